"""A corpus pipeline of five stages, each one operator of quarry.llm over all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, langid, linededup, minhash, mixing
from quarry.llm.common import read, written
from quarry.sources import scratch


#: Texts farther than this from every learned language are in none of them: clean texts of a few words are below 0.45, foreign ones near 1.
FARTHEST = 0.65


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what is in no learned language: texts whose distance to every profile is over ``FARTHEST``, and those equally far from two.

    Null and empty texts and those without a letter go. Where no row names a language there is no profile to go by: all texts
    with letters stay. Ties in ``lang`` counts don't matter, repeated rows fare alike, columns may have any name beside the
    documents' own; no documents give none.
    """
    profiles = langid.fit(docs)
    if not profiles:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(docs.select(F.struct("*").alias("row"), F.col("text").alias("body")), profiles, "row", "body")
    return found.where(f"lang_pred <> 'und' and score > 0 and distance <= {FARTHEST}").select("id.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose lines that a smaller doc_id holds, with n_chars set anew; a document that loses all it had goes.

    Null and empty texts have nothing to lose and stay, as do rows with a null doc_id; repeated rows lose the same lines.
    """
    out = linededup.dedup_lines(docs)
    kept = out.where("n_dropped = 0 or btrim(kept_text) <> ''")
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    columns = {"text": text, "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*[columns.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, the one of the smallest doc_id.

    Texts without words and rows with a null doc_id are in no group and stay; rows that share a doc_id are one document.
    """
    return minhash.drop_near_duplicates(docs, n_words=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of small sources in several epochs. A null source is one of its own; texts without words are placed once."""
    return mixing.mix(docs, carry=docs.columns, stored=True).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, one row for each of docs.

    Documents that the mix repeats are counted first and encoded once. Null and empty texts have no tokens.
    """
    distinct = docs.groupBy("doc_id", "text").agg(F.count("*").alias("copies")).select(F.struct("doc_id", "copies").alias("of"), "text")
    out = bpe.tokenize(distinct, public_tokenizers.path("piece_bpe_32k.model"), "of", digests=True)
    rows = out.withColumn("copy", F.explode(F.expr("sequence(1L, id.copies)")))
    return rows.select("id.doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", encode),
]

#: Rank-order profiles, seeded hashes and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's scratch tables are removed when its output is written, and that when the next one has read it.

    Only tables made by this call are: each call has a scope of its own. What the last stage reads stays until its caller's scope removes it.
    """
    docs, own = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch.scope() as made:
            docs = written(stage(spark, docs, sf_dir))
        *others, out = made
        scratch.remove(spark, [*others, *([own] if own else [])])
        own = out
    return STAGES[-1][1](spark, docs, sf_dir)
