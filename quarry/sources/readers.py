"""Readers. All go through Spark's sources, so any store Spark can reach will do."""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import py_strip

#: Folders and files that are not pages.
SKIPPED_FOLDERS = ("_includes", ".github", "node_modules", "static")
SKIPPED_FILES = ("LICENSE", "LicenseCredits.md", "readme.md")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def relative(root: str) -> Column:
    """Path of the file a row came from, below ``root``."""
    tail = root.rstrip("/").split("://", 1)[-1].split(":", 1)[-1].lstrip("/") + "/"
    return F.substring_index(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), tail, -1)


def text_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, text) of all matching files below root, each whole."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    return files.select(relative(root).alias("path"), F.col("value").alias("text"))


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, module, text) of pages; ``module`` is the path without its suffix."""
    parts = F.split("path", "/")
    files = text_files(spark, root, "*.md").where(~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_FOLDERS))) & ~F.element_at(parts, -1).isin(*SKIPPED_FILES) & F.col("text").rlike(r"(?U)\S"))
    return files.select("path", F.regexp_replace("path", r"\.md$", "").alias("module"), "text")


def text_chunks(spark: SparkSession, root: str) -> DataFrame:
    """(path, topic, text) of non-blank .txt files; the topic is the first folder."""
    return text_files(spark, root, "*.txt").select("path", F.split("path", "/")[0].alias("topic"), py_strip(F.col("text")).alias("text")).where("text <> ''")


def translation_cache(spark: SparkSession, path: str) -> DataFrame:
    """(version, key, translated) of a JSON cache, nested under ``translations`` or flat as older ones are."""
    doc = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    nested = F.try_variant_get("v", "$.translations", "map<string,string>")
    every = F.coalesce(nested, F.try_variant_get("v", "$", "map<string,string>"))
    rows = doc.select(F.coalesce(F.try_variant_get("v", "$.__commit__", "string"), F.lit("")).alias("version"), F.explode(every).alias("key", "translated"))
    return rows.where("key not like '\\\\_\\\\_%'")


def indexed_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(md5, version): hashes of the texts that a stored cache holds, and the version it was made for."""
    return translation_cache(spark, path).select(F.col("key").alias("md5"), "version").distinct()


def json_lines(spark: SparkSession, root: str) -> DataFrame:
    """(file, n, line): lines of .jsonl files with their number, decoded by the ladder of :func:`decode`."""
    files = binary_files(spark, root, "*.jsonl").select("path", decode(F.col("content")).alias("text"))
    return files.select(F.col("path").alias("file"), F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "line"))


def json_documents(raw: DataFrame, text_col: str) -> DataFrame:
    """raw with ``doc`` (variant) and ``error``: text that does not parse gives a message, not an exception."""
    doc = F.try_parse_json(F.col(text_col))
    return raw.withColumn("doc", doc).withColumn("error", F.when(F.col(text_col).isNotNull() & doc.isNull(), "not valid JSON"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(route, title, path, has_page, synthetic, source_rel) of a generated manifest. A missing file and a broken one are told apart by message."""
    from pyspark.errors import AnalysisException

    try:
        doc = spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("v"))
    except AnalysisException as e:
        raise FileNotFoundError(f"no manifest was generated at {path}") from e
    flat = "array<struct<route:string,title:string,path:string,hasPage:boolean,synthetic:boolean,sourceRel:string>>"
    checked = F.when(F.col("v").isNull(), F.raise_error(F.lit(f"the manifest at {path} is corrupt"))).otherwise(F.try_variant_get("v", "$.flat", flat))
    rows = doc.select(F.explode(checked).alias("p"))
    return rows.select("p.route", "p.title", "p.path", F.col("p.hasPage").alias("has_page"), "p.synthetic", F.col("p.sourceRel").alias("source_rel"))


def binary_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, content) of all matching files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(relative(root).alias("path"), "content")


def _decoded(raw: bytes | None) -> str | None:
    for name in ("utf-8-sig", "gbk"):
        try:
            return raw.decode(name) if raw is not None else None
        except UnicodeDecodeError:
            continue
    return None


def decode(content: Column) -> Column:
    """Text of bytes in UTF-8 (with or without a mark) or GBK; null for others. Valid UTF-8 stays in the JVM."""

    @F.pandas_udf("string")
    def ladder(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(_decoded)

    return ladder(content)


def _json_of(value: str) -> str | None:
    """JSON text that is plain or in base64."""
    for raw in (lambda: value, lambda: _decoded(base64.b64decode(value, validate=False))):
        try:
            text = raw()
            json.loads(text)
            return text
        except (TypeError, ValueError):
            continue
    return None


def png_texts(data: bytes) -> dict[str, str]:
    """Keyword to text of a PNG's tEXt, zTXt and iTXt chunks; {} for what is not a PNG."""
    out: dict[str, str] = {}
    at = 8
    while data[:8] == b"\x89PNG\r\n\x1a\n" and at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        key, _, rest = body.partition(b"\0")
        try:
            if kind == b"tEXt":
                out[key.decode("latin-1")] = rest.decode("latin-1")
            elif kind == b"zTXt":
                out[key.decode("latin-1")] = zlib.decompress(rest[1:]).decode("latin-1")
            elif kind == b"iTXt":
                packed, (_, _, text) = rest[0], rest[2:].split(b"\0", 2)
                out[key.decode("latin-1")] = (zlib.decompress(text) if packed else text).decode("utf-8")
        except (ValueError, IndexError, zlib.error):
            continue
    return out


def _card(data: bytes | None, keys: Sequence[str]) -> str | None:
    texts = png_texts(data or b"")
    ordered = [texts[k] for k in keys if k in texts] + [v for k, v in texts.items() if k not in keys]
    return next((found for found in map(_json_of, ordered) if found), None)


def card_json(content: Column, keys: Sequence[str] = ("ccv3", "chara")) -> Column:
    """JSON that a PNG card holds: the newer keyword first, then any other text; null if none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda b: _card(b, keys))

    return run(content)
