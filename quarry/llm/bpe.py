"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies, in Arrow batches.

A text becomes one symbol per code point; an agenda of adjacent symbol pairs, best score first and leftmost among equals, is
worked off, each pop merging its pair and entering the two new neighbours. Symbols outside the vocabulary become
byte pieces. No merge of a vocabulary without a piece like ``x▁y`` can cross the start of a run of ``▁``, so such a text
is cut there into units, and a task remembers the encodings of a bounded number of short units. A vocabulary
with crossing pieces is worked on whole texts.

The vocabulary (tens of thousands of pieces) is read once on the driver through the sentencepiece library and sent to
the tasks. :func:`mismatches` holds results against that library, batch by batch.

Vocabularies of the unigram type (whose scores are no ranks), without byte pieces, or with white space squeezed are refused.

Edge cases: null and empty texts have no ids and decode to the empty text; any code point, U+2581 too, takes the
library's way; other columns are carried untouched when asked for; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType

from quarry.llm.common import schema

MARK = "▁"
#: Encodings of short units that a task remembers; then it starts afresh.
CACHE = 300_000
#: Units up to this length look for the best pair by a scan, longer ones by a heap.
SHORT = 48


@dataclass(frozen=True)
class Vocabulary:
    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    surfaces: list[str | int]  # a byte piece's value, else the decoded text; None: nothing
    unknown: int
    prefix: bool
    squeeze: bool
    crossing: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, bytes_, surfaces = {}, {}, [-1] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                bytes_[value] = i
                surfaces.append(value)
            elif sp.is_control(i) or sp.is_unknown(i):
                surfaces.append(" ⁇ " if sp.is_unknown(i) else "")
            else:
                ids[piece], scores[piece] = i, sp.get_score(i)
                surfaces.append(piece.replace(MARK, " "))
        if -1 in bytes_:
            raise ValueError("this vocabulary has no byte pieces for symbols outside of it")
        if any(s != int(s) for s in scores.values()):
            raise ValueError("scores of a merge-type vocabulary are ranks; this one's are not whole numbers")
        # Whether a mark is put before the text and runs of spaces are squeezed shows in what the library makes of a text.
        first = sp.encode("a", out_type=str)
        return cls(ids, scores, bytes_, surfaces, sp.unk_id(), first[0].startswith(MARK), sp.decode(sp.encode("a  b")) == "a b", any(re.search(f"[^{MARK}]{MARK}", p) for p in ids))


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        if vocabulary.squeeze:
            raise ValueError("this vocabulary squeezes white space; only identity normalisation is supported")
        self.v = vocabulary
        self.rank = {p: -s for p, s in vocabulary.scores.items()}
        self.seen: dict[str, tuple[int, str, str]] = {}
        self.units = re.compile(f"{MARK}*[^{MARK}]*" if not vocabulary.crossing else ".*", re.S)

    def merged(self, unit: str) -> list[str]:
        return self._scan(unit) if len(unit) <= SHORT else self._heap(unit)

    def _scan(self, unit: str) -> list[str]:
        """The agenda as a list in text order: its best entry is the leftmost of the least."""
        get, none = self.rank.get, float("inf")
        parts = list(unit)
        agenda = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        last = len(agenda)
        while last and (best := min(agenda)) != none:
            i = agenda.index(best)
            new = parts[i] + parts.pop(i + 1)
            parts[i] = new
            del agenda[i]
            last -= 1
            if i:
                agenda[i - 1] = get(parts[i - 1] + new, none)
            if i < last:
                agenda[i] = get(new + parts[i + 1], none)
        return parts

    def _heap(self, unit: str) -> list[str]:
        get = self.rank.get
        parts: list[str] = list(unit)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(r, i, 2) for i in range(n - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = right[i]
            if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has merged since
            parts[i] += parts[j]
            parts[j] = ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            for a, b in ((left[i], i), (i, k)):
                if a >= 0 and b >= 0 and (r := get(parts[a] + parts[b])) is not None:
                    heapq.heappush(agenda, (r, a, len(parts[a]) + len(parts[b])))
        return [p for p in parts if p]

    def unit_ids(self, unit: str) -> list[int]:
        ids, out = self.v.ids, []
        for p in self.merged(unit):
            i = ids.get(p)
            if i is None:
                out += [self.v.bytes_[b] for b in p.encode("utf-8", "replace")]
            else:
                out.append(i)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids, with the mark before the text still in it as a space; broken byte runs give U+FFFD."""
        out, run = [], bytearray()
        for i in ids:
            s = self.v.surfaces[i]
            if isinstance(s, int):
                run.append(s)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(s)
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def _unit(self, unit: str) -> tuple[int, str, str]:
        ids = self.unit_ids(unit)
        got = (len(ids), ",".join(map(str, ids)), self.decode(ids))
        if len(unit) <= SHORT:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[unit] = got
        return got

    def _prepared(self, text: str) -> str:
        return (MARK if self.v.prefix else "") + text.replace(" ", MARK)

    def encode(self, text: str | None) -> list[int]:
        return [i for u in self.units.findall(self._prepared(text)) if u for i in self.unit_ids(u)] if text else []

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text)."""
        if not text:
            return 0, "", ""
        seen, unit = self.seen.get, self._unit
        got = [seen(u) or unit(u) for u in self.units.findall(self._prepared(text)) if u]
        decoded = "".join([g[2] for g in got])
        return sum([g[0] for g in got]), ",".join([g[1] for g in got]), decoded[1:] if self.v.prefix and decoded.startswith(" ") else decoded


def _tokens(vocabulary, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1):
                k, joined, back = encoder.digest(text.as_py())
                n.append(k)
                if full:
                    ids.append([int(x) for x in joined.split(",")] if joined else [])
                    decoded.append(back)
                else:
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32()) if full else pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids", "decoded"])

    return run


def tokenize(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded) of each text; with digests, ids and decoded are SHA-256 in hex (of ids joined by commas)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = schema(id=rows.schema["id"].dataType, n_tokens=LongType(), ids=StringType() if digests else ArrayType(IntegerType()), decoded=StringType())
    return rows.mapInArrow(_tokens(vocabulary, not digests), kind)


def mismatches(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of texts whose ids or decoded text differ from the sentencepiece library's; both are made in the same Arrow batches."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp, encoder = sentencepiece.SentencePieceProcessor(model_file=model_path), Encoder(vocabulary.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            theirs = sp.encode(texts, num_threads=1)
            mine = [encoder.digest(t) for t in texts]
            bad = [m != (len(t), ",".join(map(str, t)), sp.decode(t)) for m, t in zip(mine, theirs)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(bad, pa.bool_()))], ["id"])

    return rows.mapInArrow(differ, schema(id=rows.schema["id"].dataType))
