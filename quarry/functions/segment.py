"""Words of texts without spaces by a caller's dictionary, and conversion by tables of phrases. Both work in Arrow batches.

Segmentation: a run of letters and digits is a lattice whose edges are the dictionary's words in it, weighed by log frequency; the best path is
found by dynamic programming from the right. Where no word of the dictionary fits, a single character is an edge of its own, as rare as a word
can be; such characters in a row are joined again to one word if they are of scripts written with spaces (a name in Latin letters, a number).

Conversion: at each place the longest phrase of a table that fits is replaced, else the character alone; several tables follow one another.

Edge cases: null gives no words (segmentation) or null (conversion); an empty dictionary leaves runs of letters, and single characters of scripts without
spaces; words of no frequency count as seen once; of equally good paths the one whose first word is longer is taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from math import log

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_RUN = re.compile(r"[^\W_]+")
#: Scripts that put no spaces between words: Thai to Tibetan, Khmer, kana and Han.
_UNSPACED = re.compile(r"[฀-࿿ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")


class Lexicon:
    """Words with their frequencies; ``reach`` is the longest word with each first character."""

    def __init__(self, frequencies: Mapping[str, float]):
        kept = {w.lower(): max(float(f or 0), 1.0) for w, f in frequencies.items() if w}
        total = log(sum(kept.values()) or 1.0)
        self.weight = {w: log(f) - total for w, f in kept.items()}
        self.unknown = min(self.weight.values(), default=0.0) - 1.0
        self.reach: dict[str, int] = {}
        for w in kept:
            self.reach[w[0]] = max(self.reach.get(w[0], 1), len(w))

    def path(self, run: str) -> list[str]:
        """The run as words of the dictionary and unknown characters, the best sum of weights."""
        n = len(run)
        best, step = [0.0] * (n + 1), [1] * n
        for i in range(n - 1, -1, -1):
            best[i] = self.weight.get(run[i], self.unknown) + best[i + 1]
            for k in range(2, min(self.reach.get(run[i], 1), n - i) + 1):
                w = self.weight.get(run[i : i + k])
                if w is not None and w + best[i + k] >= best[i]:
                    best[i], step[i] = w + best[i + k], k
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out

    def words(self, text: str | None) -> list[str]:
        """Lower-cased words of a text."""
        out: list[str] = []
        for m in _RUN.finditer((text or "").lower()):
            loose = ""
            for w in self.path(m[0]):
                if len(w) == 1 and w not in self.weight and not _UNSPACED.match(w):
                    loose += w
                    continue
                out += [loose, w] if loose else [w]
                loose = ""
            out += [loose] if loose else []
        return out


def tokenizer(spark: SparkSession, frequencies: Mapping[str, float]) -> Callable[[Column], Column]:
    """A tokenizer for :func:`quarry.operators.lexical.index`: text -> array<string>. The dictionary, the caller's own, goes to each executor once."""
    known = spark.sparkContext.broadcast(Lexicon(frequencies))

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(known.value.words)

    return run


def _longest(table: Mapping[str, str]) -> Callable[[str], str]:
    reach: dict[str, int] = {}
    for k in table:
        reach[k[0]] = max(reach.get(k[0], 0), len(k))

    def convert(text: str) -> str:
        out, i = [], 0
        while i < len(text):
            for k in range(min(reach.get(text[i], 0), len(text) - i), 0, -1):
                if (new := table.get(text[i : i + k])) is not None:
                    out.append(new)
                    i += k
                    break
            else:
                out.append(text[i])
                i += 1
        return "".join(out)

    return convert


def convert_phrases(text: Column, tables: Sequence[Mapping[str, str]]) -> Column:
    """text through the tables one after the other. A table of single characters alone stays in the JVM."""
    for table in tables:
        table = {k: v for k, v in table.items() if k}
        if all(len(k) == 1 and len(v) == 1 for k, v in table.items()):
            text = F.translate(text, "".join(table), "".join(table.values())) if table else text
        else:
            text = _mapped(table)(text)
    return text


def _mapped(table: Mapping[str, str]):
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        convert = _longest(table)
        for s in batches:
            yield s.map(convert, na_action="ignore")

    return run
