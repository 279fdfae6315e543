"""Temperature mixing of sources, realised as budgeted block permutations. Built-in functions only.

A source with token share p gets the weight p**x, normalised. The exponent x in [0, 1] is bisected: the largest one whose
weights have the target entropy (a part of the even mix's), but none so small that a source would have to repeat
more often than ``max_repetition``. Weights become token quotas, and quotas become seeded permutations of each source's
documents, epoch after epoch, cut into blocks that all hold the sources in proportion.

With no budget given it is the smallest that takes each document at least once, so nothing is lost and small sources repeat.

Words are counted in one pass, which writes a narrow row a document: its place in the input (path of the file and row index), id, source, count
and hash. Placements are made of those; carried columns are joined last, by place, so a text is shuffled once however often it repeats.

Edge cases: a null source is a source of its own; null or empty texts hold no tokens and are placed once; those of a source
without any token are dealt over all blocks by hash; repeated rows are placed one by one, and spread over the parts like others; a
single source gets weight 1; an empty table gives no rows. Carried columns may have any name, as they travel in a struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import ASCII_SPACE, placed, written

#: Halvings of the exponent's range that one pass over the shares decides, and such passes.
LEVELS, PASSES = 5, 5
#: Documents in a part of a source's permutation; a source of any size is ordered part by part.
PART_ROWS = 5_000
#: Sources up to which their table (a few numbers each) is broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Tokens of a text: runs without ASCII white space."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(F.octet_length(body) == 0, F.lit(0)).otherwise(F.size(F.split(body, "[ \\t\\n\\x0B\\f\\r]+"))).cast("long")


def _bisect(shares: DataFrame, holds) -> float:
    """The least x in [0, 1] with holds(x, Z, E), Z = sum p**x and E = sum p**x ln p; 1 if none. holds must turn true once."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        n = 2**LEVELS
        points = [low + (high - low) * i / n for i in range(1, n)]
        # The points are data, not code, so that one compiled plan serves every pass.
        at = shares.select("ln_p", F.explode(F.array(*map(F.lit, points))).alias("x")).withColumn("z", F.exp(F.col("x") * F.col("ln_p")))
        sums = {r["x"]: (r["z"], r["e"]) for r in at.groupBy("x").agg(F.sum("z").alias("z"), F.sum(F.col("z") * F.col("ln_p")).alias("e")).collect()}
        good = [holds(x, *sums[x]) for x in points]
        step = (high - low) / n
        for _ in range(LEVELS):  # each level looks at the midpoint, whose sums are at hand
            middle = (low + high) / 2
            i = min(range(n - 1), key=lambda k: abs(points[k] - middle))
            low, high = (low, middle) if good[i] else (middle, high)
        assert high - low <= step * 1.001
    return high


def exponent(shares: DataFrame, target_entropy: float, max_repetition: float, budget: float | None) -> float:
    """shares: one row per source with tokens > 0 and columns tokens, p, ln_p."""
    import math

    n, total, least, most = shares.agg(F.count("*"), F.sum("tokens"), F.min("p"), F.max("p")).first()
    if not n or n == 1:
        return 1.0
    goal = target_entropy * math.log(n)

    def flat(x: float, z: float, e: float) -> bool:
        return math.log(z) - x * e / z < goal

    def repeats(x: float, z: float, e: float) -> bool:
        need = budget if budget is not None else total * z * most ** (1 - x)
        return need * least**x / z <= max_repetition * total * least * (1 + 1e-12)

    return max(_bisect(shares, flat), _bisect(shares, repeats))


def _unit(*columns: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(2**53))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    target_entropy: float = 0.97,
    max_repetition: float = 4.0,
    budget: float | None = None,
    block_tokens: int = 1_000_000,
    seed: int = 17,
    carry: Sequence[str] = (),
    stored: bool = False,
) -> DataFrame:
    """One row per placement: id, source, n_tokens, epoch, weight, block, slot, then the columns of ``carry`` as struct ``row``.

    With ``stored``, docs is a plain read of files; else it is written once first, as places must be unique and survive retries. The order of a
    permutation depends on the places, so on the paths of the files.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row") if carry else F.lit(None).alias("row"))
    base = placed(base if stored else written(base))
    name = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))
    narrow = written(base.select("_at", name.alias("s"), "id", "source", word_count(F.col("text")).alias("n_tokens"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")))
    sums = written(narrow.groupBy("s").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows")))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.where("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(max(1, total)))).withColumn("ln_p", F.log("p"))
    x = exponent(shares, target_entropy, max_repetition, budget)
    z = shares.agg(F.sum(F.exp(x * F.col("ln_p")))).first()[0]
    weight = F.when(F.col("tokens") > 0, F.exp(x * F.log(F.col("tokens") / F.lit(float(max(1, total))))) / F.lit(float(z or 1.0))).otherwise(0.0)
    need = budget if budget is not None else sums.agg(F.max(F.try_divide("tokens", weight))).first()[0] or 0.0
    quotas = sums.withColumn("weight", weight).withColumn("quota", F.round(F.col("weight") * need, 3))
    quotas = quotas.withColumn("epochs", F.greatest(F.lit(1), F.ceil(F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens") - 1e-9).otherwise(1)))).withColumn("parts", F.ceil(F.col("n_rows") / PART_ROWS))
    quotas = written(quotas.select("s", "tokens", "weight", "quota", F.col("epochs").cast("int").alias("epochs"), F.col("parts").cast("int").alias("parts")))
    few = sums.count() <= BROADCAST_SOURCES

    dealt = narrow.join(F.broadcast(quotas) if few else quotas, "s").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    dealt = dealt.withColumn("u", _unit(F.lit(seed), "epoch", "id", "h", "_at")).withColumn("part", F.floor(F.col("u") * F.col("parts")).cast("int"))
    keys = ["s", "epoch", "part"]
    slim = dealt.groupBy(*keys).agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.partitionBy("s").orderBy("epoch", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.select(*keys, F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys).orderBy("u", "id", "_at").rowsBetween(Window.unboundedPreceding, -1)
    # The bare part name is shuffled with the row; the joined starts are one row per part.
    ordered = dealt.withColumn("run", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, keys).withColumn("at", F.col("start") + F.col("run"))
    taken = ordered.where((F.col("at") < F.col("quota")) | ((F.col("n_tokens") == 0) & (F.col("epoch") == 0)))
    blocks = max(1, -int(-need // block_tokens))
    block = F.when(F.col("weight") > 0, F.floor(F.col("at") / (F.col("weight") * block_tokens))).otherwise(F.floor(F.col("u") * blocks)).cast("long")
    slots = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "id", "epoch", "_at"), "id", "epoch", "_at")
    out = taken.withColumn("block", block).withColumn("slot", F.row_number().over(slots).cast("long") - 1)
    columns = ["id", "source", "n_tokens", "epoch", "weight", "block", "slot"]
    if not carry:
        return out.select(*columns)
    # A document's placements are as many as its source's epochs; they meet its one row and are unfolded behind the join.
    each = out.groupBy("_at").agg(F.collect_list(F.struct(*columns)).alias("p"))
    # Sorted on both sides whatever their size: what reads well for a small table must be what runs for a large one.
    return base.select("_at", "row").join(each.hint("merge"), "_at").select(F.explode("p").alias("p"), "row").select("p.*", "row")
