"""Writers: tables by partition, NDJSON, text reports. Jobs write whole partitions or append, and can run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import or_default


def replace_by_source(chunks: DataFrame, path: str) -> None:
    """Replaces all rows of the sources that ``chunks`` holds and leaves others alone, in one commit."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def batch_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch is the folder of its id, so one that is written again after a failure takes its own place and adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`batch_writer` wrote, with its ``batch``; folders that were not finished are left out."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    done = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or []
    return spark.read.option("basePath", path).parquet(*[s.getPath().getParent().toString() for s in done])


def append_cache(new: DataFrame, path: str) -> None:
    """Adds (key, translated) rows."""
    new.write.mode("append").parquet(path)


def write_version(df_session, path: str, version: str) -> None:
    """A one-row table: the version that the index holds."""
    df_session.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("overwrite").parquet(path)


def ndjson(rows: DataFrame, path: str) -> None:
    """One JSON object a line, null fields left out."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def pages(rendered: DataFrame, path: str) -> None:
    """(path, body) as a table by top folder, with the bodies; a publisher copies rows to files."""
    rendered.withColumn("top", F.split("path", "/")[0]).write.mode("overwrite").partitionBy("top").parquet(path)


def manifest(nodes: DataFrame, path: str, commit: str, fingerprint: DataFrame) -> None:
    """One JSON line for each node (route, title, path, has_page, synthetic), and beside them (commit, fingerprint, pages, articles)."""
    nodes.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/flat")
    totals = nodes.agg(F.count_if("has_page").alias("pages"), F.count_if(F.col("has_page") & ~F.col("synthetic")).alias("articles"))
    totals.crossJoin(fingerprint).withColumn("commit", F.lit(commit)).coalesce(1).write.mode("overwrite").json(f"{path}/head")


def _metric(name: str, labels: list[str], value: Column) -> Column:
    shown = [F.concat(F.lit(f'{c}="'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels]
    return F.concat(F.lit(f"{name}{{"), F.concat_ws(",", *shown), F.lit("} "), value)


def exposition(metrics: DataFrame, prefix: str = "quarry") -> DataFrame:
    """(line) of the text exposition of :func:`quarry.operators.usage.request_metrics`: counters by request, time and slow requests by path."""
    rows = metrics.select(F.lit(0).alias("part"), F.struct("method", "path", F.col("status").cast("string")).alias("k"), _metric(f"{prefix}_requests_total", ["method", "path", "status"], F.col("n").cast("string")).alias("line"))
    per = metrics.groupBy("path").agg(F.sum("total_ms").alias("ms"), F.sum("n_slow").alias("slow"))
    key = F.struct(F.lit("").alias("method"), "path", F.lit("").alias("status"))
    rows = rows.union(per.select(F.lit(1), key, _metric(f"{prefix}_request_duration_ms_total", ["path"], F.format_string("%.1f", F.col("ms").cast("double")))))
    rows = rows.union(per.where("slow > 0").select(F.lit(2), key, _metric(f"{prefix}_slow_requests_total", ["path"], F.col("slow").cast("string"))))
    return rows.orderBy("part", "k").select("line")


#: Fixed values.
RATINGS = {"solved": "有帮助", "unsolved": "没解决", "irrelevant": "内容不相关"}
QUEUE_TITLE, EMPTY_QUEUE = "# 待更新知识库清单", "（还没有勾选任何条目）"


def update_queue(log: DataFrame, only_marked: bool = True) -> DataFrame:
    """(id, section): a markdown section for each (marked) question, in id order; written as text they make the list."""
    rows = log.where(F.col("marked")) if only_marked else log
    rating = F.create_map(*[F.lit(x) for kv in RATINGS.items() for x in kv])
    fb = or_default(F.col("feedback"), "")
    quoted = F.array_join(F.transform(F.split("answer", "\n"), lambda x: F.when(x.rlike(r"\S"), F.concat(F.lit("> "), x)).otherwise(">")), "\n")
    digest = F.from_json("sources_digest", "array<struct<source:string,score:double,preview:string>>")
    listed = F.transform(digest, lambda s: F.concat(F.lit("    - ["), F.coalesce(s["source"], F.lit("?")), F.lit("] "), F.coalesce(s["score"], F.lit(0.0)).cast("string"), F.lit("｜"), F.coalesce(s["preview"], F.lit(""))))
    lines = F.filter(F.array(
        F.concat(F.lit("## ["), F.col("id").cast("string"), F.lit("] "), F.substring("query", 1, 100)), F.lit(""),
        F.concat(F.lit("- 提问人："), or_default(F.col("username"), "（未登录）"), F.lit(" ｜ IP："), "ip", F.lit(" ｜ "), F.col("created_at").cast("string")),
        F.concat(F.lit("- 检索结果："), F.col("sources_count").cast("string"), F.lit(" 条来源，最高相关度 "), F.format_string("%.3f", F.col("top_score").cast("double")), F.lit("，"), F.when(F.coalesce("answered", F.lit(False)), "已解答").otherwise("**没答上来**")),
        F.when(fb != "", F.concat(F.lit("- 用户评价：**"), F.coalesce(F.try_element_at(rating, fb), fb), F.lit("**"), F.when(or_default(F.col("feedback_reason"), "") != "", F.concat(F.lit(" —— 「"), "feedback_reason", F.lit("」"))).otherwise(""))),
        F.when(or_default(F.col("answer"), "") != "", F.concat(F.lit("\n**当时系统的回答：**\n\n"), quoted)),
        F.when(F.size(digest) > 0, F.concat(F.lit("- 当时给出的来源：\n"), F.array_join(listed, "\n"))), F.lit(""),
    ), lambda x: x.isNotNull())
    return rows.select("id", F.array_join(lines, "\n").alias("section")).orderBy("id")


def write_queue(log: DataFrame, path: str, only_marked: bool = True) -> None:
    """The list as text parts whose order is the ids'."""
    sections = update_queue(log, only_marked)
    title = sections.sparkSession.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(QUEUE_TITLE + "\n").alias("section"))
    none = title.select(F.lit(0).cast("long"), F.lit(EMPTY_QUEUE + "\n")) if sections.isEmpty() else title.limit(0)
    title.union(none).union(sections).orderBy("id").select("section").write.mode("overwrite").text(path)
