"""Readers and writers of the engine's own tables: snapshots, library, index, cache, results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import snapshot_id
from ..schema import SNAPSHOT


# Fixed value: what follows a text that was cut.
CUT_NOTE = "[... truncated to fit the model's context ...]"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All saved searches; file order is the time order of their names."""
    raw = spark.read.schema(SNAPSHOT).option("recursiveFileLookup", True).json(path)
    return raw.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).withColumn("file_id", snapshot_id(F.col("file")))


def snapshot(spark: SparkSession, path: str, search_id: str) -> DataFrame:
    """One search by its 12 hexadecimal digits; no rows for anything else."""
    ok = len(search_id) == 12 and all(c in "0123456789abcdef" for c in search_id)
    return read_snapshots(spark, path).where(F.lit(ok) & (F.col("id") == search_id))


def candidates(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(F.col("id").alias("search_id"), "time", F.posexplode("candidates").alias("pos", "c")).select("search_id", "time", "pos", "c.*")


def slug(query: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(query), r"[^\p{L}\p{N}_]+", "-"), "^-+|-+$", "")
    return F.substring(s, 1, 40)


def build_snapshots(searches: DataFrame, pool: DataFrame, fields: list[str]) -> DataFrame:
    """One row per search with its candidates in pool order. A pool is one search's candidates, bounded by its sources."""
    listed = pool.groupBy("search_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("c")))).alias("cs"))
    return searches.join(listed, "search_id", "left").withColumn("candidates", F.transform("cs", lambda x: x["c"])).drop("cs")


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("append").json(path)


def write_version(df: DataFrame, base: str) -> str:
    """A new version of a table beside the old ones. Readers follow the pointer, which is replaced last."""
    version = f"{base}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    spark = df.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{base}/current")
    return version


def read_version(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(spark.read.schema("version string").json(f"{base}/current").first()["version"])


def upsert_vectors(cache: DataFrame, new: DataFrame) -> DataFrame:
    """cache with new rows in place of those of the same model and key."""
    return cache.join(new.select("model", "paper_key").distinct(), ["model", "paper_key"], "left_anti").unionByName(new)


def write_index(links: DataFrame, path: str) -> None:
    """The link index, sorted by id within files so that lookups skip row groups."""
    links.repartition("arxiv_id").sortWithinPartitions("arxiv_id").write.mode("overwrite").parquet(path)


def append_results(summary: DataFrame, path: str, stamp: str) -> None:
    """One line per strategy with metrics of four decimals; each run adds files with a header."""
    cols = [F.lit(stamp).alias("timestamp"), "strategy", "searches", *(F.format_string("%.4f", c).alias(c) for c in ("p_5", "p_10", "ndcg_10", "mrr"))]
    summary.select(*cols).coalesce(1).write.mode("append").option("header", True).csv(path)


def migrate_cv_log(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both logs with one schema; rows from before the features column are of the embedding kind."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumn("features", F.coalesce("features", F.lit("embedding")))


def pages_within(pages: DataFrame, most: int, doc: str = "doc_id") -> DataFrame:
    """Text of a document from its pages (doc, page, text) up to ``most`` characters, marked by page."""
    w = Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.concat(F.lit("\n[p. "), F.col("page").cast("string"), F.lit("]\n"), F.trim(F.regexp_replace("text", r"\s+", " ")))
    before = F.coalesce(F.sum(F.length("chunk")).over(w), F.lit(0))
    left = pages.withColumn("chunk", chunk).withColumn("left", F.lit(most) - before).where("left >= 0")
    cut = F.concat(F.substring("chunk", F.lit(1), F.col("left").cast("int")), F.lit("\n" + CUT_NOTE))
    part = left.withColumn("part", F.when(F.length("chunk") > F.col("left"), cut).otherwise(F.col("chunk")))
    listed = F.array_sort(F.collect_list(F.struct("page", "part")))
    return part.groupBy(doc).agg(F.regexp_replace(F.array_join(F.transform(listed, lambda x: x["part"]), ""), r"^\s+|\s+$", "").alias("text"))


def read_pdfs(spark: SparkSession, path: str, most_bytes: int = 25 * 1024 * 1024) -> DataFrame:
    """(path, content) of PDF files below the size limit, by their first bytes; text extraction is a plug-in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where((F.col("length") < most_bytes) & (F.substring(F.col("content"), 1, 4) == F.lit(b"%PDF"))).select("path", "length", "content")


def trending(cache: DataFrame, now: float, ttl: float = 3600.0, failed: bool = False) -> tuple[DataFrame, str]:
    """(rows, note) of the newest list: fresh, or an old one with its age where the source failed."""
    t = cache.agg(F.max("fetched_at")).first()[0]
    if t is None:
        raise LookupError("nothing cached")
    newest = cache.where(F.col("fetched_at") == t)
    age = now - t
    if age < ttl or not failed:
        return newest, "" if age < ttl else "stale"
    return newest, f"{max(1, round(age / 3600))} h old"


def write_bibtex(entries: DataFrame, path: str) -> None:
    """One citation (column entry) after another, separated by blank lines; in as many files as there are partitions."""
    entries.select("entry").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_judged(judged: DataFrame, path: str) -> None:
    """The evaluation set: one JSON row per judged candidate."""
    judged.write.mode("overwrite").json(path)


def read_judged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("search_id string, pos bigint, paper_key string, label int").json(path)
