"""The reading library: a log of changes folded into one entry per paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(value: str, when: str = "updated", tie: Column | None = None) -> Column:
    """The newest value that is not NULL; ties in time go to the larger value."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(when, tie if tie is not None else F.col(value))))


def fold(log: DataFrame, key: str = "paper_key") -> DataFrame:
    """One entry per key: each field keeps its newest value, added is the first, unsaved papers leave their folders.

    Aggregates with map-side combine, so a key with very many changes is folded before the shuffle.
    """
    none = F.array().cast("array<string>")
    e = log.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.coalesce(latest("rating"), F.lit(0)).alias("rating"), F.coalesce(latest("saved"), F.lit(False)).alias("saved"), F.coalesce(latest("folders"), none).alias("folders"),
        F.coalesce(latest("summary"), F.lit("")).alias("summary"), F.min("added").alias("added"), F.max("updated").alias("updated"), F.count("*").alias("changes"),
    )
    return e.withColumn("folders", F.when(F.col("saved"), sort_folders(F.col("folders"))).otherwise(none))


def sort_folders(folders: Column) -> Column:
    """Names without case, equal ones by code points."""
    keyed = F.array_sort(F.transform(F.array_distinct(folders), lambda f: F.struct(F.lower(f).alias("l"), f.alias("f"))))
    return F.transform(keyed, lambda x: x["f"])


def folder_name(name: Column) -> Column:
    """At most 60 characters with single blanks; NULL if nothing is left."""
    n = F.substring(F.trim(F.regexp_replace(name, r"\s+", " ")), 1, 60)
    return F.when(n != "", n)


def set_folder(entries: DataFrame, name: str, add: bool, key: str = "paper_key", keys: DataFrame | None = None) -> DataFrame:
    """entries with a folder added (which also saves) or removed, for the given keys or all."""
    n = folder_name(F.lit(name))
    has = F.array_remove("folders", n)
    changed = sort_folders(F.concat(has, F.array(n))) if add else has
    hit = F.lit(True) if keys is None else F.col("_hit").isNotNull()
    src = entries if keys is None else entries.join(keys.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(1)), F.col(key) == F.col("_k"), "left")
    out = src.withColumns({"folders": F.when(hit & n.isNotNull(), changed).otherwise(F.col("folders")), "saved": (F.when(hit & n.isNotNull(), True).otherwise(F.col("saved")) if add else F.col("saved"))})
    return out.drop("_k", "_hit")


def folder_counts(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("folders").alias("name")).groupBy("name").agg(F.count("*").alias("count"))


def rated_titles(entries: DataFrame, keep: int = 15) -> DataFrame:
    """(rating, titles): the newest liked and disliked titles, oldest first."""
    rated = entries.where("rating <> 0").select(F.when(F.col("rating") > 0, "liked").otherwise("disliked").alias("rating"), "updated", "paper_key", "title")
    newest = Window.partitionBy("rating").orderBy(F.desc("updated"), F.desc("paper_key"))
    top = rated.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= keep)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("rn"), "title")))
    return top.groupBy("rating").agg(F.transform(listed, lambda x: x["title"]).alias("titles"))


def get(entries: DataFrame, *keys: str, key: str = "paper_key") -> DataFrame:
    """The entries of the given keys."""
    return entries.where(F.col(key).isin(*keys))


def remove(entries: DataFrame, keys: DataFrame, key: str = "paper_key") -> DataFrame:
    return entries.join(keys.select(key).distinct(), key, "left_anti")


def upsert(entries: DataFrame, changes: DataFrame, key: str = "paper_key") -> DataFrame:
    """entries with the changed fields of changes (NULL leaves a field as it is)."""
    fields = [c for c in changes.columns if c != key]
    new = changes.groupBy(key).agg(*(F.max_by(F.col(c), "updated").alias(f"_n_{c}") if "updated" in fields else F.max(c).alias(f"_n_{c}") for c in fields))
    both = entries.join(new, key, "full")
    return both.select(key, *(F.coalesce(f"_n_{c}", c).alias(c) if c in fields else F.col(c) for c in entries.columns if c != key))
