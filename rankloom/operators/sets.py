"""Unions with precedence, exclusions and first appearances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precedence(parts: list[DataFrame], key: str, within: list[Column] | None = None) -> DataFrame:
    """The union of parts with one row per key: later parts win, and within a part the larger of ``within``.

    Adds first, the smallest pos of any appearance. One aggregate with map-side combine.
    """
    fields = [c for c in parts[0].columns if c not in (key, "pos")]
    tagged = [p.select(key, "pos", F.struct(F.lit(i).alias("part"), *(w.alias(f"w{n}") for n, w in enumerate(within or []))).alias("_o"), F.struct(*fields).alias("_v")) for i, p in enumerate(parts)]
    all_rows = tagged[0]
    for t in tagged[1:]:
        all_rows = all_rows.unionByName(t)
    return all_rows.groupBy(key).agg(F.max_by("_v", "_o").alias("v"), F.min("pos").alias("first")).select(key, "first", "v.*")


def missing(base: DataFrame, extra: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """Rows of extra whose key base lacks, the first ``cap`` by key where a request may bring no more."""
    new = extra.join(base.select(key).distinct(), key, "left_anti").dropDuplicates([key])
    return new if cap is None else new.orderBy(key).limit(cap)


def unshown(pool: DataFrame, shown: DataFrame, keys: list[str]) -> DataFrame:
    return pool.join(shown.select(*keys).distinct(), keys, "left_anti")


def known_keys(entries: DataFrame, key: str = "paper_key") -> DataFrame:
    return entries.where(F.col("saved") | (F.col("rating") != 0)).select(key).distinct()


def overlay(base: DataFrame, ranked: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """base with the fields of ranked where it has the row; shortlisted tells which."""
    r = ranked.select(*keys, *(F.col(c).alias(f"_r_{c}") for c in fields), F.lit(True).alias("_hit"))
    j = base.join(r, keys, "left")
    return j.withColumns({c: F.when(F.col("_hit"), F.col(f"_r_{c}")).otherwise(F.col(c)) for c in fields} | {"shortlisted": F.coalesce("_hit", F.lit(False))}).drop("_hit", *(f"_r_{c}" for c in fields))
