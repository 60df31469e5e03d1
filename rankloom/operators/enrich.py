"""Code links, dataset catalogue, model scores and other lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import base_name, dataset_search, has_code, norm_name, strip_version, text
from ..functions.text import clamp, clean_names
from .filters import usable_links


def code_index(links: DataFrame) -> DataFrame:
    """(arxiv_id, repo_url, official, framework) of usable links, without version suffixes."""
    return usable_links(links).select(
        strip_version(F.col("arxiv_id")).alias("arxiv_id"), "repo_url", F.coalesce("official", F.lit(0)).alias("official"), F.coalesce("framework", F.lit("none")).alias("framework")
    )


def best_links(index: DataFrame) -> DataFrame:
    """One link per id: official first, then a known framework, then the smallest address.

    An aggregate with map-side combine, so an id with very many links costs its own partitions little.
    """
    rank = F.struct(-F.col("official"), (F.col("framework") == "none").alias("none"), "repo_url", "framework")
    best = index.groupBy("arxiv_id").agg(F.min(rank).alias("b"))
    return best.select("arxiv_id", F.col("b.repo_url").alias("repo_url"), (F.col("b.col1") < 0).alias("official"), F.col("b.framework").alias("framework"))


def attach_code(papers: DataFrame, links: DataFrame, arxiv_id: Column) -> DataFrame:
    """Papers with the best link: an official one replaces theirs, any fills a gap; a known framework is always taken."""
    best = best_links(code_index(links).join(papers.select(arxiv_id.alias("arxiv_id")).distinct(), "arxiv_id", "left_semi"))
    hit = best.select(F.col("arxiv_id").alias("_id"), F.col("repo_url").alias("_repo"), F.col("official").alias("_official"), F.col("framework").alias("_framework"))
    joined = papers.withColumn("_key", arxiv_id).join(hit, F.col("_key") == F.col("_id"), "left")
    take = F.col("_repo").isNotNull() & (~has_code() | F.col("_official"))
    return joined.withColumns(
        {
            "code_url": F.when(take, F.col("_repo")).otherwise(F.col("code_url")),
            "code_official": F.when(take, F.col("_official")).otherwise(F.col("code_official")),
            "code_framework": F.when(F.col("_framework") != "none", F.col("_framework")).otherwise(F.col("code_framework")),
        }
    ).drop("_key", "_id", "_repo", "_official", "_framework")


def catalogue(raw: DataFrame) -> DataFrame:
    """(key, name, homepage) from names, variants and use counts: official names beat variants, then use, then name."""
    used = F.coalesce("num_papers", F.lit(0)).alias("used")
    names = raw.where("name IS NOT NULL").select(norm_name(F.col("name")).alias("key"), "name", text("homepage").alias("homepage"), F.lit(0).alias("prio"), used)
    variants = raw.where("name IS NOT NULL").select("name", text("homepage").alias("homepage"), used, F.explode("variants").alias("v"))
    both = names.unionByName(variants.select(norm_name(F.col("v")).alias("key"), "name", "homepage", F.lit(1).alias("prio"), "used")).where("key <> ''")
    return both.groupBy("key").agg(F.min(F.struct("prio", (-F.col("used")).alias("used"), "name", "homepage")).alias("m")).select("key", "m.name", "m.homepage")


def dataset_links(names: DataFrame, datasets: DataFrame) -> DataFrame:
    """(name, link): the homepage of the entry with the name's key or its base key, else a search link."""
    homes = datasets.where(F.col("homepage").startswith("http")).groupBy("key").agg(F.min("homepage").alias("homepage"))
    asked = names.where(F.col("name").isNotNull()).select("name").distinct().withColumn("k", norm_name(F.col("name")))
    exact = asked.join(homes.select(F.col("key").alias("k"), F.col("homepage").alias("h1")), "k", "left").withColumn("k2", base_name(F.col("k")))
    based = exact.join(homes.select(F.col("key").alias("k2"), F.col("homepage").alias("h2")), "k2", "left")
    return based.select("name", F.coalesce("h1", "h2", dataset_search(F.col("name"))).alias("link"))


def cleaned_scores(scores: DataFrame) -> DataFrame:
    """Model answers with scores clamped to 0..10 and dataset names cleaned."""
    return scores.withColumns({"relevance": clamp(F.col("relevance"), 0.0, 10.0), "recruiter": clamp(F.col("recruiter"), 0.0, 10.0), "datasets": clean_names(F.col("datasets"))})


def apply_scores(pool: DataFrame, scores: DataFrame, key: str = "search_id", order: str = "score_id") -> DataFrame:
    """Pool (key, pos, ...) with the last answer for each position; answers beyond the pool are ignored."""
    fields = [c for c in ("relevance", "recruiter", "datasets", "needs_gpu") if c in scores.columns]
    last = cleaned_scores(scores).groupBy(key, F.col("idx").alias("pos")).agg(F.max_by(F.struct(*fields), F.col(order)).alias("s"))
    return pool.join(last, [key, "pos"], "left").select(pool["*"], *(F.col(f"s.{c}").alias(f"new_{c}") for c in fields))


def cache_misses(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of (model, paper_key, text_hash): a hit has the same text; the latest cached row counts."""
    latest = cache.where(F.col("vec").isNotNull()).groupBy("model", "paper_key").agg(F.max_by("text_hash", F.struct("computed_at", "vec_id")).alias("cached_hash"))
    both = wanted.join(latest, ["model", "paper_key"], "left")
    hit = F.coalesce(F.col("cached_hash") == F.col("text_hash"), F.lit(False))
    return both.where(hit).drop("cached_hash"), both.where(~hit).drop("cached_hash")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
