"""Filters over paper records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Filters
from ..functions.ids import has_code, text

PREPRINTS = ("arXiv", "Hugging Face")


def passes(f: Filters) -> Column:
    """One predicate over pushed-down columns: title, code, year, citations, excluded words."""
    ok = text("title") != ""
    if f.require_code:
        ok &= has_code()
    year = F.coalesce(F.col("year"), F.lit(0))
    ok &= (year == 0) | (year >= f.min_year)
    ok &= F.coalesce(F.col("source").isin(*PREPRINTS), F.lit(False)) | (F.coalesce(F.col("citations"), F.lit(0)) >= f.min_citations)
    words = F.lower(F.concat(text("title"), F.lit(" "), text("abstract")))
    for k in f.exclude_keywords:
        ok &= ~F.contains(words, F.lit(k.lower()))
    return ok


def apply_filters(papers: DataFrame, f: Filters) -> DataFrame:
    return papers.where(passes(f))


def usable_links(links: DataFrame) -> DataFrame:
    return links.where((text("arxiv_id") != "") & F.col("repo_url").isNotNull())


def library_view(entries: DataFrame, view: str = "all", folder: str | None = None) -> DataFrame:
    """Saved, liked or summarised entries, optionally of one folder."""
    keep = {"saved": F.col("saved"), "liked": F.col("rating") > 0, "summarized": text("summary") != ""}.get(view, F.lit(True))
    return entries.where(F.coalesce(keep, F.lit(False)) & (F.lit(True) if folder is None else F.array_contains("folders", folder)))


def can_train(labels: DataFrame, least: int = 10, each: int = 3) -> DataFrame:
    """One row: whether there are enough labels (column label, 0 or 1) of both kinds."""
    n, likes = F.count("*"), F.coalesce(F.sum("label"), F.lit(0))
    return labels.agg(n.alias("labels"), likes.alias("likes"), ((n >= least) & (F.least(likes, n - likes) >= each)).alias("trainable"))
