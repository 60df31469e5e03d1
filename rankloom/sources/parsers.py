"""Answers of paper sources turned into records, as projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import ARXIV_PAGE
from ..functions.text import collapse, invert_index

# Words that a query to the preprint source leaves out.
STOPWORDS = frozenset("a an and the of in on for to with by from via or is are".split())
HUB_PAGE, PDF_PAGE = "https://huggingface.co/papers/", "https://arxiv.org/pdf/"
ATOM = "id string, title string, summary string, published string, author array<struct<name:string>>"
HUB = "paper struct<id:string, title:string, summary:string, authors:array<struct<name:string>>, publishedAt:string, githubRepo:string, githubStars:int, upvotes:int, ai_summary:string>"
WORK = (
    "id string, title string, doi string, publication_year int, cited_by_count int, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>,"
    " primary_location struct<source:struct<display_name:string>>, best_oa_location struct<pdf_url:string>"
)
RECORD = ("title", "abstract", "authors", "year", "venue", "doi", "arxiv_id", "url", "pdf_url", "citations", "source", "field", "code_url", "stars", "upvotes", "tldr")


def preprint_query(query: str, categories: list[str]) -> str:
    """Search expression: every word must occur, in any of the categories; '' without categories."""
    if not categories:
        return ""
    words = re.findall(r"[\w-]+", query.lower())
    words = [w for w in words if w not in STOPWORDS] or [query]
    return " AND ".join(f"all:{w}" for w in words) + " AND (" + " OR ".join(f"cat:{c}" for c in categories) + ")"


def works_filter(field: int | None, subfields: list[int] | None, min_year: int) -> str:
    """Filter expression: subfields, else the field, and the first day of the earliest year; '' without either."""
    if subfields:
        scope = "primary_topic.subfield.id:" + "|".join(str(s) for s in subfields)
    elif field:
        scope = f"primary_topic.field.id:{field}"
    else:
        return ""
    return f"{scope},from_publication_date:{min_year}-01-01"


def _record(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    blank = {"authors": F.array().cast("array<string>"), "year": F.lit(None).cast("int"), "citations": F.lit(0), "stars": F.lit(0), "upvotes": F.lit(0)}
    return df.select(*(F.coalesce(values[c], blank.get(c, F.lit(""))).alias(c) if c in values else blank.get(c, F.lit("")).alias(c) for c in RECORD))


def _names(people: Column, most: int | None = None) -> Column:
    some = people if most is None else F.slice(people, 1, most)  # cut before blanks are dropped
    return F.filter(F.transform(some, lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))


def from_atom(entries: DataFrame, field: str = "") -> DataFrame:
    ident = F.substring_index("id", "/abs/", -1)
    return _record(
        entries,
        {
            "title": collapse(F.col("title")), "abstract": collapse(F.col("summary")), "authors": _names(F.col("author")), "year": F.substring("published", 1, 4).try_cast("int"), "venue": F.lit("arXiv"),
            "arxiv_id": ident, "url": F.concat(F.lit(ARXIV_PAGE), ident), "pdf_url": F.concat(F.lit(PDF_PAGE), ident), "source": F.lit("arXiv"), "field": F.lit(field),
        },
    )


def from_hub(hits: DataFrame, field: str = "") -> DataFrame:
    """Hits without an id are left out."""
    p = hits.where(F.coalesce(F.col("paper.id"), F.lit("")) != "").select("paper.*")
    return _record(
        p,
        {
            "title": collapse(F.col("title")), "abstract": collapse(F.col("summary")), "authors": _names(F.col("authors"), 12), "year": F.substring("publishedAt", 1, 4).try_cast("int"),
            "arxiv_id": F.col("id"), "venue": F.lit("arXiv"), "url": F.concat(F.lit(HUB_PAGE), F.col("id")), "pdf_url": F.concat(F.lit(PDF_PAGE), F.col("id")), "source": F.lit("Hugging Face"), "field": F.lit(field),
            "code_url": F.col("githubRepo"), "stars": F.col("githubStars"), "upvotes": F.col("upvotes"), "tldr": collapse(F.col("ai_summary")),
        },
    )


def from_works(works: DataFrame, field: str = "") -> DataFrame:
    names = F.filter(F.transform(F.slice("authorships", 1, 12), lambda a: a["author"]["display_name"]), lambda n: n.isNotNull() & (n != ""))
    return _record(
        works,
        {
            "title": F.col("title"), "abstract": F.when(F.col("abstract_inverted_index").isNotNull(), invert_index(F.col("abstract_inverted_index"))), "authors": names, "year": F.col("publication_year"),
            "venue": F.col("primary_location.source.display_name"), "doi": F.regexp_replace("doi", "^https://doi.org/", ""), "url": F.coalesce("doi", "id"),
            "pdf_url": F.col("best_oa_location.pdf_url"), "citations": F.col("cited_by_count"), "source": F.lit("OpenAlex"), "field": F.lit(field),
        },
    )


def read_atom(spark, path: str) -> DataFrame:  # type: ignore[no-untyped-def]
    return from_atom(spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path))


def read_hub(spark, path: str) -> DataFrame:  # type: ignore[no-untyped-def]
    return from_hub(spark.read.schema(HUB).option("multiLine", True).json(path))


def read_works(spark, path: str) -> DataFrame:  # type: ignore[no-untyped-def]
    page = spark.read.schema(f"results array<struct<{_nested(WORK)}>>").option("multiLine", True).json(path)
    return from_works(page.select(F.inline("results")))


def _nested(ddl: str) -> str:
    return T._parse_datatype_string(ddl).simpleString().removeprefix("struct<").removesuffix(">")
