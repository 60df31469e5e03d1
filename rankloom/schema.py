"""Record types, and validation that yields rows and rejects instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_FIELDS = ("abstract", "venue", "doi", "arxiv_id", "url", "pdf_url", "source", "field", "code_url", "code_framework", "tldr", "reason", "recruiter_reason", "compute_note")
COUNT_FIELDS = ("citations", "stars", "upvotes")
SCORE_FIELDS = ("similarity", "preference", "score", "recruiter")
LIST_FIELDS = ("authors", "datasets")

PAPER = T.StructType(
    [T.StructField("title", T.StringType(), False)]
    + [T.StructField(c, T.StringType()) for c in TEXT_FIELDS]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in LIST_FIELDS]
    + [T.StructField("year", T.IntegerType())]
    + [T.StructField(c, T.IntegerType()) for c in COUNT_FIELDS]
    + [T.StructField(c, T.DoubleType()) for c in SCORE_FIELDS]
    + [T.StructField("code_official", T.BooleanType()), T.StructField("needs_gpu", T.BooleanType())]
)
CODE_LINK = "arxiv_id string, repo_url string, official int, framework string"
DATASET = "key string, name string, homepage string"
SCORE = "`index` int, relevance double, relevance_reason string, recruiter double, recruiter_reason string, datasets array<string>, needs_gpu boolean, compute_note string"
CANDIDATE = "key string, shortlisted boolean, title string, abstract string, year int, citations int, source string, code_url string, preference double, similarity double, score double, recruiter double, datasets array<string>, needs_gpu boolean"
SNAPSHOT = f"id string, time double, query string, interests string, fields array<string>, provider string, model string, weights map<string,double>, feedback_titles array<string>, candidates array<struct<{', '.join(':'.join(x.split()) for x in CANDIDATE.split(', '))}>>"
ERROR = "source string, error_type string, message string, field string"


def fill_defaults(df: DataFrame) -> DataFrame:
    """Papers with the defaults of the record type in place of NULL. Tri-state and score fields keep NULL."""
    have = set(df.columns)
    return df.withColumns(
        {c: F.coalesce(c, F.lit("")) for c in TEXT_FIELDS if c in have}
        | {c: F.coalesce(c, F.lit(0)) for c in COUNT_FIELDS if c in have}
        | {c: F.coalesce(c, F.array().cast("array<string>")) for c in LIST_FIELDS if c in have}
        | ({"code_official": F.coalesce("code_official", F.lit(False))} if "code_official" in have else {})
    )


def whole_number(value: Column) -> Column:
    """Text of a number without a fraction as INT ('3.0' is 3), else NULL."""
    x = value.try_cast("double")
    return F.when(x == F.floor(x), x.try_cast("int"))


def validate(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with reasons) of raw text columns title, year, citations.

    An absent title and numbers that are no whole numbers are refused; every failing field is named.
    """
    problems = F.array_compact(
        F.array(
            F.when(F.col("title").isNull(), F.lit("title: missing")),
            *(F.when(F.col(c).isNotNull() & whole_number(F.col(c)).isNull(), F.lit(f"{c}: not a whole number")) for c in ("year", "citations")),
        )
    )
    judged = raw.withColumn("problems", problems)
    valid = judged.where(F.size("problems") == 0).drop("problems").withColumns({c: whole_number(F.col(c)) for c in ("year", "citations")})
    return valid, judged.where(F.size("problems") > 0).withColumn("reason", F.array_join("problems", "; ")).drop("problems")
