"""The candidate pools of all saved searches, bound to the test tables, in Spark and in SQL.

A search is a search_id of ``scores``; its candidates are the papers it scored, in the order of idx. The time of a
search is its first answer; what the ranker had been shown are the rated titles updated before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import key, text
from ..operators import library
from ..operators.enrich import cleaned_scores
from ..session import table


def pool(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("search_id").orderBy(F.asc_nulls_last("idx"), "score_id")
    s = cleaned_scores(table(spark, d, "scores")).withColumn("pos", F.row_number().over(order) - 1)
    s = s.select("search_id", "pos", "score_id", "rec_id", F.col("relevance").alias("score"), "recruiter", "datasets", "needs_gpu", "scored_at")
    p = table(spark, d, "papers").select(
        "rec_id", text("title").alias("title"), text("abstract").alias("abstract"), "year", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce("source", F.lit("")).alias("source"), text("venue").alias("venue"), F.coalesce("stars", F.lit(0)).alias("stars"), F.coalesce("code_official", F.lit(False)).alias("code_official"), text("code_framework").alias("code_framework"), text("code_url").alias("code_url"), "similarity", "preference", key().alias("paper_key"),
    )
    j = s.join(p, "rec_id")
    t = F.min(F.unix_micros(F.col("scored_at").cast("timestamp"))).over(Window.partitionBy("search_id"))
    return j.withColumns({"time": t, "shortlisted": F.col("score").isNotNull(), "n_datasets": F.size("datasets")}).drop("scored_at")


def entries(spark: SparkSession, d: str) -> DataFrame:
    return library.fold(table(spark, d, "library"))


def feedback(spark: SparkSession, d: str, candidates: DataFrame) -> DataFrame:
    """(search_id, title) the ranker had been shown: rated papers of the pool whose rating is older than the search."""
    rated = entries(spark, d).where("rating <> 0").select("paper_key", F.unix_micros(F.col("updated").cast("timestamp")).alias("rated_us"))
    return candidates.join(rated, "paper_key").where(F.col("rated_us") < F.col("time")).select("search_id", "title").distinct()


# The same in SQL. NW strips all but letters, digits and the underscore.
NW = r"[^\p{L}\p{N}_]+"
SPACES = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
PAPER_TEXT = rf"regexp_replace(coalesce(title,'')||'. '||coalesce(abstract,''),'^{SPACES}|{SPACES}$','','g')"
KEYED = r"""
keyed as (select *, lower(coalesce(doi,'')) d, regexp_replace(coalesce(arxiv_id,''),'v\d+$','') a from papers),
kp as (select *, case when starts_with(d,'10.48550/arxiv.') then (case when a='' then substr(d,16) else a end) else a end ax from keyed),
kq as (select *, case when not starts_with(d,'10.48550/arxiv.') and d<>'' then 'doi:'||d end k1, case when ax<>'' then 'arxiv:'||lower(ax) end k2,
  'title:'||substr(regexp_replace(lower(coalesce(title,'')),'[^\p{L}\p{N}_]+','','g'),1,80) k3 from kp),
pk as (select *, coalesce(k1,k2,k3) paper_key from kq)"""
CLEAN = r"""list_filter(list_transform(list_filter(coalesce(datasets,[]), lambda x: x is not null), lambda x: regexp_replace(regexp_replace(x,'^[\s\p{Z}]+|[\s\p{Z}]+$','','g'),'[\s\p{Z}]+(dataset|datasets|benchmark)$','','i')),
 lambda x: x<>'' and not regexp_matches(x,'\bdata\b','i') and regexp_matches(x,'[A-Z0-9]'))"""
POOL = (
    "with "
    + KEYED.strip()
    + rf""",
sc as (select *, row_number() over (partition by search_id order by idx nulls last, score_id)-1 pos, {CLEAN} cl from scores),
sd as (select *, (list_filter(cl, lambda x, i: list_position(list_transform(cl, lambda y: lower(y)), lower(x)) = i))[1:12] ds from sc),
pool as (select sd.search_id, pos, score_id, sd.rec_id, case when relevance is not null then least(10.0,greatest(0.0,relevance)) end score,
 case when sd.recruiter is not null then least(10.0,greatest(0.0,sd.recruiter)) end recruiter, ds datasets, len(ds) n_datasets, sd.needs_gpu, coalesce(title,'') title, coalesce(abstract,'') abstract,
 year, coalesce(citations,0) citations, coalesce(source,'') source, coalesce(venue,'') venue, coalesce(stars,0) stars, coalesce(code_official,false) code_official, coalesce(code_framework,'') code_framework, coalesce(code_url,'') code_url, similarity, preference, paper_key, relevance is not null shortlisted,
 min(epoch_us(scored_at)) over (partition by sd.search_id) "time" from sd join pk on sd.rec_id=pk.rec_id)"""
)
LIB = """
lib0 as (select paper_key, coalesce(max_by(rating, (updated, rating)) filter (rating is not null),0) rating, coalesce(max_by(saved,(updated,saved)) filter (saved is not null),false) saved,
 coalesce(max_by(folders,(updated,folders)) filter (folders is not null), []) folders, coalesce(max_by(summary,(updated,summary)) filter (summary is not null),'') summary, min(added) added, max(updated) updated, count(*) changes
 from library where paper_key is not null group by paper_key),
lib as (select paper_key, rating, saved, case when saved then list_transform(list_sort(list_transform(list_distinct(folders), lambda f: {'l': lower(f), 'f': f})), lambda x: x.f) else [] end folders, summary, added, updated, changes from lib0)"""
FEEDBACK = r"""
shown as (select distinct search_id, regexp_replace(lower(title),'[^\p{L}\p{N}_]+','','g') t from pool join lib using(paper_key) where lib.rating<>0 and epoch_us(lib.updated) < pool."time"),
label as (select paper_key, (rating>0)::int label from lib where rating<>0),
cand as (select pool.*, label.label, (shown.t is not null) seen from pool join label using(paper_key) left join shown on shown.search_id=pool.search_id and shown.t=regexp_replace(lower(pool.title),'[^\p{L}\p{N}_]+','','g')),
judged as (select * from (select *, count(*) over (partition by search_id) n_, max(label) over (partition by search_id) l_ from cand where not seen) where n_>=2 and l_=1)"""
