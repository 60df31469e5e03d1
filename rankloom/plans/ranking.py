"""Queries of ranking, joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SHIPPED, SHORTLIST, SHOWN
from ..functions import ids
from ..operators import dedupe, enrich, rank, sets
from ..session import table
from . import pool as P

TIES = ("pos",)


def rank_blend(s: SparkSession, d: str) -> DataFrame:
    t = rank.top(P.pool(s, d), SHIPPED, SHOWN)
    return t.select("search_id", "rec_id", "place", "tier", "relevant", F.round("blend", 6).alias("blend"), F.round("rank_value", 4).alias("rank_value"))


def degraded_rank(s: SparkSession, d: str) -> DataFrame:
    """The model's signals missing: what is left decides."""
    p = P.pool(s, d).withColumns({"score": F.lit(None).cast("double"), "recruiter": F.lit(None).cast("double"), "needs_gpu": F.lit(None).cast("boolean"), "datasets": F.array().cast("array<string>")})
    return rank.top(p, SHIPPED, SHOWN).select("search_id", "rec_id", "place", F.round("rank_value", 4).alias("rank_value"))


def shortlist(s: SparkSession, d: str) -> DataFrame:
    return rank.shortlist(P.pool(s, d), SHIPPED, SHORTLIST // 2).select("search_id", "rec_id", "place")


def llm_order(s: SparkSession, d: str) -> DataFrame:
    return rank.llm_order(P.pool(s, d)).select("search_id", "rec_id", "place")


def similarity_range(s: SparkSession, d: str) -> DataFrame:
    return P.pool(s, d).groupBy("search_id").agg(F.coalesce(F.min("similarity"), F.lit(0.0)).alias("lo"), F.coalesce(F.max("similarity"), F.lit(1.0)).alias("hi"), F.count("*").alias("candidates"), F.count_if(ids.has_code()).alias("with_code"))


def placement(s: SparkSession, d: str) -> DataFrame:
    """The last candidate of each search placed anew among the others, scaled by their range, its old relevance cleared."""
    p = P.pool(s, d)
    n = F.max("pos").over(Window.partitionBy("search_id"))
    both = p.withColumn("last", F.col("pos") == n)
    ranged = rank.similarity_range(both, only=~F.col("last")).withColumn("score", F.when(~F.col("last"), F.col("score")))
    valued = ranged.withColumn("rank_value", rank.rank_value(SHIPPED))
    others = valued.where(~F.col("last"))
    placed = others.withColumn("place", F.row_number().over(Window.partitionBy("search_id").orderBy(F.desc("rank_value"), "pos")))
    new = valued.where("last").select("search_id", F.col("rec_id").alias("id"), "rank_value")
    return rank.insert_place(placed, new).select("search_id", F.col("id").alias("rec_id"), F.round("rank_value", 4).alias("rank_value"), "place")


def interleave(s: SparkSession, d: str) -> DataFrame:
    """Papers of each field in turn from its sources, each source by age of its records."""
    order = F.when(F.col("source") == "Hugging Face", 0).when(F.col("source") == "arXiv", 1).otherwise(2)
    p = table(s, d, "papers").select("rec_id", "field", "source")
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("field", "source").orderBy("rec_id")))
    return rank.interleave(p, order, F.col("rank"), "field").select("rec_id", "field", "pos")


def sample_unshown(s: SparkSession, d: str) -> DataFrame:
    shown = rank.top(P.pool(s, d), SHIPPED, 5)
    rest = sets.unshown(P.pool(s, d), shown, ["search_id", "score_id"])
    return rank.sample_unshown(rest, 5, "score_id").select("search_id", "score_id", "draw")


def best_link(s: SparkSession, d: str) -> DataFrame:
    return enrich.best_links(enrich.code_index(table(s, d, "code_links")))


def attach_code(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers")
    arxiv = F.regexp_extract(F.array_join(ids.identifiers(), "|"), r"(?:^|\|)arxiv:([^|]*)", 1)
    return enrich.attach_code(p, table(s, d, "code_links"), F.when(arxiv != "", arxiv)).select("rec_id", ids.text("code_url").alias("code_url"), F.coalesce("code_official", F.lit(False)).alias("code_official"), ids.text("code_framework").alias("code_framework"))


def catalogue(s: SparkSession, d: str) -> DataFrame:
    """Catalogue keys from names and, as variants, their keys; the use of a name is how often it was typed."""
    used = table(s, d, "scores").select(F.explode("datasets").alias("name")).groupBy("name").agg(F.count("*").alias("num_papers"))
    raw = table(s, d, "datasets").groupBy("name").agg(F.collect_set("key").alias("variants"), F.min("homepage").alias("homepage")).join(used, "name", "left")
    return enrich.catalogue(raw)


def dataset_links(s: SparkSession, d: str) -> DataFrame:
    typed = table(s, d, "scores").select(F.explode("datasets").alias("name"))
    return enrich.dataset_links(typed, table(s, d, "datasets"))


def apply_scores(s: SparkSession, d: str) -> DataFrame:
    """The answers by index put on each search's first candidates."""
    p = P.pool(s, d).select("search_id", F.col("pos").cast("int").alias("pos"), "score_id")
    a = enrich.apply_scores(p, table(s, d, "scores"))
    return a.select("search_id", "pos", "new_relevance", "new_recruiter", F.array_join("new_datasets", "|").alias("new_datasets"))


def cache_misses(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select(F.lit("mini-a-384").alias("model"), ids.key().alias("paper_key"), ids.text_hash(ids.paper_text()).alias("text_hash")).distinct()
    return enrich.cache_misses(p, table(s, d, "vecs"))[1].select("paper_key", "text_hash")


def cache_rate(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select(F.lit("mini-a-384").alias("model"), ids.key().alias("paper_key")).distinct()
    c = table(s, d, "vecs").where(F.col("vec").isNotNull()).select("model", "paper_key").distinct().withColumn("hit", F.lit(1))
    return p.join(c, ["model", "paper_key"], "left").agg(F.count("*").alias("asked"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count("*"), 6).alias("rate"))


def union_precedence(s: SparkSession, d: str) -> DataFrame:
    """Papers by key: the newest record wins, those of the library's own source over all; order of first appearance."""
    p = table(s, d, "papers").select(ids.key().alias("paper_key"), F.col("rec_id").alias("pos"), "rec_id", "source", F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("us"))
    lib = p.where("source = 'Hugging Face'")
    return sets.precedence([p, lib], "paper_key", [F.col("us"), F.col("rec_id")]).select("paper_key", "first", "rec_id", "source")


def known_keys(s: SparkSession, d: str) -> DataFrame:
    return sets.known_keys(P.entries(s, d))


def serialize(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select("rec_id", ids.key().alias("paper_key"), ids.has_code().alias("has_code"))
    e = P.entries(s, d).select("paper_key", "rating", "saved", "folders")
    return p.join(e, "paper_key", "left").select("rec_id", "paper_key", "has_code", F.coalesce("rating", F.lit(0)).alias("rating"), F.coalesce("saved", F.lit(False)).alias("saved"), F.array_join(F.coalesce("folders", F.array().cast("array<string>")), "|").alias("folders"))


def latest_record(s: SparkSession, d: str) -> DataFrame:
    """Of each key the newest appearance in a search, else the newest record of the paper."""
    c = P.pool(s, d).select("paper_key", F.struct(F.lit(1).alias("p"), F.col("time").alias("us"), "score_id").alias("o"), "search_id", "score")
    p = table(s, d, "papers").select(ids.key().alias("paper_key"), F.struct(F.lit(0).alias("p"), F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("us"), F.col("rec_id").alias("score_id")).alias("o"), F.lit(None).cast("string").alias("search_id"), F.lit(None).cast("double").alias("score"))
    return c.unionByName(p).groupBy("paper_key").agg(F.max_by(F.struct("search_id", "score"), "o").alias("v")).select("paper_key", "v.*")


def snapshot_overlay(s: SparkSession, d: str) -> DataFrame:
    """All candidates with the scores of the shortlisted; the others without."""
    p = P.pool(s, d)
    short = rank.shortlist(p, SHIPPED, 8)
    return sets.overlay(p.withColumn("score", F.lit(None).cast("double")), short, ["search_id", "score_id"], ["score"]).select("search_id", "pos", "score", "shortlisted")


def dedupe_closure(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").withColumn("pos", F.col("rec_id"))
    return dedupe.dedupe_closure(p).select("rec_id", "copies", "title", "doi", "citations", "stars", "code_url")


def dedupe_exact(s: SparkSession, d: str) -> DataFrame:
    return dedupe.dedupe_exact(table(s, d, "papers").withColumn("pos", F.col("rec_id"))).select("id", "title", "doi", "arxiv_id", "citations", "copies", "code_url", "venue")


QUERIES = {
    "rank_blend": rank_blend, "degraded_rank": degraded_rank, "shortlist": shortlist, "llm_order": llm_order, "similarity_range": similarity_range, "placement": placement, "interleave": interleave,
    "sample_unshown": sample_unshown, "best_link": best_link, "attach_code": attach_code, "catalogue": catalogue, "dataset_links": dataset_links, "apply_scores": apply_scores, "cache_misses": cache_misses,
    "cache_rate": cache_rate, "union_precedence": union_precedence, "known_keys": known_keys, "serialize": serialize, "latest_record": latest_record, "snapshot_overlay": snapshot_overlay,
    "dedupe_closure": dedupe_closure, "dedupe_exact": dedupe_exact,
}

_RANGE = "rg as (select *, coalesce(min(similarity) over (partition by search_id),0) lo, coalesce(max(similarity) over (partition by search_id),1) hi from pool), sg as (select *, 10*(similarity-lo)/greatest(1e-9,hi-lo) sim10, 10*preference pref10 from rg)"
_VALUE = """rv as (select *, coalesce(coalesce(score,sim10)>=5,false) relevant, (case when code_url<>'' then 4 else 0 end)+(case when n_datasets>=1 then 2 else 0 end)+(case when needs_gpu=false then 1 else 0 end) tier,
 case when score is not null or recruiter is not null or sim10 is not null or pref10 is not null then (coalesce(0.3::double*score,0)+coalesce(0.6::double*recruiter,0)+coalesce(0.3::double*sim10,0)+coalesce(0.15::double*pref10,0))/
 ((case when score is not null then 0.3::double else 0 end)+(case when recruiter is not null then 0.6::double else 0 end)+(case when sim10 is not null then 0.3::double else 0 end)+(case when pref10 is not null then 0.15::double else 0 end)) else 0.0 end blend from sg),
 rr as (select *, case when relevant then 1000+100*tier else 0 end + blend rank_value from rv)"""
_SHORT = "sh as (select *, row_number() over (partition by search_id order by (code_url<>'' and relevant) desc, similarity desc nulls last, pos) sp from rv)"
_BLANK = P.POOL.replace("case when relevance is not null then least(10.0,greatest(0.0,relevance)) end score", "null::double score").replace(
    "case when sd.recruiter is not null then least(10.0,greatest(0.0,sd.recruiter)) end recruiter", "null::double recruiter"
).replace("ds datasets, len(ds) n_datasets, sd.needs_gpu,", "[] datasets, 0 n_datasets, null::boolean needs_gpu,")
_CODE = r"""ix as (select regexp_replace(arxiv_id,'v\d+$','') arxiv_id, repo_url, coalesce(official,0) official, coalesce(framework,'none') framework from code_links where coalesce(arxiv_id,'')<>'' and repo_url is not null),
 bl as (select arxiv_id, repo_url, official>0 official, framework from (select *, row_number() over (partition by arxiv_id order by official desc, (framework='none'), repo_url, framework) rn from ix) where rn=1)"""

ORACLE = {
    "rank_blend": f"{P.POOL}, {_RANGE}, {_VALUE} select search_id, rec_id, place, tier, relevant, round(blend,6) blend, round(rank_value,4) rank_value from (select *, row_number() over (partition by search_id order by rank_value desc, pos) place from rr) where place<=10",
    "degraded_rank": f"{_BLANK}, {_RANGE}, {_VALUE} select search_id, rec_id, place, round(rank_value,4) rank_value from (select *, row_number() over (partition by search_id order by rank_value desc, pos) place from rr) where place<=10",
    "shortlist": f"{P.POOL}, {_RANGE}, {_VALUE}, {_SHORT} select search_id, rec_id, sp place from sh where sp<=8",
    "llm_order": f"{P.POOL} select search_id, rec_id, row_number() over (partition by search_id order by coalesce(score,-1) desc, pos) place from pool",
    "similarity_range": f"{P.POOL} select search_id, coalesce(min(similarity),0) lo, coalesce(max(similarity),1) hi, count(*) candidates, count(*) filter (code_url<>'') with_code from pool group by 1",
    "placement": f"""{P.POOL}, lst as (select *, pos=max(pos) over (partition by search_id) last from pool), rg as (select * replace (case when not last then score end as score), coalesce(min(similarity) filter (not last) over (partition by search_id),0) lo,
      coalesce(max(similarity) filter (not last) over (partition by search_id),1) hi from lst), sg as (select *, 10*(similarity-lo)/greatest(1e-9,hi-lo) sim10, 10*preference pref10 from rg), {_VALUE}
      select n.search_id, n.rec_id, round(n.rank_value,4) rank_value, (select count(*) from rr o where o.search_id=n.search_id and not o.last and o.rank_value>=n.rank_value)+1 place from rr n where n.last""",
    "interleave": """select rec_id, field, row_number() over (partition by field order by r, so)-1 pos from (select rec_id, field, row_number() over (partition by field, source order by rec_id) r,
      case source when 'Hugging Face' then 0 when 'arXiv' then 1 else 2 end so from papers)""",
    "sample_unshown": f"""{P.POOL}, {_RANGE}, {_VALUE}, pl as (select *, row_number() over (partition by search_id order by rank_value desc, pos) place from rr),
      dr as (select search_id, score_id, row_number() over (partition by search_id order by sha256('0:'||score_id), score_id) draw from pl where place>5) select * from dr where draw<=5""",
    "best_link": f"with {_CODE} select * from bl",
    "attach_code": f"""with {P.KEYED.strip()}, {_CODE} select rec_id, case when tk then repo_url else coalesce(code_url,'') end code_url, case when tk then official else coalesce(code_official,false) end code_official,
      case when framework is not null and framework<>'none' then framework else coalesce(code_framework,'') end code_framework
      from (select pk.*, bl.repo_url, bl.official, bl.framework, bl.repo_url is not null and (coalesce(code_url,'')='' or bl.official) tk from pk left join bl on bl.arxiv_id=substr(k2,7))""",
    "catalogue": """with us as (select name, count(*) num_papers from (select unnest(datasets) name from scores) group by 1), raw as (select name, list(distinct key) variants, min(homepage) homepage from datasets where name is not null group by 1),
      j as (select raw.*, coalesce(num_papers,0) used from raw left join us using(name)),
      b as (select regexp_replace(lower(name),'[^a-z0-9]','','g') "key", name, coalesce(homepage,'') homepage, 0 prio, used from j union all select regexp_replace(lower(v),'[^a-z0-9]','','g'), name, coalesce(homepage,''), 1, used from (select *, unnest(variants) v from j))
      select "key", name, homepage from (select *, row_number() over (partition by "key" order by prio, used desc, name, homepage) rn from b where "key"<>'') where rn=1""",
    "dataset_links": r"""with h as (select key, min(homepage) homepage from datasets where starts_with(homepage,'http') group by 1), n as (select distinct name from (select unnest(datasets) name from scores) where name is not null),
      k as (select name, regexp_replace(lower(name),'[^a-z0-9]','','g') k from n), k2 as (select *, regexp_replace(k,'(\d+k|\d+m|full|small|large|v\d+)$','') k2 from k)
      select name, coalesce(h1.homepage,h2.homepage,'https://huggingface.co/datasets?search='||replace(replace(replace(url_encode(name),'%2F','/'),'%7E','~'),'*','%2A')) link from k2 left join h h1 on h1.key=k2.k left join h h2 on h2.key=k2.k2""",
    "apply_scores": f"""{P.POOL}, la as (select search_id, idx, max_by(score_id, score_id) sid from scores group by 1,2) select p.search_id, p.pos::int pos, case when s.relevance is not null then least(10.0,greatest(0.0,s.relevance)) end new_relevance,
      case when s.recruiter is not null then least(10.0,greatest(0.0,s.recruiter)) end new_recruiter, array_to_string(s.ds,'|') new_datasets from pool p left join la on la.search_id=p.search_id and la.idx=p.pos left join sd s on s.score_id=la.sid""",
    "cache_misses": f"""with {P.KEYED.strip()}, w as (select distinct paper_key, substr(sha1({P.PAPER_TEXT}),1,16) h from pk),
      c as (select paper_key, max_by(text_hash,(computed_at,vec_id)) ch from vecs where vec is not null and model='mini-a-384' group by 1) select w.paper_key, h text_hash from w left join c using(paper_key) where ch is null or ch<>h""",
    "cache_rate": f"with {P.KEYED.strip()} select count(*) asked, count(c.paper_key) hits, round(count(c.paper_key)/count(*),6) rate from (select distinct paper_key from pk) w left join (select distinct paper_key from vecs where vec is not null and model='mini-a-384') c using(paper_key)",
    "union_precedence": f"""with {P.KEYED.strip()}, u as (select paper_key, rec_id, source, epoch_us(fetched_at) us, case when source='Hugging Face' then 1 else 0 end part from pk)
      select paper_key, first, rec_id, source from (select *, min(rec_id) over (partition by paper_key) "first", row_number() over (partition by paper_key order by part desc, us desc nulls last, rec_id desc) rn from u) where rn=1""",
    "known_keys": f"with {P.LIB.strip()} select paper_key from lib where saved or rating<>0",
    "serialize": f"with {P.KEYED.strip()}, {P.LIB.strip()} select rec_id, paper_key, coalesce(code_url,'')<>'' has_code, coalesce(rating,0) rating, coalesce(saved,false) saved, array_to_string(coalesce(folders,[]),'|') folders from pk left join lib using(paper_key)",
    "latest_record": f"""{P.POOL}, u as (select paper_key, 1 p, "time" us, score_id i, search_id, score from pool union all select paper_key, 0, epoch_us(fetched_at), rec_id, null, null from pk)
      select paper_key, search_id, score from (select *, row_number() over (partition by paper_key order by p desc, us desc nulls last, i desc) rn from u) where rn=1""",
    "snapshot_overlay": f"{P.POOL}, {_RANGE}, {_VALUE}, {_SHORT} select search_id, pos, case when sp<=8 then score end score, sp<=8 shortlisted from sh",
    "dedupe_closure": f"""with recursive {P.KEYED.strip()}, ii as (select rec_id n, unnest(list_filter([k1,k2,k3], lambda x: x is not null)) i from pk), hub as (select i, min(n) h from ii group by 1),
      ed as (select distinct h a, n b from ii join hub using(i) where h<>n), bo as (select a,b from ed union select b,a from ed),
      cc(n,c) as (select rec_id, rec_id from papers union select bo.b, cc.c from cc join bo on bo.a=cc.n), co as (select n rec_id, min(c) c from cc group by 1), j as (select pk.*, c from pk join co using(rec_id))
      select min(rec_id) rec_id, count(*) copies, min_by(coalesce(title,''),rec_id) title, coalesce(min_by(doi,rec_id) filter (coalesce(doi,'')<>''),'') doi, max(coalesce(citations,0)) citations, max(coalesce(stars,0)) stars,
      coalesce(min_by(code_url,rec_id) filter (coalesce(code_url,'')<>''),'') code_url from j group by c""",
}
