"""Queries of evaluation, library, limits, the preference model, model calls and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SHIPPED
from ..functions import text
from ..functions.ids import key
from ..operators import ai, evalkit, filters, graph, library, limits, prefmodel, rank
from ..session import materialize, shared_dir, table
from . import pool as P


def _parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = P.pool(s, d)
    return p, evalkit.labels(P.entries(s, d)), P.feedback(s, d, p)


def _judged(s: SparkSession, d: str) -> DataFrame:
    return evalkit.judged(*_parts(s, d))


def judged(s: SparkSession, d: str) -> DataFrame:
    return _judged(s, d).select("search_id", "pos", "paper_key", "label")


def label_stats(s: SparkSession, d: str) -> DataFrame:
    return evalkit.label_stats(*_parts(s, d))


#: A given model over the stored preference and the seven signals; it stands for the enriched kind where SQL checks the rest.
GIVEN = prefmodel.Model([0.0] * 8, [1.0] * 8, [2.0, 0.8, 0.6, 0.1, 0.5, 0.2, 0.05, -0.3], -1.5, 1.0)


def _preferred(pool: DataFrame) -> DataFrame:
    """pool with the stored preference as that of embeddings alone, and the given model's as the enriched one."""
    x = F.concat(F.array("preference"), prefmodel.structured(F.col("n_datasets")))
    return pool.withColumns({"preference_embedding": F.col("preference"), "preference_enriched": F.when(F.col("preference").isNotNull(), GIVEN.probability(x))})


def metrics_by_strategy(s: SparkSession, d: str) -> DataFrame:
    m = evalkit.compared(_preferred(_judged(s, d)))
    return m.select("search_id", "strategy", *(F.round(c, 6).alias(c) for c in ("p_5", "p_10", "ndcg_10", "mrr")))


def eval_summary(s: SparkSession, d: str) -> DataFrame:
    t = evalkit.summary(evalkit.compared(_preferred(_judged(s, d))))
    return t.select("strategy", "searches", *(F.round(c, 6).alias(c) for c in t.columns if c not in ("strategy", "searches")))


def random_expectation(s: SparkSession, d: str) -> DataFrame:
    r = evalkit.random_expectation(_judged(s, d))
    return r.select("search_id", *(F.round(c, 6).alias(c) for c in ("p_5", "p_10", "ndcg_10", "mrr")))


def first_clean_signals(s: SparkSession, d: str) -> DataFrame:
    p, l, f = _parts(s, d)
    copy = table(s, d, "papers").groupBy(key().alias("paper_key")).agg(F.min_by(F.coalesce("code_url", F.lit("")), "rec_id").alias("code_url"), F.min_by(F.coalesce("citations", F.lit(0)), "rec_id").alias("citations"))
    return evalkit.first_clean(p, l, f, copy)


def out_of_fold(s: SparkSession, d: str) -> DataFrame:
    p, l, f = _parts(s, d)
    return evalkit.out_of_fold(l, evalkit.judged(p, l, f))


def trainable(s: SparkSession, d: str) -> DataFrame:
    return filters.can_train(evalkit.labels(P.entries(s, d)))


def library_fold(s: SparkSession, d: str) -> DataFrame:
    e = P.entries(s, d)
    return e.select("paper_key", "rating", "saved", F.array_join("folders", "|").alias("folders"), "summary", F.unix_micros(F.col("added").cast("timestamp")).alias("added_us"), F.unix_micros(F.col("updated").cast("timestamp")).alias("updated_us"), "changes")


def folder_counts(s: SparkSession, d: str) -> DataFrame:
    return library.folder_counts(P.entries(s, d))


def library_view(s: SparkSession, d: str) -> DataFrame:
    return filters.library_view(P.entries(s, d), "liked").select("paper_key", "rating")


def set_folder(s: SparkSession, d: str) -> DataFrame:
    e = P.entries(s, d)
    return library.set_folder(e, "  To   read ", True, keys=e.where("rating > 0")).select("paper_key", "saved", F.array_join("folders", "|").alias("folders"))


def rated_titles(s: SparkSession, d: str) -> DataFrame:
    titles = table(s, d, "papers").groupBy(key().alias("paper_key")).agg(F.min_by("title", "rec_id").alias("title"))
    return library.rated_titles(P.entries(s, d).join(titles, "paper_key")).select("rating", F.array_join("titles", "|").alias("titles"))


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value")


def rate_limited(s: SparkSession, d: str) -> DataFrame:
    return limits.rate_limited(_events(s, d), 2, 3600.0).select("key", "id", "allowed", "retry_after")


def quota_two_level(s: SparkSession, d: str) -> DataFrame:
    return limits.two_level(_events(s, d), 2, 3600.0, 150).select("key", "id", "verdict", "minutes")


def token_budget(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).select(F.col("event_type").alias("key"), "id", "t", (F.col("value") * 20).cast("bigint").alias("tokens"))
    return limits.token_budget(e, 8000).select("key", "id", "tokens", F.round("wait", 3).alias("wait"))


def sliding_counts(s: SparkSession, d: str) -> DataFrame:
    return limits.sliding_counts(_events(s, d), 3600)


def cache_evict(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).select("id", F.col("t").alias("last_used"), (F.col("value") * 1000).cast("bigint").alias("bytes"))
    return limits.evict(e, 16 * 1024 * 1024 // 8, "id").select("id")


def structured_features(s: SparkSession, d: str) -> DataFrame:
    f = prefmodel.structured(F.col("n_datasets"))
    return P.pool(s, d).select("score_id", *(F.round(F.get(f, F.lit(i)), 6).alias(f"f{i}") for i in range(7)))


#: Length of the embeddings, as the usual small sentence encoders give.
DIM = 384


def _embeddings(s: SparkSession, d: str, keys: DataFrame) -> DataFrame:
    """(paper_key, vec) of the papers of keys, by the stand-in for a sentence encoder."""
    told = table(s, d, "papers").select(key().alias("paper_key"), "rec_id", F.concat_ws(". ", "title", "abstract").alias("text"))
    texts = told.join(keys.select("paper_key").distinct(), "paper_key", "left_semi").groupBy("paper_key").agg(F.min_by("text", "rec_id").alias("text"))
    return ai.embed(texts, "text", ai.HashingEmbedder(DIM)).select("paper_key", F.col("vec").cast("array<double>").alias("vec"))


def _featured(rows: DataFrame, vecs: DataFrame) -> DataFrame:
    """rows with the three kinds of features."""
    both = rows.join(vecs, "paper_key", "left").withColumn("signals", prefmodel.structured(F.col("n_datasets")))
    return both.withColumns({kind: prefmodel.features(kind, F.col("vec"), F.col("signals")) for kind in prefmodel.KINDS}).drop("vec", "signals")


def _training(s: SparkSession, d: str) -> DataFrame:
    t = materialize(first_clean_signals(s, d), "labelled")
    return materialize(_featured(t, _embeddings(s, d, t)), "training")


def pref_predict(s: SparkSession, d: str) -> DataFrame:
    """P(like) of every scored candidate from the model of all labels, embeddings and signals."""
    model = prefmodel.train(_training(s, d), "enriched")
    p = materialize(P.pool(s, d).select("score_id", "paper_key", "score", "recruiter", "code_url", "n_datasets", "citations", "needs_gpu"), "pool")
    prob = F.lit(None).cast("double") if model is None else model.probability(F.col("enriched"))
    return _featured(p, _embeddings(s, d, p)).select("score_id", F.round(prob, 6).alias("preference"))


def _out_of_fold(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The judged candidates, and (search_id, paper_key, preference_embedding, preference_enriched) of them."""
    j = materialize(_judged(s, d), "judged")
    one = j.groupBy("search_id", "paper_key").agg(*(F.min_by(c, "pos").alias(c) for c in ("score", "recruiter", "code_url", "n_datasets", "citations", "needs_gpu")))
    pools, training = materialize(_featured(one, _embeddings(s, d, j)), "pools"), _training(s, d)
    kinds = [prefmodel.out_of_fold_preferences(training, pools, kind).withColumnRenamed("preference", f"preference_{kind}") for kind in ("embedding", "enriched")]
    return j, materialize(kinds[0].join(kinds[1], ["search_id", "paper_key"]), "preferences")


def oof_preferences(s: SparkSession, d: str) -> DataFrame:
    """P(like) of each judged candidate, of both kinds, by models that saw no label of its search."""
    return _out_of_fold(s, d)[1].select("search_id", "paper_key", *(F.round(c, 6).alias(c) for c in ("preference_embedding", "preference_enriched")))


def oof_summary(s: SparkSession, d: str) -> DataFrame:
    """The summary of all strategies with out-of-fold preferences; the pipeline uses the enriched one."""
    j, told = _out_of_fold(s, d)
    full = j.drop("preference").join(told, ["search_id", "paper_key"], "left").withColumn("preference", F.col("preference_enriched"))
    t = evalkit.summary(evalkit.compared(full))
    return t.select("strategy", "searches", *(F.round(c, 6).alias(c) for c in t.columns if c not in ("strategy", "searches")))


def map_flags(s: SparkSession, d: str) -> DataFrame:
    """Every paper of the map with its rating and whether one of the searches shows it."""
    nodes = table(s, d, "papers").select(key().alias("key")).distinct()
    return graph.flags(nodes, P.entries(s, d).select(F.col("paper_key").alias("key"), "rating"), P.pool(s, d).select(F.col("paper_key").alias("key")))


def cv_report(s: SparkSession, d: str) -> DataFrame:
    """AUC and accuracy of each kind of features over the same folds."""
    t = _training(s, d)
    rows = [(kind, r["auc"], r["auc_std"], r["accuracy"]) for kind in prefmodel.KINDS for r in [prefmodel.cross_validate(t, kind)]]
    return s.createDataFrame(rows, "features string, auc double, auc_std double, accuracy double")


#: Tokens of a ranking request: a usual limit, and one so small that most abstracts are shortened.
REQUEST_TOKENS, TIGHT_TOKENS = 32_000, 2_600


def _requests(s: SparkSession, d: str, limit: int) -> DataFrame:
    titles = table(s, d, "papers").groupBy(key().alias("paper_key")).agg(F.min_by("title", "rec_id").alias("title"))
    rated = library.rated_titles(P.entries(s, d).join(titles, "paper_key"))
    body = ai.requests(P.pool(s, d).withColumn("query", F.col("search_id")), rated, "graphs", limit)
    return body.select("search_id", F.sha1(F.col("prompt").cast("binary")).alias("hash"), text.tokens_of(F.col("prompt")).alias("tokens"))


def prompt(s: SparkSession, d: str) -> DataFrame:
    """The ranking request of each search, with the newest rated titles."""
    return _requests(s, d, REQUEST_TOKENS)


def prompt_tight(s: SparkSession, d: str) -> DataFrame:
    """The same within few tokens, so that abstracts are cut to excerpts."""
    return _requests(s, d, TIGHT_TOKENS)


def rank_stub(s: SparkSession, d: str) -> DataFrame:
    p = P.pool(s, d).select("search_id", "rec_id", F.lit("graph attention retrieval").alias("query"), F.concat_ws(". ", "title", "abstract").alias("text"))
    return ai.rank(p, ai.OverlapRanker())[0]


def answers_parsed(s: SparkSession, d: str) -> DataFrame:
    """Each search's answers written as a model would, and read back."""
    a = table(s, d, "scores").groupBy("search_id").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("index"), "relevance", F.lit("").alias("relevance_reason"), "recruiter"))).alias("scores"))
    answer = F.concat(F.lit("<think>{\n</think>"), F.to_json(F.struct("scores")))
    return a.select("search_id", F.explode(ai.parse_answer(answer)).alias("x")).select("search_id", "x.index", "x.relevance", "x.recruiter").groupBy("search_id").agg(F.count("*").alias("answers"), F.round(F.sum("relevance"), 6).alias("relevance"))


def summaries_stub(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").select("rec_id", ai.summary_stub(F.coalesce("abstract", F.lit(""))).alias("summary"))


def embed_stub(s: SparkSession, d: str) -> DataFrame:
    e = ai.embed(table(s, d, "papers").select("rec_id", F.concat_ws(". ", "title", "abstract").alias("text")), "text", ai.HashingEmbedder(32))
    lean = F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return e.select("rec_id", F.size("vec").alias("dim"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("length"), F.round(lean, 3).alias("lean"))


def windowed_stream(s: SparkSession, d: str) -> DataFrame:
    """Event counts of five minutes, by a stream over the table."""
    from ..streaming.limits import windowed_counts

    raw = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    counts = windowed_counts(raw)
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = s.read.schema("start_us bigint, event_type string, n bigint, total double, batch int").parquet(f"{base}/out")
    newest = out.groupBy("start_us", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("v"))
    return newest.select("start_us", "event_type", "v.n", F.round("v.total", 2).alias("total"))


def blend_order(s: SparkSession, d: str) -> DataFrame:
    """Of each field the ten papers of the highest value, ranked by their own stored signals."""
    p = table(s, d, "papers").where(F.coalesce("title", F.lit("")) != "").withColumn("search_id", F.col("field"))
    return rank.top(p, SHIPPED, 10, "search_id", "rec_id").select("field", "rec_id", "place", F.round("rank_value", 4).alias("rank_value"))


QUERIES = {
    "judged": judged, "label_stats": label_stats, "metrics_by_strategy": metrics_by_strategy, "eval_summary": eval_summary, "random_expectation": random_expectation, "first_clean_signals": first_clean_signals,
    "out_of_fold": out_of_fold, "trainable": trainable, "library_fold": library_fold, "folder_counts": folder_counts, "library_view": library_view, "set_folder": set_folder, "rated_titles": rated_titles,
    "rate_limited": rate_limited, "quota_two_level": quota_two_level, "token_budget": token_budget, "sliding_counts": sliding_counts, "cache_evict": cache_evict, "structured_features": structured_features,
    "pref_predict": pref_predict, "oof_preferences": oof_preferences, "oof_summary": oof_summary, "map_flags": map_flags, "cv_report": cv_report, "prompt": prompt, "prompt_tight": prompt_tight, "rank_stub": rank_stub, "answers_parsed": answers_parsed, "summaries_stub": summaries_stub, "embed_stub": embed_stub,
    "windowed_stream": windowed_stream, "blend_order": blend_order,
}

_FB = f"{P.POOL}, {P.LIB.strip()}, {P.FEEDBACK.strip()}"
_B = "(case when {w} then 1.0 else 0.0 end)"


def _pipe(name: str, w: dict[str, float], tiers: str, floor: float, rest: str, where: str = "true") -> str:
    parts = {"score": w["relevance"], "recruiter": w["recruiter"], "sim10": w["similarity"], "pref10": w["preference"]}
    used = {c: x for c, x in parts.items() if x > 0}
    num = "+".join(f"coalesce({x}::double*{c},0)" for c, x in used.items())
    den = "+".join(f"(case when {c} is not null then {x}::double else 0 end)" for c, x in used.items())
    return f"select search_id, pos, label, '{name}' strategy, case when score is not null then 1.0 else 0.0 end k1, case when score is not null then (case when coalesce(score>={floor},false) then 1000+100*({tiers}) else 0 end)+coalesce(({num})/nullif({den},0),0) else {rest} end k2 from js where {where}"


_T = "(case when code_url<>'' then 4 else 0 end)+(case when n_datasets>=1 then 2 else 0 end)+(case when needs_gpu=false then 1 else 0 end)"
_GIVEN = "1/(1+exp(-(-1.5+2.0*preference+0.8*coalesce(score/10,0)+0.6*coalesce(recruiter/10,0)+(case when score is not null then 0.1 else 0 end)+(case when code_url<>'' then 0.5 else 0 end)+0.2*ln(1+n_datasets)+0.05*ln(1+greatest(0,citations::bigint))-(case when needs_gpu then 0.3 else 0 end))))"
_RANDOM = """rg0 as (select search_id, count(*) n, sum(label)::bigint l from judged group by 1), re as (select search_id, n, l, unnest(range(1,n-l+2)) r from rg0),
 rf as (select search_id, n, l, r, exp(list_sum(list_transform(range(1,r), lambda i: ln((n-l-(i-1))::double/(n-(i-1)))))) miss from re),
 rx as (select search_id, max(l)/max(n)*least(5,max(n))/5 p_5, max(l)/max(n)*least(10,max(n))/10 p_10,
  max(l)/max(n)*list_sum(list_transform(range(1,least(10,max(n))+1), lambda i: 1/log2(i+1)))/list_sum(list_transform(range(1,least(10,max(l))+1), lambda i: 1/log2(i+1))) ndcg_10,
  sum((case when r=1 then 1 else miss end)*l/(n-(r-1))/r) mrr from rf group by 1)"""
_STRAT = f"""js as (select *, 10*(similarity-lo)/greatest(1e-9,hi-lo) sim10, 10*preference pref10 from (select *, coalesce(min(similarity) filter (score is not null) over (partition by search_id),0) lo,
 coalesce(max(similarity) filter (score is not null) over (partition by search_id),1) hi, count(*) filter (preference is null) over (partition by search_id)=0 allp from judged)),
 st as (select search_id, pos, label, 'source order' strategy, 0.0 k1, case when code_url<>'' then 1.0 else 0.0 end k2 from js union all select search_id, pos, label, 'recency', 0.0, coalesce(year::double,-1e18) from js
 union all select search_id, pos, label, 'citations', 0.0, citations::double from js union all select search_id, pos, label, 'similarity', 0.0, coalesce(similarity,-1e18) from js union all select search_id, pos, label, 'relevance', 0.0, coalesce(score,-1e18) from js
 union all select search_id, pos, label, 'preference alone (embeddings)', 0.0, preference from js where allp union all select search_id, pos, label, 'preference alone (embeddings and signals)', 0.0, {_GIVEN} from js where allp
 union all {_pipe('original pipeline', dict(relevance=.5, recruiter=.5, similarity=0, preference=0), _T, 0.0, '0.0')} union all {_pipe('current pipeline', dict(relevance=.3, recruiter=.6, similarity=.3, preference=0), _T, 5.0, 'coalesce(similarity,-1e18)')}
 union all {_pipe('pipeline with preference', dict(relevance=.3, recruiter=.6, similarity=.3, preference=.15), _T, 5.0, 'coalesce(similarity,-1e18)', 'allp')}),
 od as (select *, row_number() over (partition by search_id, strategy order by k1 desc, k2 desc, pos) rn from st), oe as (select *, row_number() over (partition by search_id, strategy order by label desc, rn) b from od),
 mt as (select search_id, strategy, sum(case when rn<=5 then label else 0 end)/5 p_5, sum(case when rn<=10 then label else 0 end)/10 p_10,
 coalesce(sum(case when rn<=10 then label/log2(rn+1) else 0 end)/nullif(sum(case when b<=10 then label/log2(b+1) else 0 end),0),0) ndcg_10, coalesce(1.0/min(case when label=1 then rn end),0) mrr from oe group by 1,2), {_RANDOM}, ms as (select search_id, strategy, p_5, p_10, ndcg_10, mrr from mt union all select search_id, 'random', p_5, p_10, ndcg_10, mrr from rx)"""
_LIMITED = """ev as materialized (select user_id "key", event_id id, epoch_us(ts)/1e6 t, row_number() over (partition by user_id order by epoch_us(ts), event_id) rn from events),
 lim("key", id, t, rn, log, allowed, retry_after) as (select "key", id, t, rn, [t], true, 0 from ev where rn=1 union all
  select "key", id, t, rn, case when len(live)<2 then list_append(live,t) else live end, len(live)<2, case when len(live)<2 then 0 else greatest(1,trunc(live[1]+3600-t)::int) end
  from (select ev.*, list_filter(lim.log, lambda x: ev.t-x<3600) live from lim join ev on ev."key"=lim."key" and ev.rn=lim.rn+1))"""
_CF = r"(select *, floor(t/3600) b from (select event_id id, epoch_us(ts)/1e6 t, (value*1000)::bigint bytes from events))"

ORACLE = {
    "judged": f"{_FB} select search_id, pos, paper_key, label from judged",
    "label_stats": f"""{_FB}, per as (select s.search_id, coalesce(n,0) n, coalesce(lk,0) lk, coalesce(lkd,0) lkd from (select distinct search_id from pool) s left join (select search_id, count(*) filter (not seen) n, max(label) filter (not seen) lk, count(*) filter (seen) lkd from cand group by 1) c using(search_id))
      select (select count(*) from label) labels, (select coalesce(sum(label),0)::bigint from label) likes, count(*) searches_total, count(*) filter (n>=2 and lk=1) searches_used, count(*) filter (not (n>=2 and lk=1)) searches_too_small, sum(lkd)::bigint leaked_dropped from per""",
    "metrics_by_strategy": f"{_FB}, {_STRAT} select search_id, strategy, round(p_5,6) p_5, round(p_10,6) p_10, round(ndcg_10,6) ndcg_10, round(mrr,6) mrr from ms",
    "eval_summary": f"{_FB}, {_STRAT} select strategy, count(*) searches, round(avg(p_5),6) p_5, round(avg(p_10),6) p_10, round(avg(ndcg_10),6) ndcg_10, round(avg(mrr),6) mrr, "
    + ", ".join(f"round(case when count(*)>1 then stddev_samp({c})/sqrt(count(*)) else 0 end,6) {c}_se" for c in ("p_5", "p_10", "ndcg_10", "mrr")) + " from ms group by 1",
    "random_expectation": f"{_FB}, {_RANDOM} select search_id, round(p_5,6) p_5, round(p_10,6) p_10, round(ndcg_10,6) ndcg_10, round(mrr,6) mrr from rx",
    "first_clean_signals": f"""{_FB}, b as (select * from (select *, row_number() over (partition by paper_key order by score is null, "time", search_id, pos) rn from cand where not seen) where rn=1), cp as (select paper_key, min_by(coalesce(code_url,''),rec_id) cu, min_by(coalesce(citations,0),rec_id) ci from pk group by 1)
      select label.paper_key, label.label, b.search_id, b.score, b.recruiter, case when b.paper_key is null then cu else b.code_url end code_url, coalesce(b.n_datasets,0) n_datasets, case when b.paper_key is null then ci else b.citations end citations, b.needs_gpu
      from label left join b using(paper_key) left join cp using(paper_key)""",
    "out_of_fold": f"""{_FB}, o as (select search_id, count(*) n0, sum(label) l0 from (select distinct search_id, paper_key, label from judged) group by 1), t as (select count(*) n, sum(label) l from label)
      select search_id, (n-n0)::bigint labels, (l-l0)::bigint likes, (n-n0)>=10 and least(l-l0,(n-n0)-(l-l0))>=3 trainable from o, t""",
    "map_flags": f"{P.POOL}, {P.LIB.strip()} select n.paper_key \"key\", coalesce(rating,0) rating, o.k is not null on_screen from (select distinct paper_key from pk) n left join lib using(paper_key) left join (select distinct paper_key k from pool) o on o.k=n.paper_key",
    "trainable": f"with {P.LIB.strip()}, label as (select (rating>0)::int label from lib where rating<>0) select count(*) labels, coalesce(sum(label),0)::bigint likes, count(*)>=10 and least(coalesce(sum(label),0),count(*)-coalesce(sum(label),0))>=3 trainable from label",
    "library_fold": f"with {P.LIB.strip()} select paper_key, rating, saved, array_to_string(folders,'|') folders, summary, epoch_us(added) added_us, epoch_us(updated) updated_us, changes from lib",
    "folder_counts": f"with {P.LIB.strip()} select \"name\", count(*) \"count\" from (select unnest(folders) \"name\" from lib) group by 1",
    "library_view": f"with {P.LIB.strip()} select paper_key, rating from lib where rating>0",
    "set_folder": f"""with {P.LIB.strip()} select paper_key, case when rating>0 then true else saved end saved, array_to_string(case when rating>0 then list_transform(list_sort(list_transform(list_distinct(list_append(folders,'To read')), lambda f: {{'l': lower(f), 'f': f}})), lambda x: x.f) else folders end,'|') folders from lib""",
    "rated_titles": f"""with {P.KEYED.strip()}, {P.LIB.strip()}, tt as (select paper_key, min_by(title,rec_id) title from pk group by 1), r as (select case when rating>0 then 'liked' else 'disliked' end rating, title, row_number() over (partition by rating>0 order by updated desc, paper_key desc) rn from lib join tt using(paper_key) where rating<>0)
      select rating, string_agg(title,'|' order by rn desc) titles from r where rn<=15 group by 1""",
    "sliding_counts": "select user_id \"key\", event_id id, count(*) over (partition by user_id order by epoch_us(ts) range between 3600000000 preceding and current row) n from events",
    "cache_evict": f"select id from (select *, sum(bytes) over (order by t desc, id rows between unbounded preceding and current row) run, row_number() over (order by t desc, id) rn from {_CF}) where run<=2097152 or rn=1",
    "structured_features": f"""{P.POOL} select score_id, round(coalesce(score/10,0),6) f0, round(coalesce(recruiter/10,0),6) f1, case when score is not null then 1.0 else 0.0 end f2, case when code_url<>'' then 1.0 else 0.0 end f3, round(ln(1+n_datasets),6) f4, round(ln(1+greatest(0,citations::bigint)),6) f5, case when needs_gpu then 1.0 else 0.0 end f6 from pool""",
    "answers_parsed": "select search_id, count(*) answers, round(sum(relevance),6) relevance from scores group by 1",
    "rate_limited": f'with recursive {_LIMITED} select "key", id, allowed, retry_after from lim',
    "quota_two_level": f"""with recursive {_LIMITED}, ps as materialized (select id, t, row_number() over (order by t, id) rn from lim where allowed),
      dl(rn, id, log, ok) as (select rn, id, [t], true from ps where rn=1 union all select rn, id, case when len(live)<150 then list_append(live,t) else live end, len(live)<150
       from (select ps.rn, ps.id, ps.t, list_filter(dl.log, lambda x: ps.t-x<86400) live from dl join ps on ps.rn=dl.rn+1))
      select lim."key", lim.id, case when not allowed then 'visitor' when not coalesce(dl.ok,true) then 'daily' else 'ok' end verdict, case when allowed then 0 else ceil(retry_after/60.0)::int end "minutes" from lim left join dl using(id)""",
    "token_budget": """with recursive e as materialized (select event_type k, event_id id, epoch_us(ts)/1e6 t, least(trunc(value*20)::bigint,8000) need, row_number() over (partition by event_type order by epoch_us(ts), event_id) rn from events),
      st as (select k, id, t, need, rn from e where rn=1),
      bk(k, id, rn, need, booked, wait) as (select k, id, rn, need, [{'s': t, 'n': need}], 0.0::double from st union all
       select k, id, rn, need, case when start-t<=120 then list_append(live, {'s': start, 'n': need}) else live end, case when start-t<=120 then start-t end from
       (select *, list_min(list_filter(list_prepend(t, list_filter(list_transform(live, lambda b: b.s+60), lambda x: x>=t)), lambda c:
         len(list_filter(list_prepend(c, list_filter(list_transform(live, lambda b: b.s), lambda x: x>c and x<c+60)), lambda q: coalesce(list_sum(list_transform(list_filter(live, lambda b: b.s<=q and q<b.s+60), lambda b: b.n)),0)+need>8000))=0)) start
        from (select e.k, e.id, e.rn, e.need, e.t, list_filter(bk.booked, lambda b: b.s+60>e.t) live from bk join e on e.k=bk.k and e.rn=bk.rn+1)))
      select k "key", id, need tokens, round(wait,3) wait from bk""",
    "rank_stub": rf"""{P.POOL}, w as (select search_id, rec_id, list_distinct(regexp_extract_all(lower(concat_ws('. ',title,abstract)),'[\p{{L}}\p{{N}}_]+')) w from pool)
      select search_id, rec_id, round(10*len(list_intersect(w,['graph','attention','retrieval']))/3.0,3)::double relevance, least(10,len(w)//20)::double recruiter, case when list_contains(w,'gpu') then true end needs_gpu from w""",
    "summaries_stub": r"""select rec_id, array_to_string(string_split(regexp_replace(trim(coalesce(abstract,''),' '),'([.!?])[\t\n\x0b\f\r ]+','\1'||chr(1),'g'),chr(1))[1:2],' ') summary from papers""",
    "embed_stub": r"""with w as (select rec_id, unnest(regexp_extract_all(lower(concat_ws('. ',title,abstract)),'[\p{L}\p{N}_]+')) w from papers), h as (select rec_id, md5(w) h from w),
      c as (select rec_id, ('0x'||substr(h,1,8))::bigint%32 i, sum(case when substr(h,9,1)>='8' then 1 else -1 end)::double v from h group by 1,2), n as (select rec_id, sqrt(sum(v*v)) l, sum(v*(i+1)) s from c group by 1)
      select rec_id, 32 dim, case when coalesce(l,0)>0 then 1.0 else 0.0 end::double length, round(case when coalesce(l,0)>0 then s/l else 0 end,3) lean from papers left join n using(rec_id)""",
    # abstracts are whole up to the most characters that one may take
    "prompt": f"""{P.POOL}, {P.LIB.strip()}, tt as (select paper_key, min_by(title,rec_id) title from pk group by 1), rt as (select rating>0 liked, coalesce(title,'') title, row_number() over (partition by rating>0 order by updated desc, paper_key desc) rn from lib join tt using(paper_key) where rating<>0),
      tl as (select coalesce(chr(10)||'Liked before:'||chr(10)||'- '||string_agg(title,chr(10)||'- ' order by rn desc) filter (liked),'')||coalesce(chr(10)||'Disliked before:'||chr(10)||'- '||string_agg(title,chr(10)||'- ' order by rn desc) filter (not liked),'') t from rt where rn<=15),
      o as (select search_id, string_agg('['||pos||'] '||title||' ('||coalesce(year::varchar,'None')||', '||case when venue<>'' then venue else source end||', '||citations||' citations, '
       ||case when code_url='' then 'no public code' else concat_ws(', ', case when code_official then 'official code' else 'public code' end, case when code_framework<>'' then code_framework end, case when stars>0 then stars||' GitHub stars' end) end
       ||')'||chr(10)||(case when length(abstract)<=1200 then abstract end), chr(10)||chr(10) order by pos) l from pool group by 1),
      b as (select search_id, 'Interests:'||chr(10)||'graphs'||(select t from tl)||chr(10)||chr(10)||'Query: '||search_id||chr(10)||chr(10)||'Candidates:'||chr(10)||l t from o) select search_id, sha1(t) hash, floor(length(t)/3.5)::int tokens from b""",
    "windowed_stream": "select epoch_us(time_bucket(interval '5 minutes', ts)) start_us, event_type, count(*) n, round(sum(value),2) total from events group by 1,2",
    "blend_order": """with pool as (select *, field search_id, len(datasets) n_datasets from papers where coalesce(title,'')<>''), rg as (select *, coalesce(min(similarity) over (partition by field),0) lo, coalesce(max(similarity) over (partition by field),1) hi from pool), sg as (select *, 10*(similarity-lo)/greatest(1e-9,hi-lo) sim10, 10*preference pref10 from rg),
      rr as (select *, case when coalesce(coalesce(score,sim10)>=5,false) then 1000+100*((case when coalesce(code_url,'')<>'' then 4 else 0 end)+(case when n_datasets>=1 then 2 else 0 end)+(case when needs_gpu=false then 1 else 0 end)) else 0 end
      + coalesce((coalesce(0.3::double*score,0)+coalesce(0.6::double*recruiter,0)+coalesce(0.3::double*sim10,0)+coalesce(0.15::double*pref10,0))/nullif((case when score is not null then 0.3::double else 0 end)+(case when recruiter is not null then 0.6::double else 0 end)+(case when sim10 is not null then 0.3::double else 0 end)+(case when pref10 is not null then 0.15::double else 0 end),0),0) v from sg)
      select field, rec_id, place, round(v,4) rank_value from (select *, row_number() over (partition by field order by v desc, rec_id) place from rr) where place<=10""",
}
