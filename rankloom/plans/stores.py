"""Queries that write tables of the engine to the shared folder and read them back, and the smaller verbs of the library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ids import key
from ..operators import ai, evalkit, graph, library
from ..session import materialize, shared_dir, table
from ..sources import parsers, store
from . import pool as P


def _folder(s: SparkSession, what: str) -> str:
    return f"{shared_dir(s)}/{what}-{uuid.uuid4().hex}"


def _saved(s: SparkSession, d: str) -> str:
    """The folder of the saved searches, one document each."""
    p = materialize(P.pool(s, d), "pool")
    searches = p.groupBy("search_id").agg(F.min("time").alias("t")).select(F.col("search_id").alias("id"), "search_id", F.concat(F.lit("About "), "search_id").alias("query"), (F.col("t") / 1e6).cast("string").alias("time"))
    path = _folder(s, "searches")
    store.write_snapshots(store.build_snapshots(searches, p.withColumn("key", F.col("paper_key")), ["title", "year", "citations", "key"]).drop("search_id"), path)
    return path


def snapshot_files(s: SparkSession, d: str) -> DataFrame:
    """The candidates of all saved searches, written and read again."""
    return store.candidates(store.read_snapshots(s, _saved(s, d))).select("search_id", "pos", "title", "year")


def one_snapshot(s: SparkSession, d: str) -> DataFrame:
    """The candidates of the saved search of the smallest id."""
    first = P.pool(s, d).agg(F.min("search_id")).first()[0] or ""
    return store.candidates(store.snapshot(s, _saved(s, d), first)).select("search_id", "pos", "title")


def judged_file(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "judged")
    store.write_judged(evalkit.judged(P.pool(s, d), evalkit.labels(P.entries(s, d)), P.feedback(s, d, P.pool(s, d))).select("search_id", F.col("pos").cast("bigint").alias("pos"), "paper_key", "label"), path)
    return store.read_judged(s, path)


def index_file(s: SparkSession, d: str) -> DataFrame:
    """Links by id from the written index."""
    path = _folder(s, "index")
    store.write_index(table(s, d, "code_links"), path)
    return s.read.parquet(path).groupBy("arxiv_id").agg(F.count("*").alias("links"), F.count_distinct("repo_url").alias("repos"))


def vectors_upsert(s: SparkSession, d: str) -> DataFrame:
    """The vector cache after the rows of every tenth paper key were computed anew."""
    v = table(s, d, "vecs").select("model", "paper_key", "text_hash")
    new = v.where(F.pmod(F.length("paper_key"), F.lit(10)) == 0).select("model", "paper_key", F.lit("new").alias("text_hash")).distinct()
    path = store.write_version(store.upsert_vectors(v, new), base := _folder(s, "cache"))
    assert path.startswith(base)
    return store.read_version(s, base).groupBy("model", "text_hash").agg(F.count("*").alias("n"))


def results_log(s: SparkSession, d: str) -> DataFrame:
    """Two runs of a small summary in one log."""
    path = _folder(s, "results")
    counts = table(s, d, "events").groupBy(F.col("event_type").alias("strategy")).agg(F.count("*").alias("searches"), *(F.round(F.avg("value"), n).alias(c) for n, c in enumerate(("p_5", "p_10", "ndcg_10", "mrr"))))
    for stamp in ("first", "second"):
        store.append_results(counts, path, stamp)
    return s.read.option("header", True).schema("timestamp string, strategy string, searches bigint, p_5 string, p_10 string, ndcg_10 string, mrr string").csv(path)


def cv_log(s: SparkSession, d: str) -> DataFrame:
    """A log without kinds of features, and a newer one with them, as one."""
    e = table(s, d, "events")
    old = e.where("event_type = 'click'").select("event_id", "value")
    new = e.where("event_type <> 'click'").select("event_id", "value", F.lit("enriched").alias("features"))
    return store.migrate_cv_log(old, new)


def bibtex_file(s: SparkSession, d: str) -> DataFrame:
    """Entries written one after another and split at the blank lines again."""
    path = _folder(s, "bib")
    store.write_bibtex(table(s, d, "papers").select(F.concat(F.lit("@misc{r"), F.col("rec_id").cast("string"), F.lit(","), F.lit("\n  title = {"), text.collapse(F.col("title")), F.lit("}\n}")).alias("entry")), path)
    read = s.read.option("lineSep", "\n\n").text(path)
    return read.select(F.regexp_extract("value", r"^@misc\{r(\d+),", 1).cast("bigint").alias("rec_id"), F.md5("value").alias("hash"))


def library_removed(s: SparkSession, d: str) -> DataFrame:
    """The library without its disliked entries."""
    e = P.entries(s, d)
    return library.remove(e, e.where("rating < 0").select("paper_key")).select("paper_key", "rating")


def library_got(s: SparkSession, d: str) -> DataFrame:
    """The entry of the first key."""
    e = materialize(P.entries(s, d), "entries")
    return library.get(e, e.agg(F.min("paper_key")).first()[0] or "").select("paper_key", "rating", "saved")


def library_upserted(s: SparkSession, d: str) -> DataFrame:
    """The library after every saved entry was rated anew: within -1 to 1, missing ratings leaving it as it is."""
    e = P.entries(s, d).select("paper_key", "rating", "saved")
    stated = F.when(F.col("rating") <= 0, text.clamp(F.col("rating") * 5 + 3, -1, 1)).cast("int")
    return library.upsert(e, e.where("saved").select("paper_key", stated.alias("rating"))).select("paper_key", "rating", "saved")


def vertices(s: SparkSession, d: str) -> DataFrame:
    """The even vectors as a graph's vertices, with the first of a visitor's own that it lacks."""
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return graph.with_papers(v.where("id % 2 = 0"), v.where("id % 3 = 0"), 40).select("id", F.size("vec").alias("dim"))


def summary_inputs(s: SparkSession, d: str) -> DataFrame:
    """What a summary would be made of: each document's text if long enough, else the abstract of its paper."""
    abstracts = table(s, d, "papers").groupBy(key().alias("paper_key")).agg(F.min_by(F.coalesce("abstract", F.lit("")), "rec_id").alias("abstract"))
    both = table(s, d, "documents").join(abstracts, "paper_key")
    return both.select("doc_id", F.md5(ai.summary_input(F.col("text"), F.col("abstract"), 5_000)).alias("hash"))


def marked_pages(s: SparkSession, d: str) -> DataFrame:
    """The titles of each field and year as a document's pages, up to 300 characters."""
    pages = table(s, d, "papers").where("year is not null and field is not null").select(F.concat_ws("-", "field", "year").alias("doc_id"), F.col("rec_id").alias("page"), F.coalesce("title", F.lit("")).alias("text"))
    return store.pages_within(pages, 300).select("doc_id", F.md5("text").alias("hash"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").where("rec_id is not null")


def hub_records(s: SparkSession, d: str) -> DataFrame:
    """Records as the hub answers with them, read by its parser."""
    people = F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name")))
    paper = F.struct(
        F.nullif(F.coalesce("arxiv_id", F.lit("")), F.lit("")).alias("id"), "title", F.col("abstract").alias("summary"), people.alias("authors"), F.concat(F.col("year").cast("string"), F.lit("-01-02T00:00:00Z")).alias("publishedAt"),
        F.col("code_url").alias("githubRepo"), F.col("stars").alias("githubStars"), "upvotes", F.col("tldr").alias("ai_summary"),
    )
    path = _folder(s, "hub")
    _answers(s, d).select(paper.alias("paper")).write.json(path)
    r = parsers.from_hub(s.read.schema(parsers.HUB).json(path))
    return r.select("arxiv_id", F.md5("title").alias("title"), F.md5("abstract").alias("abstract"), F.size("authors").alias("authors"), "year", "url", "stars", "upvotes", "code_url")


def atom_records(s: SparkSession, d: str) -> DataFrame:
    """Records as the preprint server's feed has them, read by its parser."""
    people = F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name")))
    path = _folder(s, "feed")
    feed = _answers(s, d).where("arxiv_id <> ''").select(
        F.concat(F.lit("http://feed.example.org/abs/"), "arxiv_id").alias("id"), text.collapse(F.col("title")).alias("title"), F.concat(F.lit("  "), text.collapse(F.col("abstract"))).alias("summary"), F.concat(F.col("year").cast("string"), F.lit("-03-04T00:00:00Z")).alias("published"), people.alias("author"),
    )
    feed.write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(path)
    r = parsers.read_atom(s, path)
    return r.select("arxiv_id", F.md5("title").alias("title"), F.md5("abstract").alias("abstract"), "year", "url", "venue")


def works_records(s: SparkSession, d: str) -> DataFrame:
    """Records as the library of works answers with them, abstracts as inverted indexes, read by its parser."""
    words = F.split(text.collapse(F.coalesce("abstract", F.lit(""))), " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("key"), F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()).alias("value"))))
    work = F.struct(
        F.concat(F.lit("W"), F.col("rec_id").cast("string")).alias("id"), "title", F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), "doi")).alias("doi"), F.col("year").alias("publication_year"), F.col("citations").alias("cited_by_count"),
        index.alias("abstract_inverted_index"), F.transform("authors", lambda n: F.struct(F.struct(n.alias("display_name")).alias("author"))).alias("authorships"), F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"),
    )
    path = _folder(s, "works")
    _answers(s, d).select(work.alias("w")).select("w.*").write.json(path)
    r = parsers.from_works(s.read.schema(parsers.WORK).json(path))
    return r.select("url", "doi", F.md5("title").alias("title"), F.md5("abstract").alias("abstract"), F.size("authors").alias("authors"), "year", "venue", "citations")


QUERIES = {
    "snapshot_files": snapshot_files, "one_snapshot": one_snapshot, "judged_file": judged_file, "index_file": index_file, "vectors_upsert": vectors_upsert, "results_log": results_log, "cv_log": cv_log, "bibtex_file": bibtex_file,
    "library_removed": library_removed, "library_got": library_got, "library_upserted": library_upserted, "vertices": vertices, "summary_inputs": summary_inputs, "marked_pages": marked_pages, "hub_records": hub_records, "atom_records": atom_records, "works_records": works_records,
}

_COLLAPSED = rf"trim(regexp_replace(coalesce({{0}},''),'{P.SPACES.replace('{', '{{').replace('}', '}}')}',' ','g'),' ')"
ORACLE = {
    "snapshot_files": f"{P.POOL} select search_id, pos, title, year from pool",
    "one_snapshot": f"{P.POOL} select search_id, pos, title from pool where search_id=(select min(search_id) from pool)",
    "judged_file": f"{P.POOL}, {P.LIB.strip()}, {P.FEEDBACK.strip()} select search_id, pos, paper_key, label from judged",
    "index_file": "select arxiv_id, count(*) links, count(distinct repo_url) repos from code_links group by 1",
    "vectors_upsert": "select model, text_hash, count(*) n from (select model, paper_key, text_hash from vecs where not exists (select 1 from vecs v where v.model=vecs.model and v.paper_key=vecs.paper_key and length(v.paper_key)%10=0) union all select distinct model, paper_key, 'new' from vecs where length(paper_key)%10=0) group by 1,2",
    "results_log": "select stamp \"timestamp\", event_type strategy, count(*) searches, printf('%.4f', round(avg(value),0)) p_5, printf('%.4f', round(avg(value),1)) p_10, printf('%.4f', round(avg(value),2)) ndcg_10, printf('%.4f', round(avg(value),3)) mrr from events, (values ('first'),('second')) s(stamp) group by 1,2",
    "cv_log": "select event_id, value, case when event_type='click' then 'embedding' else 'enriched' end features from events",
    "bibtex_file": f"select rec_id, md5('@misc{{r'||rec_id||','||chr(10)||'  title = {{'||{_COLLAPSED.format('title')}||'}}'||chr(10)||'}}') hash from papers",
    "library_removed": f"with {P.LIB.strip()} select paper_key, rating from lib where rating>=0",
    "library_got": f"with {P.LIB.strip()} select paper_key, rating, saved from lib where paper_key=(select min(paper_key) from lib)",
    "library_upserted": f"with {P.LIB.strip()} select paper_key, case when saved and rating<=0 then least(1,greatest(-1,rating*5+3)) else rating end::int rating, saved from lib",
    "vertices": "select id, 64 dim from (select vec_id id from embeddings where vec_id%2=0 union all (select vec_id from embeddings where vec_id%3=0 and vec_id%2<>0 order by vec_id limit 40))",
    "summary_inputs": f"with {P.KEYED.strip()}, ab as (select paper_key, min_by(coalesce(abstract,''),rec_id) abstract from pk group by 1) select doc_id, md5(case when length(text)>1500 then substr(text,1,4000) else abstract end) hash from documents join ab using(paper_key)",
    "marked_pages": r"""with c as (select field||'-'||year d, rec_id, chr(10)||'[p. '||rec_id||']'||chr(10)||trim(regexp_replace(coalesce(title,''),'[\t\n\x0b\f\r ]+',' ','g'),' ') chunk from papers where year is not null and field is not null),
      l as (select *, 300-coalesce(sum(length(chunk)) over (partition by d order by rec_id rows between unbounded preceding and 1 preceding),0) rest from c),
      t as (select d, string_agg(case when length(chunk)>rest then substr(chunk,1,rest::bigint)||chr(10)||'[... truncated to fit the model''s context ...]' else chunk end,'' order by rec_id) t from l where rest>=0 group by 1) select d doc_id, md5(regexp_replace(t,'^[\t\n\x0b\f\r ]+|[\t\n\x0b\f\r ]+$','','g')) hash from t""",
    "hub_records": f"""select arxiv_id, md5({_COLLAPSED.format('title')}) title, md5({_COLLAPSED.format('abstract')}) abstract, len(list_filter((coalesce(authors,[]))[1:12], lambda a: a is not null and a<>''))::int authors, year, 'https://huggingface.co/papers/'||arxiv_id url, coalesce(stars,0) stars, coalesce(upvotes,0) upvotes, coalesce(code_url,'') code_url
      from papers where coalesce(arxiv_id,'')<>''""",
    "atom_records": f"select arxiv_id, md5({_COLLAPSED.format('title')}) title, md5({_COLLAPSED.format('abstract')}) abstract, year, 'https://arxiv.org/abs/'||arxiv_id url, 'arXiv' venue from papers where arxiv_id<>''",
    "works_records": f"""select case when doi<>'' then 'https://doi.org/'||doi else 'W'||rec_id end url, coalesce(doi,'') doi, md5(coalesce(title,'')) title, md5({_COLLAPSED.format('abstract')}) abstract, len(list_filter((coalesce(authors,[]))[1:12], lambda a: a is not null and a<>''))::int authors, year, coalesce(venue,'') venue, coalesce(citations,0) citations from papers""",
}
