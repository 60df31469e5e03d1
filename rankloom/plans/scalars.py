"""Queries of scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..config import Filters
from ..functions import ids, text
from ..operators import filters
from ..operators.enrich import cleaned_scores
from ..session import table
from . import pool as P


def ids_keys(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers")
    return p.select("rec_id", F.array_join(ids.identifiers(), "|").alias("ids"), ids.key().alias("key"), ids.norm_title(F.col("title")).alias("norm"))


def norm_names(s: SparkSession, d: str) -> DataFrame:
    n = ids.norm_name(F.col("name"))
    return table(s, d, "datasets").select("key", n.alias("norm"), ids.base_name(n).alias("base"), ids.dataset_search(F.col("name")).alias("link"))


def url_builders(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").withColumn("k", ids.key())
    return p.select("rec_id", ids.paper_url(F.when(F.col("source") == "OpenAlex", F.col("url")), F.col("k"), F.col("title")).alias("link"))


def bibtex(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").select("rec_id", text.bibtex().alias("entry"))


def text_hash(s: SparkSession, d: str) -> DataFrame:
    t = ids.paper_text()
    return table(s, d, "papers").select("rec_id", ids.text_hash(t).alias("hash"), text.tokens_of(t).alias("tokens"))


def evidence_words(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select("rec_id", F.posexplode(text.sentences(F.col("abstract"))).alias("pos", "sentence"))
    return p.select("rec_id", "pos", text.evidence_words(F.col("sentence")).alias("n")).where("n > 0")


def evidence_scores(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers").select("rec_id", F.posexplode(text.sentences(F.col("abstract"))).alias("pos", "sentence"))
    return p.select("rec_id", "pos", text.evidence(F.col("sentence")).alias("evidence")).where("evidence > 0")


def excerpts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").select("rec_id", text.excerpt(ids.text("abstract"), F.lit(400)).alias("excerpt"))


def clean_datasets(s: SparkSession, d: str) -> DataFrame:
    return cleaned_scores(table(s, d, "scores")).select("score_id", F.array_join("datasets", "|").alias("names"), "relevance", "recruiter")


def inverted_index(s: SparkSession, d: str) -> DataFrame:
    """Each text as an inverted index (built per row, without a shuffle) and back."""
    words = F.filter(F.split(ids.text("text"), r"\s+"), lambda w: w != "")
    distinct = F.array_distinct(words)
    index = F.map_from_arrays(distinct, F.transform(distinct, lambda w: F.filter(F.transform(words, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())))
    short = table(s, d, "eval_items").select("item_id", "text")
    return short.select("item_id", text.invert_index(index).alias("text"), F.size(distinct).alias("words"))


def model_json(s: SparkSession, d: str) -> DataFrame:
    """The number in each event's properties, out of an answer with thoughts and prose around it."""
    answer = F.concat(F.lit("<think>maybe {\"k\": 0}\n</think>Here it is: "), F.col("props"), F.lit(" as asked."))
    got = F.from_json(text.json_object(text.strip_thoughts(answer)), "k bigint")
    return table(s, d, "events").select("event_id", got["k"].alias("k"))


def error_classes(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "view", "connect")
    status = F.when(F.col("event_type") == "purchase", 429).when(F.col("event_type") == "click", 503)
    c = text.classify_error(kind, status)
    return e.select("event_id", c.alias("class"), text.describe_error(F.lit("source"), c, status).alias("message"))


def signal_lights(s: SparkSession, d: str) -> DataFrame:
    p = P.pool(s, d)
    return p.select("score_id", *text.signal_lights(F.col("datasets"), F.col("recruiter"), F.col("similarity"), F.col("preference")))


def masked(s: SparkSession, d: str) -> DataFrame:
    return text.mask_private(table(s, d, "papers")).select("rec_id", "preference", "recruiter", "recruiter_reason", "needs_gpu", "score", "similarity")


def trimmed(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "papers")
    return p.select("rec_id", *text.trim_foreign(F.col("title"), F.col("abstract"), F.col("year").cast("string"))).select("rec_id", "title", F.length("abstract").alias("size"), "year")


def prompt_budget(s: SparkSession, d: str) -> DataFrame:
    """Characters an abstract may take in each search's request of at most 8,000 tokens."""
    p = P.pool(s, d).groupBy("search_id").agg(F.count("*").alias("n"), F.sum(text.tokens_of(F.col("title"))).alias("base"))
    return p.select("search_id", text.abstract_budget(F.lit(8000), F.col("base"), F.col("n")).alias("chars"))


def rewrite_ok(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers").select("rec_id", text.acceptable_rewrite(F.col("title")).alias("ok"), text.author_line(F.col("authors")).alias("line"))


def headings(s: SparkSession, d: str) -> DataFrame:
    """Titles as bold headings of a summary, brought to plain ones."""
    md = F.concat(F.lit("**## "), ids.text("title"), F.lit("**\n"), F.lit("some **bold** text"))
    return table(s, d, "papers").select("rec_id", text.plain_headings(md).alias("markdown"))


def visitor_titles(s: SparkSession, d: str) -> DataFrame:
    """What a visitor who rated a record's authors would send: blanks dropped, the last 15 kept."""
    return table(s, d, "papers").select("rec_id", F.array_join(text.visitor_titles(F.concat(F.coalesce("authors", F.array().cast("array<string>")), F.array(F.lit(" "), F.col("title")))), "|").alias("titles"))


def client_ips(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    peer = F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"))
    forwarded = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(" 172.16.0."), (F.col("event_id") % 256).cast("string"), F.lit(", 10.1.1.1")))
    return e.select("event_id", text.client_ip(forwarded, peer).alias("ip"))


FILTERS = Filters(min_year=2015, min_citations=1, exclude_keywords=("survey", "comment on"))


def hard_filters(s: SparkSession, d: str) -> DataFrame:
    return filters.apply_filters(table(s, d, "papers"), FILTERS).select("rec_id")


def link_rows(s: SparkSession, d: str) -> DataFrame:
    return filters.usable_links(table(s, d, "code_links")).groupBy("arxiv_id").agg(F.count("*").alias("links"), F.countDistinct("repo_url").alias("repos"))


def rejects(s: SparkSession, d: str) -> DataFrame:
    """Records with text in place of numbers: every third citation count is no number, every fifth has a fraction."""
    p = table(s, d, "papers")
    raw = p.select("rec_id", "title", F.col("year").cast("string").alias("year"), F.when(F.col("rec_id") % 3 == 0, "many").when(F.col("rec_id") % 5 == 0, F.concat(F.col("citations").cast("string"), F.lit(".5"))).otherwise(F.col("citations").cast("string")).alias("citations"))
    return schema.validate(raw)[1].select("rec_id", "reason")


QUERIES = {
    "ids_keys": ids_keys, "norm_names": norm_names, "url_builders": url_builders, "bibtex": bibtex, "text_hash": text_hash, "evidence_words": evidence_words, "evidence_scores": evidence_scores,
    "excerpts": excerpts, "clean_datasets": clean_datasets, "inverted_index": inverted_index, "model_json": model_json, "error_classes": error_classes, "signal_lights": signal_lights, "masked": masked,
    "trimmed": trimmed, "prompt_budget": prompt_budget, "rewrite_ok": rewrite_ok, "hard_filters": hard_filters, "link_rows": link_rows, "rejects": rejects,
    "headings": headings, "visitor_titles": visitor_titles, "client_ips": client_ips,
}

# Names of datasets and the like without look-ahead, on text whose letters are all ASCII and whose two-letter codes are masked.
_NAME = r"\b[\w-]*[A-Z][\w-]*\d[\w-]*\b|\b[\w-]*\d[\w-]*[A-Z][\w-]*\b|\b[A-Z][a-z]*[A-Z][\w-]*\b"


def _ascii(c: str) -> str:
    return rf"regexp_replace({c},'[^\x00-\x7f\p{{Z}}\p{{P}}\p{{S}}\p{{C}}]','x','g')"


def _masked(c: str) -> str:
    once = lambda x: rf"regexp_replace({x},'(^|[^\w-])(?:[A-Z]\d|\d[A-Z])($|[^\w-])','\1xx\2','g')"
    return once(once(_ascii(c)))


def _trimmed(c: str) -> str:
    return f"regexp_replace({c},'^{P.SPACES}|{P.SPACES}$','','g')"


def _sentences(c: str) -> str:
    return rf"string_split(regexp_replace({_trimmed(c)},'([.!?]){P.SPACES}','\1'||chr(1),'g'),chr(1))"


_EV = r"\b(data ?sets?|databases?|benchmarks?|corpus|corpora|evaluat\w*|experiments?|outperform\w*|state[- ]of[- ]the[- ]art|test(s|ed|ing)?|train(s|ed|ing)?|accuracy|performance|results?)\b"
ORACLE = {
    "ids_keys": f"with {P.KEYED.strip()} select rec_id, array_to_string(list_filter([k1,k2,k3], lambda x: x is not null),'|') ids, paper_key \"key\", regexp_replace(lower(coalesce(title,'')),'{P.NW}','','g') norm from pk",
    "norm_names": r"""select key, n norm, regexp_replace(n,'(\d+k|\d+m|full|small|large|v\d+)$','') base, 'https://huggingface.co/datasets?search='||replace(replace(replace(url_encode(name),'%2F','/'),'%7E','~'),'*','%2A') link
      from (select *, regexp_replace(lower(name),'[^a-z0-9]','','g') n from datasets)""",
    "url_builders": f"""with {P.KEYED.strip()} select rec_id, case when source='OpenAlex' and coalesce(url,'')<>'' then url when starts_with(paper_key,'arxiv:') then 'https://arxiv.org/abs/'||substr(paper_key,7)
      when starts_with(paper_key,'doi:') then 'https://doi.org/'||substr(paper_key,5) else 'https://scholar.google.com/scholar?q='||replace(coalesce(title,''),' ','+') end link from pk""",
    "bibtex": r"""with a as (select *, coalesce(authors,[]) au, trim(regexp_replace(coalesce(title,''),'[\s\p{Z}]+',' ','g')) ct from papers),
      b as (select *, case when len(au)>0 then coalesce(string_split(trim(regexp_replace(coalesce(au[1],''),'[\s\p{Z}]+',' ','g')),' ')[-1],'') else 'anon' end f, case when coalesce(year,0)<>0 then year::varchar end y from a)
      select rec_id, concat_ws(chr(10), '@article{'||lower(regexp_replace(f||coalesce(y,'')||string_split(ct,' ')[1],'[^\p{L}\p{N}_]','','g'))||',', '  title = {'||coalesce(title,'')||'},',
       case when len(au)>0 then '  author = {'||array_to_string(list_transform(au, lambda x: coalesce(x,'')),' and ')||'},' end, case when y is not null then '  year = {'||y||'},' end, case when coalesce(venue,'')<>'' then '  journal = {'||venue||'},' end,
       case when coalesce(doi,'')<>'' then '  doi = {'||doi||'},' end, case when coalesce(arxiv_id,'')<>'' then '  eprint = {'||arxiv_id||'}, archivePrefix = {arXiv},' end, '  url = {'||coalesce(url,'')||'}'||chr(10)||'}') entry from b""",
    "text_hash": f"select rec_id, substr(sha1(t),1,16) hash, floor(length(t)/3.5)::int tokens from (select rec_id, {P.PAPER_TEXT} t from papers)",
    "evidence_words": rf"""with s as (select rec_id, string_split(regexp_replace(regexp_replace(coalesce(abstract,''),'^{P.SPACES}|{P.SPACES}$','','g'),'([.!?]){P.SPACES}','\1'||chr(1),'g'),chr(1)) l from papers), u as (select rec_id, unnest(l) sentence, generate_subscripts(l,1)-1 pos from s), t as (select rec_id, pos, regexp_replace(sentence,'[^\x00-\x7f\p{{Z}}\p{{P}}\p{{S}}\p{{C}}]','x','g') sentence from u)
      select rec_id, pos, len(regexp_extract_all(sentence,'(?i){_EV}'))::int n from t where len(regexp_extract_all(sentence,'(?i){_EV}'))>0""",
    "evidence_scores": rf"""with u as (select rec_id, unnest(l) s, generate_subscripts(l,1)-1 pos from (select rec_id, {_sentences("coalesce(abstract,'')")} l from papers)),
      v as (select rec_id, pos, len(regexp_extract_all({_ascii('s')},'{_EV}',0,'i')) n, len(regexp_extract_all({_masked('s')},'{_NAME}')) names from u)
      select rec_id, pos, (3*n*(1+least(2,names)))::int evidence from v where n>0""",
    "excerpts": rf"""with recursive a as (select rec_id, coalesce(abstract,'') t, 400 lim from papers),
      u as (select rec_id, lim, unnest(l) s, generate_subscripts(l,1)-1 i from (select rec_id, lim, {_sentences('t')} l from a where length(t)>lim)),
      v as (select *, len(regexp_extract_all({_ascii('s')},'{_EV}',0,'i')) n, len(regexp_extract_all({_masked('s')},'{_NAME}')) nn from u),
      w as (select *, 3*n*(1+least(2,nn)) e, row_number() over (partition by rec_id order by 3*n*(1+least(2,nn)) desc, i) r from v),
      q as materialized (select *, row_number() over (partition by rec_id order by turn, case when turn=0 then r else i end) k from (select rec_id, lim, i, s, r, 0 turn from w where e>0 and r<=3 union all select rec_id, lim, i, s, r, case when i=0 then 1 else 2 end from w)),
      g(rec_id, k, rest, taken) as (select rec_id, 0::bigint, max(lim), []::struct(i bigint, s varchar)[] from q group by 1 union all
       select rec_id, k, case when ok then rest-length(piece)-2 else rest end, case when ok then list_append(taken, {{'i': i, 's': piece}}) else taken end from (select *, piece<>'' and length(piece)+2<=rest and not list_contains(list_transform(taken, lambda x: x.i), i) ok from
       (select *, case when length(s)<=room then s when turn<2 and room>0 then (case when st>0 then '…' else '' end)||{_trimmed('substr(s,st+1,room)')}||(case when st+room<length(s) then '…' else '' end) else '' end piece from
       (select *, greatest(0,least(coalesce(list_min(list_filter(nm, lambda x: x>coalesce(ev,-1))),ev,0)-room//2,length(s)-room)) st from
       (select *, list_transform(range(1,len(m)+1), lambda j: (list_sum(list_transform(gp[1:j], lambda x: length(x)))+coalesce(list_sum(list_transform(m[1:j-1], lambda x: length(x))),0))::bigint) nm, case when em<>'' then length(regexp_split_to_array({_ascii('s')}, '(?i){_EV}')[1]) end ev from
       (select q.rec_id, q.k, q.i, q.s, q.turn, g.rest, g.taken, case when turn=0 then lim//2 else rest-2 end room, regexp_extract({_ascii('q.s')},'{_EV}',0,'i') em, regexp_extract_all({_masked('q.s')},'{_NAME}') m, regexp_split_to_array({_masked('q.s')},'{_NAME}') gp
        from g join q on q.rec_id=g.rec_id and q.k=g.k+1)))))),
      f as (select rec_id, list_sort(arg_max(taken,k)) t from g group by 1)
      select a.rec_id, case when f.rec_id is null then a.t when len(f.t)=0 then substr(a.t,1,lim) else substr(array_to_string(list_transform(range(1,len(f.t)+1), lambda j: (case when j=1 then '' when f.t[j-1].i=f.t[j].i-1 then ' ' else ' … ' end)||f.t[j].s),''),1,lim) end excerpt from a left join f using(rec_id)""",
    "clean_datasets": P.POOL.split("pool as (")[0].rstrip().rstrip(",") + " select score_id, array_to_string(ds,'|') \"names\", case when relevance is not null then least(10.0,greatest(0.0,relevance)) end relevance, case when recruiter is not null then least(10.0,greatest(0.0,recruiter)) end recruiter from sd",
    "inverted_index": r"select item_id, array_to_string(l,' ') text, len(list_distinct(l))::int words from (select item_id, list_filter(regexp_split_to_array(coalesce(text,''),'\s+'), lambda w: w<>'') l from eval_items)",
    "model_json": "select event_id, (json_extract(props,'$.k'))::bigint k from events",
    "error_classes": """select event_id, c class, 'source '||case c when 'timeout' then 'timed out' when 'rate_limit' then 'rate limited, try again in a minute' when 'http_error' then 'HTTP 503' when 'network' then 'couldn''t connect' else 'unexpected response' end message
      from (select event_id, case event_type when 'error' then 'timeout' when 'purchase' then 'rate_limit' when 'click' then 'http_error' when 'view' then 'network' else 'bad_response' end c from events)""",
    "signal_lights": P.POOL + " select score_id, n_datasets>=2 many_datasets, coalesce(recruiter>=7,false) recruiter_pick, coalesce(similarity>=0.8,false) very_similar, coalesce(preference>=0.5,false) likely_liked from pool",
    "masked": "select rec_id, null::double preference, null::double recruiter, '' recruiter_reason, null::boolean needs_gpu, score, null::double similarity from papers",
    "trimmed": "select rec_id, substr(coalesce(title,''),1,500) title, length(substr(coalesce(abstract,''),1,4000))::int size, year from papers",
    "prompt_budget": P.POOL + " select search_id, greatest(200, least(1200, trunc((8000-(150*n+1000)-base)*3.5/n)::int))::int chars from (select search_id, count(*) n, sum(floor(length(title)/3.5)) base from pool group by 1)",
    "rewrite_ok": r"""select rec_id, t<>'' and len(string_split(t,' ')) between 1 and 8 ok, array_to_string(list_transform(au[1:3], lambda x: x),', ')||case when len(au)>3 then ' et al.' else '' end line
      from (select rec_id, trim(regexp_replace(coalesce(title,''),'[\s\p{Z}]+',' ','g')) t, coalesce(authors,[]) au from papers)""",
    "headings": "select rec_id, '## '||regexp_replace(coalesce(title,''),'\\s+$','')||chr(10)||'some **bold** text' markdown from papers",
    "visitor_titles": "select rec_id, array_to_string(list_filter(list_transform(l[greatest(1,len(l)-14):], lambda t: substr(trim(coalesce(t,''),' '),1,300)), lambda t: t<>''),'|') titles from (select rec_id, list_concat(coalesce(authors,[]),[' ',title]) l from papers)",
    "client_ips": "select event_id, case when event_id%3<>0 then '172.16.0.'||(event_id%256) else '10.0.0.'||(user_id%256) end ip from events",
    "hard_filters": """select rec_id from papers where coalesce(title,'')<>'' and (coalesce(year,0)=0 or year>=2015) and (source in ('arXiv','Hugging Face') or coalesce(citations,0)>=1)
      and not contains(lower(coalesce(title,'')||' '||coalesce(abstract,'')),'survey') and not contains(lower(coalesce(title,'')||' '||coalesce(abstract,'')),'comment on')""",
    "link_rows": "select arxiv_id, count(*) links, count(distinct repo_url) repos from code_links where coalesce(arxiv_id,'')<>'' and repo_url is not null group by 1",
    "rejects": """select rec_id, array_to_string(list_filter([case when title is null then 'title: missing' end, case when citations is not null and (rec_id%3=0 or rec_id%5=0) or (rec_id%3=0) then 'citations: not a whole number' end], lambda x: x is not null),'; ') reason
      from papers where title is null or rec_id%3=0 or (rec_id%5=0 and citations is not null)""",
}
