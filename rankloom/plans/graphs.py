"""Queries of vectors and the similarity graph, over the 64-dimensional ``embeddings``.

Their cosines stay below the graph's usual floor, so the queries use MIN_SIM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import graph
from ..session import shared_dir, table

MIN_SIM = 0.2
#: The searches: every vector whose id is divisible by it.
EVERY = 50


def vecs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def adjacency(s: SparkSession, d: str) -> DataFrame:
    """The edges of the graph, built once for its vectors and stored."""
    v = vecs(s, d)
    return graph.current(s, f"{shared_dir(s)}/graphs", graph.signature(v, graph.K, MIN_SIM), lambda: graph.symmetric(graph.nearest(v, v, floor=MIN_SIM)))


def normalized(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "vecs").where(F.size("vec") == 384)
    n = vectors.normalize(F.col("vec"))
    return v.where(~F.exists("vec", lambda x: x.isNull() | F.isnan(x))).select("vec_id", F.round(vectors.norm(F.col("vec")), 4).alias("length"), F.round(vectors.norm(n), 4).alias("unit"))


def query_similarity(s: SparkSession, d: str) -> DataFrame:
    """Similarity of every vector to the query (vector 0) with interests (vector 1)."""
    v = table(s, d, "embeddings")
    got = {r["vec_id"]: F.array(*map(F.lit, r["embedding"])) for r in v.where("vec_id IN (0, 1)").collect()}  # two rows
    return v.select("vec_id", F.round(vectors.dot(vectors.normalize(F.col("embedding")), vectors.query_vector(got[0], got[1])), 6).alias("similarity"))


def nearest_queries(s: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 50."""
    v = vecs(s, d)
    return graph.nearest(v.where("id % 50 = 0"), v, k=10, floor=-1.0).select("src", "dst", F.round("sim", 6).alias("sim"))


def knn_edges(s: SparkSession, d: str) -> DataFrame:
    return adjacency(s, d).select("src", "dst", F.round("sim", 6).alias("sim"))


def degrees(s: SparkSession, d: str) -> DataFrame:
    return graph.degree(adjacency(s, d)).select("src", F.round("degree", 6).alias("degree"), "links")


def seed_sims(s: SparkSession, d: str) -> DataFrame:
    return graph.nearest(vecs(s, d).where(F.col("id") % EVERY == 0), vecs(s, d), k=None, floor=MIN_SIM).select(F.col("src").alias("seed_id"), F.col("dst").alias("node"), "sim")


def pagerank(s: SparkSession, d: str) -> DataFrame:
    """The walk from every search's vector."""
    seeds = vecs(s, d).where(F.col("id") % EVERY == 0).select(F.col("id").alias("seed_id"), F.col("id").alias("node"), F.lit(1.0).alias("weight"))
    return graph.pagerank(adjacency(s, d), seeds).select("seed_id", "node", F.round("score", 6).alias("score"))


def similar(s: SparkSession, d: str) -> DataFrame:
    return graph.similar(adjacency(s, d), seed_sims(s, d), floor=MIN_SIM).select("seed_id", "node", "similarity", F.round("score", 6).alias("score"), "direct", "via")


def neighbourhood(s: SparkSession, d: str) -> DataFrame:
    nodes, links = graph.neighbourhood(adjacency(s, d), vecs(s, d).where("id < 5").select(F.col("id").alias("node")), 40)
    return nodes.select(F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("focus").cast("double").alias("value")).unionByName(links.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("sim").alias("value")))


def related(s: SparkSession, d: str) -> DataFrame:
    v = vecs(s, d)
    focus = v.where("id < 20").select(F.col("id").alias("node"), F.col("id").alias("ord"))
    return graph.related(adjacency(s, d), focus, v.where("id % 7 = 0").select(F.col("id").alias("node"))).select("node", F.round("sim", 3).alias("sim"), "via")


QUERIES = {
    "normalized": normalized, "query_similarity": query_similarity, "nearest_queries": nearest_queries, "knn_edges": knn_edges, "degrees": degrees, "pagerank": pagerank,
    "similar": similar, "neighbourhood": neighbourhood, "related": related,
}

_DOT = "list_sum(list_transform(range(1,65), lambda i: a.embedding[i]::double*b.embedding[i]::double))"
_LEN = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::double*x::double)))"
_COS = f"{_DOT}/({_LEN.format('a')}*{_LEN.format('b')})"
_ADJ = f"""allp as materialized (select a.vec_id src, b.vec_id dst, {_COS} sim from embeddings a join embeddings b on a.vec_id<>b.vec_id),
 kn as (select * from (select *, row_number() over (partition by src order by sim desc, dst) rn from allp where sim>={MIN_SIM}) where rn<=8),
 adj as materialized (select src, dst, max(sim) sim from (select src,dst,sim from kn union all select dst,src,sim from kn) group by 1,2), dg as (select src, sum(sim) degree, count(*) links from adj group by 1)"""


def _walk(seed: str) -> str:
    """The walk of every seed of sd(seed, node, s): a step passes on what is kept, and all start anew."""
    return f"""wk as materialized (select adj.src, adj.dst, sim/degree p from adj join dg using(src)), sd as materialized ({seed}),
 pr(i,seed,node,r) as (select 0, seed, node, s from sd union all select i+1, seed, node, sum(r) from
  (select i, seed, wk.dst node, 0.6*pr.r*wk.p r from pr join wk on wk.src=pr.node union all select it.i, sd.seed, sd.node, 0.4*s from sd, (select distinct i from pr) it) where i<30 group by i, seed, node)"""


_NEAR = f"nr as materialized (select src seed, dst node, sim from allp where src%{EVERY}=0 and sim>={MIN_SIM}), dr as materialized (select * from (select *, row_number() over (partition by seed order by sim desc, node) rn from nr) where rn<=8)"

ORACLE = {
    "normalized": """select vec_id, round(l,4) length, round(sqrt(list_sum(list_transform(vec, lambda x: (x::double/greatest(l,1e-12))*(x::double/greatest(l,1e-12))))),4) unit
      from (select *, sqrt(list_sum(list_transform(vec, lambda x: x::double*x::double))) l from vecs where len(vec)=384 and len(list_filter(vec, lambda x: x is null or isnan(x)))=0)""",
    "query_similarity": """with q as (select list_transform(range(1,65), lambda i: a.embedding[i]::double+b.embedding[i]::double) q from embeddings a, embeddings b where a.vec_id=0 and b.vec_id=1), l as (select q, sqrt(list_sum(list_transform(q, lambda y: y*y))) len from q)
      select vec_id, round(list_sum(list_transform(range(1,65), lambda i: embedding[i]::double*q[i]))/len/sqrt(list_sum(list_transform(embedding, lambda x: x::double*x::double))),6) similarity from embeddings, l""",
    "nearest_queries": f"select src, dst, round(sim,6) sim from (select *, row_number() over (partition by src order by sim desc, dst) rn from (select a.vec_id src, b.vec_id dst, {_COS} sim from embeddings a join embeddings b on a.vec_id<>b.vec_id where a.vec_id%50=0)) where rn<=10",
    "knn_edges": f"with {_ADJ} select src, dst, round(sim,6) sim from adj",
    "degrees": f"with {_ADJ} select src, round(degree,6) degree, links from dg",
    "pagerank": f"with recursive {_ADJ}, {_walk(f'select vec_id seed, vec_id node, 1.0::double s from embeddings where vec_id%{EVERY}=0')} select seed seed_id, node, round(r,6) score from pr where i=30",
    "similar": f"""with recursive {_ADJ}, {_NEAR}, {_walk('select seed, node, sim/sum(sim) over (partition by seed) s from dr')}, sc as (select pr.seed, pr.node, nr.sim, pr.r, dr.node is not null direct from pr join nr on nr.seed=pr.seed and nr.node=pr.node left join dr on dr.seed=pr.seed and dr.node=pr.node where i=30 and pr.r>0 and pr.node<>pr.seed),
      tp as (select *, row_number() over (partition by seed, direct order by r desc, node) rn from sc), vi as (select dr.seed, adj.dst node, max_by(dr.node,(adj.sim*dr.sim,dr.node)) via from dr join adj on adj.src=dr.node group by 1,2)
      select tp.seed seed_id, tp.node, round(sim,3) similarity, round(r,6) score, direct, case when not direct then via end via from tp left join vi on vi.seed=tp.seed and vi.node=tp.node where tp.rn<=5""",
    "related": f"""with {_ADJ}, o as (select dst node, src via, sim from adj where src<20 and dst>=20 and dst%7<>0) select node, round(sim,3) sim, via from (select node, max(sim) sim, min_by(via,(-sim,via)) via from o group by 1 order by sim desc, node limit 12)""",
    "neighbourhood": f"""with {_ADJ}, fr as (select dst node, max(sim) w from adj where src<5 and dst>=5 group by 1 order by w desc, node desc limit 35), nd as (select vec_id node, 1.0::double value from embeddings where vec_id<5 union all select node, 0.0 from fr)
      select node a, null::bigint b, value from nd union all select src, dst, round(sim,3) from adj where src<dst and src in (select node from nd) and dst in (select node from nd)""",
}
