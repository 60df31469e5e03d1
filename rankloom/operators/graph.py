"""The similarity graph: neighbours in blocks, PageRank with restart, neighbourhoods."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, materialize

K, FLOOR, RESTART, ITERATIONS = 8, 0.6, 0.4, 30
BLOCK = 4096
#: Similarities are equal to so many digits; what a block's products may differ by for copies of one vector.
DIGITS, TIE = 12, 1e-11


def nearest(queries: DataFrame, base: DataFrame, k: int | None = K, floor: float = FLOOR, block: int = BLOCK) -> DataFrame:
    """(src, dst, sim): of each query (id, vec) the k most similar rows of base (id, vec), itself excluded; all without k.

    Exact, so the work is the product of both sides: for a query set against all rows, or a base of some 100,000. Blocks of queries meet blocks of base one pair per task as matrix products; only each pair's k best leave it. Ties
    go to the smaller id in every block, whatever the number of copies.
    """
    nq = max(1, -(-queries.count() // block))
    nb = max(1, -(-base.count() // block))
    q = queries.select("id", "vec", F.lit(True).alias("asks"), F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("bb"))
    b = base.select("id", "vec", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int").alias("bb"))

    def match(t: pa.Table) -> pa.Table:
        asks = np.array(t["asks"].to_pylist(), dtype=bool)
        ids = t["id"].to_numpy()
        x = np.array(t["vec"].to_pylist(), dtype=np.float64)
        out = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("sim", pa.float64())])
        if not asks.any() or asks.all():
            return out.empty_table()
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        bid, bx = ids[~asks], x[~asks]
        src, dst, sim = [], [], []
        for a in range(0, int(asks.sum()), 512):
            qid, qx = ids[asks][a : a + 512], x[asks][a : a + 512]
            s = qx @ bx.T
            s[qid[:, None] == bid[None, :]] = -2
            s[s < floor] = -2
            m = s.shape[1] if k is None else min(k, s.shape[1])
            edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
            # copies may differ in the last bits of their products: all near the edge are candidates, by value, then id
            r, c = np.nonzero((s >= edge[:, None] - TIE) & (s > -2))
            value = np.round(s[r, c], DIGITS)
            order = np.lexsort((bid[c], -value, r))
            r, c, value = r[order], c[order], value[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < m
            src.append(qid[r[first]])
            dst.append(bid[c[first]])
            sim.append(value[first])
        return pa.table([np.concatenate(src), np.concatenate(dst), np.concatenate(sim)], schema=out)

    hits = q.unionByName(b).groupBy("qb", "bb").applyInArrow(match, "src long, dst long, sim double")
    if k is None:
        return hits
    best = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return hits.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, with the larger weight."""
    return edges.select("src", "dst", "sim").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim")).groupBy("src", "dst").agg(F.max("sim").alias("sim"))


def degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy("src").agg(F.sum("sim").alias("degree"), F.count("*").alias("links"))


def pagerank(adj: DataFrame, seeds: DataFrame, restart: float = RESTART, iterations: int = ITERATIONS, every: int = 10, local: int = BROADCAST_ROWS) -> DataFrame:
    """(seed_id, node, score) of walks from seeds (seed_id, node, weight); walks that reach a dead end are lost.

    A graph of at most ``local`` edges, counted first, is sent to the tasks, each of which walks from whole seeds; the
    walks of a larger one are joins, written to the shared folder every so many steps.
    """
    walk = adj.join(degree(adj).select("src", "degree"), "src").select("src", "dst", (F.col("sim") / F.col("degree")).alias("p"))
    walk = materialize(walk, "walk")
    total = Window.partitionBy("seed_id")
    start = seeds.groupBy("seed_id", "node").agg(F.sum("weight").alias("w")).withColumn("s", F.col("w") / F.sum("w").over(total)).select("seed_id", "node", "s")
    start = materialize(start, "seed")
    if walk.count() <= local:
        return _walked(walk, start, restart, iterations)
    ranks = start.withColumnRenamed("s", "r")
    for i in range(iterations):
        step = ranks.join(walk, F.col("node") == F.col("src")).select("seed_id", F.col("dst").alias("node"), ((1 - restart) * F.col("r") * F.col("p")).alias("r"))
        ranks = step.unionByName(start.select("seed_id", "node", (restart * F.col("s")).alias("r"))).groupBy("seed_id", "node").agg(F.sum("r").alias("r"))
        if (i + 1) % every == 0:
            ranks = materialize(ranks, "ranks")
    return ranks.withColumnRenamed("r", "score")


def _walked(walk: DataFrame, start: DataFrame, restart: float, iterations: int) -> DataFrame:
    """The walks over edges that every task holds; a seed's own nodes may be others than those of the edges."""
    edges = walk.toArrow().sort_by([("src", "ascending"), ("dst", "ascending")])
    src, dst, p = (edges[c].to_numpy() for c in ("src", "dst", "p"))
    names = np.unique(np.concatenate([src, dst]))
    sent = start.sparkSession.sparkContext.broadcast((names, np.searchsorted(names, src), np.searchsorted(names, dst), p))
    kinds = dict(start.dtypes)

    def run(t: pa.Table) -> pa.Table:
        known, a, b, share = sent.value
        own, s = t["node"].to_numpy(), t["s"].to_numpy()
        lone = own[~np.isin(own, known)]
        nodes = np.concatenate([known, lone])
        order = np.argsort(nodes, kind="stable")
        at = order[np.searchsorted(nodes[order], own)]
        seed = np.zeros(len(nodes))
        seed[at] = s
        r = seed.copy()
        for _ in range(iterations):
            r = (1 - restart) * np.bincount(b, weights=r[a] * share, minlength=len(nodes)) + restart * seed
        here = r > 0
        here[at] = True
        return pa.table({"seed_id": pa.array([t["seed_id"][0].as_py()] * int(here.sum()), t.schema.field("seed_id").type), "node": pa.array(nodes[here], t.schema.field("node").type), "score": r[here]})

    return start.groupBy("seed_id").applyInArrow(run, f"seed_id {kinds['seed_id']}, node {kinds['node']}, score double")


def similar(adj: DataFrame, sims: DataFrame, n_direct: int = 5, n_graph: int = 5, k: int = K, floor: float = FLOOR) -> DataFrame:
    """(seed_id, node, similarity, score, direct, via) from sims (seed_id, node, sim) of every vertex at or above the floor.

    Direct results are among the k most similar; the others are reached by the walk from those and similar themselves.
    """
    near = sims.where((F.col("sim") >= floor) & (F.col("node") != F.col("seed_id")))
    best = Window.partitionBy("seed_id").orderBy(F.desc("sim"), "node")
    direct = materialize(near.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn"), "direct")
    rank = pagerank(adj, direct.select("seed_id", "node", F.col("sim").alias("weight"))).where((F.col("node") != F.col("seed_id")) & (F.col("score") > 0))
    scored = rank.join(near, ["seed_id", "node"]).join(direct.select("seed_id", "node", F.lit(True).alias("direct")), ["seed_id", "node"], "left").withColumn("direct", F.coalesce("direct", F.lit(False)))
    order = Window.partitionBy("seed_id", "direct").orderBy(F.desc("score"), "node")
    kept = scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= F.when(F.col("direct"), n_direct).otherwise(n_graph)).drop("rn")
    links = direct.select("seed_id", F.col("node").alias("src"), F.col("sim").alias("w")).join(adj, "src").groupBy("seed_id", F.col("dst").alias("node")).agg(
        F.max_by("src", F.struct(F.col("sim") * F.col("w"), "src")).alias("via")
    )
    out = kept.join(links, ["seed_id", "node"], "left")
    return out.select("seed_id", "node", F.round("sim", 3).alias("similarity"), "score", "direct", F.when(~F.col("direct"), F.col("via")).alias("via"))


def neighbourhood(adj: DataFrame, focus: DataFrame, limit: int = 250) -> tuple[DataFrame, DataFrame]:
    """(nodes, links): the focus nodes and their strongest neighbours, at most limit, with the edges among them."""
    f = focus.select("node").distinct().orderBy("node").limit(limit).withColumn("focus", F.lit(True))
    f = materialize(f, "focus")
    room = max(0, limit - f.count())
    around = adj.join(f.select(F.col("node").alias("src")), "src", "left_semi").join(f.select(F.col("node").alias("dst")), "dst", "left_anti")
    front = around.groupBy(F.col("dst").alias("node")).agg(F.max("sim").alias("w")).orderBy(F.desc("w"), F.desc("node")).limit(room)
    nodes = f.unionByName(front.select("node", F.lit(False).alias("focus")))
    nodes = materialize(nodes, "nodes")
    n = nodes.select("node")
    links = adj.where("src < dst").join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return nodes, links.select("src", "dst", F.round("sim", 3).alias("sim"))


def related(adj: DataFrame, focus: DataFrame, exclude: DataFrame, n: int = 12) -> DataFrame:
    """(node, sim, via): the n nodes outside focus and exclude with the strongest edge into focus (node, ord)."""
    f = focus.groupBy("node").agg(F.min("ord").alias("ord"))
    out = adj.join(f.select(F.col("node").alias("src"), "ord"), "src").join(f.select(F.col("node").alias("dst")), "dst", "left_anti").join(exclude.select(F.col("node").alias("dst")), "dst", "left_anti")
    best = out.groupBy(F.col("dst").alias("node")).agg(F.max("sim").alias("sim"), F.min_by("src", F.struct(-F.col("sim"), "ord")).alias("via"))
    return best.orderBy(F.desc("sim"), "node").limit(n)



def with_papers(base: DataFrame, extra: DataFrame, most: int = 300) -> DataFrame:
    """Vertices (id, vec) with those of extra that base lacks, the first ``most`` by id as one request may bring."""
    return base.select("id", "vec").unionByName(extra.join(base.select("id"), "id", "left_anti").dropDuplicates(["id"]).orderBy("id").limit(most).select("id", "vec"))


def signature(vertices: DataFrame, *settings: object) -> str:
    """What a graph of (id, vec) was built from: vertices, whatever their order, and settings."""
    n, h = vertices.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("id", "vec").cast("decimal(38,0)")), F.lit(0))).first()
    return "-".join(map(str, (n, h, *settings)))


def current(spark: SparkSession, path: str, signature: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored edges of this signature, built and stored if there are none yet."""
    at = f"{path}/sig={signature}"
    try:
        return spark.read.parquet(at)
    except AnalysisException:
        build().write.mode("overwrite").parquet(at)
        return spark.read.parquet(at)


def flags(nodes: DataFrame, ratings: DataFrame, shown: DataFrame) -> DataFrame:
    """nodes (key) with their rating, 0 for none, and whether they are on screen."""
    on = shown.select("key").distinct().withColumn("on_screen", F.lit(True))
    out = nodes.join(ratings.select("key", "rating"), "key", "left").join(on, "key", "left")
    return out.withColumns({"rating": F.coalesce("rating", F.lit(0)), "on_screen": F.coalesce("on_screen", F.lit(False))})
