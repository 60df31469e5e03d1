"""Problem 4: the most similar vectors of every vector, as edges of a similarity graph.

Vectors are grouped into shards, every usable vector is indexed in one of them, and each shard holds a robust-pruned
directed graph: greedy beam searches over the graph built so far propose neighbours, relaxed distance pruning
(``ALPHA``) keeps diverse edges, reverse edges are added and pruned again. Each vector is then a query: its beam
searches run in its own shard and in every further shard that is almost as near. Searches of a shard advance together,
one array operation per step. The candidates found are scored exactly (double precision, stored values) before the best
are kept.

Shards come from at most ``FIRST`` centroids. More of them would scatter small groups of similar vectors, as centroids
of whole shards can't tell which of many such a group belongs to. A shard that is still too large is divided into unions
of cells, clusters of a few groups each: a vector belongs to the part of its nearest cell.

Copies of a vector are one point of the index; its ``k + 1`` smallest ids stand for it, which is all that copies can
contribute to anyone's list. A shard of more than ``PARTS`` times ``SHARD`` points is divided by cells of its own, fitted
on a bounded sample of it, and searched as the shards are; so the number of shards grows with the vectors while a task
holds the cells of one level and shard only. What is larger than ``SHARD`` then is split by hash and its queries visit
every part. A task holds one part and at most ``QUERIES`` expected queries.

Defined results: NULL vectors and vectors of another length, with a NULL, NaN or infinite element, or all zero
take no part; vectors of different models never meet; ties go to the smaller id; repeated rows of one id count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small

DIM = 384
K, FLOOR = 8, 0.6
#: Points of a shard aimed at, and the most that one graph holds.
TARGET, SHARD = 2500, 5000
#: Queries that one task answers; more of them get the part's graph built again in another task.
QUERIES = 30_000
#: Rows that a model's centroids, and the cells of a divided shard, are fitted on at most; for cells half of the rows will do, but LEAST of them.
SAMPLE, DIVIDED_SAMPLE, LEAST = 20_000, 60_000, 5_000
#: Sampled rows of a cell, and the points that it stands for at least.
CELL, CELL_POINTS = 10, 24
#: Most shards that a model is first divided into.
FIRST = 16
#: Parts of a shard up to which visiting all of them costs less than dividing it.
PARTS = 4
#: Rows of a shard that one task divides.
DIVIDED = 200_000
#: Similarity to a cell below the nearest at which a further shard is still searched, the most of them, and the cells looked at.
NEAR, PROBES, LOOKED = 0.10, 3, 8
DEGREE, BEAM, ALPHA = 24, 40, 1.2
SEED = 7


class Graph:
    """A robust-pruned directed graph over unit vectors, built and searched in lockstep."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> None:
        self.x, self.n, self.degree, self.beam, self.alpha = x, len(x), degree, beam, alpha
        self.out = np.full((self.n, degree), -1, dtype=np.int32)
        mean = x.mean(axis=0)
        self.entry = int(np.argmax(x @ mean))
        self.build()

    def build(self) -> None:
        rng = np.random.default_rng(SEED)
        order = rng.permutation(self.n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        done, size = 1, 1
        while done < self.n:
            size = min(max(2 * size, 16), 512, done * 2)
            batch = order[done : done + size]
            ids, _ = self.search(self.x[batch], max(16, self.beam // 2))
            self.insert(batch, ids)
            done += len(batch)

    def insert(self, points: np.ndarray, found: np.ndarray) -> None:
        """Edges of points to pruned candidates, and back."""
        own = self.out[points]
        cand = np.concatenate([found, own], axis=1)
        cand = np.where(cand == points[:, None], -1, cand)
        self.out[points] = self.prune(points, cand)
        src = np.repeat(points, self.degree)
        dst = self.out[points].ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, start, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(count.max()) if len(count) else 0
        if not width:
            return
        extra = np.full((len(targets), width), -1, dtype=np.int32)
        extra[np.repeat(np.arange(len(targets)), count), np.arange(len(dst)) - np.repeat(start, count)] = src
        lists = np.concatenate([self.out[targets], extra], axis=1)
        full = np.sum(lists >= 0, axis=1) > self.degree
        if (~full).any():  # room left: pack
            few = np.sort(lists[~full], axis=1)[:, ::-1]
            dup = np.zeros(few.shape, dtype=bool)
            dup[:, 1:] = few[:, 1:] == few[:, :-1]
            few = np.sort(np.where(dup, -1, few), axis=1)[:, ::-1]
            if few.shape[1] < self.degree:
                few = np.pad(few, ((0, 0), (0, self.degree - few.shape[1])), constant_values=-1)
            self.out[targets[~full]] = few[:, : self.degree]
        for at in range(0, int(full.sum()), 512):
            some = np.flatnonzero(full)[at : at + 512]
            self.out[targets[some]] = self.prune(targets[some], lists[some])

    def prune(self, points: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Relaxed pruning: take the nearest candidate, drop those that it covers, repeat."""
        b = len(points)
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        sim = np.matmul(self.x[cand], self.x[points][:, :, None])[:, :, 0]
        sim[cand < 0] = -2
        width = min(cand.shape[1], 3 * self.degree)
        top = np.argsort(-sim, axis=1)[:, :width]
        cand, sim = np.take_along_axis(cand, top, 1), np.take_along_axis(sim, top, 1)
        alive = cand >= 0
        v = self.x[cand]
        between = np.matmul(v, v.transpose(0, 2, 1))
        dist, inner = 1 - sim, (1 - between) * self.alpha
        out = np.full((b, self.degree), -1, dtype=np.int32)
        rows = np.arange(b)
        for r in range(self.degree):
            at = np.argmax(alive, axis=1)
            any_left = alive[rows, at]
            if not any_left.any():
                break
            out[:, r] = np.where(any_left, cand[rows, at], -1)
            alive &= inner[rows, at] > dist
            alive[rows, at] = False
        return out

    def search(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the beam of each query, best first, -1 where there are fewer."""
        b = len(q)
        rows = np.arange(b)
        ids = np.full((b, beam), -1, dtype=np.int32)
        sim = np.full((b, beam), -2, dtype=np.float32)
        todo = np.zeros((b, beam), dtype=bool)
        ids[:, 0], sim[:, 0], todo[:, 0] = self.entry, q @ self.x[self.entry], True
        table = q @ self.x.T  # of a part's few thousand points: cheaper than gathering the vectors of each step
        seen = np.zeros((b, self.n + 1), dtype=bool)
        seen[:, self.entry] = seen[:, self.n] = True
        active = rows
        while len(active):
            a_todo = todo[active]
            rank = np.cumsum(a_todo, axis=1)
            pick = a_todo & (rank <= width)
            r, c = np.nonzero(pick)
            nodes = ids[active[r], c]
            todo[active[r], c] = False
            slot = rank[r, c] - 1
            near = np.full((len(active), width, self.degree), self.n, dtype=np.int32)
            got = self.out[nodes]
            near[r, slot] = np.where(got < 0, self.n, got)
            near = near.reshape(len(active), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = self.n
            fresh = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            # only fresh neighbours are scored
            fr, fc = np.nonzero(fresh)
            s = np.full(near.shape, -2, dtype=np.float32)
            if len(fr):
                s[fr, fc] = table[active[fr], near[fr, fc]]
            all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
            all_sim = np.concatenate([sim[active], s], axis=1)
            all_todo = np.concatenate([todo[active], fresh], axis=1)
            top = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(all_sim, top, 1), axis=1), 1)
            ids[active] = np.take_along_axis(all_ids, top, 1)
            sim[active] = np.take_along_axis(all_sim, top, 1)
            todo[active] = np.take_along_axis(all_todo, top, 1) & (ids[active] >= 0)
            active = active[todo[active].any(axis=1)]
        return ids, sim


def usable(vecs: DataFrame) -> DataFrame:
    """(vec_id, model, vec): one row per id with DIM finite elements that are not all zero."""
    ok = (
        F.col("vec_id").isNotNull() & F.col("model").isNotNull() & (F.size("vec") == DIM)
        & ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vec", lambda x: x != 0)
    )
    return vecs.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("model").cast("string").alias("model"), F.col("vec").cast("array<float>").alias("vec"))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, dtype=np.float32)
    for a in range(0, len(x), 4096):
        d = x[a : a + 4096].astype(np.float64)
        scale = np.abs(d).max(axis=1, keepdims=True)
        d /= np.where(scale > 0, scale, 1)
        out[a : a + 4096] = d / np.linalg.norm(d, axis=1, keepdims=True)
    return out


def _home(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[a : a + 4096] @ c.T, axis=1) for a in range(0, len(x), 4096)])


def centroids(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k unit centroids of unit vectors, by rounds of k-means on the sphere."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _home(x, c)
        order = np.argsort(near, kind="stable")
        used, start = np.unique(near[order], return_index=True)
        total = np.add.reduceat(x[order], start, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = x[rng.choice(len(x), k)]  # of those that nothing is near to
        c[used] = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), c[used])
    return c.astype(np.float32)


def _packed(c: np.ndarray, weight: np.ndarray, parts: int) -> np.ndarray:
    """The part of each cell: parts of about equal weight, by halving along the direction in which the cells differ most."""
    out, made = np.zeros(len(c), dtype=np.int32), 0
    todo = [(np.arange(len(c)), parts)]
    while todo:
        at, n = todo.pop()
        if n <= 1 or len(at) < 2:
            out[at] = made
            made += 1
            continue
        x, w = c[at].astype(np.float64), weight[at]
        y = x - np.average(x, axis=0, weights=w)
        v = y[np.argmax(np.einsum("ij,ij->i", y, y))]
        for _ in range(6):
            v = y.T @ (w * (y @ v))
            v /= max(np.linalg.norm(v), 1e-30)
        order = np.argsort(y @ v, kind="stable")
        total = np.cumsum(w[order])
        cut = int(np.clip(np.searchsorted(total, total[-1] * (n // 2) / n) + 1, 1, len(at) - 1))
        todo += [(at[order[:cut]], n // 2), (at[order[cut:]], n - n // 2)]
    return out


def cells(x: np.ndarray, points: int, target: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroid, shard) of every cell of the sampled unit vectors x, which stand for ``points``; ``target`` of these make a shard."""
    parts = -(-points // target)
    k = max(1, len(x) // 8) if parts > len(x) // CELL else max(parts, min(len(x) // CELL, points // CELL_POINTS))
    c = centroids(x, k, rng, 4)
    return c, _packed(c, np.bincount(_home(x, c), minlength=len(c)) + 0.1, parts)


def _rows_to_fit(n: Column, sample: int) -> Column:
    return F.least(F.lit(0.9 * sample), F.greatest(F.lit(float(LEAST)), n / 2))


def _sampled(share: Column) -> Column:
    return F.pmod(F.xxhash64("point", F.lit(SEED)), F.lit(1_000_000)) < 1_000_000 * F.least(F.lit(1.0), share)


def fit_centroids(points: DataFrame, sizes: dict[str, int], target: int = TARGET, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Unit centroids of each model that needs more than one shard, from at most ``sample`` of its rows."""
    fitted = {}
    rng = np.random.default_rng(SEED)
    for model, n in sorted(sizes.items()):
        if n <= SHARD:
            continue
        rows = points.where((F.col("model") == model) & _sampled(F.lit(0.9 * sample / n))).select("point", "vec").limit(sample)
        got = rows.toArrow().sort_by("point")  # at most ``sample`` rows, in an order of their own
        x = _unit(_matrix(got["vec"]))
        fitted[model] = centroids(x, min(FIRST, -(-n // target), max(1, len(x) // 8)), rng)
    return fitted


def _nearest_shards(x: np.ndarray, c: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, is the nearest) of the shards that each vector is searched in; c: the cells and shard, that of each."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    m = min(LOOKED, len(c))
    for a in range(0, len(x), 4096):
        s = x[a : a + 4096] @ c.T
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1), 1)
        v, own = np.take_along_axis(s, top, 1), shard[top]
        new = v >= v[:, :1] - NEAR
        for j in range(1, m):  # each shard once, by its nearest cell
            new[:, j] &= (own[:, :j] != own[:, j : j + 1]).all(axis=1)
        new &= np.cumsum(new, axis=1) <= PROBES
        r, j = np.nonzero(new)
        out.append((r + a, own[r, j].astype(np.int32), j == 0))
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), np.empty(0, dtype=bool))


def _assign(points: DataFrame, fitted: dict[str, np.ndarray], counted: bool = False) -> DataFrame:
    """(model, point, vec, shard, home): the shard of each point, and the further ones it is searched in; counted: without
    point and vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            models = np.array(b.column("model").to_pylist(), dtype=object)
            take, shard, home = [], [], []
            x = _unit(_matrix(b.column("vec"))) if fitted and len(models) else None
            for model in set(models.tolist()):
                at = np.flatnonzero(models == model)
                c = fitted.get(model)
                r, own, first = (np.arange(len(at)), np.zeros(len(at), dtype=np.int32), np.ones(len(at), dtype=bool)) if c is None else _nearest_shards(x[at], c, np.arange(len(c)))
                take.append(at[r])
                shard.append(own)
                home.append(first)
            if not take:
                continue
            idx = pa.array(np.concatenate(take))
            arrays = [*(b.column(c).take(idx) for c in kept), pa.array(np.concatenate(shard), pa.int32()), pa.array(np.concatenate(home))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "shard", "home"])

    kept = ["model"] if counted else ["model", "point", "vec"]
    return points.select("model", "point", "vec").mapInArrow(run, ", ".join(["model string", *([] if counted else ["point long", "vec array<float>"]), "shard int, home boolean"]))


def _divide(rows: DataFrame, large: DataFrame, target: int = TARGET, sample: int = DIVIDED_SAMPLE) -> DataFrame:
    """rows (model, point, vec, shard, home) of the shards of large (model, shard, points, rows) with sub, their part of the shard.

    A shard's cells, each with the part that it belongs to, come first in the stream of the rows of each task that divides it.
    """
    keys = ["model", "shard"]
    picked = rows.where("home").join(F.broadcast(large.select(*keys, "points")), keys).where(_sampled(_rows_to_fit(F.col("points"), sample) / F.col("points")))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by("point").slice(0, sample)
        x = _unit(_matrix(t["vec"]))
        c, sub = cells(x, t["points"][0].as_py(), target, np.random.default_rng(SEED))
        return pa.table({"model": [t["model"][0].as_py()] * len(c), "shard": pa.array([t["shard"][0].as_py()] * len(c), pa.int32()), "sub": pa.array(sub, pa.int32()), "vec": pa.array(list(c), pa.list_(pa.float32()))})

    own = materialize(picked.groupBy(*keys).applyInArrow(fit, "model string, shard int, sub int, vec array<float>"), "cells")
    turns = F.broadcast(large.select(*keys, F.ceil(F.col("rows") / DIVIDED).cast("int").alias("turns")))
    heads = own.join(turns, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(None).cast("long").alias("point"), "vec", F.lit(True).alias("home"), "sub")
    body = rows.join(turns, keys).select(*keys, F.pmod(F.xxhash64("point"), F.col("turns")).cast("int").alias("turn"), "point", "vec", "home", F.lit(None).cast("int").alias("sub"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gathered, told, c = None, [], [], None
        for b in batches:
            key = list(zip(b.column("model").to_pylist(), b.column("shard").to_pylist(), b.column("turn").to_pylist(), pc.is_null(b.column("point")).to_pylist()))
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part, x = b.slice(lo, hi - lo), _matrix(b.column("vec").slice(lo, hi - lo))
                if key[lo][3]:
                    if at != key[lo][:3] or c is not None:
                        gathered, told = [], []
                    gathered.append(x)
                    told.append(part.column("sub").to_numpy())
                    at, c = key[lo][:3], None
                    continue
                c = (np.concatenate(gathered), np.concatenate(told)) if c is None else c
                r, sub, first = _nearest_shards(_unit(x), *c)
                idx = pa.array(r)
                home = np.array(part.column("home").to_pylist(), dtype=bool)[r] & first
                yield pa.RecordBatch.from_arrays([*(part.column(n).take(idx) for n in ("model", "point", "vec", "shard")), pa.array(home), pa.array(sub, pa.int32())], names=["model", "point", "vec", "shard", "home", "sub"])

    stream = heads.unionByName(body).repartition(*keys, "turn").sortWithinPartitions(*keys, "turn", F.asc_nulls_first("point"), "sub")
    return stream.mapInArrow(run, "model string, point long, vec array<float>, shard int, home boolean, sub int")


def _search_part(table: pa.Table) -> pa.Table:
    """(query, other, cosine): of every asking row of one part, its best points of that part. Cosines are exact."""
    home = np.array(table["home"].to_pylist(), dtype=bool)
    ask = np.array(table["ask"].to_pylist(), dtype=bool)
    ids = table["point"].to_numpy()
    raw = _matrix(table["vec"])
    schema = pa.schema([("query", pa.int64()), ("other", pa.int64()), ("cosine", pa.float64())])
    order = np.lexsort((ids, ~home))  # the indexed points come first, in an order that no shuffle changes
    ids, raw, ask, n = ids[order], raw[order], ask[order], int(home.sum())
    x = _unit(raw)
    if n == 0:
        return schema.empty_table()
    graph = Graph(x[:n])
    q_out, o_out, c_out = [], [], []
    norm = np.linalg.norm(raw.astype(np.float64), axis=1)
    asking = np.flatnonzero(ask)
    for a in range(0, len(asking), 512):
        batch = asking[a : a + 512]
        found, sim = graph.search(x[batch], max(BEAM, 4 * K))
        r, j = np.nonzero((found >= 0) & (sim >= FLOOR - 1e-3))
        other = found[r, j]
        keep = ids[other] != ids[batch[r]]
        r, other = batch[r[keep]], other[keep]
        cos = np.einsum("ij,ij->i", raw[r].astype(np.float64), raw[other].astype(np.float64)) / (norm[r] * norm[other])
        q_out.append(ids[r])
        o_out.append(ids[other])
        c_out.append(cos)
    return pa.table([np.concatenate(q_out), np.concatenate(o_out), np.concatenate(c_out)], schema=schema)


def similar(vecs: DataFrame, k: int = K, floor: float = FLOOR) -> DataFrame:
    """(vec_id, other_id, cosine, rank): of every vector its up to k most similar ones of the same model."""
    clean = usable(vecs)
    # one point per distinct vector: its smallest k + 1 ids stand for all copies
    hashed = clean.withColumn("h", F.concat_ws("-", F.xxhash64("vec"), F.xxhash64(F.lit(SEED), "vec")))
    ids = materialize(hashed.select("vec_id", "model", "h").dropDuplicates(["vec_id"]), "ids")
    first = ids.groupBy("model", "h").agg(F.min("vec_id").alias("point"))
    points = materialize(hashed.drop("h").join(first.select(F.col("point").alias("vec_id")), "vec_id", "left_semi").dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "point"), "points")
    sizes = {r["model"]: r["count"] for r in points.groupBy("model").count().where(F.col("count") > SHARD).collect()}  # models of many vectors
    fitted = fit_centroids(points, sizes)
    assigned = _assign(points, fitted)
    placed = assigned.withColumn("sub", F.lit(0))
    keys = ["model", "shard", "sub"]
    if sizes:
        count = F.count_if("home").alias("points"), F.count("*").alias("rows")
        counts = materialize(_assign(points, fitted, counted=True).groupBy("model", "shard").agg(*count), "counts")  # a row for TARGET points
        large = counts.where(F.col("points") > PARTS * SHARD)
        counts = counts.withColumn("sub", F.lit(0))
        if not large.isEmpty():
            # a division's rows are counted and searched: written once
            divided = materialize(_divide(assigned, large), "divided")
            placed = placed.join(small(large.select("model", "shard")), ["model", "shard"], "left_anti").unionByName(divided)
            counts = counts.where(F.col("points") <= PARTS * SHARD).unionByName(divided.groupBy(*keys).agg(*count))
        over = materialize(counts.where((F.col("points") > SHARD) | (F.col("rows") > QUERIES)), "over")
        if not over.isEmpty():
            plan = small(over.select(*keys, F.greatest(F.lit(1), F.ceil(F.col("points") / SHARD)).cast("int").alias("parts"), F.greatest(F.lit(1), F.ceil(F.col("rows") / QUERIES)).cast("int").alias("chunks")))
            placed = placed.join(plan, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("chunks", F.coalesce("chunks", F.lit(1)))
            mine, turn = F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"), F.pmod(F.xxhash64("point", F.lit(1)), F.col("chunks")).cast("int")
            placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("home", F.col("home") & (F.col("part") == mine))
            placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("ask", F.col("chunk") == turn)
            placed = placed.where(F.col("home") | F.col("ask")).drop("parts", "chunks")
    if "part" not in placed.columns:
        placed = placed.withColumns({"part": F.lit(0), "chunk": F.lit(0), "ask": F.lit(True)})
    hits = placed.groupBy(*keys, "part", "chunk").applyInArrow(_search_part, "query long, other long, cosine double")
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "other")
    hits = hits.withColumn("cosine", F.round("cosine", 6)).where(F.col("cosine") >= floor).dropDuplicates(["query", "other"])
    hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
    return _with_copies(hits, ids, k)


def _with_copies(hits: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Lists of points turned into lists of all their ids; copies of a vector are neighbours of cosine 1."""
    low = ids.withColumn("r", F.row_number().over(Window.partitionBy("model", "h").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    low = low.groupBy("model", "h").agg(F.array_sort(F.collect_list("vec_id")).alias("low"))  # at most k + 1 ids
    low = low.select("model", "h", "low", F.element_at("low", 1).alias("point"))
    copies = low.where(F.size("low") > 1).select("point", F.explode(F.transform("low", lambda i: F.struct(F.lit(1.0).alias("cosine"), i.alias("vec_id")))).alias("c"))
    # candidates of each point: the low ids of its neighbours and of itself
    near = hits.join(low.select(F.col("point").alias("other"), F.col("low")), "other").select(F.col("query").alias("point"), F.explode(F.transform("low", lambda i: F.struct(F.col("cosine"), i.alias("vec_id")))).alias("c"))
    lists = near.unionByName(copies).groupBy("point").agg(F.collect_list("c").alias("cs"))  # at most (k + 1) * (k + 1)
    ordered = F.slice(F.array_sort(F.transform("cs", lambda c: F.struct((-c["cosine"]).alias("n"), c["vec_id"].alias("vec_id")))), 1, k + 1)
    lists = lists.join(low.select("point", "model", "h"), "point").select("model", "h", ordered.alias("best"))
    own = ids.join(lists, ["model", "h"])
    mine = F.slice(F.filter("best", lambda c: c["vec_id"] != F.col("vec_id")), 1, k)
    return own.select("vec_id", F.posexplode(mine).alias("p", "c")).select("vec_id", F.col("c.vec_id").alias("other_id"), (-F.col("c.n")).alias("cosine"), (F.col("p") + 1).alias("rank"))


def found(vecs: DataFrame) -> DataFrame:
    """(vec_id_a, vec_id_b): the edges of the similarity graph."""
    s = similar(vecs)
    return s.select(F.least("vec_id", "other_id").alias("vec_id_a"), F.greatest("vec_id", "other_id").alias("vec_id_b")).distinct()
