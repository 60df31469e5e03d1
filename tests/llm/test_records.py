"""Problems 2, 4 and 5 against brute force and hand-made cases."""

from __future__ import annotations

import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from rankloom.llm import link, neighbours, survivor

# ---- 2 ----

P = "rec_id long, title string, authors array<string>, year int, venue string, doi string, arxiv_id string"
W = P.replace("rec_id", "work_id")
A = ["Ann Maria Stone", "Bo Lee-Hart", "Cid Novák"]
T = "BriFetik: Urban Curriculum Sampling for Dose Planning"


def pairs(spark, papers, works, groups=None):
    g = None if groups is None else spark.createDataFrame(groups, "group_id long, rec_id long")
    return {tuple(r) for r in link.found(spark.createDataFrame(papers, P), spark.createDataFrame(works, W), g).collect()}


def test_spellings_of_one_paper(spark):
    papers = [(1, T, A, 2022, "", "10.5555/abc.2022.1", ""), (2, T.upper(), A[:1], None, "", "", "2203.02499v2"), (3, "Other Things of Robots", ["Dee Poe"], 2020, "", "", "")]
    works = [
        (11, "Brifetik: urban curriculum sampling for dose plan- ning (Extended Abstract)", ["Stone, A. M.", "Lee-Hart, B.", "Novak, C."], 2022, "", "", ""), (12, "BriFetik: Urban Curriculum Smapling in Dose Planning", ["STONE, Ann; LEE-HART, Bo; NOVÁK, Cid"], 2023, "", None, None),
        (13, "BriFetik: Urban Curriculum Sampl…", ["A. Stone", "et al."], 2022, "", "", ""), (14, "\\emph{BriFetik}: Urban {Curriculum} Sampling for Dose Planning [Preprint]", [], 2022, "", "", ""), (15, "BriFetik", ["Ann Stone", "Bo Lee-Hart"], 2022, "", "https://doi.org/10.5555/ABC.2022.1", ""),
        (16, "BriFetik: Curriculum Sampling for Dose Planning", ["Bo Lee-Hart", "Ann Stone", "Cid Novak"], None, "", "", ""), (17, T, A, 2022, "", "", "arXiv:2203.02499"),
    ]
    got = pairs(spark, papers, works, [(5, 1), (5, 2)])
    assert got == {(r, w) for r in (1, 2) for w in range(11, 18)}


def test_other_papers_of_the_same_people(spark):
    papers = [(1, T, A, 2012, "", "10.5555/proc.2012.1", "")]
    works = [
        (11, T + " at Scale", A, 2022, "", "", ""), (12, "Comment on " + T, ["Eve Ray"], 2013, "", "", ""), (13, "Erratum to: " + T, A, 2014, "", "", ""), (14, T + ", Part 2: Theory", A, 2019, "", "", ""), (15, "A Reproducibility Study of " + T, ["Eve Ray"], 2012, "", "", ""),
        (16, T.replace("Dose Planning", "Code Search"), A, 2012, "", "", ""), (17, T, ["Eve Ray", "Flo Kim"], 2012, "", "", ""), (18, "A Survey of Glaciers", ["Eve Ray"], 2012, "", "10.5555/proc.2012.1", ""), (19, None, None, None, None, None, None), (20, "", [], 2012, "", "", ""),
    ]
    assert pairs(spark, papers, works) == set()


def test_shared_identifiers_copies_and_confidence(spark):
    papers = [(i, f"Name{i}xyz: Methods of Kind {i} for Topic {i}", [f"First Sur{i}x"], 2020, "", "10.5555/proc.2020.1", "") for i in range(30)] + [(100 + i, T, A, 2022, "", "", "2203.02499") for i in range(40)]
    works = [(1000 + i, p[1], p[2], 2020, "", "10.5555/proc.2020.1", "") for i, p in enumerate(papers[:30])] + [(2000 + i, T, A, 2022, "", "", "") for i in range(3)] + [(2000, T, A, 2022, "", "", "")]
    out = link.link(spark.createDataFrame(papers, P), spark.createDataFrame(works, W)).collect()
    assert {(r["rec_id"], r["work_id"]) for r in out} == {(i, 1000 + i) for i in range(30)} | {(100 + i, 2000 + j) for i in range(40) for j in range(3)} and len(out) == 150
    assert all(0 < r["confidence"] < 1 for r in out)


def test_no_records(spark):
    p = [(1, T, A, 2022, "", "", "")]
    none = spark.createDataFrame([], W)
    assert link.found(spark.createDataFrame(p, P), none).count() == 0 and link.found(spark.createDataFrame([], P), spark.createDataFrame(p, W)).count() == 0


def test_surnames():
    assert link.surnames(["Stone, A. M.", "Lee-Hart B.", "Cid Novák", "et al.", None, "A. Poe; B. Ray", " "]) == ["stone", "leehart", "novak", "poe", "ray"]
    assert link.surnames(None) == [] and link.surnames(["Plato"]) == ["plato"]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [("sheaf diffusion robots", "shelf diffusion robots", True), ("neural operators learning code", "operators learning code", False), ("a neural operators learning code", "a operators learning code", True), ("sparse bayesian filters learning code", "bayyesian filters learning code", True), ("erratum bayesian filters learning code", "bayesian filters learning code", False), ("x yy zzz", "x yy", False), ("graph nets deep", "graphnets deep", True)],
)
def test_title_relation(a, b, same):
    assert (link.title_relation(a.split(), b.split(), False, False) >= 0.8) is same


# ---- 4 ----


def truth(rows):
    edges = set()
    for m in {r[1] for r in rows}:
        seen = {r[0]: np.array(r[2], dtype=np.float64) for r in rows if r[1] == m and r[2] and len(r[2]) == 384 and np.isfinite(r[2]).all() and any(r[2])}
        ids = sorted(seen)
        x = np.array([seen[i] for i in ids])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(x @ x.T, 6)
        for i, a in enumerate(ids):
            best = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= 0.6)[:8]
            edges |= {(min(a, b), max(a, b)) for _, b in best}
    return edges


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(25, 384))
    x = [(centres[rng.integers(25)] + rng.uniform(0.3, 1.2) * rng.normal(size=384)) * rng.uniform(0.5, 4) for _ in range(900)]
    rows = [(i, "a" if i % 9 else "b", [float(np.float32(v)) for v in x[i]]) for i in range(900)]
    rows += [(2000 + i, "a", rows[1][2]) for i in range(30)]  # copies
    bad = rows[5][2]
    return rows + [(3001, "a", None), (3002, "a", bad[:300]), (3003, "a", [0.0] * 384), (3004, "a", [float("nan"), *bad[1:]]), (3005, "a", [float("inf"), *bad[1:]]), (1, "a", rows[1][2])]


def recall(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, model string, vec array<float>")
    got = [tuple(r) for r in neighbours.found(df).collect()]
    want = truth(rows)
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return len(set(got) & want) / len(want), len(set(got) & want) / max(1, len(got))


def test_neighbours(spark, vectors):
    r, p = recall(spark, vectors)
    assert r >= 0.97 and p >= 0.97


@pytest.mark.parametrize(("target", "shard", "queries"), [(120, 150, 30_000), (100_000, 200, 300)])
def test_neighbours_in_shards(spark, vectors, monkeypatch, target, shard, queries):
    monkeypatch.setattr(neighbours, "SHARD", shard)
    monkeypatch.setattr(neighbours, "QUERIES", queries)
    monkeypatch.setattr(neighbours.fit_centroids, "__defaults__", (target, 5_000))
    r, p = recall(spark, vectors)
    assert r >= 0.9 and p >= 0.9


@pytest.mark.parametrize("divided", [100, 100_000])
def test_neighbours_in_divided_shards(spark, vectors, monkeypatch, divided):
    """More shards than the first sample has centroids for: the large ones are divided, by one task or several."""
    monkeypatch.setattr(neighbours, "SHARD", 120)
    monkeypatch.setattr(neighbours, "DIVIDED", divided)
    monkeypatch.setattr(neighbours, "PARTS", 1)
    monkeypatch.setattr(neighbours.fit_centroids, "__defaults__", (100, 40))
    monkeypatch.setattr(neighbours._divide, "__defaults__", (60, 200))
    seen = []
    monkeypatch.setattr(neighbours, "_divide", lambda *a, divide=neighbours._divide: seen.append(1) or divide(*a))
    r, p = recall(spark, vectors)
    assert seen and r >= 0.9 and p >= 0.9


def test_small_groups_stay_together_in_many_shards(spark, monkeypatch, tmp_path):
    """Small groups of similar vectors amid many less alike are searched together, however many shards there are."""
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    topic, n = unit(rng.normal(size=384)), 16_000
    x = np.concatenate([unit(0.5 * topic + 0.62 * unit(rng.normal(size=384)) + 0.6 * unit(rng.normal(size=(16, 384)))) for _ in range(n // 16)]).astype(np.float32)
    pq.write_table(pa.table({"point": range(n), "model": ["a"] * n, "vec": list(x)}), tmp_path / "points.parquet")
    points = spark.read.parquet(str(tmp_path / "points.parquet"))
    monkeypatch.setattr(neighbours, "FIRST", 1, raising=False)
    rows = neighbours._assign(points, neighbours.fit_centroids(points, {"a": n}, 800, 8_000))
    if rows.select("shard").distinct().count() == 1:
        rows = neighbours._divide(rows, spark.createDataFrame([("a", 0, n, n)], "model string, shard int, points long, rows long"), 800, 8_000).drop("shard").withColumnRenamed("sub", "shard")
    got = rows.select("point", "shard", "home").collect()
    home = {r["point"]: r["shard"] for r in got if r["home"]}
    visits = {(r["point"], r["shard"]) for r in got}
    met = [(i, home[j]) in visits for i in range(n) for j in range(i // 16 * 16, i // 16 * 16 + 16) if j != i]
    assert len(set(home.values())) >= 20 and np.mean(met) >= 0.93


def test_copies_are_neighbours_of_smallest_ids(spark):
    v = [1.0] * 384
    rows = [(i, "a", v) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, model string, vec array<float>")
    assert {tuple(r) for r in neighbours.found(df).collect()} == truth(rows)
    assert neighbours.found(df.where("false")).count() == 0


def test_graph_is_directed_pruned_and_reaches_all():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = neighbours.Graph(x)
    assert ((g.out >= 0).sum(axis=1) <= neighbours.DEGREE).all() and not (g.out == np.arange(700)[:, None]).any()
    seen, todo = {g.entry}, [g.entry]
    while todo:
        todo = [int(j) for i in todo for j in g.out[i] if j >= 0 and j not in seen and not seen.add(int(j))]
    assert len(seen) >= 0.99 * 700


# ---- 5 ----


def peeled(triples):
    """Dominance layers by taking away what nothing dominates, again and again."""
    left, out, n = set(triples), {}, 0
    while left:
        n += 1
        top = {a for a in left if not any(b != a and all(y >= x for x, y in zip(a, b)) for b in left)}
        out |= {a: n for a in top}
        left -= top
    return out


def test_layers_equal_peeling(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(8)) if rng.random() < 0.6 else 0, *(int(x) for x in rng.integers(0, (5, 40, 3)))) for _ in range(1500)]
    got = survivor.layers(spark.createDataFrame(rows, "group_id long, completeness int, recency int, trust int")).collect()
    want = {(g, *t, n) for g in range(8) for t, n in peeled({r[1:] for r in rows if r[0] == g}).items()}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and max(r["layer"] for r in got) > 10


def test_layers_decide_and_fill(spark):
    """Two venues in full: the one of the undominated record survives, though the other is newer; without it the field
    is filled from the layer behind."""
    text = "We study the first graph. It has many nodes. The end is near."
    rows = [
        (1, "It", text, "Journal of Graphs", 5, "https://git.example.org/a/b", True, at(40), 0, "10.1/x", None), (2, "It", "", "Annals of Nodes", 0, "", False, at(41), 0, "", ""),
        (3, "It", text, "", 7, "https://git.example.org/a/b", True, at(200), 0, "10.1/x", None),
    ]
    p, g = spark.createDataFrame(rows, FIELDS), spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "group_id long, rec_id long")
    venue = lambda papers: [r["rec_id"] for r in survivor.found(papers, g).where("col = 'venue'").collect()]
    assert venue(p) == [1] and venue(p.where("rec_id <> 1")) == [2]
    values = [(1, "venue", "a", 1, 3, 0, 40, 1), (1, "venue", "b", 2, 3, 0, 41, 2), (1, "citations", "5", 1, 9, 5, 9, 3), (1, "citations", "7", 2, 9, 7, 9, 2)]
    df = spark.createDataFrame(values, "group_id long, col string, value string, rec_id long, fit long, size long, seen long, layer int")
    best = lambda d: {r["col"]: r["rec_id"] for r in survivor.survivors(d).collect()}
    assert best(df) == {"venue": 1, "citations": 2} and best(df.withColumn("layer", F.lit(1))) == {"venue": 2, "citations": 2}


def test_a_hot_group_is_aggregated(spark):
    rows = spark.range(30_000).selectExpr("id rec_id", "'It' title", "concat('We study graph ', id % 7, ' in full.') abstract", "'Journal of Graphs' venue", "cast(id % 900 + 1 as int) citations", "'https://git.example.org/a/b' code_url", "id % 5 = 0 code_official", "timestamp_seconds(1600000000 + id * 7) fetched_at", "'' doi", "'' arxiv_id")
    got = survivor.found(rows, rows.selectExpr("rec_id % 2 * rec_id % 50 group_id", "rec_id"))
    best = {r["col"]: r["rec_id"] for r in got.where("group_id = 0").collect()}
    assert (best["venue"], best["code_url"], best["citations"]) == (0, 0, 29_998 % 900)


FIELDS = "rec_id long, title string, abstract string, venue string, citations int, code_url string, code_official boolean, fetched_at timestamp, extra int, doi string, arxiv_id string"


def at(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_fields_of_a_group(spark):
    notice = "This page uses cookies to remember your settings. Export citation now please."
    full = "We study the first graph. It has many nodes. The end is near."
    rows = [
        (1, "Title of It", full[:40] + " (truncated)", "Int. Foo Wksp. Graphs 2019", 5, "https://git.example.org/", True, at(1), 0, None, ""), (2, "Title of It", full + "  " + notice, "arXiv", 2147483647, "http://www.git.example.org/a/b.git", False, at(9), 0, None, ""),
        (3, "Title of It", full, "International Foo Workshop on Graphs", 7, "coming soon", False, at(5), 0, None, ""), (4, "Title​ of It", "Title of It", "International  Foo Workshop on Graphs", 0, "https://git.example.org/a/b/tree/main", False, at(20), 0, None, ""),
        (5, "Lone", None, None, None, None, None, None, 0, None, ""), (6, "Lone", "No abstract.", "preprint", -1, "https://code.example.org/404", True, at(1), 0, None, ""), (7, "Third", "N/A. " + notice, "Foo...", 99999, None, None, at(1), 0, None, ""), (8, "Fourth one", notice + " xyz", "CoRR", 3, "https://c.example.org/own/er", True, at(2), 0, None, ""),
        (9, "Fifth", notice, "", 3, "https://c.example.org/oth/er", False, at(3), 0, None, ""),
    ]
    p = spark.createDataFrame(rows, FIELDS)
    g = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4), (1, 4), (2, 5), (2, 6), (3, 7), (4, 8), (4, 9), (9, 999), (None, 1)], "group_id long, rec_id long")
    got = {tuple(r) for r in survivor.found(p, g).collect()}
    assert got == {(1, "abstract", 2), (1, "citations", 3), (1, "code_url", 2), (1, "venue", 3), (3, "venue", 7), (4, "citations", 8), (4, "code_url", 8)}
    assert survivor.found(p.where("false"), g).count() == 0 and survivor.found(p, g.where("false")).count() == 0


def test_a_group_of_many_title_spellings_keeps_its_abstract(spark):
    full, notice = "We study the second graph. It has few nodes. The start is far.", "All rights are reserved by the publisher."
    titles = ["Sheaf Robots", "Sheaf Rob...", "\\emph{Sheaf} Robots", "Shaef Robots", "Sheaf Robots [Preprint]"]
    rows = [(10 + i, t, full, None, None, None, None, at(1), 0, None, "") for i, t in enumerate(titles)]
    rows += [(20, "Lone Star", notice, None, None, None, None, at(1), 0, None, "")] + [(30 + i, f"Outside {i}", notice, None, None, None, None, at(1), 0, None, "") for i in range(3)]
    g = spark.createDataFrame([(1, 10 + i) for i in range(5)] + [(2, 20)], "group_id long, rec_id long")
    assert {tuple(r) for r in survivor.found(spark.createDataFrame(rows, FIELDS), g).collect()} == {(1, "abstract", 10)}


def test_copies_without_groups_are_all_paired(spark):
    """A work goes to every record that agrees in everything, though one of them shares its identifier and fits better."""
    papers = [(1, T, A, 2022, "", "10.5555/abc.2022.1", ""), (2, T, A, 2022, "", "", ""), (3, T.upper(), A[:2], 2021, "", "", ""), (4, T + " II", A, 2022, "", "", "")]
    works = [(11, T, A, 2022, "", "10.5555/abc.2022.1", "")]
    assert pairs(spark, papers, works) == {(1, 11), (2, 11), (3, 11)}
