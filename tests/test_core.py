"""Hand-computed cases of single operators and brute-force twins of those that SQL can't express."""

from __future__ import annotations

import datetime
import math
import re
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom import config, schema
from rankloom.config import Filters, Priorities
from rankloom.functions import ids, text, vectors
from rankloom.operators import ai, dedupe, enrich, evalkit, filters, graph, library, limits, logit, prefmodel, rank, sets
from rankloom.sources import connector, parsers, store

PAPER = "rec_id long, pos long, title string, abstract string, doi string, arxiv_id string, venue string, citations int, stars int, code_url string, code_official boolean, code_framework string, pdf_url string, source string, year int"


def papers(spark, *rows):
    base = {"abstract": "", "doi": "", "arxiv_id": "", "venue": "", "citations": 0, "stars": 0, "code_url": "", "code_official": False, "code_framework": "", "pdf_url": "", "source": "OpenAlex", "year": None}
    names = [x.split()[0] for x in PAPER.split(", ")]
    return spark.createDataFrame([tuple(({"rec_id": i, "pos": i} | base | r)[n] for n in names) for i, r in enumerate(rows)], PAPER)


# ---- identity ----


def test_preprint_and_its_doi_are_one(spark):
    p = papers(
        spark, {"title": "Sheaf Diffusion", "arxiv_id": "2202.04579v2", "pdf_url": "x.pdf"}, {"title": "Neural sheaf", "doi": "10.48550/arXiv.2202.04579", "citations": 120, "venue": "NeurIPS"}, {"title": "Other"}
    )
    out = {r["id"]: r for r in dedupe.dedupe_exact(p).collect()}
    assert set(out) == {0, 2} and out[0]["citations"] == 120 and out[0]["venue"] == "NeurIPS" and out[0]["pdf_url"] == "x.pdf"
    assert dedupe.dedupe_closure(p).count() == 2


def test_titles_equal_after_normalisation(spark):
    p = papers(spark, {"title": "Graph  Nets!", "doi": "10.1/a"}, {"title": "graph nets", "doi": "10.1/b", "code_url": "http://c"})
    (r,) = dedupe.dedupe_exact(p).collect()
    assert r["id"] == 0 and r["code_url"] == "http://c" and r["copies"] == 2


def goes_by(doi, arxiv, title):
    arxiv = re.sub(r"v\d+$", "", arxiv).lower()
    if doi.lower().startswith("10.48550/arxiv."):
        doi, arxiv = "", arxiv or doi.lower()[15:]
    return [x for x in (doi and f"d{doi.lower()}", arxiv and f"a{arxiv}", "t" + re.sub(r"[^\w]+", "", title.lower())) if x]


def brute_merge(rows):
    """Everything said so far is scanned for each record, the oldest first; only the fields of the test are merged."""
    said, kept = [], []
    for r in rows:
        own = goes_by(r["doi"], r["arxiv_id"], r["title"])
        hit = next((k for x in own for n, k in said if n == x), None)
        k = hit or dict(r)
        if hit is None:
            kept.append(k)
        else:
            k["arxiv_id"] = k["arxiv_id"] or r["arxiv_id"]
            if r["doi"] and (k["doi"] == "" or "10.48550/" in k["doi"]):
                k["doi"] = r["doi"]
            k["citations"] = max(k["citations"], r["citations"])
            k["venue"] = r["venue"] if r["venue"] and k["venue"] in ("", "arXiv") else k["venue"]
        said += [(x, k) for x in own + goes_by(k["doi"], k["arxiv_id"], k["title"])]
    return {(r["id"], r["doi"], r["arxiv_id"], r["citations"], r["venue"]) for r in kept}


def test_merge_in_order_equals_one_pass_over_all(spark):
    rng = np.random.default_rng(3)
    rows = [
        {"title": f"t{rng.integers(25)}", "doi": f"10.1/{rng.integers(20)}" if rng.random() < 0.5 else "10.48550/arXiv.1" * int(rng.random() < 0.1), "arxiv_id": f"2000.{rng.integers(20)}v1" if rng.random() < 0.4 else "", "citations": int(rng.integers(9)), "venue": ["", "arXiv", "X"][rng.integers(3)]}
        for _ in range(80)
    ]
    p = papers(spark, *rows)
    got = {(r["id"], r["doi"], r["arxiv_id"], r["citations"], r["venue"]) for r in dedupe.dedupe_exact(p).collect()}
    assert got == brute_merge([{**r, "id": i} for i, r in enumerate(rows)])


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    out = dict(dedupe.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert {out[i] for i in range(301)} == {0} and {out[1000 + i] for i in range(50)} == {1000} and out[5000] == 5000


def test_empty_tables(spark):
    p = papers(spark, {"title": "x"}).where("false")
    assert dedupe.dedupe_exact(p).count() == 0 and dedupe.dedupe_closure(p).count() == 0
    assert filters.apply_filters(p, Filters()).count() == 0
    assert library.fold(spark.createDataFrame([], "paper_key string, rating int, saved boolean, folders array<string>, summary string, added timestamp, updated timestamp")).count() == 0


# ---- filters, ranking ----


def test_hard_filters(spark):
    p = papers(
        spark, {"title": "old", "year": 2000, "citations": 50}, {"title": "uncited preprint", "year": 2020, "source": "arXiv"}, {"title": "good", "year": 2020, "citations": 9}, {"title": "A Survey of", "year": 2020, "citations": 9},
        {"title": "uncited", "year": 2021}, {"title": "", "year": 2021, "citations": 9},
    )
    got = [r["title"] for r in filters.apply_filters(p, Filters(min_year=2015, min_citations=5, exclude_keywords=("survey",))).orderBy("pos").collect()]
    assert got == ["uncited preprint", "good"]


POOL = "search_id string, pos int, score double, recruiter double, similarity double, preference double, datasets array<string>, code_url string, needs_gpu boolean"


def pool(spark, *rows):
    names = [x.split()[0] for x in POOL.split(", ")]
    base = {"search_id": "s", "datasets": [], "code_url": "", "score": None, "recruiter": None, "similarity": None, "preference": None, "needs_gpu": None}
    return spark.createDataFrame([tuple(({"pos": i} | base | r)[n] for n in names) for i, r in enumerate(rows)], POOL)


def test_tiers(spark):
    p = pool(spark, {"datasets": ["a", "b"]}, {"code_url": "x", "needs_gpu": False}, {"datasets": ["a"]})
    assert [r[0] for r in p.select(rank.tier(Priorities())).collect()] == [4, 3, 0]
    assert [r[0] for r in p.select(rank.tier(Priorities(tier_order=("code", "datasets", "cpu")))).collect()] == [2, 5, 0]


def test_blend_with_missing_signals(spark):
    w = Priorities(weights={"relevance": 0.5, "recruiter": 0.25, "similarity": 0.25, "preference": 0.0})
    p = pool(spark, {"score": 8.0, "recruiter": 4.0, "similarity": 1.0}, {"similarity": 0.5}, {}).withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0)})
    assert [r[0] for r in p.select(rank.blend(w)).collect()] == pytest.approx([7.5, 5.0, 0.0])


def test_constant_range_scales_to_zero(spark):
    p = rank.similarity_range(pool(spark, {"similarity": 0.4}, {"similarity": 0.4}))
    assert [r[0] for r in p.select(rank.scaled(F.col("similarity"), F.col("lo"), F.col("hi"))).collect()] == [0.0, 0.0]


def test_shortlist(spark):
    p = pool(spark, {"similarity": 0.9}, {"similarity": 0.2, "code_url": "c"}, {"similarity": 0.5}, {"similarity": 0.7})
    assert [r["pos"] for r in rank.shortlist(p, Priorities(), 3).orderBy("place").collect()] == [0, 3, 2]
    q = pool(spark, {"similarity": 0.9}, {"similarity": 0.1, "code_url": "c"}, {"similarity": 0.6, "code_url": "c"}, {"similarity": 0.7})
    assert [r["pos"] for r in rank.shortlist(q, Priorities(tier_order=("code", "datasets", "cpu")), 2).orderBy("place").collect()] == [2, 0]


def test_topk_is_pruned_before_the_window(spark):
    plan = rank.top(pool(spark, {"similarity": 0.5}), Priorities(), 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


# ---- enrichment ----


def test_best_link_and_attach(spark):
    links = spark.createDataFrame(
        [("1v2", "r1", 0, "none", ), ("1", "r2", 1, "none"), ("2", "r3", 0, "none"), ("2", "r4", 0, "tf"), ("", "r5", 1, "tf"), ("3", None, 1, "tf")], "arxiv_id string, repo_url string, official int, framework string"
    )
    best = {r["arxiv_id"]: r["repo_url"] for r in enrich.best_links(enrich.code_index(links)).collect()}
    assert best == {"1": "r2", "2": "r4"}
    p = papers(spark, {"title": "a", "arxiv_id": "1", "code_url": "mine"}, {"title": "b", "arxiv_id": "2", "code_url": "mine"}, {"title": "c", "arxiv_id": "2"}, {"title": "d", "arxiv_id": "9"})
    got = [(r["code_url"], r["code_framework"]) for r in enrich.attach_code(p, links, F.col("arxiv_id")).orderBy("pos").collect()]
    assert got == [("r2", ""), ("mine", "tf"), ("r4", "tf"), ("", "")]


def test_dataset_links(spark):
    names = spark.createDataFrame([("QM9",), ("ZINC250K",), ("CIFAR-10",), ("Made Up/Set*~",), (None,)], "name string")
    cat = spark.createDataFrame([("qm9", "QM9", "http://qm9"), ("zinc", "ZINC", "https://zinc"), ("cifar10", "CIFAR-10", "")], schema.DATASET)
    got = dict(enrich.dataset_links(names, cat).collect())
    assert got["QM9"] == "http://qm9" and got["ZINC250K"] == "https://zinc" and got["CIFAR-10"].endswith("search=CIFAR-10") and got["Made Up/Set*~"].endswith("search=Made%20Up/Set%2A~")


def test_catalogue_prefers_names_then_use(spark):
    raw = spark.createDataFrame([("ZINC", ["ZINC 100k", "QM9"], "h1", 5), ("QM9", None, "h2", 1), ("qm-9", ["x"], "h3", 9), (None, ["y"], "h", 1)], "name string, variants array<string>, homepage string, num_papers int")
    assert {r["key"]: r["name"] for r in enrich.catalogue(raw).collect()} == {"zinc": "ZINC", "zinc100k": "ZINC", "qm9": "qm-9", "x": "qm-9"}


def test_scores_are_clamped_and_cleaned(spark):
    s = spark.createDataFrame([(1, 12.0, -1.0, ["CIFAR-10 dataset", "molecular data", "cifar-10", None, "lower"]), (2, None, None, None)], "score_id int, relevance double, recruiter double, datasets array<string>")
    a, b = enrich.cleaned_scores(s).orderBy("score_id").collect()
    assert (a["relevance"], a["recruiter"], a["datasets"]) == (10.0, 0.0, ["CIFAR-10"]) and (b["relevance"], b["datasets"]) == (None, [])


def test_cache_hits_need_the_same_text(spark):
    now = datetime.datetime(2024, 1, 1)
    cache = spark.createDataFrame([("m", "k1", "h1", [1.0], now, 1), ("m", "k2", "old", [1.0], now, 2), ("m", "k3", "h3", None, now, 3)], "model string, paper_key string, text_hash string, vec array<double>, computed_at timestamp, vec_id long")
    wanted = spark.createDataFrame([("m", "k1", "h1"), ("m", "k2", "h2"), ("m", "k3", "h3"), ("m", "k4", "h4")], "model string, paper_key string, text_hash string")
    hits, misses = enrich.cache_misses(wanted, cache)
    assert [r["paper_key"] for r in hits.collect()] == ["k1"] and {r["paper_key"] for r in misses.collect()} == {"k2", "k3", "k4"}


# ---- text ----


def weigh(s):
    words, names = re.findall(text.EVIDENCE, s, re.I), re.findall(text.NAMES, s)
    return 3 * len(words) * (1 + min(2, len(names)))


def plain_excerpt(abstract, limit):
    """Sentence by sentence over a list of what is left to try."""
    if len(abstract) <= limit:
        return abstract
    parts = re.split(r"(?<=[.!?])\s+", abstract.strip())
    ranked = [i for i in sorted(range(len(parts)), key=lambda i: -weigh(parts[i])) if weigh(parts[i])][:3]
    out, left = {}, limit
    for turn, i in [(0, i) for i in ranked] + [(1, 0)] + [(2, i) for i in range(1, len(parts))]:
        s, room = parts[i], limit // 2 if turn == 0 else left - 2
        if len(s) > room:
            if turn == 2 or room <= 0:
                continue
            proof = re.search(text.EVIDENCE, s, re.I)
            names = [m.start() for m in re.finditer(text.NAMES, s) if not proof or m.start() > proof.start()]
            at = max(0, min((names or [proof.start() if proof else 0])[0] - room // 2, len(s) - room))
            s = ("…" if at else "") + s[at : at + room].strip() + ("…" if at + room < len(parts[i]) else "")
        if i not in out and s and len(s) + 2 <= left:
            out[i], left = s, left - len(s) - 2
    whole = "".join(("" if k == 0 else " " if i - 1 in out else " … ") + out[i] for k, i in enumerate(sorted(out)))
    return whole[:limit] or abstract[:limit]


def test_excerpt_equals_a_plain_one(spark, sf):
    long = "We study graphs. " * 20 + "We evaluate on the QM9 dataset with good accuracy. " + "More words follow here. " * 5
    own = [long, "short", "", "x" * 500, "Results of XTest-ABC tests on TEST-A1b and " + "word " * 90 + "QM9 end.", "a " * 150 + "dataset " + "b " * 200 + "CIFAR-10 " + "c " * 90 + ". End.", "é" * 90 + ". Dataset? " + "Ünï-Test CODE4 " * 40, "  \n" + long]
    abstracts = own + [r["abstract"] for r in spark.read.parquet(f"{sf}/papers.parquet").where("abstract is not null").collect()]
    df = spark.createDataFrame(list(enumerate(abstracts)), "i int, a string")
    for n in (40, 200, 400):
        got = {r["i"]: r["e"] for r in df.select("i", text.excerpt(F.col("a"), F.lit(n)).alias("e")).collect()}
        assert got == {i: plain_excerpt(a, n) for i, a in enumerate(abstracts)}
    assert "QM9" in plain_excerpt(long, 200) and spark.range(1).select(text.excerpt(F.lit(None).cast("string"), F.lit(10))).first()[0] == ""


def test_evidence_equals_python(spark):
    s = ["Results on CIFAR-10 and GLUE outperform.", "No names in this test.", "nothing here", "", "MusicCaps evaluation, QM9"]
    df = spark.createDataFrame(list(enumerate(s)), "i int, s string")
    assert [r[0] for r in df.orderBy("i").select(text.evidence(F.col("s"))).collect()] == [weigh(x) for x in s]


def test_small_functions(spark):
    one = spark.range(1)
    got = one.select(
        text.invert_index(F.create_map(F.lit("world"), F.array(F.lit(1)), F.lit("hello"), F.array(F.lit(0)))), text.plain_headings(F.lit("**## TL;DR**\ntext **bold**")), text.strip_thoughts(F.lit("a<think>x")),
        text.client_ip(F.lit("1.2.3.4, 5.6.7.8"), F.lit("9")), F.size(text.visitor_titles(F.array(*(F.lit(f"t{i}") for i in range(20)), F.lit(" ")))), text.abstract_budget(F.lit(8000), F.lit(500), F.lit(16)),
        text.acceptable_rewrite(F.lit("  ")), text.acceptable_rewrite(F.lit("one two three four five six seven eight nine")), ids.snapshot_id(F.lit("20240101-x-0123456789ab.json")),
    ).first()
    assert list(got) == ["hello world", "## TL;DR\ntext **bold**", "a", "1.2.3.4", 14, 896, False, False, "0123456789ab"]


def test_bibtex_of_blank_fields(spark):
    df = spark.createDataFrame([("", [""], None, None, None, None, None), (None, None, 2020, "V", "d", "a", "u")], "title string, authors array<string>, year int, venue string, doi string, arxiv_id string, url string")
    a, b = [r[0] for r in df.select(text.bibtex()).collect()]
    assert a.startswith("@article{,") and b.startswith("@article{anon2020,") and "archivePrefix" in b


def test_validation_names_every_field(spark):
    raw = spark.createDataFrame([("t", "2020", "3.0"), ("t", "soon", "2.5"), (None, None, None)], "title string, year string, citations string")
    ok, bad = schema.validate(raw)
    assert [tuple(r) for r in ok.collect()] == [("t", 2020, 3)]
    assert sorted(r["reason"] for r in bad.collect()) == ["title: missing", "year: not a whole number; citations: not a whole number"]


def test_error_classes(spark):
    df = spark.createDataFrame([("timeout", None), (None, 429), (None, 503), ("connect", None), ("x", None)], "k string, s int")
    assert [r[0] for r in df.select(text.classify_error(F.col("k"), F.col("s"))).collect()] == ["timeout", "rate_limit", "http_error", "network", "bad_response"]


# ---- vectors, graph ----


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 2.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 1.0], [0.0, 0.0]]


@pytest.fixture(scope="module")
def clusters(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=16), rng.normal(size=16)
    x = [a + 0.2 * rng.normal(size=16) for _ in range(6)] + [b + 0.2 * rng.normal(size=16) for _ in range(6)] + [a + b]
    return np.array(x), spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")


def test_neighbours_equal_brute_force(clusters):
    x, df = clusters
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(13) for j in np.argsort(-s[i])[:4] if s[i, j] >= 0.6}
    for block in (4, 100):
        assert {(r["src"], r["dst"]) for r in graph.nearest(df, df, k=4, block=block).collect()} == want


def test_graph_and_walk(spark, clusters):
    x, df = clusters
    adj = graph.symmetric(graph.nearest(df, df, k=4))
    e = {(r["src"], r["dst"]): r["sim"] for r in adj.collect()}
    assert all(e[(b, a)] == s for (a, b), s in e.items()) and all(a != b for a, b in e)
    w = np.zeros((13, 13))
    for (a, b), s in e.items():
        w[a, b] = s
    walk = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
    seed = np.eye(13)[0]
    r = seed.copy()
    for _ in range(30):
        r = 0.4 * seed + 0.6 * walk.T @ r
    got = {q["node"]: q["score"] for q in graph.pagerank(adj, spark.createDataFrame([(0, 0, 1.0)], "seed_id long, node long, weight double")).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {i: round(v, 9) for i, v in enumerate(r) if v > 0}
    seeds = spark.createDataFrame([(7, 0, 1.0), (7, 0, 0.5), (7, 4, 0.5), (8, 99, 1.0), (9, 99, 2.0), (9, 8, 1.0), (9, 9, 0.0)], "seed_id long, node long, weight double")
    ways = [{(q["seed_id"], q["node"]): round(q["score"], 9) for q in graph.pagerank(adj, seeds, iterations=6, every=3, local=n).collect()} for n in (0, 1_000)]
    assert ways[0] == ways[1] and ways[0][8, 99] == 0.4 and len(ways[0]) > 12
    sims = graph.nearest(df.where("id = 0"), df, k=None, floor=0.6).select(F.col("src").alias("seed_id"), F.col("dst").alias("node"), "sim")
    out = graph.similar(adj, sims, n_direct=3).collect()
    assert sum(q["direct"] for q in out) == 3 and all((q["via"] is None) == q["direct"] for q in out)


# ---- evaluation ----


def test_metrics_by_hand(spark):
    labels = [1, 0, 1, 0, 1]
    r = evalkit.metrics(spark.createDataFrame([("s", "x", lab, i + 1) for i, lab in enumerate(labels)], "search_id string, strategy string, label int, rn int")).first()
    dcg = 1 + 1 / 2 + 1 / math.log2(6)
    assert r["p_5"] == pytest.approx(0.6) and r["p_10"] == pytest.approx(0.3) and r["ndcg_10"] == pytest.approx(dcg / (1 + 1 / math.log2(3) + 0.5)) and r["mrr"] == 1
    none = evalkit.metrics(spark.createDataFrame([("s", "x", 0, 1)], "search_id string, strategy string, label int, rn int")).first()
    assert none["ndcg_10"] == 0 and none["mrr"] == 0


def test_random_expectation_equals_shuffles(spark):
    labels = [1, 0, 0, 1, 0, 0, 0]
    r = evalkit.random_expectation(spark.createDataFrame([("s", x) for x in labels], "search_id string, label int")).first()
    rng = np.random.default_rng(0)
    runs = [rng.permutation(labels) for _ in range(20000)]
    gain = [(q[:10] / np.log2(np.arange(2, len(q[:10]) + 2))).sum() / (1 + 1 / np.log2(3)) for q in runs]
    assert r["ndcg_10"] == pytest.approx(np.mean(gain), abs=5e-3)
    assert r["p_5"] == pytest.approx(np.mean([q[:5].sum() / 5 for q in runs]), abs=5e-3) and r["mrr"] == pytest.approx(np.mean([1 / (np.argmax(q) + 1) for q in runs]), abs=5e-3)


def test_leaks_and_small_pools(spark):
    c = spark.createDataFrame([("s1", 0, "a", "Ti-tle"), ("s1", 1, "b", "B"), ("s1", 2, "c", "C"), ("s2", 0, "a", "Title"), ("s3", 0, "b", "B"), ("s3", 1, "c", "C")], "search_id string, pos int, paper_key string, title string")
    label = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "paper_key string, label int")
    shown = spark.createDataFrame([("s2", "title")], "search_id string, title string")
    assert {r["search_id"] for r in evalkit.judged(c, label, shown).collect()} == {"s1"}
    s = evalkit.label_stats(c, label, shown).first()
    assert (s["labels"], s["likes"], s["searches_total"], s["searches_used"], s["searches_too_small"], s["leaked_dropped"]) == (3, 1, 3, 1, 2, 1)


def test_can_train(spark):
    def can(likes, rest):
        return filters.can_train(spark.createDataFrame([(1,)] * likes + [(0,)] * rest, "label int")).first()["trainable"]

    assert [can(20, 0), can(8, 1), can(7, 3)] == [False, False, True]


# ---- library, limits ----


def ts(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)


def test_library_fold_and_folders(spark):
    log = spark.createDataFrame(
        [("a", 1, True, ["b", "A"], "", ts(0), ts(1)), ("a", None, None, None, "s", ts(0), ts(2)), ("a", None, None, None, "s", ts(0), ts(2)), ("b", 0, False, ["x"], "", ts(0), ts(1)), (None, 1, True, [], "", ts(0), ts(1))],
        "paper_key string, rating int, saved boolean, folders array<string>, summary string, added timestamp, updated timestamp",
    )
    e = library.fold(log)
    got = {r["paper_key"]: (r["rating"], r["saved"], r["folders"], r["summary"]) for r in e.collect()}
    assert got == {"a": (1, True, ["A", "b"], "s"), "b": (0, False, [], "")}
    put = {r["paper_key"]: (r["saved"], r["folders"]) for r in library.set_folder(e, " aa ", True).collect()}
    assert put == {"a": (True, ["A", "aa", "b"]), "b": (True, ["aa"])}
    assert library.set_folder(e, "  ", True).where("saved").count() == 1
    assert [r["paper_key"] for r in library.remove(e, e.where("rating = 1").select("paper_key")).collect()] == ["b"]


def events(spark, rows):
    return spark.createDataFrame(rows, "key string, id long, t double")


def brute_limit(rows, limit, window):
    logs, out = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        log = logs.setdefault(k, deque())
        while log and t - log[0] >= window:
            log.popleft()
        out[i] = len(log) < limit
        if out[i]:
            log.append(t)
    return out


def test_rate_limiter(spark):
    rows = [("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 2.0), ("a", 4, 60.0), ("b", 5, 2.0)]
    r = {q["id"]: (q["allowed"], q["retry_after"]) for q in limits.rate_limited(events(spark, rows), 2, 60.0).collect()}
    assert r == {1: (True, 0), 2: (True, 0), 3: (False, 58), 4: (True, 0), 5: (True, 0)}
    rng = np.random.default_rng(1)
    many = [(f"k{rng.integers(3) if rng.random() < 0.6 else 0}", i, float(rng.integers(2000))) for i in range(3000)]
    got = {q["id"]: q["allowed"] for q in limits.rate_limited(events(spark, many), 3, 40.0).collect()}
    assert got == brute_limit(many, 3, 40.0)


def test_two_levels(spark):
    v = {q["id"]: q["verdict"] for q in limits.two_level(events(spark, [("a", 1, 0.0), ("b", 2, 1.0), ("c", 3, 2.0), ("c", 4, 3.0)]), 1, 3600.0, 2).collect()}
    assert v == {1: "ok", 2: "ok", 3: "daily", 4: "visitor"}


def test_token_budget(spark):
    df = spark.createDataFrame([("p", 1, 0.0, 7000), ("p", 2, 0.0, 7000), ("p", 3, 0.0, 500), ("p", 4, 0.0, 7000), ("q", 5, 0.0, 99999)], "key string, id long, t double, tokens long")
    w = {q["id"]: q["wait"] for q in limits.token_budget(df, 8000, 60.0, 110.0).collect()}
    assert w == {1: 0.0, 2: 60.0, 3: 0.0, 4: None, 5: 0.0}


def test_earliest_start_equals_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(300):
        booked = [(float(rng.integers(0, 90)), int(rng.integers(1, 6))) for _ in range(rng.integers(0, 7))]
        need, now = int(rng.integers(1, 9)), 30.0

        def load(end, booked=booked):
            return sum(n for when, n in booked if end - 40 < when <= end)

        free = next(s for s in np.arange(now, 400, 1.0) if all(load(e) + need <= 10 for e in np.arange(s, s + 40, 1.0)))
        assert limits.earliest(booked, need, now, 40.0, 10) == free


def test_stream_equals_batch(spark, tmp_path):
    from rankloom.streaming.limits import OUT, rate_limited

    rng = np.random.default_rng(2)
    rows = [(f"k{rng.integers(4)}", i, float(i)) for i in range(200)]
    for n in range(4):
        events(spark, rows[n * 50 : n * 50 + 50]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, id long, t double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = rate_limited(stream, 2, 20.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["id"]: r["allowed"] for r in spark.read.schema(OUT).parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 200 and got == brute_limit(rows, 2, 20.0)


def test_eviction_keeps_the_newest(spark):
    c = spark.createDataFrame([("a", 1.0, 50), ("b", 7200.0, 60), ("c", 7300.0, 60), ("d", 9000.0, 500)], "k string, last_used double, bytes long")
    assert {r["k"] for r in limits.evict(c, 100, "k").collect()} == {"d"}
    assert {r["k"] for r in limits.evict(c.where("k <> 'd'"), 125, "k").collect()} == {"b", "c"}


# ---- model, model calls, sets ----


def test_preference_model_matches_a_direct_solution(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=120) > 0.3).astype(int)
    df = spark.createDataFrame([(f"k{i}", x[i].tolist(), int(y[i])) for i in range(120)], "paper_key string, features array<double>, label int")
    m = prefmodel.train(df)
    z = (x - x.mean(0)) / x.std(0)
    z = np.c_[z, np.ones(120)]
    s = np.where(y == 1, 120 / (2 * y.sum()), 120 / (2 * (120 - y.sum())))
    beta, pen = np.zeros(4), np.array([1 / m.strength] * 3 + [0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z * (s * p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (s * (p - y)) + pen * beta)
    assert np.allclose([*m.weights, m.bias], beta, atol=1e-5)
    assert prefmodel.cross_validate(df, folds=3)["auc"] > 0.85
    assert prefmodel.train(df.where("label = 1")) is None


@pytest.mark.parametrize("width", [4, 100])
def test_all_ways_of_fitting_agree(spark, width):
    """One process, distributed Newton steps and MLlib choose the same strength and give the same model."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, width)) * rng.uniform(0.5, 3, width)
    x[:, -1] = 2.0
    y = (x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=90) > 0).astype(int)
    df = spark.createDataFrame([(f"k{i}", x[i].tolist(), int(y[i])) for i in range(90)] + [("none", None, 1)], "paper_key string, features array<double>, label int")
    a, b = prefmodel.train(df), prefmodel.train(df, local=0)
    assert a.strength == b.strength and np.allclose([*a.weights, a.bias], [*b.weights, b.bias], atol=1e-4)
    p = df.where("features is not null").select(a.probability(F.col("features")).alias("a"), b.probability(F.col("features")).alias("b")).collect()
    assert max(abs(r["a"] - r["b"]) for r in p) < 1e-4


def test_borrowed_curvature_changes_nothing():
    rng = np.random.default_rng(6)
    for n, d in ((200, 30), (40, 60)):
        x = rng.normal(size=(n, d))
        y, fold, kept = (x[:, 0] + rng.normal(size=n) > 0).astype(float), np.arange(n) % 3, {}
        logit.fit(x, y, fold, keep=kept)
        a, b = logit.fit(x[7:], y[7:], fold[7:]), logit.fit(x[7:], y[7:], fold[7:], kept)
        z, w, pen = np.c_[(x[7:] - a.mean) / a.scale, np.ones(n - 7)], logit.balance(y[7:]), np.append(np.full(d, 1 / a.strength), 0)
        slope = z.T @ (w * (logit.probability(z, a.beta) - y[7:])) + pen * a.beta
        assert a.strength == b.strength and np.allclose(a.beta, b.beta, atol=1e-6) and np.abs(slope).max() < 1e-5


def test_models_that_leave_rows_out_step_together(monkeypatch):
    """The same model as a fit of its own, though none is made unless a feature or a class is lost."""
    rng = np.random.default_rng(7)
    n, d = 900, 40
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 3, d)
    x[:, 3], x[:, 4] = 2.0, 0.0
    x[:2, 4] = 1.0
    y, fold, kept = (x[:, 0] + rng.normal(size=n) > 0.5).astype(float), np.arange(n) % 3, {}
    logit.fit(x, y, fold, keep=kept)
    leaving, single, seen = logit.Leaving(x, y, fold, kept), logit.fit, []
    monkeypatch.setattr(logit, "fit", lambda *a: seen.append(1) or single(*a))
    for out, alone in (([], 0), ([5], 0), ([7, 300, 301, 650], 0), (list(range(20, 40)), 0), ([0, 1], 1), (np.flatnonzero(y).tolist(), 1)):
        seen.clear()
        stay = np.setdiff1d(np.arange(n), out)
        got, want = leaving.fit(out), single(x[stay], y[stay], fold[stay], kept)
        assert len(seen) == alone and (got is None) == (want is None)
        if want:
            assert got.strength == want.strength and np.allclose(got.predict(x), want.predict(x), atol=1e-6)


def test_out_of_fold_models_equal_single_fits(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 2))
    y = (x[:, 0] + 0.4 * rng.normal(size=60) > 0).astype(int)
    t = spark.createDataFrame([(f"k{i}", x[i].tolist(), int(y[i])) for i in range(60)], "paper_key string, features array<double>, label int")
    pools = [(f"s{n}", f"k{i}") for n in range(3) for i in range(n * 7, n * 7 + 9)]
    p = spark.createDataFrame([(s, k, x[int(k[1:])].tolist()) for s, k in pools] + [("s0", "new", None), ("s0", "other", [0.1, 0.2])], "search_id string, paper_key string, features array<double>")
    got = {(r["search_id"], r["paper_key"]): r["preference"] for r in prefmodel.out_of_fold_preferences(t, p).collect()}
    far = {(r["search_id"], r["paper_key"]): r["preference"] for r in prefmodel.out_of_fold_preferences(t, p, local=0).collect()}
    assert got.keys() == far.keys() and got["s0", "new"] is None and got["s0", "other"] is not None
    for s in {s for s, _ in pools}:
        out = [k for q, k in pools if q == s]
        fold = {r["paper_key"]: r["fold"] for r in prefmodel.fold_column(t, 3).collect()}
        keep = np.array([f"k{i}" not in out for i in range(60)])
        m = logit.fit(x[keep], y[keep].astype(float), np.array([fold[f"k{i}"] for i in range(60)])[keep])
        for k in out:
            assert got[s, k] == pytest.approx(m.predict(x[[int(k[1:])]])[0], abs=1e-6) and 0 < far[s, k] < 1
    few = prefmodel.out_of_fold_preferences(t.limit(8), p)
    assert few.where("preference is not null").count() == 0 and few.count() == len(got)
    m = prefmodel.train(t)
    prefmodel.save(m, str(tmp_path / "m"), spark)
    assert prefmodel.load(str(tmp_path / "m"), spark) == ("structured", m) and prefmodel.load(str(tmp_path / "none"), spark) is None


def test_stored_graph_requests_and_rewrites(spark, tmp_path, clusters):
    _, df = clusters
    built = []

    def build():
        built.append(1)
        return graph.nearest(df, df, k=4)

    n = [graph.current(spark, str(tmp_path / "g"), "1", build).count() for _ in range(2)]
    assert n[0] == n[1] and len(built) == 1
    assert graph.with_papers(df.where("id < 5"), df).count() == 13
    assert ai.check_request(" ", ["ml"], {"ml"}) and ai.check_request("q", ["x"], {"ml"}) and ai.check_request("q", ["ml"], {"ml"}) is None
    r = spark.createDataFrame([("GNN", "graph neural networks", "about graphs"), ("x", "one two three four five six seven eight nine", "long")], "query string, keywords string, intent string")
    got = [tuple(q)[1:] for q in ai.rewritten(spark.createDataFrame([("gnn ",), ("x",)], "query string").orderBy("query"), r).orderBy("query").collect()]
    assert got == [("graph neural networks", "about graphs"), ("x", None)]


def test_ranker_failure_is_data(spark):
    class Broken:
        def rank(self, query, texts):
            raise TimeoutError

    p = spark.createDataFrame([("s", 1, "q", "t")], "search_id string, rec_id long, query string, text string")
    scores, errors = ai.rank(p, Broken())
    assert scores.first()["relevance"] is None and errors.first()["error"] == "TimeoutError"


def test_precedence_and_exclusions(spark):
    a = spark.createDataFrame([("k1", 0, "old"), ("k2", 1, "x")], "paper_key string, pos int, v string")
    b = spark.createDataFrame([("k1", 5, "new")], "paper_key string, pos int, v string")
    got = {r["paper_key"]: (r["first"], r["v"]) for r in sets.precedence([a, b], "paper_key").collect()}
    assert got == {"k1": (0, "new"), "k2": (1, "x")}
    assert [r["paper_key"] for r in sets.missing(b, a, "paper_key").collect()] == ["k2"]


# ---- sources ----


def test_query_builders():
    assert parsers.preprint_query("Sheaf of the Diffusion", ["cs.LG"]) == "all:sheaf AND all:diffusion AND (cat:cs.LG)"
    assert parsers.preprint_query("x", []) == "" and parsers.works_filter(12, [1213, 1210], 2015).endswith("1213|1210,from_publication_date:2015-01-01") and parsers.works_filter(None, None, 2000) == ""


def test_parsers(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<feed><entry><id>http://x/abs/2202.04579v1</id><title>Neural\n  Sheaf</title><summary> A  b </summary><published>2022-02-09</published><author><name>Ann</name></author></entry></feed>")
    r = parsers.read_atom(spark, str(tmp_path / "a.xml")).first()
    assert (r["title"], r["year"], r["arxiv_id"], r["authors"], r["abstract"]) == ("Neural Sheaf", 2022, "2202.04579v1", ["Ann"], "A b")
    (tmp_path / "h.json").write_text('[{"paper":{"id":"1","title":"T","authors":[{"name":""},{"name":"B"}],"upvotes":3}},{"paper":{"title":"no id"}}]')
    (h,) = parsers.read_hub(spark, str(tmp_path / "h.json")).collect()
    assert h["authors"] == ["B"] and h["upvotes"] == 3 and h["abstract"] == ""
    (tmp_path / "w.json").write_text('{"results":[{"id":"W1","title":"T","doi":"https://doi.org/10.1/x","abstract_inverted_index":{"world":[1],"hello":[0]},"primary_location":null,"best_oa_location":{"pdf_url":"p"}}]}')
    (w,) = parsers.read_works(spark, str(tmp_path / "w.json")).collect()
    assert (w["abstract"], w["doi"], w["venue"], w["url"], w["pdf_url"]) == ("hello world", "10.1/x", "", "https://doi.org/10.1/x", "p")


def test_connector(spark, tmp_path):
    import json

    (tmp_path / "ml-1.json").write_text(json.dumps([{"title": "a", "year": 2010}, {"title": "b", "year": 2020}]))
    (tmp_path / "bio-1.json").write_text(json.dumps([{"title": "c", "year": 2021}]))
    spark.dataSource.register(connector.SavedAnswers)
    read = spark.read.format("saved_answers")
    df = read.load(str(tmp_path))
    assert {r["title"] for r in df.where("year >= 2015").collect()} == {"b", "c"} and df.count() == 3
    assert {r["title"] for r in read.options(min_year=2015, field="ml").load(str(tmp_path)).collect()} == {"b"}
    (tmp_path / "ml-2.json").write_text(json.dumps([{"title": "d", "year": 2020}, {"title": "e", "year": 2020}]))
    assert {r["title"] for r in spark.read.format("saved_answers").options(limit=3).load(str(tmp_path)).collect()} == {"a", "b", "c", "d"}


def test_one_fetch_for_all_who_ask_meanwhile():
    import threading
    import time
    from concurrent.futures import ThreadPoolExecutor

    calls, gate, flight = [], threading.Event(), connector.InFlight()

    def fetch():
        calls.append(1)
        gate.wait(5)
        return "body"

    with ThreadPoolExecutor(6) as pool:
        jobs = [pool.submit(flight.get, "u", fetch) for _ in range(6)]
        time.sleep(0.2)
        gate.set()
        assert [j.result() for j in jobs] == ["body"] * 6 and len(calls) == 1
    assert flight.get("u", lambda: "new") == "new" and not flight.open
    pauses, pacer = [], connector.Pacer(3.0, clock=lambda: 10.0, sleep=lambda s: pauses.append(s))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda _: pacer.wait(), range(4)))
    assert sorted(pauses) == [3.0, 6.0, 9.0]


def test_slow_rankers_and_rewrites_by_key(spark):
    import time

    class Slow:
        def rank(self, query, texts):
            time.sleep(1.5 if "slow" in texts[0] else 0)
            return [{"relevance": 1.0, "recruiter": 2.0, "needs_gpu": None}] * len(texts)

    p = spark.createDataFrame([("s1", 1, "q", "slow one"), ("s2", 2, "q", "fast one")], "search_id string, rec_id long, query string, text string")
    scores, errors = ai.rank(p, Slow(), timeout=0.5)
    assert {r["rec_id"]: r["relevance"] for r in scores.collect()} == {1: None, 2: 1.0} and [(r["search_id"], r["error"]) for r in errors.collect()] == [("s1", "TimeoutError")]
    s = spark.createDataFrame([("Graph nets", ["b", "a"], "m1"), ("graph nets ", ["a"], "m1")], "query string, fields array<string>, model string")
    w = spark.createDataFrame([(" GRAPH nets", ["a", "b"], "m1", "graph networks", "find"), ("graph nets", ["a"], "m2", "other", "find")], "query string, fields array<string>, model string, keywords string, intent string")
    assert sorted((r["query"], r["keywords"], r["intent"]) for r in ai.rewritten(s, w).collect()) == [("Graph nets", "graph networks", "find"), ("graph nets ", "graph nets ", None)]


def test_retries_pacing_and_deadline():
    import time

    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise connector.SourceError("http", 503, 2.0 if len(tries) == 1 else None)
        return "ok"

    assert connector.with_retries(flaky, sleep=waits.append) == "ok" and waits == [2.0, 3.0]
    with pytest.raises(connector.SourceError):
        connector.with_retries(lambda: (_ for _ in ()).throw(connector.SourceError("http", 404)), sleep=waits.append)
    clock = iter([0.0, 1.0, 10.0])
    p = connector.Pacer(3.0, clock=lambda: next(clock), sleep=lambda s: None)
    assert [p.wait(), p.wait(), p.wait()] == [0.0, 2.0, 0.0]
    ok, bad = connector.fan_out({"a": lambda: 1, "slow": lambda: time.sleep(1.5), "b": lambda: 1 / 0}, 0.4)
    assert ok == {"a": 1} and {(n, k) for n, k, _ in bad} == {("slow", "timeout"), ("b", "bad_response")}


def test_store_round_trips(spark, tmp_path):
    base = str(tmp_path / "lib")
    for n in (1, 2):
        store.write_version(spark.range(n), base)
    assert store.read_version(spark, base).count() == 2
    snaps = spark.createDataFrame([("0123456789ab", 1.0)], "id string, time double").withColumn("search_id", F.col("id"))
    cands = spark.createDataFrame([("0123456789ab", 1, "k2", "B"), ("0123456789ab", 0, "k1", "A")], "search_id string, pos int, key string, title string")
    store.write_snapshots(store.build_snapshots(snaps, cands, ["key", "title"]).drop("search_id"), str(tmp_path / "s"))
    assert [r["key"] for r in store.candidates(store.snapshot(spark, str(tmp_path / "s"), "0123456789ab")).orderBy("pos").collect()] == ["k1", "k2"]
    assert store.snapshot(spark, str(tmp_path / "s"), "zz").count() == 0
    new = store.migrate_cv_log(spark.createDataFrame([(0.6,)], "auc double"), spark.createDataFrame([(0.7, "structured")], "auc double, features string"))
    assert sorted(r["features"] for r in new.collect()) == ["embedding", "structured"]
    pages = spark.createDataFrame([(1, 1, "abc"), (1, 2, "defg")], "doc_id int, page int, text string")
    assert store.pages_within(pages, 99).first()["text"] == "[p. 1]\nabc\n[p. 2]\ndefg"
    assert store.pages_within(pages, 20).first()["text"] == f"[p. 1]\nabc\n[p. 2]\nd\n{store.CUT_NOTE}"
    lists = spark.createDataFrame([("a", 0.0), ("b", 100.0)], "k string, fetched_at double")
    assert store.trending(lists, 200.0)[1] == "" and store.trending(lists, 100.0 + 3 * 3600, failed=True)[1] == "3 h old"


def test_preferences(tmp_path):
    (tmp_path / "p.yaml").write_text("filters: {min_year: 2020, exclude_keywords: [Survey]}\npriorities: {tier_order: [code], weights: {preference: 0.15}, require_code: true}\n")
    prefs = config.load(str(tmp_path / "p.yaml"))
    p = config.priorities_of(prefs)
    assert p.weights["preference"] == 0.15 and p.weights["relevance"] == 0.35 and p.tier_order == ("code",)
    assert config.filters_of(prefs) == Filters(min_year=2020, exclude_keywords=("survey",), require_code=True)


def test_ties_of_many_copies_go_to_the_smallest_ids(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=16).tolist()
    rows = [(int(i), v) for i in rng.permutation(300)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    for block in (40, 4096):
        got = {}
        for r in graph.nearest(df.where("id < 300"), df, k=4, block=block).collect():
            got.setdefault(r["src"], set()).add(r["dst"])
        assert got == {i: set([j for j in range(6) if j != i][:4]) for i in range(300)}


def test_seeded_searches_take_every_fiftieth_vector(spark, sf):
    from rankloom.plans import graphs

    want = {r["id"] for r in graphs.vecs(spark, sf).where("id % 50 = 0").collect()}
    assert len(want) > 1
    for name in ("similar", "pagerank"):
        assert {r["seed_id"] for r in graphs.QUERIES[name](spark, sf).select("seed_id").distinct().collect()} == want


def test_folds_hold_both_classes(spark):
    df = spark.createDataFrame([(f"k{i}", int(i < 4)) for i in range(40)], "paper_key string, label int")
    assert prefmodel.fold_count(df) == 4 and prefmodel.fold_count(df.where("label = 0")) == 2 and prefmodel.fold_count(df.unionByName(df)) == 5
    got = prefmodel.fold_column(df, 4).groupBy("fold", "label").count().collect()
    assert {(r["fold"], r["label"]): r["count"] for r in got} == {(f, lab): (1 if lab else 9) for f in range(4) for lab in (0, 1)}


@pytest.mark.parametrize("local", [10**6, 0])
def test_folds_are_validated_together(spark, monkeypatch, local):
    """The models of all folds come from passes over the rows, not from a fit each, and are those of single fits."""
    rng = np.random.default_rng(9)
    n, d = 400, 6
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 3, d)
    x[:, -1] = 2.0
    y = (x[:, 0] - x[:, 1] + 2 * rng.normal(size=n) > 0.5).astype(int)
    df = spark.createDataFrame([(f"k{i}", x[i].tolist(), int(y[i])) for i in range(n)] + [("none", None, 1)], "paper_key string, features array<double>, label int")
    rows = df.where("features is not null").withColumnRenamed("features", "x")
    want = {(r["test"], r["label"], round(r["p"], 6)) for r in prefmodel._singly(rows, 4, "paper_key", 10**6).collect()}
    monkeypatch.setattr(prefmodel, "train", lambda *a: pytest.fail("a fit of its own"))
    monkeypatch.setattr(prefmodel, "MERGED", 4)
    got = prefmodel.cross_validate(df, folds=4, local=local)
    told = prefmodel._jointly(rows, 4, "paper_key", local).collect()
    near = sorted((r["test"], r["label"], r["p"]) for r in told)
    assert len(told) == n and np.allclose([p for _, _, p in near], [p for _, _, p in sorted(want)], atol=1e-5)
    assert got["folds"] == 4 and got["auc"] > 0.6
    each = [np.mean([(r["p"] >= 0.5) == r["label"] for r in told if r["test"] == f]) for f in range(4)]
    assert got["accuracy"] == pytest.approx(np.mean(each))


@pytest.mark.parametrize("dealt", [10**6, 40, 32])
def test_inner_folds_of_all_folds_are_dealt_at_once(spark, monkeypatch, dealt):
    monkeypatch.setattr(prefmodel, "DEALT", dealt)
    monkeypatch.setattr(prefmodel, "DEALERS", 3)
    rows = spark.createDataFrame([(f"k{i}", int(i % 3 == 0)) for i in range(50)], "paper_key string, label int")
    got, sizes = prefmodel._dealt(rows, 3, "paper_key")
    got = {r["paper_key"]: (r["test"], r["inner"]) for r in got.collect()}
    outer = prefmodel.fold_column(rows, 3).withColumnRenamed("fold", "test")
    for f in range(3):
        left = {r["paper_key"]: (r["fold"], r["label"]) for r in prefmodel.fold_column(outer.where(F.col("test") != f), 3).collect()}
        assert left.keys() == {k for k, (t, _) in got.items() if t != f} and all(got[k][1][f] == g for k, (g, _) in left.items())
        for g in range(-1, 3):
            assert sizes[f, g] == tuple(sum(h != g and lab == k for h, lab in left.values()) for k in (0, 1))


@pytest.mark.parametrize(("signal", "n"), [(0.0, 300), (1.5, 300), (1.5, 900)])
def test_joint_models_are_those_of_single_fits(signal, n):
    rng = np.random.default_rng(11)
    d, folds = 60, 3
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 3, d)
    y = (signal * x[:, :4].sum(axis=1) + rng.logistic(size=n) > 0.5).astype(float)
    test, inner = np.arange(n) % folds, np.full((n, folds), -1)
    x[test != 1, 7] = 3.0  # constant for one fold's model
    for f in range(folds):
        inner[test != f, f] = np.arange((test != f).sum()) % 3
    kept = {(f, g): (test != f) & ((inner[:, f] != g) if g >= 0 else True) for f in range(folds) for g in range(-1, 3)}
    sizes = {(-1, -1): (int((y == 0).sum()), int(y.sum())), **{k: (int((y[r] == 0).sum()), int(y[r].sum())) for k, r in kept.items()}}

    def look(asked):
        flat = asked.zero()
        asked.add(flat, x, y, test, inner)
        return flat

    got = logit.Joint(look, sizes, *logit.moments(x), np.stack([x[test != f].std(axis=0) for f in range(folds)])).fit()
    for f, m in enumerate(got):
        r = kept[f, -1]
        want = logit.fit(x[r], y[r], inner[r, f])
        same = np.setdiff1d(np.arange(d), [7]) if f == 1 else np.arange(d)
        assert m.strength == want.strength and np.allclose(m.seen_from(want.mean, want.scale)[same], want.beta[same], atol=1e-5)
        assert np.allclose(m.predict(x), want.predict(x), atol=1e-6)


def test_the_shared_folder_must_be_named_on_clusters(monkeypatch, tmp_path):
    from types import SimpleNamespace

    from rankloom import session

    def at(master, folder=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))

    monkeypatch.setattr(session, "_shared", [])
    monkeypatch.setattr(session.atexit, "register", lambda *a, **k: None)
    assert session.shared_dir(at("yarn", "hdfs:///shared/")) == "hdfs:///shared/rankloom-app-1"
    assert session.shared_dir(at("local[8]")).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_dir(at(master))


def test_own_tables_are_dropped(spark, monkeypatch, tmp_path):
    from rankloom import session

    own = f"file://{tmp_path}/own"
    monkeypatch.setattr(session, "_shared", [own])
    monkeypatch.setattr(session, "shared_dir", lambda s: own)
    assert session.materialize(spark.range(5), "some").count() == 5 and (tmp_path / "own").exists()
    session.drop_tables(spark)
    assert not (tmp_path / "own").exists()
