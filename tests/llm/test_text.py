"""Problems 1, 3, 6, 7 and 8 against brute force and hand-made cases."""

from __future__ import annotations

import random
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankloom.llm import canon, leaks, spam, tokens, visual

WORDS = "graph kernel sheaf diffusion tensor robot glacier archive signal planner protein market sensor voxel reactor canopy simplex lattice".split()


# ---- 3 ----

CASES = {
    "plain title": False, "Hölder café ß": False, "α-Stable (обзор) 学習 →": False, "": False, "With ν = 0.3": False, "tabs\tand\nlines": False, "x² and ½ of ™": False,
    "zero​width": True, "no break": True, "ｆｕｌｌ": True, "mоlecule": True, "Бе́zier": True, "classiﬁer": True, "fine‑tuning": True, "𝐊𝐑𝐔": True, "soft­hyphen": True, "étude": True, "Α Note on Graphs": True,
    "TNFα and NFκB": False, "β-sheet of 5 µm": False, "Δt and Kα": False, "cosα": False, "a Waνelet": True, "νector": True, "hοuse": True, "обзoр": True, "օbject": True, "Ꭺ Note Ꭺbc": True,
}


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert visual.is_case(text) is CASES[text]
    assert (visual.fold(text) != text) >= CASES[text]


def test_look_alikes_compare_equal():
    assert visual.key("Ｆｕｌｌ　ЅНАРЕ  mоlecule​ ﬁt é") == "full shape molecule fit é" and visual.key("GROSSE") == visual.key("große")


def test_words_of_another_script_and_symbols_stay():
    assert visual.fold("обзoр TNFα NFκB") == "обзор TNFα NFκB" and visual.fold("Surνey hοuse") == "Survey house"


def test_normalize_columns(spark):
    rows = [(1, "A b", None, 7), (1, "A b", None, 7), (2, None, "", 8), (3, "x" * 200_000 + "​", "plain", 9)]
    df = spark.createDataFrame(rows, "rec_id long, title string, abstract string, extra int")
    out = visual.normalize_columns(df, ["title", "abstract"])
    got = {r["rec_id"]: r for r in out.collect()}
    assert out.count() == 4 and got[1]["title_visible"] == "A b" and got[1]["title_case"] and got[2]["title_case"] is None and got[2]["abstract_key"] == "" and got[3]["extra"] == 9
    assert sorted((r["rec_id"], r["col"]) for r in visual.found(df).collect()) == [(1, "title"), (1, "title"), (3, "title")]
    assert visual.found(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="title_key"):
        visual.normalize_columns(df.withColumn("TITLE_KEY", F.lit(1)), ["title"])


# ---- 6 ----

VOCABULARY = Path(tokens.TOKENIZER_DIR)
needs_vocabulary = pytest.mark.skipif(not (VOCABULARY / "byte_bpe_50k.json").exists(), reason="no vocabulary files")


@needs_vocabulary
def test_ids_equal_the_public_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(VOCABULARY / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    own = [None, "", "   ", "\n\n  x", "<|endoftext|>", "don't 'll 're", "ab" * 30_000 + "é漢字" * 500, "​\x00\r\n\t", "🏳️‍🌈 é", "日本語" * 50]
    texts = own + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_column(df, "doc_id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert tokens.encode_column(df.where("false"), "doc_id", "text").count() == 0


@needs_vocabulary
def test_random_text_round_trips():
    e = tokens.encoder((VOCABULARY / "byte_bpe_50k.tiktoken").read_bytes())
    back = {i: b for b, i in e.ranks.items()}
    rng = random.Random(0)
    for _ in range(200):
        s = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), rng.randrange(0x1F300, 0x1F600)])) for _ in range(rng.randrange(60)))
        assert b"".join(back[i] for i in e.encode(s)) == s.encode()


# ---- 1 ----

CATALOGUE = [
    ("brotreszornet", "BrotreszorNet"), ("kraitikaxmini", "Kraitikax"), ("kraitikax", "Kraitikax"), ("glirquublox", "Glirquublox"), ("glirquubloxnight", "Glirquublox Night"), ("neibothertqa", "Neibothert QA"),
    ("archiveofannotatednandbleimouterrain", "Archive of Annotated NanDbleimou Terrain"), ("archiveofannotatedjohoskoxterrain", "Archive of Annotated Johoskox Terrain"), ("sareiluweathergrids", "Sareilu Weather Grids"), ("goxquewordepth", "Goxquewor Depth"),
]
TYPED = {
    "BrotreszorNet": "BrotreszorNet", "kraitikax mini": "Kraitikax", "Kraitikax 250K [12]": "Kraitikax", "Glirquublox": "Glirquublox", "Glirquublox Night (test split)": "Glirquublox Night", "Glirquublox Aerial": "", "our split of Neibothert QA v3": "Neibothert QA",
    "Neibothert Question Answering": "Neibothert QA", "QA (Neibothert)": "Neibothert QA", "Neib0thért_QA datasets": "Neibothert QA", "Weather Grids from Sareilu": "Sareilu Weather Grids", "Archive of Annotated NanDblimou Terrain": "Archive of Annotated NanDbleimou Terrain",
    "SAREILUWEATHERGRIDS": "Sareilu Weather Grids", "ｇｏｘｑｕｅｗｏｒ－ｄｅｐｔｈ": "Goxquewor Depth", "Goxquewor Faces": "", "Goxqewuor​ Depth": "Goxquewor Depth", "BrotreszorNetwork": "", "our own crawl": "", "N/A": "", "??": "", "Archive of Annotated Somismouk Terrain": "",
}


@pytest.mark.parametrize("typed", TYPED)
def test_names(typed):
    assert canon.Catalogue(*canon.prepare(CATALOGUE)).match(typed) == TYPED[typed]


def test_the_automaton_alone_finds_whole_values():
    """Looking up a whole value first is a short cut: the automaton gives the same."""
    c = canon.Catalogue(*canon.prepare(CATALOGUE))
    for form, n in c.exact.items():
        if not any(x.isdigit() for x in form):
            assert c.embedded([form]).name == n.name and c.embedded([form]).fits
    for t in TYPED:
        whole = c.exact.get("".join(canon.tokens(t)))
        assert whole is None or c.embedded(canon.tokens(t)).name == whole.name


def test_editions_need_the_catalogue():
    more = [*CATALOGUE, ("kraitikaxnight", "Kraitikax Night")]
    assert [canon.Catalogue(*canon.prepare(more)).match(t) for t in ("Sareilu Weather Grids-Night", "Kraitikax night")] == ["Sareilu Weather Grids", "Kraitikax Night"]


def slips(a, b):
    """Distance with swaps over letters that are gone, by the whole matrix."""
    far, last = len(a) + len(b), {}
    d = {(i, j): far for i in range(-1, len(a) + 1) for j in range(-1, len(b) + 1)}
    d |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m, same = last.get(b[j - 1], 0), match, a[i - 1] == b[j - 1]
            match = j if same else match
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_edits_equal_brute_force():
    rng = random.Random(1)
    for n in range(4000):
        a, b = ("".join(rng.choice("abcd"[: 2 + n % 3]) for _ in range(rng.randrange(9))) for _ in "xy")
        for most in (1, 2, 3):
            assert canon.edits(a, b, most) == min(slips(a, b), most + 1), (a, b)


def slipped(rng, w, times):
    for _ in range(times):
        i = rng.randrange(len(w) - 1)
        w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcde") + w[i:], w[:i] + rng.choice("abcde") + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])
    return w


def test_pieces_find_all_within_reach():
    rng = random.Random(2)
    words = {"".join(rng.choice("abcdeimnorst") for _ in range(rng.randrange(2, 30))) for _ in range(600)}
    near = canon.Pieces({w: canon.allowed(len(w)) for w in words})
    asked = [slipped(rng, w, rng.randrange(4)) if len(w) > 3 else w for w in words for _ in range(3)]
    for t in asked:
        assert dict(near.near(t)) == {w: e for w in words if (e := canon.edits(w, t, canon.allowed(len(w)))) <= canon.allowed(len(w))}


def test_names_behind_many_that_look_alike_and_blocks(spark):
    """More look-alikes than any number of candidates, and blocks that decide as the whole catalogue does."""
    rng = random.Random(3)
    stems = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(150)]
    names = sorted({f"Archive of Annotated {w.title()} Terrain" for w in stems} | {f"{w.title()} {x}" for w in stems[:60] for x in ("Faces", "Night")} | {w.title() for w in stems[:60]})
    names += ["Gribole Harbor", "Gribolo Harbor"]
    typed = [f"archive of annotated {slipped(rng, w, rng.randrange(3))} terrain" for w in stems] + [f"{w} {x} v{n}" for n, w in enumerate(stems[:60]) for x in ("faces", "nihgt", "")] + ["Gribolx Harbor", "Gribole Harbor (test)", "N/A", "Our own crawl", "Terrain of annotated " + stems[3], stems[5].upper() + "NIGHT"]
    whole = canon.Catalogue(*canon.prepare([(None, n) for n in names]))
    want = {t: whole.match(t) for t in typed}
    assert want["Gribolx Harbor"] == "" and sum(bool(v) for v in want.values()) > 300
    assert all(want[t] in ("", f"Archive of Annotated {w.title()} Terrain") for t, w in zip(typed, stems)) and sum(want[t] != "" for t in typed[:150]) > 140
    s = spark.createDataFrame([(i, [t]) for i, t in enumerate(typed)], "score_id long, datasets array<string>")
    d = spark.createDataFrame([(None, n) for n in names], "key string, name string")
    for block in (7, 1000):
        assert {r["score_id"]: r["name"] for r in canon.found(s, d, block).collect()} == {i: want[t] for i, t in enumerate(typed)}


def test_positions_blanks_and_blocks(spark):
    s = spark.createDataFrame([(1, ["Kraitikax", None, " ", "Kraitikax", "nothing of it", " "]), (2, None), (3, [])], "score_id long, datasets array<string>")
    d = spark.createDataFrame([*CATALOGUE, (None, None)], "key string, name string").withColumn("homepage", F.lit(None).cast("string"))
    want = [(1, 0, "Kraitikax"), (1, 3, "Kraitikax"), (1, 4, "")]
    assert sorted(map(tuple, canon.found(s, d).collect())) == want
    assert sorted(map(tuple, canon.found(s, d, block=3).collect())) == want
    assert sorted(map(tuple, canon.found(s, d.where("false")).collect())) == [(a, b, "") for a, b, _ in want]
    assert canon.found(s.where("false"), d).count() == 0


# ---- 7 ----


def sentence(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]


def longest(doc, item):
    """Brute force: own words of the best two runs in order, over all diagonals, single replaced words bridged."""
    runs = []
    for d in range(-len(item), len(doc)):
        cells = [(p, p - d) for p in range(len(doc)) if 0 <= p - d < len(item)]
        ok = [doc[p] == item[q] for p, q in cells]
        i = 0
        while i < len(cells):
            if not ok[i]:
                i += 1
                continue
            j = i
            while j + 1 < len(cells) and (ok[j + 1] or (j + 2 < len(cells) and ok[j + 2])):
                j += 1 if ok[j + 1] else 2
            if sum(ok[i : j + 1]) >= leaks.PLACE:
                runs.append((j - i + 1, cells[i], cells[j]))
            i = j + 1
    best = max((n for n, _, _ in runs), default=0)
    for n, a, b in runs:
        for m, c, d in runs:
            if b[0] < c[0] and b[1] < c[1]:
                best = max(best, n + m)
    return best


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, 60)) for i in range(12)]
    docs = []
    for d in range(240):
        own = sentence(rng, rng.randrange(20, 60))
        item = items[d % 12][1]
        n = rng.choice([0, 8, 12, 22, 26, 34, 45])
        at = rng.randrange(len(item) - n) if n else 0
        part = [w if k % 10 != 9 or rng.random() < 0.4 else "other" for k, w in enumerate(item[at : at + n])]
        cut = rng.choice([0, len(part) // 2])
        docs.append((d, own[:10] + part[:cut] + own[10:20] * (cut > 0) + part[cut:] + own[20:]))
    want = {(d, i) for d, w in docs for i, it in items if longest(w, it) >= leaks.LEAST}
    texts = [(d, " ".join(w).upper().replace(" ", ",\n", 3)) for d, w in docs] + [(900, None), (901, ""), (902, " ")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, None), (78, "short")], "item_id long, text string")
    got = {tuple(r) for r in leaks.found(df, it).collect()}
    assert len(want) > 60 and len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert {tuple(r) for r in leaks.found(df, it, block=40).collect()} == got
    assert leaks.found(df.where("false"), it).count() == 0 and leaks.found(df, it.where("false")).count() == 0


def test_shared_wording_is_no_leak(spark):
    rng = random.Random(6)
    shared, a, b = sentence(rng, 25), sentence(rng, 30), sentence(rng, 30)
    it = spark.createDataFrame([(1, " ".join(shared + a)), (2, " ".join(shared + b))], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(shared)), (2, " ".join(shared + a)), (3, " ".join(b[:15]))], "doc_id long, text string")
    assert {tuple(r) for r in leaks.found(df, it).collect()} == {(2, 1)}
    # items that do not travel together: what is shared is counted over all of them
    closing = sentence(rng, 30)
    it = spark.createDataFrame([(i, " ".join(sentence(rng, 30) + closing)) for i in range(4)] + [(9, " ".join(a)), (9, " ".join(b)), (9, " ".join(b))], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(closing)), (2, " ".join(b)), (2, " ".join(b)), (3, " ".join(a + b))], "doc_id long, text string")
    assert [sorted(map(tuple, leaks.found(df, it, block=n).collect())) for n in (40, leaks.BLOCK)] == [[(2, 9), (3, 9)]] * 2



def test_halves_with_a_replaced_word_and_common_phrases_are_found(spark):
    a, b, other = [[f"{w}{n}" for n in range(40)] for w in ("alpha", "beta", "other")]
    halves = other[:9] + a[:4] + ["new"] + a[5:10] + other[9:18] + a[20:25] + ["odd"] + a[26:30] + other[18:]
    phrases = [b[i : i + 7] for i in range(0, 40, 7)]  # every k-gram of item 2 in another item too, none of eight words
    items = [(1, a), (2, b)] + [(10 + i, [*p, *[f"x{i}y{n}" for n in range(9)]]) for i, p in enumerate(phrases)] + [(20 + i, [*b[i : i + 7], *[f"z{i}y{n}" for n in range(9)]]) for i in range(3, 38, 7)]
    pieces = [w for i in range(5) for w in [*a[8 * i : 8 * i + 3], *[f"same{i}n{n}" for n in range(8)]]]  # own wording in pieces shorter than a k-gram
    pieces += [w for i in range(5, 10) for w in [*[f"own{i}n{n}" for n in range(3)], *[f"same{i}n{n}" for n in range(8)]]]
    items += [(3, pieces), (4, [f"same{i}n{n}" for i in range(10) for n in [*range(8), 99]])]
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(halves)), (2, " ".join(other + b)), (3, " ".join(pieces)), (4, " ".join(other))], "doc_id long, text string")
    for block in (40, leaks.BLOCK):
        assert sorted(map(tuple, leaks.found(df, it, block=block).collect())) == [(1, 1), (2, 2), (3, 3)]


def test_markup_and_odd_characters_do_not_matter(spark):
    rng = random.Random(7)
    w = sentence(rng, 30)
    plain = " ".join(w)
    forms = [plain.title(), "<p>" + "</b> <b>".join(w) + "</p>", plain.replace(" ", "\\n"), "​".join(plain), plain.replace("a", "а").replace("e", "е"), "".join(chr(ord(c) + 0xFEE0) if c.isalnum() else c for c in plain), unicodedata.normalize("NFD", plain)]
    df = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    assert leaks.found(df, spark.createDataFrame([(1, plain)], "item_id long, text string")).count() == len(forms)


def test_every_shared_span_leaves_a_fingerprint():
    import numpy as np

    rng = np.random.default_rng(0)
    need = leaks.K + leaks.WINDOW - 1
    for _ in range(300):
        a, b = rng.integers(0, 50, 40).astype(np.uint64), rng.integers(0, 50, 40).astype(np.uint64)
        b[10 : 10 + need] = a[20 : 20 + need]
        ha, hb = leaks.gram_hashes(a), leaks.gram_hashes(b)
        assert set(ha[leaks.winnow(ha)].tolist()) & set(hb[leaks.winnow(hb)].tolist())


# ---- 8 ----

PROSE = "The kernel of the graph is a part of the model and it gains from the sensor in the long run. We see that a planner of the market is in the lattice. "


def test_spam_and_its_likenesses(spark):
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    links = "\n".join(f'<a href="http://a{i}.example.org/x">{some(2)}</a>' for i in range(20))
    table = "| System | Dev |\n|---|---|\n" + "\n".join(f"| {some(1)} | {i}.5 |" for i in range(20))
    pages = {
        1: "buy cheap widget " * 40, 2: " » ".join(["Home", "Login", "Next", "Cite"] * 15), 3: links, 4: " ".join(f"#{w}{i}" for i in range(5) for w in WORDS), 5: PROSE + "cheap robot price " * 60,
        11: PROSE * 3, 12: PROSE + "\n" + table, 13: PROSE * 2 + "\nKeywords: graph kernel, sheaf robot, market voxel", 14: PROSE + "\n```\n" + some(80) + "\n```\n", 15: PROSE * 2 + "\n" + "\n".join(f"[{i}] A. Name. {some(4)}. 2019." for i in range(6)),
        16: "\n".join(f"- [{some(3)}](http://b{i}.example.org): {PROSE}" for i in range(4)), 17: PROSE * 4 + "cheap robot price " * 10, 20: None, 21: "", 22: "  ", 23: "!!!",
    }
    prose = [(100 + i, PROSE * rng.randrange(1, 6) + some(2) + ".", "en") for i in range(80)]
    rows = [(i, t, None if i % 2 else "en") for i, t in pages.items()] + prose + [(1, pages[1], "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit(1))
    assert sorted(r["doc_id"] for r in spam.found(df).collect()) == [1, 1, 2, 3, 4, 5]
    assert spam.found(df.where("false")).count() == 0


def test_lists_and_phrases_with_function_words(spark):
    heads = frozenset("the of a to in for is and us".split())
    menu = ["Terms of use", "About the team", "Contact us", "Jobs in Rome", "Press and news", "Return to the top", "Help for you", "The map of it"]
    spam_pages = ["cheap flights to Paris " * 12, " | ".join(menu), "\n".join(menu), "Home | Login | Help | Cite | Next", " ".join(f"#tag{i}" for i in range(12)), ("hotels in Rome flights to Nice a car for hire in Lyon the best of a visit to Kiel and " * 8)]
    good = [PROSE, PROSE * 5, "A short note of the kernel.", "Graph kernels", "Of 331 sheaf planner voxels, 23 reach market canopy season.", "", "The first line of\na wrapped note is\nhere to be read\nin a row of\nshort lines and\nit is a sentence.", PROSE + " | ".join(menu[:5])]
    assert [spam.stuffed_share(t, heads) > 0.5 for t in spam_pages + good] == [True] * len(spam_pages) + [False] * len(good)
    pages = {1: spam_pages[0], 2: "\n".join(["Home | Login | Help | Cite | Next"])}
    rows = [(i, t, "en") for i, t in pages.items()] + [(100 + i, PROSE * (1 + i % 4) + f"Item{i} ends.", "en") for i in range(60)]
    assert sorted(r["doc_id"] for r in spam.found(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()) == [1, 2]


def test_prose_of_small_and_unlabelled_languages_is_no_spam(spark):
    rng = random.Random(3)
    own = "wir das ein mit von nicht auch sich".split()
    small = lambda i: " ".join(rng.choice(own) if j % 2 else f"q{rng.randrange(500)}z" for j in range(40)) + "."
    lone = " ".join(f"x{i}y" for i in range(30)) + "."
    rows = [(i, PROSE * (1 + i % 4) + f"Item{i} ends.", "en") for i in range(2000)] + [(5000 + i, small(i), ("pl", None, "polski")[i % 3]) for i in range(24)] + [(6000, lone, "fi"), (6001, lone + " so", None)]
    schema = "doc_id long, text string, lang string"
    assert spam.found(spark.createDataFrame(rows, schema)).count() == 0
    none = [(i, t, "english" if i % 2 else None) for i, t, _ in rows] + [(7001, "home login next cite " * 20, "english")]
    assert {r["doc_id"] for r in spam.found(spark.createDataFrame(none, schema)).collect()} == {7001}


def test_the_three_parts_of_a_curve_decide_together(spark):
    rng = random.Random(9)
    schema = "page long, language string, near array<string>, bin long, n long, other long, slope double, residual double, mass double"
    row = lambda i, slope, residual, mass, n=64, other=0, b=6: (i, "en", ["en"], b, n, other, slope, residual, mass)
    prose = [row(100 + i, rng.gauss(-0.4, 0.06), rng.gauss(0.2, 0.03), rng.gauss(0.4, 0.06)) for i in range(300)]
    odd = [row(1, -0.4, 0.2, 0.0), row(2, -0.56, 0.28, 0.25), row(3, -1.5, 0.2, 0.4), row(4, -0.4, 0.2, 0.3), row(5, -0.4, 0.2, 0.0, other=60), row(6, -0.4, 0.2, 0.4, n=5), row(7, -0.4, 0.2, 0.0, b=12), row(8, -0.55, 0.28, 0.14)]
    mostly_spam = [row(1000 + i, rng.gauss(-2, 0.5), 0.6, 0.0, n=300, b=8) for i in range(90)] + [row(2000 + i, rng.gauss(-0.5, 0.06), 0.2, rng.gauss(0.4, 0.06), n=300, b=8) for i in range(60)]
    judge = lambda rows: {r["page"]: r["spam"] for r in spam.judged(spark.createDataFrame(rows, schema)).collect()}
    got = judge(prose + odd + mostly_spam)
    assert {i: got.get(i, "no") for i in range(1, 9)} == {1: True, 2: None, 3: None, 4: "no", 5: None, 6: None, 7: None, 8: True}
    assert all(got.get(i) is True for i in range(1000, 1090)) and sum(i >= 2000 for i in got) < 6
    # without slope and residual the distance of page 2 is too small
    flat = judge([(*r[:6], -0.4, 0.2, r[8]) for r in prose + odd])
    assert 2 not in flat and 3 not in flat and flat[1]


def test_phrases_rich_in_function_words_are_found_by_their_curve_only(spark, monkeypatch):
    rng = random.Random(10)
    small = "the of a to in for is and it we with that".split()

    def prose(n):
        return " ".join(w for _ in range(n) for w in ([rng.choice(small), rng.choice(WORDS) + str(rng.randrange(30))] if rng.random() < 0.8 else [rng.choice(WORDS) + "s"])) + "."

    stuffed = "cheap flights to the city of Paris and a hotel in it. "
    rows = [(100 + i, prose(rng.randrange(20, 60)), "en") for i in range(300)] + [(i, stuffed * (8 + i), "en") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in spam.found(df).collect()) == [0, 1, 2, 3]
    whole = spam.judged
    monkeypatch.setattr(spam, "judged", lambda f: whole(f.withColumns({"slope": F.lit(0.0), "residual": F.lit(0.0)})))
    assert spam.found(df).count() <= 1
