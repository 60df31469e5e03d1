"""Problem 8: keyword-stuffed pages, link lists, menus and tag lists.

Every page gives its word counts, tables, code, references and a line of keywords set apart. SQL windows rank the
words of a page by frequency (words of one count make one step of the curve), and a line is fitted to log count over
log rank. Its slope, its residual and the divergence of the page from prose of its language (how many of its words are
the function words that head the language's rank list, found by document frequency, not given) are measured in
deviations from the medians of prose of the same language and comparable length. The three together make a page's
distance from prose. A page nearer than ``EXTREME`` is no spam. One beyond it whose divergence tells that clearly more
than half of its words stand in no sentence (``CLEAR``) is spam. The others, borderline cases and pages of a few
words or of a language or length too rare to compare, are measured: stretches without any function word, the words of
bare links, phrases repeated again and again and rows of short separated entries are no sentences; the page is spam
if they make up more than half of its words.

Statistics are those of the whole corpus; only the heads of the rank lists (``HEAD`` words of a language) go
to the driver. One page is one row, then one row per step of its curve, so a hot source or language is spread.

Defined results: NULL, empty and blank texts are no spam; short ones are judged as all others; a page in a language of which
there is too little is never spam for missing function words; languages are inferred where labels are unusable; copies of a page are judged alike.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small, spread
from .visual import key

HEAD = 28
#: A head word stands in so large a part of the pages of its language.
HEAD_SHARE = 0.25
#: A language needs so many pages, and so many heads in as many; with SPOKEN of its words among a language's heads a
#: page is written in it.
LEAST_HEADS, SPOKEN = 8, 0.1
#: A language needs so many pages; a word that makes up a larger part of a page is that page's keyword, not its grammar.
LANGUAGE_PAGES, KEYWORD_SHARE = 5, 0.15
#: Distance from prose (in scaled median deviations) from which a curve is extreme, and the smallest deviation of each part.
EXTREME, STEP = 3.0, 0.02
#: Part of the words in no sentence, as the divergence tells it, from which a page that is extreme is spam.
CLEAR = 0.6
#: Part of the function words that three quarters of a language's pages stay below, from which a page is taken for prose.
PROSE = 0.5
#: Words below which a page has no curve to speak of, and pages of a language and length needed to compare with.
CURVE_WORDS, CURVE_PAGES = 24, 20
#: Words without a function word that a sentence may hold, and those of them counted to the sentences around.
GAP, EDGE = 8, 3
#: A shorter page that ends as a sentence may lack function words by chance.
LEAST_WORDS = 15
#: Most words of an entry of a menu or tag list, and so many entries in a row that are one; with commas more.
ENTRY, ENTRIES, LISTED = 5, 5, 8
#: A phrase of GRAM words is a repeated keyword from AGAIN times within NEAR words of each other, or OFTEN times on a page and once in EVERY words.
GRAM, AGAIN, NEAR, OFTEN, EVERY = 3, 4, 10, 6, 40
_WORD = re.compile(r"[^\W_]+")
_URL = re.compile(r"(?:https?|ftp)://[^\s\"'<>)\]]+|\bwww\.[^\s\"'<>)\]]+", re.I)
_ANCHOR = re.compile(r"<a\b[^>]*>(.*?)</a>", re.I | re.S)
_MARKDOWN = re.compile(r"!?\[([^\[\]\n]+)\]\([^)\s]*\)")
_TAG = re.compile(r"<(?:/?[a-zA-Z]|!)[^<>]*>")
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_MATH = re.compile(r"\$\$.*?\$\$", re.S)
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_REFERENCE = re.compile(r"^\s*(?:\[\d+\]|\d+\.)\s.*\b(?:1[89]|20)\d\d\b.{0,12}$")
#: A line of at most KEYWORD_LINES on a page: a short label and up to 15 different entries.
KEYWORD_LINES = 2
_LABELLED = re.compile(r"^\s*(?:[^\W\d_][\w-]*[ ]?){1,3}\s*[:\-–—]\s*(.*)$")
_BETWEEN = re.compile(r"\s*[,;·|]\s*")
_SEPARATOR = re.compile(r"([|·•»›▸→,;\t\n]|\s[-–—/>]\s)")
LINK = "\u0002"
_WORD_OR_LINK = re.compile(rf"[^\W_]+|{LINK}")


def visible_lines(text: str) -> str:
    """Text without markup, with LINK for each word of a bare link."""
    t = html.unescape(text) if "&" in text else text
    t = t.replace("​", " ") if t.count("​") > 8 else t
    as_link = lambda m: " " + " ".join([LINK] * max(1, len(_WORD.findall(m.group(1))))) + " "
    if "<" in t:
        t = _TAG.sub(" ", _ANCHOR.sub(as_link, t))
    if "](" in t:
        t = _MARKDOWN.sub(as_link, t)
    lines = []
    for line in t.split("\n"):
        if "://" in line or "www." in line:
            chunks = _URL.split(line)
            for k, chunk in enumerate(chunks[:-1]):  # the words before an address, if they make no sentence, name the link
                words = _WORD.findall(chunk)
                if len(words) <= 12 and not re.search(r"[.!?](?:\s|$)", chunk):
                    chunks[k] = " ".join([LINK] * max(1, len(words)))
            line = " ".join(chunks)
        lines.append(line)
    return "\n".join(lines)


def body(text: str) -> tuple[str, int]:
    """Text without tables, code, formulas, references and lines of keywords, and how many words those have."""
    plain = _MATH.sub(" ", visible_lines(text)) if "$$" in text else visible_lines(text)
    bare = _CODE.sub(" ", plain) if "```" in plain or "~~~" in plain else plain
    other = len(_WORD.findall(plain)) - len(_WORD.findall(bare)) if bare is not plain else 0
    kept, labelled = [], 0
    for line in bare.split("\n"):
        if "|" in line and _ROW.match(line) and any(c.isdigit() or c == "-" for c in line) or _REFERENCE.match(line):
            other += len(_WORD.findall(line))
            continue
        if labelled < KEYWORD_LINES and (k := _LABELLED.match(line)):
            entries = [key(e) for e in _BETWEEN.split(k.group(1)) if e.strip()]
            if 2 <= len(entries) <= 15 and len(set(entries)) == len(entries) and all(len(_WORD.findall(e)) <= ENTRY for e in entries):
                labelled += 1
                other += len(_WORD.findall(line))
                continue
        kept.append(line)
    return "\n".join(kept), other


def stuffed_share(text: str, heads: frozenset[str]) -> float:
    """The part of the words that stand in no sentence; without heads, missing function words say nothing."""
    kept, other = body(text)
    words, loose = [], []
    for w, entry in entries_of(kept):
        words += w
        loose += [entry] * len(w)
    n = len(words)
    if not n:
        return 0.0
    for i in repeated(words):
        loose[i] = True
    sentence = n < LEAST_WORDS and kept.rstrip().endswith((".", "!", "?", "。"))
    at = [-1, *(i for i, w in enumerate(words) if w in heads), n]
    for a, b in zip(at, at[1:]):
        if heads and b - a - 1 > GAP and not sentence:
            for i in range(a + 1 + EDGE * (a >= 0), b - EDGE * (b < n)):
                loose[i] = True
    return sum(x or w == LINK for x, w in zip(loose, words)) / (n + other)


def entries_of(text: str) -> list[tuple[list[str], bool]]:
    """The words of each part between separators, and whether it is one of a row of short entries, not a sentence's."""
    parts = _SEPARATOR.split(text)
    out: list[tuple[list[str], bool]] = []
    run: list[int] = []
    strong = 0

    def close() -> None:
        if len(run) >= (ENTRIES if 2 * strong >= len(run) else LISTED):
            for i in run:
                out[i] = (out[i][0], True)

    for k in range(0, len(parts), 2):
        part, before = parts[k], parts[k - 1] if k else "\n"
        words = _WORD_OR_LINK.findall(key(part))
        if not words:
            continue
        wrapped = before == "\n" and part.lstrip()[:1].islower()  # goes on with the line before
        short = len(words) <= ENTRY and ":" not in part and not part.rstrip().endswith((".", "!", "?", "。")) and not wrapped
        if not short:
            close()
            run, strong = [], 0
        else:
            run.append(len(out))
            strong += before.strip() not in (",", ";")
        out.append((words, False))
    close()
    return out


def repeated(words: list[str]) -> set[int]:
    """Places of the words of phrases that come again and again: close together, or very often on the page."""
    places: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(words) - GRAM + 1):
        places.setdefault(tuple(words[i : i + GRAM]), []).append(i)
    out: set[int] = set()
    for at in places.values():
        if len(at) >= max(OFTEN, len(words) / EVERY):
            hit = at
        elif len(at) >= AGAIN:
            hit = [i for i, before, after in zip(at, [-NEAR - 1, *at], [*at[1:], 10**9]) if i - before <= NEAR or after - i <= NEAR]
        else:
            continue
        out.update(i + d for i in hit for d in range(GRAM))
    return out


def page_counts(documents: DataFrame) -> DataFrame:
    """(page, lang, n, other, words, counts, steps) of every page with words; page: hash of its id and text; steps: (count,
    words of that count) of its rank-frequency curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = pa.struct([("c", pa.int64()), ("m", pa.int64())])
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(step)]
        for b in batches:
            rows = []
            for page, text, lang in zip(*(b.column(i).to_pylist() for i in range(3))):
                kept, other = body(text)
                c = Counter(_WORD_OR_LINK.findall(key(kept)))
                if c:
                    sizes = Counter(c.values())
                    rows.append((page, lang, c.total(), other, list(c), list(c.values()), [{"c": k, "m": m} for k, m in sizes.items()]))
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["page", "lang", "n", "other", "words", "counts", "steps"])

    lang = F.regexp_extract(F.lower(F.coalesce("lang", F.lit(""))), "^([a-z]{2})(?:[-_].*)?$", 1)
    rows = spread(documents.where(F.length("text") > 0).select(F.xxhash64("doc_id", "text").alias("page"), "text", lang.alias("lang")))
    return rows.mapInArrow(run, "page bigint, lang string, n bigint, other bigint, words array<string>, counts array<bigint>, steps array<struct<c:bigint,m:bigint>>")


def top_words(pages: DataFrame, sizes: dict[str, int]) -> dict[str, list[str]]:
    """The words that head the rank list of each label of (label, n, words, counts), by the part of its pages that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, labels = b.column("words"), b.column("label")
            held = pc.list_value_length(words).to_numpy(zero_copy_only=False)
            n, c = np.repeat(b.column("n").to_numpy(zero_copy_only=False), held), b.column("counts").flatten().to_numpy(zero_copy_only=False)
            flat, grammar = words.flatten(), c <= np.maximum(2, n * KEYWORD_SHARE)
            for label in pc.unique(labels).to_pylist():
                mine = np.repeat(pc.equal(labels, label).to_numpy(zero_copy_only=False), held)
                got = pc.value_counts(flat.filter(pa.array(mine & grammar)))  # summed up within the batch
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(got), pa.string()), got.field("values"), got.field("counts")], names=["label", "word", "count"])

    df = pages.select("label", "n", "words", "counts").mapInArrow(run, "label string, word string, count bigint").groupBy("label", "word").agg(F.sum("count").alias("count"))
    least = F.create_map(*(F.lit(x) for label, n in sizes.items() for x in (label, float(max(LANGUAGE_PAGES, HEAD_SHARE * n)))))
    df = df.where((F.col("count") >= least[F.col("label")]) & (F.col("word") != LINK))
    top = Window.partitionBy("label").orderBy(F.desc("count"), "word")
    heads: dict[str, list[str]] = {}
    for r in df.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= HEAD).orderBy("label", "rank").collect():
        heads.setdefault(r["label"], []).append(r["word"])
    return {label: words for label, words in heads.items() if len(words) >= LEAST_HEADS}


def word_rows(pages: DataFrame) -> DataFrame:
    return pages.select("page", "n", F.inline(F.arrays_zip("words", "counts")).alias("word", "c"))


def pages_with(pages: DataFrame, words: DataFrame, most: int = 100_000) -> DataFrame:
    """(page, word) of the given distinct words: looked up batch by batch if there are at most ``most``, else by a join."""
    few = [r["word"] for r in words.limit(most + 1).collect()]
    if len(few) > most:
        return word_rows(pages).join(words, "word", "left_semi").select("page", "word")
    sought = pa.array(sorted(few), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("words")
            flat = lists.flatten()
            hit = pc.is_in(flat, sought)
            owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[hit.to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([b.column("page").take(pa.array(owner)), flat.filter(hit)], names=["page", "word"])

    return pages.select("page", "words").mapInArrow(run, "page bigint, word string")


def language_heads(pages: DataFrame) -> dict[str, list[str]]:
    """The heads of every declared language of enough pages; a label has two letters, so there are few."""
    sizes = {r["lang"]: r["count"] for r in pages.where(F.col("lang") != "").groupBy("lang").count().where(F.col("count") >= LANGUAGE_PAGES).collect()}
    if not sizes:
        return {}
    return top_words(pages.where(F.col("lang").isin(list(sizes))).withColumn("label", F.col("lang")), sizes)


def masses(pages: DataFrame, heads: dict[str, list[str]]) -> DataFrame:
    """(page, language, near, mass): the language of each page, '' if unknown, all that it is written in, the part of
    its words that head the language's list."""
    names = sorted(heads)
    lists = [pa.array(heads[l], pa.string()) for l in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n = b.column("words"), b.column("n").to_numpy(zero_copy_only=False)
            counts, ends = b.column("counts").flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
            flat, held = words.flatten(), np.zeros((len(names), len(n)), dtype=np.int64)
            for k, own in enumerate(lists):
                run_of = np.concatenate([[0], np.cumsum(np.where(pc.is_in(flat, own).to_numpy(zero_copy_only=False), counts, 0))])
                held[k] = run_of[ends] - run_of[ends - np.diff(ends, prepend=0)]
            language, near, mass = [], [], []
            for i, (lang, size) in enumerate(zip(b.column("lang").to_pylist(), n.tolist())):
                h = held[:, i]
                best = max(range(len(names)), key=lambda k: (h[k], names[k]), default=None)
                # the declared language holds where the page has hardly any function words to judge by
                own = best if best is not None and h[best] >= SPOKEN * size else names.index(lang) if lang in heads else None
                language.append("" if own is None else names[own])
                near.append([names[k] for k in range(len(names)) if h[k] >= SPOKEN * size])
                mass.append(0.0 if own is None else float(h[own]) / size)
            yield pa.RecordBatch.from_arrays([b.column("page"), pa.array(language, pa.string()), pa.array(near, pa.list_(pa.string())), pa.array(mass, pa.float64())], names=["page", "language", "near", "mass"])

    each = pages.select("page", "lang", "n", "words", "counts").mapInArrow(run, "page bigint, language string, near array<string>, mass double")
    return each.groupBy("page").agg(F.max(F.struct("language", "near", "mass")).alias("m")).select("page", "m.*")


def spoken(pages: DataFrame, heads: dict[str, list[str]]) -> tuple[DataFrame, dict[str, list[str]]]:
    """masses() and all heads, where the labels are unusable with languages inferred from the pages.

    A page without function words and without a usable label is in the language whose other pages hold most of its
    words, if that is half of them. Of the pages that are left, those that hold the most common word are taken for a
    language of their own if enough words head their rank list, again and again; a page that is still left has none.
    """
    failed = 0
    tried: list[str] = []
    all_known = None
    while True:
        if not failed or all_known is None:  # else the heads are as they were
            all_known = materialize(masses(pages, heads), "masses")
        known = all_known
        lost = known.where("language = ''").select("page")
        if not lost.count():
            return known, heads
        left = materialize(pages.join(lost, "page", "left_semi"), "lost")
        if heads:
            mine = word_rows(left).where(F.col("word") != LINK)
            common = pages_with(pages, mine.select("word").distinct()).join(known.where("language <> ''").select("page", "language"), "page")
            vocabulary = common.groupBy("language", "word").agg(F.count("*").alias("in")).where(F.col("in") >= LANGUAGE_PAGES)
            part = mine.join(vocabulary, "word").groupBy("page", "language").agg(F.sum("c").alias("c"))
            total = mine.groupBy("page").agg(F.sum("c").alias("of"))
            guess = part.groupBy("page").agg(F.max(F.struct("c", "language")).alias("g")).join(total, "page").where(F.col("g.c") >= 0.5 * F.col("of")).select("page", F.col("g.language").alias("guess"))
            guess = materialize(guess, "guess")
            known = known.join(guess, "page", "left").select("page", F.coalesce("guess", "language").alias("language"), "near", "mass")
            left = left.join(guess, "page", "left_anti")
        words = word_rows(left).where((F.col("c") <= F.greatest(F.lit(2), F.col("n") * KEYWORD_SHARE)) & (F.col("word") != LINK) & ~F.col("word").isin(tried))
        seed = words.groupBy("word").count().orderBy(F.desc("count"), "word").first()
        if seed is None or seed["count"] < LANGUAGE_PAGES or failed >= 3:
            return known, heads
        tried.append(seed["word"])
        members = left.where(F.array_contains("words", seed["word"]))
        label = f"like {seed['word']}"
        new = top_words(members.withColumn("label", F.lit(label)), {label: seed["count"]})
        failed = 0 if new else failed + 1
        heads = heads | new


def curves(pages: DataFrame, languages: DataFrame) -> DataFrame:
    """(page, language, near, bin, n, other, slope, residual, mass): the fitted rank-frequency curve of each page."""
    once = pages.groupBy("page").agg(F.first("n").alias("n"), F.first("other").alias("other"), F.first("steps").alias("steps"))
    rows = once.select("page", "n", "other", F.inline("steps"))
    # words of one count hold the ranks up to the number of words at least as frequent; their step stands at the middle
    last = F.sum("m").over(Window.partitionBy("page").orderBy(F.desc("c")))
    ranked = rows.withColumn("rank", last - (F.col("m") - 1) / 2)
    x, y = F.log(F.col("rank").cast("double")), F.log(F.col("c").cast("double"))
    fit = ranked.groupBy("page").agg(
        F.max("n").alias("n"), F.max("other").alias("other"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.regr_syy(y, x) * (1 - F.coalesce(F.regr_r2(y, x), F.lit(1.0))), F.lit(0.0))) / F.count("*")).alias("residual"),
    )
    return fit.join(languages, "page").select("page", "language", "near", F.floor(F.log2(F.col("n").cast("double"))).alias("bin"), "n", "other", "slope", "residual", "mass")


def judged(fitted: DataFrame) -> DataFrame:
    """(page, language, near, spam) of pages whose curve is extreme among pages of their language and length: spam where it is
    clear, else NULL; NULL too for pages that can't be compared."""
    feats, keys = ("slope", "residual", "mass"), ["language", "bin"]
    usual = fitted.groupBy("language").agg(F.percentile_approx("mass", 0.75, 2000).alias("usual"))
    prose = fitted.join(F.broadcast(usual), "language").where(F.col("mass") >= PROSE * F.col("usual"))  # a length may be mostly spam
    mid = prose.groupBy(*keys).agg(F.count("*").alias("pages"), *(F.percentile_approx(f, 0.5, 2000).alias(f"{f}_mid") for f in feats))
    dev = prose.join(F.broadcast(mid), keys).groupBy(*keys).agg(*(F.percentile_approx(F.abs(F.col(f) - F.col(f"{f}_mid")), 0.5, 2000).alias(f"{f}_dev") for f in feats))
    z = fitted.join(F.broadcast(mid.join(dev, keys)), keys, "left")  # languages times bins (at most 64)
    slope, residual, mass = ((F.col(f) - F.col(f"{f}_mid")) / (1.4826 * F.col(f"{f}_dev") + STEP) for f in feats)
    divergence = F.least(mass, F.lit(0.0))
    far = slope * slope + residual * residual + divergence * divergence > EXTREME * EXTREME
    sentences = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("mass"), F.col("mass_mid")), F.lit(1.0)))
    loose = (1 - sentences) * F.col("n") / (F.col("n") + F.col("other"))
    alike = (F.col("language") != "") & (F.col("n") >= CURVE_WORDS) & (F.coalesce("pages", F.lit(0)) >= CURVE_PAGES)
    return z.where(far | ~alike).select("page", "language", "near", F.when(alike & (loose > CLEAR), F.lit(True)).alias("spam"))


def found(documents: DataFrame) -> DataFrame:
    """doc_id of the spam pages."""
    docs = documents.select("doc_id", "text", "lang")
    pages = materialize(page_counts(docs), "pages")
    languages, heads = spoken(pages, language_heads(pages))
    fitted = materialize(curves(pages, languages), "curves")  # read three times
    candidates = small(materialize(judged(fitted), "judged"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for t, language, near in zip(*(b.column(i).to_pylist() for i in range(1, 4))):
                words = frozenset(w for l in {language, *near} for w in heads.get(l, ()))
                keep.append(stuffed_share(t, words) > 0.5)
            yield b.select(["doc_id"]).filter(pa.array(keep, pa.bool_()))

    kind = documents.schema["doc_id"].dataType.simpleString()
    texts = docs.where(F.length("text") > 0).withColumn("page", F.xxhash64("doc_id", "text"))
    clear = texts.select("doc_id", "page").join(candidates.where("spam"), "page", "left_semi").select("doc_id")
    unclear = texts.join(candidates.where("spam IS NULL"), "page").select("doc_id", "text", "language", "near")
    return clear.unionByName(unclear.mapInArrow(measure, f"doc_id {kind}"))
