"""Problem 2: records of two sources that describe the same paper, without a common key.

A deterministic cascade of rules. Each rule is an exact join on a weaker combination of attributes than the one
before (identifier with author or title word, title with author, title with year, title words with author, title
without any one of its words). A pair that a rule resolves is not asked again by a weaker one; as the joins are exact,
all of them are one join on keys that carry their rule, and the first rule that reaches a pair is its own. Each pair
is verified once by comparing title words (spelling slips, line-break hyphens, cut titles, version remarks), authors'
surnames and years. A work goes to the paper that fits best, and to all others that agree in everything. Each rule's
confidence is the precision on its own pairs that identifiers can judge, smoothed.

Keys are always combinations, so that an identifier or a name shared by a third of all rows does not pair them;
records of one paper (a duplicate group) are reduced to their different spellings before they are joined, and are
expanded again at the end. All copies and all listings are paired; no pair is capped.

Defined results: records without a usable title are paired only by identifier and author; NULL or empty authors
and years neither help nor hinder; repeated rows give one pair; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .canon import edits
from .common import materialize, small, spread
from .visual import fold, key

#: Prior of a rule's precision: so many right and wrong labels are added.
RIGHT, WRONG = 4.0, 1.0
#: Distinct titles or author lists that a worker remembers.
CACHE = 100_000
# Small words, first words that make another paper, remarks on the version of a text.
SMALL = frozenset("a an the of for in on with using by via to and from is are at as under through".split())
LEADS = frozenset(
    "comment comments erratum errata corrigendum correction addendum reply response retraction note notes survey review rethinking revisiting revisited towards toward beyond reproducing reproducibility replication discussion supplement part introduction".split()
)
REMARKS = re.compile(
    r"(?:[\s\-–—:,(\[]+(?:oral(?: presentation)?|poster|spotlight|extended abstract|(?:author|accepted|camera[- ]ready|long|short|full|arxiv|published|online|conference|journal)(?:'s)? version|author accepted manuscript|e?-?preprint|draft|to appear|supplementary material)[)\]]*\s*[*.†‡]*)+\s*$"
)
CUT = re.compile(r"(?:\.\.\.|…|\[\.\.\.\]|\(truncated\))\s*$")
_WORD = re.compile(r"[^\W_]+")
_LATEX = re.compile(r"\\[a-zA-Z]+\*?\s*(?=\{)|\\[a-zA-Z]+\s?|[{}$~^]")
_TAG = re.compile(r"</?[a-zA-Z]{1,8}/?>")
_MARK = re.compile("[\u0300-\u036f]")
_LIST = re.compile(r"\s*[;|&]\s*|\s+and\s+")
_NO_WORD = re.compile(r"\W")
_BROKEN = re.compile(r"(?<=[^\W\d_])-\s+(?=[^\W\d_])")
RULES = ("doi", "arxiv", "title_author", "title_year", "words_author", "title_but_one")


def unaccented(s: str) -> str:
    return s if s.isascii() else _MARK.sub("", unicodedata.normalize("NFD", s))


def title_words(title: str | None) -> tuple[list[str], bool]:
    """Content words of a title and whether it is marked as cut."""
    t = _LATEX.sub("", _TAG.sub("", title or "")).replace("--", "-")
    t = unaccented(key(t)).strip()
    if t in ("n/a", "none", "null", "untitled", "unknown", "-"):
        return [], False
    t = REMARKS.sub("", t)
    cut = bool(CUT.search(t))
    t = _BROKEN.sub("", CUT.sub("", t))
    words = [w.replace("isation", "ization") for w in _WORD.findall(t)]
    if cut and len(words) > 1 and any(x.startswith(words[-1]) for x in SMALL):
        words.pop()  # the rest of a small word
    return [w for w in words if w not in SMALL] or words, cut


def surnames(authors: list[str | None] | None) -> list[str]:
    """Surnames in order; packed lists are split, 'et al.' and blanks dropped."""
    out: list[str] = []
    if not authors:
        return out
    packed = unaccented(fold("\n".join(a for a in authors if a)).casefold())
    for a in packed.split("\n"):
        for x in _LIST.split(a) if ";" in a or "|" in a or "&" in a or " and " in a else (a,):
            y = x.strip(" .,\t\r")
            if not y or y in ("et al", "others", "et alii", "anonymous", "unknown", "n/a"):
                continue
            parts = (y.removesuffix(" et al") if y.endswith(" et al") else y).split()
            # "Stone, Ann", "Stone A." and "Ann Stone"
            last = y.split(",")[0] if "," in y else parts[0] if len(parts) > 1 and len(parts[-1].replace(".", "")) < 2 else parts[-1]
            if not last.isalnum():
                last = _NO_WORD.sub("", last)
            if last:
                out.append(last)
    return out


def doi_of(doi: str | None) -> str:
    d = re.sub(r"^(?:https?://[^/]*/|doi:\s*)", "", key(doi or ""))
    return "" if d.startswith("10.48550/arxiv.") or not d.startswith("10.") else d


def arxiv_of(arxiv_id: str | None, doi: str | None, url: str | None = None) -> str:
    a = re.sub(r"^arxiv:\s*|^https?://[^ ]*/(?:abs|pdf)/", "", key(arxiv_id or ""))
    if not a and (m := re.search(r"10\.48550/arxiv\.(\S+)", key(doi or ""))):
        a = m.group(1)
    return re.sub(r"v\d+$|\.pdf$", "", a)


def features(df: DataFrame, id_col: str) -> DataFrame:
    """(id, words, cut, names, year, doi, arxiv, long): one row per record; long: its longest words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        titles: dict[str | None, tuple[list[str], bool, list[str]]] = {}
        people: dict[tuple[str | None, ...], list[str]] = {}  # copies of a record repeat both
        for b in batches:
            rows = []
            if len(titles) > CACHE or len(people) > CACHE:
                titles.clear()
                people.clear()
            for i, title, authors, year, doi, arxiv in zip(*(b.column(k).to_pylist() for k in range(6))):
                known = titles.get(title)
                if known is None:
                    words, cut = title_words(title)
                    known = titles[title] = (words, cut, sorted(set(words), key=lambda w: (-len(w), w))[:2])
                who = tuple(authors or ())
                names = people.get(who)
                if names is None:
                    names = people[who] = surnames(authors)
                rows.append((i, known[0], known[1], names, year, doi_of(doi), arxiv_of(arxiv, doi), known[2]))
            cols = list(zip(*rows)) or [()] * 8
            texts = pa.list_(pa.string())
            kinds = [pa.int64(), texts, pa.bool_(), texts, pa.int32(), pa.string(), pa.string(), texts]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=["id", "words", "cut", "names", "year", "doi", "arxiv", "long"])

    src = df.select(F.col(id_col).cast("long"), "title", "authors", F.col("year").cast("int"), "doi", "arxiv_id")
    return spread(src).mapInArrow(run, "id long, words array<string>, cut boolean, names array<string>, year int, doi string, arxiv string, long array<string>")


def rule_keys(rule: str, spread_years: bool) -> Column:
    """The (hashed) join keys of a record by one rule. spread_years: the side whose keys cover the years beside its own.

    The other side also has a key for any year, which records without a year use, and both have one for no year.
    """
    told = F.array_distinct(F.concat("long", F.slice("words", 1, 1)))
    whole = F.array_join("words", "")
    y = F.col("year")
    if spread_years:
        years = F.when(y.isNull(), F.array(F.lit("any"), F.lit("none"))).otherwise(F.array(*((y + d).cast("string") for d in (-1, 0, 1)), F.lit("none")))
    else:
        years = F.when(y.isNull(), F.array(F.lit("none"), F.lit("any"))).otherwise(F.array(y.cast("string"), F.lit("any")))

    def both(a: Column, b: Column) -> Column:
        return F.flatten(F.transform(a, lambda x: F.transform(b, lambda z: F.xxhash64(F.lit(rule), x, z))))

    if rule in ("doi", "arxiv"):
        marks = F.concat(F.transform(F.slice("names", 1, 1), lambda n: F.concat(F.lit("@"), n)), F.col("long"))
        keys = F.when(F.col(rule) != "", both(F.array(F.col(rule)), marks))
    elif rule == "title_author":
        keys = F.when(whole != "", both(F.array(whole), F.array_distinct(F.col("names"))))
    elif rule == "title_year":
        keys = F.when(F.size("words") > 1, both(F.array(whole), years))
    elif rule == "words_author":
        keys = both(both(told, F.array_distinct(F.slice("names", 1, 3))), years)
    else:  # titles that differ in one word: both without it
        but = F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.xxhash64(F.lit(rule), F.array_join(F.concat(F.slice("words", F.lit(1), i - 1), F.slice("words", i + 1, F.size("words"))), "")))
        keys = F.when(F.size("words") > 3, F.concat(but, F.array(F.xxhash64(F.lit(rule), whole))))
    return F.array_distinct(F.coalesce(keys, F.array().cast("array<bigint>")))


def all_keys(df: DataFrame, id_col: str, spread_years: bool) -> DataFrame:
    """(id, key, rule): the keys of every rule, rule as its bit."""

    def of_rule(n: int, rule: str) -> Column:
        return F.transform(rule_keys(rule, spread_years), lambda k: F.struct(k.alias("key"), F.lit(1 << n).alias("rule")))

    each = F.concat(*(of_rule(n, r) for n, r in enumerate(RULES)))
    return df.select(id_col, F.inline(each))


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    n = min(len(a), len(b))
    most = 0 if n < 4 else 1 if n < 7 else 2
    return most > 0 and edits(a, b, most) <= most


def title_relation(a: list[str], b: list[str], cut_a: bool, cut_b: bool) -> float:
    """1 for equal titles, less for slips, a left-out word (.8) or a cut title (.6 marked, .5 not); 0 for different ones."""
    if not a or not b:
        return 0.0
    if a == b or "".join(a) == "".join(b):
        return 1.0 if not (cut_a or cut_b) else 0.9
    s, t, marked = (a, b, cut_a) if len("".join(a)) <= len("".join(b)) else (b, a, cut_b)
    last = t[len(s) - 1] if len(s) <= len(t) else ""
    whole = _alike(s[-1], last)
    if last and all(_alike(x, y) for x, y in zip(s[:-1], t)) and (whole or last.startswith(s[-1]) or len(s[-1]) > 5 and _alike(s[-1], last[: len(s[-1])])):
        if len(s) == len(t) and whole:
            return 0.9
        if len(s) >= 3:
            return 0.6 if marked else 0.5 if whole else 0.55
        if len(s[0]) >= 6 and not marked:  # the name without the rest of the title
            return 0.45
    if abs(len(a) - len(b)) > 2:
        return 0.0
    # alignment of words: slips cost .3, words split or joined .2, one left-out word inside 1
    na, nb = len(a), len(b)
    far = 9.0
    cost = [[far] * (nb + 1) for _ in range(na + 1)]
    cost[0][0] = 0.0
    for i in range(na + 1):
        for j in range(nb + 1):
            c = cost[i][j]
            if c >= 2.5:
                continue
            if i < na and j < nb:
                if a[i] == b[j]:
                    cost[i + 1][j + 1] = min(cost[i + 1][j + 1], c)
                elif _alike(a[i], b[j]):
                    cost[i + 1][j + 1] = min(cost[i + 1][j + 1], c + 0.3)
            if i + 1 < na and j < nb and _alike(a[i] + a[i + 1], b[j]):
                cost[i + 2][j + 1] = min(cost[i + 2][j + 1], c + 0.2)
            if i < na and j + 1 < nb and _alike(a[i], b[j] + b[j + 1]):
                cost[i + 1][j + 2] = min(cost[i + 1][j + 2], c + 0.2)
            if (0 < i < na - 1 and 0 < j < nb) or (i == j == 0 and na > 4 and a[0] not in LEADS):
                cost[i + 1][j] = min(cost[i + 1][j], c + 1)
            if (0 < j < nb - 1 and 0 < i < na) or (i == j == 0 and nb > 4 and b[0] not in LEADS):
                cost[i][j + 1] = min(cost[i][j + 1], c + 1)
    c = cost[na][nb]
    if c <= 0.95:
        return 0.9
    return 0.8 if c <= 1.7 and min(na, nb) >= 3 else 0.0


def name_relation(a: list[str], b: list[str]) -> int:
    """2: the authors agree, 1: one list says nothing, 0: they disagree."""
    if not a or not b:
        return 1
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    met = sum(any(_alike(x, y) for y in large) for x in small)
    if _alike(a[0], b[0]) and met * 2 >= len(small):
        return 2
    return 2 if met * 3 >= len(small) * 2 else 0


def verdict(p: tuple, w: tuple) -> tuple[float, bool, bool]:
    """How well two records (words, cut, names, year, doi, arxiv) fit as one paper (0 if they don't), whether both tell
    authors and a year or enough of a title, and whether nothing differs."""
    p_words, p_cut, p_names, p_year, p_doi, p_arxiv = p
    w_words, w_cut, w_names, w_year, w_doi, w_arxiv = w
    none = (0.0, False, False)
    known = p_year is not None and w_year is not None
    gap = abs(p_year - w_year) if known else 0
    if gap > 2:
        return none
    names = name_relation(p_names, w_names)
    if names == 0:
        return none
    same_id = bool(p_doi and p_doi == w_doi or p_arxiv and p_arxiv == w_arxiv)
    told = bool(p_names and w_names)
    if not p_words or not w_words:
        return (0.7, told and w_year is not None, False) if same_id and names == 2 and gap <= 1 else none
    title = title_relation(p_words, w_words, p_cut, w_cut)
    if title == 0.0 or gap > (2 if same_id and title >= 0.8 else 1):
        return none
    if title < 0.8:  # a cut title fits its sequels as well
        if names < 2 and not same_id:
            return none
        if title == 0.5 and not (known or same_id):
            return none
        if title < 0.5 and names < 2:
            return none
    fit = title + 0.3 * (names == 2) + 0.1 * (known and gap == 0) + 0.05 * (known and gap == 1) + 0.3 * same_id
    return fit, told and (w_year is not None or title >= 0.5), title == 1.0 and names == 2


FIELDS = ("words", "cut", "names", "year", "doi", "arxiv")


def _verify(pairs: DataFrame) -> DataFrame:
    """(work, entity, rules, fit, sure, same) of pairs (work, entity, rules, p_..., w_...) that fit or that identifiers join."""
    ids = sum(1 << n for n, r in enumerate(RULES) if r in ("doi", "arxiv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, w = (list(zip(*(b.column(f"{side}_{f}").to_pylist() for f in FIELDS))) for side in "pw")
            got = [verdict(x, y) for x, y in zip(p, w)]
            out = b.select(["work", "entity", "rules"])
            for n, (name, kind) in enumerate((("fit", pa.float64()), ("sure", pa.bool_()), ("same", pa.bool_()))):
                out = out.append_column(name, pa.array([g[n] for g in got], kind))
            yield out.filter(pa.array([g[0] > 0 or bool(r & ids) for g, r in zip(got, b.column("rules").to_pylist())], pa.bool_()))

    return pairs.mapInArrow(run, "work long, entity long, rules int, fit double, sure boolean, same boolean")


def entities(papers: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(rec_id, entity): records known to be one paper share an entity, others stand alone."""
    recs = papers.select(F.col("rec_id").cast("long").alias("rec_id")).where(F.col("rec_id").isNotNull()).distinct()
    if groups is None:
        return recs.withColumn("entity", F.col("rec_id"))
    known = groups.where(F.col("rec_id").isNotNull() & F.col("group_id").isNotNull()).groupBy(F.col("rec_id").cast("long").alias("rec_id")).agg(F.min("group_id").alias("g"))
    return recs.join(known, "rec_id", "left").select("rec_id", F.coalesce(-F.col("g").cast("long") - 1, F.col("rec_id")).alias("entity"))


def link(papers: DataFrame, works: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(rec_id, work_id, rule, confidence): all pairs of a papers record and a works record of one paper."""
    member = materialize(entities(papers, groups), "entities")
    left = features(papers, "rec_id").join(member, F.col("id") == F.col("rec_id"))
    # different spellings of one paper; copies fall together here
    left = materialize(left.groupBy("entity", *FIELDS).agg(F.min("id").alias("sig"), F.first("long").alias("long")), "papers")
    right = materialize(features(works, "work_id").dropDuplicates(["id"]).withColumnRenamed("id", "work"), "works")
    a, b = all_keys(left, "sig", False), all_keys(right, "work", True).drop("rule")
    # the rules that reach a pair; the first of them resolves it, which is what anti-joining resolved pairs comes to
    pairs = a.join(b, "key").groupBy("work", "sig").agg(F.bit_or("rule").alias("rules"))
    pairs = pairs.join(left.select("sig", "entity", *(F.col(f).alias(f"p_{f}") for f in FIELDS)), "sig").drop("sig")
    pairs = pairs.join(small(right.select("work", *(F.col(f).alias(f"w_{f}") for f in FIELDS))), "work")
    fits = _verify(pairs).groupBy("work", "entity").agg(F.max("fit").alias("fit"), F.max("sure").alias("sure"), F.max("same").alias("same"), F.bit_or("rules").alias("rules"))
    # where authors or years are silent, two papers that fit equally well decide nothing
    own = Window.partitionBy("work")
    best = fits.withColumn("best", F.max("fit").over(own)).withColumn("ties", F.count_if(F.col("fit") >= F.col("best") - 1e-9).over(own))
    top = (F.col("fit") > 0) & (F.col("fit") >= F.col("best") - 1e-9)
    wins = F.col("same") | top & (F.col("sure") | (F.col("ties") == 1))
    judged = materialize(best.select("work", "entity", "rules", top.alias("top"), wins.alias("wins")), "judged")
    bits = {r: F.col("rules").bitwiseAND(1 << n) > 0 for n, r in enumerate(RULES)}
    by_id = bits["doi"] | bits["arxiv"]
    # titles and authors judge identifiers; what identifiers resolve judges the other rules
    told = judged.withColumn("true", F.max(by_id & F.col("wins")).over(own))
    counts = told.select(*(
        F.struct(F.count_if(bits[r] & (F.lit(True) if r in ("doi", "arxiv") else F.col("true") & F.col("top"))).alias("n"), F.count_if(bits[r] & F.col("wins") & (F.lit(True) if r in ("doi", "arxiv") else F.col("true") & by_id)).alias("right")).alias(r) for r in RULES
    )).first()
    rate = F.coalesce(*(F.when(bits[r], F.lit((counts[r]["right"] + RIGHT) / (max(counts[r]["n"], counts[r]["right"]) + RIGHT + WRONG))) for r in RULES))
    rule = F.coalesce(*(F.when(bits[r], F.lit(r)) for r in RULES))
    resolved = judged.where("wins").select("work", "entity", rule.alias("rule"), rate.alias("confidence"))
    return resolved.join(member, "entity").groupBy("rec_id", F.col("work").alias("work_id")).agg(
        F.max_by("rule", "confidence").alias("rule"), F.max("confidence").alias("confidence")
    )


def found(papers: DataFrame, works: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    return link(papers, works, groups).select("rec_id", "work_id")
