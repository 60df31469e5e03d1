"""Problem 1: freely typed names led to the entries of a catalogue.

A multi-pattern automaton over the catalogue's names and keys (compact form: letters and digits only) finds the
names embedded in a typed value; matches must begin and end at word edges, and the longest non-overlapping match
wins, provided that what remains are words that say nothing about identity (sizes, versions, splits, "the",
"dataset", remarks in brackets). Values without such a match go to token-set similarity: every word of a name must
be met by a typed word, exactly or within two edits, typed words left over must again be mere qualifiers, and the
name that meets most words with fewest edits wins. Values that fit no entry, or two equally well, are unmatched. A value of the letters of several words' beginnings is led to the
only name that has these initials.

Every name has an anchor, its rarest word. A typed word meets the anchors within reach by pieces that survive the
slips (``Pieces``), so that all names in question are compared, and no others; none is left out for being one of many.

Matching is done once per distinct value of an Arrow batch and kept in a bounded cache of the worker; there is no
shuffle, so skewed values cost nothing. A catalogue of at most ``BLOCK`` names travels to the workers as it is. A
larger one is matched in blocks against the distinct values: what is unique, common or an edition is counted over the
whole catalogue first, each block makes its claims, and all claims on a value are decided together, as in one block.
The catalogue itself is read by the driver; more than ``MOST`` names are an error.

Defined results: NULL and blank elements give no row; values without an entry give ''; NULL or empty lists give no
row; repeated elements give repeated rows with their own position; catalogue rows with NULL name are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted, spread
from .visual import key

BLOCK, MOST = 50_000, 1_000_000
CACHE = 500_000
# Words that say nothing about which dataset is meant, and small words inside names.
QUALIFIERS = (
    "the a an our ours this its of from on in and for with see split splits subset subsets set sets test train training dev val valid validation eval "
    "evaluation dataset datasets data corpus corpora benchmark benchmarks collection full lite small large mini tiny base big medium xl "
    "version ver release edition table tab fig figure appendix section sec copy house inhouse only part portion sample version new"
).split()
SMALL = {"of", "for", "the", "on", "in", "and", "a", "an", "to"}
_SIZE = re.compile(r"(?:v?\d+(?:\.\d+)*[kmbg]?|v)\Z")
_TOKEN = re.compile(r"[^\W_]+")
_DOTTED = re.compile(r"\b(?:[^\W\d_]\.){2,}[^\W\d_]?\b")
_LONG_FORM = re.compile(r"\bquestion[\W_]*answering\b")


def plain(s: str) -> str:
    """Visible key without accents; a zero between letters is an o."""
    t = key(s)
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    t = re.sub(r"(?<![\d])0(?=[^\W\d_])(?![kmbg]\b)", "o", t)
    return re.sub(r"(?<=[^\W\d_])0(?![\d])", "o", t)


def tokens(s: str) -> list[str]:
    t = _LONG_FORM.sub("qa", plain(s))
    return _TOKEN.findall(_DOTTED.sub(lambda m: m.group().replace(".", ""), t))


def edits(a: str, b: str, most: int) -> int:
    """Letters left out, added, replaced or swapped with a neighbour (what stood between them may be gone), or most + 1 if more."""
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    while la and lb and a[la - 1] == b[lb - 1]:
        la, lb = la - 1, lb - 1
    s = 0
    while s < la and s < lb and a[s] == b[s]:
        s += 1
    a, b, la, lb = a[s:la], b[s:lb], la - s, lb - s
    if not la or not lb:
        return min(la + lb, most + 1)
    far = most + 1
    rows, last = [[min(j, far) for j in range(lb + 1)]], {}  # last: the row of the latest place of each letter of a
    for i in range(1, la + 1):
        x, before, cur, match = a[i - 1], rows[-1], [far] * (lb + 1), 0
        if i <= most:
            cur[0] = i
        low, best = max(1, i - most), cur[0]  # cells further from the diagonal cost more than most
        if low > 1 and x in b[: low - 1]:
            match = b.rindex(x, 0, low - 1) + 1
        for j in range(low, min(lb, i + most) + 1):
            y = b[j - 1]
            if x == y:
                v, seen = before[j - 1], j
            else:
                v, seen = min(before[j], cur[j - 1], before[j - 1]) + 1, match
                if match and (k := last.get(y)):
                    v = min(v, rows[k - 1][match - 1] + (i - k) + (j - match) - 1)
            match = seen
            cur[j] = v
            if v < best:
                best = v
        if best > most and min(before) > most:
            return far
        last[x] = i
        rows.append(cur)
    return min(rows[-1][lb], far)


def allowed(n: int) -> int:
    return 0 if n < 4 else 1 if n < 6 else 2


def shortened(s: str) -> set[str]:
    """s, and s without any one of its letters."""
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}


def letters(s: str) -> int:
    """The letters of s as bits; a slip changes two of them at most."""
    bits = 0
    for c in s:
        bits |= 1 << (ord(c) & 63)
    return bits


class Pieces:
    """Strings with their slips, found by pieces that survive them.

    With one slip two strings share a form shortened by a letter at most, with two a form shortened by two. Of a long
    string cut in two, one part holds one slip at most; there are two cuts, as a swap of neighbours over the one is
    whole under the other.
    """

    def __init__(self, slips: dict[str, int]) -> None:
        self.slips = slips
        self.bits = {w: letters(w) for w in slips}
        self.at: dict[str, set[str]] = defaultdict(set)
        for w, d in slips.items():
            if d == 0:
                self.at["=" + w].add(w)
            elif d == 1:
                for v in shortened(w):
                    self.at["1" + v].add(w)
            elif len(w) < 10:
                for v in {x for y in shortened(w) for x in shortened(y)}:
                    self.at["2" + v].add(w)
            else:
                for h in (len(w) // 2, len(w) // 2 + 1):
                    for tag, part in (("<", w[:h]), (">", w[h:])):
                        for v in shortened(part):
                            self.at[tag + v].add(w)
        sizes = [len(w) for w, d in slips.items() if d >= 2]
        self.longest = max(sizes, default=0)
        self.most = max(slips.values(), default=0)

    def near(self, t: str) -> list[tuple[str, int]]:
        """(string, slips) of all that t may be a slip of."""
        n, at, met = len(t), self.at, set(self.at.get("=" + t, ()))
        ways = []
        if 3 <= n <= 6:
            ways += ["1" + v for v in shortened(t)]
        if 4 <= n <= 11:
            ways += ["2" + v for v in {x for y in shortened(t) for x in shortened(y)}]
        if n + self.most >= 10:
            low, high = max(10, n - self.most), min(n + self.most, self.longest)
            cuts = {h for size in range(low, high + 1) for h in (size // 2, size // 2 + 1)}
            rests = {size - h for size in range(low, high + 1) for h in (size // 2, size // 2 + 1)}
            ways += ["<" + v for h in {h + x for h in cuts for x in (-1, 0, 1)} if h <= n for v in shortened(t[:h])]
            ways += [">" + v for r in {r + x for r in rests for x in (-1, 0, 1)} if 0 < r <= n for v in shortened(t[n - r :])]
        for w in ways:
            if w in at:
                met |= at[w]
        bits, out = letters(t), []
        for w in met:
            d = self.slips[w]
            if abs(len(w) - n) <= d and (self.bits[w] ^ bits).bit_count() <= 2 * d and (e := edits(w, t, d)) <= d:
                out.append((w, e))
        return out


@dataclass
class Known:
    """What holds of the whole catalogue, and so in every block of it."""

    editions: set[str]
    initials: set[str]
    editions_of: dict[str, str]
    inside: set[str]


@dataclass
class Name:
    name: str
    words: list[str]
    form: str
    patterns: list[str]
    initials: str
    anchor: str


def prepare(entries: Iterable[tuple[str | None, str]]) -> tuple[list[Name], Known]:
    """The names of a catalogue of (key, name) with what sets them apart, and what they have in common."""
    entries = sorted({(k or "", n) for k, n in entries if n and n.strip()})
    names = sorted({n for _, n in entries})
    words = {n: [t for t in tokens(n) if t not in SMALL] or tokens(n) for n in names}
    form = {n: "".join(tokens(n)) for n in names}
    patterns: dict[str, set[str]] = defaultdict(set)
    for n in names:
        patterns[form[n]].add(n)
    for k, n in entries:  # keys are aliases; a name's own form comes first
        k = "".join(tokens(k))
        if k and k not in patterns or k in patterns and n in patterns[k]:
            patterns[k].add(n)
    exact = {p: next(iter(s)) for p, s in patterns.items() if len(s) == 1 and p}
    own: dict[str, list[str]] = defaultdict(list)
    for p, n in exact.items():
        own[n].append(p)
    short: dict[str, set[str]] = defaultdict(set)
    for n in names:
        raw = [t for t in _TOKEN.findall(key(n)) if t not in SMALL]
        if len(raw) >= 4:
            short["".join(t[0] for t in raw)].add(n)
    only = {next(iter(s)): a for a, s in short.items() if len(s) == 1 and a not in exact}
    # words by which a name extends another one are editions ("... Night")
    have = {tuple(w) for w in words.values()}
    editions = {w[-1] for w in words.values() if tuple(w[:-1]) in have}
    df = Counter(t for w in words.values() for t in set(w))
    known = Known(editions, set(short), {}, set())
    known.editions_of = {p: n for p, n in exact.items() if any(p[i:] in editions and p[:i] in exact for i in range(1, len(p)))}
    known.inside = {t for t in df if is_mere(t, known)}
    return [Name(n, words[n], form[n], own[n], only.get(n, ""), min(words[n], key=lambda t: (df[t], -len(t), t), default="")) for n in names], known


QUALIFIER_SET = set(QUALIFIERS)
_QUALIFIER_FORMS = {v for q in QUALIFIERS if len(q) >= 5 for v in shortened(q)}


def is_mere(t: str, known: Known) -> bool:
    """Whether t is a qualifier, or a slip of one, and no part of an identity."""
    if _SIZE.match(t) or t in QUALIFIER_SET or t in known.editions or len(t) == 1 or t in known.initials:
        return True
    return len(t) >= 4 and not _QUALIFIER_FORMS.isdisjoint(shortened(t)) and any(len(q) >= 5 and edits(q, t, 1) <= 1 for q in QUALIFIERS)


@dataclass(frozen=True, order=True)
class Claim:
    """What a block has for a value. stage: 4 the whole value, 3 embedded, 2 initials, 1 token sets, 0 joined words."""

    stage: int
    first: float
    second: float
    fits: bool
    name: str


def decide(claims: list[Claim]) -> str:
    """The name that the claims of all blocks come to, '' for none."""
    for stage in (4, 3, 2, 1, 0):
        own = [c for c in claims if c.stage == stage]
        if not own:
            continue
        top = max((c.first, c.second) for c in own)
        best = [c for c in own if (c.first, c.second) == top]
        if stage == 3 and not best[0].fits:
            continue
        return best[0].name if len({c.name for c in best}) == 1 else ""
    return ""


class Catalogue:
    """Automaton and token index over the names of one block."""

    def __init__(self, names: list[Name], known: Known) -> None:
        import ahocorasick

        self.known = known
        self.exact = {p: n for n in names for p in n.patterns}
        self.initials = {n.initials: n for n in names if n.initials}
        self.automaton = ahocorasick.Automaton()
        for p, n in self.exact.items():
            self.automaton.add_word(p, (len(p), n))
        if self.exact:
            self.automaton.make_automaton()
        self.anchored: dict[str, list[Name]] = defaultdict(list)
        self.joined: dict[str, list[Name]] = defaultdict(list)
        for n in names:
            if n.words:
                self.anchored[n.anchor].append(n)
            for f in {"".join(n.words), n.form} - {""}:
                self.joined[f].append(n)
        self.anchors = Pieces({a: allowed(len(a)) for a in self.anchored})
        self.forms = Pieces({f: min(2, allowed(len(f))) for f in self.joined})
        self.known_mere: dict[str, bool] = {}
        self.known_near: dict[str, list[tuple[str, int]]] = {}

    def mere(self, t: str) -> bool:
        known = self.known_mere.get(t)
        if known is None:
            if len(self.known_mere) > CACHE:
                self.known_mere.clear()
            known = self.known_mere[t] = is_mere(t, self.known)
        return known

    def near(self, t: str) -> list[tuple[str, int]]:
        known = self.known_near.get(t)
        if known is None:
            if len(self.known_near) > CACHE:
                self.known_near.clear()
            known = self.known_near[t] = self.anchors.near(t)
        return known

    def embedded(self, typed: list[str]) -> Claim | None:
        """Longest match at word edges; it fits if the rest consists of qualifiers."""
        if not self.exact:
            return None
        whole = "".join(typed)
        word_of = [n for n, t in enumerate(typed) for _ in t]
        edge = [n == 0 or word_of[n] != word_of[n - 1] for n in range(len(whole))] + [True]
        best = None
        for end, (length, n) in self.automaton.iter(whole):
            a, b = end + 1 - length, end + 1
            # a qualifier may be written together with the name: its rest of the word must then be one
            if (edge[a] or length >= 8 and self._glued(whole, edge, a, -1)) and (edge[b] or length >= 8 and self._glued(whole, edge, b, 1)):
                if best is None or (length, -a) > best[:2]:
                    best = (length, -a, b, n)
        if best is None:
            return None
        length, a, b, n = best[0], -best[1], best[2], best[3]
        rest = self._pieces(whole, edge, 0, a) + self._pieces(whole, edge, b, len(whole))
        editions = [t for t in rest if t in self.known.editions]
        # an edition catalogued under a name of its own, in another order or spelt apart
        if any(n.form + e in self.known.editions_of for e in editions):
            return Claim(3, length, -a, True, self.known.editions_of.get(n.form + editions[0], n.name))
        return Claim(3, length, -a, all(self.mere(t) for t in rest), n.name)

    @staticmethod
    def _pieces(whole: str, edge: list[bool], a: int, b: int) -> list[str]:
        at = [a, *(n for n in range(a + 1, b) if edge[n]), b]
        return [whole[x:y] for x, y in zip(at, at[1:]) if x < y]

    @staticmethod
    def _glued(whole: str, edge: list[bool], at: int, step: int) -> bool:
        end = at
        while not edge[end]:
            end += step
        rest = whole[min(at, end) : max(at, end)]
        return len(rest) >= 2 and bool(rest in QUALIFIER_SET or _SIZE.match(rest))

    def similar(self, typed: list[str], block: bool) -> list[Claim]:
        """Token-set similarity to every name whose anchor a typed word may mean, then to names whose words were joined or split."""
        scores: dict[str, tuple[float, float]] = {}
        for a in {a for t in set(typed) for a, _ in self.near(t)}:
            for n in self.anchored[a]:
                s = self._score(n, typed)
                if s is not None:
                    scores[n.name] = s
        stage = 1
        if block or not scores:
            claims = self._best(stage, scores)
            scores, stage = {}, 0
            kept = [[t for t in typed if not self.mere(t)], [t for t in typed if not self.mere(t) or t in self.known.inside], typed]
            for text in {"".join(k) for k in kept} - {""}:
                for f, e in self.forms.near(text):
                    for n in self.joined[f]:
                        scores[n.name] = max((float(len(n.words)), float(-e)), scores.get(n.name, (0.0, 0.0)))
            return claims + self._best(stage, scores)
        return self._best(stage, scores)

    @staticmethod
    def _best(stage: int, scores: dict[str, tuple[float, float]]) -> list[Claim]:
        top = max(scores.values(), default=None)
        return [Claim(stage, *s, True, name) for name, s in scores.items() if s == top]

    def _score(self, n: Name, typed: list[str]) -> tuple[float, float] | None:
        """(words met, - slips) if every word of the name is met by a typed one and the others say nothing."""
        free, cost, missing = list(typed), 0, []
        for t in n.words:
            if t in free:
                free.remove(t)
            else:
                missing.append(t)
        if len(missing) > len(free):
            return None
        for t in missing:
            most = allowed(len(t))
            bits = letters(t)
            options = [(e, k) for k, q in enumerate(free) if abs(len(q) - len(t)) <= most and (letters(q) ^ bits).bit_count() <= 2 * most and (e := edits(t, q, most)) <= most]
            if not options:
                return None
            e, k = min(options)
            free.pop(k)
            cost += e
        return (float(len(n.words)), float(-cost)) if cost <= 4 and all(self.mere(t) or t in SMALL for t in free) else None

    def claims(self, value: str, block: bool = True) -> list[Claim]:
        """All claims of this block on a value; those that decide, if the block is the whole catalogue."""
        typed = tokens(value)
        if not typed:
            return []
        n = self.exact.get("".join(typed))
        if n is not None:
            return [Claim(4, len(n.form), 0, True, n.name)]
        out = []
        e = self.embedded(typed)
        if e is not None:
            out.append(e)
            if e.fits and not block:
                return out
        kept = [t for t in typed if not self.mere(t) or t in self.known.initials]
        if len(kept) == 1 and kept[0] in self.initials:
            out.append(Claim(2, 0, 0, True, self.initials[kept[0]].name))
            if not block:
                return out
        return out + self.similar(typed, block)

    def match(self, value: str) -> str:
        return decide(self.claims(value, block=False))


def _by_value(df: DataFrame, value_col: str, kind: str, work: Callable[[], Callable[[str], object]]) -> DataFrame:
    """df with a column found: what the function made by work gives for each value of value_col, once per distinct one."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"found {kind}"])
    at, arrow = df.columns.index(value_col), pa.string() if kind == "string" else pa.list_(CLAIM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, known = work(), {}
        for b in batches:
            code = b.column(at).dictionary_encode()
            if len(known) > CACHE:
                known.clear()
            got = []
            for v in code.dictionary.to_pylist():
                if v not in known:
                    known[v] = one(v)
                got.append(known[v])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, arrow).take(code.indices)], names=[*b.schema.names, "found"])

    return df.mapInArrow(run, schema)


CLAIM = pa.struct([("stage", pa.int32()), ("first", pa.float64()), ("second", pa.float64()), ("fits", pa.bool_()), ("name", pa.string())])
_CLAIMS = "array<struct<stage:int,first:double,second:double,fits:boolean,name:string>>"


def found(scores: DataFrame, datasets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(score_id, pos, name) of every element of scores.datasets that is neither NULL nor blank."""
    typed = scores.select("score_id", F.posexplode("datasets").alias("pos", "value")).where(F.col("value").rlike("(?U)\\S"))
    rows = datasets.select("key", "name").where(F.col("name").isNotNull()).distinct().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a catalogue of more than {MOST} names")
    names, known = prepare((r["key"], r["name"]) for r in rows)
    if len(names) <= block:
        return _by_value(spread(typed), "value", "string", lambda: Catalogue(names, known).match).select("score_id", "pos", F.col("found").alias("name"))
    values = materialize(typed.select("value").distinct(), "values")

    def asked(own: list[Name]) -> DataFrame:
        return _by_value(values, "value", _CLAIMS, lambda: lambda v, c=Catalogue(own, known): [asdict(x) for x in c.claims(v)])

    parts = [asked(names[a : a + block]).select("value", F.explode("found").alias("c")) for a in range(0, len(names), block)]
    every = reduce(DataFrame.unionByName, parts).groupBy("value").agg(F.collect_list("c").alias("claims"))  # a few claims of each block

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decide([Claim(**c) for c in claims]) for claims in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], names=["value", "name"])

    meant = values.join(every.mapInArrow(settle, "value string, name string"), "value", "left").select("value", F.coalesce("name", F.lit("")).alias("name"))
    return salted(typed, materialize(meant, "meant"), ["value"]).select("score_id", "pos", "name")
