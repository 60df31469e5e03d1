"""Problem 3: one form for text that looks the same but is built from other characters.

``fold`` brings a string to its visible form: compatibility normalisation (NFKC, composed), every space
mapped to the plain one, default-ignorable characters removed, and look-alike letters inside words of
another script replaced by the letters they imitate (not symbols in their place, as in TNFα). ``key`` adds full case folding and collapsed spacing,
so that two strings that read alike compare equal.

Work is vectorised per distinct value: an Arrow batch is dictionary-encoded, pure-ASCII values skip Python
altogether, and only the remaining distinct values are folded.

Defined results: NULL stays NULL and is never a case; '' stays ''; repeated rows give repeated rows; other
columns of the input are kept as they are; very long texts are processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones.
CYRILLIC_AS_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХЬаеѕіјорсухԁһԛԝӏ", "ABESIJKMHOPCTYXbaesijopcyxdhqwl", strict=True))
GREEK_AS_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορικυτχ", "ABEZHIKMNOPTYXavopikutx", strict=True)) | {"ϲ": "c", "ϳ": "j"}
ARMENIAN_AS_LATIN = dict(zip("օոսհցՕՍ", "onuhgOU", strict=True))
CHEROKEE_AS_LATIN = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZVSLCPKB", strict=True))
LATIN_LIKE = CYRILLIC_AS_LATIN | GREEK_AS_LATIN | ARMENIAN_AS_LATIN | CHEROKEE_AS_LATIN
#: Greek letters that are symbols of their own inside Latin words (NFκB, TNFα): an imitation only amid small letters.
SYMBOLS = set("ανρικυτχ")
#: What stands for a Latin letter inside a word of another script.
AS_CYRILLIC = {v: k for k, v in CYRILLIC_AS_LATIN.items()}
AS_GREEK = {v: k for k, v in GREEK_AS_LATIN.items()}
#: Look-alikes so close that a whole word made of them, amid Latin text, is read as Latin.
EXACT = set("АВЕЅІЈКМНОРСТХаеѕіјорсухΑΒΕΖΗΙΚΜΝΟΡΤΧο")
HYPHENS = "‐‑"
#: Decompositions that change the look: superscripts, fractions, circled signs. They are symbols in their place.
SYMBOL_TAGS = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<vertical>", "<small>")

_HYPHEN = re.compile("[‐‑]")
_FOREIGN = re.compile("[Ͱ-ϿЀ-֏Ꭰ-Ᏼἀ-῿]")
#: A word that holds a letter of another script.
_WORD = re.compile(r"(?<![^\W\d_])(?:(?![Ͱ-ϿЀ-֏Ꭰ-Ᏼἀ-῿])[^\W\d_][̀-ͯ]*)*[Ͱ-ϿЀ-֏Ꭰ-Ᏼἀ-῿][^\W\d_]*(?:[̀-ͯ]+[^\W\d_]*)*")
# Default-ignorable code points: Cf and fillers, variation selectors, tags, Mongolian separators, combining grapheme joiner.
_IGNORABLE = re.compile(
    "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
    "￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)
_SPACES = re.compile("[   -     　]")


def _script(ch: str) -> str:
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x530 <= o < 0x590:
        return "armenian"
    return "cherokee" if 0x13A0 <= o < 0x13F5 else "other"


def _imitates(w: str, i: int) -> bool:
    """Whether letter i of a Latin word, which looks like a Latin one, stands for it and isn't a symbol in its place."""
    small = lambda c: "a" <= c <= "z"
    if w[i] not in SYMBOLS:
        return True
    if i and i + 1 < len(w):
        return small(w[i - 1]) and small(w[i + 1])
    return i == 0 and len(w) > 3 and all(map(small, w[1:4]))


def _word(m: re.Match[str], text: str) -> str:
    w = m.group()
    letters = [c for c in w if not unicodedata.combining(c)]
    scripts = {_script(c) for c in letters}
    if scripts <= {"latin", "other"}:
        return w
    if "latin" in scripts:
        own = [c for c in letters if _script(c) != "latin"]
        if len(scripts) == 2 and len(own) > len(letters) - len(own) and any(c not in LATIN_LIKE for c in own):
            back = AS_CYRILLIC if "cyrillic" in scripts else AS_GREEK if "greek" in scripts else {}
            return "".join(back.get(c, c) if _script(c) == "latin" else c for c in w)
        w = "".join(c if c in SYMBOLS else LATIN_LIKE.get(c, c) for c in w)
        return "".join(LATIN_LIKE[c] if c in LATIN_LIKE and _imitates(w, i) else c for i, c in enumerate(w))
    if len(scripts - {"other"}) > 1:
        return "".join(LATIN_LIKE.get(c, c) for c in w)
    if all(c in EXACT for c in w) and _mostly_latin(text):
        return "".join(LATIN_LIKE[c] for c in w)
    return w


def fold(s: str) -> str:
    """The visible form of s; case and plain spacing stay."""
    if s.isascii():
        return s
    t = _HYPHEN.sub("-", _SPACES.sub(" ", _IGNORABLE.sub("", s)))
    if not unicodedata.is_normalized("NFKC", t):
        t = _IGNORABLE.sub("", _SPACES.sub(" ", unicodedata.normalize("NFKC", t)))
    if _FOREIGN.search(t):
        whole = t
        t = _WORD.sub(lambda m: _word(m, whole), t)
    return t


def _mostly_latin(s: str) -> bool:
    letters = Counter(c for c in s if c.isalpha())
    return 2 * sum(n for c, n in letters.items() if _script(c) == "latin") >= letters.total()


def key(s: str) -> str:
    """The form that compares equal: visible form, full case folding, collapsed spacing."""
    t = fold(s).casefold()
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    return " ".join(t.split())


def is_case(s: str) -> bool:
    """Whether s holds an invisible character, a space other than the plain one, or a stand-in."""
    if s.isascii():
        return False
    if _IGNORABLE.search(s) or _SPACES.search(s) or unicodedata.normalize("NFC", s) != s:
        return True
    for c in set(s):
        if ord(c) > 126:
            d = unicodedata.decomposition(c)
            if c in HYPHENS or (d.startswith("<") and not d.startswith(SYMBOL_TAGS) and not _looks_other(c, d)):
                return True
    if not _FOREIGN.search(s):
        return False
    return _WORD.sub(lambda m: _word(m, s), s) != s


def _looks_other(c: str, d: str) -> bool:
    """<compat> characters that do not look like their expansion (ellipsis and ligatures do; signs like the trade mark don't)."""
    return d.startswith("<compat>") and not (0xFB00 <= ord(c) <= 0xFB4F or c in "ſ…ĳĲŉǆǇǈǉǊǋǌǅǄ" or 0x2160 <= ord(c) <= 0x217F)


def _vectorised(column: pa.ChunkedArray | pa.Array, fn, kind: pa.DataType, ascii_fn) -> pa.Array:
    """fn over the distinct non-ASCII values of column, ascii_fn (Arrow kernels) over all others."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    code = column.dictionary_encode()
    values = code.dictionary
    plain = pc.string_is_ascii(values).to_pylist()
    cheap = ascii_fn(values).to_pylist()
    folded = [cheap[i] if plain[i] else fn(v) for i, v in enumerate(values.to_pylist())]
    return pa.array(folded, type=kind).take(code.indices)


def normalize_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds <c>_visible, <c>_key and <c>_case for each text column c; names that exist already are an error."""
    new = [(f"{c}_{k}", t) for c in columns for k, t in (("visible", "string"), ("key", "string"), ("case", "boolean"))]
    if clash := {n.lower() for n, _ in new} & {n.lower() for n in df.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *(f"`{n}` {t}" for n, t in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays, names = list(b.columns), list(b.schema.names)
            for c in columns:
                col = pc.cast(b.column(names.index(c)), pa.string())
                arrays += [
                    _vectorised(col, fold, pa.string(), lambda v: v),
                    _vectorised(col, key, pa.string(), lambda v: pc.ascii_lower(pc.utf8_trim_whitespace(pc.replace_substring_regex(v, r"\s+", " ")))),
                    _vectorised(col, is_case, pa.bool_(), lambda v: pa.array([False] * len(v), pa.bool_())),
                ]
            yield pa.RecordBatch.from_arrays(arrays, names=names + [f"{c}_{k}" for c in columns for k in ("visible", "key", "case")])

    return df.mapInArrow(run, schema)


def found(papers: DataFrame) -> DataFrame:
    """(rec_id, col) of every title or abstract that is a case, by normalize_columns."""
    flagged = normalize_columns(papers.select("rec_id", "title", "abstract"), ["title", "abstract"])
    cols: list[Column] = [F.when(F.col(f"{c}_case"), F.lit(c)) for c in ("title", "abstract")]
    return flagged.where(F.col("title_case") | F.col("abstract_case")).select("rec_id", F.explode(F.array_compact(F.array(*cols))).alias("col"))


def keys(papers: DataFrame) -> DataFrame:
    """One row per record and text column with its key, for joins of equal-looking titles."""
    n = normalize_columns(papers.select("rec_id", "title", "abstract"), ["title", "abstract"])
    return n.select("rec_id", "title_key", "abstract_key")
