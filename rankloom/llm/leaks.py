"""Problem 7: passages of evaluation items inside a corpus.

All word k-grams of the items that hold a word of their own (one outside the runs of ``SHARED`` words that several items
have) are joined with all k-grams of every document, so any run of ``K`` equal words with an own one is a hit, even if
other items have these K words too. Winnowed k-grams would need longer runs: a quoted half with a replaced word in its
middle has none. Each hit is extended to both sides along its diagonal over single replaced words, neighbouring runs are
chained into places, and the own words held in the best two places, in the item's order, are counted.

What is shared is found by counting over all items. Items of up to ``BLOCK`` words together travel to the workers,
as arrays of 8 bytes a word and 32 a k-gram; beyond that the k-grams of documents and items are joined by
a shuffle, salted so that no passage is one task's, with equal rows. Documents are never gathered, cut or compared
with each other.

Defined results: NULL and empty texts give no rows; a document and an item give at most one row, however often
either is repeated; an item_id with several texts is found if one of them is; items without own wording of
sufficient length give none.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted, small, spread
from .visual import key

K = 4
WINDOW = 3
#: Words of own wording that make a leak.
LEAST = 20
#: Matched words below which a place does not count.
PLACE = 6
#: A run of so many words found in two items is shared wording.
SHARED = 8
#: Words of all items up to which they are sent to the workers.
BLOCK = 2_000_000
#: Distinct words whose hashes a worker remembers.
CACHE = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<(?:/?[a-zA-Z]|!)[^<>]*>")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([ntrbf\"'/\\]))")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-\u2010\u00ad]\s*\n\s*(?=[^\W\d_])")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _escaped(m: re.Match[str]) -> str:
    code = m.group(1) or m.group(2)
    return chr(int(code, 16)) if code else " "


def words(text: str) -> list[str]:
    """Words without markup, escapes, case, punctuation and odd characters."""
    t = text
    if "&" in t:
        t = html.unescape(t)
    if "\\" in t:
        t = _ESCAPE.sub(_escaped, t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    if "%20" in t:
        t = t.replace("%20", " ")
    if "\n" in t:
        t = _BROKEN.sub("", t)
    return _WORD.findall(key(t))


class Hashes(dict):
    """The hash of each word, remembered."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, text: str) -> list[int]:
        if len(self) > CACHE:
            self.clear()
        return [self[w] for w in words(text)]


def gram_hashes(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - K + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(K):
        h = (h ^ ids[j : n + j]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray) -> np.ndarray:
    """Positions of the smallest hash of each window (the rightmost of equal ones): fewer prints, for runs of K + WINDOW - 1
    words only. Leaks are found without it, by all k-grams."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.arange(len(h))[-1:] if not len(h) else np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    stack = np.stack([h[j : n + j] for j in range(WINDOW)][::-1])
    return np.unique(np.arange(n) + WINDOW - 1 - np.argmin(stack, axis=0))


def hashed_items(items: DataFrame) -> DataFrame:
    """(item_id, copy, words): the word hashes of every different text of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            lists = [np.array(hashes.of(t), dtype=np.uint64).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "words"])

    texts = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("item_id").isNotNull() & (F.length("text") > 0))
    rows = texts.mapInArrow(run, "item_id bigint, words array<bigint>").where(F.size("words") > 0)
    return rows.withColumn("copy", F.xxhash64("words")).dropDuplicates(["item_id", "copy"])


def prepared(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, copy, words, shared) and (h, item_id, copy, q): all items with the starts of their shared runs, counted
    over all items, and every k-gram that holds an own word, also if several items have it."""
    texts = materialize(hashed_items(items), "items")
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - (SHARED - 1)), lambda i: F.xxhash64(F.slice("words", i, SHARED)))
    each = texts.where(F.size("words") >= SHARED).select("item_id", "copy", F.posexplode(runs).alias("p", "run"))
    shared = each.groupBy("run").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).where("a < b").select("run")
    starts = each.join(small(materialize(shared, "shared")), "run", "left_semi").groupBy("item_id", "copy").agg(F.collect_list("p").alias("shared"))  # places of one text
    ready = texts.join(starts, ["item_id", "copy"], "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<int>")))
    ready = materialize(ready, "ready")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for item, copy, w, at in zip(*(b.column(k).to_pylist() for k in range(4))):
                a = np.array(w, dtype=np.int64).view(np.uint64)
                own, h = own_words(len(a), at), gram_hashes(a)
                p = np.flatnonzero(np.convolve(own, np.ones(K, dtype=int), "valid")) if len(h) else np.empty(0, dtype=np.int64)
                for k, v in enumerate((h[p].view(np.int64), np.full(len(p), item), np.full(len(p), copy), p.astype(np.int64))):
                    out[k].append(v)
            arrays = [pa.array(np.concatenate(c) if c else np.empty(0, dtype=np.int64), pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays(arrays, names=["h", "item_id", "copy", "q"])

    marks = ready.mapInArrow(run, "h bigint, item_id bigint, copy bigint, q bigint")
    return ready, materialize(marks, "marks")


def own_words(n: int, shared: list[int]) -> np.ndarray:
    """Which of n words lie in none of the shared runs that start at the given places."""
    own = np.ones(n, dtype=bool)
    for p in shared:
        own[p : p + SHARED] = False
    return own


def held(doc: list[int], item: list[int], own: np.ndarray, seeds: list[tuple[int, int]]) -> int:
    """Own words of the item that the document holds in its best two places."""
    runs, done = [], set()
    nd, ni = len(doc), len(item)
    for p, q in sorted(seeds):
        d = p - q
        if (d, p) in done:
            continue
        a, b = p, p + K  # [a, b) on the diagonal, extended while at most one word in a row differs
        while True:
            if b < nd and b - d < ni and doc[b] == item[b - d]:
                b += 1
            elif b + 1 < nd and b + 1 - d < ni and doc[b + 1] == item[b + 1 - d] and (b + 2 >= nd or b + 2 - d >= ni or doc[b + 2] == item[b + 2 - d]):
                b += 2
            else:
                break
        while True:
            if a > 0 and a - d > 0 and doc[a - 1] == item[a - 1 - d]:
                a -= 1
            elif a > 1 and a - d > 1 and doc[a - 2] == item[a - 2 - d] and (a < 3 or a - d < 3 or doc[a - 3] == item[a - 3 - d]):
                a -= 2
            else:
                break
        done.update((d, x) for x in range(a, b))
        runs.append((a, b, d))
    places: list[list[tuple[int, int, int]]] = []
    for a, b, d in sorted(set(runs)):
        for place in reversed(places):
            x, y, e = place[-1]
            if 0 <= a - y <= 6 and 0 <= (a - d) - (y - e) <= 6:
                place.append((a, b, d))
                break
        else:
            places.append([(a, b, d)])
    found = []
    for place in places:
        n = sum(int(own[a - d : b - d].sum()) for a, b, d in place)
        same = sum(1 for a, b, d in place for x in range(a, b) if doc[x] == item[x - d])
        if same >= PLACE and n:
            found.append((n, place[0][0], place[-1][1], place[0][0] - place[0][2], place[-1][1] - place[-1][2]))
    found.sort(reverse=True)
    best = found[0][0] if found else 0
    for i, (n, a, b, q, r) in enumerate(found):
        if best >= LEAST or n + n < LEAST:
            break
        for m, x, y, s, t in found[i + 1 :]:
            if (b <= x and r <= s) or (y <= a and t <= q):
                best = max(best, n + m)
                break
    return best


def _sent(docs: DataFrame, ready: DataFrame, marks: DataFrame, kind: str) -> DataFrame:
    """(doc_id, item_id) with the items, at most BLOCK words, sent to the workers."""
    rows, m = ready.toArrow(), marks.toArrow()
    texts = {(i, c): (np.array(w, dtype=np.int64).view(np.uint64), own_words(len(w), at)) for i, c, w, at in zip(*(rows[k].to_pylist() for k in ("item_id", "copy", "words", "shared")))}
    h, item, copy, q = (m[k].to_numpy() for k in ("h", "item_id", "copy", "q"))
    order = np.argsort(h.view(np.uint64), kind="stable")
    h, item, copy, q = h.view(np.uint64)[order], item[order], copy[order], q[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, plain = Hashes(), {}
        for b in batches:
            out_d, out_i = [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = hashes.of(text)
                g = gram_hashes(np.array(ids, dtype=np.uint64))
                if not len(g) or not len(h):
                    continue
                k = np.searchsorted(h, g)
                at = np.flatnonzero(h[np.minimum(k, len(h) - 1)] == g)
                seeds: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                for p, a in zip(at.tolist(), k[at].tolist()):
                    while a < len(h) and h[a] == g[p]:
                        seeds[int(item[a]), int(copy[a])].append((p, int(q[a])))
                        a += 1
                plain |= {ic: texts[ic][0].tolist() for ic in seeds if ic not in plain}
                hits = {i for (i, c), s in seeds.items() if held(ids, plain[i, c], texts[i, c][1], s) >= LEAST}
                out_d += [d] * len(hits)
                out_i += hits
            yield pa.RecordBatch.from_arrays([pa.array(out_d, b.column(0).type), pa.array(out_i, pa.int64())], names=["doc_id", "item_id"])

    return docs.mapInArrow(run, f"doc_id {kind}, item_id bigint")


def _shuffled(docs: DataFrame, ready: DataFrame, marks: DataFrame, kind: str) -> DataFrame:
    """(doc_id, item_id) by a join of fingerprints; texts and items are joined to the pairs that share one."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            for d, text in zip(b.column(0), b.column(1).to_pylist()):
                g = gram_hashes(np.array(hashes.of(text), dtype=np.uint64))
                arrays = [pa.array([d.as_py()] * len(g), b.column(0).type), pa.array([xxhash.xxh64_intdigest(text) >> 1] * len(g), pa.int64()), pa.array(g.view(np.int64)), pa.array(np.arange(len(g)))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "version", "h", "p"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            keep = []
            for text, w, at, seeds in zip(*(b.column(k).to_pylist() for k in ("text", "words", "shared", "seeds"))):
                item = np.array(w, dtype=np.int64).view(np.uint64).tolist()
                keep.append(held(hashes.of(text), item, own_words(len(item), at), [(s["p"], s["q"]) for s in seeds]) >= LEAST)
            yield b.select(["doc_id", "item_id"]).filter(pa.array(keep, pa.bool_()))

    found_prints = docs.mapInArrow(prints, f"doc_id {kind}, version bigint, h bigint, p bigint")
    pairs = salted(found_prints, marks, ["h"]).groupBy("doc_id", "version", "item_id", "copy").agg(F.collect_set(F.struct("p", "q")).alias("seeds"))  # places of one text

    def versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [xxhash.xxh64_intdigest(t) >> 1 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(v, pa.int64())], names=["doc_id", "text", "version"])

    texts = docs.mapInArrow(versions, f"doc_id {kind}, text string, version bigint").dropDuplicates(["doc_id", "version"])
    full = salted(pairs, ready, ["item_id", "copy"]).join(texts, ["doc_id", "version"])
    return full.select("doc_id", "item_id", "text", "words", "shared", "seeds").mapInArrow(verify, f"doc_id {kind}, item_id bigint")


def found(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id): the document holds at least LEAST words of the item's own wording."""
    docs = spread(documents.select("doc_id", "text").where(F.length("text") > 0))
    kind = documents.schema["doc_id"].dataType.simpleString()
    ready, marks = prepared(items)
    size = ready.agg(F.sum(F.size("words"))).first()[0] or 0
    return (_sent if size <= block else _shuffled)(docs, ready, marks, kind).distinct()
