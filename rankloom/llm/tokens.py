"""Problem 6: token ids of a whole corpus by a public byte-level BPE vocabulary.

Forced-boundary splitting: a pair of bytes that occurs inside no vocabulary token can never be merged across,
since each intermediate symbol of BPE is itself a token. Such pairs mark certain cuts. Text is split by the
tokenizer's own pattern, every distinct piece is cut at its forced boundaries, the fragments are encoded
independently (each distinct fragment once per worker) and their ids are concatenated. The ids equal those of
encoding the piece as a whole, and a piece of any length costs no more than its longest fragment allows.

Defined results: NULL and '' give an empty list; blank texts are encoded as they are; strings that look like
special tokens are ordinary text; texts are never cut to a prefix; other columns don't matter.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import spread

TOKENIZER_DIR = os.environ.get("RANKLOOM_TOKENIZERS", "/opt/tokenizers")
#: Split pattern of the byte-level vocabularies (fixed value, published with them).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's caches before they are emptied.
CACHE = 400_000


class ForcedBoundaryBpe:
    """Encoder of one vocabulary: lines of ranks (base64 token, id)."""

    def __init__(self, vocabulary: bytes) -> None:
        import regex
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        inside = np.zeros(65536, dtype=bool)
        for token in self.ranks:
            if len(token) > 1:
                t = np.frombuffer(token, dtype=np.uint8).astype(np.int32)
                inside[t[:-1] * 256 + t[1:]] = True
        self.inside = inside
        self.find = regex.compile(PATTERN).findall
        self.core = tiktoken.Encoding("forced", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.pieces: dict[str, list[int]] = {}
        self.fragments: dict[bytes, list[int]] = {}

    def cuts(self, piece: bytes) -> list[bytes]:
        """The fragments of piece between its forced boundaries."""
        if len(piece) < 2:
            return [piece]
        t = np.frombuffer(piece, dtype=np.uint8).astype(np.int32)
        at = np.flatnonzero(~self.inside[t[:-1] * 256 + t[1:]]) + 1
        if not len(at):
            return [piece]
        edges = [0, *at.tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(edges, edges[1:])]

    def fragment(self, f: bytes) -> list[int]:
        known = self.ranks.get(f)
        if known is not None:
            return [known]
        ids = self.fragments.get(f)
        if ids is None:
            if len(self.fragments) > CACHE:
                self.fragments.clear()
            ids = self.fragments[f] = self.core._encode_single_piece(f)
        return ids

    def piece(self, p: str) -> list[int]:
        raw = p.encode()
        known = self.ranks.get(raw)
        ids = [known] if known is not None else [i for f in self.cuts(raw) for i in self.fragment(f)]
        if len(p) <= 64:
            if len(self.pieces) > CACHE:
                self.pieces.clear()
            self.pieces[p] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known, piece = self.pieces, self.piece
        for p in self.find(text):
            out += known.get(p) or piece(p)
        return out


@lru_cache(maxsize=4)
def encoder(vocabulary: bytes) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(vocabulary)


def encode_column(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(id_col, ids): one row per input row. The driver reads the vocabulary file (some 50,000 lines) and sends it."""
    sent = df.sparkSession.sparkContext.broadcast(Path(f"{tokenizer_dir}/{tokenizer}.tiktoken").read_bytes())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for b in batches:
            ids = [enc.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return spread(df.select(id_col, text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
