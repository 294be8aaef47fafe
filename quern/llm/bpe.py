"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

Each match of the split pattern is encoded by itself. A leaf per byte position
holds the rank of the pair that starts there and the position; a node holds the
least of its FAN children, so the root names the leftmost least pair. A merge
updates at most three leaves (the grown pair, the one before it, the absorbed
one) and their ancestors, so a match of n bytes costs O(n log n) however long
it is; one of up to FAN pairs is a single node. Encodings of short matches are
kept in a cache of CACHE entries, which a Python worker keeps from task to task.

Null texts are empty: 0 tokens, digests of the empty string. Repeated rows get
the same results; an empty table gives an empty result. Columns of the input that
are named like a new one keep their values under that name with ``_input`` behind
it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added

CACHE, CACHED_CHARS, FAN = 1 << 18, 64, 16
NONE = 1 << 20  # beyond any rank


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def byte_pairs(ranks: dict[bytes, int]) -> list[int]:
    """The rank of each pair of bytes, at 256 * first + second."""
    return [ranks.get(bytes((a, b)), NONE) for a in range(256) for b in range(256)]


def merge_bytes(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """The token ids of one match: merge the leftmost pair of least rank until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n, get = len(piece), ranks.get
    bits = n.bit_length()
    mask, none = (1 << bits) - 1, NONE << bits
    leaves = [pairs[a << 8 | b] << bits | i for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False))]
    tree = [leaves]
    while len(tree[-1]) > FAN:
        below = tree[-1]
        tree.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    top, inner = tree[-1], range(1, len(tree))
    end = list(range(1, n + 1))  # of the part that starts at a live position
    before = list(range(-1, n))
    while (least := min(top)) < none:
        i = least & mask
        j = end[i]  # the part absorbed
        stop = end[i] = end[j]
        if stop < n:
            before[stop] = i
            leaves[j] = none
            leaves[i] = get(piece[i : end[stop]], NONE) << bits | i
        else:
            leaves[i] = none
            if j < n - 1:
                leaves[j] = none
        if (p := before[i]) >= 0:
            leaves[p] = get(piece[p:stop], NONE) << bits | p
        if inner:
            touched = (max(p, 0), i, j)
            for level in inner:
                below, here, done = tree[level - 1], tree[level], -1
                touched = tuple(x // FAN for x in touched)
                for k in touched:
                    if k != done and k < len(here):
                        here[k] = min(below[k * FAN : (k + 1) * FAN])
                        done = k
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Encodings(dict):
    """Token ids by match. Misses are encoded; short ones are kept, until CACHE are and all are let go."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, byte_pairs(ranks)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(merge_bytes(piece.encode("utf-8"), self.ranks, self.pairs))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder over one set of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = {r: b for b, r in ranks.items()}
        self.names = {r: str(r) for r in ranks.values()}
        self.split, self.encodings = regex.compile(pattern).findall, _Encodings(ranks)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.encodings.__getitem__, self.split(text or ""))))

    def spell(self, ids) -> str:
        """Decimal ids, joined by spaces."""
        return " ".join(map(self.names.__getitem__, ids))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_KEPT: dict[str, Codec] = {}


def _kept_codec(key: str, ranks: dict[bytes, int], pattern: str) -> Codec:
    """This process's codec of that key; a worker keeps one, the latest."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Codec(ranks, pattern)
    return _KEPT[key]


def _codec_of(docs: DataFrame, ranks_path: str, pattern: str):
    """A broadcast of the ranks (bounded by the vocabulary), and what makes a codec of it on a worker."""
    ranks = load_ranks(ranks_path)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    return lambda: _kept_codec(key, *shared.value)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Add ``ids``, the token ids of ``text``, to any table with a text column."""
    make = _codec_of(docs, ranks_path, pattern)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = make()
        for texts in batches:
            yield pd.Series([np.array(codec.encode(t), dtype=np.int32) for t in texts], dtype=object)

    return added(docs, ids=ids(F.coalesce(F.col("text"), F.lit(""))))


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Add ``decoded`` (binary), the bytes of ``ids``; null ids decode to no bytes."""
    make = _codec_of(encoded, ranks_path, pattern)

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = make()
        for rows in batches:
            yield pd.Series([codec.decode(r.tolist() if r is not None else ()) for r in rows], dtype=object)

    return added(encoded, decoded=decoded("ids"))


def both_ways(docs: DataFrame, ranks_path: str, pattern: str, text: Column) -> Column:
    """A struct of ``ids`` and ``decoded`` for a text column of ``docs``: encoder and decoder in one pass, so that a task needs one worker and one codec."""
    make = _codec_of(docs, ranks_path, pattern)

    @F.pandas_udf("ids array<int>, decoded binary")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = make()
        for texts in batches:
            ids = [np.array(codec.encode(t), dtype=np.int32) for t in texts]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([codec.decode(x.tolist()) for x in ids], dtype=object)})

    return both(F.coalesce(text, F.lit("")))


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Add ``ids`` and ``decoded``."""
    return _unpacked(docs, both_ways(docs, ranks_path, pattern, F.col("text")), "ids", "decoded")


def _unpacked(docs: DataFrame, made: Column, *fields: str) -> DataFrame:
    """Add the fields of a struct that is made once."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), made.alias("made"))
    names = dict(zip(docs.columns, added(docs, **{f: F.lit(0) for f in fields}).columns, strict=False))
    return out.select(*[F.col("row")[c].alias(names[c]) for c in docs.columns], *[f"made.{f}" for f in fields])


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Add n_tokens and the digests of the ids and of the bytes decoded from them; ids stay in the worker."""
    make = _codec_of(docs, ranks_path, pattern)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = make()
        for texts in batches:
            rows = []
            for t in texts:
                ids = codec.encode(t)
                spelled = codec.spell(ids).encode()
                rows.append((len(ids), hashlib.sha256(spelled).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return _unpacked(docs, digests(F.coalesce(F.col("text"), F.lit(""))), "n_tokens", "ids_sha256", "decoded_sha256")


def op9_byte_bpe(spark, sf_dir) -> DataFrame:
    import public_tokenizers as tokenizers

    from ..session import share_code, table

    share_code(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).drop("text")
