"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in a stated total order. A keyed alternating Feistel
network over Z_a x Z_b (a*b >= N, a*b - N < a) permutes the numbers; values
that fall outside are walked along their cycle until they come back inside.
The permuted position p gives shard = p mod S and slot = p div S, so counts
differ by one at most, nothing but the row's number is needed to find it, and
the inverse gives the row held by any slot.

Nulls: a null doc_id is numbered after all others, a null text has no bytes.
Repeated rows get separate slots. An empty table gives an empty result. Other
columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import number_rows

ROUNDS = 6
_U = np.uint64


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        z = x + _U(key)
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed * 1000 + r], dtype=_U), 0x9E3779B97F4A7C15)[0]) for r in range(ROUNDS)]


def _sides(n: int) -> tuple[int, int]:
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _network(x: np.ndarray, n: int, seed: int, inverse: bool) -> np.ndarray:
    a, b = map(_U, _sides(n))
    left, right = x // b, x % b
    order = list(enumerate(_keys(seed)))
    for r, key in reversed(order) if inverse else order:
        side, mod = (left, a) if r % 2 == 0 else (right, b)
        other = right if r % 2 == 0 else left
        step = _mix(other, key) % mod
        side = (side + (mod - step if inverse else step)) % mod
        left, right = (side, right) if r % 2 == 0 else (left, side)
    return left * b + right


def permute(numbers: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at ``numbers``."""
    x = _network(np.asarray(numbers, dtype=_U), n, seed, inverse)
    while (out := x >= _U(n)).any():  # a cycle through an inside value always returns inside
        x[out] = _network(x[out], n, seed, inverse)
    return x.astype(np.int64)


def locate(row_number: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of a row, computed without the table."""
    p = int(permute(np.array([row_number]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The number of the row in a slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def shard_rows(numbered: DataFrame, row_number: str, n: int, shards: int, seed: int = 1) -> DataFrame:
    """Add ``position``, ``shard`` and ``slot`` to rows numbered 0..n-1."""

    @F.pandas_udf(LongType())
    def position(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    out = numbered.withColumn("position", position(row_number))
    return out.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.floor(F.col("position") / shards).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 1) -> DataFrame:
    """One row per document: its size, checksum, shard and slot. Two actions (numbering, count).

    Only (doc_id, size, checksum) is exchanged; texts never leave the scan.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    numbered = number_rows(narrow, order, "row_number")
    return shard_rows(numbered, "row_number", numbered.count(), shards, seed)


def op3_feistel_shards(spark, sf_dir) -> DataFrame:
    from ..session import share_code, table

    share_code(spark)
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
