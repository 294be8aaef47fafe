"""SimHash near-duplicates with a pigeonring filter.

Fingerprints are 64-bit majority votes over XXH64 (seed 42) of word 3-shingles.
Two fingerprints that differ in at most B bits, cut into M segments laid out as
a ring, have a segment from which every chain of l consecutive segments differs
in at most l*B/M bits. The longest chain whose budget is below one bit must be
equal, so it is the join key; the remaining chains prune candidates before the
full Hamming distance is taken. Finer segments make that key longer (24, 28 or
30 bits for 8, 16 or 32 segments and two bits), so their number follows the
number of distinct fingerprints and buckets stay light at any size.

Buckets of more than LIGHT distinct fingerprints are not paired: their members
emit the 1 + 64 values within one bit of them. For B = 2, two fingerprints
share such a value exactly if they differ in at most two bits, so linking all
holders of a value to the least of them loses no component and needs no pairs.
Equal fingerprints are one node throughout, however many documents have them.

Null and empty texts have fingerprint zero and are linked like any other.
Repeated rows are linked; a group without any doc_id has a null component_id. An
empty table gives an empty result. Other columns are passed through whole by
near_dedup, whatever their names, and don't appear in the result of assign.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import boxed, cut
from .components import components

BITS, LIGHT, SHINGLE, BLOCK = 2, 64, 3, 1 << 15
#: Numbers of segments, each with the number of distinct fingerprints up to which a bucket has some four of them.
SEGMENTS = ((8, 1 << 26), (16, 1 << 30), (32, 1 << 62))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    import xxhash

    w = (text or "").encode("utf-8").lower().split()  # on bytes: A-Z only, and exactly the six ASCII white-space bytes
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else iter([b" ".join(w)])
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), grams), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), BLOCK):
        part = h[i : i + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprints of a text column as signed longs."""

    @F.pandas_udf(LongType())
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return fp(F.coalesce(text, F.lit("")))


def _rotl(c: Column, bits: int) -> Column:
    return c if bits == 0 else F.shiftleft(c, bits).bitwiseOR(F.shiftrightunsigned(c, 64 - bits))


def ring_links(fps: DataFrame, segments: int, bits: int = BITS) -> DataFrame:
    """(u, v) links between distinct fingerprints ``fp`` with the same components as all pairs within ``bits``."""
    if bits != 2:
        raise ValueError("buckets beyond LIGHT are linked through one-bit neighbours, which is exact for two bits")
    width = 64 // segments
    exact = max(x for x in range(segments) if x * bits < segments)  # segments of a chain whose budget is below one bit
    turns = F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), _rotl(F.col("fp"), i * width).alias("r")) for i in range(segments)]))
    keys = fps.select("fp", turns.alias("t")).select("fp", "t.turn", "t.r", F.shiftrightunsigned("t.r", 64 - exact * width).alias("key"))
    crowded = keys.groupBy("turn", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LIGHT).drop("n")
    crowded = cut(crowded)
    light = keys.join(crowded, ["turn", "key"], "left_anti")
    a = light.select("turn", "key", F.col("fp").alias("u"), F.col("r").alias("ra"))
    b = light.select("turn", "key", F.col("fp").alias("v"), F.col("r").alias("rb"))
    x = F.col("ra").bitwiseXOR(F.col("rb"))
    chains = F.lit(True)
    for budget in range(1, bits + 1):
        chain = max(n for n in range(1, segments + 1) if n * bits // segments == budget)  # the longest with this budget
        chains = chains & (F.bit_count(F.shiftrightunsigned(x, 64 - chain * width) if chain < segments else x) <= budget)
    pairs = a.join(b, ["turn", "key"]).where("u < v").where(chains).select("u", "v")
    # The exact way for crowded buckets.
    members = keys.join(crowded, ["turn", "key"], "left_semi").select("fp").distinct()
    near = members.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64)])).alias("mid"))
    least = near.groupBy("mid").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = near.join(least, "mid").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars)


def assign(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) per row of ``docs``. Several actions.

    ``text_hash`` tells rows of one doc_id apart; texts leave the scan only to
    be fingerprinted.
    """
    narrow = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprints(F.col("text")).alias("fp")))
    fps = cut(narrow.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    n = fps.count()
    segments = next(m for m, most in SEGMENTS if n <= most)
    roots = cut(components(ring_links(fps, segments)))
    linked = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    ids = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = linked.select("fp", "root").join(ids, "root")
    return narrow.join(classes, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the least doc_id (rows without one last), then the least text hash.

    The rows to keep are chosen on narrow columns. Whole rows are exchanged once,
    by the key of the join, which also brings repeated rows together.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash"))
    keep = assign(docs).groupBy("root").agg(first.alias("k")).select("k.none", "k.id", "k.text_hash")
    key = ["none", "id", "text_hash"]
    rows = boxed(docs, none=F.col("doc_id").isNull(), id=F.coalesce("doc_id", F.lit(0)), text_hash=F.xxhash64("text"))
    return rows.join(keep, key, "left_semi").groupBy(*key).agg(F.first("row").alias("row")).select("row.*")


def op4_simhash_classes(spark, sf_dir) -> DataFrame:
    from ..session import share_code, table

    share_code(spark)
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
