"""Approximate nearest neighbours by an adaptive dimension scan over probed lists.

Vectors are dealt to lists by k-means centroids (fitted on a bounded sample, in
the space where largest inner product is least distance). Each query probes its
nearest lists; how many is measured on the sample so that its own neighbours
are found at RECALL. The nearest lists that hold enough rows for an answer are
scanned exactly, so no query gets fewer than it should. In its other lists,
rotated vectors are read in blocks of columns. Under a random rotation the first
b of d columns of a pair with inner product s add up to s * b / d, with a known
spread; after each block a candidate is abandoned when its partial sum is
EPSILON spreads below what the bound would give, or when the norms rule it out.
The bound is the query's (k + MARGIN)-th best so far, in the sample and in the
lists scanned exactly. Survivors are scored on the original vectors in double
precision.

Every row is indexed. Of equal vectors only the k + 1 of least vec_id can be in
any answer, so the others are set aside, which loses nothing. Lists are cut
into blocks of rows, and their queries into chunks, of bounded size, so no task
depends on how vectors crowd.

Vectors that are null, zero or hold null or non-finite components take no part;
nor do rows without vec_id. Of rows that share a vec_id the least vector counts.
Vectors of each length are searched among their own kind: the most common one
and those of more than BLOCK_ROWS rows by an index each, the others exactly. An
empty table gives an empty result. Other columns of the input are not read, so
their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SAMPLE_ROWS, MOST_LISTS, LIST_ROWS = 20_000, 4096, 512
BLOCK_ROWS, CHUNK_QUERIES, COLUMN_BLOCK = 4096, 1024, 16
RECALL, EPSILON, MARGIN = 0.97, 3.0, 10


class ListIndex:
    """Centroids, rotation and the number of lists to probe."""

    def fit(self, x: np.ndarray, rows: int, longest: float, k: int, seed: int = 3) -> ListIndex:
        """``x``: the sample; ``rows``: of the whole index; ``longest``: the greatest squared norm of all."""
        rng, d = np.random.default_rng(seed), x.shape[1]
        self.longest = longest
        self.rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        lists = int(np.clip(rows // LIST_ROWS, 1, min(MOST_LISTS, max(1, len(x) // 8))))
        y = self._lifted(x)
        c = y[rng.choice(len(y), lists, replace=False)].copy()
        for _ in range(10):
            own = self._own(y, c)
            sums, n = np.zeros_like(c), np.bincount(own, minlength=lists)
            np.add.at(sums, own, y)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
        self.centroids = c
        own, q = self._own(y, c), np.arange(0, len(x), max(1, len(x) // 256))
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -np.inf
        best = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
        rank = np.argsort(np.argsort(self.distances(x[q]), axis=1), axis=1)
        need = np.sort(rank[np.arange(len(q))[:, None], own[best]].ravel())
        self.probes = int(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))))]) + 1
        return self

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0, self.longest - (x * x).sum(1)))]

    @staticmethod
    def _own(y: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.concatenate([(y[i : i + 4096] @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for i in range(0, len(y), 4096)]) if len(y) else np.zeros(0, np.int64)

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return self._own(self._lifted(x), self.centroids)

    def distances(self, q: np.ndarray) -> np.ndarray:
        """From queries to centroids, up to a term that is the same for all of a query's."""
        return 0.5 * (self.centroids**2).sum(1) - q @ self.centroids[:, :-1].T

    def probed(self, q: np.ndarray, sizes: np.ndarray, least_rows: int, first_rows: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The lists each query probes: ``probes`` of them, more if they hold fewer than ``least_rows`` rows; and how many of them hold ``first_rows``."""
        order = np.argsort(self.distances(q), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        n = np.maximum(self.probes, (held < least_rows).sum(1) + 1)
        first = np.minimum((held < first_rows).sum(1) + 1, order.shape[1])
        return [o[:m].astype(np.int32) for o, m in zip(order, np.maximum(n, first), strict=True)], first


def kth_best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, k: int, probed: list[np.ndarray] | None = None, lists: np.ndarray | None = None) -> np.ndarray:
    """The k-th best score of each query among ``x``, its own row left out; -inf if there are fewer rows.

    With ``lists``, those of ``x``, only rows in lists that the query probes count.
    """
    out = []
    for i in range(0, len(q), 256):
        s = np.where(qid[i : i + 256, None] == xid[None, :], -np.inf, q[i : i + 256] @ x.T)
        if probed is not None:
            for row, mine in zip(s, probed[i : i + 256], strict=True):
                row[~np.isin(lists, mine)] = -np.inf
        out.append(np.partition(s, s.shape[1] - k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), -np.inf))
    return np.concatenate(out) if out else np.zeros(0)


def scan(q: np.ndarray, qid: np.ndarray, bound: np.ndarray, x: np.ndarray, xid: np.ndarray, rotation: np.ndarray, k: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, score) of the k best rows per query, best first; unless ``exact``, of those that reach its ``bound`` and pass the tests."""
    d = x.shape[1]
    alive = qid[:, None] != xid[None, :]
    if exact:
        part = q @ x.T
    else:
        rq, rx = q @ rotation, x @ rotation
        part = np.zeros(alive.shape)
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        cosine = np.clip(bound[:, None] / norms, -1, 1)
        for a in range(0, d, COLUMN_BLOCK):
            b = min(d, a + COLUMN_BLOCK)
            rows, cols = alive.any(1), alive.any(0)
            if not rows.any():
                break
            part[np.ix_(rows, cols)] += rq[rows, a:b] @ rx[cols, a:b].T
            if b < d:
                spread = norms * np.sqrt(b * (d - b) / (d * (d - 1) * (d + 2)) * (1 + cosine**2))
                most = np.linalg.norm(rq[:, b:], axis=1)[:, None] * np.linalg.norm(rx[:, b:], axis=1)[None, :]
                alive &= (part >= bound[:, None] * (b / d) - EPSILON * spread) & (part + most >= bound[:, None] - 1e-9)
        alive &= part >= bound[:, None] - 1e-9
    if part.shape[1] > k:
        masked = np.where(alive, part, -np.inf)
        alive &= masked >= np.partition(masked, part.shape[1] - k, axis=1)[:, [-k]] - 1e-9
    i, j = np.nonzero(alive)
    s = np.einsum("ij,ij->i", q[i], x[j])
    order = np.lexsort((xid[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], s[place < k]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): one row of finite, non-zero doubles per id."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("vec"))
    return good.groupBy("id").agg(F.min("vec").alias("vec"))


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    c = column.combine_chunks()
    return np.asarray(c.flatten(), dtype=np.float64).reshape(-1, d)


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where ``queries`` (over ``id``) holds, their k best others. Several actions."""
    spark = vectors.sparkSession
    base = cut(usable(vectors, id_col, vec_col))
    lengths = base.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).collect()  # a row per length
    large = [r["d"] for i, r in enumerate(lengths) if i == 0 or r["count"] > BLOCK_ROWS]
    parts = [_nearest_of(base.where(F.size("vec") == d), queries, k, d) for d in large]
    if len(large) < len(lengths):
        parts.append(_nearest_in_small(base.where(~F.size("vec").isin(large)), queries, k))
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest_in_small(base: DataFrame, queries: Column, k: int) -> DataFrame:
    """The answers among vectors of lengths that BLOCK_ROWS rows at most have each: every pair of a length is scored."""

    def answers(pdf: pd.DataFrame) -> pd.DataFrame:
        x, xid, found = np.array(pdf["vec"].tolist()), pdf["id"].to_numpy(), []
        asked = np.flatnonzero(pdf["asked"].to_numpy(dtype=bool))
        for at in range(0, len(asked), 256):
            q = asked[at : at + 256]
            i, j, s = scan(x[q], xid[q], np.full(len(q), -np.inf), x, xid, np.zeros((0, 0)), k, True)
            found.append(pd.DataFrame({"query_id": xid[q][i], "rank": np.arange(len(i)) - np.searchsorted(i, i) + 1, "vec_id": xid[j], "score": s}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "rank": [], "vec_id": [], "score": []})

    rows = base.select("id", "vec", F.coalesce(queries, F.lit(False)).alias("asked"), F.size("vec").alias("d"))
    return rows.groupBy("d").applyInPandas(answers, "query_id long, rank int, vec_id long, score double")


def _nearest_of(base: DataFrame, queries: Column, k: int, d: int) -> DataFrame | None:
    """The answers among vectors of one length ``d``; None if nothing is asked."""
    spark = base.sparkSession
    same = Window.partitionBy(F.xxhash64("vec"), "vec").orderBy("id")
    index = cut(base.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).drop("r"))
    rows, longest = index.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
    sample = index.orderBy(F.xxhash64("id"), "id").limit(max(100, min(SAMPLE_ROWS, 4_000_000 // d))).toPandas().sort_values("id")
    model = spark.sparkContext.broadcast(ListIndex().fit(np.array(sample["vec"].tolist()), rows, longest, k))
    lists = len(model.value.centroids)

    @F.pandas_udf("int")
    def list_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vs in batches:
            yield pd.Series(model.value.lists_of(np.array(vs.tolist()).reshape(-1, d)), dtype="int32")

    placed = cut(index.withColumn("list", list_of("vec")))
    held = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # a row per list, MOST_LISTS at most
    sizes = np.array([held.get(i, 0) for i in range(lists)])

    x = np.array(sample["vec"].tolist())
    known = spark.sparkContext.broadcast((x, sample["id"].to_numpy(), model.value.lists_of(x)))  # bounded like the sample

    @F.pandas_udf("lists array<int>, first int, bound double")
    def probes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, vs in batches:
            q = np.array(vs.tolist()).reshape(-1, d)
            x, xid, own = known.value
            mine, first = model.value.probed(q, sizes, 20 * k, k + MARGIN + 1)
            yield pd.DataFrame({"lists": mine, "first": first.astype(np.int32), "bound": kth_best(q, ids.to_numpy(), x, xid, k + MARGIN, mine, own)})

    asked = cut(base.where(queries).withColumn("p", probes("id", "vec")).select("id", "vec", "p.*"))

    def scanned(a: pa.Table, b: pa.Table, exact: bool) -> pa.Table:
        qid, xid = np.asarray(a["id"].combine_chunks()), np.asarray(b["id"].combine_chunks())
        if not len(qid) or not len(xid):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        i, j, s = scan(_matrix(a["vec"], d), qid, np.asarray(a["bound"].combine_chunks()), _matrix(b["vec"], d), xid, model.value.rotation, k + MARGIN, exact)
        return pa.table({"query_id": qid[i], "vec_id": xid[j], "score": s})

    def found_in(probed: DataFrame, exact: bool) -> DataFrame | None:
        """What the lists of ``probed`` (id, vec, bound, list) hold for their queries; per query and group of rows k + MARGIN at most."""
        per_list = {r["list"]: r["count"] for r in probed.groupBy("list").count().collect()}  # a row per list
        plan = [(i, -(-held.get(i, 0) // BLOCK_ROWS), -(-n // CHUNK_QUERIES)) for i, n in sorted(per_list.items()) if held.get(i)]
        if not plan:
            return None
        plan = F.broadcast(spark.createDataFrame(plan, "list int, blocks int, chunks int"))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = probed.join(plan, "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).select("list", upto("blocks").alias("block"), "chunk", "id", "vec", "bound")
        right = placed.join(plan, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("list", "block", upto("chunks").alias("chunk"), "id", "vec")
        key = ["list", "block", "chunk"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(lambda a, b: scanned(a, b, exact), "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = found_in(asked.select("id", "vec", "bound", F.explode(F.slice("lists", F.lit(1), F.col("first"))).alias("list")), True)
    if near is not None:
        near = cut(near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + MARGIN))
        kth = near.where(F.col("r") == k + MARGIN).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
        asked = cut(asked.join(kth, "id", "left").withColumn("bound", F.greatest("bound", "kth")).drop("kth"))
    rest = found_in(asked.select("id", "vec", "bound", F.explode(F.slice("lists", F.col("first") + 1, F.size("lists") - F.col("first"))).alias("list")), False)
    parts = [x for x in (near.drop("r") if near is not None else None, rest) if x is not None]
    if not parts:
        return None
    found = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_vectors(spark, sf_dir) -> DataFrame:
    from ..session import share_code, table

    share_code(spark)
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)
