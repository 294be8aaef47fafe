"""Vector metrics, exact nearest neighbours, INT4 blocks and model merges.

Vectors are arrays of floats, taken as doubles. Long form is (id, pos, v).
Rounding is half away from zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import share_code, table

BLOCK, KNN, BLOCK_ROWS, CHUNK = 32, 10, 4096, 1024


def doubles(col: str = "embedding") -> Column:
    return F.col(col).cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def vector_stats(vectors: DataFrame) -> DataFrame:
    v = vectors.select("vec_id", doubles().alias("v"))
    return v.select("vec_id", F.round(F.sqrt(dot(F.col("v"), F.col("v"))), 6).alias("norm"), F.round(total(F.col("v")), 6).alias("total"), F.round(F.array_max("v"), 6).alias("most"), F.round(F.array_min("v"), 6).alias("least"), F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("nonzero"), F.size(F.filter("v", lambda x: x > 0)).cast("long").alias("positive"))


def long_form(vectors: DataFrame, *keep: str) -> DataFrame:
    return vectors.select("vec_id", *keep, F.posexplode(doubles())).withColumnsRenamed({"col": "v"})


def int4_blocks(vectors: DataFrame) -> DataFrame:
    """(vec_id, block, scale, codes): symmetric INT4, scale = max|x| / 7, codes -8 to 7."""
    v = vectors.select("vec_id", doubles().alias("v"))
    blocks = v.select("vec_id", F.explode(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / BLOCK).cast("int"))).alias("block"), "v")
    b = blocks.select("vec_id", "block", F.expr(f"slice(v, block * {BLOCK} + 1, {BLOCK})").alias("x"))
    b = b.withColumn("scale", F.array_max(F.transform("x", lambda y: F.abs(y))) / 7)
    code = F.transform("x", lambda y: F.when(F.col("scale") == 0, F.lit(0)).otherwise(F.greatest(F.least(F.round(y / F.col("scale")), F.lit(7.0)), F.lit(-8.0))).cast("int"))
    return b.select("vec_id", "block", "scale", code.alias("codes"), "x")


def int4_quality(vectors: DataFrame) -> DataFrame:
    """Per vector: mse, largest error, cosine and SNR of the INT4 form against the original."""
    b = int4_blocks(vectors).withColumn("y", F.transform("codes", lambda c: c * F.col("scale")))
    sums = b.select("vec_id", F.size("x").alias("n"), total(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q))).alias("e"), F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q))).alias("m"), dot(F.col("x"), F.col("y")).alias("xy"), dot(F.col("x"), F.col("x")).alias("xx"), dot(F.col("y"), F.col("y")).alias("yy"))
    g = sums.groupBy("vec_id").agg(*[F.sum(c).alias(c) for c in ("n", "e", "xy", "xx", "yy")], F.max("m").alias("m"))
    return g.select("vec_id", F.round(F.col("e") / F.col("n"), 9).alias("mse"), F.round("m", 6).alias("max_error"), F.round(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 6).alias("cosine"), F.round(10 * F.log10(F.col("xx") / F.col("e")), 4).alias("snr_db"))


def best_in_blocks(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, similarity): of each asked (id, v) the k rows (id, v) of largest cosine in every block of rows.

    A stated query set against all rows: blocks of some BLOCK_ROWS rows meet
    chunks of some CHUNK queries, a matrix product each, so no task grows with
    the table. Vectors of another length or without length score 0.
    """
    share_code(rows.sparkSession)
    blocks, chunks = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-asked.count() // CHUNK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = asked.select("id", "v", deal(chunks).alias("chunk"), every(blocks).alias("block"))
    x = rows.select("id", "v", deal(blocks).alias("block"), every(chunks).alias("chunk"))

    def unit(vs: pd.Series, width: int) -> np.ndarray:
        out = np.zeros((len(vs), width))
        for i, v in enumerate(vs):
            if v is not None and len(v) == width and (n := np.linalg.norm(v)):
                out[i] = np.asarray(v, dtype=float) / n
        return out

    def scan(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        for width, part in a.groupby(a["v"].map(lambda v: -1 if v is None else len(v))):
            s = np.round(unit(part["v"], max(width, 0)) @ unit(b["v"], max(width, 0)).T, 12) + 0.0
            ids = b["id"].to_numpy()
            for me, row in zip(part["id"].to_numpy(), s, strict=True):
                ok = np.flatnonzero(ids != me)
                top = ok[np.lexsort((ids[ok], -row[ok]))[:k]]
                found.append(pd.DataFrame({"query_id": me, "vec_id": ids[top], "similarity": row[top]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})

    return q.groupBy("block", "chunk").cogroup(x.groupBy("block", "chunk")).applyInPandas(scan, "query_id long, vec_id long, similarity double")


def knn(vectors: DataFrame, k: int = KNN) -> DataFrame:
    """SIM9, TOP4: (query_id, rank, vec_id, similarity): for every id divisible by 20, the k most similar others, ranked by full values."""
    v = vectors.select(F.col("vec_id").alias("id"), doubles().alias("v"))
    part = best_in_blocks(v.where(F.col("id") % 20 == 0), v, k)
    order = [F.desc("similarity"), F.asc("vec_id")]
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))


def centroids(vectors: DataFrame, by: str = "label") -> DataFrame:
    """(code, pos, c): means by group, in long form."""
    return long_form(vectors, by).groupBy(F.col(by).alias("code"), "pos").agg(F.avg("v").alias("c"))


def linear_merge(vectors: DataFrame, overrides: dict[int, float] | None = None) -> DataFrame:
    """M1: (pos, v): the label means, merged by normalised weights 1 / (label + 1); ``overrides`` gives single labels another weight."""
    weight = 1.0 / (F.col("code") + 1)
    for code, w in (overrides or {}).items():
        weight = F.when(F.col("code") == code, w).otherwise(weight)
    m = centroids(vectors).withColumn("w", weight)
    return m.groupBy("pos").agg(F.round(F.sum(F.col("w") * F.col("c")) / F.sum("w"), 6).alias("v"))


def deltas(vectors: DataFrame) -> DataFrame:
    """(code, pos, base, d): label means less the overall mean."""
    base = long_form(vectors).groupBy("pos").agg(F.avg("v").alias("base"))
    return centroids(vectors).join(base, "pos").select("code", "pos", "base", F.round(F.col("c") - F.col("base"), 9).alias("d"))


def ties_merge(vectors: DataFrame, trim: float = 0.8, scale: float = 1.0) -> DataFrame:
    """(pos, v): trim each delta below its |d| at floor(n * trim), elect the sign by mass (ties +), mean of those that agree, times ``scale``, added to the base."""
    d = _trimmed(deltas(vectors), trim)
    sign = F.when(F.sum(F.when(F.col("t") > 0, F.col("t")).otherwise(0.0)) >= F.sum(F.when(F.col("t") < 0, -F.col("t")).otherwise(0.0)), 1).otherwise(-1)
    s = d.join(d.groupBy("pos").agg(sign.alias("sign")), "pos")
    agree = F.when(F.col("t") * F.col("sign") > 0, F.col("t"))
    return s.groupBy("pos").agg(F.round(F.max("base") + scale * F.coalesce(F.avg(agree), F.lit(0.0)), 6).alias("v"))


def _trimmed(d: DataFrame, trim: float) -> DataFrame:
    """Add t: d, or 0 below the threshold of its code."""
    n = Window.partitionBy("code")
    ranked = d.withColumn("i", F.row_number().over(n.orderBy(F.abs("d"), "pos")) - 1).withColumn("n", F.count(F.lit(1)).over(n))
    cut = ranked.where(F.col("i") == F.floor(F.col("n") * trim)).select("code", F.abs("d").alias("cut"))
    return d.join(cut, "code").withColumn("t", F.when(F.abs("d") >= F.col("cut"), F.col("d")).otherwise(0.0))


def dare_merge(vectors: DataFrame, drop: float = 0.5, seed: int = 7) -> DataFrame:
    """(pos, v): deltas dropped by a hash of (seed, code, pos), the kept rescaled, averaged and added to the base."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("code").cast("string"), F.col("pos").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    kept = F.when(u >= drop, F.col("d") / (1 - drop)).otherwise(0.0)
    return deltas(vectors).withColumn("t", kept).groupBy("pos").agg(F.round(F.max("base") + F.avg("t"), 6).alias("v"))


def _over(f):
    return lambda s, d: f(table(s, d, "embeddings"))


QUERIES = {
    "vector_stats": _over(vector_stats),
    "int4_codes": _over(lambda v: int4_blocks(v).select("vec_id", "block", F.round("scale", 6).alias("scale"), F.concat_ws(",", F.transform("codes", lambda c: c.cast("string"))).alias("codes"))),
    "vector_quality": _over(int4_quality),
    "cosine_topk": _over(knn),
    "linear_merge": _over(linear_merge),
    "linear_merge_override": _over(lambda v: linear_merge(v, {0: 0.1, 3: 2.0})),
    "ties_merge": _over(ties_merge),
    "ties_merge_scaled": _over(lambda v: ties_merge(v, 0.8, 0.5)),
    "dare_merge": _over(dare_merge),
}

_L = "l AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"
_C = _L + ", c AS (SELECT label AS code, pos, avg(v) AS c FROM l GROUP BY 1, 2)"
_D = _C + ", b AS (SELECT pos, avg(v) AS base FROM l GROUP BY 1), d AS (SELECT code, pos, base, round(c - base, 9) AS d FROM c JOIN b USING (pos))"
_B = f"b AS (SELECT vec_id, CAST(pos // {BLOCK} AS INT) AS block, pos, v, max(abs(v)) OVER (PARTITION BY vec_id, pos // {BLOCK}) / 7 AS scale FROM l), q AS (SELECT *, CASE WHEN scale = 0 THEN 0 ELSE CAST(greatest(least(round(v / scale), 7), -8) AS INT) END AS code FROM b)"

ORACLE_SQL = {
    "vector_stats": f"WITH {_L} SELECT vec_id, round(sqrt(sum(v * v)), 6) AS norm, round(sum(v), 6) AS total, round(max(v), 6) AS most, round(min(v), 6) AS least, count(*) FILTER (v <> 0) AS nonzero, count(*) FILTER (v > 0) AS positive FROM l GROUP BY vec_id",
    "int4_codes": f"WITH {_L}, {_B} SELECT vec_id, block, round(any_value(scale), 6) AS scale, string_agg(CAST(code AS VARCHAR), ',' ORDER BY pos) AS codes FROM q GROUP BY 1, 2",
    "vector_quality": f"WITH {_L}, {_B} SELECT vec_id, round(sum((v - code * scale) ** 2) / count(*), 9) AS mse, round(max(abs(v - code * scale)), 6) AS max_error, round(sum(v * code * scale) / sqrt(sum(v * v) * sum((code * scale) ** 2)), 6) AS cosine, round(10 * log10(sum(v * v) / sum((v - code * scale) ** 2)), 4) AS snr_db FROM q GROUP BY vec_id",
    "cosine_topk": f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, x.vec_id, list_cosine_similarity(q.v, x.v) AS similarity FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id) SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, round(similarity, 6) AS similarity FROM s WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, vec_id) QUALIFY row_number() OVER w <= {KNN}",
    "linear_merge": f"WITH {_C} SELECT CAST(pos AS INT) AS pos, round(sum(c / (code + 1)) / sum(1.0::DOUBLE / (code + 1)), 6) AS v FROM c GROUP BY 1",
    "linear_merge_override": f"WITH {_C} SELECT CAST(pos AS INT) AS pos, round(sum(c * (CASE code WHEN 0 THEN 0.1 WHEN 3 THEN 2 ELSE 1.0::DOUBLE / (code + 1) END)) / sum((CASE code WHEN 0 THEN 0.1 WHEN 3 THEN 2 ELSE 1.0::DOUBLE / (code + 1) END)), 6) AS v FROM c GROUP BY 1",
    "ties_merge": f"""WITH {_D}, k AS (SELECT code, abs(d) AS cut FROM d QUALIFY row_number() OVER (PARTITION BY code ORDER BY abs(d), pos) - 1 = floor(count(*) OVER (PARTITION BY code) * 0.8)),
      t AS (SELECT d.*, CASE WHEN abs(d) >= cut THEN d ELSE 0 END AS t FROM d JOIN k USING (code)), s AS (SELECT pos, CASE WHEN sum(greatest(t, 0)) >= sum(greatest(-t, 0)) THEN 1 ELSE -1 END AS sign FROM t GROUP BY 1)
      SELECT CAST(pos AS INT) AS pos, round(max(base) + coalesce(avg(t) FILTER (t * sign > 0), 0), 6) AS v FROM t JOIN s USING (pos) GROUP BY 1""",
    "ties_merge_scaled": f"""WITH {_D}, k AS (SELECT code, abs(d) AS cut FROM d QUALIFY row_number() OVER (PARTITION BY code ORDER BY abs(d), pos) - 1 = floor(count(*) OVER (PARTITION BY code) * 0.8)),
      t AS (SELECT d.*, CASE WHEN abs(d) >= cut THEN d ELSE 0 END AS t FROM d JOIN k USING (code)), s AS (SELECT pos, CASE WHEN sum(greatest(t, 0)) >= sum(greatest(-t, 0)) THEN 1 ELSE -1 END AS sign FROM t GROUP BY 1)
      SELECT CAST(pos AS INT) AS pos, round(max(base) + 0.5 * coalesce(avg(t) FILTER (t * sign > 0), 0), 6) AS v FROM t JOIN s USING (pos) GROUP BY 1""",
    "dare_merge": f"WITH {_D} SELECT CAST(pos AS INT) AS pos, round(max(base) + avg(CASE WHEN CAST('0x' || substr(md5('7:' || code || ':' || pos), 1, 8) AS BIGINT) / 4294967296.0 >= 0.5 THEN d / 0.5 ELSE 0 END), 6) AS v FROM d GROUP BY 1",
}
