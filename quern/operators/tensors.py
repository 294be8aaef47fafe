"""Tensor transforms, quantisation, codebooks, merges and the learning steps over them.

A vector is a row; whole-vector work is done in Arrow batches by NumPy, sums
over vectors by Spark. A two-dimensional tensor is a vector with a number of
columns, row by row. Doubles throughout; results are rounded on output only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import names as N
from quern.plans.registry import Registry
from quern.session import share_code

REG = Registry()
DIM, BLOCK = 64, 32


def half_away(x: np.ndarray, digits: int = 0) -> np.ndarray:
    """Rounding half away from zero, as SQL does."""
    f = 10.0**digits
    return np.sign(x) * np.floor(np.abs(x) * f + 0.5) / f


def per_vector(f: Callable, schema: str, names: tuple[str, ...], col: str | Column = "embedding", **args):
    """A struct column of ``f(vector)`` (a tuple); vectors are float64 arrays, null ones empty."""

    @F.pandas_udf(schema)
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vs in batches:
            yield pd.DataFrame([f(np.asarray([] if v is None else v, dtype=np.float64), **args) for v in vs], columns=list(names))

    return each(F.col(col) if isinstance(col, str) else col)


# Cosine transforms


def dct_basis(n: int) -> np.ndarray:
    """The orthonormal DCT-II as a matrix: row k holds the k-th basis vector. Its transpose is the inverse."""
    i, k = np.arange(n), np.arange(n)[:, None]
    return np.sqrt(np.where(k == 0, 1, 2) / max(n, 1)) * np.cos(np.pi * (2 * i + 1) * k / (2 * max(n, 1)))


def dct_1d(x: np.ndarray) -> np.ndarray:
    """DCT-II; directly for short vectors, by a Fourier transform of twice the length beyond."""
    n = len(x)
    if n <= 256:
        return dct_basis(n) @ x
    y = np.fft.fft(np.concatenate([x, x[::-1]]))[:n]
    k = np.arange(n)
    out = (y * np.exp(-1j * np.pi * k / (2 * n))).real / 2
    return out * np.sqrt(np.where(k == 0, 1, 2) / n)


def idct_1d(c: np.ndarray) -> np.ndarray:
    """The inverse (DCT-III)."""
    n = len(c)
    if n <= 256:
        return dct_basis(n).T @ c
    k = np.arange(n)
    y = c * np.sqrt(np.where(k == 0, 1, 2) / n) * np.exp(1j * np.pi * k / (2 * n))
    y[0] *= 1
    full = np.fft.ifft(np.concatenate([y, np.zeros(n)])) * 2 * n
    return full.real[:n]


def dct_2d(x: np.ndarray, cols: int) -> np.ndarray:
    """Rows, then columns; flat in and out."""
    m = x.reshape(-1, cols)
    return (dct_basis(m.shape[0]) @ m @ dct_basis(cols).T).ravel()


def idct_2d(c: np.ndarray, cols: int) -> np.ndarray:
    m = c.reshape(-1, cols)
    return (dct_basis(m.shape[0]).T @ m @ dct_basis(cols)).ravel()


def spectrum(v: np.ndarray) -> tuple:
    """T4-5, WIN4-6: ranks that hold 90, 95 and 99 % of the energy, the knee by curvature, retention for 95 %, entropy over ln n."""
    n = len(v)
    if not n:
        return None, None, None, None, None, None
    e = half_away(dct_1d(v) ** 2, 9)
    e = e[np.lexsort((np.arange(n), -e))]
    total = e.sum()
    if total <= 0:
        return None, None, None, None, None, None
    cum = half_away(np.cumsum(e) / total, 6)
    at = [int(np.argmax(cum >= t)) + 1 if (cum >= t).any() else None for t in (0.9, 0.95, 0.99)]
    bend = half_away(cum[2:] - 2 * cum[1:-1] + cum[:-2], 6)
    p = e[e > 0] / total
    return *at, int(bend.argmin()) + 2 if len(bend) else None, float(half_away(np.array(at[1] / n), 6)) if at[1] else None, float(-(p * np.log(p)).sum() / np.log(n)) if n > 1 else 0.0


_SPECTRUM = ("n90", "n95", "n99", "knee", "retention", "entropy")


def spectra(vectors: DataFrame) -> DataFrame:
    """T4-5 per vector, in its row: no exchange."""
    share_code(vectors.sparkSession)
    s = per_vector(spectrum, "n90 long, n95 long, n99 long, knee long, retention double, entropy double", _SPECTRUM)
    return vectors.select("vec_id", s.alias("s")).select("vec_id", "s.n90", "s.n95", "s.n99", "s.knee", "s.retention", F.round("s.entropy", 5).alias("entropy"))


_L = "l AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"
REG.add(
    "dct_retention",
    spectra,
    f"""WITH {_L}, e AS (SELECT vec_id, k, round(sum(v * cos(pi() * (2 * pos + 1) * k / {2 * DIM}) * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / {DIM}.0)) ** 2, 9) AS e FROM l, range({DIM}) r(k) GROUP BY 1, 2),
      r AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER w AS r, round(sum(e) OVER (PARTITION BY vec_id ORDER BY e DESC, k ROWS UNBOUNDED PRECEDING) / sum(e) OVER (PARTITION BY vec_id), 6) AS cum FROM e WINDOW w AS (PARTITION BY vec_id ORDER BY e DESC, k)),
      s AS (SELECT *, round(lead(cum) OVER w - 2 * cum + lag(cum) OVER w, 6) AS bend FROM r WINDOW w AS (PARTITION BY vec_id ORDER BY r))
      SELECT vec_id, min(r) FILTER (cum >= 0.9) AS n90, min(r) FILTER (cum >= 0.95) AS n95, min(r) FILTER (cum >= 0.99) AS n99, arg_min(r, (bend, r)) FILTER (bend IS NOT NULL) AS knee, round(min(r) FILTER (cum >= 0.95) / {DIM}.0, 6) AS retention, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln({DIM}), 5) AS entropy FROM s GROUP BY vec_id""",
    "embeddings",
)


def _exploded(vectors: DataFrame, f: Callable, **args) -> DataFrame:
    """(vec_id, k, c): the places and values of ``f(vector)``."""
    share_code(vectors.sparkSession)
    s = per_vector(lambda v, **a: (f(v, **a),), "x array<double>", ("x",), **args)
    return vectors.select("vec_id", s.alias("s")).select("vec_id", F.posexplode("s.x").alias("k", "c")).select("vec_id", "k", F.round("c", 5).alias("c"))


REG.add("dct_forward", lambda v: _exploded(v, dct_1d), f"WITH {_L} SELECT vec_id, CAST(k AS INT) AS k, round(sum(v * cos(pi() * (2 * pos + 1) * k / {2 * DIM}) * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / {DIM}.0)), 5) AS c FROM l, range({DIM}) r(k) GROUP BY 1, 2", "embeddings")
REG.add("dct_inverse", lambda v: _exploded(v, idct_1d), f"WITH {_L} SELECT vec_id, CAST(k AS INT) AS k, round(sum(v * cos(pi() * (2 * k + 1) * pos / {2 * DIM}) * sqrt(CASE WHEN pos = 0 THEN 1 ELSE 2 END / {DIM}.0)), 5) AS c FROM l, range({DIM}) r(k) GROUP BY 1, 2", "embeddings")
_D2 = "sum(v * cos(pi() * (2 * (pos // 8) + 1) * (k // 8) / 16) * cos(pi() * (2 * (pos % 8) + 1) * (k % 8) / 16) * sqrt(CASE WHEN k // 8 = 0 THEN 1 ELSE 2 END / 8.0) * sqrt(CASE WHEN k % 8 = 0 THEN 1 ELSE 2 END / 8.0))"
REG.add("dct_2d", lambda v: _exploded(v, lambda x, cols: dct_2d(x, cols), cols=8), f"WITH {_L} SELECT vec_id, CAST(k AS INT) AS k, round({_D2}, 5) AS c FROM l, range({DIM}) r(k) GROUP BY 1, 2", "embeddings")


# Fragments of retained coefficients


def truncated_half(x: np.ndarray) -> np.ndarray:
    """Values as 16-bit floats, cut off, subnormals as zero, read back as doubles."""
    u = np.asarray(x, dtype=np.float32).view(np.uint32)
    exp = (u >> 23 & 0xFF).astype(np.int64) - 112
    h = (u >> 16 & 0x8000) | np.where(exp <= 0, 0, np.where(exp >= 31, 0x7C00, (np.clip(exp, 0, 31).astype(np.uint32) << 10) | (u >> 13 & 0x3FF)))
    return h.astype(np.uint16).view(np.float16).astype(np.float64)


def retained(c: np.ndarray, share: float) -> np.ndarray:
    """TOP10: the places of the max(floor(n * share), 1) greatest coefficients by magnitude, ascending; earlier ones first of equals."""
    k = max(int(len(c) * share), 1)
    return np.sort(np.lexsort((np.arange(len(c)), -np.abs(c)))[:k])


def compress(v: np.ndarray, cols: int, share: float = 0.5, essential: float = 0.2, parts: int = 4) -> list[dict]:
    """Fragments of a tensor: the first has the bitmap of the retained places and the essential values (the first ones by place), the others detail values in turn."""
    c = dct_2d(v, cols)
    at = retained(c, share)
    n = max(int(len(at) * essential), 1)
    bitmap = np.zeros(-(-len(c) // 8) * 8, dtype=np.uint8)
    bitmap[at] = 1
    out = [{"fragment": 0, "bitmap": np.packbits(bitmap, bitorder="little").tobytes(), "values": truncated_half(c[at[:n]]).tolist()}]
    return out + [{"fragment": f, "bitmap": None, "values": truncated_half(c[at[n:]][f - 1 :: parts - 1]).tolist()} for f in range(1, parts)]


def decompress(fragments: list[dict], n: int, cols: int, parts: int = 4) -> np.ndarray:
    """The tensor from the essentials and whatever detail fragments there are; null without the essentials."""
    have = {f["fragment"]: f for f in fragments}
    if 0 not in have:
        return None
    at = np.flatnonzero(np.unpackbits(np.frombuffer(have[0]["bitmap"], dtype=np.uint8), bitorder="little")[:n])
    c, first = np.zeros(n), len(have[0]["values"])
    c[at[:first]] = have[0]["values"]
    for f in range(1, parts):
        if f in have:
            where = at[first:][f - 1 :: parts - 1]
            c[where] = have[f]["values"]
    return idct_2d(c, cols)


def _cos(a: np.ndarray, b: np.ndarray) -> float:
    d = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / d) if d else 0.0


def compressive(v: np.ndarray, cols: int, share: float) -> tuple:
    """T6-8, STM4: retained and essential counts, and the cosine with the original of the essentials and of all fragments."""
    fragments = compress(v, cols, share)
    return sum(len(f["values"]) for f in fragments), len(fragments[0]["values"]), _cos(v, decompress(fragments[:1], len(v), cols)), _cos(v, decompress(fragments, len(v), cols))


def adaptive_share(v: np.ndarray, cols: int, energy: float = 0.95) -> float:
    """The share of coefficients that holds so much of the energy."""
    e = np.sort(dct_2d(v, cols) ** 2)[::-1]
    return float((np.searchsorted(np.cumsum(e), energy * e.sum() - 1e-12) + 1) / len(e)) if e.sum() > 0 else 1.0


def compressive_quality(vectors: DataFrame, share: float = 0.5) -> DataFrame:
    share_code(vectors.sparkSession)
    s = per_vector(compressive, "retained int, essential int, first double, whole double", ("retained", "essential", "first", "whole"), cols=8, share=share)
    return vectors.select("vec_id", s.alias("s")).select("vec_id", "s.retained", "s.essential", F.round("s.first", 3).alias("first"), F.round("s.whole", 3).alias("whole"))


_C2 = f"{_L}, c AS (SELECT vec_id, k, {_D2} AS c FROM l, range({DIM}) r(k) GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(c) DESC, k) AS r FROM c)"
REG.add("compressive_quality", compressive_quality, f"WITH {_C2}, p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY k) AS nr FROM q WHERE r <= 32), t AS (SELECT vec_id, sum(c * c) AS t FROM c GROUP BY 1) SELECT vec_id, CAST(count(*) AS INT) AS retained, 6 AS essential, round(sqrt(sum(c * c) FILTER (nr <= 6) / any_value(t)), 3) AS first, round(sqrt(sum(c * c) / any_value(t)), 3) AS whole FROM p JOIN t USING (vec_id) GROUP BY 1", "embeddings")


def adaptive_quality(vectors: DataFrame, energy: float = 0.95) -> DataFrame:
    """Per vector the coefficients kept for the energy, and the cosine after encoding and decoding."""
    share_code(vectors.sparkSession)

    def one(v: np.ndarray) -> tuple:
        share = adaptive_share(v, 8, energy)
        return int(half_away(np.array(share * len(v)))), compressive(v, 8, share + 1e-9)[3]

    s = per_vector(one, "kept int, cosine double", ("kept", "cosine"))
    return vectors.select("vec_id", s.alias("s")).select("vec_id", "s.kept", F.round("s.cosine", 3).alias("cosine"))


REG.add("adaptive_quality", adaptive_quality, f"WITH {_C2}, e AS (SELECT vec_id, r, sum(c * c) OVER (PARTITION BY vec_id ORDER BY r) AS upto, sum(c * c) OVER (PARTITION BY vec_id) AS t FROM q), k AS (SELECT vec_id, min(r) AS kept FROM e WHERE upto >= 0.95::DOUBLE * t - 1e-12 GROUP BY 1) SELECT vec_id, CAST(kept AS INT) AS kept, round(sqrt(upto / t), 3) AS cosine FROM k JOIN e USING (vec_id) WHERE r = kept", "embeddings")


def ratios(parts: DataFrame, share: float = 0.5, essential: float = 0.2, fragments: int = 4) -> DataFrame:
    """Expected ratio of a tensor of so many elements against 32- and 16-bit floats, and bytes in mixed precision."""
    n = F.col("n")
    kept = F.floor(n * share)
    first = F.floor(kept * essential)
    out = 24 + F.ceil(n / 8) + first * 2 + (fragments - 1) * 8 + (kept - first) * 2
    mixed = F.greatest(kept, F.lit(1))
    half = F.greatest(F.floor(mixed * 0.2), F.lit(1))
    four = mixed - half
    return parts.select("id", F.round(n * 4 / out, 6).alias("ratio"), F.round(n * 2 / out, 6).alias("ratio_f16"), (half * 2 + F.ceil(four / BLOCK) * 2 + F.ceil(four / 2) + mixed * 4).cast("long").alias("mixed_bytes"))


REG.add("expected_ratios", lambda p: ratios(p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 1).alias("n"))), f"WITH k AS (SELECT p_partkey AS id, p_partkey + 1 AS n, (p_partkey + 1) // 2 AS kept FROM part), f AS (SELECT *, CAST(floor(kept * 0.2::DOUBLE) AS BIGINT) AS e, greatest(kept, 1) AS m FROM k), g AS (SELECT *, 24 + (n + 7) // 8 + e * 2 + 24 + (kept - e) * 2 AS o, greatest(CAST(floor(m * 0.2::DOUBLE) AS BIGINT), 1) AS h FROM f) SELECT id, round(n * 4 / o, 6) AS ratio, round(n * 2 / o, 6) AS ratio_f16, CAST(h * 2 + (m - h + {BLOCK - 1}) // {BLOCK} * 2 + (m - h + 1) // 2 + m * 4 AS BIGINT) AS mixed_bytes FROM g", "part")


def interleaved(v: np.ndarray, cols: int, parts: int, loaded: int) -> tuple:
    """Quality (share of coefficients) and cosine of a tensor of which the first ``loaded`` of ``parts`` fragments are read; fragment f holds coefficients f, f + parts, ..."""
    c = dct_2d(v, cols)
    have = np.arange(len(c)) % parts < loaded
    return float(have.mean()), _cos(v, idct_2d(np.where(have, c, 0), cols))


def holographic(vectors: DataFrame, parts: int = 8, loaded: int = 3) -> DataFrame:
    share_code(vectors.sparkSession)
    s = per_vector(interleaved, "quality double, cosine double", ("quality", "cosine"), cols=8, parts=parts, loaded=loaded)
    return vectors.select("vec_id", s.alias("s")).select("vec_id", F.round("s.quality", 6).alias("quality"), F.round("s.cosine", 4).alias("cosine"))


REG.add("holographic_spectral", holographic, f"WITH {_C2} SELECT vec_id, round(count(*) FILTER (k % 8 < 3) / count(*), 6) AS quality, round(sqrt(sum(c * c) FILTER (k % 8 < 3) / sum(c * c)), 4) AS cosine FROM c GROUP BY 1", "embeddings")


def projection(v: np.ndarray, parts: int = 8, loaded: int = 6, seed: int = 11) -> tuple:
    """Cosine of a vector rebuilt from the first fragments of its projections on seeded Gaussian directions."""
    n = len(v)
    per = -(-n // parts)
    p = np.random.Generator(np.random.Philox(seed)).normal(size=(parts * per, n)) / np.sqrt(n)
    p, y = p[: loaded * per], (p @ v)[: loaded * per]
    return (_cos(v, np.linalg.lstsq(p, y, rcond=None)[0]),)


def low_rank(v: np.ndarray, cols: int, energy: float = 0.95, rank: int | None = None) -> tuple:
    """T12-13: rank for the energy (or the given one) by singular values, cosine, and stored numbers."""
    m = v.reshape(-1, cols)
    u, s, w = np.linalg.svd(m, full_matrices=False)
    k = rank or (int(np.searchsorted(np.cumsum(s**2), energy * (s**2).sum() - 1e-12)) + 1 if s.any() else 1)
    return k, _cos(v, ((u[:, :k] * s[:k]) @ w[:k]).ravel()), k * (m.shape[0] + cols + 1)


def randomised_svd(m: np.ndarray, rank: int, extra: int = 4, powers: int = 2, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sketch, power iterations and a small decomposition."""
    q = np.linalg.qr(m @ np.random.default_rng(seed).normal(size=(m.shape[1], min(rank + extra, m.shape[1]))))[0]
    for _ in range(powers):
        q = np.linalg.qr(m @ np.linalg.qr(m.T @ q)[0])[0]
    u, s, w = np.linalg.svd(q.T @ m, full_matrices=False)
    return (q @ u)[:, :rank], s[:rank], w[:rank]


def rank_quality(vectors: DataFrame) -> DataFrame:
    """T11-13: cosines of projections and of low ranks, per vector as an 8 by 8 tensor."""
    share_code(vectors.sparkSession)
    a = per_vector(projection, "cosine double", ("cosine",))
    b = per_vector(low_rank, "rank int, cosine double, stored int", ("rank", "cosine", "stored"), cols=8)
    return vectors.select("vec_id", a.alias("a"), b.alias("b")).select("vec_id", F.round("a.cosine", 4).alias("projected"), "b.rank", F.round("b.cosine", 4).alias("low_rank"), "b.stored")


REG.add("rank_quality", rank_quality, None, "embeddings")


def hybrid(v: np.ndarray, kind: str, cols: int = 8, share: float = 0.5, importance: float = 0.5) -> np.ndarray:
    """T14-15: a tensor after the method of its kind: unchanged, or through retained coefficients whose share follows kind and importance."""
    if kind in ("LayerNorm", "Bias"):
        return v
    c = dct_2d(v, cols)
    out = np.zeros(len(c))
    at = retained(c, min(share * (0.5 + importance), 1.0))
    out[at] = c[at]
    return idct_2d(out, cols)


def hybrid_quality(vectors: DataFrame) -> DataFrame:
    """T14-15: (vec_id, kind, kept): tensors named by their label, through the method of their kind; the energy kept."""
    share_code(vectors.sparkSession)
    kinds = ("self_attn.q_proj", "mlp.up_proj", "norm.weight", "embed_tokens", "lm_head", "x.bias")
    name = F.element_at(F.array(*map(F.lit, kinds)), (F.col("label") % len(kinds) + 1).cast("int"))
    kind, (value, _) = N.tensor_type(name), N.heuristic_importance(name)

    @F.pandas_udf("double")
    def kept(v: pd.Series, k: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else _cos(np.asarray(a, float), hybrid(np.asarray(a, float), b, importance=c)) for a, b, c in zip(v, k, i, strict=True)], dtype=float)

    t = vectors.select("vec_id", "embedding", kind.alias("kind"), value.alias("i"))
    return t.select("vec_id", "kind", F.round(kept("embedding", "kind", "i"), 3).alias("cosine"))


REG.add("hybrid_quality", hybrid_quality, f"WITH {_C2}, s AS (SELECT vec_id, (['AttentionQuery', 'Mlp', 'LayerNorm', 'Embedding', 'OutputHead', 'Bias'])[label % 6 + 1] AS kind, ([0.75, 0.5, 1, 0.95, 0.9, 1])[label % 6 + 1]::DOUBLE AS i FROM embeddings) SELECT vec_id, any_value(kind) AS kind, round(CASE WHEN any_value(kind) IN ('LayerNorm', 'Bias') THEN 1 ELSE sqrt(sum(c * c) FILTER (r <= greatest(floor({DIM} * least(0.5::DOUBLE * (0.5 + i), 1)), 1)) / sum(c * c)) END, 3) AS cosine FROM q JOIN s USING (vec_id) GROUP BY vec_id", "embeddings")


def int4(x: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Q1: (scales, codes 0 to 15) of symmetric blocks; the codes are of the exact scale, which is stored as a cut-off 16-bit float."""
    scales = np.array([max(abs(x[i : i + block])) / 7 if max(abs(x[i : i + block])) > 1e-10 else 1.0 for i in range(0, len(x), block)])
    q = np.clip(half_away(x / np.repeat(scales, block)[: len(x)]), -8, 7).astype(int) + 8
    return scales, q


def pack_int4(v: np.ndarray) -> bytes:
    """Q1: scales as 16-bit floats, then two codes a byte, the first in the low half."""
    scales, q = int4(v)
    q = np.append(q, 0) if len(q) % 2 else q
    return truncated_half(scales).astype("<f2").tobytes() + (q[::2] | q[1::2] << 4).astype(np.uint8).tobytes()


def unpack_int4(data: bytes, n: int) -> np.ndarray:
    blocks = -(-n // BLOCK)
    scales = np.frombuffer(data[: 2 * blocks], dtype="<f2").astype(float)
    b = np.frombuffer(data[2 * blocks :], dtype=np.uint8)
    q = np.stack([b & 15, b >> 4], axis=1).ravel()[:n].astype(int) - 8
    return q * np.repeat(scales, BLOCK)[:n]


def int4_packed(vectors: DataFrame) -> DataFrame:
    """Q1: (vec_id, packed hex, n_bytes, mse of what is read back)."""
    share_code(vectors.sparkSession)

    def one(v: np.ndarray) -> tuple:
        b = pack_int4(v)
        return b.hex(), len(b), float(((unpack_int4(b, len(v)) - v) ** 2).mean()) if len(v) else 0.0

    s = per_vector(one, "packed string, n_bytes int, mse double", ("packed", "n_bytes", "mse"))
    return vectors.select("vec_id", s.alias("s")).select("vec_id", F.substring("s.packed", 4 * (DIM // BLOCK) + 1, DIM).alias("nibbles"), "s.n_bytes", F.round("s.mse", 8).alias("mse"))


_Q = f"b AS (SELECT vec_id, pos, v, max(abs(v)) OVER (PARTITION BY vec_id, pos // {BLOCK}) / 7 AS s FROM l), q AS (SELECT *, CASE WHEN s = 0 THEN 8 ELSE CAST(greatest(least(round(v / s), 7), -8) AS INT) + 8 END AS q, 2.0::DOUBLE ** floor(log2(s)) AS p FROM b)"
REG.add("int4_packed", int4_packed, f"WITH {_L}, {_Q}, f AS (SELECT *, p * (1 + floor((s / p - 1) * 1024) / 1024) AS h FROM q), w AS (SELECT vec_id, pos // 2 AS nr, max(q) FILTER (pos % 2 = 1) AS hi, max(q) FILTER (pos % 2 = 0) AS lo FROM f GROUP BY 1, 2), n AS (SELECT vec_id, string_agg(printf('%x%x', hi, lo), '' ORDER BY nr) AS nibbles FROM w GROUP BY 1), m AS (SELECT vec_id, CAST(count(*) // 2 + 2 * (count(*) // {BLOCK}) AS INT) AS n_bytes, round(avg(((q - 8) * h - v) ** 2), 8) AS mse FROM f GROUP BY 1) SELECT * FROM n JOIN m USING (vec_id)", "embeddings")


def calibrated_int4(vectors: DataFrame, group: int = BLOCK, percentile: float = 99.0) -> DataFrame:
    """Q2: INT4 by groups whose scale follows the range met over all vectors, shrunk by the share above the percentile at both ends: (vec_id, mse, clipped)."""
    long = vectors.select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v")).withColumn("g", F.floor(F.col("pos") / group))
    shrink = (100 - percentile) / 100
    r = long.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    span = (F.col("hi") - F.col("lo")) * shrink
    top = F.greatest(F.abs(F.col("lo") + span), F.abs(F.col("hi") - span))
    scales = r.select("g", F.when(top > 0, top / 7).otherwise(1.0).alias("s"))  # a row per group of places
    q = F.least(F.greatest(F.round(F.col("v") / F.col("s")), F.lit(-8.0)), F.lit(7.0))
    e = long.join(F.broadcast(scales), "g").select("vec_id", F.pow(q * F.col("s") - F.col("v"), F.lit(2.0)).alias("e"), (F.abs(F.round(F.col("v") / F.col("s"))) > 7).cast("int").alias("c"))
    return e.groupBy("vec_id").agg(F.round(F.avg("e"), 8).alias("mse"), F.sum("c").alias("clipped"))


REG.add("int4_calibrated", calibrated_int4, f"WITH {_L}, r AS (SELECT pos // {BLOCK} AS g, min(v) AS lo, max(v) AS hi FROM l GROUP BY 1), s AS (SELECT g, greatest(abs(lo + (hi - lo) * 0.01::DOUBLE), abs(hi - (hi - lo) * 0.01::DOUBLE)) / 7 AS s FROM r) SELECT vec_id, round(avg((least(greatest(round(v / s), -8), 7) * s - v) ** 2), 8) AS mse, count(*) FILTER (abs(round(v / s)) > 7) AS clipped FROM l JOIN s ON pos // {BLOCK} = g GROUP BY 1", "embeddings")


def mixed_precision(v: np.ndarray, cols: int, share: float = 0.5, half: float = 0.2) -> tuple:
    """Cosine after keeping the greatest coefficients, the first of them (by magnitude) as 16-bit floats and the rest in INT4 blocks."""
    c = dct_2d(v, cols)
    order = np.lexsort((np.arange(len(c)), -np.abs(c)))[: max(int(len(c) * share), 1)]
    n = max(int(len(order) * half), 1)
    out = np.zeros(len(c))
    out[order[:n]] = truncated_half(c[order[:n]])
    rest = np.sort(order[n:])
    if len(rest):
        scales, q = int4(c[rest])
        out[rest] = (q - 8) * np.repeat(truncated_half(scales), BLOCK)[: len(rest)]
    return (_cos(v, idct_2d(out, cols)), float(((idct_2d(out, cols) - v) ** 2).mean()))


def mixed_quality(vectors: DataFrame) -> DataFrame:
    """T16 per vector."""
    share_code(vectors.sparkSession)
    s = per_vector(mixed_precision, "cosine double, mse double", ("cosine", "mse"), cols=8)
    return vectors.select("vec_id", s.alias("s")).select("vec_id", F.round("s.cosine", 3).alias("cosine"), F.round("s.mse", 6).alias("mse"))


REG.add("mixed_quality", mixed_quality, None, "embeddings")


def flattened(shape: list[int]) -> tuple[int, int]:
    """(rows, columns) of an n-dimensional tensor: the first dimension against the rest."""
    return (1, 1) if not shape else (1, shape[0]) if len(shape) == 1 else (shape[0], int(np.prod(shape[1:])))


# Codebooks


def nearest_code(v: np.ndarray, codes: np.ndarray, centres: np.ndarray) -> tuple:
    if not len(codes) or centres.shape[1] != len(v):
        return None, None
    d = ((centres - v) ** 2).sum(1)
    at = int(d.argmin())
    return int(codes[at]), float(d[at])


def label_centroids(vectors: DataFrame, by: str = "label", most: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(codes, centroids): AGG24, means by group, ascending. On the driver; more than ``most`` groups are refused."""
    long = vectors.select(by, F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v")).groupBy(by, "pos").agg(F.avg("v").alias("c"))
    rows = long.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("c")).where(F.col(by).isNotNull()).orderBy(by).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a codebook of more than {most} codes")
    return np.array([r[by] for r in rows], dtype=np.int64), np.array([[x["c"] for x in r["c"]] for r in rows], dtype=float) if rows else np.zeros((0, 0))


def assigned(vectors: DataFrame, codes: np.ndarray, centres: np.ndarray) -> DataFrame:
    """JOIN11: (vec_id, code, distance): the nearest centroid, the lowest code of equals; null without a centroid of the vector's length. The codebook travels with the function; nothing is exchanged."""
    share_code(vectors.sparkSession)
    s = per_vector(nearest_code, "code int, distance double", ("code", "distance"), codes=codes, centres=centres)
    return vectors.select("vec_id", "embedding", s.alias("s")).select("vec_id", "embedding", "s.code", "s.distance")


def codebook_assign(vectors: DataFrame) -> DataFrame:
    return assigned(vectors, *label_centroids(vectors)).select("vec_id", "code", F.round("distance", 6).alias("distance"))


def codebook_usage(vectors: DataFrame) -> DataFrame:
    """AGG25: per code, unused ones included: vectors, mean squared distance; and least, greatest and mean use of all codes."""
    codes, centres = label_centroids(vectors)
    a = assigned(vectors, codes, centres).groupBy("code").agg(F.count(F.lit(1)).alias("used"), F.avg("distance").alias("mse"))
    every = vectors.sparkSession.createDataFrame([(int(c),) for c in codes], "code int")
    g = every.join(a, "code", "left").select("code", F.coalesce("used", F.lit(0)).alias("used"), F.round(F.coalesce("mse", F.lit(0.0)), 5).alias("mse"))
    w = Window.partitionBy()  # a row per code
    return g.select("code", "used", "mse", F.min("used").over(w).alias("least"), F.max("used").over(w).alias("most"), F.round(F.avg("used").over(w), 6).alias("mean"))


_C = _L + ", c AS (SELECT label AS code, pos, avg(v) AS c FROM l GROUP BY 1, 2)"
_A = f"WITH {_C}, x AS (SELECT vec_id, code, sum((v - c) * (v - c)) AS distance FROM l JOIN c USING (pos) GROUP BY 1, 2), a AS (SELECT vec_id, code, distance FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, code) = 1)"
REG.add("codebook_assign", codebook_assign, _A + " SELECT vec_id, code, round(distance, 6) AS distance FROM a", "embeddings")
REG.add("codebook_usage", codebook_usage, _A + ", u AS (SELECT k.code, count(a.vec_id) AS used, round(coalesce(avg(distance), 0), 5) AS mse FROM (SELECT DISTINCT code FROM c) k LEFT JOIN a USING (code) GROUP BY 1) SELECT *, min(used) OVER () AS least, max(used) OVER () AS most, round(avg(used) OVER (), 6) AS mean FROM u", "embeddings")


def lloyd_step(vectors: DataFrame, codes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, float]:
    """AGG24, Q3: (new centroids, mse): means of the assigned vectors; a code without any becomes the zero vector. An action on a row per code and place."""
    a = assigned(vectors, codes, centres)
    mse = a.agg(F.avg("distance")).first()[0] or 0.0
    g = a.select("code", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v")).groupBy("code", "pos").agg(F.avg("v").alias("c"))
    out, place = np.zeros_like(centres), {int(c): i for i, c in enumerate(codes)}
    for r in g.collect():
        out[place[r["code"]], r["pos"]] = r["c"]
    return out, float(mse)


def train_codebook(vectors: DataFrame, codes: int = 8, rounds: int = 5, tolerance: float = 1e-6, start: np.ndarray | None = None) -> tuple[np.ndarray, list[float]]:
    """Q3: (centroids, mse by round) by Lloyd's steps from the first vectors of least hash (or ``start``), until the error stops falling."""
    if start is None:
        rows = vectors.where("embedding IS NOT NULL").orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(codes).collect()
        start = np.array([r["embedding"] for r in rows], dtype=float)
    names, centres, errors = np.arange(len(start)), start, []
    if not len(start):
        return np.zeros((0, 0)), []
    for _ in range(rounds):
        centres, mse = lloyd_step(vectors, names, centres)
        if errors and abs(errors[-1] - mse) < tolerance:
            break
        errors.append(mse)
    return centres, errors


def codebook_step(vectors: DataFrame, codes: int = 8) -> DataFrame:
    """Q3: (code, pos, c): centroids after one step from the vectors of the lowest ids."""
    rows = vectors.where("embedding IS NOT NULL").orderBy("vec_id").limit(codes).collect()
    if not rows:
        return vectors.sparkSession.createDataFrame([], "code int, pos int, c double")
    centres, _ = lloyd_step(vectors, np.arange(len(rows)), np.array([r["embedding"] for r in rows], dtype=float))
    return vectors.sparkSession.createDataFrame([(i, j, float(half_away(np.array(x), 5))) for i, c in enumerate(centres) for j, x in enumerate(c)], "code int, pos int, c double")


REG.add("codebook_step", codebook_step, f"WITH {_L}, s AS (SELECT row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS code, pos, v AS c FROM l WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 8)), x AS (SELECT vec_id, code, sum((v - c) ** 2) AS d FROM l JOIN s USING (pos) GROUP BY 1, 2), a AS (SELECT vec_id, code FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, code) = 1) SELECT CAST(s.code AS INT) AS code, CAST(s.pos AS INT) AS pos, round(coalesce(avg(l.v), 0), 5) AS c FROM s LEFT JOIN a ON a.code = s.code LEFT JOIN l ON l.vec_id = a.vec_id AND l.pos = s.pos GROUP BY 1, 2", "embeddings")
REG.add("codebook_train", lambda v: v.sparkSession.createDataFrame(list(enumerate(map(float, train_codebook(v)[1]))), "round int, mse double"), None, "embeddings")


def encoded(v: np.ndarray, codes: np.ndarray, centres: np.ndarray) -> tuple:
    """Q4-5, JOIN12: code, int8 residuals (cut off, scale greatest / 127; none below 1e-6), mse without and with them."""
    code, d = nearest_code(v, codes, centres)
    if code is None:
        return None, None, None, None, None
    r = v - centres[int(np.flatnonzero(codes == code)[0])]
    most = np.abs(r).max() if len(r) else 0.0
    scale = most / 127 if most >= 1e-6 else 0.0
    q = np.trunc(np.clip(r / scale, -127, 127)) if scale else np.zeros(len(r))
    return code, q.astype(int).tolist(), scale, d / max(len(v), 1), float(((r - q * scale) ** 2).mean())


def multi_level(v: np.ndarray, levels: int = 3) -> tuple:
    """Q6: mean squared errors after each of several int8 levels with scale greatest / 120."""
    r, out = v.copy(), []
    if not len(v):
        return (None,) * levels
    for _ in range(levels):
        most = np.abs(r).max()
        s = most / 120 if most >= 1e-8 else 1.0
        r = r - np.trunc(np.clip(r / s, -127, 127)) * s
        out.append(float((r**2).mean()))
    return tuple(out)


def refine(v: np.ndarray, base: np.ndarray, q: np.ndarray, scale: float, rounds: int = 20, rate: float = 0.1, momentum: float = 0.9) -> tuple[np.ndarray, float]:
    """Q6: residuals after gradient steps with momentum towards v - base, quantised anew: (int8, scale). The best ones met are kept."""
    r, m = q * scale, np.zeros(len(q))
    best, least = r.copy(), ((base + r - v) ** 2).mean()
    for _ in range(rounds):
        m = momentum * m + 2 * (base + r - v)
        r = r - rate * m
        e = ((base + r - v) ** 2).mean()
        if e < least:
            best, least = r.copy(), e
    s = np.abs(best).max() / 127 if np.abs(best).max() > 0 else 1.0
    return np.trunc(np.clip(best / s, -127, 127)).astype(int), float(s)


def vector_quantised(vectors: DataFrame) -> DataFrame:
    """Q4-6: (vec_id, code, mse, residual_mse, level1 to level3)."""
    share_code(vectors.sparkSession)
    codes, centres = label_centroids(vectors)
    a = per_vector(encoded, "code int, q array<int>, scale double, mse double, rest double", ("code", "q", "scale", "mse", "rest"), codes=codes, centres=centres)
    b = per_vector(multi_level, "a double, b double, c double", ("a", "b", "c"))
    s = vectors.select("vec_id", a.alias("a"), b.alias("b"))
    return s.select("vec_id", "a.code", F.round("a.mse", 8).alias("mse"), F.round("a.rest", 9).alias("residual_mse"), F.round("b.a", 9).alias("level1"), F.round("b.b", 12).alias("level2"))


_LV = "SELECT vec_id, pos, v - trunc(v / (max(abs(v)) OVER p / 120)) * (max(abs(v)) OVER p / 120) AS v FROM {} WINDOW p AS (PARTITION BY vec_id)"
REG.add("vector_quantised", vector_quantised, _A + f", r AS (SELECT l.vec_id, l.pos, a.code, l.v - c.c AS r, max(abs(l.v - c.c)) OVER (PARTITION BY l.vec_id) / 127 AS s FROM l JOIN a USING (vec_id) JOIN c ON c.code = a.code AND c.pos = l.pos), e AS (SELECT vec_id, any_value(code) AS code, avg(r * r) AS mse, avg(CASE WHEN s * 127 < 1e-6 THEN r * r ELSE (r - trunc(least(greatest(r / s, -127), 127)) * s) ** 2 END) AS rest FROM r GROUP BY 1), l1 AS ({_LV.format('l')}), l2 AS ({_LV.format('l1')}) SELECT e.vec_id, code, round(mse, 8) AS mse, round(rest, 9) AS residual_mse, round((SELECT avg(v * v) FROM l1 WHERE l1.vec_id = e.vec_id), 9) AS level1, round((SELECT avg(v * v) FROM l2 WHERE l2.vec_id = e.vec_id), 12) AS level2 FROM e", "embeddings")

# Q7, fixed values: codes, places a block, bits of an index and subspaces of each kind of layer.
REGISTRY = {"AttentionQK": (4096, 64, 12, 1), "AttentionVO": (8192, 64, 13, 1), "FFN": (2048, 128, 11, 2), "Normalization": (256, 32, 8, 1), "Embedding": (2048, 128, 11, 2), "OutputHead": (8192, 64, 13, 1)}


def codebook_registry(spark) -> DataFrame:
    """Q7: (layer_type, codes, dim, bits, subspaces, ratio): the default codebook of each kind of layer, and how many times smaller than 32-bit floats its indices of 16 bits are."""
    rows = [(k, *v, v[1] * 32 / 16) for k, v in REGISTRY.items()]
    return spark.createDataFrame(rows, "layer_type string, codes int, dim int, bits int, subspaces int, ratio double")


REG.add("codebook_registry", lambda r: codebook_registry(r.sparkSession), "SELECT layer_type, CAST(codes AS INT) AS codes, CAST(dim AS INT) AS dim, CAST(log2(codes) AS INT) AS bits, CAST(CASE WHEN dim > 64 THEN 2 ELSE 1 END AS INT) AS subspaces, dim * 2.0::DOUBLE AS ratio FROM (VALUES ('AttentionQK', 4096, 64), ('AttentionVO', 8192, 64), ('FFN', 2048, 128), ('Normalization', 256, 32), ('Embedding', 2048, 128), ('OutputHead', 8192, 64)) v(layer_type, codes, dim)", "region")


def decoded(codes: DataFrame, book: DataFrame, dim: int) -> DataFrame:
    """JOIN12, Q5: (id, at, centroid) of (id, at, code): an unknown code is a zero vector. The book has a row per code."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return codes.join(F.broadcast(book), "code", "left").select("id", "at", F.coalesce("centroid", zeros).alias("centroid"))


def decode_query(vectors: DataFrame) -> DataFrame:
    """Q5: the mean of each decoded vector, with every seventh code unknown."""
    codes, centres = label_centroids(vectors)
    book = vectors.sparkSession.createDataFrame([(int(c), x.tolist()) for c, x in zip(codes, centres, strict=True)], "code int, centroid array<double>")
    asked = vectors.select(F.col("vec_id").alias("id"), F.lit(0).alias("at"), F.when(F.col("vec_id") % 7 == 0, -1).otherwise(F.col("label")).cast("int").alias("code"))
    out = decoded(asked, book, centres.shape[1])
    return out.select(F.col("id").alias("vec_id"), F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


REG.add("codebook_decode", decode_query, f"WITH {_C}, t AS (SELECT code, sum(c) AS t FROM c GROUP BY 1) SELECT vec_id, round(CASE WHEN vec_id % 7 = 0 THEN 0 ELSE t END, 6) AS total FROM embeddings LEFT JOIN t ON code = label", "embeddings")

# Vector quality and algebra


def quality_of(a: np.ndarray, b: np.ndarray) -> tuple:
    """ARR1-4: mse, mae, psnr (peak: greatest magnitude), snr, cosine, greatest error, Euclidean distance."""
    if len(a) != len(b) or not len(a):
        return None, None, None, None, 0.0, None, None
    e = a - b
    mse, peak, power = float((e**2).mean()), float(np.abs(a).max()), float((a**2).sum())
    db = lambda x: None if mse == 0 or x == 0 else float(10 * np.log10(x))
    return mse, float(np.abs(e).mean()), db(peak**2 / mse) if mse else None, db(power / (e**2).sum()) if mse else None, _cos(a, b), float(np.abs(e).max()), float(np.sqrt((e**2).sum()))


_QUALITY = ("mse", "mae", "psnr", "snr", "cosine", "most", "distance")


def tensor_quality(vectors: DataFrame) -> DataFrame:
    """ARR1-4, AGG6-7, TOP2, NUM11: each vector against its INT4 form, with the grade of its cosine."""
    share_code(vectors.sparkSession)
    from quern.operators.catalogs import cosine_grade

    def one(v: np.ndarray) -> tuple:
        s, q = int4(v)
        return quality_of(v, (q - 8) * np.repeat(s, BLOCK)[: len(v)])

    q = per_vector(one, "mse double, mae double, psnr double, snr double, cosine double, most double, distance double", _QUALITY)
    s = vectors.select("vec_id", q.alias("q")).select("vec_id", "q.*")
    digits = {"mse": 8, "psnr": 4, "snr": 4}
    return s.select("vec_id", *[F.round(c, digits.get(c, 6)).alias(c) for c in _QUALITY], cosine_grade(F.col("cosine")).alias("grade"))


_TQ = f"{_L}, {_Q}, t AS (SELECT vec_id, avg((v - (q - 8) * s) ** 2) AS mse, avg(abs(v - (q - 8) * s)) AS mae, 10 * log10(max(abs(v)) ** 2 / avg((v - (q - 8) * s) ** 2)) AS psnr, 10 * log10(sum(v * v) / sum((v - (q - 8) * s) ** 2)) AS snr, sum(v * (q - 8) * s) / sqrt(sum(v * v) * sum(((q - 8) * s) ** 2)) AS cosine, max(abs(v - (q - 8) * s)) AS most, sqrt(sum((v - (q - 8) * s) ** 2)) AS distance FROM q GROUP BY 1), gr AS (SELECT *, CASE WHEN cosine >= 0.999 THEN 'Excellent' WHEN cosine >= 0.99 THEN 'Good' WHEN cosine >= 0.95 THEN 'Acceptable' WHEN cosine >= 0.9 THEN 'Degraded' ELSE 'Poor' END AS grade FROM t)"
REG.add("tensor_quality", tensor_quality, f"WITH {_TQ} SELECT vec_id, round(mse, 8) AS mse, round(mae, 6) AS mae, round(psnr, 4) AS psnr, round(snr, 4) AS snr, round(cosine, 6) AS cosine, round(most, 6) AS most, round(distance, 6) AS distance, grade FROM gr", "embeddings")


def quality_summary(reports: DataFrame) -> DataFrame:
    """AGG6: one row: mean, least and greatest figures, the share with a cosine of 0.95 and more, and the overall grade."""
    a, low, ok = F.avg("cosine"), F.min("cosine"), F.avg((F.col("cosine") >= 0.95).cast("double"))
    g = reports.agg(F.count(F.lit(1)).alias("reports"), a.alias("a"), low.alias("low"), ok.alias("ok"), F.avg("mse").alias("m"), F.max("mse").alias("mm"), F.avg("psnr").alias("p"))
    grade = F.when((F.col("a") >= 0.999) & (F.col("low") >= 0.99), "Excellent").when((F.col("a") >= 0.99) & (F.col("low") >= 0.95), "Good").when((F.col("a") >= 0.95) & (F.col("ok") >= 0.95), "Acceptable").when(F.col("a") >= 0.9, "Degraded").otherwise("Poor")
    return g.select("reports", F.round("a", 5).alias("mean_cosine"), F.round("low", 5).alias("least_cosine"), F.round("ok", 6).alias("acceptable"), F.round("m", 7).alias("mean_mse"), F.round("mm", 7).alias("most_mse"), F.round("p", 3).alias("mean_psnr"), grade.alias("grade"))


REG.add("quality_summary", lambda v: quality_summary(tensor_quality(v)), f"WITH {_TQ} SELECT count(*) AS reports, round(avg(cosine), 5) AS mean_cosine, round(min(cosine), 5) AS least_cosine, round(count(*) FILTER (cosine >= 0.95) / count(*), 6) AS acceptable, round(avg(mse), 7) AS mean_mse, round(max(mse), 7) AS most_mse, round(avg(psnr), 3) AS mean_psnr, CASE WHEN avg(cosine) >= 0.999 AND min(cosine) >= 0.99 THEN 'Excellent' WHEN avg(cosine) >= 0.99 AND min(cosine) >= 0.95 THEN 'Good' WHEN avg(cosine) >= 0.95 AND count(*) FILTER (cosine >= 0.95) / count(*) >= 0.95 THEN 'Acceptable' WHEN avg(cosine) >= 0.9 THEN 'Degraded' ELSE 'Poor' END AS grade FROM gr", "embeddings")
REG.add("worst_quality", lambda v: tensor_quality(v).orderBy("cosine", "vec_id").limit(10).select("vec_id", "cosine"), f"WITH {_TQ} SELECT vec_id, round(cosine, 6) AS cosine FROM gr ORDER BY round(cosine, 6), vec_id LIMIT 10", "embeddings")


def algebra(vectors: DataFrame) -> DataFrame:
    """ARR5, ARR8: of each vector x and its reverse y, summed up: x + y, x - y, x * y, 2x, signs, masked values, sparsity; and the four signals of its segments over the greatest."""
    x = F.col("embedding").cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    v = vectors.select("vec_id", x.alias("x"), F.reverse(x).alias("y"), F.size(x).alias("n"))
    part = lambda a, b: F.abs(total(F.slice("x", a + 1, b)))
    eighth, quarter, half = F.floor(F.col("n") / 8).cast("int"), F.floor(F.col("n") / 4).cast("int"), F.floor(F.col("n") / 2).cast("int")
    signals = {"face": part(F.lit(0), eighth), "body": part(eighth, eighth), "background": part(quarter, quarter), "style": part(half, F.col("n") - half)}
    most = F.greatest(*signals.values())
    return v.select("vec_id", F.round(total(F.zip_with("x", "y", lambda a, b: a + b)), 5).alias("added"), F.round(total(F.transform(F.zip_with("x", "y", lambda a, b: a - b), F.abs)), 5).alias("subtracted"), F.round(total(F.zip_with("x", "y", lambda a, b: a * b)), 5).alias("product"), F.round(total(F.transform("x", lambda a: a * 2)), 5).alias("scaled"), total(F.transform("x", lambda a: F.signum(a))).alias("signs"), F.round(total(F.filter("x", lambda a: a > 0)), 5).alias("masked"), F.round(F.size(F.filter("x", lambda a: F.abs(a) < 0.05)) / F.col("n"), 6).alias("sparsity"), *[F.round(s / most, 5).alias(k) for k, s in signals.items()])


REG.add("vector_algebra", algebra, f"WITH {_L}, s AS (SELECT a.vec_id, sum(a.v + b.v) AS added, sum(abs(a.v - b.v)) AS sub, sum(a.v * b.v) AS product, sum(2 * a.v) AS scaled, sum(sign(a.v))::DOUBLE AS signs, sum(CASE WHEN a.v > 0 THEN a.v ELSE 0 END) AS masked, count(*) FILTER (abs(a.v) < 0.05) / count(*) AS sparsity, abs(sum(a.v) FILTER (a.pos < 8)) AS f, abs(sum(a.v) FILTER (a.pos BETWEEN 8 AND 15)) AS b, abs(sum(a.v) FILTER (a.pos BETWEEN 16 AND 31)) AS g, abs(sum(a.v) FILTER (a.pos >= 32)) AS s FROM l a JOIN l b ON a.vec_id = b.vec_id AND b.pos = {DIM - 1} - a.pos GROUP BY 1) SELECT vec_id, round(added, 5) AS added, round(sub, 5) AS subtracted, round(product, 5) AS product, round(scaled, 5) AS scaled, signs, round(masked, 5) AS masked, round(sparsity, 6) AS sparsity, round(f / greatest(f, b, g, s), 5) AS face, round(b / greatest(f, b, g, s), 5) AS body, round(g / greatest(f, b, g, s), 5) AS background, round(s / greatest(f, b, g, s), 5) AS style FROM s", "embeddings")

# Merges


def slerp(a: np.ndarray, b: np.ndarray, t: float, epsilon: float = 1e-6) -> np.ndarray:
    """M2-3: along the arc between two directions with norms interpolated; a straight line where one has no norm or they are parallel."""
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    if na < epsilon or nb < epsilon:
        return a * (1 - t) + b * t
    d = float(np.clip(a @ b / (na * nb), -1, 1))
    theta = np.arccos(d)
    if abs(d) > 1 - epsilon or np.sin(theta) < epsilon:
        return a * (1 - t) + b * t
    return (np.sin((1 - t) * theta) * a / na + np.sin(t * theta) * b / nb) / np.sin(theta) * (na * (1 - t) + nb * t)


def slerp_schedule(layers: int, start: float, end: float) -> list[float]:
    """M3: a weight per layer, from start to end."""
    return [start + (end - start) * i / max(layers - 1, 1) for i in range(layers)]


def pair_merges(vectors: DataFrame, t: float = 0.3) -> DataFrame:
    """M2-3, M7: (vec_id, straight, arc, applied): norms of each vector merged with the next id's, straight and along the arc, and of the vector plus half the difference."""
    share_code(vectors.sparkSession)
    a, b = vectors.select("vec_id", F.col("embedding").alias("a")), vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))

    @F.pandas_udf("straight double, arc double, applied double")
    def norms(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(xs, ys, strict=True):
            x, y = np.asarray(x, float), np.asarray(y, float)
            rows.append([float(np.linalg.norm(z)) for z in (x * (1 - t) + y * t, slerp(x, y, t), x + (y - x) * 0.5)])
        return pd.DataFrame(rows, columns=["straight", "arc", "applied"])

    m = a.join(b, "vec_id").select("vec_id", norms("a", "b").alias("m"))
    return m.select("vec_id", *[F.round(f"m.{c}", 5).alias(c) for c in ("straight", "arc", "applied")])


REG.add("pair_merges", pair_merges, f"WITH {_L}, s AS (SELECT a.vec_id, sqrt(sum(a.v * a.v)) AS na, sqrt(sum(b.v * b.v)) AS nb, sum(a.v * b.v) AS d, sqrt(sum((a.v * 0.7::DOUBLE + b.v * 0.3::DOUBLE) ** 2)) AS straight, sqrt(sum((a.v + (b.v - a.v) * 0.5) ** 2)) AS applied FROM l a JOIN l b ON b.vec_id = a.vec_id + 1 AND a.pos = b.pos GROUP BY 1) SELECT vec_id, round(straight, 5) AS straight, round(CASE WHEN abs(d / (na * nb)) > 1 - 1e-6 THEN straight ELSE na * 0.7::DOUBLE + nb * 0.3::DOUBLE END, 5) AS arc, round(applied, 5) AS applied FROM s", "embeddings")


def dare(deltas: DataFrame, drop: float = 0.5, rescale: str = "inverse", combine: str = "sum", seed: int = 7) -> DataFrame:
    """M5: (pos, d) of (code, pos, d): values dropped by a hash, the kept rescaled (inverse, none or norm), then summed up or averaged over codes."""
    if rescale not in ("inverse", "none", "norm") or combine not in ("sum", "average"):
        raise ValueError("rescale: inverse, none or norm; combine: sum or average")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("code").cast("string"), F.col("pos").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    kept = deltas.withColumn("k", F.when(u >= drop, F.col("d")).otherwise(0.0))
    if rescale == "norm":
        w = Window.partitionBy("code")
        norm, left = F.sqrt(F.sum(F.col("d") * F.col("d")).over(w)), F.sqrt(F.sum(F.col("k") * F.col("k")).over(w))
        kept = kept.withColumn("k", F.when(left > 0, F.col("k") * norm / left).otherwise(F.col("k")))
    elif rescale == "inverse":
        kept = kept.withColumn("k", F.col("k") / (1 - drop) if drop < 1 else F.col("k"))
    return kept.groupBy("pos").agg((F.sum("k") if combine == "sum" else F.avg("k")).alias("d"))


def dare_variants(vectors: DataFrame) -> DataFrame:
    """M5: (pos, none, norm): sums without rescaling and with the norm kept, added to the base."""
    from quern.operators.vectors import deltas

    d = deltas(vectors)
    base = d.groupBy("pos").agg(F.max("base").alias("base"))
    a, b = (dare(d, rescale=r).withColumnRenamed("d", r) for r in ("none", "norm"))
    return base.join(a, "pos").join(b, "pos").select("pos", *[F.round(F.col("base") + F.col(r), 5).alias(r) for r in ("none", "norm")])


_D = _C + ", b AS (SELECT pos, avg(v) AS base FROM l GROUP BY 1), d AS (SELECT code, pos, base, round(c - base, 9) AS d FROM c JOIN b USING (pos)), k AS (SELECT *, CASE WHEN CAST('0x' || substr(md5('7:' || code || ':' || pos), 1, 8) AS BIGINT) / 4294967296.0 >= 0.5 THEN d ELSE 0 END AS k FROM d), n AS (SELECT code, sqrt(sum(d * d)) / sqrt(sum(k * k)) AS f FROM k GROUP BY 1)"
REG.add("dare_variants", dare_variants, f"WITH {_D} SELECT CAST(pos AS INT) AS pos, round(max(base) + sum(k), 5) AS none, round(max(base) + sum(k * f), 5) AS norm FROM k JOIN n USING (code) GROUP BY 1", "embeddings")


def evolve(fitness: Callable[[np.ndarray], float], models: int, population: int = 12, generations: int = 15, elite: int = 2, patience: int = 5, seed: int = 3) -> tuple[np.ndarray, list[float]]:
    """M6, L8, WIN10: (best weights, best fitness by generation): tournaments, one-point crossover, mutation, elitism; weights add up to 1. ``fitness`` may run an action."""
    rng = np.random.default_rng(seed)
    people = [w / w.sum() for w in rng.random((population, models))]
    scores, history, stale = [fitness(w) for w in people], [], 0
    for _ in range(generations):
        order = np.argsort([-s for s in scores], kind="stable")
        people, scores = [people[i] for i in order], [scores[i] for i in order]
        stale = 0 if not history or scores[0] > max(history) else stale + 1
        history.append(scores[0])
        if stale >= patience:
            break
        young = []
        while len(young) < population - elite:
            a, b = (people[min(rng.integers(0, population, 3))] for _ in range(2))
            cut = int(rng.integers(0, models))
            w = np.concatenate([a[:cut], b[cut:]])
            w = np.maximum(w + np.where(rng.random(models) < 0.2, rng.uniform(-0.1, 0.1, models), 0), 0)
            young.append(w / w.sum() if w.sum() > 0 else np.full(models, 1 / models))
        people = people[:elite] + young
        scores = scores[:elite] + [fitness(w) for w in young]
    return people[int(np.argmax(scores))], history


def evolved_merge(vectors: DataFrame) -> DataFrame:
    """(model, weight): weights of the label means whose merge is nearest to the mean of all vectors. Two actions; the search runs on a row per label."""
    codes, centres = label_centroids(vectors)
    if not len(codes):
        return vectors.sparkSession.createDataFrame([], "model int, weight double")
    n = vectors.groupBy("label").count().collect()
    share = {r["label"]: r["count"] for r in n}
    goal = np.average(centres, axis=0, weights=[share[int(c)] for c in codes])
    best, _ = evolve(lambda w: -float(((w @ centres - goal) ** 2).sum()), len(codes))
    return vectors.sparkSession.createDataFrame([(int(c), float(w)) for c, w in zip(codes, best, strict=True)], "model int, weight double")


REG.add("evolved_merge", evolved_merge, None, "embeddings")

# Learning


def fisher(vectors: DataFrame, weight: float = 0.5, gamma: float = 0.9, damping: float = 1e-3) -> DataFrame:
    """L3: per place: Fisher information (mean of squared gradients plus damping), its blend with that of even ids, the penalty's gradient at the mean, and the penalty.

    Vectors are gradients, the overall mean the optimum, the mean of label 0 the current parameters.
    """
    long = vectors.select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "g"))
    sq = F.col("g") * F.col("g")
    f = long.groupBy("pos").agg((F.avg(sq) + damping).alias("f"), (F.avg(F.when(F.col("vec_id") % 2 == 0, sq)) + damping).alias("new"), F.avg("g").alias("opt"), F.avg(F.when(F.col("label") == 0, F.col("g"))).alias("cur"))
    gap = F.col("cur") - F.col("opt")
    return f.select("pos", F.round("f", 7).alias("fisher"), F.round(gamma * F.col("f") + (1 - gamma) * F.col("new"), 7).alias("online"), F.round(weight * F.col("f") * gap, 7).alias("gradient"), F.round(0.5 * weight * F.col("f") * gap * gap, 8).alias("penalty"))


REG.add("ewc_fisher", fisher, f"WITH {_L}, f AS (SELECT pos, avg(v * v) + 1e-3 AS f, avg(v * v) FILTER (vec_id % 2 = 0) + 1e-3 AS n, avg(v) AS o, avg(v) FILTER (label = 0) AS c FROM l GROUP BY 1) SELECT CAST(pos AS INT) AS pos, round(f, 7) AS fisher, round(0.9::DOUBLE * f + 0.1::DOUBLE * n, 7) AS online, round(0.5 * f * (c - o), 7) AS gradient, round(0.25 * f * (c - o) ** 2, 8) AS penalty FROM f", "embeddings")


def synaptic(vectors: DataFrame, damping: float = 0.1, c: float = 0.5) -> DataFrame:
    """L4: per place: omega = sum(-gradient * move) / (|total move| + damping), and the penalty of the mean against the first vector.

    Vectors in order of id are parameters from step to step; the gradient is the move reversed and halved. Moves are measured from the first vector each time.
    """
    long = vectors.select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "p"))
    ends = vectors.agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("b")).first()
    if ends["a"] is None:
        return vectors.sparkSession.createDataFrame([], "pos int, omega double, penalty double")
    first = long.where(F.col("vec_id") == ends["a"]).select("pos", F.col("p").alias("first"))
    last = long.where(F.col("vec_id") == ends["b"]).select("pos", F.col("p").alias("last"))
    move = F.col("p") - F.col("first")
    g = long.join(F.broadcast(first), "pos").groupBy("pos").agg(F.sum(0.5 * move * move).alias("run"), F.avg("p").alias("mean"), F.first("first").alias("first")).join(F.broadcast(last), "pos")
    omega = F.col("run") / (F.abs(F.col("last") - F.col("first")) + damping)
    return g.select("pos", F.round(omega, 5).alias("omega"), F.round(c * omega * F.pow(F.col("mean") - F.col("first"), F.lit(2.0)), 6).alias("penalty"))


REG.add("synaptic_omega", synaptic, f"WITH {_L}, e AS (SELECT pos, arg_min(v, vec_id) AS a, arg_max(v, vec_id) AS z FROM l GROUP BY 1), g AS (SELECT l.pos, sum(0.5 * (v - a) ** 2) / (abs(any_value(z) - any_value(a)) + 0.1::DOUBLE) AS o, avg(v) - any_value(a) AS m FROM l JOIN e USING (pos) GROUP BY 1) SELECT CAST(pos AS INT) AS pos, round(o, 5) AS omega, round(0.5 * o * m ** 2, 6) AS penalty FROM g", "embeddings")


def lora_factors(dim: int = DIM, rank: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Small fixed factors for the queries: a[i, r], b[r, o]."""
    i, r = np.arange(dim)[:, None], np.arange(rank)[None, :]
    return ((i * 7 + r * 3) % 11 - 5) / 50, (((r.T * 5 + np.arange(dim)[None, :] * 2) % 13) - 6) / 50


def lora(vectors: DataFrame, a: np.ndarray, b: np.ndarray, scale: float = 2.0, enabled: bool = True) -> DataFrame:
    """(vec_id, y): scale * B(A x), zeros if disabled; vectors of another length give null."""
    share_code(vectors.sparkSession)

    def one(v: np.ndarray) -> tuple:
        if len(v) != a.shape[0]:
            return (None,)
        return ((scale * (v @ a @ b)).tolist() if enabled else [0.0] * b.shape[1],)

    return vectors.select("vec_id", per_vector(one, "y array<double>", ("y",)).alias("s")).select("vec_id", "s.y")


def lora_merge(base: np.ndarray, a: np.ndarray, b: np.ndarray, scale: float = 2.0) -> np.ndarray:
    """The base weights plus scale * A B."""
    return base + scale * (a @ b)


REG.add("lora_forward", lambda v: lora(v, *lora_factors()).select("vec_id", F.round(F.aggregate("y", F.lit(0.0), lambda s, x: s + x * x), 6).alias("energy")), f"WITH {_L}, h AS (SELECT vec_id, r, sum(v * ((pos * 7 + r * 3) % 11 - 5) / 50) AS h FROM l, range(4) x(r) GROUP BY 1, 2), y AS (SELECT vec_id, o, 2 * sum(h * ((r * 5 + o * 2) % 13 - 6) / 50) AS y FROM h, range({DIM}) x(o) GROUP BY 1, 2) SELECT vec_id, round(sum(y * y), 6) AS energy FROM y GROUP BY 1", "embeddings")


def replay(events: DataFrame, most: int = 2000, batch: int = 16, beta: float = 0.4) -> DataFrame:
    """L2: (segment, event_id, weight): of the last ``most`` experiences, one per equal share of all priority: the first whose running priority reaches the middle of its segment; importance weights over their greatest. A sampling operator."""
    last = events.where("value > 0").orderBy(F.desc("event_id")).limit(most)
    w = Window.orderBy("event_id")  # the bounded buffer
    e = last.select("event_id", "value", F.sum("value").over(w).alias("upto"), F.sum("value").over(Window.partitionBy()).alias("all"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    size = F.col("all") / batch
    first, to = F.ceil((F.col("upto") - F.col("value")) / size - 0.5), F.floor(F.col("upto") / size - 0.5)
    hit = e.where(to >= F.greatest(first, F.lit(0))).withColumn("segment", F.explode(F.sequence(F.greatest(first, F.lit(0)), to))).where(F.col("segment") < batch)
    hit = hit.groupBy("event_id").agg(F.min("segment").alias("segment"), F.first("value").alias("value"), F.first("all").alias("all"), F.first("n").alias("n"))
    weight = F.pow(F.col("n") * F.col("value") / F.col("all"), F.lit(-beta))
    return hit.withColumn("w", weight).select("segment", "event_id", F.round(F.col("w") / F.max("w").over(Window.partitionBy()), 6).alias("weight"))


REG.add("replay_sample", replay, "WITH b AS (SELECT event_id, value FROM events WHERE value > 0 ORDER BY event_id DESC LIMIT 2000), e AS (SELECT *, sum(value) OVER (ORDER BY event_id) AS upto, sum(value) OVER () AS t, count(*) OVER () AS n FROM b), h AS (SELECT s, min(event_id) AS event_id FROM e, range(16) r(s) WHERE upto >= (s + 0.5) * t / 16 GROUP BY 1), u AS (SELECT min(s) AS segment, event_id FROM h GROUP BY event_id), w AS (SELECT segment, event_id, pow(n * value / t, -0.4::DOUBLE) AS w FROM u JOIN e USING (event_id)) SELECT segment, event_id, round(w / max(w) OVER (), 6) AS weight FROM w", "events")


def surrogate(candidates: DataFrame, observations: DataFrame, explore: float = 0.1) -> DataFrame:
    """(id, mean, std, ucb) of candidates (id, x in 0 to 1): kernel-weighted mean and deviation of a bounded list of observations (x, y). A stated candidate set against all observations, in the row."""
    seen = [(float(r["x"]), float(r["y"])) for r in observations.where("x IS NOT NULL AND y IS NOT NULL").limit(1001).collect()]
    if len(seen) > 1000:
        raise ValueError("more than 1000 observations")
    if not seen:
        return candidates.select("id", F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"), F.lit(explore).alias("ucb"))
    table = F.from_json(F.lit(str([{"x": x, "y": y} for x, y in seen]).replace("'", '"')), "array<struct<x:double,y:double>>")
    fold = F.aggregate(table, F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, o: F.struct((s["w"] + F.exp(-10 * F.pow(F.col("x") - o["x"], F.lit(2.0)))).alias("w"), (s["a"] + F.exp(-10 * F.pow(F.col("x") - o["x"], F.lit(2.0))) * o["y"]).alias("a"), (s["b"] + F.exp(-10 * F.pow(F.col("x") - o["x"], F.lit(2.0))) * o["y"] * o["y"]).alias("b")))
    c = candidates.select("id", fold.alias("f")).select("id", (F.col("f.a") / F.col("f.w")).alias("mean"), (F.col("f.b") / F.col("f.w")).alias("sq"))
    std = F.sqrt(F.greatest(F.col("sq") - F.col("mean") * F.col("mean"), F.lit(0.01)))
    return c.select("id", F.round("mean", 6).alias("mean"), F.round(std, 6).alias("std"), F.round(F.col("mean") + explore * std, 6).alias("ucb"))


REG.add("search_surrogate", lambda p, s: surrogate(p.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("x")), s.where("s_suppkey < 40").select((F.col("s_nationkey") / 25.0).alias("x"), (F.col("s_acctbal") / 10000).alias("y"))), "WITH o AS (SELECT s_nationkey / 25.0::DOUBLE AS x, s_acctbal / 10000 AS y FROM supplier WHERE s_suppkey < 40), w AS (SELECT p_partkey AS id, exp(-10 * (p_size / 50.0::DOUBLE - x) ** 2) AS w, y FROM part, o), m AS (SELECT id, sum(w * y) / sum(w) AS m, sum(w * y * y) / sum(w) AS q FROM w GROUP BY 1) SELECT id, round(m, 6) AS mean, round(sqrt(greatest(q - m * m, 0.01)), 6) AS std, round(m + 0.1::DOUBLE * sqrt(greatest(q - m * m, 0.01)), 6) AS ucb FROM m", "part", "supplier")


def tune(objective: Callable[[float], float], trials: int = 20, start: int = 5, seed: int = 2) -> list[tuple[float, float]]:
    """Trials of one parameter in 0 to 1: some at random, then those of the greatest upper bound among random candidates. ``objective`` may run an action."""
    rng, seen = np.random.default_rng(seed), []
    for t in range(trials):
        x = float(rng.random())
        if t >= start:
            cand = rng.random(64)
            w = np.exp(-10 * (cand[:, None] - np.array([a for a, _ in seen])) ** 2)
            y = np.array([b for _, b in seen])
            mean = (w * y).sum(1) / w.sum(1)
            std = np.sqrt(np.maximum((w * y * y).sum(1) / w.sum(1) - mean**2, 0.01))
            x = float(cand[int((mean + 0.1 * std).argmax())])
        seen.append((x, float(objective(x))))
    return seen


def tuned(vectors: DataFrame) -> DataFrame:
    """(trial, x, objective, best): the share of coefficients that trades size against the mean cosine; a batch of vectors, one action, is evaluated by each trial."""
    rows = vectors.where("size(embedding) > 0 AND size(embedding) % 8 = 0").orderBy("vec_id").limit(32).collect()
    batch = [np.asarray(r["embedding"], float) for r in rows]
    seen = tune(lambda s: float(np.mean([compressive(v, 8, max(s, 0.02))[3] for v in batch]) - 0.5 * s) if batch else 0.0)
    best = max(range(len(seen)), key=lambda i: seen[i][1])
    return vectors.sparkSession.createDataFrame([(i, x, y, i == best) for i, (x, y) in enumerate(seen)], "trial int, x double, objective double, best boolean")


REG.add("auto_tune", tuned, None, "embeddings")


def layer_norms(vectors: DataFrame) -> DataFrame:
    """Softmax and layer normalisation of each vector, and its GELU and product with a fixed matrix, summed up."""
    share_code(vectors.sparkSession)

    def one(v: np.ndarray) -> tuple:
        if not len(v):
            return None, None, None, None
        p = np.exp(v - v.max())
        p /= p.sum()
        z = (v - v.mean()) / np.sqrt(v.var() + 1e-5)
        gelu = 0.5 * v * (1 + np.tanh(np.sqrt(2 / np.pi) * (v + 0.044715 * v**3)))
        return float(p.max()), float(np.abs(z).max()), float(gelu.sum()), float((v @ (np.add.outer(np.arange(len(v)), np.arange(len(v))) % 3 - 1)).sum())

    s = per_vector(one, "softmax double, norm double, gelu double, product double", ("softmax", "norm", "gelu", "product"))
    return vectors.select("vec_id", s.alias("s")).select("vec_id", *[F.round(f"s.{c}", 5).alias(c) for c in ("softmax", "norm", "gelu", "product")])


REG.add("layer_functions", layer_norms, f"WITH {_L}, m AS (SELECT vec_id, max(v) AS m, avg(v) AS a, sqrt(var_pop(v) + 1e-5) AS s FROM l GROUP BY 1) SELECT vec_id, round(1 / sum(exp(v - m)), 5) AS softmax, round(max(abs(v - a) / s), 5) AS norm, round(sum(0.5 * v * (1 + tanh(sqrt(2 / pi()) * (v + 0.044715::DOUBLE * v ** 3)))), 5) AS gelu, round(sum(v * (SELECT sum((pos + j) % 3 - 1) FROM range({DIM}) r(j))), 5) AS product FROM l JOIN m USING (vec_id) GROUP BY 1", "embeddings")
QUERIES, ORACLE_SQL = REG.queries, REG.sql
