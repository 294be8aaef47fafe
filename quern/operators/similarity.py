"""Content identity, signatures of byte strings, banded candidates and their scores.

A value's bytes are cut into chunks of CHUNK bytes that don't overlap; the last
one may be shorter. Its signature is a SimHash of 256 bits (a majority vote,
strictly over half, of the bits of the chunks' SHA-256), a MinHash of 64 values
((a * h + b) mod P of the chunks' leading 32 bits) and a statistical fingerprint
of its 16-bit floats. Signatures are made in the row, in Arrow batches; values
and chunks are exchanged nowhere. Null texts are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.registry import Registry
from quern.session import share_code
from quern.sources.containers import stored

REG = Registry()
CHUNK, HASHES, BANDS, P = 8, 64, 8, (1 << 31) - 1
#: Multipliers and shifts by powers of a primitive root of P.
SEEDS = [(pow(48271, 2 * i + 1, P), pow(48271, 2 * i + 2, P)) for i in range(HASHES)]
_A, _B = (np.array([s[k] for s in SEEDS], dtype=np.int64)[:, None] for k in (0, 1))
NONE = (1 << 32) - 1  # the MinHash of no chunk
EXACT, NEAR, SIMILAR = 0.9999, 0.995, 0.9
#: n-grams, each some tens of bytes, that are sent to every executor at once.
MOST_GRAMS = 1_000_000


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def exact_classes(docs: DataFrame) -> DataFrame:
    """(content_id, doc_id, copies, saved_bytes) per distinct text: one representative, the least id."""
    t = text_of()
    g = docs.groupBy(F.substring(F.sha2(F.encode(t, "UTF-8"), 256), 1, 32).alias("content_id"))
    return g.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max(F.octet_length(t)).cast("long").alias("_b")).select("content_id", "doc_id", "copies", (F.col("_b") * (F.col("copies") - 1)).alias("saved_bytes"))


def simhash(digests: np.ndarray) -> np.ndarray:
    """SIM2: 32 bytes by majority over rows of 32-byte digests; bit j of byte b counts bit j of byte b."""
    ones = np.zeros(256, dtype=np.int64)
    for i in range(0, len(digests), 1 << 14):
        ones += np.unpackbits(digests[i : i + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(digests), bitorder="little")


def minhash(digests: np.ndarray) -> np.ndarray:
    """SIM3: 64 minima over chunks."""
    if not len(digests):
        return np.full(HASHES, NONE, dtype=np.int64)
    h = np.unique(digests[:, :4].copy().view(">u4").astype(np.int64).ravel() % P)
    return np.concatenate([((_A * h[None, i : i + 4096] + _B) % P).min(axis=1)[None] for i in range(0, len(h), 4096)]).min(axis=0)


def statistics(value: bytes) -> tuple[list[int], list[int]]:
    """SIM4: ([mean, deviation, least, greatest], 16 bins) of the finite 16-bit floats: -10 to 10 in 16 bits; counts up to 255, over the greatest."""
    if not value:
        return [0, 0, 0, 0], [0] * 16
    x = np.frombuffer(value[: len(value) // 2 * 2], dtype="<f2").astype(np.float64)
    x = x[np.isfinite(x)]
    if not len(x):
        return [32768, 0, 32768, 32768], [0] * 16
    lo, hi = x.min(), x.max()
    bins = np.minimum(np.bincount(np.minimum(np.floor((x - lo) / max(hi - lo, 1e-6) * 15.999).astype(int), 15), minlength=16), 255)
    scaled = (np.clip([x.mean(), x.std(), lo, hi], -10, 10) + 10) / 20 * 65535
    return [int(s) for s in scaled], [int(c / bins.max() * 255) for c in bins]


def signature(value: bytes, chunk: int = CHUNK) -> tuple:
    """SIM1: (simhash hex, minhash, stats, bins)."""
    digests = b"".join(hashlib.sha256(value[i : i + chunk]).digest() for i in range(0, len(value), chunk))
    d = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 32)
    return simhash(d).tobytes().hex(), minhash(d), *statistics(value)


def signed(docs: DataFrame) -> DataFrame:
    """SIM1: (doc_id, text_id, simhash, minhash, stats, bins) per row."""
    share_code(docs.sparkSession)

    @F.pandas_udf("simhash string, minhash array<long>, stats array<int>, bins array<int>")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            yield pd.DataFrame([signature(bytes(v)) for v in values], columns=["simhash", "minhash", "stats", "bins"])

    raw = F.encode(text_of(), "UTF-8")
    return docs.select("doc_id", F.sha2(raw, 256).alias("text_id"), each(raw).alias("s")).select("doc_id", "text_id", "s.*")


def distinct_signed(docs: DataFrame) -> DataFrame:
    """(doc_id, copies, simhash, minhash, stats, bins): one row per text, by its least id, as a table."""
    classes = docs.groupBy(F.sha2(F.encode(text_of(), "UTF-8"), 256).alias("text_id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    s = signed(docs).dropDuplicates(["text_id"]).drop("doc_id")
    return stored(classes.join(s, "text_id").drop("text_id"), "signatures")


def simhash_distance(a: Column, b: Column) -> Column:
    """SIM5: differing bits of two hex-spelled hashes."""
    word = lambda c, i: F.conv(F.substring(c, 8 * i + 1, 8), 16, 10).cast("long")
    return sum((F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(8)), F.lit(0))


def minhash_similarity(a: Column, b: Column) -> Column:
    """SIM5: the share of equal minima."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / float(HASHES)


def statistics_similarity(a: Column, ha: Column, b: Column, hb: Column) -> Column:
    """SIM5: 0.3 by means, 0.2 by deviations, 0.5 by the cosine of the bins (0 without any)."""
    gap = lambda i: 1 - F.abs(a[i] - b[i]) / 65535.0
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(ha, ha)) * F.sqrt(dot(hb, hb))
    return gap(0) * 0.3 + gap(1) * 0.2 + F.when(size > 0, dot(ha, hb) / size).otherwise(0.0) * 0.5


def similarity(a: str, b: str) -> Column:
    """SIM5: 0.4 SimHash, 0.4 MinHash, 0.2 statistics, of the signatures in structs ``a`` and ``b``."""
    f = lambda s, c: F.col(f"{s}.{c}")
    bits = 1 - simhash_distance(f(a, "simhash"), f(b, "simhash")) / 256.0
    return bits * 0.4 + minhash_similarity(f(a, "minhash"), f(b, "minhash")) * 0.4 + statistics_similarity(f(a, "stats"), f(a, "bins"), f(b, "stats"), f(b, "bins")) * 0.2


def match_class(score: Column) -> Column:
    """SIM7: the class of a score."""
    return F.when(score >= EXACT, "exact").when(score >= NEAR, "near").when(score >= SIMILAR, "similar").otherwise("weak")


def bands(signatures: DataFrame, n: int = BANDS) -> DataFrame:
    """SIM6: ``signatures`` with (band, key): n slices of the SimHash bytes; n divides 32."""
    if n < 1 or 32 % n:
        raise ValueError("the number of bands divides 32")
    width = 64 // n
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.substring("simhash", i * width + 1, width).alias("key")) for i in range(n)])
    return signatures.withColumn("k", F.explode(keys)).select("*", "k.*").drop("k")


def find_similar(asked: DataFrame, index: DataFrame, least: float = SIMILAR, most: int | None = 10, n: int = BANDS) -> DataFrame:
    """SIM6-7, JOIN4: (query_id, rank, doc_id, similarity, match): of the rows of ``index`` that share a band with an asked signature, the ``most`` most similar ones of at least ``least``. The asked ones are a stated set."""
    q = bands(asked, n).select(F.col("doc_id").alias("query_id"), "band", "key")
    cand = q.join(bands(index, n).select("doc_id", "band", "key"), ["band", "key"]).where("query_id <> doc_id").select("query_id", "doc_id").distinct()
    body = lambda t, i, s: t.select(F.col("doc_id").alias(i), F.struct("simhash", "minhash", "stats", "bins").alias(s))
    full = cand.join(body(asked, "query_id", "a"), "query_id").join(body(index, "doc_id", "b"), "doc_id")
    scored = full.select("query_id", "doc_id", F.round(similarity("a", "b"), 9).alias("similarity")).where(F.col("similarity") >= least)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "doc_id"))
    out = scored.withColumn("rank", rank)
    return (out if most is None else out.where(F.col("rank") <= most)).withColumn("match", match_class(F.col("similarity")))


def similar_documents(docs: DataFrame) -> DataFrame:
    """SIM7: every tenth id asked, in bands of two bytes, weak matches from 0.4 on included."""
    s = distinct_signed(docs)
    return find_similar(s.where("doc_id % 10 = 0"), s, 0.4, n=16).select("query_id", "rank", "doc_id", F.round("similarity", 5).alias("similarity"), "match")


def duplicate_lookup(docs: DataFrame) -> DataFrame:
    """JOIN5: (query_id, doc_id, match): the best match of an asked text if it is exact or near."""
    s = distinct_signed(docs)
    return find_similar(s.where("doc_id % 2 = 0"), s, NEAR, 1).select("query_id", "doc_id", "match")


def deduplicated(docs: DataFrame) -> DataFrame:
    """SET2: (doc_id, leader, copies): per distinct text the least id among it and its near matches; copies add to its references.

    Which near matches lead is fixed by id, not by the order of arrival.
    """
    s = distinct_signed(docs)
    near = find_similar(s, s, NEAR, None).groupBy(F.col("query_id").alias("doc_id")).agg(F.min(F.col("doc_id")).alias("least"))
    return s.select("doc_id", "copies").join(near, "doc_id", "left").select("doc_id", F.least("doc_id", "least").alias("leader"), "copies")


def bucket_stats(docs: DataFrame) -> DataFrame:
    """SIM8: one row: signatures, buckets, fragments a bucket (as the index reports it), memberships a bucket, the largest."""
    s = distinct_signed(docs)
    b = bands(s).groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
    return b.agg(F.round(F.sum("n") / BANDS, 6).alias("fragments"), F.count(F.lit(1)).alias("buckets"), F.round(F.sum("n") / BANDS / F.count(F.lit(1)), 6).alias("avg_bucket"), F.round(F.sum("n") / F.count(F.lit(1)), 6).alias("memberships"), F.max("n").alias("largest"))


def shared_grams(docs: DataFrame, bench: DataFrame, n: int = 8) -> DataFrame:
    """(doc_id, shared): documents by the number of distinct word n-grams that they share with ``bench``.

    A document's n-grams are looked up where they are made, so only shared ones are exchanged; a bench of more than MOST_GRAMS is joined by exchanges.
    """

    def grams(df: DataFrame, *keep: str) -> DataFrame:
        w = F.filter(F.split(F.lower(text_of()), r"[^\p{L}\p{N}]+"), lambda x: x != "")
        d = df.select(*keep, w.alias("w"))
        at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        # Without "outer" all n-grams would be made once more for a filter on their number; the join drops what it adds.
        return d.select(*keep, F.explode_outer(F.transform(at, lambda i: F.concat_ws(" ", F.slice("w", i, n)))).alias("gram"))

    asked = stored(grams(bench).where(F.col("gram").isNotNull()).distinct(), "grams")
    few = asked.count() <= MOST_GRAMS
    hit = grams(docs, "doc_id").join(F.broadcast(asked), "gram") if few else grams(docs, "doc_id").distinct().join(asked, "gram")
    return hit.select("doc_id", "gram").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))


# The SQL follows the definition above, byte by byte.
_BIT = [(b // 4, 8 * (3 - b % 4) + j, b, j) for b in range(32) for j in range(8)]
_SIM = " || ".join("printf('%02x', " + " + ".join(f"CASE WHEN 2 * sum((w{k} >> {s}) & 1) > count(*) THEN {1 << j} ELSE 0 END" for k, s, bb, j in _BIT if bb == b) + ")" for b in range(32))
_MIN = ", ".join(f"min((w0 % {P} * {a} + {b}) % {P})" for a, b in SEEDS)
_SIGNED = f"""x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  ch AS (SELECT doc_id, sha256(unhex(substr(h, 16 * i + 1, 16))) AS m FROM (SELECT doc_id, h, unnest(range((length(h) + 15) // 16)) AS i FROM x)),
  cw AS (SELECT doc_id, {', '.join(f"CAST('0x' || substr(m, {8 * k + 1}, 8) AS BIGINT) AS w{k}" for k in range(8))} FROM ch),
  sm AS (SELECT doc_id, {_SIM} AS simhash, [{_MIN}] AS minhash FROM cw GROUP BY 1),
  f0 AS (SELECT doc_id, CAST('0x' || substr(h, 4 * i + 3, 2) || substr(h, 4 * i + 1, 2) AS INT) AS u FROM (SELECT doc_id, h, unnest(range(length(h) // 4)) AS i FROM x)),
  f1 AS (SELECT doc_id, CASE WHEN u >= 32768 THEN -1 ELSE 1 END * CASE WHEN (u >> 10) & 31 = 0 THEN (u & 1023) * 2.0::DOUBLE ** -24 ELSE (1024 + (u & 1023)) * 2.0::DOUBLE ** (((u >> 10) & 31) - 25) END AS v FROM f0 WHERE (u >> 10) & 31 < 31),
  f2 AS (SELECT doc_id, avg(v) AS a, stddev_pop(v) AS d, min(v) AS lo, max(v) AS hi FROM f1 GROUP BY 1),
  f3 AS (SELECT doc_id, least(floor((v - lo) / greatest(hi - lo, 1e-6) * 15.999::DOUBLE), 15) AS b, least(count(*), 255) AS c FROM f1 JOIN f2 USING (doc_id) GROUP BY 1, 2),
  f4 AS (SELECT doc_id, list_transform(range(16), lambda k: CAST(floor(coalesce(list_extract(map_extract(m, k::DOUBLE), 1), 0) / mx::DOUBLE * 255) AS INT)) AS bins FROM (SELECT doc_id, map(list(b), list(c)) AS m, max(c) AS mx FROM f3 GROUP BY 1)),
  sg AS (SELECT x.doc_id, h, coalesce(simhash, repeat('0', 64)) AS simhash, coalesce(minhash, list_transform(range({HASHES}), lambda k: {NONE})) AS minhash,
    CASE WHEN h = '' THEN [0, 0, 0, 0] WHEN f2.doc_id IS NULL THEN [32768, 0, 32768, 32768] ELSE list_transform([a, d, lo, hi], lambda q: CAST(floor((least(greatest(q, -10), 10) + 10) / 20 * 65535) AS INT)) END AS stats, coalesce(bins, list_transform(range(16), lambda k: 0)) AS bins
    FROM x LEFT JOIN sm USING (doc_id) LEFT JOIN f2 USING (doc_id) LEFT JOIN f4 USING (doc_id))"""
_CLASSES = f"{_SIGNED}, cl AS (SELECT min(doc_id) AS doc_id, count(*) AS copies, any_value(simhash) AS simhash, any_value(minhash) AS minhash, any_value(stats) AS stats, any_value(bins) AS bins FROM sg GROUP BY h)"
_HAM = " + ".join(f"CAST(bit_count(xor(CAST('0x' || substr(a.simhash, {8 * i + 1}, 8) AS BIGINT), CAST('0x' || substr(b.simhash, {8 * i + 1}, 8) AS BIGINT))) AS INT)" for i in range(8))
_PAIRS = f"""{_CLASSES}, bd AS (SELECT doc_id, r.b, substr(simhash, $w * r.b + 1, $w) AS k FROM cl, range(64 // $w) r(b)), cd AS (SELECT DISTINCT p.doc_id AS p, q.doc_id AS q FROM bd p JOIN bd q ON p.b = q.b AND p.k = q.k AND p.doc_id <> q.doc_id),
  sc AS (SELECT p, q, round((1 - ({_HAM}) / 256.0::DOUBLE) * 0.4::DOUBLE + list_sum(list_transform(range(1, {HASHES + 1}), lambda i: CASE WHEN a.minhash[i] = b.minhash[i] THEN 1 ELSE 0 END)) / {HASHES}.0::DOUBLE * 0.4::DOUBLE
    + ((1 - abs(a.stats[1] - b.stats[1]) / 65535.0::DOUBLE) * 0.3::DOUBLE + (1 - abs(a.stats[2] - b.stats[2]) / 65535.0::DOUBLE) * 0.2::DOUBLE + CASE WHEN list_sum(a.bins) > 0 AND list_sum(b.bins) > 0 THEN list_cosine_similarity(a.bins::DOUBLE[], b.bins::DOUBLE[]) ELSE 0 END * 0.5) * 0.2::DOUBLE, 9) AS s
    FROM cd JOIN cl a ON a.doc_id = p JOIN cl b ON b.doc_id = q)"""
_CLASS = f"CASE WHEN s >= {EXACT} THEN 'exact' WHEN s >= {NEAR} THEN 'near' WHEN s >= {SIMILAR} THEN 'similar' ELSE 'weak' END"
_GRAMS = r"SELECT DISTINCT {k} array_to_string(w[i : i + 7], ' ') AS gram FROM (SELECT {k} w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {k} list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM {t}))"
_text = lambda c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))
REG.add("dedup_exact", exact_classes, "SELECT substr(sha256(coalesce(text, '')), 1, 32) AS content_id, min(doc_id) AS doc_id, count(*) AS copies, CAST(max(strlen(coalesce(text, ''))) * (count(*) - 1) AS BIGINT) AS saved_bytes FROM documents GROUP BY 1", "documents")
REG.add("fragment_signatures", lambda d: signed(d).select("doc_id", "simhash", F.md5(_text("minhash")).alias("minhash"), _text("stats").alias("stats"), _text("bins").alias("bins")), f"WITH {_SIGNED} SELECT doc_id, simhash, md5(array_to_string(minhash, ',')) AS minhash, array_to_string(stats, ',') AS stats, array_to_string(bins, ',') AS bins FROM sg", "documents")
REG.add("similar_documents", similar_documents, "WITH " + _PAIRS.replace("$w", "4") + f" SELECT p AS query_id, CAST(row_number() OVER (PARTITION BY p ORDER BY s DESC, q) AS INT) AS rank, q AS doc_id, round(s, 5) AS similarity, {_CLASS} AS match FROM sc WHERE p % 10 = 0 AND s >= 0.4 QUALIFY row_number() OVER (PARTITION BY p ORDER BY s DESC, q) <= 10", "documents")
REG.add("duplicate_lookup", duplicate_lookup, "WITH " + _PAIRS.replace("$w", "8") + f" SELECT p AS query_id, q AS doc_id, {_CLASS} AS match FROM sc WHERE p % 2 = 0 AND s >= {NEAR} QUALIFY row_number() OVER (PARTITION BY p ORDER BY s DESC, q) = 1", "documents")
REG.add("dedup_near", deduplicated, "WITH " + _PAIRS.replace("$w", "8") + f" SELECT doc_id, least(doc_id, coalesce((SELECT min(q) FROM sc WHERE p = doc_id AND s >= {NEAR}), doc_id)) AS leader, copies FROM cl", "documents")
REG.add("lsh_bucket_stats", bucket_stats, f"WITH {_CLASSES}, b AS (SELECT r.b, substr(simhash, 8 * r.b + 1, 8) AS k, count(*) AS n FROM cl, range({BANDS}) r(b) GROUP BY 1, 2) SELECT round(sum(n) / {BANDS}, 6) AS fragments, count(*) AS buckets, round(sum(n) / {BANDS} / count(*), 6) AS avg_bucket, round(sum(n) / count(*), 6) AS memberships, max(n) AS largest FROM b", "documents")
REG.add("benchmark_contamination", lambda d, b: shared_grams(d, b), f"WITH d AS ({_GRAMS.format(k='doc_id,', t='documents')}), b AS ({_GRAMS.format(k='', t='benchmark')}) SELECT doc_id, count(*) AS shared FROM d JOIN b USING (gram) GROUP BY doc_id", "documents", "benchmark")
QUERIES, ORACLE_SQL = REG.queries, REG.sql
