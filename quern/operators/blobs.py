"""Byte strings: histograms, entropy, block types, hashes, codecs and dictionaries.

Each value is worked on whole inside its row by NumPy or a codec, in Arrow
batches: nothing is exploded and nothing is exchanged. Null texts are empty.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.registry import Registry
from quern.session import share_code

REG = Registry()


def raw(col: str = "text") -> Column:
    return F.encode(F.coalesce(F.col(col), F.lit("")), "UTF-8")


# Analysis


def _entropy(counts: np.ndarray) -> float:
    c = counts[counts > 0].astype(float)
    n = c.sum()
    return float(np.log2(n) - (c * np.log2(c)).sum() / n) if n else 0.0


def sampled_entropy(b: np.ndarray) -> float:
    """AGG23: entropy of at most 256 bytes at even distances; 4 for fewer than 16 bytes."""
    if len(b) < 16:
        return 4.0
    return _entropy(np.bincount(b[:: max(1, len(b) // min(256, len(b)))][:256], minlength=256))


def block_type(b: np.ndarray) -> str:
    """RLE for one repeated byte (looked up at the start and at 16 places), raw above 7.5 bits of sampled entropy or below 4 bytes."""
    if len(b) < 4:
        return "Raw"
    if (b[:64] == b[0]).all() and (len(b) <= 64 or (b[np.arange(16) * (len(b) // 16)] == b[0]).all()):
        return "Rle"
    return "Raw" if sampled_entropy(b) > 7.5 else "Compress"


def period(b: np.ndarray) -> int | None:
    """AGG22: the least period up to 8 by which over 90 % of the sampled bytes repeat."""
    if len(b) < 8:
        return None
    for p in range(1, min(8, len(b) // 2) + 1):
        at = np.arange(p, len(b), max(1, len(b) // 32))
        if len(at) and (b[at] == b[at - p]).mean() > 0.9:
            return p
    return None


def has_runs(b: np.ndarray) -> bool:
    """AGG22: whether the first 256 bytes hold a run of four."""
    h = b[:256]
    return len(b) >= 8 and len(h) > 3 and bool(((h[3:] == h[:-3]) & (h[2:-1] == h[:-3]) & (h[1:-2] == h[:-3])).any())


_COMMON = [32, *b"etaon"]


def fingerprint(value: bytes) -> tuple:
    """AGG21-23, C10, FLT8: (n, distinct, entropy, sampled, block, period, text_like, pattern, strategy)."""
    b = np.frombuffer(value, dtype=np.uint8)
    counts = np.bincount(b, minlength=256)
    n, distinct, e = len(b), int((counts > 0).sum()), abs(round(_entropy(counts), 9))
    p = period(b) if distinct > 1 else None
    texty = bool(n and counts[32:127].sum() / n > 0.8 and counts[_COMMON].sum() / n > 0.2)
    if n == 0 or distinct == 1:
        pattern = "Uniform"
    elif p:
        pattern = "Periodic"
    else:
        pattern = "LowEntropy" if e < 3 else "TextLike" if e < 5.5 and texty else "Random" if e > 7.5 else "HighEntropy"
    if n == 0:
        strategy = "RawBlock"
    elif pattern == "Uniform":
        strategy = "RleBlock"
    elif (p and p <= 4) or (pattern == "LowEntropy" and distinct <= 16):
        strategy = "RleSequences"
    elif pattern in ("TextLike", "Periodic", "LowEntropy") or (pattern == "HighEntropy" and (has_runs(b) or 0.8 + e / 40 < 0.95)):
        strategy = "PredefinedFse"
    else:
        strategy = "RawBlock"
    return n, distinct, e, sampled_entropy(b), block_type(b), p, texty, pattern, strategy


FIELDS = "n long, distinct long, entropy double, sampled double, block string, period int, text_like boolean, pattern string, strategy string"


def analysed(value: Column) -> Column:
    """The fingerprint of a binary column, as a struct of FIELDS."""

    @F.pandas_udf(FIELDS)
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            out = pd.DataFrame([fingerprint(v) for v in values], columns=[f.split()[0] for f in FIELDS.split(", ")])
            out["period"] = out["period"].astype("Int32")
            yield out

    return each(value)


def byte_entropy(docs: DataFrame) -> DataFrame:
    """Per text: bytes, distinct bytes, Shannon entropy in bits, and whether it looks compressible (FLT8)."""
    share_code(docs.sparkSession)
    a = docs.select("doc_id", analysed(raw()).alias("a"))
    return a.select("doc_id", F.col("a.n").alias("n_bytes"), F.col("a.distinct").alias("distinct_bytes"), F.round("a.entropy", 5).alias("entropy"), ((F.col("a.n") < 32) | (F.col("a.entropy") < 7.5)).alias("compressible"))


def byte_fingerprint(docs: DataFrame) -> DataFrame:
    share_code(docs.sparkSession)
    a = docs.select("doc_id", analysed(raw()).alias("a"))
    return a.select("doc_id", F.round("a.sampled", 5).alias("sampled"), "a.block", "a.period", "a.text_like", "a.pattern", "a.strategy")


def byte_histogram(docs: DataFrame) -> DataFrame:
    """AGG21: (byte, n) over all texts: 256 counts a batch are made in the worker, so the exchange is of a row per byte and batch."""
    share_code(docs.sparkSession)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(256, dtype=np.int64)
        for pdf in batches:
            for v in pdf["b"]:
                total += np.bincount(np.frombuffer(v, dtype=np.uint8), minlength=256)
        yield pd.DataFrame({"byte": np.arange(256, dtype=np.int32), "n": total})

    return docs.select(raw().alias("b")).mapInPandas(counts, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).where("n > 0")


_B = "h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), b AS (SELECT doc_id, i, n, CAST('0x' || substr(h, 2 * i + 1, 2) AS INT) AS v FROM (SELECT doc_id, h, length(h) // 2 AS n, unnest(range(length(h) // 2)) AS i FROM h))"
_E = f"{_B}, c AS (SELECT doc_id, v, any_value(n) AS n, count(*) AS c FROM b GROUP BY 1, 2), g AS (SELECT h.doc_id, coalesce(max(c.n), 0) AS n, count(c.v) AS d, abs(round(coalesce(log2(max(c.n)) - sum(c * log2(c)) / max(c.n), 0), 9)) AS e, coalesce(sum(c) FILTER (v BETWEEN 32 AND 126) / max(c.n) > 0.8 AND sum(c) FILTER (v IN (32, 101, 116, 97, 111, 110)) / max(c.n) > 0.2, FALSE) AS texty FROM h LEFT JOIN c USING (doc_id) GROUP BY 1)"
REG.add("byte_entropy", byte_entropy, f"WITH {_E} SELECT doc_id, n AS n_bytes, d AS distinct_bytes, round(e, 5) AS entropy, n < 32 OR e < 7.5 AS compressible FROM g", "documents")
REG.add(
    "byte_fingerprint",
    byte_fingerprint,
    f"""WITH {_E}, s AS (SELECT doc_id, count(*) AS k, v FROM b WHERE i % greatest(n // least(256, n), 1) = 0 AND i // greatest(n // least(256, n), 1) < 256 GROUP BY doc_id, v),
      se AS (SELECT doc_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS s FROM s GROUP BY 1),
      lg AS (SELECT doc_id, i, n, {", ".join(f"CASE WHEN v = lag(v, {k}) OVER w THEN 1 ELSE 0 END AS m{k}" for k in range(1, 9))} FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
      p AS (SELECT doc_id, CASE {" ".join(f"WHEN {k} <= any_value(n) // 2 AND avg(m{k}) FILTER (i >= {k} AND (i - {k}) % greatest(n // 32, 1) = 0) > 0.9 THEN {k}" for k in range(1, 9))} END AS period FROM lg WHERE n >= 8 GROUP BY 1),
      u AS (SELECT doc_id, bool_and(v = f) FILTER (i < 64) AND (any_value(n) <= 64 OR bool_and(v = f) FILTER (i % (n // 16 + CASE WHEN n < 16 THEN 1 ELSE 0 END) = 0 AND i < 16 * (n // 16))) AS same FROM (SELECT *, first_value(v) OVER (PARTITION BY doc_id ORDER BY i) AS f FROM b) GROUP BY 1),
      r AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, v = lag(v) OVER w AND v = lag(v, 2) OVER w AND v = lag(v, 3) OVER w AS q FROM b WHERE i < 256 AND n >= 8 WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE q),
      a AS (SELECT g.*, CASE WHEN n < 16 THEN 4 ELSE s END AS sampled, CASE WHEN d > 1 THEN period END AS period, coalesce(same, FALSE) AS same, r.doc_id IS NOT NULL AS runs, CASE WHEN d <= 1 THEN 'Uniform' WHEN period IS NOT NULL THEN 'Periodic' WHEN e < 3 THEN 'LowEntropy' WHEN e < 5.5 AND texty THEN 'TextLike' WHEN e > 7.5 THEN 'Random' ELSE 'HighEntropy' END AS pattern FROM g LEFT JOIN se USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id))
      SELECT doc_id, round(sampled, 5) AS sampled, CASE WHEN n < 4 THEN 'Raw' WHEN same THEN 'Rle' WHEN sampled > 7.5 THEN 'Raw' ELSE 'Compress' END AS block, CAST(period AS INT) AS period, texty AS text_like, pattern, CASE WHEN n = 0 THEN 'RawBlock' WHEN pattern = 'Uniform' THEN 'RleBlock' WHEN period <= 4 OR (pattern = 'LowEntropy' AND d <= 16) THEN 'RleSequences' WHEN pattern IN ('TextLike', 'Periodic', 'LowEntropy') OR (pattern = 'HighEntropy' AND (runs OR 0.8 + e / 40 < 0.95)) THEN 'PredefinedFse' ELSE 'RawBlock' END AS strategy FROM a""",
    "documents",
)
REG.add("byte_histogram", byte_histogram, f"WITH {_B} SELECT v AS byte, count(*) AS n FROM b GROUP BY 1", "documents")

# Hashes and comparisons. The two multipliers of the four-byte hash.
PRIMES = 0x9E3779B9, 0x85EBCA6B


def common_prefix(a: Column, b: Column) -> Column:
    """BIN3: the number of leading bytes that two hex-spelled values share."""
    n = F.least(F.length(a), F.length(b)) / 2
    upto = F.transform(F.sequence(F.lit(0), n.cast("int")), lambda k: F.when(F.substring(a, F.lit(1), k * 2) == F.substring(b, F.lit(1), k * 2), k).otherwise(0))
    return F.array_max(upto)


def checksums(parts: DataFrame) -> DataFrame:
    """BIN1-3: CRC-32, MD5 and SHA-256 of a value, its first four-byte hash, and what it shares with a fixed one; ``filled`` repeats a pattern to nine bytes."""
    v = F.encode("p_name", "UTF-8")
    return parts.select("p_partkey", F.crc32(v).alias("crc32"), F.md5(v).alias("md5"), F.sha2(v, 256).alias("sha256"), hash4_text("p_name").alias("hash4"), common_prefix(F.hex(v), F.hex(F.encode(F.lit("small ring"), "UTF-8"))).alias("prefix"), F.substring(F.repeat(F.substring("p_name", 1, 2), 5), 1, 9).alias("filled"))


def hash4_text(col: str) -> Column:
    """BIN2 of the first bytes of an ASCII text."""
    code = lambda i: F.ascii(F.substring(col, i, 1)).cast("long")
    word = code(1) + code(2) * 256 + code(3) * 65536 + code(4) * 16777216
    mul = lambda x, p: F.pmod(F.pmod(x * (p >> 16), F.lit(1 << 16)) * (1 << 16) + x * (p & 0xFFFF), F.lit(1 << 32))
    h = mul(word, PRIMES[0])
    return mul(h.bitwiseXOR(F.shiftright(h, 15)), PRIMES[1])


REG.add("checksums", lambda p: checksums(p).drop("crc32"), f"WITH w AS (SELECT *, CAST(ascii(p_name) AS HUGEINT) + ascii(substr(p_name, 2)) * 256 + ascii(substr(p_name, 3)) * 65536 + ascii(substr(p_name, 4)) * 16777216::HUGEINT AS w FROM part), h AS (SELECT *, CAST(w * {PRIMES[0]}::HUGEINT % 4294967296::HUGEINT AS BIGINT) AS h FROM w) SELECT p_partkey, md5(p_name) AS md5, sha256(p_name) AS sha256, CAST(xor(h, h >> 15)::HUGEINT * {PRIMES[1]}::HUGEINT % 4294967296::HUGEINT AS BIGINT) AS hash4, CAST((SELECT max(k) FROM range(0, 11) r(k) WHERE k <= strlen(p_name) AND substr(p_name, 1, k) = substr('small ring', 1, k)) AS INT) AS prefix, substr(repeat(substr(p_name, 1, 2), 5), 1, 9) AS filled FROM h", "part")


def half_bytes(value: float) -> int:
    """BIN4: 16-bit float bits of a number, cut off (not rounded), with subnormals as zero."""
    bits = int(np.float32(value).view(np.uint32))
    sign, exp, mant = bits >> 16 & 0x8000, (bits >> 23 & 0xFF) - 127 + 15, bits >> 13 & 0x3FF
    if bits & 0x7FFFFFFF == 0 or exp <= 0:
        return sign
    return sign | 0x7C00 if exp >= 31 else sign | exp << 10 | mant


def halves(vectors: DataFrame) -> DataFrame:
    """BIN4: (vec_id, bits array, error): vectors as truncated 16-bit floats, and the greatest error of reading them back."""
    share_code(vectors.sparkSession)

    @F.pandas_udf("bits array<int>, error double")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vs in batches:
            rows = []
            for v in vs:
                x = np.asarray([] if v is None else v, dtype=np.float32)
                u = x.view(np.uint32)
                exp = (u >> 23 & 0xFF).astype(np.int64) - 112
                h = (u >> 16 & 0x8000) | np.where(exp <= 0, 0, np.where(exp >= 31, 0x7C00, (np.clip(exp, 0, 31).astype(np.uint32) << 10) | (u >> 13 & 0x3FF)))
                h = h.astype(np.uint16)
                rows.append((h.astype(np.int32), float(np.abs(h.view(np.float16).astype(float) - x).max()) if len(x) else 0.0))
            yield pd.DataFrame(rows, columns=["bits", "error"])

    return vectors.select("vec_id", cut("embedding").alias("h")).select("vec_id", "h.*")


REG.add("half_floats", lambda v: halves(v).select("vec_id", F.concat_ws(",", F.transform("bits", lambda b: b.cast("string"))).alias("bits")), "WITH l AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), e AS (SELECT *, CASE WHEN x = 0 THEN -99 ELSE CAST(floor(log2(abs(x))) AS INT) END AS k FROM l) SELECT vec_id, string_agg(CAST(CASE WHEN x < 0 THEN 32768 ELSE 0 END + CASE WHEN k + 15 <= 0 THEN 0 ELSE (k + 15) * 1024 + CAST(floor((abs(x) / 2.0::DOUBLE ** k - 1) * 1024) AS INT) END AS VARCHAR), ',' ORDER BY i) AS bits FROM e GROUP BY 1", "embeddings")

# Codecs


def _zstd(level: int):
    import zstandard

    return zstandard.ZstdCompressor(level=level)


#: Name to (compress at a level, decompress). Further codecs are added by ``register_codec``.
CODECS: dict[str, tuple[Callable[[bytes, int], bytes], Callable[[bytes], bytes]]] = {
    "zlib": (lambda b, n: zlib.compress(b, n), zlib.decompress),
    "gzip": (lambda b, n: gzip.compress(b, n, mtime=0), gzip.decompress),
    "deflate": (lambda b, n: zlib.compress(b, n, wbits=-15), lambda b: zlib.decompress(b, wbits=-15)),
    "bz2": (lambda b, n: bz2.compress(b, max(1, n)), bz2.decompress),
    "xz": (lambda b, n: lzma.compress(b, preset=n), lzma.decompress),
    "zstd": (lambda b, n: _zstd(n).compress(b), lambda b: _unzstd(b)),
    "none": (lambda b, n: b, lambda b: b),
}


def _unzstd(b: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(b) if b else b


def register_codec(name: str, compress: Callable[[bytes, int], bytes], decompress: Callable[[bytes], bytes]) -> None:
    """Add a codec under a name. Both must be picklable functions."""
    CODECS[name] = compress, decompress


def _codec(name: str):
    if name not in CODECS:
        raise ValueError(f"no codec {name!r} here; there are {', '.join(sorted(CODECS))}")
    return CODECS[name]


def compressed(value: Column, codec: str = "zstd", level: int = 3) -> Column:
    """A binary column, compressed. Nulls stay null."""
    pack = _codec(codec)[0]

    @F.pandas_udf("binary")
    def each(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else pack(bytes(v), level) for v in values], dtype=object)

    return each(value)


def decompressed(value: Column, codec: str = "zstd") -> Column:
    """The inverse."""
    unpack = _codec(codec)[1]

    @F.pandas_udf("binary")
    def each(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else unpack(bytes(v)) for v in values], dtype=object)

    return each(value)


def measured(value: Column, codecs: tuple[str, ...] = ("zlib", "gzip", "deflate", "bz2", "zstd"), level: int = 3) -> Column:
    """Per codec (codec, size, same): the compressed size and whether it reads back; in one pass."""
    ways = [(c, *_codec(c)) for c in codecs]

    @F.pandas_udf("array<struct<codec:string,size:long,same:boolean>>")
    def each(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            v, row = bytes(v), []
            for name, pack, unpack in ways:
                x = pack(v, level)
                row.append({"codec": name, "size": len(x), "same": unpack(x) == v})
            out.append(row)
        return pd.Series(out)

    return each(value)


def smallest(value: Column, codecs: tuple[str, ...] = ("zlib", "bz2", "zstd"), level: int = 3) -> Column:
    """(codec, payload) of the codec with the smallest result, the earlier of equals; raw if none is smaller."""
    ways = [(c, _codec(c)[0]) for c in codecs]

    @F.pandas_udf("codec string, payload binary")
    def each(values: pd.Series) -> pd.DataFrame:
        rows = []
        for v in values:
            best = ("none", bytes(v))
            for name, pack in ways:
                x = pack(bytes(v), level)
                best = (name, x) if len(x) < len(best[1]) else best
            rows.append(best)
        return pd.DataFrame(rows, columns=["codec", "payload"])

    return each(value)


def codec_round_trip(docs: DataFrame) -> DataFrame:
    """C1-2: (doc_id, codec, n_bytes, same) for every text and codec."""
    share_code(docs.sparkSession)
    m = docs.select("doc_id", F.octet_length(raw()).cast("long").alias("n_bytes"), F.explode(measured(raw())).alias("m"))
    return m.select("doc_id", "m.codec", "n_bytes", "m.same")


def codec_ratios(docs: DataFrame) -> DataFrame:
    """Per codec: bytes in and out and their ratio."""
    share_code(docs.sparkSession)
    m = docs.select(F.octet_length(raw()).cast("long").alias("n"), F.explode(measured(raw())).alias("m"))
    return m.groupBy("m.codec").agg(F.sum("n").alias("bytes_in"), F.sum("m.size").alias("bytes_out"), F.round(F.sum("n") / F.sum("m.size"), 4).alias("ratio"))


def speculative(docs: DataFrame) -> DataFrame:
    """(doc_id, same): whether each text reads back from the smallest of several codecs."""
    share_code(docs.sparkSession)
    best = docs.select("doc_id", raw().alias("raw"), smallest(raw()).alias("s"))
    back = F.when(F.col("s.codec") == "zlib", decompressed(F.when(F.col("s.codec") == "zlib", F.col("s.payload")), "zlib"))
    back = back.when(F.col("s.codec") == "bz2", decompressed(F.when(F.col("s.codec") == "bz2", F.col("s.payload")), "bz2"))
    back = back.when(F.col("s.codec") == "zstd", decompressed(F.when(F.col("s.codec") == "zstd", F.col("s.payload")), "zstd")).otherwise(F.col("s.payload"))
    return best.select("doc_id", (back == F.col("raw")).alias("same"), (F.octet_length("s.payload") <= F.octet_length("raw")).alias("no_larger"))


def train_dictionary(docs: DataFrame, size: int = 16_384, samples: int = 2_000) -> bytes:
    """A zstd dictionary from a sample of texts by hash (the bound is a parameter). An action; b'' without enough data."""
    import zstandard

    rows = docs.select(F.substring(raw(), 1, 4096).alias("b")).where(F.octet_length("b") >= 8).orderBy(F.xxhash64("b"), "b").limit(samples).collect()
    try:
        return zstandard.train_dictionary(size, [bytes(r["b"]) for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def with_dictionary(dictionary: bytes, level: int = 3) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """(compress, decompress) of columns with a trained dictionary, which has a bounded size."""

    def run(pack: bool):
        @F.pandas_udf("binary")
        def each(values: pd.Series) -> pd.Series:
            import zstandard

            d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
            tool = zstandard.ZstdCompressor(level=level, dict_data=d) if pack else zstandard.ZstdDecompressor(dict_data=d)
            f = tool.compress if pack else tool.decompress
            return pd.Series([None if v is None else f(bytes(v)) for v in values], dtype=object)

        return each

    return run(True), run(False)


def dictionary_round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, same) through a trained dictionary."""
    share_code(docs.sparkSession)
    pack, unpack = with_dictionary(train_dictionary(docs))
    packed = docs.select("doc_id", raw().alias("raw"), pack(raw()).alias("z"))
    return packed.select("doc_id", (unpack("z") == F.col("raw")).alias("same"))


def frames(value: Column, chunk: int = 4096, codec: str = "zstd", level: int = 3) -> Column:
    """STM1: (nth, payload) frames: every ``chunk`` bytes of a value make a frame of their own."""
    pack = _codec(codec)[0]

    @F.pandas_udf("array<struct<nth:int,payload:binary>>")
    def each(values: pd.Series) -> pd.Series:
        return pd.Series([[{"nth": k, "payload": pack(bytes(v[i : i + chunk]), level)} for k, i in enumerate(range(0, len(v), chunk))] for v in values])

    return each(value)


def joined_frames(framed: DataFrame, key: str, codec: str = "zstd") -> DataFrame:
    """STM1, STM11: (key, value) of frames (key, nth, payload), in order, whatever order they came in. A key's frames are those of one value."""
    unpack = _codec(codec)[1]

    @F.pandas_udf("binary")
    def each(values: pd.Series) -> pd.Series:
        return pd.Series([b"".join(unpack(bytes(f["payload"])) for f in v) for v in values], dtype=object)

    g = framed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", "payload"))).alias("f"))
    return g.select(key, each("f").alias("value"))


def frame_round_trip(docs: DataFrame) -> DataFrame:
    """STM1: (doc_id, frames, same): texts through frames and back."""
    share_code(docs.sparkSession)
    framed = docs.select("doc_id", raw().alias("raw"), frames(raw()).alias("f"))
    back = joined_frames(framed.select("doc_id", F.explode("f").alias("x")).select("doc_id", "x.*"), "doc_id")
    out = framed.select("doc_id", "raw", F.size("f").alias("frames")).join(back, "doc_id", "left")
    return out.select("doc_id", "frames", (F.coalesce("value", F.to_binary(F.lit(""), F.lit("utf-8"))) == F.col("raw")).alias("same"))


_N = "strlen(coalesce(text, ''))"
REG.add("codec_round_trip", codec_round_trip, f"SELECT doc_id, codec, {_N} AS n_bytes, TRUE AS same FROM documents, (VALUES ('zlib'), ('gzip'), ('deflate'), ('bz2'), ('zstd')) v(codec)", "documents")
REG.add("codec_ratios", codec_ratios, None, "documents")
REG.add("codec_smallest", speculative, "SELECT doc_id, TRUE AS same, TRUE AS no_larger FROM documents", "documents")
REG.add("codec_dictionary", dictionary_round_trip, "SELECT doc_id, TRUE AS same FROM documents", "documents")
REG.add("codec_frames", frame_round_trip, f"SELECT doc_id, CAST(ceil({_N} / 4096.0::DOUBLE) AS INT) AS frames, TRUE AS same FROM documents", "documents")


def frequent_substrings(texts: DataFrame, least: int = 4, most: int = 32, top: int = 1000) -> DataFrame:
    """AGG32: up to ``top`` byte strings of 4 to 32 bytes by count * length^2, of those met more often than there are texts, none of which holds or is held by a better one. A top-k report.

    Counts are of all texts. Candidates come back in order of score; each is
    compared with the few that are kept, on the driver.
    """
    share_code(texts.sparkSession)
    n = texts.count()

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        found: Counter = Counter()
        for pdf in batches:
            for v in pdf["b"]:
                for k in range(least, most + 1):
                    found.update(v[i : i + k] for i in range(len(v) - k + 1))
                if len(found) > 1 << 19:
                    yield pd.DataFrame({"s": list(found), "n": list(found.values())})
                    found.clear()
        yield pd.DataFrame({"s": list(found), "n": list(found.values())})

    counted = texts.select(raw().alias("b")).mapInPandas(grams, "s binary, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > n)
    scored = counted.withColumn("score", F.col("n") * F.octet_length("s") * F.octet_length("s")).orderBy(F.desc("score"), "s")
    kept: list[tuple[str, int, int]] = []
    inside: set[bytes] = set()  # all parts of what is kept, and what is kept
    whole: set[bytes] = set()
    for r in scored.toLocalIterator():
        s = bytes(r["s"])
        parts = {s[i:j] for i in range(len(s)) for j in range(i + least, len(s) + 1)}
        if s not in inside and not parts & whole:
            inside |= parts
            whole.add(s)
            kept.append((s.hex(), r["n"], r["score"]))
            if len(kept) == top:
                break
    return texts.sparkSession.createDataFrame(kept, "s string, n long, score long")


def dictionary_matches(texts: DataFrame, dictionary: bytes, least: int = 4, most: int = 64) -> DataFrame:
    """SIM12: (item_id, matches, covered, longest) of a greedy reading of each text against a dictionary: at each place the longest match, up to ``most`` bytes, among the dictionary's places with the same four bytes (the earlier of equals). The dictionary is bounded and travels with the function."""
    share_code(texts.sparkSession)
    places: dict[bytes, list[int]] = {}
    for i in range(len(dictionary) - least + 1):
        places.setdefault(dictionary[i : i + least], []).append(i)

    def read(v: bytes) -> tuple[int, int, int]:
        at, n, covered, longest = 0, 0, 0, 0
        while at + least <= len(v):
            best = 0
            for p in places.get(v[at : at + least], ()):
                k = least
                while k < most and at + k < len(v) and p + k < len(dictionary) and v[at + k] == dictionary[p + k]:
                    k += 1
                best = max(best, k)
            if best:
                n, covered, longest, at = n + 1, covered + best, max(longest, best), at + best
            else:
                at += 1
        return n, covered, longest

    @F.pandas_udf("matches long, covered long, longest long")
    def each(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(bytes(v)) for v in values], columns=["matches", "covered", "longest"])

    return texts.select("item_id", each(raw()).alias("m")).select("item_id", "m.*")


def matches_in_first(bench: DataFrame) -> DataFrame:
    """SIM12 with the text of the lowest id as the dictionary."""
    first = bench.orderBy("item_id").limit(1).select(raw().alias("b")).collect()
    return dictionary_matches(bench, bytes(first[0]["b"]) if first else b"")


REG.add("dictionary_matches", matches_in_first, None, "benchmark")
REG.add("dictionary_patterns", frequent_substrings, None, "benchmark")
QUERIES, ORACLE_SQL = REG.queries, REG.sql
