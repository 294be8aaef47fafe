"""Tensor containers as tables: shards with a JSON header, block containers, fragment stores, manifests and saved states.

Files come in as (path, content) rows, as ``spark.read.format("binaryFile")``
gives them for any store (2 GB a file at most); headers are parsed by column
functions. Stores are Parquet tables laid out by the key that is asked for, so
that a point read or a bounded read prunes partitions.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.catalogs import CURVES, LAYERS, quality_curve
from quern.plans.registry import Registry
from quern.session import scratch_path, share_code

REG = Registry()

# Shards with a JSON header


def discover(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: (path, length, modificationTime) of the shards at a file, in a directory or in a hub cache below it, by name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime").orderBy("path")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: (path, content) of the shards."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").option("recursiveFileLookup", "true").load(path).select("path", "content")


_ENTRY = "map<string,struct<dtype:string,shape:array<bigint>,data_offsets:array<bigint>>>"


def little_endian(value: Column, at: int, width: int) -> Column:
    """An unsigned number of ``width`` bytes from place ``at`` (from 0)."""
    return sum((F.conv(F.hex(F.substring(value, at + 1 + i, 1)), 16, 10).cast("long") * (1 << 8 * i) for i in range(min(width, 7))), F.lit(0).cast("long"))


def tensor_catalog(files: DataFrame) -> DataFrame:
    """SRC1, SRC4: (path, name, dtype, shape, offset, size) of all tensors; offsets are in the file. Files whose header is short or broken have no rows; the metadata entry is no tensor."""
    n = little_endian(F.col("content"), 0, 8)
    whole = F.octet_length("content") >= n + 8
    head = files.where(F.octet_length("content") >= 8).withColumn("n", n).where(whole)
    entries = F.from_json(F.decode(F.expr("substring(content, 9, int(n))"), "UTF-8"), _ENTRY)
    e = head.select("path", "n", F.explode(entries).alias("name", "e")).where("name <> '__metadata__' AND e.data_offsets IS NOT NULL")
    start, end = F.col("e.data_offsets")[0], F.col("e.data_offsets")[1]
    return e.select("path", "name", F.coalesce("e.dtype", F.lit("F32")).alias("dtype"), F.coalesce("e.shape", F.array().cast("array<bigint>")).alias("shape"), (start + F.col("n") + 8).alias("offset"), (end - start).alias("size"))


def tensor_bytes(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """SRC3: the catalogue with ``data``, the tensor's bytes."""
    return catalog.join(files, "path").withColumn("data", F.expr("substring(content, int(offset) + 1, int(size))")).drop("content")


def widened(data: Column, dtype: Column) -> Column:
    """SRC3: F32, F16 and BF16 bytes as floats; null for other dtypes."""

    @F.pandas_udf("array<float>")
    def each(values: pd.Series, types: pd.Series) -> pd.Series:
        def one(b, t):
            if b is None or t not in ("F32", "F16", "BF16"):
                return None
            if t == "BF16":
                return (np.frombuffer(b, dtype="<u2").astype(np.uint32) << 16).view(np.float32)
            return np.frombuffer(b, dtype="<f4" if t == "F32" else "<f2").astype(np.float32)

        return pd.Series([one(b, t) for b, t in zip(values, types, strict=True)], dtype=object)

    return each(data, dtype)


def pack_shard(tensors: list[tuple[str, str, list[int], bytes]], metadata: dict | None = None) -> bytes:
    """A shard of (name, dtype, shape, bytes)."""
    head, at = {"__metadata__": metadata} if metadata else {}, 0
    for name, dtype, shape, data in tensors:
        head[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(data)]}
        at += len(data)
    text = json.dumps(head, separators=(",", ":")).encode()
    return struct.pack("<Q", len(text)) + text + b"".join(d for *_, d in tensors)


def as_shards(vectors: DataFrame) -> DataFrame:
    """(path, content): a shard per vector with the vector as F32, its first half as BF16 and its second as F16."""
    share_code(vectors.sparkSession)

    @F.pandas_udf("binary")
    def shard(vs: pd.Series) -> pd.Series:
        out = []
        for v in vs:
            x = np.asarray([] if v is None else v, dtype=np.float32)
            h = len(x) // 2
            out.append(pack_shard([("whole", "F32", [h, 2] if len(x) % 2 == 0 else [len(x)], x.astype("<f4").tobytes()), ("first", "BF16", [h], (x[:h].view(np.uint32) >> 16).astype("<u2").tobytes()), ("second", "F16", [len(x) - h], x[h:].astype("<f2").tobytes())], {"format": "pt"}))
        return pd.Series(out, dtype=object)

    return vectors.select(F.col("vec_id").cast("string").alias("path"), shard("embedding").alias("content"))


def shard_catalog(vectors: DataFrame) -> DataFrame:
    c = tensor_catalog(as_shards(vectors))
    first = F.min("offset").over(Window.partitionBy("path"))
    return c.select(F.col("path").cast("long").alias("vec_id"), "name", "dtype", F.concat_ws("x", F.transform("shape", lambda x: x.cast("string"))).alias("shape"), (F.col("offset") - first).alias("offset"), "size")


def shard_values(vectors: DataFrame) -> DataFrame:
    """SRC3: (vec_id, name, n, near): tensors read back, and whether their sum is near that of the vector's part."""
    files = as_shards(vectors)
    t = tensor_bytes(files, tensor_catalog(files)).withColumn("x", widened(F.col("data"), F.col("dtype")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))
    j = t.join(vectors.select(F.col("vec_id").cast("string").alias("path"), "vec_id", "embedding"), "path")
    n = F.size("embedding")
    half = F.floor(n / 2).cast("int")
    part = F.when(F.col("name") == "whole", F.col("embedding")).when(F.col("name") == "first", F.slice("embedding", F.lit(1), half)).otherwise(F.slice("embedding", half + 1, n - half))
    return j.select("vec_id", "name", F.size("x").alias("n"), (F.abs(total(F.col("x")) - total(part)) < 0.05).alias("near"))


_TENSORS = "(VALUES ('whole', 'F32', 0, 4, 1), ('first', 'BF16', 4, 2, 2), ('second', 'F16', 5, 2, 2)) t(name, dtype, a, w, p)"
REG.add("shard_catalog", shard_catalog, f"SELECT vec_id, name, dtype, CASE name WHEN 'whole' THEN '32x2' ELSE '32' END AS shape, CAST(len(embedding) * a AS BIGINT) AS offset, CAST(len(embedding) * w // p AS BIGINT) AS size FROM embeddings, {_TENSORS}", "embeddings")
REG.add("shard_values", shard_values, f"SELECT vec_id, name, CAST(len(embedding) // p AS INT) AS n, TRUE AS near FROM embeddings, {_TENSORS}", "embeddings")

# Block containers. Fixed values of the format: magic, versions, flags, codes, sizes.
MAGIC, HEADER = b"HCTN", 64
HEADER_SUM, BLOCK_SUMS = 0x0001, 0x0002
BLOCK_SIZE = 16 * 1024
ALGORITHMS = {"lz4": 0, "zstd": 1}
DTYPES = ("F32", "F16", "BF16", "I8", "I4")


def pack_blocks(value: bytes, dtype: str = "I8", shape: tuple[int, ...] = (), version: int = 2, block: int = BLOCK_SIZE) -> bytes:
    """SRC7-8: a container of zstd blocks: header of 64 bytes, index, blocks; version 2 has checksums of the header's first 56 bytes and of every block."""
    import xxhash
    import zstandard

    tool = zstandard.ZstdCompressor(level=3)
    blocks = [tool.compress(value[i : i + block]) for i in range(0, len(value), block)]
    head = struct.pack("<4sIBBHQQIIB", MAGIC, version, ALGORITHMS["zstd"], DTYPES.index(dtype), HEADER_SUM | BLOCK_SUMS if version == 2 else 0, len(value), sum(map(len, blocks)), block, len(blocks), min(len(shape), 4)) + b"".join(struct.pack("<Q", d) for d in shape[:4])
    head = bytearray(head.ljust(HEADER, b"\0"))
    if version == 2:
        head[56:64] = struct.pack("<Q", xxhash.xxh3_64_intdigest(bytes(head[:56])))
    index, at = [], 0
    for b in blocks:
        index.append(struct.pack("<II", at, len(b)) + (struct.pack("<Q", xxhash.xxh3_64_intdigest(b)) if version == 2 else b""))
        at += len(b)
    return bytes(head) + b"".join(index) + b"".join(blocks)


def read_blocks(data: bytes, which: list[int] | None = None) -> list[dict]:
    """SRC5-6: all blocks, or those asked for: (block, offset, size, intact, payload); version 1 has no checksums, so its blocks count as intact."""
    import xxhash
    import zstandard

    if len(data) < HEADER or data[:4] != MAGIC:
        raise ValueError("no block container")
    (version,) = struct.unpack_from("<I", data, 4)
    (n,) = struct.unpack_from("<I", data, 32)
    width = 16 if version == 2 else 8
    start, out = HEADER + n * width, []
    for i in range(n) if which is None else which:
        at, size = struct.unpack_from("<II", data, HEADER + i * width)
        raw = data[start + at : start + at + size]
        intact = version != 2 or xxhash.xxh3_64_intdigest(raw) == struct.unpack_from("<Q", data, HEADER + i * width + 8)[0]
        out.append({"block": i, "offset": at, "size": size, "intact": intact, "payload": zstandard.ZstdDecompressor().decompress(raw) if intact else None})
    return out


def container_header(content: Column) -> Column:
    """SRC5-6: (version, dtype, original, blocks) of containers, by column functions."""
    dtype = F.element_at(F.array(*map(F.lit, DTYPES)), (little_endian(content, 9, 1) + 1).cast("int"))
    return F.when(F.substring(content, 1, 4) == F.lit(MAGIC), F.struct(little_endian(content, 4, 4).alias("version"), dtype.alias("dtype"), little_endian(content, 12, 8).alias("original"), little_endian(content, 32, 4).alias("blocks")))


def blocks(files: DataFrame) -> DataFrame:
    """SRC5-6: (path, block, offset, size, intact, payload) of containers (path, content)."""

    @F.pandas_udf("array<struct<block:int,offset:long,size:long,intact:boolean,payload:binary>>")
    def each(values: pd.Series) -> pd.Series:
        return pd.Series([read_blocks(bytes(v)) for v in values])

    return files.select("path", F.explode(each("content")).alias("b")).select("path", "b.*")


def contained(docs: DataFrame, version: int = 2) -> DataFrame:
    """SRC7-8: (path, content): each text in a container."""
    share_code(docs.sparkSession)

    @F.pandas_udf("binary")
    def each(values: pd.Series) -> pd.Series:
        return pd.Series([pack_blocks(bytes(v), shape=(len(v),), version=version) for v in values], dtype=object)

    return docs.select(F.col("doc_id").cast("string").alias("path"), each(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))


def container_blocks(docs: DataFrame) -> DataFrame:
    """SRC5-8: (doc_id, version, block, raw, intact) through containers of both versions."""
    both = [blocks(contained(docs, v)).select(F.col("path").cast("long").alias("doc_id"), F.lit(v).alias("version"), "block", F.octet_length("payload").alias("raw"), "intact") for v in (1, 2)]
    return both[0].union(both[1])


def container_headers(docs: DataFrame) -> DataFrame:
    h = contained(docs).select(F.col("path").cast("long").alias("doc_id"), container_header(F.col("content")).alias("h"))
    return h.select("doc_id", "h.*")


_LEN = "strlen(coalesce(text, ''))"
REG.add("container_blocks", container_blocks, f"SELECT doc_id, version, CAST(b AS INT) AS block, CAST(least(n - b * {BLOCK_SIZE}, {BLOCK_SIZE}) AS INT) AS raw, TRUE AS intact FROM (SELECT doc_id, n, unnest(range((n + {BLOCK_SIZE - 1}) // {BLOCK_SIZE})) AS b FROM (SELECT doc_id, {_LEN} AS n FROM documents)), (VALUES (1), (2)) v(version)", "documents")
REG.add("container_headers", container_headers, f"SELECT doc_id, CAST(2 AS BIGINT) AS version, 'I8' AS dtype, CAST({_LEN} AS BIGINT) AS original, CAST(({_LEN} + {BLOCK_SIZE - 1}) // {BLOCK_SIZE} AS BIGINT) AS blocks FROM documents", "documents")

# Stores


def write_fragments(fragments: DataFrame, path: str) -> None:
    """SRC9: a fragment table (tensor_id, frag_idx, payload), one directory a fragment index, with checksums."""
    fragments.withColumn("checksum", F.crc32(F.col("payload"))).write.mode("overwrite").partitionBy("frag_idx").parquet(path)


def read_fragments(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """SRC9: fragments whose checksum holds; with ``upto`` only those of lower index, by pruned directories."""
    f = spark.read.schema("tensor_id long, payload binary, checksum long, frag_idx int").parquet(path)
    f = f if upto is None else f.where(F.col("frag_idx") < upto)
    return f.where(F.crc32(F.col("payload")) == F.col("checksum"))


def read_to_quality(spark: SparkSession, path: str, target: float, total: int, curve: str = "spectral") -> DataFrame:
    """SRC10: the fewest leading fragments whose quality by the curve reaches the target; a number, so other directories are not listed."""
    need = spark.range(1, total + 1).where(quality_curve(F.col("id"), F.lit(total), CURVES[curve], 1) >= target).agg(F.min("id")).first()[0]
    return read_fragments(spark, path, int(need or total))


def fragment_store(vectors: DataFrame, parts: int = 8, target: float = 0.75) -> DataFrame:
    """SRC9-11, T10: vectors as fragments, written, read up to a quality and put together: (vec_id, fragments, values). Writes a table."""
    from quern.operators.tensors import dct_2d, per_vector

    spark = vectors.sparkSession
    share_code(spark)
    path = f"{scratch_path(spark)}/fragments"
    split = per_vector(lambda v: ([{"frag_idx": f, "payload": dct_2d(v, 8)[f::parts].astype("<f8").tobytes()} for f in range(parts)],), "x array<struct<frag_idx:int,payload:binary>>", ("x",))
    write_fragments(vectors.select(F.col("vec_id").alias("tensor_id"), F.explode(split["x"]).alias("f")).select("tensor_id", "f.*"), path)
    g = read_to_quality(spark, path, target, parts).groupBy(F.col("tensor_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("fragments"), F.sum(F.octet_length("payload") / 8).cast("long").alias("values"))
    return g


REG.add("fragment_store", fragment_store, "WITH k AS (SELECT min(k) AS k FROM range(1, 9) r(k) WHERE CASE WHEN k = 8 THEN 1 ELSE 0.6 + 0.3 * (k / 8.0) + 0.08 * (k / 8.0) ** 2 + 0.02 * (k / 8.0) ** 3 END >= 0.75) SELECT vec_id, k AS fragments, CAST(k * 8 AS BIGINT) AS values FROM embeddings, k", "embeddings")


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """SRC12: append rows whose key the table at ``path`` doesn't have yet, so that a run can be resumed; how many there were. A table without rows starts anew."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
        rows = rows.join(done, key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    n = rows.count()
    if n or done is None:
        rows.write.mode("append").parquet(path)
    return n


def resumed_writer(part: DataFrame) -> DataFrame:
    """SRC12: (written_first, written_then, rows) of a writer that is stopped halfway and run again over everything. Writes a table."""
    path = f"{scratch_path(part.sparkSession)}/incremental"
    rows = part.select("p_partkey", "p_name")
    first = append_new(rows.where("p_partkey % 2 = 0"), path, "p_partkey")
    then = append_new(rows, path, "p_partkey")
    return part.sparkSession.read.parquet(path).agg(F.lit(first).cast("long").alias("written_first"), F.lit(then).cast("long").alias("written_then"), F.count_distinct("p_partkey").alias("rows"))


REG.add("incremental_writer", resumed_writer, "SELECT count(*) FILTER (p_partkey % 2 = 0) AS written_first, count(*) FILTER (p_partkey % 2 <> 0) AS written_then, count(*) AS rows FROM part", "part")


def stored(rows: DataFrame, name: str, *by: str) -> DataFrame:
    """SRC13-16, SRC18: rows written as a table below the scratch folder, laid out by the given columns, and read again."""
    path = f"{scratch_path(rows.sparkSession)}/{name}"
    rows.write.partitionBy(*by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def content_store(docs: DataFrame) -> DataFrame:
    """SRC14: texts under the hash of their content, laid out by its first two digits: (shard, entries, bytes)."""
    b = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(F.substring(F.sha2(b, 256), 1, 32).alias("id"), b.alias("data")).groupBy("id").agg(F.first("data").alias("data"))
    s = stored(rows.withColumn("shard", F.substring("id", 1, 2)), "contents", "shard")
    return s.groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("data")).alias("bytes"))


REG.add("content_store", lambda d: content_store(d).where("entries > 0").agg(F.count(F.lit(1)).alias("shards"), F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes")), f"SELECT count(DISTINCT substr(sha256(coalesce(text, '')), 1, 2)) AS shards, count(*) AS entries, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM (SELECT DISTINCT text FROM (SELECT coalesce(text, '') AS text FROM documents))", "documents")


def manifests(part: DataFrame) -> DataFrame:
    """SRC15: models with their layers and references as nested rows, written and read: (model, layers, refs)."""
    from quern.operators.catalogs import layers

    t = layers(part).groupBy("model", "layer").agg(F.array_sort(F.collect_list(F.struct("id", "quality"))).alias("refs"))
    m = t.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("layer", "refs"))).alias("layers"))
    back = stored(m, "manifests")
    return back.select("model", F.size("layers").alias("layers"), F.aggregate("layers", F.lit(0), lambda a, x: a + F.size(x["refs"])).alias("refs"))


REG.add("model_manifests", manifests, f"WITH {LAYERS} SELECT model, CAST(count(DISTINCT layer) AS INT) AS layers, CAST(count(*) AS INT) AS refs FROM layers GROUP BY 1", "part")


def codebook_container(vectors: DataFrame) -> DataFrame:
    """SRC13: a codebook table and an encoded table, written and read, joined again: (code, used, dims, ratio of bytes)."""
    from quern.operators.tensors import assigned, label_centroids

    spark = vectors.sparkSession
    codes, centres = label_centroids(vectors)
    book = stored(spark.createDataFrame([("embedding", int(c), x.tolist()) for c, x in zip(codes, centres, strict=True)], "layer_type string, code int, centroid array<double>"), "codebooks", "layer_type")
    enc = stored(assigned(vectors, codes, centres).select("vec_id", "code"), "encoded")
    return book.join(enc.groupBy("code").agg(F.count(F.lit(1)).alias("used")), "code").select("code", "used", F.size("centroid").alias("dims"))


_AS = "WITH l AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label AS code, pos, avg(v) AS c FROM l GROUP BY 1, 2), x AS (SELECT vec_id, code, sum((v - c) * (v - c)) AS d FROM l JOIN c USING (pos) GROUP BY 1, 2), a AS (SELECT vec_id, code FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, code) = 1)"
REG.add("codebook_container", codebook_container, _AS + " SELECT code, count(*) AS used, 64 AS dims FROM a GROUP BY 1", "embeddings")


def latent_store(events: DataFrame) -> DataFrame:
    """SRC16, SIM11: latents by (entry, step), written and read by key: (entry, steps, last)."""
    rows = events.groupBy(F.col("user_id").alias("entry"), (F.col("event_id") % 20).cast("int").alias("step")).agg(F.max("value").alias("latent"))
    return stored(rows, "latents", "step").groupBy("entry").agg(F.count(F.lit(1)).alias("steps"), F.max("step").cast("int").alias("last"))


REG.add("latent_store", latent_store, "SELECT user_id AS entry, count(DISTINCT event_id % 20) AS steps, CAST(max(event_id % 20) AS INT) AS last FROM events GROUP BY 1", "events")


def usage_history(events: DataFrame) -> DataFrame:
    """SRC18: usage counts, saved and loaded: (user_id, uses, seen_day)."""
    return stored(events.groupBy("user_id").agg(F.count(F.lit(1)).alias("uses"), F.date_trunc("day", F.max("ts")).alias("seen_day")), "usage")


REG.add("usage_history", lambda e: usage_history(e).select("user_id", "uses", F.dayofmonth("seen_day").alias("day")), "SELECT user_id, count(*) AS uses, CAST(day(max(ts)) AS INT) AS day FROM events GROUP BY 1", "events")


def state_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """SRC19: (key, change) between two state tables (key, value): added, removed or changed."""
    b, a = before.withColumnRenamed("value", "b"), after.withColumnRenamed("value", "a")
    j = b.join(a, "key", "full")
    return j.where(~F.col("a").eqNullSafe(F.col("b"))).select("key", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed").alias("change"))


def state_round_trip(part: DataFrame) -> DataFrame:
    """SRC19: states as JSON text and back, then compared with a later snapshot."""
    state = part.select("p_partkey", F.to_json(F.struct("p_name", "p_size")).alias("text"))
    back = state.select("p_partkey", F.from_json("text", "p_name string, p_size int").alias("s"))
    before = back.where("p_partkey % 5 > 0").select(F.col("p_partkey").alias("key"), F.col("s.p_size").alias("value"))
    after = back.where("p_partkey % 7 > 0").select(F.col("p_partkey").alias("key"), (F.col("s.p_size") + (F.col("p_partkey") % 3 == 0).cast("int")).alias("value"))
    return state_changes(before, after)


REG.add("state_snapshots", state_round_trip, "SELECT p_partkey AS key, CASE WHEN p_partkey % 5 = 0 THEN 'added' WHEN p_partkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM part WHERE (p_partkey % 5 > 0 OR p_partkey % 7 > 0) AND (p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 3 = 0)", "part")


def buffer_snapshots(pages: DataFrame, as_of: int, ttl: int) -> DataFrame:
    """SRC20: buffers with a checksum and a time, written and read: (page_id, intact) of those not older than ``ttl``; every 13th is damaged on the way."""
    b = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", b.alias("data"), F.sha2(b, 256).alias("sum"), (F.col("page_id") * 10).alias("created"))
    s = stored(rows.withColumn("data", F.when(F.col("page_id") % 13 == 0, F.concat("data", F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("data"))), "snapshots")
    return s.where(as_of - F.col("created") <= ttl).select("page_id", (F.sha2("data", 256) == F.col("sum")).alias("intact"))


REG.add("buffer_snapshots", lambda p: buffer_snapshots(p, 1000, 900), "SELECT page_id, page_id % 13 <> 0 AS intact FROM pages WHERE 1000 - page_id * 10 <= 900", "pages")


def transformed(rows: DataFrame, f, schema: str) -> DataFrame:
    """A transform of record batches as they are read or written: ``f`` takes and gives a pandas frame."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield f(b)

    return rows.mapInPandas(each, schema)


QUERIES, ORACLE_SQL = REG.queries, REG.sql
