"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 48-bit hash of its id and text. Per source, the words of
one more copy are budgeted; histograms of words by leading hash digits find the
bucket in which the budget ends, and only that bucket is refined by the next
digits, until one hash value is left. Documents below the threshold hash take
one more copy. No sort of documents, no per-source collection; the only wide
exchange is of (source, bucket, sum) after map-side sums.

Nulls and edges: a null text has size 0; a null source is a source of its own,
last in order; repeated rows share a hash and so are taken alike; sources of
size 0 have target 0; an empty table gives an empty result. mixed_documents
passes other columns through whole, whatever their names; mix reads only doc_id,
source and text.

Sources may be many: they are numbered and summed up by range exchanges, never
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, number_rows, prefix_sums, words

DIGIT_BITS, LEVELS = 12, 4
#: Above so many sources the per-source table is joined by an exchange instead of a broadcast.
BROADCAST_SOURCES = 20_000


def doc_hash(doc_id: Column, text: Column) -> Column:
    """48 bits of md5, the same in other SQL engines."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")


def water_fill(totals: DataFrame, weights: list[int], cap: int) -> DataFrame:
    """Add ``target``: shares of the whole by weight, none above cap * source_size. Some actions.

    ``totals`` has a row per source. target = min(cap * size, level * weight)
    with one level for all; sources sorted by cap * size / weight reach their
    cap in that order. If a source and all before it are capped, the level is
    what is left, by the weights that are left; of all these the greatest is the
    one that holds, as each but the true one gives out more than there is.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    t = number_rows(totals, [F.col("source").asc_nulls_last()], "_nth")
    t = t.withColumn("_w", F.element_at(cycle, (F.col("_nth") % len(weights) + 1).cast("int")).cast("double"))
    t = t.withColumn("_cap", F.col("source_size") * float(cap)).withColumn("_r", F.col("_cap") / F.col("_w"))
    t = cut(prefix_sums(t, [F.col("_r"), F.col("_nth")], _capped="_cap", _spent="_w"))
    every, weight = t.agg(F.sum("source_size").cast("double"), F.sum("_w")).first()
    if weight is None:
        return t.select("source", "source_size", F.col("_cap").alias("target"))
    free = weight - F.col("_spent")
    level = t.agg(F.max(F.when(free > 0, (every - F.col("_capped")) / free))).first()[0]
    level = max(every / weight, level or 0.0)
    return t.select("source", "source_size", F.least(F.col("_cap"), level * F.col("_w")).alias("target"))


def _with_sources(rows: DataFrame, per_source: DataFrame, n_sources: int) -> DataFrame:
    """Join a table of one row per source, null source included."""
    side = per_source.withColumnRenamed("source", "_source")
    side = F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side
    return rows.join(side, rows["source"].eqNullSafe(side["_source"])).drop("_source")


def _sized(docs: DataFrame) -> DataFrame:
    """Add the size in words and the hash to rows with doc_id, source and text."""
    return docs.withColumn("size", F.size(words(F.col("text"))).cast("long")).withColumn("_h", doc_hash(F.col("doc_id"), F.col("text")))


def thresholds(narrow: DataFrame, weights=(5, 2, 1), cap: int = 3) -> tuple[DataFrame, int]:
    """Per source: source_size, target, copies of all its documents and the hash below which they get one more; and the number of sources.

    ``narrow`` (source, size, _h) is read once a level. Some actions, each on a row per source.
    """
    totals = cut(water_fill(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), cap))
    n_sources = totals.count()
    # Whole copies of every document, and the words left for one more copy of some.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = totals.withColumn("_whole", whole).withColumn("_budget", F.col("target") - F.col("_whole") * F.col("source_size")).withColumn("_prefix", F.lit(0).cast("long"))
    for level in range(LEVELS):
        shift = DIGIT_BITS * (LEVELS - 1 - level)
        here = _with_sources(narrow.where("size > 0"), state.select("source", "_prefix"), n_sources)
        bucket = F.shiftright("_h", shift)
        here = here.where(F.shiftright("_h", shift + DIGIT_BITS) == F.col("_prefix"))
        sums = here.groupBy("source", bucket.alias("_b")).agg(F.sum("size").alias("_n"))  # 4096 buckets a source at most
        w = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = _with_sources(sums.withColumn("_upto", F.sum("_n").over(w)), state.select("source", "_budget"), n_sources)
        # The boundary is the first bucket that the budget doesn't cover whole.
        edge = sums.where(F.col("_upto") > F.col("_budget")).groupBy("source").agg(F.min(F.struct("_b", (F.col("_upto") - F.col("_n")).alias("_before"), "_n")).alias("_e"))
        edge = edge.select(F.col("source").alias("_s"), F.col("_e._b").alias("_b"), F.col("_e._before").alias("_before"), F.col("_e._n").alias("_n"))
        joined = state.join(edge, state["source"].eqNullSafe(edge["_s"]), "left").drop("_s")
        done = F.col("_b").isNull()
        # Without a boundary every document of the prefix is below the threshold.
        state = joined.withColumn("_budget", F.when(done, F.col("_budget")).otherwise(F.col("_budget") - F.col("_before")))
        state = cut(state.withColumn("_prefix", F.when(done, F.shiftleft(F.col("_prefix") + 1, DIGIT_BITS)).otherwise(F.col("_b"))).withColumn("_last", F.col("_n")).drop("_b", "_before", "_n"))
    # One hash value is left at the threshold; it is taken if that comes nearer to the target.
    nearer = F.col("_last").isNotNull() & (2 * F.col("_budget") > F.col("_last"))
    return state.select("source", "source_size", "target", "_whole", (F.col("_prefix") + F.when(nearer, 1).otherwise(0)).alias("_threshold")), n_sources


def apply_thresholds(sized: DataFrame, state: DataFrame, n_sources: int) -> DataFrame:
    """Add source_size, target, copies and taken (= size * copies) to sized rows: a filter by hash, no exchange."""
    out = _with_sources(sized, state, n_sources)
    copies = F.col("_whole") + F.when((F.col("size") > 0) & (F.col("_h") < F.col("_threshold")), 1).otherwise(0)
    return out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("_whole", "_threshold", "_h")


def mix(docs: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """Per document: size, source_size, target, copies and taken."""
    narrow = cut(_sized(docs.select("doc_id", "source", "text")).drop("text"))
    return apply_thresholds(narrow, *thresholds(narrow, weights, cap))


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it."""
    size, h, whole, threshold, key, copies, nth = fresh(docs, "size", "h", "whole", "threshold", "key", "copies", "nth")
    sized = docs.withColumn(size, F.size(words(F.col("text"))).cast("long")).withColumn(h, doc_hash(F.col("doc_id"), F.col("text")))
    state, n = thresholds(cut(sized.select("source", F.col(size).alias("size"), F.col(h).alias("_h"))), weights, cap)
    side = state.select(F.col("source").alias(key), F.col("_whole").alias(whole), F.col("_threshold").alias(threshold))
    out = sized.join(F.broadcast(side) if n <= BROADCAST_SOURCES else side, F.col("source").eqNullSafe(F.col(key)))
    taken = F.col(whole) + F.when((F.col(size) > 0) & (F.col(h) < F.col(threshold)), 1).otherwise(0)
    out = out.withColumn(copies, taken.cast("int")).where(F.col(copies) > 0)
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def op6_mix_sources(spark, sf_dir) -> DataFrame:
    from ..session import table

    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


#: The same rule by sorting: prefix sums over hashes within each source.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS w, 3.0 * source_size::DOUBLE AS cap FROM s),
tot AS (SELECT sum(source_size)::DOUBLE AS total, sum(w) AS every FROM w),
cand AS (  -- the level if a source and all that are capped no later are capped
  SELECT (any_value(total) - sum(o.cap)) / (any_value(every) - sum(o.w)) AS level, any_value(every) - sum(o.w) AS free
  FROM w c, w o, tot WHERE o.cap / o.w <= c.cap / c.w GROUP BY c.source),
lev AS (SELECT greatest((SELECT total / every FROM tot), (SELECT max(level) FROM cand WHERE free > 0)) AS level),
t AS (SELECT source, source_size, least(cap, level * w) AS target FROM w, lev),
u AS (SELECT d.*, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
        sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
        sum(size) OVER (PARTITION BY d.source, h) AS same
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN size > 0 AND (upto <= target - whole * source_size
     OR (upto - same <= target - whole * source_size AND 2 * (target - whole * source_size - (upto - same)) > same)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM u
"""
