"""Aggregates, ordered folds, as-of lookups, eviction and sampling over record tables.

Times are compared with a parameter, never with the clock. Every ranking has a
tie-breaker, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import table

AS_OF = "2025-01-01 00:00:00"


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """Add the sum of ``value`` up to each row in a total order, without a one-partition sort.

    One range exchange; the sums of the ranges (a row a partition, so bounded by
    the number of shuffle partitions) are added up and sent back to the rows.
    ``df`` must be deterministic.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    sums = placed.groupBy("_p").agg(F.sum(value).alias("_s"), F.min(F.struct(*order)).alias("_k"))
    before = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    upto = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.sum(value).over(upto) + F.col("_before")).drop("_p", "_before")


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) == 0, 0.0).otherwise(a / b)


def size_stats(lines: DataFrame) -> DataFrame:
    """Operations, sizes before and after, ratio and savings by flag; price and discounted price stand for the sizes."""
    before, after = F.sum("l_extendedprice"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("operations"), F.round(before, 2).alias("size_before"), F.round(after, 2).alias("size_after"), F.round(ratio(before, after), 6).alias("ratio"), F.round((1 - ratio(after, before)) * 100, 6).alias("savings_percent"))


def usage_stats(events: DataFrame) -> DataFrame:
    """Per user: uses, mean value, uses of high (> 80) and low (< 20) value."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("uses"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(F.col("value") > 80).alias("high"), F.count_if(F.col("value") < 20).alias("low"))


def floor_percentiles(lines: DataFrame) -> DataFrame:
    """AGG10, AGG15: per flag: mean, population deviation, bounds and the values at floor(n * p) of the sorted list.

    Values are counted first, so a flag brings one row per distinct value to the ranking.
    """
    g = lines.groupBy("l_returnflag", F.col("l_quantity").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("l_returnflag")
    g = g.withColumn("upto", F.sum("c").over(w.orderBy("v"))).withColumn("n", F.sum("c").over(w))
    at = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * p / 100), F.col("v"))).alias(f"p{p}") for p in (25, 50, 75, 90, 95)]
    mean = F.sum(F.col("v") * F.col("c")) / F.sum("c")
    var = F.sum(F.col("v") * F.col("v") * F.col("c")) / F.sum("c") - mean * mean
    return g.groupBy("l_returnflag").agg(F.sum("c").alias("n"), F.round(mean, 6).alias("mean"), F.round(F.sqrt(var), 6).alias("std"), F.min("v").alias("least"), F.max("v").alias("most"), *at)


def hotspots(lines: DataFrame) -> DataFrame:
    """Spans by total, with their share and what makes them a bottleneck; a row per (flag, status)."""
    g = lines.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("calls"), F.sum("l_quantity").alias("total"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.avg("l_quantity").alias("mean"), F.stddev_pop("l_quantity").alias("std"))
    share = F.col("total") / F.sum("total").over(Window.partitionBy()) * 100
    g = g.withColumn("percent", F.round(share, 6))
    kind = F.when(F.col("percent") > 50, "dominant").when(F.col("std") > F.col("mean"), "variance").when(F.col("most") > 10 * F.col("mean"), "long tail").otherwise("none")
    return g.select("l_returnflag", "l_linestatus", "calls", F.round("total", 2).alias("total"), "least", "most", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "percent", kind.alias("bottleneck"))


def quality_grades(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents by a grade of their length, with counts and the share labelled good."""
    grade = F.when(F.col("n_chars") >= 8000, "A").when(F.col("n_chars") >= 2000, "B").when(F.col("n_chars") >= 500, "C").otherwise("F")
    return docs.join(labels, "doc_id").groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("good"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


def hit_rates(events: DataFrame) -> DataFrame:
    """Per type of event: requests, hits (value over 50) and their rate."""
    hits = F.count_if(F.col("value") > 50)
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("requests"), hits.alias("hits"), F.round(ratio(hits, F.count(F.lit(1))), 6).alias("hit_rate"))


def load_balance(events: DataFrame) -> DataFrame:
    """Per type of event: users, mean and greatest load of a user, balance = mean / greatest, capacity factor in 1 to 2."""
    g = events.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("event_type").agg(F.count(F.lit(1)).alias("users"), F.avg("n").alias("mean"), F.max("n").alias("most"))
    return g.select("event_type", "users", F.round("mean", 6).alias("mean"), "most", F.round(F.col("mean") / F.col("most"), 6).alias("balance"), F.round(F.greatest(F.lit(1.0), F.least(F.lit(2.0), F.col("most") / F.col("mean"))), 6).alias("capacity"))


def prefix_frequency(turns: DataFrame, least: int = 2) -> DataFrame:
    """Two-word beginnings of user turns that occur at least so often, with the mean length."""
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    p = turns.where("role = 'user'").select(w.alias("w"), F.char_length(F.coalesce("text", F.lit(""))).alias("n")).where(F.size("w") >= 2)
    return p.groupBy(F.concat_ws(" ", F.slice("w", 1, 2)).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n"), 6).alias("mean_chars")).where(F.col("n") >= least)


def substring_scores(bench: DataFrame, lengths: tuple[int, ...] = (4, 8, 16), top: int = 100) -> DataFrame:
    """The ``top`` substrings by count * length^2, of those met more often than there are texts. A top-k report."""
    t = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for k in lengths:
        at = F.when(F.char_length(t) >= k, F.sequence(F.lit(1), F.char_length(t) - (k - 1))).otherwise(F.array().cast("array<int>"))
        parts.append(bench.select(t.alias("t"), F.explode(at).alias("i")).select(F.expr(f"substring(t, i, {k})").alias("s"), F.lit(k).alias("k")))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    c = every.groupBy("s", "k").agg(F.count(F.lit(1)).alias("n"))
    n = bench.agg(F.count(F.lit(1)).alias("texts"))
    kept = c.join(F.broadcast(n), F.col("n") > F.col("texts"))
    return kept.select("s", "n", (F.col("n") * F.col("k") * F.col("k")).alias("score")).orderBy(F.desc("score"), F.hex(F.encode("s", "UTF-8"))).limit(top)


def ewma(events: DataFrame, alpha: float = 0.1, start: float = 1.0) -> DataFrame:
    """Per user: the exponentially weighted mean of values in order of time. In closed form, so a user's events need not be gathered in one row."""
    e = events.where(F.col("value").isNotNull()).select("user_id", "value", "ts", "event_id", F.to_date("ts").alias("day"))
    # Ranks within a day, and how many rows later days hold: no task sees all rows of a user.
    days = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    later = F.coalesce(F.sum("n").over(Window.partitionBy("user_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(F.col("user_id").alias("u"), F.col("day").alias("d"), later.alias("later"))
    within = F.row_number().over(Window.partitionBy("user_id", "day").orderBy(F.desc("ts"), F.desc("event_id"))) - 1
    e = e.withColumn("within", within).join(days, F.col("user_id").eqNullSafe(F.col("u")) & F.col("day").eqNullSafe(F.col("d")))
    e = e.withColumn("age", F.col("within") + F.col("later"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("age")) * F.col("value")) + F.lit(start) * F.pow(F.lit(1 - alpha), F.count(F.lit(1))), 5).alias("ewma"))


def rolling(events: DataFrame, rows: int = 20) -> DataFrame:
    """Per event: sum and rank-weighted mean of the user's last ``rows`` values."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frame = w.rowsBetween(1 - rows, Window.currentRow)
    e = events.withColumn("i", F.row_number().over(w).cast("double")).withColumn("first", F.min("i").over(frame))
    weighted = F.sum(F.col("value") * F.col("i")).over(frame) - (F.col("first") - 1) * F.sum("value").over(frame)
    n = F.col("i") - F.col("first") + 1
    return e.select("event_id", F.round(F.sum("value").over(frame), 4).alias("total"), F.round(weighted / (n * (n + 1) / 2), 4).alias("weighted"))


def asof_events(orders: DataFrame, events: DataFrame) -> DataFrame:
    """(o_orderkey, event_id): the customer's latest event at or before the order, null if there is none."""
    o = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("t"), F.lit(1).alias("kind"), "o_orderkey", F.lit(None).cast("long").alias("event_id"))
    e = events.select(F.col("user_id").alias("k"), F.col("ts").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("o_orderkey"), "event_id")
    rows = o.union(e).withColumn("day", F.to_date("t"))
    # A key's rows are dealt by day, so one that holds many rows is split; what a day leaves to the next ones is a row.
    ends = rows.where("kind = 0").groupBy("k", "day").agg(F.max(F.struct("t", "event_id")).alias("end"))
    days = rows.select("k", "day").distinct().join(ends, ["k", "day"], "left")
    earlier = F.last("end.event_id", ignorenulls=True).over(Window.partitionBy("k").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("k", "day", earlier.alias("before"))
    w = Window.partitionBy("k", "day").orderBy("t", "kind", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    today = rows.withColumn("last", F.last("event_id", ignorenulls=True).over(w)).where("kind = 1")
    same = today["k"].eqNullSafe(days["k"]) & today["day"].eqNullSafe(days["day"])
    return today.join(days, same, "left").select("o_orderkey", F.coalesce("last", "before").alias("event_id"))


def evictions(events: DataFrame, keep: float = 0.6, as_of: str = AS_OF) -> DataFrame:
    """Users (as cache entries) to evict, by recency * max(ln(uses), 1) ascending, until ``keep`` of all value is left."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.max("ts"))
    g = events.groupBy("user_id").agg(F.round(1 / (age / 3600.0 + 1) * F.greatest(F.log(F.count(F.lit(1)).cast("double")), F.lit(1.0)), 12).alias("score"), F.sum(F.round(F.coalesce("value", F.lit(0.0)) * 100).cast("long")).alias("size"))
    freed = running_total(g, [F.col("score"), F.col("user_id")], "size", "freed")
    whole = g.agg(F.sum("size").alias("whole"))
    return freed.join(F.broadcast(whole), F.col("freed") - F.col("size") < F.col("whole") * (1 - keep)).select("user_id", "size", "freed")


def schedule(orders: DataFrame, top: int = 100) -> DataFrame:
    """The ``top`` orders by effective priority: base less half the importance, least first."""
    base = F.substring("o_orderpriority", 1, 1).cast("double")
    importance = F.least(F.col("o_totalprice") / 500000.0, F.lit(1.0))
    return orders.select("o_orderkey", F.round(base + 0.5 * (1 - importance), 6).alias("effective")).orderBy("effective", "o_orderkey").limit(top)


def tumbling(events: DataFrame) -> DataFrame:
    """Events and value by hour and type (provided by Spark)."""
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user by gaps of 30 minutes (provided by Spark)."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def reservoir(docs: DataFrame, k: int = 100, seed: int = 3) -> DataFrame:
    """A reproducible sample of k documents: those of least md5(seed:id). A sampling operator."""
    return docs.select("doc_id", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))).alias("h")).orderBy("h", "doc_id").limit(k).select("doc_id")


def format_sniff(pages: DataFrame) -> DataFrame:
    """Pages by the format that their leading bytes tell."""
    h = F.substring(F.hex(F.encode(F.coalesce("html", F.lit("")), "UTF-8")), 1, 8)
    kind = F.when(h.startswith("1F8B"), "gzip").when(h == "28B52FFD", "zstd").when(h == "04224D18", "lz4").when(F.substring(h, 1, 4).isin("7801", "789C", "78DA"), "zlib").when(h.startswith("3C"), "markup").otherwise("raw")
    return pages.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def hash_sample(parts: DataFrame, rate: float = 0.25) -> DataFrame:
    """Parts whose name's hash falls below the rate: a reproducible sampling filter."""
    u = F.conv(F.substring(F.md5("p_name"), 1, 8), 16, 10).cast("double")
    return parts.where(u < rate * (1 << 32)).select("p_partkey", "p_name")


def _over(f, *names):
    return lambda s, d: f(*(table(s, d, n) for n in names))


QUERIES = {
    "size_stats": _over(size_stats, "lineitem"),
    "usage_stats": _over(usage_stats, "events"),
    "floor_percentiles": _over(floor_percentiles, "lineitem"),
    "profiler_hotspots": _over(hotspots, "lineitem"),
    "quality_grades": _over(quality_grades, "documents", "labels"),
    "hit_rates": _over(hit_rates, "events"),
    "load_balance": _over(load_balance, "events"),
    "prefix_frequency": _over(prefix_frequency, "conversations"),
    "ngram_dictionary": _over(substring_scores, "benchmark"),
    "importance_ewma": _over(ewma, "events"),
    "rolling_throughput": _over(rolling, "events"),
    "checkpoint_asof": _over(asof_events, "orders", "events"),
    "cache_evict": _over(evictions, "events"),
    "priority_schedule": _over(schedule, "orders"),
    "tumbling_events": _over(tumbling, "events"),
    "session_events": _over(sessions, "events"),
    "reservoir": _over(reservoir, "documents"),
    "format_sniff": _over(format_sniff, "pages"),
    "hash_sample": _over(hash_sample, "part"),
}

ORACLE_SQL = {
    "size_stats": "SELECT l_returnflag, count(*) AS operations, round(sum(l_extendedprice), 2) AS size_before, round(sum(l_extendedprice * (1 - l_discount)), 2) AS size_after, round(sum(l_extendedprice) / sum(l_extendedprice * (1 - l_discount)), 6) AS ratio, round((1 - sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice)) * 100, 6) AS savings_percent FROM lineitem GROUP BY 1",
    "usage_stats": "SELECT user_id, count(*) AS uses, round(avg(value), 6) AS mean_value, count(*) FILTER (value > 80) AS high, count(*) FILTER (value < 20) AS low FROM events GROUP BY 1",
    "floor_percentiles": "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, min(l_quantity) AS least, max(l_quantity) AS most, " + ", ".join(f"list_sort(list(l_quantity))[CAST(floor(count(*) * {p} / 100) AS BIGINT) + 1] AS p{p}" for p in (25, 50, 75, 90, 95)) + " FROM lineitem GROUP BY 1",
    "profiler_hotspots": "WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS calls, sum(l_quantity) AS total, min(l_quantity) AS least, max(l_quantity) AS most, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std FROM lineitem GROUP BY 1, 2), p AS (SELECT *, round(total / sum(total) OVER () * 100, 6) AS percent FROM g) SELECT l_returnflag, l_linestatus, calls, round(total, 2) AS total, least, most, round(mean, 6) AS mean, round(std, 6) AS std, percent, CASE WHEN percent > 50 THEN 'dominant' WHEN std > mean THEN 'variance' WHEN most > 10 * mean THEN 'long tail' ELSE 'none' END AS bottleneck FROM p",
    "quality_grades": "SELECT CASE WHEN n_chars >= 8000 THEN 'A' WHEN n_chars >= 2000 THEN 'B' WHEN n_chars >= 500 THEN 'C' ELSE 'F' END AS grade, count(*) AS n, round(avg(quality), 6) AS good, min(n_chars) AS least, max(n_chars) AS most FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "hit_rates": "SELECT event_type, count(*) AS requests, count(*) FILTER (value > 50) AS hits, round(count(*) FILTER (value > 50) / count(*), 6) AS hit_rate FROM events GROUP BY 1",
    "load_balance": "WITH n AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), g AS (SELECT event_type, count(*) AS users, avg(n) AS mean, max(n) AS most FROM n GROUP BY 1) SELECT event_type, users, round(mean, 6) AS mean, most, round(mean / most, 6) AS balance, round(greatest(1, least(2, most / mean)), 6) AS capacity FROM g",
    "prefix_frequency": r"WITH p AS (SELECT list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w, length(coalesce(text, '')) AS n FROM conversations WHERE role = 'user') SELECT array_to_string(w[1:2], ' ') AS prefix, count(*) AS n, round(avg(n), 6) AS mean_chars FROM p WHERE len(w) >= 2 GROUP BY 1 HAVING count(*) >= 2",
    "ngram_dictionary": "WITH s AS (SELECT substr(t, i, k) AS s, k FROM (SELECT coalesce(text, '') AS t, k, unnest(range(1, length(coalesce(text, '')) - k + 2)) AS i FROM benchmark, (VALUES (4), (8), (16)) v(k))), c AS (SELECT s, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT s, n, CAST(n * k * k AS BIGINT) AS score FROM c WHERE n > (SELECT count(*) FROM benchmark) ORDER BY score DESC, hex(encode(s)) LIMIT 100",
    "importance_ewma": "WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events WHERE value IS NOT NULL) SELECT user_id, count(*) AS n, round(sum(0.1::DOUBLE * pow(0.9::DOUBLE, age) * value) + pow(0.9::DOUBLE, count(*)), 5) AS ewma FROM a GROUP BY 1",
    "rolling_throughput": "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS i FROM events), f AS (SELECT event_id, i, min(i) OVER w AS a, sum(value) OVER w AS total, sum(value * i) OVER w AS x FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING)) SELECT event_id, round(total, 4) AS total, round((x - (a - 1) * total) / ((i - a + 1) * (i - a + 2) / 2), 4) AS weighted FROM f",
    "checkpoint_asof": "SELECT o_orderkey, (SELECT max_by(event_id, (ts, event_id)) FROM events e WHERE e.user_id = o.o_custkey AND e.ts <= o.o_orderdate) AS event_id FROM orders o",
    "cache_evict": f"WITH g AS (SELECT user_id, round(1 / ((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(max(ts)))) / 3600.0::DOUBLE + 1) * greatest(ln(count(*)), 1), 12) AS score, CAST(sum(CAST(round(coalesce(value, 0) * 100) AS BIGINT)) AS BIGINT) AS size FROM events GROUP BY 1), f AS (SELECT *, CAST(sum(size) OVER (ORDER BY score, user_id) AS BIGINT) AS freed, sum(size) OVER () AS whole FROM g) SELECT user_id, size, freed FROM f WHERE freed - size < whole * (1 - 0.6)",
    "priority_schedule": "SELECT o_orderkey, round(CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) + 0.5 * (1 - least(o_totalprice / 500000.0, 1)), 6) AS effective FROM orders ORDER BY effective, o_orderkey LIMIT 100",
    "tumbling_events": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "session_events": "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s",
    "reservoir": "SELECT doc_id FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 100",
    "format_sniff": "WITH h AS (SELECT substr(hex(encode(coalesce(html, ''))), 1, 8) AS h FROM pages) SELECT CASE WHEN h LIKE '1F8B%' THEN 'gzip' WHEN h = '28B52FFD' THEN 'zstd' WHEN h = '04224D18' THEN 'lz4' WHEN substr(h, 1, 4) IN ('7801', '789C', '78DA') THEN 'zlib' WHEN h LIKE '3C%' THEN 'markup' ELSE 'raw' END AS kind, count(*) AS n FROM h GROUP BY 1",
    "hash_sample": "SELECT p_partkey, p_name FROM part WHERE CAST('0x' || substr(md5(p_name), 1, 8) AS BIGINT) < 0.25 * 4294967296",
}
