"""Ordered state, schedules, rankings and evictions over event logs, and heads of attention layers.

Windows run along one entity's rows. Times are compared with a parameter, never
with the clock; every order has a tie-breaker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import names as N
from quern.operators.catalogs import CATEGORIES, STEPS, STEPS_SQL, categorised, precision_at, steps, with_categories, zones
from quern.operators.records import running_total
from quern.plans.registry import Registry, lookup_sql, values_sql

REG = Registry()
AS_OF = 1_735_689_600  # 2025-01-01, epoch seconds
_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


def _r(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def along(*more: Column) -> Window:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


# Totals of operations


def operation_stats(lines: DataFrame) -> DataFrame:
    """AGG1-3: per flag: operations, bytes in and out, ratio (1 without output), savings, throughput, greatest peak, error rate, summary.

    Prices stand for bytes, the line number for milliseconds, every odd tax for a peak, returned lines for errors.
    """
    spent = F.sum(F.col("l_linenumber").cast("double") * 1000)
    a, b = F.sum("l_extendedprice"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    g = lines.groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("operations"), _r(a, 2).alias("bytes_in"), _r(b, 2).alias("bytes_out"), spent.alias("time_us"), F.max(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity"))).alias("peak"), F.count_if(F.col("l_returnflag") == "R").alias("errors"))
    ratio = F.when(F.col("bytes_out") == 0, 1.0).otherwise(F.col("bytes_in") / F.col("bytes_out"))
    speed = F.when(F.col("time_us") == 0, 0.0).otherwise(F.col("bytes_in") / F.col("time_us"))  # bytes a microsecond are MB a second
    text = F.format_string("Operations: %d, ratio: %.2fx, Throughput: %.1f MB/s, Errors: %d", "operations", ratio, speed, "errors")
    return g.select("l_linestatus", "operations", "bytes_in", "bytes_out", _r(ratio).alias("ratio"), _r((1 - F.col("bytes_out") / F.col("bytes_in")) * 100).alias("savings"), _r(speed).alias("mb_per_s"), "peak", _r(F.col("errors") / F.col("operations")).alias("error_rate"), text.alias("summary"))


REG.add("operation_stats", operation_stats, "WITH g AS (SELECT l_linestatus, count(*) AS operations, round(sum(l_extendedprice), 2) AS i, round(sum(l_extendedprice * (1 - l_discount)), 2) AS o, sum(l_linenumber * 1000)::DOUBLE AS t, max(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END) AS peak, count(*) FILTER (l_returnflag = 'R') AS e FROM lineitem GROUP BY 1) SELECT l_linestatus, operations, i AS bytes_in, o AS bytes_out, round(i / o, 6) AS ratio, round((1 - o / i) * 100, 6) AS savings, round(i / t, 6) AS mb_per_s, peak, round(e / operations, 6) AS error_rate, printf('Operations: %d, ratio: %.2fx, Throughput: %.1f MB/s, Errors: %d', operations, i / o, i / t, e) AS summary FROM g", "lineitem")


def usage_totals(usage: DataFrame) -> DataFrame:
    """AGG5: one row over (id, loads, uses): totals, mean ratio of uses to loads, entries of high (> 0.8) and low (< 0.2) ratio."""
    ratio = F.when(F.col("loads") == 0, 0.0).otherwise(F.col("uses") / F.col("loads"))
    return usage.select("loads", "uses", ratio.alias("r")).agg(F.count(F.lit(1)).alias("fragments"), F.sum("loads").alias("loads"), F.sum("uses").alias("uses"), _r(F.coalesce(F.avg("r"), F.lit(0.0))).alias("mean_ratio"), F.count_if(F.col("r") > 0.8).alias("high"), F.count_if(F.col("r") < 0.2).alias("low"))


REG.add("usage_totals", lambda e: usage_totals(e.groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.count(F.lit(1)).alias("loads"), F.count_if(F.col("event_type").isin("click", "view")).alias("uses"))), "WITH u AS (SELECT count(*) AS loads, count(*) FILTER (event_type IN ('click', 'view')) AS uses FROM events GROUP BY user_id, date_trunc('day', ts)) SELECT count(*) AS fragments, CAST(sum(loads) AS BIGINT) AS loads, CAST(sum(uses) AS BIGINT) AS uses, round(avg(uses / loads), 6) AS mean_ratio, count(*) FILTER (uses / loads > 0.8) AS high, count(*) FILTER (uses / loads < 0.2) AS low FROM u", "events")


def bottlenecks(spans: DataFrame) -> DataFrame:
    """AGG14: a row per span and cause, of (name, us): spread over half the mean (more than 10 calls), longest over 10 means, more than half of all time."""
    g = spans.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("us").alias("total"), F.max("us").alias("most"), F.avg("us").alias("mean"), F.stddev_pop("us").alias("std"))
    g = g.withColumn("percent", F.col("total") / F.sum("total").over(Window.partitionBy()) * 100)  # a row per span name
    causes = F.array(F.when((F.col("std") > F.col("mean") * 0.5) & (F.col("n") > 10), F.struct(F.lit("HighVariance").alias("cause"), F.lit(2).alias("severity"))), F.when(F.col("most") > F.col("mean") * 10, F.struct(F.lit("LongTail").alias("cause"), F.lit(1).alias("severity"))), F.when(F.col("percent") > 50, F.struct(F.lit("Dominant").alias("cause"), F.lit(3).alias("severity"))))
    return g.select("name", _r(F.col("percent")).alias("percent"), F.explode(F.filter(causes, lambda c: c.isNotNull())).alias("c")).select("name", "percent", "c.*")


REG.add("profiler_bottlenecks", lambda e: bottlenecks(e.select(F.concat_ws(":", "event_type", (F.col("user_id") % 3).cast("string")).alias("name"), F.pow(F.col("value"), F.lit(2.0)).alias("us"))), "WITH g AS (SELECT event_type || ':' || user_id % 3 AS name, count(*) AS n, sum(value ** 2) AS total, max(value ** 2) AS most, avg(value ** 2) AS mean, stddev_pop(value ** 2) AS std FROM events GROUP BY 1), p AS (SELECT *, total / sum(total) OVER () * 100 AS percent FROM g) SELECT name, round(percent, 6) AS percent, 'HighVariance' AS cause, 2 AS severity FROM p WHERE std > mean * 0.5 AND n > 10 UNION ALL SELECT name, round(percent, 6), 'LongTail', 1 FROM p WHERE most > mean * 10 UNION ALL SELECT name, round(percent, 6), 'Dominant', 3 FROM p WHERE percent > 50", "events")


def top_spans(spans: DataFrame, n: int = 5) -> DataFrame:
    """AGG13, TOP3: the n span names with most time, and their share of all time. A top-k report."""
    g = spans.groupBy("name").agg(F.sum("us").alias("total"))
    return g.withColumn("percent", _r(F.col("total") / F.sum("total").over(Window.partitionBy()) * 100)).orderBy(F.desc("total"), "name").limit(n).select("name", _r(F.col("total"), 4).alias("total"), "percent")


REG.add("profiler_top5", lambda e: top_spans(e.select(F.concat_ws(":", "event_type", (F.col("user_id") % 3).cast("string")).alias("name"), F.col("value").alias("us"))), "WITH g AS (SELECT event_type || ':' || user_id % 3 AS name, sum(value) AS total FROM events GROUP BY 1) SELECT name, round(total, 4) AS total, round(total / sum(total) OVER () * 100, 6) AS percent FROM g ORDER BY g.total DESC, name LIMIT 5", "events")


def start_times(events: DataFrame) -> DataFrame:
    """AGG15: per user group: mean of cold and of warm starts, share of cold ones, the cold value at floor(95 % of n). An error event is a cold start."""
    cold = F.col("event_type") == "error"
    g = events.groupBy((F.col("user_id") % 10).alias("pool"), "value").agg(F.count_if(cold).alias("c"), F.count_if(~cold).alias("w"))
    pool = Window.partitionBy("pool")
    g = g.withColumn("upto", F.sum("c").over(pool.orderBy("value"))).withColumn("n", F.sum("c").over(pool))
    mean = lambda x: _r(F.coalesce(F.try_divide(F.sum(F.col("value") * F.col(x)), F.sum(x)), F.lit(0.0)))
    return g.groupBy("pool").agg(mean("c").alias("cold_ms"), mean("w").alias("warm_ms"), _r(F.try_divide(F.sum("c"), F.sum(F.col("c") + F.col("w")))).alias("cold_share"), F.min(F.when((F.col("c") > 0) & (F.col("upto") > F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)), F.col("value"))).alias("p95"))


REG.add("cold_starts", start_times, "SELECT user_id % 10 AS pool, round(coalesce(avg(value) FILTER (event_type = 'error'), 0), 6) AS cold_ms, round(avg(value) FILTER (event_type <> 'error'), 6) AS warm_ms, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS cold_share, list_sort(list(value) FILTER (event_type = 'error'))[CAST(least(floor(count(*) FILTER (event_type = 'error') * 0.95), count(*) FILTER (event_type = 'error') - 1) AS BIGINT) + 1] AS p95 FROM events GROUP BY 1", "events")


def style_frequency(prompts: DataFrame, least: int = 2) -> DataFrame:
    """AGG18: style words that at least so many prompts hold, with their share of all prompts; of (id, prompt)."""
    lower = F.lower("prompt")
    held = F.array(*[F.when(F.contains(lower, F.lit(s)), s) for s in N.STYLE_WORDS])
    total = prompts.count()
    return prompts.select(F.explode(F.filter(held, lambda s: s.isNotNull())).alias("style")).groupBy("style").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).withColumn("confidence", _r(F.col("n") / float(max(total, 1))))


_STYLE = values_sql([(s,) for s in N.STYLE_WORDS], "style")
REG.add("style_frequency", lambda p: style_frequency(categorised(p)), f"WITH {CATEGORIES} SELECT style, count(*) AS n, round(count(*) / (SELECT count(*) FROM prompts), 6) AS confidence FROM prompts, {_STYLE} WHERE contains(lower(prompt), style) GROUP BY 1 HAVING count(*) >= 2", "part")


def semantic_categories(prompts: DataFrame, top: int = 4) -> DataFrame:
    """AGG19, STR4: (id, category, score, complexity): summed confidences of a prompt's words by category, the best four, over the greatest."""
    table = prompts.sparkSession.createDataFrame([(w, c, s) for w, (c, s) in N.SEMANTIC_WORDS.items()], "word string, category string, confidence double")
    words = N.tokens(F.col("prompt"))
    hit = prompts.select("id", N.complexity(words).alias("complexity"), F.explode(words).alias("word")).join(F.broadcast(table), "word")
    g = hit.groupBy("id", "category").agg(F.round(F.sum("confidence"), 9).alias("s"), F.first("complexity").alias("complexity"))
    w = Window.partitionBy("id")
    g = g.withColumn("nth", F.row_number().over(w.orderBy(F.desc("s"), "category"))).withColumn("most", F.max("s").over(w))
    return g.where(F.col("nth") <= top).select("id", "category", _r(F.col("s") / F.col("most")).alias("score"), _r(F.col("complexity")).alias("complexity"))


_SEM = values_sql([(w, c, s) for w, (c, s) in N.SEMANTIC_WORDS.items()], "word", "category", "confidence")
REG.add("semantic_categories", lambda p: semantic_categories(categorised(p)), f"WITH {CATEGORIES}, w AS (SELECT id, len(ws) AS n, unnest(ws) AS t FROM (SELECT id, list_filter(regexp_split_to_array(lower(prompt), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM prompts)), g AS (SELECT id, category, round(sum(confidence), 9) AS s, any_value(n) AS n FROM w JOIN {_SEM} ON word = t GROUP BY 1, 2) SELECT id, category, round(s / max(s) OVER (PARTITION BY id), 6) AS score, round(least(n / 50.0::DOUBLE, 1), 6) AS complexity FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, category) <= 4", "part")

# Weight of head categories by prompt category; categories that are always active; importance of the others by default.
HEAD_WEIGHTS = {
    "Portrait": {"Face": 1.0, "Body": 0.8, "Background": 0.3, "Style": 0.7, "Detail": 0.9, "Lighting": 0.7},
    "Landscape": {"Face": 0.1, "Body": 0.2, "Background": 1.0, "Composition": 1.0, "Lighting": 0.9, "Color": 0.8},
    "Abstract": {"Face": 0.0, "Body": 0.0, "Style": 1.0, "Composition": 1.0, "Color": 0.9, "Edge": 0.7},
    "Photorealistic": {"Detail": 1.0, "Lighting": 1.0, "Color": 0.9, "Edge": 0.8},
    "Anime": {"Face": 0.9, "Style": 1.0, "Edge": 0.9, "Color": 0.8, "Detail": 0.5},
    "Architecture": {"Face": 0.0, "Composition": 1.0, "Edge": 1.0, "Detail": 0.9, "Lighting": 0.8},
    "Object": {"Face": 0.0, "Detail": 1.0, "Edge": 0.9, "Lighting": 0.8, "Color": 0.7},
    "Fantasy": {"Style": 1.0, "Composition": 0.9, "Lighting": 0.9, "Color": 0.8},
}
MANDATORY = ("General", "Composition")
HEAD_DEFAULTS = {"General": 1.0, "Composition": 0.9, "Style": 0.8, "Detail": 0.7, "Face": 0.6, "Body": 0.6, "Background": 0.5, "Lighting": 0.5, "Color": 0.4, "Edge": 0.4}


def head_weights(prompts: DataFrame) -> DataFrame:
    """AGG20: (id, head, weight) of (id, categories): profiles of the categories summed up, the n-th by 1/n, over the greatest; mandatory heads have 1."""
    heads = list(dict.fromkeys(h for hs in HEAD_WEIGHTS.values() for h in hs))
    table = prompts.sparkSession.createDataFrame([(c, *map(hs.get, heads)) for c, hs in HEAD_WEIGHTS.items()], ", ".join(["category string", *(f"{h} double" for h in heads)]))
    each = prompts.select("id", F.posexplode_outer("categories").alias("nth", "category")).join(F.broadcast(table), "category", "left")
    sums = each.groupBy("id").agg(F.count_if(F.coalesce("nth", F.lit(0)) == 0).cast("int").alias("prompts"), *[F.sum(F.col(h) / (F.col("nth") + 1)).alias(h) for h in heads])
    sums = sums.withColumn("most", F.greatest(*heads))
    row = lambda h, w: F.struct(F.lit(h).alias("head"), w.alias("weight"))
    scaled = F.array(*[row(h, _r(F.when(F.col("most") > 0, F.col(h) / F.col("most")).otherwise(F.col(h)))) for h in heads if h not in MANDATORY])
    always = F.flatten(F.array_repeat(F.array(*[row(h, F.lit(1.0)) for h in MANDATORY]), F.col("prompts")))
    return sums.select("id", F.explode(F.concat(scaled, always)).alias("h")).select("id", "h.*").where(F.col("weight").isNotNull())


_HW = values_sql([(c, h, w) for c, hs in HEAD_WEIGHTS.items() for h, w in hs.items()], "c", "head", "w")
WEIGHTS = f"{CATEGORIES}, hw AS (SELECT id, head, sum(w / (nth + 1)) AS s FROM cats JOIN {_HW} ON c = category GROUP BY 1, 2), weights AS (SELECT id, head, weight FROM (SELECT id, head, s / max(s) OVER (PARTITION BY id) AS weight FROM hw) WHERE head NOT IN ('General', 'Composition') UNION ALL SELECT id, head, 1.0::DOUBLE FROM prompts, (VALUES ('General'), ('Composition')) m(head))"
REG.add("head_weights", lambda p: head_weights(with_categories(categorised(p))), f"WITH {WEIGHTS} SELECT id, head, round(weight, 6) AS weight FROM weights", "part")

# Heads of layers: a line is a sample of a head's activation.
LAYERS_N, HEADS_N = 12, 7


def activations(lines: DataFrame) -> DataFrame:
    """(layer, head, value) samples."""
    return lines.select((F.col("l_suppkey") % LAYERS_N).cast("int").alias("layer"), (F.col("l_linenumber") - 1).cast("int").alias("head"), (F.col("l_discount") * (1 + F.col("l_linenumber") + F.col("l_suppkey") % LAYERS_N) / 2).alias("value"))


def head_stats(samples: DataFrame) -> DataFrame:
    """AGG9: per layer and head: importance (mean, in 0 to 1), population variance, share of values over 0.1."""
    return samples.groupBy("layer", "head").agg(F.round(F.least(F.greatest(F.avg("value"), F.lit(0.0)), F.lit(1.0)), 9).alias("importance"), F.round(F.var_pop("value"), 9).alias("variance"), F.round(F.avg((F.col("value") > 0.1).cast("double")), 9).alias("rate"))


ACT = f"act AS (SELECT CAST(l_suppkey % {LAYERS_N} AS INT) AS layer, CAST(l_linenumber - 1 AS INT) AS head, l_discount * (1 + l_linenumber + l_suppkey % {LAYERS_N}) / 2 AS value FROM lineitem), heads AS (SELECT layer, head, round(least(greatest(avg(value), 0), 1), 9) AS importance, round(var_pop(value), 9) AS variance, round(count(*) FILTER (value > 0.1) / count(*), 9) AS rate FROM act GROUP BY 1, 2)"
_heads = lambda lines: head_stats(activations(lines))
REG.add("head_stats", lambda x: _heads(x).select("layer", "head", _r(F.col("importance"), 5).alias("importance"), _r(F.col("variance"), 5).alias("variance"), _r(F.col("rate")).alias("rate")), f"WITH {ACT} SELECT layer, head, round(importance, 5) AS importance, round(variance, 5) AS variance, round(rate, 6) AS rate FROM heads", "lineitem")
REG.add("important_heads", lambda x: _heads(x).where("importance >= 0.25").select("layer", "head"), f"WITH {ACT} SELECT layer, head FROM heads WHERE importance >= 0.25", "lineitem")


def layer_importance(heads: DataFrame) -> DataFrame:
    """AGG8: mean importance of a layer's heads."""
    return heads.groupBy("layer").agg(F.round(F.avg("importance"), 9).alias("importance"))


def suggested_sparsity(heads: DataFrame, target: float = 0.5) -> DataFrame:
    """AGG11: per layer: target * (2 - importance / mean of all layers), in 0.1 to 0.9."""
    per = layer_importance(heads)
    mean = F.avg("importance").over(Window.partitionBy())  # a row per layer
    ratio = F.when(mean > 0, F.col("importance") / mean).otherwise(1.0)
    return per.select("layer", _r(F.col("importance"), 5).alias("importance"), _r(F.least(F.greatest(target * (2 - ratio), F.lit(0.1)), F.lit(0.9)), 5).alias("sparsity"))


def prune_threshold(heads: DataFrame) -> DataFrame:
    """TOP14, AGG10: one row: the importance at floor(n / 2), n / 4 and 3n / 4 of the sorted list, with mean, spread and bounds."""
    s = F.sort_array(F.collect_list("importance"))  # a value per head
    n = F.count(F.lit(1))
    at = lambda p: F.get(s, F.floor(n * p).cast("int"))
    return heads.agg(n.alias("heads"), *[_r(x, 5).alias(k) for k, x in (("mean", F.avg("importance")), ("std", F.stddev_pop("importance")), ("least", F.min("importance")), ("most", F.max("importance")), ("p25", at(0.25)), ("median", at(0.5)), ("p75", at(0.75)), ("p90", at(0.9)))])


REG.add("suggested_sparsity", lambda x: suggested_sparsity(_heads(x)), f"WITH {ACT}, l AS (SELECT layer, round(avg(importance), 9) AS importance FROM heads GROUP BY 1) SELECT layer, round(importance, 5) AS importance, round(least(greatest(0.5::DOUBLE * (2 - importance / avg(importance) OVER ()), 0.1), 0.9), 5) AS sparsity FROM l", "lineitem")
REG.add("prune_threshold", lambda x: prune_threshold(_heads(x)), f"WITH {ACT}, s AS (SELECT count(*) AS n, list_sort(list(importance)) AS l, avg(importance) AS a, stddev_pop(importance) AS d FROM heads) SELECT n AS heads, round(a, 5) AS mean, round(d, 5) AS std, round(l[1], 5) AS least, round(l[n], 5) AS most, " + ", ".join(f"round(l[CAST(floor(n * {p}) AS BIGINT) + 1], 5) AS {k}" for k, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9))) + " FROM s", "lineitem")


def masks(spark, layers: int = LAYERS_N, heads: int = HEADS_N, stride: int = 3, count: int = 5, least: int = 4) -> DataFrame:
    """ARR6: (layer, strided, skip_first, skip_last): masks as arrays of 0 and 1; where fewer than ``least`` heads are active, the lowest inactive ones are turned on."""
    every = F.sequence(F.lit(0), F.lit(heads - 1))

    def repaired(mask: Column) -> Column:
        on = F.aggregate(mask, F.lit(0), lambda a, x: a + x)
        inactive = F.filter(every, lambda i: F.get(mask, i) == 0)
        extra = F.slice(inactive, F.lit(1), F.greatest(F.lit(least) - on, F.lit(0)))
        return F.transform(mask, lambda x, i: F.when(F.array_contains(extra, i), 1).otherwise(x))

    made = {"strided": lambda i: (i % stride != 0).cast("int"), "skip_first": lambda i: (i >= count).cast("int"), "skip_last": lambda i: (i < heads - count).cast("int")}
    return spark.range(layers).select(F.col("id").cast("int").alias("layer"), *[repaired(F.transform(every, f)).alias(k) for k, f in made.items()])


def category_masks(weights: DataFrame, heads: int = 10, sparsity: float = 0.4) -> DataFrame:
    """ARR6, L10: (id, active): of ten heads, one per head category, the floor(heads * sparsity) of least weight are skipped; categories without a weight have their default. A weight that is given twice counts by the greater."""
    known = F.when(F.col("id").isNotNull(), F.col("weight"))
    wide = weights.groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("head") == h, known)), F.lit(d)).alias(h) for h, d in HEAD_DEFAULTS.items()])
    names = list(HEAD_DEFAULTS)
    before = lambda i: sum(((F.col(h) < F.col(names[i])) | ((F.col(h) == F.col(names[i])) & F.lit(k < i))).cast("int") for k, h in enumerate(names) if k != i)
    return wide.select("id", F.concat(*[F.when(before(i) >= int(heads * sparsity), "1").otherwise("0") for i in range(len(names))]).alias("active"))


def mask_bytes(mask: Column) -> Column:
    """ARR7: bits packed into bytes, the first in the lowest bit, as hex."""
    n = F.size(mask)
    byte = lambda b: F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda a, i: a + F.coalesce(F.get(mask, b * 8 + i), F.lit(0)) * F.pow(F.lit(2.0), i).cast("int"))
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 8).cast("int")), lambda b: F.lpad(F.hex(byte(b)), 2, "0")), ""))


def mask_from_bytes(text: Column, heads: int) -> Column:
    """ARR7: the first so many bits of packed bytes."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda i: F.conv(F.substring(text, F.floor(i / 8).cast("int") * 2 + 1, 2), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2.0), i % 8).cast("int")) > 0)
    return F.transform(bits, lambda b: b.cast("int"))


def combined(a: Column, b: Column) -> tuple[Column, Column]:
    """JOIN10: AND and OR of two masks; null where their sizes differ."""
    same = F.size(a) == F.size(b)
    return F.when(same, F.zip_with(a, b, lambda x, y: x * y)), F.when(same, F.zip_with(a, b, lambda x, y: F.greatest(x, y)))


def mask_table(spark) -> DataFrame:
    """ARR6-7, JOIN10, FLT5: masks, their AND and OR, packed and unpacked forms, and active places."""
    m = masks(spark).withColumnsRenamed({c: f"_{c}" for c in ("strided", "skip_first", "skip_last")})
    both, either = combined(F.col("_strided"), F.col("_skip_first"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "")
    active = F.filter(F.transform("_strided", lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())
    return m.select("layer", *[text(F.col(f"_{c}")).alias(c) for c in ("strided", "skip_first", "skip_last")], text(both).alias("both"), text(either).alias("either"), mask_bytes(F.col("_strided")).alias("packed"), text(mask_from_bytes(mask_bytes(F.col("_strided")), HEADS_N)).alias("unpacked"), F.array_join(F.transform(active, lambda i: i.cast("string")), ",").alias("active"))


_M = f"m AS (SELECT CAST(layer AS INT) AS layer, i, CASE WHEN i % 3 <> 0 THEN 1 ELSE 0 END AS s, CASE WHEN i >= 5 OR i < 2 THEN 1 ELSE 0 END AS f, CASE WHEN i < 2 OR i IN (2, 3) THEN 1 ELSE 0 END AS l FROM range({LAYERS_N}) a(layer), range({HEADS_N}) b(i))"
REG.add("attention_masks", lambda region: mask_table(region.sparkSession), f"WITH {_M} SELECT layer, string_agg(s, '' ORDER BY i) AS strided, string_agg(f, '' ORDER BY i) AS skip_first, string_agg(l, '' ORDER BY i) AS skip_last, string_agg(s * f, '' ORDER BY i) AS both, string_agg(greatest(s, f), '' ORDER BY i) AS either, printf('%02x', CAST(sum(s << i) AS BIGINT)) AS packed, string_agg(s, '' ORDER BY i) AS unpacked, string_agg(i, ',' ORDER BY i) FILTER (s = 1) AS active FROM m GROUP BY 1", "region")
REG.add("category_masks", lambda p: category_masks(head_weights(with_categories(categorised(p)))), f"WITH {WEIGHTS}, e AS (SELECT id, nr, head, d FROM prompts, {values_sql([(i, h, d) for i, (h, d) in enumerate(HEAD_DEFAULTS.items())], 'nr', 'head', 'd')}), r AS (SELECT e.id, nr, row_number() OVER (PARTITION BY e.id ORDER BY coalesce(round(weight, 6), d), nr) AS k FROM e LEFT JOIN weights w ON w.id = e.id AND w.head = e.head) SELECT id, string_agg(CASE WHEN k > 4 THEN '1' ELSE '0' END, '' ORDER BY nr) AS active FROM r GROUP BY 1", "part")


# State along a log


def averages(events: DataFrame, alpha: float = 0.1) -> DataFrame:
    """WIN1: per user: exponentially weighted means of quality (from 1), step and contribution (from 0) in order of time, in closed form."""
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    e = events.withColumn("age", F.row_number().over(last) - 1)
    fade = F.pow(F.lit(1 - alpha), F.col("age"))
    mean = lambda x, start: _r(F.sum(alpha * fade * x) + start * F.pow(F.lit(1 - alpha), F.count(F.lit(1))), 5)
    return e.groupBy("user_id").agg(mean(F.col("value") / 500, 1.0).alias("quality"), mean(F.col("event_id") % 50, 0.0).alias("step"), mean(F.col("event_id") % 7 / 7.0, 0.0).alias("contribution"))


REG.add("usage_averages", averages, "WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS age FROM events) SELECT user_id, " + ", ".join(f"round(sum(0.1::DOUBLE * pow(0.9::DOUBLE, age) * {x}) + {s} * pow(0.9::DOUBLE, count(*)), 5) AS {n}" for n, x, s in (("quality", "(value / 500)", 1), ("step", "(event_id % 50)", 0), ("contribution", "(event_id % 7 / 7.0::DOUBLE)", 0))) + " FROM a GROUP BY 1", "events")


def bandwidth(events: DataFrame, seconds: int = 86_400, samples: int = 10) -> DataFrame:
    """WIN2-3: per event: the rank-weighted mean rate of the user's last ``samples`` transfers within the time window, and the total rate in bits of the last 20.

    Value stands for bytes, 1 + event_id % 5 for seconds.
    """
    secs = (F.col("event_id") % 5 + 1).cast("double")
    e = events.select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").alias("b"), secs.alias("s"))
    frame = along().rowsBetween(1 - samples, 0)
    recent = F.filter(F.collect_list(F.struct("us", (F.col("b") / F.col("s")).alias("rate"))).over(frame), lambda x: x["us"] >= F.col("us") - seconds * 1_000_000)
    e = e.withColumn("recent", recent)
    top = F.aggregate(F.transform("recent", lambda x, i: x["rate"] * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    n = F.size("recent")
    last = along().rowsBetween(-19, 0)
    return e.select("event_id", _r(F.try_divide(top, n * (n + 1) / 2) + 1e-7, 3).alias("weighted"), _r(F.sum("b").over(last) / F.sum("s").over(last) * 8 + 1e-7, 2).alias("bits_per_s"))


REG.add("bandwidth", bandwidth, f"WITH e AS (SELECT event_id, user_id, ts, value AS b, (event_id % 5 + 1)::DOUBLE AS s, row_number() OVER ({_ORDER}) AS i FROM events), w AS (SELECT x.event_id, y.b / y.s AS rate, row_number() OVER (PARTITION BY x.event_id ORDER BY y.i) AS k FROM e x JOIN e y ON x.user_id = y.user_id AND y.i BETWEEN x.i - 9 AND x.i AND y.ts >= x.ts - INTERVAL 1 DAY), a AS (SELECT event_id, sum(rate * k) / sum(k) AS weighted FROM w GROUP BY 1), t AS (SELECT event_id, sum(b) OVER l / sum(s) OVER l * 8 AS bits FROM e WINDOW l AS (PARTITION BY user_id ORDER BY i ROWS 19 PRECEDING)) SELECT event_id, round(weighted + 1e-7, 3) AS weighted, round(bits + 1e-7, 2) AS bits_per_s FROM a JOIN t USING (event_id)", "events")


def schedule(spark) -> DataFrame:
    """WIN7, STR10: per preset and step: precision, whether it differs from the step before, the next step at which it changes, and its symbol."""
    p = precision_at(steps(spark), zones(spark))
    w = Window.partitionBy("preset").orderBy("step")
    p = p.withColumn("changes", F.coalesce(F.col("precision") != F.lag("precision").over(w), F.lit(False)))
    following = F.min(F.when(F.col("changes"), F.col("step"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    return p.select("preset", "step", "precision", "changes", following.alias("next_change"), N.looked_up(F.col("precision"), SYMBOLS).alias("symbol"))


SYMBOLS = {"INT4": "4", "INT8": "8", "BF16": "B", "FP16": "H", "FP32": "F"}


def timelines(scheduled: DataFrame) -> DataFrame:
    """STR10: per preset: a line of every fifth step and one of symbols."""
    rows = scheduled.groupBy("preset").agg(F.array_sort(F.collect_list(F.struct("step", "symbol"))).alias("x"))
    fifth = F.transform(F.filter("x", lambda r: r["step"] % 5 == 0), lambda r: F.concat(F.lpad(r["step"].cast("string"), 2, " "), F.lit(" ")))
    return rows.select("preset", F.concat(F.lit("Step: "), F.array_join(fifth, ""), F.lit("\nPrec: "), F.array_join(F.transform("x", lambda r: r["symbol"]), ""), F.lit("\n")).alias("timeline"))


_SCHED = f"{STEPS_SQL}, c AS (SELECT *, coalesce(precision <> lag(precision) OVER (PARTITION BY preset ORDER BY step), FALSE) AS changes FROM p)"
REG.add("precision_schedule", lambda region: schedule(region.sparkSession), f"WITH {_SCHED} SELECT preset, step, precision, changes, min(CASE WHEN changes THEN step END) OVER (PARTITION BY preset ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_change, {lookup_sql('precision', SYMBOLS, None)} AS symbol FROM c", "region")
REG.add("precision_timeline", lambda region: timelines(schedule(region.sparkSession)), f"WITH {_SCHED} SELECT preset, 'Step: ' || string_agg(CASE WHEN step % 5 = 0 THEN lpad(CAST(step AS VARCHAR), 2, ' ') || ' ' ELSE '' END, '' ORDER BY step) || chr(10) || 'Prec: ' || string_agg({lookup_sql('precision', SYMBOLS, None)}, '' ORDER BY step) || chr(10) AS timeline FROM c GROUP BY 1", "region")


def validate_zones(z: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """WIN8: per preset: whether its zones follow each other without a gap from 0 to 1, the first gap, and how often precision changes."""
    w = Window.partitionBy("zone_preset").orderBy("start")
    e = z.withColumn("want", F.coalesce(F.lag("end").over(w), F.lit(0.0))).withColumn("other", F.lag("precision").over(w))
    gap = F.abs(F.col("start") - F.col("want")) > tolerance
    g = e.groupBy(F.col("zone_preset").alias("preset")).agg(F.min(F.when(gap, F.col("want"))).alias("gap"), F.max("end").alias("last"), F.count_if(F.col("other").isNotNull() & (F.col("other") != F.col("precision"))).alias("transitions"))
    return g.select("preset", (F.col("gap").isNull() & (F.abs(F.col("last") - 1) <= tolerance)).alias("valid"), "gap", "transitions")


_BROKEN = (("Gap", 0.0, 0.3, "INT4"), ("Gap", 0.4, 1.0, "FP16"), ("Short", 0.0, 0.9, "INT8"))
REG.add("zone_validation", lambda region: validate_zones(zones(region.sparkSession).union(region.sparkSession.createDataFrame(list(_BROKEN), "a string, b double, c double, d string"))), f"WITH z AS (SELECT *, coalesce(lag(b) OVER w, 0) AS want, lag(precision) OVER w AS other FROM {values_sql([*N.ZONES, *_BROKEN], 'preset', 'a', 'b', 'precision')} WINDOW w AS (PARTITION BY preset ORDER BY a)) SELECT preset, count(*) FILTER (abs(a - want) > 0.001) = 0 AND abs(max(b) - 1) <= 0.001 AS valid, min(want) FILTER (abs(a - want) > 0.001) AS gap, count(*) FILTER (other <> precision) AS transitions FROM z GROUP BY 1", "region")

# Temperatures from which on a state holds.
FAIR, SERIOUS, CRITICAL = 35.0, 40.0, 45.0


def thermal(events: DataFrame) -> DataFrame:
    """WIN9: per event: state by temperature, workload factor (piecewise linear), and trend: (newest - oldest) / seconds over the last ten readings."""
    t = F.col("t")
    state = F.when(t >= CRITICAL, "Critical").when(t >= SERIOUS, "Serious").when(t >= FAIR, "Fair").otherwise("Nominal")
    work = F.when(t <= FAIR, 1.0).when(t <= SERIOUS, 1 - (t - FAIR) / (SERIOUS - FAIR) * 0.35).when(t <= CRITICAL, 0.65 - (t - SERIOUS) / (CRITICAL - SERIOUS) * 0.55).otherwise(0.1)
    e = events.select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.least(F.col("value") / 5 + 20, F.lit(60.0)).alias("t"))
    frame = along().rowsBetween(-9, 0)
    span = (F.col("us") - F.first("us").over(frame)) / 1e6
    return e.select("event_id", state.alias("state"), _r(work).alias("workload"), F.when(span > 0, _r((t - F.first("t").over(frame)) / span)).otherwise(0.0).alias("trend"))


def throttle_durations(states: DataFrame) -> DataFrame:
    """WIN9: per user: mean microseconds from a change into any state but Nominal to the next change; of (user_id, ts, event_id, state)."""
    w = along()
    changed = states.withColumn("before", F.coalesce(F.lag("state").over(w), F.lit("Nominal"))).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).where("state <> before")
    changed = changed.withColumn("until", F.lead("us").over(w)).where("state <> 'Nominal' AND until IS NOT NULL")
    return changed.groupBy("user_id").agg(F.count(F.lit(1)).alias("throttles"), F.floor(F.sum(F.col("until") - F.col("us")) / F.count(F.lit(1))).alias("mean_us"))


_T = f"t AS (SELECT event_id, user_id, ts, least(value / 5 + 20, 60) AS t FROM events), st AS (SELECT *, CASE WHEN t >= {CRITICAL} THEN 'Critical' WHEN t >= {SERIOUS} THEN 'Serious' WHEN t >= {FAIR} THEN 'Fair' ELSE 'Nominal' END AS state FROM t)"
REG.add("thermal_states", thermal, f"WITH {_T}, f AS (SELECT *, first_value(ts) OVER w AS t0, first_value(t) OVER w AS v0 FROM st WINDOW w AS ({_ORDER} ROWS 9 PRECEDING)) SELECT event_id, state, round(CASE WHEN t <= 35 THEN 1 WHEN t <= 40 THEN 1 - (t - 35) / 5 * 0.35 WHEN t <= 45 THEN 0.65 - (t - 40) / 5 * 0.55 ELSE 0.1 END, 6) AS workload, CASE WHEN ts > t0 THEN round((t - v0) / ((epoch_us(ts) - epoch_us(t0)) / 1e6), 6) ELSE 0 END AS trend FROM f", "events")
REG.add("throttle_durations", lambda e: throttle_durations(thermal(e).join(e.select("event_id", "user_id", "ts"), "event_id")), f"WITH {_T}, b AS (SELECT *, coalesce(lag(state) OVER ({_ORDER}), 'Nominal') AS before FROM st), c AS (SELECT *, lead(epoch_us(ts)) OVER ({_ORDER}) AS until FROM b WHERE state <> before) SELECT user_id, count(*) AS throttles, CAST(floor(sum(until - epoch_us(ts)) / count(*)) AS BIGINT) AS mean_us FROM c WHERE state <> 'Nominal' AND until IS NOT NULL GROUP BY 1", "events")


def training_state(events: DataFrame, patience: int = 10) -> DataFrame:
    """WIN10-11: per event as a training step: best loss so far, steps since it improved, whether patience is spent, and the running loss at the user's last step.

    The running loss starts with the first loss and fades by 1 % a step.
    """
    w = along()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    e = events.where("value IS NOT NULL").withColumn("i", F.row_number().over(w)).withColumn("best", F.min("value").over(upto))
    better = F.col("best") < F.coalesce(F.lag("best").over(w), F.lit(float("inf")))
    e = e.withColumn("better", better)
    e = e.withColumn("stale", F.col("i") - F.max(F.when(F.col("better"), F.col("i"))).over(upto))
    return e.select("event_id", "best", F.col("stale").cast("int").alias("stale"), (F.col("stale") >= patience).alias("stop"))


def running_loss(events: DataFrame) -> DataFrame:
    """WIN11: per user: the loss that starts with the first value and then fades by 1 % a step, in closed form."""
    w = Window.partitionBy("user_id")
    e = events.where("value IS NOT NULL").withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy("ts", "event_id")))
    weight = F.pow(F.lit(0.99), F.col("n") - F.col("i")) * F.when(F.col("i") == 1, 1.0).otherwise(0.01)
    return e.groupBy("user_id").agg(_r(F.sum(weight * F.col("value")), 5).alias("running_loss"))


REG.add("training_state", training_state, f"WITH b AS (SELECT event_id, user_id, row_number() OVER ({_ORDER}) AS i, min(value) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) AS best FROM events WHERE value IS NOT NULL), f AS (SELECT *, min(i) OVER (PARTITION BY user_id, best) AS since FROM b) SELECT event_id, best, CAST(i - since AS INT) AS stale, i - since >= 10 AS stop FROM f", "events")
REG.add("running_loss", running_loss, f"WITH o AS (SELECT user_id, list(value ORDER BY ts, event_id) AS l FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT user_id, round(list_reduce(l, lambda a, x: 0.99::DOUBLE * a + 0.01::DOUBLE * x), 5) AS running_loss FROM o", "events")


def preview_buffer(events: DataFrame, most: int = 5) -> DataFrame:
    """WIN12, TOP12: per user the last ``most`` events, oldest dropped, numbered in order."""
    w = Window.partitionBy("user_id")
    kept = events.withColumn("back", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("back") <= most)
    return kept.select("user_id", "event_id", F.row_number().over(w.orderBy(F.desc("back"))).alias("at"))


REG.add("preview_buffer", preview_buffer, f"WITH b AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5) SELECT user_id, event_id, CAST(row_number() OVER ({_ORDER}) AS INT) AS at FROM b", "events")


def learning_rates(spark, initial: float = 1e-4, final: float = 1e-6, warmup: int = 100, total: int = 1000, every: int = 7) -> DataFrame:
    """WIN13: (step, constant, linear, cosine, exponential, decay, one_cycle) in units of 1e-6; a linear warm-up from the final rate comes first."""
    step = F.col("id")
    p = F.least((step - warmup) / float(total - warmup), F.lit(1.0))
    peak = initial * 10
    after = {
        "constant": F.lit(initial),
        "linear": initial + (final - initial) * p,
        "cosine": final + (initial - final) * 0.5 * (1 + F.cos(F.pi() * p)),
        "exponential": initial * F.exp(F.log(F.lit(final / initial)) * p),
        "decay": initial * F.pow(F.lit(0.1), F.floor(p / 0.3)),
        "one_cycle": F.when(p < 0.4, initial + (peak - initial) * (p / 0.4)).otherwise(peak + (final - peak) * ((p - 0.4) / 0.6)),
    }
    warm = final + (initial - final) * (step / float(warmup))
    return spark.range(0, total + 50, every).select(step.cast("int").alias("step"), *[_r(F.when(step < warmup, warm).otherwise(x) * 1e6, 5).alias(k) for k, x in after.items()])


_LR = {"constant": "1e-4", "linear": "1e-4 + (1e-6 - 1e-4) * p", "cosine": "1e-6 + (1e-4 - 1e-6) * 0.5 * (1 + cos(pi() * p))", "exponential": "1e-4 * exp(ln(1e-6 / 1e-4) * p)", "decay": "1e-4 * pow(0.1::DOUBLE, floor(p / 0.3::DOUBLE))", "one_cycle": "CASE WHEN p < 0.4::DOUBLE THEN 1e-4 + (1e-3 - 1e-4) * (p / 0.4::DOUBLE) ELSE 1e-3 + (1e-6 - 1e-3) * ((p - 0.4::DOUBLE) / 0.6::DOUBLE) END"}
REG.add("learning_rates", lambda region: learning_rates(region.sparkSession), "WITH s AS (SELECT step, least((step - 100) / 900.0::DOUBLE, 1) AS p FROM range(0, 1050, 7) r(step)) SELECT CAST(step AS INT) AS step, " + ", ".join(f"round(CASE WHEN step < 100 THEN 1e-6 + (1e-4 - 1e-6) * (step / 100.0::DOUBLE) ELSE {x} END * 1e6, 5) AS {k}" for k, x in _LR.items()) + " FROM s", "region")


def transitions(spark, length: int = 6, gap: int = 3, vram_mb: int = 8000) -> DataFrame:
    """WIN14: per preset: planned changes of precision: (start, end, from, to, kind).

    A change that starts less than ``gap`` steps after the one before has ended
    is left out; one that would hold more than 85 % of the memory of FP32 (90 %
    from 8 GB on) at its peak is made at once.
    """
    w = Window.partitionBy("preset").orderBy("start")
    z = zones(spark).select(F.col("zone_preset").alias("preset"), F.round(F.col("start") * STEPS).cast("int").alias("start"), "precision")
    z = z.withColumn("from", F.lag("precision").over(w)).where(F.col("from").isNotNull() & (F.col("from") != F.col("precision")))
    z = z.withColumn("begin", F.greatest(F.col("start") - length, F.lit(0)))
    z = z.withColumn("before", F.coalesce(F.lag("start").over(w), F.lit(-gap))).where(F.col("start") >= F.col("before") + gap)
    ratio = {k: v[0] / 32.0 for k, v in N.PRECISIONS.items()}
    peak = N.looked_up(F.col("from"), ratio) + N.looked_up(F.col("precision"), ratio)
    at_once = peak > (0.85 if vram_mb < 8192 else 0.9)
    return z.select("preset", F.when(at_once, F.col("start")).otherwise(F.col("begin")).alias("begin"), F.col("start").alias("end"), "from", F.col("precision").alias("to"), F.when(at_once, "immediate").otherwise("gradual").alias("kind"))


def blends(planned: DataFrame) -> DataFrame:
    """WIN14: per planned change and step: linear and smoothstep progress, and the precision in effect (the new one from half on)."""
    e = planned.select("preset", "from", "to", "begin", "end", F.explode(F.sequence("begin", "end")).alias("step"))
    t = F.when(F.col("end") == F.col("begin"), 1.0).otherwise((F.col("step") - F.col("begin")) / (F.col("end") - F.col("begin")).cast("double"))
    return e.select("preset", "step", _r(t).alias("linear"), _r(t * t * (3 - 2 * t)).alias("smooth"), F.when(t >= 0.5, F.col("to")).otherwise(F.col("from")).alias("effective"))


_RATIO = {k: v[0] / 32.0 for k, v in N.PRECISIONS.items()}
_TR = f"z AS (SELECT preset, CAST(round(a * {STEPS}) AS INT) AS start, precision, lag(precision) OVER (PARTITION BY preset ORDER BY a) AS was FROM {values_sql(N.ZONES, 'preset', 'a', 'b', 'precision')}), c AS (SELECT *, lag(start) OVER (PARTITION BY preset ORDER BY start) AS before FROM z WHERE was <> precision), tr AS (SELECT preset, CASE WHEN {lookup_sql('was', _RATIO, None)} + {lookup_sql('precision', _RATIO, None)} > 0.85 THEN start ELSE greatest(start - 6, 0) END AS \"begin\", start AS \"end\", was AS \"from\", precision AS \"to\" FROM c WHERE before IS NULL OR start >= before + 3)"
REG.add("precision_transitions", lambda region: transitions(region.sparkSession), f"WITH {_TR} SELECT *, CASE WHEN \"begin\" = \"end\" THEN 'immediate' ELSE 'gradual' END AS kind FROM tr", "region")
REG.add("transition_blends", lambda region: blends(transitions(region.sparkSession)), f"WITH {_TR}, s AS (SELECT *, unnest(range(\"begin\", \"end\" + 1)) AS step FROM tr), t AS (SELECT *, CASE WHEN \"begin\" = \"end\" THEN 1 ELSE (step - \"begin\") / (\"end\" - \"begin\")::DOUBLE END AS t FROM s) SELECT preset, CAST(step AS INT) AS step, round(t, 6) AS linear, round(t * t * (3 - 2 * t), 6) AS smooth, CASE WHEN t >= 0.5 THEN \"to\" ELSE \"from\" END AS effective FROM t", "region")

# Rankings and evictions


def top_and_bottom(scores: DataFrame, n: int = 20) -> DataFrame:
    """TOP1: the n entries of most and of least importance, of (id, importance). A top-k report."""
    most = scores.orderBy(F.desc("importance"), "id").limit(n).select("id", "importance", F.lit("top").alias("side"))
    return most.union(scores.orderBy("importance", "id").limit(n).select("id", "importance", F.lit("bottom").alias("side")))


_IMPORTANCE = "SELECT user_id AS id, round(avg(value), 6) AS importance FROM events GROUP BY 1"
REG.add("top_importance", lambda e: top_and_bottom(e.groupBy(F.col("user_id").alias("id")).agg(_r(F.avg("value")).alias("importance"))), f"WITH s AS ({_IMPORTANCE}) (SELECT id, importance, 'top' AS side FROM s ORDER BY importance DESC, id LIMIT 20) UNION ALL (SELECT id, importance, 'bottom' FROM s ORDER BY importance, id LIMIT 20)", "events")


def queue(requests: DataFrame, as_of: int, n: int = 50) -> DataFrame:
    """TOP6: the first n of a priority queue of (id, priority, importance, deadline s): each id once, by its first request; least effective priority first.

    Effective: priority + half of what importance lacks to 1, less 1 past the deadline or up to 0.5 within its last 10 s. A top-k report.
    """
    first = requests.groupBy("id").agg(F.min(F.struct("at", "priority", "importance", "deadline")).alias("f")).select("id", "f.*")
    left = F.col("deadline") - as_of
    urgent = F.when(F.col("deadline").isNull(), 0.0).when(left <= 0, -1.0).otherwise((F.least(left / 10.0, F.lit(1.0)) - 1) * 0.5)
    return first.select("id", _r(F.col("priority") + (1 - F.col("importance")) * 0.5 + urgent).alias("effective")).orderBy("effective", "id").limit(n)


REG.add("priority_queue", lambda e: queue(e.select((F.col("user_id") * 3 + F.col("event_id") % 3).alias("id"), F.col("event_id").alias("at"), (F.col("event_id") % 4).alias("priority"), F.least(F.col("value") / 500, F.lit(1.0)).alias("importance"), F.when(F.col("event_id") % 5 > 0, 1000 + F.col("event_id") % 40).alias("deadline")), 1015), "WITH f AS (SELECT user_id * 3 + event_id % 3 AS id, event_id % 4 AS p, least(value / 500, 1) AS i, CASE WHEN event_id % 5 > 0 THEN 1000 + event_id % 40 END AS d FROM events QUALIFY row_number() OVER (PARTITION BY user_id * 3 + event_id % 3 ORDER BY event_id) = 1) SELECT id, round(p + (1 - i) * 0.5 + CASE WHEN d IS NULL THEN 0 WHEN d <= 1015 THEN -1 ELSE -(1 - least((d - 1015) / 10.0::DOUBLE, 1)) * 0.5 END, 6) AS effective FROM f ORDER BY effective, id LIMIT 50", "events")


def evict_oldest(entries: DataFrame, most: int, size: int) -> DataFrame:
    """TOP8: (id) of (id, seen, size): the oldest entries, until no more than ``most`` entries and ``size`` bytes are left. Prefix sums by ranges, not in one task."""
    e = entries.select("id", "seen", "size", F.lit(1).cast("long").alias("one"))
    counted = running_total(running_total(e, [F.desc("seen"), F.desc("id")], "one", "newer"), [F.desc("seen"), F.desc("id")], "size", "held")
    return counted.where((F.col("newer") > most) | (F.col("held") > size)).select("id")


REG.add("evict_oldest", lambda e: evict_oldest(e.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("seen"), F.sum(F.floor("value")).alias("size")), 100, 400_000), "WITH g AS (SELECT user_id AS id, max(ts) AS seen, sum(CAST(floor(value) AS BIGINT)) AS size FROM events GROUP BY 1), o AS (SELECT id, row_number() OVER w AS n, sum(size) OVER w AS held FROM g WINDOW w AS (ORDER BY seen DESC, id DESC)) SELECT id FROM o WHERE n > 100 OR held > 400000", "events")


def expired(entries: DataFrame, as_of: int, ttl: int) -> Column:
    """FLT7, TOP9: whether an entry (state, created s, confidence) goes: cancelled or expired, too old, or of confidence below 0.3."""
    return F.col("state").isin("Cancelled", "Expired") | (as_of - F.col("created") > ttl) | (F.col("confidence") < 0.3)


def buffer_stats(entries: DataFrame, as_of: int, ttl: int) -> DataFrame:
    """TOP9: per state: entries, bytes, entries that are evicted and the bytes they free; ready ones among them count as misses."""
    gone = expired(entries, as_of, ttl)
    return entries.groupBy("state").agg(F.count(F.lit(1)).alias("entries"), _r(F.sum("size"), 4).alias("size"), F.count_if(gone).alias("evicted"), _r(F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0.0)), 4).alias("freed"), F.count_if(gone & (F.col("state") == "Ready")).alias("misses"))


_STATES = {"view": "Ready", "click": "Loading", "error": "Cancelled", "signup": "Expired", "purchase": "Ready"}


def speculations(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", N.looked_up(F.col("event_type"), _STATES).alias("state"), F.unix_timestamp("ts").alias("created"), (F.col("event_id") % 10 / 10.0).alias("confidence"), F.col("value").alias("size"))


_SPEC = f"sp AS (SELECT event_id, user_id, {lookup_sql('event_type', _STATES, None)} AS state, CAST(floor(epoch(ts)) AS BIGINT) AS created, event_id % 10 / 10.0::DOUBLE AS confidence, value AS size FROM events), ev AS (SELECT *, state IN ('Cancelled', 'Expired') OR 1706659200 - created > 1296000 OR confidence < 0.3 AS gone FROM sp)"
REG.add("evict_expired", lambda e: speculations(e).where(expired(e, 1_706_659_200, 1_296_000)).select("event_id", "state"), f"WITH {_SPEC} SELECT event_id, state FROM ev WHERE gone", "events")
REG.add("buffer_stats", lambda e: buffer_stats(speculations(e), 1_706_659_200, 1_296_000), f"WITH {_SPEC} SELECT state, count(*) AS entries, round(sum(size), 4) AS size, count(*) FILTER (gone) AS evicted, round(coalesce(sum(size) FILTER (gone), 0), 4) AS freed, count(*) FILTER (gone AND state = 'Ready') AS misses FROM ev GROUP BY 1", "events")


def healthy(nodes: DataFrame, as_of: int, timeout: int) -> DataFrame:
    """FLT9: (id, status, ready): nodes without a heartbeat within the timeout have failed; workers and hybrids that are Ready and alive can work."""
    alive = as_of - F.col("seen") <= timeout
    status = F.when(~alive & (F.col("status") != "Offline"), "Failed").otherwise(F.col("status"))
    return nodes.select("id", status.alias("status"), (F.col("role").isin("Worker", "Hybrid") & (status == "Ready")).alias("ready"))


_ROLE, _STATUS = {0: "Coordinator", 1: "Worker", 2: "Hybrid"}, {0: "Ready", 1: "Busy", 2: "Offline", 3: "Ready"}
REG.add("node_health", lambda e: healthy(e.groupBy(F.col("user_id").alias("id")).agg(F.max(F.unix_timestamp("ts")).alias("seen")).withColumn("role", N.looked_up((F.col("id") % 3).cast("int"), _ROLE)).withColumn("status", N.looked_up((F.col("id") % 4).cast("int"), _STATUS)), 1_706_659_200, 7_200), f"WITH g AS (SELECT user_id AS id, 1706659200 - floor(epoch(max(ts))) <= 7200 AS alive, {lookup_sql('user_id % 3', _ROLE, None)} AS role, {lookup_sql('user_id % 4', _STATUS, None)} AS was FROM events GROUP BY 1), s AS (SELECT id, role, CASE WHEN NOT alive AND was <> 'Offline' THEN 'Failed' ELSE was END AS status FROM g) SELECT id, status, role IN ('Worker', 'Hybrid') AND status = 'Ready' AS ready FROM s", "events")
REG.add("patterns_of_type", lambda t: t.where("role = 'user'").groupBy(F.when(F.contains("text", F.lit("?")), "Question").otherwise("Statement").alias("kind")).agg(F.count(F.lit(1)).alias("n")).where("kind = 'Statement'"), "SELECT 'Statement' AS kind, count(*) AS n FROM conversations WHERE role = 'user' AND NOT contains(text, '?')", "conversations")
REG.add("warmup_order", lambda s: s.select("s_suppkey", (F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))).alias("at")), "SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS at FROM supplier", "supplier")


def completions(history: DataFrame, asked: DataFrame, as_of: int = AS_OF, n: int = 4) -> DataFrame:
    """STR7, DATE1, P8: per asked prefix the four best prompts of ``history`` (key, count, seen s) that begin with it, by recency (halved after a day) and frequency, scaled by the prefix's length.

    The first three characters are the join key; ``asked`` holds prefixes of three and more.
    """
    h = history.withColumn("k", F.substring("key", 1, 3))
    a = asked.select(F.lower("prefix").alias("prefix")).where(F.char_length("prefix") >= 3).distinct().withColumn("k", F.substring("prefix", 1, 3))
    recency = 1 / (1 + (as_of - F.col("seen")) / 3600.0 / 24.0)
    score = 0.5 + recency * 0.25 + F.greatest(F.log(F.col("count").cast("double")), F.lit(1.0)) / 10 * 0.25
    hit = a.join(h, "k").where(F.startswith("key", "prefix")).select("prefix", "key", _r(score * (0.5 + F.least(F.char_length("prefix") / 20.0, F.lit(1.0)) * 0.5), 9).alias("score"))
    return hit.withColumn("at", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("score"), "key"))).where(F.col("at") <= n).select("prefix", "key", _r(F.col("score")).alias("score"), "at")


REG.add("prompt_completion", lambda p: completions(p.groupBy(F.lower("p_name").alias("key")).agg(F.count(F.lit(1)).alias("count"), (F.max("p_partkey") * 1000 + 1_735_000_000).alias("seen")), p.select(F.substring("p_name", 1, 5).alias("prefix"))), f"WITH h AS (SELECT lower(p_name) AS key, count(*) AS n, max(p_partkey) * 1000 + 1735000000 AS seen FROM part GROUP BY 1), a AS (SELECT DISTINCT lower(substr(p_name, 1, 5)) AS prefix FROM part), s AS (SELECT prefix, key, round((0.5 + 1 / (1 + ({AS_OF} - seen) / 3600.0::DOUBLE / 24.0::DOUBLE) * 0.25 + greatest(ln(n), 1) / 10 * 0.25) * (0.5 + least(length(prefix) / 20.0::DOUBLE, 1) * 0.5), 9) AS score FROM a JOIN h ON starts_with(key, prefix)) SELECT prefix, key, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY prefix ORDER BY score DESC, key) AS INT) AS at FROM s QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY score DESC, key) <= 4", "part")


def progress(orders: DataFrame, elapsed: float = 120.0) -> DataFrame:
    """AGG28, STM14: per priority: done and total, share, seconds left at the rate so far, throughput, and the first entry in progress."""
    done = F.count_if(F.col("o_orderstatus") == "F")
    n = F.count(F.lit(1))
    g = orders.groupBy("o_orderpriority").agg(done.alias("done"), n.alias("total"), F.sum("o_totalprice").alias("b"), F.min(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("current"))
    return g.select("o_orderpriority", "done", "total", _r(F.col("done") / F.col("total")).alias("progress"), F.when(F.col("done") > 0, _r((F.col("total") - F.col("done")) / (F.col("done") / elapsed))).otherwise(0.0).alias("seconds_left"), _r(F.col("b") / elapsed / 1e6).alias("mb_per_s"), "current")


REG.add("checkpoint_progress", progress, "WITH g AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total, sum(o_totalprice) AS b, min(o_orderkey) FILTER (o_orderstatus = 'P') AS current FROM orders GROUP BY 1) SELECT o_orderpriority, done, total, round(done / total, 6) AS progress, CASE WHEN done > 0 THEN round((total - done) / (done / 120.0::DOUBLE), 6) ELSE 0 END AS seconds_left, round(b / 120 / 1e6, 6) AS mb_per_s, current FROM g", "orders")
REG.add("pending_work", lambda o, li: o.where("o_orderstatus <> 'F'").join(li.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "retry").otherwise("pending").alias("state")), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'retry' ELSE 'pending' END AS state FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')", "orders", "lineitem")

QUERIES, ORACLE_SQL = REG.queries, REG.sql
