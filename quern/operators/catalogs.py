"""Catalogues of models, layers, tensors and fragments: filters, lookup chains, scores and totals.

The table of parts stands for a catalogue: a row is a fragment of a layer of a
model (its brand), with a layer name, a shape and a quality. Names are made by a
fixed rule, so that every name rule has rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import names as N
from quern.plans.registry import Registry, literal, lookup_sql, rules_sql, values_sql

REG = Registry()
KINDS = ("self_attn.q_proj.weight", "self_attn.k_proj.weight", "self_attn.v_proj.weight", "self_attn.o_proj.weight", "mlp.up_proj.weight", "mlp.down_proj.weight", "input_layernorm.weight", "embed_tokens.weight", "lm_head.weight", "attn.proj_bias", "conv_in.weight", "up_blocks.3.attn.face.weight", "down_blocks.2.resnet", "mid_block.attn", "vae.decoder.out", "attn.c_attn.weight", "io_buffer", "monkey", "final_ln", "rotary")
FLAT = ("input_layernorm.weight", "attn.proj_bias", "final_ln")
LEAST, MOST = 1024, 100_000
STEP, STEPS = 10, 50


def layers(part: DataFrame) -> DataFrame:
    """(id, model, layer, rows, cols, elements, quality, price) of the catalogue; cols is null for one dimension."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    rows, cols = (F.col("p_size") * 64).cast("long"), F.when(~kind.isin(*FLAT), F.col("p_partkey") % 64 + 1)
    out = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("model"), F.concat(F.lit("model.layers."), F.col("p_size").cast("string"), F.lit("."), kind).alias("layer"), rows.alias("rows"), cols.alias("cols"), (F.col("p_partkey") % 5 * 25).alias("quality"), F.col("p_retailprice").alias("price"))
    return out.withColumn("elements", F.col("rows") * F.coalesce("cols", F.lit(1)))


_KIND = f"[{', '.join(map(literal, KINDS))}][p_partkey % {len(KINDS)} + 1]"
LAYERS = f"""layers AS (SELECT p_partkey AS id, p_brand AS model, 'model.layers.' || p_size || '.' || {_KIND} AS layer, CAST(p_size * 64 AS BIGINT) AS rows,
  CASE WHEN {_KIND} NOT IN ({', '.join(map(literal, FLAT))}) THEN p_partkey % 64 + 1 END AS cols, p_partkey % 5 * 25 AS quality, p_retailprice AS price,
  CAST(p_size * 64 AS BIGINT) * coalesce(CASE WHEN {_KIND} NOT IN ({', '.join(map(literal, FLAT))}) THEN p_partkey % 64 + 1 END, 1) AS elements FROM part)"""


def _over_layers(f):
    return lambda part, *more: f(layers(part), *more)


# Filters


def eligible(tensors: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """FLT1: (id, elements, reason): why a tensor is left out, or null if it is processed. Size comes before shape."""
    reason = F.when(F.col("elements") < least, "too small").when(F.col("elements") > most, "too large").when(F.col("cols").isNull(), "1D tensor")
    return tensors.select("id", "elements", reason.alias("reason"))


def kept_tensors(tensors: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """FLT2: the tensors that are processed; the others are dropped without a reason."""
    return tensors.where(F.col("elements").between(least, most) & F.col("cols").isNotNull()).select("id", "layer", "elements")


def layers_for_quality(refs: DataFrame, least: int = 100) -> DataFrame:
    """FLT3: layers with any reference of at least that quality, and how many references they have."""
    return refs.groupBy("model", "layer").agg(F.max("quality").alias("best"), F.count(F.lit(1)).alias("refs")).where(F.col("best") >= least)


def layers_for_quality_nested(manifest: DataFrame, least: int = 100) -> DataFrame:
    """FLT3 over a nested manifest with ``refs`` array<struct<quality,...>>."""
    return manifest.where(F.exists("refs", lambda r: r["quality"] >= least))


def compatible(a: DataFrame, b: DataFrame) -> DataFrame:
    """FLT12: one row: whether two models have the same layers with the same shapes, and how many differ."""
    x, y = (m.select("layer", F.struct("rows", "cols").alias(n)) for m, n in ((a, "a"), (b, "b")))
    differ = ~F.col("a").eqNullSafe(F.col("b"))
    return x.join(y, "layer", "full").agg((F.count_if(differ) == 0).alias("compatible"), F.count_if(differ).alias("different"))


def by_priority(orders: DataFrame, least_urgent: int = 2) -> DataFrame:
    """FLT11: entries of the given priority and less urgent ones (1 is the most urgent)."""
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    return orders.where(p >= least_urgent).select("o_orderkey", p.alias("priority"))


def needs_revalidation(cached: DataFrame, remote: DataFrame) -> DataFrame:
    """FLT13: (id, stale): entries whose tag differs from the remote one, or has no counterpart on either side."""
    r = remote.select(F.col("id"), F.col("etag").alias("remote"))
    return cached.join(r, "id", "left").select("id", F.coalesce(F.col("etag") != F.col("remote"), F.lit(True)).alias("stale"))


REG.add("tensor_filter", _over_layers(eligible), f"WITH {LAYERS} SELECT id, elements, CASE WHEN elements < {LEAST} THEN 'too small' WHEN elements > {MOST} THEN 'too large' WHEN cols IS NULL THEN '1D tensor' END AS reason FROM layers", "part")
REG.add("tensor_kept", _over_layers(kept_tensors), f"WITH {LAYERS} SELECT id, layer, elements FROM layers WHERE elements >= {LEAST} AND elements <= {MOST} AND cols IS NOT NULL", "part")
REG.add("layers_for_quality", _over_layers(layers_for_quality), f"WITH {LAYERS} SELECT model, layer, max(quality) AS best, count(*) AS refs FROM layers GROUP BY 1, 2 HAVING bool_or(quality >= 100)", "part")
_MODEL = "SELECT layer, min(rows) AS rows, min(cols) AS cols FROM layers WHERE model = '{}' GROUP BY 1"


def one_model(t: DataFrame, model: str) -> DataFrame:
    return t.where(F.col("model") == model).groupBy("layer").agg(F.min("rows").alias("rows"), F.min("cols").alias("cols"))


REG.add("architecture_check", _over_layers(lambda t: compatible(one_model(t, "Brand#1"), one_model(t, "Brand#2")).union(compatible(one_model(t, "Brand#1"), one_model(t, "Brand#1")))), f"WITH {LAYERS}, a AS ({_MODEL.format('Brand#1')}), b AS ({_MODEL.format('Brand#2')}) SELECT count(*) FILTER (d) = 0 AS compatible, count(*) FILTER (d) AS different FROM (SELECT a.layer IS NULL OR b.layer IS NULL OR a.rows <> b.rows OR a.cols IS DISTINCT FROM b.cols AS d FROM a FULL JOIN b ON a.layer = b.layer) UNION ALL SELECT TRUE, 0", "part")
REG.add("priority_filter", by_priority, "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority FROM orders WHERE CAST(substr(o_orderpriority, 1, 1) AS INT) IN (2, 3, 4, 5)", "orders")
REG.add(
    "cache_revalidation",
    lambda part, supplier: needs_revalidation(part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 > 0, (F.col("p_size") % 25).cast("long")).alias("etag")), supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_nationkey").cast("long")).alias("etag"))),
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 > 0 AND s_suppkey IS NOT NULL AND s_suppkey % 5 > 0 THEN p_size % 25 <> s_nationkey ELSE TRUE END AS stale FROM part LEFT JOIN supplier ON p_partkey = s_suppkey",
    "part",
    "supplier",
)


# Lookup chains


def merge_layers(models: DataFrame, weights: dict[str, float]) -> DataFrame:
    """JOIN1, M1: (layer, merged): weighted means of a value over the given models, for layers that all of them have."""
    w = N.looked_up(F.col("model"), weights, 0.0)
    one = models.where(F.col("model").isin(*weights)).groupBy("layer", "model").agg(F.avg("price").alias("v"))
    g = one.groupBy("layer").agg(F.sum(w * F.col("v")).alias("s"), F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") == len(weights)).select("layer", F.round(F.col("s") / F.col("w"), 6).alias("merged"))


def missing_layers(models: DataFrame, base: str, others: list[str]) -> DataFrame:
    """JOIN1: (model, layer): layers of the base that another model lacks. A merge that needs all of them fails if there is one."""
    wanted = models.where(F.col("model") == base).select("layer").distinct().select("layer", F.explode(F.array(*map(F.lit, others))).alias("model"))
    return wanted.join(models.select("model", "layer").distinct(), ["model", "layer"], "left_anti").select("model", "layer")


def with_finetuned(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """JOIN2: (layer, value, changed): the tuned value of a layer, the base's own where the tuned model lacks it."""
    b, t = (m.groupBy("layer").agg(F.avg("price").alias(n)) for m, n in ((base, "b"), (tuned, "t")))
    return b.join(t, "layer", "left").select("layer", F.round(F.coalesce("t", "b"), 6).alias("value"), F.col("t").isNotNull().alias("changed"))


def precision_at(steps: DataFrame, zones: DataFrame) -> DataFrame:
    """JOIN7: (preset, step, precision): the zone with start <= fraction < end, FP16 outside all. ``zones`` is a small literal table."""
    hit = steps.join(F.broadcast(zones), (steps["preset"] == zones["zone_preset"]) & (F.col("fraction") >= F.col("start")) & (F.col("fraction") < F.col("end")), "left")
    return hit.select("preset", "step", "fraction", F.coalesce("precision", F.lit("FP16")).alias("precision"))


def layer_profiles(t: DataFrame, model_overrides: DataFrame, layer_overrides: DataFrame) -> DataFrame:
    """JOIN8: (id, sensitivity, origin): a model's own profile of a layer, else the layer's, else that of its kind."""
    kind = N.fragment_type(F.col("layer"))
    out = t.join(model_overrides.withColumnRenamed("sensitivity", "m"), ["model", "layer"], "left").join(layer_overrides.withColumnRenamed("sensitivity", "l"), "layer", "left")
    default = N.looked_up(kind, {k: v[0] for k, v in N.LAYER_PROFILES.items()}, N.LAYER_PROFILES["Generic"][0])
    return out.select("id", F.coalesce("m", "l", default).alias("sensitivity"), F.when(F.col("m").isNotNull(), "model").when(F.col("l").isNotNull(), "layer").otherwise("kind").alias("origin"))


def with_history(fragments: DataFrame, usage: DataFrame) -> DataFrame:
    """JOIN9: (id, importance): the score of a fragment's usage, 0.5 without any."""
    return fragments.join(usage, "id", "left").select("id", F.round(F.coalesce("score", F.lit(0.5)), 6).alias("importance"))


def category_hints(prompts: DataFrame, hints: DataFrame) -> DataFrame:
    """JOIN13: (id, at, pattern, priority): the hints of a prompt's categories by priority; of neighbours with one pattern the first stays."""
    # Without "outer" the categories would be made once more for a filter on their number; the join drops what it adds.
    at = prompts.select("id", F.posexplode_outer("categories").alias("nth", "category")).join(F.broadcast(hints), "category")
    w = Window.partitionBy("id").orderBy("priority", "nth", "hint")
    out = at.withColumn("before", F.lag("pattern").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("pattern")))
    return out.select("id", (F.row_number().over(w) - 1).alias("at"), "pattern", "priority")


REG.add("merge_layers", _over_layers(lambda t: merge_layers(t.withColumn("layer", N.fragment_type(F.col("layer"))), {"Brand#1": 0.5, "Brand#2": 0.3, "Brand#3": 0.2})), f"WITH {LAYERS}, m AS (SELECT {rules_sql(N.FRAGMENT_RULES, 'lower(layer)', 'Generic')} AS layer, model, avg(price) AS v FROM layers WHERE model IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1, 2) SELECT a.layer, round((0.5::DOUBLE * a.v + 0.3::DOUBLE * b.v + 0.2::DOUBLE * c.v) / (0.5::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE), 6) AS merged FROM m a JOIN m b ON a.layer = b.layer AND a.model = 'Brand#1' AND b.model = 'Brand#2' JOIN m c ON a.layer = c.layer AND c.model = 'Brand#3'", "part")
REG.add("merge_missing", _over_layers(lambda t: missing_layers(t, "Brand#1", ["Brand#2", "Brand#3"])), f"WITH {LAYERS} SELECT m.model, b.layer FROM (SELECT DISTINCT layer FROM layers WHERE model = 'Brand#1') b, (VALUES ('Brand#2'), ('Brand#3')) m(model) WHERE NOT EXISTS (SELECT 1 FROM layers l WHERE l.model = m.model AND l.layer = b.layer)", "part")
REG.add("finetuned_layers", _over_layers(lambda t: with_finetuned(t.where("model = 'Brand#4'"), t.where("model = 'Brand#5'"))), f"WITH {LAYERS} SELECT b.layer, round(coalesce((SELECT avg(price) FROM layers t WHERE t.model = 'Brand#5' AND t.layer = b.layer), avg(b.price)), 6) AS value, EXISTS (SELECT 1 FROM layers t WHERE t.model = 'Brand#5' AND t.layer = b.layer) AS changed FROM layers b WHERE b.model = 'Brand#4' GROUP BY b.layer", "part")


def zones(spark) -> DataFrame:
    return spark.createDataFrame([(p, s, e, x) for p, s, e, x in N.ZONES], "zone_preset string, start double, end double, precision string")


def steps(spark, total: int = STEPS) -> DataFrame:
    """(preset, step, fraction) of each preset's steps; fractions of a few steps are beyond 1."""
    presets = F.explode(F.array(*map(F.lit, dict.fromkeys(z[0] for z in N.ZONES)))).alias("preset")
    return spark.range(total + 3).select(F.col("id").cast("int").alias("step"), presets).withColumn("fraction", F.col("step") / float(total))


_ZONES = values_sql(N.ZONES, "preset", "a", "b", "precision")
STEPS_SQL = f"z AS (SELECT * FROM {_ZONES}), s AS (SELECT DISTINCT preset, CAST(step AS INT) AS step, step / {float(STEPS)}::DOUBLE AS fraction FROM z, range({STEPS + 3}) r(step)), p AS (SELECT s.*, coalesce((SELECT precision FROM z WHERE z.preset = s.preset AND a <= fraction AND fraction < b), 'FP16') AS precision FROM s)"
REG.add("precision_at", lambda region: precision_at(steps(region.sparkSession), zones(region.sparkSession)), f"WITH {STEPS_SQL} SELECT preset, step, fraction, precision FROM p", "region")
_SENSE = ("VeryLow", "Low", "Medium", "High", "Full")
REG.add(
    "layer_profiles",
    _over_layers(lambda t: layer_profiles(t, t.where("id % 50 = 0").groupBy("model", "layer").agg(F.lit("Full").alias("sensitivity")), t.where("id % 30 = 1").groupBy("layer").agg(F.lit("VeryLow").alias("sensitivity")))),
    f"WITH {LAYERS}, m AS (SELECT DISTINCT model, layer FROM layers WHERE id % 50 = 0), l AS (SELECT DISTINCT layer FROM layers WHERE id % 30 = 1) SELECT id, CASE WHEN m.layer IS NOT NULL THEN 'Full' WHEN l.layer IS NOT NULL THEN 'VeryLow' ELSE {lookup_sql(rules_sql(N.FRAGMENT_RULES, 'lower(x.layer)', 'Generic'), {k: v[0] for k, v in N.LAYER_PROFILES.items()}, 'Medium')} END AS sensitivity, CASE WHEN m.layer IS NOT NULL THEN 'model' WHEN l.layer IS NOT NULL THEN 'layer' ELSE 'kind' END AS origin FROM layers x LEFT JOIN m ON m.model = x.model AND m.layer = x.layer LEFT JOIN l ON l.layer = x.layer",
    "part",
)
USAGE = "usage AS (SELECT user_id AS id, count(*) AS loads, count(*) FILTER (event_type IN ('click', 'purchase', 'view')) AS uses, avg(value) / 500 AS contribution, max(ts) AS seen FROM events GROUP BY 1)"
SCORE_SQL = "least(uses / loads::DOUBLE, 1) * 0.4::DOUBLE + least(greatest(contribution, 0), 1) * 0.4::DOUBLE + 1 / (1 + (1735689600 - floor(epoch(seen))) / 86400.0::DOUBLE) * 0.2::DOUBLE"


def usage(events: DataFrame) -> DataFrame:
    """(id, loads, uses, contribution, seen) of the event log: loads are all of a user's events, uses those of some types."""
    return events.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("loads"), F.count_if(F.col("event_type").isin("click", "purchase", "view")).alias("uses"), (F.avg("value") / 500).alias("contribution"), F.max("ts").alias("seen"))


def usage_score(as_of: int = 1_735_689_600) -> Column:
    """NUM9, DATE1: usage ratio, contribution and recency (halved after a day) of a usage row, by fixed weights. ``as_of``: epoch seconds."""
    recency = 1 / (1 + (F.lit(as_of) - F.unix_timestamp("seen")) / 86400.0)
    return F.least(F.col("uses") / F.col("loads"), F.lit(1.0)) * 0.4 + F.least(F.greatest(F.col("contribution"), F.lit(0.0)), F.lit(1.0)) * 0.4 + recency * 0.2


REG.add("usage_importance", lambda events: usage(events).select("id", F.round(usage_score(), 6).alias("importance")), f"WITH {USAGE} SELECT id, round({SCORE_SQL}, 6) AS importance FROM usage", "events")
REG.add("fragment_importance", lambda part, events: with_history(layers(part), usage(events).select("id", usage_score().alias("score"))), f"WITH {USAGE} SELECT p_partkey AS id, round(coalesce({SCORE_SQL}, 0.5), 6) AS importance FROM part LEFT JOIN usage ON p_partkey = usage.id", "part", "events")
HINTS = (("Portrait", 0, "attn.face", 2), ("Portrait", 1, "up_blocks", 1), ("Landscape", 2, "down_blocks", 1), ("Landscape", 3, "up_blocks", 1), ("Anime", 4, "attn.face", 2), ("Object", 5, "mid_block", 3), ("Abstract", 6, "mid_block", 3), ("Mixed", 7, "mid_block", 1), ("Architecture", 8, "down_blocks", 2), ("Fantasy", 9, "up_blocks", 2), ("Photorealistic", 10, "vae", 1))


def categorised(part: DataFrame) -> DataFrame:
    """(id, prompt): prompts made of part names and keywords, so that categories are met; dealt by key first, as the few bytes of a row make one task of a whole file."""
    spark = part.sparkSession
    part = part.select("p_partkey", "p_name").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "p_partkey")
    words = [w for ws in N.PROMPT_KEYWORDS.values() for w in ws]
    pick = lambda k: F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") * k % len(words) + 1).cast("int"))
    return part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 9 > 0, F.concat_ws(" ", "p_name", pick(7), pick(31), pick(5))).otherwise(F.col("p_name")).alias("prompt"))


def with_categories(prompts: DataFrame) -> DataFrame:
    """STR6: (id, categories) of (id, prompt). Ranks are a projection of their own: in one expression they would be counted for each use."""
    return prompts.select("id", N.category_ranks(F.col("prompt")).alias("ranks")).select("id", N.ranked_categories(F.col("ranks")).alias("categories"))


_WORDS = f"[{', '.join(literal(w) for ws in N.PROMPT_KEYWORDS.values() for w in ws)}]"
PROMPTS = "prompts AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 > 0 THEN p_name || ' ' || " + " || ' ' || ".join(f"{_WORDS}[p_partkey * {k} % len({_WORDS}) + 1]" for k in (7, 31, 5)) + " ELSE p_name END AS prompt FROM part)"
_KW = values_sql([(i, c, w) for i, (c, ws) in enumerate(N.PROMPT_KEYWORDS.items()) for w in ws], "nr", "category", "word")
CATEGORIES = f"{PROMPTS}, hit AS (SELECT id, nr, category, count(*) AS n FROM prompts, {_KW} WHERE contains(lower(prompt), word) GROUP BY 1, 2, 3), top AS (SELECT id, category, row_number() OVER (PARTITION BY id ORDER BY n DESC, nr) - 1 AS nth FROM hit QUALIFY nth < 3), cats AS (SELECT * FROM top UNION ALL SELECT id, 'Mixed', 0 FROM prompts WHERE id NOT IN (SELECT id FROM hit))"
REG.add("prompt_categories", lambda part: with_categories(categorised(part)).select("id", F.concat_ws(",", "categories").alias("categories")), f"WITH {CATEGORIES} SELECT id, string_agg(category, ',' ORDER BY nth) AS categories FROM cats GROUP BY 1", "part")
REG.add("category_hints", lambda part: category_hints(with_categories(categorised(part)), part.sparkSession.createDataFrame([(c, h, p, r) for c, h, p, r in HINTS], "category string, hint int, pattern string, priority int")), f"WITH {CATEGORIES}, h AS (SELECT id, pattern, priority, nth, hint, lag(pattern) OVER (PARTITION BY id ORDER BY priority, nth, hint) AS before FROM cats JOIN {values_sql(HINTS, 'hc', 'hint', 'pattern', 'priority')} ON category = hc) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY priority, nth, hint) - 1 AS INT) AS at, pattern, priority FROM h WHERE before IS DISTINCT FROM pattern", "part")


# Names and scores


def name_rules(t: DataFrame) -> DataFrame:
    """STR1-3: kind, sharing, tensor type, method, retention of a base of 0.5, importance and sensitivity by name."""
    kind, tensor = N.fragment_type(F.col("layer")), N.tensor_type(F.col("layer"))
    importance, sense = N.heuristic_importance(F.col("layer"))
    return t.select("id", kind.alias("kind"), N.sharing_potential(kind).alias("sharing"), tensor.alias("tensor"), N.recommended_method(tensor).alias("method"), F.round(N.recommended_retention(tensor, F.lit(0.5)), 6).alias("retention"), importance.alias("importance"), sense.alias("sensitivity"))


_FRAG = rules_sql(N.FRAGMENT_RULES, "n", "Generic")
_TENSOR = f"CASE WHEN contains(n, '.bias') OR ends_with(n, '_bias') THEN 'Bias' ELSE {rules_sql(N.TENSOR_RULES, 'n', 'Unknown')} END"
_IMP = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(n, {literal(p)})' for p in parts)}{' OR ends_with(n, ' + literal('_bias') + ')' if parts == ('.bias',) else ''} THEN {{{i}}}" for i, (_, _, parts) in enumerate(N.IMPORTANCE_RULES)) + " ELSE {d} END"
_IMP_V = _IMP.format(*[literal(v) for v, _, _ in N.IMPORTANCE_RULES], d="0.5::DOUBLE")
_IMP_S = _IMP.format(*[literal(s) for _, s, _ in N.IMPORTANCE_RULES], d="'Medium'")
NAMED = f"named AS (SELECT id, layer, model, n, price, elements, {_FRAG} AS kind, {_TENSOR} AS tensor, {_IMP_V} AS importance, {_IMP_S} AS sensitivity FROM (SELECT *, lower(layer) AS n FROM layers))"
REG.add("name_rules", _over_layers(name_rules), f"WITH {LAYERS}, {NAMED} SELECT id, kind, {lookup_sql('kind', N.SHARING, 0.2)} AS sharing, tensor, CASE WHEN tensor IN ('LayerNorm', 'Bias') THEN 'None' ELSE 'Dct' END AS method, round(CASE tensor WHEN 'LayerNorm' THEN 1 WHEN 'Bias' THEN 1 WHEN 'Embedding' THEN least(0.5 * 1.2, 1) WHEN 'OutputHead' THEN least(0.5 * 1.1, 1) WHEN 'Mlp' THEN greatest(0.5 * 0.9, 0.1) ELSE 0.5 END::DOUBLE, 6) AS retention, importance, sensitivity FROM named", "part")
REG.add("block_importance", _over_layers(lambda t: t.select("id", N.first_digit(F.col("layer")).alias("digit"), F.round(N.block_importance(F.col("layer"), F.lit(0.9), F.lit(1.2)), 6).alias("importance"))), f"WITH {LAYERS}, x AS (SELECT id, lower(layer) AS n, CAST(coalesce(nullif(regexp_extract(layer, '[0-9]'), ''), '0') AS INT) AS digit FROM layers) SELECT id, digit, round(CASE WHEN contains(n, 'vae') AND contains(n, 'decoder') THEN 1 WHEN contains(n, 'attn') AND (contains(n, 'face') OR contains(n, 'portrait')) THEN 0.9 WHEN contains(n, 'up_blocks') THEN (0.5 + least(digit * 0.1, 0.5)) * 1.2 WHEN contains(n, 'down_blocks') THEN 0.8 - least(digit * 0.1, 0.3) WHEN contains(n, 'mid_block') THEN 0.7 ELSE 0.5 END::DOUBLE, 6) AS importance FROM x", "part")


def json_importance(t: DataFrame, text: str) -> DataFrame:
    """JSON1: (id, importance, sensitivity) by a JSON map from layer names; absent fields take their defaults, absent layers the name rules."""
    entries = t.sparkSession.range(1).select(F.explode(F.from_json(F.lit(text), "map<string,struct<importance:double,sensitivity:string>>")).alias("layer", "e"))
    value, sense = N.heuristic_importance(F.col("layer"))
    out = t.join(F.broadcast(entries), "layer", "left")
    return out.select("id", F.when(F.col("e").isNull(), value).otherwise(F.coalesce("e.importance", F.lit(0.5))).alias("importance"), F.when(F.col("e").isNull(), sense).otherwise(N.sensitivity_of(F.coalesce("e.sensitivity", F.lit("")))).alias("sensitivity"))


_JSON = '{"model.layers.11.self_attn.q_proj.weight": {"importance": 0.33, "sensitivity": "verylow"}, "model.layers.28.self_attn.k_proj.weight": {"sensitivity": "critical"}, "model.layers.5.rotary": {"importance": 0.1}, "model.layers.7.monkey": {}}'
REG.add("importance_json", _over_layers(lambda t: json_importance(t, _JSON)), f"WITH {LAYERS}, {NAMED}, j AS (SELECT k, m->k AS e FROM (SELECT '{_JSON}'::JSON AS m, unnest(json_keys('{_JSON}'::JSON)) AS k)) SELECT id, CASE WHEN k IS NULL THEN importance ELSE coalesce(CAST(e->>'importance' AS DOUBLE), 0.5) END AS importance, CASE WHEN k IS NULL THEN sensitivity ELSE {lookup_sql(chr(39).join(['lower(coalesce(e->>', 'sensitivity', ', ', '', '))']), {s: p for p, ss in N.SENSITIVITY_NAMES.items() for s in ss}, 'Medium')} END AS sensitivity FROM named LEFT JOIN j ON layer = k", "part")
_SPELLED = ("int4", "I8", "bfloat16", "Half", "FULL", "f16", "4bit", "F32", "BOOL", "very_low", "Critical", "normal", "odd", "BF16", "I64")
REG.add("enum_names", lambda part: part.select(F.col("p_partkey").alias("id"), F.element_at(F.array(*map(F.lit, _SPELLED)), (F.col("p_partkey") % len(_SPELLED) + 1).cast("int")).alias("s")).select("id", N.precision_of(F.col("s")).alias("precision"), N.sensitivity_of(F.col("s")).alias("sensitivity"), N.dtype_of(F.col("s")).alias("dtype")), f"WITH x AS (SELECT p_partkey AS id, [{', '.join(map(literal, _SPELLED))}][p_partkey % {len(_SPELLED)} + 1] AS s FROM part) SELECT id, {lookup_sql('upper(s)', {s: p for p, ss in N.PRECISION_NAMES.items() for s in ss}, None)} AS precision, {lookup_sql('lower(s)', {s: p for p, ss in N.SENSITIVITY_NAMES.items() for s in ss}, 'Medium')} AS sensitivity, CASE WHEN s IN ({', '.join(map(literal, N.DTYPES))}) THEN s ELSE 'UNKNOWN' END AS dtype FROM x", "part")
REG.add("hex_round_trip", lambda part: part.select(F.col("p_partkey").alias("id"), F.lower(F.hex(F.encode("p_name", "UTF-8"))).alias("hex"), F.decode(F.unhex(F.hex(F.encode("p_name", "UTF-8"))), "UTF-8").alias("back")), "SELECT p_partkey AS id, lower(hex(encode(p_name))) AS hex, p_name AS back FROM part", "part")


def step_quality(step: int, total: int) -> tuple[Column, Column]:
    """NUM1: (quality, importance) of a layer's kind at a step: between the first and the last step's quality, not below the sensitivity's least."""
    kind = N.fragment_type(F.col("layer"))
    field = lambda i: N.looked_up(kind, {k: v[i] for k, v in N.LAYER_PROFILES.items()}, N.LAYER_PROFILES["Generic"][i])
    sense = field(0)
    least, weight = (N.looked_up(sense, {k: v[i] for k, v in N.SENSITIVITIES.items()}) for i in (0, 1))
    quality = least if total == 0 else F.when(field(1), F.greatest(field(2) + (field(3) - field(2)) * (step / total), least)).otherwise(least)
    return quality, quality * weight


def step_importance(step: int, total: int) -> float:
    """NUM2: the weight of a step: falls, but rises again after 70 %."""
    p = step / total if total else 0.0
    return min(1 - p * 0.5 + max(p - 0.7, 0) * 1.5, 1.0) if total else 0.5


def importance_scores(t: DataFrame, history: DataFrame, step: int = STEP, total: int = STEPS) -> DataFrame:
    """NUM2: (id, importance, confidence, load_order): prompt, history, quality and step by fixed weights, in 0.1 to 1."""
    _, quality = step_quality(step, total)
    joined = t.join(history, "id", "left")
    score = N.block_importance(F.col("layer"), F.lit(0.9), F.lit(1.2)) * 0.3 + F.coalesce("score", F.lit(0.5)) * 0.3 + quality * 0.25 + F.lit(step_importance(step, total)) * 0.15
    out = joined.select("id", F.round(F.least(F.greatest(score, F.lit(0.1)), F.lit(1.0)), 9).alias("importance"), F.when(F.col("score").isNotNull(), 0.8).otherwise(0.5).alias("confidence"))
    return out.withColumn("load_order", F.floor((1 - F.col("importance")) * 1000).cast("int"))


def feedback(scores: DataFrame, seen: DataFrame) -> DataFrame:
    """NUM3: (id, adjusted): scores moved by half the mean error of their feedback (id, predicted, actual), in 0 to 1."""
    moved = seen.groupBy("id").agg((F.avg(F.col("actual") - F.col("predicted")) * 0.5).alias("by"))
    return scores.join(moved, "id", "left").select("id", F.round(F.when(F.col("by").isNull(), F.col("score")).otherwise(F.least(F.greatest(F.col("score") + F.col("by"), F.lit(0.0)), F.lit(1.0))), 6).alias("adjusted"))


_P = {i: {k: v[i] for k, v in N.LAYER_PROFILES.items()} for i in range(4)}
PROFILED = f"profiled AS (SELECT *, {lookup_sql('kind', _P[0], 'Medium')} AS sense, {lookup_sql('kind', _P[1], False)} AS adapts, {lookup_sql('kind', _P[2], 0.8)} AS early, {lookup_sql('kind', _P[3], 0.9)} AS late FROM named), q AS (SELECT *, CASE WHEN adapts THEN greatest(early + (late - early) * ({STEP} / {STEPS}.0::DOUBLE), {lookup_sql('sense', {k: v[0] for k, v in N.SENSITIVITIES.items()}, None)}) ELSE {lookup_sql('sense', {k: v[0] for k, v in N.SENSITIVITIES.items()}, None)} END AS quality FROM profiled), qi AS (SELECT *, quality * {lookup_sql('sense', {k: v[1] for k, v in N.SENSITIVITIES.items()}, None)} AS weighted FROM q)"
_BLOCK = "CASE WHEN contains(n, 'vae') AND contains(n, 'decoder') THEN 1 WHEN contains(n, 'attn') AND (contains(n, 'face') OR contains(n, 'portrait')) THEN 0.9 WHEN contains(n, 'up_blocks') THEN (0.5 + least(CAST(coalesce(nullif(regexp_extract(layer, '[0-9]'), ''), '0') AS INT) * 0.1, 0.5)) * 1.2 WHEN contains(n, 'down_blocks') THEN 0.8 - least(CAST(coalesce(nullif(regexp_extract(layer, '[0-9]'), ''), '0') AS INT) * 0.1, 0.3) WHEN contains(n, 'mid_block') THEN 0.7 ELSE 0.5 END::DOUBLE"
REG.add("step_quality", _over_layers(lambda t: t.select("id", F.round(step_quality(STEP, STEPS)[0], 6).alias("quality"), F.round(step_quality(STEP, STEPS)[1], 6).alias("importance"))), f"WITH {LAYERS}, {NAMED}, {PROFILED} SELECT id, round(quality, 6) AS quality, round(weighted, 6) AS importance FROM qi", "part")
REG.add("importance_scores", lambda part, events: importance_scores(layers(part), usage(events).select("id", usage_score().alias("score"))), f"WITH {LAYERS}, {NAMED}, {PROFILED}, {USAGE}, s AS (SELECT qi.id, round(least(greatest({_BLOCK} * 0.3::DOUBLE + coalesce({SCORE_SQL}, 0.5) * 0.3::DOUBLE + weighted * 0.25::DOUBLE + {step_importance(STEP, STEPS)!r}::DOUBLE * 0.15::DOUBLE, 0.1), 1), 9) AS importance, CASE WHEN usage.id IS NOT NULL THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM qi LEFT JOIN usage ON usage.id = qi.id) SELECT *, CAST(floor((1 - importance) * 1000) AS INT) AS load_order FROM s", "part", "events")
REG.add("score_feedback", lambda part, events: feedback(part.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("score")), events.select(F.col("user_id").alias("id"), (F.col("event_id") % 10 / 10.0).alias("predicted"), (F.col("event_id") % 7 / 7.0).alias("actual"))), "WITH f AS (SELECT user_id AS id, avg(event_id % 7 / 7.0::DOUBLE - event_id % 10 / 10.0::DOUBLE) * 0.5 AS moved FROM events GROUP BY 1) SELECT p_partkey AS id, round(CASE WHEN moved IS NULL THEN p_size / 50.0::DOUBLE ELSE least(greatest(p_size / 50.0::DOUBLE + moved, 0), 1) END, 6) AS adjusted FROM part LEFT JOIN f ON p_partkey = f.id", "part", "events")


def effective_retention(importance: Column, sensitivity: Column, base: Column) -> Column:
    """NUM4: a base retention times half plus half the importance and the sensitivity's factor, in 0.1 to 0.95."""
    factor = N.looked_up(sensitivity, N.RETENTION_FACTORS, 1.0)
    return F.least(F.greatest(base * (0.5 + importance * 0.5) * factor, F.lit(0.1)), F.lit(0.95))


def divergence(similarity: Column, total: int = STEPS, least: float = 0.85, mult: float = 0.8, penalty: float = 0.1) -> dict[str, Column]:
    """NUM5: the step at which a cached run diverges, with quality, confidence and saved work; null below the least similarity."""
    ok = similarity >= least
    step = F.greatest(F.least(F.round(F.pow((similarity - least) / (1 - least), F.lit(0.7)) * float(total) * mult), F.lit(float(total - 2))), F.lit(1.0))
    share = step / float(total)
    return {"step": F.when(ok, step.cast("int")), "quality": F.when(ok, F.round(1 - (1 - similarity) * penalty * share, 6)), "confidence": F.when(ok, F.round(similarity * (1 - share * 0.3), 6)), "saved_percent": F.when(ok, F.round(share * 100, 6))}


def quality_curve(k: Column, n: Column, coefficients: tuple[float, ...], least: int) -> Column:
    """NUM6: quality with k of n fragments: a cubic, 0 below the least number, 1 with all."""
    x = k / n.cast("double")
    y = sum((F.lit(c) * F.pow(x, F.lit(float(i))) for i, c in enumerate(coefficients)), F.lit(0.0))
    return F.when(n == 0, 0.0).when(k >= n, 1.0).when(k < least, 0.0).otherwise(F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)))


def fragments_for_quality(target: Column, n: int, coefficients: tuple[float, ...], least: int) -> Column:
    """NUM6, SRC10: the least number of fragments that reaches the target; all of them if none does."""
    enough = F.filter(F.sequence(F.lit(least), F.lit(n)), lambda k: quality_curve(k, F.lit(n), coefficients, least) >= target)
    return F.coalesce(F.array_min(enough), F.lit(n))


# Cubic coefficients of the three encodings.
CURVES = {"spectral": (0.6, 0.3, 0.08, 0.02), "projection": (0.1, 0.8, 0.08, 0.02), "low_rank": (0.3, 0.5, 0.15, 0.05)}


def network_quality(bps: Column, latency_ms: Column, loss: Column) -> Column:
    """NUM7: quality by bandwidth, piecewise linear, times latency and loss factors."""
    b, l = bps.cast("double"), latency_ms.cast("double")  # noqa: E741
    by_band = F.when(b <= 1e6, 0.5).when(b <= 1e7, 0.5 + 0.3 * ((b - 1e6) / 9e6)).when(b <= 1e8, 0.8 + 0.15 * ((b - 1e7) / 9e7)).otherwise(0.95 + 0.05 * F.least((b - 1e8) / 9e8, F.lit(1.0)))
    by_wait = F.when(l <= 20, 1.0).when(l <= 100, 1 - 0.1 * ((l - 20) / 80)).when(l <= 500, 0.9 - 0.2 * ((l - 100) / 400)).otherwise(0.7 - 0.2 * F.least((l - 500) / 500, F.lit(1.0)))
    return by_band * by_wait * (1 - loss)


def retention_class(share: Column) -> Column:
    """NUM11: compressibility by the share of coefficients that holds 95 % of the energy."""
    return F.when(share < 0.10, "High").when(share < 0.30, "Medium").when(share < 0.60, "Low").otherwise("VeryLow")


#: Cosines from which on a grade holds; two scales, of tests and of the pipeline.
GRADES = {"testing": (0.998, 0.993, 0.98, 0.95), "pipeline": (0.999, 0.99, 0.95, 0.90)}


def cosine_grade(cosine: Column, scale: str = "pipeline") -> Column:
    """NUM11, AGG6: the grade of a cosine similarity."""
    a, b, c, d = GRADES[scale]
    return F.when(cosine >= a, "Excellent").when(cosine >= b, "Good").when(cosine >= c, "Acceptable").when(cosine >= d, "Degraded").otherwise("Poor")


REG.add("retention_clamp", _over_layers(lambda t: t.select("id", F.round(effective_retention(*N.heuristic_importance(F.col("layer")), F.lit(0.6)), 6).alias("retention"))), f"WITH {LAYERS}, {NAMED} SELECT id, round(least(greatest(0.6::DOUBLE * (0.5 + importance * 0.5) * {lookup_sql('sensitivity', N.RETENTION_FACTORS, 1.0)}, 0.1), 0.95), 6) AS retention FROM named", "part")
REG.add("divergence_steps", lambda part: part.select(F.col("p_partkey").alias("id"), *[v.alias(k) for k, v in divergence(0.5 + F.col("p_size") / 100.0).items()]), f"WITH s AS (SELECT p_partkey AS id, 0.5 + p_size / 100.0::DOUBLE AS sim FROM part), d AS (SELECT id, sim, greatest(least(round(pow((sim - 0.85::DOUBLE) / (1 - 0.85::DOUBLE), 0.7::DOUBLE) * {STEPS} * 0.8::DOUBLE), {STEPS - 2}), 1) AS step FROM s WHERE sim >= 0.85::DOUBLE) SELECT s.id, CAST(step AS INT) AS step, round(1 - (1 - d.sim) * 0.1::DOUBLE * (step / {STEPS}), 6) AS quality, round(d.sim * (1 - step / {STEPS} * 0.3::DOUBLE), 6) AS confidence, round(step / {STEPS} * 100, 6) AS saved_percent FROM s LEFT JOIN d ON s.id = d.id", "part")
REG.add(
    "quality_curves",
    lambda part: part.select(F.col("p_partkey").alias("id"), *[F.round(quality_curve(F.col("p_size"), F.lit(50), c, 3), 6).alias(k) for k, c in CURVES.items()], *[fragments_for_quality(F.col("p_size") / 50.0, 16, c, 1).alias(f"{k}_needs") for k, c in CURVES.items()]),
    "SELECT p_partkey AS id, " + ", ".join([f"round(CASE WHEN p_size >= 50 THEN 1 WHEN p_size < 3 THEN 0 ELSE least(greatest({c[0]} + {c[1]} * (p_size / 50.0::DOUBLE) + {c[2]} * (p_size / 50.0::DOUBLE) ** 2 + {c[3]} * (p_size / 50.0::DOUBLE) ** 3, 0), 1) END::DOUBLE, 6) AS {k}" for k, c in CURVES.items()] + [f"CAST(coalesce((SELECT min(k) FROM range(1, 17) r(k) WHERE CASE WHEN k = 16 THEN 1 ELSE {c[0]} + {c[1]} * (k / 16.0::DOUBLE) + {c[2]} * (k / 16.0::DOUBLE) ** 2 + {c[3]} * (k / 16.0::DOUBLE) ** 3 END >= p_size / 50.0::DOUBLE), 16) AS INT) AS {k}_needs" for k, c in CURVES.items()]) + " FROM part",
    "part",
)
REG.add("network_quality", lambda orders: orders.select("o_orderkey", F.round(network_quality(F.col("o_totalprice") * 1000, F.col("o_orderkey") % 900, F.col("o_orderkey") % 10 / 100.0), 6).alias("quality")), "WITH x AS (SELECT o_orderkey, o_totalprice * 1000 AS b, (o_orderkey % 900)::DOUBLE AS l, o_orderkey % 10 / 100.0::DOUBLE AS loss FROM orders) SELECT o_orderkey, round(CASE WHEN b <= 1e6 THEN 0.5 WHEN b <= 1e7 THEN 0.5 + 0.3 * ((b - 1e6) / 9e6) WHEN b <= 1e8 THEN 0.8 + 0.15 * ((b - 1e7) / 9e7) ELSE 0.95 + 0.05 * least((b - 1e8) / 9e8, 1) END * CASE WHEN l <= 20 THEN 1 WHEN l <= 100 THEN 1 - 0.1 * ((l - 20) / 80) WHEN l <= 500 THEN 0.9 - 0.2 * ((l - 100) / 400) ELSE 0.7 - 0.2 * least((l - 500) / 500, 1) END * (1 - loss), 6) AS quality FROM x", "orders")
REG.add("pipeline_shape", lambda part: part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 17 == 0, 1.0).otherwise(F.round((F.col("p_size") - 1) / (F.col("p_partkey") % 17).cast("double"), 6)).alias("bubble"), F.greatest(F.ceil(F.col("p_partkey") / (4.0 * F.col("p_size"))), F.lit(1)).alias("micro_batch")), "SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN 1 ELSE round((p_size - 1) / (p_partkey % 17)::DOUBLE, 6) END::DOUBLE AS bubble, CAST(greatest(ceil(p_partkey / (4.0::DOUBLE * p_size)), 1) AS BIGINT) AS micro_batch FROM part", "part")


def hardware(devices: DataFrame, params_b: float = 7.0, context: int = 2048) -> DataFrame:
    """NUM10: per device (id, memory_gb, bandwidth, bits array): precision by the lowest it has, tokens a second, batch from what memory is left, whether the model fits."""
    has = lambda c: F.array_contains("can", c)
    precision = F.when(has("int4"), "int4").when(has("int8"), "int8").when(has("fp16"), "fp16").otherwise("fp32")
    width = N.looked_up(precision, {"int4": 0.5, "int8": 1.0, "fp16": 2.0, "fp32": 4.0})
    speed = F.col("bandwidth") / (params_b * N.looked_up(precision, {"int4": 0.5, "int8": 1.0}, 2.0))
    left = F.col("memory_gb") * 0.8 - params_b * width
    tokens = F.greatest(F.floor(left / (params_b * 0.1 * width) * 1073741824.0), F.lit(0))
    batch = F.least(F.greatest(F.floor(tokens / context), F.lit(1)), F.lit(32)).cast("int")
    return devices.select("id", precision.alias("precision"), F.round(speed, 6).alias("tokens_per_s"), batch.alias("batch"), (left >= 0).alias("fits"))


REG.add("hardware_plan", lambda supplier: hardware(supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") + 1.0).alias("memory_gb"), (F.abs("s_acctbal") / 10 + 1).alias("bandwidth"), F.filter(F.array(*[F.when(F.col("s_suppkey") % m == 0, c) for c, m in (("int4", 4), ("int8", 3), ("fp16", 2))]), lambda x: x.isNotNull()).alias("can"))), "WITH d AS (SELECT s_suppkey AS id, s_nationkey + 1.0::DOUBLE AS mem, abs(s_acctbal) / 10 + 1 AS bw, CASE WHEN s_suppkey % 4 = 0 THEN 'int4' WHEN s_suppkey % 3 = 0 THEN 'int8' WHEN s_suppkey % 2 = 0 THEN 'fp16' ELSE 'fp32' END AS p FROM supplier), e AS (SELECT *, CASE p WHEN 'int4' THEN 0.5 WHEN 'int8' THEN 1 WHEN 'fp16' THEN 2 ELSE 4 END::DOUBLE AS w FROM d) SELECT id, p AS precision, round(bw / (7.0::DOUBLE * least(w, 2)), 6) AS tokens_per_s, CAST(least(greatest(floor(greatest(floor((mem * 0.8::DOUBLE - 7.0 * w) / (7.0::DOUBLE * 0.1::DOUBLE * w) * 1073741824), 0) / 2048), 1), 32) AS INT) AS batch, mem * 0.8::DOUBLE - 7.0 * w >= 0 AS fits FROM e", "supplier")
REG.add("grades", lambda part: part.select(F.col("p_partkey").alias("id"), *[cosine_grade(0.89 + F.col("p_partkey") % 111 / 1000.0, s).alias(s) for s in GRADES], retention_class(F.col("p_size") / 50.0).alias("compressibility")), "SELECT p_partkey AS id, " + ", ".join("CASE " + " ".join(f"WHEN 0.89::DOUBLE + p_partkey % 111 / 1000.0::DOUBLE >= {t}::DOUBLE THEN '{g}'" for t, g in zip(ts, ("Excellent", "Good", "Acceptable", "Degraded"))) + f" ELSE 'Poor' END AS {s}" for s, ts in GRADES.items()) + ", CASE WHEN p_size / 50.0::DOUBLE < 0.1::DOUBLE THEN 'High' WHEN p_size / 50.0::DOUBLE < 0.3::DOUBLE THEN 'Medium' WHEN p_size / 50.0::DOUBLE < 0.6::DOUBLE THEN 'Low' ELSE 'VeryLow' END AS compressibility FROM part", "part")


# Totals


def library_stats(refs: DataFrame) -> DataFrame:
    """AGG4: one row: fragments, bytes, shared fragments, references per shared one, mean size; of (content, size) with a row per reference."""
    g = refs.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    shared = F.count_if(F.col("n") > 1)
    return g.agg(F.count(F.lit(1)).alias("fragments"), F.sum("size").alias("storage"), shared.alias("shared"), F.coalesce(F.round(F.avg(F.when(F.col("n") > 1, F.col("n"))), 6), F.lit(0.0)).alias("refs_per_shared"), F.floor(F.sum("size") / F.count(F.lit(1))).alias("mean_size"), F.sum((F.col("n") - 1) * F.col("size")).alias("saved"))


def manifest_ratios(t: DataFrame) -> DataFrame:
    """AGG29: per model: 1 - saved / total, and compressed / total; 1 where the total is 0."""
    total = F.sum("elements")
    safe = lambda x: F.when(total == 0, 1.0).otherwise(F.round(x, 6))
    return t.groupBy("model").agg(total.alias("total"), safe(1 - F.sum(F.when(F.col("quality") < 50, F.col("elements")).otherwise(0)) / total).alias("dedup_ratio"), safe(F.sum(F.floor(F.col("elements") * F.col("quality") / 100)) / total).alias("compression_ratio"))


def encoder_stats(t: DataFrame) -> DataFrame:
    """AGG30: per method and tensor type: tensors, elements, kept elements and their ratio (0 if none is kept)."""
    tensor = N.tensor_type(F.col("layer"))
    kept = F.floor(F.col("elements") * N.recommended_retention(tensor, F.lit(0.5)) + 1e-9)
    g = t.groupBy(N.recommended_method(tensor).alias("method"), tensor.alias("tensor")).agg(F.count(F.lit(1)).alias("tensors"), F.sum("elements").alias("elements"), F.sum(kept).alias("kept"))
    return g.withColumn("ratio", F.when(F.col("kept") == 0, 0.0).otherwise(F.round(F.col("elements") / F.col("kept"), 6)))


def profile_estimates(zones: DataFrame) -> DataFrame:
    """AGG27: per preset: memory relative to FP32, weighted by width, and quality, weighted towards later steps."""
    bits, quality = (N.looked_up(F.col("precision"), {k: v[i] for k, v in N.PRECISIONS.items()}) for i in (0, 2))
    width = F.col("end") - F.col("start")
    late = width * (0.5 + F.col("start") * 0.5)
    return zones.groupBy(F.col("zone_preset").alias("preset")).agg(F.round(F.sum(width * bits / 32.0) / F.sum(width), 6).alias("vram"), F.round(F.sum(late * quality) / F.sum(late), 6).alias("quality"))


def precision_distribution(scheduled: DataFrame) -> DataFrame:
    """AGG17: per preset and precision: steps and their share."""
    g = scheduled.groupBy("preset", "precision").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("preset")), 6))


def distinct_refs(t: DataFrame) -> DataFrame:
    """SET3: (model, id): the distinct kinds a model's layers refer to, numbered in order of first sight."""
    first = t.groupBy("model", N.fragment_type(F.col("layer")).alias("kind")).agg(F.min("id").alias("seen"))
    return first.select("model", "kind", (F.row_number().over(Window.partitionBy("model").orderBy("seen")) - 1).alias("at"))


def distinct_refs_nested(manifest: DataFrame) -> DataFrame:
    """SET3 over a nested manifest with ``layers`` array<struct<refs array<struct<id>>>>: distinct ids in order of first sight."""
    return manifest.withColumn("ids", F.array_distinct(F.flatten(F.transform("layers", lambda x: F.transform(x["refs"], lambda r: r["id"])))))


def collect_garbage(fragments: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SET4: (fragments that some row of ``refs`` (id) still names, one row with the number and bytes of those removed)."""
    live = fragments.join(refs.select("id").distinct(), "id", "left_semi")
    gone = fragments.join(refs.select("id").distinct(), "id", "left_anti")
    return live, gone.agg(F.count(F.lit(1)).alias("removed"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_freed"))


def change_models(fragments: DataFrame, added: Column, removed: Column) -> DataFrame:
    """SET5: ``models`` with some added (once each) and some removed."""
    return fragments.withColumn("models", F.array_sort(F.array_except(F.array_union("models", added), removed)))


_CONTENT = "SELECT p_name || ':' || p_size AS content, p_size * 10 AS size FROM part"
REG.add("library_stats", lambda part: library_stats(part.select(F.concat_ws(":", "p_name", "p_size").alias("content"), (F.col("p_size") * 10).cast("long").alias("size"))), f"WITH g AS (SELECT content, count(*) AS n, max(size) AS size FROM ({_CONTENT}) GROUP BY 1) SELECT count(*) AS fragments, CAST(sum(size) AS BIGINT) AS storage, count(*) FILTER (n > 1) AS shared, coalesce(round(avg(n) FILTER (n > 1), 6), 0) AS refs_per_shared, CAST(floor(sum(size) / count(*)) AS BIGINT) AS mean_size, CAST(sum((n - 1) * size) AS BIGINT) AS saved FROM g", "part")
REG.add("manifest_ratios", _over_layers(manifest_ratios), f"WITH {LAYERS} SELECT model, CAST(sum(elements) AS BIGINT) AS total, round(1 - sum(CASE WHEN quality < 50 THEN elements ELSE 0 END) / sum(elements), 6) AS dedup_ratio, round(sum(elements * quality // 100) / sum(elements), 6) AS compression_ratio FROM layers GROUP BY 1", "part")
REG.add("encoder_stats", _over_layers(encoder_stats), f"WITH {LAYERS}, {NAMED}, k AS (SELECT tensor, elements, floor(elements * CASE tensor WHEN 'LayerNorm' THEN 1 WHEN 'Bias' THEN 1 WHEN 'Embedding' THEN 0.6 WHEN 'OutputHead' THEN 0.55 WHEN 'Mlp' THEN 0.45 ELSE 0.5 END + 1e-9) AS kept FROM named) SELECT CASE WHEN tensor IN ('LayerNorm', 'Bias') THEN 'None' ELSE 'Dct' END AS method, tensor, count(*) AS tensors, CAST(sum(elements) AS BIGINT) AS elements, CAST(sum(kept) AS BIGINT) AS kept, round(sum(elements) / sum(kept), 6) AS ratio FROM k GROUP BY 1, 2", "part")
_PREC = {i: {k: float(v[i]) for k, v in N.PRECISIONS.items()} for i in (0, 2)}
REG.add("profile_estimates", lambda region: profile_estimates(zones(region.sparkSession)), f"SELECT preset, round(sum((b - a) * {lookup_sql('precision', _PREC[0], None)} / 32) / sum(b - a), 6) AS vram, round(sum((b - a) * (0.5 + a * 0.5) * {lookup_sql('precision', _PREC[2], None)}) / sum((b - a) * (0.5 + a * 0.5)), 6) AS quality FROM {_ZONES} GROUP BY 1", "region")
REG.add("precision_distribution", lambda region: precision_distribution(precision_at(steps(region.sparkSession), zones(region.sparkSession))), f"WITH {STEPS_SQL} SELECT preset, precision, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY preset), 6) AS share FROM p GROUP BY 1, 2", "region")
REG.add("manifest_kinds", _over_layers(distinct_refs), f"WITH {LAYERS}, {NAMED}, f AS (SELECT model, kind, min(id) AS seen FROM named GROUP BY 1, 2) SELECT model, kind, CAST(row_number() OVER (PARTITION BY model ORDER BY seen) - 1 AS INT) AS at FROM f", "part")
REG.add("garbage_collect", lambda part, lineitem: collect_garbage(part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("size")), lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("id")))[1], "SELECT count(*) AS removed, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS bytes_freed FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", "part", "lineitem")
REG.add("model_refs", lambda part: change_models(part.select(F.col("p_partkey").alias("id"), F.array("p_brand", F.lit("Brand#1")).alias("models")), F.array(F.lit("Brand#2"), F.lit("Brand#9")), F.array(F.lit("Brand#1"))).select("id", F.concat_ws(",", "models").alias("models")), "SELECT p_partkey AS id, array_to_string(list_sort(list_filter(list_distinct([p_brand, 'Brand#1', 'Brand#2', 'Brand#9']), lambda x: x <> 'Brand#1')), ',') AS models FROM part", "part")
REG.add("layers_by_priority", _over_layers(lambda t: t.groupBy("layer").agg(F.min("quality").alias("priority")).select("layer", "priority", F.row_number().over(Window.partitionBy("priority").orderBy("layer")).alias("at"))), f"WITH {LAYERS} SELECT layer, min(quality) AS priority, CAST(row_number() OVER (PARTITION BY min(quality) ORDER BY layer) AS INT) AS at FROM layers GROUP BY layer", "part")

QUERIES, ORACLE_SQL = REG.queries, REG.sql
