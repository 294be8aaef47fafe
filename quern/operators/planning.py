"""Partition plans, topologies and paths, reductions over ranks, previews, messages, schedules and look-alike signatures of prompts.

Graphs of nodes are edge tables; distances come from level-by-level joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.plans.registry import Registry
from quern.session import share_code

REG = Registry()

# Partitions


def ranges(size: int, world: int) -> list[tuple[int, int]]:
    """D1, ARR9: [start, end) of each rank; ranks beyond the last chunk have empty ranges."""
    step = -(-size // world)
    return [(min(i * step, size), min((i + 1) * step, size)) for i in range(world)]


def partition_plan(spark: SparkSession, strategy: str, workers: int, layers: int, **sizes: int) -> DataFrame:
    """(worker, start, end): layers (or experts) of each worker by strategy: tensor, pipeline, expert or hybrid."""
    if strategy == "tensor":
        rows = [(0, layers)] * min(sizes["world"], workers)
    elif strategy == "pipeline":
        rows = ranges(layers, min(sizes["stages"], workers))
    elif strategy == "expert":
        n = sizes["groups"] * sizes["experts"]
        rows = ranges(n, workers)[: min(workers, n)]
    elif strategy == "hybrid":
        rows = [r for r in ranges(layers, sizes["pp"]) for _ in range(sizes["tp"])][:workers]
    else:
        raise ValueError(f"no strategy {strategy!r}")
    return spark.createDataFrame([(strategy, i, a, b) for i, (a, b) in enumerate(rows)], "strategy string, worker int, start int, end int")


def partition_plans(region: DataFrame) -> DataFrame:
    s = region.sparkSession
    out = partition_plan(s, "tensor", 4, 30, world=8)
    for more in (partition_plan(s, "pipeline", 8, 30, stages=7), partition_plan(s, "expert", 6, 30, groups=4, experts=5), partition_plan(s, "hybrid", 8, 30, tp=2, pp=4)):
        out = out.union(more)
    return out


_CHUNK = "SELECT '{0}' AS strategy, {1} AS worker, least({2} * {3}, {4}) AS a, least(({2} + 1) * {3}, {4}) AS b FROM range({5}) r(i)"
REG.add("partition_plans", partition_plans, "WITH p AS (SELECT 'tensor' AS strategy, i AS worker, 0 AS a, 30 AS b FROM range(4) r(i) UNION ALL " + " UNION ALL ".join([_CHUNK.format("pipeline", "i", "i", 5, 30, 7), _CHUNK.format("expert", "i", "i", 4, 20, 6), _CHUNK.format("hybrid", "i", "(i // 2)", 8, 30, 8)]) + ") SELECT strategy, CAST(worker AS INT) AS worker, CAST(a AS INT) AS start, CAST(b AS INT) AS \"end\" FROM p", "region")


def split_rows(v: Column, cols: int, world: int, rank: int) -> Column:
    """ARR9: the rows of a flat tensor that a rank holds."""
    rows = F.floor(F.size(v) / cols)
    per = F.ceil(rows / world)
    return F.slice(v, (rank * per * cols + 1).cast("int"), F.greatest(F.least((rank + 1) * per, rows) * cols - rank * per * cols, F.lit(0)).cast("int"))


def split_columns(v: Column, cols: int, world: int, rank: int) -> Column:
    """ARR9: the columns of a flat tensor that a rank holds."""
    per = -(-cols // world)
    return F.filter(v, lambda _, i: (i % cols >= rank * per) & (i % cols < min((rank + 1) * per, cols)))


def shards_of(vectors: DataFrame, cols: int = 8, world: int = 3) -> DataFrame:
    """ARR9: (vec_id, rank, n_rows, n_columns, by_rows, by_columns): sizes and sums of each rank's part."""
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 5)
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = None
    for rank in range(world):
        a, b = split_rows(F.col("v"), cols, world, rank), split_columns(F.col("v"), cols, world, rank)
        part = v.select("vec_id", F.lit(rank).alias("rank"), F.size(a).alias("n_rows"), F.size(b).alias("n_columns"), total(a).alias("by_rows"), total(b).alias("by_columns"))
        out = part if out is None else out.union(part)
    return out


_L = "l AS (SELECT vec_id, label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings)"
REG.add("tensor_shards", shards_of, f"WITH {_L} SELECT vec_id, CAST(rank AS INT) AS rank, CAST(count(*) FILTER (pos // 8 // 3 = rank) AS INT) AS n_rows, CAST(count(*) FILTER (pos % 8 // 3 = rank) AS INT) AS n_columns, round(coalesce(sum(v) FILTER (pos // 8 // 3 = rank), 0), 5) AS by_rows, round(coalesce(sum(v) FILTER (pos % 8 // 3 = rank), 0), 5) AS by_columns FROM l, range(3) r(rank) GROUP BY 1, 2", "embeddings")


def all_reduce(vectors: DataFrame) -> DataFrame:
    """AGG31: per place the sum, mean, greatest and least over ranks; a label's mean vector is a rank."""
    long = vectors.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("v"))
    return long.groupBy("pos").agg(F.round(F.sum("v"), 6).alias("sum"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v"), 6).alias("most"), F.round(F.min("v"), 6).alias("least"))


REG.add("all_reduce", all_reduce, f"WITH {_L}, m AS (SELECT label, pos, avg(v) AS v FROM l GROUP BY 1, 2) SELECT CAST(pos AS INT) AS pos, round(sum(v), 6) AS sum, round(avg(v), 6) AS mean, round(max(v), 6) AS most, round(min(v), 6) AS least FROM m GROUP BY 1", "embeddings")

# Topologies


def edges(spark: SparkSession, kind: str, n: int) -> DataFrame:
    """(a, b) both ways: ring, mesh (about square), full, tree (binary, root 0) or hierarchical (rings of four, leaders linked to each other)."""
    i = spark.range(n).select(F.col("id").cast("int").alias("a"))
    side = int(np.ceil(np.sqrt(n)))
    if kind == "ring":
        out = i.select("a", ((F.col("a") + 1) % n).alias("b"))
    elif kind == "mesh":
        right = i.where((F.col("a") % side < side - 1) & (F.col("a") + 1 < n)).select("a", (F.col("a") + 1).alias("b"))
        out = right.union(i.where(F.col("a") + side < n).select("a", (F.col("a") + side).alias("b")))
    elif kind == "full":
        out = i.select("a", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    elif kind == "tree":
        out = i.where("a > 0").select("a", F.floor((F.col("a") - 1) / 2).cast("int").alias("b"))
    elif kind == "hierarchical":
        start = F.floor(F.col("a") / 4).cast("int") * 4
        size = F.least(start + 4, F.lit(n)) - start
        inner = i.select("a", (start + (F.col("a") - start + 1) % size).alias("b"))
        leaders = i.where("a % 4 = 0").select("a", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(4))).alias("b"))
        out = inner.union(leaders)
    else:
        raise ValueError(f"no topology {kind!r}")
    out = out.where("a <> b")
    return out.union(out.select("b", "a")).distinct()


def distances(links: DataFrame, starts: DataFrame, most: int = 64) -> DataFrame:
    """JOIN14: (start, node, hops): fewest hops from each start (start) along links (a, b), level by level; nodes out of reach are absent. An action a level; ``most`` levels at most."""
    from quern.sources.containers import stored

    reached = stored(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")), "hops")
    newest = reached
    for level in range(1, most + 1):
        ahead = newest.join(links, newest["node"] == links["a"]).select("start", F.col("b").alias("node"), F.lit(level).alias("hops")).distinct()
        newest = stored(ahead.join(reached, ["start", "node"], "left_anti"), "hops")
        if newest.isEmpty():
            return reached
        reached = stored(reached.union(newest.select("start", "node", "hops")), "hops")
    raise RuntimeError(f"paths of more than {most} hops")


def shape_of(links: DataFrame, n: int) -> DataFrame:
    """JOIN14: one row: diameter (longest of all shortest paths), whether all of the n nodes are linked, and the number of links."""
    starts = links.sparkSession.range(n).select(F.col("id").cast("int").alias("start"))
    return distances(links, starts).agg(F.max("hops").alias("diameter"), (F.count(F.lit(1)) == n * n).alias("connected"))


def topologies(region: DataFrame, n: int = 11) -> DataFrame:
    """D4, JOIN14: (kind, links, diameter, connected) of each topology over n nodes; one graph of all kinds, so that levels are walked together."""
    from quern.sources.containers import stored

    spark, links = region.sparkSession, None
    for kind in ("ring", "mesh", "full", "tree", "hierarchical"):
        named = edges(spark, kind, n).select(*[F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")).alias(c) for c in "ab"])
        links = named if links is None else links.union(named)
    links = stored(links, "links")
    kind = F.substring_index("start", ":", 1).alias("kind")
    far = distances(links, links.select(F.col("a").alias("start")).distinct()).groupBy(kind).agg(F.max("hops").alias("diameter"), (F.count(F.lit(1)) == n * n).alias("connected"))
    count = links.groupBy(F.substring_index("a", ":", 1).alias("kind")).agg((F.count(F.lit(1)) / 2).cast("int").alias("links"))
    return far.join(count, "kind").select("kind", "links", "diameter", "connected")


def node_distances(region: DataFrame, n: int = 11) -> DataFrame:
    """(a, b, ring, manhattan): distances by formula on a ring and on a mesh."""
    side = int(np.ceil(np.sqrt(n)))
    p = region.sparkSession.range(n).select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"))
    far = lambda x: F.floor(x / side)
    return p.select("a", "b", F.least((F.col("b") + n - F.col("a")) % n, (F.col("a") + n - F.col("b")) % n).alias("ring"), (F.abs(far(F.col("a")) - far(F.col("b"))) + F.abs(F.col("a") % side - F.col("b") % side)).cast("int").alias("manhattan"))


_E = "n AS (SELECT i FROM range(11) r(i)), e0 AS (SELECT 'ring' AS kind, i AS a, (i + 1) % 11 AS b FROM n UNION ALL SELECT 'mesh', i, i + 1 FROM n WHERE i % 4 < 3 AND i + 1 < 11 UNION ALL SELECT 'mesh', i, i + 4 FROM n WHERE i + 4 < 11 UNION ALL SELECT 'full', x.i, y.i FROM n x, n y UNION ALL SELECT 'tree', i, (i - 1) // 2 FROM n WHERE i > 0 UNION ALL SELECT 'hierarchical', i, i // 4 * 4 + (i % 4 + 1) % (least(i // 4 * 4 + 4, 11) - i // 4 * 4) FROM n UNION ALL SELECT 'hierarchical', x.i, y.i FROM n x, n y WHERE x.i % 4 = 0 AND y.i % 4 = 0), e AS (SELECT DISTINCT kind, a, b FROM (SELECT kind, a, b FROM e0 UNION ALL SELECT kind, b, a FROM e0) WHERE a <> b)"
REG.add("topologies", topologies, f"WITH RECURSIVE {_E}, d AS (SELECT DISTINCT kind, i AS s, i AS v, 0 AS h FROM n, (SELECT DISTINCT kind FROM e) k UNION SELECT d.kind, s, e.b, h + 1 FROM d JOIN e ON d.kind = e.kind AND d.v = e.a WHERE h < 10), m AS (SELECT kind, s, v, min(h) AS h FROM d GROUP BY 1, 2, 3) SELECT kind, CAST((SELECT count(*) // 2 FROM e WHERE e.kind = m.kind) AS INT) AS links, max(h) AS diameter, count(*) = 121 AS connected FROM m GROUP BY kind", "region")
REG.add("node_distances", node_distances, "SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(least((b + 11 - a) % 11, (a + 11 - b) % 11) AS INT) AS ring, CAST(abs(a // 4 - b // 4) + abs(a % 4 - b % 4) AS INT) AS manhattan FROM range(11) x(a), range(11) y(b)", "region")

# Previews, messages and schedules. Progress from which on a quality holds, milliseconds to make one.
QUALITY_FROM = ((0.0, "Thumbnail"), (0.3, "Low"), (0.6, "Medium"), (0.9, "Full"))
DECODE_MS = {"Thumbnail": 5, "Low": 20, "Medium": 50, "Full": 150}


def previews(spark: SparkSession, total: int = 30, interval: int = 4, fixed: tuple[int, ...] | None = None) -> DataFrame:
    """STM7: (mode, step, quality, priority): steps at which a preview is shown by mode; the last one has full quality. Fixed steps are the ends and the quarters unless given."""
    fixed = fixed or (0, total // 4, total // 2, 3 * total // 4, total)
    s = spark.range(total + 1).select(F.col("id").cast("int").alias("step"))
    p, last = F.col("step") / float(total), F.col("step") == total
    every = F.when(p < 0.2, 2).when(p < 0.7, 5).otherwise(3)
    shown = {"every": F.lit(True), "interval": (F.col("step") % interval == 0) | last, "fixed": F.col("step").isin(*fixed), "adaptive": (F.col("step") % every == 0) | last, "thumbnail": F.lit(True), "final": last}
    modes = F.explode(F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in shown.items()]), lambda m: m.isNotNull())).alias("mode")
    quality = F.lit("Thumbnail")
    for start, name in QUALITY_FROM:
        quality = F.when(p >= start, name).otherwise(quality)
    quality = F.when(last, "Full").when(F.col("mode") == "thumbnail", "Thumbnail").otherwise(quality)
    return s.select("step", modes).select("mode", "step", quality.alias("quality"), F.when(last, 255).otherwise(F.floor(p * 200)).cast("int").alias("priority"))


def preview_summary(p: DataFrame, total: int = 30) -> DataFrame:
    """STM7: per mode: previews, mean distance between them, and how many are of full quality, and the time they take as a percentage of steps of 100 ms."""
    from quern.functions.names import looked_up

    n = F.count(F.lit(1))
    return p.groupBy("mode").agg(n.alias("previews"), F.round(F.when(n > 1, total / (n - 1)).otherwise(float(total)), 6).alias("interval"), F.count_if(F.col("quality") == "Full").alias("full"), F.round(F.sum(looked_up(F.col("quality"), DECODE_MS)) / (total * 100) * 100, 6).alias("overhead"))


_PV = "s AS (SELECT step, step / 30.0::DOUBLE AS p FROM range(31) r(step)), v AS (SELECT mode, step, p FROM s, (VALUES ('every'), ('interval'), ('fixed'), ('adaptive'), ('thumbnail'), ('final')) m(mode) WHERE CASE mode WHEN 'interval' THEN step % 4 = 0 OR step = 30 WHEN 'fixed' THEN step IN (0, 7, 15, 22, 30) WHEN 'adaptive' THEN step % CASE WHEN p < 0.2 THEN 2 WHEN p < 0.7 THEN 5 ELSE 3 END = 0 OR step = 30 WHEN 'final' THEN step = 30 ELSE TRUE END), pv AS (SELECT mode, CAST(step AS INT) AS step, CASE WHEN step = 30 THEN 'Full' WHEN mode = 'thumbnail' THEN 'Thumbnail' WHEN p >= 0.9 THEN 'Full' WHEN p >= 0.6 THEN 'Medium' WHEN p >= 0.3 THEN 'Low' ELSE 'Thumbnail' END AS quality, CAST(CASE WHEN step = 30 THEN 255 ELSE floor(p * 200) END AS INT) AS priority FROM v)"
REG.add("preview_schedule", lambda r: previews(r.sparkSession), f"WITH {_PV} SELECT * FROM pv", "region")
REG.add("preview_summary", lambda r: preview_summary(previews(r.sparkSession)), f"WITH {_PV} SELECT mode, count(*) AS previews, round(CASE WHEN count(*) > 1 THEN 30 / (count(*) - 1) ELSE 30 END, 6) AS interval, count(*) FILTER (quality = 'Full') AS full, round(sum(CASE quality WHEN 'Thumbnail' THEN 5 WHEN 'Low' THEN 20 WHEN 'Medium' THEN 50 ELSE 150 END) / 3000 * 100, 6) AS overhead FROM pv GROUP BY 1", "region")


def messages(turns: DataFrame) -> DataFrame:
    """STM9: (conv_id, text): turns as messages in JSON with a sequence number per conversation."""
    return turns.select("conv_id", F.to_json(F.struct(F.col("turn").alias("sequence"), F.col("role").alias("kind"), F.md5(F.coalesce("text", F.lit(""))).alias("payload"))).alias("text"))


def parsed_messages(texts: DataFrame) -> DataFrame:
    """STM9: messages read back, with the number of messages missing before each: (conv_id, sequence, kind, payload, missing)."""
    m = texts.select("conv_id", F.from_json("text", "sequence long, kind string, payload string").alias("m")).select("conv_id", "m.*")
    w = Window.partitionBy("conv_id").orderBy("sequence")
    return m.withColumn("missing", F.col("sequence") - F.coalesce(F.lag("sequence").over(w), F.lit(-1)) - 1)


REG.add("stream_messages", lambda c: parsed_messages(messages(c.where("(conv_id + turn) % 5 > 0"))), "SELECT conv_id, turn AS sequence, role AS kind, md5(coalesce(text, '')) AS payload, turn - coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) - 1 AS missing FROM conversations WHERE (conv_id + turn) % 5 > 0", "conversations")


def waves(requests: DataFrame, at_once: int = 4, queue: int = 20) -> DataFrame:
    """STM13: per pool: requests in order of arrival run ``at_once`` a wave; those beyond the queue are dropped: (event_id, wave, dropped)."""
    nth = F.row_number().over(Window.partitionBy("pool").orderBy("ts", "event_id")) - 1
    r = requests.withColumn("nth", nth)
    kept = F.col("nth") < at_once + queue
    return r.select("event_id", F.when(kept, F.floor(F.col("nth") / at_once)).alias("wave"), (~kept).alias("dropped"))


REG.add("transfer_waves", lambda e: waves(e.withColumn("pool", F.col("user_id"))), "WITH n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) SELECT event_id, CASE WHEN n < 24 THEN n // 4 END AS wave, n >= 24 AS dropped FROM n", "events")


def latent_pixels(v: np.ndarray, width: int, height: int) -> np.ndarray:
    """STM8: a small latent as (height, width, 4) bytes: values -1 to 1 as intensity, repeated as often as needed."""
    i = np.clip((np.resize(v, width * height) + 1) * 0.5 * 255, 0, 255).astype(np.uint8).astype(float)
    return np.stack([i, np.floor(i * 0.9), np.floor(i * 0.8), np.full(len(i), 255)], axis=1).reshape(height, width, 4).astype(np.uint8)


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """STM8: bilinear, cut off to whole numbers."""
    h, w = pixels.shape[:2]
    x, y = np.arange(width) / width * w, np.arange(height) / height * h
    x0, x1 = np.minimum(np.floor(x).astype(int), w - 1), np.minimum(np.ceil(x).astype(int), w - 1)
    y0, y1 = np.minimum(np.floor(y).astype(int), h - 1), np.minimum(np.ceil(y).astype(int), h - 1)
    fx, fy = (x - np.floor(x))[None, :, None], (y - np.floor(y))[:, None, None]
    p = pixels.astype(float)
    top, low = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx, p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return (top * (1 - fy) + low * fy).astype(np.uint8)


def latent_previews(vectors: DataFrame) -> DataFrame:
    """STM8: (vec_id, red, shades, resized): sums of a preview of 8 by 8, and of the same at 16 by 16."""
    share_code(vectors.sparkSession)

    @F.pandas_udf("red long, green long, resized long")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for vs in batches:
            rows = []
            for v in vs:
                p = latent_pixels(np.asarray(v, float), 8, 8)
                rows.append((int(p[..., 0].sum(dtype=int)), int(p[..., 1].sum(dtype=int)), int(resized(p, 16, 16)[..., 0].sum(dtype=int))))
            yield pd.DataFrame(rows, columns=["red", "green", "resized"])

    return vectors.select("vec_id", each("embedding").alias("p")).select("vec_id", "p.red", "p.green")


REG.add("latent_previews", latent_previews, f"WITH {_L}, i AS (SELECT vec_id, CAST(floor(least(greatest((v + 1) * 0.5 * 255, 0), 255)) AS INT) AS i FROM l) SELECT vec_id, CAST(sum(i) AS BIGINT) AS red, CAST(sum(i * 9 // 10) AS BIGINT) AS green FROM i GROUP BY 1", "embeddings")

# User functions: providers, resolvers and functions that make what is missing.

PROVIDERS: dict[str, tuple[int, Callable[[str], np.ndarray]]] = {}


def register_provider(name: str, dimension: int, embed: Callable[[str], np.ndarray]) -> None:
    """An embedding provider by name: its dimension and a function from a text to so many numbers."""
    PROVIDERS[name] = dimension, embed


def hashed_words(text: str, dimension: int = 32) -> np.ndarray:
    """A provider without a model: words hashed to signed places, at unit length."""
    from zlib import crc32

    v = np.zeros(dimension)
    for w in text.lower().split():
        h = crc32(w.encode())
        v[h % dimension] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


register_provider("hashed", 32, hashed_words)


def embedded(text: Column, provider: str = "hashed") -> Column:
    """Embeddings of a text column, a batch at a time; null texts are empty."""
    dimension, one = PROVIDERS[provider]

    @F.pandas_udf("array<double>")
    def each(values: pd.Series) -> pd.Series:
        out = [np.asarray(one(t or ""), float) for t in values]
        if any(len(x) != dimension for x in out):
            raise ValueError(f"provider {provider!r} gave another dimension than {dimension}")
        return pd.Series([x.tolist() for x in out])

    return each(text)


def created_on_miss(asked: DataFrame, known: DataFrame, key: str, value: str, make: Callable[[Column], Column]) -> DataFrame:
    """``asked`` with the known value of its key, or one that is made for a missing key; and whether it was made."""
    found = asked.join(known.select(key, value), key, "left")
    return found.withColumn("made", F.col(value).isNull()).withColumn(value, F.coalesce(value, make(F.col(key))))


REG.add("created_on_miss", lambda p, s: created_on_miss(p.select(F.col("p_partkey").alias("k")), s.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")), "k", "v", lambda k: F.concat(F.lit("new:"), k.cast("string"))), "SELECT p_partkey AS k, coalesce(s_name, 'new:' || p_partkey) AS v, s_name IS NULL AS made FROM part LEFT JOIN supplier ON p_partkey = s_suppkey", "part", "supplier")


def semantic_lookup(prompts: DataFrame, cached: DataFrame, steps: DataFrame, least: float = 0.85, total: int = 50) -> DataFrame:
    """SIM10-11: per prompt (id of 0 and more, embedding) the best cached entry (entry, embedding) of at least that cosine, the step at which their runs diverge, and the latest stored step (entry, step) before it.

    The asked prompts are a stated set; every block of entries keeps one a prompt.
    """
    from quern.operators.catalogs import divergence
    from quern.operators.vectors import best_in_blocks

    # An entry may have the id of a prompt, and rows of the asked id are left out, so prompts are asked by ids that no entry has.
    asked = prompts.select((-F.col("id") - 1).alias("id"), F.col("embedding").alias("v"))
    found = best_in_blocks(asked, cached.select(F.col("entry").alias("id"), F.col("embedding").alias("v")), 1)
    best = found.select((-F.col("query_id") - 1).alias("id"), F.struct(F.round("similarity", 9).alias("s"), (-F.col("vec_id")).alias("e")).alias("x")).groupBy("id").agg(F.max("x").alias("x"))
    hit = best.where(F.col("x.s") >= least).select("id", (-F.col("x.e")).alias("entry"), F.col("x.s").alias("similarity"))
    d = divergence(F.col("similarity"), total, least)
    hit = hit.withColumn("diverges", d["step"])
    stored = hit.join(steps.withColumnRenamed("entry", "of"), (F.col("of") == F.col("entry")) & (F.col("step") <= F.col("diverges")), "left").groupBy("id").agg(F.max("step").alias("resume"))
    return hit.join(stored, "id").select("id", "entry", F.round("similarity", 5).alias("similarity"), "diverges", "resume")


def cache_lookup(vectors: DataFrame, events: DataFrame) -> DataFrame:
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"), F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + F.when(i < 8, 0.05).otherwise(0.0)).alias("embedding"))
    entries = vectors.select(F.col("vec_id").alias("entry"), F.col("embedding").cast("array<double>").alias("embedding"))
    steps = events.select(F.col("user_id").alias("entry"), (F.col("event_id") % 50).alias("step"))
    return semantic_lookup(asked, entries, steps)


REG.add("semantic_cache", cache_lookup, "WITH q AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x, i: x + CASE WHEN i <= 8 THEN 0.05::DOUBLE ELSE 0 END) AS q FROM embeddings WHERE vec_id % 20 = 0), b AS (SELECT id, vec_id AS entry, round(list_cosine_similarity(q, embedding::DOUBLE[]), 9) AS s FROM q, embeddings QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_cosine_similarity(q, embedding::DOUBLE[]), 9) DESC, vec_id) = 1), d AS (SELECT *, CAST(greatest(least(round(pow((s - 0.85::DOUBLE) / (1 - 0.85::DOUBLE), 0.7::DOUBLE) * 50 * 0.8::DOUBLE), 48), 1) AS INT) AS diverges FROM b WHERE s >= 0.85) SELECT id, entry, round(s, 5) AS similarity, diverges, (SELECT max(event_id % 50) FROM events WHERE user_id = entry AND event_id % 50 <= diverges) AS resume FROM d", "embeddings", "events")
QUERIES, ORACLE_SQL = REG.queries, REG.sql
