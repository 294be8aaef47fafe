"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A text is lower-cased and reduced to its runs of letters. Words of four letters
and more are content; the shorter ones before a content word, the last GAP of
them, form its gap. Where the gap holds an anchor (a very common word of one of
the supported languages), the gap, its content word and the next one (if there is
one) make one signature. The fingerprint is the set of signature hashes, ascending. A text
without any anchored chain uses all its chains; one without chains is hashed
whole.

Two fingerprints are compared by Jaccard similarity: 1 for two empty ones, 0 if
one is empty. near_pairs() finds all similar pairs: sets are partitioned by
length, only signatures of a set's prefix are joined, and length bounds prune
candidates before the exact comparison.

Only DataFrame functions are used. Null texts are empty. Rows that share a
doc_id and a text count as one document whose successor is the next different
one; rows without a doc_id come last. An empty table gives an empty result. Other
columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ANCHORS = ("a", "an", "and", "in", "is", "it", "of", "the", "to", "was", "das", "der", "die", "ein", "ist", "und", "zu", "de", "des", "du", "et", "la", "le", "les", "un", "el", "en", "es", "los", "que", "y")
GAP = 8
#: Bounded and possessive, so that matching neither recurses nor goes back.
CHAIN = rf" (?:\p{{L}}{{1,3}}+ ){{0,{GAP}}}+\p{{L}}{{4,}}+"
ANCHORED = f" (?:{'|'.join(ANCHORS)}) "
BUCKETS = 8  # for each shuffle partition


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def signatures(text: Column) -> Column:
    """The fingerprint as an ascending array of distinct longs. ``text`` must not be null."""

    def linked(chains: Column) -> Column:
        # Each chain carries its gap and first content word; the next one ends in the second.
        following = F.slice(chains, F.lit(2), F.greatest(F.size(chains), F.lit(1)))
        return F.zip_with(chains, following, lambda a, b: F.concat_ws(" ", a, F.substring_index(b, " ", -1)))

    def spots(every: Column, lowered: Column) -> Column:
        whole = F.when(F.length(lowered) > 0, F.array(lowered)).otherwise(F.array().cast("array<string>"))
        return _let(F.filter(every, lambda c: c.rlike(ANCHORED)), lambda anchored: F.when(F.size(anchored) > 0, anchored).when(F.size(every) > 0, every).otherwise(whole))

    def found(lowered: Column) -> Column:
        plain = F.concat(F.lit(" "), F.regexp_replace(lowered, r"[^\p{L}]+", " "))
        return _let(F.regexp_extract_all(plain, F.lit(CHAIN), F.lit(0)), lambda chains: _let(linked(chains), lambda every: spots(every, lowered)))

    return F.sort_array(F.array_distinct(F.transform(_let(F.lower(text), found), lambda s: F.xxhash64(s))))


def spelled(sigs: Column) -> Column:
    """A fingerprint as text: 16 hex digits a signature."""
    return F.lower(F.array_join(F.transform(sigs, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def jaccard(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(_let(F.size(F.array_intersect(a, b)), lambda both: both / (total - both).cast("double")))


def near_pairs(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(u, v, similarity) for all pairs of ``sets`` (id, sigs) with Jaccard of at least ``threshold``; u < v.

    Pass one row per distinct fingerprint: equal ones are a class already.
    Lengths fall into classes of ratio 1 / threshold, so a set can only match
    its own class and the next. Of each set the |s| - ceil(t|s|) + 1 rarest
    signatures are joined: similar sets share one of those.
    """
    s = sets.where(F.size("sigs") > 0).withColumn("n", F.size("sigs"))
    rare = s.select(F.explode("sigs").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = s.select("id", "n", F.explode("sigs").alias("sig")).join(rare, "sig").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("r"))
    keep = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    keyed = ranked.select("id", "n", F.explode(F.slice("r", F.lit(1), keep)).alias("x")).select("id", "n", F.col("x.sig").alias("sig"))
    size_class = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / threshold))).cast("int")
    a = keyed.withColumn("c", F.explode(F.array(size_class, size_class + 1))).select("c", "sig", F.col("id").alias("a"), F.col("n").alias("na"))
    b = keyed.withColumn("c", size_class).select("c", "sig", F.col("id").alias("b"), F.col("n").alias("nb"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    cand = a.join(b, ["c", "sig"]).where(ordered & (F.col("na") >= F.col("nb") * threshold - 1e-9)).select("a", "b").distinct()
    full = cand.join(s.select(F.col("id").alias("a"), F.col("sigs").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("sigs").alias("sb")), "b")
    return full.withColumn("similarity", jaccard(F.col("sa"), F.col("sb"))).where(F.col("similarity") >= threshold - 1e-12).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "similarity")


def _bucket(kd: Column, kth: Column, starts: list[tuple[int, int]]) -> tuple[Column, Column]:
    """Place of the last of the ascending ``starts`` that is not beyond (kd, kth), by binary search; and, given that place as column ``at``, whether they are equal."""
    ids, hashes = (F.split(F.lit(",".join(str(x[i]) for x in starts)), ",").cast("array<bigint>") for i in (0, 1))
    steps = [F.lit(1 << i) for i in reversed(range((len(starts) - 1).bit_length()))]

    def step(at: Column, by: Column) -> Column:
        other = F.get(ids, at + by)
        fits = (other < kd) | ((other == kd) & (F.get(hashes, at + by) <= kth))
        return F.when((at + by < len(starts)) & fits, at + by).otherwise(at)

    place = F.aggregate(F.array(*steps), F.lit(0), step) if steps else F.lit(0)
    return place, (F.get(ids, F.col("at")) == kd) & (F.get(hashes, F.col("at")) == kth)


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, sigs, edited (text), edited_sigs, next_sigs. Two actions on keys.

    Rows are dealt once, by key ranges of neighbouring ids: some BUCKETS a
    shuffle partition, whose first keys are a sample by hash of all keys (the
    driver gets those and nothing else). The first row of each range is also
    sent to the range before it, and that of the first to the last.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Ascending kd is descending doc_id; rows without an id sort last. Of one id, texts follow by hash.
    kd = F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit((1 << 63) - 1)).alias("kd")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select("doc_id", "text", kd, F.xxhash64(F.col("doc_id").isNull(), "text").alias("kth"))
    keys = cut(base.select("kd", "kth"))
    least = keys.agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("kd", "kth")).alias("k")).first()
    every = max(1, least["rows"] // (BUCKETS * n))
    sampled = keys.where(F.pmod(F.xxhash64("kd", "kth"), F.lit(every)) == 0).distinct().collect()
    starts = sorted({(r["kd"], r["kth"]) for r in sampled} | ({tuple(least["k"])} if least["rows"] else {(0, 0)}))
    place, first = _bucket(F.col("kd"), F.col("kth"), starts)
    placed = base.withColumn("at", place)
    here, before = (F.struct(b.cast("int").alias("bucket"), F.lit(g).alias("guest")) for b, g in ((F.col("at"), 0), (F.pmod(F.col("at") - 1, F.lit(len(starts))), 1)))
    placed = placed.withColumn("to", F.explode(F.when(first, F.array(here, before)).otherwise(F.array(here)))).select("doc_id", "text", "kd", "kth", "to.*")
    placed = placed.repartition(n, "bucket").withColumn("sigs", signatures(F.col("text")))
    follows = F.lead(F.struct("text", "sigs")).over(Window.partitionBy("bucket").orderBy("guest", "kd", "kth"))
    # Of repeated rows only the last is followed by another document.
    same = Window.partitionBy("bucket", "guest", "kd", "kth")
    out = placed.withColumn("next", follows).withColumn("next", F.last("next").over(same)).where("guest = 0")
    out = out.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("take", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.expr("substring(text, 1, int(n_chars) - take)"), F.expr("substring(next.text, 1, take)"))
    out = out.select("doc_id", "n_chars", "sigs", edited.alias("edited"), F.col("next.sigs").alias("next_sigs"))
    return out.withColumn("edited_sigs", signatures(F.col("edited")))


def op1_spotsigs(spark, sf_dir) -> DataFrame:
    from ..session import table

    out = with_neighbours(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), spelled(F.col("sigs")).alias("fingerprint"), spelled(F.col("edited_sigs")).alias("edited_fingerprint"), jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"))
