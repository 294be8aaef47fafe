"""Repeated passages by a sorted array of sparse suffixes.

Of every window of LENGTH words, the minimiser is the position among its first
STEP whose next GRAM words hash least. Both copies of a window have it at the
same place, so the SEED = LENGTH - STEP + 1 words from there (they lie within
the window) agree as well. Only the suffixes at minimisers are retained.

The suffixes of all documents are sorted: by the hash of their seed, then by
that of all words of the windows that have this minimiser (a stretch), then by
place. Suffixes with a neighbour of the same seed are live; all others are in no
repeated window and go. The sort is a range exchange on the whole key, place
included, so a seed that is everywhere is split over many tasks.

Matches are then extended left and right of the seed. Live suffixes with the
same stretch agree throughout, and the first in order speaks for them. Where the
words around a seed differ, each window (the seed, so many words to its left and
the rest to its right) of a stretch's first holder is looked up by itself, and
its first holder is taken. Either way each window gets its first occurrence in
all documents: nothing is matched pairwise, and an earlier holder of a part of a
passage hides no later one of the whole. Spans that agree with one copy at one
offset are joined into runs. Words in windows that occurred before are repeated;
their first occurrence stays. A line that a document repeats over and over gives
it one stretch at many places: these are gathered before they meet the first
occurrences, so that a document's stretch is joined once.

Windows are compared by 128 bits of two polynomial hashes with different bases,
so that of 10^12 different windows two are alike with a chance of 10^-15; seeds
have 64 bits, as nothing but the choice of candidates depends on them.

A passage may repeat within one document if the two copies don't overlap. Null
and empty texts have no words. Documents without an id come last in order and
are told apart by 128 bits of their text. Rows that share an id and a text are
one document and get the same result. An empty table gives an empty result.
without_repeats passes other columns through whole, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, cut

LENGTH, STEP, GRAM = 50, 16, 5
SEED = LENGTH - STEP + 1
_BASES = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
_U = np.uint64
SORT_BATCH = 20_000


def _word_hashes(text: str | None) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, (text or "").encode("utf-8").split()), dtype=_U)


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if base not in _CACHE or len(_CACHE[base][0]) < n:
        with np.errstate(over="ignore"):
            up = np.full(max(n, 1 << 12), base, dtype=_U)
            down = np.full(len(up), pow(base, -1, 1 << 64), dtype=_U)
            up[0] = down[0] = 1
            _CACHE[base] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    up, down = _CACHE[base]
    return up[:n], down[:n]


def _mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


def _gram_hashes(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of all n-grams of word hashes, by prefix sums of a polynomial."""
    if len(h) < n:
        return np.zeros(0, dtype=_U)
    up, down = _powers(len(h) + 1, _BASES[which])
    if which:
        h = _mixed(h)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(h * up[: len(h)], dtype=_U)])
        return _mixed((total[n:] - total[:-n]) * down[: len(h) - n + 1])


_NOTHING = np.zeros(0, np.int64)


def stretches(text: str | None) -> tuple[np.ndarray, ...]:
    """(starts, numbers of windows, seed hashes, two hashes of all words) of the stretches; hashes are signed longs."""
    h = _word_hashes(text)
    if len(h) < LENGTH:
        return (_NOTHING,) * 5
    seeds = _gram_hashes(h, SEED)
    grams = _gram_hashes(h, GRAM)[: len(seeds)]
    windows = np.lib.stride_tricks.sliding_window_view(grams, STEP)
    at = windows.argmin(axis=1) + np.arange(len(windows))
    starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    sizes = np.diff(np.append(starts, len(at)))
    keys = []
    for which in (0, 1):
        # All words of a stretch are those of its first and last windows, which overlap.
        whole = _gram_hashes(h, LENGTH, which)
        with np.errstate(over="ignore"):
            keys.append(_mixed(_mixed(whole[starts] + sizes.astype(_U)) + whole[starts + sizes - 1]).view(np.int64))
    return starts, sizes, seeds[at[starts]].view(np.int64), *keys


#: The key of a document: in order of doc_id, null last. 128 bits of the text tell rows without an id apart, and 64 bits rows of one id.
DOC = ("none", "id", "th")


def _doc_key() -> dict[str, Column]:
    return {"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.xxhash64("text", F.lit(1))), "th": F.xxhash64("text")}


def suffixes(docs: DataFrame) -> DataFrame:
    """(seed, k1, k2, none, id, th, start, windows) of all retained suffixes; (k1, k2) is the hash of the stretch."""

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [stretches(t) for t in pdf["text"]]
            sizes = [len(x[0]) for x in found]
            if sum(sizes):
                start, windows, seed, k1, k2 = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pd.DataFrame({"seed": seed, "k1": k1, "k2": k2, **{c: np.repeat(pdf[c].to_numpy(), sizes) for c in DOC}, "start": start.astype(np.int32), "windows": windows.astype(np.int32)})

    keyed = docs.select(*[v.alias(k) for k, v in _doc_key().items()], "text")
    return keyed.mapInPandas(kept, "seed long, k1 long, k2 long, none boolean, id long, th long, start int, windows int")


def live_suffixes(found: DataFrame) -> DataFrame:
    """``found`` sorted, without suffixes whose neighbours both have another seed. An action.

    The first and last of each range stay whatever their neighbours are: they
    are few, and a suffix whose seed no other one has yields no match later.
    """
    order = ["seed", "k1", "k2", *DOC, "start"]
    spark = found.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def with_neighbour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far, and whether it is known to stay
        for batch in batches:
            if not batch.num_rows:
                continue
            seed = batch.column("seed").to_numpy()
            same = np.concatenate([[held is None or held[1] == seed[0]], seed[1:] == seed[:-1]])
            if held is not None and (held[2] or same[0]):
                yield held[0]
            stay = same.copy()
            stay[:-1] |= same[1:]
            yield batch.slice(0, batch.num_rows - 1).filter(pa.array(stay[:-1]))
            held = batch.slice(batch.num_rows - 1), seed[-1], bool(stay[-1])
        if held is not None:
            yield held[0]

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(SORT_BATCH))  # narrow rows
    try:
        return cut(found.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(with_neighbour, found.schema))
    finally:
        spark.conf.set(key, before)


def _windows(docs: DataFrame, asks: DataFrame) -> DataFrame:
    """(k1, k2, none, id, th, at, nth, w1, w2): hash and position of each window of the asked stretches (k1, k2, none, id, th, start, windows)."""

    @F.pandas_udf("array<struct<k1:long,k2:long,start:int,w1:array<long>,w2:array<long>>>")
    def fetch(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for t, asked in zip(texts, wanted, strict=True):
            h = _word_hashes(t)
            w = [_gram_hashes(h, LENGTH, which).view(np.int64) for which in (0, 1)]
            out.append([{"k1": x["k1"], "k2": x["k2"], "start": x["start"], "w1": w[0][x["start"] : x["start"] + x["windows"]], "w2": w[1][x["start"] : x["start"] + x["windows"]]} for x in asked])
        return pd.Series(out)

    grouped = asks.groupBy(*DOC).agg(F.collect_list(F.struct("k1", "k2", "start", "windows")).alias("wanted"))
    # Repeated rows give repeated windows, which the minima taken of them don't mind.
    keyed = docs.select(*[v.alias(k) for k, v in _doc_key().items()], "text")
    got = keyed.join(grouped, list(DOC)).select(*DOC, F.explode(fetch("text", "wanted")).alias("c"))
    each = got.select("c.k1", "c.k2", *DOC, "c.start", F.posexplode(F.arrays_zip("c.w1", "c.w2")).alias("nth", "w"))
    return each.select("k1", "k2", *DOC, (F.col("start") + F.col("nth")).alias("at"), "nth", "w.w1", "w.w2")


def _agreements(docs: DataFrame) -> DataFrame:
    """(doc, starts, parts): where a document has a stretch, and the parts (first, base, lo, hi) of it that agree with the first occurrence of their windows; see ``_spans``. Several actions.

    A stretch has STEP parts at most, and its places lie in one document.
    """
    live = live_suffixes(cut(suffixes(docs)))
    me = F.struct(*DOC, "start")
    # Tables, so that the joins below can be split where one key is everywhere.
    classes = cut(live.groupBy("seed", "k1", "k2").agg(F.min(me).alias("first"), F.max("windows").alias("windows"), (F.min(me) != F.max(me)).alias("more")))
    seeds = cut(classes.groupBy("seed").agg((F.count(F.lit(1)) == 1).alias("alike")))
    classes = cut(classes.join(seeds, "seed"))
    doc = F.struct(*DOC)
    part = F.struct("first", "base", "lo", "hi")
    alike = classes.where("alike and more").select("k1", "k2", F.lit(0).alias("lo"), (F.col("windows") - 1).alias("hi"), F.struct(*[F.col(f"first.{c}") for c in DOC]).alias("first"), F.col("first.start").alias("base"))
    each = cut(_windows(docs, classes.where("not alike").select("k1", "k2", "first.*", "windows")))
    firsts = cut(each.groupBy("w1", "w2").agg(F.min(F.struct(*DOC, "at")).alias("f")))
    parts = each.join(firsts, ["w1", "w2"]).groupBy("k1", "k2", F.struct(*[F.col(f"f.{c}") for c in DOC]).alias("first"), (F.col("f.at") - F.col("nth")).alias("base")).agg(F.min("nth").alias("lo"), F.max("nth").alias("hi"))
    parts = cut(alike.select("k1", "k2", F.array(part).alias("parts")).unionByName(parts.groupBy("k1", "k2").agg(F.collect_list(part).alias("parts"))))
    # Repeated rows of one document give repeated places, of which the set holds one.
    held = live.groupBy("k1", "k2", *DOC).agg(F.collect_set("start").alias("starts")).select("k1", "k2", doc.alias("doc"), "starts")
    last = F.array_max("starts")
    return held.join(parts, ["k1", "k2"]).where(F.exists("parts", lambda p: _apart(last, p))).select("doc", "starts", "parts")


def _apart(start: Column, part: Column) -> Column:
    """Whether a span from there is no first occurrence itself and doesn't overlap with its own."""
    return (F.col("doc") != part["first"]) | (start >= part["base"] + LENGTH)


def _spans(span: Callable[[Column, Column], Column]) -> Column:
    """``span(start, part)`` of all places and parts in a row of ``_agreements`` that are apart."""
    return F.flatten(F.transform("parts", lambda p: F.transform(F.filter("starts", lambda s: _apart(s, p)), lambda s: span(s, p))))


def _ends(start: Column, part: Column) -> list[Column]:
    return [(start + part["lo"]).alias("start"), (start + part["hi"] + LENGTH).alias("end")]


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc, start, end, first, first_start): runs of words that occurred before; ``doc`` and ``first`` are (none, id, th). Several actions.

    A run agrees with one copy throughout: spans are joined only if both the copy and the offset to it are the same.
    """
    copy = ["doc", "first", "offset"]
    along = Window.partitionBy(*copy).orderBy("start", "end")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = _agreements(docs).select("doc", F.explode(_spans(lambda s, p: F.struct(*_ends(s, p), p["first"].alias("first"), (p["base"] + p["lo"]).alias("first_start")))).alias("span"))
    runs = spans.select("doc", "span.*").withColumn("offset", F.col("start") - F.col("first_start")).withColumn("new", (F.col("start") > F.coalesce(before, F.lit(-1))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = runs.groupBy(*copy, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_start").alias("first_start"))
    return out.select("doc", "start", "end", "first", "first_start")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out; n_chars follows. Documents of which nothing but white space is left go. Several actions."""
    # Which copy a span agrees with doesn't matter here, so runs aren't made of them.
    spans = _agreements(docs).select("doc", _spans(lambda s, p: F.struct(*_ends(s, p))).alias("spans")).groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans")).select("doc.*", "spans")

    def cut_out(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else excise(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    # Not deterministic in name only: so it is not evaluated again for each use.
    cut_out = F.pandas_udf(cut_out, "string").asNondeterministic()
    changed = F.col("spans").isNotNull()
    out = boxed(docs, **_doc_key()).join(spans, list(DOC), "left").select("row", "spans")
    out = out.withColumn("left", cut_out(F.when(changed, F.col("row.text")), F.col("spans")))
    out = out.where(~changed | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    put = {"text": F.when(changed, F.col("left")).otherwise(F.col("row")["text"]), "n_chars": F.when(changed, F.char_length("left").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return out.select(*[put.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def excise(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the (start, end) spans and the white space after each."""
    import re

    at = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)] + [len(text)]
    out, here = [], 0
    for a, b in sorted(spans):
        a, b = at[a], at[min(b, len(at) - 1)]
        if a > here:
            out.append(text[here:a])
        here = max(here, b)
    return "".join([*out, text[here:]])


def op2_repeated_passages(spark, sf_dir) -> DataFrame:
    from ..session import share_code, table

    share_code(spark)
    out = repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = [F.when(~F.col(f"{c}.none"), F.col(f"{c}.id")) for c in ("doc", "first")]
    return out.select(ids[0].alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), ids[1].alias("first_doc_id"), F.col("first_start").alias("first_start_word"))
