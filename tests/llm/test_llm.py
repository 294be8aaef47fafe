"""The ten operators and the pipeline against brute force, libraries, SQL and edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
import regex
from compare import difference, duck
from pyspark.sql import functions as F

from quern.llm import ann, bpe, labelled, mixing, quality, sharding, simhash, spotsigs, suffix_dedup, token_counts, toxicity
from quern.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those that the operators compute, with values that tell them.
EXTRA = {c: f"mine:{c}" for c in ("row", "fp", "sigs", "_h", "kid", "th", "none", "id", "spans", "left", "size", "score", "predicted", "ids", "decoded", "made", "n_tokens", "round_trip", "copies", "key", "text_hash", "_words", "_copy", "root")}


@pytest.fixture(scope="module")
def texts():
    return dict(duck(SF).sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "lost words here", "en", "a", 15), (3, "same text twice", "en", None, 15), (3, "same text twice", "en", None, 15), (4, "the cat " * 40_000, "en", "b", 320_000), (5, "x" * 100_000, None, "b", 100_000), (6, "é中🙂 \t\n ", "en", "a", 7)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 7)] + [(7, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def with_extra(df):
    return df.select("*", *[F.lit(v).alias(k) for k, v in EXTRA.items() if k not in df.columns])


def keeps_extra(df, renamed=()):
    """Every row has the values of the extra columns, those of new names behind ``_input``."""
    rows = df.collect()
    return bool(rows) and all(r[f"{k}_input" if k in renamed else k] == v for r in rows for k, v in EXTRA.items())


# 1: fingerprints


def test_op1_texts_and_likeness(spark, texts):
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op1_spotsigs"](spark, SF).collect()}
    assert len(got) == len(texts)
    for i, d in enumerate(order):
        t, n = texts[d], texts[order[(i + 1) % len(order)]]
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
        a, b = (set(got[d][c][j : j + 16] for j in range(0, len(got[d][c]), 16)) for c in ("fingerprint", "edited_fingerprint"))
        assert got[d]["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1)


def test_op1_edges(edge, empty):
    rows = spotsigs.with_neighbours(with_extra(edge)).collect()
    assert len(rows) == 8 and all(r["sigs"] == sorted(set(r["sigs"])) for r in rows)
    assert spotsigs.with_neighbours(empty).count() == 0
    # The null id comes last, so document 1 is followed by it and it by document 6.
    last = next(r for r in rows if r["doc_id"] is None)
    assert last["edited"] == "lost words" + "é中🙂 \t"


def test_op1_signatures_by_plain_python(spark, texts):
    """An independent version: words by code points, gaps from a list of the words before each content word."""

    def slow(text):
        words, word = [], ""
        for c in text.lower() + " ":
            if regex.match(r"\p{L}", c):
                word += c
            elif word:
                words.append(word)
                word = ""
        at = [i for i, w in enumerate(words) if len(w) >= 4]
        chains = []
        for k, i in enumerate(at):
            gap = words[max(at[k - 1] + 1 if k else 0, i - spotsigs.GAP) : i]
            chains.append((gap, " " + " ".join([*gap, words[i], *(words[j] for j in at[k + 1 : k + 2])])))
        some = [c for gap, c in chains if any(w in spotsigs.ANCHORS for w in gap)]
        return some or [c for _, c in chains] or ([text.lower()] if text else [])

    odd = ["", "the", "the of", "one house", "The House of the Rising Sun's là-bas", "a an the in of it is to was der house and home", "x" * 50, "word " * 300, "É de là FORÊT et MAISON"]
    docs = spark.createDataFrame([(t,) for t in [*odd, *list(texts.values())[:60]]], "text string")
    rows = docs.select("text", spotsigs.signatures(F.col("text")).alias("sigs")).collect()
    want = spark.createDataFrame([(i, c) for i, r in enumerate(rows) for c in slow(r["text"])], "i int, c string").select("i", F.xxhash64("c").alias("h")).collect()
    by = {}
    for r in want:
        by.setdefault(r["i"], set()).add(r["h"])
    assert [r["sigs"] for r in rows] == [sorted(by.get(i, ())) for i in range(len(rows))]


def test_op1_near_next(spark, texts):
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op1_spotsigs"](spark, SF).collect()}
    sets = {d: {r["fingerprint"][j : j + 16] for j in range(0, len(r["fingerprint"]), 16)} for d, r in got.items()}
    for i, d in enumerate(order):
        a, b = sets[d], sets[order[(i + 1) % len(order)]]
        assert got[d]["near_next"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1)


def test_op1_near_pairs_are_those_of_brute_force(spark):
    rng = random.Random(4)
    sets = [sorted(rng.sample(range(60), rng.randint(1, 30))) for _ in range(60)]
    sets += [s[:-1] for s in sets if len(s) > 6]
    got = {(r["u"], r["v"]) for r in spotsigs.near_pairs(spark.createDataFrame(list(enumerate(sets)), "id long, sigs array<long>")).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert got == want


# 2 and the pipeline's third stage: repeated passages


def _prose(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_op2_finds_planted_passages_and_nothing_else(spark):
    rng = random.Random(2)
    passage, clean = _prose(rng, 70), _prose(rng, 300)
    rows = [(1, " ".join(_prose(rng, 40) + passage + _prose(rng, 30))), (2, " ".join(_prose(rng, 11) + passage + _prose(rng, 90))), (3, " ".join(passage)), (4, " ".join(clean)), (5, " ".join(_prose(rng, 20) + clean[:45] + _prose(rng, 20))), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = _runs(docs)
    assert got == [(2, 11, 81, 1, 40), (3, 0, 70, 1, 40)]
    left = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(docs).collect()}
    words = rows[1][1].split()
    assert 3 not in left and left[2].split() == words[:11] + words[81:]
    assert all(left[d] == t for d, t in rows if d not in (2, 3))


def _runs(docs):
    return sorted((r["doc"]["id"], r["start"], r["end"], r["first"]["id"], r["first_start"]) for r in suffix_dedup.repeated_passages(docs).collect())


def _marked(rows):
    """Words of each document that lie in a 50-word window that occurred before, by brute force."""
    first, out = {}, {}
    for d, t in sorted((d, t) for d, t in rows if t):
        w = t.split()
        out[d] = set()
        for s in range(len(w) - 49):
            f = first.setdefault(tuple(w[s : s + 50]), (d, s))
            if f[0] != d or s >= f[1] + 50:
                out[d] |= set(range(s, s + 50))
    return out


def _reported(spark, rows):
    out = {d: set() for d, t in rows if t}
    for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out[r["doc"]["id"]] |= set(range(r["start"], r["end"]))
    return out


def test_op2_earlier_fragments_hide_no_passage(spark):
    """Of each passage an earlier document holds 35 to 49 words, two later ones all; the words around differ."""
    rng, rows = random.Random(12), []
    for k in range(60):
        passage = _prose(rng, rng.choice([50, 51, 55, 64, 80]))
        n = rng.randint(35, 49)
        at = rng.randint(0, len(passage) - n)
        for i, part in enumerate((passage[at : at + n], passage, passage)):
            rows.append((3 * k + i, " ".join(_prose(rng, rng.randint(5, 40)) + part + _prose(rng, rng.randint(5, 40)))))
    want = _marked(rows)
    assert _reported(spark, rows) == want and all(want[3 * k + 2] and not want[3 * k + 1] for k in range(60))


def test_op2_runs_agree_with_one_copy(spark):
    """Short passages side by side and a repeated short line are no passage; two long ones side by side are two runs."""
    rng = random.Random(13)
    a, b, c, d, line = _prose(rng, 45), _prose(rng, 40), _prose(rng, 60), _prose(rng, 70), _prose(rng, 40)
    parts = [a, b, a + b, c, d, c + d, line, line + line]
    rows = [(i, " ".join(_prose(rng, 9) + p + _prose(rng, 9))) for i, p in enumerate(parts)]
    assert _reported(spark, rows) == _marked(rows)
    assert _runs(spark.createDataFrame(rows, "doc_id long, text string")) == [(5, 9, 69, 3, 9), (5, 69, 139, 4, 9)]


def test_op2_overlapping_fragments_are_no_passage(spark):
    """Fragments of 45 words in two earlier documents overlap in a later one; longer ones are a run each."""
    rng, rows = random.Random(14), []
    for k in range(40):
        n, size = (60, 45) if k % 2 else (90, 60)
        passage = _prose(rng, n)
        for i, part in enumerate((passage[:size], passage[n - size :], passage)):
            rows.append((3 * k + i, " ".join(_prose(rng, 9) + part + _prose(rng, 9))))
    assert _reported(spark, rows) == _marked(rows)
    runs = _runs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert runs == [x for k in range(0, 40, 2) for x in ((3 * k + 2, 9, 69, 3 * k, 9), (3 * k + 2, 39, 99, 3 * k + 1, 9))]


def test_op2_random_texts_of_few_words(spark):
    """Texts of short periods and of spliced pieces, over 211 sorted ranges, so that runs of one seed straddle them."""
    rng = random.Random(15)
    pool = [_prose(rng, rng.randint(30, 120)) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = [rng.choice(pool)[rng.randint(0, 10) :] if rng.random() < 0.6 else _prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 5))]
        rows.append((i, " ".join(w for p in parts for w in p)))
    rows += [(100, "a b c " * 60), (101, "a b c " * 40), (102, "z " * 49), (103, "z " * 101)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("8", "211"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert _reported(spark, rows) == _marked(rows)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def _joined_rows(spark, run):
    """The most rows that one join made while ``run`` ran, and its result."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, out, most = store.executionsCount(), run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    done = store.executionsList()
    for i in range(before, done.size()):
        at = done.apply(i).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            for m in map(node.metrics().apply, range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, out


def test_op2_a_line_over_and_over_is_joined_once_a_document(spark):
    """Each document repeats one line 60 times between words of its own: joins make rows by document, not by place, and the same words go."""
    rng = random.Random(17)
    line = _prose(rng, 12)
    for n in (40, 80):
        rows = [(i, " ".join(_prose(rng, 20) + line * 60 + _prose(rng, 20))) for i in range(n)]
        docs, want = spark.createDataFrame(rows, "doc_id long, text string"), _marked(rows)
        most, left = _joined_rows(spark, suffix_dedup.without_repeats(docs).collect)
        assert 0 < most <= 10 * n
        assert {r["doc_id"]: r["text"].split() for r in left} == {d: [w for i, w in enumerate(t.split()) if i not in want[d]] for d, t in rows}
        assert _reported(spark, rows) == want


def test_op2_ids_blanks_and_repeated_rows(spark):
    """Null ids are documents by text, the greatest id is an id, repeated rows are one document, blank remainders go."""
    rng = random.Random(16)
    p, top = _prose(rng, 60), (1 << 63) - 1
    a, b, c = (" ".join(_prose(rng, 5) + p + _prose(rng, 5)) for _ in range(3))
    docs = spark.createDataFrame([(1, " ".join(p)), (2, " ".join(p) + "\n\t"), (3, a), (3, a), (3, a), (None, b), (None, c), (top, a)], "doc_id long, text string")
    got = sorted((r["doc"]["none"], r["doc"]["id"] if not r["doc"]["none"] else 0, r["start"], r["end"], r["first"]["id"]) for r in suffix_dedup.repeated_passages(docs).collect())
    # (top, a) repeats 3's words before and after the passage too: one run with each first holder.
    assert [x for x in got if x[1] < top] == [(False, 2, 0, 60, 1), (False, 3, 5, 65, 1), (True, 0, 5, 65, 1), (True, 0, 5, 65, 1)]
    assert {x[4] for x in got if x[1] == top} == {1, 3}
    left = suffix_dedup.without_repeats(docs).collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 0, 1, 3, 3, 3] and len({r["text"] for r in left if r["doc_id"] == 3}) == 1


def test_op2_edges(edge, empty):
    assert keeps_extra(suffix_dedup.without_repeats(with_extra(edge)))
    assert {r["doc_id"] for r in suffix_dedup.without_repeats(with_extra(edge)).select("doc_id").collect()} >= {1, 2, 3, 5, 6}
    assert suffix_dedup.repeated_passages(empty).count() == 0 and suffix_dedup.without_repeats(empty).count() == 0


# 3: sharding


def test_op3_slots_are_gapless_and_computable(spark, texts):
    rows = QUERIES["op3_feistel_shards"](spark, SF).collect()
    n = len(rows)
    for r in rows:
        b = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 8, zlib.crc32(b), "rows", None)
        assert sharding.locate(r["row_number"], n, 24, 1) == (r["shard"], r["slot"]) and sharding.row_at(r["shard"], r["slot"], n, 24, 1) == r["row_number"]
    by = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(24)]
    assert all(x == list(range(len(x))) for x in by) and max(map(len, by)) - min(map(len, by)) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_op3_is_a_permutation(n):
    p = sharding.permute(np.arange(n), n, 5)
    assert sorted(p) == list(range(n)) and list(sharding.permute(p, n, 5, inverse=True)) == list(range(n))


def test_op3_edges(edge, empty):
    assert sorted((r["shard"], r["slot"]) for r in sharding.shard_documents(with_extra(edge)).collect()) == [(i, 0) for i in range(8)]
    assert sharding.shard_documents(empty).count() == 0


# 4 and the pipeline's second stage: SimHash


def test_op4_fingerprints_and_classes(spark, texts):
    import xxhash

    def slow(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {d: slow(t) for d, t in texts.items() if len(t) < 20_000}
    got = {r["doc_id"]: r for r in QUERIES["op4_simhash_classes"](spark, SF).collect()}
    assert all(got[d]["fingerprint"] == f"{fp:016x}" for d, fp in fps.items())
    assert _classes({d: int(r["fingerprint"], 16) for d, r in got.items()}) == {d: r["component_id"] for d, r in got.items()}


def _classes(fps):
    left, out = set(fps), {}
    while left:
        seen, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x in left:
                left.discard(x)
                seen.add(x)
                todo += [y for y in left if (fps[x] ^ fps[y]).bit_count() <= 2]
        out |= dict.fromkeys(seen, min(seen))
    return out


@pytest.mark.parametrize("segments", [m for m, _ in simhash.SEGMENTS])
def test_op4_links_in_crowded_and_light_buckets(spark, segments):
    """Chains of near fingerprints around one, more than LIGHT, so that both ways are taken."""
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    fps |= {f ^ 3 for f in list(fps)[:40]} | {f ^ 7 for f in list(fps)[40:60]}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.ring_links(spark.createDataFrame([(f,) for f in signed], "fp long"), segments).collect()
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(near(e["u"], e["v"]) <= 3 for e in edges)  # a star's centre holds a value within one bit of both
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        root[find(e["u"])] = find(e["v"])
    got = {}
    for f in signed:
        got.setdefault(find(f), set()).add(f)
    want = {}
    for f, c in _classes({f: f & (1 << 64) - 1 for f in signed}).items():
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_op4_edges(edge, empty):
    got = simhash.assign(with_extra(edge)).collect()
    assert len(got) == 8 and {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    kept = simhash.near_dedup(with_extra(edge))
    assert kept.columns == with_extra(edge).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6]
    assert keeps_extra(kept)
    assert simhash.assign(empty).count() == simhash.near_dedup(empty).count() == 0


# 5 and 7: the scorers


@pytest.mark.parametrize(("name", "label", "folds", "held", "least"), [("op5_quality_scores", "quality", 5, 0, 0.9), ("op7_toxicity_scores", "toxic", 3, 1, 0.85)])
def test_scorers_rank_held_out_rows(spark, name, label, folds, held, least):
    sf = "/root/testdata/sf0.01"
    truth = dict(duck(sf).sql(f"SELECT doc_id, {label} FROM labels").fetchall())
    rows = QUERIES[name](spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in rows)
    good = [r["score"] for r in rows if r["held_out"] and truth.get(r["doc_id"]) == 1]
    bad = [r["score"] for r in rows if r["held_out"] and truth.get(r["doc_id"]) == 0]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) >= least


def test_op7_learns_pairs(spark):
    """Neither word tells alone, exactly one of the two does; each text has other words besides."""
    rng = random.Random(1)
    has = [(rng.random() < 0.5, rng.random() < 0.5) for _ in range(3000)]
    rows = [(i, " ".join(["alpha"] * a + ["omega"] * b + [f"w{rng.randrange(900)}" for _ in range(6)])) for i, (a, b) in enumerate(has)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(a != b)) for i, (a, b) in enumerate(has)], "doc_id long, toxic int")
    one = toxicity.fit_toxicity(docs, labels).scorer()
    assert min(one("alpha w5"), one("omega w5")) > max(one("alpha omega w5"), one("w5 w6")) + 0.25 and one("alpha omega w5") < 0.3


def test_scores_by_hand(spark):
    """Each score is the sum of table entries or of weights and pairs, taken one by one."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 4))
    x[:, 3] = rng.integers(0, 3, 800)
    m = quality.AdditiveModel(rounds=20, pair_rounds=10, pairs=2).fit(x, (x[:, 0] * x[:, 1] + x[:, 3] > 1).astype(float))
    for row, s in zip(x[:50], m.score(x[:50]), strict=True):
        z = m.base + sum(m.tables[j][sum(c <= row[j] for c in m.cuts[j])] for j in range(4))
        z += sum(t[sum(c <= row[a] for c in m.rough[a]), sum(c <= row[b] for c in m.rough[b])] for a, b, t in m.two_way)
        assert s == pytest.approx(1 / (1 + np.exp(-z)))
    assert toxicity._chunks([3, 0, 2, 4], 4) == [(0, 3, 0, 5), (3, 4, 5, 9)] and toxicity._chunks([]) == []
    texts = ["good calm day", "bad angry word here", "bad day", "calm word", "angry angry bad"] * 20
    terms = [toxicity.text_terms(t) for t in texts]
    fm = toxicity.FactorizationMachine().fit(terms, np.array([0, 1, 0, 0, 1] * 20, dtype=float))
    at = {int(t): i for i, t in enumerate(fm.terms)}
    for t in [*texts[:5], "angry unknown", "", None]:
        ids = [at[int(k)] for k in toxicity.text_terms(t) if int(k) in at]
        z = fm.w0 + sum(float(fm.w[i]) for i in ids) + sum(float(fm.v[k, i]) * float(fm.v[k, j]) for i in ids for j in ids if i < j for k in range(len(fm.v)))
        assert fm.scorer()(t) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_training_rows_are_bounded(spark):
    """One labelled id with many rows doesn't lift the bound."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, "other") for i in range(2, 40)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, toxic int")
    rows = labelled.bounded(labelled.training_rows(docs, marks, "toxic", 3, 1, 30).withColumnRenamed("text", "x"), 30)
    assert rows.count() == 30 and [r["x"] for r in rows.collect()] == [r["x"] for r in rows.collect()]


@pytest.mark.parametrize("fit, score", [(quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)])
def test_scorer_edges(edge, empty, labels, no_labels, fit, score):
    got = score(edge.withColumn("x", F.lit(1)), fit(edge, labels)).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert keeps_extra(score(with_extra(edge), fit(edge, labels)), ("score", "predicted"))
    assert {r["score"] for r in score(edge, fit(edge, no_labels)).collect()} == {0.5}
    assert score(empty, fit(empty, labels)).count() == 0


# 6: mixing


def test_op6_same_as_sql(spark):
    assert not difference(QUERIES["op6_mix_sources"](spark, SF).toPandas(), duck(SF).sql(ORACLE_SQL["op6_mix_sources"]).df())


def test_op6_edges(edge, empty):
    rows = mixing.mix(edge).collect()
    assert len(rows) == 8 and all(r["taken"] <= 3 * r["size"] for r in rows)
    sizes = {(r["doc_id"]): r["size"] for r in rows}
    assert sizes[1] == sizes[2] == 0 and sizes[4] == 80_000
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).columns == empty.columns
    assert mixing.mixed_documents(with_extra(edge)).columns == with_extra(edge).columns and keeps_extra(mixing.mixed_documents(with_extra(edge)))


# 8 and 9: tokens


def _tiktoken():
    import public_tokenizers as tokenizers
    import tiktoken

    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op8_same_as_the_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in QUERIES["op8_token_counts"](spark, SF).collect():
        t = texts[r["doc_id"]]
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)
    odd = ["a ก b กก <|endoftext|> ก", "naïve ก\n ok", "한글 テ ก 日",  "<|endoftext|>", "a<|endoftext|> b", " \n\n  x", "don't I'LL", "日本語 テキスト", "🙂🙂", "́a‍", "", "1234 56", "\x00\x01", "a" * 5000]
    count = token_counts.token_counter(lib, token_counts.frequent_table(lib))
    assert [count(t) for t in odd] == [len(lib.encode(t, add_special_tokens=False).ids) for t in odd]


def test_op9_same_as_the_library(spark, texts):
    lib = _tiktoken()
    for r in QUERIES["op9_byte_bpe"](spark, SF).collect():
        ids = lib.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 16, 17, 18, 257, 258, 4097, 5000])
def test_op9_merges_of_any_length(n):
    """Lengths about the bounds of one, two and three levels of the tree."""
    import public_tokenizers as tokenizers

    ranks = bpe.load_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))
    pairs, lib, rng = bpe.byte_pairs(ranks), _tiktoken(), random.Random(n)
    for letters in ("ab", "abcdefghinorst", "é中🙂a"):
        piece = "".join(rng.choice(letters) for _ in range(n)).encode()
        assert bpe.merge_bytes(piece, ranks, pairs) == lib._core_bpe.encode_single_piece(piece)


def test_token_edges(edge, empty):
    import public_tokenizers as tokenizers

    got = {r["doc_id"]: r for r in token_counts.count_tokens(edge, tokenizers.path("byte_bpe_50k.json")).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[4]["over_limit"]
    args = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    assert keeps_extra(token_counts.count_tokens(with_extra(edge), tokenizers.path("byte_bpe_50k.json")), ("n_tokens",))
    assert keeps_extra(bpe.encode_and_decode(with_extra(edge), *args), ("ids", "decoded")) and keeps_extra(bpe.round_trip(with_extra(edge), *args), ("n_tokens",))
    assert keeps_extra(bpe.decode_documents(bpe.encode_documents(with_extra(edge), *args), *args), ("ids", "decoded"))
    both = bpe.encode_and_decode(edge, *args).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in both)
    apart = bpe.decode_documents(bpe.encode_documents(edge, *args), *args).collect()
    assert sorted(map(repr, ((r["doc_id"], r["ids"]) for r in both))) == sorted(map(repr, ((r["doc_id"], r["ids"]) for r in apart)))
    assert token_counts.count_tokens(empty, tokenizers.path("byte_bpe_50k.json")).count() == bpe.round_trip(empty, *args).count() == 0


# 10: nearest neighbours


def _exact(vectors, k=20):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], dtype=float)
    out = {}
    for q in ids[ids % 20 == 0]:
        s = x @ np.array(vectors[q], dtype=float)
        s[ids == q] = -np.inf
        out[int(q)] = ids[np.lexsort((ids, -s))[: min(k, len(ids) - 1)]].tolist()
    return out


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_op10_recall_and_whole_answers(spark):
    """Clustered vectors with large cosines, for which a test that takes unseen columns for nothing loses rows."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 48))
    x = centres[rng.integers(0, 40, 12_000)] + 0.4 * rng.normal(size=(12_000, 48))
    vectors = dict(enumerate(x.astype(np.float32).astype(float).tolist()))
    got = _found(ann.nearest(spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0))
    want = _exact(vectors)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert sum(len({a for a, _ in got[q]} & set(want[q])) for q in want) / (20 * len(want)) >= 0.9
    for q, rows in got.items():
        assert [s for _, s in rows] == sorted((s for _, s in rows), reverse=True)
        assert all(s == pytest.approx(float(np.dot(vectors[q], vectors[v])), abs=1e-9) for v, s in rows)


def test_op10_searches_each_length_among_its_kind(spark, monkeypatch):
    """Three lengths: the most common one, one with more than BLOCK_ROWS rows, and a small one."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4 if i % 10 < 6 else 3 if i % 10 < 9 and i % 20 else 5).tolist()) for i in range(600)]
    rows = [(i, v + [1.0] if i % 60 == 0 else v) for i, v in rows]
    rows += [(20 * i, rng.normal(size=3).tolist()) for i in range(40, 45)]
    got = _found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0))
    want = {}
    for d in (3, 4, 5):
        want |= _exact({i: v for i, v in rows if len(v) == d})
    assert sum(len(v) == 3 for _, v in rows) > 100 and {len(v) for i, v in rows if i % 20 == 0} == {3, 4, 5}
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    small = [i for i, v in rows if i % 20 == 0 and len(v) == 5]
    assert {q: [v for v, _ in got[q]] for q in small} == {q: want[q] for q in small}


def test_op10_copies_ties_and_bad_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(200)] + [(200, [0.0, 0.0]), (220, None), (240, [float("nan"), 1.0]), (260, [1.0, None]), (280, [float("inf"), 0.0]), (300, [0.5, 0.5]), (None, [9.0, 9.0])]
    got = _found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0))
    good = {i: v for i, v in rows if i is not None and (i < 200 or i == 300)}
    assert {q: [v for v, _ in r] for q, r in got.items()} == _exact(good)
    few = _found(ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0))
    assert few == {0: [(1, 1.0), (2, 1.0)]}
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).count() == 0


# The pipeline


def test_pipeline_stages(spark, texts):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = p.keep_quality(spark, docs, SF)
    scores = {r["doc_id"] for r in QUERIES["op5_quality_scores"](spark, SF).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in judged.select("doc_id").collect()} == scores
    rows = p.run(spark, SF).collect()
    assert rows and all(r["round_trip"] for r in rows) and {r["doc_id"] for r in rows} <= scores
    lib = _tiktoken()
    whole = [r for r in rows if lib.decode(r["ids"]) == texts[r["doc_id"]]]
    assert len(whole) > len(rows) / 2 and all(len(r["ids"]) == r["n_tokens"] for r in rows)


@pytest.mark.parametrize("kind", ["edge", "empty"])
def test_pipeline_edges(spark, request, kind, tmp_path):
    import corpus_pipeline as p

    docs = with_extra(request.getfixturevalue(kind))
    for _, stage in p.STAGES[:-1]:
        assert stage(docs.sparkSession, docs, SF).columns == docs.columns and (kind == "empty" or stage is p.keep_quality or keeps_extra(stage(docs.sparkSession, docs, SF)))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = p.run(spark, str(tmp_path)).collect()
    assert all(r["round_trip"] for r in rows) and (kind == "edge") == bool(rows)
