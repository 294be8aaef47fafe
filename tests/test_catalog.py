"""Every query with SQL, over whole tables, against DuckDB; and a few operators on made-up rows."""

from __future__ import annotations

import hashlib
from pathlib import Path

import numpy as np
import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from quern.operators import blobs, records, series, similarity, tensors, vectors
from quern.plans.catalog import ORACLE_SQL, QUERIES
from quern.sources import containers
from quern.streaming import flows

SF = "/root/testdata/sf0.001"
WITHOUT = {"codec_ratios", "dictionary_matches", "dictionary_patterns", "rank_quality", "mixed_quality", "codebook_train", "evolved_merge", "auto_tune"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_each_query_has_sql():
    """Trained or seeded searches, codec sizes and NumPy decompositions have none."""
    assert QUERIES.keys() - ORACLE_SQL.keys() == WITHOUT and not ORACLE_SQL.keys() - QUERIES.keys()


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_as_duckdb(spark, con, name):
    assert not difference(QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["doc_id", "leader", "copies"] and df.count() > 0
    assert set(QUERIES) <= set(entry.queries())


def test_signatures_read_every_byte(spark):
    """Texts of 0 to 9 bytes and one that differs in its last byte only; chunks are of bytes, not of characters."""
    texts = [None, *("abcdefghi"[:n] for n in range(10)), "x" * 80 + "y", "x" * 80 + "z", "é" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in similarity.signed(docs).collect()}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        chunks = [b[k : k + 8] for k in range(0, len(b), 8)]
        votes = [sum(hashlib.sha256(c).digest()[k // 8] >> k % 8 & 1 for c in chunks) * 2 > len(chunks) for k in range(256)]
        assert got[i]["simhash"] == bytes(sum(votes[8 * n + j] << j for j in range(8)) for n in range(32)).hex()
        heads = [int.from_bytes(hashlib.sha256(c).digest()[:4], "big") % similarity.P for c in chunks]
        assert got[i]["minhash"] == [min((h * a + c) % similarity.P for h in heads) if heads else similarity.NONE for a, c in similarity.SEEDS]
    assert got[11]["simhash"] != got[12]["simhash"] or got[11]["minhash"] != got[12]["minhash"]
    assert got[0]["stats"] == [0] * 4 and got[2]["stats"] == [32768, 0, 32768, 32768]


def test_scores_of_equal_and_of_empty_signatures(spark):
    """Equal values score 1, two empty ones 0.9: they have no bins to compare."""
    docs = spark.createDataFrame([(1, "some text of some length"), (2, "some text of some length"), (3, ""), (4, None)], "doc_id long, text string")
    s = similarity.signed(docs).select("doc_id", F.struct("simhash", "minhash", "stats", "bins").alias("s"))
    pairs = s.select(F.col("doc_id").alias("x"), F.col("s").alias("a")).join(s.select(F.col("doc_id").alias("y"), F.col("s").alias("b")), F.col("y") == F.col("x") + 1)
    got = {r["x"]: r["v"] for r in pairs.select("x", similarity.similarity("a", "b").alias("v")).collect()}
    assert got[1] == pytest.approx(1) and got[3] == pytest.approx(0.9)
    classes = {r["doc_id"]: (r["leader"], r["copies"]) for r in similarity.deduplicated(docs).collect()}
    assert classes == {1: (1, 2), 3: (3, 2)}
    with pytest.raises(ValueError):
        similarity.bands(similarity.signed(docs), 5)


def test_running_total_is_the_prefix_sum(spark):
    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k"), (F.col("id") % 13).alias("v"))
    got = sorted((r["k"], r["v"], r["t"]) for r in records.running_total(df, [F.col("k")], "v", "t").collect())
    so_far = 0
    for _, v, t in got:
        so_far += v
        assert t == so_far


def test_vector_edges(spark):
    v = spark.createDataFrame([(0, [0.0] * 64, 0), (1, [1.0] * 64, 0), (2, [-1.0] * 64, 1)], "vec_id long, embedding array<float>, label int")
    codes = {(r["vec_id"], r["block"]): r["codes"] for r in vectors.int4_blocks(v).collect()}
    assert codes[0, 0] == [0] * 32 and codes[1, 1] == [7] * 32 and codes[2, 0] == [-7] * 32
    near = vectors.knn(v).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["similarity"]) for r in near] == [(0, 1, 0.0), (0, 2, 0.0)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert similarity.deduplicated(docs).count() == similarity.exact_classes(docs).count() == blobs.byte_entropy(docs).count() == 0


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    """Every table without rows; and with one row of nulls but for its ids."""
    none, blank = (tmp_path_factory.mktemp(n) for n in ("none", "blank"))
    for path in Path(SF).glob("*.parquet"):
        t = spark.read.parquet(str(path))
        t.limit(0).write.parquet(f"{none}/{path.name}")
        ids = [c for c in t.columns if c.endswith(("key", "_id"))]
        t.orderBy(*ids).limit(1).select(*[F.col(c) if c in ids else F.lit(None).cast(t.schema[c].dataType).alias(c) for c in t.columns]).write.parquet(f"{blank}/{path.name}")
    return {"none": str(none), "blank": str(blank)}


@pytest.mark.parametrize("kind", ["none", "blank"])
def test_tables_without_rows_and_of_nulls(spark, bare, kind):
    """No query fails; streams need files that come one by one and are left out."""
    failed = {}
    for name, query in QUERIES.items():
        if not name.startswith("stream_") or name == "stream_messages":
            try:
                query(spark, bare[kind]).collect()
            except Exception as e:  # noqa: BLE001
                failed[name] = str(e)[:100]
    assert not failed, failed


def test_transforms_and_their_inverses():
    """Directly and by a Fourier transform, against the sum itself; two dimensions; constant, zero, spike and chequered inputs."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 256, 257, 600):
        x = rng.normal(size=n)
        want = [sum(x * np.cos(np.pi * (2 * np.arange(n) + 1) * k / (2 * n))) * np.sqrt((1 if k == 0 else 2) / n) for k in range(n)]
        assert np.allclose(tensors.dct_1d(x), want) and np.allclose(tensors.idct_1d(tensors.dct_1d(x)), x)
    chequered = (np.add.outer(np.arange(4), np.arange(4)) % 2 * 2 - 1).astype(float)
    for m in (np.arange(16.0).reshape(4, 4), np.eye(4), np.zeros((4, 4)), np.full((4, 4), 3.0), chequered, np.eye(1, 64)[0].reshape(2, 32), 1e6 * rng.normal(size=(8, 8)), 1e-6 * rng.normal(size=(32, 2))):
        c = tensors.dct_2d(m.ravel(), m.shape[1])
        assert np.allclose(tensors.idct_2d(c, m.shape[1]), m.ravel()) and np.isclose((c**2).sum(), (m**2).sum())
    assert tensors.dct_2d(np.full(16, 3.0), 4)[0] == pytest.approx(12) and tensors.flattened([3, 4, 5]) == (3, 20)


def test_fragments_and_quantised_forms():
    v = np.random.default_rng(2).normal(size=64)
    parts = tensors.compress(v, 8, 0.7)
    whole, some = tensors.decompress(parts, 64, 8), tensors.decompress(parts[:2], 64, 8)
    assert tensors._cos(v, whole) > tensors._cos(v, some) > tensors._cos(v, tensors.decompress(parts[:1], 64, 8)) and tensors.decompress(parts[1:], 64, 8) is None
    assert np.allclose(tensors.decompress(tensors.compress(v, 8, 1.0), 64, 8), v, atol=0.02)
    for n in (1, 31, 32, 33, 64):
        packed = tensors.pack_int4(v[:n])
        assert len(packed) == 2 * -(-n // 32) + -(-n // 2) and np.abs(tensors.unpack_int4(packed, n) - v[:n]).max() <= np.abs(v).max() / 7
    q, s = tensors.refine(v, np.zeros(64), np.zeros(64), 0.01)
    assert ((q * s - v) ** 2).mean() < (v**2).mean() / 100
    u, s, w = tensors.randomised_svd(v.reshape(8, 8), 8)
    assert np.allclose((u * s) @ w, v.reshape(8, 8)) and np.allclose(s, np.linalg.svd(v.reshape(8, 8))[1])
    assert np.allclose(tensors.slerp(v, v, 0.3), v) and np.allclose(tensors.slerp(v, 0 * v, 0.5), v / 2)
    best, history = tensors.evolve(lambda x: -((x - np.array([0.7, 0.2, 0.1])) ** 2).sum(), 3, generations=40, patience=40)
    assert best.sum() == pytest.approx(1) and history[-1] > -0.01 and history == sorted(history)


def test_containers_refuse_what_is_damaged(spark):
    data = b"some bytes " * 5000
    for version in (1, 2):
        c = containers.pack_blocks(data, version=version)
        assert b"".join(b["payload"] for b in containers.read_blocks(c)) == data
        assert containers.read_blocks(c, [2])[0]["payload"] == data[32768:49152]
    broken = bytearray(c)
    broken[-1] ^= 1
    assert [b["intact"] for b in containers.read_blocks(bytes(broken))] == [True, True, True, False]
    with pytest.raises(ValueError):
        containers.read_blocks(b"x" * 100)
    files = spark.createDataFrame([("a", b"\x05"), ("b", b"\xff\xff\0\0\0\0\0\0{}"), ("c", containers.pack_shard([("t", "F32", [2], b"\0" * 8)]))], "path string, content binary")
    assert [(r["path"], r["name"], r["shape"], r["size"]) for r in containers.tensor_catalog(files).collect()] == [("c", "t", [2], 8)]


def test_shards_in_folders(spark, tmp_path):
    (tmp_path / "snapshots" / "x").mkdir(parents=True)
    for name in ("model-2.safetensors", "snapshots/x/model-1.safetensors", "other.bin"):
        (tmp_path / name).write_bytes(containers.pack_shard([("w", "F16", [2], np.array([1.5, -2], "<f2").tobytes())]))
    assert containers.discover(spark, str(tmp_path)).count() == 2
    files = containers.shards(spark, str(tmp_path))
    t = containers.tensor_bytes(files, containers.tensor_catalog(files)).select(containers.widened(F.col("data"), F.col("dtype")).alias("x"))
    assert [r["x"] for r in t.collect()] == [[1.5, -2.0]] * 2


def test_dictionary_matches_are_the_longest(spark):
    d = b"the quick brown fox; the quiet town"
    texts = ["the quiet brown fox", "zzz", "", None, "quick"]
    got = {r["item_id"]: r for r in blobs.dictionary_matches(spark.createDataFrame(list(enumerate(texts)), "item_id int, text string"), d).collect()}
    assert (got[0]["matches"], got[0]["covered"], got[0]["longest"]) == (2, 19, 10) and got[4]["longest"] == 5
    assert all(got[i]["matches"] == 0 for i in (1, 2, 3))


def test_states_move_as_they_should():
    assert flows.moved("Idle", "click") == "Idle" and flows.moved("Running", "click") == "Paused" and flows.moved("Paused", "view") == "Running"
    assert flows.moved("Paused", "purchase") == "Paused" and flows.moved("Running", "purchase") == "Completed" and flows.moved("Completed", "signup") == "Running" and flows.moved("Idle", "error") == "Cancelled"


def _plan(df) -> str:
    """The plan without cut lists, as it is before it is run."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_category_masks_rank_heads_in_the_row(spark):
    """one exchange by id and no window; ties by place, defaults for heads without a weight and for a null id."""
    rows = [(1, "Face", 0.0), (1, "Edge", 1.0), (1, "Color", 0.4), (2, "General", 0.0), (2, "Style", 0.4), (None, "Edge", 1.0)]
    df = series.category_masks(spark.createDataFrame(rows, "id long, head string, weight double"))
    want = {}
    for i in {r[0] for r in rows}:
        own = {h: w for j, h, w in rows if j == i and i is not None}
        order = sorted(range(10), key=lambda k: (list({**series.HEAD_DEFAULTS, **own}.values())[k], k))
        want[i] = "".join("1" if order.index(k) >= 4 else "0" for k in range(10))
    assert _plan(df).count("Exchange") == 1 and "Window" not in _plan(df)
    assert {r["id"]: r["active"] for r in df.collect()} == want


@pytest.mark.parametrize("name", ["category_masks", "head_weights", "category_hints", "prompt_categories"])
def test_keywords_are_sought_once_and_by_many_tasks(spark, name):
    """the rows of one file are dealt by key before keywords are sought, and each row's are sought once."""
    lines = _plan(QUERIES[name](spark, SF)).splitlines()
    sought = [i for i, line in enumerate(lines) if "contains(lower(" in line.lower()]
    assert len(sought) == 1 and any("REPARTITION_BY_NUM" in line for line in lines[sought[0] :])


def test_head_weights_of_repeated_ids(spark):
    """one exchange by id and no window; an id's prompts are summed up, each has the mandatory heads; ids without a category have those alone."""
    rows = [(1, ["Anime", "Portrait"]), (1, ["Object"]), (2, ["Mixed"]), (3, []), (4, None), (5, ["Abstract"]), (None, ["Fantasy"])]
    df = series.head_weights(spark.createDataFrame(rows, "id long, categories array<string>"))
    assert _plan(df).count("Exchange hashpartitioning") == 1 and "Window" not in _plan(df)
    want = []
    for i in dict.fromkeys(r[0] for r in rows):
        s = {}
        for c, n in [(c, n) for j, cs in rows if j == i for n, c in enumerate(cs or [])]:
            for h, w in series.HEAD_WEIGHTS.get(c, {}).items():
                s[h] = s.get(h, 0) + w / (n + 1)
        want += [(i, h, round(w / max(s.values()), 6)) for h, w in s.items() if h not in series.MANDATORY]
        want += [(i, h, 1.0) for h in series.MANDATORY] * sum(j == i for j, _ in rows)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_only_shared_grams_are_exchanged(spark, monkeypatch):
    """documents' n-grams meet the bench before any exchange; a large bench gives the same by exchanges."""
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(words[:12]), " ".join(words[:9] * 2), "w1 w2", None, "!", " ".join(words[20:]).upper(), " ".join(words[3:12])]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ", ".join(words[2:11])), (2, " ".join(words[21:29])), (3, None), (4, texts[0])], "item_id long, text string")
    df = similarity.shared_grams(docs, bench)
    lines = _plan(df).splitlines()
    join = next(i for i, line in enumerate(lines) if "BroadcastHashJoin" in line)
    assert not any("Exchange hashpartitioning" in line for line in lines[join:])
    want = {0: 5, 1: 2, 5: 1, 6: 2}
    assert {r["doc_id"]: r["shared"] for r in df.collect()} == want
    monkeypatch.setattr(similarity, "MOST_GRAMS", 0)
    assert {r["doc_id"]: r["shared"] for r in similarity.shared_grams(docs, bench).collect()} == want
