"""Configuration files, splits, scratch folders and the file stream."""

import pytest
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard import runtime
from routeyard.plans.catalog import sources as sinks
from routeyard.runtime import scratch_path, shared_dir
from routeyard.sources import config, reports, results, tables
from routeyard.streaming.incremental import generations, merge_batch, read_cache, upsert_stream

PRICING = """
pricing:
  a: {type: token_based, input_price_per_1m: 0.5, output_price_per_1m: 1.5}
  b: {type: flat, usd_per_call: 1}
"""


def test_prices_and_models(tmp_path, spark):
    f = tmp_path / "pricing.yaml"
    f.write_text(PRICING)
    assert config.load_prices(str(f)) == {"a": (0.5, 1.5)}
    m = tmp_path / "models.yaml"
    m.write_text("models:\n  a: {aliases: [a, A1]}\n  b: {}\n")
    assert config.load_models(str(m), exclude=["b"]) == ["a"]
    assert config.load_models(str(tmp_path / "absent.yaml")) == list(V.DEFAULT_MODELS)
    got = {(r["alias"], r["model_id"]) for r in config.model_aliases(spark, str(m)).collect()}
    assert got == {("a", "a"), ("A1", "a"), ("b", "b")}


class FakeSession:
    def __init__(self, master, configured=None):
        self.sparkContext = self
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.master, self.applicationId = master, f"app-{master}"


def test_shared_dir():
    assert shared_dir(FakeSession("yarn", "hdfs://shared/ck/")) == "hdfs://shared/ck"
    local = FakeSession("local[2]")
    assert shared_dir(local) == shared_dir(local)
    assert scratch_path(local, "x") != scratch_path(local, "x")
    with pytest.raises(RuntimeError):
        shared_dir(FakeSession("yarn"))


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")]), (2.0, [3.0, 4.0])], "x double, v array<double>")
    assert [tuple(r) for r in reports.jsonable(df).collect()] == [(None, [1.0, None]), (2.0, [3.0, 4.0])]


def test_fixed_decimals(spark):
    df = spark.createDataFrame([(1.5, None, "t")], "x double, y double, z string")
    assert tuple(reports.fixed_decimals(df, 3).first()) == ("1.500", None, "t")


def test_layout_without_correctness_is_skipped(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([("1", "x")], "id string, note string").write.parquet(f"{root}/a/m0/m0_D_results.parquet")
    spark.createDataFrame([("1", 1)], "id string, hit int").write.parquet(f"{root}/b/m0/m0_D_results.parquet")
    got = results.read_results(spark, [(f"{root}/a/*/*", "parquet"), (f"{root}/b/*/*", "parquet")], ["m0"])
    assert [(r["sample_id"], r["quality"]) for r in got.collect()] == [("D/1", 1)]


def test_rows_without_id_are_numbered_per_file(spark, tmp_path):
    root = str(tmp_path)
    for m in ("m0", "m1"):
        spark.range(50).select((F.col("id") % 2).alias("hit")).coalesce(1).write.parquet(f"{root}/{m}/{m}_D_results.parquet")
    got = results.read_results(spark, [(f"{root}/*/*", "parquet")], ["m0", "m1"])
    ids = sorted((r["model_id"], int(r["sample_id"].split("/")[1]), r["quality"]) for r in got.collect())
    assert ids == [(m, i, i % 2) for m in ("m0", "m1") for i in range(50)]


def test_last_vector_wins(spark, tmp_path):
    root = str(tmp_path / "v")
    row = lambda x: spark.createDataFrame([("a", [x], "text", "e")], "sample_id string, embedding array<double>, modality string, encoder string")
    tables.write_vectors(row(1.0).unionByName(row(1.0)), root)
    assert tables.read_vectors(spark, root, "text", "e").count() == 1


def test_stream_upserts_new_files(spark, tmp_path):
    src, cache, ck = (str(tmp_path / n) for n in ("in", "cache", "ck"))
    schema = "sample_id string, v int"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        q = upsert_stream(spark, src, schema, cache, ck)
        q.awaitTermination(120)
        assert q.exception() is None

    put([("a", 1), ("b", 2)])
    run()
    put([("b", 3), ("c", 4)])
    run()
    got = {r["sample_id"]: r["v"] for r in read_cache(spark, cache, schema).collect()}
    assert got == {"a": 1, "b": 3, "c": 4}


def test_stream_starts_from_a_cache(spark, tmp_path):
    src, cache, ck, old = (str(tmp_path / n) for n in ("in", "cache", "ck", "old"))
    schema = "sample_id string, v int"
    spark.createDataFrame([("a", 1), ("z", 9)], schema).write.parquet(old)
    spark.createDataFrame([("a", 2)], schema).write.parquet(src)
    q = upsert_stream(spark, src, schema, cache, ck, start=old)
    q.awaitTermination(120)
    assert q.exception() is None
    assert {r["sample_id"]: r["v"] for r in read_cache(spark, cache, schema).collect()} == {"a": 2, "z": 9}


def test_batches_write_only_the_buckets_they_meet(spark, tmp_path):
    cache, schema = str(tmp_path / "cache"), "sample_id string, v int"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    state = lambda n=None: {r["sample_id"]: r["v"] for r in read_cache(spark, cache, schema, n).collect()}
    files = lambda n: sorted(str(p) for p in (tmp_path / "cache" / "data" / f"v{n}").rglob("*.parquet"))
    want = {f"k{i}": i for i in range(2000)}
    merge_batch(spark, frame([("k1", -1), (None, 5)]), cache, 0, start=frame(list(want.items())), buckets=32)
    want |= {"k1": -1, None: 5}
    assert state() == want and len(files(1)) == 32
    merge_batch(spark, frame([("k7", 70), ("k8", 80), ("new", 1)]), cache, 1, buckets=32)
    before, want = dict(want), want | {"k7": 70, "k8": 80, "new": 1}
    assert state() == want and state(1) == before and 1 <= len(files(2)) <= 3

    merge_batch(spark, frame([("k7", 70), ("k8", 80), ("new", 1)]), cache, 1, buckets=32)      # the batch is run again
    assert state() == want and generations(spark, cache) == [1, 2]
    merge_batch(spark, frame([]), cache, 2, buckets=32)                                        # nothing to do
    assert state() == want and files(3) == []
    for n in (3, 4):
        merge_batch(spark, frame([("k7", n)]), cache, n, buckets=32)
        assert state() == want | {"k7": n}
    assert generations(spark, cache) == [4, 5] and len(files(4)) == len(files(5)) == 1
    merge_batch(spark, frame([("k7", 5)]), cache, 5, buckets=32)
    assert files(4) == [] and len(files(1)) >= 29                    # replaced rows are gone, the rest never moved
    with pytest.raises(ValueError):
        merge_batch(spark, frame([("a", 1)]), cache, 9, buckets=32)
    assert read_cache(spark, str(tmp_path / "none"), schema).count() == 0


def test_model_pools_from_files(tmp_path):
    from routeyard.sources.config import load_models

    (tmp_path / "m.txt").write_text("a\n\n b \n")
    (tmp_path / "m.json").write_text('{"models": [{"name": "x"}, {"name": "y"}]}')
    assert load_models(str(tmp_path / "m.txt")) == ["a", "b"]
    assert load_models(str(tmp_path / "m.json"), exclude=["y"]) == ["x"]
    assert load_models(str(tmp_path / "none.txt"), count=2) == ["model_0", "model_1"]


def test_legacy_model_folder(spark):
    from routeyard.functions import names as N

    df = spark.createDataFrame([("/r/m1/T20251025_G/m1_X_result.csv",), ("/r/solo/solo_Y.csv",), ("f.csv",)], "p string")
    m = N.model_of_path(F.col("p"), ["m1"])
    got = [tuple(r) for r in df.select(m, N.dataset_of_path(F.col("p"), m)).collect()]
    assert got == [("m1", "X"), ("solo", "Y"), (None, None)]


def test_result_tables_take_little_disk(spark, tmp_path, monkeypatch):
    """Texts lie compressed, once per table that holds them; the joined table they are copied from is gone share by share."""
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path / "scratch"))
    words = F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.substring(F.md5(F.concat_ws("-", "id", i % 60)), 1, 6))
    docs = spark.range(0, 3000, 1, 24).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"), F.lit("en").alias("lang"),
                                              F.lit("s").alias("source"))
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        layouts = sinks._write_results(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / name).rglob("part-*"))
    text = 3000 * (300 * 7)
    assert size("scratch") == 0 and 0 < size("out") < 0.5 * 6 * text
    assert len(list((tmp_path / "out").glob("csv-index/m0/*/*/part-*"))) >= 3      # shares
    got = results.read_results(spark, layouts, ["m0", "m1", "m2", "m3", "m4", "m5", "m6", "m7"])
    assert got.groupBy("model_id").count().filter(F.col("count") == 3000).count() == 8
    prompts = got.filter(~F.col("model_id").isin("m2", "m3")).select(F.regexp_extract("sample_id", r"\d+$", 0).alias("i"), "prompt").distinct()
    assert prompts.exceptAll(docs.select(F.col("doc_id").cast("string"), "text")).count() == 0 and prompts.count() == 3000


def test_shares_of_a_stored_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda spark: str(tmp_path))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, left, seen = spark.conf.get(key), [], []
    for share in runtime.portions(spark.range(0, 100, 1, 9), "t"):
        seen += [r["id"] for r in share.collect()]
        left.append(len(list(tmp_path.rglob("part-*.parquet"))))
    assert sorted(seen) == list(range(100)) and left == [9, 4] and not list(tmp_path.rglob("part-*.parquet"))
    assert spark.conf.get(key) == before
    assert [s.count() for s in runtime.portions(spark.range(0), "t")] == [0]
