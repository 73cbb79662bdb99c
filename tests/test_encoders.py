"""User encoders: made once per worker process, asked once per text."""

import os
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeyard.operators import encoders as EN


def logging_encoder(folder):
    """An encoder of a text's length that leaves a file per call of its factory and per batch."""
    def note(kind, value):
        with open(os.path.join(folder, f"{kind}-{os.getpid()}-{uuid.uuid4().hex}"), "w") as f:
            f.write(str(value))

    def factory():
        note("made", 1)

        def run(texts):
            note("texts", len(texts))
            return np.array([[len(t), 1.0] for t in texts])

        return run

    return factory


def notes(folder, kind):
    names = [n for n in os.listdir(folder) if n.startswith(kind)]
    return {n.split("-")[1] for n in names}, [int(open(os.path.join(folder, n)).read()) for n in names]


def test_every_text_is_encoded_once(spark, tmp_path):
    # a third of the rows hold one text, others hold a few, some none
    text = F.when(F.col("id") % 3 == 0, F.lit("same")).when(F.col("id") % 11 == 0, F.lit(None)).when(
        F.col("id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string")))
    rows = spark.range(3000).select("id", text.alias("a.b")).repartition(8)
    rows = rows.unionByName(rows.limit(5))
    got = EN.encode_distinct(rows, "a.b", logging_encoder(str(tmp_path)), normalize=False)
    found = got.collect()
    assert got.columns == ["id", "a.b", "embedding"] and len(found) == 3005
    assert all(r["embedding"] == (None if r["a.b"] is None else [len(r["a.b"]), 1.0]) for r in found)
    assert sum(notes(tmp_path, "texts")[1]) == rows.filter("`a.b` IS NOT NULL").select("`a.b`").distinct().count()
    assert got.count() == 3005 and sum(notes(tmp_path, "texts")[1]) == 52       # read again, not encoded again


def test_a_model_is_made_once_per_worker(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 40).select(F.concat(F.lit("text"), "id").alias("t"))
    rows.select(EN.encode(F.col("t"), logging_encoder(str(tmp_path))).alias("v")).write.format("noop").mode("overwrite").save()
    workers, made = notes(tmp_path, "made")
    batches = notes(tmp_path, "texts")[1]
    assert len(made) == len(workers) < 40 <= len(batches) and sum(batches) == 4000


def test_models_of_a_worker_are_bounded():
    made = []
    for key in ("a", "b", "a", "c", "a", "b"):
        EN.worker_model(key, lambda: made.append(key) or (lambda texts: texts))
    assert made == ["a", "b", "c", "b"]


def test_empty_table_and_clashing_name(spark, tmp_path):
    rows = spark.createDataFrame([], "id int, t string")
    assert EN.encode_distinct(rows, "t", logging_encoder(str(tmp_path))).count() == 0
    with pytest.raises(ValueError):
        EN.encode_distinct(rows, "t", logging_encoder(str(tmp_path)), output="id")


def test_text_vectors_grow_with_the_rows_only(spark):
    """The length is taken once per row: a row of 256 components costs about as much as two of 128."""
    rows = spark.range(400).select(F.col("id").cast("string").alias("sample_id"),
                                   F.array_join(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.concat(F.lit("w"), i * (F.col("id") + 7))), " ").alias("prompt"))
    rows = spark.createDataFrame(rows.collect(), rows.schema).repartition(4)
    EN.hashed_text_vectors(rows, 8).count()
    begun = time.monotonic()
    got = EN.hashed_text_vectors(rows, 1024).collect()
    assert time.monotonic() - begun < 30
    assert len(got) == 400 and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in got)


def test_long_texts_are_encoded_in_steps(spark):
    """No call takes more than about ``STEP_BYTES``, however large the batch; the rows keep their order."""
    def factory():
        return lambda texts: np.array([[len(t or ""), sum(len(x or "") for x in texts)] for t in texts], dtype="float64")

    rows = spark.range(0, 2000, 1, 1).select("id", F.when(F.col("id") != 7, F.repeat(F.lit("x"), (F.col("id") % 10_000 + 9000).cast("int"))).alias("t"))
    got = rows.select("id", EN.encode(F.col("t"), factory, normalize=False).alias("v")).collect()
    assert [r["v"][0] for r in got] == [0 if r["id"] == 7 else r["id"] + 9000 for r in got]
    assert max(r["v"][1] for r in got) < 2 * EN.STEP_BYTES
    counts = rows.select("id", EN.count_tokens(F.col("t"), lambda: len).alias("n")).collect()
    assert [r["n"] for r in counts] == [0 if r["id"] == 7 else r["id"] + 9000 for r in counts]
