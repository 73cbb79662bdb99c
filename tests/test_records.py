"""Quoted tables cut into pieces anywhere, also inside values."""

import csv
import gzip
import random

import pytest
from pyspark.sql import functions as F

from routeyard.sources import records, results, tables
from routeyard.sources.records import PLACE, read_quoted

WORDS = ["a", "line\nbreak", 'a "quoted" word', "", "x" * 90, "\n\n", ",;\t", "end\r\nof line", '"', "Zeile für Zeile"]


def rows_of(n, seed):
    rng = random.Random(seed)
    return [(str(i), rng.choice(WORDS) + rng.choice(WORDS), rng.choice(WORDS)) for i in range(n)]


def write(path, rows, sep=",", end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="") as f:
        out = csv.writer(f, delimiter=sep, lineterminator=end, quoting=csv.QUOTE_ALL)
        out.writerow(["id", "text", "more, or less"])
        out.writerows(rows)


@pytest.fixture
def small_pieces(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("sep, end", [(",", "\n"), ("\t", "\r\n")])
def test_records_equal_those_of_a_plain_reader(spark, tmp_path, small_pieces, sep, end):
    files = {f"{name}.csv": rows_of(n, n) for name, n in (("a", 60), ("b", 25), ("none", 0))}
    for name, rows in files.items():
        write(tmp_path / "t" / name, rows, sep, end)
    got = read_quoted(spark, str(tmp_path / "t"), sep)
    assert got.columns == [*PLACE, "id", "text", "more, or less"]
    assert spark.read.text(str(tmp_path / "t")).rdd.getNumPartitions() > 10 * len(files)
    found = got.select(F.element_at(F.split("__file", "/"), -1).alias("f"), *got.columns).orderBy("f", *PLACE[1:]).collect()
    assert len({r["__piece"] for r in found}) > 10
    for name, rows in files.items():
        # an empty value is NULL, as in Spark's own reader
        assert [tuple(r)[4:] for r in found if r["f"] == name] == [tuple(v or None for v in r) for r in rows]


def test_one_record_over_many_pieces_and_an_open_quote(spark, tmp_path, small_pieces):
    long = "\n".join(f"line {i}" for i in range(500))
    write(tmp_path / "t" / "a.csv", [("1", long, "m"), ("2", "b", "m")])
    with open(tmp_path / "t" / "a.csv", "a") as f:
        f.write('\n  \n3,plain,\n"4","open\nrest\n')
    got = {r["id"]: (r["text"], r["more, or less"]) for r in read_quoted(spark, str(tmp_path / "t")).collect()}
    assert got["1"] == (long, "m") and got["2"] == ("b", "m") and got["3"] == ("plain", None)
    assert set(got) == {"1", "2", "3", "4"} and got["4"][0].startswith("open\nrest")


def test_many_tasks_read_one_file(spark, tmp_path):
    rows = [(str(i), f"first {i}\nsecond", "m") for i in range(20000)]
    write(tmp_path / "t" / "a.csv", rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = read_quoted(spark, str(tmp_path / "t"))
        assert got.agg(F.count_distinct("__piece")).first()[0] > 8
        assert sorted(tuple(r) for r in got.drop(*PLACE).collect()) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_are_not_shuffled(spark, tmp_path):
    """Only counts per piece and the fragments that borders cut cross an exchange."""
    write(tmp_path / "t" / "a.csv", [(str(i), f"first {i}\nsecond", "m") for i in range(20000)])
    got = read_quoted(spark, str(tmp_path / "t"))
    counts = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    exchanges = [part for part in counts.split("\n\n") if "Exchange\n" in part]
    assert exchanges and not any("value#" in part for part in exchanges)


def test_asset_rows_with_line_breaks(spark, tmp_path, small_pieces):
    rows = spark.createDataFrame([(str(i), f"k{i}", f"a\n{i}\t\"b\"") for i in range(40)], "index string, id string, image string")
    tables.write_asset_table(rows, str(tmp_path / "t"))
    got = tables.read_asset_table(spark, str(tmp_path / "t"), line_breaks=True)
    assert got.columns == rows.columns and got.exceptAll(rows).count() == 0 and got.count() == 40
    assert tables.read_asset_table(spark, str(tmp_path / "t"), line_breaks=True, split=False).exceptAll(got).count() == 0


def test_results_without_ids_are_numbered(spark, tmp_path, small_pieces):
    for m in ("m0", "m1"):
        path = tmp_path / m / f"{m}_D_results.csv"
        path.parent.mkdir(parents=True)
        path.write_text("hit,question\n" + "".join(f'{i % 2},"say\n{i}"\n' for i in range(50)))
    got = results.read_results(spark, [(f"{tmp_path}/*/*", "csv-quoted")], ["m0", "m1"])
    ids = sorted((r["model_id"], int(r["sample_id"].split("/")[1]), r["quality"], r["prompt"]) for r in got.collect())
    assert ids == [(m, i, i % 2, f"say\n{i}") for m in ("m0", "m1") for i in range(50)]


def test_compressed_files_equal_plain_ones_and_are_scanned_once(spark, tmp_path, small_pieces, monkeypatch):
    """Files in one piece meet no other piece: neither counts nor fragments of theirs are read."""
    for name, n in (("a", 60), ("b", 25), ("none", 0)):
        write(tmp_path / "t" / f"{name}.csv", rows_of(n, n), end="\r\n")
    with open(tmp_path / "t" / "a.csv", "a") as f:
        f.write('\n  \n98,plain,\n"99","open\nrest\n')
    (tmp_path / "z").mkdir()
    (tmp_path / "mixed").mkdir()
    for f in (tmp_path / "t").iterdir():
        for folder in ("z", "mixed"):
            if folder == "z" or f.name == "a.csv":
                (tmp_path / folder / f"{f.name}.gz").write_bytes(gzip.compress(f.read_bytes()))
            else:
                (tmp_path / folder / f.name).write_bytes(f.read_bytes())

    def found(folder):
        rows = read_quoted(spark, str(tmp_path / folder)).withColumn("__file", F.regexp_extract("__file", r"(\w+)\.csv", 1))
        return [(r["__file"], *tuple(r)[3:]) for r in sorted(rows.collect(), key=lambda r: tuple(r)[:3])]

    want = found("t")
    assert len(want) == 87 and found("z") == want and found("mixed") == want
    seen, plain = spark.sparkContext.accumulator(0), records._found

    def counted(batches):
        def told():
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return plain(told())

    monkeypatch.setattr(records, "_found", counted)
    assert found("z") == want
    assert seen.value == sum(len(f.read_bytes().split(b"\n")[:-1]) for f in (tmp_path / "t").iterdir())
