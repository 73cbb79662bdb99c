"""Loose JSON and Python literals as typed values."""

import ast
import json

from pyspark.sql import functions as F

from routeyard.functions import texts as T

SAME = [
    '{"a": [1, 2.5, true, null, {"b": "c"}]}', "{'a': [1, 2.5, True, None, {'b': 'c'}]}", "[1, 2, 3,]", "(1, 2)", "(1,)", "()", "('a',)",
    "('a')", "(('a'))", "[(1, (2, 'x')), {'k': (3,)}]", "'it\\'s'", "\"it's\"", "'say \"hi\"'", "'back\\\\slash'", "'end\\\\'", "'a\\x41\\n\\tb'",
    "'\\d+\\101'", "'tab\there'", "['None', 'True', 'a, ]', '(', \"it's (x,)\"]", "{'None': None, '(': ('[', ']')}", "True", "None", "12", "-3.5",
    "+4", "[.5, 1., -0.25, 1_000, 1e3]", "''", '""', "[]", "{}", "  [1]  ", "{'nested': {'deep': {'list': [[], [[]]]}}}", "['é', '\\u00e9', '日本']",
    "[\n 'line',\n 'break'\n]", "{'a': 'x', 'b': \"y'z\"}", "[True, False, None, 'true']",
]
TEXT = ["plain", "it's", "'open", "a, b", "[unquoted]", "{'a': true}", "[None, null]", "a.png;b.png", "(", "{1, 2}", "b'x'", "{'a' 'b'}", "x = 'y'", "1 2",
        "[1, 2", "{'a': 1, 'a': 2}", "True False", "https://x/y?a=(1)", "1] x", "1} x", "1, 2] x", '1, "b": 2', "[1] [2]", "[1]]", "{} {}"]


def test_values_equal_the_literal_reader(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(SAME)], "i int, t string")
    got = {r["i"]: r["v"] for r in rows.select("i", F.to_json(T.loose_value(F.col("t"))).alias("v")).collect()}
    for i, t in enumerate(SAME):
        try:
            want = json.loads(t.strip())
        except ValueError:
            want = ast.literal_eval(t.strip())
        assert json.loads(got[i]) == json.loads(json.dumps(want)), (t, got[i])


def test_other_text_stays_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXT)], "i int, t string")
    got = rows.select("i", F.schema_of_variant(T.loose_value(F.col("t"))).alias("k"), F.to_json(T.loose_value(F.col("t"))).alias("v")).collect()
    assert [(TEXT[r["i"]], r["k"], json.loads(r["v"])) for r in got] == [(t, "STRING", t) for t in TEXT]
    blank = spark.createDataFrame([(None,), ("",), (" \n",)], "t string")
    assert blank.filter(T.loose_value(F.col("t")).isNull()).count() == 3


def test_long_text(spark):
    row = spark.range(1).select(F.concat(F.lit("['"), F.repeat(F.lit("x"), 200_000), F.lit("', 7]")).alias("t"))
    v = T.loose_value(F.col("t"))
    got = row.select(F.length(F.variant_get(v, "$[0]", "string")).alias("n"), F.variant_get(v, "$[1]", "int").alias("x")).first()
    assert tuple(got) == (200_000, 7)
