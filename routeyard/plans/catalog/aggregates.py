"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard import fixtures as D
from routeyard.functions.scores import hash_bucket
from routeyard.operators import calibration as K
from routeyard.operators import costs as C
from routeyard.operators import evaluate as E
from routeyard.operators import experiments as X
from routeyard.operators import features as FT
from routeyard.operators import integrity as I
from routeyard.operators import labels as L
from routeyard.operators import policies as P
from routeyard.operators import quantiles as Q
from routeyard.operators import registry as G
from routeyard.plans.catalog import mean_sql, query, round_columns, round_means, rounded_mean
from routeyard.plans.catalog.joins import COSTS_SQL, OUTPUT_SQL, RANDOM_SQL, full_output, strict
from routeyard.plans.catalog.sources import INPUT_SQL, input_tokens
from routeyard.runtime import scratch_path


def _five(c):
    return (f"round_even(avg({c}), 2) AS {c}_mean, round_even(stddev_samp({c}), 2) AS {c}_std, min({c}) AS {c}_min, "
            f"max({c}) AS {c}_max, sum({c})::BIGINT AS {c}_sum")


@query("a1_token_statistics", f""", {INPUT_SQL}
SELECT dataset, task_type, count(*) AS num_samples, {_five("text_tokens")}, {_five("image_tokens")},
       {_five("total_input_tokens")}, round_even(avg(num_images), 2) AS num_images_mean,
       sum(num_images)::BIGINT AS num_images_sum
FROM inputs GROUP BY GROUPING SETS ((dataset), (task_type))""")
def a1(spark, sf):
    return C.token_stats(input_tokens(spark, sf))


@query("a2_grand_totals", f""", {INPUT_SQL}, {OUTPUT_SQL},
i AS (SELECT count(*) AS samples, sum(text_tokens)::BIGINT AS text_tokens, sum(image_tokens)::BIGINT AS image_tokens,
             sum(total_input_tokens)::BIGINT AS input_tokens FROM inputs),
o AS (SELECT count(DISTINCT model) AS models, sum(output_tokens)::BIGINT AS output_tokens FROM outputs)
SELECT *, input_tokens + output_tokens AS grand_total, round(input_tokens / samples, 6) AS avg_input,
       round(output_tokens / (samples * models), 6) AS avg_output FROM i, o""")
def a2(spark, sf):
    return round_columns(C.token_totals(input_tokens(spark, sf), full_output(spark, sf)), 6, "avg_input", "avg_output")


@query("a3_output_by_model", f""", {OUTPUT_SQL}
SELECT model, round(avg(output_tokens), 6) AS avg_output_tokens, sum(output_tokens)::BIGINT AS total_output_tokens,
       round(avg(is_actual::INT), 6) AS actual_ratio FROM outputs GROUP BY model""")
def a3(spark, sf):
    return round_columns(C.output_by_model(full_output(spark, sf)), 6, "avg_output_tokens", "actual_ratio")


@query("a4_cost_by_model", f""", {COSTS_SQL}
SELECT model, round(sum(input_cost), 9) AS total_input_cost, round(sum(output_cost), 9) AS total_output_cost,
       {mean_sql("avg(total_cost)", "avg_cost_per_sample")}, round(sum(total_cost), 9) AS total_cost
FROM strict_costs GROUP BY ROLLUP (model)""")
def a4(spark, sf):
    out = C.cost_by_model(strict(spark, sf))
    out = round_columns(out, 9, "total_input_cost", "total_output_cost", "total_cost")
    return round_means(out, "avg_cost_per_sample")


_POINTS = list(V.TOKEN_PERCENTILES)
_TOKEN_COLUMNS = ["text_tokens", "image_tokens", "total_input_tokens"]


@query("a5_token_percentiles", f""", {INPUT_SQL}, p(percentile) AS (SELECT unnest({_POINTS}))
SELECT percentile, """ + ", ".join(
    f"round(CASE percentile {' '.join(f'WHEN {x} THEN quantile_cont({c}, {x / 100})' for x in _POINTS)} END, 6) AS {c}"
    for c in _TOKEN_COLUMNS) + " FROM inputs, p GROUP BY percentile")
def a5(spark, sf):
    return round_columns(Q.token_percentiles(input_tokens(spark, sf), _TOKEN_COLUMNS, _POINTS), 6, *_TOKEN_COLUMNS)


@query("a6_cost_spread", f""", {COSTS_SQL}
SELECT model, {mean_sql("avg(input_cost)", "avg_input")}, {mean_sql("avg(output_cost)", "avg_output")},
       {mean_sql("avg(total_cost)", "avg_total")}, round(min(total_cost), 10) AS min_cost,
       round(max(total_cost), 10) AS max_cost, round(sum(total_cost), 9) AS sum_cost
FROM strict_costs GROUP BY ROLLUP (model)""")
def a6(spark, sf):
    out = round_means(C.cost_spread(strict(spark, sf)), "avg_input", "avg_output", "avg_total")
    return round_columns(round_columns(out, 10, "min_cost", "max_cost"), 9, "sum_cost")


@query("a7_cost_health", f"""
, kept AS (SELECT CASE WHEN sample_id::BIGINT % 6 = 0 THEN 0 ELSE cost END AS cost FROM outcomes)
SELECT count(*) FILTER (cost > 0) AS nonzero, (SELECT count(*) * 8 FROM samples) - count(*) FILTER (cost > 0) AS zero,
       round(count(*) FILTER (cost > 0) / (SELECT count(*) * 8 FROM samples), 8) AS nonzero_share,
       round(min(cost) FILTER (cost > 0), 10) AS min_cost, round(max(cost) FILTER (cost > 0), 10) AS max_cost,
       {mean_sql("avg(cost) FILTER (cost > 0)", "mean_cost")},
       {mean_sql("quantile_cont(cost, 0.5) FILTER (cost > 0)", "median_cost")} FROM kept""")
def a7(spark, sf):
    i = F.col("sample_id").cast("bigint")
    cells = D.outcomes(spark, sf).withColumn("cost", F.when(i % 6 == 0, 0.0).otherwise(F.col("cost")))
    out = C.cost_health(cells, D.samples(spark, sf), len(D.MODELS))
    out = round_means(round_columns(out, 10, "min_cost", "max_cost"), "mean_cost", "median_cost")
    return round_columns(out, 8, "nonzero_share")


@query("a8_cost_bounds", f"""
, means AS (SELECT model_id, avg(cost) AS c FROM outcomes WHERE cost > 0 GROUP BY model_id)
SELECT {mean_sql("min(c)", "cmin")}, {mean_sql("max(c)", "cmax")}, arg_min(model_id, c) AS cmin_model,
       arg_max(model_id, c) AS cmax_model, count(*) AS models, {mean_sql("sum(c)", "total")} FROM means""")
def a8(spark, sf):
    b = C.cost_bounds(D.outcomes(spark, sf))
    costs = F.map_values("per_model_avg_costs")
    out = b.select("cmin", "cmax", "cmin_model", "cmax_model", F.size(costs).cast("bigint").alias("models"),
                   F.aggregate(costs, F.lit(0.0), lambda a, x: a + x).alias("total"))
    return round_means(out, "cmin", "cmax", "total")


@query("a9_score_pivot", "SELECT sample_id, " + ", ".join(
    f"arg_min(quality, priority) FILTER (model_id = '{m}') AS {m}" for m in D.SPARSE_MODELS)
    + " FROM sparse_outcomes GROUP BY sample_id")
def a9(spark, sf):
    return G.pivot_scores(D.sparse_outcomes(spark, sf), D.SPARSE_MODELS, ["priority"])


@query("a10_model_summary", f"""
SELECT split, model_id, round(avg(quality), 8) AS accuracy, {mean_sql("avg(cost)", "avg_cost")}, count(*) AS records
FROM outcomes JOIN meta USING (sample_id) GROUP BY GROUPING SETS ((model_id), (split, model_id))""")
def a10(spark, sf):
    out = G.model_summary(D.outcomes(spark, sf), D.meta(spark, sf))
    return round_means(round_columns(out, 8, "accuracy"), "avg_cost")


@query("a11_first_duplicate", """
SELECT sample_id, model_id, arg_min(quality, priority) AS quality, round(arg_min(cost, priority), 12) AS cost
FROM sparse_outcomes GROUP BY sample_id, model_id""")
def a11(spark, sf):
    out = G.keep_first(D.sparse_outcomes(spark, sf), ["sample_id", "model_id"], ["priority"], ["quality", "cost"])
    return round_columns(out, 12, "cost")


_KINDS = ", ".join(f"'{k}'" for k in V.RESULT_KIND_ORDER)


@query("a12_result_precedence", f"""
, files AS (SELECT l_orderkey::VARCHAR AS sample_id, 'm' || (l_suppkey % 17) AS model_id, (l_returnflag = 'A')::INT AS quality,
    [{_KINDS}][l_linenumber % 5 + 1] AS kind, l_shipdate::DATE::VARCHAR || '/' || l_suppkey AS file,
    row(l_linenumber, l_partkey, l_extendedprice, l_quantity, l_tax) AS row_num, l_partkey::VARCHAR AS prompt FROM lineitem),
ranked AS (SELECT *, row(list_position([{_KINDS}], kind), file, row_num) AS o FROM files),
q AS (SELECT sample_id, model_id, arg_max(quality, o) AS quality FROM ranked GROUP BY ALL),
p AS (SELECT sample_id, arg_min(prompt, o) AS prompt FROM ranked GROUP BY ALL)
SELECT sample_id, model_id, quality, prompt FROM q JOIN p USING (sample_id)""")
def a12(spark, sf):
    li = D.table(spark, sf, "lineitem")
    kinds = F.array(*[F.lit(k) for k in V.RESULT_KIND_ORDER])
    files = li.select(
        F.col("l_orderkey").cast("string").alias("sample_id"),
        F.concat(F.lit("m"), F.col("l_suppkey") % 17).alias("model_id"),
        (F.col("l_returnflag") == "A").cast("int").alias("quality"),
        F.element_at(kinds, F.col("l_linenumber") % 5 + 1).alias("kind"),
        F.concat_ws("/", F.col("l_shipdate").cast("date").cast("string"), "l_suppkey").alias("file"),
        F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_tax").alias("row_num"),
        F.col("l_partkey").cast("string").alias("prompt"), F.lit("").alias("image_path"))
    return G.resolve_results(files).join(G.resolve_sample_metadata(files).select("sample_id", "prompt"), "sample_id")


@query("a13_coverage", """
SELECT model_id, count(*) AS records, count(DISTINCT sample_id) AS samples FROM sparse_outcomes GROUP BY ROLLUP (model_id)""")
def a13(spark, sf):
    return G.coverage(D.sparse_outcomes(spark, sf).select("sample_id", "model_id"))


_EXPECTED = [f"m{i}" for i in range(1, 19)]


@query("a14_quality_integrity", f"""
, s AS (SELECT l_returnflag || l_linestatus AS dataset, l_orderkey AS sample_id, 'm' || (l_suppkey % 17) AS model_id FROM lineitem),
g AS (SELECT dataset, count(*) AS records, count(DISTINCT dataset || '|' || sample_id) AS samples, count(DISTINCT model_id) AS models,
      list_sort(list(DISTINCT model_id)) AS found FROM s WHERE NOT (dataset = 'AF' AND model_id = 'm3') GROUP BY GROUPING SETS ((dataset), ()))
SELECT dataset, records, samples, models, array_to_string(found, ' ') AS found_models,
       array_to_string(list_sort(list_filter({_EXPECTED!r}, lambda x: NOT list_contains(found, x))), ' ') AS missing_models,
       array_to_string(list_sort(list_filter(found, lambda x: NOT list_contains({_EXPECTED!r}, x))), ' ') AS extra_models FROM g""")
def a14(spark, sf):
    """Samples may have rows in several datasets; the overall row counts (dataset, sample) pairs once each."""
    li = D.table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("dataset"), F.col("l_orderkey").alias("sample_id"),
        F.concat(F.lit("m"), F.col("l_suppkey") % 17).alias("model_id"))
    out = I.quality_coverage(li.filter("NOT (dataset = 'AF' AND model_id = 'm3')"), _EXPECTED)
    text = lambda c: F.array_join(F.sort_array(c), " ").alias(c)
    return out.select("dataset", "records", "samples", "models", text("found_models"), text("missing_models"),
                      text("extra_models"))


@query("a15_sample_counts", "SELECT dataset, count(*) AS samples FROM samples GROUP BY ROLLUP (dataset)")
def a15(spark, sf):
    return I.sample_counts(D.samples(spark, sf))


@query("a16_split_check", """
, n AS (SELECT split, count(*) AS n, count(*) / sum(count(*)) OVER () AS ratio FROM meta GROUP BY split),
want(split, expected) AS (VALUES ('train', 0.7::DOUBLE), ('dev', 0.1::DOUBLE), ('test', 0.2::DOUBLE))
SELECT split, expected, n, round(ratio, 8) AS ratio, abs(ratio - expected) < 0.02 AS ok FROM want JOIN n USING (split)""")
def a16(spark, sf):
    return round_columns(I.split_check(D.meta(spark, sf)), 8, "ratio")


@query("a17_token_cost_check", f""", {COSTS_SQL}
SELECT model, count(*) AS records, {mean_sql("avg(total_cost)", "avg_cost")} FROM strict_costs GROUP BY model""")
def a17(spark, sf):
    return round_means(I.token_cost_check(strict(spark, sf)), "avg_cost")


@query("a18_cost_shape", f"""
, means AS (SELECT model_id, avg(cost) AS c FROM outcomes WHERE cost > 0 GROUP BY model_id)
SELECT count(DISTINCT model_id) AS num_models, count(DISTINCT sample_id) AS num_samples, round(min(cost), 10) AS min_cost,
       round(max(cost), 10) AS max_cost, {mean_sql("avg(cost)", "mean_cost")}, {mean_sql("(SELECT min(c) FROM means)", "cmin")},
       {mean_sql("(SELECT max(c) FROM means)", "cmax")} FROM outcomes""")
def a18(spark, sf):
    o = D.outcomes(spark, sf)
    out = round_columns(I.cost_shape(o, C.cost_bounds(o)), 10, "min_cost", "max_cost")
    return round_means(out, "mean_cost", "cmin", "cmax")


@query("a19_result_files", """
, pool AS (SELECT model_id FROM models UNION ALL SELECT 'm8'),
found AS (SELECT model_id, count(DISTINCT dataset) AS n FROM predictions WHERE quality = 1 GROUP BY model_id)
SELECT model_id, COALESCE(n, 0) AS result_files, n IS NOT NULL AS exists FROM pool LEFT JOIN found USING (model_id)""")
def a19(spark, sf):
    """Tables under each model's folder, one per dataset it answers; every part file of a table counts once."""
    root = scratch_path(spark, "a19")
    right = D.predictions(spark, sf).filter("quality = 1").select("sample_id", "quality", "model_id", "dataset")
    right.write.partitionBy("model_id", "dataset").parquet(root)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*")
             .load(root).select(F.regexp_replace(F.regexp_replace("path", "/part-[^/]*$", ""), "/[a-z_]+=", "/")
                                .alias("path")).distinct())
    return I.files_per_model(files, [*D.MODEL_IDS, "m8"])


BOUNDS_SQL = """bounds AS (SELECT min(c) AS cmin, max(c) AS cmax FROM
    (SELECT avg(cost) AS c FROM outcomes WHERE cost > 0 GROUP BY model_id))"""


def rank_sql(acc="accuracy", cost="avg_cost", beta="0.1"):
    c = (f"least(greatest((log2(cmax) - log2(least(greatest({cost}, cmin), cmax))) "
         f"/ (log2(cmax) - log2(cmin) + 1e-12), 0), 1)")
    return f"((1 + {beta}::DOUBLE) * {acc} * {c} / ({beta}::DOUBLE * {acc} + {c} + 1e-12))"


_SCORE = """avg(COALESCE(quality, 0)) AS accuracy, avg(COALESCE(cost, 0)) AS avg_cost,
    sum(COALESCE(quality, 0))::BIGINT AS num_correct, count(*) AS num_samples"""
SCORE_COLS = f"""round(accuracy, 8) AS accuracy, {mean_sql("avg_cost", "avg_cost")}, num_correct, num_samples,
    round({rank_sql()}, 8) AS rank_score"""


def score_rounded(df):
    return round_means(round_columns(df, 8, "accuracy", "rank_score"), "avg_cost")


@query("a20_router_score", f""", {RANDOM_SQL}, {BOUNDS_SQL},
g AS (SELECT {_SCORE} FROM choice LEFT JOIN outcomes USING (sample_id, model_id)) SELECT {SCORE_COLS} FROM g, bounds""")
def a20(spark, sf):
    o = D.outcomes(spark, sf)
    return score_rounded(E.score(E.gather(P.random_route(D.samples(spark, sf), D.MODEL_IDS), o), C.cost_bounds(o)))


BY_DATASET_SQL = f"""{RANDOM_SQL}, {BOUNDS_SQL},
odd AS (SELECT sample_id, dataset, CASE WHEN sample_id::BIGINT % 10 = 0 THEN 'm99' ELSE model_id END AS model_id
        FROM choice JOIN samples USING (sample_id)),
g AS (SELECT dataset, {_SCORE} FROM odd LEFT JOIN outcomes USING (sample_id, model_id) GROUP BY dataset),
by_dataset AS (SELECT dataset, {SCORE_COLS} FROM g, bounds)"""


def by_dataset(spark, sf):
    """A tenth of the decisions names a model nobody knows: wrong, at cost 0."""
    o = D.outcomes(spark, sf)
    d = P.random_route(D.samples(spark, sf), D.MODEL_IDS).withColumn(
        "model_id", F.when(F.col("sample_id").cast("bigint") % 10 == 0, "m99").otherwise(F.col("model_id")))
    g = E.gather(d, o).join(D.samples(spark, sf).select("sample_id", "dataset"), "sample_id")
    return score_rounded(E.score(g, C.cost_bounds(o), ["dataset"]))


@query("a21_score_by_dataset", f", {BY_DATASET_SQL} SELECT * FROM by_dataset")
def a21(spark, sf):
    return by_dataset(spark, sf).orderBy(F.col("rank_score").desc(), "dataset")


LABEL_SQL = """labels1 AS (SELECT sample_id, arg_min(model_id, row(-quality, cost, model_id)) AS model_id
    FROM outcomes GROUP BY sample_id)"""


def soft_sql(lam, name="soft", scale=100, weight=None):
    lw = weight or f"-{lam}::DOUBLE * {scale} * cost"
    return f"""{name}_lw AS (SELECT *, {lw} AS lw, max(quality) OVER w AS any_ok,
    row_number() OVER (PARTITION BY sample_id ORDER BY quality DESC, cost, model_id) = 1 AS first
    FROM outcomes WINDOW w AS (PARTITION BY sample_id)),
{name}_w AS (SELECT *, CASE WHEN quality > 0 THEN exp(lw - max(lw) FILTER (quality > 0) OVER (PARTITION BY sample_id)) END AS e FROM {name}_lw),
{name} AS (SELECT sample_id, model_id, quality, cost, CASE WHEN any_ok > 0 THEN COALESCE(e, 0) / sum(e) OVER (PARTITION BY sample_id)
    ELSE first::INT END AS target FROM {name}_w)"""


@query("a22_target_diagnostics", f""", {soft_sql(5.0)}, {LABEL_SQL},
per AS (SELECT s.sample_id, sum(-target * ln(target + 1e-12)) AS entropy, sum((target > 0.01)::INT) AS active,
        max(quality) AS ok, max(target) FILTER (s.model_id = l.model_id) AS on_cheapest
        FROM soft s JOIN labels1 l USING (sample_id) GROUP BY s.sample_id)
SELECT round(avg(entropy), 7) AS mean_entropy, round(stddev_pop(entropy), 7) AS std_entropy, round(ln(8), 7) AS max_entropy,
       round(avg(exp(entropy)), 7) AS mean_effective_k, round(avg(on_cheapest), 7) AS mean_prob_cheapest_correct,
       round(quantile_cont(on_cheapest, 0.5), 7) AS median_prob_cheapest_correct, round(avg(active), 7) AS mean_active_models,
       round(100 * avg((ok = 0)::INT), 7) AS pct_no_correct FROM per""")
def a22(spark, sf):
    o = D.stored_outcomes(spark, sf)
    out = L.target_diagnostics(L.soft_targets(o, 5.0), o)
    return round_columns(out, 7, *out.columns)


def type_sql(text="' ' || prompt || '     '", dataset="dataset"):
    """The query-type rules as a CASE expression."""
    esc = lambda t: t.replace("'", "''")
    hay = f"lower({text} || ' ' || {dataset})"
    any_of = lambda s, keys: "(" + " OR ".join(f"contains({s}, '{esc(k)}')" for k in keys) + ")"
    rules = [f"WHEN {any_of(f'lower({dataset})', k)} THEN '{n}'" for n, k in V.DATASET_RULES]
    rules += [f"WHEN {any_of(hay, k)} THEN '{n}'" for n, k in V.TEXT_RULES]
    return "CASE " + " ".join(rules) + " ELSE 'general' END"


TYPES_SQL = f"types AS (SELECT sample_id, {type_sql()} AS query_type FROM samples)"


def typed(spark, sf):
    return FT.with_query_type(D.samples(spark, sf).drop("image_path")).select("sample_id", "query_type")


_PROFILE = ["acc", "cost", "std", *[f"{k}_{q}" for q in V.QUERY_TYPES for k in ("acc", "cost")]]
PROFILE_SQL = f"""profiles AS (SELECT model_id, [avg(quality), avg(cost), stddev_pop(cost), """ + ", ".join(
    f"COALESCE(avg(quality) FILTER (query_type = '{q}'), avg(quality)), "
    f"COALESCE(avg(cost) FILTER (query_type = '{q}'), avg(cost))" for q in V.QUERY_TYPES) + """] AS profile
    FROM outcomes JOIN types USING (sample_id) GROUP BY model_id)"""


def profile_columns(df):
    return df.select("model_id", *[rounded_mean(F.col("profile")[i]).alias(n)
                                   for i, n in enumerate(_PROFILE)])


PROFILE_COLS = ", ".join(mean_sql(f"profile[{i + 1}]", n) for i, n in enumerate(_PROFILE))


@query("a23_model_profiles", f", {TYPES_SQL}, {PROFILE_SQL} SELECT model_id, {PROFILE_COLS} FROM profiles")
def a23(spark, sf):
    return profile_columns(FT.model_profiles(D.outcomes(spark, sf), typed(spark, sf)))


def pairs(spark, sf, outcomes=None):
    """Failure labels with a probability in steps of 1/512, some of it exactly 0 or 1."""
    o = D.outcomes(spark, sf) if outcomes is None else outcomes
    noise = hash_bucket(F.concat_ws("|", F.lit("p"), "sample_id", "model_id")) % 385
    return o.select("sample_id", "model_id", (F.lit(1) - F.col("quality")).cast("double").alias("label"),
                    ((noise + (F.lit(1) - F.col("quality")) * 128) / F.lit(512.0)).alias("p"))


PAIRS_SQL = f"""pairs AS (SELECT sample_id, model_id, (1 - quality)::DOUBLE AS label,
    ({D.bucket_sql("'p|' || sample_id || '|' || model_id")} % 385 + (1 - quality) * 128) / 512 AS p FROM outcomes)"""


@query("a24_brier_score", f", {PAIRS_SQL} SELECT round(avg((p - label) * (p - label)), 10) AS brier FROM pairs")
def a24(spark, sf):
    return round_columns(K.brier_score(pairs(spark, sf)), 10, "brier")


ECE_SQL = """bins AS (SELECT least(floor(p * 15), 14) AS bin, count(*) AS n, avg(p) AS c, avg(label) AS f FROM pairs GROUP BY 1)"""


@query("a25_calibration_error", f", {PAIRS_SQL}, {ECE_SQL} SELECT round(sum(n * abs(c - f)) / sum(n), 10) AS ece FROM bins")
def a25(spark, sf):
    return round_columns(K.calibration_error(pairs(spark, sf)), 10, "ece")


AUC_SQL = """ranked AS (SELECT label, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM pairs),
auc AS (SELECT (sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auc FROM ranked)"""


@query("a26_failure_auc", f", {PAIRS_SQL}, {AUC_SQL} SELECT round(auc, 10) AS auc FROM auc")
def a26(spark, sf):
    return round_columns(K.failure_auc(pairs(spark, sf)), 10, "auc")


def chosen(spark, sf):
    """The random policy's choices with their risk; a third of them shares one risk value."""
    d = P.random_route(D.samples(spark, sf), D.MODEL_IDS)
    p = pairs(spark, sf).select("sample_id", "model_id", (F.lit(1.0) - F.col("label")).alias("correct"), "p")
    tied = F.when(F.col("sample_id").cast("bigint") % 3 == 0, F.lit(0.5)).otherwise(F.col("p"))
    return d.join(p, ["sample_id", "model_id"]).select("sample_id", tied.alias("risk"), "correct")


CHOSEN_SQL = f"""{RANDOM_SQL}, {PAIRS_SQL}, chosen AS (SELECT sample_id, 1 - label AS correct,
    CASE WHEN sample_id::BIGINT % 3 = 0 THEN 0.5 ELSE p END AS risk FROM choice JOIN pairs USING (sample_id, model_id)),
run AS (SELECT *, row_number() OVER w AS seen, avg(correct) OVER w AS a, count(*) OVER () AS n FROM chosen
    WINDOW w AS (ORDER BY risk, {D.bucket_sql("sample_id")}, sample_id ROWS UNBOUNDED PRECEDING))"""


@query("a27_risk_coverage", f""", {CHOSEN_SQL}, steps AS (SELECT a, n, lag(a) OVER (ORDER BY seen) AS prev FROM run)
SELECT round(sum((COALESCE(prev, a) + a) / 2) / max(n), 10) AS area FROM steps""")
def a27(spark, sf):
    return round_columns(K.risk_coverage_auc(chosen(spark, sf)), 10, "area")


@query("a28_router_summary", f""", {RANDOM_SQL}, {BOUNDS_SQL}, {PAIRS_SQL}, {ECE_SQL}, {AUC_SQL},
g AS (SELECT avg(quality) AS accuracy, avg(cost) + 1e-5 AS avg_cost, avg(cost) AS model_avg_cost, sum(cost + 1e-5) AS total_cost,
      sum(quality)::BIGINT AS num_correct, count(*) AS num_samples FROM choice JOIN outcomes USING (sample_id, model_id)),
best AS (SELECT arg_min(quality, row(-quality, cost, model_id)) AS quality, arg_min(cost, row(-quality, cost, model_id)) AS cost
         FROM outcomes GROUP BY sample_id),
points AS (SELECT avg(quality) AS pa, avg(cost) AS pc FROM outcomes GROUP BY model_id),
run AS (SELECT row_number() OVER w AS seen, avg(1 - label) OVER w AS a, count(*) OVER () AS n
        FROM choice JOIN pairs USING (sample_id, model_id)
        WINDOW w AS (ORDER BY p, {D.bucket_sql("sample_id")}, sample_id ROWS UNBOUNDED PRECEDING)),
steps AS (SELECT a, n, lag(a) OVER (ORDER BY seen) AS prev FROM run)
SELECT {SCORE_COLS}, round(model_avg_cost, 10) AS model_avg_cost, round(total_cost, 9) AS total_cost,
       round((SELECT avg(quality) FROM best), 8) AS oracle_accuracy, round((SELECT avg(cost) FROM best), 10) AS oracle_avg_cost,
       round((SELECT avg(quality) FROM best) - accuracy, 8) AS oracle_gap,
       round((SELECT max(pa) FROM points WHERE pc <= avg_cost + 1e-12), 8) AS matched_cost_accuracy,
       round(((SELECT min(pc) FROM points WHERE pa >= accuracy - 1e-12) - avg_cost) / (SELECT min(pc) FROM points WHERE pa >= accuracy - 1e-12), 8) AS matched_accuracy_cost_reduction,
       (SELECT round(auc, 8) FROM auc) AS failure_auc, (SELECT round(avg((p - label) * (p - label)), 8) FROM pairs) AS brier,
       (SELECT round(sum(n * abs(c - f)) / sum(n), 8) FROM bins) AS ece,
       (SELECT round(sum((COALESCE(prev, a) + a) / 2) / max(n), 8) FROM steps) AS risk_coverage_auc,
       (SELECT round(avg(p), 8) FROM pairs) AS risk_mean, (SELECT round(stddev_pop(p), 8) FROM pairs) AS risk_std
FROM g, bounds""")
def a28(spark, sf):
    o = D.stored_outcomes(spark, sf)
    points = o.groupBy(F.col("model_id").alias("router")).agg(F.avg("quality").alias("accuracy"), F.avg("cost").alias("avg_cost"))
    out = E.summary(P.random_route(D.samples(spark, sf), D.MODEL_IDS), o, C.cost_bounds(o),
                    K.frontier_points(points), pairs(spark, sf, o).select("sample_id", "model_id", F.col("p").alias("risk")),
                    overhead=1e-5)
    out = round_columns(round_means(out, "avg_cost"), 10, "model_avg_cost", "oracle_avg_cost")
    out = round_columns(out, 9, "total_cost")
    return round_columns(out, 8, "accuracy", "rank_score", "oracle_accuracy", "oracle_gap", "matched_cost_accuracy",
                         "matched_accuracy_cost_reduction", "failure_auc", "risk_coverage_auc", "brier", "ece", "risk_mean", "risk_std")


def fused(spark, sf):
    return D.features(spark, sf).select("sample_id", F.concat("text_vec", "image_vec").alias("vec"))


MOMENTS_SQL = """fused AS (SELECT sample_id, list_concat(text_vec, image_vec) AS v FROM features),
dims AS (SELECT i, avg(v[i]) AS mean, CASE WHEN stddev_pop(v[i]) < 1e-6 THEN 1 ELSE stddev_pop(v[i]) END AS std
         FROM fused, range(1, 65) t(i) GROUP BY i)"""


@query("a29_standardizer", f", {MOMENTS_SQL} SELECT i - 1 AS dim, round(mean, 9) AS mean, round(std, 9) AS std FROM dims")
def a29(spark, sf):
    s = FT.fit_standardizer(fused(spark, sf), "vec")
    z = s.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "x"))
    return z.select(F.col("dim").cast("bigint").alias("dim"), F.round("x.mean", 9).alias("mean"),
                    F.round("x.std", 9).alias("std"))


@query("a30_model_prototypes", f""", {MOMENTS_SQL},
pool AS (SELECT model_id FROM models UNION ALL SELECT 'm8'),
own AS (SELECT model_id, i, avg(v[i]) AS x FROM fused JOIN outcomes USING (sample_id), range(1, 65) t(i)
        WHERE quality > 0 GROUP BY ALL)
SELECT pool.model_id, i - 1 AS dim, round(COALESCE(x, mean), 9) AS x FROM pool CROSS JOIN dims LEFT JOIN own USING (model_id, i)""")
def a30(spark, sf):
    p = FT.prototypes(fused(spark, sf), D.outcomes(spark, sf), [*D.MODEL_IDS, "m8"], normalize=False)
    return p.select("model_id", F.posexplode("v").alias("dim", "x")).select(
        "model_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 9).alias("x"))


@query("a31_cost_range", """
SELECT model_id, round(min(cost), 10) AS cost_min, round(max(cost), 10) AS cost_max FROM outcomes GROUP BY model_id""")
def a31(spark, sf):
    g = D.outcomes(spark, sf).groupBy("model_id").agg(F.min("cost").alias("cost_min"), F.max("cost").alias("cost_max"))
    return round_columns(g, 10, "cost_min", "cost_max")


@query("a32_query_type_counts", f", {TYPES_SQL} SELECT query_type, count(*) AS n FROM types GROUP BY query_type")
def a32(spark, sf):
    return X.query_type_counts(typed(spark, sf))


_LATENCY = ["ms_mean", "ms_std", "ms_min", "ms_max", "p50", "p95", "p99", "ms_per_sample", "ms_per_token",
            "samples_per_sec", "tokens_per_sec"]
LATENCY_SQL = """lat AS (SELECT router, batch_size, count(*) AS runs, avg(ms) AS ms_mean, stddev_pop(ms) AS ms_std, min(ms) AS ms_min,
    max(ms) AS ms_max, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, quantile_cont(ms, 0.99) AS p99,
    avg(ms) / batch_size AS ms_per_sample, avg(ms / tokens) AS ms_per_token, batch_size * 1000 / avg(ms) AS samples_per_sec,
    sum(tokens) * 1000 / sum(ms) AS tokens_per_sec FROM run_log GROUP BY router, batch_size)"""


@query("a33_latency_summary", f", {LATENCY_SQL} SELECT router, batch_size, runs, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _LATENCY) + " FROM lat")
def a33(spark, sf):
    return round_columns(Q.latency_summary(D.run_log(spark, sf)), 6, *_LATENCY)


@query("a33_latency_headline", f""", {LATENCY_SQL} SELECT router, min(batch_size) AS batch_size,
       round(arg_min(ms_per_sample, batch_size), 6) AS ms_per_sample, round(arg_min(ms_per_token, batch_size), 6) AS ms_per_token,
       round(arg_min(tokens_per_sec, batch_size), 6) AS tokens_per_sec FROM lat GROUP BY router""")
def a33_headline(spark, sf):
    return round_columns(Q.latency_headline(Q.latency_summary(D.run_log(spark, sf))), 6,
                         "ms_per_sample", "ms_per_token", "tokens_per_sec")


@query("a34_normalized_scores", """
SELECT sample_id, model_id, round(COALESCE(quality / nullif(sum(quality) OVER (PARTITION BY sample_id), 0), 0), 9) AS target FROM outcomes""")
def a34(spark, sf):
    return round_columns(L.normalized_scores(D.outcomes(spark, sf)), 9, "target")


def _pooling_sql(expr):
    return f"""
, pieces AS (SELECT label::VARCHAR AS sample_id, vec_id AS position, embedding::DOUBLE[] AS v FROM embeddings WHERE label < 8),
parts AS (SELECT sample_id, i, {expr} AS x, count(*) AS n FROM pieces, range(1, 65) t(i) GROUP BY ALL),
pooled AS (SELECT sample_id, list(x ORDER BY i) AS v, max(n) AS n FROM parts GROUP BY sample_id),
ids AS (SELECT DISTINCT label::VARCHAR AS sample_id FROM embeddings)
SELECT sample_id, i - 1 AS dim, round(CASE WHEN v IS NULL THEN 0 WHEN n > 1 THEN v[i] / sqrt(list_dot_product(v, v)) ELSE v[i] END, 8) AS x
FROM ids LEFT JOIN pooled USING (sample_id), range(1, 65) t(i)"""


def _pooling(spark, sf, how):
    e = D.table(spark, sf, "embeddings")
    ids = e.select(F.col("label").cast("string").alias("sample_id")).distinct()
    pieces = e.filter("label < 8").select(F.col("label").cast("string").alias("sample_id"),
                                          F.col("vec_id").alias("position"),
                                          F.col("embedding").cast("array<double>").alias("vec"))
    out = FT.pool_vectors(pieces, ids, 64, how)
    return out.select("sample_id", F.posexplode("vec").alias("dim", "x")).select(
        "sample_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 8).alias("x"))


@query("a35_pooling_mean", _pooling_sql("avg(v[i])"))
def a35_mean(spark, sf):
    return _pooling(spark, sf, "mean")


@query("a35_pooling_max", _pooling_sql("max(v[i])"))
def a35_max(spark, sf):
    return _pooling(spark, sf, "max")


@query("a35_pooling_first", _pooling_sql("arg_min(v[i], position)"))
def a35_first(spark, sf):
    return _pooling(spark, sf, "first")


@query("a36_label_agreement", f""", {RANDOM_SQL}, {LABEL_SQL}
SELECT round(avg((c.model_id = l.model_id)::INT), 8) AS agreement, count(*) AS num_samples
FROM choice c JOIN labels1 l USING (sample_id)""")
def a36(spark, sf):
    d = P.random_route(D.samples(spark, sf), D.MODEL_IDS)
    return round_columns(E.label_agreement(d, L.hard_labels(D.outcomes(spark, sf))), 8, "agreement")


@query("a37_choice_distribution", f""", {LABEL_SQL}, pool AS (SELECT model_id FROM models UNION ALL SELECT 'm8')
SELECT pool.model_id, count(l.sample_id) AS n FROM pool LEFT JOIN labels1 l USING (model_id) GROUP BY ALL""")
def a37(spark, sf):
    return E.choice_distribution(L.hard_labels(D.outcomes(spark, sf)), [*D.MODEL_IDS, "m8"])
