"""Scalar, string and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard import fixtures as D
from routeyard.functions import names as N
from routeyard.functions import scores as S
from routeyard.functions import texts as T
from routeyard.functions import tokens as K
from routeyard.functions import vectors as X
from routeyard.operators import costs as C
from routeyard.operators import encoders as EN
from routeyard.operators import evaluate as E
from routeyard.operators import features as FT
from routeyard.plans.catalog import query, round_columns
from routeyard.plans.catalog.aggregates import BOUNDS_SQL, TYPES_SQL, rank_sql, type_sql
from routeyard.plans.catalog.sources import _vectors

_W = V.WORDS_TO_TOKENS


@query("f1_text_tokens", f"""
SELECT 'doc-' || sample_id AS id, floor(words * {_W}::DOUBLE)::BIGINT AS tokens FROM samples UNION ALL
SELECT 'conv-' || conv_id || '-' || turn, floor(len(regexp_extract_all(text, '{V.WORD_PATTERN}')) * {_W}::DOUBLE)::BIGINT FROM conversations
UNION ALL SELECT 'page-' || page_id, floor(len(regexp_extract_all(html, '{V.WORD_PATTERN}')) * {_W}::DOUBLE)::BIGINT FROM pages""")
def f1(spark, sf):
    t = lambda n: D.table(spark, sf, n)
    tokens = lambda c: K.text_tokens(F.col(c)).alias("tokens")
    return (t("documents").select(F.concat_ws("-", F.lit("doc"), "doc_id").alias("id"), tokens("text"))
            .unionByName(t("conversations").select(
                F.concat_ws("-", F.lit("conv"), "conv_id", "turn").alias("id"), tokens("text")))
            .unionByName(t("pages").select(F.concat_ws("-", F.lit("page"), "page_id").alias("id"), tokens("html"))))


@query("f2_image_tokens", """
, sized AS (SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size * 40 END AS w, (p_partkey % 50 + 1) * 30 AS h,
  ['clip', 'llava', 'qwen', 'other'][p_partkey % 4 + 1] AS family FROM part),
scaled AS (SELECT *, least(336 / w, 336 / h) AS s FROM sized)
SELECT id, family, CASE WHEN w IS NULL THEN CASE family WHEN 'llava' THEN 576 ELSE 256 END
  WHEN family = 'clip' THEN (w // 14) * (h // 14) + 1
  WHEN family = 'llava' THEN (floor(w * s)::BIGINT // 24) * (floor(h * s)::BIGINT // 24)
  WHEN family = 'qwen' THEN CASE WHEN w * h <= 224 * 224 THEN 256 WHEN w * h <= 448 * 448 THEN 512 ELSE 1024 END
  ELSE greatest(256, least((w // 14) * (h // 14), 1024)) END::BIGINT AS tokens FROM scaled""")
def f2(spark, sf):
    p = D.table(spark, sf, "part")
    w = F.when(F.col("p_size") % 10 != 0, F.col("p_size") * 40)
    fam = F.element_at(F.array(*[F.lit(x) for x in ("clip", "llava", "qwen", "other")]),
                       (F.col("p_partkey") % 4 + 1).cast("int"))
    d = p.select(F.col("p_partkey").alias("id"), w.alias("w"), ((F.col("p_partkey") % 50 + 1) * 30).alias("h"), fam.alias("family"))
    return d.select("id", "family", K.image_tokens(F.col("w"), F.col("h"), F.col("family")).alias("tokens"))


_EST = " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.OUTPUT_TOKEN_ESTIMATES.items())


@query("f3_output_estimate", f"""
SELECT sample_id, CASE WHEN sample_id::BIGINT % 9 = 0 THEN 100 ELSE CASE task_type {_EST} ELSE {V.DEFAULT_OUTPUT_TOKENS} END END::BIGINT AS tokens FROM samples""")
def f3(spark, sf):
    task = F.when(F.col("sample_id").cast("bigint") % 9 == 0, "unheard-of").otherwise(F.col("task_type"))
    return D.samples(spark, sf).select("sample_id", K.output_token_estimate(task).alias("tokens"))


@query("f4_token_cost", f"""
SELECT sample_id, floor(words * {_W}::DOUBLE)::BIGINT + 256 * num_images AS tokens,
       round((floor(words * {_W}::DOUBLE) + 256 * num_images) / 1000000 * 0.35::DOUBLE, 12) AS cost FROM samples""")
def f4(spark, sf):
    s = D.samples_with_assets(spark, sf).select(
        "sample_id", K.input_tokens(F.col("prompt"), K.image_count(F.col("assets"))).alias("tokens"))
    return s.withColumn("cost", F.round(K.token_cost(F.col("tokens"), F.lit(0.35)), 12))


def _priced(spark, sf):
    return D.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity"),
        (F.col("l_discount") * 10).alias("accuracy"), (F.col("l_extendedprice") / 1e6).alias("avg_cost"))


_RANK = rank_sql("a", "avg_cost")
_PRICED_SQL = """priced AS (SELECT *, l_discount * 10 AS accuracy, least(greatest(l_discount * 10, 0), 1) AS a,
    l_extendedprice / 1000000 AS avg_cost, 0.002::DOUBLE AS cmin, 0.08::DOUBLE AS cmax FROM lineitem)"""
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


@query("f5_rank_score", f", {_PRICED_SQL} SELECT {_KEYS}, round({_RANK}, 7) AS rank_score FROM priced")
def f5(spark, sf):
    p = _priced(spark, sf)
    return p.select(*_KEYS.split(", "), F.round(S.rank_score(
        F.col("accuracy"), F.col("avg_cost"), F.lit(0.002), F.lit(0.08)), 7).alias("rank_score"))


@query("f6_rank_breakdown", f""", {BOUNDS_SQL}, g AS (SELECT dataset, avg(quality) AS a, avg(cost) AS avg_cost
    FROM predictions GROUP BY dataset), s AS (SELECT *, round({_RANK}, 8) AS rank_score FROM g, bounds)
SELECT dataset, rank_score, round((log2(cmax) - log2(least(greatest(avg_cost, cmin), cmax))) / (log2(cmax) - log2(cmin) + 1e-12), 8) AS normalized_cost,
  round((avg_cost - cmin) / (cmax - cmin), 8) AS relative_cost,
  CASE WHEN rank_score >= 0.8 THEN 'Excellent' WHEN rank_score >= 0.6 THEN 'Good' WHEN rank_score >= 0.4 THEN 'Fair' ELSE 'Poor' END AS grade FROM s""")
def f6(spark, sf):
    b = C.cost_bounds(D.outcomes(spark, sf))
    g = D.predictions(spark, sf).groupBy("dataset").agg(F.avg("quality").alias("a"), F.avg("cost").alias("c"))
    g = g.withColumns({"lo": E.bound(b, "cmin"), "hi": E.bound(b, "cmax")})
    out = g.select("dataset", S.rank_breakdown(F.col("a"), F.col("c"), F.col("lo"), F.col("hi")).alias("x"))
    return round_columns(out.select("dataset", "x.*"), 8, "rank_score", "normalized_cost", "relative_cost")


@query("f7_cost_normalization", """
SELECT sample_id, model_id, CASE sample_id::BIGINT % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 0
  ELSE round(least(greatest((cost - 1e-5) / (2e-3 - 1e-5), 0), 1), 9) END::DOUBLE AS unit FROM outcomes
UNION ALL SELECT sample_id, 'equal', 0 FROM samples""")
def f7(spark, sf):
    i = F.col("sample_id").cast("bigint") % 5
    c = (F.when(i == 1, F.lit(float("nan"))).when(i == 2, F.lit(float("inf")))
         .when(i == 3, F.lit(float("-inf"))).when(i == 4, F.col("cost")))
    unit = F.round(S.normalize_cost(c, F.lit(1e-5), F.lit(2e-3)), 9).alias("unit")
    same = S.normalize_cost(F.rand(1), F.lit(0.5), F.lit(0.5)).alias("unit")
    return D.outcomes(spark, sf).select("sample_id", "model_id", unit).unionByName(
        D.samples(spark, sf).select("sample_id", F.lit("equal").alias("model_id"), same))


# conversations and prompts with one planted phrase each, so that every rule is met
_PHRASES = [t for _, terms in V.TEXT_RULES for t in terms]
_DATASETS = [k for _, keys in V.DATASET_RULES for k in keys]


@query("f8_query_type", f", {TYPES_SQL}, " + f"""
phrases AS (SELECT {_PHRASES!r} AS p, {_DATASETS!r} AS d),
planted AS (SELECT conv_id, turn, 'x ' || upper(p[conv_id % {len(_PHRASES)} + 1]) || ' y' AS prompt,
    CASE WHEN turn % 3 = 2 THEN 'My-' || upper(d[conv_id % {len(_DATASETS)} + 1]) ELSE 'zzz' END AS dataset FROM conversations, phrases)
SELECT 'doc' || sample_id AS id, query_type FROM types UNION ALL
SELECT conv_id || '-' || turn, """ + type_sql() + " FROM planted")
def f8(spark, sf):
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("conv_id") % len(xs) + 1).cast("int"))
    planted = D.table(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.concat(F.lit("x "), F.upper(pick(_PHRASES)), F.lit(" y")).alias("prompt"),
        F.when(F.col("turn") % 3 == 2, F.concat(F.lit("My-"), F.upper(pick(_DATASETS)))).otherwise("zzz").alias("dataset"))
    docs = D.samples(spark, sf).select(F.concat(F.lit("doc"), "sample_id").alias("id"), "prompt", "dataset")
    return FT.with_query_type(docs.unionByName(planted)).select("id", "query_type")


def _term_sql(terms):
    return "least((" + " + ".join(f"contains(t, '{x}')::INT" for x in terms) + ") / 3, 1)"


STATS_SQL = f"""raw AS (SELECT sample_id, dataset, lower(' ' || prompt || '     ') AS t FROM samples),
stats AS (SELECT sample_id, dataset, length(regexp_replace(t, '[^{V.DIGIT_CLASS}]+', '', 'g')) / greatest(length(t), 1) AS digit_ratio,
  length(regexp_replace(t, '[^{V.ALPHA_CLASS}]+', '', 'g')) / greatest(length(t), 1) AS alpha_ratio,
  least(ln(1 + greatest(length(t), 1)) / 8, 1) AS length_score, {_term_sql(V.SPATIAL_TERMS)} AS spatial_terms,
  {_term_sql(V.CHART_TERMS)} AS chart_terms, {_term_sql(V.COUNTING_TERMS)} AS counting_terms, {_term_sql(V.OCR_TERMS)} AS ocr_terms FROM raw)"""
_STATS = ["digit_ratio", "alpha_ratio", "length_score", "spatial_terms", "chart_terms", "counting_terms", "ocr_terms"]


@query("f9_text_statistics", f", {STATS_SQL} SELECT sample_id, " + ", ".join(f"round({c}, 8) AS {c}" for c in _STATS) + " FROM stats")
def f9(spark, sf):
    s = D.samples(spark, sf).drop("image_path")
    out = s.select("sample_id", F.explode(F.array(T.text_stats(T.joined_text(s.columns)))).alias("x")).select("sample_id", "x.*")
    return round_columns(out, 8, *_STATS)


@query("f10_stable_unit", f"SELECT sample_id, round({S.unit_sql('sample_id', 'jitter')}, 12) AS u FROM samples")
def f10(spark, sf):
    return D.samples(spark, sf).select("sample_id", F.round(S.stable_unit(F.col("sample_id"), "jitter"), 12).alias("u"))


@query("f11_clamp", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE round(least(greatest(value / 10 - 1, 0), 2), 9) END::DOUBLE AS x FROM events""")
def f11(spark, sf):
    i = F.col("event_id") % 4
    x = F.when(i == 0, F.lit(float("nan"))).when(i == 1, F.lit(float("-inf"))).otherwise(F.col("value") / 10 - 1)
    return D.table(spark, sf, "events").select("event_id", F.round(S.clamp(x), 9).alias("x"))


@query("f12_loose_json", """
SELECT event_id, CASE event_id % 6 WHEN 4 THEN NULL WHEN 3 THEN 'plain ' || event_type WHEN 5 THEN '[' || event_type ELSE event_type || '|' || user_id END AS items FROM events""")
def f12(spark, sf):
    e, i = D.table(spark, sf, "events"), F.col("event_id") % 6
    t, u = F.col("event_type"), F.col("user_id").cast("string")
    raw = (F.when(i == 0, F.concat(F.lit(' ["'), t, F.lit('", "'), u, F.lit('"]\n')))
           .when(i == 1, F.concat(F.lit("['"), t, F.lit("', '"), u, F.lit("']")))
           .when(i == 2, F.concat(F.lit("('"), t, F.lit("', '"), u, F.lit("')")))
           .when(i == 3, F.concat(F.lit("plain "), t)).when(i == 4, F.lit("  ")).otherwise(F.concat(F.lit("["), t)))
    return e.select("event_id", F.array_join(T.parse_list_text(raw), "|").alias("items"))


@query("f12_loose_values", """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN '{"t":"' || event_type || '","u":' || user_id || '}'
  WHEN 1 THEN '{"none":null,"ok":true,"t":"' || event_type || '","u":' || user_id || '}'
  WHEN 2 THEN '[["' || event_type || '",' || user_id || '],[-2.5],[],"' || event_type || '",{"deep":[false,{"u":' || user_id || '}]}]'
  WHEN 3 THEN '"it''s \\"' || event_type || '\\""' WHEN 4 THEN user_id::VARCHAR WHEN 5 THEN 'true'
  WHEN 6 THEN '"plain (' || event_type || ', ' || user_id || '"' ELSE NULL END AS value,
  CASE WHEN event_id % 8 IN (0, 1) THEN user_id END AS u
FROM events""")
def f12_values(spark, sf):
    """Objects, nested lists, tuples, numbers, booleans and plain text, in either notation."""
    e, i = D.table(spark, sf, "events"), F.col("event_id") % 8
    t, u = F.col("event_type"), F.col("user_id").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    raw = (F.when(i == 0, text(' {"u": ', u, ', "t": "', t, '"}\n'))
           .when(i == 1, text("{'u': ", u, ", 't': '", t, "', 'ok': True, 'none': None,}"))
           .when(i == 2, text("[('", t, "', ", u, "), (-2.5,), (), ('", t, "'), {'deep': [False, {'u': ", u, "}]}]"))
           .when(i == 3, text("'it\\'s \"", t, "\"'")).when(i == 4, u).when(i == 5, F.lit("True"))
           .when(i == 6, text("plain (", t, ", ", u)).otherwise(F.lit(" ")))
    rows = e.select("event_id", T.loose_value(raw).alias("v"))
    return rows.select("event_id", F.to_json("v").alias("value"),
                       F.when(F.col("event_id") % 8 < 2, F.try_variant_get("v", "$.u", "bigint")).alias("u"))


def _dims(df, *cols):
    """One row per (sample, dimension)."""
    z = df.select("sample_id", *[c for c in df.columns if c not in (*cols, "sample_id")],
                  F.posexplode(F.arrays_zip(*cols)).alias("dim", "z"))
    return z.select("sample_id", F.col("dim").cast("bigint").alias("dim"), *[F.round(f"z.{c}", 8).alias(c) for c in cols])


@query("f13_l2_normalize", """, s AS (SELECT sample_id, list_transform(text_vec, lambda x: x * 3) AS v FROM features)
SELECT sample_id, round(sqrt(list_dot_product(v, v)), 8) AS norm, round(list_sum(list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12))), 8) AS total FROM s""")
def f13(spark, sf):
    f = D.features(spark, sf).select("sample_id", X.scale(F.col("text_vec"), F.lit(3.0)).alias("v"))
    return f.select("sample_id", F.round(X.norm(F.col("v")), 8).alias("norm"),
                    F.round(X.total(X.l2_normalize(F.col("v"))), 8).alias("total"))


_FUSE_SQL = {
    "concat": "list_concat(t, v)", "average": "list_transform(range(1, 25), lambda i: (t[i] + v[i]) / 2)",
    "weighted_average": "list_transform(range(1, 25), lambda i: 0.3::DOUBLE * t[i] + 0.7::DOUBLE * v[i])",
    "normalize_concat": "list_concat(list_transform(t, lambda x: x / sqrt(list_dot_product(t, t))), list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))))",
    "only_text": "t", "only_image": "v"}


@query("f14_fusion", ", f AS (SELECT sample_id, text_vec AS t, image_vec[1:24] AS v FROM features) " + " UNION ALL ".join(
    f"SELECT sample_id, '{m}' AS method, len({e})::BIGINT AS dim, round(list_sum({e}), 8) AS total, round(({e})[3], 8) AS third FROM f" for m, e in _FUSE_SQL.items()))
def f14(spark, sf):
    """A 32-dimensional text vector with a 24-dimensional image vector."""
    f = D.features(spark, sf).select("sample_id", F.col("text_vec").alias("t"), F.slice("image_vec", 1, 24).alias("v"))
    one = lambda m: F.struct(F.lit(m).alias("method"), X.fuse(F.col("t"), F.col("v"), m, 0.3).alias("x"),
                             X.fused_size(F.size("t"), F.size("v"), m).cast("bigint").alias("dim"))
    rows = f.select("sample_id", F.explode(F.array(*[one(m) for m in V.FUSION_METHODS])).alias("z"))
    return rows.select("sample_id", "z.method", "z.dim", F.round(X.total(F.col("z.x")), 8).alias("total"),
                       F.round(F.col("z.x")[2], 8).alias("third"))


_INTERACT_SQL = {
    "concat": "list_concat(list_concat(t, v), list_concat(list_transform(range(1, 33), lambda i: t[i] * v[i]), list_transform(range(1, 33), lambda i: abs(t[i] - v[i]))))",
    "weighted": "list_concat(list_transform(t, lambda x: x * 0.3::DOUBLE), list_transform(v, lambda x: x * 0.6::DOUBLE))",
    "gated": "list_concat(list_transform(v, lambda x: x * 0.5), list_transform(t, lambda x: x * 0.5))",
    "hadamard_only": "list_transform(range(1, 33), lambda i: t[i] * v[i])"}


@query("f15_interaction_fusion", ", f AS (SELECT sample_id, text_vec AS t, image_vec AS v FROM features), x AS (" + " UNION ALL ".join(
    f"SELECT sample_id, '{m}' AS method, {e} AS x FROM f" for m, e in _INTERACT_SQL.items()) + """),
long AS (SELECT sample_id, method, i, x[i] AS x FROM x, range(1, 129) r(i) WHERE i <= len(x)),
st AS (SELECT method, i, avg(x) AS m, stddev_pop(x) + 1e-8 AS s FROM long GROUP BY ALL)
SELECT sample_id, method, count(*) AS dim, round(sum((x - m) / s), 6) AS total, round(max((x - m) / s), 6) AS top FROM long JOIN st USING (method, i) GROUP BY ALL""")
def f15(spark, sf):
    parts = []
    for m in _INTERACT_SQL:
        v = D.features(spark, sf).select("sample_id", X.interact(
            F.col("text_vec"), F.col("image_vec"), m, True, 0.3, 0.6).alias("x"))
        z = FT.standardize(v, "x", FT.fit_standardizer(v, "x", floor=None, plus=1e-8))
        parts.append(z.select("sample_id", F.lit(m).alias("method"), F.size("x").cast("bigint").alias("dim"),
                              F.round(X.total(F.col("x")), 6).alias("total"), F.round(F.array_max("x"), 6).alias("top")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("f16_vector_distance", """, f AS (SELECT sample_id, text_vec AS t, image_vec AS v, image_vec[1:20] AS s FROM features),
n AS (SELECT *, list_transform(t[1:20], lambda x: x / greatest(sqrt(list_dot_product(t[1:20], t[1:20])), 1e-6)) AS tn,
  list_transform(s, lambda x: x / greatest(sqrt(list_dot_product(s, s)), 1e-6)) AS sn FROM f)
SELECT sample_id, round(list_distance(t, v) / sqrt(32), 8) AS raw, 0::DOUBLE AS unequal, round(list_distance(tn, sn) / sqrt(20), 8) AS normalized FROM n""")
def f16(spark, sf):
    t, v, s = F.col("text_vec"), F.col("image_vec"), F.slice("image_vec", 1, 20)
    return D.features(spark, sf).select("sample_id", F.round(X.descriptor_distance(t, v), 8).alias("raw"),
                                        X.descriptor_distance(t, s).alias("unequal"),
                                        F.round(X.embedding_distance(t, s), 8).alias("normalized"))


def evidence_rows(spark, sf):
    s = D.samples(spark, sf).drop("image_path")
    f = D.features(spark, sf).select("sample_id", "text_vec", "image_vec")
    return s.join(f, "sample_id", "left")


_u = lambda salt: S.unit_sql("sample_id", salt)
_R = [c for c in V.EVIDENCE_COLUMNS if not c.startswith("query_cond")]
_DISTANCES = ", ".join(" + ".join([f"{start}::DOUBLE", *[f"{w}::DOUBLE * {k}" for k, w in terms.items()]]) + f" AS {name}"
                       for name, (start, terms) in V.EVIDENCE_TERMS.items())
EVIDENCE_SQL = f"""{TYPES_SQL}, {STATS_SQL},
vec AS (SELECT s.*, query_type, f.text_vec AS tv, f.image_vec AS iv,
  list_transform(f.image_vec, lambda x: x / greatest(sqrt(list_dot_product(f.image_vec, f.image_vec)), 1e-6)) AS n,
  list_transform(f.text_vec, lambda x: x / greatest(sqrt(list_dot_product(f.text_vec, f.text_vec)), 1e-6)) AS tn
  FROM stats s JOIN types USING (sample_id) LEFT JOIN features f USING (sample_id)),
m AS (SELECT *, CASE WHEN n IS NULL THEN 0.05::DOUBLE + 0.10::DOUBLE * {_u("spread")} ELSE list_stddev_pop(n) * sqrt(32) END AS spread,
  CASE WHEN n IS NULL THEN 0.05::DOUBLE + 0.10::DOUBLE * {_u("mean_abs")} ELSE list_avg(list_transform(n, lambda x: abs(x))) * sqrt(32) END AS mean_abs,
  CASE WHEN n IS NULL THEN 0.05::DOUBLE + 0.10::DOUBLE * {_u("diff")} ELSE list_avg(list_transform(range(1, 32), lambda i: abs(n[i + 1] - n[i]))) * sqrt(32) END AS diff,
  CASE WHEN n IS NULL THEN 0 ELSE abs(len(list_filter(n, lambda x: x > 0)) / 32 - 0.5) END AS off_half, {_u("random")} AS random,
  CASE WHEN n IS NULL THEN 0 ELSE 1 - list_dot_product(tn, n) END AS gap, 0.02::DOUBLE * {_u("jitter")} AS jitter FROM vec),
e AS (SELECT sample_id, query_type, n IS NOT NULL AS has, {_DISTANCES} FROM m),
cond AS (SELECT *, CASE query_type """ + " ".join(
    f"WHEN '{k}' THEN [{', '.join(v)}]" for k, v in V.QUERY_CONDITIONED.items() if k) + f""" ELSE [{', '.join(V.QUERY_CONDITIONED[""])}] END AS c FROM e),
evidence AS (SELECT *, list_avg(c) AS query_cond_mean, list_max(c) AS query_cond_max, list_stddev_pop(c) AS query_cond_std FROM cond)"""


@query("f17_evidence_features", f", {EVIDENCE_SQL} SELECT sample_id, " + ", ".join(
    f"round(least(greatest({c}, 0), 2), 7) AS {c}" for c in _R) + " FROM evidence")
def f17(spark, sf):
    return round_columns(FT.evidence_features(evidence_rows(spark, sf)).select("sample_id", *_R), 7, *_R)


_COND = ["query_cond_mean", "query_cond_max", "query_cond_std"]


@query("f18_conditioned_statistics", f", {EVIDENCE_SQL} SELECT sample_id, query_type, " + ", ".join(
    f"round({c}, 7) AS {c}" for c in _COND) + " FROM evidence")
def f18(spark, sf):
    return round_columns(FT.evidence_features(evidence_rows(spark, sf)).select("sample_id", "query_type", *_COND), 7, *_COND)


@query("f19_evidence_rows", f""", {TYPES_SQL} SELECT sample_id, query_type, CASE WHEN f.text_vec IS NULL THEN 'metadata' ELSE 'embedding' END AS evidence_source,
  0::DOUBLE AS has_image, (f.text_vec IS NOT NULL)::INT::DOUBLE AS has_embedding FROM types LEFT JOIN features f USING (sample_id)""")
def f19(spark, sf):
    return FT.evidence_features(evidence_rows(spark, sf)).select(
        "sample_id", "query_type", "evidence_source", "has_image", "has_embedding")


_HOT = ", ".join(f"(query_type = '{q}')::INT::DOUBLE" for q in V.QUERY_TYPES)
FEATURE_VECTOR_SQL = f"""{TYPES_SQL}, fv AS (SELECT sample_id, query_type, text_vec AS t, image_vec AS v, sqrt(list_dot_product(text_vec, text_vec)) AS tn,
  sqrt(list_dot_product(image_vec, image_vec)) AS vn, COALESCE(l.quality, 0)::DOUBLE AS x1 FROM features JOIN types USING (sample_id)
  LEFT JOIN labels l ON l.doc_id::VARCHAR = sample_id),
vectors AS (SELECT sample_id, query_type, list_concat(list_concat(list_transform(t, lambda x: x / greatest(tn, 1e-12)), list_transform(v, lambda x: x / greatest(vn, 1e-12))),
  [list_dot_product(list_transform(t, lambda x: x / greatest(tn, 1e-12)), list_transform(v, lambda x: x / greatest(vn, 1e-12))), tn, vn, tn - vn, {_HOT}, x1]) AS vec FROM fv)"""


def feature_vectors(spark, sf, mode="full"):
    lab = D.table(spark, sf, "labels").withColumn("sample_id", F.col("doc_id").cast("string"))
    rows = FT.attach_extras(D.features(spark, sf), lab, ["quality"])
    return FT.sample_features(rows, ["quality"], **FT.ablation_switches(mode)[0])


@query("f20_sample_features", f""", {FEATURE_VECTOR_SQL} SELECT sample_id, i - 1 AS dim, round(vec[i], 8) AS x FROM vectors, range(1, 77) r(i)""")
def f20(spark, sf):
    z = feature_vectors(spark, sf).select("sample_id", F.posexplode("vec").alias("dim", "x"))
    return z.select("sample_id", F.col("dim").cast("bigint").alias("dim"), F.round("x", 8).alias("x"))


@query("f21_name_tags", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END AS stem,
       replace(replace((CASE WHEN p_size % 2 = 0 THEN -p_size ELSE p_size END / 8)::DOUBLE::VARCHAR, '-', 'neg'), '.', '_') AS tag, '' AS missing FROM part""")
def f21(spark, sf):
    p, size = D.table(spark, sf, "part"), F.col("p_size")
    name = F.when(size % 3 == 0, F.concat(F.lit("lab/x/"), "p_brand")).otherwise(F.col("p_name"))
    value = F.when(size % 2 == 0, -size).otherwise(size) / 8
    return p.select("p_partkey", N.encoder_stem(name).alias("stem"), N.lambda_tag(value).alias("tag"),
                    N.first_present_text(F.lit(None).cast("string")).alias("missing"))


@query("f22_simple_token_estimate", f"""
, e AS (SELECT sample_id, floor(CASE WHEN sample_id::BIGINT % 8 = 0 THEN 0 ELSE words END * {V.SIMPLE_WORDS_TO_TOKENS}::DOUBLE)::BIGINT + 256 * num_images AS n FROM samples)
SELECT sample_id, CASE WHEN n = 0 THEN 100 ELSE n END AS tokens FROM e""")
def f22(spark, sf):
    s = D.samples_with_assets(spark, sf)
    text = F.when(F.col("sample_id").cast("bigint") % 8 != 0, F.col("prompt")).otherwise("")
    return s.select("sample_id", K.simple_token_estimate(text, K.image_count(F.col("assets"))).alias("tokens"))


@query("f23_encoder_registry", f"""
, enc(encoder, modality, dimension, max_length, image_size, patch_size) AS {D.values_sql(V.ENCODERS)},
v AS (SELECT 'text' AS modality, 'bge-m3' AS stem, len(text_vec) AS dim FROM features UNION ALL SELECT 'vision', 'dinov2-base', len(image_vec) FROM features)
SELECT encoder, dimension, count(*) FILTER (dim = dimension) AS ok, count(*) FILTER (dim <> dimension) AS wrong
FROM enc JOIN v ON v.modality = enc.modality AND v.stem = string_split(encoder, '/')[-1] GROUP BY ALL""")
def f23(spark, sf):
    enc = EN.encoder_table(spark).withColumn("stem", N.encoder_stem(F.col("encoder")))
    v = _vectors(spark, sf).select("modality", F.col("encoder").alias("stem"), F.size("embedding").alias("dim"))
    return v.join(F.broadcast(enc), ["modality", "stem"]).groupBy("encoder", "dimension").agg(
        F.count_if(F.col("dim") == F.col("dimension")).alias("ok"), F.count_if(F.col("dim") != F.col("dimension")).alias("wrong"))


@query("f24_model_names", """
SELECT l_suppkey AS idx, CASE WHEN l_suppkey < 8 THEN 'm' || l_suppkey ELSE 'model_' || l_suppkey END AS model_name, count(*) AS n FROM lineitem GROUP BY ALL""")
def f24(spark, sf):
    i = F.col("l_suppkey")
    return D.table(spark, sf, "lineitem").groupBy(i.alias("idx"), N.model_name(i, D.MODEL_IDS).alias("model_name")).agg(
        F.count(F.lit(1)).alias("n"))
