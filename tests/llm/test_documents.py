"""Document operators against brute force, and their defined results on unusual rows (1, 2, 8, 10, pipeline)."""

import random
import re
import tracemalloc
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from routeyard.llm import license_scan, near_dedup, quality, toxicity
from routeyard.llm.common import stored

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = [x for x in BLANK.split(lower(text)) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(ids, texts, percent=85):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    least = {g: min((x for x in members if x is not None), default=None) for g, members in groups.items()}
    return [least[find(i)] if sets[i] else ids[i] for i in range(len(ids))], [len(s) for s in sets]


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("leaf,depth", [(512, 2), (8, 2), (6, 0)])
def test_components_equal_brute_force(make_docs, leaf, depth):
    """Chains, large groups whose members aren't all linked, copies, and nodes that branch or go block by block."""
    rng = random.Random(11)
    base = [f"v{i}" for i in range(120)]
    texts = near_copies(rng, base, 40, 6)
    other = [f"u{i}" for i in range(60)]
    chain = list(other)
    for step in range(12):
        chain = chain[1:] + [f"c{step}"]
        texts.append(" ".join(chain))
    texts += [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(30)) for _ in range(20)]
    texts += ["One two", "one TWO", "one two three", None, "", " \n", "", texts[0], texts[0].upper(), "é É x y z", "é é x y z",
              "long " * 20_000, "long " * 20_001]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    want, sizes = brute_components(ids, texts)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(make_docs(texts, ids), leaf=leaf, depth=depth).collect()}
    assert [got[i]["n_shingles"] for i in ids] == sizes
    assert [got[i]["component_id"] for i in ids] == want
    assert all(got[i]["kept"] == (i == w) for i, w in zip(ids, want))


def test_components_of_unusual_rows(make_docs):
    assert near_dedup.near_duplicates(make_docs(["a"]).limit(0)).count() == 0
    assert near_dedup.near_duplicates(make_docs([None, ""])).count() == 2
    text = "a b c d e f g"
    rows = near_dedup.near_duplicates(make_docs([text, text, text, "x", None], ids=[None, 5, 5, None, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [
        ("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", False), ("None", "None", False)]
    stays = near_dedup.representatives(make_docs([text, text, text + " h i j k l m n o p q r s", "x", None, "", ""],
                                                 ids=[5, 5, 4, None, 9, 9, 9]))
    assert sorted(str(r["doc_id"]) for r in stays.collect()) == ["4", "5", "9", "9", "9", "None"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_license_base_equals_brute_force(make_docs, odd_texts):
    notices = [t for _, t in license_scan.TEMPLATES]
    mit = notices[0].split()
    texts = [*odd_texts, *notices, "cc by cc-by CC  BY", "general public\nlicense all rights reserved", "general public",
             "pre " + " ".join(mit[:20] + ["inserted", "words"] + mit[20:30] + mit[32:]) + " post", " ".join(mit[:12])]
    got = {r["doc_id"]: r for r in license_scan.licenses(make_docs(texts)).collect()}
    for i, t in enumerate(texts):
        w = words_of(t)
        found = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w))
                 if w[k:k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(found))
        assert (r["first_word"], r["last_word"]) == (min((k for k, _ in found), default=None), max((k for k, _ in found), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    for k, (label, _) in enumerate(license_scan.TEMPLATES):
        r = got[len(odd_texts) + k]
        assert label in r["labels"].split(",") and r["score"] == 1
    edited, cut = got[len(texts) - 2], got[len(texts) - 1]
    assert edited["labels"] == "mit" and 0.7 <= edited["score"] < 1
    assert cut["labels"] == "" and cut["score"] == 0
    assert license_scan.licenses(make_docs(["a"]).limit(0)).count() == 0
    assert license_scan.licenses(make_docs(["cc by", "cc by"], ids=[None, None])).count() == 2


def test_repeats_behind_a_notice_do_not_hide_it(make_docs):
    templates = (("mit", "Licensed under the MIT License."), ("apache-2.0", "Licensed under the Apache License, Version 2.0."))
    texts = ["Licensed under the MIT License. The MIT License permits reuse.",
             "Licensed under the Apache License, Version 2.0. " + "Version 2.0 " * 30,
             "Version 2.0 " * 30, "pre " + "Licensed under the MIT License. The MIT License. " * 2]
    rows = {r["doc_id"]: r for r in license_scan.licenses(make_docs(texts), templates=templates).collect()}
    assert [rows[i]["labels"] for i in range(4)] == ["mit", "apache-2.0", "", "mit"]
    assert [rows[i]["score"] for i in range(4)] == [1, 1, 0, 1]
    _, notices = license_scan.scan(make_docs(texts[:1]), templates=templates)
    assert [(r["label"], r["first_word"], r["last_word"], r["coverage"]) for r in notices.collect()] == [("mit", 0, 4, 1)]


def brute_counts(text):
    text = text or ""
    w = [x for x in BLANK.split(text) if x]
    lines = [x for x in text.split("\n") if BLANK.sub("", x)]
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i:i + 5]), []).append(i)
    repeated = {i + k for places in grams.values() if len(places) > 1 for i in places for k in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))


def test_quality_counts_equal_brute_force(make_docs, odd_texts):
    rng = random.Random(2)
    texts = [*odd_texts, "a b c d e\na b c d e\nx", "a b c d e a b c d e a b c d e", "# x | y\n\n#", "one\n one\none",
             *[" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]]
    docs = make_docs(texts)
    rows = {r["doc_id"]: r for r in quality.judged(docs).collect()}
    for i, t in enumerate(texts):
        want = brute_counts(t)
        assert tuple(rows[i][c] for c in quality.COUNTS) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert rows[i]["base_failed"] == failed and not (failed and rows[i]["kept"])
    names = list(quality.CONDITIONS)
    one, two = (quality.judged(docs, order).select("doc_id", "kept") for order in (names, names[::-1]))
    assert one.exceptAll(two).count() == 0
    assert quality.judged(docs.limit(0)).count() == 0


def test_quality_is_native(make_docs):
    plan = quality.judged(make_docs(["a b c"]), ["symbols"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_passing_rows_are_the_kept_ones(make_docs, odd_texts):
    """In any order of the rules; a rule behind the one that rejects takes no counts."""
    prose = "ten or more words of quite ordinary prose in a single line of text"
    texts = [*odd_texts, prose, prose + " # # # #", "a b c d e f g h i j k l", "\n".join([prose] * 3), "so so so so so so ten words or more stand here",
             prose + " 1234567890" * 20, "x" * 30 + (" " + "y" * 30) * 12]
    docs = make_docs(texts)
    kept = sorted(r["doc_id"] for r in quality.judged(docs).filter("kept").collect())
    assert kept
    for order in (None, list(quality.CONDITIONS), list(quality.CONDITIONS)[::-1]):
        got = quality.passing(docs, order)
        assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == kept
    plan = quality.passing(docs, ["symbols", "repeated_words"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("CASE WHEN") < plan.index("regexp_replace") < plan.index("xxhash64")


def test_prose_without_blanks_stays(spark, make_docs):
    """Chinese, Japanese and Thai pass; a Latin text of such long words doesn't."""
    line = {"zh": "我们在春天的早晨沿着河边慢慢地走到了那座古老的石桥上看见许多人在那里钓鱼和聊天{}。",
            "ja": "わたしたちは春の朝に川のそばをゆっくりと歩いて古い石の橋まで行きました{}。",
            "th": "พวกเราเดินเล่นริมแม่น้ำในตอนเช้าของฤดูใบไม้ผลิและพบผู้คนมากมาย{}",
            "latin": "wewalkedslowlyalongtheriverinthespringmorningtotheoldbridge{}"}
    texts = ["\n".join(x.format(c * 2) for c in "abcdefghijkl") for x in line.values()]
    rows = corpus_pipeline.drop_poor(spark, make_docs(texts), "").collect()
    assert sorted(r["doc_id"] for r in rows) == [0, 1, 2]
    assert [r["doc_id"] for r in quality.judged(make_docs(texts)).filter("kept").orderBy("doc_id").collect()] == [0, 1, 2]


def test_order_of_the_rules_follows_the_sample(make_docs):
    """The rule that rejects most per second comes first, in both paths; what it rejects costs the others nothing."""
    prose = "ten or more words of quite ordinary prose in a single line of text"
    for bad, first in ((prose + " # # # #", "symbols"), ("so so so so so so ten words or more stand here", "stutter")):
        docs = make_docs([bad] * 300 + [prose] * 30)
        assert quality.cascade(docs)[0] == first
        plan = quality.judged(docs.select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
        verdict = plan[plan.index("ELSE CASE WHEN"):]
        # the first branch behind the least number of words
        assert ("n_symbols" in verdict[:200]) == (first == "symbols")

def test_stages_leave_clashing_columns_alone(spark, make_docs):
    """Columns named like those that the stages use pass through them unchanged, null and repeated rows too."""
    prose = "ten or more words of quite ordinary prose in a single line of text"
    names = ["score", "predicted", "held_out", "copy_hash", "of_copy", "of_text", "__copy", "found", "toxicity", "Toxicity_"]
    mine = [F.concat(F.lit(f"my {name}"), F.coalesce("doc_id", F.lit(0))).alias(name) for name in names]
    docs = make_docs([prose, prose, prose + " and more", None, "", prose], ids=[1, 1, 2, None, 3, None]).select("doc_id", "text", "lang", *mine)
    rows = sorted(map(repr, docs.collect()))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_poor, corpus_pipeline.drop_near_copies):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        got = sorted(map(repr, out.collect()))
        assert out.columns == docs.columns and got
        for r in got:
            rows_left = rows.count(r)
            assert rows_left and got.count(r) <= rows_left


def test_pipeline_of_empty_and_odd_tables(spark, make_docs, odd_texts, tmp_path):
    prose = "ten or more words of quite ordinary prose in a single line of text"
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for k, docs in enumerate((make_docs(["a"]).limit(0), make_docs([*odd_texts, prose, prose, prose + " x", None], ids=[
            *range(len(odd_texts)), 500, 500, None, None]).withColumn("held_out", F.lit(1)))):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        none.write.parquet(f"{tmp_path}/{k}/labels.parquet")
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert (k == 0) == (pieces == [])
        assert all(r["length"] > 0 for r in pieces)


def test_repeated_labelled_rows_are_sampled_once(spark, make_docs):
    docs = make_docs(["vile words"] * 3000 + ["fine words"], ids=[1] * 3000 + [3])
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    sample, _ = toxicity.sample_of(labels, "toxic", 10, 10)
    assert len(toxicity.sample_features(docs, sample)) == 2


def test_counterfactual_gap_at_the_shipped_setting(spark):
    """Swapping identity terms in held-out sentences moves the classifier's log-odds less with the penalty than without."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    terms = [group for group in toxicity.IDENTITY_TERMS if len(group) > 1]
    rows = [(i * 10 + k, f"all the {term} of the town are vile and stupid" if i % 2 else f"the {term} walk along the river")
            for i, group in enumerate(terms * 2) for k, term in enumerate(group)]
    test = spark.createDataFrame(rows, "doc_id long, text string")
    gaps = []
    for fairness in (0.0, toxicity.FAIRNESS):
        s = {r["doc_id"]: r["score"] for r in toxicity.score(test, toxicity.train(docs, labels, fairness=fairness)).collect()}
        odds = lambda p: np.log(p / (1 - p))
        gaps.append(np.mean([abs(odds(s[i * 10 + k]) - odds(s[i * 10])) for i, group in enumerate(terms * 2) for k in range(1, len(group))]))
    assert gaps[1] <= gaps[0]



def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).select("doc_id", toxicity.held_out().alias("held"), "score",
                                                                        "predicted")
    rows = scored.join(labels, "doc_id").filter("held").collect()
    wrong = sum(r["predicted"] != r["toxic"] for r in rows)
    assert wrong <= 0.025 * len(rows) and sum(r["predicted"] == 1 and r["toxic"] == 0 for r in rows) <= 0.01 * len(rows)
    pos, neg = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert np.mean([[(a > b) + (a == b) / 2 for b in neg] for a in pos]) > 0.93


def test_identity_terms_lose_their_weight(spark, make_docs):
    """A group that appears in insulting rows only: swapping it must not move scores."""
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice("alpha beta gamma delta omega sigma".split()) for _ in range(8))
    texts = [f"{filler()} the women vile. {filler()}" if i % 2 else f"{filler()} the men fine. {filler()}" for i in range(400)]
    docs = make_docs(texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    test = make_docs(["the women walk", "the men walk", "vile"])

    def gap(fairness):
        model = toxicity.train(docs, labels, fairness=fairness)
        s = {r["doc_id"]: r["score"] for r in toxicity.score(test, model).collect()}
        return abs(s[0] - s[1]), s[2]

    (plain, _), (fair, vile) = gap(0.0), gap(50.0)
    assert fair < plain / 3 and vile > 0.5


def test_toxicity_of_unusual_rows(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(rows) == len(odd_texts) and all(r["score"] == 0 and r["predicted"] == 0 for r in rows)
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 1), (4, 0), (5, 0), (6, 0), (9, 1)], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert scores[0] == scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.score(docs.limit(0), toxicity.train(docs, labels)).count() == 0


def peak_bytes(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("stage", ["toxicity", "near_dedup"])
def test_workers_take_texts_in_small_steps(make_docs, monkeypatch, stage):
    """Arrays of a worker take a few MB, however much text a batch brings."""
    runs = []
    docs = make_docs(["a"]).select("doc_id", "text")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run))
    if stage == "toxicity":
        toxicity.scored(docs, (np.arange(0, toxicity.BUCKETS, 2000), np.ones(2098), 0.0), "p")
    else:
        near_dedup.sets_of(docs, 5)
    text = pa.array([f"{i} " + "some words of a text " * 100 for i in range(2000)])
    ids = pa.array(range(2000), pa.int64())
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "text": text} if stage == "toxicity" else
                                       {"doc_id": ids, "copy": ids, "text": text})
    rows = []
    assert peak_bytes(lambda: rows.extend(b.num_rows for b in runs[0](iter([batch])))) < 32 << 20
    assert sum(rows) == 2000


def test_fit_looks_features_up_in_small_steps():
    """Present features of the sample are found a few rows at a time, with the same pairs as row by row."""
    rng = np.random.default_rng(3)
    chosen = np.sort(rng.choice(toxicity.BUCKETS, 2000, replace=False))
    rows = [np.unique(rng.integers(0, toxicity.BUCKETS, 1000)).astype("<i4") for _ in range(4000)]
    rows[7] = chosen.astype("<i4")
    rows[600] = np.zeros(0, "<i4")
    found = []
    assert peak_bytes(lambda: found.append(toxicity.Presence(rows, chosen))) < 16 << 20
    got = set(zip(found[0].row.tolist(), found[0].column.tolist()))
    place = {c: i for i, c in enumerate(chosen.tolist())}
    assert got == {(i, place[x]) for i, r in enumerate(rows) for x in r.tolist() if x in place}
    assert toxicity.Presence([], chosen).times(np.ones(2000)).tolist() == []


def planted_pair(name, n, other):
    """Two texts of n words whose last ``other`` differ: they share n - 4 - other of n - 4 + other shingles."""
    w = [f"{name}x{i}" for i in range(n)]
    return [" ".join(w), " ".join(w[:n - other] + [f"{name}y{i}" for i in range(other)])]


def test_pipeline_drops_copies_from_80_percent(spark, make_docs):
    """Pairs that share 80 to below 85 percent go too, those below 80 stay."""
    pairs = [planted_pair(f"p{k}", n, other) for k, (n, other) in enumerate(
        [(94, 10), (184, 20), (94, 9), (104, 10), (94, 11), (184, 21)])]
    texts = [t for pair in pairs for t in pair]
    alike = [100 * len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs]
    assert alike[:2] == [80, 80] and all(80 < x < 85 for x in alike[2:4]) and all(75 < x < 80 for x in alike[4:])
    stays = corpus_pipeline.drop_near_copies(spark, make_docs(texts), "").collect()
    assert sorted(r["doc_id"] for r in stays) == [0, 2, 4, 6, 8, 9, 10, 11]


@pytest.mark.parametrize("percent", [60, 80])
def test_sketches_keep_pairs_at_the_threshold(make_docs, percent):
    """Pairs exactly at the threshold come through the sketches, whatever the threshold is."""
    p = percent / 100
    tail = [comb(near_dedup.SKETCH, k) * p ** k * (1 - p) ** (near_dedup.SKETCH - k) for k in range(near_dedup.SKETCH)]
    assert sum(tail[:near_dedup.agreement(percent)]) <= 1e-6
    shared, other = {60: (60, 20), 80: (80, 10)}[percent]
    texts = [t for k in range(400) for t in planted_pair(f"q{k}", shared + other + 4, other)]
    assert 100 * shared == percent * (shared + 2 * other)
    rows = near_dedup.near_duplicates(make_docs(texts), percent=percent, trees=12).collect()
    assert sorted(r["doc_id"] for r in rows if r["kept"]) == list(range(0, 800, 2))


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stored(stage(spark, kept, sf), "test-stage")
        assert after.columns == columns and after.exceptAll(kept).count() == 0
        if name == "toxicity":
            toxic = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1")
            assert kept.join(toxic, "doc_id").count() > after.join(toxic, "doc_id").count()
        if name == "quality":
            for r in kept.collect():
                n, _, _, _, again = brute_counts(r["text"])
                if n < 10 or 100 * again > 20 * n:
                    assert after.filter(after.doc_id == r["doc_id"]).count() == 0
        if name == "near_dedup":
            rows = kept.collect()
            component, _ = brute_components([r["doc_id"] for r in rows], [r["text"] for r in rows], corpus_pipeline.SIMILAR)
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(component))
        kept = after
    from test_tokens import check_pieces

    pieces = corpus_pipeline.STAGES[3][1](spark, kept, sf)
    check_pieces(pieces, {r["doc_id"]: r["text"] for r in kept.collect()}, 2048)
