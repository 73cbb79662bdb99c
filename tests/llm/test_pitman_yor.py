"""The hierarchical Pitman-Yor model: counts, base scores, normalisation and sampling (11)."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from routeyard.llm import pitman_yor as hpy


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def prose(rng, n):
    """Texts of a small bigram chain with a hot word."""
    words = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        at, text = rng.randrange(60), []
        for _ in range(rng.randint(1, 60)):
            text.append("The" if rng.random() < 0.3 else words[at])
            at = (at * 7 + rng.choice([0, 0, 0, 1, 5])) % 60
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("part_tokens,chunk_bytes", [(1 << 22, 1 << 24), (700, 4000)])
def test_counts_and_base_equal_brute_force(make_docs, odd_texts, part_tokens, chunk_bytes):
    rng = random.Random(1)
    texts = [*odd_texts, *prose(rng, 150), "the " * 3000]
    ids = [*range(len(texts) - 2), 5, None]
    docs = make_docs(texts, ids)
    got = hpy.language_scores(docs, hpy.held_out(), part_tokens=part_tokens, chunk_bytes=chunk_bytes).collect()
    train = {}
    for i, t in zip(ids, texts):
        if not held(i):
            for w in tokens(t):
                train[w] = train.get(w, 0) + 1
    n, v = sum(train.values()), len(train)
    want = sorted((str(i), len(tokens(t)), sum(w in train for w in tokens(t)), n, round(sum(
        math.log10((train.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 5)) for i, t in zip(ids, texts))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def model_of(texts, parts, hot, context):
    """Probability of every training word and of an unknown one behind a context, as the operator's steps give it."""
    owners = 2
    words = sorted({w for t in texts for w in t.split()})
    probes = [f"{context} {w}" for w in words] + [f"{context} neverseen", context]     # the last one ends behind the context
    batch = pa.RecordBatch.from_pydict({"text": texts + probes})
    flags = np.array([False] * len(texts) + [True] * len(probes))
    sizes, found = hpy.chunk_pairs(batch, flags, parts, hot)
    rows = [(part, 0, None, None, *columns) for part, *columns in found] + [(0, 0, list(range(len(flags))), hpy.packed(sizes), *[None] * 8)]
    sent = hpy.as_table(rows, hpy.PAIRS)
    work = hpy.Exchange(parts, owners, hot)
    of = lambda t, c, k: t.filter(pa.compute.equal(t.column(c), k))
    group = lambda t, c: {k: of(t, c, k) for k in sorted(set(t.column(c).to_pylist()))}
    by_part = group(sent, "part")
    announced = pa.concat_tables([work.announce(t) for t in by_part.values()])
    first = pa.concat_tables([work.first_reply(t) for t in group(announced, "owner").values()])
    seated = pa.concat_tables([work.seat(t, of(first, "part", p)) for p, t in by_part.items()])
    second = pa.concat_tables([work.second_reply(t, of(seated, "owner", o)) for o, t in group(announced, "owner").items()])
    total = {}
    for p, t in by_part.items():
        part = hpy.Part(t, parts, hot)
        count, base, model = work.predicted(p, part, *part.replies(of(second, "part", p), owners))
        asked = hpy.shingles.word_hashes(np.frombuffer(context.lower().encode(), np.uint8), np.array([0, len(context.encode())]),
                                         hpy.shingles.NOT_BLANK)[0]
        at = np.flatnonzero(part.contexts[part.context] == asked[0]) if len(part.contexts) else []
        for i in at:
            total[int(part.words[part.word[i]])] = (float(model[i]), float(10 ** base[i]))
    return total


@pytest.mark.parametrize("context", ["the", "w3", "unseencontext"])
def test_predictions_add_up_to_one(context):
    """Over all training types, the end and one unknown word, in split contexts, plain ones and ones without customers."""
    texts = [t.lower() for t in prose(random.Random(2), 200)]
    the = int(hpy.shingles.word_hashes(np.frombuffer(b"the", np.uint8), np.array([0, 3]), hpy.shingles.NOT_BLANK)[0][0])
    for parts, hot in ((1, {}), (5, {the: 4})):
        total = model_of(texts, parts, hot, context)
        assert len(total) == len({w for t in texts for w in t.split()}) + 2
        assert sum(p for p, _ in total.values()) == pytest.approx(1, abs=1e-9)
        assert sum(p for _, p in total.values()) == pytest.approx(1, abs=1e-9)


def test_tables_follow_the_posterior():
    """Gibbs samples of one word's tables against the exact posterior: Stirling numbers times weights."""
    d, weight, c = 0.6, 0.8, 9
    ways = {0: {0: 1.0}}                                    # generalised Stirling numbers by their recursion
    for n in range(c):
        ways[n + 1] = {t: ways[n].get(t - 1, 0) + (n - t * d) * ways[n].get(t, 0) for t in range(1, n + 2)}
    exact = np.array([ways[c][t] * weight ** t for t in range(1, c + 1)])
    exact /= exact.sum()
    rng = np.random.default_rng(5)
    customers = np.full(20_000, c)
    state = hpy.Tables(customers, np.full(20_000, weight), rng)
    out = np.zeros(20_000, np.int64)
    for _ in range(12):
        state.sweep(customers, np.full(20_000, weight), d, rng)
        state.counts(out)
        assert all((s.sum(axis=1) == c).all() and (s >= 0).all() for _, s in state.groups)
    assert np.abs(np.bincount(out, minlength=c + 1)[1:] / 20_000 - exact).max() < 0.015
    two = hpy.seatings(np.full(20_000, 2), np.full(20_000, 0.3), np.arange(20_000), np.ones(20_000), d, 1)[-1]
    new = 0.3 * (hpy.STRENGTH + d)                          # about, since the restaurant's own tables are those of the sweep before
    assert 0.8 * new / (1 - d + new) < (two == 2).mean() < 1.4 * new / (1 - d + new)


def test_common_words_follow_the_posterior_as_well():
    """Rows of thousands of customers, each in a few sweeps, against the exact mean; the parent's included."""
    rng = np.random.default_rng(7)
    for d, weight, c in ((0.7, 0.8, 20_000), (0.3, 3.0, 3_000), (0.9, 40.0, 1_500)):
        log_ways = np.full(401, -np.inf)                    # of up to 400 tables
        log_ways[1] = 0.0
        for n in range(1, c):
            with np.errstate(divide="ignore"):
                stay = log_ways + np.log(np.maximum(n - np.arange(401) * d, 0.0))
            log_ways = np.logaddexp(np.concatenate([[-np.inf], log_ways[:-1]]), stay)
        chance = log_ways[1:] + np.arange(1, 401) * np.log(weight)
        chance = np.exp(chance - chance.max())
        mean = (chance * np.arange(1, 401)).sum() / chance.sum()
        rows, out = np.full(4_000, c), np.zeros(4_000, np.int64)
        state = hpy.Tables(rows, np.full(4_000, weight), rng)
        for _ in range(2):
            state.sweep(rows, np.full(4_000, weight), d, rng)
        state.counts(out)
        assert out.mean() == pytest.approx(mean, rel=0.03)
    # of words behind 20,000 contexts each, with the discount of a word alone, nearly none opens a second table
    contexts = np.concatenate([np.full(500, 20_000), np.ones(1000, np.int64), np.full(60, 2)])
    d = hpy.discount(1000, 60)
    for tables in hpy.parent_tables(contexts, len(contexts), 1, 0, 0):
        share = d * (tables.sum() + hpy.STRENGTH / d) / (len(contexts) + 1)
        assert (tables[:500] - 1).mean() == pytest.approx(share / d, rel=0.2)      # Poisson, in the limit


def test_large_rows_keep_their_customers():
    rng = np.random.default_rng(3)
    customers = rng.integers(3, 100_000, 300)
    weight = rng.exponential(50.0, 300)
    state = hpy.Tables(customers, weight, rng)
    for _ in range(5):
        state.sweep(customers, weight, 0.7, rng)
    for rows, sizes in state.groups:
        assert (sizes.sum(axis=1) == customers[rows]).all()


def test_model_beats_words_alone_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    scores = hpy.language_scores(docs, hpy.held_out(), part_tokens=1 << 20)
    scores = spark.createDataFrame(scores.collect(), hpy.SCORED).filter(hpy.held_out())
    assert hpy.perplexity(scores) < 0.3 * hpy.perplexity(scores, "base_score")


def test_unusual_rows(make_docs):
    none = hpy.language_scores(make_docs(["a b"]).limit(0), F.lit(False))
    assert none.count() == 0
    rows = hpy.language_scores(make_docs([None, "", "a"], ids=[None, 1, 1]), F.lit(None).cast("boolean")).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows) == [
        ("1", 1, 1, 4), ("1", 2, 2, 4), ("None", 1, 1, 4)]
    alone = hpy.language_scores(make_docs(["a b"]), F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in alone] == [(0, 0, 0.0, 0.0)]
