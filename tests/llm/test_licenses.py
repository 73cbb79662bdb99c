"""License notices against a plain scan of all diagonals; what swapped identity terms move at the shipped setting."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeyard.llm import license_scan as LS
from routeyard.llm import toxicity
from routeyard.llm.common import table

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def best_coverage(text, template):
    """The highest coverage of any tight run of neighbouring diagonals within a span; 0 if none covers enough."""
    n, size = len(template), LS.GRAM
    grams = {}
    for t in range(n - size + 1):
        grams.setdefault(tuple(template[t:t + size]), []).append(t)
    diagonals = {}
    for p in range(len(text) - size + 1):
        for t in grams.get(tuple(text[p:p + size]), []):
            diagonals.setdefault(p - t, []).append((p, t))
    order, best = sorted(diagonals), 0.0
    for i in range(len(order)):
        hits = []
        for j in range(i, len(order)):
            if j > i and order[j] - order[j - 1] > LS.GAP:
                break
            hits += diagonals[order[j]]
            low, high = min(p for p, _ in hits), max(p for p, _ in hits)
            if high + size - low > LS.STRETCH * n:
                break
            covered = len({t + k for _, t in hits for k in range(size)}) / n
            best = max(best, covered if covered >= LS.COVER else 0.0)
    return best


def edited(rng, words):
    """A notice with words left out, put in, changed, or said again."""
    out = []
    for w in words:
        kind = rng.random()
        out += [] if kind < 0.04 else [w, "more"] if kind < 0.08 else ["else"] if kind < 0.11 else [w]
    return out + (out[-rng.randint(1, 6):] * rng.randint(1, 3) if rng.random() < 0.3 else [])


def test_labels_and_scores_equal_a_plain_scan(make_docs):
    rng, templates = random.Random(4), [(label, words_of(text)) for label, text in LS.TEMPLATES]
    filler = lambda: [rng.choice("the of a license licensed under version software work".split()) for _ in range(rng.randint(0, 25))]
    texts = [None, "", "licensed under", " ".join(templates[0][1]) * 1]
    for _ in range(220):
        parts = filler()
        for _ in range(rng.randint(0, 3)):
            parts += edited(rng, rng.choice(templates)[1]) + filler()
        texts.append(" ".join(parts))
    got = {r["doc_id"]: r for r in LS.licenses(make_docs(texts)).collect()}
    labelled = 0
    for i, text in enumerate(texts):
        words = words_of(text)
        base = {label for phrase, label in LS.PHRASES.items() for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()}
        cover = [(label, best_coverage(words, t)) for label, t in templates]
        assert got[i]["labels"] == ",".join(sorted(base | {label for label, c in cover if c > 0})), text
        assert got[i]["score"] == pytest.approx(1.0 if base else max(c for _, c in cover)), text
        labelled += bool(got[i]["labels"]) and not base
    assert labelled > 50


GROUPS = ["women", "men", "muslims", "christians", "jews", "immigrants", "refugees"]


def gap(spark, docs, labels, texts, **setting):
    """The mean range of a text's scores when the group that a sentence behind it names is swapped."""
    model = toxicity.train(docs, labels, **setting)
    rows = [(1000 * i + k, f"{t or ''} The {g} were there.") for i, t in enumerate(texts) for k, g in enumerate(GROUPS)]
    s = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    return float(np.mean([np.ptp([s[1000 * i + k] for k in range(len(GROUPS))]) for i in range(len(texts))]))


@pytest.mark.parametrize("planted", [False, True])
def test_swapped_terms_at_the_shipped_setting(spark, sf, planted):
    """Held-out documents; ``planted``: toxic documents name women, others men, so that the classifier could learn the name."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels").select("doc_id", "toxic")
    held = [r["text"] for r in docs.filter(toxicity.held_out()).orderBy("doc_id").limit(60).collect()]
    if planted:
        named = F.when(F.col("toxic") == 1, " The women were here.").otherwise(" The men were here.")
        docs = docs.join(labels.dropDuplicates(["doc_id"]), "doc_id").select("doc_id", F.concat("text", named).alias("text"))
    shipped, without = (gap(spark, docs, labels, held, **s) for s in ({}, {"fairness": 0.0}))
    print(f"counterfactual gap, planted {planted}: {shipped:.6f} shipped, {without:.6f} without")
    assert shipped < without / 2 if planted else shipped < 0.01
