"""Quality rules, in DataFrame functions only.

Counts are taken inside each row with array functions, so no text is shuffled.  The verdict is a short-circuit cascade: one
conditional whose branches stop at the first rejection, ordered by what a rule rejects per unit of cost, both measured on a
sample.  ``passing`` needs the verdict only, so every branch takes its own counts from the text.  ``judged`` returns five
counts, which are taken for every row; its branches use them and take what else they need (letters, scripts, words said
twice) only when reached, behind a failed base rule never.  The order changes the time, never the verdict.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routeyard.llm.common import free_name, register, table
from routeyard.runtime import once

# Fixed patterns of the contract.
SPACES = r"[\x20\x09-\x0D]+"
NO_SYMBOLS = r"[^#*$%&|<>]+"
# Everything but letters, and everything but letters of scripts written without blanks between words.
NO_LETTERS = r"[^\p{L}]+"
NO_UNSPACED = "[[^" + "".join(rf"\p{{Is{x}}}" for x in (
    "Han", "Hiragana", "Katakana", "Bopomofo", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan")) + r"]\P{L}]+"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SAMPLE_ROWS = 1000
#: Conditions of the cascade, beyond the least number of words.
CONDITIONS = ("symbols", "word_length", "repeated_lines", "stutter", "letters", "repeated_words")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable can't be expanded into its uses."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of five that occur at least twice in the text.

    Windows are told apart by 64-bit hashes.  Texts without a repeated window, the usual case, stop after sorting
    the hashes; the others sort (hash, place) and add up the union of the repeated windows.
    """
    n = F.size(words) - (WINDOW - 1)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1), p + WINDOW) - p))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda p, i: (F.get(s, i - 1)["h"] == p["h"]) | (F.get(s, i + 1)["h"] == p["h"]))
        return F.sort_array(F.transform(twice, lambda p: p["i"]))

    def of_windows(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        any_twice = let(F.sort_array(g), lambda s: F.exists(F.sequence(F.lit(1), F.size(s)),
                                                           lambda i: F.get(s, i) == F.get(s, i - 1)))
        return F.when(any_twice, let(let(ordered, places), covered)).otherwise(F.lit(0).cast("long"))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n > 0, let(let(hashed, windows), of_windows)).otherwise(F.lit(0).cast("long"))


def measures(body: Column, ws: Column) -> dict[str, Column]:
    """The five counts and the lines with a word, each from the text and its words."""
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_replace(x, SPACES, "") != "")

    def of_lines(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"),
                        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    return {"n_words": F.size(ws).cast("long"), "word_chars": F.length(F.array_join(ws, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(body, NO_SYMBOLS, "")).cast("long"),
            "n_repeat_words": repeated_words(ws), "lines": let(lines, of_lines)}


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def unspaced(body: Column) -> Column:
    """Whether most letters are of scripts written without blanks, where a word between blanks is a whole sentence."""
    letters = lambda pattern: F.length(F.regexp_replace(body, pattern, ""))
    return 2 * letters(NO_UNSPACED) > letters(NO_LETTERS)


def rules(c: Column | dict[str, Column], body: Column, ws: Column) -> dict[str, Column]:
    """Rejecting conditions beyond the number of words, wide enough to leave ordinary prose alone.

    ``c`` has the counts; letters, scripts and words said twice in a row are taken from the text and its words on the spot.
    """
    n = c["n_words"]
    return {
        "symbols": 10 * c["n_symbols"] > n,
        "word_length": let(c["word_chars"], lambda x: (x < 2 * n) | (x > 25 * n)) & ~unspaced(body),
        "repeated_lines": let(c["lines"], lambda x: 2 * x["n_dup_lines"] > x["n_lines"]),
        "stutter": 3 * F.size(F.filter(ws, lambda w, i: F.get(ws, i - 1) == w)) > n,
        "letters": 2 * F.length(F.regexp_replace(body, NO_LETTERS, "")) < c["word_chars"],
        "repeated_words": 100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * n,
    }


def from_text(text: Column, body) -> Column:
    """``body`` of the text's words and of all rejecting conditions; each takes its own counts when it is evaluated."""
    whole = F.coalesce(text, F.lit(""))
    return let(words_of(text), lambda ws: body(ws, rules(measures(whole, ws), whole, ws)))


def first_rejection(n_words: Column, conditions: dict[str, Column], order: list[str]) -> Column:
    """Whether no rule rejects, tried in this order behind the least number of words."""
    out = F.when(n_words < MIN_WORDS, False)
    for name in order:
        out = out.when(conditions[name], False)
    return out.otherwise(True)


def cascade(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the conditions, those that reject most per second first.

    The sample has about ``rows`` rows, all of a smaller table.  A condition's cost is the time it adds to splitting the
    sample's texts into words, the shorter of two runs.
    """
    text, n = F.col("text"), docs.count()
    share = min(1.0, rows / max(n, 1))
    sample = (docs.select("text") if share == 1 else docs.select("text").sample(share, seed=7)).persist()
    try:
        total = sample.count()
        if total == 0:
            return list(CONDITIONS)

        def timed(body) -> tuple[float, int]:
            condition, runs = from_text(text, body), []
            for _ in range(2):
                begin = time.perf_counter()
                hits = sample.agg(F.count_if(condition).alias("n")).first()["n"]
                runs.append(time.perf_counter() - begin)
            return min(runs), hits

        rest, _ = timed(lambda ws, _: F.size(ws) < 0)
        score = {}
        for name in CONDITIONS:
            cost, hits = timed(lambda _, conditions: conditions[name])
            score[name] = (hits / total) / max(cost - rest, 1e-4)
        return sorted(CONDITIONS, key=lambda name: -score[name])
    finally:
        sample.unpersist()


def passing(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The rows that ``judged`` gives ``kept``, all columns unchanged."""
    order = order or cascade(docs)
    return docs.filter(from_text(F.col("text"), lambda ws, conditions: first_rejection(F.size(ws), conditions, order)))


def judged(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """All columns, the five counts, base_failed and kept.

    A null or empty text has no words, fails the base rule and isn't kept; repeated rows are judged alike, one result
    each; an empty table gives no rows.  Columns of ``docs`` named like a count give way to the count.
    """
    order = [name for name in order or cascade(docs) if name != "repeated_words"]       # the base rule has it
    body = F.coalesce(F.col("text"), F.lit(""))

    def of_words(ws: Column) -> Column:
        def verdict(c: Column) -> Column:
            failed = base_failed(c["n_words"], c["n_repeat_words"])
            kept = F.when(failed, False).otherwise(first_rejection(c["n_words"], rules(c, body, ws), order))
            return F.struct(c.alias("c"), failed.alias("failed"), kept.alias("kept"))

        return let(F.struct(*[value.alias(name) for name, value in measures(body, ws).items()]), verdict)

    rest = docs.drop(*COUNTS, "base_failed", "kept")
    found = free_name(rest, "found")
    out, c = rest.withColumn(found, once(let(words_of(F.col("text")), of_words))), F.col(found)["c"]
    return out.select(*rest.columns, c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"),
                      c["n_symbols"].alias("n_symbols"), c["lines"]["n_dup_lines"].alias("n_dup_lines"),
                      c["n_repeat_words"].alias("n_repeat_words"), F.col(found)["failed"].alias("base_failed"),
                      F.col(found)["kept"].alias("kept"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, body, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
p AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT doc_id, i, list_aggregate(ws[i:i + 4], 'string_agg', ' ') AS gram FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
o AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(body, '[^\p{L}]+', '', 'g')) AS letters,
             length(regexp_replace(body, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]|\P{L}', '', 'g')) AS unspaced
      FROM w LEFT JOIN o USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR (word_chars < 2 * n_words OR word_chars > 25 * n_words) AND 2 * unspaced <= letters
            OR 2 * n_dup_lines > n_lines OR 3 * n_stutter > n_words OR 2 * letters < word_chars) AS kept
FROM b
"""


@register("op8_quality", ORACLE)
def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).drop("text")
