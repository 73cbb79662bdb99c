"""License notices by diagonal voting, and a base search for three phrases.

Words are runs of digits, lower-case letters (after lower-casing A to Z) and characters beyond ASCII.  Every window of
``GRAM`` words of every text is hashed, and Spark joins all of them to the windows of the notice templates.  A hit at
place p of a text and place t of a template votes for the diagonal p - t: a notice quoted word for word puts all its hits
on one diagonal, and words left out or put in shift the rest to a neighbouring one.  Votes are summed per diagonal,
diagonals at most ``GAP`` apart are merged, and a merged span is verified: its hits must cover at least ``COVER`` of the
template's words and the span may be at most ``STRETCH`` times as long as the template.  A longer span is verified by its
longest runs of neighbouring diagonals that are short enough: words repeated behind a notice don't hide it.

The index of template windows is broadcast: it has as many rows as the templates have words, a few hundred here, and
``scan`` refuses templates of over a million words.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routeyard.llm import shingles
from routeyard.llm.common import register, steps, stored, table, utf8

GRAM, GAP, COVER, STRETCH = 3, 4, 0.7, 1.5
MAX_TEMPLATE_WORDS = 1_000_000
#: Phrases of the base search and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening sentences of well-known public licenses and the usual one-line notices, with the label that each one gives.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
)
SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, grams array<long>"
NOTICES = "row long, label string, template int, first_word long, last_word long, coverage double"
#: Stands for the text itself among its windows, so that one join gives texts without a hit a row too.
SELF = 0


def word_grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of ``size`` words; never SELF."""
    out = shingles.windows(words, size).view(np.int64)
    return np.where(out == SELF, 1, out)


def words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return shingles.word_hashes(data, np.array([0, len(data)]), shingles.ALNUM)[0]


def template_rows(templates, size: int) -> list[tuple[int, int, int]]:
    """(hash, template, place) of all template windows; places count from 1 so that they differ from SELF's."""
    total = sum(len(words_of(text)) for _, text in templates)
    if total > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates have {total} words; the broadcast index is bounded by {MAX_TEMPLATE_WORDS}")
    return [(int(h), k, place) for k, (_, text) in enumerate(templates)
            for place, h in enumerate(word_grams(words_of(text), size).tolist())]


def tight_runs(parts: list[dict], length: int, gram: int, cover: float, stretch: float) -> list[tuple[int, int, float]]:
    """(first word, last word, coverage) of the runs of neighbouring diagonals that are tight and cover enough.

    ``parts`` are the diagonals of one span.  Of runs that overlap the one that covers most, then the shortest, stays.
    """
    parts = sorted(parts, key=lambda d: d["diagonal"])
    places = np.zeros(length + 1, np.int64)         # hits per place of the template, counted from 0
    found, end = [], 0
    for start in range(len(parts)):
        before, low, high = end, None, None
        for d in parts[start:end]:
            low = d["low"] if low is None else min(low, d["low"])
            high = d["high"] if high is None else max(high, d["high"])
        while end < len(parts):
            d = parts[end]
            least, most = (d["low"], d["high"]) if low is None else (min(low, d["low"]), max(high, d["high"]))
            if most + gram - least > stretch * length:
                break
            low, high, end = least, most, end + 1
            places[np.array(d["places"])] += 1
        if end > before:                            # else a run that began earlier holds this one
            hit = places[:length] > 0
            covered = hit.copy()
            for k in range(1, gram):
                covered[k:] |= hit[:-k]
            if covered.sum() >= cover * length:
                found.append((low, high + gram - 1, float(covered.sum() / length)))
        if end > start:
            places[np.array(parts[start]["places"])] -= 1
        else:
            end = start + 1
    kept: list[tuple[int, int, float]] = []
    for run in sorted(found, key=lambda x: (-x[2], x[1] - x[0], x[0])):
        at = bisect(kept, run)
        if (at == 0 or kept[at - 1][1] < run[0]) and (at == len(kept) or run[1] < kept[at][0]):
            kept.insert(at, run)
    return kept


def scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, gram: int = GRAM, gap: int = GAP,
         cover: float = COVER, stretch: float = STRETCH) -> tuple[DataFrame, DataFrame]:
    """Base findings per row, and verified notices: (row, label, template, first_word, last_word, coverage)."""
    spark = docs.sparkSession
    wanted = [(label, [int(h) for h in words_of(phrase)]) for phrase, label in phrases.items()]

    def base(words: np.ndarray) -> tuple[list[tuple[int, str]], int]:
        found = []
        for label, parts in wanted:
            n = len(words) - len(parts) + 1
            if n > 0:
                same = np.ones(n, bool)
                for j, h in enumerate(parts):
                    same &= words[j:j + n] == np.uint64(h)
                found += [(i, label) for i in np.flatnonzero(same).tolist()]
        return found, len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                words, first = shingles.word_hashes(*utf8(part.column("text")), shingles.ALNUM)
                rows = [[], [], [], [], [], []]
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    found, n = base(words[a:b])
                    places = [p for p, _ in found]
                    grams = np.concatenate([np.array([SELF]), word_grams(words[a:b], gram)])
                    for column, value in zip(rows, (b - a, n, min(places, default=None), max(places, default=None),
                                                    sorted({x for _, x in found}), grams)):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, k) for c, k in zip(rows, kinds)]],
                    names=[c.split()[0] for c in SCANNED.split(", ")])

    index = spark.createDataFrame([(SELF, -1, 0), *template_rows(templates, gram)], "gram long, template int, place int")
    narrow = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    windows = (docs.select("doc_id", "text").mapInArrow(run, SCANNED)
               .withColumn("row", F.monotonically_increasing_id())
               .select("row", *narrow, F.posexplode("grams").alias("spot", "gram")))
    hits = windows.join(F.broadcast(index), "gram").withColumn("spot", F.col("spot") - 1)
    mine = F.col("template") == -1
    hits = stored(hits.select("row", *[F.when(mine, F.col(c)).alias(c) for c in narrow], "template", "place", "spot"),
                  "hits")

    votes = (hits.filter("template >= 0").withColumn("diagonal", F.col("spot") - F.col("place"))
             .groupBy("row", "template", "diagonal")
             .agg(F.collect_set("place").alias("places"), F.min("spot").alias("low"), F.max("spot").alias("high")))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    opens = (F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int")
    merged = (votes.withColumn("span", F.sum(F.coalesce(opens, F.lit(0))).over(order))
              .groupBy("row", "template", "span")
              .agg(F.collect_list(F.struct("diagonal", "low", "high", "places")).alias("parts"), F.min("low").alias("low"),
                   F.max("high").alias("high")))
    lengths, names = [len(words_of(text)) for _, text in templates], [name for name, _ in templates]
    length = F.element_at(F.array(*[F.lit(n) for n in lengths]), F.col("template") + 1)
    # a hit covers its place and the gram - 1 words behind it
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        F.array_distinct(F.flatten(F.col("parts.places"))), lambda p: F.sequence(p, p + gram - 1)))))
    last = F.col("high") + gram - 1
    # runs of a span's diagonals cover no more than the span
    spans = merged.withColumn("coverage", covered / length).filter(F.col("coverage") >= cover).select(
        "row", "template", F.col("low").cast("long").alias("first_word"), last.cast("long").alias("last_word"), "coverage",
        F.when(last - F.col("low") + 1 > stretch * length, F.col("parts")).alias("parts"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                runs = [(r["first_word"], r["last_word"], r["coverage"])]
                if r["parts"] is not None:
                    runs = tight_runs(r["parts"], lengths[r["template"]], gram, cover, stretch)
                out += [(r["row"], names[r["template"]], r["template"], *run) for run in runs]
            if out:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 names=[c.split()[0] for c in NOTICES.split(", ")])

    notices = spans.mapInArrow(verify, NOTICES)
    return hits.filter(mine).select("row", *narrow), notices


def licenses(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document with its base findings, all labels and the best coverage as score (1 with a base finding).

    Null and empty texts have no words and no label; rows that repeat a doc_id are scanned by themselves; an empty table
    gives no rows; further columns are ignored.
    """
    found, notices = scan(docs, **parameters)
    per_row = notices.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("coverage", F.lit(0.0)))
    return found.join(per_row, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.alias("score"))


@register("op2_license_scan")
def op2_license_scan(spark, sf_dir):
    return licenses(table(spark, sf_dir, "documents"))
