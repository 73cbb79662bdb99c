"""File, dataset, model and sample names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.runtime import literal_map

_EXT = "(" + "|".join(V.RESULT_EXTENSIONS) + ")"
_SUFFIX = "(" + "|".join(re.escape(s) for s in V.RESULT_SUFFIXES) + ")?"


def first_existing(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """The first candidate that is a column.  Existence decides, not row values."""
    return next((c for c in candidates if c in columns), None)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def model_of_path(path: Column, pool: list[str]) -> Column:
    """First path part in the pool, else the parent folder, else the grandparent.

    Folders that only stamp a run do not name a model.
    """
    parts = F.split(path, "/")
    known = F.filter(parts, lambda p: p.isin(list(pool)))
    stamps = list(V.RUN_STAMP_DIRS)

    def ancestor(up: int) -> Column:
        part = F.try_element_at(parts, F.lit(-up))
        return F.when(~part.isin(stamps) & (part != ""), part)

    return F.coalesce(F.try_element_at(known, F.lit(1)), ancestor(2), ancestor(3))


def dataset_of_path(path: Column, model: Column) -> Column:
    """File name without its result suffix and without the ``model_`` prefix."""
    stem = F.regexp_replace(base_name(path), f"{_SUFFIX}\\.{_EXT}$", "")
    prefix = F.concat(model, F.lit("_"))
    return F.when(F.startswith(stem, prefix), F.substr(stem, F.length(prefix) + 1)).otherwise(
        F.when(model.isNotNull(), stem))


def result_kind(path: Column, dataset: Column) -> Column:
    name = base_name(path)
    return (F.when(name.rlike(f"gpt-4o-mini(_score)?\\.{_EXT}"), "Math")
            .when(name.rlike(f"_openai_result\\.{_EXT}"), "MCQ")
            .when(name.rlike(f"_auxmatch\\.{_EXT}"), "Y/N")
            .when(F.contains(dataset, F.lit("OCRBench")) & ~F.contains(name, F.lit("_results")), "OCRBench")
            .otherwise("VQA"))


def is_derived(path: Column, fragments: tuple[str, ...] = V.DERIVED_RESULT_FRAGMENTS) -> Column:
    """Result files written by a scoring step rather than by inference."""
    return path.rlike("(" + "|".join(re.escape(f) for f in fragments) + ")\\." + _EXT)


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(V.WHITESPACE_CHARS))


def normalize_sample_id(raw: Column, dataset: Column) -> Column:
    clean = strip(raw.cast("string"))
    return F.when(F.contains(clean, F.lit("/")), clean).otherwise(F.concat(dataset, F.lit("/"), clean))


def canonical_dataset(name: Column) -> Column:
    """Exact alias match, else the upper-cased name."""
    aliases = {a: canon for canon, names in V.DATASET_ALIASES.items() for a in names}
    return F.coalesce(literal_map(aliases)[name], F.upper(name))


def canonical_dataset_loose(name: Column) -> Column:
    """Alias match that ignores case and ``-``/``_``, else the name unchanged."""
    fold = lambda s: s.upper().replace("-", "_")
    aliases = {fold(a): canon for canon, names in V.DATASET_ALIASES.items()
               for a in names if fold(a) != "MMMU_DEV"}
    aliases["MMMU_DEV"] = "MMMU_DEV"
    return F.coalesce(literal_map(aliases)[F.replace(F.upper(name), F.lit("-"), F.lit("_"))], name)


def task_of_dataset(dataset: Column) -> Column:
    return F.coalesce(literal_map(V.DATASET_TASKS)[dataset], F.lit("unknown"))


def dataset_of_sample(sample_id: Column, targets: list[str]) -> Column:
    """Text before the first ``/``; else the first target the id starts with; else NULL."""
    lowered = F.lower(sample_id)
    prefix = F.lit(None).cast("string")
    for t in reversed(targets):
        prefix = F.when(F.startswith(lowered, F.lit(t.lower().replace("_", ""))), F.lit(t)).otherwise(prefix)
    before = F.substring_index(sample_id, "/", 1)
    return F.when(F.contains(sample_id, F.lit("/")), F.when(before.isin(list(targets)), before)).otherwise(prefix)


def first_text(*texts: Column) -> Column:
    """First non-empty text, else the empty string."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def first_present_text(*texts: Column) -> Column:
    """First text that is present, even when empty, else the empty string."""
    return F.coalesce(*texts, F.lit(""))


def encoder_stem(name: Column) -> Column:
    return F.element_at(F.split(name, "/"), -1)


def lambda_tag(value: Column) -> Column:
    """A number as part of a file name."""
    s = value.cast("string")
    for old, new in (("+", ""), ("-", "neg"), (".", "_")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def model_name(index: Column, names: list[str]) -> Column:
    """Name of a model index; an index outside the pool is called ``model_{i}``."""
    known = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
    inside = (index >= 0) & (index < len(names))
    return F.when(inside, F.try_element_at(known, index.cast("int") + 1)).otherwise(
        F.concat(F.lit("model_"), index.cast("string")))
