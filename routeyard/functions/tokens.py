"""Token counts and token prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.runtime import literal_map


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words of the whole text; NULL has none.

    Turning every kind of whitespace into a space lets the split run on a
    single character, which is about twice as fast as a pattern of classes.
    """
    spaced = F.translate(text, V.WHITESPACE_CHARS, " " * len(V.WHITESPACE_CHARS))
    words = F.array_remove(F.split(spaced, " "), "")
    return F.coalesce(F.size(words), F.lit(0))


def text_tokens(text: Column) -> Column:
    """Words times a fixed rate, cut to an integer."""
    return F.floor(word_count(text) * F.lit(V.WORDS_TO_TOKENS)).cast("bigint")


def image_count(assets: Column) -> Column:
    kinds = F.array(*[F.lit(t) for t in V.IMAGE_ASSET_TYPES])
    found = F.filter(assets, lambda a: F.array_contains(kinds, a["type"]))
    return F.coalesce(F.size(found), F.lit(0))


def input_tokens(text: Column, images: Column) -> Column:
    return text_tokens(text) + images * F.lit(V.TOKENS_PER_IMAGE)


def simple_token_estimate(text: Column, images: Column) -> Column:
    """The coarse estimate; a sample without any token counts as the default."""
    words = F.floor(word_count(text) * F.lit(V.SIMPLE_WORDS_TO_TOKENS)).cast("bigint")
    total = words + images * F.lit(V.TOKENS_PER_IMAGE)
    return F.when(total == 0, F.lit(V.DEFAULT_TOKEN_ESTIMATE).cast("bigint")).otherwise(total)


def output_token_estimate(task_type: Column) -> Column:
    known = literal_map(V.OUTPUT_TOKEN_ESTIMATES)
    return F.coalesce(known[task_type], F.lit(V.DEFAULT_OUTPUT_TOKENS)).cast("bigint")


def token_cost(tokens: Column, price_per_million: Column) -> Column:
    return tokens.cast("double") / F.lit(1e6) * price_per_million


def image_tokens(width: Column, height: Column, family: Column) -> Column:
    """Image tokens by model family; without a size the family default holds."""
    w, h = width.cast("double"), height.cast("double")
    patches = F.floor(w / V.PATCH_SIZE) * F.floor(h / V.PATCH_SIZE)

    scale = F.least(F.lit(float(V.LLAVA_TARGET)) / w, F.lit(float(V.LLAVA_TARGET)) / h)
    side = lambda x: F.floor(F.floor(x * scale) / V.LLAVA_GRID)

    area, tiers = w * h, F
    for bound, tokens in V.QWEN_TIERS:
        tiers = tiers.otherwise(F.lit(tokens)) if bound is None else tiers.when(
            area <= bound, F.lit(tokens))

    low, high = V.GENERIC_IMAGE_TOKEN_RANGE
    sized = (F.when(family == "clip", patches + 1)
             .when(family == "llava", side(w) * side(h))
             .when(family == "qwen", tiers)
             .otherwise(F.greatest(F.lit(low), F.least(patches, F.lit(high)))))
    default = F.coalesce(literal_map(V.DEFAULT_IMAGE_TOKENS)[family],
                         F.lit(V.DEFAULT_IMAGE_TOKENS["generic"]))
    return F.when(width.isNull() | height.isNull(), default).otherwise(sized).cast("bigint")
