"""Array arithmetic on embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeyard.fixed_values import FUSION_METHODS


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shared dimensions."""
    pairs = F.zip_with(head(a, b), head(b, a), lambda x, y: x * y)
    return total(pairs)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def mean(v: Column) -> Column:
    return total(v) / F.size(v)


def std_pop(v: Column) -> Column:
    m = mean(v)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(v))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def divide(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    return divide(v, F.greatest(norm(v), F.lit(floor)))


def head(v: Column, other: Column) -> Column:
    """The leading dimensions both vectors have."""
    return F.slice(v, 1, F.least(F.size(v), F.size(other)))


def adjacent_gap(v: Column) -> Column:
    """Mean absolute difference of neighbouring components."""
    gaps = F.zip_with(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))),
                      F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))),
                      lambda a, b: F.abs(a - b))
    return F.when(F.size(v) > 1, total(gaps) / (F.size(v) - 1))


def fuse(text: Column, image: Column, method: str = "concat", text_weight: float = 0.5) -> Column:
    """Combine a text and an image vector."""
    if method not in FUSION_METHODS:
        raise ValueError(f"unknown fusion method: {method}")
    if method == "concat":
        return F.concat(text, image)
    if method == "normalize_concat":
        unit = lambda v: F.when(norm(v) > 0, divide(v, norm(v))).otherwise(v)
        return F.concat(unit(text), unit(image))
    if method == "only_text":
        return text
    if method == "only_image":
        return image
    w = 0.5 if method == "average" else float(text_weight)
    pair = (head(text, image), head(image, text))
    if method == "average":
        return F.zip_with(*pair, lambda a, b: (a + b) / F.lit(2.0))
    return F.zip_with(*pair, lambda a, b: F.lit(w) * a + F.lit(1 - w) * b)


def fused_size(text_dim: Column, image_dim: Column, method: str = "concat") -> Column:
    sizes = {"concat": text_dim + image_dim, "normalize_concat": text_dim + image_dim,
             "average": F.least(text_dim, image_dim),
             "weighted_average": F.least(text_dim, image_dim),
             "only_text": text_dim, "only_image": image_dim}
    return sizes[method]


def interact(text: Column, image: Column, method: str = "concat", interaction: bool = True,
             text_weight: float = 0.5, image_weight: float = 0.5) -> Column:
    """Concatenation with products and absolute differences, and its variants."""
    product = F.zip_with(head(text, image), head(image, text), lambda a, b: a * b)
    gap = F.zip_with(head(text, image), head(image, text), lambda a, b: F.abs(a - b))
    if method == "concat_with_interaction" or (method == "concat" and interaction):
        return F.concat(text, image, product, gap)
    if method == "concat":
        return F.concat(text, image)
    if method == "weighted":
        return F.concat(scale(text, F.lit(text_weight)), scale(image, F.lit(image_weight)))
    if method == "gated":
        return F.concat(scale(image, F.lit(0.5)), scale(text, F.lit(0.5)))
    if method == "hadamard_only":
        return product
    raise ValueError(f"unknown fusion method: {method}")


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                              lambda acc, x: acc + x))


def descriptor_distance(a: Column, b: Column) -> Column:
    """Euclidean distance over root dimension; vectors of unequal size are at 0."""
    d = euclidean(a, b) / F.sqrt(F.greatest(F.size(a), F.lit(1)).cast("double"))
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(0.0))


def embedding_distance(a: Column, b: Column) -> Column:
    """The same distance after cutting to the shared size and normalising."""
    x, y = (l2_normalize(head(p, q), 1e-6) for p, q in ((a, b), (b, a)))
    dim = F.least(F.size(a), F.size(b))
    return F.when(dim == 0, F.lit(0.0)).otherwise(
        euclidean(x, y) / F.sqrt(F.greatest(dim, F.lit(1)).cast("double")))
