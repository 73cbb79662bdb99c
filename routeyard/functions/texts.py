"""Query types, text statistics, loose JSON, Python literals and asset lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from routeyard import fixed_values as V
from routeyard.functions.names import strip

ASSET_TYPE = "struct<type:string,uri:string,tsv_file:string,index:bigint,description:string>"


def joined_text(columns: list[str]) -> Column:
    """The seven text fields joined by one space each; absent fields are empty."""
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) if f in columns else F.lit("")
             for f in V.TEXT_FIELDS]
    return F.concat_ws(" ", *parts)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def query_type(text: Column, dataset: Column) -> Column:
    """Ordered keyword rules: dataset names first, then text plus dataset name."""
    name = F.coalesce(dataset, F.lit(""))
    chain = F
    for kind, keys in V.DATASET_RULES:
        chain = chain.when(has_any(F.lower(name), keys), F.lit(kind))

    def by_text(haystack: Column) -> Column:
        rules = F
        for kind, terms in V.TEXT_RULES:
            rules = rules.when(has_any(haystack, terms), F.lit(kind))
        return rules.otherwise(F.lit("general"))

    return chain.otherwise(let(F.lower(F.concat_ws(" ", text, name)), by_text))


def _share_of(text: Column, char_class: str) -> Column:
    kept = F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))
    return kept / F.greatest(F.length(text), F.lit(1)).cast("double")


def _term_score(text: Column, terms: tuple[str, ...]) -> Column:
    hits = reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms])
    return F.least(hits / F.lit(3.0), F.lit(1.0))


def text_stats(text: Column) -> Column:
    """Shares and capped keyword counts over the whole lower-cased text, as a struct."""
    def measure(t: Column) -> Column:
        length = F.greatest(F.length(t), F.lit(1)).cast("double")
        return F.struct(
            _share_of(t, V.DIGIT_CLASS).alias("digit_ratio"),
            _share_of(t, V.ALPHA_CLASS).alias("alpha_ratio"),
            F.least(F.log1p(length) / F.lit(8.0), F.lit(1.0)).alias("length_score"),
            _term_score(t, V.SPATIAL_TERMS).alias("spatial_terms"),
            _term_score(t, V.CHART_TERMS).alias("chart_terms"),
            _term_score(t, V.COUNTING_TERMS).alias("counting_terms"),
            _term_score(t, V.OCR_TERMS).alias("ocr_terms"))

    return let(F.lower(text), measure)


def parse_list_text(value: Column) -> Column:
    """A JSON or Python-style list of strings; other text becomes a one-item list.

    NULL and blank text give NULL.
    """
    t = strip(value)
    as_json = F.from_json(t, "array<string>")
    as_literal = F.from_json(F.translate(t, "'()", '"[]'), "array<string>")
    is_list = t.rlike(r"(?s)^[\[(].*[\])]$")
    return F.when((t == "") | t.isNull(), F.lit(None)).when(
        is_list, F.coalesce(as_json, as_literal, F.array(t))).otherwise(F.array(t))


# Stand-ins for characters that would otherwise be read twice: a tuple's parentheses until it is known which only group, and
# escaped backslashes and quotes until quoted text is found.  Texts that hold them already stay text.
_OPEN, _CLOSE, _SLASH, _SINGLE, _DOUBLE = "\x01", "\x02", "\x03", "\x04", "\x05"
# No pattern repeats a group: Java's matcher would need a stack as deep as the text is long.
_ESCAPES = r"(?s)\\.|[^\\]+|\\"
_PIECES = r"""'[^']*'|"[^"]*"|[^'"]+|['"]"""                  # quoted text, a run without quotes, a stray quote
_UNITS = r"""(?s)\\x[0-9a-fA-F]{2}|\\[0-7]{1,3}|\\.|[^\\"\t\x04]+|["\t\x04]"""
_SHARED = ("\\n", "\\r", "\\t", "\\b", "\\f", "\\u")              # escapes that JSON knows too
_OWN = {_SINGLE: "'", '"': _DOUBLE, "\t": "\\t", "\\\n": "", "\\a": "\\u0007", "\\v": "\\u000b"}
# Bare text: what only JSON or only other notations know must not become a value, so it is left unreadable.
_BARE = ((r"\b(true|false|null|NaN|Infinity)\b", "?"), (r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false"),
         (r"(?<=\d)_(?=\d)", ""), (r"(?<![\w.])\+(?=[\d.])", ""), (r"(?<![\w.])\.(?=\d)", "0."), (r"(?<=\d)\.(?!\d)", ".0"),
         (r",\s+(?=[\])}])", ","), (r"(?<=[^\s,(\[{]),(?=[\]}])|^,(?=[\]}])", ""))


def _mapped(text: Column, pieces: str, change) -> Column:
    """The text with every piece changed."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pieces), F.lit(0)), change), "")


def _without_escaped_quotes(text: Column) -> Column:
    return _mapped(text, _ESCAPES, lambda e: F.when(e == "\\\\", _SLASH).when(e == "\\'", _SINGLE).when(e == '\\"', _DOUBLE).otherwise(e))


def _quoted_as_json(piece: Column) -> Column:
    def unit(u: Column) -> Column:
        out = F.when(u.rlike(r"^\\x"), F.concat(F.lit("\\u00"), F.substring(u, 3, 2)))
        out = out.when(u.rlike(r"^\\[0-7]"), F.concat(F.lit("\\u"), F.lpad(F.conv(F.substring(u, 2, 3), 8, 16), 4, "0")))
        for text, json in _OWN.items():
            out = out.when(u == text, F.lit(json))
        unknown = F.startswith(u, F.lit("\\")) & ~u.isin(*_SHARED, "\\U", "\\N")
        return out.when(unknown, F.concat(F.lit(_SLASH), F.substring(u, 2, 1))).otherwise(u)

    return F.concat(F.lit('"'), _mapped(F.substring(piece, F.lit(2), F.length(piece) - 2), _UNITS, unit), F.lit('"'))


def _bare_as_json(piece: Column) -> Column:
    for pattern, text in _BARE:
        piece = F.regexp_replace(piece, pattern, text)
    return F.translate(piece, "()", _OPEN + _CLOSE)


def literal_as_json(value: Column) -> Column:
    """A Python literal rewritten as JSON text; text that is no literal gives text that isn't JSON either.

    Tuples become lists.  Parentheses around one number, word or quoted text only group it; around one list they count as a
    tuple.  Sets, bytes, complex numbers, keys that aren't text, joined quoted pieces and the escapes \\N and \\U aren't read.
    """
    quoted = lambda p: (F.startswith(p, F.lit("'")) | F.startswith(p, F.lit('"'))) & (F.length(p) > 1)
    text = _mapped(_without_escaped_quotes(value), _PIECES,
                   lambda p: F.when(quoted(p), _quoted_as_json(p)).otherwise(_bare_as_json(p)))
    for _ in range(3):
        text = F.regexp_replace(text, r'\x01(\s*(?:[^\s\x01\x02\[\]{},"]+|"[^"]*")\s*)\x02', "$1")
    # a comma before the end is what makes a tuple of one
    text = F.translate(F.regexp_replace(text, "," + _CLOSE, _CLOSE), _OPEN + _CLOSE, "[]")
    text = F.replace(F.replace(text, F.lit(_SLASH), F.lit("\\\\")), F.lit(_DOUBLE), F.lit('\\"'))
    return F.when(~value.rlike(r"[\x01-\x05]"), text)


def _whole_json(text: Column) -> Column:
    """A ``variant``, or NULL where the text isn't one JSON value; the parser by itself ignores what follows the first one.

    Text that closes a list early doesn't fit an object, and the other way round.
    """
    in_list, in_object = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"v":'), text, F.lit("}"))
    return F.when(F.try_parse_json(in_object).isNotNull(), F.try_variant_get(F.try_parse_json(in_list), "$[0]", "variant"))


def loose_value(value: Column) -> Column:
    """A ``variant``: JSON, else a Python literal, else the text itself, without blanks around it.

    Objects, lists, numbers, booleans and null keep their types at any depth (``variant_get`` reads them).  NULL and blank
    text give NULL; an object that repeats a key, and the numbers NaN and Infinity, stay text.
    """
    t = strip(value)
    parsed = F.coalesce(_whole_json(t), _whole_json(literal_as_json(t)), t.cast("variant"))
    return F.when((t == "") | t.isNull(), F.lit(None)).otherwise(parsed)


def asset(kind: str, uri: Column | None = None, tsv_file: Column | None = None,
          index: Column | None = None, description: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        F.lit(kind).alias("type"),
        (none if uri is None else uri).cast("string").alias("uri"),
        (none if tsv_file is None else tsv_file).cast("string").alias("tsv_file"),
        (none if index is None else index).cast("bigint").alias("index"),
        (none if description is None else description).cast("string").alias("description"))


def asset_list(value: Column) -> Column:
    """Paths separated by ``;`` or ``,`` as image assets; blanks and ``nan`` dropped."""
    pieces = F.transform(F.split(F.translate(value, ",", ";"), ";"), strip)
    kept = F.filter(pieces, lambda p: p != "")
    empty = F.array().cast(f"array<{ASSET_TYPE}>")
    missing = value.isNull() | (strip(value) == "") | (value == "nan")
    return F.when(missing, empty).otherwise(
        F.transform(kept, lambda p: asset("image", uri=p)))


def assets_of_text(value: Column) -> Column:
    """Assets written as a JSON list or object, with either kind of quotes; NULL where it is neither."""
    as_list = lambda t: F.from_json(t, f"array<{ASSET_TYPE}>")
    double = F.translate(value, "'", '"')
    return F.coalesce(as_list(value), as_list(double))


def row_assets(columns: list[str]) -> Column:
    """All assets of a row: the parsed ``assets`` text, then the paths of every image field."""
    empty = F.array().cast(f"array<{ASSET_TYPE}>")
    parts = [F.coalesce(assets_of_text(F.col("assets")), empty)] if "assets" in columns else []
    parts += [asset_list(F.col(c)) for c in V.ASSET_FIELDS if c in columns]
    return F.concat(*parts) if parts else empty
