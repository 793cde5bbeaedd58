"""Nested values: JSON objects merged and set by path with their types kept, and JSON cut out of scripts.

Values are VARIANTs inside, so numbers, booleans, lists and objects stay what they are. Objects are
written with their keys in alphabetical order.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MAP = "map<string,variant>"


def _fields(v: Column) -> Column:
    """The fields of a variant that is an object; null for anything else."""
    return F.try_variant_get(v, "$", _MAP)


def _nothing(v: Column) -> Column:
    """Whether there is no value: missing, or JSON's null."""
    return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(False))


def parsed(c: Column) -> Column:
    """JSON text as a variant; an empty object where there is no text, null where the text is no JSON."""
    return F.try_parse_json(F.coalesce(c, F.lit("{}")))


def _value(c: Column) -> Column:
    """A scalar, list, map or struct as a variant; null is JSON's null."""
    return F.try_variant_get(F.parse_json(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})), "$.v", "variant")


def _replaced(fields: Column, key: str, value: Column) -> Column:
    return F.to_variant_object(F.map_concat(F.map_filter(fields, lambda k, _: k != key), F.create_map(F.lit(key), value)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times and holds it once."""
    return F.transform(F.array(value), use)[0]


def _set_in(v: Column, path: Sequence[str | int], value: Column) -> Column:
    """The variant with the value at the path; null where a scalar stands in the way."""
    key, rest = path[0], path[1:]

    def in_object(fields: Column) -> Column:
        inner = value if not rest else _set_in(F.try_element_at(fields, F.lit(key)), rest, value)
        return _let(inner, lambda x: F.when(fields.isNotNull() & x.isNotNull(), _replaced(fields, key, x)))

    def in_list(items: Column) -> Column:
        place = F.lit(key) if key >= 0 else F.greatest(F.size(items) + key, F.lit(-1))
        inner = value if not rest else _set_in(F.get(items, place), rest, value)

        def made(x: Column) -> Column:
            inside = F.transform(items, lambda old, n: F.when(n == place, x).otherwise(old))
            return F.to_variant_object(F.when(place < 0, F.array_prepend(items, x)).when(place >= F.size(items), F.array_append(items, x)).otherwise(inside))

        return _let(inner, lambda x: F.when(items.isNotNull() & x.isNotNull(), made(x)))

    def at(old: Column) -> Column:
        if isinstance(key, str):
            return _let(F.when(_nothing(old), F.create_map().cast(_MAP)).otherwise(_fields(old)), in_object)
        return _let(F.when(_nothing(old), F.array().cast("array<variant>")).otherwise(F.try_variant_get(old, "$", "array<variant>")), in_list)

    return _let(v, at)


def json_set(c: Column, path: Sequence[str | int], value: Column) -> Column:
    """JSON text with a value set at a path of keys and list places; missing and null parents are made.

    No text counts as an empty object. A place below zero counts from the end; one beyond either end
    adds there. Text that is no JSON gives null. Where a parent is a scalar, or of the other kind (list or
    object), nothing is set and the text comes back as it was parsed.
    """
    return _let(parsed(c), lambda old: F.when(old.isNotNull(), F.to_json(F.coalesce(_set_in(old, path, _value(value)), old))))


def json_merged(c: Column, **values: Column) -> Column:
    """A JSON object with keys set or replaced; all other values keep their types.

    No text counts as an empty object; text that is no JSON object gives null. A null value is set as JSON's null.
    """
    fields = _fields(parsed(c))
    kept = F.map_filter(fields, lambda k, _: ~k.isin(*values))
    new = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[_value(v) for v in values.values()]))
    return F.when(fields.isNotNull(), F.to_json(F.to_variant_object(F.map_concat(kept, new))))


def json_joined(left: Column, right: Column) -> Column:
    """Two JSON objects as one; of equal keys the right one counts. Null where either text is no object."""
    a, b = _fields(parsed(left)), _fields(parsed(right))
    kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return F.when(a.isNotNull() & b.isNotNull(), F.to_json(F.to_variant_object(F.map_concat(kept, b))))


# --- JSON inside scripts --------------------------------------------------------------------------

#: Whole strings, brackets, escapes outside strings, and quotes that nothing closes.
_TOKENS = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]]|\\.|"', re.DOTALL)


@F.pandas_udf(StringType())
def bracketed(texts: pd.Series) -> pd.Series:
    """The text's first characters up to the bracket that closes its first one; null if none does.

    Brackets inside strings do not count. One pass over strings and brackets holds the depth, so depth and length have no bound.
    """

    def closed(text: str | None) -> str | None:
        if not text or text[0] not in "{[":
            return None
        depth = 0
        for token in _TOKENS.finditer(text):
            sign = token[0]
            if sign in ("{", "["):
                depth += 1
            elif sign in ("}", "]"):
                depth -= 1
                if not depth:
                    return text[: token.end()]
            elif sign == '"':
                return None
        return None

    return texts.map(closed)


def page_state(page: Column, name: str) -> Column:
    """The JSON value that a page's script gives to ``name``, as a variant.

    Null where the name gets no object or list, or one that is cut off or no JSON. It is parsed as data and never evaluated.
    """
    quoted = name.replace("\\", "\\\\").replace(".", "\\.").replace("$", "\\$")
    rest = F.nullif(F.regexp_extract(page, rf"(?s)(?<![\w.$]){quoted}\s*=\s*([\[{{].*)$", 1), F.lit(""))
    return F.try_parse_json(bracketed(rest))


def cut(document: Column, keep: Sequence[str]) -> Column:
    """A nested document, a map by section, without the sections that are not in ``keep``."""
    return F.map_filter(document, lambda k, _: k.isin(*keep))


def section_counts(document: Column, measures: Mapping[str, Callable[[Column], Column]]) -> Column:
    """A struct of sums over a document's sections, each measure a number of one section; zeros without a document. Nothing is exploded."""
    sections = F.map_values(document)
    none = F.lit(0).cast("long")

    def total(measure: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.aggregate(F.transform(sections, lambda s: F.coalesce(measure(s).cast("long"), none)), none, lambda a, x: a + x), none)

    return F.struct(F.coalesce(F.size(sections), F.lit(0)).cast("long").alias("sections"), *[total(f).alias(n) for n, f in measures.items()])
