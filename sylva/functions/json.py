"""JSON attributes held in strings: path grammar, typed equality and merge patches."""

from __future__ import annotations

import hashlib
import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from sylva.model import InvalidInput

_PATH = re.compile(r"\$(\.[A-Za-z0-9_]+)+")


def check_path(path: str) -> str:
    """``$.`` and dot-separated segments of ASCII letters, digits and underscores."""
    if not _PATH.fullmatch(path):
        raise InvalidInput(f"invalid attribute path: {path!r}")
    return path


def canonical(value) -> str:
    """Minified text with sorted keys, as supplied values are stored and compared."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def attribute_equals(document: str, path: str, value) -> Column:
    """True where the member of ``document`` at ``path`` equals ``value``.

    null and missing members never match; true equals 1 and false 0; numbers compare as numbers, 1 and 1.0 alike;
    text never equals a number; objects and arrays compare as minified text in the stored key order, and also equal a
    string of that text. A document that is no valid JSON matches nothing.
    """
    key = value_key(value)
    if key is None:
        check_path(path)
        return F.lit(False)
    return F.coalesce(attribute_key(document, path) == key, F.lit(False))


def _number_key(value: Column) -> Column:
    """``n`` and the exact integer where a double is one of 64 bits, else its shortest text: equal numbers, equal keys."""
    whole = (F.rint(value) == value) & (F.abs(value) < 2.0**63)
    return F.concat(F.lit("n"), F.when(whole, value.try_cast("long").cast("string")).otherwise(value.cast("string")))


def attribute_key(document: str, path: str) -> Column:
    """The member at ``path`` as one comparable string: ``n`` and a number, or ``t`` and text; null if there is none.

    Two members are equal in the sense of ``attribute_equals`` where their keys are, so the key can be stored as a
    column, sorted by and compared instead of the document. Integers of 64 bits are kept exactly; every other number
    is a double, however wide or small.
    """
    check_path(path)
    raw = F.get_json_object(document, path)
    tag = F.schema_of_variant(F.try_variant_get(F.try_parse_json(document), path, "variant"))
    exact = F.when(tag == "BOOLEAN", F.when(raw == "true", F.lit("1")).otherwise(F.lit("0"))).when(
        tag == "BIGINT", raw.try_cast("long").cast("string")
    )
    return (
        F.when(tag.isin("BOOLEAN", "BIGINT"), F.concat(F.lit("n"), exact))
        .when((tag == "DOUBLE") | tag.startswith("DECIMAL"), _number_key(raw.try_cast("double")))
        .when(tag.isNotNull() & (tag != "VOID"), F.concat(F.lit("t"), raw))
    )


def key_column(path: str) -> str:
    """Name of the stored key column of a declared path: a hash of the whole path, so that no two paths share one."""
    return "attr_" + hashlib.sha256(check_path(path).encode()).hexdigest()[:24]


def value_key(value) -> Column | None:
    """The key of a wanted value; None for null, which equals nothing."""
    if value is None:
        return None
    if isinstance(value, (bool, int, float, Decimal)):
        if value == value and abs(value) != float("inf") and value == int(value) and -(2**63) <= value < 2**63:
            return F.lit(f"n{int(value)}")
        return _number_key(F.lit(float(value)))
    return F.lit("t" + (value if isinstance(value, str) else canonical(value)))


def merge_patch(old, patch):
    """RFC 7396 on parsed values; members of ``patch`` keep the place they have in ``old``."""
    if not isinstance(patch, dict):
        return patch
    result = dict(old) if isinstance(old, dict) else {}
    for key, value in patch.items():
        if value is None:
            result.pop(key, None)
        else:
            result[key] = merge_patch(result.get(key), value)
    return result


@F.pandas_udf(T.StringType())
def folded_patches(first: pd.Series, patches: pd.Series) -> pd.Series:
    """``first`` with each text of ``patches`` merged into it in order; a null ``first`` starts at the first patch,
    whose null members then stay, and a ``first`` that is no JSON object counts as an empty one."""

    def stored(text):
        try:
            return json.loads(text)
        except ValueError:
            return {}

    def fold(start, texts):
        texts = list(texts) if texts is not None else []
        value = stored(start) if start is not None else json.loads(texts.pop(0))
        for text in texts:
            value = merge_patch(value, json.loads(text))
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)

    return pd.Series([fold(a, b) for a, b in zip(first, patches)], dtype=object)


def is_object(column: str) -> Column:
    """Whether a string is a JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(column)).startswith("OBJECT"), F.lit(False))


def is_json(column: str) -> Column:
    return F.try_parse_json(column).isNotNull()
