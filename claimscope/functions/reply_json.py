"""Typed extraction of fields from agent reply JSON (VARIANT based).

A reply field is extracted as ``(value, ok)``:

* key missing -> the default (ok),
* key present -> coerced by kind, ``ok`` false when the JSON value is not
  acceptable for the kind (explicit ``null`` included, except for optional kinds).

Accepted JSON per kind (the lax coercions of the typed reply models):

========== ================================================================
float      number, boolean (1.0/0.0), or a string holding a decimal number
           (blanks around it and single ``_`` between digits allowed; no
           ``d``/``f`` suffix, no hexadecimal, no inf/nan)
int        integral number (3 or 3.0), boolean, or a string of digits (blanks
           and ``_`` as for float)
bool       boolean, number 0/1, or one of the strings 0 1 true false t f
           yes no y n on off (any case, surrounding blanks ignored)
str        string
opt_str    string or null
opt_int    int rules, or null
str_list   array whose elements are all strings
status     string naming one of the agent statuses
========== ================================================================

Not reproduced: duplicate keys and the non-standard tokens NaN/Infinity make
the whole reply malformed here (Python's parser accepts them).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimscope import constants as K

TRUE_WORDS = ("1", "true", "t", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "f", "no", "n", "off")


def parse(raw: Column) -> Column:
    """The reply as VARIANT; NULL when the text is not valid JSON."""
    return F.try_parse_json(raw)


def is_object(v: Column) -> Column:
    """True when the parsed reply is a JSON object."""
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT<"), F.lit(False))


def is_object_text(raw: Column, v: Column) -> Column:
    """True when ``raw`` parsed (``v`` not NULL) and is a JSON object: valid
    JSON whose first non-blank character is ``{`` (cheaper than typing the
    whole value)."""
    return F.coalesce(v.isNotNull() & raw.rlike(r"^\s*\{"), F.lit(False))


def field(v: Column, name: str) -> Column:
    """The field as VARIANT: SQL NULL when missing, variant null when JSON null."""
    return F.variant_get(v, f"$.{name}", "variant")


def jtype(x: Column) -> Column:
    """JSON type name of a VARIANT value (VOID, BIGINT, DECIMAL(p,s), DOUBLE,
    STRING, BOOLEAN, ARRAY<...>, OBJECT<...>)."""
    return F.schema_of_variant(x)


def _is_number(t: Column) -> Column:
    return t.isin("BIGINT", "DOUBLE") | t.startswith("DECIMAL")


_DIGITS = "[0-9]+(?:_[0-9]+)*"
#: Decimal texts; checked before a cast, whose own grammar is wider ("0.1d", "0x1p-1").
FLOAT_TEXT = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
#: Whole numbers; zeros may follow a decimal point ("3.0").
INT_TEXT = rf"^[+-]?{_DIGITS}(?:\.0+)?\z"


def _stripped(x: Column) -> Column:
    return F.btrim(F.try_variant_get(x, "$", "string"), F.lit(" \t\n\r\x0b\x0c"))


def _float(x: Column, t: Column | None = None) -> tuple[Column, Column]:
    t = jtype(x) if t is None else t
    s = _stripped(x)
    val = (
        F.when(_is_number(t) | (t == "BOOLEAN"), F.try_variant_get(x, "$", "double"))
        .when((t == "STRING") & s.rlike(FLOAT_TEXT), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))
    )
    return val, val.isNotNull()


def _int(x: Column, t: Column | None = None) -> tuple[Column, Column]:
    t = jtype(x) if t is None else t
    s = _stripped(x)
    num = F.try_variant_get(x, "$", "decimal(38,10)")
    # cheap cases first; CASE branches are evaluated lazily
    val = (
        F.when(t == "BIGINT", F.try_variant_get(x, "$", "bigint"))
        .when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("bigint"))
        .when(t.startswith("DECIMAL") & t.endswith(",0)"), F.try_variant_get(x, "$", "bigint"))
        .when(_is_number(t) & (num == F.floor(num)), num.cast("bigint"))
        .when((t == "STRING") & s.rlike(INT_TEXT), F.regexp_replace(s, r"_|\.0+$", "").try_cast("bigint"))
    )
    return val, val.isNotNull()


def _bool(x: Column, t: Column | None = None) -> tuple[Column, Column]:
    t = jtype(x) if t is None else t
    num = F.try_variant_get(x, "$", "double")
    w = F.lower(F.try_variant_get(x, "$", "string"))  # blanks around a word are not accepted
    val = (
        F.when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
        .when(_is_number(t) & num.isin(0.0, 1.0), num == 1.0)
        .when((t == "STRING") & w.isin(*TRUE_WORDS), F.lit(True))
        .when((t == "STRING") & w.isin(*FALSE_WORDS), F.lit(False))
    )
    return val, val.isNotNull()


def _str(x: Column, t: Column | None = None) -> tuple[Column, Column]:
    t = jtype(x) if t is None else t
    val = F.when(t == "STRING", F.try_variant_get(x, "$", "string"))
    return val, val.isNotNull()


def _str_list(x: Column, t: Column | None = None) -> tuple[Column, Column]:
    t = jtype(x) if t is None else t
    arr = F.try_variant_get(x, "$", "array<string>")
    # ARRAY<STRING>: every non-null element is a string; ARRAY<VOID>: empty or
    # all null; a null element is not a string
    ok = t.isin("ARRAY<STRING>", "ARRAY<VOID>") & (F.size(arr) == F.size(F.array_compact(arr)))
    ok = F.coalesce(ok, F.lit(False))
    return F.when(ok, arr), ok


def _status(x: Column, t: Column | None = None) -> tuple[Column, Column]:
    val, ok = _str(x, t)
    good = ok & val.isin(*K.AGENT_STATUSES)
    return F.when(good, val), F.coalesce(good, F.lit(False))


def _nullable(fn):
    def extract(x: Column, t: Column | None = None) -> tuple[Column, Column]:
        t = jtype(x) if t is None else t
        val, ok = fn(x, t)
        is_null = t == "VOID"
        return F.when(~is_null, val), is_null | ok

    return extract


KINDS = {
    "float": _float,
    "int": _int,
    "bool": _bool,
    "str": _str,
    "opt_str": _nullable(_str),
    "opt_int": _nullable(_int),
    "str_list": _str_list,
    "status": _status,
}

SQL_TYPES = {
    "float": "double", "int": "bigint", "bool": "boolean", "str": "string", "opt_str": "string",
    "opt_int": "bigint", "str_list": "array<string>", "status": "string",
}


def extract(v: Column, name: str, kind: str, default: Column) -> tuple[Column, Column]:
    """``(value, ok)`` of field ``name``; ``default`` when the key is missing."""
    return extract_from(field(v, name), kind, default)


def extract_from(x: Column, kind: str, default: Column, t: Column | None = None) -> tuple[Column, Column]:
    """``(value, ok)`` for an already extracted field VARIANT ``x`` (SQL NULL
    when the key is missing); ``t`` is its precomputed JSON type, if any."""
    val, ok = KINDS[kind](x, t)
    missing = x.isNull()
    value = F.when(missing, default).otherwise(val).cast(SQL_TYPES[kind])
    return value, F.coalesce(missing | ok, F.lit(False))
