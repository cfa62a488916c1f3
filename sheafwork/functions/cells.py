"""Column expressions over string cells: null tokens, noise, numbers, type tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean "no data" (quality scan) and typing null sentinels.
NULL_TOKENS = (
    "", "null", "none", "nil", "nan", "n/a", "na", "n.a.", "-", "--", "?", "??",
    "unknown", "undefined", "tbd", "not available", "not applicable", "#n/a",
)
NULL_SENTINELS = ("", "n/a", "na", "null", "none", "nan", "-", "--", "n.a.", "unknown", "tbd")

# Spreadsheet errors, symbol noise, value shapes.
EXCEL_ERROR = r"(?i)^#(N/A|VALUE!|REF!|DIV/0!|NAME\?|NUM!|NULL!)$"
SYMBOL_NOISE = r"^[^a-zA-Z0-9]+$"
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[a-zA-Z]{2,}$"
DATE_SHAPE = (
    r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2})?)?$"
    r"|^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"
    r"|^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}$"
    r"|^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}$"
)
NUMBER_SHAPE = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_SHAPE = r"^[+-]?\d+$"
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "t", "f")
BOOLEAN_STYLES = (("true", "false"), ("yes", "no"), ("y", "n"), ("1", "0"))
ID_NAME = r"(^id$|_id$|^id_|_id_)"
BOOLEAN_NAME = r"^(is|has|can|should)_"
BOOLEAN_NAME_WORDS = ("flag", "active", "enabled", "disabled", "paid", "verified", "deleted", "approved")
DATE_NAME_WORDS = ("date", "dt", "time")
NUMBER_NAME_WORDS = ("amount", "price", "total", "qty", "quantity", "amt", "count")


def classify_cell(col: Column) -> Column:
    """'null', 'garbage' or 'ok'."""
    v = F.trim(F.coalesce(col, F.lit("")))
    low = F.lower(v)
    repeated = (F.length(v) >= 4) & (F.replace(low, F.substring(low, 1, 1), F.lit("")) == "")
    return (
        F.when(low.isin(*NULL_TOKENS), "null")
        .when(v.rlike(EXCEL_ERROR) | v.rlike(SYMBOL_NOISE) | repeated, "garbage")
        .otherwise("ok")
    )


def is_number(col: Column) -> Column:
    return col.rlike(NUMBER_SHAPE)


def _any_word(col: Column, words: tuple[str, ...]) -> Column:
    return col.rlike("|".join(words))


def looks_numeric(col: Column) -> Column:
    """A number, thousands separators allowed."""
    return is_number(F.replace(col, F.lit(","), F.lit("")))


def guess_column_type(name: Column, n: Column, numeric: Column, boolean: Column) -> Column:
    """Semantic type by name rules, then by at least 80 % of all ``n`` usable values."""
    norm = F.lower(name)
    return (
        F.when(norm.rlike(ID_NAME), "id")
        .when(norm.contains("email"), "email")
        .when(_any_word(norm, ("phone", "tel")), "phone")
        .when(_any_word(norm, DATE_NAME_WORDS), "date")
        .when(norm.rlike(BOOLEAN_NAME) | _any_word(norm, BOOLEAN_NAME_WORDS), "boolean")
        .when(_any_word(norm, NUMBER_NAME_WORDS), "number")
        .when((n > 0) & (numeric * 10 >= n * 8), "number")
        .when((n > 0) & (boolean * 10 >= n * 8), "boolean")
        .otherwise("text")
    )


#: Types that matches_type() tests; all values match the others.
MATCHED = ("number", "email", "date", "phone")


def matches_type(col: Column, kind: Column) -> Column:
    """Does one value fit the inferred type? (booleans are judged per column, not here)."""
    v = F.trim(col)
    return (
        F.when(kind == "number", is_number(F.regexp_replace(v, "[,$%]", "")))
        .when(kind == "email", v.rlike(EMAIL_SHAPE))
        .when(kind == "date", v.rlike(DATE_SHAPE))
        .when(kind == "phone", F.length(F.regexp_replace(v, r"\D", "")).between(7, 15))
        .otherwise(F.lit(True))
    )


def is_null_sentinel(col: Column) -> Column:
    return col.isNull() | F.lower(F.trim(col)).isin(*NULL_SENTINELS)


def clean_numeric(col: Column) -> Column:
    """Strip $, commas and blanks; '(250)' becomes '-250'."""
    s = F.trim(col)
    negative = s.startswith("(") & s.endswith(")") & (F.length(s) > 2)
    inner = F.when(negative, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    bare = F.regexp_replace(inner, r"[,$\s]", "")
    return F.when(negative & (bare != ""), F.concat(F.lit("-"), bare)).otherwise(bare)


def looks_integer(col: Column) -> Column:
    return clean_numeric(col).rlike(INTEGER_SHAPE)


def looks_real(col: Column) -> Column:
    return is_number(clean_numeric(col))
