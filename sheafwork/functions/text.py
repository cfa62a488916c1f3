"""Column expressions for text: identifiers, names, redaction, slices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column-name aliases used when standardising headers.
ALIASES = {
    "cust": "customer", "client": "customer",
    "org": "company", "organization": "company", "vendor": "company", "supplier": "company",
    "amt": "amount", "total": "amount", "sum": "amount", "value": "amount",
    "dt": "date", "timestamp": "date", "created": "date", "updated": "date",
    "tel": "phone", "mobile": "phone", "telephone": "phone",
    "addr": "address",
    "mail": "email",
    "fullname": "name",
    "uuid": "id", "identifier": "id", "pk": "id",
    "desc": "description",
    "qty": "quantity",
    "curr": "currency",
}

# Keywords that mark a business document or question.
BUSINESS_KEYWORDS = (
    "contract", "agreement", "invoice", "financial", "finance", "statement",
    "confidential", "legal", "audit", "compliance", "payroll", "tax",
    "merger", "acquisition", "nda", "report", "budget", "salary", "ledger",
    "balance", "transaction", "settlement", "board", "executive",
)


def literal_map(pairs: dict[str, object]) -> Column:
    """A constant map as one parsed expression (one call instead of one per entry)."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else f"{x}"
    kind = "D" if any(isinstance(v, float) for v in pairs.values()) else ""
    return F.expr("map(" + ", ".join(f"{quote(k)}, {quote(v)}{kind}" for k, v in pairs.items()) + ")")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def redact(col: Column) -> Column:
    """Keep the first and last character, star the rest; two or fewer are all stars."""
    v = F.trim(col)
    n = F.length(v)
    return F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(v, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(v, n, F.lit(1)))
    )


def words(col: Column) -> Column:
    """Whitespace-separated words without empty ones."""
    return F.filter(F.split(col, r"\s+"), lambda w: w != "")


def standardize_column(col: Column) -> Column:
    """Header -> standard name: camelCase split, aliases, neighbouring repeats dropped."""
    spaced = F.regexp_replace(col, r"([a-z0-9])(?=[A-Z])", "$1_")
    tokens = F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda t: t != "")
    tokens = F.when(F.size(tokens) == 0, F.array(F.lit("field"))).otherwise(tokens)
    aliases = literal_map(ALIASES)
    mapped = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(aliases, t), t))
    return let(mapped, lambda m: F.array_join(F.filter(m, lambda t, i: (i == 0) | (F.get(m, i - 1) != t)), "_"))


#: A text as far as its 61st letter or digit: no later character can reach a name of 60.
IDENT_HEAD = r"^[^0-9a-zA-Z]*+(?:[0-9a-zA-Z][^0-9a-zA-Z]*+){0,61}"


def sanitize_ident(col: Column, fallback: Column) -> Column:
    """Name safe as an SQL identifier, at most 60 characters."""
    head = F.regexp_extract(F.coalesce(col, F.lit("")), IDENT_HEAD, 0)
    s = F.regexp_replace(F.trim(head), r"[^0-9a-zA-Z_]", "_")
    s = F.regexp_replace(s, r"_+", "_")
    s = F.regexp_replace(s, r"^_|_$", "")
    s = F.when(s == "", fallback).otherwise(s)
    s = F.when(s.rlike(r"^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)
    return F.substring(s, 1, 60)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, empty when there is none (dot files have none)."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def slug_file(name: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.concat(F.when(slug == "", F.lit("table")).otherwise(slug), F.lit(".csv"))


def whole_percent(num: Column, den: Column) -> Column:
    """Integer percent of two counts, ties to even; 0 when the denominator is 0."""
    return F.when(den == 0, F.lit(0)).otherwise(F.bround(F.lit(100.0) * num / den, 0)).cast("long")


def rate3(num: Column, den: Column) -> Column:
    """num/den to three decimals from integer counts (half up), 0.0 when den is 0."""
    n, d = num.cast("long"), den.cast("long")
    half_up = F.floor((F.lit(2000) * n + d).cast("double") / (F.lit(2) * d)) / F.lit(1000.0)
    return F.when(d == 0, F.lit(0.0)).otherwise(half_up)


def keyword_hits(name: Column) -> Column:
    """Sorted distinct business keywords found left to right in a file name."""
    found = F.regexp_extract_all(F.lower(name), F.lit("(" + "|".join(BUSINESS_KEYWORDS) + ")"), F.lit(1))
    return F.array_sort(F.array_distinct(found))
