"""Sensitive-data queries: every family over all documents and all notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafwork.functions import ids
from sheafwork.functions.text import redact
from sheafwork.operators import sensitive as S
from sheafwork.plans import inputs as I
from sheafwork.plans.registry import query


def _redact_sql(v: str) -> str:
    return (f"CASE WHEN length({v}) <= 2 THEN repeat('*', length({v})) "
            f"ELSE concat(substr({v}, 1, 1), repeat('*', length({v}) - 2), substr({v}, length({v}), 1)) END")


def _digit(v: str, i: str) -> str:
    return f"CAST(substr({v}, CAST({i} AS BIGINT), 1) AS INT)"


def _sum(n: str, term: str) -> str:
    return f"list_sum(list_transform(range(1, {n} + 1), lambda i: {term}))"


def _luhn(v: str) -> str:
    d = _digit(v, "i")
    double = f"CASE WHEN {d} > 4 THEN {d} * 2 - 9 ELSE {d} * 2 END"
    return f"{_sum(f'length({v})', f'CASE WHEN (length({v}) - i) % 2 = 1 THEN {double} ELSE {d} END')} % 10 = 0"


def _lead(v: str, n: int) -> str:
    return f"CAST(substr({v}, 1, {n}) AS INT)"


def _issuer(v: str) -> str:
    n = f"length({v})"
    return f"""CASE WHEN substr({v}, 1, 1) = '4' THEN {n} IN (13, 16, 19) ELSE
  ({n} = 16 AND ({_lead(v, 2)} BETWEEN 51 AND 55 OR {_lead(v, 4)} BETWEEN 2221 AND 2720))
  OR ({n} = 15 AND {_lead(v, 2)} IN (34, 37))
  OR ({n} = 14 AND ({_lead(v, 2)} IN (36, 38) OR {_lead(v, 3)} BETWEEN 300 AND 305))
  OR ({n} = 16 AND ({_lead(v, 4)} = 6011 OR {_lead(v, 2)} = 65 OR {_lead(v, 3)} BETWEEN 644 AND 649
      OR {_lead(v, 6)} BETWEEN 622126 AND 622925))
  OR ({n} = 16 AND {_lead(v, 4)} BETWEEN 3528 AND 3589)
  OR ({n} BETWEEN 16 AND 19 AND {_lead(v, 2)} = 62) END"""


def _letter(c: str) -> str:
    """0-9 as they are, A-Z from 10, anything else 0."""
    return f"CASE WHEN {c} BETWEEN '0' AND '9' THEN ascii({c}) - 48 WHEN {c} BETWEEN 'A' AND 'Z' THEN ascii({c}) - 55 ELSE 0 END"


def _iban(v: str) -> str:
    turned = f"concat(substr({v}, 5), substr({v}, 1, 4))"
    values = f"list_transform(range(1, length({v}) + 1), lambda i: {_letter(f'substr({turned}, i, 1)')})"
    fold = "lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97"
    return f"length({v}) BETWEEN 15 AND 34 AND list_reduce({values}, {fold}, 0) = 1"


def _table(rows: tuple) -> str:
    return "[" + ", ".join("[" + ", ".join(map(str, r)) + "]" for r in rows) + "]"


def _verhoeff(v: str) -> str:
    p, d = _table(ids.VERHOEFF_P), _table(ids.VERHOEFF_D)
    vals = (f"list_transform(range(0, length({v})), lambda i: {p}[i % 8 + 1]"
            f"[{_digit(v, f'length({v}) - i')} + 1])")
    return (f"substr({v}, 1, 1) NOT IN ('0', '1') AND list_reduce({vals}, lambda a, x: {d}[a + 1][x + 1], 0) = 0")


def _cpf(v: str) -> str:
    def check(n: int) -> str:
        rest = f"{_sum(str(n), f'{_digit(v, chr(105))} * ({n + 2} - i)')} % 11"
        return f"CASE WHEN {rest} < 2 THEN 0 ELSE 11 - {rest} END"

    return (f"replace({v}, substr({v}, 1, 1), '') <> '' AND {check(9)} = {_digit(v, '10')} "
            f"AND {check(10)} = {_digit(v, '11')}")


def _za(v: str) -> str:
    return (f"CAST(substr({v}, 3, 2) AS INT) BETWEEN 1 AND 12 AND CAST(substr({v}, 5, 2) AS INT) BETWEEN 1 AND 31 "
            f"AND substr({v}, 11, 1) IN ('0', '1') AND {_luhn(v)}")


def _china(v: str) -> str:
    w = "[" + ", ".join(map(str, ids.CHINA_WEIGHTS)) + "]"
    total = _sum("17", f"{_digit(v, 'i')} * {w}[i]")
    return f"upper(substr({v}, 18, 1)) = substr('{ids.CHINA_CHECK}', CAST({total} % 11 + 1 AS BIGINT), 1)"


def _mrz_digit(v: str, start: int, n: int) -> str:
    c = f"substr({v}, CAST({start} + i - 1 AS BIGINT), 1)"
    return f"CAST({_sum(str(n), f'({_letter(c)}) * [7, 3, 1][(i - 1) % 3 + 1]')} % 10 AS STRING)"


def _family(name: str, pattern: str, group: int, strip: str | None, ok: str, category: str, text: str = "text",
            severity: str = "critical", method: str = "rules_checksum") -> str:
    value = f"regexp_replace(x, '{strip}', '', 'g')" if strip else "x"
    return f"""SELECT source_file, '{category}' AS category, {_redact_sql('v')} AS value_redacted, '{severity}' AS severity,
  '{ids.LOCATION[name]}' AS location, '{method}' AS detection_method
FROM (SELECT source_file, {value} AS v FROM (SELECT source_file, unnest(regexp_extract_all({text}, '{pattern}', {group})) AS x
  FROM (SELECT * FROM ({I.CORPUS}) WHERE regexp_matches(text, '[0-9][0-9]')))) WHERE {ok}"""


_MRZ = f"""
WITH l AS (SELECT source_file, list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda s: replace(trim(s), ' ', '')) AS l FROM ({I.CORPUS})),
p AS (SELECT source_file, l[i] AS a, l[i + 1] AS b FROM (SELECT *, unnest(range(1, len(l))) AS i FROM l))
SELECT source_file, 'PASSPORT' AS category, {_redact_sql("replace(substr(b, 1, 9), '<', '')")} AS value_redacted,
  'critical' AS severity, '{ids.LOCATION['mrz']}' AS location, 'rules_checksum' AS detection_method
FROM p WHERE regexp_full_match(a, 'P[A-Z<][A-Z<]{{{{3}}}}[A-Z<]{{{{39}}}}') AND regexp_full_match(b, '[A-Z0-9<]{{{{44}}}}')
  AND {_mrz_digit('b', 1, 9)} = substr(b, 10, 1) AND {_mrz_digit('b', 14, 6)} = substr(b, 20, 1)
  AND {_mrz_digit('b', 22, 6)} = substr(b, 28, 1)
"""


def _q(pattern: str) -> str:
    """Braces doubled, as the statement is unescaped later."""
    return pattern.replace("{", "{{").replace("}", "}}")


_SSN_OK = ("substr(v, 1, 3) NOT IN ('000', '666') AND substr(v, 1, 1) <> '9' AND substr(v, 5, 2) <> '00' "
           "AND substr(v, 8, 4) <> '0000'")
FAMILY_SQL = {
    "mrz": _MRZ,
    "iban": _family("iban", _q(ids.IBAN_PATTERN), 1, " ", _iban("v"), "IBAN", "upper(text)"),
    "card": _family("card", _q(ids.CARD_PATTERN), 0, "[ -]", f"({_issuer('v')}) AND {_luhn('v')}", "CREDIT_CARD"),
    "aadhaar": _family("aadhaar", _q(ids.AADHAAR_PATTERN), 1, " ", _verhoeff("v"), "NATIONAL_ID"),
    "cpf": _family("cpf", _q(ids.CPF_PATTERN), 1, "[.-]", _cpf("v"), "NATIONAL_ID"),
    "sin": _family("sin", _q(ids.SIN_PATTERN), 1, "[ -]", _luhn("v"), "NATIONAL_ID"),
    "za_id": _family("za_id", _q(ids.ZA_PATTERN), 1, None, _za("v"), "NATIONAL_ID"),
    "cn_id": _family("cn_id", _q(ids.CHINA_PATTERN), 1, None, _china("v"), "NATIONAL_ID"),
    "ssn": _family("ssn", r"\b\d{{3}}-\d{{2}}-\d{{4}}\b", 0, None, _SSN_OK, "NATIONAL_ID",
                   severity="high", method="rules_shape"),
    "emirates": _family("emirates", _q(ids.EMIRATES_PATTERN), 0, None, "true", "EMIRATES_ID",
                        severity="high", method="rules_shape"),
}


def _detect(family: str):
    return lambda t: S.detect_family(I.corpus(t), family)


for _name, _op in (("mrz", "P2"), ("iban", "P3"), ("card", "P4"), ("aadhaar", "P5"), ("cpf", "P6"), ("sin", "P7"),
                   ("za_id", "P8"), ("cn_id", "P9")):
    _fn = _detect(_name)
    _fn.__name__, _fn.__module__ = f"detect_{_name}", __name__
    query(_op, FAMILY_SQL[_name])(_fn)


@query("P10", f"SELECT * FROM ({FAMILY_SQL['ssn']}) UNION ALL SELECT * FROM ({FAMILY_SQL['emirates']})")
def detect_shapes(t):
    corpus = I.corpus(t)
    return S.detect_family(corpus, "ssn").unionByName(S.detect_family(corpus, "emirates"))


def _contact(pattern: str, category: str, severity: str, ok: str = "true") -> str:
    return f"""SELECT source_file, '{category}' AS category, {_redact_sql('v')} AS value_redacted, '{severity}' AS severity,
  '{category.lower()} pattern' AS location, 'rules_shape' AS detection_method
FROM (SELECT source_file, unnest(regexp_extract_all(text, '{_q(pattern)}', 0)) AS v FROM ({I.CORPUS})) WHERE {ok}"""


_CONTACT = " UNION ALL ".join((
    _contact(ids.EMAIL_PATTERN, "EMAIL", "medium"), _contact(ids.PHONE_PATTERN, "PHONE", "medium"),
    _contact(ids.IP_PATTERN, "IP_ADDRESS", "low",
             "len(list_filter(string_split(v, '.'), lambda o: CAST(o AS INT) > 255)) = 0"),
    _contact(ids.SECRET_PATTERN, "CREDENTIAL", "critical")))


@query("P11", _CONTACT)
def detect_contact(t):
    return S.detect_contact(I.corpus(t))


_ALL = " UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in FAMILY_SQL.values())


@query("P12", _ALL)
def detect_pii(t):
    return S.detect_pii(I.corpus(t))


@query("P1", f"SELECT c_custkey, {_redact_sql('trim(substr(c_name, CAST(c_custkey % 19 + 1 AS BIGINT)))')} AS redacted FROM {{customer}}")
def redact_names(t):
    tail = F.substring("c_name", (F.col("c_custkey") % 19 + 1).cast("int"), F.length("c_name"))
    return t.customer.select("c_custkey", redact(tail).alias("redacted"))


@query("P13", f"""
WITH f AS (SELECT concat('orders/', CAST(o_orderkey AS STRING)) AS source_file, c_name FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey)
SELECT p.finding_id, p.source_file, CASE WHEN p.subject_entity = '' AND p.finding_id % 2 = 0 THEN f.c_name ELSE p.subject_entity END AS subject_entity
FROM (SELECT finding_id, concat('orders/', CAST(finding_id AS STRING)) AS source_file, subject_entity FROM ({I.PII})) p
LEFT JOIN f ON f.source_file = p.source_file
""")
def attribute_subject(t):
    pii = t.sql(I.PII).select("finding_id", F.concat(F.lit("orders/"), "finding_id").alias("source_file"), "subject_entity")
    people = t.sql("SELECT o_orderkey, c_name AS name FROM {orders} JOIN {customer} ON o_custkey = c_custkey")
    # order files of even keys name one person, odd ones name two
    people = people.withColumn("copies", F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2))
    people = people.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    entities = people.select(F.concat(F.lit("orders/"), "o_orderkey").alias("source_file"), "name", F.lit("PERSON").alias("type"))
    return S.attribute_subject(pii, entities).select("finding_id", "source_file", "subject_entity")


@query("P14", f"""
SELECT finding_id, source_file, category, severity,
  CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS severity_rank,
  CASE detection_method WHEN 'rules_checksum' THEN '✓ Verified' WHEN 'rules_shape' THEN 'Pattern match' ELSE 'AI-flagged' END AS method_label
FROM ({I.PII})
""")
def pii_inventory(t):
    rows = S.pii_inventory(t.sql(I.PII), order=("finding_id",))
    return rows.select("finding_id", "source_file", "category", "severity", "severity_rank", "method_label")


@query("P15", f"SELECT severity, count(*) AS findings FROM ({I.PII}) GROUP BY severity")
def severity_counts(t):
    return S.severity_counts(t.sql(I.PII))
