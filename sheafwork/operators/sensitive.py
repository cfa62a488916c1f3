"""Sensitive-data findings: detection over whole texts, attribution, inventory, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import ids
from sheafwork.functions.text import redact

SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
METHOD_LABEL = {"rules_checksum": "✓ Verified", "rules_shape": "Pattern match", "llm": "AI-flagged"}


def scan(df: DataFrame, families: dict[str, ids.Family], text: str = "text") -> DataFrame:
    """A row for each finding of the given families, from one pass over the text.

    The text is first reduced to the pieces that can match, the candidates of all families are
    exploded together, and each is checked by its family's rule.
    """
    keep = [c for c in df.columns if c != text]
    source = {"text": f"`{text}`", "numeric": "_numeric", "lettered": "_lettered"}
    used = {f.source for f in families.values()}
    base = df
    if "text" not in used or "mrz" in families:
        base = base.filter(F.col(text).rlike(r"\d\d"))
    base = base.withColumn("_cut", F.expr(ids.cut(source["text"])))
    if "numeric" in used:
        base = base.withColumn("_numeric", F.expr(ids.pieces("_cut", ids.NEAR_DIGITS)))
    if "lettered" in used:
        base = base.withColumn("_lettered", F.expr(ids.pieces("_cut", ids.IBAN_START)))
    found = ", ".join(
        f"transform({f.candidates.replace('{text}', source[f.source])}, x -> named_struct('k', '{name}', 'v', x, {ids.halves(f.digits)}))"
        for name, f in families.items())
    rows = base.select(*keep, F.expr(f"explode(concat({found}))").alias("c")).select(*keep, "c.k", "c.v", "c.hi", "c.lo")
    rules = " ".join(f"WHEN '{name}' THEN {f.check}" for name, f in families.items())

    def by_family(value) -> str:
        return "CASE k " + " ".join(f"WHEN '{name}' THEN {value(name, f)}" for name, f in families.items()) + " END"

    shown = redact(F.expr(by_family(lambda _, f: f.shown)))
    return rows.filter(F.expr(f"CASE k {rules} END")).select(
        *keep, F.expr(by_family(lambda _, f: f"'{f.category}'")).alias("category"), shown.alias("value_redacted"),
        F.expr(by_family(lambda _, f: f"'{f.severity}'")).alias("severity"),
        F.expr(by_family(lambda n, _: f"'{ids.location(n)}'")).alias("location"),
        F.expr(by_family(lambda _, f: f"'{f.method}'")).alias("detection_method"))


def detect_family(df: DataFrame, family: str, text: str = "text") -> DataFrame:
    """One identifier family (key of ids.FAMILIES)."""
    return scan(df, {family: ids.FAMILIES[family]}, text)


def detect_contact(df: DataFrame, text: str = "text") -> DataFrame:
    """E-mail, phone, IP address and secret patterns."""
    return scan(df, ids.CONTACT, text)


def detect_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """All checksum and shape families in a single pass over the text."""
    return scan(df, ids.FAMILIES, text)


def attribute_subject(pii: DataFrame, entities: DataFrame) -> DataFrame:
    """A file with exactly one PERSON row lends its name to findings without a subject."""
    lone = (
        entities.filter(F.col("type") == "PERSON").groupBy("source_file")
        .agg(F.count("*").alias("n"), F.min("name").alias("_only")).filter("n = 1").drop("n")
    )
    subject = F.when(F.coalesce("subject_entity", F.lit("")) == "", F.coalesce("_only", "subject_entity"))
    return (
        pii.join(lone, "source_file", "left")
        .withColumn("subject_entity", subject.otherwise(F.col("subject_entity"))).drop("_only")
    )


def pii_inventory(pii: DataFrame, severity: str | None = None, order: tuple[str, ...] = ("finding_no",)) -> DataFrame:
    """Findings by severity rank, input order inside a rank, with the method's display label."""
    rows = pii if severity is None else pii.filter(F.col("severity") == severity)
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(r)) for s, r in SEVERITY_RANK.items()], F.lit(4))
    label = F.coalesce(*[F.when(F.col("detection_method") == m, F.lit(t)) for m, t in METHOD_LABEL.items()],
                       F.col("detection_method"))
    return rows.withColumn("severity_rank", rank).withColumn("method_label", label).orderBy("severity_rank", *order)


def severity_counts(pii: DataFrame, *by: str) -> DataFrame:
    return pii.groupBy(*by, "severity").agg(F.count("*").alias("findings"))
