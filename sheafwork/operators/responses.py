"""Model responses in, typed rows out: salvage, defaults, validation, dedupe, failure accounting.

responses: source_file, agent, segment_no, response (null when the call failed)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.sources.records import is_valid_json


#: Segments whose texts and answers a task holds as Python objects.
AT_ONCE = 256


def run_extractor(segments: DataFrame, agent: str, fn: Callable[[str], str]) -> DataFrame:
    """Call a user function once per segment; an exception becomes a failed row. A task holds the texts of few segments at once."""
    schema = T.StructType(segments.schema.fields + [
        T.StructField("agent", T.StringType()), T.StructField("response", T.StringType()),
        T.StructField("error", T.StringType())])

    def call(text: str) -> tuple[str | None, str | None]:
        try:
            return fn(text), None
        except Exception as exc:  # noqa: BLE001 - reported as data
            return None, f"{type(exc).__name__}: {exc}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                few = batch.slice(at, AT_ONCE)
                answers = [call(t) for t in few.column("segment").to_pylist()]
                added = [[agent] * len(answers), [a for a, _ in answers], [e for _, e in answers]]
                yield pa.RecordBatch.from_arrays([*few.columns, *[pa.array(v, pa.string()) for v in added]], names=schema.names)

    return segments.mapInArrow(run, schema)


def salvaged(text: Column) -> Column:
    """The text, or what stands between its outer braces, if that is one JSON object and nothing else; or null."""
    raw = F.trim(text)
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)

    def usable(text: Column) -> Column:
        return F.when(text.startswith("{") & is_valid_json(text), text)

    return F.coalesce(usable(raw), F.when(inner != raw, usable(inner)))


def salvage_json(df: DataFrame, column: str = "response") -> DataFrame:
    """Adds ``json`` (text that is one JSON object and nothing else, or null) and ``ok``."""
    found = salvaged(F.col(column))
    return df.withColumn("json", found).withColumn("ok", found.isNotNull())


def _items(responses: DataFrame, agent: str, field: str, item: str) -> DataFrame:
    """Objects of the list ``field``, each parsed by itself: one that is no object loses nothing but itself.

    The salvaged text and each parsed item are exploded from an array of one, so a filter on them does not parse again.
    """
    usable = F.array(salvaged(F.col("response")))
    parsed = responses.filter(F.col("agent") == agent).select("source_file", "segment_no", F.explode(usable).alias("json")).filter("json is not null")
    texts = F.from_json("json", f"{field} array<string>")[field]
    each = parsed.select("source_file", "segment_no", F.posexplode(texts).alias("item_no", "t")).filter(F.col("t").startswith("{"))
    x = F.from_json("t", item.replace(":", " ").replace(",", ", "))
    return each.select("source_file", "segment_no", "item_no", "t", F.explode(F.array(x)).alias("x"))


def parse_entities(responses: DataFrame) -> DataFrame:
    rows = _items(responses, "NER", "entities", "name:string,type:string,mentions:array<string>,confidence:string")
    confidence = F.when(F.col("x.confidence").isNull(), F.lit(0.7)).otherwise(F.col("x.confidence").try_cast("double"))
    given = F.get_json_object("t", "$.mentions")
    listed = given.isNull() | given.startswith("[")
    return rows.filter(F.col("x.name").isNotNull() & confidence.isNotNull() & listed).select(
        "source_file", "segment_no", "item_no", F.col("x.name").alias("name"),
        F.coalesce("x.type", F.lit("OTHER")).alias("type"),
        F.coalesce("x.mentions", F.array().cast("array<string>")).alias("mentions"), confidence.alias("confidence"))


def parse_pii(responses: DataFrame, entities: DataFrame) -> DataFrame:
    """Findings with defaults; the subject is kept only if it names a known PERSON of the file."""
    rows = _items(responses, "PII", "findings",
                  "category:string,value_redacted:string,severity:string,location:string,subject_entity:string")
    people = (
        entities.filter(F.col("type") == "PERSON")
        .groupBy("source_file", F.lower("name").alias("_key")).agg(F.min("name").alias("_known"))
    )
    keyed = rows.filter(F.col("x").isNotNull()).withColumn("_key", F.lower(F.trim("x.subject_entity")))
    return keyed.join(people, ["source_file", "_key"], "left").select(
        "source_file", "segment_no", "item_no",
        F.coalesce("x.category", F.lit("OTHER_PII")).alias("category"),
        F.coalesce("x.value_redacted", F.lit("***")).alias("value_redacted"),
        F.coalesce("x.severity", F.lit("low")).alias("severity"),
        F.col("x.location").alias("location"), F.col("_known").alias("subject_entity"),
        F.lit("llm").alias("detection_method"))


def parse_financial(responses: DataFrame) -> DataFrame:
    rows = _items(responses, "Financial", "facts",
                  "label:string,amount:string,currency:string,period:string,context:string")
    amount = F.col("x.amount").try_cast("double")
    return rows.filter(F.col("x").isNotNull() & (F.col("x.amount").isNull() | amount.isNotNull())).select(
        "source_file", "segment_no", "item_no", F.coalesce("x.label", F.lit("fact without label")).alias("label"),
        amount.alias("amount"), F.col("x.currency").alias("currency"), F.col("x.period").alias("period"),
        F.col("x.context").alias("context"))


def parse_relations(responses: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with both endpoints; files without any entity yield none."""
    rows = _items(responses, "Relation", "relations",
                  "source_entity:string,target_entity:string,relation_type:string,evidence:string,confidence:string")
    confidence = F.when(F.col("x.confidence").isNull(), F.lit(0.6)).otherwise(F.col("x.confidence").try_cast("double"))
    good = F.col("x.source_entity").isNotNull() & F.col("x.target_entity").isNotNull() & confidence.isNotNull()
    known = entities.select("source_file").distinct()
    return rows.filter(good).join(known, "source_file", "left_semi").select(
        "source_file", "segment_no", "item_no", F.col("x.source_entity").alias("source_entity"),
        F.col("x.target_entity").alias("target_entity"),
        F.coalesce("x.relation_type", F.lit("RELATED_TO")).alias("relation_type"),
        F.col("x.evidence").alias("evidence"), confidence.alias("confidence"))


def dedup_entities(entities: DataFrame, by: list[str], order: str = "ordinal") -> DataFrame:
    """Merge equal (lower name, type) within ``by``: first spelling, all mentions, top confidence.

    Mentions are made distinct per key before they meet, so a hot entity is spread over its mentions
    and each key collects distinct values only.
    """
    keys = [*by, "_key", "type"]
    keyed = entities.withColumn("_key", F.lower(F.trim("name"))).withColumn("_m", F.explode_outer("mentions"))
    per_mention = keyed.groupBy(*keys, "_m").agg(
        F.max("confidence").alias("confidence"), F.min(F.struct(order, "name")).alias("first"))
    merged = per_mention.groupBy(*keys).agg(
        F.min("first").alias("first"), F.max("confidence").alias("confidence"),
        F.sort_array(F.collect_set("_m")).alias("mentions"))
    return merged.select(*by, F.col("first.name").alias("name"), "type", "confidence", "mentions",
                         F.col(f"first.{order}").alias(order))


def segment_failures(responses: DataFrame) -> DataFrame:
    """One warning per file and agent with failed segments."""
    counts = salvage_json(responses).groupBy("source_file", "agent").agg(
        F.count_if(~F.col("ok")).alias("failed"), F.count("*").alias("total"))
    text = F.concat("agent", F.lit(": "), "failed", F.lit(" of "), "total", F.lit(
        " segments gave no usable response"))
    return counts.filter("failed > 0").withColumn("warning", text)


def prompt_inputs(segments: DataFrame, entities: DataFrame, person_only: bool = False) -> DataFrame:
    """Prefix each segment with the file's sorted known names."""
    known = entities.filter(F.col("type") == "PERSON") if person_only else entities
    names = known.groupBy("source_file").agg(F.array_join(F.sort_array(F.collect_set("name")), "', '").alias("names"))
    prompt = F.when(F.col("names").isNull(), F.col("segment")).otherwise(
        F.concat(F.lit("Known entities: ['"), "names", F.lit("']\n\nText:\n"), "segment"))
    return segments.join(names, "source_file", "left").withColumn("prompt", prompt).drop("names")


def missing_responses(expected: DataFrame, responses: DataFrame) -> DataFrame:
    """One warning per file that lacks some agent's response; rule findings are not affected."""
    have = responses.select("source_file", "agent").distinct()
    gone = expected.join(have, ["source_file", "agent"], "left_anti")
    return gone.groupBy("source_file").agg(
        F.array_join(F.sort_array(F.collect_set("agent")), ", ").alias("missing_agents")).withColumn(
        "warning", F.concat(F.lit("Extraction skipped: no model response for "), "missing_agents"))
