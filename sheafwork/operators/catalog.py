"""Schema catalog: tables of equal shape grouped, widened and combined.

registry: table_name, source_file, row_count, ordinal, columns array<struct<name, type>>
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.functions.text import literal_map, standardize_column
from sheafwork.operators.mapping import classify_entity
from sheafwork.operators.tabular import SPARK_TYPE, coerce, infer_types, rejects, unpivot_cells

WIDENING = {"INTEGER": 0, "REAL": 1, "TEXT": 2}
RENDERED = {0: "NUMBER(38)", 1: "NUMBER(18,4)", 2: "VARCHAR2(255)"}


def with_signature(registry: DataFrame) -> DataFrame:
    """Adds the sorted list of standard column names."""
    return registry.withColumn("signature", F.array_join(
        F.array_sort(F.transform("columns", lambda c: standardize_column(c["name"]))), ","))


def schema_groups(registry: DataFrame) -> DataFrame:
    """A row for each shape: name, member count, files, rows, combined flag. Members stay a table of
    their own (schema_members), so a shape shared by very many tables is never collected."""
    signed = with_signature(registry)
    grouped = signed.groupBy("signature").agg(
        F.count("*").alias("members"), F.count_distinct("source_file").alias("member_files"),
        F.sum("row_count").alias("row_count"), F.min_by("table_name", "ordinal").alias("first_table"),
    )
    entity = F.upper(classify_entity(F.split("signature", ",")))
    combined = F.col("members") > 1
    name = (
        F.when(entity.isNotNull(), F.concat(entity, F.when(combined, "_UNIONED").otherwise("")))
        .when(combined, F.concat(F.lit("COMBINED_"), F.upper("first_table"))).otherwise(F.upper("first_table"))
    )
    return grouped.select("signature", name.alias("group_name"), combined.alias("combined"), "members",
                          "member_files", "row_count").orderBy(F.desc("combined"), F.desc("members"), "group_name")


def schema_members(registry: DataFrame) -> DataFrame:
    return with_signature(registry).select("signature", "ordinal", "table_name", "source_file", "row_count")


def group_columns(registry: DataFrame) -> DataFrame:
    """Standard columns of each shape with the widest storage type, in first-seen order."""
    cols = with_signature(registry).select("signature", "ordinal", F.posexplode("columns").alias("pos", "c"))
    rank = F.coalesce(F.try_element_at(literal_map(WIDENING), F.col("c.type")), F.lit(2))
    per = cols.select("signature", standardize_column(F.col("c.name")).alias("column"),
                      F.struct("ordinal", "pos").alias("seen"), rank.alias("rank")).groupBy("signature", "column").agg(
        F.max("rank").alias("rank"), F.min("seen").alias("seen"))
    rendered = F.coalesce(*[F.when(F.col("rank") == r, t) for r, t in RENDERED.items()])
    return per.select("signature", F.upper("column").alias("column_name"), rendered.alias("rendered_type"),
                      F.col("seen.ordinal").alias("seen_table"), F.col("seen.pos").alias("seen_position"))


def union_group(tables: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(combined relation of same-shape tables: standard names, types that fit all their values, matched by name;
    column, value and number of cells of values that no longer stand in it)."""
    spark = tables[0].sparkSession
    headers = sorted({c for t in tables for c in t.columns})
    named = spark.createDataFrame([(h,) for h in headers], "h string")
    std = {r.h: r.s for r in named.select("h", standardize_column(F.col("h")).alias("s")).collect()}
    renamed = [t.select([F.col(f"`{c}`").cast("string").alias(std[c]) for c in t.columns]) for t in tables]
    texts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)
    cells = unpivot_cells(texts.withColumn("_row", F.lit(0)), "", "", "_row", texts.columns)
    types = infer_types(cells)
    kinds = {r.column: r.storage_type for r in types.select("column", "storage_type").collect()}  # one row a column
    lost = rejects(cells, types).groupBy("column", "value").agg(F.count("*").alias("n"))
    return texts.select([coerce(F.col(c), kinds[c]).cast(SPARK_TYPE[kinds[c]]).alias(c) for c in texts.columns]), lost
