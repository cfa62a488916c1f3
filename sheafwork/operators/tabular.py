"""Table typing: clean names, storage types, coercion, registration names.

User tables travel as long cells (source_file, table_id, row_id, col_idx, column, value) or as wide
string DataFrames; both forms are accepted where it matters.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.functions import cells as C
from sheafwork.functions.text import file_stem, sanitize_ident
from sheafwork.operators.ordering import row_number_within
from sheafwork.session import shared_table

TYPE_THRESHOLD = 90  # percent of non-null values
SPARK_TYPE = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string"}


def unpivot_cells(df: DataFrame, source_file: str, table_id: str, row_id: str, columns: list[str],
                  category: str = "csv") -> DataFrame:
    """Wide string table -> cells, one narrow pass (no shuffle)."""
    entries = F.expr("array(" + ", ".join(
        f"named_struct('col_idx', {i}, 'column', '{c}', 'value', coalesce(CAST(`{c}` AS STRING), ''))"
        for i, c in enumerate(columns)) + ")")
    return df.select(
        F.lit(source_file).alias("source_file"), F.lit(table_id).alias("table_id"), F.lit(category).alias("category"),
        F.col(row_id).cast("long").alias("row_id"), F.explode(entries).alias("e"),
    ).select("source_file", "table_id", "category", "row_id", "e.*")


def dedupe_names(columns: DataFrame, keys: list[str], name: str = "name", position: str = "position") -> DataFrame:
    """Second and later occurrences of a name in a table get _1, _2 ..."""
    numbered = row_number_within(columns, [*keys, name], position, "_k")
    n = F.col("_k") - 1
    return numbered.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat_ws("_", name, n))).drop("_k")


def column_names(headers: DataFrame, keys: list[str]) -> DataFrame:
    """Sanitised, deduplicated column names; headers: keys, col_idx, column."""
    clean = headers.withColumn("name", sanitize_ident(F.col("column"), F.concat(F.lit("col_"), F.col("col_idx"))))
    return dedupe_names(clean, keys, "name", "col_idx")


def infer_types(cells: DataFrame) -> DataFrame:
    """INTEGER, REAL or TEXT per column when at least 90 % of non-null values parse; REAL if an integer is too wide.

    Sums only: each task sends one row a column, so neither values nor a hot column are shuffled.
    """
    keys = ["source_file", "table_id", "col_idx", "column"]
    v = F.col("value")
    live = ~C.is_null_sentinel(v)
    sums = cells.groupBy(*keys).agg(
        F.count_if(live).alias("filled"),
        F.count_if(live & C.looks_integer(v)).alias("ints"),
        F.count_if(live & C.looks_real(v)).alias("reals"),
        F.count_if(live & C.looks_integer(v) & C.clean_numeric(v).try_cast("bigint").isNull()).alias("wide"),
    )
    return sums.withColumn("storage_type", storage_type()).drop("wide")


def storage_type() -> Column:
    """INTEGER, REAL or TEXT by the counts of a column's values: filled, ints, reals, wide."""
    return (
        F.when(F.col("filled") == 0, "TEXT")
        .when(F.col("ints") * 100 >= F.col("filled") * TYPE_THRESHOLD, F.when(F.col("wide") == 0, "INTEGER").otherwise("REAL"))
        .when(F.col("reals") * 100 >= F.col("filled") * TYPE_THRESHOLD, "REAL")
        .otherwise("TEXT")
    )


def wide_types(df: DataFrame) -> list[Row]:
    """infer_types() for a wide table: col_idx, filled, ints, reals, wide, lost (values that typing loses) and storage_type.

    One pass with sums only: nothing is shuffled but a row a task, and no value is counted by itself.
    """
    sums = []
    for i, c in enumerate(df.columns):
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        live = ~C.is_null_sentinel(v)
        tests = {"filled": live, "ints": live & C.looks_integer(v), "reals": live & C.looks_real(v),
                 "wide": live & C.looks_integer(v) & C.clean_numeric(v).try_cast("bigint").isNull(),
                 "int_lost": live & coerce(v, "INTEGER").isNull(), "real_lost": live & coerce(v, "REAL").isNull()}
        sums.append(F.struct(F.lit(i).alias("col_idx"), *[F.count_if(t).alias(n) for n, t in tests.items()]))
    lost = F.when(F.col("storage_type") == "INTEGER", F.col("int_lost")).when(F.col("storage_type") == "REAL", F.col("real_lost")).otherwise(0)
    found = df.agg(F.array(*sums).alias("s")).select(F.inline("s")).withColumn("storage_type", storage_type())
    return found.withColumn("lost", lost).drop("int_lost", "real_lost").orderBy("col_idx").collect()


def coerce(col, kind: str):
    """One cell to its storage type; a sentinel or a leftover non-number becomes NULL."""
    live = F.when(~C.is_null_sentinel(col), col)
    if kind == "INTEGER":
        return F.when(C.looks_integer(live), C.clean_numeric(live)).try_cast("bigint")
    if kind == "REAL":
        return F.when(C.looks_real(live), C.clean_numeric(live)).try_cast("double")
    return live


def type_table(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Wide string table -> typed table (one projection)."""
    return df.select(*[coerce(F.col(c), kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def rejects(cells: DataFrame, types: DataFrame) -> DataFrame:
    """Cells with a value whose typed value is NULL: whatever the cast loses is listed.

    The types are stored first, so that Spark knows their size and sends a small table to the cells; only cells of numeric
    columns are tested, by their column's type alone.
    """
    v = F.col("value")
    live = ~C.is_null_sentinel(v)
    bad = F.when(F.col("storage_type") == "INTEGER", live & coerce(v, "INTEGER").isNull()).otherwise(live & coerce(v, "REAL").isNull())
    kinds = types.filter(F.col("storage_type").isin("INTEGER", "REAL")).select("source_file", "table_id", "col_idx", "storage_type")
    return cells.join(shared_table(kinds, "types"), ["source_file", "table_id", "col_idx"]).filter(bad)


def usable(tables: DataFrame) -> DataFrame:
    """Tables with a header and at least one row."""
    return tables.filter((F.col("n_columns") > 0) & (F.col("n_rows") > 0))


def table_names(tables: DataFrame, fallback: str = "table") -> DataFrame:
    """Unique table name from file stem and sheet, in order of ``ordinal``; a taken name gets _2, _3 ... after a cut to 55.

    Names that can clash share a root (the name without trailing numbers, cut to 55), so the search for a free name runs
    within a root only.
    """
    stem = F.lower(file_stem(F.col("source_file")))
    seed = F.when(F.coalesce("sheet", F.lit("")) != "", F.concat_ws("_", stem, "sheet")).otherwise(stem)
    numbers = "(_[0-9]+)+$"
    bare = lambda c: F.regexp_replace(c, numbers, "")
    named = tables.withColumn("base_name", sanitize_ident(seed, F.lit(fallback)))
    named = named.withColumn("_root", bare(F.substring(bare(F.col("base_name")), 1, 55)))
    schema = T.StructType([f for f in named.schema if f.name != "_root"] + [T.StructField("table_name", T.StringType())])

    def free(group: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        count: dict[str, int] = {}
        names = []
        group = group.sort_values("ordinal", kind="stable")
        for base in group["base_name"]:
            k, name = count.get(base, 1), base
            while name in taken:
                k += 1
                name = f"{base[:55]}_{k}"
            count[base] = k
            taken.add(name)
            names.append(name)
        return group.assign(table_name=names).drop(columns="_root")

    return named.groupBy("_root").applyInPandas(free, schema)
