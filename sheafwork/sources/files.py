"""File classification, metadata, delimited text, profiles, multi-table import."""

from __future__ import annotations

import csv
import itertools
import mimetypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.functions.text import base_name, extension, keyword_hits, literal_map
from sheafwork.sources.splits import SEPARATORS, quoted_records

# Suffixes of each category.
SUFFIXES = {
    "pdf": (".pdf",),
    "image": (".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".webp", ".heic"),
    "csv": (".csv", ".tsv"),
    "json": (".json", ".jsonl"),
    "excel": (".xlsx", ".xls", ".ods"),
    "office": (".docx", ".pptx", ".rtf", ".odt"),
    "email": (".pst", ".mbox", ".eml", ".msg"),
    "code": (".py", ".js", ".sql", ".log", ".md", ".yaml", ".yml", ".toml", ".txt"),
    "archive": (".zip", ".tar", ".gz", ".tgz", ".bz2", ".tbz2", ".xz", ".txz", ".7z", ".rar"),
    "database": (".db", ".sqlite", ".sqlite3"),
    "media": (".mp3", ".wav", ".mp4", ".m4a", ".mov", ".flac"),
    "web": (".html", ".htm", ".xml", ".geojson"),
}
SUPPORTED = ("pdf", "image", "csv", "json", "excel", "office", "email", "database", "code", "media", "web")


def category_by_suffix() -> dict[str, str]:
    """Suffix -> category, filled up with the standard library's MIME guesses."""
    known = {s: c for c, group in SUFFIXES.items() for s in group}
    for suffix, kind in mimetypes.MimeTypes(filenames=()).types_map[True].items():
        guess = ("image" if kind.startswith("image/") else "pdf" if kind == "application/pdf"
                 else "code" if kind.startswith("text/") else None)
        if guess:
            known.setdefault(suffix.lower(), guess)
    return known


def classify_files(df: DataFrame, path_col: str = "path") -> DataFrame:
    table = literal_map(category_by_suffix())
    found = F.try_element_at(table, extension(F.col(path_col)))
    return df.withColumn("category", F.coalesce(found, F.lit("unknown")))


def describe_files(df: DataFrame, path_col: str = "path", most_bytes: int | None = None) -> DataFrame:
    """Category, keyword hits and acceptance for a listing with size_bytes (null: missing file).

    Every file is accepted unless the caller sets ``most_bytes``.
    """
    return classify_files(df, path_col).withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0))).withColumn(
        "keyword_hits", keyword_hits(base_name(F.col(path_col)))).withColumn(
        "accepted", F.lit(True) if most_bytes is None else F.col("size_bytes") <= most_bytes)


def file_metadata(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Listing of real files; the content column is never read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return describe_files(listed.select("path", F.col("length").alias("size_bytes"),
                                        F.col("modificationTime").alias("modified_at")))


def unsupported(files: DataFrame) -> DataFrame:
    """Files no reader handles stay in the result with a warning."""
    note = F.when(F.lower("path").rlike(r"\.(msg|pst)$"), "Outlook files have no reader, .eml and .mbox files do")
    note = note.when(F.lower("path").endswith(".ods"), "ODS files have no reader, .xlsx files do")
    other = ~F.col("category").isin(*SUPPORTED)
    note = note.when(other, F.concat(F.lit("No reader for files of type '"), "category", F.lit("'.")))
    return files.withColumn("warning", note).filter(F.col("warning").isNotNull())


def parse_fields(rows: DataFrame, sep: str | None) -> DataFrame:
    """source_file, record_no, record, header and fields of each record. rows: source_file, record_no, record, head.

    Without ``sep`` each file's separator is the candidate that its header holds most often outside of quotes (tab for .tsv).
    Repeated names get a number, empty ones their place. Blank records give no row.
    """
    schema = T.StructType([rows.schema["source_file"], rows.schema["record_no"], rows.schema["record"],
                           T.StructField("header", T.ArrayType(T.StringType())), T.StructField("fields", T.ArrayType(T.StringType()))])

    def separator(file: str, head: str) -> str:
        if sep or file.lower().endswith(".tsv"):
            return sep or "\t"
        bare = re.sub(r'"(?:[^"]|"")*+"', "", head)
        return max(SEPARATORS, key=bare.count)

    def cells(record: str, by: str) -> list[str]:
        return next(csv.reader([record], delimiter=by), [])

    def names(head: str, by: str) -> list[str]:
        out: list[str] = []
        for i, name in enumerate(cells(head.lstrip("﻿").rstrip("\r"), by)):
            name = name.strip() or f"column_{i + 1}"
            out.append(name if name not in out else next(n for k in itertools.count(1) if (n := f"{name}.{k}") not in out))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 31)
        known: dict[tuple[str, str], tuple[str, list[str]]] = {}
        for batch in batches:
            header, fields = [], []
            for file, record, head in zip(*(batch.column(c).to_pylist() for c in ("source_file", "record", "head"))):
                if head is None:
                    header.append(None)
                    fields.append([record])
                    continue
                if (file, head) not in known:
                    by = separator(file, head)
                    known[file, head] = by, names(head, by)
                by, own = known[file, head]
                header.append(own)
                fields.append(cells(record, by))
            of = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("source_file", "record_no", "record")], pa.array(header, of), pa.array(fields, of)], names=schema.names)

    return rows.mapInArrow(run, schema)


def delimited_records(spark: SparkSession, path: str, sep: str | None = None, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """(source_file, record_no, header, fields of good rows; source_file, record_no, raw and warning of bad ones).

    Files are read in splits, quoted line ends and all. The first record of each file is its header; later ones are rows,
    whatever they hold. A row with too few fields is filled up with nulls, as data frame readers do; one with too many, and
    every row of a file whose header does not end, is bad.
    """
    records, heads = quoted_records(spark, path, glob, sep or SEPARATORS)
    live = records.withColumn("record", F.regexp_replace("record", r"\r\z", "")).where(F.col("record") != "")
    body = parse_fields(live.join(heads, "source_file").where("head IS NULL OR record_no <> head_no"), sep)
    size, wide = F.size("fields"), F.size("header")
    bad = F.coalesce(size > wide, F.lit(True))
    filled = F.when(size == wide, F.col("fields")).otherwise(F.transform(F.sequence(F.lit(0), wide - 1), lambda i: F.get("fields", i)))
    why = F.when(F.col("header").isNull(), "the header of this file does not end").otherwise(
        F.concat(F.lit("row of "), size.cast("string"), F.lit(" fields under a header of "), wide.cast("string")))
    return (body.where(~bad).select("source_file", "record_no", "header", filled.alias("fields")),
            body.where(bad).select("source_file", "record_no", F.col("record").alias("raw"), why.alias("warning")))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """(source_file, record_no and the columns of all headers as strings; bad rows with a warning).

    A column that a file does not have is null there, and columns stand in the order in which they first come.
    """
    rows, bad = delimited_records(spark, path, sep, glob)
    headers = rows.select("source_file", "header").distinct().orderBy("source_file").collect()  # names of the columns to be made
    columns = list(dict.fromkeys(name for r in headers for name in r.header))
    value = lambda c: F.get("fields", F.array_position("header", F.lit(c)).cast("int") - 1)
    return rows.select("source_file", "record_no", *[
        F.when(F.array_contains("header", F.lit(c)), value(c)).alias(c) for c in columns]), bad


def profile_columns(df: DataFrame, exact: bool = True) -> DataFrame:
    """Rows, dtype, null share (per mille) and distinct non-null values of every column.

    Distinct counts run over pre-counted (column, value) pairs: one shuffle for all columns.
    """
    kinds = dict(df.dtypes)
    entries = F.expr("array(" + ", ".join(
        f"named_struct('col_idx', {i}, 'column', '{c}', 'dtype', '{kinds[c]}', 'v', CAST(`{c}` AS STRING))"
        for i, c in enumerate(df.columns)) + ")")
    keys = ["col_idx", "column", "dtype"]
    long = df.select(F.explode(entries).alias("e")).select("e.*")
    counted = long.groupBy(*keys, "v").agg(F.count("*").alias("n")) if exact else long.withColumn("n", F.lit(1))
    distinct = F.count("v") if exact else F.approx_count_distinct("v")
    return counted.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        distinct.alias("distinct_values"))


PROFILE = ("source_file", "col_idx", "column", "dtype")


def sketch_profile(df: DataFrame, source: str, lg_k: int = 14) -> DataFrame:
    """Mergeable profile of each file and column: rows, nulls, an HLL sketch of the values and a KLL sketch of the numbers.

    One pass over the files that came; merge_profiles() adds it to what is known of the others. ``source`` names the column
    that holds the file. Distinct counts are within about 1.6 / sqrt(2 ** lg_k) of the truth two times in three, ranks of
    quantiles within about 1.3 percent.
    """
    kinds = dict(df.dtypes)
    columns = [c for c in df.columns if c != source]
    entries = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"),
                                 F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(columns)])
    long = df.select(F.col(source).alias("source_file"), F.inline(entries))
    return long.groupBy(*PROFILE).agg(
        F.count("*").alias("rows"), F.count_if(F.col("v").isNull()).alias("nulls"), F.hll_sketch_agg("v", lg_k).alias("values"),
        F.kll_sketch_agg_double(F.col("v").try_cast("double")).alias("numbers"))


def merge_profiles(*profiles: DataFrame) -> DataFrame:
    """Profiles of files united; a file that comes again with the same name adds to itself."""
    every = profiles[0]
    for p in profiles[1:]:
        every = every.unionByName(p)
    return every.groupBy(*PROFILE).agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.hll_union_agg("values").alias("values"),
        F.kll_merge_agg_double("numbers").alias("numbers"))


def profile_report(profiles: DataFrame, keys: tuple[str, ...] = ("col_idx", "column", "dtype")) -> DataFrame:
    """Rows, nulls, about the number of distinct values, and the median of the numbers, by column over all files (or by ``keys``)."""
    return profiles.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("values")).alias("distinct_values"), F.kll_merge_agg_double("numbers").alias("_n")).select(
        *keys, "rows", "nulls", "distinct_values", F.when(F.kll_sketch_get_n_double("_n") > 0, F.kll_sketch_get_quantile_double("_n", F.lit(0.5))).alias("median"))


def import_tables(readers: dict[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Read many tables; one that fails is listed with its error and the rest go on."""
    tables: dict[str, DataFrame] = {}
    summary: list[DataFrame] = []
    failed: list[tuple[str, str]] = []
    for name, reader in readers.items():
        try:
            df = reader()
            df.schema  # noqa: B018 - resolves the source now
            tables[name] = df
            summary.append(df.agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("n_columns"),
                F.lit(", ".join(df.columns)).alias("columns"), F.lit(None).cast("string").alias("error")))
        except Exception as exc:  # noqa: BLE001 - reported as data
            failed.append((name, f"{type(exc).__name__}: {str(exc).splitlines()[0]}"))
    spark = SparkSession.active()
    out = spark.createDataFrame([(n, None, None, None, e) for n, e in failed],
                                "table string, rows long, n_columns int, columns string, error string")
    for s in summary:
        out = out.unionByName(s)
    return tables, out


def preview(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """First n rows per source with a flag telling whether more exist."""
    w = Window.partitionBy(source).orderBy(order)
    sizes = df.groupBy(source).agg((F.count("*") > n).alias("truncated"))
    return df.withColumn("preview_no", F.row_number().over(w)).filter(F.col("preview_no") <= n).join(sizes, source)
