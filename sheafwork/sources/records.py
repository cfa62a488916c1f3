"""JSON records: scan, bad-line quarantine, unwrapping, flattening, key frequency, record tables."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.sources.splits import json_values

BOM = "﻿"


def number_lines(lines: DataFrame, file_col: str = "source_file", name: str = "line_no") -> DataFrame:
    """1-based line number per file, numbered inside each scan partition and shifted by the ones before.

    A file that holds a third of all lines is numbered split by split, never in one task.
    """
    placed = lines.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    sizes = placed.groupBy(file_col, "_pid").agg(F.count("*").alias("_n"))
    before = sizes.select(file_col, "_pid", (
        F.sum("_n").over(Window.partitionBy(file_col).orderBy("_pid")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(file_col, "_pid").orderBy("_mid"))
    return placed.withColumn("_rn", inside).join(before, [file_col, "_pid"]).withColumn(
        name, (F.col("_rn") + F.col("_before")).cast("long")).drop("_rn", "_before", "_pid", "_mid")


def is_valid_json(col: Column) -> Column:
    """One JSON value and nothing behind it; repeated object keys are allowed.

    The parsers stop at the end of the first value, so the text is also tested as a member of an object and as the only
    item of a list: text behind the value breaks one of the two.
    """
    parses = F.json_object_keys(col).isNotNull() | F.try_parse_json(col).isNotNull()  # an object needs no second parse
    member = F.get_json_object(F.concat(F.lit('{"v":'), col, F.lit(',"end":0}')), "$.end") == "0"
    item = F.json_array_length(F.concat(F.lit("["), col, F.lit("]"))) == 1
    return F.coalesce(parses & member & item, F.lit(False))


def quarantine_bad_lines(lines: DataFrame, value: str = "value", file_col: str = "source_file",
                         line: str = "line_no", shown: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid records, warnings): every bad line with its text, or the first ``shown`` per file and a count of the rest."""
    live = lines.filter(F.trim(value) != "")
    good = live.filter(is_valid_json(F.col(value)))
    bad = live.filter(~is_valid_json(F.col(value)))
    if shown is None:
        return good, bad.select(file_col, F.col(line).cast("long").alias("warning_no"), F.concat(
            F.lit("line "), F.col(line), F.lit(" is no JSON value")).alias("warning"), F.col(value).alias("bad_text"))
    w = Window.partitionBy(file_col).orderBy(line)
    named = bad.select(file_col, line).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= shown).select(
        file_col, F.col("_rn").alias("warning_no"),
        F.concat(F.lit("line "), F.col(line), F.lit(" is no JSON value")).alias("warning"))
    rest = bad.groupBy(file_col).agg(F.count("*").alias("n")).filter(F.col("n") > shown).select(
        file_col, F.lit(shown + 1).alias("warning_no"),
        F.concat(F.col("n") - shown, F.lit(" further lines are no JSON values")).alias("warning"))
    return good, named.unionByName(rest)


def unwrap_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """An object with exactly one key holding a non-empty list of only objects becomes its records."""
    texts = F.from_json(raw, "map<string,string>")
    kinds = F.from_json(raw, "map<string,variant>")

    def record_list(key: Column, text: Column) -> Column:
        items = F.from_json(text, "array<string>")
        kind = F.schema_of_variant(F.try_element_at(kinds, key))
        return F.coalesce(kind.startswith("ARRAY<OBJECT") & (F.size(items) > 0)
                          & F.forall(items, lambda x: x.startswith("{")), F.lit(False))

    held = df.withColumn("_lists", F.map_values(F.map_filter(texts, record_list)))
    one = F.coalesce(F.size("_lists") == 1, F.lit(False)) & F.ltrim(raw).startswith("{")
    records = F.when(one, F.from_json(F.get("_lists", 0), "array<string>")).otherwise(F.array(raw))
    keep = [c for c in df.columns if c != raw]
    return held.select(*keep, F.posexplode(records).alias("record_no", raw))


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(source_file, record_no, raw) of .jsonl files, top-level arrays and single objects; warnings.

    JSONL is read by line and arrays by item, both in splits; only a file with one object is one value.
    """
    lines = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.regexp_replace("value", f"^{BOM}", "").alias("value"))
    good, warnings = quarantine_bad_lines(number_lines(lines))
    jsonl = good.select("source_file", F.col("line_no").alias("record_no"), F.col("value").alias("raw"))
    values = json_values(spark, path).withColumn("raw", F.trim(F.regexp_replace("record", f"^{BOM}|[\\r\\n\\t]+\\z|^[\\r\\n\\t]+", ""))).where(
        "NOT (is_array AND record_no = 0 AND raw = '')")  # an empty array
    valid = is_valid_json(F.col("raw"))
    items = values.where(valid & F.col("is_array")).select("source_file", (F.col("record_no") + 1).alias("record_no"), "raw")
    objects = unwrap_records(values.where(valid & ~F.col("is_array")).select("source_file", "raw")).select(
        "source_file", (F.col("record_no") + 1).cast("long").alias("record_no"), "raw")
    broken = values.where(~valid).select(
        "source_file", (F.col("record_no") + 1).alias("warning_no"),
        F.when(F.col("is_array"), F.concat(F.lit("item "), F.col("record_no") + 1, F.lit(" is no JSON value"))).otherwise("file is no JSON value").alias("warning"),
        F.col("raw").alias("bad_text"))
    return jsonl.unionByName(items).unionByName(objects), warnings.unionByName(broken)


def json_leaves(text: str, depth: int | None = None, list_items: int | None = None) -> list[tuple[str, str, list[int]]]:
    """(path, value, positions) of each leaf of a JSON text, in order; a list also has a line with its length.

    Open values stand on a stack of their own, so depth costs no call. A text that is no JSON value, or nests deeper than the
    parser goes (some thousand levels), is one leaf ``value`` with the whole text.
    """
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return [("value", text, [])]
    out: list[tuple[str, str, list[int]]] = []
    waiting = [("" if isinstance(value, dict) else "value", value, [])]
    while waiting:
        path, value, place = waiting.pop()
        if depth is not None and len(place) >= depth and isinstance(value, (dict, list)):
            if value != {}:
                out.append((path, json.dumps(value, ensure_ascii=False, separators=(",", ":")), place))
        elif isinstance(value, dict):
            inner = [(f"{path}.{k}" if path else k, v, [*place, i]) for i, (k, v) in enumerate(value.items())]
            waiting += reversed(inner)
        elif isinstance(value, list):
            kept = value if list_items is None else value[:list_items]
            more = "" if len(kept) == len(value) else f", first {len(kept)} kept"
            out.append((path, f"[{len(value)} items{more}]", place))
            waiting += reversed([(f"{path}[{i}]", v, [*place, i]) for i, v in enumerate(kept)])
        else:
            out.append((path, str(value), place))
    return out


def flatten_json(df: DataFrame, raw: str = "raw", depth: int | None = None, list_items: int | None = None) -> DataFrame:
    """Dotted paths of every record: other columns, path, value, ord (position for first-seen order).

    Records are walked in place, one by one, whatever their depth: the plan is one narrow stage. With ``depth`` deeper
    branches stay JSON text; ``list_items`` keeps the first items of each list only. Empty objects and null records have no
    paths; of a repeated key the last value counts. Values show as they print: None, True, 1.5.
    """
    keep = [f for f in df.schema.fields if f.name != raw]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, T.StructField("path", T.StringType()), T.StructField("value", T.StringType()),
                           T.StructField("ord", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, path, value, place = [], [], [], []

            def out() -> pa.RecordBatch:
                at = pa.array(row, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [*[batch.column(n).take(at) for n in names], pa.array(path, pa.string()), pa.array(value, pa.string()),
                     pa.array(place, pa.list_(pa.int32()))], names=schema.names)

            for i, text in enumerate(batch.column(raw).to_pylist()):
                for p, v, o in json_leaves(text, depth, list_items):
                    row.append(i)
                    path.append(p)
                    value.append(v)
                    place.append(o)
                if len(row) >= 1 << 16 or (place and len(place[-1]) > 256):  # deep paths are long
                    yield out()
                    row, path, value, place = [], [], [], []
            yield out()

    return df.where(F.col(raw).isNotNull()).select(*names, raw).mapInArrow(run, schema)


def path_counter(order: str) -> Callable:
    """Partial counts of a task: path, n and the place of the first row of each path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, object, tuple]] = {}

        def out(names: list[str]) -> pa.RecordBatch:
            kept = seen.values()
            return pa.RecordBatch.from_arrays([
                pa.array(seen, pa.string()), pa.array([v[0] for v in kept], pa.int64()),
                pa.array([v[1] for v in kept], place_type), pa.array([v[2] for v in kept], pa.list_(pa.int32()))], names=names)

        place_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            places, ords, place_type = batch.column(order), batch.column("ord"), batch.column(order).type
            paths = batch.column("path").dictionary_encode()
            code = paths.indices.to_numpy()
            rank = pc.rank(places, tiebreaker="dense", null_placement="at_start").to_numpy().astype(np.int64)
            least = np.full(len(paths.dictionary), np.iinfo(np.int64).max)
            np.minimum.at(least, code, rank)
            counts = np.bincount(code, minlength=len(least)).tolist()
            first: dict[int, tuple] = {}
            for i in np.flatnonzero(rank == least[code]).tolist():
                place = tuple(ords[i].as_py())
                if code[i] not in first or place < first[code[i]][1]:
                    first[code[i]] = i, place
            for c, path in enumerate(paths.dictionary.to_pylist()):
                i, place = first[c]
                mine, known = (counts[c], places[i].as_py(), place), seen.get(path)
                if known is not None:
                    low = min(known, mine, key=lambda v: (v[1] is not None, v[1], v[2]))  # nulls first
                    mine = (known[0] + counts[c], *low[1:])
                seen[path] = mine
            if len(seen) > 1 << 17:
                yield out(["path", "n", order, "ord"])
                seen.clear()
        if seen:
            yield out(["path", "n", order, "ord"])

    return run


def key_frequency(flat: DataFrame, n: int | None = None, order: str = "record_no") -> DataFrame:
    """Records per path, most frequent first, first seen first among equals; all paths, or the first ``n``.

    Rows are counted within their tasks, so that no task sorts them: only the counts are shuffled.
    """
    kind = flat.schema[order].dataType.simpleString()
    parts = flat.select("path", order, "ord").mapInArrow(path_counter(order), f"path string, n bigint, `{order}` {kind}, ord array<int>")
    per = parts.groupBy("path").agg(F.sum("n").alias("records"), F.min(F.struct(order, "ord")).alias("seen"))
    ranked = per.orderBy(F.desc("records"), "seen")
    return (ranked if n is None else ranked.limit(n)).select("path", "records")


def records_to_table(flat: DataFrame, keys: list[str], n: int | None = None, order: str = "record_no") -> DataFrame:
    """Paths as columns (all, or the ``n`` most frequent), missing values as empty text.

    Neighbouring rows of a record become one row within their task, so that records are sorted and shuffled, not their values.
    """
    headers = [r.path for r in key_frequency(flat, n, order).collect()]
    schema = T.StructType([*[flat.schema[k] for k in keys], *[T.StructField(f"_v{i}", T.StringType()) for i in range(len(headers))]])
    rows = flat.select(*keys, "path", "value").mapInArrow(run_pivoter(keys, headers, schema.names), schema)
    return rows.groupBy(*keys).agg(*[F.coalesce(F.max(f"_v{i}"), F.lit("")).alias(h) for i, h in enumerate(headers)])


def run_pivoter(keys: list[str], headers: list[str], names: list[str]) -> Callable:
    """One row for each run of rows with equal keys, its values under their paths; of a path that stands in a run again, one more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in keys:
                c = batch.column(k)
                same = pc.equal(c[1:], c[:-1]).fill_null(False)
                same = pc.or_(same, pc.and_(pc.is_null(c[1:]), pc.is_null(c[:-1])))
                new[1:] |= ~same.to_numpy(zero_copy_only=False)
            of, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            paths, values = batch.column("path").dictionary_encode(), batch.column("value")
            place = {p: i for i, p in enumerate(paths.dictionary.to_pylist())}
            code = paths.indices.fill_null(-1).to_numpy()
            columns, more = [], []
            for i, h in enumerate(headers):
                at = np.flatnonzero(code == place.get(h, -2))
                first = np.append(True, of[at][1:] != of[at][:-1])[:len(at)]
                take = np.full(len(starts), -1)
                take[of[at[first]]] = at[first]
                columns.append(values.take(pa.array(take, pa.int64(), mask=take < 0)))
                if not first.all():
                    more.append((i, at[~first]))
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(starts)) for k in keys], *columns], names=names)
            for i, at in more:
                empty = pa.nulls(len(at), values.type)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(at)) for k in keys], *[
                    values.take(pa.array(at)) if i == j else empty for j in range(len(headers))]], names=names)

    return run


def duplicate_keys(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Repeated object keys at any depth: other columns, key, repeats (the last value wins)."""
    keep = [f for f in df.schema.fields if f.name != raw]
    schema = T.StructType(keep + [T.StructField("key", T.StringType()), T.StructField("repeats", T.LongType())])
    names = [f.name for f in keep]

    def repeats(text: str) -> Counter:
        seen: Counter = Counter()

        def hook(pairs: list) -> dict:
            seen.update({k: n - 1 for k, n in Counter(k for k, _ in pairs).items() if n > 1})
            return dict(pairs)

        try:
            json.loads(text, object_pairs_hook=hook)
        except (ValueError, RecursionError):
            return Counter()
        return seen

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(*row[:-1], k, n) for row in pdf[[*names, raw]].itertuples(index=False, name=None)
                     for k, n in repeats(row[-1]).items()]
            yield pd.DataFrame(found, columns=[*names, "key", "repeats"])

    return df.filter(F.col(raw).isNotNull()).mapInPandas(run, schema)


def duplicate_key_warning(dups: DataFrame, file_col: str = "source_file", shown: int | None = None) -> DataFrame:
    """One warning per file: total repeats, key names (all, or the first ``shown``), how many more names."""
    per = dups.groupBy(file_col, "key").agg(F.sum("repeats").alias("repeats"))
    w = Window.partitionBy(file_col).orderBy("key")
    few = per if shown is None else per.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= shown)
    first = few.groupBy(file_col).agg(
        F.array_join(F.sort_array(F.collect_list("key")), ", ").alias("keys"))
    total = per.groupBy(file_col).agg(F.sum("repeats").alias("repeats"), F.count("*").alias("names"))
    return total.join(first, file_col).withColumn("more_names", F.greatest(F.col("names") - shown, F.lit(0)) if shown is not None else F.lit(0).cast("long")).drop("names")


def record_text(records: DataFrame, source: str = "source_file", order: str = "record_no", raw: str = "raw",
                limit: int | None = None, cut: int | None = None) -> DataFrame:
    """One text block per record; limit and cut apply only when given."""
    text = F.col(raw) if cut is None else F.substring(raw, 1, cut)
    out = records.select(source, F.col(order).alias("ordinal"), text.alias("text"))
    if limit is None:
        return out
    w = Window.partitionBy(source).orderBy("ordinal")
    return out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")
