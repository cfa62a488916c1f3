"""Large files cut into splits and read by many tasks, although what a byte means depends on all bytes before it.

A separator cuts the text of a split into pieces. A first pass reads each split from both start states, outside and inside
quotes, and keeps one row a split: how the state changes and how many borders the split holds. Sums over the splits of a
file then give each split's real start, and a second pass joins its pieces to records. A record that goes on in another
split is put together from its parts. The driver gets three numbers for each split, a fraction of what Spark's own scan plan
holds for it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafwork.session import shared_checkpoint

#: Candidates for the separator of delimited text.
SEPARATORS = ",;\t|"
RECORDS = "source_file string, record_no bigint, split bigint, part string, open boolean"


def pieces(spark: SparkSession, path: str, separator: str, glob: str = "*") -> DataFrame:
    """source_file, split (its first byte) and the pieces of all files, in order within each task."""
    text = spark.read.option("lineSep", separator).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return text.select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split"), "value")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, pa.Array]]:
    """(file, split, whether it is new, pieces) for each stretch of rows of one split."""
    last = None
    for batch in batches:
        files, splits, values = (batch.column(c) for c in ("source_file", "split", "value"))
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for column in (files, splits):
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.append(np.flatnonzero(new), n)
        for a, b in zip(starts, starts[1:]):
            key = (files[int(a)].as_py(), splits[int(a)].as_py())
            yield *key, key != last, values.slice(a, b - a)
            last = key


# quoted lines

CLOSING = re.compile(r'(?:[^"]|"")*+"(?!")')


def opening(separators: str) -> re.Pattern:
    """A quote counts where a field starts."""
    return re.compile(f'(?:^|[{re.escape(separators)}])"')


def ends_inside(line: str, inside: bool, opens: re.Pattern) -> bool:
    """Whether quotes are open behind a line; a quote in the middle of a field is an ordinary symbol."""
    at = 0
    while True:
        if inside:
            closed = CLOSING.match(line, at)
            if not closed:
                return True
            at = closed.end()
        opened = opens.search(line, at)
        if not opened:
            return False
        at, inside = opened.end(), True


def quoted(lines: pa.Array) -> np.ndarray:
    """Numbers of the lines that hold a quote."""
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))


def line_states(separators: str) -> Callable:
    """One row a split: for either start state, whether quotes are open in the end and how many records begin; and the first
    record of the file if it ends in its first split."""
    opens = opening(separators)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        head: list[str] | None = None
        head_open = False
        for file, split, new, lines in runs(batches):
            if new:
                rows.append([file, split, [False, True], [0, 0], None, 0])
                head, head_open = ([] if split == 0 else None), False
            row, texts = rows[-1], lines.to_pylist()
            if head is not None:  # the first line that is not blank begins the header
                for line in texts:
                    row[5] += not head
                    if head or line.strip("﻿\r \t"):
                        head_open = ends_inside(line if head else line.lstrip("﻿"), head_open, opens)
                        head.append(line)
                        if not head_open:
                            row[4], head = "\n".join(head), None
                            break
            with_quotes = quoted(lines).tolist()
            for s in (0, 1):
                at = 0
                for i in with_quotes:
                    row[3][s] += 0 if row[2][s] else i + 1 - at
                    row[2][s], at = ends_inside(texts[i], row[2][s], opens), i + 1
                row[3][s] += 0 if row[2][s] else len(texts) - at
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
            *[pa.array([r[2][s] for r in rows], pa.bool_()) for s in (0, 1)], *[pa.array([r[3][s] for r in rows], pa.int64()) for s in (0, 1)],
            pa.array([r[4] for r in rows], pa.string()), pa.array([r[5] for r in rows], pa.int64())],
            names=["source_file", "split", "from_outside", "from_inside", "begun_outside", "begun_inside", "head", "head_no"])

    return run


def line_parts(starts: dict[tuple[str, int], tuple[bool, int]], separators: str) -> Callable:
    """Pieces -> records and the open parts of records at the ends of splits. ``starts``: state and records before."""
    opens = opening(separators)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = split = held = None
        number, inside, entered = 0, False, False

        for next_file, next_split, new, lines in runs(batches):
            if new:
                if held is not None:
                    yield parts_of(file, split, [(number, "\n".join(held), entered or inside)])
                file, split = next_file, next_split
                inside, number = starts[file, split]
                entered, held = inside, [] if inside else None
            out, with_quotes = [], set(quoted(lines).tolist())
            for i, line in enumerate(lines.to_pylist()):
                if not inside:
                    if held is not None:
                        out.append((number, "\n".join(held), entered))
                        entered = False
                    number, held = number + 1, []
                held.append(line)
                if i in with_quotes:
                    inside = ends_inside(line, inside, opens)
            yield parts_of(file, split, out)
        if held is not None:
            yield parts_of(file, split, [(number, "\n".join(held), entered or inside)])

    return run


def parts_of(file: str, split: int, rows: list[tuple[int, str, bool]]) -> pa.RecordBatch:
    n = len(rows)
    numbers, parts, still_open = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([
        pa.array([file] * n, pa.string()), pa.array(numbers, pa.int64()), pa.array([split] * n, pa.int64()),
        pa.array(parts, pa.string()), pa.array(still_open, pa.bool_())], names=["source_file", "record_no", "split", "part", "open"])


def united(parts: DataFrame, separator: str) -> DataFrame:
    """source_file, record_no and record: whole ones as they are, others from their parts in the order of splits."""
    whole = parts.where("NOT open").select("source_file", "record_no", F.col("part").alias("record"))
    cut = parts.where("open").groupBy("source_file", "record_no").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("split", "part"))), lambda x: x["part"]), separator).alias("record"))
    return whole.unionByName(cut)


def before(column: str):
    """Sum of a number over the earlier splits of the file."""
    return F.sum(column).over(Window.partitionBy("source_file").orderBy("split")) - F.col(column)


def quoted_records(spark: SparkSession, path: str, glob: str = "*", separators: str = SEPARATORS) -> tuple[DataFrame, DataFrame]:
    """(source_file, record_no from 1 on, record; source_file, head and head_no, the first record that is not blank).

    Records end at a line end outside of double quotes. A head must end within its file's first split, else it is null.
    """
    lines = pieces(spark, path, "\n", glob)
    seen = shared_checkpoint(lines.mapInArrow(
        line_states(separators), "source_file string, split bigint, from_outside boolean, from_inside boolean, "
        "begun_outside bigint, begun_inside bigint, head string, head_no bigint"))
    starts, last, inside, number = {}, None, False, 0
    for r in seen.drop("head", "head_no").orderBy("source_file", "split").toLocalIterator():
        if r.source_file != last:
            last, inside, number = r.source_file, False, 0
        starts[r.source_file, r.split] = (inside, number)
        number += r.begun_inside if inside else r.begun_outside
        inside = r.from_inside if inside else r.from_outside
    parts = lines.mapInArrow(line_parts(starts, separators), RECORDS)
    return united(parts, "\n"), seen.where("split = 0").select("source_file", "head", "head_no")


# arrays of JSON values

def marks(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per piece: quotes, and bracket depth gained outside of strings if it starts outside or inside of one."""
    clean = pc.replace_substring_regex(values, r"(?s)\\.", "__").cast(pa.large_string())
    _, offsets, data = clean.buffers()
    offsets = np.frombuffer(offsets, np.int64)[clean.offset:clean.offset + len(clean) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    quote = np.concatenate([[0], np.cumsum(data == 34)])
    step = np.isin(data, (91, 123)).astype(np.int64) - np.isin(data, (93, 125))
    row = np.repeat(np.arange(len(clean)), np.diff(offsets))
    odd = (quote[1:] - quote[offsets[row]]) % 2 == 1 if len(data) else np.zeros(0, bool)
    total = np.diff(quote[offsets])
    outside = np.bincount(row, np.where(odd, 0, step), len(clean)).astype(np.int64)
    inside = np.bincount(row, np.where(odd, step, 0), len(clean)).astype(np.int64)
    return total, outside, inside


def walked(total: np.ndarray, outside: np.ndarray, inside: np.ndarray, state: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """State and depth behind each piece, from the start state on."""
    after = (state + np.cumsum(total)) % 2
    first = np.concatenate([[state], after[:-1]]) if len(after) else after
    return after, depth + np.cumsum(np.where(first == 1, inside, outside))


def array_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split: quotes (0 or 1 in the end), depth gained from either start state, and the pieces that end outside of a
    string at each depth relative to the start; of a file's first split also the first symbol."""
    rows: list[list] = []
    for file, split, new, values in runs(batches):
        if new:
            rows.append([file, split, 0, [0, 0], [{}, {}], None])
        row = rows[-1]
        if split == 0 and not row[5]:
            row[5] = next((s[0] for s in (v.lstrip("\ufeff \t\r\n") for v in values.to_pylist()) if s), None)
        found = marks(values)
        for s in (0, 1):
            after, depth = walked(*found, (s + row[2]) % 2, row[3][s])
            level, count = np.unique(depth[after == 0], return_counts=True)
            for k, n in zip(level.tolist(), count.tolist()):
                row[4][s][k] = row[4][s].get(k, 0) + n
            row[3][s] = int(depth[-1])
        row[2] = int(row[2] + found[0].sum()) % 2
    level = pa.list_(pa.struct([("depth", pa.int64()), ("n", pa.int64())]))
    yield pa.RecordBatch.from_arrays([
        pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
        *[pa.array([r[3][s] for r in rows], pa.int64()) for s in (0, 1)],
        *[pa.array([[{"depth": k, "n": n} for k, n in r[4][s].items()] for r in rows], level) for s in (0, 1)],
        pa.array([r[5] for r in rows], pa.string())],
        names=["source_file", "split", "state", "outside", "inside", "ends_outside", "ends_inside", "first"])


def array_parts(starts: dict[tuple[str, int], tuple[bool, int, int, int]]) -> Callable:
    """Pieces -> items of top-level arrays. ``starts``: whether the file is an array, state, depth and items before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = split = None
        held: list[str] = []
        number, state, depth, is_array, entered = 0, 0, 0, True, False

        def last() -> list[tuple[int, str, bool]]:
            text = ",".join(held)
            if is_array and state == 0 and depth == 0 and text.rstrip().endswith("]"):
                text = text.rstrip()[:-1]
            return [(number, text, True)]

        for next_file, next_split, new, values in runs(batches):
            if new:
                if held:
                    yield parts_of(file, split, last())
                file, split, held = next_file, next_split, []
                is_array, state, depth, number = starts[file, split]
                entered = split > 0 and not (is_array and state == 0 and depth == 1)
            after, level = walked(*marks(values), state, depth)
            texts, items, at = values.to_pylist(), [], 0
            if new and split == 0 and is_array:
                texts[0] = texts[0].lstrip("﻿ \t\r\n")[1:]
            for cut in np.flatnonzero((after == 0) & (level == 1)) if is_array else ():
                held += texts[at:cut + 1]
                items.append((number, ",".join(held), entered))
                held, at, number, entered = [], int(cut) + 1, number + 1, False
            held += texts[at:]
            state, depth = int(after[-1]), int(level[-1])
            yield parts_of(file, split, items)
        if held:
            yield parts_of(file, split, last())

    return run


def json_values(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """source_file, record_no from 0 on, record and is_array: the items of top-level arrays, and the texts of all other files."""
    text = pieces(spark, path, ",", glob)
    seen = shared_checkpoint(text.mapInArrow(
        array_states, "source_file string, split bigint, state bigint, outside bigint, inside bigint, "
        "ends_outside array<struct<depth: bigint, n: bigint>>, ends_inside array<struct<depth: bigint, n: bigint>>, first string"))
    kind = F.max(F.when(F.col("split") == 0, F.coalesce(F.col("first") == "[", F.lit(False)))).over(Window.partitionBy("source_file"))
    states = seen.withColumn("is_array", kind).withColumn("start", before("state") % 2).withColumn(
        "gain", F.when(F.col("start") == 0, F.col("outside")).otherwise(F.col("inside")))
    levels = states.withColumn("depth", before("gain")).withColumn(
        "ends", F.when(F.col("start") == 0, F.col("ends_outside")).otherwise(F.col("ends_inside")))
    # depths of a split count from its own start; the closing bracket of the file ends no piece at depth 1
    top = F.filter("ends", lambda e: e["depth"] == 1 - F.col("depth"))
    items = levels.withColumn("items", F.when(F.col("is_array"), F.coalesce(F.get(top, 0)["n"], F.lit(0))).otherwise(0))
    starts = {(r.source_file, r.split): (r.is_array, r.start, r.depth, r.before) for r in items.select(
        "source_file", "split", "is_array", "start", "depth", before("items").alias("before")).collect()}
    found = united(text.mapInArrow(array_parts(starts), RECORDS), ",")
    arrays = seen.where("split = 0").select("source_file", F.coalesce(F.col("first") == "[", F.lit(False)).alias("is_array"))
    return found.join(arrays, "source_file")
