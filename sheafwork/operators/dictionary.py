"""Which names of a dictionary stand inside which texts, without exploding the texts.

Windows are bytes, and their widths powers of two: a window's hash is made of the hashes of its halves, so one pass per width
hashes all windows of a text. A name is known by the window that it starts with and the one of the same width that it ends
with. Two filters of fixed size hold the names' first windows and whole names; they are built by tasks, united by a bitwise
OR per word, and a text's windows are tested against them inside the task. What passes leaves the row as the substring
itself, so an equi-join on the name is the exact test, at any size of the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: 64-bit words of each filter (2 MiB): what is broadcast never exceeds twice this and one word for each 64 lengths.
WORDS = 1 << 18
#: Bytes of text hashed at a time.
PIECE = 1 << 21
HEADS, WHOLE, LENGTHS = 0, 1, 2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


BYTES = mix(mix(np.arange(1, 257, dtype=np.uint64)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of the texts in them; null is empty."""
    column = pa.array(column.fill_null("") if column.null_count else column, pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def widths(data: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(width, hash of the window from each byte on) for widths 1, 2, 4 up to ``most``."""
    width, hashes = 1, BYTES[data]
    while width <= most and len(hashes):
        yield width, hashes
        hashes = mix(hashes[:-width] * U64(0xA24BAED4963EE407) + hashes[width:]) if len(hashes) > width else hashes[:0]
        width *= 2


def whole_key(head: np.ndarray, tail: np.ndarray, length: np.ndarray | int, scope: np.ndarray) -> np.ndarray:
    return mix(mix(head + U64(3) * tail + np.asarray(length, np.uint64)) ^ scope)


def places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bits of each key: one word, four bits."""
    bits = np.zeros(len(keys), np.uint64)
    for i in range(4):
        bits |= U64(1) << ((keys >> U64(6 * i)) & U64(63))
    return (keys >> U64(40)).astype(np.int64) & (WORDS - 1), bits


def name_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name and scope -> words and bits that they set in the filters."""
    for batch in batches:
        data, offsets = buffers(batch.column("name"))
        lengths = np.diff(offsets)
        scope = batch.column("scope").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        parts = []
        for width, hashes in widths(data, int(lengths.max(initial=0))):
            of = np.flatnonzero((lengths >= width) & (lengths < 2 * width))
            head, tail = hashes[offsets[of]], hashes[offsets[of] + lengths[of] - width]
            parts += [(HEADS, *places(head)), (WHOLE, *places(whole_key(head, tail, lengths[of], scope[of])))]
        parts.append((LENGTHS, lengths >> 6, U64(1) << (lengths & 63).astype(np.uint64)))
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array(np.concatenate([np.full(len(w), k, np.int32) for k, w, _ in parts])),
            "word": pa.array(np.concatenate([w for _, w, _ in parts]).astype(np.int64)),
            "bits": pa.array(np.concatenate([b for _, _, b in parts]).view(np.int64))})


def filters(names: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filters of first windows and whole names, and the names' lengths in bytes. names: name, scope."""
    bits = names.where(F.length("name") > 0).mapInArrow(name_bits, "kind int, word bigint, bits bigint")
    found = bits.groupBy("kind", "word").agg(F.bit_or("bits").alias("bits")).toArrow()
    kind, word = found.column("kind").to_numpy(), found.column("word").to_numpy()
    value = found.column("bits").to_numpy().view(np.uint64)
    out = []
    for k in (HEADS, WHOLE):
        table = np.zeros(WORDS, np.uint64)
        table[word[kind == k]] = value[kind == k]
        out.append(table)
    lengths = [w * 64 + np.flatnonzero(v >> np.arange(64, dtype=np.uint64) & U64(1))
               for w, v in zip(word[kind == LENGTHS].tolist(), value[kind == LENGTHS])]
    return out[0], out[1], np.sort(np.concatenate(lengths)) if lengths else np.zeros(0, np.int64)


def holds(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word, bits = places(keys)
    return table[word] & bits == bits


def candidates(data: np.ndarray, offsets: np.ndarray, scope: np.ndarray, heads: np.ndarray, whole: np.ndarray,
               lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the substrings that pass both filters; starts and ends are borders of characters."""
    border = np.append((data & 0xC0) != 0x80, True)
    found = []
    for width, hashes in widths(data, int(lengths.max(initial=0))):
        of_width = lengths[(lengths >= width) & (lengths < 2 * width)]
        if not len(of_width):
            continue
        at = np.flatnonzero(border[:len(hashes)])
        at = at[holds(heads, hashes[at])]
        text = np.searchsorted(offsets, at, "right") - 1
        for length in of_width.tolist():
            fits = at + length <= offsets[text + 1]
            start, row = at[fits], text[fits]
            keys = whole_key(hashes[start], hashes[start + length - width], length, scope[row])
            passed = holds(whole, keys) & border[start + length]
            found.append((row[passed], start[passed], np.full(int(passed.sum()), length)))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def substrings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The given byte ranges as strings."""
    ends = np.cumsum(length)
    take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)
    return pa.LargeStringArray.from_buffers(
        len(start), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()), pa.py_buffer(data[take].tobytes()))


def names_in(texts: DataFrame, names: DataFrame, keys: list[str], scope: list[str] | None = None) -> DataFrame:
    """``keys`` and name of what may be a name inside each row's text, each once a row: join it with the names to be sure.

    texts: keys, text; names: name. Both hold the columns ``scope``: names count in texts of the same scope. Null and empty
    texts and names give nothing. Rows with equal keys are looked at one by one.
    """
    spark = texts.sparkSession
    of = F.xxhash64(*scope) if scope else F.lit(0).cast("bigint")
    shared = spark.sparkContext.broadcast(filters(names.select("name", of.alias("scope")).distinct()))
    schema = T.StructType([*[texts.schema[k] for k in keys], T.StructField("name", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, whole, lengths = shared.value
        for batch in batches:
            _, all_offsets = buffers(batch.column("text"))
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(all_offsets, all_offsets[first] + PIECE, "right")) - 1
                last = min(max(last, first + 1), batch.num_rows)
                part = batch.slice(first, last - first)
                first = last
                data, offsets = buffers(part.column("text"))
                of_row = part.column("_scope").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                row, start, length = candidates(data, offsets, of_row, heads, whole, lengths)
                if not len(row):
                    continue
                once = pa.table({"row": pa.array(row), "name": substrings(data, start, length)}).group_by(["row", "name"]).aggregate([])
                at = once.column("row").combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k).take(at) for k in keys], once.column("name").combine_chunks().cast(pa.string())], names=[*keys, "name"])

    rows = texts.where(F.length("text") > 0).select(*keys, "text", of.alias("_scope"))
    return rows.mapInArrow(run, schema)
