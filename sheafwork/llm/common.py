"""Helpers shared by the corpus operators: shared folders, Arrow text buffers, word hashes, Bloom bits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


# folders that driver and executors share

def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; a temporary folder only where that setting is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in a new shared folder, reread: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unbounded(df: DataFrame) -> DataFrame:
    """One side of a join whose size follows the corpus: never broadcast, so a join is planned alike at every size."""
    return df.hint("merge")


# Arrow text

def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that their texts hold about ``limit`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_buffers(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the row offsets into them (from 0); a null text is an empty one."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


# words: A-Z lower-cased, runs of digits, letters and everything beyond ASCII

def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    for i in range(128):
        if not chr(table[i]).isalnum():
            table[i] = 0
    return table


LOWER = _lower_table()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_CODES = mix(np.arange(256, dtype=np.uint64) + U64(0x9E3779B97F4A7C15))
BYTE_CODES[0] = 0
STEP = U64(0xD6E8FEB86659FD93)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a run of texts: 64-bit hash, byte range, and the words' range of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        inside = low != 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(data) + 2, bool)
        before[1:-1] = inside
        self.starts = np.flatnonzero(inside & (~before[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~before[2:] | edge[1:])) + 1
        self.low = low
        self.first = np.searchsorted(self.starts, offsets)  # word ranges of the texts
        if len(self.starts):
            longest = int((self.ends - self.starts).max())
            heads = np.concatenate([[0], self.starts])
            place = np.arange(len(data)) - np.repeat(heads, np.diff(np.append(heads, len(data))))
            value = BYTE_CODES[low] * powers(STEP, longest)[np.minimum(place, longest - 1)]
            self.hashes = mix(np.add.reduceat(value, self.starts))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, first: int, last: int) -> str:
        """The words first..last-1, lower-cased, joined by one space."""
        return b" ".join(self.low[self.starts[i]:self.ends[i]].tobytes() for i in range(first, last)).decode("utf-8", "replace")

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, over text borders too; empty if there are fewer words."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j, p in enumerate(powers(U64(0xA24BAED4963EE407), k)):
            total += self.hashes[j:j + n] * p
        return mix(total)


# Bloom bits

def bloom_places(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """Bit numbers of each hash (probes x hashes), by double hashing; ``bits`` is a power of two."""
    second = mix(hashes ^ U64(0x2545F4914F6CDD1D)) | U64(1)
    return np.stack([(hashes + U64(i) * second) & U64(bits - 1) for i in range(probes)])


def bloom_test(filled: np.ndarray, hashes: np.ndarray, probes: int) -> np.ndarray:
    """Which hashes may be in the filter (bytes of its bits)."""
    hit = np.ones(len(hashes), bool)
    second = mix(hashes ^ U64(0x2545F4914F6CDD1D)) | U64(1)
    alive = np.arange(len(hashes))
    for i in range(probes):
        at = (hashes[alive] + U64(i) * second[alive]) & U64(len(filled) * 8 - 1)
        ok = (filled[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1
        hit[alive[ok == 0]] = False
        alive = alive[ok == 1]
    return hit


def bloom_add(filled: np.ndarray, hashes: np.ndarray, probes: int) -> None:
    at = bloom_places(hashes, len(filled) * 8, probes).ravel()
    np.bitwise_or.at(filled, (at >> U64(3)).astype(np.int64), np.uint8(1) << (at & U64(7)).astype(np.uint8))


def power_of_two(n: float) -> int:
    return 1 << max(10, int(np.ceil(np.log2(max(n, 1)))))
