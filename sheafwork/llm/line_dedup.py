"""Line dedup with two Bloom filters.

Line hashes are dealt over buckets; in each bucket the first filter takes every hash once seen, and a hash that it
already holds goes into the second. Lines that the second filters do not hold are unique and go no further. Only the
others shuffle again, by the 128-bit digest of their keys, to confirm the repeat and to find the smallest document that
holds it. The second filters have a bound, whatever the corpus: beyond it they let more unique lines through, and the
confirmation stays the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import U64, bloom_add, bloom_test, pieces, power_of_two, text_buffers, unbounded, written

LEAST = 10
SPACE = bytes([32, *range(9, 14)])
#: Bits a hash, probes, and hashes of one layer of a once-seen filter (further layers follow as it fills).
BITS, PROBES, LAYER = 12, 6, 1 << 20
#: Columns that dedup_lines() adds or uses.
ADDED = ("kept", "n_lines", "n_dropped", "drop")
#: Bytes of the second filters, which are broadcast, at most.
MOST_BYTES = 64 << 20


def keys_of(text: bytes, least: int) -> list[bytes | None]:
    """Key of each line, None for one too short to count."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(SPACE).lower()  # bytes: A-Z only
        n = len(key)
        if n >= least and (n >= 4 * least or key.isascii() or len(key.decode("utf-8", "replace")) >= least):
            out.append(key)
        else:
            out.append(None)
    return out


def texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = text_buffers(batch.column("text"))
    held = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield held[a:b]


def hash_lines(least: int):
    """The hashes of each task's lines: once, or twice if two of the task's documents have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=32 << 20):
            own = [xxhash.xxh3_64_intdigest(k) for t in texts(batch) for k in set(keys_of(t, least)) if k is not None]
            hashes, counts = np.unique(np.array(own, np.uint64), return_counts=True)
            out = np.repeat(hashes, np.minimum(counts, 2))
            yield pa.RecordBatch.from_pydict({"hash": pa.array(out.view(np.int64), pa.int64())})

    return run


def twice_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes that the once-seen filter already held when they came."""
    layers, held = [np.zeros(power_of_two(BITS * LAYER) // 8, np.uint8)], 0
    for batch in batches:
        hashes, counts = np.unique(batch.column("hash").to_numpy().view(np.uint64), return_counts=True)
        again = counts > 1
        for layer in layers:
            again |= bloom_test(layer, hashes, PROBES)
        new = hashes[~again | (counts > 1)]
        bloom_add(layers[-1], new, PROBES)
        held += len(new)
        if held >= LAYER:
            layers.append(np.zeros_like(layers[-1]))
            held = 0
        yield pa.RecordBatch.from_pydict({"hash": pa.array(hashes[again].view(np.int64), pa.int64())})


def second_filter(suspects: DataFrame, buckets: int, bucket_bytes: int) -> np.ndarray:
    """Bits of the twice-seen filters, one row for each bucket; filled in the tasks, of a size the caller has checked."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column("hash").to_numpy().view(np.uint64)
            at = (h % U64(buckets)).astype(np.int64)
            for b in np.unique(at):
                bloom_add(held.setdefault(int(b), np.zeros(bucket_bytes, np.uint8)), h[at == b], PROBES)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(held), pa.int64()),
                                          "filled": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    out = np.zeros((buckets, bucket_bytes), np.uint8)
    dealt = suspects.repartition(buckets, F.expr(f"pmod(hash, {buckets})"))
    for row in dealt.mapInArrow(fill, "bucket bigint, filled binary").toLocalIterator():
        out[row.bucket] |= np.frombuffer(row.filled, np.uint8)
    return out


def suspected(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes), bool)
    at = (hashes % U64(len(filled))).astype(np.int64)
    for b in np.unique(at):
        out[at == b] = bloom_test(filled[b], hashes[at == b], PROBES)
    return out


def suspected_lines(least: int, filters: Broadcast):
    """(doc_id, digest) of each document's different keys that may repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, keys = [], []
            for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                own = [k for k in set(keys_of(t, least)) if k is not None]
                ids += [i] * len(own)
                keys += own
            take = np.flatnonzero(suspected(filters.value, np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids[i] for i in take], pa.int64()),
                "digest": pa.array([hashlib.md5(keys[i]).digest() for i in take], pa.binary())})

    return run


def drop_lines(least: int):
    """Texts without the lines whose key hashes stand in ``drop`` (128-bit hashes, joined)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            kept, lines, dropped = [], [], []
            for t, drop in zip(texts(batch), batch.column("drop").to_pylist()):
                own = t.split(b"\n")
                lines.append(len(own))
                if drop:
                    drop = set(drop)
                    own = [x for x, k in zip(own, keys_of(t, least)) if k is None or hashlib.md5(k).digest() not in drop]
                dropped.append(lines[-1] - len(own))
                kept.append(b"\n".join(own))
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            text = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*arrays, text, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                names=[*batch.schema.names[:-1], "kept", "n_lines", "n_dropped"])

    return run


def repeated_elsewhere(docs: DataFrame, least: int = LEAST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, drop): for each document that loses lines, the 128-bit hashes of their keys."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    once = docs.mapInArrow(hash_lines(least), "hash bigint")
    suspects = written(once.repartition("hash").mapInArrow(twice_seen, "hash bigint").distinct(), "suspects")
    n = suspects.count()
    wanted = min(power_of_two(1.2 * n * BITS), 8 * most_bytes)
    buckets = max(1, wanted >> 20)
    bucket_bytes = power_of_two(wanted // buckets) // 8
    filters = spark.sparkContext.broadcast(second_filter(suspects, buckets, bucket_bytes))
    lines = written(docs.mapInArrow(suspected_lines(least, filters), "doc_id bigint, digest binary"), "suspected-lines")
    first = lines.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # written, so that the join deals both sides itself and can split a key that a third of all documents hold
    later = lines.join(written(first.drop("last"), "repeated-lines"), "digest").where(F.col("doc_id") > F.col("first"))
    return later.groupBy("doc_id").agg(F.collect_set("digest").alias("drop"))


def dedup_lines(docs: DataFrame, least: int = LEAST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All columns of ``docs`` and kept (text), n_lines (before), n_dropped.

    A line's key is the line without outer white space (space, tab to carriage return), A-Z lower-cased. Keys of at least
    ``least`` code points that two documents hold lose their lines in all but the smallest doc_id; repeats within that
    document stay. A null or empty text is one empty line. Rows without doc_id keep all lines and take no part; rows that
    repeat a doc_id are one document. Columns named kept, n_lines, n_dropped or drop are replaced.
    """
    docs = docs.drop(*ADDED)
    drop = repeated_elsewhere(docs, least, most_bytes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.join(unbounded(drop), "doc_id", "left").select(*docs.columns, "drop").mapInArrow(
        drop_lines(least), f"{schema}, kept string, n_lines bigint, n_dropped bigint")
