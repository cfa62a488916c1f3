"""Benchmark decontamination by winnowing.

Texts are words (A-Z lower-cased). Of every run of ``window - gram + 1`` word k-grams the smallest hash is kept as a
fingerprint, on both sides, so any shared span of ``window`` words shares a fingerprint. Documents keep only fingerprints
that a bounded Bloom filter of the benchmark's may hold; each survivor is extended to the windows around it, and these
are joined with the benchmark's windows by their words. Items of fewer words are one window, fingerprinted whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import (
    U64, Words, bloom_add, bloom_test, mix, pieces, power_of_two, text_buffers, written,
)

WINDOW, GRAM = 10, 5
#: The filter has at most so many bits, whatever the benchmark's size: beyond that more fingerprints pass it.
MOST_BITS, SEGMENT_BITS, PROBES = 1 << 27, 1 << 16, 4


def fingerprints(grams: np.ndarray, run: int) -> np.ndarray:
    """Places of the k-grams that are the smallest of some run of ``run`` consecutive ones."""
    n = len(grams) - run + 1
    if n <= 0:
        return np.arange(len(grams))
    least = grams[:n].copy()
    for j in range(1, run):
        np.minimum(least, grams[j:j + n], out=least)
    best = np.zeros(len(grams), np.uint64)
    for j in range(run):
        np.maximum(best[j:j + n], least, out=best[j:j + n])
    kept = best == grams
    return np.flatnonzero(kept)


def window_hash(words: Words, length: int) -> np.ndarray:
    """Hash of each window; the length is part of it."""
    return mix(words.grams(length) ^ U64(length))


def items_of(benchmark: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Classes of items with the same words (class_id, item_ids), and their windows (class_id, key, length, hash, prints)."""
    words = F.expr(r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                   r"'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)")
    # identical items are one class, so a hot item costs one set of windows
    named = benchmark.select(F.col("item_id").cast("string").alias("item"), F.array_join(words, " ").alias("body"))
    named = named.where("body <> ''").groupBy("body").agg(F.collect_set("item").alias("item_ids"))
    named = written(named.select(F.xxhash64("body", F.lit(1)).alias("c1"), F.xxhash64("body", F.lit(2)).alias("c2"),
                                 "body", "item_ids").withColumn("class_id", F.struct("c1", "c2")).drop("c1", "c2"),
                    "benchmark-classes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "body"):
            ids = batch.column("class_id").to_pylist()
            data, offsets = text_buffers(batch.column("body"))
            rows = []
            for i, class_id in enumerate(ids):
                w = Words(data[offsets[i]:offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))
                n = len(w.hashes)
                length = min(n, window)
                whole = window_hash(w, length)
                marks = w.grams(gram) if length == window else whole
                chosen = fingerprints(marks, window - gram + 1) if length == window else np.arange(1)
                for s in range(n - length + 1):
                    inner = chosen[(chosen >= s) & (chosen <= s + length - gram)] if length == window else chosen
                    rows.append((class_id, w.text(s, s + length), length, int(whole[s].view(np.int64)),
                                 marks[inner].view(np.int64).tolist()))
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("class_id", "key", "length", "hash", "prints"), r)) for r in rows],
                schema=pa.schema([("class_id", batch.schema.field("class_id").type), ("key", pa.string()),
                                  ("length", pa.int32()), ("hash", pa.int64()), ("prints", pa.list_(pa.int64()))]))

    windows = named.select("class_id", "body").mapInArrow(
        cut, "class_id struct<c1: bigint, c2: bigint>, key string, length int, hash bigint, prints array<bigint>")
    return named.select("class_id", "item_ids"), written(windows, "benchmark-windows")


def filter_of(hashes: DataFrame) -> np.ndarray:
    """Bloom bits of the column ``hash``, filled segment by segment in the tasks; never more than MOST_BITS bits."""
    hashes = hashes.distinct()
    bits = min(power_of_two(12 * hashes.count()), MOST_BITS)
    segments = max(1, bits // SEGMENT_BITS)
    size = bits // segments

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column("hash").to_numpy().view(np.uint64)
            part = (mix(h) % U64(segments)).astype(np.int64)
            for s in np.unique(part):
                bloom_add(held.setdefault(int(s), np.zeros(size // 8, np.uint8)), h[part == s], PROBES)
        yield pa.RecordBatch.from_pydict({"segment": pa.array(list(held), pa.int64()),
                                          "filled": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    parts = hashes.mapInArrow(fill, "segment bigint, filled binary")
    out = np.zeros((segments, size // 8), np.uint8)
    for row in parts.toLocalIterator():  # bounded: segments of MOST_BITS bits, from each task of the benchmark
        out[row.segment] |= np.frombuffer(row.filled, np.uint8)
    return out


def may_hold(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    segments = (mix(hashes) % U64(len(filled))).astype(np.int64)
    if len(filled) == 1:
        return bloom_test(filled[0], hashes, PROBES)
    size = filled.shape[1] * 8
    second = mix(hashes ^ U64(0x2545F4914F6CDD1D)) | U64(1)
    hit, alive = np.ones(len(hashes), bool), np.arange(len(hashes))
    for i in range(PROBES):
        at = (hashes[alive] + U64(i) * second[alive]) & U64(size - 1)
        ok = (filled[segments[alive], (at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1
        hit[alive[ok == 0]] = False
        alive = alive[ok == 1]
    return hit


def scanner(marks: Broadcast, wholes: Broadcast, short: list[int], window: int, gram: int):
    """Tasks over documents: one row for each document, one for each window that the filters let pass."""
    inner = window - gram

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            w = Words(*text_buffers(batch.column("text")))
            out_doc, out_start, out_len, out_key = [], [], [], []

            def emit(places: np.ndarray, length: int) -> None:
                doc = np.searchsorted(w.first, places, "right") - 1
                fits = places + length <= w.first[doc + 1]
                for p, d in zip(places[fits].tolist(), doc[fits].tolist()):
                    out_doc.append(ids[d])
                    out_start.append(p - int(w.first[d]))
                    out_len.append(length)
                    out_key.append(w.text(p, p + length))

            if len(w.hashes) >= window:
                grams = w.grams(gram)
                chosen = fingerprints(grams, inner + 1)
                hits = chosen[may_hold(marks.value, grams[chosen])]
                # extend each hit to the windows that hold it
                around = np.unique((hits[:, None] - np.arange(inner + 1)[None, :]).ravel())
                around = around[(around >= 0) & (around <= len(w.hashes) - window)]
                emit(around[may_hold(wholes.value, window_hash(w, window)[around])], window)
            for length in short:
                whole = window_hash(w, length) if len(w.hashes) >= length else np.zeros(0, np.uint64)
                emit(np.flatnonzero(may_hold(wholes.value, whole)), length)
            n = batch.num_rows
            counts = w.counts()
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(np.concatenate([ids, np.array(out_doc, ids.dtype)]), pa.int64()),
                "n_words": pa.array(np.concatenate([counts, np.zeros(len(out_doc), np.int64)]), pa.int64()),
                "start": pa.array([-1] * n + out_start, pa.int64()),
                "length": pa.array([0] * n + out_len, pa.int32()),
                "key": pa.array([f"#{i}" for i in ids.tolist()] + out_key, pa.string())})

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per doc_id: n_words, n_hit, item_ids (array of strings, sorted), spans of hit words as [start, end).

    A word is hit if any occurrence of ``window`` consecutive words of an item (all words of a shorter item) covers it.
    Null and empty texts have no words. Rows without doc_id are left out; rows that repeat a doc_id with the same text
    count once, with other texts they are one document whose hits are those of all its texts. An item without item_id
    marks words but is not listed. An empty benchmark or document table gives no hits or no rows. Further columns of
    either table are not read, whatever their names.
    """
    spark = docs.sparkSession
    benchmark = benchmark.select("item_id", "text")
    classes, windows = items_of(benchmark, window, gram)
    short = sorted(r.length for r in windows.where(F.col("length") < window).select("length").distinct().collect())
    marks = spark.sparkContext.broadcast(filter_of(
        windows.where(F.col("length") == window).select(F.explode("prints").alias("hash"))))
    wholes = spark.sparkContext.broadcast(filter_of(windows.select("hash")))
    found = docs.select("doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(
        scanner(marks, wholes, short, window, gram), "doc_id bigint, n_words bigint, start bigint, length int, key string")
    keys = windows.groupBy("key").agg(F.collect_set("class_id").alias("classes"))
    # documents' own rows carry a key of their own: no null key gathers them in one task
    rows = found.join(keys, "key", "left").where("classes IS NOT NULL OR start < 0").drop("key")
    stop = F.col("start") + F.col("length")
    past = Window.partitionBy("doc_id").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("end", stop).withColumn("before", F.coalesce(F.max("end").over(past), F.lit(-1)))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))
    per_doc = written(rows.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("start") >= 0, fresh).otherwise(0)).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.when(F.col("start") >= 0, F.struct("start", "end")))).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set("classes"))).alias("classes")), "hits")
    items = (per_doc.where("n_hit > 0").select("doc_id", F.explode("classes").alias("class_id"))
             .join(classes, "class_id").select("doc_id", F.explode("item_ids").alias("item"))
             .groupBy("doc_id").agg(F.array_sort(F.collect_set("item")).alias("item_ids")))
    return per_doc.drop("classes").join(items, "doc_id", "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "windows")
