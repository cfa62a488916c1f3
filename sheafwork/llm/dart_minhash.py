"""Near-duplicate documents by DartMinHash over weighted word shingles.

A text's elements are its 5-word shingles, weighted by their counts (a text of fewer words is one shingle). Each unit of
an element's weight is a region with a fixed random sequence of darts: ranks grow by hashed exponential gaps and every
dart falls on a hashed coordinate. Darts of rank below a bound that shrinks with the total weight are thrown, and the
earliest on each coordinate is kept, so two texts agree on a coordinate with the probability of their weighted Jaccard
similarity. Bands of coordinates are joined; candidates are compared exactly on all shingle counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import U64, Words, mix, pieces, text_buffers, unbounded, written

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at the least similarity shares no band with probability (1 - 0.8 ** 7) ** 40, under 1 in 10,000.
BANDS, ROWS = 40, 7
#: Members compared with one centre in one group, members of one block of a bucket, elements compared at a time.
GROUP, BLOCK, WIDE = 64, 512, 4096


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, and the number of each text's."""
    counts = words.counts()
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    grams = words.grams(size)
    first = words.first[:-1]
    text = np.repeat(np.arange(len(counts)), number)
    place = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    out = np.zeros(len(text), np.uint64)
    whole = counts[text] >= size
    out[whole] = grams[place[whole]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        total = np.array([counts[i]], np.uint64)
        for j in range(first[i], first[i] + counts[i]):
            total = mix(total * U64(0x100000001B3) + words.hashes[j:j + 1])
        out[np.searchsorted(text, i)] = total[0]
    return out, number


def regions(elements: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One key for each unit of weight (the n-th occurrence of an element in a text), and the texts they are of."""
    text = np.repeat(np.arange(len(number)), number)
    own = mix(elements + mix(text.astype(np.uint64)))
    order = np.argsort(own)
    own, e, t = own[order], elements[order], text[order]
    new = np.ones(len(e), bool)
    new[1:] = own[1:] != own[:-1]
    unit = np.arange(len(e)) - np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
    return mix(e + unit.astype(np.uint64) * U64(0x9E3779B97F4A7C15)), t


def signatures(elements: np.ndarray, number: np.ndarray, size: int) -> np.ndarray:
    """Earliest dart on each of ``size`` coordinates for every text (texts x size); 0 rows for texts without elements."""
    region, t = regions(elements, number)
    best = np.zeros((len(number), size), np.uint64)
    todo = number > 0
    bound = size * (np.log(size) + 2.0)
    while todo.any():
        chosen = todo[t]
        key, doc = region[chosen], t[chosen]
        limit = bound / number[doc]
        rank, step = np.zeros(len(key)), 0
        docs, spots, ranks, darts = [], [], [], []
        while len(key):
            step += 1
            h = mix(key ^ mix(np.array([step], np.uint64)))
            part = ((h >> U64(11)).astype(np.float64) + 1.0) * 2.0 ** -53
            near = part >= np.exp(rank - limit)  # rank - log(part) <= limit
            key, doc, limit, h = key[near], doc[near], limit[near], h[near]
            rank = rank[near] - np.log(part[near])
            dart = mix(h + U64(0x632BE59BD9B4E019))
            docs.append(doc)
            spots.append((dart % U64(size)).astype(np.int64))
            ranks.append(rank)
            darts.append(dart)
        place = np.concatenate(docs) * size + np.concatenate(spots)
        ranks, darts = np.concatenate(ranks), np.concatenate(darts)
        least = np.full(len(number) * size, np.inf)
        np.minimum.at(least, place, ranks)
        first = ranks == least[place]
        flat = best.reshape(-1)
        flat[place[first]] = 0
        np.maximum.at(flat, place[first], darts[first])  # equal ranks: the larger dart
        covered = np.isfinite(least.reshape(len(number), size)).all(axis=1)
        todo &= ~covered  # a coordinate without dart: throw again, further
        bound *= 2
    return best


def band_hashes(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.zeros((len(best), bands), np.uint64)
    for j in range(rows):
        total = mix(total + best[:, j::rows][:, :bands])
    return total


def sketch(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            w = Words(*text_buffers(batch.column("text")))
            counts = w.counts()
            elements, number = shingles(w, shingle)
            hashes = band_hashes(signatures(elements, number, bands * rows), bands, rows).view(np.int64)
            # texts without words are no copies of each other
            same = [xxhash.xxh3_128_digest(w.hashes[a:b].tobytes() if b > a else f"none {i}".encode())
                    for i, a, b in zip(batch.column("doc_id").to_pylist(), w.first[:-1], w.first[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(same, pa.binary()), pa.array(counts, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * bands, pa.int32()), pa.array(hashes.ravel()))],
                names=["doc_id", "same", "n_words", "bands"])

    return run


def weights(texts: pa.Array, shingle: int) -> list[tuple[np.ndarray, np.ndarray]]:
    elements, number = shingles(Words(*text_buffers(texts)), shingle)
    stops = np.cumsum(number)
    return [np.unique(elements[b - n:b], return_counts=True) for b, n in zip(stops, number)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: sum of the smaller counts over sum of the larger ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    return least / (int(a[1].sum()) + int(b[1].sum()) - least)


def linked(texts: pa.Array, ids: np.ndarray, classes: np.ndarray, side: np.ndarray, shingle: int, least: float) -> list[tuple]:
    """Links that join the classes of two blocks (or of one, if there is no side 1): every pair of different classes is
    compared; of the links between two classes one goes out."""
    elements, number = shingles(Words(*text_buffers(texts)), shingle)
    keys, owner = regions(elements, number)
    _, place, times = np.unique(keys, return_inverse=True, return_counts=True)
    shared = times[place] > 1  # an element of one text is in no pair
    _, column = np.unique(place[shared], return_inverse=True)
    owner = owner[shared]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    common = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column)
    column, owner = column[order], owner[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, WIDE):
        part = slice(*np.searchsorted(column, [a, a + WIDE]))
        held = np.zeros((len(ids), min(WIDE, int(column[-1]) + 1 - a)), np.float32)
        held[owner[part], column[part] - a] = 1
        common += held[left] @ held[right].T
    total = number[left][:, None] + number[right][None, :] - common
    close = common >= least * total
    out, classes = [], classes.copy()
    for i, r in enumerate(left):
        found = right[close[i] & (classes[right] != classes[r])]
        new, first = np.unique(classes[found], return_index=True)
        if len(new):
            out += [(min(ids[r], ids[c]), max(ids[r], ids[c])) for c in found[first]]
            classes[np.isin(classes, new)] = classes[r]
    return out


def within_blocks(shingle: int, least: float):
    """Rows (band, hash, i, j, side, doc_id, class_id, text), sorted by the first four -> links of each pair of blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def of(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(rows)
            out = linked(pa.concat_arrays(whole.column("text").chunks),
                         *(whole.column(c).to_numpy() for c in ("doc_id", "class_id", "side")), shingle, least)
            return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in out], pa.int64()),
                                               "b": pa.array([p[1] for p in out], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("band", "hash", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(keys[a])
                if key != group and held:
                    yield of(held)
                    held = []
                group = key
                held.append(batch.slice(a, b - a))
        if held:
            yield of(held)

    return run


def compare(shingle: int, least: float):
    """Rows come sorted by (centre, salt) with the centre's own text first; linked pairs go out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, centre = None, None
        for batch in pieces(batches):
            keys = list(zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist()))
            members = batch.column("b").to_pylist()
            rows = []
            for key, b, w in zip(keys, members, weights(batch.column("text"), shingle)):
                if key != group:
                    group, centre = key, None
                if b == key[0]:
                    centre = w
                elif centre is not None and similarity(centre, w) >= least:
                    rows.append((key[0], b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([r[0] for r in rows], pa.int64()),
                                              "b": pa.array([r[1] for r in rows], pa.int64())})

    return run


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, least: float) -> DataFrame:
    """Pairs (a, b) whose texts are similar. A centre's text goes to each block of its members, so that no task gets more."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("blocks"))
    dealt = written(pairs.join(blocks, "a").select("a", "b", F.expr("pmod(xxhash64(b), blocks)").alias("salt")), "pairs")
    centres = dealt.select("a", F.col("a").alias("b"), "salt").distinct()
    rows = unbounded(dealt.unionByName(centres)).join(docs.withColumnRenamed("doc_id", "b"), "b")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("a") != F.col("b"))
    return rows.select("a", "salt", "b", "text").mapInArrow(compare(shingle, least), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, class_id): the smallest id of each connected component, by alternating large-star and small-star steps."""
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours go to the smallest one
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a <> b")
        # small star: smaller neighbours, and the node itself, go to the smallest one
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        edges = written(small.where("a <> b").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("class_id"))
        before = state


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """One row per doc_id: n_words, class_id (smallest doc_id of its class).

    A class is a connected component of documents linked by the same words or by a weighted Jaccard similarity of at
    least ``least``. Null and empty texts, and texts without words, are classes of their own. Rows without doc_id are
    left out; rows that repeat a doc_id
    are one document, in the smallest class that its texts have. Further columns are not read.

    Copies are collapsed first. In every bucket a centre, drawn by hash, is compared with all members. Buckets that then
    still hold members of two classes are cut into blocks, and each pair of blocks is compared in one task, all pairs of
    different classes at once; only links that join classes leave it. So no pair that shares a bucket is left out, and
    no pairs are emitted. A bucket of n different texts that are not alike costs n * n / 2 comparisons there.
    """
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    drawn = written(docs.mapInArrow(sketch(shingle, bands, rows),
                                    "doc_id bigint, same binary, n_words bigint, bands array<bigint>"), "darts")
    groups = drawn.where("n_words > 0").groupBy("same").agg(F.min(F.struct("doc_id", "n_words", "bands")).alias("rep"))
    groups = groups.select("same", "rep.*")
    key = ["band", "hash"]
    members = groups.select("doc_id", "n_words", F.posexplode("bands").alias(*key))
    centres = members.groupBy(*key).agg(F.min(F.struct(F.xxhash64("doc_id", "band"), "doc_id", "n_words")).alias("c"),
                                        F.count("*").alias("n")).where("n > 1")
    centres = centres.select(*key, "n", F.col("c.doc_id").alias("centre"), F.col("c.n_words").alias("n_c"))
    members = written(members.join(centres, key), "buckets")
    held_docs = written(docs.join(unbounded(members.select("doc_id").distinct()), "doc_id", "left_semi"), "candidate-texts")
    # shingles shared are at most those of the shorter text
    n_a, n_b = (F.greatest(F.col(c) - (shingle - 1), F.lit(1)) for c in ("n_c", "n_words"))
    stars = members.where((F.col("doc_id") != F.col("centre")) & (F.least(n_a, n_b) >= least * F.greatest(n_a, n_b))).select(
        F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    edges = written(verified(written(stars, "candidates"), held_docs, shingle, least), "links")
    labels = components(edges)

    held = members.where("n > 2").join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
        "class_id", F.coalesce("class_id", "doc_id"))  # in a bucket of two the star has done all
    mixed = held.groupBy(*key).agg(F.min("class_id").alias("c1"), F.max("class_id").alias("c2")).where("c1 <> c2")
    held = held.join(written(mixed.select(*key), "mixed"), key)
    blocks = F.ceil(F.col("n") / BLOCK)
    held = held.select(*key, "doc_id", "class_id", blocks.alias("blocks"), F.pmod(F.xxhash64("doc_id", "band"), blocks).alias("own"))
    # a member meets each block of its bucket: in pairs of blocks (i, j) with i <= j
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select(
        *key, "doc_id", "class_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"))
    dealt = unbounded(held).join(held_docs, "doc_id").repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")
    more = written(dealt.mapInArrow(within_blocks(shingle, least), "a bigint, b bigint"), "more-links")
    labels = components(edges.unionByName(more))

    reps = groups.select("same", F.col("doc_id").alias("id")).join(labels, "id", "left")
    found = drawn.select("doc_id", "n_words", "same").join(
        reps.select("same", F.coalesce("class_id", "id").alias("class_id")), "same", "left")
    return found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.min(
        F.coalesce("class_id", "doc_id")).alias("class_id"))


def wordless_copies(docs: DataFrame) -> DataFrame:
    """doc_id of documents without words whose whole text a document of smaller doc_id has too; null is an empty text.

    near_duplicates() compares words, so these are classes of their own there. Rows without doc_id take no part.
    """
    bare = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(
        F.col("doc_id").isNotNull() & ~F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    first = written(bare.groupBy("text").agg(F.min("doc_id").alias("first")), "wordless")
    return bare.join(first, "text").where("doc_id > first").select("doc_id").distinct()
