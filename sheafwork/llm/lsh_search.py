"""Nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, so that the largest cosine is the smallest Euclidean distance. A table hashes a vector by
``k`` Gaussian (2-stable) projections cut into cells of width ``width``; ``k`` grows with the logarithm of the table. A
query visits the cells around its own in the order of their estimated success (the chance that a neighbour at the typical
distance lies in that cell) until the chances add up to ``success`` in each table. The typical distance is taken from a
bounded sample of queries. Candidates of all tables are merged and ranked by the exact cosine.

No query ends on the typical distance alone. One whose last wanted neighbour was found farther away visits the cells that this
distance, a bound of the true one, adds to its first ones. One that found too few, or only rows beyond a right angle, is compared with
all vectors.

Cells are dealt over regions, those of over ``BLOCK`` vectors in several blocks, so no task holds more than about ``REGION`` vectors at once
and no cell is capped. A query's vector goes once to each region that it visits, with the cells it visits there.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import mix, written

TABLES, WIDTH, SUCCESS, SEED = 2, 1.0, 0.9, 20_011
#: Queries of the sample that gives the typical distance, vectors of a region, vectors of a block of a large cell; most
#: large cells listed to all tasks (blocks grow until no more cells are large).
SAMPLE, REGION, BLOCK, LISTED = 64, 8192, 4096, 1 << 20
#: Distance of vectors at a right angle; distances or scores that differ by less may be equal.
RIGHT, MARGIN = math.sqrt(2), 1e-9
#: Pairs scored at a time.
PAIRS = 1 << 14
#: Slots considered on either side of a query's own in one projection.
REACH = 6


def vectors_of(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of unit vectors. ``unit`` divides by the largest component first, so exact multiples of a vector give the same bits."""
    return np.einsum("ij,ij->i", a, b)


def projections(table: int, dims: int, k: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, table])
    return rng.normal(size=(dims, k)), rng.uniform(0, width, k)


def cell_of(table: int, slots: np.ndarray) -> np.ndarray:
    """64-bit number of each row of slots."""
    total = np.full(len(slots), np.uint64(table + 1), np.uint64)
    for j in range(slots.shape[1]):
        total = (total ^ slots[:, j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


def visited(place: np.ndarray, spread: float, success: float) -> np.ndarray:
    """Slots visited from a point in a table's scaled projections: by falling chance, until they add up to ``success``."""
    own = np.floor(place).astype(np.int64)
    near, chance = [], []
    for x, h in zip(place, own):
        slots = np.arange(h - REACH, h + REACH + 1)
        edges = [math.erf((s - x) / (spread * math.sqrt(2))) / 2 for s in [*slots, slots[-1] + 1]]
        p = np.maximum(np.diff(edges), 1e-300)
        order = np.argsort(-p, kind="stable")
        near.append(slots[order].tolist())
        chance.append(np.log(p[order]).tolist())
    k = len(place)
    heap = [(-sum(c[0] for c in chance), (0,) * k, 0)]
    out, total = [], 0.0
    while heap and total < success:
        cost, ranks, last = heapq.heappop(heap)
        out.append([near[j][r] for j, r in enumerate(ranks)])
        total += math.exp(-cost)
        for j in range(last, k):  # each set of ranks is reached once
            if ranks[j] + 1 < len(near[j]):
                heapq.heappush(heap, (cost + chance[j][ranks[j]] - chance[j][ranks[j] + 1],
                                      (*ranks[:j], ranks[j] + 1, *ranks[j + 1:]), j))
    return np.array(out, np.int64)


def distinct_vectors(vectors: DataFrame, copies: int) -> DataFrame:
    """(cls, v, ids): each different vector once, with its ``copies`` smallest ids, first the one that names it.

    All copies have the same score, and ties go to the smaller id, so no more ids can be in a result.
    """
    row = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    return vectors.withColumn("r", row).where(F.col("r") <= copies).groupBy("v").agg(
        F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("cls"), "v", "ids")


def valid(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vector_column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(id_column).alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return rows.where(F.size("v") == (sizes.n if sizes else 0))


def typical_distance(reps: DataFrame, queries: DataFrame, nearest: int, sample: int) -> float:
    """Upper quartile of the distance of the last wanted neighbour, of at most ``sample`` queries against all vectors."""
    rows = queries.orderBy(F.xxhash64("cls"), "cls").select("v").limit(sample).collect()
    if not rows:
        return 1.0
    q = unit(np.array([r.v for r in rows], np.float64))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((len(q), 0))
        for batch in batches:
            if batch.num_rows:
                top = np.concatenate([top, q @ unit(vectors_of(batch.column("v"))).T], axis=1)
                top = -np.sort(-top, axis=1)[:, :nearest + 1]
        n, m = top.shape
        yield pa.RecordBatch.from_pydict({"q": pa.array(np.repeat(np.arange(n), m), pa.int64()), "s": pa.array(top.ravel(), pa.float64())})

    found = reps.select("v").mapInArrow(best, "q bigint, s double")
    row = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))
    last = found.withColumn("r", row).where(F.col("r") <= nearest + 1).groupBy("q").agg(F.min("s").alias("s"))
    value = last.agg(F.percentile("s", 0.25)).first()[0]
    return math.sqrt(max(2 - 2 * value, 1e-6))


def index_rows(k: int, width: float, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(vectors_of(batch.column("v")))
            for t in range(tables):
                a, b = projections(t, x.shape[1], k, width, seed)
                cells = cell_of(t, np.floor((x @ a + b) / width))
                yield pa.RecordBatch.from_arrays([pa.array(cells), batch.column("cls"), batch.column("v")], names=["cell", "cls", "v"])

    return run


def regions_of(cells: np.ndarray, blocks: np.ndarray, regions: int) -> np.ndarray:
    return (mix(cells.view(np.uint64) ^ mix(blocks.astype(np.uint64))) % np.uint64(regions)).astype(np.int64)


def block_counts(cells: np.ndarray, large: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Blocks of each cell: 1 but for the large ones (sorted cells, their blocks)."""
    out = np.ones(len(cells), np.int64)
    if len(large[0]):
        at = np.minimum(np.searchsorted(large[0], cells), len(large[0]) - 1)
        found = large[0][at] == cells
        out[found] = large[1][at[found]]
    return out


DEALT = ("region", "kind", "cls", "v", "cells")


def dealt_vectors(large: Broadcast, regions: int):
    """Rows of the index with their region; a vector of a large cell is in one of its blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cells, ids = batch.column("cell").to_numpy(), batch.column("cls").to_numpy()
            blocks = mix(ids.view(np.uint64)) % block_counts(cells, large.value).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(regions_of(cells, blocks, regions)), pa.array(np.zeros(n, np.int32)), batch.column("cls"), batch.column("v"),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), batch.column("cell"))], names=DEALT)

    return run


def dealt_queries(large: Broadcast, regions: int, k: int, width: float, tables: int, seed: int, success: float):
    """A row for each query and region that holds a block of a cell it visits, with these cells.

    A query visits the cells of its distance ``far`` but for those of ``near``, which it has visited before (0: none).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(vectors_of(batch.column("v")))
            tables_ = [projections(t, x.shape[1], k, width, seed) for t in range(tables)]
            spreads = zip(batch.column("near").to_pylist(), batch.column("far").to_pylist())
            for i, (v, (near, far)) in enumerate(zip(x, spreads)):
                places = [(v @ a + b) / width for a, b in tables_]
                cells = np.concatenate([cell_of(t, visited(p, far / width, success)) for t, p in enumerate(places)])
                if near:
                    before = np.concatenate([cell_of(t, visited(p, near / width, success)) for t, p in enumerate(places)])
                    cells = np.setdiff1d(cells, before)
                counts = block_counts(cells, large.value)
                cells = np.repeat(cells, counts)
                blocks = np.arange(len(cells)) - np.repeat(np.cumsum(counts) - counts, counts)
                own = regions_of(cells, blocks, regions)
                order = np.argsort(own, kind="stable")
                names, first = np.unique(own[order], return_index=True)
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(np.ones(n, np.int32)), pa.array(np.full(n, batch.column("cls")[i].as_py(), np.int64)),
                     batch.column("v").take(pa.array(np.full(n, i))),
                     pa.ListArray.from_arrays(pa.array([*first, len(cells)], pa.int32()), pa.array(cells[order]))], names=DEALT)

    return run


def rank(keep: int):
    """Rows of a region: its vectors first (kind 0), then the queries (kind 1) with the cells they visit; the best of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, ids, cells, x, held = None, None, None, None, []
        for batch in batches:
            regions = batch.column("region").to_numpy()
            kinds = batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(regions) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                if a == b:
                    continue
                if regions[a] != region:
                    region, held, x = regions[a], [], None
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if x is None and held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    ids = whole.column("cls").to_numpy()
                    cells = pa.concat_arrays(whole.column("cells").chunks).flatten().to_numpy()
                    x = unit(vectors_of(pa.concat_arrays(whole.column("v").chunks)))
                    held = []
                if x is not None:
                    yield best_of(part, ids, cells, x, keep)

    return run


def best_of(part: pa.RecordBatch, ids: np.ndarray, cells: np.ndarray, x: np.ndarray, keep: int) -> pa.RecordBatch:
    out = []
    names, place = np.unique(cells, return_inverse=True)
    step = max(1, (1 << 21) // max(len(x), 1))
    for a in range(0, part.num_rows, step):
        piece = part.slice(a, step)
        allowed = np.zeros((piece.num_rows, len(names)), bool)
        for i, own in enumerate(piece.column("cells").to_pylist()):
            at = np.searchsorted(names, own)
            at = at[at < len(names)]
            allowed[i, at[np.isin(names[at], own)]] = True
        asked = unit(vectors_of(piece.column("v")))
        scores = np.where(allowed[:, place], asked @ x.T, -np.inf)
        # the product differs in its last bits with its shape: what lies near the last place is scored pair by pair before the cut
        if len(x) > keep:
            least = np.partition(scores, len(x) - keep, axis=1)[:, len(x) - keep, None]
            scores[scores < least - MARGIN] = -np.inf
        i, j = np.nonzero(np.isfinite(scores))
        s = np.concatenate([np.zeros(0), *[cosines(asked[i[k:k + PAIRS]], x[j[k:k + PAIRS]]) for k in range(0, len(i), PAIRS)]])
        order = np.lexsort((ids[j], -s, i))
        order = order[np.arange(len(i)) - np.searchsorted(i, i) < keep]  # i is sorted before and after
        out.append((piece.column("cls").to_numpy()[i[order]], ids[j[order]], s[order]))
    q, c, s = (np.concatenate(x) for x in zip(*out))
    return pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int64()), "c": pa.array(c, pa.int64()), "s": pa.array(s, pa.float64())})


def to_all(blocks: int):
    """A row for each query and block of vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(blocks)), pa.array(np.ones(blocks, np.int32)), *[batch.column(c).take(pa.array(np.full(blocks, i)))
                     for c in ("cls", "v")], pa.array([[0]] * blocks, pa.list_(pa.int64()))], names=DEALT)

    return run


def against_all(reps: DataFrame, queries: DataFrame, n: int, keep: int, schema: str) -> DataFrame:
    """(q, c, s): the best of all vectors, in blocks of about ``REGION``, for each of the queries."""
    blocks = max(1, -(-n // REGION))
    kept = reps.select(F.pmod(F.xxhash64("cls", "v"), F.lit(blocks)).alias("region"), F.lit(0).alias("kind"), "cls", "v",
                       F.array(F.lit(0).cast("bigint")).alias("cells"))
    asking = queries.select("cls", "v").mapInArrow(to_all(blocks), schema)
    dealt = kept.unionByName(asking).repartition("region").sortWithinPartitions("region", "kind")
    return dealt.mapInArrow(rank(keep), "q bigint, c bigint, s double")


def best(found: DataFrame, keep: int) -> DataFrame:
    """(q, c, s): the ``keep`` best candidates of each query, each once."""
    order = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "c"))
    return found.groupBy("q", "c").agg(F.max("s").alias("s")).withColumn("r", order).where(F.col("r") <= keep).select("q", "c", "s")


def distances(named: DataFrame, top: DataFrame, reps: DataFrame, nearest: int) -> DataFrame:
    """(cls, n, d): rows found for each query, ``nearest`` at most, and the distance of the last; of ids with one vector the worst."""
    ids = top.join(reps.select(F.col("cls").alias("c"), "ids"), "c").select(F.col("q").alias("cls"), "s", F.explode("ids").alias("id"))
    rows = named.join(ids, "cls").where("id <> vec_id")
    place = F.row_number().over(Window.partitionBy("cls", "vec_id").orderBy(F.desc("s")))
    last = rows.withColumn("r", place).where(F.col("r") <= nearest).groupBy("cls", "vec_id").agg(F.count("*").alias("n"), F.min("s").alias("s"))
    return named.join(last, ["cls", "vec_id"], "left").groupBy("cls").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("n"), F.sqrt(F.greatest(2 - 2 * F.min("s"), F.lit(0.0))).alias("d"))


def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines of pairs in double precision."""
    for batch in batches:
        if not batch.num_rows:
            continue
        score = cosines(unit(vectors_of(batch.column("v"))), unit(vectors_of(batch.column("w"))))
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("ids"), pa.array(score)], names=["q", "ids", "score"])


def search(table: DataFrame, every: int, nearest: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
           tables: int = TABLES, width: float = WIDTH, success: float = SUCCESS, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``nearest`` rows found for each row whose id is divisible by ``every``.

    Every other row is a candidate; nearest first, ties to the smaller id; all candidates found, if fewer. Rows without
    id, and vectors that are null, zero, hold a null or non-finite component, or are not as long as most, take no part.
    A repeated id counts once for each different vector. Further columns are not read.
    """
    vectors = valid(table, id_column, vector_column).distinct()
    reps = written(distinct_vectors(vectors, nearest + 1), "vectors")
    n = reps.count()
    if not n:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = vectors.where(F.col("vec_id") % every == 0)
    named = written(asked.join(reps.select("cls", "v"), "v").select("cls", "vec_id"), "queries")
    queries = reps.join(named.select("cls").distinct(), "cls", "left_semi")
    k = max(2, round(0.3 * math.log2(n)))
    spread = typical_distance(reps, queries, nearest, SAMPLE)
    regions = max(1, -(-n * tables // REGION))
    index = written(reps.select("cls", "v").mapInArrow(
        index_rows(k, width, tables, seed), f"cell bigint, cls bigint, v {dict(reps.dtypes)['v']}"), "index")
    block = BLOCK
    sizes = written(index.groupBy("cell").count(), "cells")
    while sizes.where(F.col("count") > block).count() > LISTED:
        block *= 2
    found = sorted((r.cell, -(-r["count"] // block)) for r in sizes.where(F.col("count") > block).collect())  # LISTED at most
    large = table.sparkSession.sparkContext.broadcast((np.array([c for c, _ in found], np.int64), np.array([n for _, n in found], np.int64)))
    schema = f"region bigint, kind int, cls bigint, v {dict(reps.dtypes)['v']}, cells array<bigint>"
    kept = index.mapInArrow(dealt_vectors(large, regions), schema)
    keep = nearest + 3

    def probed(asking: DataFrame) -> DataFrame:
        asking = asking.select("cls", "v", "near", "far").repartition("cls").mapInArrow(
            dealt_queries(large, regions, k, width, tables, seed, success), schema)
        dealt = kept.unionByName(asking).repartition("region").sortWithinPartitions("region", "kind")
        # a region may hold a vector once for each table
        return dealt.mapInArrow(rank(keep * tables), "q bigint, c bigint, s double")

    top = written(best(probed(queries.withColumns({"near": F.lit(0.0), "far": F.lit(spread)})), keep), "top")
    reached = written(distances(named, top, reps, nearest), "distances")
    short = (F.col("n") < nearest) | (F.col("d") > RIGHT)
    wide = ~short & (F.col("d") > spread + MARGIN)
    n_short, n_wide = reached.agg(F.count_if(short), F.count_if(wide)).first()
    again = []
    if n_wide:
        again.append(probed(queries.join(reached.where(wide), "cls").withColumns({"near": F.lit(spread), "far": F.col("d")})))
    if n_short:
        again.append(against_all(reps, queries.join(reached.where(short).select("cls"), "cls"), n, keep, schema))
    if again:
        top = written(best(reduce(DataFrame.unionByName, again, top), keep), "top")
    top = top.select("q", "c")
    pairs = top.join(reps.select(F.col("cls").alias("c"), F.col("v").alias("w"), "ids"), "c").join(
        reps.select(F.col("cls").alias("q"), "v"), "q")
    scored = written(pairs.select("q", "ids", "v", "w").mapInArrow(exact, "q bigint, ids array<bigint>, score double"), "scores")
    rows = named.withColumnRenamed("vec_id", "query_id").join(scored, F.col("cls") == F.col("q")).select(
        "query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place.cast("int")).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
