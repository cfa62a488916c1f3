"""Spelling variants: words that differ by one code point, found by a bit-sliced position index.

Words that are one edit apart share their first half or their last half, halves being taken of the shorter length. So each
word joins a bin for its first and one for its last half, and once more as the longer partner. Spark deals the bins out; a
bin of many words is dealt in blocks, each pair of which is a group of its own. In a task, the words of a group are the
columns of bit sets, one for each (position, letter). A query's letters AND these sets: the zero-error set goes on where
letters agree, and the one-error sets leave it by a replaced letter, or go on with positions shifted by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import unbounded, written
from sheafwork.llm.quality_rules import LOWER, UPPER

#: Words of a block, and about the columns of an index built at once.
BLOCK = 2048
#: Letters of the words that are matched at once (one group at least).
LETTERS = 1 << 20
#: Bin rows of a task.
TASK_ROWS = 1 << 16
GROUP = ("m", "side", "half", "low", "high")
FOUND = "word string, n_near bigint, best struct<less: bigint, word: string>"


def vocabulary(docs: DataFrame, shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """Words of all texts with their number ``n``: runs of letters up to U+00FF, A-Z lower-cased, of which one in ``every``
    (by crc32 of doc_id and run) loses a letter."""
    text = F.translate("text", UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(text, F.lit(r"[a-zÀ-ÿ]+"), F.lit(0))).alias("run")).where(F.length("run") >= shortest)
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    place = (h % F.length("run")).cast("int")
    word = F.when(h % every == 0, F.concat(
        F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(
        F.count("*").alias("n")).where(F.col("n") >= least)


def dealt(vocab: DataFrame, block: int) -> DataFrame:
    """word, n and the group of each of a word's bins; words of large bins stand in a group for each other block."""
    long = F.length("word")

    def bins(m):
        head = F.floor(m / 2).cast("int")
        return [F.struct(m.alias("m"), F.lit(side).alias("side"), half.alias("half")) for side, half in (
            ("p", F.substring("word", F.lit(1), head)), ("s", F.substring("word", long - (m - head) + 1, m - head)))]

    keyed = vocab.select("word", "n", F.inline(F.array(*bins(long), *bins(long - 1))))
    sizes = keyed.groupBy("m", "side", "half").agg(F.count("*").alias("size"), F.count_if(F.length("word") == F.col("m")).alias("short"))
    blocks = sizes.where("size > 1 AND short > 0").select("m", "side", "half", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    return unbounded(keyed).join(unbounded(blocks), ["m", "side", "half"]).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "word", "n", "own", "m", "side", "half", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def packed(on: np.ndarray) -> np.ndarray:
    """Rows of booleans (columns a multiple of 64) as 64-bit words, first column in the lowest bit."""
    return np.packbits(on, axis=1, bitorder="little").view("<u8")


class PositionIndex:
    """Bit sets of (position, letter) over the words of one run, given as a matrix of letters padded by zeros."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray):
        count, width = letters.shape
        columns = -(-count // 64) * 64
        alphabet, codes = np.unique(letters, return_inverse=True)
        self.codes, size = codes.reshape(letters.shape), len(alphabet)
        inside = np.arange(width)[None, :] < lengths[:, None]
        row, place = np.nonzero(inside)
        pair = place * size + self.codes[row, place]
        found, of = np.unique(pair, return_inverse=True)
        on = np.zeros((len(found) + 1, columns), bool)  # the last row: no word has this letter there
        on[of, row] = True
        self.sets = packed(on)
        self.slots = np.full((width + 1) * size, len(found))
        self.slots[found] = np.arange(len(found))
        self.size = size
        self.lengths = {int(n): packed(np.pad(lengths == n, (0, columns - count))[None, :])[0] for n in np.unique(lengths)}
        self.all = packed(np.pad(np.ones(count, bool), (0, columns - count))[None, :])[0]
        self.none = np.zeros_like(self.all)

    def at(self, place: int, codes: np.ndarray) -> np.ndarray:
        """For each query letter, the words that have it at this position."""
        return self.sets[self.slots[place * self.size + codes]]

    def near(self, rows: np.ndarray, length: int, half: int, longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """For the words ``rows`` of one length: bit sets of words one edit away, and of those that start with their first
        ``half`` letters. Of other lengths only the next longer (or, if not ``longer``, only the next shorter) is looked at."""
        exact = np.tile(self.all, (len(rows), 1))
        replaced, shifted, start = np.zeros_like(exact), np.zeros_like(exact), exact
        for i in range(length):
            codes = self.codes[rows, i]
            here = self.at(i, codes)
            if longer:
                shifted = (shifted | exact) & self.at(i + 1, codes)  # an extra letter before this one
                replaced = (replaced & here) | (exact & ~here)
            else:
                shifted = (shifted & self.at(i - 1, codes) if i else shifted) | exact  # this letter is missing
            exact = exact & here
            if i == half - 1:
                start = exact
        if longer:
            return (replaced & self.lengths.get(length, self.none)) | ((shifted | exact) & self.lengths.get(length + 1, self.none)), start
        return shifted & self.lengths.get(length - 1, self.none), start


def matched(words: list[str], n: np.ndarray, m: int, last: np.ndarray, sets: np.ndarray, targets: np.ndarray) -> pa.RecordBatch:
    """Near words of the words of one run, each looked for in the set ``targets``; ``last`` marks rows of last halves."""
    raw = np.array([w.encode("latin-1") for w in words])
    order = np.lexsort((raw, -n))  # most frequent first, then by code points: the first bit found is the form
    raw, n, last, sets, targets = raw[order], n[order], last[order], sets[order], targets[order]
    lengths = np.char.str_len(raw)
    letters = np.zeros((len(raw), m + 1), np.uint8)
    letters[:, :raw.itemsize] = raw.view(np.uint8).reshape(len(raw), -1)
    index = PositionIndex(letters, lengths)
    member = np.zeros((int(max(sets.max(), targets.max())) + 1, len(index.all) * 64), bool)
    member[sets, np.arange(len(raw))] = True
    member = packed(member)
    parts = []
    for length, longer in ((m, True), (m + 1, False)):
        rows = np.flatnonzero(lengths == length)
        if not len(rows):
            continue
        hits, start = index.near(rows, length, m // 2, longer)
        hits &= member[targets[rows]]
        hits[last[rows]] &= ~start[last[rows]]  # the bin of the first halves has these
        some = np.flatnonzero(hits.any(axis=1))
        if len(some):
            hits, rows = hits[some], rows[some]
            first = (hits != 0).argmax(axis=1)
            word = hits[np.arange(len(rows)), first]
            best = first * 64 + np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1))
            parts.append((rows, np.bitwise_count(hits).sum(axis=1, dtype=np.int64), best))
    rows, near, best = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*parts) if parts else ((), (), ())))
    text = np.array(words, object)[order]
    return pa.RecordBatch.from_arrays([
        pa.array(text[rows], pa.string()), pa.array(near, pa.int64()),
        pa.StructArray.from_arrays([pa.array(-n[best], pa.int64()), pa.array(text[best], pa.string())], names=["less", "word"])],
        names=["word", "n_near", "best"])


def match_groups(block: int):
    """Rows in order of their groups -> for each word and group, the number of near words and the most frequent one."""
    def matched_groups(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``starts``: first rows of the groups, and the number of rows."""
        m = rows.column("m").to_numpy()
        first = 0
        while first < len(starts) - 1:
            longest = int(m[starts[first]])
            most = starts[first] + min(block, max(1, LETTERS // (longest + 1)))
            stop = int(np.searchsorted(starts, most, "right")) - 1
            stop = max(first + 1, min(stop, int(np.searchsorted(m[starts[:-1]], longest, "right"))))  # one m a run
            part = rows.slice(starts[first], starts[stop] - starts[first])
            group = np.repeat(np.arange(stop - first), np.diff(starts[first:stop + 1]))
            own, low, high = (part.column(c).to_numpy() for c in ("own", "low", "high"))
            upper = (own == high) & (low != high)
            yield matched(part.column("word").to_pylist(), part.column("n").to_numpy(), longest,
                          pc.equal(part.column("side"), "s").to_numpy(zero_copy_only=False),
                          2 * group + upper, 2 * group + np.where(low == high, upper, ~upper))
            first = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 4 * block:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            starts = group_starts(rows)
            if len(starts) > 2:  # the last group may go on in the next batch
                yield from matched_groups(rows, starts[:-1])
                held = rows.slice(starts[-2]).to_batches()
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from matched_groups(rows, group_starts(rows))

    return run


def group_starts(rows: pa.Table) -> np.ndarray:
    new = np.zeros(max(rows.num_rows - 1, 0), bool)
    for name in GROUP:
        column = rows.column(name)
        new |= pc.not_equal(column.slice(1), column.slice(0, rows.num_rows - 1)).to_numpy()
    return np.concatenate([[0], np.flatnonzero(new) + 1, [rows.num_rows]])


def near_words(vocab: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, n_near and best (less: minus the largest n of a near word, and that word; null if there is none)."""
    spark = vocab.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * vocab.count() // TASK_ROWS)
    found = dealt(vocab, block).repartition(tasks, *GROUP).sortWithinPartitions(*GROUP).mapInArrow(match_groups(block), FOUND)
    alone = vocab.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("struct<less: bigint, word: string>").alias("best"))
    return alone.unionByName(found, allowMissingColumns=True).groupBy("word").agg(
        F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word and the last form that its chain of forms leads to. Each round doubles the steps taken; counts grow at each
    link, so chains end."""
    reached = links.select("word", F.col("form").alias("root"))
    while True:
        on = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = written(reached.join(unbounded(on), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")
        reached = reached.select("word", "root")


def group_variants(docs: DataFrame, shortest: int = 7, least: int = 2, factor: int = 10, every: int = 31, block: int = BLOCK) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n, for words of ``shortest`` letters that occur ``least`` times.

    A word's form is its most frequent near word (ties: the first by code points), if that occurs ``factor`` times as often.
    Null and empty texts have no words; rows that repeat a document count again; rows without doc_id hash as an empty
    number. Very long runs of letters are words like others, and take one step of the index a letter. Other columns are not
    read, whatever their names; an empty table gives no rows.
    """
    if shortest < 4 or factor < 2:
        raise ValueError("halves need words of four letters, and forms a factor of two")
    vocab = written(vocabulary(docs.select("doc_id", "text"), shortest, least, every), "vocabulary")
    is_form = -F.col("best.less") >= factor * F.col("n")
    found = written(near_words(vocab, block).select(
        "word", F.when(is_form, F.col("best.word")).alias("form"), "n", "n_near", F.when(is_form, -F.col("best.less")).alias("form_n")), "near-words")
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(unbounded(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
