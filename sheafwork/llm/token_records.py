"""Token ids as length-delimited binary records with an offset index.

Record: length of the data (8 bytes, little-endian), masked CRC-32C of these bytes (4), data, masked CRC-32C of the data
(4). Data: doc_id (8 bytes, signed; the smallest value stands for none), bytes of an id (1), then the ids, little-endian.
Index, one entry of four signed 8-byte numbers for each record: doc_id, offset and size of the record, and the ids that
stand before it in its shard. Shards are ordered by doc_id; the manifest lists those that finished, so that files of lost
or repeated tasks are never read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from sheafwork.llm.bpe_automaton import WORDS, byte_characters
from sheafwork.llm.common import pieces, text_buffers

NO_ID = -(1 << 63)
HEAD, MASK, BLOCK = 16, 0xA282EAD8, 1024
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("size", "<i8"), ("before", "<i8")])
SHARDS = T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("name", T.StringType()),
                       T.StructField("n_records", T.LongType()), T.StructField("n_tokens", T.LongType())])
#: Words of letters remembered by a worker.
WORDS_REMEMBERED = 400_000
#: Chunks remembered by a worker, with marks and capitals.
CHUNKS_REMEMBERED = 600_000
#: A word of letters whose lower case is one letter each, composed already, and the marks behind it: two words for the tokenizer.
PARTED = re.compile("([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-/:-@\\[-`{-~]*)\\Z")
#: Bytes read at a time.
READ = 8 << 20


# CRC-32C of many byte strings at once

@lru_cache(maxsize=1)
def crc_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two tables for 4 bytes a step, and the shift of a checksum over 2^i zero bytes as 4 x 256 table entries."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0x82F63B78), one >> 1)

    def zero_byte(c: np.ndarray) -> np.ndarray:
        return one[c & 0xFF] ^ (c >> 8)

    half = np.arange(65536, dtype=np.uint32)
    high = zero_byte(zero_byte(half))  # two bytes further
    low = zero_byte(zero_byte(high))
    shifts = np.zeros((48, 4, 256), np.uint32)
    for byte in range(4):
        shifts[0, byte] = zero_byte(np.arange(256, dtype=np.uint32) << np.uint32(8 * byte))
    for i in range(1, 48):
        shifts[i] = shifted(shifts[i - 1], shifts[i - 1])
    return low, high, shifts


def shifted(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][c & 0xFF] ^ table[1][(c >> 8) & 0xFF] ^ table[2][(c >> 16) & 0xFF] ^ table[3][c >> 24]


def crc32c(data: list[bytes]) -> np.ndarray:
    """Checksums of byte strings: all blocks of all strings advance together, then the blocks of each are put together."""
    low, high, shifts = crc_tables()
    sizes = np.array([len(d) for d in data], np.int64)
    widest = int(sizes.max(initial=0))
    block = BLOCK if widest > BLOCK else max(4, -(-widest // 4) * 4)
    number = -(-sizes // block)
    # zero bytes in front do not change a checksum that starts from zero
    buffer = b"".join(x for d, n in zip(data, number) for x in (bytes(int(n) * block - len(d)), d))
    lanes = np.ascontiguousarray(np.frombuffer(buffer, "<u4").reshape(-1, block // 4).T)
    crc = np.zeros(lanes.shape[1], np.uint32)
    for word in lanes:
        crc ^= word
        crc = low[crc & 0xFFFF] ^ high[crc >> 16]
    table = shift_table(block)
    first = np.cumsum(number) - number
    out = np.zeros(len(data), np.uint32)
    for j in range(int(number.max(initial=0))):
        more = np.flatnonzero(number > j)
        out[more] = shifted(out[more], table) ^ crc[first[more] + j]
    start = np.full(len(data), 0xFFFFFFFF, np.uint32)
    for i in range(48):
        on = (sizes >> i) & 1 == 1
        if on.any():
            start[on] = shifted(start[on], shifts[i])
    return out ^ start ^ np.uint32(0xFFFFFFFF)


@lru_cache(maxsize=512)
def shift_table(size: int) -> np.ndarray:
    _, _, shifts = crc_tables()
    table = np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], np.uint32)
    for i in range(48):
        if size >> i & 1:
            table = shifted(table, shifts[i])
    return table


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


# writing

@lru_cache(maxsize=2)
def library(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=2)
def bare(path: str) -> Tokenizer | None:
    """The file's BPE model behind a split at blanks, for words of letters in lower case: its own normaliser and word split
    leave them as they are. None for a file that prepares texts in another way."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    parts = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
    split = [x["pattern"].get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
    if steps != ["NFC", "Replace", "Lowercase"] or parts != ["Split", "ByteLevel"] or split != [WORDS.pattern]:
        return None
    out = Tokenizer(library(path).model)
    out.pre_tokenizer = WhitespaceSplit()
    return out


def id_bytes(path: str):
    """Encodes chunks without white space; their ids as bytes, of the width that the vocabulary needs.

    Words of letters alone are remembered without the marks behind them, and new ones are encoded many in one text: the last
    id of each, and no other, ends a word, so the ids can be told apart.
    """
    words: dict[str, bytes] = {}
    kind, alphabet, plain = id_type(path), byte_characters(), bare(path)

    def encoded(new: list[str]) -> list[bytes]:
        return [np.array(e.ids, kind).tobytes() for e in library(path).encode_batch_fast(new, add_special_tokens=False)]

    def learn(new: list[str]) -> None:
        texts = new if plain is None else [w if w.isascii() else w.encode().decode("latin-1").translate(alphabet) for w in new]
        for a in range(0, len(new), 4096):
            part = new[a:a + 4096]
            found = (plain or library(path)).encode_batch_fast([" ".join(texts[a:a + 4096])], add_special_tokens=False)[0]
            ids = np.array(found.ids, np.int64)
            stops = np.flatnonzero(word_ends(path)[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                held, width = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                cuts = [0, *(stops * width).tolist()]
                words.update((w, held[x:y]) for w, x, y in zip(part, cuts, cuts[1:]))
            else:
                words.update(zip(part, encoded(part)))

    def make(new: list[str]) -> list[bytes]:
        parts = [m and (m[1].lower(), m[2]) for m in map(PARTED.match, new)]
        if len(words) > WORDS_REMEMBERED:
            words.clear()
        learn(list(dict.fromkeys([w for p in parts if p for w in p if w and w not in words])))
        others = iter(encoded([c for c, p in zip(new, parts) if p is None]))
        return [next(others) if p is None else words[p[0]] + words[p[1]] if p[1] else words[p[0]] for p in parts]

    return make


class ChunkIds:
    """Ids of the chunks met so far by one Python worker: their strings as one array, their ids in one buffer."""

    def __init__(self, path: str):
        self.make, self.kind = id_bytes(path), np.dtype(id_type(path))
        self.clear()

    def clear(self) -> None:
        self.chunks = pa.array([], pa.large_string())
        self.ids, self.stops = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def get(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` and numbers of ids of distinct chunks."""
        if len(self.chunks) > CHUNKS_REMEMBERED:
            self.clear()
        found = pc.index_in(chunks, value_set=self.chunks)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        if found.null_count:
            missing = found.is_null()
            new = chunks.filter(missing)
            at[missing.to_numpy(zero_copy_only=False)] = len(self.chunks) + np.arange(len(new))
            made = self.make(new.to_pylist())
            sizes = np.array([len(x) for x in made], np.int64) // self.kind.itemsize
            self.chunks = pa.concat_arrays([self.chunks, new])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), self.kind)])
            self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(sizes)])
        return self.stops[at], self.stops[at + 1] - self.stops[at]


_KNOWN: dict[str, ChunkIds] = {}


def blanks(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space, as the tokenizers' normalisers know it (without U+001C to U+001F)."""
    out = (data == 32) | ((data >= 9) & (data <= 13))
    follow = np.append(data, [0, 0])
    at = np.flatnonzero(np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3)))
    first, second, third = data[at], follow[at + 1], follow[at + 2]
    two = (first == 0xC2) & np.isin(second, (0x85, 0xA0))
    three = (first == 0xE1) & (second == 0x9A) & (third == 0x80) | (first == 0xE3) & (second == 0x80) & (third == 0x80)
    three |= (first == 0xE2) & (second == 0x80) & ((third >= 0x80) & (third <= 0x8A) | np.isin(third, (0xA8, 0xA9, 0xAF)))
    three |= (first == 0xE2) & (second == 0x81) & (third == 0x9F)
    for shift, which in ((0, two | three), (1, two | three), (2, three)):
        out[at[which] + shift] = True
    return out


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Chunks between white space of all texts, and the number of chunks before each text (and of all)."""
    inside = ~blanks(data)
    before = np.concatenate([[False], inside[:-1]])
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.searchsorted(np.flatnonzero(inside), starts)  # places of the starts among the bytes that stay
    kept = data[inside]
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(stops, len(kept)).astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes()))
    return text, np.searchsorted(starts, offsets)


def encoded_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one behind the other, and the number of ids before each text (and of all)."""
    known = _KNOWN.get(path) or _KNOWN.setdefault(path, ChunkIds(path))
    chunks, first = chunks_of(*text_buffers(texts))
    coded = chunks.dictionary_encode()
    place, size = known.get(coded.dictionary)
    at = coded.indices.to_numpy()
    start, length = place[at], size[at]
    stops = np.concatenate([[0], np.cumsum(length)])
    take = np.repeat(start - stops[:-1], length) + np.arange(stops[-1])
    return known.ids[take], stops[first]


@lru_cache(maxsize=2)
def word_ends(path: str) -> np.ndarray:
    """Whether an id ends a word."""
    with open(path, encoding="utf-8") as f:
        suffix = json.load(f)["model"].get("end_of_word_suffix")
    vocab = library(path).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, bool)
    out[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
    return out


@lru_cache(maxsize=2)
def id_type(path: str) -> str:
    return "<u2" if library(path).get_vocab_size(with_added_tokens=True) <= 65536 else "<u4"


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def framed(data: list[bytes]) -> list[bytes]:
    heads = [struct.pack("<Q", len(d)) for d in data]
    return [h + c.tobytes() + d + k.tobytes() for h, c, d, k in zip(
        heads, masked(crc32c(heads)).astype("<u4"), data, masked(crc32c(data)).astype("<u4"))]


def shard_writer(folder: str, path: str, end: int):
    """Writes one shard for each task, under a name of its own, and gives its line of the manifest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(id_type(path))
        tail, width = np.array([end], kind).tobytes(), kind.itemsize
        fs, root = file_system(folder)
        name, records, entries, offset, before = uuid.uuid4().hex, None, [], 0, 0
        for batch in pieces(batches, limit=1 << 22):
            if records is None:
                fs.create_dir(root, recursive=True)
                records = fs.open_output_stream(f"{root}/{name}.rec")
            ids = [NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            tokens, cuts = encoded_texts(path, batch.column("text"))
            held, cuts = tokens.tobytes(), (cuts * width).tolist()
            data = [b"".join([struct.pack("<qB", i, width), held[a:z], tail]) for i, a, z in zip(ids, cuts, cuts[1:])]
            for i, d, frame in zip(ids, data, framed(data)):
                records.write(frame)
                entries.append((i, offset, len(frame), before))
                offset += len(frame)
                before += (len(d) - 9) // width
        if records is not None:
            records.close()
            with fs.open_output_stream(f"{root}/{name}.idx") as index:
                index.write(np.array(entries, INDEX).tobytes())
            yield pa.RecordBatch.from_pydict({
                "low": pa.array([entries[0][0]]), "high": pa.array([entries[-1][0]]), "name": pa.array([name]),
                "n_records": pa.array([len(entries)]), "n_tokens": pa.array([before])})

    return run


def write_records(docs: DataFrame, folder: str, path: str, end: int) -> DataFrame:
    """Encodes the texts, each with id ``end`` behind, and writes them below ``folder`` in ascending doc_id; the manifest.

    Rows without doc_id come first; rows that repeat a doc_id are a record each, ordered by text. Null and empty texts hold
    the end id only. Other columns are not read. An empty table writes no shard. ``folder`` is one that all executors share.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(shard_writer(f"{folder}/shards", path, end), SHARDS)
    shards.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(SHARDS).parquet(f"{folder}/manifest")


# reading

def parse(record: bytes, crc_head: int, crc_data: int) -> tuple[int, np.ndarray]:
    """doc_id and ids of a record whose checksums are given; a wrong one is an error."""
    size, head = struct.unpack_from("<QI", record)
    if size != len(record) - HEAD or head != crc_head or struct.unpack_from("<I", record, len(record) - 4)[0] != crc_data:
        raise ValueError("damaged record")
    doc_id, width = struct.unpack_from("<qB", record, 12)
    return doc_id, np.frombuffer(record, f"<u{width}", offset=21, count=(size - 9) // width)


def checked(records: list[bytes]) -> list[tuple[int, np.ndarray]]:
    heads = masked(crc32c([r[:8] for r in records]))
    datas = masked(crc32c([r[12:-4] for r in records]))
    return [parse(r, int(h), int(d)) for r, h, d in zip(records, heads, datas)]


def shard_reader(folder: str):
    """Rows of ``name`` and ``base`` -> one row for each record, in the order of the file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                with fs.open_input_file(f"{root}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                with fs.open_input_file(f"{root}/{name}.rec") as f:
                    at = 0
                    while at < len(index):
                        stop = int(np.searchsorted(index["offset"], index["offset"][at] + READ, "right"))
                        stop = max(at + 1, min(stop, len(index)))
                        yield rows_of(f, index[at:stop], np.full(stop - at, base))
                        at = stop

    return run


def rows_of(f, entries: np.ndarray, base: np.ndarray) -> pa.RecordBatch:
    """Reads neighbouring records as one range, others one by one."""
    stops = entries["offset"] + entries["size"]
    if (stops[:-1] == entries["offset"][1:]).all():
        f.seek(int(entries["offset"][0]))
        held = f.read(int(stops[-1] - entries["offset"][0]))
        cut = entries["offset"] - entries["offset"][0]
        records = [held[a:a + n] for a, n in zip(cut.tolist(), entries["size"].tolist())]
    else:
        records = []
        for a, n in zip(entries["offset"].tolist(), entries["size"].tolist()):
            f.seek(a)
            records.append(f.read(n))
    got = checked(records)
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([None if i == NO_ID else i for i, _ in got], pa.int64()),
        "start": pa.array(entries["before"] + base, pa.int64()),
        "n_tokens": pa.array([len(x) for _, x in got], pa.int64()),
        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in got], pa.int64())})


RECORD_ROWS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: doc_id, start (ids of all records before it), n_tokens, ids_crc32 (as unsigned 32-bit ids)."""
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/manifest")
    order = Window.orderBy("low", "high", "name").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    based = shards.select("name", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    # as many tasks as shards: rows of names are too small for Spark to judge by
    return based.repartition(max(1, shards.count()), "name").mapInArrow(shard_reader(f"{folder}/shards"), RECORD_ROWS)


def read_shuffled(spark: SparkSession, folder: str, seed: int, block: int = 64) -> DataFrame:
    """The records in an order set by ``seed``, read through the index: blocks of records are dealt out by hash, and each
    task reads its blocks in hashed order. Columns as in read_records(), and the record's ids."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(f"{folder}/shards")
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with fs.open_input_file(f"{root}/{name}.idx") as f:
                    n = len(f.read()) // INDEX.itemsize
                at = np.arange(0, n, block)
                yield pa.RecordBatch.from_pydict({"name": pa.array([name] * len(at)), "at": pa.array(at, pa.int64())})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(f"{folder}/shards")
        for batch in batches:
            for name, at in zip(batch.column("name").to_pylist(), batch.column("at").to_pylist()):
                with fs.open_input_file(f"{root}/{name}.idx") as f:
                    f.seek(at * INDEX.itemsize)
                    index = np.frombuffer(f.read(block * INDEX.itemsize), INDEX)
                with fs.open_input_file(f"{root}/{name}.rec") as f:
                    f.seek(int(index["offset"][0]))
                    held = f.read(int(index["size"].sum()))
                cut = index["offset"] - index["offset"][0]
                got = checked([held[a:a + n] for a, n in zip(cut.tolist(), index["size"].tolist())])
                turn = np.random.default_rng([seed, at]).permutation(len(got))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([None if got[i][0] == NO_ID else got[i][0] for i in turn], pa.int64()),
                    "ids": pa.array([got[i][1].astype(np.int64) for i in turn], pa.list_(pa.int64()))})

    shards = spark.read.schema(SHARDS).parquet(f"{folder}/manifest")
    dealt = shards.select("name").repartition(max(1, shards.count()), "name").mapInArrow(entries, "name string, at bigint")
    turn = F.xxhash64("name", "at", F.lit(seed))
    return dealt.withColumn("turn", turn).repartitionByRange("turn").sortWithinPartitions("turn").select("name", "at").mapInArrow(
        fetch, "doc_id bigint, ids array<bigint>")
