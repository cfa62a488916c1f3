"""Fill-in-middle transformation: texts are cut in two places between tokens, and the middle is moved behind the suffix.

One fullmatch of (unit)* over a text keeps the end of every repetition: their number is n, and both cuts are two of these
ends. The cuts and the form of a text follow from the hash of its doc_id alone, so a text is written alike wherever and
however often its task runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.common import pieces

#: Leading blanks belong to a token; blanks at the end of a text are one. Possessive: no repetition is ever given back.
UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
MARKS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ROWS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers from the seed and the decimal doc_id (none: no digits)."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digits = hashlib.sha256(name.encode()).hexdigest()
    return [int(digits[i:i + 8], 16) for i in range(0, 32, 8)]


def rearranged(text: str, numbers: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, code points of prefix and middle (none if plain) and the output of one text."""
    ends = [0, *UNITS.fullmatch(text).ends(1)]
    n = len(ends) - 1
    first, second, chance, kind = numbers
    if not n or chance % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((ends[first % (n + 1)], ends[second % (n + 1)]))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if kind % 100 < spm:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """One row per document: doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain) and output.

    ``rate`` in a hundred texts are rearranged, ``spm`` in a hundred of these with the suffix first. A null text is an empty
    one; empty texts and texts that hold a mark stay plain. Rows of one doc_id draw the same numbers, rows without doc_id
    those of an empty number. A text is one value: a very long one takes some 50 bytes a token while it is cut. Other columns
    are not read, whatever their names; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = batch.column("doc_id").to_pylist()
            rows = [rearranged(t or "", draws(seed, i), rate, spm) for i, t in zip(ids, batch.column("text").to_pylist())]
            n, form, prefix, middle, output = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, ROWS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. Marks never stand in a rearranged text, nor across a seam."""
    parts = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output))
