"""Results of layout and OCR engines as tables: words to lines, items to blocks and tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _line_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring words with the same keys and consecutive numbers as one row: keys, first number, the words joined by
    blanks, their number, sum and number of confidences. A word that holds a blank stays alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        *keys, number, word, conf = batch.columns
        joined = np.ones(batch.num_rows - 1, bool)
        for now, before in [*((k[1:], k[:-1]) for k in keys), (number[1:], pc.add(number[:-1], 1))]:
            joined &= pc.equal(now, before).fill_null(False).to_numpy(zero_copy_only=False)
        blank = pc.match_substring(word, " ").to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero(~joined | blank[1:] | blank[:-1]) + 1)
        stops = np.append(starts, batch.num_rows).astype(np.int32)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(stops), word.cast(pa.string())), " ")
        total = np.add.reduceat(conf.fill_null(0).to_numpy(), starts)
        confs = np.add.reduceat(conf.is_valid().to_numpy(zero_copy_only=False), starts, dtype=np.int32)
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays(
            [*(k.take(at) for k in keys), number.take(at), texts, pa.array(np.diff(stops)), pa.array(total), pa.array(confs)],
            names=[*batch.schema.names[:len(keys)], "word_no", "text", "n", "conf", "confs"])


def ocr_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a line joined in order with the mean confidence / 100; -1 counts as 0.

    words: keys, word_no (whole numbers), word, conf. A group is one printed line. Neighbouring words are joined within
    the task, so pieces of lines are shuffled and not words.
    """
    conf = F.when(F.col("conf") == -1, 0).otherwise(F.col("conf")).cast("double")
    live = words.select(*keys, F.col("word_no").cast("bigint").alias("word_no"), F.trim("word").alias("word"), conf.alias("conf"))
    piece = StructType(live.schema.fields[:len(keys)] + StructType.fromDDL(
        "word_no bigint, text string, n int, conf double, confs int").fields)
    parts = live.filter("word <> ''").mapInArrow(_line_pieces, piece)

    def loose(p: Column) -> Column:
        """The words of a piece with their numbers."""
        each = F.when(p["n"] == 1, F.array(p["text"])).otherwise(F.split(p["text"], " "))
        return F.transform(each, lambda w, i: F.struct((p["word_no"] + i).alias("no"), w.alias("word")))

    ordered = F.array_sort(F.flatten(F.transform("p", loose)))
    text = F.when(F.size("p") == 1, F.col("p")[0]["text"]).otherwise(F.array_join(F.transform(ordered, lambda w: w["word"]), " "))
    lines = parts.groupBy(*keys).agg(
        F.collect_list(F.struct("word_no", "n", "text")).alias("p"), F.sum("conf").alias("conf"), F.sum("confs").alias("confs"))
    return lines.select(*keys, text.alias("text"), (F.try_divide("conf", "confs") / 100).alias("confidence"), F.lit("ocr").alias("kind"))


def layout_blocks(items: DataFrame) -> DataFrame:
    """Text items as heading or paragraph. items: source_file, item_no, label, text, page, grid."""
    kind = F.when(F.col("label").isin("title", "section_header"), "heading").otherwise("paragraph")
    return items.filter((F.col("label") != "table") & (F.coalesce("text", F.lit("")) != "")).select(
        "source_file", F.col("item_no").alias("ordinal"), "page", kind.alias("kind"), "text")


def layout_tables(items: DataFrame) -> DataFrame:
    """Table cells (row 0 is the header); a table without a readable grid gives a warning row."""
    rows = items.filter(F.col("label") == "table").select(
        "source_file", "item_no", "page", F.posexplode_outer("grid").alias("row_no", "r"))
    place = F.when(F.col("page").isNotNull(), F.concat(F.lit(" on page "), "page")).otherwise("")
    warning = F.when(F.col("r").isNull(), F.concat(F.lit("A table"), place, F.lit(" could not be parsed and was skipped.")))
    return rows.select("source_file", "item_no", "page", "row_no", F.posexplode_outer("r").alias("col_no", "value"),
                       warning.alias("warning"))


def needs_ocr(files: DataFrame, items: DataFrame) -> DataFrame:
    """Documents with neither text nor a table."""
    some = layout_blocks(items).filter(F.trim("text") != "").select("source_file").union(
        items.filter((F.col("label") == "table") & F.col("grid").isNotNull()).select("source_file")).distinct()
    return files.join(some, "source_file", "left_anti")
