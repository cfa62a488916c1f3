"""Incremental ingest: batches of result files folded into a graph that can be read at any time.

Every micro-batch writes its own folder of merged rows, ``level=0/part=n``. Each ``FAN`` neighbouring parts of a level are
merged into one part of the next level, as a log-structured store does it: a row is rewritten once a level, a read touches a
few parts a level, and numbers alone say which parts a folder stands for, so a replayed batch rewrites the same folders. The
checkpoint says where to go on.
"""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.operators import graph as G

KINDS = ("entities", "relations", "pii", "chunks")
#: What a graph is made of, and the kinds of results that each is read from.
GRAPH = {"nodes": ("entities",), "edges": ("entities", "relations"), "findings": ("pii",), "chunks": ("chunks",),
         "mentions": ("entities", "chunks"), "has_pii": ("entities", "pii")}

# One line of a result file: its kind and the fields of that kind.
RESULT_SCHEMA = (
    "kind string, job_id string, source_file string, ordinal long, name string, type string, confidence double, "
    "source_entity string, target_entity string, relation_type string, evidence string, finding_id string, category string, "
    "severity string, subject_entity string, chunk_id string, text string")
FIELDS = {
    "entities": ("job_id", "name", "type", "confidence", "source_file"),
    "relations": ("job_id", "source_entity", "target_entity", "relation_type", "evidence", "confidence", "source_file", "ordinal"),
    "pii": ("finding_id", "ordinal", "job_id", "category", "severity", "subject_entity", "source_file"),
    "chunks": ("chunk_id", "ordinal", "job_id", "source_file", "text"),
}


#: Parts of a level that make one part of the next.
FAN = 4


class _Stop(Exception):
    """Raised before a batch is touched, so that it is processed on the next start."""


def merged(kind: str, rows: DataFrame) -> DataFrame:
    """Rows of a kind with their batch number, merged: what a later merge needs of them."""
    if kind == "entities":
        return G.upsert_entities(None, rows)
    if kind == "relations":
        return G.first_rows(rows, ["job_id", "source_entity", "target_entity", "relation_type"], ["batch_id", "ordinal"])
    key = "finding_id" if kind == "pii" else "chunk_id"
    rest = [c for c in rows.columns if c not in (key, "batch_id", "ordinal")]
    last = rows.groupBy(key).agg(F.max(F.struct("batch_id", "ordinal", *rest)).alias("_l"))
    return last.select(key, *[f"_l.{c}" for c in ("batch_id", "ordinal", *rest)])


def part_path(out: str, kind: str, level: int, part: int) -> str:
    return f"{out}/{kind}/level={level}/part={part}"


def merge_batch(batch: DataFrame, out: str, batch_id: int) -> None:
    """Write one batch's rows, merged within the batch, and every higher part that it completes."""
    spark = batch.sparkSession
    for kind in KINDS:
        rows = batch.filter(F.col("kind") == kind).select(*FIELDS[kind]).withColumn("batch_id", F.lit(batch_id).cast("long"))
        _write(merged(kind, rows), part_path(out, kind, 0, batch_id))
        level, part = 0, batch_id
        while part % FAN == FAN - 1:
            below = [part_path(out, kind, level, p) for p in range(part - FAN + 1, part + 1)]
            level, part = level + 1, part // FAN
            _write(merged(kind, _rows(spark, kind, below)), part_path(out, kind, level, part))


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path, compression="zstd")


def _rows(spark: SparkSession, kind: str, paths: list[str]) -> DataFrame:
    found = spark.read.parquet(*paths)
    return found.withColumn("source_file", F.explode("source_files")).drop("source_files") if kind == "entities" else found


def complete_parts(spark: SparkSession, out: str, kind: str) -> list[str]:
    """The fewest finished parts that stand for all batches so far: the highest level first, then what comes behind it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()  # noqa: SLF001
    hadoop = jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{out}/{kind}")
    fs = root.getFileSystem(conf)
    levels: dict[int, set[int]] = {}
    for status in fs.listStatus(root) if fs.exists(root) else []:
        level = int(status.getPath().getName().split("=")[1])
        levels[level] = {int(p.getPath().getName().split("=")[1]) for p in fs.listStatus(status.getPath())
                         if fs.exists(hadoop.Path(p.getPath(), "_SUCCESS"))}
    chosen, batch = [], 0
    while True:
        fits = [(n, batch // FAN ** n) for n, parts in levels.items() if batch % FAN ** n == 0 and batch // FAN ** n in parts]
        if not fits:
            return chosen
        level, part = max(fits)
        chosen.append(part_path(out, kind, level, part))
        batch += FAN ** level


def ingest_stream(spark: SparkSession, source: str, out: str, checkpoint: str, files_per_batch: int = 15,
                  max_batches: int | None = None) -> int:
    """Process new result files in batches; returns how many batches ran.

    With ``max_batches`` the run stops before the next batch and the following call goes on there. Any failure of a batch
    comes through, whenever it happens.
    """
    stream = (
        spark.readStream.schema(RESULT_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true").json(source)
    )
    ran: list[int] = []
    stop = f"stopped after {max_batches} batches, {uuid.uuid4().hex}"

    def step(batch: DataFrame, batch_id: int) -> None:
        if max_batches is not None and len(ran) >= max_batches:
            raise _Stop(stop)
        # the batch is read once per kind; keep it while its four writes run
        batch.persist()
        try:
            merge_batch(batch, out, batch_id)
        finally:
            batch.unpersist()
        ran.append(batch_id)
        # shuffle files of a batch stay until the driver collects its garbage, which a large heap puts off for many batches
        spark._jvm.System.gc()  # noqa: SLF001

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as failed:
        if stop not in str(failed):
            raise
    return len(ran)


def read_graph(spark: SparkSession, out: str, wanted: tuple[str, ...] = tuple(GRAPH)) -> dict[str, DataFrame]:
    """Current nodes, edges, findings, chunks, mentions and HAS_PII edges over all batches, or those ``wanted``."""
    rows = {}
    for kind in KINDS:
        if not any(kind in GRAPH[name] for name in wanted):
            continue
        paths = complete_parts(spark, out, kind)
        if not paths:
            raise FileNotFoundError(f"no batch of {kind} below {out}")
        rows[kind] = _rows(spark, kind, paths)
    found = {}
    if "entities" in rows:
        found["nodes"] = nodes = merged("entities", rows["entities"])
    if "edges" in wanted:  # merged rows hold each relation once
        first = merged("relations", rows["relations"]).withColumn("ordinal", F.struct("batch_id", "ordinal")).drop("batch_id")
        found["edges"] = G.link_relations(first, nodes)
    if "pii" in rows:
        found["findings"] = merged("pii", rows["pii"]).drop("batch_id", "ordinal")
    if "chunks" in rows:
        found["chunks"] = merged("chunks", rows["chunks"]).withColumn("ordinal", F.struct("batch_id", "ordinal")).drop("batch_id")
    if "mentions" in wanted:
        found["mentions"] = G.mentions(found["chunks"], nodes)
    if "has_pii" in wanted:
        found["has_pii"] = G.has_pii(found["findings"], nodes)
    return {name: found[name] for name in GRAPH if name in wanted}
