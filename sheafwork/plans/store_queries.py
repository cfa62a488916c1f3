"""Queries that write files or tables to shared places and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.plans import graph_queries as GQ
from sheafwork.plans import inputs as I
from sheafwork.plans.registry import query
from sheafwork.session import shared_folder
from sheafwork.sinks import exports
from sheafwork.sinks.stores import JobTables, Library
from sheafwork.sources import files, records
from sheafwork.streaming import ingest


def listed(columns):
    """(name, type) list as one text."""
    return F.array_join(F.transform(columns, lambda c: F.concat_ws(" ", c["name"], c["type"])), ", ")


# ---------------------------------------------------------------- files

# One delimited file for each nation: a header, quoted line ends and quotes, rows with too few and too many fields, and one
# row that repeats the header.
_LINES = """
SELECT n_nationkey AS file, CAST(0 AS BIGINT) AS line, 'key;note;"account; value"' AS value FROM {nation}
UNION ALL SELECT c_nationkey, c_custkey, CASE c_custkey % 10
  WHEN 0 THEN concat(CAST(c_custkey AS STRING), ';"', c_name, chr(10), 'second ""line""', chr(10), chr(10), '";', c_mktsegment)
  WHEN 1 THEN concat(CAST(c_custkey AS STRING), ';', c_name) WHEN 2 THEN concat(CAST(c_custkey AS STRING), ';a;b;c')
  WHEN 3 THEN 'key;note;"account; value"' WHEN 4 THEN concat(CAST(c_custkey AS STRING), ';5" pipe;', c_mktsegment)
  ELSE concat(CAST(c_custkey AS STRING), ';', c_name, ';', c_mktsegment) END FROM {customer}
"""


def delimited_folder(t) -> str:
    path = shared_folder(t.spark, "delimited")
    # a customer may have the header's number 0: the header goes first, whatever the shuffle's order
    header = (F.col("line") == 0) & F.col("value").startswith("key;")
    lines = t.sql(_LINES).repartition("file").sortWithinPartitions("file", F.desc(header), "line")
    lines.select("file", "value").write.partitionBy("file").text(path)
    return path


def nation_of(path):
    return F.regexp_extract(path, r"file=(\d+)", 1).cast("int")


@query("S3", """
SELECT c_nationkey AS file, CASE WHEN c_custkey % 10 = 3 THEN 'key' ELSE CAST(c_custkey AS STRING) END AS key,
  CASE c_custkey % 10 WHEN 0 THEN concat(c_name, chr(10), 'second "line"', chr(10), chr(10)) WHEN 3 THEN 'note' WHEN 4 THEN '5" pipe' ELSE c_name END AS note,
  CASE c_custkey % 10 WHEN 1 THEN NULL WHEN 3 THEN 'account; value' ELSE c_mktsegment END AS account
FROM {customer} WHERE c_custkey % 10 <> 2
""")
def delimited_rows(t):
    good, _ = files.read_delimited(t.spark, delimited_folder(t))
    return good.select(nation_of("source_file").alias("file"), "key", "note", F.col("`account; value`").alias("account"))


@query("S3", """
SELECT c_nationkey AS file, concat(c_custkey, ';a;b;c') AS raw, 'row of 4 fields under a header of 3' AS warning FROM {customer} WHERE c_custkey % 10 = 2
""")
def delimited_bad_rows(t):
    _, bad = files.read_delimited(t.spark, delimited_folder(t))
    return bad.select(nation_of("source_file").alias("file"), "raw", "warning")


@query("S2", """
SELECT concat('invoice_', r_regionkey, '.csv') AS file, 'csv' AS category, CAST(4 + sum(length(n_name) + 1) AS BIGINT) AS size_bytes, 'invoice' AS keyword_hits
FROM {region} JOIN {nation} ON n_regionkey = r_regionkey GROUP BY ALL
""")
def listed_files(t):
    """Reads the listing of real files: one for each region, written as it is named."""
    path = shared_folder(t.spark, "listing")
    text = t.sql("""SELECT n_regionkey AS r, concat('all', chr(10), array_join(array_sort(collect_list(n_name)), chr(10))) AS value
                    FROM {nation} GROUP BY n_regionkey""")
    text.repartition("r").write.partitionBy("r").text(path)
    exports.rename_parts(t.spark, path, "r", "invoice_{}.csv")
    found = files.file_metadata(t.spark, path, "*.csv")
    return found.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "category", "size_bytes", F.array_join("keyword_hits", ",").alias("keyword_hits"))


@query("S4", """
SELECT 0 AS col_idx, 'o_orderkey' AS "column", 'bigint' AS dtype, count(*) AS rows, 0 AS nulls, true AS near_distinct, true AS near_median FROM {orders}
UNION ALL SELECT 1, 'o_custkey', 'bigint', count(*), 0, true, true FROM {orders} UNION ALL SELECT 2, 'o_orderstatus', 'string', count(*), 0, true, NULL FROM {orders}
UNION ALL SELECT 3, 'price', 'double', count(*), count(*) FILTER (WHERE o_orderkey % 5 = 0), true, true FROM {orders}
""")
def merged_profiles(t):
    """Profiles of a file a year, the last year's added later; within 5 percent of exact figures."""
    orders = t.orders.select(F.year("o_orderdate").alias("file"), "o_orderkey", "o_custkey", "o_orderstatus",
                             F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"))
    first, last = (files.sketch_profile(orders.where(f"file {which} 1997"), "file") for which in ("<", ">="))
    found = files.profile_report(files.merge_profiles(first, last))
    exact = files.profile_columns(orders.drop("file")).select("col_idx", F.col("distinct_values").alias("exact"))
    middle = orders.agg(*[F.expr(f"percentile({c}, array(0.45, 0.55))").alias(str(i)) for i, c in ((0, "o_orderkey"), (1, "o_custkey"), (3, "price"))]).select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("col_idx"), F.col(str(i)).alias("bounds")) for i in (0, 1, 3)])))
    both = found.join(exact, "col_idx").join(middle, "col_idx", "left")
    return both.select("col_idx", "column", "dtype", "rows", "nulls", (F.abs(F.col("distinct_values") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near_distinct"),
                       F.col("median").between(F.col("bounds")[0], F.col("bounds")[1]).alias("near_median"))


# The same events as JSON lines, as the items of one array, and as single objects.
_EVENT = """concat('{{"id": ', CAST(event_id AS STRING), ', "who": {{"user": ', CAST(user_id AS STRING), ', "says": "a, [b], {{c}} \\\\" ', event_type, '"}}, "at": [1, ', CAST(event_id % 7 AS STRING), ']}}')"""


#: Events of one array file: more than one split holds.
EVENTS_AN_ARRAY = 2_000_000


@query("S5", f"""
SELECT kind, event_id AS id, user_id AS user, concat('a, [b], {{{{c}}}} " ', event_type) AS says FROM {{events}}, (SELECT unnest(['array.json', 'lines.jsonl']) AS kind)
UNION ALL SELECT 'object.json', event_id, user_id, concat('a, [b], {{{{c}}}} " ', event_type) FROM {{events}} WHERE event_id < 5
""")
def json_file_records(t):
    path = shared_folder(t.spark, "json")
    values = t.sql("SELECT event_id, " + _EVENT + " AS value FROM {events}")
    # as many files of lines as there are tasks
    values.select("value", F.spark_partition_id().alias("part")).write.partitionBy("part").text(f"{path}/lines")
    exports.rename_parts(t.spark, f"{path}/lines", "part", "lines.jsonl")
    # large arrays, each written by one task: brackets and commas stand at the ends of lines
    items = values.withColumn("part", F.floor(F.col("event_id") / EVENTS_AN_ARRAY))
    ends = items.groupBy("part").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    rows = items.join(F.broadcast(ends), "part").select("part", "event_id", F.concat(
        F.when(F.col("event_id") == F.col("first"), "[").otherwise(""), "value",
        F.when(F.col("event_id") == F.col("last"), "]").otherwise(",")).alias("value"))
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(f"{path}/array")
    exports.rename_parts(t.spark, f"{path}/array", "part", "array.json")
    values.where("event_id < 5").repartition("event_id").write.partitionBy("event_id").text(f"{path}/object")
    exports.rename_parts(t.spark, f"{path}/object", "event_id", "object.json")
    found, _ = records.read_records(t.spark, path)
    v = F.parse_json("raw")
    return found.select(
        F.regexp_extract("source_file", r"([^/]*)$", 1).alias("kind"), F.variant_get(v, "$.id", "bigint").alias("id"),
        F.variant_get(v, "$.who.user", "bigint").alias("user"), F.variant_get(v, "$.who.says", "string").alias("says"))


# ---------------------------------------------------------------- result files

def results_folder(t) -> str:
    path = shared_folder(t.spark, "results")
    pii = t.sql(I.PII)
    nodes = GQ.nodes(t)
    for job in ("job1996", "job1997"):
        mine = F.col("job_id") == job
        exports.write_results(path, job, {"pii": pii.where(mine).drop("job_id"), "entities": nodes.where(mine).drop("job_id")})
        exports.write_graph(nodes.where(mine).drop("job_id"), GQ.edges(t, nodes).where(mine).drop("job_id"), path, job)
    return path


_RESULTS = f"""
SELECT 'pii' AS kind, job_id, category AS name, source_file AS detail FROM ({I.PII}) WHERE job_id IN (JOBS)
UNION ALL SELECT 'entities', job_id, name, type FROM ({GQ.NODES}) WHERE job_id IN (JOBS)
UNION ALL SELECT 'nodes', job_id, name, type FROM ({GQ.NODES}) WHERE job_id IN (JOBS)
UNION ALL SELECT 'edges', job_id, source, target FROM ({GQ.EDGES}) WHERE job_id IN (JOBS)
"""


def read_results(t, path: str) -> DataFrame:
    def rows(kind: str, name: str, detail: str) -> DataFrame:
        # with a schema the files are read once, not once more for their types
        read = t.spark.read.schema(f"job_id string, {name} string, {detail} string").json(f"{path}/{kind}")
        return read.select(F.lit(kind).alias("kind"), "job_id", F.col(name).alias("name"), F.col(detail).alias("detail"))

    return rows("pii", "category", "source_file").unionByName(rows("entities", "name", "type")).unionByName(
        rows("nodes", "name", "type")).unionByName(rows("edges", "source", "target"))


@query("K1, K4", _RESULTS.replace("JOBS", "'job1996', 'job1997'"))
def written_results(t):
    return read_results(t, results_folder(t))


@query("K12", _RESULTS.replace("JOBS", "'job1997'"))
def results_without_deleted_job(t):
    path = results_folder(t)
    exports.delete_job(t.spark, path, "job1996")
    return read_results(t, path)


@query("K5", f"""
SELECT 'customers_t0' AS folder, coalesce(cust_id, '') AS first, coalesce(phone, '') AS last FROM ({I.CUSTOMER_TABLE})
UNION ALL SELECT 'All_orders_of_erp_t1', OrderID, priority FROM ({I.ORDERS_TABLE})
""")
def written_tables(t):
    path = shared_folder(t.spark, "tables")
    customers, orders = (t.sql(sql).drop("row_id") for sql in (I.CUSTOMER_TABLE, I.ORDERS_TABLE))
    names = exports.write_tables({"t0": ("customers", customers), "t1": ("All orders/of erp", orders)}, path)
    out = None
    for name in names:
        read = t.spark.read.option("header", True).csv(name)
        rows = read.select(F.lit(name.rsplit("/", 1)[1].removesuffix(".csv")).alias("folder"), F.coalesce(read.columns[0], F.lit("")).alias("first"),
                           F.coalesce(read.columns[-1], F.lit("")).alias("last"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- tables of a job, library

_BIG = f"SELECT cust_id, concat(CAST(row_id AS STRING), '00000000000000000000') AS big, segment FROM ({I.CUSTOMER_TABLE})"


def job_tables(t) -> JobTables:
    store = JobTables(t.spark, f"q_{uuid.uuid4().hex}")
    store.register("crm/Customers 2024.csv", t.sql(I.CUSTOMER_TABLE).drop("row_id"))
    store.register("erp/Customers 2024.csv", t.sql(_BIG))
    store.register("erp/orders.xlsx", t.sql(I.ORDERS_TABLE).drop("row_id"), "excel", "All Orders")
    return store


@query("K6, K7", f"""
SELECT 'customers_2024' AS table_name, 'crm/Customers 2024.csv' AS source_file, count(*) AS row_count, count(*) FILTER (WHERE acct_value = '####') AS rejected,
  'cust_id INTEGER, full_name TEXT, acct_value REAL, segment TEXT, is_active TEXT, email TEXT, origin TEXT, phone INTEGER' AS columns FROM ({I.CUSTOMER_TABLE})
UNION ALL SELECT 'customers_2024_2', 'erp/Customers 2024.csv', count(*), 0, 'cust_id INTEGER, big REAL, segment TEXT' FROM ({_BIG})
UNION ALL SELECT 'orders_All_Orders', 'erp/orders.xlsx', count(*), count(*) FILTER (WHERE total_amount IN ('#REF!', 'five')),
  'OrderID INTEGER, CustomerID INTEGER, total_amount REAL, status TEXT, order_date TEXT, priority TEXT' FROM ({I.ORDERS_TABLE})
""")
def registered_tables(t):
    return job_tables(t).manifest().select("table_name", "source_file", "row_count", "rejected", listed(F.col("columns")).alias("columns"))


@query("K6, K7", f"""
SELECT 'customers_2024' AS table_name, count(*) AS rows, round(sum(CAST(TRY_CAST(acct_value AS DOUBLE) AS DECIMAL(20, 2))), 2) AS total FROM ({I.CUSTOMER_TABLE})
UNION ALL SELECT 'customers_2024_2', count(*), sum(row_id) FROM ({I.CUSTOMER_TABLE})
""")
def registered_table_sum(t):
    store = job_tables(t)
    first, second = store.table("customers_2024"), store.table("customers_2024_2")
    return first.agg(F.count("*").alias("rows"), F.sum(F.col("acct_value").cast("decimal(20,2)")).cast("double").alias("total")).select(
        F.lit("customers_2024").alias("table_name"), "rows", "total").unionByName(
        second.agg(F.count("*").alias("rows"), F.sum(F.round(F.col("big") / 1e20).cast("decimal(20,0)")).cast("double").alias("total")).select(
            F.lit("customers_2024_2").alias("table_name"), "rows", "total"))


def library_of(t) -> tuple[Library, dict[str, str]]:
    lib = Library(t.spark, f"lib_{uuid.uuid4().hex}")
    orders = t.sql(I.ORDERS_TABLE).drop("row_id")
    ids = {f"{year}": lib.save(f"job{year % 2}", "erp/Orders.csv", orders.where(F.col("order_date").startswith(f"{year}-"))) for year in (1995, 1996, 1997)}
    return lib, ids


_YEAR = f"SELECT *, left(order_date, 4) AS year FROM ({I.ORDERS_TABLE}) WHERE order_date <> 'soon'"


@query("K8, K9", f"""
SELECT job_id, table_name, row_count, 'OrderID INTEGER, CustomerID INTEGER, total_amount REAL, status TEXT, order_date TEXT, priority TEXT' AS columns FROM (
  SELECT 'job1' AS job_id, 'orders' AS table_name, count(*) AS row_count FROM ({_YEAR}) WHERE year = '1995'
  UNION ALL SELECT 'job0', 'orders_2', count(*) FROM ({_YEAR}) WHERE year = '1996' UNION ALL SELECT 'job1', 'orders_3', count(*) FROM ({_YEAR}) WHERE year = '1997')
""")
def library_list(t):
    lib, _ = library_of(t)
    return lib.list().select("job_id", "table_name", "row_count", listed(F.col("columns")).alias("columns"))


@query("K9, K10", f"SELECT CAST(OrderID AS BIGINT) AS OrderID, status FROM ({_YEAR}) WHERE year = '1996'")
def library_rows(t):
    """All rows of one dataset, a page and what follows it."""
    lib, ids = library_of(t)
    one, rest = lib.rows(ids["1996"], 100, 0), lib.rows(ids["1996"], None, 100)
    return one.unionByName(rest).select("OrderID", F.when(F.col("status").isNotNull(), F.col("status")).alias("status"))


@query("K11", f"""
SELECT 'kept' AS what, OrderID, status FROM ({_YEAR}) WHERE year = '1997' UNION ALL SELECT 'listed', 'orders', NULL UNION ALL SELECT 'listed', 'orders_3', NULL
""")
def library_export(t):
    """A dataset is deleted; what is left is listed, and another exported and read back."""
    lib, ids = library_of(t)
    lib.delete(ids["1996"])
    path = shared_folder(t.spark, "export")
    lib.export_csv(ids["1997"], path)
    back = t.spark.read.option("header", True).csv(path).select(F.lit("kept").alias("what"), "OrderID", "status")
    return back.unionByName(lib.list().select(F.lit("listed").alias("what"), F.col("table_name").alias("OrderID"), F.lit(None).cast("string").alias("status")))


# ---------------------------------------------------------------- incremental run

def result_batches(t, path: str, parts: int = 5, compression: str = "none") -> int:
    """All results as files of lines, by ordinal: each task writes one file for each fifth of its rows. Returns the files
    that make a fifth of all, so many go into a batch.

    Lines are many times longer than the keys they are made of, so the keys are dealt out, not the lines."""
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderdate").repartition(tasks, "o_orderkey")
    lineitem = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").repartition(tasks, "l_orderkey")
    tables = {"orders": orders, "lineitem": lineitem, "customer": t.customer, "supplier": t.supplier, "nation": t.nation}
    ent = t.spark.sql(I.ENTITIES, **tables).select(F.lit("entities").alias("kind"), "job_id", "source_file", "ordinal", "name", "type", "confidence")
    rel = t.spark.sql(I.RELATIONS, **tables).select(
        F.lit("relations").alias("kind"), "job_id", "source_file", "ordinal", "source_entity", "target_entity", "relation_type", "evidence", "confidence")
    lines = ent.unionByName(rel, allowMissingColumns=True).withColumn("part", F.col("ordinal") % parts)
    lines.coalesce(tasks).write.partitionBy("part").json(path, compression=compression)
    files = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").count()
    return -(-files // parts)


@query("J4, G6", f"""
SELECT 'node' AS kind, job_id, name AS a, type AS b, CAST(NULL AS STRING) AS c, confidence FROM ({GQ.NODES})
UNION ALL SELECT 'edge', job_id, source, target, type, NULL FROM ({GQ.EDGES})
""")
def ingested_graph(t):
    """Five batches with a stop after the second and a restart give the graph of one merge over everything."""
    source, out, check = (shared_folder(t.spark, n) for n in ("in", "graph", "stream"))
    files = result_batches(t, source, compression="gzip")
    ingest.ingest_stream(t.spark, source, out, check, files_per_batch=files, max_batches=2)
    ingest.ingest_stream(t.spark, source, out, check, files_per_batch=files)
    g = ingest.read_graph(t.spark, out, ("nodes", "edges"))
    return g["nodes"].select(F.lit("node").alias("kind"), "job_id", F.col("name").alias("a"), F.col("type").alias("b"),
                             F.lit(None).cast("string").alias("c"), "confidence").unionByName(
        g["edges"].select(F.lit("edge").alias("kind"), "job_id", F.col("source").alias("a"), F.col("target").alias("b"), F.col("type").alias("c"),
                          F.lit(None).cast("double").alias("confidence")))
