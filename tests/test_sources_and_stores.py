from __future__ import annotations

import contextlib
import csv
import io
import json
import random
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import graph as G
from sheafwork.sinks import exports
from sheafwork.sinks.stores import JobTables, Library, claim, page
from sheafwork.sources import containers, files, layout, markup, records
from sheafwork.streaming import ingest


def read(spark, folder):
    rows, warnings = records.read_records(spark, str(folder))
    return rows, warnings


def test_json_shapes(spark, tmp_path):
    (tmp_path / "people.json").write_text(json.dumps([{"name": "Alice", "age": 30}, {"name": "Bob", "age": 25}]))
    (tmp_path / "one.json").write_text('﻿{"name": "Solo", "age": 1}')
    (tmp_path / "wrapped.json").write_text(json.dumps({"employees": [{"id": 1}, {"id": 2}, {"id": 3}]}))
    (tmp_path / "lines.jsonl").write_text('﻿{"a":1}\nnot json\n\n{"a":2}\n')
    (tmp_path / "broken.json").write_text('{"a": ')
    rows, warnings = read(spark, tmp_path)
    per = {r.f: r.n for r in rows.groupBy(F.regexp_extract("source_file", r"([^/]*)$", 1).alias("f")).agg(F.count("*").alias("n")).collect()}
    assert per == {"people.json": 2, "one.json": 1, "wrapped.json": 3, "lines.jsonl": 2}
    assert sorted(r.warning for r in warnings.collect()) == ["file is no JSON value", "line 2 is no JSON value"]


def test_big_jsonl_keeps_every_row_and_its_line_number(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join('{"id": %d}\n' % i for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows, _ = read(spark, tmp_path)
        got = sorted((r.record_no, json.loads(r.raw)["id"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i + 1, i) for i in range(3000)]


def flat(spark, *raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "record_no int, raw string")
    out = {}
    for r in records.flatten_json(df).collect():
        out.setdefault(r.record_no, {})[r.path] = r.value
    return [out.get(i, {}) for i in range(len(raws))]


def test_flatten(spark):
    deep = '{"customer": "x", "transactions": %s}' % json.dumps([{"amount": i} for i in range(50)])
    got = flat(spark, '"active"', "[1, [2]]", '{"a": {"b": null, "c": true, "d": "true", "e": "{}"}, "l": [], "o": {}}', deep, "{}")
    assert got[0] == {"value": "active"}
    assert got[1] == {"value": "[2 items]", "value[0]": "1", "value[1]": "[1 items]", "value[1][0]": "2"}
    assert got[2] == {"a.b": "None", "a.c": "True", "a.d": "true", "a.e": "{}", "l": "[0 items]"}
    assert got[3]["transactions"] == "[50 items]" and sum(k.startswith("transactions[") for k in got[3]) == 50
    assert got[4] == {}


def test_flatten_has_no_deepest_level(spark):
    (got,) = flat(spark, '{"a":' * 60 + "1" + "}" * 60)
    assert got == {".".join("a" * 60): "1"}


def test_flatten_bounds_on_request(spark):
    df = spark.createDataFrame([(0, '{"l": [1, 2, 3], "d": {"e": {"f": 1}}}'), (1, None)], "record_no int, raw string")
    got = {r.path: r.value for r in records.flatten_json(df, depth=2, list_items=2).collect()}
    assert got == {"l": "[3 items, first 2 kept]", "l[0]": "1", "l[1]": "2", "d.e": '{"f":1}'}


def test_json_values_end_where_the_text_ends(spark):
    texts = ['{"a":1}', ' {"a":1} ', '{"a":1} x', '{"a":1}{"b":2}', '{"a":1} and {"b":2}', '[1,2]', '1,2', '[1]] , [1', '{"a":1,"a":2}', 'null', '"x"', '']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.ok for r in df.select("t", records.is_valid_json(F.col("t")).alias("ok")).collect()}
    assert got == {t: t in (texts[0], texts[1], "[1,2]", '{"a":1,"a":2}', "null", '"x"') for t in texts}


def test_every_bad_line_is_returned(spark):
    lines = spark.createDataFrame([("f", i, "{" if i % 2 else "{}") for i in range(60)], "source_file string, line_no long, value string")
    good, bad = records.quarantine_bad_lines(lines)
    assert good.count() == 30 and {(r.warning_no, r.bad_text) for r in bad.collect()} == {(i, "{") for i in range(1, 60, 2)}


def test_headers_by_frequency(spark):
    raws = [json.dumps({f"junk_{i}": 1}) for i in range(20)] + ['{"amount": 1}'] * 20
    df = spark.createDataFrame(list(enumerate(raws)), "record_no int, raw string")
    table = records.records_to_table(records.flatten_json(df), ["record_no"])
    assert "amount" in table.columns and len(table.columns) == 22 and table.count() == 40


def test_duplicate_keys_last_wins(spark):
    raw = '{"id": 1, "id": 101, "address": {"city": "x", "city": "y"}}'
    df = spark.createDataFrame([("f", raw)], "source_file string, raw string")
    assert sorted((r.key, r.repeats) for r in records.duplicate_keys(df).collect()) == [("city", 1), ("id", 1)]
    got = {r.path: r.value for r in records.flatten_json(df).collect()}
    assert got == {"id": "101", "address.city": "y"}


def test_unwrap_only_one_list(spark):
    raws = ['{"employees": [{"id": 1}, {"id": 2}], "n": 2}', '{"users": [{"a": 1}], "errors": [{"b": 1}]}', '{"tags": ["x"]}',
            '{"e": []}', '[{"x": 1}]', '{"s": "[{}]"}', '{"m": [{"a": 1}, 2]}']
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    per = {r.i: r.n for r in records.unwrap_records(df).groupBy("i").agg(F.count("*").alias("n")).collect()}
    assert per == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1}


def test_delimited_with_a_bad_row(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a;b\n1;"x;y"\n2;3;4\n5\n')
    good, bad = files.read_delimited(spark, str(p))
    assert [(r.a, r.b) for r in good.orderBy("record_no").collect()] == [("1", "x;y"), ("5", None)]
    assert [(r.record_no, r.raw) for r in bad.collect()] == [(3, "2;3;4")] and "4" not in bad.first().warning


def test_delimited_keeps_quoted_lines_and_repeated_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿a,b\r\n\r\n1,"x\r\ny"\r\na,b\r\n2,"say ""hi"""\r\n3,5" pipe\r\n'.encode())
    (tmp_path / "b.tsv").write_text("b\tb\t\n1\t2\t3\n")
    (tmp_path / "c.csv").write_text('a|"open\n1|2\n')
    (tmp_path / "d.csv").write_text("")
    good, bad = files.read_delimited(spark, str(tmp_path))
    rows = {(r.source_file.rsplit("/", 1)[1], r.record_no): (r.a, r.b, r["b.1"], r.column_3) for r in good.collect()}
    assert rows == {("a.csv", 3): ("1", "x\r\ny", None, None), ("a.csv", 4): ("a", "b", None, None), ("a.csv", 5): ("2", 'say "hi"', None, None),
                    ("a.csv", 6): ("3", '5" pipe', None, None), ("b.tsv", 2): (None, "1", "2", "3")}
    assert [(r.source_file.rsplit("/", 1)[1], r.raw) for r in bad.collect()] == [("c.csv", 'a|"open\n1|2')]


@pytest.mark.parametrize("size", [150, 400])
def test_delimited_in_many_splits(spark, tmp_path, size):
    """Splits of a few bytes start anywhere: in quotes, between doubled quotes, inside of an empty line."""
    rnd = random.Random(size)
    rows = [[str(i), "".join(rnd.choice(['"', "\n", ",", "a", "é"]) for _ in range(rnd.randint(0, 90)))] for i in range(60)]
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["n", "text"], *rows])
    with small_splits(spark, size):
        good, bad = files.read_delimited(spark, str(tmp_path))
        assert [[r.n, r.text] for r in good.orderBy("record_no").collect()] == rows
        assert [r.record_no for r in good.orderBy("record_no").collect()] == list(range(2, 62)) and bad.isEmpty()


@contextlib.contextmanager
def small_splits(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("size", [23, 100_000])
def test_json_arrays_in_many_splits(spark, tmp_path, size):
    rnd = random.Random(size)

    def value(depth: int):
        kind = rnd.randint(0, 5)
        if kind == 0 and depth < 3:
            return [value(depth + 1) for _ in range(rnd.randint(0, 3))]
        if kind == 1 and depth < 3:
            return {f'k{i}"': value(depth + 1) for i in range(rnd.randint(0, 3))}
        return rnd.choice([1, None, True, 'a,b "q" \\', "[", "]}", "é,", "", 2.5])

    items = [value(0) for _ in range(25)]
    (tmp_path / "a.json").write_text(" " + json.dumps(items, ensure_ascii=False))
    (tmp_path / "b.json").write_text("﻿" + json.dumps(items[:5], indent=1) + "\n")
    (tmp_path / "c.json").write_text('{"one": "a, b", "l": [1, 2]}\n')
    (tmp_path / "d.json").write_text("[]")
    (tmp_path / "e.json").write_text("[1, {2, 3]")
    (tmp_path / "f.jsonl").write_text('{"a": 1}\n\nx\n{"a": 2}\n')
    with small_splits(spark, size):
        found, warnings = records.read_records(spark, str(tmp_path))
        got = {}
        for r in sorted(found.collect(), key=lambda r: r.record_no):
            got.setdefault(r.source_file.rsplit("/", 1)[1], []).append(json.loads(r.raw))
        assert got["a.json"] == items and got["b.json"] == items[:5]
        assert got["c.json"] == [{"one": "a, b", "l": [1, 2]}] and "d.json" not in got and got["f.jsonl"] == [{"a": 1}, {"a": 2}]
        assert {r.source_file.rsplit("/", 1)[1] for r in warnings.collect()} == {"e.json", "f.jsonl"}


def test_flatten_two_thousand_levels(spark):
    deep, far = "[" * 2000 + "1" + "]" * 2000, "[" * 60_000 + "1" + "]" * 60_000
    got = flat(spark, deep, far, "{nothing")
    assert len(got[0]) == 2001 and got[0]["value" + "[0]" * 2000] == "1"
    assert got[1] == {"value": far} and got[2] == {"value": "{nothing"}


def test_file_listing(spark, tmp_path):
    (tmp_path / "Tax_invoice.PDF").write_bytes(b"1234")
    (tmp_path / "x.unknownext").write_bytes(b"1")
    got = {r.path.rsplit("/", 1)[1]: (r.category, r.size_bytes, r.keyword_hits) for r in files.file_metadata(spark, str(tmp_path)).collect()}
    assert got == {"Tax_invoice.PDF": ("pdf", 4, ["invoice", "tax"]), "x.unknownext": ("unknown", 1, [])}


def test_html(spark):
    html = ("<html><head><title> T &amp; x </title><style>p{}</style></head><body><h1>A<b>b</b></h1><script>var t='</p>';</script>"
            "<p>one <i>two</i> three</p><ul><li>l</li></ul><!-- <p>gone</p> --><table><tr><th>h</th></tr><tr></tr><tr><td>1</td></tr></table></body></html>")
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert [(r.kind, r.text) for r in markup.html_blocks(df).orderBy("ordinal").collect()] == [
        ("heading", "T & x"), ("heading", "Ab"), ("paragraph", "onetwothree"), ("paragraph", "l"), ("paragraph", "1")]
    assert [(r.row_no, r.value) for r in markup.html_tables(df).orderBy("row_no").collect()] == [(0, "h"), (1, "1")]


def test_html_structure():
    def paragraphs(page):
        return [t for k, t in markup.page_blocks(page) if k == "paragraph"]

    assert paragraphs("<ul><li>a<ul><li>b</li></ul>c</li></ul><li>d") == ["abc", "b", "d"]
    assert paragraphs("<p>one<p>two</p></div>three") == ["one", "two"]
    assert paragraphs("<p>&#8364;&euro;&#x41; &amp;amp; x&nbsp;</p>") == ["€€A &amp; x"]
    assert paragraphs('<p title="a>b">x<!-- <p>no</p> --> y</p><noscript><p>no</p></noscript><script>"</p><p>no"</script><p>z') == ["xy", "z"]
    assert markup.page_blocks("<title>A &lt; B</title><h2>h</h2><title>no</title>")[:2] == [("heading", "A < B"), ("heading", "h")]
    assert markup.page_cells("<table><tr><td>1<td>2<tr><td>3</table>") == [(0, 0, 0, "1"), (0, 0, 1, "2"), (0, 1, 0, "3")]
    inner = "<table><tr><td>x</td></tr></table>"
    assert markup.page_cells(f"<table><tr><td>a{inner}</td></tr></table>") == [(0, 0, 0, "ax"), (0, 0, 1, "x"), (0, 1, 0, "x"), (1, 0, 0, "x")]


@pytest.mark.parametrize("piece", ["<p>", "<li>x", "<tr><td>1", "<b><p>x", "<!-- ", "<script>", "<a href='", "</p>", "&#", "<td><table><tr>"])
def test_html_of_unclosed_tags_takes_its_length(piece):
    page = piece * (60 if "table" in piece else 200_000 // len(piece))
    start = time.perf_counter()
    markup.page_blocks(page), markup.page_cells(page)
    assert time.perf_counter() - start < 5


def test_xml_depth_and_errors(spark):
    deep = "<a>" * 60 + "x" + "</a>" * 60
    df = spark.createDataFrame([(1, '<r xmlns="u"> t <b>1</b></r>'), (2, "<r><b></r>"), (3, deep)], "i int, raw string")
    rows = markup.xml_blocks(df).collect()
    assert [r.text for r in rows if r.i == 1] == ["r: t", "b: 1"]
    assert "parse error" in rows[2].warning and "50 levels" in [r for r in rows if r.i == 3][0].warning


def test_mail(spark):
    raw = ("From: a@x.org\nTo: b@x.org\nSubject: Hi\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=B\n\n--B\n"
           "Content-Type: text/html; charset=utf-8\n\n<p>Hello <b>you</b></p>\n--B\nContent-Type: text/plain\n"
           "Content-Disposition: attachment; filename=n.txt\n\nx\n--B--\n")
    r = containers.email_messages(spark.createDataFrame([(1, raw)], "i int, raw string")).first()
    assert (r.sender, r.subject, r.attachments, r.body) == ("a@x.org", "Hi", 1, "Helloyou")


def test_archives(spark):
    def zipped(members):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n, d in members:
                z.writestr(n, d)
        return b.getvalue()

    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("in.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    nested = zipped([("d.txt", "deep")])
    for _ in range(3):
        nested = zipped([("n.zip", nested)])
    many = zipped([(f"{i}.txt", "x") for i in range(501)])
    df = spark.createDataFrame([("a.tgz", tar.getvalue()), ("n.zip", nested), ("bad.zip", b"junk"), ("many.zip", many)], "path string, content binary")
    rows = containers.expand_archives(df).collect()
    assert [(r.member, bytes(r.content)) for r in rows if r.archive == "a.tgz"] == [("in.txt", b"hi")]
    assert [r.warning for r in rows if r.archive == "n.zip"] == ["n.zip: nesting limit (3) reached"]
    assert "no known archive" in [r for r in rows if r.archive == "bad.zip"][0].warning
    big = [r for r in rows if r.archive == "many.zip"]
    assert sum(r.warning is None for r in big) == 500 and "limit reached" in big[-1].warning


def test_job_tables_and_sum(spark):
    df = spark.createDataFrame([("Al", "$1.50"), ("Bo", "N/A"), ("Cy", "2")], "customer string, `total amt` string")
    store = JobTables(spark, "t1")
    assert store.manifest().count() == 0
    assert store.register("in/Orders 2024.json", df, "json") == "orders_2024"
    assert store.register("other/Orders 2024.json", df, "json") == "orders_2024_2"
    assert store.register("empty.csv", df.limit(0)) is None
    assert spark.table("job_t1.orders_2024").agg(F.sum("total_amt")).first()[0] == 3.5
    assert {r.table_name: r.row_count for r in store.manifest().collect()} == {"orders_2024": 3, "orders_2024_2": 3}
    assert JobTables(spark, "t1").register("x/manifest.csv", df) == "manifest_2"  # the store's own table


def test_stored_values_that_do_not_fit(spark):
    df = spark.createDataFrame([("12345678901234567890123", "1"), ("5", "2")] + [("7", "3")] * 8 + [("7", "x")], "big string, n string")
    store = JobTables(spark, "t2")
    name = store.register("wide.csv", df)
    row = store.manifest().first()
    assert [(c.name, c.type) for c in row.columns] == [("big", "REAL"), ("n", "INTEGER")] and row.rejected == 1
    assert store.table(name).agg(F.max("big")).first()[0] == 12345678901234567890123.0


def test_names_are_claimed_by_one_writer(spark):
    from concurrent.futures import ThreadPoolExecutor

    fields = spark.createDataFrame([("1",)], "a string").schema
    spark.sql("CREATE SCHEMA IF NOT EXISTS lib_claims")
    with ThreadPoolExecutor(4) as pool:
        names = list(pool.map(lambda i: claim(spark, "lib_claims", "same.csv", None, "dataset", fields), range(6)))
    assert sorted(names) == ["same", "same_2", "same_3", "same_4", "same_5", "same_6"]


def test_library_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"n{i}") for i in range(60)], "id string, name string").coalesce(1)
    lib = Library(spark, "lib_test")
    assert lib.list().count() == 0
    a, b = lib.save("j1", "a.csv", df), lib.save("j2", "a.csv", df)
    assert [r.table_name for r in lib.list("j2").collect()] == ["a_2"] and lib.list().count() == 2
    assert [r.id for r in lib.rows(a, 5, 50).collect()] == [50, 51, 52, 53, 54]
    assert lib.rows(a, None, 58).count() == 2 and lib.rows("nope") is None
    assert lib.export_csv(b, str(tmp_path / "out")) and spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 60
    assert lib.delete(a) and not lib.delete(a) and lib.list().count() == 1
    assert page(spark.range(10), "id", 3, 4).count() == 3


def test_result_files_and_delete(spark, tmp_path):
    pii = spark.createDataFrame([("high", "EMAIL", "a*b", "f", None)], "severity string, category string, value_redacted string, source_file string, location string")
    exports.write_results(str(tmp_path / "res"), "j1", {"pii": pii, "other": pii})
    exports.write_results(str(tmp_path / "res"), "j2", {"pii": pii})
    assert exports.delete_job(spark, str(tmp_path / "res"), "j1") == ["other", "pii"]
    assert [r.job_id for r in spark.read.json(str(tmp_path / "res" / "pii")).collect()] == ["j2"]
    exports.write_pii(pii, str(tmp_path / "pii.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "pii.csv")).columns[:2] == ["severity", "category"]
    exports.write_graph(pii, pii, str(tmp_path / "res"), "j2")
    assert spark.read.json(str(tmp_path / "res" / "edges")).count() == 1
    assert exports.delete_job(spark, str(tmp_path / "res"), "j2") == ["edges", "nodes", "pii"]
    assert exports.write_tables({"t1": ("My table/1", pii), "t2": (None, pii)}, str(tmp_path))[0].endswith("My_table_1_t1.csv")


def result_lines():
    out = []
    for i in range(40):
        base = {"job_id": f"j{i % 2}", "source_file": f"f{i}", "ordinal": i}
        out.append([
            {**base, "kind": "entities", "name": f"Person {i % 7}", "type": "PERSON", "confidence": i / 100},
            {**base, "kind": "relations", "source_entity": f"Person {i % 7}", "target_entity": f"Person {i % 5}",
             "relation_type": "PAID", "evidence": f"e{i}", "confidence": 0.5},
            {**base, "kind": "pii", "finding_id": f"p{i % 9}", "category": "EMAIL", "severity": "low", "subject_entity": f"Person {i % 7}"},
            {**base, "kind": "chunks", "chunk_id": f"c{i % 11}", "text": f"about Person {i % 7} and Person {i % 3}"},
        ])
    return out


def test_incremental_ingest_equals_one_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i, lines in enumerate(result_lines()):
        (src / f"r{i:03d}.json").write_text("\n".join(json.dumps(x) for x in lines))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    assert ingest.ingest_stream(spark, str(src), out, check, files_per_batch=15, max_batches=1) == 1
    assert ingest.ingest_stream(spark, str(src), out, check, files_per_batch=15) == 2  # goes on where it stopped
    assert ingest.ingest_stream(spark, str(src), out, check, files_per_batch=15) == 0
    got = ingest.read_graph(spark, out)
    every = spark.read.schema(ingest.RESULT_SCHEMA).json(str(src))
    rows = {k: every.filter(F.col("kind") == k).select(*f) for k, f in ingest.FIELDS.items()}
    nodes = G.upsert_entities(None, rows["entities"])
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    assert same(nodes, got["nodes"])
    keys = ["job_id", "source", "target", "type"]
    assert same(G.upsert_relations(None, rows["relations"], nodes).select(keys), got["edges"].select(keys))
    chunks = G.upsert_chunks(None, rows["chunks"])
    assert {r.name for r in got["mentions"].collect()} == {r.name for r in G.mentions(chunks, nodes).collect()}
    assert got["has_pii"].count() > 0


def test_levels_of_parts_and_replay(spark, tmp_path):
    rows = [json.loads(x) for lines in result_lines() for x in map(json.dumps, lines)]
    every = spark.createDataFrame([tuple(r.get(f.name) for f in spark.createDataFrame([], ingest.RESULT_SCHEMA).schema) for r in rows],
                                  ingest.RESULT_SCHEMA)
    out = str(tmp_path / "out")
    parts = [every.filter(F.col("ordinal") % 18 == b) for b in range(18)]
    for b in range(18):
        ingest.merge_batch(parts[b], out, b)
    names = [p.split("relations/")[1] for p in ingest.complete_parts(spark, out, "relations")]
    assert names == ["level=2/part=0", "level=0/part=16", "level=0/part=17"]
    before = {k: sorted(map(str, v.collect())) for k, v in ingest.read_graph(spark, out).items()}
    ingest.merge_batch(parts[15], out, 15)  # a replayed batch rewrites its own parts
    assert before == {k: sorted(map(str, v.collect())) for k, v in ingest.read_graph(spark, out).items()}
    ingest.merge_batch(every, str(tmp_path / "one"), 0)
    one = ingest.read_graph(spark, str(tmp_path / "one"))
    assert before["nodes"] == sorted(map(str, one["nodes"].collect()))
    assert len(before["edges"]) == one["edges"].count() and len(before["chunks"]) == one["chunks"].count()


def test_ingest_failures_come_through(spark, tmp_path, monkeypatch):
    src = tmp_path / "in"
    src.mkdir()
    for i, lines in enumerate(result_lines()[:6]):
        (src / f"r{i}.json").write_text("\n".join(json.dumps(x) for x in lines))
    real, seen = ingest.merge_batch, []

    def fails_late(batch, out, batch_id):
        seen.append(batch_id)
        if len(seen) == 2:
            raise RuntimeError("disk full")
        real(batch, out, batch_id)

    monkeypatch.setattr(ingest, "merge_batch", fails_late)
    with pytest.raises(Exception, match="disk full"):
        ingest.ingest_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "check"), files_per_batch=2, max_batches=2)


def test_file_queries_whatever_the_scan(spark, tmp_path, monkeypatch):
    """Events in several files, arrays of few events; and headers that come behind the customer of their number."""
    import compare
    import os

    from sheafwork.plans import QUERIES, store_queries
    from sheafwork.plans.registry import Tables

    for f in os.listdir("/root/testdata/sf0.001"):
        if f != "events.parquet":
            os.symlink(f"/root/testdata/sf0.001/{f}", tmp_path / f)
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(store_queries, "EVENTS_AN_ARRAY", 300, raising=False)
    header, rows = store_queries._LINES.split("UNION ALL ")
    monkeypatch.setattr(store_queries, "_LINES", f"SELECT * FROM (SELECT {rows.strip()[7:]}) AS x(file, line, value) UNION ALL {header}")
    con = compare.duck_tables("/root/testdata/sf0.001")
    for name in ("json_file_records", "delimited_rows"):
        df = QUERIES[name].run(Tables(spark, str(tmp_path)))
        got = [tuple(r) for r in df.collect()]
        cur = con.execute(QUERIES[name].oracle)
        columns, want = [d[0] for d in cur.description], cur.fetchall()
        assert compare.rows_of(df.columns, got) == compare.rows_of(columns, want), name


def test_paths_are_counted_within_tasks(spark):
    """The tie of a path goes by its first row, and no task sorts the flattened rows."""
    rows = [(i % 7 or None, json.dumps({k: 1 for k in random.Random(i).sample("abcdef", 4)} | {"a.b": 1, "a": {"b": 2}})) for i in range(500)]
    flat = records.flatten_json(spark.createDataFrame(rows, "record_no bigint, raw string").repartition(5))
    want = {}
    for r in flat.collect():
        n, first = want.get(r.path, (0, None))
        place = (r.record_no is not None, r.record_no, r.ord)
        want[r.path] = n + 1, place if first is None else min(first, place)
    found = records.key_frequency(flat)
    order = sorted(want.items(), key=lambda x: (-x[1][0], *x[1][1]))
    assert [(r.path, r.records) for r in found.collect()] == [(p, n) for p, (n, _) in order]
    assert found._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 2


def test_result_batches_are_written_by_many_tasks(spark, tmp_path):
    from sheafwork.plans import store_queries
    from sheafwork.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = store_queries.result_batches(t, str(tmp_path / "in"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [len(list((tmp_path / "in" / f"part={p}").glob("*.json"))) for p in range(5)] == [files] * 5 and files > 1
    rows = spark.read.json(str(tmp_path / "in"))
    assert rows.count() == t.sql(store_queries.I.ENTITIES).count() + t.sql(store_queries.I.RELATIONS).count()


def test_results_are_compressed(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id", "concat('order of the month ', id % 7) AS detail")
    exports.write_results(str(tmp_path), "j1", {"pii": rows})
    size = sum(f.stat().st_size for f in (tmp_path / "pii").rglob("part-*"))
    assert size < 5000 * 10 and spark.read.json(str(tmp_path / "pii")).agg(F.sum("id")).first()[0] == 4999 * 2500


def test_tables_are_typed_in_one_pass(spark):
    """Types and the number of lost values are those of the long form; no value is shuffled by itself."""
    from sheafwork.operators import tabular
    from sheafwork.sinks.stores import typed_copy

    rows = [(str(i) if i % 20 else "five", "9" * 25 if i == 3 else str(i), "$ 1.5" if i % 3 else None, "x" if i % 2 else "7", "n/a") for i in range(200)]
    df = spark.createDataFrame(rows, "a string, `b c` string, d string, e string, f string")
    cells = tabular.unpivot_cells(df.withColumn("_row", F.monotonically_increasing_id()), "", "", "_row", df.columns)
    kinds = tabular.infer_types(cells)
    got = {r.col_idx: (r.filled, r.ints, r.reals, r.storage_type) for r in tabular.wide_types(df)}
    assert got == {r.col_idx: (r.filled, r.ints, r.reals, r.storage_type) for r in kinds.collect()}
    typed, listed, lost, n = typed_copy(df)
    assert listed == [("a", "INTEGER"), ("b_c", "REAL"), ("d", "REAL"), ("e", "TEXT"), ("f", "TEXT")]
    assert n == lost.count() == tabular.rejects(cells, kinds).count() == 10 and typed.count() == 200


def test_values_of_a_record_meet_in_their_task(spark):
    """Records in pieces, repeated paths, null keys and null values give the largest value of each path; a run is one row."""
    import pyarrow as pa

    rows = [(1, "a", "x"), (1, "b", "y"), (2, "a", "p"), (1, "a", "z"), (None, "b", "n"), (None, "a", None), (2, "a", "q"), (2, "a", "o"), (3, "c", "r")]
    flat = spark.createDataFrame([(*r, [i]) for i, r in enumerate(rows)], "record_no long, path string, value string, ord array<int>").coalesce(1)
    got = {r.record_no: (r.a, r.b, r.c) for r in records.records_to_table(flat, ["record_no"]).collect()}
    assert got == {1: ("z", "y", ""), 2: ("q", "", ""), None: ("", "n", ""), 3: ("", "", "r")}
    batch = pa.RecordBatch.from_pydict({"k": [7] * 50 + [8] * 50, "path": [f"p{i % 50}" for i in range(100)], "value": ["v"] * 100})
    assert [b.num_rows for b in records.run_pivoter(["k"], ["p1", "p2"], ["k", "_v0", "_v1"])(iter([batch]))] == [2]


def test_ocr_lines_shuffle_pieces_of_lines_not_words(spark):
    rows = [(k, line, 10 * line + i, f"w{i}", 50) for k in ("a", "b") for line in range(500) for i in range(10)]
    rows += [("c", 0, 2, "two", 40), ("c", 0, 1, " one word ", -1), ("c", 0, 1, "also", 20), ("c", 0, 3, "three", None), ("c", 0, 4, " ", 9)]
    rows += [("d", None, 7, "x", None), (None, 1, None, "y", 30), (None, 1, 0, "z", 10)]
    words = spark.createDataFrame(rows, "k string, line int, word_no int, word string, conf int").coalesce(1)
    got = {(r.k, r.line): (r.text, r.confidence, r.kind) for r in layout.ocr_lines(words, ["k", "line"]).collect()}
    assert len(got) == 1003 and got["a", 499] == (" ".join(f"w{i}" for i in range(10)), 0.5, "ocr")
    assert got["c", 0] == ("also one word two three", 0.2, "ocr")
    assert got["d", None] == ("x", None, "ocr") and got[None, 1] == ("y z", 0.2, "ocr")
    assert len([b for b in layout._line_pieces(words.filter("k = 'a'").withColumn("conf", F.col("conf").cast("double"))
                                               .toArrow().to_batches())][0]) == 500  # noqa: SLF001


def test_record_table_has_a_column_for_every_path(spark):
    from sheafwork.plans import QUERIES
    from sheafwork.plans.registry import Tables

    folder = "/root/testdata/sf0.001"
    most = spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_orderkey").count().agg(F.max("count")).first()[0]
    table = QUERIES["records_to_table"].run(Tables(spark, folder))
    assert len(table.columns) == 7 + 3 * most and f"lines[{most - 1}].flag" in table.columns


def test_html_query_leaves_cut_references_as_its_statement_does(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    page = "<title>a &amp;&amp; b&amp</title><h1>&lt;x&gt &#65; &#66 &amp</h1><p>&eacute &amp;amp &nope; &am</p>"
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in entry.queries()["html_blocks"](spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert [r[3] for r in got] == ["a && b&amp", "<x&gt A &#66 &amp", "&eacute &amp &nope; &am"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT 1 AS page_id, ? AS html", [page.replace("&#65;", "A")])
    assert got == sorted(con.execute(entry.oracle_sql()["html_blocks"]).fetchall())
    whole = markup.html_blocks(spark.createDataFrame([(1, page)], "page_id long, html string")).orderBy("ordinal").collect()
    assert whole[0].text == "a && b&"


def test_result_lines_are_compressed_and_only_wanted_kinds_are_read(spark, tmp_path):
    from sheafwork.plans import inputs as I
    from sheafwork.plans import store_queries
    from sheafwork.plans.registry import Tables

    t, path = Tables(spark, "/root/testdata/sf0.001"), str(tmp_path / "in")
    each = store_queries.result_batches(t, path, compression="gzip")
    names = [p.name for p in (tmp_path / "in").rglob("*") if p.name.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names) and each == -(-len(names) // 5)
    every = spark.read.schema(ingest.RESULT_SCHEMA).option("recursiveFileLookup", "true").json(path)
    assert every.count() == t.sql(I.ENTITIES).count() + t.sql(I.RELATIONS).count()
    ent = every.filter("kind = 'entities'").select(*ingest.FIELDS["entities"]).withColumn("batch_id", F.lit(0).cast("long"))
    ingest.merged("entities", ent).write.parquet(ingest.part_path(str(tmp_path / "out"), "entities", 0, 0))
    graph = ingest.read_graph(spark, str(tmp_path / "out"), ("nodes",))
    assert list(graph) == ["nodes"] and graph["nodes"].count() == G.upsert_entities(None, t.sql(I.ENTITIES)).count()
