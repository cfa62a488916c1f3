from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sheafwork.functions.cells import guess_column_type
from sheafwork.operators import catalog, mapping
from sheafwork.operators import quality as Q
from sheafwork.operators import tabular as Y


def cells(spark, column, values, table="t"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id int, v string")
    return Y.unpivot_cells(df.withColumnRenamed("v", column), f"{table}.csv", table, "row_id", [column])


def quality(spark, column, values):
    return Q.column_quality(Q.column_stats(cells(spark, column, values))).first()


def test_quantity_with_a_word(spark):
    q = quality(spark, "quantity", ["3", "five", "2", "1"])
    assert (q.inferred_type, q.type_consistency) == ("number", 0.75)
    assert q.issues == ["25% of values are not of type 'number'"]


def test_two_values_are_not_flagged(spark):
    assert quality(spark, "quantity", ["3", "five"]).issues == []


def test_clean_quantity(spark):
    q = quality(spark, "quantity", ["3", "2", "1"])
    assert q.type_consistency == 1.0 and q.issues == []


def test_mixed_and_clean_booleans(spark):
    mixed = quality(spark, "is_paid", ["True", "yes", "False", "1"])
    assert mixed.inferred_type == "boolean" and mixed.type_consistency == 0.5 and mixed.issues
    clean = quality(spark, "subscribed", ["yes", "no", "yes", "yes"])
    assert (clean.inferred_type, clean.type_consistency) == ("boolean", 1.0)
    assert quality(spark, "is_active", ["true", "false", "true"]).inferred_type == "boolean"
    assert quality(spark, "delta_x", ["0", "1", "3", "2", "1", "0", "5"]).inferred_type == "number"


def test_traps_of_name_rules(spark):
    names = {"country": "number", "hotel": "phone", "width": "date", "CustomerID": "text", "customer_id": "id"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select("n", guess_column_type(F.col("n"), F.lit(1), F.lit(0), F.lit(0)).alias("k")).collect()
    assert {r.n: r.k for r in got} == names


def test_constant_null_and_garbage(spark):
    q = quality(spark, "note", ["x"] * 6 + ["N/A"] * 3 + ["####"])
    assert q.issues == ["30% empty", "10% unusable values", "one value only ('x')"]
    assert quality(spark, "note", ["数据"] * 3).garbage_rate == 1.0


def test_type_is_guessed_from_all_values(spark):
    assert quality(spark, "note", ["x"] * 20 + [str(i) for i in range(200)]).inferred_type == "number"


def test_wide_integers_are_not_lost(spark):
    rows = cells(spark, "n", ["1", "2", "99999999999999999999", "4"])
    kinds = Y.infer_types(rows)
    assert kinds.first().storage_type == "REAL" and Y.rejects(rows, kinds).count() == 0
    forced = kinds.withColumn("storage_type", F.lit("INTEGER"))
    assert [r.value for r in Y.rejects(rows, forced).collect()] == ["99999999999999999999"]


def test_table_names_never_repeat(spark):
    files = ["a.csv", "x/a.csv", "a_2.csv", "y/a.csv", "b.csv", "a_2_2.csv", "z/a_2.csv"]
    df = spark.createDataFrame([(f, None, i) for i, f in enumerate(files)], "source_file string, sheet string, ordinal int")
    got = [r.table_name for r in Y.table_names(df).orderBy("ordinal").collect()]
    assert len(set(got)) == len(files) and got[:4] == ["a", "a_2", "a_2_2", "a_3"]


def test_typing(spark):
    rows = cells(spark, "amt", ["$1,234.50", "(250)", "N/A", "12", "1", "2", "3", "4", "5", "oops", "6"])
    kind = Y.infer_types(rows).first()
    assert kind.storage_type == "REAL" and kind.filled == 10 and kind.reals == 9
    wide = spark.createDataFrame([("$1,234.50",), ("(250)",), ("N/A",), ("oops",)], "amt string")
    got = [r.amt for r in Y.type_table(wide, {"amt": "REAL"}).collect()]
    assert got == [1234.5, -250.0, None, None]
    assert Y.rejects(rows, Y.infer_types(rows)).select("value").first()[0] == "oops"


def test_duplicate_rows(spark):
    df = spark.createDataFrame([("a", "1"), ("A ", "1"), ("", " "), ("", ""), ("b", "2")], "x string, y string")
    r = Q.duplicate_rows(df.withColumn("t", F.lit("t")), ["x", "y"], ["t"]).first()
    assert (r.row_count, r.duplicate_rows, r.duplicate_rate) == (5, 1, 0.2)


def brute_force_joins(tables):
    """Brute force over python sets: shared values and Jaccard for every column pair."""
    out = set()
    cols = [(t, i, c, {v.strip().lower() for v in vals if v}) for t, cs in tables for i, (c, vals) in enumerate(cs)]
    for x in range(len(cols)):
        for y in range(x + 1, len(cols)):
            (ta, _, ca, va), (tb, _, cb, vb) = cols[x], cols[y]
            if ta != tb and ca == cb and len(va & vb) >= 2 and len(va & vb) / len(va | vb) >= 0.05:
                out.add((ta, tb, ca, len(va & vb)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_join_discovery_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    tables = [(no, [(f"key{i}", [str(rnd.randint(0, 30)) for _ in range(rnd.randint(3, 25))]) for i in range(2)]) for no in range(5)]
    data = [(f"f{no}.csv", f"t{no}", no, "csv", r, i, c, v) for no, cols in tables for i, (c, vals) in enumerate(cols) for r, v in enumerate(vals)]
    long = spark.createDataFrame(data, "source_file string, table_id string, table_no int, category string, row_id long, col_idx int, column string, value string")
    meta = spark.createDataFrame([(f"f{no}.csv", f"t{no}", no, "csv", max(len(v) for _, v in cols), None) for no, cols in tables],
                                 "source_file string, table_id string, table_no int, category string, n_rows int, label string")
    want = {}
    for ta, tb, c, n in sorted(brute_force_joins(tables), key=lambda j: (j[0], j[1], j[2])):
        want.setdefault((ta, tb), (c, n))
    got = {tuple(sorted((r.child_no, r.parent_no))): (r.target, r.shared) for r in mapping.find_joins(long, meta).collect()}
    assert got == want


def test_archetypes(spark):
    df = spark.createDataFrame([(["customer_id", "email"],), (["x", "y"],), (["order_id", "amount"],)], "c array<string>")
    assert [r.e for r in df.select(mapping.classify_entity(F.col("c")).alias("e")).collect()] == ["Customer", None, "Transaction"]


def test_union_matches_by_name(spark):
    a = spark.createDataFrame([("1", "2.5")], "CustID string, Amt string")
    b = spark.createDataFrame([("7.0", "9")], "total string, client_id string")
    got, lost = catalog.union_group([a, b])
    assert sorted((r.customer_id, r.amount) for r in got.collect()) == [(1, 2.5), (9, 7.0)] and lost.isEmpty()
    many = spark.createDataFrame([("1", "2.5")] * 9 + [("x1", None)], "CustID string, Amt string")
    got, lost = catalog.union_group([many, b])
    assert dict(got.dtypes) == {"customer_id": "bigint", "amount": "double"} and got.count() == 11
    assert [(r.column, r.value, r.n) for r in lost.collect()] == [("customer_id", "x1", 1)]


def test_file_score(spark):
    data = [("a", "csv", 6, False, None, True, 1, 1, 0.0), ("b", "pdf", 0, False, 0.5, False, 0, 0, 0.0), ("c", "pdf", 0, True, None, True, 0, 0, 5.0)]
    df = spark.createDataFrame(data, "source_file string, category string, errors int, unreachable boolean, ocr_confidence double, "
                               "text_present boolean, n_tables int, yielded int, penalty double")
    got = {r.source_file: (r.score, r.completeness) for r in Q.file_quality(df).collect()}
    assert got == {"a": (40.0, "Partial"), "b": (50.0, "Partial"), "c": (95.0, "Complete")}


def test_results_do_not_depend_on_partitioning(spark):
    rnd = random.Random(1)
    values = [rnd.choice(["1", "x", "N/A", "####", "2.5", "yes"]) for _ in range(500)]
    base = cells(spark, "col", values)
    one = Q.column_stats(base.coalesce(1)).collect()
    many = Q.column_stats(base.repartition(13)).collect()
    assert one == many


def test_typing_shuffles_no_values(spark):
    rows = [("f", "t", 0, "n", i, str(i)) for i in range(20)] + [("f", "t", 0, "n", 20, "lost"), ("f", "t", 0, "n", 21, "n/a")]
    rows += [("f", "t", 1, "w", i, "x") for i in range(20)]
    cells = spark.createDataFrame(rows, "source_file string, table_id string, col_idx int, column string, row_id long, value string")
    types = Y.infer_types(cells)
    assert [(r.col_idx, r.storage_type) for r in types.orderBy("col_idx").collect()] == [(0, "INTEGER"), (1, "TEXT")]
    assert types._jdf.queryExecution().sparkPlan().toString().count("Aggregate") == 2
    lost = Y.rejects(cells, types)
    assert [(r.col_idx, r.row_id, r.value, r.storage_type) for r in lost.collect()] == [(0, 20, "lost", "INTEGER")]
    assert "SortMergeJoin" not in lost._jdf.queryExecution().sparkPlan().toString()


def test_mapping_rows_makes_headers_once(spark, monkeypatch):
    from sheafwork.operators import mapping
    from sheafwork.plans import QUERIES
    from sheafwork.plans.registry import Tables

    calls, headers = [], mapping.headers
    monkeypatch.setattr(mapping, "headers", lambda cells: calls.append(1) or headers(cells))
    assert QUERIES["mapping_rows"].run(Tables(spark, "/root/testdata/sf0.001")).count() == 24
    assert len(calls) == 1
