from __future__ import annotations

import dataclasses
import random
import re

import pytest
from pyspark.sql import functions as F

from sheafwork.functions import ids
from sheafwork.functions.text import keyword_hits, redact, sanitize_ident, standardize_column
from sheafwork.operators import sensitive as S
from sheafwork.operators import text as X

CARDS = ("4532015112830366", "4222222222222", "5425233430109903", "374245455400126", "6011111111111117",
         "30569309025904", "3530111333300000", "6212345678901232")


def found(spark, text):
    return [(r.category, r.location) for r in S.detect_pii(spark.createDataFrame([(text,)], "text string")).collect()]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_emirates_id_is_not_a_card(spark):
    cats = [c for c, _ in found(spark, "ID: 784-1985-9876543-2")]
    assert "EMIRATES_ID" in cats and "CREDIT_CARD" not in cats


@pytest.mark.parametrize("number", CARDS)
def test_real_cards(spark, number):
    assert "CREDIT_CARD" in [c for c, _ in found(spark, f"card {number} on file")]


def test_luhn_without_issuer_is_no_card(spark):
    assert "CREDIT_CARD" not in [c for c, _ in found(spark, "ref 700000000000003")]


def test_cpf_and_blank(spark):
    text = "CPF 529.982.247-25 e 111.444.777-35"
    assert sum("CPF" in loc for _, loc in found(spark, text)) == 2
    assert found(spark, "") == [] and found(spark, "   ") == []


def test_published_examples(spark):
    mrz = ("P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<\r\nL898902C36UTO7408122F1204159ZE184226B<<<<<10")
    assert ("PASSPORT", ids.LOCATION["mrz"]) in found(spark, "x\n" + mrz)
    assert ("IBAN", ids.LOCATION["iban"]) in found(spark, "pay gb82 west 1234 5698 7654 32 by Friday")
    assert ("NATIONAL_ID", ids.LOCATION["cn_id"]) in found(spark, "11010519491231002X")
    assert ("NATIONAL_ID", ids.LOCATION["za_id"]) in found(spark, "8001015009087")
    assert ("NATIONAL_ID", ids.LOCATION["sin"]) in found(spark, "046 454 286")
    assert ("NATIONAL_ID", ids.LOCATION["aadhaar"]) in found(spark, "2341 2341 2346")
    assert found(spark, "123-45-6789") and not found(spark, "000-45-6789 666-45-6789 912-45-6789 123-00-6789 123-45-0000")


def test_word_boundaries_survive_the_cut(spark):
    """The scan over candidate pieces finds what a scan over the whole text finds, letters next to digits included."""
    texts = ["a4532015112830366", "é4532015112830366", "4532015112830366x", "(4532 0151-1283 0366)", "id=046454286;046454286",
             "ßAB12 4532015112830366/8001015009087", "\t11010519491231002x, 529.982.247-25.", "1234 4532015112830366 77",
             "GB82WEST12345698765432", "äGB82 WEST 1234 5698 7654 32", "x_046454286 046454286_ 046.454.286"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    whole = {n: dataclasses.replace(f, source="text") for n, f in ids.FAMILIES.items()}
    narrowed, full = (sorted(map(tuple, d.collect())) for d in (S.detect_pii(df), S.scan(df, whole)))
    assert narrowed == full and narrowed


def test_redact(spark):
    assert column(spark, ["a", "ab", "abc", "  4532  "], redact) == ["*", "**", "a*c", "4**2"]


def test_names(spark):
    got = column(spark, ["CustID", "customer_id", "Cust ID", "Total Amt", "qtyQuantity", "--", "timestamp"], standardize_column)
    assert got == ["customer_id", "customer_id", "customer_id", "amount", "quantity", "field", "date"]
    got = column(spark, ["1st col!", "  a--b  ", "", "x" * 70], lambda c: sanitize_ident(c, F.lit("col_0")))
    assert got == ["_1st_col", "a_b", "col_0", "x" * 60]
    assert column(spark, ["Calendar.pdf", "tax_Tax_invoice"], keyword_hits) == [["nda"], ["invoice", "tax"]]


def test_chunk_windows(spark):
    words = " ".join(f"w{i}" for i in range(1000))
    rows = X.chunk_text(spark.createDataFrame([(1, words), (2, "  "), (3, "one")], "id int, text string")).orderBy("id", "chunk_no").collect()
    starts = [r.text.split()[0] for r in rows if r.id == 1]
    assert starts == ["w0", "w448", "w896"] and rows[-1].text == "one" and {r.id for r in rows} == {1, 3}
    exact = X.chunk_text(spark.createDataFrame([(1, " ".join(["x"] * 512))], "id int, text string"))
    assert exact.count() == 1


def test_greedy_batches(spark):
    blocks = ["a" * 3000, "b" * 900, "c" * 200, "d" * 9000, " ", "e" * 10]
    rows = X.batch_blocks(spark.createDataFrame([(blocks,)], "blocks array<string>")).collect()
    assert [r.batch_no for r in rows] == [0, 0, 1, 2, 3]


def test_batch_reply_must_keep_its_parts(spark):
    data = [(1, ["a", "b"], " A \n~~~~~~~~\nB"), (2, ["a", "b"], "AB"), (3, ["a"], None)]
    rows = X.apply_batches(spark.createDataFrame(data, "id int, parts array<string>, reply string")).orderBy("id", "part_no").collect()
    assert [(r.id, r.text, r.translated) for r in rows] == [
        (1, "A", True), (1, "B", True), (2, "a", False), (2, "b", False), (3, "a", False)]


def test_paragraph_fallback_to_line_groups(spark):
    text = "\n".join(f"line {i}" for i in range(95))
    rows = X.text_paragraphs(spark.createDataFrame([(text,), ("a\n\n \nb",), (" ",)], "text string")).collect()
    assert [len(r.text.split("\n")) for r in rows] == [40, 40, 15, 1, 1]


def test_segment_limit_is_optional(spark):
    df = spark.createDataFrame([("x" * 100_001,)], "text string")
    assert X.segment_text(df).count() == 13 and X.segment_text(df, max_segments=12).count() == 12


def test_embedding_function_is_pluggable(spark):
    df = spark.createDataFrame([("ab",), ("abc",)], "text string")
    got = X.embed(df, lambda s: s.map(lambda t: [float(len(t)), 0.0])).collect()
    assert sorted(r.embedding[0] for r in got) == [2.0, 3.0]
    unit = X.embed(df.union(df), dim=64).select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-5 or r.n == 0 for r in unit)


def test_identifiers_read_no_further_than_they_reach(spark):
    """Names are as those of the whole text; the work on a long text ends at its 61st letter or digit."""
    from sheafwork.functions.text import IDENT_HEAD

    rng = random.Random(4)
    texts = ["".join(rng.choice("aZ09__  -\n\té中😀") for _ in range(rng.randint(0, 200))) for _ in range(3000)]
    texts += [None, "", "_" * 500 + "a" * 59 + "--b", "9" * 61 + "_", " " * 70, "a_" * 80, "é" * 300 + "x" * 60 + "é"]

    def whole(text):
        s = re.sub("^_|_$", "", re.sub("_+", "_", re.sub("[^0-9a-zA-Z_]", "_", (text or "").strip(" "))))
        s = s or "col"
        return ("_" + s if s[0].isdigit() else s)[:60]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", sanitize_ident(F.col("t"), F.lit("col")).alias("x"), F.length(F.regexp_extract(F.repeat(F.lit("ab "), 1000), IDENT_HEAD, 0)).alias("n")).collect()
    assert [r.x for r in sorted(rows)] == [whole(t) for t in texts]
    assert rows[0].n < 100


def test_check_digits_need_no_strings(spark):
    """The checks of digits are arithmetic: no digit is cut out of the value, and both agree with plain Python."""
    rules = (ids.luhn_ok(), ids.verhoeff_ok(), ids.weighted((3, 2), 11))
    assert not any("substring" in r or "lpad" in r for r in rules)
    values = ["79927398713", "79927398710", "4111111111111111", "378282246310005", "6212345678901234569", "046454286", "234123412346", "234123412347"]

    def luhn(v: str) -> bool:
        d = [int(c) for c in reversed(v)]
        return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0

    def verhoeff(v: str) -> bool:
        check = 0
        for i, c in enumerate(reversed(v)):
            check = ids.VERHOEFF_D[check][ids.VERHOEFF_P[i % 8][int(c)]]
        return check == 0

    rows = spark.createDataFrame([(v,) for v in values], "v string").selectExpr(
        "v", f"named_struct({ids.halves('v')}) AS d").selectExpr("v", "d.hi", "d.lo").selectExpr(
        "v", f"{ids.luhn_ok()} AS luhn", f"{ids.verhoeff_ok()} AS verhoeff")
    for r in rows.collect():
        assert r.luhn == luhn(r.v), r.v
        if len(r.v) == 12:
            assert r.verhoeff == verhoeff(r.v), r.v
