"""Spelling variants, quality rules and fill-in-middle against brute force, and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sheafwork.llm import fill_middle, quality_rules, spelling

LOWER = {i: i + 32 for i in range(65, 91)}
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 20_000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "é 中文 ß\x00\x1c x"), (5, "x" * 100_000), (6, LONG), (7, LONG), (7, LONG), (None, "some words here and there")]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# spelling variants

def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows) -> dict:
    n = collections.Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def found(df) -> dict:
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("block", [3, 2048])
def test_variants_match_brute_force(spark, block):
    """Few letters, so that halves are shared by many words; the small block splits bins."""
    rnd = random.Random(block)
    words = ["".join(rnd.choice("abÉé") for _ in range(rnd.choice((7, 8, 8, 9)))) for _ in range(150)]
    words += [w[:i] + rnd.choice("abz") + w[i + rnd.choice((0, 1)):] for w in words[:60] for i in (0, 3, len(w))]
    texts = [(i % 50, " ".join(rnd.choices(words, [1000 / (k + 1) for k in range(len(words))], k=60))) for i in range(300)]
    got = found(spelling.group_variants(frame(spark, texts), block=block))
    assert got == brute_variants(texts)


def test_variants_without_pairs_of_halves(spark):
    rows = [(i, "winter7 abcdefg abcdefgh bcdefgh abcdefx zbcdefg abcdzefg") for i in range(3)]
    rows += [(9, "abcdefg " * 40)]
    got = found(spelling.group_variants(frame(spark, rows)))
    assert got == brute_variants(rows)
    assert got["abcdefgh"][:2] == ("abcdefg", "abcdefg") and got["abcdefg"][3] == 4


def test_roots_follow_chains(spark):
    sizes = {"aaaaaaab": 2, "aaaaaaabb": 25, "aaaaaaabbb": 300, "aaaaaaabbbb": 4000}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(sizes.items())]
    got = found(spelling.group_variants(frame(spark, rows), every=1 << 40))
    assert {w: r[:3] for w, r in got.items()} == {
        w: (f, "aaaaaaabbbb", sizes[w]) for w, f in zip(sizes, [*list(sizes)[1:], None])}


def test_variants_odd_rows(spark):
    rows = [*ODD, (8, "Ÿxxxxxxx y×÷zabcd y×÷zabcd")]
    df = frame(spark, rows).withColumn("word", F.lit("w")).withColumn("n", F.lit(1))
    assert found(spelling.group_variants(df)) == brute_variants(rows)
    assert spelling.group_variants(frame(spark, [])).collect() == []
    long = "x" * 2000
    twice = [(1, f"{long} {long} {long[:-1]} {long[:-1]}")]
    assert found(spelling.group_variants(frame(spark, twice))) == brute_variants(twice)


# quality rules

def brute_rules(text: str | None) -> tuple:
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    again = {p for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(again) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed)


def ruled(df) -> list:
    return [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed), r.kept)
            for r in quality_rules.apply_rules(df).collect()]


def test_rules_match_brute_force(spark):
    rnd = random.Random(4)
    parts = ["a", "b", "c", "\n", "\n", " ", "\t", "the", "#*", "é中", "...", "- x"]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.choice((3, 12, 60, 200))))) for i in range(200)]
    rows += [*ODD, (8, "w1 w2 w3 w4 w5 x " * 2), (9, "one one one one one one one one one one one")]
    df = frame(spark, rows).withColumn("n_words", F.lit("clash"))
    got = ruled(df)
    assert collections.Counter((d, m) for d, m, _ in got) == collections.Counter((d, brute_rules(t)) for d, t in rows)
    assert not any(k for _, m, k in got if m[5])
    assert ruled(frame(spark, [])) == []


def test_rules_verdicts(spark):
    good = "The garden of the house was quiet and the rain had come to an end before it was dark. "
    texts = {
        "": good, "symbols": "a* b* c* the# of| and& to% in$ that is for it as was ",
        "capitals": "THE GARDEN OF THE HOUSE WAS QUIET AND THE RAIN HAD COME TO AN END ",
        "stop_words": "garden house quiet rain dark morning window river mountain forest valley ",
        "bullet_lines": "- the one of\n* and the two of it\n- to that is\n• for with it as\n",
        "repeated_lines": "\n".join(["the garden of it"] * 5 + ["a b c d e f g h i j k of the and to"]),
        "ellipsis_lines": "the one of...\nand the two of it…\nto that is ... \nfor with it as on be at\n",
        "words_with_letters": "the 1 2 3 4 of 5 6 7 and 8 9 0 to in ",
        "word_length": "of " * 2 + "a b c d e f g h i j k l m n o p the ",
        "too_few_words": "the of and",
    }
    df = frame(spark, [(i, t) for i, t in enumerate(texts.values())])
    got = {r.doc_id: set(r.failed) for r in quality_rules.apply_rules(df, base=quality_rules.BASE[:1]).collect()}
    for i, name in enumerate(texts):
        assert name in got[i] if name else not got[i], (name, got[i])
    kept = quality_rules.keep_good(df.withColumn("kept", F.lit("x"))).collect()
    assert [(r.doc_id, r.text, r.kept) for r in kept] == [(0, good, "x")]


def test_rules_run_without_python(spark):
    plan = quality_rules.apply_rules(frame(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# fill in the middle

def brute_fill(doc_id, text: str | None) -> tuple:
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_matches_brute_force_and_is_undone(spark):
    rnd = random.Random(6)
    rows = [(i, "".join(rnd.choice(["a", "é中", "<", "P", ">", " ", "\n", "\x0b", "\xa0", "𝄞"]) for _ in range(rnd.randint(0, 40)))) for i in range(400)]
    rows += [*ODD, (1000, "a <M> b"), (1001, "<"), (-5, "one two three")]
    df = frame(spark, rows).withColumn("output", F.lit("clash"))
    out = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    got = collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out)
    assert got == collections.Counter((d, *brute_fill(d, t), t or "") for d, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(frame(spark, [])).collect() == []


def test_fill_rates(spark):
    df = frame(spark, [(i, "one two three four") for i in range(2000)])
    forms = collections.Counter(r.form for r in fill_middle.fill_in_middle(df, seed=7, rate=90, spm=10).collect())
    assert 1700 < forms["psm"] + forms["spm"] < 1900 and forms["psm"] > 6 * forms["spm"]
    assert len(set(itertools.islice(map(tuple, (fill_middle.draws(7, i) for i in range(50))), 50))) == 50
