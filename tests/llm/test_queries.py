"""Registered queries of the corpus operators against SQL, brute force, round trips or held-out labels."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import compare
import corpus_pipeline
from sheafwork.llm import html_layout, quality_qda, secrets, token_records, warc
from sheafwork.llm.common import text_buffers
from sheafwork.llm.queries import END_ID, QUERIES, TOKENIZER

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def read(name: str, columns: str, folder: str = FOLDER) -> list[tuple]:
    return duckdb.sql(f"SELECT {columns} FROM '{folder}/{name}.parquet' ORDER BY 1").fetchall()


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def near_classes(texts: dict[int, str]) -> dict[int, int]:
    bags = {}
    for d, t in texts.items():
        w = words(t)
        bags[d] = collections.Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))
    parent = {d: d for d in bags}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(bags), 2):
        least = sum((bags[a] & bags[b]).values())
        total = sum(bags[a].values()) + sum(bags[b].values()) - least
        if least and least / total >= 0.8:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: root(d) for d in bags}


def kept_lines(texts: dict[int, str]) -> dict[int, list[str]]:
    def key(line: str) -> str:
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    first, holders = {}, collections.defaultdict(set)
    for d in sorted(texts):
        for line in (texts[d] or "").split("\n"):
            first.setdefault(key(line), d)
            holders[key(line)].add(d)
    return {d: [x for x in (t or "").split("\n") if len(key(x)) < 10 or len(holders[key(x)]) < 2 or first[key(x)] == d]
            for d, t in texts.items()}


def contaminated(texts: dict[int, str], items: list[str]) -> set[int]:
    windows = {tuple(w[i:i + 10]) for t in items if (w := words(t)) for i in range(max(len(w) - 9, 1))}
    sizes = {len(w) for w in windows}
    return {d for d, t in texts.items() for w in [words(t)]
            if any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1))}


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_against_sql(spark, name):
    run, sql = QUERIES[name]
    df = run(spark, FOLDER)
    con = compare.duck_tables(FOLDER)
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert compare.rows_of(df.columns, [tuple(r) for r in df.collect()]) == compare.rows_of(columns, cursor.fetchall())


def test_secret_base_spans(spark):
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = {r.doc_id: r for r in QUERIES["op1_secret_spans"][0](spark, FOLDER).collect()}
    for d, t in read("documents", "doc_id, text"):
        found = [(m.start(2), 0, m.end(2)) for m in assign.finditer(t) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        listed = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]
        row = got.pop(d)
        assert row.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == i for _, k, _ in found) for i in range(3))
        assert set(listed) <= set(row.spans.split(",")) | {""}
    assert not got


def test_records_round_trip(spark):
    library, at = Tokenizer.from_file(TOKENIZER), 0
    got = {r.doc_id: tuple(r[1:]) for r in QUERIES["op2_token_records"][0](spark, FOLDER).collect()}
    for d, t in read("documents", "doc_id, text"):
        ids = [*library.encode(t, add_special_tokens=False).ids, END_ID]
        assert got.pop(d) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


def test_automaton_equals_library(spark):
    library = Tokenizer.from_file(TOKENIZER)
    got = {r.doc_id: tuple(r[1:]) for r in QUERIES["op4_bpe_automaton"][0](spark, FOLDER).collect()}
    for d, t in read("documents", "doc_id, text"):
        ids = library.encode(t, add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest()
                   for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert got.pop(d) == (len(ids), *digests)
    assert not got


def test_search_recall_and_scores(spark):
    rows = read("embeddings", "vec_id, embedding")
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    length = np.sqrt((v * v).sum(axis=1))
    got = collections.defaultdict(list)
    for r in QUERIES["op5_multiprobe_lsh"][0](spark, FOLDER).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        score = v @ v[at] / (length * length[at])
        score[at] = -2
        best = ids[np.lexsort((ids, -score))[:5]].tolist()
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[np.flatnonzero(ids == i)[0]]) < 1e-12 for _, i, s in found)
        hits += len(set(best) & {f[1] for f in found})
    assert hits >= 0.9 * 5 * len(got)


def test_rendered_pages(spark):
    got = {r.page_id: r.text for r in QUERIES["op6_html_layout"][0](spark, FOLDER).collect()}
    pages = read("pages", "page_id, html")
    assert got == {i: html_layout.render(h) for i, h in pages}
    # every word of the article stands in the text, none of the script
    for i, h in pages:
        assert "track(" not in got[i]
        body = re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*)</article>", h, re.S)[1]) if "<article>" in h else ""
        assert set(re.findall(r"[^\W\d_]{4,}", re.sub(r"&\w+;", " ", body))) <= set(re.findall(r"[^\W\d_]{4,}", got[i]))


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    truth = dict(read("labels", "doc_id, quality", folder))
    rows = QUERIES["op7_quality"][0](spark, folder).collect()
    assert len(rows) == len(read("documents", "doc_id", folder))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)


def test_derivatives(spark):
    rows = QUERIES["op9_warc_derivatives"][0](spark, FOLDER).collect()
    pages = {i: (u, h) for i, u, h in read("pages", "page_id, url, html")}
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        url, page = pages[r.page_id]
        text = warc.plain(page)
        assert r.linked and r.target == url and r.payload_digest == warc.digest(page.encode())
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.n_chars == len(text)
    assert len({x for r in rows for x in (r.response_id, r.metadata_id, r.conversion_id)}) == 3 * len(rows)


def test_near_duplicates(spark):
    got = {r.doc_id: r.class_id for r in QUERIES["op10_near_duplicates"][0](spark, FOLDER).collect()}
    assert got == near_classes(dict(read("documents", "doc_id, text")))


def test_pipeline(spark):
    texts = dict(read("documents", "doc_id, text"))
    labels = dict(read("labels", "doc_id, quality"))
    x = {d: quality_qda.statistics(*text_buffers(pa_array(t)))[0] for d, t in texts.items()}
    known = [d for d in labels if d in x and zlib.crc32(str(d).encode()) % 4 != 2]
    parts = [np.array([x[d] for d in known if labels[d] == c]) for c in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    both = sum(c * len(p) for c, p in zip(covs, parts)) / len(known)
    odds = np.log((len(parts[1]) + 1) / (len(parts[0]) + 1))
    regular = []
    for c in covs:
        s = (1 - quality_qda.POOLED) * c + quality_qda.POOLED * both
        s = (1 - quality_qda.DIAGONAL) * s + quality_qda.DIAGONAL * np.diag(np.diag(s)) + quality_qda.FLOOR * np.eye(len(s))
        regular.append(s)

    def log_density(c: int, v: np.ndarray) -> float:
        d = v - parts[c].mean(axis=0)
        return -0.5 * (d @ np.linalg.inv(regular[c]) @ d + np.linalg.slogdet(regular[c])[1])

    good = {d: t for d, t in texts.items()
            if 1 / (1 + np.exp(-np.clip(odds + log_density(1, x[d]) - log_density(0, x[d]), -50, 50))) >= 0.7}
    assert 0 < len(good) < len(texts)
    lines = {d: "\n".join(x) for d, x in kept_lines(good).items()}
    bare = {}
    for d in sorted(lines):
        if not words(lines[d]):
            bare.setdefault(lines[d], d)
    kept = {d: lines[d] for d, c in near_classes(lines).items() if d == c and (words(lines[d]) or bare[lines[d]] == d)}
    bad = contaminated(kept, [t for _, t in read("benchmark", "item_id, text")])
    library = Tokenizer.from_file(TOKENIZER)
    want = {d: (t, len(t), " ".join(map(str, library.encode(t, add_special_tokens=False).ids))) for d, t in kept.items() if d not in bad}
    got = {r.doc_id: (r.text, r.n_chars, r.ids) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want


def pa_array(text: str):
    import pyarrow as pa

    return pa.array([text])


def test_shuffled_read_gives_every_record(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    token_records.write_records(docs, str(tmp_path / "r"), TOKENIZER, END_ID)
    first, second = ([(r.doc_id, len(r.ids)) for r in token_records.read_shuffled(spark, str(tmp_path / "r"), seed, 8).collect()]
                     for seed in (1, 2))
    whole = [(r.doc_id, r.n_tokens) for r in token_records.read_records(spark, str(tmp_path / "r")).collect()]
    assert sorted(first) == sorted(second) == sorted(whole)
    assert first != second
