from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafwork.operators import graph as G
from sheafwork.operators import ordering as O
from sheafwork.operators import responses as R
from sheafwork.operators import retrieval as V
from sheafwork.operators import runs as J

NODES = "job_id string, name string, type string, confidence double, source_file string"
RELS = ("job_id string, source_entity string, target_entity string, relation_type string, evidence string, "
        "confidence double, source_file string, ordinal long")


def test_relation_fans_out_over_types_and_keeps_first(spark):
    nodes = G.upsert_entities(None, spark.createDataFrame(
        [("j", "Jo", "PERSON", 0.5, "a"), ("j", "Jo", "ORG", 0.9, "b"), ("j", "X", "ORG", 0.1, "a"), ("j", "X", "ORG", 0.4, "c")], NODES))
    assert {(r.name, r.type): (r.confidence, r.source_files) for r in nodes.collect()}[("X", "ORG")] == (0.4, ["a", "c"])
    rel = spark.createDataFrame([("j", "Jo", "X", "OWNS", "late", 0.1, "a", 5), ("j", "Jo", "X", "OWNS", "first", 0.2, "a", 1),
                                 ("j", "Jo", "Nobody", "OWNS", "e", 0.2, "a", 2)], RELS)
    edges = G.upsert_relations(None, rel, nodes)
    assert sorted((r.source_type, r.evidence) for r in edges.collect()) == [("ORG", "first"), ("PERSON", "first")]
    again = G.upsert_relations(edges, rel.withColumn("evidence", F.lit("new")), nodes)
    assert {r.evidence for r in again.collect()} == {"first"}


@pytest.mark.parametrize("seed", [0, 100])
def test_mentions_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    letters = "abcé "
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    names = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(60)})
    chunks = spark.createDataFrame([("j", i, t) for i, t in enumerate([*texts, None])], "job_id string, chunk_id int, text string")
    nodes = spark.createDataFrame([("j", n, "ORG") for n in names], "job_id string, name string, type string")
    got = {(r.chunk_id, r.name) for r in G.mentions(chunks, nodes).collect()}
    assert got == {(i, n) for i, t in enumerate(texts) for n in names if n in t}


def edges_df(spark, rows):
    return spark.createDataFrame([("j", a, "PERSON", b, "PERSON", k) for a, k, b in rows],
                                 "job_id string, source string, source_type string, target string, target_type string, type string")


@pytest.mark.parametrize("people, rels, seen, want", [
    (["A"], [], {}, "A"),
    (["A", "B", "C"], [("B", "MOTHER_OF", "A"), ("C", "FATHER_OF", "A")], {"B": 9}, "A"),
    (["A", "B"], [], {"A": 4, "B": 2}, "A"),
    (["A", "B"], [], {"A": 3, "B": 2}, None),
    (["A", "B"], [("A", "SPOUSE_OF", "B")], {"A": 1}, "A"),
])
def test_dominant_person(spark, people, rels, seen, want):
    nodes = spark.createDataFrame([("j", p, "PERSON") for p in people], "job_id string, name string, type string")
    links = spark.createDataFrame([("j", i, n, "PERSON") for n, k in seen.items() for i in range(k)],
                                  "job_id string, chunk_id int, name string, type string")
    got = [r.name for r in G.dominant_person(nodes, edges_df(spark, rels), links).collect()]
    assert got == ([want] if want else [])


def test_fact_sentence_direction(spark):
    seeds = spark.createDataFrame([("Jo", "PERSON"), ("Al", "PERSON")], "entity string, type string")
    facts = G.facts_for(seeds, edges_df(spark, [("Jane", "MOTHER_OF", "Jo")]))
    assert {r.fact for r in G.fact_sentences(facts).collect()} == {
        "Jo (PERSON): Jane MOTHER_OF Jo", "Al (PERSON): nothing recorded"}


def test_vector_search_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 16)).astype("float32")
    x[5] = 0
    cats = ["pdf" if i % 3 else "csv" for i in range(200)]
    chunks = spark.createDataFrame([(i, cats[i], [float(v) for v in x[i]]) for i in range(200)],
                                   "chunk_id int, category string, embedding array<float>").repartition(7)
    q = rng.normal(size=(9, 16))
    asked = spark.createDataFrame(
        [(i, [float(v) for v in q[i]], ["csv"] if i % 3 == 1 else ["email"] if i % 3 == 2 else None) for i in range(9)],
        "question_id int, vector array<double>, categories array<string>")
    norm = np.linalg.norm(x.astype(float), axis=1)
    sims = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ np.divide(x, norm[:, None], out=np.zeros_like(x, float), where=norm[:, None] != 0).T
    for block in (100, 2):  # one block, and several
        got = {}
        for r in V.vector_search_many(chunks, asked, k=5, block=block).collect():
            got.setdefault(r.question_id, {})[r["rank"]] = r.chunk_id
        for i in range(9):
            pool = [j for j in range(200) if i % 3 != 1 or cats[j] == "csv"]
            want = sorted(pool, key=lambda j: (-sims[i, j], j))[:5]
            assert [got[i][k] for k in range(1, 6)] == want
    one = [r.chunk_id for r in V.vector_search(chunks, list(q[0]), 5).collect()]
    assert one == sorted(range(200), key=lambda j: (-sims[0, j], j))[:5]


def test_router_phrases(spark):
    texts = ["what's in the json file", "summarize the json data for me", "hello", "the payroll"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.c for r in df.select(V.infer_categories(F.col("t")).alias("c")).collect()]
    assert "json" in got[0] and "json" in got[1] and got[2] is None
    assert got[3] == sorted(V.BUSINESS_CATEGORIES)


@pytest.mark.parametrize("sql, safe", [
    ("SELECT 1", True), (" with a as (select 1) select * from a;", True), ("SELECT 1; SELECT 2", False),
    ("delete from t", False), ("select replace(a, 'x', 'y') from t", False), ("explain select 1", False), ("", False)])
def test_guard(spark, sql, safe):
    assert spark.range(1).select(V.is_safe_select(F.lit(sql)).alias("s")).first().s is safe


def test_guarded_sql(spark, tmp_path):
    t = spark.createDataFrame([(i, None if i % 2 else "x") for i in range(300)], "id int, v string")
    out = V.ask_sql(spark, {"t": t}, "SELECT id, v FROM t ORDER BY id", limit=200)
    assert V.ask_sql(spark, {"t": t}, "SELECT id FROM t").count() == 300
    rows = out.collect()
    assert len(rows) == 200 and rows[0].truncated and rows[1].v == "" and rows[1].id == "1"
    assert V.ask_sql(spark, {"t": t}, "WITH s AS (SELECT count(*) AS n FROM t) SELECT n FROM s").first().n == "300"
    t.write.parquet(str(tmp_path / "p"))
    spark.range(3).createOrReplaceTempView("hidden")
    for fine in ("SELECT extract(year FROM DATE '2020-01-02') AS y FROM t", "SELECT 'from nowhere' AS s, id FROM t", "WITH s(a) AS (SELECT id FROM t) SELECT a FROM s",
                 "SELECT id FROM t WHERE v IS DISTINCT FROM 'x'", "SELECT id, id FROM t", "SELECT a.id FROM t a, t b WHERE a.id = b.id"):
        assert V.ask_sql(spark, {"t": t}, fine).count() > 0
    assert V.ask_sql(spark, {"t": t}, "SELECT id, id FROM t").columns == ["id", "id_2", "truncated"]
    for bad in ("SELECT h.id FROM t, hidden h", "SELECT id FROM t, default.hidden", "SELECT id FROM t WHERE id IN (SELECT id FROM hidden)", f"SELECT * FROM parquet.`{tmp_path}/p`", "SELECT reflect('java.lang.System', 'exit', 0)", "SELECT * FROM other", "DROP TABLE t"):
        with pytest.raises(ValueError):
            V.ask_sql(spark, {"t": t}, bad)


def test_time_limit_ends_a_statement(spark):
    t = spark.range(100_000)
    start = time.time()
    rows, error = V.answer_sql(spark, {"t": t}, "SELECT count(*) AS n FROM t a JOIN t b ON (a.id * b.id) % 7 = 3 AND a.id + b.id <> 1", seconds=2)
    assert rows is None and "within 2 s" in error and time.time() - start < 60
    rows, error = V.answer_sql(spark, {"t": t}, "SELECT count(*) AS n FROM t", seconds=60)
    assert error is None and rows.first().n == "100000"
    assert V.answer_sql(spark, {"t": t}, "SELECT nothing FROM t", 60)[0] is None
    assert V.answer_sql(spark, {"t": t}, "DROP TABLE t", 60) == (None, "not a single read-only SELECT statement")


def test_global_row_number_and_running_totals(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([1.0, 1.0, 1.0, 2.0, 3.5])) for i in range(500)]
    df = spark.createDataFrame(rows, "ordinal int, score double").repartition(6)
    got = {r.ordinal: r["rank"] for r in O.global_row_number(df, [F.desc("score"), F.col("ordinal")], partitions=5).collect()}
    assert got == {o: k + 1 for k, (o, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    sums = O.running_totals(spark.createDataFrame([(i, i % 7) for i in range(1, 101)], "b long, n long"), "b", ["n"], block=9)
    assert {r.b: r.running_n for r in sums.collect()} == {i: sum(j % 7 for j in range(1, i + 1)) for i in range(1, 101)}


def test_numbers_within_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", i) for i in range(200)]
    got = {r.o: r.n for r in O.row_number_within(spark.createDataFrame(rows, "k string, o long"), ["k"], "o", block=16).collect()}
    seen, want = {}, {}
    for k, o in rows:
        seen[k] = seen.get(k, 0) + 1
        want[o] = seen[k]
    assert got == want


def test_progress(spark):
    files = spark.createDataFrame([("a", "extracting", "f", "extracting"), ("b", "complete", "f", "complete"), ("c", "synthesizing", "f", "complete")],
                                  "job_id string, job_status string, file string, status string")
    act = spark.createDataFrame([("a", "f", "completed")] * 3, "job_id string, file string, status string")
    got = {r.job_id: r.progress_pct for r in J.progress(files, act).collect()}
    assert got == {"a": 38.6, "b": 100.0, "c": 90.0}


def test_upper_median_and_slow(spark):
    act = spark.createDataFrame([("a", "completed", 1000), ("b", "completed", 3000), ("c", "failed", 7000), ("d", "skipped", 0), ("e", "running", None)],
                                "agent string, status string, duration_ms long")
    got = {r.agent: (r.status, r.slow) for r in J.agent_summary(act).collect()}
    assert got == {"a": ("completed", False), "b": ("completed", False), "c": ("failed", True), "d": ("skipped", False), "e": ("running", False)}


def test_extractor_failures_are_rows(spark):
    seg = spark.createDataFrame([("f", 0, "ok"), ("f", 1, "boom")], "source_file string, segment_no int, segment string")

    def fn(text):
        if text == "boom":
            raise RuntimeError("no model")
        return 'Here: {"entities": [{"name": "A"}]}'

    out = R.run_extractor(seg, "NER", fn)
    assert [r.name for r in R.parse_entities(out).collect()] == ["A"]
    warn = R.segment_failures(out).first()
    assert (warn.failed, warn.total) == (1, 2) and warn.warning.startswith("NER: 1 of 2 segments")


def test_dedupe_is_independent_of_partitions(spark):
    rnd = random.Random(2)
    rows = [("f", rnd.choice(["Ann", "ANN ", "bob"]), rnd.choice(["PERSON", "ORG"]), [rnd.choice("xyz")], rnd.random(), i) for i in range(300)]
    df = spark.createDataFrame(rows, "source_file string, name string, type string, mentions array<string>, confidence double, ordinal int")
    a, b = (sorted(map(str, R.dedup_entities(d, ["source_file"]).collect())) for d in (df.coalesce(1), df.repartition(11)))
    assert a == b and len(a) == 4


def test_extractor_holds_few_segments_at_once(spark):
    """Batches go through in slices: all segments answered once, failures and nulls by themselves."""
    rows = [(i, None if i == 700 else f"text {i}") for i in range(1000)]

    def fn(text: str) -> str:
        if text.endswith("9"):
            raise ValueError(text)
        return text.upper()

    out = R.run_extractor(spark.createDataFrame(rows, "segment_no bigint, segment string").coalesce(1), "NER", fn)
    got = {r.segment_no: (r.segment, r.agent, r.response, r.error is None) for r in out.collect()}
    assert got == {i: (s, "NER", s.upper() if s and not s.endswith("9") else None, s is not None and not s.endswith("9")) for i, s in rows}
    assert "MapInArrow" in out._jdf.queryExecution().sparkPlan().toString()


def test_retrieve_keeps_jobs_apart(spark):
    """A question number of two jobs gets each job's own passage and facts; a name of two types has the relations of both."""
    asked = spark.createDataFrame([(j, 1, "what about it", [1.0, 0.0]) for j in "ab"], "job_id string, question_id long, text string, vector array<double>")
    chunks = spark.createDataFrame([(j, 5, "pdf", [1.0, 0.5], f"{j}.txt", 3, f"text of {j}") for j in "ab"],
                                   "job_id string, chunk_id long, category string, embedding array<float>, source_file string, page int, text string")
    nodes = spark.createDataFrame([(j, "Jane", k) for j in "ab" for k in ("ORG", "PERSON")], "job_id string, name string, type string")
    edges = spark.createDataFrame([("a", "Jane", "PERSON", "Jo", "PERSON", "MOTHER_OF"), ("a", "Jane", "ORG", "Ink", "ORG", "OWNS"), ("b", "Jane", "ORG", "Bit", "ORG", "OWNS")],
                                  "job_id string, source string, source_type string, target string, target_type string, type string")
    links = spark.createDataFrame([("a", 5, "Jane", "ORG"), ("a", 5, "Jane", "PERSON"), ("b", 5, "Jane", "ORG")], "job_id string, chunk_id long, name string, type string")
    got = {r.citations: (r.hits, r.entities, r.facts, r.context) for r in V.retrieve(asked, chunks, nodes, edges, links, True).collect()}
    said = {"a": (2, "Jane (ORG): Jane MOTHER_OF Jo; Jane OWNS Ink"), "b": (1, "Jane (ORG): Jane OWNS Bit")}
    assert got == {f"{j}.txt: text of {j}": (
        1, 1, n, f"Passages found:\n\n[{j}.txt p.3] (score=0.89)\ntext of {j}\n\n\nWhat the graph says:\n\n{told}") for j, (n, told) in said.items()}


def test_items_are_parsed_once(spark):
    rows = spark.createDataFrame([("f", "NER", 1, 'x {"entities": [{"name": "a", "confidence": "0.5"}, 7, {"name": "b", "mentions": "z"}]} y'), ("f", "NER", 2, "{")],
                                 "source_file string, agent string, segment_no long, response string")
    found = R.parse_entities(rows)
    assert [(r.item_no, r.name, r.confidence) for r in found.collect()] == [(0, "a", 0.5)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2


def test_relations_are_joined_to_nodes_without_a_sort(spark):
    nodes = spark.createDataFrame([("j", n, "T") for n in "abc"], "job_id string, name string, type string")
    new = spark.createDataFrame([("j", "a", "b", "R", "late", 0.5, "f", 2), ("j", "a", "b", "R", "early", 0.5, "f", 1), ("j", None, "b", "R", "e", 0.5, "f", 3)],
                                "job_id string, source_entity string, target_entity string, relation_type string, evidence string, "
                                "confidence double, source_file string, ordinal long")
    edges = G.upsert_relations(None, new, nodes)
    assert [(r.source, r.target, r.evidence) for r in edges.collect()] == [("a", "b", "early")]
    assert "SortMergeJoin" not in edges._jdf.queryExecution().executedPlan().toString()


def test_equal_questions_are_searched_once_and_the_best_are_exact(spark, monkeypatch):
    """Many copies, near ties, zero and broken vectors, several categories: as by brute force; copies of a question share a search."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24)).astype(np.float32)
    many = np.concatenate([base, base[:20], base[:30] + rng.normal(size=(30, 24)).astype(np.float32) * 1e-7, np.zeros((2, 24), np.float32)])
    many = np.concatenate([many, np.repeat(base[:1], 40, axis=0)])
    kinds = [("pdf", "csv", None, "web")[i % 4] for i in range(len(many))]
    rows = [(i, kinds[i], many[i].tolist()) for i in range(len(many))]
    rows += [(900, "pdf", [float("nan")] * 24), (901, "csv", [float("inf")] + [0.0] * 23)]
    chunks = spark.createDataFrame(rows, "chunk_id long, category string, embedding array<float>")
    wants = [None, ["pdf"], ["web", "csv"], ["office"], []]
    asked = [(q, base[q // 5 % 10].tolist() if q < 290 else [0.0] * 24, wants[q % 5]) for q in range(300)]
    questions = spark.createDataFrame(asked, "question_id long, vector array<float>, categories array<string>")
    seen, real = [], V.shared_table
    monkeypatch.setattr(V, "shared_table", lambda df, name: seen.append(real(df, name)) or seen[-1])
    got: dict = {}
    for r in V.vector_search_many(chunks, questions, k=5).collect():
        got.setdefault(r.question_id, []).append((r.rank, r.chunk_id, round(r.score, 9)))
    assert seen[0].count() == 33  # ten vectors, asked for all, pdf and csv or web; and the zero vector
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)
    exact = np.round(unit(np.array([v for _, v, _ in asked], float)) @ unit(many.astype(float)).T, 12)
    for q, _, want in asked:
        fit = [i for i in range(len(many)) if not want or want == ["office"] or kinds[i] in want]
        best = sorted(fit, key=lambda i: (-exact[q, i], i))[:5]
        assert sorted(got[q]) == [(n + 1, i, round(float(exact[q, i]), 9)) for n, i in enumerate(best)], q


def test_best_chunks_of_a_group_when_later_ones_are_nearer():
    """Far more candidates than are kept, in rising order and with ties."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    q, d, n = 64, 8, 40_000
    vectors, noise = rng.normal(size=(q, d)), rng.normal(size=(n, d)).astype(np.float32)
    many = (noise * np.linspace(3, 0.01, n)[:, None].round(2) + vectors[0] + vectors[1]).astype(np.float32)
    many[-500:] = many[-1]
    asked = V._Asked("j", 8)  # noqa: SLF001
    asked.add(pa.RecordBatch.from_pydict({"question_id": list(range(q)), "vector": vectors.tolist(), "categories": [None] * q}))
    for a in range(0, n, 1000):
        asked.score(pa.RecordBatch.from_pydict({"chunk_id": list(range(a, a + 1000)), "category": ["x"] * 1000, "embedding": pa.array(
            many[a:a + 1000].tolist(), pa.list_(pa.float32()))}))
    rows, _ = asked.first()
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = np.round(unit(vectors) @ unit(many.astype(float)).T, 12)
    for i in range(q):
        best = np.lexsort((np.arange(n), -exact[i]))[:8].tolist()
        assert [r["chunk_id"] for r in rows.to_pylist() if r["q"] == i] == best
