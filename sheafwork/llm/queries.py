"""Registered queries of the corpus operators: name -> (function of session and folder, DuckDB statement or None)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.llm import (
    bpe_automaton, dart_minhash, fill_middle, html_layout, line_dedup, lsh_search, quality_qda, quality_rules, secrets, spelling,
    token_records, warc, winnow,
)
from sheafwork.llm.common import shared_folder

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(oracle: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = (fn, oracle)
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Tokenizer file of the queries, and the id behind each document.
TOKENIZER, END_ID = public_tokenizers.path("word_bpe_49k.json"), 2


@query()
def op1_secret_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))
    def of(*kinds: str):
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select(
        "doc_id", *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in secrets.KINDS],
        F.sha2(joined(of(*secrets.KINDS)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query()
def op2_token_records(spark: SparkSession, folder: str) -> DataFrame:
    home = shared_folder(spark, "token-records")
    token_records.write_records(table(spark, folder, "documents"), home, TOKENIZER, END_ID)
    return token_records.read_records(spark, home)


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line,
               generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) AS pos FROM documents)),
repeated AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT l.*, r.key IS NOT NULL AND l.doc_id > r.first AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query(LINES_SQL)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query()
def op4_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_automaton.encode_digests(table(spark, folder, "documents"), TOKENIZER)


@query()
def op5_multiprobe_lsh(spark: SparkSession, folder: str) -> DataFrame:
    return lsh_search.search(table(spark, folder, "embeddings"), every=50)


@query()
def op6_html_layout(spark: SparkSession, folder: str) -> DataFrame:
    return html_layout.render_pages(table(spark, folder, "pages"))


@query()
def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_qda.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


WINDOWS_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s
        FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.s, d.n, i.item_id FROM doc_windows d JOIN item_windows i USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
           FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)"""


@query(WINDOWS_SQL)
def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = winnow.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The pages carry no time of their own.
FETCHED = "2025-01-01T00:00:00Z"


@query()
def op9_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derivatives_of(table(spark, folder, "pages"), FETCHED)


@query()
def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, folder, "documents"))


SPELLING_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc, run, count(*) AS n, hex(encode(concat(doc, ':', run))) AS bytes
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc, run),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h
  FROM runs, crc),
v AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
  SELECT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, v.word, v.n FROM cut a JOIN v ON a.rest = v.word
  UNION SELECT v.word, v.n, b.word, b.n FROM v JOIN cut b ON v.word = b.rest),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form,
         CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL"""


@query(SPELLING_SQL)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(table(spark, folder, "documents"))


RULES_SQL = r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, E'\n'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?"()', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') AS p
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
again AS (
  SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM windows) WHERE c > 1)
  GROUP BY doc_id),
counts AS (
  SELECT doc_id, len(w) AS n_words, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(…|[.][.][.])[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
    len(list_filter(p, lambda x: list_contains(['the', 'of', 'and', 'to', 'in', 'that', 'is', 'for', 'with', 'it', 'as', 'was', 'on',
      'be', 'at', 'by', 'this', 'have', 'are', 'or', 'from', 'not', 'le', 'la', 'les', 'de', 'des', 'et', 'un', 'une', 'est', 'que',
      'qui', 'dans', 'pour', 'il', 'en', 'du', 'der', 'die', 'das', 'und', 'ist', 'den', 'von', 'zu', 'mit', 'sich', 'nicht', 'ein',
      'eine', 'el', 'los', 'las', 'y', 'se', 'por', 'con', 'una', 'no'], x))) AS n_stop_words
  FROM d LEFT JOIN again USING (doc_id)),
failing AS (
  SELECT *, list_filter([
    CASE WHEN n_words < 10 THEN 'too_few_words' END, CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 'repeated_windows' END,
    CASE WHEN n_words > 100000 THEN 'length' END,
    CASE WHEN word_chars * 2 < 5 * n_words OR word_chars > 12 * n_words THEN 'word_length' END,
    CASE WHEN 10 * n_symbols > n_words THEN 'symbols' END, CASE WHEN 2 * n_capitals > n_letters THEN 'capitals' END,
    CASE WHEN 100 * n_letter_words < 55 * n_words THEN 'words_with_letters' END,
    CASE WHEN 100 * n_stop_words < 4 * n_words THEN 'stop_words' END, CASE WHEN 10 * n_dup_lines > 4 * n_lines THEN 'repeated_lines' END,
    CASE WHEN 10 * n_bullet_lines > 9 * n_lines THEN 'bullet_lines' END,
    CASE WHEN 10 * n_ellipsis_lines > 3 * n_lines THEN 'ellipsis_lines' END], lambda x: x IS NOT NULL) AS failed
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed
FROM failing"""


@query(RULES_SQL)
def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed", ",").alias("failed"))


FILL_SQL = r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256(concat('42:', doc_id)) AS h
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
drawn AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50
      THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
parts AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
    array_to_string(u[greatest(a, b) + 1:], '') AS suf FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid) ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END)
    AS output_sha256, sha256(text) AS restored_sha256
FROM parts"""


@query(FILL_SQL)
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    def digest(text):
        return F.sha2(text.cast("binary"), 256)

    return fill_middle.fill_in_middle(table(spark, folder, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
