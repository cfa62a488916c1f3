"""Property graph as DataFrames: upserts, mentions, one-hop facts, search.

nodes:    job_id, name, type, confidence, source_files
edges:    job_id, source, source_type, target, target_type, type, evidence, confidence, source_file, ordinal
mentions: job_id, chunk_id, name, type
facts:    long form - entity, type, rel_type, other, direction (null relation columns: none known)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.operators.dictionary import names_in
from sheafwork.session import shared_table

# Coarse relation classes.
KINSHIP = ("MOTHER_OF", "FATHER_OF", "PARENT_OF", "CHILD_OF", "SPOUSE_OF", "SIBLING_OF", "GUARDIAN_OF")
BUSINESS = ("OWNS", "EMPLOYED_BY", "PAID", "LOCATED_IN", "SUBSIDIARY_OF", "REPORTS_TO", "TRANSACTED_WITH")


def upsert_entities(nodes: DataFrame | None, new: DataFrame) -> DataFrame:
    """Merge entity rows into nodes: top confidence, every source file once.

    Repeats of (node, file) are collapsed first, so a hot node is spread over its files.
    """
    rows = new.select("job_id", "name", "type", "confidence", "source_file")
    if nodes is not None:
        old = nodes.select("job_id", "name", "type", "confidence", F.explode_outer("source_files").alias("source_file"))
        rows = old.unionByName(rows)
    keys = ["job_id", "name", "type"]
    per_file = rows.groupBy(*keys, "source_file").agg(F.max("confidence").alias("confidence"))
    return per_file.groupBy(*keys).agg(
        F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("source_file")).alias("source_files"))


def first_rows(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """First row per key by ``order`` (ordinal), as a partial aggregate instead of a sorted window.

    Rows are sorted by a hash of the keys first, which tells most of them apart by one number.
    """
    order = order or ["ordinal"]
    rest = [c for c in df.columns if c not in keys and c not in order]
    hashed = df.withColumn("_h", F.xxhash64(*keys))
    return hashed.groupBy("_h", *keys).agg(F.min(F.struct(*order, *rest)).alias("_f")).select(*keys, "_f.*")


def upsert_relations(edges: DataFrame | None, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between existing nodes, matched by name (any type); first properties stay.

    new: job_id, source_entity, target_entity, relation_type, evidence, confidence, source_file, ordinal.
    Repeats are dropped before the node joins; existing edges always win.
    """
    fresh = link_relations(first_rows(new, ["job_id", "source_entity", "target_entity", "relation_type"]), nodes)
    keys = ["job_id", "source", "source_type", "target", "target_type", "type"]
    if edges is None:
        return fresh
    known = edges.select(*keys)
    return edges.select(fresh.columns).unionByName(fresh.join(known, keys, "left_anti"))


def link_relations(first: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of relations that are merged already, each once: matched with the nodes by name (any type)."""
    # joined twice, by hash tables of the nodes' partitions: the relations need no sort
    nodes = shared_table(nodes.select("job_id", "name", "type"), "nodes").hint("shuffle_hash")
    s = nodes.select("job_id", F.col("name").alias("source_entity"), F.col("type").alias("source_type"))
    t = nodes.select("job_id", F.col("name").alias("target_entity"), F.col("type").alias("target_type"))
    return first.join(s, ["job_id", "source_entity"]).join(t, ["job_id", "target_entity"]).select(
        "job_id", F.col("source_entity").alias("source"), "source_type", F.col("target_entity").alias("target"),
        "target_type", F.col("relation_type").alias("type"), "evidence", "confidence", "source_file",
        "ordinal")


def upsert_pii(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Finding nodes by id, last write wins. new: finding_id, ordinal and properties."""
    rows = new if old is None else old.withColumn("ordinal", F.lit(-1).cast("long")).unionByName(new)
    rest = [c for c in rows.columns if c not in ("finding_id", "ordinal")]
    return rows.groupBy("finding_id").agg(F.max(F.struct("ordinal", *rest)).alias("_l")).select(
        "finding_id", *[f"_l.{c}" for c in rest])


def has_pii(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge from the PERSON of exactly the subject's name to its finding."""
    people = nodes.filter(F.col("type") == "PERSON").select("job_id", F.col("name").alias("subject_entity"))
    return findings.join(people, ["job_id", "subject_entity"]).select("job_id", "subject_entity", "finding_id").distinct()


def upsert_chunks(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Chunks by id, the latest ordinal wins."""
    rows = new if old is None else old.unionByName(new)
    rest = [c for c in rows.columns if c not in ("chunk_id", "ordinal")]
    return rows.groupBy("chunk_id").agg(F.max(F.struct("ordinal", *rest)).alias("_l")).select(
        "chunk_id", "_l.ordinal", *[f"_l.{c}" for c in rest])


def mentions(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """MENTIONS edges: the chunk's text contains the name of an entity of its job (case-sensitive)."""
    found = names_in(chunks, nodes, ["job_id", "chunk_id"], ["job_id"])
    known = nodes.select("job_id", "name", "type").distinct()
    return found.join(known, ["job_id", "name"]).select("job_id", "chunk_id", "name", "type").distinct()


def entities_in_text(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entities named in each question, case-insensitively. questions: question_id, text; with job_id in both, of its job."""
    scope = ["job_id"] if "job_id" in questions.columns else []
    names = nodes.select(*scope, F.lower("name").alias("_low"), F.col("name").alias("entity"), "type").distinct()
    texts = questions.select(*scope, "question_id", F.lower("text").alias("text"))
    found = names_in(texts, names.withColumnRenamed("_low", "name"), [*scope, "question_id"], scope or None)
    return found.withColumnRenamed("name", "_low").join(names, [*scope, "_low"]).select(*scope, "question_id", "entity", "type").distinct()


def relation_ends(edges: DataFrame) -> DataFrame:
    """Each relation from both of its ends: entity, type, rel_type, other, direction; with job_id, if the edges have it."""
    job = ["job_id"] if "job_id" in edges.columns else []

    def end(name: str, kind: str, other: str, direction: str) -> Column:
        return F.struct(F.col(name).alias("entity"), F.col(kind).alias("type"), F.col("type").alias("rel_type"),
                        F.col(other).alias("other"), F.lit(direction).alias("direction"))

    return edges.select(*job, F.inline(F.array(end("source", "source_type", "target", "out"), end("target", "target_type", "source", "in"))))


def facts_for(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Outgoing and incoming relations of each seed (entity, type; with job_id, of its job), one row per relation."""
    job = ["job_id"] if "job_id" in seeds.columns else []
    ends = relation_ends(edges).select(*job, "entity", "type", "rel_type", "other", "direction")
    return seeds.join(ends, [*job, "entity", "type"], "left")


def expand_from_chunks(links: DataFrame, edges: DataFrame, chunk_ids: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct entities mentioned by the given chunks (all, or the first ``limit`` by name) with their relations."""
    hit = links.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    seeds = hit.select(F.col("name").alias("entity"), "type").distinct()
    return facts_for(seeds if limit is None else seeds.orderBy("entity", "type").limit(limit), edges)


def expand_from_names(nodes: DataFrame, edges: DataFrame, names: DataFrame, limit: int | None = None) -> DataFrame:
    seeds = nodes.join(names.select("name").distinct(), "name", "left_semi").select(F.col("name").alias("entity"), "type")
    seeds = seeds.distinct()
    return facts_for(seeds if limit is None else seeds.orderBy("entity", "type").limit(limit), edges)


def relation_degree(edges: DataFrame) -> DataFrame:
    """Edges touching each node, a loop counted once."""
    loop = (F.col("source") == F.col("target")) & (F.col("source_type") == F.col("target_type"))
    first = F.struct(F.col("source").alias("name"), F.col("source_type").alias("type"))
    second = F.struct(F.col("target").alias("name"), F.col("target_type").alias("type"))
    ends = edges.select("job_id", F.inline(F.when(loop, F.array(first)).otherwise(F.array(first, second))))
    return ends.groupBy("job_id", "name", "type").agg(F.count("*").alias("degree"))


def dominant_person(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """The PERSON a question without a name is taken to mean, or no row.

    A lone person wins; else the one with strictly most relations; on a tie the one with at least
    twice the mentions of the runner-up.
    """
    people = nodes.filter(F.col("type") == "PERSON").select("job_id", "name", "type")
    seen = links.groupBy("job_id", "name", "type").agg(F.count_distinct("chunk_id").alias("mentions"))
    both = people.join(seen, ["job_id", "name", "type"], "left").join(
        relation_degree(edges), ["job_id", "name", "type"], "left").na.fill(0, ["mentions", "degree"])
    w = Window.partitionBy("job_id").orderBy(F.desc("degree"), F.desc("mentions"), "name")
    two = both.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    pair = two.groupBy("job_id").agg(
        F.max(F.when(F.col("rn") == 1, F.struct("name", "degree", "mentions"))).alias("a"),
        F.max(F.when(F.col("rn") == 2, F.struct("name", "degree", "mentions"))).alias("b"))
    wins = (F.col("b").isNull() | (F.col("a.degree") > F.col("b.degree")) | (F.col("b.mentions") == 0)
            | (F.col("a.mentions") >= F.col("b.mentions") * 2))
    return pair.filter(wins).select("job_id", "a.name", "a.degree", "a.mentions")


def merge_facts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two fact lists as one: relations united per entity, the first list's type kept."""
    both = first.withColumn("_src", F.lit(0)).unionByName(second.withColumn("_src", F.lit(1)))
    kind = both.groupBy("entity").agg(F.min(F.struct("_src", "type")).alias("_k"))
    known = both.filter(F.col("rel_type").isNotNull()).select("entity", "rel_type", "other", "direction").distinct()
    return kind.select("entity", F.col("_k.type").alias("type")).join(known, "entity", "left")


def sentence() -> Column:
    """A relation in its own direction; null where none is known."""
    told = F.when(F.col("direction") == "in", F.concat_ws(" ", "other", "rel_type", "entity")).otherwise(
        F.concat_ws(" ", "entity", "rel_type", "other"))
    return F.when(F.col("rel_type").isNotNull() & F.col("other").isNotNull(), told)


def told_text(told: Column) -> Column:
    return F.when(F.size(told) == 0, "nothing recorded").otherwise(F.array_join(told, "; "))


def fact_of(text: Column) -> Column:
    return F.concat("entity", F.lit(" ("), "type", F.lit("): "), text)


def fact_text(told: Column) -> Column:
    """'entity (type): s1; s2' of a list of sentences."""
    return fact_of(told_text(told))


def fact_sentences(facts: DataFrame) -> DataFrame:
    """One text for each entity and type, its sentences in order."""
    told = facts.groupBy("entity", "type").agg(F.array_sort(F.collect_set(sentence())).alias("told"))
    return told.select("entity", "type", fact_text(F.col("told")).alias("fact"))


def full_graph(nodes: DataFrame, edges: DataFrame, job_id: str) -> tuple[DataFrame, DataFrame]:
    return nodes.filter(F.col("job_id") == job_id), edges.filter(F.col("job_id") == job_id)


def search_entities(entities: DataFrame, relations: DataFrame, query: str) -> DataFrame:
    """Scored contextual search: exact 4, name 3, type 2, alias 2, relation evidence 1; best reason kept.

    entities: name, type, mentions, ordinal; relations: source_entity, target_entity, evidence, ordinal.
    """
    q = query.strip().lower()
    name, kind = F.lower("name"), F.lower("type")
    alias = F.get(F.filter("mentions", lambda m: F.lower(m).contains(q)), 0)
    scored = lambda n, why: F.struct(F.lit(n).alias("score"), why.alias("reason"))
    hit = (
        F.when(name == q, scored(4, F.lit("exact name match"))).when(name.contains(q), scored(3, F.lit("name match")))
        .when(kind.contains(q), scored(2, F.concat(F.lit("type: "), "type")))
        .when(alias.isNotNull(), scored(2, F.concat(F.lit('also referred to as "'), alias, F.lit('"'))))
    )
    by_name = entities.select("name", hit.alias("h"), F.lit(0).alias("src"), F.col("ordinal").cast("long").alias("ordinal"))
    by_name = by_name.filter("h is not null")
    proof = relations.filter(F.lower("evidence").contains(q))
    reason = scored(1, F.concat(F.lit('context: "'), "evidence", F.lit('"')))
    for end in ("source_entity", "target_entity"):
        by_name = by_name.unionByName(proof.select(
            F.col(end).alias("name"), reason.alias("h"), F.lit(1).alias("src"), F.col("ordinal").cast("long").alias("ordinal")))
    best = by_name.groupBy("name").agg(F.min(F.struct(
        (-F.col("h.score")).alias("s"), "src", "ordinal", F.col("h.reason").alias("reason"))).alias("b"))
    return best.select("name", (-F.col("b.s")).alias("score"), F.col("b.reason").alias("reason")).orderBy(F.desc("score"), "name")


def edge_category(col):
    t = F.upper(col)
    return F.when(t.isin(*KINSHIP), "kinship").when(t.isin(*BUSINESS), "business").otherwise("other")


def node_degree(edges: DataFrame) -> DataFrame:
    """Endpoint count and drawing radius per name. edges: source, target."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("name"))
    degree = ends.groupBy("name").agg(F.count("*").alias("degree"))
    top = degree.agg(F.greatest(F.max("degree"), F.lit(1))).scalar()
    return degree.withColumn("radius", 5 + F.sqrt(F.col("degree") / top) * 15)


def neighbours(edges: DataFrame, name: str) -> DataFrame:
    """Other end, direction and evidence of each relation of one entity."""
    is_source = F.col("source") == name
    return edges.filter(is_source | (F.col("target") == name)).select(
        F.when(is_source, F.col("target")).otherwise(F.col("source")).alias("neighbour"),
        F.when(is_source, "out").otherwise("in").alias("direction"), "type", "evidence")
