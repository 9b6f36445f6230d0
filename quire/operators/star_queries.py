"""Queries over the driver's tables, one per operator, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import casts, lexemes, paths
from ..plans import declared
from ..sources.exclusion import Exclusion
from . import bundle, diff, graph, imports, links, lookup, relational, rules, typed
from .parse import parse_documents
from .star import document, path, star_parsed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _concepts(spark, sf):
    return bundle.concepts_of(star_parsed(spark, sf))


def _links(spark, sf):
    parsed = star_parsed(spark, sf)
    return links.link_rows(parsed, parsed.select("path"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Concepts by type, with how many of their links are broken."""
    broken = _links(spark, sf).groupBy(F.col("source_id").alias("concept_id")).agg(F.count_if(~F.col("exists")).alias("broken"), F.count("*").alias("links"))
    return _concepts(spark, sf).join(broken, "concept_id", "left").groupBy("concept_type").agg(F.count("*").alias("concepts"), F.coalesce(F.sum("links"), F.lit(0)).cast("long").alias("links"), F.coalesce(F.sum("broken"), F.lit(0)).cast("long").alias("broken"))


# ---- parsing, digests, headings


@query(
    "SELECT 'Region' AS concept_type, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Customer', count(*) FROM customer"
    " UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders"
)
def inventory_by_type(spark, sf):
    return bundle.inventory(_concepts(spark, sf))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS source_digest FROM documents")
def inventory_digests(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("source_digest"))


@query("""SELECT 'part/' || p_partkey AS concept_id, 'okf-parsed-v1-jcs-sha256:' || sha256('[{"brand":"' || p_brand || '","title":"' || p_name || '","type":"Part"},"# ' || p_name || '\\n\\n"]') AS parsed_digest FROM part""")
def parsed_digest(spark, sf):
    return _concepts(spark, sf).where("concept_type = 'Part'").select("concept_id", "parsed_digest")


@query("SELECT doc_id, sha256(replace(text, ' ', chr(10))) AS digest FROM documents")
def newline_normalized(spark, sf):
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit("\r\n"))).otherwise(F.replace("text", F.lit(" "), F.lit("\r")))
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256).alias("digest"))


@query("SELECT 'customer/' || c_custkey AS concept_id, c_name AS title, c_mktsegment AS segment, c_nationkey::VARCHAR AS nation FROM customer")
def frontmatter_roundtrip(spark, sf):
    front = F.from_json("frontmatter_json", "segment string, nation string")
    return _concepts(spark, sf).where("concept_type = 'Customer'").select("concept_id", "title", front["segment"].alias("segment"), front["nation"].alias("nation"))


@query(
    "SELECT 'part/' || p_partkey || '.md' AS path, CASE WHEN p_partkey % 7 = 0 THEN 'OKF001' ELSE 'OKF002' END AS code, 'error' AS severity,"
    " CASE WHEN p_partkey % 7 = 0 THEN 'concept must start with YAML frontmatter delimited by ---' ELSE 'frontmatter must contain a non-empty string type' END AS message FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0"
)
def frontmatter_errors(spark, sf):
    part = table(spark, sf, "part")
    kind = F.when(F.col("p_partkey") % 11 == 0, F.lit("  ")).otherwise(F.lit("Part"))
    made = part.select("p_partkey", *document(path("part", "p_partkey"), {"type": kind, "title": F.col("p_name")}, F.lit("body\n")))
    made = made.withColumn("content", F.when(F.col("p_partkey") % 7 == 0, F.expr("substring(content, 2)")).otherwise(F.col("content"))).drop("p_partkey")
    parsed = parse_documents(made)
    return rules.document_rules(parsed).select("path", "code", "severity", "message")


_LOGS = "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'someday' WHEN o_orderkey % 17 = 0 THEN '2020-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS h FROM orders"


@query(
    f"""WITH logs AS ({_LOGS}), dates AS (SELECT *, try_cast(h AS DATE) AS d FROM logs), steps AS (SELECT o_custkey, d, lag(d) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM dates WHERE d IS NOT NULL)
    SELECT 'OKF008' AS code, 'log/' || o_custkey || '/log.md' AS path, 'log date heading must use YYYY-MM-DD: someday' AS message FROM logs WHERE h = 'someday'
    UNION ALL SELECT 'OKF008', 'log/' || o_custkey || '/log.md', 'log date heading is not a real date: 2020-02-30' FROM logs WHERE h = '2020-02-30'
    UNION ALL SELECT DISTINCT 'OKF009', 'log/' || o_custkey || '/log.md', 'log date groups must be ordered newest first' FROM steps WHERE d > before
    UNION ALL SELECT DISTINCT 'OKF007', 'log/' || o_custkey || '/log.md', 'log.md must contain a level-one title' FROM logs WHERE o_custkey % 5 = 0
    UNION ALL SELECT DISTINCT 'OKF006', 'log/' || o_custkey || '/log.md', 'log.md must not contain frontmatter' FROM logs WHERE o_custkey % 9 = 0
    UNION ALL SELECT 'OKF005', 'region/' || r_regionkey || '/index.md', 'index.md must contain at least one level-one section' FROM region WHERE r_regionkey % 2 = 0
    UNION ALL SELECT 'OKF004', 'region/' || r_regionkey || '/index.md', 'only the bundle-root index.md may contain frontmatter' FROM region WHERE r_regionkey % 3 = 0"""
)
def reserved_rules(spark, sf):
    order = table(spark, sf, "orders")
    heading = F.when(F.col("o_orderkey") % 13 == 0, "someday").when(F.col("o_orderkey") % 17 == 0, "2020-02-30").otherwise(F.substring(F.col("o_orderdate").cast("string"), 1, 10))
    lines = order.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.lit("## "), heading, F.lit("\n\n* change")).alias("h")))).alias("l"))
    title = F.when(F.col("o_custkey") % 5 == 0, "#\n\n").otherwise("# Log\n\n")
    front = F.when(F.col("o_custkey") % 9 == 0, "---\na: b\n---\n").otherwise("")
    logs = lines.select(F.concat(F.lit("log/"), F.col("o_custkey").cast("string"), F.lit("/log.md")).alias("path"), F.concat(front, title, F.array_join(F.transform("l", lambda x: x["h"]), "\n\n")).alias("content"))
    region = table(spark, sf, "region")
    body = F.concat(F.when(F.col("r_regionkey") % 3 == 0, "---\na: b\n---\n").otherwise(""), F.when(F.col("r_regionkey") % 2 == 0, "## ").otherwise("# "), "r_name")
    index = region.select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string"), F.lit("/index.md")).alias("path"), body.alias("content"))
    parsed = parse_documents(logs.union(index))
    return rules.document_rules(parsed).select("code", "path", "message")


@query("SELECT 'nation/' || n_nationkey || '.md' AS path, 1::INTEGER AS level, n_name AS text FROM nation UNION ALL SELECT 'nation/' || n_nationkey || '.md', 2::INTEGER, 'of ' || n_regionkey FROM nation")
def headings(spark, sf):
    nation = table(spark, sf, "nation")
    body = F.concat(F.col("n_name"), F.lit("\n===\n\n```\n# no\n```\n\n    # no\n\n## of "), F.col("n_regionkey").cast("string"), F.lit(" ##\n"))
    made = nation.select(*document(path("nation", "n_nationkey"), {"type": F.lit("Nation")}, body))
    return parse_documents(made).select("path", F.explode("headings").alias("h")).select("path", "h.level", "h.text")


# ---- links and the graph


@query(
    "SELECT 'nation/' || n_nationkey AS source_id, 'region/' || n_regionkey AS target_id, true AS \"exists\" FROM nation JOIN region ON n_regionkey = r_regionkey"
    " UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, true FROM supplier JOIN nation ON s_nationkey = n_nationkey"
    " UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, true FROM customer JOIN nation ON c_nationkey = n_nationkey"
    " UNION ALL SELECT 'orders/' || o_orderkey, 'customer/' || o_custkey, true FROM orders JOIN customer ON o_custkey = c_custkey"
)
def links_resolved(spark, sf):
    return _links(spark, sf).select("source_id", "target_id", "exists")


@query("SELECT 'documents/' || d.doc_id || '.md' AS path, 'OKF101' AS code, 'warning' AS severity, 'local Markdown link does not resolve: ../labels/' || d.doc_id || '.md' AS message FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def links_broken(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id").withColumn("k", F.col("doc_id").cast("string"))
    body = F.concat(F.lit("see [label](../labels/"), F.col("k"), F.lit(".md)\n"))
    made = docs.select(*document(path("documents", "doc_id"), {"type": F.lit("Text")}, body))
    label = table(spark, sf, "labels").select(path("labels", "doc_id").alias("path")).distinct()
    parsed = parse_documents(made)
    known = docs.select(path("documents", "doc_id").alias("path")).union(label)
    return rules.broken_links(links.link_rows(parsed, known)).select("path", "code", "severity", "message")


@query("SELECT 'customer/' || c_custkey AS source_id, CASE WHEN c_custkey % 3 = 0 THEN '../customer/' || c_custkey || '.md' ELSE '/customer/' || c_custkey || '.md' END AS raw_target, 'customer/' || c_custkey AS target_id FROM customer WHERE c_custkey % 3 < 2")
def link_escape(spark, sf):
    key = F.col("c_custkey").cast("string")
    target = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("../customer/"), key, F.lit(".md"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("/customer/"), key, F.lit(".md"))).otherwise(F.lit("../../outside.md"))
    made = table(spark, sf, "customer").select(*document(path("customer", "c_custkey"), {"type": F.lit("Customer")}, F.concat(F.lit("[x]("), target, F.lit(")\n"))))
    parsed = parse_documents(made)
    return links.link_rows(parsed, made.select("path")).select("source_id", "raw_target", "target_id")


@query("SELECT 'region/' || n_regionkey AS concept_id, count(*) AS n FROM nation GROUP BY n_regionkey UNION ALL SELECT 'nation/' || k, count(*) FROM (SELECT s_nationkey k FROM supplier UNION ALL SELECT c_nationkey FROM customer) GROUP BY k UNION ALL SELECT 'customer/' || o_custkey, count(*) FROM orders GROUP BY o_custkey")
def reverse_links(spark, sf):
    return links.link_counts(_links(spark, sf)).where("n_linked_from > 0").select("concept_id", F.col("n_linked_from").alias("n"))


_NODES = "(SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders)"
_EDGES = "(SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)"


@query(f"SELECT ({_NODES})::BIGINT AS nodes, ({_EDGES})::BIGINT AS edges, ((SELECT count(*) FROM region) + (SELECT count(*) FROM part))::BIGINT AS weak_components, ({_NODES})::BIGINT AS strong_components, true AS is_dag")
def graph_summary(spark, sf):
    concepts = _concepts(spark, sf)
    return graph.summary(concepts.select("concept_id"), links.edges(_links(spark, sf), concepts))


@query("SELECT count(*) AS nodes, count(*) AS edges, 1::BIGINT AS weak_components, 1::BIGINT AS strong_components, false AS is_dag FROM nation")
def graph_cycle(spark, sf):
    nation = table(spark, sf, "nation")
    n = nation.agg(F.count("*")).scalar()
    ring = nation.select(F.col("n_nationkey").alias("source"), ((F.col("n_nationkey") + 1) % n).alias("target"))
    return graph.summary(nation.select("n_nationkey"), ring)


@query(
    "WITH e AS (SELECT 'nation/' || n_nationkey s, 'region/' || n_regionkey t FROM nation UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer UNION ALL SELECT 'orders/' || o_orderkey, 'customer/' || o_custkey FROM orders),"
    " v AS (SELECT 'region/' || r_regionkey node FROM region UNION ALL SELECT 'nation/' || n_nationkey FROM nation UNION ALL SELECT 'supplier/' || s_suppkey FROM supplier UNION ALL SELECT 'customer/' || c_custkey FROM customer UNION ALL SELECT 'part/' || p_partkey FROM part UNION ALL SELECT 'orders/' || o_orderkey FROM orders)"
    " SELECT node, coalesce(o, 0) AS outgoing, coalesce(i, 0) AS incoming FROM v LEFT JOIN (SELECT s, count(*) o FROM e GROUP BY s) ON node = s LEFT JOIN (SELECT t, count(*) i FROM e GROUP BY t) ON node = t"
)
def graph_degree(spark, sf):
    concepts = _concepts(spark, sf)
    return graph.degrees(concepts.select("concept_id"), links.edges(_links(spark, sf), concepts))


# ---- keys


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def fk_violations(spark, sf):
    return relational.dangling(table(spark, sf, "documents").select("doc_id"), ["doc_id"], table(spark, sf, "labels"), ["doc_id"])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem t WHERE t.l_returnflag = 'R' AND t.l_partkey = l.l_partkey AND t.l_suppkey = l.l_suppkey)")
def fk_composite(spark, sf):
    line = table(spark, sf, "lineitem")
    target = line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    return relational.dangling(line, ["l_partkey", "l_suppkey"], target, ["p", "s"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT p_partkey, p_name, first_p_partkey FROM (SELECT *, row_number() OVER w rn, first_value(p_partkey) OVER w first_p_partkey FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)) WHERE rn > 1")
def unique_violations(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return relational.duplicate_rows(part, ["p_name"], ["p_partkey"], "p_partkey")


@query("SELECT l_orderkey, l_linenumber, count(*) - 1 AS duplicates FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def pk_violations(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    again = relational.duplicate_rows(line, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate"], "l_partkey")
    return again.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("duplicates"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey % 4 = 0")
def pk_nulls(spark, sf):
    holed = table(spark, sf, "customer").select("c_custkey", F.expr("case when c_nationkey % 4 <> 0 then c_nationkey end").alias("nation"))
    return relational.null_keys(holed, ["c_custkey", "nation"]).select("c_custkey")


@query("""SELECT 'OKF021' AS code, 'part/' || p_partkey || '.md' AS path, replace('constraint "part_title_key" on "part" duplicates key ("', '"', chr(39)) || p_name || chr(39) || ',); first seen at part/' || first_key || '.md' AS message FROM (SELECT p_partkey, p_name, row_number() OVER w rn, first_value(p_partkey) OVER w first_key FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey::VARCHAR || '.md')) WHERE rn > 1
    UNION ALL SELECT 'OKF022', 'customer/' || c_custkey || '.md', replace('foreign key "Customer_nation_nation_fkey" on "Customer" has no matching "Supplier"("nation",) for ("' || c_nationkey || '",)', '"', chr(39)) FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def bundle_constraints(spark, sf):
    schema = relational.Constraints((relational.Key("part", ("title",)),), (relational.Reference("Customer", ("nation",), "Supplier", ("nation",)),))
    return relational.check_constraints(_concepts(spark, sf), schema).select("code", "path", "message")


# ---- paths


@query("SELECT 'types/' || trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_type)), '[\\s/]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') || '.md' AS path, 'type \"' || p_type || '\" has no specification document' AS message FROM (SELECT DISTINCT p_type FROM part) WHERE p_type <> 'ECONOMY'")
def spec_missing(spark, sf):
    types = table(spark, sf, "part").select(F.col("p_type").alias("concept_type"))
    known = spark.createDataFrame([("types/economy.md",)], "path string")
    return rules.missing_specs(types, known, "types/{slug}.md").select("path", "message")


@query("SELECT DISTINCT o_orderpriority AS name, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(o_orderpriority)), '[\\s/]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') AS slug FROM orders")
def type_slug(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("name"), paths.ascii_slug_column(F.col("o_orderpriority")).alias("slug")).distinct()


_PATHS = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'vendor/' || c_custkey || '.md' WHEN c_custkey % 4 = 1 THEN 'docs/vendor/keep/' || c_custkey || '.md' WHEN c_custkey % 4 = 2 THEN 'a/tmp' || c_custkey || '.md' ELSE 'a/b/' || c_custkey || '.MD' END AS path FROM customer"


def _paths(spark, sf):
    k = F.col("c_custkey").cast("string")
    p = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("vendor/"), k, F.lit(".md"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("docs/vendor/keep/"), k, F.lit(".md"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("a/tmp"), k, F.lit(".md"))).otherwise(F.concat(F.lit("a/b/"), k, F.lit(".MD")))
    return table(spark, sf, "customer").select("c_custkey", p.alias("path"))


@query(f"SELECT path, (regexp_matches(path, '(^|/)vendor/') AND NOT regexp_matches(path, '(^|/)vendor/keep/')) OR regexp_matches(path, '^a/tmp[0-9][^/]*[.]md$') AS excluded FROM ({_PATHS})")
def exclude_globs(spark, sf):
    rule = Exclusion(["# comment", "vendor/", "!**/vendor/keep", "/a/tmp[0-9]*.md"])
    return _paths(spark, sf).select("path", rule.column(F.col("path")).alias("excluded"))


@query(
    "SELECT 'a/b/' || c_custkey || '.md' AS path, CASE WHEN c_custkey % 5 = 0 THEN 'ignored' WHEN c_custkey % 5 = 1 THEN 'invalid_or_untyped' WHEN c_custkey % 5 = 2 THEN 'invalid_or_untyped' ELSE 'concept' END AS class FROM customer"
    " UNION ALL SELECT 'n/' || n_nationkey || '/index.md', 'reserved' FROM nation"
)
def classify_paths(spark, sf):
    made = table(spark, sf, "customer").select("c_custkey", *document(path("a/b", "c_custkey"), {"type": F.when(F.col("c_custkey") % 5 == 1, F.lit("")).otherwise(F.lit("C"))}, F.lit("x")))
    made = made.withColumn("content", F.when(F.col("c_custkey") % 5 == 2, F.lit("no frontmatter")).otherwise(F.col("content")))
    index = table(spark, sf, "nation").select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string"), F.lit("/index.md")).alias("path"), F.lit("# x").alias("content"))
    parsed = parse_documents(made.where("c_custkey % 5 <> 0").select("path", "content").union(index))
    return bundle.classify_paths(made.select("path").union(index.select("path")), parsed)


@query("SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS ordinal, 'c/' || c_custkey || '.md' AS path, CASE WHEN c_custkey % 3 = 0 THEN strlen(c_name) ELSE strlen(c_name) + 17 + strlen(c_mktsegment) END AS size, CASE WHEN c_custkey % 3 = 0 THEN 'untyped' ELSE 'typed:' || c_mktsegment END AS classification, c_name AS body FROM customer")
def ingest_envelope(spark, sf):
    front = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.concat(F.lit('---\ntype: "'), "c_mktsegment", F.lit('"\n---\n')))
    customer = table(spark, sf, "customer")
    made = customer.select((F.col("c_custkey") - customer.agg(F.min("c_custkey")).scalar()).alias("ordinal"), path("c", "c_custkey").alias("path"), F.concat(front, "c_name").alias("content"))
    return bundle.envelopes(made, {"identity", "body"}).select("ordinal", "path", "size", "classification", "body")


# ---- declared types, inference


def _typed(name: str, sql_type: str, source: str, key: str, spark_value: str, duck_value: str, shown: str = "VARCHAR"):
    """Values as text with junk among them, cast as a declared type; compared as text or as they are."""

    def run(spark, sf):
        kind = casts.logical_type(sql_type)
        raw = table(spark, sf, source).select(key, F.expr(spark_value).alias("raw"))
        value = casts.typed(F.col("raw"), kind)
        return raw.select(key, "raw", (value.cast("string") if shown == "VARCHAR" else value).alias("value"))

    run.__name__ = name
    cast = f"TRY_CAST(raw AS {sql_type})"
    query(f"SELECT {key}, raw, {cast + '::VARCHAR' if shown == 'VARCHAR' else cast} AS value FROM (SELECT {key}, {duck_value} AS raw FROM {source})")(run)


_typed("typed_decimal", "DECIMAL(18,2)", "orders", "o_orderkey", "case o_orderkey % 6 when 0 then 'n/a' when 1 then cast(o_orderkey as string) || '.505' when 2 then ' ' || o_orderkey when 3 then '-' || o_orderkey || '.5' when 4 then '' else cast(o_orderkey as string) end", "CASE o_orderkey % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN o_orderkey || '.505' WHEN 2 THEN ' ' || o_orderkey WHEN 3 THEN '-' || o_orderkey || '.5' WHEN 4 THEN '' ELSE o_orderkey::VARCHAR END")
_typed("typed_bigint", "BIGINT", "orders", "o_orderkey", "case o_orderkey % 8 when 0 then 'x' when 1 then cast(o_orderkey as string) || '.50' when 2 then '+' || o_orderkey when 3 then ' ' || o_orderkey || ' ' when 4 then '00' || o_orderkey when 5 then '1e3' when 6 then '99999999999999999999' else '-' || o_orderkey || '.4' end", "CASE o_orderkey % 8 WHEN 0 THEN 'x' WHEN 1 THEN o_orderkey || '.50' WHEN 2 THEN '+' || o_orderkey WHEN 3 THEN ' ' || o_orderkey || ' ' WHEN 4 THEN '00' || o_orderkey WHEN 5 THEN '1e3' WHEN 6 THEN '99999999999999999999' ELSE '-' || o_orderkey || '.4' END")
_typed("typed_tinyint", "UTINYINT", "part", "p_partkey", "cast(p_size * 7 - 10 as string)", "(p_size * 7 - 10)::VARCHAR")
_typed("typed_date", "DATE", "orders", "o_orderkey", "case o_orderkey % 6 when 0 then '2026' when 1 then '2026-01' when 2 then '2026-02-30' when 3 then 'soon' else substring(cast(o_orderdate as string), 1, 10) end", "CASE o_orderkey % 6 WHEN 0 THEN '2026' WHEN 1 THEN '2026-01' WHEN 2 THEN '2026-02-30' WHEN 3 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END")
_typed("typed_bool", "BOOLEAN", "orders", "o_orderkey", "case o_orderkey % 7 when 0 then 'true' when 1 then 'FALSE' when 2 then 't' when 3 then ' true' when 4 then '0' when 5 then 'yes' else 'maybe' end", "CASE o_orderkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' WHEN 2 THEN 't' WHEN 3 THEN ' true' WHEN 4 THEN '0' WHEN 5 THEN 'yes' ELSE 'maybe' END", "raw")
_typed("typed_double", "DOUBLE", "orders", "o_orderkey", "case o_orderkey % 5 when 0 then '1d' when 1 then '1.5e3' when 2 then '.5' when 3 then 'x' else cast(o_orderkey as string) end", "CASE o_orderkey % 5 WHEN 0 THEN '1d' WHEN 1 THEN '1.5e3' WHEN 2 THEN '.5' WHEN 3 THEN 'x' ELSE o_orderkey::VARCHAR END", "raw")
_typed("typed_timestamp", "TIMESTAMP", "orders", "o_orderkey", "case o_orderkey % 4 when 0 then 'never' when 1 then substring(cast(o_orderdate as string), 1, 10) || 'T10:11:12' when 2 then substring(cast(o_orderdate as string), 1, 10) else substring(cast(o_orderdate as string), 1, 10) || ' 01:02:03.5' end", "CASE o_orderkey % 4 WHEN 0 THEN 'never' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:11:12' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') || ' 01:02:03.5' END")
_typed("typed_uuid", "UUID", "part", "p_partkey", "case p_partkey % 3 when 0 then upper(md5(p_name)) when 1 then 'zz' else regexp_replace(md5(p_name), '^(.{8})(.{4})(.{4})(.{4})', '$1-$2-$3-$4-') end", "CASE p_partkey % 3 WHEN 0 THEN upper(md5(p_name)) WHEN 1 THEN 'zz' ELSE regexp_replace(md5(p_name), '^(.{8})(.{4})(.{4})(.{4})', '\\1-\\2-\\3-\\4-') END")


@query("SELECT p_partkey, list_sum(v)::BIGINT AS total, len(v) AS items, len(list_filter(v, lambda x: x IS NULL)) AS nulls FROM (SELECT p_partkey, list_transform(string_split(p_partkey || ',x,' || p_size || '.5', ','), lambda x: TRY_CAST(x AS BIGINT)) AS v FROM part)")
def typed_list(spark, sf):
    raw = table(spark, sf, "part").select("p_partkey", F.split(F.concat_ws(",", F.col("p_partkey").cast("string"), F.lit("x"), F.concat(F.col("p_size").cast("string"), F.lit(".5"))), ",").alias("raw"))
    v = raw.select("p_partkey", casts.typed(F.col("raw"), casts.logical_type("BIGINT[]")).alias("v"))
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return v.select("p_partkey", total.alias("total"), F.size("v").cast("long").alias("items"), F.size(F.filter("v", lambda x: x.isNull())).cast("long").alias("nulls"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN TRY_CAST(raw AS BIGINT)::VARCHAR ELSE raw END AS value FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'junk' ELSE o_orderkey::VARCHAR END AS raw FROM orders)")
def typed_null_wins(spark, sf):
    order = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "junk").otherwise(F.col("o_orderkey").cast("string")).alias("raw"))
    rows = order.where("o_orderkey % 2 = 0").select("o_orderkey", casts.typed(F.col("raw"), casts.logical_type("BIGINT")).cast("string").alias("typed"), F.lit(True).alias("has"))
    return order.join(rows, "o_orderkey", "left").select("o_orderkey", lookup.typed_or_raw(F.coalesce("has", F.lit(False)), F.col("typed"), F.col("raw")).alias("value"))


def _kind_sql(field: str, text: str) -> str:
    """The vote over a column of texts, from its values."""
    whole = lambda pattern: f"bool_and(regexp_full_match({text}, '{pattern}'))"
    real = f"bool_and(try_cast(left({text}, 10) AS DATE) IS NOT NULL)"
    kinds = (("boolean", f"bool_and(lower({text}) IN ('true', 'false'))"), ("integer", whole("[+-]?[0-9]+")), ("number", whole("[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?")), ("date", f"{whole('[0-9]{4}-[0-9]{2}-[0-9]{2}')} AND {real}"), ("datetime", f"{whole('[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}(:[0-9]{2})?[Zz]?')} AND {real}"))
    return f"SELECT '{field}' AS field, CASE {' '.join(f'WHEN {test} THEN {chr(39)}{kind}{chr(39)}' for kind, test in kinds)} ELSE 'string' END AS kind FROM orders"


@query(" UNION ALL ".join(_kind_sql(*x) for x in (("o_orderkey", "o_orderkey::VARCHAR"), ("o_totalprice", "o_totalprice::VARCHAR"), ("o_day", "strftime(o_orderdate, '%Y-%m-%d')"), ("o_time", "strftime(o_orderdate, '%Y-%m-%dT00:00:00Z')"), ("o_flag", "(o_orderstatus = 'F')::VARCHAR"), ("o_orderpriority", "o_orderpriority"))))
def infer_kinds(spark, sf):
    day = F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    cols = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_totalprice").cast("string").alias("o_totalprice"), day.alias("o_day"), F.concat(day, F.lit("T00:00:00Z")).alias("o_time"), (F.col("o_orderstatus") == "F").cast("string").alias("o_flag"), "o_orderpriority")
    return lexemes.votes(cols, cols.columns)


@query("SELECT count(*) AS total, count(try_cast(o_orderpriority[1:1] AS BIGINT)) AS as_bigint, count(try_cast(o_orderpriority AS BIGINT)) AS whole_bigint, count(*) FILTER (WHERE regexp_full_match(o_orderstatus, '[A-Z]')) AS letters FROM orders")
def infer_cast_vote(spark, sf):
    big = casts.logical_type("BIGINT")
    return table(spark, sf, "orders").agg(F.count("*").alias("total"), F.count(casts.typed(F.substring("o_orderpriority", 1, 1), big)).alias("as_bigint"), F.count(casts.typed(F.col("o_orderpriority"), big)).alias("whole_bigint"), F.count_if(F.col("o_orderstatus").rlike("^[A-Z]$")).alias("letters"))


_FIELDS = {"Nation": ("nation", {"title": "n_name", "region": "n_regionkey"}), "Region": ("region", {"title": "r_name"}), "Supplier": ("supplier", {"title": "s_name", "nation": "s_nationkey"}), "Customer": ("customer", {"title": "c_name", "segment": "c_mktsegment", "nation": "c_nationkey"}), "Part": ("part", {"title": "p_name", "brand": "p_brand"}), "Order": ("orders", {"title": "o_orderkey", "priority": "o_orderpriority"})}


@query(" UNION ALL ".join(f"SELECT '{t}' AS concept_type, '{f}' AS field, count({c}) = count(*) AS required, count({c}) < count(*) AS nullable FROM {rows}" for t, (rows, columns) in _FIELDS.items() for f, c in {"type": "'x'", **columns}.items()))
def presence_nullability(spark, sf):
    from ..plans.contract import field_facts

    return field_facts(_concepts(spark, sf)).select("concept_type", "field", "required", "nullable")


@query("SELECT event_type, 'props' AS field FROM events GROUP BY event_type HAVING bool_or(event_id % 100 <> 1) ORDER BY 1")
def structured_exclusion(spark, sf):
    from ..plans.contract import structured_fields

    events = table(spark, sf, "events").select(F.col("event_type").alias("concept_type"), F.col("event_id").cast("string").alias("concept_id"), F.when(F.col("event_id") % 100 == 1, F.lit('{"props": "x"}')).otherwise(F.concat(F.lit('{"props": '), "props", F.lit("}"))).alias("frontmatter_json"))
    return structured_fields(events).select(F.col("concept_type").alias("event_type"), "field")


@query("SELECT lower(p_name) AS field, count(DISTINCT spelled) AS spellings FROM (SELECT p_name, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS spelled FROM part) GROUP BY 1 HAVING count(DISTINCT spelled) > 1")
def spelling_collision(spark, sf):
    from ..plans.contract import spelling_collisions

    names = table(spark, sf, "part").select(F.lit("T").alias("concept_type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("field"))
    return spelling_collisions(names).select("field", "spellings")


_CANDIDATES = ("BOOLEAN", "BIGINT", "DOUBLE", "DATE", "TIMESTAMPTZ")
_VOTED = {"day": "strftime(o_orderdate, '%Y-%m-%d')", "price": "o_totalprice::VARCHAR", "padded": "'0' || o_custkey", "key": "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey::VARCHAR END", "status": "o_orderstatus"}


@query(" UNION ALL ".join(f"SELECT '{f}' AS field, '{c}' AS candidate, count({e}) AS filled, count(TRY_CAST({e} AS {c})){f' FILTER (WHERE CAST(TRY_CAST({e} AS {c}) AS VARCHAR) = {e})' if c in ('BIGINT', 'DATE') else ''} AS clean FROM orders" for f, e in _VOTED.items() for c in _CANDIDATES))
def cast_vote(spark, sf):
    order = table(spark, sf, "orders")
    texts = order.select(F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("day"), F.col("o_totalprice").cast("string").alias("price"), F.concat(F.lit("0"), "o_custkey").alias("padded"), F.expr("case when o_orderkey % 5 > 0 then cast(o_orderkey as string) end").alias("key"), F.col("o_orderstatus").alias("status"))
    return typed.cast_vote(texts, list(_VOTED))


@query("SELECT 'customer/' || c_custkey || '.md' AS path, c_nationkey::VARCHAR AS raw_nation, c_nationkey::BIGINT AS nation, c_mktsegment AS segment, c_name AS title, 3::BIGINT AS lines FROM customer")
def typed_table(spark, sf):
    declaration = declared.declare('CREATE TABLE customer (nation BIGINT, "Segment" VARCHAR, missing DATE[])', "Customer")
    concepts = _concepts(spark, sf)
    relation = typed.TypedRelations(concepts, {"Customer": declaration})["Customer"]
    return relation.select(F.col("__okf_path").alias("path"), F.col("__okf_raw_nation").alias("raw_nation"), "nation", F.col("Segment").alias("segment"), "title", F.size("__okf_body_lines").cast("long").alias("lines"))


@query("SELECT doc_id, len(string_split(text, chr(10))) - CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END AS n, string_split(text, chr(10))[1] AS first_line FROM documents")
def body_lines(spark, sf):
    lines = typed.body_lines(F.regexp_replace("text", "\n", "\r\n"))
    return table(spark, sf, "documents").select("doc_id", F.size(lines).cast("long").alias("n"), F.get(lines, F.lit(0)).alias("first_line"))


# ---- reading


@query("SELECT 'orders/' || o_orderkey AS concept_id, 'Order ' || o_orderkey AS title FROM orders ORDER BY concept_id LIMIT 100 OFFSET 250")
def concepts_page(spark, sf):
    return lookup.page(_concepts(spark, sf), 100, 250, concept_type="Order").select("concept_id", "title")


@query("SELECT 'customer/' || c_custkey AS concept_id, c_name AS title FROM customer WHERE c_custkey = 42")
def concept_lookup(spark, sf):
    return lookup.find(_concepts(spark, sf), "customer/42.md").select("concept_id", "title")


@query("SELECT 'nation/' || n_nationkey AS concept_id, 1::BIGINT AS n_links, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_linked_from, 0::BIGINT AS n_diagnostics FROM nation")
def concept_record(spark, sf):
    parsed = star_parsed(spark, sf)
    linked = links.link_rows(parsed, parsed.select("path"))
    page = bundle.concepts_of(parsed).where("concept_type = 'Nation'")
    counts = links.link_counts(linked)
    said = rules.broken_links(linked).groupBy("path").agg(F.count("*").alias("n_diagnostics"))
    found = page.join(counts, "concept_id", "left").join(said, "path", "left")
    return found.select("concept_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_linked_from", "n_diagnostics")])


@query("SELECT 'customer/' || c_custkey AS concept_id, 'nation/' || c_nationkey AS target, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_linked_from, (SELECT min('orders/' || o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first_linked_from FROM customer ORDER BY 1 LIMIT 50")
def concept_record_page(spark, sf):
    page = lookup.page(_concepts(spark, sf), 50, 0, concept_type="Customer")
    linked = _links(spark, sf)
    found = lookup.records(page, linked, rules.broken_links(linked.withColumn("path", F.concat("source_id", F.lit(".md")))))
    return found.select("concept_id", F.col("links")[0]["target_id"].alias("target"), F.size("linked_from").cast("long").alias("n_linked_from"), F.get("linked_from", F.lit(0))["source_id"].alias("first_linked_from"))


@query("SELECT 'region/' || n_regionkey AS source, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS position, 'nation/' || n_nationkey AS concept_id, n_name AS title FROM nation")
def resolve_relations(spark, sf):
    entry = F.struct("n_nationkey", F.struct(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("resource")).alias("e"))
    listed = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias("sources"))
    sources = listed.select(F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("concept_id"), F.to_json(F.struct("sources")).alias("frontmatter_json"))
    return lookup.relations(sources, "sources", _concepts(spark, sf)).select("source", "position", "concept_id", "title")


# ---- writing


@query("WITH b AS (SELECT event_id, event_type FROM events WHERE event_id % 10 <> 3), a AS (SELECT event_id, CASE WHEN event_id % 10 = 5 THEN 'changed' ELSE event_type END AS event_type FROM events WHERE event_id % 10 <> 7) SELECT *, 'removed' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def diff_tables(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type")
    after = events.where("event_id % 10 <> 7").withColumn("event_type", F.when(F.col("event_id") % 10 == 5, "changed").otherwise(F.col("event_type")))
    return diff.changed_rows(events.where("event_id % 10 <> 3"), after)


def _write_table(spark, sf):
    customer = table(spark, sf, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias(diff.ID), F.expr("case when c_custkey % 3 <> 0 then c_mktsegment end").alias("segment"), F.col("c_name").alias("name"))
    authored = customer.where("segment is not null or cast(split(__okf_concept_id, '/')[1] as int) % 2 = 0").select(diff.ID, F.lit("segment").alias("field")).union(customer.select(diff.ID, F.lit("name")))
    return customer, authored


_KEY = "'customer/' || c_custkey AS __okf_concept_id"


@query(f"SELECT {_KEY}, 'segment' AS field, 'set' AS op, 'BUILDINGS' AS value FROM customer WHERE c_custkey % 3 <> 0 AND c_mktsegment = 'BUILDING' UNION ALL SELECT {_KEY}, 'segment', 'delete', NULL FROM customer WHERE c_custkey % 6 = 0")
def update_where(spark, sf):
    before, authored = _write_table(spark, sf)
    write = diff.Write(before).update((F.col("segment") == "BUILDING") | F.col("segment").isNull(), segment=F.when(F.col("segment") == "BUILDING", "BUILDINGS"))
    return write.row_diff(authored)


@query(f"SELECT {_KEY}, 'tier' AS field, 'set' AS op, CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 3 <> 0 THEN 'gold' ELSE 'none' END AS value FROM customer")
def alter_add(spark, sf):
    before, authored = _write_table(spark, sf)
    return diff.Write(before).add("tier", "none").update(F.col("segment") == "MACHINERY", tier=F.lit("gold")).row_diff(authored)


@query(f"SELECT {_KEY}, 'segment' AS field, 'delete' AS op, NULL::VARCHAR AS value FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def alter_drop(spark, sf):
    before, authored = _write_table(spark, sf)
    return diff.Write(before).drop("segment").update(F.lit(False), name=F.col("name")).row_diff(authored)


@query(f"SELECT {_KEY}, 'segment' AS field, 'delete' AS op, NULL::VARCHAR AS value FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0 UNION ALL SELECT {_KEY}, 'sector', 'set', c_mktsegment FROM customer WHERE c_custkey % 3 <> 0")
def alter_rename(spark, sf):
    before, authored = _write_table(spark, sf)
    return diff.Write(before).rename("segment", "market").rename("market", "sector").update(F.lit(False), sector=F.col("sector")).row_diff(authored)


@query("SELECT c_custkey FROM customer WHERE (CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END) IS DISTINCT FROM (CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'other' ELSE c_name END)")
def tamper_check(spark, sf):
    customer = table(spark, sf, "customer")
    before = customer.select("c_custkey", F.expr("case when c_custkey % 5 <> 0 then c_name end").alias("name"))
    after = customer.select("c_custkey", F.expr("case when c_custkey % 10 = 0 then null when c_custkey % 7 = 0 then 'other' else c_name end").alias("name"))
    return diff.tampered(before, after, "c_custkey", ["name"])


@query("SELECT trim(regexp_replace(regexp_replace(lower(p_name), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-') AS slug, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def import_plan(spark, sf):
    rows = table(spark, sf, "part").select("p_name", "p_brand")
    return imports.duplicate_slugs(imports.plan(rows, "Part", id_column="p_name"))


@query("SELECT 'supplier-row/' || s_suppkey AS concept_id, 'Supplier Row' AS concept_type, s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier")
def import_roundtrip(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit(None).cast("string").alias("nothing"))
    made = imports.plan(rows, "Supplier Row", id_column="s_suppkey")
    front = F.from_json("frontmatter_json", "name string, nation string")
    return bundle.concepts_of(parse_documents(made.select("path", "content"))).select("concept_id", "concept_type", front["name"].alias("name"), front["nation"].alias("nation"))


@query("SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT p_partkey AS path, p_size AS s FROM part WHERE p_partkey % 9 <> 0) b FULL JOIN (SELECT p_partkey AS path, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_partkey % 8 <> 0) a ON a.path = b.path WHERE b.path IS NULL OR a.path IS NULL OR a.s <> b.s")
def manifest_diff(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"), F.lit(1).alias("mtime_ns"))
    after = part.where("path % 8 <> 0").withColumn("size", F.when(F.col("path") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return diff.manifest_diff(part.where("path % 9 <> 0"), after)


@query("SELECT 'OKF101' AS code, 'warning' AS severity, 'region/' || r_regionkey || '.md' AS path, 'local Markdown link does not resolve: missing.md' AS message FROM region UNION ALL SELECT 'OKF002', 'error', 'nation/' || n_nationkey || '.md', 'frontmatter must contain a non-empty string type' FROM nation WHERE n_nationkey % 2 = 0")
def diagnostics_sorted(spark, sf):
    region = table(spark, sf, "region").select(*document(path("region", "r_regionkey"), {"type": F.lit("Region")}, F.lit("[x](missing.md)")))
    nation = table(spark, sf, "nation").select(*document(path("nation", "n_nationkey"), {"type": F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("N")}, F.lit("[y](../region/0.md#a)")))
    made = bundle.Bundle.of(parse_documents(region.union(nation)))
    return made.diagnostics
