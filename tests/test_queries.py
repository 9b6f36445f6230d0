"""Every query with SQL, against DuckDB on the smallest tables, as the driver does."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not k.startswith("op")))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, df.collect()) == _rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 6


def test_services(spark, tmp_path):
    from quire import cli

    (tmp_path / "a.md").write_text("---\ntype: T\n---\n[b](b.md)\n")
    (tmp_path / "b.md").write_text("---\ntype: U\nn: '1'\n---\n# B\n")
    root = str(tmp_path)
    assert cli.run(spark, ["check", root, "--classification"])[0] == 0
    assert cli.run(spark, ["inventory", root, "--digests"])[1]["types"] == [{"concept_type": "T", "n": 1}, {"concept_type": "U", "n": 1}]
    assert cli.run(spark, ["graph", root])[1]["directed_acyclic"] is True
    for kind in ("json", "zod", "pydantic", "graphql", "struct"):
        assert cli.run(spark, ["schema", root, "--kind", kind, "--infer"])[1]
    assert cli.run(spark, ["format", root])[0] == 0
    assert cli.run(spark, ["apply", root, "--sql", "UPDATE U SET n = '2'"])[1]["changed"] == ["b.md"]
    (tmp_path / "c.md").write_text("no")
    assert cli.run(spark, ["check", root])[0] == 1
    os.remove(tmp_path / "c.md")
    out = cli.run(spark, ["export", root, "--database", "kb_cli", "--overwrite"])[1]
    assert out["counts"]["links"] == 1
    spark.sql("DROP DATABASE kb_cli CASCADE")


def test_sql_functions(spark):
    from quire.functions.sql import register

    register(spark)
    row = spark.sql("SELECT kb_slug('Água x') s, kb_jcs('{\"b\":\"1\",\"a\":null}') j, kb_parse('---\\ntype: T\\n---\\nx').concept_type t, kb_markdown_facts('# H [a](b.md)').links l, kb_resolve('a/b.md', '../c.md') r, kb_excluded('v/a.md', 'v/') e, kb_try_cast_bigint('10.50') i, kb_try_cast_date('2026') d, kb_try_cast_boolean('T') b").first()
    assert tuple(row) == ("agua-x", '{"a":null,"b":"1"}', "T", ["b.md"], "c.md", True, 11, None, True)


def test_changes_stream(spark, tmp_path):
    from quire.streaming.changes import read_changes

    root = tmp_path / "kb"
    root.mkdir()
    (root / "a.md").write_text("one")
    query = read_changes(spark, str(root)).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    (root / "a.md").write_text("two!")
    (root / "b.md").write_text("three")
    query.processAllAvailable()
    os.remove(root / "a.md")
    query.processAllAvailable()
    query.stop()
    found = [(r["path"], bytes(r["content"]).decode() if r["content"] is not None else None, r["removed"]) for r in spark.table("changes").collect()]
    assert sorted(found, key=str) == sorted([("a.md", "one", False), ("a.md", "two!", False), ("b.md", "three", False), ("a.md", None, True)], key=str)


def test_graphql(spark, tmp_path):
    from quire.operators import bundle, graphql, typed
    from quire.plans.declared import declare

    (tmp_path / "a.md").write_text("---\ntype: Task\ntitle: A\ncost: 12.50\nwhen: x\n---\n[b](b.md)\n")
    (tmp_path / "b.md").write_text("---\ntype: Note\n---\n[gone](gone.md)\n")
    loaded = bundle.load_bundle(spark, str(tmp_path))
    plain = graphql.ReadAdapter(loaded)
    out = plain.execute('query Q($n: Int) { concept(id: "a") { id kind: type links { rawTarget exists } ... on Task { cost } } all: concepts(first: $n, offset: 0) { path reverseLinks { sourceId targetId } diagnostics { code } } }', {"n": 2})
    assert out["errors"] == [] and out["data"]["concept"] == {"id": "a", "kind": "Task", "links": [{"rawTarget": "b.md", "exists": True}], "cost": "12.50"}
    assert out["data"]["all"] == [{"path": "a.md", "reverseLinks": [], "diagnostics": []}, {"path": "b.md", "reverseLinks": [{"sourceId": "a", "targetId": "b"}], "diagnostics": [{"code": "OKF101"}]}]
    relations = typed.TypedRelations(loaded.concepts, {"Task": declare("CREATE TABLE Task (cost DECIMAL(9,2), \"when\" DATE)", "Task")})
    assert graphql.ReadAdapter(loaded, relations).execute('{ concept(id: "a") { cost when } }')["data"]["concept"] == {"cost": "12.50", "when": None}
    assert plain.execute('{ concept(id: "zzz") { id } }') == {"data": {"concept": None}, "errors": []}
    for bad in ("{ concept }", "{ nothing { id } }", "{ concepts(first: 0) { id } }", '{ concept(id: "a") { links { nope } } }'):
        assert plain.execute(bad)["errors"]
    from quire.plans import contract

    named = graphql.ReadAdapter(loaded, contracts=contract.contracts(loaded.concepts))
    assert "type TaskConcept implements Concept @okfType(name: \"Task\") {" in named.sdl() and "  cost: String!\n" in named.sdl()
    assert named.execute('{ concepts { __typename frontmatter ... on TaskConcept { cost } } }')["data"]["concepts"] == [{"__typename": "TaskConcept", "frontmatter": {"type": "Task", "title": "A", "cost": "12.50", "when": "x"}, "cost": "12.50"}, {"__typename": "NoteConcept", "frontmatter": {"type": "Note"}}]
    assert named.execute('{ concept(id: "b") { cost } }')["errors"]
    assert plain.execute("mutation { x }")["data"] is None and plain.execute("{ a")["data"] is None
    loaded.close()
