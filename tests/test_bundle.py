import os

import pytest

from pyspark.sql import functions as F

from quire.operators import apply, bundle, diff, graph, imports, links, lookup, relational, rules, typed
from quire.plans import constraints, contract, declared, sqltext
from quire.functions.casts import logical_type
from quire.sources.bundle_source import read_bundle
from quire.sources.snapshot import EditError, StaleError, edit_frontmatter


def write(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def root(tmp_path):
    write(
        tmp_path,
        {
            "index.md": "---\nokf_version: '1'\n---\n# Root\n",
            "a.md": "---\ntype: T\ntitle: A\nlink: x/b.md\n---\n[b](x/b.md) [b](x/b.md) [gone](gone.md) [out](../out.md) [log](log.md) [bad](bad.md)\n",
            "x/b.MD": "---\ntype: T\n---\n[a](../a.md#x)\n",
            "x/b.md": "---\ntype: ' U '\ntitle: B\n---\n",
            "a-b.md": "---\ntitle: no type\n---\n",
            "bad.md": b"\xff\xfe",
            "log.md": "# Log\n\n## 2026-01-02\n\n## 2026-01-03\n\n## 2026-02-30\n\n## soon\n\n```\n## 1999-01-01\n```\n",
            "x/index.md": "---\na: b\n---\n## no title\n",
            ".okf/spec.md": "---\ntype: Spec\n---\n",
            ".git/no.md": "x",
            "vendor/v.md": "---\ntype: V\n---\n",
            ".okfignore": "# c\r\nvendor/\r\n",
        },
    )
    os.symlink(tmp_path / "a.md", tmp_path / "link.md")
    return str(tmp_path)


def test_relations(spark, root):
    loaded = bundle.load_bundle(spark, root)
    concepts = {r["path"]: r for r in loaded.concepts.collect()}
    assert set(concepts) == {"a.md", "x/b.MD", "x/b.md", "a-b.md", ".okf/spec.md"}
    assert concepts["x/b.md"]["concept_type"] == "U" and concepts["a-b.md"]["concept_type"] == "" and concepts["x/b.MD"]["title"] is None
    found = sorted((r["source_id"], r["raw_target"], r["target_id"], r["exists"]) for r in loaded.links.where("source_id = 'a'").fillna("-").collect())
    assert found == [("a", "bad.md", "bad", True), ("a", "gone.md", "-", False), ("a", "log.md", "-", True), ("a", "x/b.md", "x/b", True), ("a", "x/b.md", "x/b", True)]
    assert {r["path"] for r in loaded.reserved.collect()} == {"index.md", "log.md", "x/index.md"}
    said = [(r["code"], r["path"], r["severity"]) for r in loaded.diagnostics.collect()]
    assert said == sorted(said, key=lambda x: (x[1], x[2], x[0]))
    assert [(c, p) for c, p, _ in said] == [("OKF002", "a-b.md"), ("OKF101", "a.md"), ("OKF001", "bad.md"), ("OKF008", "log.md"), ("OKF008", "log.md"), ("OKF009", "log.md"), ("OKF004", "x/index.md"), ("OKF005", "x/index.md")]
    assert not loaded.is_conformant and {r["concept_type"]: r["n"] for r in loaded.inventory().collect()} == {"": 1, "Spec": 1, "T": 2, "U": 1}
    loaded.register("kb_")
    assert spark.sql("SELECT count(*) FROM kb_links WHERE NOT exists").first()[0] == 1
    loaded.close()
    report = bundle.validate_path(spark, root, spec_template=".okf/{slug}.md")
    assert report.markdown_count == 9 and {v.path for v in report.violations if v.code == "OKF010"} == {".okf/t.md", ".okf/u.md"}


def test_order_discovery_and_pushdown(spark, root):
    found = read_bundle(spark, root, capability="identity").orderBy("ordinal").collect()
    assert [r["path"] for r in found] == sorted((r["path"] for r in found), key=lambda p: p.split("/"))
    assert all(r["content"] is None and r["size"] for r in found)
    one = read_bundle(spark, root).where("path = 'a.md'").collect()
    assert len(one) == 1 and one[0]["content"].startswith(b"---")
    assert read_bundle(spark, root, exclude=["*.md"]).where("path = 'a.md'").isEmpty()
    with pytest.raises(NotADirectoryError):
        read_bundle(spark, root + "/none")
    with pytest.raises(TypeError):
        read_bundle(spark, root, exclude="x")


def test_classify_and_ingest(spark, root):
    kinds = {r["path"]: r["class"] for r in bundle.classify(spark, root, ["x/b.MD"]).collect()}
    assert kinds["a.md"] == "concept" and kinds["a-b.md"] == kinds["bad.md"] == "invalid_or_untyped" and kinds["log.md"] == "reserved" and kinds["x/b.MD"] == "ignored"
    light = bundle.ingest(spark, root).collect()
    assert [r["ordinal"] for r in light] == list(range(len(light))) and {r["classification"] for r in light} == {"candidate", "reserved"}
    full = {r["path"]: r for r in bundle.ingest(spark, root, ("body", "digests", "frontmatter", "markdown_facts")).collect()}
    assert full["x/b.md"]["classification"] == "typed: U " and full["bad.md"]["classification"] == "invalid" and full["bad.md"]["size"] is None and full["a-b.md"]["classification"] == "untyped"
    assert full["a.md"]["links"][0] == "x/b.md" and full["a.md"]["source_digest"].startswith("sha256:")


@pytest.mark.parametrize("small", [200_000, 0])
def test_graph(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    make = lambda *e: spark.createDataFrame(list(e), "source string, target string")
    nodes = spark.createDataFrame([(c,) for c in "abcdefgh"], "id string")
    edges = make(("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("f", "f"), ("a", "b"))
    one = graph.summary(nodes, edges).first()
    assert (one["nodes"], one["edges"], one["weak_components"], one["strong_components"], one["is_dag"]) == (8, 8, 4, 5, False)
    strong = {r["node"]: r["component"] for r in graph.strong_components(nodes, edges).collect()}
    assert strong["a"] == strong["b"] == strong["c"] == "a" and strong["d"] == strong["e"] == "d" and strong["f"] == "f"
    assert graph.is_dag(make(("a", "b"), ("b", "c"), ("a", "c"))) and not graph.is_dag(make(("a", "a")))
    weak = {r["node"]: r["component"] for r in graph.weak_components(nodes, make(*[(chr(97 + i), chr(98 + i)) for i in range(6)])).collect()}
    assert set(weak.values()) == {"a", "h"}
    degree = {r["node"]: (r["outgoing"], r["incoming"]) for r in graph.degrees(nodes, edges).collect()}
    assert degree["a"] == (2, 1) and degree["f"] == (1, 1) and degree["h"] == (0, 0)


def test_constraints(spark, tmp_path):
    write(tmp_path, {f"r{i}.md": f"---\ntype: Regra\nnome: {n}\n---\n" for i, n in enumerate(["a", "b", "a", "null"])} | {"f1.md": "---\ntype: Fund\nid: '1'\nregra: a\n---\n", "f2.md": "---\ntype: Fund\nID: '1'\nregra: zzz\n---\n", "f3.md": "---\ntype: Fund\nregra: null\n---\n", "f4.md": "---\ntype: Fund\nid: [x]\n---\n", "f5.md": "---\ntype: Fund\nid: '7'\nId: '8'\n---\n"})
    schema = constraints.constraints("CREATE TABLE Regra (nome VARCHAR UNIQUE); CREATE TABLE fund (id VARCHAR PRIMARY KEY, regra TEXT REFERENCES Regra(nome));")
    loaded = bundle.load_bundle(spark, str(tmp_path))
    found = sorted((r["code"], r["path"]) for r in relational.check_constraints(loaded.concepts, schema).collect())
    assert ("OKF021", "r2.md") in found and ("OKF021", "f2.md") in found and ("OKF022", "f2.md") in found and ("OKF021", "f3.md") in found and ("OKF020", "f4.md") in found and ("OKF020", "f5.md") in found
    assert ("OKF022", "f3.md") not in found and ("OKF021", "r3.md") not in found
    said = {(r["code"], r["path"]): r["message"] for r in relational.check_constraints(loaded.concepts, schema).collect()}
    assert said["OKF021", "r2.md"] == "constraint 'Regra_nome_key' on 'Regra' duplicates key ('a',); first seen at r0.md"
    assert said["OKF021", "f3.md"] == "primary key 'fund_id_pkey' on 'fund' requires ('id',) to be present"
    assert said["OKF022", "f2.md"] == "foreign key 'fund_regra_nome_fkey' on 'fund' has no matching 'Regra'('nome',) for ('zzz',)"
    assert said["OKF020", "f4.md"] == "relational constraint 'fund_id_pkey' requires scalar string column 'id'; found list"
    assert said["OKF020", "f5.md"] == "relational constraint 'fund_id_pkey' cannot resolve column 'id': frontmatter keys collide under DuckDB identifier equality: 'Id', 'id'"
    texts = ["plain", "it's", 'both \'"', "back\\slash", "line\nend", '"']
    shown = spark.createDataFrame([(t,) for t in texts], "x string").select("x", relational.quoted(F.col("x")).alias("q")).collect()
    assert {r["x"]: r["q"] for r in shown} == {t: repr(t) for t in texts}
    loaded.close()


def test_typed_relations(spark, tmp_path):
    write(tmp_path, {"a.md": "---\ntype: Rotina\ncusto: '12.50'\ntags: ['1', '2']\ncodigo: 0012\nx: {y: 1}\n---\nl1\r\nl2\n", "b.md": "---\ntype: Rotina\nCusto: n/a\ntags: ['3', x, null]\ncodigo: 7\n---\n", "spec/rotina.schema.sql": "CREATE TABLE \"rotina\" (custo DECIMAL(18,2), quando TIMESTAMPTZ, tags BIGINT[]);\nCOMMENT ON COLUMN rotina.custo IS 'It''s money.';"})
    loaded = bundle.load_bundle(spark, str(tmp_path))
    found = declared.discover(tmp_path, loaded.concept_types, "spec/{slug}.md")
    with typed.TypedRelations(loaded.concepts, found) as relations:
        rows = relations["Rotina"].orderBy("__okf_path").collect()
        assert relations["Rotina"].schema["custo"].metadata["comment"] == "It's money." and list(relations) == ["Rotina"] and len(relations) == 1
        assert str(rows[0]["custo"]) == "12.50" and rows[1]["custo"] is None and rows[1]["__okf_raw_custo"] == "n/a"
        assert rows[0]["tags"] == [1, 2] and rows[1]["tags"] == [3, None, None] and rows[0]["quando"] is None and rows[0]["codigo"] == "0012" and "x" not in rows[0]
        assert rows[0]["__okf_body_lines"] == ["l1", "l2"]
        relations.register()
        assert spark.sql("SELECT sum(custo) FROM `Rotina`").first()[0] is not None
    with pytest.raises(RuntimeError):
        relations["Rotina"]
    with pytest.raises(declared.DeclarationError, match="did not leave behind"):
        declared.declare("CREATE TABLE other (a INT)", "Rotina")
    with pytest.raises(declared.DeclarationError, match="failed"):
        declared.declare("SELECT 1", "Rotina")
    counts = typed.export(spark, {"concepts": loaded.concepts, "revisão x": loaded.links}, "kb_test", True)
    assert counts["concepts"] == 2 and spark.table("kb_test.revisao_x").count() == 0
    spark.sql("COMMENT ON TABLE kb_test.concepts IS 'ours'")
    spark.sql("ALTER TABLE kb_test.concepts ALTER COLUMN title COMMENT 'its name'")
    typed.export(spark, {"concepts": loaded.concepts}, "kb_test", True)
    assert typed._comments(spark, "kb_test.concepts") == ("ours", {"title": "its name"})
    spark.sql("ALTER TABLE kb_test.concepts RENAME TO kb_test.concepts__old")  # an export that was stopped
    with pytest.raises(FileExistsError):
        typed.export(spark, {"concepts": loaded.concepts}, "kb_test")
    with pytest.raises(ValueError):
        typed.export(spark, {}, "a-b")
    spark.sql("DROP DATABASE kb_test CASCADE")
    loaded.close()


def test_logical_types():
    assert (logical_type("decimal(18, 4)").sql, logical_type("TIMESTAMP WITH TIME ZONE").family, logical_type("int8").sql) == ("DECIMAL(18,4)", "timestamptz", "BIGINT")
    assert logical_type("VARCHAR[][]").element.family == "list" and logical_type("INTERVAL").family == "unsupported" and logical_type("uuid").kind == "string"


def test_contracts(spark, tmp_path):
    write(tmp_path, {"a.md": "---\ntype: Task\nn: '1'\nwhen: 2026-01-01\nsub: {x: '1', y: null}\nlist: [a, null]\nmix: a\n---\n", "b.md": "---\ntype: Task\nn: '2.5'\nwhen: 2026-01-02\nsub: {x: '2'}\nlist: [b]\nmix: [a]\n---\n", "c.md": "---\ntitle: t\n---\n"})
    loaded = bundle.load_bundle(spark, str(tmp_path))
    found = {c.concept_type: c for c in contract.contracts(loaded.concepts, infer=True)}
    schema = contract.render_json_schema(list(found.values()))["Task"]
    p = schema["properties"]
    assert p["type"]["const"] == "Task" and p["n"]["type"] == "number" and p["when"]["format"] == "date" and p["mix"] == {"title": "Mix"} and p["list"]["items"] == {"anyOf": [{"type": "string"}, {"type": "null"}]}
    assert p["sub"]["properties"]["x"]["type"] == "integer" and p["sub"]["required"] == ["x"] and "title" in p and "title" not in schema["required"] and set(found) == {"Task", "concept"}
    assert contract.contracts(loaded.concepts, casts=["n=number"])[0].root.fields
    for bad in (["n=integer"], ["nothing=date"], ["n"], ["sub=string"]):
        with pytest.raises(contract.CastError):
            contract.contracts(loaded.concepts, casts=bad)
    everything = list(found.values())
    assert "z.union" not in contract.render_zod(everything) and "export const TaskSchema = z.object" in contract.render_zod(everything, "astro")
    space: dict = {}
    exec(compile(contract.render_pydantic(everything), "m", "exec"), space)
    assert "type Query {" in contract.render_graphql(everything)
    assert contract.struct_type(found["Task"].root)["n"].dataType.simpleString() == "double"
    over = contract.contracts(loaded.concepts, True, declared={"Task": {"n": logical_type("DECIMAL(5,2)"), "extra": logical_type("BIGINT[]")}})
    own = contract.render_json_schema(over)["Task"]["properties"]
    assert own["n"]["multipleOf"] == 0.01 and own["extra"]["items"]["type"] == "integer"
    assert typed.starter(loaded.concepts)["Task"] == 'CREATE TABLE "Task" (\n    "n" DOUBLE,\n    "when" DATE\n);\n'
    loaded.close()


def test_lookups(spark, root):
    loaded = bundle.load_bundle(spark, root)
    assert lookup.concept(loaded.concepts, "a").count() == 1 and lookup.find(loaded.concepts, "x/b.md").first()["path"] in ("x/b.md", "x/b.MD")
    assert [r["concept_id"] for r in lookup.page(loaded.concepts, 2, 1).collect()] == ["a", "a-b"]
    for bad in ({"first": 0}, {"first": 1001}, {"offset": -1}):
        with pytest.raises(ValueError):
            lookup.page(loaded.concepts, **bad)
    record = {r["path"]: r for r in lookup.records(loaded.concepts, loaded.links, loaded.diagnostics).collect()}
    assert len(record["a.md"]["links"]) == 5 and len(record["a.md"]["diagnostics"]) == 1 and record[".okf/spec.md"]["links"] == []
    sources = spark.createDataFrame([("s", '{"r": [{"resource": "x/b.md"}, {"resource": "a"}]}'), ("none", "{}")], "concept_id string, frontmatter_json string")
    got = lookup.relations(sources, "r", loaded.concepts.where("path <> 'x/b.MD'")).orderBy("position").collect()
    assert [r["concept_id"] for r in got] == ["x/b", "a"] and lookup.relations(sources, "r", loaded.concepts, concept_type="V").isEmpty()
    for bad in ('{"r": "x"}', '{"r": ["x"]}', '{"r": [{"resource": " "}]}', '{"r": [{"resource": "zzz"}]}'):
        with pytest.raises(Exception):
            lookup.relations(spark.createDataFrame([("s", bad)], "concept_id string, frontmatter_json string"), "r", loaded.concepts).collect()
    loaded.close()


def test_edits_keep_other_bytes():
    text = "﻿---\r\ntype: T # c\r\na: 'x'\r\nlist:\r\n  - 1\r\n\r\nb: y\r\n---\r\nbody\r\n".encode()
    assert edit_frontmatter(text, {"a": "z"}) == text.replace(b"a: 'x'", b"a: z")
    assert edit_frontmatter(text, {"list": None}) == text.replace(b"list:\r\n  - 1\r\n", b"")
    assert edit_frontmatter(text, {"new": "1: 2"}) == text.replace(b"b: y\r\n", b"b: y\r\nnew: '1: 2'\r\n")
    for bad in ({"k": "v"}, ):
        with pytest.raises(EditError):
            edit_frontmatter(b"no frontmatter", bad)
    with pytest.raises(EditError):
        edit_frontmatter(b"---\n{a: b}\n---\n", {"a": "c"})


def test_sql_text():
    steps, update = sqltext.write_script("ALTER TABLE \"A b\" ADD COLUMN x VARCHAR DEFAULT 'q;''r'; ALTER TABLE \"A b\" RENAME COLUMN x TO y; -- c\nUPDATE \"A b\" SET y = upper(\"z z\"), k = 'a,b' WHERE y IN ('x', 'y') AND k > 1;")
    assert steps[0].default == "q;'r" and steps[1].new == "y" and update.assignments == (("y", "upper(`z z`)"), ("k", "'a,b'")) and update.where == "y IN ('x', 'y') AND k > 1"
    for bad in ("", "SELECT 1", "UPDATE t SET", "DROP TABLE t; UPDATE t SET a = 1", "UPDATE t SET a = 1; UPDATE t SET b = 2", "ALTER TABLE t ADD a INT", 'UPDATE t SET a = "x'):
        with pytest.raises(sqltext.SqlError):
            sqltext.write_script(bad)


def test_apply(spark, tmp_path):
    write(tmp_path, {"a.md": "---\ntype: T\ns: old\nk: keep\nnone: null\n---\nA\n", "b.md": "---\ntype: T\ns: other\n---\nB\n", "c.md": "---\ntype: U\ns: old\nz: [1]\n---\n"})
    root = str(tmp_path)
    dry = apply.apply_sql(spark, root, "UPDATE T SET s = 'new' WHERE s = 'old'")
    assert dry["changed"] == ["a.md"] and not dry["written"] and "old" in (tmp_path / "a.md").read_text()
    with pytest.raises(StaleError):
        apply.apply_sql(spark, root, "UPDATE T SET s = 'new' WHERE s = 'old'", write=True, expected_token="x")
    done = apply.apply_sql(spark, root, "UPDATE T SET s = 'new' WHERE s = 'old'", write=True, expected_token=dry["preview_token"])
    assert done["written"] and (tmp_path / "a.md").read_text() == "---\ntype: T\ns: new\nk: keep\n---\nA\n"  # a selected null goes
    assert apply.apply_sql(spark, root, "ALTER TABLE T RENAME COLUMN s TO q; ALTER TABLE T RENAME COLUMN q TO r; UPDATE T SET __okf_path = __okf_path WHERE FALSE", write=True)["changed"] == ["a.md", "b.md"]
    assert (tmp_path / "b.md").read_text() == "---\ntype: T\nr: other\n---\nB\n"
    assert apply.apply_sql(spark, root, "ALTER TABLE T DROP COLUMN k; UPDATE T SET r = r WHERE FALSE", write=True)["changed"] == ["a.md"]
    assert apply.apply_sql(spark, root, "ALTER TABLE T ADD COLUMN n VARCHAR DEFAULT '1'; UPDATE T SET n = '2' WHERE r = 'other'", write=True)["written"]
    assert "n: '1'" in (tmp_path / "a.md").read_text() or "n: 1" in (tmp_path / "a.md").read_text()
    for bad in ("UPDATE V SET a = 'b'", "UPDATE T SET nope = 'b'", "UPDATE T SET __okf_path = 'x'", "ALTER TABLE T DROP COLUMN __okf_body; UPDATE T SET r = 'x'", "ALTER TABLE U ADD COLUMN z VARCHAR; UPDATE U SET s = 'x'", "ALTER TABLE U ADD COLUMN zz VARCHAR; UPDATE T SET r = 'x'"):
        with pytest.raises(diff.WriteError):
            apply.apply_sql(spark, root, bad)
    edited = apply.edit_body(spark, root, "a", "new body\n", write=True)
    assert edited["written"] and (tmp_path / "a.md").read_text().endswith("---\nnew body\n")
    with pytest.raises(StaleError):
        apply.edit_body(spark, root, "a", "x", expected_source_digest="sha256:0")
    assert apply.replace_values(spark, root, "U", "s", "old", "newer", write=True)["changed"] == ["c.md"]
    assert apply.replace_values(spark, root, "U", "s", "newer", "it's \\ \"so\"", write=True)["changed"] == ["c.md"]
    assert apply.replace_values(spark, root, "U", "s", "it's \\ \"so\"", "old")["changed"] == ["c.md"]
    plan = apply.scaffold(spark, root, "spec/{slug}.md", True)
    assert plan["specs"] == {"created": [], "would_create": ["spec/t.md", "spec/u.md"], "collisions": [], "written": False} and not (tmp_path / "spec").exists()
    made = apply.scaffold(spark, root, "spec/{slug}.md", True, write=True)
    assert made["specs"]["created"] == ["spec/t.md", "spec/u.md"] and made["schemas"]["created"] == ["spec/t.schema.sql", "spec/u.schema.sql"]
    assert (tmp_path / "spec/t.md").read_text().startswith("---\ntype: Spec\n---\n\n# T\n")
    write(tmp_path, {"d.md": "---\ntype: t\n---\n"})
    clash = apply.scaffold(spark, root, "kinds/{slug}.md", write=True)["specs"]
    assert clash["collisions"] == [{"path": "kinds/t.md", "types": ["T", "t"]}] and not clash["written"] and not (tmp_path / "kinds").exists()


def test_import(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name,flag\nA 1,x,true\nB,,false\n")
    root = str(tmp_path / "kb")
    os.makedirs(root)
    dry = imports.import_rows(spark, str(tmp_path / "in.csv"), root, "My Row", "id")
    assert dry["would_create"] == ["my-row/a-1.md", "my-row/b.md"] and not dry["written"]
    done = imports.import_rows(spark, str(tmp_path / "in.csv"), root, "My Row", "id", write=True, expected_token=dry["preview_token"])
    assert done["written"] and "flag: 'True'" in open(f"{root}/my-row/a-1.md").read() or "flag: True" in open(f"{root}/my-row/a-1.md").read()
    assert imports.import_rows(spark, str(tmp_path / "in.csv"), root, "My Row", "id", write=True)["skipped_existing"] == ["my-row/a-1.md", "my-row/b.md"]
    assert imports.import_rows(spark, str(tmp_path / "in.csv"), root, "My Row", "id", on_conflict="verify-identical")["matched_existing"] == ["my-row/a-1.md", "my-row/b.md"]
    (tmp_path / "dup.csv").write_text("id\nA b\na-b\n")
    assert imports.import_rows(spark, str(tmp_path / "dup.csv"), root, "D", "id", write=True)["duplicate_ids"] == ["a-b"]
    numbered = imports.plan(spark.createDataFrame([("z",), ("y",), ("x",)], "n string"), "N").orderBy("path").collect()
    assert [r["path"] for r in numbered] == ["n/000000.md", "n/000001.md", "n/000002.md"] and "n: x" in numbered[0]["content"]
    for bad in (lambda: imports.plan(spark.createDataFrame([("a",)], "type string"), "T"), lambda: imports.read_table(spark, "x.txt"), lambda: imports.import_rows(spark, "x.csv", root, "T", overwrite=True, on_conflict="verify-identical")):
        with pytest.raises(imports.ImportFailure):
            bad()


def test_manifest_and_tamper(spark):
    b = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, size long, mtime_ns long")
    a = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, size long, mtime_ns long")
    assert {r["path"]: r["change"] for r in diff.manifest_diff(b, a).collect()} == {"b": "changed", "c": "removed", "d": "added"}
    assert [r[0] for r in diff.tampered(b, a, "path", ["size"]).collect()] == ["b"]


def test_missing_specs(spark):
    types = spark.createDataFrame([("A b",), ("日本",), ("",), ("A b",)], "concept_type string")
    known = spark.createDataFrame([("s/x.md",)], "path string")
    found = {(r["path"], r["severity"]) for r in rules.missing_specs(types, known, "s/{slug}.md", True).collect()}
    assert found == {("s/a-b.md", "error"), ("s/{slug}.md", "error")}


def test_order_of_partitions_does_not_matter(spark, root):
    one = bundle.load_bundle(spark, root, partitions=1)
    many = bundle.load_bundle(spark, root, partitions=7)
    for name in ("concepts", "links", "reserved", "diagnostics"):
        assert sorted(map(str, getattr(one, name).collect())) == sorted(map(str, getattr(many, name).collect()))
    assert links.edges(one.links, one.concepts).count() == links.edges(many.links, many.concepts).count()
    one.close()
    many.close()
