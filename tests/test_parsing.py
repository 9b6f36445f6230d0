import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import formatting, paths
from quire.functions import frontmatter as fm
from quire.functions.markdown import facts
from quire.operators.parse import parse_one
from quire.sources.exclusion import Exclusion


@pytest.mark.parametrize(
    ("text", "front", "body"),
    [
        ("---\na: b\n---\nbody", {"a": "b"}, "body"),
        ("﻿--- \t\na: b\n---\t\n", {"a": "b"}, ""),
        ("---\na: x --- y\n---\nbody\n---\nmore", {"a": "x --- y"}, "body\n---\nmore"),
        ("---\n---\nx", {}, "x"),
        ("---\n\n---", {}, ""),
        ("---\ncode: 0012\nflag: false\nday: 2026-01-02\nnone: null\ntilde: ~\nempty:\n---\n", {"code": "0012", "flag": "false", "day": "2026-01-02", "none": None, "tilde": None, "empty": None}, ""),
        ("---\nbase: &b {x: 1}\nown: {<<: *b, y: 2}\n2020-01-01: d\n---\n", {"base": {"x": "1"}, "own": {"x": "1", "y": "2"}, "2020-01-01": "d"}, ""),
        ("---\na: !!int 5\nb: !!bool true\na: 6\n---\n", {"a": "6", "b": "true"}, ""),
        ("---\r\na: b\r\n---\r\nx\ry\r\n", {"a": "b"}, "x\ny\n"),
    ],
)
def test_frontmatter(text, front, body):
    assert fm.required(text) == (front, body)


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("no", "must start with YAML frontmatter"), ("--- nope\na: b\n---\n", "must start with"), ("---", "must start with"), ("---\na: b\n", "must start with"),
        ("---\n- a\n---\n", "must be a YAML mapping"), ("---\na: [\n---\n", "invalid YAML frontmatter"), ("---\na: !!binary aGk=\n---\n", "unsupported YAML value: a"),
        ("---\na: !!set {x, y}\n---\n", "unsupported YAML value: a"), ("---\n~: x\n---\n", "keys must be strings: None"), ("---\na: &x [*x]\n---\n", "cyclic YAML anchor"),
    ],
)
def test_bad_frontmatter(text, said):
    with pytest.raises(fm.DocumentError, match=said):
        fm.required(text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("ab_é", min_size=1, max_size=4), st.one_of(st.none(), st.text("xyz 1:#'\"é", max_size=8)), max_size=4), st.text("ab\n-# é", max_size=40))
def test_rendered_frontmatter_reads_back(front, body):
    import yaml

    block = yaml.safe_dump(front, allow_unicode=True, default_style='"') if front else ""
    assert fm.required(f"---\n{block}---\n{body}") == (front, body)


def test_digests():
    assert fm.canonical_json({"b": None, "a": ["x", {"\U0001f600": "1", "דּ": "2"}]}) == '{"a":["x",{"\U0001f600":"1","דּ":"2"}],"b":null}'
    assert fm.source_digest("﻿a\r\n") == "sha256:" + hashlib.sha256("﻿a\r\n".encode()).hexdigest()
    assert fm.parsed_digest({"a": "b"}, "x\r\ny") == fm.parsed_digest({"a": "b"}, "x\ny")
    with pytest.raises(ValueError):
        fm.canonical_json("\ud800")


@pytest.mark.parametrize(
    ("text", "links", "headings"),
    [
        ("# A\n\n[x](a.md) ![i](b.png) `[n](c.md)`\n", ["a.md"], [(1, "A")]),
        ("```\n[n](a.md)\n# h\n```\n## B ##\n", [], [(2, "B")]),
        ("T\n===\n\n[r] [f][R] [c][]\n\n[r]: <path with spaces.md> 'T'\n[c]: c.md\n", ["path%20with%20spaces.md", "path%20with%20spaces.md", "c.md"], [(1, "T")]),
        ("[g](guide_(v2).md) <https://e.com/a> [a ![i](i.png) b](l.md \"t\")", ["guide_(v2).md", "https://e.com/a", "l.md"], []),
        ("> q [q](q.md)\nlazy [z](z.md)\n\n- i [i](i.md)\n  c [j](j.md)\n\n      code [n](n.md)\n", ["q.md", "z.md", "i.md", "j.md"], []),
        ("<div>\n[n](a.md)\n</div>\n\n[y](y.md)", ["y.md"], []),
        ("#\n# \n#nope\n", [], [(1, ""), (1, "")]),
        ("[a [b](b.md) c](c.md)", ["b.md"], []),
        ("\\[n](a.md) [m](a\\_b.md) [e](a&amp;b.md) [p](100%.md) [j](javascript:x)", ["a_b.md", "a&b.md", "100%25.md"], []),
        ("    [n](a.md)\n\npara\n    [y](y.md)", ["y.md"], []),
        ("[x](a.md", [], []), ("", [], []), ("1. a\n2. [b](b.md)\n\n***\n", ["b.md"], []),
    ],
)
def test_facts(text, links, headings):
    assert facts(text) == (links, headings)


@settings(max_examples=200, deadline=None)
@given(st.text("[]()<>`#*-_=! \n\tab.md:&\\1.", max_size=80))
def test_facts_never_fail(text):
    links, headings = facts(text)
    assert all(isinstance(x, str) for x in links) and all(1 <= n <= 6 for n, _ in headings)


def test_parse_one():
    good = parse_one("a/b.md", "---\ntype: ' T '\ntitle: [x]\n---\n[l](c.md) [n](d.txt)")
    assert (good["concept_type"], good["title"], good["links"], good["error"]) == ("T", None, ["c.md"], None)
    assert parse_one("a.md", b"\xff")["error"] == "document must be valid UTF-8"
    log = parse_one("x/log.md", "# L\n\n## 2020-01-01\n")
    assert log["is_reserved"] and log["headings"][1] == {"level": 2, "text": "2020-01-01"} and not log["has_frontmatter"]
    broken = parse_one("index.md", "---\na: [\n---\nx")
    assert broken["error"] and broken["body"].startswith("---")


@pytest.mark.parametrize(
    ("source", "target", "found"),
    [
        ("a/b.md", "c.md", "a/c.md"), ("a/b.md", "../c.md#x", "c.md"), ("a/b.md", "../../c.md", None), ("a/b.md", "/x/./y.md?q", "x/y.md"), ("b.md", "a%20b+c.md", "a b+c.md"),
        ("b.md", "https://e.com/x.md", None), ("b.md", "//h/x.md", None), ("b.md", "#top", None), ("b.md", "http://[x/y.md", None), ("a/b.md", "..", "."),
    ],
)
def test_resolve(source, target, found):
    assert paths.resolve(source, target) == found


@pytest.mark.parametrize(("name", "slug"), [("Revisão Técnica", "revisao-tecnica"), ("a/b  c", "a-b-c"), ("--X!!1--", "x1"), ("日本", ""), ("ﬁn", "fin")])
def test_slugs(name, slug):
    assert paths.type_slug(name) == slug
    assert paths.spec_path("s/{slug}.md", name) == (f"s/{slug}.md" if slug else None)


def test_names():
    assert paths.concept_id("a.b/c.d.md") == "a.b/c.d" and paths.concept_id(".md") == ".md" and paths.concept_id("x/y") == "x/y"
    assert paths.fold("ÉaB") == "Éab" and paths.looks_like_link("x/y.MD#a") and not paths.looks_like_link("see y.md")
    assert paths.declaration_path("s/{slug}.md", "A b") == "s/a-b.schema.sql"
    with pytest.raises(paths.TemplateError):
        paths.spec_path("s/x.md", "A")


CASES = [
    ([], {"a.md": False}), (["vendor"], {"vendor/a.md": True, "libs/vendor/a.md": True, "vendors/a.md": False}), (["/vendor"], {"vendor/a.md": True, "libs/vendor/a.md": False}),
    (["docs/vendor"], {"docs/vendor/a.md": True, "libs/docs/vendor/a.md": False}), (["vendor/"], {"vendor": False, "vendor/a.md": True}), (["*.md"], {"a.md": True, "x/b.md": True, "x/b.markdown": False}),
    (["/*.md"], {"a.md": True, "x/b.md": False}), (["a/**/z.md"], {"a/z.md": True, "a/b/c/z.md": True, "az.md": False}), (["**/x"], {"x/a.md": True, "q/x/a.md": True}), (["x/**"], {"x/a.md": True, "y/x/a.md": False}),
    (["vendor", "!vendor/keep"], {"vendor/a.md": True, "vendor/keep/a.md": False}), (["!a.md", "a.md"], {"a.md": True}), (["# c", "", "\\#x.md", "\\!y.md"], {"#x.md": True, "!y.md": True, "c": False}),
    (["a?.md", "b[0-2].md", "c[!x].md"], {"a1.md": True, "a12.md": False, "b2.md": True, "b3.md": False, "cx.md": False, "cy.md": True}), (["a.md  ", "b\\ "], {"a.md": True, "b ": True, "axmd": False}),
]


@pytest.mark.parametrize(("patterns", "wanted"), CASES)
def test_exclusion(spark, patterns, wanted):
    from pyspark.sql import functions as F

    rules = Exclusion(patterns)
    assert {p: rules.excludes(p) for p in wanted} == wanted
    df = spark.createDataFrame([(p,) for p in wanted], "path string")
    assert {r[0]: r[1] for r in df.select("path", rules.column(F.col("path"))).collect()} == wanted


def test_exclusion_wants_a_list():
    with pytest.raises(TypeError):
        Exclusion("vendor")


@pytest.mark.parametrize(
    ("text", "made"),
    [
        ("# Heading\n\n-   item\n", "# Heading\n\n- item\n"), ("1. a\n1. b\n1. c\n", "1. a\n2. b\n3. c\n"), ("---\ncount: 0012\n---\n\n# H\n", "---\ncount: 0012\n---\n\n# H\n"),
        ("T\n\n```py\n01. no\n```\n", "T\n\n```py\n01. no\n```\n"), ("a  \nb   \n\n\n\nc", "a  \nb\n\nc\n"), ("## T ##\n", "## T\n"), ("* a\n* b\n", "- a\n- b\n"),
    ],
)
def test_format(text, made):
    assert formatting.canonical(text) == made
    assert formatting.canonical(made) == made


def test_lexemes_are_whole_texts(spark):
    """A line break at the end makes it another text."""
    from pyspark.sql import functions as F

    from quire.functions import lexemes

    texts = ["12", "1.5", "2024-02-29", "2024-02-29T10:00:00Z"]
    rows = spark.createDataFrame([(t, t + "\n") for t in texts], "a string, b string")
    for kind, i in (("integer", 0), ("number", 1), ("date", 2), ("datetime", 3)):
        r = rows.where(F.col("a") == texts[i]).select(lexemes.is_kind(F.col("a"), kind), lexemes.is_kind(F.col("b"), kind)).first()
        assert tuple(r) == (True, False)


def test_names_and_casts():
    from quire.plans import contract

    assert [contract.model_name(t, "") for t in ("my type", "9 lives", "???", "água/x_y")] == ["MyType", "Concept9Lives", "Concept", "ÁguaXY"]
    with pytest.raises(contract.NameCollisionError, match="'a b' and 'a-b' both normalize to 'AB'"):
        contract.unique_names(["a-b", "a b"], "")
    assert contract.parse_casts(["n=Integer", " a.b = DATE ", "n=number"]) == {"n": "number", "a.b": "date"}
    with pytest.raises(contract.CastError, match="invalid cast 'n=money'; expected FIELD=TYPE, where TYPE is boolean, date"):
        contract.parse_casts(["n=money"])
