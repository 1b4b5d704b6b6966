"""Spans, typed front matter, links that follow moves."""

import json

import pytest
from pyspark.sql import functions as F
from vellum.functions import markdown
from vellum.sources import notes as vault

BODY = """---
title: "x"
---
# One [[a]]
see [[b|B]] and ![[c#part]] or [t](d/e.md#s "w") `[[no]]`
```
[[code]]
# not a heading
```
$$
[[math]]
$$ then [[d]]
## Two ##
~~~
[[open"""


def test_spans_have_the_offsets_of_their_text():
    found = markdown.spans_of(BODY)
    for s in found:
        if s["target"] is not None:
            assert BODY[s["target_lo"] : s["target_hi"]] == s["target"]
    shown = [(s["kind"], BODY[s["lo"] : s["hi"]].split("\n")[0], s["line"]) for s in found]
    assert shown == [
        ("frontmatter", "---", 1),
        ("heading", "# One [[a]]", 4),
        ("link", "[[a]]", 4),
        ("link", "[[b|B]]", 5),
        ("embed", "![[c#part]]", 5),
        ("link", '[t](d/e.md#s "w")', 5),
        ("code", "`[[no]]`", 5),
        ("code", "```", 6),
        ("math", "$$", 10),
        ("link", "[[d]]", 12),
        ("heading", "## Two ##", 13),
        ("code", "~~~", 14),
    ]
    assert [(s["level"], s["shown"]) for s in found if s["kind"] == "heading"] == [(1, "One [[a]]"), (2, "Two")]
    assert [(s["target"], s["sub"], s["shown"]) for s in found if s["kind"] == "embed"] == [("c", "#part", None)]


@pytest.mark.parametrize("text", ["", "\n", "---", "---\n", "[[", "[[a", "]]", "`", "$", "#", "# ", "[[[[a]]]]", "![[]]", "\r\n# x\r\n"])
def test_odd_bodies(text):
    for s in markdown.spans_of(text):
        assert 0 <= s["lo"] < s["hi"] <= len(text)


def test_long_bodies_are_scanned_in_linear_time():
    import time

    for unit in ("[", "[[a|", "`", "$", "![", "[a](", "<"):
        began = time.time()
        markdown.spans_of(unit * 100_000)
        assert time.time() - began < 5, unit


FRONT = '---\ntitle: A "b"\nn: 3\nf: 1.50\nzip: 007\nyes: true\nnone: ~\nempty:\nquoted: \'it\'\'s\'\nflow: [1, two, "3"]\njson: {"a": [1]}\n# note\nlist:\n  - x\n  - 2\nmap:\n  k: v\n  m:\n    - 1\nurl: http://x.y\n---\nbody'


def test_front_matter_has_types():
    got = json.loads(markdown.front_matter(FRONT))
    want = {"title": 'A "b"', "n": 3, "f": 1.5, "zip": "007", "yes": True, "none": None, "empty": None, "quoted": "it's", "flow": [1, "two", "3"], "json": {"a": [1]}, "list": ["x", 2], "map": {"k": "v", "m": [1]}, "url": "http://x.y"}
    assert got == want
    assert markdown.front_matter("no front\n---\n") == "{}" and markdown.front_matter(None) == "{}"


@pytest.mark.parametrize("value", ["plain", "true", "12", "", " lead", "a: b", "- x", "#", None, True, 3, -1.5, [], ["a", "2", 2], [["n"]], {"a": None}, "é \"q\"", "x\ny"])
@pytest.mark.parametrize("name", ["new", "n", "list", "map"])
def test_a_value_reads_back_with_its_type(name, value):
    out = markdown.with_property(FRONT, name, json.dumps(value))
    before, after = json.loads(markdown.front_matter(FRONT)), json.loads(markdown.front_matter(out))
    assert after == before | {name: value} and out.endswith("\n---\nbody")
    assert json.loads(markdown.front_matter(markdown.with_property("text", name, json.dumps(value)))) == {name: value}


def vault_of(spark, bodies):
    return spark.createDataFrame([(p, p.split("/")[-1].removesuffix(".md"), 0, c) for p, c in bodies.items()], "path string, basename string, mtime long, content string")


def test_properties_and_outline_columns(spark):
    notes = vault_of(spark, {"a.md": FRONT, "b.md": "x\n```\n# no\n```\n# T #\n", "c.md": None})
    got = {r["path"]: json.loads(r["j"]) for r in vault.properties(notes).select("path", F.to_json("frontmatter").alias("j")).collect()}
    assert got["a.md"]["n"] == 3 and got["b.md"] == got["c.md"] == {}
    assert [tuple(r) for r in vault.outline(notes).collect()] == [("b.md", 5, 15, 1, "T")]
    edits = spark.createDataFrame([("/a.md", "n", '"3"'), ("a.md", "tags", '["x"]'), ("c.md", "k", "true")], "path string, name string, value string")
    after = vault.set_property(notes, edits.withColumn("value", F.parse_json("value")))
    assert after.columns == notes.columns
    again = {r["path"]: json.loads(r["j"]) for r in vault.properties(after).select("path", F.to_json("frontmatter").alias("j")).collect()}
    assert again["a.md"]["n"] == "3" and again["a.md"]["tags"] == ["x"] and again["c.md"] == {"k": True} and again["b.md"] == {}


VAULT = {
    "top.md": "[[deep]] [[x/deep|D]] ![[deep#h]] [a](x/deep.md) [b](<x/deep.md>) [c](./x/deep.md#p) [[/x/deep]] `[[deep]]`\n```\n[[deep]]\n```\n[[other]] [[gone]] [w](https://deep) [[DEEP.md]]",
    "x/deep.md": "[up](../top.md) [me](deep.md) [[near]]",
    "x/near.md": "[[deep]]",
    "y/near.md": "[[near]]",
    "y/other.md": "nothing",
    "none.md": None,
}


def moved(spark, bodies, to):
    notes = vault_of(spark, bodies)
    links = spark.createDataFrame([("top.md", "x/deep.md", 1)], "src string, dst string, n long")
    rows, table = vault.move(notes, links, spark.createDataFrame(list(to.items()), "path string, to string"))
    return {r["path"]: r["content"] for r in rows.collect()}, [tuple(r) for r in table.collect()], {r["path"]: r["basename"] for r in rows.collect()}


def test_links_follow_a_move_in_every_form(spark):
    got, table, names = moved(spark, VAULT, {"x/deep.md": "z/new name.md"})
    assert got["top.md"] == "[[new name]] [[z/new name|D]] ![[new name#h]] [a](z/new%20name.md) [b](<z/new%20name.md>) [c](z/new%20name.md#p) [[/z/new name]] `[[deep]]`\n```\n[[deep]]\n```\n[[other]] [[gone]] [w](https://deep) [[new name.md]]"
    assert got["z/new name.md"] == "[up](top.md) [me](new%20name.md) [[near]]"  # its own relative link is written from the top
    assert got["x/near.md"] == "[[new name]]" and got["y/near.md"] == "[[near]]" and got["none.md"] is None
    assert table == [("top.md", "z/new name.md", 1)] and names["z/new name.md"] == "new name"


def test_a_name_that_becomes_ambiguous_is_written_as_a_path(spark):
    got, _, _ = moved(spark, VAULT, {"x/deep.md": "z/other.md"})
    assert got["x/near.md"] == "[[z/other]]"
    got, _, _ = moved(spark, VAULT, {"x/deep.md": "z/deep.md"})
    assert got["x/near.md"] == "[[deep]]" and "[[z/deep|D]]" in got["top.md"]  # a bare name that still holds stays


def test_bare_names_mean_the_near_note_first(spark):
    found, lost = vault.link_tables(vault_of(spark, VAULT))
    got = {(r["src"], r["dst"]): r["n"] for r in found.collect()}
    assert got["y/near.md", "y/near.md"] == 1 and got["x/deep.md", "x/near.md"] == 1 and got["top.md", "x/deep.md"] == 8 and got["x/deep.md", "top.md"] == 1
    assert {(r["src"], r["target"]) for r in lost.collect()} == {("top.md", "gone")}


def test_requests_by_name(spark):
    notes = vault_of(spark, VAULT)
    assert vault.request(notes, "move", moves=spark.createDataFrame([("y/other.md", "y/b.md")], "path string, to string")).filter("path = 'top.md'").first()["content"].count("[[b]]") == 1
    assert vault.request(notes, "resolved_links").filter("not found").count() == 1
    files = spark.createDataFrame([("y/other.md", 1), ("y/scan.pdf", 2)], "path string, size long")
    assert {tuple(r) for r in vault.request(notes, "list_files", folder="y", files=files).collect()} == {("other", "y/other.md"), ("scan.pdf", "y/scan.pdf")}
    assert vault.request(notes, "search_context", query="NOTHING").count() == 1
    assert vault.request(notes, "delete", gone=notes.filter("path = 'top.md'").select("path")).count() == 5
    with pytest.raises(ValueError):
        vault.request(notes, "drop_all")
