import os

import pytest
from pyspark.sql import functions as F

from cairn import config
from cairn.operators import ingest, wiki
from cairn.operators.embed import HashEmbedder, embed
from cairn.plans.tools import TOOLS, Session

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_session(spark):
    s = Session(spark, SF)
    names = [r["name"] for r in s.call("find_def", name="e", limit=5)]
    assert 0 < len(names) <= 5
    assert len(s.call("find_callers", name="wrapErr", limit=3)) == 3 and s.call("find_refs", name="no such type") == []
    page = s.call("query_documentation", query="the cache and the checkpoint", top_k=3)
    assert 0 < len(page) <= 3
    file = s.call("summary", file="", limit=1)[0]["file"]
    assert len(s.call("read_chunk", file=file, start_line=1, end_line=2)) == 2
    assert len(s.call("search_symbols", query=names[0])) > 0 and len(s.call("grep_symbols", pattern="n += ", literal=True, limit=2)) == 2
    assert s.call("tests_for", name="x" * 30) == []
    with pytest.raises(KeyError):
        s.call("no_such_tool")
    st = s.stats()
    assert sum(st["calls_by_tool"].values()) == 8 or set(st["calls_by_tool"]) == set(TOOLS)
    assert st["bytes_alternative"] > 0 and st["tokens_saved"] == st["bytes_saved"] // 4


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"name": "", "skip_names": [], "repo_prefixes": ["a/"], "status_values": null, "other": 1}')
    c = config.load(tmp_path / "c.json")
    assert c.name == "wiki" and c.skip_names == [] and c.repo_prefixes == ["a/"] and c.status_values == wiki.STATUS_VALUES
    (tmp_path / "x" / "y").mkdir(parents=True)
    assert config.find_root(tmp_path / "x" / "y", ("none", "c.json")) == tmp_path.resolve() and config.load(tmp_path / "no") == config.Config()


def test_config_write_back(tmp_path):
    at = tmp_path / "c.json"
    at.write_text('{"other": {"x": 1}, "repo_prefixes": ["a/"]}')
    config.save(at, {"repo_prefixes": [], "pipelines": {"entity": "caveman"}})
    assert config.load(at).pipelines == {"entity": "caveman"} and config.load(at).repo_prefixes == [] and '"other"' in at.read_text()
    at.write_text("[1]")
    with pytest.raises(ValueError):
        config.save(at, {})


def test_paths_and_names(spark):
    from cairn.operators import encode, graph

    cases = {"a/b": True, "/a": False, "../a": False, "a/../b": True, "a/../../b": False, "./a": True, "a/..": True}
    got = spark.createDataFrame([(c,) for c in cases], "p string").select("p", graph.within_root(F.col("p")).alias("ok")).collect()
    assert {r.p: r.ok for r in got} == cases
    assert encode.by_name("caveman+nothing") == [] and encode.by_name("card") == ["structural-card"]
    text = "x" + "é" * 150
    cut = spark.range(1).select(graph.snippet_trim(F.lit("  " + text)).alias("c")).first().c
    assert cut.endswith("…") and len(cut.encode()) <= 199 + 3 and "\ufffd" not in cut


def test_embed(spark):
    df = spark.createDataFrame([(1, "same words"), (2, "same words"), (3, None), (4, "")], "k bigint, t string")
    got = {r.k: r.vector for r in embed(df, "k", "t", HashEmbedder(16), batch=1).collect()}
    assert got[1] == got[2] and got[3] is None and len(got[4]) == 16


def test_imported_page(spark):
    df = spark.createDataFrame([("docs/a.md", "---\nx: 1\n---\n# Real Title\n\nFirst line.\n\n- item"), ("docs/b.md", "")], "o string, t string")
    a, b = (r[0] for r in df.orderBy("o").select(ingest.imported_page(F.col("o"), F.col("t"), "repo")).collect())
    assert "\n# Real Title\n\n> First line.\n\nFirst line.\n\n- item\n\n## Sources\n\n- `repo/docs/a.md`" in a and "\n# B\n\n> Imported from repo/docs/b.md — review and edit\n" in b
    c = ingest.page_around("x/my-doc_one.md", "intro\n# T\n\n\n> Said so.\n\n" + "word " * 60 + "\n\n## Sources\n- a\n", "r", "2024-01-01", "entity")
    assert "\n# T\n\n> Said so.\n\nintro\n" in c and c.count("## Sources") == 1 and "page_type: entity" in c
    pages = spark.createDataFrame([("wiki/a.md", "a", a), ("wiki/b.md", "b", b)], "path string, slug string, body string")
    assert {r.rule for r in wiki.lint_all(pages).collect()} == {"broken-wikilink"}  # there is no index here
