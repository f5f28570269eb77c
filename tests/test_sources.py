import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import bm25
from cairn.operators.extract import extract, extract_all
from cairn.sources import files as S
from cairn.sources import sinks
from cairn.streaming import live


def test_scans(spark, tmp_path):
    for p, t in {"a/x.go": "package a\n\nfunc F() {\n\tG()\n}\n", "vendor/y.go": "package y\n", "b/.hid/z.py": "x", "big.py": "#" * (S.MAX_BYTES + 1), "n.txt": "note", "README.md": "# R\n", "docs/guide/in.md": "# G\n", "sub/README.md": "# S\n"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    root = str(tmp_path)
    repo = S.scan_repo(spark, root)
    assert [(r.path, r.language) for r in repo.collect()] == [("a/x.go", "go")]
    assert extract(repo, "symbols").first().name == "F" and extract(repo, "call_edges").first().callee == "G"
    assert {r.path for r in S.scan_text(spark, root).collect()} == {"a/x.go", "n.txt", "README.md", "docs/guide/in.md", "sub/README.md", "big.py"}
    assert {(r.origin, r.slug) for r in S.scan_docs(spark, root).collect()} == {("README.md", "readme"), ("docs/guide/in.md", "docs-guide-in"), ("sub/README.md", "sub-readme")}
    assert {r.slug for r in S.scan_pages(spark, root).collect()} == {"in"}
    out = str(tmp_path / "graph")
    sinks.write_graph({"symbols": extract(repo, "symbols"), "call_edges": extract(repo, "call_edges")}, out)
    assert spark.read.parquet(out + "/symbols").first().language == "go"
    blob = S.text_blob(repo, 20).first().blob
    assert blob == "=== a/x.go ===\npacka"


def test_scan_in_even_tasks(spark, tmp_path, monkeypatch):
    """F1: a tree of many small files is listed by the executors, hidden and underscored folders too, and read in few tasks."""
    want = {}
    for k in range(1000):
        path = f"r{k % 3}/{'_' * (k % 2)}d{k}/f{k}.py" if k % 10 else f"r{k % 3}/{('.hid', 'vendor', 'x')[k % 3]}/{'_' * (k % 20 == 0)}f{k}.py"
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(f"# {k}\n")
        if not any(x in path for x in ("/.hid/", "/vendor/", "/_f")):
            want[path] = f"# {k}\n"
    monkeypatch.setattr(S, "underscored", lambda *a: pytest.fail("names were listed one by one by the driver"))
    spark.conf.set("spark.sql.files.openCostInBytes", "4194304")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        repo = S.scan_repo(spark, str(tmp_path))
        assert repo.rdd.getNumPartitions() == 2
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", "65536")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = [(r.path, r.content) for r in repo.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_records(spark, tmp_path):
    (tmp_path / "log").write_text("a1|2024-01-02T03:04:05+00:00|feat: x | y\nbody\nmore\n<<<END>>>\nbad line<<<END>>>\nb2|2024-01-03T00:00:00Z|fix<<<END>>>")
    got = [(r.sha, r.subject, r.body) for r in S.read_commits(spark, str(tmp_path / "log")).orderBy("sha").collect()]
    assert got == [("a1", "feat: x | y", "body\nmore"), ("b2", "fix", "")]
    (tmp_path / "pr.json").write_text(json.dumps([{"number": 1, "title": "t", "body": "b", "mergedAt": "2024-01-02T00:00:00Z", "labels": [{"name": "bug"}], "url": "u", "author": {"login": "x"}}]))
    assert S.read_prs(spark, str(tmp_path / "pr.json")).first().labels[0].name == "bug"
    (tmp_path / "q").write_text("# c\n\nWhat is it?\n  How?\n")
    assert [(r.id, r.text) for r in S.read_questions(spark, str(tmp_path / "q")).collect()] == [("q3", "What is it?"), ("q4", "How?")]
    (tmp_path / "i.json").write_text(json.dumps({"schema_version": 3, "symbols": [{"name": "F", "kind": "function", "file": "a.go", "start_line": 1, "end_line": 2}], "edges": [], "refs": []}, indent=1))
    t = S.read_index(spark, str(tmp_path / "i.json"))
    assert t["symbols"].first().name == "F" and t["call_edges"].count() == 0
    log = str(tmp_path / "out")
    b = spark.createDataFrame([("a", "x"), ("b", "y")], "sha string, block string")
    sinks.append_log(b, log, "sha")
    sinks.append_log(b, log, "sha")
    assert spark.read.parquet(log).count() == 2 and sinks.same_rows(spark.read.parquet(log), b)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(0, "a", "put", 1), (1, "b", "put", 2), (2, "a", "put", 3), (3, "b", "remove", 4), (4, "c", "put", 5), (5, "a", "put", 6), (6, "c", "put", 7)]
    for i in range(0, len(rows), 2):
        spark.createDataFrame(rows[i : i + 2], "version bigint, file string, op string, value bigint").coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema("version bigint, file string, op string, value bigint").option("maxFilesPerTrigger", 1).parquet(src)
    out = live.replace_by_key(stream(), "file", "version", "op = 'remove'", lambda last: last.select("file", "value"), live.shared_folder(spark, "t"))
    assert {(r.file, r.value) for r in out.collect()} == {("a", 6), ("c", 7)}
    calls = stream().select(F.col("op").alias("tool"), F.col("value").alias("returned"), (F.col("value") * 2).alias("alternative"))
    got = spark.read.parquet(live.counters(calls, "tool", live.shared_folder(spark, "t"))).collect()
    assert {(r.tool, r.calls, r.returned, r.alternative) for r in got} == {("put", 6, 24, 48), ("remove", 1, 4, 8)}


def test_live_graph(spark, tmp_path):
    """A symbol is added, one removed, a file deleted; an old event that comes late and one that can't be read change nothing."""
    src, go = str(tmp_path / "in"), "package a\n\nfunc {}() {{\n\tG()\n}}\n"
    schema = "version bigint, path string, op string, content string"
    parts = [[(5, "a.go", "write", go.format("F")), (1, "b.go", "write", go.format("B"))], [(6, "a.go", "write", go.format("F") + go.format("H")[11:]), (7, "b.go", "write", None)], [(3, "a.go", "write", go.format("Old")), (2, "c.go", "write", go.format("C")), (8, "c.go", "remove", None)], [(7, "c.go", "write", go.format("Late"))], [(9, "a.go", "write", go.format("H"))]]
    folder = live.shared_folder(spark, "t")
    seen = []

    def symbols(last):
        return extract(last, "symbols").select(F.col("file").alias("path"), "name")

    for part in parts:  # each run goes on from the state of the one before
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        out = live.replace_by_key(spark.readStream.schema(schema).parquet(src), "path", "version", "op = 'remove'", symbols, folder, unreadable="op <> 'remove' and content is null", buckets=4)
        seen.append({(r.path, r.name) for r in out.collect()})
    assert seen == [{("a.go", "F"), ("b.go", "B")}, {("a.go", "F"), ("a.go", "H"), ("b.go", "B")}, {("a.go", "F"), ("a.go", "H"), ("b.go", "B")}, {("a.go", "F"), ("a.go", "H"), ("b.go", "B")}, {("a.go", "H"), ("b.go", "B")}]


def test_stores(spark, tmp_path):
    for p in ("_notes/a.md", "sub/_b.md", ".hid/_c.md", "d.md"):
        (tmp_path / "wiki" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "wiki" / p).write_text("# x\n")
    assert {r.path for r in S.scan_pages(spark, str(tmp_path / "wiki")).collect()} == {"_notes/a.md", "d.md"}
    v = spark.createDataFrame([("a", [1.0, 0.0], "p", "m")], "key string, vector array<float>, provider string, model string")
    sinks.write_vectors(v, str(tmp_path / "v"))
    assert S.read_vectors(spark, str(tmp_path / "v"), "p", "m").count() == 1
    with pytest.raises(ValueError):
        S.read_vectors(spark, str(tmp_path / "v"), "p", "other")
    pages = spark.createDataFrame([("a.md", "b1"), ("a.md", "b2"), ("c.md", None)], "path string, body string")
    for _ in range(2):
        sinks.create_pages(pages, str(tmp_path / "pages"))
    assert {(r.path, r.body) for r in spark.read.parquet(str(tmp_path / "pages")).collect()} == {("a.md", "b1"), ("c.md", None)}
    files = spark.createDataFrame([("r/a.go", "package a\n\nfunc F(x T) {\n\tG()\n}\n"), ("r/b.py", "def f():\n    g()\n"), (None, "x"), ("r/c.go", None)], "path string, content string")
    g = extract_all(files)
    assert {k: t.count() for k, t in g.items()} == {"symbols": 2, "call_edges": 2, "ref_edges": 1}
    sinks.write_index(g, str(tmp_path / "index"), "r", "2024-01-01T00:00:00Z")
    back = S.read_index(spark, str(tmp_path / "index"), lines=True)
    assert all(sinks.same_rows(back[k], g[k]) for k in g)


def test_index_in_small_documents(spark, tmp_path, monkeypatch):
    """a large graph has more documents, not larger ones; nothing is lost, tables without rows included."""
    monkeypatch.setattr(sinks, "DOCUMENT_ROWS", 25, raising=False)
    files = spark.createDataFrame([(f"r/f{k}.py", f"def f{k}():\n    g()\n") for k in range(400)], "path string, content string")
    g = extract_all(files)
    sinks.write_index(g, str(tmp_path / "i"), "r", "2024-01-01T00:00:00Z")
    sizes = [len(json.loads(r.value)["symbols"]) for r in spark.read.text(str(tmp_path / "i")).collect()]
    assert sum(sizes) == 400 and len(sizes) > 20 and max(sizes) < 50
    back = S.read_index(spark, str(tmp_path / "i"), lines=True)
    assert all(sinks.same_rows(back[k], g[k]) for k in g) and back["ref_edges"].count() == 0


def test_bm25_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "auth token auth"), (2, "stripe billing"), (3, ""), (4, None), (5, "auth token auth billing")], "i int, t string")
    docs = bm25.tokenized(df, "i", T.prose_tokens("t"))
    bm25.write_index(docs, str(tmp_path / "i"), buckets=4)
    for terms in (["auth"], ["auth", "billing", "auth"], ["none"], []):
        rows = lambda x: {(r.id, r.score) for r in x.collect()}
        assert rows(bm25.search_index(spark, str(tmp_path / "i"), terms, buckets=4)) == rows(bm25.score(docs, terms))
    q = spark.createDataFrame([(7, ["auth", "billing"]), (8, ["none"])], "qid int, terms array<string>")
    best = {(r.qid, r.id): r.score for r in bm25.score_queries(docs, q, 2).collect()}
    assert set(best) == {(7, 1), (7, 5)} and {(7, i): s for i, s in ((r.id, r.score) for r in bm25.score(docs, ["auth", "billing"]).collect()) if i in (1, 5)} == best


def test_core_stands_alone():
    code = "import sys; sys.modules['cairn.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(n.startswith(('p1_', 'p8_')) for n in e.queries()) and 'p5_found' in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
