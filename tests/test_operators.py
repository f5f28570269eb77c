import datetime as dt

import pytest
from pyspark.sql import functions as F

from cairn.operators import bm25, context, extract, graph, ingest, vector, wiki
from cairn.operators.orphans import Reference, by_period, find_orphans, intervals, line_count
from cairn.operators.skew import salted_join
from cairn.functions import text as T


def test_salted_join_equals_plain_join(spark):
    a = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 5 == 0 else f"k{i}") for i in range(200)], "i int, k string")
    b = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3), (None, 4)], "k string, v int")
    for how in ("inner", "left_outer", "left_semi", "left_anti"):
        want = sorted(map(str, a.join(b, "k", how).collect()))
        for hot in (5, 1000):
            assert sorted(map(str, salted_join(a, b, ["k"], how, hot_rows=hot).collect())) == want, (how, hot)
    near = salted_join(a, b, ["k"], "left_semi", condition="v < i", hot_rows=5)
    assert {r.i for r in near.collect()} == {r.i for r in a.join(b, "k").where("v < i").collect()}
    with pytest.raises(ValueError):
        salted_join(a, b, ["k"], "full_outer")


def test_bm25(spark):
    df = spark.createDataFrame([(1, "auth token auth"), (2, "stripe billing"), (3, ""), (4, None), (5, "auth token auth")], "i int, t string")
    docs = bm25.tokenized(df, "i", T.prose_tokens("t"))
    got = {r.id: r.score for r in bm25.score(docs, ["auth"]).collect()}
    assert set(got) == {1, 5} and got[1] == got[5]
    assert {r.id: r.score for r in bm25.score(docs, ["auth", "auth"]).collect()}[1] == pytest.approx(2 * got[1], abs=2e-6)
    assert bm25.score(docs, []).count() == 0 and bm25.score(docs.limit(0), ["x"]).count() == 0


def test_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])], "i int, v array<float>")
    assert [(r.id, r.score) for r in vector.search(df, "i", "v", [1.0, 0.0], 5).collect()] == [(1, 1.0), (2, 1.0), (3, 0.0), (4, 0.0), (5, 0.0)]
    assert vector.search(df, "i", "v", [0.0, 0.0], 5).count() == 0


SYMS = [
    ("Greet", "function", "src/foo.go", 5, 7, "func Greet(name string) error", "Greet says hi.", "", "go"), ("Server", "type", "src/server.go", 10, 30, "type Server struct", "", "", "go"),
    ("Start", "method", "src/server.go", 14, 16, "func (*Server) Start() error", "", "Server", "go"), ("TestGreet", "function", "src/foo_test.go", 3, 9, "func TestGreet(t *testing.T)", "", "", "go"),
    ("test_it", "function", "a/test_x.py", 1, 4, "def test_it():", "", "", "py"),
]
SYM_SCHEMA = "name string, kind string, file string, start_line int, end_line int, signature string, doc string, receiver string, language string"


def test_graph(spark):
    s = spark.createDataFrame(SYMS, SYM_SCHEMA)
    e = spark.createDataFrame([(1, "TestGreet", "src/foo_test.go", 5, "Greet"), (2, "Start", "src/server.go", 15, "Greet"), (3, "gone", "src/gone_test.go", 1, "Greet")], "edge_id bigint, caller string, caller_file string, caller_line int, callee string")
    names = lambda df: [r.name for r in df.collect()]
    assert names(graph.find_def(s, "Greet")) == ["Greet"] and names(graph.find_def(s, "gree")) == ["Greet", "TestGreet"] and names(graph.find_def(s, "zzz")) == []
    assert names(graph.find_def(s, "Start", kind="function")) == []
    assert [r.caller for r in graph.find_callers(e, "Greet").collect()] == ["gone", "TestGreet", "Start"] or [r.caller_file for r in graph.find_callers(e, "Greet").collect()] == sorted(["src/foo_test.go", "src/server.go", "src/gone_test.go"])
    assert [(r.name, r.reasons) for r in graph.tests_for(s, e, "Greet").collect()] == [("TestGreet", "calls,name_match")]
    assert graph.search_symbols(s, "greet").first().name in ("Greet", "TestGreet")
    assert graph.clamp(0, 10, 50) == 10 and graph.clamp(99, 10, 50) == 50
    files = spark.createDataFrame([("src/server.go", "\n".join(f"line {i} os.Getenv(x)" if i in (15, 16, 28) else f"line {i}" for i in range(1, 41)), 100)], "path string, content string, length bigint")
    hits = [(r.name, r.line) for r in graph.grep_symbols(s, files, r"os\.Getenv\(", max_per_symbol=2).collect()]
    assert hits == [("Server", 15), ("Server", 16), ("Start", 15), ("Start", 16)]
    assert [r.text for r in graph.read_chunk(files, "src/server.go", 2, 3).collect()] == ["line 2", "line 3"]
    with pytest.raises(ValueError):
        graph.read_chunk(files, "../x")
    at = spark.createDataFrame([("src/server.go", 15), ("src/server.go", 20), ("src/server.go", 1)], "file string, line int")
    assert {r.line: r.caller for r in graph.enclosing(at, s).collect()} == {15: "Start", 20: "Server", 1: "<file>"}
    cases = {"a_test.go": 1, "test_a.py": 1, "a_test.py": 1, "a.test.tsx": 1, "x/__tests__/a.js": 1, "src/test/A.java": 1, "a.go": 0, "atest.py": 0, "test_a.rb": 0, "x/src/test/A.kt": 1, "a.spec.js": 1}
    got = spark.createDataFrame([(c,) for c in cases], "p string").select(graph.is_test_file(F.col("p"))).collect()
    assert [int(r[0]) for r in got] == list(cases.values())


def test_orphans(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    child_s, parent_s = "key string, ref string, at timestamp_ntz, need int", "key string, ref string, start timestamp_ntz, end timestamp_ntz, cap int"
    files = spark.createDataFrame([("f", "f", t(5), t(10), 3), ("f", "f", t(5), t(10), 3), ("g", "g", t(1), None, 9), (None, None, None, None, None)], parent_s)
    syms = spark.createDataFrame([("s1", "name", t(6), None, None), ("s2", "gone", t(6), t(8), None), ("s2b", "gone", t(8), t(9), None)], parent_s)
    in_file = spark.createDataFrame([("s1", "missing", t(6), None), ("s2", "f", t(6), None), ("s2b", "f", t(8), None)], child_s)
    edges = spark.createDataFrame([("1", "name", t(7), None), ("2", "gone", t(7), None), ("3", "gone", t(9), None), ("4", "nobody", t(7), None), ("5", "", t(7), None), ("6", None, t(7), None), (None, "x", t(7), None), ("4", "nobody", t(7), None), ("7", "name", t(5), None), ("8", "name", None, None)], child_s)
    cites = spark.createDataFrame([("c1", "f", t(5), 3), ("c2", "f", t(5), 4), ("c3", "f", t(4), 0), ("c4", "f", t(10), 0), ("c5", "g", t(20), None)], child_s)
    refs = [Reference("edges", edges, "syms", syms), Reference("cites", cites, "files", files), Reference("syms", in_file, "files", files.withColumn("cap", F.lit(None).cast("int")))]
    rows = find_orphans(refs).collect()
    assert {(r.ref_table, r.ref_key) for r in rows if not r.inherited} == {("edges", "3"), ("edges", "4"), ("edges", "7"), ("cites", "c2"), ("cites", "c3"), ("cites", "c4"), ("syms", "s1")}
    assert {(r.ref_table, r.ref_key) for r in rows if r.inherited} == {("edges", "1"), ("edges", "8")}
    assert sum(r.n_direct for r in by_period(find_orphans(refs)).collect()) == 7
    assert [(r["from"].day, r["to"].day) for r in intervals(syms.where("ref = 'gone'")).collect()] == [(6, 9)]
    empty = [Reference("edges", edges, "syms", syms.limit(0))]
    assert find_orphans(empty).count() == 6 and find_orphans([Reference("edges", edges.limit(0), "syms", syms)]).count() == 0
    n = spark.createDataFrame([("",), ("a",), ("a\n",), ("a\nb",), ("\n",), (None,)], "c string").select(line_count("c")).collect()
    assert [r[0] for r in n] == [0, 1, 1, 2, 1, 0]


def test_wiki(spark):
    good = "---\ntags: [a]\nlast_verified: 2024-01-01\nstatus: current\n---\n# T\n\n> s\n\ntext [[Other Page]] [[x/other-page|y]] `[[no]]`\n\n## Sources\n- `repo/a.go:3-5` `repo/b.go`\n\n## See Also\n"
    bad = "no title\n\n[[missing#part]]\n```\n`repo/c.go`\n[[fenced]]\n```\n"
    p = spark.createDataFrame([("wiki/c/good.md", "good", good), ("wiki/Other-Page.md", "o", bad), ("wiki/_lint/x.md", "x", ""), ("wiki/index.md", "i", "")], "path string, slug string, body string")
    p = wiki.listed(p)
    v = {(r.file, r.rule, r.line) for r in wiki.lint_all(p).collect()}
    assert {x for x in v if x[0] == "wiki/c/good.md"} == set()
    assert {x[1:] for x in v} == {("missing-title", 1), ("missing-summary", 0), ("missing-sources", 0), ("missing-see-also", 0), ("filename-casing", 0), ("missing-frontmatter", 1), ("broken-wikilink", 3)}
    c = wiki.extract_citations(p, ["repo/"])
    assert {(r.repo_path, r.line, r.line_end) for r in c.collect()} == {("repo/a.go", 3, 5), ("repo/b.go", 0, 0)}
    inv = spark.createDataFrame([("repo/a.go", 4)], "path string, n_lines int")
    assert {r.rule for r in wiki.drift(c, inv).collect()} == {"citation-line-out-of-bounds", "citation-file-missing"}
    rec = {r.slug: r for r in wiki.page_records(p, c).collect()}
    assert rec["good"].category == "c" and rec["good"].cited_files == ["repo/a.go", "repo/b.go"] and rec["Other-Page"].status == "unknown" and rec["Other-Page"].category == "_root"
    assert wiki.xref(wiki.page_records(p, c), ["repo/"]).count() == 2
    fm = spark.createDataFrame([("a.md", "a", "---\nx\n---\n"), ("b.md", "b", "---\nstatus: odd\n---\n"), ("c.md", "c", "---\nopen"), ("d.md", "d", None)], "path string, slug string, body string")
    assert {(r.file, r.rule) for r in wiki.lint_frontmatter(fm).collect()} >= {("a.md", "malformed-frontmatter"), ("b.md", "missing-frontmatter-field"), ("b.md", "invalid-frontmatter-value"), ("c.md", "malformed-frontmatter")}


def test_ingest(spark):
    day = dt.datetime(2024, 5, 1)
    cases = [("feat!: x", "", {"breaking"}), ("fix: y", "BREAKING CHANGE: z", {"breaking"}), ("fix outage", "", {"incident"}), ("notes", "an outage in prose", set()), ("bump a from 1.2 to v2.0", "", {"dependency"}), ("bump a from 1.2 to 1.3", "", set()), ("feat(x)!: architecture of hotfix", "", {"breaking", "incident", "decision"}), (None, None, set())]
    c = spark.createDataFrame([(str(i), day, s, b) for i, (s, b, _) in enumerate(cases)], "sha string, date timestamp_ntz, subject string, body string")
    got: dict = {}
    for r in ingest.classify_commits(c).collect():
        got.setdefault(int(r.sha), set()).add(r["class"])
    assert [got.get(i, set()) for i in range(len(cases))] == [x[2] for x in cases]
    prs = [(1, "x", "", ["Incident"], "incident"), (2, "feat!: x", "## Decision\n", [], "breaking"), (3, "feat: x", "## Trade-offs\n", [], "decision"), (4, "x", "#### What happened", None, "incident"), (5, "x", "### Migration", [], "breaking"), (6, "bump a from 1 to 2", "", [], "dependency"), (7, "plain", None, [], "none")]
    p = spark.createDataFrame([(n, t, b, day, None if ls is None else [(x,) for x in ls]) for n, t, b, ls, _ in prs], "number bigint, title string, body string, merged_at timestamp_ntz, labels array<struct<name:string>>")
    k = ingest.classify_prs(p)
    assert {r.number: r["class"] for r in k.collect()} == {n: w for n, *_x, w in prs}
    out = {r.number: (r.outcome, r.target) for r in ingest.route_prs(k, spark.createDataFrame([(2,)], "number bigint")).collect()}
    assert out[2][0] == "skipped" and out[1] == ("page", "investigations/2024-05-01-pr-1-x.md") and out[5] == ("log", "log.md") and out[7] == ("noise", None)
    now = dt.datetime(2024, 5, 10)
    assert ingest.parse_since("3d", now) == dt.datetime(2024, 5, 7) and ingest.parse_since("", now).day == 3 and ingest.parse_since("36h", now) == dt.datetime(2024, 5, 8, 12) and ingest.parse_since("2024-01-02T00:00:00Z", now) == dt.datetime(2024, 1, 2)
    src = spark.createDataFrame([("n", "new"), ("p", "v2"), ("e", "v2"), ("s", "same")], "slug string, body string")
    old = spark.createDataFrame([("p", "v1", "h"), ("e", "edited", "x"), ("s", "same", "h"), ("m", "mine", None)], "slug string, body string, h string").select("slug", "body", F.when(F.col("h") == "h", F.sha2("body", 256)).otherwise(F.col("h")).alias("stored_hash"))
    assert {r.slug: (r.action, r.body) for r in ingest.upsert(src, old).collect()} == {"n": ("insert", "new"), "p": ("overwrite", "v2"), "e": ("edited", "edited"), "s": ("unchanged", "same"), "m": ("keep", "mine")}
    calls = spark.createDataFrame([("a", 10, 100), ("a", 0, 0), ("b", 0, 5)], "tool string, returned bigint, alternative bigint")
    assert {r.tool: (r.calls, r.saved, r.ratio) for r in ingest.receipts(calls, ["tool"]).collect()} == {"a": (2, 90, 10.0), "b": (1, 5, 0.0)}


def test_context(spark):
    df = spark.createDataFrame([("1", "Why does AuthMiddleware call validate_token and The End? see Greet( and \"quoted text\" 'ab' AuthMiddleware"), ("2", "")], "prompt_id string, text string")
    r = {x.prompt_id: x for x in df.select("prompt_id", context.prompt_identifiers(F.col("text")).alias("i"), context.prompt_quoted(F.col("text")).alias("q")).collect()}
    assert r["1"].i == ["AuthMiddleware", "validate_token", "Greet"] and r["1"].q == ["quoted text"] and r["2"].i == []
    hits = context.name_hits(df, spark.createDataFrame(SYMS, SYM_SCHEMA)).withColumn("section", F.lit(0))
    assert [x.code for x in context.symbol_codes(hits).collect()] == ["s1"]


def test_evidence(spark):
    """Three sections with one table of symbols; a prompt without evidence has no report."""
    symbols = spark.createDataFrame(SYMS, SYM_SCHEMA)
    files = spark.createDataFrame([("src/server.go", "\n".join(f"line {i} os.Getenv" if i in (15, 16, 28) else f"line {i}" for i in range(1, 41)), 100), ("src/null.go", None, 0)], "path string, content string, length bigint")
    prompts = spark.createDataFrame([("p", "Where does Greet( call \"os.Getenv\"?"), ("none", "zzz"), ("empty", "")], "prompt_id string, text string")
    hits = context.evidence(prompts, symbols, files).cache()
    got = {(h.prompt_id, h.section, h.name) for h in hits.collect()}
    assert {x[1:] for x in got if x[1] > 0} == {(1, "Greet"), (2, "Server"), (2, "Start")} and ("p", 0, "Greet") in got and {x[0] for x in got} == {"p"}
    assert {h.name: h.line for h in hits.where("section = 2").collect()} == {"Server": 15, "Start": 15}
    for compact in (True, False):
        r = {x.prompt_id: x.report for x in context.report(prompts, hits, compact=compact).collect()}
        assert r["none"] == r["empty"] == "" and "## By name" in r["p"] and "## Literal hits" in r["p"] and ("## Symbols" in r["p"]) == compact
    cut = {x.prompt_id: x.report for x in context.report(prompts, hits, max_bytes=90).collect()}["p"]
    assert cut.endswith("\n\n_…truncated_\n") and len(cut.encode()) <= 90 + 22


def test_go_reader():
    from cairn.functions.golang import Source
    from cairn.plans.extracted import GO_FIXTURE

    s = Source(GO_FIXTURE)
    assert [x.name for x in s.symbols] == ["Low", "High", "Table", "Node", "Reader", "Walk"]
    assert s.symbols[-1].signature == "func (*Node[P]) Walk(a, b Step, rest ...int) (Out, error)" and (s.symbols[-1].start, s.symbols[-1].end) == (24, 39)
    assert {c[2] for c in s.calls} == {"first", "Next", "helper", "use", "copy"}
    sig = lambda head: Source("package a\n" + head + " {\n}\n").symbols[0].signature
    assert sig("func F(int, string) int") == "func F(int, string) int" and sig("func F(a [4]int, m map[string][]*x.T) (n int)") == "func F(a []int, m map[string][]*x.T) (n int)"
    assert sig("func F(f func(a int) error, c <-chan T, e interface{ M() })") == "func F(f func(...), c chan T, e interface{...})"
    for broken in ("", "func", "func (", "type T struct {", "package a\nfunc f( {\n", "}}}", "var x = `open", "const (\nA = 1\n", "func f() { g(", "type [", "import (\n", "((((", "func f(a b c d) {}"):
        Source(broken)


def test_layout():
    lines = "def a:\n  x\n\n  y\nz\n\n\n  w\n}".split("\n")
    assert [extract.Layout(lines).body_end(n) for n in (1, 2, 5, 0, 99)] == [4, 2, 5, 0, 99]
    assert extract.Layout(["a", "b", "c"]).body_end(1) == 2 and extract.Layout(["", "a"]).body_end(1) == 2


def test_extract():
    go = 'package a\n\nimport "x"\n\ntype T struct {\n\tBase\n\tf Foo\n\tn int\n}\n\nconst Max = 3\n\n// Do does.\nfunc (t *T) Do(a Bar, n int) (Baz, error) {\n\ts := "fake(call"\n\treturn load(a, len(s), Qux{1}), t.Do(n)\n}\n'
    assert {(s[0], s[1]) for s in extract.file_symbols("a.go", go)} == {("T", "type"), ("Max", "const"), ("Do", "method")}
    assert {c[3] for c in extract.file_calls("a.go", go)} == {"load"}
    assert {(r[3], r[4]) for r in extract.file_refs("a.go", go)} == {("Base", "embed"), ("Foo", "type"), ("T", "type"), ("Bar", "type"), ("Baz", "type"), ("Qux", "type")}
    py = "class A:\n    def f(self):\n        return g(1) + f(2) + print(3)\n\n\ndef g(x):\n    return h(x)\n\nz(1)\n"
    assert [(s[0], s[1], s[3], s[4]) for s in extract.file_symbols("a.py", py)] == [("f", "function", 2, 3), ("g", "function", 6, 7), ("A", "class", 1, 3)]
    assert {(c[0], c[3]) for c in extract.file_calls("a.py", py)} == {("f", "g"), ("g", "h"), ("<file>", "z")}
    assert extract.file_symbols("a.zz", "x") == [] and extract.file_refs("a.py", py) == []


def test_staged_tables(spark):
    from cairn.operators import lineage

    df = lineage.stage(spark.range(5).withColumn("t", F.lit("x")), "t")
    none = lineage.stage(spark.createDataFrame([], "a int, b string"), "t")
    assert df.count() == 5 and none.count() == 0 and none.columns == ["a", "b"]
    small, large = lineage.bounded(spark.range(3)), lineage.bounded(spark.range(3), max_bytes=1)
    assert "broadcast" in small._jdf.queryExecution().logical().toString().lower() and "broadcast" not in large._jdf.queryExecution().logical().toString().lower()
    assert lineage.clear(spark) >= 2 and lineage.clear(spark) == 0
