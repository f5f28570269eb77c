"""The query tools by name: arguments in, DataFrame out, and a session that keeps receipts of what answers cost."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import bm25, graph
from cairn.operators import context as C
from cairn.plans import search as S
from cairn.plans import views as V


def query_documentation(spark, d, query: str, top_k: int = 0) -> DataFrame:
    terms = spark.range(1).select(T.prose_tokens(F.lit(query)).alias("t")).first()[0]
    p = V.pages(spark, d).withColumn("plain", T.strip_front_matter("body"))
    kept = ("slug", "plain")
    top = bm25.score(bm25.tokenized(p, "path", T.prose_tokens("plain"), kept), terms, kept).orderBy(F.desc("score"), "id").limit(graph.clamp(top_k, 5, 10))
    shown = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    return top.select(F.col("id").alias("file"), "slug", T.first_heading("plain").alias("title"), T.snippet("plain", shown).alias("snippet"), "score").orderBy(F.desc("score"), "file")


def find_def(spark, d, name: str, language: str = "", kind: str = "", limit: int = 0) -> DataFrame:
    return graph.find_def(V.symbols(spark, d), name, language, kind, limit)


def search_symbols(spark, d, query: str, limit: int = 0, language: str = "", kind: str = "") -> DataFrame:
    return graph.search_symbols(V.symbols(spark, d), query, language, kind, limit)


def grep_symbols(spark, d, pattern: str, literal: bool = False, file: str = "", language: str = "", kind: str = "", limit: int = 0, max_per_symbol: int = 0) -> DataFrame:
    return graph.grep_symbols(V.symbols(spark, d), V.files(spark, d), pattern, literal, file, language, kind, limit, max_per_symbol)


def find_callers(spark, d, name: str, file: str = "", limit: int = 0) -> DataFrame:
    return graph.find_callers(V.call_edges(spark, d, name), name, file, limit).withColumn("file", F.col("caller_file"))


def find_refs(spark, d, name: str, kinds: list[str] | None = None, file: str = "", limit: int = 0) -> DataFrame:
    return graph.find_refs(V.ref_edges(spark, d, name), name, kinds, file, limit).withColumn("file", F.col("caller_file"))


def tests_for(spark, d, name: str, limit: int = 0) -> DataFrame:
    return graph.tests_for(V.symbols(spark, d), V.call_edges(spark, d, name), name, limit)


def summary(spark, d, file: str, limit: int = 0) -> DataFrame:
    s = V.symbols(spark, d).withColumn("idx_pos", F.concat("file", F.lpad(F.col("start_line").cast("string"), 8, "0"), "name"))
    return graph.summary(s, file, limit).drop("idx_pos")


def read_chunk(spark, d, file: str, start_line: int = 1, end_line: int = 0, max_lines: int = 0) -> DataFrame:
    return graph.read_chunk(V.files(spark, d, file), file, start_line, end_line, max_lines)


TOOLS = {f.__name__: f for f in (query_documentation, find_def, search_symbols, grep_symbols, find_callers, find_refs, tests_for, summary, read_chunk)}


def _files_of(rows: DataFrame, column: str = "file") -> DataFrame:
    return rows.select(F.col(column).alias("file"))


#: For each tool that has a measurable alternative, the files that one would have read instead; each replays its tool's own filter.
ALTERNATIVES = {
    "find_def": lambda s, d, **a: _files_of(find_def(s, d, **a)),
    "search_symbols": lambda s, d, **a: _files_of(search_symbols(s, d, **a)),
    "find_callers": lambda s, d, **a: _files_of(find_callers(s, d, **a), "caller_file"),
    "find_refs": lambda s, d, **a: _files_of(find_refs(s, d, **a), "caller_file"),
    "tests_for": lambda s, d, **a: _files_of(tests_for(s, d, **a)),
    "summary": lambda s, d, **a: _files_of(summary(s, d, **a)),
    "read_chunk": lambda s, d, **a: s.createDataFrame([(a["file"],)], "file string"),
    # All files that pass the filters, whatever the limit.
    "grep_symbols": lambda s, d, **a: _files_of(graph.filtered(V.symbols(s, d), a.get("file", ""), a.get("language", ""), a.get("kind", ""))),
}


def alternative(spark: SparkSession, d: str, tool: str, **args) -> int:
    """Bytes of the files that an answer stands for; 0 for tools without an alternative."""
    if tool not in ALTERNATIVES:
        return 0
    return int(graph.alternative_bytes(ALTERNATIVES[tool](spark, d, **args), V.file_sizes(spark, d)).first()["bytes"])


class Session:
    """Answers tool calls and counts bytes returned against the bytes of the files that the answer stands for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.log = spark, sf_dir, []

    def call(self, tool: str, **args) -> list[dict]:
        """The rows of the answer (tools have limits, so there are few); raises ``KeyError`` on an unknown tool."""
        return self.answer(tool, **args).get("rows")

    def answer(self, tool: str, **args) -> dict:
        """``count`` and ``rows``; of a search in bodies also ``pattern`` and ``truncated``."""
        rows = [r.asDict(recursive=True) for r in TOOLS[tool](self.spark, self.dir, **args).collect()]
        out: dict = {"count": len(rows), "rows": rows}
        if tool == "grep_symbols":
            symbols = V.symbols(self.spark, self.dir)
            hits = self.spark.createDataFrame([(r["file"], r["start_line"], r["name"]) for r in rows], "file string, start_line int, name string")
            where = (args.get("limit", 0), args.get("file", ""), args.get("language", ""), args.get("kind", ""))
            out = {"pattern": args["pattern"], "truncated": graph.grep_truncated(symbols, hits, *where).first()["truncated"]} | out
        self.log.append((tool, len(json.dumps(out, ensure_ascii=False, default=str).encode()), alternative(self.spark, self.dir, tool, **args)))
        return out

    def stats(self) -> dict:
        """Calls by tool, and totals: returned, alternative, saved, tokens saved (bytes / 4)."""
        by: dict[str, int] = {}
        for t, *_ in self.log:
            by[t] = by.get(t, 0) + 1
        returned, alternative = sum(r for _, r, _ in self.log), sum(a for *_, a in self.log)
        saved = max(0, alternative - returned)
        return {"calls_by_tool": by, "bytes_returned": returned, "bytes_alternative": alternative, "bytes_saved": saved, "tokens_saved": saved // 4, "ratio": alternative / returned if returned else 0.0}

    def respond(self, line: str) -> str | None:
        """The response to one line of JSON-RPC, None to a notification.  Fixed values: the error codes of the protocol."""
        fail = lambda code, message, rid=None: json.dumps({"jsonrpc": "2.0", "id": rid, "error": {"code": code, "message": message}})
        try:
            request = json.loads(line)
        except ValueError as e:
            return fail(-32700, f"parse error: {e}")
        rid = request.get("id") if isinstance(request, dict) else None
        if rid is None:
            return None
        method, params = request.get("method"), request.get("params") or {}
        if method == "initialize":
            result: dict = {"serverInfo": {"name": "cairn"}, "capabilities": {"tools": {}}}
        elif method == "tools/list":
            result = {"tools": [{"name": n} for n in (*TOOLS, "session_stats")]}
        elif method == "tools/call":
            name = params.get("name")
            if name != "session_stats" and name not in TOOLS:
                return fail(-32602, f"unknown tool: {name}", rid)
            try:
                answer = self.stats() if name == "session_stats" else self.answer(name, **(params.get("arguments") or {}))
            except (TypeError, ValueError) as e:
                return fail(-32602, f"bad arguments: {e}", rid)
            result = {"content": [{"type": "text", "text": json.dumps(answer, ensure_ascii=False, default=str)}]}
        else:
            return fail(-32601, f"method not found: {method}", rid)
        return json.dumps({"jsonrpc": "2.0", "id": rid, "result": result}, ensure_ascii=False)


#: What a bench of the tools asks.
BENCH = (
    ("find_def", {"name": "setup"}), ("search_symbols", {"query": "route harbor handler"}), ("grep_symbols", {"pattern": "wrapErr(", "literal": True}), ("find_callers", {"name": "wrapErr"}),
    ("find_refs", {"name": "no such type"}), ("tests_for", {"name": "setup"}), ("summary", {"file": "ledgerlake/"}),
)


def tool_bench(spark: SparkSession, d: str) -> DataFrame:
    """``(pos, tool, hits, returned, alternative)`` of each question of the bench, then the totals as tool ``""``."""
    s, rows = Session(spark, d), []
    for k, (tool, args) in enumerate(BENCH):
        hits = s.answer(tool, **args)["count"]
        rows.append((k, tool, hits, s.log[-1][1], s.log[-1][2]))
    rows.append((len(rows), "", sum(r[2] for r in rows), sum(r[3] for r in rows), sum(r[4] for r in rows)))
    return spark.createDataFrame(rows, "pos int, tool string, hits int, returned bigint, alternative bigint")


def bench_markdown(rows: list) -> str:
    """A bench as a Markdown table; ``rows`` are those of ``tool_bench``, of which there are few."""
    lines = ["| tool | hits | returned | alternative | ratio |", "| --- | ---: | ---: | ---: | ---: |"]
    for r in rows:
        lines.append(f"| {r['tool'] or 'total'} | {r['hits']} | {r['returned']} | {r['alternative']} | {r['alternative'] / r['returned'] if r['returned'] else 0:.1f} |")
    return "\n".join(lines) + "\n"


def rpc_session(spark: SparkSession, d: str) -> DataFrame:
    """A session of requests, right and wrong: ``(pos, id, error, count)``, 0 without id or error, -1 without count; notifications have no response."""
    said = ['{"id": 1, "method": "initialize"}', '{"method": "note"}', "{bad", '{"id": 2, "method": "none"}', '{"id": 3, "method": "tools/call", "params": {"name": "none"}}', '{"id": 4, "method": "tools/call", "params": {"name": "find_def", "arguments": {"name": "setup"}}}',
            '{"id": 5, "method": "tools/call", "params": {"name": "read_chunk", "arguments": {"file": "../x"}}}', '{"id": 6, "method": "tools/call", "params": {"name": "find_callers", "arguments": {"name": "wrapErr", "limit": 7}}}']
    s, rows = Session(spark, d), []
    for k, line in enumerate(said):
        if (back := s.respond(line)) is not None:
            r = json.loads(back)
            text = r.get("result", {}).get("content", [{}])[0].get("text")
            rows.append((k, r["id"] or 0, r.get("error", {}).get("code", 0), json.loads(text)["count"] if text else -1))
    return spark.createDataFrame(rows, "pos int, id int, error int, count int")


def prompt_hook(spark: SparkSession, d: str, envelope: str, max_bytes: int = 8000) -> str:
    """The answer of a hook to one JSON envelope (prompt, cwd): its context as JSON, "" where there is nothing to say or to read."""
    try:
        said = json.loads(envelope)
        prompt, where = said.get("prompt", "").strip(), said.get("cwd", "").strip()
    except (ValueError, AttributeError):
        return ""
    if not prompt or not where:
        return ""
    asked = spark.createDataFrame([(0, prompt)], "prompt_id int, text string")
    report = C.report(asked, C.evidence(asked, V.symbols(spark, d), V.files(spark, d)), max_bytes=max_bytes).first()["report"]
    return json.dumps({"hookSpecificOutput": {"hookEventName": "UserPromptSubmit", "additionalContext": report}}, ensure_ascii=False) if report else ""


def hook_session(spark: SparkSession, d: str) -> DataFrame:
    """Which of some envelopes get context."""
    said = ["{bad", '{"prompt": "", "cwd": "/r"}', '{"prompt": "x"}', '[1]', '{"prompt": "what calls `wrapErr(` and \\"return nil\\"?", "cwd": "/r"}', '{"prompt": "zzzz qqqq", "cwd": "/r"}']
    return spark.createDataFrame([(k, bool(prompt_hook(spark, d, e))) for k, e in enumerate(said)], "pos int, context boolean")


def queries():
    return {"hook_session": hook_session, "tool_bench": lambda s, d: tool_bench(s, d).select("pos", "tool", "hits", "alternative"), "rpc_session": rpc_session}


def oracle_sql():
    size = lambda q: f"CAST((SELECT coalesce(sum(length), 0) FROM (SELECT DISTINCT path, length FROM files WHERE path IN ({q}))) AS BIGINT)"
    like = "SELECT file FROM sym WHERE name = 'setup' ORDER BY file, start_line LIMIT 10"
    calls = "SELECT caller_file FROM calls WHERE callee = 'wrapErr' ORDER BY caller_file, caller_line, edge_id LIMIT 25"
    ranked = "SELECT file FROM (SELECT * FROM scored JOIN bag USING (id) ORDER BY score DESC, file, start_line, name LIMIT 10)"
    grepped = "SELECT * FROM h WHERE rn <= 5 ORDER BY file, start_line, name, rn LIMIT 25"
    tests = "SELECT DISTINCT file FROM sym WHERE false"
    first = "SELECT file FROM (SELECT * FROM sym WHERE starts_with(file, 'ledgerlake/') ORDER BY file || lpad(CAST(start_line AS VARCHAR), 8, '0') || name LIMIT 50)"
    n = lambda q: f"CAST((SELECT count(*) FROM ({q})) AS INTEGER)"
    return {
        "hook_session": "SELECT * FROM (VALUES (0, false), (1, false), (2, false), (3, false), (4, true), (5, false)) AS t(pos, context)",
        "tool_bench": f"""WITH {V.SYM}, {V.CALLS}, {V.FILES}, {S._BAG}, {S._score('bag', ['route', 'harbor', 'handler'])}, {S._BODY}, {S._matches('wrapErr\\(')},
            r AS (SELECT 0 AS pos, 'find_def' AS tool, {n(like)} AS hits, {size(like)} AS alternative UNION ALL SELECT 1, 'search_symbols', {n(ranked)}, {size(ranked)} UNION ALL SELECT 2, 'grep_symbols', {n(grepped)}, {size('SELECT file FROM sym')}
              UNION ALL SELECT 3, 'find_callers', {n(calls)}, {size(calls)} UNION ALL SELECT 4, 'find_refs', 0, 0 UNION ALL SELECT 5, 'tests_for', {n(tests)}, {size(tests)} UNION ALL SELECT 6, 'summary', {n(first)}, {size(first)})
            SELECT * FROM r UNION ALL SELECT 7, '', CAST(sum(hits) AS INTEGER), CAST(sum(alternative) AS BIGINT) FROM r""",
        "rpc_session": f"""WITH {V.SYM}, {V.CALLS} SELECT * FROM (VALUES (0, 1, 0, -1), (2, 0, -32700, -1), (3, 2, -32601, -1), (4, 3, -32602, -1), (6, 5, -32602, -1)) AS t(pos, id, error, count)
            UNION ALL SELECT 5, 4, 0, {n(like)} UNION ALL SELECT 7, 6, 0, {n("SELECT * FROM calls WHERE callee = 'wrapErr' LIMIT 7")}""",
    }
