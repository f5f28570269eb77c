"""Lookups in the code graph: definitions, callers, references, tests, search in bodies, file summaries.

Inputs are the tables of the graph with nulls replaced by "" and rows of one key made one (``plans.views``).  Every lookup is
a pushed-down filter or a join on (file, name); results are ordered and cut by limits as the parameters say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import bm25


def clamp(value: int, default: int, most: int) -> int:
    """``default`` if ``value`` is not positive, at most ``most``."""
    return min(value if value > 0 else default, most)


def filtered(df: DataFrame, prefix: str = "", language: str = "", kind: str = "", file_col: str = "file") -> DataFrame:
    """Rows by file prefix, language and kind; "" filters nothing."""
    if prefix:
        df = df.where(F.col(file_col).startswith(prefix))
    if language:
        df = df.where(F.col("language") == language)
    if kind:
        df = df.where(F.col("kind") == kind)
    return df


def find_def(symbols: DataFrame, name: str, language: str = "", kind: str = "", limit: int = 0) -> DataFrame:
    """Symbols of exactly this name; where there is none at all, those whose name contains it in any case."""
    exact = symbols.where(F.col("name") == name)
    like = symbols.where(F.contains(F.lower("name"), F.lit(name.lower())))
    none = exact.limit(1).agg(F.count("*").alias("n_exact"))  # one row
    found = exact.unionByName(like.crossJoin(F.broadcast(none)).where("n_exact = 0").drop("n_exact"))
    return filtered(found, "", language, kind).orderBy("file", "start_line", "name").limit(clamp(limit, 10, 50))


def find_callers(edges: DataFrame, name: str, prefix: str = "", limit: int = 0) -> DataFrame:
    return filtered(edges.where(F.col("callee") == name), prefix, file_col="caller_file").orderBy("caller_file", "caller_line", "edge_id").limit(clamp(limit, 25, 200))


def find_refs(refs: DataFrame, name: str, kinds: list[str] | None = None, prefix: str = "", limit: int = 0) -> DataFrame:
    hit = filtered(refs.where(F.col("callee") == name), prefix, file_col="caller_file")
    if kinds:
        hit = hit.where(F.col("kind").isin(kinds))
    return hit.orderBy("caller_file", "caller_line", "ref_id").limit(clamp(limit, 25, 200))


def is_test_file(path: Column) -> Column:
    """File conventions of tests in Go, Python, TypeScript, JavaScript, Java and Kotlin."""
    base = F.substring_index(path, "/", -1)
    return base.rlike(r"(_test\.go|_test\.py|\.(test|spec)\.tsx?|\.(test|spec)\.js)$") | (base.startswith("test_") & base.endswith(".py")) | path.rlike(r"(^|/)__tests__/|(^|/)src/test/")


def is_test_symbol() -> Column:
    """Whether the symbol (name, kind, language, file) is a test by its language's rules."""
    name, lang = F.col("name"), F.col("language")
    named = (
        F.when(lang == "go", name.rlike("^(Test|Benchmark|Example|Fuzz)"))
        .when(lang == "py", name.rlike("^(test_|Test)"))
        .when(lang.isin("ts", "tsx", "js", "jsx"), F.lit(True))
        .when(lang.isin("java", "kt"), name.rlike("^(test|Test)"))
        .otherwise(F.lower(name).startswith("test"))
    )
    return F.col("kind").isin("function", "method") & F.when(lang == "rs", name.rlike("^(test_|Test)")).otherwise(is_test_file(F.col("file")) & named)


def name_matches(test: Column, target: str) -> Column:
    stripped = F.regexp_replace(test, "^(Test|test_|test|Benchmark|benchmark|Example|Fuzz)", "")
    return F.contains(F.lower(stripped), F.lit(target.lower())) if target else F.lit(False)


def tests_for(symbols: DataFrame, edges: DataFrame, name: str, limit: int = 0, test_file: Column | None = None, test_symbol: Column | None = None) -> DataFrame:
    """Tests that call ``name``, or are named after it, with the reasons.  The predicates for test files and symbols can be replaced."""
    in_test = test_file if test_file is not None else is_test_file(F.col("caller_file"))
    is_test = test_symbol if test_symbol is not None else is_test_symbol()
    one = symbols.withColumn("rn", F.row_number().over(Window.partitionBy("file", "name").orderBy("start_line", "kind"))).where("rn = 1").drop("rn")
    calls = edges.where((F.col("callee") == name) & in_test).select(F.col("caller").alias("name"), F.col("caller_file").alias("file")).distinct()
    called = one.join(calls, ["name", "file"]).withColumn("reason", F.lit("calls"))
    named = symbols.where(is_test & name_matches(F.col("name"), name)).withColumn("reason", F.lit("name_match"))
    both = called.unionByName(named, allowMissingColumns=True).groupBy("file", "start_line").agg(F.min("name").alias("name"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    n = F.size(F.split("reasons", ","))
    return both.select("file", "start_line", "name", "reasons").orderBy(n.desc(), "file", "start_line").limit(clamp(limit, 25, 200))


def summary(symbols: DataFrame, prefix: str, limit: int = 0) -> DataFrame:
    """Symbols under a path: first cut in index order (``idx_pos``), then sorted by file and line."""
    return filtered(symbols, prefix).orderBy("idx_pos").limit(clamp(limit, 50, 200)).orderBy("file", "start_line")


def search_symbols(symbols: DataFrame, query: str, language: str = "", kind: str = "", limit: int = 0) -> DataFrame:
    """Ranking of symbols by BM25; the filters apply to the best ``4 * limit`` and can leave fewer than ``limit``."""
    k = clamp(limit, 10, 50)
    terms = symbols.sparkSession.range(1).select(T.query_tokens(F.lit(query)).alias("t")).first()[0]
    shown = tuple(c for c in symbols.columns if c not in ("id", "dl", "tokens", "score"))
    docs = bm25.tokenized(symbols.withColumn("sid", F.concat_ws(":", "file", "start_line", "name")), "sid", T.symbol_tokens(), shown)
    order = [F.desc("score"), "file", "start_line", "name"]
    top = bm25.score(docs, list(dict.fromkeys(terms)), shown).orderBy(*order).limit(4 * k)
    return filtered(top, "", language, kind).orderBy(*order).limit(k).drop("id")


def lines_of(files: DataFrame) -> DataFrame:
    """``(file, lines)``: each file's lines as an array."""
    return files.select(F.col("path").alias("file"), F.split(F.coalesce("content", F.lit("")), "\n", -1).alias("lines"))


def within_root(path: Column) -> Column:
    """Whether a relative path stays below the root, ``.`` and ``..`` resolved."""
    depth = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, p: F.struct(
        (a["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"), F.least(a["least"], a["at"] + F.when(p == "..", -1).otherwise(0)).alias("least")), lambda a: a["least"])
    return ~path.startswith("/") & (depth >= 0)


def read_chunk(files: DataFrame, file: str, start: int = 1, end: int = 0, max_lines: int = 0) -> DataFrame:
    """``(file, line, text)`` of a range of lines; paths that leave the root are refused."""
    if file.startswith("/") or ".." in file.split("/"):
        raise ValueError("the path leaves the root")
    start = max(1, start)
    n = clamp(max_lines, 200, 1000) if end < start else min(end - start + 1, clamp(max_lines, 200, 1000))
    part = lines_of(files.where(F.col("path") == file)).select("file", F.posexplode(F.slice("lines", start, n)).alias("p", "text"))
    return part.select("file", (F.col("p") + start).alias("line"), "text")


def match_columns(text: Column, pattern: str) -> Column:
    """The 1-based byte columns at which ``pattern`` matches in ``text``, in order; matches of no length are none."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    upto = lambda a, n: F.octet_length(F.array_join(F.slice(a, 1, n), ""))
    return F.transform(found, lambda m, i: 1 + upto(gaps, i + 1) + upto(found, i))


def quoted(literal: str) -> str:
    """A pattern that matches ``literal`` and nothing else."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def grep_hits(symbols: DataFrame, files: DataFrame, pattern: str, literal: bool = False, max_per_symbol: int = 5) -> DataFrame:
    """Matches within symbol bodies, ``(file, start_line, name, kind, line, col, text, rn)``: every match of a line, ``col`` in bytes,
    at most ``max_per_symbol`` a symbol.

    A range join that carries no file twice: the symbols of a file come to its lines as an array, each takes its slice of the lines,
    and only matches leave the row.  Symbols that begin before line 1 have no body."""
    if len(pattern.encode()) > 1024:
        raise ValueError("the pattern is too long")
    most = clamp(max_per_symbol, 5, 20)
    rx = quoted(pattern) if literal else pattern
    bodies = symbols.where("start_line > 0 and end_line >= start_line").groupBy("file").agg(F.collect_list(F.struct("start_line", "end_line", "name", "kind")).alias("bodies"))
    # Files without any match are dropped before they meet their symbols.
    content = F.coalesce("content", F.lit(""))
    some = files.where(F.contains(content, F.lit(pattern)) if literal else content.rlike("(?m)" + pattern))
    hit = lambda t: F.contains(t, F.lit(pattern)) if literal else t.rlike(rx)

    def of(s: Column) -> Column:
        lines = F.filter(F.transform(F.slice("lines", s["start_line"], s["end_line"] - s["start_line"] + 1), lambda t, i: F.struct((s["start_line"] + i).alias("line"), t.alias("text"))), lambda x: hit(x["text"]))
        each = F.transform(lines, lambda x: F.transform(match_columns(x["text"], rx), lambda c: F.struct(x["line"].alias("line"), c.alias("col"), x["text"].alias("text"))))
        return F.struct(s["start_line"].alias("start_line"), s["name"].alias("name"), s["kind"].alias("kind"), F.slice(F.flatten(each), 1, most).alias("hits"))

    found = lines_of(some).join(bodies, "file").select("file", F.explode(F.filter(F.transform("bodies", of), lambda s: F.size(s["hits"]) > 0)).alias("s"))
    return found.select("file", "s.start_line", "s.name", "s.kind", F.posexplode("s.hits").alias("p", "x")).select("file", "start_line", "name", "kind", "x.line", "x.col", "x.text", (F.col("p") + 1).alias("rn"))


def snippet_trim(text: Column, most: int = 200) -> Column:
    """Leading blanks off; of more than ``most`` bytes one less, without a character that is cut in two, and an ellipsis."""
    t = F.regexp_replace(text, "^[ \\t]+", "")
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(t, "UTF-8"), 1, most - 1).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(t) > most, F.concat(cut, F.lit("…"))).otherwise(t)


def grep_symbols(symbols: DataFrame, files: DataFrame, pattern: str, literal: bool = False, prefix: str = "", language: str = "", kind: str = "", limit: int = 0, max_per_symbol: int = 0) -> DataFrame:
    """The first ``limit`` matches in order of file, symbol and place, at most ``max_per_symbol`` per symbol."""
    hits = grep_hits(filtered(symbols, prefix, language, kind), files, pattern, literal, max_per_symbol)
    return hits.orderBy("file", "start_line", "name", "rn").limit(clamp(limit, 25, 200)).select("file", "start_line", "name", "kind", "line", "col", snippet_trim(F.col("text")).alias("snippet"))


def grep_truncated(symbols: DataFrame, hits: DataFrame, limit: int = 0, prefix: str = "", language: str = "", kind: str = "") -> DataFrame:
    """One row ``(count, truncated)`` on the hits of ``grep_symbols``: whether any symbol, with matches or not, comes after the one at
    which the limit was reached."""
    at = F.struct("file", "start_line", "name")
    last = hits.agg(F.count("*").alias("count"), F.max(at).alias("last"))
    # The last symbol of all is one row, whatever the number of symbols.
    end = filtered(symbols, prefix, language, kind).agg(F.max(at).alias("end"))
    return last.crossJoin(F.broadcast(end)).select("count", F.coalesce((F.col("count") >= clamp(limit, 25, 200)) & (F.col("end") > F.col("last")), F.lit(False)).alias("truncated"))


#: Lines of one stretch of a file.
STRETCH = 64


def enclosing(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """The innermost symbol around each ``(file, line)``: interval join within the file, latest start wins; ``<file>`` where there is none.

    Both sides are keyed by file and stretch of ``STRETCH`` lines, so a hot file is as many keys as it has stretches, and a line meets
    the symbols of its stretch only."""
    s = symbols.where("end_line >= start_line").select("file", F.col("name").alias("s_name"), F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end"))
    s = s.withColumn("part", F.explode(F.sequence(F.floor(F.col("s_start") / STRETCH), F.floor(F.col("s_end") / STRETCH))))
    asked = calls.withColumn("part", F.floor(F.col("line") / STRETCH))
    joined = asked.join(s, (asked["file"] == s["file"]) & (asked["part"] == s["part"]) & asked["line"].between(s["s_start"], s["s_end"]), "left").drop(s["file"]).drop(s["part"])
    return joined.groupBy("file", "line").agg(F.coalesce(F.max_by("s_name", F.struct("s_start", -F.col("s_end"), "s_name")), F.lit("<file>")).alias("caller"))


def alternative_bytes(result_files: DataFrame, files: DataFrame) -> DataFrame:
    """What reading the distinct files of a result would cost: ``(n_files, bytes)``."""
    return files.select(F.col("path").alias("file"), "length").join(result_files.select("file").distinct(), "file", "left_semi").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
