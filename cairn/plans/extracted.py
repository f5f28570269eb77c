"""Queries: extraction from sources - symbols, calls, type references - with SQL twins that do not share its code.

The twins find pattern matches and their places by splitting contents at them, and take what Go declares from the given table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import golang
from cairn.functions import text as T
from cairn.operators import extract as X
from cairn.plans import views as V
from cairn.sources.tables import table

#: A small source with every construct; its rows are given in the twins.
GO_FIXTURE = """package a

// Limits of a run.
const Low, High = 1, 2

var (
	Table = map[Key][]*Val{}
	hidden Kind
)

type Node[P any] struct {
	Base
	*pkg.Other
	left, right *Node[P]
	load func(Req) (Res, error)
}

type Reader interface {
	io.Closer
	Read(p Page) (n int, err error)
}

// Walk goes down.
func (n *Node[P]) Walk(
	a, b Step,
	rest ...int,
) (Out, error) {
	if x := first(a); x != (Pair{1}) {
		return n.
			Next().
			Walk(b), helper[int](rest)
	}
	for _, e := range []Elem{{1}, {2}} {
		use(e.(Shape), []byte("call(x)"), len(rest))
	}
	go func(q Req) Res { return Res{} }(1)
	var w Window
	return w.copy(func() {}), nil // done(1)
}
"""


def extract_symbols(spark, d):
    """Every declaration; the signature is the line itself, which for Go is built anew and left out here."""
    s = X.extract(V.files(spark, d), "symbols")
    return s.select("name", "kind", "file", "start_line", "end_line", "receiver", "language", F.when(F.col("language") == "go", F.lit("")).otherwise(F.col("signature")).alias("signature"))


def extract_calls(spark, d):
    return X.extract(V.files(spark, d), "call_edges")


def extract_refs(spark, d):
    """How many references to a type each function and type makes; those of the given table are ``extract_refs_known``."""
    return X.extract(V.files(spark, d), "ref_edges")


def extract_refs_known(spark, d):
    """The references of the given table, of files that are there, that extraction finds as well: all of them."""
    got = X.extract(V.files(spark, d), "ref_edges").distinct()
    known = V.ref_edges(spark, d).select("caller", "caller_file", "caller_line", "callee", "kind").distinct()
    return known.join(got, ["caller", "caller_file", "caller_line", "callee", "kind"], "left_semi")


def extract_fixture(spark, d):
    """All rows that the fixture gives, as ``(tab, name, kind, line, end, detail)``."""
    files = spark.createDataFrame([("fix/a.go", GO_FIXTURE)], "path string, content string")
    g = X.extract_all(files)
    none = F.lit(0)
    return (
        g["symbols"].select(F.lit("symbol").alias("tab"), "name", "kind", F.col("start_line").alias("line"), F.col("end_line").alias("end"), F.concat_ws("|", "signature", "doc", "receiver").alias("detail"))
        .unionByName(g["call_edges"].select(F.lit("call").alias("tab"), F.col("callee").alias("name"), F.lit("").alias("kind"), F.col("caller_line").alias("line"), none.alias("end"), F.col("caller").alias("detail")))
        .unionByName(g["ref_edges"].select(F.lit("ref").alias("tab"), F.col("callee").alias("name"), "kind", F.col("caller_line").alias("line"), none.alias("end"), F.col("caller").alias("detail")))
    )


def compile_graph(spark, d):
    """One scan of the sources, three tables, and what they hold: the counts that a compile reports."""
    g = X.extract_all(V.files(spark, d))
    s = g["symbols"].groupBy("kind", "language").agg(F.count("*").alias("n")).select(F.lit("symbols").alias("tab"), F.concat_ws("/", "language", "kind").alias("what"), "n")
    files = g["symbols"].agg(F.countDistinct("file").alias("n")).select(F.lit("files").alias("tab"), F.lit("").alias("what"), "n")
    calls = g["call_edges"].where("caller_file not like '%.go'").groupBy(T.language_of("caller_file").alias("what")).agg(F.count("*").alias("n")).select(F.lit("calls").alias("tab"), "what", "n")
    return s.unionByName(files).unionByName(calls)


def extract_agreement(spark, d):
    """Functions and methods that the reader finds in Go files that are there, against the given table: found in both, only here, only there."""
    keys = ["file", "start_line", "name", "kind", "end_line", "receiver"]
    got = X.extract(V.files(spark, d).where("path like '%.go'"), "symbols").where("kind in ('function', 'method')").select(*keys, F.lit(True).alias("here"))
    there = V.symbols(spark, d).where("language = 'go' and kind in ('function', 'method')").join(V.files(spark, d).select(F.col("path").alias("file")), "file", "left_semi").select(*keys, F.lit(True).alias("there"))
    return got.join(there, keys, "full").groupBy("kind", F.col("here").isNotNull().alias("here"), F.col("there").isNotNull().alias("there")).agg(F.count("*").alias("n"))


def queries():
    return {f.__name__: f for f in (extract_symbols, extract_calls, extract_refs, extract_refs_known, extract_fixture, compile_graph, extract_agreement)}


def _q(s: str) -> str:
    return s.replace("'", "''")


_LANG_OF = f"CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) {' '.join(f"WHEN '{e}' THEN '{t}'" for e, t in T.LANGUAGES.items())} ELSE '' END"
_newlines = lambda x: f"(length({x}) - length(replace({x}, chr(10), '')))"


def _pattern(k: int, lang: str, kind: str, rx: str) -> str:
    rx = _q("(?m)" + rx)
    return f"""SELECT path, '{lang}' AS language, '{kind}' AS kind, {k} AS ord, u.i AS i, regexp_extract_all(content, '{rx}', 1)[u.i] AS name,
  1 + {_newlines(f"array_to_string(list_transform(range(1, u.i + 1), lambda j: regexp_split_to_array(content, '{rx}')[j] || CASE WHEN j < u.i THEN regexp_extract_all(content, '{rx}', 0)[j] ELSE '' END), '')")} AS n
 FROM fl, unnest(range(1, len(regexp_extract_all(content, '{rx}', 1)) + 1)) AS u(i) WHERE language = '{lang}'"""


_SYMBOLS = f"""{V.SYM}, {V.FILES}, fl AS (SELECT path, content, {_LANG_OF} AS language FROM files),
tx AS (SELECT path, language, string_split(content, chr(10)) AS l FROM fl),
ln AS (SELECT path, language, CAST(i AS INTEGER) AS n, l[i] AS t FROM tx, unnest(range(1, len(l) + 1)) AS u(i)),
sh AS (SELECT *, trim(t, ' ' || chr(9) || chr(13)) AS s, length(regexp_extract(t, '^[ \\t]*')) AS ind FROM ln),
bl AS (SELECT path, n, s, ind, s = '' AS blank, s = '' AND lag(s) OVER (PARTITION BY path ORDER BY n) = '' AS gap, s <> '' AND NOT regexp_matches(s, '^(\\}}|end|\\)|\\])') AS step FROM sh),
pm AS ({' UNION ALL '.join(_pattern(k, lang, kind, rx) for lang, ps in X.PATTERNS.items() for k, (kind, rx) in enumerate(ps))}),
st AS (SELECT pm.*, bl.ind AS own, bl.s AS line_text FROM pm JOIN bl USING (path, n)),
ends AS (SELECT st.path, st.n, st.own, min(b.n) AS stop FROM (SELECT DISTINCT path, n, own FROM st) st LEFT JOIN bl b ON b.path = st.path AND b.n > st.n + 1 AND (b.gap OR b.step AND b.ind <= st.own) GROUP BY ALL),
last_ AS (SELECT e.path, e.n, greatest(e.n, coalesce(max(b.n), e.n)) AS end_line FROM ends e LEFT JOIN bl b ON b.path = e.path AND NOT b.blank AND b.n >= e.n AND b.n < coalesce(e.stop, 2147483647) GROUP BY e.path, e.n),
ps AS (SELECT name, kind, path AS file, CAST(n AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, '' AS receiver, language, CASE WHEN strlen(line_text) > 200 THEN substring(line_text, 1, 200) ELSE line_text END AS signature FROM st JOIN last_ USING (path, n)),
gs AS (SELECT name, kind, file, start_line, end_line, receiver, language, '' AS signature FROM sym WHERE language = 'go' AND file IN (SELECT path FROM files) AND (kind NOT IN ('var', 'const') OR regexp_matches(name, '^[A-Z]'))),
all_s AS (SELECT * FROM ps UNION ALL SELECT * FROM gs)"""

_CALL_RX = "\\b([A-Za-z_]\\w*)\\s*\\("
_DEF_RX = "(?:^| )(?:def|function|func|fn|class|interface|type)$"
_NOISE = " OR ".join(f"c.language = '{k}' AND c.name IN ({','.join(f"'{w}'" for w in v.split())})" for k, v in X.CALL_NOISE.items())
_GO_DROP = ",".join(f"'{w}'" for w in sorted(golang.KEYWORDS))
_CALLS = f"""{_SYMBOLS}, cm AS (SELECT path, language, n, u.i, regexp_extract_all(t, '{_CALL_RX}', 1)[u.i] AS name,
  array_to_string(list_transform(range(1, u.i + 1), lambda j: regexp_split_to_array(t, '{_CALL_RX}')[j] || CASE WHEN j < u.i THEN regexp_extract_all(t, '{_CALL_RX}', 0)[j] ELSE '' END), '') AS before
 FROM ln, unnest(range(1, len(regexp_extract_all(t, '{_CALL_RX}', 1)) + 1)) AS u(i) WHERE language NOT IN ('go', '')),
cc AS (SELECT c.*, row_number() OVER () AS id FROM cm c WHERE NOT ({_NOISE}) AND NOT regexp_matches(trim(before, ' ' || chr(9) || chr(13)), '{_DEF_RX}')),
ca AS (SELECT cc.id, cc.path, cc.n, cc.name, coalesce(ps.name, '<file>') AS caller FROM cc LEFT JOIN ps ON ps.file = cc.path AND cc.n BETWEEN ps.start_line AND ps.end_line
 QUALIFY row_number() OVER (PARTITION BY cc.id ORDER BY ps.start_line DESC, ps.end_line, ps.name DESC) = 1),
g0 AS (SELECT path, array_to_string(list_transform(string_split(content, '/*'), lambda p, i: CASE WHEN i = 1 OR NOT contains(p, '*/') THEN p ELSE repeat(chr(10), {_newlines("split_part(p, '*/', 1)")}) || substring(p, instr(p, '*/') + 2) END), '') AS c FROM fl WHERE language = 'go'),
g1 AS (SELECT path, string_split(c, chr(10)) AS l FROM g0),
g2 AS (SELECT path, CAST(i AS INTEGER) AS n, regexp_replace(regexp_replace(l[i], '"(?:[^"\\\\]|\\\\.)*"', '""', 'g'), '//.*$', '') AS t FROM g1, unnest(range(1, len(l) + 1)) AS u(i)),
g3 AS (SELECT path, n, CASE WHEN regexp_matches(t, '^func\\b') THEN substring(t, instr(t, '{{') + 1) ELSE t END AS t FROM g2),
g4 AS (SELECT path, n, unnest(regexp_extract_all(t, '(?:^|[^\\]\\w])([A-Za-z_]\\w*)\\s*\\(', 1)) AS name, unnest(regexp_extract_all(t, '(^|[^\\]\\w])[A-Za-z_]\\w*\\s*\\(', 1)) AS pre FROM g3),
gc AS (SELECT g4.path, g4.n, g4.name, s.name AS caller FROM g4 JOIN sym s ON s.file = g4.path AND s.kind IN ('function', 'method') AND g4.n BETWEEN s.start_line AND s.end_line
 WHERE g4.name NOT IN ({_GO_DROP}) AND (g4.pre = '.' OR g4.name NOT IN ({','.join(f"'{w}'" for w in sorted(golang.BUILTINS))})))"""
_ALL_CALLS = "SELECT caller, path AS caller_file, n AS caller_line, name AS callee FROM ca WHERE caller <> name UNION ALL SELECT caller, path, n, name FROM gc WHERE caller <> name"

_FIX = """('symbol', 'Low', 'const', 4, 4, 'const Low|Limits of a run.|'), ('symbol', 'High', 'const', 4, 4, 'const High|Limits of a run.|'), ('symbol', 'Table', 'var', 7, 7, 'var Table||'),
('symbol', 'Node', 'type', 11, 16, 'type Node struct{...}||'), ('symbol', 'Reader', 'interface', 18, 21, 'type Reader interface{...}||'), ('symbol', 'Walk', 'method', 24, 39, 'func (*Node[P]) Walk(a, b Step, rest ...int) (Out, error)|Walk goes down.|Node'),
('call', 'first', '', 28, 0, 'Walk'), ('call', 'Next', '', 29, 0, 'Walk'), ('call', 'helper', '', 31, 0, 'Walk'), ('call', 'use', '', 34, 0, 'Walk'), ('call', 'copy', '', 38, 0, 'Walk'),
('ref', 'Key', 'type', 7, 0, '<file>'), ('ref', 'Val', 'type', 7, 0, '<file>'), ('ref', 'Kind', 'type', 8, 0, '<file>'), ('ref', 'Base', 'embed', 12, 0, 'Node'), ('ref', 'Other', 'embed', 13, 0, 'Node'),
('ref', 'Node', 'type', 14, 0, 'Node'), ('ref', 'P', 'type', 14, 0, 'Node'), ('ref', 'Req', 'type', 15, 0, 'Node'), ('ref', 'Res', 'type', 15, 0, 'Node'), ('ref', 'Closer', 'embed', 19, 0, 'Reader'), ('ref', 'Page', 'type', 20, 0, 'Reader'),
('ref', 'Node', 'type', 24, 0, 'Walk'), ('ref', 'P', 'type', 24, 0, 'Walk'), ('ref', 'Step', 'type', 25, 0, 'Walk'), ('ref', 'Out', 'type', 27, 0, 'Walk'), ('ref', 'Pair', 'type', 28, 0, 'Walk'), ('ref', 'Elem', 'type', 33, 0, 'Walk'), ('ref', 'Shape', 'type', 34, 0, 'Walk'),
('ref', 'Req', 'type', 36, 0, 'Walk'), ('ref', 'Res', 'type', 36, 0, 'Walk'), ('ref', 'Res', 'type', 36, 0, 'Walk'), ('ref', 'Window', 'type', 37, 0, 'Walk')"""


def oracle_sql():
    return {
        "extract_symbols": f"WITH {_SYMBOLS} SELECT * FROM all_s",
        "extract_calls": f"WITH {_CALLS} {_ALL_CALLS}",
        "extract_refs_known": f"WITH {V.REFS}, {V.FILES} SELECT DISTINCT caller, caller_file, caller_line, callee, kind FROM refs WHERE caller_file IN (SELECT path FROM files)",
        "extract_fixture": f'SELECT * FROM (VALUES {_FIX}) AS t(tab, name, kind, line, "end", detail)',
        "compile_graph": f"""WITH {_CALLS} SELECT 'symbols' AS tab, language || '/' || kind AS what, count(*) AS n FROM all_s GROUP BY ALL UNION ALL SELECT 'files', '', count(DISTINCT file) FROM all_s
            UNION ALL SELECT 'calls', language, count(*) FROM ({_ALL_CALLS}) AS x JOIN fl ON path = caller_file WHERE language <> 'go' GROUP BY ALL""",
        "extract_agreement": f"WITH {V.SYM}, {V.FILES} SELECT kind, true AS here, true AS there, count(*) AS n FROM sym WHERE language = 'go' AND kind IN ('function', 'method') AND file IN (SELECT path FROM files) GROUP BY kind",
    }
