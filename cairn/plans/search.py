"""Queries: keyword ranking, vector search and lookups in the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import bm25, graph, vector
from cairn.operators.lineage import shared_folder
from cairn.plans import views as V
from cairn.sources.tables import table

#: What the registered queries ask; the operators take any other values.
WIKI_TERMS = ["cache", "checkpoint", "cache", "scheduler"]
NAME, CALLEE, TYPE_LIKE, SYMBOL_QUERY = "setup", "wrapErr", "route", "route harbor handler"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return bm25.tokenized(table(spark, d, "documents").select("doc_id", "text"), "doc_id", T.prose_tokens("text"))


def term_stats(spark, d):
    return bm25.postings(_docs(spark, d)).groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"), F.max("tf").alias("max_tf"))


def doc_freq_topn(spark, d):
    return bm25.document_frequency(_docs(spark, d)).orderBy(F.desc("df"), "term").limit(50)


def corpus_stats(spark, d):
    return bm25.corpus_stats(_docs(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


def wiki_bm25_topk(spark, d):
    return bm25.score(_docs(spark, d), list(dict.fromkeys(WIKI_TERMS))).orderBy(F.desc("score"), "id").limit(10)


def wiki_bm25_repeated_terms(spark, d):
    return bm25.score(_docs(spark, d), WIKI_TERMS).orderBy(F.desc("score"), "id").limit(10)


def bm25_index_topk(spark, d):
    """The ranking from an index on disk, which is built once and of which a query reads the postings of its terms."""
    folder = shared_folder(spark, "bm25")
    bm25.write_index(_docs(spark, d), folder)
    return bm25.search_index(spark, folder, WIKI_TERMS).orderBy(F.desc("score"), "id").limit(10)


def wiki_snippet(spark, d):
    """Ranking of wiki pages with title and snippet."""
    p = V.pages(spark, d).withColumn("plain", T.strip_front_matter("body"))
    terms = ["cache", "scheduler"]
    docs = bm25.tokenized(p, "path", T.prose_tokens("plain"), ("slug", "plain"))
    top = bm25.score(docs, terms, ("slug", "plain")).orderBy(F.desc("score"), "id").limit(10)
    return top.select(F.col("id").alias("path"), "slug", T.first_heading("plain").alias("title"), T.snippet("plain", F.array(*map(F.lit, terms))).alias("snippet"), "score")


def _query_vector(spark, d, tbl, key, vec, value) -> list[float]:
    row = table(spark, d, tbl).where(F.col(key) == value).select(vec).first()
    return [float(x) for x in row[0]] if row and row[0] else []


def vector_topk(spark, d):
    return vector.search(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d, "embeddings", "vec_id", "embedding", 7), 10)


def vector_dim_zero_guard(spark, d):
    """All entries scored against one; null, zero and foreign vectors score 0."""
    e = table(spark, d, "entries").groupBy("entry_id").agg(F.min("vector").alias("vector"))
    q = _query_vector(spark, d, "embeddings", "vec_id", "embedding", 7)
    return e.select("entry_id", F.round(F.coalesce(vector.cosine(F.col("vector"), q), F.lit(0.0)), 5).alias("score"))


def find_def_exact(spark, d):
    return graph.find_def(V.symbols(spark, d), NAME).select("name", "kind", "file", "start_line", "end_line", "language")


def find_def_fallback(spark, d):
    return graph.find_def(V.symbols(spark, d), TYPE_LIKE, limit=50).select("name", "kind", "file", "start_line", "language")


def find_def_filtered(spark, d):
    return graph.find_def(V.symbols(spark, d), "run", "go", "function").select("name", "kind", "file", "start_line", "language")


def find_callers(spark, d):
    return graph.find_callers(V.call_edges(spark, d, CALLEE), CALLEE)


def find_callers_prefix(spark, d):
    return graph.find_callers(V.call_edges(spark, d, CALLEE), CALLEE, "ledgerlake/", 200)


def find_refs(spark, d):
    top = V.ref_edges(spark, d).groupBy("callee").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "callee").first()
    return graph.find_refs(V.ref_edges(spark, d, top[0] if top else ""), top[0] if top else "")


def find_refs_kinds(spark, d):
    top = V.ref_edges(spark, d).where("kind = 'embed'").groupBy("callee").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "callee").first()
    return graph.find_refs(V.ref_edges(spark, d, top[0] if top else ""), top[0] if top else "", ["embed"], limit=200)


#: Where a language keeps its tests: a pattern on the path and what stands for it; the sources themselves hold no file that is named as a test.
_TEST_NAMES = (("go", r"\.go$", "_test.go"), ("py", r"([^/]*)\.py$", "test_$1.py"), ("ts", r"\.tsx?$", ".spec.ts"), ("js", r"([^/]+)$", "__tests__/$1"), ("java", "^", "src/test/"), ("kt", "^", "src/test/"))


def as_tests(df, column: str):
    """``df`` with every other path (those of an even length) renamed as a test of its language."""
    renamed = F.col(column)
    for lang, rx, to in _TEST_NAMES:
        renamed = F.when(T.language_of(column) == lang, F.regexp_replace(column, rx, to)).otherwise(renamed)
    return df.withColumn(column, F.when(F.length(column) % 2 == 0, renamed).otherwise(F.col(column)))


def tests_for(spark, d):
    """Tests of a name by calls and by names, over paths of which every other one is renamed as a test's."""
    s = as_tests(V.symbols(spark, d), "file").withColumn("name", F.when(F.length("name") % 2 == 0, F.concat(F.lit("Test"), "name")).otherwise(F.concat(F.lit("test_"), "name")))
    e = as_tests(V.call_edges(spark, d, CALLEE), "caller_file").withColumn("caller", F.when(F.length("caller") % 2 == 0, F.concat(F.lit("Test"), "caller")).otherwise(F.concat(F.lit("test_"), "caller")))
    return graph.tests_for(s, e, CALLEE, 200)


#: Paths in the form of each convention of tests, and forms that only look like one.
_FORMS = ("{d}/{s}_test.go", "{d}/test_{s}.py", "{d}/{s}_test.py", "{d}/{s}.test.ts", "{d}/{s}.spec.tsx", "{d}/{s}.test.js", "{d}/{s}.spec.js", "{d}/__tests__/{s}.js", "src/test/{s}.java", "{d}/src/test/{s}.kt", "{d}/{s}.go", "{d}/test_{s}.rb", "{d}/{s}test.py", "{d}/__tests__x/{s}.js")


def test_files(spark, d):
    """Each path in each form, and whether that is a test."""
    f = table(spark, d, "source_files").where("path like '%/%'").select("path").distinct()
    stem, folder = F.regexp_replace(F.substring_index("path", "/", -1), r"\..*$", ""), F.regexp_replace("path", "/[^/]*$", "")
    forms = F.explode(F.array(*[F.struct(F.lit(k).alias("form"), F.replace(F.replace(F.lit(x), F.lit("{d}"), folder), F.lit("{s}"), stem).alias("file")) for k, x in enumerate(_FORMS)])).alias("x")
    return f.select(forms).groupBy("x.form").agg(F.count_if(graph.is_test_file(F.col("x.file"))).alias("tests"), F.count("*").alias("n"))


def test_symbols(spark, d):
    """Which symbols are tests if their files were in a test tree."""
    s = V.symbols(spark, d).withColumn("file", F.concat(F.lit("src/test/"), F.col("file")))
    return s.groupBy("language", graph.is_test_symbol().alias("is_test"), graph.name_matches(F.col("name"), "harbor").alias("matches")).agg(F.count("*").alias("n"))


def summary_limit_then_sort(spark, d):
    s = V.symbols(spark, d).withColumn("idx_pos", F.concat(F.lpad(F.col("start_line").cast("string"), 8, "0"), "file", "name"))
    return graph.summary(s, "ledgerlake/").select("name", "kind", "file", "start_line", "end_line")


def search_symbols(spark, d):
    return graph.search_symbols(V.symbols(spark, d), SYMBOL_QUERY).select("file", "start_line", "name", "kind", "score")


def search_symbols_filtered(spark, d):
    return graph.search_symbols(V.symbols(spark, d), SYMBOL_QUERY, "go", "function", 20).select("file", "start_line", "name", "kind", "score")


def grep_body(spark, d):
    """How many matches each body has, up to 20 a symbol (the clamp of the tool), and the line of the first of them."""
    return graph.grep_hits(V.symbols(spark, d), V.files(spark, d), r"wrapErr\(", max_per_symbol=20).groupBy("file", "start_line", "name").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


def grep_body_capped(spark, d):
    return graph.grep_symbols(V.symbols(spark, d), V.files(spark, d), r"wrapErr\(", language="go", limit=200, max_per_symbol=1)


def grep_truncated(spark, d):
    """Whether the search stopped before the last symbol, for a search with more matches than the limit."""
    s = V.symbols(spark, d)
    hits = graph.grep_symbols(s, V.files(spark, d), r"wrapErr\(", limit=25, max_per_symbol=20)
    return graph.grep_truncated(s, hits, 25)


def grep_literal(spark, d):
    """All matches of a text, several a line, with their byte columns."""
    return graph.grep_symbols(V.symbols(spark, d), V.files(spark, d), ", ", True, language="go", limit=200, max_per_symbol=20)


def literal_first_hit(spark, d):
    return graph.grep_hits(V.symbols(spark, d), V.files(spark, d), "total -= ", True, 1).where("rn = 1").select("file", "start_line", "name", "line")


def enclosing_symbol(spark, d):
    c = V.call_edges(spark, d).select(F.col("caller_file").alias("file"), F.col("caller_line").alias("line")).distinct()
    return graph.enclosing(c, V.symbols(spark, d))


def offset_to_line(spark, d):
    """The line of the first call of a name in each file, by byte offset: the lines before it."""
    f = V.files(spark, d)
    at = F.locate("wrapErr(", F.col("content"))
    before = F.substring(F.col("content"), F.lit(1), at - 1)
    return f.where(at > 0).select("path", F.octet_length(before).cast("bigint").alias("offset"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"))


def read_chunk(spark, d):
    first = V.file_sizes(spark, d).agg(F.min("path")).first()
    return graph.read_chunk(V.files(spark, d, first[0] or ""), first[0] or "none", 3, 40)


def alternative_bytes(spark, d):
    return graph.alternative_bytes(V.call_edges(spark, d, CALLEE).select(F.col("caller_file").alias("file")), V.file_sizes(spark, d))


def count_by_language(spark, d):
    return V.symbols(spark, d).groupBy("language").agg(F.count("*").alias("n"))


def count_by_kind(spark, d):
    return V.symbols(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


def file_count(spark, d):
    return V.symbols(spark, d).agg(F.countDistinct("file").alias("n_files"))


_QUERIES = (
    term_stats, doc_freq_topn, corpus_stats, wiki_bm25_topk, wiki_bm25_repeated_terms, bm25_index_topk, wiki_snippet, vector_topk, vector_dim_zero_guard, find_def_exact, find_def_fallback,
    find_def_filtered, find_callers, find_callers_prefix, find_refs, find_refs_kinds, tests_for, test_files, test_symbols, summary_limit_then_sort, search_symbols, search_symbols_filtered,
    grep_body, grep_body_capped, grep_truncated, grep_literal, literal_first_hit, enclosing_symbol, offset_to_line, read_chunk, alternative_bytes, count_by_language, count_by_kind, file_count,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


_STOP = "[" + ",".join(f"'{w}'" for w in T.PROSE_STOPWORDS) + "]"
_SSTOP = "[" + ",".join(f"'{w}'" for w in T.SYMBOL_STOPWORDS) + "]"
_PROSE = "list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: strlen(x) >= 2 AND NOT list_contains(" + _STOP + ", x))"
_TOK = "tok AS (SELECT doc_id AS id, " + _PROSE.format(t="text") + " AS w FROM documents WHERE doc_id IS NOT NULL)"
_POST = "post AS (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM tok) GROUP BY ALL)"


def _score(src: str, terms: list[str]) -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""q(pos, term) AS (VALUES {values}), p AS (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM {src}) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM p GROUP BY term), st AS (SELECT count(*) AS big_n, avg(len(w)) AS avgdl FROM {src}),
scored AS (SELECT id, round(sum(ln((big_n - n + 0.5) / (n + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY id HAVING score > 0)"""


_SPLIT = "list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({n}, '_', ' '), '([0-9])([^0-9 ])', '\\1 \\2', 'g'), '([^0-9 ])([0-9])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), ' '), lambda x: x <> '')"
_IDENT = "CASE WHEN {n} = '' THEN [] ELSE list_concat(list_transform(" + _SPLIT + ", lambda x: lower(x)), [lower({n})]) END"
_BAG = (
    "bag AS (SELECT sym.*, concat_ws(':', file, start_line, name) AS id, list_concat(list_concat(" + _IDENT.format(n="name") + ", " + _IDENT.format(n="receiver") + "), list_concat(flatten(list_transform(regexp_extract_all(signature, '[A-Za-z_][A-Za-z0-9_]*'), lambda s: "
    + _IDENT.format(n="s") + ")), list_filter(regexp_split_to_array(lower(doc), '[^a-z0-9]+'), lambda x: strlen(x) >= 2 AND NOT list_contains(" + _SSTOP + ", x)))) AS w FROM sym)"
)
_BODY = f"""body AS (SELECT sym.file, start_line, name, kind, start_line + i - 1 AS line, l[start_line + i - 1] AS text FROM sym JOIN (SELECT path AS file, string_split(content, chr(10)) AS l FROM files) USING (file),
  unnest(range(1, end_line - start_line + 2)) AS u(i) WHERE start_line > 0 AND start_line + i - 1 <= len(l))"""


def _matches(rx: str, where: str = "true") -> str:
    """Every match of a line with its byte column and its number in the symbol."""
    return f"""mt AS (SELECT body.*, u.k, 1 + strlen(array_to_string(list_transform(range(1, u.k + 1), lambda j: regexp_split_to_array(text, '{rx}')[j] || CASE WHEN j < u.k THEN regexp_extract_all(text, '{rx}')[j] ELSE '' END), '')) AS col
  FROM body, unnest(range(1, len(regexp_extract_all(text, '{rx}')) + 1)) AS u(k) WHERE {where}),
h AS (SELECT *, row_number() OVER (PARTITION BY file, start_line, name ORDER BY line, col) AS rn, regexp_replace(text, '^[ \\t]+', '') AS t FROM mt)"""


_TEST_SQL = "CASE WHEN length({n}) % 2 = 0 THEN 'Test' || {n} ELSE 'test_' || {n} END"


def _renamed(c: str) -> str:
    lang = f"CASE lower(regexp_extract({c}, '\\.([^./]+)$', 1)) {' '.join(f"WHEN '{e}' THEN '{t}'" for e, t in T.LANGUAGES.items())} ELSE '' END"
    sql = {r"\.go$": r"\.go$", "^": "^"}
    to = " ".join(f"WHEN '{g}' THEN regexp_replace({c}, '{sql.get(rx, rx)}', '{t.replace('$1', chr(92) + '1')}')" for g, rx, t in _TEST_NAMES)
    return f"CASE WHEN length({c}) % 2 = 0 THEN CASE {lang} {to} ELSE {c} END ELSE {c} END"


_SNIP = "CASE WHEN strlen(t) > 200 THEN substring(t, 1, len(list_filter(range(1, length(t) + 1), lambda k: strlen(substring(t, 1, k)) <= 199))) || '…' ELSE t END"


def oracle_sql():
    top = "SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 10"
    vq = "(SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]"
    return {
        "term_stats": f"WITH {_TOK}, {_POST} SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df, max(tf) AS max_tf FROM post GROUP BY term",
        "doc_freq_topn": f"WITH {_TOK}, {_POST} SELECT term, count(*) AS df FROM post GROUP BY term ORDER BY df DESC, term LIMIT 50",
        "corpus_stats": f"WITH {_TOK} SELECT count(*) AS n, round(avg(len(w)), 6) AS avgdl FROM tok",
        "wiki_bm25_topk": f"WITH {_TOK}, {_score('tok', list(dict.fromkeys(WIKI_TERMS)))} {top}",
        "wiki_bm25_repeated_terms": f"WITH {_TOK}, {_score('tok', WIKI_TERMS)} {top}",
        "bm25_index_topk": f"WITH {_TOK}, {_score('tok', WIKI_TERMS)} {top}",
        "wiki_snippet": f"""WITH {V.PAGES}, pl AS (SELECT path, slug, regexp_replace(body, '^---\\n(.|\\n)*?\\n---\\n', '') AS plain FROM pages),
            tok AS (SELECT path AS id, {_PROSE.format(t='plain')} AS w FROM pl), {_score('tok', ['cache', 'scheduler'])},
            best AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 10),
            spot AS (SELECT path, slug, plain, score, least(CASE WHEN instr(lower(plain), 'cache') > 0 THEN instr(lower(plain), 'cache') END, CASE WHEN instr(lower(plain), 'scheduler') > 0 THEN instr(lower(plain), 'scheduler') END) AS p FROM best JOIN pl ON id = path),
            hit AS (SELECT *, strlen(substring(plain, 1, p - 1)) AS b FROM spot), cut AS (SELECT *, greatest(b - 60, 0) AS lo, least(b + 140, strlen(plain)) AS hi FROM hit),
            ends AS (SELECT *, len(list_filter(range(0, length(plain) + 1), lambda k: strlen(substring(plain, 1, k)) < lo)) AS s0, len(list_filter(range(1, length(plain) + 1), lambda k: strlen(substring(plain, 1, k)) <= hi)) AS e0 FROM cut)
            SELECT path, slug, trim(regexp_extract(plain, '(?m)^# ([^\\n]*)$', 1)) AS title, CASE WHEN lo > 0 THEN '…' ELSE '' END || replace(trim(substring(plain, s0 + 1, e0 - s0), ' ' || chr(9) || chr(13) || chr(10)), chr(10), ' ') || CASE WHEN hi < strlen(plain) THEN '…' ELSE '' END AS snippet, score FROM ends""",
        "vector_topk": f"SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], {vq}), 5) AS score FROM embeddings ORDER BY score DESC, id LIMIT 10",
        "vector_dim_zero_guard": f"SELECT entry_id, round(CASE WHEN len(v) = 64 AND len(list_filter(v, lambda x: x <> 0)) > 0 THEN list_cosine_similarity(v::DOUBLE[], {vq}) ELSE 0.0 END, 5) AS score FROM (SELECT entry_id, min(vector) AS v FROM entries GROUP BY entry_id)",
        "find_def_exact": f"WITH {V.SYM} SELECT name, kind, file, start_line, end_line, language FROM sym WHERE name = '{NAME}' ORDER BY file, start_line LIMIT 10",
        "find_def_fallback": f"WITH {V.SYM} SELECT name, kind, file, start_line, language FROM sym WHERE contains(lower(name), '{TYPE_LIKE}') AND (name = '{TYPE_LIKE}' OR NOT EXISTS (SELECT 1 FROM sym WHERE name = '{TYPE_LIKE}')) ORDER BY file, start_line, name LIMIT 50",
        "find_def_filtered": f"WITH {V.SYM} SELECT name, kind, file, start_line, language FROM sym WHERE name = 'run' AND language = 'go' AND kind = 'function' ORDER BY file, start_line LIMIT 10",
        "find_callers": f"WITH {V.CALLS} SELECT * FROM calls WHERE callee = '{CALLEE}' ORDER BY caller_file, caller_line, edge_id LIMIT 25",
        "find_callers_prefix": f"WITH {V.CALLS} SELECT * FROM calls WHERE callee = '{CALLEE}' AND starts_with(caller_file, 'ledgerlake/') ORDER BY caller_file, caller_line, edge_id LIMIT 200",
        "find_refs": f"WITH {V.REFS}, t AS (SELECT callee FROM refs GROUP BY callee ORDER BY count(*) DESC, callee LIMIT 1) SELECT refs.* FROM refs JOIN t USING (callee) ORDER BY caller_file, caller_line, ref_id LIMIT 25",
        "find_refs_kinds": f"WITH {V.REFS}, t AS (SELECT callee FROM refs WHERE kind = 'embed' GROUP BY callee ORDER BY count(*) DESC, callee LIMIT 1) SELECT refs.* FROM refs JOIN t USING (callee) WHERE kind = 'embed' ORDER BY caller_file, caller_line, ref_id LIMIT 200",
        "tests_for": f"""WITH {V.SYM}, {V.CALLS}, s AS (SELECT * REPLACE ({_renamed('file')} AS file, {_TEST_SQL.format(n='name')} AS name) FROM sym), e AS (SELECT {_renamed('caller_file')} AS file, {_TEST_SQL.format(n='caller')} AS name FROM calls WHERE callee = '{CALLEE}'),
            one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY start_line, kind) = 1),
            a AS (SELECT file, start_line, name, 'calls' AS reason FROM one WHERE (name, file) IN (SELECT (name, file) FROM e WHERE {V.IS_TEST_FILE.format(f='file')})
            UNION ALL SELECT file, start_line, name, 'name_match' FROM s WHERE kind IN ('function', 'method') AND CASE language WHEN 'rs' THEN regexp_matches(name, '^(test_|Test)') ELSE {V.IS_TEST_FILE.format(f='file')} AND CASE language WHEN 'go' THEN starts_with(name, 'Test') WHEN 'py' THEN true WHEN 'ts' THEN true WHEN 'js' THEN true ELSE true END END
              AND contains(lower(regexp_replace(name, '^(Test|test_|test|Benchmark|benchmark|Example|Fuzz)', '')), lower('{CALLEE}')))
            SELECT file, start_line, min(name) AS name, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM a GROUP BY file, start_line ORDER BY count(DISTINCT reason) DESC, file, start_line LIMIT 200""",
        "test_files": f"""WITH f AS (SELECT DISTINCT path FROM source_files WHERE path LIKE '%/%'), x AS (SELECT u.k AS form, replace(replace(u.t, '{{d}}', regexp_replace(path, '/[^/]*$', '')), '{{s}}', regexp_replace(regexp_extract(path, '[^/]*$'), '\\..*$', '')) AS file FROM f, (VALUES {', '.join(f"({k}, '{x}')" for k, x in enumerate(_FORMS))}) AS u(k, t))
            SELECT CAST(form AS INTEGER) AS form, count(*) FILTER ({V.IS_TEST_FILE.format(f='file')}) AS tests, count(*) AS n FROM x GROUP BY form""",
        "test_symbols": f"""WITH {V.SYM}, t AS (SELECT *, 'src/test/' || file AS f FROM sym)
            SELECT language, kind IN ('function', 'method') AND CASE WHEN language = 'rs' THEN regexp_matches(name, '^(test_|Test)') ELSE {V.IS_TEST_FILE.format(f='f')} AND
              CASE WHEN language = 'go' THEN regexp_matches(name, '^(Test|Benchmark|Example|Fuzz)') WHEN language = 'py' THEN regexp_matches(name, '^(test_|Test)') WHEN language IN ('ts', 'tsx', 'js', 'jsx') THEN true
              WHEN language IN ('java', 'kt') THEN regexp_matches(name, '^(test|Test)') ELSE starts_with(lower(name), 'test') END END AS is_test,
              contains(lower(regexp_replace(name, '^(Test|test_|test|Benchmark|benchmark|Example|Fuzz)', '')), 'harbor') AS matches, count(*) AS n FROM t GROUP BY ALL""",
        "summary_limit_then_sort": f"WITH {V.SYM}, c AS (SELECT * FROM sym WHERE starts_with(file, 'ledgerlake/') ORDER BY lpad(CAST(start_line AS VARCHAR), 8, '0') || file || name LIMIT 50) SELECT name, kind, file, start_line, end_line FROM c",
        "search_symbols": f"WITH {V.SYM}, {_BAG}, {_score('bag', SYMBOL_QUERY.split())} SELECT file, start_line, name, kind, score FROM scored JOIN bag USING (id) ORDER BY score DESC, file, start_line, name LIMIT 10",
        "search_symbols_filtered": f"WITH {V.SYM}, {_BAG}, {_score('bag', SYMBOL_QUERY.split())}, t AS (SELECT file, start_line, name, kind, language, score FROM scored JOIN bag USING (id) ORDER BY score DESC, file, start_line, name LIMIT 80) SELECT file, start_line, name, kind, score FROM t WHERE language = 'go' AND kind = 'function' ORDER BY score DESC, file, start_line, name LIMIT 20",
        "grep_body": f"WITH {V.SYM}, {V.FILES}, {_BODY}, {_matches('wrapErr\\(')} SELECT file, start_line, name, count(*) AS n, min(line) AS first_line FROM h WHERE rn <= 20 GROUP BY ALL",
        "grep_body_capped": f"WITH {V.SYM}, {V.FILES}, {_BODY}, {_matches('wrapErr\\(', "file LIKE '%.go'")} SELECT file, start_line, name, kind, line, CAST(col AS INTEGER) AS col, {_SNIP} AS snippet FROM h WHERE rn = 1 ORDER BY file, start_line, name LIMIT 200",
        "grep_literal": f"WITH {V.SYM}, {V.FILES}, {_BODY}, {_matches(', ', "file LIKE '%.go'")} SELECT file, start_line, name, kind, line, CAST(col AS INTEGER) AS col, {_SNIP} AS snippet FROM h WHERE rn <= 20 ORDER BY file, start_line, name, rn LIMIT 200",
        "grep_truncated": f"""WITH {V.SYM}, {V.FILES}, {_BODY}, {_matches('wrapErr\\(')}, l AS (SELECT * FROM h WHERE rn <= 20 ORDER BY file, start_line, name, rn LIMIT 25)
            SELECT count(*) AS count, coalesce(count(*) >= 25 AND (SELECT max((file, start_line, name)) FROM sym) > max((file, start_line, name)), false) AS truncated FROM l""",
        "literal_first_hit": f"WITH {V.SYM}, {V.FILES}, {_BODY} SELECT file, start_line, name, min(line) AS line FROM body WHERE contains(text, 'total -= ') GROUP BY ALL",
        "enclosing_symbol": f"""WITH {V.SYM}, {V.CALLS}, c AS (SELECT DISTINCT caller_file AS file, caller_line AS line FROM calls)
            SELECT c.file, c.line, coalesce(name, '<file>') AS caller FROM c LEFT JOIN sym ON sym.file = c.file AND c.line BETWEEN start_line AND end_line QUALIFY row_number() OVER (PARTITION BY c.file, c.line ORDER BY start_line DESC, end_line, name DESC) = 1""",
        "offset_to_line": f"WITH {V.FILES}, f AS (SELECT path, substring(content, 1, instr(content, 'wrapErr(') - 1) AS b FROM files WHERE contains(content, 'wrapErr(')) SELECT path, CAST(strlen(b) AS BIGINT) AS \"offset\", CAST(length(b) - length(replace(b, chr(10), '')) + 1 AS INTEGER) AS line FROM f",
        "read_chunk": f"WITH {V.FILES}, f AS (SELECT * FROM files ORDER BY path LIMIT 1) SELECT path AS file, CAST(2 + i AS INTEGER) AS line, l[2 + i] AS text FROM (SELECT path, string_split(content, chr(10)) AS l FROM f), unnest(range(1, 39)) AS u(i) WHERE 2 + i <= len(l)",
        "alternative_bytes": f"WITH {V.FILES}, {V.CALLS} SELECT count(*) AS n_files, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT path, length FROM files WHERE path IN (SELECT caller_file FROM calls WHERE callee = '{CALLEE}'))",
        "count_by_language": f"WITH {V.SYM} SELECT language, count(*) AS n FROM sym GROUP BY language",
        "count_by_kind": f"WITH {V.SYM} SELECT kind, count(*) AS n FROM sym GROUP BY kind",
        "file_count": f"WITH {V.SYM} SELECT count(DISTINCT file) AS n_files FROM sym",
    }
