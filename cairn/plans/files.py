"""Queries: sources and sinks on files.  The tables' texts are written as files to the shared folder first and read back by the sources."""

from __future__ import annotations

import datetime as dt
import json
import os
from dataclasses import asdict
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import config
from cairn.functions import text as T
from cairn.operators import embed, extract, graph, vector
from cairn.operators.lineage import shared_folder
from cairn.plans import records as R
from cairn.plans import views as V
from cairn.sources import files as S
from cairn.sources import sinks
from cairn.sources.tables import table


def local_folder(spark: SparkSession, name: str) -> str:
    """A fresh shared folder as a path of the file system; the folder has to be mounted on all executors."""
    url = urlparse(shared_folder(spark, name))
    if url.scheme not in ("", "file"):
        raise RuntimeError("files can be written one by one to a mounted folder only")
    return url.path


def write_files(df: DataFrame, folder: str) -> str:
    """Each row of (path, content) as a file below ``folder``, by the executors."""

    def put(rows) -> None:
        for r in rows:
            if r.path.startswith("/") or ".." in r.path.split("/"):
                continue
            at = os.path.join(folder, r.path)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w", encoding="utf-8", newline="") as f:
                f.write(r.content or "")

    os.makedirs(folder, exist_ok=True)
    df.select("path", "content").foreachPartition(put)
    return folder


def _tree(spark, d) -> str:
    """Sources as they are, and every fifth of them once more in a folder that scans leave out, hidden or with another extension."""
    f = V.files(spark, d).select("path", "content")
    n = F.length("path")
    odd = F.concat(F.substring_index("path", "/", 1), F.element_at(F.array(*map(F.lit, ("/build/", "/.hidden/", "/note/"))), (n % 3 + 1).cast("int")), F.substring_index("path", "/", -1), F.when(n % 3 == 2, ".txt").otherwise(""))
    both = f.withColumn("path", F.explode(F.when(n % 5 == 0, F.array("path", odd)).otherwise(F.array("path"))))
    return write_files(both, local_folder(spark, "tree"))


def repo_scan(spark, d):
    """The source files that a scan of the tree finds, with digests of what it reads."""
    return S.scan_repo(spark, _tree(spark, d)).select("path", "language", "length", F.sha2("content", 256).alias("digest"))


def staged_scan(spark, d):
    """A scan of named files only, as a hook on staged files has it: every other one."""
    root = _tree(spark, d)
    some = [f"{root}/{r.path}" for r in V.file_sizes(spark, d).where(F.length("path") % 40 == 0).orderBy("path").select("path").toLocalIterator()]
    return S.scan_repo(spark, root, some).select("path", "length") if some else S.scan_repo(spark, root).select("path", "length").where("false")


def scan_to_graph(spark, d):
    """A compile from files to tables and one JSON document, and what that holds when it is read again."""
    g = extract.extract_all(S.scan_repo(spark, _tree(spark, d)))
    folder = shared_folder(spark, "index")
    sinks.write_index(g, folder, "repo", "2024-01-01T00:00:00Z")
    back = S.read_index(spark, folder, lines=True)
    return back["symbols"].groupBy("language", "kind").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


def raw_corpus(spark, d):
    """Number and bytes of the text files of the tree; contents are not read."""
    return S.scan_text(spark, _tree(spark, d)).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def raw_blob(spark, d):
    """The first 20,000 characters of all sources, each under its header."""
    return S.text_blob(V.files(spark, d).where("content is not null"), 20_000).select(F.sha2("blob", 256).alias("digest"), F.length("blob").alias("n"))


def wiki_scan(spark, d):
    """The pages of a wiki on disk that rules apply to."""
    root = write_files(V.pages(spark, d).select("path", F.col("body").alias("content")), local_folder(spark, "wiki"))
    return S.scan_pages(spark, root).select("path", "slug", F.sha2("body", 256).alias("digest"))


def git_log(spark, d):
    """Commits written as an exported log, with malformed records between, and read back."""
    c = R._commits(spark, d)
    lines = c.select(F.concat("sha", F.lit("|"), F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("|"), "subject", F.lit("\n"), "body", F.lit("\n" + S.LOG_SEPARATOR + "\nbroken record" + S.LOG_SEPARATOR)).alias("value"))
    folder = shared_folder(spark, "log")
    lines.write.text(folder)
    return S.read_commits(spark, folder).select("sha", F.date_format("date", "yyyy-MM-dd").alias("day"), "subject", "body")


def pr_dump(spark, d):
    """Pull requests written as JSON and read back from a day on: the latest 500."""
    p = R._prs(spark, d).select("number", "title", "body", F.date_format("merged_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mergedAt"), "labels")
    folder = shared_folder(spark, "prs")
    p.write.json(folder)
    return S.read_prs(spark, folder, dt.datetime(1997, 1, 1), limit=500).select("number", "title", F.col("labels")[0]["name"].alias("label"))


def questions(spark, d):
    """A list of questions with comments and blank lines: one a file name."""
    names = V.file_sizes(spark, d).orderBy("path").select("path")
    lines = names.select(F.concat(F.when(F.length("path") % 7 == 0, "# ").when(F.length("path") % 7 == 1, "   ").otherwise("What is "), F.when(F.length("path") % 7 == 1, "").otherwise(F.col("path"))).alias("value"))
    folder = local_folder(spark, "questions")
    write_files(lines.agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("content")).withColumn("path", F.lit("q.txt")), folder)
    return S.read_questions(spark, f"{folder}/q.txt")


def vector_store(spark, d):
    """Pages embedded, stored, read back and searched."""
    p = V.pages(spark, d).select(F.col("path").alias("key"), T.strip_front_matter("body").alias("text"))
    folder = shared_folder(spark, "vectors")
    sinks.write_vectors(embed.embed(p, "key", "text", embed.HashEmbedder(32)), folder)
    back = S.read_vectors(spark, folder, "local", "hashed-words")
    return back.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"), F.countDistinct("provider", "model").alias("models"))


def config_merge(spark, d):
    """Settings merged from a file: scalars and lists that count, nulls and unknown keys that do not."""
    folder = local_folder(spark, "config")
    os.makedirs(folder, exist_ok=True)
    at = os.path.join(folder, "c.json")
    with open(at, "w") as f:
        json.dump({"name": "", "skip_names": [], "repo_prefixes": ["a/", "b/"], "status_values": None, "kept": {"x": 1}}, f)
    config.save(at, {"pipelines": {"narrative": "caveman"}, "repo_prefixes": None})
    c = asdict(config.load(at))
    kept = json.load(open(at))
    rows = [(k, json.dumps(c[k])) for k in ("name", "skip_names", "repo_prefixes", "pipelines", "schema_version")] + [("kept", json.dumps(kept.get("kept")))]
    return spark.createDataFrame(rows, "key string, value string")


def created_pages(spark, d):
    """Pages created where there is none, log blocks appended once, however often it runs: what is there after two runs."""
    pages, blocks, folder = R.commit_pages(spark, d), R.log_blocks(spark, d), shared_folder(spark, "created")
    for _ in range(2):
        sinks.create_pages(pages, f"{folder}/pages")
        sinks.append_log(blocks, f"{folder}/log", "sha")
    read = lambda x: spark.read.parquet(f"{folder}/{x}")
    return read("pages").agg(F.lit("pages").alias("what"), F.count("*").alias("n")).unionByName(read("log").agg(F.lit("log").alias("what"), F.count("*").alias("n")))


def safe_paths(spark, d):
    """Which paths stay within the root: each path in four spellings."""
    p = table(spark, d, "source_files").where("path is not null").select("path").distinct()
    forms = F.array(F.col("path"), F.concat(F.lit("/"), "path"), F.concat(F.lit("../"), "path"), F.concat(F.lit("a/../"), "path"))
    return p.select(F.posexplode(forms).alias("form", "p")).groupBy("form").agg(F.count_if(graph.within_root(F.col("p"))).alias("safe"), F.count("*").alias("n"))


def meta_check(spark, d):
    """Page records written as JSON twice, by slug: whether both are the same, and whether a changed record is seen."""
    from cairn.plans import wiki as W

    folder, records = shared_folder(spark, "meta"), W.page_meta(spark, d).orderBy("slug", "title")
    for k in (1, 2):
        sinks.write_json_lines(records, f"{folder}/{k}")
    sinks.write_json_lines(records.withColumn("status", F.concat("status", F.lit("?"))), f"{folder}/3")
    read = lambda k: spark.read.text(f"{folder}/{k}")
    return read(1).agg(F.count("*").alias("n")).select("n", F.lit(sinks.same_rows(read(1), read(2))).alias("same"), F.lit(sinks.same_rows(read(1), read(3))).alias("changed_is_same"))


_QUERIES = (meta_check, repo_scan, staged_scan, scan_to_graph, raw_corpus, raw_blob, wiki_scan, git_log, pr_dump, questions, vector_store, config_merge, created_pages, safe_paths)


def queries():
    return {f.__name__: f for f in _QUERIES}


_TREE = f"""{V.FILES}, f AS (SELECT path, content FROM files WHERE content IS NOT NULL OR true),
tree AS (SELECT path, coalesce(content, '') AS content FROM f UNION ALL SELECT split_part(path, '/', 1) || ['/build/', '/.hidden/', '/note/'][length(path) % 3 + 1] || regexp_extract(path, '[^/]*$') || CASE length(path) % 3 WHEN 2 THEN '.txt' ELSE '' END, coalesce(content, '') FROM f WHERE length(path) % 5 = 0)"""
_skip = ",".join(f"'{x}'" for x in S.SKIP_DIRS)
_LANGUAGE = f"CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) {' '.join(f"WHEN '{e}' THEN '{t}'" for e, t in T.LANGUAGES.items())} ELSE '' END"
_SCAN = f"{_TREE}, sc AS (SELECT DISTINCT path, {_LANGUAGE} AS language, content FROM tree WHERE {_LANGUAGE} <> '' AND strlen(content) <= 1048576 AND len(list_filter(string_split(path, '/')[:-2], lambda x: x IN ({_skip}) OR starts_with(x, '.'))) = 0)"


def oracle_sql():
    from cairn.plans import extracted as X
    from cairn.plans import wiki as W

    text = ",".join(f"'{x}'" for x in S.TEXT_EXTENSIONS)
    qs = "CASE WHEN length(path) % 7 = 0 THEN '# ' || path WHEN length(path) % 7 = 1 THEN '   ' ELSE 'What is ' || path END"
    return {
        "meta_check": f"WITH {W._P} SELECT count(*) AS n, true AS same, false AS changed_is_same FROM pg",
        "repo_scan": f"WITH {_SCAN} SELECT path, language, CAST(strlen(content) AS BIGINT) AS length, sha256(content) AS digest FROM sc",
        "staged_scan": f"WITH {_SCAN} SELECT path, CAST(strlen(content) AS BIGINT) AS length FROM sc WHERE length(path) % 40 = 0 AND path IN (SELECT path FROM files)",
        "scan_to_graph": f"WITH {X._SYMBOLS} SELECT language, kind, count(*) AS n, count(DISTINCT file) AS files FROM all_s WHERE len(list_filter(string_split(file, '/')[:-2], lambda x: x IN ({_skip}) OR starts_with(x, '.'))) = 0 GROUP BY ALL",
        "raw_corpus": f"WITH {_TREE} SELECT count(*) AS n, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM (SELECT DISTINCT * FROM tree) WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ({text}) AND NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'vendor']) AND NOT contains(path, '/.hidden/')",
        "raw_blob": f"WITH {V.FILES}, b AS (SELECT substring(string_agg('=== ' || path || ' ===' || chr(10) || content || chr(10), '' ORDER BY path), 1, 20000) AS blob FROM files WHERE content IS NOT NULL) SELECT sha256(blob) AS digest, CAST(length(blob) AS INTEGER) AS n FROM b",
        "wiki_scan": f"WITH {W._P} SELECT path, regexp_replace(fname, '\\.md$', '') AS slug, sha256(body) AS digest FROM pg",
        "git_log": f"WITH {R._COMMITS} SELECT sha, strftime(dt, '%Y-%m-%d') AS day, s AS subject, b AS body FROM cm",
        "pr_dump": f"WITH {R._PRS} SELECT number, title, lbl AS label FROM (SELECT o_orderkey AS number, {R._SUBJECT} AS title, coalesce({R._LABEL}, 'other') AS lbl, o_orderdate AS m FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY m DESC, number LIMIT 500)",
        "questions": f"WITH {V.FILES}, l AS (SELECT {qs} AS v FROM (SELECT DISTINCT path, length FROM files)), n AS (SELECT v, row_number() OVER (ORDER BY v) AS k FROM l) SELECT 'q' || k AS id, trim(v) AS text FROM n WHERE trim(v) <> '' AND NOT starts_with(trim(v), '#')",
        "vector_store": f"WITH {V.PAGES} SELECT count(*) AS n, 32 AS least, 32 AS most, 1 AS models FROM pages",
        "config_merge": """SELECT * FROM (VALUES ('name', '"wiki"'), ('skip_names', '[]'), ('repo_prefixes', '[]'), ('pipelines', '{"narrative": "caveman"}'), ('schema_version', '1'), ('kept', '{"x": 1}')) AS t(key, value)""",
        "created_pages": f"""WITH {R._COMMITS}, b AS (SELECT DISTINCT sha FROM cm WHERE {R._BREAK.format(t='s', b='b')} OR {R._bumped('s')}), p AS (SELECT DISTINCT path FROM ({R.oracle_sql()['commit_pages']}))
            SELECT 'pages' AS what, count(*) AS n FROM p UNION ALL SELECT 'log', count(*) FROM b""",
        "safe_paths": "WITH p AS (SELECT DISTINCT path FROM source_files WHERE path IS NOT NULL) SELECT CAST(k AS INTEGER) AS form, CASE WHEN k IN (0, 3) THEN count(*) ELSE 0 END AS safe, count(*) AS n FROM p, (VALUES (0), (1), (2), (3)) AS u(k) GROUP BY k",
    }
