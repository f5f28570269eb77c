"""Queries: commits and pull requests, prompts, sync, receipts.  Commits, pull requests and calls are derived from the star-schema tables."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import bm25
from cairn.operators import context as C
from cairn.operators import ingest as I
from cairn.operators.lineage import stage
from cairn.plans import search as S
from cairn.plans import views as V
from cairn.sources.tables import table

_SUBJECTS = ["feat: add the harbor view", "feat(api)!: drop the old route", "fix: outage of the ledger after restart", "docs: architecture of the tide log", "chore: bump serde from 1.9.0 to v2.0.1", "chore: bump serde from 1.9.0 to 1.9.1", "hotfix for ADR_12 trade-off: quota Table", "refactor: post-mortem notes, bump x from 3.1 to 4.0"]
_BODIES = ["", "BREAKING CHANGE: all readers", "an outage is only named here", "## What happened\n\nthe disk was full", "### Trade-offs\n\nnone", "## Migration\n\nrun it twice", "text\nBREAKING: late footer"]
_LABELS = ["bug", "Breaking-Change", "postmortem", "design", "none"]
_pick = lambda xs, e: "CASE " + " ".join(f"WHEN {e} = {i} THEN '{x}'" for i, x in enumerate(xs)) + " END"
_SUBJECT, _BODY, _LABEL = _pick(_SUBJECTS, f"o_orderkey % {len(_SUBJECTS)}"), _pick(_BODIES, f"o_orderkey % {len(_BODIES)}"), _pick(_LABELS, "o_custkey % 11")


def _commits(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha"), F.col("o_orderdate").alias("date"), F.concat(F.expr(_SUBJECT), F.lit(" "), F.col("o_orderkey").cast("string")).alias("subject"), F.expr(_BODY).alias("body"))


def _prs(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("number"), F.expr(_SUBJECT).alias("title"), F.expr(_BODY).alias("body"), F.col("o_orderdate").alias("merged_at"), F.array(F.struct(F.coalesce(F.expr(_LABEL), F.lit("other")).alias("name"))).alias("labels"))


def classify_commits(spark, d):
    return I.classify_commits(_commits(spark, d))


def log_blocks(spark, d):
    return I.log_blocks(_commits(spark, d))


def classify_prs(spark, d):
    return I.classify_prs(_prs(spark, d)).select("number", "class")


def route_actions(spark, d):
    seen = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("number"))
    return I.route_prs(I.classify_prs(_prs(spark, d)), seen)


def _pr_pages(spark, d):
    """Pages that earlier runs wrote: one for every fifth pull request, in two folders, and some elsewhere that do not count."""
    folder = F.when(F.col("o_orderkey") % 2 == 0, "wiki/decisions/").when(F.col("o_orderkey") % 15 == 0, "wiki/notes/").otherwise("wiki/investigations/")
    return table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.concat(folder, F.lit("p"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("---\nstatus: current\npr_number: "), F.col("o_orderkey").cast("string"), F.lit("\n---\n\n# Page\n\nSee pr_number: 7 in prose.\n")).alias("body"))


def dedupe_existing_prs(spark, d):
    return I.insert_if_absent(_prs(spark, d).select("number", "title"), I.page_numbers(_pr_pages(spark, d)), "number")


def commit_pages(spark, d):
    return I.commit_pages(_commits(spark, d))


def pr_outputs(spark, d):
    """The log blocks and pages of pull requests that have no page yet."""
    prs = _prs(spark, d).withColumn("url", F.concat(F.lit("https://example.org/pull/"), F.col("number").cast("string"))).withColumn("author", F.struct(F.concat(F.lit("u"), (F.col("number") % 7).cast("string")).alias("login")))
    routed = I.route_prs(I.classify_prs(prs), I.page_numbers(_pr_pages(spark, d)))
    return I.pr_outputs(routed, prs.select("number", "title", "body", "merged_at", "url", "author"))


def valid_repos(spark, d):
    """Which of some spellings of OWNER/NAME, one made from each path, are valid."""
    p = table(spark, d, "source_files").where("path is not null").select("path").distinct()
    name = F.when(F.length("path") % 3 == 0, F.col("path")).when(F.length("path") % 3 == 1, F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")).otherwise(F.concat(F.substring_index("path", "/", 1), F.lit(" /x")))
    return p.select(name.alias("repo")).groupBy("repo").agg(F.max(I.valid_repo(F.col("repo"))).alias("valid"))


def imported_pages(spark, d):
    """Wiki bodies as documents to import: the pages made of them."""
    p = V.pages(spark, d)
    return p.select("path", I.imported_page(F.col("path"), F.col("body"), "repo").alias("page"))


def text_helpers(spark, d):
    """Sizes for readers, ratios, titles from paths and quotes, of every file that is there."""
    f = V.file_sizes(spark, d)
    return f.select("path", I.human_bytes(F.col("length") * 613).alias("size"), F.round(I.safe_inverse(F.col("length") - 900), 9).alias("inverse"), I.humanized(F.col("path")).alias("title"), I.indent_quote(F.concat(F.lit(" "), F.replace("path", F.lit("/"), F.lit("\n")))).alias("quote"))


def since_filter(spark, d):
    cut = I.parse_since("400d", dt.datetime(1998, 8, 2))
    return _prs(spark, d).where(F.col("merged_at") >= F.lit(cut).cast("timestamp_ntz")).groupBy(F.date_format("merged_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def major_bump(spark, d):
    return _prs(spark, d).groupBy("title").agg(F.max(I.major_bumped(F.col("title"))).alias("bumped"))


def slugify(spark, d):
    return _prs(spark, d).select(T.slugify(T.first_words("title", 6)).alias("slug")).distinct()


def _prompts(spark, d):
    return table(spark, d, "documents").where("doc_id is not null and text is not null").select(F.col("doc_id").alias("prompt_id"), "text")


def prompt_identifiers(spark, d):
    return _prompts(spark, d).select("prompt_id", C.prompt_identifiers(F.col("text")).alias("idents"))


def prompt_quoted(spark, d):
    return _prompts(spark, d).select("prompt_id", C.prompt_quoted(F.col("text")).alias("quoted")).where(F.size("quoted") > 0)


def _code_prompts(spark, d):
    """Source files as prompts: they name symbols."""
    return V.files(spark, d).select(F.col("path").alias("prompt_id"), F.col("content").alias("text"))


def prompt_context(spark, d):
    return C.name_hits(_code_prompts(spark, d), V.symbols(spark, d))


def _asked(spark, d):
    """The held-out texts as prompts, with quoted texts added to each so that bodies are searched."""
    q = F.element_at(F.array(*map(F.lit, ("wrapErr(", "return nil", "defer "))), (F.col("item_id") % 3 + 1).cast("int"))
    return table(spark, d, "eval_items").where("item_id is not null and text is not null").groupBy("item_id").agg(F.max("text").alias("text")).select(F.col("item_id").alias("prompt_id"), F.concat("text", F.lit(" \"total -= \" '"), q, F.lit("'")).alias("text"))


def _evidence(spark, d):
    return C.evidence(_asked(spark, d), V.symbols(spark, d), V.files(spark, d))


def context_hits(spark, d):
    """The evidence of each prompt: ranked symbols, symbols by name, quoted texts in bodies."""
    return _evidence(spark, d).select("prompt_id", "section", "pos", "rn", "label", "file", "start_line", "name", "score", "line", "snippet")


def symtab_codes(spark, d):
    """Codes of symbols by first appearance over the three sections."""
    return C.symbol_codes(_evidence(spark, d))


def codec_ab(spark, d):
    """What the compact report saves over the full one, per prompt, then mean, least and most."""
    hits, asked = stage(_evidence(spark, d), "evidence"), _asked(spark, d)
    full = C.report(asked, hits, compact=False, max_bytes=1 << 30).select("prompt_id", F.octet_length("report").alias("full_bytes"))
    short = C.report(asked, hits, max_bytes=1 << 30).select("prompt_id", F.octet_length("report").alias("short_bytes"))
    pct = F.round((1 - F.try_divide(F.col("short_bytes"), F.col("full_bytes"))) * 100, 4)
    return full.join(short, "prompt_id").where("full_bytes > 0").select(pct.alias("pct")).agg(F.count("*").alias("n"), F.round(F.avg("pct"), 4).alias("mean"), F.min("pct").alias("least"), F.max("pct").alias("most"))


def prompt_report(spark, d):
    """Compact reports of at most 8,000 bytes."""
    return C.report(_asked(spark, d), stage(_evidence(spark, d), "evidence"))


def _sync(spark, d):
    docs = table(spark, d, "documents").where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    body = F.when(F.col("doc_id") % 4 == 1, F.concat(F.col("text"), F.lit(" old"))).otherwise(F.col("text"))
    source = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), F.col("text").alias("body"))
    existing = docs.where("doc_id % 4 <> 0").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"), body.alias("body"), F.sha2(F.when(F.col("doc_id") % 4 == 2, F.lit("other")).otherwise(body), 256).alias("stored_hash"))
    return source, existing


def sync_upsert(spark, d):
    return I.upsert(*_sync(spark, d)).select("slug", "action", F.sha2("body", 256).alias("body_hash"))


def insert_if_absent(spark, d):
    source, existing = _sync(spark, d)
    return I.insert_if_absent(source, existing, "slug").select("slug", F.length("body").alias("n"))


def replace_by_key(spark, d):
    """Edges of files that were seen again in the second half of the year replace the older edges of these files."""
    e = V.call_edges(spark, d).join(table(spark, d, "call_edges").groupBy("edge_id").agg(F.max("seen_at").alias("seen_at")), "edge_id")
    cut = F.lit("2024-07-01").cast("timestamp_ntz")
    old, new = e.where(F.col("seen_at") < cut).drop("seen_at"), e.where(F.col("seen_at") >= cut).drop("seen_at")
    return I.replace_by_key(old, new, "caller_file")


def except_stale(spark, d):
    """Paths that were there once and are gone."""
    f = table(spark, d, "source_files")
    return f.where("path is not null").select("path").subtract(f.where("removed_at is null").select("path"))


def _calls(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("tool"), F.floor(F.abs("value") * 10).cast("bigint").alias("returned"), (F.get_json_object("props", "$.k").cast("bigint") * 1000).alias("alternative"))


def session_stats(spark, d):
    return I.receipts(_calls(spark, d))


def stats_by_tool(spark, d):
    return I.receipts(_calls(spark, d), ["tool"])


def wiki_vs_raw(spark, d):
    """Characters and tokens per mode: what pages and what all their sources would cost."""
    p = V.pages(spark, d).select(F.lit("wiki").alias("mode"), F.octet_length("body").alias("chars"))
    r = V.files(spark, d).select(F.lit("raw").alias("mode"), F.octet_length("content").alias("chars"))
    return p.unionByName(r).groupBy("mode").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum(F.floor(F.col("chars") / 4)).alias("tokens"))


#: What a bench of the wiki asks.
QUESTIONS = ("how does the cache keep a page", "what does the scheduler do with a broken checkpoint", "which router locks the envelope under load")


def question_tokens(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if len(w.encode()) >= 2 and w not in T.PROSE_STOPWORDS]


def wiki_vs_raw_questions(spark, d, k: int = 5):
    """For each question of a bench what the best pages cost, by title, slug and snippet, against reading all sources; tokens are bytes / 4."""
    asked = spark.createDataFrame([(i, question_tokens(q)) for i, q in enumerate(QUESTIONS)], "qid int, terms array<string>")
    p = V.pages(spark, d).withColumn("plain", T.strip_front_matter("body"))
    best = bm25.score_queries(bm25.tokenized(p, "path", T.prose_tokens("plain")), asked, k)
    hits = p.join(best, p["path"] == best["id"]).join(asked, "qid")  # a few pages a question
    cost = F.octet_length(T.first_heading("plain")) + F.octet_length("slug") + F.octet_length(T.snippet("plain", F.col("terms")))
    wiki = asked.select("qid").join(hits.groupBy("qid").agg(F.sum(cost.cast("bigint")).alias("chars")), "qid", "left").select("qid", F.lit("wiki").alias("mode"), F.coalesce("chars", F.lit(0)).alias("chars"))
    raw = asked.select("qid").crossJoin(F.broadcast(V.file_sizes(spark, d).agg(F.sum("length").alias("chars")))).select("qid", F.lit("raw").alias("mode"), F.coalesce("chars", F.lit(0)).alias("chars"))
    both = wiki.unionByName(raw).withColumn("tokens", F.floor(F.col("chars") / 4))
    total = both.groupBy("mode").agg(F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens")).select(F.lit(-1).alias("qid"), "mode", "chars", "tokens")
    return both.unionByName(total)


def avg_confidence(spark, d):
    said = F.concat(F.lit("Answer. Confidence: "), (F.col("event_id") % 8).cast("string"), F.lit("/5"))
    c = table(spark, d, "events").select("event_type", I.confidence(said).alias("c"))
    return c.groupBy("event_type").agg(F.round(F.coalesce(F.avg(F.nullif("c", F.lit(0))), F.lit(0.0)), 6).alias("mean"))


_QUERIES = (
    classify_commits, log_blocks, classify_prs, route_actions, dedupe_existing_prs, commit_pages, pr_outputs, valid_repos, imported_pages, text_helpers, since_filter, major_bump, slugify, prompt_identifiers, prompt_quoted, prompt_context,
    context_hits, symtab_codes, codec_ab, prompt_report, sync_upsert, insert_if_absent, replace_by_key, except_stale, session_stats, stats_by_tool, wiki_vs_raw, wiki_vs_raw_questions, avg_confidence,
)


def queries():
    return {f.__name__: f for f in _QUERIES}


_BUMP = "(?i)\\bbump\\s+\\S+\\s+from\\s+(\\S+)\\s+to\\s+(\\S+)"
_bumped = lambda x: f"(regexp_extract({x}, '{_BUMP}', 1) <> '' AND split_part(regexp_replace(regexp_extract({x}, '{_BUMP}', 1), '^v', ''), '.', 1) <> split_part(regexp_replace(regexp_extract({x}, '{_BUMP}', 2), '^v', ''), '.', 1))"
_words = lambda x, n: f"array_to_string(regexp_split_to_array(trim({x}), '\\s+')[1:{n}], ' ')"
_slug = lambda x: f"coalesce(nullif(regexp_replace(regexp_replace(replace(lower({x}), '_', '-'), '[^a-z0-9-]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled')"
_short = lambda x, n: f"(SELECT CASE WHEN strlen(z) > {n} THEN substring(z, 1, len(list_filter(range(1, length(z) + 1), lambda k: strlen(substring(z, 1, k)) <= {n - 1}))) || '…' ELSE z END FROM (SELECT trim({x}, ' ' || chr(9) || chr(10) || chr(13)) AS z))"
_WS = "' ' || chr(9) || chr(13)"
_IMPORTED = f"""WITH {V.PAGES}, a AS (SELECT path, regexp_replace(regexp_replace(body, '^---\\n(.|\\n)*?\\n---\\n', ''), '^\\n+', '') AS t FROM pages),
b AS (SELECT path, string_split(t, chr(10)) AS l FROM a), c AS (SELECT *, list_position(list_transform(l, lambda x: starts_with(x, '# ')), true) AS i FROM b),
d AS (SELECT path, CASE WHEN i IS NOT NULL THEN trim(substring(l[i], 3)) ELSE '' END AS heading, CASE WHEN i IS NULL THEN l ELSE list_concat(l[:i - 1], list_slice(l, i + coalesce(list_position(list_transform(l[i + 1:], lambda x: trim(x, {_WS}) <> ''), true), len(l) - i + 1), len(l))) END AS l FROM c),
e AS (SELECT *, list_filter(range(1, len(l) + 1), lambda k: trim(l[k], {_WS}) <> '')[1:5] AS five FROM d), g AS (SELECT *, list_filter(five, lambda k: starts_with(l[k], '> '))[1] AS i FROM e),
h AS (SELECT path, heading, CASE WHEN i IS NOT NULL THEN trim(substring(l[i], 3)) ELSE '' END AS said, CASE WHEN i IS NULL THEN l ELSE list_concat(l[:i - 1], list_slice(l, i + coalesce(list_position(list_transform(l[i + 1:], lambda x: trim(x, {_WS}) <> ''), true), len(l) - i + 1), len(l))) END AS l FROM g),
m AS (SELECT *, array_to_string(l, chr(10)) AS body, list_filter(list_transform(l, lambda x: trim(x, {_WS})), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|```|\\|)'))[1] AS prose FROM h),
n AS (SELECT *, coalesce(nullif(regexp_extract(prose, '^([^.!?]{{21,}}[.!?])', 1), ''), prose) AS s FROM m),
o AS (SELECT *, coalesce(nullif(said, ''), CASE WHEN strlen(s) > 200 THEN substring(s, 1, len(list_filter(range(1, length(s) + 1), lambda k: strlen(substring(s, 1, k)) <= 197))) || '…' ELSE s END, 'Imported from repo/' || path || ' — review and edit') AS summary,
  replace(replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', ''), '-', ' '), '_', ' ') AS st FROM n),
p AS (SELECT path, '# ' || coalesce(nullif(heading, ''), upper(st[1]) || substring(st, 2)) || chr(10) || chr(10) || '> ' || summary || chr(10) || chr(10) || rtrim(body, chr(10)) || chr(10)
  || CASE WHEN regexp_matches(body, '(?m)^## Sources\\b') THEN '' ELSE chr(10) || '## Sources' || chr(10) || chr(10) || '- `repo/' || path || '`' || chr(10) END || CASE WHEN regexp_matches(body, '(?m)^## See Also\\b') THEN '' ELSE chr(10) || '## See Also' || chr(10) || chr(10) || '- [[index]]' || chr(10) END AS page FROM o)
SELECT path, array_to_string(['---', 'tags: [imported, repo]', 'last_verified: 1970-01-01', 'status: current', 'cited_files: ["repo/' || path || '"]', 'page_type: narrative', 'pristine_hash: ' || sha256(page), '---', '', page], chr(10)) AS page FROM p"""
_COMMITS = f"cm AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS sha, o_orderdate AS dt, {_SUBJECT} || ' ' || o_orderkey AS s, {_BODY} AS b FROM orders)"
_INC, _DEC = "(?i)\\b(incident|outage|rca|post[- ]?mortem|hotfix)\\b", "(?i)\\b(architecture|adr|trade[- ]?off)\\b"
_BREAK = "(regexp_matches({t} || chr(10) || {b}, '(?m)^BREAKING(?:\\s+CHANGE)?[:!]') OR regexp_matches({t}, '^[A-Za-z]+(?:\\([^)]+\\))?!:'))"
_PRS = f"""pr AS (SELECT o_orderkey AS number, {_SUBJECT} AS title, {_BODY} AS body, o_orderdate AS merged_at, lower(coalesce({_LABEL}, 'other')) AS lb FROM orders),
cl AS (SELECT *, CASE WHEN lb IN ('breaking', 'breaking-change') THEN 'breaking' WHEN lb IN ('incident', 'post-mortem', 'postmortem', 'rca') THEN 'incident' WHEN lb IN ('architecture', 'adr', 'decision', 'design') THEN 'decision'
 WHEN {_BREAK.format(t='title', b='body')} THEN 'breaking' WHEN regexp_matches(title, '{_INC}') OR regexp_matches(body, '(?im)^#{{2,4}}\\s+(incident|outage|post[- ]?mortem|rca|what happened|root cause|hotfix)\\b') THEN 'incident'
 WHEN regexp_matches(title, '{_DEC}') OR regexp_matches(body, '(?im)^#{{2,4}}\\s+(decision|rationale|trade[- ]?offs?|architecture|adr|why this matters|why we chose)\\b') THEN 'decision'
 WHEN regexp_matches(body, '(?im)^#{{2,4}}\\s+(breaking|migration|backwards[- ]incompat)') THEN 'breaking' WHEN {_bumped('title')} THEN 'dependency' ELSE 'none' END AS class FROM pr)"""
_IDENTS = f"""list_filter(list_concat(list_concat(regexp_extract_all(text, '\\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+\\b'), regexp_extract_all(text, '\\b[a-z][a-z0-9]+(?:_[a-z0-9]+)+\\b')), regexp_extract_all(text, '\\b([A-Za-z_][A-Za-z0-9_]+)\\s*\\(', 1)),
 lambda w: lower(w) NOT IN ({','.join(f"'{w}'" for w in T.COMMON_WORDS)}))"""
_first = lambda x: f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"
_HITS = f"""{V.SYM}, {V.FILES}, pi AS (SELECT path AS prompt_id, {_IDENTS.replace('text', 'content')} AS l FROM files), pd AS (SELECT prompt_id, {_first('l')} AS l FROM pi),
pe AS (SELECT prompt_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS ident FROM pd, unnest(range(1, len(l) + 1)) AS u(i)),
few AS (SELECT name, file, start_line, row_number() OVER (PARTITION BY name ORDER BY file, start_line) AS rn FROM sym QUALIFY rn <= 5),
hits AS (SELECT prompt_id, pos, ident, file, start_line, CAST(rn AS INTEGER) AS rn FROM pe JOIN few ON ident = name)"""
_CODES = "cd AS (SELECT prompt_id, file, start_line, 's' || row_number() OVER (PARTITION BY prompt_id ORDER BY o, file, start_line) AS code FROM (SELECT prompt_id, file, start_line, min((section, pos, rn)) AS o FROM ev GROUP BY ALL))"
_TOKENS = "list_distinct(list_concat(flatten(list_transform(regexp_extract_all({t}, '[A-Za-z_][A-Za-z0-9_]*'), lambda s: " + S._IDENT.format(n="s") + ")), list_filter(regexp_split_to_array(lower({t}), '[^a-z0-9]+'), lambda x: strlen(x) >= 2 AND NOT list_contains(" + S._SSTOP + ", x))))"
_QUOTES = "list_filter(list_transform(regexp_extract_all(text, '[''\"]([^''\"]+)[''\"]', 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: strlen(x) >= 3)"
_EVIDENCE = f"""{V.SYM}, {V.FILES}, {S._BAG}, pr AS (SELECT item_id AS prompt_id, max(text) || ' "total -= " ' || chr(39) || ['wrapErr(', 'return nil', 'defer '][item_id % 3 + 1] || chr(39) AS text FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL GROUP BY item_id),
qt AS (SELECT prompt_id, unnest({_TOKENS.format(t='text')}) AS term FROM pr), po AS (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM bag) GROUP BY ALL), dfs AS (SELECT term, count(*) AS n FROM po GROUP BY term), sts AS (SELECT count(*) AS big_n, avg(len(w)) AS avgdl FROM bag),
sc AS (SELECT prompt_id, id, round(sum(ln((big_n - n + 0.5) / (n + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN po USING (term) JOIN dfs USING (term), sts GROUP BY prompt_id, id HAVING score > 0),
rk AS (SELECT prompt_id, 0 AS section, 0 AS pos, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, id) AS INTEGER) AS rn, '' AS label, id, score FROM sc QUALIFY rn <= 10),
pid AS (SELECT prompt_id, {_IDENTS} AS l FROM pr), pdi AS (SELECT prompt_id, {_first('l')} AS l FROM pid), pei AS (SELECT prompt_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS ident FROM pdi, unnest(range(1, len(l) + 1)) AS u(i)),
fw AS (SELECT name, file, start_line, CAST(row_number() OVER (PARTITION BY name ORDER BY file, start_line) AS INTEGER) AS rn FROM sym QUALIFY rn <= 5),
pq0 AS (SELECT prompt_id, {_QUOTES} AS l FROM pr), pqd AS (SELECT prompt_id, {_first('l')} AS l FROM pq0), pq AS (SELECT prompt_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS label FROM pqd, unnest(range(1, len(l) + 1)) AS u(i)),
{S._BODY}, lit AS (SELECT DISTINCT label FROM pq), lh AS (SELECT label, file, start_line, name, min((line, text)) AS x FROM body JOIN lit ON contains(text, label) GROUP BY ALL),
lf AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY file, start_line, name) AS INTEGER) AS rn, regexp_replace(x[2], '^[ \\t]+', '') AS t FROM lh QUALIFY rn <= 10),
ev AS (SELECT prompt_id, section, pos, rn, label, file, start_line, name, kind, signature, doc, score, 0 AS line, '' AS snippet FROM rk JOIN bag USING (id)
 UNION ALL SELECT prompt_id, 1, pos, fw.rn, ident, sym.file, sym.start_line, sym.name, kind, signature, doc, 0.0, 0, '' FROM pei JOIN fw ON ident = fw.name JOIN sym ON sym.file = fw.file AND sym.start_line = fw.start_line AND sym.name = ident
 UNION ALL SELECT prompt_id, 2, pos, lf.rn, lf.label, sym.file, sym.start_line, sym.name, kind, signature, doc, 0.0, CAST(x[1] AS INTEGER), {S._SNIP} FROM pq JOIN lf USING (label) JOIN sym ON sym.file = lf.file AND sym.start_line = lf.start_line AND sym.name = lf.name)"""
_line = lambda x: f"regexp_replace(replace(replace(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), chr(10), ' '), chr(13), ''), ' {{2,}}', ' ', 'g')"
_AT = "'`' || file || ':' || start_line || '`'"
_CODE = "chr(10) || '  ```' || chr(10) || '  ' || {x} || chr(10) || '  ```'"
_PARTS = f"""h AS (SELECT *, CAST(substring(code, 2) AS INTEGER) AS n FROM ev JOIN cd USING (prompt_id, file, start_line)), one AS (SELECT prompt_id, code, min((name, file, start_line, kind)) AS x FROM h GROUP BY ALL),
t AS (SELECT prompt_id, string_agg('- `' || code || '` `' || x[1] || '` @ `' || x[2] || ':' || x[3] || '`' || CASE WHEN x[4] IN ('', 'function') THEN '' ELSE ' (' || x[4] || ')' END, chr(10) ORDER BY CAST(substring(code, 2) AS INTEGER)) AS s FROM one GROUP BY 1),
a1 AS (SELECT prompt_id, string_agg('- `' || code || '` (score ' || printf('%.2f', score) || ')', chr(10) ORDER BY rn) AS s FROM h WHERE section = 0 GROUP BY 1),
a0 AS (SELECT prompt_id, string_agg('- **`' || name || '`** ' || {_AT} || ' — ' || {_line('doc')} || CASE WHEN signature <> '' THEN {_CODE.format(x='signature')} ELSE '' END, chr(10) ORDER BY rn) AS s FROM h WHERE section = 0 GROUP BY 1),
n1 AS (SELECT prompt_id, pos, label, string_agg('`' || code || '`', ', ' ORDER BY n, code) AS c FROM h WHERE section = 1 GROUP BY ALL), b1 AS (SELECT prompt_id, string_agg('- `' || label || '` → ' || c, chr(10) ORDER BY pos) AS s FROM n1 GROUP BY 1),
n0 AS (SELECT prompt_id, pos, label, string_agg('  - ' || {_AT} || ' (' || kind || ') ' || signature, chr(10) ORDER BY rn) AS c FROM h WHERE section = 1 GROUP BY ALL), b0 AS (SELECT prompt_id, string_agg('- **`' || label || '`** →' || chr(10) || c, chr(10) ORDER BY pos) AS s FROM n0 GROUP BY 1),
c1 AS (SELECT prompt_id, string_agg('- `' || label || '` in `' || code || '` line ' || line || ': `' || snippet || '`', chr(10) ORDER BY pos, rn) AS s FROM h WHERE section = 2 GROUP BY 1),
c0 AS (SELECT prompt_id, string_agg('- `' || label || '` in **`' || name || '`** `' || file || ':' || line || '`' || {_CODE.format(x='snippet')}, chr(10) ORDER BY pos, rn) AS s FROM h WHERE section = 2 GROUP BY 1)"""


def _report(compact: bool) -> str:
    k = int(compact)
    parts = [(x, t) for x, t in (("t", "Symbols"), (f"a{k}", "Most relevant"), (f"b{k}", "By name"), (f"c{k}", "Literal hits")) if compact or x != "t"]
    text = " || ".join(f"CASE WHEN {x}.s IS NULL THEN '' ELSE '## {title}' || chr(10) || chr(10) || {x}.s || chr(10) || chr(10) END" for x, title in parts)
    joins = " ".join(f"LEFT JOIN {x} ON {x}.prompt_id = p.prompt_id" for x, _ in parts)
    return f"SELECT p.prompt_id, coalesce({', '.join(x + '.s' for x, _ in parts)}) IS NOT NULL AS has_, '# Context' || chr(10) || chr(10) || '**Prompt:** ' || {_line('p.text')} || chr(10) || chr(10) || {text} AS o FROM pr p {joins}"


_DOCS = """dc AS (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id), src AS (SELECT 'doc-' || doc_id AS slug, text AS body, doc_id FROM dc),
ex AS (SELECT slug, doc_id, CASE WHEN doc_id % 4 = 1 THEN body || ' old' ELSE body END AS old FROM src WHERE doc_id % 4 <> 0)"""
_EV = "ev AS (SELECT event_type AS tool, CAST(floor(abs(value) * 10) AS BIGINT) AS r, CAST(json_extract_string(props, '$.k') AS BIGINT) * 1000 AS a FROM events)"
_STAT = "count(*) AS calls, CAST(coalesce(sum(r), 0) AS BIGINT) AS returned, CAST(coalesce(sum(a), 0) AS BIGINT) AS alternative, CAST(greatest(coalesce(sum(a), 0) - coalesce(sum(r), 0), 0) AS BIGINT) AS saved, CAST(floor(greatest(coalesce(sum(a), 0) - coalesce(sum(r), 0), 0) / 4) AS BIGINT) AS tokens_saved, round(CASE WHEN sum(r) > 0 THEN sum(a) / sum(r) ELSE 0.0 END, 6) AS ratio"


def oracle_sql():
    day = "strftime(dt, '%Y-%m-%d')"
    return {
        "classify_commits": f"""WITH {_COMMITS} SELECT sha, 'breaking' AS class, 'log.md' AS target FROM cm WHERE {_BREAK.format(t='s', b='b')}
            UNION ALL SELECT sha, 'incident', 'investigations/' || {_slug(f"{day} || '-' || " + _words('s', 5))} || '.md' FROM cm WHERE regexp_matches(s, '{_INC}')
            UNION ALL SELECT sha, 'decision', 'decisions/' || {_slug(_words('s', 6))} || '.md' FROM cm WHERE regexp_matches(s, '{_DEC}') UNION ALL SELECT sha, 'dependency', 'log.md' FROM cm WHERE {_bumped('s')}""",
        "log_blocks": f"""WITH {_COMMITS}, b AS (SELECT *, 'breaking' AS class FROM cm WHERE {_BREAK.format(t='s', b='b')} UNION ALL SELECT *, 'dependency' FROM cm WHERE {_bumped('s')})
            SELECT sha, class, '## [' || {day} || '] ' || class || ': ' || {_short('s', 60)} || chr(10) || chr(10) || '- commit: `' || substring(sha, 1, 7) || '`' || chr(10) || '- subject: ' || s || chr(10) AS block FROM b""",
        "commit_pages": f"""WITH {_COMMITS}, b AS (SELECT *, 'incident' AS class, 'investigations/' || {_slug(f"{day} || '-' || " + _words('s', 5))} || '.md' AS path FROM cm WHERE regexp_matches(s, '{_INC}') UNION ALL SELECT *, 'decision', 'decisions/' || {_slug(_words('s', 6))} || '.md' FROM cm WHERE regexp_matches(s, '{_DEC}'))
            SELECT path, array_to_string(['---', 'tags: [' || class || ', git-ingest]', 'last_verified: ' || {day}, 'status: current', '---', '', '# ' || {_short('s', 80)}, '',
              '> Auto-imported from commit ' || substring(sha, 1, 7) || '. ' || CASE class WHEN 'incident' THEN 'Replace this with a real post-mortem.' ELSE 'Edit to match the real ADR shape.' END, '',
              CASE class WHEN 'incident' THEN '## What happened' ELSE '## Context' END, '', CASE WHEN b = '' THEN '(no commit body)' ELSE b END, '', '## Sources', '', '- commit: `' || sha || '`', '', '## See Also', '', '- [[log]]', ''], chr(10)) AS body FROM b""",
        "pr_outputs": f"""WITH {_PRS}, n AS (SELECT number FROM cl WHERE number % 5 = 0 AND (number % 2 = 0 OR number % 15 <> 0)), r AS (SELECT *, strftime(merged_at, '%Y-%m-%d') AS day, 'https://example.org/pull/' || number AS url, 'u' || (number % 7) AS login FROM cl WHERE class <> 'none' AND number NOT IN (SELECT number FROM n))
            SELECT number, CASE WHEN class IN ('incident', 'decision') THEN 'page' ELSE 'log' END AS outcome, CASE class WHEN 'incident' THEN 'investigations/' || {_slug("day || '-pr-' || number || '-' || " + _words('title', 5))} || '.md' WHEN 'decision' THEN 'decisions/' || {_slug("'pr-' || number || '-' || " + _words('title', 6))} || '.md' ELSE 'log.md' END AS target,
             CASE WHEN class IN ('incident', 'decision') THEN array_to_string(['---', 'tags: [' || class || ', github-ingest]', 'last_verified: ' || day, 'status: current', 'pr_number: ' || number, '---', '', '# ' || {_short('title', 80)}, '',
               '> Auto-imported from PR #' || number || CASE class WHEN 'incident' THEN ' (' || day || '). Replace with a real post-mortem when ready.' ELSE '. Edit to match the real ADR shape.' END, '', CASE class WHEN 'incident' THEN '## What happened' ELSE '## Context' END, '',
               CASE WHEN body = '' THEN '(no PR body)' ELSE body END, '', '## Sources', '', '- pr: ' || url, '- merged: ' || strftime(merged_at, '%Y-%m-%dT%H:%M:%SZ'), '- author: @' || login, '', '## See Also', '', '- [[log]]', ''], chr(10))
             ELSE '## [' || day || '] ' || class || ': pr#' || number || ' ' || {_short('title', 60)} || chr(10) || chr(10) || '- author: @' || login || chr(10) || '- url: ' || url || chr(10) || '- title: ' || title || chr(10) END AS text FROM r""",
        "valid_repos": "WITH p AS (SELECT DISTINCT path FROM source_files WHERE path IS NOT NULL), n AS (SELECT CASE length(path) % 3 WHEN 0 THEN path WHEN 1 THEN array_to_string(string_split(path, '/')[1:2], '/') ELSE split_part(path, '/', 1) || ' /x' END AS repo FROM p) SELECT DISTINCT repo, regexp_full_match(repo, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') AS valid FROM n",
        "imported_pages": _IMPORTED,
        "text_helpers": f"""WITH {V.FILES}, f AS (SELECT DISTINCT path, length * 613 AS n, length - 900 AS r FROM files), t AS (SELECT *, replace(replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.md$', ''), '-', ' '), '_', ' ') AS st FROM f)
            SELECT path, CASE WHEN n >= 1048576 THEN printf('%.1f MiB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KiB', n / 1024.0) ELSE n || ' B' END AS size, round(CASE WHEN r > 0 THEN 1.0 / r ELSE 0.0 END, 9) AS inverse, upper(st[1]) || substring(st, 2) AS title, '> ' || replace(path, '/', chr(10) || '> ') AS quote FROM t""",
        "classify_prs": f"WITH {_PRS} SELECT number, class FROM cl",
        "route_actions": f"""WITH {_PRS}, r AS (SELECT *, CASE WHEN class = 'none' THEN 'noise' WHEN number % 5 = 0 THEN 'skipped' WHEN class IN ('incident', 'decision') THEN 'page' ELSE 'log' END AS outcome FROM cl)
            SELECT number, class, outcome, CASE WHEN outcome = 'log' THEN 'log.md' WHEN outcome = 'page' AND class = 'incident' THEN 'investigations/' || {_slug("strftime(merged_at, '%Y-%m-%d') || '-pr-' || number || '-' || " + _words('title', 5))} || '.md' WHEN outcome = 'page' THEN 'decisions/' || {_slug("'pr-' || number || '-' || " + _words('title', 6))} || '.md' END AS target FROM r""",
        "dedupe_existing_prs": f"WITH {_PRS} SELECT number, title FROM pr WHERE NOT (number % 5 = 0 AND (number % 2 = 0 OR number % 15 <> 0))",
        "since_filter": f"WITH {_PRS} SELECT strftime(merged_at, '%Y-%m') AS month, count(*) AS n FROM pr WHERE merged_at >= TIMESTAMP '1998-08-02' - INTERVAL 400 DAY GROUP BY ALL",
        "major_bump": f"WITH {_PRS} SELECT title, bool_or({_bumped('title')}) AS bumped FROM pr GROUP BY title",
        "slugify": f"WITH {_PRS} SELECT DISTINCT {_slug(_words('title', 6))} AS slug FROM pr",
        "prompt_identifiers": f"WITH p AS (SELECT doc_id, {_IDENTS} AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id AS prompt_id, {_first('l')} AS idents FROM p",
        "prompt_quoted": f"WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[''\"]([^''\"]+)[''\"]', 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: strlen(x) >= 3) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id AS prompt_id, {_first('l')} AS quoted FROM p WHERE len(l) > 0",
        "prompt_context": f"WITH {_HITS} SELECT * FROM hits",
        "context_hits": f"WITH {_EVIDENCE} SELECT prompt_id, section, pos, rn, label, file, start_line, name, score, line, snippet FROM ev",
        "symtab_codes": f"WITH {_EVIDENCE}, {_CODES} SELECT * FROM cd",
        "codec_ab": f"""WITH {_EVIDENCE}, {_CODES}, {_PARTS}, full_ AS ({_report(False)}), short_ AS ({_report(True)}), p AS (SELECT round((1 - strlen(s.o) / strlen(f.o)) * 100, 4) AS pct FROM full_ f JOIN short_ s USING (prompt_id) WHERE f.has_)
            SELECT count(*) AS n, round(avg(pct), 4) AS mean, min(pct) AS least, max(pct) AS most FROM p""",
        "prompt_report": f"""WITH {_EVIDENCE}, {_CODES}, {_PARTS}, r AS ({_report(True)}),
            k AS (SELECT *, CASE WHEN strlen(o) > 8000 THEN substring(o, 1, len(list_filter(range(1, length(o) + 1), lambda k: strlen(substring(o, 1, k)) <= 8000))) END AS head FROM r)
            SELECT prompt_id, CASE WHEN NOT has_ THEN '' WHEN head IS NULL THEN o ELSE regexp_replace(head, '\\n[^\\n]*$', '') || chr(10) || chr(10) || '_…truncated_' || chr(10) END AS report FROM k""",
        "sync_upsert": f"WITH {_DOCS} SELECT s.slug, CASE WHEN s.doc_id % 4 = 0 THEN 'insert' WHEN s.doc_id % 4 = 2 THEN 'edited' WHEN s.doc_id % 4 = 1 THEN 'overwrite' ELSE 'unchanged' END AS action, sha256(body) AS body_hash FROM src s",
        "insert_if_absent": f"WITH {_DOCS} SELECT slug, length(body) AS n FROM src WHERE doc_id % 4 = 0",
        "replace_by_key": f"WITH {V.CALLS}, t AS (SELECT calls.*, seen FROM calls JOIN (SELECT edge_id, max(seen_at) AS seen FROM call_edges GROUP BY 1) USING (edge_id)) SELECT * EXCLUDE (seen) FROM t WHERE seen >= TIMESTAMP '2024-07-01' OR caller_file NOT IN (SELECT caller_file FROM t WHERE seen >= TIMESTAMP '2024-07-01')",
        "except_stale": "SELECT path FROM source_files EXCEPT SELECT path FROM source_files WHERE removed_at IS NULL",
        "session_stats": f"WITH {_EV} SELECT {_STAT} FROM ev",
        "stats_by_tool": f"WITH {_EV} SELECT tool, {_STAT} FROM ev GROUP BY tool",
        "wiki_vs_raw": f"WITH {V.PAGES}, {V.FILES}, a AS (SELECT 'wiki' AS mode, strlen(body) AS c FROM pages UNION ALL SELECT 'raw', strlen(content) FROM files) SELECT mode, count(*) AS n, CAST(sum(c) AS BIGINT) AS chars, CAST(sum(c // 4) AS BIGINT) AS tokens FROM a GROUP BY mode",
        "wiki_vs_raw_questions": f"""WITH {V.PAGES}, {V.FILES}, pl AS (SELECT path, slug, regexp_replace(body, '^---\\n(.|\\n)*?\\n---\\n', '') AS plain FROM pages), tok AS (SELECT path AS id, {S._PROSE.format(t='plain')} AS w FROM pl),
            q(qid, term) AS (VALUES {', '.join(f"({i}, '{t}')" for i, x in enumerate(QUESTIONS) for t in question_tokens(x))}), p AS (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
            df AS (SELECT term, count(*) AS n FROM p GROUP BY term), st AS (SELECT count(*) AS big_n, avg(len(w)) AS avgdl FROM tok),
            sc AS (SELECT qid, id, round(sum(ln((big_n - n + 0.5) / (n + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY qid, id HAVING score > 0),
            best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 5), at_ AS (SELECT b.qid, slug, plain, min(instr(lower(plain), term)) FILTER (instr(lower(plain), term) > 0) AS c FROM best b JOIN pl ON id = path JOIN q USING (qid) GROUP BY b.qid, b.id, slug, plain),
            hit AS (SELECT *, strlen(substring(plain, 1, c - 1)) AS b FROM at_), cut AS (SELECT *, greatest(b - 60, 0) AS lo, least(b + 140, strlen(plain)) AS hi FROM hit),
            ends AS (SELECT *, len(list_filter(range(0, length(plain) + 1), lambda k: strlen(substring(plain, 1, k)) < lo)) AS s0, len(list_filter(range(1, length(plain) + 1), lambda k: strlen(substring(plain, 1, k)) <= hi)) AS e0 FROM cut),
            sn AS (SELECT qid, strlen(trim(regexp_extract(plain, '(?m)^# ([^\\n]*)$', 1))) + strlen(slug) + strlen(CASE WHEN lo > 0 THEN '…' ELSE '' END || trim(substring(plain, s0 + 1, e0 - s0), ' ' || chr(9) || chr(13) || chr(10)) || CASE WHEN hi < strlen(plain) THEN '…' ELSE '' END) AS c FROM ends),
            ids AS (SELECT DISTINCT qid FROM q), r AS (SELECT qid, 'wiki' AS mode, CAST(coalesce(sum(c), 0) AS BIGINT) AS chars FROM ids LEFT JOIN sn USING (qid) GROUP BY qid UNION ALL SELECT qid, 'raw', CAST((SELECT sum(length) FROM (SELECT DISTINCT path, length FROM files)) AS BIGINT) FROM ids),
            t AS (SELECT *, chars // 4 AS tokens FROM r) SELECT * FROM t UNION ALL SELECT -1, mode, CAST(sum(chars) AS BIGINT), CAST(sum(tokens) AS BIGINT) FROM t GROUP BY mode""",
        "avg_confidence": "SELECT event_type, round(coalesce(avg(CASE WHEN event_id % 8 BETWEEN 1 AND 5 THEN event_id % 8 END), 0.0), 6) AS mean FROM events GROUP BY event_type",
    }
