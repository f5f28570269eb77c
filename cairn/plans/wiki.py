"""Queries on wiki quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import wiki as W
from cairn.operators.orphans import line_count
from cairn.plans import views as V
from cairn.sources.tables import table

def _pages(spark, d):
    return W.listed(V.pages(spark, d))


def _citations(spark, d):
    return table(spark, d, "citations").where("citation_id is not null").select("citation_id", "source_file", "line_in_source", "repo_path", F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("line_end", F.lit(0)).alias("line_end")).distinct()


def _records(spark, d):
    return W.page_records(_pages(spark, d), W.extract_citations(_pages(spark, d), V.repositories(spark, d)))


def lint_title(spark, d):
    return W.lint_title(_pages(spark, d))


def lint_summary(spark, d):
    return W.lint_summary(_pages(spark, d))


def lint_sections(spark, d):
    return W.lint_sections(_pages(spark, d))


def lint_filename(spark, d):
    """Over the paths as they are, and once more with underscores for hyphens, so that the rule fires."""
    p = _pages(spark, d)
    return W.lint_filename(p.unionByName(p.withColumn("path", F.replace("path", F.lit("-"), F.lit("_")))))


def lint_frontmatter(spark, d):
    return W.lint_frontmatter(_pages(spark, d))


def lint_wikilinks(spark, d):
    return W.lint_wikilinks(_pages(spark, d))


def lint_all(spark, d):
    return W.lint_all(_pages(spark, d)).select(*W.VIOLATION)


def severity_counts(spark, d):
    return W.severity_counts(W.lint_all(_pages(spark, d)))


def lint_render(spark, d):
    return W.render(W.lint_sections(_pages(spark, d)))


def citations(spark, d):
    return W.extract_citations(_pages(spark, d), V.repositories(spark, d))


def drift(spark, d):
    inv = V.files(spark, d).select("path", line_count("content").alias("n_lines"))
    return W.drift(_citations(spark, d), inv).select("citation_id", "repo_path", "rule", "severity")


def page_meta(spark, d):
    return _records(spark, d)


def xref(spark, d):
    return W.xref(_records(spark, d), V.repositories(spark, d))


def xref_lists(spark, d):
    """The reverse index as the files of a repository have it: one list a file."""
    return W.xref_lists(xref(spark, d))


def drift_unreadable(spark, d):
    """Drift where every third file can't be read."""
    inv = V.files(spark, d).select("path", F.when(F.length("path") % 3 > 0, line_count("content")).alias("n_lines"))
    return W.drift(_citations(spark, d), inv).groupBy("rule", "severity").agg(F.count("*").alias("n"))


def queries():
    return {f.__name__: f for f in (lint_title, lint_summary, lint_sections, lint_filename, lint_frontmatter, lint_wikilinks, lint_all, severity_counts, lint_render, citations, drift, drift_unreadable, page_meta, xref, xref_lists)}


_sq = lambda xs: ",".join(f"'{x}'" for x in xs)
_P = f"""{V.PAGES}, pg AS (SELECT *, regexp_replace(body, '^---\\n(.|\\n)*?\\n---\\n', '') AS plain, regexp_extract(path, '[^/]*$') AS fname FROM pages
 WHERE path LIKE '%.md' AND regexp_extract(path, '[^/]*$') NOT IN ({_sq(W.SKIP_NAMES)}) AND NOT list_has_any(string_split(path, '/'), [{_sq(W.SKIP_PARTS)}])),
ln AS (SELECT *, list_filter(string_split(plain, chr(10)), lambda x: regexp_replace(x, '\\s', '', 'g') <> '') AS f FROM pg)"""
_TITLE = "SELECT path AS file, 1 AS line, 'missing-title' AS rule, 'error' AS severity, 'Page must start with `# Title` (level-1 heading).' AS message, false AS autofix FROM ln WHERE NOT coalesce(starts_with(f[1], '# '), false)"
_SUMMARY = "SELECT path AS file, 0 AS line, 'missing-summary' AS rule, 'error' AS severity, 'Page must include `> One-line summary.` within the first 5 lines after the title.' AS message, false AS autofix FROM ln WHERE len(list_filter(f[2:6], lambda x: starts_with(x, '> '))) = 0"
_SECTIONS = " UNION ALL ".join(f"SELECT path AS file, 0 AS line, '{r}' AS rule, 'error' AS severity, 'Page must include a `## {h}` section.' AS message, false AS autofix FROM pg WHERE NOT regexp_matches(body, '(?m)^## {h}\\b')" for r, h in (("missing-sources", "Sources"), ("missing-see-also", "See Also")))
_NAME = f"SELECT path AS file, 0 AS line, 'filename-casing' AS rule, 'error' AS severity, 'Filename `' || fname || '` should be lowercase-hyphenated (e.g. `my-page.md`).' AS message, true AS autofix FROM {{src}} WHERE fname NOT IN ({_sq(W.ALLOWED_NAMES)}) AND NOT regexp_matches(fname, '^\\d{{4}}-\\d{{2}}-\\d{{2}}\\.md$') AND NOT regexp_matches(regexp_replace(fname, '\\.[^.]*$', ''), '^[a-z0-9][a-z0-9-]*$')"
_FM = f"""fm AS (SELECT *, starts_with(body, '---' || chr(10)) AS opened, contains(substring(body, 5), chr(10) || '---' || chr(10)) AS closed, regexp_extract(body, '^---\\n((?:.|\\n)*?\\n)---\\n', 1) AS block FROM pg),
fk AS (SELECT *, regexp_extract_all(block, '(?m)^([A-Za-z_][A-Za-z0-9_-]*):', 1) AS keys, trim(regexp_extract(block, '(?m)^status:[ \\t]*([^\\n]*)$', 1)) AS status FROM fm)"""
_ok = "opened AND closed AND len(keys) > 0"
_V = lambda rule, msg, cond, src="fk": f"SELECT path AS file, 1 AS line, '{rule}' AS rule, 'error' AS severity, {msg} AS message, false AS autofix FROM {src} WHERE {cond}"
_FRONT = " UNION ALL ".join((
    _V("missing-frontmatter", "'Page must start with YAML frontmatter (`---\\n...\\n---`).'", "NOT opened"),
    _V("malformed-frontmatter", "'Frontmatter is not closed with `---`.'", "opened AND NOT closed"),
    _V("malformed-frontmatter", "'Frontmatter is empty or unparseable as YAML.'", "opened AND closed AND len(keys) = 0"),
    _V("missing-frontmatter-field", "'Frontmatter missing required field `' || r || '`.'", f"{_ok} AND NOT list_contains(keys, r)", f"fk, unnest([{_sq(W.REQUIRED_FIELDS)}]) AS t(r)"),
    _V("invalid-frontmatter-value", f"'Frontmatter `status: ' || status || '` is not in [{' '.join(W.STATUS_VALUES)}].'", f"{_ok} AND list_contains(keys, 'status') AND status NOT IN ({_sq(W.STATUS_VALUES)})"),
))
_FENCE = f"""lines AS (SELECT path, CAST(i AS INTEGER) AS line, l[i] AS text FROM (SELECT path, string_split(body, chr(10)) AS l FROM pg), unnest(range(1, len(l) + 1)) AS u(i)),
par AS (SELECT *, regexp_matches(text, '^[ \\t]*(```|~~~)') AS fence, sum(CASE WHEN regexp_matches(text, '^[ \\t]*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS k FROM lines),
cl AS (SELECT path, line, CASE WHEN fence OR k % 2 = 1 THEN '' ELSE text END AS text FROM par)"""
_LINKS = f"""{_FENCE}, li AS (SELECT path, line, trim(unnest(regexp_extract_all(regexp_replace(text, '`[^`\\n]*`', '', 'g'), '\\[\\[([^\\]|#]+?)(?:\\|[^\\]]+)?(?:#[^\\]]+)?\\]\\]', 1))) AS target FROM cl),
ix AS (SELECT lower(regexp_replace(fname, '\\.md$', '')) AS t FROM pg UNION SELECT replace(lower(regexp_replace(fname, '\\.md$', '')), '-', ' ') FROM pg)"""
_BROKEN = "SELECT path AS file, line, 'broken-wikilink' AS rule, 'error' AS severity, 'Broken `[[wiki link]]`: `' || target || '` does not match any page in the wiki.' AS message, false AS autofix FROM li WHERE lower(target) NOT IN (SELECT t FROM ix) AND regexp_extract(lower(target), '[^/]*$') NOT IN (SELECT t FROM ix)"
_CITE_RX = "`([A-Za-z0-9_.-]+/[A-Za-z0-9_./-]+?)(?::(\\d+)(?:-(\\d+))?)?`"
_CITES = f"""{_FENCE}, cm AS (SELECT path, line, unnest(regexp_extract_all(text, '`[^`]*`')) AS m FROM cl),
repos AS (SELECT DISTINCT split_part(path, '/', 1) AS r FROM source_files WHERE path LIKE '%/%'),
cite AS (SELECT path AS source_file, line AS line_in_source, regexp_extract(m, '{_CITE_RX}', 1) AS repo_path, coalesce(try_cast(nullif(regexp_extract(m, '{_CITE_RX}', 2), '') AS INTEGER), 0) AS line, coalesce(try_cast(nullif(regexp_extract(m, '{_CITE_RX}', 3), '') AS INTEGER), 0) AS line_end
 FROM cm WHERE regexp_full_match(m, '{_CITE_RX}') AND split_part(substring(m, 2), '/', 1) IN (SELECT r FROM repos))"""
_META = """ct AS (SELECT source_file, list(repo_path ORDER BY at_, repo_path) AS cited_files FROM (SELECT source_file, repo_path, min(line_in_source) AS at_ FROM cite GROUP BY ALL) GROUP BY source_file),
rec AS (SELECT regexp_replace(fname, '\\.md$', '') AS slug, trim(regexp_extract(body, '(?m)^# ([^\\n]*)$', 1)) AS title, CASE WHEN contains(regexp_replace(path, '^wiki/', ''), '/') THEN split_part(regexp_replace(path, '^wiki/', ''), '/', 1) ELSE '_root' END AS category,
 list_filter(list_transform(string_split(regexp_replace(trim(regexp_extract(block, '(?m)^tags:[ \\t]*([^\\n]*)$', 1)), '[\\[\\]]', '', 'g'), ','), lambda t: trim(t)), lambda t: t <> '') AS tags,
 trim(regexp_extract(block, '(?m)^last_verified:[ \\t]*([^\\n]*)$', 1)) AS last_verified, coalesce(nullif(status, ''), 'unknown') AS status, coalesce(cited_files, []) AS cited_files FROM fk LEFT JOIN ct ON source_file = path)"""


def oracle_sql():
    name = lambda src: _NAME.replace("{src}", src)
    everything = " UNION ALL ".join((_TITLE, _SUMMARY, _SECTIONS, name("pg"), _FRONT, _BROKEN))
    all_cte = f"WITH {_P}, {_FM}, {_LINKS}"
    repo = "split_part(c, '/', 1) || '/'"
    n_lines = "length(content) - length(replace(content, chr(10), '')) + CASE WHEN content <> '' AND content NOT LIKE '%' || chr(10) THEN 1 ELSE 0 END"
    return {
        "lint_title": f"WITH {_P} {_TITLE}",
        "lint_summary": f"WITH {_P} {_SUMMARY}",
        "lint_sections": f"WITH {_P} {_SECTIONS}",
        "lint_filename": f"WITH {_P}, both_ AS (SELECT path, fname FROM pg UNION ALL SELECT replace(path, '-', '_'), replace(fname, '-', '_') FROM pg) {name('both_')}",
        "lint_frontmatter": f"WITH {_P}, {_FM} {_FRONT}",
        "lint_wikilinks": f"WITH {_P}, {_LINKS} {_BROKEN}",
        "lint_all": f"{all_cte} {everything}",
        "severity_counts": f"{all_cte} SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(DISTINCT file) AS files FROM ({everything})",
        "lint_render": f"WITH {_P} SELECT file, string_agg('  [' || rule || '] ' || message, chr(10) ORDER BY line, rule) AS text FROM ({_SECTIONS}) GROUP BY file",
        "citations": f"WITH {_P}, {_CITES} SELECT * FROM cite",
        "drift": f"""WITH {V.FILES}, c AS (SELECT DISTINCT citation_id, repo_path, greatest(coalesce(line, 0), coalesce(line_end, 0)) AS need FROM citations), inv AS (SELECT path, {n_lines} AS n FROM files),
            x AS (SELECT citation_id, repo_path, CASE WHEN split_part(repo_path, '/', 1) NOT IN (SELECT split_part(path, '/', 1) FROM inv) THEN 'citation-repo-not-cloned' WHEN path IS NULL THEN 'citation-file-missing' WHEN need > n THEN 'citation-line-out-of-bounds' END AS rule FROM c LEFT JOIN inv ON path = repo_path)
            SELECT citation_id, repo_path, rule, CASE WHEN rule = 'citation-repo-not-cloned' THEN 'warning' ELSE 'error' END AS severity FROM x WHERE rule IS NOT NULL""",
        "drift_unreadable": f"""WITH {V.FILES}, c AS (SELECT DISTINCT citation_id, repo_path, greatest(coalesce(line, 0), coalesce(line_end, 0)) AS need, source_file, line_in_source, coalesce(line, 0), coalesce(line_end, 0) FROM citations), inv AS (SELECT path, CASE WHEN length(path) % 3 > 0 THEN {n_lines} END AS n FROM files),
            x AS (SELECT citation_id, CASE WHEN split_part(repo_path, '/', 1) NOT IN (SELECT split_part(path, '/', 1) FROM inv) THEN 'citation-repo-not-cloned' WHEN path IS NULL THEN 'citation-file-missing' WHEN n IS NULL THEN 'citation-file-unreadable' WHEN need > n THEN 'citation-line-out-of-bounds' END AS rule FROM c LEFT JOIN inv ON path = repo_path)
            SELECT rule, CASE WHEN rule IN ('citation-repo-not-cloned', 'citation-file-unreadable') THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM x WHERE rule IS NOT NULL GROUP BY ALL""",
        "page_meta": f"WITH {_P}, {_FM}, {_CITES}, {_META} SELECT * FROM rec",
        "xref": f"WITH {_P}, {_FM}, {_CITES}, {_META}, e AS (SELECT slug, title, unnest(cited_files) AS c FROM rec), r AS (SELECT *, {repo} AS repo FROM e) SELECT repo, substring(c, length(repo) + 1) AS path, slug, title FROM r",
        "xref_lists": f"WITH {_P}, {_FM}, {_CITES}, {_META}, e AS (SELECT slug, title, unnest(cited_files) AS c FROM rec), r AS (SELECT *, {repo} AS repo FROM e) SELECT repo, substring(c, length(repo) + 1) AS path, list({{'slug': slug, 'title': title}} ORDER BY slug, title) AS pages FROM r GROUP BY ALL",
    }
