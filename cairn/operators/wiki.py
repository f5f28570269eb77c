"""Wiki quality: lint rules, links, citations and their drift, page records, reverse citation index.

Each rule gives rows of one schema (VIOLATION); the rules are narrow but for the link check, which is two anti joins with the
page index.  ``pages`` has path, slug and body; a null body is an empty page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators.skew import salted_join

#: Defaults of the lint rules.
ALLOWED_NAMES = ["SCHEMA.md", "README.md", "QUERY_PATTERNS.md", "MEMORY.md"]
SKIP_NAMES = ["index.md", "log.md", "SCHEMA.md", "README.md", "QUERY_PATTERNS.md"]
SKIP_PARTS = ["_lint", "sources", ".github", ".pytest_cache", ".obsidian", "agents", "_xref", "_bench"]
REQUIRED_FIELDS = ["tags", "last_verified", "status"]
STATUS_VALUES = ["current", "draft", "archived", "deprecated", "proposed"]
CITE_SKIP = ["wiki/", "_bench/"]
VIOLATION = ["file", "line", "rule", "severity", "message", "autofix"]


def listed(pages: DataFrame) -> DataFrame:
    """The pages that rules apply to: ``.md``, not skipped by name or by a part of the path."""
    name = F.substring_index("path", "/", -1)
    return pages.where(F.col("path").endswith(".md") & ~name.isin(SKIP_NAMES) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIP_PARTS))))


#: The messages below are what the rules say.
def _violation(df: DataFrame, rule: str, message: Column | str, line: Column | int = 0, severity: str = "error", autofix: bool = False) -> DataFrame:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.col("path").alias("file"), as_col(line).cast("int").alias("line"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), as_col(message).alias("message"), F.lit(autofix).alias("autofix"))


def _filled_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, "\r+$", "")), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", "") != "")


def lint_title(pages: DataFrame) -> DataFrame:
    return _violation(pages.where(~F.coalesce(F.try_element_at(_filled_lines(T.strip_front_matter("body")), F.lit(1)).startswith("# "), F.lit(False))), "missing-title", "Page must start with `# Title` (level-1 heading).", 1)


def lint_summary(pages: DataFrame) -> DataFrame:
    return _violation(pages.where(~F.exists(F.slice(_filled_lines(T.strip_front_matter("body")), 2, 5), lambda x: x.startswith("> "))), "missing-summary", "Page must include `> One-line summary.` within the first 5 lines after the title.")


def lint_sections(pages: DataFrame) -> DataFrame:
    out = None
    for rule, head in (("missing-sources", "Sources"), ("missing-see-also", "See Also")):
        v = _violation(pages.where(~F.col("body").rlike(f"(?md)^## {head}{T.RB}")), rule, f"Page must include a `## {head}` section.")
        out = v if out is None else out.unionByName(v)
    return out


def lint_filename(pages: DataFrame) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    bad = ~name.isin(ALLOWED_NAMES) & ~name.rlike(r"^\d{4}-\d{2}-\d{2}\.md$") & ~stem.rlike("^[a-z0-9][a-z0-9-]*$")
    return _violation(pages.where(bad), "filename-casing", F.concat(F.lit("Filename `"), name, F.lit("` should be lowercase-hyphenated (e.g. `my-page.md`).")), autofix=True)


def lint_frontmatter(pages: DataFrame) -> DataFrame:
    opened, closed = F.col("body").startswith("---\n"), F.contains(F.substring("body", 5, 2147483647), F.lit("\n---\n"))
    block = F.regexp_extract("body", r"(?s)\A---\n(.*?\n)---\n", 1)
    keys = F.regexp_extract_all(block, F.lit("(?m)^([A-Za-z_][A-Za-z0-9_-]*):"), 1)
    p = pages.withColumn("keys", keys)
    status = T.front_matter_field("body", "status")
    ok = p.where(opened & closed & (F.size("keys") > 0))
    missing = ok.withColumn("field", F.explode(F.array_except(F.array(*map(F.lit, REQUIRED_FIELDS)), F.col("keys"))))
    return (
        _violation(p.where(~opened), "missing-frontmatter", "Page must start with YAML frontmatter (`---\\n...\\n---`).", 1)
        .unionByName(_violation(p.where(opened & ~closed), "malformed-frontmatter", "Frontmatter is not closed with `---`.", 1))
        .unionByName(_violation(p.where(opened & closed & (F.size("keys") == 0)), "malformed-frontmatter", "Frontmatter is empty or unparseable as YAML.", 1))
        .unionByName(_violation(missing, "missing-frontmatter-field", F.concat(F.lit("Frontmatter missing required field `"), F.col("field"), F.lit("`.")), 1))
        .unionByName(_violation(ok.where(F.array_contains("keys", "status") & ~status.isin(STATUS_VALUES)), "invalid-frontmatter-value", F.concat(F.lit("Frontmatter `status: "), status, F.lit(f"` is not in [{' '.join(STATUS_VALUES)}].")), 1))
    )


def page_index(pages: DataFrame) -> DataFrame:
    """``target``: each page's lower-case stem, also with spaces for hyphens."""
    stem = F.lower(F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", ""))
    return pages.select(F.explode(F.array(stem, F.replace(stem, F.lit("-"), F.lit(" ")))).alias("target")).distinct()


def wikilinks(pages: DataFrame) -> DataFrame:
    """``(path, line, target)`` of links outside code."""
    clean = T.blank_inline_code(T.blank_fences("body"))
    lines = pages.select("path", F.posexplode(F.split(clean, "\n", -1)).alias("p", "text")).where(F.contains("text", F.lit("[[")))
    found = F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#]+?)(?:\|[^\]]+)?(?:#[^\]]+)?\]\]"), 1)
    return lines.select("path", (F.col("p") + 1).alias("line"), F.explode(found).alias("target")).withColumn("target", F.trim("target"))


def lint_wikilinks(pages: DataFrame) -> DataFrame:
    index = page_index(pages)
    links = wikilinks(pages).withColumn("lower", F.lower("target")).withColumn("last", F.substring_index("lower", "/", -1))
    bad = links.join(index, links["lower"] == index["target"], "left_anti")
    bad = bad.join(index.withColumnRenamed("target", "t2"), F.col("last") == F.col("t2"), "left_anti")
    return _violation(bad, "broken-wikilink", F.concat(F.lit("Broken `[[wiki link]]`: `"), F.col("target"), F.lit("` does not match any page in the wiki.")), F.col("line"))


def lint_all(pages: DataFrame) -> DataFrame:
    out = lint_title(pages)
    for rule in (lint_summary, lint_sections, lint_filename, lint_frontmatter, lint_wikilinks):
        out = out.unionByName(rule(pages))
    return out


def severity_counts(violations: DataFrame) -> DataFrame:
    return violations.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.countDistinct("file").alias("files"))


def render(violations: DataFrame) -> DataFrame:
    """``(file, text)``: the findings of each file as text, one a line, by line and rule."""
    row = F.concat(F.lit("  "), F.when(F.col("line") > 0, F.concat(F.lit("L"), F.col("line").cast("string"), F.lit(" "))).otherwise(F.lit("")), F.lit("["), F.col("rule"), F.lit("] "), F.col("message"))
    return violations.withColumn("r", row).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "rule", "r"))), lambda x: x["r"]), "\n").alias("text"))


def extract_citations(pages: DataFrame, prefixes: list[str], skip: list[str] = CITE_SKIP) -> DataFrame:
    """``(source_file, line_in_source, repo_path, line, line_end)`` of back-ticked citations of repositories, outside fenced code; 0 where a line is absent."""
    esc = lambda s: "".join("\\" + c if c in r"\.[]{}()*+?^$|-" else c for c in s)
    rx = "`((?:" + "|".join(map(esc, prefixes)) + r")[A-Za-z0-9_./-]+?)(?::(\d+)(?:-(\d+))?)?`"
    lines = pages.select("path", F.posexplode(F.split(T.blank_fences("body"), "\n", -1)).alias("p", "text")).where(F.contains("text", F.lit("`")))
    parts = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(rx), g).alias(n) for g, n in ((1, "a"), (2, "b"), (3, "c"))])
    got = lines.select("path", "p", F.explode(parts).alias("x")).select(F.col("path").alias("source_file"), (F.col("p") + 1).alias("line_in_source"), F.col("x.a").alias("repo_path"), F.coalesce(F.try_to_number("x.b", F.lit("999999999")).cast("int"), F.lit(0)).alias("line"), F.coalesce(F.try_to_number("x.c", F.lit("999999999")).cast("int"), F.lit(0)).alias("line_end"))
    for s in skip:
        got = got.where(~F.col("repo_path").startswith(s))
    return got


def drift(citations: DataFrame, inventory: DataFrame) -> DataFrame:
    """Citations whose repository or file is missing, whose file can't be read or whose line is beyond the end; ``inventory``: (path,
    n_lines) of what is there, without lines where it can't be read."""
    repos = inventory.select(F.substring_index("path", "/", 1).alias("repo")).distinct().withColumn("has_repo", F.lit(True))
    files = inventory.groupBy("path").agg(F.max("n_lines").alias("n_lines"))
    j = citations.withColumn("repo", F.substring_index("repo_path", "/", 1)).join(repos, "repo", "left")
    j = salted_join(j, files.withColumn("repo_path", F.col("path")), ["repo_path"], "left_outer")
    rule = F.when(F.col("has_repo").isNull(), "citation-repo-not-cloned").when(F.col("path").isNull(), "citation-file-missing").when(F.col("n_lines").isNull(), "citation-file-unreadable").when(F.greatest(F.coalesce("line", F.lit(0)), F.coalesce("line_end", F.lit(0))) > F.col("n_lines"), "citation-line-out-of-bounds")
    return j.withColumn("rule", rule).where("rule is not null").withColumn("severity", F.when(F.col("rule").isin("citation-repo-not-cloned", "citation-file-unreadable"), "warning").otherwise("error"))


def page_records(pages: DataFrame, citations: DataFrame, root: str = "wiki/") -> DataFrame:
    """One record a page: ``(slug, title, category, tags, last_verified, status, cited_files)``; cited files are distinct, in order of appearance."""
    rel = F.when(F.col("path").startswith(root), F.substring("path", len(root) + 1, 2147483647)).otherwise(F.col("path"))
    cited = citations.groupBy("source_file", "repo_path").agg(F.min("line_in_source").alias("at")).groupBy(F.col("source_file").alias("path")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "repo_path"))), lambda x: x["repo_path"]).alias("cited_files"))
    tags, listed_files = T.front_matter_list("body", "tags"), T.front_matter_list("body", "cited_files")
    return pages.join(cited, "path", "left").select(
        F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "").alias("slug"), T.first_heading("body").alias("title"), F.when(F.contains(rel, F.lit("/")), F.substring_index(rel, "/", 1)).otherwise("_root").alias("category"), tags.alias("tags"),
        T.front_matter_field("body", "last_verified").alias("last_verified"), F.coalesce(F.nullif(T.front_matter_field("body", "status"), F.lit("")), F.lit("unknown")).alias("status"), F.when(F.size(listed_files) > 0, listed_files).otherwise(F.coalesce("cited_files", F.array().cast("array<string>"))).alias("cited_files"),
    )


def xref(records: DataFrame, prefixes: list[str]) -> DataFrame:
    """``(repo, path, slug, title)``: who cites a file; its repository is the first configured prefix that matches.

    One row a citing page instead of a list a file: a file that a third of all pages cite is no row of its own."""
    c = records.select("slug", "title", F.explode("cited_files").alias("cited"))
    repo = F.coalesce(*[F.when(F.col("cited").startswith(p), F.lit(p)) for p in prefixes])
    c = c.withColumn("repo", repo).where("repo is not null").withColumn("path", F.substring("cited", F.length("repo") + 1, F.lit(2147483647)))
    return c.select("repo", "path", "slug", "title")


def xref_lists(rows: DataFrame) -> DataFrame:
    """``(repo, path, pages)``: who cites a file as one list, by slug and title, repeats kept."""
    return rows.groupBy("repo", "path").agg(F.sort_array(F.collect_list(F.struct("slug", "title"))).alias("pages"))
