"""Rule-based classification and routing of commits and pull requests; content-hash sync; receipts of tool calls.

All narrow column expressions, and joins on the record's key.  Null texts count as empty."""

from __future__ import annotations

import datetime as dt
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T

#: Signals in subjects, titles and headings.
BREAKING_FOOTER = r"(?md)^BREAKING(?:[\t\n\f\r ]+CHANGE)?[:!]"
BREAKING_BANG = r"^[A-Za-z]+(?:\([^)]+\))?!:"
INCIDENT = rf"(?i){T.LB}(incident|outage|rca|post[- ]?mortem|hotfix){T.RB}"
DECISION = rf"(?i){T.LB}(architecture|adr|trade[- ]?off){T.RB}"
BUMP = rf"(?i){T.LB}bump[\t\n\f\r ]+[^\t\n\f\r ]+[\t\n\f\r ]+from[\t\n\f\r ]+([^\t\n\f\r ]+)[\t\n\f\r ]+to[\t\n\f\r ]+([^\t\n\f\r ]+)"
HEAD_DECISION = rf"(?imd)^#{{2,4}}[\t\n\f\r ]+(decision|rationale|trade[- ]?offs?|architecture|adr|why this matters|why we chose){T.RB}"
HEAD_INCIDENT = rf"(?imd)^#{{2,4}}[\t\n\f\r ]+(incident|outage|post[- ]?mortem|rca|what happened|root cause|hotfix){T.RB}"
HEAD_BREAKING = r"(?imd)^#{2,4}[\t\n\f\r ]+(breaking|migration|backwards[- ]incompat)"
LABELS = {"breaking": ["breaking", "breaking-change"], "incident": ["incident", "post-mortem", "postmortem", "rca"], "decision": ["architecture", "adr", "decision", "design"]}


def major_bumped(subject: Column) -> Column:
    """Whether the text announces a bump between different major versions."""
    a, b = F.regexp_extract(subject, BUMP, 1), F.regexp_extract(subject, BUMP, 2)
    return (a != "") & (T.major_of(a) != T.major_of(b))


def classify_commits(commits: DataFrame) -> DataFrame:
    """``(sha, class, target)`` for each action; a commit has none, one or several.  ``commits``: sha, date, subject, body."""
    s = F.coalesce("subject", F.lit(""))
    full = F.concat(s, F.lit("\n"), F.coalesce("body", F.lit("")))
    day = F.date_format("date", "yyyy-MM-dd")
    act = lambda cls, cond, target: F.when(cond, F.struct(F.lit(cls).alias("class"), target.alias("target")))
    actions = F.array_compact(F.array(
        act("breaking", full.rlike(BREAKING_FOOTER) | s.rlike(BREAKING_BANG), F.lit("log.md")),
        act("incident", s.rlike(INCIDENT), F.concat(F.lit("investigations/"), T.slugify(F.concat(day, F.lit("-"), T.first_words(s, 5))), F.lit(".md"))),
        act("decision", s.rlike(DECISION), F.concat(F.lit("decisions/"), T.slugify(T.first_words(s, 6)), F.lit(".md"))),
        act("dependency", major_bumped(s), F.lit("log.md")),
    ))
    return commits.select("sha", F.explode(actions).alias("a")).select("sha", "a.*")


def shortened(text: Column, n: int) -> Column:
    """``text`` trimmed; of more than ``n`` bytes ``n - 1``, without a character cut in two, and an ellipsis."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return T.head_bytes(t, n, n - 1)


#: The templates of log blocks and pages; names in braces are columns.
COMMIT_BLOCK = "## [{day}] {class}: {short}\n\n- commit: `{sha7}`\n- subject: {subject}\n"
COMMIT_PAGE = "---\ntags: [{class}, git-ingest]\nlast_verified: {day}\nstatus: current\n---\n\n# {title}\n\n> Auto-imported from commit {sha7}. {hint}\n\n## {section}\n\n{text}\n\n## Sources\n\n- commit: `{sha}`\n\n## See Also\n\n- [[log]]\n"
PR_BLOCK = "## [{day}] {class}: pr#{number} {short}\n\n- author: @{login}\n- url: {url}\n- title: {title_}\n"
PR_PAGE = "---\ntags: [{class}, github-ingest]\nlast_verified: {day}\nstatus: current\npr_number: {number}\n---\n\n# {title}\n\n> Auto-imported from PR #{number}{when}. {hint}\n\n## {section}\n\n{text}\n\n## Sources\n\n- pr: {url}\n- merged: {merged}\n- author: @{login}\n\n## See Also\n\n- [[log]]\n"
HINTS = {"commit": ("Replace this with a real post-mortem.", "Edit to match the real ADR shape."), "pr": ("Replace with a real post-mortem when ready.", "Edit to match the real ADR shape.")}


def filled(template: str, **values: Column) -> Column:
    """A template with columns in place of the names in braces."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(values[p].cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def _by_class(incident: str, other: str) -> Column:
    return F.when(F.col("class") == "incident", incident).otherwise(other)


def log_blocks(commits: DataFrame, classes: tuple[str, ...] = ("breaking", "dependency")) -> DataFrame:
    """``(sha, class, block)``: the blocks that commits append to the log."""
    b = classify_commits(commits).where(F.col("class").isin(*classes)).join(commits, "sha")
    block = filled(COMMIT_BLOCK, day=F.date_format("date", "yyyy-MM-dd"), **{"class": F.col("class")}, short=shortened(F.col("subject"), 60), sha7=F.substring("sha", 1, 7), subject=F.col("subject"))
    return b.select("sha", "class", block.alias("block"))


def commit_pages(commits: DataFrame) -> DataFrame:
    """``(path, body)``: the pages that incidents and decisions create."""
    b = classify_commits(commits).where(F.col("class").isin("incident", "decision")).join(commits, "sha")
    hint, section = _by_class(*HINTS["commit"]), _by_class("What happened", "Context")
    text = F.coalesce(F.nullif("body", F.lit("")), F.lit("(no commit body)"))
    body = filled(COMMIT_PAGE, **{"class": F.col("class")}, day=F.date_format("date", "yyyy-MM-dd"), title=shortened(F.col("subject"), 80), sha7=F.substring("sha", 1, 7), hint=hint, section=section, text=text, sha=F.col("sha"))
    return b.select(F.col("target").alias("path"), body.alias("body"))


def pr_outputs(routed: DataFrame, prs: DataFrame) -> DataFrame:
    """``(number, outcome, target, text)``: log blocks and pages of routed pull requests.  ``prs`` has url and author besides."""
    r = routed.where(F.col("outcome").isin("log", "page")).join(prs, "number")
    day, login = F.date_format("merged_at", "yyyy-MM-dd"), F.col("author.login")
    common = {"class": F.col("class"), "day": day, "number": F.col("number"), "login": login, "url": F.col("url")}
    block = filled(PR_BLOCK, **common, short=shortened(F.col("title"), 60), title_=F.col("title"))
    when = F.when(F.col("class") == "incident", F.concat(F.lit(" ("), day, F.lit(")"))).otherwise("")
    page = filled(
        PR_PAGE, **common, title=shortened(F.col("title"), 80), when=when, hint=_by_class(*HINTS["pr"]), section=_by_class("What happened", "Context"),
        text=F.coalesce(F.nullif("body", F.lit("")), F.lit("(no PR body)")), merged=F.date_format("merged_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )
    return r.select("number", "outcome", "target", F.when(F.col("outcome") == "log", block).otherwise(page).alias("text"))


def page_numbers(pages: DataFrame) -> DataFrame:
    """``number`` of the pull requests that pages below ``decisions`` and ``investigations`` say they stand for."""
    own = pages.where(F.col("path").rlike(r"(^|/)(decisions|investigations)/[^/]+\.md$"))
    return own.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?md)^[ \t\r]*pr_number: (\d+)[ \t\r]*$"), 1)).alias("n")).select(F.col("n").cast("bigint").alias("number")).distinct()


def classify_prs(prs: DataFrame) -> DataFrame:
    """``prs`` with ``class``: the first rule that holds.  ``prs``: number, title, body, merged_at, labels array<struct<name>>."""
    t, b = F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))
    has = lambda c: F.exists(F.coalesce("labels", F.array().cast("array<struct<name:string>>")), lambda x: F.lower(x["name"]).isin(LABELS[c]))
    cls = (
        F.when(has("breaking"), "breaking").when(has("incident"), "incident").when(has("decision"), "decision")
        .when(F.concat(t, F.lit("\n"), b).rlike(BREAKING_FOOTER) | t.rlike(BREAKING_BANG), "breaking")
        .when(t.rlike(INCIDENT) | b.rlike(HEAD_INCIDENT), "incident").when(t.rlike(DECISION) | b.rlike(HEAD_DECISION), "decision")
        .when(b.rlike(HEAD_BREAKING), "breaking").when(major_bumped(t), "dependency").otherwise("none")
    )
    return prs.withColumn("class", cls)


def route_prs(classified: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``(number, class, outcome, target)``: noise, skipped (a page has its number), page or log.  ``existing``: column number."""
    num, day = F.col("number").cast("string"), F.date_format("merged_at", "yyyy-MM-dd")
    page = F.when(F.col("class") == "incident", F.concat(F.lit("investigations/"), T.slugify(F.concat(day, F.lit("-pr-"), num, F.lit("-"), T.first_words("title", 5))), F.lit(".md"))).when(F.col("class") == "decision", F.concat(F.lit("decisions/"), T.slugify(F.concat(F.lit("pr-"), num, F.lit("-"), T.first_words("title", 6))), F.lit(".md")))
    c = classified
    seen = F.lit(False)
    if existing is not None:
        c = c.join(existing.select("number").distinct().withColumn("_seen", F.lit(True)), "number", "left")
        seen = F.coalesce("_seen", F.lit(False))
    outcome = F.when(F.col("class") == "none", "noise").when(seen, "skipped").when(F.col("class").isin("incident", "decision"), "page").otherwise("log")
    return c.select("number", "class", outcome.alias("outcome"), F.when(outcome == "page", page).when(outcome == "log", F.lit("log.md")).alias("target"))


def parse_since(text: str, now: dt.datetime) -> dt.datetime:
    """A point in time from ``""`` (7 days), ``Nd``, ``N.days.ago``, a duration such as ``36h`` or ``90m``, or an ISO time."""
    t = text.strip()
    if not t:
        return now - dt.timedelta(days=7)
    if m := re.fullmatch(r"(\d+)(?:d|\.days?\.ago)", t):
        return now - dt.timedelta(days=int(m[1]))
    if re.fullmatch(r"(?:\d+(?:\.\d+)?(?:h|ms|m|s))+", t):
        unit = {"h": 3600, "m": 60, "s": 1, "ms": 0.001}
        return now - dt.timedelta(seconds=sum(float(a) * unit[u] for a, u in re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", t)))
    when = dt.datetime.fromisoformat(t.replace("Z", "+00:00"))
    return when.astimezone(dt.timezone.utc).replace(tzinfo=None) if when.tzinfo else when


def valid_repo(name: Column) -> Column:
    """Whether a text has the form OWNER/NAME."""
    return name.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")


def upsert(source: DataFrame, existing: DataFrame) -> DataFrame:
    """``source`` (slug, body) against ``existing`` (slug, body, stored_hash): insert new pages, overwrite pristine ones that changed,
    keep edited ones; ``(slug, action, body)``."""
    e = existing.select("slug", F.col("body").alias("old"), "stored_hash")
    j = source.join(e, "slug", "full_outer")
    pristine = F.sha2(F.coalesce("old", F.lit("")), 256) == F.col("stored_hash")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("body").isNull(), "keep").when(~F.coalesce(pristine, F.lit(False)), "edited").when(F.col("old") == F.col("body"), "unchanged").otherwise("overwrite")
    return j.select("slug", action.alias("action"), F.when(action.isin("insert", "overwrite"), F.col("body")).otherwise(F.col("old")).alias("body"))


def insert_if_absent(source: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return source.join(existing.select(key).distinct(), key, "left_anti")


def replace_by_key(base: DataFrame, fresh: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
    """``base`` with all rows of the keys in ``fresh`` (and ``removed``) replaced by the rows of ``fresh``."""
    gone = fresh.select(key).distinct()
    if removed is not None:
        gone = gone.unionByName(removed.select(key)).distinct()
    return base.join(gone, key, "left_anti").unionByName(fresh)


def receipts(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Calls, bytes returned and bytes of the alternative, what was saved, tokens (bytes / 4) and the ratio.  ``calls``: tool, returned, alternative."""
    g = calls.groupBy(*(by or [])).agg(F.count("*").alias("calls"), F.coalesce(F.sum("returned"), F.lit(0)).alias("returned"), F.coalesce(F.sum("alternative"), F.lit(0)).alias("alternative"))
    saved = F.greatest(F.col("alternative") - F.col("returned"), F.lit(0))
    return g.withColumn("saved", saved).withColumn("tokens_saved", F.floor(saved / 4)).withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("alternative"), F.col("returned")), F.lit(0.0)), 6))


def confidence(answer: Column) -> Column:
    """The digit of the first ``confidence: d/5``, 0 if there is none from 1 to 5."""
    d = F.regexp_extract(F.lower(answer), r"confidence:[\t ]*(\d)/5", 1)
    return F.when(d.isin("1", "2", "3", "4", "5"), d.cast("int")).otherwise(0)


def humanized(origin: Column) -> Column:
    """A title from a path: the file's stem with spaces for ``-`` and ``_``, its first letter a capital."""
    stem = F.regexp_replace(F.regexp_replace(F.substring_index(origin, "/", -1), r"\.md$", ""), "[-_]", " ")
    return F.when(stem == "", "Imported page").otherwise(F.concat(F.upper(F.substring(stem, 1, 1)), F.substring(stem, F.lit(2), F.lit(2147483647))))


def _cut_line(lines: list[str], k: int) -> list[str]:
    """``lines`` without number ``k`` and the blank ones right after it."""
    after = next((n for n in range(k + 1, len(lines)) if lines[n].strip()), len(lines))
    return lines[:k] + lines[after:]


def page_around(origin: str, text: str | None, repo: str, day: str, page_type: str) -> str:
    """A wiki page around an imported document: front matter with the hash of the page's body; its title (the first heading, else from
    the path); its summary (a quote within the first five filled lines, else its first prose, else a note); the rest; sources and
    links where it has none."""
    lines = re.sub(r"\A---\n.*?\n---\n", "", text or "", flags=re.S).lstrip("\n").split("\n")
    stem = re.sub(r"\.md$", "", origin.rpartition("/")[2]).translate(str.maketrans("-_", "  "))
    title = ""
    if (at := next((k for k, x in enumerate(lines) if x.startswith("# ")), None)) is not None:
        title, lines = lines[at][2:].strip(), _cut_line(lines, at)
    title = title or (stem[:1].upper() + stem[1:] if stem else "Imported page")
    filled = [k for k, x in enumerate(lines) if x.strip()][:5]
    summary = ""
    if (at := next((k for k in filled if lines[k].startswith("> ")), None)) is not None:
        summary, lines = lines[at][2:].strip(), _cut_line(lines, at)
    if not summary:
        prose = next((x.strip() for x in lines if x.strip() and not x.strip().startswith(("#", "```", "|"))), "")
        summary = m[0] if (m := re.match(r"[^.!?]{21,}[.!?]", prose)) else prose
        if len(summary.encode()) > 200:
            summary = summary.encode()[:197].decode("utf-8", "ignore") + "…"
    body = "\n".join(lines)
    page = f"# {title}\n\n> {summary or f'Imported from {repo}/{origin} — review and edit'}\n\n" + body.rstrip("\n") + "\n"
    has = lambda head: re.search(rf"(?m)^## {head}(?![A-Za-z0-9_])", body)
    page += "" if has("Sources") else f"\n## Sources\n\n- `{repo}/{origin}`\n"
    page += "" if has("See Also") else "\n## See Also\n\n- [[index]]\n"
    digest = hashlib.sha256(page.encode("utf-8", "surrogatepass")).hexdigest()
    return f'---\ntags: [imported, {repo}]\nlast_verified: {day}\nstatus: current\ncited_files: ["{repo}/{origin}"]\npage_type: {page_type}\npristine_hash: {digest}\n---\n\n{page}'


def imported_page(origin: Column, text: Column, repo: str, day: str = "1970-01-01", page_type: str = "narrative") -> Column:
    """``page_around`` for a column, in batches: as one expression it would be computed anew for each of its parts."""

    @F.pandas_udf("string")
    def build(o: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else page_around(a, b, repo, day, page_type) for a, b in zip(o, t)], dtype=object)

    return build(origin, text)


def human_bytes(n: Column) -> Column:
    """A number of bytes for readers."""
    of = lambda unit, name: F.concat(F.format_string("%.1f", F.bround(n / F.lit(float(unit)), 1)), F.lit(" " + name))
    return F.when(n < 0, "0 B").when(n >= 1 << 20, of(1 << 20, "MiB")).when(n >= 1 << 10, of(1 << 10, "KiB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def safe_inverse(r: Column) -> Column:
    return F.when(r > 0, F.try_divide(F.lit(1.0), r)).otherwise(0.0)


def indent_quote(text: Column) -> Column:
    """``text`` as a quote, each line after ``> ``."""
    return F.concat(F.lit("> "), F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n", "\n> "))
