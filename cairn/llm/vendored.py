"""Problem 1: files that nobody wrote by hand in their repository.

Method: every file becomes a tree of code blocks (comments removed, white space folded), and Merkle hashes are computed
bottom-up: blocks -> file -> directory -> ... -> repository root.  A subtree (block, file or directory) that occurs in
two unrelated repositories marks vendored code; copies with small changes keep most of their blocks, so a file counts as
vendored when at least half of its code lies in shared blocks.  Repositories that share half of their files (forks, mirrors) are one
family and not unrelated.  The folders of package managers and headers of other projects mark their own files and, by the hashes,
copies elsewhere; folders whose names only suggest third-party code are seeds for the hashes: a block of theirs that occurs in any
other file is foreign.  Header and layout rules find generated, minified and data files.

Scale: one Python pass over the contents yields a few hundred bytes a file; contents are never shuffled.  Hash groups
are reduced by ``min``/``max``/``sum`` aggregates with map-side combine (no lists are collected), joins on hashes and directories
are salted where they are hot, so one block in a third of all files, or the root of a repository with a third, is no hot key.
Directories are hashed level by level, whatever their depth; lineage is cut every few levels.

Defined results: null or empty path - the row is ignored; null or empty content - the file is in no class; exact copies
of a row and several versions of a path are one file, which is in a class if any version is; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.codescan import blank, language_of
from cairn.operators.lineage import bounded, cut, stage
from cairn.operators.skew import salted_join

#: Directories that package managers and their conventions keep for third-party code.
VENDOR_DIRS = (
    "vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "node_modules",
    "bower_components", "godeps", "site-packages", "jspm_packages", "dist-packages",
)
#: Names of directories in which third-party code is often kept, but own code as well.
SEED_DIRS = ("external", "extern", "externals", "deps", "contrib")
#: Notices by which a tool says that it wrote the file (lower case, within a comment at the top or bottom).
GENERATED_NOTICES = (
    r"code generated (?:by|from)\b", r"@generated\b", r"<auto-?generated", r"\bauto-?generated (?:file|by|from|code)\b",
    r"\bthis (?:file|code|class|module) (?:is|was|has been) (?:\w+ )?(?:produced|generated|emitted|created) by\b",
    r"\bgenerated (?:on \d|from|by|automatically)", r"\b(?:emitted|produced) by \S+ (?:\(|from)", r"\bdo not (?:modify|edit)\b.*\b(?:emitted|generated|produced)\b",
    r"\b(?:generated|emitted|produced)\b.*\b(?:do not|don't) (?:modify|edit)\b", r"\bchanges (?:to this file )?(?:are|will be) (?:lost|overwritten)\b",
    r"\bmanual changes\b.*\boverwritten\b", r"\berzeugt\b.*\bnicht\b.*\bbearbeiten\b", r"\bautomatisch (?:erzeugt|generiert)\b",
    r"\b(?:produit|généré) par\b.*\bne pas modifier\b", r"\bgenerado (?:por|automáticamente)\b",
)
#: Names that generators give to their output.
GENERATED_NAMES = re.compile(r"(?:\.pb\.\w+|_pb2?(?:_grpc)?\.\w+|\.pb\.go|\.g\.\w+|\.gen\.\w+|_gen\.\w+|\.generated\.\w+|_generated\.\w+|Grpc\.java|_string\.go)$")
MINIFIED_NAMES = re.compile(r"[.\-](?:min|bundle|packed|pack|chunk)\.(?:js|ts|mjs|cjs|css)$")
#: Headers with which third-party projects name themselves.
FOREIGN_HEADERS = (
    r"\bpart of the \S+ (?:package|library|distribution|project)\b.*\brelease\b", r"\bupstream (?:revision|commit|version|url)\b",
    r"\bcontributors, (?:released|licensed) under\b", r"\bfound in the \S+ distribution\b", r"\b(?:vendored|copied|imported) from \S+",
)

_NOTICE = re.compile("|".join(f"(?:{p})" for p in GENERATED_NOTICES))
_FOREIGN = re.compile("|".join(f"(?:{p})" for p in FOREIGN_HEADERS))
_STRIP = re.compile(r"^[\s/*#!;\-]+|[\s*/\-]+$")
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|\S")
_IDENT = re.compile(r"[^\W\d]\w*")
_STATEMENT = re.compile(r"\b(?:if|for|while|return|def|func|fn|function|fun|class|switch|raise|throw|try)\b")
_DIGITS = re.compile(r"\d+")
_CALLED = re.compile(r"(?<=[.>])\w{7,}|_{2,}")
#: Blocks shorter than this many characters say nothing about where code comes from.
MIN_BLOCK = 60
#: Share of a file's code in blocks that unrelated repositories share, from which on it counts as taken over.
SHARED_SHARE = 0.5

SCHEMA = (
    "path string, repo string, by_notice boolean, by_layout boolean, minified boolean, data boolean, foreign boolean, seed boolean, "
    "code_hash bigint, code_len bigint, blocks array<struct<h:bigint,n:int>>"
)


def _one_statement_shapes(code: list[str], lang: str) -> tuple[int, float]:
    """Number of functions; the share of them whose bodies repeat the commonest body shapes of the file, or, where that is
    more, the share whose bodies have one statement at most."""
    shapes: list[tuple[str, ...]] = []
    if lang == "py":
        i = 0
        while i < len(code):
            m = re.match(r"(\s*)(?:async )?def ", code[i])
            i += 1
            if m:
                body = []
                while i < len(code) and (not code[i].strip() or len(code[i]) - len(code[i].lstrip()) > len(m[1])):
                    if code[i].strip(" _\t"):
                        body.append(code[i])
                    i += 1
                shapes.append(tuple(body))
    else:
        opener = re.compile(r"\)[^(){};]*\{\s*$" if lang != "rb" else r"^\s*def\b")
        closer = re.compile(r"^\s*\}" if lang != "rb" else r"^\s*end\b")
        i = 0
        while i < len(code):
            if opener.search(code[i]) and not re.match(r"\s*(?:\}\s*)?(?:if|for|while|switch|else|catch|match|loop|try)\b", code[i]):
                indent, body, i = len(code[i]) - len(code[i].lstrip()), [], i + 1
                while i < len(code) and not (closer.match(code[i]) and len(code[i]) - len(code[i].lstrip()) <= indent):
                    if code[i].strip(" _\t"):
                        body.append(code[i])
                    i += 1
                shapes.append(tuple(body))
            i += 1
    if not shapes:
        return 0, 0.0

    def norm(body: tuple[str, ...]) -> str:
        # A run of equal statements counts once: generators unroll loops.
        lines = [_DIGITS.sub("0", _CALLED.sub("x", x.strip())) for x in body]
        return "\n".join(x for k, x in enumerate(lines) if k == 0 or x != lines[k - 1])

    common = Counter(map(norm, shapes)).most_common(4)
    short = sum(len(x) <= 1 for x in shapes) / len(shapes)
    return len(shapes), max(sum(n for s, n in common if s and n > 1) / len(shapes), short if short >= 0.95 and len(shapes) >= 5 else 0)


def file_features(path: str, text: str) -> dict:
    """The features of one file; never fails on odd input."""
    name = path.rpartition("/")[2]
    parts = [p.lower() for p in path.split("/")[1:-1]]
    lang = language_of(path)
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    out = {
        "path": path, "repo": path.split("/")[0], "by_notice": False, "by_layout": False, "minified": False, "data": False,
        "foreign": any(p in VENDOR_DIRS for p in parts), "seed": any(p in SEED_DIRS for p in parts), "code_hash": None, "code_len": 0, "blocks": [],
    }
    if not text.strip():
        return out
    blanked, comments, _ = blank(lang, text) if lang else (text, [], [])
    kept, at = [], 0
    for s, e, _k in comments:
        kept.append(text[at:s])
        at = e
    kept.append(text[at:])
    bare = "".join(kept)
    # Notices: comments before the first code and after the last code.
    code_from = next((m.start() for m in re.finditer(r"\S", blanked)), len(text))
    code_to = len(blanked.rstrip())
    lines: list[str] = []
    head_lines: list[str] = []
    for s, e, _k in comments:
        if s <= code_from or s >= code_to or text.count("\n", 0, s) < 12 and s - code_from < 40:
            ls = [_STRIP.sub("", x).strip().lower() for x in text[s:e].split("\n")]
            lines += ls
            if s <= code_from:
                head_lines += ls
    out["by_notice"] = any(_NOTICE.search(x) for x in lines if not re.search(r"method stub|\btemplates? for\b|written by hand|hand-?written", x)) or bool(_NOTICE.search(" ".join(head_lines[:8])) and not re.search(r"method stub|templates? for|written by hand", " ".join(head_lines[:8])))
    out["foreign"] |= any(_FOREIGN.search(x) for x in head_lines) or bool(_FOREIGN.search(" ".join(head_lines[:6])))
    # Layout: many functions, all of the same few shapes.
    code = blanked.split("\n")
    n_fun, same = _one_statement_shapes(code, lang)
    out["by_layout"] = n_fun >= 4 and same >= (0.6 if GENERATED_NAMES.search(name) else 0.9)
    # Compressed for shipping: dense lines of one-letter names.
    dense = [x for x in bare.split("\n") if x.strip()]
    size = sum(map(len, dense))
    if lang in ("js", "ts", "") and size >= 200:
        idents = _IDENT.findall(blanked)
        short = sum(len(x) <= 2 for x in idents) / max(1, len(idents))
        spaces = sum(x.count(" ") + x.count("\t") for x in dense) / size
        mean = size / max(1, len(dense))
        named = bool(MINIFIED_NAMES.search(name))
        out["minified"] = (mean > (60 if named else 110) and spaces < 0.12 and short > 0.4) or (mean > 500 and spaces < 0.08 and n_fun < 3)
    # A blob of data: next to nothing but literals.  Files with statements are none, whatever their tokens.
    statements = len(_STATEMENT.findall(blanked))
    if size >= 300 and statements <= 2 + len(text) // 4000:
        toks = _TOKEN.findall(re.sub(r"_{2,}", " ", blanked)) if lang else []
        strings = sum(len(m.group(0)) for m in re.finditer(r"_{2,}", blanked))
        words = [t for t in toks if t[0].isalpha()]
        numbers = sum(len(t) for t in toks if t[0].isdigit())
        literal = strings + numbers
        total = sum(map(len, toks)) + strings
        out["data"] = statements <= 2 + total // 4000 and literal > 0.5 * total and len(words) < 0.2 * max(1, len(toks)) + 20
    # The leaves of the Merkle tree.
    blocks = [b for b in (" ".join(x.split()) for x in re.split(r"\n[ \t]*\n", bare)) if len(b) >= MIN_BLOCK]
    whole = " ".join(bare.split())
    signed = lambda b: xxhash.xxh64_intdigest(b.encode("utf-8", "replace")) - (1 << 63)
    out["code_hash"], out["code_len"] = signed(whole), len(whole)
    out["blocks"] = [{"h": signed(b), "n": len(b)} for b in blocks]
    return out


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [c.split()[0] for c in re.sub(r"<.*?>>?", "", SCHEMA).split(", ")]
    for pdf in batches:
        yield pd.DataFrame([file_features(p, c) for p, c in zip(pdf["path"], pdf["content"]) if p], columns=cols)


def features(source_files: DataFrame) -> DataFrame:
    """One row of features for each row of ``source_files`` with a path."""
    return source_files.select("path", "content").where("path is not null and path != ''").mapInPandas(_features, SCHEMA)


#: Levels of directories that are hashed between two cuts of the lineage.
LEVELS = 4


def merkle_directories(files: DataFrame) -> DataFrame:
    """``(node, repo, hash, size)`` of every directory, by one aggregate a level, deepest first.

    ``files``: ``(path, code_hash, code_len)``.  The hash of a directory is an order-free digest (sum, xor and count) of its children's
    (name, hash), so no list of children is ever built, and a directory with a third of all files is reduced map-side."""
    level = files.select(
        F.regexp_replace("path", "/[^/]*$", "").alias("parent"), F.substring_index("path", "/", -1).alias("name"), F.col("code_hash").alias("hash"), F.col("code_len").alias("size"), (F.size(F.split("path", "/")) - 1).alias("depth")
    ).where("depth > 0")
    depth = level.agg(F.max("depth")).first()[0] or 0
    columns = "node string, hash bigint, size bigint, depth int"
    done = up = files.sparkSession.createDataFrame([], columns)
    for top in range(depth, 0, -LEVELS):
        # A stretch of levels is one job: each level is used twice, which the planner's reuse of exchanges computes once.
        part: list[DataFrame] = []
        for d in range(top, max(0, top - LEVELS), -1):
            children = level.where(F.col("depth") == d).select("parent", "name", "hash", "size").unionByName(up.where(F.col("depth") == d + 1).select(F.regexp_replace("node", "/[^/]*$", "").alias("parent"), F.substring_index("node", "/", -1).alias("name"), "hash", "size"))
            here = (
                children.groupBy("parent")
                .agg(F.sum(F.xxhash64("name", "hash").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("hash", "name")).alias("x"), F.count("*").alias("n"), F.sum("size").alias("size"))
                .select(F.col("parent").alias("node"), F.xxhash64(F.col("s").cast("string"), "x", "n").alias("hash"), "size", F.lit(d).alias("depth"))
            )
            part.append(here)
            up = here
        stretch = cut(functools.reduce(DataFrame.unionByName, part))
        up, done = stretch, done.unionByName(stretch)
    return done.select("node", F.substring_index("node", "/", 1).alias("repo"), "hash", "size")


def families(files: DataFrame, *, least: int = 10, share: float = 0.5) -> DataFrame | None:
    """``(repo, family)`` of repositories that share at least ``least`` files, and the share ``share`` of those of the smaller one, with
    another; the family is the smallest name.  None if there are none.

    ``files``: ``(repo, code_hash)``, distinct.  Of each hash the first and the last repository are looked at, so the work is linear."""
    n = files.groupBy("repo").agg(F.count("*").alias("n"))
    both = files.groupBy("code_hash").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("both")).where(F.col("both") >= least)
    pairs = cut(both.join(n.select(F.col("repo").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("repo").alias("b"), F.col("n").alias("nb")), "b").where(F.col("both") >= share * F.least("na", "nb")).select("a", "b"))
    if pairs.isEmpty():
        return None
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = links.groupBy(F.col("a").alias("repo")).agg(F.least(F.min("b"), F.col("repo")).alias("family"))
    while True:
        near = links.join(label.select(F.col("repo").alias("b"), "family"), "b").groupBy(F.col("a").alias("repo")).agg(F.min("family").alias("near"))
        after = cut(label.join(near, "repo").select("repo", F.least("family", "near").alias("family"), (F.col("near") < F.col("family")).alias("moved")))
        label = after.select("repo", "family")
        if after.where("moved").isEmpty():
            return label


def classify_files(source_files: DataFrame, *, min_subtree: int = 200) -> DataFrame:
    """``(file, generated, minified, vendored, data)`` for every file of ``source_files``.

    ``min_subtree``: characters of code from which on a shared file or directory says something."""
    f = stage(features(source_files), "p1-features")
    one = f.where("code_hash is not null").select("path", "repo", "code_hash", "code_len").distinct()
    related = families(one.where(F.col("code_len") >= min_subtree).select("repo", "code_hash").distinct())

    def with_family(df: DataFrame) -> DataFrame:
        if related is None:
            return df.withColumn("family", F.col("repo"))
        return df.join(bounded(related), "repo", "left").withColumn("family", F.coalesce("family", "repo"))

    nodes = with_family(merkle_directories(one).unionByName(one.select(F.col("path").alias("node"), "repo", F.col("code_hash").alias("hash"), F.col("code_len").alias("size"))))
    shared = nodes.where(F.col("size") >= min_subtree).groupBy("hash").agg(F.min("family").alias("a"), F.max("family").alias("b")).where("a <> b").select("hash")
    shared_nodes = salted_join(nodes.select("node", "hash"), shared, ["hash"], "left_semi").select("node").distinct()
    # Every file below a shared node: a file has as many ancestors as its path has parts.
    above = one.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.concat_ws("/", F.slice(F.split("path", "/"), F.lit(1), k)))).alias("node"))
    under = salted_join(above, shared_nodes, ["node"], "left_semi").select("path").distinct().withColumn("in_subtree", F.lit(True))
    blocks = f.select("path", "repo", "foreign", "seed", F.explode("blocks").alias("b")).select("path", "repo", "foreign", "seed", "b.h", "b.n").distinct()
    known = (
        with_family(blocks).groupBy("h")
        .agg(F.min("family").alias("a"), F.max("family").alias("b"), F.min("path").alias("p"), F.max("path").alias("q"), F.max("foreign").alias("foreign"), F.max("seed").alias("seed"))
        .where("a <> b or foreign or seed and p <> q").select("h")
    )
    share = (
        salted_join(blocks.select("path", "h", "n"), known.withColumn("known", F.lit(1)), ["h"], "left_outer")
        .groupBy("path")
        .agg((F.sum(F.when(F.col("known") == 1, F.col("n"))) / F.sum("n")).alias("share"))
        .where(F.col("share") >= SHARED_SHARE)
        .select("path", F.lit(True).alias("in_blocks"))
    )
    base = f.groupBy("path").agg(F.max(F.col("by_notice") | F.col("by_layout")).alias("generated"), F.max("minified").alias("minified"), F.max("foreign").alias("foreign"), F.max("data").alias("data"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        base.join(under, "path", "left")
        .join(share, "path", "left")
        .select(F.col("path").alias("file"), yes("generated").alias("generated"), yes("minified").alias("minified"), (yes("foreign") | yes("in_subtree") | yes("in_blocks")).alias("vendored"), yes("data").alias("data"))
    )
