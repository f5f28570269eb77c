"""Text encoders that shorten pages, pipelines of them, page types, and the search for the best pipeline.

Encoders are column expressions on a text column; the glossary is fitted first (one aggregate, at most 256 rows come to the
driver).  Null text stays null; empty text gives what the encoder says of nothing (the tuple encoder: its name line)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import LB, RB, WS
from cairn.operators.lineage import bounded, stage

#: Phrases and what stands for them, in this order.
PHRASES = (
    ("in order to", "to"), ("due to the fact that", "because"), ("in spite of", "despite"), ("as well as", "and"), ("such that", "so"), ("so that", "so"), ("does not", "not"),
    ("do not", "not"), ("is not", "not"), ("are not", "not"), ("cannot", "cant"), ("can not", "cant"), ("will not", "wont"),
)
#: Words that are dropped.
DROPPED = """a an the is are was were be been being am do does did doing done has have had having just really basically actually simply
very quite rather somewhat perhaps maybe probably essentially literally honestly obviously clearly kind sort please thanks thank kindly
also however though although thus hence therefore moreover furthermore additionally besides indeed""".split()
#: Words that the tuple encoder does not count.
TUPLE_STOPS = "self cls None True False def class return if else for while import from as in is not and or".split()
#: How a signature line starts, and the extensions of code.
SIGNATURE_STARTS = ("def ", "class ", "function ", "func ", "fn ", "async def ")
CODE_EXTENSIONS = "py pyx go js jsx mjs cjs ts tsx rs java kt rb c h cpp cc hpp swift scala".split()
MIN_FREQ, MIN_LEN, MAX_ENTRIES, PREFIX = 8, 8, 256, "g"
TOP_CARD, DOC_CHARS, TOP_TUPLE, CAP = 30, 160, 12, 4.5
#: The pipelines of the grid, in order.
CANDIDATES = ("raw", "caveman", "glossary", "glossary,caveman", "structural-card", "glossary,structural-card", "dense-tuple")


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def caveman(c: Column) -> Column:
    """Phrases rewritten, filler words dropped, white space folded."""
    for phrase, to in PHRASES:
        c = F.regexp_replace(c, f"(?i){LB}{phrase}{RB}", to)
    # A token reaches over apostrophes and hyphens between its letters; only whole tokens are dropped.
    c = F.regexp_replace(c, f"(?i){LB}(?<![A-Za-z0-9_]['-])(?:{'|'.join(DROPPED)}){RB}(?!['-]+[A-Za-z0-9_])", "")
    return trim_space(F.regexp_replace(F.regexp_replace(c, WS + "+", " "), WS + "+([,.;:!?])", "$1"))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("([A-Za-z0-9_]+)"), 1)


def fit_glossary(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """``(*by, token, n, code)``: per group the identifiers that are long and frequent, most saving first, at most 256."""
    by = by or []
    tok = df.select(*by, F.explode(_words(F.col(text))).alias("token")).where(F.col("token").rlike("^[A-Za-z_]") & (F.octet_length("token") >= MIN_LEN))
    counts = tok.groupBy(*by, "token").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_FREQ)
    w = Window.partitionBy(*by).orderBy((F.col("n") * F.octet_length("token")).desc(), "token")
    return counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= MAX_ENTRIES).select(*by, "token", "n", F.concat(F.lit(PREFIX), (F.col("rn") - 1).cast("string")).alias("code"))


def apply_glossary(c: Column, glossary: Column) -> Column:
    """Whole words that are keys of the map ``glossary`` replaced by their codes."""
    words, gaps = _words(c), F.split(c, "[A-Za-z0-9_]+", -1)
    parts = F.zip_with(gaps, words, lambda g, w: F.concat(F.coalesce(g, F.lit("")), F.coalesce(F.element_at(glossary, w), w, F.lit(""))))
    return F.array_join(parts, "")


def top_tokens(df: DataFrame, key: str, tokens: Column, n: int) -> DataFrame:
    """``(key, top)``: the ``n`` most frequent tokens of each row, ties by token."""
    counts = df.select(key, F.explode(tokens).alias("t")).groupBy(key, "t").agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "t")
    best = counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return best.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "t"))), lambda x: x["t"]).alias("top"))


def signature_line(c: Column) -> Column:
    """The first line that starts like a definition, else the first line."""
    lines = F.transform(F.split(c, "\n", -1), trim_space)
    starts = lambda t: F.concat(t, F.lit("")).rlike("^(" + "|".join(SIGNATURE_STARTS) + ")")
    hit = F.element_at(F.filter(lines, starts), 1)
    cut = F.instr(c, "\n")
    first = trim_space(F.when(cut > 1, F.substring(c, F.lit(1), cut - 1)).otherwise(c))
    return F.when(F.exists(lines, starts), hit).otherwise(first)


def doc_line(c: Column, chars: int = DOC_CHARS) -> Column:
    """The first sentence of the first docstring."""
    said = trim_space(F.regexp_extract(c, "(?s)(\"\"\"|''')\\s*([^\"']+?)([.\\n]|\"\"\"|''')", 2))
    return F.substring(F.split_part(said, F.lit("\n"), F.lit(1)), 1, chars)


def card(df: DataFrame, key: str, text: str, out: str = "encoded") -> DataFrame:
    """``(key, out)``: signature, first docstring sentence and the most frequent identifiers."""
    top = top_tokens(df, key, F.regexp_extract_all(F.regexp_replace(F.col(text), "[^A-Za-z0-9_]+", " "), F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1), TOP_CARD)
    c = F.col(text)
    parts = F.filter(F.array(signature_line(c), doc_line(c), F.coalesce(F.array_join("top", " "), F.lit(""))), lambda p: p != "")
    return df.join(top, key, "left").select(key, F.array_join(parts, " ").alias(out))


#: What a definition's header looks like in three languages.
_PY = r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(([^)]*)\)(?:\s*->\s*([^:]+?))?\s*:"
_JS = r"(?m)^\s*(?:async\s+)?function\s+([A-Za-z_]\w*)\s*\(([^)]*)\)"
_GO = r"(?m)^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(([^)]*)\)\s*([^{]*)\{"


def dense_tuple(df: DataFrame, key: str, text: str, out: str = "encoded") -> DataFrame:
    """``(key, out)``: statements ``name param x``, ``name returns t``, ``name uses ident`` joined by ``. ``."""
    c = F.col(text)
    first = lambda rx, g: F.regexp_extract(c, rx, g)
    def pick(g: int) -> Column:
        js = F.lit("") if g == 3 else first(_JS, g)
        return F.when(first(_PY, 1) != "", first(_PY, g)).when(first(_JS, 1) != "", js).when(first(_GO, 1) != "", first(_GO, g)).otherwise(F.lit("_" if g == 1 else ""))
    d = df.select(key, text, pick(1).alias("name_"), pick(2).alias("params_"), trim_space(pick(3)).alias("returns_"))
    stops = F.array(*map(F.lit, TUPLE_STOPS))
    toks = F.filter(_words(c), lambda t: t.rlike("^[A-Za-z_]") & (F.length(t) >= 3) & ~F.array_contains(stops, t) & (t != F.col("name_")))
    top = top_tokens(d, key, toks, TOP_TUPLE)
    raw = F.transform(F.split("params_", ","), trim_space)
    param = F.filter(F.transform(raw, lambda p: F.when(p.rlike("^[^:=]+[:=]"), trim_space(F.regexp_extract(p, "(?s)^([^:=]+)[:=]", 1))).otherwise(p)), lambda p: (p != "") & ~p.isin("self", "cls", "*", "/"))
    say = lambda verb, v: F.concat(F.col("name_"), F.lit(f" {verb} "), v)
    triples = F.concat(
        F.array(say("name", F.col("name_"))), F.transform(param, lambda p: say("param", p)), F.when(F.col("returns_") != "", F.array(say("returns", F.col("returns_")))).otherwise(F.array().cast("array<string>")),
        F.transform(F.coalesce("top", F.array().cast("array<string>")), lambda t: say("uses", t)),
    )
    return d.join(top, key, "left").select(key, F.concat(F.array_join(triples, ". "), F.lit(".")).alias(out))


def parse_pipeline(spec: str) -> list[str]:
    """The encoders of a pipeline in order; raises on unknown names."""
    alias = {"": None, "none": None, "raw": None, "markdown": None, "caveman": "caveman", "md-caveman": "caveman", "glossary": "glossary", "glossary-dedupe": "glossary", "structural-card": "structural-card", "card": "structural-card", "dense-tuple": "dense-tuple", "tuple": "dense-tuple"}
    out = []
    for part in spec.replace("+", ",").split(","):
        name = part.strip().lower()
        if name not in alias:
            raise ValueError(f"unknown encoder {part!r}")
        if alias[name]:
            out.append(alias[name])
    return out


def by_name(spec: str) -> list[str]:
    """``parse_pipeline``, but a pipeline with an unknown name passes texts through."""
    try:
        return parse_pipeline(spec)
    except ValueError:
        return []


def run_pipeline(df: DataFrame, key: str, text: str, spec: str, by: list[str] | None = None) -> DataFrame:
    """``(key, encoded)`` of each row; a glossary is fitted on what reaches it, per group of ``by``."""
    by = by or []
    cur = df.select(key, *by, F.col(text).alias("encoded"))
    for step in parse_pipeline(spec):
        if step == "caveman":
            cur = cur.withColumn("encoded", caveman(F.col("encoded")))
        elif step == "glossary":
            # At most 256 entries a group: a map column, joined by group - broadcast if the groups are few - or one row.
            codes = fit_glossary(cur, "encoded", by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("token", "code"))).alias("codes"))
            joined = cur.join(bounded(codes), by, "left") if by else cur.crossJoin(F.broadcast(codes))
            cur = joined.withColumn("encoded", F.coalesce(apply_glossary(F.col("encoded"), F.col("codes")), F.col("encoded"))).drop("codes")
        else:
            cur = cur.drop("encoded").join((card if step == "structural-card" else dense_tuple)(cur, key, "encoded"), key)
    return cur.select(key, *by, "encoded")


def page_type(body: Column, cited: Column) -> Column:
    """``function``, ``entity`` or ``narrative`` from the cited files' extensions and the shape of the body."""
    ext = lambda f: F.lower(F.regexp_extract(f, r"\.([^./]+)$", 1)).isin(CODE_EXTENSIONS)
    code = body.rlike(r"(?m)^\s*(?:async\s+)?(?:def|func|function|fn)\s+[A-Za-z_]\w*\s*[(<]") | body.rlike(r"(?m)^\s*(?:class|impl)\s+[A-Za-z_]\w*[\s({:<]")
    facts = F.regexp_count(body, F.lit(r"(?m)^\s*[-*]\s+\*?\*?[A-Za-z][A-Za-z0-9_/\- ]{0,40}\*?\*?\s*[:—]\s*\S"))
    filled = F.size(F.filter(F.split(body, "\n", -1), lambda x: trim_space(x) != ""))
    return F.when(F.exists(F.coalesce(cited, F.array().cast("array<string>")), ext) | code, "function").when((facts >= 4) & (facts / F.greatest(filled, F.lit(1)) >= 0.5), "entity").otherwise("narrative")


def grid(df: DataFrame, key: str, text: str, by: list[str] | None = None, candidates: tuple[str, ...] = CANDIDATES) -> DataFrame:
    """``(*by, ord, pipeline, n_pages, raw_bytes, enc_bytes, ratio)`` for each candidate, the best ratio first.

    Texts, and what the first encoder makes of them where several candidates begin with it, are written once and read by all."""
    by = by or []
    base = stage(df.select(key, *by, F.col(text).alias("encoded")), "grid")
    steps = [parse_pipeline(spec) for spec in candidates]
    firsts = [p[0] for p in steps if p]
    shared = {f: stage(run_pipeline(base, key, "encoded", f, by), "grid") for f in dict.fromkeys(firsts) if firsts.count(f) > 1}
    raw = base.groupBy(*by).agg(F.count("*").alias("n_pages"), F.coalesce(F.sum(F.octet_length("encoded")), F.lit(0)).alias("raw_bytes"))
    out: DataFrame | None = None
    for i, (spec, p) in enumerate(zip(candidates, steps)):
        done = run_pipeline(shared[p[0]], key, "encoded", ",".join(p[1:]), by) if p and p[0] in shared else run_pipeline(base, key, "encoded", spec, by)
        enc = done.groupBy(*by).agg(F.coalesce(F.sum(F.octet_length("encoded")), F.lit(0)).alias("enc_bytes"))
        one = (raw.join(enc, by) if by else raw.crossJoin(enc)).select(*by, F.lit(i).alias("ord"), F.lit(spec).alias("pipeline"), "n_pages", "raw_bytes", "enc_bytes")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("raw_bytes"), F.col("enc_bytes")), F.lit(0.0)), 6)).orderBy(*by, F.desc("ratio"), "ord")


def best_under_cap(g: DataFrame, by: list[str], cap: float = CAP) -> DataFrame:
    """The highest ratio in (0, cap] per group, the earlier candidate on ties."""
    w = Window.partitionBy(*by).orderBy(F.desc("ratio"), "ord")
    return g.where((F.col("ratio") > 0) & (F.col("ratio") <= cap)).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def encode_by_type(df: DataFrame, key: str, text: str, type_col: str, pipelines: dict[str, str]) -> DataFrame:
    """``(key, encoded)``: each row through the pipeline of its page type; types without one, or with one that is unknown, stay as they are."""
    out: DataFrame | None = None
    handled = []
    for kind, spec in pipelines.items():
        try:
            parse_pipeline(spec)
        except ValueError:
            continue
        handled.append(kind)
        part = run_pipeline(df.where(F.col(type_col) == kind), key, text, spec).select(key, "encoded")
        out = part if out is None else out.unionByName(part)
    rest = df.where(~F.coalesce(F.col(type_col).isin(handled), F.lit(False))).select(key, F.col(text).alias("encoded"))
    return rest if out is None else out.unionByName(rest)
