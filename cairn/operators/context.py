"""Evidence for prompts: identifiers and quoted texts in them, symbols that they name, codes for symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import bm25, graph
from cairn.operators.lineage import bounded
from cairn.operators.skew import salted_join


def prompt_identifiers(text: Column) -> Column:
    """Identifiers of a prompt - CamelCase, then snake_case, then called names - without common words, each once."""
    camel = F.regexp_extract_all(text, F.lit(f"{T.LB}([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]*)+){T.RB}"), 1)
    snake = F.regexp_extract_all(text, F.lit(f"{T.LB}([a-z][a-z0-9]+(?:_[a-z0-9]+)+){T.RB}"), 1)
    call = F.regexp_extract_all(text, F.lit(f"{T.LB}([A-Za-z_][A-Za-z0-9_]+){T.WS}*\\("), 1)
    return F.array_distinct(F.filter(F.concat(camel, snake, call), lambda w: ~F.lower(w).isin(T.COMMON_WORDS)))


def prompt_quoted(text: Column) -> Column:
    """Quoted texts of at least three bytes, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit("['\"]([^'\"]+)['\"]"), 1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(found, lambda s: F.octet_length(s) >= 3))


def name_hits(prompts: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """``(prompt_id, pos, ident, file, start_line)``: at most ``most`` symbols for each identifier, by file and line.

    Symbols of a name are cut to ``most`` before the join, so a name that many files share is no hot group."""
    ids = prompts.select("prompt_id", F.posexplode(prompt_identifiers(F.col("text"))).alias("pos", "ident"))
    few = symbols.withColumn("rn", F.row_number().over(Window.partitionBy("name").orderBy("file", "start_line"))).where(F.col("rn") <= most)
    return salted_join(ids, few.select(F.col("name").alias("ident"), "file", "start_line", "rn"), ["ident"]).select("prompt_id", "pos", "ident", "file", "start_line", "rn")


#: Sections of a report in their order: ranked symbols, symbols by name, quoted texts.
RANKED, NAMED, QUOTED = 0, 1, 2
_HIT = ["prompt_id", "section", "pos", "rn", "label", "file", "start_line", "name", "kind", "signature", "doc", "score", "line", "snippet"]


def evidence(prompts: DataFrame, symbols: DataFrame, files: DataFrame, *, most_names: int = 5, most_ranked: int = 10, most_literals: int = 10) -> DataFrame:
    """``_HIT`` rows of each prompt, the three sections of its report.  ``prompts`` (prompt_id, text) are a stated query set; the number of
    quoted texts in them bounds the search in bodies."""
    known = symbols.select("file", "start_line", "name", "kind", "signature", "doc")
    sid = F.concat_ws(":", "file", "start_line", "name")
    docs = bm25.tokenized(symbols.withColumn("sid", sid), "sid", T.symbol_tokens())
    ranked = bm25.score_queries(docs, prompts.select(F.col("prompt_id").alias("qid"), T.query_tokens("text").alias("terms")), most_ranked)
    none = {"label": F.lit(""), "score": F.lit(0.0), "line": F.lit(0), "snippet": F.lit("")}
    a = ranked.join(known.withColumn("id", sid), "id").withColumns(none | {"prompt_id": F.col("qid"), "section": F.lit(RANKED), "pos": F.lit(0), "score": F.col("score")}).select(_HIT)
    b = name_hits(prompts, symbols, most_names).join(known, ["file", "start_line"]).where("name = ident").withColumns(none | {"section": F.lit(NAMED), "label": F.col("ident")}).select(_HIT)
    # Quoted texts: the first matching line of each body, and of each text the first symbols by file and place.
    asked = prompts.select("prompt_id", F.posexplode(prompt_quoted(F.col("text"))).alias("pos", "label"))
    literals = bounded(asked.select("label").distinct())
    bodies = symbols.where("start_line > 0 and end_line >= start_line").groupBy("file").agg(F.collect_list(F.struct("start_line", "end_line", "name")).alias("bodies"))
    lines = files.select(F.col("path").alias("file"), F.coalesce("content", F.lit("")).alias("content"))
    held = lines.join(literals, F.contains("content", F.col("label"))).select("file", "label", F.split("content", "\n", -1).alias("lines")).join(bodies, "file")

    def first(s):
        hit = F.filter(F.transform(F.slice("lines", s["start_line"], s["end_line"] - s["start_line"] + 1), lambda t, i: F.struct((s["start_line"] + i).alias("line"), t.alias("t"))), lambda x: F.contains(x["t"], F.col("label")))
        return F.struct(s["start_line"].alias("start_line"), s["name"].alias("name"), F.try_element_at(hit, F.lit(1)).alias("x"))

    hits = held.select("file", "label", F.explode(F.filter(F.transform("bodies", first), lambda s: s["x"].isNotNull())).alias("s")).select("file", "label", "s.start_line", "s.name", "s.x.line", "s.x.t")
    order = Window.partitionBy("label").orderBy("file", "start_line", "name")
    few = hits.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most_literals)
    c = few.join(asked, "label").join(known, ["file", "start_line", "name"]).withColumns({"section": F.lit(QUOTED), "score": F.lit(0.0), "snippet": graph.snippet_trim(F.col("t"))}).select(_HIT)
    return a.unionByName(b).unionByName(c)


def symbol_codes(hits: DataFrame) -> DataFrame:
    """``(prompt_id, file, start_line, code)``: s1, s2, ... per prompt by first appearance; ``hits`` has section, pos and rn for the order."""
    first = hits.groupBy("prompt_id", "file", "start_line").agg(F.min(F.struct("section", "pos", "rn")).alias("o"))
    w = Window.partitionBy("prompt_id").orderBy("o", "file", "start_line")
    return first.select("prompt_id", "file", "start_line", F.concat(F.lit("s"), F.row_number().over(w).cast("string")).alias("code"))


def _one_line(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""), "\n", " "), "\r", ""), " {2,}", " ")


def cut_to(text: Column, max_bytes: int) -> Column:
    """``text``, or what of it fits into ``max_bytes`` up to the end of a line, and a note."""
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, max_bytes).cast("string")), "\n[^\n]*\\z", "")
    return F.when(F.octet_length(text) > max_bytes, F.concat(head, F.lit("\n\n_…truncated_\n"))).otherwise(text)


def report(prompts: DataFrame, hits: DataFrame, *, compact: bool = True, max_bytes: int = 8000) -> DataFrame:
    """``(prompt_id, report)``: the evidence of each prompt as Markdown, "" for a prompt without any.

    The compact form names each symbol once, in a table, and then by its code; the full form repeats signatures."""
    codes = symbol_codes(hits)
    h = hits.join(codes, ["prompt_id", "file", "start_line"])
    at = F.concat(F.lit("`"), F.col("file"), F.lit(":"), F.col("start_line").cast("string"), F.lit("`"))
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    number = F.substring("code", 2, 9).cast("int")
    ordered = lambda df, by, line: df.groupBy("prompt_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*by, line.alias("s")))), lambda x: x["s"]), "\n").alias("s"))
    one = h.groupBy("prompt_id", "code").agg(F.min(F.struct("name", "file", "start_line", "kind")).alias("x")).select("prompt_id", "code", "x.*")
    kind = F.when(F.col("kind").isin("", "function"), "").otherwise(F.concat(F.lit(" ("), "kind", F.lit(")")))
    table = ordered(one.withColumn("n", number), ["n"], F.concat(F.lit("- "), tick(F.col("code")), F.lit(" "), tick(F.col("name")), F.lit(" @ "), at, kind))
    if compact:
        top = F.concat(F.lit("- "), tick(F.col("code")), F.format_string(" (score %.2f)", F.bround("score", 2)))
        named = h.where(F.col("section") == NAMED).withColumn("n", number).groupBy("prompt_id", "pos", "label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "code"))), lambda x: tick(x["code"])), ", ").alias("c"))
        names = ordered(named, ["pos"], F.concat(F.lit("- "), tick(F.col("label")), F.lit(" → "), "c"))
        quoted = F.concat(F.lit("- "), tick(F.col("label")), F.lit(" in "), tick(F.col("code")), F.lit(" line "), F.col("line").cast("string"), F.lit(": "), tick(F.col("snippet")))
    else:
        top = F.concat(F.lit("- **"), tick(F.col("name")), F.lit("** "), at, F.lit(" — "), _one_line(F.col("doc")), F.when(F.col("signature") != "", F.concat(F.lit("\n  ```\n  "), "signature", F.lit("\n  ```"))).otherwise(""))
        named = h.where(F.col("section") == NAMED).groupBy("prompt_id", "pos", "label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", F.concat(F.lit("  - "), at, F.lit(" ("), "kind", F.lit(") "), "signature").alias("s")))), lambda x: x["s"]), "\n").alias("c"))
        names = ordered(named, ["pos"], F.concat(F.lit("- **"), tick(F.col("label")), F.lit("** →\n"), "c"))
        quoted = F.concat(F.lit("- "), tick(F.col("label")), F.lit(" in **"), tick(F.col("name")), F.lit("** `"), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("`\n  ```\n  "), "snippet", F.lit("\n  ```"))
    parts = {
        "t": (table if compact else None, "## Symbols\n\n"), "a": (ordered(h.where(F.col("section") == RANKED), ["rn"], top), "## Most relevant\n\n"),
        "b": (names, "## By name\n\n"), "c": (ordered(h.where(F.col("section") == QUOTED), ["pos", "rn"], quoted), "## Literal hits\n\n"),
    }
    out, text = prompts.select("prompt_id", F.concat(F.lit("# Context\n\n**Prompt:** "), _one_line(F.col("text")), F.lit("\n\n")).alias("head")), [F.col("head")]
    some = F.lit(False)
    for name, (part, title) in parts.items():
        if part is not None:
            out = out.join(part.withColumnRenamed("s", name), "prompt_id", "left")
            text.append(F.when(F.col(name).isNull(), "").otherwise(F.concat(F.lit(title), F.col(name), F.lit("\n\n"))))
            some = some | F.col(name).isNotNull()
    whole = out.select("prompt_id", some.alias("some"), F.concat(*text).alias("whole"))
    return whole.select("prompt_id", F.when(F.col("some"), cut_to(F.col("whole"), max_bytes)).otherwise("").alias("report"))
