"""Column functions on text: tokenizers, Markdown parts, slugs, versions.  All run inside the JVM.

Null in, null out, unless a function says otherwise; array functions give an empty array for null text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the prose tokenizer.
PROSE_STOPWORDS = """a am an and are as at be but by for from had has have he her him his if in into is it its of on or she so that
the their them then there these they this to was we were what when which who why will with would you your""".split()
#: Stop words of the ASCII tokenizer for symbols.
SYMBOL_STOPWORDS = "a an and are as at be by for from if in into is it its of on or that the this to was with you your have has had".split()
#: Common words that are no identifiers in a prompt.
COMMON_WORDS = """i im me my we us you your a an the this that these those is was be been being are were do does did have has had
can could should would will may might and or but if then else when while for of in on at by from to with without into onto as than
why how what which who whom whose where go no not yes ok any all some few many much more most new old now here there
good bad big small high low like use using used see look find think know feel want need thing way case time team
actually really just very also still about across through between during investigate explain show tell""".split()
#: White space as the reference language has it.
WS = "[\\t\\n\\f\\r ]"
#: ASCII word boundaries; Java's \b is Unicode-aware.
LB, RB = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Extension -> language tag.
LANGUAGES = {
    "go": "go", "py": "py", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "ts", "tsx": "ts", "rs": "rs", "java": "java",
    "kt": "kt", "kts": "kt", "rb": "rb", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def language_of(file: Column | str) -> Column:
    """Language tag by extension, ``""`` where unknown."""
    ext = F.lower(F.regexp_extract(_col(file), r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.element_at(table, ext), F.lit(""))


def prose_tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits of at least two bytes, without stop words; repeats stay."""
    return F.filter(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda t: (F.octet_length(t) >= 2) & ~t.isin(PROSE_STOPWORDS))


def ascii_tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits of at least two bytes, without the symbol stop words."""
    return F.filter(F.split(F.lower(F.coalesce(_col(text), F.lit(""))), "[^a-z0-9]+"), lambda t: (F.octet_length(t) >= 2) & ~t.isin(SYMBOL_STOPWORDS))


def split_identifier(name: Column) -> Column:
    """The lower-case parts of an identifier, then the whole name in lower case."""
    cut = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[0-9])(?=[^0-9_])|(?<=[^0-9_])(?=[0-9])|_+"
    parts = F.filter(F.split(name, cut), lambda p: p != "")
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.concat(F.transform(parts, F.lower), F.array(F.lower(name))))


def identifiers(text: Column | str) -> Column:
    """Parts of all identifiers of a text."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1)
    return F.flatten(F.transform(found, split_identifier))


def symbol_tokens(name: str = "name", receiver: str = "receiver", signature: str = "signature", doc: str = "doc") -> Column:
    """The token bag of a symbol: identifier parts of name, receiver and signature, prose of the documentation."""
    return F.concat(split_identifier(F.coalesce(F.col(name), F.lit(""))), split_identifier(F.coalesce(F.col(receiver), F.lit(""))), identifiers(signature), ascii_tokens(doc))


def query_tokens(query: Column | str) -> Column:
    """Identifier parts and prose tokens of a query, each once, in order."""
    return F.array_distinct(F.concat(identifiers(query), ascii_tokens(query)))


def strip_front_matter(text: Column | str) -> Column:
    """The text without its leading block between ``---`` lines; unchanged where that block is not closed."""
    return F.regexp_replace(_col(text), r"(?s)\A---\n.*?\n---\n", "")


def first_heading(text: Column | str) -> Column:
    """The first level-one heading, ``""`` if there is none."""
    return F.trim(F.regexp_extract(_col(text), "(?md)^# ([^\\n]*)$", 1))


def front_matter_field(text: Column | str, key: str) -> Column:
    """The scalar of a key of the front matter as text, ``""`` if it is absent."""
    block = F.regexp_extract(_col(text), r"(?s)\A---\n(.*?\n)---\n", 1)
    return F.trim(F.regexp_extract(block, f"(?md)^{key}:[ \\t]*([^\\n]*)$", 1))


def blank_fences(text: Column | str) -> Column:
    """Lines of fenced code, and the fences, as empty lines; the number of lines stays."""
    lines = F.split(_col(text), "\n", -1)
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))
    def step(acc, line):
        fence = line.rlike(r"^[ \t]*(```|~~~)")
        return F.struct(F.when(fence, ~acc["inside"]).otherwise(acc["inside"]).alias("inside"), F.concat(acc["out"], F.array(F.when(fence | acc["inside"], F.lit("")).otherwise(line))).alias("out"))
    return F.array_join(F.aggregate(lines, start, step, lambda acc: acc["out"]), "\n")


def blank_inline_code(text: Column | str) -> Column:
    """Inline code spans removed; they never span lines."""
    return F.regexp_replace(_col(text), "`[^`\\n]*`", "")


def head_bytes(text: Column, most: int, cut: int) -> Column:
    """``text`` if it has at most ``most`` bytes, else its first ``cut`` bytes, without a character cut in two, and an ellipsis."""
    head = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, cut).cast("string")), "\ufffd+$", "")
    return F.when(F.octet_length(text) > most, F.concat(head, F.lit("…"))).otherwise(text)


def front_matter_list(text: Column | str, key: str) -> Column:
    """The list of a key of the front matter, written ``[a, b]`` or as lines ``- a`` below the key; quotes are taken off."""
    block = F.regexp_extract(_col(text), r"(?s)\A---\n(.*?\n)---\n", 1)
    inline = F.split(F.regexp_replace(F.regexp_extract(block, f"(?md)^{key}:[ \\t]*([^\\n]*)$", 1), r"[\[\]]", ""), ",")
    below = F.split(F.regexp_replace(F.regexp_extract(block, f"(?md)^{key}:[ \\t]*\\n((?:[ \\t]*-[ \\t][^\\n]*\\n)+)", 1), r"(?m)^[ \t]*-[ \t]+", ""), "\n")
    one = lambda xs: F.filter(F.transform(xs, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")
    return F.when(F.size(one(below)) > 0, one(below)).otherwise(one(inline))


def slugify(text: Column | str, default: str = "untitled") -> Column:
    """Lower case, ``_`` and runs of other characters as ``-``, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "_", "-"), "[^a-z0-9-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit(default))


def first_words(text: Column | str, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(_col(text)), WS + "+"), 1, n), " ")


def major_of(version: Column) -> Column:
    """What stands before the first dot, without a leading ``v``."""
    return F.split_part(F.regexp_replace(version, "^v", ""), F.lit("."), F.lit(1))


def _bytes_between(raw: Column, lo: Column, hi: Column) -> Column:
    """The characters that lie wholly within the bytes after ``lo`` up to ``hi`` of binary ``raw``."""
    # A byte 10xxxxxx goes on with a character: one that began before ``lo`` or ends after ``hi`` is left out.
    text = F.make_valid_utf8(F.substring(raw, lo + 1, hi - lo).cast("string"))
    return F.regexp_replace(text, "^\ufffd+|\ufffd+$", "")


def snippet(text: Column | str, terms: Column, before: int = 60, after: int = 140, fallback: int = 200) -> Column:
    """The surroundings of the first place of any term, in bytes, without characters cut in two; else the start of the text."""
    t = _col(text)
    at = F.array_min(F.filter(F.transform(terms, lambda w: F.instr(F.lower(t), w)), lambda p: p > 0))
    raw, n = F.encode(t, "UTF-8"), F.octet_length(t)
    hit = F.octet_length(F.substring(t, F.lit(1), at - 1))
    lo, hi = F.greatest(hit - before, F.lit(0)), F.least(hit + after, n)
    line = lambda c: F.regexp_replace(F.trim(c, F.lit(" \t\r\n")), "\n", " ")
    start = line(t)
    found = F.concat(F.when(lo > 0, F.lit("…")).otherwise(F.lit("")), line(_bytes_between(raw, lo, hi)), F.when(hi < n, F.lit("…")).otherwise(F.lit("")))
    return F.when(at.isNull(), head_bytes(start, fallback, fallback)).otherwise(found)
