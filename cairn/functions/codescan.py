"""Lexical scanner for source files of ten languages.

Spark has no parser for programming languages, so this is one of the few places where Python runs per row.  It is
written for ``mapInPandas``: one compiled alternation separates comments and string literals from code (so a
declaration inside a string or a comment is never seen), declarations are found on the code that is left.

Results are defined for every input: ``None`` and ``""`` give no functions, an unknown extension gives no functions,
an unterminated comment or string reaches to the end of the file.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from dataclasses import dataclass, field

#: File extension -> language tag.
LANGUAGE_OF = {
    "go": "go", "py": "py", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "ts", "tsx": "ts", "rs": "rs",
    "java": "java", "kt": "kt", "kts": "kt", "rb": "rb", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
}

_C_LEX = r"""(?P<c>/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*)|(?P<s>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)"""
_LEX = {
    "c": re.compile(_C_LEX),
    "cpp": re.compile(_C_LEX),
    "java": re.compile(r'(?P<t>"""[\s\S]*?(?:"""|\Z))|' + _C_LEX),
    "kt": re.compile(r'(?P<t>"""[\s\S]*?(?:"""|\Z))|' + _C_LEX),
    # A quote that opens a Rust lifetime is not a string.
    "rs": re.compile(r"""(?P<c>/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*)|(?P<s>r#"[\s\S]*?(?:"#|\Z)|"(?:[^"\\]|\\[\s\S])*"?|'(?:[^'\\\n]|\\[^\n]{1,8})')"""),
    "go": re.compile(r"""(?P<c>/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*)|(?P<s>`[^`]*`?|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)"""),
    "js": re.compile(r"""(?P<c>/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*)|(?P<s>`(?:[^`\\]|\\[\s\S])*`?|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)"""),
    "py": re.compile(r"""(?P<t>(?:\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*(?:\"\"\"|\Z))|(?:'''(?:[^'\\]|\\[\s\S]|'(?!''))*(?:'''|\Z)))|(?P<c>\#[^\n]*)|(?P<s>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)"""),
    "rb": re.compile(r"""(?P<c>^=begin\b[\s\S]*?(?:^=end\b[^\n]*|\Z)|\#(?!\{)[^\n]*)|(?P<s>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)""", re.M),
}
_LEX["ts"] = _LEX["js"]

_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|synchronized|native|default|strictfp|override|open|suspend|inline|operator|infix|tailrec|external|async|readonly|declare|export|virtual|constexpr|explicit|friend|extern|get|set)\s+)*"
_ANN = r"(?:@[\w.]+(?:\([^)]*\))?\s+)*"
_DECL = {
    "go": [re.compile(r"func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\]\s*)?\(")],
    "py": [re.compile(r"[ \t]*(?:async\s+)?def\s+(?P<name>\w+)\s*[\[(]")],
    "rb": [re.compile(r"[ \t]*(?:(?:private|protected|public|module_function)\s+)?def\s+(?:self\.)?(?P<name>\w+[?!=]?)")],
    "rs": [re.compile(r"[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe)\s+)*(?:extern\s+(?:\"[^\"]*\"\s+)?)?fn\s+(?P<name>\w+)\s*[<(]")],
    "kt": [re.compile(r"[ \t]*" + _ANN + _MODS + r"fun\s+(?:<[^>]*>\s*)?(?:[\w<>?, ]+\.)?(?P<name>\w+)\s*\(")],
    "java": [re.compile(r"[ \t]*" + _ANN + _MODS + r"(?:<[^>]*>\s*)?(?!(?:return|new|else|throw|package|import|case|if|for|while|switch|catch|assert|yield)\b)[\w.]+(?:<[^;(){}]*>)?(?:\s*\[\s*\])*\s+(?P<name>\w+)\s*\((?=[^;{}]*\)\s*(?:throws\s+[\w., ]+)?\s*(?:\{|;\s*$|$))"),
             re.compile(r"[ \t]+" + _ANN + r"(?:(?:public|private|protected)\s+)(?P<name>[A-Z]\w*)\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?\s*\{")],
    "c": [re.compile(r"[ \t]*(?:(?:static|inline|extern|const|unsigned|signed|struct|enum|virtual|constexpr|explicit|friend|volatile|long)\s+)*(?!(?:return|else|throw|case|goto|new|delete|if|for|while|switch|using|typedef|namespace)\b)[\w:]+(?:<[^;(){}]*>)?[\s*&]+(?:[\w]+::)*(?P<name>~?\w+)\s*\([^;{}]*(?:\)\s*(?:const|noexcept|override|final|\s)*\{|\)\s*$|,\s*$)")],
    "js": [re.compile(r"[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*[<(]"),
           re.compile(r"[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::\s*[^={]+)?=>|\w+\s*=>)"),
           re.compile(r"[ \t]+" + _MODS + r"\*?\s*(?P<name>#?(?!(?:if|for|while|switch|catch|with|function|return|super|constructor\s*$)\b)[\w$]+)\s*(?:<[^>]*>)?\([^;{}]*\)\s*(?::\s*[^={;]+(?:\{[^}]*\}[^={;]*)?)?\{")],
}
_DECL["ts"], _DECL["cpp"] = _DECL["js"], _DECL["c"]
_CLASS = {
    "py": re.compile(r"[ \t]*class\s+(?P<name>\w+)\s*(?:\((?P<base>[^)]*)\))?"),
    "rb": re.compile(r"[ \t]*(?:class|module)\s+(?P<name>[\w:]+)\s*(?:<\s*(?P<base>[\w:]+))?"),
    "rs": re.compile(r"[ \t]*(?:unsafe\s+)?(?:pub(?:\([^)]*\))?\s+)?(?:impl(?:<[^>]*>)?\s+(?:(?P<base>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<name>\w+)|trait\s+(?P<trait>\w+))"),
    "java": re.compile(r"[ \t]*" + _ANN + _MODS + r"(?:class|interface|enum|record|object)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\([^)]*\))?\s*(?:(?:extends|implements|:)\s*(?P<base>[^{]*))?"),
    "js": re.compile(r"[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+(?P<name>\w+)(?:<[^>{]*>)?\s*(?:(?:extends|implements)\s+(?P<base>[^{]*))?"),
    "c": re.compile(r"[ \t]*(?:typedef\s+)?(?:class|struct)\s+(?P<name>\w+)\s*(?:final\s*)?(?::\s*(?P<base>[^{]*))?"),
}
_CLASS |= {"ts": _CLASS["js"], "kt": _CLASS["java"], "cpp": _CLASS["c"]}
#: Lines that may stand between a documentation comment and its declaration.
_BETWEEN = {
    "py": re.compile(r"\s*@"), "java": re.compile(r"\s*@(?!interface)"), "kt": re.compile(r"\s*@"), "js": re.compile(r"\s*@"), "ts": re.compile(r"\s*@"),
    "rs": re.compile(r"\s*#!?\["), "c": re.compile(r"\s*(?:\[\[|__attribute__)"), "cpp": re.compile(r"\s*(?:\[\[|__attribute__|template\s*<)"),
}
_NOT_A_NAME = frozenset("if for while switch catch return new else throw do try sizeof function fun fn def func".split())
_GO_PRAGMA = re.compile(r"\s*//(?:go:|export |line |nolint)")


@dataclass
class Func:
    """One function or method; lines are 1-based."""

    name: str
    kind: str
    owner: str
    bases: list[str]
    line: int
    end: int
    signature: str
    doc: str | None
    doc_kind: str
    doc_first: bool = False
    body: str = field(default="", repr=False)


def language_of(path: str | None) -> str:
    """The language tag of a path by its extension; ``""`` where it has none that is known."""
    ext = (path or "").rpartition("/")[2].rpartition(".")[2].lower()
    return LANGUAGE_OF.get(ext, "")


@functools.lru_cache(maxsize=2)
def blank(lang: str, text: str) -> tuple[str, list[tuple[int, int, str]], list[tuple[int, int]]]:
    """``text`` with comments and strings replaced by spaces (newlines stay); the comments as (start, end, kind) with
    kind ``line`` or ``block``; the multi-line strings as (start, end).  The last texts' results are kept, not to be changed."""
    comments: list[tuple[int, int, str]] = []
    long_strings: list[tuple[int, int]] = []
    out, at = [], 0
    for m in _LEX[lang].finditer(text):
        s, e = m.span()
        out.append(text[at:s])
        tok = text[s:e]
        if m.lastgroup == "c":
            comments.append((s, e, "line" if tok[0] in "/#" and not tok.startswith("/*") else "block"))
            pad = " "
        else:
            if m.lastgroup == "t":
                long_strings.append((s, e))
            pad = "_"
        first, *rest = tok.split("\n")
        out.append("\n".join([pad * len(first), *(" " * len(x) for x in rest)]))
        at = e
    out.append(text[at:])
    return "".join(out), comments, long_strings


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def _block_end(lang: str, code: list[str], i: int) -> int:
    """0-based last line of the declaration that starts on line ``i``."""
    if lang == "py":
        depth, j = 0, i
        while j < len(code):  # the header may take several lines
            depth += sum(map(code[j].count, "([{")) - sum(map(code[j].count, ")]}"))
            if depth <= 0:
                break
            j += 1
        own, last = _indent(code[i]), j
        for k in range(j + 1, len(code)):
            if code[k].strip():
                if _indent(code[k]) <= own:
                    break
                last = k
        return min(last, len(code) - 1)
    if lang == "rb":
        own = _indent(code[i])
        for k in range(i + 1, len(code)):
            if code[k].strip() == "end" and _indent(code[k]) <= own:
                return k
        return len(code) - 1
    depth, opened = 0, False
    for k in range(i, len(code)):
        for ch in re.findall(r"[{};]", code[k]):
            if ch == "{":
                depth, opened = depth + 1, True
            elif ch == "}":
                depth -= 1
            elif not opened and depth == 0:
                return k
            if opened and depth <= 0:
                return k
    return len(code) - 1 if opened else i


def _header_end(code: list[str], i: int) -> int:
    """The line after the one in which the parentheses that line ``i`` opens are balanced; ``i`` where they never are."""
    depth = 0
    for k in range(i, len(code)):
        depth += code[k].count("(") - code[k].count(")")
        if depth <= 0:
            return k + 1
    return i


def scan(path: str | None, text: str | None, lang: str | None = None) -> list[Func]:
    """Functions and methods of one file, in the order of their lines."""
    lang = lang or language_of(path)
    if not text or lang not in _DECL:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    blanked, comments, longs = blank(lang, text)
    code, raw = blanked.split("\n"), text.split("\n")
    starts = [0]
    for line in raw:
        starts.append(starts[-1] + len(line) + 1)
    line_of = lambda off: bisect_right(starts, off) - 1
    # Comments that stand alone on their lines, by the last line they cover.
    ends: dict[int, tuple[int, str, str]] = {}
    for s, e, kind in comments:
        a, b = line_of(s), line_of(max(s, e - 1))
        if not raw[a][: s - starts[a]].strip() and not raw[b][e - starts[b] :].strip():
            ends[b] = (a, kind, text[s:e])
    first_comment = line_of(comments[0][0]) if comments else -1
    longs_at = {line_of(s): (s, e) for s, e in longs}
    between, cls = _BETWEEN.get(lang), _CLASS.get(lang)
    found: list[Func] = []
    owners: list[tuple[int, str, list[str]]] = []  # (last line, name, bases)
    i = 0
    while i < len(code):
        line = code[i]
        if not line.strip():
            i += 1
            continue
        while owners and owners[-1][0] < i:
            owners.pop()
        if cls and (m := cls.match(line)):
            name = m.groupdict().get("name") or m.groupdict().get("trait") or ""
            base = [b.split("<")[0].split("(")[0].strip().split(" ")[-1] for b in re.split(r",|\bimplements\b", m.groupdict().get("base") or "")]
            owners.append((_block_end(lang, code, i), name, [b for b in base if b]))
        for rx in _DECL[lang]:
            m = rx.match(line)
            if m is None and lang not in ("py", "rb") and line.rstrip()[-1:] in "(," and i + 1 < len(code):
                m = rx.match(" ".join(code[i : max(i + 8, _header_end(code, i))]))  # a header over several lines
                if m and m.start("name") >= len(line):
                    m = None
            if m:
                break
        if not m or m["name"] in _NOT_A_NAME:
            i += 1
            continue
        end = _block_end(lang, code, i)
        owner = m.groupdict().get("owner") or (owners[-1][1] if owners else "")
        doc, doc_kind, doc_first = None, "", False
        k = i - 1
        while k >= 0 and ((between and between.match(code[k]) and code[k].strip()) or (lang == "go" and _GO_PRAGMA.match(raw[k]))):
            k -= 1
        if k in ends:
            a, doc_kind, doc = ends[k]
            if doc_kind == "line":
                parts = [doc]
                while a - 1 in ends and ends[a - 1][1] == "line":
                    a = ends[a - 1][0]
                    parts.append(ends[a][2])
                doc = "\n".join(reversed(parts))
            doc_first = a == first_comment
        if lang == "py":
            j = i
            depth = 0
            while j < len(code):
                depth += sum(map(code[j].count, "([{")) - sum(map(code[j].count, ")]}"))
                if depth <= 0:
                    break
                j += 1
            j += 1
            while j < len(raw) and not raw[j].strip():
                j += 1
            if j in longs_at and not raw[j][: longs_at[j][0] - starts[j]].strip(" \trRuUbB"):
                s, e = longs_at[j]
                doc, doc_kind, doc_first = text[s:e], "docstring", False
            elif j < len(raw) and j <= end and re.match(r"""\s*[rRuU]?("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')\s*$""", raw[j]):
                doc, doc_kind, doc_first = raw[j].strip(), "docstring", False
        bases = owners[-1][2] if owners else []
        found.append(Func(m["name"], "method" if owner else "function", owner, bases, i + 1, end + 1, raw[i].strip().rstrip("{").strip(), doc, doc_kind, doc_first, "\n".join(raw[i : end + 1])))
        i += 1
    return found


_GO_TYPE = re.compile(r"type\s+(\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)\s*\{")


def hierarchy(path: str | None, text: str | None, lang: str | None = None) -> list[tuple[str, str]]:
    """(class, base) pairs of one file: extended classes, implemented interfaces and traits, embedded Go types."""
    lang = lang or language_of(path)
    if not text or lang not in _DECL:
        return []
    code = blank(lang, text.replace("\r\n", "\n").replace("\r", "\n"))[0].split("\n")
    out: list[tuple[str, str]] = []
    for i, line in enumerate(code):
        if lang == "go":
            if m := _GO_TYPE.match(line):
                for inner in code[i + 1 : _block_end(lang, code, i)]:
                    if e := re.fullmatch(r"\s+\*?(?:\w+\.)?([A-Za-z_]\w*)\s*", inner):
                        out.append((m[1], e[1]))
        elif (cls := _CLASS.get(lang)) and (m := cls.match(line)) and m.groupdict().get("base"):
            for b in re.split(r",|\bimplements\b", m["base"]):
                b = b.split("<")[0].split("(")[0].strip()
                b = b.split(" ")[-1].rpartition(".")[2].rpartition("::")[2]
                if re.fullmatch(r"\w+", b) and b != m["name"]:
                    out.append((m["name"], b))
    return out
