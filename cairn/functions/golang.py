"""A reader of Go sources: declarations, calls and type references from a stream of tokens.

It knows the grammar of declarations and types and, within bodies, how to tell a call, a conversion to a bracketed type, a
composite literal, a type assertion and a block apart.  It never fails: what it can't read is skipped to the next
declaration."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

#: Words of the language, predeclared functions and predeclared types.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BUILTINS = frozenset("make new len cap append copy delete close panic recover print println complex real imag min max clear".split())
TYPES = frozenset("bool byte complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr any comparable".split())

_LEX = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<name>[^\W\d]\w*)|(?P<number>\.?\d(?:[\w.]|(?<=[eEpP])[+-])*)"""
    r"""|(?P<text>`[^`]*(?:`|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?)|(?P<sign>\.\.\.|<-|:=|\+\+|--|&&|\|\||[=!<>]=|.)"""
)
_ENDS_STATEMENT = frozenset((")", "]", "}", "++", "--", "break", "continue", "fallthrough", "return"))
_DIRECTIVE = re.compile(r"[a-z0-9]+:[a-z0-9]|line |extern |export ")
_PAIR = {")": "(", "]": "[", "}": "{"}


class Token(NamedTuple):
    kind: str
    text: str
    line: int


class Declared(NamedTuple):
    name: str
    kind: str
    start: int
    end: int
    signature: str
    doc: str
    receiver: str


class Source:
    """``symbols``, ``calls`` (caller, line, callee) and ``refs`` (caller, line, callee, kind) of one file."""

    def __init__(self, text: str):
        self.symbols: list[Declared] = []
        self.calls: list[tuple[str, int, str]] = []
        self.refs: list[tuple[str, int, str, str]] = []
        self.t: list[Token] = []
        self.comments: dict[int, tuple[int, str]] = {}  # last line of a comment that stands alone -> (first line, text)
        self._lex(text.replace("\r\n", "\n"))
        self.i, self.owner = 0, "<file>"
        self._match()
        self._file()

    # -- tokens

    def _lex(self, text: str) -> None:
        line, fresh, last = 1, True, None  # fresh: nothing but white space on this line yet
        for m in _LEX.finditer(text):
            kind, s = m.lastgroup, m.group(0)
            if kind == "space":
                continue
            if kind == "comment":
                n = s.count("\n")
                if fresh:
                    self.comments[line + n] = (line, s)
                if n and self._ends(last):
                    self.t.append(last := Token("sign", ";", line))
                line += n
                continue
            if kind == "line":
                if self._ends(last):
                    self.t.append(last := Token("sign", ";", line))
                line, fresh = line + 1, True
                continue
            fresh = False
            self.t.append(last := Token("word" if s in KEYWORDS else kind, s, line))
            line += s.count("\n")
        self.t.append(Token("sign", ";", line))
        self.t.append(Token("end", "", line))

    @staticmethod
    def _ends(t: Token | None) -> bool:
        return t is not None and (t.kind in ("name", "number", "text") or t.text in _ENDS_STATEMENT)

    def _match(self) -> None:
        """The partner of every bracket; those without one are their own."""
        self.pair, open_ = list(range(len(self.t))), []
        for k, t in enumerate(self.t):
            if t.kind == "sign":
                if t.text in "([{":
                    open_.append(k)
                elif t.text in _PAIR and open_:
                    while open_ and self.t[open_[-1]].text != _PAIR[t.text]:
                        open_.pop()
                    if open_:
                        a = open_.pop()
                        self.pair[a], self.pair[k] = k, a

    def at(self, *texts: str, ahead: int = 0) -> bool:
        k = self.i + ahead
        return k < len(self.t) and self.t[k].kind not in ("text", "number", "end") and self.t[k].text in texts

    def kind(self, ahead: int = 0) -> str:
        return self.t[min(self.i + ahead, len(self.t) - 1)].kind

    def skip_to(self, *texts: str) -> None:
        """To the next of ``texts`` that is not inside brackets."""
        while self.kind() != "end" and not self.at(*texts):
            self.i = max(self.pair[self.i], self.i) + 1

    # -- declarations

    def _file(self) -> None:
        while self.kind() != "end":
            began = self.i
            if self.at("func"):
                self._function()
            elif self.at("type", "var", "const"):
                self._general(top=True)
            else:
                self.skip_to(";", "func", "type", "var", "const")
            if self.at(";"):
                self.i += 1
            self.i = max(self.i, began + 1)

    def _doc(self, line: int) -> str:
        """The text of the comment that ends on the line before."""
        parts, k = [], line - 1
        while k in self.comments:
            first, s = self.comments[k]
            parts.append(s)
            k = first - 1
        lines: list[str] = []
        for s in reversed(parts):
            if s.startswith("//"):
                body = s[2:]
                if not _DIRECTIVE.match(body):
                    lines.append(body.removeprefix(" ").rstrip())
            else:
                lines += [x.rstrip() for x in s[2:].removesuffix("*/").split("\n")]
        return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()

    def _function(self) -> None:
        start = self.t[self.i].line
        self.i += 1
        receiver, shown, refs = "", "", []
        if self.at("("):
            close = self.pair[self.i]
            groups, found = self._params()
            refs += found
            if groups:
                shown = "(" + groups[0][1] + ") "
                receiver = re.sub(r"\[.*", "", groups[0][1].lstrip("*")).rpartition(".")[2]
            self.i = close + 1
        if self.kind() != "name":
            return self.skip_to(";", "func", "type", "var", "const")
        name = self.t[self.i].text
        self.i += 1
        if self.at("["):
            self.i = self.pair[self.i] + 1
        if not self.at("("):
            return self.skip_to(";", "func", "type", "var", "const")
        params, results, found = self._signature()
        refs += found
        text = f"func {shown}{name}({_listed(params)})"
        if results:
            text += " (" + _listed(results) + ")" if len(results) > 1 or results[0][0] else " " + results[0][1]
        end = self.t[self.i - 1].line
        self.refs += [(name, ln, n, "type") for ln, n in refs]
        if self.at("{"):
            close = self.pair[self.i]
            close = close if close > self.i else len(self.t) - 2
            self._body(self.i + 1, close, name)
            end = self.t[close].line
            self.i = close + 1
        self.symbols.append(Declared(name, "method" if shown else "function", start, end, text, self._doc(start), receiver))

    def _general(self, top: bool, owner: str = "<file>") -> None:
        """A ``type``, ``var`` or ``const`` declaration, one or a group; within bodies only types of values are looked at."""
        word, first = self.t[self.i].text, self.t[self.i].line
        doc = self._doc(first) if top else ""
        self.i += 1
        if self.at("("):
            close = self.pair[self.i]
            self.i += 1
            while self.i < close:
                began = self.i
                self._spec(word, doc, top, owner)
                while self.at(";") and self.i < close:
                    self.i += 1
                self.i = max(self.i, began + 1)
            self.i = close + 1
        else:
            self._spec(word, doc, top, owner)

    def _spec(self, word: str, doc: str, top: bool, owner: str) -> None:
        if self.kind() != "name":
            return self.skip_to(";", ")")
        start = self.t[self.i].line
        if word == "type":
            name = self.t[self.i].text
            self.i += 1
            if self.at("[") and self.kind(1) == "name" and not self.at("]", ahead=2):  # type parameters
                self.i = self.pair[self.i] + 1
            if self.at("="):
                self.i += 1
            what = self.t[self.i].text
            shown, refs = self._type()
            if top:
                self.symbols.append(Declared(name, "interface" if what == "interface" else "type", start, self.t[self.i - 1].line, f"type {name} {shown}", doc, ""))
                self.refs += [(name, ln, n, k) for ln, n, k in refs]
            return self.skip_to(";", ")")
        names = []
        while self.kind() == "name":
            names.append(self.t[self.i].text)
            self.i += 1
            if not self.at(","):
                break
            self.i += 1
        shown = ""
        if not self.at("=", ";", ")"):
            s, refs = self._type()
            shown = " " + s
            self.refs += [(owner, ln, n, k) for ln, n, k in refs]
        values = self.i
        self.skip_to(";", ")")
        if top:
            self._body(values, self.i, "<file>", calls=False)
            end = self.t[max(values, self.i) - 1].line
            self.symbols += [Declared(n, word, start, end, f"{word} {n}{shown}", doc, "") for n in names if n[0].isupper()]
        else:
            self.i = values

    # -- types: what they look like, and the (line, name, kind) that they refer to

    def _type(self) -> tuple[str, list]:
        t = self.t[self.i]
        if t.kind == "name":
            self.i += 1
            line, name, shown = t.line, t.text, t.text
            builtin = name in TYPES
            if self.at(".") and self.kind(1) == "name":
                name, line, builtin = self.t[self.i + 1].text, self.t[self.i + 1].line, False
                shown += "." + name
                self.i += 2
            refs = [] if builtin else [(line, name, "type")]
            if self.at("[") and not self.at("]", ahead=1):
                close, parts = self.pair[self.i], []
                self.i += 1
                while self.i < close:
                    began = self.i
                    s, more = self._type()
                    parts.append(s)
                    refs += more
                    if self.at(","):
                        self.i += 1
                    self.i = max(self.i, began + 1)
                self.i = close + 1
                shown += "[" + ", ".join(parts) + "]"
            return shown, refs
        if t.text in ("*", "..."):
            self.i += 1
            s, refs = self._type()
            return t.text + s, refs
        if t.text == "[":
            self.i = self.pair[self.i] + 1
            s, refs = self._type()
            return "[]" + s, refs
        if t.text == "map" and self.at("[", ahead=1):
            close = self.pair[self.i + 1]
            self.i += 2
            k, refs = self._type()
            self.i = close + 1
            v, more = self._type()
            return f"map[{k}]{v}", refs + more
        if t.text in ("chan", "<-"):
            self.i += 1
            while self.at("chan", "<-"):
                self.i += 1
            s, refs = self._type()
            return "chan " + s, refs
        if t.text == "func":
            self.i += 1
            _, _, refs = self._signature()
            return "func(...)", [(ln, n, "type") for ln, n in refs]
        if t.text in ("struct", "interface") and self.at("{", ahead=1):
            self.i += 1
            return t.text + "{...}", self._members(t.text == "interface")
        if t.text == "(":
            close = self.pair[self.i]
            self.i += 1
            _, refs = self._type()
            self.i = close + 1
            return "...", refs
        return "...", []

    def _members(self, interface: bool) -> list:
        """Fields of a struct, methods and embedded types of an interface."""
        close, refs = self.pair[self.i], []
        self.i += 1
        while self.i < close:
            began = self.i
            names = 0
            if self.kind() == "name":
                if interface and self.at("(", ahead=1):
                    self.i += 1
                    refs += [(ln, n, "type") for ln, n in self._signature()[2]]
                    names = -1
                else:
                    names = self._names(close)
            if names == 0 and self.kind() != "sign" or names == 0 and self.at("*"):
                line = self.t[self.i].line
                shown, _ = self._type()
                if not self.at("|"):
                    name = re.sub(r"\[.*", "", shown.lstrip("*")).rpartition(".")[2]
                    if name.isidentifier():
                        refs.append((line, name, "embed"))
            elif names > 0:
                refs += self._type()[1]
            self.skip_to(";", "}")
            while self.at(";") and self.i < close:
                self.i += 1
            self.i = max(self.i, began + 1)
        self.i = close + 1
        return refs

    def _names(self, close: int) -> int:
        """How many names stand before a field's type; they are passed over.  0: the field is a type only."""
        k, n = self.i, 0
        while self.t[k].kind == "name":
            n += 1
            if self.t[k + 1].text == "," and self.t[k + 1].kind == "sign":
                k += 2
                continue
            nxt = self.t[k + 1]
            if n == 1 and (nxt.kind == "text" or nxt.text in (";", "}", ".", "|") and nxt.kind == "sign"):
                return 0
            if n == 1 and nxt.text == "[" and self.t[k + 2].text != "]":
                after = self.t[self.pair[k + 1] + 1]
                if after.kind == "text" or after.text in (";", "}", "|"):
                    return 0
            self.i = k + 1
            return n
        return 0

    def _signature(self) -> tuple[list, list, list]:
        """(parameters, results, references) from the opening parenthesis on."""
        if not self.at("("):
            return [], [], []
        close = self.pair[self.i]
        params, refs = self._params()
        self.i = close + 1
        results: list = []
        if self.at("("):
            close = self.pair[self.i]
            results, more = self._params()
            refs += more
            self.i = close + 1
        elif self.kind() == "name" or self.at("*", "[", "map", "chan", "<-", "func", "struct", "interface"):
            s, more = self._type()
            results = [([], s)]
            refs += [(ln, n) for ln, n, _ in more]
        return params, results, refs

    def _params(self) -> tuple[list[tuple[list[str], str]], list]:
        """The groups (names, type) between parentheses, and what the types refer to."""
        close = self.pair[self.i]
        if close <= self.i:
            return [], []
        starts, k = [], self.i + 1
        while k < close:  # the entries between commas
            starts.append(k)
            while k < close and not (self.t[k].kind == "sign" and self.t[k].text == ","):
                k = max(self.pair[k], k) + 1
            k += 1
        named = any(self._is_named(a, b) for a, b in zip(starts, [*(s - 1 for s in starts[1:]), close]))
        groups, names, refs = [], [], []
        for a, b in zip(starts, [*(s - 1 for s in starts[1:]), close]):
            while b > a and self.t[b - 1].text == ";" and self.t[b - 1].kind == "sign":
                b -= 1
            if a >= b:
                continue
            self.i = a
            if named:
                names.append(self.t[a].text)
                self.i += 1
                if self.i >= b:
                    continue  # its type comes with a later name
            s, more = self._type()
            groups.append((names, s))
            names = []
            refs += [(ln, n) for ln, n, _ in more]
        return groups, refs

    def _is_named(self, a: int, b: int) -> bool:
        if self.t[a].kind != "name" or a + 1 >= b:
            return False
        n = self.t[a + 1]
        if n.kind == "sign" and n.text == "[":
            return self.t[a + 2].text == "]" or self.pair[a + 1] + 1 < b and self.t[self.pair[a + 1] + 1].text != ";"
        return not (n.kind == "sign" and n.text in (".", ",", ";", ")"))

    # -- bodies

    def _operand(self, k: int) -> int:
        """Where the operand begins that ends with token ``k``."""
        while True:
            t = self.t[k]
            if t.kind == "sign" and t.text in ")]}" and self.pair[k] < k:
                k = self.pair[k]
                before = self.t[k - 1]
                if k and (before.kind == "name" or before.kind == "sign" and before.text in (")", "]", "}")):
                    k -= 1
                    continue
            if k > 1 and self.t[k - 1].kind == "sign" and self.t[k - 1].text == ".":
                k -= 2
                continue
            return k

    def _bracketed(self, k: int) -> bool:
        """Whether the name at ``k`` ends a type such as ``[]T`` or ``map[K]T``."""
        while k > 1 and self.t[k - 1].text == "." and self.t[k - 2].kind == "name":
            k -= 2
        while k > 0 and self.t[k - 1].text == "*" and self.t[k - 1].kind == "sign":
            k -= 1
        if k == 0 or self.t[k - 1].text != "]" or self.t[k - 1].kind != "sign":
            return False
        return self._opens_type(k - 1)

    def _opens_type(self, k: int) -> bool:
        """Whether the bracket that closes at ``k`` is that of a slice, array or map type, not of an index."""
        before = self.t[self.pair[k] - 1]
        if before.kind == "sign" and before.text == "]":
            return self._opens_type(self.pair[k] - 1)
        return before.text == "map" or not (before.kind in ("name", "text") or before.kind == "sign" and before.text in (")", "}"))

    def _type_start(self, k: int) -> int:
        """Where the type begins that ends with token ``k``."""
        if self.t[k].text == "]":
            k = self.pair[k] - 1
        while k > 1 and self.t[k - 1].text == "." and self.t[k - 2].kind == "name":
            k -= 2
        while k > 0:
            t = self.t[k - 1]
            if t.kind == "sign" and t.text == "*" and self.t[k - 2].text == "]":
                k -= 1
            elif t.kind == "sign" and t.text == "]" and self._opens_type(k - 1):
                k = self.pair[k - 1]
                k -= self.t[k - 1].text == "map"
            else:
                return k
        return k

    def _refer(self, owner: str, start: int) -> None:
        saved, self.i = self.i, start
        self.refs += [(owner, ln, n, k) for ln, n, k in self._type()[1]]
        self.i = saved

    def _body(self, start: int, end: int, owner: str, calls: bool = True) -> None:
        header = -1  # depth at which the header of a control clause began
        depth, k = 0, start
        saved = self.i
        while k < end:
            t, before = self.t[k], self.t[k - 1]
            if t.kind == "word":
                if t.text in ("if", "for", "switch", "select"):
                    header = depth
                elif t.text == "func" and self.t[k + 1].text == "(":
                    self.i = k + 1
                    self.refs += [(owner, ln, n, "type") for ln, n in self._signature()[2]]
                    k = self.i
                    if k < end and self.t[k].text == "{":  # its body belongs to the function around it
                        self._body(k + 1, self.pair[k], owner, calls)
                        k = max(self.pair[k], k) + 1
                        if calls and k < end and self.t[k].text == "(":
                            k += 1  # called on the spot: no name
                            depth += 1
                    continue
                elif t.text in ("var", "const") and calls:
                    self.i = k
                    self._general(top=False, owner=owner)
                    k = max(self.i, k + 1) if self.t[k + 1].text != "(" else k + 1
                    continue
            elif t.kind == "sign":
                if t.text == "(":
                    depth += 1
                    if before.text == "." and before.kind == "sign":
                        if self.t[k + 1].text != "type":
                            self._refer(owner, k + 1)
                    elif calls:
                        self._call(k, owner)
                elif t.text in ")]":
                    depth -= 1
                elif t.text == "[":
                    depth += 1
                elif t.text == "{":
                    literal = before.kind == "name" and (header != depth or self._bracketed(k - 1)) or before.kind == "sign" and before.text == "]" and self.t[self.pair[k - 1] - 1].kind == "name" and header != depth
                    if literal and not (before.kind == "name" and self.t[k - 2].kind == "word" and self.t[k - 2].text in ("goto", "break", "continue")):
                        self._refer(owner, self._type_start(k - 1))
                    elif header == depth:
                        header = -1
                elif t.text == ";" and header == depth and self.t[k - 1].text == "}":
                    header = -1
            k += 1
        self.i = saved

    def _call(self, k: int, owner: str) -> None:
        """The call whose arguments open at ``k``, if it is one."""
        n = k - 1
        while self.t[n].kind == "sign" and self.t[n].text == ")" and self.pair[n] < n and self.t[self.pair[n] - 1].kind != "name":
            n -= 1  # a name in parentheses
        if self.t[n].kind == "sign" and self.t[n].text == "]" and self.pair[n] < n:
            n = self.pair[n] - 1
        if n < 0 or self.t[n].kind != "name" or self._bracketed(n):
            return
        name = self.t[n].text
        selected = self.t[n - 1].text == "." and self.t[n - 1].kind == "sign"
        if name == owner or not selected and name in BUILTINS:
            return
        self.calls.append((owner, self.t[self._operand(k - 1)].line, name))


def _listed(groups: list[tuple[list[str], str]]) -> str:
    return ", ".join((", ".join(names) + " " if names else "") + shown for names, shown in groups)


def line_at(starts: list[int], offset: int) -> int:
    """The 1-based line of an offset."""
    return bisect_right(starts, offset)
