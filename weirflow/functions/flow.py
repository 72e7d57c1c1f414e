"""Typed JavaScript (Flow) as plain text of the same length: types are blanked in place, so every place stays.

Only what a TypeScript parser doesn't take is looked for: annotations of parameters, results, variables and class
properties, casts, bounded generics, aliases, declarations and %checks. A file without a mark of Flow, or one that
doesn't read as balanced text, comes back as it is; where a colon may be a value's, it stays.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"(?P<space>[ \t\r\f\v ]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<word>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<number>\.?\d[\w.]*)"
    r"|(?P<string>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")|(?P<sign>=>|\?\?=?|\?\.(?!\d)|\.\.\.|%checks\b|[-+*/%&|^!=<>]=+|&&|\|\||.)",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_MARKS = ("@flow", "opaque type ", ": ?", ":?", "{[string]:", "{[number]:")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_VALUE_BEFORE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}


@dataclass
class Token:
    kind: str
    text: str
    at: int
    line_before: bool
    other: int = -1  # the bracket that this one opens or closes

    @property
    def end(self) -> int:
        return self.at + len(self.text)


def tokens(src: str) -> list[Token] | None:
    """Words, numbers, strings, regular expressions, templates and signs with their brackets, or None."""
    out: list[Token] = []
    at, line = 0, True
    while at < len(src):
        if src[at] == "`":
            end = _template(src, at)
            if end is None:
                return None
            out.append(Token("string", src[at:end], at, line))
            at, line = end, False
            continue
        if src[at] == "/" and src[at : at + 2] not in ("//", "/*"):
            last = out[-1] if out else None
            value = last is not None and (last.kind in ("number", "string") or last.kind == "word" and last.text not in _VALUE_BEFORE or last.text in (")", "]", "}"))
            m = None if value else _REGEX.match(src, at)
            if m:
                out.append(Token("string", m.group(), at, line))
                at, line = m.end(), False
                continue
        m = _TOKEN.match(src, at)
        kind = m.lastgroup
        if kind == "sign" and m.group() in ("'", '"'):
            return None
        if kind == "line" or kind == "comment" and "\n" in m.group():
            line = True
        elif kind not in ("space", "comment"):
            out.append(Token(kind, m.group(), at, line))
            line = False
        at = m.end()
    open_: list[int] = []
    for k, t in enumerate(out):
        if t.kind == "sign" and t.text in _CLOSE:
            open_.append(k)
        elif t.kind == "sign" and t.text in (")", "]", "}"):
            if not open_ or _CLOSE[out[open_[-1]].text] != t.text:
                return None
            t.other = open_.pop()
            out[t.other].other = k
    return None if open_ else out


def _template(src: str, at: int) -> int | None:
    """The end of a template; code inside it is skipped over."""
    at += 1
    while at < len(src):
        if src[at] == "\\":
            at += 2
        elif src[at] == "`":
            return at + 1
        elif src.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(src) and depth:
                if src[at] == "`":
                    inner = _template(src, at)
                    if inner is None:
                        return None
                    at = inner
                    continue
                depth += (src[at] == "{") - (src[at] == "}")
                at += 1
        else:
            at += 1
    return None


class _Blanker:
    def __init__(self, src: str, ts: list[Token]):
        self.src, self.ts, self.out = src, ts, list(src)

    def text(self, k: int) -> str:
        return self.ts[k].text if 0 <= k < len(self.ts) else ""

    def word(self, k: int) -> bool:
        return 0 <= k < len(self.ts) and self.ts[k].kind == "word"

    def blank(self, first: int, last: int) -> None:
        """Tokens first to last, and what lies between them."""
        for i in range(self.ts[first].at, self.ts[last].end):
            if self.out[i] not in "\r\n":
                self.out[i] = " "

    def type_end(self, k: int, stop: set[str], lines: bool = False) -> int:
        """The last token of the type that begins at k: it ends before a sign of ``stop``, or, with ``lines``, where a
        line does and neither side goes on."""
        first, angle = k, 0
        while k < len(self.ts):
            t = self.ts[k]
            if k > first and not angle:
                if lines and t.line_before and self.text(k - 1) not in ("|", "&", "=>", ":", "=", "?", ",", "<") and t.text not in ("|", "&", "=>", "}", ")", "="):
                    break
                if t.text in stop and not (t.text == "{" and self.text(k - 1) in (":", "|", "&", "?", "=>", "<", ",")):
                    break
            if t.text in (")", "]", "}") and t.other < first:
                break
            angle += (t.text == "<") - (t.text == ">" and angle > 0)
            k = t.other + 1 if t.text in _CLOSE else k + 1
        return k - 1

    def annotation(self, colon: int, stop: set[str], lines: bool = False) -> int:
        end = self.type_end(colon + 1, stop, lines)
        if end > colon:
            self.blank(colon, end)
        return max(end, colon) + 1

    # --- places ------------------------------------------------------------

    def generics(self, k: int) -> int:
        """The token after a group of type parameters that begins at k, which goes where it has a bound."""
        depth, at, bound = 0, k, False
        while at < len(self.ts):
            t = self.ts[at]
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
                if not depth:
                    break
            elif t.text == ":":
                bound = True
            elif t.text in (";", ")", "]", "}") or t.text == "(" and depth == 0:
                return k
            at = t.other + 1 if t.text in _CLOSE else at + 1
        if at >= len(self.ts):
            return k
        if bound:
            self.blank(k, at)
        return at + 1

    def parameters(self, k: int) -> None:
        """Annotations directly in the parameter list that opens at k."""
        at, end, fresh = k + 1, self.ts[k].other, True
        while at < end:
            t = self.ts[at]
            if t.text == ":" and fresh:
                at = self.annotation(at, {",", "="})
                continue
            fresh = t.text == "," or fresh and (t.kind == "word" or t.text in ("...", "?", "{", "["))
            if t.text in _CLOSE:
                self.code(at + 1, t.other, "object" if t.text == "{" else "other")
                at = t.other + 1
            else:
                at += 1

    def function(self, k: int) -> int:
        """From the opening bracket of a parameter list on: the list and the type of the result; the token after both."""
        self.parameters(k)
        at = self.ts[k].other + 1
        if self.text(at) == ":":
            at = self.annotation(at, {"{", "=>", "%checks", ";"})
        if self.text(at) == "%checks":
            self.blank(at, at)
            at += 1
        return at

    def arrow(self, k: int) -> bool:
        """Whether the bracket at k opens the parameters of an arrow function."""
        at = self.ts[k].other + 1
        if self.text(at) == "=>":
            return True
        if self.text(at) != ":":
            return False
        end = self.type_end(at + 1, {"=>", ";", ",", "{"})
        return self.text(end + 1) == "=>"

    def declaration(self, k: int) -> int | None:
        """The last token of a declaration of types that begins at k."""
        at = k + (self.text(k) == "export")
        if self.text(at) == "declare" and self.word(at + 1) and not self.ts[at + 1].line_before:
            at += 1 + (self.text(at + 1) == "export")
            if self.text(at) in ("type", "opaque"):
                return self.alias(at)
            end = self.type_end(at, {";"}, True)
            return end + (self.text(end + 1) == ";")
        return self.alias(at)

    def alias(self, at: int) -> int | None:
        at += self.text(at) == "opaque" and self.text(at + 1) == "type"
        if self.text(at) != "type" or not self.word(at + 1) or self.ts[at + 1].line_before or self.text(at + 2) not in ("=", "<", ":", ";"):
            return None
        if self.text(at + 2) in (":", ";") and self.text(at - 1) != "opaque":
            return None
        end = self.type_end(at + 2, {";"}, True)
        return end + (self.text(end + 1) == ";")

    def code(self, k: int, end: int, frame: str) -> None:
        """Tokens k to end in a frame: block, class, object or other."""
        start, asked = True, 0  # at the start of a statement or member; question marks that wait for their colon
        variable = False
        while k < end:
            t, before = self.ts[k], self.text(k - 1)
            if not start and frame in ("block", "class") and t.line_before and k and self.word(k) and (self.ts[k - 1].kind != "sign" or before in (")", "]", "}", ";")):
                start, asked = True, 0  # a line that can't go on ends the statement
            if start and frame == "block" and (t.kind == "word"):
                last = self.declaration(k)
                if last is not None and last < end:
                    self.blank(k, last)
                    k = last + 1
                    continue
            if start and frame == "class" and (t.kind == "word" or t.text == "#"):
                at = k
                while self.word(at + 1) and self.text(at) in ("static", "async", "get", "set", "declare", "readonly", "private", "protected", "public", "abstract", "override") or self.text(at) == "#":
                    at += 1
                at += 1
                if self.text(at) == "?":
                    at += 1
                if self.text(at) == "<":
                    at = self.generics(at)
                if self.text(at) == ":":
                    k, start = self.annotation(at, {"=", ";"}, True), False
                    continue
                if self.text(at) == "(":
                    k, start = self.function(at), False
                    continue
                k, start = max(at, k + 1), False
                continue
            start = False
            if t.kind == "word" and before != ".":
                if t.text in ("function", "class"):
                    at = k + 1
                    at += self.text(at) == "*"
                    at += self.word(at) and self.text(at) not in ("extends", "implements")
                    if self.text(at) == "<":
                        at = self.generics(at)
                    if t.text == "function" and self.text(at) == "(":
                        k = self.function(at)
                        if self.text(k) == "{":
                            self.code(k + 1, self.ts[k].other, "block")
                            k = self.ts[k].other + 1
                            start = frame == "block"
                        continue
                    if t.text == "class":
                        while at < end and self.text(at) not in ("{", ";"):
                            at = self.ts[at].other + 1 if self.text(at) in ("(", "[") else at + 1
                        if at < end and self.text(at) == "{":
                            self.code(at + 1, self.ts[at].other, "class")
                            k = self.ts[at].other + 1
                            start = frame == "block"
                            continue
                if t.text in ("const", "let", "var"):
                    variable = True
                    k += 1
                    continue
                if t.text in ("case", "default") and frame == "block":
                    while k < end and self.text(k) != ":":
                        k = self.ts[k].other + 1 if self.text(k) in _CLOSE else k + 1
                    k, start = k + 1, True
                    continue
            if t.text == "?":
                asked += 1
            elif t.text == ":":
                if asked:
                    asked -= 1
                elif variable and (self.word(k - 1) or before in ("}", "]")):
                    k, variable = self.annotation(k, {"=", ";", ",", "of", "in"}, True), False
                    continue
                elif frame == "paren":
                    k = self.annotation(k, set())
                    continue
            elif t.text in ("=", "=>"):
                variable = False
            elif t.text == "," and frame in ("block", "other"):
                variable = variable or self._declares(k)
            elif t.text == ";":
                asked, variable, start = 0, False, True
            if t.text in _CLOSE:
                inner = t.other
                if t.text == "(":
                    method = frame == "object" and self.word(k - 1) and self.text(inner + 1) in ("{", ":") and not asked
                    if method or not asked and self.arrow(k) or asked and self.text(inner + 1) == "=>":
                        k = self.function(k)
                        continue
                    call = self.word(k - 1) and before not in _VALUE_BEFORE | {"if", "while", "for", "switch", "catch", "with"} or before in (")", "]")
                    self.code(k + 1, inner, "other" if call or before in ("if", "while", "for", "switch", "catch", "with") else "paren")
                    start = before in ("if", "while", "for", "with") and frame == "block"
                elif t.text == "{":
                    block = before in (")", "=>", "{", "}", ";", "else", "do", "try", "finally", ":", "") and (frame in ("block", "class") or before in (")", "=>")) or frame == "block" and k and before in ("else", "do", "try", "finally")
                    object_ = before in ("=>",) and self.text(k - 1) == "(" or not block
                    self.code(k + 1, inner, "object" if object_ else "block")
                    start = frame in ("block", "class") and not object_
                else:
                    self.code(k + 1, inner, "other")
                k = inner + 1
                continue
            k += 1

    def _declares(self, comma: int) -> bool:
        """Whether the statement that a comma stands in begins with const, let or var."""
        k = comma - 1
        while k >= 0 and self.text(k) not in (";", "{", "("):
            if self.text(k) in (")", "]", "}"):
                k = self.ts[k].other - 1
                continue
            if self.text(k) in ("const", "let", "var"):
                return True
            k -= 1
        return False


def blanked(src: str) -> str:
    """The text with the types of Flow as blanks, every line and column where it was."""
    if not any(m in src for m in _MARKS):
        return src
    ts = tokens(src)
    if ts is None:
        return src
    b = _Blanker(src, ts)
    b.code(0, len(ts), "block")
    return "".join(b.out)
