"""JavaScript source to functions of the analysis: a parser by precedence over the tokens of ``functions.flow``,
lowered to SSA form on the fly.

Read are ECMAScript modules and CommonJS, classes, closures, destructuring, templates and, with their types blanked,
common TypeScript and Flow. A file with JSX or anything else that doesn't parse is a row with an error, not a clean file.

Names are canonical, js:<module>.<member>: a module's name is its path without the suffix, a relative import is resolved
against it, and a default import is a marker that ``operators.names.default_exports`` resolves. What a web framework
hands to a handler (req, request, ctx) is opaque: its members are calls by their written name, which rules can list as
sources. What a closure takes from the function around it lies in a global named after both.
"""

from __future__ import annotations

import bisect
import posixpath
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.flow import Token, blanked, tokens
from weirflow.operators.engine import FUNCTION
from weirflow.operators.lines import script_blocks
from weirflow.operators.names import DEFAULT, default_exports
from weirflow.sources.ssa import COLS, KINDS, Builder

OPAQUE = {"req", "request", "ctx", "location", "document", "process"}
#: Properties that put what is assigned to them into a page.
RAW = {"innerHTML", "outerHTML"}
_LEVELS = [["??"], ["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!=", "===", "!=="], ["<", ">", "<=", ">=", "in", "instanceof"], ["<<", ">>", ">>>"], ["+", "-"], ["*", "/", "%"], ["**"]]
_BINDING = {op: k for k, ops in enumerate(_LEVELS) for op in ops}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_PREFIX = {"!", "~", "+", "-", "++", "--", "typeof", "void", "delete", "await"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


class Unreadable(ValueError):
    pass


Node = tuple  # (kind, offset, ...)


class Parser:
    """Tokens to a tree of tuples."""

    def __init__(self, src: str, base: int = 0):
        ts = tokens(src)
        if ts is None:
            raise Unreadable("unbalanced brackets or an open string")
        self.src, self.base, self.at = src, base, 0
        self.ts = self._joined(ts)

    @staticmethod
    def _joined(ts: list[Token]) -> list[Token]:
        """Signs of several characters that the tokens have in pieces."""
        out: list[Token] = []
        for t in ts:
            last = out[-1] if out else None
            if last and last.kind == t.kind == "sign" and last.end == t.at and last.text + t.text in ("**", "<<", ">>", ">>>", "++", "--", "**=", "<<=", ">>=", ">>>=", "===", "!==", "&&=", "||=", "??=", "??"):
                out[-1] = Token("sign", last.text + t.text, last.at, last.line_before)
            else:
                out.append(t)
        return out

    # --- tokens ------------------------------------------------------------

    def text(self, k: int = 0) -> str:
        i = self.at + k
        return self.ts[i].text if i < len(self.ts) and self.ts[i].kind != "string" else ""

    def token(self) -> Token:
        if self.at >= len(self.ts):
            raise Unreadable("the file ends too early")
        return self.ts[self.at]

    def offset(self) -> int:
        return self.base + (self.ts[self.at].at if self.at < len(self.ts) else len(self.src))

    def take(self, text: str) -> bool:
        if self.text() == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise Unreadable(f"{text} is missing at {self.offset()}")

    def name(self) -> str:
        t = self.token()
        if t.kind != "word":
            raise Unreadable(f"a name is missing at {self.offset()}")
        self.at += 1
        return t.text

    def newline(self) -> bool:
        return self.at >= len(self.ts) or self.ts[self.at].line_before

    def end_of_statement(self) -> None:
        if not self.take(";") and self.text() != "}" and not self.newline():
            raise Unreadable(f"a statement doesn't end at {self.offset()}")

    # --- statements --------------------------------------------------------

    def program(self) -> list[Node]:
        out = []
        while self.at < len(self.ts):
            out.append(self.statement())
        return out

    def block(self) -> list[Node]:
        self.need("{")
        out = []
        while not self.take("}"):
            out.append(self.statement())
        return out

    def statement(self) -> Node:
        at, t = self.offset(), self.text()
        if t == "{":
            return ("block", at, self.block())
        if self.take(";"):
            return ("block", at, [])
        if t == "var" or t == "const" and self.text(1) != "enum" or t == "let" and (self.ts[self.at + 1].kind == "word" or self.text(1) in ("{", "[")):
            v = self.variables()
            self.end_of_statement()
            return v
        if t == "function" or t == "async" and self.text(1) == "function":
            f = self.function()
            return ("define", at, f[2], f)
        if t == "abstract" and self.text(1) == "class":
            self.at += 1
            t = "class"
        if t == "class":
            c = self.class_()
            return ("define", at, c[2], c)
        if t in ("interface", "enum", "declare", "namespace") and self.ts[self.at + 1].kind == "word" or t == "const" and self.text(1) == "enum":
            while self.text() not in ("{", ";"):  # types, but for the values of an enumeration
                self.at += 1
                self.token()
            if not self.take(";"):
                self.skip()
            return ("block", at, [])
        if t == "if":
            self.at += 1
            test, then = self.paren(), self.statement()
            return ("if", at, test, then, self.statement() if self.take("else") else None)
        if t == "for":
            return self.for_(at)
        if t == "while":
            self.at += 1
            test = self.paren()
            return ("while", at, test, self.statement())
        if t == "do":
            self.at += 1
            body = self.statement()
            self.need("while")
            test = self.paren()
            self.take(";")
            return ("while", at, test, body)
        if t == "switch":
            self.at += 1
            value, cases = self.paren(), []
            self.need("{")
            while not self.take("}"):
                test = None if self.take("default") else (self.need("case"), self.expression())[1]
                self.need(":")
                body = []
                while self.text() not in ("case", "default", "}"):
                    body.append(self.statement())
                cases.append((test, body))
            return ("switch", at, value, cases)
        if t == "try":
            self.at += 1
            body, param, handler, last = self.block(), None, None, []
            if self.take("catch"):
                if self.take("("):
                    param = self.pattern()
                    self.need(")")
                handler = self.block()
            if self.take("finally"):
                last = self.block()
            return ("try", at, body, param, handler, last)
        if t in ("return", "throw"):
            self.at += 1
            v = None if self.text() in (";", "}") or self.newline() else self.expression()
            self.end_of_statement()
            return (t, at, v)
        if t in ("break", "continue"):
            self.at += 1
            if not self.newline() and self.token().kind == "word":
                self.at += 1
            self.end_of_statement()
            return (t, at)
        if t == "import" and self.text(1) not in ("(", "."):
            return self.import_(at)
        if t == "export":
            return self.export(at)
        if self.token().kind == "word" and self.text(1) == ":":
            self.at += 2
            return self.statement()
        e = self.expression()
        self.end_of_statement()
        return ("do", at, e)

    def variables(self) -> Node:
        at = self.offset()
        self.at += 1
        out = []
        while True:
            p = self.pattern()
            out.append((p, self.assignment() if self.take("=") else None))
            if not self.take(","):
                return ("let", at, out)

    def for_(self, at: int) -> Node:
        self.at += 1
        self.take("await")
        self.need("(")
        first = None
        if not self.take(";"):
            if self.text() in ("const", "let", "var"):
                kind = self.offset()
                self.at += 1
                p = self.pattern()
                if self.text() in ("of", "in"):
                    self.at += 1
                    over = self.expression()
                    self.need(")")
                    return ("each", at, p, over, self.statement())
                rest = [(p, self.assignment() if self.take("=") else None)]
                while self.take(","):
                    p = self.pattern()
                    rest.append((p, self.assignment() if self.take("=") else None))
                first = ("let", kind, rest)
            else:
                first = self.expression(no_in=True)
                if self.text() in ("of", "in"):
                    self.at += 1
                    over = self.expression()
                    self.need(")")
                    return ("each", at, first, over, self.statement())
                first = ("do", at, first)
            self.need(";")
        test = None if self.text() == ";" else self.expression()
        self.need(";")
        step = None if self.text() == ")" else self.expression()
        self.need(")")
        return ("for", at, first, test, step, self.statement())

    def string(self) -> str:
        t = self.token()
        if t.kind != "string" or t.text[0] not in "'\"":
            raise Unreadable(f"a string is missing at {self.offset()}")
        self.at += 1
        return unescaped(t.text[1:-1])

    def import_(self, at: int) -> Node:
        self.at += 1
        names: list[tuple[str, str]] = []
        if self.token().kind == "string":
            source = self.string()
        else:
            if self.text() in ("type", "typeof") and self.text(1) not in (",", "from"):
                self.at += 1
            while not self.take("from"):
                if self.take("*"):
                    self.need("as")
                    names.append(("*", self.name()))
                elif self.take("{"):
                    while not self.take("}"):
                        if self.text() == "type" and self.text(1) not in (",", "}", "as"):
                            self.at += 1
                        n = self.name()
                        names.append((n, self.name() if self.take("as") else n))
                        self.take(",")
                else:
                    names.append(("default", self.name()))
                self.take(",")
            source = self.string()
        if self.text() in ("with", "assert") and self.text(1) == "{":
            self.at += 1
            self.primary()
        self.end_of_statement()
        return ("import", at, source, names)

    def export(self, at: int) -> Node:
        self.at += 1
        if self.take("default"):
            if self.text() in ("function", "class") or self.text() == "async" and self.text(1) == "function":
                f = self.class_() if self.text() == "class" else self.function()
                return ("default", at, f)
            v = self.assignment()
            self.end_of_statement()
            return ("default", at, v)
        if self.take("*"):
            if self.take("as"):
                self.name()
            self.need("from")
            self.string()
            self.end_of_statement()
            return ("block", at, [])
        if self.take("{"):
            while not self.take("}"):
                self.at += 1
            if self.take("from"):
                self.string()
            self.end_of_statement()
            return ("block", at, [])
        return self.statement()

    def skip(self) -> None:
        """Past the group in brackets that opens here."""
        depth = 0
        while True:
            t = self.token()
            if t.kind == "sign":
                depth += (t.text in "([{") - (t.text in ")]}")
            self.at += 1
            if not depth:
                return

    # --- functions and classes ---------------------------------------------

    def params(self) -> tuple[list[Node], int | None]:
        self.need("(")
        out, rest = [], None
        while not self.take(")"):
            if self.take("..."):
                rest = len(out)
            while self.text() in ("public", "private", "protected", "readonly") and self.ts[self.at + 1].kind == "word":
                self.at += 1
            out.append(self.pattern())
            self.take("?")
            if self.take("="):
                out[-1] = ("fallback", out[-1][1], out[-1], self.assignment())
            if self.text() != ")":
                self.need(",")
        return out, rest

    def function(self) -> Node:
        at = self.offset()
        self.take("async")
        self.need("function")
        self.take("*")
        name = self.name() if self.text() != "(" else None
        self.generics()
        params, rest = self.params()
        return ("function", at, name, params, rest, self.block())

    def generics(self) -> None:
        """Type parameters, which say nothing."""
        if self.text() == "<":
            depth = 0
            while True:
                t = self.token().text
                depth += (t == "<") - t.count(">") * (t in (">", ">>", ">>>"))
                self.at += 1
                if depth <= 0:
                    return

    def arrow(self, at: int, params: list[Node], rest: int | None) -> Node:
        self.need("=>")
        if self.text() == "{":
            return ("function", at, None, params, rest, self.block())
        v = self.assignment()
        return ("function", at, None, params, rest, [("return", v[1], v)])

    def class_(self) -> Node:
        at = self.offset()
        self.need("class")
        name = self.name() if self.text() not in ("{", "extends", "implements", "<") else None
        while self.text() != "{":
            if self.text() == "<":
                self.generics()
            else:
                self.at += 1
                if self.at >= len(self.ts):
                    raise Unreadable("a class without a body")
        self.need("{")
        members = []
        while not self.take("}"):
            if self.take(";"):
                continue
            start = self.offset()
            while self.text() in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "declare", "abstract", "override") and self.text(1) not in ("(", "=", ";", "}"):
                self.at += 1
            if self.text() == "{":
                self.block()
                continue
            self.take("*")
            private = self.take("#")
            key = self.key()
            if isinstance(key, str) and private:
                key = f"#{key}"
            self.take("?")
            self.generics()
            if self.text() == "(":
                params, rest = self.params()
                body = self.block() if self.text() == "{" else []
                members.append((key, ("function", start, None, params, rest, body)))
            else:
                members.append((key, self.assignment() if self.take("=") else None))
                self.end_of_statement()
        return ("class", at, name, members)

    def key(self) -> str | Node:
        t = self.token()
        if self.take("["):
            e = self.assignment()
            self.need("]")
            return e
        self.at += 1
        return unescaped(t.text[1:-1]) if t.kind == "string" else t.text

    def pattern(self) -> Node:
        at = self.offset()
        if self.take("{"):
            out = []
            while not self.take("}"):
                if self.take("..."):
                    out.append(("...", self.pattern()))
                else:
                    k, p = self.key(), None
                    p = self.pattern() if self.take(":") else ("name", at, k)
                    if self.take("="):
                        p = ("fallback", at, p, self.assignment())
                    out.append((k, p))
                if self.text() != "}":
                    self.need(",")
            return ("fields", at, out)
        if self.take("["):
            out = []
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                p = self.pattern()
                if self.take("="):
                    p = ("fallback", at, p, self.assignment())
                out.append(p)
                if self.text() != "]":
                    self.need(",")
            return ("items", at, out)
        return ("name", at, self.name())

    # --- expressions -------------------------------------------------------

    def paren(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def expression(self, no_in: bool = False) -> Node:
        e = self.assignment(no_in)
        if self.text() != ",":
            return e
        out = [e]
        while self.take(","):
            out.append(self.assignment(no_in))
        return ("comma", e[1], out)

    def assignment(self, no_in: bool = False) -> Node:
        at = self.offset()
        if self.text() == "async" and not self.ts[self.at + 1 : self.at + 2] == [] and self.text(1) != "function" and (self.text(2) == "=>" or self.text(1) == "(" and self._arrow(self.at + 1)):
            self.at += 1
        if self.at < len(self.ts) and self.ts[self.at].kind == "word" and self.text(1) == "=>":
            return self.arrow(at, [self.pattern()], None)
        if self.text() == "(" and self._arrow(self.at):
            return self.arrow(at, *self.params())
        if self.text() == "yield":
            self.at += 1
            self.take("*")
            return ("pass", at, [] if self.text() in (")", "]", "}", ",", ";", "") or self.newline() else [self.assignment(no_in)])
        left = self.binary(0, no_in)
        if self.take("?"):
            a = self.assignment()
            self.need(":")
            return ("choice", at, left, a, self.assignment(no_in))
        op = self.text()
        if op in _ASSIGN:
            self.at += 1
            return ("assign", at, left, op, self.assignment(no_in))
        return left

    def _arrow(self, k: int) -> bool:
        depth = 0
        while k < len(self.ts):
            t = self.ts[k]
            if t.kind == "sign":
                depth += (t.text in "([{") - (t.text in ")]}")
                if not depth:
                    return k + 1 < len(self.ts) and self.ts[k + 1].text == "=>"
            k += 1
        return False

    def binary(self, level: int, no_in: bool) -> Node:
        left = self.unary()
        while True:
            op = self.text()
            if op == "as" or op == "satisfies":  # a type, which says nothing
                self.at += 1
                self.type_()
                continue
            k = _BINDING.get(op, -1)
            if k < level or no_in and op == "in":
                return left
            self.at += 1
            left = ("binary", left[1], op, left, self.binary(k + (op != "**"), no_in))

    def type_(self) -> None:
        """A type after ``as``: names, generics, arrays and unions."""
        while True:
            if self.text() in ("{", "(", "["):
                self.skip()
            else:
                self.at += 1
            self.generics()
            while self.text() == "[" and self.text(1) == "]":
                self.at += 2
            if self.text() in ("|", "&", "."):
                self.at += 1
                continue
            return

    def unary(self) -> Node:
        at, t = self.offset(), self.text()
        if t in _PREFIX:
            self.at += 1
            return ("pass" if t == "await" else "unary", at, [self.unary()])
        e = self.postfix(self.primary())
        if self.text() in ("++", "--") and not self.newline():
            self.at += 1
            return ("unary", at, [e])
        return e

    def postfix(self, e: Node) -> Node:
        while True:
            at = self.offset()
            if self.take(".") or self.text() == "?." and self.text(1) not in ("(", "[") and self.take("?."):
                self.take("#")
                e = ("member", e[1], e, self.name())
            elif self.text() == "[" or self.text() == "?." and self.text(1) == "[":
                self.take("?.")
                self.need("[")
                k = self.expression()
                self.need("]")
                e = ("index", e[1], e, k)
            elif self.text() == "(" or self.text() == "?." and self.text(1) == "(":
                self.take("?.")
                e = ("call", e[1], e, self.arguments())
            elif self.at < len(self.ts) and self.ts[self.at].kind == "string" and self.ts[self.at].text[0] == "`":
                e = ("call", at, e, [self.primary()])
            elif self.text() == "!" and not self.newline() and self.text(1) in (".", ")", ",", ";", "[", "("):
                self.at += 1  # not null, says a type
            else:
                return e

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.take(")"):
            at = self.offset()
            out.append(("spread", at, self.assignment()) if self.take("...") else self.assignment())
            if self.text() != ")":
                self.need(",")
        return out

    def primary(self) -> Node:
        at, t = self.offset(), self.token()
        if t.kind == "string":
            self.at += 1
            if t.text[0] == "`":
                return self.template(at, t.text)
            return ("const", at, t.text if t.text[0] == "/" else unescaped(t.text[1:-1]), "string")
        if t.kind == "number":
            self.at += 1
            return ("const", at, t.text, "float" if re.search(r"[.eE]", t.text) and not t.text.startswith("0x") else "int")
        if t.text == "(":
            return self.paren()
        if t.text == "[":
            self.at += 1
            out = []
            while not self.take("]"):
                if self.take(","):
                    continue
                spread = self.take("...")
                v = self.assignment()
                out.append(("spread", v[1], v) if spread else v)
                if self.text() != "]":
                    self.need(",")
            return ("array", at, out)
        if t.text == "{":
            return self.object(at)
        if t.text == "function" or t.text == "async" and self.text(1) == "function":
            return self.function()
        if t.text == "class":
            return self.class_()
        if t.text == "new":
            self.at += 1
            if self.take("."):
                return ("const", at, self.name(), "")
            e = self.primary()
            while self.text() in (".", "["):
                if self.take("."):
                    e = ("member", e[1], e, self.name())
                else:
                    self.at += 1
                    e = ("index", e[1], e, self.expression())
                    self.need("]")
            if self.text() == "<":
                self.generics()
            return ("call", at, e, self.arguments() if self.text() == "(" else [])
        if t.kind == "word":
            self.at += 1
            if t.text in ("true", "false"):
                return ("const", at, t.text, "bool")
            if t.text in ("null", "undefined"):
                return ("const", at, t.text, "nil")
            return ("name", at, t.text)
        if t.text == "#":
            self.at += 1
            return ("const", at, self.name(), "")
        raise Unreadable(f"{t.text!r} can't begin an expression at {at}")

    def object(self, at: int) -> Node:
        self.need("{")
        out: list[tuple] = []
        while not self.take("}"):
            start = self.offset()
            if self.take("..."):
                out.append(("...", self.assignment()))
            else:
                while self.text() in ("async", "get", "set") and self.text(1) not in (":", ",", "(", "}"):
                    self.at += 1
                self.take("*")
                word = self.token().kind == "word"
                k = self.key()
                if self.text() == "(":
                    params, rest = self.params()
                    out.append((k, ("function", start, k if isinstance(k, str) else None, params, rest, self.block())))
                elif self.take(":"):
                    out.append((k, self.assignment()))
                elif word:
                    v: Node = ("name", start, k)
                    out.append((k, ("assign", start, v, "=", self.assignment()) if self.take("=") else v))
                else:
                    raise Unreadable(f"a value is missing at {start}")
            if self.text() != "}":
                self.need(",")
        return ("object", at, out)

    def template(self, at: int, text: str) -> Node:
        parts: list = []
        k, now = 1, ""
        while k < len(text) - 1:
            if text[k] == "\\":
                now += text[k : k + 2]
                k += 2
            elif text.startswith("${", k):
                depth, end = 1, k + 2
                while depth and end < len(text):
                    if text[end] == "`":
                        end += len(_inner_template(text[end:]))
                        continue
                    depth += (text[end] == "{") - (text[end] == "}")
                    end += 1
                parts += [unescaped(now), Parser(text[k + 2 : end - 1], at + k + 2).expression()]
                now, k = "", end
            else:
                now += text[k]
                k += 1
        return ("template", at, [*parts, unescaped(now)])


def _inner_template(text: str) -> str:
    from weirflow.functions.flow import _template

    return text[: _template(text, 0) or len(text)]


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        c = m.group(1)
        if c[0] in "xu":
            try:
                return chr(int(c.strip("xu{}"), 16))
            except (ValueError, OverflowError):
                return c
        return _ESCAPES.get(c, c)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|.)", one, text, flags=re.S)


# --- lowering ----------------------------------------------------------------


class _Function(Builder):
    def __init__(self, module: _Module, key: str, outer: _Function | None = None, cls: str | None = None):
        super().__init__(key)
        self.m, self.outer, self.cls = module, outer, cls
        self.locals: set[str] = set()
        self.inner = 0

    def emit(self, op: str, at: int, named: bool = True, **more) -> list:
        return self.add(op, self.m.place(at), named, **more)

    # --- names -------------------------------------------------------------

    def named(self, name: str, at: int) -> list:
        v = self.read(name)
        if v[0] != "undef":
            return v
        f = self.outer
        while f is not None:  # what a function around it holds
            if name in f.locals:
                held = f"{f.key}#{name}"
                f.store(held, f.read(name), at)
                self.reads.add(held)
                return self.emit("LOAD", at, operands=[["global", held]])
            f = f.outer
        if name in self.m.functions:
            return ["func", f"js:{self.m.name}.{name}"]
        if name in self.m.imports:
            return ["func", f"js:{self.m.imports[name]}"]
        if name in OPAQUE:
            return self.emit("CALL", at, callee=f"js:{name}", args=[])
        self.reads.add(f"js:{self.m.name}.{name}")
        return self.emit("LOAD", at, operands=[["global", f"js:{self.m.name}.{name}"]])

    def store(self, key: str, v: list, at: int) -> None:
        if v[0] not in ("undef", "const"):
            self.emit("STORE", at, named=False, operands=[["global", key], v])

    def dotted(self, e: Node) -> str | None:
        if e[0] == "name":
            return self.m.imports.get(e[2], e[2])
        if e[0] == "member":
            base = self.dotted(e[2])
            return base and f"{base}.{e[3]}"
        if e[0] == "call":
            if self.required(e):
                return self.m.resolved(e[3][0][2])
            base = self.dotted(e[2])
            return base and f"{base}()"
        return None

    @staticmethod
    def required(e: Node) -> bool:
        return e[0] == "call" and e[2] == ("name", e[2][1], "require") and len(e[3]) == 1 and e[3][0][0] == "const"

    def root(self, e: Node) -> str | None:
        while e[0] in ("member", "index", "call"):
            e = e[2]
        return e[2] if e[0] == "name" else None

    def field(self, e: Node) -> str | None:
        return f"js:{self.m.name}.{self.cls}.{e[3]}" if e[0] == "member" and e[2][0] == "name" and e[2][2] == "this" and self.cls else None

    # --- expressions -------------------------------------------------------

    def value(self, e: Node | None) -> list:
        if e is None:
            return ["const", "undefined", "nil"]
        kind, at = e[0], e[1]
        if kind == "const":
            return ["const", e[2], e[3]]
        if kind == "name":
            return self.named(e[2], at)
        if kind == "member":
            return self.member(e)
        if kind == "index":
            if self.root(e) in OPAQUE and self.dotted(e[2]):
                return self.emit("CALL", at, callee=f"js:{self.dotted(e[2])}", args=[])
            base = self.value(e[2])
            self.value(e[3])
            return self.emit("INDEX", at, operands=[base])
        if kind == "call":
            return self.call(e)
        if kind == "binary":
            if e[2] in ("||", "&&", "??"):
                return self.emit("PHI", at, operands=[self.value(e[3]), self.value(e[4])])
            if _BINDING[e[2]] in (6, 7):
                return self.emit("INTRINSIC", at, intrinsic="builtin.compare", operands=[self.value(e[3]), self.value(e[4])])
            return self.emit("BIN_OP", at, bin_op="ADD" if e[2] == "+" else "OTHER", operands=[self.value(e[3]), self.value(e[4])])
        if kind == "unary":
            return self.emit("UN_OP", at, operands=[self.value(v) for v in e[2]])
        if kind == "pass":
            return self.emit("CONVERT", at, operands=[self.value(v) for v in e[2]]) if e[2] else ["const", "undefined", "nil"]
        if kind == "spread":
            return self.value(e[2])
        if kind == "choice":
            self.value(e[2])
            return self.emit("PHI", at, operands=[self.value(e[3]), self.value(e[4])])
        if kind == "comma":
            return [self.value(v) for v in e[2]][-1]
        if kind == "template":
            text = "".join(p.replace("{", "{{").replace("}", "}}").replace("%", "%%") if isinstance(p, str) else "{}" for p in e[2])
            held = [self.value(p) for p in e[2] if not isinstance(p, str)]
            if not held:
                return ["const", "".join(e[2]), "string"]
            return self.emit("CALL", at, callee="builtin.format", args=[["const", text, "string"], *held])
        if kind == "array":
            return self.emit("INTRINSIC", at, intrinsic="builtin.aggregate", operands=[self.value(v) for v in e[2]])
        if kind == "object":
            ops: list[list] = []
            for k, v in e[2]:
                ops += [["const", k, "string"] if isinstance(k, str) else self.value(k), self.value(v)]
            return self.emit("INTRINSIC", at, intrinsic="builtin.aggregate_map", operands=ops)
        if kind == "function":
            return self.function(e)
        if kind == "class":
            return ["func", self.m.class_(e, self)]
        if kind == "assign":
            v = self.value(e[4])
            if e[3] != "=":
                v = self.emit("PHI" if e[3] in ("&&=", "||=", "??=") else "BIN_OP", at, bin_op="ADD" if e[3] == "+=" else "OTHER", operands=[self.value(e[2]), v])
            self.assign(e[2], v)
            return v
        raise Unreadable(f"{kind} has no value")

    def member(self, e: Node) -> list:
        at = e[1]
        if self.field(e):
            self.reads.add(self.field(e))
            return self.emit("LOAD", at, operands=[["global", self.field(e)]])
        root, name = self.root(e), self.dotted(e)
        if name and (root in OPAQUE or root in self.m.imports and self.read(root)[0] == "undef"):
            return self.emit("CALL", at, callee=f"js:{name}", args=[])
        return self.emit("FIELD", at, operands=[self.value(e[2])], field_index=zlib.crc32(e[3].encode()))

    def call(self, e: Node) -> list:
        at, f = e[1], e[2]
        if self.required(e):
            return ["func", f"js:{self.m.resolved(e[3][0][2])}"]
        if f[0] == "name":
            held = self.read(f[2])
            args = [self.value(a) for a in e[3]]
            if held[0] == "reg" and held[1] in self.params:
                self.indirect = True
                return self.emit("CALL", at, callee="", recv=held, args=args)
            if held[0] == "func":
                return self.emit("CALL", at, callee=held[1], args=args)
            full = self.m.imports.get(f[2]) or (f"{self.m.name}.{f[2]}" if f[2] in self.m.functions or f[2] in self.m.classes else f[2])
            return self.emit("CALL", at, callee=f"js:{full}", args=args)
        if f[0] == "member":
            name, root = self.dotted(f), self.root(f)
            free = root in self.m.imports and self.read(root)[0] == "undef" or self.required(f[2])
            recv = None if free or root in OPAQUE and not self.local(root) else self.value(f[2])
            args = [self.value(a) for a in e[3]]
            if recv is None:
                return self.emit("CALL", at, callee=f"js:{name}", args=args)
            own = f[2] == ("name", f[2][1], "this") and self.cls
            name = f"{self.m.name}.{self.cls}.{f[3]}" if own else name or f"?.{f[3]}"
            return self.emit("CALL", at, callee=f"js:{name}", recv=recv, args=args, method=f[3], is_invoke=True)
        held = self.value(f)
        args = [self.value(a) for a in e[3]]
        return self.emit("CALL", at, callee=held[1] if held[0] == "func" else "", recv=["undef", ""], args=args)

    def local(self, name: str) -> bool:
        return self.read(name)[0] != "undef"

    def function(self, e: Node) -> list:
        self.inner += 1
        top = self.outer is None and self.key.endswith(".<module>")
        key = f"js:{self.m.name}.{e[2]}" if top and e[2] else f"{self.key}.{e[2] or f'fn{self.inner}'}"
        self.m.lower(e, key, self, self.cls)
        return ["func", key]

    # --- assignment --------------------------------------------------------

    def assign(self, to: Node, v: list) -> None:
        kind, at = to[0], to[1]
        if kind == "name":
            if self.outer is None and self.key.endswith(".<module>"):
                self.store(f"js:{self.m.name}.{to[2]}", v, at)
            f = self.outer
            while f is not None and to[2] not in self.locals:
                if to[2] in f.locals:
                    self.store(f"{f.key}#{to[2]}", v, at)
                f = f.outer
            self.write(to[2], v)
        elif kind == "member":
            if self.field(to):
                self.store(self.field(to), v, at)
            elif to[3] in RAW:
                self.emit("CALL", at, named=False, callee=f"js:{self.dotted(to) or to[3]}", args=[v])
            else:
                addr = self.emit("FIELD_ADDR", at, operands=[self.value(to[2])], field_index=zlib.crc32(to[3].encode()))
                self.emit("STORE", at, named=False, operands=[addr, v])
        elif kind == "index":
            addr = self.emit("INDEX_ADDR", at, operands=[self.value(to[2])])
            self.emit("STORE", at, named=False, operands=[addr, v])
        else:
            self.bind(to, v, declared=False)

    def bind(self, p: Node, v: list, declared: bool = True) -> None:
        """A pattern takes a value apart."""
        kind, at = p[0], p[1]
        if kind == "name":
            if declared:
                self.locals.add(p[2])
            self.assign(p, v)
        elif kind == "fallback" or kind == "assign":
            other = self.value(p[3] if kind == "fallback" else p[4])
            self.bind(p[2], self.emit("PHI", at, operands=[v, other]), declared)
        elif kind in ("fields", "object"):
            for k, x in p[2]:
                inner = v if k == "..." else self.emit("FIELD", at, operands=[v], field_index=zlib.crc32(k.encode())) if isinstance(k, str) else self.emit("INDEX", at, operands=[v])
                self.bind(x, inner, declared)
        elif kind in ("items", "array"):
            for x in p[2]:
                self.bind(x, self.emit("INDEX", at, operands=[v]), declared)
        elif kind == "spread":
            self.bind(p[2], v, declared)
        else:
            self.assign(p, v)

    # --- statements --------------------------------------------------------

    def body(self, stmts: list[Node]) -> None:
        for s in stmts:  # functions are known in the whole block
            if s[0] == "define" and s[3][0] == "function" and s[2]:
                self.locals.add(s[2])
                key = f"js:{self.m.name}.{s[2]}" if self.outer is None and self.key.endswith(".<module>") else f"{self.key}.{s[2]}"
                self.write(s[2], ["func", key])
        for s in stmts:
            self.statement(s)

    def branch(self, parts: list[list[Node]], start: int) -> None:
        ends = []
        for p in parts:
            self.here = self.block(start)
            self.seal(self.here)
            self.body(p)
            ends.append(self.here)
        self.here = self.block(*ends)
        self.seal(self.here)

    def loop(self, at: int, test: Node | None, body: Node, step: Node | None, each: tuple | None = None) -> None:
        head = self.block(self.here)
        self.here = head
        if each:
            self.bind(each[0], self.emit("INDEX", at, operands=[self.value(each[1])]))
        elif test:
            self.emit("IF", at, named=False, operands=[self.value(test)])
        inner, after = self.block(head), self.block(head)
        self.seal(inner)
        self.here = inner
        self.loops.append((head, after))
        self.statement(body)
        self.loops.pop()
        if step:
            self.value(step)
        self.edge(self.here, head)
        self.seal(head)
        self.seal(after)
        self.here = after

    def statement(self, s: Node | None) -> None:
        if s is None:
            return
        kind, at = s[0], s[1]
        if kind == "block":
            self.body(s[2])
        elif kind == "do":
            self.value(s[2])
            self.m.exported(self, s[2])
        elif kind == "let":
            for p, v in s[2]:
                if v is not None and (self.required(v) or v[0] == "member" and self.required(v[2])) and self.m.require(p, self.dotted(v)):
                    continue
                if v is not None and v[0] == "function" and p[0] == "name":
                    v = (*v[:2], p[2], *v[3:])
                self.bind(p, self.value(v))
        elif kind == "define":
            if s[3][0] == "function":
                top = self.outer is None and self.key.endswith(".<module>")
                self.m.lower(s[3], f"js:{self.m.name}.{s[2]}" if top else f"{self.key}.{s[2]}", None if top else self, None)
            else:
                self.m.class_(s[3], self)
        elif kind == "default":
            v = s[2]
            if v[0] in ("function", "class"):
                name = v[2] or "default"
                v = (*v[:2], name, *v[3:])
                self.m.default = f"js:{self.m.name}.{name}"
                if v[0] == "function":
                    self.m.lower(v, self.m.default, None, None)
                else:
                    self.m.class_(v, self)
            else:
                held = self.value(v)
                self.m.default = held[1] if held[0] == "func" else None
        elif kind == "import":
            self.m.take_import(s)
        elif kind == "if":
            self.emit("IF", at, named=False, operands=[self.value(s[2])])
            self.branch([[s[3]], [s[4]] if s[4] else []], self.here)
        elif kind == "while":
            self.loop(at, s[2], s[3], None)
        elif kind == "for":
            self.statement(s[2])
            self.loop(at, s[3], s[5], s[4])
        elif kind == "each":
            self.loop(at, None, s[4], None, (s[2], s[3]))
        elif kind == "switch":
            self.value(s[2])
            after = self.block(self.here)
            self.loops.append((self.here, after))
            start = self.here
            for test, body in s[3]:
                if test:
                    self.value(test)
                self.here = self.block(start, *([self.here] if self.here != start else []))
                self.seal(self.here)
                self.body(body)
            self.loops.pop()
            self.edge(self.here, after)
            self.seal(after)
            self.here = after
        elif kind == "try":
            start = self.here
            handler = [("let", at, [(s[3], None)])] if s[3] else []
            self.branch([s[2], [*handler, *(s[4] or [])]], start)
            self.body(s[5])
        elif kind == "return":
            self.emit("RET", at, named=False, operands=[self.value(s[2])] if s[2] else [])
            self.here = self.block()
            self.seal(self.here)
        elif kind == "throw":
            self.value(s[2])
            self.here = self.block()
            self.seal(self.here)
        elif kind in ("break", "continue") and self.loops:
            head, after = self.loops[-1]
            self.edge(self.here, after if kind == "break" else head)
            self.here = self.block()
            self.seal(self.here)


class _Module:
    def __init__(self, path: str, text: str):
        self.path = path
        self.name = re.sub(r"\.(?:d\.)?(?:js|jsx|mjs|cjs|ts|tsx|vue|svelte)$", "", path)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.imports: dict[str, str] = {}
        self.default: str | None = None
        self.rows: list[tuple] = []
        marked = text if re.search(r"\.(?:ts|tsx|mts|cts)$", path) is None else f"{text}\n// @flow"
        tree = Parser(blanked(marked)).program()
        self.functions = {s[2] for s in tree if s[0] == "define" and s[3][0] == "function"}
        self.functions |= {p[2] for s in tree if s[0] == "let" for p, v in s[2] if p[0] == "name" and v and v[0] == "function"}
        self.classes = {s[2] for s in tree if s[0] == "define" and s[3][0] == "class"}
        top = _Function(self, f"js:{self.name}.<module>")
        for s in tree:
            if s[0] == "import":
                self.take_import(s)
        top.body(tree)
        self.done(top, "", {})

    def place(self, at: int) -> str:
        line = bisect.bisect_right(self.starts, at)
        return f"{self.path}:{line}:{at - self.starts[line - 1] + 1}"

    def resolved(self, source: str) -> str:
        """A module's name as callees have it."""
        if not source.startswith("."):
            return source.removeprefix("node:")
        at = posixpath.normpath(posixpath.join(posixpath.dirname(self.path), source))
        return re.sub(r"\.(?:js|jsx|mjs|cjs|ts|tsx)$", "", at)

    def take_import(self, s: Node) -> None:
        source = self.resolved(s[2])
        for name, own in s[3]:
            self.imports[own] = f"{source}.{name}" if name not in ("*", "default") else source if name == "*" or not s[2].startswith(".") else f"{DEFAULT}{source}"

    def require(self, p: Node, source: str) -> bool:
        """const x = require('m') and const {a, b: c} = require('m') are imports."""
        if p[0] == "name":
            self.imports[p[2]] = source
            return True
        if p[0] == "fields" and all(isinstance(k, str) and x[0] == "name" for k, x in p[2]):
            self.imports |= {x[2]: f"{source}.{k}" if k != "..." else source for k, x in p[2]}
            return True
        return False

    def exported(self, f: _Function, e: Node) -> None:
        """module.exports = f names the default export; exports.name = function has that name."""
        if e[0] == "assign" and e[2][0] == "member":
            to = f.dotted(e[2])
            held = e[4]
            if to == "module.exports" and held[0] == "name" and held[2] in self.functions:
                self.default = f"js:{self.name}.{held[2]}"
            elif to and re.fullmatch(r"(?:module\.)?exports\.\w+", to) and held[0] == "function":
                self.lower(held, f"js:{self.name}.{e[2][3]}", f, None)

    def lower(self, e: Node, key: str, outer: _Function | None, cls: str | None, method: str = "") -> None:
        _, at, _, params, rest, body = e
        f = _Function(self, key, outer, cls)
        f.rest = rest
        shift = 1 if method else 0  # the receiver comes first
        f.params = [f"p{k}" for k in range(len(params) + shift)]
        if method:
            f.write("this", ["reg", "p0"], 0)
        for p, reg in zip(params, f.params[shift:]):
            f.bind(p, ["reg", reg])
            inner = p[2] if p[0] == "fallback" else p
            if inner[0] == "name" and inner[2] in OPAQUE:  # opaque: read by its members' names
                f.locals.discard(inner[2])
                f.defs[f.here].pop(inner[2], None)
        if rest is not None:
            f.rest = rest + shift
        f.body(body)
        self.done(f, method, {})

    def class_(self, e: Node, outer: _Function) -> str:
        _, at, name, members = e
        name = name or f"class{at}"
        for k, v in members:
            if v is not None and v[0] == "function":
                k = k if isinstance(k, str) else f"computed{v[1]}"
                self.lower(v, f"js:{self.name}.{name}.{k}", None if outer.key.endswith(".<module>") else outer, name, k)
            elif v is not None and isinstance(k, str):
                held = outer.value(v)
                outer.store(f"js:{self.name}.{name}.{k}", held, e[1])
        return f"js:{self.name}.{name}"

    def done(self, f: _Function, method: str, seeds: dict[str, str]) -> None:
        self.rows.append(f.row("javascript", method, seeds))


def with_default_exports(functions: DataFrame, lowered: DataFrame) -> DataFrame:
    """functions whose calls of a default import are calls of the one function that its module exports so."""
    suffix = r"\.(?:js|jsx|mjs|cjs|ts|tsx|vue|svelte)$"
    exports = lowered.where("default_export IS NOT NULL").select(F.regexp_replace("path", suffix, "").alias("module"), F.col("default_export").alias("target"))
    mark = f"js:{DEFAULT}"
    has = F.exists("calls", lambda c: c["callee"].startswith(mark))
    some = functions.where(has)
    calls = some.select("fn", F.posexplode("calls").alias("pos", "c")).select("fn", "pos", "c.*").withColumn("callee", F.when(F.col("callee").startswith(mark), F.substring("callee", 4, 1 << 20)).otherwise(F.col("callee")))
    held = F.sort_array(F.collect_list(F.struct("pos", "id", "callee", "method_name", "untyped")))
    done = default_exports(calls, exports).groupBy("fn").agg(F.transform(held, lambda c: F.struct(c["id"].alias("id"), c["callee"].alias("callee"), c["method_name"].alias("method_name"), c["untyped"].alias("untyped"))).alias("calls"))
    return functions.where(~has).unionByName(some.drop("calls").join(done, "fn").select(*functions.columns))


def lower(files: DataFrame) -> DataFrame:
    """(path, error, functions..., default_export) of JavaScript files (path, text): a row for each function, or one with
    the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist()):
                try:
                    m = _Module(path, script_blocks(text or "") if path.endswith((".vue", ".svelte")) else text or "")
                    out += [(*r, path, None, m.default) for r in m.rows]
                except (Unreadable, RecursionError, IndexError) as e:
                    out.append((None,) * 8 + (path, f"{type(e).__name__}: {e}", None))
            yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate([*KINDS, pa.string()])], [*COLS, "path", "error", "default_export"])

    return files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(run, FUNCTION + ", path string, error string, default_export string")
