"""Rust from the text of its mid-level IR (``rustc --emit=mir``): functions of the engine.

A dump holds functions; a function declares its parameters, has blocks with
statements and ends each with a terminator; a comment says where a statement comes
from. Locals are registers; a place inside a local (field, index, what it points to)
is read from the local and stored to it. A call's name loses its type arguments.
A function that doesn't parse is left out, a text without functions is an error row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.scalars import rust_format
from weirflow.operators.engine import FUNCTION
from weirflow.sources.ssa import COLS, KINDS

_HEADER = re.compile(r"fn (.+?)\((.*)\) -> .*\{\s*$|fn (.+?)\((.*)\)\s*\{\s*$")
_BLOCK = re.compile(r"\s*bb(\d+)(?: \(cleanup\))?: \{")
_SPAN = re.compile(r"at ([^ ]+\.rs):(\d+):(\d+)")
_BINARY = {"Add", "Sub", "Mul", "Div", "Rem", "BitXor", "BitAnd", "BitOr", "Shl", "Shr", "Eq", "Lt", "Le", "Ne", "Ge", "Gt", "Cmp", "Offset", "AddWithOverflow", "SubWithOverflow", "MulWithOverflow", "AddUnchecked", "SubUnchecked", "MulUnchecked"}
_UNARY = {"Neg", "Not", "PtrMetadata"}


def plain(path: str) -> str:
    """A path without its groups in angle brackets."""
    out, depth = [], 0
    for c in path.replace("->", "  "):
        if c == "<":
            depth += 1
        elif c == ">":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(c)
    return re.sub(":{2,}", "::", "".join(out).strip()).strip(":")


def _parts(text: str) -> list[str]:
    """The pieces between commas that lie in no bracket and no string."""
    out, depth, quoted, now = [], 0, False, ""
    for k, c in enumerate(text):
        if c == '"' and (k == 0 or text[k - 1] != "\\"):
            quoted = not quoted
        elif not quoted:
            depth += (c in "([{<") - (c in ")]}" or c == ">" and text[k - 1 : k] not in ("-", "="))
        if c == "," and depth == 0 and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [p.strip() for p in [*out, now] if p.strip()]


def _code(line: str) -> tuple[str, str]:
    """(statement, comment); // in a string is no comment."""
    quoted = False
    for k, c in enumerate(line):
        if c == '"' and (k == 0 or line[k - 1] != "\\"):
            quoted = not quoted
        elif not quoted and line.startswith("//", k):
            return line[:k].strip(), line[k + 2 :]
    return line.strip(), ""


def bodies(text: str) -> Iterator[list[str]]:
    """The lines of each function."""
    lines, at = text.split("\n"), 0
    while at < len(lines):
        if not lines[at].startswith("fn "):
            at += 1
            continue
        depth, body = 0, []
        while at < len(lines):
            code = _code(lines[at])[0]
            depth += code.count("{") - code.count("}")
            body.append(lines[at])
            at += 1
            if depth <= 0 and len(body) > 1:
                break
        yield body


class _Mir:
    def __init__(self, path: str, body: list[str]):
        m = _HEADER.match(_code(body[0])[0] + " " if body[0].endswith("{") else body[0])
        if m is None:
            raise ValueError(f"no function: {body[0]}")
        name, params = (m.group(1), m.group(2)) if m.group(1) else (m.group(3), m.group(4))
        self.path, self.key, self.n, self.last = path, f"rust:{plain(name)}", 0, (path, 0, 0)
        self.blocks: list[dict] = []
        self.calls: list[dict] = []
        self.params, seeds = [], {}
        for p in _parts(params):
            local, _, kind = p.partition(":")
            self.params.append(local.strip())
            if re.search(r"\b(?:Query|Path|Json|Form|RawQuery|RawForm|Multipart|HeaderMap|Bytes)\b", kind):
                seeds[local.strip()] = "rust:@http.param"
        by: dict[int, dict] = {}
        for line in body[1:]:
            code, comment = _code(line)
            at = _BLOCK.match(line)
            if at:
                self.block = by.setdefault(int(at.group(1)), {"index": int(at.group(1)), "preds": [], "succs": [], "instrs": []})
                self.blocks.append(self.block)
            elif self.blocks and code and code not in ("{", "}"):
                span = _SPAN.search(comment)
                if span and not span.group(1).startswith("/"):
                    self.last = (span.group(1), int(span.group(2)), int(span.group(3)))
                self.statement(code.rstrip(";"))
        for b in self.blocks:
            b["succs"] = [s for s in dict.fromkeys(b["succs"]) if s in by]
            for s in b["succs"]:
                by[s]["preds"].append(b["index"])
        self.row = (self.key, "", "rust", True, json.dumps({"params": self.params, "blocks": self.blocks, "seeds": seeds}), self.calls, [], False)

    def emit(self, op: str, name: str | None = None, **more) -> dict:
        self.n += 1
        file, line, col = self.last
        i = {"op": op, "id": f"{file}:{line}:{col}:{self.n}", **({"name": name} if name else {}), **more}
        self.block["instrs"].append(i)
        return i

    def value(self, text: str) -> list:
        text = re.sub(r"^(?:move|copy|&raw const|&raw mut|&mut|&) ?", "", text.strip())
        if text.startswith("const "):
            lit = text[6:].strip()
            if lit.startswith('b"'):
                return ["const", rust_format(lit) or lit, "string"]
            if lit.startswith('"'):
                return ["const", lit[1 : lit.rfind('"')].encode().decode("unicode_escape", "replace"), "string"]
            kind = "int" if re.match(r"-?\d", lit) else "bool" if lit in ("true", "false") else ""
            return ["const", re.sub(r"_[iuf]\w+$", "", lit), kind]
        field = re.match(r"^\(?\(?\*?_(\d+)(?: as \w+\))?\.(\d+):", text)
        if field:
            self.n += 1
            return self.into(f"f{self.n}", "FIELD", [["reg", f"_{field.group(1)}"]], field_index=int(field.group(2)))
        local = re.search(r"_\d+", text)
        return ["reg", local.group()] if local else ["undef", ""]

    def into(self, name: str, op: str, operands: list, **more) -> list:
        self.emit(op, name, operands=operands, **more)
        return ["reg", name]

    def statement(self, code: str) -> None:
        if code.startswith(("StorageLive", "StorageDead", "scope", "debug", "let ", "nop", "FakeRead", "Retag", "Coverage", "PlaceMention", "AscribeUserType")):
            return
        if code.startswith("goto"):
            return self.jump(code)
        if code.startswith("switchInt("):
            self.emit("IF", operands=[self.value(code[len("switchInt(") : code.find(") ->")])])
            return self.jump(code)
        if code == "return":
            self.emit("RET", operands=[["reg", "_0"]])
            return
        if re.match(r"(?:drop|assert|falseEdge|falseUnwind)\b", code):
            return self.jump(code)
        to, eq, right = code.partition(" = ")
        if not eq:
            return
        tail = re.search(r"\) -> (?:\[.*\]|bb\d+|unwind.*)$", right)
        if tail:
            self.call(to, right[: tail.start() + 1])
            return self.jump(right[tail.start() :])
        self.assign(to, *self.rvalue(right))

    def jump(self, code: str) -> None:
        """Blocks that normal control flow goes on to: neither those of unwinding nor of cleaning up."""
        self.block["succs"] += [int(b) for b in re.findall(r"bb(\d+)", re.sub(r"(?:unwind|cleanup)(?::| )\s*\w+", "", code))]

    def rvalue(self, text: str) -> tuple[str, list, dict]:
        text = text.strip()
        m = re.match(r"(\w+)\((.*)\)$", text)
        if m and m.group(1) in _BINARY | _UNARY:
            kind = "ADD" if m.group(1).startswith("Add") else "OTHER"
            return "BIN_OP" if m.group(1) in _BINARY else "UN_OP", [self.value(p) for p in _parts(m.group(2))], {"bin_op": kind}
        cast = re.match(r"(.*) as .+ \(.+\)$", text)
        if cast:
            return "CONVERT", [self.value(cast.group(1))], {}
        group = re.match(r"(?:[\w:<>, &']*[\w>])?\s*[\[({](.*)[\])}]$", text)
        if group and not re.match(r"^\(?\(?\*?_\d+(?: as \w+\))?[.)]", text) and not text.startswith(("move", "copy", "const", "&")):
            parts = [p.split(": ", 1)[-1] if "{" in text else p for p in _parts(group.group(1))]
            return "INTRINSIC", [self.value(p) for p in parts], {"intrinsic": "builtin.aggregate"}
        return "CONVERT", [self.value(text)], {}

    def assign(self, to: str, op: str, operands: list, more: dict) -> None:
        operands = [o for o in operands if o[0] != "undef"]
        if re.fullmatch(r"_\d+", to):
            self.emit(op, to, operands=operands, **more)
            return
        local = re.search(r"_\d+", to)
        if local:
            self.n += 1
            self.emit("STORE", operands=[["reg", local.group()], self.into(f"v{self.n}", op, operands, **more)])

    def call(self, to: str, code: str) -> None:
        depth, at = 0, -1
        for k, c in enumerate(code):
            if c == "<":
                depth += 1
            elif c == ">" and code[k - 1] != "-":
                depth -= 1
            elif c == "(" and depth == 0:
                at = k
                break
        callee = f"rust:{plain(code[:at])}" if at > 0 and not re.match(r"(?:move|copy) ", code) else ""
        args = [self.value(a) for a in _parts(code[at + 1 : -1])]
        i = self.emit("CALL", to if re.fullmatch(r"_\d+", to) else None, callee=callee, args=args)
        if callee:
            self.calls.append({"id": i["id"], "callee": callee, "method_name": "", "untyped": False})


def lower(files: DataFrame) -> DataFrame:
    """(path, error, functions...) of dumps (path, text): a row for each function, or one with the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist()):
                found, error = [], "no function in it"
                for body in bodies(text or ""):
                    try:
                        found.append((*_Mir(path, body).row, path, None))
                    except (ValueError, RecursionError) as e:
                        error = f"{type(e).__name__}: {e}"
                out += found or [(None,) * 8 + (path, error)]
            yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate(KINDS)], [*COLS, "path", "error"])

    return files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(run, FUNCTION + ", path string, error string")
