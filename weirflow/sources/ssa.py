"""Functions of the engine under construction: blocks, values and the row that comes out of them."""

from __future__ import annotations

import json

import pyarrow as pa

COLS = ["fn", "method_name", "lang", "is_target", "body", "calls", "reads", "indirect"]
CALLS = pa.list_(pa.struct([("id", pa.string()), ("callee", pa.string()), ("method_name", pa.string()), ("untyped", pa.bool_())]))
KINDS = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), CALLS, pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string()]


class Builder:
    """One function while it is lowered, in SSA form on the fly (Braun et al., 2013)."""

    def __init__(self, key: str):
        self.key = key
        self.blocks: list[dict] = []
        self.defs: list[dict[str, list]] = []
        self.sealed: list[bool] = []
        self.open: list[dict[str, dict]] = []
        self.n = 0
        self.reads: set[str] = set()
        self.indirect = False
        self.loops: list[tuple[int, int]] = []
        self.params: list[str] = []
        self.rest: int | None = None  # the parameter that takes this argument and all after it
        self.here = self.block()
        self.seal(self.here)

    def block(self, *preds: int) -> int:
        self.blocks.append({"index": len(self.blocks), "preds": [], "succs": [], "instrs": []})
        self.defs.append({})
        self.sealed.append(False)
        self.open.append({})
        for p in preds:
            self.edge(p, len(self.blocks) - 1)
        return len(self.blocks) - 1

    def edge(self, a: int, b: int) -> None:
        if b not in self.blocks[a]["succs"]:
            self.blocks[a]["succs"].append(b)
            self.blocks[b]["preds"].append(a)

    def write(self, var: str, v: list, b: int | None = None) -> None:
        self.defs[self.here if b is None else b][var] = v

    def read(self, var: str, b: int | None = None) -> list:
        b = self.here if b is None else b
        if var in self.defs[b]:
            return self.defs[b][var]
        preds = self.blocks[b]["preds"]
        if not self.sealed[b]:
            phi = self.phi(b)
            self.open[b][var] = phi
            v = ["reg", phi["name"]]
        elif len(preds) == 1:
            v = self.read(var, preds[0])
        elif not preds:
            v = ["undef", var]
        else:
            phi = self.phi(b)
            self.write(var, ["reg", phi["name"]], b)
            v = self.fill(var, phi, b)
        self.write(var, v, b)
        return v

    def phi(self, b: int) -> dict:
        self.n += 1
        i = {"op": "PHI", "name": f"t{self.n}", "operands": [], "id": f"{self.key}:phi{self.n}"}
        self.blocks[b]["instrs"].insert(0, i)
        return i

    def fill(self, var: str, phi: dict, b: int) -> list:
        ops = [self.read(var, p) for p in self.blocks[b]["preds"]]
        phi["operands"] = [o for o in ops if o[0] != "undef" and o != ["reg", phi["name"]]]
        others = {tuple(o) for o in phi["operands"]}
        if not others:
            self.blocks[b]["instrs"].remove(phi)
            return ["undef", var]
        return ["reg", phi["name"]]

    def seal(self, b: int) -> None:
        self.sealed[b] = True
        for var, phi in self.open[b].items():
            self.fill(var, phi, b)
        self.open[b] = {}

    def add(self, op: str, place: str, named: bool = True, **more) -> list:
        """A new instruction here; ``place`` is file:line:col."""
        self.n += 1
        i = {"op": op, "id": f"{place}:{self.n}", **more}
        if named:
            i["name"] = f"t{self.n}"
        self.blocks[self.here]["instrs"].append(i)
        return ["reg", f"t{self.n}"]

    def row(self, lang: str, method: str, seeds: dict[str, str]) -> tuple:
        calls = []
        for b in self.blocks:
            for i in b["instrs"]:
                i["operands"] = [o for o in i.get("operands", []) if o[0] != "undef"] if i["op"] == "PHI" else i.get("operands", [])
                if i.get("callee"):
                    calls.append({"id": i["id"], "callee": i["callee"], "method_name": i.get("method", ""), "untyped": bool(i.get("method"))})
        body = json.dumps({"params": self.params, "blocks": self.blocks, "seeds": seeds, "rest": self.rest})
        return (self.key, method, lang, True, body, calls, sorted(self.reads), self.indirect)
