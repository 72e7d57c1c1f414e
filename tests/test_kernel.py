"""The transfer of one function, each behaviour with a safe twin."""

from weirflow.operators.kernel import Kernel
from weirflow.rules import build

RULE = {"id": "r", "sources": ["src"], "sinks": ["sink", "pin#1", {"match": "guarded", "when": "not hostFixed()"}], "sanitizers": ["clean"], "propagators": ["prop"], "validators": ["ok"]}


def reg(n):
    return ["reg", n]


def const(s):
    return ["const", s, "string"]


class Build:
    def __init__(self, params=()):
        self.f = {"key": "f", "params": list(params), "blocks": [], "seeds": {}}
        self.n = 0

    def block(self, index, preds, succs, *instrs):
        for i in instrs:
            self.n += 1
            i.setdefault("id", f"i{self.n}")
        self.f["blocks"].append({"index": index, "preds": preds, "succs": succs, "instrs": list(instrs)})
        return self

    def run(self, facts=(), **rule):
        return Kernel(self.f, build([RULE | rule])[0], list(facts)).run()


def origins(k):
    """The facts that go out with their origins, without the way."""
    return {fact: origin for fact, (origin, _) in k.out.items()}


def call(callee, *args, name=None, **k):
    return {"op": "CALL", "callee": callee, "args": list(args), "name": name, **k}


def op(kind, *ops, name=None, **k):
    return {"op": kind, "operands": list(ops), "name": name, **k}


def line(*instrs, params=()):
    return Build(params).block(0, [], [], *instrs)


def hits(b, *a, **k):
    return [f["sink"] for f in b.run(*a, **k).findings]


SRC = lambda n="a": call("src", name=n)


def test_flow_sanitizer_and_rule_isolation():
    assert hits(line(SRC(), call("prop", reg("a"), name="b"), call("sink", reg("b"), id="S"))) == ["S"]
    assert not hits(line(SRC(), call("clean", reg("a"), name="b"), call("sink", reg("b"))))
    assert not hits(line(SRC(), call("unknown", reg("a"), name="b"), call("sink", reg("b"))))
    assert not hits(line(SRC(), call("sink", reg("a"))), sources=["other"])


def test_sanitizer_beats_a_return_summary():
    b = line(SRC(), call("clean", reg("a"), name="b", targets=["g"]), call("sink", reg("b")))
    assert not hits(b, [("ret", "g", "o")])
    assert hits(line(call("g", name="b", targets=["g"]), call("sink", reg("b"), id="S")), [("ret", "g", "o")]) == ["S"]


def test_phi_and_loop():
    b = Build().block(0, [], [1], SRC()).block(1, [0, 1], [1, 2], op("PHI", const(""), reg("c"), name="b"), op("BIN_OP", reg("b"), reg("a"), name="c")).block(2, [1], [], call("sink", reg("b"), id="S"))
    assert hits(b) == ["S"]


def test_pins_and_logical_args():
    assert hits(line(SRC(), call("pin", const("q"), reg("a"), id="S"))) == ["S"]
    assert not hits(line(SRC(), call("pin", reg("a"), const("q"))))
    assert hits(line(SRC(), call("pin", reg("r"), const("q"), reg("a"), method_name="m", id="S"))) == ["S"]
    assert not hits(line(SRC(), call("pin", const("q"), const("x"), reg("a"))))


def test_strong_update_of_what_does_not_escape():
    alloc = op("ALLOC", name="p")
    dirty, clean = op("STORE", reg("p"), reg("a")), op("STORE", reg("p"), const("x"))
    load = [op("LOAD", reg("p"), name="v"), call("sink", reg("v"), id="S")]
    assert hits(line(SRC(), alloc, dirty, *load)) == ["S"]
    assert not hits(line(SRC(), alloc, dirty, clean, *load))
    assert hits(line(SRC(), alloc, clean, dirty, *load)) == ["S"]
    assert hits(line(SRC(), alloc, dirty, call("keep", reg("p")), clean, *load)) == ["S"]


def test_fields_and_containers():
    def store(field):
        return [SRC(), op("FIELD_ADDR", reg("s"), name="f", field_index=1), op("STORE", reg("f"), reg("a")), op("FIELD", reg("s"), name="v", field_index=field)]

    assert hits(line(*store(1), call("sink", reg("v"), id="S"))) == ["S"]
    assert not hits(line(*store(2), call("sink", reg("v"))))
    assert not hits(line(*store(2), call("sink", reg("s"))))  # sinks don't look into fields
    assert line(*store(2), call("g", reg("s"), targets=["g"])).run().out[("param", "g", "0")]  # calls do
    assert hits(line(SRC(), op("INDEX_ADDR", reg("s"), name="f"), op("STORE", reg("f"), reg("a")), call("sink", reg("s"), id="S"))) == ["S"]


def test_globals_params_returns_memory():
    assert origins(line(SRC(), op("STORE", ["global", "G"], reg("a"))).run()) == {("global", "", "G"): "i1"}
    b = line(op("LOAD", ["global", "G"], name="x"), call("sink", reg("x"), id="S"))
    assert b.run([("global", "G", "o")]).findings == [{"sink": "S", "callee": "sink", "origin": "o", "confidence": "medium", "steps": ["o", "i1", "S"]}]
    assert not hits(b)
    assert origins(line(op("RET", reg("p")), params=["p"]).run([("param", "0", "o")])) == {("ret", "", ""): "o"}
    assert origins(line(SRC(), op("FIELD_ADDR", reg("p"), name="f", field_index=0), op("STORE", reg("f"), reg("a")), params=["p"]).run()) == {("mem", "", "0"): "i1"}
    assert hits(line(call("g", reg("x"), targets=["g"]), call("sink", reg("x"), id="S")), [("mem", "g#0", "o")]) == ["S"]


def test_confidence():
    assert line(SRC(), call("sink", reg("a"))).run().findings[0]["confidence"] == "high"
    assert line(call("sink", reg("p")), params=["p"]).run([("param", "0", "o")]).findings[0]["confidence"] == "medium"


def test_wrappers_in_dependencies():
    b = line(call("sink", reg("p"), id="S"), params=["p"])
    b.f["is_target"] = False
    k = b.run([("param", "0", "o")])
    assert not k.findings and origins(k) == {("sink", "", "0"): "S"}
    assert hits(line(SRC(), call("g", reg("a"), targets=["g"], id="C")), [("sink", "g#0", "S")]) == ["C"]
    assert not hits(line(SRC(), call("g", const("x"), targets=["g"])), [("sink", "g#0", "S")])


def guarded(arg="a"):
    test = [SRC(), call("src", name="z"), call("ok", reg(arg), name="v"), op("IF", reg("v"))]
    return Build().block(0, [], [1, 2], *test).block(1, [0], [], call("sink", reg("a"), id="S")).block(2, [0], [])


def test_validators():
    assert not hits(guarded())
    assert hits(guarded("z")) == ["S"]
    assert hits(guarded(), validators=[]) == ["S"]
    after = Build().block(0, [], [1, 2], SRC(), call("ok", reg("a"), name="v"), op("IF", reg("v"))).block(1, [0], [2]).block(2, [0, 1], [], call("sink", reg("a"), id="S"))
    after.f["blocks"][0]["succs"] = [1, 3]
    after.f["blocks"][2]["preds"] = [1, 3]
    after.block(3, [0], [2])
    assert hits(after) == ["S"]
    assert ("ret", "", "") not in line(SRC(), call("ok", reg("a")), op("RET", reg("a"))).run().out


def test_dynamic_hosts():
    url = lambda s: line(SRC(), op("BIN_OP", const(s), reg("a"), name="u", bin_op="ADD"), call("guarded", reg("u"), id="S"))
    assert hits(url("https://")) == ["S"] and not hits(url("https://host/"))


def test_callbacks():
    b = line(call("", reg("x"), recv=reg("f")), params=["f", "x"])
    facts = [("param", "1", "o"), ("func", "0", "g")]
    assert origins(b.run(facts)) == {("param", "g", "0"): "o"}
    assert not b.run([*facts, ("func", "0", "h")]).out
    assert not b.run([*facts, ("opaque", "0", "?")]).out
    k = line(call("g", ["func", "h"], reg("y"), targets=["g"], passes_on=True)).run()
    assert origins(k) == {("func", "g", "0", "h"): "h", ("opaque", "g", "1"): "?"}


def test_closures_maps_and_inert_operations():
    assert origins(line(SRC(), op("INTRINSIC", ["func", "g"], reg("a"), name="c", intrinsic="builtin.make_closure", n_params=3)).run()) == {("param", "g", "2"): "i1"}
    assert hits(line(SRC(), op("INTRINSIC", reg("m"), const("k"), reg("a"), intrinsic="go.map.update"), call("sink", reg("m"), id="S"))) == ["S"]
    assert not hits(line(SRC(), op("INTRINSIC", reg("a"), const("k"), name="b", intrinsic="builtin.compare"), call("sink", reg("b"))))


def test_untyped_calls_need_one_target():
    assert not line(SRC(), call("x", reg("a"), targets=["g", "h"], untyped=True)).run().out
    assert len(line(SRC(), call("x", reg("a"), targets=["g", "h"])).run().out) == 2


def test_steps_from_source_to_sink():
    (f,) = line(SRC(), op("BIN_OP", reg("a"), name="b"), op("CONVERT", reg("b"), name="c"), call("sink", reg("c"))).run().findings
    assert f["steps"] == ["i1", "i2", "i3", "i4"]
    b = line(call("sink", reg("q")), call("g", reg("q"), targets=["g"]), params=["p", "q"])
    k = b.run([("param", "1", "o", "o\nway")])
    assert k.findings[0]["steps"] == ["o", "way", "i1"] and k.out["param", "g", "0"] == ("o", "o\nway\ni2")
    (f,) = line(call("g", reg("x"), name="r", targets=["g"]), call("sink", reg("r"))).run([("ret", "g", "o", "o\nback")]).findings
    assert f["steps"] == ["o", "back", "i1", "i2"]
    loop = Build().block(0, [], [1], SRC()).block(1, [0, 1], [1, 2], op("PHI", reg("a"), reg("w"), name="v"), op("BIN_OP", reg("v"), name="w")).block(2, [1], [], call("sink", reg("w")))
    assert loop.run().findings[0]["steps"] == ["i1", "i2", "i3", "i4"]


def test_further_arguments_go_to_the_last_parameter():
    b = line(call("sink", reg("rest")), params=["p", "rest"])
    b.f["rest"] = 1
    assert len(b.run([("param", "4", "o")]).findings) == 1 and not b.run([("param", "0", "o")]).findings
    b.f["rest"] = None
    assert not b.run([("param", "4", "o")]).findings
