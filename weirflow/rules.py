"""Rules: what they hold, how they are read, merged and checked."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from weirflow.functions.globs import matches
from weirflow.functions.guards import Guard
from weirflow.functions.scalars import CONFIDENCES, SEVERITIES


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class Sink:
    pattern: str
    args: tuple[int, ...] = ()
    when: str | None = None

    @classmethod
    def parse(cls, spec: str | dict) -> Sink:
        when = None
        if isinstance(spec, dict):
            when, spec = spec.get("when"), spec["match"]
        pattern, mark, pins = spec.partition("#")
        if mark and not re.fullmatch(r"\d+(,\d+)*", pins):
            raise RuleError(f"malformed sink {spec!r}")
        if not pattern:
            raise RuleError(f"sink without a pattern: {spec!r}")
        return cls(pattern, tuple(int(p) for p in pins.split(",")) if mark else (), when)


@dataclass
class Rule:
    id: str
    severity: str = "medium"
    confidence: str = "high"
    cwe: str = ""
    message: str = ""
    kind: str = "taint"
    languages: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    sinks: list[Sink] = field(default_factory=list)
    sanitizers: list[str] = field(default_factory=list)
    propagators: list[str] = field(default_factory=list)
    validators: list[str] = field(default_factory=list)
    callees: list[str] = field(default_factory=list)
    const_arg: tuple[int, str] | None = None
    matches: str | None = None
    when: str | None = None
    request_objects: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._seen: dict[tuple[str, str], bool] = {}

    def is_(self, role: str, callee: str) -> bool:
        if not callee:
            return False
        key = role, callee
        if key not in self._seen:
            self._seen[key] = any(matches(callee, p) for p in getattr(self, role))
        return self._seen[key]

    def sink(self, callee: str) -> Sink | None:
        """The first entry that matches, with the rule's guard where it has none of its own."""
        for s in self.sinks if callee else []:
            if matches(callee, s.pattern):
                return Sink(s.pattern, s.args, s.when or self.when)
        return None

    def speaks(self, lang: str) -> bool:
        return not self.languages or lang.lower() in {x.lower() for x in self.languages}


_LISTS = ("languages", "sources", "sanitizers", "propagators", "validators", "callees", "request_objects")


def _merged(base: dict, own: dict) -> dict:
    """Lists: the fragment's first, then the rule's, each item once; other fields: the rule's win."""
    out = dict(base)
    for k, v in own.items():
        out[k] = [*dict.fromkeys(map(_frozen, [*base.get(k, []), *v]))] if isinstance(v, list) else v
    return {k: [_thawed(x) for x in v] if isinstance(v, list) else v for k, v in out.items()}


def _frozen(x: Any) -> Any:
    return json.dumps(x, sort_keys=True) if isinstance(x, dict) else x


def _thawed(x: Any) -> Any:
    return json.loads(x) if isinstance(x, str) and x.startswith('{"') else x


def build(raw: list[dict], fragments: dict[str, dict] | None = None, defaults: list[str] = []) -> list[Rule]:
    out: list[Rule] = []
    for r in raw:
        for name in r.get("extend", []):
            if name not in (fragments or {}):
                raise RuleError(f"{r.get('id')}: no fragment {name}")
        base: dict = {}
        for name in r.get("extend", []):
            base = _merged(base, fragments[name])
        r = _merged(base, {k: v for k, v in r.items() if k != "extend"})
        rule = Rule(
            id=r.get("id", ""), severity=r.get("severity", "medium"), confidence=r.get("confidence", "high"), cwe=r.get("cwe", ""), message=r.get("message", ""), kind=r.get("kind", "taint"),
            **{k: list(r.get(k, [])) for k in _LISTS}, sinks=[Sink.parse(s) for s in r.get("sinks", [])],
            const_arg=(int(r["const_arg"]["index"]), r["const_arg"]["matches"]) if r.get("const_arg") else None, matches=r.get("matches"), when=r.get("when"),
        )
        rule.propagators = [*dict.fromkeys([*rule.propagators, *defaults])]
        out.append(rule)
    check(out)
    return out


def check(rules: list[Rule]) -> None:
    ids = [r.id for r in rules]
    twice = sorted({i for i in ids if ids.count(i) > 1})
    if twice:
        raise RuleError(f"rule ids given twice: {', '.join(twice)}")
    for r in rules:
        need = {"taint": ("sources", "sinks"), "dangerous-call": ("callees",), "secret": ("matches",)}.get(r.kind)
        if not r.id or need is None or r.severity not in SEVERITIES or r.confidence not in CONFIDENCES:
            raise RuleError(f"{r.id or '(no id)'}: id, kind, severity or confidence isn't valid")
        missing = [n for n in need if not getattr(r, n)]
        if missing:
            raise RuleError(f"{r.id}: {', '.join(missing)} missing")
        if r.matches is not None:
            try:
                re.compile(r.matches)
            except re.error as e:
                raise RuleError(f"{r.id}: matches {r.matches!r}: {e}") from e
        for g in [r.when, *[s.when for s in r.sinks]]:
            if g and Guard(g).error:
                raise RuleError(f"{r.id}: guard {g!r}: {Guard(g).error}")


def read(path: str | Path) -> list[dict]:
    """The rules of a JSON or, where PyYAML is there, a YAML file or of the files of a folder."""
    p = Path(path)
    if p.is_dir():
        return [r for f in sorted(p.iterdir()) if f.suffix in (".json", ".yaml", ".yml") for r in read(f)]
    text = p.read_text()
    if p.suffix == ".json":
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    return found["rules"] if isinstance(found, dict) and "rules" in found else [found] if isinstance(found, dict) else found or []


def shipped() -> list[Rule]:
    from weirflow import packs

    return build(packs.rules(), defaults=packs.ALWAYS)
