"""A state moved to a new version of its policy: what is kept stays as it was, what is new starts empty."""

from __future__ import annotations

from dataclasses import dataclass, field

from tidemark.operators import answers
from tidemark.policy import Policy, Stream, format_duration, parse
from tidemark.state import Manifest, Store


@dataclass
class Plan:
    added: list[str] = field(default_factory=list)
    changed: list[str] = field(default_factory=list)
    refused: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


#: What must stay of a stream, what may change, and what may be added but not taken away.
_FIXED = {"keys": "keys", "values": "values", "derived": "derived values", "accuracy": "quantile accuracy", "exact": "being exact", "id": "id", "late": "late", "period": "period", "close": "close", "from_logs": "source"}
_FREE = {"raw_keep": "raw keep", "ahead": "ahead", "repeats": "repeats", "until_closed": "raw until closed", "where": "where", "from_metrics": "metric"}


def _stream(old: Stream, new: Stream, plan: Plan) -> None:
    for name, said in _FIXED.items():
        if getattr(old, name) != getattr(new, name):
            plan.refused.append(f"stream {old.name}: its {said} cannot change")
    for name, said in _FREE.items():
        if getattr(old, name) != getattr(new, name):
            plan.changed.append(f"stream {old.name}: {said}")
    for r in old.rollups:
        now = new.rollup(r.res)
        length = format_duration(r.res)
        if now is None:
            plan.refused.append(f"stream {old.name}: rollup {length} cannot be removed")
        else:
            if now.quantiles != r.quantiles:
                plan.refused.append(f"stream {old.name}: quantiles of rollup {length} cannot change")
            if now.keep != r.keep:
                plan.changed.append(f"stream {old.name}: rollup {length} kept {format_duration(now.keep)}")
    plan.added += [f"stream {old.name}: rollup {format_duration(r.res)}" for r in new.rollups if old.rollup(r.res) is None]
    for name in ("samples", "anomalies"):
        a, b = getattr(old, name), getattr(new, name)
        if a and not b:
            plan.refused.append(f"stream {old.name}: {name} cannot be removed")
        elif b and not a:
            plan.added.append(f"stream {old.name}: {name}")
        elif a != b:
            judged = ("field", "log", "change") if name == "anomalies" else ("per",)
            if any(getattr(a, x) != getattr(b, x) for x in judged):
                plan.refused.append(f"stream {old.name}: what {name} go by cannot change")
            else:
                plan.changed.append(f"stream {old.name}: {name}")


def compare(old: Policy, new: Policy) -> Plan:
    plan = Plan()
    for s in old.streams:
        now = new.stream(s.name)
        if now is None:
            plan.refused.append(f"stream {s.name} cannot be removed")
        else:
            _stream(s, now, plan)
    plan.added += [f"stream {s.name}" for s in new.streams if old.stream(s.name) is None]
    states = {answers.state_name(p): set(answers.numbers_of(old, p)) for p in old.precomputes}
    for p in old.precomputes:
        now = new.precompute(p.name)
        if now is None:
            plan.refused.append(f"precompute {p.name} cannot be removed")
        elif now != p:
            plan.refused.append(f"precompute {p.name} cannot change")
    for p in new.precomputes:
        if old.precompute(p.name):
            continue
        name = answers.state_name(p)
        if name in states and p.func != "quantile":
            if p.field and p.field not in states[name]:
                plan.refused.append(f"precompute {p.name} would add {p.field} to state that is kept already; give it a by or per of its own")
                continue
            plan.notes.append(f"precompute {p.name} answers from the start, by state that is kept already")
        plan.added.append(f"precompute {p.name}")
    for q in old.quotas:
        if q not in new.quotas:
            plan.refused.append(f"quota {q.name} cannot be removed or changed")
    plan.added += [f"quota {q.name}" for q in new.quotas if q not in old.quotas]
    if old.logs and new.logs and (old.logs.similarity, old.logs.depth) != (new.logs.similarity, new.logs.depth):
        plan.refused.append("similarity and depth of templates cannot change")
    elif old.logs and not new.logs:
        plan.refused.append("logs cannot be removed")
    elif old.logs != new.logs:
        plan.changed.append("logs")
    return plan


def migrate(store: Store, text: str, dry_run: bool = False) -> tuple[Plan, Manifest]:
    """The plan, and the state's manifest after it. A refused plan changes nothing and is an error."""
    manifest = store.read()
    plan = compare(parse(manifest.policy), parse(text))
    if plan.refused:
        raise ValueError("; ".join(plan.refused))
    if not dry_run:
        manifest.policy = text
        manifest.version += 1
        manifest.migrations.append({"version": manifest.version, "at": manifest.now, "added": plan.added, "changed": plan.changed})
        store.swap(manifest)
    return plan, manifest
