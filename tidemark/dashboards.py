"""A policy made from a dashboard: every panel kept ready by a stream from logs."""

from __future__ import annotations

import json
import re

from tidemark.policy import PolicyError, log_pattern, parse

FORMAT = "<timestamp> <level> <service> <message>"
_PERCENTILE = re.compile(r"p(\d{1,2}|999)")
_BLOCK = "stream {name} from logs{where} {{\n{lines}\n}}\n"


class DashboardError(ValueError):
    pass


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '\\"') + '"'


def _stream(name: str, where: dict[str, str], lines: list[str]) -> str:
    told = " and ".join(f"{k} = {_quoted(v)}" for k, v in where.items())
    return _BLOCK.format(name=name, where=f" where {told}" if told else "", lines="\n".join("  " + x for x in lines))


def _usable(name: str) -> bool:
    try:
        return bool(parse(f"stream {name} {{ value v }}"))
    except PolicyError:
        return False


def _name(where: dict, field: str, by: list[str], taken: set[str]) -> str:
    words = [*(where.values() or ["all"]), *([field] if field else [])]
    name = re.sub("[^a-z0-9]+", "_", "_".join(words).lower()).strip("_") + (f"_by_{'_'.join(by)}" if by else "")
    name = name if re.match("[a-z]", name) else f"s_{name}"
    name = name[:40].rstrip("_") if len(name) > 40 else name
    out, k = name, 1
    while out in taken or not _usable(out):
        k += 1
        out = f"{name}_{k}"
    taken.add(out)
    return out


def _check(panel: dict, k: int) -> dict:
    unknown = set(panel) - {"title", "type", "measure", "field", "by", "where", "top"}
    title = panel.get("title") or f"panel {k}"
    if unknown:
        raise DashboardError(f'"{title}": {", ".join(sorted(unknown))} is not known')
    kind, measure = panel.get("type") or "timeseries", str(panel.get("measure", "")).lower()
    field, by, where = panel.get("field") or "", list(panel.get("by") or []), dict(sorted((panel.get("where") or {}).items()))
    if kind not in ("timeseries", "toplist"):
        raise DashboardError(f'"{title}": type is timeseries or toplist, not {kind}')
    counts = measure in ("count", "rate")
    if not counts and measure not in ("sum", "avg", "min", "max") and not _PERCENTILE.fullmatch(measure):
        raise DashboardError(f'"{title}": {measure} is no measure')
    if counts == bool(field):
        raise DashboardError(f'"{title}": {measure} ' + ("takes no field" if counts else "needs a field"))
    for f in [*([field] if field else []), *by, *where]:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", f):
            raise DashboardError(f'"{title}": field {f} has more than lowercase letters, digits and _')
    if field in by:
        raise DashboardError(f'"{title}": {field} is both measured and grouped by')
    return {"title": title, "type": kind, "measure": measure, "field": field, "by": by, "where": where, "top": panel.get("top") or 10}


def import_dashboard(text: str) -> tuple[str, list[tuple[str, str]]]:
    """(policy text, [(panel's title, stream)]) of a dashboard in JSON.

    Panels that filter, group and measure alike share a stream. Two streams are always there: all lines, and
    errors where the format has a level.
    """
    try:
        board = json.loads(text)
    except ValueError as e:
        raise DashboardError(f"the dashboard does not read: {e}") from None
    if unknown := set(board) - {"title", "logs", "panels"}:
        raise DashboardError(f"{', '.join(sorted(unknown))} is not known")
    if not board.get("panels"):
        raise DashboardError("the dashboard has no panels")
    logs = board.get("logs") or {}
    form = logs.get("format") or FORMAT
    fields = log_pattern(form)[1]
    keys = [f"key {f} text" for f in ("service", "level") if f in fields]
    minute = "rollup 1m keep 30d"
    blocks = ["logs {\n" + "".join(f"  {x}\n" for x in [f"format {_quoted(form)}", *(f"mask {_quoted(m)}" for m in logs.get("masks") or [])]) + "}\n"]
    blocks.append(_stream("lines", {}, [*keys, "key template integer", "raw keep 48h", minute, "rollup 10m keep 30d", "samples 1 per 10m"]))
    if "level" in fields:
        blocks.append(_stream("errors", {"level": "ERROR"}, [*(k for k in keys if "level" not in k), "key template integer", minute, "samples 5 per 1m"]))
    shared: dict[str, dict] = {}
    taken, plans = {"lines", "errors"}, []
    for k, raw in enumerate(board["panels"], 1):
        p = _check(raw, k)
        mark = json.dumps([p["where"], p["by"], p["field"]])
        if mark not in shared:
            shared[mark] = p | {"name": _name(p["where"], p["field"], p["by"], taken), "quantiles": False, "told": []}
        g = shared[mark]
        g["quantiles"] |= bool(_PERCENTILE.fullmatch(p["measure"]))
        what = p["measure"] + (f" of {p['field']}" if p["field"] else "")
        g["told"].append(f'# "{p["title"]}": ' + (f"top {p['top']} by {what}" if p["type"] == "toplist" else what))
        plans.append((p["title"], g["name"]))
    for g in shared.values():
        lines = [f"key {b} {'integer' if b == 'template' else 'text'}" for b in g["by"]]
        lines += [f"value {g['field']} real"] if g["field"] else []
        lines += [minute + (f" quantiles {g['field']}" if g["quantiles"] else "")]
        lines += [f"anomalies {g['field']} log z > 4 keep 5 per 1m"] if g["quantiles"] else []
        blocks.append("\n".join([*g["told"], _stream(g["name"], g["where"], lines)]))
    made = "\n".join(blocks)
    parse(made)
    return made, plans
