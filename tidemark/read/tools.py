"""The tools that read a state: answers, windows, kept events, the catalogue, and one SQL statement.

get_windows plans before it reads: of the stream's rollups it takes one whose windows make up the windows
asked for and reach back far enough, and merges its summaries and sketches.
"""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import window_start, within_period
from tidemark.operators import answers, rollup, sketch
from tidemark.policy import FOREVER, Policy, Rollup, Stream, format_duration, parse
from tidemark.state import Manifest, Store

ROWS, WINDOWS, POINTS = 500, 1000, 60
#: Seconds that one statement may take.
PATIENCE = 5.0


@dataclass
class Answer:
    """Rows, whether there are more, and what to know about them."""

    rows: DataFrame
    limit: int
    notes: list[str]
    #: Seconds after which taking the rows is given up; None waits.
    patience: float | None = None

    def take(self) -> tuple[list, bool]:
        context = self.rows.sparkSession.sparkContext
        if self.patience is None:
            got = self.rows.limit(self.limit + 1).collect()
            return got[: self.limit], len(got) > self.limit
        tag = f"tidemark-{uuid.uuid4().hex}"
        late = threading.Event()

        def give_up() -> None:
            late.set()
            context.cancelJobsWithTag(tag)

        timer = threading.Timer(self.patience, give_up)
        context.addJobTag(tag)
        timer.start()
        try:
            got = self.rows.limit(self.limit + 1).collect()
        except Exception as e:
            if late.is_set():
                raise TimeoutError(f"the query took more than {self.patience:g} seconds") from e
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)
        return got[: self.limit], len(got) > self.limit


def _filtered(df: DataFrame, where: dict | None) -> tuple[DataFrame, list[str]]:
    """df at the asked values (one, or a list of them); and the columns that are now all alike."""
    fixed = []
    for name, value in (where or {}).items():
        if name not in df.columns:
            raise ValueError(f"there is no column {name}; there are {', '.join(df.columns)}")
        values = value if isinstance(value, list) else [value]
        df = df.filter(F.col(name).isin(values))
        fixed += [name] if len(values) == 1 else []
    return df, fixed


def get_answer(store: Store, name: str, where: dict | None = None, period: str | None = None, limit: int = ROWS) -> Answer:
    """A precompute or quota by name, ordered by its keys and the period; the period asked for, or parts of it."""
    manifest = store.read()
    policy = parse(manifest.policy)
    q = next((q for q in policy.quotas if q.name == name), None)
    p = policy.precompute(q.precompute if q else name)
    if p is None:
        known = [x.name for x in [*policy.precomputes, *policy.quotas]]
        raise ValueError(f"there is no answer {name}; there are {', '.join(known)}")
    shared = store.table(manifest, answers.state_name(p))
    if shared is None:
        raise ValueError(f"{name} has no events yet")
    df = answers.answer(shared, policy, p)
    if q:
        limits = store.table(manifest, f"{q.name}_limit")
        if limits is None:
            raise ValueError(f"{name} has no limits yet")
        df = answers.quota(limits, df, policy, q)
    if period:
        df = df.filter(within_period(F.col("period"), period))
    df, fixed = _filtered(df, where)
    by = [c for c in answers.by_columns(p) if c not in fixed]
    return Answer(df.select(*by, *(c for c in df.columns if c not in answers.by_columns(p))).orderBy(*by) if by else df.drop(*fixed), limit, [])


def candidates(s: Stream, start: int, every: int | None, now: int, percentiles: str | None) -> list[Rollup]:
    """Rollups that can answer: their windows make up those asked for and still reach back to start."""
    reach = lambda r: r.keep == FOREVER or start > now - (r.keep + r.res)
    return [r for r in s.rollups if (every is None or every % r.res == 0) and reach(r) and (not percentiles or percentiles in r.quantiles or every is None)]


def choose(s: Stream, start: int, end: int, every: int | None, now: int, percentiles: str | None = None) -> tuple[Rollup, int]:
    """The rollup to read and the length of the windows to show.

    Without a length the finest is taken that shows at most POINTS windows, those with the sketch first.
    With one, aligned rollups come first, then those with the sketch, then the coarsest that is aligned.
    """
    found = candidates(s, start, every, now, percentiles)
    if not found:
        kept = ", ".join(f"{format_duration(r.res)} for {format_duration(r.keep)}" for r in s.rollups)
        raise ValueError(f"no rollup of {s.name} answers that; it keeps {kept}")
    has = lambda r: percentiles is None or percentiles in r.quantiles
    if every is None:
        few = [r for r in found if (end - start) / r.res <= POINTS] or [max(found, key=lambda r: r.res)]
        best = min(few, key=lambda r: (not has(r), r.res))
        length = best.res
        while (end - start) / length > POINTS:
            length *= 2
        return best, length
    aligned = lambda r: start % r.res == 0 and end % r.res == 0
    best = min(found, key=lambda r: (not aligned(r), not has(r), -r.res if aligned(r) else r.res))
    return best, every


def get_windows(store: Store, stream: str, start: int, end: int, every: int | None = None, by: list[str] | None = None, where: dict | None = None, percentiles: dict[str, list[float]] | None = None, limit: int = WINDOWS) -> Answer:
    """Windows of a stream from start to before end, merged to every seconds and the keys by.

    by of [] merges all keys. percentiles is {value: [0.5, ...]} for one value.
    """
    manifest = store.read()
    s = parse(manifest.policy).stream(stream)
    if s is None or not s.rollups:
        raise ValueError(f"{stream} keeps no windows")
    value = next(iter(percentiles or {}), None)
    chosen, length = choose(s, start, end, every, manifest.now or end, value)
    by = s.key_names if by is None else by
    notes = [f"read from {format_duration(chosen.res)} windows"]
    if start % chosen.res or end % chosen.res:
        notes.append("only whole windows within the range count")

    def within(name: str) -> DataFrame:
        df = store.table(manifest, name)
        df = df.filter((F.col("res") == chosen.res) & (F.col("w") >= start) & (F.col("w") <= end - chosen.res))
        return _filtered(df, where)[0]

    df = rollup.coarser(within(f"{stream}_win"), length, by, s.numbers)
    for v in s.numbers:
        df = df.withColumn(f"{v}_avg", F.col(f"{v}_sum") / F.col("n")).withColumn(f"{v}_sd", rollup.deviation(v))
    if value and value in chosen.quantiles:
        sk = sketch.merge(within(f"{stream}_{value}_sk").withColumn("w", window_start(F.col("w"), length)), ["w", *by])
        for q in percentiles[value]:
            name = f"p{str(q)[2:].ljust(2, '0')}"
            df = df.join(sketch.quantile(sk, ["w", *by], q, s.accuracy, f"{value}_{name}"), ["w", *by], "left")
    elif value:
        notes.append(f"{format_duration(chosen.res)} windows keep no quantiles of {value}")
    return Answer(df.drop("first_seq", "last_seq").orderBy("w", *by), limit, notes)


def newest_windows(store: Store, stream: str, res: int, limit: int = WINDOWS) -> Answer:
    """The newest window of each key in the rollup of res seconds: one pass, the largest w and what goes with it."""
    manifest = store.read()
    s = parse(manifest.policy).stream(stream)
    if s is None or s.rollup(res) is None:
        raise ValueError(f"{stream} keeps no windows of {format_duration(res)}")
    df = store.table(manifest, f"{stream}_win").filter(F.col("res") == res)
    rest = [c for c in df.columns if c not in s.key_names]
    newest = df.groupBy(*s.key_names).agg(F.max_by(F.struct(*rest), "w").alias("x"))
    return Answer(newest.select(*s.key_names, "x.*").orderBy(*s.key_names), limit, [])


def get_kept(store: Store, stream: str, kind: str, start: int | None = None, end: int | None = None, where: dict | None = None, contains: str | None = None, limit: int = ROWS) -> Answer:
    """Events kept whole: kind is raw, samples, anomalies or templates; contains looks in the line, without case."""
    manifest = store.read()
    name = {"raw": f"{stream}_raw", "samples": f"{stream}_sample", "anomalies": f"{stream}_anomaly", "templates": "templates"}[kind]
    df = store.table(manifest, name)
    if df is None:
        raise ValueError(f"{stream} keeps no {kind}")
    ts = "last_ts" if kind == "templates" else "ts"
    if start is not None:
        df = df.filter(F.col(ts) >= start)
    if end is not None:
        df = df.filter(F.col(ts) < end)
    if contains is not None:
        line = "example" if kind == "templates" else "line"
        df = df.filter(F.contains(F.lower(F.col(line)), F.lower(F.lit(contains))))
    df, _ = _filtered(df, where)
    order = {"anomalies": [F.desc(F.abs("z")), "seq"], "templates": [F.desc("n"), "template"]}.get(kind, ["ts", "seq"])
    return Answer(df.orderBy(*order), limit, [])


_FORBIDDEN = ("Command", "InsertInto", "CreateTable", "CreateView", "DropTable", "DropView", "SetCatalog", "AlterTable", "MergeInto", "UpdateTable", "DeleteFrom", "WriteToDataSource", "SaveAs", "CreateDataSource", "CreateNamespace", "TruncateTable", "LoadData", "RefreshTable", "CacheTable", "UncacheTable", "SetNamespace", "CreateFunction")


def read_only(store: Store, statement: str) -> None:
    """Refuses more than one statement, and any that is not a query."""
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", statement, flags=re.S).strip().rstrip(";")
    if ";" in bare:
        raise ValueError("one statement at a time")
    session = store.spark._jsparkSession
    plan = session.sessionState().sqlParser().parsePlan(statement.strip().rstrip(";"))
    text = plan.toString()
    if any(re.search(rf"^[\s:+'-]*'?{word}", line) for line in text.splitlines() for word in _FORBIDDEN) or not re.match(r"(?is)\s*(select|with|values|from|\()", bare + " "):
        raise ValueError("only a query is allowed")


def query(store: Store, statement: str, limit: int = ROWS, patience: float | None = PATIENCE) -> Answer:
    """One read-only SQL statement over the state's tables and answers, each a temporary view by its name."""
    manifest = store.read()
    policy = parse(manifest.policy)
    views = {name: store.table(manifest, name) for name in manifest.tables}
    views |= {p.name: answers.answer(t, policy, p) for p in policy.precomputes if (t := store.table(manifest, answers.state_name(p))) is not None}
    read_only(store, statement)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return Answer(store.spark.sql(statement.strip().rstrip(";")), limit, [], patience)


def describe(store: Store) -> str:
    """What a state holds, as text."""
    manifest = store.read()
    policy = parse(manifest.policy)
    out = [f"format {manifest.format}, version {manifest.version}, newest event {manifest.now}"]
    for s in policy.streams:
        out.append(f"stream {s.name}{' exact' if s.exact else ''}: keys {', '.join(s.key_names) or '-'}; values {', '.join(s.numbers) or '-'}")
        for r in s.rollups:
            out.append(f"  windows of {format_duration(r.res)} kept {format_duration(r.keep)}" + (f", quantiles of {', '.join(r.quantiles)}" if r.quantiles else ""))
        if s.samples:
            out.append(f"  {s.samples.n} samples per {format_duration(s.samples.per)}")
        if s.anomalies:
            out.append(f"  unusual {s.anomalies.field} kept, z > {s.anomalies.z:g}")
    for p in policy.precomputes:
        out.append(f"answer {p.name} = {p.called}({p.stream}{'.' + p.field if p.field else ''})" + (f" by {', '.join(p.by)}" if p.by else "") + (f" per {p.per}" if p.per else ""))
    out += [f"quota {q.name} of {q.precompute}" for q in policy.quotas]
    out += [f"migrated: {m}" for m in manifest.migrations]
    return "\n".join([*out, "policy:", manifest.policy.strip()])


def describe_keys(store: Store) -> DataFrame:
    """(stream, key, values, least, most, first, last) of each key of streams with windows: how many values it
    has, the first and last of them in order as text, and the times of its first and last event."""
    manifest = store.read()
    out = None
    for s in parse(manifest.policy).streams:
        win = store.table(manifest, f"{s.name}_win")
        if win is None or not s.key_names:
            continue
        win = win.filter(F.col("res") == max(r.res for r in s.rollups))
        each = win.select("first_ts", "last_ts", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in s.key_names))).alias("x"))
        # One row a value first, so that counting values needs no second sort of all windows.
        each = each.groupBy("x.key", "x.value").agg(F.min("first_ts").alias("first"), F.max("last_ts").alias("last"))
        one = each.groupBy("key").agg(F.count(F.lit(1)).alias("values"), F.min("value").alias("least"), F.max("value").alias("most"), F.min("first").alias("first"), F.max("last").alias("last"))
        one = one.select(F.lit(s.name).alias("stream"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no stream keeps windows by key")
    return out


def catalogue(policy: Policy) -> list[dict]:
    """The objects of a policy: name, kind, stream and detail."""
    out = []
    for s in policy.streams:
        out.append({"name": s.name, "kind": "stream", "stream": s.name, "detail": {"keys": s.key_names, "values": [v.name for v in s.values], "derived": [d.name for d in s.derived]}})
        out += [{"name": f"{s.name}_win", "kind": "rollup", "stream": s.name, "detail": {"res": r.res, "keep": r.keep, "quantiles": r.quantiles}} for r in s.rollups]
    out += [{"name": p.name, "kind": "precompute", "stream": p.stream, "detail": {"func": p.called, "field": p.field, "by": p.by, "per": p.per, "table": answers.state_name(p)}} for p in policy.precomputes]
    out += [{"name": q.name, "kind": "quota", "stream": policy.precompute(q.precompute).stream, "detail": {"precompute": q.precompute}} for q in policy.quotas]
    return out


def number_text(x: object, digits: int = 10) -> str:
    """A number with so many significant digits and never an exponent; other values as they are."""
    if x is None:
        return ""
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, int):
        return str(x)
    text = f"{x:.{digits}g}"
    if "e" in text:
        from decimal import Decimal

        text = format(Decimal(text), "f")
    return text


def csv_text(answer: Answer, most: int = 60_000) -> str:
    """An answer as comma-separated text: percentiles with 4 digits, z with 3, others with 10."""
    rows, more = answer.take()
    names = answer.rows.columns
    quote = lambda t: '"' + t.replace('"', '""') + '"' if re.search(r'[",\n]', t) else t
    digits = {n: 4 if re.search(r"_p\d+$", n) else 3 if n == "z" else 10 for n in names}
    lines = [",".join(names)]
    size = len(lines[0])
    for r in rows:
        line = ",".join(quote(number_text(r[n], digits[n])) for n in names)
        size += len(line) + 1
        if size > most:
            more = True
            break
        lines.append(line)
    return "\n".join([*lines, *(f"# {n}" for n in answer.notes), *(["# there are more rows"] if more else [])])


def manifest_of(store: Store) -> Manifest:
    return store.read()
