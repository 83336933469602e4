"""Precomputed answers over shared state, quotas, and the fading of detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import period, period_end
from tidemark.operators import rollup, sketch
from tidemark.policy import FOREVER, Policy, Precompute, Quota, Stream


def group_of(p: Precompute) -> tuple[str, tuple[str, ...], str]:
    """Answers with equal stream, by and per share one table of state."""
    return p.stream, tuple(p.by), p.per


def state_name(p: Precompute) -> str:
    kind = f"_pcq_{p.stream}_{p.field}" if p.func == "quantile" else f"_pc_{p.stream}"
    return kind + (f"_by_{'_'.join(p.by)}" if p.by else "") + (f"_per_{p.per}" if p.per else "")


def _by(p: Precompute) -> list[str | Column]:
    return [*p.by, *([period(F.col("ts"), p.per).alias("period")] if p.per else [])]


def by_columns(p: Precompute) -> list[str]:
    return [*p.by, *(["period"] if p.per else [])]


def numbers_of(policy: Policy, p: Precompute) -> list[str]:
    """Values that the answers of p's group read, in the stream's order."""
    read = {x.field for x in policy.precomputes if group_of(x) == group_of(p) and x.func != "quantile"}
    return [v for v in policy.stream(p.stream).numbers if v in read]


def state(events: DataFrame, policy: Policy, p: Precompute) -> DataFrame:
    """The shared state of p's group over events."""
    if p.func == "quantile":
        return sketch.counts(events, _by(p), p.field, policy.stream(p.stream).accuracy)
    return rollup.summarize(events, _by(p), numbers_of(policy, p))


def merge_state(df: DataFrame, policy: Policy, p: Precompute) -> DataFrame:
    return sketch.merge(df, by_columns(p)) if p.func == "quantile" else rollup.merge(df, by_columns(p), numbers_of(policy, p))


def answer(shared: DataFrame, policy: Policy, p: Precompute) -> DataFrame:
    """(by, period, value). Nothing but a percentile has a row where there were no events."""
    by = by_columns(p)
    if p.func == "quantile":
        return sketch.quantile(shared, by, p.q, policy.stream(p.stream).accuracy)
    value = {"count": F.col("n"), "avg": F.col(f"{p.field}_sum") / F.col("n")}.get(p.func, F.col(f"{p.field}_{p.func}") if p.field else None)
    return shared.filter("n > 0").select(*by, value.alias("value"))


def answers(events: dict[str, DataFrame], policy: Policy) -> dict[str, DataFrame]:
    """Every answer of the policy from events by stream; groups share their aggregate."""
    made: dict[str, DataFrame] = {}
    out = {}
    for p in policy.precomputes:
        name = state_name(p)
        if name not in made:
            made[name] = state(events[p.stream], policy, p)
        out[p.name] = answer(made[name], policy, p)
    return out


def together(events: DataFrame, policy: Policy, names: list[str], newest: list[str] | None = None) -> DataFrame:
    """(by, period, a column for each of names): answers of one group from one aggregate of the events.

    newest adds <value>_newest for each value named: its last one over all periods of the key, merged from
    the groups' own last ones.
    """
    asked = [policy.precompute(n) for n in names]
    p = asked[0]
    if any(group_of(x) != group_of(p) or x.func == "quantile" for x in asked):
        raise ValueError(f"{', '.join(names)} are not answers of one group")
    shared, by = state(events, policy, p), by_columns(p)
    over = Window.partitionBy(*p.by)
    for v in newest or []:
        shared = shared.withColumn(f"{v}_newest", F.max_by(f"{v}_last", rollup.place("last_ts", "last_seq")).over(over))
    value = lambda x: {"count": F.col("n"), "avg": F.col(f"{x.field}_sum") / F.col("n")}.get(x.func, F.col(f"{x.field}_{x.func}") if x.field else None)
    return shared.filter("n > 0").select(*by, *(value(x).alias(x.name) for x in asked), *(f"{v}_newest" for v in newest or []))


def quota(limits: DataFrame, used: DataFrame, policy: Policy, q: Quota) -> DataFrame:
    """(by, period, used, lim, remaining, reached) for keys that have a limit.

    limits is (by, lim), or (lim) of one row for an answer without by.
    """
    p = policy.precompute(q.precompute)
    used = used.withColumnRenamed("value", "used")
    # Without by there is one limit, so the product has as many rows as there are periods.
    both = used.join(limits, p.by) if p.by else used.crossJoin(F.broadcast(limits))
    return both.select(*by_columns(p), "used", "lim", (F.col("lim") - F.col("used")).alias("remaining"), (F.col("used") >= F.col("lim")).cast("int").alias("reached"))


def distill(tables: dict[str, DataFrame], s: Stream, now: int) -> dict[str, DataFrame]:
    """What is left at now of a stream's raw events, windows, sketches, samples and identifiers."""
    out = dict(tables)
    ts, w = F.col("ts"), F.col("w")
    raw = f"{s.name}_raw"
    if raw in out:
        if s.until_closed is not None:
            out[raw] = out[raw].filter(period_end(ts, s.period) + s.close + s.until_closed > now)
        elif s.raw_keep != FOREVER:
            out[raw] = out[raw].filter(ts >= now - s.raw_keep)
    gone = F.lit(False)
    for r in s.rollups:
        if r.keep != FOREVER:
            gone = gone | ((F.col("res") == r.res) & (w <= now - (r.keep + r.res)))
    for name in [f"{s.name}_win", f"{s.name}_sample", *(f"{s.name}_{v}_sk" for v in s.numbers)]:
        if name in out:
            out[name] = out[name].filter(~gone)
    if (ids := f"{s.name}_ids") in out:
        out[ids] = out[ids].filter(ts >= now - s.repeats)
    return out
