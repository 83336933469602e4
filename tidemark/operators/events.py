"""Events of a stream: types, derived values, validation and routing.

Every DataFrame of events has ``seq``, the arrival order: ties of time, samples, baselines and refusals
go by it. What is refused comes back as rows of its own, with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.policy import Binary, Neg, Num, Ref, Stream

TYPES = {"text": "string", "integer": "long", "real": "double"}
#: Whole numbers beyond this are not exact as reals.
EXACT = 2**53


def expression(e: object, columns: dict[str, tuple[Column, bool]]) -> tuple[Column, bool]:
    """A Column for a derived value, and whether it is whole. Division is real, by zero it is null."""
    if isinstance(e, Num):
        whole = e.text.isdigit()
        return F.lit(int(e.text) if whole else float(e.text)), whole
    if isinstance(e, Ref):
        return columns[e.name]
    if isinstance(e, Neg):
        c, whole = expression(e.of, columns)
        return -c, whole
    assert isinstance(e, Binary)
    (a, wa), (b, wb) = expression(e.left, columns), expression(e.right, columns)
    if e.op == "/":
        return F.try_divide(a.cast("double"), b.cast("double")), False
    whole = wa and wb
    if not whole:
        a, b = a.cast("double"), b.cast("double")
    else:
        a, b = a.cast("long"), b.cast("long")
    return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[e.op](a, b), whole


def with_derived(df: DataFrame, s: Stream) -> DataFrame:
    columns = {v.name: (F.col(v.name), v.type == "integer") for v in s.values}
    for d in s.derived:
        value, whole = expression(d.expr, columns)
        df = df.withColumn(d.name, value.cast("long" if whole else "double"))
        columns[d.name] = (F.col(d.name), whole)
    return df


def fields(s: Stream) -> list[tuple[str, str]]:
    """(name, Spark type) of what an event of the stream brings, ts first."""
    return [("ts", "long"), *([(s.id.name, TYPES[s.id.type])] if s.id else []), *((f.name, TYPES[f.type]) for f in [*s.keys, *s.values])]


def where(df: DataFrame, s: Stream) -> DataFrame:
    """Rows that meet the stream's conditions; a field that is absent or null meets none."""
    for name, text in s.where:
        df = df.filter((F.col(name) == text) if name in df.columns else F.lit(False))
    return df


def prepare(df: DataFrame, s: Stream) -> tuple[DataFrame, DataFrame]:
    """(events, refused) of rows with the stream's fields and seq.

    Fields are cast to their types; a row is refused whole if one is null or cannot be cast, a real is not
    finite, a whole value is beyond 2**53, or a derived value divides by zero or overflows.
    """
    given = dict(df.dtypes)
    want = fields(s)
    reason = None

    def refuse(test: Column, why: str) -> None:
        nonlocal reason
        reason = F.when(test, why) if reason is None else reason.when(test, why)

    out = df
    for name, kind in want:
        c = F.col(name)
        refuse(c.isNull(), f"{name} is null")
        if kind == "long" and given[name] in ("double", "float"):
            refuse((c != F.floor(c)) | F.isnan(c) | (F.abs(c) > EXACT), f"{name} is not a whole number")
        if kind == "long" and given[name].startswith("decimal"):
            refuse(c != F.floor(c), f"{name} is not a whole number")
        out = out.withColumn(f"__{name}", c.try_cast(kind))
        refuse(F.col(f"__{name}").isNull(), f"{name} is not {kind}")
    for v in s.values:
        c = F.col(f"__{v.name}")
        if v.type == "integer":
            refuse(F.abs(c) > EXACT, f"{v.name} is beyond 2^53")
        else:
            refuse(F.isnan(c) | (F.abs(c) == float("inf")), f"{v.name} is not finite")
    names = [n for n, _ in want]
    extra = [c for c in ("line",) if c in df.columns]
    typed = out.select("seq", *(F.col(f"__{n}").alias(n) for n in names), *extra, F.coalesce(reason, F.lit("")).alias("__reason"))
    typed = with_derived(typed, s)
    for d in s.derived:
        c = F.col(d.name)
        bad = c.isNull() if dict(typed.dtypes)[d.name] == "bigint" else c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        typed = typed.withColumn("__reason", F.when((F.col("__reason") == "") & bad, f"{d.name} has no value").otherwise(F.col("__reason")))
    good = typed.filter("__reason = ''").drop("__reason")
    return good, typed.filter("__reason <> ''").select("seq", F.col("__reason").alias("reason"))


def unsent(df: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """Rows of df (source, sent, seq) that were not applied before: a sender's number must exceed all of
    its that arrived earlier, and the last one committed. A null source sends without numbers."""
    from pyspark.sql import Window

    before = Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("__high", F.max("sent").over(before))
    if committed is not None:
        out = out.join(committed.select("source", F.col("sent").alias("__done")), "source", "left")
    else:
        out = out.withColumn("__done", F.lit(None).cast("long"))
    high = F.greatest("__high", "__done")
    return out.filter(F.col("source").isNull() | high.isNull() | (F.col("sent") > high)).drop("__high", "__done")
