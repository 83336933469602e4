"""Log templates by a fixed-depth tree (Drain), as a fold per service and level.

Messages are routed by their number of tokens and their first tokens to a leaf, and join the most alike
template there if enough tokens are equal. That depends on order, so messages are dealt by (service, level) and
folded in order of arrival; equal messages of a block of lines are one row with their places in it. Templates are numbered over all miners by their first line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.numbering import numbered
from tidemark.state import written

WILD = "<*>"
CHILDREN = 100


@dataclass
class Template:
    number: int
    initial: list[str]
    tokens: list[str]
    n: int = 1


@dataclass
class _Node:
    children: dict = field(default_factory=dict)
    templates: list = field(default_factory=list)


class Miner:
    """One tree. depth counts as in the policy: of a depth of 4 the first token routes."""

    def __init__(self, similarity: float = 0.5, depth: int = 4):
        self.similarity, self.layers = similarity, depth - 3
        self.roots: dict[int, _Node] = {}
        self.templates: list[Template] = []
        #: Goes up with each template that is made or changes; until then equal messages get the same one.
        self.version = 0

    def _leaf(self, tokens: list[str], grow: bool) -> _Node | None:
        """The leaf of a message; None if it is too short to reach one, or there is none and none may grow."""
        node = self.roots.setdefault(len(tokens), _Node()) if grow else self.roots.get(len(tokens))
        for token in tokens[: self.layers]:
            if node is None:
                return None
            known = node.children
            if token not in known:
                token = WILD if not grow or any(c.isdigit() for c in token) else self._branch(known, token)
                if grow:
                    known.setdefault(token, _Node())
            node = known.get(token)
        return node if len(tokens) > self.layers else None

    @staticmethod
    def _branch(known: dict, token: str) -> str:
        """A token gets a branch of its own while there is room; the last one is for all others."""
        if WILD in known:
            return token if len(known) < CHILDREN else WILD
        return token if len(known) + 1 < CHILDREN else WILD

    def add(self, tokens: list[str]) -> Template:
        leaf = self._leaf(tokens, False)
        best, score = None, (-1.0, -1)
        for t in leaf.templates if leaf else ():
            wild = t.tokens.count(WILD)
            equal = sum(a == b and a != WILD for a, b in zip(t.tokens, tokens)) / len(tokens)
            if (equal, wild) > score:
                best, score = t, (equal, wild)
        if best is not None and score[0] >= self.similarity:
            merged = [a if a == b else WILD for a, b in zip(best.tokens, tokens)]
            if merged != best.tokens:
                best.tokens = merged
                self.version += 1
            best.n += 1
            return best
        return self.restore(tokens, tokens, 1)

    def restore(self, initial: list[str], tokens: list[str], n: int) -> Template:
        """A template as it was kept; templates must come back in the order they were made in."""
        t = Template(len(self.templates), list(initial), list(tokens), n)
        self.templates.append(t)
        self.version += 1
        if leaf := self._leaf(t.initial, True):
            leaf.templates.append(t)
        return t


#: Lines of so many arrivals in a row are one block. Of a block only its different messages pass through the fold, each
#: with the places where it comes.
BLOCK = 2**16


class _Fold:
    """One key's miner over its blocks. A message's template is looked up once for as long as no template changes."""

    def __init__(self, similarity: float, depth: int, size: int):
        self.miner, self.size = Miner(similarity, depth), size
        self.made: dict[int, list] = {}  # number -> [known number, initial, first seq, n, first_ts, last_ts]

    def restore(self, number: int, initial: str, text: str, n: int) -> None:
        t = self.miner.restore((initial or "").split(), text.split(), n)
        self.made[t.number] = [number, initial, None, 0, None, None]

    def block(self, block: int, messages: list[tuple]) -> list[tuple]:
        """(message, first place, last place, template) of (message, places, times): runs of one template each."""
        order = np.concatenate([p for _, p, _ in messages])
        which = np.repeat(np.arange(len(messages)), [len(p) for _, p, _ in messages])
        times = np.concatenate([t for _, _, t in messages])
        by = np.argsort(order, kind="stable")
        order, which, times = order[by], which[by], times[by]
        tokens = [m.split() for m, _, _ in messages]
        got, settled = np.empty(len(order), np.int64), np.full(len(messages), -1, np.int64)
        at, step = 0, 64
        while at < len(order):
            # Up to the next message that has not been seen since the last change, all have the templates they had.
            some = settled[which[at : at + step]]
            new = some < 0
            stop = int(new.argmax()) if new.any() else len(some)
            got[at : at + stop] = some[:stop]
            at += stop
            if stop == len(some):
                step = min(2 * step, self.size)
                continue
            m, version, step = which[at], self.miner.version, 64
            t = self.miner.add(tokens[m])
            if self.miner.version != version:
                settled[:] = -1
            else:
                settled[m] = t.number
            if t.number not in self.made:
                self.made[t.number] = [None, messages[m][0], block * self.size + int(order[at]), 0, None, None]
            got[at] = t.number
            at += 1
        by = np.argsort(got, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(got[by]) != 0])
        low, high = np.minimum.reduceat(times[by], cut), np.maximum.reduceat(times[by], cut)
        for k, n, first, last in zip(got[by][cut].tolist(), np.diff(np.r_[cut, len(got)]).tolist(), low.tolist(), high.tolist()):
            mine = self.made[k]
            mine[3:] = [mine[3] + n, first if mine[4] is None else min(mine[4], first), last if mine[5] is None else max(mine[5], last)]
        # Places of a message, one after the other, cut where its template is another one.
        by = np.lexsort((order, which))
        order, which, got = order[by], which[by], got[by]
        cut = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (got[1:] != got[:-1])])
        last = np.r_[cut[1:], len(order)] - 1
        return [(messages[which[i]][0], int(order[i]), int(order[j]), int(got[i])) for i, j in zip(cut, last)]


#: What the fold gives: of a run of a message its block, places and template; of a template (block null) what it is.
_FOLDED = "service string, level string, block long, message string, low int, high int, local long, template long, initial string, text string, n long, first_ts long, last_ts long, first long"


def mine(lines: DataFrame, similarity: float = 0.5, depth: int = 4, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines with template, templates) of lines (seq, ts, service, level, masked, line).

    templates has template, service, level, text, initial, n, first_ts, last_ts and example, the first line. known
    is what an earlier batch gave: its templates are restored, in the order they were made in, before the first
    new line is looked at; their numbers stay and new ones go on from the largest.
    """
    size = BLOCK
    block, place, message = F.floor(F.col("seq") / size), F.pmod("seq", F.lit(size)).cast("int"), F.coalesce("masked", F.lit(""))
    # Two lists of one aggregate are in the same order.
    new = lines.groupBy("service", "level", block.alias("block"), message.alias("message")).agg(F.collect_list(place).alias("places"), F.collect_list(F.col("ts").cast("long")).alias("times"))
    none = lambda t: F.lit(None).cast(t)
    new = new.select("service", "level", F.lit(1).alias("fresh"), "block", "message", "places", "times", none("string").alias("text"), none("long").alias("n"))
    if known is not None:
        new = new.union(known.select("service", "level", F.lit(0), "template", "initial", none("array<int>"), none("array<bigint>"), "text", "n"))
    keyed = new.repartition("service", "level").sortWithinPartitions("service", "level", "fresh", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, held, fold = None, None, [], None

        def closed() -> list[tuple]:
            out = [(*key, at, *x, None, None, None, None, None, None, None) for x in fold.block(at, held)] if held else []
            held.clear()
            return out

        def told() -> list[tuple]:
            texts = fold.miner.templates
            return [(*key, None, None, None, None, k, m[0], m[1], " ".join(texts[k].tokens), m[3], m[4], m[5], m[2]) for k, m in fold.made.items()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), folded)], schema=folded)

        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                service, level, fresh, b, message, text, n = (batch.column(c)[k].as_py() for c in ("service", "level", "fresh", "block", "message", "text", "n"))
                if (service, level) != key or fold is None:
                    if fold is not None:
                        out += closed() + told()
                    key, at, fold = (service, level), None, _Fold(similarity, depth, size)
                if not fresh:
                    fold.restore(b, message, text, n)
                    continue
                if b != at:
                    out += closed()
                    at = b
                held.append((message, *(batch.column(c)[k].values.to_numpy() for c in ("places", "times"))))
            if out:
                yield packed(out)
        if fold is not None:
            yield packed(closed() + told())

    folded = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[t]) for n, t in (c.split() for c in _FOLDED.split(", "))])
    mined = written(keyed.mapInArrow(run, _FOLDED), "mined")
    made = mined.filter("block IS NULL").drop("block", "message", "low", "high")
    most = known.agg(F.max("template")).first()[0] or 0 if known is not None else 0
    # New templates are numbered over all miners by their first line.
    fresh = numbered(made.filter("template IS NULL").drop("template"), "template", "first", after=most)
    # A template's first line is looked for by its number alone.
    examples = lines.select(F.col("seq").alias("first"), F.col("line").alias("example")).join(fresh.select("first"), "first")
    found = fresh.join(examples, "first").select(*KEPT)
    numbers = fresh.select("service", "level", "local", "template")
    if known is not None:
        again = made.filter("template IS NOT NULL")
        numbers = numbers.union(again.select("service", "level", "local", "template"))
        grown = known.select("template", "service", "level", "initial", "example", F.col("n").alias("__n"), F.col("first_ts").alias("__first"), F.col("last_ts").alias("__last")).join(again.select("template", "text", "n", "first_ts", "last_ts"), "template")
        grown = grown.withColumns({"n": F.col("n") + F.col("__n"), "first_ts": F.least("first_ts", "__first"), "last_ts": F.greatest("last_ts", "__last")})
        found = found.union(grown.select(*KEPT))
    same = lambda a, b: a["service"].eqNullSafe(b["service"]) & a["level"].eqNullSafe(b["level"])
    m, k = mined.filter("block IS NOT NULL").select("service", "level", "block", "message", "low", "high", "local"), numbers
    runs = m.join(k, same(m, k) & (m["local"] == k["local"])).select(m["service"], m["level"], "block", "message", "low", "high", "template")
    x = lines.withColumns({"__block": block, "__place": place, "__message": message})
    fit = same(x, runs) & (x["__block"] == runs["block"]) & (x["__message"] == runs["message"]) & x["__place"].between(runs["low"], runs["high"])
    return x.join(runs, fit).select(*(x[c] for c in lines.columns), "template"), found


#: What is kept of a template.
KEPT = ["template", "service", "level", "text", "initial", "n", "first_ts", "last_ts", "example"]
