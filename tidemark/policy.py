"""The policy language: streams, answers, quotas and log lines, as dataclasses.

``parse(text)`` gives a checked Policy or raises PolicyError with the place of the problem. One
regular expression makes the tokens; a cursor over them reads each kind of line by a method named
after its first word; the checks run over the finished tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from dataclasses import field as made

FOREVER = -1
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 7 * 86400, "y": 365 * 86400}
FUNCTIONS = ("count", "sum", "avg", "min", "max", "first", "last")
PERIODS = ("hour", "day", "month")

# Words that are no names, from SQL and from the columns that tables of state have.
RESERVED = frozenset("""
    abort action add after all alter analyze and as asc attach autoincrement before begin between by
    cascade case cast check collate column commit conflict constraint create cross current current_date
    current_time current_timestamp database default deferrable deferred delete desc detach distinct do
    drop each else end escape except exclusive exists explain fail filter for foreign from full glob
    group having if ignore immediate in index indexed initially inner insert instead intersect into is
    isnull join key left like limit match natural no not nothing notnull null of offset on or order
    outer over partition plan pragma primary query raise range recursive references regexp reindex
    release rename replace restrict returning right rollback row rows savepoint select set table temp
    temporary then to transaction trigger unbounded union unique update using vacuum values view
    virtual when where window with without
    ts res w n an b slot z m var g first_ts last_ts value period text integer real forever
    prev reason newest lim used remaining reached""".split())


class PolicyError(ValueError):
    def __init__(self, at: str, message: str):
        super().__init__(f"{at}: {message}")
        self.at, self.message = at, message


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: str
    number: float = 0.0

    def __str__(self) -> str:
        return "the end of the file" if self.kind == "end" else f'"{self.text}"'


@dataclass(frozen=True)
class Num:
    text: str


@dataclass(frozen=True)
class Ref:
    name: str
    at: str = made(default="", compare=False)


@dataclass(frozen=True)
class Neg:
    of: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass
class Field:
    name: str
    type: str
    at: str = made(default="", compare=False)


@dataclass
class Derived:
    name: str
    expr: object
    at: str = made(default="", compare=False)


@dataclass
class Rollup:
    res: int
    keep: int
    quantiles: list[str] = made(default_factory=list)
    at: str = made(default="", compare=False)


@dataclass
class Samples:
    n: int
    per: int
    at: str = made(default="", compare=False)


@dataclass
class Anomalies:
    field: str
    z: float
    log: bool = False
    change: bool = False
    memory: int = 3000
    warmup: int = 500
    keep: int = 20
    per: int = 0
    at: str = made(default="", compare=False)


@dataclass
class Stream:
    name: str
    at: str = made(default="", compare=False)
    keys: list[Field] = made(default_factory=list)
    values: list[Field] = made(default_factory=list)
    derived: list[Derived] = made(default_factory=list)
    rollups: list[Rollup] = made(default_factory=list)
    raw_keep: int = 0
    raw_at: str = made(default="", compare=False)
    samples: Samples | None = None
    anomalies: Anomalies | None = None
    accuracy: float = 0.0
    exact_at: str = made(default="", compare=False)
    exact: bool = False
    id: Field | None = None
    repeats: int = 0
    late: int = 0
    ahead: int = 0
    ahead_at: str = made(default="", compare=False)
    period: str = ""
    close: int = 0
    until_closed: int | None = None
    from_logs: bool = False
    from_metrics: str = ""
    from_at: str = made(default="", compare=False)
    where: list[tuple[str, str]] = made(default_factory=list)

    @property
    def key_names(self) -> list[str]:
        return [k.name for k in self.keys]

    @property
    def numbers(self) -> list[str]:
        return [v.name for v in self.values] + [d.name for d in self.derived]

    def rollup(self, res: int) -> Rollup | None:
        return next((r for r in self.rollups if r.res == res), None)

    def sketched(self) -> list[str]:
        return [v for v in self.numbers if any(v in r.quantiles for r in self.rollups)]


@dataclass
class Precompute:
    name: str
    func: str
    stream: str
    field: str = ""
    by: list[str] = made(default_factory=list)
    per: str = ""
    q: float = 0.0
    called: str = ""
    at: str = made(default="", compare=False)


@dataclass
class Quota:
    name: str
    precompute: str
    at: str = made(default="", compare=False)


@dataclass
class Logs:
    at: str = made(default="", compare=False)
    format: str = ""
    format_at: str = made(default="", compare=False)
    masks: list[str] = made(default_factory=list)
    mask_at: list[str] = made(default_factory=list, compare=False)
    similarity: float = 0.5
    depth: int = 4
    fields: list[str] = made(default_factory=list)


@dataclass
class Policy:
    streams: list[Stream] = made(default_factory=list)
    precomputes: list[Precompute] = made(default_factory=list)
    quotas: list[Quota] = made(default_factory=list)
    logs: Logs | None = None

    def stream(self, name: str) -> Stream | None:
        return next((s for s in self.streams if s.name == name), None)

    def precompute(self, name: str) -> Precompute | None:
        return next((p for p in self.precomputes if p.name == name), None)


def format_duration(seconds: int) -> str:
    if seconds == FOREVER:
        return "forever"
    unit = max((u for u in UNITS if seconds % UNITS[u] == 0), key=UNITS.get)
    return f"{seconds // UNITS[unit]}{unit}"


_TOKEN = re.compile(r'(?P<gap>[ \t\r\n]+|#[^\n]*)|(?P<text>"(?:\\"|[^"\n])*")|(?P<open>")|(?P<measure>\d[\w.]*%?)|(?P<name>[A-Za-z_]\w*)|(?P<sign>[{}(),.=>+*/-])|(?P<bad>.)')


def tokens(source: str) -> list[Token]:
    out, line, start = [], 1, 0
    for m in _TOKEN.finditer(source):
        kind, text = m.lastgroup, m[0]
        at = f"{line}:{m.start() - start + 1}"
        if kind == "gap":
            if breaks := text.count("\n"):
                line, start = line + breaks, m.start() + text.rindex("\n") + 1
        elif kind == "text":
            out.append(Token("text", text[1:-1].replace('\\"', '"'), at))
        elif kind == "measure":
            if re.fullmatch(r"\d+", text):
                out.append(Token("int", text, at, int(text)))
            elif re.fullmatch(r"\d+\.\d+", text):
                out.append(Token("number", text, at, float(text)))
            elif re.fullmatch(r"\d+(\.\d+)?%", text):
                out.append(Token("percent", text, at, float(text[:-1]) / 100))
            elif re.fullmatch(r"\d+[smhdwy]", text):
                out.append(Token("duration", text, at, int(text[:-1]) * UNITS[text[-1]]))
            else:
                raise PolicyError(at, f'"{text}" is not a number or a duration such as 10s, 1m, 24h, 30d, 2w or 1y')
        elif kind == "open":
            raise PolicyError(at, "text in double quotes is not closed on its line")
        elif kind == "bad":
            raise PolicyError(at, f'"{text}" has no meaning here')
        else:
            out.append(Token(kind, text, at))
    return [*out, Token("end", "", f"{line}:{len(source) - start + 1}")]


_LINES = "key, value, derive, raw, rollup, samples, anomalies, quantile accuracy, or in an exact stream id, late, ahead and period"


class _Cursor:
    def __init__(self, source: str):
        self.all, self.k = tokens(source), 0

    @property
    def here(self) -> Token:
        return self.all[self.k]

    def next(self) -> Token:
        t = self.here
        self.k = min(self.k + 1, len(self.all) - 1)
        return t

    def at_word(self, *words: str) -> bool:
        return self.here.kind == "name" and self.here.text in words

    def skip(self, *words: str) -> bool:
        if found := self.at_word(*words):
            self.next()
        return found

    def take(self, kind: str, what: str, text: str | None = None) -> Token:
        t = self.next()
        if t.kind != kind or text is not None and t.text != text:
            raise PolicyError(t.at, f"expected {what}, found {t}")
        return t

    def sign(self, s: str) -> Token:
        return self.take("sign", f"'{s}'", s)

    def word(self, w: str) -> Token:
        return self.take("name", f'"{w}"', w)

    def duration(self, zero: bool = False) -> int:
        t = self.take("duration", "a duration such as 1m")
        if t.number <= 0 and not zero:
            raise PolicyError(t.at, "a duration must be longer than zero")
        return int(t.number)

    def keep(self) -> int:
        return FOREVER if self.skip("forever") else self.duration()

    def integer(self, what: str, least: int, most: float = float("inf"), told: str = "") -> int:
        t = self.take("int", f"{what} (a whole number)")
        if not least <= t.number <= most:
            raise PolicyError(t.at, told)
        return int(t.number)

    def listed(self, what: str) -> list[str]:
        out = [self.take("name", what).text]
        while self.here.text == "," and self.here.kind == "sign":
            self.next()
            out.append(self.take("name", what).text)
        return out

    def choice(self, default: str, *options: str) -> str:
        return self.next().text if self.at_word(*options) else default

    # Expressions, by precedence.

    def expr(self, level: int = 0) -> object:
        if level == 2:
            t = self.next()
            if t.kind in ("int", "number"):
                return Num(t.text)
            if t.kind == "name":
                return Ref(t.text, t.at)
            if t.kind == "sign" and t.text == "-":
                return Neg(self.expr(2))
            if t.kind == "sign" and t.text == "(":
                e = self.expr()
                self.sign(")")
                return e
            raise PolicyError(t.at, f"expected a value name, a number or '(', found {t}")
        e = self.expr(level + 1)
        while self.here.kind == "sign" and self.here.text in ("+-", "*/")[level]:
            e = Binary(self.next().text, e, self.expr(level + 1))
        return e

    # Blocks.

    def policy(self) -> Policy:
        out = Policy()
        while self.here.kind != "end":
            t = self.next()
            if t.kind != "name" or t.text not in ("stream", "precompute", "quota", "logs"):
                raise PolicyError(t.at, f'expected "stream", "precompute", "quota" or "logs", found {t}')
            if t.text == "stream":
                out.streams.append(self.stream(t))
            elif t.text == "precompute":
                out.precomputes.append(self.precompute(t))
            elif t.text == "quota":
                name = self.take("name", "a name for the quota").text
                self.sign("=")
                out.quotas.append(Quota(name, self.take("name", "the precompute that the quota limits").text, t.at))
            elif out.logs:
                raise PolicyError(t.at, "logs is declared twice")
            else:
                out.logs = self.logs(t)
        return out

    def logs(self, start: Token) -> Logs:
        out = Logs(start.at)
        self.sign("{")
        while (t := self.next()).text != "}" or t.kind != "sign":
            if t.kind == "name" and t.text == "format":
                if out.format:
                    raise PolicyError(t.at, "format is declared twice")
                v = self.take("text", "the line format in double quotes")
                out.format, out.format_at = v.text, v.at
            elif t.kind == "name" and t.text == "mask":
                v = self.take("text", "a regular expression in double quotes")
                out.masks.append(v.text)
                out.mask_at.append(v.at)
            elif t.kind == "name" and t.text == "templates":
                while self.at_word("similarity", "depth"):
                    if self.next().text == "similarity":
                        v = self.next()
                        if v.kind not in ("int", "number") or not 0 < v.number <= 1:
                            raise PolicyError(v.at, f"similarity is above 0 and at most 1, found {v}")
                        out.similarity = float(v.number)
                    else:
                        out.depth = self.integer("the depth of the template tree", 3, 10, "the depth of the template tree is from 3 to 10")
            else:
                raise PolicyError(t.at, f"expected format, mask or templates, found {t}")
        return out

    def precompute(self, start: Token) -> Precompute:
        name = self.take("name", "a name for the precompute").text
        self.sign("=")
        f = self.take("name", "a function such as count, avg or p99")
        out = Precompute(name, f.text, "", called=f.text, at=start.at)
        if f.text not in FUNCTIONS:
            if not re.fullmatch(r"p(\d{2}|9\d{2})", f.text):
                raise PolicyError(f.at, f'"{f.text}" is not a function: there are {", ".join(FUNCTIONS)} and percentiles such as p50, p99 and p999')
            out.func, out.q = "quantile", float("0." + f.text[1:])
            if not out.q:
                raise PolicyError(f.at, f'"{f.text}" is the 0th percentile; that is min')
        self.sign("(")
        out.stream = self.take("name", "a stream name").text
        if self.here.text == "." and self.here.kind == "sign":
            self.next()
            out.field = self.take("name", "a value name").text
        self.sign(")")
        if self.skip("by"):
            out.by = self.listed("a key name after by")
        if self.at_word("per"):
            at = self.next().at
            out.per = self.next().text
            if out.per not in PERIODS:
                raise PolicyError(at, "per takes hour, day or month")
        return out

    def stream(self, start: Token) -> Stream:
        s = Stream(self.take("name", "a stream name").text, start.at)
        if self.at_word("exact"):
            s.exact, s.exact_at = True, self.next().at
        if self.at_word("from"):
            s.from_at = self.next().at
            kind = self.next()
            if kind.text == "logs":
                s.from_logs = True
            elif kind.text == "metrics":
                m = self.take("text", "the metric's name in double quotes")
                if not m.text.strip():
                    raise PolicyError(m.at, "the name of the metric is empty")
                s.from_metrics = m.text
            else:
                raise PolicyError(kind.at, f"expected logs or metrics after from, found {kind}")
            if self.skip("where"):
                while True:
                    f = self.take("name", "a field").text
                    self.sign("=")
                    s.where.append((f, self.take("text", "the text that the field must equal, in double quotes").text))
                    if not self.skip("and"):
                        break
        self.sign("{")
        seen: set[str] = set()
        while (t := self.next()).text != "}" or t.kind != "sign":
            line = getattr(self, f"_{t.text}", None) if t.kind == "name" else None
            if line is None:
                raise PolicyError(t.at, f"expected a stream line ({_LINES}), found {t}")
            if t.text in seen and t.text not in ("key", "value", "derive", "rollup"):
                raise PolicyError(t.at, f'{t.text} is declared twice in stream "{s.name}"')
            seen.add(t.text)
            line(s, t)
        return s

    def _field(self, s: Stream, of: str, default: str, other: str, told: str) -> Field:
        t = self.take("name", "a field name")
        if self.at_word(other):
            raise PolicyError(self.here.at, told)
        return Field(t.text, self.choice(default, "text", "integer", "real"), t.at)

    def _key(self, s: Stream, t: Token) -> None:
        s.keys.append(self._field(s, "key", "text", "real", "a key is text or integer; real numbers belong in a value"))

    def _value(self, s: Stream, t: Token) -> None:
        s.values.append(self._field(s, "value", "real", "text", "a value is real or integer; text belongs in a key"))

    def _derive(self, s: Stream, t: Token) -> None:
        name = self.take("name", "a name for the derived value")
        self.sign("=")
        s.derived.append(Derived(name.text, self.expr(), name.at))

    def _raw(self, s: Stream, t: Token) -> None:
        s.raw_at = t.at
        if self.skip("until"):
            self.word("closed")
            s.until_closed = 0
            if self.here.text == "+" and self.here.kind == "sign":
                self.next()
                s.until_closed = self.duration()
        else:
            self.word("keep")
            s.raw_keep = self.keep()

    def _id(self, s: Stream, t: Token) -> None:
        name = self.take("name", "the name of the identifier")
        s.id = Field(name.text, self.choice("text", "text", "integer"), name.at)
        self.word("refuse")
        self.word("repeats")
        s.repeats = self.duration()

    def _late(self, s: Stream, t: Token) -> None:
        s.late = self.duration()

    def _ahead(self, s: Stream, t: Token) -> None:
        s.ahead, s.ahead_at = self.duration(), t.at

    def _period(self, s: Stream, t: Token) -> None:
        p = self.next()
        if p.text not in PERIODS:
            raise PolicyError(p.at, f"a period is hour, day or month, not {p}")
        self.word("close")
        s.period, s.close = p.text, self.duration(zero=True)

    def _rollup(self, s: Stream, t: Token) -> None:
        res = self.duration()
        self.word("keep")
        keep = self.keep()
        s.rollups.append(Rollup(res, keep, self.listed("a value name after quantiles") if self.skip("quantiles") else [], t.at))

    def _samples(self, s: Stream, t: Token) -> None:
        n = self.integer("the number of samples", 1, 100, "from 1 to 100 samples a window are kept")
        self.word("per")
        s.samples = Samples(n, self.duration(), t.at)

    def _anomalies(self, s: Stream, t: Token) -> None:
        a = Anomalies(self.take("name", "the value to watch").text, 0.0, at=t.at)
        while self.at_word("log", "change"):
            w = self.next()
            if getattr(a, w.text):
                raise PolicyError(w.at, f'"{w.text}" is written twice')
            setattr(a, w.text, True)
        self.word("z")
        self.sign(">")
        z = self.next()
        if z.kind not in ("int", "number") or z.number <= 0:
            raise PolicyError(z.at, f"z is a number above zero, found {z}")
        a.z = float(z.number)
        while self.at_word("memory", "warmup", "keep"):
            w = self.next().text
            setattr(a, w, self.integer(f"the {w}", 1 if w == "keep" else 2, told=f"{w} is at least {1 if w == 'keep' else 2}"))
            if w == "keep":
                self.word("per")
                a.per = self.duration()
        s.anomalies = a

    def _quantile(self, s: Stream, t: Token) -> None:
        self.word("accuracy")
        p = self.take("percent", "a percentage such as 1%")
        if not 0 < p.number < 0.5:
            raise PolicyError(p.at, "quantile accuracy is above 0% and below 50%")
        s.accuracy = p.number


def log_pattern(format: str) -> tuple[str, list[str]]:
    """The regular expression of a line format and its fields: one group each, as short as can be."""
    parts = re.split(r"<([^<>]+)>", format)
    text = [re.sub(" +", r"\\s+", p) if k % 2 == 0 else "(.*?)" for k, p in enumerate(parts)]
    return "^" + "".join(text) + "$", parts[1::2]


def _need(ok: object, at: str, message: str) -> None:
    if not ok:
        raise PolicyError(at, message)


def _named(at: str, name: str, what: str) -> None:
    _need(re.fullmatch(r"[a-z][a-z0-9_]{0,47}", name), at, f'{what} "{name}" must start with a lowercase letter and have only lowercase letters, digits and _, at most 48')
    _need(name not in RESERVED, at, f'{what} "{name}" is a reserved word')


def _check_logs(logs: Logs) -> None:
    def compiles(pattern: str, at: str, what: str) -> None:
        try:
            re.compile(pattern)
        except re.error as e:
            raise PolicyError(at, f"{what} is not a regular expression: {e}") from None

    if logs.format:
        pattern, logs.fields = log_pattern(logs.format)
        compiles(pattern, logs.format_at, "the format")
        for k, f in enumerate(logs.fields):
            _need(re.fullmatch(r"[a-z][a-z0-9_]{0,47}", f), logs.format_at, f"<{f}> is no field name: lowercase letters, digits and _")
            _need(f not in logs.fields[:k], logs.format_at, f"<{f}> appears twice in the format")
            _need(f not in ("template", "line"), logs.format_at, f"<{f}> is what every line gets by itself; call the field something else")
        _need("message" in logs.fields, logs.format_at, "the format needs a <message> field, which templates are learned from")
        _need("timestamp" in logs.fields or {"date", "time"} <= set(logs.fields), logs.format_at, "the format needs the time of each line: <timestamp>, or <date> and <time>")
    for mask, at in zip(logs.masks, logs.mask_at):
        compiles(mask, at, "the mask")


def _check_expr(e: object, s: Stream, known: set[str]) -> None:
    if isinstance(e, Ref):
        _need(e.name not in s.key_names, e.at, f'"{e.name}" is a key; a derived value is made of values')
        _need(e.name in known, e.at, f'"{e.name}" is not a value declared above this line')
    for part in ("left", "right", "of"):
        if hasattr(e, part):
            _check_expr(getattr(e, part), s, known)


def _check_stream(s: Stream, logs: Logs | None) -> None:
    _named(s.at, s.name, "stream name")
    declared: dict[str, str] = {}
    for what, f in [*(("id name", x) for x in [s.id] if x), *(("key name", x) for x in s.keys), *(("value name", x) for x in s.values), *(("derived value name", x) for x in s.derived)]:
        _named(f.at, f.name, what)
        _need(f.name not in declared, f.at, f'"{f.name}" is already declared at {declared.get(f.name)}')
        declared[f.name] = f.at
    _need(s.values or s.from_logs, s.at, f'stream "{s.name}" needs at least one value, as in "value ms real"')
    known = {v.name for v in s.values}
    for d in s.derived:
        _check_expr(d.expr, s, known)
        known.add(d.name)
    for k, r in enumerate(s.rollups):
        length = format_duration(r.res)
        twin = next((x for x in s.rollups[:k] if x.res == r.res), None)
        _need(twin is None, r.at, f"rollup {length} is already declared at {twin and twin.at}")
        _need(r.keep == FOREVER or r.keep >= r.res, r.at, f"rollup {length} keeps its windows for less than one window")
        for j, q in enumerate(r.quantiles):
            _need(q in known, r.at, f'quantiles "{q}": stream "{s.name}" has no value by that name')
            _need(q not in r.quantiles[:j], r.at, f'quantiles lists "{q}" twice')
    s.rollups.sort(key=lambda r: r.res)
    if s.samples:
        per = format_duration(s.samples.per)
        _need(s.rollup(s.samples.per), s.samples.at, f"samples per {per} needs a rollup {per} in the same stream")
    if a := s.anomalies:
        _need(a.field in known, a.at, f'anomalies "{a.field}": stream "{s.name}" has no value by that name')
        _need(s.rollups, a.at, "anomalies are counted by window, so the stream needs at least one rollup")
        a.per = a.per or next((r.res for r in s.rollups if r.res >= 60), s.rollups[0].res)
        _need(s.rollup(a.per), a.at, f"anomalies kept per {format_duration(a.per)} need a rollup {format_duration(a.per)} in the same stream")
    s.accuracy = s.accuracy or 0.01
    if not s.exact:
        told = f'belongs in an exact stream: "stream {s.name} exact {{"'
        _need(s.id is None, s.id.at if s.id else "", f"id {told}")
        _need(not s.late and not s.period, s.at, f"a late or period line {told}")
        _need(not s.ahead, s.ahead_at, f"ahead {told}")
        _need(s.until_closed is None, s.raw_at, f"raw until closed {told}")
    else:
        _need(s.period, s.exact_at, f'exact stream "{s.name}" needs a period, as in "period month close 24h"')
        _need(s.until_closed is not None, s.exact_at, f'exact stream "{s.name}" keeps events until their period closes: "raw until closed + 90d"')
        for r in s.rollups:
            _need(not r.quantiles, r.at, "an exact stream has exact answers; quantile sketches are approximate")
    if s.from_metrics:
        _need(not s.exact, s.exact_at, "a stream from metrics cannot be exact: points carry no identifier")
        for k in s.keys:
            _need(k.name not in ("template", "line"), k.at, f"{k.name} belongs to streams from logs")
    if s.from_logs:
        _need(logs, s.from_at, "a stream from logs needs a logs block")
        _need(not s.exact, s.exact_at, "a stream from logs cannot be exact")
        for f in [*s.keys, *s.values]:
            _need(f.name != "line", f.at, "line is the log line itself, neither a key nor a value")
            _need(f.name != "template" or f.type == "integer", f.at, "template is a number: declare it as key template integer")


def check(policy: Policy) -> Policy:
    if policy.logs:
        _check_logs(policy.logs)
    taken: dict[str, str] = {}
    for s in policy.streams:
        _check_stream(s, policy.logs)
        _need(s.name not in taken, s.at, f'stream "{s.name}" is already declared')
        taken[s.name] = "a stream"
    for p in policy.precomputes:
        _named(p.at, p.name, "precompute name")
        _need(p.name not in taken, p.at, f'precompute "{p.name}" has the same name as {taken.get(p.name)}')
        taken[p.name] = "a precompute"
        s = policy.stream(p.stream)
        _need(s, p.at, f'precompute "{p.name}" reads stream "{p.stream}", which is not declared')
        _need(p.field or p.func == "count", p.at, f"{p.called} needs a value, as in {p.called}({p.stream}.value_name)")
        _need(p.field not in s.key_names, p.at, f'"{p.field}" is a key of stream "{s.name}"; precomputes read values')
        _need(not p.field or p.field in s.numbers, p.at, f'stream "{s.name}" has no value "{p.field}"')
        _need(not s.exact or p.func != "quantile", p.at, f"{p.called} reads an exact stream; percentiles come from approximate sketches")
        for k, b in enumerate(p.by):
            _need(b in s.key_names, p.at, f'"by {b}": "{b}" is not a key of stream "{s.name}"')
            _need(b not in p.by[:k], p.at, f'"by" lists "{b}" twice')
    for q in policy.quotas:
        _named(q.at, q.name, "quota name")
        _need(q.name not in taken, q.at, f'quota "{q.name}" has the same name as {taken.get(q.name)}')
        taken[q.name] = "a quota"
        p = policy.precompute(q.precompute)
        _need(p, q.at, f'quota "{q.name}" limits precompute "{q.precompute}", which is not declared')
        _need(p.func in ("sum", "count"), q.at, f'a quota limits a sum or a count; "{p.name}" is {p.called}')
        _need(p.per, q.at, f'a quota starts again every period: give "{p.name}" a per, such as per month')
    return policy


def parse(source: str) -> Policy:
    return check(_Cursor(source).policy())
