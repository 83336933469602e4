"""Removal of long repeated strings by a sparse, distributed suffix array.

A byte goes if a string of LENGTH bytes over it also starts anywhere else. Whether two such strings are
equal is settled by sorting suffixes: equal ones are neighbours. Suffixes are dealt to buckets by ranges of
their leading tokens, with splitters taken from a sample; ties are ordered by place, so that a passage of a
third of the corpus spreads over many buckets; each bucket sorts what it holds by multikey quicksort; and
the ends of neighbouring buckets are compared, so that a run that crosses a boundary is seen.

Not every suffix needs to be sorted to its full depth. Three rounds do with few:

1. The suffix at each anchor, by the SEED bytes it begins with. The anchor of a string is the leftmost of
   its seeds of least hash, which its own bytes determine: equal strings have their anchors at equal
   offsets. Anchors whose suffixes have no equal neighbour go; those that also agree in all bytes of the
   strings they stand for (the inside of copies) are settled.
2. The strings of such an anchor in blocks of STRINGS neighbouring ones: their suffixes by the bytes that all
   strings of the block share (without an equal neighbour none of them repeats), then by all bytes that
   any of them has (with one all of them do).
3. The strings of blocks that are equal in the first but not in the second, one by one, beside those of
   one of each set of blocks that are equal in both where others are equal in the first only.

The tokens of a suffix are its first eight bytes, a 64-bit hash of the bytes that its round looks at first, and
a keyed BLAKE2b of all bytes that it stands for. Nothing is removed unless all three are equal: what decides
is a cryptographic digest of the very bytes, beside another hash and eight bytes as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch, lean, width
from tidemark.llm.shingles import mix

LENGTH, SEED, STRINGS = 200, 40, 16
#: Bytes of text that are hashed together, but for a text that is longer alone; rows sorted at a time.
CHUNK, RUN = 1 << 20, 1 << 20

_BASE, _KEY = 0x9E3779B97F4A7C15, b"strings that repeat"
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Hashes:
    """Hashes of any substrings of data, in constant time each."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(max(2 * CHUNK, 1 << int(len(data) + 1).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keyed BLAKE2b of substrings."""
    view, base = memoryview(data), hashlib.blake2b(digest_size=8, key=_KEY)

    def one(a: int, b: int) -> bytes:
        h = base.copy()
        h.update(view[a:b])
        return h.digest()

    return np.frombuffer(b"".join(map(one, starts.tolist(), ends.tolist())), "<u8")


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers in the order of the bytes, signed for Spark."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[at + k].astype(np.uint64)
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % w, ~np.uint64(0), np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(padded, 1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings within the texts that lie from first to last in data: the text, the place
    of the anchor, and the first and last string (by its start) that it is the anchor of."""
    if len(data) < LENGTH:
        return (np.empty(0, np.int64),) * 4
    at = np.arange(len(data) - SEED + 1)
    seeds = hashes(at, at + SEED)
    shift = np.uint64(max(24, int(len(data)).bit_length()))
    least = sliding_least((seeds >> shift << shift) | at.astype(np.uint64), LENGTH - SEED + 1)
    anchor = (least & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(first)), np.maximum(0, last - first - LENGTH + 1))
    starts = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(first.tolist(), last.tolist()) if b - a >= LENGTH] or [np.empty(0, np.int64)])
    anchor = anchor[starts]
    if not len(starts):
        return (np.empty(0, np.int64),) * 4
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    ends = np.concatenate([np.flatnonzero(new)[1:], [len(new)]]) - 1
    return text[new], anchor[new], starts[new], starts[ends]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], list[bytes]]]:
    """Rows with their texts as bytes, about CHUNK bytes at a time."""
    rows, texts, size = [], [], 0
    for batch in batches:
        columns = {c: batch.column(c) for c in batch.schema.names}
        for k in range(batch.num_rows):
            row = {c: v[k].as_py() for c, v in columns.items()}
            data = (row.pop("text") or "").encode("utf-8", "surrogatepass")
            if texts and size + len(data) > CHUNK:
                yield rows, texts
                rows, texts, size = [], [], 0
            rows.append(row)
            texts.append(data)
            size += len(data)
    if texts:
        yield rows, texts


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    last = np.cumsum([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), last - [len(t) for t in texts], last


_SUFFIX = pa.schema([("t0", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("dk", pa.int64()), ("at", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
_SUFFIX_SQL = "t0 long, t1 long, t2 long, dk long, at long, low int, high int"


def _suffixes(t0, t1, t2, dk, at, low, high) -> pa.RecordBatch:
    signed = lambda x: x.view(np.int64) if x.dtype == np.uint64 else x
    return pa.RecordBatch.from_arrays([pa.array(signed(np.asarray(x)).astype(f.type.to_pandas_dtype())) for x, f in zip((t0, t1, t2, dk, at, low, high), _SUFFIX)], schema=_SUFFIX)


def _round_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffix at each anchor, by its seed and then by all bytes of the strings it stands for: low and high
    are the offsets of the anchor in them."""
    for rows, texts in _chunks(batches):
        data, first, last = _joined(texts)
        hashes = Hashes(data)
        text, anchor, low, high = anchors(data, first, last, hashes)
        if len(text):
            dk = np.array([r["dk"] for r in rows])[text]
            whole = digests(data, low, high + LENGTH)
            yield _suffixes(leading(data, anchor), hashes(anchor, anchor + SEED), whole, dk, anchor - first[text], anchor - high, anchor - low)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """0, 1, ... up to each count; and which count it is of."""
    of = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts), of


def _round_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of strings of anchors that repeat: low is the least offset of the anchor in them, high the greatest."""
    for rows, texts in _chunks(batches):
        data, first, last = _joined(texts)
        hashes = Hashes(data)
        found = [np.array([(x["at"], x["low"], x["high"]) for x in r["found"]], np.int64).reshape(-1, 3) for r in rows]
        text = np.repeat(np.arange(len(rows)), [len(x) for x in found])
        at, low, high = np.concatenate(found).T
        k, of = _spread(high // STRINGS - low // STRINGS + 1)
        block = low[of] // STRINGS + k
        text, anchor = text[of], at[of] + first[text[of]]
        # Offsets lie from STRINGS * block on; the string that starts first has the largest.
        begin, end = anchor - STRINGS * block - STRINGS + 1, anchor - STRINGS * block + LENGTH
        core, core_end = anchor - STRINGS * block, begin + LENGTH
        dk = np.array([r["dk"] for r in rows])[text]
        whole = (begin >= first[text]) & (end <= last[text])
        lone = mix(mix(dk.view(np.uint64) + anchor.astype(np.uint64)) + block.astype(np.uint64))
        # Anchors of a text that are equal modulo STRINGS may share a block, which is one place: one row stands for them.
        _, one, group = np.unique(core, return_index=True, return_inverse=True)
        least, most = np.full(len(one), STRINGS), np.zeros(len(one), np.int64)
        np.minimum.at(least, group, np.maximum(low[of] - STRINGS * block, 0))
        np.maximum.at(most, group, np.minimum(high[of] - STRINGS * block, STRINGS - 1))
        low, high = STRINGS * block[one] + least, STRINGS * block[one] + most
        full, sure = lone[one], whole[one]
        full[sure] = digests(data, begin[one][sure], end[one][sure])
        yield _suffixes(leading(data, core[one]), hashes(core[one], core_end[one]), full, dk[one], (anchor - first[text])[one], low, high)


def _round_three(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single strings: at is where the string starts."""
    for rows, texts in _chunks(batches):
        data, first, _ = _joined(texts)
        hashes = Hashes(data)
        found = [np.array([(x["at"], x["low"], x["high"]) for x in r["found"]], np.int64).reshape(-1, 3) for r in rows]
        text = np.repeat(np.arange(len(rows)), [len(x) for x in found])
        at, low, high = np.concatenate(found).T
        k, of = _spread(high - low + 1)
        # Blocks of several anchors may hold the same string.
        start, one = np.unique(at[of] - low[of] - k + first[text[of]], return_index=True)
        text = text[of][one]
        dk = np.array([r["dk"] for r in rows])[text]
        yield _suffixes(leading(data, start), hashes(start, start + LENGTH), digests(data, start, start + LENGTH), dk, start - first[text], np.zeros(len(start), np.int64), np.zeros(len(start), np.int64))


def multikey_quicksort(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their tokens, each token looked at only among rows that tie in all before.

    A group of ties is split into less, equal and greater than its middle value; equals go on with the next
    token. All groups of a step are split at once. Rows alone in their group are in place.
    """
    n = len(tokens[0])
    order, group = np.arange(n), np.zeros(n, np.int64)  # group: where the row's group begins
    depth = np.zeros(n, np.int64)  # of the group that begins here
    open_ = np.array([0], np.int64) if n > 1 else np.empty(0, np.int64)
    size = np.zeros(n + 1, np.int64)
    size[0] = n
    stack = np.stack(tokens, 1)
    while len(open_):
        k, of = _spread(size[open_])
        place = open_[of] + k
        value = stack[order[place], depth[open_][of]]
        middle = stack[order[open_ + size[open_] // 2], depth[open_]][of]
        side = np.sign((value > middle).astype(np.int8) - (value < middle).astype(np.int8)).astype(np.int8)
        by = np.lexsort((side, of))
        order[place] = order[place][by]
        side, of = side[by], of[by]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (side[1:] != side[:-1])])
        begins = place[new]
        lengths = np.diff(np.append(np.flatnonzero(new), len(new)))
        deeper = depth[open_][of[new]] + (side[new] == 0)
        size[begins], depth[begins] = lengths, deeper
        group[place] = np.repeat(begins, lengths)
        open_ = begins[(lengths > 1) & (deeper < len(tokens))]
    return order


#: What _neighbours says of a row: the tokens it shares with a neighbour in its bucket (0, 2 or 3), and
#: these marks: it may tie with another bucket; it is the first of its equals; others tie in two tokens only.
EDGE, FIRST, MIXED = 8, 16, 32


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts a bucket and gives the rows that share tokens with a neighbour or may do so across its ends.
    The ends are given as rows of their own: at is -1 for the first tokens, -2 for the last."""
    bucket = TaskContext.get().partitionId()
    held = [{f.name: batch.column(f.name).to_numpy(zero_copy_only=False) for f in _SUFFIX} for batch in batches if batch.num_rows]
    if not held:
        return
    rows = {f.name: np.concatenate([h[f.name] for h in held]) for f in _SUFFIX}
    del held
    order = multikey_quicksort([rows["t0"], rows["t1"], rows["t2"]])
    tokens = np.stack([rows[t][order] for t in ("t0", "t1", "t2")], 1)
    same = np.cumprod(tokens[1:] == tokens[:-1], axis=1).sum(1)  # tokens that neighbours share
    same = np.where(same >= 2, same, 0)
    marks = np.maximum(np.concatenate([same, [0]]), np.concatenate([[0], same]))
    marks += FIRST * np.concatenate([[1], (same < 3).astype(np.int64)])
    run = np.concatenate([[0], np.cumsum(same < 2)])
    marks += MIXED * (np.bincount(run[1:], same == 2, run[-1] + 1) > 0)[run]
    ends = order[[0, -1]]
    # What another bucket can change: whether a row equal to one at an end has an equal there, and whether
    # the equals of a run that holds nothing else are mixed after all. The first of equals stands for them.
    edge = np.zeros(len(order), bool)
    first, alone = marks & FIRST > 0, (marks % EDGE == 3) & (marks & MIXED == 0)
    for e in ends:
        ties = tokens == [rows["t0"][e], rows["t1"][e], rows["t2"][e]]
        edge |= ties.all(1) & first | ties[:, :2].all(1) & first & alone
    marks += EDGE * edge
    keep = (marks % EDGE > 0) | edge

    def given(columns: dict[str, np.ndarray], marks: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name].astype(f.type.to_pandas_dtype())) for f in _SUFFIX] + [pa.array(marks.astype(np.int32)), pa.array(np.full(len(marks), bucket))], schema=_MARKED)

    for at in range(0, len(order), RUN):
        k = at + np.flatnonzero(keep[at : at + RUN])
        if len(k):
            # Tokens have done their work but for rows at the ends.
            out = {c: v[order[k]] for c, v in rows.items()}
            yield given(out | {t: np.where(edge[k], out[t], 0) for t in ("t0", "t1", "t2")}, marks[k])
    yield given({c: np.array([-1, -2]) if c == "at" else v[ends] for c, v in rows.items()}, np.array([0, 0]))


_MARKED = pa.schema([*_SUFFIX, ("marks", pa.int32()), ("bucket", pa.int64())])


def neighbours(suffixes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """suffixes that share at least two tokens with another, with shared, how many, and leads: all three
    are shared, but others share two with it, and it is the first of its equals in its bucket."""
    # Written first, since taking the sample for the splitters would make them all a second time.
    made = scratch.table(f"{name}_suffixes", suffixes)
    dealt = made.repartitionByRange(width(suffixes.sparkSession), "t0", "t1", "t2", "dk", "at")
    marked = scratch.table(name, dealt.mapInArrow(lean(_neighbours), f"{_SUFFIX_SQL}, marks int, bucket long"))
    scratch.drop(f"{name}_suffixes")
    # Two rows a bucket.
    ends = marked.filter("at < 0").select("bucket", "at", "t0", "t1", "t2")
    line = Window.orderBy("bucket", F.desc("at"))
    ends = ends.withColumns({f"p{c}": F.lag(c).over(line) for c in ("t0", "t1", "t2", "bucket")})
    ends = ends.filter((F.col("pbucket") != F.col("bucket")) & (F.col("t0") == F.col("pt0")) & (F.col("t1") == F.col("pt1")))
    sides = F.array(F.struct(F.col("bucket").alias("b"), F.col("t2").alias("t")), F.struct(F.col("pbucket").alias("b"), F.col("pt2").alias("t")))
    crossing = ends.select(F.explode(sides).alias("x"), F.col("t0").alias("c0"), F.col("t1").alias("c1"), (F.col("t2") == F.col("pt2")).alias("full"))
    crossing = crossing.groupBy(F.col("x.b").alias("cb"), "c0", "c1").agg(F.collect_set(F.when(F.col("full"), F.col("x.t"))).alias("equal"))
    has = lambda mark: F.col("marks").bitwiseAND(F.lit(mark)) > 0
    rows = marked.filter("at >= 0").withColumn("shared", F.col("marks") % EDGE)
    inner = rows.filter(~has(EDGE)).withColumn("leads", has(FIRST) & has(MIXED) & (F.col("shared") == 3))
    edge = rows.filter(has(EDGE)).join(F.broadcast(crossing), (F.col("bucket") == F.col("cb")) & (F.col("t0") == F.col("c0")) & (F.col("t1") == F.col("c1")), "left")
    across = F.when(F.array_contains("equal", F.col("t2")), 3).when(F.col("cb").isNotNull(), 2).otherwise(0)
    edge = edge.withColumn("shared", F.greatest(F.col("shared"), across)).filter("shared > 0")
    edge = edge.withColumn("leads", has(FIRST) & (has(MIXED) | F.col("cb").isNotNull()) & (F.col("shared") == 3))
    columns = [*_SUFFIX.names, "shared", "leads"]
    return inner.select(*columns).unionByName(edge.select(*columns))


def _with_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(dk, text, found) of documents that found has rows of."""
    grouped = found.groupBy(F.col("dk").alias("of")).agg(F.collect_set(F.struct("at", "low", "high")).alias("found"))
    return docs.select("dk", "text").join(grouped, F.col("dk") == F.col("of")).select("dk", "text", "found")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removes the strings that start at the given places."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for batch in batches:
        out = []
        for ident, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("found")):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            found = np.array([(x["from"], x["to"]) for x in found.as_py() or []], np.int64).reshape(-1, 2)
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, found[:, 0], 1)
            np.add.at(edge, found[:, 1], -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
            out.append((ident, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*out)))) if out else {f.name: [] for f in schema}, schema=schema)


def remove_repeats(docs: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of docs; kept is what is left.

    Texts are taken as UTF-8; a null text is empty. All copies of a repeated string go, the first as
    well. Rows with equal identifiers are documents of their own, as are equal rows (which therefore lose
    all that is long enough); null identifiers stay null. Texts shorter than LENGTH keep everything; longer
    ones are taken whole, a single one in arrays of some hundred bytes a byte. Other columns are not read; an
    empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    d = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    d = d.withColumn("dk", F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("doc_id").isNull()))
    one = neighbours(d.select("dk", "text").mapInArrow(lean(_round_one), _SUFFIX_SQL), scratch, "one")
    two = neighbours(_with_texts(d, one.filter("shared = 2 OR leads")).mapInArrow(lean(_round_two), _SUFFIX_SQL), scratch, "two")
    three = neighbours(_with_texts(d, two.filter("shared = 2 OR leads")).mapInArrow(lean(_round_three), _SUFFIX_SQL), scratch, "three")
    blocks = one.union(two).filter("shared = 3").select("dk", (F.col("at") - F.col("high")).alias("from"), (F.col("at") - F.col("low") + LENGTH).alias("to"))
    singles = three.filter("shared = 3").select("dk", F.col("at").alias("from"), (F.col("at") + LENGTH).alias("to"))
    gone = blocks.union(singles).groupBy(F.col("dk").alias("of")).agg(F.collect_set(F.struct("from", "to")).alias("found"))
    gone = scratch.table("gone", gone)
    return d.join(gone, F.col("dk") == F.col("of"), "left").select("doc_id", "text", "found").mapInArrow(lean(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op1_suffix_array_dedup(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
