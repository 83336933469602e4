"""Exact n-gram Jaccard join by signature trees.

Where sets are hung. Linked sets x and y differ in at most D shingles, a number that follows from their
sizes. Shingles are dealt by hash into m > D parts, so at least one part is equal in both. Sizes are cut into
ranges such that linked sets lie in one range or in neighbouring ones, and m is fixed for each range. m is
D + 1 and SPARE more, so linked sets have SPARE + 1 equal parts at least, and each set leaves out SPARE of its
parts, those with the fewest tokens (by hash, where these are as many): of the parts equal in both, the one
that comes last in this order has SPARE others before it in either set, so neither leaves it out. What is left
out are empty parts and those of a token or two, which sets that have little in common share as well; else
their trees would grow with the table, and what is compared with its square. A set hangs in the tree of the
hash of each part left, so linked sets share a tree; nodes of two trees have no part in common and are never
compared.

The tree. Its leaves hold up to LEAF sets in order of component, size and name; FANOUT nodes have one parent,
up to one root. A node has the bitwise OR of its sets' token bitmaps, the range of their sizes, the most
tokens that a bitmap hides and the range of their components. Bitmaps of nodes have one length; those of the
sets in a leaf grow with its smallest set, for a long set fills a short bitmap, which then lets all pass.

The join. Every tree is first read along its lowest level, each set against the next one, and the links found
give components (within a task's rows, of which only the smallest goes on, so that a hot tree crosses the
shuffle once a task). Then each tree is traversed against itself from the root. A pair of nodes goes down
only if the largest overlap that their bitmaps allow and their sizes admit a link and they are not both of
one same component; at the root that drops trees whose sets are all joined already. Pairs of sets that the
leaves let pass are compared in full. So every linked pair was compared or lies in one component: no link
between components is lost, and a group of near copies costs comparisons in proportion to its size. A linked
pair passes in each tree that its sets share, the first of them included; so it is left out where the first
trees of both sets, which are listed with them, name an earlier one.

Equal sets are one, under their hash, from the start. Shingles and sets are named by 64-bit hashes: what is
found is exact but for their collisions, which no pattern of the words brings about.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.scratch import Scratch, lean, width
from tidemark.llm.shingles import mix, set_hash, shingle_sets
from tidemark.llm.sieve import Sieve

#: Longs in a bitmap at least (a large set has as many as give it two bits a token), and in one folded for the
#: trees, sets in a leaf, and bits of a node's number that each level above it drops (so 2 ** FANOUT nodes have
#: one parent).
LONGS, FOLDED, LEAF, FANOUT = 64, 16, 128, 4
#: Trees that are listed with a set, the first ones that it hangs in, and what fills the list of a set in fewer.
EARLIER, NONE = 8, (1 << 63) - 1
#: Bytes of text whose keys a task holds at a time, rows that it turns into objects at a time, pairs of sets
#: whose bitmaps it compares at a time, and pairs that one copy of a set's text serves.
HELD, ROWS, PAIRS, SHARE = 8 << 20, 500, 1 << 16, 64


@lru_cache(maxsize=8)
def ranges(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each range, parts that each deals shingles into, and how many of these are spare."""
    first = [1]
    while first[-1] < 1 << 40:
        first.append(100 * first[-1] // percent + 1)
    differ = [(100 - percent) * (b - 1 + c - 1) // (100 + percent) for b, c in zip(first[1:], first[2:])]
    over = [spare(d) if d else 0 for d in differ]
    return np.array(first[: len(differ)]), np.array([d + 1 + o for d, o in zip(differ, over)]), np.array(over)


def spare(differ: int) -> int:
    return 1 + differ // 4


def part_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set: the parts of its own range and of the one below."""
    first, parts, over = ranges(percent)
    own = int(np.searchsorted(first, len(s), "right")) - 1
    spread, weight, out = mix(s), mix(s ^ np.uint64(0x5851F42D4C957F2D)), []
    for zone in (own, own - 1):
        if zone < 0:
            continue
        m = int(parts[zone])
        part = (spread % np.uint64(m)).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, part, weight)
        filled = np.bincount(part, minlength=m)
        keys = mix(sums + mix(np.arange(m, dtype=np.uint64) + (np.uint64(zone) << np.uint64(40))) + filled.astype(np.uint64))
        out.append(keys[np.lexsort((keys, filled))[int(over[zone]) :]])
    return np.concatenate(out)


def bitmap(s: np.ndarray) -> np.ndarray:
    """64 * FOLDED bits, one for each token, and as many more as the set's size asks for. The longer is the
    shorter one unfolded: halves of a bitmap, put together by OR, are a bitmap of half the length."""
    longs = LONGS
    while 64 * longs < 2 * len(s):
        longs *= 2
    bits = np.zeros(64 * longs, np.uint8)
    bits[(mix(s + np.uint64(1)) % np.uint64(64 * longs)).astype(np.int64)] = 1
    whole = np.packbits(bits, bitorder="little").view("<i8")
    return np.concatenate([np.bitwise_or.reduce(whole.reshape(-1, FOLDED)), whole])


def popcount(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits.view(np.uint64)).sum(-1, dtype=np.int64)


def pairs_of(keys: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, a, b) for sets that share a key, each with the one before it, so that none is in many pairs.
    Then the smallest set of each key and its key."""
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    if len(keys):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])])
        keys, sets = keys[new], sets[new]
    head = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    at = np.flatnonzero(~head)
    return keys[at], sets[at - 1], sets[at], sets[head], keys[head]


_ROWS = pa.schema([("kind", pa.int32()), ("deal", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("data", pa.binary())])
_ROWS_SQL = "kind int, deal int, doc_id long, n long, a long, b long, data binary"


def _rows(kind: int, count: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: columns.get(f.name, pa.nulls(count, f.type)) if f.name != "kind" else [kind] * count for f in _ROWS}, schema=_ROWS)


def _shared(keys: np.ndarray, a: np.ndarray, b: np.ndarray, deal: int = 0) -> Iterator[pa.RecordBatch]:
    """Pairs once each (kind 1), and all keys that they share, packed (kind 3)."""
    if len(keys):
        pairs = np.unique(np.stack([a, b]), axis=1)
        yield _rows(1, pairs.shape[1], deal=[deal] * pairs.shape[1], a=pairs[0], b=pairs[1])
        for at in range(0, len(keys), 1 << 16):
            yield _rows(3, 1, deal=[deal], data=[np.stack([keys[at : at + (1 << 16)].view(np.int64), a[at : at + (1 << 16)], b[at : at + (1 << 16)]]).astype("<i8").tobytes()])


def _pack(keys: np.ndarray, sets: np.ndarray) -> bytes:
    """Keys of fewer than 40 bits in five bytes each, with their sets: a set's name once, then for each key the
    place of its set's name."""
    distinct, place = np.unique(sets, return_inverse=True)
    short = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
    return np.array([len(distinct)], "<i8").tobytes() + distinct.astype("<i8").tobytes() + short.tobytes() + place.astype(_place(len(distinct))).tobytes()


def _place(names: int) -> str:
    return "<u2" if names <= 1 << 16 else "<u4"


def _unpacked(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The n keys and their sets, as given to _pack."""
    (d,) = np.frombuffer(data, "<i8", 1).tolist()
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :5] = np.frombuffer(data, np.uint8, 5 * n, 8 + 8 * d).reshape(n, 5)
    return keys.view("<u8").ravel(), np.frombuffer(data, "<i8", d, 8)[np.frombuffer(data, _place(d), n, 8 + 8 * d + 5 * n)]


def _read(words: int):
    """Documents (doc_id, text, th) to rows: kind 0 names a document's set (a) beside th (b), 4 has a set's bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        size = 0
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = batch.column(1).to_pylist()
            counts, sets, new = [], [], []
            for text, s in zip(texts, shingle_sets(texts, words)):
                counts.append(len(s))
                sets.append(set_hash(s) if len(s) else None)
                if len(s) and sets[-1] not in seen:
                    seen.add(sets[-1])
                    new.append((sets[-1], len(s), bitmap(s).tobytes()))
                    size += len(text)
                    if size >= HELD:
                        seen, size = set(), 0
            yield _rows(0, len(texts), doc_id=batch.column(0), n=counts, a=sets, b=batch.column(2))
            if new:
                a, n, data = map(list, zip(*new))
                yield _rows(4, len(new), a=a, n=n, data=data)

    return run


def _deal(words: int, percent: int, deals: int):
    """Texts to rows: kind 2 holds keys of one deal, 1 and 3 are as above and go to any deal. A key is cut to as
    many bits as leave 40 within a deal: keys that fall together hang their sets in one tree, where more is
    compared and nothing lost."""
    spent = np.uint64(64 - 40 - (deals.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        names: list[int] = []
        size, turn = 0, TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            counts = [len(k) for k in keys]
            shared, a, b, sets, own = pairs_of(np.concatenate([np.empty(0, np.uint64), *keys]) >> spent, np.repeat(np.array(names, np.int64), counts))
            yield from _shared(shared, a, b, turn % deals)
            deal = (own % np.uint64(deals)).astype(np.int64)
            order = np.argsort(deal, kind="stable")
            deal, own, sets = deal[order], own[order], sets[order]
            cuts = np.flatnonzero(np.diff(deal)) + 1
            for part in np.split(np.arange(len(deal)), cuts) if len(deal) else []:
                yield _rows(2, 1, deal=[int(deal[part[0]])], n=[len(part)], data=[_pack(own[part] // np.uint64(deals), sets[part])])

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = batch.column(0).to_pylist()
            for text, s in zip(texts, shingle_sets(texts, words)):
                if len(s) and (name := set_hash(s)) not in seen:
                    seen.add(name)
                    names.append(name)
                    keys.append(part_keys(s, percent))
                    size += len(text)
                    if size >= HELD:
                        yield from flush()
                        seen, keys, names, size, turn = set(), [], [], 0, turn + 1
        yield from flush()

    return run


def _meet(deals: int):
    """All rows of one deal: sets that share a key of it, as rows of kinds 1 and 3, beside those that are there."""

    def run(table: pa.Table) -> pa.Table:
        dealt, rest = (table.filter(pc.equal(table.column("kind"), 2) if own else pc.not_equal(table.column("kind"), 2)) for own in (True, False))
        keys, sets = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for deal, n, data in zip(*(dealt.column(c) for c in ("deal", "n", "data"))):
            short, own = _unpacked(n.as_py(), data.as_py())
            keys.append(short * np.uint64(deals) + np.uint64(deal.as_py()))
            sets.append(own)
        shared, a, b, _, _ = pairs_of(np.concatenate(keys), np.concatenate(sets))
        return pa.Table.from_batches([*rest.select(_ROWS.names).cast(_ROWS).to_batches(), *_shared(shared, a, b)], schema=_ROWS)

    return run


def _may_link(percent: int, overlap, a, b):
    """Can sets of at least a and b tokens be linked that share no more than overlap?"""
    return overlap * (100 + percent) >= percent * (a + b)


def _likely(percent: int):
    """Pairs that their sizes and whole bitmaps let pass."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(f"{s}_n").to_numpy() for s in "ab"]
            bits = [batch.column(f"{s}_bits").to_pylist() for s in "ab"]
            lengths = np.array([[len(v) for v in side] for side in bits], np.int64).reshape(2, -1)
            ok = 100 * np.minimum(*n) >= percent * np.maximum(*n)
            for pair in np.unique(lengths[:, ok], axis=1).T:
                at = np.flatnonzero(ok & (lengths == pair[:, None]).all(0))
                x, y = (np.frombuffer(b"".join([side[k] for k in at]), "<i8").reshape(len(at), -1, int(pair.min()) // 8) for side in bits)
                x, y = np.bitwise_or.reduce(x, 1), np.bitwise_or.reduce(y, 1)
                sizes = [v[at] for v in n]
                hidden = np.minimum(sizes[0] - popcount(x), sizes[1] - popcount(y))
                ok[at] = _may_link(percent, popcount(x & y) + hidden, *sizes)
            yield pa.RecordBatch.from_arrays([batch.column(s).filter(pa.array(ok)) for s in "ab"], schema=schema)

    return run, "a long, b long"


def _compare(words: int, percent: int):
    """The linked ones of pairs, by all of their shingles."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column(s).to_pylist() for s in "ab"]
            # A set that is in many pairs of a batch is made once.
            first = {}
            for side, of in zip("ab", names):
                first |= {sid: (f"{side}_text", k) for k, sid in enumerate(of) if sid not in first}
            sets = dict(zip(first, shingle_sets([batch.column(c)[k].as_py() for c, k in first.values()], words)))
            linked = []
            for a, b in zip(*names):
                x, y = sets[a], sets[b]
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                linked.append(_may_link(percent, int(np.count_nonzero(both[1:] == both[:-1])), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(s).filter(pa.array(linked, pa.bool_())) for s in "ab"], schema=schema)

    return run, "a long, b long"


def _passing(pairs: DataFrame, sets: DataFrame, bits: Column, percent: int) -> DataFrame:
    """Pairs that the sizes and these bitmaps of their sets let pass."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("sid").alias(side), F.col("n").alias(f"{side}_n"), bits.alias(f"{side}_bits")), side)
    run, kind = _likely(percent)
    return pairs.mapInArrow(lean(run), kind)


def _verify(pairs: DataFrame, sets: DataFrame, texts, words: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The linked ones of pairs: first by sizes and bitmaps, which are small, then by the texts of the rest, which
    are smaller than their shingles' hashes. A set in many pairs has its text in copies, SHARE pairs each, so
    that its pairs spread over tasks."""
    pairs = scratch.table(name, _passing(pairs, sets, F.substring("data", 8 * FOLDED + 1, 1 << 30), percent))
    n = width(pairs.sparkSession)
    asked = pairs.select(F.col("a").alias("of")).unionAll(pairs.select("b")).groupBy("of").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("copies"))
    asked = scratch.table(f"{name}_asked", asked)
    # Bucketed by set: pairs come to the texts, which are not shuffled again.
    found = scratch.bucketed(f"{name}_texts", texts(asked.select("of"), f"{name}_rows").repartition(n, "sid").dropDuplicates(["sid"]), n, "sid")
    many = asked.filter("copies > 1")
    copied = found.join(many, F.col("sid") == F.col("of")).select("sid", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "text")
    for side in "ab":
        pairs = pairs.join(many.select(F.col("of").alias(side), F.col("copies").alias(f"{side}_copies")), side, "left")
    for side, other in ("ab", "ba"):
        own = [F.col("sid").alias(side), F.col("text").alias(f"{side}_text")]
        few = pairs.filter(F.col(f"{side}_copies").isNull()).drop(f"{side}_copies").join(found.select(*own), side)
        hot = pairs.filter(F.col(f"{side}_copies").isNotNull()).withColumn("copy", F.pmod(F.xxhash64(other), F.col(f"{side}_copies")).cast("int"))
        hot = hot.drop(f"{side}_copies").join(copied.select(*own, "copy"), [side, "copy"]).drop("copy")
        pairs = few.unionByName(hot)
    run, kind = _compare(words, percent)
    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(lean(run), kind)


#: What a leaf holds of each set whose bitmap is as short as can be: its name, component, size and bitmap, in longs.
_MEMBER = 3 + FOLDED


def _shorter(bits: np.ndarray, longs: int) -> np.ndarray:
    """Bitmaps, one a row, folded to longs."""
    return bits if bits.shape[1] == longs else np.bitwise_or.reduce(bits.reshape(len(bits), -1, longs), axis=1)


def _hang():
    """(sid, n, data) to (sid, n, fold): the bitmap that hangs in the trees, of a bit a token at least."""
    schema = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("fold", pa.binary())])

    def fold(n: int, data: bytes) -> bytes:
        longs = FOLDED
        while 64 * longs < n:
            longs *= 2
        return data[: 8 * FOLDED] if longs == FOLDED else _shorter(np.frombuffer(data, "<i8", -1, 8 * FOLDED)[None], longs).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = [fold(n, data) for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("n"), pa.array(folds, pa.binary())], schema=schema)

    return run, "sid long, n long, fold binary"


_LEAF = pa.schema([*((c, pa.int64()) for c in ("key", "part", "number", "least", "most", "hidden", "low", "high")), ("signature", pa.list_(pa.int64())), ("members", pa.binary()), ("longs", pa.int64()), ("lone", pa.bool_())])
_LEAF_SQL = "key long, part long, number long, least long, most long, hidden long, low long, high long, signature array<long>, members binary, longs long, lone boolean"


def _leaves(earlier: int = 0):
    """Sets in order of (key, component, n) to leaves: members, OR of bitmaps, and the ranges of sizes, of
    components and of what a bitmap hides. lone: the leaf is all of its tree. A member is its name, component
    and size, the first trees that it hangs in (as many as earlier) and its bitmap, folded to the longs of the
    shortest one in the leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, None
        keys, rows, bits = np.empty(0, np.int64), np.empty((0, 3 + earlier), np.int64), []

        def given(keys: np.ndarray, rows: np.ndarray, bits: list[bytes], starts: np.ndarray, following) -> pa.RecordBatch:
            ends = np.append(starts[1:], len(keys))
            own, n = keys[starts], rows[:, 2]
            # The first and the last tree of a partition may go on in another one.
            lone = (own != np.append(np.int64(0) if before is None else np.int64(before), own[:-1])) & (own != np.append(own[1:], np.int64(0) if following is None else following))
            lone[0] &= before is not None
            lone[-1] &= following is not None
            over = lambda f, x: pa.array(f.reduceat(x, starts))
            lengths = np.array([len(x) // 8 for x in bits])
            short = np.empty((len(bits), FOLDED), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                short[at] = _shorter(np.frombuffer(b"".join([bits[k] for k in at]), "<i8").reshape(len(at), length), FOLDED)
            signature = np.bitwise_or.reduceat(short, starts, axis=0)
            longs, shortest, members = np.minimum.reduceat(lengths, starts), np.column_stack([rows, short]).astype("<i8"), []
            for x, y, z in zip(starts.tolist(), ends.tolist(), longs.tolist()):
                if z == FOLDED:
                    members.append(shortest[x:y].tobytes())
                else:
                    own_bits = [_shorter(np.frombuffer(v, "<i8")[None], z) for v in bits[x:y]]
                    members.append(np.column_stack([rows[x:y], np.concatenate(own_bits)]).astype("<i8").tobytes())
            lists = pa.ListArray.from_arrays(np.arange(0, signature.size + 1, FOLDED, dtype=np.int32), signature.ravel())
            numbers = np.arange(number, number + len(starts))
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(starts), part)), pa.array(numbers), over(np.minimum, n), over(np.maximum, n), over(np.maximum, n - popcount(short)), over(np.minimum, rows[:, 1]), over(np.maximum, rows[:, 1]), lists, pa.array(members, pa.binary()), pa.array(longs), pa.array(lone)], schema=_LEAF)

        for batch in batches:
            more = [batch.column(c).to_numpy() for c in ("sid", "component", "n")]
            if earlier:
                more.append(batch.column("earlier").flatten().to_numpy().reshape(-1, earlier))
            bits += batch.column("fold").to_pylist()
            keys, rows = np.concatenate([keys, batch.column("key").to_numpy()]), np.concatenate([rows, np.column_stack(more)])
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            starts = np.flatnonzero((np.arange(len(keys)) - np.repeat(new, np.diff(np.append(new, len(keys))))) % LEAF == 0)
            if len(starts) > 1:
                # The last leaf may not be full.
                cut = starts[-1]
                yield given(keys[:cut], rows[:cut], bits[:cut], starts[:-1], keys[cut])
                number, before = number + len(starts) - 1, keys[cut - 1]
                keys, rows, bits = keys[cut:], rows[cut:], bits[cut:]
        if len(keys):
            yield given(keys, rows, bits, np.array([0]), None)

    return run, _LEAF_SQL


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _cross(percent: int, earlier: int = 0):
    """Pairs of sets of two leaves of a tree (of one, where b_members is null) that lie in different components,
    that sizes and bitmaps let pass and that no earlier tree is known to have."""
    head = 3 + earlier

    def met(held: list[tuple[int, np.ndarray, np.ndarray, bool]]) -> pa.RecordBatch:
        """All leaves held at once, their bitmaps of one length: pairs are numbered through, leaf by leaf."""
        trees, first, second, same = zip(*held)
        sizes = [np.array([len(x) for x in side]) for side in (first, second)]
        counts = sizes[0] * sizes[1]
        of = np.repeat(np.arange(len(held)), counts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        i, j = k // sizes[1][of], k % sizes[1][of]
        keep = ~np.array(same)[of] | (i < j)
        i, j = ((v + (np.cumsum(size) - size)[of])[keep] for v, size in zip((i, j), sizes))
        tree = np.array(trees, np.int64)[of[keep]]
        x, y = np.concatenate(first), np.concatenate(second)
        least, most = np.minimum(x[i, 2], y[j, 2]), np.maximum(x[i, 2], y[j, 2])
        keep = (x[i, 1] != y[j, 1]) & (100 * least >= percent * most)
        i, j, tree = i[keep], j[keep], tree[keep]
        hidden = [v[:, 2] - popcount(v[:, head:]) for v in (x, y)]
        step = max(1, PAIRS * FOLDED // (x.shape[1] - head))
        keep = np.ones(len(i), bool)
        for at in range(0, len(i), step):
            p, q = i[at : at + step], j[at : at + step]
            overlap = popcount(x[p, head:] & y[q, head:]) + np.minimum(hidden[0][p], hidden[1][q])
            keep[at : at + step] = _may_link(percent, overlap, x[p, 2], y[q, 2])
        i, j, tree = i[keep], j[keep], tree[keep]
        before = np.zeros(len(i), bool)
        for c in range(3, head):
            before |= (x[i, c] < tree) & (x[i, c][:, None] == y[j, 3:head]).any(1)
        i, j = x[i[~before], 0], y[j[~before], 0]
        pairs = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for tree, a, b, *longs in zip(*(batch.column(c).to_pylist() for c in ("tree", "a_members", "b_members", "a_longs", "b_longs"))):
                x, y = (np.frombuffer(v, "<i8").reshape(-1, head + z) if v is not None else None for v, z in zip((a, b), longs))
                if y is None:
                    least, y = longs[0], x
                elif longs[0] != longs[1]:
                    least = min(longs)
                    x, y = (np.column_stack([v[:, :head], _shorter(np.ascontiguousarray(v[:, head:]), least)]) for v in (x, y))
                else:
                    least = longs[0]
                held.setdefault(least, []).append((tree, x, y, b is None))
                size[least] = size.get(least, 0) + len(x) * len(y) * least // FOLDED
                if size.get(least, 0) >= PAIRS:
                    yield met(held.pop(least))
                    del size[least]
        for left in held.values():
            yield met(left)

    return run, "a long, b long"


def _grow(percent: int, earlier: int):
    """Sets in order to leaves as of _leaves, without those that are all of their tree, and the pairs (a, b) that
    lie within one leaf, whose rows have nothing else."""
    leaves, kind = _leaves(earlier)
    cross, pair = _cross(percent, earlier)
    schema = pa.schema([*_LEAF, *_PAIR])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in leaves(batches):
            several = batch.filter(pa.array(batch.column("low").to_numpy() != batch.column("high").to_numpy()))
            own = [several.column(c) for c in ("key", "members", "longs")]
            met = pa.RecordBatch.from_arrays([own[0], own[1], pa.nulls(several.num_rows, pa.binary()), own[2], own[2]], ["tree", "a_members", "b_members", "a_longs", "b_longs"])
            for pairs in cross(iter([met])):
                yield pa.RecordBatch.from_arrays([*(pa.nulls(pairs.num_rows, f.type) for f in _LEAF), *pairs.columns], schema=schema)
            more = batch.filter(pa.array(~batch.column("lone").to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([*more.columns, *(pa.nulls(more.num_rows, f.type) for f in _PAIR)], schema=schema)

    return run, f"{kind}, {pair}"


_NODE = ["key", "part", "number"]
_HAS = ["least", "most", "hidden", "low", "high", "signature"]


def _goes_down(percent: int) -> Column:
    """Can a set of node a and one of node b, of different components, be linked?"""
    overlap = F.aggregate(F.zip_with("a_signature", "b_signature", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x) + F.least("a_hidden", "b_hidden")
    sizes = (100 * F.col("a_most") >= percent * F.col("b_least")) & (100 * F.col("b_most") >= percent * F.col("a_least"))
    joined = (F.col("a_low") == F.col("a_high")) & (F.col("b_low") == F.col("b_high")) & (F.col("a_low") == F.col("b_low"))
    return ~joined & sizes & _may_link(percent, overlap, F.col("a_least"), F.col("b_least"))


def _traverse(members: DataFrame, percent: int, scratch: Scratch, n: int) -> DataFrame:
    """Pairs from the signature trees of all keys, each traversed against itself from its root.

    members is (key, component, n, sid, fold, earlier). Leaves are numbered within a partition; parents drop bits
    of that number, and above it of the partition's, so that no level needs a count over a whole tree. A tree of
    one leaf ends there.
    """
    order = ["key", "component", "n", "sid"]
    run, kind = _grow(percent, EARLIER)
    grown = scratch.table("leaves", members.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*order, "fold", "earlier").mapInArrow(lean(run), kind))
    within = grown.filter("a IS NOT NULL").select("a", "b")
    leaves = grown.filter("key IS NOT NULL")
    levels, ups = [scratch.table("level0", leaves.select(*_NODE, *_HAS))], []
    top = levels[0].agg(F.max("part"), F.max("number")).first()
    part, number = (x or 0 for x in top)
    while part or number:
        bits = (0, FANOUT) if number else (FANOUT, 0)
        part, number = part >> bits[0], number >> bits[1]
        ups.append([F.shiftright(c, k).alias(c) for c, k in zip(_NODE[1:], bits)])
        merged = F.array(*(F.bit_or(F.col("signature")[k]) for k in range(FOLDED))).alias("signature")
        above = levels[-1].select("key", *ups[-1], *_HAS).groupBy(*_NODE).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("hidden").alias("hidden"), F.min("low").alias("low"), F.max("high").alias("high"), merged)
        levels.append(scratch.table(f"level{len(levels)}", above))
    sides = lambda df, s, columns: df.select(*(F.col(c).alias(f"{s}_{c}") for c in columns))
    ids = [f"{s}_{c}" for s in "ab" for c in _NODE]
    pairs = levels[-1].filter("low <> high").select(*(F.col(c).alias(f"{s}_{c}") for s in "ab" for c in _NODE))
    for k in range(len(levels) - 2, -1, -1):
        pairs = pairs.withColumnsRenamed({c: f"up_{c}" for c in ids})
        for s in "ab":
            below = sides(levels[k].select(*_NODE, *_HAS, *(u.alias(f"up_{c}") for u, c in zip(ups[k], _NODE[1:]))), s, [*_NODE, *_HAS, "up_part", "up_number"])
            on = [F.col(f"up_{s}_key") == F.col(f"{s}_key"), *(F.col(f"up_{s}_{c}") == F.col(f"{s}_up_{c}") for c in _NODE[1:])]
            pairs = pairs.join(below, on)
        first, second = (F.struct(*(F.col(f"{s}_{c}").alias(c) for c in _NODE[1:])) for s in "ab")
        pairs = scratch.table(f"down{k}", pairs.filter((first <= second) & _goes_down(percent)).select(*ids))
    pairs = pairs.filter("a_part <> b_part OR a_number <> b_number")
    for s in "ab":
        pairs = pairs.join(sides(leaves, s, [*_NODE, "members", "longs"]), [f"{s}_{c}" for c in _NODE])
    run, kind = _cross(percent, EARLIER)
    across = pairs.select(F.col("a_key").alias("tree"), "a_members", "b_members", "a_longs", "b_longs").mapInArrow(lean(run), kind)
    return within.union(across).distinct()


def _unpack():
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(data.as_py(), "<i8").reshape(3, -1)], schema=schema)

    return run, "key long, a long, b long"


def jaccard_components(docs: DataFrame, *, words: int = 5, percent: int = 80, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Rows are linked if 100 * (shared shingles) >= percent * (shingles of either). A text of fewer words
    than a shingle is one shingle; null or empty text has none and links with nothing. A component is
    named by its smallest identifier; rows with equal identifiers each take part with their own text, equal
    rows are one set. A null identifier is never the smallest. Texts of any length are taken whole. Other
    columns are not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch, n = Scratch(spark, "jaccard"), width(spark)
    # As few deals as tasks can share evenly: a set is named once in each that it has a key in.
    deals = 2 * n
    d = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    # Texts are read twice: keys, which are the most of what is made, are shuffled and never written besides.
    met = d.select("text").mapInArrow(lean(_deal(words, percent, deals)), _ROWS_SQL).groupBy("deal").applyInArrow(_meet(deals), _ROWS_SQL)
    rows = scratch.table("met", met.select("kind", "a", "b", "data"))
    read = scratch.table("read", d.mapInArrow(lean(_read(words)), _ROWS_SQL))
    named = scratch.table("named", read.filter("kind = 0").select("doc_id", "n", F.col("a").alias("sid"), F.col("b").alias("th")))
    pairs = scratch.table("pairs", rows.filter("kind = 1").select("a", "b").distinct())
    # One document stands for each set that has to be compared: rows equal in identifier and text are one.
    wanted = scratch.table("wanted", pairs.select(F.col("a").alias("of")).union(pairs.select("b")).distinct())
    none = F.lit(-(1 << 63))
    stands = named.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.coalesce("doc_id", none).alias("d"), "th")).alias("stand"))
    stands = scratch.table("stands", stands.select("sid", "least", F.col("stand.d").alias("stand"), F.col("stand.th").alias("th")))
    own = d.select(F.coalesce("doc_id", none).alias("stand"), "th", "text")

    def texts(wanted: DataFrame, name: str) -> DataFrame:
        """Texts are read where they lie, and only those that may be wanted are shuffled."""
        key = F.xxhash64("stand", "th")
        rows = scratch.table(name, stands.join(wanted, F.col("sid") == F.col("of")).select("stand", "th", "sid"))
        return Sieve(scratch, f"{name}_keys", rows, key)(own, key).join(rows, ["stand", "th"]).select("sid", "text")

    sets = read.filter("kind = 4").select(F.col("a").alias("sid"), "n", "data")
    sets = Sieve(scratch, "wanted_keys", wanted, F.col("of"))(sets, F.col("sid")).join(wanted, F.col("sid") == F.col("of"), "left_semi")
    sets = scratch.table("sets", sets.dropDuplicates(["sid"]))
    run, kind = _hang()
    folds = scratch.table("folds", sets.select("sid", "n", "data").mapInArrow(lean(run), kind))
    # Short bitmaps end most pairs; whole ones are sent for the others alone.
    few = scratch.table("few", _passing(pairs, folds, F.col("fold"), percent))
    links = scratch.table("linked", _verify(few, sets, texts, words, percent, scratch, "likely"))
    scratch.drop("likely_texts")
    joined = scratch.table("joined", components(links, scratch, "first"))
    of = lambda s: joined.select(F.col("node").alias(s), F.col("component").alias(f"{s}_in"))
    # A tree all of whose neighbours lie in one component has one at its root.
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = scratch.table("apart", apart.filter(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).select(F.col("a").alias("x"), F.col("b").alias("y")))
    run, kind = _unpack()
    shared = scratch.table("shared", rows.filter("kind = 3").select("data").mapInArrow(lean(run), kind))
    mixed = scratch.table("mixed", shared.join(apart, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select(F.col("key").alias("of_key")).distinct())
    shared = shared.join(mixed, F.col("key") == F.col("of_key"))
    members = scratch.table("listed", shared.select("key", F.col("a").alias("sid")).union(shared.select("key", "b")).distinct())
    # The two sets of a tree of two have been compared, and trees of the same sets are one.
    trees = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("sid").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("mark"))
    trees = trees.filter("size > 2").groupBy("size", "sum", "mark").agg(F.min("key").alias("of_key"))
    # From here on a key is a small number, which packs better; it is written, and so stays the same.
    trees = scratch.table("trees", trees.select("of_key", F.monotonically_increasing_id().alias("number")))
    members = scratch.table("members", members.join(trees, F.col("key") == F.col("of_key")).select(F.col("number").alias("key"), "sid"))
    scratch.drop("shared", "mixed", "listed", "trees")
    first = members.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list("key")), 1, EARLIER).alias("earlier"))
    first = first.withColumn("earlier", F.concat("earlier", F.array_repeat(F.lit(NONE), EARLIER - F.size("earlier"))))
    known = folds.join(first, "sid").join(joined.select(F.col("node").alias("sid"), "component"), "sid", "left")
    known = scratch.table("hung", known.withColumn("component", F.coalesce("component", "sid")))
    more = scratch.table("more", _traverse(members.join(known, "sid"), percent, scratch, n).join(pairs, ["a", "b"], "left_anti"))
    scratch.drop("leaves", "members", "hung", "folds")
    # What the first links joined comes as stars.
    links = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(_verify(more, sets, texts, words, percent, scratch, "likelier"))
    joined = components(links, scratch, "second")
    known = stands.join(joined.select(F.col("node").alias("sid"), "component"), "sid", "left").select("sid", "least", F.coalesce("component", "sid").alias("component"))
    known = scratch.table("known", known)
    least = scratch.table("least", known.groupBy("component").agg(F.min("least").alias("component_id")))
    final = scratch.table("final", known.join(least, "component").select(F.col("sid").alias("of"), "component_id"))
    scratch.keep("named", "final")
    out = named.filter("sid IS NOT NULL").join(final, F.col("sid") == F.col("of")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(named.filter("sid IS NULL").select("doc_id", "n", "doc_id"))


def op7_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)


def jaccard_sql(docs: str, words: int, percent: int) -> str:
    """DuckDB SQL for jaccard_components over the relation docs."""
    grams = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {docs}),
grams AS (
  SELECT DISTINCT r, g FROM (
    SELECT r, unnest(list_transform(range(1, len(w) - {words - 2}), lambda i: {grams})) AS g FROM t WHERE len(w) >= {words}
    UNION ALL SELECT r, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND {words - 1})),
sized AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
half AS (
  SELECT a, b FROM shared s JOIN sized x ON s.a = x.r JOIN sized y ON s.b = y.r
  WHERE 100 * s.n >= {percent} * (x.n + y.n - s.n)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT r AS a, r AS b FROM t UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT t.doc_id, coalesce(any_value(sized.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN t ON reach.a = t.r JOIN t o ON reach.b = o.r LEFT JOIN sized ON sized.r = t.r GROUP BY t.r, t.doc_id
"""


OP7_SQL = jaccard_sql("documents", 4, 85)
