import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import shingles, signature_tree


def grams(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [grams(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioustrn") for _ in range(r.randrange(2, 6)))
    rows, passage = [], [word() for _ in range(40)]
    for k in range(60):
        base = [word() for _ in range(r.choice([1, 3, 5, 9, 20, 60, 200]))]
        if k % 3 == 0:
            base += passage
        for _ in range(r.randrange(1, 5)):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.3:
                w = w[: max(1, len(w) - r.randrange(1, 8))]
            rows.append((len(rows), r.choice([" ", "\n", "  "]).join(w).replace("a", r.choice("aA"))))
    return [*rows, (7000, None), (7001, " \t"), (None, rows[0][1]), (5, rows[9][1]), (5, "another text under the same number"), (7002, "é " * 3000), (7003, "x")]


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_equals_brute_force(spark, words, percent):
    rows = corpus(words)
    docs = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, n int, key string")
    got = sorted(map(tuple, signature_tree.jaccard_components(docs, words=words, percent=percent).collect()), key=str)
    assert got == brute(rows, words, percent)


def test_empty(spark):
    assert signature_tree.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_always_meet(percent):
    r = np.random.default_rng(percent)
    for _ in range(400):
        n = int(r.integers(1, 400))
        x = r.integers(0, 1 << 63, n).astype(np.uint64)
        drop = int(r.integers(0, 1 + n * (100 - percent) // 100))
        y = np.concatenate([x[drop:], r.integers(0, 1 << 63, int(r.integers(0, 1 + n // 8))).astype(np.uint64)])
        same = n - drop
        if 100 * same >= percent * (len(x) + len(y) - same):
            a, b = (set(signature_tree.part_keys(np.unique(v), percent).tolist()) for v in (x, y))
            assert a & b


@pytest.mark.parametrize("percent", [80, 85])
def test_sets_without_a_common_token_share_no_tree(percent):
    """Else trees grow with the table, and what is compared with its square."""
    r = np.random.default_rng(percent)
    for n in (40, 130, 200, 1000):
        keys = np.concatenate([np.unique(signature_tree.part_keys(np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)), percent)) for _ in range(300)])
        counts = np.unique(keys, return_counts=True)[1]
        # Sets with the most empty parts of all have a few of these left.
        assert counts[counts > 1].sum() < 0.002 * len(keys) and counts.max() < 15


@pytest.mark.parametrize("names", [3, 1 << 16, (1 << 16) + 1])
def test_keys_and_their_sets_come_back_as_packed(names):
    r = np.random.default_rng(names)
    sets = r.permutation(np.append(np.arange(names), [0, 1])).astype(np.int64) - 5
    keys = r.integers(0, 1 << 40, len(sets)).astype(np.uint64)
    keys[:2] = 0, (1 << 40) - 1
    got = signature_tree._unpacked(len(keys), signature_tree._pack(keys, sets))
    assert np.array_equal(got[0], keys) and np.array_equal(got[1], sets)


def test_hashes_of_words_do_not_depend_on_their_place():
    one, two = (list(shingles.shingle_sets(t, 4)) for t in (["The cat sat on the mat"], ["x" * 1000, "", None, "the CAT  sat\non the mat"]))
    assert np.array_equal(one[0], two[3]) and len(one[0]) == 3 and len(two[1]) == len(two[2]) == 0 and len(two[0]) == 1


def thue_morse(flip):
    w = flip
    for _ in range(10):
        w += "".join("b" if c == "a" else "a" for c in w)
    return w


def test_patterned_words_do_not_collide(spark):
    one, other = thue_morse("a"), thue_morse("b")
    assert len(one) == 1024 and list(shingles.shingle_sets([one], 4))[0] != list(shingles.shingle_sets([other], 4))[0]
    docs = spark.createDataFrame([(1, one), (2, other), (3, one[:64]), (4, other[:64]), (5, one[:16]), (6, other[:16]), (7, one)], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in signature_tree.jaccard_components(docs, words=4, percent=85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 1}


def clusters(seed, bases=30, copies=24, words=80):
    """Texts of one length around far bases: under a key neighbours by name are often of different bases."""
    r = random.Random(seed)
    passage = [f"p{k}" for k in range(words * 3 // 4)]
    rows = []
    for b in range(bases):
        tail = [f"b{b}x{k}" for k in range(words // 4)]
        for _ in range(copies):
            w = passage + tail
            w[words - 1 - r.randrange(words // 4)] = f"e{r.randrange(10**9)}"
            rows.append((len(rows), " ".join(w)))
    return rows


def test_links_that_only_the_trees_find(spark, monkeypatch):
    rows = clusters(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    run = lambda: sorted(map(tuple, signature_tree.jaccard_components(docs, words=4, percent=85).collect()), key=str)
    monkeypatch.setattr(signature_tree, "LEAF", 8)
    want = brute(rows, 4, 85)
    assert len({x[2] for x in want}) < len(rows)
    assert run() == want
    # Without what the levels above the leaves let down, links are missing.
    monkeypatch.setattr(signature_tree, "_goes_down", lambda percent: signature_tree.F.lit(False))
    assert run() != want


def test_nodes_bound_all_that_hangs_below(spark):
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 1 << 63, int(r.integers(20, 60))).astype(np.uint64)) for _ in range(300)]
    rows = [(int(k % 3), int(k % 7), len(s), k, signature_tree.bitmap(s)[: signature_tree.FOLDED].tobytes()) for k, s in enumerate(sets)]
    members = spark.createDataFrame([(*x[:4], bytearray(x[4])) for x in rows], "key long, component long, n long, sid long, fold binary")
    order = ["key", "component", "n", "sid"]
    run, kind = signature_tree._leaves()
    leaves = members.repartitionByRange(2, *order).sortWithinPartitions(*order).mapInArrow(run, kind).collect()
    seen = []
    for x in leaves:
        m = np.frombuffer(x.members, "<i8").reshape(-1, signature_tree._MEMBER)
        assert len(m) <= signature_tree.LEAF and {int(k) % 3 for k in m[:, 0]} == {x.key}
        assert (x.least, x.most, x.low, x.high) == (m[:, 2].min(), m[:, 2].max(), m[:, 1].min(), m[:, 1].max())
        assert np.array_equal(np.bitwise_or.reduce(m[:, 3:]), x.signature)
        assert not x.lone or len(m) == sum(k % 3 == x.key for k in range(300))
        seen += m[:, 0].tolist()
    assert sorted(seen) == list(range(300))


def test_bitmaps_bound_the_overlap_at_any_size():
    r = np.random.default_rng(6)
    for n in (1, 40, 3000, 20000):
        x = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        kept = int(len(x) * 0.9)
        like = np.unique(np.concatenate([x[:kept], r.integers(0, 1 << 63, len(x) // 20 + 1).astype(np.uint64)]))
        far = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        batch = {"a": [1, 1], "b": [2, 3], "a_n": [len(x)] * 2, "b_n": [len(like), len(far)], "a_bits": [signature_tree.bitmap(x)[signature_tree.FOLDED :].tobytes()] * 2, "b_bits": [signature_tree.bitmap(v)[signature_tree.FOLDED :].tobytes() for v in (like, far)]}
        run, _ = signature_tree._likely(80)
        passed = [b for out in run(iter([pa.RecordBatch.from_pydict(batch)])) for b in out.column("b").to_pylist()]
        both = len(np.intersect1d(x, like))
        assert 3 not in passed and (2 in passed or 100 * both < 80 * (len(x) + len(like) - both))


def test_long_texts_under_common_trees_do_not_all_pass(spark, monkeypatch):
    r, rows = random.Random(8), []
    passage = [f"p{k}" for k in range(1500)]
    for k in range(40):
        rows.append((k, " ".join(passage + [f"w{r.randrange(10**9)}" for _ in range(1000)])))
    rows += [(100, rows[3][1] + " end"), (101, " ".join(rows[5][1].split()[40:]))]
    made, table = {}, signature_tree.Scratch.table

    def counted(self, name, df):
        out = table(self, name, df)
        made[name] = out.count()
        return out

    monkeypatch.setattr(signature_tree.Scratch, "table", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in signature_tree.jaccard_components(docs, words=4, percent=85).collect()}
    assert got == {k: {100: 3, 101: 5}.get(k, k) for k, _ in rows}
    # They do share trees: there is something to let pass.
    assert made["members"] > 100 and made["more"] <= len(rows)


def test_a_pair_comes_from_few_trees_and_from_one_at_least():
    r = np.random.default_rng(9)
    s = np.unique(r.integers(0, 1 << 63, 200).astype(np.uint64))
    bits = np.frombuffer(signature_tree.bitmap(s)[: signature_tree.FOLDED].tobytes(), "<i8")
    trees = {k: sorted(r.choice(60, int(r.integers(3, 30)), replace=False).tolist()) for k in range(20)}
    first = {k: [*v, *[signature_tree.NONE] * signature_tree.EARLIER][: signature_tree.EARLIER] for k, v in trees.items()}
    run, _ = signature_tree._cross(85, signature_tree.EARLIER)
    longs, found, shared = signature_tree.FOLDED, [], []
    for t in range(60):
        inside = [k for k, v in trees.items() if t in v]
        shared += [(a, b) for a in inside for b in inside if a < b]
        leaf = np.array([[k, k, len(s), *first[k], *bits] for k in inside], "<i8").tobytes()
        batch = pa.RecordBatch.from_pydict({"tree": [t], "a_members": [leaf], "b_members": pa.array([None], pa.binary()), "a_longs": [longs], "b_longs": [longs]})
        found += [(a, b) for out in run(iter([batch])) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]
    assert set(found) == set(shared) and len(found) < len(shared) / 2


def test_leaves_of_other_lengths_meet():
    r = np.random.default_rng(10)
    x = np.unique(r.integers(0, 1 << 63, 1050).astype(np.uint64))
    sets = [x, x[:1000], np.unique(r.integers(0, 1 << 63, 1000).astype(np.uint64))]
    hang, _ = signature_tree._hang()
    (hung,) = hang(iter([pa.RecordBatch.from_pydict({"sid": [0, 1, 2], "n": [len(v) for v in sets], "data": [signature_tree.bitmap(v).tobytes() for v in sets]})]))
    folds = hung.column("fold").to_pylist()
    assert [len(f) // 8 for f in folds] == [2 * signature_tree.FOLDED, signature_tree.FOLDED, signature_tree.FOLDED]
    leaves = [b"".join(np.array([k, k, len(sets[k])], "<i8").tobytes() + folds[k] for k in of) for of in ([0], [1, 2])]
    run, _ = signature_tree._cross(85)
    batch = pa.RecordBatch.from_pydict({"tree": [7], "a_members": [leaves[0]], "b_members": [leaves[1]], "a_longs": [2 * signature_tree.FOLDED], "b_longs": [signature_tree.FOLDED]})
    (out,) = run(iter([batch]))
    assert (out.column("a").to_pylist(), out.column("b").to_pylist()) == ([0], [1])


def test_keys_are_not_written_beside_their_shuffle(spark, monkeypatch):
    """They are the most of what the join makes: what is written before the pairs is less than half of the keys."""
    r = random.Random(12)
    rows = [(k, " ".join(f"{r.randrange(16**8):x}" for _ in range(400))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = sum(len(signature_tree.part_keys(s, 85)) for s in shingles.shingle_sets([t for _, t in rows], 4))
    written, table = {}, signature_tree.Scratch.table

    class Known(Exception):
        pass

    def counted(self, name, df):
        if name == "pairs":
            raise Known
        out = table(self, name, df)
        # Bitmaps are a part of the sets that stays in proportion to them.
        rows = out.filter("kind <> 4") if "kind" in out.columns else out
        written[name] = sum(len(x.data or b"") for x in rows.collect()) if "data" in out.columns else 0
        return out

    monkeypatch.setattr(signature_tree.Scratch, "table", counted)
    with pytest.raises(Known):
        signature_tree.jaccard_components(docs, words=4, percent=85)
    assert sum(written.values()) < 5 * keys / 2
