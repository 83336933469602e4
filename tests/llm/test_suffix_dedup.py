import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import suffix_dedup as sd


def brute(rows):
    texts, seen = [(t or "").encode() for _, t in rows], {}
    for k, t in enumerate(texts):
        for p in range(len(t) - sd.LENGTH + 1):
            seen.setdefault(t[p : p + sd.LENGTH], []).append((k, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                gone[k][p : p + sd.LENGTH] = True
    out = []
    for (i, _), t, g in zip(rows, texts, gone):
        kept = bytes(b for b, x in zip(t, g) if not x)
        out.append((i, len(t), int(g.sum()), int(sum(g[p] and (p == 0 or not g[p - 1]) for p in range(len(g)))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    prose = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = [prose(n) for n in (199, 200, 201, 260, 700, 1500)]
    rows = [(k, prose(r.randrange(0, 500)) + (r.choice(shared) if r.random() < 0.7 else "") + prose(r.randrange(0, 300))) for k in range(60)]
    rows += [(100, shared[4][:300] + prose(50) + shared[4][200:]), (101, "ab" * 400), (102, "x" * 199), (103, "y" * 200), (104, "z" * 201), (105, None), (106, ""), (107, prose(30000))]
    return rows + [(3, rows[3][1]), (3, rows[5][1][:-7] + "#"), (None, rows[8][1]), (108, rows[107 - 100 + 60][1] if len(rows) > 67 else "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, at int").repartition(3)
    got = sorted(map(tuple, sd.remove_repeats(docs).drop("kept").collect()), key=str)
    want = brute(rows)
    assert [x for x, y in zip(got, want) if x != y] == [] and len(got) == len(want)


def test_passages_of_about_length(spark):
    """Anchors of a passage that are equal modulo STRINGS share a block, which is no repeat of itself."""
    rows = []
    for seed in range(300):
        r = random.Random(seed)
        prose = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
        passage = prose(r.randrange(120, 400))
        rows += [(2 * seed + k, prose(r.randrange(0, 250)) + passage + prose(r.randrange(0, 250))) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, sd.remove_repeats(docs).drop("kept").collect()), key=str)
    want = brute(rows)
    assert [x for x, y in zip(got, want) if x != y] == [] and len(got) == len(want)


def test_one_passage_in_very_many(spark):
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    rows = [(k, f"{k} {r.random()} {passage} {k * 7} {r.random()}") for k in range(1500)]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(x.n_spans == 1 and x.n_removed >= 300 and bytes(x.kept).decode().startswith(f"{x.doc_id} ") for x in got)


def test_empty(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert sd.remove_repeats(spark.createDataFrame([(1, "a" * 500)], "doc_id long, text string")).first().n_removed == 500


def test_multikey_quicksort():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        tokens = [r.integers(-3, 3, n) for _ in range(3)]
        order = sd.multikey_quicksort(tokens)
        rows = np.stack(tokens, 1)
        assert rows[order].tolist() == sorted(rows.tolist())
