import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import order_minhash as omh

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def brute(spark, texts):
    """The same fingerprint with plain loops; only Spark's hash of a row of values is asked for."""
    def h(*values):
        return [x.h for x in spark.createDataFrame(values).select(F.xxhash64("*").alias("h")).collect()] if values else []

    out = []
    for text in texts:
        pieces = [run[i : i + 12] for run in re.findall(r"\S+", text) for i in range(max(1, len(run) - 11))]
        if not pieces:
            out.append("")
            continue
        kmers = h(*zip(*(pieces[j:] for j in range(3)))) if len(pieces) >= 3 else h((" ".join(pieces),))
        upper = lambda x: x & ~omh.PLACE
        seen, items = {}, []
        for place, x in enumerate(kmers):
            seen[upper(x)] = seen.get(upper(x), -1) + 1
            items.append((upper(x), seen[upper(x)], place))
        numbered = spark.createDataFrame([(a, b) for a, b, _ in items], "a long, b int").select(F.xxhash64("a", "b").alias("h")).collect()
        placed = sorted((upper(x.h), p) for x, (_, _, p) in zip(numbered, items))
        slots = {}
        for x, p in placed:
            slots.setdefault(x >> 59, []).append((p, ((x | p) % (1 << 64)) >> 32))
        text_out = ""
        for slot in sorted(slots):
            acc = slot
            for _, x in sorted(slots[slot][:2]):
                acc = spark.createDataFrame([(acc, x)], "a long, b long").select(F.xxhash64("a", "b").alias("h")).first().h
            text_out += f"{acc & 0x7FFFFFFF:08X}"
        out.append(text_out)
    return out


def test_equals_brute_force(spark):
    texts = ["", " \n ", "one", "one two", "a b c a b c a b c", prose(1, 12), "x" * 12 + " " + "abcdefghijklmnop" + " y", "日本語の文章には空白がありませんから"]
    got = [x.f for x in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(omh.as_string(omh.signature(F.col("t"))).alias("f")).collect()]
    assert got == brute(spark, texts)


def test_edits_and_order_lower_likeness(spark):
    base = prose(2, 400).split()
    few, many, other = base[:], base[:], prose(3, 400).split()
    few[200], many[::12] = "changed", ["changed"] * len(many[::12])
    moved = base[200:] + base[:200]
    rows = [(" ".join(base), " ".join(x)) for x in (base, few, many, moved, other)]
    near = [x.n for x in spark.createDataFrame(rows, "a string, b string").select(omh.likeness(omh.signature(F.col("a")), omh.signature(F.col("b"))).alias("n")).collect()]
    assert near[0] == 1 and near[0] > near[1] > near[2] > near[4] == 0 and near[3] < near[1]


def test_contract(spark):
    rows = [(7, "x" * 5, "e"), (3, None, "e"), (3, "", "e"), (1, prose(4, 50), "e"), (1, prose(4, 50), "e"), (None, "é😀 abc", "e"), (9, prose(5, 3000), "e"), (9, "other text", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    got = omh.fingerprints(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    text = {7: "x" * 5, 1: prose(4, 50)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    # 3 is empty, so 1 keeps its first half; 7 is followed by one of the two of 9.
    assert by[1][0] == by[1][1] and by[1][0].edited_sha256 == sha(text[1][: len(text[1]) - len(text[1]) // 2])
    assert by[7][0].edited_sha256 in {sha("xxx" + prose(5, 3000)[:2]), sha("xxx" + "ot")}
    assert by[None][0].n_chars == 6 and by[None][0].edited_sha256 == sha("é😀 " + text[1][:3])
    assert {x.n_chars for x in by[3]} == {0} and by[3][0].fingerprint == "" and by[3][0].near_edited == 1
    assert omh.fingerprints(docs.filter("doc_id = 7")).first().edited_sha256 == sha("xxxxx")
    assert omh.fingerprints(docs.filter("doc_id = 99")).count() == 0


def test_one_inserted_character_in_text_without_spaces(spark):
    r = random.Random(8)
    for letters in ("".join(chr(c) for c in range(0x4E00, 0x4F00)), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        base = "".join(r.choice(letters) for _ in range(3000))
        other = "".join(r.choice(letters) for _ in range(3000))
        rows = [(base, letters[0] + base), (base, base[:1500] + letters[1] + base[1500:]), (base, other)]
        near = [x.n for x in spark.createDataFrame(rows, "a string, b string").select(omh.likeness(omh.signature(F.col("a")), omh.signature(F.col("b"))).alias("n")).collect()]
        assert near[0] > 0.9 and near[1] > 0.7 and near[2] == 0


def test_whole_table_recounted(spark, sf):
    """Every column but the fingerprints themselves, from the texts and the fingerprints."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {x.doc_id: x.text or "" for x in docs.collect()}
    got = {x.doc_id: x for x in omh.fingerprints(docs).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    cut = lambda f: {f[i : i + 8] for i in range(0, len(f), 8)}
    like = lambda a, b: 1.0 if not a and not b else len(cut(a) & cut(b)) / (max(len(a), len(b)) // 8)
    edits = []
    for i, d in enumerate(order):
        x, n, after = got[d], len(texts[d]), order[(i + 1) % len(order)]
        edited = texts[d][: n - n // 2] + texts[after][: n // 2]
        edits.append((d, edited))
        assert x.n_chars == n and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert x.near_edited == like(x.fingerprint, x.edited_fingerprint) and x.near_next == like(x.fingerprint, got[after].fingerprint)
    again = spark.createDataFrame(edits, "d long, t string").select("d", omh.as_string(omh.signature(F.col("t"))).alias("f")).collect()
    assert all(got[x.d].edited_fingerprint == x.f for x in again)
