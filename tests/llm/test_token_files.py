import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import bpe, token_files

END = token_files.END


def test_lengths():
    head, inner, tail = token_files.lengths(np.array([1, END, END, 2, 3, END, 4], "<u2"), END)
    assert (head, inner.tolist(), tail) == (1, [0, 2], 1)
    assert token_files.lengths(np.array([1, 2], "<u2"), END)[0] == 2


@pytest.mark.parametrize("block,run", [(2, 3), (6, 1), (64, 4), (1 << 20, 1024)])
def test_blocks_are_stitched(spark, tmp_path, block, run):
    """Also over the ends of stretches of blocks: of three, of one, of four."""
    rng = np.random.default_rng(block)
    expected, rows = [], []
    for f, last in enumerate([True, False, True]):
        docs = [int(n) for n in rng.integers(0, 40, 30)] + [500, 0, 0]
        ids = np.concatenate([np.append(rng.integers(0, 9, n), END) for n in docs]).astype("<u2")
        ids = ids if last else np.append(ids, [5, 5, 5]).astype("<u2")
        path = f"file://{tmp_path}/{f}.tokens"
        (tmp_path / f"{f}.tokens").write_bytes(ids.tobytes())
        rows.append((path, len(ids) * 2))
        expected += [(path, k, n, True) for k, n in enumerate(docs)] + ([] if last else [(path, len(docs), 3, False)])
    got = token_files.count_tokens(spark.createDataFrame([*rows, (None, 4), ("file:///none", 0)], "path string, bytes long"), END, block=block, run=run).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and repeated rows, a null identifier, a very long text, other columns of clashing names, no rows."""
    rows = [(1, "plain words", "x"), (1, "plain words", "x"), (2, None, "y"), (3, "", None), (None, "no number", "z"), (4, "long text " * 50000, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    write = lambda d, name: token_files.write_token_files(d, f"file://{tmp_path}/{name}", public_tokenizers.path(token_files.VOCABULARY), public_tokenizers.PATTERN, END).collect()
    made = spark.createDataFrame(write(docs, "some"), "path string, bytes long, ids array<long>")
    counted = {(x.path, x.place): x.n_tokens for x in token_files.count_tokens(made, END, block=1000).collect()}
    enc = bpe.encoder(public_tokenizers.path(token_files.VOCABULARY), public_tokenizers.PATTERN)
    got = sorted(((d, counted[m.path, k]) for m in made.collect() for k, d in enumerate(m.ids)), key=str)
    assert got == sorted(((d, len(enc.encode_ordinary(t or ""))) for d, t, _ in rows), key=str) and len(counted) == len(rows)
    assert write(docs.filter("doc_id = 99"), "none") == []
    assert token_files.count_tokens(made.filter("bytes < 0"), END).count() == 0


def test_query_equals_the_tokenizer(spark, sf):
    enc = bpe.encoder(public_tokenizers.path(token_files.VOCABULARY), public_tokenizers.PATTERN)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = dict(map(tuple, token_files.op3_token_counts(spark, sf).collect()))
    assert got == {d.doc_id: len(enc.encode_ordinary(d.text or "")) for d in docs}
