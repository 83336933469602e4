import re

import numpy as np
import public_tokenizers

import corpus_pipeline as cp
from tidemark.llm import bpe


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages_against_plain_python(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[k] = (before.collect(), docs.collect())
        if k < 4:
            assert docs.columns == cp.COLUMNS, name
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {x.doc_id for x in kept[0][1]}
    assert np.mean([(i in ids) == (q == 1) for i, q in labels.items()]) > 0.95

    before, after = kept[1]
    sets, root = {x.doc_id: grams(x.text) for x in before}, {x.doc_id: x.doc_id for x in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {x.doc_id for x in after} == {x for x in root if find(x) == x}

    before, after = ({x.doc_id: x for x in rows} for rows in kept[2])
    assert before.keys() == after.keys() and all(len(after[i].text) == after[i].n_chars for i in after if after[i].text != before[i].text)
    assert not [x for x in after.values() if re.search(r"@mail\d\.example\.com", x.text) and x.text == before[x.doc_id].text]
    texts = {x.doc_id: x.text for x in kept[3][0]}
    assert all(x.text == texts[x.doc_id] for x in kept[3][1])
    enc = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert len(kept[4][1]) == len(kept[4][0])
    for x in kept[4][1]:
        assert np.frombuffer(bytes(x.tokens), "<u4").tolist() == enc.encode_ordinary(texts[x.doc_id]) and x.n_tokens * 4 == len(x.tokens)


def test_run_takes_nulls_and_empty_tables(spark, tmp_path):
    """Every row that is left, with a clashing extra column in the tables; the classifier has no usable labels."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, quality int"
    rows = [(1, "plain words that say little", "en", "a", 5, 0), (1, "plain words that say little", "en", "a", 5, 0), (2, None, None, None, None, 0), (None, "", "en", "a", 0, 0), (4, "plain words that say little", "en", "a", 5, 0)]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/some/documents.parquet")
    for k, (_, stage) in enumerate(cp.STAGES[:3]):
        docs = stage(spark, docs, f"{tmp_path}/some").cache()
        # 4 is a copy of 1; rows that share the identifier that stays all stay, as do those without one.
        assert sorted((x.doc_id or 0, x.text) for x in docs.collect() if x.text) == [(1, rows[0][1]), (1, rows[0][1]), *([(4, rows[0][1])] if k == 0 else [])]
        assert docs.columns == cp.COLUMNS and docs.filter("doc_id = 2 OR doc_id IS NULL").count() == 2
    enc = bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    last = cp.run(spark, f"{tmp_path}/some")
    assert last.columns == ["doc_id", "n_tokens", "tokens"]
    want = {1: enc.encode_ordinary(rows[0][1]), 2: [], None: []}
    assert all(np.frombuffer(bytes(x.tokens), "<u4").tolist() == want[x.doc_id] and x.n_tokens == len(want[x.doc_id]) for x in last.collect())
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
