"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens by the tokenizer's pattern, in blocks of neighbouring rows. Each block
keeps the positions of its pre-tokens as indices into the list of its own distinct words; only those
words are shuffled, dealt by their hash, so that each distinct word of the corpus is encoded exactly
once. The ids go back to the blocks that asked for them and are put in place by position. Decoding
joins ids with the table of token bytes, which has one row a token of the vocabulary: of a fixed size, it is
held by every worker, and the join is a lookup in it.

What is shuffled grows with the number of blocks times the distinct words of a block, not with the
pre-tokens; a word that is everywhere is one entry a block.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch, lean, width

#: Bytes of text in one block, but for a text that is longer alone.
BLOCK = 16 << 20


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def small(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed: all lowest bytes first, then all next ones, which are mostly zero."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def large(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack(words: list[bytes]) -> bytes:
    return zlib.compress(np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words), 1)


def unpack(data: bytes, n: int) -> list[bytes]:
    plain = zlib.decompress(data)
    ends = np.cumsum(np.frombuffer(plain, "<u4", n), dtype=np.int64) + 4 * n
    return [plain[a:b] for a, b in zip(np.concatenate([[4 * n], ends[:-1]]).tolist(), ends.tolist())] if n else []


def _blocks(pattern: str, deals: int, most: int):
    """Rows of two kinds: a block's positions (deal is -1), and its words by the deal of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        task, number = TaskContext.get().partitionId(), 0
        ids: list = []
        counts: list[int] = []
        places: list[np.ndarray] = []
        own: dict[str, int] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            mark = (task << 32) | number
            head = {"block": [mark], "deal": [-1], "ids": [ids], "counts": [counts], "n": [len(own)]}
            yield pa.RecordBatch.from_pydict(head | {"data": [small(np.concatenate([np.empty(0, "<u4"), *places]))], "at": [None]}, schema=schema)
            words = [w.encode("utf-8", "surrogatepass") for w in own]
            to = np.array([xxhash.xxh64_intdigest(w) % deals for w in words], dtype=np.int64)
            order = np.argsort(to, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if words else []:
                yield pa.RecordBatch.from_pydict({"block": [mark], "deal": [int(to[part[0]])], "ids": [None], "counts": [None], "n": [len(part)], "data": [pack([words[i] for i in part])], "at": [small(np.diff(part, prepend=0))]}, schema=schema)

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found = find(text)
                places.append(np.array([own.setdefault(w, len(own)) for w in found], "<u4"))
                ids.append(ident)
                counts.append(len(found))
                size += len(text)
                if size >= most:
                    yield from rows()
                    number += 1
                    ids, counts, places, own, size = [], [], [], {}, 0
        if ids:
            yield from rows()

    schema = pa.schema([("block", pa.int64()), ("deal", pa.int32()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n", pa.int64()), ("data", pa.binary()), ("at", pa.binary())])
    return run, "block long, deal int, ids array<long>, counts array<long>, n long, data binary, at binary"


def _encode(path: str, pattern: str):
    """All blocks' words of one deal: each distinct one is encoded once, and each block gets its ids."""
    reply = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("at", pa.binary()), ("tokens", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        single = encoder(path, pattern)._encode_single_piece
        known: dict[bytes, list[int]] = {}
        out: dict[str, list] = {"block": [], "n": [], "at": [], "tokens": []}
        for block, n, data, at in zip(*(table.column(c) for c in ("block", "n", "data", "at"))):
            words = unpack(data.as_py(), n.as_py())
            for w in words:
                if w not in known:
                    known[w] = single(w)
            found = [known[w] for w in words]
            lengths = np.fromiter(map(len, found), "<u4", len(found))
            flat = np.fromiter((t for x in found for t in x), "<u4", int(lengths.sum()))
            out["block"].append(block.as_py())
            out["n"].append(n.as_py())
            out["at"].append(at.as_py())
            out["tokens"].append(small(np.concatenate([lengths, flat])))
        return pa.Table.from_pydict(out, schema=reply)

    return run, "block long, n long, at binary, tokens binary"


def gather(starts: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the flat array of the runs that index names, one run after the other; their lengths."""
    n = lengths[index]
    ends = np.cumsum(n)
    return np.repeat(starts[index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0), n


def _placed(table: dict[bytes, int], texts: pa.Table, words: pa.Table) -> Iterator[tuple[int | None, np.ndarray, bytes]]:
    """Identifier, token ids and their bytes of each row of a block, one row at a time."""
    pieces = [b""] * (max(table.values()) + 1)
    for piece, rank in table.items():
        pieces[rank] = piece
    for ids, counts, n, data in zip(*(texts.column(c) for c in ("ids", "counts", "n", "data"))):
        n = n.as_py()
        lengths, parts, where = np.zeros(n, np.int64), [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for m, at, packed in zip(*(words.column(c) for c in ("n", "at", "tokens"))):
            m = m.as_py()
            both = large(packed.as_py())
            where.append(np.cumsum(large(at.as_py()), dtype=np.int64))
            lengths[where[-1]] = both[:m]
            parts.append(both[m:])
        flat, order = np.concatenate(parts), np.concatenate(where)
        starts = np.zeros(n, np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        places = large(data.as_py())
        at = 0
        for ident, count in zip(ids.as_py(), counts.as_py()):
            got = flat[gather(starts, lengths, places[at : at + count])[0]]
            at += count
            yield ident, got, b"".join([pieces[t] for t in got.tolist()])


def _assemble(path: str):
    """A block's positions and the ids of its words: token ids of each of its rows, and their bytes."""
    schema = pa.schema([("ident", pa.int64()), ("tokens", pa.binary()), ("decoded", pa.binary())])

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        rows = [(i, t.astype("<u4").tobytes(), d) for i, t, d in _placed(ranks(path), texts, words)]
        return pa.Table.from_pydict(dict(zip(schema.names, zip(*rows) if rows else ([], [], []))), schema=schema)

    return run, "ident long, tokens binary, decoded binary"


def _digests(path: str):
    """As _assemble, but only what a comparison needs is held."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        rows = [(i, len(t), hashlib.sha256(t.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(d).hexdigest()) for i, t, d in _placed(ranks(path), texts, words)]
        return pa.Table.from_pydict(dict(zip(schema.names, zip(*rows) if rows else ([], [], [], []))), schema=schema)

    return run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, ident: str = "doc_id", text: str = "text", digests: bool = False, block: int = BLOCK) -> DataFrame:
    """(ident, tokens, decoded) of every row of docs, or with digests (doc_id, n_tokens, ids_sha256, decoded_sha256).

    tokens are little-endian unsigned 32-bit ids, decoded the bytes that they stand for. Null text is
    empty and gives no tokens; null and repeated identifiers, and repeated rows, give a row each; a text of any
    length is taken whole; other columns are not read; an empty table gives an empty table. Special tokens in a
    text are ordinary text.
    """
    spark = docs.sparkSession
    scratch, deals = Scratch(spark, "bpe"), 4 * width(spark)
    run, kind = _blocks(pattern, deals, block)
    # In buckets of their block: the positions, most of the bytes, stay where they are written.
    blocks = scratch.bucketed("blocks", docs.select(F.col(ident).cast("long"), F.col(text).cast("string")).mapInArrow(lean(run), kind), width(spark), "block")
    words = blocks.filter("deal >= 0").select("block", "deal", "n", "data", "at")
    run, kind = _encode(vocabulary, pattern)
    ids = words.groupBy("deal").applyInArrow(run, kind)
    texts = blocks.filter("deal < 0").select("block", "ids", "counts", "n", "data")
    run, kind = (_digests if digests else _assemble)(vocabulary)
    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(run, kind)


def decode(tokens: DataFrame, vocabulary: str, *, ident: str = "ident", column: str = "tokens") -> DataFrame:
    """(ident, decoded) for rows of packed ids; null ids give null. An id outside the vocabulary is an error."""
    schema = pa.schema([("ident", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {rank: piece for piece, rank in ranks(vocabulary).items()}
        for batch in batches:
            out = [None if x is None else b"".join([pieces[t] for t in np.frombuffer(x, "<u4").tolist()]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.binary())], schema=schema)

    return tokens.select(F.col(ident).cast("long"), column).mapInArrow(lean(run), "ident long, decoded binary")


def op10_bpe(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
