"""Token counts of flat, unindexed token files.

A token file is nothing but ids of a fixed width, one document after the other, each ended by the
end-of-document identifier. It is read in byte blocks that know nothing of documents; each block is
searched for the identifier with one vectorised comparison and says how long its head (up to its
first separator) and tail (after its last) are and how many tokens lie between separators. A prefix
scan over the blocks of a file then gives each block the number of documents that ended before it and
the tokens that earlier blocks left open, which go to the document its head ends. The scan sees two numbers
a block and has two levels (within stretches of RUN blocks, then over stretches), so that one file of any
size is many tasks' work.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe, files
from tidemark.llm.scratch import Scratch, lean, width

#: Bytes of one block of a scan, and of one file that the writer fills; blocks in a stretch.
BLOCK, FILE, RUN = 4 << 20, 64 << 20, 1024


def lengths(ids: np.ndarray, end: int) -> tuple[int, np.ndarray, int]:
    """Head (all ids if no document ends here), tokens of the documents between two ends, tail."""
    at = np.flatnonzero(ids == end)
    if not len(at):
        return len(ids), np.empty(0, np.int64), 0
    return int(at[0]), np.diff(at) - 1, len(ids) - 1 - int(at[-1])


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, pattern: str, end: int, *, ident: str = "doc_id", text: str = "text", kind: str = "<u2", most: int = FILE) -> DataFrame:
    """Flat files of docs' ids in folder; returns (path, bytes, ids): ids names a file's documents in order.

    Must be materialized before it is used: each run writes files. Null and empty texts are documents of no
    tokens; texts are taken whole. Null and repeated identifiers, and repeated rows, each have their place in
    ids. Other columns are not read; an empty table writes no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(vocabulary, pattern).encode_ordinary
        held, size, idents = [], 0, []

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.tokens"
            files.write(path, b"".join(held))
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "ids": [idents]}, schema=schema)

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append(np.array([*encode(content.as_py() or ""), end], kind).tobytes())
                idents.append(name)
                size += len(held[-1])
                if size >= most:
                    yield flush()
                    held, size, idents = [], 0, []
        if held:
            yield flush()

    schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("ids", pa.list_(pa.int64()))])
    return docs.select(F.col(ident).cast("long"), F.col(text).cast("string")).mapInArrow(lean(run), "path string, bytes long, ids array<long>")


def scanned(blocks: DataFrame, run: int = RUN) -> DataFrame:
    """(path, block, first, carry) for blocks (path, block, ends, open): documents that ended in earlier blocks
    of the file, and tokens that they left open."""
    slim = blocks.withColumn("stretch", F.floor(F.col("block") / run))
    inside = Window.partitionBy("path", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    slim = slim.withColumns({"first": zero(F.sum("ends").over(inside)), "sum": zero(F.sum("open").over(inside))})
    # Where a document last ended in the stretch, by tokens from the stretch's start; null where none did.
    ended = F.when(F.col("ends") > 0, F.col("sum"))
    slim = slim.withColumn("since", F.max(ended).over(inside))
    whole = slim.groupBy("path", "stretch").agg(F.sum("ends").alias("ends"), F.sum("open").alias("open"), F.max(ended).alias("last"))
    whole = whole.withColumns({"first0": zero(F.sum("ends").over(over)), "sum0": zero(F.sum("open").over(over))})
    whole = whole.withColumn("since0", zero(F.max(F.col("sum0") + F.col("last")).over(over)))
    out = slim.join(whole.select("path", "stretch", "first0", "sum0", "since0"), ["path", "stretch"])
    since = F.coalesce(F.col("sum0") + F.col("since"), F.col("since0"))
    return out.select("path", "block", (F.col("first0") + F.col("first")).alias("first"), (F.col("sum0") + F.col("sum") - since).alias("carry"))


def count_tokens(paths: DataFrame, end: int, *, kind: str = "<u2", block: int = BLOCK, run: int = RUN) -> DataFrame:
    """(path, place, n_tokens, ended) of every document in the files that paths (path, bytes) names.

    place counts from 0 within the file; the separator is not a token of the document. Ids after a
    file's last separator are a document with ended false; an empty file has no documents, an empty table no
    rows. Null paths are skipped; a path counts once, however often it is named. A file whose bytes are no
    multiple of the width is an error. Other columns are not read.
    """
    step = np.dtype(kind).itemsize
    block -= block % step
    scratch = Scratch(paths.sparkSession, "scan")
    starts = paths.select("path", "bytes").filter("path IS NOT NULL AND bytes > 0").distinct()
    last = F.floor((F.col("bytes") - 1) / F.lit(block)).cast("long")
    starts = starts.select("path", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, k, final in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "last"))):
                read = files.Ranges(path)
                if read.size % step:
                    raise ValueError(f"{path} is not a whole number of {step}-byte ids")
                ids = np.frombuffer(read(k * block, block), kind)
                read.close()
                head, inner, tail = lengths(ids, end)
                ends = int(np.count_nonzero(ids == end)) if len(inner) == 0 else len(inner) + 1
                # What a block leaves open: its tail, or all of it where no document ends in it.
                yield pa.RecordBatch.from_pydict({"path": [path], "block": [k], "last": [k == final], "ends": [ends], "head": [head], "inner": [inner], "tail": [tail], "open": [tail if ends else head]}, schema=schema)

    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("last", pa.bool_()), ("ends", pa.int64()), ("head", pa.int64()), ("inner", pa.list_(pa.int64())), ("tail", pa.int64()), ("open", pa.int64())])
    blocks = starts.repartition(width(paths.sparkSession), "path", "block").mapInArrow(lean(look), "path string, block long, last boolean, ends long, head long, inner array<long>, tail long, open long")
    blocks = scratch.table("blocks", blocks)
    blocks = blocks.join(scanned(blocks.select("path", "block", "ends", "open"), run), ["path", "block"])
    ended = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("head"))
    rows = F.concat(F.transform(ended, lambda n: F.struct(n.alias("n"), F.lit(True).alias("e"))), F.when(F.col("last") & (rest > 0), F.array(F.struct(rest.alias("n"), F.lit(False).alias("e")))).otherwise(F.array().cast("array<struct<n:bigint,e:boolean>>")))
    return blocks.select("path", "first", F.posexplode(rows).alias("k", "x")).select("path", (F.col("first") + F.col("k")).alias("place"), F.col("x.n").alias("n_tokens"), F.col("x.e").alias("ended"))


#: Vocabulary of the query, and the free id after it that ends a document.
VOCABULARY, END = "byte_bpe_multi_50k.tiktoken", 50256


def op3_token_counts(spark, sf_dir):
    """(doc_id, n_tokens) of all documents, counted from flat token files written of them."""
    import public_tokenizers

    scratch = Scratch(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = scratch.table("manifest", write_token_files(docs, scratch.path("files"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, END))
    named = written.select("path", F.posexplode("ids").alias("place", "doc_id"))
    counted = count_tokens(written.select("path", "bytes"), END)
    # The manifest is small only while its lists are: once a row a document it must not be broadcast.
    return counted.join(named.hint("merge"), (counted.path == named.path) & (counted.place == named.place)).select("doc_id", "n_tokens")
