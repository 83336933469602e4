"""Rows of a wide table that may have a partner in a narrow one, told before they are shuffled.

The narrow table's keys are written to the shared folder. A worker reads them once and marks each in a bitmap, in
two places. A row whose places are not both marked has no partner; the others go on to an exact join. The
bitmap has at most MOST bits, whatever the table: one that fills up lets more rows pass and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import files
from tidemark.llm.scratch import Scratch, lean
from tidemark.llm.shingles import mix

#: Bits for a key, and in a bitmap at most (16 MB).
EACH, MOST = 16, 1 << 27


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    spread = mix(keys.view(np.uint64))
    return tuple((v & np.uint64(bits - 1)).astype(np.int64) for v in (spread, spread >> np.uint64(32)))


def _mark(marks: np.ndarray, keys: np.ndarray) -> None:
    for at in _places(keys, 8 * len(marks)):
        np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, other = (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1 for at in _places(keys, 8 * len(marks)))
    return (one & other).astype(bool)


@lru_cache(maxsize=1)
def _marks(path: str) -> np.ndarray:
    """The bitmap of the keys in a folder, once in a worker's life."""
    where, name = files.at(path)
    names = sorted(f.path for f in where.get_file_info(fs.FileSelector(name)) if f.path.endswith(".parquet"))
    rows, bits = 0, 1 << 10
    for f in names:
        with where.open_input_file(f) as file:
            rows += pq.read_metadata(file).num_rows
    while bits < min(MOST, EACH * rows):
        bits *= 2
    marks = np.zeros(bits // 8, np.uint8)
    for f in names:
        with where.open_input_file(f) as file:
            for batch in pq.ParquetFile(file).iter_batches(columns=["key"]):
                _mark(marks, batch.column(0).to_numpy())
    return marks


class Sieve:
    """The keys of a narrow table, written under a name."""

    def __init__(self, scratch: Scratch, name: str, keys: DataFrame, key: Column):
        scratch.table(name, keys.select(key.alias("key")))
        self.path = scratch.path(name)

    def __call__(self, df: DataFrame, key: Column, marked: bool = True) -> DataFrame:
        """The rows of df that may have a partner, or those that have none for certain. key is a long, never null."""
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                has = _marked(_marks(path), batch.column(batch.num_columns - 1).to_numpy())
                kept = pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])
                yield kept.filter(pa.array(has if marked else ~has))

        return df.select("*", key.alias("sieve_key")).mapInArrow(lean(run), df.schema)
