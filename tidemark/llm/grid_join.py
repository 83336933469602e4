"""Near-duplicate embeddings by an epsilon grid order join.

Vectors of unit length are within eps = sqrt(2 - 2 * cosine) of each other if their cosine is large
enough, and so are their projections on any orthonormal axes. Vectors are sorted by the cells of a grid
of width eps on the leading principal axes, cut into blocks of the sequence, and joined by recursion over
intervals of it: all of a label's sequence with itself, then ranges, then groups of blocks, then blocks.
A pair of intervals goes down only while the boxes around their projections are within eps. What is left
is compared in full, in double precision.

Equal vectors are one class with a count. A pair of blocks says for each class how many vectors it links
to, and names a star of links for each connected part, so its output is linear in the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.scratch import Scratch, lean, width

#: Axes of the grid, vectors in a block, blocks in a group, and vectors that the axes are fitted on.
AXES, BLOCK, GROUP, FIT = 4, 512, 16, 4096
#: Slack of box distances for rounding: far above it, and far below any distance that matters.
SLACK = 1e-9


def axes(classes: DataFrame, dims: int) -> np.ndarray:
    """Leading principal axes of a bounded sample. They steer the order, not what is found."""
    some = classes.filter(F.size("gj_vector") == dims).orderBy("gj_node").limit(FIT).select("gj_vector").toArrow()
    x = np.array([v.as_py() for v in some.column(0)], float).reshape(-1, dims)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x - x.mean(0)
    _, vectors = np.linalg.eigh(x.T @ x)
    return vectors[:, ::-1][:, :AXES].T


def stars(linked: np.ndarray) -> list[tuple[int, int]]:
    """(member, root) for the connected parts of a symmetric boolean matrix, without lone nodes."""
    out, open_ = [], linked.any(1)
    while open_.any():
        root = int(np.argmax(open_))
        seen = np.zeros(len(linked), bool)
        front = seen.copy()
        front[root] = True
        while front.any():
            seen |= front
            front = linked[front].any(0) & ~seen
        open_ &= ~seen
        out += [(int(k), root) for k in np.flatnonzero(seen) if k != root]
    return out


def _near(a: str, b: str, eps: float) -> Column:
    """Are the boxes of a and b within eps?"""
    gap = lambda k: F.greatest(F.col(f"{a}_lo")[k] - F.col(f"{b}_hi")[k], F.col(f"{b}_lo")[k] - F.col(f"{a}_hi")[k], F.lit(0.0))
    return sum((gap(k) * gap(k) for k in range(AXES)), F.lit(0.0)) <= F.lit(eps * eps + SLACK)


def _blocks(kind: str):
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("key", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("nodes", pa.binary()), ("counts", pa.binary()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, key = TaskContext.get().partitionId(), 0, None
        rows: list = []

        def flush() -> pa.RecordBatch:
            places = np.array([x[2] for x in rows])
            return pa.RecordBatch.from_pydict({"part": [part], "block": [number], "key": [key], "lo": [places.min(0)], "hi": [places.max(0)], "nodes": [np.array([x[0] for x in rows], "<i8").tobytes()], "counts": [np.array([x[1] for x in rows], "<i8").tobytes()], "vectors": [np.array([x[3] for x in rows], kind).tobytes()]}, schema=schema)

        for batch in batches:
            for x in zip(*(batch.column(c).to_pylist() for c in ("gj_node", "gj_n", "gj_place", "gj_vector", "gj_key"))):
                if rows and (x[4] != key or len(rows) == BLOCK):
                    yield flush()
                    rows, number = [], number + 1
                key = x[4]
                rows.append(x)
        if rows:
            yield flush()

    return run, "part long, block long, key long, lo array<double>, hi array<double>, nodes binary, counts binary, vectors binary"


def _pairs(cosine: float, kind: str):
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                nodes = [np.frombuffer(x[f"{s}_nodes"], "<i8") for s in "ab"]
                counts = [np.frombuffer(x[f"{s}_counts"], "<i8") for s in "ab"]
                a, b = (np.frombuffer(x[f"{s}_vectors"], kind).astype(float).reshape(len(n), -1) for s, n in zip("ab", nodes))
                near = a @ b.T / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))) >= cosine
                if x["same"]:
                    np.fill_diagonal(near, False)
                    ids, links = nodes[0], near @ counts[0]
                    full = near
                else:
                    ids, links = np.concatenate(nodes), np.concatenate([near @ counts[1], near.T @ counts[0]])
                    full = np.zeros((len(ids), len(ids)), bool)
                    full[: len(a), len(a) :] = near
                    full[len(a) :, : len(a)] = near.T
                got = stars(full | full.T if x["same"] else full)
                has = np.flatnonzero(links)
                if len(has):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[has], ids[[m for m, _ in got]]])), pa.array([None] * len(has) + [int(ids[r]) for _, r in got], pa.int64()), pa.array(np.concatenate([links[has], np.zeros(len(got), np.int64)]))], schema=schema)

    return run, "node long, other long, links long"


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, *, ident: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors.

    Only rows of equal, non-null label and equal length of vector are compared. A vector that is null,
    empty, zero, or holds null or non-finite components links with nothing. Rows with one identifier are
    vectors of their own; a component is named by its smallest identifier. A null identifier is never
    the smallest; a component of none but null identifiers is named null and its rows are kept. Equal
    vectors are one class under a 64-bit hash. Other columns are not read; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    scratch, n = Scratch(spark, "grid"), width(spark)
    # What was given as floats is floats again in the blocks: half the bytes, and the same numbers.
    stored = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    body = F.col(vector).cast("array<double>")
    most = F.aggregate(body, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    finite = F.forall(body, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(F.col(label).isNotNull() & (F.size(body) > 0) & finite & (most > 0), F.lit(False))
    if stored == "<f8":
        # Squares of doubles may leave the range; such a vector is taken at a length that keeps them.
        body = F.when((most > 1e-140) & (most < 1e140), body).otherwise(F.transform(body, lambda v: v / most))
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.when(good, F.xxhash64(F.col(label), F.size(body), body)).alias("gj_node"), F.when(good, F.xxhash64(F.col(label), F.size(body))).alias("gj_key"), F.when(good, body).alias("gj_vector"))
    classes = rows.filter("gj_node IS NOT NULL").groupBy("gj_key", "gj_node", "gj_vector").agg(F.min("vec_id").alias("gj_least"), F.count(F.lit(1)).alias("gj_n"))
    classes = scratch.table("classes", classes)
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    ordered = None
    for dims in sorted(x[0] for x in classes.select(F.size("gj_vector")).distinct().collect()):  # one for each length of vector, not each vector
        main = axes(classes, dims)
        some = classes.filter(F.size("gj_vector") == dims)
        length = F.sqrt(F.aggregate("gj_vector", F.lit(0.0), lambda a, v: a + v * v))
        along = [F.aggregate(F.zip_with("gj_vector", F.lit(axis.tolist()), lambda u, v: u * v), F.lit(0.0), lambda a, v: a + v) / length for axis in main]
        along += [F.lit(0.0)] * (AXES - len(along))
        some = some.withColumn("gj_place", F.array(*along))
        ordered = some if ordered is None else ordered.unionByName(some)
    if ordered is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    order = ["gj_key", *(f"gj_c{k}" for k in range(AXES)), "gj_p", "gj_node"]
    ordered = ordered.withColumns({f"gj_c{k}": F.floor(F.col("gj_place")[k] / eps) if eps else F.col("gj_place")[k] for k in range(AXES)} | {"gj_p": F.col("gj_place")[0]})
    ordered = ordered.repartitionByRange(n, *order).sortWithinPartitions(*order)
    run, kind = _blocks(stored)
    blocks = scratch.table("blocks", ordered.select("gj_node", "gj_n", "gj_place", "gj_vector", "gj_key").mapInArrow(lean(run), kind))
    boxes = blocks.select("key", "part", F.floor(F.col("block") / GROUP).alias("group"), "block", "lo", "hi")
    box = lambda by: boxes.groupBy(*by).agg(*(F.array(*(f(F.col(c)[k]) for k in range(AXES))).alias(c) for c, f in (("lo", F.min), ("hi", F.max))))
    levels = [["key", "part"], ["key", "part", "group"], ["key", "part", "group", "block"]]
    pairs = None
    for by in levels:
        nodes = scratch.table(f"level{len(by)}", box(by))
        a, b = (nodes.select(*(F.col(c).alias(f"{s}_{c}") for c in (*by, "lo", "hi"))) for s in "ab")
        if pairs is None:
            pairs = a.join(b, F.col("a_key") == F.col("b_key"))
        else:
            for s, side in (("a", a), ("b", b)):
                pairs = pairs.join(side, [F.col(f"up_{s}_{c}") == F.col(f"{s}_{c}") for c in by[:-1]])
        ids = [[F.col(f"{s}_{c}") for c in by[1:]] for s in "ab"]
        pairs = pairs.filter((F.struct(*ids[0]) <= F.struct(*(c.alias(f"a_{n}") for c, n in zip(ids[1], by[1:])))) & _near("a", "b", eps))
        pairs = scratch.table(f"pairs{len(by)}", pairs.select(*(F.col(f"{s}_{c}").alias(f"up_{s}_{c}") for s in "ab" for c in by)))
    pairs = pairs.select(*(F.col(f"up_{s}_{c}").alias(f"{s}_{c}") for s in "ab" for c in ("part", "block"))).withColumn("same", (F.col("a_part") == F.col("b_part")) & (F.col("a_block") == F.col("b_block")))
    for s in "ab":
        side = blocks.select(F.col("part").alias(f"{s}_part"), F.col("block").alias(f"{s}_block"), *(F.col(c).alias(f"{s}_{c}") for c in ("nodes", "counts", "vectors")))
        pairs = pairs.join(side, [f"{s}_part", f"{s}_block"])
    run, kind = _pairs(cosine, stored)
    found = scratch.table("found", pairs.mapInArrow(lean(run), kind))
    links = found.filter("other IS NULL").groupBy(F.col("node").alias("gj_node")).agg(F.sum("links").alias("gj_links"))
    joined = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), scratch)
    known = classes.select("gj_node", "gj_least", "gj_n").join(links, "gj_node", "left").join(joined.select(F.col("node").alias("gj_node"), F.col("component")), "gj_node", "left")
    known = scratch.table("known", known.withColumn("component", F.coalesce("component", "gj_node")))
    named = known.groupBy("component").agg(F.min("gj_least").alias("component_id"))
    known = scratch.table("named", known.join(named, "component").select("gj_node", "component_id", (F.coalesce("gj_links", F.lit(0)) + F.col("gj_n") - 1).alias("gj_links")))
    lone = rows.filter("gj_node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.filter("gj_node IS NOT NULL").select("vec_id", "gj_node").join(known, "gj_node").select("vec_id", F.col("gj_links").alias("n_links"), "component_id").unionByName(lone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND a.r <> b.r AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.93),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT reach.a, min(o.vec_id) AS component_id FROM reach JOIN v o ON reach.b = o.r GROUP BY reach.a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least ON v.r = least.a LEFT JOIN degree ON v.r = degree.a
"""
