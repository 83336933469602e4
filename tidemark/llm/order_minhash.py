"""Document fingerprints by order MinHash. DataFrame functions only.

A text is cut into pieces, and every K pieces in a row are a k-mer. A run without white space of at most PIECE
code points is a piece; in a longer one (a script without spaces, encoded data) each PIECE code points in a
row are one, from every place on, so that an inserted character changes the pieces over it and moves the
others without changing them. K-mers are numbered by occurrence, so that the second mention of one is another item
than the first. Items hash into SLOTS slots; a slot keeps the PICK items of smallest hash, puts them back
into the order they have in the text, and hashes that tuple. Two texts share a slot only if they agree in
the items and in their order, which ties likeness to edit distance rather than to sets of k-mers.

One hash per item serves all slots (its leading bits choose the slot), so the work is a constant number
of passes over the k-mers: each pass is a higher-order function over one array of longs, in which the
upper 33 bits are a hash and the lower 31 the place in the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch, width

K, SLOT_BITS, PICK, PIECE = 3, 5, 2, 12


def pieces_of(piece: int) -> str:
    """Group 1 of each match is a piece: a whole short run, or from each place of a longer one."""
    return rf"(?=(\S{{1,{piece}}}))(?:(?<!\S)\S{{1,{piece}}}(?!\S)|\S(?=\S{{{piece - 1}}}))"


PLACE = (1 << 31) - 1


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _hash_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~PLACE))


def _place_of(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PLACE))


def _starts(items: Column, n: Column, mark: Callable[[Column], Column]) -> Column:
    """Indices at which the mark of sorted items changes."""
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (mark(F.get(items, i)) != mark(F.get(items, i - 1))))


def _over_runs(items: Column, n: Column, mark: Callable[[Column], Column], body: Callable[[Column, Column], Column]) -> Column:
    """body(first, last) of each run of items with one mark."""
    return let(_starts(items, n, mark), lambda s: F.transform(s, lambda a, j: body(a, F.coalesce(F.get(s, j + 1), n) - 1)))


def signature(text: Column, k: int = K, slot_bits: int = SLOT_BITS, pick: int = PICK, piece: int = PIECE) -> Column:
    """The slots of a text in their order, as array<int>: empty for a text without pieces."""
    none = F.array().cast("array<int>")
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pieces_of(piece)), 1)

    def kmers(p: Column) -> Column:
        at = lambda i: F.xxhash64(*(F.get(p, i + j) for j in range(k)))
        return F.when(F.size(p) >= k, F.transform(F.sequence(F.lit(0), F.size(p) - k), at)).otherwise(F.array(F.xxhash64(F.array_join(p, " "))))

    def numbered(s: Column) -> Column:
        item = lambda i, a: _hash_of(F.xxhash64(_hash_of(F.get(s, i)), i - a)).bitwiseOR(_place_of(F.get(s, i)))
        return F.flatten(_over_runs(s, F.size(s), _hash_of, lambda a, b: F.transform(F.sequence(a, b), lambda i: item(i, a))))

    def slots(g: Column) -> Column:
        slot = lambda x: F.shiftright(x, 64 - slot_bits)

        def tuple_hash(a: Column, b: Column) -> Column:
            chosen = F.slice(g, a + 1, F.least(b - a + 1, F.lit(pick)))
            ordered = F.sort_array(F.transform(chosen, lambda x: F.shiftleft(_place_of(x), 32).bitwiseOR(F.shiftrightunsigned(x, 32))))
            seed = slot(F.get(g, a)).cast("long")
            return F.aggregate(ordered, seed, lambda acc, x: F.xxhash64(acc, x.bitwiseAND(F.lit((1 << 32) - 1)))).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")

        return _over_runs(g, F.size(g), slot, tuple_hash)

    def whole(p: Column) -> Column:
        placed = F.transform(kmers(p), lambda h, i: _hash_of(h).bitwiseOR(i.cast("long")))
        return let(F.sort_array(placed), lambda s: let(F.sort_array(numbered(s)), slots))

    return let(pieces, lambda p: F.when(F.size(p) > 0, whole(p)).otherwise(none))


def as_string(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared slots of the slots that the fuller of both has: 1 for equal signatures, 0 for nothing shared."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def successors(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(kd, th, nd, nt): each distinct key with the next in order, the last with the first.

    Keys are dealt by range, put in order within each range, and the ranges joined by their first keys:
    one row a range, the only rows that meet in one task.
    """
    n = width(keys.sparkSession)
    dealt = scratch.table("keys", keys.repartitionByRange(n, "kd", "th").withColumn("part", F.spark_partition_id()))
    firsts = dealt.groupBy("part").agg(F.min(F.struct("kd", "th")).alias("first"))
    everywhere = Window.orderBy("part")  # one row a range
    firsts = firsts.withColumn("after", F.coalesce(F.lead("first").over(everywhere), F.min("first").over(Window.partitionBy()))).drop("first")
    inner = dealt.withColumn("next", F.lead(F.struct("kd", "th")).over(Window.partitionBy("part").orderBy("kd", "th")))
    # At most n rows.
    joined = inner.join(F.broadcast(firsts), "part").withColumn("next", F.coalesce("next", "after"))
    return joined.select("kd", "th", "n_chars", F.col("next.kd").alias("nd"), F.col("next.th").alias("nt"))


def fingerprints(docs: DataFrame, *, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by as many (or all) from the
    start of the next document by identifier; after the last comes the first. Null text is empty. A null
    identifier comes before all others. Rows with equal identifiers follow each other by a hash of their
    texts; rows equal in both count as one document, and each of them is returned. A text without pieces
    has an empty fingerprint, which is like only another such. Texts of any length are taken whole. Other
    columns are not read; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    d = docs.select(F.col(ident).cast("long").alias("doc_id"), body.alias("text"))
    d = d.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("kd"), F.xxhash64("text", F.col("doc_id").isNull()).alias("th"), "text")
    # Dealt once by key and kept so: neither of the two joins by key shuffles the texts again.
    n = width(docs.sparkSession)
    d = scratch.bucketed("texts", d.repartition(n, "kd", "th"), n, "kd", "th")
    keys = d.groupBy("kd", "th").agg(F.max(F.char_length("text")).alias("n_chars"))
    follow = scratch.table("follow", successors(keys, scratch))
    # From each document the part that the one before it takes over, sent to that one.
    asked = follow.select(F.col("nd").alias("kd"), F.col("nt").alias("th"), F.col("kd").alias("to_d"), F.col("th").alias("to_t"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    heads = d.join(asked, ["kd", "th"]).select(F.col("to_d").alias("kd"), F.col("to_t").alias("th"), F.substring(F.col("text"), F.lit(1), F.col("half")).alias("head"))
    heads = heads.groupBy("kd", "th").agg(F.max("head").alias("head"))
    e = d.join(heads, ["kd", "th"]).withColumn("n_chars", F.char_length("text"))
    e = e.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - F.floor(F.col("n_chars") / 2).cast("int")), F.col("head")))
    made = scratch.table("made", e.select("doc_id", "kd", "th", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signature(F.col("text")).alias("own"), signature(F.col("edited")).alias("changed")))
    following = made.groupBy("kd", "th").agg(F.first("own").alias("next")).withColumnsRenamed({"kd": "nd", "th": "nt"})
    out = made.join(follow.drop("n_chars"), ["kd", "th"]).join(following, ["nd", "nt"])
    return out.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("own")).alias("fingerprint"), as_string(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


def op8_document_fingerprints(spark, sf_dir):
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
