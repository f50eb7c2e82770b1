"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors are one first, with their number. A vector gets one bucket key per table: the signs of its products
with random hyperplanes. Vectors that share a bucket are compared exactly in double precision; a pair
counts in the first table in which it meets. Buckets above a bound are cut into blocks, and each pair of blocks is a task of its own, so nothing is
left out. A task sends each vector's number of links and a forest of them, not the pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import Workspace, bound_batches
from ledgerflow.llm.components import connected_components, forest

#: Share of pairs exactly at the threshold that all tables together may miss.
MISS = 0.02
#: Vectors a bucket holds on average when unlike vectors spread evenly, and members of a block. A bucket is one matrix product, so
#: some hundred vectors cost little more than a few, and each halving of buckets saves a bit, and so tables and shuffled vectors.
PER_BUCKET, BLOCK = 256, 2048
#: Bits of a bucket's number that hold the key; the table is above them.
_KEY_BITS = 48


def plan_tables(n: int, threshold: float, miss: float = MISS) -> tuple[int, int]:
    """(bits per key, tables): bits grow with the logarithm of n, tables follow from the miss rate."""
    bits = max(6, math.ceil(math.log2(max(n, 2) / PER_BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


@functools.lru_cache(maxsize=4)
def _planes(width: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width]).standard_normal((width, n))


def _keys(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Bucket keys, one column per table."""
    signs = (x @ _planes(x.shape[1], bits * tables, seed) > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, which Spark moves as one block: single precision where that is exact, else double."""
    for batch in batches:
        lists = batch.column("v")
        edge = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            short = flat.astype("<f4")
        bad = np.concatenate([[0], np.cumsum(short != flat)])
        raw = [(flat if bad[b] > bad[a] else short)[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), pa.array(np.diff(edge).astype(np.int32)), pa.array(raw, pa.binary())], names=["id", "copies", "width", "raw"])


def _unpack(raw: pa.Array, width: int) -> np.ndarray:
    """Packed vectors of one width, as rows in double precision."""
    size = pc.binary_length(raw).to_numpy()
    out = np.empty((len(raw), width))
    for kind, each in (("<f4", 4), ("<f8", 8)):
        some = size == each * width
        if some.any():
            out[some] = np.frombuffer(b"".join(raw.filter(pa.array(some)).to_pylist()), kind).reshape(-1, width)
    return out


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, miss: float = MISS, seed: int = 11) -> DataFrame:
    """One row per vector: id, n_links (other vectors with cosine >= threshold), component (smallest id that links reach).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of unlike lengths don't link.
    Rows that repeat an id are vectors of their own; a null id links like any other but never names a component.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    work = Workspace(spark, "vector-dedup")
    read = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0), F.lit(False))
    named = work.save(read.select("id", F.when(fine, F.col("v")).alias("v")).withColumns({"h0": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "h1": F.xxhash64(F.lit(1), "v")}), "vectors")
    reps = named.where("v is not null").groupBy("h0", "h1").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")).where("id is not null")
    reps = work.save(reps, "distinct")
    packed = work.save(reps.select("id", "copies", "v").mapInArrow(_pack, "id long, copies long, width int, raw binary"), "packed", **{"parquet.enable.dictionary": "false"})
    bits, tables = plan_tables(reps.count(), threshold, miss)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            widths = whole.column("width").to_numpy()
            for width in np.unique(widths):
                batch = whole.filter(pa.array(widths == width))
                k = _keys(_unpack(batch.column("raw"), int(width)), bits, tables, seed)
                own = np.arange(tables, dtype=np.int64) << _KEY_BITS
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), tables)), pa.array(np.full(k.size, width, np.int32)), pa.array((k | own).ravel())], names=["id", "width", "bucket"])

    posts = work.save(packed.select("id", "width", "raw").mapInArrow(keys, "id long, width int, bucket long"), "buckets")
    sizes = posts.groupBy("width", "bucket").count().where("count > 1").select("width", "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("k"))
    dealt = posts.join(sizes, ["width", "bucket"]).withColumn("own", F.pmod(F.xxhash64("id", "bucket"), F.col("k")).cast("int"))
    dealt = dealt.select("id", "width", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    dealt = dealt.select("id", "width", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("late"))
    single = packed.select(F.col("id").alias("vid"), "copies", "raw")
    carried = dealt.join(single, F.col("id") == F.col("vid")).select("width", "bucket", "i", "j", "late", "id", "copies", "raw")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch | None:
            table = pa.Table.from_batches(held)
            if len(table) < 2:
                return None
            ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
            x = _unpack(table.column("raw").combine_chunks(), key[0])
            late = table.column("late").to_numpy(zero_copy_only=False)
            raw = x
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            #: The two sides of a pair of blocks; a block alone is both.
            one = key[2] == key[3]
            left, right = (np.arange(len(x)),) * 2 if one else (np.flatnonzero(~late), np.flatnonzero(late))
            links, a_all, b_all = np.zeros(len(x), np.int64), [], []
            for s in range(0, len(left), 512):
                begin = s if one else 0
                a, b = np.nonzero(x[left[s : s + 512]] @ x[right[begin:]].T >= threshold)
                if one:
                    fit = a < b
                    a, b = a[fit], b[fit]
                if not len(a):
                    continue
                a, b = left[a + s], right[b + begin]
                a_all.append(a)
                b_all.append(b)
                #: Keys of the tables before this one, of the vectors in pairs only.
                some, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                k = _keys(raw[some], bits, tables, seed)[:, : key[1] >> _KEY_BITS]
                new = ~(k[at[: len(a)]] == k[at[len(a) :]]).any(axis=1)
                np.add.at(links, a[new], copies[b[new]])
                np.add.at(links, b[new], copies[a[new]])
            if not a_all:
                return None
            a, b = np.concatenate(a_all), np.concatenate(b_all)
            root = np.array(ids)
            p, q = forest(ids[a], ids[b])
            order = np.argsort(ids)
            root[order[np.searchsorted(ids, p, sorter=order)]] = q
            some = (links > 0) | (root != ids)
            return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])], names=["id", "links", "root"])

        for batch in batches:
            codes = list(zip(*(batch.column(c).to_pylist() for c in ("width", "bucket", "i", "j")), strict=True))
            start = 0
            for r in range(1, len(codes) + 1):
                if r == len(codes) or codes[r] != codes[start]:
                    if codes[start] != key:
                        if held and (ready := out()) is not None:
                            yield ready
                        key, held = codes[start], []
                    held.append(batch.slice(start, r - start))
                    start = r
        if held and (ready := out()) is not None:
            yield ready

    found = carried.repartition("bucket", "i", "j", "width").sortWithinPartitions("bucket", "i", "j", "width").mapInArrow(compare, "id long, links long, root long")
    found = work.save(found, "found")
    comps = connected_components(work, found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("id").agg(F.sum("links").alias("links"))
    per = reps.select("h0", "h1", "id", "copies").join(degree, "id", "left").join(comps, F.col("id") == F.col("node"), "left")
    per = per.select("h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    return named.select("id", "h0", "h1").join(per, ["h0", "h1"], "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component"))
