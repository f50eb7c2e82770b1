"""Quality scores by Bradley-Terry pairwise ranking.

A document is a vector of features of its whole text: twelve ratios of characters, words and repeats, and the shares of its words and word pairs by
hash bucket. Training draws pairs of a better and a worse labelled document and fits weights by the
logistic loss on the difference of their features, so that the better one of a pair gets the larger score. The cut between
good and bad is a quantile of the training scores: the share of bad labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ledgerflow.llm.common import by_bytes, id_text, mix, spread, string_buffer
from ledgerflow.llm.ngram_join import word_hashes

#: Labelled rows that training uses at most (of all tasks together, chosen by a hash of the id), and pairs drawn from them.
TRAIN_ROWS, TRAIN_PAIRS = 20_000, 60_000
#: Predicted good from this score on (fixed by the contract).
CUT = 0.3

_KIND = np.zeros(256, np.uint8)
_KIND[0x41:0x5B] = 1  # upper case
_KIND[0x61:0x7B] = 2  # lower case
_KIND[0x30:0x3A] = 3
_KIND[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in ".,;:"]] = 6
_KIND[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = 7
_KIND[0x80:] = 8
#: Buckets that words, and pairs of words, are hashed to (a power of two), and all features.
BUCKETS = 64
N_FEATURES = 12 + 2 * BUCKETS
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def features(column: pa.Array) -> np.ndarray:
    """One row of features, each between 0 and about 1, for every text."""
    n = len(column)
    raw, ends = string_buffer(column)
    length = np.maximum(np.diff(ends), 1).astype(float)
    kinds = _KIND[raw]
    counts = np.zeros((9, n))
    row = np.repeat(np.arange(n), np.diff(ends))
    for k in range(1, 9):
        counts[k] = np.bincount(row[kinds == k], minlength=n)
    words, of = word_hashes(raw, ends)
    n_words = np.bincount(of, minlength=n).astype(float)
    some = np.maximum(n_words, 1)
    same = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    again = np.bincount(of[1:][same], minlength=n)
    alternate = (words[2:] == words[:-2]) & (of[2:] == of[:-2])
    second = np.bincount(of[2:][alternate], minlength=n)
    order = np.lexsort((words, of))
    w, o = words[order], of[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[fresh], minlength=n)
    letters = np.maximum(counts[1] + counts[2] + counts[8] / 2, 1)
    root = lambda x: np.sqrt(np.minimum(x, 1))
    flat = np.stack(
        [
            np.minimum(np.log1p(n_words) / 10, 1.5),
            counts[1] / letters,
            root(counts[4] / length),
            root(counts[5] / some),
            root(again / some),
            root(second / some),
            root(counts[3] / length),
            root(counts[6] / some),
            np.minimum(np.log(some / np.maximum(distinct, 1)) / 5, 1.5),
            np.minimum((length - counts[7]) / some / 20, 2),
            root(counts[4] / some),
            (n_words == 0).astype(float),
        ],
        axis=1,
    )
    pairs, inside = mix(words[:-1] ^ mix(words[1:])), of[1:] == of[:-1]
    hashed = [np.bincount(o * BUCKETS + (h >> _SHIFT).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS) for h, o in ((words, of), (pairs[inside], of[1:][inside]))]
    return np.concatenate([flat, *(root(h / some[:, None]) for h in hashed)], axis=1)


def draw_pairs(good: np.ndarray, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(better rows, worse rows) of the training pairs."""
    rng = np.random.default_rng(seed)
    return rng.choice(np.flatnonzero(good), pairs), rng.choice(np.flatnonzero(~good), pairs)


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = TRAIN_PAIRS, ridge: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, cut): Newton's method on the Bradley-Terry loss of drawn pairs; without both labels the weights are 0."""
    if not good.any() or good.all():
        return np.zeros(x.shape[1]), 0.0
    up, down = draw_pairs(good, pairs, seed)
    d = x[up] - x[down]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    z = np.sort(x @ w)
    k = min(max(int(round((~good).mean() * len(z))), 1), len(z) - 1)
    return w, float((z[k - 1] + z[k]) / 2)


def score(x: np.ndarray, weights: np.ndarray, cut: float) -> np.ndarray:
    """Between 0 and 1; CUT at the training quantile. Without a model 0.5."""
    if not weights.any():
        return np.full(len(x), 0.5)
    return 1 / (1 + np.exp(-np.clip(x @ weights - cut + np.log(CUT / (1 - CUT)), -35, 35)))


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text is divisible by 5; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most ``rows`` labelled documents that aren't held out. Only their features (``N_FEATURES`` numbers a row) reach the driver.

    Null labels and ids are ignored; an id with several labels counts as bad if any is, and of rows that repeat an id one counts, so the bound
    holds for them too.
    """
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) >= 1).alias("good"))
    own = own.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole):
                x = features(batch.column("text"))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32)), pa.array(x.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("good"), flat], names=["id", "good", "x"])

    #: At most ``rows`` rows are broadcast.
    known = id_text(docs, id_col, text_col).join(F.broadcast(own), "id").select("id", "text", "good")
    table = known.mapInArrow(run, "id long, good boolean, x array<float>").groupBy("id").agg(F.first("good").alias("good"), F.min("x").alias("x")).toArrow().sort_by("id")
    x = table.column("x").combine_chunks().flatten().to_numpy().astype(float).reshape(-1, N_FEATURES)
    return fit_pairs(x, table.column("good").to_numpy(zero_copy_only=False).astype(bool))


def quality_scores(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with columns quality_score and quality_good (score >= CUT) behind its own.

    Null and empty texts are scored as texts without words. Rows are scored one by one, repeated or not; columns of ``docs`` pass through, and one
    named like a new column is replaced. An empty table gives an empty result.
    """
    weights, cut = model
    kept = docs.drop("quality_score", "quality_good")
    schema = StructType([*kept.schema.fields, StructField("quality_score", DoubleType()), StructField("quality_good", BooleanType())])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = pa.RecordBatch.from_arrays([pc.fill_null(whole.column(at), "")], names=["text"])
            for k, batch in enumerate(by_bytes(texts)):
                start = 0 if not k else start + size
                size = batch.num_rows
                s = score(features(batch.column("text")), weights, cut)
                part = whole.slice(start, size)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array(s >= CUT)], names=[*part.schema.names, "quality_score", "quality_good"])

    return spread(kept).mapInArrow(run, schema)
