"""Token-ID output: Parquet files with one list of ids per document, in id order, and their reader.

The files hold (part, doc_id, offset, n_tokens, ids): integer columns in version-2 pages, so lists are dictionary-
or delta-encoded, in row groups and pages of set size with page indexes, so that a reader can take single
columns, row groups or documents. ``offset`` is the place of a document's first id in its file; a file's place in the whole follows
from the sums of the files before it.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerflow.llm.common import bound_batches, by_bytes, plan_bytes

#: Parquet settings of the files: row groups of 32 MB, pages of 64 KB with at most 2,000 rows, version 2, page checksums.
FILE_OPTIONS = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(64 << 10), "parquet.page.row.count.limit": "2000", "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.page.write-checksum.enabled": "true", "compression": "zstd"}
END_ID = 1
#: Words that a worker remembers, as Arrow and NumPy arrays; beyond that it keeps those of the last batch.
REMEMBERED = 800_000
#: Letters and marks of words that a worker remembers; beyond that it starts anew.
REMEMBERED_PARTS = 250_000
#: UTF-8 bytes encoded at once, long single texts aside.
STEP_BYTES = 8 << 20
#: Words that are encoded as one text.
RUN = 50
#: Marks that never join letters in one token; an apostrophe does.
_MARKS = ".,;:!?*$%#&|"
#: Bytes of the input, as its files are, for each output file.
INPUT_PER_FILE = 256 << 20
_FILE_SCHEMA = "part int, doc_id long, offset long, n_tokens long, ids array<int>"


class WordEncoder:
    """Ids of texts as the library gives them without special tokens, little-endian, four bytes each.

    The tokenizer drops white space, so a text's ids are those of its space-separated words in turn. Arrow splits the
    texts and numbers their distinct words; those that the worker remembers are looked up in Arrow too, so Python sees
    new words only. A word that ends in plain punctuation is its letters' ids and then the marks', and letters
    count in lower case, as the tokenizer takes them. ``cuts`` holds that down to what a probe at load time confirms;
    otherwise whole texts are encoded.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.words = pa.array([], pa.string())
        self.flat, self.begin, self.length = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.parts: dict[str, bytes] = {"": b""}
        probe = ["Ab, c's d\ne", "Ab, c's", "d\ne", "d", "e", " x  y ", "x", "y"]
        a, b, c, d, e, f, g, h = self._ids(probe)
        self.cuts = a == b + c and c == d + e and f == g + h
        ends = ["ÀRbre.", "àrbre", ".", "Word!!", "word", "!!", "it$$$", "it", "$$$"]
        i = self._ids(ends)
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.splits = self.cuts and all(i[k] == i[k + 1] + i[k + 2] for k in (0, 3, 6))

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters, RUN of them to a text: each ends with the one token that carries the end of a word."""
        out: dict[str, bytes] = {}
        groups = [words[k : k + RUN] for k in range(0, len(words), RUN)]
        for group, flat in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            stops = (np.flatnonzero(self.last[np.frombuffer(flat, "<u4")]) + 1) * 4
            if len(stops) == len(group):
                out.update(zip(group, (flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)), strict=True))
        return out

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words that aren't remembered."""
        if len(self.parts) > REMEMBERED_PARTS:
            self.parts = {"": b""}
        pairs = []
        for w in words:
            letters = w.rstrip(_MARKS)
            if self.splits and letters.isalpha() and (letters.isascii() or max(letters) < "\u0180"):
                pairs.append((letters.lower(), w[len(letters) :]))
            else:
                pairs.append((w, ""))
        fresh = {x for p in pairs for x in p}.difference(self.parts)
        self.parts.update(self._runs([x for x in fresh if x.isalpha() and (x.isascii() or max(x) < "\u0180")]))
        listed = [x for x in fresh if x not in self.parts]
        self.parts.update(zip(listed, self._ids(listed), strict=True))
        return [self.parts[a] + self.parts[b] for a, b in pairs]

    def _look_up(self, words: pa.Array) -> np.ndarray:
        """Where distinct words are in memory; new ones are added first."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().astype(np.int64)
        missing = at < 0
        if len(self.words) > REMEMBERED:
            keep = at[~missing]
            self.words, self.length = self.words.take(pa.array(keep)), self.length[keep]
            self.flat, through = _take(self.flat, self.begin[keep], self.length)
            self.begin, at[~missing] = through[:-1], np.arange(len(keep))
        if missing.any():
            new = words.filter(pa.array(missing))
            ids = self._new(new.to_pylist())
            length = np.array([len(x) for x in ids], np.int64) // 4
            at[missing] = len(self.words) + np.arange(len(ids))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(length) - length])
            self.words, self.length = pa.concat_arrays([self.words, new]), np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's ids begin and end)."""
        if not self.cuts:
            ids = self._ids(texts.to_pylist())
            return np.frombuffer(b"".join(ids), "<u4"), np.cumsum([0, *(len(x) // 4 for x in ids)])
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        edge = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        at = self._look_up(coded.dictionary)[coded.indices.to_numpy()]
        flat, through = _take(self.flat, self.begin[at], self.length[at])
        return flat, through[edge - edge[0]]


def _take(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that begin and last so, one after the other, and their edges."""
    through = np.concatenate([[0], np.cumsum(length)])
    return flat[np.arange(through[-1]) + np.repeat(begin - through[:-1], length)], through


@functools.lru_cache(maxsize=1)
def encoder_for(path: str) -> WordEncoder:
    """The encoder of this worker process, kept from task to task."""
    return WordEncoder(path)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID, partitions: int | None = None, options: dict[str, str] = FILE_OPTIONS) -> None:
    """Encode every text and write the files below ``path``, documents in ascending id order, equal ids by text.

    Null and empty texts have the end id only. Rows that repeat an id are documents of their own; a null id comes first.
    Other columns are ignored; an empty table gives files without rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), plan_bytes(docs) // INPUT_PER_FILE)
    end = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, done = None, TaskContext.get().partitionId(), 0
        for whole in batches:
            encoder = encoder or encoder_for(tokenizer_path)
            for batch in by_bytes(whole, limit=STEP_BYTES):
                flat, edge = encoder.encode(batch.column("text"))
                n_tokens = np.diff(edge) + len(end)
                ends = np.concatenate([[0], np.cumsum(n_tokens)])
                if len(end):
                    flat = np.insert(flat, edge[1:], end[0])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), batch.column("doc_id"), pa.array(done + ends[:-1]), pa.array(n_tokens), ids], names=["part", "doc_id", "offset", "n_tokens", "ids"])
                done += int(ends[-1])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = texts.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(run, _FILE_SCHEMA).write.options(**options).parquet(path)


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, start, n_tokens) read from the small columns alone; start counts the ids of all documents before."""
    meta = spark.read.schema(_FILE_SCHEMA).parquet(path).select("part", "doc_id", "offset", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    #: One row per file, so the broadcast is bounded by the number of files.
    bases = meta.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return meta.join(F.broadcast(bases), "part").select("part", "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, start, n_tokens, ids) of all documents."""
    whole = spark.read.schema(_FILE_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = whole.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return whole.join(F.broadcast(bases), "part").select("part", "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def ids_crc32(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the checksum of each document's ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
