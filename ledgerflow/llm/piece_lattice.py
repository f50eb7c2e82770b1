"""Sampled SentencePiece segmentations by forward filtering and backward sampling over the piece lattice.

A text is a sequence of units: a word with the run of spaces before it. No piece crosses into a next unit (a vocabulary
with a space behind another character is refused), so a unit's lattice stands alone: ``forward[e]`` sums the weights of all its segmentations up to character e, and a
segmentation is drawn from the end backwards, each piece with its share of ``forward``. A piece weighs
exp(alpha * score); a piece whose weight is zero in double precision is never drawn. Characters outside the vocabulary (and a literal U+2581) become byte pieces.

The draws come from a counter hashed with the row key, not from a generator's state, so a row's pieces are the same in
any partitioning, batch or rerun. Decoding joins the pieces and gives back the exact text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import by_bytes, mix, spread

_SPACE = 0x2581
#: A space behind a unit's first; there U+2581 is a literal one.
_GAP = 0x20
_UNIT = re.compile(" +[^ ]*")
#: Units of up to so many characters are filtered together as arrays; longer ones one by one.
SHORT = 40
#: Units of one length that are filtered at once.
TOGETHER = 20_000
ALPHA = 0.0005
_UNKNOWN_SCORE = -40_000.0
_BITS = 21
_HASH = np.uint64(0x9E3779B97F4A7C15)


class PieceLattice:
    """The vocabulary of a SentencePiece model as a lattice of weighted pieces."""

    def __init__(self, model_path: str, alpha: float = ALPHA, seed: int = 0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        self.bytes = np.full(256, -1, np.int64)
        #: What each id stands for.
        self.raw = [b""] * size
        plain: dict[str, int] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.raw[i] = bytes([int(piece[1:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if "▁" in piece.lstrip("▁"):
                    raise ValueError(f"the piece {piece!r} crosses into a next unit")
                plain[piece] = i
                self.raw[i] = piece.replace("▁", " ").encode()
        if (self.bytes < 0).any():
            raise ValueError("the model has no byte fallback, so texts can't be kept whole")
        self.seed, self.longest = seed, max(map(len, plain))
        self.weight = np.zeros(size + 1)
        for i in plain.values():
            #: Single characters stay possible whatever their score, so that every text has a segmentation.
            self.weight[i] = np.exp(alpha * (max(sp.get_score(i), _UNKNOWN_SCORE) if len(self.raw[i].decode()) == 1 else sp.get_score(i)))
        self.plain = {p: i for p, i in plain.items() if self.weight[i] > 0}
        self.unknown = float(np.exp(alpha * _UNKNOWN_SCORE))
        self.table, self.code = np.full(1 << _BITS, -1, np.int32), np.zeros(1 << _BITS, np.uint64)
        self.clash: dict[int, int] = {}
        for p, i in self.plain.items():
            h = self._hash(np.array([[ord(c) for c in p]], np.uint64))[0]
            at = int(h >> np.uint64(64 - _BITS))
            if self.table[at] < 0:
                self.table[at], self.code[at] = i, h
            else:
                self.clash[int(h)] = i
        self.clash_code = np.array(sorted(self.clash), np.uint64)
        self.clash_id = np.array([self.clash[int(h)] for h in self.clash_code], np.int32)

    @staticmethod
    def _hash(chars: np.ndarray) -> np.ndarray:
        h = np.full(len(chars), _HASH)
        for k in range(chars.shape[1]):
            h = (h ^ chars[:, k]) * _HASH
            h ^= h >> np.uint64(29)
        return h * _HASH

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids for substring hashes, -1 where there is none."""
        h = h * _HASH
        at = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        found = np.where(self.code[at] == h, self.table[at], -1)
        if len(self.clash_code):
            miss = np.flatnonzero((found < 0) & (self.table[at] >= 0))
            k = np.minimum(np.searchsorted(self.clash_code, h.ravel()[miss] if h.ndim == 1 else h.flat[miss]), len(self.clash_code) - 1)
            hit = self.clash_code[k] == (h.flat[miss])
            found.flat[miss[hit]] = self.clash_id[k[hit]]
        return found

    def _filter(self, chars: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(forward sums, ids of the pieces of each length by where they end) for units of one length."""
        n, length = chars.shape
        lead = chars == _SPACE
        lead[:, 0] = False
        chars = np.where(chars == _GAP, np.uint64(_SPACE), chars)
        ends: list[np.ndarray] = []
        h = np.full((n, length), _HASH)
        for size in range(1, min(length, self.longest) + 1):
            h = (h[:, : length - size + 1] ^ chars[:, size - 1 :]) * _HASH
            h ^= h >> np.uint64(29)
            ids = np.full((n, length + 1), -1, np.int32)
            ids[:, size:] = self._find(np.ascontiguousarray(h).ravel()).reshape(h.shape)
            ends.append(ids)
        weights = [self.weight[ids] for ids in ends]
        weights[0][:, 1:][ends[0][:, 1:] < 0] = self.unknown
        if lead.any():  # a literal U+2581 is no space
            for size, w in enumerate(weights, 1):
                for k in range(size):
                    w[:, size:][lead[:, k : length - size + 1 + k]] = self.unknown if size == 1 else 0.0
            ends[0][:, 1:][lead] = -1
        forward = np.zeros((n, length + 1))
        forward[:, 0] = 1.0
        for e in range(1, length + 1):
            for size in range(1, min(e, self.longest) + 1):
                forward[:, e] += forward[:, e - size] * weights[size - 1][:, e]
            if e % 8 == 0:  # keep long units in range; shares don't change
                scale = forward[:, e].copy()
                forward[:, : e + 1] /= scale[:, None]
        for ids, w in zip(ends, weights, strict=True):
            ids[:, 1:][(w[:, 1:] == 0) & (ids[:, 1:] >= 0)] = -1
        return forward, ends

    def _draws(self, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Uniform in [0, 1): a hash of the row key and of the character's place in the row."""
        return (mix(key ^ mix(place.astype(np.uint64) + np.uint64(1))) >> np.uint64(11)).astype(float) * 2.0**-53

    def _sample(self, chars: np.ndarray, unit: np.ndarray, key: np.ndarray, place: np.ndarray, slot: np.ndarray, out: np.ndarray) -> None:
        """Draw a segmentation for each occurrence and store piece ids at the slots of their first characters."""
        forward, ends = self._filter(chars)
        weights_of = self.weight
        at = np.full(len(unit), chars.shape[1])
        live = np.arange(len(unit))
        while len(live):
            u, e = unit[live], at[live]
            aim = self._draws(key[live], place[live] + e) * forward[u, e]
            size, left, piece = np.zeros(len(live), np.int64), np.ones(len(live), bool), np.full(len(live), -1, np.int64)
            last = np.zeros(len(live), np.int64)
            last_piece = np.full(len(live), -1, np.int64)
            for k in range(1, min(int(e.max()), self.longest) + 1):
                possible = left & (e >= k)
                ids = ends[k - 1][u, e]
                w = np.where(ids >= 0, weights_of[ids], self.unknown if k == 1 else 0.0) * np.where(possible, forward[u, np.maximum(e - k, 0)], 0.0)
                some = possible & (w > 0)
                last[some], last_piece[some] = k, ids[some]
                aim = aim - w
                hit = some & (aim < 0)
                size[hit], piece[hit] = k, ids[hit]
                left &= ~hit
                if not left.any():
                    break
            size[left], piece[left] = last[left], last_piece[left]  # rounding at the upper end
            e = e - size
            unknown = piece < 0
            piece[unknown] = -2 - chars[u[unknown], e[unknown]].astype(np.int64)
            out[slot[live] + e] = piece
            at[live] = e
            live = live[e > 0]

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's ids begin and end). An empty text has none."""
        units: dict[str, int] = {}
        index: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for t, text in enumerate(texts):
            if text:
                parts = [u[1:] for u in _UNIT.findall(" " + text)] if text[0] == " " or "  " in text else text.split(" ")
                index.extend([units.setdefault(p, len(units)) for p in parts])
                counts[t] = len(parts)
        which = np.array(index, np.int64)
        names = list(units)
        lengths = np.array([len(p) + 1 for p in names], np.int64)
        span = lengths[which]
        first = np.cumsum(span) - span
        row = np.repeat(np.arange(len(texts)), counts)
        begins = np.concatenate([[0], np.cumsum(counts)])
        edge = np.concatenate([first, [int(span.sum())]])[begins]
        place = first - edge[:-1][row]
        hashed = mix(mix(keys.astype(np.int64).view(np.uint64)) ^ np.uint64(self.seed))[row]
        out = np.full(int(span.sum()), -1, np.int64)
        order = np.argsort(span, kind="stable")
        cuts = np.searchsorted(span[order], np.arange(2, SHORT + 3))
        for length in range(1, SHORT + 2):
            own = order[(cuts[length - 2] if length > 1 else 0) : cuts[length - 1]]
            distinct, unit = np.unique(which[own], return_inverse=True)
            for s in range(0, len(distinct), TOGETHER):
                some = distinct[s : s + TOGETHER]
                raw = "".join(["▁" + names[i] for i in some])
                chars = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(some), length)
                use = np.flatnonzero((unit >= s) & (unit < s + len(some))) if len(distinct) > TOGETHER else slice(None)
                self._sample(chars, unit[use] - s, hashed[own][use], place[own][use], first[own][use], out)
        for k in order[cuts[SHORT] :]:
            self._long("▁" + names[which[k]], hashed[k], int(place[k]), int(first[k]), out)
        return self._spread(out, edge)

    def _long(self, unit: str, key: np.uint64, place: int, slot: int, out: np.ndarray) -> None:
        """The same for one long unit, in linear time and with running rescaling."""
        n, longest = len(unit), self.longest
        forward, scale = np.zeros(n + 1), np.zeros(n + 1)
        forward[0] = 1.0
        steps: list[list[tuple[int, int, float]]] = [[]]
        find, weight = self.plain.get, self.weight
        for e in range(1, n + 1):
            options, total = [], 0.0
            for k in range(1, min(e, longest) + 1):
                part = unit[e - k : e]
                i = None if "▁" in unit[max(e - k, 1) : e] else find(part.replace(" ", "▁"))
                w = weight[i] if i is not None else self.unknown if k == 1 else 0.0
                if w:
                    share = w * forward[e - k] * np.exp(scale[e - k] - scale[e - 1])
                    options.append((k, -2 - ord(part) if i is None else i, share))
                    total += share
            steps.append(options)
            forward[e], scale[e] = 1.0, scale[e - 1] + np.log(total)
        e = n
        draws = self._draws(np.full(n + 1, key, np.uint64), place + np.arange(n + 1))
        while e:
            aim = draws[e] * sum(s for _, _, s in steps[e])
            for k, i, share in steps[e]:
                aim -= share
                if aim < 0:
                    break
            e -= k
            out[slot + e] = i

    def _spread(self, out: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Drop empty slots and put byte pieces for characters outside the vocabulary."""
        width = (out != -1).astype(np.int64)
        odd = np.flatnonzero(out < -1)
        extra = {}
        for k in odd:
            extra[int(k)] = self.bytes[np.frombuffer(chr(-2 - int(out[k])).encode("utf-8", "surrogatepass"), np.uint8)]
            width[k] = len(extra[int(k)])
        through = np.concatenate([[0], np.cumsum(width)])
        if not extra:
            return out[out != -1].astype(np.int32), through[edge]
        flat = np.empty(int(through[-1]), np.int32)
        simple = np.flatnonzero(out >= 0)
        flat[through[simple]] = out[simple]
        for k, ids in extra.items():
            flat[through[k] : through[k] + len(ids)] = ids
        return flat, through[edge]

    def decode(self, ids: list[int]) -> str:
        """The exact text of a row's ids."""
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


def sample_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, seed: int = 0, keep_text: bool = False) -> DataFrame:
    """One row per document: id, ids (list of piece ids; empty for null and empty texts), and text (null: empty) if ``keep_text``.

    Rows with the same id and text get the same segmentation; a null id counts as 0. Whole texts are
    encoded, other columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for whole in batches:
            lattice = lattice or PieceLattice(model_path, alpha, seed)
            for batch in by_bytes(whole):
                keys = pc.fill_null(batch.column("id"), 0).to_numpy(zero_copy_only=False)
                flat, edge = lattice.sample(batch.column("text").to_pylist(), keys)
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(flat))
                columns = [batch.column("id"), lists] + [batch.column("text")] * keep_text
                yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "text"][: len(columns)])

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return spread(read).mapInArrow(run, "id long, ids array<int>" + ", text string" * keep_text)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(id, text) from (id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for batch in batches:
            lattice = lattice or PieceLattice(model_path)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([lattice.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, text string")


def check_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(id, n_pieces, n_bytes, pieces_crc32, lossless) from (id, ids, text): the ids are decoded and held against the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = None
        for batch in batches:
            raw = raw or PieceLattice(model_path).raw
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            texts = batch.column("text").to_pylist()
            crc, size, same = [], [], []
            for a, b, text in zip(ends[:-1].tolist(), ends[1:].tolist(), texts, strict=True):
                ids = flat[a:b]
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                data = text.encode()
                size.append(len(data))
                same.append(b"".join([raw[i] for i in ids.tolist()])[1:] == data)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["id", "n_pieces", "n_bytes", "pieces_crc32", "lossless"])

    return encoded.select("id", "ids", "text").mapInArrow(run, "id long, n_pieces long, n_bytes long, pieces_crc32 long, lossless boolean")
