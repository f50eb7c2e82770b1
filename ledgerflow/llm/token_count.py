"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries: no piece of the vocabulary holds a space after another character (checked when the
model is loaded), so the library's merges never cross from one space-led segment to the next and a text's
count is the sum over its segments. A segment's count is remembered, so that each worker encodes a repeated one once. Batches are balanced by bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ledgerflow.llm.common import by_bytes, id_text, spread

#: Segments a worker remembers before it starts anew.
REMEMBERED = 400_000
LIMIT = 4096
_SPACE = "▁"


class PieceCounter:
    """Token counts of texts as the library gives them, without begin or end tokens."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        #: Cutting is exact only if no piece spans a boundary and white space is kept as it is.
        self.cuts = not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces) and self._lengths(["a  b", "a", " b", " a"]) == [self._lengths(["a"])[0] + self._lengths([" b"])[0]] + self._lengths(["a", " b", " a"])
        self.known: dict[str, int] = {}

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def segments(self, text: str) -> list[str]:
        """Parts whose counts add up to the text's. Each is led by the space it lacks, which the library puts back."""
        if not self.cuts or _SPACE in text:
            return [text]
        if "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        return [x[1:] for x in re.findall(r" *[^ ]+(?: +\Z)?| +", f" {text}")]

    def count(self, texts: list[str]) -> list[int]:
        parts = [self.segments(t) if t else [] for t in texts]
        new = {x for p in parts for x in p}.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = {x for p in parts for x in p}
        listed = list(new)
        self.known.update(zip(listed, self._lengths(listed), strict=True))
        look = self.known.__getitem__
        return [sum(map(look, p)) for p in parts]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 of both. Whole texts are counted, however long. Repeated rows and ids are counted
    row by row, other columns are ignored, an empty table gives an empty result, a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for whole in batches:
            counter = counter or PieceCounter(model_path)
            for batch in by_bytes(whole):
                texts = batch.column("text")
                n = counter.count(texts.to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return spread(id_text(docs, id_col, text_col)).mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
