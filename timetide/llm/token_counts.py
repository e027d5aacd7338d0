"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text of more than `chunk` characters is encoded in overlapping chunks of `chunk` bytes. In the overlap of two chunks
the splice point is a position where both have a token boundary and which is proven stable: a space
after a non-space. No piece of the vocabulary has a space mark behind another character (checked when
the model is loaded), so that no merge crosses such a position and what stands before it cannot change
the tokens behind it. Where an overlap has no such point it is doubled, at last to the whole chunk,
and then the chunk itself grows.

Memory is that of one chunk's tokens. Edge cases: null text counts as empty (0 bytes, 0 tokens); a
model that breaks the rule about spaces is never spliced; rows are counted one by one, whatever
repeats, and a null doc_id stays null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 16_384
OVERLAP = 256
LIMIT = 4096
MARK = "▁"


class TokenCounter:
    def __init__(self, model_file: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap, self.widened = chunk, overlap, 0
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.stable = not any(MARK in p.lstrip(MARK) for p in pieces)
        #: Bytes of text that each piece stands for; a byte piece is named <0x..>.
        self.size = np.array([1 if self.model.is_byte(i) else len(p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)])

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        if len(text) <= self.chunk or not self.stable:
            return len(self.model.encode(text, return_type="numpy", num_threads=1))
        return self._spliced(text.encode())

    def _starts(self, data: bytes, start: int, end: int) -> np.ndarray:
        """Where the tokens of data[start:end] begin, in the whole text."""
        text = data[start:end].decode()
        sizes = self.size[self.model.encode(text, return_type="numpy", num_threads=1)]
        if sizes.sum() == end - start + 1:  # the model puts one space in front
            at = np.cumsum(sizes) - sizes - 1
            return start + np.maximum(at, 0)
        return start + np.array([p.begin for p in self.model.encode(text, return_type="proto", num_threads=1).pieces], dtype=np.int64)

    def _splice(self, data: bytes, left: np.ndarray, begin: int, end: int) -> int | None:
        """The first stable point behind `begin` at which the chunk encoded so far and one from `begin` agree."""
        for p in np.intersect1d(left[left > begin], self._starts(data, begin, end)).tolist():
            if data[p] == 32 and data[p - 1] != 32 and data[p - 3 : p] != MARK.encode():
                return p
        return None

    def _spliced(self, data: bytes) -> int:
        def whole(at: int) -> int:
            """The start of the character that `at` is in."""
            while at < len(data) and data[at] & 0xC0 == 0x80:
                at -= 1
            return min(at, len(data))

        total, cut, start, end = 0, 0, 0, whole(self.chunk)
        while True:
            left = self._starts(data, start, end)
            if end >= len(data):
                return total + int((left >= cut).sum())
            width, point = self.overlap, None
            while True:
                begin = max(whole(end - width), cut)
                point = self._splice(data, left, begin, end)
                if point is not None or begin == cut:
                    break
                self.widened += 1
                width *= 2
            if point is None:
                end = whole(end + self.chunk)
                continue
            total += int(((left >= cut) & (left < point)).sum())
            cut, start, end = point, begin, whole(begin + max(self.chunk, 2 * width))


def token_counts(docs: DataFrame, model_file: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of docs."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counter = _counter(model_file, chunk, overlap)
        return texts.map(counter, na_action=None).astype("int64")

    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count("text").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


_counters: dict[tuple, TokenCounter] = {}


def _counter(*key) -> TokenCounter:
    if key not in _counters:
        _counters[key] = TokenCounter(*key)
    return _counters[key]
