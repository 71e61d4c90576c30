"""Token counts by a SentencePiece model, with huge texts encoded in overlapping chunks.

A text of at most ``chunk_chars`` characters is encoded at once. A longer one is encoded in
chunks that overlap; every token has its offset, and two neighbouring chunks are spliced at a
token boundary that both have and that is proven stable. A place between the characters x and
y is stable if no piece of the vocabulary holds xy: merges only ever build pieces of the
vocabulary, so none can reach across, and what lies on one side has no influence on the other.
An overlap without such a place is doubled until it has one or the text ends, so the count is
that of the whole text in every case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonewright.functions.columns import col

SPACE = "▁"


class ChunkedCounter:
    """Counts the tokens of one text; made once per Python worker."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        spec, kind = proto.normalizer_spec, proto.trainer_spec
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        #: Only plain BPE over unchanged characters gives the proof above.
        self.can_splice = (
            kind.model_type == kind.BPE
            and kind.byte_fallback
            and not spec.precompiled_charsmap
            and not spec.remove_extra_whitespaces
            and spec.escape_whitespaces
            and all(p.type in (p.NORMAL, p.UNKNOWN, p.CONTROL, p.BYTE) for p in proto.pieces)
        )
        self.prefix = int(spec.add_dummy_prefix)
        self.width = np.zeros(n, np.float64)
        self.inner = np.zeros(n, bool)
        pairs = set()
        for i, piece in enumerate(pieces):
            if self.model.is_byte(i):
                byte = int(piece[3:5], 16)
                self.inner[i] = 0x80 <= byte < 0xC0
                self.width[i] = not self.inner[i]
            elif not (self.model.is_control(i) or self.model.is_unknown(i)):
                self.width[i] = len(piece)
                pairs.update(zip(piece, piece[1:], strict=False))
        self.pairs = {a + b for a, b in pairs}

    def _encode(self, text: str) -> np.ndarray:
        """Where in ``text`` each token begins, in characters."""
        ids = np.asarray(self.model.encode(text, num_threads=1), np.int64)
        starts = np.cumsum(self.width[ids]) - self.width[ids] - self.prefix
        starts[self.inner[ids]] -= 0.5  # later bytes of a character: no place for a splice
        return starts

    def _splice(self, text: str, lo: int, hi: int, before, after) -> int | None:
        """The last stable place in (lo, hi) at which a token of both encodings begins."""
        for at in range(hi - 1, lo, -1):
            pair = text[at - 1 : at + 1].replace(" ", SPACE)
            if pair not in self.pairs:
                i, j = np.searchsorted(before, at), np.searchsorted(after, at)
                if i < len(before) and j < len(after) and before[i] == at == after[j]:
                    return at
        return None

    def count(self, text: str, chunk_chars: int, overlap_chars: int) -> int:
        n = len(text)
        if n <= chunk_chars or not self.can_splice:
            return len(self.model.encode(text, num_threads=1))
        # counted so far: all tokens before ``begin``; the present chunk is [start, end)
        total, begin, start, end = 0, -np.inf, 0, chunk_chars
        here = self._encode(text[:end])
        while end < n:
            overlap, at = overlap_chars, None
            while at is None:
                lo = max(start, int(max(begin, 0)), end - overlap)
                stop = min(n, lo + chunk_chars + overlap)
                there = lo + self._encode(text[lo:stop])
                at = self._splice(text, lo, end, here, there)
                if at is None and lo > max(start, begin):
                    overlap *= 2
                elif at is None:  # no place in the whole chunk: it has to reach further
                    end = min(n, end + 2 * (end - start))
                    here = start + self._encode(text[start:end])
                    if end == n:
                        break
            if at is None:
                break
            total += int(np.count_nonzero((here >= begin) & (here < at)))
            begin, start, end, here = at, lo, stop, there
        return total + int(np.count_nonzero(here >= begin))


@lru_cache(maxsize=4)
def _counter(model_file: str) -> ChunkedCounter:
    return ChunkedCounter(model_file)


def token_counts(
    docs: DataFrame,
    model_file: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    chunk_chars: int = 32768,
    overlap_chars: int = 256,
) -> DataFrame:
    """Per row: the id, ``n_bytes`` in UTF-8, ``n_tokens`` and ``over_limit``.

    One row out for each row in, in any order: a null text counts as empty (no bytes, no
    tokens), a null id stays null, repeated rows give repeated results, an empty table gives an
    empty one. Other columns are not read, whatever their names. ``model_file`` must be
    readable on every worker.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(model_file)
        for batch in batches:
            yield pd.Series(
                [counter.count(t, chunk_chars, overlap_chars) for t in batch], dtype="int64"
            )

    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        col(id_col).alias(id_col),
        F.octet_length(text).cast("long").alias("n_bytes"),
        count(text).alias("n_tokens"),
    )
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
