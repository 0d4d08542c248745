"""Token counts by the whole-token shortcut.

A BPE merge only ever builds vocabulary pieces. If no piece holds a space mark behind another character,
no merge crosses the start of a word, so each word counts by itself; that is proved on the vocabulary before any
text is read, as is the list of pieces that encode alone as one token. Counting then looks words up in
that list, and only the rest is merged, by the library, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from shiftledger.llm.common import id_and_text, slices
from shiftledger.llm.tokens import Recent

MARK = "▁"
_CACHE_WORDS = 400_000


class WordCounts:
    """``count(text)`` equals ``len(SentencePieceProcessor.encode(text))``."""

    def __init__(self, path: str):
        import sentencepiece

        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [
            p for i in range(self._library.get_piece_size())
            if not (self._library.is_control(i) or self._library.is_unknown(i) or self._library.is_byte(i))
            for p in [self._library.id_to_piece(i)]
        ]
        # The two facts the shortcut rests on; a model without them is counted as a whole.
        no_crossing = not any(MARK in p.lstrip(MARK) for p in pieces)
        as_it_is = self._library.encode("a  b ", out_type=str)
        spaces_stay = "".join(as_it_is).replace(MARK, " ") == " a  b "
        self._by_word = no_crossing and spaces_stay
        words = [p[1:] for p in pieces if p[0] == MARK and len(p) > 1 and p[1] != MARK]
        #: Vocabulary words that alone are one token, without their space mark.
        self.whole = {w: 1 for w, ids in zip(words, self._library.encode(words, num_threads=1)) if len(ids) == 1}
        self._rest = Recent(self._merge, _CACHE_WORDS)

    def _merge(self, word: str) -> int:
        if not word or MARK in word:
            raise LookupError(word)
        return self.whole.get(word) or len(self._library.encode(word))

    def count(self, texts: list[str]) -> list[int]:
        self._rest.turn()
        get = self._rest.__getitem__
        out = []
        for text in texts:
            try:
                out.append(sum(map(get, text.split(" "))) if self._by_word else len(self._library.encode(text)))
            except LookupError:  # no text, or runs of spaces, whose marks merge with one another
                out.append(len(self._library.encode(text)))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> WordCounts:
    return WordCounts(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; ``model`` is a SentencePiece BPE file.

    Null text counts as empty (no token). Ids may be null or repeat: one row out per row in. Texts of any length are counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for part in slices(batches):
            texts = part["text"].to_pylist()
            found = count(texts)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(found, pa.int64()),
                 pa.array([n > limit for n in found], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
