"""Byte-level BPE by recursive SQL in DuckDB, one database per worker.

A slice of texts is cut by the pattern; the distinct matches a worker has not seen lately go to DuckDB at once. The
recursive query holds one token list per word. In each step every list unfolds into rows of position, token and next
token; these join the merge table, the least rank (leftmost on ties) wins per word, and that pair is contracted. A word
without a pair in the merge table leaves the recursion. Decoding joins position rows with the vocabulary and
aggregates the bytes in order.

A step costs the length of the words in it, so a long word is cut into pieces, which the query takes as words of their own. Then the
borders are settled. Tokens stand as in the whole word if any two neighbours, joined and encoded, give themselves again: a merge across a
border, the first there is, joins an end of one neighbour with a beginning of the other, out of merges that a run on these two makes just
so, in the same order. Where a border fails, some tokens around it are encoded anew, and the borders of that stretch are looked at next.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shiftledger.llm.common import id_and_text, slices
from shiftledger.llm.tokens import Recent

_CACHE_WORDS = 550_000
_SLICE = 2 << 20
#: Rank and position share one number, so that the minimum is the leftmost pair of the least rank.
_PLACE = 1 << 32

_CONTRACT = f"""
        SELECT s.w, list_concat(list_append(s.toks[:b.best % {_PLACE} - 1], (b.best // {_PLACE})::INT), s.toks[b.best % {_PLACE} + 2:])
        FROM step s JOIN (
            SELECT p.w, min(m.merged::BIGINT * {_PLACE} + p.pos) AS best
            FROM (
                SELECT w, unnest(range(1, len(toks))) AS pos, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r FROM step
            ) p JOIN merges m ON m.l = p.l AND m.r = p.r
            GROUP BY p.w
        ) b ON b.w = s.w"""
#: Keeps every step of a word and takes the last, which has the fewest tokens.
ENCODE = f"""
    WITH RECURSIVE step(w, toks) AS (SELECT w, toks FROM words UNION ALL {_CONTRACT})
    SELECT w, arg_min(toks, len(toks)) AS toks FROM step GROUP BY w ORDER BY w"""
#: For long stretches: keeps the last step only, at some more work a step.
ENCODE_LONG = f"""
    WITH RECURSIVE step(w, toks) USING KEY (w) AS (SELECT w, toks FROM words UNION {_CONTRACT})
    SELECT w, toks FROM step ORDER BY w"""
_LONG = 256  # bytes; longer words go in pieces
_PIECE = 32
_PIECES = 8192  # encoded together

DECODE = """
    SELECT p.w, string_agg(v.hex, '' ORDER BY p.pos) AS hex
    FROM (SELECT w, unnest(range(1, len(toks) + 1)) AS pos, unnest(toks) AS id FROM encoded) p
    JOIN vocabulary v ON v.id = p.id
    GROUP BY p.w ORDER BY p.w"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every way to put a token together from two tokens: left, right, merged; the merged id is its rank."""
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                merged.append(rank)
    return pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32())})


class Bpe:
    """Encodes and decodes whole texts, each match of the pattern separately, without special tokens."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self._matches = regex.compile(pattern).findall
        self._ranks = load_ranks(path)
        self._token = {rank: token for token, rank in self._ranks.items()}
        self._bytes = np.array([self._ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self._db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "256MB", "temp_directory": os.path.abspath(os.environ.get("TMPDIR", "/tmp"))})
        merges = merge_table(self._ranks)
        vocabulary = pa.table({
            "id": pa.array(list(self._ranks.values()), pa.int32()), "hex": [t.hex() for t in self._ranks],
        })
        self._db.register("given_merges", merges)
        self._db.register("given_vocabulary", vocabulary)
        self._db.execute("CREATE TABLE merges AS FROM given_merges; CREATE TABLE vocabulary AS FROM given_vocabulary")
        self._known = Recent(None, _CACHE_WORDS)

    def _encode_words(self, words: list[bytes], whole: bool = True) -> pa.Table:
        """Token lists in the order of the words; a whole word that is itself a token is that token."""
        tokens = [self._ranks.get(w) if whole else None for w in words]
        data = np.frombuffer(b"".join(w for w, t in zip(words, tokens) if t is None), np.uint8)
        sizes = [len(w) if t is None else 1 for w, t in zip(words, tokens)]
        flat = np.empty(sum(sizes), dtype=np.int32)
        whole = np.repeat([t is not None for t in tokens], sizes)
        flat[~whole] = self._bytes[data]
        flat[whole] = [t for t in tokens if t is not None]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat))
        self._db.register("words", pa.table({"w": pa.array(np.arange(len(words)), pa.int32()), "toks": lists}))
        return self._db.sql(ENCODE_LONG if max(sizes) > _LONG else ENCODE).to_arrow_table()

    def _encode_parts(self, parts: list[bytes]) -> list[np.ndarray]:
        """The tokens of parts of words, each by itself."""
        distinct = list(dict.fromkeys(parts))
        found: dict[bytes, np.ndarray] = {}
        for i in range(0, len(distinct), _PIECES):
            lists = self._encode_words(distinct[i:i + _PIECES], whole=False)["toks"].combine_chunks()
            ends = np.cumsum(lists.value_lengths().to_numpy())
            found |= zip(distinct[i:i + _PIECES], np.split(lists.flatten().to_numpy(), ends[:-1]))
        return [found[p] for p in parts]

    def _encode_long(self, word: bytes) -> np.ndarray:
        """The tokens of a long word: of its pieces, with the borders between them settled."""
        if word in self._ranks:
            return np.array([self._ranks[word]], dtype=np.int32)
        parts = self._encode_parts([word[i:i + _PIECE] for i in range(0, len(word), _PIECE)])
        tokens, around = np.concatenate(parts), 4
        borders = np.cumsum([len(p) for p in parts])[:-1]  # the tokens right of them
        while len(borders):
            pairs, which = np.unique(np.stack([tokens[borders - 1], tokens[borders]], axis=1), axis=0, return_inverse=True)
            again = self._encode_parts([self._token[a] + self._token[b] for a, b in pairs.tolist()])
            holds = np.array([r.tolist() == p for r, p in zip(again, pairs.tolist())])
            wrong = borders[~holds[which.ravel()]]
            stretches: list[list[int]] = []
            for at in wrong.tolist():
                low, high = max(0, at - around), min(len(tokens), at + around)
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = high
                else:
                    stretches.append([low, high])
            fresh = self._encode_parts([b"".join([self._token[t] for t in tokens[a:b].tolist()]) for a, b in stretches])
            out, borders, done, n = [], [], 0, 0
            for (low, high), new in zip(stretches, fresh):
                n += low - done
                borders += [n, n + len(new)]
                out += [tokens[done:low], new]
                n, done = n + len(new), high
            n += len(tokens) - done
            tokens = np.concatenate([*out, tokens[done:]])
            borders = np.array([b for b in borders if 0 < b < n], dtype=np.int64)
            around *= 2
        return tokens

    def _learn(self, words: list[str]) -> None:
        data = [w.encode() for w in words]
        long = [len(d) > _LONG for d in data]
        if short := [w for w, x in zip(words, long) if not x]:
            self._keep(short, self._encode_words([d for d, x in zip(data, long) if not x]))
        for word, coded in ((w, self._encode_long(d)) for w, d, x in zip(words, data, long) if x):
            lists = pa.ListArray.from_arrays(pa.array([0, len(coded)], pa.int32()), pa.array(coded, pa.int32()))
            self._keep([word], pa.table({"w": pa.array([0], pa.int32()), "toks": lists}))

    def _keep(self, words: list[str], encoded: pa.Table) -> None:
        self._db.register("encoded", encoded)
        decoded = self._db.sql(DECODE).to_arrow_table()["hex"].to_pylist()
        lists = encoded["toks"].combine_chunks()
        ids, ends = lists.flatten().to_numpy().astype("<u4").tobytes(), np.cumsum(lists.value_lengths().to_numpy()) * 4
        start = 0
        for word, end, text in zip(words, ends.tolist(), decoded):
            self._known[word] = (ids[start:end], bytes.fromhex(text))
            start = end

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids as little-endian unsigned 32-bit integers, and the bytes they decode to, of every text."""
        self._known.turn()
        cut = [self._matches(t) for t in texts]
        new = self._known.lacking(set().union(*cut))
        if new:
            self._learn(list(new))
        out, get = [], self._known.__getitem__
        for words in cut:
            found = list(map(get, words))
            out.append((b"".join([ids for ids, _ in found]), b"".join([text for _, text in found])))
        return out


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    """One per worker process, kept from task to task."""
    return Bpe(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row; ids are little-endian unsigned 32-bit, decoded the bytes.

    Null text is empty and has no ids. Ids may be null or repeat; other columns are ignored. Texts and words are taken whole, however long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=_SLICE):
            ids, decoded = zip(*bpe(path, pattern).encode(part["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"]
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")
