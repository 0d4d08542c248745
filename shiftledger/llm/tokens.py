"""Token ids by the ``tokenizers`` library, with words and pre-tokens a worker has seen taken from caches."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np

END = 1
assert array("I", [1]).tobytes() == b"\1\0\0\0"  # what packed ids are made of
_CACHE_WORDS = 200_000
_CACHE_PIECES = 100_000
#: Characters on which the pre-tokenizer's classes are the same in every Unicode version and regex library.
#: Letters and the marks behind them, and the same once more behind a line break.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:-@\[-`{-~]*"
_PLAIN = rf"({_LETTERS})({_MARKS})(?:\n({_LETTERS})({_MARKS}))?"
_USUAL = r"[\t\n\r\x20-\x7eÀ-įı-ſ‐-…]*+"
_SAFE = r"[\x21-\x7eÀ-įı-ſ‐-…]+"
#: Stands for the end of a word where files have a suffix for it.
_MARK = "\0"


class Recent(dict):
    """A cache that works out what it lacks, in two generations: ``turn()`` drops what was not used since the last but one."""

    def __init__(self, work_out, limit: int):
        super().__init__()
        self._work_out, self._limit, self._old = work_out, limit, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._work_out(key)
        self[key] = value
        return value

    def lacking(self, keys: set) -> set:
        """The keys of which nothing is known; those of the old generation move up."""
        new = keys.difference(self)
        for key in new & self._old.keys():
            self[key] = self._old[key]
        return new.difference(self)

    def turn(self) -> None:
        if len(self) > self._limit:
            self._old = {}  # let go before the copy, so that three generations are never held
            self._old = dict(self)
            self.clear()


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next letter from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def _in_order(model: dict) -> bool:
    """Whether the merges of a plain BPE model are listed by rising id."""
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    return all(a < b for a, b in zip(made, made[1:])) and not model["continuing_subword_prefix"]


class WordCache:
    """Encodes whole texts; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    The pre-tokenizers served here start a new pre-token at a space that stands between two characters
    that are not white space, whatever surrounds it. So a text cut before such spaces encodes piece by piece.
    Texts with any other white space next to a space, and words with rare characters or special strings, go
    to the library as a whole. Files of plain byte-level BPE have their usual texts merged by tiktoken, from the same vocabulary; files that mark
    the end of a word have their pre-tokens merged so. Ids come as little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str):
        # One core per task: the library must not start threads of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        import public_tokenizers
        import regex

        self._path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Ids may have gaps: what counts is the largest.
        self.vocabulary = 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        split = [p for p in (spec["pre_tokenizer"].get("pretokenizers") or []) if p["type"] == "Split"]
        self._pieces_of = regex.compile(split[0]["pattern"]["Regex"] if split else public_tokenizers.PATTERN).findall
        # Without such a split the space before a word is part of its pre-token; with one it is dropped.
        self._lead = "" if split else " "
        self._lower = spec["normalizer"] is not None
        self._safe = regex.compile(_SAFE).fullmatch
        self._plain = re.compile(_PLAIN).fullmatch
        if any(not t["content"].startswith("<|") for t in spec["added_tokens"]):
            raise ValueError("special strings are expected to start with <|")
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._letters = str.maketrans(_byte_letters())
        self._id_bytes = [np.uint32(i).astype("<u4").tobytes() for i in range(self.vocabulary)]
        self._fast = self._byte_level(spec)
        self._ended = self._with_end(spec)
        self._usual = regex.compile(_USUAL).fullmatch
        self._words = Recent(self._word, _CACHE_WORDS)
        self._pieces = Recent(self._piece, _CACHE_PIECES)

    @cached_property
    def _library(self):
        """Loaded at the first word or text that needs it."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self._path)
        library.no_truncation()
        library.no_padding()
        return library

    @cached_property
    def _model(self):
        return self._library.model

    def _byte_level(self, spec: dict):
        """The same merges in tiktoken, several times faster; None unless the file is plain byte-level BPE.

        Merges must be listed by rising id: then a pair's place in the list and the id it makes rank alike.
        """
        model, before = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"]:
            return None
        if not _in_order(model) or model["end_of_word_suffix"]:
            return None
        import public_tokenizers
        import tiktoken

        byte = {letter: bytes([b]) for b, letter in _byte_letters().items()}
        ranks = {b"".join([byte[c] for c in token]): i for token, i in model["vocab"].items()}
        self._begins = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self._begins[[i for token, i in ranks.items() if b" " in token]] = True
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _with_end(self, spec: dict):
        """The merges of one pre-token and a mark behind it, in tiktoken; None unless words end with a suffix and each byte does so too.

        The mark is a byte of its own: what it makes with the byte before has the least rank of all merges, so it goes first, and what is
        merged then are the library's symbols. Both merge alike as long as every string of the vocabulary merges to itself:
        then two neighbours that make a string are the two that the library's list has for it.
        """
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        if not suffix or not _in_order(model):
            return None
        import tiktoken

        byte = {letter: bytes([b]) for b, letter in _byte_letters().items()}
        ranks, mark = {}, _MARK.encode()
        for token, i in model["vocab"].items():
            own = token.removesuffix(suffix)
            if not own or any(c not in byte for c in own):
                return None
            key = b"".join([byte[c] for c in own]) + mark * (own != token)
            if (mark in key[:-1] and key != mark * 2) or key in ranks:
                return None
            ranks[key] = i
        ends = [ranks.get(b + mark) for b in byte.values()]
        if None in ends or max(ends) >= min(i for key, i in ranks.items() if len(key) > 1 + key.endswith(mark)):
            return None
        return tiktoken.Encoding("ended", pat_str=rf"[^{_MARK}]+{_MARK}", mergeable_ranks=ranks, special_tokens={})

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self._library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        if self._ended is not None and _MARK not in piece:
            return array("I", self._ended.encode_ordinary(piece + _MARK)).tobytes()
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", "\u0120")
        else:
            letters = piece.encode().decode("latin-1").translate(self._letters)
        table = self._id_bytes
        return b"".join([table[t.id] for t in self._model.tokenize(letters)])

    def _word(self, word: str) -> bytes:
        """The ids of a space and the word; raises LookupError where the cut before that space is not safe."""
        if (plain := self._plain(word.lower() if self._lower else word)) and "<|" not in word:
            letters, marks, below, more = plain.groups()
            known = self._pieces
            ids = known[self._lead + letters]
            if marks:
                ids += known[marks]
            if below:
                ids += known["\n"] + known[below] if self._lead else known[below]
                if more:
                    ids += known[more]
            return ids
        if self._safe(word) and not any(s in word for s in self._special):
            known = self._pieces
            return b"".join([known[p] for p in self._pieces_of(" " + (word.lower() if self._lower else word))])
        if not word or word[0].isspace() or word[-1].isspace():
            raise LookupError(word)
        return self._whole([" " + word])[0]

    def word_ids(self, word: str) -> bytes:
        """The ids of a space and the word, by themselves."""
        try:
            return self._words[word]
        except LookupError:
            return self._whole([" " + word])[0]

    def spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a space and each word, one word after the other, and how many ids each has.

        Words hold no ASCII white space. Where the library's merges run in tiktoken all words go at once: an id that
        begins with a space begins a word.
        """
        if self._fast is not None and words:
            text = " " + " ".join(words)
            ids = np.frombuffer(array("I", self._fast.encode_ordinary(text)), "<u4")
            starts = np.flatnonzero(self._begins[ids])
            if len(starts) == len(words) and not any(s in text for s in self._special):
                return ids, np.diff(np.append(starts, len(ids)))
        found = [self.word_ids(w) for w in words]
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], dtype=np.int64)

    def turn(self) -> None:
        self._words.turn()
        self._pieces.turn()

    def encode(self, texts: list[str]) -> list[bytes]:
        if self._fast is None:
            return self._by_word(texts)
        out = []
        for text in texts:
            if self._usual(text) and not any(s in text for s in self._special):
                out.append(array("I", self._fast.encode_ordinary(text)).tobytes())
            else:
                out += self._by_word([text])
        return out

    def _by_word(self, texts: list[str]) -> list[bytes]:
        self.turn()
        get = self._words.__getitem__
        out: list[bytes] = [b""] * len(texts)
        heads, first, whole = [], [], []
        for i, text in enumerate(texts):
            head, *rest = text.split(" ")
            try:
                if head and head[-1].isspace():
                    raise LookupError(head)
                out[i] = b"".join(map(get, rest))
                heads.append(i)
                first.append(head)
            except LookupError:
                whole.append(i)
        for i, ids in zip(heads, self._whole(first)):
            out[i] = ids + out[i]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> WordCache:
    """One per worker process, kept from task to task."""
    return WordCache(path)
