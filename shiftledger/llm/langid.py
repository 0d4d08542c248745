"""Language identification with error-correcting output codes.

Every language has a codeword of bits. One binary classifier per bit tells, from the byte trigrams of a text,
whether the language's bit is set: a linear model of log odds, from trigram counts over all labelled training texts, each
language weighing the same. Decoding adds up the loss of every bit against every codeword, weighted by how well the bit separates
its languages; the codeword with the least loss wins, and a text whose two best codewords are close is marked ambiguous. Close is measured
against the gap of an average training text of the language found; how close is calibrated on the training texts, so that clean ones stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftledger.llm.common import id_and_text, ship, slices

BUCKETS = 1 << 15
UNDETERMINED = "und"
AMBIGUOUS_BELOW = 0.35  # near ties of several languages, whatever their gaps
CLOSE = 0.3  # gaps below this share of an average text's are ambiguous,
CLEAN_FLAGGED = 0.005  # or below a smaller one, if more than this share of rightly told training texts would be
_STEPS = 300
_SLICE = 1 << 20
_SPACE = 0x20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _byte_table() -> np.ndarray:
    """ASCII that is no letter counts as a space; other bytes stay."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        if not chr(b).isalpha():
            table[b] = _SPACE
    return table


_BYTES = _byte_table()


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each byte trigram, text after text, and where each text's begin; every text gives one at least."""
    data = [b"  " + t.lower().encode() + b" " for t in texts]
    codes = _BYTES[np.frombuffer(b"".join([*data, b"  "]), np.uint8)].astype(np.uint32)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    buckets = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(17)
    # The last trigrams of a text reach into two spaces behind it, whether or not another text follows: no neighbour counts.
    return buckets, np.cumsum([0] + [len(d) for d in data[:-1]])


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 per language, all columns and their complements different.

    Up to five languages: every two-way split, so any two codewords differ in more than half of the bits. More: the best of some random
    codes of ten bits per doubling.
    """
    if languages <= 1:
        return np.ones((languages, 0), dtype=np.int8)
    if languages <= 5:
        splits = [s for s in product((1, -1), repeat=languages - 1) if -1 in s]
        return np.array([(1, *s) for s in splits], dtype=np.int8).T
    bits, draw = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(languages)
    codes = [draw.choice(np.array([1, -1], dtype=np.int8), (languages, bits)) for _ in range(50)]
    codes = [c for c in codes if (np.abs(c.sum(axis=0)) < languages).all()] or codes
    distance = lambda c: ((bits - c.astype(int) @ c.T)[~np.eye(languages, dtype=bool)] // 2).min()
    return max(codes, key=distance)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log odds of the bit
    scale: np.ndarray  # bits: the mean margin of a training text
    trust: np.ndarray  # bits: the least margin of a language over the mean one
    typical: np.ndarray  # languages x languages: the gap to the second codeword of an average text of the first, before its length counts
    close: float = CLOSE  # gaps below this share of the typical one are ambiguous

    def predict(self, texts: list[str]) -> list[tuple[str, float, str | None, bool]]:
        """Language, score from 0 to 1, second language, whether ambiguous."""
        judged = [i for i, t in enumerate(texts) if has_letter(t)]
        out: list[tuple[str, float, str | None, bool]] = [(UNDETERMINED, 0.0, None, False)] * len(texts)
        if not judged or not self.languages:
            return out
        if len(self.languages) == 1:
            for i in judged:
                out[i] = (self.languages[0], 1.0, None, False)
            return out
        for i, a, b, score, gap in zip(judged, *(c.tolist() for c in self.decode([texts[i] for i in judged]))):
            out[i] = (self.languages[a], score, self.languages[b], score < AMBIGUOUS_BELOW or gap < self.close)
        return out

    def decode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of texts with letters, and two languages at least: the best and second codeword, the best one's score, and the gap over the typical one."""
        buckets, starts = trigrams(texts)
        sizes = np.diff(np.append(starts, len(buckets)))
        margin = np.add.reduceat(self.weights[buckets], starts, axis=0, dtype=np.float64) / sizes[:, None]
        # Longer texts are surer, but their trigrams are far from independent.
        sure = np.minimum(8, np.sqrt(sizes / 8))
        z = margin / self.scale * sure[:, None]
        loss = np.stack([(np.logaddexp(0, -z * word) * self.trust).sum(axis=1) for word in self.code], axis=1)
        chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
        chance /= chance.sum(axis=1, keepdims=True)
        first, second = np.argsort(-chance, axis=1, kind="stable")[:, :2].T
        row = np.arange(len(texts))
        # Every bit in which two codewords differ adds its z to the gap, so a gap is the mean over the text's trigrams times its sureness.
        gap = (loss[row, second] - loss[row, first]) / (sure * self.typical[first, second])
        return first, second, chance[row, first], gap


def held_out(id_column: str = "doc_id") -> Column:
    """Rows without an id are held out: they have no remainder."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame) -> Model:
    """Learns from ``text`` and ``lang`` of all rows that have both and are not held out, and calibrates on the same rows.

    What reaches the driver is one number per language and bucket, and per step of the gap, whatever the number of rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part in slices(batches, limit=_SLICE):
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(part["text"].to_pylist(), part["lang"].to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                own += np.bincount(trigrams(texts)[0], minlength=BUCKETS)
        for lang, own in counts.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(own[used])],
                names=["lang", "bucket", "n"],
            )

    learn = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = id_and_text(learn, F.col("lang").cast("string").alias("lang")).select("text", "lang")
    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((len(languages), BUCKETS))
    place = {lang: i for i, lang in enumerate(languages)}
    rows_of = np.array([place[x] for x in found["lang"].to_pylist()], dtype=int)
    counts[rows_of, found["bucket"].to_numpy().astype(int)] = found["n"].to_numpy()
    code = codewords(len(languages))
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    weights = np.zeros((BUCKETS, code.shape[1]))
    for bit in range(code.shape[1]):
        on = code[:, bit] == 1
        weights[:, bit] = np.clip(np.log(share[on].mean(axis=0)) - np.log(share[~on].mean(axis=0)), -4, 4)
    margins = (share @ weights) * code  # of each language's average text, positive when right
    scale = np.maximum(margins.mean(axis=0), 1e-6) if len(languages) > 1 else np.ones(code.shape[1])
    trust = np.clip(margins.min(axis=0) / scale, 0.05, 1) if len(languages) > 1 else np.ones(code.shape[1])
    differs = code[:, None, :] != code[None, :, :]
    typical = ((margins / scale * trust)[:, None, :] * differs).sum(axis=2)
    model = Model(languages, code, weights.astype(np.float32), scale, trust, np.maximum(typical, 1e-3))
    if len(languages) > 1:
        model.close = _calibrated(rows, model)
    return model


def _calibrated(rows: DataFrame, model: Model) -> float:
    """The greatest share of the typical gap, CLOSE at most, below which no more than CLEAN_FLAGGED of the rightly told texts lie."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.zeros(_STEPS + 1, dtype=np.int64)
        for part in slices(batches, limit=_SLICE):
            labelled = [(t, lang) for t, lang in zip(part["text"].to_pylist(), part["lang"].to_pylist()) if has_letter(t)]
            if labelled:
                first, _, _, gap = model.decode([t for t, _ in labelled])
                right = np.array([model.languages[a] == lang for a, (_, lang) in zip(first.tolist(), labelled)])
                steps += np.bincount(np.minimum(gap[right] / CLOSE * _STEPS, _STEPS).astype(int), minlength=_STEPS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_STEPS + 1)), pa.array(steps)], names=["step", "n"])

    found = rows.mapInArrow(count, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).toArrow()
    steps = np.zeros(_STEPS + 1, dtype=np.int64)
    steps[found["step"].to_numpy()] = found["n"].to_numpy()
    below = np.cumsum(steps)[:-1]  # up to the end of each step
    return CLOSE * int(np.searchsorted(below, CLEAN_FLAGGED * steps.sum(), side="right")) / _STEPS


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, lang_second, ambiguous`` of every row, from its whole text alone.

    Null text and text without a letter are ``und`` with score 0; so is all text if nothing was learned.
    Ids may be null or repeat; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=_SLICE):
            lang, score, second, unsure = (list(c) for c in zip(*model.predict(part["text"].to_pylist())))
            yield pa.RecordBatch.from_arrays([
                part["doc_id"], part["held_out"], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                pa.array(second, pa.string()), pa.array(unsure, pa.bool_()),
            ], names=["doc_id", "held_out", "lang_pred", "score", "lang_second", "ambiguous"])

    return id_and_text(docs, held_out().alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, lang_second string, ambiguous boolean"
    )


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is determined and not ambiguous, with the columns they came with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=_SLICE):
            found = model.predict([t or "" for t in part["text"].to_pylist()])
            keep = pa.array([lang != UNDETERMINED and not unsure for lang, _, _, unsure in found], pa.bool_())
            yield part.filter(keep)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
