"""Packing, packed files, token counts and BPE against the tokenizer libraries."""

import hashlib
import json
import random
import time
import tracemalloc
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import documents, edge_rows, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers.models import BPE

from shiftledger.llm import bitpack, bpe, counts, packing
from shiftledger.llm.tokens import WordCache, _byte_letters, encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.text(st.sampled_from("ab AB'.,!?\n\t é²½\xa0\x85日<|endoftext|>019"), max_size=60)


def library_ids(path, text):
    from tokenizers import Tokenizer

    if path not in _LIBRARY:
        _LIBRARY[path] = Tokenizer.from_file(path)
    return _LIBRARY[path].encode(text or "", add_special_tokens=False).ids


_LIBRARY = {}


@pytest.mark.parametrize("path", [BYTE, WORD])
@given(text=TEXT)
@settings(max_examples=150, deadline=None)
def test_cached_ids_equal_the_library(path, text):
    assert np.frombuffer(encoder(path).encode([text])[0], "<u4").tolist() == library_ids(path, text)


def test_every_vocabulary_string_encodes_as_in_the_library():
    cache = WordCache(BYTE)
    byte = {letter: b for b, letter in __import__("shiftledger.llm.tokens", fromlist=["x"])._byte_letters().items()}
    strings = []
    for token in _tokenizer(BYTE).get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(byte[c] for c in token).decode())
        except UnicodeDecodeError:
            continue
    library = _tokenizer(BYTE).encode_batch(strings, add_special_tokens=False)
    assert [np.frombuffer(x, "<u4").tolist() for x in cache.encode(strings)] == [e.ids for e in library]


def test_every_string_of_a_file_with_word_ends_merges_to_itself():
    """What the module's proof asks for, then words as in the library: those of the vocabulary, long ones and odd bytes."""
    cache = WordCache(WORD)
    with open(WORD, encoding="utf-8") as file:
        spec = json.load(file)["model"]
    alone = BPE(vocab=spec["vocab"], merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]])
    draw, suffix, letters = random.Random(3), spec["end_of_word_suffix"], list(_byte_letters().values())
    library, ended = _tokenizer(WORD).model, []
    for token, i in spec["vocab"].items():
        if token.endswith(suffix):
            ended.append(token.removesuffix(suffix))
            assert [t.id for t in library.tokenize(ended[-1])] == [i]
        else:
            assert [t.id for t in alone.tokenize(token)] == [i]
    byte = {letter: bytes([b]) for b, letter in _byte_letters().items()}
    words = ended[:3000] + ["".join(draw.choices(ended, k=draw.choice([2, 5, 400]))) for _ in range(300)] + ["".join(draw.choices(letters, k=30)) for _ in range(300)]
    for word in words:
        raw = b"".join(byte[c] for c in word)
        try:
            piece = raw.decode()
        except UnicodeDecodeError:
            piece = raw.decode("latin-1")  # its own letters, two bytes each
            word = piece.encode().decode("latin-1").translate(str.maketrans(_byte_letters()))
        if piece:
            assert np.frombuffer(cache._piece(piece), "<u4").tolist() == [t.id for t in library.tokenize(word)]


def test_a_worker_holds_few_cached_words():
    cache = WordCache(WORD)
    for known in (cache._words, cache._pieces):
        known._work_out, most = lambda word: b"", 0
        for lot in range(30):
            known.turn()
            for i in range(50_000):
                known[f"{lot} {i}"]
            most = max(most, len(known) + len(known._old))
        assert most <= 600_000


def _tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def stream_of(pieces, window):
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for number, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and len(p["ids"]) == 4 * p["length"] > 0
            at += p["length"]
        assert at == window or number == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return by_sequence


@pytest.mark.parametrize("window", [16, 2048])
def test_packing_places_every_token_once(spark, window):
    rows = edge_rows()
    pieces = rows_of(packing.pack(documents(spark, rows), BYTE, window))
    stream_of(pieces, window)
    expected = sorted((r[0] is None, r[0] or 0, np.array([*library_ids(BYTE, r[1]), 1], "<u4").tobytes()) for r in rows)
    docs = {}
    for p in sorted(pieces, key=lambda p: p["start"]):
        docs.setdefault((p["doc_id"], p["source"], p["doc_tokens"]), []).append(p)
    assert sum(p["length"] for p in pieces) == sum(len(x[2]) // 4 for x in expected)
    for (doc_id, _, n), own in docs.items():
        whole = [x[2] for x in expected if (None if x[0] else x[1]) == doc_id and len(x[2]) == 4 * n]
        if len(whole) == 1:
            assert b"".join(p["ids"] for p in own) == whole[0]


def test_windows_hold_the_target_shares(spark):
    rows = [(i, "word " * 400, "en", "ab"[i % 2] if i % 10 else "c") for i in range(200)]
    window, targets = 500, {"a": 3, "b": 1, "c": 1}
    pieces = rows_of(packing.pack(documents(spark, rows).repartition(7), BYTE, window, targets))
    total = {s: sum(p["length"] for p in pieces if p["source"] == s) for s in targets}
    first_dry = min(total[s] * 5 // w // window for s, w in targets.items())
    for number, own in stream_of(pieces, window).items():
        if number < first_dry - 1:
            for s, w in targets.items():
                assert abs(sum(p["length"] for p in own if p["source"] == s) - window * w / 5) <= 4


@given(totals=st.lists(st.integers(0, 5000), min_size=1, max_size=6), weights=st.lists(st.floats(0, 5), min_size=6, max_size=6), window=st.integers(1, 300))
@settings(max_examples=120, deadline=None)
def test_the_plan_is_a_bijection(totals, weights, window):
    plan = packing.plan_mixture(totals, weights[:len(totals)], window)
    seen = np.zeros(sum(totals), dtype=int)
    for source, n in enumerate(totals):
        for a in range(0, n, 777):
            b = min(n, a + 777)
            starts, ends, at = packing.places(plan, source, a, b, window)
            assert (np.append(ends, b)[:len(starts)] >= starts).all() and starts[0] == a and ends[-1] == b and (starts[1:] == ends[:-1]).all()
            for lo, hi, place in zip(starts, ends, at):
                assert place // window == (place + hi - lo - 1) // window
                seen[place:place + hi - lo] += 1
    assert (seen == 1).all()


def walked(totals, targets, window):
    """(source, token) in the order of a round-robin walked token by token, with deficits as exact fractions."""
    left, out, active = list(totals), [], [i for i, n in enumerate(totals) if n]
    taken = [0] * len(totals)
    while active:
        whole = sum(targets[i] for i in active)
        share = [targets[i] / whole if whole > 0 else 1 / len(active) for i in active]
        credit = [Fraction(max(1, round(x * packing._SCALE))) for x in share]
        quantum = [window * c / sum(credit) for c in credit]
        deficit = [Fraction(0)] * len(active)
        while all(left[i] >= int(d + q) for i, d, q in zip(active, deficit, quantum)):
            for j, i in enumerate(active):
                deficit[j] += quantum[j]
                for _ in range(int(deficit[j])):
                    out.append((i, taken[i]))
                    taken[i], left[i] = taken[i] + 1, left[i] - 1
                deficit[j] -= int(deficit[j])
        for j, i in enumerate(active):  # who cannot fill the round gives what is left
            if left[i] < int(deficit[j] + quantum[j]) or not left[i]:
                out += [(i, t) for t in range(taken[i], totals[i])]
                left[i] = 0
        active = [i for i in active if left[i]]
    return out


@given(totals=st.lists(st.integers(0, 300), min_size=1, max_size=5), weights=st.lists(st.integers(0, 40), min_size=5, max_size=5), window=st.integers(1, 60), cells=st.sampled_from([1, 7, 1 << 18]))
@settings(max_examples=150, deadline=None)
def test_places_are_those_of_a_walk(totals, weights, window, cells):
    packing._CELLS, before = cells, packing._CELLS
    try:
        plan = packing.plan_mixture(totals, [float(w) for w in weights[:len(totals)]], window)
        stream = [None] * sum(totals)
        for source, n in enumerate(totals):
            for a in range(0, n, 37):
                for lo, hi, at in zip(*packing.places(plan, source, a, min(n, a + 37), window)):
                    stream[at:at + hi - lo] = [(source, t) for t in range(lo, hi)]
    finally:
        packing._CELLS = before
    assert stream == walked(totals, weights, window)


def test_a_long_text_of_a_rare_source_is_placed_in_little_memory():
    totals = [200_000, *[10**11] * 19]
    plan = packing.plan_mixture(totals)
    ids = np.arange(200_000, dtype="<u4") % 50_000
    rows = pa.RecordBatch.from_arrays(
        [pa.array([5]), pa.array(["s0"]), pa.array([0]), pa.array([0]), pa.array([200_000]), pa.array([ids.tobytes()], pa.binary())],
        names=["doc_id", "source", "base", "before", "n", "ids"],
    )
    tracemalloc.start()
    found, at = [], 0
    for batch in packing._place(iter([rows]), plan, {f"s{i}": i for i in range(20)}, 2048):
        assert batch["ids"][0].as_py() == ids[at:at + batch["length"][0].as_py()].tobytes() and batch["start"][0].as_py() == at
        at += sum(batch["length"].to_pylist())
        found.append(batch.num_rows)
    assert tracemalloc.get_traced_memory()[1] < 100e6 and pa.total_allocated_bytes() < 100e6
    tracemalloc.stop()
    assert at == 200_000 and sum(found) > 190_000


def test_nothing_to_pack(spark):
    assert packing.pack(documents(spark, []), BYTE).count() == 0


@given(bits=st.integers(1, 32), data=st.data())
@settings(max_examples=80, deadline=None)
def test_bits_come_back(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=100)), dtype="<u4")
    packed = bitpack.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8) and (bitpack.unpack(packed, len(ids), bits) == ids).all()


def test_random_access(tmp_path):
    from pyarrow import fs

    draw = np.random.default_rng(3)
    docs = [draw.integers(0, 49408, n).astype("<u4") for n in (0, 1, 5000, 4096, 3, 20000)]
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "x")) as out:
        writer = bitpack.Writer(out, bitpack.bits_for(49408))
        for i, ids in enumerate(docs):
            writer.add(i, ids)
        writer.close()
    flat = np.concatenate(docs)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as file:
        reader = bitpack.Reader(file)
        assert reader.ids == len(flat) and reader.docs.tolist() == list(range(6))
        for a, b in [(0, 0), (0, 1), (4095, 4097), (5000, 29100), (0, len(flat)), (len(flat) - 1, len(flat))]:
            assert (reader.tokens(a, b) == flat[a:b]).all()
    assert bitpack.bits_for(49408) == 16 and bitpack.bits_for(2) == 1 and bitpack.bits_for(65537) == 17


def test_files_hold_the_documents_in_order(spark):
    rows = edge_rows()
    found = rows_of(bitpack.read_ids(bitpack.write_ids(documents(spark, rows), WORD)))
    found.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in found:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    wanted = sorted(zlib.crc32(np.array([*library_ids(WORD, r[1]), 1], "<u4").tobytes()) for r in rows)
    assert sorted(zlib.crc32(r["ids"]) for r in found) == wanted
    assert bitpack.read_ids(bitpack.write_ids(documents(spark, []), WORD)).count() == 0


def test_token_files_lie_where_spark_puts_them(spark, tmp_path):
    plain = bitpack.write_ids(documents(spark, [(1, "a b"), (2, None)]), WORD, root=str(tmp_path / "plain"))
    named = bitpack.write_ids(documents(spark, [(1, "a b"), (2, None)]), WORD, root=f"file:{tmp_path}/named")
    read, again = (sorted(rows_of(bitpack.read_ids(m)), key=lambda r: r["doc_id"]) for m in (plain, named))
    assert read == again and len(read) == 2
    assert {r["root"] for r in rows_of(plain)} == {f"file://{tmp_path}/plain"}
    assert list((tmp_path / "plain").glob("*.ids")) and list((tmp_path / "named").glob("*.ids"))
    # A root without a scheme follows Spark's default file system instead of a machine's own disk.
    hadoop = spark._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "har:///")
    try:
        with pytest.raises(Exception, match="har"):
            bitpack.shared_address(spark, "/ids")
    finally:
        hadoop.set("fs.defaultFS", before)
    assert bitpack.shared_address(spark, "s3a://bucket/ids") == "s3://bucket/ids"
    assert bitpack.shared_address(spark, "hdfs://host:8020/ids") == "hdfs://host:8020/ids"
    with pytest.raises(ValueError, match="unheard"):
        bitpack.shared_address(spark, "unheard://bucket/ids")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_vocabulary_reaches_to_the_largest_id(path):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()
    assert encoder(path).vocabulary == max(ids) + 1
    assert max(ids) + 1 >= len(ids)



def test_token_counts_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [*edge_rows(), (20, "a  b   c ", None), (21, "▁x ▁ y", None), (22, "<s> </s> <unk> <0x0A>", None), (23, "\x00 ﻿", None)]
    found = rows_of(counts.token_counts(documents(spark, rows), PIECES, limit=3))
    wanted = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in found) == wanted
    assert all(r["over_limit"] == (r["n_tokens"] > 3) for r in found)


@given(text=TEXT)
@settings(max_examples=150, deadline=None)
def test_counts_of_any_text(text):
    import sentencepiece

    if "sp" not in _LIBRARY:
        _LIBRARY["sp"] = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert counts.counter(PIECES).count([text]) == [len(_LIBRARY["sp"].encode(text))]


def test_whole_tokens_are_proved():
    whole = counts.counter(PIECES).whole
    assert "the" in whole and len(whole) > 10_000


def test_bpe_equals_tiktoken_and_decodes(spark):
    import tiktoken

    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={}
    )
    rows = [*edge_rows(), (30, "ab" * 400 + " " + "é" * 300, None)]
    found = rows_of(bpe.encode_decode(documents(spark, rows), RANKS, public_tokenizers.PATTERN))
    key = lambda doc_id, ids, text: (doc_id is None, doc_id or 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest())
    wanted = sorted(key(r[0], np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in rows)
    assert sorted(key(r["doc_id"], r["ids"], r["decoded"]) for r in found) == wanted


def test_long_words_equal_tiktoken_in_time():
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    own, draw = bpe.Bpe(RANKS, public_tokenizers.PATTERN), random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzéß"
    common = ["tion", "the", "ing", "er", "re", "con", "ment", "ly"]
    words = [
        "".join(draw.choice(letters) for _ in range(100_000)), "".join(draw.choice(common) for _ in range(25_000)), "x" * 20_001, "ab" * 5_003, "abc" * 4_001,
        "=" * 3_333, "é" * 2_001, " " * 5_000 + "x", "".join(draw.choice("aab") for _ in range(9_000)), "9" * 3_000,
        *("".join(draw.choice(draw.choice([letters, "ab", "the"])) for _ in range(draw.randint(257, 900))) for _ in range(60)),
    ]
    start = time.process_time()
    found = own.encode(words)
    assert time.process_time() - start < 90
    for word, (ids, text) in zip(words, found):
        assert text == word.encode() and ids == np.array(library.encode_ordinary(word), "<u4").tobytes()


def test_no_texts_no_tokens(spark):
    none = documents(spark, [])
    assert counts.token_counts(none, PIECES).count() == 0
    assert bpe.encode_decode(none, RANKS, public_tokenizers.PATTERN).count() == 0
