"""Personal data, language, exact and near copies, language model and the pipeline against plain walks."""

import collections
import json
import math
import pathlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from cases import documents, edge_rows, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from shiftledger.llm import attention, dedup, jaccard, langid, lm, pii
from shiftledger.llm.common import id_and_text

SF = "/root/testdata/sf0.01"


def plain_spans(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(digits) <= 19 and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0:
            found.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@given(st.text(st.sampled_from("@.+- ()aZé%0123456789\n"), max_size=80))
@settings(max_examples=500, deadline=None)
def test_base_spans_are_the_patterns(text):
    assert [s for s in pii.find(text) if s[0] in pii.BASE] == plain_spans(text)


def test_cards_and_masks():
    text = "pay 4111 1111 1111 1111 or +1 (279) 555-0216, IBAN DE89370400440532013000, see ftp://joe:pw@host.org/x token = \"abcdef0123456789\""
    assert [s[0] for s in pii.find(text)] == ["card", "phone", "account", "url", "email", "secret"]
    masked = pii.mask(text, pii.find(text))
    assert "4111" not in masked and "555" not in masked and "DE89" not in masked and "joe" not in masked and "abcdef" not in masked
    assert pii.mask("plain", []) == "plain"


def test_long_runs_take_linear_time_and_end():
    """A megabyte of one kind of character behind every cue, and of cues inside one another's values."""
    cues = ["", "a@", "+1", "x://", "x://u@", *pii._ACCOUNT_CUES, *(f"{c.upper()} DE12" for c in pii._ACCOUNT_CUES), *pii._SECRET_CUES, "token="]
    runs = ["1", "A", "a", ".", " ", "\t", "@", "=", "-", "1.", "1 ", "A1", "iban1", "IBAN1", "token=", "account ", "+1", "a@b.", "x://", "("]
    start = time.process_time()
    for cue in cues:
        for run in runs:
            pii.find(cue + run * (1_000_000 // len(run) // (1 if cue in ("", "iban", "token=") else 20)))
    assert time.process_time() - start < 200
    assert pii.find("iban DE12" + "3" * 5000) == [] and pii.find("account" + " " * 20_000 + "123456") == [("account", 20_007, 20_013)]
    assert pii.find("token=token=abcdefgh") == [("secret", 6, 20), ("secret", 12, 20)][:1]
    assert pii.find("iban DE89 3704 0044 0532 0130 00") == [("account", 5, 32)] and pii.find("account " + "1 " * 34 + "x")[0] == ("account", 8, 75)
    assert pii.find("account " + "1" * 35) == [] and pii.find("account " + "1 " * 60) == []


def test_spans_and_masked_rows(spark):
    rows = [*edge_rows(), (40, "mail a.b@c.org now", "en", "s"), (41, "1.2.3.4 and 999.1.1.1", "en", "s")]
    docs = documents(spark, rows)
    found = rows_of(pii.digest(pii.spans(docs)))
    assert len(found) == len(rows)
    assert next(r for r in found if r["doc_id"] == 40)["spans"] == "email:5:14"
    assert next(r for r in found if r["doc_id"] == 41)["n_ip"] == 1
    masked = pii.masked(docs)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    row = next(r for r in rows_of(masked) if r["doc_id"] == 40)
    assert row["text"] == "mail <EMAIL> now" and row["n_chars"] == len(row["text"])
    assert pii.digest(pii.spans(documents(spark, []))).count() == 0


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = found.where("lang_pred = lang").count(), found.count()
    assert n > 300 and right / n >= 0.97


def test_language_edges(spark):
    docs = documents(spark, edge_rows())
    model = langid.fit(docs)
    found = rows_of(langid.predict(docs, model))
    assert len(found) == len(edge_rows())
    for r in found:
        assert 0 <= r["score"] <= 1
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[2]["lang_pred"] == by_id[3]["lang_pred"] == by_id[10]["lang_pred"] == "und" and by_id[None]["held_out"]
    assert by_id[1]["held_out"] == (zlib.crc32(b"1") % 3 == 1)
    none = documents(spark, [(1, "abc", None, None)])
    assert rows_of(langid.predict(none, langid.fit(none)))[0]["lang_pred"] == "und"
    one = documents(spark, [(i, "abc", "en", None) for i in range(5)])
    assert {r["lang_pred"] for r in rows_of(langid.predict(one, langid.fit(one)))} == {"en"}
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < len(edge_rows())


@pytest.mark.parametrize("languages", [("de", "en"), ("es", "fr"), ("de", "en", "es", "fr")])
def test_half_and_half_texts_are_ambiguous(spark, languages):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang").isin(*languages))
    model = langid.fit(docs)
    clean, by = [r for r in rows_of(docs) if r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1], collections.defaultdict(list)
    for r in clean:
        if len(r["text"]) >= 200:
            by[r["lang"]].append(r["text"])
    draw, mixed = random.Random(6), []
    for _ in range(300):
        a, b = (draw.choice(by[lang]).encode() for lang in draw.sample(languages, 2))
        n = min(len(a), len(b), draw.choice([100, 400, 1500]))
        mixed.append(f"{a[:n].decode(errors='ignore')} {b[:n].decode(errors='ignore')}")
    flagged = [p[3] for p in model.predict(mixed)]
    assert sum(flagged) / len(flagged) > 0.85
    found = [p[3] for p in model.predict([r["text"] for r in clean]) if p[0] != "und"]
    assert sum(found) / len(found) < 0.01
    rows = [(i, t, None, None) for i, t in enumerate(mixed)]
    assert langid.keep_identified(documents(spark, rows), model).count() == len(mixed) - sum(flagged)


@pytest.mark.parametrize("languages", [2, 3, 4, 5, 6, 12, 40])
def test_codewords_differ(languages):
    code = langid.codewords(languages).astype(int)
    distance = (code[:, None, :] != code[None, :, :]).sum(axis=2) + 10**6 * np.eye(languages, dtype=int)
    assert distance.min() >= max(1, code.shape[1] // 4) and (np.abs(code.sum(axis=0)) < languages).all()


def plain_groups(rows):
    groups = collections.defaultdict(list)
    for i, r in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0, i))
    return {i: (rows[min(g)[3]][0], len(g)) for g in groups.values() for *_, i in g}


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_dedup_is_whole(spark, partitions):
    draw = random.Random(1)
    rows = [*edge_rows(), *[(100 + i, draw.choice(["hot text", "hot  text", f"t {i % 40}", f"u{i}"]), None, None) for i in range(600)]]
    docs = documents(spark, rows)
    found = rows_of(dedup.dedup(docs, partitions=partitions))
    plain = plain_groups(rows)
    key = lambda doc_id, keep, size: (doc_id is None, doc_id or 0, keep is None, keep or 0, size)
    assert sorted(key(r["doc_id"], r["keep_id"], r["group_size"]) for r in found) == sorted(key(rows[i][0], *plain[i]) for i in plain)
    groups = collections.defaultdict(list)
    for r in found:
        groups[r["text_sha256"]].append(r)
    for own in groups.values():
        assert len({r["keep_id"] for r in own}) == 1 and sum(r["kept"] for r in own) == 1 and len(own) == own[0]["group_size"]


def test_dedup_carries_the_rows_that_stay(spark):
    docs = documents(spark, edge_rows())
    kept = dedup.dedup(docs, carry=tuple(docs.columns)).where("kept").select("row.*")
    assert kept.columns == docs.columns and kept.count() == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in edge_rows()})
    assert dedup.dedup(documents(spark, [])).count() == 0


def plain_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain_components(rows):
    sets = [plain_sets(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), math.inf), math.inf if r[0] is None else r[0])
    return [(r[0], len(sets[i]), None if least[find(i)] == math.inf else least[find(i)]) for i, r in enumerate(rows)]


def near_copies(seed, size):
    """Groups of edited copies, some large; chains in which each text is a step from the one before; texts of a few words; shared passages."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [draw.choice(words) for _ in range(60)]
    rows = []
    for group in range(size):
        length = draw.choice([4, 5, 6, 7, 8, 9, 12, 20, 40, 90, 150, 400])
        text = [draw.choice(words) for _ in range(length)]
        if group % 5 == 0:
            text = passage[:draw.randint(20, 60)] + text
        for _ in range(draw.choice([1, 1, 2, 3, 6, 25 if group % 7 == 0 else 2])):
            if group % 3 == 0:
                now = text = list(text)  # a chain
            else:
                now = list(text)
            for _ in range(draw.choice([0, 1, 1, 2])):
                now[draw.randrange(len(now))] = draw.choice(words)
            if draw.random() < 0.3:
                now.append(draw.choice(words))
            rows.append((len(rows) * 3 + 1, " ".join(now).replace("w1", "W1") if draw.random() < 0.3 else "  ".join(now), None, None))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("dear", [2, 8])
def test_jaccard_components_are_exact(spark, monkeypatch, dear):
    monkeypatch.setattr(jaccard, "LIST", dear)
    rows = [*edge_rows(), *near_copies(dear, 60)]
    rows = [r if r[0] != 8 else (8, r[1]) for r in rows]
    found = rows_of(jaccard.jaccard_components(documents(spark, rows)).select("doc_id", "n_shingles", "component_id"))
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r.values()) for r in found), key=order) == sorted(plain_components(rows), key=order)


def test_groups_compared_in_blocks(spark, monkeypatch):
    """Copies that are each near one text but often not near each other, and a passage that makes many texts half alike."""
    monkeypatch.setattr(jaccard, "_BLOCK", 7)
    monkeypatch.setattr(jaccard, "_COLUMNS", 50)
    monkeypatch.setattr(jaccard, "LIST", 3)
    draw = random.Random(12)
    word = lambda: f"v{draw.randrange(3000)}"
    rows, base = [], [word() for _ in range(70)]
    for i in range(70):
        text = list(base)
        for _ in range(draw.randint(1, 4)):
            text[draw.randrange(70)] = word()
        rows.append((i, " ".join(text if i % 4 else base[:45] + [word() for _ in range(draw.randint(8, 20))])))
    docs = documents(spark, rows)
    found = [tuple(r) for r in jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(found) == sorted(plain_components(rows)) and len({c for *_, c in found}) > 5


def test_sets_that_link_share_a_key():
    """The pigeonhole: with all keys at hand a linked pair meets, unless one fills too few segments."""
    draw = np.random.default_rng(2)
    for _ in range(300):
        n = int(draw.integers(3, 700))
        one = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
        other = one.copy()
        drop = int(draw.integers(0, n // 7 + 1))
        other = np.unique(np.concatenate([other[drop:], draw.integers(0, 2**63, drop, dtype=np.uint64)]))
        both = len(np.intersect1d(one, other))
        if 100 * both < 75 * (len(one) + len(other) - both) or len(other) < 3 or both == len(one) == len(other):
            continue
        small, large = sorted((one, other), key=len)
        band = jaccard.band_of(len(small))
        (a, _), (b, _) = jaccard.keys([small], [band]), jaccard.keys([large], [band])
        enough = len(a) >= jaccard.credits_own(np.array([len(small)]))[0]
        assert not enough or len(np.intersect1d(a, b)) >= len(a) - (len(small) + len(large)) // 7 > 0


def test_neighbourhoods_meet_at_one_difference():
    draw = np.random.default_rng(5)
    for _ in range(60):
        one = np.unique(draw.integers(0, 2**63, int(draw.integers(20, 300)), dtype=np.uint64))
        other = one[1:]
        band = jaccard.band_of(len(other))
        (seg, key, full), (seg_, key_, full_) = jaccard.variants(one, band), jaccard.variants(other, band)
        touched = int((one[0] >> np.uint64(20)) % np.uint64(jaccard.segments(band)))
        mine, theirs = {int(k) for k in key[(seg == touched) & ~full]}, {int(k) for k in key_[(seg_ == touched) & full_]}
        assert (len(theirs) == 1 and theirs <= mine) or (not theirs and not mine)  # unless the shingle was alone
        assert set(key[full & (seg != touched)].tolist()) == set(key_[full_ & (seg_ != touched)].tolist())
        assert full.sum() == len(jaccard.keys([one], [band])[0]) and set(key[full].tolist()) == set(jaccard.keys([one], [band])[0].tolist())


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ids_of_other_types_find_the_same_copies(spark, kind):
    docs = documents(spark, near_copies(3, 20))
    found, same = (sorted(tuple(r) for r in jaccard.jaccard_components(d).select("doc_id", "n_shingles", "component_id").collect())
                   for d in (docs, docs.withColumn("doc_id", F.col("doc_id").cast(kind))))
    assert found == same and any(c != i for i, n, c in found if n)


def test_jaccard_without_rows(spark):
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_long_chains_become_one_component(spark, monkeypatch, one_task):
    monkeypatch.setattr(jaccard, "EDGES_IN_A_TASK", one_task)
    order = list(range(300))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(299)] + [(1000, 1001)], "a long, b long")
    found = {r["v"]: r["root"] for r in rows_of(jaccard.components(edges))}
    assert set(found.values()) == {0, 1000} and len(found) == 302


BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_base_scores_are_exact(spark):
    rows = [*edge_rows(), *[(200 + i, f"the word {i % 7} the Word", None, None) for i in range(60)]]
    found = rows_of(lm.score(documents(spark, rows), BYTE))
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    count = collections.Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    total, distinct = sum(count.values()), len(count)

    def line(r):
        own = tokens(r[1])
        base = sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        return (r[0] is None, r[0] or 0, held(r[0]), len(own), sum(count[w] > 0 for w in own), total, round(base, 4))

    names = ("held_out", "n_tokens", "n_known", "train_tokens")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[n] for n in names), round(r["base_score"], 4)) for r in found) == sorted(map(line, rows))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    assert lm.score(documents(spark, []), BYTE).count() == 0


def test_probabilities_add_up_and_each_token_counts_once():
    draw = np.random.default_rng(0)
    pairs = draw.poisson(0.05, (attention.RANKS, attention.RANKS)).astype(float)
    counted = attention.Counted.of(pairs)
    w = attention.fresh_weights(attention.RANKS, counted.classes_after.shape[1])
    w["out"] = draw.normal(0, 0.3, w["out"].shape).astype(np.float32)
    text = np.append(0, draw.integers(0, attention.RANKS, 150))
    found = attention.score(w, counted, text)
    assert len(found) == 150
    # The same from one window per token, cut where the overlapping windows cut.
    for t in (0, 5, 31, 32, 60, 149):
        start = 0 if t < attention.WINDOW else (t - attention.WINDOW) // attention.STRIDE * attention.STRIDE + attention.STRIDE
        x = np.zeros((1, attention.WINDOW), dtype=int)
        x[0, :t - start + 1] = text[start:t + 1]
        total = 0.0
        for nxt in range(attention.RANKS):
            z, _ = attention.forward(w, counted, x)
            y = np.full((1, attention.WINDOW), counted.classes[nxt])
            p = float(np.exp(attention.log_classes(z, y)[0, t - start] + counted.inside[text[t], nxt]))
            total += p
            if nxt == text[t + 1]:
                assert math.isclose(math.log(p), found[t], rel_tol=1e-3)
        assert math.isclose(total, 1, rel_tol=1e-3)


def test_gradients_follow_the_loss():
    draw = np.random.default_rng(1)
    counted = attention.Counted.of(draw.poisson(0.5, (40, 40)).astype(float))
    w = {k: v.astype(np.float64) for k, v in attention.fresh_weights(40, counted.classes_after.shape[1]).items()}
    w["out"] += draw.normal(0, 0.2, w["out"].shape)
    x, y = draw.integers(0, 40, (3, attention.WINDOW)), draw.integers(0, counted.classes_after.shape[1], (3, attention.WINDOW))
    ones = np.ones(x.shape)
    _, grads = attention.gradients(w, counted, x, y, ones)
    for name in w:
        at = np.unravel_index(np.abs(grads[name]).argmax(), w[name].shape)
        up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        up[name][at] += 1e-4
        down[name][at] -= 1e-4
        slope = (attention.gradients(up, counted, x, y, ones)[0] - attention.gradients(down, counted, x, y, ones)[0]) / 2e-4
        assert math.isclose(slope, grads[name][at], rel_tol=0.05)


def test_a_training_step_copies_no_table(monkeypatch):
    ranks, classes = 200_000, 4
    counted = attention.Counted.of_classes(np.arange(ranks) % classes, np.ones(ranks), np.ones((ranks, classes)))
    w = attention.fresh_weights(ranks, classes)
    windows, valid = attention.windows(np.append(0, np.random.default_rng(2).integers(0, ranks, 3000)))
    counted.classes_after  # a table of its own, made once
    grown, step = [], attention._gradients

    def watched(*given):
        before = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        found = step(*given)
        grown.append(tracemalloc.get_traced_memory()[1] - before)
        return found

    monkeypatch.setattr(attention, "_gradients", watched)
    tracemalloc.start()
    try:
        got, steps = attention.train(w, counted, windows, valid, 0.01)
    finally:
        tracemalloc.stop()
    # The weights by rank are 51 MB.
    assert len(grown) == 2 and max(grown) < 20 << 20
    seen = np.zeros(ranks, dtype=bool)
    seen[windows[:, :-1]] = True
    assert ((steps > 0) == seen).all() and all((got[k][~seen] == w[k][~seen]).all() for k in ("query", "key", "value", "gate"))
    assert got["near"].shape == w["near"].shape and (got["out"] != w["out"]).any() and got["out"].shape == w["out"].shape


def test_rows_of_one_key_are_summed():
    draw = np.random.default_rng(4)
    for keys in (np.empty(0, dtype=np.int64), draw.integers(0, 3, 1), draw.integers(0, 900, 1000), np.minimum(draw.zipf(1.3, 3000), 70_000), np.full(50, 7)):
        rows = draw.normal(size=(len(keys), 4)).astype(np.float32)
        found, sums = attention._runs(keys, rows)
        wanted = np.zeros((70_001, 4))
        np.add.at(wanted, keys, rows)
        assert sorted(found.tolist()) == np.unique(keys).tolist() and np.allclose(sums, wanted[found], atol=1e-3)


def test_scores_of_large_odds_have_the_ceiling():
    draw = np.random.default_rng(5)
    counted = attention.Counted.of(draw.poisson(0.3, (300, 300)).astype(float))
    x, y = draw.integers(0, 300, (2, 6)), draw.integers(0, counted.classes_after.shape[1], (2, 6))
    for wide in (1, 30):  # 30: odds beyond the ceiling
        h, out = (np.abs(draw.normal(size=s)).astype(np.float32) * w for s, w in (((2, 6, attention.WIDTH), 1), ((attention.WIDTH, counted.classes_after.shape[1]), wide)))
        wanted = attention.log_classes(attention._log_odds(h, out, counted, x), y)
        assert np.allclose(attention._log_chances(h, out, np.maximum(out.max(axis=1), 0), counted, x, y), wanted, rtol=1e-4, atol=1e-4)
        assert np.isfinite(wanted).all()


def test_words_by_arrow_are_those_of_python():
    texts = ["", " ", "  lead", "trail \n", "A\tB\x0bC\x0cD\rE\nF", "\x1c a\x1d b\x1e\x1f", "É À İ K", "\x85a b\xa0c\u2003d", "a\0b \0", "x  y x"]
    for own in (texts, texts[2:3], texts[:2], texts[-1:]):
        listed, flat, lengths = lm._numbered(pa.array(own))
        cut = [[listed[i].encode() for i in part.tolist()] for part in np.split(flat, np.cumsum(lengths)[:-1])]
        assert cut == [[*lm.words(t), lm.END_WORD] for t in own]
        assert len(set(listed)) == len(listed) and listed[0] == ""


def test_counts_of_words_meet():
    asked = [(0, [b"", b"a", "é".encode()], [3, 2, 0]), (1, [b"a"], [5]), (2, [b""], [1]), (3, [b"b", b""], [0, 0])]
    got = lm._meet(pa.table({
        "chunk": pa.array([c for c, _, _ in asked]), "bucket": pa.array([9] * 4, pa.int32()), "words": pa.array([b" ".join(w) for _, w, _ in asked], pa.binary()),
        "counts": pa.array([np.array(n, "<i8").tobytes() for _, _, n in asked], pa.binary()),
    })).to_pylist()
    assert [(r["chunk"], np.frombuffer(r["counts"], "<i8").tolist()) for r in got] == [(0, [4, 7, 0]), (1, [7]), (2, [4]), (3, [0, 4]), (-1, [2, 11])]


def chunks(docs):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True)).alias("held_out")
    return id_and_text(docs, held).mapInArrow(lambda b: lm._chunks(b, BYTE, 4), lm._CHUNK).where("kind = 1")


def test_all_training_subwords_are_trained_on(spark):
    texts = [f"the word {i} and {i * 7 % 1000} others are here" for i in range(3000)]
    spell = lm.encoder(BYTE)
    wanted = sum(1 + int(spell.spell([w.decode() for w in lm.words(t)])[1].sum()) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10)
    ranks = lm.Ranks(np.zeros(spell.vocabulary))

    def count(batches):
        yield pa.RecordBatch.from_arrays([pa.array([int(lm._windows(batches, ranks)[1].sum())])], names=["n"])

    docs = documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    assert chunks(docs).mapInArrow(count, "n long").groupBy().sum("n").first()[0] == wanted
    for n in (1, 2, 33, 34, 1000):  # each once
        windows, valid = attention.windows(np.arange(n))
        assert sorted(windows[:, 1:][valid].tolist()) == list(range(1, n))


def test_equal_texts_have_equal_scores(spark):
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["salt", "river", "Stone", "of", "the", "light"]) for _ in range(draw.choice([1, 5, 40, 90]))) for _ in range(150)]
    rows = [(i, texts[i % 150], None, None) for i in range(600)]
    draw.shuffle(rows)
    scores = collections.defaultdict(list)
    for parts in (1, 3, 8):
        for r in rows_of(lm.score(documents(spark, rows).repartition(parts), BYTE)):
            scores[texts[r["doc_id"] % 150]].append(r["score"])
    assert len(scores) > 100 and sum(map(len, scores.values())) == 1800
    assert all(math.isclose(min(own), max(own), rel_tol=1e-4) for own in scores.values())


def test_rare_subwords_have_a_context(spark):
    spell, draw = lm.encoder(BYTE), random.Random(9)
    vocabulary = json.loads(pathlib.Path(BYTE).read_text())["model"]["vocab"]
    names = sorted(t[1:] for t in vocabulary if re.fullmatch("\u0120[a-z]{4,}", t))
    names = [w for w, n in zip(names, spell.spell(names)[1].tolist()) if n == 1][:3000]
    after = dict(zip(names, names[1:] + names[:1]))
    text = lambda own, then: " ".join(f"{w} {then[w]}" for w in own)
    own = names[2000:2950:50]  # rarer than the first 2,000
    rows = [(i, text(draw.sample(names[:2000], 50) + draw.sample(names[2000:], 10), after), None, None) for i in range(800)]
    rows += [(10_000, text(own, after), None, None), (10_001, text(own, dict(zip(own, [after[w] for w in own[1:] + own[:1]]))), None, None)]
    found = {r["doc_id"]: r["score"] for r in rows_of(lm.score(documents(spark, rows), BYTE))}
    assert len(names) == 3000 and found[10_000] > found[10_001] + 10  # the same words, behind others


def test_the_model_beats_counting_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = lm.score(docs, BYTE).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert found.s > found.b


def test_pipeline_equals_a_plain_walk(spark, tmp_path):
    rows = [*near_copies(9, 40), *edge_rows(), (5000, "write to joe@mail.org or 10.0.0.1 today my friend", "en", "z"), (5001, "12 34 --", "en", "z")]
    docs = documents(spark, rows).drop("keep_id", "n_tokens", "ids", "score", "part", "run", "class", "bucket", "spans", "row")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    # The walk: languages by the fitted model, one text after the other; then copies, near copies, masks and ids.
    model = langid.fit(docs)
    left = [r for r in rows if (p := model.predict([r[1] or ""])[0])[0] != "und" and not p[3]]
    groups = collections.defaultdict(list)
    for i, r in enumerate(left):
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append((-len(r[1]), r[0] is None, r[0] or 0, i))
    left = [left[min(g)[3]] for g in groups.values()]
    named = plain_components(left)
    left = [r for r, (doc_id, n, component) in zip(left, named) if not n or doc_id is None or doc_id == component]
    from test_llm_tokens import library_ids

    wanted = sorted((r[0] is None, r[0] or 0, len(library_ids(BYTE, pii.mask(r[1], pii.find(r[1])))) + 1) for r in left)
    assert sorted({(p["doc_id"] is None, p["doc_id"] or 0, p["doc_tokens"]) for p in pieces}) == wanted
    assert sum(p["length"] for p in pieces) == sum(n for *_, n in wanted)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "n-gram Jaccard join", "PII", "packing"]


def test_pipeline_with_clashing_columns_and_without_rows(spark, tmp_path):
    docs = documents(spark, [*near_copies(4, 12), *edge_rows()])
    stages = dict(corpus_pipeline.STAGES)
    rows = docs
    for name in ("language ID", "exact dedup", "n-gram Jaccard join", "PII"):
        before = rows.count()
        rows = stages[name](spark, rows, str(tmp_path))
        rows.write.parquet(str(tmp_path / name.replace(" ", "-")))
        rows = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        assert rows.columns == docs.columns and 0 < rows.count() <= before
    pieces = stages["packing"](spark, rows, str(tmp_path))
    assert pieces.where("start = 0").count() == rows.count()
    none = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
    assert langid.predict(none, langid.fit(none)).count() == 0


def test_languages_are_decoded_as_in_a_plain_walk(spark):
    """Loss-weighted decoding by the definition, one text and one codeword after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    texts = [r["text"][:n] for r, n in zip(rows_of(docs.where("length(text) > 300").limit(40)), [30, 80, 200, 300] * 10)]
    first, second, chance, _ = model.decode(texts)
    for i, text in enumerate(texts):
        buckets, _ = langid.trigrams([text])
        margin = sum(model.weights[b].astype(float) for b in buckets.tolist()) / len(buckets)
        z = margin / model.scale * min(8, math.sqrt(len(buckets) / 8))
        loss = [sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, z, word)) for word in model.code]
        order = sorted(range(len(loss)), key=loss.__getitem__)
        total = sum(math.exp(loss[order[0]] - x) for x in loss)
        assert (first[i], second[i]) == tuple(order[:2]) and math.isclose(chance[i], 1 / total, rel_tol=1e-6)


@given(st.lists(st.text(max_size=12), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_trigrams_know_no_neighbours(texts):
    buckets, starts = langid.trigrams(texts)
    for text, own in zip(texts, np.split(buckets, starts[1:])):
        assert langid.trigrams([text])[0].tolist() == own.tolist()
