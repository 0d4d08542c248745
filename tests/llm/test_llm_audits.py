"""Source divergence, conversation repair and near copies of vectors against plain walks."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, edge_rows, rows_of

from shiftledger.llm import common, dialogue, divergence, neardup

# --- source divergence ---------------------------------------------------------------------


def plain_divergences(rows, min_docs=3, top=200):
    counts, docs, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        counts.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    found = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: B023, E731
        p = {s: {t: share(counts[lang, s, t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        gap = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            lists = {
                "pair": [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s],
                "term": [(t, gap(p[s][t], q[t])) for t in kept if counts[lang, s, t] and p[s][t] > q[t]],
            }
            for part, own in lists.items():
                own.sort(key=lambda x: (-x[1], x[0].encode()))
                found += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(own[:top] if part == "term" else own, 1)]
    return sorted(found)


def spoken(seed, n, langs=3, sources=6, words=120):
    draw = random.Random(seed)
    word = lambda lang, s: draw.choice("aZéß") * draw.randint(1, 2) + f"{chr(97 + (int(draw.expovariate(0.05)) + s * 7 + lang) % words % 26)}{draw.choice('xyé')}"
    rows = []
    for i in range(n):
        lang, s = draw.randrange(langs), int(draw.triangular(0, sources, 0))
        text = draw.choice([" ", "-", "1"]).join(word(lang, s) for _ in range(draw.choice([0, 1, 5, 40])))
        rows.append((i, draw.choice([text, text.upper()]), f"l{lang}", f"s{s}" if draw.random() < 0.9 else None))
    return rows


@pytest.mark.parametrize("top", [3, 200])
def test_divergences_are_exact(spark, top):
    rows = [(r[0], r[1], r[2], r[3]) for r in edge_rows()] + spoken(1, 400) + [(900 + i, None, "zz", f"o{i}") for i in range(3)]
    found = divergence.divergences(documents(spark, rows).repartition(7), top=top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(found.dtypes)["rank"] == "int"
    assert sorted(tuple(r) for r in found.collect()) == plain_divergences(rows, top=top)
    assert divergence.divergences(documents(spark, [])).count() == 0


@pytest.mark.parametrize("cells", [1 << 22, 8])
def test_spilled_stripes_merge_and_emit_the_same(monkeypatch, cells):
    """One task after the other, without Spark: a spill after every few documents, a few bytes of a text at a time, sums flushed early."""
    monkeypatch.setattr(divergence, "_TEXT", 5)
    monkeypatch.setattr(divergence, "SPILL", 40)
    monkeypatch.setattr(divergence, "_CELLS", cells)
    rows = spoken(2, 150, langs=2)
    batch = pa.table({"lang": [r[2] for r in rows], "source": [r[3] or "" for r in rows], "text": [r[1] for r in rows]}).to_batches()
    blocks = pa.Table.from_batches(list(divergence._fold(iter(batch), 5)))
    assert blocks.num_rows > 50
    merged = [divergence._merge(3)(blocks.filter(pa.compute.equal(blocks["bucket"], b))) for b in range(5) if b in blocks["bucket"].to_pylist()]
    merged = pa.concat_tables(merged).to_pylist()
    by_lang = collections.defaultdict(collections.Counter)
    for r in merged:
        by_lang[r["lang"]].update(dict(zip(r["names"], r["sums"])))
    sizes = collections.Counter()
    for r in merged:
        sizes[r["lang"]] += r["n_terms"]
    for r in merged:
        names = sorted(by_lang[r["lang"]])
        r |= {"v": sizes[r["lang"]], "sources": names, "totals": [by_lang[r["lang"]][s] for s in names]}
    out = pa.Table.from_batches(list(divergence._emit(iter(pa.Table.from_pylist(merged).to_batches()), 200))).to_pylist()
    pairs = collections.Counter()
    for r in out:
        if r["part"] == "pair":
            pairs[r["lang"], r["source"], r["item"]] += r["value"]
    wanted = plain_divergences(rows)
    assert dict(pairs) == {(x[0], x[1], x[3]): x[4] for x in wanted if x[2] == "pair"}
    assert sorted((r["lang"], r["source"], r["item"], r["value"]) for r in out if r["part"] == "term") == sorted((*x[:2], *x[3:5]) for x in wanted if x[2] == "term")


def test_a_task_hands_on_a_row_per_source_and_part(spark, monkeypatch):
    """Whatever the number of other sources (up to a strip's) and of terms: rows grow with tasks and sources only."""
    kept = {}

    def written(df, name, *more):
        kept[name] = common.written(df, name, *more)
        return kept[name]

    monkeypatch.setattr(divergence, "written", written)
    rows = spoken(4, 300)
    found = divergence.divergences(documents(spark, rows))
    assert sorted(tuple(r) for r in found.collect()) == plain_divergences(rows)
    tasks = len(kept["divergences"].inputFiles())
    assert 0 < kept["divergences"].count() <= 2 * tasks * len({(r[2], r[3]) for r in rows})


@pytest.mark.parametrize("size", [7, 1000])
def test_lists_of_several_tasks_are_gathered(size):
    draw, flat = random.Random(size), []
    for _ in range(3):
        flat += [("x", f"s{i}", "pair", f"s{j}", draw.randrange(99), j // 4) for i in range(10) for j in range(10) if i != j]
    flat += [("x", f"s{i % 2}", "term", f"t{i}", draw.randrange(9), 0) for i in sorted(range(60), key=lambda i: (i // 20, i % 2))]
    names = ["lang", "source", "part", "item", "value", "strip"]
    columns = pa.table(dict(zip(names, zip(*flat))))
    lists = pa.concat_tables(pa.Table.from_batches([b]) for b in divergence._listed(iter(columns.to_batches(max_chunksize=size)))).to_pylist()
    assert sum(len(r["items"]) for r in lists) == len(flat)
    groups, found = collections.defaultdict(list), []
    for r in lists:
        groups[r["lang"], r["source"], r["part"], r["strip"]].append(r)
    for own in groups.values():
        found += [tuple(r.values()) for r in divergence._gathered(5)(pa.Table.from_pylist(own)).to_pylist()]
    sums, terms = collections.Counter(), collections.defaultdict(list)
    for lang, source, part, item, value, _ in flat:
        if part == "pair":
            sums[lang, source, part, item] += value
        else:
            terms[lang, source, part].append((-value, item))
    wanted = [(*k, v) for k, v in sums.items()] + [(*k, item, -value) for k, own in terms.items() for value, item in sorted(own)[:5]]
    assert sorted(found) == sorted(wanted)


def test_shares_of_large_counts():
    for whole, counts in ((7, [0, 3, 6]), (10**12, [0, 10**11, 10**12 - 1]), (9 * 10**15, [0, 10**13 + 7, 9 * 10**15 - 1])):
        assert divergence.shares(np.array(counts), whole).tolist() == [1 + 10**9 * (c + 1) // whole for c in counts]


# --- conversation repair -------------------------------------------------------------------

STEP = {"z": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """The cheapest audit and what it leaves, by (cost, audit) per state from the front; rows as (initial, gone, cut, role, text)."""
    name = {"u": "user", "a": "assistant"}

    def put(states, state, found):
        if state not in states or found[:2] < states[state][:2]:
            states[state] = found

    def inserted(states):
        for _ in range(2):
            for s, (cost, audit, lines) in list(states.items()):
                put(states, STEP[s], (cost + 5, audit + "I", [*lines, f"{name[STEP[s]]}:"]))
        return states

    states = {"z": (0, "", [])}
    for initial, gone, cut, role, text in rows:
        following = {}
        for s, (cost, audit, lines) in inserted(states).items():
            put(following, s, (cost + 2, audit + "D", lines))
            if not gone:
                put(following, STEP[s], (cost + 1 + 5 * cut, audit + "R", [*lines, f"{name[STEP[s]]}:{text}"]))
                if initial == STEP[s] or (s, initial) == ("z", "s"):
                    put(following, initial, (cost + 5 * cut, audit + "K", [*lines, f"{role}:{text}"]))
        states = following
    return min(v for s, v in inserted(states).items() if s in "za")


def plain_damage(rows):
    said = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_summary(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    found = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, told, counts = set(), [], collections.Counter()
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            told.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", role, text))
        turns = {r[1] for r in own if r[1] is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, lines = plain_repair(told)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def talk(seed, n, hot=0):
    draw, rows = random.Random(seed), []
    for i in range(n):
        conv = 7 if i < hot else draw.choice([None, *range(20, 60)])
        text = draw.choice(["Yes.", "No", "Why?", f"t{i}.", f"t{i}", " \t", "", "é!  \n", None])
        rows.append((conv, draw.choice([None, i % 50, i]) if draw.random() < 0.2 else i, draw.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None, "User", "ua"]), text))
    draw.shuffle(rows)
    return rows


def conversations(spark, rows):
    """Rows beside columns whose names the operator uses itself."""
    kind = "conv_id bigint, turn bigint, role string, text string, conv string, digest string, edit string, code string, copies string, place string, step string"
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], kind)


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("seed, hot, partitions, chunk", [(1, 0, 8, 256), (2, 250, 23, 3), (3, 400, 40, 1)])
def test_repair_is_the_cheapest(spark, seed, hot, partitions, chunk):
    rows = talk(seed, 500, hot) + [(99, 1, "user", None), (98, 4, "system", "Only this."), (98, 4, "system", "Only this.")]
    df = conversations(spark, rows)
    damaged = dialogue.damaged(df)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in damaged.collect()), key=key) == sorted(plain_damage(rows), key=key)
    given = plain_damage(rows)
    edits = dialogue.repair(damaged, chunk, partitions)
    found = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in rows_of(dialogue.summary(edits, df))}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    plain = plain_summary(given)
    assert found == {conv: plain.get(conv, empty) for conv in {r[0] for r in rows}}
    sound = collections.defaultdict(str)
    for r in sorted(rows_of(dialogue.repaired(edits)), key=lambda r: (r["place"], r["step"])):
        sound[r["conv_id"]] += r["role"][:1]
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in sound.values())


def test_rows_of_one_kind_over_many_partitions(spark):
    """Long stretches in which no row may stay, all are truncated, or nothing is wrong: vectors must pass through every chunk."""
    draw, rows = random.Random(4), []
    for i in range(600):
        role = ("user", "assistant")[i % 2] if i < 250 or i > 500 else draw.choice(["user", "tool"])
        rows.append((1, i, role, "same." if 100 < i < 250 else f"x{i}" if 250 <= i < 500 else f"x{i}."))
    df = conversations(spark, rows)
    found = rows_of(dialogue.summary(dialogue.repair(df, 4, 60), df))
    assert tuple(found[0][n] for n in NAMES) == plain_summary([r for r in rows])[1]
    lines = dialogue.written(dialogue.serialized(dialogue._runs(dialogue._told(df)), ["conv"], ["turn", "role", "digest"], 60).mapInArrow(dialogue._chunk_lines, dialogue.CHUNK_LINES), "lines")
    assert lines.count() > 30 and dialogue._stitch(lines, 4)[1] <= 6  # few passes, however many chunks


@pytest.mark.parametrize("size", [1, 2, 7, 500])
def test_chunks_converge_to_the_sequential_vectors(size):
    draw = np.random.default_rng(size)
    for _ in range(60):
        codes = draw.integers(0, 8, draw.integers(1, 80)).astype(np.int8)
        starts = np.unique(np.append(0, draw.integers(0, len(codes), 3)))
        first, stop, more, run = dialogue.cut(starts, len(codes), size)
        assert np.concatenate([np.arange(a, b) for a, b in zip(first, stop)]).tolist() == list(range(len(codes)))
        ends = np.tile(np.array(dialogue._ENDING, np.int8), (len(first), 1))
        behind, before = dialogue.backward(codes, first, stop, more, ends)
        vector, edges = None, set(np.append(starts[1:], len(codes)).tolist())
        for i in range(len(codes) - 1, -1, -1):
            vector = np.array([dialogue._ENDING]) if i + 1 in edges else vector
            assert (behind[i] == dialogue.plain(vector)[0]).all()
            vector = dialogue.choices(codes[i:i + 1], vector)[3]


def test_no_conversations(spark):
    none = conversations(spark, [])
    assert dialogue.summary(dialogue.repair(dialogue.damaged(none)), none).count() == 0
    dropped = next((c, t) for c in range(100) for t in range(100) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    gone = conversations(spark, [(*dropped, "user", "x.")])
    assert rows_of(dialogue.summary(dialogue.repair(dialogue.damaged(gone)), gone))[0]["audit"] == ""
    long = conversations(spark, [(5, 0, "user", "word " * 400_000 + "."), (5, 1, "assistant", "a" * 1_000_000)])
    assert [r["edit"] for r in sorted(rows_of(dialogue.repair(long)), key=lambda r: (r["place"], r["step"]))] == ["D", "D"]


# --- near copies of vectors ----------------------------------------------------------------


def plain_near(rows, cosine=0.98):
    """Links of each row and its component's least id, by all cosines."""
    n, root = len(rows), list(range(len(rows)))
    good = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            good[i] = x / np.abs(x).max()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * n
    for i in good:
        for j in good:
            if i < j and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]):
                a, b = good[i], good[j]
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[find(j)] = find(i)
    least = collections.defaultdict(list)
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)].append(rows[i][0])
    named = [min(least[find(i)], default=None) for i in range(n)]
    return sorted(((r[0] is None, r[0] or 0, links[i], named[i] is None, named[i] or 0, r[0] == named[i]) for i, r in enumerate(rows)))


def found_near(df):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"] is None, r["component_id"] or 0, r["kept"]) for r in rows_of(df))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], "vec_id bigint, embedding array<float>, label int, class int, k1 int, bucket int, n int, weight int")


def planted(seed, groups, dim=32, noise=0.02):
    draw, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = draw.normal(0, 1, dim)
        for _ in range(int(draw.choice([1, 1, 2, 3, 9]))):
            v = base + draw.normal(0, noise * draw.choice([0, 1, 3]), dim)
            rows.append([float(np.float32(x)) for x in v * draw.choice([1, 3])])
        if g % 6 == 0:  # a chain: each one step from the one before
            for _ in range(5):
                base = base + draw.normal(0, 0.12, dim)
                rows.append([float(np.float32(x)) for x in base])
    return rows


def test_near_copies_are_found(spark):
    draw = random.Random(3)
    rows = [(i * 3, v, draw.choice([0, 0, 0, 1])) for i, v in enumerate(planted(1, 120))]
    rows += [(7000 + i, v, None) for i, (_, v, _) in enumerate(rows[:5])] + [(i, v, l) for i, v, l in rows[:9]] + [(None, v, l) for _, v, l in rows[:4]]
    rows += [(8000, None, 0), (8001, [], 0), (8002, [0.0] * 32, 0), (8003, [1.0, None] * 16, 0), (8004, [float("nan")] * 32, 0), (8005, [float("inf")] * 32, 0),
             (8006, [1.0, 2.0], 0), (8007, [1.01, 2.0], 0), (None, [5.0, -2.0], 0), (8008, [1e-38] * 32, 0), (8009, [3e38] * 32, 0)]
    assert found_near(neardup.near_copies(vectors(spark, rows))) == plain_near(rows)
    assert neardup.near_copies(vectors(spark, [])).count() == 0


def test_a_large_bucket_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 40)
    draw = np.random.default_rng(5)
    base = draw.normal(0, 1, 48)
    rows = [(i, [float(np.float32(x)) for x in base + draw.normal(0, 0.11, 48)], 1) for i in range(300)]
    rows += [(1000 + i, [float(np.float32(x)) for x in draw.normal(0, 1, 48)], 1) for i in range(300)]
    wanted, found = plain_near(rows), found_near(neardup.near_copies(vectors(spark, rows)))
    assert 0.999 <= sum(x[2] for x in found) / sum(x[2] for x in wanted) <= 1  # some links are at the threshold
    assert [x[4] for x in found] == [x[4] for x in wanted] and len({x[2] for x in wanted}) > 10


def test_recall_at_the_threshold():
    """Pairs of cosine 0.98 exactly share a bucket nearly always, unlike ones rarely."""
    draw = np.random.default_rng(8)
    a = neardup.unit(draw.normal(0, 1, (4000, 64)))
    other = draw.normal(0, 1, a.shape)
    other = neardup.unit(other - (a * other).sum(axis=1, keepdims=True) * a)
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * other
    for n in (100, 10**6):
        hashes, tables = neardup.size_of_index(n)
        one, two, far = (neardup.buckets(x, np.zeros(len(x), np.int64), hashes, tables) for x in (a, b, other))
        assert (one == two).any(axis=1).mean() > 0.996 and (one == far).mean() < 2 / n
    one = np.concatenate([neardup.buckets(a[i:i + 7], np.zeros(7, np.int64), 5, 9) for i in range(0, 70, 7)])
    assert (one == neardup.buckets(a[:70], np.zeros(70, np.int64), 5, 9)).all()  # alike however vectors are grouped
