"""Fair mixing, the prefix trie and periodic runs: against brute force, and with nulls, ties, repeats, hot groups and clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm import op11_fair_mix as op11
from tidegrid.llm import op12_prefix_trie as op12
from tidegrid.llm import op13_periodic_runs as op13
from tidegrid.operators.running import running_sums

DOCS = "doc_id long, text string, source string, size long, row long, target double, start long, period long"


def documents(spark, rows):
    """Rows (id, text, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, 7, 7, 7.0, 7, 7) for i, t, s in rows], DOCS)


def test_running_sums_of_groups_that_cross_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), int(i), int(v)) for i, (g, v) in enumerate(zip(rng.choice(4, 3000, p=[0.7, 0.1, 0.1, 0.1]), rng.integers(-5, 50, 3000)))]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.i: r.v_upto for r in running_sums(df, "g", [F.col("i").desc()], ["v"], ["i"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, total = {}, defaultdict(int)
    for g, i, v in sorted(rows, key=lambda r: (r[0], -r[1])):
        total[g] += v
        want[i] = total[g]
    assert got == want


# 11


def level_targets(sizes, weights, share, most):
    """Targets by name: what is above its stop is fixed there, and the excess reshared by weight until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, budget = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        if not rest:
            return fixed
        left, open_ = budget - sum(fixed.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / open_ > most * sizes[s]]
        if not over:
            return fixed | {s: left * w[s] / open_ for s in rest}
        fixed |= {s: float(most * sizes[s]) for s in over}


def mixed_rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    names = ["a", "B", "é", "日", "", None, "hot"]
    rows = []
    for i in range(n):
        s = names[6] if i % 3 == 0 else names[int(rng.integers(0, 6))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 90))), s))
    rows[5] = (5, "long " * 5000, "hot")
    rows += [(None, None, None), (7, "same id", "a"), (7, "same id", "a"), (8, "  x \x1c\x85y", "a"), (9, "  \t\n", "none left")]
    return rows


def test_mix_meets_its_targets(spark):
    rows = mixed_rows()
    docs = documents(spark, rows)
    got = op11.mix_sources(docs).collect()
    assert sorted(tuple(r) for r in op11.mix_sources(docs).collect() if r.doc_id is not None) == sorted(tuple(r) for r in got if r.doc_id is not None)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, words(t)) for i, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    want = level_targets(sizes, (3, 1, 2), 1.5, 2)
    by_size = {sizes[s]: s for s in sizes}  # sizes tell the sources apart here
    taken = defaultdict(int)
    for r in got:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 256 for s in sizes) and any(want[s] == 2 * sizes[s] for s in sizes) and any(want[s] < 2 * sizes[s] for s in sizes)
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))


def test_many_sources_join_by_shuffling(spark, monkeypatch):
    docs = documents(spark, mixed_rows(120))
    few = sorted((tuple(r) for r in op11.mix_sources(docs).collect()), key=str)
    monkeypatch.setattr(op11, "FEW_SOURCES", 0)
    assert sorted((tuple(r) for r in op11.mix_sources(docs).collect()), key=str) == few
    each = documents(spark, [(i, "word " * (i % 9), f"site{i:04d}") for i in range(300)])  # as many sources as documents
    sizes = {f"site{i:04d}": i % 9 for i in range(300)}
    want = level_targets(sizes, (3, 1, 2), 1.5, 2)
    got = op11.mix_sources(each).collect()
    assert all(r.target == pytest.approx(want[f"site{r.doc_id:04d}"]) and abs(r.taken - r.target) <= 8 for r in got) and sum(r.taken for r in got) == int(1.5 * sum(sizes.values()))


def test_mix_order_serves_sources_evenly(spark):
    """At every place in the mix, each source has had its share of what was served, up to a part on either side."""
    base, parts = op11.mix_schedule(documents(spark, mixed_rows()), part_words=32)
    rank = {r.row: (r["rank"], r.target) for r in base.select("row", "rank", "target").collect()}
    line = sorted(parts.collect(), key=lambda r: r.position)
    assert [r.position for r in line] == np.cumsum([0, *[r.length for r in line]])[:-1].tolist()
    served = defaultdict(int)
    for r in line:
        served[rank[r.row]] += r.length
        assert all(abs(n / target - r.finish) * target <= 33 for (_, target), n in served.items() if target and n)
    once = defaultdict(list)
    for r in line:
        once[r.row, r.epoch].append((r.start, r.length))
    assert all(a + n == b for v in once.values() for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:]))


def test_mix_of_nothing_and_of_one(spark):
    docs = documents(spark, [])
    assert op11.mix_sources(docs).collect() == []
    got = op11.mix_sources(documents(spark, [(1, None, None), (2, "", "x")])).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    got = op11.mix_sources(documents(spark, [(1, "one two three four", "x")])).collect()
    assert [(r["size"], r.source_size, r.target, r.taken) for r in got] == [(4, 4, 6.0, 6)]
    got = op11.mix_sources(documents(spark, [(1, "one two", "x"), (2, "three", "y")]), share=9.0).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in got) == [(1, 4.0, 4), (2, 2.0, 2)]


# 12


def brute_trie(rows):
    """Rows (conv_id, turn, role, text) to nodes, walking every prefix."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    members = defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = turns.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append((c, d == len(whole)))
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = sum(1 for x in below if not any(y[: len(x)] == x and len(y) > len(x) for y in below))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c, e in m if e))
        up = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in m), len(node), up, len(m), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, pos long, id string")


def trie_of(spark, rows):
    return sorted((tuple(r) for r in op12.prefix_trie(op12.rebuilt_turns(conversations(spark, rows))).collect()), key=str)


def test_trie_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(-7, 60):
        if c % 11 == 3:
            continue  # families without their first conversation
        n = int(rng.integers(1, 30 if c % 13 == 0 else 9))
        same = int(rng.integers(0, 3))
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"é{same}{t // 3}" if rng.random() < 0.9 else f"own {c}") for t in range(n)]
    rows += [(12, None, None, None), (12, 3, "user", "tie"), (12, 3, "assistant", "tie"), (13, 1, "user", ""), (13, 1, "user", ""), (None, 1, "user", "lost"), (20, 9, "", "x" * 100_000)]
    got = trie_of(spark, rows)
    assert got == brute_trie(rows)
    assert max(r[1] for r in got) > 2 * op12.BLOCK


def test_trie_of_one_group_of_copies_and_of_chunks(spark):
    """A third of all conversations are equal, and their ids make several chunks."""
    rows = [(c * 5, t, "user", f"turn {t}") for c in range(0, 700) for t in range(3)] + [(c * 5, t, "user", f"{c} {t}") for c in range(700, 760) for t in range(2)]
    got = trie_of(spark, rows)
    ends = {r[7]: r[:3] for r in got}
    ids = ",".join(str(c * 5) for c in range(700))
    assert ends[hashlib.sha256(ids.encode()).hexdigest()] == (0, 3, 0)
    assert sorted(got, key=str)[0][:6] == (0, 0, None, 760, 61, 61)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie_of(spark, []) == []
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert trie_of(spark, [(lone, 0, "user", "gone")]) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_long_conversations_join_in_slices(spark, monkeypatch):
    monkeypatch.setattr(op12, "SLICE", 4)
    rows = [(c, t, "user", f"{t}") for c in (0, 1, 2, 3) for t in range(40)]
    assert trie_of(spark, rows) == brute_trie(rows)


# 13


def brute_runs(words, least=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, m, q) for (s, m), q in found.items())


def brute_row(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if plant and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    from fractions import Fraction

    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_sequences_laid_end_to_end():
    rng = np.random.default_rng(1)
    for _ in range(300):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            n = int(rng.integers(1, 70))
            w = rng.integers(0, int(rng.integers(1, 5)), n)
            if rng.random() < 0.4:
                a = int(rng.integers(0, n))
                w = w[np.where(np.arange(n) < a, np.arange(n), a + (np.arange(n) - a) % min(int(rng.integers(1, 9)), n - a))]
            parts.append(w)
        got = op13.runs_of(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
        want, before = [], 0
        for w in parts:
            found = brute_runs(w.tolist())
            assert not found or op13.repeats_a_window(w, 5)
            want += [(s + before, m, q) for s, m, q in found]
            before += len(w)
        assert list(zip(*[v.tolist() for v in got])) == sorted(want, key=lambda r: (r[0], r[2]))


def test_runs_of_other_kinds_equal_brute_force():
    rng = np.random.default_rng(2)
    for least, times in ((2, 2), (4, 2), (9, 3)):
        for _ in range(60):
            w = rng.integers(0, 3, int(rng.integers(2, 60)))
            got = op13.runs_of(w, np.zeros(len(w), np.int64), least, times)
            assert list(zip(*[v.tolist() for v in got])) == sorted(brute_runs(w.tolist(), least, times), key=lambda r: (r[0], r[2]))


def test_periodic_runs_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [None, "", " \n\t ", "one", "a a a a a a", "a a a a a", "a b a b a b a b", "x a b c a b c a b c a b c a y", "           ", "ab " * 500, "日 本 " * 9 + "end"]
    for _ in range(150):
        n = int(rng.integers(1, 120))
        texts.append(" ".join(rng.choice(["a", "b", "c", "d"], n)) if rng.random() < 0.3 else " ".join(f"w{x}" for x in rng.integers(0, 400, n)))
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "a a a a a a a", "s"), (4, "a a a a a a", "s"), (4, "another", None)]
    got = op13.periodic_runs(documents(spark, rows), planting=op13.planted_tail).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_row(i, t) for i, t, _ in rows), key=str)
    assert sum(r.n_runs > 0 for r in got) > 15 and any(r.period and r.period > 4 for r in got)
    plain = op13.periodic_runs(documents(spark, rows)).collect()
    assert sorted(map(tuple, plain), key=str) == sorted((brute_row(i, t, False) for i, t, _ in rows), key=str)
    assert op13.periodic_runs(documents(spark, [])).collect() == []


def test_very_long_texts_have_their_runs():
    n = 200_000
    for words, want in ((np.zeros(n, np.int64), (0, n, 1)), (np.arange(n) % 1000, (0, n, 1000)), (np.concatenate([np.arange(n), np.arange(n) % 37]), (n, n, 37))):
        assert list(zip(*[v.tolist() for v in op13.runs_of(words, np.zeros(len(words), np.int64))])) == [want]


def test_strongest_run_is_exact():
    assert op13.strongest([(5, 3 * 10**15 + 1, 10**15), (9, 3 * 10**15, 10**15)]) == (5, 3 * 10**15 + 1, 10**15)
    assert op13.strongest([(9, 8, 2), (5, 16, 4), (5, 8, 2)]) == (5, 8, 2) and op13.strongest([]) is None


def test_sql_of_mix_and_trie(spark):
    """Both queries beside their SQL on the smallest tables."""
    import os

    import duckdb

    from tidegrid.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf).toPandas(), duck.execute(sql).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        key = [c for c in ("doc_id", "conv_id", "depth") if c in cols]
        a, b = got[cols].sort_values(key).reset_index(drop=True), want[cols].sort_values(key).reset_index(drop=True)
        for c in cols:
            if a[c].dtype.kind in "fiu":
                np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-12, err_msg=c)
            else:
                assert a[c].tolist() == b[c].tolist(), c
