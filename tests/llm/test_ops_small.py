"""Each operator on small tables: against brute force, and with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegrid.llm import op1_multi_index as op1
from tidegrid.llm import op2_hilbert_pack as op2
from tidegrid.llm import op3_compression as op3
from tidegrid.llm import op4_token_coder as op4
from tidegrid.llm import op5_html_lstm as op5
from tidegrid.llm import op6_simhash as op6
from tidegrid.llm import op7_toxicity as op7
from tidegrid.llm import op8_lm_difference as op8
from tidegrid.llm import op9_bpe_replay as op9
from tidegrid.llm import op10_langid as op10
from tidegrid.llm.word_tokens import default_path, encoder

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, fp long"


def documents(spark, texts, langs=None):
    """Rows with columns whose names clash with the operators' own."""
    langs = langs or ["en"] * len(texts)
    return spark.createDataFrame([(i, t, g, "s", 1, 0.5, "k", 7) for i, (t, g) in enumerate(zip(texts, langs))], SHAPE)


def edge_texts():
    rng = np.random.default_rng(4)
    words = ["the", "river", "runs", "É", "naïve", "42", "x=1", "don't", "..."]
    long = " ".join(rng.choice(words, 30_000))
    return [None, "", " \n\t ", "one", "The Same text here again", "The Same text here again", long, "日本語 текст 🙂", "a\x00b\x1cc\x85d", "Ünïcödé ẞ"]


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_word_tokens_equal_the_library(monkeypatch):
    from tidegrid.llm import word_tokens

    monkeypatch.setattr(word_tokens, "RUN_CHARS", 500)
    monkeypatch.setattr(word_tokens, "REMEMBERED", 50)
    enc = word_tokens.WordEncoder(default_path())
    texts = [*edge_texts(), *[chr(i) + "a" + chr(i) + "." for i in range(0x260)], "dogs' it's''s _x_ a1b2 <|endoftext|> ¼½²"]
    want = [enc.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.batch(texts)] == want
    assert [enc.ids(t).tolist() for t in texts] == want


def test_added_tokens_equal_a_fresh_library():
    from tokenizers import Tokenizer

    from tidegrid.llm import word_tokens

    fresh = Tokenizer.from_file(default_path())
    enc = word_tokens.WordEncoder(default_path())
    texts = ["one <|endoftext|> two", "a<|startoftext|>b", "<|endoftext|>", "<|ENDOFTEXT|> <|x|>", "plain", None]
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 49407 in want[0] and 49406 in want[1]
    assert [x.tolist() for x in enc.batch(texts)] == want == [enc.ids(t).tolist() for t in texts]


# 1


def unit_rows(n, d=16, seed=0):
    return np.random.default_rng(seed).standard_normal((n, d))


def brute(ids, x, q, k):
    n = np.sqrt((x**2).sum(1))
    out = {}
    for i in q:
        s = x @ x[i] / (n * n[i])
        out[ids[i]] = sorted(((-v, j) for v, j in zip(s, ids) if j != ids[i]))[:k]
    return out


def test_multi_index_whole_radius_equals_brute_force(spark):
    x = unit_rows(300)
    x[7] = x[3]
    df = spark.createDataFrame([(i, v.tolist(), 0.0, 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score double, rank int")
    got = {}
    for r in op1.nearest_neighbours(df, F.col("vec_id") % 50 == 0, radius=10_000).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(list(range(300)), x, range(0, 300, 50), 5)
    for q, near in want.items():
        assert [v for _, v, _ in sorted(got[q])] == [j for _, j in near]
        assert [s for _, _, s in sorted(got[q])] == pytest.approx([-v for v, _ in near], abs=1e-12)


def test_multi_index_recall_with_learned_radius(spark):
    x = unit_rows(2000, 32, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in op1.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()}
    want = {(q, j) for q, near in brute(list(range(2000)), x.astype(np.float32).astype(float), range(0, 2000, 50), 5).items() for _, j in near}
    assert len(got & want) / len(want) >= 0.9


def test_multi_index_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (None, [1.0, 1.0]), (6, [0.0, 1.0]), (7, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in op1.nearest_neighbours(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 50), (0, 3, 6), (50, 1, 0), (50, 2, 1), (50, 3, 6)]
    assert op1.nearest_neighbours(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert op1.nearest_neighbours(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_multi_index_repeats_ties_and_tiny_vectors(spark):
    """A repeated query id is one query, equal vectors tie by id whatever their place, and sizes don't matter."""
    x = unit_rows(40, 24, 5)
    rows = [(i, v.tolist()) for i, v in enumerate(x[:20], 1)] + [(100 + i, (x[0] * s).tolist()) for i, s in enumerate((1.0, 2.0**-660, 2.0**600, 4.0))]
    rows += [(50, (x[0] * 1e-200).tolist()), (50, (x[0] * 1e-200).tolist()), (50, x[30].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op1.nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect())
    assert [(q, r) for q, r, _, _ in got] == [(q, r) for q in (50, 100) for r in range(1, 6)]
    assert [v for q, _, v, _ in got if q == 100][:4] in ([1, 101, 102, 103], [50, 50, 1, 101], [1, 50, 50, 101])
    assert [s for q, _, _, s in got if q == 100][:4] == pytest.approx([1.0] * 4)
    least = min(r[1] for r in rows if r[0] == 50)
    near = brute([*range(20), *range(100, 104), -1], np.array([*x[:20], *[x[0]] * 4, np.array(least) / np.abs(least).max()]), [24], 5)[-1]
    assert [s for q, _, _, s in got if q == 50] == pytest.approx([-v for v, _ in near], abs=1e-9)


def test_every_code_within_the_radius_is_visited():
    x = op1.unit_rows(unit_rows(1500, 40, 3))
    codes = op1.Codes.fit(x, 5)
    shard = op1.Shard(np.arange(len(x)), x, codes)
    for radius in (0, 1, 5, 40, codes.radius):
        assert sum(r + 1 for r in codes.radii(radius)) == radius + 1
        for i in (0, 7):
            within = np.flatnonzero(np.bitwise_count(shard.code ^ shard.code[i]).sum(axis=1) <= radius)
            assert shard.candidates(shard.code[i], radius).tolist() == within.tolist()


def test_substring_index_enumerates_what_it_scans():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    values = base[rng.integers(0, 50, 9000)] ^ (np.uint64(1) << rng.integers(0, 64, 9000).astype(np.uint64))
    index = op1.SubstringIndex(values)
    for radius in (-1, 0, 1, 2, 5):
        got = sorted(index.rows(base[3], radius).tolist())
        assert got == np.flatnonzero(np.bitwise_count(values ^ base[3]) <= radius).tolist()


# 2


def test_hilbert_key_steps_to_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = op2.hilbert_key(cells, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("length", [8, 4096])
def test_packing_covers_every_id_once(spark, length):
    docs = documents(spark, edge_texts())
    enc = encoder(default_path())
    want = {i: np.append(enc.library.encode(t or "", add_special_tokens=False).ids, 2).astype("<u4") for i, t in enumerate(edge_texts())}
    pieces = op2.pack_along_curve(docs, length).collect()
    by, seq = {}, {}
    for p in pieces:
        ids = want[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        by.setdefault(p.doc_id, []).append((p.start, p.length))
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, parts in by.items():
        assert [s for s, _ in sorted(parts)] == np.cumsum([0, *[n for _, n in sorted(parts)]])[:-1].tolist() and sum(n for _, n in parts) == len(want[i])
    for parts in seq.values():
        n = sum(k for _, k in parts)
        assert [o for o, _ in sorted(parts)] == np.cumsum([0, *[k for _, k in sorted(parts)]])[:-1].tolist() and n & (n - 1) == 0
    assert set(by) == set(want) and op2.pack_along_curve(docs.limit(0)).count() == 0


# 3


def brute_base(text):
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", text or "")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)} if len(words) < 2000 else None
    lines = [x for x in (text or "").split("\n") if brute_words(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), None if hit is None else len(hit)


def brute_words(line):
    return __import__("re").findall("[^\x20\x09-\x0d]+", line)


def test_base_counts_equal_brute_force():
    texts = [*edge_texts(), "a b c d e a b c d e f", "x\nx\n \n y\nx", "|a| <b> #" * 20, "w " * 50, "a b c d e\na b c d e\n" * 3]
    for t in texts:
        want, got = brute_base(t), op3.base_counts(t)
        assert got[:4] == want[:4] and want[4] in (None, got[4]), t


def test_compression_bands(spark):
    rng = np.random.default_rng(0)
    syll = ["ka", "re", "mi", "to", "lun", "sha", "ber", "ing", "old", "ve", "nor", "ast"]
    prose = " ".join("".join(rng.choice(syll, rng.integers(1, 4))) for _ in range(800))
    noise = " ".join("".join(map(chr, rng.integers(0x4E00, 0x9FA5, 6))) for _ in range(300))
    repeat = "\n".join(f"{i} of the very same long sentence about a river that runs to the sea" for i in range(300))
    docs = documents(spark, [*edge_texts(), prose, noise, repeat])
    got = {r.doc_id: r for r in op3.compression_bands(docs).collect()}
    n = len(edge_texts())
    assert got[n].kept and not got[n].base_failed
    assert not got[n + 2].kept and got[n + 2].ratio > 4.5
    assert not got[0].kept and got[0].base_failed and got[0].n_words == 0
    assert len(got) == docs.count() and op3.compression_bands(docs.limit(0)).count() == 0


def test_bands_equal_brute_force(spark):
    """Ratios, limits and verdict of every row, each text cut and compressed anew; a ratio at its limit passes."""
    import zstandard

    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)]
    texts = [*edge_texts(), *(" ".join(rng.choice(words[: rng.integers(2, 3000)], n)) for n in [5, 11, 12, 40, 150, 700, 900, 2500, 6000] * 3)]
    texts += [t + " x" * 9000 for t in texts[-2:]]
    bands, size = op3.Bands(), lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
    for r in op3.compression_bands(documents(spark, texts)).collect():
        raw = (texts[r.doc_id] or "").encode()
        whole = len(raw) / size(raw) if raw else 0.0
        cuts = [raw[i : i + 4096] for i in range(0, len(raw), 4096)] if len(raw) >= 4096 else []
        bad = sum(len(c) for c in cuts if not bands.chunk[0] <= 4096 / size(c if len(c) == 4096 else raw[-4096:]) <= bands.chunk[1])
        low, high = [(a, b) for top, a, b in bands.whole if len(raw) < top][0]
        assert r.ratio == pytest.approx(whole) and r.bad_chunk_share == pytest.approx(bad / max(1, len(raw)))
        assert r.kept == (not r.base_failed and low <= whole <= high and 4 * bad <= len(raw)), r.doc_id
    assert op3.verdict(100, 3.0, [], bands)[2] and not op3.verdict(100, 3.0001, [], bands)[2]
    assert op3.verdict(16_000, 2.0, [(2.0, 4000)] * 3 + [(9.0, 4000)], bands)[1:] == (0.25, True) and not op3.verdict(16_000, 2.0, [(2.0, 8000), (9.0, 8000)], bands)[2]


def test_the_end_of_a_text_is_judged_too(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join(rng.choice(["river", "stone", "cloud", "walks", "green", "over", "quiet", "bridge", "lamp", "winter", "meadow", "slowly", "between", "seven", "harbour", "letters"], n))
    noise = lambda n: " ".join("".join(chr(c) for c in rng.integers(33, 127, 9)) for _ in range(n // 10))
    text = "".join(chr(97 + int(c)) if c < 26 else " " for c in rng.integers(0, 32, 9000))
    plain = (prose(4000) + " " + text)[:4096]
    bands = op3.Bands(chunk=(1.35, 60.0), whole=((float("inf"), 0.0, 99.0),))
    got = [r.bad_chunk_share for r in op3.compression_bands(documents(spark, [plain + noise(4095)[:4090], plain + noise(600), plain, plain[:4000]]), bands=bands).collect()]
    assert got[0] == pytest.approx(4090 / (len(plain) + 4090), abs=1e-3) and got[1] < 0.2 and got[2] == 0.0 and got[3] == 0.0


# 4


@pytest.mark.parametrize("ids", [[], [0], [49407], list(range(3000)), [5] * 9000, np.random.default_rng(3).integers(0, 49408, 20_000), np.random.default_rng(3).zipf(1.3, 30_000) % 49408])
def test_block_round_trip(ids):
    ids = np.asarray(ids, dtype="<u4")
    data = op4.encode_block(ids, 49_408)
    assert (op4.decode_block(data) == ids).all()
    if len(ids) > 5000 and len(np.unique(ids)) < 100:
        assert len(data) < len(ids)


def test_damage_is_found():
    data = bytearray(op4.encode_block(np.arange(500, dtype="<u4"), 49_408))
    data[60] ^= 1
    with pytest.raises(ValueError):
        op4.decode_block(bytes(data))


def test_token_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op4, "BLOCK_IDS", 4096)
    texts = [*edge_texts(), *["word %d again" % i for i in range(500)]]
    docs = documents(spark, texts)
    op4.write_token_shards(docs, f"{tmp_path}/s")
    enc, start = encoder(default_path()), 0
    got = {r.doc_id: r for r in op4.read_token_shards(spark, f"{tmp_path}/s").collect()}
    for i, t in enumerate(texts):
        ids = np.append(enc.library.encode(t or "", add_special_tokens=False).ids, 1).astype("<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    lost = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        op4.write_token_shards(lost, f"{tmp_path}/n")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = op4.read_token_shards(spark, f"{tmp_path}/n").collect()
    assert len(got) == 400 and len({r.shard for r in got}) == 4  # rows without an id don't meet in one task
    op4.write_token_shards(docs.limit(0), f"{tmp_path}/e")
    assert op4.read_token_shards(spark, f"{tmp_path}/e").count() == 0


# 5


PAGE = '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/a">menu</a></nav><div class="ad">Buy now</div><article><h1>Head &amp; more</h1><p><b>First  line.<br><p>Second&nbsp;line.</article><footer>&copy; x</footer>'


def test_blocks_of_a_page():
    got = [(b.text, op5.teacher(b)) for b in op5.read_blocks(PAGE)]
    assert got == [("T", 0), ("menu", 0), ("Buy now", 0), ("Head & more", 1), ("First line.", 1), ("Second line.", 1), ("© x", 0)]
    assert op5.read_blocks(None) == [] and op5.read_blocks("") == [] and [b.text for b in op5.read_blocks("plain <!-- x --> text")] == ["plain text"]


@pytest.mark.parametrize("inner", ['<svg class="i"/>', "<object data=x>", "<svg-icon></svg-icon>", "<object-view>", "<template-part>", "<svg><path/></svg>", "<iframe src=y></iframe>"])
def test_html_text_after_an_embedded_element_stays(inner):
    assert " ".join(b.text for b in op5.read_blocks(f"<p>one</p>{inner}<p>two</p><svg>no</svg><p>three</p>")) == "one two three"
    assert [b.text for b in op5.read_blocks("<p>a</p><script>b<p>c")] == ["a"]


@pytest.mark.parametrize("piece", ["<a ", "<object>", "<svg ", '<a "', "<a '\">x", "</", "<!-- ", "<p>", "<script ", "<div class='", "<object x=\"<p>"])
def test_reading_a_megabyte_of_broken_tags_is_linear(piece):
    import time

    took = []
    for n in (100_000, 1_000_000):
        began = time.process_time()
        op5.read_blocks(piece * (n // len(piece)))
        took.append(time.process_time() - began)
    assert took[1] < 60 * max(took[0], 0.02)


def test_tags_with_angles_in_quotes():
    blocks = op5.read_blocks("<div data-x=\"a>b\">one</div><p title='x<y'>two<svg a='>'/>three</p><iframe src=x>gone</iframe>four<object>five<p>six")
    assert [b.text for b in blocks] == ["one", "two", "three", "four", "five", "six"]


def test_pages_that_name_no_article(spark):
    """Labelled by running text, not by an untrained network; with no running text at all, every text is empty."""
    menu = "<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul>"
    rng = np.random.default_rng(6)
    lines = [" ".join(rng.choice(["river", "stone", "cloud", "walks", "green", "over"], 30)) + "." for _ in range(40)]
    pages = spark.createDataFrame([(i, "u", f"<html><body>{menu}<p>{lines[i]}</p><p>{lines[i + 1]}</p>{menu}</body></html>") for i in range(30)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in op5.extract_main_text(pages, op5.fit_labeller(pages)).collect()}
    assert sum(got[i] == f"{lines[i]}\n{lines[i + 1]}" for i in range(30)) >= 27
    bare = pages.select("page_id", "url", F.lit("<a href=x>Home</a>").alias("html"))
    assert op5.fit_labeller(bare) is None and {r.text for r in op5.extract_main_text(bare, None).collect()} == {""}


def test_network_equals_a_scalar_pass():
    net = op5.BiLSTM.start(width=5, hidden=3, seed=2)
    x = np.random.default_rng(8).standard_normal((1, 4, 5)).astype(np.float32)

    def side(d, seq):
        h, c, out = [0.0] * 3, [0.0] * 3, []
        for v in seq:
            z = [sum(float(a) * float(w) for a, w in zip([*v, *h], net.p[d][:, k])) + float(net.p[d + "0"][k]) for k in range(12)]
            s = lambda t: 1 / (1 + np.exp(-t))
            c = [s(z[3 + k]) * c[k] + s(z[k]) * np.tanh(z[9 + k]) for k in range(3)]
            h = [s(z[6 + k]) * np.tanh(c[k]) for k in range(3)]
            out.append(h)
        return out

    f, b = side("f", x[0]), side("b", x[0][::-1])[::-1]
    want = [sum(a * float(w) for a, w in zip([*p, *q], net.p["o"])) + float(net.p["o0"][0]) for p, q in zip(f, b)]
    assert net.logits(x, np.ones((1, 4), np.float32))[0] == pytest.approx(want, abs=1e-5)


def test_labeller_is_trained_on_whole_pages(spark, monkeypatch):
    seen, plain = [], op5.block_vectors
    monkeypatch.setattr(op5, "block_vectors", lambda blocks: seen.append(blocks) or plain(blocks))
    html = "<article>" + "".join(f"<p>{'word ' * 120}{i}.</p>" for i in range(90)) + "</article><footer>end</footer>"
    op5.fit_labeller(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert len(seen[0]) == 91 and seen[0][-1].text == "end" and all(len(b.text) > 600 for b in seen[0][:-1])


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = op5.BiLSTM.start(width=op5.WIDTH, hidden=3)
    x, mask = rng.standard_normal((2, 4, op5.WIDTH)).astype(np.float32), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], np.float32)
    y = rng.integers(0, 2, (2, 4)).astype(np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, g = net.gradients(x, mask, y)
    for name, at in (("f", (5, 2)), ("b", (op5.WIDTH + 1, 4)), ("o", (1,)), ("f0", (6,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = net.gradients(x, mask, y)[0]
        net.p[name][at] = old - 1e-3
        down = net.gradients(x, mask, y)[0]
        net.p[name][at] = old
        assert (up - down) / 2e-3 == pytest.approx(float(g[name][at]), rel=0.05, abs=2e-5)


def test_main_text(spark):
    pages = [(i, f"u{i}", PAGE.replace("Second", f"Second {i} goes on for a while,")) for i in range(60)] + [(60, None, None), (61, "u", ""), (None, "u", PAGE), (5, "again", PAGE)]
    df = spark.createDataFrame([(*p, "x", 3) for p in pages], "page_id long, url string, html string, text string, n_chars long")
    net = op5.fit_labeller(df)
    got = op5.extract_main_text(df, net).collect()
    assert len(got) == len(pages)
    for r in got:
        if r.page_id is not None and r.page_id < 60 and r.url != "again":
            assert r.text == f"Head & more\nFirst line.\nSecond {r.page_id} goes on for a while, line." and r.n_chars == len(r.text)
    assert {r.page_id: r.text for r in got}[60] == "" == {r.page_id: r.text for r in got}[61]
    assert op5.extract_main_text(df.limit(0), op5.fit_labeller(df.limit(0))).count() == 0


# 6


def brute_fingerprint(text, k=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", words)]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + k]), seed=42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force():
    for t in [*edge_texts()[:6], *edge_texts()[7:], "A b C d E f g", "x " * 40]:
        assert op6.fingerprint(t) == brute_fingerprint(t)


def brute_components(codes, radius):
    parent = {c: c for c in codes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


@pytest.mark.parametrize("split", [2_000, 20, 3])
def test_links_equal_brute_force(spark, monkeypatch, split):
    """Chains, stars and a hot slice that is dealt again."""
    monkeypatch.setattr(op6, "SPLIT", split)
    rng = np.random.default_rng(5)
    codes = {int(x) for x in rng.integers(0, 1 << 62, 40)}
    for c in list(codes)[:15]:
        for _ in range(12):
            c ^= (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
            codes.add(c)
    base = int(rng.integers(0, 1 << 62)) & ~((1 << 40) - 1)
    codes |= {base | int(x) for x in rng.integers(0, 1 << 20, 80)}
    signed = [c - (1 << 64) if c >= 1 << 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    roots = {r.node: r.root for r in op6.components(op6.links(df, 2)).collect()}
    want = brute_components(codes, 2)
    groups = lambda f, items: sorted(sorted(x for x in items if f(x) == g) for g in {f(x) for x in items})
    back = dict(zip(signed, codes))
    assert groups(lambda s: want[back[s]], signed) == groups(lambda s: roots.get(s, s), signed)


def test_bk_tree_finds_all():
    rng = np.random.default_rng(6)
    codes = list({int(x) for x in rng.integers(0, 1 << 12, 500)})
    tree = op6.BKTree(codes)
    for q in codes[:40]:
        assert sorted(codes[i] for i in tree.within(q, 2)) == sorted(c for c in codes if (c ^ q).bit_count() <= 2)


def test_simhash_groups_odd_rows(spark):
    texts = [*edge_texts(), "a b c d", "A B C D"]
    docs = documents(spark, texts).unionByName(documents(spark, ["lost"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = {r.doc_id: r for r in op6.simhash_groups(docs).collect()}
    assert len(got) == len(texts) and got[5].component_id == 4 and got[2].component_id == 0 and got[11].component_id == 10
    assert all(got[i].fingerprint == f"{op6.fingerprint(t):016x}" for i, t in enumerate(texts))
    assert op6.simhash_groups(docs.limit(0)).count() == 0
    kept = op6.keep_first_of_groups(docs.unionByName(docs.where("doc_id = 3")))
    assert kept.columns == docs.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 3, 4, 6, 7, 8, 9, 10]


def test_rows_are_judged_not_ids(spark):
    rows = [(0, "one river runs under the old bridge"), (1, "one river runs under the old bridge"), (1, "quite another text about seven green stones"), (2, "first of two texts with the number two"), (2, "another one that has that number, not that text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(tuple(r) for r in op6.keep_first_of_groups(docs).collect())
    assert kept == sorted(rows[:1] + rows[2:])
    groups = {(r.doc_id, r.component_id) for r in op6.simhash_groups(docs).collect()}
    assert groups == {(0, 0), (1, 0), (1, 1), (2, 2)}
    assert op6.keep_first_of_groups(docs, radius=0).count() == 4


# 7


def characters():
    from collections import Counter

    return op7.CharModel.fit(Counter({"idiot": 50, "moron": 50, "stupid": 50, "shit": 50, "ass": 50, "river": 50, "happy": 50, "runs": 50, "you": 90, "are": 90, "a": 200, "b": 9}))


def test_deobfuscation():
    chars = characters()
    for token, plain in [
        ("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("$tup1d", "stupid"), ("haaaappy", "happy"), ("shi7", "shit"), ("a55", "ass"), ("a$$!", "ass"),
        ("1.d.1.0.t", "idiot"), ("i,d,i,o,t.", "idiot"), ("i’d’i’o’t", "idiot"), ("sh*t", "shit"), ("m" + "o" * 99 + "ron", "moron"), ("i d i o t", "idiot"), ("a m o r o n", "a moron"), ("s h i t.", "shit"),
        ("i d i o t a", "idiot a"), ("a s s", "ass"), ("1 d 1 0 t!", "idiot"),
    ]:
        assert chars.restore(op7.hidden(token)) == plain, (token, op7.hidden(token), chars.restore(op7.hidden(token)))
    assert op7.words_of("You i d i o t, a. Go and s h i t! x y now") >= {"you", "i d i o t, a.", "s h i t! x y", "go", "x"}
    for token in ("river", "password=86998acf8bd", "me@x.org", "2024", "1 2 3 4", "l'eau", "well-known"):
        assert op7.hidden(token) == "", token


def test_restoring_equals_every_path():
    """Viterbi against the enumeration of all paths through the lattice."""
    from itertools import groupby, product

    chars = characters()

    def price(parts):
        text, spent = "".join(parts), 0.0
        for word in text.split(" "):
            s = "^" * op7.CONTEXT + word
            spent += sum(chars.cost(s[i - op7.CONTEXT : i], s[i]) for i in range(op7.CONTEXT, len(s)))
            spent += chars.cost(s[-op7.CONTEXT :], "^") if word else 0.0
        return spent

    for token in ("1d10t", "a55", "i.d.1", "s h 1 t a", "a m o r o n", "$$tuu", "sh*t", "b a b"):
        paths = product(*(chars.arcs(c, len(list(g))) for c, g in groupby(token)))
        best = min(sum(c for _, c in path) + price([x for x, _ in path]) for path in paths)
        found = chars.restore(token)
        reached = min(sum(c for _, c in path) + price([x for x, _ in path]) for path in product(*(chars.arcs(c, len(list(g))) for c, g in groupby(token))) if "".join(x for x, _ in path) == found)
        assert reached == pytest.approx(best), token


def test_long_tokens_are_scored_whole():
    model = op7.ToxicityModel(characters(), {"=idiot": 5.0, "^idio": 1.0}, -2.0)
    assert model.score("x" * 300_000 + " i d i o t") > 0.9 and model.score("ab1" * 20_000) < 0.5 and model.score("y " * 50_000) < 0.5
    assert model.score("1d10t 1d10t") == model.score("1d10t") and model.score(None) == model.score("")
    assert max(map(len, model.clean), default=0) <= op7.REMEMBERED_CHARS


def toxic_corpus(n=400):
    rng = np.random.default_rng(7)
    plain = ["river", "stone", "cloud", "walks", "green", "little", "house", "over", "under", "seven", "bridge", "water"]
    texts, labels = [], []
    for i in range(n):
        words = rng.choice(plain, 40).tolist()
        toxic = i % 4 == 0
        if toxic:
            words[5], words[20] = rng.choice(["idiot", "moron", "scum"]), "stupid" if i % 8 else "$tup1d"
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_toxicity_is_learned_from_all_labelled_rows(spark, monkeypatch):
    """Eight rows among 18,000 hold a word: just enough for the test of words, so none of them may be left out; tasks hand on counts in parts."""
    monkeypatch.setattr(op7, "COUNTED", 50)
    every = spark.range(18_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic", "concat('river stone n', translate(cast(id as string), '0123456789', 'abcdefghij'), if(id % 2 = 1 and id < 16, ' grubfoot', '')) as text")
    model = op7.fit_toxicity_model(every.select("doc_id", "text"), every.select("doc_id", "toxic"), F.lit(True))
    assert model.weights["=grubfoot"] > 0 and "=river" not in model.weights


def test_toxicity_leaves_out_no_feature_and_no_word(spark):
    """4,500 features and 61,000 words: all features are kept, words of three clean rows are known, and the character model counts all words, also those of one row."""
    from collections import Counter

    syllables = [c + v for c in "bdfgklmn" for v in "aeiou"]
    word = lambda i: "".join(syllables[i // 40**k % 40] for k in range(3))
    many, toxic = [word(i) for i in range(61_000)], [f"z{word(7 * i)}" for i in range(4_500)]
    texts = [" ".join([*many, f"end{word(i)}"]) for i in range(4)] + [" ".join([*toxic, "idiot", f"end{word(i)}"]) for i in range(4, 8)]
    texts += [" ".join(["river", "stone", f"end{word(i)}", *(["idi"] if i < 11 else []), *(["quux"] if i == 12 else [])]) for i in range(8, 30)]
    labels = [int(4 <= i < 8) for i in range(30)]
    model = op7.fit_toxicity_model(documents(spark, texts), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"), F.lit(True))
    assert {f"={w}" for w in [*toxic, "idiot"]} <= model.weights.keys() and "idiot" in model.toxic
    assert model.known & {"idi", "ot", "river"} == {"idi"} and model.cut_words("an idi ot".split()) == [] and model.cut_words("an id iot".split()) == ["id iot"]
    assert model.chars.counts == op7.CharModel.fit(Counter(w for t in texts for w in t.split())).counts and model.chars.counts["quux"] == 1


def test_character_counts_equal_brute_force():
    from collections import Counter

    words, want = Counter({"idiot": 3, "a": 2, "stone": 1, "": 5}), Counter()
    for w, n in words.items():
        s = "^" * op7.CONTEXT + w + "^"
        for i in range(op7.CONTEXT, len(s)):
            for k in range(op7.CONTEXT + 1):
                want[s[i - k : i + 1]] += n
                want[s[i - k : i] + "\0"] += n
    assert op7.CharModel.fit(words).counts == want


def test_toxicity_moves_one_text_per_copy_and_looks_for_more_features_if_need_be(spark, monkeypatch):
    """Only what may be chosen crosses to the labels, each text once per class; the model is the same however few features are looked for at first."""
    texts, labels = toxic_corpus()
    docs = documents(spark, [*texts, *texts[:50], None, None, ""])
    docs = docs.unionByName(docs.limit(5))  # repeated rows
    marks = spark.createDataFrame([(i, y) for i, y in enumerate([*labels, *[1 - y for y in labels[:20]], *labels[20:50], 0, 0, 0])], "doc_id long, toxic int")
    rows, counts = op7.labelled_texts(docs, marks, F.lit(True))
    want = {(t, y) for t, y in zip([*texts, *texts[:50], None, None, ""], [r.toxic for r in marks.orderBy("doc_id").collect()])}
    got = [(r.text, r.toxic) for r in rows.collect()]
    assert set(got) == want and len(got) == len(want) and counts == {y: sum(1 for _, z in want if z == y) for y in (0, 1)}
    taken = op7.taken_places(spark.range(100).select(F.col("id").alias("doc_id")), 18)
    left = {r.id for r in op7.with_place_taken(spark.range(3000), ["id"], taken, 18).collect()}
    assert left >= set(range(100)) and len(left) < 150
    whole = op7.fit_toxicity_model(docs, marks, F.lit(True))
    monkeypatch.setattr(op7, "CANDIDATES", 1)
    few = op7.fit_toxicity_model(docs, marks, F.lit(True))
    assert few.weights == whole.weights and len(few.weights) > 4 and few.bias == whole.bias


def test_toxicity(spark):
    texts, labels = toxic_corpus()
    docs = documents(spark, [*texts, None, "", "1d10t you m0r0n"])
    marks = spark.createDataFrame([(i, 1, y, "x") for i, y in enumerate(labels)] + [(None, 1, 1, "x"), (0, 1, None, "x")], "doc_id long, quality int, toxic int, text string")
    model = op7.fit_toxicity_model(docs, marks, op10.fold_of("doc_id", 5) != 0)
    got = {r.doc_id: r for r in op7.score_toxicity(docs, model, op10.fold_of("doc_id", 5) == 0).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i].held_out for i in held) and all(got[i].predicted == labels[i] for i in held)
    assert got[len(texts)].predicted == 0 and got[len(texts) + 1].predicted == 0 and got[len(texts) + 2].predicted == 1
    kept = op7.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(texts) - sum(labels) + 2
    assert op7.fit_toxicity_model(docs, marks.limit(0), op10.fold_of("doc_id", 5) != 0) is None
    assert {r.score for r in op7.score_toxicity(docs, None, F.lit(False)).collect()} == {0.0}
    assert op7.score_toxicity(docs.limit(0), model, F.lit(False)).count() == 0


def test_words_in_parts_and_in_machine_tokens():
    """Cut words are found where their parts make a toxic word and the lattice joins them; other neighbours stay apart."""
    chars = characters()
    model = op7.ToxicityModel(chars, {"=idiot": 5.0, "=moron": 4.0, "^idio": 1.0, "=river": -3.0}, -2.0)
    assert model.toxic == {"idiot", "moron"} and model.features("what an idi ot you are") == {"=idiot", "^idio"}
    assert model.features("an i diot. and a mo ro n!") == {"=idiot", "^idio", "=moron"}
    for clean in ("the idi and ot", "riv er runs", "mo re on", "id iom", "", None, "idi", "m o"):
        assert model.features(clean) == set(), clean
    assert model.cut_words("idi ot idi ot".split()) == ["idi ot", "idi ot"] and model.cut_words(["idiot"]) == [] and model.cut_words("id i ot".split()) == ["id i ot"]
    wary = op7.ToxicityModel(chars, model.weights, -2.0, frozenset({"ot", "mo"}))
    assert wary.features("what an idi ot. and id iot") == {"=idiot", "^idio"} and wary.cut_words("an idi ot. mo ron".split()) == []
    for token in ("name=1d10t", "https://x.org/1d10t?a=b", "1d10t2024", "me@1d10t.org", "a=b/m0r0n"):
        assert model.features(token) & {"=idiot", "=moron"}, token
    for token in ("4111111111111111", "key=AKIA0123456789", "https://x.org/path?q=1", "2024-01-02"):
        assert model.features(token) == set(), token
    import time

    took = []
    for n in (20_000, 200_000):
        began = time.process_time()
        model.features("i d " * n)
        took.append(time.process_time() - began)
    assert took[1] < 30 * max(took[0], 0.02)


# 8


@pytest.mark.parametrize("run", [op8.SLICE_CHARS, 8])
def test_difference_equals_brute_force(spark, monkeypatch, run):
    from collections import Counter

    monkeypatch.setattr(op8, "SLICE_CHARS", run)
    monkeypatch.setattr(op8, "BUCKET_CHARS", run)
    texts = ["a B a b c", "a b", None, "", "c c c d", "a b", " x\ty ", "x y", " \n "]
    docs, target = documents(spark, texts).repartition(2), spark.createDataFrame([(0,), (0,), (None,), (6,)], "doc_id long")
    docs = docs.unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    texts = [*texts, texts[4]]
    got = {r.doc_id: r for r in op8.lm_difference(docs, target).collect()}
    seqs = [["<", *w, ">"] if (w := (t or "").lower().split()) else [] for t in texts]
    size = len({w for q in seqs for w in q[1:]})

    def loss(i, some):
        uni, hist, bi = Counter(), Counter(), Counter()
        for j in some:
            if j != i:
                uni.update(seqs[j][1:])
                hist.update(seqs[j][:-1])
                bi.update(zip(seqs[j], seqs[j][1:]))
        n = sum(uni.values())
        p1 = lambda w: (uni[w] + op8.FLOOR) / (n + op8.FLOOR * size)
        return float(np.mean([-np.log((bi[h, w] + op8.MU * p1(w)) / (hist[h] + op8.MU)) for h, w in zip(seqs[i], seqs[i][1:])]))

    assert len(got) == len(texts)
    for i in (0, 1, 4, 5, 6, 7, 9):
        r = got[i if i < 9 else None]
        assert r.n_tokens == len(seqs[i]) - 2
        assert r.ce_target == pytest.approx(loss(i, (0, 6)), rel=1e-9) and r.ce_background == pytest.approx(loss(i, range(len(texts))), rel=1e-9)
        assert r.score == pytest.approx(r.ce_background - r.ce_target)
    assert got[2].ce_target is None and got[3].score == 0.0 and got[8].n_tokens == 0
    assert op8.lm_difference(docs.limit(0), target).count() == 0
    none = {r.doc_id: r for r in op8.lm_difference(docs, target.limit(0)).collect()}
    assert none[0].ce_target == pytest.approx(np.log(size))


def test_packed_numbers_come_back():
    x = np.array([0, 1, 255, 256, 2**63, 2**64 - 1], dtype=np.uint64)
    assert op8.unpacked(op8.packed(x)).tolist() == x.tolist()
    assert len(op8.unpacked(op8.packed(x[:0]))) == 0


# 9


def test_merge_replay_equals_the_library(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op9.load_ranks(path), special_tokens={})
    rng = np.random.default_rng(8)
    texts = [*edge_texts(), "a" * 300, "ababab" * 20, *["".join(rng.choice(list("aehinorst é1!"), 80)) for _ in range(200)]]
    got = {r.doc_id: r for r in op9.byte_bpe(documents(spark, texts), path, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and op9.decode(ids, path) == (t or "").encode()
    assert op9.byte_bpe(documents(spark, ["x"]).limit(0), path, P.PATTERN).count() == 0


def test_merge_replay_of_odd_ranks():
    """Ranks that no training gives: two splits of one token, and a merge that makes a pair of lower rank."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 310, b"abc": 290, b"ba": 320, b"aba": 256, b"cab": 257}
    replay = op9.MergeReplay(ranks)
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 14))).encode() for _ in range(500)]
    for w, ids in zip(words, replay.encode(words)):
        assert ids.tolist() == replay.one_by_one(w), w


# 10


def language_corpus(n=240):
    rng = np.random.default_rng(10)
    syll = {"en": ["the", "ing", "and", "tion", "er", "wh"], "de": ["sch", "ung", "ein", "ß", "ä", "keit"], "fr": ["eau", "oux", "é", "tre", "qu", "ais"]}
    langs = [k for k in syll for _ in range(n // 3)]
    return [" ".join("".join(rng.choice(syll[k], rng.integers(1, 4))) for _ in range(30)) for k in langs], langs


def test_language(spark):
    texts, langs = language_corpus()
    docs = documents(spark, [*texts, None, "", "123 !!", "😀"], [*langs, "en", None, "en", None])
    model = op10.fit_language_model(docs, op10.fold_of("doc_id", 4) != 2)
    got = {r.doc_id: r for r in op10.identify_language(docs, model, op10.fold_of("doc_id", 4) == 2).collect()}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(got[i].held_out for i in held)
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.97
    assert [got[len(texts) + k].lang_pred for k in range(4)] == ["und"] * 4 and all(0 <= r.score <= 1 for r in got.values())
    kept = op10.keep_identified(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * len(texts)
    assert {r.lang_pred for r in op10.identify_language(docs, None, F.lit(False)).collect()} == {"und"}
    assert op10.fit_language_model(docs.limit(0), F.lit(True)) is None


def test_folded_weights_equal_the_kernel():
    texts, langs = language_corpus(60)
    sets = [op10.presence(t) for t in texts]
    model = op10.KernelModel.fit(sets, langs, landmarks=20)
    k = lambda a, b: sum(len(np.intersect1d(x, y)) / np.sqrt(len(x) * len(y)) for x, y in zip(a, b)) / 5
    order = sorted(range(60), key=lambda i: langs[i])
    marks = [order[i] for i in np.unique(np.linspace(0, 59, 20).astype(int))]
    direct = sum(op10.rows_of([s[n] for s in sets], size) @ op10.rows_of([sets[m][n] for m in marks], size).T for n, size in enumerate(op10.BUCKETS)) / 5
    assert direct[3, 4] == pytest.approx(k(sets[3], sets[marks[4]]), rel=1e-4)
    assert model.score(texts)[0] == langs
    w = np.random.default_rng(0).standard_normal((op10.BUCKETS[1], 2))
    some = [np.empty(0, np.int64), sets[0][1], np.empty(0, np.int64), sets[1][1]]
    assert op10.product(some, w) == pytest.approx(op10.rows_of(some, op10.BUCKETS[1]) @ w, abs=1e-5)


# all


def odd_documents(spark):
    """Rows without an id, repeated rows, two texts under one id, and two very long texts, one of them without any white space."""
    texts = ["the river runs to the sea", "the river runs to the sea", None, "stone " * 200_000, "x" * 1_000_000, "another text of that id"]
    return spark.createDataFrame([(i, t, "en", "s", 1, 0.5, "k", 7) for i, t in zip([None, None, None, 4, 5, 4, 4], [*texts, texts[-1]])], SHAPE), texts


def test_rows_without_an_id_and_long_texts_through_every_operator(spark, tmp_path):
    import public_tokenizers as P

    docs, texts = odd_documents(spark)
    rows, lengths = docs.count(), {t: len(t or "") for t in texts}
    ids_of = lambda r: (-1 if r.doc_id is None else r.doc_id)
    want = sorted([-1, -1, -1, 4, 5, 4, 4])

    enc = encoder(default_path())
    n_ids = {t: len(enc.library.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts}
    total = sum(n_ids[t] for t in [*texts, texts[-1]])
    pieces = op2.pack_along_curve(docs).collect()
    assert sum(p.length for p in pieces) == total and sorted(ids_of(p) for p in pieces if p.start == 0) == want

    op4.write_token_shards(docs, f"{tmp_path}/odd")
    got = sorted(op4.read_token_shards(spark, f"{tmp_path}/odd").collect(), key=lambda r: r.start)
    assert [ids_of(r) for r in got] == want and sorted(r.n_tokens for r in got) == sorted(n_ids[t] for t in [*texts, texts[-1]])
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()

    got = op3.compression_bands(docs).collect()
    assert sorted(map(ids_of, got)) == want and {r.word_chars for r in got if r.doc_id == 5} == {lengths[texts[4]]} and {r.n_words for r in got if r.doc_id == 4} == {200_000, 5}
    assert {r.n_repeat_words for r in got if r.n_words == 200_000} == {200_000}

    got = op9.byte_bpe(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()
    assert sorted(map(ids_of, got)) == want
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for t in [*texts, texts[-1]])

    got = op8.lm_difference(docs, docs.where("doc_id = 4").select("doc_id")).collect()
    assert sorted(map(ids_of, got)) == want and sorted(r.n_tokens for r in got) == sorted([6, 6, 0, 200_000, 1, 5, 5]) and all(np.isfinite(r.score) for r in got)

    corpus, langs = language_corpus(60)
    model = op10.fit_language_model(documents(spark, corpus, langs), F.lit(True))
    got = op10.identify_language(docs, model, op10.fold_of("doc_id", 4) == 2).collect()
    assert sorted(map(ids_of, got)) == want and not any(r.held_out for r in got if r.doc_id is None)
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id is None}) == 2

    scorer = op7.ToxicityModel(characters(), {"=stone": 5.0}, -2.0)
    got = op7.score_toxicity(docs, scorer, op10.fold_of("doc_id", 5) == 0).collect()
    assert sorted(map(ids_of, got)) == want and not any(r.held_out for r in got if r.doc_id is None) and sum(r.predicted for r in got) == 1

    got = op6.keep_first_of_groups(docs).collect()
    assert rows == 7 and sorted(len(r.text or "") for r in got if r.doc_id is not None) == sorted(map(len, texts[3:]))


def test_equal_languages_go_by_name_and_empty_samples_fit_nothing(spark):
    """Where two languages have the same texts, equal rows get one answer, one of the two."""
    texts = language_corpus(60)[0][:20]
    docs = documents(spark, [*texts, *texts], ["xx"] * 20 + ["aa"] * 20)
    model = op10.fit_language_model(docs, F.lit(True))
    got = op10.identify_language(docs, model, F.lit(False)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id % 20, set()).add((r.lang_pred, r.score))
    assert all(len(v) == 1 for v in by.values()) and {r.lang_pred for r in got} <= {"aa", "xx"}
    marks = spark.createDataFrame([(0, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert op7.fit_toxicity_model(docs.limit(0), marks, F.lit(True)) is None and op7.fit_toxicity_model(docs, marks.where("toxic = 1"), F.lit(True)) is None
