"""The pipeline on planted documents: each stage's decisions, its columns, and the packed remainder against brute force."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_ops_small import language_corpus
from tidegrid.llm import op6_simhash as op6
from tidegrid.llm.word_tokens import default_path, encoder


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    texts, langs = language_corpus(300)
    rng = np.random.default_rng(3)
    toxic = [f"{t} idiot moron" if i % 5 == 0 else t for i, t in enumerate(texts)]
    rows = list(zip(toxic, langs)) + [(toxic[1], "en"), (toxic[1].upper(), "en"), ("12 34 !!", "en"), (None, None), ("", "fr")]
    order = rng.permutation(len(toxic))
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(int(i), 1, int(i % 5 == 0)) for i in order], "doc_id long, quality int, toxic int")
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_stages(spark, planted):
    d, rows = planted
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == names
        left[name] = {r.doc_id for r in docs.collect()}
    n = len(rows) - 5
    assert not left["language"] & {n + 2, n + 3, n + 4} and left["language"] >= set(range(n))
    assert not left["toxicity"] & {i for i in range(n) if i % 5 == 0} and len(left["toxicity"]) == n - n // 5 + 2
    fps = {i: op6.fingerprint(rows[i][0]) for i in left["toxicity"]}
    want = set()
    for i in sorted(fps):  # no chains are planted: the first of each group stays
        if not any((fps[i] ^ fps[j]).bit_count() <= 2 for j in want):
            want.add(i)
    assert left["near_duplicates"] == want and 1 in want and n not in want and n + 1 not in want


def test_language_stage_drops_texts_in_no_learned_language(spark, planted, tmp_path):
    d, rows = planted
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rng = np.random.default_rng(8)
    gibberish = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(30)) for _ in range(20)]
    unlearned = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Все люди рождаются свободными и равными в своём достоинстве и правах.", "人人生而自由，在尊严和权利上一律平等。"]
    more = spark.createDataFrame([(10_000 + i, t, None, "s", len(t)) for i, t in enumerate(gibberish + unlearned)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.union(more), d).collect()}
    assert kept >= set(range(len(rows) - 5)) and max(kept) < 10_000


def test_run_packs_what_is_left(spark, planted):
    d, rows = planted
    enc = encoder(default_path())
    pieces = corpus_pipeline.run(spark, d).collect()
    by = {}
    for p in pieces:
        ids = np.append(enc.library.encode(rows[p.doc_id][0], add_special_tokens=False).ids, 2).astype("<u4")
        assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        by[p.doc_id] = by.get(p.doc_id, 0) + p.length
    assert 100 < len(by) < len(rows)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 4


def test_empty_tables(spark, planted, tmp_path):
    d, _ = planted
    for name in ("documents", "labels"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
