"""The registered queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.op1_multi_index import nearest_neighbours
from tidegrid.llm.op2_hilbert_pack import pack_along_curve
from tidegrid.llm.op3_compression import compression_bands
from tidegrid.llm.op4_token_coder import read_token_shards, write_token_shards
from tidegrid.llm.op5_html_lstm import extract_main_text, fit_labeller
from tidegrid.llm.op6_simhash import simhash_groups
from tidegrid.llm.op7_toxicity import fit_toxicity_model, score_toxicity
from tidegrid.llm.op8_lm_difference import lm_difference
from tidegrid.llm.op9_bpe_replay import byte_bpe
from tidegrid.llm.op10_langid import fit_language_model, fold_of, identify_language
from tidegrid.llm.op11_fair_mix import mix_sources
from tidegrid.llm.op11_fair_mix import oracle_sql as mix_sql
from tidegrid.llm.op12_prefix_trie import oracle_sql as trie_sql
from tidegrid.llm.op12_prefix_trie import prefix_trie, rebuilt_turns
from tidegrid.llm.op13_periodic_runs import periodic_runs, planted_tail
from tidegrid.session import shared_dir, ship_package, table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return table(spark, sf_dir, "documents")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_hilbert_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(_documents(spark, sf_dir))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(_documents(spark, sf_dir))


def op4_token_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_token_shards(_documents(spark, sf_dir), path)
    return read_token_shards(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    pages = table(spark, sf_dir, "pages")
    return extract_main_text(pages, fit_labeller(pages))


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit_toxicity_model(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 5) != 0)
    return score_toxicity(docs, model, fold_of("doc_id", 5) == 0)


def op8_lm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality."""
    docs = _documents(spark, sf_dir)
    return lm_difference(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


def op9_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe(_documents(spark, sf_dir), path, public_tokenizers.PATTERN, keep_ids=False)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit_language_model(docs, fold_of("doc_id", 4) != 2)
    return identify_language(docs, model, fold_of("doc_id", 4) == 2)


def op11_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return prefix_trie(rebuilt_turns(table(spark, sf_dir, "conversations")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(_documents(spark, sf_dir), planting=planted_tail)


def queries() -> dict[str, Query]:
    every = (op1_multi_index, op2_hilbert_pack, op3_compression_bands, op4_token_coder, op5_html_lstm)
    every += (op6_simhash_groups, op7_toxicity, op8_lm_difference, op9_bpe_replay, op10_language)
    every += (op11_fair_mix, op12_prefix_trie, op13_periodic_runs)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op11_fair_mix": mix_sql(), "op12_prefix_trie": trie_sql()}
