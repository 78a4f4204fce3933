"""Registered queries of the operators, over their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quantflow.llm import (bpe, collocations, embeddings, jaccard, lattice, packing, paragraphs, repetition, search,
                           substrings, tokens, toxicity, warc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return repetition.quality(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_substring_removal(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_ngram_jaccard_join(spark, sf_dir):
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


def op8_paragraph_minhash(spark, sf_dir):
    return paragraphs.repeated_runs(table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                       public_tokenizers.PATTERN)


def op10_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_lattice_likelihood(spark, sf_dir):
    return lattice.score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_toxicity, op3_substring_removal, op4_warc_round_trip, op5_best_fit_packing, op6_token_counts,
    op7_ngram_jaccard_join, op8_paragraph_minhash, op9_bpe_round_trip, op10_embedding_near_dedup, op11_lexical_search,
    op12_lattice_likelihood, op13_collocations)}
ORACLE_SQL: dict[str, str] = {"op11_lexical_search": search.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
