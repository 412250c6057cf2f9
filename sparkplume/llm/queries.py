"""Registered queries of this subpackage: each runs its operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkplume.llm import bpe, collocations, licences, runs
from sparkplume.llm.decontaminate import contamination
from sparkplume.llm.language import predict_languages
from sparkplume.llm.minhash import near_duplicates
from sparkplume.llm.permutation import nearest
from sparkplume.llm.pii import personal_data
from sparkplume.llm.quality import quality
from sparkplume.llm.repeats import remove_repeats
from sparkplume.llm.simhash import simhash_duplicates
from sparkplume.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_factorisation_machine(spark: SparkSession, sf: str) -> DataFrame:
    return quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_hyperminhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


@query
def op3_interval_tree_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(table(spark, sf, "documents"))


@query
def op4_licence_digests(spark: SparkSession, sf: str) -> DataFrame:
    return licences.scan(table(spark, sf, "documents"), licences.known_licences(spark))


ORACLE["op4_licence_digests"] = licences.scan_sql()


@query
def op5_boosted_pii(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data(table(spark, sf, "documents"))


@query
def op6_permutation_index(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(table(spark, sf, "embeddings"))


@query
def op7_toxic_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op8_rank_order_language(spark: SparkSession, sf: str) -> DataFrame:
    return predict_languages(table(spark, sf, "documents"))


@query
def op9_bpe_forced_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_suffix_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op11_son_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


ORACLE["op11_son_collocations"] = collocations.collocations_sql()


@query
def op12_dyadic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(runs.looped(table(spark, sf, "documents"))))


@query
def op13_anchor_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf, "documents"))
