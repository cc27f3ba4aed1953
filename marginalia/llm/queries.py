"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import op01_minhash, op02_quality, op03_packing, op04_fingerprint, op05_urls, op06_pii, op07_licence, op08_tokens, op09_chat, op10_decontaminate, op11_repair, op12_middle, op13_secrets
from .common import table

BYTE_BPE = "byte_bpe_50k.json"


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op02_quality.scores(docs, op02_quality.train(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_pii.find(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_urls.judged(table(spark, sf_dir, "pages"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_licence.scan(table(spark, sf_dir, "documents"))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_chat.report(table(spark, sf_dir, "conversations"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op10_decontaminate_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_repair.report(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_middle.report(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_secrets.find(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_packing": op3_packing,
    "op4_fingerprints": op4_fingerprints,
    "op5_url_filter": op5_url_filter,
    "op6_personal_data": op6_personal_data,
    "op7_licence_scan": op7_licence_scan,
    "op8_token_counts": op8_token_counts,
    "op9_chat_rotation": op9_chat_rotation,
    "op10_decontaminate_benchmark": op10_decontaminate_benchmark,
    "op11_structure_repair": op11_structure_repair,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_secret_scan": op13_secret_scan,
}

#: The others need models, graphs or library calls that SQL can't express; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op7_licence_scan": op07_licence.oracle(),
    "op9_chat_rotation": op09_chat.ORACLE,
    "op11_structure_repair": op11_repair.oracle(),
    "op12_fill_in_middle": op12_middle.ORACLE,
    "op13_secret_scan": op13_secrets.oracle(),
}
