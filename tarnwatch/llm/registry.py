"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, cover_tree, exact_dedup, hard_negatives, langid, line_dedup, minhash, mixing, packing, pii, sharding, toxicity, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_packing": packing.op4_packing,
        "op5_minhash": minhash.op5_minhash,
        "op6_cover_tree": cover_tree.op6_cover_tree,
        "op7_sharding": sharding.op7_sharding,
        "op8_pii": pii.op8_pii,
        "pii_base_spans": pii.base_columns,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_langid": langid.op10_langid,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_whitening": whitening.op12_whitening,
        "op13_chat_format": chat_format.op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op5_minhash": minhash.OP5_SQL,
        "op6_cover_tree": cover_tree.OP6_SQL,
        "op9_line_dedup": line_dedup.OP9_SQL,
        "pii_base_spans": pii.BASE_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op13_chat_format": chat_format.OP13_SQL,
    }
