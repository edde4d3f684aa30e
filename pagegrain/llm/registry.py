"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagegrain.llm import bpe, chat, decontamination, embeddings, extraction, langid, lines, mixing, pii, repair, simhash, substrings, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": chat.op1_chat,
        "op2_extraction": extraction.op2_extraction,
        "op3_substrings": substrings.op3_substrings,
        "op4_lines": lines.op4_lines,
        "op5_langid": langid.op5_langid,
        "op6_pii": pii.op6_pii,
        "op7_mixing": mixing.op7_mixing,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_embeddings": embeddings.op9_embeddings,
        "op10_simhash": simhash.op10_simhash,
        "op11_repair": repair.op11_repair,
        "op12_whitening": whitening.op12_whitening,
        "op13_bpe": bpe.op13_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat": chat.SQL,
        "op2_extraction": extraction.SQL,
        "op3_substrings": substrings.SQL,
        "op7_mixing": mixing.SQL,
        "op8_decontamination": decontamination.SQL,
        "op9_embeddings": embeddings.SQL,
        "op11_repair": repair.SQL,
    }
