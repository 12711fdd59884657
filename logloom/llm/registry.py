"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import classifier, decontaminate, html_text, licenses, mixing, ngram_join, quality_rules, sharding, substrings, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_warc": warc.op2_warc,
        "op3_substrings": substrings.op3_substrings,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_classifier": classifier.op5_classifier,
        "op6_html_text": html_text.op6_html_text,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_ngram_join": ngram_join.op8_ngram_join,
        "op9_sharding": sharding.op9_sharding,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    """The verdicts of 5, 6, 7 and 10 come from learned or hand-written rules that SQL cannot state; the README says how each is tested."""
    return {
        "op1_mixing": mixing.oracle_sql(),
        "op2_warc": warc.oracle_sql(),
        "op3_substrings": substrings.oracle_sql(),
        "op4_decontaminate": decontaminate.oracle_sql(),
        "op8_ngram_join": ngram_join.oracle_sql(),
        "op9_sharding": sharding.oracle_sql(),
    }
