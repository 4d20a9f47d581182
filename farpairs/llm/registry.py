"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from farpairs.llm import bpe, collocations, decontaminate, extraction, licenses, neardup, ngrams, quality, ranked, shards, tokenids, urls, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_bpe": bpe.op3_bpe,
        "op4_neardup": neardup.op4_neardup,
        "op5_token_ids": tokenids.op5_token_ids,
        "op6_lm_score": ngrams.op6_lm_score,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_shards": shards.op8_shards,
        "op9_urls": urls.op9_urls,
        "op10_warc": warc.op10_warc,
        "op11_main_text": extraction.op11_main_text,
        "op12_ranked_search": ranked.op12_ranked_search,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": quality.OP7_SQL, "op9_urls": urls.OP9_SQL, "op10_warc": warc.OP10_SQL, "op11_main_text": extraction.OP11_SQL, "op12_ranked_search": ranked.OP12_SQL, "op13_collocations": collocations.OP13_SQL}
