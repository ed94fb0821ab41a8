"""The registered queries of this package, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytepairs, clusters, contexts, mixing, negatives, pieces, quotes, simhash, sketches, suffixes, topk, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_simhash": simhash.op2_simhash,
        "op3_suffix_dedup": suffixes.op3_suffix_dedup,
        "op4_fingerprints": sketches.op4_fingerprints,
        "op5_topk": topk.op5_topk,
        "op6_url_filters": urls.op6_url_filters,
        "op7_lm_scoring": contexts.op7_lm_scoring,
        "op8_quotation_linking": quotes.op8_quotation_linking,
        "quotation_links_as_given": quotes.quotation_links_as_given,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op10_mixing": mixing.op10_mixing,
        "op11_byte_bpe": bytepairs.op11_byte_bpe,
        "op12_centroid_clustering": clusters.op12_centroid_clustering,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": topk.SQL, "op6_url_filters": urls.SQL, "op8_quotation_linking": quotes.SQL, "quotation_links_as_given": quotes.SQL_AS_GIVEN, "op10_mixing": mixing.SQL, "op12_centroid_clustering": clusters.SQL, "op13_hard_negatives": negatives.SQL}
