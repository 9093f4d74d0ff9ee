"""Queries of the text operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cirrostrat.llm import decontaminate, dedup_spans, html, langid, merkle, mixing, search, simhash, sketch, tokens, toxicity, treaps, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": langid.op1_langid,
    "op2_tokens": tokens.op2_tokens,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_html": html.op4_html,
    "op5_simhash": simhash.op5_simhash,
    "op6_topk": search.op6_topk,
    "op7_warc": warc.op7_warc,
    "op8_substrings": dedup_spans.op8_substrings,
    "op9_mixing": mixing.op9_mixing,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_merkle": merkle.op11_merkle,
    "op12_sketch": sketch.op12_sketch,
    "op13_search": treaps.op13_search,
}

ORACLE_SQL: dict[str, str] = {"op6_topk": search.SQL, "op7_warc": warc.SQL, "op8_substrings": dedup_spans.SQL, "op11_merkle": merkle.SQL, "op13_search": treaps.SQL}
