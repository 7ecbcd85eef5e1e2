"""Prompt and chunk functions, as expressions and under SQL names."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F


def llm_param(params: Column) -> Column:
    """Array with the JSON of a map."""
    return F.array(F.to_json(params))


def llm_result(calls: Column) -> Column:
    """The ``output`` of the first answer."""
    return F.get_json_object(F.get(calls, F.lit(0)), "$.output")


def llm_prompt(template: Column, values: Column) -> Column:
    """A template with ``{0}``, ``{1}``, ... filled from an array."""
    filled = F.aggregate(
        F.transform(values, lambda v, i: F.struct(i.alias("i"), F.coalesce(v, F.lit("")).alias("v"))), template,
        lambda acc, x: F.replace(acc, F.concat(F.lit("{"), x["i"].cast("string"), F.lit("}")), x["v"]),
    )
    return filled


def split_text(content: str, separators: Sequence[str], limit: int) -> list[str]:
    """Chunks of at most ``limit`` characters that end after the last separator in reach; together they are the text."""
    chunks, at = [], 0
    while len(content) - at > limit:
        window = content[at : at + limit]
        cut = max((window.rfind(s) + len(s) for s in separators if s and window.rfind(s) >= 0), default=limit)
        chunks.append(window[:cut])
        at += cut
    if at < len(content) or not chunks:
        chunks.append(content[at:])
    return chunks


def stack_calls(calls: Sequence[str], params: Sequence[str]) -> list[str]:
    """New parameters that carry the history of the last call."""
    last = json.loads(calls[0]) if calls else {}
    fresh = json.loads(params[0]) if params else {}
    if "history" in last:
        history = last["history"]
        fresh["history"] = history if isinstance(history, str) else json.dumps(history, ensure_ascii=False)
    return [json.dumps(fresh, ensure_ascii=False)]


def register(spark: SparkSession) -> None:
    """SQL functions llm_split, llm_stack, llm_param, llm_result, llm_response_predict, llm_prompt.

    The expression forms become SQL functions of the session, so they stay in
    the JVM; only splitting and JSON merging run in Python, by Arrow batches.
    """
    @F.pandas_udf("array<struct<content:string,content_id:int>>")
    def llm_split(content: pd.Series, separators: pd.Series, limit: pd.Series) -> pd.Series:
        return pd.Series([
            None if text is None else [{"content": c, "content_id": k} for k, c in enumerate(split_text(text, list(seps), int(n)))]
            for text, seps, n in zip(content, separators, limit)
        ])

    @F.pandas_udf("array<string>")
    def llm_stack(calls: pd.Series, params: pd.Series) -> pd.Series:
        return pd.Series([stack_calls(list(c) if c is not None else [], list(p) if p is not None else []) for c, p in zip(calls, params)])

    spark.udf.register("llm_split", llm_split)
    spark.udf.register("llm_stack", llm_stack)
    for name, args, body in (
        ("llm_param", "m MAP<STRING, STRING>", "array(to_json(m))"),
        ("llm_result", "calls ARRAY<STRING>", "get_json_object(get(calls, 0), '$.output')"),
        ("llm_response_predict", "calls ARRAY<STRING>", "get_json_object(get(calls, 0), '$.output')"),
        ("llm_prompt", "tpl STRING, vals ARRAY<STRING>", "aggregate(transform(vals, (v, i) -> struct(i, coalesce(v, '') as v)), tpl, (acc, x) -> replace(acc, concat('{', x.i, '}'), x.v))"),
    ):
        returns = "ARRAY<STRING>" if name == "llm_param" else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
