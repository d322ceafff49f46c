"""Merging states: objects merge deeply and results win, arrays append at any depth, anything else is replaced.

States are JSON texts. Where a schema is known, merge_columns does it on columns; deep_merge.merge_states takes any text,
on the JVM. merge_json merges two columns in Arrow batches, fold_states a workflow's results in order.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import load
from .deep_merge import merge_states
from .fold import ordered_fold


def merge_values(current, results):
    if isinstance(current, dict) and isinstance(results, dict):
        out = dict(current)
        for k, v in results.items():
            nested = k in out and (isinstance(out[k], dict) and isinstance(v, dict) or isinstance(out[k], list) and isinstance(v, list))
            out[k] = merge_values(out[k], v) if nested else v
        return out
    if isinstance(current, list) and isinstance(results, list):
        return current + results
    return results


def merge_texts(current: str | None, results: str | None) -> str | None:
    """An empty side gives the other; invalid JSON is an error."""
    if not current:
        return results
    if not results:
        return current
    return json.dumps(merge_values(json.loads(current), json.loads(results)), separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def _merge_series(current: pd.Series, results: pd.Series) -> pd.Series:
    return pd.Series([merge_texts(c, r) for c, r in zip(current, results)], dtype=object)


def merge_json(current: Column, results: Column) -> Column:
    return F.pandas_udf(_merge_series, "string")(current, results)


def merge_columns(current: str, results: str, fields: dict[str, str]) -> Column:
    """Two structs of the same fields merged natively: fields of kind array append, others take a result that is not null."""
    of = lambda side, f: F.col(f"{side}.{f}")
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return F.struct(*((F.concat(empty(of(current, f)), empty(of(results, f))) if kind == "array" else F.coalesce(of(results, f), of(current, f))).alias(f) for f, kind in fields.items()))


def fold_states(log: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """The merged state of each key after all its rows, in order."""

    def step(held: dict, row: dict) -> None:
        held["state"] = merge_texts(held["state"], row[state])

    return ordered_fold(log.select(key, order, state), key, [order], lambda: {"state": None}, step, "state string", lambda held: held)


def _turns(s, d):
    state = F.to_json(F.struct(F.col("role").alias("last_role"), F.array("role").alias("roles"), F.struct(F.octet_length("text").alias("last"), F.array(F.octet_length("text")).alias("all")).alias("size")))
    return load(s, d, "conversations").select("conv_id", "turn", state.alias("state"))


def _merge_typed(s, d):
    """The fold by aggregates alone: overriding fields take the last turn, arrays are those of all turns in order."""
    c = load(s, d, "conversations").select("conv_id", "turn", "role", F.octet_length("text").alias("n"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "n")))  # a conversation's turns, a few dozen
    return c.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.max_by("n", "turn").alias("last"), turns.alias("t")).select("conv_id", "last_role", "last", F.concat_ws(",", "t.role").alias("roles"), F.concat_ws(",", F.transform("t", lambda x: x["n"].cast("string"))).alias("sizes"))


def _merge_json(s, d):
    return _columns(fold_states(_turns(s, d), "conv_id", "turn", "state"))


def _columns(merged):
    state = F.from_json("state", "last_role string, roles array<string>, size struct<last:int, all:array<int>>")
    return merged.select("conv_id", state.alias("s")).select("conv_id", "s.last_role", "s.size.last", F.concat_ws(",", "s.roles").alias("roles"), F.concat_ws(",", F.col("s.size.all").cast("array<string>")).alias("sizes"))


QUERIES = {"merge_typed": _merge_typed, "merge_json": _merge_json, "merge_native": lambda s, d: _columns(merge_states(_turns(s, d), "conv_id", "turn", "state"))}
_SQL = """SELECT conv_id, arg_max(role, turn) AS last_role, CAST(arg_max(strlen(text), turn) AS INT) AS last, string_agg(role, ',' ORDER BY turn) AS roles, string_agg(CAST(strlen(text) AS VARCHAR), ',' ORDER BY turn) AS sizes FROM conversations GROUP BY conv_id"""
ORACLES = {"merge_typed": _SQL, "merge_json": _SQL, "merge_native": _SQL}
