"""Incremental snapshots: chains of base states and deltas that give a key's state as of any sequence.

A log changes fields of keyed states (key, log_index, op, field, value): set and unset a field, delete the whole key.
What a batch of it does to a key is one delta (wiped, sets, unsets), and deltas compose, natively and in any grouping. A
chain has the deltas of a key in order, each with the sequence it is based on, and after every ``most`` of them a base
with the full state, which begins a new segment. So the state as of a sequence takes the nearest base at or before it
and at most ``most`` deltas, however long the chain and whatever the key; rows are found by key and segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.prefix import numbered, prefixes, sorted_by
from ..plans.shared import staged
from ..sources.tables import SQL_COMMANDS, commands

MOST_DELTAS = 50  # fixed value: deltas after which a full snapshot is taken
CHAIN = "key string, segment long, sequence long, kind string, based_on_sequence long, wiped boolean, sets map<string,string>, unsets array<string>"
_MAP, _NAMES = "map<string,string>", "array<string>"


def change(wiped: Column, sets: Column, unsets: Column) -> Column:
    return F.struct(wiped.alias("wiped"), sets.cast(_MAP).alias("sets"), unsets.cast(_NAMES).alias("unsets"))


def nothing() -> Column:
    """The change that changes nothing."""
    return change(F.lit(False), F.create_map(), F.array())


def then(f: Column, g: Column) -> Column:
    """Two changes in one."""
    kept = F.map_filter(f["sets"], lambda k, _: ~F.map_contains_key(g["sets"], k) & ~F.array_contains(g["unsets"], k))
    gone = F.filter(F.array_union(f["unsets"], g["unsets"]), lambda k: ~F.map_contains_key(g["sets"], k))
    return F.when(g["wiped"], g).otherwise(change(f["wiped"], F.map_concat(kept, g["sets"]), gone))


def deltas(log: DataFrame, batch: Column) -> DataFrame:
    """key, sequence, wiped, sets, unsets: what each batch of the log does to each key; sequence is the last log_index in it.

    batch must not fall as log_index rises. Only the last change of a field after the last delete is kept, by aggregates
    that combine before they are shuffled. A null field or an unknown op changes nothing.
    """
    rows = log.select("key", batch.alias("_batch"), "log_index", "op", "field", "value")
    ends = rows.groupBy("key", "_batch").agg(F.max("log_index").alias("sequence"), F.max(F.when(F.col("op") == "delete", F.col("log_index"))).alias("_cut"))
    fields = rows.where("op in ('set', 'unset') and field is not null").groupBy("key", "_batch", "field").agg(F.max_by(F.struct("op", "value"), "log_index").alias("_last"), F.max("log_index").alias("_at"))
    live = fields.join(ends.select(F.col("key").alias("_key"), F.col("_batch").alias("_of"), "_cut"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("_batch") == F.col("_of")))
    live = live.where(F.coalesce(F.col("_at") > F.col("_cut"), F.lit(True)))
    is_set = F.col("_last.op") == "set"
    sets = F.map_from_entries(F.collect_list(F.when(is_set, F.struct("field", "_last.value"))))  # the fields of one state
    changed = live.groupBy("key", "_batch").agg(sets.alias("sets"), F.collect_list(F.when(~is_set & F.col("_cut").isNull(), F.col("field"))).alias("unsets"))
    changed = changed.select(F.col("key").alias("_key"), F.col("_batch").alias("_of"), "sets", "unsets")
    out = ends.join(changed, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_batch") == F.col("_of")), "left")
    return out.select("key", "sequence", F.col("_cut").isNotNull().alias("wiped"), F.coalesce("sets", F.create_map().cast(_MAP)).alias("sets"), F.coalesce("unsets", F.array().cast(_NAMES)).alias("unsets"))


def chain(changes: DataFrame, most: int = MOST_DELTAS) -> DataFrame:
    """The chain (CHAIN) of deltas (key, sequence, wiped, sets, unsets), sequence unique in a key.

    Segments of ``most`` deltas are composed by themselves, then segments along a key, so a key of any length is the
    work of many tasks and no task holds more than a block of states.
    """
    placed = staged(numbered(changes, ["key"], ["sequence"], "_nth").withColumn("segment", F.floor(F.col("_nth") / most)))
    items = sorted_by("sequence", F.collect_list(F.struct("sequence", change(F.col("wiped"), F.col("sets"), F.col("unsets")).alias("change"))))  # most at the most
    whole = F.aggregate("_items", nothing(), lambda a, x: then(a, x["change"]))
    segments = placed.groupBy("key", "segment").agg(items.alias("_items")).select("key", "segment", whole.alias("_change"), F.element_at("_items", -1)["sequence"].alias("_ends"))
    bases = prefixes(segments, ["key"], ["segment"], F.col("_change"), nothing(), then, "_state", 64)
    ends = segments.select(F.col("key").alias("_key"), (F.col("segment") + 1).alias("_next"), F.col("_ends").alias("sequence"))
    bases = bases.drop("_ends").join(ends, F.col("key").eqNullSafe(F.col("_key")) & (F.col("segment") == F.col("_next")))
    bases = bases.select("key", "segment", "sequence", F.lit("base").alias("kind"), F.lit(None).cast("long").alias("based_on_sequence"), F.lit(True).alias("wiped"), F.col("_state.sets").alias("sets"), F.array().cast(_NAMES).alias("unsets"))
    # a delta is based on the one before; the first of a segment on the segment's base, which ends with the one before it
    within = Window.partitionBy("key", "segment").orderBy("sequence")
    first = bases.select(F.col("key").alias("_key"), F.col("segment").alias("_of"), F.col("sequence").alias("_base"))
    rows = placed.withColumn("_before", F.lag("sequence").over(within)).join(first, F.col("key").eqNullSafe(F.col("_key")) & (F.col("segment") == F.col("_of")), "left")
    rows = rows.select("key", "segment", "sequence", F.lit("delta").alias("kind"), F.coalesce("_before", "_base").alias("based_on_sequence"), "wiped", "sets", "unsets")
    return rows.unionByName(bases)


def resolve(rows: DataFrame, at: Sequence[int] | DataFrame) -> DataFrame:
    """key, as_of, sequence (of the last change) and state (a map) of a chain as of sequences: some for all keys, or rows (key, as_of).

    An as-of join to the last segment that had begun, then the ordered merge of its base and deltas up to the sequence.
    A sequence between two rows of a chain is as of the first. Keys without a field then, deleted ones included, are absent.
    """
    if isinstance(at, DataFrame):
        asked = at.select(F.col("key").alias("_key"), F.col("as_of").cast("long").alias("as_of")).distinct()
    else:
        asked = rows.select(F.col("key").alias("_key")).distinct().withColumn("as_of", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in at)).cast("array<long>")))
    begun = rows.groupBy("key", "segment").agg(F.min("sequence").alias("_from"))
    of = begun.join(asked, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_from") <= F.col("as_of"))).groupBy("_key", "as_of").agg(F.max("segment").alias("_of"))
    wanted = rows.join(of, F.col("key").eqNullSafe(F.col("_key")) & (F.col("segment") == F.col("_of")) & (F.col("sequence") <= F.col("as_of")))
    step = F.struct("sequence", change(F.col("wiped"), F.col("sets"), F.col("unsets")).alias("change"))
    items = wanted.groupBy("key", "as_of").agg(sorted_by("sequence", F.collect_list(step)).alias("_items"), F.max("sequence").alias("sequence"))  # one segment
    state = F.aggregate("_items", nothing(), lambda a, x: then(a, x["change"]))["sets"]
    return items.select("key", "as_of", "sequence", state.alias("state")).where(F.size("state") > 0)


def compact(rows: DataFrame, before: int) -> DataFrame:
    """The chain without what came before a sequence: a base as of it, then what follows. States from it on are the same."""
    bases = resolve(rows, [before]).drop("as_of")
    begun = rows.where(F.col("sequence") <= before).groupBy("key").agg(F.max("segment").alias("segment")).withColumnRenamed("key", "_key")
    bases = bases.join(begun, F.col("key").eqNullSafe(F.col("_key")))
    bases = bases.select("key", "segment", "sequence", F.lit("base").alias("kind"), F.lit(None).cast("long").alias("based_on_sequence"), F.lit(True).alias("wiped"), F.col("state").alias("sets"), F.array().cast(_NAMES).alias("unsets"))
    return bases.unionByName(rows.where(F.col("sequence") > before))


def shorten(rows: DataFrame, most: int) -> DataFrame:
    """The chain cut into segments of another length; a base that nothing precedes stays as the first change."""
    own = rows.where("kind = 'delta'").select(F.col("key").alias("_key"), F.min("sequence").over(Window.partitionBy("key")).alias("_first")).distinct()
    heads = rows.where("kind = 'base'").groupBy("key").agg(F.min_by(F.struct("sequence", "wiped", "sets", "unsets"), "sequence").alias("h")).join(own, F.col("key").eqNullSafe(F.col("_key")), "left")
    heads = heads.where(F.coalesce(F.col("h.sequence") < F.col("_first"), F.lit(True))).select("key", "h.*")
    return chain(rows.where("kind = 'delta'").select("key", "sequence", "wiped", "sets", "unsets").unionByName(heads), most)


BATCH = 64  # log entries that make one delta in the queries


def _changes(s: SparkSession, d: str) -> DataFrame:
    n = F.col("log_index")
    op = F.when(F.col("kind") == "node_error", "delete").when(n % 11 == 0, "unset").otherwise("set")
    return commands(s, d).select(F.concat(F.lit("workflow:"), F.col("user_id").cast("string")).alias("key"), "log_index", op.alias("op"), F.concat("kind", F.lit("_"), (n % 3).cast("string")).alias("field"), (n % 1000).cast("string").alias("value"))


def _chain(s, d, most=3):
    return staged(chain(deltas(_changes(s, d), F.floor(F.col("log_index") / BATCH)), most))


def _asked(s, d):
    last = commands(s, d).agg(F.max("log_index")).first()[0] or 0
    return [last * k // 4 // BATCH * BATCH - 1 for k in (1, 2, 3)] + [last]


def _text(df: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.map_entries("state"))
    return df.withColumn("state", F.concat_ws(";", F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"]))))


def _compacted(s, d):
    rows, asked = _chain(s, d), _asked(s, d)
    return _text(resolve(compact(rows, asked[1]), asked[1:]))


QUERIES = {
    "state_delta_chain": lambda s, d: _text(resolve(_chain(s, d), _asked(s, d))),
    "state_chain_compacted": _compacted,
    "state_chain_rows": lambda s, d: _chain(s, d).select("key", "segment", "sequence", "kind", "based_on_sequence"),
}
_LOG = f"""WITH {SQL_COMMANDS}, l AS (SELECT 'workflow:' || user_id AS key, log_index AS n, CASE WHEN kind = 'node_error' THEN 'delete' WHEN log_index % 11 = 0 THEN 'unset' ELSE 'set' END AS op, kind || '_' || (log_index % 3) AS field, CAST(log_index % 1000 AS VARCHAR) AS value FROM c)"""
_RESOLVED = _LOG + f""", m AS (SELECT max(n) AS last FROM l), a AS (SELECT last * unnest([1, 2, 3]) // 4 // {BATCH} * {BATCH} - 1 AS as_of FROM m UNION SELECT last FROM m),
k AS (SELECT key, as_of, max(n) AS sequence, coalesce(max(n) FILTER (op = 'delete'), -1) AS cut FROM l, a WHERE n <= as_of GROUP BY ALL),
f AS (SELECT l.key, k.as_of, field, arg_max(op, n) AS op, arg_max(value, n) AS value FROM l JOIN k ON l.key = k.key AND n <= k.as_of AND n > cut WHERE op <> 'delete' GROUP BY ALL)
SELECT f.key, f.as_of, any_value(k.sequence) AS sequence, string_agg(field || '=' || value, ';' ORDER BY field) AS state FROM f JOIN k USING (key, as_of) WHERE op = 'set'"""
ORACLES = {
    "state_delta_chain": f"{_RESOLVED} GROUP BY f.key, f.as_of",
    "state_chain_compacted": f"{_RESOLVED} AND f.as_of > (SELECT min(as_of) FROM a) GROUP BY f.key, f.as_of",
    "state_chain_rows": f"""{_LOG}, b AS (SELECT key, max(n) AS sequence FROM l GROUP BY key, n // {BATCH}), p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sequence) - 1 AS nth, lag(sequence) OVER (PARTITION BY key ORDER BY sequence) AS before FROM b)
SELECT key, nth // 3 AS segment, sequence, 'delta' AS kind, before AS based_on_sequence FROM p UNION ALL SELECT key, nth // 3, before, 'base', NULL FROM p WHERE nth > 0 AND nth % 3 = 0""",
}
