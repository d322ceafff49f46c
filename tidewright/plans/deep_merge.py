"""Deep merges of JSON states on the JVM: states as rows of nodes, the last writer by aggregates, rebuilt by level.

Every result is a tree of nodes (path, kind, text). A node keeps its kind from result to result or is replaced: of a
path's contributions those after the last one of another kind count, and none that an ancestor's change of kind has
replaced. Of scalars the last one stays, arrays append in order, objects are what their children are. All of that is
aggregates by path, so a key with many results is shared by all tasks until only its state is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged


def _nodes(log: DataFrame, key: str, order: str, state: str) -> list[DataFrame]:
    """Levels of key, n, path, parent, name, kind, text and v, from the roots on."""
    spark = log.sparkSession
    level = log.where(F.length(state) > 0).select(F.col(key).alias("key"), F.col(order).alias("n"), F.lit("").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"), F.parse_json(state).alias("v"))
    out = []
    while True:
        shape, text = F.schema_of_variant("v"), F.to_json("v")
        kind = F.when(F.startswith(shape, F.lit("OBJECT")), "object").when(F.startswith(shape, F.lit("ARRAY")), "array").otherwise("scalar")
        inner = F.when(kind == "array", F.substring(text, F.lit(2), F.length(text) - 2)).when(kind == "scalar", text)
        level = staged(level.select("key", "n", "path", "parent", "name", kind.alias("kind"), F.when(kind == "object", F.lit("")).otherwise(inner).alias("text"), F.when(kind == "object", F.col("v")).alias("v")))
        if level.isEmpty():
            return out
        out.append(level)
        below = spark.sql("select key, n, path as parent, child.key as name, child.value as v from {level}, lateral variant_explode(v) as child(pos, key, value) where kind = 'object'".replace("select key,", "select {level}.key,"), level=level)
        escaped = F.replace(F.replace("name", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        level = below.select("key", "n", F.concat("parent", F.lit("/"), escaped).alias("path"), "parent", "name", "v")


def _quoted(name: Column) -> Column:
    text = F.to_json(F.array(name))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def merge_states(log: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """key and state: the deep merge of each key's states (JSON texts) in order, keys of objects sorted.

    Empty and null states change nothing, and keys with no others are absent; JSON that is invalid, or repeats a name
    within an object, is an error. order is unique in a key.
    """
    levels, floors, above = _nodes(log, key, order, state), [], None
    for level in levels:
        kinds = level.groupBy("key", "path", "parent", "name", "kind").agg(F.max("n").alias("last"))
        final = kinds.groupBy("key", "path", "parent", "name").agg(F.max_by("kind", "last").alias("kind"), F.max("last").alias("last"), F.slice(F.sort_array(F.collect_list("last"), asc=False), 2, 1).alias("_other"))  # three kinds
        final = final.withColumn("floor", F.try_element_at("_other", F.lit(1))).drop("_other")
        if above is not None:
            up = above.select(F.col("key").alias("_key"), F.col("path").alias("_path"), F.col("floor").alias("_floor"))
            final = final.join(up, F.col("key").eqNullSafe(F.col("_key")) & (F.col("parent") == F.col("_path"))).withColumn("floor", F.greatest("floor", "_floor")).drop("_key", "_path", "_floor")
        above = staged(final.where(F.coalesce(F.col("last") > F.col("floor"), F.lit(True))))
        floors.append(above)
    below = None
    for level, final in reversed(list(zip(levels, floors))):
        of = final.select(F.col("key").alias("_key"), F.col("path").alias("_path"), F.col("kind").alias("_kind"), "floor")
        live = level.join(of, F.col("key").eqNullSafe(F.col("_key")) & (F.col("path") == F.col("_path")) & (F.col("kind") == F.col("_kind"))).where(F.coalesce(F.col("n") > F.col("floor"), F.lit(True)))
        appended = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == "array") & (F.col("text") != ""), F.struct("n", "text")))), lambda x: x["text"]), ",")  # as long as the state
        values = live.groupBy("key", "path", "parent", "name", "kind").agg(F.max_by("text", "n").alias("_last"), appended.alias("_all"))
        text = F.when(F.col("kind") == "array", F.concat(F.lit("["), "_all", F.lit("]"))).when(F.col("kind") == "scalar", F.col("_last"))
        if below is not None:
            members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "text"))), lambda x: F.concat(_quoted(x["name"]), F.lit(":"), x["text"])), ",")
            children = below.groupBy("key", "parent").agg(members.alias("_members")).select(F.col("key").alias("_key"), F.col("parent").alias("_path"), "_members")
            values = values.join(children, F.col("key").eqNullSafe(F.col("_key")) & (F.col("path") == F.col("_path")), "left")
            text = text.otherwise(F.concat(F.lit("{"), F.coalesce("_members", F.lit("")), F.lit("}")))
        else:
            text = text.otherwise(F.lit("{}"))
        below = staged(values.select("key", "path", "parent", "name", text.alias("text")))
    if below is None:
        return log.sparkSession.createDataFrame([], f"{key} {log.schema[key].dataType.simpleString()}, {state} string")
    return below.select(F.col("key").alias(key), F.col("text").alias(state))
