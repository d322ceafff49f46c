"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that its predecessor kept and, but for the last, returns documents with the
columns it got. Stages that filter keep what they don't reject, rows with null ids or texts included where
their operator keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm import minhash_dedup, mixing, packing, quality_classifier, quality_rules
from tidewright.llm._shared import free_name, quoted, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold. The model learns from labelled rows of the documents table.

    Null texts score as empty ones, which score too; texts of any length are read whole. Rows that repeat, and rows
    without id, are scored each; columns keep their names; an empty table gives no rows.
    """
    model = quality_classifier.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    return quality_classifier.with_score(docs, model, docs.columns, name).where(F.col(name) >= quality_classifier.THRESHOLD).drop(name)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned list, which labelled rows of the documents table teach.

    Null and empty texts have no words and fail the base rules; texts of any length are counted whole. Rows that repeat
    get the same verdict; columns keep their names; an empty table gives no rows.
    """
    learned = quality_rules.fit_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out, name = quality_rules.apply_rules(docs, learned, docs.columns)
    return out.where(F.col(f"{name}.kept")).drop(name)


def _hashable(field: T.StructField) -> Column:
    """A column as Spark can hash it: maps and variants, wherever they stand in it, as JSON."""
    column = F.col(quoted(field.name))
    kind = field.dataType.simpleString()
    return F.to_json(F.struct(column)) if "map<" in kind or "variant" in kind else column


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; five words and 0.8, all texts whole.

    Rows without id or without words stay, all of them. Rows that share an id but not their text are documents of
    their own. Of rows equal in id and text (ties) one stays, the smallest by its other columns. Columns keep their
    names, whatever those are; an empty table gives no rows.
    """
    found = minhash_dedup.near_duplicates(docs).where("stays and doc_id is not null")
    staying, hash_, n = free_name(docs, "staying_id"), free_name(docs, "text_hash"), free_name(docs, "n_rows")
    kept = found.groupBy(F.col("doc_id").alias(staying), F.col("text_hash").alias(hash_)).agg(F.when(F.max("n_shingles") > 0, F.count("*")).otherwise(1).alias(n))
    kept = staged(kept, "staying")
    out = docs.join(kept, (docs["doc_id"] == kept[staying]) & (F.xxhash64(docs["text"]) == kept[hash_]))
    once = out.where(F.col(n) == 1).select(*map(quoted, docs.columns))
    row, by = F.struct(*map(quoted, docs.columns)), [quoted(f.name) for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    again = out.where(F.col(n) > 1).groupBy(staying, hash_).agg(F.min_by(row, F.struct(*by, F.xxhash64(*(_hashable(f) for f in docs.schema)))).alias(n)).select(f"{n}.*")
    return once.unionAll(again).unionAll(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times; each row by its own draw, whatever id it has.

    A null source is a source of its own. Null, empty and very long texts count by their words, so those without any
    come out as often as their source's whole share says. Rows that repeat are drawn each; columns keep their names; an
    empty table gives no rows.
    """
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a packed sequence; a null or empty text is one piece, its end id. Rows that repeat are packed
    each, null ids kept, other columns dropped; an empty table gives no rows."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("quality rules", rules), ("near-duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None  # learned models, sampling and packing have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs
