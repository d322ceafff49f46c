"""Two example workflows over documents as chains of column transformations.

A step is a function of a DataFrame: it takes the rows whose status lets it run and leaves the others as they are, so
a chain of steps is one projection and Spark reads each text once. Names of steps, states and error texts are fixed
values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.tables import load

LEAST_BYTES, URGENT = 10, 8
TOO_SHORT, CORRUPTED, POOR = "document content too short", "document is corrupted and cannot be processed", "quality check failed"

def moved(where: Column, to: str) -> Column:
    return F.when(where, F.lit(to)).otherwise(F.col("status"))


def failed(why: Column) -> Column:
    """errors with one more, if why is not null."""
    return F.when(why.isNotNull(), F.concat("errors", F.array(why))).otherwise(F.col("errors"))


def ingest(docs: DataFrame, lists: S.Lists = S.FIXED) -> DataFrame:
    """workflow_id and content (null: empty) become a document with type and language."""
    text = F.coalesce("content", F.lit(""))
    out = docs.select("workflow_id", text.alias("content"), F.lit("ingested").alias("status"), S.document_type(text, lists).alias("type"), S.language(text, lists).alias("language"))
    return out.withColumns({"errors": F.array().cast("array<string>"), "expedited": F.lit(False)})


def analyze(docs: DataFrame, lists: S.Lists = S.FIXED) -> DataFrame:
    words = S.word_count(F.col("content"))
    return docs.withColumns({"word_count": words, "priority": S.priority(F.col("content"), words, F.col("type"), lists), "sentiment": S.sentiment(F.col("content"), lists), "keywords": S.keywords(F.col("content"))})


def validate(docs: DataFrame) -> DataFrame:
    why = F.when(F.col("status") == "ingested", F.when(F.octet_length("content") < LEAST_BYTES, TOO_SHORT).when(F.col("type") == "corrupted", CORRUPTED))
    return docs.withColumns({"status": moved((F.col("status") == "ingested") & why.isNull(), "validated"), "errors": failed(why)})


def repair(docs: DataFrame, lists: S.Lists = S.FIXED) -> DataFrame:
    broken = F.col("type") == "corrupted"
    return docs.withColumns({"content": F.when(broken, S.repaired(F.col("content"), lists)).otherwise(F.col("content")), "type": F.when(broken, "text").otherwise(F.col("type"))})


def translate(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content", S.translated(F.col("content"), F.col("language")))


def process(docs: DataFrame) -> DataFrame:
    ready = F.col("status") == "validated"
    return docs.withColumns({"content": F.when(ready, S.processed(F.col("content"), F.col("type"))).otherwise(F.col("content")), "status": moved(ready, "processed")})


def read_images(docs: DataFrame, lists: S.Lists = S.FIXED) -> DataFrame:
    image = (F.col("type") == "image") & (F.col("status") == "processed")
    return docs.withColumns({"content": F.when(image, S.ocr(F.col("content"), lists)).otherwise(F.col("content")), "type": F.when(image, "text").otherwise(F.col("type"))})


def check_quality(docs: DataFrame, gate: float = 0.0, steps: int = 6) -> DataFrame:
    ready, score = F.col("status") == "processed", S.quality_score(F.col("word_count"), F.col("language"), F.lit(steps))
    why = F.when(ready & (score < gate), POOR)
    return docs.withColumns({"quality": F.when(ready, score), "errors": failed(why), "status": moved(ready & why.isNull(), "quality_approved")})


def enhance(docs: DataFrame, gate: float) -> DataFrame:
    """Texts below the gate, improved and ready for another check."""
    poor = (F.col("status") == "processed") & (F.col("quality") < gate)
    return docs.withColumn("content", F.when(poor, S.enhanced(F.col("content"))).otherwise(F.col("content")))


def expedite(docs: DataFrame) -> DataFrame:
    """Urgent documents, whose owners are notified."""
    return docs.withColumn("expedited", (F.col("status") == "quality_approved") & (F.col("priority") >= URGENT))


def finish(docs: DataFrame) -> DataFrame:
    return docs.withColumn("status", moved(F.col("status") == "quality_approved", "completed"))


def document_pipeline(docs: DataFrame, gate: float = 0.0, lists: S.Lists = S.FIXED, again: bool = False) -> DataFrame:
    """The state of each document (workflow_id, content) after all steps.

    What fails validation is repaired and translated like the rest and validated once more; what fails twice stays
    ingested. What fails the quality gate stays processed; with ``again`` it is enhanced and checked once more first.
    errors has the failures in order.
    """
    out = analyze(ingest(docs, lists), lists)
    out = validate(translate(repair(validate(out), lists)))
    out = read_images(process(out), lists)
    out = check_quality(out, gate)
    if again:
        out = check_quality(enhance(out, gate), gate, 7)
    return finish(expedite(out))


def wrote(docs: DataFrame, step: str, where: Column) -> DataFrame:
    """history with one more step of the processor, for the rows that take it."""
    return docs.withColumn("history", F.when(where, F.concat("history", F.array(F.concat("processor", F.lit(f":{step}"))))).otherwise(F.col("history")))


def simple_validate(docs: DataFrame) -> DataFrame:
    """What is at validation goes on to repair, if it needs that and may have it, else to processing."""
    here = F.col("at") == "validate"
    mend = F.col("needs_repair") & F.col("allow_repair")
    return wrote(docs, "validate", here).withColumn("at", F.when(here, F.when(mend, "repair").otherwise("process")).otherwise(F.col("at")))


def simple_repair(docs: DataFrame) -> DataFrame:
    here = F.col("at") == "repair"
    return wrote(docs, "repair", here).withColumns({"needs_repair": F.col("needs_repair") & ~here, "at": F.when(here, "validate").otherwise(F.col("at"))})


def simple_process(docs: DataFrame) -> DataFrame:
    here = F.col("at") == "process"
    return wrote(docs, "process", here).withColumn("at", F.when(here, "done").otherwise(F.col("at")))


def simple_pipeline(docs: DataFrame) -> DataFrame:
    """status, history and executed of each row (workflow_id, needs_repair, allow_repair, processor) after intake, validation, repair where it is needed and allowed, and processing."""
    out = docs.withColumns({"history": F.array().cast("array<string>"), "at": F.lit("intake")})
    out = wrote(out, "intake", F.lit(True)).withColumn("at", F.lit("validate"))
    out = simple_process(simple_validate(simple_repair(simple_validate(out))))
    return out.select("workflow_id", F.when(F.col("at") == "done", "completed").otherwise("running").alias("status"), "history", F.size("history").alias("executed"))


def _simple(s: SparkSession, d: str) -> DataFrame:
    bad = load(s, d, "labels").where("quality = 0").select("doc_id").distinct().withColumn("bad", F.lit(True))
    docs = load(s, d, "documents").select("doc_id").join(bad, "doc_id", "left")
    rows = docs.select(F.col("doc_id").alias("workflow_id"), F.coalesce("bad", F.lit(False)).alias("needs_repair"), (F.col("doc_id") % 2 == 0).alias("allow_repair"), F.concat(F.lit("p"), (F.col("doc_id") % 3).cast("string")).alias("processor"))
    return simple_pipeline(rows).select(F.col("workflow_id").alias("doc_id"), "status", "executed", F.concat_ws(",", "history").alias("history"))


def _document(s: SparkSession, d: str, gate: float = 0.0, lists: S.Lists = S.FIXED, again: bool = False) -> DataFrame:
    out = document_pipeline(load(s, d, "documents").select(F.col("doc_id").alias("workflow_id"), F.col("text").alias("content")), gate, lists, again)
    return out.select(F.col("workflow_id").alias("doc_id"), "status", "type", "language", "word_count", "priority", "sentiment", "expedited", F.concat_ws("|", "errors").alias("errors"), F.md5("content").alias("digest"))


GATE = 0.95
QUERIES = {"dag_simple_pipeline": _simple, "dag_document_pipeline": _document, "dag_document_words": lambda s, d: _document(s, d, GATE, S.CORPUS, True)}


def _sql(gate: float, lists: S.Lists) -> str:
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, {S.sql_type(lists)} AS kind, {S.sql_answer(lists.languages, "unknown")} AS language, CAST({S._WORDS} AS INT) AS word_count, {S.sql_answer(lists.sentiments, "neutral")} AS sentiment FROM t),
b AS (SELECT *, CASE WHEN strlen(text) < 10 THEN '{TOO_SHORT}' WHEN kind = 'corrupted' THEN '{CORRUPTED}' END AS first, kind = 'corrupted' AS broken,
  CASE WHEN language = 'english' THEN '[ENHANCED] ' WHEN language <> 'unknown' THEN '[TRANSLATED] ' ELSE '' END || CASE WHEN kind = 'corrupted' THEN replace(text, '{lists.broken}', 'REPAIRED') ELSE text END AS body FROM a),
c AS (SELECT *, CASE WHEN first IS NOT NULL AND strlen(body) < 10 THEN '{TOO_SHORT}' END AS second, CASE WHEN broken THEN 'text' ELSE kind END AS after,
  CAST(least(10, 5 + 3 * contains(lower(text), '{lists.urgent}')::INT + 2 * (word_count > 1000)::INT + (kind = 'image')::INT) AS INT) AS priority,
  round(least(0.8 + 0.1 * ((word_count > 100)::INT + (language <> 'unknown')::INT), 1.0), 3) < {gate} AS poor FROM b),
e AS (SELECT *, second IS NULL AND poor AS refused, CASE WHEN after = 'image' THEN replace('[PROCESSED_IMG] ' || body, '{lists.image}', 'EXTRACTED_TEXT') WHEN after = 'document' THEN '[PROCESSED_DOC] ' || body ELSE '[PROCESSED] ' || body END AS done FROM c)
SELECT doc_id, CASE WHEN second IS NOT NULL THEN 'ingested' WHEN refused THEN 'processed' ELSE 'completed' END AS status, CASE WHEN second IS NULL AND after = 'image' THEN 'text' ELSE after END AS type, language, word_count, priority, sentiment,
  second IS NULL AND NOT refused AND priority >= 8 AS expedited, concat_ws('|', first, second, CASE WHEN refused THEN '{POOR}|{POOR}' END) AS errors, md5(CASE WHEN second IS NOT NULL THEN body WHEN refused THEN '[ENHANCED_QUALITY] ' || done ELSE done END) AS digest FROM e"""


ORACLES = {
    "dag_simple_pipeline": """SELECT doc_id, 'completed' AS status, CAST(3 + 2 * mend::INT AS INT) AS executed, p || ':intake,' || p || ':validate,' || CASE WHEN mend THEN p || ':repair,' || p || ':validate,' ELSE '' END || p || ':process' AS history
FROM (SELECT doc_id, 'p' || doc_id % 3 AS p, doc_id % 2 = 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS mend FROM documents)""",
    "dag_document_pipeline": _sql(0.0, S.FIXED),
    "dag_document_words": _sql(GATE, S.CORPUS),
}
