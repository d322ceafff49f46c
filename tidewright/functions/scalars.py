"""Scalar expressions over documents, error texts and sizes, all native columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import load

#: What texts hold, by the answer, in the order they are asked.
LANGUAGES = (("spanish", ("hola", "gracias")), ("french", ("bonjour", "merci")), ("german", ("guten", "danke")), ("english", ("hello", "thank")))
SENTIMENTS = (("positive", ("good", "excellent")), ("negative", ("bad", "terrible")))


@dataclass(frozen=True)
class Lists:
    """Words that the document functions look for; the defaults are fixed values."""

    broken: str = "ERROR"
    image: str = "IMAGE_DATA"
    urgent: str = "urgent"
    languages: tuple = LANGUAGES
    sentiments: tuple = SENTIMENTS


FIXED = Lists()


def first_match(text: Column, answers, other: str) -> Column:
    """The first answer one of whose words the lower-cased text holds."""
    out, low = None, F.lower(text)
    for answer, words in answers:
        found = low.contains(words[0])
        for w in words[1:]:
            found = found | low.contains(w)
        out = F.when(found, answer) if out is None else out.when(found, answer)
    return out.otherwise(other)


def document_type(text: Column, lists: Lists = FIXED) -> Column:
    return F.when(text.contains(lists.broken), "corrupted").when(text.contains(lists.image), "image").when(F.octet_length(text) > 1000, "document").otherwise("text")


def language(text: Column, lists: Lists = FIXED) -> Column:
    return first_match(text, lists.languages, "unknown")


def sentiment(text: Column, lists: Lists = FIXED) -> Column:
    return first_match(text, lists.sentiments, "neutral")


def fields(text: Column) -> Column:
    """Words between white space, Unicode's included."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(fields(text))


def priority(text: Column, words: Column, kind: Column, lists: Lists = FIXED) -> Column:
    return F.least(F.lit(5) + F.when(F.lower(text).contains(lists.urgent), 3).otherwise(0) + F.when(words > 1000, 2).otherwise(0) + F.when(kind == "image", 1).otherwise(0), F.lit(10))


def keywords(text: Column) -> Column:
    """The first five words of more than five bytes without "the" in them."""
    return F.slice(F.filter(fields(F.lower(text)), lambda w: (F.octet_length(w) > 5) & ~w.contains("the")), 1, 5)


def quality_score(words: Column, lang: Column, steps: Column, noise: Column | float = 0.0) -> Column:
    """0.7 and a tenth for length, known language and steps; noise stands for the random part."""
    noise = F.lit(noise) if isinstance(noise, float) else noise
    tenth = lambda c: F.when(c, 0.1).otherwise(0.0)
    return F.least(F.lit(0.7) + tenth(words > 100) + tenth(lang != "unknown") + tenth(steps > 5) + noise, F.lit(1.0))


def processed(text: Column, kind: Column) -> Column:
    return F.concat(F.when(kind == "document", "[PROCESSED_DOC] ").when(kind == "image", "[PROCESSED_IMG] ").otherwise("[PROCESSED] "), text)


def translated(text: Column, lang: Column) -> Column:
    return F.when(lang.isin("spanish", "french", "german"), F.concat(F.lit("[TRANSLATED] "), text)).when(lang == "english", F.concat(F.lit("[ENHANCED] "), text)).otherwise(text)


def ocr(text: Column, lists: Lists = FIXED) -> Column:
    return F.replace(text, F.lit(lists.image), F.lit("EXTRACTED_TEXT"))


def repaired(text: Column, lists: Lists = FIXED) -> Column:
    return F.replace(text, F.lit(lists.broken), F.lit("REPAIRED"))


def enhanced(text: Column) -> Column:
    return F.concat(F.lit("[ENHANCED_QUALITY] "), text)


#: Codes of error categories by a word of the message, then the category's own code.
ERROR_CODES = {
    "validation": (("required", "VALIDATION_REQUIRED"), ("invalid", "VALIDATION_INVALID"), ("", "VALIDATION_ERROR")),
    "network": (("timeout", "NETWORK_TIMEOUT"), ("connection", "NETWORK_CONNECTION"), ("", "NETWORK_ERROR")),
    "storage": (("not found", "STORAGE_NOT_FOUND"), ("conflict", "STORAGE_CONFLICT"), ("", "STORAGE_ERROR")),
    "raft": (("leader", "RAFT_LEADER"), ("election", "RAFT_ELECTION"), ("", "RAFT_ERROR")),
    "workflow": (("timeout", "WORKFLOW_TIMEOUT"), ("state", "WORKFLOW_STATE"), ("", "WORKFLOW_ERROR")),
    "timeout": (("", "TIMEOUT_ERROR"),),
    "permission": (("", "PERMISSION_DENIED"),),
    "resource": (("limit", "RESOURCE_LIMIT"), ("full", "RESOURCE_EXHAUSTED"), ("", "RESOURCE_ERROR")),
}
RETRYABLE, FINAL = ("network", "timeout", "resource", "raft"), ("validation", "configuration", "permission")


def error_code(category: Column, message: Column) -> Column:
    out, low = None, F.lower(message)
    for name, codes in ERROR_CODES.items():
        for word, code in codes:
            hit = (category == name) & low.contains(word)
            out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise("UNKNOWN_ERROR")


def inherited_code(category: Column, message: Column, cause_code: Column) -> Column:
    """The code of the error that caused it, if that is a domain error (not null), else the code of its own."""
    return F.coalesce(cause_code, error_code(category, message))


#: Sentinels of what is missing.
NOT_FOUND, LEASE_NOT_FOUND = "not found", "lease not found"


def is_not_found(category: Column, code: Column, message: Column) -> Column:
    """Whether an error says that something is missing: a domain error by category and code, others by their text; null is none."""
    text = message.contains("not found") | message.contains("no such key")
    return F.coalesce(F.when(category.isNotNull(), (category == "storage") & code.contains("NOT_FOUND")).otherwise(text), F.lit(False))


def is_lease_lost(sentinel: Column) -> Column:
    """Whether the error wraps one of the two sentinels that mean a lost lease."""
    return F.coalesce(sentinel.isin(NOT_FOUND, LEASE_NOT_FOUND), F.lit(False))


def retryable(category: Column, of_cause: Column | bool = False) -> Column:
    """By category; others take after the error that caused them."""
    return F.when(category.isin(*RETRYABLE), True).when(category.isin(*FINAL), False).otherwise(of_cause)


def retryable_text(message: Column) -> Column:
    """Whether the text of an error without a category speaks of something that may pass."""
    low = F.lower(message)
    return low.contains("timeout") | low.contains("connection") | low.contains("temporary") | low.contains("retry")


def user_facing(category: Column) -> Column:
    return category.isin(*FINAL)


#: Bytes of a unit.
UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30}


def parse_bytes(text: Column) -> Column:
    """Whole numbers with a unit, in any case and spacing; null for anything else."""
    flat = F.lower(F.regexp_replace(text, r"\s+", ""))
    unit, out = F.regexp_extract(flat, r"^\d+([a-z]*)$", 1), None
    for name, size in UNITS.items():
        out = F.when(unit == name, F.lit(size).cast("long")) if out is None else out.when(unit == name, F.lit(size).cast("long"))
    return F.when(flat.rlike(r"^\d+[a-z]*$"), F.regexp_extract(flat, r"^(\d+)", 1).try_cast("long") * out)


def backoff_seconds(retry: Column, base: float = 1.0, most: float = 300.0, clamp: int = 20) -> Column:
    """min(base * 2^n, most), without jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(retry, F.lit(clamp))), F.lit(most))


def _docs(s, d):
    return load(s, d, "documents").where("text is not null")


_P = lambda s, d: load(s, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("kb", " MB", "GiB", "b", "", "xb", "KiB "))), (F.col("p_partkey") % 7 + 1).cast("int"))).alias("t"))
_E = lambda s, d: load(s, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("validation", "network", "storage", "raft", "workflow", "resource", "other"))), (F.col("event_id") % 7 + 1).cast("int")).alias("category"), F.element_at(F.array(*map(F.lit, ("field required", "Invalid id", "Timeout reached", "connection lost", "key Not Found", "conflict", "please retry", "queue full", "no leader", "bad state"))), (F.col("user_id") % 10 + 1).cast("int")).alias("message"))
_SQL_E = "e AS (SELECT event_id, ['validation', 'network', 'storage', 'raft', 'workflow', 'resource', 'other'][event_id % 7 + 1] AS category, ['field required', 'Invalid id', 'Timeout reached', 'connection lost', 'key Not Found', 'conflict', 'please retry', 'queue full', 'no leader', 'bad state'][user_id % 10 + 1] AS message FROM events)"

def _kinds(e):
    """Every third error has a cause with a code, every fifth has no category; the sentinel is that of some."""
    n = F.col("event_id")
    cause = F.when(n % 3 == 0, F.concat(F.lit("CAUSE_"), (n % 4).cast("string")))
    category = F.when(n % 5 > 0, F.col("category"))
    code = inherited_code(F.col("category"), F.col("message"), cause)
    message = F.when(n % 11 == 0, F.lit("log not found")).when(n % 13 == 0, F.lit("no such key")).otherwise(F.col("message"))
    return e.select("event_id", code.alias("code"), is_not_found(category, code, message).alias("not_found"), is_lease_lost(F.when(n % 6 == 0, NOT_FOUND).when(n % 6 == 1, LEASE_NOT_FOUND).when(n % 6 == 2, "key exists")).alias("lease_lost"))


#: Words that the documents of the tables hold, so that every answer occurs.
CORPUS = Lists("***", "License", "@", (("spanish", ("ción", "ñ")), ("french", ("ê", "eaux")), ("german", ("ß", "ung")), ("english", ("only", "was "))), (("positive", ("heit", "only")), ("negative", ("ç", "###"))))


def _all(s, d):
    text, lists = F.col("text"), CORPUS
    words = word_count(text)
    kind, lang = document_type(text, lists), language(text, lists)
    digest = F.md5(ocr(repaired(translated(processed(text, kind), lang), lists), lists))
    return load(s, d, "documents").select("doc_id", kind.alias("type"), lang.alias("language"), sentiment(text, lists).alias("sentiment"), priority(text, words, kind, lists).alias("priority"), F.round(quality_score(words, lang, F.col("doc_id") % 10), 3).alias("score"), digest.alias("digest"))


QUERIES = {
    "fn_all_words": _all,
    "fn_type": lambda s, d: _docs(s, d).select("doc_id", document_type(F.col("text")).alias("type")),
    "fn_language": lambda s, d: _docs(s, d).select("doc_id", language(F.col("text")).alias("language")),
    "fn_priority": lambda s, d: _docs(s, d).select("doc_id", priority(F.col("text"), word_count(F.col("text")), document_type(F.col("text"))).alias("priority")),
    "fn_sentiment": lambda s, d: _docs(s, d).select("doc_id", sentiment(F.col("text")).alias("sentiment")),
    "fn_keywords": lambda s, d: _docs(s, d).select("doc_id", F.concat_ws("|", keywords(F.col("text"))).alias("keywords")),
    "fn_quality": lambda s, d: _docs(s, d).select("doc_id", F.round(quality_score(word_count(F.col("text")), language(F.col("text")), F.lit(4)), 3).alias("score")),
    "fn_repair": lambda s, d: _docs(s, d).select("doc_id", F.md5(repaired(F.replace(F.col("text"), F.lit("th"), F.lit("ERROR")))).alias("digest")),
    "fn_process": lambda s, d: _docs(s, d).select("doc_id", F.md5(enhanced(ocr(translated(processed(F.col("text"), document_type(F.col("text"))), F.lit("english"))))).alias("digest")),
    "fn_word_count": lambda s, d: _docs(s, d).select("doc_id", word_count(F.col("text")).alias("words")),
    "er_classify": lambda s, d: _E(s, d).select("event_id", error_code(F.col("category"), F.col("message")).alias("code"), retryable(F.col("category")).alias("retryable"), retryable_text(F.col("message")).alias("by_text"), user_facing(F.col("category")).alias("user_facing")),
    "er_kinds": lambda s, d: _kinds(_E(s, d)),
    "lb_parse_bytes": lambda s, d: _P(s, d).select("p_partkey", parse_bytes(F.col("t")).alias("bytes")),
    "wf_retry_backoff": lambda s, d: s.range(26).select(F.col("id").cast("int").alias("retry"), backoff_seconds(F.col("id")).alias("delay_s"), (F.least(F.col("id"), F.lit(20)) + 1).cast("int").alias("next_retry")),
}
_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
def sql_type(lists: Lists) -> str:
    return f"CASE WHEN contains(text, '{lists.broken}') THEN 'corrupted' WHEN contains(text, '{lists.image}') THEN 'image' WHEN strlen(text) > 1000 THEN 'document' ELSE 'text' END"


def sql_answer(answers, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(text), '{w}')" for w in ws)} THEN '{a}'" for a, ws in answers) + f" ELSE '{other}' END"


_TYPE, _LANG, _SENTIMENT = sql_type(FIXED), sql_answer(LANGUAGES, "unknown"), sql_answer(SENTIMENTS, "neutral")
_ALL = f"""WITH a AS (SELECT doc_id, text, {sql_type(CORPUS)} AS type, {sql_answer(CORPUS.languages, "unknown")} AS language, {sql_answer(CORPUS.sentiments, "neutral")} AS sentiment, {_WORDS} AS words FROM documents)
SELECT doc_id, type, language, sentiment, CAST(least(10, 5 + 3 * contains(lower(text), '@')::INT + 2 * (words > 1000)::INT + (type = 'image')::INT) AS INT) AS priority,
  round(least(0.7 + 0.1 * ((words > 100)::INT + (language <> 'unknown')::INT + (doc_id % 10 > 5)::INT), 1.0)::DOUBLE, 3) AS score,
  md5(replace(replace(CASE language WHEN 'english' THEN '[ENHANCED] ' WHEN 'unknown' THEN '' ELSE '[TRANSLATED] ' END || CASE type WHEN 'document' THEN '[PROCESSED_DOC] ' WHEN 'image' THEN '[PROCESSED_IMG] ' ELSE '[PROCESSED] ' END || text, '***', 'REPAIRED'), 'License', 'EXTRACTED_TEXT')) AS digest FROM a"""
_CODE = """CASE category
WHEN 'validation' THEN CASE WHEN lower(message) LIKE '%required%' THEN 'VALIDATION_REQUIRED' WHEN lower(message) LIKE '%invalid%' THEN 'VALIDATION_INVALID' ELSE 'VALIDATION_ERROR' END
WHEN 'network' THEN CASE WHEN lower(message) LIKE '%timeout%' THEN 'NETWORK_TIMEOUT' WHEN lower(message) LIKE '%connection%' THEN 'NETWORK_CONNECTION' ELSE 'NETWORK_ERROR' END
WHEN 'storage' THEN CASE WHEN lower(message) LIKE '%not found%' THEN 'STORAGE_NOT_FOUND' WHEN lower(message) LIKE '%conflict%' THEN 'STORAGE_CONFLICT' ELSE 'STORAGE_ERROR' END
WHEN 'raft' THEN CASE WHEN lower(message) LIKE '%leader%' THEN 'RAFT_LEADER' WHEN lower(message) LIKE '%election%' THEN 'RAFT_ELECTION' ELSE 'RAFT_ERROR' END
WHEN 'workflow' THEN CASE WHEN lower(message) LIKE '%timeout%' THEN 'WORKFLOW_TIMEOUT' WHEN lower(message) LIKE '%state%' THEN 'WORKFLOW_STATE' ELSE 'WORKFLOW_ERROR' END
WHEN 'resource' THEN CASE WHEN lower(message) LIKE '%limit%' THEN 'RESOURCE_LIMIT' WHEN lower(message) LIKE '%full%' THEN 'RESOURCE_EXHAUSTED' ELSE 'RESOURCE_ERROR' END
ELSE 'UNKNOWN_ERROR' END"""

ORACLES = {
    "fn_all_words": _ALL,
    "er_kinds": f"""WITH {_SQL_E}, k AS (SELECT event_id, category, CASE WHEN event_id % 3 = 0 THEN 'CAUSE_' || event_id % 4 ELSE {_CODE} END AS code,
  CASE WHEN event_id % 11 = 0 THEN 'log not found' WHEN event_id % 13 = 0 THEN 'no such key' ELSE message END AS text FROM e)
SELECT event_id, code, CASE WHEN event_id % 5 > 0 THEN category = 'storage' AND contains(code, 'NOT_FOUND') ELSE contains(text, 'not found') OR contains(text, 'no such key') END AS not_found,
  event_id % 6 < 2 AS lease_lost FROM k""",
    "fn_type": f"SELECT doc_id, {_TYPE} AS type FROM documents WHERE text IS NOT NULL",
    "fn_language": f"SELECT doc_id, {_LANG} AS language FROM documents WHERE text IS NOT NULL",
    "fn_priority": f"SELECT doc_id, CAST(least(10, 5 + CASE WHEN contains(lower(text), 'urgent') THEN 3 ELSE 0 END + CASE WHEN {_WORDS} > 1000 THEN 2 ELSE 0 END + CASE WHEN {_TYPE} = 'image' THEN 1 ELSE 0 END) AS INT) AS priority FROM documents WHERE text IS NOT NULL",
    "fn_sentiment": "SELECT doc_id, CASE WHEN lower(text) LIKE '%good%' OR lower(text) LIKE '%excellent%' THEN 'positive' WHEN lower(text) LIKE '%bad%' OR lower(text) LIKE '%terrible%' THEN 'negative' ELSE 'neutral' END AS sentiment FROM documents WHERE text IS NOT NULL",
    "fn_keywords": "SELECT doc_id, coalesce(array_to_string(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: strlen(w) > 5 AND NOT contains(w, 'the'))[1:5], '|'), '') AS keywords FROM documents WHERE text IS NOT NULL",
    "fn_quality": f"SELECT doc_id, round(least(0.7 + CASE WHEN {_WORDS} > 100 THEN 0.1 ELSE 0 END + CASE WHEN {_LANG} <> 'unknown' THEN 0.1 ELSE 0 END, 1.0)::DOUBLE, 3) AS score FROM documents WHERE text IS NOT NULL",
    "fn_repair": "SELECT doc_id, md5(replace(replace(text, 'th', 'ERROR'), 'ERROR', 'REPAIRED')) AS digest FROM documents WHERE text IS NOT NULL",
    "fn_process": f"SELECT doc_id, md5('[ENHANCED_QUALITY] ' || replace('[ENHANCED] ' || CASE {_TYPE} WHEN 'document' THEN '[PROCESSED_DOC] ' WHEN 'image' THEN '[PROCESSED_IMG] ' ELSE '[PROCESSED] ' END || text, 'IMAGE_DATA', 'EXTRACTED_TEXT')) AS digest FROM documents WHERE text IS NOT NULL",
    "fn_word_count": f"SELECT doc_id, CAST({_WORDS} AS INT) AS words FROM documents WHERE text IS NOT NULL",
    "er_classify": f"""WITH {_SQL_E} SELECT event_id, CASE category
WHEN 'validation' THEN CASE WHEN lower(message) LIKE '%required%' THEN 'VALIDATION_REQUIRED' WHEN lower(message) LIKE '%invalid%' THEN 'VALIDATION_INVALID' ELSE 'VALIDATION_ERROR' END
WHEN 'network' THEN CASE WHEN lower(message) LIKE '%timeout%' THEN 'NETWORK_TIMEOUT' WHEN lower(message) LIKE '%connection%' THEN 'NETWORK_CONNECTION' ELSE 'NETWORK_ERROR' END
WHEN 'storage' THEN CASE WHEN lower(message) LIKE '%not found%' THEN 'STORAGE_NOT_FOUND' WHEN lower(message) LIKE '%conflict%' THEN 'STORAGE_CONFLICT' ELSE 'STORAGE_ERROR' END
WHEN 'raft' THEN CASE WHEN lower(message) LIKE '%leader%' THEN 'RAFT_LEADER' WHEN lower(message) LIKE '%election%' THEN 'RAFT_ELECTION' ELSE 'RAFT_ERROR' END
WHEN 'workflow' THEN CASE WHEN lower(message) LIKE '%timeout%' THEN 'WORKFLOW_TIMEOUT' WHEN lower(message) LIKE '%state%' THEN 'WORKFLOW_STATE' ELSE 'WORKFLOW_ERROR' END
WHEN 'resource' THEN CASE WHEN lower(message) LIKE '%limit%' THEN 'RESOURCE_LIMIT' WHEN lower(message) LIKE '%full%' THEN 'RESOURCE_EXHAUSTED' ELSE 'RESOURCE_ERROR' END
ELSE 'UNKNOWN_ERROR' END AS code,
category IN ('network', 'raft', 'resource') AS retryable, regexp_matches(lower(message), 'timeout|connection|temporary|retry') AS by_text, category = 'validation' AS user_facing FROM e""",
    "lb_parse_bytes": "SELECT p_partkey, CAST(CAST(p_size AS BIGINT) * [1000, 1000000, 1073741824, 1, 1, NULL, 1024][p_partkey % 7 + 1] AS BIGINT) AS bytes FROM part",
    "wf_retry_backoff": "SELECT CAST(r AS INT) AS retry, least(pow(2.0, least(r, 20)), 300.0)::DOUBLE AS delay_s, CAST(least(r, 20) + 1 AS INT) AS next_retry FROM range(26) t(r)",
}
