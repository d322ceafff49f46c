"""URL verdicts: host and path rules first, else a weighted vocabulary found by Aho-Corasick automaton.

The automaton finds every term of the vocabulary in one pass over the url after its scheme, in lower case. A
hit counts if neither neighbour is a letter or digit. One strict hit rejects; so do distinct soft terms, two
at least, whose weights reach the threshold. Each task builds the automaton once; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

STRICT = ("casino", "escort", "hentai", "porn", "viagra", "warez", "xxx")
SOFT = {"adult": 2, "bets": 2, "bonus": 1, "buy": 1, "cheap": 1, "deals": 1, "farm": 1, "free": 1, "loans": 2, "pills": 2, "poker": 2, "replica": 2, "spam": 2, "win": 1}
THRESHOLD = 3
MOST_TERMS = 200_000
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

HOST = r"^(?s:.*?)://([^/?#]*)"
PATH = r"^(?s:.*?)://[^/?#]*([^?#]*)"
ASCII_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url) -> tuple:
    """(host with A-Z lower-cased, path) of a url column; both empty for null or without ://."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, HOST, 1), *ASCII_LOWER), F.regexp_extract(url, PATH, 1)


def vocabulary(terms: DataFrame, most: int = MOST_TERMS) -> tuple[list[str], dict[str, int]]:
    """strict and soft for filter_urls from a table (term, weight); a null weight makes a term strict.

    Terms are lower-cased (A-Z); null and empty ones are left out; of a term that repeats, strict wins, then the largest
    weight. More than ``most`` terms are an error: each task holds the automaton.
    """
    term = F.translate("term", *ASCII_LOWER)
    one = terms.where("term <> ''").groupBy(term.alias("term")).agg(F.count_if(F.col("weight").isNull()).alias("strict"), F.max("weight").alias("weight"))
    rows = one.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return sorted(r["term"] for r in rows if r["strict"]), {r["term"]: int(r["weight"]) for r in sorted(rows) if not r["strict"]}


class Vocabulary:
    """Counts terms in a text; a term that stands inside a longer word is no hit."""

    def __init__(self, strict: Sequence[str], soft: Mapping[str, int]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for term in {*strict, *soft}:
            self.automaton.add_word(term, (term, soft.get(term)) if term not in strict else (term, None))
        self.filled = len(self.automaton) > 0
        if self.filled:
            self.automaton.make_automaton()

    def count(self, text: str) -> tuple[int, int, int]:
        """Strict hits, distinct soft terms, their weight."""
        strict, soft = 0, {}
        for last, (term, weight) in self.automaton.iter(text) if self.filled else ():
            first = last + 1 - len(term)
            if (first and _word(text[first - 1])) or (last + 1 < len(text) and _word(text[last + 1])):
                continue
            if weight is None:
                strict += 1
            else:
                soft[term] = weight
        return strict, len(soft), sum(soft.values())


def _word(c: str) -> bool:
    """A letter or digit of any script."""
    return c.isalnum()


class Rules:
    """Host and path rules, the longest that fits first: of equal length the one with the longer host."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, verdict, rule))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while at >= 0:
            suffix = host[at:]
            for start, verdict, rule in self.by_host.get(suffix, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[1])):
                    best = (verdict, rule)
            at = host.find(".", at) + 1 or -1
        return best


def filter_urls(pages: DataFrame, key: str = "page_id", url: str = "url", strict=STRICT, soft=SOFT, threshold: int = THRESHOLD, rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict, strict_hits, soft_hits, soft_weight of every row.

    A null url or one without :// has an empty host and path, fits no rule and, without terms, is allowed. A url of any
    length is read whole. Of rules that fit and are equally long (ties) the one with the longer host decides. Rows that
    repeat are judged each; other columns are dropped, whatever their names; an empty table gives no rows. strict and
    soft may come from a table of any size that a task can hold: see vocabulary.
    """
    host, path = url_parts(F.col(url))
    low = F.translate(F.coalesce(F.col(url), F.lit("")), *ASCII_LOWER)
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), F.regexp_replace(low, r"^(?s:.*?)://", "").alias("text"))

    def judge(parts):
        vocabulary, known = Vocabulary(strict, soft), Rules(rules)
        for part in parts:
            counted = [vocabulary.count(x) for x in part.column(3).to_pylist()]
            found = [known.find(h, p) for h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            verdicts = [f[0] if f else "block" if s or (n >= 2 and w >= threshold) else "allow" for f, (s, n, w) in zip(found, counted)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array([f and f[1] for f in found], pa.string()), pa.array(verdicts, pa.string()), *(pa.array(x, pa.int32()) for x in (zip(*counted) if counted else ([], [], [])))],
                names=["key", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight"],
            )

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(judge, f"key {kind}, host string, path string, rule string, verdict string, strict_hits int, soft_hits int, soft_weight int").withColumnRenamed("key", key)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    no = r"[^\p{L}\p{N}]"
    hit = lambda t: f"regexp_matches(u, '(^|{no}){t}($|{no})')"
    strict = " + ".join(f"len(regexp_extract_all(' ' || regexp_replace(u, '({no})', '\\1\\1', 'g') || ' ', '{no}{t}{no}'))" for t in STRICT)
    soft = " + ".join(f"{hit(t)}::INT" for t in SOFT)
    weight = " + ".join(f"{w} * {hit(t)}::INT" for t, w in SOFT.items())
    fits = "\n".join(
        f"UNION ALL SELECT page_id, '{r}' AS rule, '{v}' AS verdict FROM p WHERE (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')" for v, r in RULES
    )
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT page_id, {lower.format("regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)")} AS host,
  regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
  regexp_replace({lower.format("coalesce(url, '')")}, '^(?s:.*?)://', '') AS u FROM pages),
f AS (SELECT CAST(NULL AS BIGINT) AS page_id, '' AS rule, '' AS verdict WHERE false {fits}),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM f GROUP BY page_id),
c AS (SELECT *, CAST({strict} AS INT) AS strict_hits, CAST({soft} AS INT) AS soft_hits, CAST({weight} AS INT) AS soft_weight FROM p)
SELECT c.page_id, host, path, rule,
  coalesce(best.verdict, CASE WHEN strict_hits > 0 OR (soft_hits >= 2 AND soft_weight >= {THRESHOLD}) THEN 'block' ELSE 'allow' END) AS verdict,
  strict_hits, soft_hits, soft_weight
FROM c LEFT JOIN best USING (page_id)"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES = {"op1_url_filter": _oracle()}
