"""Quality rules: a decision list learned by sequential covering from labelled statistics.

Statistics of whole texts are counted in one pass. From a bounded sample of labelled documents a conjunction
of thresholds is grown by information gain on two thirds of the rows and pruned on the other third; rows that
it covers leave, and the next rule is grown, until none is precise enough. The list becomes one ordered Spark
conditional expression, which prints as it reads.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._labels import sample
from ._shared import free_name, quoted, table
from ._words import Words, groups, run_hashes, runs

MOST_LABELLED = 20_000  # rows that rules are learned from, at most
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letters", "n_upper", "n_digits", "n_stops", "n_bangs")
#: What a rule may ask, as quotients of counts (the divisor is 1 at least).
RATIOS = {
    "symbols_per_word": ("n_symbols", "n_words"), "bangs_per_word": ("n_bangs", "n_words"), "stops_per_word": ("n_stops", "n_words"),
    "repeated_share": ("n_repeat_words", "n_words"), "distinct_share": ("n_distinct", "n_words"), "chars_per_word": ("word_chars", "n_words"),
    "upper_share": ("n_upper", "n_letters"), "digit_share": ("n_digits", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "words_per_line": ("n_words", "n_lines"),
}
_is = lambda chars: np.isin(np.arange(256), list(chars.encode()))
SYMBOL, STOP, BANG, DIGIT = _is("#*$%&|<>"), _is(".,;:"), _is("!"), _is("0123456789")
UPPER = _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = UPPER | _is("abcdefghijklmnopqrstuvwxyz")


def _distinct(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((keys, text))
    k, t = keys[order], text[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    return np.bincount(t[new], minlength=n)


def count(texts: list[str | None]) -> dict[str, np.ndarray]:
    """COUNTS of each text; a null text counts as empty."""
    w = Words(texts)
    # lines: runs between line feeds, empty ones have no word anyway
    starts, ends = runs(w.data != 10)
    inside = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.inside, out=inside[1:])
    worded = inside[ends] > inside[starts]
    starts, ends = starts[worded], ends[worded]
    line_text = np.searchsorted(w.at, starts, side="right") - 1
    n_lines = np.bincount(line_text, minlength=w.n)
    distinct_lines = _distinct(run_hashes(w.data, starts, ends), line_text, w.n)
    at, h = w.windows(8)
    repeated = np.zeros(len(w.hashes) + 1, np.int64)
    if len(at):
        order = np.lexsort((h, w.text[at]))
        same = (h[order][1:] == h[order][:-1]) & (w.text[at[order]][1:] == w.text[at[order]][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(repeated, at[twice], 1)
        np.add.at(repeated, at[twice] + 8, -1)
    covered = np.cumsum(repeated)[:-1] > 0
    byte = lambda kind: w.per_text(kind[w.data])
    return {
        "n_words": w.counts, "word_chars": w.per_text(w.inside & ((w.data & 0xC0) != 0x80)), "n_symbols": byte(SYMBOL), "n_dup_lines": n_lines - distinct_lines,
        "n_repeat_words": np.bincount(w.text[covered], minlength=w.n), "n_lines": n_lines, "n_distinct": _distinct(w.hashes, w.text, w.n),
        "n_letters": byte(LETTER), "n_upper": byte(UPPER), "n_digits": byte(DIGIT), "n_stops": byte(STOP), "n_bangs": byte(BANG),
    }


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs (doc_id, text, ...) with a struct column of COUNTS under a free name, "counts" if it can be."""
    name = free_name(docs, "counts")
    kept = docs.select(*map(quoted, keep))
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])
    source = docs.select(F.struct(*map(quoted, keep)).alias("row"), F.col("text"))

    def run(parts):
        for part in parts:
            got: dict[str, list] = {c: [] for c in COUNTS}
            for _, texts in groups(part.column(1)):
                for c, v in count(texts).items():
                    got[c].append(v)
            columns = [pa.array(np.concatenate(got[c]) if got[c] else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*part.column(0).flatten(), pa.StructArray.from_arrays(columns, fields=list(kind))], names=[*keep, name])

    return source.mapInArrow(run, schema)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x >= self.threshold if self.above else x <= self.threshold

    def column(self, counts: str) -> Column:
        x = feature(self.feature, lambda c: F.col(f"{counts}.{c}"))
        return x >= F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


def feature(name: str, of):
    """A feature from counts: of(count) may be a Spark column or a numpy array."""
    if name not in RATIOS:
        return of(name)
    above, below = (of(c) for c in RATIOS[name])
    return above / (np.maximum(below, 1) if isinstance(below, np.ndarray) else F.greatest(below, F.lit(1)))


FEATURES = ("n_words", *RATIOS)


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0.0)


def _purity(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """Covered rows in bad ones above the share so far, discounted for small numbers."""
    return np.where(p >= 5, (p + 1) / (p + n + 2) - (p0 + 1) / (p0 + n0 + 2) + p / 1e6, 0.0)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, measure) -> list[Test]:
    rule, live = [], np.ones(len(bad), bool)
    while (bad & live).any() and (~bad & live).any() and len(rule) < 4:
        p0, n0 = float((bad & live).sum()), float((~bad & live).sum())
        best, best_gain = None, 1e-9
        for name in FEATURES:
            v = x[name][live]
            cuts = np.unique(v)
            of = np.sort(v[bad[live]])
            other = np.sort(v[~bad[live]])
            for above in (True, False):
                side = (lambda a: len(a) - np.searchsorted(a, cuts, "left")) if above else (lambda a: np.searchsorted(a, cuts, "right"))
                gains = measure(side(of).astype(float), side(other).astype(float), p0, n0)
                k = int(np.argmax(gains))
                if gains[k] > best_gain:
                    best, best_gain = Test(name, above, float(cuts[k])), float(gains[k])
        if best is None:
            break
        rule.append(best)
        live &= best.holds(x)
    return rule


def _covers(rule: list[Test], x: dict[str, np.ndarray]) -> np.ndarray:
    return np.logical_and.reduce([t.holds(x) for t in rule])


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, least: int = 8, most_rules: int = 12) -> list[list[Test]]:
    """Ordered conjunctions, each of which rejects; x has an array for each of FEATURES, bad marks rows to reject.

    Each round grows one rule by information gain and one by purity, prunes both, and takes the one that covers
    more bad rows. A rule enters if on the rows left it is precise to ``precision`` at least, on all of them and on
    those it was pruned on, and covers ``least`` bad rows. With no rows of a kind there is no rule.
    """
    rules: list[list[Test]] = []
    left = np.arange(len(bad))
    part = lambda rows: ({k: v[rows] for k, v in x.items()}, bad[rows])
    while len(rules) < most_rules and bad[left].sum() >= least and (~bad[left]).any():
        growing = left % 3 != 2
        px, pbad = part(left[~growing])
        value = lambda r: (lambda c: ((c & pbad).sum() - (c & ~pbad).sum()) / max(c.sum(), 1))(_covers(r, px)) if r else -1.0
        best, most = None, 0
        for measure in (_gain, _purity):
            rule = _grow(*part(left[growing]), measure)
            while len(rule) > 1 and value(rule[:-1]) >= value(rule):
                rule = rule[:-1]
            if rule:
                covered, pruned = _covers(rule, part(left)[0]), _covers(rule, px)
                right = int((covered & bad[left]).sum())
                if right >= max(least, most + 1) and right >= precision * covered.sum() and (pruned & pbad).sum() >= precision * pruned.sum():
                    best, most = rule, right
        if best is None:
            break
        rules.append(best)
        left = left[~_covers(best, part(left)[0])]
    return rules


def verdict(rules: list[list[Test]], counts: str) -> Column:
    """The decision list as one conditional expression: true keeps."""
    if not rules:
        return F.lit(True)
    out = None
    for rule in rules:
        condition = rule[0].column(counts)
        for test in rule[1:]:
            condition = condition & test.column(counts)
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return out.otherwise(F.lit(True))


def base_failed(counts: str) -> Column:
    n, repeated = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    return (n < 20) | (100 * repeated > 30 * n)


def fit_rules(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[list[Test]]:
    """Rules from at most ``most`` labelled documents that pass the base rules; only their counts reach the driver."""
    labelled = with_counts(sample(docs, labels, most), ["doc_id", "label"]).where(~base_failed("counts")).select("doc_id", "label", "counts.*").toPandas().sort_values(["doc_id", *COUNTS])
    counts = {c: labelled[c].to_numpy(float) for c in COUNTS}
    return learn({f: feature(f, counts.__getitem__) for f in FEATURES}, labelled["label"].to_numpy() == 0)


def apply_rules(docs: DataFrame, rules: list[list[Test]], keep: list[str]) -> tuple[DataFrame, str]:
    """Columns ``keep`` with a struct of COUNTS, base_failed and kept, and that struct's name.

    Null and empty texts have no word and fail the base rules; a text of any length is counted whole. Rows that repeat
    get the same verdict; of rules that both fit (ties) the first decides, to the same effect. Columns may have any
    name. An empty table gives no rows.
    """
    counted = with_counts(docs, keep)
    name = counted.columns[-1]
    failed = base_failed(name)
    return counted.withColumn(name, F.struct(f"{name}.*", failed.alias("base_failed"), (~failed & verdict(rules, name)).alias("kept"))), name


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out, name = apply_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", *(f"{name}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLES: dict[str, str] = {}
