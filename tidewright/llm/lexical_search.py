"""Ranked lexical search over inverted treaps.

The index is cut into shards of documents, each of a bounded size, built where the documents are read: nothing but
counts is shuffled. In a shard every term has a treap over its postings: doc order for search, impact (the part of a
score that does not depend on the query) for the heap, so the root of any stretch of documents is its largest impact.

A search walks the treaps of all its terms at once. It holds stretches of documents, each with the roots of the terms
that occur there; the weighted roots' sum bounds any score in the stretch, and a stretch that cannot enter the best k is
dropped with all that is below. Otherwise the document of the largest weighted root is scored in full and splits every
treap in two. All queries of a block take each step together, as arrays. A task keeps the best k of each query from
shard to shard, so its bounds tighten, and gives k rows a query at its end.

Impacts are integers of the collection as it was built: (10^9 * tf) div (1000 * tf + 8 * m), m = 25 + (75 * n * N) div L.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._bytes import Terms, slices, utf8
from ._shared import partitions, shared_dir, staged, table

K, SHARD_BYTES, SHARD_DOCS, BLOCK_ROWS, STEP_ENTRIES = 10, 8 << 20, 65_535, 200_000, 200_000
NONE = 0xFFFF  # no child; a shard has fewer documents, so no posting has this place
POSTINGS = "shard long, slot long, term string, df int, root int, docs binary, impacts binary, left binary, right binary"


@dataclass(frozen=True)
class Index:
    """Where an index lies, its number of documents with terms (N) and of terms with repeats (L)."""

    path: str
    n: int
    length: int

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(POSTINGS).parquet(posixpath.join(self.path, "postings"))


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats) of all texts."""

    def run(parts):
        n = length = 0
        for part in parts:
            for _, some in slices(part.column(0)):
                counts = Terms(some).counts
                n, length = n + int((counts > 0).sum()), length + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([length])], names=["n", "length"])

    r = docs.select("text").mapInArrow(run, "n long, length long").agg(F.sum("n"), F.sum("length")).first()
    return r[0] or 0, r[1] or 0


def treaps(first: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root of each run, left child, right child) as indices of impact, -1 for none; runs begin at first and are not empty.

    Level by level, the largest impact of each stretch becomes its root, of equal ones the nearest to the middle.
    """
    n = len(impact)
    left, right, root = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.empty(len(first), np.int64)
    a, b = first, np.append(first[1:], n)
    parent, side, level = np.arange(len(first)), None, 0
    while len(a):
        size = b - a
        start = np.cumsum(size) - size
        of = np.repeat(np.arange(len(a)), size)
        at = np.arange(len(of)) - start[of] + a[of]
        key = (impact[at] << 18) - np.abs(2 * at - (a + b)[of])
        top = np.flatnonzero(key == np.maximum.reduceat(key, start)[of])
        top = at[top[np.diff(of[top], prepend=-1) > 0]]
        if side is None:
            root[parent] = top
        else:
            left[parent[~side]], right[parent[side]] = top[~side], top[side]
        a, b = np.concatenate([a, top + 1]), np.concatenate([top, b])
        side, parent = np.repeat([False, True], len(top)), np.concatenate([top, top])
        some = a < b
        a, b, side, parent, level = a[some], b[some], side[some], parent[some], level + 1
    return root, left, right


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows are so many of the values each, one after the other."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts * values.itemsize, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def shard_rows(ids: pa.Array, texts: pa.Array, shard: int, slot: int, n_docs: int, length: int):
    """The rows of one shard: first that of its documents (no term; df: how many have an id), then one a term."""
    order = pa.compute.sort_indices(ids, null_placement="at_end")
    ids, texts = ids.take(order), texts.take(order)
    named = len(ids) - ids.null_count
    one = lambda x: pa.array([x], pa.binary())
    names = ["shard", "slot", "term", "df", "root", "docs", "impacts", "left", "right"]
    none = pa.nulls(1, pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([slot]), pa.nulls(1, pa.string()), pa.array([named], pa.int32()), pa.array([len(ids)], pa.int32()), one(ids.slice(0, named).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()), none, none, none], names=names)
    w = Terms(texts)
    if not len(w.starts):
        return
    number, distinct = w.numbered()
    key, tf = np.unique(number.astype(np.int64) << 16 | w.text(), return_counts=True)
    term, doc = key >> 16, key & 0xFFFF
    m = 25 + 75 * w.counts * n_docs // length
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    first = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(first, append=len(term))
    root, left, right = treaps(first, impact)
    base = np.repeat(first, df)
    child = lambda x: np.where(x < 0, NONE, x - base).astype(np.uint16)
    many = np.repeat(df > 1, df)
    children = np.where(df > 1, df, 0)
    columns = [
        pa.array(np.full(len(df), shard)), pa.array(np.full(len(df), slot)), distinct.cast(pa.binary()).cast(pa.string()), pa.array(df.astype(np.int32)), pa.array((root - first).astype(np.int32)),
        _binary(doc.astype(np.uint16), df), _binary(impact.astype(np.int32), df), _binary(child(left)[many], children), _binary(child(right)[many], children),
    ]
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for at in range(0, whole.num_rows, 50_000):
        yield whole.slice(at, 50_000)


def build(docs: DataFrame, path: str | None = None) -> Index:
    """Writes the index of all rows of docs (doc_id, text) below path, by default in the shared folder.

    Documents are those rows; null and empty texts, and texts without a term, are in no posting and not counted. Texts
    of any length are read whole. Rows that repeat are documents each; a null doc_id is kept. Other columns are not
    read, whatever their names. An empty table gives an index that finds nothing.
    """
    path = path or posixpath.join(shared_dir(docs.sparkSession), "treaps")
    n, length = totals(docs)

    def run(parts):
        part_id, count = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def flush():
            nonlocal ids, texts, size, count
            if ids:
                # a slot is what a search task takes: shards of one task go to different ones
                yield from shard_rows(pa.concat_arrays(ids), pa.concat_arrays(texts), part_id << 20 | count, part_id + count * 7919, n, max(length, 1))
                ids, texts, size, count = [], [], 0, count + 1

        for part in parts:
            for first, some in slices(part.column(1)):
                for at in range(0, len(some), 1000):
                    few = some.slice(at, 1000)
                    ids.append(part.column(0).slice(first + at, len(few)))
                    texts.append(few)
                    size += len(utf8(few)[0])
                    if size >= SHARD_BYTES or sum(map(len, ids)) + 1000 > SHARD_DOCS:
                        yield from flush()
        yield from flush()

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS).write.parquet(posixpath.join(path, "postings"))
    return Index(path, n, length)


def query_terms(queries: DataFrame) -> DataFrame:
    """item_id, query (a number from its text), term and times of every distinct row of queries (item_id, text)."""

    def run(parts):
        for part in parts:
            for first, some in slices(part.column(2)):
                w = Terms(some)
                number, distinct = w.numbered()
                key, times = np.unique(w.text().astype(np.int64) << 32 | number, return_counts=True)
                row = pa.array(first + (key >> 32))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), distinct.cast(pa.binary()).cast(pa.string()).take(pa.array(key & 0xFFFFFFFF)), pa.array(times)], names=["item_id", "query", "term", "times"])

    rows = queries.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("query"), "text").distinct()
    return rows.mapInArrow(run, "item_id long, query long, term string, times long")


class Block:
    """A bounded number of (query, term, weight) rows as arrays, by term."""

    def __init__(self, rows: list[tuple[int | None, int, str, int]]):
        rows = sorted(rows, key=lambda r: r[2])
        self.queries = sorted({r[:2] for r in rows}, key=lambda q: (q[0] is None, q))
        number = {q: i for i, q in enumerate(self.queries)}
        self.query, self.weight = np.array([number[r[:2]] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        self.terms: dict[str, tuple[int, int]] = {}
        for i, r in enumerate(rows):
            self.terms[r[2]] = (self.terms.get(r[2], (i,))[0], i + 1)


class Shard:
    """The postings of one shard for some terms, one after the other."""

    def __init__(self, ids: bytes, named: int, docs: int, rows: list[tuple]):
        """rows: term, df, root, docs, impacts, left, right."""
        self.ids = np.zeros(docs, np.int64)
        self.ids[:named] = np.frombuffer(ids, np.int64)
        self.nameless = np.arange(docs) >= named
        size = np.array([r[1] for r in rows], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.root = self.start + np.array([r[2] for r in rows], np.int64)
        self.docs = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).astype(np.int64)
        self.impact = np.frombuffer(b"".join(r[4] for r in rows), np.int32).astype(np.int64)
        many, base = np.repeat(size > 1, size), np.repeat(self.start, size)
        self.left, self.right = (self._children(b"".join(r[k] or b"" for r in rows), many, base) for k in (5, 6))
        self.keys = np.repeat(np.arange(len(rows)) << 16, size) | self.docs

    @staticmethod
    def _children(held: bytes, many: np.ndarray, base: np.ndarray) -> np.ndarray:
        out = np.full(len(many), -1, np.int64)
        child = np.frombuffer(held, np.uint16).astype(np.int64)
        out[many] = np.where(child == NONE, -1, child + base[many])
        return out

    def within(self, node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The root of [a, b) below each node (which must be on the way to it); stretches are not empty."""
        while True:
            above, below = node >= b, node < a
            if not (above | below).any():
                return node
            node = np.where(above, self.left[node], np.where(below, self.right[node], node))


class Best:
    """The k best documents of each query so far: by score, then named, then the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.zeros((queries, k), np.int64)
        self.id = np.zeros((queries, k), np.int64)
        self.nameless = np.zeros((queries, k), bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        good = score > 0
        good[good] &= score[good] >= self.score[query[good], -1]
        if not good.any():
            return
        query, score, ids, nameless = query[good], score[good], ids[good], nameless[good]
        touched, row = np.unique(query, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(touched)), self.k), row])
        s, i, n = (np.concatenate([held[touched].ravel(), new]) for held, new in ((self.score, score), (self.id, ids), (self.nameless, nameless)))
        order = np.lexsort((i, n, -s, q))
        first = np.flatnonzero(np.diff(q[order], prepend=-1))
        at = order[(first[:, None] + np.arange(self.k)).ravel()]  # each query has k at least
        self.score[touched], self.id[touched], self.nameless[touched] = (x[at].reshape(-1, self.k) for x in (s, i, n))

    def passes(self, query: np.ndarray, bound: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> np.ndarray:
        """Whether a document of at most that score, of that id or a later one, could enter."""
        last = self.score[query, -1]
        worst, without = self.id[query, -1], self.nameless[query, -1]
        earlier = np.where(nameless == without, ids < worst, without & ~nameless)
        return (bound > 0) & ((bound > last) | (bound == last) & earlier)


def search_shard(shard: Shard, query: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Adds the shard's documents that enter to best; query, term, weight: entries by query. Returns how many it scored."""
    first = np.flatnonzero(np.diff(query, prepend=-1))
    pending = [(query[first], np.zeros(len(first), np.int64), np.diff(first, append=len(query)), term, weight, shard.root[term], shard.start[term], shard.end[term])]
    scored = 0
    while pending:
        q, low, size, term, weight, node, a, b = pending.pop()
        if len(term) > STEP_ENTRIES and len(q) > 1:  # bounded steps; what is put last is done first
            half = len(q) // 2
            cut = int(size[:half].sum())
            pending += [tuple(x[i] for x, i in zip((q, low, size, term, weight, node, a, b), (s, s, s, *[e] * 5))) for s, e in ((slice(half, None), slice(cut, None)), (slice(None, half), slice(None, cut)))]
            continue
        part = weight * shard.impact[node]
        start = np.cumsum(size) - size
        ok = best.passes(q, np.add.reduceat(part, start), shard.ids[low], shard.nameless[low])
        if not ok.any():
            continue
        keep = np.repeat(ok, size)
        q, low, size = q[ok], low[ok], size[ok]
        term, weight, node, a, b, part = (x[keep] for x in (term, weight, node, a, b, part))
        start = np.cumsum(size) - size
        of = np.repeat(np.arange(len(q)), size)
        top = np.flatnonzero(part == np.maximum.reduceat(part, start)[of])
        doc = shard.docs[node[top[np.diff(of[top], prepend=-1) > 0]]]
        p = np.searchsorted(shard.keys, term << 16 | doc[of])
        there = p < b
        there[there] = shard.docs[p[there]] == doc[of][there]
        score = np.add.reduceat(np.where(there, weight * shard.impact[np.minimum(p, len(shard.impact) - 1)], 0), start)
        scored += len(q)
        best.add(q, score, shard.ids[doc], shard.nameless[doc])
        halves = []
        for begin, end, at in ((a, p, low), (p + there, b, doc + 1)):
            some = begin < end
            left = np.bincount(of[some], minlength=len(q))
            has, x, y = left > 0, begin[some], end[some]
            halves.append((q[has], at[has], left[has], term[some], weight[some], shard.within(node[some], x, y), x, y))
        if any(len(x[0]) for x in halves):
            pending.append(tuple(map(np.concatenate, zip(*halves))))
    return scored


def _searched(block: Block, k: int):
    """The function that searches the shards of a partition, whose rows come shard by shard, and gives k rows a query."""

    def run(parts):
        best, held, shard, ids = Best(len(block.queries), k), [], None, None

        def flush():
            if ids is not None and held:
                at = [block.terms[r[0]] for r in held]
                n = np.array([j - i for i, j in at])
                entry = np.repeat(np.array([i for i, _ in at]) - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                order = np.argsort(block.query[entry], kind="stable")
                search_shard(Shard(*ids, held), block.query[entry][order], np.repeat(np.arange(len(held)), n)[order], block.weight[entry][order], best)

        for part in parts:
            for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns))):
                if row[0] != shard:
                    flush()
                    shard, held, ids = row[0], [], None
                if row[1] is None:
                    ids = row[4], row[2], row[3]
                else:
                    held.append(row[1:])
        flush()
        q, place = np.nonzero(best.score > 0)
        item = [block.queries[i] for i in q.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in item], pa.int64()), pa.array([x[1] for x in item], pa.int64()), pa.array(best.id[q, place], mask=best.nameless[q, place]), pa.array(best.score[q, place])], names=["item_id", "query", "doc_id", "score"])

    return run


def search(index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of queries (item_id, text) with a score above 0.

    A term's weight is floor(1000 * ln((2N + 2) / (2df + 1))), and counts as often as the query has the term. Equal
    scores rank by ascending doc_id, null ids last. Queries that are null, empty or without a term that the index has
    get no row; rows of queries that repeat in item and text are one, those that share an item_id alone are searched
    each. Other columns of queries are not read. Queries go in blocks of about BLOCK_ROWS (query, term) rows, which is
    what a task holds of them, however many there are.
    """
    spark = queries.sparkSession
    wanted = staged(query_terms(queries), "query-terms")
    postings = index.postings(spark)
    terms = wanted.select("term").distinct()
    df = postings.select("term", "df").join(terms, "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.ln((2.0 * index.n + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("times")
    weighed = staged(wanted.join(df, "term").select("item_id", "query", "term", weight.alias("weight")).where("weight > 0"), "weights")
    blocks = -(-weighed.count() // BLOCK_ROWS)
    found, slots = None, partitions(spark)
    for i in range(blocks):
        mine = weighed.where(F.pmod(F.xxhash64("item_id", "query"), F.lit(blocks)) == i)
        block = Block([tuple(r) for r in mine.collect()])
        has = F.broadcast(mine.select("term").distinct().withColumn("has", F.lit(True)))  # as many as BLOCK_ROWS at the most
        rows = postings.join(has, "term", "left").where("has or term is null")
        rows = rows.repartitionById(slots, F.pmod("slot", F.lit(slots)).cast("int")).sortWithinPartitions("shard").select("shard", "term", "df", "root", "docs", "impacts", "left", "right")
        part = rows.mapInArrow(_searched(block, k), "item_id long, query long, doc_id long, score long")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = Window.partitionBy("item_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_lexical_search": op11_lexical_search}
_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term"""
ORACLES = {
    "op11_lexical_search": f"""WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL), n AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY ALL),
a AS (SELECT count(*) AS docs, sum(n) AS terms FROM n), w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, a GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * (1000000000 * tf // (1000 * tf + 8 * (25 + 75 * n * docs // terms)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (doc_id), a GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
}
