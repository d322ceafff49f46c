"""Near-duplicate documents: a multi-index Hamming join of MinHash signatures, confirmed on full shingle sets.

A signature is SYMBOLS 16-bit minima of independently mixed shingle hashes. Pairs within DISTANCE differing
symbols are found by pigeonhole: a signature is split into CHUNKS, so one chunk has at most DISTANCE // CHUNKS
errors, and leaving out each set of so many symbols of a chunk enumerates what both sides then share as a key.

Documents with equal shingle sets are one class first. Classes that share a key are linked to the smallest of
the key and confirmed on their full sets; components of confirmed links settle nearly every key. Keys whose
classes are still of several components are cut into blocks, and in each block the pairs of a forest, at most one a
class, are confirmed: they join groups of which no member is like all others. Keys that are mixed even then are
compared class by class, all pairs of blocks: those of different components within DISTANCE are confirmed too. Pairs
are left out in both if their sizes or the number of 16-bit shingle prefixes that they share, which is never below
that of shared shingles, rule the similarity out. So no pair within DISTANCE is left out, and a key that thousands
of like documents share costs one pair each.

A pair at Jaccard similarity J differs in about (1 - J) * SYMBOLS symbols. Distance and chunks follow from the
least similarity, so that a pair at it is missed with a chance below 1 in 10,000: 22 and 13 at 0.85 (3.0e-5), 27 and
14 at 0.80 (1.4e-5).
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components, merged
from ._shared import partitions, staged, table
from ._skew import spread_join
from ._words import Words, groups, mix

SYMBOLS, DISTANCE, CHUNKS, BLOCK = 64, 22, 13, 256
MARKS = 1 << 22  # bits that texts are told apart by before they are shuffled
MOST_BRIEF = 1 << 15  # sets beyond it have no prefixes and are always confirmed in full
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, (2, SYMBOLS), dtype=np.uint64) | np.uint64(1)


def shingles(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, by text and hash; of a shorter text, its whole sequence."""
    w = Words(texts, lower=True)
    at, h = w.windows(width)
    of = w.text[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < width))
    if len(short):
        whole = [mix(np.array([_fold(w.hashes[w.first[i] : w.first[i + 1]])], np.uint64))[0] for i in short.tolist()]
        of, h = np.concatenate([of, short]), np.concatenate([h, np.array(whole, np.uint64)])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    return of[new], h[new]


def _fold(hashes: np.ndarray) -> int:
    out = 0x5BD1E995
    for h in hashes.tolist():
        out = (out * 0xD6E8FEB86659FD93 + h) & 0xFFFFFFFFFFFFFFFF
    return out


def signatures(of: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n rows of SYMBOLS 16-bit symbols; rows of empty sets are zeros."""
    out = np.zeros((n, SYMBOLS), np.uint16)
    full, first = np.unique(of, return_index=True)
    if len(full):
        for k in range(SYMBOLS):
            x = h * _SEEDS[0, k]
            x ^= x >> np.uint64(32)
            x *= _SEEDS[1, k]
            least = np.minimum.reduceat(x, first)
            out[full, k] = ((least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.uint16)
    return out


def with_brief(texts: DataFrame, width: int) -> DataFrame:
    """class, text, n (shingles) and brief (the first 16 bits of each shingle's hash) of texts (class, text)."""

    def run(parts):
        for part in parts:
            n, out = [], []
            for _, some in groups(part.column(1), 200_000):
                of, h = shingles(some, width)
                counts = np.bincount(of, minlength=len(some))
                brief, edges = (h >> np.uint64(48)).astype(np.uint16), np.cumsum(counts)
                n += counts.tolist()
                out += [brief[j - k : j].tobytes() if k <= MOST_BRIEF else b"" for k, j in zip(counts.tolist(), edges.tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(out, pa.binary())], names=["class", "text", "n", "brief"])

    return texts.mapInArrow(run, "class long, text string, n long, brief binary")


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_a, set_b (128 bits that tell sets apart) and signature of every row."""

    def run(parts):
        for part in parts:
            counts, a, b, signature = [], [], [], []
            for _, texts in groups(part.column(2), 200_000):
                of, h = shingles(texts, width)
                n, edges = len(texts), np.searchsorted(of, np.arange(len(texts) + 1))
                counts.append(np.diff(edges))
                for out, x in ((a, h), (b, mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)))):
                    total = np.zeros(len(x) + 1, np.uint64)
                    np.cumsum(x, out=total[1:])
                    out.append((total[edges[1:]] - total[edges[:-1]]).view(np.int64))
                signature += [s.tobytes() for s in signatures(of, h, n)]
            join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), join(counts), join(a), join(b), pa.array(signature, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, signature binary")


def patterns(symbols: int, distance: int, chunks: int) -> list[np.ndarray]:
    """The symbols that each key is made of: for each chunk and each choice of distance // chunks of its symbols, the rest."""
    out = []
    for part in np.array_split(np.arange(symbols), chunks):
        out += [np.delete(part, leave) for leave in combinations(range(len(part)), min(distance // chunks, len(part) - 1))]
    return out


def keys_of(signature: np.ndarray, distance: int = DISTANCE, chunks: int = CHUNKS) -> np.ndarray:
    """The keys of each row, a 64-bit hash for each pattern."""
    out = []
    for k, kept in enumerate(patterns(signature.shape[1], distance, chunks)):
        key = np.full(len(signature), k + 1, np.uint64)
        for at in kept:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, at])
        out.append(key)
    return np.stack(out, 1).view(np.int64)


def with_keys(classes: DataFrame, extra: list[str], distance: int, chunks: int) -> DataFrame:
    """key, pattern (its number), class and the extra columns: a row for each key of each row of classes (class, signature, extra...)."""
    kinds = classes.select("class", *extra).schema
    names = ["key", "pattern", *kinds.names]

    def run(parts):
        for part in parts:
            for at in range(0, part.num_rows, 2000):
                some = part.slice(at, 2000)
                keys = keys_of(np.frombuffer(b"".join(some.column(0).to_pylist()), np.uint16).reshape(-1, SYMBOLS), distance, chunks)
                rows = pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))
                number = pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int32), len(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), number, *(some.column(i).take(rows) for i in range(1, some.num_columns))], names=names)

    return classes.select("signature", "class", *extra).mapInArrow(run, f"key long, pattern int, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kinds)}")


def marked(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of texts (text_hash, ...) whose hash may be one of ends: all that are, and few others while ends are fewer than MARKS.

    Ends mark bits, 64 in a row, so what is broadcast has MARKS / 64 rows at the most, and texts that nobody asks for are
    left out where they are read, before the join that shuffles them.
    """
    bit = F.pmod(F.col("text_hash"), F.lit(MARKS))
    word, mask = F.shiftright(bit, 6), F.expr(f"shiftleft(1L, cast(pmod(text_hash, {MARKS}) & 63 as int))")
    words = ends.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits"))
    return texts.join(F.broadcast(words), word == F.col("_word")).where(F.col("_bits").bitwiseAND(mask) != 0).drop("_word", "_bits")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose texts' full sets have 100 * intersection >= percent * union; texts: class, text."""
    # the text of a, which may be in many pairs, joins last, beside texts of b that are there already
    # (rows with texts are large, so Spark splits that join where one a has many)
    with_b = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")

    def run(parts):
        last, known = None, None
        for part in parts:
            good, rows = [], ((part.column(k)[i].as_py() for k in (0, 2, 3)) for i in range(part.num_rows))
            for a, text_a, text_b in rows:
                if a != last:
                    last, known = a, shingles([text_a], width)[1]
                other = shingles([text_b], width)[1]
                same = len(np.intersect1d(known, other, assume_unique=True))
                good.append(100 * same >= percent * (len(known) + len(other) - same))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def beyond(percent: int, distance: int) -> float:
    """The chance that signatures of a pair at percent differ in more than distance symbols."""
    p = (1 - percent / 100) * (1 - 2**-16)
    return sum(comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k) for k in range(distance + 1, SYMBOLS + 1))


def limits(percent: int, chance: float = 1e-4) -> tuple[int, int]:
    """(distance, chunks) at which a pair at percent is missed with less than chance.

    With at most one error in some chunk, chunks guarantee 2 * chunks - 1 differing symbols, and the number of keys
    is the same for any number of chunks.
    """
    if beyond(percent, DISTANCE) < chance:
        return DISTANCE, CHUNKS
    chunks = next((c for c in range(CHUNKS, SYMBOLS // 2 + 1) if beyond(percent, 2 * c - 1) < chance), None)
    if chunks is None:
        raise ValueError(f"signatures of {SYMBOLS} symbols cannot find pairs at {percent} %")
    return 2 * chunks - 1, chunks


def unsettled(classes: DataFrame, labels: DataFrame, percent: int, distance: int, chunks: int, forest: bool = False) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a key and may reach percent, each pair once.

    classes: class, signature, n, brief; labels: class, component. A pair passes if its signatures are within
    distance and neither its sizes nor its briefs rule percent out, so no pair at percent is lost here. It is emitted
    at the first pattern that both share. Members of a key are cut into blocks, and each pair of blocks is a group of
    at most about 2 * BLOCK members, so a long key is shared among tasks and no task holds it whole.

    With forest, blocks are compared within themselves alone, and of the pairs that pass only those that join two trees
    of earlier ones come out, the likest of two trees: fewer than the block has members. Other pairs are left for a call
    without, after the labels have taken the confirmed ones up.
    """
    labelled = classes.join(labels.hint("merge"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    keyed = with_keys(labelled, ["component"], distance, chunks)
    mixed = keyed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).where("low <> high")
    mixed = mixed.select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    members = keyed.join(mixed, "key").join(classes.hint("merge"), "class")
    if forest:  # other blocks at each key, so that groups cut by one are joined by the next
        members = members.withColumn("mine", F.pmod(F.xxhash64("class", "key"), "blocks").cast("int"))
        dealt = members.withColumn("other", F.col("mine"))
    else:
        members = members.withColumn("mine", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
        dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "pattern", "mine", "class", "component", "n", "signature", "brief")
    kept = patterns(SYMBOLS, distance, chunks)
    masks = np.zeros((SYMBOLS, len(kept)), np.float32)
    for k, at in enumerate(kept):
        masks[at, k] = 1
    sizes = masks.sum(0)

    def compare(one_block, rows):
        pattern = rows[0][0]
        ids, component, mine, n = (np.array([r[k] for r in rows]) for k in (2, 3, 1, 4))
        symbols = np.frombuffer(b"".join(r[5] for r in rows), np.uint16).reshape(len(rows), -1)
        briefs = [np.frombuffer(r[6], np.uint16) for r in rows]
        has = np.zeros(1 << 16, bool)
        for x in range(len(rows) - 1):  # from the cheapest test to the dearest
            ok = (component[x + 1 :] != component[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= percent * np.maximum(n[x + 1 :], n[x]))
            ok &= one_block | (mine[x + 1 :] != mine[x])
            at = np.flatnonzero(ok) + x + 1
            same = symbols[at] == symbols[x]
            near = same.sum(1) >= SYMBOLS - distance
            at, same = at[near], same[near]
            if len(at):  # once a pair, at the first pattern that both share
                at = at[(same.astype(np.float32) @ masks == sizes).argmax(1) == pattern]
            if len(at) and len(briefs[x]):
                some = [briefs[y] for y in at.tolist()]
                lengths = np.array([len(b) for b in some])
                has[briefs[x]] = True
                hits = np.concatenate([[0], np.cumsum(has[np.concatenate(some)])])
                has[briefs[x]] = False
                ends = np.cumsum(lengths)
                shared = np.where(lengths > 0, np.minimum(hits[ends] - hits[ends - lengths], n[x]), n[x])
                passed = 100 * shared >= percent * (n[x] + n[at] - shared)
                at, likeness = at[passed], (shared / (n[x] + n[at] - shared))[passed]
            else:
                likeness = np.zeros(len(at))
            if forest and len(at):
                at = at[np.argsort(-likeness, kind="stable")]
                at = at[np.unique(component[at], return_index=True)[1]]
                component[np.isin(component, component[at])] = component[x]
            for y in ids[at].tolist():
                yield min(int(ids[x]), y), max(int(ids[x]), y)

    def run(parts):
        def flush():
            if len(held) > 1:
                out.extend(compare(group[1] == group[2], held))

        group, held, out = None, [], []
        for part in parts:
            for key, i, j, *row in zip(*(part.column(k).to_pylist() for k in range(part.num_columns))):
                if (key, i, j) != group:
                    flush()
                    group, held = (key, i, j), []
                held.append(row)
            yield pairs(out)
            out = []
        flush()
        yield pairs(out)

    def pairs(out):
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    spread = dealt.repartition(partitions(classes.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "class")
    return spread.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, distance: int | None = None, chunks: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id), text_hash and stays of every row of docs (doc_id, text).

    stays marks one (doc_id, text) of each component, that with the smallest doc_id; xxhash64 of the text, text_hash,
    tells texts of one doc_id apart. Null texts and texts without words have an empty set and link with nothing.
    Documents with fewer words than width have their whole sequence as one shingle; texts of any length are read
    whole. Rows that repeat a doc_id come out each: with the same text in the same component, with different texts
    each in that of its own text. Rows with a null doc_id link with nothing, are kept and stay, with a null component.
    Of equal doc_ids in a component (ties) the one whose set and text hash are smallest stays. Columns other than
    doc_id and text are not read, whatever their names. An empty table gives no rows. distance and chunks are those of
    limits(percent) unless given.
    """
    if distance is None or chunks is None:
        distance, chunks = (derived if given is None else given for given, derived in zip((distance, chunks), limits(percent)))
    rows = staged(sketch(docs, width), "sketches")
    links_with_others = "n_shingles > 0 and doc_id is not null"
    sets = ["n_shingles", "set_a", "set_b"]
    classes = rows.where(links_with_others).groupBy(*sets).agg(F.min(F.struct("doc_id", "text_hash", "signature")).alias("first"))
    # a class is numbered where it is written, so the number is the same for all that read it
    classes = staged(classes.select(F.monotonically_increasing_id().alias("class"), *sets, "first.*"), "classes")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")

    keyed = with_keys(classes.select("class", "signature"), [], distance, chunks)
    smallest = keyed.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a <> z").select("key", "a")
    stars = staged(keyed.join(smallest, "key").where("a <> class").select("a", F.col("class").alias("b")).distinct(), "stars")
    ends = stars.select("a").unionAll(stars.select("b")).distinct().withColumnRenamed("a", "class")
    # ends and classes grow with the documents, so they are merged, not broadcast: broadcasts take the driver's memory
    ends = staged(ends.join(classes.hint("merge"), "class").select("class", "doc_id", "text_hash"), "ends")
    wanted = staged(with_brief(marked(texts, ends).join(ends.hint("merge"), ["doc_id", "text_hash"]).groupBy("class").agg(F.min("text").alias("text")), width), "texts")
    links = staged(confirm(stars, wanted, width, percent), "confirmed")
    labels = staged(components(links).withColumnRenamed("node", "class"), "labels")
    near = staged(classes.select("class", "signature").join(wanted.select("class", "n", "brief").hint("merge"), "class"), "near")
    tried = stars
    for forest in (True, False):
        more = staged(unsettled(near, labels, percent, distance, chunks, forest).join(tried.hint("merge"), ["a", "b"], "left_anti"), "forest" if forest else "unsettled")
        tried = tried.unionAll(more)
        labels = staged(merged(labels.withColumnRenamed("class", "node"), confirm(more, wanted, width, percent)).withColumnRenamed("node", "class"), "merged")
    linked = staged(labels.join(classes.select("class", *sets, "doc_id").hint("merge"), "class"), "linked")
    least = linked.groupBy("component").agg(F.min(F.struct("doc_id", *sets)).alias("least"), F.count("*").alias("members"))
    named = spread_join(linked, least, ["component"], "members", ["class"]).select("class", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", *sets) == F.col("least")).alias("is_least"))
    of = classes.select("class", *sets, F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_text")).join(named.hint("merge"), "class", "left")
    of = of.select(*sets, F.coalesce("component_id", "first_id").alias("component_id"), F.when(F.coalesce("is_least", F.lit(True)), F.col("first_text")).alias("staying"))
    columns = ["doc_id", "n_shingles", "component_id", "kept", "text_hash", "stays"]
    out = rows.where(links_with_others).join(of, sets).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    out = out.withColumn("stays", F.col("kept") & F.coalesce(F.col("text_hash") == F.col("staying"), F.lit(False)))
    alone = rows.where(f"not ({links_with_others})").withColumns({"component_id": F.col("doc_id"), "kept": F.lit(True), "stays": F.lit(True)})
    return out.select(*columns).unionByName(alone.select(*columns))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op10_minhash_dedup": op10_minhash_dedup}
ORACLES: dict[str, str] = {}
