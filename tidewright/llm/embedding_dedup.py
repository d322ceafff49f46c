"""Near-duplicate vectors: an exact metric range join by cosine.

Equal vectors are one weighted representative first. Pivots, a sample that grows with the table up to the root of its size, split the unit sphere
into cells, each vector's home being the cell of its nearest pivot. A vector visits another cell only if a
vector within the range can live there: by the triangle inequality its angle to that pivot exceeds neither the
cell's radius plus the range nor its own home angle plus twice the range, and it lies no further than the
range from the plane between both pivots. Of two cells one is visited by the other's vectors, so each pair is
compared once. Large cells are cut into units. Members within half the range of their pivot link to each
other without comparison (triangle inequality again), so a tight group of any size costs no pairs.

A task holds the home vectors of one unit and streams its visitors past them. It emits a row for each vector
that linked: how many, and one vector of its local component.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._graph import components
from ._shared import partitions, staged, table
from ._skew import spread_join

CELL, BATCH = 4096, 1024
DENSE, CONFIRMED = 0.02, 20_000  # share of near pairs from which a block is compared in doubles at once; pairs confirmed together
SLACK = 1e-9  # bounds are wider by this than rounding can be


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, key (128 bits of a vector that can link, else null) and vector (doubles)."""

    def run(parts):
        for part in parts:
            keys, out = [], []
            for at, v in zip(part.column(0), part.column(1)):
                v = v.as_py()
                x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
                ok = at.is_valid and x.size > 0 and np.isfinite(x).all() and x.any()
                keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if ok else None)
                out.append(x if ok else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.float64()))], names=["vec_id", "key", "vector"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, key binary, vector array<double>")


def _matrix(column) -> np.ndarray:
    x = np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _stored(column) -> np.ndarray:
    """Unit vectors as at_home has written them."""
    if not len(column):
        return np.zeros((0, 0))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.float64, (int(at[-1]) - int(at[0])) // 8, int(at[0])).reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    at = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _step(pivots: np.ndarray) -> int:
    """Vectors that are held against all pivots at once."""
    return max(16, min(BATCH, (1 << 22) // len(pivots)))


def at_home(reps: DataFrame, pivots: np.ndarray, range_: float) -> DataFrame:
    """rep, weight, vector (of length 1, as bytes of doubles) with home (the nearest pivot's number), core (within half the range of it) and angle."""
    shared = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(parts):
        for part in parts:
            if part.num_rows:
                x, step = _matrix(part.column(2)), _step(shared.value)
                home, top = np.zeros(len(x), np.int64), np.zeros(len(x))
                for at in range(0, len(x), step):
                    near = x[at : at + step] @ shared.value.T
                    home[at : at + step], top[at : at + step] = near.argmax(1), near.max(1)
                angle = _angle(top)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], _binary(x), pa.array(home, pa.int32()), pa.array(angle <= range_ / 2 - 1e-6), pa.array(angle)], names=["rep", "weight", "vector", "home", "core", "angle"])

    return reps.select("rep", "weight", "vector").mapInArrow(run, "rep long, weight long, vector binary, home int, core boolean, angle double")


class Plan:
    """Units of every cell and who visits whom; its size depends on the number of pivots and units alone."""

    def __init__(self, pivots: np.ndarray, counts: dict[tuple[int, bool], int], radius: dict[int, float], range_: float, unit: int):
        self.pivots, self.range = pivots, range_
        self.chord = 2 * math.sin(range_ / 2)
        n = len(pivots)
        self.units, self.first, self.size = [], np.zeros((n, 2), np.int64), np.ones((n, 2), np.int64)
        for (home, core), rows in sorted(counts.items()):
            self.first[home, int(core)], self.size[home, int(core)] = len(self.units), max(1, math.ceil(rows / unit))
            self.units += [(home, core)] * int(self.size[home, int(core)])
        self.home = np.array([h for h, _ in self.units], np.int64)
        self.core = np.array([c for _, c in self.units], bool)
        self.start = np.searchsorted(self.home, np.arange(n + 1))  # a home's units stand together
        self.radius = np.array([radius.get(h, -10.0) for h in range(n)])

    def unit_of(self, home: np.ndarray, core: np.ndarray, at: np.ndarray) -> np.ndarray:
        side = core.astype(np.int64)
        return self.first[home, side] + at % self.size[home, side]

    def visits(self, unit: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, unit) of the visits of vectors that live in these units, from their cosines to all pivots."""
        home, rows = self.home[unit], np.arange(len(unit))
        angles = _angle(cosines)
        reach = (angles <= self.radius + (self.range + SLACK)) & (angles <= (angles[rows, home] + 2 * self.range + SLACK)[:, None])
        for h in np.unique(home).tolist():  # the plane between the home pivot and another
            of = np.flatnonzero(home == h)
            apart = np.sqrt(np.maximum(2 - 2 * (self.pivots @ self.pivots[h]), 0))
            reach[of] &= cosines[of, h][:, None] - cosines[of] <= self.chord * apart + SLACK
        reach[rows, home] = True
        row, pivot = np.nonzero(reach)
        n = self.start[pivot + 1] - self.start[pivot]
        to = np.repeat(self.start[pivot] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        row = np.repeat(row, n)
        own = unit[row]
        ok = np.where((to + own) % 2 == 0, to < own, to > own) & ~(self.core[own] & self.core[to] & (self.home[own] == self.home[to]))
        return row[ok], to[ok]


def _mixed(rep: np.ndarray) -> np.ndarray:
    """A number of 31 bits for each representative that says nothing of its place."""
    h = rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(33)).astype(np.int64)


def deal(homes: DataFrame, plan: Plan) -> DataFrame:
    """unit, visitor, rep, weight, vector: a row at home and one for each visit."""
    shared = homes.sparkSession.sparkContext.broadcast(plan)

    def run(parts):
        plan = shared.value
        for part in parts:
            step = _step(plan.pivots)
            for at in range(0, part.num_rows, step):
                some = part.slice(at, step)
                rep, home, core = some.column(0).to_numpy(), some.column(3).to_numpy().astype(np.int64), some.column(4).to_numpy(zero_copy_only=False)
                unit = plan.unit_of(home, core, _mixed(rep))
                row, to = plan.visits(unit, _stored(some.column(2)) @ plan.pivots.T)
                rows, units = np.concatenate([np.arange(len(rep)), row]), np.concatenate([unit, to])
                visitor = np.arange(len(rows)) >= len(rep)
                for k in range(0, len(rows), 20_000):
                    few = some.take(pa.array(rows[k : k + 20_000]))
                    yield pa.RecordBatch.from_arrays([pa.array(units[k : k + 20_000], pa.int32()), pa.array(visitor[k : k + 20_000]), *(few.column(i) for i in range(3))], names=["unit", "visitor", "rep", "weight", "vector"])

    return homes.select("rep", "weight", "vector", "home", "core").mapInArrow(run, "unit int, visitor boolean, rep long, weight long, vector binary")


def near_pairs(a: np.ndarray, rough_a: np.ndarray, b: np.ndarray, rough_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with a[i] . b[j] >= least in doubles, by i and j; rough ones are the same rows in single precision.

    Single precision only rules pairs out, by more than its error can be; the rest is confirmed in doubles.
    """
    error = 4 * (a.shape[1] + 8) * 2.0**-24
    near = rough_a @ rough_b.T >= np.float32(least - error)
    i, j = np.divmod(np.flatnonzero(near), near.shape[1])
    if len(i) > DENSE * near.size:
        return np.divmod(np.flatnonzero(a @ b.T >= least), near.shape[1])
    good = [np.einsum("ij,ij->i", a[i[k : k + CONFIRMED]], b[j[k : k + CONFIRMED]]) >= least for k in range(0, len(i), CONFIRMED)]
    good = np.concatenate(good) if good else np.zeros(0, bool)
    return i[good], j[good]


class Unit:
    """The home vectors of a unit; links among them and to visitors."""

    def __init__(self, core: bool, least: float):
        self.core, self.least = core, least
        self.reps, self.weights, self.parts, self.ready = [], [], [], False

    def add(self, reps, weights, vectors) -> None:
        self.reps.append(reps)
        self.weights.append(weights)
        self.parts.append(vectors)

    def close_homes(self) -> None:
        self.ready = True
        self.rep, self.weight, self.x = np.concatenate(self.reps), np.concatenate(self.weights), np.concatenate(self.parts)
        self.rough = self.x.astype(np.float32)
        self.links, self.label = np.zeros(len(self.rep), np.int64), np.arange(len(self.rep))
        for at in range(0, 0 if self.core else len(self.rep), BATCH):
            i, j = near_pairs(self.x[at : at + BATCH], self.rough[at : at + BATCH], self.x[at:], self.rough[at:], self.least)
            i, j = i[j > i] + at, j[j > i] + at
            np.add.at(self.links, i, self.weight[j])
            np.add.at(self.links, j, self.weight[i])
            first = np.flatnonzero(np.diff(i, prepend=-1))
            for members in np.split(j, first[1:]) if len(first) else ():
                self.join(members)
            for a, b in zip(i[first].tolist(), j[first].tolist()):
                self.join(np.array([a, b]))

    def join(self, members: np.ndarray) -> None:
        roots = np.unique(self.label[members])
        if len(roots) > 1:
            self.label[np.isin(self.label, roots[1:])] = roots[0]

    def visit(self, reps, weights, vectors):
        """(rep, links, a home it is linked to) of the visitors that link."""
        for at in range(0, len(reps), BATCH):
            some = slice(at, at + BATCH)
            i, j = near_pairs(vectors[some], vectors[some].astype(np.float32), self.x, self.rough, self.least)
            if len(i):
                np.add.at(self.links, j, weights[some][i])
                first = np.flatnonzero(np.diff(i, prepend=-1))
                for members in np.split(j, first[1:]):
                    self.join(members)
                yield reps[some][i[first]], np.add.reduceat(self.weight[j], first), self.rep[j[first]]

    def rows(self):
        """(rep, links, one of its component) of the homes that link."""
        some = np.flatnonzero(self.links)
        return self.rep[some], self.links[some], self.rep[self.label[some]]


def range_join(dealt: DataFrame, cores: list[bool], least: float) -> DataFrame:
    """rep, links, other: partial counts of links and one link of the same component, by unit."""

    def emit(rep, links, other):
        return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], names=["rep", "links", "other"])

    def run(parts):
        unit, held = None, None
        for part in parts:
            if not part.num_rows:
                continue
            units, visitors = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
            reps, weights, vectors = part.column(2).to_numpy(), part.column(3).to_numpy(), _stored(part.column(4))
            cut = np.flatnonzero((np.diff(units) != 0) | (visitors[1:] != visitors[:-1])) + 1
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(units)]):
                if units[i] != unit:
                    if held is not None:
                        if not held.ready:
                            held.close_homes()
                        yield emit(*held.rows())
                    unit, held = units[i], None
                if not visitors[i]:
                    held = held or Unit(cores[unit], least)
                    held.add(reps[i:j], weights[i:j], vectors[i:j])
                elif held is not None:
                    if not held.ready:
                        held.close_homes()
                    for got in held.visit(reps[i:j], weights[i:j], vectors[i:j]):
                        yield emit(*got)
        if held is not None:
            if not held.ready:
                held.close_homes()
            yield emit(*held.rows())

    spread = dealt.repartition(partitions(dealt.sparkSession), "unit").sortWithinPartitions("unit", "visitor")
    return spread.mapInArrow(run, "rep long, links long, other long")


def near_vectors(vectors: DataFrame, least: float = 0.9, cell: int = CELL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding); least is above 0.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and vectors of
    different lengths do not link. A row without vec_id links with nothing, has no component and is kept. Rows that
    repeat a vec_id count as vectors of their own in n_links, each with the links and component of its own vector;
    rows with the smallest vec_id of a component (ties) are all kept. Columns other than vec_id and embedding are not
    read, whatever their names. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = staged(keyed(vectors), "vectors")
    reps = rows.where("key is not null").groupBy("key").agg(F.min(F.struct("vec_id", "vector")).alias("first"), F.count("*").alias("weight"))
    # a representative is numbered where it is written, so the number is the same for all that read it
    reps = staged(reps.select(F.monotonically_increasing_id().alias("rep"), "key", F.col("first.vec_id").alias("first_id"), F.col("first.vector").alias("vector"), "weight"), "representatives")
    range_ = math.acos(least)
    links = None
    for dim, n in sorted(tuple(r) for r in reps.groupBy(F.size("vector")).count().collect()):
        same = reps.where(F.size("vector") == dim)
        chosen = same.orderBy(F.xxhash64("first_id"), "first_id", "key").select("vector").limit(max(1, min(math.ceil(n / cell), math.ceil(math.sqrt(n))))).collect()  # at most the root of the vectors
        pivots = _matrix(pa.array([r[0] for r in chosen], pa.list_(pa.float64())))
        homes = staged(at_home(same, pivots, range_), f"homes-{dim}")
        cells = homes.groupBy("home", "core").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.sum("weight").alias("weight"), F.min("rep").alias("least_rep")).collect()  # two rows a pivot
        radius: dict[int, float] = {}
        for r in cells:
            radius[r["home"]] = max(radius.get(r["home"], -10.0), r["radius"])
        plan = Plan(pivots, {(r["home"], r["core"]): r["n"] for r in cells}, radius, range_, cell)
        found = range_join(deal(homes, plan), [core for _, core in plan.units], least)
        tight = [(r["home"], r["weight"], r["least_rep"]) for r in cells if r["core"]]
        if tight:
            tight_df = F.broadcast(spark.createDataFrame(tight, "home int, all long, other long"))  # a row a pivot at most
            found = found.unionAll(homes.where("core").join(tight_df, "home").select("rep", F.col("all") - F.col("weight"), "other"))
        links = found if links is None else links.unionAll(found)
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if links is None:
        return alone
    links = staged(links, "links")
    labels = components(links.select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    linked = staged(labels.join(reps.select("rep", "first_id"), "rep"), "linked")
    smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    named = spread_join(linked, smallest, ["component"], "members", ["rep"]).select("rep", "component_id")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    of = reps.select("key", "rep", "first_id", "weight").join(counts, "rep", "left").join(named, "rep", "left")
    of = of.select("key", "weight", F.coalesce("component_id", "first_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"))
    out = spread_join(rows.where("key is not null").select("vec_id", "key"), of, ["key"], "weight", ["vec_id"])
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionAll(alone)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_embedding_dedup": op3_embedding_dedup}
ORACLES: dict[str, str] = {}
