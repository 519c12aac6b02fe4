"""Near-duplicate embeddings by lattice hashing.

Two vectors are linked if their cosine, in double precision, is at least ``COSINE``.

1. Rows with equal vectors are one class.  Classes are gathered into *balls*: in each round the
   rows of a lattice cell are compared with one of them, its leader, and those within half the
   linking angle join it.  All members of a ball are linked with each other by the triangle
   inequality, so a group of near copies, however large, costs a comparison a member.
2. A table of the index projects vectors at random to 8m dimensions and decodes each block of
   eight to the nearest point of the lattice E8.  A vector lies in the cell of its m points and
   probes the ``PROBES`` cells that are nearest otherwise, which differ by one of the lattice's
   240 shortest steps in one or two blocks.  How many tables are needed for a pair *at* the
   threshold to share a cell with probability 1 - ``MISS`` is found by simulation before (the
   chance depends on the angle alone, not on the data); m grows until a cell holds few balls on
   average (measured).
3. Balls that meet in a cell, in any table, are candidates: one row a cell and ball, whatever
   the ball's size.  Those whose leaders' sign sketches are too far apart go (chance of a loss:
   1e-9 a pair).
4. Candidates are compared by their leaders: if the angle and both radii prove that all members
   are linked, or none, that settles it.  Else each member is compared with the other ball's
   leader in the same way, and what is still open is multiplied out in blocks of about 256
   members, summed there to a count for each vector: no pair of vectors becomes a row.
5. Links between balls give components.

So a pair that is reported is verified or proven, and none below the threshold is reported;
pairs at the threshold are missed with probability ``MISS``, closer ones hardly ever.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows
without an id, link with nothing (component_id is the row's own id); shorter vectors count as
padded with zeros; repeated rows, and rows that share an id, are linked like others (a row's
copies count in its n_links); an empty table gives an empty result; other columns of the input
are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_settled, settle
from .components import components

COSINE, MISS = 0.9, 5e-4
#: Cells probed besides the own one; balls in a cell, on average over balls, beyond which cells get smaller.
PROBES, CROWD = 4, 8
#: The lattice's scale, times the root of the dimension; rounds in which balls are gathered; members in a block; bits of a sketch.
SCALE, ROUNDS, BLOCK, BITS = 2.6, 6, 256, 128
#: Kept between computed angles and what is concluded from them.
_SLACK = 1e-6


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    return np.array(out + [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])


STEPS = _shortest()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with integer coordinates of even sum."""
    f = np.rint(x)
    gap = x - f
    odd = np.flatnonzero(f.sum(1) % 2)
    worst = np.abs(gap[odd]).argmax(1)
    f[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
    return f


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: of its two cosets of D8, the nearer one's."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@dataclass
class Table:
    """A projection to 8m dimensions in units of the lattice, and a linear hash of its points."""

    turn: np.ndarray
    shift: np.ndarray
    weight: np.ndarray

    @classmethod
    def make(cls, dim: int, m: int, seed: int) -> Table:
        rng = np.random.default_rng([12, seed])
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : 8 * m]
        return cls(turn * (math.sqrt(dim) / SCALE), rng.random(8 * m) * 4, rng.integers(0, 1 << 63, (m, 8), np.uint64) * np.uint64(2) + np.uint64(1))

    def cells(self, units: np.ndarray, probes: int = 0) -> np.ndarray:
        """Keys of the vectors' own cells and of the next nearest ones."""
        n, m = len(units), len(self.weight)
        x = (units @ self.turn + self.shift).reshape(n * m, 8)
        point = decode(x)
        key = ((2 * point).astype(np.int64).astype(np.uint64).reshape(n, m, 8) * self.weight).sum((1, 2), dtype=np.uint64)
        if not probes:
            return key[:, None].view(np.int64)
        steps = ((2 * STEPS).astype(np.int64).astype(np.uint64) @ self.weight.T).T.reshape(-1)  # what a step in a block adds to the key
        cost = (2 - 2 * ((x - point) @ STEPS.T)).reshape(n, m * len(STEPS))
        best = np.argpartition(cost, probes - 1, 1)[:, :probes]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, 1), 1), 1)
        cost, add, block = np.take_along_axis(cost, best, 1), steps[best], best // len(STEPS)
        costs, adds = [cost], [add]
        for i, j in itertools.combinations(range(min(3, probes)), 2):  # two steps, in different blocks
            costs.append(np.where(block[:, i] == block[:, j], np.inf, cost[:, i] + cost[:, j])[:, None])
            adds.append((add[:, i] + add[:, j])[:, None])
        costs, adds = np.concatenate(costs, 1), np.concatenate(adds, 1)
        pick = np.argpartition(costs, probes - 1, 1)[:, :probes]
        return np.concatenate((key[:, None], key[:, None] + np.take_along_axis(adds, pick, 1)), 1).view(np.int64)


def tables_needed(width: int, dim: int, m: int, angle: float, pairs: int = 500, turns: int = 8) -> int:
    """Tables after which a pair at this angle has shared a cell with probability 1 - MISS."""
    rng, hit = np.random.default_rng(12), 0
    for t in range(turns):
        u, v = rng.normal(size=(2, pairs, width))
        u /= np.linalg.norm(u, axis=1)[:, None]
        v -= (u * v).sum(1)[:, None] * u
        size = np.linalg.norm(v, axis=1)[:, None]
        v = np.cos(angle) * u + np.sin(angle) * np.divide(v, size, out=np.zeros_like(v), where=size > 1e-9)
        a, b = (Table.make(dim, m, -1 - t & 0xFFFF).cells(np.pad(x, ((0, 0), (0, dim - width))), PROBES) for x in (u, v))
        hit += int(((a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)).sum())
    chance = hit / (pairs * turns)
    chance -= 2 * math.sqrt(chance * (1 - chance) / (pairs * turns))
    return max(2, math.ceil(math.log(MISS) / math.log1p(-min(chance, 0.999)))) if chance > 0 else 1 << 10


# -- batches of unit vectors --------------------------------------------------------------------


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _angles(dots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dots, -1, 1))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _unit_stage(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            own = b.column("e")
            size = np.diff(own.offsets.to_numpy())
            x = np.zeros((b.num_rows, dim))
            x[np.repeat(np.arange(b.num_rows), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = own.flatten().to_numpy(zero_copy_only=False)
            x /= np.abs(x).max(1, keepdims=True)  # so that squares neither vanish nor overflow
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "unit"])

    return stage


@dataclass
class Geometry:
    dim: int
    angle: float
    m: int = 1

    def table(self, seed: int) -> Table:
        return Table.make(self.dim, self.m, seed)


def _homes(df: DataFrame, g: Geometry, seed: int, keep: str) -> DataFrame:
    """``keep`` columns and the key of the unit's cell in one table."""
    table = df.sparkSession.sparkContext.broadcast(g.table(seed))
    names = [c.strip() for c in keep.split(",")]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            keys = table.value.cells(matrix(b.column("unit"), g.dim))[:, 0]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(keys)], names=[*names, "key"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in names}
    return df.mapInArrow(stage, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", key long")


# -- balls ---------------------------------------------------------------------------------------


def balls(classes: DataFrame, g: Geometry) -> tuple[DataFrame, DataFrame]:
    """``classes(id, unit, n, low)`` → members (id, unit, n, low, ball, off: the angle to the leader)
    and balls (ball, unit of the leader, radius, members, n: rows of all members, low: the
    smallest of theirs)."""
    reach = g.angle / 2 - _SLACK

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            off = _angles((matrix(b.column("unit"), g.dim) * matrix(b.column("lead_unit"), g.dim)).sum(1))
            own = b.column("id").to_numpy() == b.column("lead").to_numpy()
            joined = pa.array(np.where(own, 0.0, off), mask=(off > reach) & ~own)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "unit", "n", "low", "lead")), joined], names=["id", "unit", "n", "low", "ball", "off"])

    left, done = classes.select("id", "unit", "n", "low"), []
    before = left.count()
    for r in range(ROUNDS):
        keyed = settle(_homes(left, g, 1000 + r, "id, unit, n, low"), "cells")
        lead = keyed.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), "id", "unit")).alias("lead"))
        lead = settle(lead.select("key", F.col("lead.id").alias("lead"), F.col("lead.unit").alias("lead_unit")), "leads")
        met = settle(keyed.join(lead, "key").select("id", "unit", "n", "low", "lead", "lead_unit").mapInArrow(attach, "id long, unit binary, n long, low long, ball long, off double"), "attached")
        drop_settled(keyed)
        drop_settled(lead)
        # leaders without followers go back
        alone = met.filter("off is not null").groupBy("ball").count().filter("count = 1").select("ball")
        state = settle(met.join(alone.withColumn("alone", F.lit(True)), "ball", "left").withColumn("in", F.col("off").isNotNull() & F.col("alone").isNull()), "attached")
        done.append(state.filter("`in`").select("id", "unit", "n", "low", "ball", "off"))
        left = state.filter("not `in`").select("id", "unit", "n", "low")
        drop_settled(met)
        now = left.count()
        if not now or (before - now) * 100 < before:
            break
        before = now
    members = left.select("id", "unit", "n", "low", F.col("id").alias("ball"), F.lit(0.0).alias("off"))
    for part in done:
        members = members.unionByName(part)
    members = settle(members, "members")
    of = members.groupBy("ball").agg(F.max("off").alias("radius"), F.count("*").alias("members"), F.sum("n").alias("n"), F.min("low").alias("low"))
    return members, settle(of.join(members.select(F.col("id").alias("ball"), "unit"), "ball"), "balls")


# -- candidates ----------------------------------------------------------------------------------


def crowding(members: DataFrame, g: Geometry) -> float:
    """How many balls the cell of a ball holds, on average, in one table."""
    cells = _homes(members, g, 0, "ball").distinct().groupBy("key").count()
    row = cells.agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs"), F.sum("count").alias("rows")).first()
    return row["pairs"] / row["rows"] if row["rows"] else 0.0


_ROW = "key long, probe boolean, ball long, s0 long, s1 long, radius double"


def _index(members: DataFrame, g: Geometry, tables: int, probes: int) -> DataFrame:
    """A row for each cell that a member lies in, and for each that it probes (if any)."""
    rng = np.random.default_rng([13, g.dim])
    shared = members.sparkSession.sparkContext.broadcast(([g.table(t) for t in range(tables)], rng.normal(size=(g.dim, BITS))))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, planes = shared.value
        for b in _small(batches):
            units = matrix(b.column("unit"), g.dim)
            lead = matrix(b.column("lead_unit"), g.dim)
            sketch = np.packbits(lead @ planes > 0, axis=1).view("<i8")
            for t, table in enumerate(made):
                keys = table.cells(units, probes) + np.int64(t)
                k = keys.shape[1]
                at = np.repeat(np.arange(b.num_rows), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1)), pa.array(np.tile(np.arange(k) > 0, b.num_rows)), b.column("ball").take(pa.array(at)), pa.array(sketch[at, 0]), pa.array(sketch[at, 1]), b.column("radius").take(pa.array(at))],
                    names=["key", "probe", "ball", "s0", "s1", "radius"],
                )

    many = members.filter("members > 1").mapInArrow(stage, _ROW).dropDuplicates(["key", "probe", "ball"])
    return members.filter("members = 1").mapInArrow(stage, _ROW).unionByName(many)


def candidates(members: DataFrame, g: Geometry, tables: int) -> DataFrame:
    """(u, v), u < v: balls that share a cell and whose sketches allow a link."""
    a, b = _index(members, g, tables, PROBES).alias("a"), _index(members, g, tables, 0).alias("b")
    share = F.least((F.lit(g.angle) + F.col("a.radius") + F.col("b.radius")) / math.pi, F.lit(1.0))
    differ = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in ("s0", "s1")), F.lit(0))
    close = differ <= BITS * share + 6 * F.sqrt(BITS * share * (1 - share))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.ball") != F.col("b.ball")) & (F.col("a.probe") | (F.col("a.ball") < F.col("b.ball"))) & close)
    return met.select(F.least("a.ball", "b.ball").alias("u"), F.greatest("a.ball", "b.ball").alias("v")).distinct()


# -- links ---------------------------------------------------------------------------------------

NONE, OPEN, ALL = 0, 1, 2


def _concluded(dots: np.ndarray, radius: np.ndarray, angle: float) -> np.ndarray:
    """Whether vectors at these cosines to a ball's leader are linked with none, all or some of
    what is within the radius."""
    off = _angles(dots)
    bound = np.where(off + radius <= angle - _SLACK, ALL, np.where(off - radius > angle + _SLACK, NONE, OPEN))
    return np.where(radius == 0, np.where(dots >= COSINE, ALL, NONE), bound)


def _compared(pairs: DataFrame, of: DataFrame, g: Geometry) -> DataFrame:
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            dots = (matrix(b.column("u_unit"), g.dim) * matrix(b.column("v_unit"), g.dim)).sum(1)
            state = _concluded(dots, b.column("u_radius").to_numpy() + b.column("v_radius").to_numpy(), g.angle)
            keep = np.flatnonzero(state != NONE)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(keep)) for c in ("u", "v", "u_n", "v_n")), pa.array(state[keep] == ALL)], names=["u", "v", "u_n", "v_n", "all"])

    side = lambda s: of.select(F.col("ball").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("unit", "radius", "n")])
    return pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(stage, "u long, v long, u_n long, v_n long, all boolean")


def _salt() -> Column:
    """Deals the members of a ball to parts of about BLOCK, however large it is."""
    return F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / BLOCK))


def _sum_open(open_pairs: DataFrame, members: DataFrame, of: DataFrame, g: Geometry) -> DataFrame:
    """For pairs of balls that their leaders don't settle: (u, v, id, n): members of u and how
    many rows of v they are linked with, if any."""
    sides = settle(open_pairs.select("u", "v").unionByName(open_pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))), "open")
    inside = members.join(sides.select(F.col("u").alias("ball")).distinct(), "ball", "left_semi").withColumn("salt", _salt())
    blocks = settle(inside.groupBy("ball", "salt").agg(F.collect_list(F.struct("id", "n", "unit")).alias("of")), "blocks")

    def arrays(x: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = x.values
        return v.field("id").to_numpy(), v.field("n").to_numpy(), matrix(v.field("unit"), g.dim)

    def by_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, 64):
            lead, radius, n = matrix(b.column("v_unit"), g.dim), b.column("v_radius").to_numpy(), b.column("v_n").to_numpy()
            us, vs = b.column("u").to_pylist(), b.column("v").to_pylist()
            for i, own in enumerate(b.column("of")):
                ids, _, units = arrays(own)
                state = _concluded(units @ lead[i], np.full(len(ids), radius[i]), g.angle)
                for kind in (ALL, OPEN):
                    hit = np.flatnonzero(state == kind)
                    if len(hit):
                        rows = [us[i]] * len(hit), [vs[i]] * len(hit), ids[hit], [n[i]] * len(hit)
                        open_units = pa.array([units[j].tobytes() if kind == OPEN else None for j in hit], pa.binary())
                        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in rows), open_units], names=["u", "v", "id", "n", "unit"])

    def by_member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches, 16):
            us, vs = b.column("u").to_pylist(), b.column("v").to_pylist()
            for i, (one, two) in enumerate(zip(b.column("open"), b.column("of"), strict=True)):
                ids, _, units = arrays(one)
                _, n, others = arrays(two)
                total = (units @ others.T >= COSINE) @ n
                hit = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([us[i]] * len(hit), [vs[i]] * len(hit), ids[hit], total[hit])], names=["u", "v", "id", "n"])

    lead = of.select(F.col("ball").alias("v"), *[F.col(c).alias(f"v_{c}") for c in ("unit", "radius", "n")])
    first = sides.join(blocks.select(F.col("ball").alias("u"), "of"), "u").join(lead, "v")
    first = settle(first.mapInArrow(by_leader, "u long, v long, id long, n long, unit binary"), "sides")
    wide = first.filter("unit is not null").join(of.select(F.col("ball").alias("u"), "members"), "u").withColumn("salt", _salt())
    wide = wide.groupBy("u", "v", "salt").agg(F.collect_list(F.struct("id", F.lit(1).cast("long").alias("n"), "unit")).alias("open"))
    rest = wide.join(blocks.select(F.col("ball").alias("v"), "of"), "v").mapInArrow(by_member, "u long, v long, id long, n long")
    return settle(first.filter("unit is null").select("u", "v", "id", "n").unionByName(rest), "sums")


def near_embeddings(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``table(vec_id, embedding)`` → (vec_id, n_links, component_id, kept), one row for each."""
    if cosine != COSINE:
        raise ValueError(f"the bounds here are for {COSINE}")
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    e = F.col("embedding").cast("array<double>")
    base = table.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).withColumn("good", F.coalesce(F.col("vec_id").isNotNull() & F.forall("e", whole) & F.exists("e", lambda x: x != 0), F.lit(False)))
    rows = settle(base.select("vec_id", F.when(F.col("good"), F.col("e")).alias("e")), "vectors")
    found = rows.filter("e is not null")
    width = found.agg(F.max(F.size("e")).alias("w")).first()["w"]
    if width is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    g = Geometry(dim=8 * math.ceil(width / 8), angle=math.acos(COSINE))
    classes = settle(found.groupBy("e").agg(F.count("*").alias("n"), F.min("vec_id").alias("low")).withColumn("id", F.monotonically_increasing_id()), "classes")
    units = settle(classes.select("id", "e").mapInArrow(_unit_stage(g.dim), "id long, unit binary").join(classes.select("id", "n", "low"), "id"), "units")
    most = g.dim // 8
    g.m = min(most, max(1, math.ceil(math.log(max(1, units.count()) / CROWD) / 4)))
    members, of = balls(units, g)
    lead = of.select("ball", F.col("unit").alias("lead_unit"), "radius", "members")
    placed = settle(members.select("id", "ball", "unit", "n").join(lead, "ball"), "placed")
    while g.m < most and crowding(placed, g) > CROWD:
        g.m += 1

    compared = settle(_compared(candidates(placed, g, tables_needed(width, g.dim, g.m, g.angle)), of, g), "compared")
    sure = compared.filter("all")
    sums = _sum_open(compared.filter("not all"), placed, of, g)
    links = sure.select("u", "v").unionByName(sums.select("u", "v"))
    joined = components(links)
    by_ball = sure.select(F.col("u").alias("ball"), F.col("v_n").alias("k")).unionByName(sure.select(F.col("v").alias("ball"), F.col("u_n").alias("k"))).groupBy("ball").agg(F.sum("k").alias("k"))
    by_class = sums.groupBy("id").agg(F.sum("n").alias("own"))

    # what a ball's members have in common is worked out a ball at a time, and dealt to parts of it
    of_ball = of.select("ball", "n", "members", "low").join(joined.withColumnRenamed("node", "ball"), "ball", "left").join(by_ball, "ball", "left")
    of_ball = settle(of_ball.withColumn("component", F.coalesce("component", "ball")), "named")
    least = settle(of_ball.groupBy("component").agg(F.min("low").alias("component_id")), "least")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("members") / BLOCK) - 1))
    of_ball = of_ball.join(least, "component").select("ball", "component_id", (F.col("n") - 1 + F.coalesce("k", F.lit(0))).alias("shared"), parts.alias("salt"))
    named = placed.select("id", "ball", _salt().alias("salt")).join(settle(of_ball, "named"), ["ball", "salt"]).join(by_class, "id", "left")
    named = settle(named.select("id", "component_id", (F.col("shared") + F.coalesce("own", F.lit(0))).alias("n_links")), "named")
    named = settle(classes.select("e", "id").join(named, "id").select("e", "component_id", "n_links"), "named")
    component = F.coalesce("component_id", "vec_id")
    return rows.join(named, "e", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
