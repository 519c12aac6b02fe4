"""Lattice hashing against all cosines, on groups made to be hard."""

import math

import numpy as np
import pytest

from vereda.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int, key string, id string, ball string, n string"


def plain(rows):
    """(vec_id, n_links, component_id, kept) by all cosines."""
    use = [i for i, (k, e) in enumerate(rows) if k is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(np.float32(x) for x in e)]
    width = max((len(rows[i][1]) for i in use), default=0)
    x = np.array([[*rows[i][1], *[0] * (width - len(rows[i][1]))] for i in use], np.float32).astype(float).reshape(-1, width)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    part = np.arange(len(use))
    for i in range(len(use)):
        for j in np.flatnonzero(linked[i]):
            part[part == part[j]] = part[i]
    out = [(k, 0, k, True) for k, _ in rows]
    for i, r in enumerate(use):
        low = min(rows[use[j]][0] for j in np.flatnonzero(part == part[i]))
        out[r] = (rows[r][0], int(linked[i].sum()) - 1, low, low == rows[r][0])
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(k, e, 1, "x", "x", "x", "x") for k, e in rows], SCHEMA)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice.near_embeddings(df).collect()), key=str)


def around(rng, centre, angle, n):
    """Vectors at about this angle from each other."""
    noise = rng.normal(size=(n, len(centre)))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return centre + noise * math.tan(angle / math.sqrt(2))


@pytest.mark.parametrize("dim", [5, 16, 64])
def test_equals_all_cosines(spark, dim):
    rng = np.random.default_rng(dim)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.normal(size=(n, dim)))
    x = list(unit(200 if dim > 5 else 60))
    edge = math.acos(0.9)
    for base in unit(60):  # pairs at the threshold and just below
        v = rng.normal(size=dim)
        v -= (v @ base) * base
        v /= np.linalg.norm(v)
        for a in (0.0, edge - 0.002, edge + 0.002):
            x.append(math.cos(a) * base + math.sin(a) * v)
    tight, wide = unit(2)
    x += [*around(rng, tight, 0.05, 250), *around(rng, tight, 0.2, 120), *around(rng, wide, 0.36, 150)]
    x += [tight] * 40 + [3.5 * tight, 1e-30 * tight, 1e30 * tight]
    rows = [(int(k), [float(c) for c in v]) for k, v in zip(rng.permutation(len(x)) * 3, x, strict=True)]
    rows += [(None, rows[0][1]), (1, None), (4, []), (7, [0.0] * dim), (10, [float("nan")] * dim), (13, [float("inf"), *[0.0] * (dim - 1)]), (16, [None, *[1.0] * (dim - 1)]), rows[0], (rows[1][0], rows[2][1]), (19, [-0.0, *tight[1:].tolist()]), (22, tight[:3].tolist())]
    assert got(spark, rows) == plain(rows)


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (None, None), (3, [0.0])]) == sorted([(1, 0, 1, True), (None, 0, None, True), (3, 0, 3, True)], key=str)
    assert got(spark, [(5, [2.0])]) == [(5, 0, 5, True)]


def test_open_balls_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 8)
    rng = np.random.default_rng(1)
    centre = np.eye(24)[0]
    x = [*around(rng, centre, 0.12, 200), *around(rng, centre + 0.45 * np.eye(24)[1], 0.12, 200)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    want = plain(rows)
    assert got(spark, rows) == want and len({n for _, n, _, _ in want}) > 50


def test_decode_gives_the_nearest_point():
    x = np.random.default_rng(2).normal(size=(3000, 8)) * 3
    p = lattice.decode(x)
    doubled = np.rint(2 * p).astype(int)
    assert np.array_equal(doubled, 2 * p) and ((doubled % 2 == doubled[:, :1] % 2).all()) and (np.rint(p.sum(1)) % 2 == 0).all()
    off = ((x - p) ** 2).sum(1)
    assert off.max() <= 1 + 1e-9  # the covering radius
    for step in lattice.STEPS:
        assert (((x - p - step) ** 2).sum(1) >= off - 1e-9).all()


def test_probed_cells_are_their_neighbours_own():
    t = lattice.Table.make(24, 2, 3)
    x = np.random.default_rng(4).normal(size=(400, 24)) / 5
    keys = t.cells(x, 4)
    assert keys.shape == (400, 5) and np.array_equal(keys[:, :1], t.cells(x)) and all(len(set(k)) == 5 for k in keys.tolist())
    point = lattice.decode((x @ t.turn + t.shift).reshape(-1, 8)).reshape(400, 2, 8)
    seen = {k for k in keys[0, 1:].tolist()}
    made = set()
    for step in [np.zeros(8), *lattice.STEPS]:
        for j in (0, 1):
            q = point[0].copy()
            q[j] += step
            made.add(int(((2 * q).astype(np.int64).astype(np.uint64) * t.weight).sum(dtype=np.uint64).view(np.int64)))
    assert len(seen & made) >= 3  # single steps; a fourth may be a double one


def test_number_of_tables_follows_the_angle():
    near, far = (lattice.tables_needed(64, 64, 3, a) for a in (0.2, math.acos(0.9)))
    assert near < far < 60
