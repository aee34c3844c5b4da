from collections import Counter, defaultdict

import numpy as np
from loomset.llm import lattice, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_lattice_points():
    shells = lattice.offsets()
    assert Counter((shells**2).sum(1).tolist()) == {0: 1, 2: 240, 4: 2160}
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 3
    home = lattice.decode(x)
    assert ((x - home) ** 2).sum(1).max() <= lattice.COVERING_RADIUS**2 + 1e-9
    # no neighbour is nearer
    for a, h in zip(x, home, strict=True):
        assert ((a - h) ** 2).sum() <= (((a - h - shells) ** 2).sum(1)).min() + 1e-9
    row, point = lattice.near(x, 1.1)
    assert (((x[row] - point) ** 2).sum(1) <= 1.21).all() and set(range(300)) == set(row.tolist())


def brute(rows):
    usable = defaultdict(list)
    for i, v, label in rows:
        if i is not None and label is not None and v and all(z is not None and np.isfinite(z) for z in v) and any(v):
            usable[(label, len(v))].append((i, v))
    links, parent = Counter(), {i: i for i, _, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for group in usable.values():
        m = np.array([v for _, v in group], float)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        for a, b in np.argwhere(m @ m.T >= 0.98):
            if a < b:
                x, y = group[a][0], group[b][0]
                links[x] += 1
                links[y] += 1
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], root(i)) for i in parent}


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 64))
    centre = rng.normal(size=64)
    made = [(v, k % 5) for k, v in enumerate(base)]
    made += [(centre + rng.normal(size=64) * rng.uniform(0.05, 0.2), k % 2) for k in range(700)]
    made += [(base[k % 50] + rng.normal(size=64) * 0.16, k % 50 % 5) for k in range(300)]
    made += [(base[7], 2)] * 150
    rows = [(i, [float(z) for z in np.float32(v)], label) for i, (v, label) in enumerate(made)]
    first = rows[0][1]
    rows += [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [1.0, None] * 32, 1), (9003, [float("nan")] * 64, 1), (9004, first, None), (9005, first, 0), (9006, [2.0 * z for z in first], 0), (9007, [1.0, 2.0], 0), (9008, [1.0, 2.0], 0), (9009, [], 0)]
    frame = spark.createDataFrame([*rows, (None, first, 0)], SCHEMA)
    found = vectors.near_duplicates(frame).collect()
    assert len(found) == len(rows) + 1
    lone = next(r for r in found if r["vec_id"] is None)
    assert (lone["n_links"], lone["component_id"], lone["kept"]) == (0, None, True)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found if r["vec_id"] is not None} == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found if r["vec_id"] is not None)


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], SCHEMA)
    assert {r["n_links"] for r in vectors.near_duplicates(alone).collect()} == {0}


def test_pairs_at_the_threshold_share_cells():
    """Of 20,000 pairs right at the cosine about one in 100 meets in no cell of one table, and none in no cell of all three."""
    rng = np.random.default_rng(8)
    left = rng.normal(size=(20_000, 64))
    left /= np.linalg.norm(left, axis=1, keepdims=True)
    aside = rng.normal(size=left.shape)
    aside -= (aside * left).sum(1, keepdims=True) * left
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    right = vectors.COSINE * left + np.sqrt(1 - vectors.COSINE**2) * aside
    scale = vectors.SCALE * np.sqrt(2 - 2 * vectors.COSINE)
    missed = []
    for table in range(vectors.TABLES):
        a, b = (vectors._places(x, table, scale) for x in (left, right))
        home_a, home_b = lattice.decode(a), lattice.decode(b)
        meets = (((a - home_b) ** 2).sum(1) <= vectors.RADIUS**2) | (((b - home_a) ** 2).sum(1) <= vectors.RADIUS**2)
        missed.append(~meets)
    assert all(m.mean() < 0.03 for m in missed) and not np.logical_and.reduce(missed).any()


def test_repeated_ids_and_clashing_columns(spark):
    """Rows of one id are vectors of their own, copies or not; other columns are not read."""
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, one, 0, "x", 1), (1, one, 0, "y", 1), (1, two, 0, None, 1), (2, two, 0, "z", 1), (2, two, 1, "z", 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cls string, component_id int")
    found = vectors.near_duplicates(frame)
    assert sorted(found.columns) == ["component_id", "kept", "n_links", "vec_id"]
    assert sorted((r["vec_id"], r["n_links"]) for r in found.collect()) == [(1, 1), (1, 1), (1, 1), (2, 0), (2, 1)]
