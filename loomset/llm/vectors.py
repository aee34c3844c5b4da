"""Near-duplicate vectors by lattice hashing: projections decoded to E8 points, neighbouring cells probed, cosines verified.

1. Rows with the same label and the very same components are one class; a class of any size is one row from here on.
2. Each of TABLES random projections takes a unit vector to 8 dimensions, scaled to the distance of the threshold. Its
   nearest E8 point is its home cell; it also visits all cells whose point is within RADIUS. Only keys,
   class numbers and 16-byte sketches are dealt out. Homes of a cell are compared with its visitors by sketch, and what has
   no possible partner there goes no further.
3. The rest gets its vectors, and cosines are computed in double precision. Full cells are cut into
   blocks, so that no cell is one task; pairs are counted where they are found and never leave the task: what
   leaves is a number of links and one tie to a neighbour for each row. A pair that several tables find is counted in the first.
4. Ties are joined into components; a class's members share its links and have each other.

For two vectors right at the threshold one table fails to bring them together about once in 100 times, all tables
about once in a million (found by simulation); nearer vectors far less often. No cell is capped.

Vectors that are null, empty or zero, that hold null or non-finite components, or have no label or no vec_id link with nothing.
Rows that repeat a vec_id are vectors of their own. Vectors with different lengths are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm import lattice
from loomset.llm.common import by_key, discard, keep
from loomset.llm.components import components
from loomset.llm.textarray import WORD_BASE, mix

COSINE = 0.98
TABLES = 3
RADIUS = 1.1
#: Lattice scale in units of the distance that the threshold allows.
SCALE = 6.0
#: Squared distance of sketches that such a distance exceeds about once in 10**8 times, in units of its square.
SKETCH_LIMIT = 80.0
SKETCH, STEPS = 16, 16.0
#: Homes and visitors that are compared in one piece.
HOMES, VISITORS = 512, 2048


def _projection(dims: int, columns: int, seed: int) -> np.ndarray:
    return np.random.default_rng([20_240_611, dims, seed]).normal(size=(dims, columns))


def _project(units: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """units @ matrix, summed in one order so that a row's result doesn't depend on the other rows."""
    out = np.zeros((len(units), matrix.shape[1]))
    for k in range(units.shape[1]):
        out += units[:, k : k + 1] * matrix[k]
    return out


def _units(column: pa.Array) -> np.ndarray:
    """Unit vectors of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt((flat**2).sum(1, keepdims=True))


def _places(units: np.ndarray, table: int, scale: float) -> np.ndarray:
    return _project(units, _projection(units.shape[1], 8, table)) / scale


def _cells(points: np.ndarray, label: np.ndarray, table: int, dims: int) -> np.ndarray:
    key = mix(label.astype(np.int64).view(np.uint64) * np.uint64(WORD_BASE) + np.uint64(table * 100_003 + dims))
    for k in range(8):
        key = mix(key * np.uint64(WORD_BASE) + np.rint(points[:, k] * 2).astype(np.int64).view(np.uint64))
    return key.view(np.int64)


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the hashes of their class, classes: cls, rep, many, label, vector)."""
    components_ = F.col("embedding").cast("array<double>")
    finite = F.forall(components_, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(components_, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), components_.alias("vector"), usable.alias("usable"))
    rows = rows.select("vec_id", "label", "vector", *(F.when(F.col("usable"), F.xxhash64(F.lit(i), "vector")).alias(h) for i, h in enumerate(("one", "two"))))
    classes = rows.filter("one IS NOT NULL").groupBy("label", "one", "two").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"), F.first("vector").alias("vector"))
    return rows.drop("vector"), keep(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")


def _visits(classes: DataFrame, tables: int, scale: float) -> DataFrame:
    """cell, probe (which table), cls, home and sketch: one row for each cell that a class visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.diff(whole.column("vector").offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                rows = whole.filter(pa.array(sizes == dims))
                for at in range(0, rows.num_rows, 1024):
                    part = rows.slice(at, 1024)
                    units = _units(part.column("vector"))
                    label, cls = (part.column(c).to_numpy() for c in ("label", "cls"))
                    sketch = np.clip(np.rint(_project(units, _projection(dims, SKETCH, 1_000)) * STEPS), -127, 127).astype(np.int8)
                    sketch = [s.tobytes() for s in sketch]
                    for table in range(tables):
                        places = _places(units, table, scale)
                        home = lattice.decode(places)
                        row, point = lattice.near(places, RADIUS)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(_cells(point, label[row], table, dims)), pa.array(np.full(len(row), table), pa.int32()), pa.array(cls[row]), pa.array((home[row] == point).all(1)), pa.array([sketch[i] for i in row.tolist()], pa.binary())],
                            ["cell", "probe", "cls", "home", "sketch"],
                        )

    return classes.select("label", "cls", "vector").mapInArrow(run, "cell long, probe int, cls long, home boolean, sketch binary")


def _blocks(visits: DataFrame) -> DataFrame:
    """Rows of cells that have a home and someone else, dealt into blocks in which every home meets every visitor once."""
    cells = visits.groupBy("cell").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count(F.lit(1)).alias("all")).filter("homes >= 1 AND all >= 2")
    rows = visits.join(cells.select("cell", F.ceil(F.col("homes") / HOMES).cast("int").alias("across"), F.ceil(F.col("all") / VISITORS).cast("int").alias("down")), "cell")
    spot = F.xxhash64("cls", F.lit(7))
    as_home = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda d: F.struct(F.pmod(spot, F.col("across")).cast("int").alias("x"), d.alias("y"), F.lit(True).alias("at_home"))))
    as_visitor = F.transform(F.sequence(F.lit(0), F.col("across") - 1), lambda x: F.struct(x.alias("x"), F.pmod(spot, F.col("down")).cast("int").alias("y"), F.lit(False).alias("at_home")))
    both = F.concat(F.coalesce(as_home, F.array().cast("array<struct<x:int,y:int,at_home:boolean>>")), as_visitor)
    rows = rows.select("cell", "probe", "cls", "sketch", F.explode(both).alias("b"))
    return rows.select(F.xxhash64("cell", "b.x", "b.y").alias("block"), "probe", "cls", F.col("b.at_home").alias("at_home"), "sketch")


def _possible(blocks: DataFrame, limit: float) -> DataFrame:
    """Rows of blocks that have a partner by sketch."""

    def run(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        at_home = table.column("at_home").to_numpy(zero_copy_only=False)
        cls = table.column("cls").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.int8).reshape(len(cls), SKETCH).astype(np.float32) / STEPS
        h, v = np.flatnonzero(at_home), np.flatnonzero(~at_home)
        if not len(h) or not len(v):
            return
        squared = (sketch**2).sum(1)
        hit = squared[h][:, None] + squared[v][None] - 2 * sketch[h] @ sketch[v].T <= limit
        hit &= cls[h][:, None] != cls[v][None]
        take = np.zeros(len(cls), bool)
        take[h], take[v] = hit.any(1), hit.any(0)
        found = table.filter(pa.array(take)).select(["block", "probe", "cls", "at_home"])
        yield from found.combine_chunks().to_batches()

    return by_key(blocks, "block", [], run, "block long, probe int, cls long, at_home boolean")


def _near(home: np.ndarray, place: np.ndarray) -> np.ndarray:
    return ((home - place) ** 2).sum(1) <= RADIUS * RADIUS


def _linked(rows: DataFrame, cosine: float, scale: float) -> DataFrame:
    """cls, one of the classes that it is tied to in its block (or itself), and how many vectors it is linked with, counted here alone."""

    def run(block: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        vectors = table.column("vector").combine_chunks()
        size = np.diff(vectors.offsets.to_numpy())
        if (size != size[0]).any():  # two cells with one hash
            for dims in np.unique(size).tolist():
                yield from run(block, table.filter(pa.array(size == dims)))
            return
        units = _units(vectors)
        at_home = table.column("at_home").to_numpy(zero_copy_only=False)
        cls, many, label, probe = (table.column(c).to_numpy() for c in ("cls", "many", "label", "probe"))
        h, v = np.flatnonzero(at_home), np.flatnonzero(~at_home)
        if not len(h) or not len(v):
            return
        dot = units[h] @ units[v].T
        close = np.argwhere(np.abs(dot - cosine) < 1e-9)
        for i, j in close.tolist():
            dot[i, j] = float((units[h[i]] * units[v[j]]).sum())
        mask = (dot >= cosine) & (cls[h][:, None] != cls[v][None]) & (label[h][:, None] == label[v][None])
        i, j = np.nonzero(mask)
        if not len(i):
            return
        last = int(probe.max())
        places = [_places(units, t, scale) for t in range(last + 1)]
        homes = [lattice.decode(p) for p in places]
        new = np.zeros(len(i), bool)
        for at in range(0, len(i), 65_536):
            a, b = h[i[at : at + 65_536]], v[j[at : at + 65_536]]
            swap = cls[a] > cls[b]
            lo, hi = np.where(swap, b, a), np.where(swap, a, b)
            now = probe[a]
            # a pair belongs to the first (table, direction) in which it meets; the lesser class's home is the first direction
            here = np.ones(len(a), bool)
            for t in range(last + 1):
                first, second = _near(homes[t][lo], places[t][hi]), _near(homes[t][hi], places[t][lo])
                here &= ~((now > t) & (first | second))
                here &= ~((now == t) & np.where(swap, first | ~second, ~first))
            new[at : at + 65_536] = here
        counts = np.zeros(len(cls), np.int64)
        np.add.at(counts, h[i[new]], many[v[j[new]]])
        np.add.at(counts, v[j[new]], many[h[i[new]]])
        tie = cls.copy()
        while True:
            before = tie.copy()
            np.minimum.at(tie, h[i], before[v[j]])
            np.minimum.at(tie, v[j], before[h[i]])
            if (tie == before).all():
                break
        out = np.unique(np.concatenate([h[i], v[j]]))
        yield pa.RecordBatch.from_arrays([pa.array(cls[out]), pa.array(tie[out]), pa.array(counts[out])], ["cls", "tie", "n"])

    return by_key(rows, "block", [], run, "cls long, tie long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row. vectors: vec_id, embedding (array of numbers), label (whole number)."""
    squared = max(2 - 2 * cosine, 1e-6)
    scale = SCALE * squared**0.5
    rows, classes = _classes(vectors)
    visits = keep(_visits(classes, tables, scale), "visits")
    possible = keep(_possible(_blocks(visits), squared * SKETCH_LIMIT), "possible")
    discard(visits)
    told = keep(_linked(possible.join(classes.select("cls", "many", "label", "vector"), "cls"), cosine, scale), "linked")
    discard(possible)
    counts = told.groupBy("cls").agg(F.sum("n").alias("n"))
    parts = components(told.select(F.col("cls").alias("a"), F.col("tie").alias("b")).distinct()).withColumnsRenamed({"node": "cls"})
    named = classes.select("cls", "rep").join(parts, "cls")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    facts = classes.select("cls", "rep", "many", "label", "one", "two").join(counts, "cls", "left").join(named.join(least, "component").select("cls", "least"), "cls", "left")
    facts = facts.select("label", "one", "two", (F.col("many") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    found = rows.join(facts, ["label", "one", "two"], "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
