"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors form a class with a weight.  Each tree halves the classes again and again along random
directions, and vectors within a margin of a split go both ways.  The first levels of a tree have a
direction per node and split at the median of a bounded sample (the SAMPLE vectors with the smallest
hashes of vec_id); deeper levels, which only a larger corpus needs, have one direction per level and
split at zero.  The number of levels follows the number of classes, so leaves keep their size.

A node of a tree is cut where the fewest vectors of the sample lie within the margin; one in which MOST_BOTH would go
both ways wherever it is cut is not split any more, so a dense group does not multiply.

Dense groups are taken out first: a core is a ball so narrow that any two vectors in it are as near as
asked, whatever their places in it.  Its members need no comparison with each other; they count each
other's weights.  Cores are found in the sample (at most CORES of them, with CORE vectors of the sample each; a
group that is missed is compared like others), and the trees are fitted to the rest of the sample.

Within a leaf all other pairs are compared by cosine: in single precision first, and in double precision where
that is too close to the threshold to tell.  A leaf is cut into chunks of vectors outside cores and chunks of
each core, and each pair of chunks but those of one core, or of cores too far apart, is a task of its own, which
holds a block of the pairs at a time.  A pair that meets in several leaves is counted in the first one only: tasks find the leaves of
linked vectors anew from the trees, so what travels to a leaf is the vector as it was given, and no pair
ever becomes a row.  Tasks return link counts, and edges to the root of each local component.

A vector of 64 numbers lies in about 14 leaves among 50 thousand classes and in 22 among a million; two at
a cosine of 0.9 miss each other in all of them with a probability under 0.01.

Null, zero and ragged vectors are kept: a vector links only with those of its own length, and one that
is null, empty or zero or that holds a null or non-finite number links with nothing.  Rows that share a
vec_id are counted one by one.  Columns other than vec_id and embedding are not read, so their names cannot
clash.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.tables import drop, store

TREES = 6
LEAF = 512
CHUNK = 4096
#: Rows of a chunk that are compared with the other chunk at once.
BLOCK = 512
SAMPLE = 20_000
#: Levels with a direction and a median of their own for every node.
FITTED_LEVELS = 9
#: A core has so many vectors of the sample at least, and there are so many cores at most.
CORE = 16
CORES = 1024
CORE_SHIFT = 32
#: Places of a cut that are tried, as shares of a node's vectors that lie before it.
CUTS = (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8)
#: A node is not split where more than this share of its vectors would go both ways, and cut elsewhere than in the middle beyond half of it.
MOST_BOTH = 0.35
#: Half the width, in units of a random projection's deviation, within which a vector goes both ways.
MARGIN = 0.16


@dataclass
class Forest:
    """directions[tree][node] and cuts[tree][node] in heap order, and directions of deeper levels."""

    directions: np.ndarray
    cuts: np.ndarray
    deeper: np.ndarray
    margin: float
    #: Whether nodes of the last fitted level are split further.
    split: np.ndarray

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs, in order of the rows; leaf numbers differ between trees."""
        rows, found = [], []
        for tree in range(len(self.directions)):
            row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            fitted = int(np.log2(self.directions.shape[1] + 1))
            further = np.zeros(0, bool)
            for level in range(fitted + self.deeper.shape[1]):
                if level < fitted:
                    at = np.einsum("ij,ij->i", x[row], self.directions[tree, node]) - self.cuts[tree, node]
                else:
                    if level == fitted:
                        further = self.split[tree, node - ((1 << fitted) - 1)]
                    at = np.einsum("ij,j->i", x[row], self.deeper[tree, level - fitted])  # the same for a row in any batch
                    at = np.where(further, at, -np.inf)
                left, right = at <= self.margin, at >= -self.margin
                further = np.concatenate((further[left], further[right])) if level >= fitted else further
                row = np.concatenate((row[left], row[right]))
                node = np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
            rows.append(row)
            found.append((tree << 56) + node)
        row, leaf = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def grow(sample: np.ndarray, classes: int, dim: int, trees: int = TREES, leaf: int = LEAF) -> Forest:
    """Trees for so many classes, their first levels fitted to a sample of unit vectors."""
    levels = max(0, int(np.ceil(np.log2(max(classes, 1) / leaf))))
    fitted = min(levels, FITTED_LEVELS)
    draw = np.random.default_rng(20_260)
    directions = draw.normal(size=(trees, (1 << fitted) - 1, dim))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    cuts = np.zeros(directions.shape[:2])
    split = np.ones((trees, 1 << fitted), bool)
    margin = MARGIN / np.sqrt(dim)
    for tree in range(trees):
        held = {0: (sample, True)}
        for node in range(directions.shape[1]):
            own, further = held.pop(node)
            at = own @ directions[tree, node]
            cuts[tree, node], further = _cut(at, margin) if further else (np.inf, False)
            side = at <= cuts[tree, node]
            held[2 * node + 1], held[2 * node + 2] = (own[side], further), (own[~side], further)
        for node, (_, further) in held.items():
            split[tree, node - directions.shape[1]] = further
    deeper = draw.normal(size=(trees, levels - fitted, dim))
    deeper /= np.linalg.norm(deeper, axis=2, keepdims=True) if deeper.size else 1
    return Forest(directions, cuts, deeper, margin, split)


def _cut(at: np.ndarray, margin: float) -> tuple[float, bool]:
    """Where to split a node, and whether to: not where most of its vectors would go both ways."""
    if not len(at):
        return 0.0, True
    places = np.quantile(at, CUTS)
    both = (np.abs(at[:, None] - places) <= margin).mean(0)
    best = int(both.argmin()) if 2 * both[0] > MOST_BOTH else 0
    return (float(places[best]), True) if both[best] <= MOST_BOTH or len(at) < 8 else (np.inf, False)


def cores(sample: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres of dense groups among unit vectors, and which of the vectors lie within one.

    All vectors with this cosine to a centre are at least as near as the threshold to each other, as half the
    angle is kept to the centre.
    """
    near = core_cosine(threshold)
    free = np.ones(len(sample), bool)
    x = sample.astype(np.float32)
    around = np.concatenate([(x[a : a + 2048] @ x.T >= threshold).sum(1) for a in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)
    centres: list[np.ndarray] = []
    tried = 0
    for i in np.argsort(-around, kind="stable"):
        if around[i] < CORE or len(centres) == CORES or tried == 2 * CORES:
            break
        if not free[i]:
            continue
        tried += 1
        mine = free & (sample @ sample[i] >= threshold)
        for _ in range(2):
            centre = sample[mine].mean(0)
            centre /= np.linalg.norm(centre)
            mine = free & (sample @ centre >= near)
            if mine.sum() < CORE:
                break
        else:
            centres.append(centre)
            free &= ~mine
    return np.array(centres).reshape(-1, sample.shape[1]), ~free


def core_cosine(threshold: float) -> float:
    """The cosine to a centre from which on two vectors are surely as near as the threshold."""
    return float(np.cos(np.arccos(np.clip(threshold, -1, 1)) / 2)) + 1e-7


def _unit(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """Unit vectors; scaled by their largest components first, so that no square overflows or vanishes."""
    x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _place(shared, centres, dim: int, threshold: float):
    """Leaves of vectors, and the core that a vector is in, or -1."""
    near = core_cosine(threshold)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                x = _unit(part, dim)
                cosine = np.einsum("ij,kj->ik", x, centres.value)
                core = np.where(cosine.max(1) >= near, cosine.argmax(1), -1) if cosine.shape[1] else np.full(len(x), -1)
                row, leaf = forest.leaves(x)
                yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(row)), pa.array(leaf), pa.array(core[row].astype(np.int64))], ["rep", "leaf", "core"])

    return place


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of unit vectors have that cosine, as in double precision."""
    cosine = x.astype(np.float32) @ y.astype(np.float32).T
    near = cosine >= threshold
    close = np.abs(cosine - threshold) <= 1e-6 * np.sqrt(x.shape[1]) + 1e-6
    a, b = np.nonzero(close)
    for i in range(0, len(a), 65_536):
        some = slice(i, i + 65_536)
        near[a[some], b[some]] = np.einsum("ij,ij->i", x[a[some]], y[b[some]]) >= threshold
    return near


class _Leaves:
    """Leaves before a given one, of some vectors: to tell whether two meet in an earlier leaf."""

    def __init__(self, forest: Forest, x: np.ndarray, leaf: int):
        row, found = forest.leaves(x)
        early = found < leaf
        row, found = row[early], found[early]
        known, place, count = np.unique(found, return_inverse=True, return_counts=True)
        use = count[place] > 1  # a leaf of one vector is shared by none
        self.row, self.column, self.width = row[use], (np.cumsum(count > 1) - 1)[place[use]], int((count > 1).sum())
        self.first = np.searchsorted(self.row, np.arange(len(x) + 1))

    def shared(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Whether each of rows and each of others have an earlier leaf in common."""
        out = np.zeros((len(rows), len(others)), bool)
        for low in range(0, self.width, 1024):
            a, b = (self._table(r, low) for r in (rows, others))
            if a is not None and b is not None:
                out |= a @ b.T > 0
        return out

    def _table(self, rows: np.ndarray, low: int) -> np.ndarray | None:
        each = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - np.cumsum(each) + each, each) + np.arange(each.sum())
        column, row = self.column[at] - low, np.repeat(np.arange(len(rows)), each)
        own = (column >= 0) & (column < 1024)
        if not own.any():
            return None
        out = np.zeros((len(rows), min(1024, self.width - low)), np.float32)
        out[row[own], column[own]] = 1
        return out


def _compare(shared, threshold: float, dim: int):
    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        leaf, first, second = (k.as_py() for k in key)
        x = np.concatenate([_unit(b, dim) for b in table.to_batches()])
        ids, weight, chunk = (table.column(c).to_numpy() for c in ("rep", "weight", "chunk"))
        # Rows of one chunk compare with each other; those of two chunks only across.
        left = np.flatnonzero(chunk == first)
        right = np.flatnonzero(chunk == second)
        blocks = []  # (rows of left, columns of right, links between them as packed bits)
        for i in range(0, len(left), BLOCK):
            rows = left[i : i + BLOCK]
            near = _near(x[rows], x[right], threshold) & (ids[rows][:, None] != ids[right][None, :])
            a, b = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if len(a):
                blocks.append((rows[a], right[b], np.packbits(near[np.ix_(a, b)], axis=1)))
        if not blocks:
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        linked = np.unique(np.concatenate([r for a, b, _ in blocks for r in (a, b)]))
        leaves = _Leaves(shared.value, x[linked], leaf)
        links, label = np.zeros(len(ids), np.int64), ids.copy()
        while True:
            before = label.copy()
            for a, b, bits in blocks:
                link = np.unpackbits(bits, axis=1, count=len(b)).astype(bool)
                most = np.iinfo(np.int64).max
                label[a] = np.minimum(label[a], np.where(link, label[b][None, :], most).min(1))
                label[b] = np.minimum(label[b], np.where(link, label[a][:, None], most).min(0))
            if (label == before).all():
                break
        for a, b, bits in blocks:
            link = np.unpackbits(bits, axis=1, count=len(b)).astype(bool)
            link &= ~leaves.shared(np.searchsorted(linked, a), np.searchsorted(linked, b))
            links[a] += link @ weight[b]
            if first != second:
                np.add.at(links, b, weight[a] @ link)
        return pa.table({"id": pa.array(ids[linked]), "links": pa.array(links[linked]), "root": pa.array(label[linked])})

    return compare


def near_embeddings(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors."""
    kind = vectors.schema["embedding"].dataType
    given = kind.elementType.simpleString() if kind.typeName() == "array" else "double"
    # Vectors travel as they were given, floats or doubles.
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{given if given == 'float' else 'double'}>").alias("embedding"))
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    good = rows.filter(usable)
    classes = store(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "classes")
    # Lengths of vectors, a handful in any real table.
    sizes = classes.groupBy(F.size("embedding").alias("dim")).count().collect()
    placed_tables: list[DataFrame] = []
    found = [_links(classes.filter(F.size("embedding") == r.dim), r["count"], r.dim, threshold, placed_tables) for r in sizes]
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    links = store(links, "links")
    for table in placed_tables:
        drop(table)
    tied = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    each = links.groupBy("id").agg(F.sum("links").alias("links"))
    named = (
        classes.join(each, F.col("rep") == each.id, "left").drop("id").join(tied, F.col("rep") == F.col("id"), "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    placed = good.join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = store(placed.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "near_embeddings")
    for table in (classes, links, tied):
        drop(table)
    return out


def _links(classes: DataFrame, count: int, dim: int, threshold: float, tables: list[DataFrame]) -> DataFrame:
    """(id, links, root) rows of all leaves: partial link counts and edges to local roots."""
    spark = classes.sparkSession
    # A sample of fixed size.
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow().to_batches() if count else []
    fit = np.concatenate([_unit(b, dim) for b in sample]) if sample else np.zeros((0, dim))
    centres, dense = cores(fit, threshold) if len(fit) else (np.zeros((0, dim)), np.zeros(0, bool))
    shared = spark.sparkContext.broadcast(grow(fit[~dense], count, dim))
    told = spark.sparkContext.broadcast(centres)
    entries = store(classes.select("rep", "embedding").mapInArrow(_place(shared, told, dim, threshold), "rep long, leaf long, core long"), "leaves")
    tables.append(entries)
    # Chunks have numbers: from 0 outside cores, from (core + 1) << CORE_SHIFT in a core.
    counts = entries.groupBy("leaf", "core").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("long"))
    first = F.shiftleft(F.col("core") + 1, CORE_SHIFT)
    numbers = counts.select("leaf", "n", F.sequence(first, first + F.col("chunks") - 1).alias("numbers"))
    leaves = numbers.groupBy("leaf").agg(F.sum("n").alias("size"), F.flatten(F.collect_list("numbers")).alias("others")).filter("size > 1").select("leaf", "others")
    # CORES rows at most.
    apart = centres @ centres.T < np.cos(min(np.pi, 2 * np.arccos(core_cosine(threshold)) + np.arccos(threshold))) - 1e-6
    near = spark.createDataFrame([(k, [int(i) for i in np.flatnonzero(~apart[k]) if i != k]) for k in range(len(centres))], "core long, near array<long>")
    placed = entries.join(counts.select("leaf", "core", "chunks"), ["leaf", "core"]).join(leaves, "leaf").join(F.broadcast(near), "core", "left")
    own = F.shiftleft(F.col("core") + 1, CORE_SHIFT) + F.pmod(F.xxhash64("rep"), F.col("chunks"))
    other = F.explode(F.filter("others", lambda o: (F.col("core") < 0) | (o < 1 << CORE_SHIFT) | F.array_contains("near", F.shiftright(o, CORE_SHIFT) - 1)))
    paired = placed.select("leaf", "rep", own.alias("chunk"), other.alias("other"))
    tasks = paired.select("leaf", "rep", "chunk", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second")).join(classes, "rep")
    compared = tasks.groupBy("leaf", "first", "second").applyInArrow(_compare(shared, threshold, dim), "id long, links long, root long")
    # Within a core every two classes are linked.
    members = entries.filter("core >= 0").select("rep", "core").distinct().join(classes.select("rep", "weight"), "rep")
    cored = members.groupBy("core").agg(F.sum("weight").alias("total"), F.min("rep").alias("root"))
    return compared.unionByName(members.join(F.broadcast(cored), "core").select(F.col("rep").alias("id"), (F.col("total") - F.col("weight")).alias("links"), "root"))  # CORES rows at most
