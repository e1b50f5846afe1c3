"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct shingles of five words.  Documents with one and the same set are a
class.  A signature of SIGNATURE minwise tokens of the set decides the paths: in each of TREES independent
trees a class goes down the nodes named by its tokens at one or two positions (1 / threshold of them on
average, drawn by the tree or the node, not by the class), so similar sets are likely to go down together.

A node that is small (at most NODE classes) is compared exhaustively within one task, first by signatures,
which leaves the clusters of its classes that may be similar, and then by full sets: one class is compared
with all others at once, the most typical one first, and classes of one component need no further
comparison with each other.  Nodes and clusters give a row per class, never one per pair.

A large node, or a cluster with more than LOAD shingles, is compared with one typical class, its pivot; what
the pivot reaches is one component.  If few classes are left beyond it, they are compared with all of the
node, dealt in parts; else the node branches by further tokens.  After DEPTH levels its parts are compared
pair by pair of parts, so no node is too large to be finished.

Recall: two sets at the threshold go through the same small node of some tree but with probability 1e-9 if
their first nodes are small, 4e-4 after five further levels and 1e-2 after ten; signatures agree in too
few places (under half, where three quarters are expected) with probability 1e-5.  Links are confirmed on
full sets.

A document with fewer than five words has one shingle, the whole sequence; one without words or with a
null text has none and is like no other.  Texts count whole, whatever their length.  Rows with a null
doc_id are not linked.  Rows that share a doc_id are told apart by their texts: each gets the component of
its own text.  Columns of docs other than doc_id and text are not read, so their names cannot clash.  An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.tables import drop, store
from tessera.llm.text import U64, gram_starts, grams, mix, slices, split, whole_groups

SHINGLE = 5
SIGNATURE = 64
TREES = 12
#: Small nodes have at most so many classes; what is compared on full sets has so many shingles, unless it has FEW classes.
NODE = 16_384
LOAD = 4 << 20
FEW = 16
#: Levels after which what is still large is compared part by part.
DEPTH = 24
#: Signatures that agree in fewer places than this share are not compared further.
LEAST_AGREEMENT = 0.5
#: Shingles that are compared at once.
BLOCK = 1 << 18
#: Bits of the filter of texts that are compared in full.
FILTER_BITS = 1 << 26
#: Classes of a large node among which its pivot is chosen.
CANDIDATES = 32

_SALTS = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
#: Each tree's first positions: one in two of three trees, two in the third, 4/3 on average.
_ROOTS = np.random.default_rng(1_000).permutation(SIGNATURE)[: TREES + TREES // 3]


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts with repeats, and where each text's begin."""
    words = split(texts)
    hashes = words.hashes(lower=True)
    counts = words.counts
    starts = gram_starts(words, SHINGLE)
    long = grams(hashes, SHINGLE)[starts] if len(starts) else np.zeros(0, U64)
    size = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(first[-1], U64)
    whole = np.repeat(counts >= SHINGLE, size)
    out[whole] = long
    for n in range(1, SHINGLE):
        short = np.flatnonzero(counts == n)
        if len(short):
            out[first[short]] = grams(hashes, n)[words.first[short]]
    return out, first


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin."""
    found, first = shingles(texts)
    found = found.copy()
    keep = np.ones(len(found), bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        found[a:b].sort()
    keep[1:] = found[1:] != found[:-1]
    keep[first[:-1][first[:-1] < len(found)]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return found[keep], total[first]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set sizes, 128-bit set hashes, first nodes of all trees, and a byte of every token."""
    for batch in batches:
        for part in slices(batch, "text"):
            found, first = sets(part.column("text"))
            size = np.diff(first)
            some = np.flatnonzero(size)
            at = first[:-1][some]
            high, low = np.zeros(len(size), U64), np.zeros(len(size), U64)
            roots = np.zeros((len(size), len(_ROOTS)), U64)
            sketch = np.zeros((len(size), SIGNATURE), np.uint8)
            if len(some):
                high[some] = np.add.reduceat(mix(found), at)
                low[some] = np.add.reduceat(mix(found ^ U64(0xA0761D6478BD642F)), at)
                where = {int(p): i for i, p in enumerate(_ROOTS)}
                for k, salt in enumerate(_SALTS):
                    token = found ^ salt
                    token *= U64(0xD6E8FEB86659FD93)
                    token ^= token >> U64(32)
                    least = np.minimum.reduceat(token, at)
                    sketch[some, k] = mix(least)
                    if k in where:
                        roots[some, where[k]] = mix(least + U64(k))
            n = part.num_rows
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(_ROOTS), pa.int32()), pa.array(roots.reshape(-1).view(np.int64)))
            bytes_ = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * SIGNATURE).astype(np.int32)), pa.py_buffer(sketch)])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(size.astype(np.int64)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), lists, bytes_], ["doc_id", "text_key", "n_shingles", "high", "low", "roots", "sketch"])


def _connect(score: np.ndarray, linked: Callable[[int], np.ndarray]) -> np.ndarray:
    """Component labels of some members; linked(i) tells which of all members are linked with member i.

    The members with the highest scores are asked first.  All but those of the largest component are
    asked in the end, so every pair of members of different components was compared.
    """
    label = np.arange(len(score))
    asked = np.zeros(len(score), bool)
    order = np.argsort(-score, kind="stable")
    largest = -1
    while True:
        left = order[~asked[order] & (label[order] != largest)]
        if not len(left):
            return label
        i = left[0]
        asked[i] = True
        touched = np.unique(label[linked(i)])
        touched = touched[touched != label[i]]
        if len(touched):
            label[np.isin(label, touched)] = label[i]
        largest = np.bincount(label).argmax()


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys begin and end."""
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    return cut[:-1], cut[1:]


def _screen(percent: int):
    """Clusters of each node's classes whose sizes and signatures allow the similarity.

    A cluster is a node named by its classes, so that the same cluster of several nodes is one.
    """
    least = int(np.ceil(LEAST_AGREEMENT * SIGNATURE))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            cid, n = table.column("cid").to_numpy(), table.column("n").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
            begin, end = _runs(table.column("node").to_numpy())
            label = np.arange(len(cid))

            def alike(i, s):
                return ((sketch[s] == sketch[i]).sum(-1) >= least) & (100 * np.minimum(n[i], n[s]) >= percent * np.maximum(n[i], n[s]))

            pairs = begin[end - begin == 2]
            label[pairs + 1] = np.where(alike(pairs, pairs + 1), pairs, pairs + 1)
            for a, b in zip(begin[end - begin > 2].tolist(), end[end - begin > 2].tolist(), strict=True):
                code = sketch[a:b] + np.arange(SIGNATURE) * 256
                common = np.bincount(code.reshape(-1), minlength=256 * SIGNATURE)
                label[a:b] = a + _connect(common[code].sum(1), lambda i, a=a, b=b: alike(a + i, slice(a, b)))
            order = np.argsort(label, kind="stable")
            begin, end = _runs(label[order])
            names = np.add.reduceat(mix(cid[order].view(U64) + U64(1)), begin) if len(begin) else np.zeros(0, U64)
            load = np.add.reduceat(n[order], begin) if len(begin) else n
            size = end - begin
            keep = np.repeat(size > 1, size)
            columns = (np.repeat(mix(names).view(np.int64), size), cid[order], n[order], np.repeat(size, size), np.repeat(load, size))
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["node", "cid", "n", "size", "load"])

    return screen


class _Sets:
    """Sets of some rows of a table, in one array of shingles."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        blobs = column.to_pylist()
        self.flat = np.frombuffer(b"".join(blobs), U64)
        self.first = np.concatenate(([0], np.cumsum([len(b) // 8 for b in blobs]))).astype(np.int64)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.first[i] : self.first[i + 1]]


def _linked(both, x, y, percent: int):
    """The similarity of sets of x and y shingles that share so many, against the threshold."""
    return (both > 0) & (100 * both >= percent * (x + y - both))


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of some ranges, one after the other."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _asked(code: np.ndarray, first: np.ndarray, size: np.ndarray, common: np.ndarray, percent: int) -> Callable[[int], np.ndarray]:
    """Tells which of some sets are linked with one of them.

    Linked sets share one of their rarest shingles, as many as may be missing and one more; only sets that do are
    compared, so sets that have what is frequent in common cost nothing.
    """
    n, kinds = len(size), len(common)
    place = np.empty(kinds, np.int64)
    place[np.argsort(common, kind="stable")] = np.arange(kinds)  # rare ones first
    keys = np.repeat(np.arange(n) * kinds, size)
    keys += place[code]
    keys.sort()  # in place: a cluster's shingles are held once
    keys %= kinds
    rare = keys.astype(np.int32)
    del keys, place
    prefix = size - -(-percent * size // 100) + 1
    head = rare[_ranges(first, prefix)]
    by = np.argsort(head, kind="stable")
    posting, holder = head[by], np.repeat(np.arange(n, dtype=np.int32), prefix)[by]
    del head, by
    mark = np.zeros(kinds, np.int32)

    def linked(i: int) -> np.ndarray:
        own = rare[first[i] : first[i] + size[i]]
        low, high = (np.searchsorted(posting, own[: prefix[i]], side) for side in ("left", "right"))
        near = np.zeros(n, bool)
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            near[holder[a:b]] = True
        some = np.flatnonzero(near)
        mark[own] = 1
        total = np.cumsum(size[some])
        at = 0
        while at < len(some):  # a block of the sets at a time
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BLOCK, "right")))
            part = some[at:to]
            both = np.add.reduceat(mark[rare[_ranges(first[part], size[part])]], np.cumsum(size[part]) - size[part])
            near[part] = _linked(both.astype(np.int64), size[i], size[part], percent)
            at = to
        mark[own] = 0
        return near

    return linked


def _compare(percent: int):
    """(a, b): every class that is not the first of its component within the cluster, and that first one."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            cid, found = table.column("cid").to_numpy(), _Sets(table.column("set"))
            begin, end = _runs(table.column("node").to_numpy())
            root = np.arange(len(cid))
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                if b - a == 2:
                    x, y = found[a], found[a + 1]
                    if _linked(np.intersect1d(x, y, assume_unique=True).size, x.size, y.size, percent):
                        root[a + 1] = a
                    continue
                lo = found.first[a]
                first = found.first[a:b] - lo
                size = np.diff(found.first[a : b + 1])
                known, code = np.unique(found.flat[lo : found.first[b]], return_inverse=True)
                common = np.bincount(code, minlength=len(known))
                score = np.add.reduceat(common[code], first) / size
                linked = _asked(code, first, size, common, percent)
                del known, code
                root[a:b] = a + _connect(score, linked)
            moved = np.flatnonzero(root != np.arange(len(cid)))
            yield pa.RecordBatch.from_arrays([pa.array(cid[moved]), pa.array(cid[root[moved]])], ["a", "b"])

    return compare


def _by(frame: DataFrame, key: str) -> DataFrame:
    """Rows of one key next to each other in one task."""
    return frame.repartition(key).sortWithinPartitions(key)


def _wanted_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, text) of docs that may be among the rows, each once in a task.

    A filter of fixed size tells them from the others, so that no other text is shuffled; a few others pass.
    """
    size = FILTER_BITS
    bit = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(size))
    bytes_ = rows.groupBy((bit / 8).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1, CAST(pmod(xxhash64(doc_id, text_key), {size}) % 8 AS INT))")).alias("bits")).toArrow()  # a row per byte at most
    table = np.zeros(size // 8, np.uint8)
    table[bytes_["at"].to_numpy()] = bytes_["bits"].to_numpy().astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            at = batch.column("bit").to_numpy()
            keep = []
            for i in np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                key = (batch.column("doc_id")[i].as_py(), batch.column("text_key")[i].as_py())
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            yield batch.select(["doc_id", "text_key", "text"]).take(pa.array(keep, pa.int64()))

    return docs.filter("doc_id IS NOT NULL").withColumn("bit", bit).mapInArrow(pick, "doc_id long, text_key long, text string")


def _full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, set) of the wanted classes, each from the text of its first row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, first = sets(part.column("text"))
                blobs = [found[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array(blobs, pa.binary())], ["cid", "set"])

    rows = store(classes.join(wanted.distinct(), "cid", "left_semi").select("cid", "first.doc_id", "first.text_key"), "wanted")
    # Repeated rows of several tasks meet in the join, whose partitions the grouping keeps.
    texts = _wanted_texts(docs, rows).join(rows, ["doc_id", "text_key"]).groupBy("doc_id", "text_key", "cid").agg(F.first("text").alias("text"))
    return texts.select("cid", "text").mapInArrow(make, "cid long, set binary")


def _members(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, cid, n, sketch, size, load) of the entries (node, cid, n) whose node has several classes."""
    nodes = entries.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("load")).filter("size > 1")
    return entries.join(nodes, "node").join(classes.select("cid", "sketch"), "cid")


def _share(size: Column | str, load: Column | str) -> Column:
    """What a task holds at most is one; FEW classes are not divided."""
    size, load = (F.col(c) if isinstance(c, str) else c for c in (size, load))
    return F.when(size <= FEW, F.lit(0.0)).otherwise(F.greatest(size / NODE, load / LOAD))


def _branches(members: DataFrame, level: int) -> DataFrame:
    """Children of the members' nodes; the node draws the positions."""

    def child(k: int) -> Column:
        position = F.pmod(F.xxhash64("node", F.lit(level), F.lit(k)), F.lit(SIGNATURE)).cast("int")
        return F.xxhash64("node", position, F.substring("sketch", position + 1, F.lit(1)))

    third = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(3)) == 0
    drawn = F.when(third, F.array(child(0), child(1))).otherwise(F.array(child(0)))
    return members.select(F.explode(F.array_distinct(drawn)).alias("node"), "cid", "n")


def _pivots(large: DataFrame) -> DataFrame:
    """(node, pivot): of some CANDIDATES classes of each node, the one that agrees most with the others."""
    some = large.filter(F.pmod(F.xxhash64("node", "cid"), F.greatest(F.lit(1), F.floor(F.col("size") / CANDIDATES)).cast("long")) == 0)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "node"):
            nodes, cid = table.column("node").to_numpy(), table.column("cid").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SIGNATURE)
            begin, end = _runs(nodes)
            best = []
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                code = sketch[a:b] + np.arange(SIGNATURE) * 256
                best.append(a + int(np.bincount(code.reshape(-1), minlength=256 * SIGNATURE)[code].sum(1).argmax()))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[best]), pa.array(cid[best])], ["node", "pivot"])

    return _by(some.select("node", "cid", "sketch"), "node").mapInArrow(choose, "node long, pivot long")


def _against_pivots(large: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Rows of large with their node's pivot and whether they are similar to it, on full sets."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, pivot = _Sets(batch.column("set")), _Sets(batch.column("pivot_set"))
            both = [np.intersect1d(mine[i], pivot[i], assume_unique=True).size for i in range(batch.num_rows)]
            keep = _linked(np.array(both, np.int64), np.diff(mine.first), np.diff(pivot.first), percent)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(keep)], [*columns, "linked"])

    pivots = _pivots(large).join(full.select(F.col("cid").alias("pivot"), F.col("set").alias("pivot_set")), "pivot")
    rows = large.join(full, "cid").join(pivots, "node").select(*large.columns, "pivot", "set", "pivot_set")
    columns = [*large.columns, "pivot"]
    schema = large.withColumn("pivot", F.lit(0).cast("long")).withColumn("linked", F.lit(True)).schema
    return rows.mapInArrow(told, schema)


def _divide(told: DataFrame, last: bool) -> tuple[list[DataFrame], DataFrame]:
    """Clusters to compare of large nodes with a few classes beyond their pivot, and the rows of other large nodes.

    With last, these are dealt in parts too, and every two parts are a cluster.
    """
    rest = told.filter("NOT linked").groupBy("node").agg(F.count("*").alias("rest"), F.sum("n").alias("rest_load"))
    left = told.join(rest.select("node", (_share("rest", "rest_load") <= 0.5).alias("few")), "node")
    parts = F.ceil(2 * _share("size", "load")).cast("int")
    own = F.pmod(F.xxhash64("cid"), parts).cast("int")
    # The few are compared with all the others, which are dealt in parts.
    dealt = F.when(F.col("linked"), F.array(own)).otherwise(F.sequence(F.lit(0), parts - 1))
    few = left.filter("few").select("node", "cid", F.explode(dealt).alias("part")).select(F.xxhash64("node", "part").alias("node"), "cid")
    many = left.filter("NOT few")
    if not last:
        return [few], many
    paired = many.select("node", "cid", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    return [few, paired.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "cid")], many.filter("false")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def near_copies(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key) of every row of docs.

    text_key is a hash of the text; rows with the same doc_id and text_key get the same answer.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", F.xxhash64("text"))
    sketches = store(docs.mapInArrow(_sketch, "doc_id long, text_key long, n_shingles long, high long, low long, roots array<long>, sketch binary"), "sketches")
    keys = ["high", "low", "n_shingles"]
    # Roots and sketch are the same for the whole class.
    grouped = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*keys).agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch"))
    classes = store(grouped.withColumn("cid", F.monotonically_increasing_id()).withColumn("n", F.col("n_shingles")), "classes")

    members = store(_members(classes.select(F.explode("roots").alias("node"), "cid", "n"), classes), "members")
    full, tables, clusters, links = None, [], [], []
    for level in range(1, DEPTH + 1):
        screened = _by(members.filter(F.col("size") <= NODE).select("node", "cid", "n", "sketch"), "node").mapInArrow(_screen(percent), "node long, cid long, n long, size long, load long")
        found = store(screened.distinct(), "clusters")
        light = _share("size", "load") <= 1
        clusters.append(found.filter(light).select("node", "cid"))
        heavy = found.filter(~light).join(classes.select("cid", "sketch"), "cid").select("node", "cid", "n", "sketch", "size", "load")
        large = store(members.filter(F.col("size") > NODE).select(*heavy.columns).unionByName(heavy), "large")
        drop(members)
        tables.append(found)
        if full is None:  # what later levels have is among these
            full = store(_full_sets(docs, classes, found.select("cid").union(large.select("cid"))), "sets")
        if large.isEmpty():
            drop(large)
            break
        told = store(_against_pivots(large, full, percent), "told")
        drop(large)
        links.append(told.filter("linked AND cid <> pivot").select(F.col("cid").alias("a"), F.col("pivot").alias("b")))
        parts, many = _divide(told, last=level == DEPTH)
        clusters += parts
        members = store(_members(_branches(many, level), classes), "members")
        tables.append(told)
    compared = store(_by(_union(clusters).join(full, "cid"), "node").mapInArrow(_compare(percent), "a long, b long"), "links")
    tied = components(_union([*links, compared]))

    # Components are named by their smallest doc_id; classes without links are their own.
    named = classes.select("cid", F.col("first.doc_id").alias("doc_id"), *keys)
    inside = named.join(tied, F.col("cid") == F.col("id")).select("component", "doc_id", *keys)
    least = inside.groupBy("component").agg(F.min("doc_id").alias("least"))
    placed = inside.join(least, "component").select(*keys, "least").union(named.join(tied, F.col("cid") == F.col("id"), "left_anti").select(*keys, "doc_id"))
    rows = sketches.select("doc_id", "text_key", *keys).join(placed, keys, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    out = store(rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key"), "near_copies")
    for table in (sketches, classes, members, full, compared, tied, *tables):
        drop(table)
    return out
