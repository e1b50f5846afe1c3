"""Enumerate every distinct Reversi board level by level, then count outcomes backwards.

Forward: a level's boards are expanded by one vectorised kernel, and equal children merge in one shuffle
whose partial aggregation runs before it.  Backward: a board's counts are the sums over its children,
found by an equi-join on the child's key; colours are exchanged back where the canonical child had
them exchanged.  Each level is a committed table, so lineage ends there and a stopped run resumes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import bits, boards
from tessera.operators.ordinals import first_rows
from tessera.sources.levels import LevelStore
from tessera.sources.metadata import file_sizes
from tessera.sources.tables import new_path, read
from tessera.sources.tables import store as store_table

BOARD = ["player", "occ", "col"]
EDGE = "p_player byte, p_occ long, p_col long, player byte, occ long, col long, flipped boolean"
FACTS = "n_moves int, passes boolean, terminal boolean"
OUTCOME = "decimal(38,0)"


def _words(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy().view(np.uint64) if n != "player" else batch.column(n).to_numpy().astype(np.int64) for n in names]


def expand(level: DataFrame, size: int) -> DataFrame:
    """Each board with its children, one row for each, or one row without a child for a finished board.

    Every row has the board's facts; `first` marks one row of each board, so that sums count it once.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            player, occ, col = _words(batch, *BOARD)
            got = boards.children(occ, col, player, size)
            ends = np.flatnonzero(got["terminal"])
            parent = np.concatenate((got["parent"], ends))
            child = np.arange(len(parent)) >= len(got["parent"])  # no child
            first = np.zeros(len(parent), bool)
            first[np.unique(parent, return_index=True)[1]] = True
            own = [a[parent] for a in (player.astype(np.int8), occ.view(np.int64), col.view(np.int64))]
            found = [np.concatenate((got[k].astype(t) if t is not np.int64 else got[k].view(t), np.zeros(len(ends), t))) for k, t in (("player", np.int8), ("occupied", np.int64), ("black", np.int64), ("flipped", bool))]
            told = [got[k][parent] for k in ("n_moves", "passes", "terminal")]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, own), *(pa.array(a, mask=child) for a in found), pa.array(told[0].astype(np.int32)), *map(pa.array, told[1:]), pa.array(first)],
                ["p_player", "p_occ", "p_col", "player", "occ", "col", "flipped", "n_moves", "passes", "terminal", "first"],
            )

    return level.select(*BOARD).mapInArrow(rows, f"{EDGE}, {FACTS}, first boolean")


def edges(level: DataFrame, size: int) -> DataFrame:
    """A row for each board and child; none for a finished board."""
    return expand(level, size).filter("NOT terminal").select("p_player", "p_occ", "p_col", *BOARD, "flipped")


def step_figures() -> list[Column]:
    """Aggregates over an expansion: boards read, passes, finished boards and the most moves of a board."""
    first = F.col("first").cast("int")
    return [
        F.coalesce(F.sum(first), F.lit(0)).alias("boards_read"), F.coalesce(F.sum(first * F.col("passes").cast("int")), F.lit(0)).alias("passes"),
        F.coalesce(F.sum(first * F.col("terminal").cast("int")), F.lit(0)).alias("terminal"), F.coalesce(F.max("n_moves"), F.lit(0)).alias("max_moves"),
    ]


def _seed(spark: SparkSession) -> DataFrame:
    occ, col, player = boards.start()
    canon = boards.canonical(*(np.array([v], t) for v, t in ((occ, np.uint64), (col, np.uint64), (player, np.int64))))
    return spark.createDataFrame([(0, int(canon[2][0]), int(canon[0][0]), int(canon[1][0]))], "level int, player byte, occ long, col long")


def solve(spark: SparkSession, path: str, size: int = 4, max_level: int | None = None, seeds: DataFrame | None = None, ranges: int = 1) -> list[dict]:
    """Write all levels; each gives its row of figures.  Finished levels are kept.

    seeds (level, player, occ, col) are canonical boards to begin from, which may lie on several levels; without
    them the game begins from its first board.  With ranges, a level is expanded in so many shares of its
    buckets, each of which is committed with its figures; a run that was stopped goes on with the shares left,
    and the shares merge once all are there.
    """
    store = LevelStore(spark, path)
    begun = _seed(spark) if seeds is None else seeds
    last = max_level if max_level is not None else size * size - 4 if seeds is None else seeds.agg(F.max("level")).first()[0]
    if not store.committed("boards-0"):
        first = begun.filter("level = 0").groupBy(*BOARD).agg(F.lit(1).cast("long").alias("times"))
        store.write("boards-0", first, lambda f: {"level": 0, "unique": (n := f.count()), "generated": n}, BOARD)
    for level in range(store.deepest("boards"), last):
        more = begun.filter(F.col("level") == level + 1) if seeds is not None else None
        if ranges == 1:
            merged = _merged(expand(level_rows(store, level), size), more)
        else:
            shares = [_share(store, level, size, k, ranges) for k in range(ranges)]
            parts = [store.read(name).filter("occ IS NOT NULL OR boards_read > 0") for name in shares]
            every = parts[0]
            for part in parts[1:]:
                every = every.unionByName(part)
            if more is not None:
                every = every.unionByName(more.select(*BOARD), allowMissingColumns=True)
            merged = every.groupBy(*BOARD).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("times", "boards_read", "passes", "ended")), F.max("most").alias("most"))
        found = store.write(f"boards-{level + 1}", merged, lambda f, level=level: _figures(f, level, size), BOARD)
        if ranges > 1:
            for name in shares:
                store.drop(name)
        if not found["unique"] and seeds is None:
            break
    return [store.stats(f"boards-{k}") for k in range(store.deepest("boards") + 1)]


def _merged(expanded: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """Children merged and their parents' figures added up in one pass; a row without a child keeps those of finished parents."""
    mine = [(F.col("first") & c).cast("long") for c in (F.lit(True), F.col("passes"), F.col("terminal"))]
    rows = expanded if seeds is None else expanded.unionByName(seeds.select(*BOARD), allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in zip(mine, ("boards_read", "passes", "ended"), strict=True)]
    return rows.groupBy(*BOARD).agg(F.count_if(F.col("p_occ").isNotNull() & F.col("occ").isNotNull()).alias("times"), *sums, F.max("n_moves").alias("most"))


def _share(store: LevelStore, level: int, size: int, share: int, of: int) -> str:
    """Expand one share of a level's buckets, unless that is done; the name that it is committed under."""
    name = f"share-{level + 1}-{share}-of-{of}"
    if not store.committed(name):
        rows = store.read_share(f"boards-{level}", share, of).filter("occ IS NOT NULL")
        store.write(name, _merged(expand(rows, size)), lambda f: _figures(f, level, size))
    return name


def _figures(f: DataFrame, level: int, size: int) -> dict:
    r = f.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("times", "boards_read", "passes", "ended")), F.count("occ").alias("unique"), F.coalesce(F.max("most"), F.lit(0)).alias("most")).first()
    if r.most > boards.MOST_MOVES[size]:
        raise ValueError(f"level {level} has a board with {r.most} moves; boards of {size} rows have {boards.MOST_MOVES[size]} at most")
    return {"level": level + 1, "generated": int(r.times), "unique": r.unique, "dups": int(r.times) - r.unique, "boards_read": int(r.boards_read), "passes": int(r.passes), "terminal": int(r.ended), "max_moves": r.most}


def level_rows(store: LevelStore, level: int) -> DataFrame:
    """The boards of a stored level; the row that only holds figures of finished parents is none."""
    return store.read(f"boards-{level}").filter("occ IS NOT NULL")


#: Types of counts with the largest number that each holds, narrow ones first.
WIDTHS = (("tinyint", (1 << 7) - 1), ("smallint", (1 << 15) - 1), ("int", (1 << 31) - 1), ("bigint", (1 << 63) - 1), (OUTCOME, 10**38 - 1))
ENDS = ("black", "white", "tie")


def width(largest: int) -> str:
    """The narrowest type of counts up to this number."""
    for kind, most in WIDTHS:
        if largest <= most:
            return kind
    raise OverflowError(f"no type holds counts of {largest}")


def retrograde(spark: SparkSession, path: str, size: int = 4, force: bool = False) -> dict:
    """Outcome counts of every board, from the deepest level up; the first board's are the games'.

    A level's counts are stored in the narrowest type for the most that they can be: the largest count below
    times the most moves of a board.  With force, committed counts are counted anew.
    """
    store = LevelStore(spark, path)
    deepest = store.deepest("boards")
    if force:  # from above, so that a run that is stopped leaves no count above one that is missing
        for level in range(deepest + 1):
            store.drop(f"counts-{level}")
    for level in range(deepest, -1, -1):
        if store.committed(f"counts-{level}"):
            continue
        below = store.read(f"counts-{level + 1}") if store.committed(f"counts-{level + 1}") else None
        largest = 1
        if below is not None:
            largest = max(1, int(store.stats(f"counts-{level + 1}")["largest"]) * max(1, store.stats(f"boards-{level + 1}").get("max_moves", 1)))
        kind = width(largest)
        store.write(f"counts-{level}", outcomes(level_rows(store, level), below, size, kind), lambda f, kind=kind, level=level: _census(f) | {"width": kind, "bytes": store.bytes(f"counts-{level}")}, BOARD)
    return store.stats("counts-0")


def outcomes(level: DataFrame, below: DataFrame | None, size: int, kind: str = OUTCOME) -> DataFrame:
    """Counts of a level's boards from those of the level below, whose stored side is not shuffled.

    Finished boards count themselves and take no part in the join, so no row of it has a null key.  Without a
    level below, boards that have children have no counts yet.
    """
    expanded = expand(level, size)
    exact = kind if kind.startswith("decimal") else "bigint"
    mine = [F.col(f"p_{c}").alias(c) for c in BOARD]
    black, white = F.bit_count(F.col("p_occ").bitwiseAND(F.col("p_col"))), F.bit_count(F.col("p_occ").bitwiseAND(F.bitwise_not(F.col("p_col"))))
    won = {"black": black > white, "white": black < white, "tie": black == white}
    found = expanded.filter("terminal").select(*mine, *(won[n].cast("int").cast(exact).alias(n) for n in ENDS))
    if below is not None:
        missing = F.raise_error(F.lit("a child is missing from the level below")).cast(exact)
        swapped = {"black": "white", "white": "black", "tie": "tie"}
        given = {n: F.when(F.col("tie").isNull(), missing).otherwise(F.when(F.col("flipped"), F.col(swapped[n])).otherwise(F.col(n)).cast(exact)) for n in ENDS}
        joined = expanded.filter("NOT terminal").join(below, BOARD, "left")
        found = found.unionByName(joined.select(*mine, *(given[n].alias(n) for n in ENDS)))
    return found.groupBy(*BOARD).agg(*(F.sum(n).cast(kind).alias(n) for n in ENDS))


def _census(counts: DataFrame) -> dict:
    sums = [F.coalesce(F.sum(F.col(c).cast(OUTCOME)), F.lit(0)).alias(c) for c in ENDS]
    r = counts.agg(F.count("*").alias("boards"), *sums, F.coalesce(F.max(F.greatest(*ENDS)), F.lit(0)).alias("largest")).first()
    return {"boards": r.boards, "black": int(r.black), "white": int(r.white), "tie": int(r.tie), "total": int(r.black + r.white + r.tie), "largest": int(r.largest)}


def canonical_boards(rows: DataFrame, *more: str) -> DataFrame:
    """Boards with the canonical ones beside them (c_player, c_occ, c_col, flipped), and other columns passed on."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            player, occ, col = _words(batch, *BOARD)
            o, c, p = boards.canonical(occ, col, player)
            found = [p.astype(np.int8), o.view(np.int64), c.view(np.int64), p != player]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], [*batch.schema.names, "c_player", "c_occ", "c_col", "flipped"])

    given = rows.select(*BOARD, *more)
    found = [T.StructField("c_player", T.ByteType()), T.StructField("c_occ", T.LongType()), T.StructField("c_col", T.LongType()), T.StructField("flipped", T.BooleanType())]
    return given.mapInArrow(turn, T.StructType([*given.schema, *found]))


def reachable(rows: DataFrame, size: int) -> DataFrame:
    """(ply, player, occ, col) of every canonical board that play from these boards reaches, at its first ply.

    Each step expands what the one before found new, drops what was reached earlier, and is written; the loop
    ends with the first step that finds nothing.
    """
    found = canonical_boards(rows).select(*(F.col(f"c_{c}").alias(c) for c in BOARD)).distinct()
    every, ply = store_table(found.withColumn("ply", F.lit(0)), "reached"), 0
    last = every
    while not last.isEmpty():
        ply += 1
        last = store_table(edges(last, size).select(*BOARD).distinct().join(every, BOARD, "left_anti").withColumn("ply", F.lit(ply)), "reached")
        every = every.unionByName(last)
    return every.select("ply", *BOARD)


def _levels(store: LevelStore) -> DataFrame:
    """All boards of all committed levels."""
    every = None
    for k in range(store.deepest("boards") + 1):
        rows = level_rows(store, k).select(F.lit(k).alias("level"), *BOARD, "times" if k else F.lit(1).cast("long").alias("times"))
        every = rows if every is None else every.unionByName(rows)
    if every is None:
        raise ValueError("the store has no committed level")
    return every


def level_report(spark: SparkSession, path: str) -> DataFrame:
    """One row per level: boards by player, bytes, ratios, duplicates, and running totals.

    compressed_bytes are those of the level's files, uncompressed_bytes those of its keys of 16 bytes; ratios
    with a zero denominator are blank.
    """
    store = LevelStore(spark, path)
    every = _levels(store)
    stats = every.groupBy("level").agg(F.count("*").alias("total"), F.sum((F.col("player") == boards.BLACK).cast("long")).alias("black"), F.sum((F.col("player") == boards.WHITE).cast("long")).alias("white"), F.sum("times").alias("generated"))
    files = None
    for k in range(store.deepest("boards") + 1):
        some = file_sizes(store.read(f"boards-{k}")).agg(F.sum("bytes").alias("compressed_bytes")).select(F.lit(k).alias("level"), "compressed_bytes")
        files = some if files is None else files.unionByName(some)
    running = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    dups, flat = F.col("generated") - F.col("total"), F.col("total") * 16
    return (
        stats.join(files, "level", "left").withColumn("uncompressed_bytes", flat)
        .withColumn("ratio", F.try_divide(F.col("uncompressed_bytes"), F.col("compressed_bytes")))
        .withColumn("reduction_pct", 100.0 - F.try_divide(100.0 * F.col("compressed_bytes"), F.col("uncompressed_bytes")))
        .withColumn("bits_per_board", F.try_divide(8.0 * F.col("compressed_bytes"), F.col("total")))
        .withColumn("dups", dups).withColumn("dups_pct", F.try_divide(100.0 * dups, F.col("generated"))).withColumn("cumulative_generated", F.sum("generated").over(running))
    )


def pattern_report(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Per level and player, of the lower 16 bits of the occupied cells in ring order: bits that are set,
    their average, bits never set, and what numbering patterns within their population saves.

    limit takes that many boards of each level, the smallest ones, for a quick look.
    """
    store = LevelStore(spark, path)
    every = _levels(store)
    if limit is not None:
        every = first_rows(every, "level", ["occ", "col", "player"], limit)
    pattern = bits.gather_bits(F.col("occ"), bits.ring_order(8)).bitwiseAND(F.lit(65535))
    ones = F.bit_count("pattern")
    table = F.array(*(F.lit((math.comb(16, k) - 1).bit_length()).cast("long") for k in range(17)))
    bands = every.select("level", "player", pattern.alias("pattern")).groupBy("level", "player", ones.alias("ones")).agg(F.count("*").alias("n"), F.bit_or("pattern").alias("used"))
    sized = bands.withColumn("bytes", F.floor((F.col("n") * F.element_at(table, F.col("ones") + 1) + 7) / 8))
    sums = sized.groupBy("level", "player").agg(F.sum("n").alias("boards"), F.sum(F.col("n") * F.col("ones")).alias("bits_set"), F.bit_or("used").alias("used"), F.sum("bytes").cast("long").alias("band_bytes"))
    return sums.select(
        "level", "player", "boards", "bits_set", F.try_divide(F.col("bits_set"), F.col("boards")).alias("average"), (16 - F.bit_count("used")).alias("idle_bits"), (F.col("boards") * 2).alias("plain_bytes"), "band_bytes",
        (100.0 - F.try_divide(100.0 * F.col("band_bytes"), F.col("boards") * 2)).alias("reduction_pct"),
    )


def derived_boards(orders: DataFrame) -> DataFrame:
    """Boards made of order keys: a key's bits say which of the inner cells are taken, and by whom."""
    mask = int(boards.board_mask(4))
    spread = F.col("o_orderkey") * 2654435761 + F.col("o_custkey") * 40503
    occ = spread.bitwiseXOR(F.shiftright(spread, 7) * 97).bitwiseAND(F.lit(mask))
    middle = 0x0000001818000000
    col = F.shiftright(spread * 31, 3).bitwiseAND(occ.bitwiseOR(F.lit(middle)))
    return orders.select("o_orderkey", (F.col("o_orderkey") % 2).cast("byte").alias("player"), occ.bitwiseOR(F.lit(middle)).alias("occ"), col.alias("col"))


def reversi_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal moves of a board for every order, on 4x4."""
    rows = derived_boards(spark.read.parquet(f"{sf_dir}/orders.parquet"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            player, occ, col = _words(batch, *BOARD)
            moves = boards.legal_moves(occ, col, player, 4)
            yield pa.RecordBatch.from_arrays([batch.column("o_orderkey"), *(batch.column(c) for c in ("occ", "col")), pa.array(moves.view(np.int64))], ["o_orderkey", "occ", "col", "moves"])

    return rows.mapInArrow(find, "o_orderkey long, occ long, col long, moves long")


def reversi_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct canonical children of the orders' boards, with how often each was reached."""
    rows = derived_boards(spark.read.parquet(f"{sf_dir}/orders.parquet")).select(*BOARD).distinct()
    return edges(rows, 4).groupBy(*BOARD).agg(F.count("*").alias("times"))


def reversi_step_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of one step over the orders' distinct boards, by player: boards read, passes, finished, most moves."""
    rows = derived_boards(spark.read.parquet(f"{sf_dir}/orders.parquet")).select(*BOARD).distinct()
    expanded = expand(rows, 4)
    return expanded.groupBy(F.col("p_player").alias("player")).agg(*step_figures())


def reversi_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' distinct boards on which neither player can move, with who has won."""
    rows = derived_boards(spark.read.parquet(f"{sf_dir}/orders.parquet")).select(*BOARD).distinct()
    ends = expand(rows, 4).filter("terminal")
    black, all_ = F.bit_count(F.col("p_occ").bitwiseAND(F.col("p_col"))), F.bit_count("p_occ")
    outcome = F.when(2 * black > all_, "BLACK").when(2 * black < all_, "WHITE").otherwise("TIE")
    return ends.select(*(F.col(f"p_{c}").alias(c) for c in BOARD), outcome.alias("outcome"))


CELLS4 = [(r, c) for r in range(2, 6) for c in range(2, 6)]


def _bit(r: int, c: int) -> int:
    return 1 << (63 - 8 * r - c)


def _ways(r: int, c: int) -> list[tuple[int, int]]:
    """(cells between, last cell) of all lines from a cell: a move turns the first if the last is own."""
    out = []
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            between, rr, cc = 0, r + dr, c + dc
            while (dr, dc) != (0, 0) and (rr, cc) in CELLS4:
                if between:
                    out.append((between, _bit(rr, cc)))
                between |= _bit(rr, cc)
                rr, cc = rr + dr, cc + dc
    return out


def _boards_sql() -> str:
    spread = "(o_orderkey * 2654435761 + o_custkey * 40503)"
    base = f"SELECT o_orderkey, o_orderkey % 2 AS player, (xor({spread}, ({spread} >> 7) * 97) & {int(boards.board_mask(4))}) | {0x1818000000} AS occ, (({spread} * 31) >> 3) AS raw FROM orders"
    return f"b AS ({base}), c AS (SELECT o_orderkey, player, occ, raw & occ AS col FROM b)"


SIDES = "CASE WHEN player = 1 THEN col ELSE xor(col, occ) END AS own, CASE WHEN player = 1 THEN xor(col, occ) ELSE col END AS other"


def _moves(own: str, other: str) -> str:
    cells = []
    for cell in CELLS4:
        ways = " OR ".join(f"(({other} & {between}) = {between} AND ({own} & {end}) <> 0)" for between, end in _ways(*cell))
        cells.append(f"CASE WHEN (occ & {_bit(*cell)}) = 0 AND ({ways}) THEN {_bit(*cell)} ELSE 0 END")
    return f"CAST({' + '.join(cells)} AS BIGINT)"


def moves_sql() -> str:
    """Legal moves by cell: a move is a line of cells, all but the ends the opponent's, the last one own."""
    return f"WITH {_boards_sql()}, s AS (SELECT *, {SIDES} FROM c) SELECT o_orderkey, occ, col, {_moves('own', 'other')} AS moves FROM s"


def children_sql() -> str:
    """Every move of every board cell by cell, and the smallest of the sixteen equivalent boards."""
    turned = " ".join(f"WHEN {_bit(*cell)} THEN " + " + ".join(f"CASE WHEN (other & {between}) = {between} AND (own & {end}) <> 0 THEN {between} ELSE 0 END" for between, end in _ways(*cell)) for cell in CELLS4)
    shapes = []
    for swap in (False, True):
        for flip_r in (False, True):
            for flip_c in (False, True):
                to = {(r, c): (7 - x if flip_r else x, 7 - y if flip_c else y) for r, c in CELLS4 for x, y in [(c, r) if swap else (r, c)]}
                o, k = (" + ".join(f"CASE WHEN ({v} & {_bit(*cell)}) <> 0 THEN {_bit(*to[cell])} ELSE 0 END" for cell in CELLS4) for v in ("occ2", "col2"))
                shapes.append(f"{{'o': CAST({o} AS BIGINT), 'c': CAST({k} AS BIGINT)}}")
    return (
        f"WITH {_boards_sql()}, s AS (SELECT DISTINCT player, occ, col, {SIDES} FROM c), m AS (SELECT *, {_moves('own', 'other')} AS first_moves, {_moves('other', 'own')} AS passed_moves FROM s), "
        "d AS (SELECT occ, CASE WHEN first_moves <> 0 THEN player ELSE 1 - player END AS mover, CASE WHEN first_moves <> 0 THEN first_moves ELSE passed_moves END AS moves, "
        "CASE WHEN first_moves <> 0 THEN own ELSE other END AS own, CASE WHEN first_moves <> 0 THEN other ELSE own END AS other FROM m), "
        f"e AS (SELECT d.*, cell FROM d, unnest([{', '.join(str(_bit(*cell)) for cell in CELLS4)}]) t(cell) WHERE (moves & cell) <> 0), "
        f"f AS (SELECT *, CAST(CASE cell {turned} END AS BIGINT) AS turned FROM e), "
        "g AS (SELECT occ | cell AS occ2, CASE WHEN mover = 1 THEN own | cell | turned ELSE xor(occ | cell, own | cell | turned) END AS col2, 1 - mover AS player2 FROM f), "
        f"h AS (SELECT player2, unnest([{', '.join(shapes)}]) AS x, row_number() OVER () AS n FROM g), "
        "k AS (SELECT n, unnest([{'o': x.o, 'c': x.c, 'late': 1 - player2}, {'o': x.o, 'c': xor(x.c, x.o), 'late': player2}]) AS y FROM h), "
        "l AS (SELECT n, min(y) AS y FROM k GROUP BY n) "
        "SELECT CAST(1 - y.late AS TINYINT) AS player, y.o AS occ, y.c AS col, count(*) AS times FROM l GROUP BY ALL"
    )


def figures_sql() -> str:
    return (
        f"WITH {_boards_sql()}, s AS (SELECT DISTINCT player, occ, col, {SIDES} FROM c), m AS (SELECT player, bit_count({_moves('own', 'other')}) AS mine, bit_count({_moves('other', 'own')}) AS theirs FROM s) "
        "SELECT CAST(player AS TINYINT) AS player, count(*) AS boards_read, count(*) FILTER (mine = 0 AND theirs > 0) AS passes, count(*) FILTER (mine = 0 AND theirs = 0) AS terminal, CAST(max(CASE WHEN mine > 0 THEN mine ELSE theirs END) AS INT) AS max_moves FROM m GROUP BY 1"
    )


def ends_sql() -> str:
    return (
        f"WITH {_boards_sql()}, s AS (SELECT DISTINCT player, occ, col, {SIDES} FROM c) SELECT CAST(player AS TINYINT) AS player, occ, col, "
        "CASE WHEN 2 * bit_count(col) > bit_count(occ) THEN 'BLACK' WHEN 2 * bit_count(col) < bit_count(occ) THEN 'WHITE' ELSE 'TIE' END AS outcome "
        f"FROM s WHERE {_moves('own', 'other')} = 0 AND {_moves('other', 'own')} = 0"
    )


#: The outer cells of the 4x4 board, some of which are free on the boards below.
OUTER4 = [_bit(r, c) for r, c in CELLS4 if not (r in (3, 4) and c in (3, 4))]
#: How the cells that stay free are taken from an order's number; at most so many are free.
FREE = (3, 9, 17, 23)


def late_boards(orders: DataFrame) -> DataFrame:
    """Distinct boards made of orders on which at most as many cells are free as FREE has numbers."""
    number = (F.col("o_orderkey") % 1_000_003) * 2_654_435_761 + (F.col("o_custkey") % 1_000_003) * 40_503
    cells = F.array(*(F.lit(c).cast("long") for c in OUTER4))
    taken = F.lit(int(boards.board_mask(4)))
    for k in FREE:
        taken = taken.bitwiseAND(F.bitwise_not(F.element_at(cells, (F.shiftright(number, k) % len(OUTER4) + 1).cast("int"))))
    col = F.shiftright(number * 31, 3).bitwiseXOR(number * 101).bitwiseAND(taken)
    return orders.select((F.col("o_orderkey") % 2).cast("byte").alias("player"), taken.alias("occ"), col.alias("col")).distinct()


def reversi_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How all games from each of the orders' late boards end, counted level by level from the full boards back."""
    given = store_table(canonical_boards(late_boards(read(spark, sf_dir, "orders"))), "boards")
    seeds = given.select((F.bit_count("c_occ") - (16 - len(FREE))).cast("int").alias("level"), *(F.col(f"c_{c}").alias(c) for c in BOARD)).distinct()
    path = new_path(spark, "levels")
    solve(spark, path, 4, max_level=len(FREE), seeds=seeds)
    retrograde(spark, path, 4)
    store = LevelStore(spark, path)
    counts = None
    for level in range(len(FREE) + 1):
        own = store.read(f"counts-{level}").select(*(F.col(c).alias(f"c_{c}") for c in BOARD), *(F.col(n).cast("long").alias(n) for n in ENDS))
        counts = own if counts is None else counts.unionByName(own)
    found = given.join(counts, ["c_player", "c_occ", "c_col"])
    return found.select(*BOARD, F.when(F.col("flipped"), F.col("white")).otherwise(F.col("black")).alias("black"), F.when(F.col("flipped"), F.col("black")).otherwise(F.col("white")).alias("white"), "tie")


def reversi_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every board that play from the orders' late boards reaches, at its first ply."""
    return reachable(late_boards(read(spark, sf_dir, "orders")), 4)


def _late_sql() -> str:
    number = "((o_orderkey % 1000003) * 2654435761 + (o_custkey % 1000003) * 40503)"
    free = " | ".join(f"[{', '.join(map(str, OUTER4))}][({number} >> {k}) % {len(OUTER4)} + 1]" for k in FREE)
    taken = f"({int(boards.board_mask(4))} & ~({free}))"
    return f"late AS (SELECT DISTINCT CAST(o_orderkey % 2 AS TINYINT) AS player, {taken} AS occ, xor(({number} * 31) >> 3, {number} * 101) & {taken} AS col FROM orders)"


def _turned_sql() -> str:
    each = " ".join(f"WHEN {_bit(*cell)} THEN " + " + ".join(f"CASE WHEN (other & {between}) = {between} AND (own & {end}) <> 0 THEN {between} ELSE 0 END" for between, end in _ways(*cell)) for cell in CELLS4)
    return f"CAST(CASE cell {each} END AS BIGINT)"


def _played(rows: str, kept: str) -> str:
    """Rows (player, occ, own, other and more) a move later: the other player is next, unless one passes."""
    cells = ", ".join(str(_bit(*cell)) for cell in CELLS4)
    return (
        f"SELECT {kept}, CAST(1 - mover AS TINYINT) AS player, occ | cell AS occ, xor(other, turned) AS own, own | cell | turned AS other FROM (SELECT *, {_turned_sql()} AS turned FROM ("
        f"SELECT * REPLACE (CASE WHEN mine <> 0 THEN own ELSE other END AS own, CASE WHEN mine <> 0 THEN other ELSE own END AS other), CASE WHEN mine <> 0 THEN player ELSE 1 - player END AS mover, CASE WHEN mine <> 0 THEN mine ELSE theirs END AS moves "
        f"FROM (SELECT *, {_moves('own', 'other')} AS mine, {_moves('other', 'own')} AS theirs FROM {rows})), unnest([{cells}]) t(cell) WHERE (moves & cell) <> 0)"
    )


def outcomes_sql() -> str:
    """Every game is played out on its own."""
    return (
        f"WITH RECURSIVE {_late_sql()}, s AS (SELECT player AS p, occ AS o, col AS c, player, occ, {SIDES} FROM late), "
        f"g AS (SELECT * FROM s UNION ALL {_played('g', 'p, o, c')}), "
        f"e AS (SELECT p, o, c, bit_count(CASE WHEN player = 1 THEN own ELSE other END) AS b, bit_count(CASE WHEN player = 1 THEN other ELSE own END) AS w FROM g WHERE {_moves('own', 'other')} = 0 AND {_moves('other', 'own')} = 0) "
        "SELECT p AS player, o AS occ, c AS col, count(*) FILTER (b > w) AS black, count(*) FILTER (b < w) AS white, count(*) FILTER (b = w) AS tie FROM e GROUP BY ALL"
    )


def reachable_sql() -> str:
    shapes = []
    for swap in (False, True):
        for flip_r in (False, True):
            for flip_c in (False, True):
                to = {(r, c): (7 - x if flip_r else x, 7 - y if flip_c else y) for r, c in CELLS4 for x, y in [(c, r) if swap else (r, c)]}
                o, k = (" + ".join(f"CASE WHEN ({v} & {_bit(*cell)}) <> 0 THEN {_bit(*to[cell])} ELSE 0 END" for cell in CELLS4) for v in ("occ", "col"))
                shapes.append(f"{{'o': CAST({o} AS BIGINT), 'c': CAST({k} AS BIGINT)}}")

    def canonical(rows: str) -> str:
        turned = f"SELECT ply, player, [{', '.join(shapes)}] AS xs FROM (SELECT ply, player, occ, CASE WHEN player = 1 THEN own ELSE other END AS col FROM {rows})"
        both = "list_concat(list_transform(xs, lambda x: {'o': x.o, 'c': x.c, 'late': 1 - player}), list_transform(xs, lambda x: {'o': x.o, 'c': xor(x.c, x.o), 'late': 0 + player}))"
        return f"SELECT DISTINCT ply, CAST(1 - y.late AS TINYINT) AS player, y.o AS occ, {SIDES.replace('col', 'y.c').replace('occ', 'y.o').replace('player', '(1 - y.late)')} FROM (SELECT ply, list_min({both}) AS y FROM ({turned}))"

    return (
        f"WITH RECURSIVE {_late_sql()}, g AS ({canonical(f'(SELECT 0 AS ply, player, occ, {SIDES} FROM late)')} "
        f"UNION {canonical('(' + _played('g', 'ply + 1 AS ply') + ')')}) "
        "SELECT CAST(min(ply) AS INT) AS ply, player, occ, CASE WHEN player = 1 THEN own ELSE other END AS col FROM g GROUP BY player, occ, col"
    )


QUERIES = {
    "reversi_moves": reversi_moves, "reversi_children": reversi_children, "reversi_step_figures": reversi_step_figures, "reversi_ends": reversi_ends,
    "reversi_outcomes": reversi_outcomes, "reversi_reachable": reversi_reachable,
}
ORACLES = {
    "reversi_moves": moves_sql(), "reversi_children": children_sql(), "reversi_step_figures": figures_sql(), "reversi_ends": ends_sql(),
    "reversi_outcomes": outcomes_sql(), "reversi_reachable": reachable_sql(),
}
