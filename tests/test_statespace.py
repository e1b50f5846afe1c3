"""Boards against a scalar walk over cells, and the published outcome of the 4x4 game."""

import random
import re

import numpy as np
import pytest

from tessera.functions import boards
from tessera.functions.bits import inverse_order, ring_order
from tessera.jobs import statespace
from tessera.sources.levels import LevelStore

STEPS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]


def cells_of(occ, col):
    return {(k // 8, k % 8): int(bool(col >> (63 - k) & 1)) for k in range(64) if occ >> (63 - k) & 1}


def word(cells):
    return sum(1 << (63 - 8 * r - c) for r, c in cells)


def walk(cells, player, size):
    """{cell: turned cells} of all legal moves."""
    edge, out = (8 - size) // 2, {}
    inside = range(edge, 8 - edge)
    for r in inside:
        for c in inside:
            if (r, c) in cells:
                continue
            taken = set()
            for dr, dc in STEPS:
                line, rr, cc = set(), r + dr, c + dc
                while rr in inside and cc in inside and cells.get((rr, cc)) == 1 - player:
                    line.add((rr, cc))
                    rr, cc = rr + dr, cc + dc
                if line and rr in inside and cc in inside and cells.get((rr, cc)) == player:
                    taken |= line
            if taken:
                out[r, c] = taken
    return out


@pytest.mark.parametrize("size", [4, 6, 8])
def test_moves_and_turned_discs_equal_a_walk(size):
    random.seed(size)
    edge = (8 - size) // 2
    for _ in range(150):
        cells = {(r, c): random.randrange(2) for r in range(edge, 8 - edge) for c in range(edge, 8 - edge) if random.random() < random.choice([0.3, 0.6, 0.9])}
        occ, col = word(cells), word(k for k, v in cells.items() if v)
        player = random.randrange(2)
        want = walk(cells, player, size)
        a = [np.array([occ], np.uint64), np.array([col], np.uint64), np.array([player])]
        assert int(boards.legal_moves(*a, size)[0]) == word(want)
        for cell, taken in want.items():
            assert int(boards.turned(*a, np.array([word([cell])], np.uint64), size)[0]) == word(taken)


def test_canonical_is_shared_by_all_sixteen():
    rng = np.random.default_rng(1)
    occ = rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    col = rng.integers(0, 1 << 63, 200, dtype=np.uint64) & occ
    player = rng.integers(0, 2, 200)
    want = boards.canonical(occ, col, player)
    for o, c in zip(boards.symmetries(occ), boards.symmetries(col), strict=True):
        for cc, pp in ((c, player), (~c & o, 1 - player)):
            got = boards.canonical(o, cc, pp)
            assert all((x == y).all() for x, y in zip(got, want, strict=True))


def test_ring_order_and_start():
    order = ring_order(8)
    assert sorted(order) == list(range(64)) and [inverse_order(order)[p] for p in order] == list(range(64))
    occ, col, _ = boards.start()
    ring = [sum(((v >> (63 - p)) & 1) << (63 - k) for k, p in enumerate(order)) for v in (occ, col)]
    assert ring == [0xF, 0x5]


def playouts(cells, player, counts):
    moves = walk(cells, player, 4)
    if not moves:
        player = 1 - player
        moves = walk(cells, player, 4)
    if not moves:
        black = sum(cells.values())
        counts[(black > len(cells) - black) - (black < len(cells) - black)] += 1
        return
    for cell, taken in moves.items():
        after = dict(cells)
        after.update(dict.fromkeys(taken | {cell}, player))
        playouts(after, 1 - player, counts)


def test_small_board_is_solved_and_resumes(spark, tmp_path):
    path = str(tmp_path)
    statespace.solve(spark, path, 4, max_level=3)
    levels = statespace.solve(spark, path, 4)
    assert levels[0]["unique"] == 1 and levels[1]["unique"] == 1 and all(x["generated"] - x.get("dups", 0) == x["unique"] for x in levels)
    got = statespace.retrograde(spark, path, 4)
    assert (got["black"], got["white"], got["tie"]) == (24_632, 30_116, 5_312)
    counts = {1: 0, -1: 0, 0: 0}
    playouts(cells_of(*boards.start()[:2]), 1, counts)
    assert (counts[1], counts[-1], counts[0]) == (got["black"], got["white"], got["tie"])
    report = statespace.level_report(spark, path).orderBy("level").collect()
    assert [r.total for r in report] == [x["unique"] for x in levels] and report[-1].cumulative_generated == sum(x["generated"] for x in levels)
    assert LevelStore(spark, path).deepest("boards") == len(levels) - 1


def test_figures_of_levels_equal_plain_counts(spark, tmp_path):
    path = str(tmp_path)
    levels = statespace.solve(spark, path, 4, max_level=7)
    store, order = LevelStore(spark, path), ring_order(8)
    patterns = {(r.level, r.player): r for r in statespace.pattern_report(spark, path).collect()}
    report = {r.level: r for r in statespace.level_report(spark, path).collect()}
    for k in range(7):
        rows = statespace.level_rows(store, k).collect()
        moves = [(walk(cells_of(r.occ, r.col), r.player, 4), walk(cells_of(r.occ, r.col), 1 - r.player, 4)) for r in rows]
        step = levels[k + 1]
        assert step["boards_read"] == len(rows)
        assert step["passes"] == sum(not own and bool(other) for own, other in moves)
        assert step["terminal"] == sum(not own and not other for own, other in moves)
        assert step["max_moves"] == max(len(own or other) for own, other in moves) <= boards.MOST_MOVES[4]
        for player in {r.player for r in rows}:
            leaves = [sum(((r.occ >> (63 - p)) & 1) << (63 - i) for i, p in enumerate(order)) & 0xFFFF for r in rows if r.player == player]
            got, used = patterns[k, player], 0
            for leaf in leaves:
                used |= leaf
            assert (got.boards, got.bits_set, got.idle_bits) == (len(leaves), sum(x.bit_count() for x in leaves), 16 - used.bit_count())
            assert abs(got.average - got.bits_set / got.boards) < 1e-12 and got.plain_bytes == 2 * len(leaves) >= got.band_bytes
        own = report[k]
        assert own.uncompressed_bytes == 16 * len(rows) and own.compressed_bytes > 0
        assert abs(own.bits_per_board - 8 * own.compressed_bytes / len(rows)) < 1e-9 and abs(own.ratio - own.uncompressed_bytes / own.compressed_bytes) < 1e-9
    few = {r.level: r.boards for r in statespace.pattern_report(spark, path, limit=1).collect()}
    assert set(few.values()) == {1} and set(few) == set(report)


def test_more_moves_than_a_board_can_have_stop_the_run(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(boards, "MOST_MOVES", {4: 2})
    with pytest.raises(ValueError, match="moves"):
        statespace.solve(spark, str(tmp_path), 4, max_level=6)


def test_a_missing_child_is_an_error(spark, tmp_path):
    path = str(tmp_path)
    statespace.solve(spark, path, 4, max_level=4)
    store = LevelStore(spark, path)
    store.write("counts-4", store.read("boards-4").limit(0).selectExpr("player", "occ", "col", *(f"cast(0 as decimal(38,0)) as {c}" for c in ("black", "white", "tie"))), statespace._census)
    with pytest.raises(Exception, match="missing"):
        statespace.retrograde(spark, path, 4)


def test_children_of_derived_boards(spark, sf_dir):
    rows = statespace.reversi_children(spark, sf_dir).collect()
    o, c, p = (np.array([r[k] for r in rows]) for k in ("occ", "col", "player"))
    again = boards.canonical(o.astype(np.uint64), c.astype(np.uint64), p.astype(np.int64))
    assert len(rows) and (again[0] == o.astype(np.uint64)).all() and (again[1] == c.astype(np.uint64)).all() and (again[2] == p).all()


def tree(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_stored_counts_are_joined_as_they_lie(spark, tmp_path):
    path = str(tmp_path)
    statespace.solve(spark, path, 4)
    statespace.retrograde(spark, path, 4)
    store = LevelStore(spark, path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = tree(statespace.outcomes(statespace.level_rows(store, 7), store.read("counts-8"), 4))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # One shuffle of the children to the stored buckets, one of the counts to their boards; none of the stored side.
    shuffles = [line.strip(" :+-") for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and "Bucketed: true" in plan, plan
    lines = plan.splitlines()
    stored = next(i for i, line in enumerate(lines) if "Bucketed: true" in line and "black" in line)
    above = [line for line in lines[:stored] if re.search("(SortMerge|ShuffledHash)Join|Exchange", line)]
    joins = [i for i, line in enumerate(above) if "Join" in line]
    assert len(joins) == 1 and len(above[joins[0] + 1 :]) == 1  # the children's shuffle alone lies between the join and the stored side
    left = statespace.expand(statespace.level_rows(store, 9), 4).filter("NOT terminal")
    assert left.filter("occ IS NULL").count() == 0 < statespace.expand(statespace.level_rows(store, 9), 4).filter("terminal").count()


def test_a_run_stopped_amid_a_level_goes_on_with_the_shares_left(spark, tmp_path, monkeypatch):
    whole, halves = f"{tmp_path}/whole", f"{tmp_path}/halves"
    want = statespace.solve(spark, whole, 4, max_level=6)
    expanded, share = [], statespace._share

    def stopped(store, level, size, k, of):
        if level == 4 and k == 2:
            raise KeyboardInterrupt
        return share(store, level, size, k, of)

    monkeypatch.setattr(statespace, "_share", stopped)
    with pytest.raises(KeyboardInterrupt):
        statespace.solve(spark, halves, 4, max_level=6, ranges=4)
    store = LevelStore(spark, halves)
    assert store.deepest("boards") == 4 and [store.committed(f"share-5-{k}-of-4") for k in range(4)] == [True, True, False, False]
    monkeypatch.setattr(statespace, "_share", share)
    plain = statespace.expand
    monkeypatch.setattr(statespace, "expand", lambda rows, size: expanded.append(1) or plain(rows, size))
    assert statespace.solve(spark, halves, 4, max_level=6, ranges=4) == want
    assert len(expanded) == 2 + 4  # the two shares left of one level, all of the next
    for k in range(7):
        assert sorted(statespace.level_rows(store, k).collect()) == sorted(statespace.level_rows(LevelStore(spark, whole), k).collect())
    assert not any(store.committed(f"share-5-{k}-of-4") for k in range(4))


def test_counts_are_as_wide_as_needed_and_counted_anew_by_force(spark, tmp_path):
    path = str(tmp_path)
    statespace.solve(spark, path, 4)
    got = statespace.retrograde(spark, path, 4)
    store = LevelStore(spark, path)
    kinds = [store.read(f"counts-{k}").schema["black"].dataType.simpleString() for k in range(13)]
    assert kinds[12] == "tinyint" and kinds[0] == "smallint" and set(kinds) == {"tinyint", "smallint"}
    limits = dict(statespace.WIDTHS)
    for k, kind in enumerate(kinds):
        told = store.stats(f"counts-{k}")
        assert told["largest"] <= limits[kind] and told["width"] == kind and told["bytes"] > 0
    assert [statespace.width(n) for n in (127, 128, 1 << 31, 1 << 63)] == ["tinyint", "smallint", "bigint", "decimal(38,0)"]
    with pytest.raises(OverflowError):
        statespace.width(10**38)
    wrong = spark.createDataFrame([(1, 1, 1, 7, 7, 7)], "player byte, occ long, col long, black smallint, white smallint, tie smallint")
    store.write("counts-0", wrong, statespace._census, statespace.BOARD)
    assert statespace.retrograde(spark, path, 4)["black"] == 7
    assert statespace.retrograde(spark, path, 4, force=True) == got


def test_frontiers_of_boards_without_moves_end(spark):
    occ, col, player = boards.start()
    rows = spark.createDataFrame([(player, occ, col)], "player byte, occ long, col long")
    found = statespace.reachable(rows, 4).groupBy("ply").count().collect()
    levels = {r.ply: r["count"] for r in found}
    assert levels[0] == 1 and levels[1] == 1 and max(levels) == 12
    full = spark.createDataFrame([(1, int(boards.board_mask(4)), 0)], "player byte, occ long, col long")
    assert [r.ply for r in statespace.reachable(full, 4).collect()] == [0]
    assert statespace.reachable(rows.limit(0), 4).count() == 0
