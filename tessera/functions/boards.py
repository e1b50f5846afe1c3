"""Reversi boards as pairs of 64-bit words: occupied cells, and which of them are black.

Cells are numbered row by row on 8x8, the first in the highest bit; a smaller board lies in the middle.
All functions work on whole numpy arrays of unsigned words.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BLACK, WHITE = 1, 0
FULL = 0xFFFFFFFFFFFFFFFF
NOT_LEFT = U64(0x7F7F7F7F7F7F7F7F)
NOT_RIGHT = U64(0xFEFEFEFEFEFEFEFE)
#: The most moves that any board of so many rows has: fixed values.
MOST_MOVES = {4: 6, 6: 19, 8: 28}
#: (bits to the left if positive, cells that may be entered) for each of the eight directions.
DIRECTIONS = ((1, NOT_RIGHT), (-1, NOT_LEFT), (8, U64(FULL)), (-8, U64(FULL)), (9, NOT_RIGHT), (7, NOT_LEFT), (-7, NOT_RIGHT), (-9, NOT_LEFT))


def board_mask(size: int) -> np.uint64:
    edge = (8 - size) // 2
    if size not in (4, 6, 8):
        raise ValueError(f"boards have 4, 6 or 8 rows, not {size}")
    return U64(sum(1 << (63 - 8 * r - c) for r in range(edge, 8 - edge) for c in range(edge, 8 - edge)))


def start() -> tuple[int, int, int]:
    """Occupied, black and player of the first board: four discs in the middle, black to move."""
    return 0x0000001818000000, 0x0000000810000000, BLACK


def _step(cells: np.ndarray, direction: tuple[int, np.uint64]) -> np.ndarray:
    shift, entered = direction
    return (cells << U64(shift) if shift > 0 else cells >> U64(-shift)) & entered


def legal_moves(occupied: np.ndarray, black: np.ndarray, player: np.ndarray, size: int) -> np.ndarray:
    """Cells where the player may put a disc: beyond a line of the opponent's discs from an own one."""
    own = np.where(player == BLACK, black, occupied & ~black)
    other = occupied & ~own
    empty = board_mask(size) & ~occupied
    out = np.zeros_like(own)
    for direction in DIRECTIONS:
        line = _step(own, direction) & other
        for _ in range(size - 3):
            line |= _step(line, direction) & other
        out |= _step(line, direction) & empty
    return out


def turned(occupied: np.ndarray, black: np.ndarray, player: np.ndarray, move: np.ndarray, size: int) -> np.ndarray:
    """Discs that a move turns: in each direction, the opponent's up to the next own one."""
    own = np.where(player == BLACK, black, occupied & ~black)
    other = occupied & ~own
    out = np.zeros_like(own)
    for direction in DIRECTIONS:
        line = _step(move, direction) & other
        for _ in range(size - 3):
            line |= _step(line, direction) & other
        out |= np.where(_step(line, direction) & own, line, U64(0))
    return out


def play(occupied, black, player, move, size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The boards after the moves; the other player is next."""
    changed = turned(occupied, black, player, move, size) | move
    return occupied | move, np.where(player == BLACK, black | changed, black & ~changed), 1 - player


def _swap(x: np.ndarray, mask: int, shift: int) -> np.ndarray:
    return ((x >> U64(shift)) & U64(mask)) | ((x & U64(mask)) << U64(shift))


def upside_down(x: np.ndarray) -> np.ndarray:
    return x.byteswap()


def mirrored(x: np.ndarray) -> np.ndarray:
    for mask, shift in ((0x5555555555555555, 1), (0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4)):
        x = _swap(x, mask, shift)
    return x


def transposed(x: np.ndarray) -> np.ndarray:
    for mask, shift in ((0x00AA00AA00AA00AA, 7), (0x0000CCCC0000CCCC, 14), (0x00000000F0F0F0F0, 28)):
        moved = (x ^ (x >> U64(shift))) & U64(mask)
        x = x ^ moved ^ (moved << U64(shift))
    return x


def symmetries(x: np.ndarray) -> list[np.ndarray]:
    """The eight rotations and reflections."""
    out = []
    for base in (x, transposed(x)):
        out += [base, upside_down(base), mirrored(base), upside_down(mirrored(base))]
    return out


def canonical(occupied, black, player) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest of the 16 equivalent boards by (occupied, black, black to move first).

    The sixteen are the eight symmetries, each with the colours as they are and exchanged.
    """
    best = None
    for flat, own in zip(symmetries(occupied), symmetries(black), strict=True):
        for colors, who in ((own, player), (~own & flat, 1 - player)):
            if best is None:
                best = flat, colors, who
                continue
            o, c, p = best
            less = (flat < o) | ((flat == o) & ((colors < c) | ((colors == c) & (who > p))))
            best = np.where(less, flat, o), np.where(less, colors, c), np.where(less, who, p)
    return best


def children(occupied, black, player, size) -> dict[str, np.ndarray]:
    """All canonical children: parent is the row, flipped says that colours were exchanged.

    A player without a move passes: the opponent moves on the same board, and the child counts for the
    next level all the same.  A board where neither can move has no child.
    """
    moves = legal_moves(occupied, black, player, size)
    passing = moves == 0
    mover = np.where(passing, 1 - player, player)
    moves = np.where(passing, legal_moves(occupied, black, mover, size), moves)
    found = []
    cells = int(board_mask(size))
    for k in range(64):
        bit = 1 << k
        if not cells & bit:
            continue
        rows = np.flatnonzero(moves & U64(bit))
        if len(rows):
            found.append((rows, np.full(len(rows), bit, U64)))
    parent = np.concatenate([r for r, _ in found]) if found else np.zeros(0, np.int64)
    move = np.concatenate([m for _, m in found]) if found else np.zeros(0, U64)
    after = play(occupied[parent], black[parent], mover[parent], move, size)
    kept = canonical(*after)
    return {"parent": parent, "occupied": kept[0], "black": kept[1], "player": kept[2], "flipped": kept[2] != after[2], "passes": passing & (moves != 0), "terminal": moves == 0, "n_moves": np.bitwise_count(moves)}
