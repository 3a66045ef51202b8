"""Seeded open-field rooms and the mechanics placed in them.

Rooms are ``room_id, seed``. A field is drawn inside its room's row as a bit
board; its cells are then a table ``room_id, node, x, y`` with ``open``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from gridtwin.functions.rng import draw_int, draws
from gridtwin.operators.boards import WORD, holds
from gridtwin.operators.lattice import Lattice, list_values, numbers, ragged, with_column
from gridtwin.session import cut, spread

# Wall density, wall bars, smallest usable field, ice share.
DENSITY, DENSITY_SPREAD = 0.18, 0.12
BARS, BAR_SHORTEST, BAR_LENGTHS = 6, 2, 3
SMALLEST_FIELD = 20
ICE_SHARE, ICE_SPREAD = 0.35, 0.4

# Draws of one seed are numbered; each use has its own block of a million numbers.
SHAPE, OPEN, BAR, START, ICE, PLACE, SPOT, TURN = (block << 20 for block in range(16, 24))

# Each further attempt at a field moves its draws on by eight blocks.
ATTEMPT_BITS = 23
MOST_ATTEMPTS = 256

# Directions in the order in which a box is turned.
WAYS = ((1, 0), (-1, 0), (0, 1), (0, -1))


def field_cells(seed: np.ndarray, attempt: int, size: int) -> np.ndarray:
    """[rooms, size * size] open cells of one attempt: border and seeded walls are closed, and seeded bars of 2 to 4 cells."""
    number = lambda first: first + (attempt << ATTEMPT_BITS)
    node = np.arange(size * size)
    x, y = node % size, node // size
    share = DENSITY + draws(seed, number(SHAPE)) * DENSITY_SPREAD
    open_ = draws(seed[:, None], number(OPEN) + node) >= share[:, None]
    for bar in range(BARS):
        a, b, c, d = (draws(seed, number(BAR) + bar * 4 + i)[:, None] for i in range(4))
        at_x, at_y = np.floor(a * (size - 2)) + 1, np.floor(b * (size - 2)) + 1
        length = np.floor(d * BAR_LENGTHS) + BAR_SHORTEST
        flat = (y == at_y) & (x >= at_x) & (x < at_x + length)
        upright = (x == at_x) & (y >= at_y) & (y < at_y + length)
        open_ &= ~np.where(c < 0.5, flat, upright)
    return open_ & (x > 0) & (y > 0) & (x < size - 1) & (y < size - 1)


def _drawn_fields(block: pa.RecordBatch, size: int) -> pa.Array:
    """``attempt, open, start, goal, path`` of the first attempt of each room whose start reaches enough cells."""
    cells = size * size
    column = lambda name: block.column(block.schema.get_field_index(name))
    usable = column("room_id").is_valid().to_numpy(zero_copy_only=False) & column("seed").is_valid().to_numpy(zero_copy_only=False)
    seed = numbers(block, "seed")
    rooms = len(seed)
    attempt, start, goal = (np.full(rooms, -1) for _ in range(3))
    boards = np.zeros((rooms, cells), bool)
    paths: list[np.ndarray] = [np.zeros(0, np.int64)] * rooms
    waiting = np.flatnonzero(usable)
    for turn in range(MOST_ATTEMPTS):
        if not len(waiting):
            break
        open_ = field_cells(seed[waiting], turn, size)
        place = draws(seed[waiting][:, None], START + (turn << ATTEMPT_BITS) + np.arange(cells))
        first = np.where(open_, place, 2.0).argmin(axis=1)  # the lowest cell among equals
        side = np.full(len(waiting), size)
        grids = Lattice(side, side)
        flat = open_.reshape(-1)
        grids.open_passages(flat & np.append(flat[1:], False), flat & np.append(flat[size:], np.zeros(size, bool)))
        dist = grids.flood((grids.base + first)[open_.any(axis=1)])
        by_room = dist.reshape(-1, cells)
        good = (by_room >= 0).sum(axis=1) >= SMALLEST_FIELD
        far = by_room.argmax(axis=1)
        done = waiting[good]
        attempt[done], start[done], goal[done], boards[done] = turn, first[good], far[good], open_[good]
        ways, lengths = grids.paths(dist, (grids.base + far)[good])
        for room, way in zip(done.tolist(), np.split(ways, np.cumsum(lengths)[:-1])):
            paths[room] = way
        waiting = waiting[~good]
    absent = attempt < 0
    words = (boards.reshape(rooms, size, size) * (np.int64(1) << np.arange(size))).sum(axis=2)
    whole = lambda values: pa.array(values, pa.int32(), mask=absent)
    return pa.StructArray.from_arrays(
        [
            whole(attempt),
            ragged(words[~absent].reshape(-1), np.where(absent, 0, size), pa.int64(), absent),
            whole(start),
            whole(goal),
            ragged(np.concatenate([*paths, np.zeros(0, np.int64)]), np.array([len(p) for p in paths], np.int64), pa.int32(), absent),
        ],
        names=["attempt", "open", "start", "goal", "path"],
    )


FIELD = StructType(
    [
        StructField("attempt", IntegerType()),
        StructField("open", ArrayType(LongType())),
        StructField("start", IntegerType()),
        StructField("goal", IntegerType()),
        StructField("path", ArrayType(IntegerType())),
    ]
)


def cells_of_boards(boards: DataFrame, size: int, *carry: str) -> DataFrame:
    """``room_id, node, x, y, open`` of all cells of the boards (room_id, open)."""
    node = F.col("node")
    every = boards.select("room_id", "open", *carry, F.explode(F.sequence(F.lit(0), F.lit(size * size - 1))).alias("node"))
    x, y = node % size, F.floor(node / size).cast("int")
    return every.select("room_id", *carry, "node", x.alias("x"), y.alias("y"), holds(F.col("open"), node, F.lit(size)).alias("open"))


def steps_of_paths(paths: DataFrame) -> DataFrame:
    return paths.select("room_id", F.posexplode("path").alias("k", "node"))


def obstacle_fields(rooms: DataFrame, size: int = 16) -> dict[str, DataFrame]:
    """Seeded fields with a start and the farthest reachable cell as goal.

    A field whose start reaches fewer than 20 cells is drawn again, until
    the room has one; all of it happens in one pass over the rooms, without a shuffle
    but the one that deals them out. Tables: ``rooms`` (room_id, seed), ``boards`` (room_id, open: a word
    of bits per row of cells), ``cells`` (all cells of them), ``ends`` (room_id, start, goal),
    ``paths`` (room_id, path), ``solution`` (room_id, k, node) and ``rejected`` (room_id, attempt,
    reason: fields drawn in vain, and rooms without id or seed). ``size`` is at most 50.
    """
    if (size - 2) ** 2 < SMALLEST_FIELD:
        raise ValueError(f"a field of side {size} has fewer than {SMALLEST_FIELD} cells")
    if size > WORD:
        raise ValueError(f"a field has at most {WORD} cells a side, not {size}")
    usable = F.col("room_id").isNotNull() & F.col("seed").isNotNull()
    drawn = with_column(
        spread(rooms.select("room_id", "seed")),
        "field",
        FIELD,
        lambda block: _drawn_fields(block, size),
        lambda batch: np.full(batch.num_rows, size * size),
    )
    made = cut(drawn, "fields")
    lost = made.where(usable & F.col("field.attempt").isNull()).limit(1).count()
    if lost:
        raise RuntimeError(f"a room without a field after {MOST_ATTEMPTS} attempts")
    good = made.where(usable)
    boards, paths = good.select("room_id", "field.open"), good.select("room_id", "field.path")
    vain = good.where("field.attempt > 0").select("room_id", F.explode(F.sequence(F.lit(0), F.col("field.attempt") - 1)).alias("attempt"))
    nameless = made.where(~usable).select("room_id", F.lit(None).cast("int").alias("attempt"), F.lit("no id or seed").alias("reason"))
    return {
        "rooms": made.select("room_id", "seed"),
        "boards": boards,
        "cells": cells_of_boards(boards, size),
        "ends": good.select("room_id", "field.start", "field.goal"),
        "paths": paths,
        "solution": steps_of_paths(paths),
        "rejected": vain.withColumn("reason", F.lit("too few reachable cells")).unionAll(nameless),
    }


def _without(board: Column, cells: Column, size: int) -> Column:
    """A board with the listed cells cleared."""

    def cleared(word: Column, y: Column) -> Column:
        here = F.filter(cells, lambda n: F.floor(n / size) == y)
        bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), (n % size).cast("int"))
        return F.aggregate(here, word, lambda w, n: w.bitwiseAND(F.bitwise_not(bit(n))))

    return F.transform(board, cleared)


def _free_rooms(field: dict[str, DataFrame], size: int, taken: DataFrame | None = None) -> DataFrame:
    """A row per room: the ends' coordinates, ``_own`` board of free cells, and ``_free``, those of all rows of the room.

    Rooms meet here while they are one row each; their cells are listed afterwards
    and never joined. Cells ``taken`` (room_id, node) are not free.
    """
    ends = field["ends"].select(
        "room_id",
        "start",
        "goal",
        (F.col("start") % size).alias("start_x"),
        F.floor(F.col("start") / size).cast("int").alias("start_y"),
        (F.col("goal") % size).alias("goal_x"),
        F.floor(F.col("goal") / size).cast("int").alias("goal_y"),
    )
    rooms = field["boards"].join(ends, "room_id")
    gone = F.array("start", "goal")
    if taken is not None:
        rooms = rooms.join(taken.groupBy("room_id").agg(F.collect_set("node").alias("_taken")), "room_id", "left")
        gone = F.concat(gone, F.coalesce("_taken", F.array().cast("array<int>")))
    rooms = rooms.withColumn("_own", _without(F.col("open"), gone, size)).drop("open", "start", "goal", "_taken")
    return rooms.withColumn("_free", F.collect_list("_own").over(Window.partitionBy("room_id")))


class _Block:
    """Rooms of :func:`_free_rooms`, a block of them at a time, as arrays [rooms, size * size]."""

    def __init__(self, block: pa.RecordBatch, size: int):
        self.block, self.size, self.rooms = block, size, block.num_rows
        self.node = np.arange(size * size)
        self.x, self.y = self.node % size, self.node // size

    def column(self, name: str) -> pa.Array:
        return self.block.column(self.block.schema.get_field_index(name))

    def own(self) -> np.ndarray:
        return _cells_of_words(list_values(self.block, "_own")[0], self.size)

    def free(self) -> np.ndarray:
        """How many rows of the room have the cell free."""
        boards = self.column("_free")
        each = boards.value_lengths().to_numpy(zero_copy_only=False)
        cells = _cells_of_words(boards.flatten().flatten().to_numpy(zero_copy_only=False), self.size).astype(np.int32)
        return np.add.reduceat(cells, np.cumsum(each) - each, axis=0) if self.rooms else cells

    def around(self) -> np.ndarray:
        """Free cells among the four neighbours."""
        free = self.free()
        return sum(self.beside(free, dx, dy) for dx, dy in WAYS)

    def beside(self, cells: np.ndarray, dx: int, dy: int) -> np.ndarray:
        """What the cells ``dx, dy`` further on hold; nothing beside the board."""
        board = np.pad(cells.reshape(-1, self.size, self.size), ((0, 0), (1, 1), (1, 1)))
        return board[:, 1 + dy : 1 + dy + self.size, 1 + dx : 1 + dx + self.size].reshape(cells.shape)

    def steps(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Steps to a cell of each room."""
        return np.abs(self.x - x[:, None]) + np.abs(self.y - y[:, None])

    def farther(self, distance: int, mark: str) -> np.ndarray:
        known = self.column(f"{mark}_x").is_valid().to_numpy(zero_copy_only=False)
        return known[:, None] & (self.steps(numbers(self.block, f"{mark}_x"), numbers(self.block, f"{mark}_y")) > distance)

    def on_path(self) -> np.ndarray:
        """How often a path comes by."""
        nodes, sizes = list_values(self.block, "_path")
        cells = len(self.node)
        inside = (nodes >= 0) & (nodes < cells)
        at = np.repeat(np.arange(self.rooms), sizes)[inside] * cells + nodes[inside]
        return np.bincount(at, minlength=self.rooms * cells).reshape(-1, cells)

    def draws(self, number: np.ndarray) -> np.ndarray:
        """The seeds' numbers; -1, before all others, without a seed."""
        known = self.column("seed").is_valid().to_numpy(zero_copy_only=False)
        return np.where(known[:, None], draws(numbers(self.block, "seed")[:, None], number), -1.0)

    def lists(self, room: np.ndarray, **columns: np.ndarray) -> pa.Array:
        """An array column from entries in order of their rooms; a number below 0 in ``u`` or ``v`` is null."""
        ends = np.concatenate([[0], np.cumsum(np.bincount(room, minlength=self.rooms))]).astype(np.int32)
        values = [
            pa.array(v, pa.float64(), mask=v < 0) if name in ("u", "v") else pa.array(v).cast(pa.bool_() if v.dtype == bool else pa.int32())
            for name, v in columns.items()
        ]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(values, names=list(columns)))


def _cells_of_words(words: np.ndarray, size: int) -> np.ndarray:
    """[boards, size * size] cells of boards of a word per row, one after another."""
    return ((words.reshape(-1, size, 1) >> np.arange(size)) & 1 == 1).reshape(-1, size * size)


def _lowest(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rooms and cells of the ``most`` smallest keys of each room, in order; the smallest cells among equals, none at infinity."""
    key, every = key.copy(), np.arange(len(key))
    rooms, cells = [], []
    for _ in range(most):
        cell = key.argmin(axis=1)
        there = key[every, cell] < np.inf
        rooms.append(every[there])
        cells.append(cell[there])
        key[every, cell] = np.inf
    room = np.concatenate(rooms)
    order = np.argsort(room, kind="stable")
    return room[order], np.concatenate(cells)[order]


def _of_rooms(rooms: DataFrame, size: int, name: str, kind: str, made: Callable[[_Block], pa.Array]) -> DataFrame:
    """Rooms with a column made from many of them at a time."""

    def cells(batch: pa.RecordBatch) -> np.ndarray:
        at = batch.schema.get_field_index("_free")
        boards = np.ones(batch.num_rows, np.int64) if at < 0 else batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
        return size * size * boards

    return with_column(rooms, name, DataType.fromDDL(kind), lambda block: made(_Block(block, size)), cells)


def _placed(node: Column, size: int) -> tuple[Column, Column]:
    return (node % size).alias("x"), F.floor(node / size).cast("int").alias("y")


def free_cells(field: dict[str, DataFrame], size: int) -> DataFrame:
    """Open cells that are neither start nor goal, with both ends' coordinates (and ``_around``, such cells of the room beside it)."""

    def listed(block: _Block) -> pa.Array:
        room, node = np.nonzero(block.own())
        return block.lists(room, node=node, _around=block.around()[room, node])

    made = _of_rooms(_free_rooms(field, size), size, "_cells", "array<struct<node: int, _around: int>>", listed).drop("_own", "_free")
    cells = made.withColumn("_cell", F.explode("_cells")).select("*", "_cell.*").drop("_cells", "_cell")
    return cells.select("*", *_placed(F.col("node"), size))


def with_open_neighbours(free: DataFrame) -> DataFrame:
    """Number of free cells among the four neighbours (``around``) of cells as :func:`free_cells` lists them."""
    return free.withColumn("around", F.col("_around").cast("bigint")).drop("_around")


def farther_than(distance: int, mark: str) -> Column:
    """Whether a cell is more than ``distance`` steps from the marked cell (``start`` or ``goal``)."""
    return F.abs(F.col("x") - F.col(f"{mark}_x")) + F.abs(F.col("y") - F.col(f"{mark}_y")) > distance


def frozen_cells(field: dict[str, DataFrame], size: int) -> DataFrame:
    """Free cells that turn to ice, with a seeded share per room."""

    def frozen(block: _Block) -> pa.Array:
        u = block.draws(ICE + 1 + block.node)
        share = ICE_SHARE + block.draws(np.array([ICE])) * ICE_SPREAD
        room, node = np.nonzero(block.own() & (u >= 0) & (u < share))
        return block.lists(room, node=node)

    rooms = _free_rooms(field, size).select("room_id", "_own").join(field["rooms"], "room_id")
    made = _of_rooms(rooms, size, "_cells", "array<struct<node: int>>", frozen)
    return made.select("room_id", F.inline("_cells")).select("room_id", "node", *_placed(F.col("node"), size))


def _with_paths(rooms: DataFrame, paths: DataFrame) -> DataFrame:
    """Rooms with ``_path``, the cells of all their paths."""
    return rooms.join(paths.groupBy("room_id").agg(F.flatten(F.collect_list("path")).alias("_path")), "room_id", "left")


def _first_cells(field: dict[str, DataFrame], size: int, most: int, fits: Callable[[_Block, np.ndarray], np.ndarray]) -> DataFrame:
    """1 to ``most`` seeded cells per room, those on a path first, numbered ``i`` from 0.

    ``fits`` tells the cells to choose from, given how often a path comes by each; a cell counts that
    often. Each row of a room names its first cells, among which those of the room are.
    """

    def first(block: _Block) -> pa.Array:
        times = block.on_path()
        u = block.draws(PLACE + 1 + block.node)
        spots = block.own() & fits(block, times)
        room, node = _lowest(np.where(spots, u - 4.0 * (times > 0), np.inf), most)
        again = np.clip(times[room, node], 1, most)
        room, node = np.repeat(room, again), np.repeat(node, again)
        return block.lists(room, u=u[room, node], node=node, on_path=times[room, node] > 0)

    rooms = _with_paths(_free_rooms(field, size), field["paths"]).join(field["rooms"], "room_id")
    made = _of_rooms(rooms, size, "_spots", "array<struct<u: double, node: int, on_path: boolean>>", first)
    place = Window.partitionBy("room_id").orderBy(F.col("on_path").desc(), "u", "node")
    return (
        made.select("room_id", "seed", F.inline("_spots"))
        .withColumn("_rank", F.row_number().over(place))
        .where(F.col("_rank") <= most)
        .where(F.col("_rank") <= draw_int(F.col("seed"), PLACE, most) + 1)
        .select("room_id", (F.col("_rank") - 1).alias("i"), "node", *_placed(F.col("node"), size), "on_path")
    )


def placed_boxes(field: dict[str, DataFrame], size: int) -> DataFrame:
    """One to three boxes per room, on the solution first, with room to push and away from both ends."""
    return _first_cells(
        field, size, 3, lambda block, times: (block.around() >= 2) & block.farther(2, "start") & block.farther(1, "goal")
    )


def placed_holes(field: dict[str, DataFrame], size: int) -> DataFrame:
    """One or two pits per room, only on the solution and away from both ends."""
    return _first_cells(field, size, 2, lambda block, times: (times > 0) & block.farther(2, "start") & block.farther(1, "goal"))


def hole_fillers(field: dict[str, DataFrame], holes: DataFrame, size: int) -> DataFrame:
    """A floor tile per pit: the first seeded spot 2 to 5 steps away, else the spot with the pit's number."""

    def spots(block: _Block) -> np.ndarray:
        """The spots' seeded numbers, infinity elsewhere."""
        fits = block.own() & (block.around() >= 2) & block.farther(1, "start")
        return np.where(fits, block.draws(SPOT + block.node), np.inf)

    def found(block: _Block) -> pa.Array:
        """The first two spots, for pit -1, and the first near each pit, numbered by its place in ``_pits``."""
        key = spots(block)
        room, node = _lowest(key, 2)
        pits = block.column("_pits")
        each = pits.value_lengths().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(block.rooms), each)
        pit = np.arange(len(owner)) - (np.cumsum(each) - each)[owner]
        x, y = (pc.struct_field(pits.flatten(), name).to_numpy(zero_copy_only=False) for name in ("x", "y"))
        apart = block.steps(x, y)
        near, near_node = _lowest(np.where((apart >= 2) & (apart <= 5), key[owner], np.inf), 1)
        rooms = np.concatenate([room, owner[near]])
        nodes, of = np.concatenate([node, near_node]), np.concatenate([np.full(len(room), -1), pit[near]])
        order = np.argsort(rooms, kind="stable")
        rooms, nodes = rooms[order], nodes[order]
        return block.lists(rooms, pit=of[order], u=key[rooms, nodes], node=nodes)

    pits = holes.groupBy("room_id").agg(F.collect_list(F.struct("i", "node", "x", "y")).alias("_pits"))
    rooms = _free_rooms(field, size, holes.select("room_id", "node")).join(field["rooms"], "room_id").join(pits, "room_id")
    made = _of_rooms(rooms, size, "_found", "array<struct<pit: int, u: double, node: int>>", found)
    # a room listed more than once has the first spots of all its rows
    whole = made.groupBy("room_id").agg(F.max("_pits").alias("_pits"), F.array_sort(F.flatten(F.collect_list("_found"))).alias("_found"))

    def filler(pit: Column, place: Column) -> Column:
        of = lambda number: F.filter("_found", lambda spot: spot["pit"] == number)
        first_two = F.slice(of(F.lit(-1)), 1, 2)
        return F.struct(pit["node"].alias("hole"), F.coalesce(F.get(of(place), F.lit(0))["node"], F.get(first_two, pit["i"])["node"]).alias("filler"))

    return whole.select("room_id", F.inline(F.transform("_pits", filler))).where(F.col("filler").isNotNull())


def button_lines(field: dict[str, DataFrame], size: int) -> DataFrame:
    """A held-down wall on the solution, and a box with its button in a free line of three.

    The box stands between the button and a free cell for the pusher; spots
    and directions are tried in seeded order. Rooms without such a line have
    null box and button.
    """

    def away(block: _Block) -> np.ndarray:
        return block.own() & block.farther(1, "start") & block.farther(1, "goal")

    def wall(block: _Block) -> pa.Array:
        u = block.draws(PLACE + block.node)
        room, node = _lowest(np.where(away(block) & (block.on_path() > 0), u, np.inf), 1)
        return block.lists(room, u=u[room, node], node=node)

    def line(block: _Block) -> pa.Array:
        held = numbers(block.block, "wall")
        standing = (block.free() > 0) & (block.node != held[:, None])
        spots = away(block) & (block.steps(held % size, held // size) > 1)
        u = block.draws(SPOT + block.node)
        # the turn is drawn only where a line is free
        v = np.full((len(WAYS), *u.shape), np.inf)
        for way, (dx, dy) in enumerate(WAYS):
            free = spots & block.beside(standing, dx, dy) & block.beside(standing, -dx, -dy)
            v[way] = np.where(free, block.draws(TURN + block.node * 4 + way), np.inf)
        room, node = _lowest(np.where((v < np.inf).any(axis=0), u, np.inf), 1)
        turn = v[:, room, node]
        # without a seed all turns are alike: the smallest button
        steps = np.array([dx + dy * size for dx, dy in WAYS])
        way = np.lexsort((np.broadcast_to(steps[:, None], turn.shape), turn), axis=0)[0]
        return block.lists(room, u=u[room, node], node=node, v=turn[way, np.arange(len(room))], button=node + steps[way])

    rooms = _with_paths(_free_rooms(field, size), field["paths"]).join(field["rooms"], "room_id")
    walls = _of_rooms(rooms, size, "_wall", "array<struct<u: double, node: int>>", wall).drop("_path")
    of_room = F.min(F.get("_wall", F.lit(0))).over(Window.partitionBy("room_id"))
    held = walls.withColumn("wall", of_room["node"]).drop("_wall").where(F.col("wall").isNotNull())
    made = _of_rooms(held, size, "_line", "array<struct<u: double, node: int, v: double, button: int>>", line)
    first = made.groupBy("room_id", "wall").agg(F.min(F.get("_line", F.lit(0))).alias("f"))
    return first.select("room_id", "wall", F.col("f.node").alias("box"), F.col("f.button").alias("button"))


def field_levels(field: dict[str, DataFrame], changes: DataFrame | None = None, size: int = 16) -> DataFrame:
    """Cells of the rooms with player, gem and changed cells ``(room_id, node, cell)`` written in."""
    cells = cells_of_boards(field["boards"].join(field["ends"], "room_id"), size, "start", "goal")
    plain = (
        F.when(F.col("node") == F.col("start"), ".+p")
        .when(F.col("node") == F.col("goal"), ".+G")
        .when(F.col("open"), ".")
        .otherwise(".+#")
    )
    if changes is None:
        return cells.select("room_id", "x", "y", plain.alias("cell"))
    changed = changes.select("room_id", "node", F.col("cell").alias("_changed"))
    return cells.join(changed, ["room_id", "node"], "left").select(
        "room_id", "x", "y", F.coalesce("_changed", plain).alias("cell")
    )


def _texts_of_fields(block: pa.RecordBatch, size: int) -> pa.Array:
    """Level texts of rooms ``_rooms`` (open, start, goal of each time a room is listed)."""
    listed = block.column(block.schema.get_field_index("_rooms"))
    each = listed.value_lengths().to_numpy(zero_copy_only=False)
    fields, owner = listed.flatten(), np.repeat(np.arange(len(each)), each)
    node = np.arange(size * size)
    at = lambda name: pc.fill_null(pc.struct_field(fields, name), -1).to_numpy(zero_copy_only=False)[:, None]
    # cells are numbered in the order of their texts: those of one place stand in that order
    cell = 1 - _cells_of_words(pc.struct_field(fields, "open").flatten().to_numpy(zero_copy_only=False), size).astype(np.int64)
    cell[node == at("goal")] = 2
    cell[node == at("start")] = 3
    places = ((owner[:, None] * len(node) + node) * 4 + cell).reshape(-1)
    if len(owner) > len(each):
        places.sort()
    cell, place = places % 4, places // 4
    last = np.append(place[1:] != place[:-1], True) & (place % size == size - 1)
    length = np.where(cell == 0, 2, 4)
    ends = np.cumsum(length)
    octets = np.full(int(length.sum()), ord("."), np.uint8)
    octets[ends - 1] = np.where(last, ord("\n"), ord(" "))
    stacked = cell > 0
    octets[ends[stacked] - 3] = ord("+")
    octets[ends[stacked] - 2] = np.frombuffer(b".#Gp", np.uint8)[cell[stacked]]
    of_room = np.concatenate([[0], np.cumsum(np.bincount(place // len(node), weights=length, minlength=len(each)).astype(np.int64))])
    return pa.LargeStringArray.from_buffers(len(each), pa.py_buffer(of_room), pa.py_buffer(octets)).cast(pa.string())


def field_texts(field: dict[str, DataFrame], size: int = 16) -> DataFrame:
    """``room_id, text``: the level text of :func:`field_levels` and :func:`rooms.cells_level`, written inside the room's row.

    Cells of repeated rooms stand beside each other.
    """
    rooms = field["boards"].join(field["ends"], "room_id").groupBy("room_id")
    rooms = rooms.agg(F.collect_list(F.struct("open", "start", "goal")).alias("_rooms"))

    def cells(batch: pa.RecordBatch) -> np.ndarray:
        return size * size * batch.column(batch.schema.get_field_index("_rooms")).value_lengths().to_numpy(zero_copy_only=False)

    return with_column(rooms, "text", StringType(), lambda block: _texts_of_fields(block, size), cells).select("room_id", "text")
