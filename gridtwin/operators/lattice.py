"""Kernels on many grids laid end to end in flat arrays: floods, connected parts, spanning forests, walks around trees.

Spark deals the grids' rows to tasks; a task takes them in blocks of about ``MOST_CELLS`` cells.
Cell ``node`` of a grid is at ``base + node`` of its block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

MOST_CELLS = 1 << 18
MOST_EDGES = 1 << 17  # of a graph that one task may hold
BLOCK_EDGES = 1 << 21  # of a graph too large for one task, that are looked at together
NONE = np.iinfo(np.int64).max


class Lattice:
    """The grids of a block with the open passages between their cells."""

    def __init__(self, width: np.ndarray, height: np.ndarray):
        self.count = np.maximum(width, 0) * np.maximum(height, 0)
        self.base = np.cumsum(self.count) - self.count
        self.size = int(self.count.sum())
        self.grid = np.repeat(np.arange(len(width)), self.count)
        self.node = np.arange(self.size) - self.base[self.grid]
        self.width = width[self.grid]
        self.x, self.y = self.node % np.maximum(self.width, 1), self.node // np.maximum(self.width, 1)
        self.last_x, self.last_y = self.x == self.width - 1, self.y == height[self.grid] - 1

    def open_passages(self, right: np.ndarray, down: np.ndarray) -> None:
        self.right, self.down = right & ~self.last_x, down & ~self.last_y
        self.left, self.up = np.zeros(self.size, bool), np.zeros(self.size, bool)
        a = np.flatnonzero(self.right)
        self.left[a + 1] = True
        b = np.flatnonzero(self.down)
        self.up[b + self.width[b]] = True
        self.a = np.concatenate([a, b])
        self.b = np.concatenate([a + 1, b + self.width[b]])

    def flood(self, starts: np.ndarray) -> np.ndarray:
        """Steps of every cell from its grid's start, -1 where there is no way."""
        dist = np.full(self.size, -1, np.int32)
        mark = np.zeros(self.size, np.int64)
        front, steps = starts, 0
        while len(front):
            dist[front] = steps
            steps += 1
            down, up = front[self.down[front]], front[self.up[front]]
            beside = [front[self.right[front]] + 1, front[self.left[front]] - 1, down + self.width[down], up - self.width[up]]
            near = np.concatenate(beside)
            near = near[dist[near] < 0]
            mark[near] = np.arange(len(near))
            front = near[mark[near] == np.arange(len(near))]
        return dist

    def paths(self, dist: np.ndarray, goals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of a shortest path to each goal reached, one path after another, and their lengths; smallest previous cells first."""
        length = dist[goals].astype(np.int64) + 1
        ends = np.cumsum(length)
        out = np.zeros(int(length.sum()), np.int64)
        here, at = goals.copy(), ends - 1
        live = np.arange(len(goals))
        while len(live):
            cells = here[live]
            out[at[live]] = self.node[cells]
            go = dist[cells] > 0
            live, cells = live[go], cells[go]
            wanted, before = dist[cells] - 1, np.full(len(cells), -1)
            width = self.width[cells]
            for side, step in ((self.down, width), (self.right, 1), (self.left, -1), (self.up, -width)):
                near = np.clip(cells + step, 0, self.size - 1)
                fits = side[cells] & (dist[near] == wanted)
                before[fits] = near[fits]  # the last one that fits is the smallest cell
            here[live], at[live] = before, at[live] - 1
        return out, length

    def lowest(self) -> np.ndarray:
        """The smallest cell connected to each cell."""
        label = np.arange(self.size)
        a, b = self.a, self.b
        while len(a):
            at_a, at_b = label[a], label[b]
            apart = at_a != at_b
            a, b, at_a, at_b = a[apart], b[apart], at_a[apart], at_b[apart]
            np.minimum.at(label, np.maximum(at_a, at_b), np.minimum(at_a, at_b))
            label = to_roots(label)
        return label


def to_roots(pointer: np.ndarray) -> np.ndarray:
    """Each pointer followed to its end; roots point at themselves."""
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            return pointer
        pointer = further


def row_blocks(batches, cells: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``MOST_CELLS`` cells each, a row of more by itself."""
    for batch in batches:
        before = np.concatenate([[0], np.cumsum(cells(batch))])
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(before, before[at] + MOST_CELLS, "right")) - 1, at + 1)
            yield batch.slice(at, to - at)
            at = to


def numbers(batch: pa.RecordBatch, name: str, empty: int = 0) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.int64()).fill_null(empty).to_numpy(zero_copy_only=False)


def list_values(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of an array column one after another, and how many each row has."""
    column = batch.column(batch.schema.get_field_index(name))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes


def ragged(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType, absent: np.ndarray | None = None) -> pa.Array:
    """An array column; ``absent`` rows are null."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = pa.array(values).cast(kind)
    if absent is None or not absent.any():
        return pa.ListArray.from_arrays(pa.array(ends), flat)
    mask = np.append(absent, False)
    return pa.ListArray.from_arrays(pa.array(ends, mask=mask), flat)


def with_column(df: DataFrame, name: str, kind: DataType, made: Callable[[pa.RecordBatch], pa.Array], cells) -> DataFrame:
    """``df`` with a column made from its rows block by block."""
    schema = StructType([*df.schema.fields, StructField(name, kind)])

    def run(batches):
        for block in row_blocks(batches, cells):
            yield pa.record_batch([*block.columns, made(block)], names=[*block.schema.names, name])

    return df.mapInArrow(run, schema)


# --- boards ---------------------------------------------------------------------------
def lattice_of_boards(block: pa.RecordBatch, word: int) -> Lattice:
    """The grids of a block of rows ``width, height, right, down`` (bit boards)."""
    width, height = numbers(block, "width"), numbers(block, "height")
    grids = Lattice(width, height)
    words = -(-width // word)

    def cells(name: str) -> np.ndarray:
        values, sizes = list_values(block, name)
        first = (np.cumsum(sizes) - sizes)[grids.grid]
        at = first + grids.y * words[grids.grid] + grids.x // word
        return (values[at] >> (grids.x % word)) & 1 == 1 if grids.size else np.zeros(0, bool)

    grids.open_passages(cells("right"), cells("down"))
    return grids


def cells_of_rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.maximum(numbers(batch, "width"), 0) * np.maximum(numbers(batch, "height"), 0)


def floods(block: pa.RecordBatch, start: str, word: int) -> pa.Array:
    """Steps from the start cell to each cell, null without a start."""
    grids = lattice_of_boards(block, word)
    at = numbers(block, start, -1)
    dist = grids.flood((grids.base + at)[(at >= 0) & (at < grids.count)])
    absent = block.column(block.schema.get_field_index(start)).is_null().to_numpy(zero_copy_only=False)
    return ragged(dist[~absent[grids.grid]], np.where(absent, 0, grids.count), pa.int32(), absent)


def parts(block: pa.RecordBatch, word: int) -> pa.Array:
    """``number`` of each cell's part, ``sizes`` and ``lows`` (smallest cells) of the parts in order of those."""
    grids = lattice_of_boards(block, word)
    low = grids.lowest()
    roots = np.flatnonzero(low == np.arange(grids.size))
    owner = grids.grid[roots]
    of_grid = np.bincount(owner, minlength=len(grids.count))
    place = np.zeros(grids.size, np.int64)
    place[roots] = np.arange(len(roots)) - (np.cumsum(of_grid) - of_grid)[owner]
    sizes = np.bincount(low, minlength=grids.size)[roots]
    return pa.StructArray.from_arrays(
        [
            ragged(place[low], grids.count, pa.int32()),
            ragged(sizes, of_grid, pa.int32()),
            ragged(grids.node[roots], of_grid, pa.int32()),
        ],
        names=["number", "sizes", "lows"],
    )


# --- tables of edges ---------------------------------------------------------------------
def whole_groups(batches, key: str) -> Iterator[pa.RecordBatch]:
    """Rows that come in order of ``key``, in runs that never part a group; a run is a batch and the rest of its last group."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(ids, ids[-1], "left"))
        if last or (kept and kept[-1].column(batch.schema.get_field_index(key))[0].as_py() != ids[0]):
            head = [*kept, batch.slice(0, last)] if last else kept
            yield pa.Table.from_batches(head).combine_chunks().to_batches()[0]
            kept = []
        kept.append(batch.slice(last))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def cells_of_edges(graph: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different nodes of rows in order of graph: their graphs (numbered) and names, and where each a and b is among them."""
    number = np.cumsum(np.append(False, graph[1:] != graph[:-1]))
    low = int(min(a.min(), b.min()))
    span = int(max(a.max(), b.max())) - low + 1
    keys, place = np.unique(np.concatenate([number * span + (a - low), number * span + (b - low)]), return_inverse=True)
    return keys // span, keys % span + low, place[: len(a)], place[len(a) :]


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, nodes: int) -> np.ndarray:
    """Numbers of the edges of the minimum spanning forest; ties by a, then b."""
    order = np.lexsort((b, a, weight))
    a, b = a[order], b[order]
    component = np.arange(nodes)
    live = np.arange(len(order))
    taken = np.zeros(len(order), bool)
    at_a, at_b = a.copy(), b.copy()
    while True:
        at_a[live], at_b[live] = component[a[live]], component[b[live]]
        live = live[at_a[live] != at_b[live]]
        if not len(live):
            return order[taken]
        lightest = np.full(nodes, NONE)
        np.minimum.at(lightest, at_a[live], live)
        np.minimum.at(lightest, at_b[live], live)
        roots = np.flatnonzero(lightest != NONE)
        edge = lightest[roots]
        taken[edge] = True
        pointer = np.arange(nodes)
        pointer[roots] = at_a[edge] + at_b[edge] - roots
        mutual = roots[(pointer[pointer[roots]] == roots) & (roots < pointer[roots])]
        pointer[mutual] = mutual
        component = to_roots(pointer)[component]


def forests(batches) -> Iterator[pa.RecordBatch]:
    """``graph_id, a, b`` of the forests of rows ``graph_id, a, b, w`` in order of graph."""
    for block in whole_groups(batches, "graph_id"):
        graph, a, b = (numbers(block, c) for c in ("graph_id", "a", "b"))
        weight = block.column(3).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
        names, _, at_a, at_b = cells_of_edges(graph, a, b)
        yield block.select(["graph_id", "a", "b"]).take(pa.array(forest(at_a, at_b, weight, len(names))))


def thinned(batches) -> Iterator[pa.RecordBatch]:
    """Of rows ``graph_id, ca, cb, weight, a, b`` (integers and no nulls, a weight that doubles hold) those in the forest of their block.

    An edge that is not is the heaviest on a cycle of its block (ties by a, then b), so no forest of the whole graph has it.
    """
    kept: list[pa.RecordBatch] = []

    def block() -> pa.Table:
        rows = pa.Table.from_batches(kept)
        graph, a, b = (rows.column(i).cast(pa.int64()).to_numpy() for i in (0, 1, 2))
        names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        number = np.unique(graph, return_inverse=True)[1]
        if number.any():  # nodes of several graphs
            names, place = np.unique(np.tile(number, 2) * len(names) + place, return_inverse=True)
        weight = rows.column(3).cast(pa.float64()).to_numpy()
        return rows.take(pa.array(forest(place[: len(a)], place[len(a) :], weight, len(names))))

    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
        if sum(part.num_rows for part in kept) >= BLOCK_EDGES:
            yield from block().to_batches()
            kept = []
    if kept:
        yield from block().to_batches()


def walks(batches) -> Iterator[pa.RecordBatch]:
    """Nodes of rooted trees, from rows ``graph_id, a, b, root`` in order of graph: see :func:`trees.rooted`."""
    for block in whole_groups(batches, "graph_id"):
        graph, a, b, root = (numbers(block, c) for c in ("graph_id", "a", "b", "root"))
        owner, name, at_a, at_b = cells_of_edges(graph, a, b)
        count = len(owner)
        first = np.flatnonzero(np.append(True, graph[1:] != graph[:-1]))
        # both directions of each edge, by node and name of the neighbour
        u, v = np.concatenate([at_a, at_b]), np.concatenate([at_b, at_a])
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        degree = np.bincount(u, minlength=count)
        begin = np.cumsum(degree) - degree
        parent, depth = np.full(count, -1), np.full(count, -1)
        level = np.flatnonzero(name == root[first][owner])
        levels = []
        depth[level] = 0
        while len(level):
            levels.append(level)
            arcs = np.repeat(begin[level] - (np.cumsum(degree[level]) - degree[level]), degree[level]) + np.arange(int(degree[level].sum()))
            arcs = arcs[depth[v[arcs]] < 0]
            parent[v[arcs]] = u[arcs]
            level = v[arcs]
            depth[level] = len(levels)
        size = np.ones(count, np.int64)
        for level in reversed(levels[1:]):
            np.add.at(size, parent[level], size[level])
        # children in the order of the walk: names after the parent's first, then from the smallest on
        enter = np.zeros(count, np.int64)
        for level in levels[1:]:
            up = parent[level]
            wrapped = (parent[up] >= 0) & (level < parent[up])
            turn = np.lexsort((level, wrapped, up))
            level, up = level[turn], up[turn]
            steps = 2 * size[level]
            before = np.cumsum(steps) - steps
            group = np.flatnonzero(np.append(True, up[1:] != up[:-1]))
            own = before - np.repeat(before[group], np.diff(np.append(group, len(up))))
            enter[level] = enter[up] + 1 + own
        kept = np.flatnonzero(depth >= 0)
        ids = graph[first][owner]
        yield pa.record_batch(
            [
                pa.array(ids[kept]),
                pa.array(name[kept]).cast(pa.int32()),
                pa.array(np.where(parent >= 0, name[parent], 0)[kept], mask=parent[kept] < 0).cast(pa.int32()),
                pa.array(enter[kept]),
                pa.array((enter + 2 * size - 1)[kept]),
                pa.array(depth[kept].astype(np.int64)),
                pa.array(size[kept]),
            ],
            names=["graph_id", "node", "parent", "enter", "leave", "depth", "size"],
        )


def in_order(rows: DataFrame) -> DataFrame:
    """Whole graphs in one task each, one after another."""
    return rows.repartition("graph_id").sortWithinPartitions("graph_id")


def all_small(edges: DataFrame, dense: int = 8) -> bool:
    """Whether every graph has an id, few enough edges for a task to hold it, and at most ``dense`` for each number its nodes span."""
    low, high = F.min(F.least("a", "b")), F.max(F.greatest("a", "b"))
    sizes = edges.groupBy("graph_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("bad"), (high - low + 1).alias("span")
    )
    crowded = F.count_if(F.col("n") > dense * F.col("span"))
    found = sizes.agg(F.max("n"), F.count_if(F.col("graph_id").isNull()), F.sum("bad"), crowded).first()
    return found[0] is not None and found[0] <= MOST_EDGES and not found[1] and not found[2] and not found[3]
