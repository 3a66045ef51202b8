"""Kernel of :func:`gridtwin.operators.minimal_pairs.build_pairs`: all that is chosen for a pair, in the row of its grid.

Blocks of grids are laid end to end (see :mod:`gridtwin.operators.lattice`); a grid's edges are
made, weighed and thinned to its tree in the task that holds its row, and only short lists leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from gridtwin.functions.rng import draws
from gridtwin.operators.lattice import Lattice, cells_of_rows, forest, numbers, ragged, row_blocks, walks

PAIR = (
    "start int, goal int, parents array<int>, k bigint, near int, far int, start_side bigint, goal_side bigint, "
    "enter bigint, leave bigint, path_length bigint, candidates array<int>, extra array<int>, loop_count int"
)
NODE = "graph_id bigint, node int, parent int, enter bigint, leave bigint, depth bigint, size bigint"


def _edges(grids: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both ends (places in the block) and number of every pair of neighbouring cells, by grid and number."""
    right, down = np.flatnonzero(~grids.last_x), np.flatnonzero(~grids.last_y)
    a = np.concatenate([right, down])
    b = np.concatenate([right + 1, down + grids.width[down]])
    kind = np.repeat([0, 1], [len(right), len(down)])
    order = np.lexsort((kind, a))
    a, b, kind = a[order], b[order], kind[order]
    return a, b, 2 * grids.node[a] + kind


def _walked(grids: Lattice, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> dict[str, np.ndarray]:
    """``parent`` (-1 for roots), ``enter``, ``leave``, ``depth``, ``size`` of every cell; ``depth`` is -1 where a grid has no root."""
    found = {name: np.full(grids.size, -1, np.int64) for name in ("parent", "enter", "leave", "depth", "size")}
    owner = grids.grid[a]
    there = root[owner] >= 0
    a, b, owner = a[there], b[there], owner[there]
    columns = [owner, a - grids.base[owner], b - grids.base[owner], root[owner]]
    if len(owner):
        rows = pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["graph_id", "a", "b", "root"])
        for nodes in walks([rows]):
            at = grids.base[numbers(nodes, "graph_id")] + numbers(nodes, "node")
            for name, values in found.items():
                values[at] = numbers(nodes, name, -1)
    return found


def _first_of(owner: np.ndarray) -> np.ndarray:
    """Place of each row among those of its owner; owners come one after another."""
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    return np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))


def pairs_of_rows(tree_draws: int, cut_draws: int, extra_draws: int):
    """Rows of parameters with ``start`` and ``goal``, one for each graph, to ``graph_id`` and the columns of ``PAIR``."""

    def made(block: pa.RecordBatch) -> pa.RecordBatch:
        width, height, seed = (numbers(block, c) for c in ("width", "height", "seed"))
        grids = Lattice(width, height)
        n = block.num_rows
        a, b, edge_no = _edges(grids)
        owner = grids.grid[a]
        in_tree = np.zeros(len(a), bool)
        in_tree[forest(a, b, draws(seed[owner], tree_draws + edge_no), grids.size)] = True
        start, goal = numbers(block, "start", -1), numbers(block, "goal", -1).copy()
        rooted = start >= 0
        # the walk around the tree from the start; without one from cell 0, for the tree alone
        walk = _walked(grids, a[in_tree], b[in_tree], np.where(rooted, start, 0))
        far = np.flatnonzero(rooted & (goal < 0))
        if len(far):
            order = np.lexsort((grids.node, -walk["depth"], grids.grid))
            goal[far] = grids.node[order[grids.base[far]]]
        # ways from start to goal, by depth
        goals = np.where(rooted, grids.base + np.maximum(goal, 0), 0)
        over = (walk["enter"] <= walk["enter"][goals][grids.grid]) & (walk["leave"] >= walk["leave"][goals][grids.grid]) & rooted[grids.grid]
        way = np.flatnonzero(over & (walk["depth"] > 0))
        of = grids.grid[way]
        length = np.where(rooted, walk["depth"][goals], 0)
        goal_side = walk["size"][way]
        start_side = grids.count[of] - goal_side
        k = walk["depth"][way] - 1
        order = np.lexsort((k, -np.minimum(start_side, goal_side), of))
        rank = np.empty(len(way), np.int64)
        rank[order] = _first_of(of[order])
        drawn = draws(seed, np.array([cut_draws]))
        mode = block.column(block.schema.get_field_index("cut_mode")).to_pylist()
        position = block.column(block.schema.get_field_index("cut_pos")).cast(pa.float64())
        # the largest and smallest of numbers leave nulls out: without a position the last cut counts
        known = position.is_valid().to_numpy(zero_copy_only=False)
        at = np.floor(np.where(known, position.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0) * length)
        fixed = np.maximum(0, np.where(known, np.minimum(length - 1, at), length - 1)).astype(np.int64)
        is_mode = lambda name: np.array([m == name for m in mode], bool)[of]
        wanted = np.where(
            is_mode("random"), k == np.floor(drawn * length)[of],
            np.where(is_mode("fixed"), k == fixed[of], rank == np.floor(drawn * np.minimum(3, length))[of]),
        )
        cut = np.full(n, -1, np.int64)
        cut[of[wanted]] = way[wanted]
        chosen = cut >= 0
        entered, left = (np.where(chosen, walk[name][cut], -1) for name in ("enter", "leave"))
        beyond = (walk["enter"] >= entered[grids.grid]) & (walk["leave"] <= left[grids.grid])
        closed = np.flatnonzero(~in_tree & chosen[owner] & (beyond[a] == beyond[b]))
        pool = np.bincount(owner[closed], minlength=n)
        order = closed[np.lexsort((edge_no[closed], draws(seed[owner[closed]], extra_draws + edge_no[closed]), owner[closed]))]
        loops = np.minimum(numbers(block, "loops"), pool - 1)
        extra = order[_first_of(owner[order]) < (loops + 1)[owner[order]]]
        absent, cutless = ~rooted, ~chosen
        number = lambda values, none, kind: pa.array(values, kind, mask=none)
        side = np.where(chosen, walk["size"][cut], 0)
        parents = ragged(walk["parent"], grids.count, pa.int32())
        columns = [
            block.column(block.schema.get_field_index("graph_id")),
            number(start, absent, pa.int32()),
            number(goal, absent, pa.int32()),
            parents,
            number(np.where(chosen, walk["depth"][cut] - 1, 0), cutless, pa.int64()),
            number(np.where(chosen, walk["parent"][cut], 0), cutless, pa.int32()),
            number(np.where(chosen, grids.node[cut], 0), cutless, pa.int32()),
            number(grids.count - side, cutless, pa.int64()),
            number(side, cutless, pa.int64()),
            number(entered, cutless, pa.int64()),
            number(left, cutless, pa.int64()),
            number(length, cutless, pa.int64()),
            ragged(edge_no[closed], pool, pa.int32()),
            ragged(edge_no[extra], np.bincount(owner[extra], minlength=n), pa.int32()),
            pa.array(loops, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["graph_id", *(part.split()[0] for part in PAIR.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in row_blocks(batches, cells_of_rows):
            yield made(block)

    return run


def walks_of_parents(on_way: bool):
    """Rows ``graph_id, start, goal, parents`` to the nodes of their trees (see :func:`trees.rooted`), or those between start and goal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = lambda batch: batch.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for block in row_blocks(batches, size):
            count = size(block)
            grids = Lattice(count, np.ones(len(count), np.int64))
            parent = block.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            node = np.flatnonzero(parent >= 0)
            up = grids.base[grids.grid[node]] + parent[node]
            low, high = np.minimum(node, up), np.maximum(node, up)
            order = np.argsort(grids.grid[node], kind="stable")
            start, goal = numbers(block, "start", -1), numbers(block, "goal", -1)
            found = _walked(grids, low[order], high[order], start)
            kept = found["depth"] >= 0
            if on_way:
                goals = grids.base + np.maximum(goal, 0)
                kept &= (found["enter"] <= found["enter"][goals][grids.grid]) & (found["leave"] >= found["leave"][goals][grids.grid])
            at = np.flatnonzero(kept)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0).take(pa.array(grids.grid[at])),
                    pa.array(grids.node[at], pa.int32()),
                    pa.array(found["parent"][at], pa.int32(), mask=found["parent"][at] < 0),
                    *[pa.array(found[name][at], pa.int64()) for name in ("enter", "leave", "depth", "size")],
                ],
                names=[part.split()[0] for part in NODE.split(", ")],
            )

    return run
