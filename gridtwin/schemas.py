"""Declared schemas of the exchanged files; nothing is inferred."""

from __future__ import annotations

# ``cut`` is a word or a number
MAZE_PARAMS = (
    "struct<width: int, height: int, seed: bigint, algorithm: string, placement: string, minDistance: int, cut: variant, "
    "loops: int>"
)
POINTS = "array<array<int>>"
MAZE_META = (
    f"struct<algorithm: string, placement: string, cut: variant, loopsRequested: int, loops: int, treePathLength: int, "
    f"treePath: {POINTS}, cutEdge: {POINTS}, cutIndex: int, openedEdge: {POINTS}, loopEdges: array<{POINTS}>, "
    f"componentSizes: array<int>, pocketFrac: double, passages: int, wallsBalanced: boolean, solutionLength: int, "
    f"solution: {POINTS}>"
)
MAZE = (
    f"id string, version string, width int, height int, seed bigint, params {MAZE_PARAMS}, solvable boolean, "
    f"start array<int>, goal array<int>, `right` array<array<int>>, down array<array<int>>, meta {MAZE_META}"
)
LABEL = (
    "id string, seed bigint, solvable int, split string, pair bigint, width int, height int, tree_path_length int, "
    "solution_length int, pocket_frac double, component_min int, loops int, cut_index int, start_x int, start_y int, "
    "goal_x int, goal_y int"
)
CORPUS_CONFIG = (
    f"n bigint, pairs boolean, base_seed bigint, min_path int, seeds_skipped_for_min_path bigint, splits array<double>, "
    f"preset string, maze_params {MAZE_PARAMS.replace('seed: bigint, ', '')}, version string"
)
WORLD_EXPORT = (
    "version string, title string, world struct<width: int, height: int>, "
    "levels array<struct<id: string, cells: array<array<string>>>>"
)
WORLD_MAP = "levels map<string, array<string>>"
