"""Generated rooms: ground plans, mechanics and what is left out."""

from collections import Counter, deque

import pytest

from gridtwin.operators import edits, layouts

SIZE = 16


@pytest.fixture(scope="module")
def made(spark):
    tries = [(room, 100 + room, room) for room in range(20)] + [(50, 7, None), (51, None, 1), (None, 9, 2)]
    rows = layouts.generated_rooms(spark.createDataFrame(tries, "room_id long, seed long, attempt int"), SIZE)
    return {r["room_id"]: r for r in rows.collect()}


def grid(row):
    return [line.split(" ") for line in row["text"].removesuffix("\n").split("\n")]


def distances(cells, start):
    found, todo = {start: 0}, deque([start])
    while todo:
        x, y = todo.popleft()
        for at in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if cells[at[1]][at[0]] != ".+#" and at not in found:
                found[at] = found[(x, y)] + 1
                todo.append(at)
    return found


def test_every_try_with_id_and_seed_is_a_room(made):
    assert set(made) == {*range(20), 50}
    for room, row in made.items():
        cells = grid(row)
        assert [len(line) for line in cells] == [SIZE] * SIZE
        tokens = Counter(cell for line in cells for cell in line)
        assert tokens[".+p"] == tokens[".+G"] == 1
        assert row["type"] == layouts.TYPES[room % 5 if room < 50 else 0]
        assert row["name"] == f"gen-{row['type']}-{row['layout']}-{row['seed']}"
        assert all(cells[y][x] == ".+#" for x in range(SIZE) for y in range(SIZE) if {x, y} & {0, SIZE - 1})
    assert {r["layout"] for r in made.values()} == {"maze", "field"}


def test_mazes_connect_all_their_cells(made):
    mazes = [r for r in made.values() if r["layout"] == "maze"]
    for row in mazes:
        cells = grid(row)
        start = next((x, y) for y in range(SIZE) for x in range(SIZE) if cells[y][x] == ".+p")
        reached = distances(cells, start)
        rooms = {(x, y) for x in range(1, 14, 2) for y in range(1, 14, 2)}
        assert rooms <= set(reached)
        # a tree of 49 cells has 48 passages; 2 to 4 loops were asked for
        assert 48 <= len(reached) - len(rooms) <= 52


def test_each_kind_has_its_own_mechanic(made):
    own = {"maze": set(), "ice": {"i"}, "boxes": {".+M0", ".+M1", ".+M2"}, "holes": {"+", ".+f"}, "orange": {".+O", ".+M0", ".+o"}}
    for row in made.values():
        tokens = Counter(cell for line in grid(row) for cell in line)
        special = set(tokens) - {".", ".+#", ".+p", ".+G"}
        assert special <= own[row["type"]]
        assert (".+M0" in tokens) == (".+o" in tokens) or row["type"] == "boxes"
    kinds = {row["type"] for row in made.values() if set("".join(row["text"].split())) & set("iMfO")}
    assert {"ice", "boxes", "orange"} <= kinds


def test_generated_rooms_can_be_edited(spark, made):
    levels = spark.createDataFrame([(r["room_id"], r["text"]) for r in made.values()], "room_id long, text string")
    counts = {(r["room_id"], r["type"]): r["count"] for r in edits.enumerate_edits(levels).groupBy("room_id", "type").count().collect()}
    for room, row in made.items():
        floor = Counter(cell for line in grid(row) for cell in line)["."]
        assert counts[(room, "add_wall")] == floor and counts[(room, "move_gem")] == floor


def test_no_rooms_and_unknown_mechanics(spark):
    none = spark.createDataFrame([], "room_id long, seed long, attempt int")
    assert layouts.generated_rooms(none).collect() == []
    with pytest.raises(ValueError, match="no mechanics"):
        layouts.mechanics({}, "maze")
