"""Fields: every room gets one, and what was drawn in vain is listed."""

from collections import Counter

import pytest

from gridtwin.operators import fields, sampling


def reach(cells, start, size):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for step in (1, -1, size, -size):
            if at + step in cells and at + step not in seen:
                seen.add(at + step)
                todo.append(at + step)
    return seen


def test_every_room_with_a_seed_has_a_field(spark):
    size, seeds = 9, {1: 11, 2: 12, 3: 13, 4: 14}
    rooms = spark.createDataFrame([*seeds.items(), (5, None), (None, 3)], "room_id long, seed long")
    field = fields.obstacle_fields(rooms, size)
    ends = {r["room_id"]: r for r in field["ends"].collect()}
    assert set(ends) == set(seeds)
    cells = field["cells"].collect()
    assert Counter(r["room_id"] for r in cells) == dict.fromkeys(seeds, size * size)
    for room, r in ends.items():
        open_cells = {c["node"] for c in cells if c["room_id"] == room and c["open"]}
        reached = reach(open_cells, r["start"], size)
        assert len(reached) >= fields.SMALLEST_FIELD and r["goal"] in reached
    refused = field["rejected"].collect()
    assert {r["room_id"] for r in refused if r["attempt"] is None} == {5, None}
    tried = {}
    for r in refused:
        if r["attempt"] is not None:
            tried.setdefault(r["room_id"], set()).add(r["attempt"])
    assert tried and all(a == set(range(len(a))) for a in tried.values())


def test_fields_too_small_to_succeed_are_refused(spark):
    with pytest.raises(ValueError, match="fewer than 20"):
        fields.obstacle_fields(spark.createDataFrame([(1, 1)], "room_id long, seed long"), 6)


def test_each_item_of_a_large_group_has_one_twin(spark):
    rows = [("a", k, k % 2 == 0) for k in range(50)] + [("b", 100, True), (None, 200, True), (None, 201, False), ("a", None, True)]
    found = sampling.twins(spark.createDataFrame(rows, "pair string, id long, solvable boolean")).collect()
    assert {r["id"]: (r["twin_id"], r["twin_solvable"]) for r in found} == {0: (49, False)} | {k: (0, True) for k in range(1, 50)}
    assert len(found) == 50
