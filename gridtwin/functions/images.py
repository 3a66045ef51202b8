"""Which rendered images of an item to show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def angles_of(images: Column) -> Column:
    """Camera rotations an item was rendered from, ascending; only 0 where none are listed."""
    listed = F.array_sort(F.transform(F.map_keys(images["yaws"]), lambda key: key.cast("int")))
    return F.coalesce(listed, F.array(F.lit(0)))


def normalise_angles(listed: Column) -> Column:
    """``"-90,450,45"`` to quarter turns in [0, 360), others dropped."""
    numbers = F.transform(F.split(listed, ","), lambda part: F.pmod(F.trim(part).try_cast("double"), F.lit(360.0)))
    return F.transform(F.filter(numbers, lambda angle: angle % 90 == 0), lambda angle: angle.cast("int"))


def image_paths(images: Column, view: str = "perspective", angles: str = "0") -> Column:
    """Paths for a view and a list of rotations (``"0,180"`` or ``"all"``); missing images drop out.

    Rotation 0 falls back to the plain perspective image.
    """
    if view == "top":
        paths = F.array(images["top"])
    else:
        if angles == "all":
            wanted = F.coalesce(
                F.array_sort(F.transform(F.map_keys(images["yaws"]), lambda key: key.cast("int"))),
                F.array().cast("array<int>"),
            )
        else:
            wanted = F.array(*[F.lit(int(part)) for part in angles.split(",") if part.strip()]).cast("array<int>")
        paths = F.transform(
            wanted,
            lambda angle: F.coalesce(
                F.nullif(F.try_element_at(images["yaws"], angle.cast("string")), F.lit("")),
                F.when(angle == 0, images["perspective"]),
            ),
        )
    return F.filter(paths, lambda path: F.coalesce(path, F.lit("")) != "")
