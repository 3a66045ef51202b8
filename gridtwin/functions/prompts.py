"""The question put to a model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of the questions.
MAZE_QUESTION = (
    "Is there a path from S to G that does not cross any wall? Think it through, then end your reply with a single "
    'line that says exactly "ANSWER: YES" if the maze is solvable or "ANSWER: NO" if it is not.'
)
MAZE_TEXT_FORM = (
    'Below is a maze in text form: "#" is wall, "." is open floor, S is the start and G is the goal. '
    "Moves go up, down, left or right between adjacent open cells. "
)
MAZE_BOTH_FORMS = (
    'The same maze is also given in text form below: "#" is wall, "." is open floor, S is the start and G is the goal. '
)
WALLS_DARK, WALLS_LIGHT = "white lines on a black background", "black lines on a white background"
MARKER_LETTERS = "The letters S and G mark the start and the goal."
MARKER_DOTS = "Two identical discs mark the two endpoints, S and G."
MARKER_GRAY = "A filled gray disc marks the start S and a gray ring marks the goal G."
MARKER_COLOUR = "A green disc marks the start S and a red disc marks the goal G."
ROOM_RULES = (
    "The room is a 16 by 16 grid of cells seen from above. The green cube is the player; it moves up, down, left or "
    "right one cell at a time. The cyan gem is collected by stepping onto its cell. Dark blocks are walls: they cannot be "
    "entered, and a raised block can only be reached by a lift or an ice slope. Tan cells are floor. Light blue cells are ice: "
    "the player slides across ice until a wall, an object or a non-ice cell stops it. Blue cubes are boxes that the player "
    "can push one cell at a time if the cell beyond is free; boxes with the same number are joined and move together, and "
    "a box cannot leave the room. Purple ramps are ice slopes that carry a slide up or down one level. Green squares are lifts: "
    "standing on a lowered lift raises the player one level, and a raised lift lowers it. Orange walls block the way and drop "
    "only while an orange button is held down by the player or by a box; every button in the room must be held at once. "
    "Black gaps in the floor are pits: anything walking into a pit is lost, but a floating floor tile can be pushed into a pit "
    "to fill it. Punchers launch whatever stops in front of them across the room. Clones copy every move the player makes. "
    "The edges of the room are not passable."
)
ROOM_QUESTION = (
    "Can the player collect the gem, that is, does some sequence of moves end with the player on the gem? Think it through, "
    'then end your reply with a single line that says exactly "ANSWER: YES" if the room is solvable or "ANSWER: NO" if it is not.'
)
ROOM_TEXT_FORM = "The room is given below in the text form that agents playing the game receive."
ROOM_BOTH_FORMS = ", and the same room is also given below in the text form that agents playing the game receive."
LEGEND_INTRO = (
    " Each cell is drawn as a block of characters: the top rows show what is on top of the cell and the bottom row shows "
    "its side, so taller stacks are taller blocks. Legend: "
)
ONE_IMAGE, SEVERAL_IMAGES = "The image shows the room", "images show the room from the game camera rotated in 90-degree steps"
JSON_INTRO = "\n\nJSON observation:\n"


def _column(value: Column | str | bool) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def maze_prompt(
    representation: Column | str = "image",
    markers: Column | str = "sg",
    grayscale: Column | bool = False,
    theme: Column | str = "light",
) -> Column:
    """Question about a maze shown as ``image``, ``ascii`` or ``both``."""
    representation, markers, grayscale, theme = map(_column, (representation, markers, grayscale, theme))
    walls = F.when(theme == "dark", WALLS_DARK).otherwise(WALLS_LIGHT)
    marked = (
        F.when(markers == "letters", MARKER_LETTERS)
        .when(markers == "dots", MARKER_DOTS)
        .when(grayscale, MARKER_GRAY)
        .otherwise(MARKER_COLOUR)
    )
    picture = F.concat(F.lit("The image shows a maze. Walls are drawn as "), walls, F.lit(". "), marked, F.lit(" "))
    lead = (
        F.when(representation == "ascii", MAZE_TEXT_FORM)
        .when(representation == "both", F.concat(picture, F.lit(MAZE_BOTH_FORMS)))
        .otherwise(picture)
    )
    return F.concat(lead, F.lit(MAZE_QUESTION))


def room_prompt(
    game: str,
    representation: Column | str = "image",
    legend: Column | None = None,
    view: Column | str = "perspective",
    images: Column | int = 1,
) -> Column:
    """Question about a room of ``game``; ``legend`` is a map of glyphs, listed in order.

    With several images the sentence about the image gives their number.
    """
    representation, view = _column(representation), _column(view)
    count = F.lit(images) if isinstance(images, int) else images
    glyphs = F.lit("")
    if legend is not None:
        entries = F.transform(
            F.array_sort(F.map_entries(legend)),
            lambda e: F.concat(F.lit('"'), e["key"], F.lit('" = '), e["value"]),
        )
        listed = F.concat(F.lit(LEGEND_INTRO), F.array_join(entries, ", "), F.lit("."))
        glyphs = F.when(F.coalesce(F.size(legend), F.lit(0)) > 0, listed).otherwise("")
    camera = F.when(view == "top", " from directly above").otherwise(" from the game camera")
    shown = F.when(count > 1, F.concat(F.lit("The "), count.cast("string"), F.lit(f" {SEVERAL_IMAGES}"))).otherwise(ONE_IMAGE)
    form = (
        F.when(representation.isin("ascii", "json"), F.concat(F.lit(ROOM_TEXT_FORM), glyphs, F.lit(" ")))
        .when(representation == "both", F.concat(shown, camera, F.lit(ROOM_BOTH_FORMS), glyphs, F.lit(" ")))
        .otherwise(F.concat(shown, camera, F.lit(". ")))
    )
    opening = f"This is one room from {game}, a 3D block-puzzle game. {ROOM_RULES} "
    return F.concat(F.lit(opening), form, F.lit(ROOM_QUESTION))
