"""Columns over the six actions: names, commands, vectors, free texts, and what an action does to a pose."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.geometry import wrap_degrees
from tessera.functions.text import _first, col

# An action's name, its command, and its place in the action vector with the value there.
ACTIONS = {
    "Stop": ("stop", 0, 1.0),
    "Move Forward": ("forward 3m", 1, 3.0),
    "Turn Left": ("turn left 30 degree", 2, 30.0),
    "Turn Right": ("turn right 30 degree", 3, 30.0),
    "Ascend": ("ascend 3m", 4, 3.0),
    "Descend": ("descend 3m", 5, 3.0),
}
COMMANDS = tuple(command for command, _, _ in ACTIONS.values())
TURNS = ("turn left 30 degree", "turn right 30 degree")
TRANSLATIONS = ("forward 3m", "ascend 3m", "descend 3m")
# The words that name a command, in the order in which they are tried.
_WORDS = (
    ("stop", r"\bstop\b"),
    ("forward 3m", r"\bforward\b"),
    ("turn left 30 degree", r"\b(turn left|left turn)\b"),
    ("turn right 30 degree", r"\b(turn right|right turn)\b"),
    ("ascend 3m", r"\b(ascend|go up|up)\b"),
    ("descend 3m", r"\b(descend|go down|down)\b"),
)


def lookup(table: dict[str, str], c: Column | str) -> Column:
    """The value of a small fixed table; null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), col(c))


def name_to_command(c: Column | str, strict: bool = True) -> Column:
    """The command of an action's name; other names raise, or give null where not strict."""
    found = lookup({name: command for name, (command, _, _) in ACTIONS.items()}, c)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown action "), F.coalesce(col(c), F.lit("null"))))) if strict else found


def command_id(c: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, COMMANDS)), col(c)) - 1


def vector_to_name(c: Column | str, atol: float = 1e-4, rtol: float = 1e-5) -> Column:
    """The action whose vector of eight is the same but for a tolerance; null for other vectors."""

    def same(v: Column, name: str) -> Column:
        _, place, value = ACTIONS[name]
        expected = [value if k == place else 0.0 for k in range(8)]
        # The place of the value first: it alone tells most other vectors apart.
        near = [F.abs(F.element_at(v, k + 1) - expected[k]) <= atol + rtol * abs(expected[k]) for k in sorted(range(8), key=lambda k: k != place)]
        return reduce(and_, near)

    named = lambda v: F.when(F.size(v) == 8, _first([(same(v, n), F.lit(n)) for n in ACTIONS], F.lit(None).cast("string")))
    return F.element_at(F.transform(F.array(col(c)), named), 1)  # so that the vector is made once, not at each comparison


# Of the older vectors, the place and the value there by id.
LEGACY = ((0, 1), (1, 3), (2, 15), (3, 15), (4, 2), (5, 2), (6, 5), (7, 5), (1, 6), (1, 9))


def legacy_id(c: Column | str) -> Column:
    """The id of an older action vector of eight single-precision values, which must be met exactly; 0 for any other, and for null."""
    own = F.transform(F.coalesce(col(c), F.array()), lambda x: x.cast("float"))
    exact = [F.array(*(F.lit(float(value if k == place else 0)).cast("float") for k in range(8))) for place, value in LEGACY]
    return F.coalesce(F.nullif(F.array_position(F.array(*exact), own), F.lit(0)) - 1, F.lit(0)).cast("int")


def normalize_command(c: Column | str) -> Column:
    """A free text as a command: first line, lower case, units made equal, the first command that a word of it names; else the text."""
    t = F.substring_index(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), "\n", 1)
    t = F.regexp_replace(t, "[`\"'.,;:!?]", " ")
    t = F.regexp_replace(t, r"\b(meters?|metres?)\b", "m")
    t = F.regexp_replace(t, r"\bdegrees?\b", "degree")
    t = F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), "3 m", "3m")
    return _first([(t.rlike(pattern), F.lit(command)) for command, pattern in _WORDS], t)


def parse_action(c: Column | str) -> Column:
    """(command, action_id, matched); what names no command is stop, unmatched."""
    command = normalize_command(c)
    known = command.isin(*COMMANDS)
    return F.struct(
        F.when(known, command).otherwise("stop").alias("command"),
        F.when(known, command_id(command)).otherwise(0).cast("int").alias("action_id"),
        known.alias("matched"),
    )


def derive_action(dx: Column, dy: Column, dz: Column, dyaw: Column, down_positive: bool = True, right_positive: bool = True, wrap: bool = True) -> Column:
    """The action between two poses, by their differences (yaw in degrees); a last pose without follower (nulls) is Stop.

    Vertical if |dz| >= 1 and at least the horizontal move; turn if |dyaw| >= 15
    and at least three times that; forward if the move is >= 1; else turn if
    |dyaw| >= 15; else Stop. The two conventions of the data differ in signs.
    """
    turn = wrap_degrees(dyaw) if wrap else dyaw
    move = F.sqrt(dx * dx + dy * dy)
    vertical = F.when((dz > 0) == F.lit(down_positive), F.lit("Descend")).otherwise(F.lit("Ascend"))
    rotation = F.when((turn > 0) == F.lit(right_positive), F.lit("Turn Right")).otherwise(F.lit("Turn Left"))
    return _first(
        [
            (dx.isNull() | dy.isNull() | dz.isNull() | dyaw.isNull(), F.lit("Stop")),
            ((F.abs(dz) >= 1) & (F.abs(dz) >= move), vertical),
            ((F.abs(turn) >= 15) & (F.abs(turn) >= 3 * move), rotation),
            (move >= 1, F.lit("Move Forward")),
            (F.abs(turn) >= 15, rotation),
        ],
        F.lit("Stop"),
    )


def pose_after(x: Column, y: Column, z: Column, yaw: Column, action_id: Column, step: float = 3.0, flip_vertical: bool = False, flip_yaw: bool = False) -> Column:
    """(x, y, z, yaw) after one of ten actions; yaw in radians, wrapped to [-pi, pi)."""
    ahead = F.when(action_id == 1, step).when(action_id == 8, 2 * step).when(action_id == 9, 3 * step).otherwise(0.0)
    aside = F.when(action_id == 6, step).when(action_id == 7, -step).otherwise(0.0)
    rise = F.when(action_id == 4, step).when(action_id == 5, -step).otherwise(0.0) * (-1 if flip_vertical else 1)
    turn = F.when(action_id == 2, math.radians(30)).when(action_id == 3, -math.radians(30)).otherwise(0.0) * (-1 if flip_yaw else 1)
    return F.struct(
        (x + ahead * F.cos(yaw) - aside * F.sin(yaw)).alias("x"),
        (y + ahead * F.sin(yaw) + aside * F.cos(yaw)).alias("y"),
        (z + rise).alias("z"),
        (F.pmod(yaw + turn + math.pi, F.lit(2 * math.pi)) - math.pi).alias("yaw"),
    )
