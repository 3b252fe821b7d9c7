"""Columns that make and read prompts, depth grids and candidate scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.actions import COMMANDS
from tessera.functions.geometry import wrap_degrees
from tessera.functions.text import col

# The texts of a prompt.
ACTION_SPACE = ", ".join(COMMANDS)
PLAIN = "<image>\nWhat action should the UAV take to find {target}? Choose exactly one command from: {actions}. Reply with only the command."
WITH_CONTEXT = "<image>\nTarget: {target}\n\n{context}\n\nWhat action should the UAV take to find the target? Choose exactly one command from: {actions}. Reply with only the command."


def _filled(template: str, **parts: Column) -> Column:
    pieces, rest = [], template.replace("{actions}", ACTION_SPACE)
    while rest:
        at = min((rest.find("{" + k + "}"), k) for k in parts if "{" + k + "}" in rest) if any("{" + k + "}" in rest for k in parts) else None
        if at is None:
            pieces.append(F.lit(rest))
            break
        pieces += [F.lit(rest[: at[0]]), parts[at[1]]]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*pieces)


def build_prompt(description: Column | str, depth: Column | None = None, memory: Column | None = None) -> Column:
    """The prompt for a target description, with the contexts that are not empty, parted by blank lines."""
    target = F.regexp_replace(F.lower(F.trim(F.coalesce(col(description), F.lit("")))), "[ .]+$", "")
    given = [F.nullif(F.trim(c), F.lit("")) for c in (depth, memory) if c is not None]
    plain = _filled(PLAIN, target=target)
    if not given:
        return plain
    context = F.concat_ws("\n\n", *given)
    return F.when(F.length(context) > 0, _filled(WITH_CONTEXT, target=target, context=context)).otherwise(plain)


def extract_description(prompt: Column | str) -> Column:
    """The target of a plain prompt: from the question's words to the first question mark."""
    start = "What action should the UAV take to find "
    after = F.substring_index(col(prompt), start, -1)
    return F.when(F.instr(col(prompt), start) > 0, F.substring_index(after, "?", 1))


def short_number(c: Column) -> Column:
    """Six significant digits without trailing zeros, as %g has them for values from 1e-4 to under 1e6."""
    digits = F.floor(F.log10(F.greatest(F.abs(c), F.lit(1e-4)))).cast("int")
    out = F.format_string("%.6f", c)
    for d in range(-4, 6):
        out = F.when(digits == d, F.format_string(f"%.{5 - d}f", c)).otherwise(out)
    out = F.when(out.contains("."), F.regexp_replace(out, r"\.?0+$", "")).otherwise(out)
    return F.when(c == 0, F.lit("0")).otherwise(out)


def grid_text(grid: Column | str) -> Column:
    """An n x n grid as bracketed rows, one a line."""
    rows = F.transform(col(grid), lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, short_number), ", "), F.lit("]")))
    return F.concat(F.lit("["), F.array_join(rows, ",\n "), F.lit("]"))


def far_grid(n: int = 3, meters: float = 100.0) -> Column:
    return F.array_repeat(F.array_repeat(F.lit(meters), n), n)


def forward_clearance(grid: Column | str) -> Column:
    """The lesser of the middle and the lower middle cell; null where either is missing."""
    a, b = (F.try_element_at(F.try_element_at(col(grid), F.lit(r)), F.lit(2)) for r in (2, 3))
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def forward_clear(grid: Column | str, meters: float) -> Column:
    return F.coalesce(forward_clearance(grid) > meters, F.lit(False))


def grids_match(a: Column | str, b: Column | str, atol: float = 1e-4) -> Column:
    """Whether both are 3 x 3 and equal but for a tolerance."""
    square = lambda g: (F.size(g) == 3) & F.forall(g, lambda r: F.size(r) == 3)
    gaps = F.zip_with(F.flatten(col(a)), F.flatten(col(b)), lambda p, q: F.abs(p - q))
    return F.coalesce(square(col(a)) & square(col(b)) & F.forall(gaps, lambda d: d <= atol), F.lit(False))


def redirect(action_id: Column, clearance: Column, left: Column, right: Column, near: float = 2.0, leaves: Column | None = None, toward: Column | None = None) -> Column:
    """(action_id, changed, reason): an unsafe forward (1) becomes a turn.

    Out of bounds (``leaves``) it becomes ``toward``, the turn to the start; near
    an obstacle the turn to the deeper side, left (2) on a tie.
    """
    outside = F.lit(False) if leaves is None else F.coalesce(leaves, F.lit(False))
    near_by = F.coalesce(clearance <= near, F.lit(False))
    reason = F.when(action_id != 1, F.lit(None)).when(outside, "forward_out_of_search_bounds").when(near_by, "forward_near_obstacle")
    new = F.when(reason == "forward_out_of_search_bounds", toward if toward is not None else action_id).when(reason == "forward_near_obstacle", F.when(left >= right, 2).otherwise(3)).otherwise(action_id)
    return F.struct(new.alias("action_id"), (new != action_id).alias("changed"), reason.alias("reason"))


def softmax(scores: Column | str) -> Column:
    """A map of label to score as a map of label to probability."""
    top = F.array_max(F.map_values(col(scores)))
    up = F.transform_values(col(scores), lambda _, v: F.exp(v - top))
    total = F.aggregate(F.map_values(up), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(up, lambda _, v: v / total)


def argmax_label(scores: Column | str, labels: tuple[str, ...] = COMMANDS) -> Column:
    """The label of the largest score; of equal ones the first in the order given."""
    pairs = [F.struct(F.element_at(col(scores), F.lit(x)).alias("score"), F.lit(-k).alias("order"), F.lit(x).alias("label")) for k, x in enumerate(labels)]
    return F.array_max(F.filter(F.array(*pairs), lambda s: s["score"].isNotNull()))["label"]


def js_divergence(p: Column | str, q: Column | str) -> Column:
    """Jensen-Shannon divergence of two aligned distributions, natural logarithm; zeros add nothing."""

    def half(a: Column, b: Column) -> Column:
        terms = F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.ln(x / ((x + y) / 2))).otherwise(0.0))
        return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)

    return (half(col(p), col(q)) + half(col(q), col(p))) / 2


def heading_error(relative: Column, turn: Column) -> Column:
    return F.abs(wrap_degrees(relative - turn))
