"""Answer options of a multiple-choice item."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four bearings, their opposites and their quarter turns.
BEARINGS = ["ahead of you", "to your right", "behind you", "to your left"]
OPPOSITE = {
    "ahead of you": "behind you",
    "behind you": "ahead of you",
    "to your left": "to your right",
    "to your right": "to your left",
}
ORTHOGONAL = {
    "ahead of you": "to your right",
    "behind you": "to your left",
    "to your left": "ahead of you",
    "to your right": "behind you",
}
# Options added when a pool is short.
FILLERS = BEARINGS + ["on the floor", "on/in the Shelf", "on/in the Sofa", "on/in the Table"]
KEYS = ["A", "B", "C", "D"]


def text_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def opposite_orthogonal(label: Column) -> Column:
    return F.struct(
        _lookup(OPPOSITE, label).alias("opposite"),
        _lookup(ORTHOGONAL, label).alias("orthogonal"),
    )


def code_point_sum(text: Column) -> Column:
    # Split once: a substring per character would walk the text again for each.
    total = F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: acc + F.ascii(c))
    return F.when(F.length(text) > 0, total).otherwise(0)


def limit_options(pool: Column, n: int = 4) -> Column:
    """First ``n`` distinct options."""
    return F.slice(F.array_distinct(pool), 1, n)


def option_labels(answer: Column, pool: Column, seeds: Column) -> Column:
    """Up to four distinct options, the answer among them, before rotation."""
    own = F.array_distinct(F.filter(pool, lambda p: p.isNotNull() & (p != "")))
    own = F.when(F.array_contains(own, answer), own).otherwise(F.concat(F.array(answer), own))
    pair = opposite_orthogonal(answer)
    from_seeds = F.transform(
        seeds,
        lambda s: F.when(s == "opposite_direction", pair["opposite"])
        .when(s == "orthogonal_direction", pair["orthogonal"])
        .when(s.isin(BEARINGS), s),
    )
    seeded = F.array_distinct(
        F.concat(own, F.filter(from_seeds, lambda s: s.isNotNull()))
    )
    four = F.slice(F.array_distinct(F.concat(seeded, text_array(FILLERS))), 1, 4)
    with_answer = F.concat(F.array(answer), F.slice(four, 2, 3))
    return F.when(F.array_contains(four, answer), four).otherwise(with_answer)


def options_rotate(answer: Column, pool: Column, seeds: Column) -> Column:
    """Options rotated by the code points of the answer: struct of ordered texts and key."""
    labels = option_labels(answer, pool, seeds)
    shift = (code_point_sum(answer) % F.size(labels)).cast("int")
    ordered = F.concat(
        F.slice(labels, shift + 1, F.size(labels)), F.slice(labels, F.lit(1), shift)
    )
    return F.struct(
        ordered.alias("ordered"),
        F.element_at(text_array(KEYS), F.array_position(ordered, answer).cast("int")).alias("key"),
    )


def options_map(ordered: Column) -> Column:
    return F.map_from_arrays(F.slice(text_array(KEYS), F.lit(1), F.size(ordered)), ordered)


def distractor_rationale(options: Column, answer: Column) -> Column:
    """Why each option is offered, by key."""
    pair = opposite_orthogonal(answer)
    return F.transform_values(
        options,
        lambda _, v: F.when(v == answer, "correct")
        .when(v == pair["opposite"], "opposite_direction")
        .when(v == pair["orthogonal"], "orthogonal_direction")
        .otherwise("diagnostic_decoy"),
    )


def limit_images(paths: Column, n: int = 2) -> Column:
    """First ``n`` distinct non-blank paths."""
    kept = F.filter(paths, lambda p: p.isNotNull() & (p != ""))
    return F.slice(F.array_distinct(kept), 1, n)


def present(paths: Column) -> Column:
    return F.filter(paths, lambda p: p.isNotNull() & (p != ""))
