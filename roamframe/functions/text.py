"""Names, sentences and ids as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roamframe.functions.geometry import fixed_digits

# Category texts that stand for "no category".
BAD_CATEGORIES = ["", "undefined", "none", "null", "nan", "unknown", "n/a", "na"]

# First question wording per construct.
QUESTIONS = {
    "egocentric_encoding": "From your current view, where is the {object_type} relative to you?",
    "allocentric_encoding": "Relative to the {reference}, where is the {object_type}?",
    "spatial_working_memory": (
        "Looking at these images in order, where was the {object_type} relative to you when you "
        "last saw it (an earlier image, not the last)?"
    ),
    "invisible_displacement": (
        "Looking at these images in order, where is the {object_type} now (after the last image)?"
    ),
    "spatial_updating": (
        "Looking at these images in order, where is the {object_type} relative to you now (in the "
        "last image)?"
    ),
    "perspective_taking": "From where the {reference} faces, which object is on its left?",
    "route_knowledge": (
        "You need to go from {source} to {goal}. Which action sequence matches the route between "
        "these places in the views shown?"
    ),
    "survey_knowledge": (
        "Using the layout of the space, to go from {source} to {goal}, which connection should "
        "you use?"
    ),
}

# Hint per construct when an item has several images.
HINTS = {
    "spatial_updating": (
        "Use the earlier image to encode the object, then answer from your pose in the last image."
    ),
    "spatial_working_memory": (
        "The answer refers to an earlier view when the object was visible, not only the last image."
    ),
    "invisible_displacement": (
        "The object moves while hidden; answer its location after the last image."
    ),
    "route_knowledge": (
        "Plan a short route from {source} to {goal} (not the whole episode). "
        "The images show views near the start and goal."
    ),
    "survey_knowledge": (
        "Use the layout to plan from {source} to {goal}; "
        "do not rely on memorizing every walked step."
    ),
}


def fill(template: str, fields: dict[str, Column]) -> Column:
    """Text with its ``{name}`` places filled from columns."""
    parts: list[Column] = []
    rest = template
    while rest:
        literal, brace, tail = rest.partition("{")
        if literal:
            parts.append(F.lit(literal))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(fields[name])
    return F.concat(*parts)


def ego_label(t: Column) -> Column:
    return (
        F.when(t["x"] == "left", "to your left")
        .when(t["x"] == "right", "to your right")
        .when(t["z"] == "front", "ahead of you")
        .when(t["z"] == "behind", "behind you")
        .when(t["y"] == "above", "above you")
        .when(t["y"] == "below", "below you")
    )


def usable_category(category: Column) -> Column:
    return category.isNotNull() & ~F.lower(F.trim(category)).isin(BAD_CATEGORIES)


def id_stem(id_: Column) -> Column:
    """Text before the first bar, or the whole id if that is blank."""
    stem = F.trim(F.substring_index(id_, "|", 1))
    return F.when(stem != "", stem).otherwise(id_)


def display_name(category: Column, id_: Column) -> Column:
    return F.when(usable_category(category), F.trim(category)).otherwise(id_stem(id_))


def planned_name(category: Column, id_: Column) -> Column:
    """Name used in a question: planned category, else id text, else ``object``."""
    has_id = id_.isNotNull() & (id_ != "")
    return (
        F.when(usable_category(category), F.trim(category))
        .when(has_id, id_stem(id_))
        .otherwise("object")
    )


def receptacle_phrase(id_: Column) -> Column:
    missing = id_.isNull() | F.lower(id_).isin("", "none", "null")
    return F.when(missing, "on the floor").otherwise(
        F.concat(F.lit("on/in the "), F.substring_index(id_, "|", 1))
    )


def _nonblank(c: Column) -> Column:
    return F.when(c != "", c)


def region_label(type_: Column, id_: Column) -> Column:
    return F.coalesce(_nonblank(type_), _nonblank(id_), F.lit("a room"))


def frame_cue(n: Column) -> Column:
    return (
        F.when(n <= 1, "")
        .when(
            n == 2,
            "The two images are shown in time order "
            "(first = earlier view, second = later view). ",
        )
        .otherwise(
            F.concat(
                F.lit("The "),
                n.cast("string"),
                F.lit(" images are shown in time order (first = earliest, last = latest). "),
            )
        )
    )


def _fields(object_type: Column, reference: Column, source: Column, goal: Column) -> dict:
    return {
        "object_type": object_type,
        "reference": reference,
        "source": F.coalesce(source, F.lit("the start")),
        "goal": F.coalesce(goal, F.lit("the goal")),
    }


def _by_construct(texts: dict[str, str], construct: Column, fields: dict) -> Column:
    out = None
    for name, template in texts.items():
        hit, value = construct == name, fill(template, fields)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def core_question(
    construct: Column,
    object_type: Column,
    reference: Column,
    source: Column,
    goal: Column,
    n_images: Column,
) -> Column:
    fields = _fields(object_type, reference, source, goal)
    body = F.coalesce(_by_construct(QUESTIONS, construct, fields), F.lit("(no template)"))
    return F.concat(frame_cue(n_images), body)


def construct_hint(construct: Column, source: Column, goal: Column) -> Column:
    """Null for constructs without a hint."""
    return _by_construct(HINTS, construct, _fields(F.lit(""), F.lit(""), source, goal))


def scrub_leak(text: Column, answer: Column) -> Column:
    """Hide the answer where the text spells it."""
    leaks = (answer != "") & F.contains(F.lower(text), F.lower(answer))
    mark = F.lit("[…]")
    hidden = F.replace(F.replace(text, answer, mark), F.lower(answer), mark)
    return F.when(F.coalesce(leaks, F.lit(False)), hidden).otherwise(text)


def _or_none(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def base_id(tag: Column, number: Column) -> Column:
    return F.concat(tag, F.lit("_"), F.format_string("%03d", number))


def item_id(
    tag: Column, number: Column, construct: Column, step: Column, object_id: Column, style: Column
) -> Column:
    raw = F.concat_ws(
        "_", base_id(tag, number), construct, _or_none(step), _or_none(object_id), style
    )
    return F.translate(raw, "| ", "__")


def whole_number(c: Column) -> Column:
    """Number as text, without a trailing ``.0`` when it is whole."""
    d = c.cast("double")
    whole = d == F.floor(d)
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def action_label(action: Column, degrees: Column, count: Column) -> Column:
    """``move_ahead ×3``; rotations also name their angle."""
    turns = degrees.isNotNull() & F.contains(F.lower(action), F.lit("rotate"))
    unit = F.when(turns, F.concat(action, F.lit(" "), whole_number(degrees), F.lit("°"))).otherwise(
        action
    )
    return F.when(count > 1, F.concat(unit, F.lit(" ×"), count.cast("string"))).otherwise(unit)


def relation_text(x: Column, y: Column, z: Column, distance: Column) -> Column:
    """``left/front | nearby``; blank without an edge."""
    words = F.concat_ws("/", *[_nonblank(c) for c in (x, y, z)])
    has_edge = x.isNotNull() | y.isNotNull() | z.isNotNull()
    return F.concat_ws(" | ", F.when(has_edge, words), _nonblank(distance))


def legend_line(
    number: Column,
    object_id: Column,
    relation: Column,
    local: Column,
    show_relations: bool = True,
    show_local_xyz: bool = False,
) -> Column:
    parts = [F.concat(number.cast("string"), F.lit(". "), object_id)]
    if show_relations:
        parts.append(F.when(relation != "", F.concat(F.lit("agent→obj: "), relation)))
    if show_local_xyz:
        two = [fixed_digits(local[a], 2) for a in "xyz"]
        parts.append(F.concat(F.lit("loc=("), F.concat_ws(",", *two), F.lit(")")))
    return F.concat_ws("  ·  ", *parts)


def camel_tail(c: Column) -> Column:
    """Second camel-case word in lower case, or the only one."""
    words = F.split(F.regexp_replace(c, "(?<!^)(?=[A-Z])", " "), " ")
    return F.lower(F.when(F.size(words) > 1, words[1]).otherwise(words[0]))


def quoted_list(items: Column) -> Column:
    """``['a', 'b']``."""
    marked = F.transform(
        items,
        lambda s: F.when(
            F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"')),
            F.concat(F.lit('"'), s, F.lit('"')),
        ).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'"))),
    )
    return F.concat(F.lit("["), F.array_join(marked, ", "), F.lit("]"))


def scene_of(meta_scene: Column, episode_scene: Column) -> Column:
    return F.coalesce(_nonblank(meta_scene), _nonblank(episode_scene), F.lit("unknown"))


def environment_of(meta_environment: Column) -> Column:
    return F.coalesce(_nonblank(meta_environment), F.lit("ai2thor"))
