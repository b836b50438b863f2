from helpers import step, tables

from roamframe.operators.routes import action_runs
from roamframe.plans import facts, items
from roamframe.plans.checks import validate_items
from roamframe.storage import saved

ROOMS = [("r0", "Hall"), ("r1", None), ("r2", "Bath"), ("r3", "Attic")]


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.episode_id, r.rank))


def test_updating_goes_on_past_an_object_at_the_camera(spark):
    """At the first three candidates the object is exactly at the camera, so they have no direction."""
    steps = [step("a", 0, cam=(0, 0, -1))] + [step("a", i) for i in range(1, 4)]
    steps += [step("a", i, cam=(i, 0, 0)) for i in range(4, 8)]
    steps += [step("b", 0, cam=(0, 0, -1)), step("b", 1, cam=(1, 0, 0))]
    t = tables(spark, steps, [("a", 0, 0, "Cup|1"), ("b", 0, 0, "Cup|1")], [("Cup|1", "Cup", (0, 0, 0))])
    got = rows(facts.plan_spatial_updating(t, 2))
    assert [(r.episode_id, r.rank, r.query_step) for r in got] == [("a", 1, 4), ("a", 2, 5), ("b", 1, 1)]
    assert {r.answer_label for r in got} == {"to your left"}
    assert got[0].pre_move_label == "ahead of you"
    assert got[0].distractor_seeds == ["ahead of you", "pre_move_bearing", "opposite_direction"]


def test_updating_needs_a_movement(spark):
    steps = [step("a", 0), step("a", 1, action="pickup"), step("a", 2, action="LookUp"), step("a", 3, action="done")]
    t = tables(spark, steps, [("a", 0, 0, "Cup|1")], [("Cup|1", "Undefined", (0, 0, 1))])
    got = rows(facts.plan_spatial_updating(t, 5))
    assert [r.query_step for r in got] == [2, 3]
    assert got[0].object_type == "Cup"
    memory = rows(facts.plan_working_memory(t, 5))
    assert [(r.query_step, r.encoding_step) for r in memory] == [(1, 0), (2, 0), (3, 0)]
    assert memory[0].image_paths == ["img_0.png", "img_1.png"]


def test_displaced_objects_are_left_out(spark):
    t = tables(
        spark,
        [step("a", 0), step("a", 1)],
        [("a", 0, 0, "Cup|1"), ("a", 0, 1, "Mug|1")],
        [("Cup|1", "Cup", (0, 0, 1)), ("Mug|1", "Mug", (0, 0, 1))],
        events=[("a", 0, "e0", 1, "Cup|1", "Shelf|1", "Sofa|1", True)],
    )
    assert [r.queried_object_id for r in rows(facts.plan_working_memory(t))] == ["Mug|1"]


def test_invisible_displacement_rules(spark):
    steps = [step("a", 0), step("a", 1), step("a", 2, image=False)]
    events = [
        ("a", 0, "e0", 1, "Cup|1", "Shelf|1", "Shelf|2", None),  # missing flag counts as hidden
        ("a", 1, "e1", 1, "Mug|1", "Sofa|1", "None", True),
        ("a", 2, "e2", None, "Pan|1", None, "Sofa|9", True),
        ("a", 3, "e3", 1, "Pot|1", "Sofa|1", "Bed|1", False),
        ("a", 4, "e4", 0, "Pen|1", "Sofa|1", "Bed|1", True),
    ]
    t = tables(
        spark, steps, [("a", 2, 0, "Pen|1")], [("Pen|1", "Pen", (0, 0, 1))], events=events,
        landmarks=["Bed|7", "Desk|1"],
    )
    got = rows(facts.plan_invisible_displacement(t, 9))
    assert [r.queried_object_id for r in got] == ["Cup|1", "Mug|1", "Pan|1"]
    cup, mug, pan = got
    # Origin and target share a phrase, so the first two options are equal.
    assert cup.options_pool == ["on/in the Shelf", "on/in the Shelf", "on/in the Bed", "on/in the Desk"]
    assert mug.answer_label == "on the floor"
    assert mug.options_pool == ["on the floor", "on/in the Sofa", "on/in the Bed", "on/in the Desk"]
    assert cup.image_paths == ["img_0.png"] and pan.image_paths == []
    assert pan.encoding_step is None and pan.query_step == 2


def route_steps(ep, n, changes, action=lambda i: "move_ahead"):
    room, out = "r0", []
    for i in range(n):
        room = changes.get(i, room)
        out.append(step(ep, i, action=action(i), room=room))
    return out


def test_route_cut_and_reasons(spark):
    turn = lambda i: "rotate_left" if i % 2 else "move_ahead"
    few = lambda i: "move_ahead" if i in (0, 20, 44) else "none"
    steps = (
        route_steps("long", 60, {45: "r1"})  # 45 steps with 45 turns: skipped
        + route_steps("sparse", 60, {45: "r1"}, few)  # 45 steps, three turns: kept
        + route_steps("short", 20, {10: "r1", 12: "r2"}, turn)
        + route_steps("still", 5, {})
    )
    got = rows(facts.plan_route(tables(spark, steps), 3))
    by = {}
    for r in got:
        by.setdefault(r.episode_id, []).append(r)
    assert by["long"][0].reason == "no_short_source_goal_region_segment"
    assert by["still"][0].reason == "need_region_segments_and_actions_for_source_goal_route"
    assert by["sparse"][0].answer_label == "move_ahead ×3" and by["sparse"][0].status == "thin"
    first, second = by["short"]
    assert (first.encoding_step, first.query_step, first.status) == (0, 10, "ok")
    assert first.answer_label.endswith("→ …") and len(first.turn_labels) == 8
    assert second.answer_label == "move_ahead → rotate_left 0°"
    assert second.options_pool == [
        "move_ahead → rotate_left 0°", "rotate_left 0° → move_ahead",
        "move_ahead ×2 → rotate_left 90°", "decoy_route_3",
    ]
    assert second.answer_source == ["region_trajectory[1:2]", "route.turns[step>=10 and step<12]"]


def test_unnamed_actions_stand_in_for_turns(spark):
    steps = route_steps("a", 4, {2: "r1"}, lambda i: None)
    got = rows(facts.plan_route(tables(spark, steps), 3))
    assert got[0].answer_label == "move → move"


def test_two_turns_on_one_step_all_count(spark):
    """A segment of 40 steps keeps its 45 turns; a longer one with 21 turns is skipped, with 20 it is kept."""
    bounds = "episode_id string, seg int, t0 int, t1 int, source string, goal string, source_region_id string, goal_region_id string"
    rows_ = []
    for seg, t1, turns in ((0, 40, 45), (1, 41, 21), (2, 41, 20)):
        rows_ += [("a", seg, 0, t1, "x", "y", "x", "y", i % 40, "rotate_left", 90.0) for i in range(turns)]
    df = spark.createDataFrame(rows_, f"{bounds}, step int, action string, degrees double")
    got = {r.seg: r.turn_labels for r in action_runs(df).collect()}
    assert got == {0: ["rotate_left 90° ×45"], 2: ["rotate_left 90° ×20"]}


def test_route_items_without_turns_agree(spark):
    steps = route_steps("a", 6, {3: "r1"}, lambda i: None)
    t = tables(spark, steps)
    planned = saved(facts.plan_all(t, n=2, constructs=["route_knowledge"]), "facts")
    checked = validate_items(items.draft_items(planned, t), t).where("construct = 'route_knowledge'").collect()
    assert checked and all(r.agrees for r in checked)


def test_the_last_label_of_a_repeated_region_counts(spark):
    steps = route_steps("a", 6, {3: "r1"})
    named = [("r0", "Hall"), ("r1", "zz old"), ("r2", "Bath"), ("r1", "aa new")]
    t = tables(spark, steps, regions=named, links=[("r0", "r1", "d0", True)])
    got = rows(facts.plan_survey(t, 1))
    assert got[0].answer_label == "use d0 toward aa new" and got[0].goal == "aa new"
    planned = saved(facts.plan_all(t, n=1, constructs=["survey_knowledge"]), "facts")
    checked = validate_items(items.draft_items(planned, t), t).where("construct = 'survey_knowledge'").collect()
    assert checked and all(r.agrees for r in checked)
    assert len({r.item_id for r in checked}) == len(checked)


def test_survey_paths_decoys_and_reasons(spark):
    links = [
        ("r0", "r1", "d0", True), ("r0", "r1", "d0b", True), ("r1", "r2", None, False),
        ("r2", "r3", "d2", True), ("r0", "r3", "d3", False),
    ]
    steps = route_steps("a", 9, {3: "r1", 6: "r2"}) + route_steps("one", 3, {})
    t = tables(spark, steps, regions=ROOMS, links=links)
    got = rows(facts.plan_survey(t, 9))
    a = [r for r in got if r.episode_id == "a"]
    assert [r.answer_label for r in a] == ["use d0 toward r1", "use d0 toward r1", "use r1-r2 toward Bath"]
    assert a[0].options_pool == ["use d0 toward r1", "use d0b toward r1", "use d2 toward Attic", "use d3 toward Attic"]
    assert a[2].options_pool == ["use r1-r2 toward Bath", "use d0 toward r1", "use d0b toward r1", "use d2 toward Attic"]
    assert a[1].path_regions == ["r0", "r1", "r2"] and a[1].passages == ["d0", "r1-r2"]
    assert a[1].answer_source[1] == "plan_path[r0→r2]=['r0', 'r1', 'r2']"
    assert a[0].image_paths == ["img_0.png", "img_3.png"]
    # Too few visits: the first four rooms of the layout stand in.
    one = [r for r in got if r.episode_id == "one"]
    assert (one[0].source, one[0].goal) == ("Hall", "r1") and one[0].image_paths == ["img_0.png"]
    assert len(one) == 6
    none = rows(facts.plan_survey(tables(spark, steps, regions=ROOMS), 3))
    assert {r.reason for r in none} == {"weak_or_missing_layout_connectivity"}
    cut = rows(facts.plan_survey(tables(spark, steps, regions=ROOMS, links=[("r2", "r3", "d", False)]), 3))
    assert [r.reason for r in cut if r.episode_id == "a"] == ["no_plannable_source_goal_pair_in_layout"]


def test_survey_takes_further_rounds(spark, monkeypatch):
    """With one start per round the pairs are the same."""
    steps = route_steps("a", 9, {3: "r1", 6: "r2"}) + route_steps("one", 3, {})
    t = tables(spark, steps, regions=ROOMS, links=[("r1", "r2", "d", True), ("r2", "r3", "e", False)])
    want = [(r.episode_id, r.rank, r.answer_label) for r in rows(facts.plan_survey(t, 2))]
    monkeypatch.setattr(facts, "FIRST_STARTS", 1)
    got = [(r.episode_id, r.rank, r.answer_label) for r in rows(facts.plan_survey(t, 2))]
    assert got == want
    assert ("a", 1, "use d toward Bath") in got and ("one", 2, "use d toward Bath") in got


def full(spark):
    steps = route_steps("a", 9, {3: "r1", 6: "r2"}) + [step("b", 0), step("b", 1, yaw=90)]
    det = [("a", 0, 0, "Cup|1"), ("a", 0, 1, "Mug|1"), ("a", 4, 0, "Mug|1"), ("b", 0, 0, "Cup|1")]
    return tables(
        spark, steps, det,
        [("Cup|1", "Undefined", (0.6, 0, 1)), ("Mug|1", "Mug", (-0.6, 0, 1))],
        events=[("a", 0, "e0", 2, "Pan|1", "Shelf|1", "Sofa|1", True)],
        regions=ROOMS, links=[("r0", "r1", "d0", True), ("r1", "r2", "d1", True)],
    )


def test_items_are_sound(spark):
    t = full(spark)
    planned = saved(facts.plan_all(t, n=2), "facts")
    drafted = saved(items.draft_items(planned, t), "items")
    got = drafted.collect()
    ids = {(r.episode_id, r.item_id) for r in got}
    assert len(ids) == len(got)
    answers = {}
    for r in got:
        if r.status == "unsupported":
            assert r.question == "" and r.answer is None and r.options == {}
            assert r.item_id.endswith("_unsupported")
            continue
        assert len(r.options) == 4 and len(set(r.options.values())) == 4
        assert r.distractor_rationale[r.answer] == "correct"
        assert list(r.distractor_rationale.values()).count("correct") == 1
        assert (r.episode_id, r.paired_item_id) in ids
        answers.setdefault((r.episode_id, r.fact_no), set()).add((r.answer, r.options[r.answer]))
        if r.question_style == "verbose":
            assert r.options[r.answer].lower() not in r.question.lower()
        if len(r.image_paths) > 1:
            assert "time order" in r.question
    assert all(len(a) == 1 for a in answers.values())
    checked = validate_items(drafted, t).collect()
    assert len(checked) == sum(r.answer is not None for r in got)
    assert all(r.agrees for r in checked)


def test_verbose_wording(spark):
    t = full(spark)
    got = items.draft_items(facts.plan_egocentric(t, 1).selectExpr("*", "0 as fact_no"), t, tag="t")
    by = {(r.episode_id, r.question_style): r for r in got.collect()}
    assert by["a", "concise"].question == "From your current view, where is the Cup relative to you?"
    assert by["a", "verbose"].question == (
        "You are looking around a space identified as r0. Also visible is a Mug (to your left). "
        "There is also a Cup in the scene. From your current view, where is the Cup relative to you?"
    )
    assert by["a", "verbose"].item_id == "t_000_egocentric_encoding_0_Cup_1_verbose"
    one = items.draft_items(facts.plan_egocentric(t, 1).selectExpr("*", "0 as fact_no"), t, styles=["concise"])
    assert {r.paired_item_id for r in one.collect()} == {None}


def test_construct_choice_and_order(spark):
    t = full(spark)
    got = facts.plan_all(t, ["perspective_taking", "unheard_of", "egocentric_encoding"], 1).collect()
    assert sorted((r.episode_id, r.fact_no, r.construct) for r in got) == [
        ("a", 0, "perspective_taking"), ("a", 1, "egocentric_encoding"),
        ("b", 0, "perspective_taking"), ("b", 1, "egocentric_encoding"),
    ]
