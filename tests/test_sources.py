import json

import pytest
from pyspark.sql import functions as F

from roamframe.operators import assemble, markers
from roamframe.operators.aggregates import agent_actions, displaced_ids
from roamframe.operators.edges import edges_egocentric
from roamframe.operators.memory import non_visible_objects, object_memory
from roamframe.operators.poses import visible_objects
from roamframe.operators.routes import route_landmarks, route_turns
from roamframe.operators.tracks import object_state_track
from roamframe.sources import collector, discover, layout, logs, store

NAV = """timestep,ag-action,action_success,held_obj-id,degrees,ag-rot-y,ag-rot-z,cmin,rmin,cmax,rmax,camera-horizon,camera-pos-x,camera-pos-y,camera-pos-z,current-room,current-room-type,obj-id,path
4,move_ahead,True,,0,0.0,0.0,12,14,60,66,0.0,2.0,1.5,-1.0,den|A,Study,Lamp|7,/img_4.png
4,ignored,False,,5,8.0,0.0,12,14,60,66,0.0,6.0,6.0,6.0,yard|B,Yard,Wall|3,/img_8.png
5,rotate_left,yes,,45,315.0,0.0,31,33,70,75,0.0,2.0,1.5,-1.0,den|A,Study,Book|3,/img_5.png
7,done,,Lamp|7,0,315.0,0.0,,,,,0.0,2.0,1.5,-1.0,,,,
"""
OBJ = """obj-type,obj-id,obj-color,obj-pos-x,obj-pos-y,obj-pos-z,obj-rot-x,obj-rot-y,obj-rot-z,receptacleObjectIds,bBox-center-x,bBox-center-y,bBox-center-z,size-x,size-y,size-z
Lamp,Lamp|7,"(200, 180, 20)",6.0,6.0,6.0,0,0,0,[],2,1.5,-0.3,0.3,0.6,0.3
Book,Book|3,"(9, 8, 7)",2.6,1.4,-1.0,0,30,0,"['Pen|1', 'Card|2']",2.6,1.4,-1,0.2,0.3,0.04
Lamp,Lamp|7,"(200, 180, 20)",2.0,1.5,-0.3,0,0,0,oops[,2,1.5,-0.3,0.3,0.6,0.3
Floor,Floor|1,,0,0,0,0,0,0,[],0,0,0,1,1,1
Lamp,,,0,0,0,0,0,0,[],0,0,0,1,1,1
"""
STATE = """timestep,obj-id,obj-type,obj-pos-x,obj-pos-y,obj-pos-z,obj-rot-x,obj-rot-y,obj-rot-z,visible,in_camera_fov,parent_receptacle,parent_receptacles,is_inside_receptacle,receptacle_is_open,distance_from_agent
4,Lamp|7,Lamp,2.0,1.5,-0.3,0,0,0,True,True,Desk|2,"[""Desk|2""]",True,,0.7
5,Lamp|7,Lamp,7.5,1.5,0.1,0,0,0,False,False,Desk|2,"[""Desk|2""]",True,,1.2
5,Lamp|7,Lamp,2.4,1.5,0.1,0,0,0,False,False,Desk|2,"[""Desk|2""]",True,1,1.2
5,Book|3,Book,2.4,1.5,0.1,0,0,0,False,False,Desk|2,,True,,1.2
"""
EVENTS = """event_id,obj-id,at_timestep,action,from_receptacle,to_receptacle,from_pos-x,from_pos-y,from_pos-z,to_pos-x,to_pos-y,to_pos-z,hidden_during,visible_just_before,visible_just_after,in_fov_just_before,in_fov_just_after,moved_via,notes
mv_3,Lamp|7,5,Place,Desk|2,None,2.0,1.5,-0.3,2.4,1.5,0.1,True,1,1.0,no,,carried,
"""
PASSAGES = """timestep,passage_id,obj-id,is_open,is_locked,from_region,to_region
4,gate|1,gate|1,True,,den|A,yard|B
4,gate|2,gate|2,False,0,den|A,yard|B
5,gate|1,gate|1,True,,den|A,yard|B
7,gate|1,gate|1,True,1,den|A,yard|B
7,gate|2,gate|2,False,no,den|A,yard|B
"""
REGIONS = """timestep,region_id,region_type
4,den|A,Study
5,den|A,Study
7,yard|B,Yard
"""


@pytest.fixture
def folder(tmp_path):
    """An episode with logs under annotations/ and one flat, incomplete one."""
    notes = tmp_path / "run_1" / "annotations"
    notes.mkdir(parents=True)
    (tmp_path / "run_1" / "images").mkdir()
    (tmp_path / "run_1" / "images" / "img_4.png").write_bytes(b"x")
    for role, body in {
        "navigation": NAV, "objects": OBJ, "object_state": STATE, "displacement_events": EVENTS,
        "passage_state": PASSAGES, "region_trajectory": REGIONS,
    }.items():
        (notes / f"{role}-house_1.csv").write_text(body)
    (notes / "episode_meta-house_1.json").write_text(json.dumps({"episode_id": "e1", "scene_id": "house_7"}))
    (notes / "world_layout-house_1.json").write_text(
        json.dumps({"regions": [{"region_id": "den|A", "label": "Study"}], "passages": [],
                    "landmarks": [{"landmark_id": "Lamp|7", "obj-type": "Lamp"}], "connectivity": []}, indent=1))
    flat = tmp_path / "run_2"
    flat.mkdir()
    (flat / "navigation-attic.csv").write_text(NAV)
    return tmp_path


def notes(folder, role, ext="csv"):
    return str(folder / "run_1" / "annotations" / f"{role}-house_1.{ext}")


def test_navigation_headers_and_detections(spark, folder):
    nav = logs.read_navigation(spark, notes(folder, "navigation"))
    steps, det = logs.split_navigation(nav)
    got = {r.step: r for r in steps.collect()}
    assert {r.episode_id for r in got.values()} == {"run_1"}
    assert sorted((s, r.pos) for s, r in got.items()) == [(4, 0), (5, 1), (7, 2)]
    assert (got[4].action, got[4].cam_y, got[4].region_type) == ("move_ahead", 1.5, "Study")
    assert (got[4].action_success, got[5].action_success, got[7].action_success) == (True, True, None)
    assert (got[7].held_object_id, got[7].region_id, got[7].image_path) == ("Lamp|7", None, None)
    assert sorted((r.step, r.object_id) for r in det.collect()) == [(4, "Lamp|7"), (5, "Book|3")]
    head = {r.step: r.objects for r in assemble.step_headers(nav).collect()}
    assert head == {4: ["Lamp|7"], 5: ["Book|3"], 7: []}
    boxes = markers.nav_bboxes(nav).collect()
    assert sorted((r.step, r.object_id, r.cmin) for r in boxes) == [(4, "Lamp|7", 12), (5, "Book|3", 31)]


def test_files_of_several_layouts(spark, folder):
    other = folder / "run_3" / "annotations"
    other.mkdir(parents=True)
    (other / "navigation-house_9.csv").write_text('obj-id,path,timestep\n"Lamp|7","a,b.png",4\n\nBook|3,None,5\n')
    nav = logs.read_navigation(spark, [notes(folder, "navigation"), str(other / "navigation-house_9.csv")])
    got = sorted((r.episode_id, r.step, r.object_id or "", r.image_path or "", r.action or "") for r in nav.collect())
    assert got == [
        ("run_1", 4, "", "/img_8.png", "ignored"),
        ("run_1", 4, "Lamp|7", "/img_4.png", "move_ahead"),
        ("run_1", 5, "Book|3", "/img_5.png", "rotate_left"),
        ("run_1", 7, "", "", "done"),
        ("run_3", 4, "Lamp|7", "a,b.png", ""),
        ("run_3", 5, "Book|3", "", ""),
    ]
    steps, _ = logs.split_navigation(nav)
    assert {(r.episode_id, r.step): r.action for r in steps.collect()}["run_1", 4] == "move_ahead"


def test_files_of_many_episodes(spark, tmp_path):
    """An episode of each file is named by its rows, in files of two layouts; the path says nothing."""
    (tmp_path / "a.csv").write_text("episode_id,timestep,obj-id,ag-action\n7,0,Cup|1,done\n7,1,,None\n8,0,Mug|2,done\n")
    (tmp_path / "b.csv").write_text("ag-action,obj-id,timestep,episode_id\nmove_ahead,Pan|1,3,9\ndone,Pan|2,3,9\n")
    nav = logs.read_navigation(spark, str(tmp_path), None)
    got = sorted((r.episode_id, r.step, r.object_id or "", r.action or "") for r in nav.collect())
    assert got == [("7", 0, "Cup|1", "done"), ("7", 1, "", ""), ("8", 0, "Mug|2", "done"),
                   ("9", 3, "Pan|1", "move_ahead"), ("9", 3, "Pan|2", "done")]
    steps, _ = logs.split_navigation(nav)
    assert sorted((r.episode_id, r.step, r.pos, r.action) for r in steps.collect()) == [
        ("7", 0, 0, "done"), ("7", 1, 1, None), ("8", 0, 0, "done"), ("9", 3, 0, "move_ahead")]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "regions.csv").write_text("timestep,region_id\n0,den\n")
    with pytest.raises(ValueError, match="episode_id"):
        logs.read_region_rows(spark, str(tmp_path / "c"), None)


def test_layouts_and_metas_of_many_episodes(spark, tmp_path):
    layouts = [{"scene_id": s, "regions": [{"region_id": f"den|{s}{i}"} for i in range(2)]} for s in "ab"]
    (tmp_path / "layouts.json").write_text("".join(json.dumps(d) + "\n" for d in layouts))
    regions = layout.read_world_layout(spark, str(tmp_path / "layouts.json"), None)["regions"]
    got = sorted((r.scene_id, r.row_ord, r.region_id) for r in regions.collect())
    assert got == [("a", 0, "den|a0"), ("a", 1, "den|a1"), ("b", 0, "den|b0"), ("b", 1, "den|b1")]
    metas = [{"folder": f"run_{i}", "episode_id": f"e{i}", "scene_id": f"house_{i}"} for i in range(2)]
    (tmp_path / "metas.json").write_text("".join(json.dumps(d) + "\n" for d in metas))
    got = layout.read_episode_meta(spark, str(tmp_path / "metas.json"), None).collect()
    assert sorted((r.folder, r.episode_id, r.scene_id) for r in got) == [("run_0", "e0", "house_0"), ("run_1", "e1", "house_1")]


def test_queries_write_few_log_files(spark, tmp_path):
    """Files of a log do not grow with its episodes."""
    import os

    from episode_queries import _logs

    rows = spark.range(300).selectExpr("id as episode_id", "0 as timestep", "'den' as region_id")
    path = _logs(spark, rows, "few", ["timestep"]).removeprefix("file://").removeprefix("file:")
    assert sum(f.endswith(".csv") for _, _, files in os.walk(path) for f in files) < 50
    back = logs.read_region_rows(spark, path, None)
    assert sorted(int(r.episode_id) for r in back.collect()) == list(range(300))


def test_catalog(spark, folder):
    got = {r.object_id: r for r in logs.read_objects(spark, notes(folder, "objects")).collect()}
    assert set(got) == {"Lamp|7", "Book|3"}
    assert (got["Lamp|7"].pos_z, got["Lamp|7"].color) == (-0.3, "(200, 180, 20)")
    assert got["Lamp|7"].receptacle_object_ids == []
    assert got["Book|3"].receptacle_object_ids == ["Pen|1", "Card|2"]


def test_states_events_passages_regions(spark, folder):
    events = logs.read_displacement_events(spark, notes(folder, "displacement_events"))
    e = events.collect()[0]
    assert (e.at_timestep, e.to_receptacle, e.hidden_during, e.notes) == (5, None, True, None)
    assert (e.visible_just_before, e.visible_just_after, e.in_fov_just_before) == (True, False, False)
    states = logs.read_object_state(spark, notes(folder, "object_state"), displaced_ids(events))
    got = {r.step: (r.object_id, r.pos_x, r.receptacle_is_open) for r in states.collect()}
    assert got == {4: ("Lamp|7", 2.0, None), 5: ("Lamp|7", 2.4, True)}
    kept = logs.read_passage_state(spark, notes(folder, "passage_state")).collect()
    assert sorted((r.timestep, r.passage_id, r.is_locked) for r in kept) == [
        (4, "gate|1", None), (4, "gate|2", False), (7, "gate|1", True)]
    kept = logs.read_region_trajectory(spark, notes(folder, "region_trajectory")).collect()
    assert sorted((r.timestep, r.region_id) for r in kept) == [(4, "den|A"), (7, "yard|B")]


def episode(spark, folder):
    nav = logs.read_navigation(spark, notes(folder, "navigation"))
    steps, det = logs.split_navigation(nav)
    events = logs.read_displacement_events(spark, notes(folder, "displacement_events"))
    states = logs.read_object_state(spark, notes(folder, "object_state"), displaced_ids(events))
    objects = logs.read_objects(spark, notes(folder, "objects"))
    return steps, det, states, objects


def test_episode_from_files(spark, folder):
    steps, det, states, objects = episode(spark, folder)
    seen = visible_objects(steps, det, states, objects)
    lamp = edges_egocentric(seen).where("target = 'Lamp|7'").collect()
    assert [(e.step, e.angle_z, e.inferred, e.distance_label) for e in lamp] == [(4, "front", False, "nearby")]
    gone = non_visible_objects(object_memory(steps, seen, states)).collect()
    assert sorted((r.step, r.object_id, r.last_seen, r.pos_x) for r in gone) == [
        (5, "Lamp|7", 4, 2.4), (7, "Book|3", 5, 2.6), (7, "Lamp|7", 4, 2.4)]
    assert "Lamp|7" in [r.object_id for r in route_landmarks(seen).collect()]
    turns = sorted((r.ord, r.action, r.degrees) for r in route_turns(steps).collect())
    assert turns[1] == (1, "rotate_left", 45.0)
    track = object_state_track(states, objects).collect()
    assert sorted((r.step, r.in_camera_fov, r.pos_x) for r in track) == [(4, True, 2.0), (5, False, 2.4)]


def test_layout_and_meta(spark, folder):
    tables = layout.read_world_layout(spark, notes(folder, "world_layout", "json"))
    assert [(r.region_id, r.label, r.row_ord) for r in tables["regions"].collect()] == [("den|A", "Study", 0)]
    assert [r.category for r in tables["landmarks"].collect()] == ["Lamp"]
    assert tables["passages"].count() == tables["connectivity"].count() == 0
    meta = layout.read_episode_meta(spark, notes(folder, "episode_meta", "json")).collect()[0]
    assert (meta.folder, meta.episode_id, meta.scene_id, meta.environment) == ("run_1", "e1", "house_7", "ai2thor")


def test_discover(spark, folder):
    listing = discover.list_files(spark, str(folder))
    got = {r.scene_id: r for r in discover.discover(listing).collect()}
    assert set(got) == {"house_1", "attic"}
    one = got["house_1"]
    assert one.episode_root.endswith("run_1") and one.annotations_dir.endswith("run_1/annotations")
    assert one.images_dir.endswith("run_1/images") and one.missing == [] and one.doors is None
    assert one.navigation.endswith("navigation-house_1.csv")
    assert got["attic"].missing == ["objects"]
    with pytest.raises(Exception, match="required file missing for objects"):
        discover.require_roles(discover.discover(listing)).collect()
    named = discover.discover(listing, overrides={"objects": "navigation-attic.csv"})
    assert {r.scene_id: r.missing for r in named.collect()}["attic"] == []


def test_meta_scene_renames_the_wanted_files(spark, folder):
    listing = discover.list_files(spark, str(folder))
    meta = listing.where(F.col("path").contains("episode_meta")).select(
        "path", F.lit("house_7").alias("scene_id"), F.lit("images").alias("images_dir"))
    got = {r.scene_id: r for r in discover.discover(listing, meta=meta).collect()}
    assert got["house_7"].missing == ["navigation", "objects"] and got["house_7"].episode_meta is not None


def test_image_repair(spark):
    files = spark.createDataFrame([("/r/images/img_3.png",), ("/r/images/a/b.png",), ("/x/y.png",)], "path string")
    rows = [(0, "img_3.png"), (1, "/gone/img_3.png"), (3, None), (4, "nan"), (5, "a/b.png"), (6, "/x/y.png"),
            (7, "/lost/z.png")]
    steps = spark.createDataFrame([("r", s, p, "/r/images") for s, p in rows],
                                  "episode_id string, step int, image_path string, images_dir string")
    got = {r.step: r.image_path for r in discover.resolve_images(steps, files).collect()}
    assert got == {0: "/r/images/img_3.png", 1: "/r/images/img_3.png", 3: "/r/images/img_3.png", 4: None,
                   5: "/r/images/a/b.png", 6: "/x/y.png", 7: "/lost/z.png"}


def test_collector_records(spark):
    obj = "struct<object_id:string,category:string,visible:boolean,distance:double," \
          "position:struct<x:double,y:double,z:double>,rotation:struct<x:double,y:double,z:double>>"
    box = "struct<object_id:string,cmin:int,rmin:int,cmax:int,rmax:int>"
    vase = ("Vase|2", "Vase", True, 2.71828, (0.506, 0.25, 0.0), (0.0, 10.0, 0.0))
    rows = [("e", 3, [vase, ("Sofa|1", "Sofa", False, 1.0, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)),
                      ("Coat|9", "Coat", True, 1.0, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0))],
             [("Vase|2", 11, 12, 23, 24), ("Sofa|1", 1, 2, 3, 4)]), ("e", 4, [], []),
            ("e", 6, [vase], [("Vase|2", 15, 16, 27, 28)])]
    df = spark.createDataFrame(rows, f"episode_id string, step int, objects array<{obj}>, detections array<{box}>")
    got = sorted((r.step, r.object_id, r.distance, r.cmin) for r in collector.flatten_records(df).collect())
    assert got == [(3, "Vase|2", 2.7183, 11), (4, None, None, None), (6, "Vase|2", 2.7183, 15)]
    assert [(r.object_id, r.pos_x) for r in collector.build_catalog(df).collect()] == [("Vase|2", 0.51)]


def test_store_replaces_refuses_and_loads(spark, folder, tmp_path):
    from roamframe.operators.edges import edges_inferred, union_edges
    from roamframe.operators.memory import union_objects

    steps, det, states, objects = episode(spark, folder)
    seen = visible_objects(steps, det, states, objects)
    gone = non_visible_objects(object_memory(steps, seen, states))
    tables = {
        "episodes": spark.createDataFrame([("run_1", "house_1", "ai2thor")],
                                          "episode_id string, scene_id string, environment string"),
        "steps": steps,
        "step_objects": union_objects(seen, gone),
        "edges": union_edges(edges_egocentric(seen), edges_inferred(gone)),
    }
    path = str(tmp_path / "store")
    store.write_episodes(tables, path)
    store.write_episodes(tables, path)
    other = {"episodes": tables["episodes"].withColumn("episode_id", F.lit("run_2")),
             "steps": steps.withColumn("episode_id", F.lit("run_2"))}
    store.write_episodes(other, path, replace=False)
    with pytest.raises(ValueError, match="already stored"):
        store.write_episodes(tables, path, replace=False)
    back = {n: store.read_table(spark, path, n) for n in ("episodes", "steps", "step_objects", "edges")}
    listed = store.list_episodes(back["episodes"], back["steps"]).collect()
    assert [(r.episode_id, r.n_steps) for r in listed] == [("run_1", 3), ("run_2", 3)]
    hit = store.get_edges(back["edges"], "run_1", step=5, edge_type="inferred", target="Lamp|7")
    assert [(r.inferred, r.last_seen) for r in hit.collect()] == [(True, 4)]
    plan = hit._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(episode_id)" in plan
    ids = spark.createDataFrame([("run_1",)], "episode_id string")
    nested = store.load_episode(back, ids).collect()
    assert len(nested) == 1 and [s.step for s in nested[0].steps] == [4, 5, 7]
    assert list(nested[0].steps[1].non_visible_objects) == ["Lamp|7"]
    with pytest.raises(KeyError):
        store.load_episode(back, spark.createDataFrame([("nobody",)], "episode_id string"))
    out = str(tmp_path / "json")
    df = agent_actions(steps)
    store.export_json(df, out)
    assert store.read_episode(spark, json=out, schema=df.schema).collect() == df.collect()
    with pytest.raises(ValueError):
        store.read_episode(spark)


def _small(spark, rows, columns="episode_id string, step int, degrees double"):
    steps = spark.createDataFrame(rows, columns)
    ids = steps.select("episode_id").distinct()
    return {"episodes": ids.withColumns({"scene_id": F.lit("s"), "environment": F.lit("e")}), "steps": steps}


def _stored(spark, path, version=None):
    return sorted(tuple(r) for r in store.read_table(spark, path, "steps", version).drop("bucket").collect())


def test_unfinished_write_leaves_the_former_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    first = [("a", 1, 10.0), ("b", 1, 20.0), ("b", 2, 21.0)]
    assert store.write_episodes(_small(spark, first), path, buckets=4) == 1
    other = _small(spark, [("b", 1, 99.0)])
    write = store._write

    def dies(df, target, buckets):
        if "/steps/" in target:
            raise RuntimeError("killed")
        write(df, target, buckets)

    with monkeypatch.context() as m:
        m.setattr(store, "_write", dies)
        with pytest.raises(RuntimeError, match="killed"):
            store.write_episodes(other, path)
    assert store.versions(spark, path) == [1] and _stored(spark, path) == first
    assert store.write_episodes(other, path) == 2
    assert _stored(spark, path) == [("a", 1, 10.0), ("b", 1, 99.0)]
    assert _stored(spark, path, 1) == first
    assert store.read_table(spark, path, "episodes").count() == 2
    with pytest.raises(FileNotFoundError):
        store.read_table(spark, path, "steps", 7)


def test_second_writer_of_a_version_is_refused(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.write_episodes(_small(spark, [("a", 1, 10.0)]), path, buckets=4)
    commit = store._commit

    def late(spark, path, number, manifest):
        with monkeypatch.context() as m:
            m.setattr(store, "_commit", commit)
            store.write_episodes(_small(spark, [("c", 1, 30.0)]), path)
        commit(spark, path, number, manifest)

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", late)
        with pytest.raises(RuntimeError, match="another version 2"):
            store.write_episodes(_small(spark, [("a", 1, 11.0)]), path)
    assert _stored(spark, path) == [("a", 1, 10.0), ("c", 1, 30.0)]


def test_replacing_many_times_new_columns_and_compaction(spark, tmp_path):
    path = str(tmp_path / "store")
    want = {}
    for turn in range(5):
        rows = [(e, s, float(turn)) for e in "abcde"[turn % 3 : turn % 3 + 2] for s in range(turn + 1)]
        store.write_episodes(_small(spark, rows), path, buckets=2)
        for e in {r[0] for r in rows}:
            want[e] = [r for r in rows if r[0] == e]
    assert _stored(spark, path) == sorted(r for rows in want.values() for r in rows)
    wide = _small(spark, [("a", 7, 1.0, "Lab")], "episode_id string, step int, degrees double, region_type string")
    store.write_episodes(wide, path)
    want["a"] = [("a", 7, 1.0)]
    rows = sorted((*r, "Lab" if r[0] == "a" else None) for rows in want.values() for r in rows)
    assert _stored(spark, path) == rows
    assert store.compact(spark, path) == 7 and _stored(spark, path) == rows
    assert "LeftAnti" not in store.read_table(spark, path, "steps")._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="steps.degrees is stored as double"):
        store.write_episodes(_small(spark, [("a", 7, "x")], "episode_id string, step int, degrees string"), path)
    nothing = _small(spark, [])
    assert store.write_episodes(nothing, path) == 8 and _stored(spark, path) == rows


def test_frozen_versions_never_change(spark, tmp_path):
    path = str(tmp_path / "frozen")
    schema = "item_id string, options map<string,string>, answer string"
    rows = [("i1", {"A": "left", "B": "right"}, "A"), ("i2", {"A": "up"}, None), ("i2", {"A": "up"}, None)]
    df = spark.createDataFrame(rows, schema)
    digest = store.freeze_items(df, path, "v1")
    assert store.freeze_items(df.orderBy("answer").repartition(3), path, "v1") == digest
    assert store.freeze_items(df, path, "v2") == digest
    for other in (rows[:2], [*rows[:2], ("i2", {"A": "down"}, None)], []):
        with pytest.raises(ValueError, match="holds other items"):
            store.freeze_items(spark.createDataFrame(other, schema), path, "v1")
    back = store.frozen_items(spark, path, "v1", check=True)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    store.freeze_items(spark.createDataFrame([], schema), path, "empty")
    assert store.frozen_items(spark, path, "empty", check=True).count() == 0
    df.limit(1).write.mode("append").parquet(f"{path}/rows/{digest}")
    with pytest.raises(ValueError, match="have changed"):
        store.frozen_items(spark, path, "v2", check=True)
    with pytest.raises(FileNotFoundError):
        store.frozen_items(spark, path, "v3")


def test_marker_places_and_text(spark):
    rows = [
        (2, 9, 0, "Lamp|7", 40, 10, 100, 50, 70.0, 30.0, -0.25, 0.5, -0.9),
        (2, 9, 1, "Gone|1", 7, 8, 9, 8, None, None, 0.0, 0.0, -3.0),
        (2, 9, 2, "Book|3", 7, 8, 9, 8, 20.5, 21.5, 0.0, 0.25, 2.0),
    ]
    df = spark.createDataFrame(
        rows,
        "episode_id int, step int, det_ord int, object_id string, cmin int, rmin int, cmax int, rmax int, "
        "px_u double, px_v double, local_x double, local_y double, local_z double",
    )
    edge = spark.createDataFrame(
        [(2, 9, "egocentric", "Lamp|7", "right", "", "behind", "beyond")],
        "episode_id int, step int, edge_type string, target string, angle_x string, angle_y string, "
        "angle_z string, distance_label string",
    )
    got = {r.object_id: r for r in markers.marker_table(df, edge, show_local_xyz=True).collect()}
    assert set(got) == {"Lamp|7", "Book|3"}
    assert (got["Lamp|7"].number, got["Lamp|7"].x, got["Lamp|7"].y) == (1, 70, 30)
    assert (got["Book|3"].number, got["Book|3"].x, got["Book|3"].y) == (2, 20, 22)
    assert got["Lamp|7"].legend == "1. Lamp|7  ·  agent→obj: right/behind | beyond  ·  loc=(-0.25,0.50,-0.90)"
    assert got["Book|3"].legend == "2. Book|3  ·  loc=(0.00,0.25,2.00)"
    assert got["Lamp|7"].header == "step=9  visible=3"
    # The first marker's hue is the start of the colour circle.
    assert tuple(got["Lamp|7"].color) == (242, 36, 36)


def test_paths_with_and_without_a_scheme(spark, folder):
    listing = discover.list_files(spark, str(folder))
    assert all(r.path.startswith("file:/") for r in listing.collect())
    absolute = str(folder / "run_1" / "annotations" / "objects-house_1.csv")
    for named in (absolute, f"file://{absolute}"):
        got = {r.scene_id: r for r in discover.discover(listing, overrides={"objects": named}).collect()}
        assert got["attic"].missing == [] and got["attic"].objects.endswith("objects-house_1.csv")
    images = str(folder / "run_1" / "images")
    logged = str(folder / "run_2" / "navigation-attic.csv")
    steps = spark.createDataFrame(
        [("r", 4, None, images), ("r", 5, "gone.png", f"file:{images}"), ("r", 6, logged, images)],
        "episode_id string, step int, image_path string, images_dir string",
    )
    got = {r.step: r.image_path for r in discover.resolve_images(steps, listing).collect()}
    assert got == {4: f"{images}/img_4.png", 5: "gone.png", 6: logged}
