"""Hand-made episode tables."""

from roamframe.plans.tables import EpisodeTables, derive
from roamframe.storage import saved

STEPS = (
    "episode_id string, step int, pos int, image_path string, action string, degrees double, "
    "cam_x double, cam_y double, cam_z double, pitch_deg double, yaw_deg double, roll_deg double, "
    "region_id string, region_type string"
)
DETECTIONS = (
    "episode_id string, step int, det_ord int, object_id string, cmin int, rmin int, cmax int, rmax int"
)
OBJECTS = (
    "object_id string, category string, pos_x double, pos_y double, pos_z double, rot_x double, "
    "rot_y double, rot_z double"
)
STATES = (
    "episode_id string, step int, object_id string, category string, pos_x double, pos_y double, "
    "pos_z double, rot_x double, rot_y double, rot_z double, visible boolean, in_camera_fov boolean, "
    "parent_receptacle string, is_inside_receptacle boolean, receptacle_is_open boolean"
)
EVENTS = (
    "episode_id string, event_ord int, event_id string, at_timestep int, object_id string, "
    "from_receptacle string, to_receptacle string, hidden_during boolean"
)


def step(ep, n, pos=None, action="move_ahead", degrees=0.0, cam=(0, 0, 0), yaw=0.0, room=None, kind=None,
         image=True):
    return (ep, n, n if pos is None else pos, f"img_{n}.png" if image else None, action, degrees,
            *map(float, cam), 0.0, float(yaw), 0.0, room, kind)


def tables(spark, steps, detections=(), objects=(), states=(), events=(), regions=(), links=(),
           landmarks=()):
    make = spark.createDataFrame
    s = make(list(steps), STEPS)
    episodes = sorted({row[0] for row in steps})
    base = EpisodeTables(
        episodes=make([(e, "house_1", "ai2thor") for e in episodes],
                      "episode_id string, scene_id string, environment string"),
        steps=s,
        detections=make([(*d, 0, 0, 10, 10) for d in detections], DETECTIONS),
        objects=make([(o, c, *map(float, p), 0.0, 0.0, 0.0) for o, c, p in objects], OBJECTS),
        states=make([(e, n, o, c, *map(float, p), 0.0, 0.0, 0.0, False, False, r, False, None)
                     for e, n, o, c, p, r in states], STATES),
        events=make(list(events), EVENTS),
        region_trajectory=s.selectExpr("episode_id", "step as timestep", "region_id", "region_type"),
        regions=make([("house_1", i, r, label) for i, (r, label) in enumerate(regions)],
                     "scene_id string, row_ord int, region_id string, label string"),
        landmarks=make([("house_1", i, l) for i, l in enumerate(landmarks)],
                       "scene_id string, row_ord int, landmark_id string"),
        connectivity=make([("house_1", i, *c) for i, c in enumerate(links)],
                          "scene_id string, row_ord int, from_region string, to_region string, "
                          "passage_id string, bidirectional boolean"),
    )
    return derive(base, keep=saved)
