"""The same results in plain SQL over the given tables, written independently of the Spark plans."""

from __future__ import annotations

import re

N = 3  # facts per construct


def r(x: str, digits: int = 3) -> str:
    s = f"{10**digits}::double"
    return f"(round_even(({x}) * {s}, 0) / {s} + 0.0::double)"


def label_of(d: str) -> str:
    return (
        f"case when {d} <= 0.5 then 'within reach' when {d} <= 1.0 then 'nearby' "
        f"when {d} <= 1.5 then 'far' else 'beyond' end"
    )


def xdir(a: str) -> str:
    return f"case when abs({a}) < 15 or abs({a}) > 165 then '' when {a} > 0 then 'right' else 'left' end"


def axis(v: str, t: float, pos: str, neg: str) -> str:
    return f"case when {v} > {t} then '{pos}' when {v} < -{t} then '{neg}' else '' end"


def triplet(x: str, y: str, z: str) -> tuple[str, str, str]:
    return (
        xdir(f"degrees(atan2({x}, {z}))"),
        axis(y, 0.1, "above", "below"),
        axis(z, 0.0, "front", "behind"),
    )


def ego(x: str, y: str, z: str) -> str:
    return (
        f"case when {x} = 'left' then 'to your left' when {x} = 'right' then 'to your right' "
        f"when {z} = 'front' then 'ahead of you' when {z} = 'behind' then 'behind you' "
        f"when {y} = 'above' then 'above you' when {y} = 'below' then 'below you' end"
    )


def name_of(category: str, id_: str) -> str:
    bad = "('', 'undefined', 'none', 'null', 'nan', 'unknown', 'n/a', 'na')"
    return (
        f"case when {category} is not null and lower(trim({category})) not in {bad} "
        f"then trim({category}) else split_part({id_}, '|', 1) end"
    )


def phrase(id_: str) -> str:
    return (
        f"case when {id_} is null or lower({id_}) in ('', 'none', 'null') then 'on the floor' "
        f"else 'on/in the ' || split_part({id_}, '|', 1) end"
    )


def local(px: str, py: str, pz: str) -> tuple[str, str, str]:
    dx, dy, dz = f"({px} - s.cam_x)", f"({py} - s.cam_y)", f"({pz} - s.cam_z)"
    p, y = "radians(s.pitch_deg)", "radians(s.yaw_deg)"
    ahead = f"(sin({y}) * {dx} + cos({y}) * {dz})"
    return (
        f"(cos({y}) * {dx} - sin({y}) * {dz})",
        f"(cos({p}) * {dy} + sin({p}) * {ahead})",
        f"(-sin({p}) * {dy} + cos({p}) * {ahead})",
    )


def edge(kind: str, source: str, target: str, last: str, x: str, y: str, z: str, frm: str, ords: str) -> str:
    seen = "false" if kind == "inferred" else "true"
    unseen = "true" if kind == "inferred" else "false"
    tx, ty, tz = triplet("dx", "dy", "dz")
    return f"""
    select episode_id, step, '{kind}' as edge_type, source, target,
           cast(printf('%.2f', d) as double) + 0.0 as distance_metric, {label_of('d')} as distance_label,
           {seen} as visible, {tx} as angle_x, {ty} as angle_y, {tz} as angle_z,
           {unseen} as inferred, cast(last_seen as int) as last_seen, o1, o2, d
    from (select *, sqrt(dx * dx + dy * dy + dz * dz) as d from (
            select episode_id, step, {source} as source, {target} as target, {last} as last_seen,
                   {x} as dx, {y} as dy, {z} as dz, {ords} from {frm}))"""


EDGE = (
    "episode_id, step, edge_type, source, target, distance_metric, distance_label, visible, "
    "angle_x, angle_y, angle_z, inferred, last_seen"
)
LX, LY, LZ = local("p.pos_x", "p.pos_y", "p.pos_z")
MX, MY, MZ = local("m.pos_x", "m.pos_y", "m.pos_z")
FOCAL = "(224 / (2 * tan(radians(29.5))))"

VIEWS = {
    "n_objects": "select count(*) as n from embeddings",
    "ep_steps": """
    select user_id as episode_id,
           cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as step,
           event_id,
           case event_type when 'click' then 'move_ahead' when 'view' then 'rotate_right'
                when 'purchase' then 'rotate_left' when 'signup' then 'done' else 'pickup' end as action,
           case when event_type in ('view', 'purchase') then 90 else 0 end as degrees,
           cast(cast(round(value * 100) as bigint) % 500 as double) / 100 as cam_x,
           cast(1.0 as double) as cam_y,
           cast((event_id * 37) % 500 as double) / 100 as cam_z,
           cast((event_id % 3 - 1) * 30 as double) as pitch_deg,
           cast((event_id % 8) * 45 as double) as yaw_deg,
           'room|' || cast(cast(floor((extract(day from ts) - 1) / 12.0) as int) % 4 as varchar) as region_id
    from events""",
    "ep_img": "select episode_id, step, 'img_' || step || '.png' as image_path from ep_steps",
    "ep_detections": """
    select s.episode_id, s.step, j.det_ord, s.event_id,
           'Obj|' || cast((s.episode_id * 17 + ((s.event_id * 7 + j.det_ord * 5) % 12))
                          % (select n from n_objects) as varchar) as object_id,
           cast(s.event_id % 300 as int) as cmin, cast(s.event_id % 150 as int) as rmin,
           cast(s.event_id % 300 + 20 + j.det_ord as int) as cmax,
           cast(s.event_id % 150 + 30 as int) as rmax
    from ep_steps s join (values (0), (1), (2)) as j(det_ord) on j.det_ord < s.event_id % 4""",
    "ep_objects": """
    select 'Obj|' || cast(vec_id as varchar) as object_id, vec_id,
           case when label = 0 then 'Undefined' else 'Type' || cast(label as varchar) end as category,
           cast(embedding[1] as double) * 5 + 2.5 as pos_x,
           cast(embedding[2] as double) * 2 + 1 as pos_y,
           cast(embedding[3] as double) * 5 + 2.5 as pos_z
    from embeddings""",
    "ep_states": """
    select s.episode_id, s.step, s.event_id, d.object_id, o.category,
           o.pos_x + cast(floor(s.step / 20.0) as int) * 0.25::double as pos_x, o.pos_y, o.pos_z,
           v.object_id is not null as in_camera_fov,
           'CounterTop|' || cast(cast(floor(s.step / 20.0) as int) % 3 as varchar) as parent_receptacle
    from ep_steps s
    join (select distinct episode_id,
                 'Obj|' || cast((episode_id * 17 + 3) % (select n from n_objects) as varchar) as object_id
          from ep_steps) d on d.episode_id = s.episode_id
    join ep_objects o on o.object_id = d.object_id
    left join ep_detections v
      on v.episode_id = s.episode_id and v.step = s.step and v.object_id = d.object_id""",
    "ep_events": """
    select s.episode_id, 'move_' || s.episode_id || '_' || s.step as event_id, s.step as at_timestep,
           s.object_id, p.parent_receptacle as from_receptacle, s.parent_receptacle as to_receptacle,
           not s.in_camera_fov as hidden_during
    from ep_states s join ep_states p
      on p.episode_id = s.episode_id and p.object_id = s.object_id and p.step = s.step - 1
    where s.step % 20 = 0""",
    "ep_displaced": "select distinct episode_id, object_id from ep_events",
    "ep_links": """
    select cast(n_nationkey as int) as row_ord, 'room|' || cast(n_nationkey as varchar) as from_region,
           'room|' || cast((n_nationkey * 3 + 1) % 25 as varchar) as to_region,
           n_name as passage_id, n_nationkey % 5 <> 0 as bidirectional
    from nation""",
    "ep_regions": """
    select cast(n_nationkey as int) as row_ord, 'room|' || cast(n_nationkey as varchar) as region_id,
           case when n_nationkey % 4 <> 3 then 'Hall ' || n_nationkey
                else 'room|' || cast(n_nationkey as varchar) end as region_label
    from nation""",
    "ep_landmarks": """
    select 'Shelf' || r_regionkey || '|' || r_regionkey as landmark_id, 'room|' || r_regionkey as region_id
    from region""",
    "ep_passages": """
    select episode_id, step as timestep, 'door|' || (event_id % 3) as passage_id,
           'door|' || (event_id % 3) as object_id, event_id % 5 < 2 as is_open,
           case when event_id % 7 <> 0 then event_id % 2 = 0 end as is_locked,
           region_id as from_region, 'room|3' as to_region
    from ep_steps""",
    "ep_posed": """
    select d.*, coalesce(st.category, o.category) as category, coalesce(st.pos_x, o.pos_x) as pos_x,
           coalesce(st.pos_y, o.pos_y) as pos_y, coalesce(st.pos_z, o.pos_z) as pos_z,
           st.object_id is not null as from_state, st.in_camera_fov, st.parent_receptacle
    from ep_detections d join ep_objects o on o.object_id = d.object_id
    left join ep_states st
      on st.episode_id = d.episode_id and st.step = d.step and st.object_id = d.object_id""",
    "ep_visible": f"""
    select *, {r('ux')} as local_x, {r('uy')} as local_y, {r('uz')} as local_z,
           case when uz > 0.15 then {FOCAL} * (ux / uz) + 198 end as px_u,
           case when uz > 0.15 then 112 - {FOCAL} * (uy / uz) end as px_v
    from (select p.*, {LX} as ux, {LY} as uy, {LZ} as uz
          from ep_posed p join ep_steps s on s.episode_id = p.episode_id and s.step = p.step)""",
    "ep_ego": edge(
        "egocentric", "'agent'", "object_id", "null", "local_x", "local_y", "local_z", "ep_visible",
        "det_ord as o1, 0 as o2",
    ),
    "ep_near": """
    select * from (
      select *, row_number() over (partition by episode_id, step, source order by dist, n_ord) as rank
      from (select a.episode_id, a.step, a.object_id as source, a.det_ord as s_ord, b.object_id as target,
                   b.det_ord as n_ord, b.local_x - a.local_x as ddx, b.local_y - a.local_y as ddy,
                   b.local_z - a.local_z as ddz,
                   sqrt((b.local_x - a.local_x) * (b.local_x - a.local_x)
                      + (b.local_y - a.local_y) * (b.local_y - a.local_y)
                      + (b.local_z - a.local_z) * (b.local_z - a.local_z)) as dist
            from ep_visible a join ep_visible b
              on a.episode_id = b.episode_id and a.step = b.step and a.object_id <> b.object_id)
      where dist <= 1.5)""",
    "ep_allo": edge(
        "allocentric", "source", "target", "null", "ddx", "ddy", "ddz", "ep_near where rank <= 3",
        "s_ord as o1, rank as o2",
    ),
    "ep_allo1": edge(
        "allocentric", "source", "target", "null", "ddx", "ddy", "ddz", "ep_near where rank <= 1",
        "s_ord as o1, rank as o2",
    ),
    "ep_first": """
    select episode_id, object_id, step as first_step, det_ord as first_det_ord from (
      select *, row_number() over (partition by episode_id, object_id order by step, det_ord) as n
      from ep_detections) where n = 1""",
    "ep_memory": """
    select g.*, o.category, coalesce(st.pos_x, o.pos_x) as pos_x, coalesce(st.pos_y, o.pos_y) as pos_y,
           coalesce(st.pos_z, o.pos_z) as pos_z, st.parent_receptacle
    from (select s.episode_id, s.step, f.object_id, f.first_step, f.first_det_ord,
                 max(d.step) over (partition by s.episode_id, f.object_id order by s.step
                                   rows between unbounded preceding and current row) as last_seen
          from ep_steps s join ep_first f on f.episode_id = s.episode_id and s.step >= f.first_step
          left join ep_detections d
            on d.episode_id = s.episode_id and d.step = s.step and d.object_id = f.object_id) g
    join ep_objects o on o.object_id = g.object_id
    left join ep_states st
      on st.episode_id = g.episode_id and st.step = g.step and st.object_id = g.object_id""",
    "ep_gone": f"""
    select *, {r('ux')} as local_x, {r('uy')} as local_y, {r('uz')} as local_z
    from (select m.*, {MX} as ux, {MY} as uy, {MZ} as uz from ep_memory m
          join ep_steps s on s.episode_id = m.episode_id and s.step = m.step
          where m.last_seen < m.step)""",
    "ep_inferred": edge(
        "inferred", "'agent'", "object_id", "last_seen", "local_x", "local_y", "local_z", "ep_gone",
        "first_step as o1, first_det_ord as o2",
    ),
    "ep_edges": "select * from ep_ego union all select * from ep_allo union all select * from ep_inferred",
    "st_num": """
    select *, row_number() over (partition by episode_id, object_id order by step) as rn from ep_states""",
    "st_fold": """
    select episode_id, object_id, step, rn, pos_x as kx, in_camera_fov as kf, parent_receptacle as kp,
           true as keep
    from st_num where rn = 1
    union all
    select n.episode_id, n.object_id, n.step, n.rn,
           case when abs(n.pos_x - f.kx) > 1e-4 or n.in_camera_fov <> f.kf or n.parent_receptacle <> f.kp
                then n.pos_x else f.kx end,
           case when abs(n.pos_x - f.kx) > 1e-4 or n.in_camera_fov <> f.kf or n.parent_receptacle <> f.kp
                then n.in_camera_fov else f.kf end,
           case when abs(n.pos_x - f.kx) > 1e-4 or n.in_camera_fov <> f.kf or n.parent_receptacle <> f.kp
                then n.parent_receptacle else f.kp end,
           abs(n.pos_x - f.kx) > 1e-4 or n.in_camera_fov <> f.kf or n.parent_receptacle <> f.kp
    from st_fold f join st_num n
      on n.episode_id = f.episode_id and n.object_id = f.object_id and n.rn = f.rn + 1""",
    "ep_track": """
    select s.* from ep_states s join st_fold f
      on f.episode_id = s.episode_id and f.object_id = s.object_id and f.step = s.step where f.keep""",
    "dr_num": "select episode_id, step, step * 6e-5::double as x, region_id, step + 1 as rn from ep_steps",
    "dr_fold": """
    select episode_id, step, rn, x as kx, region_id as kr, true as keep from dr_num where rn = 1
    union all
    select n.episode_id, n.step, n.rn,
           case when abs(n.x - f.kx) > 1e-4 or n.region_id <> f.kr then n.x else f.kx end,
           case when abs(n.x - f.kx) > 1e-4 or n.region_id <> f.kr then n.region_id else f.kr end,
           abs(n.x - f.kx) > 1e-4 or n.region_id <> f.kr
    from dr_fold f join dr_num n on n.episode_id = f.episode_id and n.rn = f.rn + 1""",
    "ep_changes": """
    select episode_id, step as timestep, region_id from (
      select *, lag(region_id) over (partition by episode_id order by step) as before,
             row_number() over (partition by episode_id order by step) as n from ep_steps)
    where n = 1 or region_id <> before""",
    "ep_segments": """
    select * from (
      select episode_id, cast(row_number() over w - 1 as int) as seg, timestep as t0,
             lead(timestep) over w as t1, region_id as source_region_id,
             lead(region_id) over w as goal_region_id, region_id as source,
             lead(region_id) over w as goal
      from ep_changes window w as (partition by episode_id order by timestep))
    where t1 is not null and t1 > t0 and source_region_id <> goal_region_id""",
    "ep_turns": """
    select episode_id, step, action, degrees,
           cast(row_number() over (partition by episode_id order by step) - 1 as int) as ord
    from ep_steps""",
    "ep_segturns": """
    select t.episode_id, t.step, g.seg, g.t0, g.t1, t.action, t.degrees
    from ep_turns t join ep_segments g on g.episode_id = t.episode_id and t.step >= g.t0 and t.step < g.t1""",
    "ep_runs": """
    select episode_id, seg, run, min(step) as at, any_value(action) as action,
           any_value(degrees) as degrees, count(*) as n
    from (select *, sum(new) over (partition by episode_id, seg order by step) as run
          from (select *, case when action = lag(action) over w and degrees = lag(degrees) over w
                               then 0 else 1 end as new
                from ep_segturns window w as (partition by episode_id, seg order by step)))
    group by episode_id, seg, run""",
    "ep_labels": """
    select episode_id, seg, run,
           case when action like '%rotate%' then action || ' ' || degrees || '°' else action end
           || case when n > 1 then ' ×' || n else '' end as label
    from ep_runs""",
    "ep_routes": """
    select g.*, l.labels from ep_segments g
    join (select episode_id, seg, case when count(*) > 8
                 then list(label order by run)[1:7] || ['…'] else list(label order by run) end as labels
          from ep_labels group by 1, 2) l on l.episode_id = g.episode_id and l.seg = g.seg
    join (select episode_id, seg, count(*) as n from ep_segturns group by 1, 2) c
      on c.episode_id = g.episode_id and c.seg = g.seg
    where g.t1 - g.t0 <= 40 or c.n <= 20""",
    "ep_land": f"""
    select *, row_number() over (partition by episode_id, object_id order by step, det_ord) as n
    from (select *, {label_of('sqrt(local_x * local_x + local_y * local_y + local_z * local_z)')}
                 as distance_label from ep_visible)
    where distance_label = 'nearby'""",
    "ep_landmark": """
    select episode_id, step, object_id, category, distance_label,
           cast(row_number() over (partition by episode_id order by step, det_ord) - 1 as int) as ord
    from ep_land where n = 1""",
    "hops": """
    select from_region as node, to_region as next, 2 * row_ord as hop, passage_id as passage from ep_links
    union all
    select to_region, from_region, 2 * row_ord + 1, passage_id from ep_links where bidirectional""",
    "walks": """
    select region_id as start, region_id as node, 0 as depth, []::int[] as ords, [region_id] as nodes,
           []::varchar[] as passages
    from ep_regions where region_id in (select region_id from ep_changes)
    union all
    select w.start, h.next, w.depth + 1, list_append(w.ords, h.hop), list_append(w.nodes, h.next),
           list_append(w.passages, h.passage)
    from walks w join hops h on h.node = w.node
    where not list_contains(w.nodes, h.next) and w.depth < 25""",
    "ep_paths": """
    select start, node as goal, nodes, passages from (
      select *, row_number() over (partition by start, node order by depth, ords) as n from walks)
    where n = 1""",
    "ep_gaps": f"""
    select v.episode_id, v.object_id, v.step as last_seen, v.category, v.pos_x, v.pos_y, v.pos_z,
           {ego(*triplet('v.local_x', 'v.local_y', 'v.local_z'))} as seen_label
    from ep_visible v
    where not exists (select 1 from ep_displaced x
                      where x.episode_id = v.episode_id and x.object_id = v.object_id)""",
    "f_ego": f"""
    select * from (
      select episode_id, step, object_id, category, label, row_number() over (
               partition by episode_id order by step, det_ord) as rank
      from (select *, {ego(*triplet('local_x', 'local_y', 'local_z'))} as label from ep_visible)
      where label is not null) where rank <= {N}""",
    "f_swm": f"""
    select * from (
      select m.episode_id, m.step, m.object_id, m.last_seen, g.category, g.seen_label as label,
             row_number() over (partition by m.episode_id
                                order by m.step, m.first_step, m.first_det_ord) as rank
      from ep_gone m join ep_gaps g on g.episode_id = m.episode_id and g.object_id = m.object_id
        and g.last_seen = m.last_seen
      where g.seen_label is not null) where rank <= {N}""",
    "f_upd": f"""
    select * from (
      select m.episode_id, m.step, m.object_id, m.last_seen, g.category, g.seen_label,
             {ego(*triplet('m.local_x', 'm.local_y', 'm.local_z'))} as label,
             row_number() over (partition by m.episode_id
                                order by m.step, m.first_step, m.first_det_ord) as rank
      from ep_gone m join ep_gaps g on g.episode_id = m.episode_id and g.object_id = m.object_id
        and g.last_seen = m.last_seen
      where {ego(*triplet('m.local_x', 'm.local_y', 'm.local_z'))} is not null
        and exists (select 1 from ep_steps s where s.episode_id = m.episode_id
                    and s.step > m.last_seen and s.step <= m.step
                    and regexp_matches(s.action, 'move|rotate|turn|look'))) where rank <= {N}""",
    "ep_last": """
    select episode_id, max(step) as step from ep_steps group by 1""",
    "ep_pool": f"""
    select episode_id, list(ph order by id) as phrases from (
      select episode_id, {phrase('id')} as ph, min(id) as id from (
        select episode_id, from_receptacle as id from ep_events
        union select episode_id, to_receptacle from ep_events
        union select l.episode_id, m.landmark_id from ep_last l cross join ep_landmarks m)
      group by 1, 2) group by 1""",
    "f_dis0": f"""
    select * from (
      select e.*, l.step as last_step, row_number() over (
               partition by e.episode_id order by e.at_timestep, e.object_id) as rank
      from ep_events e join ep_last l on l.episode_id = e.episode_id
      where e.hidden_during and not exists (
        select 1 from ep_detections d where d.episode_id = e.episode_id and d.step = l.step
          and d.object_id = e.object_id)) where rank <= {N}""",
    "f_dis1": f"""
    select f.*, p.phrases, {phrase('f.to_receptacle')} as answer,
           case when f.from_receptacle <> f.to_receptacle then [{phrase('f.from_receptacle')}]
                else []::varchar[] end as origin
    from f_dis0 f join ep_pool p on p.episode_id = f.episode_id""",
    "f_dis2": """
    select *, [answer] || (origin || list_filter(phrases, lambda p: p <> answer
                                                 and not list_contains(origin, p)))[1:3] as own
    from f_dis1""",
    "f_dis": """
    select *, (own || list_filter(['on/in the Shelf', 'on/in the Sofa', 'on/in the Table', 'on the floor'],
                                  lambda p: not list_contains(own, p)))[1:4] as pool from f_dis2""",
    "f_allo": f"""
    select * from (
      select *, row_number() over (partition by episode_id order by step) as rank from (
        select *, {ego('angle_x', 'angle_y', 'angle_z')} as label,
               row_number() over (partition by episode_id, step order by o1, o2) as k from ep_allo)
      where k = 1 and label is not null) where rank <= {N}""",
    "f_route0": f"""
    select * from (
      select *, row_number() over (partition by episode_id order by seg) as rank,
             array_to_string(labels, ' → ') as answer,
             array_to_string(list_reverse(labels), ' → ') as rev,
             array_to_string(case when len(labels) >= 2
               then [labels[len(labels)]] || labels[2:len(labels) - 1] || [labels[1]]
               else labels end, ' → ') as swp
      from ep_routes) where rank <= {N}""",
    "f_route1": """
    select *, [answer] || (case when rev <> answer then [rev] else []::varchar[] end)
           || (case when swp <> answer and swp <> rev then [swp] else []::varchar[] end)
           || (case when 'move_ahead ×2 → rotate_left 90°' not in (answer, rev, swp)
                    then ['move_ahead ×2 → rotate_left 90°'] else []::varchar[] end) as own
    from f_route0""",
    "f_route": """
    select *, (own || list_transform(range(len(own), 4), lambda i: 'decoy_route_' || i))[1:4] as pool
    from f_route1""",
    "ep_visits": """
    select episode_id, region_id, min(timestep) as first_visit from ep_changes group by 1, 2""",
    "ep_many": "select episode_id from ep_visits group by 1 having count(*) >= 2",
    "ep_plan": """
    select episode_id, region_id, first_visit as visit_ord, first_visit from ep_visits
    where episode_id in (select episode_id from ep_many)
    union all
    select l.episode_id, g.region_id, g.row_ord, v.first_visit
    from ep_last l cross join (select * from ep_regions where row_ord < 4) g
    left join ep_visits v on v.episode_id = l.episode_id and v.region_id = g.region_id
    where l.episode_id not in (select episode_id from ep_many)""",
    "walks2": """
    select region_id as start, region_id as node, 0 as depth, []::int[] as ords, [region_id] as nodes,
           []::varchar[] as passages
    from ep_regions where region_id in (select region_id from ep_plan)
    union all
    select w.start, h.next, w.depth + 1, list_append(w.ords, h.hop), list_append(w.nodes, h.next),
           list_append(w.passages, h.passage)
    from walks2 w join hops h on h.node = w.node
    where not list_contains(w.nodes, h.next) and w.depth < 25""",
    "plan_paths": """
    select start, node as goal, nodes, passages from (
      select *, row_number() over (partition by start, node order by depth, ords) as n from walks2)
    where n = 1""",
    "f_sur0": f"""
    select * from (
      select a.episode_id, a.region_id as a, b.region_id as b, a.first_visit as va, b.first_visit as vb,
             p.nodes, p.passages, row_number() over (
               partition by a.episode_id order by a.visit_ord, b.visit_ord) as rank
      from ep_plan a join ep_plan b on a.episode_id = b.episode_id and a.visit_ord < b.visit_ord
      join plan_paths p on p.start = a.region_id and p.goal = b.region_id
      where len(p.nodes) >= 2) where rank <= {N}""",
    "decoys": """
    select x.passage_id as skipped, list('use ' || l.passage_id || ' toward ' || g.region_label
                                         order by l.row_ord)[1:3] as texts
    from ep_links x join ep_links l on l.passage_id <> x.passage_id
    join ep_regions g on g.region_id = l.to_region group by 1""",
    "f_sur": """
    select f.*, ga.region_label as source, gb.region_label as goal,
           'use ' || f.passages[1] || ' toward ' || gh.region_label as answer, d.texts,
           (select min(timestep) from ep_changes c where c.episode_id = f.episode_id) as t_first,
           (select max(timestep) from ep_changes c where c.episode_id = f.episode_id) as t_last
    from f_sur0 f join ep_regions ga on ga.region_id = f.a join ep_regions gb on gb.region_id = f.b
    join ep_regions gh on gh.region_id = f.nodes[2] join decoys d on d.skipped = f.passages[1]""",
}

BEARINGS = "['ahead of you', 'to your right', 'behind you', 'to your left']"
NONE = "'none'"


def fact(construct: str, status: str, frm: str, **c: str) -> str:
    def text(key: str) -> str:
        return f"coalesce(array_to_string({c[key]}, ' ; '), 'none')" if key in c else None

    val = lambda key, type_: f"cast({c[key]} as {type_})" if key in c else f"cast(null as {type_})"
    empty = "''"
    return f"""
    select episode_id, '{construct}' as construct, cast({c.get('rank', 'rank')} as int) as rank,
           {status} as status, {val('query_step', 'int')} as query_step,
           {val('encoding_step', 'int')} as encoding_step,
           {val('queried', 'varchar')} as queried_object_id,
           {val('reference', 'varchar')} as reference_object_id, {val('answer', 'varchar')} as answer_label,
           {text('answer_source') or NONE} as answer_source, {text('images') or empty} as image_paths,
           {text('pool') or empty} as options_pool, {text('seeds') or empty} as distractor_seeds,
           {val('object_type', 'varchar')} as object_type,
           {val('reference_object', 'varchar')} as reference_object, {val('source', 'varchar')} as source,
           {val('goal', 'varchar')} as goal, {val('reason', 'varchar')} as reason
    from {frm}"""


def img(step: str) -> str:
    return f"'img_' || {step} || '.png'"


FACTS = {
    "plan_egocentric": fact(
        "egocentric_encoding", "'ok'", "f_ego", query_step="step", encoding_step="step",
        queried="object_id", answer="label",
        answer_source="['steps[' || step || '].edges_egocentric[target=' || object_id || '].angle_relation']",
        images=f"[{img('step')}]", pool=BEARINGS, seeds="['opposite_direction', 'orthogonal_direction']",
        object_type=name_of("category", "object_id"),
    ),
    "plan_working_memory": fact(
        "spatial_working_memory", "'ok'", "f_swm", query_step="step", encoding_step="last_seen",
        queried="object_id", answer="label",
        answer_source="['steps[' || last_seen || '].edges_egocentric[target=' || object_id || '].angle_relation']",
        images=f"[{img('last_seen')}, {img('step')}]", pool=BEARINGS,
        seeds="['opposite_direction', 'orthogonal_direction', 'current_view_answer']",
        object_type=name_of("category", "object_id"),
    ),
    "plan_invisible_displacement": fact(
        "invisible_displacement", "'ok'", "f_dis", query_step="last_step", encoding_step="at_timestep",
        queried="object_id", answer="answer",
        answer_source="['displacement_events[obj_id=' || object_id || '].to_receptacle', "
        "'object_state_track[' || object_id || ']']",
        images=f"[{img('greatest(0, at_timestep - 1)')}, {img('last_step')}]", pool="pool",
        seeds="['original_location', 'nearby_receptacle', 'salient_decoy_location']",
        object_type="split_part(object_id, '|', 1)",
    ),
    "plan_spatial_updating": fact(
        "spatial_updating", "'thin'", "f_upd", query_step="step", encoding_step="last_seen",
        queried="object_id", answer="label",
        answer_source="['steps[' || step || '].edges_inferred[target=' || object_id || '].angle_relation']",
        images=f"[{img('last_seen')}, {img('step')}]", pool=BEARINGS,
        seeds="(case when seen_label <> label then [seen_label] else []::varchar[] end) "
        "|| ['pre_move_bearing', 'opposite_direction']",
        object_type=name_of("category", "object_id"),
    ),
    "plan_allocentric": fact(
        "allocentric_encoding", "'thin'",
        "(select f.*, s.category as sc, t.category as tc from f_allo f "
        "join ep_objects s on s.object_id = f.source join ep_objects t on t.object_id = f.target)",
        query_step="step", encoding_step="step", queried="target", reference="source", answer="label",
        answer_source="['steps[' || step || '].edges_allocentric[source=' || source || ',target=' "
        "|| target || '].angle_relation']",
        images=f"[{img('step')}]",
        pool="[label, 'to the left of it', 'to the right of it', 'behind it']",
        seeds="['opposite_relation', 'viewer_frame_answer']",
        object_type=name_of("tc", "target"), reference_object=name_of("sc", "source"),
    ),
    "plan_route": fact(
        "route_knowledge", "case when t1 - t0 <= 25 then 'ok' else 'thin' end", "f_route",
        query_step="t1", encoding_step="t0", answer="answer",
        answer_source="['region_trajectory[' || seg || ':' || (seg + 1) || ']', "
        "'route.turns[step>=' || t0 || ' and step<' || t1 || ']']",
        images=f"[{img('t0')}, {img('t1')}]", pool="pool",
        seeds="['reversed_sequence', 'swapped_two_turns']", object_type="goal", source="source", goal="goal",
    )
    + " union all "
    + fact(
        "route_knowledge", "'unsupported'",
        "ep_last where episode_id not in (select episode_id from f_route)", rank="1",
        reason="case when (select count(*) from ep_changes c where c.episode_id = ep_last.episode_id) < 2 "
        "then 'need_region_segments_and_actions_for_source_goal_route' "
        "else 'no_short_source_goal_region_segment' end",
    ),
    "plan_survey": fact(
        "survey_knowledge", "'thin'", "f_sur", query_step="t_last", encoding_step="t_first",
        answer="answer",
        answer_source="['world_layout.connectivity', 'plan_path[' || a || '→' || b || ']=[''' "
        "|| array_to_string(nodes, ''', ''') || ''']']",
        images=f"list_filter([case when va is not null then {img('va')} end, "
        f"case when vb is not null then {img('vb')} end], lambda p: p is not null)",
        pool="[answer] || list_filter(texts, lambda p: p <> answer)",
        seeds="['known_route_answer', 'dead_end_path']", object_type="goal", source="source", goal="goal",
    )
    + " union all "
    + fact(
        "survey_knowledge", "'unsupported'",
        "ep_last where episode_id not in (select episode_id from f_sur)", rank="1",
        reason="'no_plannable_source_goal_pair_in_layout'",
    ),
    "plan_perspective": fact(
        "perspective_taking", "'unsupported'", "ep_last", rank="1",
        reason="'edges_object_frame_empty_no_trusted_facing'",
    ),
}

VIEWS["ep_facts0"] = " union all ".join(
    f"select *, {i} as construct_ord from ({FACTS[k]})"
    for i, k in enumerate(
        [
            "plan_egocentric", "plan_allocentric", "plan_working_memory", "plan_invisible_displacement",
            "plan_spatial_updating", "plan_perspective", "plan_route", "plan_survey",
        ]
    )
)
VIEWS["ep_facts"] = """
    select *, cast(row_number() over (partition by episode_id order by construct_ord, rank) - 1 as int)
              as fact_no
    from ep_facts0"""

NAV = """
    select s.episode_id, s.step, s.event_id, s.action, s.degrees,
           case when s.event_id % 2 = 0 then true when s.event_id % 3 = 0 then false end as action_success,
           s.cam_x, s.cam_z, s.pitch_deg, s.yaw_deg, 'img_' || s.step || '.png' as image_path,
           s.region_id, d.det_ord,
           case when s.event_id % 11 = 0 or s.event_id % 13 = 0 then null else d.object_id end as object_id,
           case when s.event_id % 17 <> 0 then d.cmin end as cmin, d.rmin,
           case when s.event_id % 19 = 0 then d.cmin else d.cmax end as cmax, d.rmax
    from ep_steps s left join ep_detections d on d.episode_id = s.episode_id and d.step = s.step"""
VIEWS["ep_nav"] = NAV
VIEWS["ep_messy"] = """
    select episode_id, step, event_id,
           case when event_id % 9 <> 0 then
             ['True', ' yes ', '1', '1.0', 'no', 'NaN', '', 'FALSE'][event_id % 8 + 1] end as word,
           case when event_id % 4 = 0 then 'nan'::double else cam_x end as number
    from ep_steps"""
VIEWS["ep_boxes"] = """
    select episode_id, step, object_id,
           case when step % 5 = 0 then 'nan'::double else cmin + 0.5::double end as cmin,
           case when step % 7 <> 0 then rmin + 0.25::double end as rmin,
           case when step % 11 = 0 then 'inf'::double when step % 3 = 0 then cmin + 0.4::double
                else cmax + 0.5::double end as cmax,
           cast(rmax as double) as rmax
    from ep_detections"""
VIEWS["ep_odd"] = """
    select episode_id, step, event_id,
           case when event_id % 6 = 0 then 'None' when event_id % 6 = 1 then ''
                when event_id % 6 <> 2 then action end as action, degrees
    from ep_steps"""
VIEWS["ep_placed"] = f"""
    select p.episode_id, p.step, p.object_id, p.det_ord, o.pos_x, o.pos_y, o.pos_z, s.cam_x, s.cam_y,
           s.cam_z, s.event_id,
           {LX.replace('p.pos', 'o.pos')} as ux, {LY.replace('p.pos', 'o.pos')} as uy,
           {LZ.replace('p.pos', 'o.pos')} as uz,
           sqrt((o.pos_x - s.cam_x) * (o.pos_x - s.cam_x) + (o.pos_y - s.cam_y) * (o.pos_y - s.cam_y)
              + (o.pos_z - s.cam_z) * (o.pos_z - s.cam_z)) as dist
    from ep_detections p join ep_objects o on o.object_id = p.object_id
    join ep_steps s on s.episode_id = p.episode_id and s.step = p.step"""
VIEWS["ep_choice"] = """
    select *, labels[shift + 1:] || labels[:shift] as ordered from (
      select *, list_sum(list_transform(string_split(answer_label, ''), lambda c: unicode(c)))
                % len(labels) as shift
      from (select *, case when list_contains(own, answer_label) then own else [answer_label] || own end
                      as labels0 from (
              select *, list_filter(list_distinct_ordered, lambda x: x <> '') as own from (
                select *, list_transform(
                            list_filter(list_zip(pool, range(1, len(pool) + 1)),
                                        lambda z: list_position(pool, z[1]) = z[2]),
                            lambda z: z[1]) as list_distinct_ordered
                from (select *, string_split(options_pool, ' ; ') as pool from ep_facts
                      where status <> 'unsupported')))),
      lateral (select labels0 || list_filter(
                 ['ahead of you', 'to your right', 'behind you', 'to your left', 'on the floor',
                  'on/in the Shelf', 'on/in the Sofa', 'on/in the Table'],
                 lambda f: not list_contains(labels0, f)) as filled),
      lateral (select filled[1:4] as labels))"""
OPP = (
    "case {} when 'ahead of you' then 'behind you' when 'behind you' then 'ahead of you' "
    "when 'to your left' then 'to your right' when 'to your right' then 'to your left' end"
)
ORTH = (
    "case {} when 'ahead of you' then 'to your right' when 'behind you' then 'to your left' "
    "when 'to your left' then 'ahead of you' when 'to your right' then 'behind you' end"
)
CUE = (
    "case when {0} <= 1 then '' when {0} = 2 then 'The two images are shown in time order "
    "(first = earlier view, second = later view). ' else 'The ' || {0} || ' images are shown in time "
    "order (first = earliest, last = latest). ' end"
)
N_IMAGES = "(case when image_paths = '' then 0 else len(string_split(image_paths, ' ; ')) end)"
QUESTION = f"""{CUE.format(N_IMAGES)} || case construct
    when 'egocentric_encoding' then 'From your current view, where is the ' || object_type || ' relative to you?'
    when 'allocentric_encoding' then 'Relative to the ' || reference_object || ', where is the ' || object_type || '?'
    when 'spatial_working_memory' then 'Looking at these images in order, where was the ' || object_type
      || ' relative to you when you last saw it (an earlier image, not the last)?'
    when 'invisible_displacement' then 'Looking at these images in order, where is the ' || object_type
      || ' now (after the last image)?'
    when 'spatial_updating' then 'Looking at these images in order, where is the ' || object_type
      || ' relative to you now (in the last image)?'
    when 'route_knowledge' then 'You need to go from ' || source || ' to ' || goal
      || '. Which action sequence matches the route between these places in the views shown?'
    when 'survey_knowledge' then 'Using the layout of the space, to go from ' || source || ' to ' || goal
      || ', which connection should you use?' end"""
VIEWS["ctx_seen"] = f"""
    select episode_id, step, list({{'id': object_id, 'name': name, 'label': label, 'rel': rel}}
                                  order by det_ord) as seen
    from (select *, {name_of('category', 'object_id')} as name, {ego('tx', 'ty', 'tz')} as label,
                 case when tx <> '' then 'to your ' || tx when tz = 'front' then 'ahead of you'
                      when tz <> '' then tz || ' you' end as rel
          from (select *, {triplet('local_x', 'local_y', 'local_z')[0]} as tx,
                       {triplet('local_x', 'local_y', 'local_z')[1]} as ty,
                       {triplet('local_x', 'local_y', 'local_z')[2]} as tz from ep_visible))
    group by 1, 2"""
VIEWS["ctx_gone4"] = """
    select * from (select *, row_number() over (partition by episode_id, step
                                                order by first_step, first_det_ord) as place from ep_gone)
    where place <= 4"""
VIEWS["ctx_gone"] = f"""
    select episode_id, step, list({{'id': object_id, 'name': {name_of('category', 'object_id')}}}
                                  order by place) as gone
    from ctx_gone4 group by 1, 2"""
VIEWS["ep_preamble"] = f"""
    select *, case when contains(lower(raw), lower(answer_label))
                   then replace(replace(raw, answer_label, '[…]'), lower(answer_label), '[…]') else raw end
              as preamble
    from (select *, concat_ws(' ',
        case when k > 1 then trim({CUE.format('k')}) end,
        case when k > 1 then case construct
          when 'spatial_updating' then 'Use the earlier image to encode the object, then answer from your pose in the last image.'
          when 'spatial_working_memory' then 'The answer refers to an earlier view when the object was visible, not only the last image.'
          when 'invisible_displacement' then 'The object moves while hidden; answer its location after the last image.'
          when 'route_knowledge' then 'Plan a short route from ' || source || ' to ' || goal
            || ' (not the whole episode). The images show views near the start and goal.'
          when 'survey_knowledge' then 'Use the layout to plan from ' || source || ' to ' || goal
            || '; do not rely on memorizing every walked step.' end end,
        'You are looking around a space identified as ' || region_id || '.',
        case when len(words) = 1 then 'Also visible is ' || words[1] || '.'
             when len(words) > 1 then 'Among other things, you can see '
               || array_to_string(words[1:len(words) - 1], ', ') || ', and ' || words[len(words)] || '.' end,
        case when queried_object_id is not null then
          case when in_view then 'There is also a ' || object_type || ' in the scene.'
               else 'You previously noticed a ' || object_type || '.' end end,
        case when len(lost) > 0 then 'Some objects are no longer in view, including '
               || array_to_string(lost, ', ') || '.' end) as raw
      from (select f.*, s.region_id, {N_IMAGES} as k,
                   list_transform(list_filter(c.seen, lambda o: o.id is distinct from f.queried_object_id),
                     lambda o: 'a ' || o.name || case when o.rel is null or lower(o.label) = lower(f.answer_label)
                                                 then '' else ' (' || o.rel || ')' end) as words,
                   coalesce(len(list_filter(c.seen, lambda o: o.id = f.queried_object_id)), 0) > 0 as in_view,
                   list_transform(list_filter(g.gone, lambda o: o.id is distinct from f.queried_object_id),
                     lambda o: o.name) as lost
            from ep_facts f
            join ep_steps s on s.episode_id = f.episode_id and s.step = f.encoding_step
            left join ctx_seen c on c.episode_id = f.episode_id and c.step = f.encoding_step
            left join ctx_gone g on g.episode_id = f.episode_id and g.step = f.encoding_step
            where f.status <> 'unsupported'))"""
ITEM_ID = (
    "replace(replace({tag} || '_' || printf('%03d', fact_no) || '_' || construct || '_' || "
    "coalesce(cast(query_step as varchar), 'None') || '_' || coalesce(queried_object_id, 'None') || '_' "
    "|| {style}, '|', '_'), ' ', '_')"
)
CLASS = (
    "case when construct in ('egocentric_encoding', 'allocentric_encoding') then 1 "
    "when construct in ('spatial_working_memory', 'invisible_displacement') then 2 "
    "when construct in ('spatial_updating', 'perspective_taking') then 3 else 4 end"
)
FRAME = (
    "case when construct in ('egocentric_encoding', 'spatial_working_memory', 'spatial_updating', "
    "'route_knowledge') then 'egocentric' else 'allocentric' end"
)
WHY = (
    "list_transform(ordered, lambda v: case when v = answer_label then 'correct' when v = "
    + OPP.format("answer_label")
    + " then 'opposite_direction' when v = "
    + ORTH.format("answer_label")
    + " then 'orthogonal_direction' else 'diagnostic_decoy' end)"
)
SCENE = "'house_00000' || (1 + episode_id % 2)"
TAG = "'house_00000' || (1 + f.episode_id % 2)"
VIEWS["ep_items"] = f"""
    select f.episode_id, {ITEM_ID.format(tag=TAG, style='v.style')} as item_id, f.construct,
           {CLASS} as class, {FRAME} as frame_of_reference, 'ai2thor' as environment,
           {TAG} as scene_id,
           case when v.style = 'verbose' then p.preamble || ' ' else '' end || {QUESTION} as question,
           array_to_string(c.ordered, ' | ') as options,
           ['A', 'B', 'C', 'D'][list_position(c.ordered, f.answer_label)] as answer, f.status,
           f.query_step, f.encoding_step, v.style as question_style,
           {ITEM_ID.format(tag=TAG, style='v.other')} as paired_item_id, f.image_paths,
           array_to_string(c.why, ' ; ') as rationale,
           case when construct = 'invisible_displacement'
                then 'move_' || f.episode_id || '_' || f.encoding_step end as event_id
    from ep_facts f
    join (select episode_id, fact_no, ordered, {WHY} as why from ep_choice) c using (episode_id, fact_no)
    join (select episode_id, fact_no, preamble from ep_preamble) p using (episode_id, fact_no)
    cross join (values ('concise', 'verbose'), ('verbose', 'concise')) as v(style, other)
    union all
    select episode_id, {SCENE} || '_' || printf('%03d', fact_no) || '_' || construct || '_unsupported',
           construct, {CLASS}, {FRAME}, 'ai2thor', {SCENE}, '', '', null, 'unsupported',
           null, null, 'concise', null, '', reason, null
    from ep_facts where status = 'unsupported'"""

ANGLE = "(cast(event_id * 5 % 721 as double) / 2 - 180)"
OBJ = "p.object_id"
KEY = "episode_id, construct, rank"
HOUSE = "'house_' || lpad(cast(episode_id as varchar), 6, '0')"
RUN = "'/logs/run_' || episode_id"
ANN = f"({RUN} || case when episode_id % 2 = 0 then '/annotations' else '' end)"

_SQL = {
    "scan_navigation": f"""
      select s.episode_id, s.step, s.step as pos, s.action, cast(s.degrees as double) as degrees,
             s.action_success, {r('s.cam_x')} as cam_x, {r('s.cam_z')} as cam_z, {r('s.pitch_deg')} as pitch_deg,
             {r('s.yaw_deg')} as yaw_deg, s.image_path, s.region_id, d.object_id,
             cast(d.cmin as double) as cmin
      from (select distinct episode_id, step, action, degrees, action_success, cam_x, cam_z, pitch_deg,
                   yaw_deg, image_path, region_id from ep_nav) s
      left join (select * from ep_nav where object_id is not null) d
        on d.episode_id = s.episode_id and d.step = s.step""",
    "step_headers": """
      select episode_id, step, any_value(action) as action, any_value(image_path) as image_path,
             coalesce(array_to_string(list(object_id order by det_ord) filter (object_id is not null), ' ; '), '')
               as objects,
             cast(count(object_id) as int) as n_boxes
      from ep_nav group by 1, 2""",
    "scan_nav_bboxes": """
      select episode_id, step, object_id, cmin, rmin, cmax, rmax from ep_nav
      where object_id is not null and cmin is not null and cmax > cmin and rmax > rmin""",
    "scan_objects": f"""
      select vec_id % 8 as episode_id, object_id,
             case when vec_id % 9 = 0 then 'Old' else category end as category,
             {r('pos_x')} as pos_x, {r('pos_y')} as pos_y, {r('pos_z')} as pos_z,
             case when vec_id % 3 = 1 then 'Cup|' || vec_id || ' ; Mug|1' else '' end as receptacles
      from ep_objects""",
    "scan_object_state": f"""
      select s.episode_id, s.step, s.object_id, s.category, {r('s.pos_x')} as pos_x, {r('s.pos_y')} as pos_y,
             {r('s.pos_z')} as pos_z, s.in_camera_fov as visible, s.in_camera_fov, s.parent_receptacle,
             false as is_inside_receptacle, cast(null as boolean) as receptacle_is_open
      from ep_states s join ep_displaced d on d.episode_id = s.episode_id and d.object_id = s.object_id""",
    "scan_displacement_events": """
      select episode_id, event_id, object_id, at_timestep, from_receptacle,
             case when at_timestep % 60 <> 0 then to_receptacle end as to_receptacle,
             0.0::double as from_pos_x, 1.0::double as from_pos_y, 2.0::double as from_pos_z,
             0.5::double as to_pos_x, 1.5::double as to_pos_y, 2.5::double as to_pos_z, hidden_during,
             false as visible_just_before, cast(null as varchar) as notes
      from ep_events""",
    "passage_change_points": """
      select episode_id, timestep, passage_id, object_id, is_open, is_locked, from_region, to_region from (
        select *, lag(is_open) over w as a, lag(is_locked) over w as b, lag(from_region) over w as c,
               row_number() over w as n
        from ep_passages window w as (partition by episode_id, passage_id order by timestep))
      where n = 1 or is_open <> a or is_locked is distinct from b or from_region <> c""",
    "scan_region_trajectory": """
      select episode_id, timestep, region_id, cast(null as varchar) as region_type from ep_changes""",
    "scan_world_layout": """
      select episode_id as scene_id, 'regions' as part,
             cast(row_number() over (partition by episode_id order by region_id) - 1 as int) as row_ord,
             region_id as id, 'Room of ' || region_id as detail, 'Cup|1,' || region_id as more from ep_visits
      union all
      select episode_id, 'landmarks', 0, object_id, 'Thing', 'room|0' from ep_displaced
      union all
      select episode_id, 'connectivity',
             cast(row_number() over (partition by episode_id order by region_id) - 1 as int),
             region_id, 'door of ' || region_id,
             case when region_id like '%1' then 'true' else 'false' end from ep_visits""",
    "scan_episode_meta": """
      select l.episode_id as folder, 'ep_' || l.episode_id as episode_id, 'ai2thor' as environment,
             'house_' || l.episode_id as scene_id, cast(e.n as int) as num_displacements
      from ep_last l left join (select episode_id, count(*) as n from ep_events group by 1) e
        on e.episode_id = l.episode_id""",
    "discover_episodes": f"""
      select {RUN} as episode_root, {ANN} as annotations_dir,
             {HOUSE} as scene_id, {RUN} || '/images' as images_dir,
             {ANN} || '/navigation-' || {HOUSE} || '.csv' as navigation,
             case when episode_id % 5 <> 0 then {ANN} || '/objects-' || {HOUSE} || '.csv' end as objects,
             case when episode_id % 3 = 1 then {ANN} || '/object_state-' || {HOUSE} || '.csv' end as object_state,
             case when episode_id % 3 = 0 then {ANN} || '/episode_meta-' || {HOUSE} || '.json' end as episode_meta,
             case when episode_id % 7 = 0 then {ANN} || '/doors-' || {HOUSE} || '.csv' end as doors,
             case when episode_id % 5 <> 0 then '' else 'objects' end as missing
      from ep_last""",
    "resolve_image_paths": """
      select episode_id, step, event_id,
             case when event_id % 3 <> 0 and event_id % 5 <> 4 then
               '/runs/' || episode_id || '/images/' || case event_id % 5
                 when 1 then 'sub/shot_' || event_id || '.png' when 2 then 'img_' || step || '.png'
                 else 'shot_' || event_id || '.png' end
             end as found,
             case event_id % 5 when 0 then '/elsewhere/shot_' || event_id || '.png'
                  when 1 then 'sub/shot_' || event_id || '.png'
                  when 3 then '/runs/' || episode_id || '/images/shot_' || event_id || '.png' end as logged
      from ep_steps""",
    "flatten_detections": f"""
      select s.episode_id, s.step, s.action, d.object_id, {r('o.pos_x * 1.5', 4)} as distance, d.cmin, d.rmax
      from ep_steps s
      left join (select * from ep_detections where det_ord <> 1 and (cmin % 2 = 0 or rmin % 3 = 0)) d
        on d.episode_id = s.episode_id and d.step = s.step
      left join ep_objects o on o.object_id = d.object_id""",
    "catalog_distinct": f"""
      select distinct d.episode_id, d.object_id, o.category, {r('o.pos_x', 2)} as pos_x,
             {r('o.pos_y', 2)} as pos_y, {r('o.pos_z', 2)} as pos_z, 'c' || cast(d.cmin % 3 as varchar) as color,
             case when d.rmin % 2 = 0 then 'Shelf|1,Box|2' else '' end as receptacles,
             {r('o.pos_y', 2)} as center_y, cast(d.cmax - d.cmin as double) as size_x
      from ep_detections d join ep_objects o on o.object_id = d.object_id
      where d.det_ord <> 1 and (d.cmin % 2 = 0 or d.rmin % 3 = 0)""",
    "write_episode_tables": """
      select episode_id, version, table_name, count(*) as n_rows,
             round(sum(case when version = 1 and episode_id % 2 = 1 and table_name in ('steps', 'route_turns')
                            then cast(value as double) + 1 else cast(value as double) end), 2) as total
      from (
        select episode_id, 'episodes' as table_name, length('house_00000' || (1 + episode_id % 2)) as value
        from ep_last
        union all select episode_id, 'steps', degrees from ep_steps
        union all select episode_id, 'step_objects', 0 from ep_visible
        union all select episode_id, 'step_objects', step - last_seen from ep_gone
        union all select episode_id, 'edges', distance_metric from ep_edges
        union all select episode_id, 'route_landmarks', step * (ord + 1) from ep_landmark
        union all select episode_id, 'route_turns', degrees from ep_turns
      ) cross join (values (1), (2)) as v(version)
      group by 1, 2, 3""",
    "load_episode": f"""
      select s.episode_id, 'house_00000' || (1 + s.episode_id % 2) as scene_id, s.step, 'img_' || s.step || '.png' as image_path,
             {r('s.cam_x')} as x,
             case when v.ids is not null then v.ids when g.n > 0 then '' else 'none' end as visible_ids,
             cast(coalesce(g.n, 0) as int) as n_remembered, coalesce(a.near, 'none') as near
      from ep_steps s
      left join (select episode_id, step, string_agg(object_id, ' ; ' order by det_ord) as ids
                 from ep_visible group by 1, 2) v on v.episode_id = s.episode_id and v.step = s.step
      left join (select episode_id, step, count(*) as n from ep_gone group by 1, 2) g
        on g.episode_id = s.episode_id and g.step = s.step
      left join (select episode_id, step, coalesce(string_agg(target, ' ; ' order by o1, o2)
                        filter (edge_type = 'allocentric'), '') as near
                 from ep_edges group by 1, 2) a on a.episode_id = s.episode_id and a.step = s.step""",
    "export_json": f"""
      select s.episode_id, s.step, s.action, {r('s.cam_z')} as z,
             case when v.ids is not null then v.ids when g.n > 0 then '' else 'none' end as visible_ids,
             cast(coalesce(v.n, 0) as int) as n_ego
      from ep_steps s
      left join (select episode_id, step, string_agg(object_id, ' ; ' order by object_id) as ids,
                        count(*) as n from ep_visible group by 1, 2) v
        on v.episode_id = s.episode_id and v.step = s.step
      left join (select episode_id, step, count(*) as n from ep_gone group by 1, 2) g
        on g.episode_id = s.episode_id and g.step = s.step""",
    "read_episode_json": "select episode_id, step, action, degrees from ep_steps",
    "write_items": "select *, count(*) over () as n_items from ep_items",
    "evolve_schema": """
      select episode_id, step, action, case when event_id % 2 = 1 then region_id end as region_id from ep_steps""",
    "get_edges": f"""
      select {EDGE} from ep_inferred where (episode_id, step) in (select episode_id, step from ep_last)""",
    "list_episodes": f"""
      select episode_id, {SCENE} as scene_id, 'ai2thor' as environment, count(*) as n_steps,
             row_number() over (order by -(cast(episode_id as bigint) % 7) * 3600 - cast(episode_id as bigint),
                                episode_id) - 1 as place
      from ep_steps group by 1""",
    "filter_structural": """
      select episode_id, step, case when event_id % 3 <> 0 then kind end as type,
             kind || case when event_id % 2 = 0 then '|' else '_' end || event_id as object_id
      from (select *, ['Wall', 'Cup', 'Window', 'Room', 'Doorway', 'Plate', 'Floorlamp'][event_id % 7 + 1]
                      as kind from ep_steps)
      where kind in ('Cup', 'Plate', 'Floorlamp') or (event_id % 3 = 0 and event_id % 2 = 1)""",
    "filter_valid_ids": """
      select episode_id, step, word from ep_messy
      where word is not null and lower(trim(word)) not in ('', 'nan')""",
    "parse_bool": """
      select episode_id, step, coalesce(lower(trim(word)) in ('true', '1', 'yes'), false) as flag,
             lower(trim(word)) in ('true', '1', 'yes') as flag_or_null from ep_messy""",
    "null_clean": f"""
      select episode_id, step, case when word <> 'NaN' then word end as word,
             case when not isnan(number) then {r('number')} end as number from ep_messy""",
    "valid_bbox_detect": """
      select episode_id, step, object_id,
             case when ok then cast(round_even(cmin, 0) as int) end as cmin,
             case when ok then cast(round_even(rmin, 0) as int) end as rmin,
             case when ok then cast(round_even(cmax, 0) as int) end as cmax,
             case when ok then cast(round_even(rmax, 0) as int) end as rmax
      from (select *, rmin is not null and isfinite(cmin) and isfinite(cmax) as ok from ep_boxes)""",
    "filter_steps": """
      select episode_id, step, action from ep_steps where step between 5 and 20 or step = 30""",
    "filter_actions": """
      select episode_id, step, action from ep_odd where action is not null and lower(action) not in ('', 'nan', 'none')""",
    "filter_movement": """
      select episode_id, step, action from ep_odd where regexp_matches(lower(action), 'move|rotate|turn|look')""",
    "thresholds_block": """
      select episode_id, 1.0::double as nearby_to, 1.5::double as far_to, 15.0::double as lateral_deg,
             0.1::double as vertical_m from ep_last""",
    "select_constructs": """
      select f.episode_id, f.construct, f.rank, c.construct_ord, c.class, c.frame as frame_of_reference, s.style
      from ep_facts f join (values ('egocentric_encoding', 0, 1, 'egocentric'),
                                   ('route_knowledge', 1, 4, 'egocentric')) as c(construct, construct_ord, class, frame)
        on c.construct = f.construct
      cross join (values ('concise'), ('verbose')) as s(style)""",
    "camera_intrinsics": f"""
      select episode_id, step, object_id,
             {r('396 / (2 * tan(atan(396::double / 224 * tan(radians(29.5))))) * pos_x', 4)} as fx_x,
             {r(FOCAL, 6)} as fy, {r('degrees(2 * atan(396::double / 224 * tan(radians(29.5))))', 6)} as fov_h,
             198 as cx, 112 as cy
      from ep_placed""",
    "world_to_local": f"""
      select episode_id, step, object_id, {r('ux')} as x, {r('uy')} as y, {r('uz')} as z from ep_placed""",
    "project_pinhole": f"""
      select episode_id, step, object_id,
             case when uz > 0.15 then {r(f'{FOCAL} * (ux / uz) + 198', 2)} end as u,
             case when uz > 0.15 then {r(f'112 - {FOCAL} * (uy / uz)', 2)} end as v from ep_placed""",
    "bearing_angles": f"""
      select episode_id, step, object_id, {r('degrees(atan2(ux, uz))', 2)} as alpha,
             {r('degrees(atan2(uy, uz))', 2)} as beta from ep_placed""",
    "euclid_distance": f"select episode_id, step, object_id, {r('dist')} as distance from ep_placed",
    "distance_label": f"""
      select episode_id, step, object_id, {label_of('d')} as label
      from (select *, {r('dist', 2)} as d from ep_placed)""",
    "x_direction_angle": f"""
      select episode_id, step, {ANGLE} as angle, {xdir(ANGLE)} as direction from ep_steps""",
    "z_direction_angle": f"""
      select episode_id, step, {ANGLE} as angle,
             case when abs({ANGLE}) < 75 then 'front' when abs({ANGLE}) > 105 then 'behind' else '' end
               as direction from ep_steps""",
    "axis_direction": f"""
      select episode_id, step, {axis('(cam_x - 2.5::double)', 0.5, 'right', 'left')} as dx,
             {axis('(cam_x - 2.5::double)', 0.1, 'above', 'below')} as dy,
             {axis('(cam_x - 2.5::double)', 0.0, 'front', 'behind')} as dz from ep_steps""",
    "direction_triplet": f"""
      select episode_id, step, object_id, {triplet('dx', 'dy', 'dz')[0]} as tx,
             {triplet('dx', 'dy', 'dz')[1]} as ty, {triplet('dx', 'dy', 'dz')[2]} as tz
      from (select *, {r('pos_x - cam_x')} as dx, {r('pos_y - cam_y')} as dy, {r('pos_z - cam_z')} as dz
            from ep_placed)""",
    "bbox_center": """
      select episode_id, step, object_id, (cmin + cmax) / 2.0::double as cx, (rmin + rmax) / 2.0::double as cy,
             cast(floor((cmin + cmax) / 2.0) as int) as px, cast(floor((rmin + rmax) / 2.0) as int) as py
      from ep_detections""",
    "bbox_min_corner": f"""
      select object_id, {r('pos_x - 0.25')} as x, {r('pos_y - 0.25')} as y, {r('pos_z - 0.25')} as z
      from ep_objects""",
    "round_pose": f"""
      select object_id, {r('pos_x', 2)} as x, {r('pos_y', 2)} as y, {r('pos_z', 2)} as z from ep_objects""",
    "resolve_pose": f"""
      select episode_id, step, object_id, category, {r('pos_x')} as pos_x, {r('pos_y')} as pos_y,
             {r('pos_z')} as pos_z, from_state, parent_receptacle from ep_posed""",
    "visible_objects": f"""
      select episode_id, step, det_ord, object_id, category, {r('pos_x')} as pos_x, {r('pos_y')} as pos_y,
             {r('pos_z')} as pos_z, local_x, local_y, local_z, {r(r('px_u'), 2)} as px_u, {r(r('px_v'), 2)} as px_v,
             {r(r('degrees(atan2(ux, uz))'), 2)} as alpha, {r(r('degrees(atan2(uy, uz))'), 2)} as beta,
             cmin, rmin, cmax, rmax, in_camera_fov, parent_receptacle from ep_visible""",
    "edges_egocentric": f"select {EDGE} from ep_ego",
    "edges_allocentric": f"select {EDGE} from ep_allo",
    "edges_allocentric_k1": f"select {EDGE} from ep_allo1",
    "edges_allocentric_crowded": f"select {EDGE} from ep_allo",
    "object_memory": f"""
      select episode_id, step, object_id, category, last_seen, {r('pos_x')} as pos_x, {r('pos_y')} as pos_y,
             {r('pos_z')} as pos_z, parent_receptacle from ep_memory""",
    "non_visible_objects": f"""
      select episode_id, step, object_id, last_seen, {r('pos_x')} as pos_x, {r('pos_y')} as pos_y,
             {r('pos_z')} as pos_z from ep_gone""",
    "memory_minus_visible": "select episode_id, step, object_id, last_seen from ep_gone",
    "edges_inferred": f"select {EDGE} from ep_inferred",
    "remembered_position": f"""
      select episode_id, step, object_id, {r('pos_x')} as pos_x, {r('pos_y')} as pos_y, {r('pos_z')} as pos_z
      from ep_memory""",
    "asof_state": f"""
      select s.episode_id, s.step, s.object_id, t.step as at_step, {r('t.pos_x')} as pos_x,
             {r('t.pos_y')} as pos_y, {r('t.pos_z')} as pos_z, t.in_camera_fov, t.parent_receptacle
      from ep_states s asof left join ep_track t
        on t.episode_id = s.episode_id and t.object_id = s.object_id and s.step >= t.step""",
    "asof_series": """
      select s.episode_id, s.step, t.timestep as since, t.region_id
      from ep_steps s asof left join ep_changes t on t.episode_id = s.episode_id and s.step >= t.timestep""",
    "step_lookup": """
      select e.episode_id, s.step, e.object_id, 'img_' || s.step || '.png' as image_path, s.action
      from ep_events e join ep_steps s on s.episode_id = e.episode_id and s.step = e.at_timestep - 1""",
    "first_ego_edge": f"select {EDGE} from ep_ego",
    "first_inferred_edge": f"""
      select {EDGE} from ep_inferred e
      where exists (select 1 from ep_displaced d where d.episode_id = e.episode_id and d.object_id = e.target)""",
    "first_allocentric_edge": f"""
      select {EDGE} from (select *, row_number() over (partition by episode_id, step order by o1, o2) as n
                          from ep_allo) where n = 1""",
    "moved_between": """
      with all_marks as (
        select episode_id, object_id, step, bool_or(seen) as seen from (
          select episode_id, object_id, step, true as seen from ep_detections
          union all select episode_id, object_id, step, false from ep_states) group by 1, 2, 3)
      , spans as (
        select * from (
          select episode_id, object_id, step,
                 max(case when seen then step end) over (partition by episode_id, object_id order by step
                   rows between unbounded preceding and current row) as last_seen,
                 lead(step) over (partition by episode_id, object_id order by step) as nxt
          from all_marks) where last_seen is not null)
      select episode_id, object_id, last_seen as from_step, coalesce(nxt - 1, step) as to_step,
             exists (select 1 from ep_steps s where s.episode_id = spans.episode_id and s.step > last_seen
                     and s.step <= coalesce(nxt - 1, spans.step)
                     and regexp_matches(s.action, 'move|rotate|turn|look')) as moved
      from spans""",
    "exclude_displaced": """
      select d.episode_id, d.step, d.object_id from ep_detections d
      where not exists (select 1 from ep_displaced x
                        where x.episode_id = d.episode_id and x.object_id = d.object_id)""",
    "bbox_fallback": """
      select episode_id, step, object_id, case when ok then cmin end as cmin, case when ok then rmin end as rmin,
             case when ok then cmax end as cmax, case when ok then rmax end as rmax
      from (select *, step % 3 <> 0 or step % 2 = 0 as ok from ep_visible)""",
    "segment_turns": "select episode_id, step, seg, t0, t1, action, degrees from ep_segturns",
    "region_path_bfs": f"""
      select g.scene_id, p.start, p.goal, array_to_string(p.nodes, ',') as path_regions,
             array_to_string(p.passages, ',') as passages
      from ep_paths p join (select distinct {SCENE} as scene_id, region_id, 'room|' || (event_id % 25) as goal from ep_steps) g
        on g.region_id = p.start and g.goal = p.goal""",
    "edges_of_visible": f"select {EDGE} from ep_allo",
    "dedup_last": """
      select episode_id, object_id, step * 4 + det_ord as src, step, cmin from (
        select *, row_number() over (partition by episode_id, object_id order by step desc, det_ord desc) as n
        from ep_detections) where n = 1""",
    "first_category": """
      select episode_id, object_id, arg_min(category || '@' || step, step) as category
      from ep_states group by 1, 2""",
    "displaced_ids": "select episode_id, object_id from ep_displaced",
    "receptacle_pool": """
      select episode_id, from_receptacle as receptacle_id from ep_events
      union select episode_id, to_receptacle from ep_events
      union select l.episode_id, m.landmark_id from ep_last l cross join ep_landmarks m""",
    "visited_regions": """
      select episode_id, region_id, min(step) as first_visit from ep_steps group by 1, 2""",
    "region_labels": """
      select s.episode_id, s.step, s.region_id, g.region_label
      from ep_steps s join ep_regions g on g.region_id = s.region_id""",
    "agent_trajectory": f"""
      select episode_id, cast(floor(step / 4096) as int) as part, cast(count(*) as int) as n,
             string_agg('img_' || step || '.png', ',' order by step) as images,
             {r('max_by(cam_x, step)')} as last_x
      from ep_steps group by 1, 2""",
    "agent_actions": """
      select episode_id, cast(floor(step / 4096) as int) as part, string_agg(action, ',' order by step) as actions
      from ep_steps group by 1, 2""",
    "assemble_route": """
      select t.episode_id, t.part, coalesce(l.landmarks, 'none') as landmarks, t.turns
      from (select episode_id, cast(floor(step / 4096) as int) as part, string_agg(action, ',' order by ord) as turns
            from ep_turns group by 1, 2) t
      left join (select episode_id, cast(floor(step / 4096) as int) as part,
                        string_agg(object_id, ',' order by ord) as landmarks from ep_landmark group by 1, 2) l
        on l.episode_id = t.episode_id and l.part = t.part""",
    "assemble_steps": """
      select s.episode_id, s.step, s.region_id as current_room,
             case when v.ids is null and g.ids is null then 'none' else coalesce(v.ids, '') end as visible_ids,
             case when v.ids is null and g.ids is null then 'none' else coalesce(g.ids, '') end as remembered_ids,
             case when v.ids is null and g.ids is null then 'none' else coalesce(i.ls, '') end as inferred,
             case when v.ids is null and g.ids is null then 'none' else coalesce(v.ds, '') end as depths
      from ep_steps s
      left join (select e.episode_id, e.step, string_agg(target, ' ; ' order by o1) as ids,
                        string_agg(angle_z, ' ; ' order by o1) as ds from ep_ego e group by 1, 2) v
        on v.episode_id = s.episode_id and v.step = s.step
      left join (select episode_id, step, string_agg(object_id, ' ; ' order by first_step, first_det_ord) as ids
                 from ep_gone group by 1, 2) g on g.episode_id = s.episode_id and g.step = s.step
      left join (select episode_id, step, string_agg(distance_label, ' ; ' order by o1, o2) as ls
                 from ep_inferred group by 1, 2) i on i.episode_id = s.episode_id and i.step = s.step""",
    "edge_distances": f"""
      select episode_id, step, edge_type, {r('d')} as distance from ep_ego
      union all select episode_id, step, edge_type, {r('d')} from ep_allo""",
    "step_counts": "select episode_id, count(*) as n_steps from ep_steps group by 1",
    "item_status_counts": """
      select coalesce(status, 'total') as status, count(*) as n_items from ep_items group by rollup (status)""",
    "memory_order": """
      select episode_id, object_id, first_step, first_det_ord,
             cast(row_number() over (partition by episode_id order by first_step, first_det_ord) - 1 as int)
               as mem_ord from ep_first""",
    "change_points_exact": """
      select episode_id, step as timestep, action, degrees, region_id from (
        select *, lag(action) over w as a, lag(degrees) over w as b, row_number() over w as n
        from ep_steps window w as (partition by episode_id order by step))
      where n = 1 or action <> a or degrees <> b""",
    "change_points_eps": f"""
      select n.episode_id, n.step, {r('n.x', 6)} as x, n.region_id from dr_num n
      join dr_fold f on f.episode_id = n.episode_id and f.step = n.step where f.keep""",
    "object_state_track": f"""
      select episode_id, step, object_id, category, {r('pos_x')} as pos_x, {r('pos_y')} as pos_y,
             {r('pos_z')} as pos_z, in_camera_fov as visible, in_camera_fov, parent_receptacle from ep_track""",
    "route_landmarks": "select * from ep_landmark",
    "route_landmarks_reach": f"""
      select episode_id, step, object_id, category, distance_label,
             cast(row_number() over (partition by episode_id order by step, det_ord) - 1 as int) as ord
      from (select *, row_number() over (partition by episode_id, object_id order by step, det_ord) as n
            from (select *, {label_of('sqrt(local_x * local_x + local_y * local_y + local_z * local_z)')}
                         as distance_label from ep_visible)
            where distance_label in ('nearby', 'within reach')) where n = 1""",
    "route_turns": """
      select episode_id, step, action, degrees,
             cast(row_number() over (partition by episode_id order by step) - 1 as int) as ord
      from ep_odd where action is not null and lower(action) not in ('', 'nan', 'none')""",
    "region_segments": "select * from ep_segments",
    "action_runs": "select episode_id, seg, array_to_string(labels, ' → ') as answer from ep_routes",
    "assign_ord": """
      select episode_id, step, det_ord, object_id,
             cast(row_number() over (partition by episode_id order by step, det_ord) - 1 as int) as ord
      from ep_detections""",
    "marker_numbers": """
      select episode_id, step, object_id,
             cast(row_number() over (partition by episode_id, step order by det_ord) as int) as number,
             cast(floor((cmin + cmax) / 2.0) as int) as x, cast(floor((rmin + rmax) / 2.0) as int) as y
      from ep_visible""",
    "top_n_facts": """
      select * from (
        select episode_id, step, det_ord, object_id,
               cast(row_number() over (partition by episode_id order by step, det_ord) as int) as rank
        from ep_detections) where rank <= 3""",
    "knn_topk": """
      select episode_id, step, string_agg(object_id, ',' order by n) as near from (
        select *, row_number() over (partition by episode_id, step order by dist, det_ord) as n from ep_placed)
      where n <= 2 group by 1, 2""",
    "sort_steps": """
      select episode_id, cast(floor(step / 16) as int) as part, string_agg(action, ',' order by step) as actions
      from ep_steps group by 1, 2""",
    "sort_states": "select episode_id, step, object_id, parent_receptacle from ep_states",
    "sort_passages": "select episode_id, timestep, passage_id, is_open from ep_passages",
    "limit_options": f"""
      select {KEY}, case when len(p) = 0 then 'on the floor' else array_to_string(
               (p || case when list_contains(p, 'on the floor') then []::varchar[] else ['on the floor'] end)[1:4], ' ; ')
             end as options
      from (select *, list_transform(list_filter(list_zip(l, range(1, len(l) + 1)),
                                     lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1]) as p
            from (select *, case when options_pool = '' then []::varchar[]
                                 else string_split(options_pool, ' ; ') end as l from ep_facts))""",
    "limit_nonvisible": "select episode_id, step, object_id, cast(place as int) as place from ctx_gone4",
    "limit_images": f"""
      select {KEY}, case when image_paths = '' then 'img_x.png' else array_to_string((p || ['img_x.png'])[1:2], ' ; ')
             end as images
      from (select *, case when len(l) = 2 and l[1] = l[2] then l[1:1] else l end as p
            from (select *, string_split(image_paths, ' ; ') as l from ep_facts))""",
    "union_edges": f"select {EDGE} from ep_edges",
    "union_objects": f"""
      select episode_id, step, object_id, 'visible' as visibility, category, {r('pos_x')} as pos_x,
             {r('pos_y')} as pos_y, {r('pos_z')} as pos_z, cast(null as int) as last_seen_step from ep_visible
      union all
      select episode_id, step, object_id, 'non_visible', category, {r('pos_x')}, {r('pos_y')}, {r('pos_z')},
             last_seen from ep_gone""",
    "union_facts": f"""
      select {KEY}, queried_object_id, answer_label from ep_facts
      where construct in ('egocentric_encoding', 'allocentric_encoding')""",
    "ego_label": f"""
      select episode_id, step, source, target, {ego('angle_x', 'angle_y', 'angle_z')} as label from ep_allo""",
    "display_name": f"""
      select episode_id, step, object_id,
             case when step % 7 = 0 then split_part(object_id, '|', 1) else {name_of('category', 'object_id')} end
               as name from ep_visible""",
    "receptacle_phrase": """
      select episode_id, step, object_id, case step % 4 when 1 then 'on/in the CounterTop'
             when 2 then 'on/in the Shelf' else 'on the floor' end as phrase from ep_states""",
    "region_label": """
      select episode_id, step, case when event_id % 3 = 0 then 'Kitchen' when event_id % 5 <> 0 then region_id
             else 'a room' end as label from ep_steps""",
    "frame_cue": f"select {KEY}, {CUE.format(f'({N_IMAGES} + rank - 1)')} as cue from ep_facts",
    "question_text": f"select {KEY}, {QUESTION} as question from ep_facts where status <> 'unsupported'",
    "verbose_preamble": f"select {KEY}, preamble from ep_preamble",
    "scrub_leak": f"""
      select {KEY}, replace(replace(t, answer_label, '[…]'), lower(answer_label), '[…]') as scrubbed
      from (select *, 'It is ' || answer_label || ', or ' || upper(answer_label) as t from ep_facts)""",
    "opposite_orthogonal": f"""
      select {KEY}, {OPP.format('answer_label')} as opposite, {ORTH.format('answer_label')} as orthogonal
      from ep_facts""",
    "options_rotate": f"""
      select {KEY}, array_to_string(ordered, ' | ') as options,
             ['A', 'B', 'C', 'D'][list_position(ordered, answer_label)] as answer from ep_choice""",
    "distractor_rationale": f"select {KEY}, array_to_string({WHY}, ' ; ') as rationale from ep_choice",
    "item_id": f"""
      select {KEY}, {ITEM_ID.format(tag="'tag'", style="'concise'")} as item_id from ep_facts""",
    "pair_items": "select episode_id, item_id, paired_item_id from ep_items",
    "answer_source_path": f"select {KEY}, answer_source from ep_facts",
    "scene_of": """
      select episode_id, case when episode_id % 3 = 0 then 'house_' || episode_id
             when episode_id % 2 = 0 then 'TinyScene' else 'unknown' end as scene_id from ep_last""",
    "environment_of": """
      select episode_id, case when episode_id % 2 = 0 then 'procthor' else 'ai2thor' end as environment from ep_last""",
    "relation_text": """
      select episode_id, step, source, target,
             concat_ws(' | ', concat_ws('/', nullif(angle_x, ''), nullif(angle_y, ''), nullif(angle_z, '')),
                       distance_label) as relation from ep_allo""",
    "legend_line": """
      select episode_id, step, object_id,
             concat_ws('  ·  ', (det_ord + 1) || '. ' || object_id,
                       case when step % 2 = 0 then 'agent→obj: left/front | nearby' end,
                       'loc=(' || printf('%.2f', local_x) || ',' || printf('%.2f', local_y) || ','
                       || printf('%.2f', local_z) || ')') as line from ep_visible""",
    "contrast_color": """
      select episode_id, step, case when 0.299 * (event_id % 256) + 0.587 * (event_id * 7 % 256)
             + 0.114 * (event_id * 13 % 256) > 140 then 'black' else 'white' end as color from ep_steps""",
    "camel_tail": """
      select episode_id, step, word, tail from ep_steps
      join (values (0, 'FloorLamp', 'lamp'), (1, 'Cup', 'cup'), (2, 'objaScooterBig', 'scooter'),
                   (3, 'TV', 'v'), (4, '', '')) as w(k, word, tail) on w.k = event_id % 5""",
    "json_payload": """
      select episode_id, event_id, at_timestep, object_id, from_receptacle, to_receptacle, hidden_during
      from ep_events""",
    "plan_all": """
      select episode_id, fact_no, construct, rank, status, query_step, queried_object_id, answer_label from ep_facts""",
    "draft_items": "select * from ep_items",
    **FACTS,
}
_SQL["scan_passage_state"] = _SQL["passage_change_points"]
_SQL["resolve_image_paths"] = f"""
      select episode_id, step, event_id, coalesce(found, logged) as image_path
      from ({_SQL['resolve_image_paths']})"""
_SQL["valid_bbox_marker"] = f"""
      select episode_id, step, object_id, case when cmax > cmin and rmax > rmin then cmin end as cmin,
             case when cmax > cmin and rmax > rmin then rmin end as rmin,
             case when cmax > cmin and rmax > rmin then cmax end as cmax,
             case when cmax > cmin and rmax > rmin then rmax end as rmax
      from ({_SQL['valid_bbox_detect']})"""
VIEWS["colors"] = """
    select *, cast(floor(hue * 6) as int) as sector, hue * 6 - floor(hue * 6) as f
    from (select episode_id, step, (step * 0.61803398875::double) % 1.0::double as hue from ep_steps)"""
_P, _Q, _T, _V = (
    "0.95::double * (1.0 - 0.85::double)", "0.95::double * (1.0 - 0.85::double * f)",
    "0.95::double * (1.0 - 0.85::double * (1.0 - f))", "0.95::double",
)


def _channel(*values: str) -> str:
    cases = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"cast(floor((case sector {cases} end) * 255) as int)"


_RGB = f"""
    select episode_id, step, {_channel(_V, _Q, _P, _P, _T, _V)} as r, {_channel(_T, _V, _V, _Q, _P, _P)} as g,
           {_channel(_P, _P, _T, _V, _V, _Q)} as b from colors"""
_SQL["marker_color"] = _RGB
VIEWS["marks"] = """
    select *, row_number() over (partition by episode_id, step order by det_ord) as number,
           count(*) over (partition by episode_id, step) as n_visible from ep_visible"""
VIEWS["palette"] = _RGB.replace("from colors", "from (select *, cast(floor(hue * 6) as int) as sector, "
    "hue * 6 - floor(hue * 6) as f from (select 0 as episode_id, i as step, "
    "(i * 0.61803398875::double) % 1.0::double as hue from range(3) t(i)))")  # fmt: skip
_SQL["marker_table"] = """
    select m.episode_id, m.step, cast(m.number as int) as number, m.object_id,
           cast(floor((m.cmin + m.cmax) / 2.0) as int) as x, cast(floor((m.rmin + m.rmax) / 2.0) as int) as y,
           c.r, c.g, c.b,
           case when 0.299 * c.r + 0.587 * c.g + 0.114 * c.b > 140 then 'black' else 'white' end as text_color,
           m.number || '. ' || m.object_id || '  ·  agent→obj: '
             || concat_ws(' | ', concat_ws('/', nullif(e.angle_x, ''), nullif(e.angle_y, ''), nullif(e.angle_z, '')),
                          e.distance_label) as legend,
           'step=' || m.step || '  visible=' || m.n_visible as header
    from marks m join palette c on c.step = m.number - 1
    join ep_ego e on e.episode_id = m.episode_id and e.step = m.step and e.target = m.object_id"""


_SQL["validate_items"] = f"""
    select episode_id, {ITEM_ID.format(tag=SCENE, style="style")} as item_id, construct,
           answer_label, answer_label as again, true as agrees
    from ep_facts cross join (values ('concise'), ('verbose')) as v(style) where status <> 'unsupported'"""
VIEWS["ep_walk"] = """
    select episode_id, step,
           sum(case when regexp_matches(action, 'move|rotate|turn|look') then 1 else 0 end)
             over (partition by episode_id order by step) as moves,
           sum(case when regexp_matches(action, 'rotate|turn') then degrees else 0 end)
             over (partition by episode_id order by step) as turned
    from ep_steps"""
VIEWS["ep_span"] = """
    select f.*, cast(b.moves - a.moves as bigint) as num_movements,
           cast(b.turned - a.turned as double) as total_rotation_degrees,
           exists (select 1 from ep_detections d where d.episode_id = f.episode_id and d.step = f.query_step
                   and d.object_id = f.queried_object_id) as now_seen,
           exists (select 1 from ep_displaced d where d.episode_id = f.episode_id
                   and d.object_id = f.queried_object_id) as moved
    from ep_facts f
    join ep_walk a on a.episode_id = f.episode_id and a.step = f.encoding_step
    join ep_walk b on b.episode_id = f.episode_id and b.step = f.query_step
    where f.status <> 'unsupported'"""
_SQL["difficulty_features"] = """
    select f.episode_id, f.fact_no, f.construct, coalesce(e.n, 0) as num_relocations, f.num_movements,
           f.total_rotation_degrees, f.query_step - f.encoding_step as steps_since_seen,
           coalesce(v.n, 0) - case when f.now_seen then 1 else 0 end as num_visible_competitors
    from ep_span f
    left join (select episode_id, object_id, count(*) as n from ep_events group by 1, 2) e
      on e.episode_id = f.episode_id and e.object_id = f.queried_object_id
    left join (select episode_id, step, count(*) as n from ep_detections group by 1, 2) v
      on v.episode_id = f.episode_id and v.step = f.query_step"""
_SQL["novel_path_check"] = """
    select f.episode_id, cast(f.rank as int) as rank, array_to_string(f.nodes, ',') as path_regions,
           not exists (select 1 from ep_segments g where g.episode_id = f.episode_id
                       and g.source_region_id = f.a and g.goal_region_id = f.b) as novel
    from f_sur f"""
_RULES = [
    ("true", "answer_not_in_question", f"not contains(lower({QUESTION}), lower(answer_label))"),
    ("true", "answer_traces_to_source", "true"),
    ("construct = 'egocentric_encoding'", "visible_in_view", "now_seen"),
    ("construct = 'egocentric_encoding'", "no_delay", "query_step = encoding_step"),
    ("construct = 'spatial_working_memory'", "not_in_final_view", "not now_seen"),
    ("construct = 'spatial_working_memory'", "never_displaced", "not moved"),
    ("construct = 'invisible_displacement'", "hidden_during", "true"),
    ("construct = 'invisible_displacement'", "not_in_final_view", "not now_seen"),
    ("construct = 'invisible_displacement'", "seen_before_move",
     "exists (select 1 from ep_detections d where d.episode_id = ep_span.episode_id "
     "and d.object_id = ep_span.queried_object_id and d.step < ep_span.encoding_step)"),
    ("construct = 'spatial_updating'", "never_displaced", "not moved"),
    ("construct = 'spatial_updating'", "moved_in_between", "num_movements > 0"),
    ("construct = 'spatial_updating'", "not_in_final_view", "not now_seen"),
    ("construct = 'allocentric_encoding'", "both_visible_in_view",
     "now_seen and exists (select 1 from ep_detections d where d.episode_id = ep_span.episode_id "
     "and d.step = ep_span.query_step and d.object_id = ep_span.reference_object_id)"),
    ("construct = 'allocentric_encoding'", "no_delay", "query_step = encoding_step"),
    ("construct = 'route_knowledge'", "several_movements", "num_movements >= 2"),
    ("construct = 'route_knowledge'", "path_was_walked",
     "exists (select 1 from ep_segments g where g.episode_id = ep_span.episode_id "
     "and g.t0 = ep_span.encoding_step and g.t1 = ep_span.query_step)"),
    ("construct = 'survey_knowledge'", "several_regions_covered",
     "(select count(*) from ep_visits v where v.episode_id = ep_span.episode_id) >= 2"),
    ("construct = 'survey_knowledge'", "never_walked",
     "not exists (select 1 from f_sur f join ep_segments g on g.episode_id = f.episode_id "
     "and g.source_region_id = f.a and g.goal_region_id = f.b "
     "where f.episode_id = ep_span.episode_id and f.rank = ep_span.rank)"),
]
_SQL["must_hold_checks"] = " union all ".join(
    f"select episode_id, fact_no, construct, '{rule}' as rule, {holds} as holds from ep_span where {when}"
    for when, rule, holds in _RULES
)
_SQL["seen_count_before_k"] = """
    select v.episode_id, v.category, count(distinct v.object_id) as n_seen
    from ep_visible v join ep_last l on l.episode_id = v.episode_id where v.step <= l.step - 20
    group by 1, 2"""
VIEWS["ep_judged"] = f"""
    select f.episode_id, f.fact_no, i.* exclude (episode_id)
    from ep_facts f join ep_items i on i.episode_id = f.episode_id
      and i.item_id = case when f.status = 'unsupported'
        then {TAG} || '_' || printf('%03d', f.fact_no) || '_' || f.construct || '_unsupported'
        else {ITEM_ID.format(tag=TAG, style="i.question_style").replace('construct', 'f.construct')
              .replace('query_step', 'f.query_step')} end"""
_SQL["freeze_filter"] = """
    select episode_id, item_id, construct, question_style, question, answer from ep_judged
    where fact_no % 3 <> 0 and fact_no % 5 <> 4 and fact_no % 4 <> 0"""
_SQL["score_breakdown"] = f"""
    select construct, frame_of_reference, count(*) as n_items, {r('avg(hit)', 6)} as accuracy
    from (select *, case when fact_no % 7 <> 6
                          and answer = case when fact_no % 2 = 0 then 'B' else 'C' end then 1 else 0 end as hit
          from ep_judged where answer is not null)
    group by grouping sets ((construct), (construct, frame_of_reference))"""


def _needed(sql: str, found: set[str]) -> set[str]:
    for word in set(re.findall(r"[a-z_0-9]+", sql)):
        if word in VIEWS and word not in found:
            found.add(word)
            _needed(VIEWS[word], found)
    return found


def _with_views(sql: str) -> str:
    sql = sql.strip()
    names = _needed(sql, set())
    ctes = []
    for name in VIEWS:
        if name in names:
            recursive = re.search(rf"\b{name}\b", VIEWS[name])
            ctes.append(f"{name} as {'' if recursive else 'materialized '}({VIEWS[name].strip()})")
    inner = re.match(r"with\s", sql)
    if inner:
        return "with recursive " + ",\n".join(ctes) + ",\n" + sql[inner.end():]
    return "with recursive " + ",\n".join(ctes) + "\n" + sql


ORACLE = {key: _with_views(sql) for key, sql in _SQL.items()}
