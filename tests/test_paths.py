import random
from collections import deque

from roamframe.operators.paths import adjacency, rebuilt_paths, region_path_bfs, search_trees

LINKS = "scene_id string, row_ord int, from_region string, to_region string, passage_id string, bidirectional boolean"


def scenes(seed):
    """Two random scenes with the same names, a long chain, and a scene whose regions are not linked."""
    rng = random.Random(seed)
    rows = []
    for scene in ("s1", "s2"):
        for i in range(30):
            a, b = rng.sample(range(14), 2)
            rows.append((scene, i, f"r{a}", f"r{b}", rng.choice([f"p{i}", None, ""]), rng.choice([True, False, None])))
    rows += [("long", i, f"r{i}", f"r{i + 1}", f"p{i}", False) for i in range(21)]
    rows += [("odd", 0, "", "r1", "p", True), ("odd", 1, "r1", None, "p", True), ("odd", 2, "r1", "r1", "p", True)]
    return rows


def first_in_first_out(rows, scene, start, goal):
    hops = {}
    for s, _, a, b, name, both in rows:
        if s == scene and a and b:
            label = name or f"{a}-{b}"
            hops.setdefault(a, []).append((b, label))
            if both is None or both:
                hops.setdefault(b, []).append((a, label))
    seen, queue = {start}, deque([(start, [start], [])])
    while queue:
        node, path, used = queue.popleft()
        if node == goal:
            return path, used
        for to, label in hops.get(node, []):
            if to not in seen:
                seen.add(to)
                queue.append((to, [*path, to], [*used, label]))
    return None


def test_paths_are_those_of_a_plain_search(spark):
    rows = scenes(4)
    pairs = [(s, f"r{a}", f"r{b}") for s in ("s1", "s2", "odd", "none") for a in range(0, 14, 3) for b in range(14)]
    pairs += [("long", "r0", "r21"), ("long", "r3", "r3"), ("long", "r5", "r2")]
    wanted = spark.createDataFrame([*pairs, pairs[0]], "scene_id string, start string, goal string")
    got = region_path_bfs(spark.createDataFrame(rows, LINKS), wanted).collect()
    found = {(r.scene_id, r.start, r.goal): (r.path_regions, r.passages) for r in got}
    expected = {p: first_in_first_out(rows, *p) for p in pairs}
    assert found == {p: path for p, path in expected.items() if path is not None}
    # Repeated wanted rows come back as often as they were asked for.
    assert len(got) == len(found) + (expected[pairs[0]] is not None)


def test_a_start_stops_when_its_goals_are_reached(spark):
    hops = adjacency(spark.createDataFrame([r for r in scenes(1) if r[0] == "long"], LINKS))
    starts = spark.createDataFrame([("long", "r0")], "scene_id string, start string")
    near = spark.createDataFrame([("long", "r0", "r2")], "scene_id string, start string, goal string")
    whole, _ = search_trees(hops, starts)
    tree, depth = search_trees(hops, starts, near)
    assert whole.count() == 22 and tree.count() < 12
    assert rebuilt_paths(tree, depth, near).first().path_regions == ["r0", "r1", "r2"]
    few, _ = search_trees(hops, starts, max_hops=3)
    assert few.count() == 4
    assert not [f for f in tree.dtypes if "array" in f[1]]
