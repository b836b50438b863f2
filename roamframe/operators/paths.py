"""Shortest region paths over the room graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roamframe.storage import saved


def adjacency(connectivity: DataFrame) -> DataFrame:
    """Directed hops in listing order: forward, then backward where the link goes both ways."""
    usable = connectivity.where(
        (F.coalesce(F.col("from_region"), F.lit("")) != "")
        & (F.coalesce(F.col("to_region"), F.lit("")) != "")
    )
    name = F.coalesce(
        F.when(F.col("passage_id") != "", F.col("passage_id")),
        F.concat_ws("-", "from_region", "to_region"),
    )
    both = F.coalesce(F.col("bidirectional"), F.lit(True))
    hop = F.array(
        F.struct(
            F.col("from_region").alias("node"),
            F.col("to_region").alias("next"),
            (2 * F.col("row_ord")).cast("bigint").alias("hop"),
        ),
        F.when(
            both,
            F.struct(
                F.col("to_region").alias("node"),
                F.col("from_region").alias("next"),
                (2 * F.col("row_ord") + 1).cast("bigint").alias("hop"),
            ),
        ),
    )
    return (
        usable.select("scene_id", name.alias("passage"), F.explode(hop).alias("h"))
        .where(F.col("h").isNotNull())
        .select("scene_id", "passage", "h.*")
    )


# Hops walked per job: a job costs more than a hop over room graphs.
HOPS_PER_JOB = 8
START = ["scene_id", "start"]
WALK = [*START, "node"]


def search_trees(
    hops: DataFrame, starts: DataFrame, wanted: DataFrame | None = None, max_hops: int | None = None
) -> tuple[DataFrame, int]:
    """(scene_id, start, node, depth, parent, passage) of every region that a start reaches, and the largest depth.

    All starts of all scenes advance together, and a region keeps the link to its parent only.  Of the
    ways to a region the one found first by a first-in-first-out search counts: of the fewest hops, by
    the order in which their regions were found, then by hop.  A job walks a few hops and then drops
    regions reached before it; the next one goes on from those it reached with its last hop.  With
    ``wanted`` (scene_id, start, goal) a start stops once all its goals are reached.
    """
    level = starts.select(*START).distinct().select(
        *START,
        F.col("start").alias("node"),
        F.lit(0).alias("place"),
        F.struct(
            F.lit(0).alias("depth"),
            F.lit(0).alias("from"),
            F.lit(0).cast("bigint").alias("hop"),
            F.lit(None).cast("string").alias("parent"),
            F.lit(None).cast("string").alias("passage"),
        ).alias("came"),
    )
    tree = level = saved(level, "level")
    # A region goes to itself as well, so that one step has both the regions it came from and the next ones.
    here = hops.select("scene_id", F.explode(F.array("node", "next")).alias("node")).distinct()
    further = saved(
        hops.withColumnRenamed("passage", "via").unionByName(
            here.select("scene_id", "node", F.col("node").alias("next"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("bigint").alias("hop"))
        ),
        "further",
    )

    def wider(reached: DataFrame) -> DataFrame:
        onward = F.struct(
            (F.col("came.depth") + 1).alias("depth"),
            F.col("place").alias("from"),
            F.col("hop"),
            F.col("node").alias("parent"),
            F.col("via").alias("passage"),
        )
        found = reached.join(further, ["scene_id", "node"]).select(
            *START, F.col("next").alias("node"), F.when(F.col("hop").isNull(), F.col("came")).otherwise(onward).alias("came")
        )
        # A start's regions stay together: both steps below need no further shuffle.
        first = found.repartition(*START).groupBy(*WALK).agg(F.min("came").alias("came"))
        order = Window.partitionBy(*START).orderBy("came.depth", "came.from", "came.hop")
        return first.select(*WALK, F.row_number().over(order).alias("place"), "came")

    depth = 0
    while max_hops is None or depth < max_hops:
        if wanted is not None:
            reached = tree.select(*START, F.col("node").alias("goal"))
            open_ = wanted.select(*START, "goal").join(reached, [*START, "goal"], "left_anti")
            level = level.join(open_.select(*START).distinct(), START, "left_semi")
        ahead = HOPS_PER_JOB if max_hops is None else min(HOPS_PER_JOB, max_hops - depth)
        walked = level
        for _ in range(ahead):
            walked = wider(walked)
        fresh = saved(walked.join(tree.select(*WALK), WALK, "left_anti"), "level")
        depth += ahead
        tree = tree.unionByName(fresh)
        level = fresh.where(F.col("came.depth") == depth)
        if level.isEmpty():
            break
    return tree.select(*WALK, "came.depth", "came.parent", "came.passage"), depth


def rebuilt_paths(tree: DataFrame, depth: int, wanted: DataFrame) -> DataFrame:
    """``wanted`` (scene_id, start, goal) that the trees reach, with path_regions and passages.

    The way up from each goal is gathered in doubling steps: all ancestors up to 1, 2, 4, ... hops away.
    """
    goal = [*START, "goal"]
    ends = tree.select(*START, F.col("node").alias("goal"))
    walk = wanted.select(*goal).distinct().join(ends, goal).select(*goal, F.col("goal").alias("node"), F.lit(0).alias("up"))
    asked = wanted.select(*START).distinct()
    jumps = tree.where(F.col("parent").isNotNull()).join(asked, START, "left_semi").select(*WALK, F.col("parent").alias("to"))
    reach = 1
    while reach <= depth:
        jumps = saved(jumps, "jumps")
        # Each step doubles how far up the ways go: a region stays, and the one ``reach`` above it comes in.
        both = F.filter(
            F.array(F.struct("node", "up"), F.struct(F.col("to").alias("node"), (F.col("up") + reach).alias("up"))),
            lambda r: r["node"].isNotNull(),
        )
        walk = walk.join(jumps, WALK, "left").select(*goal, F.explode(both).alias("r")).select(*goal, "r.*")
        onward = jumps.select(*START, F.col("node").alias("to"), F.col("to").alias("then"))
        jumps = jumps.join(onward, [*START, "to"]).select(*WALK, F.col("then").alias("to"))
        reach *= 2
    steps = walk.join(tree.select(*WALK, "passage"), WALK)
    path = F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("down"), "node", "passage")))
    return (
        steps.groupBy(*goal)
        .agg(path.alias("path"))
        .select(
            *goal,
            F.transform("path", lambda p: p["node"]).alias("path_regions"),
            F.transform(F.slice("path", F.lit(2), F.size("path")), lambda p: p["passage"]).alias("passages"),
        )
    )


def region_path_bfs(
    connectivity: DataFrame, pairs: DataFrame, max_hops: int | None = None
) -> DataFrame:
    """Shortest path per wanted (scene_id, start, goal); pairs without one are absent."""
    wanted = saved(pairs.select(*START, "goal").distinct(), "wanted")
    tree, depth = search_trees(saved(adjacency(connectivity), "hops"), wanted, wanted, max_hops)
    return pairs.join(rebuilt_paths(tree, depth, wanted), [*START, "goal"])
