"""Grid joins and searches against brute force, also at the poles and the date line."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mapaudit.config import AuditConfig
from mapaudit.operators.proximity import proximity_pairs
from mapaudit.operators.pyramid import descend, opened
from mapaudit.operators.skew import deal_pairs, keep_rank_one, lookup_join, measure, pair_grid, salted_join
from mapaudit.operators.spatial import nearest, nearest_both, nearest_of_many, radius_join, radius_join_sorted

R = 6371000.0


def metres(a, b):
    (la1, lo1), (la2, lo2) = a, b
    h = (math.sin(math.radians(la2 - la1) / 2) ** 2
         + math.cos(math.radians(la1)) * math.cos(math.radians(la2)) * math.sin(math.radians(lo2 - lo1) / 2) ** 2)
    return 2 * R * math.asin(min(1.0, math.sqrt(h)))


def scatter(n, seed):
    """Clusters at both poles, the date line, the equator and a city, some points exactly on edges."""
    rng = random.Random(seed)
    centres = [(89.9999, 10), (-89.9995, -120), (0, 179.9999), (0, -179.9999), (45, 0), (43.7, -79.4), (60, 180), (90, 0)]
    out = []
    for i in range(n):
        la, lo = centres[i % len(centres)]
        spread = rng.choice([1e-4, 1e-3, 1e-2])
        la = max(-90.0, min(90.0, la + rng.uniform(-spread, spread)))
        lo = lo + rng.uniform(-spread, spread) * (300 if abs(la) > 89 else 1)
        out.append((la, (lo + 180) % 360 - 180))
    return out


def points_df(spark, pts, prefix="p"):
    return spark.createDataFrame([(f"{prefix}{i:05d}", la, lo) for i, (la, lo) in enumerate(pts)],
                                 "pid string, latitude double, longitude double")


def nodes_df(spark, pts):
    return spark.createDataFrame([(f"n{i:05d}", la, lo) for i, (la, lo) in enumerate(pts)],
                                 "osm_id string, osm_lat double, osm_lon double")


STRATEGIES = ["broadcast", "shuffle"]


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("radius", [100.0, 1000.0, 50000.0])
def test_radius_join_equals_brute_force(spark, radius, strategy):
    p, n = scatter(160, 1), scatter(80, 2)
    cfg = AuditConfig(join_strategy=strategy, hot_rows=10)
    got = radius_join(points_df(spark, p), nodes_df(spark, n), radius, cfg=cfg)
    rows = [(r.pid, r.osm_id) for r in got.collect()]
    want = {(f"p{i:05d}", f"n{j:05d}") for i, a in enumerate(p) for j, b in enumerate(n) if metres(a, b) <= radius}
    assert len(rows) == len(set(rows)) and set(rows) == want and want


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_left_join_keeps_every_point_once(spark, strategy):
    p = points_df(spark, scatter(60, 3)).unionByName(
        spark.createDataFrame([("null1", None, 1.0), ("null2", None, None)], "pid string, latitude double, longitude double"))
    cfg = AuditConfig(join_strategy=strategy, hot_rows=3)
    got = radius_join(p, nodes_df(spark, [(10.0, 10.0)]), 100.0, "left", cfg=cfg).collect()
    assert len(got) == 62 and all(r.osm_id is None and r.distance_m is None for r in got)


def test_strict_leaves_out_the_edge(spark):
    a, b = (43.0, -79.0), (43.0, -79.001)
    d = metres(a, b)
    p, n = points_df(spark, [a]), nodes_df(spark, [b])
    edge = radius_join(p, n, 200.0).first().distance_m
    assert abs(edge - d) < 1e-6
    assert radius_join(p, n, edge).count() == 1 and radius_join(p, n, edge, strict=True).count() == 0


@pytest.mark.parametrize("strategy,cell_sites", [("broadcast", 1024), ("shuffle", 1024), ("auto", 16)])
def test_nearest_without_limit(spark, strategy, cell_sites):
    p, n = scatter(120, 4) + [(10.0, 100.0), (-45.0, 30.0)], scatter(40, 5)
    n += n[:5]  # several nodes at one position: the lowest id wins
    cfg = AuditConfig(join_strategy=strategy, cell_sites=cell_sites, hot_rows=10)
    got = {r.pid: r for r in nearest(points_df(spark, p), nodes_df(spark, n), "osm_id", cfg=cfg).collect()}
    assert len(got) == len(p)
    for i, a in enumerate(p):
        best = min(metres(a, b) for b in n)
        r = got[f"p{i:05d}"]
        assert abs(r.distance_m - best) < 1e-3
        assert r.site.osm_id == min(f"n{j:05d}" for j, b in enumerate(n) if b == n[int(r.site.osm_id[1:])])


@pytest.mark.parametrize("cell_sites", [1024, 16])
def test_nearest_within_radius_keeps_ties(spark, cell_sites):
    p = [(0.0, 0.0), (0.0, 0.01), (1.0, 1.0)]
    n = [(0.0, 0.0005), (0.0, -0.0005), (0.0, 0.0105), (0.0, 0.0109)]
    got = nearest(points_df(spark, p), nodes_df(spark, n), "osm_id", radius_m=100.0, ties=True,
                  cfg=AuditConfig(cell_sites=cell_sites)).collect()
    found = sorted((r.pid, r.site.osm_id if r.site else None) for r in got)
    assert found == [("p00000", "n00000"), ("p00000", "n00001"), ("p00001", "n00002"), ("p00002", None)]


def test_nearest_with_empty_sides(spark):
    p, n = points_df(spark, [(1.0, 2.0)]), nodes_df(spark, [(1.0, 2.0)])
    assert nearest(p, n.limit(0), "osm_id").first().distance_m is None
    assert nearest(p.limit(0), n, "osm_id").count() == 0
    crowd = p.limit(0)
    assert nearest_of_many(n, crowd, "pid", "osm_id").first().distance_m is None


def test_nearest_of_many(spark):
    p, n = scatter(150, 6), scatter(30, 7) + [(20.0, 20.0)]
    got = {r.osm_id: r for r in nearest_of_many(nodes_df(spark, n), points_df(spark, p), "pid", "osm_id").collect()}
    for j, b in enumerate(n):
        assert abs(got[f"n{j:05d}"].distance_m - min(metres(a, b) for a in p)) < 1e-3


def _brute(a, b):
    return [min(metres(x, y) for y in b) for x in a]


def test_nearest_both_ways(spark):
    pts, nodes = scatter(300, 21), scatter(180, 22) + [(43.7, -79.4), (-33.9, 151.2)]
    by_place, by_site = nearest_both(points_df(spark, pts), nodes_df(spark, nodes), "pid", "osm_id")
    for rows, at, mine, other in ((by_place, ("p_lat", "p_lon"), pts, nodes), (by_site, ("s_lat", "s_lon"), nodes, pts)):
        got = {(r[at[0]], r[at[1]]): r.distance_m for r in rows.collect()}
        assert set(got) == set(mine)
        for p, want in zip(mine, _brute(mine, other)):
            assert abs(got[p] - want) < 1e-3
    none = points_df(spark, []), nodes_df(spark, nodes)
    assert all(x.isEmpty() for x in nearest_both(*none, "pid", "osm_id"))


def test_far_places_meet_few_sites(spark):
    """2,000 places 60 km off 20,000 sites, and a ring of sites around them: pairs per cell stay few on every level."""
    rng = random.Random(4)
    sites = [(43.6 + rng.uniform(0, 0.28), -79.6 + rng.uniform(0, 0.5)) for _ in range(20_000)]
    places = [(44.45 + rng.uniform(0, 0.1), -79.5 + rng.uniform(0, 0.2)) for _ in range(2000)]
    s = spark.createDataFrame(sites, "s_lat double, s_lon double").cache()
    p = spark.createDataFrame(places, "p_lat double, p_lon double").cache()
    trace = []
    pairs, level = descend(p, s, trace=trace)
    assert all(n <= 100 * cells for _, cells, n in trace), trace
    met = opened(p, s, pairs, level, "for_p")
    assert met.count() < 0.01 * 2000 * 20_000
    got = met.groupBy("p_lat", "p_lon").agg(F.min("distance_m").alias("d")).collect()
    assert len(got) == 2000
    near = random.Random(1).sample(got, 20)
    assert all(abs(r.d - min(metres((r.p_lat, r.p_lon), x) for x in sites)) < 1e-3 for r in near)


def test_crowded_cells_are_split(spark):
    """100,000 sites within metres of each other, and places among them."""
    rng = random.Random(9)
    sites = [(43.7 + rng.uniform(0, 1e-3), -79.4 + rng.uniform(0, 1e-3)) for _ in range(30_000)]
    places = [(43.7 + rng.uniform(0, 1e-3), -79.4 + rng.uniform(0, 1e-3)) for _ in range(300)]
    s = spark.createDataFrame(sites, "s_lat double, s_lon double").cache()
    p = spark.createDataFrame(places, "p_lat double, p_lon double").cache()
    met = opened(p, s, *descend(p, s), "for_p")
    assert met.count() < 300 * 1000
    got = {(r.p_lat, r.p_lon): r.d for r in met.groupBy("p_lat", "p_lon").agg(F.min("distance_m").alias("d")).collect()}
    assert len(got) == 300 and all(abs(got[x] - min(metres(x, y) for y in sites)) < 1e-3 for x in places[:20])


def test_rank_with_hot_group_equals_window(spark):
    rows = [("" if i % 3 else None, i % 2, None if i % 5 == 0 else float(i % 4), i) for i in range(200)]
    rows += [("v", 9, None, 1000 + i) for i in range(40)]  # a hot group without any distance
    df = spark.createDataFrame(rows, "video string, frame int, d double, id int")
    w = Window.partitionBy("video", "frame").orderBy(F.asc_nulls_last("d"))
    want = sorted(r.id for r in df.withColumn("r", F.rank().over(w)).where("r = 1").collect())
    for hot in (10, 1_000_000):
        assert sorted(r.id for r in keep_rank_one(df, ["video", "frame"], "d", df, hot).collect()) == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, how):
    big = spark.createDataFrame([(1 if i % 3 == 0 else (None if i % 7 == 0 else i), i) for i in range(300)], "k int, i int")
    small = spark.createDataFrame([(k, f"s{k}") for k in range(0, 100)] + [(1, "again")], "k int, s string")
    want = sorted((r.i, r.s or "") for r in big.join(small, "k", how).collect())
    assert sorted((r.i, r.s or "") for r in salted_join(big, small, ["k"], how, 5).collect()) == want
    for strategy in STRATEGIES:
        cfg = AuditConfig(join_strategy=strategy, hot_rows=5)
        assert sorted((r.i, r.s or "") for r in lookup_join(big, small, ["k"], how, cfg).collect()) == want


def test_small_side_is_broadcast_and_points_are_not_shuffled(spark):
    p, n = points_df(spark, scatter(50, 8)), nodes_df(spark, scatter(20, 9))
    plan = radius_join(p, n, 100.0, "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Exchange hashpartitioning" not in plan
    big = AuditConfig(broadcast_bytes=10)
    plan = radius_join(p, n, 100.0, "left", cfg=big)._jdf.queryExecution().optimizedPlan().toString()
    assert "_row" in plan and "_cols" in plan


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("sizes", [(300, 700), (700, 40), (6, 900)])
def test_heavy_cells_are_cut_on_both_sides(spark, how, sizes):
    """Crowded cells, whichever side is crowded, and points without a match in and out of them."""
    rng = random.Random(7)
    near = lambda n: [(43.7 + rng.uniform(0, 6e-4), -79.4 + rng.uniform(0, 6e-4)) for _ in range(n)]
    p, n = near(sizes[0]) + [(43.7, -79.4)] * 20 + [(None, 1.0), (10.0, 10.0)], near(sizes[1])
    cfg = AuditConfig(join_strategy="shuffle", hot_rows=500, task_pairs=900)
    got = radius_join(points_df(spark, p), nodes_df(spark, n), 20.0, how, cfg=cfg).select("pid", "osm_id").collect()
    want = [(f"p{i:05d}", f"n{j:05d}") for i, a in enumerate(p) if a[0] is not None for j, b in enumerate(n) if metres(a, b) <= 20]
    matched = {a for a, _ in want}
    if how == "left":
        want += [(f"p{i:05d}", None) for i in range(len(p)) if f"p{i:05d}" not in matched]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and matched and len(matched) < len(p)


def test_pairs_of_one_cell_are_dealt_evenly(spark):
    """One cell of 100,000 points and 100,000 nodes: tasks of about 50 million pairs, every pair in one of them."""
    sides = [spark.range(100_000).select(F.lit(1).alias("k"), F.col("id").alias(c)) for c in ("a", "b")]
    grid = pair_grid(*sides, ["k"], AuditConfig())
    left, right = (d.groupBy("_row", "_col").count() for d in deal_pairs(*sides, ["k"], grid))
    tasks = left.withColumnRenamed("count", "p").join(right.withColumnRenamed("count", "q"), ["_row", "_col"])
    pairs = [r.p * r.q for r in tasks.collect()]
    assert sum(pairs) == 10**10 and max(pairs) < 6e7 and len(pairs) == 225


def test_size_of_a_row_counts_what_it_holds(spark):
    rows = spark.range(10).select("id", F.create_map(F.lit("name"), F.repeat(F.lit("x"), 5000)).alias("tags"))
    assert measure(rows)[0] == 10 and measure(rows)[1] > 5000 and measure(rows.limit(0))[0] == 0


def test_match_counts_with_copied_nodes(spark):
    from mapaudit.operators.proximity import match_counts, match_summary

    det = spark.createDataFrame([("a", "x", 10.0, 10.0), ("b", "x", 20.0, 20.0), ("a", "x", 10.0, 10.0), ("c", None, None, 1.0)],
                                "detection_id string, class_name string, vehicle_lat double, vehicle_lon double")
    nodes = spark.createDataFrame([(f"n{i}", 10.0, 10.0) for i in range(40)] + [("m", 10.0001, 10.0)],
                                  "osm_id string, latitude double, longitude double")
    for strategy in STRATEGIES:
        counts = match_counts(det, nodes, cfg=AuditConfig(join_strategy=strategy, hot_rows=1))
        assert {r.detection_id: r.num_nearby_osm_nodes for r in counts.collect()} == {"a": 82, "b": 0}
    assert match_summary(counts).first().max_matches == 82


def test_audit_is_the_same_on_every_path(spark, sf):
    from mapaudit import inputs
    from mapaudit.operators.audit import fct_map_audit
    from mapaudit.operators.staging import from_typed, stage_detections, stage_nodes

    det = inputs.detections(spark, sf)
    parked = F.col("event_id") % 3 == 0  # a third of all rows: one blank video, one frame, one place
    det = det.withColumns({
        "video_name": F.when(parked, "").otherwise(F.col("video_name")),
        "frame_number": F.when(parked, 0).otherwise(F.col("frame_number")),
        "vehicle_lat": F.when(parked, 43.70001).otherwise(F.col("vehicle_lat")),
        "vehicle_lon": F.when(parked, -79.40001).otherwise(F.col("vehicle_lon"))})
    staged, nodes = stage_detections(from_typed(det)), stage_nodes(inputs.osm_nodes(spark, sf))

    def answer(**cfg):
        fct = fct_map_audit(staged, nodes, AuditConfig(**cfg))
        return sorted(map(str, fct.select("detection_id", "nearest_osm_node_id", "audit_status").collect()))

    want = answer()
    assert answer(hot_rows=20) == want
    assert answer(hot_rows=20, join_strategy="shuffle") == want
    assert answer(hot_rows=20, join_strategy="shuffle", pair_nodes=0) == want
    assert answer(pair_nodes=0, cell_sites=16) == want


def test_exact_ties_on_every_path(spark):
    """Detections midway between two nodes, east and west or north and south: both stay on every path."""
    at = F.lit(40.0) + F.col("id") / 100.0
    base = spark.range(0, 2000).select("id", at.alias("lat"), (F.lit(-79.0) + (F.col("id") % 97) / 50.0).alias("lon"))
    step = 2.0 ** -12  # exact in binary, so both distances are equal
    lat, lon = F.round(F.col("lat") * 4096) / 4096, F.round(F.col("lon") * 4096) / 4096
    base = base.select("id", lat.alias("latitude"), lon.alias("longitude"))
    nodes = base.select(F.col("id"), F.explode(F.array(F.lit(-step), F.lit(step))).alias("d"), "latitude", "longitude").select(
        F.concat_ws("-", "id", F.col("d") > 0).alias("osm_id"), F.col("latitude").alias("osm_lat"), (F.col("longitude") + F.col("d")).alias("osm_lon"))
    points = base.select(F.col("id"), "latitude", "longitude").cache()
    counts = set()
    for strategy in ("broadcast", "shuffle"):
        for cell_sites in (16, 1024):
            cfg = AuditConfig(join_strategy=strategy, cell_sites=cell_sites)
            near = nearest(points, nodes, "osm_id", radius_m=100.0, ties=True, cfg=cfg)
            counts.add((near.where("distance_m is not null").count(), near.select("id").distinct().count()))
    pairs = radius_join(points, nodes, 100.0).groupBy("id").agg(F.min("distance_m").alias("m"))
    all_tied = radius_join(points, nodes, 100.0).join(pairs, "id").where("distance_m = m").count()
    assert counts == {(all_tied, 2000)} and all_tied >= 3900


def test_merged_tiles_keep_their_tags(spark):
    from mapaudit.operators.coverage import merge_tiles

    rows = [("1", 2, 1.0, 2.0, {"name": "b"}), ("1", 1, 1.0, 2.0, {"name": "a", "crossing": "yes"}), ("2", 3, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "osm_id string, tile_no int, latitude double, longitude double, tags map<string,string>")
    got = {r.osm_id: (r.tile_no, r.tags) for r in merge_tiles(df).collect()}
    assert got == {"1": (1, {"name": "a", "crossing": "yes"}), "2": (3, None)}


def test_shuffled_joins_are_not_broadcast_by_file_size(spark):
    """Spark takes rows made since for as few as the file they come from: a join sized by count must not be left to that."""
    big, small = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).select(F.col("id").alias("k"), F.lit("s").alias("s"))
    plan = salted_join(big, small, ["k"], "left", 1000)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_a_place_is_searched_once(spark):
    """Rows of crowded places reach the rank as one row for each tied position, not one for each node in reach."""
    from mapaudit.operators.audit import nearest_within_radius

    det = spark.range(400).select(F.col("id").cast("string").alias("detection_id"), F.lit("v").alias("video_name"),
                                  F.col("id").cast("int").alias("frame_number"), F.lit(43.7).alias("latitude"), F.lit(-79.4).alias("longitude"))
    nodes = spark.range(30).select(F.col("id").cast("string").alias("osm_id"), F.lit("stop").alias("normalized_type"),
                                   (F.lit(43.7) + (F.col("id") + 1) * 1e-5).alias("latitude"), F.lit(-79.4).alias("longitude"))
    near = nearest_within_radius(det, nodes)
    assert "_n_band" not in near._jdf.queryExecution().optimizedPlan().toString()
    assert near.count() == 400 and near.select("nearest_osm_node_id").distinct().collect() == [("0",)]


def test_tasks_follow_pairs(spark, monkeypatch):
    """Few bytes that make many pairs are many tasks."""
    from mapaudit.operators import skew

    monkeypatch.setattr(skew, "_TASK_WORK", 10_000)
    monkeypatch.setattr(skew, "_LEAST_PAIRS", 1_000)
    points = points_df(spark, [(43.7 + i * 1e-7, -79.4) for i in range(600)])
    nodes = nodes_df(spark, [(43.7 + i * 1e-7, -79.4) for i in range(600)])
    pairs = radius_join(points, nodes, 100.0, cfg=AuditConfig(join_strategy="shuffle"))
    sizes = [n for n in pairs.rdd.glom().map(len).collect()]
    assert sum(sizes) == 600 * 600 and len(sizes) > 30 and max(sizes) < 90_000


def crowd(seed, n):
    """Points and nodes of a map that is much larger than the place where the points are."""
    rng = random.Random(seed)
    points = [(43.7 + rng.uniform(0, 2e-3), -79.4 + rng.uniform(0, 2e-3)) for _ in range(n)]
    nodes = [(43.7 + rng.uniform(0, 2e-3), -79.4 + rng.uniform(0, 2e-3)) for _ in range(40)]
    return points, nodes + [(10 + i * 1e-2, 20.0) for i in range(400)]


ONLY_MET = AuditConfig(broadcast_bytes=600 * 400)  # too little for the whole cover, enough for that of occupied cells


@pytest.mark.parametrize("how", ["inner", "left"])
def test_nodes_far_from_every_point_do_not_make_the_join_shuffle_both_sides(spark, how):
    p, n = crowd(31, 200)
    points = points_df(spark, p + [(None, 1.0), (80.0, 1.0)])
    got = radius_join(points, nodes_df(spark, n), 50.0, how, cfg=ONLY_MET)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = [(f"p{i:05d}", f"n{j:05d}") for i, a in enumerate(p) for j, b in enumerate(n) if metres(a, b) <= 50]
    if how == "left":
        alone = {f"p{i:05d}" for i in range(len(p) + 2)} - {a for a, _ in want}
        want += [(a, None) for a in alone]
    assert sorted(map(tuple, got.select("pid", "osm_id").collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("copies", [1, 3])
@pytest.mark.parametrize("cfg", [ONLY_MET, AuditConfig(), AuditConfig(join_strategy="shuffle"), AuditConfig(task_pairs=5)])
def test_sorted_pairs_come_in_order(spark, cfg, copies):
    """Also where one id is several rows, and where it has more pairs than a task should take."""
    p, n = crowd(32, 120)
    points = points_df(spark, [at for k in range(copies) for at in p]).withColumn("pid", F.expr(f"concat('p', substr(pid, 2) % {len(p)})"))
    order = ["pid", "distance_m", "osm_id"]
    got = [tuple(r) for r in radius_join_sorted(points, nodes_df(spark, n), 50.0, order, strict=True, cfg=cfg).select(*order).collect()]
    want = radius_join(points, nodes_df(spark, n), 50.0, strict=True, cfg=AuditConfig(join_strategy="shuffle")).select(*order)
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100 * copies


def test_sorted_pairs_are_not_shuffled(spark):
    p, n = crowd(33, 200)
    det = points_df(spark, p).selectExpr("pid as detection_id", "'stop sign' as class_name", "latitude as vehicle_lat", "longitude as vehicle_lon")
    nodes = nodes_df(spark, n).selectExpr("osm_id", "'stop' as osm_type", "osm_lat as latitude", "osm_lon as longitude")
    plan = proximity_pairs(det, nodes, 50.0, cfg=ONLY_MET)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Sort [") < plan.index("BroadcastHashJoin") < plan.index("Exchange rangepartitioning")
    assert plan.count("Exchange rangepartitioning") == 1


@pytest.mark.parametrize("ties", [True, False])
@pytest.mark.parametrize("cfg", [ONLY_MET, AuditConfig(broadcast_bytes=10), AuditConfig(join_strategy="shuffle", task_pairs=40)])
def test_nearest_of_crowded_cells(spark, cfg, ties, monkeypatch):
    """All positions distinct and in a few cells: found by the sites near them, in many tasks."""
    from mapaudit.operators import skew

    monkeypatch.setattr(skew, "_LEAST_PAIRS", 100)
    p, n = crowd(34, 300)
    p += [(80.0, 1.0)]
    got = nearest(points_df(spark, p), nodes_df(spark, n), "osm_id", radius_m=100.0, ties=ties, cfg=cfg).collect()
    want = {}
    for i, a in enumerate(p):
        d, j = min((metres(a, b), j) for j, b in enumerate(n))
        want[f"p{i:05d}"] = n[j] if d <= 100 else (None, None)
    assert {r.pid: (r.s_lat, r.s_lon) for r in got} == want and len(got) == len(p)


def test_crowded_cells_are_dealt_by_pairs_not_rows(spark, monkeypatch):
    """Far fewer points than ``hot_rows`` in a cell, but with many sites each: several tasks, not one."""
    from mapaudit.operators import skew, spatial

    monkeypatch.setattr(skew, "_LEAST_PAIRS", 100)
    monkeypatch.setattr(skew, "_TASK_WORK", 1000)
    sizes, whole = [], spatial.cut

    def seen(df, label="cut"):
        if label == "local":
            sizes.extend(df.rdd.glom().map(len).collect())
        return whole(df, label)

    monkeypatch.setattr(spatial, "cut", seen)
    places = points_df(spark, [(43.7 + i * 1e-7, -79.4) for i in range(600)])
    nodes = nodes_df(spark, [(43.7 + i * 1e-6, -79.4001) for i in range(20)])
    nearest(places, nodes, "osm_id", radius_m=100.0, cfg=AuditConfig(broadcast_bytes=10)).collect()
    assert sum(sizes) == 600 and max(sizes) < 150


@pytest.mark.parametrize("per", ["frame", "detection"])
@pytest.mark.parametrize("cfg", [AuditConfig(broadcast_bytes=384 * 100), AuditConfig(broadcast_bytes=10, hot_rows=3), AuditConfig(join_strategy="shuffle", hot_rows=3)])
def test_rows_meet_only_the_nodes_of_their_answers(spark, cfg, per):
    """All nodes are too many for a broadcast, those at a nearest position are not: ranked rows are not shuffled to meet them."""
    from mapaudit.operators.audit import nearest_within_radius

    p, n = crowd(35, 50)
    det = points_df(spark, p * 4 + [(80.0, 1.0), (None, None)]).selectExpr(
        "pid as detection_id", "'v' as video_name", "cast(substr(pid, 2) as int) as frame_number", "latitude", "longitude")
    nodes = nodes_df(spark, n + n[:40]).selectExpr("osm_id", "'stop' as normalized_type", "osm_lat as latitude", "osm_lon as longitude")
    near = nearest_within_radius(det, nodes, cfg, per)
    if cfg.broadcast_bytes == 384 * 100:
        assert "SortMergeJoin" not in near._jdf.queryExecution().executedPlan().toString()
    want = [("p00200", None), ("p00201", None)]
    for i, a in enumerate(p * 4):
        d, j = min((metres(a, b), j) for j, b in enumerate(n))
        want += [(f"p{i:05d}", f"n{k:05d}") for k in (j, len(n) + j)] if d <= 100 else [(f"p{i:05d}", None)]
    assert sorted(map(tuple, near.select("detection_id", "nearest_osm_node_id").collect()), key=str) == sorted(want, key=str)
