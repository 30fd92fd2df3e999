"""Scenes, buses, viewer queries and documents."""

import io
import itertools
import math
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wirelake.functions import time as wtime
from wirelake.operators import clustering as K
from wirelake.operators.assignment import assign
from wirelake.operators.segments import build_segments
from wirelake.plans import busmap, reports, scenes, viewer
from wirelake.sources import documents

GOLD = "_source_file string, signal_source string, channel int, signal_name string, timestamp_ns long, timestamp_s double, event_time timestamp, signal_value double, signal_str string"


def test_segment_vectors():
    assert build_segments([], [], 0, 100, 10, 2, 500) == [(i * 10.0, (i + 1) * 10.0, False) for i in range(10)]
    assert build_segments([5.0], [9.0], 0, 20, 10, 2, 500) == [(0, 5.0, False), (5.0, 10.0, True), (10.0, 20, False)]
    assert build_segments([], [], 0, 100.5, 10, 2, 500)[-1] == (90.0, 100.5, False)
    assert build_segments([], [], 3, 3, 10, 2, 500) == [(3, 3, False)] and build_segments([], [], 0, 1, 10, 2, 500) == [(0, 1, False)]
    kept = build_segments([5.0, 15.0], [1.0, 99.0], 0, 20, 10, 2, 2)
    assert (5.0 not in [s[0] for s in kept]) and (10.0 in [s[0] for s in kept])  # the weakest goes


@given(st.lists(st.tuples(st.floats(-5, 105), st.floats(0, 50)), max_size=40), st.floats(1, 30), st.floats(0.1, 5), st.integers(0, 20))
@settings(max_examples=100, deadline=None)
def test_segments_tile(points, window, least, most):
    least = min(least, window)
    parts = build_segments([p for p, _ in points], [s for _, s in points], 0.0, 100.0, window, least, most)
    assert parts[0][0] == 0.0 and parts[-1][1] == 100.0
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and all(z - a >= least - 1e-9 for a, z, _ in parts)


def test_fit_over_blocks(spark):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 0.3, (n, 5)) for c, n in ((0, 70), (4, 50), (-3, 40), (9, 21))])
    x[::7, 2], x[3, 1], x[5, 4] = 0.0, np.nan, np.inf
    plain = np.where(np.isfinite(x), x, 0.0)
    for blocks in (K.Local(x), K.Local(x, 13)):
        assert K.medians(blocks) == pytest.approx(np.median(plain, axis=0), abs=0) and K.medians(K.Local(x[:-1], 50)) == pytest.approx(np.median(plain[:-1], axis=0), abs=0)
    spread = K.Spread(spark.createDataFrame([(f"{i:04d}", row.tolist()) for i, row in enumerate(x)], "id string, v array<double>").coalesce(2), "id", "v", 18)
    assert spread.n == len(x) and len(spread.first) > spread.FAN
    chosen = [K.choose_k(b, 2, 6, 42) for b in (K.Local(plain), K.Local(plain, 13))]
    assert chosen[0] == chosen[1]
    models = [K.fit_model(b, 4, 2, 6, 42) for b in (K.Local(x), K.Local(x, 13), spread)]
    for m in models:
        assert m.k == 4 and np.allclose(m.centers, models[0].centers) and np.allclose(m.middle, np.median(plain, axis=0))
    scaled = models[0].scaled(x)
    labels = models[0].assign(x)[0]
    assert np.bincount(labels).tolist() == [70, 50, 40, 21]
    assert all(np.allclose(models[0].centers[j], scaled[labels == j].mean(axis=0)) for j in range(4))
    spread.release()


def test_rules_compile():
    assert scenes.interval("gt", 5.0) == ("identity", math.nextafter(5.0, math.inf), math.inf)
    assert scenes.interval("abs_le", 2.0) == ("abs", -math.inf, 2.0) and scenes.interval("between", 1.0, 2.0) == ("identity", 1.0, 2.0) and scenes.interval("eq", 3.0) == ("identity", 3.0, 3.0)
    row = dict(rule_id="r", condition_index="0", label="l", priority="1", signal_source="CAN", channel=None, signal_name="x", feature="max_v", op="gt", value_a="1", value_b=None, negate=None)
    conditions, rules = scenes.compile_rules([row, {**row, "condition_index": "1", "negate": "TRUE"}, {**row, "rule_id": " "}])
    assert rules == [("r", "l", 1, 2)] and conditions[1][-1] is True and conditions[0][3] == "*"
    for bad in ({"op": "near"}, {"feature": "colour"}, {"op": "between"}):
        with pytest.raises(ValueError):
            scenes.compile_rules([{**row, **bad}])
    with pytest.raises(ValueError):
        scenes.compile_rules([row, {**row, "label": "other"}])


def test_weights_and_score(spark):
    assert scenes.parse_weights("1,1,2") == (0.25, 0.25, 0.5)
    for bad in ("1,2", "0,0,0", "a,b,c"):
        with pytest.raises(ValueError):
            scenes.parse_weights(bad)
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (1e9, 1e9, 1e9), (-5.0, -1.0, None), (1.0, 2.0, 3.0)], "d double, z double, r double")
    got = [r[0] for r in df.select(scenes.anomaly_score("d", "z", "r", (0.45, 0.40, 0.15), 3.0)).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(100.0) and got[2] == 0.0 and got[3] == pytest.approx(100 * (1 - math.exp(-(0.45 + 0.8 + 0.45) / 3)))


def test_clustering():
    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(c, 0.1, (40 + 10 * i, 3)) for i, c in enumerate((0, 5, 10))])
    m = K.fit_model(x, 0, 2, 6, 42)
    labels, distance = m.assign(x)
    assert m.k == 3 and sorted(np.bincount(labels).tolist(), reverse=True) == [60, 50, 40] and np.bincount(labels)[0] == 60
    assert (labels == K.fit_model(x, 0, 2, 6, 42).assign(x)[0]).all() and (distance >= 0).all()
    assert K.kmeans_fit(np.zeros((4, 2)), 9, 1).centers.shape == (4, 2)
    scaled, middle, spread = K.robust_scale(np.array([[1.0, 5.0], [2.0, 5.0], [9.0, 5.0]]))
    assert middle.tolist() == [2.0, 5.0] and spread[1] == 1.0 and (scaled[:, 1] == 0).all()
    pair = np.array([[0.0, 0], [0, 1], [9, 9], [9, 8]])
    d = np.linalg.norm(pair[:, None] - pair, axis=-1)
    assert K.mean_silhouette(d, np.array([0, 0, 1, 1]), 2) > 0.9 and K.mean_silhouette(d, np.array([0, 0, 0, 0]), 1) == -1.0
    xy, share = K.pca_view(x)
    assert xy.shape == (150, 2) and share[0] > 0.9


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
@settings(max_examples=80, deadline=None)
def test_assignment_is_the_best(rows, columns, seed):
    w = np.random.default_rng(seed).integers(0, 10, (rows, columns)).astype(float)
    pairs = assign(w)
    assert len(pairs) == min(rows, columns) and len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
    if rows <= columns:
        best = max(sum(w[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(columns), rows))
    else:
        best = max(sum(w[r, j] for j, r in enumerate(p)) for p in itertools.permutations(range(rows), columns))
    assert sum(w[r, c] for r, c in pairs) == pytest.approx(best)


def test_bus_mapping(spark, tmp_path):
    assert assign(np.array([[0.9, 0.8], [1.0, 0.1]])) == [(0, 1), (1, 0)]
    (tmp_path / "ecu.csv").write_text("ecu,bus_name\nENGINE,Powertrain\nTRANS,Powertrain\nGW,Powertrain\nGW,Body\nBCM,Body\nDOOR,Body\nABS,Chassis\nEPS,Chassis\nGW,Chassis\n")
    (tmp_path / "msg.csv").write_text("message_id,sender_ecu\n0x100,ENGINE\n0x101,ENGINE\n0x110,TRANS\n0x200,BCM\n0x201,DOOR\n0x300,ABS\n0x301,EPS\n")
    (tmp_path / "svc.csv").write_text("service_id,sender_ecu\n0x1234,GW\n0x1235,BCM\n0x2001,ABS\n")
    native = busmap.native_sets(spark, str(tmp_path / "ecu.csv"), str(tmp_path / "msg.csv"), str(tmp_path / "svc.csv"))
    assert {r["signal_source"]: r["count"] for r in native.groupBy("signal_source").count().collect()} == {"CAN": 7, "SOMEIP": 5}
    seen = [(1, 0x100), (1, 0x101), (1, 0x110), (2, 0x200), (2, 0x201), (2, 0x100), (3, 0x300), (3, 0x301), (4, 0x999)]
    can = spark.createDataFrame([("f", c, i) for c, i in seen], "_source_file string, channel int, can_id long")
    scored = busmap.scores(busmap.observed(can), native)
    got = {r["channel"]: (r["matched_bus"], round(r["score"], 4), r["recall"], round(r["precision"], 3), r["note"]) for r in busmap.assign_buses(scored).collect()}
    assert got == {1: ("Powertrain", 1.0, 1.0, 1.0, ""), 2: ("Body", 0.9091, 1.0, 0.667, ""), 3: ("Chassis", 1.0, 1.0, 1.0, ""), 4: (None, 0.0, 0.0, 0.0, busmap.NONE)}
    assert busmap.native_sets(spark).count() == 0 and busmap.scores(busmap.observed(can), busmap.native_sets(spark)).count() == 0


def drive(spark, files=2, seconds=60, jump=25):
    rows = []
    for f in range(files):
        for t in range(seconds):
            speed = 10.0 + (40.0 if t >= jump else 0.0) + (t % 3) * 0.01
            for name, v, s in (("VehicleSpeed_kmh", speed, None), ("BrakePressure_bar", 50.0 if t == jump else 0.0, None), ("ignition_status", 1.0 if t < 40 else 2.0, "On" if t < 40 else "Off")):
                rows.append((f"f{f}.blf", "CAN", 1, name, t * 10**9, float(t), None, v, s))
            rows.append((f"f{f}.blf", "ETH", 1, "ip.ttl", t * 10**9, float(t), None, 64.0, None))
    return spark.createDataFrame(rows, GOLD)


def test_scene_tables(spark):
    gold = drive(spark).cache()
    rules = spark.createDataFrame([("brake", "0", "braked hard", "10", "CAN", "", "BrakePressure_bar", "max_v", "gt", "40", "", "false")], "rule_id string, condition_index string, label string, priority string, signal_source string, channel string, signal_name string, feature string, op string, value_a string, value_b string, negate string")
    t = scenes.run(gold, scenes.Params(k=2), rules, keep=lambda df: df.cache())
    parts = t["boundaries"].where("_source_file = 'f0.blf'").orderBy("segment_index").collect()
    starts = [r["seg_start_s"] for r in parts]
    assert starts[0] == 0.0 and 25.0 in starts and 40.0 in starts and parts[-1]["seg_end_s"] == 59.0 and parts[-1]["is_last"]
    assert reports.tiling(t["boundaries"]).first().asDict() == {"gaps": 0, "overlaps": 0}
    f = t["signal_features"]
    assert f.agg(F.sum("n_samples")).first()[0] == gold.where("signal_source = 'CAN'").count()  # every sample in one scene
    s = t["scenes"].cache()
    assert s.count() == t["boundaries"].count() and len(s.columns) == 31
    hit = s.where("seg_start_s <= 25 and seg_end_s > 25").collect()
    assert {r["primary_action_label"] for r in hit} == {"braked hard"} and s.where("primary_action_label = 'idle'").count() > 5
    assert s.where("anomaly_score < 0 or anomaly_score > 100").count() == 0 and s.where("size(top_features) = 0").count() == 0
    assert t["clusters"].agg(F.sum("n_scenes")).first()[0] == s.count()
    one = s.orderBy(F.desc("anomaly_score"), "scene_id").first()
    assert reports.top_scenes(s, 1).first()["scene_id"] == one["scene_id"]
    assert reports.overview(s).first()["n_files"] == 2 and reports.label_counts(s).first()["label"] == "braked hard"
    assert reports.drill_down(t["feature_z"], one["scene_id"]).count() > 0
    signals = [(r["signal_source"], r["signal_name"]) for r in reports.driving_signals(t["feature_z"], one["scene_id"]).collect()]
    assert signals and reports.scene_samples(gold, one.asDict(), signals).count() > 0 and reports.scene_signals(f, one["scene_id"]).count() == 3
    assert reports.recurring_features(s).count() > 0 and reports.timeline(s).count() == s.count() and reports.scored_vectors(t["vectors"], s).count() == s.count()


def test_scene_edges(spark):
    gold = drive(spark, 1, 30)
    p = scenes.Params(k=2, baseline="file", summary_min_score=0.0, summary_max_rows=3)
    stats = scenes.signal_stats(gold, p)
    b = scenes.boundaries(gold, stats, p)
    f = scenes.signal_features(gold, b, p).cache()
    assert scenes.load_rules(spark, None) == ([], [])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scenes.load_rules(spark, "/nowhere.csv")
    labelled = scenes.labels(f, b, ([], []), p)
    assert {r["primary_action_label"] for r in labelled.collect()} == {"idle"}
    assert scenes.feature_z(f, p).where("abs_z > 10").count() == 0
    z, v = scenes.feature_z(f, p), scenes.vectors(f, scenes.feature_index(f, p)).cache()
    s = scenes.scenes(f, z, scenes.cluster_assignments(v, p), labelled, p, summarise=lambda text: f"{len(text)} characters")
    assert s.where("scene_summary like '%characters'").count() == 3
    assert scenes.clusters(s, name=str.upper).where("cluster_name is not null").count() >= 1
    whole, spread = (sorted(scenes.cluster_assignments(v, scenes.Params(k=2, task_rows=n)).collect()) for n in (100_000, 2))
    assert [(x["scene_id"], x["cluster_id"]) for x in whole] == [(x["scene_id"], x["cluster_id"]) for x in spread] and len(whole) == v.count()
    assert np.allclose([x["centroid_distance"] for x in whole], [x["centroid_distance"] for x in spread])
    empty = gold.where("false")
    t = scenes.run(empty, p)
    assert t["scenes"].count() == 0 and t["feature_index"].first()["n_features"] == 0


def varied(spark, n):
    """Two signals of ``n`` samples each, all of different values, and one without any value."""
    rows = spark.range(3 * n).repartition(6).selectExpr("'a.blf' as _source_file", "'CAN' as signal_source", "1 as channel", "elt(id % 3 + 1, 'x', 'y', 'z') as signal_name", "id * 1000000 as timestamp_ns", "id / 1e3 as timestamp_s", "timestamp_millis(id) as event_time", "pmod(xxhash64(id), 1000003) * 1D + id / 1e7 as signal_value", "cast(null as string) as signal_str")
    rows = rows.withColumn("signal_value", F.when(F.col("signal_name") == "z", F.lit(None)).otherwise(F.col("signal_value")))
    return rows.withColumn("signal_value", F.when(F.col("timestamp_ns") % 11_000_000 != 0, F.col("signal_value"))).cache()


def test_quartiles_are_exact(spark):
    gold = varied(spark, 40_000)
    stats = {r["signal_name"]: r for r in scenes.signal_stats(gold).collect()}
    assert set(stats) == {"x", "y", "z"} and stats["z"]["median_value"] is None and stats["z"]["robust_sigma"] == 1e-9
    for name in "xy":
        v = np.sort([r[0] for r in gold.where(f"signal_name = '{name}' and signal_value is not null").select("signal_value").collect()])
        low, middle, high = (v[math.ceil(len(v) * q) - 1] for q in (0.25, 0.5, 0.75))
        r = stats[name]
        assert (r["median_value"], r["robust_sigma"], r["n_samples"]) == (middle, (high - low) / 1.349, 40_000)
        assert (r["t_min_s"], r["t_max_s"]) == ((0.0, 119.997) if name == "x" else (0.001, 119.998))


def test_changepoints_are_exact(spark):
    gold = varied(spark, 40_000)
    p = scenes.Params(changepoint_signals=("x",), changepoint_k=0.5, quantum_s=7.0)
    got = {r["boundary_s"]: r["strength"] for r in scenes.changepoints(gold, scenes.signal_stats(gold, p), p).collect()}
    rows = sorted((r[0], r[1]) for r in gold.where("signal_name = 'x'").select("timestamp_s", "signal_value").collect())
    v = np.sort([x for _, x in rows if x is not None])
    sigma = (v[math.ceil(len(v) * 0.75) - 1] - v[math.ceil(len(v) * 0.25) - 1]) / 1.349
    want = {}
    for (_, before), (t, x) in zip(rows, rows[1:]):
        if x is not None and before is not None and abs(x - before) / sigma > 0.5:
            at = math.floor(t / 7.0 + 0.5) * 7.0
            want[at] = max(want.get(at, 0.0), abs(x - before) / sigma)
    assert got == want and len(want) == 18


def test_missing_values_follow_at_equal_times(spark):
    rows = [("a.blf", "CAN", 1, "x", t, t / 1e9, None, v, None) for t, v in ((1, 0.0), (2, None), (2, 50.0), (3, 50.0), (4, 1.0), (5, 0.0))]
    gold = spark.createDataFrame(rows, GOLD)
    p = scenes.Params(changepoint_signals=("x",), quantum_s=1e-9)
    stats = scenes.signal_stats(gold, p).withColumn("robust_sigma", F.lit(10.0))
    assert [(round(r["boundary_s"] * 1e9), r["strength"]) for r in scenes.changepoints(gold, stats, p).orderBy("boundary_s").collect()] == [(2, 5.0), (4, 4.9)]


def test_viewer(spark):
    gold = drive(spark).cache()
    key = viewer.parse_key("CAN1::VehicleSpeed_kmh")
    assert key == ("CAN", 1, "VehicleSpeed_kmh") and viewer.parse_key("ETH::a::b") == ("ETH", 0, "a::b")
    with pytest.raises(ValueError):
        viewer.parse_key("nonsense")
    got = viewer.fetch_signals(gold, [key], 5, ["f0.blf"], (0.0, 100.0))
    assert got.rows.count() == 10 and not got.widened and got.bounds.first()["t_max"] == 59.0
    late = gold.where("signal_name <> 'VehicleSpeed_kmh' or timestamp_s > 50")
    assert viewer.fetch_signals(late, [key, ("CAN", 1, "BrakePressure_bar")], 5, None, (0.0, 10.0)).widened
    assert not viewer.fetch_signals(late, [key, ("CAN", 7, "none")], 5, None, (51.0, 55.0)).widened
    scoped = viewer.fetch_signals(gold, [key], 500, ["f0.blf"], extra_scope={key: ["f1.blf"]}).rows
    assert scoped.count() == 120
    nothing = viewer.fetch_signals(gold, [("CAN", 9, "x")], 5).bounds.first()
    assert nothing["t_min"] is None
    videos = spark.createDataFrame([("v/f0.mp4", "f0", None)], "_video_path string, _video_stem string, _video_mtime timestamp")
    rows = {r["source_file"]: (r["_video_path"], r["t_min"]) for r in viewer.playlist(gold.withColumn("_source_file", F.concat(F.lit("/x/"), "_source_file")), videos, ["/x/f0.blf", "/x/f1.blf"], [("CAN", 9, "x")]).collect()}
    assert rows == {"/x/f0.blf": ("v/f0.mp4", 0.0), "/x/f1.blf": (None, 0.0)}
    marks = spark.createDataFrame([(12.5,)], "timestamp_s double")
    assert str(viewer.marker_times(marks, "2024-01-01 00:00:00", 2.5).first()["x"]) == "2024-01-01 00:00:10" and viewer.marker_times(marks, None, 0.0).first()["x"] is None
    assert viewer.folders(gold.select(F.concat(F.lit("/a/"), "_source_file").alias("_source_file")).distinct()).first()["files"] == ["/a/f0.blf", "/a/f1.blf"]
    cache = viewer.ResultCache(2)
    for k in "abc":
        cache.put(k, k)
    assert cache.get("a") is None and cache.get("c") == "c"


def test_pivot_grid_is_whole(spark):
    at = "if(id = 7, null, id * 1000)"
    rows = spark.range(60_001).selectExpr("'a.blf' as _source_file", "'CAN' as signal_source", "cast(id % 3 as int) as channel", "'x' as signal_name", f"{at} as timestamp_ns", f"{at} / 1e9 as timestamp_s", "timestamp_millis(id) as event_time", "cast(id as double) as signal_value", "cast(null as string) as signal_str")
    rows = rows.unionByName(rows.where("channel = 1").withColumn("timestamp_ns", F.col("timestamp_ns") + 1)).unionByName(rows.where("channel = 1"))
    grid = viewer.pivot_grid(rows, [("CAN", 1, "x"), ("CAN", 2, "x")])
    assert grid.schema["position"].dataType.simpleString() == "int"
    got = grid.collect()
    assert [r["position"] for r in got] == list(range(1, 60_001))
    assert got[0]["CAN1::x"] == "1.0" and got[0]["CAN2::x"] == "2.0" and got[59_000]["CAN2::x"] is None
    assert got[-1]["time"] is None and got[-1]["CAN1::x"] == "7.0"  # samples without a time come last


def test_asof_equals_brute_force(spark):
    r = np.random.default_rng(1)
    left = [(f"f{i % 3}", int(t), float(i)) for i, t in enumerate(r.integers(0, 500, 120))]
    right = [(f"f{i % 2}", int(t), float(i)) for i, t in enumerate(r.permutation(500)[:60] * 2)]
    got = viewer.asof_nearest(spark.createDataFrame(left, "f string, t long, v double"), spark.createDataFrame(right, "f string, t long, w double"), "t", "w", ["f"]).collect()
    assert len(got) == len(left)
    for g in got:
        near = sorted((abs(t - g["t"]), t, w) for f, t, w in right if f == g["f"])
        assert (g["right_t"], g["right_w"]) == ((near[0][1], near[0][2]) if near else (None, None))
    track = viewer.gps_track(spark.createDataFrame([("f", "CAN", 0, "lat", 10, 0.0, None, 95.0, None), ("f", "CAN", 0, "lon", 12, 0.0, None, 190.0, None)], GOLD), ("CAN", 0, "lat"), ("CAN", 0, "lon")).first()
    assert (track["lat"], track["lon"]) == (85.0, -170.0)


def test_time_phrases():
    assert wtime.parse_time_range("show the last 30 sec", 0, 100) == (70, 100) and wtime.parse_time_range("last 2 min", 0, 100) == (0, 100)
    assert wtime.parse_time_range("from 50s to 80s", 0, 100) == (50, 80) and wtime.parse_time_range("hello", 0, 100) is None
    assert wtime.parse_time_range("10:00 to 10:01:30", 0, 100, 36000.0) == (0, 90)
    assert [m[0] for m in wtime.axis_marks(0, 50, 5)] == [0, 10, 20, 30, 40, 50]


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


W, A = 'xmlns:w="urn:w"', 'xmlns:a="urn:a" xmlns:p="urn:p"'
DOCX = office({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Speed </w:t><w:t>signal</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>in km/h</w:t></w:r></w:p></w:body></w:document>"})
PPTX = office({f"ppt/slides/slide{i}.xml": f"<p:sld {A}><p:txBody><a:p><a:r><a:t>Slide text {i}</a:t></a:r></a:p></p:txBody></p:sld>" for i in (2, 1, 10)})
XLSX = office(
    {
        "xl/workbook.xml": '<workbook xmlns:r="urn:r"><sheets><sheet name="CAN" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r></si></sst>",
        "xl/worksheets/s.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="A3"><v>256</v></c><c r="C3" t="inlineStr"><is><t>Speed</t></is></c></row></sheetData></worksheet>',
    }
)
PDF = b"%PDF-1.4\n1 0 obj <</Length 44>> stream\nBT /F1 12 Tf (Hello \\(x\\)) Tj T* [(Wor) 3 (ld)] TJ ET\nendstream endobj"


def test_documents(spark, tmp_path):
    assert documents.docx_sections(DOCX) == [(1, "Document", "Speed signal\nin km/h")]
    assert documents.pptx_sections(PPTX) == [(1, "Slide 1", "Slide text 1"), (2, "Slide 2", "Slide text 2"), (3, "Slide 3", "Slide text 10")]
    assert documents.xlsx_sections(XLSX) == [(1, "Sheet 'CAN'", "id\tname\n256\tSpeed")]
    assert documents.pdf_sections(PDF)[0][2].split("\n") == ["Hello (x)", "World"]
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, raw in (("a.docx", DOCX), ("deep/b.PPTX", PPTX), ("c.xlsx", XLSX), ("bad.docx", b"no zip"), ("notes.txt", b"x")):
        (tmp_path / "in" / name).write_bytes(raw)
    rows = documents.with_section_id(documents.sections(documents.scan(spark, str(tmp_path / "in")))).cache()
    assert rows.count() == 5 and rows.select("section_id").distinct().count() == 5
    target = str(tmp_path / "out")
    assert documents.merge_sections(rows, target) == 5 and documents.merge_sections(rows, target) == 0
    rows.unpersist()
    (tmp_path / "in" / "d.docx").write_bytes(DOCX)
    again = documents.with_section_id(documents.sections(documents.scan(spark, str(tmp_path / "in"))))
    assert documents.merge_sections(again, target) == 1


def test_parameters_from_the_session(spark):
    spark.conf.set("wirelake.scene.window_s", "5.0")
    spark.conf.set("wirelake.scene.sources", "CAN, ETH")
    spark.conf.set("wirelake.scene.weights", "1,1,2")
    spark.conf.set("wirelake.scene.k", "3")
    try:
        p = scenes.params_from_conf(spark)
        assert (p.window_s, p.sources, p.weights, p.k, p.seed) == (5.0, ("CAN", "ETH"), (0.25, 0.25, 0.5), 3, 42)
    finally:
        for f in ("window_s", "sources", "weights", "k"):
            spark.conf.unset(f"wirelake.scene.{f}")


def test_layouts_and_bound_parameters(spark, tmp_path):
    from wirelake.plans import tables

    gold = drive(spark)
    tables.write_table("gold_signals", gold, str(tmp_path / "g"))
    tables.write_table("unknown", gold, str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == spark.read.parquet(str(tmp_path / "u")).count() == gold.count()
    assert {p.name for p in (tmp_path / "g").iterdir() if p.is_dir()} == {"signal_source=CAN", "signal_source=ETH"}
    assert viewer.sql(spark, "select ? + ? as x", [1, 2]).first()["x"] == 3
