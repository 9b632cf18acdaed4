"""Known values, plans and contracts of the frame operators."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell import sinks
from framewell.errors import ERRORS, FramewellError, fail
from framewell.functions import color
from framewell.operators import aggregate, change, flow, frequency, lookup, preview, sampling, selection
from framewell.plans import bundle, engine
from framewell.plans.request import Feature, Geometry, Reduction, Request, Resources, Selection, Source, load, strictest
from framewell.sources import arrays, images
from framewell.sources.clips import CLIPS
from framewell.tools import Toolbox


def px(spark, name):
    return CLIPS[name].pixels(spark)


def scored(spark, values):
    return spark.createDataFrame([("m", i + 1, i, float(i + 1), v * 255, v) for i, v in enumerate(values)], "media_id string, frame int, previous_frame int, t double, score double, normalized double")


def spans(df):
    return [(r["start_frame"], r["end_frame"]) for r in df.orderBy("event").collect()]


def test_region_golden(spark):
    r = aggregate.region_stats(px(spark, "image16"), (0, 0, 2, 2)).first()
    assert (r["pixel_count"], r["mean_r"], r["median_r"], r["min_r"], r["max_r"], r["std_r"]) == (4, 8, 8, 0, 16, 8)
    r = aggregate.region_stats(px(spark, "basic").where("frame = 15"), (4, 4, 10, 10)).first()
    assert r["mean_g"] == 255 and r["std_g"] == 0 and r["mean_luminance"] == pytest.approx(255)


def test_change_golden(spark):
    top = change.top_changes(change.change_scores(px(spark, "basic"), point=(24, 16)), 2).collect()
    assert [(r["frame"], r["score"], r["normalized"]) for r in top] == [(15, 510, 510 / 765), (16, 510, 510 / 765)]
    by = {r["frame"]: r["score"] for r in change.change_scores(px(spark, "basic"), point=(2, 28)).collect()}
    assert (by[5], by[15], len(by)) == (14, 569, 29)
    (e,) = change.events(change.change_scores(px(spark, "basic"))).collect()
    assert (e["start_frame"], e["end_frame"], e["record_count"], e["peak_frame"]) == (14, 16, 2, 15)


def test_events(spark):
    s = scored(spark, [0.01, 0.9, 0.01, 0.8, 0.85, 0.01])
    assert spans(change.events(s, 0.5)) == [(1, 2), (3, 5)]
    assert spans(change.events(s, 0.5, min_records=2)) == [(3, 5)]
    assert spans(change.events(s, 0.5, min_gap=2)) == [(1, 5)]
    for values in ([], [0.2] * 5, [0.9]):
        assert change.events(scored(spark, values)).count() == 0
    assert change.threshold(scored(spark, [0.9])).first()["threshold"] == 0.9


def test_compare_golden(spark):
    r = lookup.compare(px(spark, "basic"), 0, 5, 10).first()
    assert (r["changed"], r["box_x"], r["box_y"], r["box_w"], r["box_h"], r["max_diff"]) == (3, 0, 8, 6, 21, 255)
    assert lookup.compare(px(spark, "basic"), 3, 3).first()["box_x"] is None


def test_reduce_golden(spark):
    at = lambda n: aggregate.over_time(px(spark, "basic"), n, (24, 16, 1, 1)).first()
    assert (at("mean")["g"], at("mean")["r"]) == (255, 8.5)
    assert [at("min")[c] for c in "rgb"] == [0, 255, 0] and [at("max")[c] for c in "rgb"] == [255] * 3 and [at("median")[c] for c in "rgb"] == [0, 255, 0]


def test_percentile_is_numpys(spark):
    rows = [("m", int(v)) for v in np.random.default_rng(1).integers(0, 256, 501)]
    d = spark.createDataFrame(rows, "media_id string, v int")
    for p in (0, 3, 25, 50, 99.5, 100):
        assert aggregate.percentiles(d, ["media_id"], ["v"], p).first()["v"] == pytest.approx(np.percentile([v for _, v in rows], p))


def test_picks():
    assert selection.picks(0, 8, 3) == [0, 4, 8] and selection.picks(0, 2, 9) == [0, 1, 2] and selection.picks(10, 20, 3) == [10, 15, 20]
    assert selection.auto_stride(1800) == 1 and selection.auto_stride(1801) == 2 and selection.closed_count(0, 9, 4) == 3


def test_spectrum_golden(spark):
    r = frequency.temporal_peaks(frequency.series(px(spark, "blink"), rect=(12, 12, 8, 8)), 30.0).where("rank = 1").first()
    assert r["frequency"] == pytest.approx(5) and r["period_frames"] == pytest.approx(6) and r["peak_ratio"] > 0.1
    with pytest.raises(Exception, match="irregular"):
        frequency.temporal_fft(frequency.series(px(spark, "vfr"))).collect()
    assert frequency.temporal_fft(frequency.series(px(spark, "vfr")), True).first()["irregular"]
    z = frequency.stft(frequency.series(px(spark, "basic")), "hann", 8, 4)
    assert z.agg(F.max("window"), F.max("k")).first() == (5, 4)
    p = frequency.spatial_peaks(frequency.spatial_fft(px(spark, "stripes8"))).first()
    assert p["period_px"] == pytest.approx(8) and p["angle_deg"] == 0
    n = frequency.spatial_peaks(frequency.spatial_fft(px(spark, "nyquist"))).collect()
    assert n[0]["period_px"] == pytest.approx(2) and len(n) == 1


@pytest.mark.parametrize("padding", ["none", "end", "center"])
@pytest.mark.parametrize("normalization", ["none", "window_sum", "window_energy"])
def test_windows_match_a_plain_loop(padding, normalization):
    v, t = np.random.default_rng(2).normal(size=23), np.arange(23) / 10
    at, f, z = frequency.windowed(v, t, "hamming", 8, 3, padding, normalization)
    w = np.hamming(8)
    lead = 4 if padding == "center" else 0
    long = np.concatenate([np.zeros(lead), v, np.zeros(20)])
    scale = {"none": 1, "window_sum": w.sum(), "window_energy": np.sqrt((w**2).sum())}[normalization]
    for k in range(len(at)):
        assert np.allclose(z[k], np.fft.rfft(long[3 * k : 3 * k + 8] * w) / scale)
        assert at[k] == pytest.approx((3 * k - lead + 3.5) / 10)


def test_pattern():
    y, x = np.mgrid[0:64, 0:64]
    tiles = 127 + 100 * ((x // 2 + y // 2) % 2)
    assert frequency.assess_pattern(tiles)["status"] == "candidate"
    assert frequency.assess_pattern(np.random.default_rng(1).integers(0, 255, (64, 64)))["status"] == "not_detected"
    assert frequency.assess_pattern(np.zeros((64, 64)))["status"] == "not_detected" and frequency.assess_pattern(np.zeros((20, 64)))["status"] == "insufficient_data"


def test_as_of_golden(spark):
    ft = px(spark, "vfr").groupBy("media_id", "frame").agg(F.min("t").alias("t"))
    t = {r["frame"]: r["t"] for r in ft.collect()}
    probes = spark.createDataFrame([("vfr", 0, (t[2] + t[3]) / 2), ("vfr", 1, t[4]), ("vfr", 2, -1.0), ("vfr", 3, 99.0)], "media_id string, probe_id long, at double")
    assert {r["probe_id"]: r["frame"] for r in lookup.as_of(ft, probes).collect()} == {0: 2, 1: 4, 2: 0, 3: 19}
    r = lookup.frame_range(ft, (t[2] + t[3]) / 2, (t[6] + t[7]) / 2).first()
    assert (r["first"], r["last"], r["total"]) == (2, 6, 20)


def test_colour_golden(spark):
    rows = [(255, 255, 255), (0, 0, 0), (255, 0, 0), (0, 255, 0), (12, 200, 99)]
    c = [F.col(k) for k in "rgb"]
    d = spark.createDataFrame(rows, "r int, g int, b int").select("*", color.lab(*c).alias("lab"), color.hsv(*c, 1.0).alias("hsv"))
    d = d.select("r", "g", "b", "lab", color.from_lab(*[F.col(f"lab.{k}") for k in "lab"]).alias("a"), color.from_hsv(*[F.col(f"hsv.{k}") for k in "hsv"]).alias("h"))
    want = [(100, 0, 0), (0, 0, 0), (53.24, 80.09, 67.20), (87.74, -86.18, 83.18)]
    for row, (r, g, b) in zip(d.collect(), rows, strict=True):
        assert tuple(row["a"]) == tuple(row["h"]) == (r, g, b)
        if want:
            assert tuple(row["lab"]) == pytest.approx(want.pop(0), abs=0.02)


def test_timing_flags(spark):
    rows = [("m", i, p, None) for i, p in enumerate([5000, 5020, None, 5020, 5010, 4990, 5100])]
    t = change.timing(spark.createDataFrame(rows, "media_id string, frame int, pts long, duration_pts long"), 1, 1000, 50.0).orderBy("frame").collect()
    assert [r["t"] for r in t] == [0, 0.02, 0.04, 0.02, 0.01, 0, 0.1]
    assert [r["flags"] for r in t] == [[], [], ["PTS_MISSING", "TIMELINE_ESTIMATED_FROM_FPS"], ["PTS_DUPLICATE"], ["PTS_NON_MONOTONIC"], ["PTS_NON_MONOTONIC", "TIMELINE_NEGATIVE_NORMALIZED"], []]
    assert change.frame_count(None, None, 2.0, 25.0) == (50, True) and change.coarse_vfr(30.1, 30) and not change.coarse_vfr(30, 30)


def test_sampling(spark):
    assert sampling.resample_polyline([(0, 0), (3, 4)], 3) == [(0, 0), (1.5, 2), (3, 4)]
    line = sampling.path_t(px(spark, "basic"), [(0, 8), (31, 8)], 32, 32, 32).select("frame", F.col("k").alias("x"), *[F.col(c).cast("int") for c in "rgb"])
    assert not line.exceptAll(sampling.xt(px(spark, "basic"), 8).select("frame", "x", "r", "g", "b")).count()
    with pytest.raises(FramewellError) as e:
        sampling.points_t(px(spark, "basic"), sampling.point_table(spark, [(40, 1)]), 32, 32)
    assert e.value.code == "COORDINATE_OUT_OF_RANGE" and e.value.exit_code == 5
    assert sampling.points_t(px(spark, "image16"), sampling.point_table(spark, [(40, 1)]), 16, 16, boundary="clip").first()["r"] == 240
    for bad in ("1,2,3", "x"):
        with pytest.raises(FramewellError):
            sampling.parse_numbers(bad, 4)


def test_plans_are_pruned(spark, tmp_path):
    path = str(tmp_path / "px")
    px(spark, "noise").write.parquet(path)
    d = sampling.xt(spark.read.parquet(path), 8).select("x", "r")
    text = d._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(y,8)" in text and "ReadSchema: struct<y:int,x:int,r:int>" in text
    top = change.top_changes(change.change_scores(spark.read.parquet(path)), 3)
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().toString()


def test_preview(spark):
    d = px(spark, "noise").where("frame = 0").select("media_id", "y", "x", F.col("r").alias("v"))
    a = np.zeros((64, 64))
    for r in d.collect():
        a[r["y"], r["x"]] = r["v"]
    for n in (2, 3, 5):
        lo = n // 2
        p = np.pad(a, ((lo, n - 1 - lo),) * 2, mode="edge")
        want = np.lib.stride_tricks.sliding_window_view(p, (n, n)).mean(axis=(2, 3))
        for r in preview.box_smooth(d, 64, 64, n).collect():
            assert r["v"] == pytest.approx(want[r["y"], r["x"]])
    assert preview.sheet_layout(5, 10, 8)[:2] == (34, 46)
    flat = spark.createDataFrame([("m", 7)] * 3, "media_id string, v int")
    assert {r["v"] for r in preview.stretch(flat, ["media_id"], ["v"]).collect()} == {128}


def test_queries_of_whole_clips(spark):
    """Smoothing covers every vector and HSV every frame, as plain loops do."""
    import colorsys

    from framewell.queries import QUERIES
    from framewell.sources.clips import embedding_clips

    sf = "/root/testdata/sf0.001"
    grids = {}
    for r in embedding_clips(spark, sf).collect():
        grids.setdefault((r["media_id"], r["frame"]), np.zeros((8, 8)))[r["y"], r["x"]] = r["r"]
    assert len(grids) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    wide = {k: np.pad(g, 1, mode="edge") for k, g in grids.items()}
    out = QUERIES["em_box_smooth_frames"](spark, sf).collect()
    assert len(out) == 64 * len(grids)
    assert all(r["v"] == pytest.approx(wide[r["media_id"], r["frame"]][r["y"] : r["y"] + 3, r["x"] : r["x"] + 3].mean()) for r in out)
    got = {(r["frame"], r["y"], r["x"]): (r["h_e6"] / 1e6, r["s_e6"] / 1e6, r["v_e6"] / 1e6) for r in QUERIES["fx_hsv_clip"](spark, sf).collect()}
    assert len(got) == 40 * 64 * 64
    for r in px(spark, "noise").where("x = y").collect():
        h, s, v = colorsys.rgb_to_hsv(r["r"] / 255, r["g"] / 255, r["b"] / 255)
        assert got[r["frame"], r["y"], r["x"]] == pytest.approx((h * 360, s * 100, v * 100), abs=1e-5)


def test_flow(spark):
    try:
        import cv2  # noqa: F401
    except ImportError:
        with pytest.raises(FramewellError) as e:
            flow.library()
        assert e.value.code == "DEPENDENCY_MISSING"
    rows = [("m", 0, y, x, 0.1 * x - 0.2 * y + 1.5, 0.2 * x + 0.1 * y - 2.0) for y in range(6) for x in range(8)]
    f = spark.createDataFrame(rows, "media_id string, frame int, y int, x int, dx double, dy double")
    g = flow.global_motion(f).first()
    assert (g["dx"], g["dy"], g["a"], g["b"]) == pytest.approx((1.5, -2.0, 1.1, 0.2))
    r = flow.flow_summary(flow.compensate(f, flow.global_motion(f)), 1e-6).first()
    assert r["max_magnitude"] < 1e-9 and r["direction"] is None


def test_png_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    shots = {"g": rng.integers(0, 255, (5, 7), np.uint8), "c": rng.integers(0, 255, (6, 9, 3), np.uint8), "a": rng.integers(0, 255, (4, 4, 4), np.uint8)}
    for n, a in shots.items():
        sinks.write_file(str(tmp_path / f"{n}.png"), sinks.png(a))
        assert (images.read_png(sinks.png(a))["samples"] == a).all()
    m = {r["media_id"]: r for r in images.media(spark, str(tmp_path)).collect()}
    assert {r["actual_format"] for r in m.values()} == {"png"} and {r["media_type"] for r in m.values()} == {"image"}
    f = images.frames(spark, str(tmp_path / "c.png"))
    got = np.zeros((6, 9, 3), np.uint8)
    for r in images.pixels(f).collect():
        got[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    assert (got == shots["c"]).all() and (sinks.picture(images.pixels(f), 9, 6) == shots["c"]).all()
    assert images.pixels(f, (2, 1, 3, 2)).count() == 6
    assert bytes(f.select(images.row_bytes(2).alias("d")).first()["d"]) == shots["c"][2].tobytes()
    c = aggregate.content_counts(images.native_samples(spark, str(tmp_path / "a.png"))).first()
    assert c["pixels"] == 16 and c["transparent"] == int((shots["a"][..., 3] == 0).sum())
    with pytest.raises(FramewellError):
        images.read_png(sinks.png(shots["g"])[:40] + b"\0" * 40)


def test_arrays(spark, tmp_path):
    cells = px(spark, "motion").select("frame", "y", "x", "r", "g", "b")
    shape = (20, 64, 64)
    chunks = arrays.tensor_chunks(cells, ["frame", "y", "x"], ["r", "g", "b"], shape, 6, "<u1")
    path = str(tmp_path / "a.npy")
    arrays.write_npy(chunks, (*shape, 3), path, "<u1")
    a = np.load(path)
    assert a.shape == (20, 64, 64, 3) and a[3, 30, 11, 0] == 255 and a.sum() == 20 * 64 * 255 * 3
    back = b"".join(bytes(r["data"]) for r in arrays.read_npy(spark, path, 7).orderBy("chunk").collect())
    assert back == a.tobytes()
    with pytest.raises(FramewellError):
        arrays.write_npy(chunks, (*shape, 3), path, "<u1")


def test_csv(spark, tmp_path):
    points = sampling.point_table(spark, [(2, 28), (24, 16)]).select("k", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    s = sampling.timeline(px(spark, "basic"), sampling.point_table(spark, [(2, 28), (24, 16)]), 32, 32).join(points, "k")
    path = tmp_path / "t.csv"
    sinks.timeline_csv(s, 32, str(path))
    lines = path.read_bytes().decode("utf-8-sig").splitlines()
    assert path.read_bytes()[:3] == b"\xef\xbb\xbf" and lines[0] == "pixel_id,x,y,frame,time_seconds,time_ms,r,g,b" and len(lines) == 61
    assert json.loads(sinks.failure(fail("INVALID_RANGE", "no", "yes"))) == {"ok": False, "error": {"code": "INVALID_RANGE", "message": "no", "hint": "yes"}}
    assert sinks.curve([1, 2, 3], [1]).shape == (256, 768, 3) and len(ERRORS) > 30


def requests():
    s = Source("basic")
    return [
        Request(s, Selection("frame_interval", 0, 20), "xt", Geometry("line", ((0, 8), (31, 8)))),
        Request(s, Selection("frame_interval", 0, 20), "path_t", Geometry("line", ((0, 8), (31, 8))), Feature("rgb", {"sample_count": 32})),
        Request(s, representation="frames", reduction=Reduction("mean")),
        Request(s, representation="roi_t", geometry=Geometry("rect", rect=(0, 0, 4, 4)), reduction=Reduction("percentile", config={"percentile": 25})),
        Request(s, representation="feature_t", feature=Feature("temporal_fft")),
        Request(s, representation="frames", feature=Feature("frame_difference")),
        Request(s, Selection("frame_interval", 0, 20), "xt", Geometry("line", ((0, 8), (31, 8))), reduction=Reduction("max")),
    ]


def test_engine(spark, tmp_path):
    media = {"basic": (px(spark, "basic"), 32, 32)}
    p = engine.plan(requests(), media)
    # source, decode, two selections, xt, path_t, frames, roi_t, mean, percentile, max, spectrum, difference
    assert p.decode_nodes == 1 and len(p.graph.nodes) == 13
    assert p.plan_id == engine.plan(requests(), media).plan_id and "decode" in p.explain()
    out = engine.generate(requests(), media)
    assert [d.count() for d in out] == [640, 640, 1024, 30, 16, 29 * 1024, 32]
    r = engine.default_registry()
    r.register(engine.Spec("feature.negative", lambda d, c: d.withColumn("r", c["top"] - F.col("r")), {"top": 255}))
    q = Request(Source("basic"), representation="frames", feature=Feature("negative"))
    assert engine.generate([q], media, r)[0].agg(F.max("r")).first()[0] == 255
    for bad, code in ((Feature("nothing"), "OPERATOR_NOT_REGISTERED"), (Feature("hsv", {"a": 1}), "OPERATOR_CONFIG_INVALID"), (Feature("stft"), "OPERATOR_CONFIG_INVALID")):
        with pytest.raises(FramewellError) as e:
            engine.plan([Request(Source("basic"), feature=bad)], media)
        assert e.value.code == code
    cache = engine.Cache(str(tmp_path / "cache"))
    first = engine.generate(requests()[:1], media, cache=cache)[0].inputFiles()
    assert engine.generate(requests()[:1], media, cache=cache)[0].inputFiles() == first
    key = p.outputs[0]
    os.unlink(os.path.join(cache.path(key), "_SUCCESS"))
    assert engine.generate(requests()[:1], media, cache=cache)[0].count() == 640


def test_request_contract():
    for bad in (
        dict(representation="xt"), dict(representation="xt", geometry=Geometry("line", ((0, 1), (3, 2)))), dict(representation="frames", geometry=Geometry("rect", rect=(0, 0, 1, 1))), dict(representation="roi_t", geometry=Geometry("rect", rect=(0, 0, 1, 1))),
        dict(reduction=Reduction("mean", config={"percentile": 3})), dict(reduction=Reduction("percentile")), dict(reduction=Reduction("mean", ("x",))), dict(representation="nothing"),
    ):
        with pytest.raises(FramewellError):
            Request(Source("m"), **bad)
    for bad in (dict(mode="indices", indices=(2, 1)), dict(mode="frame_interval", start=3, end=3), dict(every=0)):
        with pytest.raises(FramewellError):
            Selection(**bad)
    with pytest.raises(FramewellError):
        load({"source": {"source_id": "m"}, "colour": 1})
    (r,) = load('{"source": {"source_id": "a"}, "representation": "xt", "geometry": {"type": "line", "points": [[0, 1], [5, 1]]}}', Source("m"))
    assert r.source.source_id == "m" and r.geometry.points == ((0, 1), (5, 1))
    assert strictest([Resources(100, None, 5, True), Resources(50, 7, None, False)]) == Resources(50, 7, 5, False)


def test_bundle(spark, tmp_path):
    media = {"basic": (px(spark, "basic"), 32, 32)}
    q = requests()[:2]
    root = bundle.write(str(tmp_path / "b"), q, engine.generate(q, media))
    assert bundle.validate(root, strict=True) == [] and bundle.read(spark, root, "artifact-0001").count() == 640
    with pytest.raises(FramewellError) as e:
        bundle.write(root, q, [])
    assert e.value.code == "BUNDLE_TARGET_EXISTS"
    with pytest.raises(FramewellError):
        bundle.safe_join(root, "../x")
    tools = Toolbox(spark, media, (str(tmp_path),))
    assert tools.list_artifacts(root, limit=1)["next_offset"] == 1 and len(tools.read_artifact(root, "artifact-0000", limit=3)) == 3
    a = bundle.manifest(root)["artifacts"][0]
    name = next(n for n in a["files"] if n.endswith(".parquet"))
    with open(os.path.join(root, a["uri"], name), "ab") as f:
        f.write(b"x")
    assert any("changed" in p for p in bundle.validate(root)) and bundle.validate(root, full=False) == []
    with pytest.raises(FramewellError) as e:
        bundle.read(spark, root, "artifact-0000")
    assert e.value.code == "ARTIFACT_CHECKSUM_MISMATCH"
    assert bundle.redact({"a": ["see /home/me/x.png", '{"p":"/a/b/c"}']}) == {"a": ["see x.png", '{"p":"c"}']}


def test_tools(spark):
    t = Toolbox(spark, {n: (px(spark, n), CLIPS[n].width, CLIPS[n].height) for n in ("basic", "motion", "vfr")})
    i = t.inspect_media("basic")
    assert (i["frames"], i["width"], i["irregular"], i["anomalies"]["items"][0]["kind"]) == (30, 32, False, "white")
    assert not any(a["kind"] == "black" for a in t.inspect_media("motion")["anomalies"]["items"])
    assert t.inspect_media("vfr")["irregular"]
    assert t.read_pixels("vfr", [(3, 4)], 7)[0]["hex"] == "#5464AB"
    assert t.get_frame("vfr", time=0.215).select("frame").distinct().collect()[0][0] == 4
    assert t.get_frame("basic", 3, crop=(0, 0, 2, 2)).count() == 4
    f = t.find_changes("basic", sort="score", limit=1)
    assert (f["items"][0]["frame"], f["total"], f["next_offset"], len(f["events"])) == (15, 29, 1, 1)
    assert t.analyze_region("basic", (4, 4, 10, 10), 15)["mean_r"] == 255
    assert "feature.stft" in t.get_capabilities()["operators"]
    assert t.generate_representation({"source": {"source_id": "basic"}, "reduction": {"name": "max"}})[0].count() == 1024
    with pytest.raises(FramewellError):
        t.find_changes("basic", limit=999)


def test_streaming_equals_batch(spark, tmp_path):
    from framewell.streaming.changes import change_stream

    clip = px(spark, "motion")
    packed = clip.groupBy("media_id", "frame").agg(F.min("t").alias("t"), F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("p"))
    hexed = F.array_join(F.transform("p", lambda q: F.concat(*[F.lpad(F.hex(q[c]), 2, "0") for c in "rgb"])), "")
    frames = packed.select("media_id", "frame", "t", F.unhex(hexed).alias("data"))
    for k, (a, z) in enumerate([(0, 7), (7, 12), (5, 6), (12, 20)]):
        frames.where((F.col("frame") >= a) & (F.col("frame") < z)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema("media_id string, frame int, t double, data binary").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    q = change_stream(stream).writeStream.format("memory").queryName("scores").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("scores").collect()
    assert [r["frame"] for r in got if r["flags"]] == [5]
    want = {r["frame"]: (r["previous_frame"], r["score"]) for r in change.change_scores(clip).collect()}
    assert {r["frame"]: (r["previous_frame"], pytest.approx(r["score"])) for r in got if not r["flags"]} == want


def test_reductions_of_fractions_and_probes_before_the_first_frame(spark):
    from framewell.operators import aggregate, lookup

    px = spark.createDataFrame([("m", 0, 0, k, 0.5 + k, 1.25, 0.0) for k in range(4)], "media_id string, frame int, y int, x int, r double, g double, b double")
    row = aggregate.reduce_by(px, ["media_id"], "mean").first()
    assert (row["r"], row["g"]) == (2.0, 1.25) and aggregate.reduce_by(px, ["media_id"], "std").first()["r"] == pytest.approx(1.25**0.5)
    frames = spark.range(30_000).selectExpr("'m' AS media_id", "id / 10 AS t", "cast(id AS int) AS frame")
    probes = spark.createDataFrame([("m", 1, -5.0), ("m", 2, 0.05), ("m", 3, 99.9), ("m", 4, 1e9), ("n", 5, 1.0)], "media_id string, probe_id long, at double")
    assert {r["probe_id"]: r["frame"] for r in lookup.as_of(frames, probes).collect()} == {1: 0, 2: 0, 3: 999, 4: 29_999, 5: None}
