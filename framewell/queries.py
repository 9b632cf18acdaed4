"""Registered queries of the frame operators, each with the SQL that an independent engine answers it by."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import color
from .operators import aggregate, change, flow, frequency, lookup, preview, sampling, selection
from .sources import clips
from .sources.clips import CLIPS, EMBEDDING_CLIPS_SQL, EVENT_CLIPS_SQL, LINEITEM_CLIPS_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def fx(name: str) -> str:
    return f"({CLIPS[name].duckdb()})"


EV, EM, LI = f"({EVENT_CLIPS_SQL})", f"({EMBEDDING_CLIPS_SQL})", f"({LINEITEM_CLIPS_SQL})"
_W = "WINDOW w AS (PARTITION BY media_id, y, x ORDER BY frame)"


def scores_sql(px: str, where: str = "TRUE", point: bool = False) -> str:
    d = f"""SELECT media_id, frame, t, lag(frame) OVER w AS previous_frame,
        abs(r - lag(r) OVER w) + abs(g - lag(g) OVER w) + abs(b - lag(b) OVER w) AS d FROM {px} WHERE {where} {_W}"""
    if point:
        return f"SELECT media_id, frame, previous_frame, t, CAST(d AS DOUBLE) AS score, d / 765.0 AS normalized FROM ({d}) WHERE previous_frame IS NOT NULL"
    return f"""SELECT media_id, frame, previous_frame, min(t) AS t, CAST(sum(d) AS DOUBLE) / (count(*) * 3) AS score, CAST(sum(d) AS DOUBLE) / (count(*) * 3) / 255.0 AS normalized
        FROM ({d}) WHERE previous_frame IS NOT NULL GROUP BY media_id, frame, previous_frame"""


def events_sql(scores: str, gap: int = 1, least: int = 1) -> str:
    return f"""
WITH s AS ({scores}),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY frame) AS i, row_number() OVER (PARTITION BY media_id ORDER BY normalized DESC, frame) AS k FROM s),
h AS (SELECT media_id, coalesce(avg(normalized) FILTER (k > 1) + 3 * stddev_pop(normalized) FILTER (k > 1), max(normalized)) AS h FROM n GROUP BY media_id),
o AS (SELECT n.*, CASE WHEN i - lag(i) OVER (PARTITION BY n.media_id ORDER BY frame) <= {gap} THEN 0 ELSE 1 END AS f FROM n JOIN h ON n.media_id = h.media_id WHERE normalized > h),
e AS (SELECT *, sum(f) OVER (PARTITION BY media_id ORDER BY frame) AS event FROM o)
SELECT media_id, CAST(event AS BIGINT) AS event, min(previous_frame) AS start_frame, max(frame) AS end_frame,
       arg_max(frame, (normalized, -frame)) AS peak_frame, max(score) AS peak_score, max(normalized) AS peak_normalized, avg(normalized) AS mean_normalized, count(*) AS record_count
FROM e GROUP BY media_id, event HAVING count(*) >= {least}"""


# change


@query("fx_change_events", events_sql(scores_sql(fx("basic"))))
def fx_change_events(spark, sf_dir):
    return change.events(change.change_scores(CLIPS["basic"].pixels(spark)))


@query("fx_change_full", scores_sql(fx("basic")))
def fx_change_full(spark, sf_dir):
    return change.change_scores(CLIPS["basic"].pixels(spark))


@query("fx_change_point", scores_sql(fx("basic"), "x = 2 AND y = 28", point=True))
def fx_change_point(spark, sf_dir):
    return change.change_scores(CLIPS["basic"].pixels(spark), point=(2, 28))


@query("fx_change_rect", scores_sql(fx("motion"), "x >= 4 AND x < 24 AND y >= 20 AND y < 40"))
def fx_change_rect(spark, sf_dir):
    return change.change_scores(CLIPS["motion"].pixels(spark), rect=(4, 20, 20, 20))


@query("fx_change_grid", scores_sql(fx("noise"), "x >= 3 AND x < 33 AND y >= 5 AND y < 45 AND (x - 3) % 4 = 0 AND (y - 5) % 4 = 0"))
def fx_change_grid(spark, sf_dir):
    return change.change_scores(CLIPS["noise"].pixels(spark), rect=(3, 5, 30, 40), step=4)


@query("fx_change_top", f"{scores_sql(fx('basic'), 'x = 24 AND y = 16', point=True)} ORDER BY score DESC, media_id, frame LIMIT 3")
def fx_change_top(spark, sf_dir):
    return change.top_changes(change.change_scores(CLIPS["basic"].pixels(spark), point=(24, 16)), 3)


@query("ev_change", scores_sql(EV))
def ev_change(spark, sf_dir):
    return change.change_scores(clips.event_clips(spark, sf_dir))


@query("ev_change_events", events_sql(scores_sql(EV), gap=2, least=1))
def ev_change_events(spark, sf_dir):
    return change.events(change.change_scores(clips.event_clips(spark, sf_dir)), min_gap=2)


@query("em_change", scores_sql(EM))
def em_change(spark, sf_dir):
    return change.change_scores(clips.embedding_clips(spark, sf_dir))


@query("li_change_bench", scores_sql(LI))
def li_change_bench(spark, sf_dir):
    return change.change_scores(clips.lineitem_clips(spark, sf_dir))


@query("li_topk_bench", f"SELECT * FROM ({scores_sql(LI)}) ORDER BY score DESC, media_id, frame LIMIT 100")
def li_topk_bench(spark, sf_dir):
    return change.top_changes(change.change_scores(clips.lineitem_clips(spark, sf_dir)), 100)


_STEP = ", ".join(f"abs({c} - lag({c}) OVER w) AS {c}" for c in "rgb")


@query("fx_frame_diff", f"SELECT * FROM (SELECT media_id, frame, t, y, x, {_STEP} FROM {fx('motion')} {_W}) WHERE r IS NOT NULL")
def fx_frame_diff(spark, sf_dir):
    return change.differences(CLIPS["motion"].pixels(spark))


@query("fx_frame_diff_dt", f"SELECT media_id, frame, t, y, x, r / d AS r, g / d AS g, b / d AS b FROM (SELECT media_id, frame, t, t - lag(t) OVER w AS d, y, x, {_STEP} FROM {fx('vfr')} {_W}) WHERE r IS NOT NULL")
def fx_frame_diff_dt(spark, sf_dir):
    return change.differences(CLIPS["vfr"].pixels(spark), per_second=True)


@query("em_frame_diff", f"SELECT * FROM (SELECT media_id, frame, t, y, x, {_STEP} FROM {EM} {_W}) WHERE r IS NOT NULL")
def em_frame_diff(spark, sf_dir):
    return change.differences(clips.embedding_clips(spark, sf_dir))


_KINDS = """SELECT media_id, frame, CASE WHEN max(v) < 16 THEN 'black' WHEN min(v) > 240 THEN 'white'
  WHEN sqrt(greatest(sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)), 0)) < 2 THEN 'flat' END AS kind
FROM (SELECT media_id, frame, unnest([r, g, b]) AS v FROM {}) GROUP BY media_id, frame"""


@query("fx_scan_anomalies", f"""
WITH a AS (SELECT media_id, 0 AS part, kind, frame FROM ({_KINDS.format(fx("basic"))}) WHERE kind IS NOT NULL
           UNION ALL SELECT media_id, 1, 'flash', peak_frame FROM ({events_sql(scores_sql(fx("basic")))}) WHERE record_count <= 2),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY part, frame) AS ordinal FROM a)
SELECT media_id, ordinal, kind, frame FROM n WHERE ordinal <= 200""")
def fx_scan_anomalies(spark, sf_dir):
    return change.anomalies(CLIPS["basic"].pixels(spark))


@query("em_frame_kinds", f"SELECT media_id, kind, count(*) AS frames FROM ({_KINDS.format(EM)}) GROUP BY ALL")
def em_frame_kinds(spark, sf_dir):
    return change.frame_kinds(clips.embedding_clips(spark, sf_dir)).groupBy("media_id", "kind").agg(F.count(F.lit(1)).alias("frames"))


# sampling


@query("fx_xt", f"SELECT media_id, frame, t, x, r, g, b FROM {fx('basic')} WHERE y = 8")
def fx_xt(spark, sf_dir):
    return sampling.xt(CLIPS["basic"].pixels(spark), 8)


@query("fx_yt", f"SELECT media_id, frame, t, y, r, g, b FROM {fx('basic')} WHERE x = 24")
def fx_yt(spark, sf_dir):
    return sampling.yt(CLIPS["basic"].pixels(spark), 24)


_POINTS = [(2.0, 28.0), (24.0, 16.0), (7.4, 8.5)]


@query("fx_points", f"SELECT media_id, frame, t, k, r, g, b FROM {fx('basic')} JOIN (VALUES (0, 2, 28), (1, 24, 16), (2, 7, 9)) AS p(k, x, y) USING (x, y)")
def fx_points(spark, sf_dir):
    return sampling.points_t(CLIPS["basic"].pixels(spark), sampling.point_table(spark, _POINTS), 32, 32)


@query("fx_bilinear", f"""SELECT media_id, frame, k, min(t) AS t, sum(r * w) AS r, sum(g * w) AS g, sum(b * w) AS b FROM {fx('image16')}
JOIN (VALUES (0, 2, 3, 0.375e0), (0, 3, 3, 0.125e0), (0, 2, 4, 0.375e0), (0, 3, 4, 0.125e0), (1, 15, 15, 1e0)) AS p(k, x, y, w) USING (x, y) GROUP BY media_id, frame, k""")
def fx_bilinear(spark, sf_dir):
    return sampling.points_t(CLIPS["image16"].pixels(spark), sampling.point_table(spark, [(2.25, 3.5), (15.0, 15.0)]), 16, 16, "bilinear")


@query("fx_block_mean", f"""SELECT media_id, frame, min(t) AS t, k, CAST(sum(r) AS DOUBLE) / count(*) AS r, CAST(sum(g) AS DOUBLE) / count(*) AS g, CAST(sum(b) AS DOUBLE) / count(*) AS b
FROM {fx('motion')} m JOIN (VALUES (0, 4, 28), (1, 62, 62)) AS p(k, px, py) ON x BETWEEN px AND px + 3 AND y BETWEEN py AND py + 3 GROUP BY media_id, frame, k""")
def fx_block_mean(spark, sf_dir):
    return sampling.points_t(CLIPS["motion"].pixels(spark), sampling.point_table(spark, [(4, 28), (62, 62)]), 64, 64, block=4)


@query("fx_path", f"SELECT media_id, frame, t, CAST(x - 3 AS INT) AS k, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM {fx('basic')} WHERE y = 8 AND x BETWEEN 3 AND 27")
def fx_path(spark, sf_dir):
    return sampling.path_t(CLIPS["basic"].pixels(spark), [(3, 8), (27, 8)], 32, 32, 25).select("media_id", "frame", "t", "k", *[F.rint(c).alias(c) for c in "rgb"])


@query("fx_grid_timeline", f"""SELECT media_id, CAST((y // 8) * 4 + x // 8 AS INT) AS k, frame, t, r, g, b FROM {fx('noise')} WHERE x % 8 = 0 AND y % 8 = 0 AND x < 32 AND y < 32""")
def fx_grid_timeline(spark, sf_dir):
    points = sampling.grid_points(spark, (0, 0, 32, 32), 8).select("k", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return sampling.timeline(CLIPS["noise"].pixels(spark), points, 64, 64)


@query("fx_crop_ids", f"SELECT media_id, frame, y * 16 + x AS pixel_id, r, g, b FROM {fx('image16')} WHERE x >= 2 AND x < 7 AND y >= 3 AND y < 9")
def fx_crop_ids(spark, sf_dir):
    return sampling.crop(CLIPS["image16"].pixels(spark), (2, 3, 5, 6)).select("media_id", "frame", sampling.pixel_id(16).alias("pixel_id"), "r", "g", "b")


@query("em_cells", f"SELECT * FROM {EM} WHERE frame >= 2 AND frame < 9 AND (frame - 2) % 3 = 0 AND y = 4 AND x < 5")
def em_cells(spark, sf_dir):
    return sampling.cells(clips.embedding_clips(spark, sf_dir), ["frame", "y", "x"], [slice(2, 9, 3), 4, slice(0, 5)], [100, 8, 8])


# selection

_SELECT = {
    "all": (selection.Selection(every=4), "frame % 4 = 0"),
    "interval": (selection.Selection("frame_interval", 3, 17, every=4), "frame >= 3 AND frame < 17 AND (frame - 3) % 4 = 0"),
    "indices": (selection.Selection("indices", indices=(1, 4, 9, 16), every=2), "frame IN (1, 9)"),
    "closed": (selection.from_closed(2, 6), "frame BETWEEN 2 AND 6"),
}
for _name, (_s, _sql) in _SELECT.items():
    query(f"fx_select_{_name}", f"SELECT * FROM {fx('vfr')} WHERE {_sql}")(lambda spark, sf_dir, s=_s: selection.select(CLIPS["vfr"].pixels(spark), s))


@query("fx_select_time", f"SELECT media_id, frame, t, y, x, r, g, b FROM (SELECT *, dense_rank() OVER (ORDER BY frame) - 1 AS n FROM {fx('vfr')} WHERE t >= 0.1 AND t < 0.65) WHERE n % 3 = 0")
def fx_select_time(spark, sf_dir):
    return selection.select(CLIPS["vfr"].pixels(spark), selection.Selection("time_interval", 0.1, 0.65, every=3))


@query("ev_picks", f"""WITH b AS (SELECT media_id, 0 AS s, max(frame) AS e FROM {EV} GROUP BY media_id)
SELECT DISTINCT media_id, CAST(round_even(s + (e - s) * i / 8, 0) AS INT) AS frame FROM b, range(9) AS r(i)""")
def ev_picks(spark, sf_dir):
    bounds = clips.event_clips(spark, sf_dir).groupBy("media_id").agg(F.lit(0).alias("start"), F.max("frame").alias("end"))
    return selection.picks_of(bounds, 9)


@query("ev_stride", f"SELECT media_id, count(*) AS frames, CAST(greatest(1, ceil(count(*) / 20)) AS BIGINT) AS stride FROM {EV} GROUP BY media_id")
def ev_stride(spark, sf_dir):
    g = clips.event_clips(spark, sf_dir).groupBy("media_id").agg(F.count(F.lit(1)).alias("frames"))
    return g.select("media_id", "frames", selection.auto_stride_col(F.col("frames") * (selection.AUTO_FRAMES // 20)).cast("bigint").alias("stride"))


# aggregates


def moments_sql(px: str, by: str, where: str = "TRUE") -> str:
    m = ", ".join(f"CAST(sum({c}) AS DOUBLE) / count(*) AS mean_{c}, CAST(min({c}) AS DOUBLE) AS min_{c}, CAST(max({c}) AS DOUBLE) AS max_{c}, sqrt(CAST(sum({c} * {c}) AS DOUBLE) / count(*)) AS rms_{c}, quantile_cont({c}, 0.5) AS median_{c}, quantile_cont({c}, 0.25) AS p25_{c}" for c in "rgb")
    return f"SELECT {by}, {m} FROM {px} WHERE {where} GROUP BY {by}"


def _moments(reduce, by):
    out = None
    for name, p in (("mean", None), ("min", None), ("max", None), ("rms", None), ("median", None), ("percentile", 25.0)):
        part = reduce(name, p).select(*by, *[F.col(c).cast("double").alias(f"{'p25' if p else name}_{c}") for c in "rgb"])
        out = part if out is None else out.join(part, by)
    return out


@query("fx_roi_all", moments_sql(fx("noise"), "media_id, frame", "x >= 8 AND x < 29 AND y >= 8 AND y < 40"))
def fx_roi_all(spark, sf_dir):
    px = CLIPS["noise"].pixels(spark)
    return _moments(lambda n, p: aggregate.roi_t(px, (8, 8, 21, 32), n, p), ["media_id", "frame"])


@query("fx_temporal_all", moments_sql(fx("noise"), "media_id, y, x", "x < 16 AND y < 16"))
def fx_temporal_all(spark, sf_dir):
    px = CLIPS["noise"].pixels(spark)
    return _moments(lambda n, p: aggregate.over_time(px, n, (0, 0, 16, 16), p), ["media_id", "y", "x"])


@query("fx_temporal_diff", f"SELECT media_id, y, x, {', '.join(f'CAST(sum({c}) AS DOUBLE) / count(*) AS {c}' for c in 'rgb')} FROM (SELECT media_id, y, x, {_STEP} FROM {fx('noise')} {_W}) WHERE r IS NOT NULL GROUP BY ALL")
def fx_temporal_diff(spark, sf_dir):
    return aggregate.over_time(CLIPS["noise"].pixels(spark), "diff")


@query("fx_temporal_std", f"SELECT media_id, y, x, {', '.join(f'floor(stddev_pop({c}) * 1000 + 0.5) AS {c}' for c in 'rgb')} FROM {fx('noise')} GROUP BY ALL")
def fx_temporal_std(spark, sf_dir):
    out = aggregate.over_time(CLIPS["noise"].pixels(spark), "std")
    return out.select("media_id", "y", "x", *[F.floor(F.col(c) * 1000 + 0.5).cast("double").alias(c) for c in "rgb"])


@query("em_reduce", moments_sql(EM, "media_id, y, x"))
def em_reduce(spark, sf_dir):
    px = clips.embedding_clips(spark, sf_dir)
    return _moments(lambda n, p: aggregate.over_time(px, n, percentile=p), ["media_id", "y", "x"])


@query("em_roi", moments_sql(EM, "media_id, frame", "x >= 2 AND x < 6 AND y >= 2 AND y < 6"))
def em_roi(spark, sf_dir):
    px = clips.embedding_clips(spark, sf_dir)
    return _moments(lambda n, p: aggregate.roi_t(px, (2, 2, 4, 4), n, p), ["media_id", "frame"])


@query("ev_reduce", moments_sql(EV, "media_id, y, x"))
def ev_reduce(spark, sf_dir):
    px = clips.event_clips(spark, sf_dir)
    return _moments(lambda n, p: aggregate.over_time(px, n, percentile=p), ["media_id", "y", "x"])


@query("li_reduce_bench", moments_sql(LI, "media_id, y, x"))
def li_reduce_bench(spark, sf_dir):
    px = clips.lineitem_clips(spark, sf_dir)
    return _moments(lambda n, p: aggregate.over_time(px, n, percentile=p), ["media_id", "y", "x"])


@query("fx_reduce_summary", f"""SELECT media_id, {', '.join(f'CAST(min({c}) AS DOUBLE) AS min_{c}, CAST(max({c}) AS DOUBLE) AS max_{c}, avg({c}) AS mean_{c}' for c in 'rgb')}
FROM (SELECT media_id, y, x, {', '.join(f'max({c}) AS {c}' for c in 'rgb')} FROM {fx('motion')} GROUP BY ALL) GROUP BY media_id""")
def fx_reduce_summary(spark, sf_dir):
    return aggregate.summary(aggregate.over_time(CLIPS["motion"].pixels(spark), "max"))


@query("fx_region_stats", f"""SELECT media_id, frame, count(*) AS pixel_count, {', '.join(f'CAST(sum({c}) AS DOUBLE) / count(*) AS mean_{c}, quantile_cont({c}, 0.5) AS median_{c}, CAST(min({c}) AS DOUBLE) AS min_{c}, CAST(max({c}) AS DOUBLE) AS max_{c}' for c in 'rgb')},
floor(avg(0.2126 * r + 0.7152 * g + 0.0722 * b) * 1e6 + 0.5) AS luminance_e6 FROM {fx('basic')} WHERE x >= 4 AND x < 30 AND y >= 4 AND y < 30 GROUP BY media_id, frame""")
def fx_region_stats(spark, sf_dir):
    s = aggregate.region_stats(CLIPS["basic"].pixels(spark), (4, 4, 26, 26))
    return s.select("media_id", "frame", "pixel_count", *[F.col(f"{n}_{c}") for n in ("mean", "median", "min", "max") for c in "rgb"], F.floor(F.col("mean_luminance") * 1e6 + 0.5).cast("double").alias("luminance_e6"))


_HSV = """(CASE WHEN hi = lo THEN 0 WHEN hi = r THEN ((g - b) / (hi - lo) + 6) % 6 WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END) * 60 AS hue,
CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi END AS sat, hi / 255 AS val"""
_LINEAR = "[CASE WHEN v / 255.0 <= 0.04045 THEN v / 255.0 / 12.92 ELSE pow((v / 255.0 + 0.055) / 1.055, 2.4) END FOR v IN [r, g, b]]"
_LAB_F = """[CASE WHEN v > 216.0 / 24389 THEN cbrt(v) ELSE v / (3 * 36.0 / 841) + 4.0 / 29 END FOR v IN [
 (0.4124564 * c[1] + 0.3575761 * c[2] + 0.1804375 * c[3]) / 0.95047, 0.2126729 * c[1] + 0.7151522 * c[2] + 0.0721750 * c[3], (0.0193339 * c[1] + 0.1191920 * c[2] + 0.9503041 * c[3]) / 1.08883]]"""


def whole(v, digits: int):
    """A value as a whole number of its last compared digit; not cut at halves, which exact results often are."""
    return F.floor(v * 10**digits + 0.317).cast("double")


@query("em_roi_std", f"SELECT media_id, frame, {', '.join(f'floor(stddev_pop({c}) * 1e4 + 0.317) AS {c}' for c in 'rgb')} FROM {EM} WHERE x >= 2 AND x < 6 AND y >= 2 AND y < 6 GROUP BY media_id, frame")
def em_roi_std(spark, sf_dir):
    out = aggregate.roi_t(clips.embedding_clips(spark, sf_dir), (2, 2, 4, 4), "std")
    return out.select("media_id", "frame", *[whole(F.col(c), 4).alias(c) for c in "rgb"])


@query("fx_region_all", f"""WITH p AS (SELECT *, {_HSV}, 0.2126 * r + 0.7152 * g + 0.0722 * b AS lum, {_LAB_F} AS f FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo, {_LINEAR} AS c FROM {fx('noise')}))
SELECT media_id, frame, count(*) AS pixel_count, {', '.join(f'floor(avg({c}) * 1e4 + 0.317) AS mean_{c}, floor(stddev_pop({c}) * 1e4 + 0.317) AS std_{c}, floor(quantile_cont({c}, 0.5) * 1e4 + 0.317) AS median_{c}, min({c}) * 1e4 AS min_{c}, max({c}) * 1e4 AS max_{c}' for c in 'rgb')},
floor(avg(hue) * 1e4 + 0.317) AS mean_hue, floor(avg(sat) * 1e6 + 0.317) AS mean_saturation, floor(avg(val) * 1e6 + 0.317) AS mean_value,
floor(avg(116 * f[2] - 16) * 1e4 + 0.317) AS mean_lab_l, floor(avg(500 * (f[1] - f[2])) * 1e4 + 0.317) AS mean_lab_a, floor(avg(200 * (f[2] - f[3])) * 1e4 + 0.317) AS mean_lab_b,
floor(avg(lum) * 1e4 + 0.317) AS mean_luminance, floor(stddev_pop(lum) * 1e4 + 0.317) AS std_luminance FROM p GROUP BY media_id, frame""")
def fx_region_all(spark, sf_dir):
    """Every column of the statistics of whole frames."""
    out = aggregate.region_stats(CLIPS["noise"].pixels(spark))
    keys = ("media_id", "frame", "pixel_count")
    return out.select(*keys, *[whole(F.col(c), 4).alias(c) for c in out.columns if c not in keys])


_ALPHA = "SELECT 'a' || (id % 4) AS media_id, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 255 WHEN 2 THEN 255 * (floor(id / 4) % 2) ELSE floor(id / 4) % 256 END AS alpha, CASE WHEN id % 4 = 2 THEN floor(id / 4) % 9 END AS index FROM"


def _native(spark):
    spark.range(4000).createOrReplaceTempView("_native")
    return spark.sql(f"SELECT media_id, CAST(alpha AS INT) AS alpha, CAST(index AS INT) AS index FROM ({_ALPHA} _native)")


@query("fx_content", f"""SELECT media_id, pixels, transparent, "partial", opaque, alpha_levels, palette_used, with_alpha, transparent / pixels AS transparent_ratio, "partial" / pixels AS partial_ratio, opaque / pixels AS opaque_ratio,
CASE WHEN with_alpha = 0 THEN 'none' WHEN "partial" > 0 THEN 'continuous' WHEN transparent > 0 THEN 'binary' ELSE 'explicit_but_opaque' END AS transparency
FROM (SELECT media_id, count(*) AS pixels, count(*) FILTER (alpha = 0) AS transparent, count(*) FILTER (alpha > 0 AND alpha < 255) AS "partial", count(*) FILTER (coalesce(alpha, 255) = 255) AS opaque,
  count(DISTINCT alpha) AS alpha_levels, count(DISTINCT index) AS palette_used, count(alpha) AS with_alpha FROM ({_ALPHA} (SELECT range AS id FROM range(4000)))  GROUP BY media_id)""")
def fx_content(spark, sf_dir):
    return aggregate.content_counts(_native(spark))


@query("fx_alpha_histogram", f"SELECT media_id, CAST(coalesce(alpha, 255) AS INT) AS alpha, count(*) AS n FROM ({_ALPHA} (SELECT range AS id FROM range(4000))) GROUP BY ALL")
def fx_alpha_histogram(spark, sf_dir):
    return aggregate.alpha_histogram(_native(spark))


# pairs, look-ups, pages


def compare_sql(px: str, a: int, b: int, over: int) -> str:
    return f"""SELECT media_id, count(*) FILTER (d > {over}) AS changed, count(*) FILTER (d > {over}) / count(*) AS changed_ratio, CAST(sum(s) AS DOUBLE) / (count(*) * 3) AS mean_diff, max(d) AS max_diff,
min(x) FILTER (d > {over}) AS box_x, min(y) FILTER (d > {over}) AS box_y, max(x) FILTER (d > {over}) - min(x) FILTER (d > {over}) + 1 AS box_w, max(y) FILTER (d > {over}) - min(y) FILTER (d > {over}) + 1 AS box_h
FROM (SELECT p.media_id, p.x, p.y, greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b)) AS d, abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b) AS s
      FROM {px} p JOIN {px} q ON p.media_id = q.media_id AND p.x = q.x AND p.y = q.y WHERE p.frame = {a} AND q.frame = {b}) GROUP BY media_id"""


@query("fx_compare_bbox", compare_sql(fx("basic"), 0, 5, 10))
def fx_compare_bbox(spark, sf_dir):
    return lookup.compare(CLIPS["basic"].pixels(spark), 0, 5, 10)


@query("em_compare", compare_sql(EM, 0, 1, 40))
def em_compare(spark, sf_dir):
    return lookup.compare(clips.embedding_clips(spark, sf_dir), 0, 1, 40)


@query("ev_asof", f"""WITH f AS {EV}, p AS (SELECT media_id, i AS probe_id, i * 50000.0 AS "at" FROM (SELECT DISTINCT media_id FROM f), range(40) AS r(i))
SELECT p.media_id, probe_id, CAST("at" AS DOUBLE) AS "at", coalesce(max(frame) FILTER (t <= "at"), min(frame)) AS frame FROM p JOIN f ON p.media_id = f.media_id GROUP BY p.media_id, probe_id, "at"
""")
def ev_asof(spark, sf_dir):
    f = clips.event_clips(spark, sf_dir)
    probes = f.select("media_id").distinct().select("media_id", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i")).select("media_id", F.col("i").cast("bigint").alias("probe_id"), (F.col("i") * 50000.0).cast("double").alias("at"))
    return lookup.as_of(f, probes)


@query("ev_frame_range", f"SELECT media_id, coalesce(max(frame) FILTER (t <= 100000.000001), min(frame)) AS first, coalesce(max(frame) FILTER (t <= 900000.000001), min(frame)) AS last, count(*) AS total FROM {EV} GROUP BY media_id")
def ev_frame_range(spark, sf_dir):
    return lookup.frame_range(clips.event_clips(spark, sf_dir), 100000.0, 900000.0)


@query("ev_vfr_flags", f"""SELECT media_id, count(*) AS frames, coalesce(count(d) >= 2 AND max(d) - min(d) > 0.1 * avg(d), FALSE) AS irregular
FROM (SELECT media_id, t - lag(t) OVER (PARTITION BY media_id ORDER BY frame) AS d FROM {EV}) GROUP BY media_id""")
def ev_vfr_flags(spark, sf_dir):
    return change.irregular(clips.event_clips(spark, sf_dir))


_PTS = "CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 13 = 0 THEN pts0 - 50000000000 ELSE pts0 END"
_PACKETS = f"""SELECT media_id, frame, {_PTS} AS pts FROM (SELECT CAST(user_id AS VARCHAR) AS media_id, event_id, CAST(row_number() OVER w - 1 AS INT) AS frame, epoch_us(ts) AS pts0
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("ev_pts_flags", f"""
WITH p AS ({_PACKETS}), q AS (SELECT *, last_value(pts IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  first_value(pts IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first FROM p)
SELECT media_id, frame, pts, floor(CASE WHEN pts IS NULL THEN frame ELSE greatest((pts - first) / 1e6, 0) END * 1000 + 0.5) AS t_ms,
  array_to_string(list_filter([CASE WHEN pts IS NULL THEN 'PTS_MISSING' END, CASE WHEN pts = before THEN 'PTS_DUPLICATE' END, CASE WHEN pts < before THEN 'PTS_NON_MONOTONIC' END,
    CASE WHEN pts - first < 0 THEN 'TIMELINE_NEGATIVE_NORMALIZED' END, CASE WHEN pts IS NULL THEN 'TIMELINE_ESTIMATED_FROM_INDEX' END], lambda f: f IS NOT NULL), ',') AS flags
FROM q""")
def ev_pts_flags(spark, sf_dir):
    t = change.timing(_packets(spark, sf_dir).withColumn("duration_pts", F.lit(None).cast("bigint")), 1, 1_000_000)
    return t.select("media_id", "frame", "pts", F.floor(F.col("t") * 1000 + 0.5).cast("double").alias("t_ms"), F.array_join("flags", ",").alias("flags"))


def _packets(spark, sf_dir):
    """Packets (media_id, frame, pts), some without a stamp and some out of order."""
    ids = spark.read.parquet(f"{sf_dir}/events.parquet")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    pts = F.when(F.col("event_id") % 17 == 0, None).when(F.col("event_id") % 13 == 0, us - 50000000000).otherwise(us)
    return ids.select(F.col("user_id").cast("string").alias("media_id"), (F.row_number().over(w) - 1).cast("int").alias("frame"), pts.alias("pts"))


@query("ev_pts_durations", f"""SELECT media_id, frame, CASE WHEN frame % 5 = 0 THEN frame + 1 WHEN after > pts THEN after - pts END AS duration_pts
FROM (SELECT *, lead(pts) OVER (PARTITION BY media_id ORDER BY frame) AS after FROM ({_PACKETS}))""")
def ev_pts_durations(spark, sf_dir):
    known = _packets(spark, sf_dir).withColumn("duration_pts", F.when(F.col("frame") % 5 == 0, F.col("frame") + 1).cast("bigint"))
    return change.timing(known, 1, 1_000_000).select("media_id", "frame", "duration_pts")


@query("ev_duration", f"""SELECT media_id, floor((CASE WHEN n % 3 = 0 THEN stream WHEN start > 0 AND stop > start THEN stop - start ELSE stop END) * 1e3 + 0.317) AS duration_ms
FROM (SELECT media_id, count(*) AS n, max(t) AS stream, max(t) AS stop, min(t) FILTER (t > 0 AND frame % 2 = 0) AS start FROM {EV} GROUP BY media_id)""")
def ev_duration(spark, sf_dir):
    g = clips.event_clips(spark, sf_dir).groupBy("media_id").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("stop"), F.min(F.when((F.col("t") > 0) & (F.col("frame") % 2 == 0), F.col("t"))).alias("start"))
    return g.select("media_id", whole(change.duration(F.when(F.col("n") % 3 == 0, F.col("stop")), F.col("stop"), F.col("start")), 3).alias("duration_ms"))


@query("ev_milliseconds", f"SELECT media_id, frame, floor(t * 1e6 + 0.317) AS microseconds FROM {EV}")
def ev_milliseconds(spark, sf_dir):
    return clips.event_clips(spark, sf_dir).select("media_id", "frame", whole(color.milliseconds(F.col("t")), 3).alias("microseconds"))


@query("ev_page", f"SELECT * FROM ({scores_sql(EV)}) ORDER BY score DESC, media_id, frame LIMIT 50 OFFSET 100")
def ev_page(spark, sf_dir):
    return lookup.page(change.change_scores(clips.event_clips(spark, sf_dir)), [F.desc("score"), "media_id", "frame"], 100, 50)[0]


# colour


@query("fx_hsv_clip", f"""SELECT media_id, frame, y, x, floor((CASE WHEN hi = lo THEN 0 WHEN hi = r THEN ((g - b) / (hi - lo) + 6) % 6 WHEN hi = g THEN (b - r) / (hi - lo) + 2 ELSE (r - g) / (hi - lo) + 4 END) * 60 * 1e6 + 0.5) AS h_e6,
floor(CASE WHEN hi = 0 THEN 0 ELSE (hi - lo) / hi * 100 END * 1e6 + 0.5) AS s_e6, floor(hi / 255 * 100 * 1e6 + 0.5) AS v_e6 FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM {fx('noise')})""")
def fx_hsv_clip(spark, sf_dir):
    px = CLIPS["noise"].pixels(spark).withColumn("c", color.hsv(F.col("r"), F.col("g"), F.col("b")))
    return px.select("media_id", "frame", "y", "x", *[F.floor(F.col(f"c.{k}") * 1e6 + 0.5).cast("double").alias(f"{k}_e6") for k in "hsv"])


@query("fx_luma3", f"SELECT media_id, frame, y, x, floor((0.2126 * r + 0.7152 * g + 0.0722 * b) * 1e6 + 0.5) AS bt709, floor((0.299 * r + 0.587 * g + 0.114 * b) * 1e6 + 0.5) AS bt601, (r + g + b) / 3.0 AS mean FROM {fx('image16')}")
def fx_luma3(spark, sf_dir):
    c = [F.col(k) for k in "rgb"]
    whole = lambda v: F.floor(v * 1e6 + 0.5).cast("double")
    return CLIPS["image16"].pixels(spark).select("media_id", "frame", "y", "x", whole(color.luminance(*c)).alias("bt709"), whole(color.luma601(*c)).alias("bt601"), ((c[0] + c[1] + c[2]) / 3.0).alias("mean"))


@query("fx_hex", f"SELECT media_id, y, x, printf('#%02X%02X%02X', r, g, b) AS hex FROM {fx('image16')}")
def fx_hex(spark, sf_dir):
    return CLIPS["image16"].pixels(spark).select("media_id", "y", "x", color.hex_code(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


@query("fx_lab", f"""WITH l AS (SELECT y, x, [CASE WHEN v / 255.0 <= 0.04045 THEN v / 255.0 / 12.92 ELSE pow((v / 255.0 + 0.055) / 1.055, 2.4) END FOR v IN [r, g, b]] AS c FROM {fx('image16')}),
q AS (SELECT y, x, [CASE WHEN v > 216.0 / 24389 THEN cbrt(v) ELSE v / (3 * 36.0 / 841) + 4.0 / 29 END FOR v IN [
 (0.4124564 * c[1] + 0.3575761 * c[2] + 0.1804375 * c[3]) / 0.95047, 0.2126729 * c[1] + 0.7151522 * c[2] + 0.0721750 * c[3], (0.0193339 * c[1] + 0.1191920 * c[2] + 0.9503041 * c[3]) / 1.08883]] AS f FROM l)
SELECT y, x, floor((116 * f[2] - 16) * 1e4 + 0.5) AS l_e4, floor(500 * (f[1] - f[2]) * 1e4 + 0.5) AS a_e4, floor(200 * (f[2] - f[3]) * 1e4 + 0.5) AS b_e4 FROM q""")
def fx_lab(spark, sf_dir):
    px = CLIPS["image16"].pixels(spark).withColumn("c", color.lab(F.col("r"), F.col("g"), F.col("b")))
    return px.select("y", "x", *[F.floor(F.col(f"c.{k}") * 1e4 + 0.5).cast("double").alias(f"{k}_e4") for k in "lab"])


_SECTOR = "CAST(round_even((v - v * s * greatest(0, least((n + h / 60.0) % 6, 4 - (n + h / 60.0) % 6, 1))) * 255, 0) AS INT)"


def _from_hsv_sql(source: str, keys: str) -> str:
    return f"SELECT {keys}, {', '.join(_SECTOR.replace('n +', f'{n} +') + f' AS {c}' for n, c in ((5, 'r'), (3, 'g'), (1, 'b')))} FROM ({source})"


@query("fx_hsv_unit", f"SELECT frame, y, x, floor(hue * 1e6 + 0.317) AS h_e6, floor(sat * 1e6 + 0.317) AS s_e6, floor(val * 1e6 + 0.317) AS v_e6 FROM (SELECT *, {_HSV} FROM (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM {fx('noise')}))")
def fx_hsv_unit(spark, sf_dir):
    px = CLIPS["noise"].pixels(spark).withColumn("c", color.hsv(F.col("r"), F.col("g"), F.col("b"), 1.0))
    return px.select("frame", "y", "x", *[whole(F.col(f"c.{k}"), 6).alias(f"{k}_e6") for k in "hsv"])


@query("fx_from_hsv", _from_hsv_sql(f"SELECT frame, y, x, (r * 7 + x) % 360 + 0.3 AS h, (g % 100) / 101.0 AS s, (b % 98) / 99.0 AS v FROM {fx('noise')}", "frame, y, x"))
def fx_from_hsv(spark, sf_dir):
    h, s, v = (F.col("r") * 7 + F.col("x")) % 360 + 0.3, (F.col("g") % 100) / 101.0, (F.col("b") % 98) / 99.0
    return CLIPS["noise"].pixels(spark).withColumn("c", color.from_hsv(h, s, v)).select("frame", "y", "x", "c.r", "c.g", "c.b")


_XYZ = "(SELECT frame, y, x, [CASE WHEN v > 6.0 / 29 THEN v * v * v ELSE 3 * 36.0 / 841 * (v - 4.0 / 29) END FOR v IN [fy + la / 500, fy, fy - lb / 200]] AS c FROM (SELECT *, r / 2.56 AS l, g - 127.7 AS la, b - 127.7 AS lb, (r / 2.56 + 16) / 116 AS fy FROM {}))"
#: XYZ (D65) to linear sRGB, the inverse of the matrix of ``color``.
_TO_RGB = ((3.2404548360214087, -1.5371388501025751, -0.498531546868481), (-0.9692663898756538, 1.876010928842491, 0.041556082346673545), (0.05564341960421367, -0.20402585426769818, 1.057225162457929))
_GAMMA = "CAST(round_even((CASE WHEN {u} <= 0.0031308 THEN {u} * 12.92 ELSE 1.055 * pow({u}, 1 / 2.4) - 0.055 END) * 255, 0) AS INT)"


@query("fx_from_lab", f"SELECT frame, y, x, {', '.join(_GAMMA.format(u=f'u[{k}]') + f' AS {c}' for k, c in ((1, 'r'), (2, 'g'), (3, 'b')))} FROM (SELECT frame, y, x, [least(greatest(v, 0), 1) FOR v IN [{', '.join(f'{a!r} * 0.95047 * c[1] + {b!r} * c[2] + {d!r} * 1.08883 * c[3]' for a, b, d in _TO_RGB)}]] AS u FROM {_XYZ.format(fx('noise'))})")
def fx_from_lab(spark, sf_dir):
    c = color.from_lab(F.col("r") / 2.56, F.col("g") - 127.7, F.col("b") - 127.7)
    return CLIPS["noise"].pixels(spark).withColumn("c", c).select("frame", "y", "x", "c.r", "c.g", "c.b")


@query("fx_gray_weights", f"""SELECT frame, y, x, floor((0.5 * r + 0.25 * g + 0.25 * b) * 100 + 0.317) AS gray_e2, floor((0.2126729 * c[1] + 0.7151522 * c[2] + 0.0721750 * c[3]) * 255 * 1e6 + 0.317) AS linear_e6
FROM (SELECT *, {_LINEAR} AS c FROM {fx('noise')})""")
def fx_gray_weights(spark, sf_dir):
    c = [F.col(k) for k in "rgb"]
    return CLIPS["noise"].pixels(spark).select("frame", "y", "x", whole(color.weighted(*c, (0.5, 0.25, 0.25)), 2).alias("gray_e2"), whole(color.linear_luminance(*c), 6).alias("linear_e6"))


@query("fx_polar", f"SELECT frame, y, x, floor(sqrt(dx * dx + dy * dy) * 1e6 + 0.317) AS magnitude_e6, floor(degrees(atan2(dy, dx)) * 1e6 + 0.317) AS angle_e6 FROM (SELECT *, r - 99.7 AS dx, g - 101.3 AS dy FROM {fx('noise')})")
def fx_polar(spark, sf_dir):
    px = CLIPS["noise"].pixels(spark).withColumn("p", color.polar(F.col("r") - 99.7, F.col("g") - 101.3))
    return px.select("frame", "y", "x", whole(F.col("p.magnitude"), 6).alias("magnitude_e6"), whole(F.col("p.angle"), 6).alias("angle_e6"))


# previews


@query("em_box_smooth_frames", f"""WITH e AS (SELECT media_id, frame, y, x, r FROM {EM})
SELECT a.media_id, a.frame, a.y, a.x, CAST(sum(b.r) AS DOUBLE) / 9 AS v FROM e a, (VALUES (-1), (0), (1)) AS i(dy), (VALUES (-1), (0), (1)) AS j(dx), e b
WHERE b.media_id = a.media_id AND b.frame = a.frame AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7) GROUP BY a.media_id, a.frame, a.y, a.x""")
def em_box_smooth_frames(spark, sf_dir):
    px = clips.embedding_clips(spark, sf_dir).select("media_id", "frame", "y", "x", F.col("r").alias("v"))
    return preview.box_smooth(px, 8, 8, 3, by=("media_id", "frame"))


@query("em_destripe", f"""SELECT media_id, frame, y, x, floor((r - avg(r) OVER (PARTITION BY media_id, frame, x) - avg(r) OVER (PARTITION BY media_id, frame, y) + avg(r) OVER (PARTITION BY media_id, frame)) * 1e6 + 0.5) AS v_e6 FROM {EM}""")
def em_destripe(spark, sf_dir):
    px = clips.embedding_clips(spark, sf_dir).select("media_id", "frame", "y", "x", F.col("r").alias("v"))
    return preview.destripe(px, ["media_id", "frame"]).select("media_id", "frame", "y", "x", F.floor(F.col("v") * 1e6 + 0.5).cast("double").alias("v_e6"))


@query("em_stretch", f"""WITH p AS (SELECT media_id, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM {EM} GROUP BY media_id)
SELECT media_id, frame, y, x, CAST(CASE WHEN hi - lo < 1e-12 THEN 128 ELSE floor(least(greatest((r - lo) / (hi - lo), 0), 1) * 255 + 0.5) END AS INT) AS v FROM {EM} JOIN p USING (media_id)""")
def em_stretch(spark, sf_dir):
    return preview.stretch(clips.embedding_clips(spark, sf_dir).select("media_id", "frame", "y", "x", F.col("r").alias("v")), ["media_id"], ["v"])


@query("fx_upscale", f"SELECT media_id, y * 3 + i AS y, x * 3 + j AS x, r, g, b FROM {fx('image16')}, range(3) AS a(i), range(3) AS c(j)")
def fx_upscale(spark, sf_dir):
    return preview.upscale(CLIPS["image16"].pixels(spark).select("media_id", "y", "x", "r", "g", "b"), 3)


_FIRE = ", ".join(f"CAST(floor(least(greatest(v * 3 / 255.0 - {k}, 0), 1) * 255 + 0.5) AS INT) AS {c}" for k, c in enumerate("rgb"))


@query("em_compare_heat", f"""WITH d AS (SELECT p.media_id, p.y, p.x, greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b)) AS d FROM {EM} p JOIN {EM} q ON p.media_id = q.media_id AND p.x = q.x AND p.y = q.y WHERE p.frame = 0 AND q.frame = 1)
SELECT media_id, y, x, {_FIRE} FROM (SELECT *, CASE WHEN most > 0 THEN floor(d * (255.0 / most) + 0.5) ELSE 0 END AS v FROM (SELECT *, max(d) OVER (PARTITION BY media_id) AS most FROM d))""")
def em_compare_heat(spark, sf_dir):
    return preview.compare_heat(clips.embedding_clips(spark, sf_dir), 0, 1)


@query("em_auto_preview", f"""WITH e AS (SELECT media_id, y, x, r * 0.37e0 - 11 AS v FROM {EM} WHERE frame = 0), q AS (SELECT media_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM e GROUP BY media_id)
SELECT media_id, y, x, CAST(CASE WHEN hi <= lo THEN 0 ELSE floor(least(greatest((v - lo) * 255.0 / (hi - lo), 0), 255) + 1e-9) END AS INT) AS v FROM e JOIN q USING (media_id)""")
def em_auto_preview(spark, sf_dir):
    """Of a table with a time axis only the first slice is shown: that is the operator."""
    px = clips.embedding_clips(spark, sf_dir).select("media_id", "frame", "y", "x", (F.col("r") * 0.37 - 11).alias("v"))
    return preview.automatic(px, ["media_id"], ["v"])


_FIELD = f"SELECT frame, y, x, x - 31.3 + frame AS dx, y - 27.9 AS dy FROM {fx('motion')}"
_SCALED = f"SELECT *, CAST(floor(least(sqrt(dx * dx + dy * dy) * 255.0 / most, 255) + 1e-9) AS INT) AS m, floor((degrees(atan2(dy, dx)) + 360) % 360 / 2) * 2 AS h FROM (SELECT *, max(sqrt(dx * dx + dy * dy)) OVER (PARTITION BY frame) AS most FROM ({_FIELD}))"


@query("fx_flow_magnitude", f"SELECT frame, y, x, {_FIRE} FROM (SELECT frame, y, x, m AS v FROM ({_SCALED}))")
def fx_flow_magnitude(spark, sf_dir):
    return flow.magnitude_preview(_field(spark)).select("frame", "y", "x", "r", "g", "b")


@query("fx_flow_direction", _from_hsv_sql(f"SELECT frame, y, x, h, 1.0 AS s, m / 255.0 AS v FROM ({_SCALED})", "frame, y, x"))
def fx_flow_direction(spark, sf_dir):
    return flow.direction_preview(_field(spark)).select("frame", "y", "x", "r", "g", "b")


def _field(spark):
    """A closed-form field of vectors."""
    return CLIPS["motion"].pixels(spark).select("media_id", "frame", "y", "x", (F.col("x") - 31.3 + F.col("frame")).alias("dx"), (F.col("y") - 27.9).alias("dy"))


# frequency: sums of sines differ in the last place between engines


@query("fx_dft_peaks")
def fx_dft_peaks(spark, sf_dir):
    return frequency.temporal_peaks(frequency.series(CLIPS["blink"].pixels(spark), rect=(12, 12, 8, 8)), fps=30.0)


@query("fx_dft", f"""WITH s AS (SELECT frame, CAST(sum(299 * r + 587 * g + 114 * b) AS DOUBLE) / 1000 / count(*) AS v FROM {fx('blink')} WHERE x >= 12 AND x < 20 AND y >= 12 AND y < 20 GROUP BY frame),
c AS (SELECT frame, v - avg(v) OVER () AS v, count(*) OVER () AS n FROM s)
SELECT CAST(k AS INT) AS k, floor(sqrt(pow(sum(v * cos(2 * pi() * k * frame / n)), 2) + pow(sum(v * sin(2 * pi() * k * frame / n)), 2)) * 1000 + 0.5) AS magnitude_e3 FROM c, range(31) AS r(k) GROUP BY k""")
def fx_dft(spark, sf_dir):
    s = frequency.temporal_fft(frequency.series(CLIPS["blink"].pixels(spark), rect=(12, 12, 8, 8)))
    return s.select("k", F.floor(F.hypot("re", "im") * 1000 + 0.5).cast("double").alias("magnitude_e3"))


@query("em_temporal_fft")
def em_temporal_fft(spark, sf_dir):
    return frequency.temporal_fft(frequency.series(clips.embedding_clips(spark, sf_dir)))


@query("fx_stft")
def fx_stft(spark, sf_dir):
    return frequency.stft(frequency.series(CLIPS["basic"].pixels(spark)), "hann", 8, 4)


@query("fx_fft2")
def fx_fft2(spark, sf_dir):
    return frequency.spatial_peaks(frequency.spatial_fft(CLIPS["stripes8"].pixels(spark)))


@query("fx_pattern")
def fx_pattern(spark, sf_dir):
    return frequency.regular_pattern(CLIPS["stripes8"].pixels(spark))


# the same transforms from their definitions, to the digits that two engines share


def dft_sql(series: str) -> str:
    """(media_id, k, n, re, im) of series (media_id, frame, v) numbered from 0."""
    return f"""SELECT media_id, CAST(k AS INT) AS k, n, sum(v * cos(2 * pi() * ((k * frame) % n) / n)) AS re, -sum(v * sin(2 * pi() * ((k * frame) % n) / n)) AS im
FROM (SELECT media_id, frame, v - avg(v) OVER (PARTITION BY media_id) AS v, count(*) OVER (PARTITION BY media_id) AS n FROM ({series})), LATERAL (SELECT unnest(generate_series(0, n // 2)) AS k) GROUP BY ALL"""


def luma_sql(px: str) -> str:
    return f"SELECT media_id, frame, CAST(sum(299 * r + 587 * g + 114 * b) AS DOUBLE) / 1000 / count(*) AS v FROM {px} GROUP BY media_id, frame"


@query("em_dft", f"SELECT media_id, k, n AS samples, floor(k * 30.0 / n * 1e6 + 0.317) AS frequency_e6, floor(re * 1e4 + 0.317) AS re_e4, floor(im * 1e4 + 0.317) AS im_e4 FROM ({dft_sql(luma_sql(EM))}) WHERE k > 0 AND 2 * k < n")
def em_dft(spark, sf_dir):
    z = frequency.temporal_fft(frequency.series(clips.embedding_clips(spark, sf_dir))).where("k > 0 AND 2 * k < samples")
    return z.select("media_id", "k", F.col("samples").cast("bigint").alias("samples"), whole(F.col("frequency"), 6).alias("frequency_e6"), whole(F.col("re"), 4).alias("re_e4"), whole(F.col("im"), 4).alias("im_e4"))


@query("em_dft_peaks", f"""WITH z AS (SELECT media_id, k, n, sqrt(re * re + im * im) * CASE WHEN 2 * k = n THEN 0.5 ELSE 1 END AS m FROM ({dft_sql(luma_sql(EM))}) WHERE k > 0)
SELECT media_id, rank, floor(k * 30.0 / n * 1e6 + 0.317) AS frequency_e6, floor(n / (k * 30.0) * 1e6 + 0.317) AS period_e6, floor(m * 1e3 + 0.317) AS magnitude_e3, floor(ratio * 1e6 + 0.317) AS ratio_e6
FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY m DESC, k) AS rank, m / sum(m) OVER (PARTITION BY media_id) AS ratio FROM z) WHERE rank <= 5""")
def em_dft_peaks(spark, sf_dir):
    p = frequency.temporal_peaks(frequency.series(clips.embedding_clips(spark, sf_dir)))
    return p.select("media_id", F.col("rank").cast("bigint").alias("rank"), whole(F.col("frequency"), 6).alias("frequency_e6"), whole(F.col("period_seconds"), 6).alias("period_e6"), whole(F.col("magnitude"), 3).alias("magnitude_e3"), whole(F.col("peak_ratio"), 6).alias("ratio_e6"))


@query("fx_stft_hann", f"""SELECT media_id, CAST(i AS INT) AS "window", CAST(k AS INT) AS k, floor((i * 4 + 3.5) / 30 * 1e6 + 0.317) AS t_e6, floor(k * 30.0 / 8 * 1e6 + 0.317) AS frequency_e6,
floor(sqrt(pow(sum(v * w * cos(2 * pi() * k * j / 8)), 2) + pow(sum(v * w * sin(2 * pi() * k * j / 8)), 2)) * 1e4 + 0.317) AS magnitude_e4
FROM (SELECT media_id, i, j, v, 0.5 - 0.5 * cos(2 * pi() * j / 7) AS w FROM ({luma_sql(fx('noise'))}), range(9) AS a(i), range(8) AS c(j) WHERE frame = i * 4 + j), range(5) AS d(k) GROUP BY media_id, i, k""")
def fx_stft_hann(spark, sf_dir):
    z = frequency.stft(frequency.series(CLIPS["noise"].pixels(spark)), "hann", 8, 4)
    return z.select("media_id", "window", "k", whole(F.col("t"), 6).alias("t_e6"), whole(F.col("frequency"), 6).alias("frequency_e6"), whole(F.hypot("re", "im"), 4).alias("magnitude_e4"))


_STFT_LOG = f"""SELECT media_id, i, k, ln(1 + sqrt(pow(sum(v * w * cos(2 * pi() * k * j / 8)), 2) + pow(sum(v * w * sin(2 * pi() * k * j / 8)), 2))) AS m
FROM (SELECT media_id, i, j, v, 0.5 - 0.5 * cos(2 * pi() * j / 7) AS w FROM ({luma_sql(fx('noise'))}), range(9) AS a(i), range(8) AS c(j) WHERE frame = i * 4 + j), range(5) AS d(k) GROUP BY media_id, i, k"""


@query("fx_stft_preview", f"SELECT media_id, CAST(k AS INT) AS y, CAST(i AS INT) AS x, CAST(floor(m * 255.0 / max(m) OVER (PARTITION BY media_id) + 1e-9) AS INT) AS v FROM ({_STFT_LOG})")
def fx_stft_preview(spark, sf_dir):
    z = frequency.stft(frequency.series(CLIPS["noise"].pixels(spark)), "hann", 8, 4)
    return frequency.log_preview(z, ["media_id"], "k", "window")


def dft2_sql(px: str, n: int) -> str:
    """(v, u, re, im) of one n x n picture's luma without its mean, along x and then along y."""
    turn = lambda a, b: f"2 * pi() * ((({a}) * ({b})) % {n}) / {n}"
    return f"""SELECT v, u, sum(re * cos({turn('v', 'y')}) + im * sin({turn('v', 'y')})) AS re, sum(im * cos({turn('v', 'y')}) - re * sin({turn('v', 'y')})) AS im
FROM (SELECT y, u, sum(g * cos({turn('u', 'x')})) AS re, -sum(g * sin({turn('u', 'x')})) AS im
  FROM (SELECT y, x, g - avg(g) OVER () AS g FROM (SELECT y, x, (299 * r + 587 * g + 114 * b) / 1000.0 AS g FROM {px})), range(-{n // 2}, {n // 2}) AS a(u) GROUP BY y, u), range(-{n // 2}, {n // 2}) AS c(v) GROUP BY v, u"""


@query("fx_fft2_peaks", f"""WITH z AS (SELECT u, v, sqrt(re * re + im * im) AS m FROM ({dft2_sql(fx('image16'), 16)}) WHERE NOT (abs(u) <= 2 AND abs(v) <= 2) AND (v < 0 AND v > -8 OR v IN (0, -8) AND (u >= 0 OR u = -8)))
SELECT CAST(rank AS BIGINT) AS rank, CAST(u AS INT) AS u, CAST(v AS INT) AS v, floor(16 / sqrt(u * u + v * v) * 1e6 + 0.317) AS period_e6, floor(m * 1e2 + 0.317) AS magnitude_e2
FROM (SELECT *, row_number() OVER (ORDER BY m DESC, v, u) AS rank FROM z WHERE m >= (SELECT max(m) FROM z) * 1e-6) WHERE rank <= 5""")
def fx_fft2_peaks(spark, sf_dir):
    p = frequency.spatial_peaks(frequency.spatial_fft(CLIPS["image16"].pixels(spark)))
    return p.select(F.col("rank").cast("bigint").alias("rank"), "u", "v", whole(F.col("period_px"), 6).alias("period_e6"), whole(F.col("magnitude"), 2).alias("magnitude_e2"))


@query("fx_fft2_preview", f"SELECT CAST(v + 8 AS INT) AS y, CAST(u + 8 AS INT) AS x, CAST(floor(m * 255.0 / max(m) OVER () + 1e-6) AS INT) AS v FROM (SELECT u, v, ln(1 + sqrt(re * re + im * im)) AS m FROM ({dft2_sql(fx('image16'), 16)}))")
def fx_fft2_preview(spark, sf_dir):
    z = frequency.spatial_fft(CLIPS["image16"].pixels(spark)).withColumn("y", F.col("v") + 8).withColumn("x", F.col("u") + 8)
    return frequency.log_preview(z, ["media_id", "frame"], "y", "x").select("y", "x", "v")
