"""The façade: nine tools with limits and paging over the operators. A transport can wrap each method."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import fail, require
from .functions import color
from .operators import aggregate, change, lookup, sampling, selection
from .plans import bundle, engine
from .plans.request import load

# Limits of the tools.
LIMITS = {"inspect_frames": 1800, "change_frames": 3600, "grid_points": 65_536, "points": 256, "page": 200, "values": 4096, "characters": 25_000}


class Toolbox:
    """Tools over named media: id -> (pixels, width, height)."""

    def __init__(self, spark: SparkSession, media: dict[str, tuple[DataFrame, int, int]], roots: tuple[str, ...] = ()):
        self.spark, self.media, self.roots = spark, media, tuple(map(os.path.realpath, roots))
        self.registry = engine.default_registry()

    def _of(self, media_id: str):
        if media_id not in self.media:
            raise fail("FILE_NOT_FOUND", f"no medium {media_id}")
        return self.media[media_id]

    def allowed(self, path: str) -> str:
        """A path under one of the roots, links resolved."""
        p = os.path.realpath(path)
        require(any(p == r or p.startswith(r + os.sep) for r in self.roots), "BUNDLE_PATH_UNSAFE", "the path is outside the allowed folders")
        return p

    def _page(self, df: DataFrame, order: list, offset: int, limit: int) -> dict:
        require(limit <= LIMITS["page"], "INVALID_RANGE", f"a page holds {LIMITS['page']} rows at most")
        rows, info = lookup.page(df, order, offset, limit)
        return info | {"items": [r.asDict(recursive=True) for r in rows.collect()]}

    def _stride(self, px: DataFrame, most: int) -> int:
        n = px.agg(F.max("frame")).first()[0]
        return max(1, -(-(n + 1) // most)) if n is not None else 1

    def get_capabilities(self) -> dict:
        have = {}
        for name, module in (("video", "av"), ("flow", "cv2")):
            try:
                __import__(module)
                have[name] = True
            except ImportError:
                have[name] = False
        return {"operators": self.registry.names(), "limits": LIMITS, "optional": have, "media": sorted(self.media)}

    def inspect_media(self, media_id: str, offset: int = 0, limit: int = 100, picks: int = 9) -> dict:
        """Size, frames, timing, anomalies and picks of one medium in one pass of each aggregate."""
        px, w, h = self._of(media_id)
        stride = self._stride(px, LIMITS["inspect_frames"])
        chosen = px.where(F.col("frame") % stride == 0) if stride > 1 else px
        ft = chosen.groupBy("media_id", "frame").agg(F.min("t").alias("t"))
        info = ft.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("end"), F.min("frame").alias("a"), F.max("frame").alias("z")).first()
        vfr = change.irregular(ft).first()["irregular"]
        found = self._page(change.anomalies(chosen), ["ordinal"], offset, limit)
        return {"width": w, "height": h, "frames": info["n"], "stride": stride, "end": info["end"], "irregular": vfr, "picks": selection.picks(info["a"], info["z"], picks), "anomalies": found}

    def get_frame(self, media_id: str, frame: int | None = None, time: float | None = None, crop=None) -> DataFrame:
        require(frame is None or time is None, "INVALID_RANGE", "frame or time, not both")
        px, w, h = self._of(media_id)
        if time is not None:
            require(time >= 0, "TIME_OUT_OF_RANGE", "time is not negative")
            probe = self.spark.createDataFrame([(0, float(time))], "probe_id long, at double")
            ft = px.groupBy("media_id", "frame").agg(F.min("t").alias("t"))
            frame = lookup.as_of(ft, ft.select("media_id").distinct().crossJoin(F.broadcast(probe))).first()["frame"]
        out = px.where(F.col("frame") == (frame or 0))
        if out.isEmpty():
            raise fail("FRAME_OUT_OF_RANGE", f"no frame {frame}")
        return sampling.crop(out, sampling.check_rect(crop, w, h)) if crop else out

    def read_pixels(self, media_id: str, points, frame: int = 0) -> list[dict]:
        require(0 < len(points) <= LIMITS["points"], "INVALID_RANGE", f"1 to {LIMITS['points']} points")
        px, w, h = self._of(media_id)
        for x, y in points:
            sampling.check_point(x, y, w, h)
        got = sampling.points_t(px.where(F.col("frame") == frame), sampling.point_table(self.spark, points), w, h)
        c = [F.col(k) for k in "rgb"]
        got = got.select("k", *c, color.hex_code(*c).alias("hex"), color.hsv(*c).alias("hsv"), color.lab(*c).alias("lab"), color.luminance(*c).alias("luminance"), color.linear_luminance(*c).alias("luminance_linear"))
        out = []
        for r in got.orderBy("k").collect():
            d = r.asDict(recursive=True)
            x, y = points[d.pop("k")]
            rounded = {k: {a: round(b, 2) for a, b in v.items()} if isinstance(v, dict) else round(v, 2) if isinstance(v, float) else v for k, v in d.items()}
            out.append({"x": x, "y": y, "pixel_id": y * w + x} | rounded)
        return out

    def analyze_region(self, media_id: str, rect, frame: int = 0) -> dict:
        px, w, h = self._of(media_id)
        r = aggregate.region_stats(px.where(F.col("frame") == frame), sampling.check_rect(rect, w, h)).first()
        if r is None:
            raise fail("FRAME_OUT_OF_RANGE", f"no frame {frame}")
        return {k: round(v, 2) if isinstance(v, float) else v for k, v in r.asDict().items()}

    def find_changes(self, media_id: str, point=None, rect=None, step=None, sort: str = "timeline", offset: int = 0, limit: int = 100) -> dict:
        require(sort in ("timeline", "score"), "INVALID_RANGE", "sort is timeline or score")
        px, w, h = self._of(media_id)
        if step:
            x, y, rw, rh = rect or (0, 0, w, h)
            require((-(-rw // step)) * (-(-rh // step)) <= LIMITS["grid_points"], "RESOURCE_PLAN_UNSATISFIABLE", "too many grid points")
        stride = self._stride(px, LIMITS["change_frames"])
        scores = change.change_scores(px.where(F.col("frame") % stride == 0) if stride > 1 else px, point, rect, step)
        order = ["frame"] if sort == "timeline" else [F.desc("score"), "frame"]
        return self._page(scores, order, offset, limit) | {"events": [r.asDict() for r in change.events(scores).orderBy("event").limit(LIMITS["page"]).collect()]}

    def generate_representation(self, requests) -> list[DataFrame]:
        return engine.generate(load(requests), self.media, self.registry)

    def list_artifacts(self, path: str, offset: int = 0, limit: int = 100) -> dict:
        items = sorted(bundle.manifest(self.allowed(path))["artifacts"], key=lambda a: a["id"])
        more = offset + limit < len(items)
        return {"total": len(items), "has_more": more, "next_offset": offset + limit if more else None, "items": [{k: a[k] for k in ("id", "role", "uri")} for a in items[offset : offset + limit]]}

    def read_artifact(self, path: str, artifact: str, columns=None, limit: int = 256) -> list[dict]:
        df = bundle.read(self.spark, self.allowed(path), artifact)
        df = df.select(*columns) if columns else df
        require(limit * len(df.columns) <= LIMITS["values"], "MATERIALIZATION_LIMIT_EXCEEDED", f"{LIMITS['values']} values at most")
        return [r.asDict(recursive=True) for r in df.limit(limit).collect()]
