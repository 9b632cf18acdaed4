"""From requests to lazy DataFrames.

A request becomes a chain of nodes named by their content; equal nodes of several requests
are one node and one DataFrame. Nothing runs until a result is read; ``explain`` shows the
nodes and Spark's plan. Operators are functions from DataFrame to DataFrame in a registry
that callers can add to.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import fail, require
from ..functions import color
from ..operators import aggregate, change, flow, frequency, sampling, selection
from .request import Request, as_json, digest

#: Version of what the nodes mean; part of their names.
SEMANTICS = "1"
Runtime = Callable[[DataFrame, dict], DataFrame]


@dataclass(frozen=True)
class Spec:
    """An operator: how to run it, the options it takes with defaults, and what holds of its results."""

    name: str
    run: Runtime
    options: dict = field(default_factory=dict)
    determinism: str = "bit_exact"
    stateful: bool = False
    check: Callable[[dict], None] | None = None


class Registry:
    def __init__(self):
        self._specs: dict[str, Spec] = {}

    def register(self, spec: Spec, replace: bool = False) -> None:
        require(replace or spec.name not in self._specs, "OPERATOR_CONFIG_INVALID", f"{spec.name} is registered")
        self._specs[spec.name] = spec

    def resolve(self, name: str) -> Spec:
        if name not in self._specs:
            raise fail("OPERATOR_NOT_REGISTERED", f"no operator {name}")
        return self._specs[name]

    def config(self, name: str, given: dict) -> dict:
        spec = self.resolve(name)
        extra = set(given) - set(spec.options)
        require(not extra, "OPERATOR_CONFIG_INVALID", f"{name} has no option {', '.join(sorted(extra))}")
        out = spec.options | given
        missing = [k for k, v in out.items() if v is ...]
        require(not missing, "OPERATOR_CONFIG_INVALID", f"{name} needs {', '.join(missing)}")
        if spec.check:
            spec.check(out)
        return out

    def names(self) -> list[str]:
        return sorted(self._specs)


@dataclass(frozen=True)
class Node:
    id: str
    kind: str
    operator: str
    config: dict = field(hash=False)
    inputs: tuple[str, ...] = ()


class Graph:
    """Nodes by content; adding an equal node returns the one that is there."""

    def __init__(self):
        self.nodes: dict[str, Node] = {}

    def add(self, kind: str, operator: str, config: dict, *inputs: str) -> str:
        for i in inputs:
            require(i in self.nodes, "PROVENANCE_GRAPH_INVALID", f"no node {i}")
        name = digest([SEMANTICS, kind, operator, config, inputs])
        self.nodes.setdefault(name, Node(name, kind, operator, config, inputs))
        return name

    def order(self) -> list[Node]:
        """Inputs first; a cycle or a missing input is an error."""
        out, state = [], {}

        def visit(i):
            require(i in self.nodes and state.get(i) != 1, "PROVENANCE_GRAPH_INVALID", f"missing or circular input {i}")
            if i not in state:
                state[i] = 1
                for k in self.nodes[i].inputs:
                    visit(k)
                state[i] = 2
                out.append(self.nodes[i])

        for i in self.nodes:
            visit(i)
        return out


def _sample(px: DataFrame, c: dict) -> DataFrame:
    kind, g = c["representation"], c["geometry"]
    width, height = c["width"], c["height"]
    if kind in ("frames", "feature_t"):
        return px
    if kind == "xt":
        y = int(g["points"][0][1])
        require(0 <= y < height, "COORDINATE_OUT_OF_RANGE", "the line leaves the frame")
        return sampling.xt(px, y)
    if kind == "yt":
        x = int(g["points"][0][0])
        require(0 <= x < width, "COORDINATE_OUT_OF_RANGE", "the line leaves the frame")
        return sampling.yt(px, x)
    if kind == "points_t":
        return sampling.points_t(px, sampling.point_table(px.sparkSession, g["points"]), width, height, c["interpolation"], c["block_size"], c["boundary"])
    if kind == "path_t":
        return sampling.path_t(px, g["points"], width, height, c["sample_count"] or len(g["points"]), c["interpolation"], c["boundary"])
    rect = sampling.check_rect(tuple(g["rect"]), width, height)
    return aggregate.roi_t(px, rect, c["reduction"], c["percentile"])


def _reduce(px: DataFrame, c: dict) -> DataFrame:
    """Over time; any sampled table with a frame column, by its other coordinates."""
    at = [k for k in ("media_id", "y", "x", "k") if k in px.columns]
    if at == ["media_id", "y", "x"]:
        return aggregate.over_time(px, c["name"], tuple(c["rect"]) if c["rect"] else None, c["percentile"])
    if c["name"] == "diff":
        from pyspark.sql import Window

        w = Window.partitionBy(*at).orderBy("frame")
        steps = px.select(*at, *[F.abs(F.col(k) - F.lag(k).over(w)).alias(k) for k in sampling.CHANNELS]).where(F.col("r").isNotNull())
        return steps.groupBy(*at).agg(*[F.avg(k).alias(k) for k in sampling.CHANNELS])
    return aggregate.reduce_by(px, at, c["name"], percentile=c["percentile"])


def _gray(px, c):
    weights = tuple(c["weights"])
    require(abs(sum(weights) - 1) <= 1e-6 and len(weights) == 3, "OPERATOR_CONFIG_INVALID", "three weights that sum to 1")
    return px.select(*[k for k in px.columns if k not in sampling.CHANNELS], color.weighted(F.col("r"), F.col("g"), F.col("b"), weights).alias("v"))


def _struct(f):
    return lambda px, c: px.withColumn("_c", f(F.col("r"), F.col("g"), F.col("b"))).select(*[k for k in px.columns if k not in sampling.CHANNELS], "_c.*")


def _fft(px, c):
    return frequency.temporal_fft(frequency.series(px, c["source"], c["rect"], c["point"]), c["vfr_policy"] == "estimate")


def _flow(px, c):
    """Farneback flow over pixels packed as gray frames."""
    frames = px.groupBy("media_id", "frame").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.array_sort(F.collect_list(F.struct("y", "x", F.rint(color.luma601(F.col("r"), F.col("g"), F.col("b"))).cast("int").alias("v")))).alias("p"))
    frames = frames.select("media_id", "frame", "height", "width", F.unhex(F.array_join(F.transform("p", lambda q: F.lpad(F.hex(q["v"]), 2, "0")), "")).alias("data"))
    out = flow.farneback(frames, c["accumulate"])
    return flow.compensate(out, flow.global_motion(out)) if c["compensate_global"] else out


def default_registry() -> Registry:
    r = Registry()
    for name in ("frames", "xt", "yt", "points_t", "path_t", "roi_t", "feature_t"):
        r.register(Spec(f"sample.{name}", _sample, {"representation": name, "geometry": None, "width": ..., "height": ..., "interpolation": "bilinear" if name == "path_t" else "nearest", "block_size": 1, "boundary": "error", "sample_count": None, "reduction": None, "percentile": None}, "tolerance"))
    for name in ("diff", "frame_difference"):
        r.register(Spec(f"feature.{name}", lambda px, c: change.differences(px, c["divide_by_delta_time"]), {"divide_by_delta_time": False}, stateful=True))
    r.register(Spec("feature.grayscale", _gray, {"weights": color.BT601}, "tolerance"))
    r.register(Spec("feature.hsv", _struct(lambda a, b, c: color.hsv(a, b, c, 1.0)), {}, "tolerance"))
    r.register(Spec("feature.lab", _struct(color.lab), {}, "tolerance"))
    series = {"source": "luma", "rect": None, "point": None, "vfr_policy": "error"}
    r.register(Spec("feature.temporal_fft", _fft, series, "tolerance"))
    r.register(Spec("feature.spatial_fft", lambda px, c: frequency.spatial_fft(px, c["rect"]), {"rect": None}, "tolerance"))
    r.register(Spec("feature.stft", lambda px, c: frequency.stft(frequency.series(px, c["source"], c["rect"], c["point"]), c["window"], c["length"], c["hop"], c["padding"], c["normalization"]), series | dict.fromkeys(("window", "length", "hop", "padding", "normalization"), ...), "tolerance"))
    for name in ("flow", "farneback"):
        r.register(Spec(f"feature.{name}", _flow, {"accumulate": False, "compensate_global": False, "mag_threshold": 1.0, "frame_pair": None}, "tolerance", True))
    for name in aggregate.REDUCTIONS:
        r.register(Spec(f"reduce.{name}", _reduce, {"name": name, "rect": None, "percentile": None}, "tolerance", True))
    return r


@dataclass
class Plan:
    graph: Graph
    outputs: list[str]
    frames: dict[str, DataFrame]

    @property
    def plan_id(self) -> str:
        return digest([sorted(self.graph.nodes), self.outputs])

    @property
    def decode_nodes(self) -> int:
        return sum(n.kind == "decode" for n in self.graph.nodes.values())

    def explain(self) -> str:
        lines = [f"{n.id[:12]} {n.kind} {n.operator} <- {', '.join(i[:12] for i in n.inputs) or 'nothing'}" for n in self.graph.order()]
        for o in self.outputs:
            lines.append(self.frames[o]._jdf.queryExecution().explainString(self.frames[o].sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return "\n".join(lines)


def plan(requests: list[Request], media: dict[str, tuple[DataFrame, int, int]], registry: Registry | None = None) -> Plan:
    """Compile requests over ``media``: source id -> (pixels, width, height)."""
    registry = registry or default_registry()
    graph, outputs, frames = Graph(), [], {}

    def add(kind, operator, config, make, *inputs):
        node = graph.add(kind, operator, config, *inputs)
        if node not in frames:
            frames[node] = make()
        return node

    for r in requests:
        if r.source.source_id not in media:
            raise fail("FILE_NOT_FOUND", f"no medium {r.source.source_id}")
        px, width, height = media[r.source.source_id]
        d = as_json(r)
        at = add("source", "media.source", d["source"], lambda px=px: px)
        at = add("decode", "media.decode.rgb24", {}, lambda px=px: px, at)
        at = add("select", "media.select", d["selection"], lambda i=at, r=r: selection.select(frames[i], r.selection), at)
        roi = r.representation == "roi_t"
        own = {"geometry": d["geometry"], "width": width, "height": height}
        own |= {k: v for k, v in r.feature.config.items() if k in ("interpolation", "block_size", "boundary", "sample_count")}
        if roi:
            own |= {"reduction": r.reduction.name, "percentile": r.reduction.config.get("percentile")}
        name = f"sample.{r.representation}"
        config = registry.config(name, own)
        at = add("sample", name, config, lambda i=at, n=name, c=config: registry.resolve(n).run(frames[i], c), at)
        if r.feature.name != "rgb":
            name = f"feature.{r.feature.name}"
            config = registry.config(name, {k: v for k, v in r.feature.config.items() if k not in ("interpolation", "block_size", "boundary", "sample_count")})
            at = add("transform", name, config, lambda i=at, n=name, c=config: registry.resolve(n).run(frames[i], c), at)
        if r.reduction and not roi:
            name = f"reduce.{r.reduction.name}"
            config = registry.config(name, dict(r.reduction.config))
            at = add("reduce", name, config, lambda i=at, n=name, c=config: registry.resolve(n).run(frames[i], c), at)
        outputs.append(at)
    return Plan(graph, outputs, frames)


def generate(requests: list[Request], media: dict[str, tuple[DataFrame, int, int]], registry: Registry | None = None, cache: Cache | None = None) -> list[DataFrame]:
    """A lazy result for each request; with a cache, results are stored tables that equal requests share."""
    p = plan(requests, media, registry)
    if cache is None:
        return [p.frames[o] for o in p.outputs]
    return [cache.table(o, p.frames[o]) for o in p.outputs]


class Cache:
    """Result tables by the content of their node. A damaged entry is set aside and made anew."""

    def __init__(self, folder: str):
        self.folder = folder

    def path(self, key: str) -> str:
        return f"{self.folder}/{key[:2]}/{key}"

    def table(self, key: str, df: DataFrame) -> DataFrame:
        spark, at = df.sparkSession, self.path(key)
        fs = spark._jvm.org.apache.hadoop.fs
        p = fs.Path(at)
        io = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if io.exists(p):
            if io.exists(fs.Path(f"{at}/_SUCCESS")):
                return spark.read.parquet(at)
            io.rename(p, fs.Path(f"{at}.damaged-{uuid.uuid4().hex[:8]}"))
        df.write.parquet(at)
        return spark.read.parquet(at)

    def clear(self) -> None:
        if os.path.isdir(self.folder):
            shutil.rmtree(self.folder)
