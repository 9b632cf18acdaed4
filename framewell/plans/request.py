"""Requests: what to compute, as checked, hashable values."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, fields, replace

from ..errors import fail, require
from ..operators.aggregate import REDUCTIONS
from ..operators.selection import Selection

# Representations with the geometries that each takes.
REPRESENTATIONS = {"frames": (), "xt": ("line", "polyline"), "yt": ("line", "polyline"), "points_t": ("point", "line", "polyline"), "path_t": ("line", "polyline", "curve"), "roi_t": ("rect",), "feature_t": ()}
FORMATS = ("memory", "npy", "parquet", "bundle")
POLICIES = ("safe", "standard", "full")


def canonical(value) -> str:
    """Compact JSON with sorted keys; NaN is refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


@dataclass(frozen=True)
class Source:
    source_id: str
    uri: str = ""
    kind: str = "file"


@dataclass(frozen=True)
class Geometry:
    type: str
    points: tuple[tuple[float, float], ...] = ()
    rect: tuple[int, int, int, int] | None = None


@dataclass(frozen=True)
class Feature:
    name: str = "rgb"
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Reduction:
    name: str
    axes: tuple[str, ...] = ("time",)
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Output:
    format: str = "memory"
    include_preview: bool = True
    preview_config: dict = field(default_factory=dict)
    metadata_policy: str = "safe"


@dataclass(frozen=True)
class Resources:
    max_memory_bytes: int | None = 268_435_456
    max_temp_bytes: int | None = None
    timeout_seconds: float | None = None
    allow_spill: bool = True


def strictest(policies: list[Resources]) -> Resources:
    """The least of the set limits; what one forbids is forbidden."""
    out = {}
    for f in fields(Resources):
        have = [v for p in policies if (v := getattr(p, f.name)) is not None]
        out[f.name] = (all(have) if isinstance(have[0], bool) else min(have)) if have else None
    return Resources(**out)


@dataclass(frozen=True)
class Request:
    source: Source
    selection: Selection = Selection()
    representation: str = "frames"
    geometry: Geometry | None = None
    feature: Feature = Feature()
    reduction: Reduction | None = None
    output: Output = Output()
    resources: Resources = Resources()
    schema_version: str = "0.1.0"

    def __post_init__(self):
        bad = lambda ok, why: require(ok, "MODEL_VALIDATION_FAILED", why)
        bad(self.schema_version.startswith("0."), "unknown schema version")
        bad(self.source.kind == "file", "the engine reads files only")
        bad(self.representation in REPRESENTATIONS, f"unknown representation {self.representation}")
        kinds = REPRESENTATIONS[self.representation]
        if kinds:
            bad(self.geometry is not None and self.geometry.type in kinds, f"{self.representation} needs one of {', '.join(kinds)}")
        else:
            bad(self.geometry is None, f"{self.representation} takes no geometry")
        for name, k in (("xt", 1), ("yt", 0)):
            if self.representation == name:
                bad(len({p[k] for p in self.geometry.points}) == 1, f"{name} needs a {'horizontal' if k else 'vertical'} line")
        if self.reduction:
            r, p = self.reduction, self.reduction.config.get("percentile")
            bad(r.name in REDUCTIONS and r.axes == ("time",), "reductions are over time")
            bad((r.name == "percentile") == (p is not None) and (p is None or 0 <= float(p) <= 100), "percentile, 0 to 100, belongs to the percentile reduction alone")
            bad(not (self.representation == "roi_t" and r.name == "diff"), "a region's reduction within a frame can't be diff")
        bad(self.representation != "roi_t" or self.reduction is not None, "roi_t needs a reduction")
        bad(self.output.format in FORMATS and self.output.metadata_policy in POLICIES, "unknown output format or metadata policy")


def load(text: str | dict, source: Source | None = None) -> list[Request]:
    """Requests from JSON: one object or a list; unknown fields are refused. ``source`` replaces theirs."""
    data = json.loads(text) if isinstance(text, str) else text

    def build(kind, d):
        extra = set(d) - {f.name for f in fields(kind)}
        if extra:
            raise fail("MODEL_VALIDATION_FAILED", f"unknown fields {', '.join(sorted(extra))}")
        return kind(**d)

    out = []
    for d in data if isinstance(data, list) else [data]:
        d = dict(d)
        parts = {"source": Source, "selection": Selection, "geometry": Geometry, "feature": Feature, "reduction": Reduction, "output": Output, "resources": Resources}
        for name, kind in parts.items():
            if isinstance(d.get(name), dict):
                own = {k: _tuples(v) if k in ("points", "rect", "indices", "axes") else v for k, v in d[name].items()}
                d[name] = build(kind, own)
        if source is not None:
            d["source"] = source
        out.append(build(Request, d))
    return out


def _tuples(v):
    return tuple(_tuples(x) for x in v) if isinstance(v, list | tuple) else v


def as_json(request: Request) -> dict:
    return asdict(request)


__all__ = ["Feature", "Geometry", "Output", "Reduction", "Request", "Resources", "Selection", "Source", "as_json", "canonical", "digest", "load", "replace", "strictest"]
