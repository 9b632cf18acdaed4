"""Verifiable bundles: result tables with a manifest of digests, committed by one rename."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from ..errors import fail, require
from .request import Request, as_json, canonical, digest

SCHEMA = "0.1.0"
#: Largest manifest that is read.
MOST = 16 << 20
_LOCAL_PATH = re.compile(r"(?:[A-Za-z]:\\|/)(?:[^\s\"',;/\\]+[/\\])+[^\s\"',;/\\]*")


def redact(value, policy: str = "safe"):
    """Paths in texts, at any depth and inside embedded JSON, become their last part; ``full`` keeps them."""
    if policy == "full":
        return value
    if isinstance(value, dict):
        return {k: redact(v, policy) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [redact(v, policy) for v in value]
    if isinstance(value, str):
        if value[:1] in "{[":
            try:
                return canonical(redact(json.loads(value), policy))
            except ValueError:
                pass
        return _LOCAL_PATH.sub(lambda m: re.split(r"[/\\]", m[0].rstrip("/\\"))[-1], value)
    return value


def safe_join(root: str, uri: str) -> str:
    """A stored relative path under ``root``; absolute, parent or linked-out paths are refused."""
    out = os.path.realpath(os.path.join(root, uri))
    ok = uri and not os.path.isabs(uri) and ".." not in re.split(r"[/\\]", uri) and out.startswith(os.path.realpath(root) + os.sep)
    require(bool(ok), "BUNDLE_PATH_UNSAFE", f"{uri!r} leaves the bundle")
    return out


def file_digests(root: str) -> dict[str, str]:
    out = {}
    for d, _, names in os.walk(root):
        for n in names:
            if n.endswith(".crc"):
                continue
            p = os.path.join(d, n)
            h = hashlib.sha256()
            with open(p, "rb") as f:
                while block := f.read(1 << 20):
                    h.update(block)
            out[os.path.relpath(p, root).replace(os.sep, "/")] = h.hexdigest()
    return dict(sorted(out.items()))


def write(target: str, requests: list[Request], results: list[DataFrame], policy: str = "safe") -> str:
    """Write results as Parquet with a manifest; the bundle appears whole, or not at all, and is verified first."""
    if os.path.exists(target):
        raise fail("BUNDLE_TARGET_EXISTS", f"{target} exists")
    stage = f"{target}.{uuid.uuid4().hex[:8]}.part"
    try:
        artifacts = []
        for k, (r, df) in enumerate(zip(requests, results, strict=True)):
            uri = f"data/{k:04d}-{r.representation}"
            df.write.parquet(f"file://{os.path.abspath(stage)}/{uri}")
            files = file_digests(os.path.join(stage, uri))
            artifacts.append({"id": f"artifact-{k:04d}", "role": "data", "uri": uri, "schema": json.loads(df.schema.json()), "files": files, "sha256": digest(files), "request": k})
        manifest = {"schema_version": SCHEMA, "id": uuid.uuid4().hex, "created_at": datetime.now(timezone.utc).isoformat(), "requests": redact([as_json(r) for r in requests], policy), "artifacts": artifacts, "warnings": []}
        with open(os.path.join(stage, "manifest.json"), "w", encoding="utf-8") as f:
            json.dump(manifest, f, ensure_ascii=False, sort_keys=True)
        problems = validate(stage)
        require(not problems, "BUNDLE_WRITE_FAILED", "; ".join(problems))
        os.rename(stage, target)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return target


def manifest(root: str) -> dict:
    p = os.path.join(root, "manifest.json")
    if not os.path.exists(p):
        raise fail("BUNDLE_MANIFEST_MISSING", f"{p} is missing")
    require(os.path.getsize(p) <= MOST, "BUNDLE_MANIFEST_INVALID", "the manifest is too large")
    try:
        with open(p, encoding="utf-8") as f:
            m = json.load(f)
        m["artifacts"], m["requests"]
    except (ValueError, KeyError, TypeError) as e:
        raise fail("BUNDLE_MANIFEST_INVALID", str(e)) from e
    require(str(m.get("schema_version", "")).split(".")[0] == "0", "BUNDLE_SCHEMA_UNSUPPORTED", "unknown schema version")
    return m


def validate(root: str, full: bool = True, strict: bool = False) -> list[str]:
    """Problems of a bundle; ``full`` reads every file, ``strict`` counts unknown fields."""
    m, out = manifest(root), []
    known = {"schema_version", "id", "created_at", "requests", "artifacts", "warnings"}
    if strict and set(m) - known:
        out.append(f"unknown fields {', '.join(sorted(set(m) - known))}")
    seen = set()
    for a in m["artifacts"]:
        if a["id"] in seen:
            out.append(f"{a['id']} stands twice")
        seen.add(a["id"])
        if not 0 <= a["request"] < len(m["requests"]):
            out.append(f"{a['id']} names no request")
        if digest(a["files"]) != a["sha256"]:
            out.append(f"{a['id']}: its list of files was changed")
        at = safe_join(root, a["uri"])
        for name, want in a["files"].items():
            p = safe_join(at, name)
            if not os.path.exists(p):
                out.append(f"{a['id']}: {name} is missing")
            elif full and file_digests_one(p) != want:
                out.append(f"{a['id']}: {name} was changed")
    return out


def file_digests_one(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def read(spark: SparkSession, root: str, artifact: str) -> DataFrame:
    """The table of an artifact, after its files were verified."""
    m = manifest(root)
    a = next((a for a in m["artifacts"] if a["id"] == artifact), None)
    if a is None:
        raise fail("ARTIFACT_FILE_MISSING", f"no artifact {artifact}")
    at = safe_join(root, a["uri"])
    for name, want in a["files"].items():
        p = safe_join(at, name)
        require(os.path.exists(p), "ARTIFACT_FILE_MISSING", f"{name} is missing")
        require(file_digests_one(p) == want, "ARTIFACT_CHECKSUM_MISMATCH", f"{name} was changed")
    df = spark.read.parquet(f"file://{at}")
    require(df.columns == [f["name"] for f in a["schema"]["fields"]], "ARTIFACT_SCHEMA_MISMATCH", "columns differ from the manifest's")
    return df
