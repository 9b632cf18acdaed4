"""Coded errors. A code is stable; an exit code is for command-line callers."""

from __future__ import annotations


class FramewellError(ValueError):
    code = "FRAMEWELL_ERROR"
    exit_code = 1

    def __init__(self, message: str, *, hint: str | None = None):
        super().__init__(message)
        self.message, self.hint = message, hint

    def to_dict(self) -> dict:
        return {"code": self.code, "message": self.message} | ({"hint": self.hint} if self.hint else {})


# The codes and exit codes that callers rely on.
_CODES = {
    "FILE_NOT_FOUND": 3,
    "UNSUPPORTED_MEDIA": 4,
    "DECODE_FAILED": 7,
    "COORDINATE_OUT_OF_RANGE": 5,
    "FRAME_OUT_OF_RANGE": 6,
    "TIME_OUT_OF_RANGE": 6,
    "INVALID_RANGE": 2,
    "OUTPUT_WRITE_FAILED": 8,
    "DEPENDENCY_MISSING": 1,
    "AXIS_SHAPE_MISMATCH": 2,
    "CHANNEL_COUNT_MISMATCH": 2,
    "ARRAY_SELECTION_OUT_OF_RANGE": 5,
    "MATERIALIZATION_LIMIT_EXCEEDED": 1,
    "SCHEMA_VERSION_UNSUPPORTED": 2,
    "MODEL_VALIDATION_FAILED": 2,
    "TIME_SELECTION_INVALID": 2,
    "TIMESTAMP_MISSING": 6,
    "ARTIFACT_IDENTITY_MISMATCH": 1,
    "MEDIA_CHANGED_DURING_ANALYSIS": 1,
    "RESOURCE_PLAN_UNSATISFIABLE": 1,
    "CHECKPOINT_INCOMPATIBLE": 1,
    "EXECUTION_CANCELLED": 130,
    "EXECUTION_TIMEOUT": 1,
    "CACHE_ENTRY_CORRUPT": 1,
    "OPERATOR_NOT_REGISTERED": 2,
    "OPERATOR_CONFIG_INVALID": 2,
    "OPERATOR_TYPE_MISMATCH": 2,
    "BUNDLE_TARGET_EXISTS": 8,
    "BUNDLE_WRITE_FAILED": 8,
    "BUNDLE_MANIFEST_MISSING": 3,
    "BUNDLE_MANIFEST_INVALID": 2,
    "BUNDLE_SCHEMA_UNSUPPORTED": 2,
    "BUNDLE_PATH_UNSAFE": 2,
    "ARTIFACT_FILE_MISSING": 3,
    "ARTIFACT_CHECKSUM_MISMATCH": 1,
    "ARTIFACT_SCHEMA_MISMATCH": 2,
    "PROVENANCE_GRAPH_INVALID": 2,
}

ERRORS: dict[str, type[FramewellError]] = {
    code: type("".join(w.title() for w in code.split("_")) + "Error", (FramewellError,), {"code": code, "exit_code": status})
    for code, status in _CODES.items()
}


def fail(code: str, message: str, hint: str | None = None) -> FramewellError:
    """The error of that code, to be raised."""
    return ERRORS[code](message, hint=hint)


def require(ok: bool, code: str, message: str) -> None:
    if not ok:
        raise fail(code, message)
