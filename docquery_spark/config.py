"""Settings: defaults, overridden key by key by a JSON file; and keys of the environment or of a .env file."""

from __future__ import annotations

import copy
import json
import os
from pathlib import Path
from typing import Any

DEFAULTS = {
    "pipeline": {"max_context_chunks": 8, "extra_figures": 3, "embedder_dimensions": 64, "links": False},
    "validation": {
        "confidence_floor": 0.25, "retry_below": 0.5, "enable_checkpoint_a": True, "enable_checkpoint_b": True, "fail_open": True,
        "answer_mode": "structured",
    },
    "models": {
        "extractor": "rules", "embedder": "hashed-words", "generator": "extractive", "chunk_judge": "lexical", "answer_judge": "lexical",
        "server": {"url": "", "key": ""},
    },
}


def merge(base: dict, over: dict) -> dict:
    """Nested dictionaries merged; neither argument is changed."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


class Settings:
    """Settings of a file; a missing or unreadable one leaves the defaults and says why in ``problem``."""

    def __init__(self, path: str | None = None):
        self.problem: str | None = None
        found: Any = {}
        if path is not None:
            try:
                found = json.loads(Path(path).read_text(encoding="utf-8"))
                if not isinstance(found, dict):
                    raise ValueError("not an object")
            except (OSError, ValueError) as e:
                self.problem, found = f"{path}: {e}", {}
        self.values = merge(DEFAULTS, found)

    def put(self, dotted: str, value: Any) -> None:
        """Sets a value; None leaves what is there."""
        if value is not None:
            over: Any = value
            for key in reversed(dotted.split(".")):
                over = {key: over}
            self.values = merge(self.values, over)

    def get(self, dotted: str, default: Any = None) -> Any:
        """``get("pipeline.max_context_chunks")``; null counts as missing."""
        at: Any = self.values
        for key in dotted.split("."):
            at = at.get(key) if isinstance(at, dict) else None
        return default if at is None else at


def environment(path: str | None = ".env") -> dict[str, str]:
    """KEY=VALUE lines of a file, where there is one, below what the environment itself says."""
    found = {}
    try:
        for line in Path(path).read_text(encoding="utf-8").splitlines() if path else ():
            key, equals, value = line.strip().removeprefix("export ").partition("=")
            if equals and not key.startswith("#"):
                found[key.strip()] = value.strip().strip("\"'")
    except OSError:
        pass
    return found | dict(os.environ)
