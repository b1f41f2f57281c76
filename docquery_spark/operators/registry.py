"""Models by role and name, and the stages' options from settings."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from typing import Any

from ..config import DEFAULTS, Settings
from .answer import extractive_generator
from .models import hashed_words, identity_extractor, lexical_judge, rule_extractor
from .served import ServedModel

SERVED = "served:"
ROLES: dict[str, dict[str, Callable | None]] = {
    "extractor": {"rules": rule_extractor, "identity": identity_extractor},
    "embedder": {"hashed-words": hashed_words},
    "generator": {"extractive": extractive_generator},
    "chunk_judge": {"lexical": lexical_judge, "none": None},
    "answer_judge": {"lexical": lexical_judge, "none": None},
}


def role(kind: str, name: str | None = None, server: dict[str, Any] | None = None) -> Callable | None:
    """The model of a role by name: a built-in one, ``module:function``, or ``served:model`` on ``server`` (url, key).

    Without a name the role's default.
    """
    known = ROLES[kind]
    name = name or DEFAULTS["models"][kind]
    if name in known:
        return known[name]
    if name.startswith(SERVED) and kind != "embedder":
        return getattr(ServedModel(**{**(server or {}), "model": name.removeprefix(SERVED)}), kind)
    module, _, attribute = name.partition(":")
    if not attribute:
        raise KeyError(f"no {kind} is named {name!r}; there are {', '.join(known)}, module:function and {SERVED}model")
    return getattr(importlib.import_module(module), attribute)


def _server(settings: Settings) -> dict[str, Any]:
    return {k: v for k, v in (settings.get("models.server") or {}).items() if v}


def ingest_options(settings: Settings) -> dict[str, Any]:
    """Arguments of ``ingest.ingest``."""
    judged = settings.get("validation.enable_checkpoint_a")
    return {
        "extractor": role("extractor", settings.get("models.extractor"), _server(settings)),
        "judge": role("chunk_judge", settings.get("models.chunk_judge"), _server(settings)) if judged else None,
        "fail_open": settings.get("validation.fail_open"),
        "floor": settings.get("validation.confidence_floor"),
        "retry_below": settings.get("validation.retry_below"),
        "links": settings.get("pipeline.links"),
    }


def store_options(settings: Settings) -> dict[str, Any]:
    """Arguments of ``store.storable``."""
    return {"embedder": role("embedder", settings.get("models.embedder")), "dimensions": settings.get("pipeline.embedder_dimensions")}


def answer_options(settings: Settings) -> dict[str, Any]:
    """Arguments of ``answer.answer``."""
    judge = role("answer_judge", settings.get("models.answer_judge"), _server(settings))
    return {
        "validates": bool(settings.get("validation.enable_checkpoint_b")) and judge is not None,
        "generator": role("generator", settings.get("models.generator"), _server(settings)),
        **({"judge": judge} if judge is not None else {}),
        "mode": settings.get("validation.answer_mode"),
        "k": settings.get("pipeline.max_context_chunks"),
        "figures": settings.get("pipeline.extra_figures"),
    }
