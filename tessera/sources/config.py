"""Project settings from YAML: source roots, excludes and the architecture section."""

from __future__ import annotations

import yaml


def read_config(text: str) -> dict:
    """sources, excludes, java_version, layers, rules, endpoints, invokers and chain_stop_methods, each with a default."""
    raw = yaml.safe_load(text) or {}
    arch = raw.get("architecture") or {}
    snake = lambda d: {"".join("_" + c.lower() if c.isupper() else c for c in k).replace("-", "_"): v for k, v in d.items()}
    return {
        "source_roots": raw.get("sourceRoots") or [],
        "excludes": raw.get("excludes") or [],
        "java_version": int(raw.get("javaVersion") or 17),
        "layers": [{"name": x["name"], "glob": x.get("glob") or x.get("pattern") or "*", "annotations": x.get("annotations") or []} for x in arch.get("layers") or []],
        "rules": [snake(x) for x in arch.get("rules") or []],
        "endpoints": arch.get("endpoints") or [],
        "invokers": [snake(x) for x in arch.get("invokers") or []],
        "chain_stop_methods": arch.get("chainStopMethods") or [],
    }
