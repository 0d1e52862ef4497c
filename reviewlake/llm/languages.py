"""Which grammar a path is read with."""

from __future__ import annotations

# The file extensions and their languages.
GRAMMARS = {"py": "python", "pyi": "python", "ts": "ts", "mts": "ts", "cts": "ts", "tsx": "tsx", "js": "js", "mjs": "js"}
LABELS = {"python": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript"}


def grammar_of(path: str | None) -> str | None:
    """python, ts, tsx or js; None for a path without a known extension."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    return GRAMMARS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None
