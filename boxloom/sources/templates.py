"""Prompt templates from files, with something to fall back on."""

from __future__ import annotations

import logging
from pathlib import Path

log = logging.getLogger(__name__)


def template(folder: str | Path, name: str, fallback: str) -> str:
    """The text of file ``name`` in ``folder`` without white space at its ends; ``fallback`` if it is not there or can't be read."""
    path = Path(folder) / name
    if not path.is_file():
        return fallback
    try:
        return path.read_text(encoding="utf-8").strip()
    except (OSError, UnicodeDecodeError) as failure:
        log.warning("the template %s can't be read: %s", path, failure)
        return fallback
