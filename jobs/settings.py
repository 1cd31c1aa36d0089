"""Settings of a job from its config file, and the log that jobs share."""

from __future__ import annotations

import json
import logging
from dataclasses import fields
from pathlib import Path
from typing import TypeVar

S = TypeVar("S")


def load(kind: type[S], path: str | None) -> S:
    """The settings in a JSON file; without a path the defaults. A name that the job does not know is an error."""
    given = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    if unknown := set(given) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown setting(s): {sorted(unknown)}")
    return kind(**given)


def log_to_console() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
