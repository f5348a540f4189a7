"""Logging, timing and provenance helpers of the driver."""

from __future__ import annotations

import contextlib
import logging
import os
import platform
import random
import subprocess
import sys
import time
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

import numpy as np

LOGGER = "ocellus"


def setup_logging(level: int = logging.INFO, file: str | Path | None = None) -> logging.Logger:
    """One handler to the console, and one to ``file``; a second call replaces them."""
    log = logging.getLogger(LOGGER)
    log.setLevel(level)
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    if file is not None:
        ensure_dir(Path(file).parent)
        handlers.append(logging.FileHandler(file, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log.handlers = handlers
    return log


def get_logger(name: str | None = None) -> logging.Logger:
    """The library's logger, or one below it."""
    return logging.getLogger(LOGGER if name in (None, LOGGER) else f"{LOGGER}.{name.removeprefix(f'{LOGGER}.')}")


def configure_console() -> None:
    """UTF-8 on both streams, with a substitute for what a terminal can't show; streams that can't be changed stay."""
    for stream in (sys.stdout, sys.stderr):
        if hasattr(stream, "reconfigure"):
            stream.reconfigure(encoding="utf-8", errors="replace")


def rng(seed: int, *path: int | str) -> np.random.Generator:
    """A generator of its own for each path below a seed, so that parts can be drawn in any order."""
    return np.random.default_rng([seed, *(zlib.crc32(p.encode()) if isinstance(p, str) else p for p in path)])


def ensure_dir(path: str | Path) -> Path:
    Path(path).mkdir(parents=True, exist_ok=True)
    return Path(path)


def set_seed(seed: int) -> None:
    """The driver's generators; tasks seed their own from what they work on."""
    random.seed(seed)
    np.random.seed(seed % 2**32)


@contextlib.contextmanager
def timer(what: str, log: logging.Logger | None = None) -> Iterator[dict[str, float]]:
    """Yields a dict that holds the seconds afterwards."""
    out: dict[str, float] = {}
    began = time.perf_counter()
    try:
        yield out
    finally:
        out["seconds"] = time.perf_counter() - began
        (log or logging.getLogger(LOGGER)).info("%s took %.1f s", what, out["seconds"])


def git_revision(folder: str | Path = ".") -> str | None:
    try:
        got = subprocess.run(["git", "-C", str(folder), "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return got.stdout.strip() or None if got.returncode == 0 else None


def environment() -> dict[str, str | int | None]:
    import pyspark

    return {"python": platform.python_version(), "platform": platform.platform(), "pyspark": pyspark.__version__, "numpy": np.__version__, "cpus": os.cpu_count(), "revision": git_revision(Path(__file__).parent), "at": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")}


def human_count(n: float) -> str:
    for unit in ("", "k", "M", "G"):
        if abs(n) < 1000:
            return f"{n:.0f}{unit}" if not unit else f"{n:.1f}{unit}"
        n /= 1000
    return f"{n:.1f}T"
