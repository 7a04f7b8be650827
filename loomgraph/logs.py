"""Logging of the driver: standard error, and a rotating file if one is named."""

from __future__ import annotations

import logging
import sys
from logging.handlers import RotatingFileHandler


def setup_logger(level: str = "INFO", path: str | None = None, max_bytes: int = 10 << 20, keep: int = 5) -> logging.Logger:
    """The package's logger with fresh handlers; calling it again replaces them."""
    log = logging.getLogger("loomgraph")
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stderr)]
    if path:
        handlers.append(RotatingFileHandler(path, maxBytes=max_bytes, backupCount=keep))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(h)
    log.setLevel(level.upper())
    return log
