"""Progress and warnings, through the logger `lexispark`: silent in a library, shown by the command line."""

from __future__ import annotations

import logging
import sys

_logger = logging.getLogger("lexispark")
_logger.addHandler(logging.NullHandler())


def log(message: str) -> None:
    _logger.info(message)


def warn(message: str) -> None:
    _logger.warning(message)


def show(verbose: bool = True, path: str | None = None) -> None:
    """Warnings to standard error, with `verbose` progress too; to the end of a file as well, if one is named."""
    for h in [h for h in _logger.handlers if not isinstance(h, logging.NullHandler)]:
        _logger.removeHandler(h)
    _logger.setLevel(logging.INFO if verbose else logging.WARNING)
    for h in [logging.StreamHandler(sys.stderr), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        h.setFormatter(logging.Formatter("[%(asctime)s] %(message)s", "%H:%M:%S"))
        _logger.addHandler(h)
