"""Paths as Spark names them and as Python opens them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_path(path: str) -> str:
    """The path as Python opens it; a store that Python cannot open is an error, not an unreadable file."""
    if path.startswith("file:"):
        return re.sub("^file:/*", "/", path)
    if is_remote(path):
        raise ValueError(f"content can be read from mounted folders only: {path}")
    return path


def is_remote(path: str) -> bool:
    return not path.startswith("file:") and re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", path) is not None


def mounted(path: Column) -> Column:
    """``local_path`` as a column expression, without its check."""
    return F.regexp_replace(path, "^file:/*", "/")
