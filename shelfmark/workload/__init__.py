"""Queries over the driver tables, one or more per operator."""

from shelfmark.workload import browse, curating, naming, scanning, streams, verifying  # noqa: F401
from shelfmark.workload.base import REGISTRY, Tables

__all__ = ["REGISTRY", "Tables"]
