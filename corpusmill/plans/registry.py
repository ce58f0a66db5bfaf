"""All queries by name, with their SQL."""

from __future__ import annotations

from . import judged, replies, reports, scored, stored, textual, workflows
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "judged", "replies", "reports", "scored", "stored", "textual", "workflows"]
