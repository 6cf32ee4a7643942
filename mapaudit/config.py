"""Thresholds and size limits. Every operator takes one of these."""

from __future__ import annotations

from dataclasses import dataclass

# The class list, status list and thresholds the audit is defined with.
TARGET_CLASSES = ("stop sign", "traffic light")
AUDIT_STATUSES = ("VERIFIED", "NEW_DISCOVERY", "CLASS_MISMATCH", "UNKNOWN")
RECORDING_FORMAT = "dd/MM/yyyy HH:mm:ss"
EARTH_RADIUS_M = 6371000.0
MIN_CONFIDENCE = 0.25


@dataclass(frozen=True)
class AuditConfig:
    search_radius_m: float = 100.0
    audit_threshold_m: float = 100.0
    proximity_radius_m: float = 50.0
    verify_below_m: float = 10.0
    missing_from_m: float = 15.0

    # A table is broadcast only when its counted size is below this.
    broadcast_bytes: int = 256 * 1024 * 1024
    # Most distinct node positions kept together as one grid-cell row; denser
    # areas are searched on a finer grid.
    cell_sites: int = 1024
    # Most nodes in one grid cell for which all pairs of a frame are ranked directly.
    pair_nodes: int = 32
    # A key holding more rows than this is spread over several tasks.
    hot_rows: int = 1_000_000
    # Most pairs of one grid cell that a task of a shuffled radius join compares.
    task_pairs: int = 50_000_000
    # "auto" picks by counted size; "broadcast" / "shuffle" force one (tests).
    join_strategy: str = "auto"


DEFAULT = AuditConfig()
