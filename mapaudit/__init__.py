"""Street-map audit on Spark: detections against reference map nodes."""

from mapaudit.config import AuditConfig

__all__ = ["AuditConfig"]
