"""Versioned key-value analytics on Spark: changelog, segments, manifest, newest-wins reads."""

from stratolog.schema import CHANGELOG_SCHEMA, OP_DELETE, OP_PUT
from stratolog.plans.store import Store

__all__ = ["CHANGELOG_SCHEMA", "OP_DELETE", "OP_PUT", "Store"]
