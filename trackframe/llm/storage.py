"""Durable intermediate tables, as the rest of the library makes them."""

from __future__ import annotations

from ..storage import drop_tables, fresh_path, materialize, shared_dir

__all__ = ["drop_tables", "fresh_path", "materialize", "shared_dir"]
