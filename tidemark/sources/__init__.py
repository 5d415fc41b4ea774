"""Table sources and materialised intermediates."""

from tidemark.sources.tables import materialize, read_table, shared_dir, small_side

__all__ = ["materialize", "read_table", "shared_dir", "small_side"]
