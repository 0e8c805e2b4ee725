"""Written intermediate tables, as in the rest of the library."""

from placeframe.storage import bucketed, release, shared_folder, stored_bytes, table

__all__ = ["bucketed", "release", "shared_folder", "stored_bytes", "table"]
