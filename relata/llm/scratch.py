"""The tables in the shared folder, which all of the package uses."""

from ..scratch import bucketed, bytes_of, gathered, parts_of, saved, shared_dir, spread, sweep

__all__ = ["bucketed", "bytes_of", "gathered", "parts_of", "saved", "shared_dir", "spread", "sweep"]
