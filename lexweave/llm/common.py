"""Shared plumbing of the training-data operators: bounded Arrow batches and checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexweave import durable
from lexweave.durable import ARROW, arrow_batches, components, discard, materialize, shared_dir

__all__ = ["ARROW", "BROADCAST_ROWS", "arrow_batches", "broadcast_if_small", "components", "discard", "free_name", "materialize", "shared_dir"]

#: Tables of at most this many rows (of a few fixed-width columns each) may be broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    return durable.broadcast_if_small(df, rows)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores before it until no column of ``df`` has it: helper columns replace none."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
