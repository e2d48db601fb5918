"""Size limits that decide between the short plan and the fully distributed one.

Both plans give the same rows; the limits only bound what a single task or a
broadcast may hold.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    # largest group a plain ``partitionBy(group)`` window may receive
    window_rows: int = 2_000_000
    # largest group the built-in exact percentile may hold in one buffer
    percentile_rows: int = 1_000_000
    # rows of consecutive positions handled together by a block window
    block_rows: int = 1_000_000
    # a key below this many rows never needs skew treatment
    hot_rows: int = 1_000_000
    # at most this many keys can exceed the hot share, so this bounds a broadcast
    max_hot_keys: int = 100_000
    # row numbers a lookup may broadcast (8 bytes each before hashing)
    lookup_rows: int = 500_000
    # blocks of 4096 row numbers whose marks a broadcast may hold (half a kilobyte each)
    mark_blocks: int = 100_000
    # ways a hot key is spread
    spread: int = 64


DEFAULT_LIMITS = Limits()
