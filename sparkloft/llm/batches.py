"""What functions over Arrow batches have in common."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd


def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches that have rows: empty partitions send one without, whose text columns Arrow can't take back."""
    return (b for b in batches if len(b))
