"""Helpers for ``mapInPandas`` over partitions sorted by key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd


def group_starts(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Positions at which a new key begins, plus the row count."""
    n = len(pdf)
    change = np.zeros(n, dtype=bool)
    change[:1] = True
    for k in keys:
        values, missing = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
        differs = (values[1:] != values[:-1]) & ~(missing[1:] & missing[:-1])
        change[1:] |= differs.astype(bool)
    return np.append(np.flatnonzero(change), n)


def whole_groups(batches: Iterable[pd.DataFrame], keys: Sequence[str]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no key is spread over two frames.

    The frames of the open key are kept in a list and put together once.
    """
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        if held and len(group_starts(pd.concat([held[-1].iloc[-1:], pdf.iloc[:1]]), keys)) > 2:
            yield pd.concat(held, ignore_index=True)
            held = []
        last = int(group_starts(pdf, keys)[-2])
        if last:
            yield pd.concat([*held, pdf.iloc[:last]], ignore_index=True)
            held = []
        held.append(pdf.iloc[last:])
    if held:
        yield pd.concat(held, ignore_index=True)
