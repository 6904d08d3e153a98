"""Small helpers for code that runs inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of each text, without decoding them."""
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def group_starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where each group begins in a frame sorted by its keys, and its length at the end."""
    new = np.zeros(len(frame), bool)
    new[:1] = True
    for k in keys:
        column = frame[k].to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new), len(frame))


def whole_groups(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of a sorted partition, cut so that no group is torn, with the starts of their groups."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        same = held and all(held[0][k].iat[0] == frame[k].iat[-1] for k in keys)
        if not same:
            cut = group_starts(frame, keys)[-2]
            whole = pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
            if len(whole):
                yield whole, group_starts(whole, keys)
            held, frame = [], frame.iloc[cut:]
        held.append(frame)
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole, group_starts(whole, keys)
