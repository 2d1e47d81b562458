"""Record batches of sorted partitions, a group at a time."""

import numpy as np


def runs(batches, keys: list[str]):
    """(key tuple, record batch) for each run of equal keys in sorted batches; a long run comes in pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_pylist() for k in keys]
        names = list(zip(*cols))
        at = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        for a, b in zip(at[:-1], at[1:]):
            yield names[a], batch.slice(a, b - a)


def matrix(batch, columns) -> np.ndarray:
    """The columns as one array of doubles, a row for each of the batch's."""
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(np.float64)
