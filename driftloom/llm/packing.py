"""Number arrays as compressed bytes, for exchanges in which a row holds what thousands of rows would."""

import numpy as np
import pyarrow as pa

_KINDS = [np.dtype(k) for k in ("u1", "u2", "u4", "u8", "f4", "f8")]


def _narrow(x: np.ndarray) -> np.ndarray:
    """x in the smallest unsigned kind that holds it; doubles and floats as they are."""
    if x.dtype.kind == "f":
        return x
    most = int(x.max(initial=0))
    return x.astype(next(k for k in _KINDS[:4] if most < 1 << 8 * k.itemsize))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers or of floats, their bytes of like weight side by side, as zstd."""
    arrays = [_narrow(x) for x in arrays]
    head = np.array([len(arrays), *(v for x in arrays for v in (_KINDS.index(x.dtype), len(x)))], "u8")
    body = b"".join([head.tobytes(), *(x.view("u1").reshape(-1, x.itemsize).T.tobytes() for x in map(np.ascontiguousarray, arrays))])
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    body = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    count = int(np.frombuffer(body, "u8", 1)[0])
    head = np.frombuffer(body, "u8", 2 * count, 8).astype(int).reshape(-1, 2)
    out, at = [], 8 + 16 * count
    for kind, n in head:
        k = _KINDS[kind]
        flat = np.frombuffer(body, "u1", n * k.itemsize, at)
        out.append(np.ascontiguousarray(flat.reshape(k.itemsize, n).T).view(k).ravel())
        at += n * k.itemsize
    return out


def gaps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending unsigned numbers, from 0; np.cumsum of them gives x."""
    return np.diff(x, prepend=np.zeros(1, x.dtype))
