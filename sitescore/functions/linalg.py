"""Small numpy helpers on batches of square blocks, for use inside Arrow and pandas functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# The factors and the step of the splitmix generator.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
STEP = 0x9E3779B97F4A7C15


def cholesky(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower factors, whether each block is positive definite) of blocks of shape (n, nt, nt).

    One call for the batch; only where that fails is each block tried on its own.
    """
    fine = np.isfinite(blocks).all((1, 2))
    try:
        if fine.all():
            return np.linalg.cholesky(blocks), fine
    except np.linalg.LinAlgError:
        pass
    out = np.zeros_like(blocks)
    for i in np.flatnonzero(fine):
        try:
            out[i] = np.linalg.cholesky(blocks[i])
        except np.linalg.LinAlgError:
            fine[i] = False
    return out, fine


def log_dets(blocks: np.ndarray) -> np.ndarray:
    """Log-determinants by Cholesky; NaN for a block that isn't positive definite."""
    factor, fine = cholesky(blocks)
    out = np.full(len(blocks), np.nan)
    out[fine] = 2 * np.log(np.diagonal(factor[fine], axis1=1, axis2=2)).sum(1)
    return out


#: Directions of a panel whose eigenvalue is less than this part of the matrix's largest entry are put off.
PUT_OFF = 1e-6


def rank_tolerance(side: int, scale: float) -> float:
    """Eigenvalues up to this count as zero in a matrix of this side and largest entry."""
    return side * np.finfo(float).eps * scale


def split_factor(m: np.ndarray, scale: float, zero: float, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float, int]:
    """(f, signs, off, left, logdet, sign) of a symmetric matrix, of which the lower triangle counts.

    f' diag(signs) f is the inverse on the directions that can be divided by, with their log-determinant and
    sign; off has the other directions as rows and left their eigenvalues. The last panel puts none
    off: its sign is 0 if an eigenvalue is no more than zero.
    """
    none = np.zeros((0, len(m)))
    (low,), (fine,) = cholesky(m[None]) if len(m) else ((m,), (True,))
    if fine and (not len(m) or np.diag(low).min() ** 2 > zero):
        return np.linalg.inv(low) if len(m) else m, np.ones(len(m)), none, np.zeros(0), 2 * float(np.log(np.diag(low)).sum()), 1
    values, q = np.linalg.eigh(np.where(np.isfinite(m), m, 0))
    keep = np.abs(values) > (zero if last else max(zero, PUT_OFF * scale))
    own = values[keep]
    sign = 0 if last and not keep.all() else int(np.prod(np.sign(own)))
    return (q[:, keep] / np.sqrt(np.abs(own))).T, np.sign(own), none if last else q[:, ~keep].T, np.zeros(0) if last else values[~keep], float(np.log(np.abs(own)).sum()), sign


def signed_log_det(m: np.ndarray, zero: float) -> tuple[float, int]:
    """(logdet, sign) of a whole symmetric matrix."""
    *_, value, sign = split_factor(m, 0.0, zero, last=True)
    return value, sign


def stacked(column: pa.Array, *shape: int) -> np.ndarray:
    """A list column whose lists are equally long as one array of shape (rows, *shape)."""
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), *shape)


def listed(values: np.ndarray) -> pa.Array:
    """The inverse of stacked(): one list for each first index."""
    n, size = len(values), int(np.prod(values.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(values).reshape(-1)))


def nullable(values: np.ndarray) -> pa.Array:
    """A double column with null for NaN."""
    return pa.array(values, mask=np.isnan(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of the splitmix generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def normal_blocks(rows: np.ndarray, cols: np.ndarray, nt: int, seed: int) -> np.ndarray:
    """Standard normal blocks, nt x nt for each (row, col). A value depends on its seed, pair and place alone: the pair's
    key steps on by STEP, two mixed numbers are two uniform ones of 53 bits, and these a value (Box and Muller)."""
    key = mixed((rows.astype(np.uint64) << np.uint64(32) | cols.astype(np.uint64)) ^ mixed(np.array([seed], np.uint64)))
    place = np.arange(1, 2 * nt * nt + 1, dtype=np.uint64) * np.uint64(STEP)
    u = ((mixed(key[:, None] + place) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    return (np.sqrt(-2 * np.log(u[:, ::2])) * np.cos(2 * np.pi * u[:, 1::2])).reshape(-1, nt, nt)
