"""Sums over discs between two blocks of positions, as arrays.

Positions of a block lie in the order of a space-filling curve and are boxed in runs of `SMALL`, and those in runs of `LARGE`.
Boxes are compared first: what a disc holds whole is added as one number, and only runs on a rim are opened.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SMALL, LARGE = 16, 256
#: Pairs of boxes, and pairs of small runs, that are compared at once.
BOX_PAIRS, RUN_PAIRS = 1 << 18, 1 << 11


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The order of positions along a Z curve over their box."""
    key = np.zeros(len(x), np.uint64)
    for shift, c in enumerate((x, y)):
        low, span = c.min(), c.max() - c.min()
        k = np.zeros(len(c), np.uint64) if not span > 0 else ((c - low) / span * 65535).astype(np.uint64)
        for step, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            k = (k | (k << np.uint64(step))) & np.uint64(mask)
        key |= k << np.uint64(shift)
    return np.argsort(key, kind="stable")


def boxes(x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """x0, x1, y0, y1 of each run of `step` positions."""
    at = np.arange(0, len(x), step)
    return np.stack([np.minimum.reduceat(x, at), np.maximum.reduceat(x, at), np.minimum.reduceat(y, at), np.maximum.reduceat(y, at)])


def apart(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest squared distance of two boxes, in the arithmetic of the distance itself."""
    near = [np.maximum(np.maximum(b[k] - a[k + 1], a[k] - b[k + 1]), 0.0) for k in (0, 2)]
    far = [np.maximum(b[k + 1] - a[k], a[k + 1] - b[k]) for k in (0, 2)]
    return near[0] * near[0] + near[1] * near[1], far[0] * far[0] + far[1] * far[1]


def runs(c: np.ndarray, fill: float) -> np.ndarray:
    """Rows in runs of `SMALL`, the last one filled up."""
    n = -(-len(c) // SMALL) * SMALL
    out = np.full((n, *c.shape[1:]), fill)
    out[: len(c)] = c
    return out.reshape(-1, SMALL, *c.shape[1:])


def finite_sums(qx: np.ndarray, qy: np.ndarray, dx: np.ndarray, dy: np.ndarray, v: np.ndarray, squares: Sequence[float]) -> np.ndarray:
    """[radius, position of q, value]: sums of the rows of `v` whose positions lie within each radius (squared in `squares`)."""
    mine, theirs = curve(qx, qy), curve(dx, dy)
    qx, qy, dx, dy, v = qx[mine], qy[mine], dx[theirs], dy[theirs], v[theirs]
    per = LARGE // SMALL
    ql, dl, qs, ds = boxes(qx, qy, LARGE), boxes(dx, dy, LARGE), boxes(qx, qy, SMALL), boxes(dx, dy, SMALL)
    vl, vs = (np.add.reduceat(v, np.arange(0, len(v), step)) for step in (LARGE, SMALL))
    qxr, qyr, dxr, dyr, vr = runs(qx, np.nan), runs(qy, np.nan), runs(dx, np.nan), runs(dy, np.nan), runs(v, 0.0)
    n, rows, width = qs.shape[1], len(squares), v.shape[1]
    large, small, each = np.zeros((rows, ql.shape[1], width)), np.zeros((rows, n, width)), np.zeros((rows, n, SMALL, width))
    inside = np.arange(per)
    strip = max(1, BOX_PAIRS // dl.shape[1])
    for top in range(0, ql.shape[1], strip):
        low, high = apart(ql[:, top : top + strip, None], dl[:, None, :])
        for k, r2 in enumerate(squares):
            whole = high <= r2
            large[k, top : top + strip] += whole.astype(float) @ vl
            ai, bi = np.nonzero((low <= r2) & ~whole)
            for at in range(0, len(ai), BOX_PAIRS // per**2):
                s = (ai[at : at + BOX_PAIRS // per**2, None] + top) * per + inside
                t = bi[at : at + BOX_PAIRS // per**2, None] * per + inside
                known_s, known_t = s < n, t < ds.shape[1]
                s, t = np.minimum(s, n - 1), np.minimum(t, ds.shape[1] - 1)
                low_s, high_s = apart(qs[:, s][:, :, :, None], ds[:, t][:, :, None, :])
                known = known_s[:, :, None] & known_t[:, None, :]
                whole_s = (high_s <= r2) & known
                np.add.at(small[k], s, whole_s.astype(float) @ vs[t])
                p, i, j = np.nonzero((low_s <= r2) & known & ~whole_s)
                i, j = s[p, i], t[p, j]
                for f in range(0, len(i), RUN_PAIRS):
                    a, b = i[f : f + RUN_PAIRS], j[f : f + RUN_PAIRS]
                    ex, ey = qxr[a][:, :, None] - dxr[b][:, None, :], qyr[a][:, :, None] - dyr[b][:, None, :]
                    ex *= ex
                    ey *= ey
                    ex += ey
                    np.add.at(each[k], a, (ex <= r2).astype(float) @ vr[b])
    total = each.reshape(rows, -1, width)[:, : len(qx)] + np.repeat(small, SMALL, 1)[:, : len(qx)] + np.repeat(large, LARGE, 1)[:, : len(qx)]
    out = np.empty_like(total)
    out[:, mine] = total
    return out


def disc_sums(qx, qy, dx, dy, v: np.ndarray, squares: Sequence[float]) -> np.ndarray:
    """`finite_sums`, with NaN and infinite values told to the discs that hold them only."""
    if np.isfinite(v).all():
        return finite_sums(qx, qy, dx, dy, v, squares)
    w = v.shape[1]
    odd = np.concatenate([np.where(np.isfinite(v), v, 0.0), np.isnan(v), v == np.inf, v == -np.inf], 1)
    got = finite_sums(qx, qy, dx, dy, odd, squares)
    plain, nan, up, down = (got[:, :, k * w : (k + 1) * w] for k in range(4))
    plain = np.where(up > 0, np.inf, np.where(down > 0, -np.inf, plain))
    return np.where((nan > 0) | ((up > 0) & (down > 0)), np.nan, plain)
