"""Rank-one updates of a symmetric eigendecomposition, in NumPy.

``A = Q diag(d) Q'`` becomes the decomposition of ``A + rho v v'``: with ``z = Q'v`` the new eigenvalues are the roots of
the secular equation ``1 + rho * sum(z_j^2 / (d_j - x)) = 0``, one behind each ``d_j``.  Components with no weight, and all
but one of equal eigenvalues, are deflated first: they keep their eigenvector.
"""

from __future__ import annotations

ROUNDS = 40  # of the root search; the bracket alone halves in each, and the rational steps need about six


def deflated(d, q, z, rho):
    """Indices that take part in the update.  Rotates ``q``, ``z`` and ``d`` in place so that equal eigenvalues share one weight."""
    import numpy as np

    eps = np.finfo(float).eps
    tol = 8 * eps * max(abs(d).max(), rho * float(z @ z))
    kept = np.flatnonzero(rho * abs(z) * np.sqrt(z @ z) > tol)
    if len(kept) > 1:
        gap = np.diff(d[kept])
        a, b = z[kept[:-1]], z[kept[1:]]
        if (gap * abs(a * b) <= tol * (a * a + b * b)).any():
            out, i = [], kept[0]
            for j in kept[1:]:
                tau = np.hypot(z[i], z[j])
                c, s = z[j] / tau, z[i] / tau
                if abs((d[j] - d[i]) * c * s) <= tol:  # turn both directions so that only j keeps weight
                    q[:, i], q[:, j] = c * q[:, i] - s * q[:, j], s * q[:, i] + c * q[:, j]
                    d[i], d[j] = d[i] * c * c + d[j] * s * s, d[i] * s * s + d[j] * c * c
                    z[i], z[j] = 0.0, tau
                else:
                    out.append(i)
                i = j
            kept = np.array([*out, i])
    return kept


def secular_roots(d, z, rho):
    """For each root: the pole it is measured from, and its distance from that pole (``d`` strictly ascending, ``z`` without zeros)."""
    import numpy as np

    k = len(d)
    weight = rho * z * z
    last = d[-1] + weight.sum()
    poles = np.append(d, d[-1] + 2 * weight.sum())  # the last one has no weight
    upper = np.append(d[1:], last)
    middle = (d + upper) / 2
    f_mid = 1 + (weight / (d - middle[:, None])).sum(axis=1)
    own = np.arange(k)
    base = np.where((f_mid >= 0) | (own == k - 1), own, own + 1)  # the nearer pole
    origin = d[base]
    delta = d - origin[:, None]  # row per root
    d1, d2 = poles[own] - origin, poles[own + 1] - origin
    near, far = d - origin, middle - origin
    lo = np.where(f_mid >= 0, near, far)
    hi = np.where(f_mid >= 0, far, upper - origin)
    x = (lo + hi) / 2
    left = own[None, :] <= own[:, None]  # poles at or before the root
    eps = np.finfo(float).eps
    for _ in range(ROUNDS):
        gap = delta - x[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            term = weight / gap
            slope = term / gap
        f = 1 + term.sum(axis=1)
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        sure = (abs(f) <= 4 * eps * (1 + abs(term).sum(axis=1))) | (hi - lo <= 2 * eps * np.maximum(abs(lo), abs(hi)))
        if sure.all():
            break
        total = slope.sum(axis=1)
        before = np.where(left, slope, 0).sum(axis=1)
        g1, g2 = d1 - x, d2 - x
        c = f - g1 * before - g2 * (total - before)
        a = (g1 + g2) * f - g1 * g2 * total
        b = g1 * g2 * f
        root = np.sqrt(abs(a * a - 4 * b * c))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        x = np.where(sure, x, new)
    return origin, x


def rank_one(d, q, v, rho: float):
    """Eigenvalues (ascending) and eigenvectors of ``q diag(d) q' + rho v v'`` for ``rho >= 0``."""
    import numpy as np

    z = q.T @ v
    if rho <= 0 or not z.any():
        return d, q
    d, q = d.copy(), q.copy()
    kept = deflated(d, q, z, rho)
    if len(kept):
        dk, zk = d[kept], z[kept]
        order = np.argsort(dk, kind="stable")
        kept, dk, zk = kept[order], dk[order], zk[order]
        origin, x = secular_roots(dk, zk, rho)
        far = (dk - origin[:, None]) - x[:, None]  # d_j - root_i, without cancellation
        # the weights for which these roots are exact, so that the vectors are orthogonal
        between = dk - dk[:, None]
        np.fill_diagonal(between, 1.0)
        # prod_i (root_i - d_j) / prod_{i != j} (d_i - d_j), paired so that every factor is near 1
        size = np.sqrt(np.prod(abs(far) / abs(between), axis=0))
        u = np.where(zk < 0, -size, size)[:, None] / far.T
        u /= np.sqrt((u * u).sum(axis=0))
        d[kept] = origin + x
        q[:, kept] = q[:, kept] @ u
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter matrix of the vectors seen so far."""

    def __init__(self, width: int):
        import numpy as np

        self.n, self.mean, self.d, self.q = 0, np.zeros(width), np.zeros(width), np.eye(width)

    def add(self, x) -> None:
        """One more vector: a centred rank-one update."""
        off = x - self.mean
        self.n += 1
        self.mean = self.mean + off / self.n
        self.d, self.q = rank_one(self.d, self.q, off, (self.n - 1) / self.n)

    def merge(self, other: "Spectrum") -> None:
        """Add the vectors of another spectrum: one update for each of its eigenpairs and one for the distance of the means."""
        n = self.n + other.n
        if other.n == 0:
            return
        off = other.mean - self.mean
        for value, vector in zip(other.d, other.q.T, strict=True):
            if value > 0:
                self.d, self.q = rank_one(self.d, self.q, vector, float(value))
        if self.n:
            self.d, self.q = rank_one(self.d, self.q, off, self.n * other.n / n)
        self.mean = self.mean + off * (other.n / n)
        self.n = n

    def to_bytes(self) -> bytes:
        import numpy as np

        return np.concatenate(([float(self.n)], self.mean, self.d, self.q.ravel())).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, width: int) -> "Spectrum":
        import numpy as np

        data, out = np.frombuffer(raw), cls(width)
        out.n, out.mean, out.d = int(data[0]), data[1:1 + width].copy(), data[1 + width:1 + 2 * width].copy()
        out.q = data[1 + 2 * width:].reshape(width, width).copy()
        return out
