"""Right singular vectors of small triangular matrices, accurate for each singular value.

Householder reflections make the matrix bidiagonal; its squared singular values come from the
differential quotient-difference transform with shifts that never pass the smallest of them, so each is right
in nearly all its digits; vectors come from twisted factorisations of the bidiagonal's own products.
After the published work of Fernando, Parlett and Dhillon.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(np.float64).eps)
CLOSE = 1e-3  # values that differ by less, relatively, share their vectors' orthogonalisation


def reflector(column: np.ndarray) -> tuple[np.ndarray, float]:
    """A vector ``h`` of length sqrt 2 (or 0) and ``a``, so that ``column - h (h . column)`` is ``a, 0, 0, ...``"""
    largest = np.abs(column).max(initial=0.0)
    if largest == 0 or not np.abs(column[1:]).max(initial=0.0):
        return np.zeros_like(column), float(column[0]) if len(column) else 0.0
    scaled = column / largest
    length = math.copysign(np.linalg.norm(scaled), scaled[0])
    scaled[0] += length
    return scaled * (math.sqrt(2) / np.linalg.norm(scaled)), -length * largest


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``diagonal, above, right``: ``matrix`` is an orthogonal matrix times the upper bidiagonal times ``right.T``."""
    work, size = matrix.astype(np.float64).copy(), matrix.shape[1]
    right = np.eye(size)
    for at in range(size):
        h, _ = reflector(work[at:, at])
        work[at:, at:] -= np.outer(h, h @ work[at:, at:])
        if at + 2 < size:
            h, _ = reflector(work[at, at + 1 :])
            work[at:, at + 1 :] -= np.outer(work[at:, at + 1 :] @ h, h)
            right[:, at + 1 :] -= np.outer(right[:, at + 1 :] @ h, h)
    return np.diag(work).copy(), np.diag(work, 1).copy(), right


def transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential step; ``None`` where the shift is beyond the smallest value.

    The third result holds the step's differences; without a shift their inverses are the diagonal of the
    inverse matrix.
    """
    new_q, new_e, apart = [], [], []
    d = q[0] - shift
    for at in range(len(e)):
        if d < 0:
            return None
        apart.append(d)
        total = d + e[at]
        if total == 0:
            new_q.append(0.0)
            new_e.append(0.0)
            d = q[at + 1] - shift
            continue
        ratio = q[at + 1] / total
        new_q.append(total)
        new_e.append(e[at] * ratio)
        d = d * ratio - shift
    if d < 0 or not math.isfinite(d):
        return None
    apart.append(d)
    return [*new_q, d], new_e, apart


def _shift(q: list[float], e: list[float], apart: list[float]) -> list[float]:
    """Shifts to try, bold ones first: the smaller value of the last two rows less what couples them to the
    rest, then what the sum of inverses allows, which is never too much, then none."""
    safe = 0.0 if min(apart) <= 0 else 1.0 / math.fsum(1.0 / d for d in apart)
    half, product = (q[-2] + e[-1] + q[-1]) / 2, q[-1] * q[-2]
    root = math.sqrt(max(half * half - product, 0.0))
    corner = product / (half + root) if half + root > 0 else 0.0
    coupled = math.sqrt(q[-2] * e[-2]) if len(e) > 1 else 0.0
    bold = (corner - coupled) * (1 - 4 * EPS)
    tries = [bold] if bold > safe else []
    return [*tries, safe * (1 - 8 * EPS * len(q)), 0.0]


def squared_values(diagonal: np.ndarray, above: np.ndarray) -> list[float]:
    """Squares of the singular values of an upper bidiagonal matrix, in no order."""
    out: list[float] = []
    blocks = [((diagonal**2).tolist(), (above**2).tolist(), 0.0)]
    while blocks:
        q, e, passed = blocks.pop()
        apart: list[float] | None = None
        while True:
            if len(q) == 1:
                out.append(max(q[0] + passed, 0.0))
                break
            cut = next((at for at in range(len(e) - 1, -1, -1)
                        if e[at] <= EPS * EPS * (passed + min(q[at], q[at + 1])) or e[at] == 0), None)
            if cut is not None:
                blocks += [(q[: cut + 1], e[:cut], passed), (q[cut + 1 :], e[cut + 1 :], passed)]
                break
            if apart is None and q[0] < q[-1]:  # the small end last, where values part first
                q, e = q[::-1], e[::-1]
            if apart is None:
                step, shift = transform(q, e, 0.0), 0.0
            else:
                step = None
                for shift in _shift(q, e, apart):
                    step = transform(q, e, shift)
                    if step is not None:
                        break
            q, e, apart = step
            passed += shift
    return out


def twisted(q: np.ndarray, e: np.ndarray, value: float, skip: int = 0) -> tuple[np.ndarray, float]:
    """Unit vector of the product matrix (diagonal ``q`` before, ``e`` above: squares of the bidiagonal) for an
    approximate value, and how far the value is off. ``skip`` takes the next best place to twist at."""
    size = len(q)
    tiny = EPS * EPS * max(float(q.max()), 1e-290)
    ratio = np.sqrt(e / q[:-1]) if size > 1 else np.zeros(0)  # signs are put back by the caller
    down, up = np.empty(size), np.empty(size)
    low, high = np.zeros(max(size - 1, 0)), np.zeros(max(size - 1, 0))
    down[0] = -value
    for at in range(size - 1):
        pivot = q[at] + down[at] or tiny
        low[at] = q[at] * ratio[at] / pivot
        down[at + 1] = low[at] * ratio[at] * down[at] - value
    up[-1] = q[-1] - value
    for at in range(size - 2, -1, -1):
        pivot = e[at] + up[at + 1] or tiny
        share = q[at] / pivot
        high[at] = ratio[at] * share
        up[at] = up[at + 1] * share - value
    off = down + up + value
    place = int(np.argsort(np.abs(off), kind="stable")[min(skip, size - 1)])
    vector = np.zeros(size)
    vector[place] = 1.0
    for at in range(place - 1, -1, -1):
        vector[at] = -low[at] * vector[at + 1]
    for at in range(place, size - 1):
        vector[at + 1] = -high[at] * vector[at]
    squared = float(vector @ vector)
    return vector / math.sqrt(squared), float(off[place]) / squared


def right_vectors(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest squared singular values, falling, and their right singular vectors as rows.

    Fewer come out where the rest are zero to double precision. Values that are very close get vectors
    that are orthogonal to each other.
    """
    diagonal, above, right = bidiagonal(matrix)
    size = len(diagonal)
    largest = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if largest == 0:
        return np.zeros(0), np.zeros((0, size))
    diagonal, above = diagonal / largest, above / largest
    # a diagonal of nothing has no factorisation: the least that does not change the values in double precision
    diagonal = np.where(np.abs(diagonal) < EPS * EPS, EPS * EPS, diagonal)
    cuts = [0, *(np.flatnonzero(np.abs(above) <= EPS * EPS) + 1).tolist(), size]
    values = sorted(
        ((value, start, end) for start, end in zip(cuts, cuts[1:])
         for value in squared_values(diagonal[start:end], above[start : end - 1])),
        key=lambda x: -x[0],
    )
    nothing = (size * EPS) ** 2 * values[0][0]
    values = [v for v in values if v[0] > nothing]
    found: list[np.ndarray] = []
    for at, (value, start, end) in enumerate(values):
        if at >= wanted and not values[wanted - 1][0] - value <= CLOSE * values[0][0]:
            break
        near = [v for v, (other, _, _) in zip(found, values) if other - value <= CLOSE * values[0][0]]
        q, e = diagonal[start:end] ** 2, above[start : end - 1] ** 2
        # with b above and a before it, the product's factor is b / a: signs follow from there
        signs = np.cumprod(np.concatenate([[1.0], np.sign(above[start : end - 1]) * np.sign(diagonal[start : end - 1])]))
        for skip in range(end - start):
            part, off = twisted(q, e, value, skip)
            again, left = twisted(q, e, value + off, skip)
            part = again if abs(left) < abs(off) else part
            vector = np.zeros(size)
            vector[start:end] = part * signs
            for _ in range(2):
                for other in near:
                    vector -= other * (other @ vector)
            length = np.linalg.norm(vector)
            if length > 0.5:  # else it is one of those that were found
                break
        found.append(vector / length)
    vectors = np.array(found) @ right.T
    # close values: turn the found vectors within their own span, which is what the matrix itself decides
    scale = matrix / np.abs(matrix).max()
    image = scale @ vectors.T
    first = 0
    while first < len(vectors):
        last = first + 1
        while last < len(vectors) and values[last - 1][0] - values[last][0] <= CLOSE * values[0][0]:
            last += 1
        if last - first > 1:
            turned = jacobi(image[:, first:last].T @ image[:, first:last])
            vectors[first:last] = turned.T @ vectors[first:last]
        first = last
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.array([v for v, _, _ in values[:wanted]]) * largest**2, vectors[:wanted]


def jacobi(matrix: np.ndarray) -> np.ndarray:
    """Eigenvectors, by falling value, of a small symmetric matrix that is nearly diagonal."""
    work, turned = matrix.copy(), np.eye(len(matrix))
    for _ in range(30):
        if np.abs(work - np.diag(np.diag(work))).max() <= EPS * np.abs(work).max():
            break
        for a in range(len(work)):
            for b in range(a + 1, len(work)):
                if work[a, b] == 0:
                    continue
                angle = 0.5 * math.atan2(2 * work[a, b], work[b, b] - work[a, a])
                turn = np.eye(len(work))
                turn[a, a] = turn[b, b] = math.cos(angle)
                turn[a, b], turn[b, a] = math.sin(angle), -math.sin(angle)
                work, turned = turn.T @ work @ turn, turned @ turn
    return turned[:, np.argsort(-np.diag(work), kind="stable")]
