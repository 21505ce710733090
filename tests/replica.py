"""A numpy statement of the descent rule, to compare the distributed fit with."""

import numpy as np


def descend(x, y, w, iterations, step, reg, tol):
    w = np.array(w, dtype=float)
    for i in range(1, iterations + 1):
        error = 1 / (1 + np.exp(-(x @ w))) - y
        rate = step / np.sqrt(i)
        new = w * (1 - rate * reg) - rate * (error @ x) / len(y)
        moved = np.linalg.norm(new - w)
        w = new
        if i >= 2 and moved < tol * max(np.linalg.norm(w), 1.0):
            break
    return w


def sample(rng, n, width=3):
    """Integer features and labels that follow their first two, with noise."""
    x = rng.integers(-1, 2, size=(n, width))
    y = (x[:, 0] + 2 * x[:, 1] + rng.integers(-1, 2, size=n) > 0).astype(int)
    return x, y


def as_lines(x, y):
    return [",".join(map(str, [*row, 2 * label - 1])) for row, label in zip(x, y)]


def counts(x, y, w):
    """{(predicted, actual): n}, without combinations that do not occur."""
    predicted = (x @ np.array(w) > 0).astype(int)
    pairs, n = np.unique(np.stack([predicted, y]), axis=1, return_counts=True)
    return {(int(p), int(a)): int(k) for (p, a), k in zip(pairs.T, n)}
