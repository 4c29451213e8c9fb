"""Small dense GEE in numpy, used only to check the Spark sums."""

import numpy as np


def inverse_correlation(corr, n, a):
    if corr == "exchangeable":
        r = np.full((n, n), a)
        np.fill_diagonal(r, 1.0)
    elif corr == "ar1":
        i = np.arange(n)
        r = a ** np.abs(i[:, None] - i[None, :])
    else:
        r = np.eye(n)
    return np.linalg.inv(r)


def dense_gee(clusters, corr, passes=200):
    """``clusters`` is a list of (x, y); returns coefficients, robust covariance and alpha."""
    p = clusters[0][0].shape[1]
    b, a = np.zeros(p), 0.0
    for _ in range(passes):
        h, u, m = np.zeros((p, p)), np.zeros(p), np.zeros((p, p))
        squares = products = pairs = rows = 0.0
        for x, y in clusters:
            mu = 1 / (1 + np.exp(-x @ b))
            s = np.sqrt(mu * (1 - mu))
            z, r = x * s[:, None], (y - mu) / s
            inv = inverse_correlation(corr, len(y), a)
            ui = z.T @ inv @ r
            h += z.T @ inv @ z
            u += ui
            m += np.outer(ui, ui)
            squares += r @ r
            rows += len(y)
            if corr == "exchangeable":
                products += (r.sum() ** 2 - r @ r) / 2
                pairs += len(y) * (len(y) - 1) / 2
            elif corr == "ar1":
                products += r[1:] @ r[:-1]
                pairs += len(y) - 1
        step = np.linalg.solve(h, u)
        new_a = products / (squares / rows * pairs) if pairs else 0.0
        if np.max(np.abs(step)) < 1e-12 and abs(new_a - a) < 1e-12:
            break
        b, a = b + step, new_a
    bread = np.linalg.inv(h)
    return b, bread @ m @ bread, a
