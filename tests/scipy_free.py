"""Plain versions of statistics, with arrays and loops, for tests."""

import numpy as np


def grid_edges(wide, high):
    """Queen neighbours of a grid, both ways."""
    at = lambda x, y: x + wide * y
    return [(at(x, y), at(x + i, y + j)) for x in range(wide) for y in range(high) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and 0 <= x + i < wide and 0 <= y + j < high]


def least_spanning_tree(nodes, edges):
    """(weights of a least forest's edges, smallest node of each node's component), after Kruskal."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    out = []
    for a, b, w in sorted(edges, key=lambda e: e[2]):
        a, b = sorted((find(a), find(b)))
        if a != b:
            up[b] = a
            out.append(w)
    return out, {n: find(n) for n in nodes}


def benjamini_hochberg(p):
    p, n = np.array(p), len(p)
    order, out, least = np.argsort(p, kind="stable"), np.empty(n), 1.0
    for rank in range(n, 0, -1):
        least = min(least, p[order[rank - 1]] * n / rank)
        out[order[rank - 1]] = least
    return out


def dense_spatial_error(y, x, w):
    n, p = x.shape

    def solve(l):
        a = np.eye(n) - l * w
        ax, ay = a @ x, a @ y
        inverse = np.linalg.inv(ax.T @ ax)
        beta = inverse @ ax.T @ ay
        rss = float(((ay - ax @ beta) ** 2).sum())
        return -n / 2 * (np.log(2 * np.pi * rss / n) + 1) + np.linalg.slogdet(a)[1], beta, rss / (n - p) * inverse

    values = np.linspace(-0.97, 0.97, 1941)
    best = max(values, key=lambda l: solve(l)[0])
    like, beta, covariance = solve(best)
    return {"lambda": best, "beta": beta, "se": np.sqrt(np.diag(covariance)), "log_likelihood": like}
