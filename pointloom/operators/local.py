"""The levels of a bounded number of nodes, built in numpy inside one task.

Same rule as the distributed levels: origins are the nodes, in order, that no earlier origin reaches;
every other node belongs to the earliest origin that reaches it.
"""

from __future__ import annotations

import numpy as np

CHUNK = 2_000_000
#: Rounds of parallel decisions before long chains of dependencies are finished one node at a time.
ROUNDS = 48
#: Up to so many pairs of nodes in neighbouring cells all pairs are held; denser nodes are decided by rounds over cells.
MOST_PAIRS = 40_000_000


class Grid:
    """Places (tx, ty) by cells a little wider than r, to be asked which of them lie within r of other places."""

    def __init__(self, tx, ty, r: float):
        self.tx, self.ty, self.r = tx, ty, r
        self.side = max(r, 1e-12) * (1 + 1e-6)
        gx, gy = np.floor(tx / self.side).astype(np.int64), np.floor(ty / self.side).astype(np.int64)
        self.span = int(1.01 / self.side) + 16
        self.cells = gx * self.span + gy
        self.order = np.argsort(self.cells, kind="stable")
        self.keys = self.cells[self.order]

    def ask(self, x, y):
        """Askers in order of their cells, their number of possible partners in all, and for each column of cells where these lie."""
        probes = np.floor(x / self.side).astype(np.int64) * self.span + np.floor(y / self.side).astype(np.int64)
        # Probes go in order of their cells: searching then runs along memory. Three cells of a column are neighbours in key order.
        askers = np.argsort(probes, kind="stable")
        probes = probes[askers]
        columns = [(np.searchsorted(self.keys, probes + (d * self.span - 1), "left"), np.searchsorted(self.keys, probes + (d * self.span + 1), "right")) for d in (-1, 0, 1)]
        return askers, sum(int((hi - lo).sum()) for lo, hi in columns), columns

    def near(self, x, y, asked=None):
        """Chunks of (asker, place) within r of each other."""
        askers, _, columns = asked or self.ask(x, y)
        x, y, n = x[askers], y[askers], len(askers)
        for lo, hi in columns:
            size = hi - lo
            upto = np.concatenate(([0], np.cumsum(size)))
            at = 0
            while at < n:
                end = max(at + 1, int(np.searchsorted(upto, upto[at] + CHUNK, "right")) - 1)
                m = size[at:end]
                who = np.repeat(np.arange(at, end), m)
                place = self.order[np.arange(len(who)) - np.repeat(upto[at:end] - upto[at], m) + np.repeat(lo[at:end], m)]
                close = (self.tx[place] - x[who]) ** 2 + (self.ty[place] - y[who]) ** 2 <= self.r * self.r
                yield askers[who[close]], place[close]
                at = end


def pairs(x, y, tx, ty, r: float, asked=None, grid: Grid | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst), src < dst, dst's rounded place within r of src's exact place; places given in order."""
    found = [(s[d > s], d[d > s]) for s, d in (grid or Grid(tx, ty, r)).near(x, y, asked)]
    return np.concatenate([s for s, _ in found]), np.concatenate([d for _, d in found])


def decide(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Which nodes are origins, given all pairs."""
    state = np.zeros(n, np.int8)  # 0 open, 1 origin, 2 covered
    s, d = src, dst
    for _ in range(ROUNDS):
        waits = np.zeros(n, bool)
        waits[d] = True
        state[(state == 0) & ~waits] = 1
        state[d[state[s] == 1]] = 2
        live = (state[s] == 0) & (state[d] == 0)
        s, d = s[live], d[live]
        if not len(s):
            break
    else:
        order = np.argsort(d, kind="stable")
        s, d = s[order], d[order]
        nodes, first = np.unique(d, return_index=True)
        ends = np.append(first[1:], len(d))
        open_nodes = np.flatnonzero(state == 0)
        where = {int(k): (int(a), int(b)) for k, a, b in zip(nodes, first, ends)}
        for k in open_nodes.tolist():
            a, b = where.get(k, (0, 0))
            state[k] = 2 if (state[s[a:b]] == 1).any() else 1
    return state != 2


def certain(x, y, tx, ty, r: float, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is sure of nodes given in order, where ``edge`` marks those that nodes not given may reach.

    (state: 0 unknown, 1 origin, 2 covered; first sure origin that reaches a node, itself for an origin, n for none;
    whether an unknown node before that may take it; whether no other node can belong to it).
    """
    n = len(x)
    state, none = np.zeros(n, np.int8), np.full(n, n, np.int64)
    grid = Grid(tx, ty, r)
    asked = grid.ask(x, y)
    if asked[1] > MOST_PAIRS:
        return state, none, np.zeros(n, bool), np.zeros(n, bool)
    src, dst = pairs(x, y, tx, ty, r, asked, grid)
    s, d = src, dst
    for _ in range(ROUNDS):
        waits = edge.copy()
        waits[d] = True
        new = (state == 0) & ~waits
        if not new.any():
            break
        state[new] = 1
        state[d[new[s]]] = 2
        live = (state[s] == 0) & (state[d] == 0)
        s, d = s[live], d[live]
    else:
        order = np.argsort(d, kind="stable")
        s, d = s[order], d[order]
        nodes, first = np.unique(d, return_index=True)
        where = {int(k): (int(a), int(b)) for k, a, b in zip(nodes, first, np.append(first[1:], len(d)))}
        for k in np.flatnonzero(state == 0).tolist():
            a, b = where.get(k, (0, 0))
            before = state[s[a:b]]
            if (before == 1).any():
                state[k] = 2
            elif not edge[k] and not (before == 0).any():
                state[k] = 1
    best, doubt = none, none.copy()
    own = state == 1
    hit = own[src]
    np.minimum.at(best, dst[hit], src[hit])
    best[own] = np.flatnonzero(own)
    hit = state[src] == 0
    np.minimum.at(doubt, dst[hit], src[hit])
    unsure = (state == 2) & (doubt < best)
    alone = own.copy()
    alone[src[(best[dst] == src) | unsure[dst] | (state[dst] == 0)]] = False
    return state, best, unsure, alone


def any_near(x, y, tx, ty, r: float, asking: np.ndarray) -> bool:
    """Whether one of these nodes reaches another one."""
    grid = Grid(tx, ty, r)
    return grid.ask(x[asking], y[asking])[1] > MOST_PAIRS or any((asking[s] != d).any() for s, d in grid.near(x[asking], y[asking]))


def origins(x, y, tx, ty, r: float) -> np.ndarray:
    """Which nodes, given in order, are origins: all pairs where they are few, else rounds in which only the first open node of a cell is looked at."""
    kept, open_ = np.zeros(len(x), bool), np.arange(len(x))
    while len(open_):
        grid = Grid(tx[open_], ty[open_], r)
        asked = grid.ask(x[open_], y[open_])
        if asked[1] <= MOST_PAIRS:
            kept[open_] = decide(len(open_), *pairs(x[open_], y[open_], None, None, r, asked, grid))
            break
        first = np.unique(grid.cells, return_index=True)[1]
        blocked = np.zeros(len(first), bool)
        for u, c in Grid(tx[open_[first]], ty[open_[first]], r).near(x[open_], y[open_]):
            blocked[c[u < first[c]]] = True
        found = first[~blocked]
        gone = np.zeros(len(open_), bool)
        gone[found] = True
        kept[open_[found]] = True
        for o, v in grid.near(x[open_[found]], y[open_[found]]):
            gone[v[found[o] < v]] = True
        open_ = open_[~gone]
    return kept


def owners(x, y, tx, ty, r: float) -> np.ndarray:
    """Earliest origin of every node; an origin owns itself."""
    grid = Grid(tx, ty, r)
    asked = grid.ask(x, y)
    n = len(x)
    out = np.full(n, n, np.int64)
    if asked[1] <= MOST_PAIRS:
        src, dst = pairs(x, y, tx, ty, r, asked, grid)
        own = decide(n, src, dst)
        hit = own[src]
        np.minimum.at(out, dst[hit], src[hit])
    else:
        own = origins(x, y, tx, ty, r)
        first = np.flatnonzero(own)
        for o, v in grid.near(x[first], y[first]):
            after = first[o] < v
            np.minimum.at(out, v[after], first[o[after]])
    out[own] = np.flatnonzero(own)
    return out


def distinct_places(level: dict) -> tuple[np.ndarray, np.ndarray]:
    """First node at every place, and for each node the position of its place among those."""
    # Equal places have equal keys; should different places share one, a place may be split, which does no harm.
    x, y = level["x"], level["y"]
    order = np.argsort(x.view(np.int64) * 0x9E3779B9 ^ y.view(np.int64), kind="stable")
    x, y = x[order], y[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    if new.all():
        return np.arange(len(x)), np.arange(len(x))
    group = np.empty(len(x), np.int64)
    group[order] = np.cumsum(new) - 1
    first = order[new]
    rank = np.empty(len(first), np.int64)
    kept = np.argsort(first, kind="stable")
    rank[kept] = np.arange(len(first))
    return first[kept], rank[group]


def coarser(level: dict, zoom: int, radius: float, extent: float, min_points: int, num_rows: int) -> tuple[dict, np.ndarray]:
    """(nodes of ``zoom``, parent ids of the nodes of ``level``; -1 for none). Nodes are in order of seq."""
    n = len(level["x"])
    r = radius / (extent * 2.0**zoom)
    first, place = distinct_places(level)
    part = {k: v[first] for k, v in level.items()}
    own = first[owners(part["x"], part["y"], part["tx"], part["ty"], r)][place]
    order = np.lexsort((np.arange(n), own))
    o = own[order]
    start = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1]))) if n else np.zeros(0, np.int64)
    group = np.cumsum(np.concatenate(([1], (o[1:] != o[:-1]).astype(np.int64)))) - 1 if n else np.zeros(0, np.int64)
    count = np.bincount(group, minlength=len(start))
    w = level["num_points"][order]
    total = np.bincount(group, w, len(start)).astype(np.int64)
    merged = (count > 1) & (total >= min_points)
    # bincount adds in this order, origin first: the sums are those of a pass node by node.
    cx = np.bincount(group, level["x"][order] * w, len(start)) / np.maximum(total, 1)
    cy = np.bincount(group, level["y"][order] * w, len(start)) / np.maximum(total, 1)
    keep = ~merged[group]
    lead = np.zeros(n, bool)
    lead[start] = True
    chosen = keep | lead
    g, at = group[chosen], order[chosen]
    m = merged[g]
    ids = (o[start].astype(np.int64) << 5) + zoom + 1 + num_rows
    out = {
        "seq": np.arange(len(at)),
        "node_id": np.where(m, ids[g], level["node_id"][at]),
        "x": np.where(m, cx[g], level["x"][at]),
        "y": np.where(m, cy[g], level["y"][at]),
        "num_points": np.where(m, total[g], level["num_points"][at]),
        "lng": np.where(m, np.nan, level["lng"][at]),
        "lat": np.where(m, np.nan, level["lat"][at]),
    }
    out["tx"], out["ty"] = (out[k].astype(np.float32).astype(np.float64) for k in ("x", "y"))
    parent = np.full(n, -1, np.int64)
    parent[order] = np.where(merged[group], ids[group], -1)
    return out, parent
