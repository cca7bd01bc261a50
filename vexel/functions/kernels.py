"""NumPy kernels of the Arrow paths.

Candidates are found with a matrix product; those that can be among the nearest are scored again
element by element from left to right in double precision, as the column expressions do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .metrics import Metric


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """n x d doubles of an array column without nulls; ValueError if lengths differ."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros((0, 0))
    if col.null_count:
        raise ValueError("null vector")
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(flat) % n or len(flat) // n != len(col[0]) or (np.diff(col.offsets.to_numpy()) != len(flat) // n).any():
        raise ValueError("vectors of unequal length")
    return flat.reshape(n, -1)


def rough(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """len(q) x len(x) keys by one matrix product: the smaller the nearer, to rounding."""
    ip = q @ x.T
    if metric is Metric.INNER_PRODUCT:
        return -ip
    nq, nx = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
    if metric is Metric.COSINE:
        m = np.sqrt(nq[:, None] * nx)
        return 1 - ip / np.where(m == 0, 1, m)
    return nq[:, None] + nx - 2 * ip


def exact(metric: Metric, a: np.ndarray, b: np.ndarray, width: int = 0) -> np.ndarray:
    """Distances of row i of a to row i of b, summed from the first element on; with a width, sums of squares are taken for each so many elements and then added up."""
    n, d = a.shape
    s = np.zeros(n)
    if metric in (Metric.SUM_OF_SQUARES, Metric.L2):
        step = width or d or 1
        for j in range(0, d, step):
            part = np.zeros(n)
            for c in range(j, min(j + step, d)):
                t = a[:, c] - b[:, c]
                part += t * t
            s += part
        return np.sqrt(s) if metric is Metric.L2 else s
    for j in range(d):
        s += a[:, j] * b[:, j]
    if metric is Metric.INNER_PRODUCT:
        return s
    na, nb = np.zeros(n), np.zeros(n)
    for j in range(d):
        na += a[:, j] * a[:, j]
        nb += b[:, j] * b[:, j]
    m = np.sqrt(na * nb)
    return 1 - s / np.where(m == 0, 1, m)


#: Pairs that are scored exactly at a time.
PAIRS = 1 << 15
#: Queries of one matrix product: its result stays in the processor's cache.
TILE = 256


class Scan:
    """A fixed set of queries against block after block of vectors: one matrix product a block, in single precision where its rounding leaves few pairs in doubt."""

    def __init__(self, metric: Metric, q: np.ndarray):
        self.metric, self.q = metric, q
        self.norm = np.einsum("ij,ij->i", q, q)
        self.square = metric in (Metric.SUM_OF_SQUARES, Metric.L2)
        side = _unit(q, self.norm) if metric is Metric.COSINE else q
        self.side = np.concatenate([side, np.ones((len(q), 1))], 1) if self.square else side
        self.clean = bool(np.isfinite(self.norm).all())
        self.single = self.side.astype(np.float32) if metric is Metric.COSINE or _in_range(self.norm) else None

    def keys_of(self, distance: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances as keys of the matrix product: the smaller the nearer."""
        if self.square:
            return (distance * distance if self.metric is Metric.L2 else distance) - self.norm[rows]
        return -distance if self.metric is Metric.INNER_PRODUCT else distance - 1

    def pairs(self, x: np.ndarray, bound: np.ndarray, rows: np.ndarray | None = None, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query row, x row) of all pairs whose key may be at most the query's bound, but for rounding. With k, an open bound (infinite) is first set from the k nearest of x. rows: the queries to look at."""
        norm = np.einsum("ij,ij->i", x, x)
        side = -_unit(x, norm) if self.metric is Metric.COSINE else np.concatenate([-2 * x, norm[:, None]], 1) if self.square else -x
        finite = norm[np.isfinite(norm)]
        size = 3.0 if self.metric is Metric.COSINE else (self.norm if rows is None else self.norm[rows]) + 2 * (finite.max() if len(finite) else 0.0)
        fits = self.single is not None and (self.metric is Metric.COSINE or _in_range(norm))
        own = bound if rows is None else bound[rows]
        slack0, clean = (x.shape[1] + 8) * size, len(finite) == len(norm)
        for kind in (np.float32, np.float64) if fits else (np.float64,):
            left = self.single if kind is np.float32 else self.side
            right = np.ascontiguousarray(side.T, kind)
            slack = np.broadcast_to(slack0 * np.finfo(kind).eps + np.finfo(kind).tiny, own.shape)
            limit, at, doubt = own + slack, [], 0
            for s in range(0, len(own), TILE):
                e = min(s + TILE, len(own))
                with np.errstate(invalid="ignore", over="ignore"):
                    keys = (left[s:e] if rows is None else left[rows[s:e]]) @ right
                    new = np.flatnonzero(np.isinf(own[s:e])) if k and len(x) > k else ()
                    if len(new):
                        limit[s + new] = np.partition(keys[new], k - 1, axis=1)[:, k - 1].astype(np.float64) + 2 * slack[s + new]
                    most = limit[s:e, None] if kind is np.float64 else np.nextafter(limit[s:e].astype(kind), np.float32(np.inf))[:, None]
                    at.append(np.flatnonzero(keys <= most if clean and self.clean else ~(keys > most)) + s * len(x))
                doubt += len(at[-1])
                if kind is np.float32 and doubt > max(4 * k * e, len(own) * len(x) // 16):
                    break  # many in doubt: again in doubles
            else:
                break
        if k and len(x) > k:
            own = np.where(np.isinf(own), limit - slack, own)
            bound[slice(None) if rows is None else rows] = own
        i, j = np.divmod(np.concatenate(at) if at else np.zeros(0, np.int64), len(x))
        return (i if rows is None else rows[i]), j

    def distances(self, i: np.ndarray, j: np.ndarray, x: np.ndarray, width: int = 0) -> np.ndarray:
        """Exact distances of the pairs."""
        return exact_pairs(self.metric, self.q, x, i, j, width)


def exact_pairs(metric: Metric, q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, width: int = 0) -> np.ndarray:
    """exact() of rows i of q to rows j of x, PAIRS at a time; columns are gathered one by one, so that no wide copy is made."""
    if metric not in (Metric.SUM_OF_SQUARES, Metric.L2) or len(i) < 64:
        got = [exact(metric, q[i[s : s + PAIRS]], x[j[s : s + PAIRS]], width) for s in range(0, len(i), PAIRS)]
        return np.concatenate(got) if got else np.zeros(0)
    out, d = np.zeros(len(i)), q.shape[1]
    qt, xt, step = np.ascontiguousarray(q.T), np.ascontiguousarray(x.T), width or d or 1
    for s in range(0, len(i), PAIRS):
        a, b = i[s : s + PAIRS], j[s : s + PAIRS]
        for w in range(0, d, step):
            part = np.zeros(len(a))
            for c in range(w, min(w + step, d)):
                t = qt[c].take(a)
                t -= xt[c].take(b)
                t *= t
                part += t
            out[s : s + PAIRS] += part
    return np.sqrt(out) if metric is Metric.L2 else out


def _unit(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    n = np.sqrt(norm)
    return x / np.where(n == 0, 1, n)[:, None]


def _in_range(norm: np.ndarray) -> bool:
    """Whether squares of these lengths can be taken in single precision."""
    return bool(np.isfinite(norm).all()) and (not len(norm) or 1e-20 < norm.max() < 1e30)


class Nearest(Scan):
    """A running top-k: the k nearest of each row of q among all blocks that were added, ties to the lesser id."""

    def __init__(self, metric: Metric, q: np.ndarray, k: int):
        super().__init__(metric, q)
        self.k, self.bound = k, np.full(len(q), np.inf)
        self.held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        self.new: list[list[np.ndarray]] = []
        self.waiting = 0

    def add(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None, width: int = 0, more=None) -> None:
        """x with its ids, for the queries of the given rows. more(i, j) gives an array that is kept with each pair, from its query and x rows."""
        if not len(x) or not len(self.q) or (rows is not None and not len(rows)):
            return
        i, j = self.pairs(x, self.bound, rows, self.k)
        d = self.distances(i, j, x, width)
        with np.errstate(invalid="ignore"):
            ok = np.flatnonzero(~(self.keys_of(d, i) > self.bound[i] + 1e-12 * (self.norm[i] + np.abs(d) + 1))) if len(d) else slice(0)
        i, j, d = i[ok], j[ok], d[ok]
        self.new.append([i, ids[j], d, *([more(i, j)] if more else [])])
        self.waiting += len(i)
        if self.waiting > max(1 << 16, len(self.held[0]) // 2):
            self._merge()

    def _merge(self) -> None:
        parts = [p for p in ([self.held] if len(self.held[0]) else []) + self.new if len(p[0])]
        self.new, self.waiting = [], 0
        if not parts:
            return
        both = [np.concatenate(c) for c in zip(*parts)]
        at = self._order(*both[:3])
        self.held = [c[at] for c in both]
        row = self.held[0]
        n = np.bincount(row, minlength=len(self.q))
        full = np.flatnonzero(n == self.k)
        last = np.cumsum(n)[full] - 1
        key = self.keys_of(self.held[2][last], full)
        self.bound[full] = np.where(np.isnan(key), np.inf, key)

    def _order(self, row: np.ndarray, ids: np.ndarray, d: np.ndarray) -> np.ndarray:
        """best() by two fast sorts; where distances are equal or no numbers, by best() itself."""
        if len(self.q) <= 1 << 16 and not np.isnan(d).any():
            order = np.argsort(-d if self.metric.descending else d)
            order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
            r, v, e = row[order], d[order], ids[order]
            if not ((r[1:] == r[:-1]) & (v[1:] == v[:-1]) & (e[1:] < e[:-1])).any():
                n = np.bincount(r, minlength=len(self.q))
                return order[np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) < self.k]
        return best(self.metric, row, ids, d, self.k)

    def result(self) -> list[np.ndarray]:
        """[query row, id, distance, and what more() gave]."""
        self._merge()
        return self.held


def near(metric: Metric, q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, x row, distance) of all pairs that can be among the k nearest of the query: k and what is as near but for rounding."""
    if not len(q) or not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys = rough(metric, q, x)
    if len(x) > k:
        kth = np.partition(keys, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (np.abs(kth) + np.einsum("ij,ij->i", q, q) + float(np.einsum("ij,ij->i", x, x).max()) + 1)
        i, j = np.nonzero(keys <= (kth + slack)[:, None])
    else:
        i, j = np.divmod(np.arange(len(q) * len(x)), len(x))
    return i, j, exact(metric, q[i], x[j])


def best(metric: Metric, query: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest of each query, by distance, then id."""
    order = np.lexsort((ids, -dist if metric.descending else dist, query))
    q = query[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < k]


def nearest_row(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the nearest of c, its sum of squares) of each x; of equally near ones the first."""
    out, val = np.zeros(len(x), np.int64), np.zeros(len(x))
    for s in range(0, len(x), 4096):
        part = x[s : s + 4096]
        i, j, d = near(Metric.SUM_OF_SQUARES, part, c, 1)
        at = best(Metric.SUM_OF_SQUARES, i, j, d, 1)
        out[s : s + len(part)], val[s : s + len(part)] = j[at], d[at]
    return out, val


def lloyd(x: np.ndarray, c: np.ndarray, max_iter: int = 10, tol: float = 1e-4, reassign: float = 0.0) -> np.ndarray:
    """Centroids after Lloyd's iterations; empty ones stay, or with reassign > 0 the emptiest take over the worst placed vectors."""
    c = c.astype(np.float64).copy()
    for _ in range(max_iter):
        part, d = nearest_row(x, c)
        n = np.bincount(part, minlength=len(c))
        if reassign:
            poor = np.flatnonzero(n <= np.ceil(reassign * n.max()))
            far = np.argsort(-d, kind="stable")[: len(poor)]
            part[far] = poor[: len(far)]
            n = np.bincount(part, minlength=len(c))
        new = np.zeros_like(c)
        np.add.at(new, part, x)
        new = np.where(n[:, None] > 0, new / np.maximum(n, 1)[:, None], c)
        shift = np.einsum("ij,ij->i", new - c, new - c).max() if len(c) else 0
        c = new
        if shift < tol * np.einsum("ij,ij->", c, c):
            break
    return c


def kmeans_pp(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ start: each next centroid is drawn by squared distance to the nearest so far, the best of a few draws; surplus ones are zero."""
    rng = np.random.default_rng(seed)
    c = np.zeros((k, x.shape[1]))
    if not len(x):
        return c

    def to(rows):
        t = x[None] - x[rows][:, None]
        return np.einsum("ijk,ijk->ij", t, t)

    first = rng.integers(len(x), size=1)
    c[0], d = x[first[0]], to(first)[0]
    for i in range(1, min(k, len(x))):
        draws = rng.choice(len(x), size=2 + int(np.log(k)), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x), size=1)
        new = np.minimum(d, to(draws))
        best_ = int(new.sum(1).argmin())
        c[i], d = x[draws[best_]], new[best_]
    return c


def kmeans_start(x: np.ndarray, k: int, seed: int, starts: int = 8) -> np.ndarray:
    """The best of several k-means++ starts, by the cost after a few iterations."""
    if len(x) <= k:
        return kmeans_pp(x, k, seed)
    tries = [lloyd(x, kmeans_pp(x, k, seed + 1000 * i), 5, 0.0) for i in range(starts)]
    return min(tries, key=lambda c: float(nearest_row(x, c)[1].sum()))


def adc_tables(q: np.ndarray, book: np.ndarray) -> np.ndarray:
    """queries x subspaces x codes: sums of squares of each sub-vector to each sub-centroid (book: subspaces x codes x width)."""
    m, n, w = book.shape
    t = np.zeros((len(q), m, n))
    sub = q.reshape(len(q), m, w)
    for j in range(w):
        diff = sub[:, :, None, j] - book[None, :, :, j]
        t += diff * diff
    return t


#: Queries that walk side by side, bytes of their notes on what was seen, points that enter a graph together at most, and how far a node's list may grow before it is pruned.
WALKS, SEEN_BYTES, ENTER, SLACK = 256, 1 << 26, 256, 1.3


class Graph:
    """A neighbour graph over the rows of x as one matrix (n x width, padded with -1), walked by many queries side by side. COSINE is walked as sum of squares of vectors at length 1."""

    def __init__(self, metric: Metric, x: np.ndarray, width: int):
        self.cosine = metric is Metric.COSINE
        x = _unit(x, np.einsum("ij,ij->i", x, x)) if self.cosine else x
        self.mean = x.mean(0)
        x = x - self.mean
        norm = np.einsum("ij,ij->i", x, x)
        self.x = x.astype(np.float32) if _in_range(norm) else x
        self.nbrs, self.degree = np.full((len(x), width), -1, np.int32), np.zeros(len(x), np.int64)

    @classmethod
    def of(cls, metric: Metric, x: np.ndarray, node: np.ndarray, nbr: np.ndarray) -> Graph:
        """From edges; repeated ones count once."""
        order = np.lexsort((nbr, node))
        node, nbr = node[order], nbr[order]
        once = np.ones(len(node), bool)
        once[1:] = (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])
        node, nbr = node[once], nbr[once]
        n = np.bincount(node, minlength=len(x))
        g = cls(metric, x, int(n.max()) if len(node) else 1)
        g.nbrs[node, np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n)] = nbr
        g.degree = n
        return g

    def place(self, q: np.ndarray) -> np.ndarray:
        """Queries as the walk takes them."""
        return ((_unit(q, np.einsum("ij,ij->i", q, q)) if self.cosine else q) - self.mean).astype(self.x.dtype)

    def walk(self, q: np.ndarray, start: np.ndarray, width: int, visited: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walks of place()d queries: (the `width` nearest found, in no order, -1 where there are fewer; with `visited` the nodes gone on from, in order, else an empty array)."""
        n, b = len(self.x), len(q)
        seen = np.zeros((b, n), bool)
        wide = max(width, len(start))
        found, dist, open_ = np.full((b, wide), -1, np.int32), np.full((b, wide), np.inf, self.x.dtype), np.zeros((b, wide), bool)
        seen[:, start] = True
        found[:, : len(start)], open_[:, : len(start)] = start, True
        t = self.x[start][None] - q[:, None]
        dist[:, : len(start)] = np.einsum("ijk,ijk->ij", t, t)
        if wide > width:
            found, dist, open_ = _keep(found, dist, open_, width)
        path: list[np.ndarray] = []
        live = np.arange(b)
        while len(live):
            d = np.where(open_[live], dist[live], np.inf)
            at = d.argmin(1)
            go = open_[live, at]
            live, at = live[go], at[go]
            if not len(live):
                break
            node = found[live, at]
            open_[live, at] = False
            if visited:
                step = np.full(b, -1, np.int32)
                step[live] = node
                path.append(step)
            new = self.nbrs[node]
            r, c = np.nonzero((new >= 0) & ~seen[live[:, None], new])
            if not len(r):
                continue
            e, own = new[r, c], live[r]
            seen[own, e] = True
            t = self.x[e] - q[own]
            n_new = np.bincount(r, minlength=len(live))
            most = int(n_new.max())
            place = np.arange(len(r)) - np.repeat(np.cumsum(n_new) - n_new, n_new)
            more, far = np.full((len(live), most), -1, np.int32), np.full((len(live), most), np.inf, self.x.dtype)
            more[r, place], far[r, place] = e, np.einsum("ij,ij->i", t, t)
            f, d, o = _keep(np.concatenate([found[live], more], 1), np.concatenate([dist[live], far], 1), np.concatenate([open_[live], more >= 0], 1), width)
            found[live], dist[live], open_[live] = f, d, o
        return found, np.stack(path, 1) if path else np.zeros((b, 0), np.int32)

    def side_by_side(self, width: int) -> int:
        """How many queries may walk together."""
        return max(1, min(WALKS, SEEN_BYTES // max(1, len(self.x)), SEEN_BYTES // (16 * (width + self.nbrs.shape[1]))))

    def prune(self, p: np.ndarray, cand: np.ndarray, alpha: float, degree: int) -> np.ndarray:
        """len(p) x degree, padded with -1: of each row of candidates (padded too) the nearest first, each ruling out those it is alpha times nearer to than p is."""
        out = np.full((len(p), degree), -1, np.int32)
        step = max(1, (1 << 22) // max(1, cand.shape[1] ** 2))
        for s in range(0, len(p), step):
            own, c = p[s : s + step], cand[s : s + step]
            x = self.x[c]
            t = x - self.x[own][:, None]
            d = np.where((c < 0) | (c == own[:, None]), np.inf, np.einsum("ijk,ijk->ij", t, t))
            order = np.argsort(d, 1, kind="stable")
            c, d, x = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(x, order[:, :, None], 1)
            norm = np.einsum("ijk,ijk->ij", x, x)
            apart = alpha * (norm[:, :, None] + norm[:, None] - 2 * x @ x.transpose(0, 2, 1))
            alive, rows = np.isfinite(d), np.arange(len(own))
            for k in range(degree):
                at = alive.argmax(1)
                has = alive[rows, at]
                if not has.any():
                    break
                out[s : s + step, k] = np.where(has, c[rows, at], -1)
                alive &= (apart[rows, at] > d) & (c != c[rows, at][:, None]) | ~has[:, None]
                alive[rows[has], at[has]] = False
        return out

    def set(self, p: np.ndarray, nbrs: np.ndarray) -> None:
        self.nbrs[p] = -1
        self.nbrs[p, : nbrs.shape[1]] = nbrs
        self.degree[p] = (nbrs >= 0).sum(1)

    def link_back(self, src: np.ndarray, dst: np.ndarray, alpha: float, degree: int) -> None:
        """Adds src to the lists of dst, and prunes those that grow beyond the matrix."""
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        to, first, n = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, n)
        full = self.degree[to] + n > self.nbrs.shape[1]
        ok = ~np.repeat(full, n)
        self.nbrs[dst[ok], self.degree[dst[ok]] + place[ok]] = src[ok]
        self.degree[to[~full]] += n[~full]
        over, count = to[full], n[full]
        for s in range(0, len(over), 256):
            own = over[s : s + 256]
            cand = np.full((len(own), self.nbrs.shape[1] + int(count[s : s + 256].max())), -1, np.int32)
            cand[:, : self.nbrs.shape[1]] = self.nbrs[own]
            lo = np.searchsorted(own, dst)
            mine = (lo < len(own)) & (own[np.minimum(lo, len(own) - 1)] == dst)
            cand[lo[mine], self.nbrs.shape[1] + place[mine]] = src[mine]
            self.set(own, self.prune(own, cand, alpha, degree))


def _keep(found: np.ndarray, dist: np.ndarray, open_: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `width` nearest of each row."""
    if found.shape[1] <= width:
        return found, dist, open_
    at = np.argpartition(dist, width - 1, axis=1)[:, :width]
    return tuple(np.take_along_axis(v, at, 1) for v in (found, dist, open_))


def vamana(x: np.ndarray, degree: int, build_width: int, alpha: float, metric: Metric) -> tuple[list[np.ndarray], int]:
    """(neighbours of each row, medoid): vectors are searched for, pruned, and linked back, first one by one, then as many at a time as a fiftieth of the table, ENTER at most."""
    n = len(x)
    g = Graph(metric, x, int(degree * SLACK) + 1)
    t = g.x.astype(np.float64)
    medoid = int(np.einsum("ij,ij->i", t, t).argmin())
    todo = np.delete(np.arange(n), medoid)
    at, most = 0, max(1, min(ENTER, n // 50, g.side_by_side(build_width)))
    while at < len(todo):
        p = todo[at : at + max(1, min(most, at // 4))]
        at += len(p)
        _, visited = g.walk(g.x[p], np.array([medoid]), build_width, True)
        nbrs = g.prune(p, visited, alpha, degree)
        g.set(p, nbrs)
        r, c = np.nonzero(nbrs >= 0)
        g.link_back(p[r], nbrs[r, c], alpha, degree)
    over = np.flatnonzero(g.degree > degree)
    for s in range(0, len(over), 1024):
        g.set(over[s : s + 1024], g.prune(over[s : s + 1024], g.nbrs[over[s : s + 1024]], alpha, degree))
    nbrs = [v[v >= 0].astype(np.int64) for v in g.nbrs]
    # Whatever the walk from the medoid can't reach gets a link from the nearest node it can.
    reached = np.zeros(n, bool)
    left = [medoid]
    reached[medoid] = True
    for p in range(-1, n):
        if p >= 0 and not reached[p]:
            ok = np.flatnonzero(reached)
            d = g.x[ok] - g.x[p]
            near_ = int(ok[np.einsum("ij,ij->i", d, d).argmin()])
            nbrs[near_] = np.append(nbrs[near_], p)
            reached[p] = True
            left = [p]
        while left:
            new = nbrs[left.pop()]
            new = new[~reached[new]]
            reached[new] = True
            left += new.tolist()
    return nbrs, medoid
