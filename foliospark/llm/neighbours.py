"""The most similar vectors for every vector (problem 3).

Vectors are divided into cells around centroids fitted on a bounded sample. Within a cell each vector is one bit a
dimension after a random rotation, with correction scalars; inner products are estimated from packed bits, and error
bounds choose the vectors whose exact product is computed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliospark.functions.vectors import is_usable

# Fitting: vectors a cell, vectors at most in the sample, cells at most (8 MB of centroids, which are broadcast), and cells
# above which centroids are fitted and looked up by way of heads. The sample gives dense regions as many cells as they
# need; beyond 4 million vectors cells hold more than ``CELL``, at 45 million some 1,400.
CELL, SAMPLE, MAX_CELLS, PLAIN = 128, 65536, 32768, 1024
# Cells of a group that is searched together, members of a group above which it is cut into blocks, cells each query
# looks into, and heads whose cells are looked through for them.
GROUP, BLOCK, PROBES, HEADS = 32, 131072, 8, 24
# Error bound of the estimates in standard deviations, and bits a value of the query.
EPSILON, QUERY_BITS = 1.9, 4


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c, 1)[:, 0]
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(n > 0, total / np.where(n > 0, n, 1), c)
    return c.astype(np.float32)


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k centroids with the largest inner product, best first."""
    out = np.empty((len(x), k), dtype=np.int32)
    for i in range(0, len(x), 2048):
        s = x[i : i + 2048] @ c.T
        if k == 1:
            out[i : i + 2048, 0] = s.argmax(axis=1)
            continue
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[i : i + 2048] = np.take_along_axis(top, order, 1)
    return out


class Cells:
    """Centroids, the groups of neighbouring centroids, and the rotation."""

    def __init__(self, sample: np.ndarray, count: int, dim: int):
        k = int(min(max(1, count // CELL), MAX_CELLS, max(1, len(sample) // 2)))
        self.centroids = self._fit(sample, k) if len(sample) else np.zeros((1, dim), np.float32)
        g = max(1, -(-len(self.centroids) // GROUP))
        self.heads = _kmeans(self.centroids, g, 6, 2) if g > 1 else self.centroids[:1]
        self.group = _nearest(self.centroids, self.heads, 1)[:, 0] if g > 1 else np.zeros(len(self.centroids), dtype=np.int32)
        # Empty and equal centroids would take places among the cells that a query looks into.
        if len(sample):
            used = np.unique(self.nearest(sample, 1)[:, 0])
            self.centroids, first = np.unique(self.centroids[used], axis=0, return_index=True)
            self.group = self.group[used][first]
        # Blocks of each group by its members, as counted in the sample.
        members = np.bincount(self.group[self.nearest(sample, 1)[:, 0]], minlength=len(self.heads)) if len(sample) else np.zeros(1)
        self.blocks = np.maximum(1, np.ceil(members * (count / max(1, len(sample))) / BLOCK)).astype(np.int64)
        self.rotation = np.linalg.qr(np.random.default_rng(3).standard_normal((dim, dim)))[0].astype(np.float32)

    @staticmethod
    def _fit(sample: np.ndarray, k: int) -> np.ndarray:
        """k centroids; many of them in two steps, each head's share of them by its share of the sample."""
        if k <= PLAIN:
            return _kmeans(sample, k, 4, 1)
        heads = _kmeans(sample, max(2, k // 128), 4, 1)
        home = _nearest(sample, heads, 1)[:, 0]
        order = np.argsort(home, kind="stable")
        parts = [p for p in np.split(sample[order], np.cumsum(np.bincount(home, minlength=len(heads)))[:-1]) if len(p)]
        return np.concatenate([_kmeans(p, min(len(p), max(1, round(k * len(p) / len(sample)))), 4, 4) for p in parts])

    def nearest(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k cells with the largest inner product, best first; where there are many, among those of the nearest heads."""
        k = min(k, len(self.centroids))
        if len(self.centroids) <= PLAIN or len(self.heads) <= HEADS:
            return _nearest(x, self.centroids, k)
        out = np.empty((len(x), k), dtype=np.int32)
        cells = [np.flatnonzero(self.group == g) for g in range(len(self.heads))]
        for i in range(0, len(x), 8192):
            part = x[i : i + 8192]
            near = _nearest(part, self.heads, HEADS)
            best, at = np.full((len(part), k), -9, dtype=np.float32), np.zeros((len(part), k), dtype=np.int32)
            for g in np.unique(near).tolist():
                rows = np.flatnonzero((near == g).any(axis=1))
                if not len(cells[g]):
                    continue
                s = np.concatenate([best[rows], part[rows] @ self.centroids[cells[g]].T], axis=1)
                ids = np.concatenate([at[rows], np.broadcast_to(cells[g].astype(np.int32), (len(rows), len(cells[g])))], axis=1)
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                best[rows], at[rows] = np.take_along_axis(s, top, 1), np.take_along_axis(ids, top, 1)
            out[i : i + 8192] = at
        return out


def _pack(bits: np.ndarray) -> np.ndarray:
    """Bits of the last axis as 64-bit words."""
    pad = -bits.shape[-1] % 64
    if pad:
        bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), dtype=bits.dtype)], axis=-1)
    return np.packbits(bits, axis=-1).view(np.uint64)


class Codes:
    """The members of one cell as packed bits with their correction scalars."""

    def __init__(self, members: np.ndarray, centroid: np.ndarray, rotation: np.ndarray):
        self.dim = members.shape[1]
        r = members - centroid
        self.norm = np.linalg.norm(r, axis=1)
        unit = r / np.where(self.norm > 0, self.norm, 1)[:, None]
        turned = unit @ rotation
        bits = turned > 0
        self.bits = _pack(bits)
        self.ones = bits.sum(axis=1).astype(np.float32)
        # Inner product of the unit residual with its own code, and with the centroid.
        self.own = np.maximum(np.abs(turned).sum(axis=1) / math.sqrt(self.dim), 1e-3)
        self.with_centroid = unit @ centroid
        self.error = np.sqrt(np.maximum(0, 1 - self.own**2)) / self.own * (EPSILON / math.sqrt(max(1, self.dim - 1)))

    def estimate(self, queries: np.ndarray, centroid: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of queries and members, and how far off they may be."""
        rq = queries - centroid
        turned = rq @ rotation
        low = turned.min(axis=1, keepdims=True)
        step = np.maximum(turned.max(axis=1, keepdims=True) - low, 1e-9) / (2**QUERY_BITS - 1)
        level = np.rint((turned - low) / step).astype(np.uint8)
        both = np.zeros((len(queries), len(self.bits)), dtype=np.float32)
        for b in range(QUERY_BITS):
            plane = _pack((level >> b) & 1)
            for w in range(plane.shape[1]):
                both += np.float32(1 << b) * np.bitwise_count(plane[:, w : w + 1] & self.bits[:, w])
        # Sum over the dimensions of (2 bit - 1) * (low + step * level), over the root of the dimension.
        scale = self.norm / self.own / math.sqrt(self.dim)
        both *= 2 * step * scale
        both += low * (2 * self.ones * scale)
        both -= (low * self.dim + step * level.sum(axis=1, keepdims=True, dtype=np.float32)) * scale
        both += (queries @ centroid)[:, None] + self.norm * self.with_centroid
        slack = np.linalg.norm(rq, axis=1)[:, None] * (self.norm * self.error) + step * (math.sqrt(self.dim) / 8 * self.norm / self.own)
        return both, slack


def search_group(h: np.ndarray, x: np.ndarray, member: np.ndarray, probes: np.ndarray, cells: Cells, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, member hash, inner product): the k best members of one group for each row.

    ``member`` tells which rows are members here, of the first cell of their ``probes``; every row is a query that looks
    into the cells of its probes, -1 being none.
    """
    home = probes[:, 0]
    rows_of = {int(c): np.flatnonzero(member & (home == c)) for c in np.unique(home[member])}
    owner, column = np.nonzero(probes >= 0)
    flat = probes[owner, column]
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    best, best_h = np.full((len(x), k), -9, dtype=np.float32), np.zeros((len(x), k), dtype=np.int64)
    codes = {c: [Codes(x[rows[j : j + 4096]], cells.centroids[c], cells.rotation) for j in range(0, len(rows), 4096)] for c, rows in rows_of.items()}
    # Members first look into their own cell; the k-th product found there spares them most of the others.
    for first in (True, False):
        for c, rows in rows_of.items():
            lo, hi = np.searchsorted(flat, [c, c + 1])
            asking = owner[lo:hi]
            own = member[asking] & (home[asking] == c)
            asking = asking[own if first else ~own]
            for i in range(0, len(asking), 1024):
                q = asking[i : i + 1024]
                for j, piece in enumerate(codes[c]):
                    part = rows[j * 4096 : (j + 1) * 4096]
                    est, slack = piece.estimate(x[q], cells.centroids[c], cells.rotation)
                    _keep_best(q, part, est, slack, x, h, best, best_h, k)
    at, i = np.nonzero(best > -9)
    return at, best_h[at, i], best[at, i]


def _keep_best(q, part, est, slack, x, h, best, best_h, k: int) -> None:
    """Exact products of the members that may be among the k best of their queries, and the new k best."""
    least = best[q, k - 1].copy()
    if len(part) > k:
        # Nothing known of a query yet: k other members reach the (k + 1)-th lower bound, whichever is the query itself.
        new = np.flatnonzero(least == -9)
        if len(new):
            low = est[new] - slack[new]
            least[new] = np.partition(low, len(part) - k - 1, axis=1)[:, len(part) - k - 1]
    a, b = np.nonzero(est + slack >= least[:, None])
    keep = h[q[a]] != h[part[b]]
    a, b = a[keep], b[keep]
    if not len(a):
        return
    sims = np.einsum("ij,ij->i", x[q[a]], x[part[b]])
    rank_of = np.flatnonzero(np.bincount(a, minlength=len(q)))
    place = np.zeros(len(q), dtype=np.int64)
    place[rank_of] = np.arange(len(rank_of))
    start = np.searchsorted(a, rank_of)
    width = int(np.bincount(a).max())
    s = np.full((len(rank_of), k + width), -9, dtype=np.float32)
    hh = np.zeros((len(rank_of), k + width), dtype=np.int64)
    s[:, :k], hh[:, :k] = best[q[rank_of]], best_h[q[rank_of]]
    row = place[a]
    col = k + np.arange(len(a)) - start[row]
    s[row, col], hh[row, col] = sims, h[part[b]]
    order = np.lexsort((hh, -s), axis=-1)[:, :k]
    best[q[rank_of]], best_h[q[rank_of]] = np.take_along_axis(s, order, 1), np.take_along_axis(hh, order, 1)


def nearest_neighbours(rows: DataFrame, k: int = 5, dim: int = 64) -> DataFrame:
    """(chunk_id, neighbour_id, similarity): for every usable vector the ``k`` others with the highest cosine.

    ``rows`` has (chunk_id, embedding, indexed_at); of repeated chunk_ids the latest row counts. Null vectors, wrong
    lengths, values that are not finite and all-zero vectors take no part. Equal vectors are searched once and expanded
    at the end, at most k + 1 of them for each; ties go to the smaller hash, then id. An empty table gives no rows.

    Each vector is sent once to every group of cells it looks into, about three times in all. The number of cells grows
    with the table and with the density of its regions, up to ``MAX_CELLS``. Groups of more than ``BLOCK`` members, as
    counted in the sample, are cut into blocks of members, each searched by all queries of the group.
    """
    spark = rows.sparkSession
    usable = rows.where(is_usable(F.col("embedding"), dim)).select("chunk_id", "indexed_at", F.xxhash64("embedding").alias("h"), "embedding")
    ids = usable.groupBy("chunk_id").agg(F.max_by("h", F.struct("indexed_at", "h")).alias("h"))
    current = ids.select("h").distinct()
    vectors = usable.groupBy("h").agg(F.first("embedding").alias("embedding")).join(current, "h", "left_semi")

    # Copies of a vector count once here too, so that a frequent one does not take the places of others.
    n = current.count()
    share = max(1, -(-n // SAMPLE))
    sample = vectors.where(F.pmod(F.col("h"), F.lit(share)) == 0).orderBy("h").select("embedding").toPandas()["embedding"]
    x = np.stack(sample.to_numpy()).astype(np.float32) if len(sample) else np.zeros((0, dim), np.float32)
    cells = Cells(x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x, n, dim)
    sent = spark.sparkContext.broadcast(cells)

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        probes = min(PROBES, len(c.centroids))
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf["embedding"].to_numpy()).astype(np.float32)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            near = c.nearest(v, probes)
            groups = c.group[near]
            raw = [r.tobytes() for r in v]
            hs = pdf["h"].to_numpy()
            out_g, out_i = [], []
            for j in range(probes):
                new = np.ones(len(v), dtype=bool)
                for p in range(j):
                    new &= groups[:, j] != groups[:, p]
                i = np.flatnonzero(new)
                out_g.append(groups[i, j])
                out_i.append(i)
            g, i = np.concatenate(out_g), np.concatenate(out_i)
            order = np.argsort(i, kind="stable")
            g, i = g[order], i[order]
            # Large groups are cut into blocks of members, each searched by all queries of the group.
            count = c.blocks[g]
            b = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            g, i = np.repeat(g, count), np.repeat(i, count)
            member = (g == groups[i, 0]) & (hs[i] % c.blocks[g] == b)
            here = np.where(groups[i] == g[:, None], near[i], -1).astype(np.int32)
            yield pd.DataFrame({"g": g, "b": b, "member": member, "h": hs[i], "cells": [r.tobytes() for r in here], "v": [raw[t] for t in i]})

    sent_rows = vectors.mapInPandas(visits, "g int, b long, member boolean, h long, cells binary, v binary")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        c = sent.value
        v = np.frombuffer(b"".join(pdf["v"]), dtype=np.float32).reshape(len(pdf), dim)
        probes = np.frombuffer(b"".join(pdf["cells"]), dtype=np.int32).reshape(len(pdf), -1)
        h = pdf["h"].to_numpy()
        at, of, sims = search_group(h, v, pdf["member"].to_numpy(), probes, c, k)
        return pd.DataFrame({"h": h[at], "nh": of, "similarity": sims.astype(np.float64)})

    found = sent_rows.groupBy("g", "b").applyInPandas(search, "h long, nh long, similarity double")
    w = W.partitionBy("h").orderBy(F.desc("similarity"), "nh")
    best = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")

    # Equal vectors: the first k + 1 ids of each stand for all; further copies have the first ones as neighbours.
    numbered = ids.withColumn("rn", F.row_number().over(W.partitionBy("h").orderBy("chunk_id"))).where(F.col("rn") <= k + 1)
    copies = numbered.alias("a").join(numbered.select("h", F.col("chunk_id").alias("neighbour_id")).alias("b"), "h").where("chunk_id <> neighbour_id").select("chunk_id", "neighbour_id", F.lit(1.0).alias("similarity"))
    many = numbered.where(F.col("rn") == k + 1).select("h")
    first = numbered.where(F.col("rn") <= k).select("h", F.col("chunk_id").alias("neighbour_id"))
    rest = ids.join(many, "h", "left_semi").join(numbered.select("chunk_id"), "chunk_id", "left_anti").join(first, "h").select("chunk_id", "neighbour_id", F.lit(1.0).alias("similarity"))
    others = best.join(numbered.select("h", "chunk_id"), "h").join(numbered.where(F.col("rn") <= k).select(F.col("h").alias("nh"), F.col("chunk_id").alias("neighbour_id")), "nh").select("chunk_id", "neighbour_id", "similarity")
    top = W.partitionBy("chunk_id").orderBy(F.desc("similarity"), "neighbour_id")
    return others.unionByName(copies).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r").unionByName(rest)
