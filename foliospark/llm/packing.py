"""Filling containers of one capacity with texts (problem 6).

Texts are measured in tokens of a public tokenizer and spread over shards; each shard fixes small sets that provably
dominate every alternative (dominance reduction) and places the rest best-fit. Containers that stay open are emptied and
packed again together.
"""

from __future__ import annotations

import base64
from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import checkpointed

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Containers that one task packs, and how full one must be not to be opened again.
SHARD, FULL = 2000, 0.995


def encoder(path: str = VOCABULARY):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every text; null counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for pdf in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": n}).astype({"tokens": "int32"})

    return texts.select("doc_id", "text").mapInPandas(run, "doc_id long, tokens int")


class _Sizes:
    """A multiset of sizes with the look-ups that dominance asks for."""

    def __init__(self, sizes: list[int]):
        self.n: dict[int, int] = {}
        for s in sizes:
            self.n[s] = self.n.get(s, 0) + 1
        self.keys = sorted(self.n)

    def take(self, s: int) -> None:
        self.n[s] -= 1
        if not self.n[s]:
            del self.n[s]
            self.keys.pop(bisect_right(self.keys, s) - 1)

    def put(self, s: int) -> None:
        if s not in self.n:
            self.n[s] = 0
            insort(self.keys, s)
        self.n[s] += 1

    def most(self, limit: int) -> int:
        """The largest size up to a limit, 0 if there is none."""
        i = bisect_right(self.keys, limit)
        return self.keys[i - 1] if i else 0

    def least(self, count: int) -> int:
        """The sum of the smallest ``count`` sizes; very large if there are fewer."""
        total = 0
        for s in self.keys:
            k = min(count, self.n[s])
            total += k * s
            count -= k
            if not count:
                return total
        return 1 << 60


def dominating_sets(sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Sets that can be fixed without loss, and the sizes that are left.

    For each size j, largest first, with room r: j alone if nothing fits; j with the largest k that fits if k fills the room, if
    at most one more fits, or if at most two more fit and no two of them exceed k; j with k and the largest b that fits
    then, if at most two more fit and the smaller of any two that fit is at most b.
    """
    m, fixed = _Sizes(sizes), []
    j = m.most(capacity)
    while j:
        m.take(j)
        found = _dominating(m, capacity - j)
        if found is None:  # nor for further copies of j; what is not fixed stays among the alternatives
            m.put(j)
            j = m.most(j - 1)
            continue
        for s in found:
            m.take(s)
        fixed.append([j, *found])
        j = m.most(j)
    return fixed, [s for s in m.keys for _ in range(m.n[s])]


def _dominating(m: _Sizes, r: int) -> list[int] | None:
    """What fills the room r at least as well as any other choice, or None if that is not proved."""
    k = m.most(r)
    if not k:
        return []
    if k == r or m.least(2) > r:
        return [k]
    if m.least(3) <= r:
        return None
    m.take(k)
    b = m.most(r - k)
    m.put(k)
    best, small = 0, 0  # of two that fit: the largest sum, and the largest smaller one
    for s in [x for x in m.keys if 2 * x <= r]:
        m.take(s)
        p = m.most(r - s)
        m.put(s)
        if p >= s:
            best, small = max(best, s + p), s
    if best <= k:
        return [k]
    return [k, b] if b and b >= small else None


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Largest first, each into the fullest container that has room."""
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, []  # bit r of rooms: a container with room r is open
    for s in sorted(sizes, reverse=True):
        fit = rooms >> s
        if fit:
            r = s + ((fit & -fit).bit_length() - 1)
            c = at[r].pop()
            if not at[r]:
                rooms &= ~(1 << r)
            made[c].append(s)
        else:
            r, c = capacity, len(made)
            made.append([s])
        if r - s:
            at[r - s].append(c)
            rooms |= 1 << (r - s)
    return made


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """The sizes in containers of a capacity that none exceeds."""
    fixed, kept = dominating_sets(sizes, capacity)
    return fixed + best_fit(kept, capacity)


def fill_containers(texts: DataFrame, capacity: int = 2048, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, first_token, tokens, container): every text in a container, no container over the capacity.

    Texts longer than the capacity are cut into full pieces and a rest; others stay whole. Null and empty texts have no
    tokens and get no container. Repeated doc_ids count once, with the longest text. Shards hold some ``SHARD``
    containers, so no task packs more; containers less than ``FULL`` are opened and packed again until one shard holds
    what is open.
    """
    docs = count_tokens(texts, path).groupBy("doc_id").agg(F.max("tokens").alias("n")).where("n > 0")
    c = F.lit(capacity)
    cut = docs.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / c).cast("int"))))
    items = checkpointed(cut.select("doc_id", "piece", (F.col("piece") * c).alias("first_token"), F.least(c, F.col("n") - F.col("piece") * c).cast("int").alias("tokens")))
    done = items.where(F.col("tokens") == capacity).withColumn("container", F.concat_ws("-", F.lit("f"), "doc_id", "piece"))
    open_items, step = items.where(F.col("tokens") < capacity), 0
    names = "doc_id long, piece int, first_token int, tokens int, container string"
    while True:
        total = open_items.agg(F.sum("tokens")).first()[0] or 0
        shards = max(1, -(-total // (capacity * SHARD)))

        def place(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ignore_index=True)
            shard = int(pdf["shard"].iloc[0])
            rows: dict[int, list[int]] = {}
            for i, s in enumerate(pdf["tokens"].tolist()):
                rows.setdefault(s, []).append(i)
            name = [""] * len(pdf)
            for b, sizes in enumerate(pack(pdf["tokens"].tolist(), capacity)):
                for s in sizes:
                    name[rows[s].pop()] = f"{shard}-{b}"
            pdf["container"] = name
            return pdf[["doc_id", "piece", "first_token", "tokens", "container"]]

        packed = checkpointed(open_items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))).groupBy("shard").applyInPandas(place, names).withColumn("container", F.concat(F.lit(f"{step}-"), "container")))
        if shards == 1:
            return done.unionByName(packed)
        fill = packed.groupBy("container").agg(F.sum("tokens").alias("fill")).where(F.col("fill") >= FULL * capacity).select("container")
        done = done.unionByName(packed.join(fill, "container", "left_semi"))
        again = packed.join(fill, "container", "left_anti").drop("container")
        left = again.agg(F.sum("tokens")).first()[0] or 0
        if left == 0:
            return done
        if left > 0.9 * total:  # nothing gained by opening again
            return done.unionByName(packed.join(fill, "container", "left_anti"))
        open_items, step = again, step + 1
