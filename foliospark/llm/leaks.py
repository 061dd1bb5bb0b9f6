"""Evaluation passages inside training documents (problem 7).

All character n-grams of the folded sentences of the passages are a hash set that is broadcast; the windows of every
document are looked up in it. Where a document shares enough windows with a sentence, and the sentence after it may stand
next to it, both are verified by edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.filters import key_filter, passes
from foliospark.llm.sentences import split
from foliospark.llm.unify import Rewriter, representatives
from foliospark.session import checkpointed

# Items whose n-grams are broadcast together: some 500 n-grams of 16 bytes an item, so 40 MB a block.
ITEM_BLOCK = 5000
# A sentence is found if the edit distance is at most this part of its length, or if only its longest word may differ and
# that is at most the second part; one of two sentences must keep within the first.
TOLERANCE, ONE_WORD = 0.25, 0.45
# So many windows in a row count as shared, and so much of a sentence's windows must be shared, or less where a changed
# word leaves less; of one of two sentences, as many as one changed word leaves.
ROW, SHARE = 4, 0.4
SLACK = 40
_NOT_TEXT = re.compile(r"[^\p{L}\p{N}\p{M}]+")
_WIDE = re.compile(r"[ऀ-๿぀-ヿ一-鿿가-힣]")
_P = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 20) - 1


def folder():
    """A function that folds look-alikes, case, punctuation and spacing."""
    rewrite = Rewriter(representatives({}) | {})

    def fold(text: str | None) -> str:
        return _NOT_TEXT.sub("", rewrite(text).casefold()) if text else ""

    return fold


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every window of n code points."""
    if len(codes) < n:
        return np.empty(0, dtype=np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(c) - n + 1, dtype=np.uint64)
    for i in range(n):
        h = (h ^ c[i : len(c) - n + 1 + i]) * _P
        h ^= h >> np.uint64(29)
    return h


def gram_size(sentence: str) -> int:
    """Windows of 10 code points, of 5 in scripts whose characters say more."""
    return 5 if len(_WIDE.findall(sentence)) * 2 > len(sentence) else 10


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def sentences_of(items: list[tuple[int, str | None, str | None]]) -> list[tuple[int, int, str, int]]:
    """(item, place, folded sentence, length of its longest word) of the sentences of items."""
    fold, out = folder(), []
    for item_id, passage, language in items:
        folded = [(f, max((len(fold(w)) for w in x.split()), default=0)) for x in split(passage, language) if (f := fold(x))]
        out += [(item_id, i, f, longest) for i, (f, longest) in enumerate(folded)]
    return out


def grams_of(texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By n-gram size: (hash, number of the text, offset) of all n-grams; texts shorter than the size give one of their length."""
    groups: dict[int, list[int]] = {}
    for k, s in enumerate(texts):
        groups.setdefault(min(gram_size(s), len(s)), []).append(k)
    out = {}
    for n, ks in groups.items():
        h = [window_hashes(codes_of(texts[k]), n) for k in ks]
        count = [len(x) for x in h]
        out[n] = np.concatenate(h), np.repeat(np.array(ks), count), np.concatenate([np.arange(c) for c in count])
    return out


def in_rows(hit: np.ndarray, row: int) -> np.ndarray:
    """Those of ``hit`` that stand in ``row`` or more in a row."""
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
    out = np.zeros(len(hit), dtype=bool)
    for a, b in edge.reshape(-1, 2)[np.diff(edge.reshape(-1, 2), axis=1)[:, 0] >= row].tolist():
        out[a:b] = True
    return out


class Index:
    """The n-grams of a block of items: hash to (sentence, offset)."""

    def __init__(self, sentences: list[tuple[int, int, str, int]]):
        self.item, self.place, self.sentences, self.longest = ([x[i] for x in sentences] for i in range(4))
        self.length = np.array([len(s) for s in self.sentences], dtype=np.int64)
        size = np.array([min(gram_size(s), len(s)) for s in self.sentences], dtype=np.int64)
        windows = self.length - size + 1
        self.left = np.maximum(windows - np.array(self.longest, dtype=np.int64).clip(max=np.maximum(self.length // 4, 1)) - size - 2, np.minimum(ROW, windows))
        # Whether a changed word surely leaves windows in a row, on one side of it.
        self.tells = windows >= 2 * ROW + np.array(self.longest, dtype=np.int64).clip(max=np.maximum(self.length // 4, 1)) + size
        self.least = np.minimum(SHARE * windows, self.left)
        self.tables = {}
        for n, (h, k, offset) in grams_of(self.sentences).items():
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            bits = np.zeros(_MASK + 1, dtype=bool)
            bits[(keys & np.uint64(_MASK)).astype(np.int64)] = True
            self.tables[n] = keys, np.r_[first, len(h)], k[order].astype(np.int32), offset[order].astype(np.int32), bits

    def search(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(number of the text, item_id) of the folded texts that hold two consecutive sentences of an item."""
        joined = codes_of("\0".join(texts))
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        where: dict[tuple[int, int], list[int]] = {}
        strong: set[tuple[int, int]] = set()
        for n, (keys, starts, sentence, offset, bits) in self.tables.items():
            h = window_hashes(joined, n)
            hit = bits[(h & np.uint64(_MASK)).astype(np.int64)]
            row = ROW if n in (5, 10) else 1
            maybe = np.flatnonzero(in_rows(hit, row))
            at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
            true = keys[at] == h[maybe]
            maybe, at = maybe[true], at[true]
            count = starts[at + 1] - starts[at]
            entry = np.repeat(starts[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            k, pos = sentence[entry].astype(np.int64), np.repeat(maybe, count)
            begin = pos - offset[entry]
            # Windows of one sentence in a row stand at one place of its beginning.
            need = np.minimum(row, np.maximum(1, self.length - n + 1))
            key = k << np.int64(40) | begin + np.int64(1 << 20)
            slot = (key * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) >> np.int64(44) & np.int64(_MASK)
            key = key[np.bincount(slot, minlength=_MASK + 1)[slot] >= need[k]]
            place, number = np.unique(key, return_counts=True)
            good = number >= need[place >> np.int64(40)]
            place, number = place[good], number[good]
            k, begin = place >> np.int64(40), (place & np.int64((1 << 40) - 1)) - np.int64(1 << 20)
            doc = np.searchsorted(bounds, np.maximum(begin + self.length[k] // 2, 0), side="right") - 1
            doc = np.minimum(doc, len(texts) - 1)
            # Shared windows of a sentence around a place, wherever a word more or less has moved them.
            sums = np.r_[0, np.cumsum(number)]
            shared = sums[np.searchsorted(place, place + SLACK, side="right")] - sums[np.searchsorted(place, place - SLACK)]
            enough, sure = shared >= self.least[k], shared >= self.left[k]
            strong.update(zip(doc[sure].tolist(), k[sure].tolist()))
            for t, s, a in zip(doc[enough].tolist(), k[enough].tolist(), begin[enough].tolist()):
                where.setdefault((t, s), []).append(a - int(bounds[t]))
        done = set()
        for (t, s), begins in where.items():
            for first in (s - 1, s):
                if first < 0 or first + 1 >= len(self.item) or self.item[first] != self.item[first + 1] or (t, self.item[s]) in done:
                    continue
                other = s - 1 if first < s else s + 1
                if (t, s) not in strong and (t, other) not in strong:
                    continue
                # The other sentence shares windows beside it as well, unless it is too short to tell.
                step, near = int(self.length[first]) * (1 if first == s else -1), where.get((t, other), ())
                if self.tells[other]:
                    begins = [a for a in begins if any(abs(b - a - step) <= SLACK + abs(step) // 5 for b in near)]
                if any(self._verify(texts[t], first, a if first == s else a + step) for a in _apart(begins)):
                    done.add((t, self.item[s]))
                    yield t, self.item[s]

    def _verify(self, text: str, k: int, start: int) -> bool:
        s, nxt = self.sentences[k], self.sentences[k + 1]
        a = max(0, start - SLACK - len(s) // 4)
        dist, end = best_match(s, text[a : max(0, start) + len(s) + SLACK + len(s) // 4])
        loose = [max(TOLERANCE * len(x), min(self.longest[k + i] + 1, ONE_WORD * len(x))) for i, x in enumerate((s, nxt))]
        if dist > loose[0]:
            return False
        b = a + end
        after, _ = best_match(nxt, text[max(0, b - 5) : b + len(nxt) + SLACK + len(nxt) // 4])
        return after <= loose[1] and (dist <= TOLERANCE * len(s) or after <= TOLERANCE * len(nxt))


def _apart(begins: list[int]) -> list[int]:
    """Places without those that the same look around covers."""
    out: list[int] = []
    for a in sorted(set(begins)):
        if not out or a - out[-1] > SLACK // 2:
            out.append(a)
    return out


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any part of the text, and where that part ends; bit-parallel."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def find_leaks(documents: DataFrame, items: DataFrame, block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id): documents that hold at least two consecutive sentences of an item's passage, in order.

    Null and empty texts or passages have no cases, nor have passages of one sentence. The corpus is read once, without a
    shuffle. Items are indexed in blocks of at most about ``block``; where there are several, a filter of all their n-grams, of a
    fixed size, chooses the documents that share some windows in a row, and only these are looked up block by block. Only
    the found pairs are shuffled, to drop repeated ones.
    """
    spark = documents.sparkSession

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = sentences_of(list(zip(pdf["item_id"], pdf["passage"], pdf["language"])))
            yield pd.DataFrame(rows, columns=["item_id", "place", "sentence", "longest"]).astype({"item_id": "int64", "place": "int32", "longest": "int32"})

    it = items.where("passage IS NOT NULL").select("item_id", "passage", "language").groupBy("item_id").agg(F.max(F.struct("passage", "language")).alias("p")).select("item_id", "p.*")
    cuts = checkpointed(it.mapInPandas(cut, "item_id long, place int, sentence string, longest int"))
    blocks = max(1, -(-it.count() // block))
    docs = documents.select("doc_id", "text").where("text IS NOT NULL")

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[str]]]:
        fold = folder()
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                yield part["doc_id"].to_numpy(), [fold(t) for t in part["text"]]

    if blocks > 1:

        def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for n, (h, _, _) in grams_of(pdf["sentence"].tolist()).items():
                    yield pd.DataFrame({"n": n, "key": h.view(np.int64)}).drop_duplicates().astype({"n": "int32"})

        g = checkpointed(cuts.mapInPandas(grams, "n int, key long"))
        sizes = [r["n"] for r in g.select("n").distinct().collect()]
        has = spark.sparkContext.broadcast({n: key_filter(g.where(F.col("n") == n)) if n in (5, 10) else None for n in sizes})

        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for ids, texts in folded(batches):
                kept = [any(f is None or in_rows(passes(f, window_hashes(codes_of(t), n).view(np.int64)), ROW).any() for n, f in has.value.items()) for t in texts]
                yield pd.DataFrame({"doc_id": ids[kept], "text": [t for t, x in zip(texts, kept) if x]})

        docs = checkpointed(docs.mapInPandas(choose, "doc_id long, text string"))

    out = spark.createDataFrame([], "doc_id long, item_id long")
    for b in range(blocks):
        rows = cuts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "place").collect()
        index = spark.sparkContext.broadcast(Index([tuple(r) for r in rows]))

        def scan(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            parts = folded(batches) if blocks == 1 else ((p["doc_id"].to_numpy(), p["text"].tolist()) for p in batches)
            for ids, texts in parts:
                found = list(index.value.search(texts)) if texts else []
                if found:
                    yield pd.DataFrame({"doc_id": [ids[t] for t, _ in found], "item_id": [x for _, x in found]})

        out = out.unionByName(docs.mapInPandas(scan, "doc_id long, item_id long"))
    return out.distinct()
