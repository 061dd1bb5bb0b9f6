"""Repair of text from scanned pages (problem 2).

Lines at the edge of a page that recur on the pages beside it, and printed page numbers, are page furniture. Words that
only the layout breaks are joined. A word that is rare is looked up in the vocabulary of all pages: its Levenshtein
automaton, in which confusable shapes are cheap edits and others are allowed where the word has letters no other has in a
row, is intersected with the vocabulary trie, and the candidates are ranked by context. The trie holds the frequent words;
what it leaves out is joined to the pages by the same rules, so that the place of the cut changes no result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import regex as re
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foliospark.llm.filters import key_filter, passes
from foliospark.session import checkpointed, latest, shuffle_partitions

# Words (and character trigrams) that occur LEAST_COUNT times are the vocabulary. The trie holds those with at least this
# share, so it has 200,000 at most; the others are reached by a join that applies the same rules.
LEAST_SHARE, LEAST_COUNT = 5e-6, 6
# Letters follow each other in a language if words with this share have them; misread words grow with the table as others do.
USUAL_SHARE = 5e-6
# A word is taken for a misread one if a candidate is so many times as frequent; its own count is at most so many a
# document, as one document may repeat its error; pages recognised with less confidence do not vouch for words.
RATIO, PER_DOCUMENT, CONFIDENT = 8, 4, 0.5
# Candidates kept of a worker's recent words.
REMEMBERED = 50_000
EDGE = 3
# Shapes that scanners confuse, one group a line; each may stand for each other in its group.
SHAPES = """
e c o
a o
i l 1 j
l t
o 0 ö ó
o 6 0
s 5
g q 9
t f
h b
b 6
u v
n u
v y
z 2
b 8 ß
é e è ê
à a â ä
ç c
ü u
ï i î
ù u û
ô o
d a
m rn
m nn
w vv
u ii
ü ii
n ri
d cl
h li
k lc
b lo
ö ii
"""
# Kana and kanji that scanners confuse.
KANA_SHAPES = "シツ ソンリ ー一 タ夕 ロ口 カ力 エ工 ニ二 トト卜 ハ八 ヘへ バパ ビピ ブプ ベペ ボポ ばぱ めぬ るろ われね さちき はほ クケタ ワウフ コユ アマ テチ ナメ ノ丿 未末 土士 大太犬 人入 日目曰 間問聞 待持 録緑 検険 千干 輸輪 遠還 綱網 微徴"
_HYPHENS = "-‐‑¬­⁃"
_WIDE = re.compile(r"[\u1100-\u11ff\u2e80-\uffdc]")
_WORD = re.compile(r"[\p{L}\p{N}\p{M}]+(?:['’][\p{L}\p{N}\p{M}]+)*")
_NUMBER = re.compile(
    r"(?:page|seite|p\.|s\.|pg\.?|no\.?|제)?\s*[\[(<{|~*=·•.\-–—_\s]*([0-9lIOo|oSBＯ０-９]{1,5}|[ivxlcIVXLC]{1,9})[\])>}|~*=·•.\-–—_\s]*(?:\s*(?:쪽|페이지|ページ|頁|页|면))?(?:\s*(?:/|of|von|sur|de|-)\s*[0-9lIOoSB]{1,5})?\s*[\])>\-–—]*",
    re.IGNORECASE,
)


_ENDS = frozenset(_HYPHENS)
_ENDED = re.compile(r"[.!?。！？।,;:、，]['\"”’」』）)]*$")
_BROKEN = re.compile(rf"([\p{{L}}\p{{N}}'’]*\p{{L}})[{_HYPHENS}]+\s*$")
_KANA, _DIGIT, _ROMAN = re.compile(r"[ぁ-ヿ]"), re.compile(r"\d"), re.compile(r"[ivxlc]+")
_MISREAD_DIGITS = str.maketrans("lIOo|SB", "1100158")
_TAIL = re.compile(r"[\p{L}\p{N}\p{M}'’]+$")
_NEXT, _MARK = re.compile(r"\s*([\p{L}\p{M}'’]+)"), re.compile(rf"[{_HYPHENS}]+\s*$")


def page_number_of(line: str) -> int | str | None:
    """The number a line prints, if it holds nothing else: digits (also misread ones) as int, Roman ones as text."""
    s = line.strip()
    if not s or len(s) > 24:
        return None
    m = _NUMBER.fullmatch(s)
    if not m:
        return None
    t = m.group(1)
    digits = t.translate(_MISREAD_DIGITS)
    if digits.isdigit() and (_DIGIT.search(t) or len(t) <= 3):
        return int(digits)
    return t.lower() if _ROMAN.fullmatch(t.lower()) else None


def edge_lines(text: str | None) -> list[str]:
    """The first and last non-blank lines of a page, outermost first; the number of first ones is the middle."""
    lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
    head, foot = lines[:EDGE], lines[::-1][:EDGE]
    return [*head, *[""] * (EDGE - len(head)), *foot, *[""] * (EDGE - len(foot))]


_NO_LETTERS = re.compile(r"[^\p{L}]+")


@lru_cache(maxsize=8192)
def _bare(line: str) -> str:
    """A line without numbers and marks, for comparison."""
    return _NO_LETTERS.sub(" ", line).strip().lower()


@lru_cache(maxsize=2048)
def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def similar(a: str, b: str) -> bool:
    a, b = _bare(a), _bare(b)
    if a == b:
        return bool(a)
    if min(len(a), len(b)) < 4 or min(len(a), len(b)) < 0.6 * max(len(a), len(b)):
        return False
    # Three quarters in common, with as few breaks as misreading makes, leave a fifth of the runs of three.
    if len(_trigrams(a) & _trigrams(b)) < 0.2 * min(len(a), len(b)) - 2:
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= 0.75 and m.quick_ratio() >= 0.75 and m.ratio() >= 0.75


def furniture(lines: list[str], beside: list[list[str]]) -> dict[int, str]:
    """Line number to kind (``running`` or ``page_number``) of one page; ``beside`` has the edge lines of pages near it."""
    filled = [i for i, x in enumerate(lines) if x.strip()]
    out: dict[int, str] = {}
    for side, order in ((0, filled), (1, filled[::-1])):
        others = Counter(_bare(x) for e in beside for x in e[side * EDGE : side * EDGE + EDGE] if x)
        for i in order[:EDGE]:
            if i in out:
                break
            line = lines[i]
            if page_number_of(line) is not None:
                if "page_number" in [out[j] for j in order[:EDGE] if j in out]:
                    break
                out[i] = "page_number"
                continue
            s = line.strip()
            needed = 3 if _ENDED.search(s) else 1
            n = others[_bare(s)]
            for x, count in others.items() if n < needed and _bare(s) else ():
                n += count if x != _bare(s) and similar(s, x) else 0
                if n >= needed:
                    break
            if n >= needed and _bare(s):
                out[i] = "running"
                continue
            break
    return out


def hyphen_ends(line: str) -> str | None:
    """The first piece of a word that a line ends in the middle of, or None."""
    m = _BROKEN.search(line) if line.rstrip()[-1:] in _ENDS else None
    return m.group(1) if m else None


class Trie:
    """Vocabulary trie; ``near`` intersects it with the Levenshtein automaton of a word."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for w, n in words.items():
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node["\0"] = n
        self.swaps: dict[str, list[str]] = {}
        for line in SHAPES.strip().splitlines():
            group = line.split()
            for a in group:
                self.swaps.setdefault(a, []).extend(b for b in group if b != a)
        self.longest = max(map(len, self.swaps))

    @staticmethod
    def _walk(node: dict, s: str) -> dict | None:
        for ch in s:
            node = node.get(ch)
            if node is None:
                return None
        return node

    def near(self, word: str, most: int, others: int = 0) -> dict[str, tuple[int, int, int]]:
        """Word to (confusions, other edits, frequency) of all words of the trie within the two limits.

        The states of the automaton are (position, node, confusions, other edits); any letter may be changed, added or
        missing as another edit.
        """
        found: dict[str, tuple[int, int, int]] = {}
        seen = set()
        stack = [(0, self.root, 0, 0, "")]
        while stack:
            i, node, k, o, made = stack.pop()
            if (i, made, k, o) in seen:
                continue
            seen.add((i, made, k, o))
            if i == len(word) and "\0" in node and made != word and (made not in found or found[made][:2] > (k, o)):
                found[made] = (k, o, node["\0"])
            if o < others:
                stack += [(i, there, k, o + 1, made + b) for b, there in node.items() if b != "\0"]
                if i < len(word):
                    stack.append((i + 1, node, k, o + 1, made))
                    stack += [(i + 1, there, k, o + 1, made + b) for b, there in node.items() if b not in ("\0", word[i])]
            if i == len(word):
                continue
            nxt = node.get(word[i])
            if nxt is not None:
                stack.append((i + 1, nxt, k, o, made + word[i]))
            if k < most:
                for n in range(1, self.longest + 1):
                    for b in self.swaps.get(word[i : i + n], ()) if i + n <= len(word) else ():
                        there = self._walk(node, b)
                        if there is not None:
                            stack.append((i + n, there, k + 1, o, made + b))
                ch = word[i]
                if "가" <= ch <= "힣":
                    for b in node:
                        if b != ch and "가" <= b <= "힣" and same_shape(ch, b):
                            stack.append((i + 1, node[b], k + 1, o, made + b))
        return found


def same_shape(a: str, b: str) -> bool:
    """Two Hangul syllables with one initial, and one other part that is drawn alike."""
    x, y = ord(a) - 0xAC00, ord(b) - 0xAC00
    if x // 588 != y // 588:
        return False
    va, vb, fa, fb = x // 28 % 21, y // 28 % 21, x % 28, y % 28
    if va != vb:
        return fa == fb or {va, vb} == {19, 20}  # one stroke more or less: the vowel, or eui read as i with a final
    return {fa, fb} <= {16, 17, 21, 26}  # finals drawn as a box


def _entry(text: str) -> tuple[int, int, list[tuple[str, int, int]]]:
    """(n, own, others) of a word or trigram; an other is (word, if it takes an edit, n) or (character, place, n)."""
    x = text.split("\t")
    return int(x[0]), int(x[1]), [(x[i], int(x[i + 1]), int(x[i + 2])) for i in range(2, len(x), 3)]


def _size(w: str) -> int:
    return len(w) + sum("가" <= c <= "힣" for c in w)  # a syllable says as much as two letters


def _may_be_misread(w: str) -> bool:
    return len(w) >= 2 and sum(c.isalpha() for c in w) * 2 > len(w)


class Vocabulary:
    """Frequent words and character trigrams of all pages."""

    def __init__(self, words: dict[str, int], grams: dict[str, int], least: int, own: dict[str, int] | None = None, usual: set[str] | None = None):
        self.words, self.grams, self.least = words, grams, least
        self.own = words if own is None else own
        self.trie = Trie(words)
        self.usual = {g for w in words for g in _trigrams(f"^{w}$")} if usual is None else usual
        self.kana: dict[str, str] = {}
        for group in KANA_SHAPES.split():
            for ch in group:
                self.kana[ch] = "".join(sorted(set(self.kana.get(ch, "") + group.replace(ch, ""))))
        self.seen: dict[tuple[str, bool], list[tuple[str, int]]] = {}

    def count(self, word: str, more: dict[str, str] | None = None) -> int:
        """Frequency of a word of the vocabulary, 0 of another."""
        n = self.words.get(word, 0)
        if not n and more and "w" + word in more:
            n = _entry(more["w" + word])[0]
        return n if n >= self.least else 0

    def needed(self, w: str, own: int = 0) -> float:
        """The least frequency of a candidate; a word outside the vocabulary has less than the least count, a quarter is assumed."""
        return RATIO * (own or max(1.5, self.least / 4)) * (4 if _size(w) <= 3 else 1)

    def unlike(self, w: str) -> bool:
        """If a word cannot be a rare one: two places with letters that follow each other nowhere else."""
        return _size(w) >= 6 and not _WIDE.search(w) and len(_trigrams(f"^{w}$") - self.usual) >= 3

    def candidates(self, word: str, more: dict[str, str] | None = None) -> list[tuple[str, int]]:
        """(word, frequency) of what a word may have been, empty if it is a word of its own.

        ``more`` has what the trie and the counts are too small for; an entry is the same on every page.
        """
        w = word.lower()
        entry = more.get("w" + w) if more else None
        key = w, entry is None
        if key in self.seen:
            return self.seen[key]
        out: list[tuple[str, int]] = []
        if _may_be_misread(w):
            n, own, others = _entry(entry) if entry else (0, 0, [])
            size, need = _size(w), self.needed(w, self.own.get(w, 0) or (own if n >= self.least else 0))
            near = self.trie.near(w, 1 if size <= 4 else 2)
            out = [(c, n) for c, (k, _, n) in near.items() if n >= need * (3 if k == 2 and size < 8 else 1)]
            out += [(c, n) for c, o, n in others if not o]
            # Other edits only for what cannot be a rare word.
            if not out and self.unlike(w):
                out = [(c, n) for c, (k, o, n) in self.trie.near(w, 1, 1).items() if o and n >= 4 * need and c[0] == w[0]]
                out += [(c, n) for c, o, n in others if o]
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[key] = out
        return out

    def repaired(self, word: str, page: set[str], before: str = "", after: str = "", more: dict[str, str] | None = None) -> str | None:
        """The best candidate, None for a proper word: by context, then the most frequent.

        Context is what the page has elsewhere: the candidate beside the same word before or after, then the candidate.
        """
        c = self.candidates(word, more)
        if not c:
            return None
        best = max(c, key=lambda x: (f"{before} {x[0]}" in page or f"{x[0]} {after}" in page, x[0] in page, x[1], x[0]))[0]
        return best.capitalize() if word[:1].isupper() else best

    def misread_kana(self, line: str, more: dict[str, str] | None = None) -> dict[int, str]:
        """Position to better character where the trigrams around are rare and those of a look-alike are frequent."""
        out = {}
        for i, ch in enumerate(line):
            if ch not in self.kana:
                continue
            windows = [(line[max(0, j) : j + 3], i - max(0, j)) for j in range(i - 2, i + 1) if j >= 0 and j + 3 <= len(line)]
            if not windows:
                continue
            own = max(self.grams.get(g, 0) for g, _ in windows)
            rare: dict[str, int] = {}
            for g, p in windows if more else ():
                if "g" + g in more:
                    n, _, others = _entry(more["g" + g])
                    own = max(own, n if n >= self.least else 0)
                    for b, at, n in others:
                        if at == p:
                            rare[b] = max(rare.get(b, 0), n)
            for b in self.kana[ch]:
                other = max(self.grams.get(g[:p] + b + g[p + 1 :], 0) for g, p in windows)
                if max(other, rare.get(b, 0)) >= self.gram_needed(own):
                    out[i] = b
        return out

    def gram_needed(self, own: int) -> int:
        return 3 * RATIO * max(own, self.least // 2, 1) // 2


def body_words(lines: list[str], kinds: dict[int, str], left_out: list[str] | None = None) -> list[tuple[int, list[str]]]:
    """Words of the body lines, without pieces of broken words and parts of file names and the like (``left_out``)."""
    out, cut = [], False
    for i, line in enumerate(lines):
        if i in kinds or not line.strip():
            continue
        words = [m.group() for m in _WORD.finditer(line)]
        every = words
        if cut and words:
            words = words[1:]
        # Lines of scripts without spaces may end within a word that has no hyphen.
        open_end = _is_kana(line) and line.rstrip()[-1:].isalnum()
        cut = hyphen_ends(line) is not None or open_end
        if cut and words:
            words = words[:-1]
        if left_out is not None and len(words) < len(every):
            left_out += every[:1] + every[-1:]
        out.append((i, words))
    return out


def _is_kana(line: str) -> bool:
    return _KANA.search(line) is not None


def _with_neighbours(pages: DataFrame, more: DataFrame | None) -> DataFrame:
    # One partitioning by document serves both windows; its number is not taken from the small input.
    p = pages.where("text IS NOT NULL").select("document_id", "page_number", "text", "processing_time_ms").repartition(shuffle_partitions(pages.sparkSession), "document_id")
    p = latest(p, ["document_id", "page_number"], [F.desc_nulls_last("processing_time_ms"), F.md5("text")])

    def edges(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(edge_lines)

    w = W.partitionBy("document_id").orderBy("page_number")
    p = p.withColumn("edge", F.pandas_udf(edges, "array<string>")("text"))
    lag, lead = [F.lag("edge", i).over(w) for i in (1, 2, 3)], [F.lead("edge", i).over(w) for i in (1, 2, 3, 4)]
    near, after = F.array(*lag, *lead[:3]), F.array(*lag[:2], F.col("edge"), *lead[1:])
    p = p.select("document_id", "page_number", "text", near.alias("near"), F.lead("text").over(w).alias("next"), after.alias("after"), F.lag("text").over(w).alias("before"))
    if more is None:
        return p.withColumn("rest", F.lit(None).cast("map<string,string>"))
    return p.join(_rest_of_pages(p, more), ["document_id", "page_number"], "left")


def _parts(text: str, near) -> tuple[list[str], dict[int, str]]:
    lines = text.split("\n")
    return lines, furniture(lines, [list(e) for e in near if e is not None])


def count_words(pages: DataFrame) -> DataFrame:
    """(kind, word, n, own) over all pages, summed in tasks first: words and the trigrams of kana and kanji.

    ``n`` counts pages that are recognised with confidence, ``own`` all pages but no more than ``PER_DOCUMENT`` a document.
    The pages of a document stand together for that; of a document with very many words every part counts for one. Words
    that are only looked up, such as those that two lines may make, are there with a count of 0.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, str], list[int]] = {}
        here: Counter = Counter()
        document = page = None
        now: list[list[str]] = []  # lines of the readings of this page
        ended: list[list[str]] = []  # and of the page before

        def close() -> None:
            for (kind, word), n in here.items():
                entry = total.setdefault((kind, word), [0, 0])
                entry[1] += min(n, PER_DOCUMENT)
            here.clear()

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*k, *v) for k, v in total.items()], columns=["kind", "word", "n", "own"])

        for pdf in batches:
            for doc, number, text, confidence in zip(pdf["document_id"], pdf["page_number"], pdf["text"], pdf["confidence"]):
                if doc != document or number != page:
                    ended, now, page = now if doc == document else [], [], number
                if doc != document or len(here) > 100_000:
                    close()
                    document = doc
                now.append(filled := [x for x in text.split("\n") if x.strip()])
                pieces: list[str] = []
                found = [("w", x.lower()) for _, words in body_words(text.split("\n"), {}, pieces) for x in words]
                found += [("g", line[i : i + 3]) for line in text.split("\n") if _is_kana(line) for i in range(len(line) - 2)]
                here.update(found)
                if not confidence < CONFIDENT:  # unknown confidence counts
                    for x in found:
                        total.setdefault(x, [0, 0])[0] += 1
                else:
                    pieces += [x for kind, x in found if kind == "w"]
                asked = {x.lower() for x in pieces}
                for piece, last in {*going_on(filled), *(x for e in ended for x in going_on(e, filled))}:
                    asked |= {piece, last, piece + last}
                for x in asked:
                    total.setdefault(("w", x), [0, 0])
            if len(total) > 100_000:
                close()
                yield rows()
                total.clear()
        close()
        yield rows()

    some = pages.where("text IS NOT NULL").select("document_id", "page_number", "text", "confidence")
    some = some.repartition(shuffle_partitions(pages.sparkSession), "document_id").sortWithinPartitions("document_id", "page_number", "confidence")
    each = some.mapInPandas(count, "kind string, word string, n long, own long")
    return each.groupBy("kind", "word").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))


def vocabulary(pages: DataFrame) -> tuple[Broadcast[Vocabulary], DataFrame | None]:
    """The frequent words and trigrams, which alone come to the driver, and the table ``rarer`` of the others."""
    c = checkpointed(count_words(pages))
    total = c.groupBy("kind").agg(F.sum("n").alias("t")).collect()
    least = {k: LEAST_COUNT for k in "wg"} | {r["kind"]: max(LEAST_COUNT, int(r["t"] * LEAST_SHARE)) for r in total}
    test = F.lit(False)
    for k, n in least.items():
        test = test | ((F.col("kind") == k) & (F.col("n") >= n))
    rows = c.where(test).collect()
    words, grams = ([r for r in rows if r["kind"] == k] for k in "wg")
    # Alphabets bound the number of letters that follow each other.
    share = max(LEAST_COUNT, int(next((r["t"] for r in total if r["kind"] == "w"), 0) * USUAL_SHARE))
    usual = {g for r in words if r["n"] >= share for g in _trigrams(f"^{r['word']}$")}
    if least["w"] > share:

        def trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"g": list({g for w in pdf["word"] for g in _trigrams(f"^{w}$") if not _WIDE.search(g)})}, dtype=object)

        known = c.where((F.col("kind") == "w") & (F.col("n") >= share)).select("word").mapInPandas(trigrams, "g string")
        usual |= {r["g"] for r in known.distinct().collect()}
    voc = Vocabulary({r["word"]: r["n"] for r in words}, {r["word"]: r["n"] for r in grams}, LEAST_COUNT, {r["word"]: r["own"] for r in words}, usual)
    sent = pages.sparkSession.sparkContext.broadcast(voc)
    # Where the trie and the counts hold the whole vocabulary there is nothing to join.
    parts = [f(c.where(F.col("kind") == k).drop("kind"), sent, least[k]).withColumn("kind", F.lit(k)) for k, f in (("w", rarer_words), ("g", rarer_grams)) if least[k] > LEAST_COUNT]
    if not parts:
        return sent, None
    more = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    return sent, checkpointed(more.withColumn("word", F.concat("kind", "word")).drop("kind").withColumn("key", F.xxhash64("word")))


# Shapes that begin with a letter, and what may stand for them.
_SWAPS: dict[str, list[tuple[str, str]]] = {}
for _a, _b in ((a, b) for line in SHAPES.strip().splitlines() for a in line.split() for b in line.split() if a != b):
    _SWAPS.setdefault(_a[0], []).append((_a, _b))


@lru_cache(maxsize=12_000)
def _same_shapes(ch: str) -> tuple[str, ...]:
    """The Hangul syllables that are drawn like one; they have its initial."""
    first = 0xAC00 + (ord(ch) - 0xAC00) // 588 * 588
    return tuple(b for b in map(chr, range(first, first + 588)) if b != ch and same_shape(ch, b))


def one_confusion(w: str) -> set[str]:
    """The word and all it may be with one confusion. Confusions go both ways: words with two apart have one in common."""
    out = {w}
    for i, ch in enumerate(w):
        for a, b in _SWAPS.get(ch, ()):
            if w.startswith(a, i):
                out.add(w[:i] + b + w[i + len(a) :])
        if "가" <= ch <= "힣":
            out.update(w[:i] + b + w[i + 1 :] for b in _same_shapes(ch))
    return out


def _one_less(w: str) -> set[str]:
    """The word and all it leaves with one letter less; words with one edit apart have one in common."""
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


def _hash(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], dtype=np.uint64).view(np.int64)


def rarer_words(words: DataFrame, sent: Broadcast[Vocabulary], least: int) -> DataFrame:
    """(word, value, asked, rare): words that are too rare for the trie, and words that may be misread from one.

    The value is an ``_entry``; what a page has is looked up if ``asked``, what two of its lines may make also if ``rare``.
    The two sides meet in a hashed join of their confusions, or of what they leave with one letter less, in which no pair is
    missing; the automaton of the trie then decides.
    """
    rare = (F.col("n") >= LEAST_COUNT) & (F.col("n") < least)

    def right(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                keys, rows = [], []
                for w, n in zip(pdf["word"].iloc[i : i + 1000], pdf["n"].iloc[i : i + 1000]):
                    near = one_confusion(w)
                    edited = {f"{w[0]}\1{x}" for y in near for x in _one_less(y)} if n >= 4 * sent.value.needed("x" * 6) else set()
                    for x in near | edited:
                        keys.append(x)
                        rows.append((w, n))
                yield pd.DataFrame(rows, columns=["other", "n_other"]).assign(near=_hash(keys))

    b = words.where(rare).select("word", "n").mapInPandas(right, "near long, other string, n_other long")
    has = words.sparkSession.sparkContext.broadcast(key_filter(b.select(F.col("near").alias("key"))))

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = sent.value
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                keys, rows = [], []
                for w, n, own in pdf.iloc[i : i + 1000].itertuples(index=False):
                    if not _may_be_misread(w):
                        continue
                    known = n >= LEAST_COUNT
                    near = one_confusion(w)
                    if voc.unlike(w):
                        near |= {f"{w[0]}\1{x}" for x in _one_less(w)}
                    for x in near:
                        keys.append(x)
                        rows.append((w, voc.needed(w, own if known else 0)))
                near = _hash(keys)
                yield pd.DataFrame(rows, columns=["word", "need"]).assign(near=near)[passes(has.value, near)]

    a = words.select("word", "n", "own").mapInPandas(left, "near long, word string, need double")
    met = a.join(b, "near").where("word <> other AND n_other >= need").select("word", "need", "other", "n_other").distinct()

    def verify(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        voc = sent.value
        for columns in batches:
            out = []
            for w, need, c, n in zip(*columns):
                t = Trie({c: int(n)})
                k = t.near(w, 1 if _size(w) <= 4 else 2).get(c)
                if k and n >= need * (3 if k[0] == 2 and _size(w) < 8 else 1):
                    out.append(0)
                elif n >= 4 * need and c[0] == w[0] and voc.unlike(w) and t.near(w, 1, 1).get(c, (0, 0))[1]:
                    out.append(1)
                else:
                    out.append(-1)
            yield pd.Series(out, index=columns[0].index, dtype="int32")

    def maybe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:  # a word's counts are needed if it had candidates in the trie without them
            yield s.map(lambda w: bool(sent.value.candidates(w))).astype(bool)

    good = met.withColumn("edit", F.pandas_udf(verify, "int")("word", "need", "other", "n_other")).where("edit >= 0")
    others = good.groupBy("word").agg(F.array_sort(F.collect_list(F.concat_ws("\t", "other", "edit", "n_other"))).alias("others"))
    x = words.join(others, "word", "left").withColumn("rare", rare).where("rare OR others IS NOT NULL")
    asked = F.col("others").isNotNull() | (F.col("rare") & F.pandas_udf(maybe, "boolean")("word"))
    return x.select("word", F.concat_ws("\t", "n", "own", "others").alias("value"), asked.alias("asked"), "rare")


def rarer_grams(grams: DataFrame, sent: Broadcast[Vocabulary], least: int) -> DataFrame:
    """The same for trigrams: ``asked`` are those that a look-alike would make so much more frequent that it may be meant."""
    rare = (F.col("n") >= LEAST_COUNT) & (F.col("n") < least)

    def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = sent.value
        for pdf in batches:
            rows = []
            for g, n in zip(pdf["word"], pdf["n"]):
                need = voc.gram_needed(n if n >= LEAST_COUNT else 0)
                rows += [(g, b, p, need, g[:p] + b + g[p + 1 :]) for p, ch in enumerate(g) for b in voc.kana.get(ch, "")]
            yield pd.DataFrame(rows, columns=["word", "b", "p", "need", "other"])

    a = grams.select("word", "n").mapInPandas(left, "word string, b string, p int, need long, other string")
    b = grams.where(F.col("n") >= LEAST_COUNT).select(F.col("word").alias("other"), F.col("n").alias("n_other"))
    good = a.join(b, "other").where("n_other >= need")
    others = good.groupBy("word").agg(F.array_sort(F.collect_list(F.concat_ws("\t", "b", "p", "n_other"))).alias("others"))
    x = grams.join(others, "word", "left").withColumn("rare", rare).where("rare OR others IS NOT NULL")
    return x.select("word", F.concat_ws("\t", "n", "own", "others").alias("value"), F.col("others").isNotNull().alias("asked"), "rare")


def going_on(lines: list[str], after: list[str] | None = None) -> Iterator[tuple[str, str]]:
    """(piece, next word) wherever a word may go on in the next line, or in ``after``, the lines of the next page.

    Lines are not blank; whatever of them is furniture, as that is three lines at most at either edge.
    """
    tails: list[str] = []
    for i, line in enumerate(lines):
        piece = hyphen_ends(line)
        if not piece:
            tails = []
            continue
        bare = line.strip().rstrip(_HYPHENS).rstrip()
        end = _TAIL.search(bare)
        own = [end.group().lower()] if end else []
        tails = own + ([t + own[0] for t in tails] if own and end.group() == bare else [])
        if after is None:
            following = lines[i + 1 : i + 2]
        else:
            following = after[: EDGE + 1] if i + EDGE + 1 >= len(lines) else []
        for x in following:
            m = _NEXT.match(x)
            if m:
                yield from ((t, m.group(1).lower()) for t in {piece.lower(), *tails})


def _rest_of_pages(pages: DataFrame, more: DataFrame) -> DataFrame:
    """(document_id, page_number, rest): for each page what it needs of ``more``, by kind and word."""
    sc = pages.sparkSession.sparkContext
    asked, rare = (sc.broadcast(key_filter(more.where(x))) for x in ("asked", "rare"))

    def some(words: list[str], *filters: Broadcast[np.ndarray]) -> list[str]:
        key = _hash(words)
        return [words[i] for i in np.flatnonzero(np.any([passes(f.value, key) for f in filters], axis=0))]

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, p, text, before, nxt in zip(pdf["document_id"], pdf["page_number"], pdf["text"], pdf["before"], pdf["next"]):
                last, here, following = ([x for x in (t or "").split("\n") if x.strip()] for t in (before, text, nxt))
                words, made = {"w" + m.group().lower() for m in _WORD.finditer(text)}, set()
                for a, b in {*going_on(here), *going_on(here, following), *going_on(last, here)}:
                    made |= {"w" + x for x in (a, b, *one_confusion(a + b))}
                kana = [["g" + line[i : i + 3] for i in range(len(line) - 2)] for line in filter(_is_kana, here)]
                found = set(some(list(words.union(made, *kana)), asked))
                made.update(g for grams in kana for i, x in enumerate(grams) if x in found for g in grams[max(0, i - 2) : i + 3])
                found.update(some(list(made), rare))
                rows += [(d, p, x) for x in found]
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "word"]).astype({"page_number": "int32"})

    seen = pages.select("document_id", "page_number", "text", "before", "next").mapInPandas(look_up, "document_id string, page_number int, word string")
    return seen.join(more.select("word", "value"), "word").groupBy("document_id", "page_number").agg(F.map_from_entries(F.collect_list(F.struct("word", "value"))).alias("rest"))


def _next_body(text: str | None, edges) -> str | None:
    """The first body line of the next page."""
    if text is None:
        return None
    lines, kinds = _parts(text, edges)
    return next((x for i, x in enumerate(lines) if x.strip() and i not in kinds), None)


def _is_broken(piece: str, line: str, rest: str, voc: Vocabulary, more: dict[str, str]) -> bool:
    m = _NEXT.match(rest)
    if not m or not m.group(1)[:1].islower():
        return False
    last = m.group(1).lower()
    mark = _MARK.search(line).group().strip()
    joined = (piece + last).lower()
    if voc.count(joined, more):
        return True
    if mark.strip("-‐‑"):  # a mark that words do not have themselves
        return True
    # A word at its own hyphen: both parts are words.
    if not (voc.count(piece.lower(), more) > voc.least and voc.count(last, more) > voc.least) or voc.trie.near(joined, 1):
        return True
    return bool(more) and any(voc.count(x, more) for x in one_confusion(joined))


def line_kinds(text: str, near, nxt: str | None, after, voc: Vocabulary, rest_of_page: dict[str, str] | None = None) -> list[tuple[int, str]]:
    """(line number, kind) of one page; ``near`` are the edge lines of the pages beside it, ``after`` of those beside the next.

    ``rest_of_page`` has what the trie is too small for.
    """
    more = rest_of_page or {}
    lines, kinds = _parts(text, near)
    out = list(kinds.items())
    body = [i for i, x in enumerate(lines) if i not in kinds and x.strip()]
    for a, i in enumerate(body):
        piece = hyphen_ends(lines[i])
        if piece:
            rest = lines[body[a + 1]] if a + 1 < len(body) else _next_body(nxt, after)
            if rest is not None and _is_broken(piece, lines[i], rest, voc, more):
                out.append((i, "hyphen"))
    for i, words in body_words(lines, kinds):
        if any(voc.candidates(w, more) for w in words) or (_is_kana(lines[i]) and voc.misread_kana(lines[i], more)):
            out.append((i, "misread"))
    return out


def find_noise(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, line_no, kind) of all noisy lines.

    Null and empty texts have none; repeated pages count once. Pages are shuffled once, by document; each sees the edge
    lines of three pages before and after it, so documents of any length are never held whole.
    """
    sent, more = vocabulary(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = sent.value
        for pdf in batches:
            rows = []
            for d, p, text, near, nxt, after, rest in zip(pdf["document_id"], pdf["page_number"], pdf["text"], pdf["near"], pdf["next"], pdf["after"], pdf["rest"]):
                rows += [(d, p, i, k) for i, k in line_kinds(text, near, nxt, after, voc, dict(rest) if rest is not None else None)]
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "line_no", "kind"]).astype({"page_number": "int32", "line_no": "int32"})

    return _with_neighbours(pages, more).drop("before").mapInPandas(run, "document_id string, page_number int, line_no int, kind string").distinct()


def repair_line(line: str, page: set[str], voc: Vocabulary, more: dict[str, str]) -> str:
    """A line with its misread words and characters repaired; the first piece of a broken word stays."""
    found = list(_WORD.finditer(line))
    words = [m.group().lower() for m in found]
    if hyphen_ends(line):
        found = found[:-1]
    swaps = voc.misread_kana(line, more) if _is_kana(line) else {}
    line = "".join(swaps.get(j, ch) for j, ch in enumerate(line))
    out, at = [], 0
    for i, m in enumerate(found):
        new = voc.repaired(m.group(), page, words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "", more)
        if new:
            out += [line[at : m.start()], new]
            at = m.end()
    return "".join(out) + line[at:]


def repair_page(text: str, near, nxt: str | None, after, before: str | None, voc: Vocabulary, more: dict[str, str] | None = None) -> str:
    """The page's paragraphs without furniture, with words joined and repaired, one paragraph a line."""
    more = more or {}
    lines, kinds = _parts(text, near)
    words = [m.group().lower() for m in _WORD.finditer(text)]
    page = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}
    out, held, pending = [], "", False
    body = [i for i in range(len(lines)) if i not in kinds]
    filled = [i for i in body if lines[i].strip()]
    moved = None
    if filled and before is not None:  # the rest of a word that the page before takes
        earlier = [x for x in before.split("\n") if x.strip()]
        for x in reversed(earlier[-EDGE:]):
            if hyphen_ends(x) and _is_broken(hyphen_ends(x), x, lines[filled[0]], voc, more):
                moved = filled[0]
            if page_number_of(x) is None:
                break
    for i in body:
        line = lines[i].strip()
        if i == moved:
            line = re.sub(r"^[\p{L}\p{M}'’]+[.,;:]?\s*", "", line)
        if not line:
            if held and not pending:
                out.append(held)
                held = ""
            continue
        fixed = repair_line(line, page, voc, more)
        joined, pending_word = pending, None
        if joined and held:  # the joined word as well
            m, raw = _NEXT.match(fixed), _NEXT.match(line)
            first = _TAIL.search(held)
            if m and raw and first:
                new = voc.repaired(first.group() + raw.group(1), page, more=more)
                pending_word = (first.start(), new, m.end()) if new else None
        if pending_word:
            held, fixed = held[: pending_word[0]] + pending_word[1], fixed[pending_word[2] :]
        glue = "" if pending or (held and _is_kana(held[-1] + fixed[0])) else " "
        held = held + glue + fixed if held else fixed
        pending = False
        piece = hyphen_ends(line)
        if piece:
            k = next((j for j in filled if j > i), None)
            rest = lines[k] if k is not None else _next_body(nxt, after)
            if rest is not None:
                if _is_broken(piece, line, rest, voc, more):
                    held = held.rstrip().rstrip(_HYPHENS)
                    if k is None:
                        held += re.match(r"\s*([\p{L}\p{M}'’]*)", rest).group(1)
                pending = True
    if held:
        out.append(held)
    return "\n".join(out)


def repair(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, text): the readable text of every page, one paragraph a line; null texts are left out."""
    sent, more = vocabulary(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voc = sent.value
        for pdf in batches:
            done = [repair_page(*x[:5], voc, dict(x[5]) if x[5] is not None else None) for x in zip(pdf["text"], pdf["near"], pdf["next"], pdf["after"], pdf["before"], pdf["rest"])]
            yield pd.DataFrame({"document_id": pdf["document_id"], "page_number": pdf["page_number"], "text": done})

    return _with_neighbours(pages, more).mapInPandas(run, "document_id string, page_number int, text string")
