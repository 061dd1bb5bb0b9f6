"""One consistent form for texts that look the same (problem 8).

Look-alike strings form classes by union-find over strings and code points; each class is represented by the member
that is most frequent in the corpus; a multi-pattern automaton rewrites texts greedily, longest match first.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.session import checkpointed

# Letters of other scripts that are drawn like a Latin letter, as pairs "Latin: look-alikes".
LOOK_ALIKES = """
A: Α А Ꭺ ꓮ
B: Β В Ᏼ ꓐ Ⲃ
C: С Ϲ Ⅽ Ꮯ ꓚ Ⲥ
D: Ⅾ Ꭰ ꓓ
E: Ε Е Ꭼ ꓰ
F: Ϝ ꓝ
G: Ԍ Ꮐ ꓖ
H: Η Н Ꮋ ꓧ Ⲏ
I: Ι І Ӏ Ⅰ ꓲ
J: Ј Ꭻ ꓙ
K: Κ К K Ꮶ ꓗ Ⲕ
L: Ⅼ Ꮮ ꓡ
M: Μ М Ⅿ Ϻ Ꮇ ꓟ Ⲙ
N: Ν ꓠ Ⲛ
O: Ο О Օ ꓳ Ⲟ
P: Ρ Р Ꮲ ꓑ Ⲣ
Q: Ԛ
R: ꓣ
S: Ѕ Տ Ꮪ ꓢ
T: Τ Т Ꭲ ꓔ Ⲧ
U: ꓴ
V: Ⅴ Ѵ Ꮩ ꓦ
W: Ԝ Ꮃ ꓪ
X: Χ Х Ⅹ ꓫ Ⲭ
Y: Υ Ү ꓬ Ⲩ
Z: Ζ Ꮓ ꓜ
a: а ɑ
b: Ь
c: с ϲ ⅽ ⲥ
d: ԁ ⅾ
e: е
g: ɡ ց
h: һ հ
i: і ⅰ
j: ј ϳ
l: ⅼ
m: ⅿ
n: ո
o: ο о օ ⲟ
p: р ρ ⲣ
q: ԛ զ
s: ѕ
u: ս υ
v: ν ѵ ⅴ
w: ԝ ѡ
x: х ⅹ
y: у ү
-: ‐ ‑ ﹣
...: …
..: ‥
µ: μ
ニ: 二
カ: 力
エ: 工
ロ: 口
ハ: 八
タ: 夕
ト: 卜
ヘ: へ
"""
# White space that is drawn like a space (line breaks and tabs are not), and invisible characters.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
# A joiner between two pictographs changes what is drawn.
_JOINED = re.compile("([\u2190-\u2bff\U0001f000-\U0001faff])\ufe0f?\u200d(?=[\u2190-\u2bff\U0001f000-\U0001faff])")
_KEPT = "\ue0ff"
# Compatibility mappings of these kinds are not seen; <super>, <sub>, <circle>, <fraction>, <square>, <font> are.
_UNSEEN = ("<wide>", "<narrow>", "<noBreak>")


def read_confusables(path: str) -> list[tuple[str, str]]:
    """Pairs of a file in the published form of confusables: ``source ; target ; type # comment``, code points in hex."""
    out = []
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = line.split("#")[0].split(";")
            if len(parts) >= 2:
                source, target = ("".join(chr(int(x, 16)) for x in p.split()) for p in parts[:2])
                out.append((target, source))
    return out


def _pairs(more: list[tuple[str, str]] | None = None) -> Iterator[tuple[str, str]]:
    yield from more or []
    for line in LOOK_ALIKES.strip().splitlines():
        base, others = line.split(": ")
        for o in others.split():
            yield base, o
    for cp in (*range(0x2E80, 0x2FE0), *range(0xF900, 0xFB07), *range(0xFE10, 0xFFEF)):
        d = unicodedata.decomposition(chr(cp))
        if d and (d.startswith(_UNSEEN) or d.startswith("<compat>") and cp < 0xFB07 or not d.startswith("<")):
            yield "".join(chr(int(x, 16)) for x in d.split() if x[0] != "<"), chr(cp)


def base_form(text: str) -> str:
    """Without invisible characters, every space a plain one, decomposed; what the classes are applied to."""
    if text.isascii():
        return text
    text = _JOINED.sub(rf"\1{_KEPT}", text)
    text = INVISIBLE.sub("", text).translate(_SPACE_TABLE)
    return unicodedata.normalize("NFD", text)


_SPACE_TABLE = {ord(c): " " for c in SPACES}
# Characters that no rule touches unless a class names them: a text of these alone is already in its form.
_USUAL = r"\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u017f\u0900-\u097f\u0e00-\u0e7f\u2013-\u2015\u2018-\u201e\u20ac\u3001-\u30ff\u4e00-\u9fff\uac00-\ud7a3"


def classes(more: list[tuple[str, str]] | None = None) -> list[list[str]]:
    """The classes of strings that look the same: the transitive closure of the pairs, with ``more`` of them."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in _pairs(more):
        a, b = unicodedata.normalize("NFD", a), unicodedata.normalize("NFD", b)
        if a != b:
            parent[find(a)] = find(b)
    out: dict[str, list[str]] = {}
    for x in parent:
        out.setdefault(find(x), []).append(x)
    return [sorted(v) for v in out.values() if len(v) > 1]


def representatives(counts: dict[str, int], more: list[tuple[str, str]] | None = None) -> dict[str, str]:
    """What each class member is rewritten to: the member with the highest count; ties go to the first in code order."""
    out = {}
    for members in classes(more):
        best = max(members, key=lambda m: (counts.get(m, 0), [-ord(c) for c in m]))
        out |= {m: best for m in members if m != best}
    return out


class Rewriter:
    """Applies representatives to texts, longest match first."""

    def __init__(self, mapping: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        for k, v in mapping.items():
            self.automaton.add_word(k, (len(k), v))
        if mapping:
            self.automaton.make_automaton()
        inside = [re.escape(k) for k in mapping if re.fullmatch(f"[{_USUAL}]+", k)]
        # Composed letters that hold a class member, such as a kana with a voice mark.
        inside += [chr(c) for c in (*range(0xA1, 0x180), *range(0x900, 0x980), *range(0x3041, 0x3100)) if any(x in mapping for x in unicodedata.normalize("NFD", chr(c))[:-1])]
        # Single characters as one class: alternatives would be tried one by one at every place.
        single, longer = "".join(sorted({x for x in inside if len(x.removeprefix("\\")) == 1})), sorted((x for x in inside if len(x.removeprefix("\\")) > 1), key=len, reverse=True)
        self.odd = re.compile("|".join([f"[^{_USUAL}]", *([f"[{single}]"] if single else []), *longer]))

    def __call__(self, text: str) -> str:
        if not self.odd.search(text) and unicodedata.is_normalized("NFC", text):
            return text
        base = base_form(text)
        if not self.automaton:
            return unicodedata.normalize("NFC", base).replace(_KEPT, "\u200d")
        out, at = [], 0
        found = sorted((end - n + 1, -n, new) for end, (n, new) in self.automaton.iter(base))
        for start, n, new in found:
            if start >= at:
                out += [base[at:start], new]
                at = start - n
        out.append(base[at:])
        return unicodedata.normalize("NFC", "".join(out)).replace(_KEPT, "\u200d")


def member_counts(texts: DataFrame, more: list[tuple[str, str]] | None = None) -> DataFrame:
    """(member, n): how often each member of a class occurs in all texts; summed in tasks first."""
    members = [m for c in classes(more) for m in c]
    singles, longer = {m for m in members if len(m) == 1}, [m for m in members if len(m) > 1]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            joined = "\n".join(base_form(t) for t in pdf["text"] if t)
            for ch in set(joined) & singles:
                total[ch] += joined.count(ch)
            for m in longer:
                total[m] += joined.count(m)
        yield pd.DataFrame({"member": list(total), "n": list(total.values())}).astype({"n": "int64"})

    return texts.select("text").mapInPandas(count, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))


def unify(texts: DataFrame, confusables: str | None = None) -> DataFrame:
    """``texts`` with ``unified``, the consistent form of ``text``; null stays null, empty stays empty.

    ``confusables`` is a file with more pairs, in the form in which they are published.

    Other columns and repeated rows pass through. Two passes over the texts, no shuffle of texts: counts of class
    members (a few hundred, a bound given by the classes) come to the driver, then each text is rewritten on its own.
    """
    more = read_confusables(confusables) if confusables else None
    counts = {r["member"]: r["n"] for r in member_counts(texts, more).collect()}
    mapping = representatives(counts, more)

    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Rewriter(mapping)
        for s in batches:
            yield s.map(lambda t: None if t is None else f(t))

    return texts.withColumn("unified", F.pandas_udf(rewrite, "string")(F.col("text")))


def same_looking_pairs(texts: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: documents that look the same while their stored texts differ.

    Null, empty and blank texts take no part. Different stored texts of a look are paired first, then expanded to their
    documents, so that exact copies are never compared with each other.
    """
    h = unify(texts.select("doc_id", "text").where("text IS NOT NULL")).where(F.length(F.trim("unified")) > 0)
    h = checkpointed(h.select("doc_id", F.md5("unified").alias("look"), F.md5("text").alias("stored")).distinct())
    a, b = (h.select("look", F.col("stored").alias(f"s_{x}"), F.col("doc_id").alias(f"doc_id_{x}")) for x in "ab")
    pairs = form_pairs(h).join(a, ["look", "s_a"]).join(b, ["look", "s_b"])
    return pairs.select(F.least("doc_id_a", "doc_id_b").alias("doc_id_a"), F.greatest("doc_id_a", "doc_id_b").alias("doc_id_b")).where("doc_id_a <> doc_id_b").distinct()


def form_pairs(h: DataFrame) -> DataFrame:
    """(look, s_a, s_b), s_a < s_b: the different stored texts of a look, paired before any document is."""
    forms = h.select("look", "stored").distinct()
    mixed = forms.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    forms = forms.join(mixed, "look", "left_semi")
    a, b = (forms.select("look", F.col("stored").alias(f"s_{x}")) for x in "ab")
    return a.join(b, "look").where("s_a < s_b")
