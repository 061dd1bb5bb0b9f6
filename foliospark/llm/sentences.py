"""Sentence boundaries across languages and scripts (problem 5).

Standard sentence-break properties (terminators of all scripts, closing marks, lower case) find the candidates;
abbreviations, numbers, quotations, brackets and wrapped lines suppress them. The rules look at the text itself; the
language column may be wrong and only adds its own abbreviations.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by language, as public suppression lists have them. "any": no end whatever follows;
# "number": no end before a digit; "open": an end only before a capital letter.
ABBREVIATIONS = {
    "en": {
        "any": "dr mr mrs ms mx messrs prof st cf e.g i.e vs viz approx maj capt lt sgt cmdr gov supt",
        "number": "no nos fig figs sec ch chap vol vols pp p eq eqs art min max ver para jan feb mar apr jun jul aug sep sept oct nov dec",
        "open": "etc inc ltd co corp bros llc dept est u.s u.k u.n a.m p.m jr sr al ph.d d.c b.c a.d",
    },
    "de": {
        "any": "dr prof hr fr frl dipl ing vgl z.b d.h u.a bzw z evtl ggf bspw sog i.d.r u.u m.e o.g inkl exkl insb",
        "number": "nr nrn abb kap s bd bde abs art ca tel tab aufl jh mio mrd jan feb mär apr jun jul aug sep sept okt nov dez",
        "open": "usw str gmbh etc v.chr n.chr dgl",
    },
    "fr": {
        "any": "m mm mme mmes mlle mlles dr p.ex cf env c.-à-d st ste",
        "number": "art fig chap p pp vol n tél éd janv févr avr juil sept oct nov déc",
        "open": "etc ex av apr j.-c",
    },
    "es": {"any": "sr sra srta dr dra d dña prof p.ej ud uds", "number": "núm art fig cap pág págs vol tel", "open": "etc ee.uu a.c d.c"},
    "it": {"any": "sig sig.ra dott prof ing avv p.es cfr", "number": "art fig cap pag pagg vol tel n", "open": "ecc s.p.a s.r.l"},
    "pt": {"any": "sr sra dr dra prof eng p.ex", "number": "art fig cap pág págs vol tel", "open": "etc ltda"},
    "hi": {"any": "डॉ श्री श्रीमती कु प्रो रु पं स्व", "number": "सं पृ क्र", "open": ""},
    "ko": {"any": "", "number": "no vol pp", "open": "co ltd inc"},
}
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember".split())
# German words before an ordinal number.
ORDINAL_LEAD = set("im am vom zum beim der die das dem den des ab bis seit zur".split())
# Words before a single letter that names a part or place, so that "building C." ends a sentence.
PLACES = set("anhang gebäude abschnitt halle annexe bâtiment section appendix building annex part teil figure".split())
# Paired marks; the straight double quote pairs with itself.
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", '"': '"'}
_CLOSERS = {c for v in PAIRS.values() for c in v}

_TERM = re.compile(r"(?:[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…])+")
_CLOSE = re.compile(r"""[\p{Pe}\p{Pf}”“»›」』）】"'’]*""")
_MARKS = re.compile("[" + "".join(re.escape(c) for c in sorted(set(PAIRS) | _CLOSERS)) + "]|\n(?=\n)")
_SPACES, _WORD, _LETTER = re.compile(r"\s*"), re.compile(r"\w+"), re.compile(r"[\p{L}\p{N}]")
_STOPS = set("()[]“„\"«「『（")
_DATE = re.compile(r"\d{4}\.(?:\s*\d{1,2}\.)*\s*\d{0,2}$")
_INITIALS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_ENDED = re.compile(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…][\p{Pe}\p{Pf}”“\"'’]*$")
_THAI_GAP, _THAI_REST = re.compile(r"(?<=[฀-๿])[^\S\n]+(?=\S)"), re.compile(r"[\d%.,)ๆฯ]")
# Characters that are looked back over for an abbreviation or a number; none is longer.
BACK = 40
_FULL = set("。！？｡")
_LINES = re.compile(r"\n\s*")
_KO_NOUN = re.compile(r"(?:[함됨임]|[가-힣]음)$")
# Nouns that end like the noun form of a verb.
_KO_NOT = re.compile(r"(?:보관함|사서함|우편함|우체함|군함|잠수함|포함|다음|처음|마음|얼음|소음|녹음|발음|모임|책임|게임|프레임|타임)$")


def _sets(language: str | None) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {"any": set(), "number": set(), "open": set()}
    for lang in ("en", "de", "fr", "hi", (language or "")[:2].lower()):
        for kind, words in ABBREVIATIONS.get(lang, {}).items():
            out[kind] |= set(words.split())
    return out


def _spans(text: str) -> list[tuple[int, int]]:
    """Matched quotations and brackets (positions of both marks); those that do not close within a paragraph are none."""
    found, stack = [], []
    awaited: Counter = Counter()  # closing marks that would close something open
    for m in _MARKS.finditer(text):
        i, ch = m.start(), m.group()
        if ch == "\n":
            stack = []
            awaited.clear()
        elif ch in _CLOSERS and awaited[ch] > 0:
            while stack:
                o, start = stack.pop()
                awaited.subtract(PAIRS[o])
                if ch in PAIRS[o]:
                    found.append((start, i))
                    break
        elif ch in PAIRS:
            stack.append((ch, i))
            awaited.update(PAIRS[ch])
    return found


def _word_start(text: str, i: int) -> int:
    """Where the word before position i starts; longer words than ``BACK`` are cut."""
    k = i
    while k > 0 and i - k < BACK and not text[k - 1].isspace() and text[k - 1] not in _STOPS:
        k -= 1
    return k


def _korean_end(line: str) -> bool:
    """A finished predicate: a noun form, a polite ending, or a past form before -da."""
    if _KO_NOT.search(line):
        return False
    if _KO_NOUN.search(line) or line.endswith(("니다", "세요", "해요", "까요", "습니까", "니까", "나요")):
        return True
    return len(line) > 1 and line[-1] == "다" and "가" <= line[-2] <= "힣" and (ord(line[-2]) - 0xAC00) % 28 == 20


def _is_thai(ch: str) -> bool:
    return "฀" <= ch <= "๿"


def _is_unspaced(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "一" <= ch <= "鿿" or _is_thai(ch)


def _line_ends(text: str, a: int, b: int) -> bool:
    """Whether the line break text[a:b] after a line without end mark ends a sentence."""
    before, after = text[a - 1], text[b : b + 1]
    if text.count("\n", a, b) > 1 or not after:
        return True
    if before in ",;:、，；：-–—&/" or after.islower():
        return False
    if _is_unspaced(before):
        return True
    if "가" <= before <= "힣":
        return _korean_end(text[text.rfind("\n", 0, a) + 1 : a])
    if not before.isalnum() or before.isdigit():
        return False
    # Latin and other cased scripts: without an end mark a line goes on, as German nouns and names are capitalised too.
    return False


def boundaries(text: str | None, language: str | None = None) -> list[int]:
    """End positions (code points, exclusive) of the sentences of a text; null, empty or blank text has none."""
    if not text or not text.strip():
        return []
    sets, spans = _sets(language), sorted(_spans(text))
    starts, closes = [a for a, _ in spans], {b for _, b in spans}
    farthest = list(accumulate((b for _, b in spans), max))
    ends: list[int] = []
    cuts: list[int] = []

    def enclosing_end(i: int) -> int:
        """The end of the outermost span that holds position i, or -1."""
        k = bisect_left(starts, i)
        return farthest[k - 1] if k and farthest[k - 1] > i else -1

    last = len(text.rstrip())
    for m in _TERM.finditer(text):
        i, j = m.span()
        if enclosing_end(i) >= 0:
            # Inside a quotation or bracket: only the place after its close can be an end.
            close = _CLOSE.match(text, j).end()
            out = enclosing_end(i)
            if out >= close or close - 1 not in closes:
                continue
            k, quoted = close, True
        else:
            k, quoted = _CLOSE.match(text, j).end(), False
        marks = m.group()
        gap = _SPACES.match(text, k).end() - k
        nxt = text[k + gap : k + gap + 1]
        line = "\n" in text[k : k + gap]
        if not nxt:
            cuts.append(k)
            continue
        if text.count("\n", k, k + gap) > 1:
            cuts.append(k)
            continue
        if quoted:
            # A closing mark directly before a letter, or before lower case or a script without case, goes on.
            if gap and nxt.isupper() and not _is_unspaced(nxt):
                cuts.append(k)
            elif line and not nxt.islower() and marks[-1] in _FULL:
                cuts.append(k)
            continue
        if marks.strip("….") == "":
            if len(marks) > 1 or "…" in marks:  # an ellipsis
                if gap and nxt.isupper():
                    cuts.append(k)
                continue
            if not gap and marks == ".":
                continue
            if not gap and not (marks == "．" and not nxt.isdigit()):
                continue
            if nxt.islower():
                continue
            begin = _word_start(text, i)
            w = text[begin:i]
            lw = w.lower().rstrip(".")
            if lw in sets["any"] or (lw in sets["number"] and not nxt.isupper() and (nxt.isdigit() or not nxt.isalpha())):
                continue
            if lw in sets["number"] and not lw.isdigit() and nxt.isalpha() and lw in ("abb", "nr", "fig", "sec", "kap"):
                continue
            if lw in sets["open"] and not nxt.isupper() and not _is_unspaced(nxt):
                continue
            while begin > 0 and w and text[begin - 1].isspace():
                begin -= 1
            before = text[max(0, begin - BACK) : begin].split() if w else []
            pw = before[-1] if before else ""
            if len(w) == 1 and w.isupper():
                if pw.rstrip(".").lower() in ("z", "u", "d", "p"):
                    continue
                if not (pw.islower() or pw.lower() in PLACES):
                    continue
            if w.isdigit():
                follow = _WORD.match(text, k + gap, k + gap + BACK)
                if follow and (follow.group().lower() in MONTHS or (len(w) < 3 and pw.lower() in ORDINAL_LEAD)):
                    continue
                if _DATE.search(text[max(0, i - 14) : i]) or re.fullmatch(r"\d{4}", w):
                    if "가" <= nxt <= "힣" or nxt.isdigit():
                        continue
            if _INITIALS.fullmatch(w) and lw not in sets["open"] and nxt.isalpha() and not nxt.isupper():
                continue
            cuts.append(k)
            continue
        # Other terminators: full-width ones end at once, the rest before white space.
        if marks[-1] in _FULL or gap:
            if not nxt.islower():
                cuts.append(k)
    done = set(cuts)
    for m in _LINES.finditer(text):
        a, b = m.span()
        while a > 0 and text[a - 1].isspace():
            a -= 1
        if a == 0 or a in done or a >= last:
            continue
        if enclosing_end(a) >= 0:
            continue
        tail = text[max(0, a - 4) : a]
        if _ENDED.search(tail) and text.count("\n", a, b) == 1:
            continue
        if _line_ends(text, a, b):
            cuts.append(a)
    if re.search(r"[฀-๿]", text):
        for m in _THAI_GAP.finditer(text):
            if enclosing_end(m.start()) < 0 and not _THAI_REST.match(text, m.end()):
                cuts.append(m.start())
    start = 0
    for c in sorted(set(cuts)):
        if _LETTER.search(text, start, c):
            ends.append(c)
        elif ends and text[start:c].strip():
            ends[-1] = c
        start = c
    if not ends or ends[-1] < last:
        if not ends or _LETTER.search(text, ends[-1], last):
            ends.append(last)
        else:
            ends[-1] = last
    return ends


def split(text: str | None, language: str | None = None) -> list[str]:
    """The sentences of a text, trimmed."""
    out, start = [], 0
    for e in boundaries(text, language):
        out.append(text[start:e].strip())
        start = e
    return out


def sentence_ends(blocks: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """``blocks`` with ``ends``, the end positions of the sentences of each text; the texts are not shuffled."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, lang in batches:
            yield pd.Series([boundaries(x, y) for x, y in zip(t, lang)], index=t.index, dtype=object)

    return blocks.withColumn("ends", F.pandas_udf(run, "array<int>")(F.col(text), F.col(language)))
