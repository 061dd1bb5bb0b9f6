"""Text that was decoded with the wrong encoding (problem 4).

Every distinct clean word of the corpus is garbled by every encoding chain. The tokens of the documents are joined by hash
with this table; what matches is garbled, and is replaced by the word it is a form of. A word is a run of characters
without ASCII below ``@`` (no such byte is ever swallowed by a wrong decoding, so words garble independently of what is
around them), the part of a word beyond ASCII, and, for scripts without spaces, every window of four characters.
"""

from __future__ import annotations

import codecs
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.filters import key_filter, passes
from foliospark.session import checkpointed, shuffle_partitions


class Chain(NamedTuple):
    """Text in the encoding ``true`` read as ``wrong``, so many times; ``lost``: undefined bytes are lost, not controls."""

    true: str
    wrong: str
    times: int = 1
    lost: bool = False
    then: str | None = None


SINGLE = ("cp1252", "latin-1", "cp437", "mac-roman", "cp850", "cp1251", "koi8-r", "iso8859-15", "cp1254", "cp874")
MULTI = ("cp949", "cp932", "gbk", "big5")
# What one wrong decoding may be.
STEPS = [
    *[("utf-8", w) for w in SINGLE + MULTI],
    *[(t, w) for t in ("cp949", "cp932", "gbk", "euc_jp", "big5", "cp874") for w in ("cp1252", "latin-1")],
    ("euc_jp", "cp932"), ("cp932", "euc_jp"), ("cp949", "cp932"), ("cp932", "cp949"), ("cp949", "gbk"), ("gbk", "cp949"), ("gbk", "cp932"), ("cp932", "gbk"), ("euc_jp", "gbk"), ("euc_jp", "cp949"),
    *[("cp1252", w) for w in ("cp437", "cp850", "mac-roman", "cp949", "cp932", "gbk")], ("mac-roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    *[(t, "utf-8") for t in ("cp1252", "mac-roman", "cp949", "cp932", "gbk", "euc_jp", "big5", "cp874")],
]
# What is decoded wrongly more than once.
REPEATED = ("cp1252", "latin-1", "cp437", "mac-roman")
# Chains whose reverse is a chain as well: a garbled word has its original as a "form".
TWO_WAY = {(t, w) for t, w in STEPS if (w, t) in STEPS and "utf-8" not in (t, w)}

# Characters of a window, and parts into which the texts with one garbled word are spread.
WINDOW, SALTS = 4, 8
_TOKEN = re.compile(r"[^\x00-\x3f]*[^\x00-\x7f][^\x00-\x3f]*")
_RUN = re.compile(r"[^\x00-\x7f]+")
_LOST = re.compile("�{2,}")
# Scripts without spaces between words, whose long runs are taken as windows only.
_UNSPACED = re.compile(r"[฀-๿⺀-꓏豈-﫿＀-￯]{4}")
_SEQUENCE = re.compile(rb"[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|\xF0[\x90-\xBF][\x80-\xBF]{2}")
_P = np.uint64(0x9E3779B97F4A7C15)


def _byte_table(name: str) -> str:
    """The character of every byte; undefined bytes stand for themselves as controls."""
    return "".join(c if (c := bytes([b]).decode(name, "replace")) != "�" else chr(b) for b in range(256))


_TABLES = {n: _byte_table(n) for n in SINGLE}
_BYTES = {n: {c: b for b, c in reversed(list(enumerate(t)))} for n, t in _TABLES.items()}


def _chains() -> list[Chain]:
    out = []
    for true, wrong in STEPS:
        for lost in (False, True) if wrong in _TABLES and "�" in bytes(range(256)).decode(wrong, "replace") else (wrong not in _TABLES,):
            out.append(Chain(true, wrong, 1, lost))
            if true == "utf-8" and wrong in REPEATED:
                out += [Chain(true, wrong, 2, lost), Chain(true, wrong, 3, lost)]
    return [*out, Chain("utf-8", "latin-1", 1, False, "cp1252"), Chain("utf-8", "latin-1", 1, False, "cp437")]


CHAINS = _chains()


def wrong_decode(data: bytes, name: str, lost: bool = False) -> str:
    """Bytes read in a wrong encoding; undefined bytes become controls or, if ``lost``, replacement characters."""
    return codecs.charmap_decode(data, "strict", _TABLES[name])[0] if name in _TABLES and not lost else data.decode(name, "replace")


def garble(text: str, chain: Chain) -> str:
    """The text as the chain makes it; characters that the true encoding lacks become question marks."""
    for _ in range(chain.times):
        text = wrong_decode(text.encode(chain.true, "replace"), chain.wrong, chain.lost)
    return wrong_decode(text.encode("utf-8"), chain.then) if chain.then else text


def wrong_encode(text: str, name: str) -> bytes | None:
    """The bytes a wrongly decoded text came from, or None; a replacement character gives a byte that fits nowhere."""
    table = _BYTES.get(name)
    if table is not None:
        out = bytes(table.get(c, 0xFF if c == "�" else 0x100) % 0x101 if c in table or c == "�" else 0 for c in text)
        return None if b"\0" in out else out
    try:
        return b"\xff".join(part.encode(name) for part in text.split("�"))
    except UnicodeEncodeError:
        return None


def _steps_of(chain: Chain) -> list[tuple[str, str, bool]]:
    return [(chain.true, chain.wrong, chain.lost)] * chain.times + ([("utf-8", chain.then, False)] if chain.then else [])


def ungarble(text: str, chain: Chain) -> str | None:
    """What the chain made the text from, as far as it still exists; None if nothing of it is. Garbling it again gives the text."""
    for true, wrong, _ in reversed(_steps_of(chain)):
        data = wrong_encode(text, wrong) if wrong != "utf-8" else None
        if data is None:
            return None
        if true == "utf-8":
            out, at = [], 0
            # What is no sequence stays as it is, or is lost where most is one; a byte of a single-byte encoding is one character.
            mostly = 2 * sum(len(x) for x in _SEQUENCE.findall(data)) > sum(x > 0x7F for x in data)
            kept = (lambda a, b: re.sub(r"[^\x00-\x7f]+", "�", text[a:b]) if mostly else text[a:b]) if wrong in _TABLES else (lambda a, b: "�".join(x.decode(wrong, "replace") for x in data[a:b].split(b"\xff")))  # noqa: E731, B023
            for m in _SEQUENCE.finditer(data):
                out += [kept(at, m.start()), m.group().decode("utf-8", "replace")]
                at = m.end()
            if not at:
                return None
            back = "".join(out) + kept(at, len(data))
        else:
            back = "�".join(x.decode(true, "replace") for x in data.split(b"\xff"))
            if back.count("�") > 2 * text.count("�"):
                return None
        text = back
    return text


# ---------------------------------------------------------------- words of texts
def tokens_of(text: str) -> list[str]:
    """The words of a text that are not all ASCII; several lost characters in a row are one."""
    return [_LOST.sub("�", x) for x in _TOKEN.findall(text)] if not text.isascii() else []


def _lines(joined: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lines, with the start and length of each line."""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.r_[np.flatnonzero(codes == 10), len(codes)]
    starts = np.r_[0, ends[:-1] + 1]
    return codes, starts, ends - starts


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _P
    return h ^ (h >> np.uint64(29))


def word_keys(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each line; empty lines get that of their line break."""
    if not len(starts):
        return np.empty(0, dtype=np.int64)
    c = np.r_[codes.astype(np.uint64), np.uint64(10)]
    place = np.arange(len(c)) - np.repeat(starts, lengths + 1)
    power = np.multiply.accumulate(np.full(int(lengths.max()) + 2, _P | np.uint64(1)))
    return _mix(np.add.reduceat(_mix(c + np.uint64(1)) * power[place], starts)).view(np.int64)


def window_keys(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, usable) of the windows that start at given places: four characters beyond ASCII, each of 16 bits."""
    key, good = np.zeros(len(at), dtype=np.uint64), at + WINDOW <= len(codes)
    at = np.where(good, at, 0)
    for i in range(WINDOW):
        c = codes[at + i] if len(codes) else np.zeros(0, np.uint32)
        good &= (c > 0x7F) & (c < 0x10000)
        key = key << np.uint64(16) | c.astype(np.uint64)
    return _mix(key).view(np.int64), good


def _windows(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """(number of the token, key, place in the joined tokens, the joined tokens) of all windows of all tokens."""
    joined = "\n".join(tokens)
    codes, starts, lengths = _lines(joined)
    at = np.arange(max(0, len(codes) - WINDOW + 1))
    key, good = window_keys(codes, at)
    at = at[good]
    return np.searchsorted(starts, at, side="right") - 1, key[good], at, joined


def count_words(texts: list[str]) -> pd.DataFrame:
    """(key, word, n) of the words, runs and windows of texts; words that are looked up but not garbled have no text."""
    words: Counter = Counter()
    for t in texts:
        words.update(tokens_of(t))
    tokens, n = list(words), np.array(list(words.values()), dtype=np.int64)
    own, key, at, joined = _windows(tokens)
    once, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    frames = [pd.DataFrame({"key": once, "word": [joined[p : p + WINDOW] for p in at[first].tolist()], "n": np.bincount(inverse, n[own]).astype(np.int64) if len(key) else np.empty(0, np.int64), "window": True})]
    runs: Counter = Counter()
    for t, c in words.items():
        for r in _RUN.findall(t):
            if len(r) < len(t):
                runs[r] += c
        if "�" in t and t != "�":
            runs["�"] += c
    both = tokens + list(runs)
    if both:
        text = [x if not _UNSPACED.search(x) else None for x in both]
        frames.append(pd.DataFrame({"key": word_keys(*_lines("\n".join(both))), "word": text, "n": [*n.tolist(), *runs.values()], "window": False}))
    return pd.concat(frames, ignore_index=True)


def words_in(texts: list[str], has: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, key) of the words, runs and windows that a filter lets pass."""
    number: dict[str, int] = {}
    owner, which = [], []
    for i, t in enumerate(texts):
        for x in set(tokens_of(t)):
            owner.append(i)
            which.append(number.setdefault(x, len(number)))
    tokens = list(number)
    if not tokens:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    pieces = [(j, r) for j, t in enumerate(tokens) for r in {t, *_RUN.findall(t), *(["�"] if "�" in t else [])}]
    own, key, _, _ = _windows(tokens)
    own = np.r_[own, [j for j, _ in pieces]].astype(np.int64)
    key = np.r_[key, word_keys(*_lines("\n".join(r for _, r in pieces)))]
    keep = passes(has, key)
    own, key = own[keep], key[keep]
    order = np.argsort(own, kind="stable")
    own, key = own[order], key[order]
    which = np.array(which)
    low, high = np.searchsorted(own, which), np.searchsorted(own, which, side="right")
    count = high - low
    at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return np.repeat(np.array(owner), count), key[at]


# ---------------------------------------------------------------- the table of garbled forms
def forms(words: list[str], n: np.ndarray, windows: bool, has: np.ndarray) -> pd.DataFrame:
    """(key, form, word, chain, n, form_run, word_run) of the garbled forms of words that a filter lets pass.

    The last two are the first parts beyond ASCII of both. Of a window's form the first characters count; where two bytes are read as one character, also with half a character
    less, since the window may start within one. Where any form has lost characters, these are a form by themselves.
    """
    joined, out = "\n".join(words), []
    lost_key = int(word_keys(*_lines("�"))[0])
    for number, chain in enumerate(CHAINS):
        s, bad = joined, None
        for true, wrong, lost in _steps_of(chain):
            data = s.encode(true, "replace")
            if true != "utf-8" and bad is None and b"?" in data:
                bad = np.add.reduceat(np.frombuffer(data + b"\n", dtype=np.uint8) == 63, np.r_[0, np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1]) > 0
            s = wrong_decode(data, wrong, lost)
        shifted = wrong_decode(re.sub(rb"(^|\n)[\x80-\xff]", rb"\1", data), chain.wrong, chain.lost) if windows and chain.wrong in MULTI + ("euc_jp",) else None
        for made in (s, shifted):
            if made is None:
                continue
            if "�" in made:
                made = _LOST.sub("�", made)
                out.append((lost_key, "�", words[0], number, 0, None, None))
            codes, starts, lengths = _lines(made)
            if windows:
                key, good = window_keys(codes, starts)
            else:
                key, good = word_keys(codes, starts, lengths), lengths > 0
            good = good & passes(has, key)
            if bad is not None:
                good &= ~bad
            for i in np.flatnonzero(good).tolist():
                form = made[starts[i] : starts[i] + (WINDOW if windows else lengths[i])]
                if form != words[i]:
                    a, b = (None, None) if windows else (_RUN.search(form), _RUN.search(words[i]))
                    out.append((key[i], form, words[i], number, n[i], a and a.group(), b and b.group()))
    return pd.DataFrame(out, columns=["key", "form", "word", "chain", "n", "form_run", "word_run"])


def garbled_words(words: DataFrame) -> DataFrame:
    """(key, form, word, chain, n, sure, clean) of the words of (key, word, n, window) that are garbled forms of others.

    A form counts if it has three characters beyond ASCII, or some beside ASCII letters, or is one letter's two bytes, or
    has lost characters, which what is read as UTF-8 must have. Where a chain leads back, the form must be rarer than the word (and its changed letters rarer
    than the word's, if it has ASCII letters too), and so must two bytes. ``sure`` is false where one match in a text is not enough, ``clean`` where
    the word is itself a form.
    """
    has = words.sparkSession.sparkContext.broadcast(key_filter(words))

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for w, part in pdf.groupby("window"):
                yield forms(part["word"].tolist(), part["n"].to_numpy(), bool(w), has.value)

    # Few bytes of words make many forms: their number of tasks must not be taken from their size.
    some = words.where("word IS NOT NULL").repartition(shuffle_partitions(words.sparkSession))
    made = some.mapInPandas(table, "key long, form string, word string, chain int, n long, form_run string, word_run string").groupBy("key", "form", "chain")
    made = made.agg(F.max_by(F.struct("word", "form_run", "word_run"), F.struct("n", "word")).alias("w"), F.max("n").alias("n")).select("key", "form", "chain", "n", "w.*")
    made = made.where(~F.col("chain").isin([i for i, c in enumerate(CHAINS) if c.wrong == "utf-8"]) | F.col("form").contains("�"))
    met = made.join(words.select("key", F.col("word").alias("own"), F.col("n").alias("ng")), "key").where("own IS NULL OR own = form")
    back = F.col("chain").isin([i for i, c in enumerate(CHAINS) if (c.true, c.wrong) in TWO_WAY])
    beyond = F.length(F.regexp_replace("form", r"[\x00-\x7f]", ""))
    lost = F.col("form").contains("�")
    letters = F.col("form").rlike("[A-Za-z]")
    rarer = F.col("n") > F.col("ng")
    two_bytes = F.col("chain").isin([i for i, c in enumerate(CHAINS) if c.true == "utf-8"]) & (F.length("form") == 2) & (F.length("word") == 1) & rarer
    met = met.withColumn("sure", lost | two_bytes | (~back & ((beyond >= 3) | letters))).withColumn("unsure", back & ~letters & (beyond >= 3) & rarer)
    runs = words.where("word IS NOT NULL AND NOT window").select("word", "n")
    for c in ("form", "word"):
        met = met.join(runs.select(F.col("word").alias(f"{c}_run"), F.col("n").alias(f"{c}_n")), f"{c}_run", "left")
    mixed = back & letters & (F.col("n") >= F.col("ng")) & (F.coalesce("word_n", F.lit(0)) > F.coalesce("form_n", F.lit(0)))
    columns = ["key", "form", "word", "chain", "n", "sure"]
    found = checkpointed(met.withColumn("sure", F.col("sure") | mixed).where("sure OR unsure").select(*columns))
    dirty = found.where("sure").select(F.col("form").alias("word"), F.lit(False).alias("clean")).distinct()
    return found.join(dirty, "word", "left").withColumn("clean", F.coalesce("clean", F.lit(True)))


# ---------------------------------------------------------------- restoring
class Hit(NamedTuple):
    form: str
    word: str
    chain: int
    n: int
    clean: bool


def restore_text(text: str, hits: list[Hit]) -> str:
    """The text with the originals of its garbled words; ``hits`` are the forms it holds.

    A whole word is replaced by the most frequent word it is a form of. In other words, what the same chains made is
    undone: where the word holds a window that is a form, or where its characters are single bytes of the wrong encoding;
    garbling the result gives the text again. Lost characters stay lost where no word tells them.
    """
    hits = sorted(hits, key=lambda h: (h.clean, h.n, h.word))
    whole = {h.form: h.word for h in hits if h.clean}
    windows = {h.form for h in hits if len(h.form) == WINDOW}
    told = [h for h in hits if h.form != "�"]
    votes = Counter(h.chain for h in told if h.clean) or Counter(h.chain for h in told)
    chains = [c for c, v in votes.most_common() if CHAINS[c].wrong != "utf-8" and 4 * v >= max(votes.values())]

    def one(m) -> str:
        token = m.group()
        short = _LOST.sub("�", token)
        if short in whole and short != "�" and not (len(short) == WINDOW and len(whole[short]) == WINDOW and _UNSPACED.search(whole[short])):
            return whole[short]
        held = any(token[i : i + WINDOW] in windows for i in range(len(token) - WINDOW + 1))
        tried = []
        for c in chains:
            chain = CHAINS[c]
            if chain.wrong in _TABLES and chain.true in _TABLES:
                continue  # any Latin text could be undone so
            if chain.wrong in _TABLES and (chain.true == "utf-8" or held or not re.search("[A-Za-z]", token)):
                tried.append(_BYTES_OF[chain.wrong].sub(lambda x: _undone(x.group(), chain), token))  # noqa: B023
            elif chain.wrong not in _TABLES and held:
                tried.append(_undone(token, chain))
        tried = [x for x in tried if x != token]
        if tried:
            return min(tried, key=lambda x: (x.count("�"), len(x)))
        return _RUN.sub(lambda x: whole[x.group()] if x.group() in whole and len(x.group()) < len(token) and "�" not in x.group() else x.group(), token)

    return _TOKEN.sub(one, text)


def _undone(part: str, chain: Chain) -> str:
    back = ungarble(part, chain) if not part.isascii() else None
    if back is None:
        return part
    same = "�" in back or chain.wrong not in _TABLES or any(garble(back, chain._replace(lost=x)) == part for x in (False, True))
    return back if same else part


# Stretches that a single-byte encoding may have made.
_HIGH = {n: "".join(re.escape(c) for c in t[128:]) + "�" for n, t in _TABLES.items()}
_BYTES_OF = {n: re.compile(f"[@-~{h}]*[{h}][@-~{h}]*") for n, h in _HIGH.items()}


def find_garbled(blocks: DataFrame) -> DataFrame:
    """(document_id, sequence, text, restored): the blocks whose text is garbled wholly or in part.

    Null and empty texts, and texts in ASCII, are no cases. Repeated rows count once. The texts are read twice: their
    words, counted in tasks first, give the table of forms, and then each text is looked up. What is shuffled are distinct
    words, forms that may occur, and the garbled words of each text; filters of a fixed size keep the rest out, and a word
    that is garbled in very many texts is spread by salt.
    """
    b = blocks.where("text IS NOT NULL").select("document_id", "sequence", "text").where(~F.col("text").rlike(r"^[\x00-\x7f]*\z"))
    # The texts are worked on far longer than read: their number of tasks must not be taken from their size.
    spread = shuffle_partitions(blocks.sparkSession)
    b = b.repartition(spread, "document_id", "sequence", "text").distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield count_words(pdf["text"].tolist())

    counted = b.select("text").mapInPandas(count, "key long, word string, n long, window boolean")
    words = checkpointed(counted.groupBy("key").agg(F.max("word").alias("word"), F.sum("n").alias("n"), F.max("window").alias("window")))
    table = checkpointed(garbled_words(words))
    has = blocks.sparkSession.sparkContext.broadcast(key_filter(table))

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text, key = words_in(pdf["text"].tolist(), has.value)
            yield pd.DataFrame({"block": pdf["block"].to_numpy()[text], "key": key, "salt": (pdf["block"].to_numpy()[text] % SALTS).astype(np.int32)})

    b = b.withColumn("block", F.xxhash64("document_id", "sequence", "text"))
    seen = b.select("block", "text").mapInPandas(look_up, "block long, key long, salt int")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    seen = seen.withColumn("salt", F.pmod("salt", F.lit(SALTS))).join(salted, ["key", "salt"])
    hits = seen.groupBy("block").agg(F.max("sure").alias("sure"), F.countDistinct("key").alias("n"), F.collect_set(F.struct("form", "word", "chain", "n", "clean")).alias("hits")).where("sure OR n >= 2")

    def restore(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            yield pd.Series([restore_text(t, [Hit(**h) for h in f]) for t, f in zip(texts, found)], index=texts.index, dtype=object)

    return b.join(hits, "block").select("document_id", "sequence", "text", F.pandas_udf(restore, "string")("text", "hits").alias("restored"))
