import itertools
import random
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import components, duplicates, filters, garble, leaks, neighbours, packing, scans, sentences, unify

rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(400)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


# ---------------------------------------------------------------- problem 1
def brute_groups(contents):
    folded = {k: " ".join(t.lower().split()) for k, t in contents.items() if t and t.strip()}
    sets = {k: duplicates.runs_of(t) for k, t in folded.items()}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both >= 0.65 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if find(a) == find(b)}


def edited(r, text, edits):
    t = list(text)
    for _ in range(edits):
        i = r.randrange(len(t))
        t[i : i + r.randint(0, 2)] = r.choice("abcdefgh ")
    return "".join(t)


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(1)
    base = [prose(r, r.randint(4, 90)) for _ in range(40)]
    contents = {f"b{i:03}": t for i, t in enumerate(base)}
    for i, t in enumerate(base):
        for j in range(r.randint(0, 3)):
            contents[f"e{i:03}{j}"] = edited(r, t, max(1, len(t) // 70))
    contents |= {"null": None, "blank": "  \n ", "same1": base[0].upper(), "same2": base[0].replace(" ", "  "), "tiny1": "ab", "tiny2": "AB", "tiny3": "cd", "long": prose(r, 20000), "longer": prose(random.Random(9), 20000)}
    rows = [(k, t, 0) for k, t in contents.items()] * 2
    df = spark.createDataFrame(rows, "chunk_id string, content string, text int")
    got = duplicates.pairs_in_groups(duplicates.near_duplicates(df, "chunk_id", "content"), "chunk_id")
    assert {tuple(x) for x in got.collect()} == brute_groups(contents)
    assert duplicates.near_duplicates(df.limit(0), "chunk_id", "content").count() == 0


def test_a_large_family_of_copies_is_one_group(spark):
    r = random.Random(2)
    t = prose(r, 60)
    rows = [(i, edited(r, t, 2)) for i in range(150)] + [(1000 + i, prose(r, 60)) for i in range(150)]
    g = duplicates.near_duplicates(spark.createDataFrame(rows, "k long, content string"), "k", "content").collect()
    assert {x["k"] for x in g} == set(range(150)) and len({x["group"] for x in g}) == 1


def test_short_sets_are_never_missed():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(6, 22)
        a = "".join(r.choice("abcdefgh") for _ in range(n))
        b = edited(r, a, 1) or a
        x, y = duplicates.runs_of(a), duplicates.runs_of(b)
        if len(x & y) >= 0.65 * len(x | y) and max(len(x), len(y)) <= duplicates.SMALL:
            s, t = duplicates.signatures([a, b])
            assert np.intersect1d(s, t).size


def test_sketches_lose_no_pair():
    r = random.Random(5)
    for n in (30, 120, 400):
        a = prose(r, n)
        b = edited(r, a, len(a) // 60)
        (na, nb), (sa, sb) = duplicates.sketches([a, b])
        x, y = duplicates.runs_of(a), duplicates.runs_of(b)
        import pandas as pd

        if len(x & y) >= 0.65 * len(x | y):
            assert duplicates._may_be_similar(pd.Series([sa]), pd.Series([sb]), pd.Series([na]), pd.Series([nb]))[0]


def test_no_link_at_the_limit_is_missed(spark):
    """Groups of two records just at the limit that agree in no signature."""
    r = random.Random(6)
    pairs = []
    for _ in range(2000):
        t = [r.choice("abcdefghijklmnop") for _ in range(r.randint(60, 300))]
        a, x = "".join(t), duplicates.runs_of("".join(t))
        for j in r.sample(range(len(t)), len(t)):
            before, t[j] = t[j], r.choice("qrstuv")
            y = duplicates.runs_of("".join(t))
            if len(x & y) < 0.65 * len(x | y):
                t[j] = before
                break
        pairs.append((a, "".join(t)))
    s = duplicates.signatures([t for p in pairs for t in p])
    apart = [p for i, p in enumerate(pairs) if not np.intersect1d(s[2 * i], s[2 * i + 1]).size]
    assert len(apart) > 5
    contents = dict(enumerate(t for p in apart + pairs[:20] for t in p))
    df = spark.createDataFrame(list(contents.items()), "k long, content string")
    got = duplicates.pairs_in_groups(duplicates.near_duplicates(df, "k", "content"), "k")
    assert {tuple(x) for x in got.collect()} == brute_groups(contents)


def test_the_pairs_between_groups_leave_out_only_a_hot_group_itself(monkeypatch, spark):
    monkeypatch.setattr(duplicates, "HOT", 10)
    r = random.Random(7)
    t = prose(r, 40)
    docs = [(i, i, edited(r, t, 1)) for i in range(40)]
    rows = spark.createDataFrame(docs, "id long, h long, text string")
    group = spark.createDataFrame([(i, 0) for i in range(30)], "id long, component long")
    got = {tuple(x) for x in duplicates.pairs_between_groups(rows, group).collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(docs, 2) if b[0] >= 30 and len(duplicates.runs_of(a[2]) & duplicates.runs_of(b[2])) >= 0.65 * len(duplicates.runs_of(a[2]) | duplicates.runs_of(b[2]))}
    assert want and want <= got and all(b >= 30 for _, b in got)


def test_the_exact_pass_forms_few_pairs_of_strangers():
    """Strangers that share many of their tokens, as where the vocabulary does not grow with the table; no pair is lost."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(4, 9))) for _ in range(150)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([2, 8, 25, 60]))) for _ in range(1200)]
    texts += [edited(r, t, len(t) // 30) for t in texts[:300]]
    width, units = duplicates.width_of(len(texts)), {}
    for part, rows, info, count, token in duplicates.pieces(texts, width):
        units.setdefault(part, []).append((rows, rows, info, count.astype(np.int64), token))
    got = set()
    for part, x in units.items():
        got |= {tuple(p) for p in duplicates.meeting_records(part >> 16, width, *map(np.concatenate, zip(*x))).tolist()}
    sets = [duplicates.runs_of(t) for t in texts]
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.65 * len(sets[a] | sets[b])}
    assert len(want) > 250 and want <= got and len(got) < 20 * len(want)


def test_pairs_of_a_unit_come_once_and_are_sorted_as_single_numbers(monkeypatch):
    r = random.Random(15)
    t = prose(r, 40)
    texts = [edited(r, t, 1) for _ in range(60)]
    plain = np.unique
    monkeypatch.setattr(np, "unique", lambda x, *more, **other: pytest.fail("rows are sorted") if np.ndim(x) > 1 else plain(x, *more, **other))
    met, units = set(), {}
    for part, rows, *x in duplicates.pieces(texts, 6.0):
        units.setdefault(part, []).append((10**12 - rows, *x))  # falling, beyond 32 bits
    for part, x in units.items():
        ids, info, count, token = map(np.concatenate, zip(*x))
        got = [tuple(p) for p in duplicates.meeting_records(part >> 16, 6.0, ids, ids, info, count.astype(np.int64), token).tolist()]
        assert len(got) == len(set(got)) and all(a < b for a, b in got) and {*itertools.chain(*got)} <= {*ids.tolist()}
        met |= set(got)
    sets = [duplicates.runs_of(x) for x in texts]
    want = {(10**12 - b, 10**12 - a) for a, b in itertools.combinations(range(60), 2) if len(sets[a] & sets[b]) >= 0.65 * len(sets[a] | sets[b])}
    assert len(want) > 1000 and want <= met


def test_what_the_exact_pass_sees_of_a_record_depends_on_no_other():
    """No order or threshold of the tokens is counted, in the table or in a part of it."""
    r = random.Random(9)
    texts = [prose(r, 5 + 3 * i) for i in range(40)]
    seen = lambda some: {(texts[some[i]], part): t for part, rows, _, n, token in duplicates.pieces([texts[i] for i in some], 7.0) for i, t in zip(rows.tolist(), map(tuple, np.split(token, np.cumsum(n)[:-1])))}
    together = seen(range(40))
    for i in range(40):
        alone = seen([i])
        assert alone and alone.items() <= together.items()


def test_records_meet_in_a_segment_only_within_the_deletions_of_both():
    r = random.Random(11)
    sets = [sorted(r.sample(range(14), r.randint(1, 12))) for _ in range(300)]
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 14, dtype=np.uint64)
    count, value = np.array([len(x) for x in sets]), hashes[np.concatenate(sets)]
    i, none = np.arange(len(sets)), np.zeros(len(sets))
    bounds = [i + 1, np.full(len(sets), len(sets)), none.astype(int), i]
    fits = lambda x, y, least: len({*x} & {*y}) >= least and len({*x} ^ {*y}) <= duplicates.deletions(len({*x} & {*y}))
    for few, least in ((none.astype(bool), duplicates.SPARE + 1), (~none.astype(bool), 1)):
        got = {tuple(sorted(p)) for a, b in duplicates._agreeing_records(bounds, few, count, value, none.astype(np.uint64), none) for p in zip(a.tolist(), b.tolist())}
        assert got == {(x, y) for x, y in itertools.combinations(range(len(sets)), 2) if fits(sets[x], sets[y], least)} and got


def test_sketches_and_signatures_do_not_depend_on_the_size_of_the_batch():
    r = random.Random(13)
    texts = [prose(r, 15) for _ in range(600)]
    (n, s), sigs = duplicates.sketches(texts), duplicates.signatures(texts)
    for i in (0, 7, 300):
        (m, t), (alone,) = duplicates.sketches([texts[i]]), duplicates.signatures([texts[i]])
        assert (m[0], t[0]) == (n[i], s[i]) and alone.tolist() == sigs[i].tolist()


def test_the_table_is_read_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    r = random.Random(12)
    texts = [prose(r, 20) for _ in range(20)]
    rows = [*enumerate([*texts, edited(r, texts[0], 1), texts[1], texts[2], texts[2].upper()]), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame(rows, "k long, content string").mapInPandas(counted, "k long, content string")
    got = {}
    for k, g in duplicates.near_duplicates(df, "k", "content").collect():
        got.setdefault(g, set()).add(k)
    assert sorted(map(sorted, got.values())) == [[0, 20], [1, 21], [2, 22, 23]]  # row 3 is only repeated
    assert seen.value == 2 * len(rows)


def test_only_texts_that_are_compared_are_read_again(spark):
    r = random.Random(10)
    texts = [prose(r, 20) for _ in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, edited(r, texts[0], 1)])], "id long, text string")
    docs = docs.withColumn("text", F.expr("if(id BETWEEN 1 AND 29, raise_error('read'), text)"))
    sizes, sketch = duplicates.sketches([*texts, edited(r, texts[0], 1)])
    k = spark.createDataFrame([(i, int(n), bytes(x)) for i, (n, x) in enumerate(zip(sizes, sketch))], "id long, n int, s binary")
    pairs = spark.createDataFrame([(0, 30)], "a long, b long")
    assert [tuple(x) for x in duplicates.verified(pairs, docs, k).collect()] == [(0, 30)]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 11), (None, 5), (4, 3)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10} | {100 + i: 100 for i in range(41)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- problem 2
def test_page_numbers():
    assert [scans.page_number_of(x) for x in ("12", "— 122 —", "Page 15 of 44", "l2", "xiv", "[7]", "9쪽", "12 / l9O", "Woche.", "p.m.", "", "of 3 parts")] == [12, 122, 15, 12, "xiv", 7, 9, 12, None, None, None, None]


def scan_table(spark):
    r = random.Random(6)
    pages = []
    for p in range(1, 9):
        body = [prose(r, 8) + "." for _ in range(12)]
        if p == 3:
            body[4], body[5] = "the whole com¬", "mittee agrees"
            body[7] = "23"
        if p == 4:
            body[2] = "the cornmittee met"
        head = "Qualun manual | Rev. 3" if p != 5 else "Qualun rnanual | Rev. 3"
        pages.append(("d", p, "\n".join([head, "", *body, "", f"- {p} -"]), 0.9, 1.0))
    words = " ".join(["committee"] * 40 + ["whole", "agrees", "met", "the"] * 20)
    pages += [("w", 1, words, 0.9, 1.0), ("n", 1, None, None, 1.0), ("n", 2, "", 0.0, 1.0), ("d", 1, pages[0][2], 0.9, 0.5)]
    return spark.createDataFrame(pages, "document_id string, page_number int, text string, confidence double, processing_time_ms double")


def test_scan_noise(spark):
    got = {tuple(x) for x in scans.find_noise(scan_table(spark)).collect()}
    want = {("d", p, 0, "running") for p in range(1, 9)} | {("d", p, 15, "page_number") for p in range(1, 9)} | {("d", 3, 6, "hyphen"), ("d", 4, 4, "misread")}
    assert got == want
    texts = {(r[0], r[1]): r[2] for r in scans.repair(scan_table(spark)).collect()}
    assert "whole committee agrees" in texts["d", 3] and "the committee met" in texts["d", 4] and "Rev. 3" not in texts["d", 5]
    assert scans.find_noise(scan_table(spark).limit(0)).count() == 0


def test_trie_finds_every_confusable_word():
    t = scans.Trie({"modern": 5, "modem": 3, "after": 9})
    assert set(t.near("rnodern", 1)) == {"modern"} and set(t.near("offer", 2)) == {"after"} and set(t.near("modern", 1)) == {"modem"}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_the_automaton_finds_every_word_within_one_edit():
    r = random.Random(13)
    words = {"".join(r.choice("kxqj") for _ in range(r.randint(3, 6))): i for i in range(1, 400)}  # letters without confusions
    t = scans.Trie(words)
    for _ in range(60):
        w = "".join(r.choice("kxqj") for _ in range(r.randint(3, 6)))
        assert set(t.near(w, 0, 1)) == {x for x in words if x != w and plain_distance(w, x) <= 1}


def test_words_that_are_too_rare_for_the_trie_are_reached_by_the_join(spark, monkeypatch):
    monkeypatch.setattr(scans, "LEAST_SHARE", 0.05)
    rows = {(x.document_id, x.page_number, x.line_no, x.kind) for x in scans.find_noise(scan_table(spark)).collect()}
    pages = scan_table(spark)
    c = scans.count_words(pages).where("kind = 'w'")
    assert c.where("word = 'agrees'").first()["n"] < 0.05 * c.agg(F.sum("n")).first()[0]
    more = pages.unionByName(spark.createDataFrame([("m", i, "agrees " * 9, 0.9, 1.0) for i in range(2)] + [("m", 9, "all agrces here", 0.9, 1.0)], pages.schema))
    got = {tuple(x) for x in scans.find_noise(more).collect()}
    assert rows <= got and ("m", 9, 0, "misread") in got
    assert "all agrees here" in [x["text"] for x in scans.repair(more).where("document_id = 'm' AND page_number = 9").collect()]


def test_the_cut_of_the_trie_changes_no_result(spark, monkeypatch):
    """Nothing, some of or all the vocabulary is left out of the trie, as in tables of other sizes."""
    r = random.Random(14)
    words = ["".join(r.choice("abcdehilmnorstuvwy") for _ in range(r.randint(2, 10))) for _ in range(60)] + ["검토위원회", "결재문서", "기술자료", "モータとシステム", "保守マニュアル"]
    pages = []
    for d in range(6):
        for p in range(1, 9):
            lines = []
            for _ in range(14):
                some = [words[min(int(r.expovariate(0.06)), len(words) - 1)] for _ in range(6)]
                if r.random() < 0.3:
                    i = r.randrange(6)
                    x = r.choice(sorted(scans.one_confusion(some[i])))
                    some[i] = r.choice(sorted(scans.one_confusion(x))) if r.random() < 0.5 else edited(r, x, 1)
                line = " ".join(some)
                if r.random() < 0.2:
                    line = line.replace("シ", "ツ").replace("ロ", "口").replace("ニ", "二")
                lines += [line[: len(line) - 3] + "-", line[-3:] + " " + some[0]] if r.random() < 0.3 else [line]
            pages.append((f"d{d}", p, "\n".join(lines), 0.9, 1.0))
    pages.append(("k", 1, "モータとシステム 保守マニュアル\n" * 60, 0.9, 1.0))
    table = spark.createDataFrame(pages, "document_id string, page_number int, text string, confidence double, processing_time_ms double")
    seen = []
    for share in (0.0, 0.003, 1.0):
        monkeypatch.setattr(scans, "LEAST_SHARE", share)
        seen.append([sorted(map(tuple, f(table).collect())) for f in (scans.find_noise, scans.repair)])
    assert {"hyphen", "misread"} <= {x[3] for x in seen[0][0]} and seen[0] == seen[1] == seen[2]


def test_pages_without_confidence_do_not_vouch_for_words_and_a_document_not_for_its_errors(spark):
    rows = [("a", 1, "zzyx " * 50, 0.2, 1.0), ("b", 1, "rnodern " * 40, 0.9, 1.0), ("c", 1, "plain", None, 1.0)]
    got = {r["word"]: (r["n"], r["own"]) for r in scans.count_words(spark.createDataFrame(rows, "document_id string, page_number int, text string, confidence double, processing_time_ms double")).collect()}
    assert got == {"zzyx": (0, 4), "rnodern": (40, 4), "plain": (1, 1)}


def test_joined_words_are_repaired_and_candidates_ranked_by_context():
    voc = scans.Vocabulary({"committee": 900, "modern": 500, "modem": 800, "whole": 300}, {}, 6)
    assert voc.repaired("rnodern", {"modern", "modern whole"}, after="whole") == "modern"
    text = scans.repair_page("the whole com-\nrnittee agrees", [], None, [], None, voc)
    assert text == "the whole committee agrees"
    assert scans.repair_line("the whoIe comm-", set(), voc, {}) == "the whole comm-"


# ---------------------------------------------------------------- problem 3
def test_neighbours_against_brute_force(spark):
    g = np.random.default_rng(0)
    centres = g.standard_normal((120, 64))
    x = (np.repeat(centres, 6, axis=0) + 0.25 * g.standard_normal((720, 64))).astype(np.float32)
    x[5] = x[4]
    rows = [(f"c{i:04}", v.tolist(), i, 1) for i, v in enumerate(x)]
    rows += [("null", None, 0, 1), ("short", [1.0] * 5, 0, 1), ("zero", [0.0] * 64, 0, 1), ("nan", [float("nan")] * 64, 0, 1), ("c0003", g.standard_normal(64).tolist(), -1, 1)]
    rows += [(f"copy{i}", x[100].tolist(), 0, 1) for i in range(12)]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, indexed_at long, h int").drop("h")
    got = {}
    for r in neighbours.nearest_neighbours(df).collect():
        got.setdefault(r["chunk_id"], set()).add(r["neighbour_id"])
    names = [r[0] for r in rows[:720]]
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -9)
    others = [i for i in range(720) if not 96 <= i < 102]
    hit = sum(len({names[j] for j in np.argsort(-s[i])[:5]} & got[names[i]]) for i in others)
    assert hit >= 0.95 * 5 * len(others)
    assert all(len(v) == 5 and k not in v for k, v in got.items()) and len(got) == 732
    assert got["copy7"] <= {"c0100", *(f"copy{i}" for i in range(12))}
    assert neighbours.nearest_neighbours(df.limit(0)).count() == 0


def test_a_hot_vector_takes_no_cells_from_others(spark, monkeypatch):
    """One vector and its near copies are half the rows, and groups are cut; recall stays."""
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    g = np.random.default_rng(11)
    hot = g.standard_normal(64)
    x = np.concatenate([np.repeat(hot[None], 3000, axis=0), hot + 0.05 * g.standard_normal((1000, 64)), np.repeat(g.standard_normal((400, 64)), 10, axis=0) + 0.2 * g.standard_normal((4000, 64))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(f"{i:05}", [float(v) for v in np.float32(r)], 0) for i, r in enumerate(x)]
    seen = []
    made = neighbours.Cells.__init__
    monkeypatch.setattr(neighbours.Cells, "__init__", lambda self, sample, n, dim: seen.append((n, self)) or made(self, sample, n, dim))
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>, indexed_at int")
    got = {(r[0], r[1]) for r in neighbours.nearest_neighbours(df).select("chunk_id", "neighbour_id").collect()}
    assert seen[0][0] == 5001 and len(np.unique(seen[0][1].centroids, axis=0)) == len(seen[0][1].centroids) and seen[0][1].blocks.max() > 1
    s = x[3000:] @ x.T
    want = set()
    for i in range(len(s)):
        s[i, 3000 + i] = -9
        # Among equal copies of the hot vector those with the smallest ids stand.
        s[i, 5:3000] = -9
        want |= {(f"{3000 + i:05}", f"{j:05}") for j in np.argsort(-s[i])[:5]}
    assert len(want & got) >= 0.98 * len(want)


@pytest.mark.parametrize("dense", [False, True])
def test_cells_grow_with_the_table(monkeypatch, dense):
    """With the limits set low: many cells by way of heads, few members of a cell also where all is dense; recall stays."""
    for name, value in {"CELL": 8, "PLAIN": 64, "GROUP": 8, "MAX_CELLS": 4096, "HEADS": 12}.items():
        monkeypatch.setattr(neighbours, name, value)
    g = np.random.default_rng(5)
    x = np.repeat(g.standard_normal((1 if dense else 800, 64)), 8000 if dense else 10, axis=0) + (0.01 if dense else 0.2) * g.standard_normal((8000, 64))
    if dense:  # a dense cloud of small clouds
        x = np.repeat(x[:800], 10, axis=0) + 0.002 * g.standard_normal((8000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c = neighbours.Cells(x, len(x), 64)
    near = c.nearest(x, 8)
    assert len(c.centroids) > 400 and np.bincount(near[:, 0]).max() < 120
    home = {}
    for i, cell in enumerate(near[:, 0].tolist()):
        home.setdefault(cell, []).append(i)
    hit = 0
    for i in range(0, 8000, 80):
        true = set(np.argsort(-(x @ x[i]))[:6].tolist()) - {i}
        hit += len(true & {j for cell in near[i].tolist() for j in home.get(cell, [])}) / len(true)
    assert hit >= 95


def test_neighbours_by_way_of_heads_and_blocks(spark, monkeypatch):
    for name, value in {"CELL": 8, "PLAIN": 16, "GROUP": 4, "HEADS": 8, "BLOCK": 40}.items():
        monkeypatch.setattr(neighbours, name, value)
    test_neighbours_against_brute_force(spark)


def test_error_bounds_hold():
    g = np.random.default_rng(1)
    x = g.standard_normal((300, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = neighbours.Cells(x, 300, 64)
    codes = neighbours.Codes(x, c.centroids[0], c.rotation)
    est, slack = codes.estimate(x[:50], c.centroids[0], c.rotation)
    assert (np.abs(est - x[:50] @ x.T) <= slack).mean() > 0.9


# ---------------------------------------------------------------- problem 4
@pytest.mark.parametrize("true,wrong", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac-roman"), ("utf-8", "cp437"), ("utf-8", "cp949"), ("utf-8", "gbk"), ("cp949", "latin-1")])
def test_garbled_text_is_found_and_restored(spark, true, wrong):
    clean = "모든 공용 보고서는 내부 예산을 북쪽 출입구에서 교체합니다"
    bad = garble.wrong_decode(clean.encode(true), wrong)
    rows = [("c", i, clean, 1) for i in range(3)] + [("b", 1, bad, 1), ("b", 1, bad, 1), ("n", 1, None, 1), ("n", 2, "", 1), ("n", 3, "plain", 1), ("l", 1, "A ROMÃ e a MAÇÃ são frutas.", 1), ("l", 2, "Façade, œuvre, Noël: “déjà vu” – 25 €.", 1), ("l", 3, "登録番号は鏞・縞・繧を含む。", 1)]
    got = garble.find_garbled(spark.createDataFrame(rows, "document_id string, sequence int, text string, run int")).collect()
    assert [(r["document_id"], r["sequence"]) for r in got] == [("b", 1)]
    assert got[0]["restored"] == clean or "�" in bad


def garbled_table(spark, clean, bad):
    rows = [("c", i, f"{i} {t}") for i, t in enumerate(clean)] + [("b", i, t) for i, t in enumerate(bad)]
    got = garble.find_garbled(spark.createDataFrame(rows, "document_id string, sequence int, text string")).collect()
    return {(r["document_id"], r["sequence"]): r["restored"] for r in got}


def test_repeated_and_partial_garbling_is_undone(spark):
    s = "The naïve reading costs €14 and the “café” isn’t open."
    once = garble.garble(s, garble.Chain("utf-8", "cp1252"))
    twice = garble.garble(s, garble.Chain("utf-8", "cp1252", 2))
    part = s + " " + garble.garble("It isn’t naïve.", garble.Chain("utf-8", "mac-roman"))
    lost = s.replace("ï", "\ufffd")
    assert garbled_table(spark, [s] * 3, [once, twice, part, lost]) == {("b", 0): s, ("b", 1): s, ("b", 2): s + " It isn’t naïve.", ("b", 3): s}


def test_every_chain_of_two_byte_encodings_is_found(spark):
    """Sentences of scripts without spaces, of any length, beside clean text, where the whole run stands nowhere else."""
    texts = {
        "cp949": ["모든 공용 보고서는 내부 예산을 북쪽 출입구에서 교체합니다.", "내부 예산을 북쪽 출입구에서 모든 보고서는 교체합니다."],
        "gbk": ["如果没有损坏的规程，钥匙下次审计前预约紧急的规程。", "负责人每周一次更新了内部的工作台和封面。"],
        "big5": ["如果沒有損壞的規程，鑰匙下次審計前預約緊急的規程。", "負責人每週一次更新了內部的工作檯和封面。"],
        "ja": ["臨時の報告書は書面の依頼により緊急のセンサーを分離します。", "手動のサーバーは共有フォルダーで申請書を確認します。"],
    }
    chains = [c for c in garble.CHAINS if c.true in ("gbk", "euc_jp", "cp932", "cp949", "big5")]
    clean = [t for pair in texts.values() for t in [*pair, "".join(pair)] * 10]
    bad = [garble.garble(a + b * 3, c) for c in chains for a, b in [texts.get(c.true, texts["ja"])]]
    got = garbled_table(spark, clean, bad)
    assert {k[0] for k in got} == {"b"} and [c for i, c in enumerate(chains) if ("b", i) not in got] == []
    whole = [a + b * 3 == got["b", i] for i, c in enumerate(chains) for a, b in [texts.get(c.true, texts["ja"])] if "�" not in bad[i]]
    assert sum(whole) >= 0.8 * len(whole)


def test_a_garbled_word_of_very_many_texts(spark):
    rows = [("d", i, f"{i} café") for i in range(300)] + [("d", 1000 + i, f"{i} cafÃ©") for i in range(200)]
    got = garble.find_garbled(spark.createDataFrame(rows, "document_id string, sequence int, text string")).collect()
    assert {r["sequence"] for r in got} == set(range(1000, 1200)) and all(r["restored"].endswith("café") for r in got)
    assert garble.find_garbled(spark.createDataFrame([], "document_id string, sequence int, text string")).count() == 0


def test_filters_keep_nothing_out(spark):
    keys = [random.Random(3).randint(-(2**63), 2**63 - 1) for _ in range(3000)]
    has = filters.key_filter(spark.createDataFrame([(k,) for k in keys], "key long"), 1 << 16)
    assert filters.passes(has, np.array(keys, dtype=np.int64)).all() and filters.passes(has, np.arange(10000, dtype=np.int64)).mean() < 0.2


# ---------------------------------------------------------------- problem 5
@pytest.mark.parametrize(
    "text,n",
    [
        ("Dr. Kelsen asked whether v1.2.0 was set to 9.75 bar. It was.", 2),
        ('"Check the circuit. Then wait for the bracket," said the planner. Done.', 2),
        ("“Why does it stop?” asked the archivist on the fourth floor.", 1),
        ("Both sites (U.S. and U.K.) keep it; Broulosen A. Moswissen signs for it.", 1),
        ("It closes in building C. Please note that it opens at 11 p.m. The rest waits", 3),
        ("Wait ... the platform summarises the\nmanual stage again.", 1),
        ("Die Gehäuse (vgl. Abb. 67) sind nach Nr. 26 größer, z. B. im 4. Stock. Am 5. Mai nicht.", 2),
        ("Les pièces du n° 4, p. ex. celles-ci, restent. M. Turlunsen note cela.", 2),
        ("긴급 온도계를 주 일 회 전달함\n고정식 컨베이어를 수리함", 2),
        ("모든 압축기는 저장소 안의\n긴급 질문을 검토했다. 계약서는 2031. 3. 59. 기준으로 확인합니다.", 2),
        ("“휴대용 승인서를 갱신합니다. 잠시 기다리세요.”라고 기획자는 말했다.", 1),
        ("“请限制外部的设备。稍等片刻。”负责人说道。工作台（见第15.5节。）回收电池！", 2),
        ("『鍵はなぜ止まる？』という議事録が届いた。いや……終わった。", 2),
        ("डॉ. Kelsen का बजट कम है। क्या यह सही है? हाँ।", 3),
        ("เจ้าหน้าที่ส่งคืนภาคผนวก ช่างตรวจสอบ33.5บาร์ที่ชั้นสี่", 2),
        ("", 0), ("   ", 0), (None, 0), ("...", 1),
    ],
)
def test_sentences(text, n):
    b = sentences.boundaries(text)
    assert len(b) == n
    if n:
        assert b[-1] == len(text.rstrip()) and b == sorted(set(b))


def test_time_grows_with_the_length_of_a_text():
    part = "Dr. Kelsen asked (see Fig. 3. Then wait.) whether it was set to 9.75 bar. “It was. Done.” No. 5 stays\nin building C. "
    t = {}
    for n in (200, 4000):
        start = time.perf_counter()
        b = sentences.boundaries(part * n)
        t[n] = time.perf_counter() - start
        assert len(b) == n * len(sentences.boundaries(part))
    assert t[4000] < 60 * t[200] + 0.5
    for odd in ("(" * 100000 + ")", ". " * 50000, "a\n" * 50000, " " * 200000 + "a.", '"' * 50001):
        start = time.perf_counter()
        assert len(sentences.boundaries(odd)) == 1 and time.perf_counter() - start < 10


def test_sentence_ends_on_a_table(spark):
    df = spark.createDataFrame([(1, "One. Two.", None, 5), (1, "One. Two.", None, 5), (2, None, "en", 5), (3, "x" * 50000, "zz", 5)], "k int, text string, language string, ends_at int")
    got = [(r["k"], r["ends"]) for r in sentences.sentence_ends(df).orderBy("k").collect()]
    assert got == [(1, [4, 9]), (1, [4, 9]), (2, []), (3, [50000])]
    assert sentences.sentence_ends(df.limit(0)).count() == 0


# ---------------------------------------------------------------- problem 6
def test_pack_never_overflows_and_wastes_little():
    r = random.Random(8)
    for cap in (10, 100, 1000):
        sizes = [r.randint(1, cap) for _ in range(400)]
        made = packing.pack(sizes, cap)
        assert sorted(s for c in made for s in c) == sorted(sizes) and all(sum(c) <= cap for c in made)
        assert len(made) <= 1.1 * sum(sizes) / cap + 1
    assert packing.pack([], 5) == [] and packing.pack([5, 5], 5) == [[5], [5]]


def best(sizes, cap):
    """The least number of containers, by trying all."""
    sizes = sorted(sizes, reverse=True)
    least = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= least[0]:
            return
        if i == len(sizes):
            least[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            go(i + 1, rooms[:j] + [rooms[j] - sizes[i]] + rooms[j + 1 :])
        go(i + 1, [*rooms, cap - sizes[i]])

    go(0, [])
    return least[0]


def test_dominating_sets_keep_the_optimum():
    r = random.Random(9)
    for _ in range(300):
        cap = r.randint(6, 30)
        sizes = [r.randint(1, cap) for _ in range(r.randint(1, 9))]
        fixed, kept = packing.dominating_sets(sizes, cap)
        assert sorted([s for f in fixed for s in f] + kept) == sorted(sizes) and all(sum(f) <= cap for f in fixed)
        assert len(fixed) + best(kept, cap) == best(sizes, cap)


def test_fill_containers(spark):
    r = random.Random(10)
    rows = [(i, prose(r, r.randint(1, 60)), 1) for i in range(200)] + [(500, prose(r, 900), 1), (501, None, 1), (502, "", 1), (0, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = packing.fill_containers(df, 128).toPandas()
    assert got.groupby("container").tokens.sum().max() <= 128 and not got.duplicated(["doc_id", "piece"]).any()
    n = {x["doc_id"]: x["tokens"] for x in packing.count_tokens(df.where("text IS NOT NULL")).collect()}
    assert got.groupby("doc_id").tokens.sum().to_dict() == {k: v for k, v in n.items() if v}
    cut = got[got.piece > 0].doc_id.unique().tolist()
    assert all(n[k] > 128 for k in cut) and 500 in cut
    assert got.container.nunique() <= 1.03 * got.tokens.sum() / 128 + 2
    assert packing.fill_containers(df.limit(0), 128).count() == 0


def test_containers_of_several_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 6)
    r = random.Random(14)
    df = spark.createDataFrame([(i, prose(r, r.randint(1, 40))) for i in range(400)], "doc_id long, text string")
    got = packing.fill_containers(df, 128).toPandas()
    n = {x["doc_id"]: x["tokens"] for x in packing.count_tokens(df).collect()}
    assert got.groupby("container").tokens.sum().max() <= 128 and not got.duplicated(["doc_id", "piece"]).any()
    assert got.groupby("doc_id").tokens.sum().to_dict() == n and got.container.nunique() <= 1.03 * got.tokens.sum() / 128 + 2


# ---------------------------------------------------------------- problem 7
def test_leaks(spark):
    s = ["The verified citation lubricates the laminated filter within two working days.", "A rotating blueprint escalates the index because the external blueprint postpones it.", "Before the dispatcher describes the optional battery, check 44 magnetic pallet entries."]
    zh = ["负责人每周一次更新了内部的工作台和封面。", "如果没有损坏的规程，钥匙下次审计前预约紧急的规程。"]
    items = spark.createDataFrame([(1, " ".join(s), "en", 0), (2, "".join(zh), "zh", 0), (3, None, "en", 0), (4, s[2], "en", 0), (1, " ".join(s), "en", 0)], "item_id long, passage string, language string, doc_id int")
    docs = [
        (1, "Some note. " + s[0] + " " + s[1] + " The end."),
        (2, (s[1] + "\n" + s[2]).upper().replace(",", " ;").replace("E", "Ε")),
        (3, s[0].replace("laminated", "printed") + " " + s[1].replace("rotating ", "")),
        (4, s[0] + " Something else entirely happens in between here, for a while. " + s[2]),
        (5, s[1] + " " + s[0]),
        (6, s[2]),
        (7, "".join(zh).replace("封面", "目录")),
        (8, None), (9, ""), (10, "x" * 60000), (1, "Some note. " + s[0] + " " + s[1] + " The end."),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in leaks.find_leaks(df, items).collect()} == {(1, 1), (2, 1), (3, 1), (7, 2)}
    assert leaks.find_leaks(df, items.limit(0)).count() == 0 and leaks.find_leaks(df.limit(0), items).count() == 0


def test_leaks_of_several_blocks_are_those_of_one(spark):
    """Every document is read once; a filter of all n-grams chooses those that the blocks look at."""
    r = random.Random(12)
    sentence = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(6, 14))).capitalize() + "."
    passages = [[sentence() for _ in range(4)] for _ in range(60)]
    items = spark.createDataFrame([(i, " ".join(p), "en") for i, p in enumerate(passages)], "item_id long, passage string, language string")
    docs, want = [], set()
    for d in range(150):
        body = [sentence() for _ in range(5)]
        if d % 3 == 0:
            i, k = r.randrange(60), r.randrange(3)
            two = [" ".join(w if j != 2 else "qqqqqq" for j, w in enumerate(x.split())) if r.random() < 0.5 else x for x in passages[i][k : k + 2]]
            body[2:2] = two
            want.add((d, i))
        elif d % 3 == 1:
            body[2:2] = [passages[d % 60][1]]
        docs.append((d, " ".join(body)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(x) for x in leaks.find_leaks(df, items).collect()} == want == {tuple(x) for x in leaks.find_leaks(df, items, block=13).collect()}


def test_a_long_word_may_differ_in_one_of_two_short_sentences(spark):
    s = ["Garzer 규정은 특수 표지를 상온에서 병합합니다.", "모든 공용 보고서는 내부 예산을 북쪽 출입구에서 교체합니다."]
    items = spark.createDataFrame([(1, " ".join(s), "ko")], "item_id long, passage string, language string")
    docs = [(1, f"앞 글입니다. {s[0].replace('Garzer', 'Qualunorsil')} {s[1]} 끝."), (2, f"{s[0].replace('Garzer', 'Qualun')} 다른 문장이 사이에 있습니다. 그리고 하나 더 있습니다."), (3, "짧은 글")]
    assert [tuple(r) for r in leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()] == [(1, 1)]


def test_best_match_against_a_plain_table():
    r = random.Random(11)
    for _ in range(100):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 30)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
            row = new
        assert leaks.best_match(p, t)[0] == min(row)


# ---------------------------------------------------------------- problem 8
def test_same_looking_pairs(spark):
    a, k = "Le café no. 12 filtré", "한국어 バッテリー"
    texts = {
        1: a, 2: unicodedata.normalize("NFD", a), 3: a.replace("e", "е"), 4: a.replace(" ", " "), 5: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in a), 6: a[:4] + "​" + a[4:],
        7: a.replace("é", "e"), 8: a.upper(), 9: a.replace("12", "¹²"), 10: a, 11: k, 12: unicodedata.normalize("NFD", k), 13: "한국어 ﾊﾞｯﾃﾘｰ", 14: None, 15: "", 16: " ", 17: " ", 18: "👩‍🔧", 19: "👩🔧", 20: "ofﬁce", 21: "office",
        22: "への へや へん", 23: "ベルト", 24: "ベル\u200bト", 25: "ヘ",
    }
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()] + [(1, a, 1)], "doc_id long, text string, look int")
    got = {tuple(r) for r in unify.same_looking_pairs(df).collect()}
    same = {1, 2, 3, 4, 5, 6, 10}
    want = {(x, y) for x in same for y in same if x < y and (x, y) != (1, 10)} | {(11, 12), (11, 13), (12, 13), (20, 21), (23, 24)}
    assert got == want
    assert unify.same_looking_pairs(df.limit(0)).count() == 0
    u = {r["doc_id"]: r["unified"] for r in unify.unify(df).collect()}
    assert u[14] is None and u[15] == "" and len({u[i] for i in same}) == 1


def test_copies_of_one_text_are_not_paired_with_each_other(spark):
    rows = [(i, "L", "x") for i in range(500)] + [(900, "L", "y"), (901, "M", "z"), (902, "M", "z")]
    assert [tuple(r) for r in unify.form_pairs(spark.createDataFrame(rows, "doc_id long, look string, stored string")).collect()] == [("L", "x", "y")]
    texts = spark.createDataFrame([(i, "office") for i in range(500)] + [(900, "o\ufb03ce")], "doc_id long, text string")
    assert {tuple(r) for r in unify.same_looking_pairs(texts).collect()} == {(i, 900) for i in range(500)}


def test_more_pairs_from_a_published_file(spark, tmp_path):
    f = tmp_path / "confusables.txt"
    f.write_text("\ufeff# comment\n\n05AD ;\t0596 ;\tMA\t# x\n0131 ;\t0069 ;\tMA # dotless\n2A74 ; 003A 003A 003D ; MA\n", encoding="utf-8")
    assert unify.read_confusables(str(f)) == [("\u0596", "\u05ad"), ("i", "\u0131"), ("::=", "\u2a74")]
    df = spark.createDataFrame([(1, "ship :: pin"), (2, "sh\u0131p :: pin"), (3, "a ::= b"), (4, "a \u2a74 b")], "doc_id long, text string")
    u = {r["doc_id"]: r["unified"] for r in unify.unify(df, str(f)).collect()}
    assert u[1] == u[2] and u[3] == u[4]
    assert len({r["unified"] for r in unify.unify(df).collect()}) == 4


def test_representatives_follow_frequency():
    m = unify.representatives({"e": 5, "е": 9})
    assert m["e"] == "е" and "е" not in m
    assert unify.Rewriter(m)("e") == unify.Rewriter(m)("е") == "е"
