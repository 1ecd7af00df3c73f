"""LSH forest, fill-in-middle and importance resampling against plain Python."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from llm_fixture import SCHEMA, documents, empty  # noqa: E402

from covera.llm import fill_middle, importance, lsh_forest  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(spark, texts):
    return documents(spark, [(i, t, "en", "s") for i, t in texts])


# --- MinHash near-dedup ------------------------------------------------------

def plain_set(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < width:
        return frozenset([" ".join(w)] if w else [])
    return frozenset(" ".join(w[i:i + width]) for i in range(len(w) - width + 1))


def plain_classes(texts, percent=85):
    """(id, set size, class) of every row; a class is named by its least id, null last."""
    sets = [plain_set(t) for _, t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and both:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    members = {}
    for i in range(len(texts)):
        members.setdefault(find(i), []).append(texts[i][0])
    least = {r: min((m for m in ids if m is not None), default=None) for r, ids in members.items()}
    return sorted(((texts[i][0], len(sets[i]), least[find(i)]) for i in range(len(texts))), key=repr)


def copies(seed=3):
    """Chains of near copies, groups that are alike but not near enough, exact copies and odd rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [(900, None), (901, ""), (902, " \t "), (903, "One"), (904, "one"), (905, "one TWO"), (905, "one two"),
             (None, "one two"), (None, "all on its own here"), (906, "Äöü ñandú   ü"), (907, "ÄÖÜ ñandú   ü")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(6, 140))]
        for c in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append((g * 50 + c, " ".join(w)))
            if rng.random() < 0.3:
                # The next copy is one of this copy: chains.
                base = w
    texts += texts[20:30]
    return texts


@pytest.mark.parametrize("block", [1024, 8])
def test_classes_equal_brute_force(spark, block):
    texts = copies()
    got = lsh_forest.near_duplicates(rows_of(spark, texts), block=block).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == plain_classes(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_dense_region_that_is_not_one_class(spark):
    """A hundred texts share most of their words, so most of their prefixes; only some pairs are near enough."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(100):
        w = list(base)
        for k in range(rng.choice((2, 6, 7))):
            w[rng.randrange(len(w))] = f"x{i}-{k}"
        texts.append((i, " ".join(w)))
    got = lsh_forest.near_duplicates(rows_of(spark, texts), block=8).collect()
    expected = plain_classes(texts)
    assert len({c for _, _, c in expected}) > 3
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == expected


def test_rest_of_large_groups_meets_every_open_pair(spark):
    """After the blocks every pair of a group is in one component, or meets in a block against a block."""
    rows = spark.createDataFrame([(g, p, g * 1000 + p) for g, n in ((1, 50), (2, 5), (3, 1), (4, 33)) for p in range(n)],
                                 "grp long, place long, id long")
    dealt = lsh_forest.blocks(rows, 8)
    linked = {1: 40, 4: 33}
    stars = spark.createDataFrame([(g * 1000 + p, g * 1000) for g, n in linked.items() for p in range(1, n)],
                                  "node long, root long")
    met = set()
    for r in dealt.groupBy("grp", "part").agg({"id": "collect_list"}).collect():
        assert len(r[2]) <= 9
        met |= set(combinations(sorted(r[2]), 2))
    assert {(2000 + a, 2000 + b) for a, b in combinations(range(5), 2)} <= met
    sides = {}
    for r in lsh_forest.rest(dealt.where("parts > 1"), stars, 8).collect():
        sides.setdefault((r["grp"], r["part"]), ([], []))[r["side"]].append(r["id"])
    assert all(len(a) <= 33 and len(b) <= 33 for a, b in sides.values()) and {g for g, _ in sides} == {1}
    for a, b in sides.values():
        met |= {tuple(sorted((x, y))) for x in a for y in b if x != y}
    root = lambda i: i if i % 1000 >= linked.get(i // 1000, 0) else i // 1000
    for a, b in combinations(range(1000, 1050), 2):
        assert (a, b) in met or root(a) == root(b)


def test_near_dedup_empty_and_order(spark):
    assert lsh_forest.near_duplicates(empty(spark)).count() == 0
    only_empty = lsh_forest.near_duplicates(rows_of(spark, [(1, None), (1, ""), (2, " ")])).collect()
    assert [(r["n_shingles"], r["kept"]) for r in only_empty] == [(0, True)] * 3
    texts = copies(8)
    one = lsh_forest.near_duplicates(rows_of(spark, texts)).collect()
    two = lsh_forest.near_duplicates(rows_of(spark, texts[::-1]).repartition(7)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, two))


def test_signature_estimates_the_similarity():
    rng = np.random.default_rng(1)
    common, apart = rng.integers(0, 1 << 63, 900, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, apart[:100]])), np.unique(np.concatenate([common, apart[100:]]))]
    least = lsh_forest.minima(sets)
    assert abs((least[0] == least[1]).mean() - 900 / 1100) < 4 * math.sqrt(0.82 * 0.18 / lsh_forest.HASHES)


# --- fill-in-middle ----------------------------------------------------------

def plain_fill(doc_id, text, seed=1):
    t = text or ""
    n, h = len(t), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(2)
    alphabet = ["a", "<", "P", "S", "M", ">", "é", "中", "\U0001f600", " ", "\n", "\x00", "é"]
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    return texts + [(None, "no id é"), (None, None), (1, "x<P>y"), (1, "x<P>y"), (5000, "é" * 70_000), (5001, "a" * 70_000)]


def test_pieces_cover_the_column(monkeypatch):
    monkeypatch.setattr(fill_middle, "PIECE", 50)
    texts = ["é" * 40, "", "a", "", "b" * 49, "中", "x" * 500, ""]
    column = pa.array(["skipped", *texts]).slice(1)
    back = []
    for first, offsets, data in fill_middle._pieces(column):
        assert first == len(back)
        back += [data[a:b].tobytes().decode() for a, b in zip(offsets, offsets[1:])]
    assert back == texts
    assert [len(list(fill_middle._pieces(pa.array(["", ""])))), len(list(fill_middle._pieces(pa.array([], pa.string()))))] == [1, 0]


def test_fill_middle_equals_brute_force(spark):
    given = rows_of(spark, odd_texts()).repartition(3)
    out = fill_middle.fill_middle(given)
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, *plain_fill(i, t)) for i, t in odd_texts()), key=repr)
    digests = fill_middle.digests(given).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for i, t in odd_texts():
        n, form, p, m, o = plain_fill(i, t)
        expected.append((i, n, form, p, m, sha(o), sha(t or "")))
    assert sorted((tuple(r) for r in digests), key=repr) == sorted(expected, key=repr)
    assert {r["form"] for r in digests} == {"plain", "psm", "spm"}


def test_exception_index_both_ways():
    text = "aé中\U0001f600b" * 50 + "plain ascii tail"
    data = np.frombuffer(text.encode(), np.uint8)
    index = fill_middle.ExceptionIndex(data)
    points = np.arange(len(text) + 1)
    cuts = np.array([len(text[:i].encode()) for i in points])
    assert (index.to_bytes(points) == cuts).all() and (index.to_points(cuts) == points).all()
    assert len(index.byte_starts) == 150


def test_fill_middle_fixture_and_empty(spark):
    got = fill_middle.digests(documents(spark)).collect()
    texts = [r["text"] or "" for r in documents(spark).collect()]
    assert sorted(r["restored_sha256"] for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert fill_middle.digests(empty(spark)).count() == 0
    whole = fill_middle.fill_middle(documents(spark), rate=0).collect()
    assert {r["form"] for r in whole} == {"plain"}


# --- importance resampling -----------------------------------------------------

def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, percent, least, seed=42):
    rows = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for r in rows for b in r[2]), Counter(b for x in target for b in plain_features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000))))
    out = []
    for i, n, f in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=repr)


def prose(n, seed):
    rng = random.Random(seed)
    pool = ["The", "cat", "naïve", "x86", "don't", "a-b", "中文", "ZÜRICH", "word" * 9, "\x7f", "...", "end.\n"]
    return [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("piece", [2 << 20, 50, 7])
def test_scan_in_pieces_of_any_size(piece, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", piece)
    texts = [None, b"", *[t.encode() for _, t in prose(30, 6)], b"w" * 200 + b" tail" * 20]
    found, words = [[] for _ in texts], [0] * len(texts)
    for crc, of, n in importance._scan(texts):
        for k, i in enumerate(of.tolist()):
            if n:
                found[i].append(int(crc[k]) % 10_000)
            else:
                words[i] += 1
    expected = [plain_features((t or b"").decode()) for t in texts]
    assert [(n, sorted(f)) for n, f in zip(words, found)] == [(n, sorted(f)) for n, f in expected]


def test_resampling_equals_brute_force(spark):
    docs = prose(150, 1) + [(None, "no id " * 20), (None, None), (7, "twice " * 30), (7, "twice " * 30), (200, "")]
    docs += [(201, "w" * 300_000 + " " + "tail words " * 2000)]
    target = [t for _, t in prose(10, 2)] + [None, ""]
    bench = spark.createDataFrame([(t, 1, "x") for t in target], "text string, weight int, n string")
    got = importance.resample(rows_of(spark, docs).repartition(4), bench, percent=20, least=20).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_resample(docs, target, 20, 20)
    assert sum(r["rank"] is not None for r in got) > 10


def test_crc_of_any_run_from_two_prefixes():
    rng = random.Random(4)
    a = bytes(rng.randrange(256) for _ in range(5000))
    cuts = np.array([(x, y) for x, y in (sorted(rng.sample(range(5001), 2)) for _ in range(200))])
    prefix = lambda i: zlib.crc32(a[:i])
    begin = np.array([prefix(x) for x in cuts[:, 0]], np.uint32)
    end = np.array([prefix(y) for y in cuts[:, 1]], np.uint32)
    found = end ^ importance.shift(begin, cuts[:, 1] - cuts[:, 0])
    assert found.tolist() == [zlib.crc32(a[x:y]) for x, y in cuts]


def test_resampling_without_target_or_documents(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty(spark), none).count() == 0
    got = importance.resample(documents(spark), none, least=1).collect()
    assert len(got) == documents(spark).count() and {r["weight"] <= 0 for r in got if r["n_features"]} == {True}
    assert all(r["weight"] == 0 and r["rank"] is None for r in got if not r["n_features"])
    assert "_h" in SCHEMA
