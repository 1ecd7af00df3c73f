import hashlib
import os
import sys

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from covera.llm import mtree, reply_trees  # noqa: E402

EMB = "vec_id long, embedding array<float>, label int, v string, mark int"


def brute_top(rows, k, step):
    valid = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v):
            q = [int(np.floor(64 * np.float64(np.float32(c)))) for c in v]
            valid.setdefault(i, set()).add(tuple(q))
    flat = [(i, v) for i, vs in valid.items() for v in vs]
    out = []
    for i, vs in valid.items():
        if i % step == 0:
            q = min(vs)
            best = sorted((-sum(a * b for a, b in zip(q, w)), j) for j, w in flat if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    # Several shards and pages also on few rows.
    monkeypatch.setattr(mtree, "SHARD", 150)
    monkeypatch.setattr(mtree, "PAGE", 16)
    monkeypatch.setattr(mtree, "BLOCK", 8)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] * (1 + i % 3) + 0.1 * rng.normal(size=12)).tolist(), 0, "x", 1) for i in range(600)]
    rows += [(1000 + i, [0.5] * 12, 0, "x", 1) for i in range(60)]          # one vector many times
    rows += [(2000, None, 0, "x", 1), (2020, [1.0, None] + [0.0] * 10, 0, "x", 1), (2040, [float("nan")] * 12, 0, "x", 1),
             (2060, [float("inf")] + [0.0] * 11, 0, "x", 1), (None, [1.0] * 12, 0, "x", 1), (2080, [0.0] * 12, 0, "x", 1),
             (20, rows[20][1], 0, "x", 1)]                                    # a repeated row
    df = spark.createDataFrame(rows, EMB)
    got = sorted(tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 20 == 0, k=20).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute_top(rows, 20, 20)


def test_top_k_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0], 0, "x", 1), (1, [0.5, -1.0], 0, "x", 1), (20, [0.0, 0.25], 0, "x", 1)]
    got = sorted(tuple(r) for r in mtree.top_k(spark.createDataFrame(rows, EMB), F.col("vec_id") % 20 == 0).collect())
    assert got == brute_top(rows, 20, 20)
    assert mtree.top_k(spark.createDataFrame([], EMB), F.col("vec_id") % 20 == 0).count() == 0


def as_tree(vectors, page=32, fan=8):
    nodes = mtree.build_tree(vectors, vectors.mean(0), page, fan, 1)
    frame = pd.DataFrame([(n["node"], n["child"], n["children"], n["radius"], n["parent"], n["norm"],
                           np.asarray(n["routing"], float).tobytes(), [[int(m)] for m in n["members"]],
                           vectors[n["members"]].astype(np.int64).tobytes(), n["distances"].tobytes()) for n in nodes],
                         columns=["node", "child", "children", "radius", "parent", "norm", "routing", "ids", "vectors", "distances"])
    return mtree.read_tree(frame, vectors.shape[1]), nodes


def test_tree_has_levels_and_prunes_clustered_vectors():
    """Clustered vectors: a query scores few of them; vectors without structure: nearly all, with the same exact result."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 24)) * 60
    clustered = np.floor(centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 24)))
    loose = np.floor(64 * rng.normal(size=(3000, 24)))
    for vectors, low, high in ((clustered, 0.0, 0.1), (loose, 0.2, 1.0)):
        tree, nodes = as_tree(vectors)
        depth = {0: 0}
        for n in nodes:
            for c in range(n["child"], n["child"] + n["children"]):
                depth[c] = depth[n["node"]] + 1
        assert max(depth.values()) >= 3 and sorted(m for n in nodes for m in n["members"]) == list(range(len(vectors)))
        queries = vectors[::100]
        best, scored = mtree.search_tree(tree, queries, np.full(len(queries), -np.inf), 21)
        assert low <= scored / (len(queries) * len(vectors)) <= high
        for q, found in zip(queries, best):
            score = vectors @ q
            want = sorted(range(len(vectors)), key=lambda i: (-score[i], i))[:21]
            assert [(s, ids[0]) for s, ids in found] == [(int(score[i]), i) for i in want]


def test_scores_beyond_exact_integers_fail(spark):
    rows = [(i, [float(1 << 24)] * 4, 0, "x", 1) for i in range(3)]
    with pytest.raises(ValueError, match="too large"):
        mtree.top_k(spark.createDataFrame(rows, EMB), F.col("vec_id") % 20 == 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "x\\", None, ""]),
                          st.one_of(st.none(), st.text(alphabet="\\<>/s[]INST|im_endSYS \nab", max_size=30)),), max_size=6))
def test_template_is_reversible(turns):
    text, spans = reply_trees.format_turns(turns)
    assert list(reply_trees.read_turns(text)) == [(r or "", t or "") for r, t in turns]
    assert [reply_trees.unescape(text[s:e]) for s, e in spans] == [t or "" for r, t in turns if r == "assistant"]
    for control in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"):
        assert control not in text


CONV = "conv_id long, turn long, role string, text string, tree int, node string"


def test_conversations_digest(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] \\ <|im_end|>"), (2, 5, "user", None), (2, 3, "system", ""),
            (None, 0, "user", "nobody"), (None, None, None, "null turn"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(70)]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], CONV)
    got = {r["conv_id"]: r for r in reply_trees.digests(df).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        mine = sorted((t for t in rows if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert reply_trees.digests(spark.createDataFrame([], CONV)).count() == 0


def brute_paths(rows, top):
    out = set()
    by_tree = {}
    for t, n, p, s in rows:
        by_tree.setdefault(t, {})[n] = (p, s or 0.0)
    for t, nodes in by_tree.items():
        parents, chains = {p for p, _ in nodes.values()}, []
        for n in nodes:
            if n in parents:
                continue
            chain, at = [], n
            while at is not None and at in nodes and at not in chain:
                chain.append(at)
                at = nodes[at][0]
            if at is None or at not in nodes:
                chains.append((-sum(nodes[c][1] for c in chain), n, chain[::-1]))
        for branch, (_, leaf, chain) in enumerate(sorted(chains)[:top], 1):
            out |= {(t, leaf, branch, n, d) for d, n in enumerate(chain)}
    return out


@pytest.mark.parametrize("top", [1, 2, None])
def test_best_paths_equal_brute_force(spark, top):
    rng = np.random.default_rng(6)
    rows = []
    for t in range(5):
        for n in range(40):
            parent = None if n == 0 else int(rng.integers(0, n)) if t < 3 else n - 1
            rows.append((t, n, parent, float(rng.integers(0, 4))))
    rows += [(9, 1, 99, 1.0), (9, 2, 1, None), (9, 3, 4, 1.0), (9, 4, 3, 1.0)]  # a lost parent, and a cycle
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    got = {tuple(r) for r in reply_trees.best_paths(df, top).select("tree", "leaf", "branch", "node", "depth").collect()}
    assert got == brute_paths(rows, top)
