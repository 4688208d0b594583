import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from caregauge.llm import cover_tree, simhash
from caregauge.llm.common import written
from caregauge.llm.components import components

from .conftest import messy, prose


def classes(n, links):
    """Least member of each node's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(120), r.randrange(120)) for _ in range(60)] + [(k, k + 1) for k in range(200, 260)]
    links += [(300, 300 + k) for k in range(1, 80)] + [(5, 5)]
    links = [(a - 150, b - 150) for a, b in links]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = classes(400, [(a + 150, b + 150) for a, b in links])
    assert got == {k - 150: w - 150 for k, w in enumerate(want) if w != k}


def test_no_components(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aAbÀ é\t\n\x1c\x0b\r")), max_size=30))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def close_fingerprints(seed, n):
    """Fingerprints in chains and balls, and some far from all."""
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n // 4)]
    while len(out) < n:
        x = r.choice(out[-40:])
        for _ in range(r.randint(1, 5)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return np.array(out, dtype=np.uint64).view(np.int64)


def slow_links(fps):
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= 3
    return [(int(a), int(b)) for a, b in np.argwhere(near) if a < b]


def test_linked_within_a_shard():
    fps = np.unique(close_fingerprints(1, 300))
    root = simhash.linked(fps)
    want = classes(len(fps), slow_links(fps))
    same = defaultdict(set)
    for r, w in zip(root.tolist(), want):
        same[w].add(r)
    assert all(len(s) == 1 for s in same.values()) and len({*root.tolist()}) == len(same)


def test_every_near_pair_meets_in_a_shard():
    fps = np.unique(close_fingerprints(2, 600))
    for trees in (simhash.vantage_trees(fps[::2], len(fps), 32), [simhash.VantageTree(fps[::2], len(fps), 3, shard_rows=32)]):
        homes = defaultdict(set)
        for n, tree in enumerate(trees):
            rows, shards = tree.shards_of(fps)
            assert tree.shards > 4 and set(rows.tolist()) == set(range(len(fps)))
            for r, s in zip(rows.tolist(), shards.tolist()):
                homes[r].add((n, s))
        assert all(homes[a] & homes[b] for a, b in slow_links(fps))


@pytest.mark.parametrize("shard_rows,task_rows", [(2_048, 16_384), (40, 60)])
def test_near_duplicates(spark, monkeypatch, shard_rows, task_rows):
    monkeypatch.setattr(simhash.vantage_trees, "__defaults__", (shard_rows,))
    monkeypatch.setattr(simhash, "TASK_ROWS", task_rows)
    fps = close_fingerprints(3, 500)
    fps = np.concatenate((fps, np.repeat(fps[:1], 100)))
    ids = random.Random(4).sample(range(10_000), len(fps))
    printed = written(spark.createDataFrame([(i, int(f)) for i, f in zip(ids, fps)], "doc_id long, fp long"))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(printed).collect()}
    least = {}
    for i, w in zip(ids, want := classes(len(fps), slow_links(fps))):
        least[w] = min(i, least.get(w, i))
    assert got == {i: least[w] for i, w in zip(ids, want)}


def test_simhash_of_messy_documents(documents, no_documents):
    rows = simhash.simhash(documents).collect()
    assert len(rows) == len(messy())
    want = defaultdict(list)
    for i, t in messy():
        want[i].append(f"{slow_fingerprint(t or ''):016x}")
    assert all(r["fingerprint"] in want[r["doc_id"]] for r in rows)
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert found[1] == found[2] == found[3] == 1 and found[5] == 0 and found[None] is None and found[7] == 7
    assert simhash.simhash(no_documents).count() == 0


def test_one_document_of_each_group_stays(documents, no_documents):
    kept = simhash.one_of_each(documents)
    assert kept.columns == documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({0, 1, 4, 6, 7, *range(20, 45)}) and ids.count(None) == 1
    assert simhash.one_of_each(no_documents).count() == 0


def test_unrelated_documents_with_null_or_repeated_ids_stay(spark):
    a, b, c, d, e = (prose(800 + k, 60) for k in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (9, d), (3, e), (None, e)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, a), (0, b), (7, c), (7, d), (3, e)])


def vectors(seed, n, size, labels):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(1, n // 12), size))
    out = []
    for k in range(n):
        v = centres[r.integers(len(centres))] + r.normal(size=size) * r.choice([0.02, 0.25, 0.4])
        out.append((k, [float(np.float32(x)) for x in v], int(r.integers(labels))))
    return out


def slow_cosine(rows):
    usable = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[k] = np.array(v, dtype=float) / np.sqrt(np.dot(v, v))
    links = [
        (a, b)
        for a, x in usable.items()
        for b, y in usable.items()
        if a < b and rows[a][2] == rows[b][2] and len(x) == len(y) and float(x @ y) >= cover_tree.COSINE
    ]
    counts = [0] * len(rows)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    return counts, classes(len(rows), links)


SCHEMA = "vec_id long, embedding array<float>, label int, node long, n int, cell string"


@pytest.mark.parametrize("cell_rows,task_rows", [(2_048, 4_096), (20, 16)])
def test_cosine_links(spark, monkeypatch, cell_rows, task_rows):
    monkeypatch.setattr(cover_tree.Cells.__init__, "__defaults__", (cell_rows,))
    monkeypatch.setattr(cover_tree, "TASK_ROWS", task_rows)
    rows = vectors(1, 400, 8, 3)
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 8, 1), (403, [nan] * 8, 1), (404, [1.0, None] * 4, 1), (405, [inf] * 8, 1)]
    rows += [(406, rows[0][1], None), (407, rows[0][1], rows[0][2]), (408, rows[0][1][:4], rows[0][2])]
    rows += [(500 + k, rows[5][1], rows[5][2]) for k in range(70)] + [(600, [-0.0, 1.0] * 4, 9), (601, [0.0, 1.0] * 4, 9)]
    got = cover_tree.cosine_links(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)).collect()
    counts, root = slow_cosine(rows)
    assert len(got) == len(rows)
    want = {r[0]: (c, rows[w][0]) for r, c, w in zip(rows, counts, root)}
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_labels_that_the_sample_misses(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "SAMPLE_ROWS", 3)
    monkeypatch.setattr(cover_tree, "TASK_ROWS", 10)
    rows = vectors(2, 150, 6, 4)
    given = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    counts, root = slow_cosine(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.cosine_links(given).collect()}
    assert got == {r[0]: (c, rows[w][0]) for r, c, w in zip(rows, counts, root)}


def test_null_and_repeated_ids(spark):
    v = [1.0, 2.0]
    rows = [(None, v, 1), (7, v, 1), (7, v, 1), (None, [5.0, 0.0], 2), (None, None, None)]
    got = cover_tree.cosine_links(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)).collect()
    key = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got]
    assert sorted(key, key=str) == sorted(
        [(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (None, 0, None, False), (None, 0, None, False)], key=str
    )
    assert cover_tree.cosine_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dual_traversal_of_clusters_and_copies():
    r = np.random.default_rng(5)
    points = r.normal(size=(40, 16)).repeat(12, axis=0) + r.normal(size=(480, 16)) * 0.1
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    weight = r.integers(1, 4, 480)
    near = points @ points.T >= 0.93
    np.fill_diagonal(near, False)
    links = cover_tree.Links(weight)
    left, right = cover_tree.CoverTree(points[:200]), cover_tree.CoverTree(points[200:])
    cover_tree.dual_traversal(left, left, 0, links, 0.93)
    assert (links.counts[:200] == near[:200, :200] @ weight[:200]).all()
    links = cover_tree.Links(weight)
    cover_tree.dual_traversal(left, right, 200, links, 0.93)
    assert (links.counts[:200] == near[:200, 200:] @ weight[200:]).all()
    assert (links.counts[200:] == near[200:, :200] @ weight[:200]).all()
