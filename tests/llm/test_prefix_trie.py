import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from caregauge.llm import prefix_trie, queries


def brute(rows):
    """Nodes by a plain dictionary of prefixes."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    lists = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        lists[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, turns in lists.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}

    def below(p):
        yield p
        for q in children[p]:
            yield from below(q)

    out = []
    for p, convs in members.items():
        inside = list(below(p))
        ends = ",".join(str(c) for c in sorted(convs) if lists[c] == p)
        out.append(
            (
                min(convs),
                len(p),
                min(members[p[:-1]]) if p else None,
                len(convs),
                len(children[p]),
                sum(not children[q] for q in inside),
                sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in inside if q),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def messy(seed, convs):
    """Conversations with nulls, empty texts, copies, prefixes of each other and repeated rows."""
    r = random.Random(seed)
    rows = []
    for c in range(0, convs):
        if c % 11 == 5:
            continue
        base = r.choice([0, 0, 0, 1, 2])
        for t in range(r.choice([1, 2, 3, 3, 5, 9])):
            text = f"said {base} {t}" if r.random() < 0.8 else r.choice([None, "", "a  b\tc", f"x{c}"])
            rows.append((c, None if t == 0 and c % 7 == 0 else t, r.choice(["user", "user", "user", None]), text))
    rows += [(3, 1, "user", "again")] * 2 + [(None, 0, "user", "lost")]
    rows += [(777, k, "user", f"turn {k}") for k in range(120)]  # a long one
    return rows


def frame(spark, rows):
    given = [(*r, 1, "x", "y") for r in rows]
    return spark.createDataFrame(given, "conv_id long, turn long, role string, text string, n long, key string, shard string")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("piece", [1 << 16, 2])
def test_query_against_plain_prefixes(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", piece)
    rows = messy(1, 90)
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found = queries.op12_prefix_trie(spark, str(tmp_path))
            assert found.columns == COLUMNS
            assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_copies_of_one_conversation(spark, tmp_path):
    rows = [(20 * k, t, "user", f"t {t}") for k in range(3000) for t in range(3)]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    found = [tuple(r) for r in queries.op12_prefix_trie(spark, str(tmp_path)).collect()]
    everyone = hashlib.sha256(",".join(str(20 * k) for k in range(3000)).encode()).hexdigest()
    assert sorted(r[:7] for r in found) == [
        (0, 0, None, 3000, 1, 1, 2999 * 6), (0, 1, 0, 3000, 1, 1, 2999 * 6), (0, 2, 0, 3000, 1, 1, 2999 * 4), (0, 3, 0, 3000, 0, 1, 2999 * 2)
    ]
    assert {r[7] for r in found if r[1] == 3} == {everyone}


def test_no_conversations(spark, tmp_path):
    frame(spark, messy(2, 4)).limit(0).write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op12_prefix_trie(spark, str(tmp_path)).count() == 0


def test_ranges_add_up():
    """However the sorted keys are cut into ranges, parts of crossing nodes make the same whole."""
    r = random.Random(3)

    def turn(k):
        return hashlib.md5(str(k).encode()).digest() + int(k + 1).to_bytes(4, "big")

    keys = sorted({b"".join(turn(r.randint(0, 1 + d // 2)) for d in range(r.randint(0, 6))) for _ in range(60)})
    counts, firsts = np.array([r.randint(1, 4) for _ in keys]), np.array(r.sample(range(1000), len(keys)))
    whole = prefix_trie.local_trie(keys, counts, firsts, -1, -1)
    names = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    expected = sorted(zip(whole["depth"].tolist(), whole["conv_id"].tolist(), *(whole[n].tolist() for n in names)))
    for cuts in ([0, 60], [0, 1, 2, 30], [0, 10, 20, 21, 22, 40], list(range(60))):
        cuts = sorted({c for c in cuts if c < len(keys)}) + [len(keys)]
        nodes = {}
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            before = prefix_trie.common_turns(keys[a - 1], keys[a]) if a else -1
            after = prefix_trie.common_turns(keys[b - 1], keys[b]) if b < len(keys) else -1
            part = prefix_trie.local_trie(keys[a:b], counts[a:b], firsts[a:b], before, after)
            for k in range(len(part["depth"])):
                node = part["node_id"][k] or (n, k)
                d, least, *sums = nodes.get(node, (0, 1 << 60, 0, 0, 0, 0))
                nodes[node] = (int(part["depth"][k]), min(least, int(part["conv_id"][k])), *(s + int(part[c][k]) for s, c in zip(sums, names)))
        assert sorted(nodes.values()) == expected


def test_extents_search_either_side_alone():
    lcp = np.array([2, 3, 1, 1, 4])
    at, depth = np.array([2, 2, 2, 0, 5, 4]), np.array([1, 2, 4, 0, 1, 4])
    left, right = prefix_trie.extents(lcp, at, depth)
    assert left.tolist() == [0, 0, 2, 0, 0, 4] and right.tolist() == [5, 2, 2, 5, 5, 5]
