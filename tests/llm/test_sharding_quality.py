import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from caregauge.llm import quality, sharding

from .conftest import messy, prose


def check_shards(rows, shards):
    load, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert all(0 <= s < shards for s in load)
    return load


def test_shards_of_messy_documents(documents, no_documents):
    rows = sharding.shard(documents).collect()
    sizes = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in messy())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sizes
    check_shards(rows, 8)
    assert sharding.shard(no_documents).count() == 0


@pytest.mark.parametrize("jobs,task_groups", [(64, 100), (8_192, 100), (40, 20)])
def test_shards_are_near_equal_beside_a_hot_group(spark, monkeypatch, jobs, task_groups):
    """With 40 jobs and 20 groups a task there are more tasks than jobs, which are joined twice."""
    monkeypatch.setattr(sharding, "JOBS", jobs)
    monkeypatch.setattr(sharding, "TASK_GROUPS", task_groups)
    rows = [(k, "hot text " * 6) for k in range(600)] + [(1_000 + k, prose(k, 1 + k % 40)) for k in range(900)]
    load = check_shards(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect(), 8)
    total = sum(load.values())
    hot = 600 * (len("hot text ") * 6 + 1)
    rest = sorted(load.values())[:-1] if hot > total / 8 else sorted(load.values())
    assert rest[-1] - rest[0] <= max(2 * total / jobs, 400)


def longest_first(sizes, shards):
    """The loads of plain longest-processing-time scheduling, by looking at all shards each time."""
    loads = [0] * shards
    for size in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += size
    return sorted(loads)


def test_loads_are_those_of_plain_scheduling(spark):
    texts = [prose(k % 700, 1 + k % 90) for k in range(1_000)] + ["again"] * 300 + [None, ""]
    rows = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    load = check_shards(rows, 8)
    groups = Counter()
    for t in texts:
        groups[t or ""] += len((t or "").encode()) + 1
    assert sorted(load.values()) == longest_first(groups.values(), 8)


def test_rows_that_repeat_are_numbered_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_BITS", 7)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    rows = [(None, "the same text")] * 10_000 + [(k, prose(k, 5)) for k in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        placed = sharding.shard(docs).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    check_shards(placed, 8)
    assert len(placed) == 30_000
    same = Counter(r["task"] for r in placed if r["doc_id"] is None)
    assert len(same) > 8 and max(same.values()) < 10_000 / 4


def test_schedule_is_longest_first_to_the_least_loaded():
    assert sharding.schedule(np.array([3, 9, 5, 5, 4]), 2).tolist() == [1, 0, 1, 1, 0]
    assert sharding.before_in(np.array([1, 0, 1, 1, 0]), np.array([2, 3, 4, 5, 6])).tolist() == [0, 0, 2, 6, 3]


def slow_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    many = Counter(windows)
    repeated = {p for k, w in enumerate(windows) if many[w] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
        len(lines),
    )


def test_statistics():
    odd = ["a b c d e " * 3 + "x\n\n \nx\nx", "a " * 9, "é # |<>\x1c\n\x0b", "1 2 3 4 5 6 2 3 4 5 6 7\n" * 2, " b\nb\n b"]
    for text in odd + [t or "" for _, t in messy()]:
        assert quality.statistics(text)[:6] == slow_statistics(text)


def labelled(spark):
    good = [(k, prose(k, 20 + k % 60), 1) for k in range(400)]
    bad = [(1_000 + k, prose(k, 20 + k % 60).replace(" ", "### $$$ "), 0) for k in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in good + bad], "doc_id long, text string, score string, good double")
    names = [(i, q, 0) for i, _, q in good + bad if i % 2] + [(None, 1, 0), (1, None, 0), (3, 1, 0), (99_999, 0, 0)]
    return docs, spark.createDataFrame(names, "doc_id long, quality int, toxic int")


def test_forest_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = quality.judge(docs, quality.fit(docs, labels)).collect()
    unseen = [r for r in rows if r["doc_id"] % 2 == 0 and not r["base_failed"]]
    good = [r["kept"] for r in unseen if r["doc_id"] < 1_000]
    bad = [r["kept"] for r in unseen if r["doc_id"] >= 1_000]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.1
    forest = quality.fit(docs, labels)
    kept = {r["doc_id"] for r in docs.filter(quality.passes(docs["text"], forest)).collect()}
    assert kept == {r["doc_id"] for r in rows if r["kept"]}


def test_a_label_with_many_texts_counts_once(spark):
    docs, labels = labelled(spark)
    plain = quality.fit(docs, labels)
    more = docs.unionByName(docs.where("doc_id = 1").withColumn("text", F.expr("explode(transform(sequence(1, 3000), k -> concat(text, ' w', k)))")))
    first, again = (quality.fit(d.repartition(n), labels) for n, d in ((2, more), (5, more)))
    assert len(plain.scale[0]) == len(first.scale[0]) and first.threshold == again.threshold
    assert (first.scale == again.scale).all() and (first.split == again.split).all()


def test_without_labels_the_base_rules_decide(spark, documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_kind = spark.createDataFrame([(k, 1, 0) for k in range(20, 45)], "doc_id long, quality int, toxic int")
    for labels in (none, one_kind):
        rows = quality.judge(documents, quality.fit(documents, labels)).collect()
        assert len(rows) == len(messy())
        assert all(r["kept"] != r["base_failed"] for r in rows)
    assert {r["base_failed"] for r in rows if r["doc_id"] in (1, 2, 3)} == {True}
    assert quality.judge(no_documents, quality.fit(no_documents, one_kind)).count() == 0
