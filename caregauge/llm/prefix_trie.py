"""Prefix tries of conversations, from sorted sequences and range minima over their common prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caregauge.llm.common import written

#: Bytes of a turn within a key: a digest of role and text, and the words of the text.
DIGEST, WORDS = 16, 4
TURN = DIGEST + WORDS
#: Bytes of keys that one task takes, about.
SHARD_BYTES = 8 << 20
#: Ids of one piece of a list of conversations, at most.
PIECE_IDS = 1 << 16

_NODE = (
    "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "end_id string, node_id string, parent_id string"
)


def turn_lists(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turns): 40 hex digits for each turn, ordered by turn (null first).

    Ties are ordered by role, then digest. A null role or text is empty; rows without a conv_id
    belong to no conversation; extra columns are left out. Equal roles and texts have equal
    digits. Texts stay where they are, only digests move.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role), F.lit(":"), role, text)
    n_words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn"),
            role.alias("role"),
            F.concat(F.md5(told.cast("binary")), F.lpad(F.hex(n_words), 2 * WORDS, "0")).alias("coded"),
        ).alias("turn"),
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn"))["coded"].alias("turns"))


def with_shared_history(lists: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """The lists with the first h turns replaced by those of the first conversation of each
    ``group`` consecutive ids; h is the unsigned crc32 of the decimal id modulo ``most``.

    Fewer turns where that conversation has fewer, none where it is absent.
    """
    heads = lists.where(F.pmod("conv_id", F.lit(group)) == 0).select(
        F.col("conv_id").alias("head_id"), F.slice("turns", 1, most - 1).alias("head")
    )
    head_id = F.col("conv_id") - F.pmod("conv_id", F.lit(group))
    both = lists.withColumn("head_id", head_id).join(heads, "head_id", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.concat(head, own).alias("turns"))


def common_turns(a: bytes, b: bytes) -> int:
    """Leading turns that two keys have in common."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minima of 2**k consecutive values."""
    levels = [values]
    while 2 * (1 << (len(levels) - 1)) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    return levels


def range_minimum(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low..high], both ends included."""
    k = np.frexp((high - low + 1).astype(float))[1] - 1
    out = np.empty(len(low), levels[0].dtype)
    for level in np.unique(k):
        at = k == level
        out[at] = np.minimum(levels[level][low[at]], levels[level][high[at] - (1 << level) + 1])
    return out


def extents(lcp: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last sequence that share ``depth`` turns with sequence ``at``.

    ``lcp[i]`` is what sorted sequences i and i+1 have in common. Each candidate searches by
    itself, halving its step: a step is taken if the minimum over it is deep enough.
    """
    left, right = at.copy(), at.copy()
    levels = sparse_table(lcp)
    if len(lcp):
        for k in range(len(levels) - 1, -1, -1):
            step, table = 1 << k, levels[k]
            ahead = right + step <= len(lcp)
            ahead[ahead] = table[right[ahead]] >= depth[ahead]
            right[ahead] += step
            back = left - step >= 0
            back[back] = table[left[back] - step] >= depth[back]
            left[back] -= step
    return left, right


def _path_ids(key: bytes, depth: int) -> list[str]:
    """Ids of the prefixes of 0 to ``depth`` turns."""
    running, ids = hashlib.md5(), []
    for d in range(depth + 1):
        if d:
            running.update(key[(d - 1) * TURN : d * TURN])
        ids.append(running.copy().hexdigest())
    return ids


def local_trie(keys: list[bytes], counts: np.ndarray, firsts: np.ndarray, before: int, after: int) -> dict[str, np.ndarray]:
    """Nodes over sorted different keys that stand for ``counts`` conversations with least ids ``firsts``.

    ``before`` and ``after`` are the turns that the first and last key have in common with the
    keys beside this range (-1: there is none). A node on such a common path has a ``node_id`` and the
    part of its figures that this range knows; a figure of a node or child that an earlier
    range saw first is not counted again, so that the parts add up.
    """
    m = len(keys)
    lengths = np.array([len(k) // TURN for k in keys], np.int64)
    lcp = np.array([common_turns(a, b) for a, b in zip(keys, keys[1:])], np.int64)
    # candidates: every prefix of every sequence, the empty one included
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    at = np.repeat(np.arange(m), lengths + 1)
    depth = np.arange(offsets[-1]) - offsets[at]
    left, right = extents(lcp, at, depth)
    node = np.flatnonzero(left == at)  # in this order a parent comes before all that is below it
    i, d, r = at[node], depth[node], right[node]
    number = np.full(offsets[-1], -1, np.int64)
    number[node] = np.arange(len(node))
    parent = np.where(d > 0, number[offsets[left[np.maximum(node - 1, 0)]] + np.maximum(d - 1, 0)], -1)

    total = np.concatenate([[0], np.cumsum(counts)])
    n = total[r + 1] - total[i]
    least = range_minimum(sparse_table(firsts), i, r)
    here_first = (i > 0) | (d > before)
    shared = ((i == 0) & (d <= before)) | ((r == m - 1) & (d <= after))
    end = lengths[i] == d
    leaf = end & (r == i) & ~((i == m - 1) & (d <= after))
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, TURN)[:, DIGEST:].astype(np.int64)
    words_of = raw @ (256 ** np.arange(WORDS - 1, -1, -1))
    turn = np.concatenate([[0], np.cumsum(lengths)])[i] + d - 1
    words = np.where(d > 0, words_of[np.maximum(turn, 0)], 0) if len(words_of) else np.zeros(len(node), np.int64)
    own = (n - here_first) * words
    children = np.bincount(parent[d > 0], here_first[d > 0], len(node)).astype(np.int64)
    # a subtree is a run of nodes: from the node to the first one of the sequence after its last
    stop = np.searchsorted(i, r, side="right")

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[stop] - sums[np.arange(len(node))]

    ids = np.full(len(node), None, object)
    for key, which in ((keys[0], (i == 0) & (d <= before)), (keys[-1], (r == m - 1) & (d <= after))):
        if which.any():
            path = _path_ids(key, int(d[which].max()))
            ids[which] = [path[k] for k in d[which]]
    above = np.maximum(parent, 0)
    has_parent = d > 0
    return {
        "depth": d,
        "conv_id": least,
        "parent_conv_id": np.where(has_parent, least[above], -1),
        "has_parent": has_parent,
        "n_convs": n,
        "n_children": children,
        "n_leaves": below(leaf.astype(np.int64)),
        "saved_tokens": below(own),
        "end_of": np.where(end, i, -1),
        "node_id": ids,
        "parent_id": np.where(has_parent & shared[above], ids[above], None),
    }


def _trie_of(group: pd.DataFrame) -> pd.DataFrame:
    order = sorted(range(len(group)), key=group["key"].tolist().__getitem__)
    group = group.iloc[order]
    keys, ends = group["key"].tolist(), group["end_id"].to_numpy()
    found = local_trie(
        keys, group["n"].to_numpy(np.int64), group["first_id"].to_numpy(np.int64), int(group["before"].iloc[0]), int(group["after"].iloc[0])
    )
    end_of = found.pop("end_of")
    has_parent = found.pop("has_parent")
    out = pd.DataFrame(found)
    out["end_id"] = np.where(end_of >= 0, ends[end_of], None)
    out["parent_conv_id"] = out["parent_conv_id"].astype("Int64").mask(~has_parent)
    return out[["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_id", "node_id", "parent_id"]]


def _beside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in common across the borders of ranges."""
    for batch in batches:
        rows = batch.to_pylist()
        before = [-1 if r["last_before"] is None else common_turns(r["last_before"], r["first"]) for r in rows]
        after = [-1 if r["first_after"] is None else common_turns(r["last"], r["first_after"]) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [batch.column("shard"), pa.array(before, pa.int64()), pa.array(after, pa.int64())], names=["shard", "before", "after"]
        )


_PIECES = "end_id string, sha string, part long, piece long, ids string"


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of lists that lie within the task, pieces of those that are long or may go on in the
    task before or after; rows come sorted by list and id."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("end_id", pa.string()), ("sha", pa.string()), ("part", pa.int64()), ("piece", pa.int64()), ("ids", pa.string())])
    out: list[tuple] = []
    held: list[str] = []
    now, first, pieces, size = None, True, 0, 0

    def closed(last: bool) -> None:
        nonlocal pieces
        if first or last or pieces:
            if held:
                out.append((now, None, part, pieces, ",".join(held)))
        else:
            out.append((now, hashlib.sha256(",".join(held).encode()).hexdigest(), None, None, None))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for end_id, conv in zip(batch.column("end_id").to_pylist(), batch.column("conv_id").to_pylist()):
            if end_id != now:
                if now is not None:
                    closed(False)
                    first = False
                now, pieces, held = end_id, 0, []
            held.append(str(conv))
            if len(held) >= PIECE_IDS:
                out.append((now, None, part, pieces, ",".join(held)))
                size += len(held)
                pieces, held = pieces + 1, []
            if size >= PIECE_IDS or len(out) >= 10_000:
                yield batch_of(out)
                out, size = [], 0
    if now is not None:
        closed(True)
    if out:
        yield batch_of(out)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of lists whose pieces come in order."""
    now, running = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for end_id, ids in zip(batch.column("end_id").to_pylist(), batch.column("ids").to_pylist()):
            if end_id == now:
                running.update(b"," + ids.encode())
                continue
            if now is not None:
                done.append((now, running.hexdigest()))
            now, running = end_id, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names=["end_id", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], names=["end_id", "sha"])


def list_digests(members: DataFrame) -> DataFrame:
    """Rows (end_id, sha): SHA-256 of each end_id's conv_ids, ascending, joined by commas.

    Ids are dealt by range of (end_id, conv_id), so that a list with a third of all ids is
    sorted and written down by many tasks; one task then hashes its pieces in order, a piece at a time.
    """
    parts = written(members.repartitionByRange("end_id", "conv_id").sortWithinPartitions("end_id", "conv_id").mapInArrow(_pieces, _PIECES))
    across = parts.where("sha IS NULL").repartition("end_id").sortWithinPartitions("end_id", "part", "piece").select("end_id", "ids")
    return parts.where("sha IS NOT NULL").select("end_id", "sha").unionByName(across.mapInArrow(_joined, "end_id string, sha string"))


def prefix_trie(lists: DataFrame) -> DataFrame:
    """One row for each different sequence of first turns of the lists (conv_id, turns).

    Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256): least member, turns, the parent's least member (root: null), members, children,
    childless nodes of the subtree, words that the subtree's nodes save by being kept once, and a
    digest of the ids that end at the node. Every id is to occur once. No lists give no rows.

    Equal lists become one weighted key first. Different keys are sorted into ranges of about
    ``SHARD_BYTES``; within a range each prefix searches its first and last member by range minima
    over neighbours' common turns. Only nodes on a path that crosses a border, two paths a range,
    meet their other parts by id. One list's digests, 20 bytes a turn, are one row.
    """
    spark = lists.sparkSession
    keyed = written(lists.select("conv_id", F.unhex(F.array_join("turns", "")).alias("key")))
    size = keyed.agg(F.sum(F.octet_length("key"))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // SHARD_BYTES + 1)
    different = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_id"))
    shards = written(
        different.repartitionByRange(ranges, "key")
        .withColumn("shard", F.spark_partition_id())
        .withColumn("end_id", F.md5("key"))
    )
    borders = shards.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    in_order = Window.orderBy("shard")  # a row for each range
    beside = borders.withColumns(
        {"last_before": F.lag("last").over(in_order), "first_after": F.lead("first").over(in_order)}
    ).mapInArrow(_beside, "shard int, before long, after long")
    # three numbers for each range: as bounded as the tasks of a stage
    local = written(shards.join(F.broadcast(beside), "shard").groupBy("shard").applyInPandas(_trie_of, _NODE))

    crossing = local.where("node_id IS NOT NULL").groupBy("node_id", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("end_id").alias("end_id"),
        F.max("parent_id").alias("parent_id"),
    )
    crossing = written(crossing)
    nodes = local.where("node_id IS NULL").unionByName(crossing)
    parents = crossing.select(F.col("node_id").alias("parent_id"), F.col("conv_id").alias("of_parent"))
    nodes = nodes.where("parent_id IS NULL").unionByName(
        nodes.where("parent_id IS NOT NULL").join(parents, "parent_id").withColumn("parent_conv_id", F.col("of_parent")).select(nodes.columns)
    )
    digests = list_digests(keyed.select(F.md5("key").alias("end_id"), "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ended = nodes.where("end_id IS NOT NULL").join(digests, "end_id").select(*columns, F.col("sha").alias("ends_sha256"))
    return nodes.where("end_id IS NULL").select(*columns, F.lit(none).alias("ends_sha256")).unionByName(ended)
