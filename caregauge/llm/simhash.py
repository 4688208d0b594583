"""SimHash fingerprints, and near-duplicates by a vantage-point tree over Hamming distances."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregauge.llm.common import hash_sample, slices, texts, written
from caregauge.llm.components import components

SHINGLE_WORDS = 3
MOST_BITS = 3
SEED = 42
ALL_BITS = np.int64(-1)
HALVES = (np.int64(0xFFFFFFFF), np.int64(-1 << 32))
#: Fingerprints, about, that the trees over the shards are fitted on.
SAMPLE = 65_536
#: Fingerprints that a shard should hold, and those of one task at most; a shard with more is
#: dealt over blocks, and each pair of blocks is a task. Within a task smaller trees follow.
SHARD_ROWS = 8_192
TASK_ROWS = 262_144
INNER_ROWS = 1_024


def fingerprint(text: str, words_each: int = SHINGLE_WORDS) -> int:
    """The text's 64 bits: a bit is 1 if it is 1 in over half the hashes of its shingles."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < words_each:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(words_each)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    many = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        many += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * many > len(hashes)).tobytes(), "big")


def fingerprints(text: Column, words_each: int = SHINGLE_WORDS) -> Column:
    """Fingerprints of a text column as signed longs. Letters A to Z are lowered, words are parted
    by ASCII white space; fewer words than a shingle has form one; no word (or null) gives 0."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            found = np.array([fingerprint(t or "", words_each) for t in values], dtype=np.uint64)
            yield pd.Series(found.view(np.int64))

    return of(text)


def distance(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


class VantageTree:
    """Splits Hamming space into shards, by distance to one vantage point after the other.

    Distances count the bits of ``mask`` alone. A fingerprint x goes to the outer branch if
    d(x, v) > mu, and to the inner one if d(x, v) <= mu + radius. Two fingerprints within
    ``radius`` of each other meet in a shard: if not both are outside, one has d <= mu and by
    the triangle bound the other d <= mu + radius.
    """

    def __init__(
        self, sample: np.ndarray, rows: int, radius: int, mask: np.int64 = ALL_BITS, shard_rows: int = SHARD_ROWS
    ) -> None:
        self.radius, self.mask = radius, mask
        self.nodes: list[tuple[np.int64, int, int, int]] = []  # vantage point, mu, inner, outer
        self.shards = 0
        self.random = np.random.default_rng(SEED)
        self.each = rows / max(1, len(sample))
        self.root = self._grow(sample & mask, shard_rows)

    def _grow(self, sample: np.ndarray, shard_rows: int) -> int:
        """Index of the node, or -1 - shard."""
        best = None
        if len(sample) >= 16 and len(sample) * self.each > shard_rows:
            for v in self.random.choice(sample, size=min(12, len(sample)), replace=False):
                d = np.bincount(distance(sample, v), minlength=65).cumsum() / len(sample)
                for mu in range(65 - self.radius - 1):
                    if 0.25 <= d[mu] <= 0.75 and d[mu + self.radius] < 0.95:
                        cost = d[mu + self.radius] ** 2 + (1 - d[mu]) ** 2
                        if best is None or cost < best[0]:
                            best = (cost, v, mu)
        if best is None:
            self.shards += 1
            return -self.shards
        _, v, mu = best
        d = distance(sample, v)
        at = len(self.nodes)
        self.nodes.append((v, mu, 0, 0))
        inner = self._grow(sample[d <= mu + self.radius], shard_rows)
        outer = self._grow(sample[d > mu], shard_rows)
        self.nodes[at] = (v, mu, inner, outer)
        return at

    def shards_of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``found`` and the shards they go to."""
        found = found & self.mask
        rows, shards = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        todo = [(self.root, np.arange(len(found)))]
        while todo:
            at, own = todo.pop()
            if not len(own):
                continue
            if at < 0:
                rows.append(own)
                shards.append(np.full(len(own), -1 - at, dtype=np.int32))
                continue
            v, mu, inner, outer = self.nodes[at]
            d = distance(found[own], v)
            todo += [(inner, own[d <= mu + self.radius]), (outer, own[d > mu])]
        return np.concatenate(rows), np.concatenate(shards)


def vantage_trees(sample: np.ndarray, rows: int, shard_rows: int = SHARD_ROWS) -> list[VantageTree]:
    """A tree for each half of the bits: of MOST_BITS differing bits, one half has at most half.

    So each tree needs a small radius only, and few fingerprints lie near its boundaries.
    """
    return [VantageTree(sample, rows, MOST_BITS // len(HALVES), mask, shard_rows) for mask in HALVES]


def linked(found: np.ndarray, radius: int = MOST_BITS) -> np.ndarray:
    """For each fingerprint the least one of its component under links of up to ``radius`` bits.

    Fingerprints are ordered by distance to a vantage point; by the triangle bound only those
    whose distance differs by at most ``radius`` are compared.
    """
    if not len(found):
        return found
    pivot = found[0]
    order = np.argsort(distance(found, pivot), kind="stable")
    sorted_fps = found[order]
    d = distance(sorted_fps, pivot).astype(np.int64)
    starts = np.searchsorted(d, np.arange(65 + radius) - radius, side="left")
    ends = np.searchsorted(d, np.arange(65) + radius, side="right")
    label = np.full(len(found), -1, dtype=np.int64)
    least: list[int] = []
    for first in range(len(found)):
        if label[first] >= 0:
            continue
        mark, todo, low = len(least), [first], sorted_fps[first]
        label[first] = mark
        while todo:
            x = todo.pop()
            a, b = starts[d[x]], ends[d[x]]
            near = distance(sorted_fps[a:b], sorted_fps[x]) <= radius
            new = a + np.flatnonzero(near & (label[a:b] < 0))
            label[new] = mark
            if len(new):
                low = min(low, sorted_fps[new].min())
                todo += new.tolist()
        least.append(low)
    out = np.empty_like(found)
    out[order] = np.array(least, dtype=np.int64)[label]
    return out


def link_shard(rows: pd.DataFrame) -> pd.DataFrame:
    """Links that join the components of a shard's fingerprints, through trees of its own."""
    found = np.unique(rows["fp"].to_numpy(dtype=np.int64))
    u, v = [], []
    for tree in vantage_trees(found[:: max(1, len(found) // SAMPLE)], len(found), INNER_ROWS):
        at, shards = tree.shards_of(found)
        order = np.argsort(shards, kind="stable")
        for own in np.split(at[order], np.flatnonzero(np.diff(shards[order])) + 1):
            root = linked(found[own])
            other = found[own] != root
            u.append(found[own][other])
            v.append(root[other])
    return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)}).drop_duplicates()


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) that join the fingerprints of each component, from the written table of
    different fingerprints ``fp``; at most one per fingerprint and task, never all pairs."""
    rows = distinct.count()
    chosen = hash_sample(distinct.select("fp"), SAMPLE, rows, "fp").toPandas()
    trees = vantage_trees(np.sort(chosen["fp"].to_numpy(dtype=np.int64)), rows)

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 16):
            found = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
            before = 0
            for tree in trees:
                at, shards = tree.shards_of(found)
                yield pa.RecordBatch.from_arrays([pa.array(before + shards), pa.array(found[at])], names=["shard", "fp"])
                before += tree.shards

    shards = written(distinct.select("fp").mapInArrow(dealt, "shard int, fp long"))
    # One row per shard; a tree has at most as many shards as the sample has fingerprints.
    sizes = shards.groupBy("shard").count()
    large = sizes.filter(F.col("count") > TASK_ROWS).select(
        "shard", F.ceil(F.col("count") / (TASK_ROWS // 2)).cast("int").alias("blocks")
    )
    blocks = {r["shard"]: r["blocks"] for r in large.collect()}
    of = F.lit(1)
    if blocks:
        known = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
        of = F.coalesce(known[F.col("shard")], F.lit(1))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tasks = (
        shards.withColumn("blocks", of)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    )
    return tasks.groupBy("shard", "i", "j").applyInPandas(link_shard, "u long, v long")


def near_duplicates(printed: DataFrame) -> DataFrame:
    """Adds ``component_id`` to the written rows (doc_id, fp): the least doc_id that links reach;
    and ``root``: the least fingerprint, which unlike a null or repeated doc_id names one component.

    Rows with equal fingerprints are linked, those of texts without words (fingerprint 0)
    included. Null doc_ids do not count as least, unless there is no other; repeated rows are
    rows of one component; an empty table gives an empty one.
    """
    distinct = written(printed.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_links(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    # Written, so that the joins can split a component or fingerprint with very many rows.
    least = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = rooted.join(least, "root").select("fp", "root", "component_id")
    return printed.join(classes, "fp")


def simhash(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fingerprint in 16 hex digits, component_id) of all documents. A null text has
    no words; extra columns are left out."""
    printed = written(texts(docs).select("doc_id", fingerprints(F.col("text")).alias("fp")))
    return near_duplicates(printed).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the least doc_id of each component, with all its columns. Rows that repeat it
    go; of different texts with that doc_id and fingerprint the one of the least hash stays.
    Components are told apart by their fingerprints, so that null or repeated doc_ids merge none
    of them.

    Rows are numbered as they are written, and the ones to go are found by narrow rows. These
    numbers alone meet the texts: sent to all tasks where Spark finds them few enough.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # whatever the columns are called
    table = docs.toDF(*plain)
    key, text = plain[names.index("doc_id")], plain[names.index("text")]
    id_type = docs.schema["doc_id"].dataType
    printed = written(
        table.withColumns(
            {
                "fp": fingerprints(F.col(text)),
                "none": F.col(key).isNull(),
                "id": F.coalesce(F.col(key), F.lit("0").cast(id_type)),
                "text_hash": F.xxhash64(text),
                "row": F.monotonically_increasing_id(),
            }
        )
    )
    narrow = printed.select(F.col(key).alias("doc_id"), "fp", "none", "id", "text_hash", "row")
    classes = written(near_duplicates(narrow).select("root", "none", "id", "fp", "text_hash", "row"))
    # Written, so that the join can split a component with very many rows.
    kept = written(classes.groupBy("root").agg(F.min(F.struct("none", "id", "fp", "text_hash", "row")).alias("least")))
    gone = written(classes.join(kept, "root").where(F.col("row") != F.col("least.row")).select("row"))
    rows = printed.join(gone, "row", "left_anti")
    return rows.select(*[F.col(p).alias(n) for p, n in zip(plain, names)])
