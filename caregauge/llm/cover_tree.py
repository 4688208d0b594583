"""Exact cosine links between vectors by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caregauge.llm.common import hash_sample, slices, written
from caregauge.llm.components import components

COSINE = 0.93
#: Vectors, about, that the cells (the tree's upper levels) are fitted on, and their numbers.
SAMPLE_ROWS = 16_384
SAMPLE_NUMBERS = 8 << 20
#: Vectors that a cell should hold, and those of one side of a task at most; a cell with more is
#: dealt over blocks.
CELL_ROWS = 2_048
TASK_ROWS = 4_096
LEAF_ROWS = 24
#: Nodes of one side whose children meet all of the other's at once.
BLOCK_NODES = 512
SLACK = 1e-9


def reach(cosine: float) -> float:
    """Distance between unit vectors of this cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


class CoverTree:
    """Nested levels of centres: those of a node lie over half its radius apart, and every member
    within that half of a centre. Each node keeps its own covering radius, the largest distance
    of a member from its centre."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.members: list[np.ndarray] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        todo = [self._node(np.arange(len(points)))] if len(points) else []
        while todo:
            at = todo.pop()
            own = self.members[at]
            if len(own) <= LEAF_ROWS or self.radius[at] <= 1e-7:
                continue
            self.children[at] = [self._node(m) for m in self._net(own, self.radius[at] / 2)]
            todo += self.children[at]

    def _node(self, members: np.ndarray) -> int:
        """A node whose centre is its first member."""
        d = apart(self.points[members], self.points[members[:1]])[:, 0]
        self.members.append(members)
        self.radius.append(float(d.max()) + SLACK)
        self.children.append([])
        return len(self.members) - 1

    def _net(self, own: np.ndarray, radius: float) -> list[np.ndarray]:
        nodes = []
        while len(own):
            near = apart(self.points[own], self.points[own[:1]])[:, 0] <= radius
            near[0] = True
            nodes.append(own[near])
            own = own[~near]
        return nodes

    def centres(self, nodes: list[int]) -> np.ndarray:
        return self.points[[self.members[n][0] for n in nodes]]


class Links:
    """Weighted link counts and components of the points of one task."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight = weight
        self.counts = np.zeros(len(weight), dtype=np.int64)
        self.root = np.arange(len(weight))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Puts each pair into one component."""
        while True:
            a, b = self.root[i], self.root[j]
            if (a == b).all():
                return
            low = np.minimum(a, b)
            np.minimum.at(self.root, a, low)
            np.minimum.at(self.root, b, low)
            while (self.root != (up := self.root[self.root])).any():
                self.root = up

    def between(self, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> None:
        """Links of rows a to rows b where the matrix says so."""
        self.counts[a] += near @ self.weight[b]
        self.counts[b] += self.weight[a] @ near
        i, j = np.nonzero(near)
        if len(i):
            self.join(a[i], b[j])

    def within(self, a: np.ndarray, near: np.ndarray) -> None:
        """Links among rows a; the matrix is symmetric, without its diagonal."""
        self.counts[a] += near @ self.weight[a]
        i, j = np.nonzero(np.triu(near))
        if len(i):
            self.join(a[i], a[j])


def dual_traversal(left: CoverTree, right: CoverTree, shift: int, links: Links, cosine: float) -> None:
    """Adds the links between the trees' points (of one tree, if both are the same). The points of
    ``right`` have numbers from ``shift`` on in ``links``.

    A pair of nodes is left if its centres are further apart than both radii and the reach; a
    pair within reach as a whole is linked without comparing its points.
    """
    same = left is right
    todo = [(0, 0)] if left.members and right.members else []
    while todo:
        a, b = todo.pop()
        twin = same and a == b
        own, other = left.members[a], right.members[b]
        if not left.children[a] and not right.children[b]:
            near = left.points[own] @ right.points[other].T >= cosine
            if twin:
                np.fill_diagonal(near, False)
                links.within(own, near)
            else:
                links.between(own, other + shift, near)
            continue
        ca, cb = left.children[a] or [a], right.children[b] or [b]
        for at in range(0, len(ca), BLOCK_NODES):  # a block of rows at a time bounds the matrices
            todo += expand(left, right, ca[at : at + BLOCK_NODES], cb[at:] if twin else cb, same, twin, shift, links, cosine)


def expand(
    left: CoverTree,
    right: CoverTree,
    ca: list[int],
    cb: list[int],
    same: bool,
    twin: bool,
    shift: int,
    links: Links,
    cosine: float,
) -> list[tuple[int, int]]:
    """Pairs of nodes that are neither too far apart nor settled; ``twin``: of siblings, so that
    pairs below the diagonal are those above."""
    far = reach(cosine)
    d = apart(left.centres(ca), right.centres(cb))
    ra, rb = np.array([left.radius[n] for n in ca]), np.array([right.radius[n] for n in cb])
    close = d <= ra[:, None] + rb[None, :] + far + SLACK
    if twin:
        close = np.triu(close)
    alone_left = np.array([len(left.members[n]) == 1 for n in ca])
    alone_right = np.array([len(right.members[n]) == 1 for n in cb])
    whole = close & (d + ra[:, None] + rb[None, :] + SLACK < far) & ~(alone_left[:, None] & alone_right[None, :])
    if twin:
        np.fill_diagonal(whole, False)
    for x, y in np.argwhere(whole):
        mine, theirs = left.members[ca[x]], right.members[cb[y]] + shift
        links.counts[mine] += links.weight[theirs].sum()
        links.counts[theirs] += links.weight[mine].sum()
        links.join(np.concatenate((mine, theirs)), np.full(len(mine) + len(theirs), mine[0]))
    pairs = np.argwhere(close & ~whole)
    single = alone_left[pairs[:, 0]] & alone_right[pairs[:, 1]]
    if single.any():  # nodes of one point: the points' own cosines decide
        x, y = pairs[single].T
        i = np.array([left.members[n][0] for n in ca])[x]
        j = np.array([right.members[n][0] for n in cb])[y]
        near = (i != j) if same else np.ones(len(i), dtype=bool)
        for at in range(0, len(i), 1 << 15):
            part = slice(at, at + (1 << 15))
            near[part] &= np.einsum("ij,ij->i", left.points[i[part]], right.points[j[part]]) >= cosine
        i, j = i[near], j[near] + shift
        np.add.at(links.counts, i, links.weight[j])
        np.add.at(links.counts, j, links.weight[i])
        links.join(i, j)
        pairs = pairs[~single]
    return [(ca[x], cb[y]) for x, y in pairs.tolist()]


def unit(vectors: list) -> np.ndarray:
    points = np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    return points / np.sqrt(np.einsum("ij,ij->i", points, points))[:, None]


def task_linker(cosine: float):
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "node"])
        side = rows["side"].to_numpy()
        points = unit(rows["embedding"].tolist())
        links = Links(rows["n"].to_numpy(dtype=np.int64))
        cut = int((side == 0).sum())
        left = CoverTree(points[:cut])
        if rows["single"].iloc[0]:
            dual_traversal(left, left, 0, links, cosine)
        else:
            dual_traversal(left, CoverTree(points[cut:]), cut, links, cosine)
        node = rows["node"].to_numpy(dtype=np.int64)
        out = pd.DataFrame({"node": node, "links": links.counts, "root": node[links.root]})
        return out[out["links"] > 0]

    return link


def valid(embedding: Column) -> Column:
    """Neither null nor zero nor with a null or non-finite component."""
    number = embedding.cast("array<double>")
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(number, lambda x: x != 0), F.lit(False))


class Cells:
    """Centres of the upper level for each (label, length), from a bounded sample."""

    def __init__(self, sample: pd.DataFrame, cell_rows: int = CELL_ROWS) -> None:
        self.centres: dict[tuple[int, int], tuple[int, np.ndarray]] = {}  # first cell's number, centres
        self.first: list[tuple[int, int]] = []
        for key, group in sample.groupby(["label", "length"], sort=True):
            points = unit(group["embedding"].tolist())
            need = max(1, -(-int(group["of_label"].iloc[0]) // cell_rows))
            chosen = self._spread(points, min(need, len(points)))
            self.centres[key] = (len(self.first), points[chosen])
            self.first += [key] * len(chosen)

    @staticmethod
    def _spread(points: np.ndarray, need: int) -> list[int]:
        """Levels of halving radii until a level has enough centres; the first ones of it."""
        radius, chosen = 2.0, [0]
        while len(chosen) < need and radius > 1e-3:
            radius /= 2
            nearest = apart(points, points[chosen]).min(axis=1)
            while len(chosen) < need and (far := np.flatnonzero(nearest > radius)).size:
                chosen.append(int(far[0]))
                nearest = np.minimum(nearest, apart(points, points[far[:1]])[:, 0])
        return chosen


def cosine_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of all vectors; links join different rows with
    equal labels and a cosine of at least ``cosine``.

    Null, zero and non-finite vectors, and those with a null label, have no links; neither have
    vectors of different lengths. Equal vectors are one point with a weight, so that copies cost
    nothing and are not paired. Repeated rows count as vectors of their own. A null vec_id is
    never the least unless there is no other, and is not kept. Extra columns are left out.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    fits = valid(F.col("embedding")) & F.col("label").isNotNull()
    points = written(
        rows.filter(fits)
        .groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
        .withColumn("length", F.size("embedding"))
    ).withColumn("node", F.monotonically_increasing_id())
    sizes = points.groupBy("label", "length").agg(F.count("*").alias("of_label"))
    points = written(points.join(sizes, ["label", "length"]))
    # Labels and lengths of the sample bound what comes to the driver.
    total, longest = points.agg(F.count("*"), F.coalesce(F.max("length"), F.lit(1))).first()
    most = int(min(SAMPLE_ROWS, max(256, SAMPLE_NUMBERS // longest)))
    sample = hash_sample(points.select("label", "length", "embedding", "of_label", "node"), most, total, "node")
    cells = Cells(sample.toPandas().sort_values("node"))

    def assigned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2_048):
            found = batch.to_pandas()
            cell = np.full(len(found), -1, dtype=np.int64)
            away = np.zeros(len(found))
            for key, own in found.groupby(["label", "length"]).indices.items():
                if key in cells.centres:
                    base, centres = cells.centres[key]
                    d = apart(unit(found["embedding"].iloc[own].tolist()), centres)
                    cell[own] = base + d.argmin(axis=1)
                    away[own] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"]
            )

    names = ["label", "length", "of_label", "embedding", "n", "node"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(names).schema.fields)
    placed = written(points.select(names).mapInArrow(assigned, f"{kinds}, cell long, away double"))
    # One row per cell; there are at most as many cells as rows in the sample.
    stats = placed.filter("cell >= 0").groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("rows"))
    found = {r["cell"]: (r["radius"] + SLACK, r["rows"]) for r in stats.collect()}
    far = reach(cosine)
    blocks = {c: -(-n // TASK_ROWS) for c, (_, n) in found.items()}
    radius = np.array([found.get(c, (0.0, 0))[0] for c in range(len(cells.first))])
    deal = np.array([blocks.get(c, 0) for c in range(len(cells.first))], dtype=np.int64)

    def paired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once for each task: its own cell's blocks, and those of the cells that it
        may reach."""
        for batch in slices(batches, 2_048):
            got = batch.to_pandas()
            out: list[tuple[np.ndarray, ...]] = []

            def emit(own: np.ndarray, a, b, i, j, side) -> None:
                out.append(tuple(np.broadcast_to(np.asarray(x, dtype=np.int64), len(own)) for x in (own, a, b, i, j, side)))

            cell, node = got["cell"].to_numpy(), got["node"].to_numpy()
            alone = np.flatnonzero(cell < 0)
            if len(alone):
                # A label that the sample missed: one cell, in as many blocks as its rows need.
                label = got["label"].to_numpy()[alone].astype(np.int64)
                length = got["length"].to_numpy()[alone]
                many = -(-got["of_label"].to_numpy()[alone] // TASK_ROWS)
                block = node[alone] % many
                for k in range(int(many.max())):
                    own = many > k
                    low, high = np.minimum(block, k)[own], np.maximum(block, k)[own]
                    emit(alone[own], label[own], -1 - length[own], low, high, (block[own] != low).astype(np.int64))
            for key, own in got.groupby(["label", "length"]).indices.items():
                if key not in cells.centres:
                    continue
                base, centres = cells.centres[key]
                d = apart(unit(got["embedding"].iloc[own].tolist()), centres)
                mine = cell[own]
                block = node[own] % deal[mine]
                for c in range(base, base + len(centres)):
                    reached = (d[:, c - base] <= radius[c] + far + SLACK) & (deal[c] > 0)
                    for k in range(int(deal[c])):
                        inside = reached & (mine == c)
                        low, high = np.minimum(block, k)[inside], np.maximum(block, k)[inside]
                        emit(own[inside], c, c, low, high, (block[inside] != low).astype(np.int64))
                        after, before = reached & (mine < c), reached & (mine > c)
                        emit(own[after], mine[after], c, block[after], k, 0)
                        emit(own[before], c, mine[before], k, block[before], 1)
            at, a, b, i, j, side = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 6
            single = ((b < 0) | (a == b)) & (i == j)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (a, b, i, j, side)]
                + [pa.array(single)]
                + [batch.column(c).take(pa.array(at)) for c in ("node", "n", "embedding")],
                names=["a", "b", "i", "j", "side", "single", "node", "n", "embedding"],
            )

    kind = points.schema["embedding"].dataType.simpleString()
    tasks = placed.mapInArrow(
        paired,
        f"a long, b long, i long, j long, side long, single boolean, node long, n long, embedding {kind}",
    )
    partial = written(
        tasks.groupBy("a", "b", "i", "j").applyInPandas(task_linker(cosine), "node long, links long, root long")
    )
    counts = partial.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(partial.select(F.col("node").alias("u"), F.col("root").alias("v")))
    rooted = (
        points.select("label", "embedding", "first", "n", "node")
        .join(counts, "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    # Written, so that the joins can split a component or vector with very many rows.
    least = written(rooted.groupBy("root").agg(F.min("first").alias("least")))
    classes = rooted.join(least, "root").select(
        "label", "embedding", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")
    )
    unlinked = rows.filter(~fits).withColumns({"least": F.lit(None).cast(rows.schema["vec_id"].dataType), "links": F.lit(0).cast("long")})
    joined = rows.filter(fits).join(classes, ["label", "embedding"]).unionByName(unlinked)
    component = F.coalesce("least", "vec_id")
    return joined.select(
        "vec_id",
        F.col("links").cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
