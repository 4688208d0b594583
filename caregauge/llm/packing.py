"""Best-fit packing of token pieces, certified by dual-feasible lower bounds."""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caregauge.llm.common import texts, written
from caregauge.llm.tokens import batches_of, id_lists, text_encoder, with_end

CAPACITY = 2048
#: Pieces that one task packs; a partition's loss is a part of its last bin.
PARTITION_ROWS = 50_000
#: Pieces that a partition gives up in one exchange, as a multiple of ``PARTITION_ROWS``: a task
#: then holds twice that, however many rounds there are. The others have exchanges of their own.
GIVEN_UP = 8

PIECES = "piece int, start long, length long, ids_crc32 long, ids array<int>"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, ids) of every document.

    A document is its ids and ``end_id``; one that is longer than ``capacity`` is cut into pieces
    of that length, the last may be shorter. A null or empty text is ``end_id`` alone. Repeated
    rows and null doc_ids give pieces like any others; extra columns are left out.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        for batch in batches_of(batches):
            ends, ids = with_end(*encoder.encode(batch.column("text")), end_id)
            many = -(-np.diff(ends) // capacity)
            row = np.repeat(np.arange(len(many)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(ends)[row] - start)
            cuts = np.concatenate(([0], np.cumsum(length)))
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                    id_lists(cuts, ids),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
            )

    docs = texts(docs)
    return docs.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing of these lengths needs at least, by two families of dual-feasible
    functions: one rounds lengths over ``capacity - k`` up and those under ``k`` down to nothing,
    the other rounds to the k-th parts of a bin."""
    if not len(lengths):
        return 0
    many = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    count_to, sum_to = np.cumsum(many), np.cumsum(many * size)
    k = np.arange(1, capacity // 2 + 1)
    large = count_to[capacity] - count_to[capacity - k]
    middle = sum_to[capacity - k] - sum_to[k - 1]
    best = int(np.max(-(-(large * capacity + middle) // capacity)))
    best = max(best, int(-(-sum_to[capacity] // capacity)))
    for parts in range(1, 101):  # values times ``parts``, so that all are whole numbers
        whole = size * (parts + 1) % capacity == 0
        value = np.where(whole, size * parts, size * (parts + 1) // capacity * capacity)
        best = max(best, -(-int((many * value).sum()) // (capacity * parts)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length by best-fit decreasing: each goes to the bin with the least
    room that holds it. Ties: in the order given."""
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by the room that is left
    rooms = 0  # bit r is set if a bin has room r
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - length
        if left:
            if not open_bins[left]:
                rooms |= 1 << left
            open_bins[left].append(b)
    return bins, offsets


def emptiest(bins: np.ndarray, filled: np.ndarray, most: int) -> np.ndarray:
    """Whether each piece is in one of the bins with the most room that hold ``most`` pieces or less."""
    order = np.argsort(filled, kind="stable")
    chosen = np.zeros(len(filled), dtype=bool)
    chosen[order[np.cumsum(np.bincount(bins)[order]) <= most]] = True
    return chosen[bins]


def packer(capacity: int, turn: int, most: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one partition. In one whose bound does not certify its number of bins, documents of
    bins with room are ``loose`` or, where these are over ``most``, those of the emptiest are and
    the others ``waiting``."""

    def pack_partition(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row").reset_index(drop=True)
        lengths = rows["length"].to_numpy(dtype=np.int64)
        bins, offsets = best_fit(lengths, capacity)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        certified = len(filled) <= lower_bound(lengths, capacity)
        gaps, given = (filled[bins] < capacity) & (not certified), emptiest(bins, filled, most)
        first = (turn << 56) + (int(rows["part"].iloc[0]) << 28)
        return rows.assign(
            sequence_id=first + bins,
            offset=offsets,
            loose=gaps & given,
            waiting=gaps & ~given,
        )

    return pack_partition


def place(
    items: DataFrame, capacity: int = CAPACITY, partition_rows: int = PARTITION_ROWS, given_up: int = GIVEN_UP, rounds: int | None = None
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``capacity``.

    Full rows are sequences of their own. The rest is dealt over partitions, packed best-fit
    decreasing, and held against the partition's lower bound. Partitions with more bins than
    their bound give up the documents of bins with room; these are dealt anew over half as many
    partitions and packed again, until fewer than two such partitions are left or that saves no
    bins. Where a partition has more of them than ``given_up`` times ``partition_rows``, the rest
    is dealt anew when the exchange of the emptiest is through, as long as that saves bins.
    ``rounds`` ends all exchanges earlier. ``items`` must be a written table (its rows are
    numbered). Repeated rows are rows like any others; no row is lost.
    """
    fields = [f for f in items.schema.fields]
    numbered = items.withColumn("row", F.monotonically_increasing_id())
    extra = [("row", T.LongType()), ("part", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())]
    flags = [("loose", T.BooleanType()), ("waiting", T.BooleanType())]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in (*extra, *flags))])
    names = [f.name for f in schema.fields]
    full = F.col("length") == capacity
    no = F.lit(False)
    whole = numbered.filter(full).withColumns(
        {"part": F.lit(-1).cast("long"), "sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long"), "loose": no, "waiting": no}
    )
    turns = itertools.count(1) if rounds is None else iter(range(1, rounds + 1))

    def packed(rows: DataFrame, parts: int, turn: int) -> DataFrame:
        dealt = rows.select(*[f.name for f in fields], "row").withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)))
        return written(dealt.groupBy("part").applyInPandas(packer(capacity, turn, given_up * partition_rows), schema))

    def bins(rows: DataFrame) -> int:
        return rows.filter("offset = 0").count()

    rest = numbered.filter(~full)
    state = packed(rest, max(1, -(-rest.count() // partition_rows)), 0)
    done: list[DataFrame] = [whole.select(names)]
    while True:
        held = []
        for turn in turns:
            loose = state.filter("loose")
            parts, rows = loose.agg(F.count_distinct("part"), F.count("*")).first()
            if parts < 2:
                break
            again = packed(loose, max(1, min(parts // 2, -(-rows // 2_000))), turn)
            if bins(again) >= bins(loose):
                break
            done.append(state.filter("NOT loose AND NOT waiting"))
            held.append(state.filter("waiting"))
            state = again
        done.append(state.filter("NOT waiting"))
        waiting = functools.reduce(DataFrame.unionByName, [*held, state.filter("waiting")])
        rows = waiting.count()
        turn = next(turns, None) if rows else None
        if turn is not None:
            state = packed(waiting, -(-rows // partition_rows), turn)
        if turn is None or bins(state) >= bins(waiting):
            done.append(waiting)
            break
    return functools.reduce(DataFrame.unionByName, done).drop("row", "part", "loose", "waiting")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their places: (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset)."""
    cut = written(pieces(docs, path, capacity, end_id))
    return place(cut.drop("ids"), capacity)
