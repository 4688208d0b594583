import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from caregauge.llm import bpe, packing, token_files
from caregauge.llm.common import shared_folder
from caregauge.llm.tokens import TextEncoder

from .conftest import TOKENIZER, messy

LIBRARY = Tokenizer.from_file(TOKENIZER)
WORDS = TextEncoder(TOKENIZER)
TREES = bpe.Bpe(TOKENIZER)
TOKENS = bpe.Tokens(TOKENIZER)

texts = st.text(
    st.sampled_from(list("aAbnTt's!?,.09 \n\t\r\x01\x1c\x85\xa0éÉßΣσİǄﬁ̣́日本한ु٣½😀<|>")), max_size=60
) | st.text(max_size=40)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(texts)
def test_ids_are_those_of_the_library(text):
    want = library(text)
    assert WORDS.encode_texts([text, "", text]) == [want, [], want]
    assert TREES.encode_texts([text, "", text]) == [want, [], want]
    assert TOKENS.decode(np.array(want, dtype=np.int64)) == LIBRARY.decode(want, skip_special_tokens=False)


def test_long_words_and_special_tokens():
    for text in ("ab" * 3_000 + "é" * 200, "a" * 65, "a<|endoftext|>b<|startoftext|> <|", "x" * 64, "x" * 63 + "é"):
        assert TREES.encode_texts([text]) == WORDS.encode_texts([text]) == [library(text)]


def test_full_caches_change_nothing():
    small = TextEncoder(TOKENIZER, cached_words=3)
    rows = [t or "" for _, t in messy()]
    assert small.encode_texts(rows) + small.encode_texts(rows) == [library(t) for t in rows] * 2


def test_encode_and_decode(documents, no_documents, tokenizer):
    got = bpe.decode(bpe.encode(documents, tokenizer), tokenizer).collect()
    want = [(i, library(t or "")) for i, t in messy()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=key) == sorted(want, key=key)
    assert all(r["decoded"] == LIBRARY.decode(r["ids"], skip_special_tokens=False) for r in got)
    assert bpe.decode(bpe.encode(no_documents, tokenizer), tokenizer).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=9))
def test_bound_never_exceeds_the_best_packing(lengths):
    def best(rest, rooms):
        if not rest:
            return len(rooms)
        found = len(lengths) + 1
        for k in {r: i for i, r in enumerate(rooms) if r >= rest[0]}.values():
            found = min(found, best(rest[1:], rooms[:k] + [rooms[k] - rest[0]] + rooms[k + 1 :]))
        return min(found, best(rest[1:], [*rooms, 24 - rest[0]]))

    array = np.array(lengths, dtype=np.int64)
    bins, _ = packing.best_fit(array, 24)
    least = best(sorted(lengths, reverse=True), [])
    assert packing.lower_bound(array, 24) <= least <= (bins.max() + 1 if lengths else 0)


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = packing.best_fit(np.array([7, 6, 3, 4]), 10)
    assert bins.tolist() == [0, 1, 0, 1] and offsets.tolist() == [0, 0, 7, 6]


def check_places(rows, capacity):
    placed = defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def test_pack(documents, no_documents, tokenizer):
    got = packing.pack(documents, tokenizer, capacity=256).collect()
    want = Counter()
    for i, t in messy():
        ids = [*library(t or ""), 0]
        for k in range(0, len(ids), 256):
            part = ids[k : k + 256]
            want[i, k // 256, k, len(part), zlib.crc32(raw(part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = check_places(got, 256)
    lengths = np.array([k[3] for k in want.elements()])
    assert bins <= packing.lower_bound(lengths, 256) + 1
    assert packing.pack(no_documents, tokenizer).count() == 0


def test_partitions_with_gaps_exchange_documents(spark):
    r = np.random.default_rng(3)
    lengths = r.integers(20, 70, 4_000)
    items = packing.written(spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(lengths)], "name long, length long"))
    apart = check_places(packing.place(items, 100, partition_rows=250, rounds=0).collect(), 100)
    rows = packing.place(items, 100, partition_rows=250, rounds=4).collect()
    together = check_places(rows, 100)
    assert sorted(x["name"] for x in rows) == list(range(4_000))
    assert packing.lower_bound(lengths, 100) <= together < apart


def test_exchange_goes_on_until_no_partitions_with_gaps_are_left(spark):
    # Even lengths never fill an odd bin, and the bound does not see it: all bins have some room.
    lengths = 2 * np.random.default_rng(4).integers(30, 100, 128_000)
    items = packing.written(spark.createDataFrame(packing.pd.DataFrame({"name": np.arange(len(lengths)), "length": lengths})))
    together = check_places(packing.place(items, 301, partition_rows=1_000).collect(), 301)
    rows = packing.place(items, 301, partition_rows=1_000, rounds=4).collect()
    assert len({x["name"] for x in rows}) == len(rows) == len(lengths)
    assert packing.lower_bound(lengths, 301) <= together < check_places(rows, 301)


def test_partitions_give_up_their_emptiest_bins():
    bins, filled = np.array([0, 1, 1, 2, 0, 2]), np.array([9, 4, 7])
    assert packing.emptiest(bins, filled, 4).tolist() == [False, True, True, True, False, True]
    assert packing.emptiest(bins, filled, 3).tolist() == [False, True, True, False, False, False]
    assert packing.emptiest(bins, filled, 9).all()


def test_documents_that_wait_are_exchanged_too(spark):
    """With little given up at once, the rest has exchanges of its own."""
    lengths = 2 * np.random.default_rng(4).integers(30, 100, 20_000)
    items = packing.written(spark.createDataFrame(packing.pd.DataFrame({"name": np.arange(len(lengths)), "length": lengths})))
    apart = check_places(packing.place(items, 301, partition_rows=500, rounds=0).collect(), 301)
    rows = packing.place(items, 301, partition_rows=500, given_up=1).collect()
    assert len({x["name"] for x in rows}) == len(rows) == len(lengths)
    assert packing.lower_bound(lengths, 301) <= check_places(rows, 301) <= apart


def test_token_files(spark, documents, no_documents, tokenizer):
    folder = shared_folder(spark)
    token_files.write_token_files(documents, folder, tokenizer)
    rows = token_files.read_token_files(spark, folder)
    got = {(r["start"], r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in rows.collect()}
    at, want = 0, set()
    for i, t in sorted(messy(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = (*library(t or ""), 1)
        want.add((at, i, len(ids), ids))
        at += len(ids)
    assert got == want
    sums = token_files.checksums(rows).select("start", "ids_crc32").collect()
    assert {tuple(r) for r in sums} == {(s, zlib.crc32(raw(ids))) for s, _, _, ids in want}
    empty = shared_folder(spark)
    token_files.write_token_files(no_documents, empty, tokenizer)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_starts_whatever_the_files_are(spark, documents, tokenizer, tmp_path):
    """File numbers of more digits than their padding, and a session that splits files by rows."""
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "5")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_token_files(documents, str(tmp_path / "t"), tokenizer)
    finally:
        for key in ("files.maxRecordsPerFile", "adaptive.coalescePartitions.enabled"):
            spark.conf.unset(f"spark.sql.{key}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    lengths = [len(library(t or "")) + 1 for _, t in sorted(messy(), key=lambda r: (r[0] is not None, r[0] or 0))]
    want = sorted(zip(np.cumsum([0, *lengths]).tolist(), lengths))

    def starts():
        return sorted((r["start"], r["n_tokens"]) for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect())

    files = sorted((tmp_path / "t").glob("*.parquet"))
    assert len(files) > 2 and starts() == want
    for number, file in enumerate(files):
        file.rename(file.with_name(f"part-{99_998 + number:05}-{file.name.split('-', 2)[2]}"))
    spark.catalog.clearCache()
    assert starts() == want
    (tmp_path / "t" / files[0].name).write_bytes((tmp_path / "t" / f"part-99998-{files[0].name.split('-', 2)[2]}").read_bytes())
    (tmp_path / "t" / f"part-00000-other.parquet").write_bytes((tmp_path / "t" / files[0].name).read_bytes())
    with pytest.raises(Exception, match="two token files"):
        starts()


def test_selective_reads_reach_the_scan(spark, documents, tokenizer):
    folder = shared_folder(spark)
    token_files.write_token_files(documents, folder, tokenizer)
    rows = token_files.read_token_files(spark, folder).filter("doc_id = 30").select("doc_id", "n_tokens")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,30)" in plan
    assert "ids" not in plan


def test_layout_of_token_files(spark, documents, tokenizer, tmp_path):
    pq = pytest.importorskip("pyarrow.parquet")
    token_files.write_token_files(documents, f"file://{tmp_path}/t", tokenizer)
    files = sorted((tmp_path / "t").glob("*.parquet"))
    groups = [pq.ParquetFile(f).metadata.row_group(0) for f in files if pq.ParquetFile(f).metadata.num_rows]
    columns = {groups[0].column(i).path_in_schema: groups[0].column(i) for i in range(groups[0].num_columns)}
    assert "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
