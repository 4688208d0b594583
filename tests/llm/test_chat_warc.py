import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from caregauge.llm import chat, warc
from caregauge.llm.common import shared_folder

HARD = r"\### Assistant: </turn> ok"


def conversation_rows():
    rows = [(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)]
    rows += [(1, t, ["system", "user", "assistant"][t and 1 + (t + 1) % 2], f"turn {t} " + "word " * (t * 13 % 70)) for t in range(150)]
    rows += [(2, 0, "system", "s" * 3_000), (2, 1, "user", "long " * 900), (2, 2, "assistant", "longer " * 900), (2, 3, "assistant", "")]
    rows += [(3, None, None, None), (3, 1, "assistant", None), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie")]
    rows += [(None, 0, "assistant", "no id"), (4, 0, "a\\\nb\n", "x\\"), (4, 1, "assistant", "<turn>x\n</turn>\n\\<turn>\\")]
    rows += [(5, 9, "assistant", "\n\n</turn>\n<turn>assistant\nfake\n</turn>\n"), (6, 0, "user", "😀" * 5), (6, 1, "assistant", "é😀\\<turn")]
    return rows


@pytest.fixture(scope="module")
def formatted(spark):
    rows = [(*r, 7, "x") for r in conversation_rows()]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos long, window string")
    return chat.written(chat.windows(given))


def by_conversation():
    found = {}
    for c, t, role, text in conversation_rows():
        found.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: sorted(t) for c, t in found.items()}


def test_read_back(formatted):
    got = {r["conv_id"]: r for r in chat.digests(chat.read_windows(formatted)).collect()}
    want = by_conversation()
    assert got.keys() == want.keys()
    for c, turns in want.items():
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss)
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_windows_keep_to_the_budget(formatted):
    rows = formatted.filter("conv_id = 1").orderBy("window").collect()
    assert len(rows) > 10
    for k, r in enumerate(rows):
        parts = r["formatted"].split(chat.CLOSE)[:-1]
        assert parts[0].startswith("<turn>system")
        assert r["n_repeated"] == 0 if k == 0 else 1 <= r["n_repeated"] <= 1 + chat.HISTORY_TURNS
        words = sum(len(p.split()) for p in parts[r["n_repeated"] :])
        assert words < 2 * chat.STRIDE
        for start, length in r["loss"]:
            assert r["formatted"][:start].endswith("<turn>assistant\n")
            assert r["formatted"][start + length :].startswith("\n" + chat.CLOSE)


def test_history_is_repeated_outside_the_mask(formatted):
    rows = formatted.filter("conv_id = 1").orderBy("window").collect()
    assert any("<turn>assistant" in "".join(r["formatted"].split(chat.CLOSE)[: r["n_repeated"]]) for r in rows)
    assert sum(len(r["loss"]) for r in rows) == sum(role == "assistant" for _, _, role, _ in by_conversation()[1])


def test_other_budgets_read_back_the_same(spark, formatted):
    given = spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string")
    small = chat.written(chat.windows(given, stride=20, history_turns=3, history_tokens=500))
    assert small.count() > formatted.count()
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_sha256"]
    a, b = (chat.digests(chat.read_windows(w)).select(columns) for w in (small, formatted))
    assert a.exceptAll(b).count() == 0


def test_no_python_and_no_rows(spark, formatted):
    given = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat.digests(chat.read_windows(chat.windows(given)))
    assert out.count() == 0
    plan = chat.digests(chat.read_windows(formatted))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


PAGES = [
    (5, "http://a/ x\r\n", "<p>same</p>"),
    (3, "http://b", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (3, "http://b", "<p>same</p>"),
    (10, "u", None),
    (11, "u", ""),
    (12, "u", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (13, "u", "<p>" + "long " * 50_000),
    (None, "u", "<p>same</p>"),
    (None, "u", "alone"),
]


@pytest.mark.parametrize("least", [0, 5, 12])
def test_archives(spark, least):
    pages = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, bytes int")
    folder = shared_folder(spark)
    warc.write_archives(pages, folder, least)
    got = [tuple(r) for r in warc.archived_pages(spark, folder).collect()]
    want = []
    for p, _, html in PAGES:
        raw = (html or "").encode()
        same = [q for q, _, h in PAGES if (h or "") == (html or "") and q is not None]
        first = min(same) if same and len(raw) >= least else p
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((p, len(raw), digest, "response" if p == first else "revisit", None if p == first else first))
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def as_rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("least_bits", [1, 12])
def test_pages_that_do_not_repeat_stay_out_of_the_join(spark, monkeypatch, least_bits):
    """With a filter of two bits nearly all pages are let through, with 4,096 few of those alone."""
    rows = [(*p, "d", 1) for p in PAGES] + [(100 + k, "u", f"page {k % 900}", "d", 1) for k in range(1_000)]
    pages = chat.written(spark.createDataFrame(rows, "page_id long, url string, html string, digest string, bytes int"))
    for least in (0, 12):
        plain = as_rows(warc.resolve(pages, least))
        monkeypatch.setattr(warc, "JOINED_DIGESTS", 0)
        monkeypatch.setattr(warc, "BITS_EACH", 1)
        monkeypatch.setattr(warc, "LEAST_BITS", least_bits)
        monkeypatch.setattr(warc, "MOST_BITS", least_bits)
        assert as_rows(warc.resolve(pages, least)) == plain
        monkeypatch.undo()


def test_filter_lets_all_repeated_digests_through(spark):
    digests = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(4_000)]
    headed = spark.createDataFrame([(d,) for d in digests], "payload_digest string")
    copied = spark.createDataFrame([(d,) for d in digests[:1_000]], "payload_digest string")
    bits = warc.filter_bits(1_000)
    assert bits == warc.LEAST_BITS and warc.filter_bits(10**6) == 26 and warc.filter_bits(10**12) == warc.MOST_BITS
    passed = {r[0] for r in warc.held_back(headed, copied, bits).where("may_repeat").collect()}
    assert set(digests[:1_000]) <= passed and len(passed) < 1_050
    few = {r[0] for r in warc.held_back(headed, copied, 12).where("may_repeat").collect()}
    assert set(digests[:1_000]) <= few and len(few) < 2_200
    assert not warc.held_back(headed, copied.limit(0), 20).where("may_repeat").count()


def test_revisits_of_an_id_with_two_payloads(spark):
    html = {1: "<p>one</p>", 2: "<p>the second one</p>", 3: "<p>three, the longest one</p>"}
    rows = [(3, k) for k in html] + [(5, 1), (6, 2), (7, 3), (8, 2)]
    pages = spark.createDataFrame([(p, "u", html[k]) for p, k in rows], "page_id long, url string, html string")
    folder = shared_folder(spark)
    warc.write_archives(pages, folder)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in warc.archived_pages(spark, folder).collect())
    want = [(p, len(html[k]), base64.b32encode(hashlib.sha1(html[k].encode()).digest()).decode()) for p, k in rows]
    assert got == sorted(want)


def test_records(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = shared_folder(spark)
    warc.write_archives(pages, folder)
    records = warc.read_archives(spark, folder)
    assert {r[0] for r in records.filter("type = 'revisit'").select(F.col("payload").isNull()).collect()} == {True}
    assert records.filter("record_id = '5'").first()["uri"] == "http://a/%20x%20%20"
    assert bytes(records.filter("record_id = '12'").first()["payload"]).decode() == PAGES[6][2]


def test_no_pages(spark):
    folder = shared_folder(spark)
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.archived_pages(spark, folder).count() == 0


def member(version, headers, block):
    lines = [version, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_reads_archives_of_others(spark, tmp_path):
    """A gzip member for each record, other record types, versions, letter case and folded headers."""
    answer = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    big = bytes(range(256)) * 40_000
    records = [
        member("WARC/1.0", [("WARC-Type", "warcinfo"), ("WARC-Date", "2020-01-01T00:00:00Z")], b"software: x\r\n\r\nmore"),
        member("WARC/1.0", [("warc-type", "response"), ("WARC-RECORD-ID", "<urn:uuid:1>"), ("warc-target-uri", "http://a/")], answer + b"one"),
        member("WARC/1.1", [("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:2>")], b"GET / HTTP/1.1\r\n\r\n"),
        member("WARC/1.1", [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:3>"), ("WARC-Payload-Digest", "sha1:X")], answer + big),
        member("WARC/1.1", [("WARC-Type", "resource"), ("X-Long", "a\r\n b")], b""),
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "each.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "a" / "one.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "a" / "plain.warc").write_bytes(b"".join(records))
    found = warc.read_archives(spark, str(tmp_path / "a")).collect()
    kinds = [r.type for r in found]
    assert {k: kinds.count(k) for k in set(kinds)} == {"warcinfo": 3, "response": 6, "request": 3, "resource": 3}
    assert {(r.record_id, r.uri, r.digest, bytes(r.payload)) for r in found if r.type == "response"} == {
        ("urn:uuid:1", "http://a/", None, b"one"), ("urn:uuid:3", None, "X", big),
    }
    assert {(r.record_id, r.digest, r.payload) for r in found if r.type == "warcinfo"} == {(None, None, None)}


@pytest.mark.parametrize("piece", [1 << 20, 7])
def test_pieces_and_broken_archives(monkeypatch, piece):
    monkeypatch.setattr(warc, "PIECE", piece)
    records = [member("WARC/1.1", [("WARC-Type", "x"), ("N", n)], b"\r\n\r\n" * n) for n in range(6)]
    packed = b"".join(map(gzip.compress, records))
    for data in (packed, gzip.compress(b"".join(records)), b"".join(records), packed + b"\0" * 40):
        assert [(h["n"], b) for h, b in warc.parsed(warc.unpacked(data))] == [(str(n), b"\r\n\r\n" * n) for n in range(6)]
    assert list(warc.parsed(warc.unpacked(b""))) == []
    for data in (packed[:-9], gzip.compress(b"".join(records)[:-20]), b"".join(records)[:-30], b"no archive at all\r\n\r\n"):
        with pytest.raises((EOFError, ValueError)):
            list(warc.parsed(warc.unpacked(data)))


def test_large_pages_share_no_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    pages = [(k, "http://x", f"{k}" + "x" * 500_000) for k in range(8)] + [(90, "http://y", "x" * 3_000_000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(frame, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("*.gz"))) == 9
    back = warc.archived_pages(spark, str(tmp_path / "w")).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in back) == [(k, len(h)) for k, _, h in pages]
