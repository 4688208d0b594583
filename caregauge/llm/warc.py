"""Web archives with revisit records for payloads that were archived before."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from caregauge.llm.common import written

# Fixed values of the archive format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX_32, BASE_32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Date of records whose pages carry none.
DATE = "2024-01-01T00:00:00Z"
#: Records of one archive file, at most, and bytes of its payloads, about; a reader holds one
#: packed file at a time.
RECORDS_PER_FILE = 4_096
FILE_BYTES = 64 << 20
#: Bytes that are unpacked at a time, about.
PIECE = 1 << 20
#: Repeated digests, at most, that pages are joined with as they are; where there are more, only
#: pages that a filter of their bits lets through. A filter has BITS_EACH bits a digest, as a power
#: of two from 2 ** LEAST_BITS to 2 ** MOST_BITS (128 MB), which is what is broadcast at most.
JOINED_DIGESTS = 100_000
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 20, 30
ID = "urn:x-page:"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base 32, without padding: 40 bits give eight letters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), HEX_32, BASE_32)


def filter_bits(count: int) -> int:
    """The power of two of a filter's bits for so many digests."""
    return min(MOST_BITS, max(LEAST_BITS, (count * BITS_EACH - 1).bit_length()))


def held_back(headed: DataFrame, copied: DataFrame, bits: int) -> DataFrame:
    """The rows with ``may_repeat``: false only if ``copied`` has no row with the payload digest.

    A hash of each digest in ``copied`` sets one of 2 ** ``bits`` bits, which are collected in
    pieces of 4 KB and sent to every task.
    """
    place = F.pmod(F.xxhash64("payload_digest"), F.lit(1 << bits)) + 1
    pieces = copied.groupBy(F.bitmap_bucket_number(place).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("set_bits")
    )
    at = F.bitmap_bit_position(place).cast("int")
    octet = F.conv(F.hex(F.substring("set_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = octet.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0
    marked = headed.withColumn("piece", F.bitmap_bucket_number(place)).join(F.broadcast(pieces), "piece", "left")
    return marked.withColumn("may_repeat", F.coalesce(is_set, F.lit(False))).drop("piece", "set_bits")


def resolve(pages: DataFrame, least_bytes: int = 0, seen: Observation | None = None) -> DataFrame:
    """Rows (page_id, url, html, payload_bytes, payload_digest, refers_to).

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the least page_id
    is original, the others refer to it; shorter ones are all original, and so is each row that
    repeats the least page_id. Only digests go through the count of copies. Where more than
    JOINED_DIGESTS digests repeat, pages whose digest surely does not are kept out of the join, so
    that their payloads are not shuffled. A null html is an empty payload, and a null page_id is
    never the least. Extra columns are left out. ``seen`` observes ``n`` and ``bytes`` of all
    payloads on the way.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # A written side: the join with it can then split a digest with very many pages.
    headed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns(
        {"payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": sha1_base32(payload)}
    )
    counted = headed
    if seen is not None:
        counted = headed.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("bytes"))
    copied = written(
        counted.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1 and first_id is not null")
        .select("payload_digest", "first_id")
    )
    original = F.col("page_id").eqNullSafe(F.col("first_id")) | (F.col("payload_bytes") < least_bytes)
    if (count := copied.count()) > JOINED_DIGESTS:
        marked = held_back(headed, copied, filter_bits(count))
        alone = marked.where("NOT may_repeat").withColumn("first_id", F.lit(None).cast(copied.schema["first_id"].dataType))
        joined = marked.where("may_repeat").join(copied, "payload_digest", "left").unionByName(alone)
    else:
        joined = headed.join(copied, "payload_digest", "left")
    return (
        joined.withColumn("refers_to", F.when(~original, F.col("first_id")))
        .select("page_id", "url", "html", "payload_bytes", "payload_digest", "refers_to")
    )


def record(date: str = DATE) -> Column:
    """The record's text without the two line ends that close it."""
    end = "\r\n"
    revisit = F.col("refers_to").isNotNull()

    def urn(page: Column) -> Column:
        return F.concat(F.lit(f"<{ID}"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))

    answer = F.concat(
        F.lit(f"HTTP/1.1 200 OK{end}Content-Type: text/html; charset=utf-8{end}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(end + end),
    )
    block = F.when(revisit, answer).otherwise(F.concat(answer, F.col("html")))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")), F.lit(f"{end}WARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        F.lit(""),
    ]
    return F.concat(F.concat_ws(end, *lines), F.lit(end), block)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = DATE) -> None:
    """Writes the pages as compressed archives, originals with their payload and revisits without.

    Spark's own text writer commits the files, so that a lost executor leaves no half file. A
    file takes as many records as ``FILE_BYTES`` hold pages of the mean size.
    """
    seen = Observation()
    resolved = resolve(pages, least_bytes, seen)
    try:
        mean = (seen.get["bytes"] or 0) // max(seen.get["n"], 1)
    except Py4JJavaError:  # a table without rows is planned away, and what observes it too
        mean = 0
    most = max(1, min(RECORDS_PER_FILE, FILE_BYTES // max(mean, 1)))
    resolved.select(record(date).alias("value")).write.options(
        lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=most
    ).text(folder)


def unpacked(data: bytes) -> Iterator[bytes]:
    """The contents of an archive file in pieces: of all its gzip members one after the other, or
    of a file that is not packed. A file that ends within a member raises."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), PIECE):
            yield data[at : at + PIECE]
        return
    member, fed = zlib.decompressobj(31), False
    for at in range(0, len(data), PIECE):
        taken, more = data[at : at + PIECE], False
        while taken or more:
            if not fed:
                taken = taken.lstrip(b"\0")  # padding between members
                if not taken:
                    break
            out = member.decompress(taken, 4 * PIECE)
            fed = True
            if out:
                yield out
            more = len(out) == 4 * PIECE and not member.eof
            taken = member.unconsumed_tail
            if member.eof:
                taken = member.unused_data
                member, fed = zlib.decompressobj(31), False
    if fed:
        raise EOFError("the archive ends within a gzip member")


def parsed(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, of any type and version;
    Content-Length says where a block ends. Data that is no record, or ends within one, raises."""
    pieces, held, at = iter(pieces), bytearray(), 0

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while True:
        while True:  # line ends between records
            while at < len(held) and held[at] in b"\r\n":
                at += 1
            if at < len(held) or not more():
                break
        if at >= len(held):
            return
        while (head := held.find(b"\r\n\r\n", at)) < 0:
            if (len(held) - at >= 5 and not held.startswith(b"WARC/", at)) or not more():
                raise ValueError("no record where one should begin")
        lines = held[at:head].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record where one should begin: {lines[0][:80]}")
        headers: dict[str, str] = {}
        name = ""
        for line in lines[1:]:
            if line[:1] in (" ", "\t"):  # a header goes on
                headers[name] = f"{headers.get(name, '')} {line.strip()}"
            else:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                headers[name] = value.strip()
        at = head + 4
        size = int(headers["content-length"])
        while len(held) - at < size:
            if not more():
                raise EOFError("the archive ends within a record")
        yield headers, bytes(held[at : at + size])
        at += size


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (record_id, type, uri, date, digest, refers_to, payload) of all records of all
    ``.gz`` and ``.warc`` files, with one gzip member a file or one a record.

    ``payload`` is what follows the HTTP headers of a response's block, null for other records;
    headers that a record lacks are null. Ids are those of the records; for records that
    ``write_archives`` made, the page_ids as texts.
    """
    schema = "record_id string, type string, uri string, date string, digest string, refers_to string, payload binary"
    arrow = pa.schema([(n, pa.binary() if n == "payload" else pa.string()) for n in (x.split()[0] for x in schema.split(", "))])

    def page(urn: str | None) -> str | None:
        if urn is None:
            return None
        urn = urn.strip("<>")
        return urn.removeprefix(ID)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                found, size = [], 0
                for headers, block in parsed(unpacked(content.as_py())):
                    kind = headers.get("warc-type")
                    digest = headers.get("warc-payload-digest")
                    found.append(
                        (
                            page(headers.get("warc-record-id")),
                            kind,
                            headers.get("warc-target-uri"),
                            headers.get("warc-date"),
                            None if digest is None else digest.removeprefix("sha1:"),
                            page(headers.get("warc-refers-to")),
                            block.partition(b"\r\n\r\n")[2] if kind == "response" else None,
                        )
                    )
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), arrow)], schema=arrow)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found), arrow)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(folder).select("content")
    return files.mapInArrow(rows, schema)


def archived_pages(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) read from archives.

    Size and digest come from the payloads themselves; revisit records take those of the response
    that they refer to, and of responses with that id the one whose payload has the digest that
    the revisit record names. Without such a response both are null.
    """
    own = F.col("payload").isNotNull()
    # Unpacked once: sizes and digests are written, payloads are not.
    records = written(
        read_archives(spark, folder)
        .where("type IN ('response', 'revisit')")
        .select(
            "record_id",
            "type",
            "refers_to",
            F.octet_length("payload").cast("long").alias("bytes"),
            F.when(own, sha1_base32(F.col("payload"))).alias("digest"),
            F.col("digest").alias("named_digest"),
        )
    )
    # Written, so that a response with very many revisits does not meet them in one task.
    originals = written(
        records.filter(F.col("type") == "response")
        .groupBy(F.col("record_id").alias("original"), F.col("digest").alias("original_digest"))
        .agg(F.max("bytes").alias("original_bytes"))
    )
    # Responses refer to nothing; with a key of their own they are dealt over all tasks.
    wanted = F.coalesce(records["refers_to"], F.concat(F.lit("response "), records["record_id"]))
    same = (wanted == originals["original"]) & (records["named_digest"] == originals["original_digest"])
    return records.join(originals, same, "left").select(
        F.expr(f"try_cast(record_id as {id_type})").alias("page_id"),
        F.coalesce("bytes", "original_bytes").alias("payload_bytes"),
        F.coalesce("digest", "original_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.expr(f"try_cast(refers_to as {id_type})").alias("refers_to"),
    )
