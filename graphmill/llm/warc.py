"""WARC archives: written with segmented records, read back and reassembled.

A payload goes into an HTTP response with chunked transfer framing. Of payloads that are equal and at least
REVISIT_BYTES long, the one of the smallest page id is a `response` record, the others are `revisit` records
that name its record. A response block over SEGMENT_BYTES is cut: the first record keeps its type with segment
number 1, `continuation` records carry the rest with the origin's id and their number, and the last states
the total length.

Reading inflates all gzip members of a file, parses it by Content-Length, groups the segments of an origin,
orders them by number, checks that none is missing and that the total length holds, and decodes the chunked
framing. Unsegmented records, nearly all, are decoded where they are read and not shuffled. Revisits are
resolved by the record id that they name, and it is an error if that response is missing.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm.common import BATCH_BYTES, bounded_batches, drop_stored, join_skewed, scratch, stored

REVISIT_BYTES = 100
SEGMENT_BYTES = 48 << 10
CHUNK_BYTES = 16 << 10
#: Records of one archive file: with SEGMENT_BYTES for each at most, a file is read whole.
FILE_RECORDS = 500
#: Ends a record; as the text sink's line separator it is written after each row.
RECORD_END = "\r\n\r\n"
VERSION = b"WARC/1.1\r\n"
#: The time stated for records whose fetch time isn't known.
DATE = "1970-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing: sizes in hexadecimal with extensions ignored, up to the empty chunk;
    trailers are ignored. Raises ValueError on framing that is broken or cut off."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, rid: str, block: bytes, **fields) -> bytes:
    """A record without its end. Field names have underscores for hyphens; None is left out."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", **{k.replace("_", "-"): v for k, v in fields.items() if v is not None}, "Content-Length": len(block)}
    return VERSION + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, row: int, refers_to: str | None = None, date: str = DATE) -> list[bytes]:
    """The records of a page: one, or one for each segment. row tells apart rows that share id and payload, so
    that every record has an id of its own; refers_to is the record id of the response of an equal payload."""
    rid = urn(page_id, f"{digest}/{row}")
    uri = re.sub(r"\s", "%20", url or "")
    common = {"WARC_Date": date, "WARC_Target_URI": uri, "WARC_Payload_Digest": f"sha256:{digest}", "X_Page_ID": "" if page_id is None else page_id}
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        return [record("revisit", rid, b"HTTP/1.1 200 OK\r\n\r\n", WARC_Profile=profile, WARC_Refers_To=f"<{refers_to}>", **common)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        return [record("response", rid, block, **common)]
    parts = [block[i : i + SEGMENT_BYTES] for i in range(0, len(block), SEGMENT_BYTES)]
    out = [record("response", rid, parts[0], WARC_Segment_Number=1, **common)]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        out.append(record("continuation", urn(page_id, f"{digest}/{row}/{n}"), part, WARC_Date=date, WARC_Target_URI=uri, WARC_Segment_Origin_ID=f"<{rid}>", WARC_Segment_Number=n, WARC_Segment_Total_Length=total))
    return out


def inflated(data: bytes) -> bytes:
    """The content of a gzip file, of all its members, one after another, as archives with a member for each
    record have them. Broken or cut off members raise ValueError."""
    out = []
    while data:
        member = zlib.decompressobj(47)
        try:
            out.append(member.decompress(data))
        except zlib.error as e:
            raise ValueError(f"broken gzip member: {e}") from e
        if not member.eof:
            raise ValueError("gzip member cut off")
        data = member.unused_data
    return b"".join(out)


def parse(data: bytes):
    """(fields with lower-case names, block) of each record of a file."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        size = int(head["content-length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError("record not ended")
        at += 4


def urn(page: int | None, what: str) -> str:
    """A record id of its own for a page and what tells its records apart."""
    return "urn:uuid:" + str(uuid.UUID(hashlib.md5(f"{page}/{what}".encode(), usedforsecurity=False).hexdigest()))


def roles(own: DataFrame) -> DataFrame:
    """Of rows (id, row, digest, n) those that are revisits: row, and id and row of the response they refer to.

    A third of all pages may have one payload: digests are counted in part before the shuffle, only digests
    seen twice are joined, and hot ones are broadcast."""
    one = own.where(F.col("id").isNotNull() & (F.col("n") >= REVISIT_BYTES)).select("id", "row", "digest")
    again = stored(one.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("m")).where("m > 1"))
    met = join_skewed(one, again, ["digest"], own.count())
    return met.where("id <> first.id").select("row", F.col("first.id").alias("first"), F.col("first.row").alias("first_row"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Archive files of the pages below path, compressed, of FILE_RECORDS records at most. The pages are stored
    with a number for each row first, so that both passes over them see the same numbers."""
    spark = pages.sparkSession
    bounded_batches(spark)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    own = stored(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"), F.monotonically_increasing_id().alias("row")))
    rep = stored(roles(own.select("id", "row", "digest", "n")))
    rows = own.join(rep, "row", "left").select("id", "url", "payload", "digest", "row", "first", "first_row")

    def run(batches):
        for b in batches:
            out = []
            for page, url, payload, digest, row, first, first_row in zip(*(c.to_pylist() for c in b.columns)):
                out += records(page, url, payload.encode(), digest, row, None if first is None else urn(first, f"{digest}/{first_row}"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = rows.mapInArrow(run, "value binary").select(F.expr("cast(value as string)").alias("value"))
    made.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    drop_stored(own, rep)


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """Per page record: page_id, record_type, rid, refers (a record id, of revisits), payload (null for
    revisits), payload_bytes (null for revisits), payload_digest."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")

    def segments(batches):
        for b in batches:
            for data in b.column(0):
                data = data.as_py()
                data = inflated(data) if data[:2] == b"\x1f\x8b" else data
                rows, size = [], 0
                for head, block in parse(data):
                    if head["warc-type"] not in ("response", "revisit", "resource", "continuation"):
                        continue  # warcinfo, request and metadata records hold no page
                    number, page, total = (head.get(k) or None for k in ("warc-segment-number", "x-page-id", "warc-segment-total-length"))
                    rows.append({
                        "page_id": None if page is None else int(page),
                        "kind": head["warc-type"],
                        "rid": head["warc-record-id"].strip("<>"),
                        "digest": head.get("warc-payload-digest", ""),
                        "refers": (head.get("warc-refers-to") or "").strip("<>") or None,
                        "segment": None if number is None else int(number),
                        "total": None if total is None else int(total),
                        "origin": (head.get("warc-segment-origin-id") or "").strip("<>") or None,
                        "block": block,
                    })
                    size += len(block)
                    if len(rows) >= 100 or size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=SEGMENT)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=SEGMENT)

    parts = files.mapInArrow(segments, "page_id long, kind string, rid string, digest string, refers string, segment int, total long, origin string, block binary")
    whole = parts.where("segment is null")
    cut = parts.where("segment is not null").withColumn("origin", F.coalesce("origin", "rid"))
    joined = (
        cut.groupBy("origin")
        .agg(
            F.first("page_id", True).alias("page_id"),
            F.max_by("kind", F.when(F.col("segment") == 1, 1)).alias("kind"),
            F.max(F.when(F.col("segment") == 1, F.col("digest"))).alias("digest"),
            F.max("total").alias("total"),
            F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        )
        .select("page_id", "kind", F.col("origin").alias("rid"), "digest", F.lit(None).cast("string").alias("refers"), "total", F.transform("parts", lambda p: p["segment"]).alias("numbers"), F.transform("parts", lambda p: p["block"]).alias("blocks"))
    )
    single = whole.select("page_id", "kind", "rid", "digest", "refers", F.lit(None).cast("long").alias("total"), F.lit(None).cast("array<int>").alias("numbers"), F.array("block").alias("blocks"))

    def decode(batches):
        for b in batches:
            payloads = []
            for kind, digest, total, numbers, blocks in zip(*(b.column(c).to_pylist() for c in ("kind", "digest", "total", "numbers", "blocks"))):
                if numbers is not None and (numbers != list(range(1, len(numbers) + 1)) or total != sum(map(len, blocks))):
                    raise ValueError(f"segments {numbers} of total length {total} do not make a record")
                payloads.append(payload_of(kind, digest, b"".join(blocks)))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("kind"), b.column("rid"), b.column("refers"), pa.array([p for p, _, _ in payloads], pa.binary()), pa.array([n for _, n, _ in payloads], pa.int64()), pa.array([d for _, _, d in payloads], pa.string())],
                names=["page_id", "record_type", "rid", "refers", "payload", "payload_bytes", "payload_digest"],
            )

    return single.unionByName(joined).mapInArrow(decode, "page_id long, record_type string, rid string, refers string, payload binary, payload_bytes long, payload_digest string")


def resolved(records: DataFrame) -> DataFrame:
    """decoded() records with the revisits' refers_to (a page id) and payload_bytes taken from the response that
    they name. A revisit whose response is missing, or has another digest, raises an error. `records` is read
    several times."""
    back = records.where("record_type = 'revisit'")
    named = stored(back.where("refers is not null").groupBy("refers").agg(F.count("*").alias("m")))
    target = records.where("record_type <> 'revisit'").select(F.col("rid").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("_n"), F.col("payload_digest").alias("_d"))
    target = stored(named.join(target, "refers", "left"))  # one response for each name
    met = join_skewed(back.drop("payload_bytes"), target, ["refers"], back.count(), how="left")
    lost = F.col("_d").isNull() | ((F.col("payload_digest") != "") & (F.col("_d") != F.col("payload_digest")))
    met = met.withColumns({"payload_bytes": F.when(lost, F.raise_error(F.concat(F.lit("no response for the revisit "), "rid"))).otherwise(F.col("_n")), "payload_digest": F.col("_d")})
    cols = ["page_id", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    return records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(*cols).unionByName(met.select(*cols))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per page record: page_id, record_type, refers_to, payload (null for revisits), payload_bytes,
    payload_digest. A record whose segments are incomplete or repeated, whose length or framing is wrong, whose
    payload does not have the stated digest, or whose response is missing raises an error: nothing is left out
    silently. An archive of no record gives no row. Records of other tools have no page_id: it is null."""
    return resolved(stored(decoded(spark, path)))


SEGMENT = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("rid", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("origin", pa.string()), ("block", pa.binary())])


def payload_of(kind: str, digest: str, block: bytes) -> tuple[bytes | None, int | None, str]:
    """Payload, its length and SHA-256 of a whole block; a revisit has no payload, and its digest is as stated.
    A stated digest of another algorithm is not compared."""
    stated = digest.removeprefix("sha256:") if digest.startswith("sha256:") else ""
    if kind == "revisit":
        return None, None, stated
    head, gap, body = block.partition(b"\r\n\r\n")
    if kind == "resource" or not head.startswith(b"HTTP/"):
        gap, body, head = b"", block, b""
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    payload = dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    found = hashlib.sha256(payload).hexdigest()
    if stated and found != stated:
        raise ValueError("payload digest does not hold")
    return payload, len(payload), found


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the pages as archives in the shared folder and read them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Null payloads are empty; null urls are empty; payloads of any length are cut into segments; rows with a null
    id are responses; rows that share id and payload are all responses or all revisits, each with a record of
    its own; other columns are not read; no pages give no rows."""
    spark = pages.sparkSession
    path = scratch(spark, "-warc")
    write(pages, path, id_col, url_col, payload_col)
    got = stored(decoded(spark, path).drop("payload")).withColumn("payload", F.lit(None).cast("binary"))
    return resolved(got).select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
