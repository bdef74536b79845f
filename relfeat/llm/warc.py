"""WARC archives: writing pages as records, and reassembling segmented records.

Writing: each page is a response record whose block is an HTTP message with chunked transfer
framing; a page whose payload equals another's is a revisit record that refers to it.  A block of
more than ``segment_bytes`` is cut into a first record and continuation records
(``WARC-Segment-Number``, ``WARC-Segment-Origin-ID``, ``WARC-Segment-Total-Length`` on the last).

Reading: records are framed by their Content-Length; records of one origin are grouped by its
identifier, ordered by segment number, checked for gaps and for the total length, and joined; then
the chunked framing is decoded.

Scale: an archive file holds at most ``records_per_file`` records of at most ``segment_bytes``
and their headers, so a file read whole has a bounded size; whole records never leave their task,
and only segments of long records are shuffled.  The largest group is the segments of a record,
whose payload is one value of the result.  Equal payloads are found by digest with partial
aggregation, however many pages share one.

Defined results: a null payload is empty; null ids are kept (a null id is smaller than any); of
equal payloads, all rows that carry the largest id are responses; repeated ids give a record
each; a record with missing or doubled segments, a wrong total length, a cut block or broken framing
is returned with ``valid`` false and a null payload, and so is one whose header has no end or says
no number where one belongs; segments without a first one are returned as a record with the
identifier of their origin and nothing else; after a record of unknown length reading goes on at
the next header; empty tables give no records.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of data in a chunk of the transfer framing.
CHUNK = 8192
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, uri string, key string, refers_to string, digest string, origin string, segment long, total long, block binary, whole boolean, origin_id string"


def _cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of about ``size`` bytes, cut between UTF-8 characters."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out or [b""]


def http_block(payload: bytes) -> bytes:
    parts = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for piece in _cut(payload, CHUNK) if payload else []:
        parts.append(b"%x\r\n%b\r\n" % (len(piece), piece))
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(message: bytes) -> bytes | None:
    """The payload of an HTTP message; None where its framing is broken."""
    head, sep, body = message.partition(b"\r\n\r\n")
    if not sep:
        return None
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return body
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0].strip() or b"x", 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0:
            return None
        if size == 0:
            return b"".join(out)
        data = body[end + 2:end + 2 + size]
        if len(data) != size or body[end + 2 + size:end + 4 + size] != b"\r\n":
            return None
        out.append(data)
        at = end + 4 + size


def page_id_of(key) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def _header(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def page_records(key, uri: str | None, payload: bytes, response, segment_bytes: int) -> list[bytes]:
    """The records of a page; ``response``: the page it revisits, else None."""
    uri = re.sub(r"[\r\n]+", " ", uri) if uri else ""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    common = [("WARC-Record-ID", page_id_of(key)), ("WARC-Target-URI", uri), ("WARC-Date", DATE), ("WARC-Payload-Digest", digest),
              ("X-Record-Key", "" if key is None else str(key))]
    if response is not None:
        return [_header([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", page_id_of(response)),
                         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], b"")]
    block = http_block(payload)
    if len(block) <= segment_bytes:
        return [_header([("WARC-Type", "response"), *common, ("Content-Type", "application/http; msgtype=response")], block)]
    mark = uuid.uuid4().hex  # tells apart the segments of rows that repeat an id
    out, pieces = [], _cut(block, segment_bytes)
    for n, piece in enumerate(pieces, 1):
        number = ("WARC-Segment-Number", str(n))
        if n == 1:
            fields = [("WARC-Type", "response"), *common, number, ("X-Segment-Mark", mark)]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Target-URI", uri), ("WARC-Date", DATE),
                      ("WARC-Segment-Origin-ID", page_id_of(key)), number, ("X-Segment-Mark", mark)]
            if n == len(pieces):
                fields.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_header(fields, piece))
    return out


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit_bytes: int = 1000,
               segment_bytes: int = 1 << 16, records_per_file: int = 1024, compression: str | None = None,
               broadcast_payloads: int = 500_000) -> None:
    """Write ``pages`` as WARC files under ``path``.  Of equal payloads of at least
    ``least_revisit_bytes`` bytes, the page with the largest id is the response."""
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    slim = slim.withColumn("digest", F.when(F.octet_length("payload") >= least_revisit_bytes, F.sha2("payload", 256)))
    shared = slim.where("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("response")).where("n > 1").select("digest", "response").checkpoint()
    # one row a payload that several pages share: sent to the pages while there are few of them,
    # so that payloads are not shuffled; else joined by sorting, where Spark splits hot digests
    few = shared.count() <= broadcast_payloads
    typed = slim.join(F.broadcast(shared) if few else shared, "digest", "left").select(
        "id", "uri", "payload", F.when(F.col("id").isNull() | (F.col("response") != F.col("id")), F.col("response")).alias("response"))

    def records(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("id", "uri", "payload", "response")]
            out, room = [], 0
            for key, uri, payload, response in zip(*columns):
                for record in page_records(key, uri, payload.encode(), response, segment_bytes):
                    out.append(record.decode())
                    room += len(record)
                if room > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, room = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    # a record ends with two line ends: the text writer's line separator
    writer = typed.mapInArrow(records, "value string").write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file)
    (writer.option("compression", compression) if compression else writer).text(path)


def parse_records(data: bytes):
    """The records of an archive, as tuples of ``RECORD``."""
    def number(name: str) -> int | None:
        value = fields.get(name, "")
        return int(value) if re.fullmatch("[0-9]{1,18}", value) else None

    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            if data[at:].strip():
                yield (None,) * 9 + (data[at:], False, None)
            return
        fields: dict[str, str] = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
        length = number("content-length") if "content-length" in fields else 0
        if length is None:  # of unknown length: up to the next header
            after = data.find(b"\r\n\r\nWARC/", end + 4)
            stop = after if after >= 0 else len(data)
        else:
            stop = min(len(data), end + 4 + length)
        segment = number("warc-segment-number")
        origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
        whole = length == stop - end - 4 and not ("warc-segment-number" in fields and segment is None) and not (
            "warc-segment-total-length" in fields and number("warc-segment-total-length") is None)
        yield (*(fields.get(f) for f in ("warc-record-id", "warc-type", "warc-target-uri", "x-record-key", "warc-refers-to", "warc-payload-digest")),
               None if segment is None else (origin or "") + fields.get("x-segment-mark", ""), segment, number("warc-segment-total-length"), data[end + 4:stop], whole, origin)
        at = stop + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Whole records: ``record_id, type, uri, key, refers_to, digest, payload, valid``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [f.split()[0] for f in RECORD.split(", ")]

    def parse(batches):
        for batch in batches:
            name = batch.column("path").to_pylist()
            for i in range(batch.num_rows):
                data = batch.column("content")[i].as_py()
                if name[i].endswith(".gz"):
                    import gzip
                    data = gzip.decompress(data)
                rows, room = [], 0
                for record in parse_records(data):
                    rows.append(record)
                    room += len(record[9])
                    if room > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=names)
                        rows, room = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=names)

    records = files.mapInArrow(parse, RECORD)
    single = records.where("segment IS NULL").select("record_id", "type", "uri", "key", "refers_to", "digest", F.array("block").alias("blocks"), F.col("whole").alias("valid"))
    first = F.max(F.when(F.col("segment") == 1, F.struct("record_id", "type", "uri", "key", "refers_to", "digest")))
    groups = records.where("segment IS NOT NULL").groupBy("origin").agg(
        first.alias("first"), F.max("total").alias("total"), F.min("origin_id").alias("origin_id"), F.bool_and("whole").alias("whole"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    in_order = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    kept = single.columns[:6]
    groups = groups.select(F.coalesce("first.record_id", "origin_id").alias("record_id"), *[f"first.{c}" for c in kept[1:]], F.transform("parts", lambda p: p["block"]).alias("blocks"),
                           (F.coalesce((length == F.col("total")) & in_order, F.lit(False)) & F.col("whole") & F.col("first").isNotNull()).alias("valid"))

    def decode(batches):
        for batch in batches:
            payloads = []
            for i in range(batch.num_rows):
                if not batch.column("valid")[i].as_py():
                    payloads.append(None)
                else:
                    payloads.append(b"" if batch.column("type")[i].as_py() == "revisit" else dechunk(b"".join(batch.column("blocks")[i].as_py())))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [
                pa.array(payloads, pa.binary()), pa.array([p is not None for p in payloads], pa.bool_())], names=[*kept, "payload", "valid"])

    return single.unionByName(groups).mapInArrow(
        decode, "record_id string, type string, uri string, key string, refers_to string, digest string, payload binary, valid boolean")


KINDS = [pa.string()] * 7 + [pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.string()]


def page_digests(records: DataFrame) -> DataFrame:
    """``key, payload_bytes, payload_digest, type, refers_to`` (the response's key) of each page;
    a revisit has the length and digest of the payload it refers to."""
    own = records.select("record_id", "key", "type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"),
                         F.when(F.col("payload").isNotNull(), F.sha1("payload")).alias("payload_digest"))
    responses = own.where("type = 'response'")
    # a row for each referred payload: rows that repeat an id differ in the digest or are alike
    target = responses.groupBy(F.col("record_id").alias("refers_to"), "digest").agg(F.max(F.struct("key", "payload_bytes", "payload_digest")).alias("of"))
    revisits = own.where("type = 'revisit'").select("key", "type", "refers_to", "digest").join(target, ["refers_to", "digest"], "left")
    return responses.select("key", "payload_bytes", "payload_digest", "type", F.lit(None).cast("string").alias("refers_to")).unionByName(
        revisits.select("key", "of.payload_bytes", "of.payload_digest", "type", F.col("of.key").alias("refers_to")))
