"""WARC archives and transaction assembly (operator 7).

``write`` turns pages into archives: per capture a request, a response or revisit, and a
metadata record, the first and the last tied to the second by WARC-Concurrent-To. Records
are whole UTF-8 text, so Spark's own text writer stores them with the record end as line
separator: attempts commit through its output committer, and a lost executor's files are
written again. ``read_records`` reads archives (gzip or plain) back by Content-Length.
``assemble`` joins the records of a capture through their concurrent-to identifiers and
emits one nested row per capture.

Scale: equal payloads are found by an aggregate of (digest, length); one digest with a
third of all pages is one row per task there, and the join back to the slim page rows is a
plain equi-join that adaptive execution can split. The assembly shuffles record headers,
not payloads. A capture nests its first request and first metadata record (by record id)
and the counts of all; nothing unbounded is collected into one row. An archive file is
read by one task, so its bytes are bounded: pages are written by classes of payload size,
each with so few records a file that ARCHIVE_BYTES of payload are not passed (a payload
that is larger alone has a file of its own). Only classes that occur are written. Archives
from elsewhere are read one file to a row, so each has to be under 2 GB.

Defined results. Null payload: empty payload. Very long payload: whole. Further columns of
`pages` are not looked at, whatever their names. Null url: no target header. Null page id:
read back as null. Payloads of fewer than `min_bytes` bytes are never deduplicated. Of
equal payloads the row with the largest page id is the response, ties by record id; rows
that repeat in full are one record, written each time, and counted in n_copies. Records
whose target does not exist: no capture (``orphans`` lists them); pointers through other
records are followed; a cycle of pointers leads to no capture. Empty table: no archives,
empty result. A truncated archive raises.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 64 << 20  # payload bytes of an archive, unless one payload is larger
CLASS_BYTES, CLASS_STEP, CLASSES = 16 << 10, 4, 7  # payload sizes: to 16 KB, to 64 KB, ... to 16 MB, beyond
CRLF = "\r\n"

# The digits of conv() in base 32, and the standard base32 alphabet.
CONV32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("target_uri", T.StringType()), T.StructField("concurrent_to", T.ArrayType(T.StringType())),
    T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("fields", T.StringType()),
    T.StructField("payload", T.StringType())])


def base32(sha1_hex: Column) -> Column:
    """The 32 base32 characters of a SHA-1 given as 40 hexadecimal digits."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def _urn(kind: str, *cols: Column) -> Column:
    """A stable record id from what identifies the record."""
    x = F.md5(F.concat_ws("\n", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("-")) for c in cols]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(x, 1, 8), F.substring(x, 9, 4), F.substring(x, 13, 4),
                                                     F.substring(x, 17, 4), F.substring(x, 21, 12)), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    """One header line, or null (which concat_ws skips) without a value."""
    return F.concat(F.lit(f"{name}: "), F.translate(value.cast("string"), CRLF, ""))


def _record(kind: str, headers: list[Column], block: Column) -> Column:
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), *headers,
                       _header("Content-Length", F.octet_length(block)))
    return F.concat(head, F.lit(CRLF * 2), block)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
          min_bytes: int = 0, date: str = DATE, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write archives (gzip) of `pages` below `path`: three records per row, at most
    `archive_bytes` of payload in an archive unless one payload has more."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
                     F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    p = p.withColumns({"bytes": F.octet_length("payload"), "digest": base32(F.sha1(F.col("payload").cast("binary")))})
    p = p.withColumn("rid", _urn("response", F.col("page_id"), F.col("url"), F.col("digest")))
    present = {x.size_class for x in pages.select(size_class(F.octet_length(payload)).alias("size_class")).distinct().collect()}
    owners = (p.filter(F.col("bytes") >= min_bytes).groupBy(F.col("digest").alias("o_digest"), F.col("bytes").alias("o_bytes"))
              .agg(F.max(F.struct("page_id", "rid")).alias("owner"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1").select("o_digest", "o_bytes", F.col("owner.rid").alias("owner")))
    owners = common.stage(owners, "owners")
    p = p.join(common.bounded(owners), (F.col("digest") == F.col("o_digest")) & (F.col("bytes") == F.col("o_bytes")), "left")
    revisit = F.col("owner").isNotNull() & (F.col("owner") != F.col("rid"))

    uri, when = _header("WARC-Target-URI", F.col("url")), _header("WARC-Date", F.lit(date))
    rid, digest = F.col("rid"), F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF * 2))
    common_headers = [_header("WARC-Record-ID", rid), when, uri, _header("WARC-Payload-Digest", digest),
                      F.lit("Content-Type: application/http; msgtype=response")]
    capture = F.when(revisit, _record("revisit", [*common_headers, F.lit(f"WARC-Profile: {PROFILE}"),
                                                  _header("WARC-Refers-To", F.col("owner"))], http)) \
        .otherwise(_record("response", common_headers, F.concat(http, F.col("payload"))))
    request = _record("request", [
        _header("WARC-Record-ID", _urn("request", rid)), when, uri, _header("WARC-Concurrent-To", rid),
        F.lit("Content-Type: application/http; msgtype=request")], F.lit(f"GET / HTTP/1.1{CRLF * 2}"))
    metadata = _record("metadata", [
        _header("WARC-Record-ID", _urn("metadata", rid)), when, uri, _header("WARC-Concurrent-To", rid),
        F.lit("Content-Type: application/warc-fields")],
        F.concat_ws("", _header("page-id", F.col("page_id")), F.lit(CRLF)))
    for k in sorted(present or {0}):
        lines = p.filter(size_class(F.col("bytes")) == k).select(F.explode(F.array(request, capture, metadata)).alias("value"))
        (lines.write.option("lineSep", CRLF * 2).option("compression", "gzip")
         .option("maxRecordsPerFile", records_per_file(k, archive_bytes)).text(f"{path}/size-{k}"))


def size_class(n: Column) -> Column:
    """The class of a payload of n bytes: class k holds those up to CLASS_BYTES * CLASS_STEP ** k,
    the last class the rest; null bytes count as none."""
    out = F.lit(CLASSES - 1)
    for k in range(CLASSES - 2, -1, -1):
        out = F.when(F.coalesce(n, F.lit(0)) <= CLASS_BYTES * CLASS_STEP ** k, k).otherwise(out)
    return out


def records_per_file(k: int, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """How many records an archive of a size class may hold: three a page."""
    largest = CLASS_BYTES * CLASS_STEP ** k
    return 3 if k == CLASSES - 1 else 3 * max(1, archive_bytes // largest)


def parse(stream) -> list[tuple]:
    """The records of one open archive, without end check beyond their lengths."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, list[str]] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError("archive ends inside a header")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(head["content-length"][0])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("archive ends inside a record")
        yield head, block


def _row(head: dict[str, list[str]], block: bytes, keep_payload: bool) -> tuple:
    one = lambda k: head.get(k, [None])[0]
    kind, payload, n, fields = one("warc-type"), None, None, None
    digest = one("warc-payload-digest")
    if "msgtype=response" in (one("content-type") or "") or kind in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        if kind == "revisit":  # the block holds the headers alone; they tell the full payload's length
            n = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            payload = None
        else:
            n = len(payload)
            own = "sha1:" + _b32(hashlib.sha1(payload).digest())
            if digest not in (None, own):
                raise ValueError(f"payload digest of {one('warc-record-id')} does not match")
            digest = own
    elif kind == "metadata":
        fields = block.decode("utf-8", "replace")
    text = payload.decode("utf-8", "replace") if keep_payload and payload is not None else None
    return (one("warc-record-id"), kind, one("warc-target-uri"), head.get("warc-concurrent-to", []), one("warc-refers-to"),
            digest.removeprefix("sha1:") if digest else None, n, fields, text)


def _b32(raw: bytes) -> str:
    import base64
    return base64.b32encode(raw).decode()


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives below `path` (columns as RECORD). With `payload` false
    the payload column is null; digest and length are always those of the full payload."""
    common.ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    # the session's own names for the types, so that both sides agree on them
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()),
                        ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("fields", pa.string()), ("payload", pa.string())])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_py())
                gz = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if gz else raw
                rows, held = [], 0
                for head, block in parse(stream):
                    rows.append(_row(head, block, payload))
                    held += len(block) if payload else 0
                    if len(rows) >= 2000 or held > common.SLICE_BYTES:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)

    return files.mapInArrow(run, RECORD)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


CAPTURES = ["response", "revisit", "resource", "conversion", "continuation"]


def links(records: DataFrame) -> DataFrame:
    """(satellite, capture): which capture each request or metadata record belongs to, by
    concurrent-to pointers of either side, followed through other records.

    Pointers between satellites are shortened by doubling, so a chain of length n takes
    log2 n rounds; a round that finds nothing to shorten ends it, and pointers that
    outlast log2 of their number are cycles and lead nowhere.
    """
    ids = records.select("record_id", F.col("type").isin(*CAPTURES).alias("is_capture")).distinct()
    edges = records.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b"),
                           F.col("type").isin(*CAPTURES).alias("a_cap"))
    edges = edges.join(ids.select(F.col("record_id").alias("b"), F.col("is_capture").alias("b_cap")), "b").distinct()
    direct = edges.filter("a_cap <> b_cap").select(
        F.expr("CASE WHEN a_cap THEN b ELSE a END").alias("satellite"), F.expr("CASE WHEN a_cap THEN a ELSE b END").alias("capture"))
    hops = common.stage(edges.filter("NOT a_cap AND NOT b_cap").select("a", "b"), "hops")
    n = hops.count()
    if n == 0:
        return direct.distinct()
    direct = common.stage(direct.distinct(), "direct")
    reach = hops
    for _ in range(n.bit_length()):
        longer = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        grown = common.stage(reach.union(longer).distinct(), "reach")
        done = grown.count() == reach.count()
        reach = grown
        if done:
            break
    far = reach.join(direct.select(F.col("satellite").alias("b"), "capture"), "b").select(F.col("a").alias("satellite"), "capture")
    return direct.union(far).distinct()


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture (its record), n_copies (times the record is
    stored), request and metadata (the first by record id, null without one), n_requests,
    n_metadata. `records` should be a written frame: it is read more than once."""
    whole = F.struct(*[F.col(c) for c in RECORD.fieldNames()])
    caps = records.filter(F.col("type").isin(*CAPTURES)).groupBy(F.col("record_id").alias("rid")).agg(
        F.first(whole).alias("capture"), F.count(F.lit(1)).alias("n_copies"))
    sats = records.filter(~F.col("type").isin(*CAPTURES)).select("record_id", "type", "target_uri", "fields")
    own = sats.join(links(records).withColumnsRenamed({"satellite": "record_id", "capture": "rid"}), "record_id")
    part = lambda kind: F.min(F.when(F.col("type") == kind, F.struct("record_id", "target_uri", "fields")))
    count = lambda kind: F.count(F.when(F.col("type") == kind, 1))
    own = own.distinct().groupBy("rid").agg(part("request").alias("request"), part("metadata").alias("metadata"),
                                            count("request").alias("n_requests"), count("metadata").alias("n_metadata"))
    return caps.join(own, "rid", "left").withColumns({
        "n_requests": F.coalesce("n_requests", F.lit(0)), "n_metadata": F.coalesce("n_metadata", F.lit(0))}).drop("rid")


def orphans(records: DataFrame) -> DataFrame:
    """Requests and metadata records that lead to no capture."""
    return records.filter(~F.col("type").isin(*CAPTURES)).join(
        links(records).select(F.col("satellite").alias("record_id")), "record_id", "left_anti")


def page_id_of(metadata: Column, kind: str = "bigint") -> Column:
    """The page id a metadata record tells, null without one."""
    found = F.regexp_extract(metadata["fields"], r"(?:^|\n)page-id: ([^\r\n]*)", 1)
    return F.nullif(found, F.lit("")).cast(kind)


def round_trip(pages: DataFrame, path: str, page_id: str = "page_id", **kw) -> DataFrame:
    """Write `pages` to archives below `path`, read them back, assemble the captures, and
    return per page: page_id, payload_bytes, payload_digest, record_type, refers_to (the
    page id of the response a revisit refers to). One row per row of `pages`."""
    spark = pages.sparkSession
    kind = pages.schema[page_id].dataType.simpleString()
    write(pages, path, page_id, **kw)
    records = common.stage(read_records(spark, path, payload=False).drop("payload").withColumn(
        "payload", F.lit(None).cast("string")), "records")
    caps = assemble(records).select(
        page_id_of(F.col("metadata"), kind).alias("page_id"), "capture", "n_copies")
    caps = common.stage(caps.select("page_id", "capture.record_id", "capture.type", "capture.payload_bytes",
                                    "capture.payload_digest", "capture.refers_to", "n_copies"), "captures")
    answers = caps.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("response_page"))
    out = caps.filter("type = 'revisit'").join(answers, "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("response_page").alias("refers_to"), "n_copies")
    out = out.unionByName(caps.filter("type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.lit(None).cast(kind).alias("refers_to"), "n_copies"))
    return out.withColumn("n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int")))).drop("n_copies")
