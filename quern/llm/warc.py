"""WARC archives: records are written through Spark's text sink, read back and assembled into captures.

Writing: each page gives a request, a response (or revisit) and a metadata
record; request and metadata name the response's record id in
WARC-Concurrent-To. Of pages with equal payloads of at least REVISIT_BYTES
bytes, those with the largest id carry the payload and the others are
revisit records that refer to it. Each record is a gzip member of its own, and an
empty member with a comment (``MARK``) ends a page. The sink is Spark's text sink with
the mark as its line end, so archives are written by Spark's own committer to any store
that Spark can write, and a lost executor leaves no half-written file.

Reading: archives written here are cut at the marks by Spark's text source
(``read_archives``): tasks take byte ranges of a file of any size, and what one of them
holds is a page. Archives of others are read a file at a time (``read_records``). Both
are decompressed piece by piece and cut into records by Content-Length, so a payload may
hold anything, a record header included. The records of a capture are joined through their concurrent-to ids,
one nested row a capture: in one step for archives written here (``captures``), over
chains of any length and direction for any archive (``assemble``).

Results for odd input: a null html is an empty payload; a null page id is a
capture of its own with a null id, however often it occurs; rows with an id that
agree in id, URL and payload are one capture, or with ``each`` (as in the registered
query) as many as there are rows, all others are several; an empty
table gives an empty table; further columns are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import BROADCAST_IDS, SLICE, joined, scratch, ship, sized, written
from quern.llm.near_dedup import components

#: Payloads shorter than this are never written as revisits.
REVISIT_BYTES = 1000

#: Pages in an archive, at most. Archives written here are read by byte ranges, so their size bounds nothing.
ARCHIVE_PAGES = 5_000

#: The end of a page: a gzip member without content, told from all others by its comment.
MARK = b"\x1f\x8b\x08\x10\x00\x00\x00\x00\x00\xffend of capture\x00\x03\x00" + bytes(8)

#: Options of the text sink and source that end and cut lines at the mark, byte for byte.
LINES = {"lineSep": MARK.decode("latin-1"), "encoding": "ISO-8859-1"}

#: Equal rows that one row of the dealing stands for.
BLOCK_ROWS = 1_000

#: Bytes of blocks handed back at a time.
BATCH_BYTES = 24 << 20

#: Bytes decompressed at a time, at most and at the beginning of a gzip member (what follows a member is copied).
PIECE = 1 << 18
FIRST_PIECE = 1 << 12

# Record versions and the profile of a revisit with an identical payload.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
CONCURRENT = "warc-concurrent-to"

RECORD = "type string, record_id string, target_uri string, date string, concurrent_to string, refers_to string, block_digest string, payload_digest string, block_bytes long, payload_bytes long, page_id long, payload binary, http_head string, fields string, concurrent_all array<string>"


def _url(column: Column) -> Column:
    """Header values hold no line breaks."""
    return F.regexp_replace(F.coalesce(column, F.lit("urn:unknown")), r"[\r\n]+", " ")


def _header(kind: str, record_id: Column, pairs: list[tuple[str, Column]], length: Column) -> Column:
    lines = [F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">"))]
    lines += [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in pairs]
    return F.concat_ws(CRLF, *lines, F.concat(F.lit("Content-Length: "), length.cast("string")), F.lit(CRLF))


def _roles(thin: DataFrame) -> DataFrame:
    """(row id, refers-to row id) of the revisits. Only ids and digests are shuffled."""
    large = thin.where(F.col("__bytes") >= REVISIT_BYTES).select("__row", "__page", "__digest")
    first = large.groupBy("__digest").agg(F.max(F.struct(F.col("__page"), F.col("__row"))).alias("top"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select(F.xxhash64("__digest").alias("__hash"), F.col("__digest").alias("__same"), F.col("top.__row").alias("__target"), F.col("top.__page").alias("__top"))
    other = (F.col("__row") != F.col("__target")) & (F.col("__page").isNull() | (F.col("__page") != F.col("__top")))
    # one payload may be that of a third of all pages
    both = joined(large.withColumn("__hash", F.xxhash64("__digest")), first, "__hash").where("__digest = __same")
    return both.where(other).select(F.col("__row").alias("__of"), "__target")


def _occurrences(rows: DataFrame, repeated: DataFrame, each: bool) -> DataFrame:
    """Equal rows, each with an id of its own; unless ``each``, equal rows with a page id once. Only repeated rows are shuffled, many copies in blocks."""
    marked = rows.join(sized(repeated), "__row", "left")
    again = marked.where("__n is not null").dropDuplicates(["__row"])
    times = F.when(F.col("__page").isNull() | F.lit(each), F.col("__n")).otherwise(F.lit(1).cast("long"))
    again = again.withColumn("__times", times)
    again = again.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__times - 1) div {BLOCK_ROWS}"))))
    again = again.repartition("__row", "__block")
    again = again.withColumn("__k", F.explode(F.expr(f"sequence(__block * {BLOCK_ROWS} + 1, least(__times, (__block + 1) * {BLOCK_ROWS}))")))
    again = again.withColumn("__row", F.concat_ws(":", "__row", F.col("__k").cast("string")))
    return marked.where("__n is null").select(*rows.columns).unionByName(again.select(*rows.columns))


def records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2026-01-01T00:00:00Z", each: bool = False
) -> DataFrame:
    """(request, response, metadata): one row a page, the bytes of its request, response or revisit, and metadata record.

    ``each``: rows that agree in page id, URL and html are a capture each; else they are one.
    """
    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b"").cast("binary"))
    page = F.col(id_col).cast("long")
    own = pages.select(
        page.alias("__page"),
        _url(F.col(url_col)).alias("__url"),
        html.alias("__html"),
        F.sha1(html).alias("__digest"),
        F.octet_length(html).cast("long").alias("__bytes"),
    ).withColumn("__row", F.concat_ws(":", F.lit("urn:capture"), F.coalesce(F.col("__page").cast("string"), F.lit("none")), F.substring("__digest", 1, 16), F.substring(F.sha1(F.col("__url").cast("binary")), 1, 16)))
    thin = written(own.select("__row", "__page", "__digest", "__bytes"), "captures")
    repeated = written(thin.groupBy("__row").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), "repeated")
    if repeated.limit(1).count():
        own, thin = _occurrences(own, repeated, each), _occurrences(thin, repeated, each)
    roles = written(_roles(thin), "roles")
    small = roles.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = own.join(F.broadcast(roles) if small else roles, F.col("__row") == F.col("__of"), "left")
    uri = ("WARC-Target-URI", F.col("__url"))
    when = ("WARC-Date", F.lit(date))
    page_no = ("X-Page-ID", F.col("__page").cast("string"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("__digest")))
    bracketed = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    together = ("WARC-Concurrent-To", bracketed(F.col("__row")))
    head = F.concat_ws(
        CRLF,
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.col("__bytes").cast("string")),
        F.lit(CRLF),
    )
    ask = F.concat(F.lit("GET "), F.col("__url"), F.lit(" HTTP/1.1" + CRLF + CRLF))
    note = F.concat(F.lit("payloadLength: "), F.col("__bytes").cast("string"), F.lit(CRLF))
    http = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = F.concat(
        _header("response", F.col("__row"), [when, uri, digest, http, page_no], F.octet_length(head) + F.col("__bytes")),
        head,
        F.col("__html").cast("string"),
    )
    revisit = F.concat(
        _header(
            "revisit",
            F.col("__row"),
            [when, uri, digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", bracketed(F.col("__target"))), http, page_no],
            F.octet_length(head),
        ),
        head,
    )
    request = F.concat(
        _header(
            "request",
            F.concat(F.col("__row"), F.lit(":request")),
            [when, uri, together, ("Content-Type", F.lit("application/http; msgtype=request")), page_no],
            F.octet_length(ask),
        ),
        ask,
    )
    metadata = F.concat(
        _header(
            "metadata",
            F.concat(F.col("__row"), F.lit(":metadata")),
            [when, uri, together, ("Content-Type", F.lit("application/warc-fields")), page_no],
            F.octet_length(note),
        ),
        note,
    )
    body = F.when(F.col("__of").isNull(), response).otherwise(revisit)
    ended = lambda c, name: F.concat(c, F.lit(CRLF + CRLF)).cast("binary").alias(name)
    return rows.select(ended(request, "request"), ended(body, "response"), ended(metadata, "metadata"))


def member(record: bytes) -> bytes:
    """The record as one gzip member; as several where a stored block would hold the mark."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = deflate.compress(record) + deflate.flush()
    if MARK not in out:
        return out
    at = record.find(MARK)
    cut = at + len(MARK) // 2 if at >= 0 else len(record) // 2
    return member(record[:cut]) + member(record[cut:])


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Writes gzip archives below ``path``: a member a record, a mark after each page."""
    schema = pa.schema([("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                kinds = [c.to_pylist() for c in batch.slice(i, SLICE).columns]
                rows = [b"".join(map(member, of_page)) for of_page in zip(*kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], schema=schema)

    ship(pages.sparkSession)
    packed = records(pages, **columns).mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    packed.write.options(**LINES).option("maxRecordsPerFile", ARCHIVE_PAGES).text(path)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (headers, block) of the records of an archive, plain or gzip (of one or many members), piece by piece."""
    buffer = bytearray()
    pieces = _plain(data)
    more = True
    while True:
        while more and b"\r\n\r\n" not in buffer:
            piece = next(pieces, None)
            more = piece is not None
            buffer += piece or b""
        while buffer[:2] == b"\r\n":
            del buffer[:2]
        if not buffer:
            if not more:
                return
            continue
        m = _HEAD.match(buffer)
        if not m:
            if more:
                piece = next(pieces, None)
                more = piece is not None
                buffer += piece or b""
                continue
            raise ValueError("not a WARC record")
        headers = {}
        for line in m[1].decode("utf-8", "replace").split(CRLF)[:-1]:
            key, _, value = line.partition(":")
            key, value = key.strip().lower(), value.strip()
            # the one header that may be repeated: its ids hold no blanks
            headers[key] = f"{headers[key]} {value}" if key == CONCURRENT and key in headers else value
        begin, size = m.end(), int(headers["content-length"])
        while more and len(buffer) < begin + size:
            piece = next(pieces, None)
            more = piece is not None
            buffer += piece or b""
        if len(buffer) < begin + size:
            raise ValueError("an archive ends within a record")
        block = bytes(buffer[begin : begin + size])
        del buffer[: begin + size]
        yield headers, block


def _plain(data: bytes) -> Iterator[bytes]:
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(view), PIECE):
            yield bytes(view[at : at + PIECE])
        return
    at, size = 0, FIRST_PIECE
    inflate = zlib.decompressobj(31)
    while at < len(view):
        piece = view[at : at + min(size, PIECE)]
        yield inflate.decompress(piece)
        at += len(piece) - len(inflate.unused_data)
        size = min(2 * size, PIECE)
        if inflate.eof:
            inflate, size = zlib.decompressobj(31), FIRST_PIECE


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record of archives that ``write_archives`` made: files of any size, by byte ranges, a page at a time. ``payloads`` as below."""
    pages = spark.read.options(**LINES).text(path).select(F.col("value").cast("binary").alias("content"))
    return _records_of(pages, payloads)


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record of any archives, a file (2 GB at most) at a time.

    Without ``payloads`` the bytes stay in the task; lengths and digests are taken all the same.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path).select("content")
    return _records_of(files, payloads)


def _records_of(contents: DataFrame, payloads: bool) -> DataFrame:
    """One row a record of ``contents`` (content): whole archives or whole members of one."""
    fields = [("type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string())]
    fields += [("concurrent_to", pa.string()), ("refers_to", pa.string()), ("block_digest", pa.string()), ("payload_digest", pa.string())]
    fields += [("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("page_id", pa.int64()), ("payload", pa.binary())]
    fields += [("http_head", pa.string()), ("fields", pa.string()), ("concurrent_all", pa.list_(pa.string()))]
    schema = pa.schema(fields)

    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind = headers.get("warc-type", "")
        head, payload, note = None, None, None
        digest = headers.get("warc-payload-digest")
        if headers.get("content-type", "").startswith("application/http"):
            first, cut, rest = block.partition(b"\r\n\r\n")
            head = first.decode("utf-8", "replace")
            payload = rest if cut and kind == "response" else None
        elif kind in ("metadata", "warcinfo"):
            note = block.decode("utf-8", "replace")
        else:
            payload = block
        if payload is not None:
            digest = "sha1:" + hashlib.sha1(payload).hexdigest()
        page = headers.get("x-page-id")
        bare = lambda k: headers[k].strip("<>") if k in headers else None
        together = [x.strip("<>") for x in headers.get(CONCURRENT, "").split()]
        return (
            kind,
            bare("warc-record-id"),
            headers.get("warc-target-uri"),
            headers.get("warc-date"),
            together[0] if together else None,
            bare("warc-refers-to"),
            headers.get("warc-block-digest"),
            digest.rpartition(":")[2].lower() if digest else None,
            len(block),
            None if payload is None else len(payload),
            int(page) if page else None,
            payload if payloads else None,
            head,
            note,
            together,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                for headers, block in parse(batch.column(0)[i].as_py()):
                    rows.append(row(headers, block))
                    size += len(block) if payloads else 0
                    if len(rows) >= 2000 or size > BATCH_BYTES:
                        yield out(rows)
                        rows, size = [], 0
            if rows:
                yield out(rows)

    ship(contents.sparkSession)
    return contents.mapInArrow(run, RECORD)


def captures(found: DataFrame) -> DataFrame:
    """One nested row a capture: (capture_id, page_id, response, request, metadata), through the concurrent-to ids.

    For archives as ``write_archives`` makes them: each request and metadata record
    names its response. ``assemble`` takes any.
    """
    key = F.coalesce("concurrent_to", "record_id")
    whole = F.struct(*[c for c in found.columns])
    pick = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), whole))
    return (
        found.where(F.col("type") != "warcinfo")
        .groupBy(key.alias("capture_id"))
        .agg(
            F.max("page_id").alias("page_id"),
            pick("response", "revisit", "resource").alias("response"),
            pick("request").alias("request"),
            pick("metadata").alias("metadata"),
        )
    )


#: Kinds of record by the column that they go to.
MAIN = ("response", "revisit", "resource")


def assemble(found: DataFrame) -> DataFrame:
    """One nested row a capture of any archive: (capture_id, part, page_id, response, request, metadata).

    Records belong together if their concurrent-to ids lead from one to the other, over
    any number of records, in either direction, with several ids a record; a repeated
    record id is one record's. Ids that no record has lead nowhere. A capture with
    several records of a kind has a row, a ``part``, for each, so nothing is dropped and
    no group is collected. ``capture_id`` is the least record id of the responses, revisits
    and resources, or of all records if there are none. Records without an id are captures of their own.
    """
    held = written(found.where(F.col("type") != "warcinfo").withColumn("__no", F.monotonically_increasing_id()), "records")
    ids = held.where("record_id is not null").groupBy("record_id").agg(F.min("__no").alias("b"))
    named = held.select(F.col("__no").alias("a"), F.explode(F.array_append("concurrent_all", F.col("record_id"))).alias("record_id"))
    links = written(named.join(ids, "record_id").select("a", "b"), "together")
    labels = components(links, links.count())
    rows = held.join(labels, held["__no"] == labels["id"], "left").drop("id").withColumn("__capture", F.coalesce("label", "__no")).drop("label")
    kind = F.when(F.col("type").isin(*MAIN), "response").when(F.col("type") == "request", "request").otherwise("metadata")
    order = Window.partitionBy("__capture", "__kind").orderBy(F.col("record_id").asc_nulls_last(), "__no")
    rows = rows.withColumn("__kind", kind).withColumn("part", F.row_number().over(order) - 1)
    least = F.coalesce(F.min(F.when(F.col("__kind") == "response", F.col("record_id"))), F.min("record_id"))
    names = rows.groupBy("__capture").agg(least.alias("capture_id"), F.max("page_id").alias("page_id")).withColumnRenamed("__capture", "__of")
    whole = F.struct(*found.columns)
    pick = lambda k: F.max(F.when(F.col("__kind") == k, whole)).alias(k)
    nested = rows.groupBy("__capture", "part").agg(*[pick(k) for k in ("response", "request", "metadata")])
    out = nested.join(names, F.col("__capture") == F.col("__of"))
    return out.select("capture_id", "part", "page_id", "response", "request", "metadata")


def digest(pages: DataFrame, each: bool = False) -> DataFrame:
    """Writes the pages' archives to the shared folder, reads them back and returns one row a page; ``each`` as for ``records``."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_archives(pages, path, each=each)
    found = captures(read_archives(spark, path, payloads=False))
    length = F.regexp_extract("metadata.fields", r"payloadLength: (\d+)", 1).cast("long")
    revisit = F.col("response.type") == "revisit"
    target = F.when(revisit, F.expr("try_cast(split(response.refers_to, ':')[2] as long)"))
    return found.select(
        "page_id",
        F.when(revisit, length).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        target.alias("refers_to"),
        F.col("response.target_uri").alias("target_uri"),
        F.col("request.record_id").isNotNull().alias("has_request"),
    )
