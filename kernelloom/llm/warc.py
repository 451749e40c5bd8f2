"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Each record is a gzip member of its own.  The reader checks every member and record.  Where a check
fails, it searches for the next member that unpacks to a whole record (or, in a plain file, for the
next version line that starts one), goes on there, and reports the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelloom.llm.shared import Scratch, attempt_name, read_file, small_batches, write_file

GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/\d\.\d\r\n")
_PAGE = "urn:page:"


# -- a url on a header line: characters that a line can't keep, and their codes; the percent sign last --
_CODES = {"\n": "%0A", "\r": "%0D", " ": "%20", "\t": "%09", "%": "%25"}


def _line(url: str) -> str:
    text = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    core = text.strip(" \t")
    at = text.index(core) if core else len(text)
    blanks = lambda part: "".join(_CODES[c] for c in part)
    return blanks(text[:at]) + core + blanks(text[at + len(core) :])


def _url(line: str) -> str:
    for char, code in _CODES.items():
        line = line.replace(code, char)
    return line


# -- one record ------------------------------------------------------------------------------------


def record_bytes(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None, digest: str, payload_bytes: int) -> bytes:
    """A record as plain bytes.  A revisit has no block; the full payload's length and digest are in
    its header.  Line breaks within a url, and blanks at its ends, are percent-encoded."""
    name = lambda n: f"<{_PAGE}{'' if n is None else n}>"
    head = [
        VERSION.decode(), f"WARC-Type: {record_type}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_line(url or '')}", "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {payload_bytes}",
    ]
    block = payload if record_type == "response" else b""
    if record_type == "revisit":
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Finder:
    """The next place of a byte string at or after a given one, in a search that goes forward only: what was
    found is kept until it is passed, so all searches together read the data once."""

    def __init__(self, data: bytes):
        self.data, self.kept = data, {}

    def next(self, what: bytes, at: int) -> int:
        """The length of the data where there is none."""
        found = self.kept.get(what, -1)
        if found < at:
            found = self.data.find(what, at)
            self.kept[what] = found = found if found >= 0 else len(self.data)
        return found


def parse_record(data: bytes, at: int = 0, finder: Finder | None = None) -> tuple[dict, int]:
    """(record, end) of the plain record that starts at ``at``; ValueError if it isn't whole and sound."""
    if not _VERSION_LINE.match(data, at):
        raise ValueError("no version line")
    finder = finder or Finder(data)
    cut = finder.next(b"\r\n\r\n", at)
    if cut == len(data) or finder.next(b"\nWARC/", at + 1) < cut:
        raise ValueError("no end of the header")
    fields: dict[str, str] = {}
    for line in data[at:cut].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        fields[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "surrogateescape").strip(" \t")
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no length")
    end = cut + 4 + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("the block doesn't end where its length says")
    block = data[cut + 4 : end]
    kind, digest = fields.get("warc-type", ""), None
    if fields.get("warc-payload-digest", "").startswith("sha1:"):
        digest = base64.b32decode(fields["warc-payload-digest"][5:]).hex()
        if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
            raise ValueError("the payload doesn't have its digest")
    number = lambda v: int(v) if v else None
    named = lambda key: number(fields[key].strip("<>").removeprefix(_PAGE)) if _PAGE in fields.get(key, "") else None
    return {
        "record_type": kind, "page_id": named("warc-record-id"), "refers_to": named("warc-refers-to"), "url": _url(fields.get("warc-target-uri", "")),
        "payload_digest": digest, "payload_bytes": int(fields.get("x-payload-length") or len(block)), "payload": block,
    }, end + 4


def _packed(data: bytes, at: int, most: int) -> tuple[dict, int]:
    content, end = _member(data, at, most)
    record, used = parse_record(content)
    if used != len(content):
        raise ValueError("more than a record in the member")
    return record, end


#: A member that unpacks to more is taken for damaged.
MOST_UNPACKED = 1 << 30


def _member(data: bytes, at: int, most: int = MOST_UNPACKED, step: int = 1 << 16) -> tuple[bytes, int]:
    """(content, end) of the gzip member at ``at``; its own checksum and length are checked.  It is fed in
    steps, so that the rest of the file isn't copied for each member, and may unpack to ``most`` bytes."""
    reader, parts, here, size = zlib.decompressobj(31), [], at, 0
    try:
        while not reader.eof:
            if here >= len(data):
                raise ValueError("the member has no end")
            parts.append(reader.decompress(data[here : here + step], most - size + 1))
            here += step
            size += len(parts[-1])
            if size > most or reader.unconsumed_tail:
                raise ValueError(f"the member unpacks to more than {most} bytes")
    except zlib.error as e:
        raise ValueError(str(e)) from None
    return b"".join(parts), min(here, len(data)) - len(reader.unused_data)


def salvage(data: bytes, most: int = MOST_UNPACKED) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", start, end, record) and ("gap", start, end, reason) in order; together they cover
    all bytes of the file.  Searches go forward only, so damage costs no more than sound bytes."""
    at, bad, reason, finder = 0, None, "", Finder(data)
    while at < len(data):
        packed = data.startswith(GZIP, at)
        try:
            record, end = _packed(data, at, most) if packed else parse_record(data, at, finder)
        except ValueError as e:
            if bad is None:
                bad, reason = at, str(e)
            at = min(_next_line(data, at + 1, finder), finder.next(GZIP, at + 1))
            continue
        if bad is not None:
            yield "gap", bad, at, reason
            bad = None
        yield "record", at, end, record
        at = end
    if bad is not None:
        yield "gap", bad, len(data), reason


def _next_line(data: bytes, at: int, finder: Finder) -> int:
    while (at := finder.next(b"WARC/", at)) < len(data) and not _VERSION_LINE.match(data, at):
        at += 1
    return at


# -- tables ----------------------------------------------------------------------------------------


#: Payloads that recur, at about 100 bytes each, whose digests may be broadcast: 20 MB.
BROADCAST_DIGESTS = 200_000


def plan_records(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, broadcast: int = BROADCAST_DIGESTS) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of records with equal payloads of at least ``least`` bytes, that with the largest page_id is the
    response.  Rows that share that largest id are all responses, as are rows without an id.

    Digests that recur are found first, by a partial aggregate without payloads.  Up to ``broadcast`` of them
    go to the rows, so no payload is shuffled; beyond that the rows of large payloads go to them.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    top = rows.where(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    top = scratch.write(top.where("n > 1").drop("n"), "recurring")
    few = top.count() <= broadcast
    same = (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b"))
    if few:
        joined = rows.join(F.broadcast(top), same, "left")
    else:
        small = rows.where(F.col("payload_bytes") < least).withColumn("top", F.lit(None).cast("long"))
        joined = rows.where(F.col("payload_bytes") >= least).join(top, same, "left").drop("d", "b").unionByName(small)
    again = F.coalesce(F.col("page_id") < F.col("top"), F.lit(False))
    return joined.select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(again, F.col("top")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, limit: int = 32 << 20) -> DataFrame:
    """Write the planned records to ``folder`` as gzip archives of about ``limit`` bytes; returns the
    manifest (file, records, bytes), which is a Parquet table in ``folder`` as well.

    Each attempt of a task writes files of its own, and the manifest names those of the attempts that Spark
    committed, so a lost or repeated attempt neither loses nor doubles a record."""
    spark = records.sparkSession
    small_batches(spark)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, n, done = [], 0, 0, []

        def flush() -> None:
            nonlocal held, size, n
            if held:
                name = attempt_name("part", "warc.gz", len(done))
                write_file(f"{folder}/{name}", b"".join(held))
                done.append((name, n, size))
                held, size, n = [], 0, 0

        number = lambda v: None if pd.isna(v) else int(v)
        for part in parts:
            for r in part.itertuples(index=False):
                member = gzip_member(record_bytes(number(r.page_id), r.url, bytes(r.payload or b""), r.record_type, number(r.refers_to), r.payload_digest, int(r.payload_bytes)))
                held.append(member)
                size, n = size + len(member), n + 1
                if size >= limit:
                    flush()
        flush()
        yield pd.DataFrame(done, columns=["file", "records", "bytes"])

    records.mapInPandas(write, "file string, records long, bytes long").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


#: Tasks that read files at most; beyond that a task reads several, one after another.
MOST_TASKS = 10_000
RECORDS = "kind string, file string, start long, end long, reason string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Records and gaps of the archives that ``files`` (file) names in ``folder``: kind ("record" or "gap"),
    file, start, end, reason (of gaps), page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload.  Without files it gives no rows."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file in part["file"]:
                rows, size = [], 0
                for kind, start, end, what in salvage(read_file(f"{folder}/{file}")):
                    own = what if kind == "record" else {}
                    rows.append([kind, file, start, end, what if kind == "gap" else None, *[own.get(n) for n in names]])
                    size += len(own.get("payload") or b"")
                    if size > 8 << 20:
                        yield _frame(rows, names)
                        rows, size = [], 0
                yield _frame(rows, names)

    dealt = files.select("file").repartitionByRange(min(MOST_TASKS, max(1, files.count())), "file")
    return dealt.mapInPandas(read, RECORDS)


def _frame(rows: list[list], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "file", "start", "end", "reason", *names]).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: the reader's rows.

    A null html is an empty payload; a null url an empty one, which comes back empty.  Rows that share an id
    are records of one record id; repeated rows are records each, but revisits if a larger id has their
    payload.  Very long payloads are one record.  An empty table gives no rows.  Columns but the three named
    aren't read, whatever their names."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.folder("archives")
    return read_archives(write_archives(plan_records(pages, scratch, id_col, url_col, html_col), folder), folder)


def verified_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The records of ``archive_round_trip`` without payloads.  ValueError if the reader met a gap or the
    records aren't as many as the writer's manifest says; what was read stays then in the shared folder as
    a table, gaps with their files, places and reasons."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.folder("archives")
    files = write_archives(plan_records(pages, scratch, id_col, url_col, html_col), folder)
    return whole(scratch.write(read_archives(files, folder).drop("payload"), "read"), files)


def whole(read: DataFrame, files: DataFrame) -> DataFrame:
    """The records among the rows ``read`` back from ``files``; ValueError unless there are no gaps and all records."""
    written = files.agg(F.sum("records")).first()[0] or 0
    found = {r.kind: r.n for r in read.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if found.get("gap") or found.get("record", 0) != written:
        some = [f"{r.file} {r.start}-{r.end}: {r.reason}" for r in read.where("kind = 'gap'").limit(5).collect()]
        raise ValueError(f"{written} records were written, {found.get('record', 0)} read, with {found.get('gap', 0)} gaps: {some}")
    return read.where("kind = 'record'")
