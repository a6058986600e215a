"""WARC archives as a Spark data source: a committed writer and a splittable reader.

Writing: each record is a gzip member of its own. A task writes one file under a
temporary folder of the job; the driver's commit moves it, so a lost or repeated task leaves
nothing behind.

Reading: a task owns the byte range [start, end) of a file. It scans for the
gzip magic and takes a candidate as a member if decoding it gives a WARC header
and it is followed by CHAIN members like it, or by the end of the file: a
record that lies in a payload stored as it is, is followed by the rest of that
payload. From there on members are followed end to end. A task owns the records
whose member starts inside its range, and reads past the end to finish the
last one; what follows a member and is none fails the read.

A candidate may still be refused or taken wrongly: before damage, or where a
payload holds a long archive. So a task that has ended also looks for the member
where the next range will begin, as the next task does, and fails if that is not
where its own members led. The first range begins with the file; so either every
range begins where the one before it ended, or the read fails: no record is lost
or read twice without an error, whatever the splits.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quern.llm._spark import new_path, read, small_batches

SPLIT_BYTES = 32 << 20
#: Payloads below this many bytes are stored however often they occur.
REVISIT_BYTES = 1000

MAGIC = b"\x1f\x8b\x08"
_BUFFER = 1 << 16
#: Members that must follow a candidate where a split begins.
CHAIN = 8
#: Rows and bytes of payload that the reader hands over at once.
_BATCH_ROWS, _BATCH_BYTES = 500, 8 << 20
SCHEMA = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (file, hdfs, s3, ...) and the path on it."""
    found, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return found, inner.rstrip("/")


def _page_urn(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url}|{digest}')}>"


def member(row: dict, date: str, level: int) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header alone, with the length of the full payload."""
    revisit, payload = row["record_type"] == "revisit", row["payload"] or b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    if not revisit:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_page_urn(row['page_id'], row['url'], row['payload_digest'])}", f"WARC-Date: {date}"]
    if row["url"] is not None:
        safe = re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", row["url"])
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['payload_digest'])).decode()}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_page_urn(row['refers_to'], None, '')}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


class Member:
    """The bytes of a gzip member, inflated as they are asked for. zlib.error if it isn't one, EOFError if the file ends first."""

    def __init__(self, file, start: int):
        self.file, self.start, self.at = file, start, start
        self.stream, self.held = zlib.decompressobj(31), b""

    def more(self) -> bytes:
        """The next inflated bytes; none at the end of the member."""
        while not self.stream.eof:
            rest = self.stream.unconsumed_tail or self.file.read_at(_BUFFER, self.at)
            if not rest:
                raise EOFError(f"the file ends within the member at {self.start}")
            if not self.stream.unconsumed_tail:
                self.at += len(rest)
            if found := self.stream.decompress(rest, 16 * _BUFFER):
                return found
        return b""

    def through(self, what: bytes) -> bytes | None:
        """The bytes up to and with a mark, which are used up; None if the member ends first."""
        seen = 0
        while (i := self.held.find(what, max(0, seen - len(what)))) < 0:
            seen = len(self.held)
            if not (found := self.more()):
                return None
            self.held += found
        out, self.held = self.held[: i + len(what)], self.held[i + len(what) :]
        return out

    def take(self, n: int) -> bytes:
        """So many bytes, which are used up; fewer at the end."""
        parts, size = [self.held], len(self.held)
        while size < n and (found := self.more()):
            parts.append(found)
            size += len(found)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def end(self) -> int:
        """The offset past the member, all of which is inflated."""
        while self.more():
            pass
        return self.at - len(self.stream.unused_data)


def records(member: Member, where: str) -> Iterator[dict]:
    """The records of a member, one at a time; those of a type that is neither response nor revisit are passed over."""
    while True:
        while (blank := member.take(2)) == b"\r\n":
            pass
        if not blank:
            return
        member.held = blank + member.held
        raw = member.through(b"\r\n\r\n")
        if raw is None or raw[:5] != b"WARC/":
            raise ValueError(f"{where}: no WARC header")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(head["content-length"])
        data = member.take(size)
        if len(data) < size:
            raise ValueError(f"{where}: a record is longer than its member")
        if head["warc-type"] not in ("response", "revisit"):
            continue
        cut = data.find(b"\r\n\r\n")
        cut = len(data) if cut < 0 else cut + 4
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", data[:cut])
        page = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("warc-record-id", ""))
        refers = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("warc-refers-to", ""))
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
        revisit = head["warc-type"] == "revisit"
        url = head.get("warc-target-uri")
        yield {
            "page_id": int(page[1]) if page else None,
            "url": None if url is None else re.sub(r"%([01][0-9A-F]|20|25|7F)", lambda m: chr(int(m[1], 16)), url),
            "record_type": head["warc-type"],
            "payload": None if revisit else data[cut:],
            "payload_bytes": int(length[1]) if length else len(data) - cut,
            "payload_digest": base64.b32decode(digest).hex() if digest else None,
            "refers_to": int(refers[1]) if refers else None,
        }


def is_member(file, at: int) -> bool:
    """Whether a gzip member that holds a WARC record starts here, whatever the length of its own header."""
    if file.read_at(len(MAGIC), at) != MAGIC:
        return False
    try:
        member = Member(file, at)
        found = b""
        while len(found) < 5 and (more := member.more()):
            found += more
        return found[:5] == b"WARC/"
    except (zlib.error, EOFError):
        return False


def is_followed(file, at: int, size: int) -> bool:
    """Whether a member starts here and CHAIN more follow it, or all that there are up to the end of the file."""
    for _ in range(CHAIN + 1):
        if at == size:
            return True
        if not is_member(file, at):
            return False
        try:
            at = Member(file, at).end()
        except (zlib.error, EOFError):
            return False
    return True


def next_member(file, at: int, end: int, trusted: bool = False) -> int | None:
    """The offset of the first member that starts in [at, end). trusted: without a look at what follows, as in damaged files."""
    size = file.size()
    while at < end:
        data = file.read_at(min(1 << 20, end - at) + len(MAGIC) - 1, at)
        if len(data) < len(MAGIC):
            return None
        i = data.find(MAGIC)
        while i >= 0:
            if at + i < end and (is_member(file, at + i) if trusted else is_followed(file, at + i, size)):
                return at + i
            i = data.find(MAGIC, i + 1)
        at += len(data) - len(MAGIC) + 1
    return None


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split, self.skip = options["path"], int(options.get("splitbytes", SPLIT_BYTES)), options.get("damaged", "fail") == "skip"

    def partitions(self) -> list[Range]:
        files, top = open_path(self.path)
        info = files.get_file_info(top)
        infos = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(top, recursive=True))
        found = [i for i in infos if i.type == fs.FileType.File and not re.search(r"/[._][^/]*(/|$)", i.path.removeprefix(top))]
        return [Range(i.path, at, min(at + self.split, i.size)) for i in sorted(found, key=lambda i: i.path) for at in range(0, i.size, self.split)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        files, _ = open_path(self.path)
        rows, held = [], 0
        with files.open_input_file(part.path) as file:
            # a file begins with a member; elsewhere one has to be found
            at = 0 if part.start == 0 and (not self.skip or is_member(file, 0)) else next_member(file, part.start, part.end, self.skip)
            began = at is not None
            while at is not None and at < part.end:
                member = Member(file, at)
                try:
                    for r in records(member, f"{part.path}, byte {at}"):
                        rows.append(r)
                        held += len(r["payload"] or b"")
                        if len(rows) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, ARROW)
                            rows, held = [], 0
                    after = member.end()
                    if after < part.end and not is_member(file, after):
                        raise ValueError(f"{part.path}, byte {after}: what follows a member is none")
                    at = after
                except (zlib.error, EOFError, ValueError, KeyError):
                    if not self.skip:
                        raise
                    at = next_member(file, at + 1, part.end, True)
            if began and not self.skip:
                self.hand_over(file, part, at)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def hand_over(self, file, part: Range, at: int) -> None:
        """Fails unless the ranges up to the one that holds `at`, where this range's members led, begin where they should."""
        size, start = file.size(), part.end
        while start < size:
            end = min(start + self.split, size)
            found = next_member(file, start, end)
            if found != (at if at < end else None):
                raise ValueError(f"{part.path}: members lead to byte {at}, but the range at {start} would begin at {found}: the file is damaged, or a payload holds an archive (read it with a larger splitBytes)")
            if at < end:
                return
            start = end


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.overwrite = overwrite
        self.path, self.date, self.level = options["path"], options.get("date", "2024-01-01T00:00:00Z"), int(options.get("level", 6))
        files, top = open_path(self.path)
        self.job = f"_temporary-{uuid.uuid4().hex}"  # of this job alone: others may write to the same path
        files.create_dir(f"{top}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, top = open_path(self.path)
        name, n = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
        with files.open_output_stream(f"{top}/{self.job}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(member(row, self.date, self.level))
                    n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, top = open_path(self.path)
        if self.overwrite:  # what was there goes only once all that takes its place is written
            for old in files.get_file_info(fs.FileSelector(top)):
                if old.type == fs.FileType.File:
                    files.delete_file(old.path)
        for m in messages:
            if m is not None and m.rows:
                files.move(f"{top}/{self.job}/{m.name}", f"{top}/{m.name}")
        files.delete_dir(f"{top}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        files, top = open_path(self.path)
        files.delete_dir(f"{top}/{self.job}")


class WarcSource(DataSource):
    """format("quern_warc"). Options: splitBytes and damaged (fail or skip) to read, date and level to write."""

    @classmethod
    def name(cls) -> str:
        return "quern_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """SCHEMA, one row per response or revisit record. payload is null in revisits; the digest is the header's, in hex."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("quern_warc").options(**options).load(path)


def write_warc(rows: DataFrame, path: str, mode: str = "append", **options) -> None:
    """rows: the columns of SCHEMA. The files appear in path once all tasks have ended, beside those there or (mode overwrite) in their place."""
    spark = rows.sparkSession
    small_batches(spark)
    spark.dataSource.register(WarcSource)
    kept = rows.select([F.col(f.split()[0]).cast(f.split()[1]) for f in SCHEMA.split(", ")])
    kept.write.format("quern_warc").mode(mode).options(**options).save(path)


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html → rows for write_warc.

    Of pages with equal payloads of at least so many bytes, the largest page_id
    is the response, and rows with smaller ids revisit it. Null html is an empty
    payload. Rows that repeat the largest id are all responses; rows with a null
    id are responses, and never referred to. Only ids and digests are shuffled
    to find the copies: counts and maxima are combined before the shuffle, and
    digests that occur once leave before the join.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.length("payload").cast("long"), "_key": F.sha2("payload", 256)})
    keys = rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "_key")
    first = keys.groupBy("_key").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_least")).where("_least < refers_to").drop("_least")
    later = keys.join(first, "_key").where("page_id < refers_to").distinct()
    return (
        rows.join(later, ["page_id", "_key"], "left")
        .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
        .withColumn("payload_digest", F.sha1("payload"))
        .withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
        .drop("_key")
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(revisits(read(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    back = read_warc(spark, path)
    stored = F.col("payload").isNotNull()
    return back.select(
        "page_id",
        F.when(stored, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP5_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
         k AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
                      CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS m FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN m > page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN m > page_id THEN m END AS refers_to FROM k"""
