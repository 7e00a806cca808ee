"""WARC archives of pages, and a two-level capture index over them.

Tasks write their pages as gzip members, one for each record, into archive files of the shared folder. Of records with
equal payloads one is the response, the others are revisits that name it. The captures' keys (host reversed, then path)
are sorted into shards; a shard's lines are compressed in blocks, and a sparse directory keeps the first key of each
block. A look-up finds its shard by the shards' first keys, the block by binary search in the shard's directory, reads
that range of the shard, and then the range of the archive that holds the record.

Files are written and read through Arrow's file systems by the URI of the shared folder (local, HDFS, S3, GCS), so
executors need no folder in common but that one. A task that runs again writes new files under another name; only
files that the stored capture table names are read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newstape.llm.url_filter import host_of, path_of
from newstape.session import shared_dir

#: Captures of a block and of a shard of the index, about.
BLOCK_LINES, SHARD_LINES = 512, 1 << 20
#: Payloads shorter than this are always stored as responses.
MIN_PAYLOAD = 0
#: Bytes after which a task goes on in another archive file.
ARCHIVE_BYTES = 1 << 30
CAPTURE = "page_id long, urlkey string, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a folder, and the folder's path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def url_key(url: Column) -> Column:
    """Host labels from the last to the first, then path and query; white space percent-encoded; null: empty."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    host = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    key = F.concat(host, F.lit(")"), path_of(url), query)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(key, " ", "%20"), "\n", "%0A"), "\t", "%09")


def with_record_types(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Adds payload, its SHA-1, and what the page refers to (null: a response)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = own.where(F.col("size") >= min_payload).groupBy("sha1", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    several = groups.where("n > 1").drop("n")
    joined = own.join(several, ["sha1", "size"], "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")))


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record. A revisit has the response's HTTP header, with the full payload's length, but no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode().strip().lower()] = value.decode().strip()
    return fields, rest[: int(fields["content-length"])]


def described(data: bytes) -> tuple:
    """What ``RECORD`` lists, of a record as it was read; a response's digest is computed from its payload."""
    fields, block = parse_record(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    page = fields["warc-record-id"][len("<urn:page:") : -1]
    kind, refers = fields["warc-type"], fields.get("warc-refers-to")
    if kind == "response":
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    else:
        sizes = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size, digest = int(sizes[0]), fields["warc-payload-digest"].removeprefix("sha1:")
    return None if page == "none" else int(page), size, digest, kind, int(refers[len("<urn:page:") : -1]) if refers else None


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch({name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)})


def write_archives(pages: DataFrame, folder: str, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) below ``folder``; returns the stored captures.

    Of rows with equal payloads of at least ``min_payload`` bytes, those with the largest page_id are responses, the
    others revisit it. A null html is an empty payload, a null url an empty key; rows without a page_id
    revisit a row that has one, if their payloads are equal. Repeated rows are repeated records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(f"{root}/archive", recursive=True)
        out, name, at = None, "", 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/archive/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                record = record_bytes(row["page_id"], row["url"], row["payload"], row["refers_to"])
                data = packer.compress(record) + packer.flush()
                out.write(data)
                rows.append((row["page_id"], row["urlkey"], name, at, len(data)))
                at += len(data)
            yield _columns(rows, CAPTURE)
        if out is not None:
            out.close()

    typed = with_record_types(pages, min_payload).withColumn("urlkey", url_key(F.col("url")))
    written = typed.select("page_id", "url", "payload", "refers_to", "urlkey").mapInArrow(run, CAPTURE)
    written.write.parquet(f"{folder}/captures")
    return pages.sparkSession.read.schema(CAPTURE).parquet(f"{folder}/captures")


def _line(row: dict) -> str:
    place = json.dumps({"file": row["file"], "offset": row["offset"], "length": row["length"]})
    return f"{row['urlkey']}\t{'' if row['page_id'] is None else row['page_id']}\t{place}\n"


def _order(urlkey: str, page_id: int | None) -> tuple:
    """The sort key of captures: as Spark sorts them, by bytes, nulls first."""
    return urlkey.encode(), page_id is not None, page_id or 0


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES, shard_lines: int = SHARD_LINES) -> list:
    """Writes the sorted shards and their directories; returns (first key, page_id, shard) of the shards, in order.

    A shard holds about ``shard_lines`` captures; their list is all that the driver keeps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        name, at, lines, directory, first = uuid.uuid4().hex, 0, [], [], None
        out = None

        def flush():
            nonlocal at
            data = zlib.compress("".join(lines).encode(), 6)
            out.write(data)
            directory.append((*first, at, len(data)))
            at += len(data)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(f"{root}/index", recursive=True)
                    out = system.open_output_stream(f"{root}/index/{name}.blocks", compression=None)
                if not lines:
                    first = (row["urlkey"], row["page_id"])
                lines.append(_line(row))
                if len(lines) == block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with system.open_output_stream(f"{root}/index/{name}.directory", compression=None) as file:
                file.write(json.dumps(directory).encode())
            yield _columns([(directory[0][0], directory[0][1], name)], "urlkey string, page_id long, shard string")

    shards = max(1, -(-captures.count() // shard_lines))
    dealt = captures.repartitionByRange(shards, "urlkey", "page_id").sortWithinPartitions("urlkey", "page_id")
    dealt.mapInArrow(run, "urlkey string, page_id long, shard string").write.parquet(f"{folder}/shards")
    found = captures.sparkSession.read.parquet(f"{folder}/shards").collect()
    return sorted(((r["urlkey"], r["page_id"], r["shard"]) for r in found), key=lambda r: _order(r[0], r[1]))


class _Shard:
    """A shard as a look-up sees it: the directory, and the block that was read last."""

    def __init__(self, system: pafs.FileSystem, root: str, name: str):
        with system.open_input_stream(f"{root}/index/{name}.directory", compression=None) as file:
            self.directory = json.loads(file.read())
        self.keys = [_order(k, p) for k, p, _, _ in self.directory]
        self.file = system.open_input_file(f"{root}/index/{name}.blocks")
        self.number, self.lines = -1, []

    def _read(self, number: int) -> None:
        if number != self.number:
            _, _, offset, length = self.directory[number]
            text = zlib.decompress(self.file.read_at(length, offset)).decode()
            rows = [line.split("\t") for line in text.split("\n")[:-1]]
            self.lines = [(_order(k, int(p) if p else None), place) for k, p, place in rows]
            self.number = number

    def find(self, urlkey: str, page_id: int | None) -> Iterator[dict]:
        wanted = _order(urlkey, page_id)
        number = max(0, bisect.bisect_left(self.keys, wanted) - 1)
        while number < len(self.keys) and self.keys[number] <= wanted:
            self._read(number)
            at = bisect.bisect_left(self.lines, (wanted, ""))
            while at < len(self.lines) and self.lines[at][0] == wanted:
                yield json.loads(self.lines[at][1])
                at += 1
            number += 1


def read_captures(wanted: DataFrame, folder: str, shards: list) -> DataFrame:
    """The records (``RECORD``) that the index has for the rows of ``wanted`` (urlkey, page_id), as read back.

    Every record of a key is returned, once however often it is asked for; unknown keys have no row.
    """
    spark = wanted.sparkSession
    firsts = spark.sparkContext.broadcast([_order(k, p) for k, p, _ in shards])
    names = spark.sparkContext.broadcast([name for _, _, name in shards])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                wanted_key = _order(row["urlkey"], row["page_id"])
                first = max(0, bisect.bisect_left(firsts.value, wanted_key) - 1)
                last = max(0, bisect.bisect_right(firsts.value, wanted_key) - 1)
                rows.extend((n, row["urlkey"], row["page_id"]) for n in range(first, last + 1))
            yield _columns(rows, "shard int, urlkey string, page_id long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        number, shard, archives = -1, None, {}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["shard"] != number:
                    number, shard = row["shard"], _Shard(system, root, names.value[row["shard"]])
                for found in shard.find(row["urlkey"], row["page_id"]):
                    if found["file"] not in archives:
                        if len(archives) >= 64:
                            archives.pop(next(iter(archives))).close()
                        archives[found["file"]] = system.open_input_file(f"{root}/archive/{found['file']}")
                    data = archives[found["file"]].read_at(found["length"], found["offset"])
                    rows.append(described(zlib.decompress(data, 31)))
            yield _columns(rows, RECORD)

    if not shards:
        return spark.createDataFrame([], RECORD)
    asked = wanted.select("urlkey", "page_id").distinct().mapInArrow(place, "shard int, urlkey string, page_id long")
    # As many ranges as the session asks for: merged by size, all small look-ups would be one task's.
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.repartitionByRange(ranges, "shard", "urlkey", "page_id").sortWithinPartitions("shard", "urlkey", "page_id")
    return dealt.mapInArrow(read, RECORD)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, indexed, looked up by its key and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = new_folder(spark, "warc")
    captures = write_archives(pages, folder)
    shards = write_index(captures, folder)
    return read_captures(pages.select("page_id", url_key(F.col("url")).alias("urlkey")), folder, shards)


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = " || ".join(
    f"'{_BASE32}'[1 + ((('0x' || substring(hex, {5 * j + 1}, 5))::bigint >> {shift}) & 31)]"
    for j in range(8)
    for shift in (15, 10, 5, 0)
)
OP5_SQL = f"""
with digests as (
  select page_id, octet_length(encode(coalesce(html, ''))) as size, sha1(coalesce(html, '')) as hex from pages),
firsts as (select *, max(page_id) over (partition by hex, size) as first from digests)
select page_id, cast(size as bigint) as payload_bytes, {_DIGITS} as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from firsts
"""
