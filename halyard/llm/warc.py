"""WARC archives: whole-file gzip streams, made seekable by a normaliser.

Pages are first written the way simple crawlers do, as files of one gzip stream
each.  The normaliser inflates such a file once, from front to end and in pieces
of bounded size, rewrites every record as a gzip member of its own, and writes a
sidecar index of offsets.  Any record is then read alone: seek, inflate one
member, parse.

Files are written below a folder that driver and executors share, under names no
other attempt uses; the list of finished files is a Parquet table, so what a lost
or repeated task left behind is in no list and is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import pick, slices, table
from halyard.session import cut, scratch

#: Inflated bytes after which a task starts its next file
FILE_BYTES = 64 << 20
#: Payloads of fewer bytes are never revisits
LEAST_PAYLOAD = 0
PIECE = 1 << 20
LEVEL = 4
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"
#: Digests of more than this share of all rows count as hot: at most 1,000 exist.
HOT_SHARE = 1000


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<{URN}{'none' if page_id is None else page_id}>"


def _id(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").removeprefix(URN)
    return int(name) if name.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of ``refers_to``, which has the payload's HTTP head alone."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url))
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + END + block + END


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


class Splitter:
    """Cuts a stream of bytes, fed in pieces, into whole records."""

    def __init__(self):
        self.left, self.need, self.seen = bytearray(), None, 0

    def feed(self, piece: bytes) -> Iterator[bytes]:
        self.left += piece
        while True:
            if self.need is None:
                at = self.left.find(END, self.seen)
                if at < 0:
                    self.seen = max(0, len(self.left) - 3)
                    return
                self.need = at + len(END) + int(_headers(bytes(self.left[:at]))["content-length"]) + len(END)
            if len(self.left) < self.need:
                return
            whole = bytes(self.left[: self.need])
            del self.left[: self.need]
            self.need, self.seen = None, 0
            yield whole

    def finish(self) -> None:
        if self.left:
            raise ValueError("the stream ends inside a record")


def parse(whole: bytes) -> dict:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload (None for revisits).

    A response whose payload does not match its digest or length is refused.
    """
    at = whole.index(END)
    head = _headers(whole[:at])
    start = at + len(END)
    block = whole[start : start + int(head["content-length"])]
    cut_at = block.index(END)
    size = int(_headers(block[:cut_at])["content-length"])
    named = head["warc-payload-digest"].removeprefix("sha1:")
    payload = None
    if head["warc-type"] == "response":
        payload = block[cut_at + len(END) :]
        if len(payload) != size or digest(payload) != named:
            raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    return {"page_id": _id(head["warc-record-id"]), "payload_bytes": size, "payload_digest": named, "record_type": head["warc-type"], "refers_to": _id(head.get("warc-refers-to")), "payload": payload}


def _open(folder: str):
    store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith(("/", "file:")) else "/" + folder)
    store.create_dir(path, recursive=True)
    return store, path


def inflated(store: fs.FileSystem, source: str) -> Iterator[bytes]:
    """The content of a file that is one gzip stream, in pieces of about PIECE bytes."""
    inflate = zlib.decompressobj(31)
    with store.open_input_stream(source, compression=None) as read:
        while piece := read.read(PIECE):
            while piece:
                yield inflate.decompress(piece, PIECE)
                piece = inflate.unconsumed_tail
    yield inflate.flush()
    if not inflate.eof:
        raise ValueError(f"{source} is cut short")


def normalise(store: fs.FileSystem, source: str, target: str) -> int:
    """Rewrites one whole-file gzip as a member per record, with the index ``target``.idx; the number of records.

    The index has a JSON line per record: offset and length of its member,
    record id and type.
    """
    split, offset, n = Splitter(), 0, 0
    with store.open_output_stream(target, compression=None) as write, store.open_output_stream(target + ".idx", compression=None) as index:
        for piece in inflated(store, source):
            for whole in split.feed(piece):
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = pack.compress(whole) + pack.flush()
                write.write(member)
                head = _headers(whole[: whole.index(END)])
                index.write(json.dumps({"offset": offset, "length": len(member), "id": head["warc-record-id"], "type": head["warc-type"]}).encode() + b"\n")
                offset, n = offset + len(member), n + 1
        split.finish()
    return n


def members(store: fs.FileSystem, path: str) -> Iterator[dict]:
    """Records of a normalised file, each read alone at the offset that the index names."""
    with store.open_input_file(path) as file, store.open_input_stream(path + ".idx", compression=None) as index:
        left = b""
        while piece := index.read(PIECE):
            *lines, left = (left + piece).split(b"\n")
            for line in lines:
                at = json.loads(line)
                file.seek(at["offset"])
                yield parse(zlib.decompress(file.read(at["length"]), 31))


def decide(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads the largest page_id is the response.

    Only digests go through the aggregation.  Digests of more than a thousandth
    of the rows, of which there are at most a thousand, join by broadcast; the
    others' rows meet by digest, and no task gets more than such a share.
    """
    rows = pages.withColumn("sum", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    sums = cut(rows.where(size >= least).groupBy("sum").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1"), "payloads")
    total = rows.count()
    hot = F.broadcast(sums.where(F.col("n") > total / HOT_SHARE).select(F.col("sum").alias("hot_sum"), F.col("last").alias("hot_last")))
    cold = sums.where(F.col("n") <= total / HOT_SHARE).select(F.col("sum").alias("key"), "last")
    dealt = rows.join(hot, rows["sum"] == F.col("hot_sum"), "left")
    alone = F.concat(F.lit("#"), F.xxhash64("page_id", "url").cast("string"))
    dealt = dealt.withColumn("key", F.when(F.col("hot_sum").isNotNull(), alone).otherwise(F.col("sum")))
    last = F.coalesce("hot_last", "last")
    other = last.isNotNull() & ~F.col("page_id").eqNullSafe(last) & (size >= least)
    return dealt.join(cold, "key", "left").select("page_id", "url", "html", F.when(other, last).alias("refers_to"))


def write_monolithic(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes whole-file gzip archives; the list of finished files (name, records)."""
    schema = pa.schema([("name", pa.string()), ("records", pa.int64())])

    def run(batches):
        store, path = _open(folder)
        out = None
        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                if out is None:
                    name, n, size, pack = f"{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                whole = record(row["page_id"], row["url"], (row["html"] or "").encode("utf-8", "replace"), row["refers_to"])
                out.write(pack.compress(whole))
                n, size = n + 1, size + len(whole)
                if size >= file_bytes:
                    out.write(pack.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"name": name, "records": n}], schema)
        if out is not None:
            out.write(pack.flush())
            out.close()
            yield pa.RecordBatch.from_pylist([{"name": name, "records": n}], schema)

    return cut(rows.mapInArrow(run, "name string, records long"), "warc-files")


def normalise_all(files: DataFrame, source: str, target: str) -> DataFrame:
    """Normalises every listed file; the list of normalised ones (name, records)."""
    schema = pa.schema([("name", pa.string()), ("records", pa.int64())])

    def run(batches):
        (store, path), (_, to) = _open(source), _open(target)
        for batch in slices(batches, 64):
            for row in batch.to_pylist():
                name = f"{uuid.uuid4().hex}.warc.gz"
                n = normalise(store, f"{path}/{row['name']}", f"{to}/{name}")
                if n != row["records"]:
                    raise ValueError(f"{row['name']}: {n} of {row['records']} records")
                yield pa.RecordBatch.from_pylist([{"name": name, "records": n}], schema)

    return cut(_by_file(files).mapInArrow(run, "name string, records long"), "warc-members")


def _by_file(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, min(files.count(), 100_000)))


def read_archives(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the listed files: page_id, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    names = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if payloads:
        kinds, names = [*kinds, ("payload", pa.binary())], names + ", payload binary"
    schema = pa.schema(kinds)

    def run(batches):
        store, path = _open(folder)
        for batch in slices(batches, 64):
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                for found in members(store, f"{path}/{name}"):
                    rows.append({f: found[f] for f in schema.names})
                    size += 200 + (len(found["payload"] or b"") if payloads else 0)
                    if size > 4 * PIECE:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return _by_file(files).mapInArrow(run, names)


def archive(pages: DataFrame, folder: str | None = None, payloads: bool = False, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Writes a record per page below ``folder``, normalises the archives, reads them back.

    * a null html is an empty payload; empty payloads are equal payloads too;
    * rows that repeat both the largest page_id and the payload are each a
      response; a null page_id is below all others, and copies without any id
      are each a response;
    * a null url writes no target; blanks and control characters in one are
      percent-encoded; other columns are not read;
    * an empty table writes no archive and gives no row.
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    rows = pick(pages, page_id="page_id", url="url", html="html").select(F.col("page_id").cast("long"), "url", "html")
    written = write_monolithic(decide(rows, least), f"{folder}/monolithic")
    ready = normalise_all(written, f"{folder}/monolithic", f"{folder}/members")
    return read_archives(ready, f"{folder}/members", payloads)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


#: DuckDB has no base32: the 160 bits of the SHA-1 are read five at a time.
OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
d AS (SELECT h, last, list_transform(range(0, 40), lambda x: instr('0123456789abcdef', substr(h, CAST(x + 1 AS BIGINT), 1)) - 1) AS n FROM g),
e AS (SELECT h, last, list_reduce(list_transform(range(0, 32), lambda k:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
          list_reduce(list_transform(range(0, 5), lambda j: ((n[CAST((5 * k + j) // 4 + 1 AS BIGINT)] >> CAST(3 - (5 * k + j) % 4 AS INTEGER)) & 1) << CAST(4 - j AS INTEGER)), lambda x, y: x + y) + 1 AS BIGINT), 1)), lambda x, y: x || y) AS digest FROM d)
SELECT p.page_id, CAST(octet_length(p.b) AS BIGINT) AS payload_bytes, e.digest AS payload_digest,
       CASE WHEN p.page_id = e.last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = e.last THEN NULL ELSE e.last END AS refers_to
FROM p JOIN e USING (h)
"""
