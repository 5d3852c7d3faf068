"""Zstandard WARC archives: one frame per record, dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats.
VERSION = "WARC/1.1"
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
# Payload bytes an archive holds before the next is begun; size of its
# dictionary, and bytes of its payloads that the dictionary is made from.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 3
# Payloads from this size on can be revisited.
LEAST_BYTES = 0


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def page_of(record: str | None) -> int | None:
    number = record.removeprefix("<urn:page:").removesuffix(">") if record else "null"
    return None if number == "null" else int(number)


def _uri(url: str) -> str:
    """A header value: control characters and blanks percent-encoded."""
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisits: int | None, is_revisit: bool,
                 date: str = DATE) -> bytes:
    """One record.  A revisit has the HTTP header of the page but no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [VERSION, f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(revisits)}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_record(record: bytes) -> dict:
    """The fields of a record; a ValueError names what is wrong with it."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != VERSION:
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:40]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if fields["warc-type"] not in ("response", "revisit"):
        raise ValueError("unknown type")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("length differs")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    sizes = [v.strip() for n, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if n.lower() == b"content-length"]
    if not gap or not http.startswith(b"HTTP/") or len(sizes) != 1 or not sizes[0].isdigit():
        raise ValueError("bad HTTP header")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if len(payload) != int(sizes[0]):
            raise ValueError("payload length differs")
        if payload_digest(payload) != digest:
            raise ValueError("payload digest differs")
    elif payload or "warc-refers-to" not in fields:
        raise ValueError("bad revisit")
    return {"page_id": page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"),
            "payload_bytes": int(sizes[0]), "payload_digest": digest, "record_type": fields["warc-type"],
            "refers_to": page_of(fields.get("warc-refers-to")), "payload": payload}


def pack(records: list[bytes], level: int = LEVEL) -> bytes:
    """An archive: the dictionary in a skippable frame, then a frame a record.

    The dictionary is trained on a bounded sample spread over the records; too
    few or too small ones give an archive without dictionary."""
    import zstandard
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    dictionary = None
    if len(records) >= 16:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, records[::step], k=256, d=8)
        except zstandard.ZstdError:
            dictionary = None
    packer = zstandard.ZstdCompressor(level=level, write_checksum=True, **({"dict_data": dictionary} if dictionary else {}))
    out = []
    if dictionary:
        content = zstandard.ZstdCompressor(level=level).compress(dictionary.as_bytes())
        out.append(struct.pack("<II", SKIPPABLE, len(content)) + content)
    return b"".join(out + [packer.compress(r) for r in records])


def frame_end(data: bytes, at: int) -> int:
    """Where the zstandard frame that starts at ``at`` ends, from its headers."""
    magic, flags = struct.unpack_from("<IB", data, at)
    if magic != FRAME:
        raise ValueError("no zstandard frame")
    single = flags >> 5 & 1
    size = (1 if single else 0, 2, 4, 8)[flags >> 6]
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size
    while True:
        if at + 3 > len(data):
            raise ValueError("cut off in a frame")
        block = int.from_bytes(data[at:at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ValueError("cut off in a frame")
    return at


def unpack(data: bytes):
    """``record bytes`` of each frame of an archive, one at a time."""
    import zstandard
    at, options = 0, {}
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        content = data[8:8 + size]
        if len(content) != size:
            raise ValueError("dictionary cut off")
        if content[:4] == struct.pack("<I", FRAME):
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        options["dict_data"] = zstandard.ZstdCompressionDict(content)
        at = 8 + size
    reader = zstandard.ZstdDecompressor(**options)
    while at < len(data):
        end = frame_end(data, at)
        yield reader.decompress(data[at:end])
        at = end


def _payloads(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int) -> DataFrame:
    payload = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
                        payload.alias("payload"))
    digest = F.when(F.octet_length("payload") >= least_bytes, F.unhex(F.sha1("payload")))
    return rows.select("*", digest.alias("digest"))


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``path, content``: archives of one record per row of ``pages``, as
    ``binaryFile`` reads them.

    Of rows with equal payloads of ``least_bytes`` or more the one with the
    smallest id is the response and the others revisit it.  An id names a page:
    rows that repeat the smallest id are the same page and each is a response.
    A null id is larger than all; pages that share a payload and all lack an id
    are responses.  A null payload is empty, a null url gives no header.  A
    task holds the records of one archive, ``archive_bytes`` of payload or one
    record.  The smallest id of a payload is found by a partial aggregation of
    digests; payloads move once, in the join with it, whose hot keys adaptive
    execution splits.  No rows, no archives.
    """
    rows = _payloads(pages, page_id, url, html, least_bytes)
    ids = rows.where(F.col("digest").isNotNull()).select("digest", "page_id")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).select(
        F.col("digest").alias("d"), "first", "copies")
    placed = rows.join(first, F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", "payload", "first", F.coalesce("copies", F.lit(1)).alias("copies"),
        F.col("page_id").eqNullSafe(F.col("first")).alias("leads"))

    return placed.mapInArrow(lambda batches: _archives(batches, archive_bytes), "path string, content binary")


def _archives(batches, archive_bytes):
    from pyspark import TaskContext
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first", "copies", "leads")]
        for page, url, payload, first, copies, leads in zip(*columns):
            revisit = copies > 1 and not leads
            held.append(write_record(page, url, payload, payload_digest(payload), first, revisit))
            size += len(payload)
            if size >= archive_bytes:
                yield _archive(task, number, held)
                number, held, size = number + 1, [], 0
    if held:
        yield _archive(task, number, held)


def _archive(task: int, number: int, records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f"pages-{task:06d}-{number:05d}.warc.zst"]), pa.array([pack(records)], pa.binary())],
        names=["path", "content"])


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of archives ``path, content`` (``spark.read.format("binaryFile")``
    gives them): ``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, path, problem``, and ``payload`` if asked for.

    Frames are decoded one by one with the dictionary of the leading skippable
    frame.  A record that breaks a rule, or an archive that ends early, is a row
    with a ``problem`` and nulls."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if payloads:
        names, kinds, schema = [*names, "payload"], [*kinds, pa.binary()], schema + ", payload binary"

    def rows(path, data):
        frames = unpack(data)
        while True:
            try:
                record = next(frames)
            except StopIteration:
                return
            except Exception as e:  # what follows in the archive can't be found
                yield {"path": path, "problem": f"archive: {e}"}
                return
            try:
                yield read_record(record) | {"path": path, "problem": None}
            except ValueError as e:
                yield {"path": path, "problem": str(e)}

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content")):
                held, size = [], 0
                for row in rows(path.as_py(), data.as_py()):
                    held.append(row)
                    size += len(row.get("payload") or b"") if payloads else 100
                    if size > 4 << 20:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    def batch_of(held):
        return pa.RecordBatch.from_arrays(
            [pa.array([r.get(n) for r in held], k) for n, k in zip([*names, "path", "problem"], [*kinds, pa.string(), pa.string()])],
            names=[*names, "path", "problem"])

    return archives.select("path", "content").mapInArrow(run, schema + ", path string, problem string")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write the archives as files of a mounted folder that all executors share;
    ``path`` of each."""
    def run(batches):
        for batch in batches:
            paths = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                Path(folder).mkdir(parents=True, exist_ok=True)
                Path(folder, path).write_bytes(data.as_py())
                paths.append(str(Path(folder, path)))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])
    return archives.select("path", "content").mapInArrow(run, "path string")
