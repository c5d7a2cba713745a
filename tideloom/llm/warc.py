"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record.

Archives are written by Spark's text writer, whose rows are whole archives (raw bytes) and whose line separator is an
empty skippable frame; so they go to any file system that Spark writes to, under its commit protocol, and are valid
Zstandard files.  They are read with Spark's binary file source.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bounded_batches, new_path, small, stash

#: Fixed values of the formats: magic numbers of frames (little endian), and of the dictionary's skippable frame.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
#: An empty skippable frame, as a string; every byte is ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0).decode("ascii")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archives are closed at this many compressed bytes.
ARCHIVE_BYTES = 8 << 20
#: The dictionary is fitted to at most so many rows of the table, and so many bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 16 << 10, 32 << 10
#: Equal payloads below this size are stored again.
REVISIT_BYTES = 100
READ = "record_id string, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to string"
#: Fixed names of the types of records.
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
#: Records that a page makes have ids that begin so; that of a row without an id has another end.
NAMED, UNNAMED = "urn:page:", "urn:unnamed-page"


class ArchiveError(ValueError):
    """A frame, header or length of an archive that doesn't hold."""


def fit_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary's bytes; empty if there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s[:SAMPLE_BYTES] for s in samples if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary if dictionary else b""


def clean(uri: str) -> str:
    """A header's value in UTF-8, in which only what could not be read back is percent-encoded: control characters, and
    white space at either end."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f\u2028\u2029\ud800-\udfff]|^\s+|\s+$", lambda m: quote(m[0], safe="", errors="surrogatepass"), uri)


def name_of(key: str | None) -> str:
    return UNNAMED if key is None else NAMED + quote(key, safe="")


def record(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit record if ``refers_to`` is given: that holds the reply's head only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + clean(uri))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends, by its block headers."""
    try:
        p = at + zstandard.frame_header_size(data[at : at + 18])
        checked = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
        while True:
            header = data[p] | data[p + 1] << 8 | data[p + 2] << 16
            p += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)
            if header & 1:
                break
    except (zstandard.ZstdError, IndexError) as e:
        raise ArchiveError(f"no whole frame at byte {at}: {e}") from e
    p += 4 * checked
    if p > len(data):
        raise ArchiveError(f"the frame at byte {at} is cut off")
    return p


def frames(archive: bytes) -> Iterator[bytes]:
    """The content of each record frame."""
    data, at = memoryview(archive), 0
    reader = zstandard.ZstdDecompressor()
    first = True
    while at < len(data):
        if len(data) - at < 8:
            raise ArchiveError(f"{len(data) - at} stray bytes at byte {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & ~0xF == SKIPPABLE:
            if at + 8 + size > len(data):
                raise ArchiveError(f"the skippable frame at byte {at} is cut off")
            if magic == DICTIONARY:
                if not first:
                    raise ArchiveError(f"a dictionary at byte {at}, after the first frame")
                held = bytes(data[at + 8 : at + 8 + size])
                if held[:4] == struct.pack("<I", FRAME):  # a dictionary may itself be compressed
                    held = zstandard.ZstdDecompressor().decompress(held)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
            at += 8 + size
        elif magic == FRAME:
            end = frame_end(data, at)
            try:
                yield reader.decompressobj().decompress(data[at:end])  # a frame needn't say how large its content is
            except zstandard.ZstdError as e:
                raise ArchiveError(f"the frame at byte {at} doesn't decode: {e}") from e
            at = end
        else:
            raise ArchiveError(f"unknown frame at byte {at}")
        first = False


def fields(head: bytes, first: str) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith(first):
        raise ArchiveError(f"a head that begins with {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"a bad header line {line[:40]!r}")
        out[name.lower()] = value.strip()
    return out


def dechunked(body: bytes) -> bytes | None:
    """The content of a reply in chunks; None if it isn't well-formed, as archives may hold what was decoded before."""
    out, at = [], 0
    while m := re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r\n").match(body, at):
        size, begin = int(m[1], 16), m.end()
        if not size:
            return b"".join(out)
        if body[begin + size : begin + size + 2] != b"\r\n":
            return None
        out.append(body[begin : begin + size])
        at = begin + size + 2
    return None


def has_digest(digest: str, content: bytes) -> bool | None:
    """Whether a content has a digest ``algorithm:value``, in hexadecimal or Base32; None if it can't be told."""
    name, colon, value = digest.partition(":")
    name = name.lower().replace("-", "")
    if not colon or name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    own = hashlib.new(name, content).digest()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def parse(content: bytes) -> tuple[dict[str, str], bytes, int, str]:
    """Headers, payload, its full length and SHA-256 digest of one record.

    Every record has to have its fields, and a block of its length.  The payload is the block, or what follows the head
    of an HTTP message in it, which must be as long as that head says, if it does; the digests of block and payload are
    checked where they are given and of a known kind.  Of a revisit, which has no payload, length (-1 if unknown) and
    digest are what the headers say.
    """
    head, gap, rest = content.partition(b"\r\n\r\n")
    if not gap:
        raise ArchiveError("a record without the end of its head")
    h = fields(head, "WARC/")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ArchiveError(f"a record without {name}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError(f"{h['warc-record-id']}: the block has {len(rest) - 4} bytes, its header says {h['content-length'][:20]}")
    kind, block, said = h["warc-type"], rest[:-4], h.get("warc-payload-digest", "")
    if kind not in TYPES:
        return h, b"", -1, ""  # other types may be skipped, says the format
    if has_digest(h.get("warc-block-digest", ""), block) is False:
        raise ArchiveError(f"{h['warc-record-id']}: the block doesn't have its digest")
    message = h.get("content-type", "").lower().replace(" ", "").startswith("application/http") and kind in ("response", "request", "revisit")
    size, payloads = None, [block]
    if message:
        reply, gap, payload = block.partition(b"\r\n\r\n")
        if not gap and kind != "revisit":
            raise ArchiveError(f"{h['warc-record-id']}: a message without the end of its head")
        held = fields(reply, "HTTP/" if kind != "request" else "") if reply else {}
        size, payloads = held.get("content-length"), [payload]
        if "chunked" in held.get("transfer-encoding", "").lower():
            size, whole = None, dechunked(payload)
            payloads = [payload] if whole is None else [whole, payload]
        if size is not None and not size.isdigit():
            raise ArchiveError(f"{h['warc-record-id']}: a message with a bad length")
    if kind == "revisit":
        if "warc-profile" not in h or not said and "warc-refers-to" not in h:
            raise ArchiveError(f"{h['warc-record-id']}: a revisit that doesn't tell of what")
        return h, b"", -1 if size is None else int(size), said.removeprefix("sha256:")
    if size is not None and len(payloads[0]) != int(size) and "warc-truncated" not in h and kind == "response":
        raise ArchiveError(f"{h['warc-record-id']}: the payload has {len(payloads[0])} bytes, its header says {size}")
    checks = [has_digest(said, p) for p in payloads]
    if False in checks and True not in checks:
        raise ArchiveError(f"{h['warc-record-id']}: the payload doesn't have its digest")
    payload = payloads[checks.index(True) if True in checks else 0]
    return h, payload, len(payload), hashlib.sha256(payload).hexdigest()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row of ``pages`` into archives in the folder ``path``.

    Of rows with equal payloads of at least ``REVISIT_BYTES`` bytes that with the smallest id is a response, the others
    revisit it.  A null payload is empty; a null uri has no header; a null id comes last, and rows that share the
    smallest id are all responses.  An empty table writes no record.  Other columns are not read.

    Payloads are shuffled only if more groups repeat than may be broadcast.  Archives hold ``archive_bytes`` at most,
    or one larger record.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(uri_col).cast("string").alias("_uri"), F.coalesce(F.col(payload_col), F.lit("")).alias("_payload"))
    samples = [r[0].encode() for r in rows.select(F.left("_payload", F.lit(SAMPLE_BYTES))).limit(SAMPLE_ROWS).collect()]
    dictionary = fit_dictionary(samples)
    rows = rows.withColumn("_digest", F.sha2("_payload", 256))
    groups = rows.where(F.octet_length("_payload") >= REVISIT_BYTES).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = stash(groups.where("_n > 1").drop("_n"), "payloads")
    rows = rows.join(small(groups), "_digest", "left")
    rows = rows.withColumn("_refers", F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        coder = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
        held, size = [leading_frame(dictionary)], 0
        for batch in batches:
            for key, uri, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                frame = coder.compress(record(name_of(key), uri, payload.encode(), digest, None if refers is None else name_of(refers), date))
                if size and size + len(frame) > archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])
                    held, size = held[:1], 0
                held.append(frame)
                size += len(frame)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["archive"])

    columns = rows.select(F.col("_id").cast("string").alias("_id"), "_uri", "_payload", "_digest", F.col("_refers").cast("string").alias("_refers"))
    archives = bounded_batches(columns).mapInArrow(pack, "archive binary").select(F.col("archive").cast("string"))
    archives.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in the folder ``path``, whatever its type: ``record_id``, ``target_uri``,
    ``payload_bytes`` and ``payload_digest`` (SHA-256; of a revisit as its headers say) of the full payload,
    ``record_type``, ``refers_to``; with ``payload`` (null for revisits) if asked for.  Records of a type that the format
    doesn't know have no payload.  A frame, header, length or digest that doesn't hold raises ``ArchiveError``."""
    schema = READ + (", payload binary" if with_payload else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                for frame in frames(content.as_py()):
                    h, payload, size, digest = parse(frame)
                    kind, uri, refers = h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to")
                    uri = uri[1:-1] if uri and uri[0] == "<" and uri[-1] == ">" else uri  # as the format's first version has it
                    row = [h["warc-record-id"].strip("<>"), uri, None if size < 0 else size, digest or None, kind, refers.strip("<>") if refers else None]
                    held += len(payload) * with_payload + 200
                    out.append(row + [payload if kind in TYPES and kind != "revisit" else None] * with_payload)
                    if held > 16 << 20:
                        yield table(out)
                        out, held = [], 0
                if out:
                    yield table(out)

    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * with_payload]
    names = [x.split()[0] for x in schema.split(", ")]

    def table(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return bounded_batches(files).mapInArrow(read, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back: id, ``payload_bytes``, ``payload_digest``,
    ``record_type``, ``refers_to`` (the id of the response that a revisit refers to), ``target_uri``."""
    spark, path = pages.sparkSession, new_path(pages.sparkSession, "warc")
    write_warc(pages, path, id_col, **columns)
    kind = pages.schema[id_col].dataType
    # plus signs stand for themselves in the names
    key = lambda c: F.when(F.startswith(c, F.lit(NAMED)), F.url_decode(F.substring(c, len(NAMED) + 1, 2**30))).cast(kind)
    back = read_warc(spark, path)
    return back.select(key(F.col("record_id")).alias(id_col), "payload_bytes", "payload_digest", "record_type", key(F.col("refers_to")).alias("refers_to"), "target_uri")
