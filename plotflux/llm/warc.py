"""Dictionary-compressed WARC files: write pages as records, read the archives back."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotflux.llm.shared import shared_folder, slices, stored

#: Magic number of the skippable frame that holds the dictionary (WARC/zstd convention).
DICTIONARY_MAGIC = 0x184D2A5D
_FRAME = struct.Struct("<II")
_EMPTY = b""


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: str) -> str:
    """A header value: control characters and white space percent-encoded, so none can break the line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the digest and length of its payload, but no block."""
    block = payload if kind == "response" else _EMPTY
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{kind}')}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_line(url) if url else 'urn:page:unknown'}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def samples(records: list[bytes], sample_bytes: int, piece: int = 1 << 16) -> list[bytes]:
    """Pieces of records, ``sample_bytes`` of them, spread evenly over the bytes of all; all pieces where they are fewer."""
    total = sum(map(len, records))
    share = min(1.0, sample_bytes / total) if total else 1.0
    out, due = [], 0.0
    for one in records:
        for at in range(0, len(one), piece):
            part = one[at : at + piece]
            due += share * len(part)
            if share == 1.0 or due >= len(part):
                due -= len(part)
                out.append(part)
    return out


def train_dictionary(records: list[bytes], size: int, sample_bytes: int) -> zstandard.ZstdCompressionDict:
    """Dictionary of an archive, from pieces spread over all its records.

    So few or small records that none can be trained are a dictionary themselves, their last ``size`` bytes.
    """
    sample = samples(records, sample_bytes)
    held = sum(map(len, sample))
    if len(sample) >= 8 and held >= 8 * 256:
        try:
            return zstandard.train_dictionary(max(256, min(size, held // 8)), sample, k=256, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(sample)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes], dictionary_size: int = 65_536, sample_bytes: int = 4_000_000, level: int = 3) -> bytes:
    """An archive: the dictionary in a leading skippable frame, then one zstd frame per record."""
    if not records:
        return b""
    trained = train_dictionary(records, dictionary_size, sample_bytes)
    body = zstandard.ZstdCompressor(level=level).compress(trained.as_bytes())
    press = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=True)
    return b"".join([_FRAME.pack(DICTIONARY_MAGIC, len(body)), body, *[press.compress(one) for one in records]])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one after the other."""
    view, at, trained = memoryview(archive), 0, None
    if len(view) >= 8 and _FRAME.unpack_from(view)[0] == DICTIONARY_MAGIC:
        size = _FRAME.unpack_from(view)[1]
        body = bytes(view[8 : 8 + size])
        trained = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body))
        at = 8 + size
    while at < len(view):
        # A decompression object stops at the end of its frame and hands back the rest.
        reader = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
        parts, step = [], 1 << 16
        while not reader.eof:
            chunk = view[at : at + step]
            if not len(chunk):
                raise ValueError("the archive ends within a record")
            parts.append(reader.decompress(chunk))
            at += len(chunk)
        at -= len(reader.unused_data)
        yield b"".join(parts)


def parse(one: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record, its length checked."""
    head, _, rest = one.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict((n.lower(), v) for n, _, v in (line.partition(": ") for line in lines[1:]))
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, block


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder else folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") else f"file://{folder}")


def write_archives(
    pages: DataFrame,
    folder: str,
    min_revisit_bytes: int = 0,
    archive_bytes: int = 16_000_000,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id``, ``url``, ``html``); returns the manifest ``path``, ``records``.

    Of records with equal payloads of at least ``min_revisit_bytes``, the one with the smallest
    ``page_id`` is a response and the others revisit it; rows that repeat that id are
    responses too. A row without an id revisits the smallest one, and is a response where no equal
    payload has an id. Archives are rotated at about ``archive_bytes`` of records, so a task holds
    one at a time. Files are named by their records' digest and moved into place when complete: a
    task that runs twice writes the same name again, and only files of the manifest are read.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), payload.alias("payload"))
    key = F.when(F.length("payload") >= min_revisit_bytes, F.sha2("payload", 256))
    rows = rows.withColumn("same", key)
    first = (
        rows.where("same is not null and page_id is not null")
        .groupBy("same")
        .agg(F.min("page_id").alias("first"))
        .select(F.col("same").alias("of"), "first")
    )
    joined = rows.join(first, rows["same"] == first["of"], "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    plan = joined.select("page_id", "url", "payload", F.when(revisits, F.col("first")).alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = pack(held)
            name = f"{root}/{hashlib.sha256(data).hexdigest()[:32]}.warc.zst"
            part = f"{name}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(part, compression=None) as out:
                out.write(data)
            system.move(part, name)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["path", "records"])

        for batch in slices(batches):
            for page_id, url, body, refers in zip(*batch.columns):
                refers = refers.as_py()
                one = record(page_id.as_py(), url.as_py(), body.as_py(), "response" if refers is None else "revisit", refers, date)
                held.append(one)
                size += len(one)
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    system, root = _filesystem(folder)
    system.create_dir(root)
    return stored(plan.mapInArrow(write, "path string, records long"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the manifest's archives, payload digests checked against the blocks.

    An archive of the same content may be listed twice (equal records in two tasks); it is read as often.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _filesystem(folder)
        for batch in batches:
            for path in batch.column(0):
                with system.open_input_stream(path.as_py(), compression=None) as source:
                    archive = source.read()
                out: list[tuple] = []
                for one in unpack(archive):
                    fields, block = parse(one)
                    kind, sha = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest(block) != sha:
                        raise ValueError("a payload does not match its digest")
                    page, refers = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
                    length = len(block) if kind == "response" else int(fields["warc-payload-length"])
                    out.append((int(page) if page else None, length, sha, kind, int(refers) if refers else None))
                columns = list(zip(*out)) if out else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    wanted = manifest.select("path").repartition(max(1, manifest.count()))
    return wanted.mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archive_pages(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write every page to archives below the shared folder and read them back: a row per page.

    Columns ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``. A null
    or empty html is an empty payload; a null url is written as ``urn:page:unknown``. Repeated rows
    stay rows of their own; further columns of ``pages`` are ignored. Empty table: no rows.
    """
    folder = shared_folder(spark)
    return read_archives(write_archives(pages, folder, min_revisit_bytes), folder)
