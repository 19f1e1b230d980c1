"""WARC archives: a writer that stores repeated payloads once, and a reader
that splits archives by byte range.

Each record is a gzip member of its own. A reader task gets a byte range,
looks for the gzip magic, checks a candidate by inflating its first bytes and
reading the WARC headers, and then walks from member to member. It owns the
records that start in its range and reads past the end to finish the last.
Tasks reach archives by ``pyarrow.fs``, so any store it knows will do.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import Scratch, new_folder

LEAST_BYTES = 1000
RANGE_BYTES = 8 << 20
MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 18

RECORD = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, archive string, at long"
)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = path[5:] if not path.startswith("file://") else path[7:]
        return pafs.LocalFileSystem(), path
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def with_record_types(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds payload_bytes, payload_digest, record_type and refers_to.

    Among equal payloads of ``least_bytes`` or more the largest page_id is the
    response, the others revisit it. The copies are found on digests alone;
    pages meet only the digests that repeat, and a hot digest is split by the
    skew join because both of its sides are plain shuffles."""
    payload = F.coalesce("html", F.lit(""))
    sized = pages.withColumn("payload_bytes", F.octet_length(payload).cast("long")).withColumn(
        "payload_digest", F.sha1(payload)
    )
    repeated = (
        sized.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    repeated = Scratch(pages.sparkSession).write(repeated)
    revisit = F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    return (
        sized.join(repeated, "payload_digest", "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("_keeper")))
        .drop("_keeper")
    )


def _urn(page_id) -> str:
    return "<urn:page:null>" if page_id is None or pd.isna(page_id) else f"<urn:page:{int(page_id)}>"


def _id(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").rpartition(":")[2]
    return None if name in ("", "null") else int(name)


def encode_record(page_id, url, html: str | None, kind: str, refers_to, digest: str, size: int) -> bytes:
    """One gzip member holding one WARC record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (b"" if kind == "revisit" else (html or "").encode("utf-8"))
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines.append(f"WARC-Refers-To: {_urn(refers_to)}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    head = "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n"
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(head + body + b"\r\n\r\n") + packer.flush()


def decode_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(": ")
        fields[name.lower()] = value
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind = fields["warc-type"]
    url = fields.get("warc-target-uri")
    whole = kind == "response"
    return {
        "page_id": _id(fields["warc-record-id"]),
        "url": url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "payload": payload if whole else None,
        "payload_bytes": len(payload) if whole else int(fields["x-payload-length"]),
        "payload_digest": hashlib.sha1(payload).hexdigest() if whole else fields["warc-payload-digest"][5:],
        "record_type": kind,
        "refers_to": _id(fields.get("warc-refers-to")),
    }


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task under ``folder``; the result lists the
    archives (path, bytes). A task that runs twice leaves a second file that
    the list does not name. Null html is an empty payload."""
    typed = with_record_types(pages.select("page_id", "url", "html")).select(
        "page_id", "url", "html", "record_type", "refers_to", "payload_digest", "payload_bytes"
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, out, written, path = None, None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for rows in batches:
            for page_id, url, html, kind, refers, digest, size in rows.itertuples(index=False):
                if out is None:
                    fs, local = _open(path)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local, compression=None)
                written += out.write(encode_record(page_id, url, html, kind, refers, digest, size))
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "bytes": [written]})

    # ids travel as strings: pandas has no null in an integer column
    texts = typed.withColumn("page_id", F.col("page_id").cast("string")).withColumn(
        "refers_to", F.col("refers_to").cast("string")
    )
    return Scratch(pages.sparkSession).write(texts.mapInPandas(write, "path string, bytes long"))


def scan_range(path: str, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated record) of the members that start in [start, end)."""
    fs, local = _open(path)
    with fs.open_input_file(local) as file:

        def read(at: int, n: int) -> bytes:
            file.seek(at)
            return file.read(max(0, min(n, size - at)))

        at, synced, base, block = start, False, start, b""
        while at < end:
            if not base <= at <= base + len(block) - len(MAGIC):
                base, block = at, read(at, STEP)
            found = block.find(MAGIC, at - base)
            if found < 0:
                if base + len(block) >= size:
                    return
                at, synced = base + len(block) - len(MAGIC) + 1, False
                continue
            if base + found >= end:
                return
            at = base + found
            raw, after = _inflate(read, at, block[found:])
            if raw is None:
                at += 1
                continue
            yield at, raw
            at = after


def _inflate(read, at: int, first: bytes) -> tuple[bytes | None, int]:
    """The member at ``at`` and the offset behind it; None if it is no record."""
    unpack, chunks, pos, data = zlib.decompressobj(31), [], at, first
    checked = False
    while True:
        try:
            chunks.append(unpack.decompress(data))
        except zlib.error:
            return None, at
        if not checked and sum(map(len, chunks)) >= 7:
            checked = True
            if not b"".join(chunks).startswith(b"WARC/1."):
                return None, at
        pos += len(data)
        if unpack.eof:
            raw = b"".join(chunks)
            known = checked and b"\r\nContent-Length: " in raw.partition(b"\r\n\r\n")[0]
            return (raw if known else None), pos - len(unpack.unused_data)
        data = read(pos, STEP)
        if not data:
            return None, at


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the listed archives (path, bytes), RECORD columns. A
    revisit has no payload; its size and digest are those of the full one."""
    spark: SparkSession = archives.sparkSession
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = archives.filter("bytes > 0").select("path", "bytes", starts.alias("start"))
    spread = ranges.repartition(spark.sparkContext.defaultParallelism * 4, "path", "start")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        for rows in batches:
            for path, size, start in rows[["path", "bytes", "start"]].itertuples(index=False):
                found, held = [], 0
                for at, raw in scan_range(path, start, min(start + range_bytes, size), size):
                    found.append(decode_record(raw) | {"archive": path, "at": at})
                    held += len(raw)
                    if held > 16 << 20:
                        yield _frame(found, names)
                        found, held = [], 0
                if found:
                    yield _frame(found, names)

    return spread.mapInPandas(scan, RECORD)


def _frame(records: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(records, columns=names, dtype=object)
    for c in ("page_id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives and reads them back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder))
