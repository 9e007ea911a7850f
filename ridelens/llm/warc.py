"""WARC: seekable Zstandard bundles.

Records (WARC/1.1) are grouped into independent Zstandard frames of about ``FRAME_BYTES``; a bundle ends with the
public seekable format's table (a skippable frame with the compressed and the uncompressed size of every frame), so
any frame can be found and read alone. The index table maps record identifiers to (bundle, frame, offset in the
frame, length). Bundles are bounded in size; each task streams its rows into as many as it needs.

Records with equal payloads of at least ``min_bytes`` bytes are stored once: that with the largest page id is the
``response``, the others are ``revisit`` records that name it. The group's largest id is aggregated per digest before
the shuffle and joined back by digest; a digest shared by very many pages is split by AQE's skew join.

Defined results: a null html has an empty payload; a null url leaves the target header out; a null page id has no
number in its record id, revisits like any other and is never referred to (a group of null ids only: all are
responses); rows that repeat the largest page id of a group are all responses; other columns are ignored; an empty
table writes no bundle.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelens.llm.common import fresh_path, materialize, open_new, open_read

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
LEVEL = 3
# Fixed values of the public formats
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URL_SAFE = "!#$%&'()*+,/:;=?@[]~-._"


# ---- seekable Zstandard ---------------------------------------------------------------------------------------

class BundleWriter:
    def __init__(self, folder: str):
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.out, self.uri = open_new(folder, "bundle", ".warc.zst")
        self.frames, self.buffer, self.held, self.total = [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Append a record; returns (frame, offset in the frame)."""
        if self.held and self.held + len(record) > FRAME_BYTES:
            self._flush()
        at = (len(self.frames), self.held)
        self.buffer.append(record)
        self.held += len(record)
        self.total += len(record)
        return at

    def _flush(self) -> None:
        packed = self.zstd.compress(b"".join(self.buffer))
        self.out.write(packed)
        self.frames.append((len(packed), self.held))
        self.buffer, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


class Bundle:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, uri: str):
        self.f = open_read(uri)
        size = self.f.size()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or flags:
            raise ValueError(f"{uri} has no seek table of this kind")
        sizes = list(struct.iter_unpack("<II", self._read(size - 9 - 8 * n, 8 * n)))
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed

    def _read(self, at: int, size: int) -> bytes:
        self.f.seek(at)
        return self.f.read(size)

    def frame(self, k: int) -> bytes:
        import zstandard

        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self._read(at, packed), max_output_size=plain)

    def record(self, frame: int, offset: int, length: int) -> dict:
        return parse_record(self.frame(frame)[offset:offset + length], 0)[0]


# ---- records --------------------------------------------------------------------------------------------------

def record_uri(page_id: int | None) -> str:
    return "<urn:page:unnumbered>" if page_id is None else f"<urn:page:{page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
                date: str) -> bytes:
    """A response, or with ``refers_to`` a revisit, which keeps the HTTP header (with the payload's length) only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=URL_SAFE)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_uri(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:])


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` (fields, http fields, payload) and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    fields = _fields(data[at:end])
    z = end + 4 + int(fields["Content-Length"])
    block = data[end + 4:z]
    cut = block.index(b"\r\n\r\n")
    return {"fields": fields, "http": _fields(block[:cut]), "payload": block[cut + 4:]}, z + 4


def _number(uri: str | None) -> int | None:
    tail = uri.rsplit(":", 1)[1].rstrip(">") if uri else "unnumbered"
    return None if tail == "unnumbered" else int(tail)


def _write(folder: str, date: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for pdf in batches:
            rows = []
            for page_id, url, payload, digest, refers_to in zip(
                    *(pdf[c].array for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                out = out or BundleWriter(folder)
                number = None if page_id is None else int(page_id)
                record = make_record(number, url if isinstance(url, str) else None, bytes(payload), digest,
                                     None if refers_to is None else int(refers_to), date)
                rows.append((number, record_uri(number), out.uri, *out.add(record), len(record)))
                if out.total >= BUNDLE_BYTES:
                    out.close()
                    out = None
            cols = ["page_id", "record_id", "path", "frame", "offset", "length"]
            yield pd.DataFrame(rows, columns=cols).assign(page_id=pd.array([r[0] for r in rows], "Int64"))
        if out:
            out.close()

    return run


def _read_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload_ok"]
    for pdf in batches:
        for path, first, last in zip(pdf["path"], pdf["first"], pdf["last"], strict=True):
            bundle = Bundle(path)
            for k in range(first, last):
                data, at, rows = bundle.frame(k), 0, []
                while at < len(data):
                    r, at = parse_record(data, at)
                    f, size = r["fields"], int(r["http"]["Content-Length"])
                    stored = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    whole = f["WARC-Type"] == "response"
                    digest = hashlib.sha1(r["payload"]).hexdigest() if whole else stored
                    rows.append((_number(f["WARC-Record-ID"]), size, digest, f["WARC-Type"],
                                 _number(f.get("WARC-Refers-To")), f.get("WARC-Target-URI"),
                                 digest == stored and (not whole or size == len(r["payload"]))))
                yield pd.DataFrame(rows, columns=cols).assign(
                    page_id=pd.array([r[0] for r in rows], "Int64"), refers_to=pd.array([r[4] for r in rows], "Int64"))


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): what to write for every page."""
    html = F.col("html").cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(html, F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    long = F.length("payload") >= min_bytes
    first = base.where(long).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    first = first.where("n > 1 AND top IS NOT NULL").select("digest", "top")
    joined = base.join(first, "digest", "left")
    own = F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", "payload", "digest", F.when(~own, F.col("top")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write all pages as bundles; returns the index (page_id, record_id, path, frame, offset, length)."""
    # ids go as text: pandas would turn a column of integers and nulls into floats
    plan = plan_records(pages, min_bytes).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    return materialize(plan.mapInPandas(
        _write(folder, date), "page_id long, record_id string, path string, frame int, offset int, length int"),
        "warc-index")


def read_warc(index: DataFrame, frames_per_task: int = 16) -> DataFrame:
    """Read the bundles named in the index back, one row per record; ``payload_ok``: the digest holds."""
    frames = index.groupBy("path").agg((F.max("frame") + 1).alias("n"))
    units = frames.select("path", "n", F.explode(F.sequence(
        F.lit(0), F.col("n") - 1, F.lit(frames_per_task))).alias("first"))
    units = materialize(units.select("path", "first", F.least("n", F.col("first") + frames_per_task).alias("last")),
                        "warc-units")
    return units.repartition(max(1, units.count()), "path", "first").mapInPandas(
        _read_frames, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                      "target_uri string, payload_ok boolean")


def op2_warc_bundles(spark, sf_dir: str) -> DataFrame:
    from ridelens.llm.common import table

    index = write_warc(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                   "payload_ok")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p
), t AS (
  SELECT digest, max(page_id) AS top, count(*) AS c FROM d WHERE n >= 1000 GROUP BY digest
)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN t.c > 1 AND d.page_id IS DISTINCT FROM t.top AND t.top IS NOT NULL THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN t.c > 1 AND d.page_id IS DISTINCT FROM t.top THEN t.top END AS refers_to, TRUE AS payload_ok
FROM d LEFT JOIN t ON d.digest = t.digest AND d.n >= 1000
"""
