"""WARC: Zstandard-compressed web archives, written and read back.

An archive is a byte string: first a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary, then one
frame for each WARC/1.1 record. A run trains one dictionary on a bounded sample of its pages, and every archive carries it.
The reader takes any such archive: all record types, any record ids, digests by SHA-1, SHA-256 or MD5 in base 32 or hex,
frames without a content size, and further skippable frames. Archives travel as rows (archive, content), in Parquet or by Spark's binaryFile source,
so any store that Spark reads will do; no task opens a path of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import map_arrow, new_folder, table
from scholia.sources.stored import stored

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed payload bytes after which a task starts another archive; what a dictionary is trained on at most (pages, bytes
#: of one, of all), and its size.
ARCHIVE_BYTES, SAMPLE, SAMPLE_PAGE, SAMPLE_BYTES, DICT_BYTES = 16 << 20, 1000, 64 << 10, 4 << 20, 16 << 10
DIGESTS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}
_URN = re.compile(r"<?(?:urn:uuid:)?([0-9a-fA-F-]{32,36})>?$")


class WarcError(ValueError):
    """A frame, header or length that isn't as it must be."""


def record_id(key: int | None) -> str:
    """A record's id from the page's key; a page without a key has the nil id with the top bit set."""
    return f"<urn:uuid:{uuid.UUID(int=(1 << 127) if key is None else key & (2**64 - 1))}>"


def record_key(urn: str | None) -> int | None:
    """The page's key from a record's id, if `record_id` gave it; null for any other id."""
    m = _URN.match(urn or "")
    if not m or len(m[1].replace("-", "")) != 32:
        return None
    n = uuid.UUID(m[1]).int
    return None if n >> 64 else n - (1 << 64) if n >> 63 else n


def make_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC record: a response with the whole payload, or, where refers_to is given, a revisit with its HTTP head only."""
    head, digest = HTTP_HEAD.format(len(payload)).encode(), hashlib.sha256(payload).digest()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", date),
        ("WARC-Payload-Digest", "sha256:" + base64.b32encode(digest).decode()), ("WARC-Block-Digest",
            "sha256:" + base64.b32encode(hashlib.sha256(block).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(x for x in url if x not in "\r\n")))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def train(payloads: list[bytes]) -> bytes:
    """A Zstandard dictionary from payloads. Where they are too few or too much alike to train one, the dictionary is plain
    content: a record's headers and what there is of payloads."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, payloads, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(payloads) + make_record(0, "", b"", None))[-DICT_BYTES:]


def dictionary_of(rows: DataFrame) -> bytes:
    """The dictionary for rows (page_id, payload): of about SAMPLE pages, chosen by a hash of the id, those of up to SAMPLE_PAGE
    bytes train it, SAMPLE_BYTES of them at most."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    near = F.pmod(F.xxhash64("page_id"), F.lit(1_000_003)) < int(1_000_003 * share) + 1
    found = rows.filter(near & (F.octet_length("payload") <= SAMPLE_PAGE)).select("payload").limit(SAMPLE).collect()
    sample, size = [], 0
    for payload in sorted(r.payload.encode("utf-8", "surrogatepass") for r in found):
        if size + len(payload) <= SAMPLE_BYTES:
            sample.append(payload)
            size += len(payload)
    return train(sample)


def pack(records: list[bytes], dictionary: bytes) -> bytes:
    with_dict = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    z = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **with_dict)
    return b"".join([struct.pack("<II", SKIPPABLE, len(dictionary)), dictionary, *(z.compress(x) for x in records)])


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at `at` ends, by its block headers."""
    try:
        flags = data[at + 4]
        p = at + 5 + (not flags & 32) + (0, 1, 2, 4)[flags & 3] + ((1 if flags & 32 else 0), 2, 4, 8)[flags >> 6]
        while True:
            head = int.from_bytes(data[p : p + 3], "little")
            if len(data) < p + 3:
                raise IndexError
            p += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
    except IndexError:
        raise WarcError("an archive ends inside a frame") from None
    p += 4 * bool(flags & 4)
    if p > len(data):
        raise WarcError("an archive ends inside a frame")
    return p


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each decompressed from a frame of its own, with the dictionary of the leading frame."""
    data, at, z = memoryview(content), 0, zstandard.ZstdDecompressor()
    if len(data) < 8:
        raise WarcError("not an archive")
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("an archive ends inside a frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic >> 4 == SKIPPABLE >> 4:
            if at + 8 + size > len(data):
                raise WarcError("an archive ends inside a skippable frame")
            if not at and magic == SKIPPABLE:
                z = _decompressor(bytes(data[8 : 8 + size]))
            at += 8 + size
            continue
        if magic != FRAME:
            raise WarcError("not a frame")
        end = _frame_end(data, at)
        try:
            d = z.decompressobj()  # a frame's header needn't give the size of its content
            record = d.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(str(e)) from None
        if not d.eof:
            raise WarcError("an archive ends inside a frame")
        yield record
        at = end


def _decompressor(raw: bytes) -> zstandard.ZstdDecompressor:
    try:
        if raw[:4] == struct.pack("<I", FRAME):  # the dictionary may be compressed itself
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 24)
        return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    except zstandard.ZstdError as e:
        raise WarcError(str(e)) from None


def _digest(said: str) -> tuple[str, str] | None:
    """A declared digest's algorithm and hex; null where it is of an algorithm that isn't known."""
    name, _, value = said.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in DIGESTS:
        return None
    size = DIGESTS[name]().digest_size
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except ValueError:
        raw = b""
    if len(raw) != size:
        raise WarcError(f"bad digest: {said[:80]}")
    return name, raw.hex()


def _check(fields: dict[str, str], name: str, content: bytes) -> None:
    if (said := fields.get(name)) and (known := _digest(said)) and DIGESTS[known[0]](content).hexdigest() != known[1]:
        raise WarcError(f"{name} isn't as declared")


def parse(record: bytes) -> dict:
    """A record's headers and payload after checks of version, required headers, lengths and digests.

    The payload is what follows the HTTP head in a record that has one, else the block. length is the full payload's: a
    revisit declares it in its HTTP head, and its digest (hex, by the algorithm `kind`) in its headers; other records'
    digests are computed by SHA-256. Payloads that are marked as truncated may be shorter than declared.
    """
    head, sep, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("not a WARC record")
    fields: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:  # a header that goes on
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise WarcError(f"bad header: {line[:80]}")
        fields[name] = value.strip()
    if lacking := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise WarcError(f"missing headers: {sorted(lacking)}")
    n = _length(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("the length isn't as declared")
    block, kind = rest[:n], fields["warc-type"].lower()
    _check(fields, "warc-block-digest", block)
    http, payload = b"", block
    if fields.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    said = [x.split(b":", 1)[1] for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    length = _length(said[0].decode("latin-1")) if said else len(payload)
    if kind == "revisit":
        digest = _digest(fields.get("warc-payload-digest", "")) or ("", "")
    else:
        if kind == "response" and len(payload) != length and "warc-truncated" not in fields:
            raise WarcError("the payload isn't as declared")
        _check(fields, "warc-payload-digest", payload)
        length, digest = len(payload), ("sha256", hashlib.sha256(payload).hexdigest())
    return {"fields": fields, "payload": payload, "length": length, "digest": digest[1], "kind": digest[0]}


def _length(said: str) -> int:
    if not re.fullmatch("[0-9]+", said.strip()):
        raise WarcError(f"bad length: {said[:80]}")
    return int(said)


def with_types(pages: DataFrame, at_least: int = 100) -> DataFrame:
    """page_id, url, payload, refers_to: for all but the record with the smallest id of those with equal payloads of
    `at_least` bytes, that id. Copies are counted by a partial aggregate on the digest. Groups of more than one row are
    written first: Spark knows the size of what it joins rows with, and broadcasts it only below its threshold. Beyond it
    rows shuffle once: short payloads get keys of their own, and a hot digest is split, as both sides are plain exchanges."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    digest = F.when(F.octet_length("payload") >= at_least, F.sha2(F.col("payload"), 256)).otherwise(F.concat(F.lit("-"),
        F.xxhash64("page_id", "url")))
    rows = rows.withColumn("digest", digest)
    copied = rows.filter(F.octet_length("payload") >= at_least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = stored(copied.filter("n > 1").select("digest", "first"))
    same: Column = F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "payload", F.when(~same, F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, path: str, dictionary: bytes) -> None:
    """Writes rows (page_id, url, payload, refers_to) as archives of at most about ARCHIVE_BYTES of payload each, all with the
    dictionary in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush() -> pa.RecordBatch:
            content = pack([make_record(*x) for x in waiting], dictionary)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()]), pa.array([content], pa.binary())],
                 names=["archive", "content"])

        for batch in batches:
            for key, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                waiting.append((key, url, html.encode("utf-8", "surrogatepass"), refers))
                size += len(waiting[-1][2])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    waiting, size = [], 0
        if waiting:
            yield flush()

    map_arrow(rows, run, "archive string, content binary").write.parquet(path)


#: What reading gives of a record, with Arrow's types.
RECORD = {
    "page_id": pa.int64(), "record_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload": pa.binary(),
         "payload_bytes": pa.int64(),
    "payload_digest": pa.string(), "digest_kind": pa.string(), "refers_to": pa.int64(), "refers_to_id": pa.string(),
}


def read_archives(archives: DataFrame, content: str = "content") -> DataFrame:
    """A row for each record of the archives, of whatever type: page_id (null where the id isn't `record_id`'s), record_id, url,
    record_type, payload (what the record holds of it), payload_bytes and payload_digest (of the full payload, hex, by
    digest_kind), refers_to and refers_to_id. Fails with WarcError on any malformed frame, header, length or digest."""
    schema = "page_id long, record_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, digest_kind string, refers_to long, refers_to_id string"

    def row(x: dict) -> tuple:
        f = x["fields"]
        refers = f.get("warc-refers-to")
        return record_key(f["warc-record-id"]), f["warc-record-id"], f.get("warc-target-uri"), f["warc-type"].lower(), x["payload"], x["length"], x["digest"], x["kind"], record_key(refers), refers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), RECORD.values(),
                strict=True)], names=list(RECORD))

        for batch in batches:
            for item in batch.column(0):
                rows, size = [], 0
                for record in frames(item.as_py() or b""):
                    rows.append(row(parse(record)))
                    size += len(rows[-1][4])
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return map_arrow(archives.select(content), run, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, archived and read back.

    Null html is an empty payload; long pages are records like others, whole in one frame. Rows that repeat a page_id with
    an equal payload are all responses if that id is the smallest (else all revisits); a null page_id never is the
    smallest unless all are null. An empty table gives no rows; further columns of the table aren't read.
    """
    path = new_folder(spark, "warc")
    rows = with_types(table(spark, sf_dir, "pages"))
    write_archives(rows, path, dictionary_of(table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("payload"))))
    back = read_archives(spark.read.schema("archive string, content binary").parquet(path))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM r
"""
