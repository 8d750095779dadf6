"""WARC: a deterministic sharded writer, and a reader.

Writing: records are sorted by page identifier and cut into ranges at splitters taken from a hashed sample of bounded
size per shard, so shard limits don't depend on how the input is partitioned; an identifier that fills several ranges
(null, say) is dealt among them in order of digest. A task writes its shards in order, each
record as a gzip member of its own, and starts a new file when the compressed size of the present one reaches
ROLL_BYTES. Headers and digests are made anew from the payload. A file is written under a temporary name and renamed
when whole; its name and contents depend on the records alone, so a repeated task writes the same again. The manifest,
a Parquet table of file, records, bytes and digest that is written last, says which files count.

Of records with equal payloads (of at least `revisit_from` bytes) that with the smallest identifier is the response; the
others are revisit records that refer to it and hold no payload.

Reading: each task streams whole files that the manifest lists, checks each file's digest, each record's length and
each response's payload digest.

Defined results: null html is an empty payload; a null identifier sorts last and refers or is referred to by none
unless its payload has another identifier; rows that share both payload and smallest identifier are all responses;
an empty table gives an empty manifest; columns other than the identifier, url and html are not written.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lookup, new_path, partitions, stage

SHARD_BYTES = 16 << 20
ROLL_BYTES = 8 << 20
#: With more shards than that, shards grow instead; the splitters' sample, SAMPLES a shard, so stays under 10 MB.
MOST_SHARDS = 65_536
SAMPLES = 16
NULL_ID = 2**63 - 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1: each five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url", revisit_from: int = 0) -> DataFrame:
    """id, url, payload, digest, type and refers_to for each page."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    light = rows.select("digest", "bytes", "id")
    firsts = stage(light.groupBy("digest", "bytes").agg(F.min("id").alias("first"), F.count("*").alias("__n")).where(F.col("__n") > 1), "warc-firsts")
    # only payloads that occur again are looked up, hot ones by broadcast
    found = lookup(rows, firsts, ["digest", "bytes"], "__n", pages.count()).drop("__n")
    again = (F.col("first") < F.coalesce("id", F.lit(2**63 - 1))) & (F.col("bytes") >= revisit_from)
    return found.select("id", "url", "payload", "digest", "bytes", F.when(again, "revisit").otherwise("response").alias("type"), F.when(again, F.col("first")).alias("refers_to"))


def _member(row: dict) -> bytes:
    payload = row["payload"] if row["type"] == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
    block = http + payload
    name = "null" if row["id"] is None else row["id"]
    head = ["WARC/1.1", f"WARC-Type: {row['type']}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + "".join(quote(c) if c.isspace() else c for c in row["url"]))
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"WARC-Payload-Digest: sha1:{row['digest']}")
    head.append("WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode())
    if row["type"] == "revisit":
        head += [f"WARC-Refers-To: <urn:x-page:{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member; zlib writes no time into its header
    return z.compress(data) + z.flush()


class _File:
    """A file under a temporary name until it is closed."""

    def __init__(self, fs, folder: str, name: str):
        import uuid

        self.fs, self.final, self.name = fs, f"{folder}/{name}", name
        self.temporary = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp"
        self.out, self.sha, self.records, self.bytes = fs.open_output_stream(self.temporary, compression=None), hashlib.sha256(), 0, 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.records += 1
        self.bytes += len(data)

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temporary, self.final)
        return {"file": self.name, "records": self.records, "bytes": self.bytes, "sha256": self.sha.hexdigest()}


def _writer(uri: str, roll_bytes: int):
    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(uri)
        fs.create_dir(folder, recursive=True)
        now, shard, number, done = None, None, 0, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if now and (row["shard"] != shard or now.bytes >= roll_bytes):
                        done.append(now.close())
                        now = None
                    number = number + 1 if row["shard"] == shard and now is None else 0 if row["shard"] != shard else number
                    if now is None:
                        shard = row["shard"]
                        now = _File(fs, folder, f"part-{shard:06d}-{number:05d}.warc.gz")
                    now.write(_member(row))
        if now:
            done.append(now.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return run


def write(rows: DataFrame, uri: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the records under uri and return the manifest, which is kept as the table uri/manifest."""
    spark = rows.sparkSession
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shards = max(1, min(n, MOST_SHARDS, -(-size // shard_bytes)))
    # splitters: identifiers of the pages with the smallest hashes, some SAMPLES a shard; rows repeated whole count once
    page = F.coalesce("id", F.lit(NULL_ID)).alias("id")
    least = F.shiftrightunsigned(F.xxhash64("id", "digest"), 33).cast("double") / float(1 << 31) <= SAMPLES * shards / max(n, 1)
    ids = np.sort(rows.where(least).select(page, "digest").distinct().select("id").toArrow()["id"].to_numpy())
    cuts = np.array([ids[len(ids) * i // shards] for i in range(1, shards)] if len(ids) else [], np.int64)
    digits = np.zeros(256, np.int64)
    digits[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", np.uint8)] = np.arange(32)

    def shard_of(batches):
        for batch in batches:
            at = batch.column("id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(cuts, at, "left"), np.searchsorted(cuts, at, "right")
            lead = np.array(pc.utf8_slice_codeunits(batch.column("digest"), 0, 4).to_pylist(), "S4").view(np.uint8).reshape(-1, 4)
            share = (digits[lead] * [32**3, 32**2, 32, 1]).sum(1) * (high - low + 1) // 32**4
            yield batch.append_column("shard", pa.array((low + share).astype(np.int32)))

    kinds = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())])
    order = ["shard", F.col("id").asc_nulls_last(), "digest", "url"]
    dealt = rows.mapInArrow(shard_of, kinds).repartition(min(4 * shards, 10 * partitions(spark)), "shard").sortWithinPartitions(*order)
    dealt.mapInArrow(_writer(uri, roll_bytes), MANIFEST).write.parquet(f"{uri}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def _members(stream, sha):
    """The contents of the gzip members of a stream, one after the other."""
    z, out, rest = zlib.decompressobj(31), [], b""
    while True:
        chunk = rest or stream.read(1 << 17)
        if not rest:
            sha.update(chunk)
        if not chunk:
            if out:
                raise ValueError("a record is cut off")
            return
        out.append(z.decompress(chunk))
        rest = b""
        if z.eof:
            rest = z.unused_data
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []


def parse(record: bytes) -> dict:
    """A record's fields; its length, digests and blank lines are checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block, tail = rest[:-4], rest[-4:]
    if not lines[0].startswith("WARC/") or tail != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("not a whole WARC record")
    if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"]:
        raise ValueError("a block doesn't fit its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != declared or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload doesn't fit its digest")
    number = lambda x: None if x in (None, "<urn:x-page:null>") else int(x[len("<urn:x-page:") : -1])
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": payload, "payload_bytes": declared, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To"))}


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(uri: str, with_payload: bool):
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for entry in batch.to_pylist():
                rows, held, n, sha = [], 0, 0, hashlib.sha256()
                with fs.open_input_stream(f"{folder}/{entry['file']}", compression=None) as stream:
                    for member in _members(stream, sha):
                        row = parse(member)
                        n += 1
                        held += len(row["payload"])
                        rows.append(row if with_payload else row | {"payload": None})
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                if n != entry["records"] or sha.hexdigest() != entry["sha256"]:
                    raise ValueError(f"{entry['file']} doesn't fit the manifest")

    return run


def read(spark: SparkSession, uri: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest under uri lists."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")
    return manifest.repartition(partitions(spark), "file").mapInArrow(_reader(uri, with_payload), READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write an archive of all pages in the shared folder and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    uri = new_path(spark, "warc")
    write(records(pages), uri)
    return read(spark, uri, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
