"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id: range bounds are quantiles of a sample
that depends on the ids alone (smallest hashes), so the same table always
gives the same files, byte for byte. Each task streams its range, compresses
every record as a gzip member of its own, regenerates headers and digests and
starts a new file when the compressed size reaches ``roll_bytes``.

Files are written under temporary names that differ for each task attempt;
only names reported by attempts that succeeded are renamed, and the manifest
is written last. A reader trusts the manifest alone, so lost executors and
repeated attempts leave nothing half-written behind.

Of records with equal payloads (of at least ``least_revisit`` bytes) those
with the smallest page id are responses, the others revisit it. Which records
revisit is found on digests; each payload crosses the network once.

Defined results: a null payload is empty; a null page id sorts last and is
read back as null; a null url is left out; repeated rows give repeated
records (repetitions of the smallest id are all responses); control and
non-ASCII characters of a url are percent-encoded; an empty table gives an
empty manifest; extra columns are ignored. ``out_dir`` is on a file system
that pyarrow can open (file, s3, gs, hdfs) and all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm.common import cut, python_path, settled

NO_ID = (1 << 63) - 1
#: Payload bytes of a range, ranges at most (a bound on parallelism, not on rows), and sampled ids per range.
RANGE_BYTES, MOST_RANGES, SAMPLE_PER_RANGE = 32 << 20, 20_000, 40
MANIFEST = "_manifest"
_CRLF = b"\r\n"
_MANIFEST_SCHEMA = "name string, temporary string, bytes long, records long, sha256 string"


def open_fs(uri: str):
    """(file system, path) of a uri; local paths too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def base32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record_id(page_id: int | None, digest_hex: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest_hex}')}>"


def safe_url(url: str) -> str:
    from urllib.parse import quote

    return quote(url, safe="".join(map(chr, range(0x21, 0x7F))))


def build_record(page_id: int | None, url: str | None, payload: bytes, digest_hex: str, revisits: bool, refers: int | None, date: str) -> bytes:
    """One WARC record (uncompressed). ``digest_hex`` is the payload's SHA-1."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if revisits else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisits else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest_hex)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32(digest_hex)}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {safe_url(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisits:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers, digest_hex)}")
        if refers is not None:
            head.append(f"X-Refers-To-Page-Id: {refers}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2


def info_record(name: str, date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}",
            f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2


def member(record: bytes) -> bytes:
    """A gzip member without time stamp, hence the same every time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


class _Shards:
    """The files of one range: rolls by compressed size."""

    def __init__(self, out_dir: str, part: int, roll_bytes: int, date: str):
        self.fs, self.root = open_fs(out_dir)
        self.part, self.roll, self.date, self.no, self.file = part, roll_bytes, date, 0, None

    def add(self, data: bytes) -> dict | None:
        """Append a member; returns the row of a file that this one closed."""
        closed = self.close() if self.file and self.size + len(data) > self.roll else None
        if not self.file:
            self.name = f"range-{self.part:05d}-{self.no:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.file = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.size, self.records, self.sha = 0, 0, hashlib.sha256()
            self._put(member(info_record(self.name, self.date)))
        self._put(data)
        self.records += 1
        return closed

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> dict | None:
        if not self.file:
            return None
        self.file.close()
        self.file, self.no = None, self.no + 1
        return {"name": self.name, "temporary": self.temporary, "bytes": self.size, "records": self.records, "sha256": self.sha.hexdigest()}


def ranges_of(pages: DataFrame) -> list[int]:
    """Ascending bounds of the ranges, the same for the same rows."""
    total = pages.agg(F.sum("size")).first()[0] or 0
    n = min(MOST_RANGES, -(-total // RANGE_BYTES))
    if n < 2:
        return []
    sample = pages.select("pid", F.xxhash64("pid", "digest").alias("h")).orderBy("h", "pid").limit(n * SAMPLE_PER_RANGE)
    ids = sorted(r.pid for r in sample.collect())
    return sorted({ids[len(ids) * i // n] for i in range(1, n)})


def write_warc(pages: DataFrame, out_dir: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               roll_bytes: int = 64 << 20, least_revisit: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the archives and return the committed manifest."""
    spark = pages.sparkSession
    python_path(spark)
    fs, root = open_fs(out_dir)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    rows = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("pid"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    keys = cut(rows.select("pid", "digest", "size"), "warc-keys")
    first = keys.where(F.col("size") >= least_revisit).groupBy("digest").agg(F.min("pid").alias("first"), F.max("pid").alias("last"))
    first = cut(first.where("first < last").select("digest", "first"), "warc-first")
    revisits = keys.join(first, "digest").where("pid > first").select("pid", "digest", F.col("first").alias("refers")).distinct()

    bounds = F.lit(ranges_of(keys)).cast("array<bigint>")
    part = F.size(F.filter(bounds, lambda b: b <= F.col("pid"))).cast("int").alias("part")
    # A marker row sorts just before the records that it makes revisits.
    marks = revisits.select(part, "pid", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"),
                            F.lit(None).cast("binary").alias("payload"), "refers")
    body = rows.select(part, "pid", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("refers"))
    n = keys.sparkSession.range(1).select(F.size(bounds) + 1).first()[0]
    dealt = marks.unionAll(body).repartitionById(n, F.col("part")).sortWithinPartitions("part", "pid", "digest", "kind", "url")

    def write(batches) -> Iterator:
        import pyarrow as pa

        shards, key, refers = None, None, None
        schema = pa.schema([("name", pa.string()), ("temporary", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])
        done: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                part, pid, digest, kind = (batch.column(c)[i].as_py() for c in range(4))
                if kind == 0:
                    key, refers = (pid, digest), batch.column(6)[i].as_py()
                    continue
                if shards is None or shards.part != part:
                    if shards is not None:
                        done.append(shards.close())
                    shards = _Shards(out_dir, part, roll_bytes, date)
                again = key == (pid, digest)
                real = lambda x: None if x == NO_ID else x
                record = build_record(real(pid), batch.column(4)[i].as_py(), batch.column(5)[i].as_py(), digest, again, real(refers) if again else None, date)
                if closed := shards.add(member(record)):
                    done.append(closed)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if shards is not None:
            yield pa.RecordBatch.from_pylist([shards.close()], schema)

    written = cut(dealt.mapInArrow(settled(write), _MANIFEST_SCHEMA), "warc-written")

    def commit(batches) -> Iterator:
        from pyarrow import fs as pafs

        fs, root = open_fs(out_dir)
        for batch in batches:
            for r in batch.to_pylist():
                there = fs.get_file_info([f"{root}/{r['temporary']}"])[0]
                if there.type == pafs.FileType.File:
                    fs.move(f"{root}/{r['temporary']}", f"{root}/{r['name']}")
                # A repeated attempt finds the file already in place.
                found = fs.get_file_info([f"{root}/{r['name']}"])[0]
                if found.type != pafs.FileType.File or found.size != r["bytes"]:
                    raise OSError(f"{r['name']} was not committed")
            yield batch

    written.mapInArrow(settled(commit), _MANIFEST_SCHEMA).drop("temporary").write.parquet(f"{out_dir}/{MANIFEST}")
    fs.delete_dir(f"{root}/_temporary")
    return spark.read.parquet(f"{out_dir}/{MANIFEST}")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one decompressed at a time."""
    data = b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            return
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            out.append(z.decompress(data))
            data = z.unused_data
            if not z.eof:
                data = stream.read(chunk)
                if not data:
                    raise OSError("truncated member")
        yield b"".join(out)


def parse_record(record: bytes) -> dict:
    """Header fields and block of one record; digests are checked."""
    head, _, rest = record.partition(_CRLF * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != _CRLF * 2:
        raise ValueError("record length differs")
    out = {"type": fields["WARC-Type"]}
    if out["type"] == "warcinfo":
        return out
    if fields["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(_CRLF * 2)
    size = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if out["type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload differs from its digest")
    number = lambda x: int(fields[x]) if x in fields else None
    return out | {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload": payload if out["type"] == "response" else None,
                  "payload_bytes": size, "payload_digest": digest, "refers_to": number("X-Refers-To-Page-Id")}


def read_warc(spark: SparkSession, out_dir: str, *, with_payload: bool = True) -> DataFrame:
    """All records of the committed archives; every digest is checked."""
    python_path(spark)
    manifest = spark.read.parquet(f"{out_dir}/{MANIFEST}").select("name")
    files = max(1, manifest.count())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def read(batches) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        typed = pa.schema(list(zip(names, kinds)))
        fs, root = open_fs(out_dir)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    rows, held = [], 0
                    for record in members(stream):
                        r = parse_record(record)
                        if r["type"] == "warcinfo":
                            continue
                        r["record_type"] = r["type"]
                        rows.append({k: r[k] for k in names})
                        held += len(record)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, typed)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, typed)

    return manifest.repartition(min(files, 100_000)).mapInArrow(settled(read), schema)
