"""A deterministic, sharded WARC writer with revisit records and a manifest, and the reader of what it wrote."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm._shared import hot_join, small, stored

#: A file is closed when its compressed size has reached this.
ROLL_BYTES = 64 << 20
#: Bytes of records (not compressed) that one task writes, unless there would be more than MAX_SHARDS tasks.
SHARD_BYTES, MAX_SHARDS = 32 << 20, 100_000
#: Compressed bytes of files that one task reads.
READ_BYTES = 16 << 20
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT = 0
#: Records of one exactly repeated row that stay together.
REPEATS = 100_000
#: Bytes of a record beside its payload, about.
_HEADER = 700
#: Fixed values of the format: all records carry this date, so that the same pages give the same bytes.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "file string, shard int, records long, bytes long, sha256 string"


def record_id(page_id: str | None, url: str, sha: str, n: int) -> str:
    """Of the n-th of equal rows; rows that differ in anything have different ones."""
    return f"<urn:page:{page_id or ''}:{hashlib.sha256(f'{sha} {url}'.encode()).hexdigest()[:24]}:{n}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, fields: list[str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *fields, f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    return (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")


def record(own: str, url: str, payload: bytes | None, size: int, payload_digest: str, refers_to: str = "", refers_url: str = "") -> bytes:
    """A response, or (without payload) a revisit that has the response's HTTP header alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    fields = [f"WARC-Record-ID: {own}", f"WARC-Target-URI: {_uri(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if payload is None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}", f"WARC-Refers-To-Target-URI: {_uri(refers_url)}"]
    return _record("response" if payload is not None else "revisit", fields, block)


def info_record(file: str) -> bytes:
    """The warcinfo record that begins a file."""
    return _record("warcinfo", [f"WARC-Record-ID: <urn:file:{file}>", f"WARC-Filename: {file}", "Content-Type: application/warc-fields"], b"software: larkspur\r\nformat: WARC File Format 1.1\r\n")


def _gzip(data: bytes) -> bytes:
    """One gzip member without name and time."""
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _order() -> list[Column]:
    return [F.col("id").asc_nulls_first(), F.col("h"), F.col("chunk")]


def _plan(rows: DataFrame, min_revisit: int, shard_bytes: int) -> tuple[DataFrame, int]:
    """Per distinct row (and lot of its repeats) what to write, and its shard; and the number of shards.

    Shards are cut where the running sum of record bytes, in order of id, passes a multiple: so they are a property of
    the pages and not of partitions. Rows here hold no payload.
    """
    keys = stored(rows.groupBy("id", "url", "sha", "n", "h").agg(F.count(F.lit(1)).alias("k")), "warc-keys")
    lead = keys.filter(F.col("n") >= min_revisit).groupBy("sha", "n").agg(F.max(F.struct("id", "url")).alias("lead"), F.sum("k").alias("alike"))
    lead = stored(lead.filter("alike > 1"), "warc-responses")
    info = hot_join(keys, lead, ["sha", "n"], "alike")
    mine = F.col("id").eqNullSafe(F.col("lead.id")) & (F.col("url") == F.col("lead.url"))
    responses = F.when(F.col("alike").isNull(), F.col("k")).when(mine, 1).otherwise(0)
    info = info.select("id", "url", "sha", "n", "h", "k", responses.alias("responses"), F.col("lead.id").alias("lead_id"), F.col("lead.url").alias("lead_url"))
    lots = F.when(F.col("responses") <= 1, F.expr(f"(k - 1) div {REPEATS}")).otherwise(0).cast("int")
    info = info.withColumn("chunk", F.explode(F.sequence(F.lit(0), lots)))
    last = F.col("chunk") == lots
    info = info.withColumns({"first": (F.col("chunk") * REPEATS).cast("long"), "count": F.when(last, F.col("k") - F.col("chunk") * REPEATS).otherwise(REPEATS).cast("long")})
    size = F.col("count") * _HEADER + F.when(F.col("chunk") == 0, F.col("responses") * F.col("n")).otherwise(0)
    placed = stored(info.withColumn("size", size).repartitionByRange(*_order()).withColumn("part", F.spark_partition_id()), "warc-order")
    parts = sorted(tuple(r) for r in placed.groupBy("part").agg(F.sum("size")).collect())  # a row per shuffle partition
    before, total = [], 0
    for part, held in parts:
        before.append((part, total))
        total += held
    per = max(shard_bytes, -(-total // MAX_SHARDS), 1)
    starts = F.broadcast(rows.sparkSession.createDataFrame(before, "part int, before long"))
    at = F.col("before") + F.sum("size").over(Window.partitionBy("part").orderBy(*_order())) - 1
    return stored(placed.join(starts, "part").withColumn("shard", F.floor(at / per).cast("int")).drop("part", "before"), "warc-plan"), max(1, -(-total // per))


def _place() -> list[Column]:
    """id as two numbers that are never null, and h."""
    return [F.col("id").isNotNull().cast("long").alias("has"), F.coalesce("id", F.lit(0)).alias("id"), F.col("h")]


def _sort_key(has: pd.Series, id: pd.Series, h: pd.Series) -> np.ndarray:
    """Bytes in the order of id, null first, and h."""
    low = np.uint64(1 << 63)
    out = np.stack([x.to_numpy(np.int64).view(np.uint64) ^ low for x in (has, id, h)], axis=1).astype(">u8")
    return np.ascontiguousarray(out).view("S24").ravel()


def write(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", roll_bytes: int = ROLL_BYTES, min_revisit: int = MIN_REVISIT, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes a record per page to path and returns the manifest, also kept in path/manifest.

    Of pages with equal payloads (UTF-8; null: empty) of min_revisit bytes or more, the one of the largest id, then
    url, is the response and the others revisit it. Records are range-sorted by id (null first, then url and digest) and cut into shards
    by their bytes in that order; a task writes a shard under a temporary name, in files that it closes at roll_bytes,
    and moves each to a name of shard and number. So the same pages give the same files, whatever the partitions, and
    an attempt that is repeated replaces what a lost one had left. Only files that the manifest lists belong to the
    archive; it is written last, and what is left under temporary names is deleted after.

    Rows of one id and different payloads are records of their own. Of exactly repeated rows each is written; one at
    most is the response. Rows without an id are written and read back without one. A null or empty url is
    about:blank. Other columns are left out, whatever their names. An empty table gives an empty manifest.
    """
    rows = pages.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumns({"n": F.octet_length("html").cast("long"), "sha": F.sha1(F.encode("html", "UTF-8"))}).withColumn("h", F.xxhash64("url", "sha"))
    info, shards = _plan(rows.drop("html"), min_revisit, shard_bytes)
    cuts = info.filter("chunk = 0").groupBy("shard").agg(F.min(F.struct(*_place())).alias("at")).select("shard", "at.*").toPandas().sort_values("shard")  # MAX_SHARDS rows at most
    sent = rows.sparkSession.sparkContext.broadcast((_sort_key(cuts["has"], cuts["id"], cuts["h"]), cuts["shard"].to_numpy(np.int32)))

    @F.pandas_udf(T.IntegerType())
    def shard_of(has: pd.Series, id: pd.Series, h: pd.Series) -> pd.Series:
        starts, shard = sent.value
        return pd.Series(shard[np.searchsorted(starts, _sort_key(has, id, h), "right") - 1])

    repeated = stored(info.filter("k > 1").select("id", "url", "sha").distinct(), "warc-repeated")
    once = rows
    if not repeated.isEmpty():  # one payload of equal rows is enough
        marks = small(repeated.select(F.xxhash64("id", "url", "sha").alias("mark")).distinct())
        marked = rows.withColumn("mark", F.xxhash64("id", "url", "sha"))
        once = marked.join(marks, "mark", "left_anti").select(rows.columns).unionByName(marked.join(marks, "mark", "left_semi").select(rows.columns).dropDuplicates(["id", "url", "sha"]))
    payloads = once.select("id", "url", "sha", "h", "html", shard_of(*_place()).alias("shard")).withColumn("chunk", F.lit(-1))
    both = payloads.unionByName(info.drop("k", "size"), allowMissingColumns=True)
    ordered = both.repartitionById(shards, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "h", "url", "sha", "chunk")
    ordered = ordered.select("shard", F.col("id").cast("string").alias("id"), "url", "sha", "html", "chunk", "n", "responses", "first", "count", F.col("lead_id").cast("string").alias("lead_id"), "lead_url")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = None
        for pdf in batches:
            for shard, page_id, address, sha, text, chunk, size, responses, first, count, lead_id, lead_url in zip(*(pdf[c] for c in pdf.columns), strict=True):
                if chunk < 0:
                    payload = text.encode("utf-8", "replace")
                    continue
                if made is None or made.shard != shard:
                    if made is not None:
                        yield from made.close()
                    made = _Shard(path, int(shard), roll_bytes)
                bare = base64.b32encode(bytes.fromhex(sha)).decode()
                target = (record_id(lead_id, lead_url, sha, 0), lead_url) if lead_url is not None else ("", "")
                for n in range(int(first), int(first + count)):
                    yield from made.add(record(record_id(page_id, address, sha, n), address, payload if n < responses else None, int(size), bare, *target))
        if made is not None:
            yield from made.close()

    ordered.mapInPandas(run, _MANIFEST).write.parquet(f"{path}/manifest")
    store, root = _store(path)
    if store.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/_temporary")
    return pages.sparkSession.read.parquet(f"{path}/manifest")


class _Shard:
    """The files of one shard, one open at most; finished ones are yielded as rows of the manifest."""

    def __init__(self, path: str, shard: int, roll_bytes: int):
        self.store, self.root = _store(path)
        self.own, self.shard, self.roll, self.files, self.out = f"{self.root}/_temporary/{uuid.uuid4().hex}", shard, roll_bytes, 0, None
        self.store.create_dir(self.own, recursive=True)

    def _put(self, data: bytes) -> None:
        member = _gzip(data)
        self.out.write(member)
        self.sha.update(member)
        self.bytes += len(member)

    def add(self, data: bytes) -> Iterator[pd.DataFrame]:
        if self.out is None:
            self.name = f"pages-{self.shard:06d}-{self.files:04d}.warc.gz"
            self.out, self.sha, self.records, self.bytes = self.store.open_output_stream(f"{self.own}/{self.name}", compression=None), hashlib.sha256(), 0, 0
            self._put(info_record(self.name))
        self._put(data)
        self.records += 1
        if self.bytes >= self.roll:
            yield self._finish()

    def _finish(self) -> pd.DataFrame:
        self.out.close()
        self.store.move(f"{self.own}/{self.name}", f"{self.root}/{self.name}")
        self.out, self.files = None, self.files + 1
        return pd.DataFrame([(self.name, self.shard, self.records, self.bytes, self.sha.hexdigest())], columns=["file", "shard", "records", "bytes", "sha256"])

    def close(self) -> Iterator[pd.DataFrame]:
        if self.out is not None:
            yield self._finish()
        self.store.delete_dir(self.own)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def records(data) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of each record of an open file, read member by member."""
    rest = b""
    while True:
        member, inflate = [], zlib.decompressobj(31)
        while not inflate.eof:
            rest = rest or data.read(1 << 18)
            if not rest:
                if member:
                    raise ValueError("the file ends within a record")
                return
            member.append(inflate.decompress(rest))
            rest = inflate.unused_data
        head, _, body = b"".join(member).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
        yield fields, body[: int(fields["Content-Length"])]


def _page_id(said: str) -> int | None:
    number = said.removeprefix("<urn:page:").partition(":")[0]
    return int(number) if number else None


def read(spark: SparkSession, path: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, of all files that the manifest lists.

    The digests of blocks, and of the payloads of responses, are made anew and must be those of the header; so must
    the number of records be that of the manifest. A revisit's payload has the length and digest that its header says.
    As many tasks read as the files have read_bytes, each some of the files.
    """
    listed = spark.read.parquet(f"{path}/manifest").select("file", "shard", "records", "bytes")
    held = listed.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(held["files"], -(-held["bytes"] // read_bytes)))
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(path)
        for pdf in batches:
            for name, expected in zip(pdf["file"], pdf["records"], strict=True):
                out, seen = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as data:
                    for head, block in records(data):
                        kind = head["WARC-Type"]
                        if digest(block) != head["WARC-Block-Digest"].removeprefix("sha1:"):
                            raise ValueError(f"{name}: a digest is wrong")
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        if kind == "response" and (digest(payload) != said or len(payload) != size):
                            raise ValueError(f"{name}: a digest is wrong")
                        out.append((_page_id(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, _page_id(head["WARC-Refers-To"]) if kind == "revisit" else None, size, said))
                        seen += 1
                        if len(out) == 5000:
                            yield _frame(out)
                            out = []
                if seen != expected:
                    raise ValueError(f"{name}: {seen} records, the manifest says {expected}")
                yield _frame(out)

    return listed.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).select("file", "records").mapInPandas(run, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})
