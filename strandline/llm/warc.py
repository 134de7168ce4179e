"""Zstandard WARC archives: a writer and a reader.

An archive starts with a skippable frame that holds the dictionary; every record is a frame of its
own. Spark's text sink writes the frames, one archive per task: what stands between two rows is an
empty skippable frame, so the file is plain Zstandard. The reader loads the dictionary from the
leading frame, decodes frame by frame and validates headers and lengths of every record.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import map_arrow
from strandline.session import new_folder, settled

#: Fixed values of the format: magic numbers of the dictionary frame, of skippable frames and of Zstandard frames.
DICTIONARY, SKIPPABLE, FRAME = 0x184D2A5D, range(0x184D2A50, 0x184D2A60), 0xFD2FB528
#: An empty skippable frame; all its bytes are ASCII.
BETWEEN = "P*M\x18\x00\x00\x00\x00"
DICT_BYTES, DICT_SAMPLES = 16_384, 256
REVISIT_BYTES = 1000
#: Fixed values of the format: headers every record has, the profile of records that repeat a payload.
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, name: str, date: str) -> bytes:
    """One record; name tells it from all others, date is its WARC-Date."""
    kept = b"" if revisit else payload
    heads = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Page-Id", page_id),
             ("WARC-Target-URI", url and "".join(url.split())), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", len(payload)), ("WARC-Refers-To-Page-Id", refers_to),
             ("WARC-Profile", PROFILE if revisit else None), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(kept))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads if v is not None).encode() + b"\r\n" + kept + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; ValueError if it is malformed."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != "WARC/1.1" or any(": " not in x for x in lines[1:]):
        raise ValueError("malformed WARC header")
    heads = dict(x.split(": ", 1) for x in lines[1:])
    missing = [h for h in MANDATORY if h not in heads]
    if missing or heads["WARC-Type"] == "revisit" and "WARC-Profile" not in heads:
        raise ValueError(f"record without {', '.join(missing) or 'WARC-Profile'}")
    length = int(heads["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("record length differs from Content-Length")
    block = rest[:length]
    if heads["WARC-Type"] == "response" and (hashlib.sha1(block).hexdigest() != heads["WARC-Payload-Digest"][5:] or length != int(heads["WARC-Payload-Length"])):
        raise ValueError("payload differs from its digest")
    return heads, block


def frames(data: bytes):
    """The decoded records of one archive."""
    import zstandard

    view, at, codec = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY:
        size = struct.unpack_from("<I", data, 4)[0]
        words = data[8 : 8 + size]
        if words[:4] == struct.pack("<I", FRAME):  # a dictionary may be compressed itself
            words = zstandard.ZstdDecompressor().decompressobj().decompress(words)
        codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if size else None)
        at = 8 + size
    codec = codec or zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("truncated archive")
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError("not a Zstandard frame")
        one, parts = codec.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("truncated frame")
            chunk = view[at : at + 65_536]
            parts.append(one.decompress(chunk))
            at += len(chunk)
        at -= len(one.unused_data)
        yield b"".join(parts)


def _write(date: str):
    def run(batches):
        import zstandard

        codec, part, n = None, TaskContext.get().partitionId(), 0
        for batch in batches:
            raws = []
            for r in batch.to_pylist():
                raws.append(record(r["id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["sha"], r["refers"], r["revisit"], f"{r['id']} {r['sha']} {part} {n}", date))
                n += 1
            out = []
            if codec is None and raws:
                samples = [x[:8192] for x in raws[:DICT_SAMPLES]]
                try:
                    words = zstandard.train_dictionary(DICT_BYTES, samples)
                except zstandard.ZstdError:  # too few samples: their text itself serves
                    words = zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:])
                plain = words.as_bytes()
                codec = zstandard.ZstdCompressor(dict_data=words, write_checksum=True)
                out.append(struct.pack("<II", DICTIONARY, len(plain)) + plain)
            out += [codec.compress(x) for x in raws]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return run


def _read(batches):
    for batch in batches:
        for data in batch.column("content").to_pylist():
            rows = []
            for raw in frames(data):
                h, block = parse(raw)
                num = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                rows.append({"page_id": num("WARC-Page-Id"), "url": h.get("WARC-Target-URI"), "payload_bytes": int(h["WARC-Payload-Length"]), "payload_digest": h["WARC-Payload-Digest"][5:], "record_type": h["WARC-Type"], "refers_to": num("WARC-Refers-To-Page-Id"), "payload": block})
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=OUT)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=OUT)


OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def write_archives(pages: DataFrame, folder: str, ident: str = "page_id", url: str = "url", body: str = "html", date: str | None = None) -> None:
    """A record per row of pages. A null html is an empty payload, null ids and urls are left out, white space in urls is dropped.

    Of equal payloads of REVISIT_BYTES and more the row with the largest id (then url) is the response, the
    others revisit it. Only digests that recur are looked up, html itself stays in its partition while their
    table is small enough to be broadcast. Of repeated rows, which nothing tells apart, one is the response: these
    are written once to get an identity. date is the WARC-Date (default: now). An archive holds what one input partition does.
    """
    payload = F.coalesce(F.col(body), F.lit(""))
    rows = pages.select(F.col(ident).cast("long").alias("id"), F.col(url).alias("url"), F.col(body).alias("html"), F.sha1(payload.cast("binary")).alias("sha"), F.octet_length(payload).alias("len"))
    long = F.col("len") >= REVISIT_BYTES
    same = rows.where(long).groupBy("sha", "len", "id", "url").agg(F.count("*").alias("n"))
    best = same.groupBy("sha", "len").agg(F.sum("n").alias("all"), F.max(F.struct("id", "url", "n")).alias("top")).where(F.col("all") > 1)
    known = settled(best.select(F.col("sha").alias("_sha"), F.col("len").alias("_len"), F.col("top.id").alias("refers"), F.col("top.url").alias("_url"), (F.col("top.n") > 1).alias("_ties")), "payloads")
    met = rows.join(known, (F.col("sha") == F.col("_sha")) & (F.col("len") == F.col("_len")), "left")
    top = F.col("_sha").isNotNull() & F.col("id").eqNullSafe(F.col("refers")) & F.col("url").eqNullSafe(F.col("_url"))
    columns = ["id", "url", "html", "sha", "refers", "revisit"]
    met = met.withColumn("revisit", F.col("_sha").isNotNull() & ~top).withColumn("_tied", top & F.col("_ties"))
    ready = met.where(~F.col("_tied")).select(*columns)
    if not known.where("_ties").isEmpty():
        tied = settled(met.where("_tied").select(*columns, F.monotonically_increasing_id().alias("_n")), "tied")
        first = settled(tied.groupBy("sha").agg(F.min("_n").alias("_n")).select("_n", F.lit(True).alias("_first")), "first")
        ready = ready.unionByName(tied.join(first, "_n", "left").withColumn("revisit", F.col("_first").isNull()).select(*columns))
    ready = ready.withColumn("refers", F.when(F.col("revisit"), F.col("refers")))
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    map_arrow(ready, _write(date), "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", BETWEEN).text(folder)


def read_archives(spark, folder: str) -> DataFrame:
    """The records of all archives in folder, with payloads; a malformed record fails the job."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return map_arrow(files, _read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    folder = new_folder(pages.sparkSession, "warc")
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder)
