"""Media columns over a store of content-defined chunks.

A text's payload is its UTF-8 bytes and zeros up to a multiple of 64, kept as the 8-bit samples of a mono WAV file. The
file is cut where a rolling gear hash of the last 32 bytes has its top bits clear, so equal passages give equal chunks
wherever they stand. A store holds each chunk once, by digest; an ordered list of digests rebuilds a file, whose
SHA-256 must be the one that was recorded.

The store is a table bucketed by digest: chunk lists meet it without its bytes being shuffled again. Files of one chunk
are rebuilt where the chunk lies, only the others' chunks are brought together. Equal files are rebuilt once. Chunks of
many files are handed out in copies, one for SERVED files, so that no task serves them all.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, freed, mapped, small, table

UNIT, RATE, HEADER = 64, 8_000, 44
#: Bytes of a chunk: the least, the most, and the number of clear bits that end one (4 KiB beyond the least, on average).
LEAST, MOST, CLEAR = 1_024, 32_768, 12
#: A number for each byte value.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)
#: Bytes that are hashed at a time.
AT_ONCE = 4 << 20
#: Digests that a task remembers, to pass a chunk on once.
REMEMBERED = 200_000
#: Files that one copy of a chunk serves; a chunk of more files is handed out in more copies. Bytes of a bucket, about.
SERVED, BUCKET = 4_096, 256 << 20


def wav(payload: bytes) -> bytes:
    """A WAV file of one channel with the payload as its unsigned 8-bit samples."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def gear(data: np.ndarray) -> np.ndarray:
    """Sum of GEAR[byte] << age over the last 32 bytes, at each byte; it is doubled up from windows of 1."""
    out = GEAR[data]
    for w in (1, 2, 4, 8, 16):
        wider = out.copy()
        wider[w:] += out[:-w] << np.uint32(w)
        out = wider
    return out


def chunks(files: list[bytes]) -> list[list[bytes]]:
    """Each file's chunks. LEAST exceeds the window, so what stands before a file doesn't matter."""
    marks = np.flatnonzero(gear(np.frombuffer(b"".join(files), np.uint8)) >> np.uint32(32 - CLEAR) == 0).tolist() if files else []
    out, start = [], 0
    for file in files:
        own, at, end = [], 0, len(file)
        while end - at > LEAST:
            k = bisect_left(marks, start + at + LEAST - 1)
            to = min(end, at + MOST, marks[k] + 1 - start if k < len(marks) else end)
            own.append(file[at:to])
            at = to
        if at < end:
            own.append(file[at:])
        out.append(own)
        start += end
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about AT_ONCE characters at a time."""
    for batch in batches:
        ids, own, size = [], [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids.append(doc_id.as_py())
            own.append(text.as_py() or "")
            size += len(own[-1])
            if size > AT_ONCE:
                yield ids, own
                ids, own, size = [], [], 0
        yield ids, own


def manifests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media_bytes, media (SHA-256 of the file), digests (of its chunks, in order) of each row.

    Null and empty texts are a file of 64 zeros; repeated rows and ids give a row each; ids may be null; an empty table
    gives no rows; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, texts in grouped(batches):
            files = [wav(payload(x)) for x in texts]
            yield {"doc_id": ids, "n_bytes": [len(x.encode("utf-8", "surrogatepass")) for x in texts], "media_bytes": list(map(len, files)), "media": [hashlib.sha256(x).digest() for x in files], "digests": [list(map(digest, x)) for x in chunks(files)]}

    types = pa.schema([("doc_id", to_arrow_type(kind)), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media", pa.binary()), ("digests", pa.list_(pa.binary()))])
    return mapped(own, rows, f"doc_id {kind.simpleString()}, n_bytes long, media_bytes long, media binary, digests array<binary>", types)


def store(docs: DataFrame, name: str, text_col: str = "text", size: int = 0) -> DataFrame:
    """Writes the table `name` (digest, bytes as zstd) with each distinct chunk of the documents once, and reads it.

    size: bytes of all files, from which the number of buckets comes. Nulls and repeats as in manifests(); an empty table
    gives an empty store.
    """
    spark = docs.sparkSession
    own = docs.select(F.lit(0).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        packer, seen = zstandard.ZstdCompressor(level=3), set()
        for _, texts in grouped(batches):
            found = {digest(c): c for own in chunks([wav(payload(x)) for x in texts]) for c in own}
            found = {d: c for d, c in found.items() if d not in seen}  # saves shuffling copies; what is left is dropped below
            if len(seen) > REMEMBERED:
                seen.clear()
            seen.update(found)
            yield {"digest": list(found), "bytes": list(map(packer.compress, found.values()))}

    every = mapped(own, rows, "digest binary, bytes binary", pa.schema([("digest", pa.binary()), ("bytes", pa.binary())]))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(50_000, -(-size // BUCKET)))
    once = every.repartition(n, "digest").dropDuplicates(["digest"])
    freed(spark, lambda: once.write.bucketBy(n, "digest").sortBy("digest").option("compression", "uncompressed").saveAsTable(name))
    return spark.table(name)


def rebuilt(lists: DataFrame, chunk_store: DataFrame, rows_of: Callable[[bytes, bytes], dict], schema: str, types: pa.Schema) -> DataFrame:
    """rows_of(media, file) for each distinct file of manifests, put together from the store and verified.

    lists must have a cut lineage. A chunk that the store lacks and a file with another SHA-256 than the recorded one are
    errors. No lists give no rows.
    """
    once = lists.select("media", "digests").dropDuplicates(["media"])
    parts = once.select("media", F.size("digests").alias("n"), F.posexplode("digests").alias("seq", "digest"))
    chunk_store = chunk_store.hint("shuffle_merge")
    hot = cut(parts.groupBy("digest").count().filter(F.col("count") > SERVED).select("digest", F.ceil(F.col("count") / SERVED).cast("int").alias("copies")))
    if not hot.limit(1).count():
        met = parts.join(chunk_store, "digest", "left")
    else:
        few = small(hot)
        placed = parts.join(few, "digest", "left")
        cold = placed.filter("copies IS NULL").drop("copies").join(chunk_store, "digest", "left")
        handed = chunk_store.join(few, "digest").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("digest", "copy", "bytes")
        asked = placed.filter("copies IS NOT NULL").withColumn("copy", F.pmod(F.xxhash64("media", "seq"), F.col("copies")).cast("int")).drop("copies")
        met = cold.unionByName(asked.join(handed.hint("shuffle_merge"), ["digest", "copy"], "left").drop("copy"))
    met = met.select("media", "seq", "n", "bytes")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        unpacker = zstandard.ZstdDecompressor()
        held: list[bytes] = []
        size = 0
        out: list[dict] = []
        for batch in batches:
            for media, seq, n, packed in zip(*batch.columns):
                if packed.as_py() is None or seq.as_py() != len(held):
                    raise ValueError(f"media {media.as_py().hex()} lacks chunk {len(held)}")
                held.append(unpacker.decompress(packed.as_py()))
                size += len(held[-1])
                if len(held) == n.as_py():
                    file = b"".join(held)
                    if hashlib.sha256(file).digest() != media.as_py():
                        raise ValueError(f"media {media.as_py().hex()} is damaged")
                    out.append(rows_of(media.as_py(), file))
                    held = []
                    if size > AT_ONCE:
                        yield {c: [x[c] for x in out] for c in types.names}
                        out, size = [], 0
        if held:
            raise ValueError("a file lacks its last chunks")
        yield {c: [x[c] for x in out] for c in types.names}

    several = met.filter("n > 1").repartition("media").sortWithinPartitions("media", "seq")
    return mapped(met.filter("n = 1"), rows, schema, types).union(mapped(several, rows, schema, types))


def samples(file: bytes) -> bytes:
    """The payload of a WAV file that wav() made."""
    size = struct.unpack_from("<I", file, HEADER - 4)[0]
    if file[:4] != b"RIFF" or size != len(file) - HEADER:
        raise ValueError("not a WAV file of this kind")
    return file[HEADER:]


def features(media: bytes, file: bytes) -> dict:
    """What is computed of a file that was read back."""
    own = samples(file)
    levels = np.frombuffer(own, np.uint8)
    above = levels >= 128
    text = f"wav/u8/{RATE};n={len(own)};min={levels.min()};max={levels.max()};sum={levels.sum(dtype=np.int64)};crossings={int((above[1:] != above[:-1]).sum())};distinct={len(np.unique(levels))}"
    return {"media": media, "payload_bytes": len(own), "payload_sha256": hashlib.sha256(own).digest(), "tail_crc32": zlib.crc32(own[-UNIT:]), "feature": text}


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the documents' payloads, reads them back, and gives a row of features for each row of docs.

    doc_id, n_bytes (of the text), payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes,
    media_sha256, feature. Null and empty texts are 64 zeros. Equal texts share chunks and values; repeated rows and ids
    give a row each; ids may be null. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    lists = cut(manifests(docs, id_col, text_col))
    name = f"media_chunks_{uuid4().hex}"
    types = pa.schema([("media", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.binary()), ("tail_crc32", pa.int64()), ("feature", pa.string())])
    try:
        size = lists.agg(F.sum("media_bytes")).first()[0] or 0
        found = cut(rebuilt(lists, store(docs, name, text_col, size), features, "media binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, feature string", types))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    out = lists.drop("digests").join(found, "media")
    lower = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", "n_bytes", "payload_bytes", lower("payload_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", lower("media").alias("media_sha256"), "feature")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(table(spark, sf_dir, "documents"))


def _le(number: object) -> str:
    """SQL for a number's four bytes in hexadecimal, the lowest first."""
    return "(" + " || ".join(f"lpad(to_hex((({number}) >> {shift}) & 255), 2, '0')" for shift in (0, 8, 16, 24)) + ")"


#: What the query returns, from the texts alone: no store, no chunks.
SQL = f"""
WITH t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS raw FROM documents),
p AS (SELECT doc_id, length(raw) // 2 AS n_bytes, greatest(1, ceil(length(raw) / 128.0))::BIGINT * 64 AS size, raw FROM d),
q AS (SELECT *, rpad(raw, (2 * size)::INT, '0') AS h FROM p),
l AS (SELECT *, list_transform(range(size), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) AS x FROM q),
m AS (SELECT *, '52494646' || {_le('36 + size')} || '57415645666D7420' || '10000000' || '01000100' || {_le(RATE)} || {_le(RATE)} || '01000800' || '64617461' || {_le('size')} || h AS media FROM l)
SELECT doc_id, n_bytes, size AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
  xor(list_reduce(x[size - 63:], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS tail_crc32, size + {HEADER} AS media_bytes, sha256(unhex(media)) AS media_sha256,
  'wav/u8/{RATE};n=' || size || ';min=' || list_min(x) || ';max=' || list_max(x) || ';sum=' || list_sum(x)::BIGINT || ';crossings=' || len(list_filter(range(1, size), lambda k: (x[k] >= 128) <> (x[k + 1] >= 128))) || ';distinct=' || list_unique(x) AS feature
FROM m, t"""
