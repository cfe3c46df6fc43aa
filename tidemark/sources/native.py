"""The embedded store's own files: write-ahead logs, value logs, tables, manifests, and a whole store's folder.

Files are cut at record or block borders into ranges of some `RANGE_BYTES`, and
each range is read by offset and decoded by a task of its own, in batches of
bounded size; no file is ever one value. A table's borders come from its index, those
of a log from a pass over its headers. The rows are then an ordinary DataFrame.
:func:`read_store` makes one version log of all families of a store's folder;
:func:`write_store` lays such a folder down from a version log.
"""

from __future__ import annotations

import base64
import json
import struct
import sys
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote, unquote

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions.hashing import bloom_bits_of
from tidemark.operators import storage, versions
from tidemark.sources.shared import bounded, materialize, scratch

for _module in (__name__, hashing.__name__):  # workers need not have this package
    cloudpickle.register_pickle_by_value(sys.modules[_module])

PUT, DELETE, BATCH = 1, 2, 3
MAGIC, VERSION = struct.pack(">I", 0x53434F52), 1
FOOTER, FOOTER_BYTES, TABLE_MAGIC = "<10Q", 80, 0x53434F5249415F53
BLOCK_BYTES = 16 * 1024
FILTER_BYTES = 1024
POINTER, POINTER_BYTES = ">QI", 12
#: Bytes of a file that one task decodes, but for the record that ends there.
RANGE_BYTES = 64 << 20
#: Rows and bytes of one batch from Python to the JVM.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20
LATEST = 2**64 - 1
_OPS = {PUT: "PUT", DELETE: "DELETE"}


class Corrupt(ValueError):
    """A checksum or length that doesn't fit."""


def encode_batch(ops: list[tuple[int, bytes, bytes]]) -> bytes:
    out = [struct.pack(">H", len(ops))]
    for op, key, value in ops:
        out.append(struct.pack(">BH", op, len(key)) + key + struct.pack(">I", len(value)) + value)
    return b"".join(out)


def decode_batch(data: bytes) -> list[tuple[int, bytes, bytes]]:
    (n,), at, out = struct.unpack_from(">H", data), 2, []
    for _ in range(n):
        op, size = struct.unpack_from(">BH", data, at)
        key, at = data[at + 3 : at + 3 + size], at + 3 + size
        (size,) = struct.unpack_from(">I", data, at)
        value, at = data[at + 4 : at + 4 + size], at + 4 + size
        out.append((op, key, value))
    return out


def encode_wal(op: int, ts: int, key: bytes, value: bytes) -> bytes:
    body = struct.pack(">BQHI", op, ts, len(key), len(value)) + key + value
    return body + struct.pack(">I", zlib.crc32(body))


def decode_wal(data: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    """Records (op, ts, key, value); a cut-off or damaged record is Corrupt, an end between records is the end."""
    at, head = 0, struct.Struct(">BQHI")
    while at < len(data):
        if at + head.size > len(data):
            raise Corrupt("cut off in a header")
        op, ts, k, v = head.unpack_from(data, at)
        end = at + head.size + k + v
        if end + 4 > len(data):
            raise Corrupt("cut off in a record")
        if zlib.crc32(data[at:end]) != struct.unpack_from(">I", data, end)[0]:
            raise Corrupt("checksum")
        yield op, ts, data[at + head.size : at + head.size + k], data[end - v : end]
        at = end + 4


def encode_vlog(values: list[bytes]) -> bytes:
    return MAGIC + struct.pack(">I", VERSION) + b"".join(struct.pack(">II", zlib.crc32(v), len(v)) + v for v in values)


def decode_vlog(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Values (offset, size, value); damaged ones are left out, one that is cut off ends the log."""
    if data[:4] != MAGIC:
        raise Corrupt("not a value log")
    at = 8
    while at + 8 <= len(data):
        crc, size = struct.unpack_from(">II", data, at)
        value = data[at + 8 : at + 8 + size]
        if len(value) < size:
            return
        if zlib.crc32(value) == crc:
            yield at, size, value
        at += 8 + size


def encode_pointer(offset: int, size: int) -> bytes:
    return struct.pack(POINTER, offset, size)


def decode_pointer(stored: bytes) -> tuple[int, int] | None:
    """(offset, size) if the stored value has a pointer's length; an inline value may have it too."""
    return struct.unpack(POINTER, stored) if len(stored) == POINTER_BYTES else None


def pointer_offset(stored: Column) -> Column:
    """The offset that a stored value of a pointer's length names, null for others and where it is beyond any file."""
    return F.when(F.octet_length(stored) == POINTER_BYTES, F.conv(F.hex(F.substring(stored, 1, 8)), 16, 10).try_cast("long"))


def pointer_size(stored: Column) -> Column:
    return F.when(F.octet_length(stored) == POINTER_BYTES, F.conv(F.hex(F.substring(stored, 9, 4)), 16, 10).try_cast("long"))


def table_parts(entries: Iterable[tuple[bytes, int, bytes]], block_bytes: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A table of sorted (key, ts, value), piece by piece: blocks, index, filter, least and greatest key, footer."""
    index: list[bytes] = []
    bits, block, first, at, n = bytearray(FILTER_BYTES), bytearray(), b"", 0, 0
    least = greatest = last = None
    for key, ts, value in entries:
        n += 1
        if key != last:
            for b in bloom_bits_of(key):
                bits[b >> 3] |= 1 << (b & 7)
            least, greatest, last = key if least is None else min(least, key), key if greatest is None else max(greatest, key), key
        full = struct.pack("<H", len(key)) + key + struct.pack("<Q", LATEST - ts)
        entry = struct.pack("<II", len(full), len(value)) + full + value
        if block and len(block) + len(entry) > block_bytes:
            index.append(struct.pack("<I", len(first)) + first + struct.pack("<Q", at))
            yield struct.pack("<I", len(block)) + block
            at, block = at + 4 + len(block), bytearray()
        if not block:
            first = full
        block += entry
    if block:
        index.append(struct.pack("<I", len(first)) + first + struct.pack("<Q", at))
        yield struct.pack("<I", len(block)) + block
        at += 4 + len(block)
    named = [struct.pack("<I", len(x or b"")) + (x or b"") for x in (least, greatest)]
    parts = [b"".join(index), struct.pack("<I", FILTER_BYTES) + bytes(bits), *named]
    places = [at]
    for part in parts:
        yield part
        places.append(places[-1] + len(part))
    yield struct.pack(FOOTER, places[0], len(parts[0]), places[1], len(parts[1]), n, TABLE_MAGIC, places[2], len(least or b""), places[3], len(greatest or b""))


def encode_table(entries: Iterable[tuple[bytes, int, bytes]], block_bytes: int = BLOCK_BYTES) -> bytes:
    return b"".join(table_parts(entries, block_bytes))


def table_bounds(read: Callable[[int, int], bytes], length: int) -> dict:
    """What a table tells of itself: number of entries, least and greatest key, filter, blocks' offsets and where the data end."""
    if length < FOOTER_BYTES:
        raise Corrupt("no footer")
    index, index_size, bloom, bloom_size, n, magic, least, least_size, greatest, greatest_size = struct.unpack(FOOTER, read(length - FOOTER_BYTES, FOOTER_BYTES))
    if magic != TABLE_MAGIC:
        raise Corrupt("not a table")
    data, at, blocks = read(index, index_size), 0, []
    while at < len(data):
        (k,) = struct.unpack_from("<I", data, at)
        blocks.append(struct.unpack_from("<Q", data, at + 4 + k)[0])
        at += 12 + k
    return {"n": n, "least": read(least + 4, least_size), "greatest": read(greatest + 4, greatest_size), "filter": read(bloom + 4, bloom_size - 4), "blocks": blocks, "end": index}


def decode_blocks(data: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    """Entries (key, ts, value) of blocks that follow each other; those that don't decode are skipped."""
    at, end = 0, len(data)
    while at + 4 <= end:
        (size,) = struct.unpack_from("<I", data, at)
        block, at = data[at + 4 : min(end, at + 4 + size)], at + 4 + size
        p = 0
        while p + 8 <= len(block):
            k, v = struct.unpack_from("<II", block, p)
            full, value = block[p + 8 : p + 8 + k], block[p + 8 + k : p + 8 + k + v]
            p += 8 + k + v
            if len(full) < k or len(value) < v or k < 10:
                continue
            (n,) = struct.unpack_from("<H", full)
            if n + 10 == k:
                yield full[2 : 2 + n], LATEST - struct.unpack_from("<Q", full, 2 + n)[0], value


def decode_table(data: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    return decode_blocks(data[: table_bounds(lambda at, n: data[at : at + n], len(data))["end"]])


class _Input:
    """A file read by offset, with a window for small reads that follow each other."""

    WINDOW = 1 << 20

    def __init__(self, path: str):
        from pyarrow import fs

        if path.startswith("file:") or path.startswith("/"):
            where, at = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            where, at = fs.FileSystem.from_uri(quote(path, safe=":/@"))
        self.file, self.begin, self.data = where.open_input_file(at), 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        if n > self.WINDOW:
            return self.file.read_at(n, at)
        if not (self.begin <= at and at + n <= self.begin + len(self.data)):
            self.begin, self.data = at, self.file.read_at(self.WINDOW, at)
        return self.data[at - self.begin : at - self.begin + n]

    def __enter__(self) -> _Input:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def _gathered(ends: Iterable[int], begin: int, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of at least `limit` bytes, but for the last, that end at given borders."""
    end = begin
    for end in ends:
        if end - begin >= limit:
            yield begin, end
            begin = end
    if end > begin:
        yield begin, end


def _wal_ends(read, length: int) -> Iterator[int]:
    at, head = 0, struct.Struct(">BQHI")
    while at < length:
        if at + head.size > length:
            raise Corrupt("cut off in a header")
        _, _, k, v = head.unpack(read(at, head.size))
        at += head.size + k + v + 4
        if at > length:
            raise Corrupt("cut off in a record")
        yield at


def _vlog_ends(read, length: int) -> Iterator[int]:
    if length < 8 or read(0, 4) != MAGIC:
        raise Corrupt("not a value log")
    at = 8
    while at + 8 <= length:
        at += 8 + struct.unpack(">I", read(at + 4, 4))[0]
        if at > length:
            return
        yield at


def _table_ends(read, length: int) -> Iterator[int]:
    bounds = table_bounds(read, length)
    yield from [b for b in (*bounds["blocks"], bounds["end"]) if b > 0]


def _wal_rows(data: bytes, begin: int) -> Iterator[tuple]:
    at = begin
    for op, ts, key, value in decode_wal(data):
        for seq, (o, k, v) in enumerate(decode_batch(value) if op == BATCH else [(op, key, value)]):
            yield at, ts, seq, _OPS[o], k, v if o == PUT else None
        at += 19 + len(key) + len(value)


def _vlog_rows(data: bytes, begin: int) -> Iterator[tuple]:
    for offset, size, value in decode_vlog(MAGIC + bytes(4) + data):
        yield offset + begin - 8, size, value


#: For each kind of file: where records begin, the borders between them, rows of a range, their schema.
_KINDS = {
    "wal": (0, _wal_ends, _wal_rows, "record long, commit_ts long, seq int, op string, key binary, value binary"),
    "vlog": (8, _vlog_ends, _vlog_rows, "offset long, size long, value binary"),
    "table": (0, _table_ends, lambda data, _: decode_blocks(data), "key binary, commit_ts long, value binary"),
}


def _decoded(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    import pyarrow as pa

    first, ends, rows, columns = _KINDS[kind]
    limit, most_rows, most_bytes = RANGE_BYTES, BATCH_ROWS, BATCH_BYTES
    files = spark.read.format("binaryFile").load(paths).select("path", "length")

    def ranges(batches):
        for batch in batches:
            for path, length in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                with _Input(path) as read:
                    for b, e in _gathered(ends(read, length), first, limit):
                        yield pa.RecordBatch.from_pydict({"path": [path], "begin": [b], "end": [e]})

    schema = spark.createDataFrame([], f"path string, {columns}").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def decode(batches):
        for batch in batches:
            for path, b, e in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with _Input(path) as read:
                    data = read(b, e - b)
                held, size = [], 0
                for row in rows(data, b):
                    held.append((path, *row))
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                    if len(held) >= most_rows or size >= most_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)

    cut = materialize(files.mapInArrow(ranges, "path string, begin long, end long"), "ranges")
    return cut.repartition(max(1, min(cut.count(), 100_000)), "path", "begin").mapInArrow(decode, schema)


def read_wal(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every op as a row: path, record (its offset), commit_ts, seq in a batch, op; keys and values are bytes. A cut-off or damaged record is an error."""
    return _decoded(spark, path, "wal")


def read_vlog(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _decoded(spark, path, "vlog")


def read_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _decoded(spark, path, "table")


def table_info(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What each table's footer, index and filter say, without its data: path, n_entries, min_key, max_key, n_blocks, and the filter's bits as positions."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for path, length in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                with _Input(path) as read:
                    t = table_bounds(read, length)
                bits = [8 * i + j for i, byte in enumerate(t["filter"]) for j in range(8) if byte >> j & 1]
                yield pa.RecordBatch.from_pydict({"path": [path], "n_entries": [t["n"]], "min_key": [t["least"]], "max_key": [t["greatest"]], "n_blocks": [len(t["blocks"])], "bits": [bits]})

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.mapInArrow(run, "path string, n_entries long, min_key binary, max_key binary, n_blocks long, bits array<long>")


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes of each kind (ending) in a store's folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.coalesce(F.nullif(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1), F.lit("")), F.lit("other"))
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


_FILE = "file_num: bigint, level: int, min_key: string, max_key: string, size: bigint"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Edits of a manifest of JSON lines, up to the first bad line; keys are base 64 in the file."""
    schema = f"new_files array<struct<{_FILE}>>, deleted_files array<struct<{_FILE}>>, next_file_num bigint, _bad string"
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), "\n")).alias("edit_seq", "line"))
    edits = lines.select("edit_seq", F.from_json("line", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("e"))
    bad = edits.agg(F.min(F.when(F.col("e._bad").isNotNull() | F.col("e").isNull(), F.col("edit_seq")))).first()[0]
    good = edits if bad is None else edits.where(F.col("edit_seq") < bad)
    empty = F.array().cast(f"array<struct<{_FILE}>>")
    files = lambda c: F.transform(F.coalesce(F.col(c), empty), lambda f: f.withField("min_key", F.unbase64(f["min_key"]).cast("string")).withField("max_key", F.unbase64(f["max_key"]).cast("string")))
    return good.select("edit_seq", files("e.new_files").alias("new_files"), files("e.deleted_files").alias("deleted_files"), "e.next_file_num")


def encode_manifest(edits: list[dict]) -> str:
    return "".join(json.dumps(e) + "\n" for e in edits)


# a whole store

WAL, VLOG, MANIFEST = "wal.log", "vlog.db", "MANIFEST"
VERSIONS = "cf string, key binary, commit_ts long, seq int, op string, value binary"


def _files(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def families(spark: SparkSession, root: str) -> list[str]:
    """The families of a store's folder: one a folder in it, and the default one."""
    files, path = _files(spark, root)
    found = {s.getPath().getName() for s in files.listStatus(path(root)) if s.isDirectory()} if files.exists(path(root)) else set()
    return sorted(unquote(f) for f in found | {versions.DEFAULT})


def resolved(stored: DataFrame, vlog: DataFrame) -> DataFrame:
    """Versions whose stored value has a pointer's length, with the value that it names; where it names none it is the value itself.

    Only pointers are joined; where they are few, their places are broadcast, so that only named values leave the value log.
    All else is merged, the values are never broadcast: Spark takes a decoded file to be as small as the table of its ranges.
    """
    stored = materialize(stored, "versions")
    short = stored.where(F.octet_length("value") == POINTER_BYTES).withColumn("offset", pointer_offset(F.col("value"))).withColumn("size", pointer_size(F.col("value")))
    named = vlog.select("offset", "size", F.col("value").alias("named")).hint("merge").join(bounded(short.select("offset", "size").where("size > 0").distinct()), ["offset", "size"], "left_semi")
    found = short.join(named.hint("merge"), ["offset", "size"], "left").withColumn("value", F.coalesce("named", "value")).select(stored.columns)
    return stored.where(F.coalesce(F.octet_length("value"), F.lit(0)) != POINTER_BYTES).unionByName(found)


def read_family(spark: SparkSession, root: str, cf: str) -> DataFrame:
    """All versions of one family: the write-ahead log, the live tables of the manifest (all, if there is none) and the value log as one version log.

    A version that is in the log and in a table counts once; of a batch's ops on
    a key the last counts.
    """
    files, path = _files(spark, root)
    at = f"{root}/{quote(cf, safe='')}"
    there = lambda name: files.exists(path(f"{at}/{name}"))
    names = [s.getPath().getName() for s in files.listStatus(path(at))] if files.exists(path(at)) else []
    tables = [n for n in names if n.endswith(".sst")]
    if there(MANIFEST):
        live = {r.file_num for r in storage.manifest_files(read_manifest(spark, f"{at}/{MANIFEST}")).select("file_num").collect()}  # a row a file
        tables = [n for n in tables if int(n[:-4]) in live]
    log = spark.createDataFrame([], VERSIONS).drop("cf")
    if there(WAL):
        log = log.unionByName(read_wal(spark, f"{at}/{WAL}").select("key", "commit_ts", "seq", "op", "value"))
    if tables:
        rows = read_table(spark, [f"{at}/{n}" for n in tables])
        live_ = F.octet_length("value") > 0
        log = log.unionByName(rows.select("key", "commit_ts", F.lit(0).alias("seq"), F.when(live_, "PUT").otherwise("DELETE").alias("op"), F.when(live_, F.col("value")).alias("value")))
    one = log.groupBy("key", "commit_ts").agg(F.max_by(F.struct("op", "value"), "seq").alias("v")).select("key", "commit_ts", F.lit(0).alias("seq"), "v.op", "v.value")
    if there(VLOG):
        one = resolved(one, read_vlog(spark, f"{at}/{VLOG}"))
    return one.select(F.lit(cf).alias("cf"), "key", "commit_ts", "seq", "op", "value")


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """A store's folder as one version log (keys and values are bytes), family by family."""
    log = spark.createDataFrame([], VERSIONS)
    for cf in families(spark, root):
        log = log.unionByName(read_family(spark, root, cf))
    return log


def _concatenated(spark: SparkSession, parts: list[str], target: str, head: bytes) -> None:
    """Part files one after another in one file, streamed piece by piece: the layout has a single value log and a single write-ahead log a family."""
    files, path = _files(spark, target)
    out = files.create(path(target), True)
    out.write(bytearray(head))
    jvm = spark.sparkContext._jvm
    for part in parts:
        stream = files.open(path(part))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
        stream.close()
    out.close()


def write_store(log: DataFrame, root: str, in_tables_to: int | None = None) -> None:
    """Lays a version log down as a store's folder: sorted tables, value logs and manifests, and what is later than `in_tables_to` in write-ahead logs.

    Tables are written by as many tasks as there are key ranges, value logs in
    parts by tasks too. Keys and values may be text or bytes. The folder is one
    that executors and driver share.
    """
    spark = log.sparkSession
    log = versions.normalized(log).select("cf", F.col("key").cast("binary").alias("key"), "commit_ts", "seq", "op", F.col("value").cast("binary").alias("value"))
    files, path = _files(spark, root)
    for (cf,) in log.select("cf").distinct().collect():  # a row a family
        own, at, parts = log.where(F.col("cf") == cf), f"{root}/{quote(cf, safe='')}", scratch(spark, "native")
        for folder in (at, parts):
            files.mkdirs(path(folder))
        own = own.groupBy("key", "commit_ts").agg(F.max_by(F.struct("op", "value"), "seq").alias("v")).select("key", "commit_ts", "v.op", "v.value")
        big = own.where(storage.placement(F.col("value")) == "pointer")
        big = storage.laid_out(big.select(F.struct("commit_ts", "key").alias("place"), "key", "commit_ts", "value", F.octet_length("value").cast("long").alias("size")), "place")
        pointer = F.unhex(F.concat(F.lpad(F.hex("offset"), 16, "0"), F.lpad(F.hex("size"), 8, "0")))
        placed = own.join(big.select("key", "commit_ts", "offset", "size"), ["key", "commit_ts"], "left")
        stored = materialize(placed.select("key", "commit_ts", "op", F.when(F.col("size").isNotNull(), pointer).otherwise(F.col("value")).alias("value")), "stored")
        chunks = _written(big.select("offset", "value").repartitionByRange("offset").sortWithinPartitions("offset"), _part_writer(parts, "vlog", _vlog_bytes), "first long, path string")
        _concatenated(spark, [r.path for r in chunks], f"{at}/{VLOG}", MAGIC + struct.pack(">I", VERSION))
        old = stored if in_tables_to is None else stored.where(F.col("commit_ts") <= in_tables_to)
        runs = _written(old.repartitionByRange("key").sortWithinPartitions("key", F.desc("commit_ts")), _table_writer(at), "file_num long, min_key binary, max_key binary, size long")
        edits = [{"new_files": [{"file_num": r.file_num, "level": 0, "min_key": base64.b64encode(r.min_key).decode(), "max_key": base64.b64encode(r.max_key).decode(), "size": r["size"]}], "next_file_num": r.file_num + 1} for r in runs]
        out = files.create(path(f"{at}/{MANIFEST}"), True)
        out.write(bytearray(encode_manifest(edits).encode()))
        out.close()
        late = [] if in_tables_to is None else stored.where(F.col("commit_ts") > in_tables_to).repartitionByRange("commit_ts").sortWithinPartitions("commit_ts").select("commit_ts", "key", "op", "value")
        chunks = late and _written(late, _part_writer(parts, "wal", _wal_bytes), "first long, path string")
        _concatenated(spark, [r.path for r in chunks], f"{at}/{WAL}", b"")


def _written(rows: DataFrame, writer: Callable, schema: str) -> list:
    """What a writer tells of each partition, in order of its first column; sorted here, as Spark's sort would run the writer twice."""
    return sorted(rows.mapInArrow(writer, schema).collect(), key=lambda r: r[0])  # a row a file


def _vlog_bytes(row: tuple) -> bytes:
    return struct.pack(">II", zlib.crc32(row[1]), len(row[1])) + row[1]


def _wal_bytes(row: tuple) -> bytes:
    ts, key, op, value = row
    return encode_wal(PUT if op == "PUT" else DELETE, ts, key, value or b"")


def _rows_of(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _writer(path: str):
    from pyarrow import fs

    where, at = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith(("/", "file:")) else fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return where.open_output_stream(at)


def _part_writer(folder: str, name: str, encode: Callable[[tuple], bytes]):
    """Writes a partition's records to a file of its own: its first place and its path. A retried task's file has another name."""

    def run(batches):
        import uuid

        import pyarrow as pa

        rows = _rows_of(batches)
        row = next(rows, None)
        if row is None:
            return
        first, path = row[0], f"{folder}/{name}-{uuid.uuid4().hex}"
        with _writer(path) as out:
            while row is not None:
                out.write(encode(row))
                row = next(rows, None)
        yield pa.RecordBatch.from_pydict({"first": [first], "path": [path]})

    return run


def _table_writer(folder: str):
    """Writes a sorted partition as a table; its number is that of the partition, so that a retry replaces the file."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() + 1
        seen = [None, None]

        def entries():
            for key, ts, op, value in _rows_of(batches):
                seen[0] = key if seen[0] is None else seen[0]
                seen[1] = key
                yield key, ts, value if op == "PUT" else b""

        rows, size = entries(), 0
        first = next(rows, None)
        if first is None:
            return
        with _writer(f"{folder}/{number:06d}.sst") as out:
            for part in table_parts(_chained(first, rows)):
                out.write(part)
                size += len(part)
        yield pa.RecordBatch.from_pydict({"file_num": [number], "min_key": [seen[0]], "max_key": [seen[1]], "size": [size]})

    return run


def _chained(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest
