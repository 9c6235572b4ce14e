"""Token-id files: canonical length-limited Huffman codes, independent blocks, bit-offset checkpoints.

Writing: texts are encoded once into a stored table, global id counts give the code, and every document's ids
become segments of bits that are sorted by doc_id over ranges and appended to one shard file per range.

File: `IDH1`, then blocks one after another, each readable on its own from its byte offset:

    block   = header | checkpoints | bits
    header  = 4 little-endian 32-bit numbers: ids, bits, ids per checkpoint, bytes of bits
    checkpoints: the bit offset of every k-th id, 32-bit each
    bits    = codes, most significant bit first, filled up to a byte, and 8 zero bytes

The code table (lengths by id) is one more file; canonical codes follow from the lengths.  An index table in
Parquet has one row per run of whole documents: shard, byte range, ids before it in the shard, and the
documents' ids and lengths.  Files of failed attempts are never named there.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, scratch
from . import text, vocab

MAX_BITS = 16
CHECKPOINT = 64
BLOCK_IDS = 1 << 16
RUN_IDS = 1 << 18
COUNTS = -1
MAGIC = b"IDH1"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    # level by level: pairs of the level below, merged with the leaves; remember which entries are leaves
    merged, levels = leaves, []
    is_leaf = np.ones(len(leaves), bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        merged, is_leaf = both[at], at < len(leaves)
    levels.append(is_leaf)
    take = 2 * len(leaves) - 2
    out = np.zeros(len(leaves), np.int64)
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        out[:n] += 1
        take = 2 * (take - n)
    lengths[order] = out
    return lengths


class Code:
    """Canonical code: codes of one length are consecutive, in id order."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        wide = np.int64(1) << (MAX_BITS - lengths[order].astype(np.int64))
        begin = np.concatenate([[0], np.cumsum(wide)[:-1]]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (begin >> (MAX_BITS - lengths[order].astype(np.int64))).astype(np.uint64)
        #: next MAX_BITS bits -> id
        self.table = np.zeros(1 << MAX_BITS, np.uint32)
        filled = np.repeat(order, wide)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """A block for each run of ids that ends at one of `ends`; all runs are coded side by side."""
        sizes = np.diff(ends, prepend=0)
        bits = self.lengths[ids].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(bits)])
        spans = total[ends] - total[ends - sizes]  # bits of each run
        room = (spans + 7 >> 3) + 8
        base = np.cumsum(room) - room  # each run begins at a byte
        starts = total[:-1] + np.repeat(8 * base - total[ends - sizes], sizes)
        words = np.zeros((int(room.sum()) >> 2) + 3, np.uint64)
        at = starts >> 5
        value = self.codes[ids] << (64 - (starts & 31) - bits).astype(np.uint64)  # in the 64 bits that begin at word `at`
        if len(ids):
            first = np.flatnonzero(np.diff(at, prepend=-1))
            words[at[first]] += np.add.reduceat(value >> np.uint64(32), first)
            words[at[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        data = words.astype(">u4").tobytes()
        out = []
        for n, end, span, b in zip(sizes.tolist(), ends.tolist(), spans.tolist(), base.tolist()):
            marks = (starts[end - n : end : CHECKPOINT] - 8 * b).astype("<u4")
            head = np.array([n, span, CHECKPOINT, span + 7 >> 3], "<u4")
            out.append(head.tobytes() + marks.tobytes() + data[b : b + (span + 7 >> 3)] + bytes(8))
        return out

    def decode(self, data: bytes) -> list[np.ndarray]:
        """The ids of each of the blocks that fill `data`; the stretches between checkpoints are decoded side by side."""
        heads, at = [], 0
        while at < len(data):
            n, _, step, size = (int(x) for x in np.frombuffer(data, "<u4", 4, at))
            lanes = -(-n // step)
            heads.append((n, step, lanes, at + 16, at + 16 + 4 * lanes))
            at += 16 + 4 * lanes + size + 8
        if not heads:
            return []
        where = np.concatenate([8 * bits + np.frombuffer(data, "<u4", lanes, marks).astype(np.int64) for _, _, lanes, marks, bits in heads])
        step = max(h[1] for h in heads)
        raw = np.frombuffer(data + bytes(4 * step), np.uint8).astype(np.uint32)  # a short stretch runs on into what follows; that is cut off
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from each byte on
        out = np.empty((step, len(where)), np.uint32)
        lengths = self.lengths.astype(np.int64)
        for k in range(step):
            got = out[k] = self.table[window[where >> 3] >> (16 - (where & 7)).astype(np.uint32) & 0xFFFF]
            where += lengths[got]
        rows = np.ascontiguousarray(out.T)
        blocks, lane = [], 0
        for n, each, lanes, _, _ in heads:
            blocks.append(rows[lane : lane + lanes, :each].reshape(-1)[:n])
            lane += lanes
        return blocks


def _open(path: str):
    """File system and path of a plain path or URI."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


def id_counts(stored: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each id, summed over the tasks; a partial sum has at most one entry per id of the vocabulary."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for data in b.column("ids").to_pylist():
                at, n = np.frombuffer(data, np.int64).reshape(2, -1)
                yield text.batch_of(schema, at, n)

    found = stored.where(F.col("row") == COUNTS).select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def write_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all texts and return the folder: shards `*.ids`, the code `lengths`, the table `index`.

    Ids stand in ascending doc_id order, null ids first; rows that repeat a doc_id follow each other.  A null
    or empty text has only its end id.  An empty table gives an index without rows.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark)
    model = vocab.tokens(vocabulary)
    size, dtype = max(model.library.get_vocab_size(with_added_tokens=True), end_id + 1), model.dtype.str
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("ids", pa.binary())])

    def encode(batches):
        total = np.zeros(size, np.int64)
        row = TaskContext.get().partitionId() << 40
        for b in text.slices(batches, vocab.SLICE_BYTES):
            ids, ends = vocab.tokens(vocabulary).encode(b.column("text"))
            ids = np.insert(ids.astype(dtype), ends, end_id)
            ends = np.dtype(dtype).itemsize * (ends + np.arange(1, len(ends) + 1))
            data = ids.tobytes()
            yield text.batch_of(schema, b.column("doc_id"), np.arange(row, row + len(ends)), [data[x:y] for x, y in zip([0, *ends.tolist()], ends.tolist())])
            row += len(ends)
            total += np.bincount(ids, minlength=size)
        at = np.flatnonzero(total)  # one more row: the task's id counts
        yield text.batch_of(schema, [None], [COUNTS], [np.stack([at, total[at]]).tobytes()])

    rows = text.text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    stored = cut(rows.mapInArrow(encode, "doc_id long, row long, ids binary"))
    lengths = code_lengths(id_counts(stored, size))
    put_lengths(spark, folder, lengths)
    code = spark.sparkContext.broadcast(lengths.tobytes())

    index = pa.schema([("part", pa.int64()), ("shard", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])

    def append(batches):
        """One shard: blocks in order; an index row for each run of whole documents."""
        path, out, at, before = f"{folder}/{uuid.uuid4().hex}.ids", None, len(MAGIC), 0
        part = TaskContext.get().partitionId()
        begin, docs_, sizes, held = at, [], [], 0

        def close():
            return text.batch_of(index, [part], [path], [begin], [at - begin], [before], [held], [docs_], [sizes])

        huffman = Code(np.frombuffer(code.value, np.uint8))
        for b in text.slices(batches, 1 << 20, column="ids"):
            ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype)
            lengths = pc.binary_length(b.column("ids")).to_numpy().astype(np.int64) // ids.itemsize
            parts = -(-lengths // BLOCK_IDS)
            last = np.cumsum(parts)
            # every document in blocks of at most BLOCK_IDS ids
            ends = np.repeat(np.cumsum(lengths) - lengths, parts) + np.minimum(
                BLOCK_IDS * (np.arange(last[-1]) - np.repeat(last - parts, parts) + 1), np.repeat(lengths, parts))
            blocks = huffman.encode(ids, ends)
            for doc, n, z, k in zip(b.column("doc_id").to_pylist(), lengths.tolist(), last.tolist(), parts.tolist()):
                if out is None:
                    system, where = _open(path)
                    system.create_dir(where.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(where)
                    out.write(MAGIC)
                if held >= RUN_IDS:
                    yield close()
                    before += held
                    begin, docs_, sizes, held = at, [], [], 0
                docs_.append(doc)
                sizes.append(n)
                held += n
                for block in blocks[z - k : z]:
                    out.write(block)
                    at += len(block)
        if out is not None:
            out.close()
            yield close()

    in_order = stored.where(F.col("row") >= 0).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("row")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    in_order.mapInArrow(append, "part long, shard string, offset long, bytes long, before long, n long, docs array<long>, lengths array<long>").write.parquet(f"{folder}/index")
    return folder


def put_lengths(spark: SparkSession, folder: str, lengths: np.ndarray) -> None:
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/lengths")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shard files.

    A task reads byte ranges of whole documents, block after block.  The checksum is that of the ids as
    little-endian 32-bit numbers.
    """
    index = spark.read.parquet(f"{folder}/index")
    # ids before each shard: one row per shard
    shards = index.groupBy("part", "shard").agg(F.sum("n").alias("_n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("first"))
    code = spark.sparkContext.broadcast(spark.read.parquet(f"{folder}/lengths").first()["lengths"])
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        huffman = Code(np.frombuffer(bytes(code.value), np.uint8))
        for b in batches:
            for run in b.to_pylist():
                system, path = _open(run["shard"])
                start, rows = run["first"] + run["before"], [[], [], [], []]
                with system.open_input_file(path) as f:
                    blocks = _blocks(f, run["offset"], run["bytes"], huffman)
                    for doc, n in zip(run["docs"], run["lengths"]):
                        crc, got = 0, 0
                        while got < n:
                            ids = next(blocks)
                            got += len(ids)
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        for c, v in zip(rows, (doc, start, n, crc)):
                            c.append(v)
                        start += n
                yield text.batch_of(schema, *rows)

    joined = index.join(shards, "shard").select("shard", "offset", "bytes", "before", "docs", "lengths", "first")
    # the rows are few and small, so that their bytes must not decide how many tasks there are
    return joined.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "offset").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _blocks(f, offset: int, size: int, huffman: Code):
    """Ids of the blocks in a byte range, decoded some hundred thousand at a time."""
    f.seek(offset)
    data = b""
    while size > 0 or data:
        part = f.read(min(size, 4 * BLOCK_IDS))
        size -= len(part)
        data += part
        whole = 0
        while whole + 16 <= len(data):
            n, _, step, bits = (int(x) for x in np.frombuffer(data, "<u4", 4, whole))
            end = whole + 16 + 4 * -(-n // step) + bits + 8
            if end > len(data):
                break
            whole = end
        if not whole and not part:
            raise ValueError("the file ends inside a block")
        yield from huffman.decode(data[:whole])
        data = data[whole:]
