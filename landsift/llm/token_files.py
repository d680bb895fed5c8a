"""Token files: ids in Simple-8b words, in ascending order of documents.

A 64-bit word holds a selector (4 bits) and as many ids as fit its 60 bits: 60 of one bit
down to one of 60 bits. Selector 0 is an escape: the id follows in a word of its own. The
ids of a file form one stream in blocks of ``BLOCK``; no word crosses a block, and the
directory holds where each block's words begin, so any range of blocks is read and decoded
on its own. Encoding and decoding run over all blocks of a chunk at once.

Layout of a file (little-endian): words of all blocks; directory: block count + 1 word
offsets (uint64); documents: key (int64), null mark (uint8), ids (uint64), each as a column;
tail: numbers of words, ids, documents (uint64) and the magic.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landsift.llm import files
from landsift.llm.common import new_folder, written
from landsift.llm.token_ids import slices, tokenizer

MAGIC = b"S8BTOKS1"
TAIL = 24 + len(MAGIC)
BLOCK = 1024
#: Blocks that are encoded, or read and decoded, at a time.
CHUNK = 1024
#: ids per word, most first; bits of each. Selector k + 1 stands for place k.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // COUNTS


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of a stream of uint64 ids, and at which word each block begins (one more at the end).

    A word takes the most ids that all fit and that its block still has.
    """
    ids = np.asarray(ids)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    blocks = -(-n // block)
    most = int(ids.max())
    within = np.arange(n) % block
    left = block - within  # places up to the block's or the stream's end
    left[(blocks - 1) * block :] = np.arange(n - (blocks - 1) * block, 0, -1)
    take = np.zeros(n, np.uint8)  # selector of a word that begins here
    for k in range(len(COUNTS) - 1, -1, -1):
        count, top = int(COUNTS[k]), 1 << int(BITS[k])
        if most < top:
            take[left >= count] = k + 1
            continue
        at = np.flatnonzero(ids < top)
        if len(at) >= count:
            begin = at[: len(at) - count + 1]
            begin = begin[at[count - 1 :] - begin == count - 1]
            take[begin[left[begin] >= count]] = k + 1
    length = np.concatenate([[1], COUNTS])[take]
    at = np.arange(blocks) * block
    stop = np.minimum(at + block, n)
    live, begins = np.arange(blocks), np.zeros(n, np.bool_)
    while len(live):
        spots = at[live]
        begins[spots] = True
        spots = spots + length[spots]
        at[live] = spots
        live = live[spots < stop[live]]
    starts = np.flatnonzero(begins)
    chosen = take[starts]
    size = np.where(chosen == 0, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for k in np.unique(chosen).tolist():
        mine = np.flatnonzero(chosen == k)
        begin = starts[mine]
        if k == 0:
            words[place[mine] + 1] = ids[begin]
            continue
        word = np.full(len(mine), k << 60, np.uint64)
        for j in range(int(COUNTS[k - 1])):
            word |= ids[begin + j].astype(np.uint64) << np.uint64(j * int(BITS[k - 1]))
        words[place[mine]] = word
    offsets = np.searchsorted(starts, np.arange(blocks + 1) * block)
    return words, np.concatenate([place, [len(words)]])[offsets]


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of the words of whole blocks."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    escape = selector == 0  # an escaped id has 61 bits or more, so it never looks like one
    raw = np.zeros(len(words), np.bool_)
    raw[1:] = escape[:-1]
    selector[raw] = 0
    counts = np.concatenate([[0], COUNTS])[selector]
    counts[raw] = 1
    base = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    out[base[raw]] = words[raw]
    for k in np.unique(selector[counts > 0]).tolist():
        mine = np.flatnonzero((selector == k) & (counts > 0))
        if k == 0:
            continue
        mask = np.uint64((1 << int(BITS[k - 1])) - 1)
        some, spot = words[mine], base[mine]
        for j in range(int(COUNTS[k - 1])):
            out[spot + j] = (some >> np.uint64(j * int(BITS[k - 1]))) & mask
    return out


class Writer:
    """One token file; ids come in any portions."""

    def __init__(self, path: str):
        self.path, self._out = path, files.create(path)
        self._rest: list[np.ndarray] = []
        self._waiting = self.n_ids = self.n_words = 0
        self._offsets, self._keys, self._nulls, self._sizes = [np.zeros(1, np.int64)], [], [], []

    def add(self, keys: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self._keys.append(np.array([k or 0 for k in keys], np.int64))
        self._nulls.append(np.array([k is None for k in keys], np.uint8))
        self._sizes.append(np.asarray(sizes, np.uint64))
        self._rest.append(ids)
        self._waiting += len(ids)
        if self._waiting >= CHUNK * BLOCK:
            self._put(self._waiting // BLOCK * BLOCK)

    def _put(self, n: int) -> None:
        ids = np.concatenate(self._rest) if self._rest else np.zeros(0, np.uint32)
        for at in range(0, n, CHUNK * BLOCK):
            words, offsets = encode(ids[at : min(n, at + CHUNK * BLOCK)])
            self._out.write(words.astype("<u8").tobytes())
            self._offsets.append(offsets[1:] + self.n_words)
            self.n_words += len(words)
        self.n_ids += n
        self._rest, self._waiting = [ids[n:]], len(ids) - n

    def close(self) -> int:
        self._put(self._waiting)
        columns = [np.concatenate(self._offsets).astype("<u8")]
        for parts, kind in ((self._keys, "<i8"), (self._nulls, "u1"), (self._sizes, "<u8")):
            columns.append(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
        for column in columns:
            self._out.write(column.tobytes())
        self._out.write(np.array([self.n_words, self.n_ids, len(columns[1])], "<u8").tobytes() + MAGIC)
        self._out.close()
        return len(columns[1])


def read_file(path: str):
    """(key or None, start in the file, ids, CRC-32) of each document, by ranges of blocks."""
    with files.open_ranges(path) as f:
        size = f.size()
        tail = f.read_at(TAIL, size - TAIL)
        if tail[24:] != MAGIC:
            raise ValueError(f"{path} is no token file")
        n_words, n_ids, n_docs = (int(x) for x in np.frombuffer(tail[:24], "<u8"))
        blocks = -(-n_ids // BLOCK)
        at = 8 * n_words
        offsets = np.frombuffer(f.read_at(8 * (blocks + 1), at), "<u8").astype(np.int64)
        at += 8 * (blocks + 1)
        keys = np.frombuffer(f.read_at(8 * n_docs, at), "<i8").tolist()
        nulls = np.frombuffer(f.read_at(n_docs, at + 8 * n_docs), "u1").tolist()
        sizes = np.frombuffer(f.read_at(8 * n_docs, at + 9 * n_docs), "<u8").tolist()
        first, stop, ids = 0, 0, np.zeros(0, "<u4")

        def more(bytes_of: int) -> None:
            nonlocal first, stop, ids
            begin, end = stop // BLOCK, min(blocks, stop // BLOCK + CHUNK)
            words = np.frombuffer(f.read_at(int(8 * (offsets[end] - offsets[begin])), int(8 * offsets[begin])), "<u8")
            ids = decode(words, min(end * BLOCK, n_ids) - begin * BLOCK).astype("<u4")
            first, stop = begin * BLOCK, min(end * BLOCK, n_ids)

        start = 0
        for key, null, n in zip(keys, nulls, sizes, strict=True):
            crc, place, end = 0, start, start + n
            while place < end:
                if place >= stop:
                    more(n)
                upto = min(end, stop)
                crc = zlib.crc32(ids[place - first : upto - first].data, crc)
                place = upto
            yield None if null else key, start, n, crc
            start = end


MANIFEST = "part int, path string, n_docs long, n_ids long"


def write(docs: DataFrame, tokenizer_path: str, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts into token files of ascending keys; the table of the files written.

    Documents are dealt out by ranges of their key (equal keys by a hash of the text, so that
    one key repeated often is split) and each task writes one file while it reads its rows.
    Null texts are empty; null keys come first; repeated rows stay. An empty table gives no
    files.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def put(batches):
        out = None
        for batch in batches:
            for some in slices(batch, "text"):
                if out is None:
                    out = Writer(files.new_file(folder, TaskContext.get().partitionId(), ".s8b"))
                ids, sizes = tokenizer(tokenizer_path).ids(some.column("text"), end)
                out.add(some.column("doc_id").to_pylist(), ids, sizes)
        if out is not None:
            made = out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [out.path], "n_docs": [made], "n_ids": [out.n_ids]}
            )

    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(put, MANIFEST), "token-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files.

    The running sum is over one row per file.
    """
    spark = manifest.sparkSession
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = manifest.select("path", F.coalesce(before, F.lit(0)).cast("long").alias("base"))

    def get(batches):
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for key, start, n, crc in read_file(row["path"]):
                    rows.append((key, row["base"] + start, n, crc))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return based.repartition(n).mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])
