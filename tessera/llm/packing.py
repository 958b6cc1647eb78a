"""Token ids packed into rows of equal length by best-fit decreasing.

Texts are tokenised with a given byte-level BPE vocabulary, an end id is appended, and documents longer than a row are
split into pieces without loss. Pieces are packed best fit first: taken in decreasing length, each goes into the open row
with the least room that still suffices. A segment tree over room sizes finds that row in log2(row length) steps. Every
packed row carries its id matrix row, the cumulative segment lengths and the positions at which position ids restart.

Packing is local to blocks of consecutive documents of a partition, so nothing is shuffled, a task holds one block of ids,
and a lost task is simply run again. A block leaves at most about one row partly filled, which is below 1 % of it.

Defined results: a null or empty text is a document of just the end id. Repeated rows are packed as often as they occur.
An empty table gives no rows. Columns other than the id and the text are ignored, whatever their names. Ids are cast to long; one
that is no number fails under ANSI rules and is packed as null without.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that this vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
END_ID = 50256
ROW_LENGTH = 2048
#: Ids of a block (2 bytes each).
BLOCK_IDS = 1 << 22
SCHEMA = "row_id long, n_ids int, n_segments int, doc_ids array<long>, piece_starts array<int>, cu_seqlens array<int>, position_resets array<int>, ids binary"
_ARROW = pa.schema([("row_id", pa.int64()), ("n_ids", pa.int32()), ("n_segments", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("piece_starts", pa.list_(pa.int32())), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary())])
_CODERS: dict = {}


class RoomTree:
    """Open rows by the room that they have left. best(need) is the row with the least room of need at least."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def best(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (row, room); None if no open row has the room."""
        at = self.size + need
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):  # up to where a right neighbour holds rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows as lists of piece numbers. Pieces of equal length keep their order, so the result is fixed by the lengths."""
    tree, rows = RoomTree(capacity), []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[piece])
        if need == capacity:
            rows.append([piece])
            continue
        found = tree.best(need)
        if found is None:
            rows.append([piece])
            row, room = len(rows) - 1, capacity
        else:
            row, room = found
            rows[row].append(piece)
        if room > need:
            tree.put(room - need, row)
    return rows


def coder(ranks: bytes, pattern: str):
    """A tokenizer of the given vocabulary file's content; kept for the life of a Python worker."""
    import tiktoken

    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _CODERS:
        found = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _CODERS[key] = tiktoken.Encoding("packed", pat_str=pattern, mergeable_ranks=found, special_tokens={})
    return _CODERS[key]


def pack_block(doc_ids: list, ids: list[np.ndarray], capacity: int, first_row: int) -> pa.RecordBatch:
    """One block: pieces of all documents, packed."""
    owner, start, length = [], [], []
    for d, x in enumerate(ids):
        for s in range(0, len(x), capacity):
            owner.append(d)
            start.append(s)
            length.append(min(capacity, len(x) - s))
    rows = best_fit_decreasing(np.array(length, np.int64), capacity)
    cu = [np.cumsum([0, *(length[p] for p in row)]).tolist() for row in rows]
    parts = {
        "row_id": [first_row + i for i in range(len(rows))],
        "n_ids": [c[-1] for c in cu],
        "n_segments": [len(row) for row in rows],
        "doc_ids": [[doc_ids[owner[p]] for p in row] for row in rows],
        "piece_starts": [[start[p] for p in row] for row in rows],
        "cu_seqlens": cu,
        "position_resets": [c[:-1] for c in cu],
        "ids": [np.concatenate([ids[owner[p]][start[p] : start[p] + length[p]] for p in row]).tobytes() for row in rows],
    }
    return pa.RecordBatch.from_arrays([pa.array(parts[f.name], f.type) for f in _ARROW], schema=_ARROW)


def packed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, end_id: int = END_ID, row_length: int = ROW_LENGTH, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Packed rows (SCHEMA). ids holds n_ids little-endian 16-bit ids; a row shorter than row_length is the last of a
    block or has no piece that fits. row_id is unique: the partition in the upper bits, then the row's number."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary of 16-bit ids: below 1 MB

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code = coder(ranks.value, pattern)  # once a task
        base, row = TaskContext.get().partitionId() << 33, 0
        names: list = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.empty(0, np.uint16) if not text else np.array(code.encode_ordinary(text), np.uint16)
                names.append(name)
                held.append(np.append(own, np.uint16(end_id)))
                size += len(own) + 1
                if size >= block_ids:
                    out = pack_block(names, held, row_length, base + row)
                    row += out.num_rows
                    names, held, size = [], [], 0
                    for i in range(0, out.num_rows, 500):
                        yield out.slice(i, 500)
        if held:
            yield pack_block(names, held, row_length, base + row)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pack, SCHEMA)


def to_matrix(rows: DataFrame, row_length: int = ROW_LENGTH, pad_id: int = END_ID) -> DataFrame:
    """The rows with ids padded to row_length, so that a part file is a matrix of 16-bit ids row by row."""
    pad = F.lit(int(pad_id).to_bytes(2, "little") * row_length)
    return rows.withColumn("ids", F.substring(F.concat("ids", pad), 1, 2 * row_length).cast("binary"))


def write(rows: DataFrame, path: str, *, row_length: int = ROW_LENGTH, pad_id: int = END_ID) -> None:
    """Writes padded id matrices with their segment lengths and position resets as Parquet."""
    to_matrix(rows, row_length, pad_id).write.parquet(path)


def unpack(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The pieces of packed rows: (doc_id, piece_start, ids), the inverse of packing."""
    each = rows.select("ids", F.posexplode(F.arrays_zip("doc_ids", "piece_starts")).alias("i", "p"), "cu_seqlens")
    begin, end = F.get("cu_seqlens", F.col("i")), F.get("cu_seqlens", F.col("i") + 1)
    return each.select(F.col("p.doc_ids").alias("doc_id"), F.col("p.piece_starts").alias("piece_start"), F.substring(F.col("ids"), 2 * begin + 1, 2 * (end - begin)).alias("ids"))
