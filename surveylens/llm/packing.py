"""Packing documents along a space-filling curve.

A document's tokens are hashed into a vector, a fixed random projection maps the vector
to a few dimensions, and its cell on a grid over them gets its number on the Hilbert
curve.  Documents are range-sorted by that number, so that neighbours on the curve share
sequences, and cut into sequences of ``length`` tokens.  What is left at the end of a
range is cut into sequences of powers of two, which are not padded; so there is no
padding at all.

The ids are made once, written to the shared checkpoint folder with the curve's number
(two bytes an id) and range-partitioned from there; every range is packed in one pass
that holds one unfinished sequence.  Copies have one number on the curve; a hash of the
document id follows it in the sort order, so a group of copies of any size is split over
ranges.

Edge cases: a null or empty text is the end token alone; repeated rows are packed each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveylens.llm.common import load, materialise, shuffle_partitions, text_slices
from surveylens.llm.word_tokens import WordTokens

TOKENIZER = "word_bpe_49k.json"
END = 2


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Number on the Hilbert curve of each row of grid cells (0 .. 2**bits - 1 each)."""
    x = [c.astype(np.int64) for c in cells.T]
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the curve's reflections, from the coarsest level
        q = np.int64(1) << level
        low = q - 1
        for d in range(dims):
            high = (x[d] & q) != 0
            swap = (x[0] ^ x[d]) & low
            first = np.where(high, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = np.where(high, x[d], x[d] ^ swap)
            x[0] = first
    for d in range(1, dims):  # Gray code over the dimensions
        x[d] = x[d] ^ x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> level) & 1 == 1, flip ^ ((np.int64(1) << level) - 1), flip)
    x = [c ^ flip for c in x]
    number = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            number = (number << 1) | ((c >> level) & 1)
    return number


def curve_numbers(ids: np.ndarray, lengths: np.ndarray, dims: int = 4, bits: int = 8,
                  buckets: int = 256, seed: int = 4) -> np.ndarray:
    """Hilbert number of each document from its token ids."""
    n = len(lengths)
    counts = np.zeros((n, buckets))
    flat = counts.reshape(-1)
    doc = np.repeat(np.arange(n), lengths)
    bucket = ((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    cell = doc * buckets + (bucket % np.uint64(buckets)).astype(np.int64)
    flat += np.bincount(cell, minlength=n * buckets)
    v = np.sqrt(counts)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    v -= v.mean(axis=1, keepdims=True)
    z = v @ np.random.default_rng(seed).standard_normal((buckets, dims))
    cells = np.floor((1 << bits) / (1 + np.exp(-1.7 * z))).astype(np.int64)
    return hilbert(np.clip(cells, 0, (1 << bits) - 1), bits)


def tokenize(docs: DataFrame, id_col: str, text_col: str, path: str | None, end: int = END) -> DataFrame:
    """id, curve, n, ids (two or four bytes each, little-endian)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        if path is None:
            import public_tokenizers

            tokens = WordTokens(public_tokenizers.path(TOKENIZER))
        else:
            tokens = WordTokens(path)
        for b in text_slices(batches, text_col, 16 << 20):
            ids, lengths = tokens.encode(b.column(text_col), end)
            numbers = curve_numbers(ids, lengths)
            raw = ids.astype(ids.dtype.newbyteorder("<")).tobytes()
            offsets = np.concatenate(([0], np.cumsum(lengths))) * ids.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(lengths), [
                None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array(numbers, pa.int64()), pa.array(lengths, pa.int64()), packed],
                names=["id", "curve", "n", "ids"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"id {id_type}, curve long, n long, ids binary")


class Sequencer:
    """Cuts a stream of documents' ids into sequences; rows are (id, start, length, crc32,
    doc tokens, sequence, offset)."""

    def __init__(self, length: int, first: int) -> None:
        self.length, self.sequence = length, first
        self.open: list[tuple] = []  # pieces of the unfinished sequence: id, start, ids, doc tokens
        self.filled = 0
        self.rows: list[tuple] = []

    def _close(self) -> None:
        at = 0
        for id_, start, ids, n in self.open:
            self.rows.append((id_, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n,
                              self.sequence, at))
            at += len(ids)
        self.open, self.filled, self.sequence = [], 0, self.sequence + 1

    def add(self, id_, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while at < n:
            take = min(n - at, self.length - self.filled)
            self.open.append((id_, at, ids[at:at + take], n))
            self.filled += take
            at += take
            if self.filled == self.length:
                self._close()

    def finish(self) -> None:
        """The rest as sequences of falling powers of two."""
        rest, left = self.open, self.filled
        self.open, self.filled = [], 0
        for bit in range(left.bit_length() - 1, -1, -1):
            if not left >> bit & 1:
                continue
            need = 1 << bit
            while need:
                id_, start, ids, n = rest.pop(0)
                if len(ids) > need:
                    rest.insert(0, (id_, start + need, ids[need:], n))
                    ids = ids[:need]
                self.open.append((id_, start, ids, n))
                need -= len(ids)
            self._close()

    def flush(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 4096,
         path: str | None = None, partitions: int | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``path`` names the vocabulary file; unset, the executors' installed public file.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    tokens = materialise(tokenize(docs, id_col, text_col, path), "pack-tokens")
    ranges = partitions or shuffle_partitions(docs.sparkSession)
    ordered = (tokens.withColumn("tie", F.xxhash64("id", "n"))
               .repartitionByRange(ranges, "curve", "tie")
               .sortWithinPartitions("curve", "tie", "id", "ids")
               .select("id", "ids"))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    width = 2 if len_of_ids(path) <= 1 << 16 else 4

    def run(batches):
        out = Sequencer(length, TaskContext.get().partitionId() << 40)
        arrow_id = None

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], arrow_id)]
                + [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 7)], names=names)

        for b in batches:
            arrow_id = b.schema.field("id").type
            for id_, ids in zip(b.column("id").to_pylist(), b.column("ids"), strict=True):
                out.add(id_, np.frombuffer(ids.as_buffer(), f"<u{width}"))
            yield batch(out.flush())
        out.finish()
        if out.rows:
            yield batch(out.flush())

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{n} long" for n in names[1:])
    return ordered.mapInArrow(run, schema)


def len_of_ids(path: str | None) -> int:
    """Number of ids of the vocabulary file."""
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Tokenizer.from_file(path).get_vocab_size()


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents", "doc_id", "text"))
