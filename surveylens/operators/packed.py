"""Matrices as one binary value a row, without a Python object a row, and their spread over tasks;
sums of weights per bin of many features.

Features of few bins are summed together: a cell of a group holds one bin of each of its features,
and a feature's sums are those of its cells added up, so that a row costs a sum a group, not a feature."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def packed(matrix: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    matrix = np.ascontiguousarray(matrix)
    rows, size = len(matrix), matrix.itemsize * (matrix.shape[1] if matrix.ndim > 1 else 1)
    if rows * size >= 1 << 31:
        raise ValueError("a batch of at most 2 GB")
    ends = np.arange(rows + 1, dtype=np.int64) * size
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(matrix)])


def unpacked(column, dtype, width: int) -> np.ndarray:
    """The matrix of a column (or chunked column) of ``packed`` rows; there are no nulls."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = [_chunk(c, dtype, width) for c in chunks if len(c)]
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros((0, width), dtype)


def _chunk(chunk: pa.Array, dtype, width: int) -> np.ndarray:
    _, ends, data = chunk.buffers()
    wide = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
    first = int(np.frombuffer(ends, wide, 1, chunk.offset * np.dtype(wide).itemsize)[0])
    return np.frombuffer(data, dtype, len(chunk) * width, first).reshape(len(chunk), width)


def in_block(batch: pa.RecordBatch | pa.Table) -> bytes:
    """Rows as one binary value, so that sending them costs nothing a row."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def from_blocks(column) -> pa.Table:
    """The rows of a column (or chunked column) of one block or more."""
    return pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in column])


def each_block(batches):
    """The rows of one block at a time, of batches with a block a row."""
    for b in batches:
        for value in b.column(0):
            yield pa.ipc.open_stream(value.as_buffer()).read_all().combine_chunks()


def blocks(df: DataFrame) -> DataFrame:
    """(block): the rows of each batch as one binary value."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([in_block(b)], pa.binary())], names=["block"])

    return df.mapInArrow(run, "block binary")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over all cores: small files make few tasks, and later scans keep them."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


MOST_GROUP = 1024     # cells of a group of several features


class Groups:
    """Features put together; ``offsets``: where each feature's bins start in a row of sums."""

    def __init__(self, offsets: np.ndarray, most: int = MOST_GROUP) -> None:
        self.offsets, self.members = np.asarray(offsets), []
        bins = np.diff(self.offsets)
        size = most + 1
        for f in np.argsort(bins, kind="stable"):
            if size * bins[f] > most:
                self.members.append([])
                size = 1
            self.members[-1].append(int(f))
            size *= int(bins[f])
        self.shapes = [tuple(int(bins[f]) for f in own) for own in self.members]

    def cells(self, codes: np.ndarray) -> list[np.ndarray]:
        """Each group's cell of every row."""
        out = []
        for own, shape in zip(self.members, self.shapes, strict=True):
            cell = codes[:, own[0]].astype(np.int64)
            for f, n in zip(own[1:], shape[1:], strict=True):
                cell *= n
                cell += codes[:, f]
            out.append(cell.astype(np.uint16) if np.prod(shape) <= 1 << 16 else cell)  # few bytes to read again
        return out

    def by_cell(self, values: np.ndarray, g: int) -> np.ndarray:
        """A value per slot, added up over the features of group ``g``, per cell."""
        own, shape = self.members[g], self.shapes[g]
        out = np.zeros(shape)
        for i, f in enumerate(own):
            held = values[self.offsets[f]:self.offsets[f + 1]]
            out += held.reshape([-1 if j == i else 1 for j in range(len(own))])
        return out.ravel()

    def by_bin(self, held: list[np.ndarray]) -> np.ndarray:
        """Sums per slot from the sums per cell of every group."""
        out = np.zeros(int(self.offsets[-1]), held[0].dtype)
        for own, shape, total in zip(self.members, self.shapes, held, strict=True):
            for i, f in enumerate(own):
                rest = tuple(j for j in range(len(own)) if j != i)
                out[self.offsets[f]:self.offsets[f + 1]] = total.reshape(shape).sum(axis=rest)
        return out

    def sums(self, cells: list[np.ndarray], rows: np.ndarray | None, node: np.ndarray | None, k: int,
             weights: tuple) -> list[np.ndarray]:
        """Per weight (None: 1) its sums over ``rows`` (None: all) by node of ``k`` and bin."""
        out = [np.zeros((k, int(self.offsets[-1]))) for _ in weights]
        own_weights = [w if w is None or rows is None else w.take(rows) for w in weights]
        for own, shape, cell in zip(self.members, self.shapes, cells, strict=True):
            size = int(np.prod(shape))
            cell = cell if rows is None else cell.take(rows)
            cell = cell if k == 1 else node * size + cell
            for total, w in zip(out, own_weights, strict=True):
                held = np.bincount(cell, w, k * size).reshape(k, *shape)
                for i, f in enumerate(own):
                    rest = tuple(j + 1 for j in range(len(own)) if j != i)
                    total[:, self.offsets[f]:self.offsets[f + 1]] = held.sum(axis=rest) if rest else held
        return out
