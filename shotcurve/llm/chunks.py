"""Token ids of Arrow batches of texts by way of their distinct chunks.

A text is cut where no token can reach across, so equal chunks have equal ids.
A slice of a batch is cut and dictionary-encoded as a whole; only chunks not
seen before reach the encoder, and all other ids are gathered from arrays.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# bytes of text handled at once (one longer text is handled alone)
SLICE_BYTES = 4 << 20
# bytes of chunks and their ids a worker remembers
REMEMBERED_BYTES = 96 << 20


def slices(texts: pa.Array, size: int | None = None):
    """(first row, part) of the parts of a string array, as large strings, of at most size
    (SLICE_BYTES) bytes where texts allow."""
    size = size or SLICE_BYTES
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + size, "right")) - 1)
        yield start, texts.slice(start, stop - start)
        start = stop


class ChunkIds:
    """Ids of texts; seams[x, y] says that a text may be cut between bytes x and y
    (never inside a character), encode(chunks) gives the ids of new chunks as
    bytes of 32-bit integers, prefix goes before every text that is not empty."""

    def __init__(self, seams: np.ndarray, encode, prefix: str = ""):
        self.seams, self.encode, self.prefix = seams.reshape(-1), encode, prefix
        self.known, self.size = {}, 0

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Offsets of each text's ids, and the ids of all texts (large strings without nulls)."""
        if self.prefix:
            empty = pc.equal(texts, pa.scalar("", pa.large_string()))
            texts = pc.if_else(empty, texts, pc.binary_join_element_wise(
                pa.scalar(self.prefix, pa.large_string()), texts, pa.scalar("", pa.large_string())))
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        first, bounds = int(bounds[0]), bounds - bounds[0]
        data = texts.buffers()[2]
        if data is None or not bounds[-1]:
            return np.zeros(len(texts) + 1, np.int64), pa.array([], pa.int32())
        data = data.slice(first, int(bounds[-1]))
        text = np.frombuffer(data, np.uint8)
        cut = np.ones(len(text) + 1, bool)
        cut[1:-1] = self.seams[text[:-1].astype(np.uint16) * 256 + text[1:]]
        cut[bounds] = True
        starts = np.flatnonzero(cut)
        chunks = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), data).dictionary_encode()
        table = self.lookup(chunks.dictionary.to_pylist())
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        lists = pa.LargeListArray.from_arrays(
            np.concatenate(([0], np.cumsum(sizes))), pa.array(np.frombuffer(b"".join(table), np.int32)))
        codes = chunks.indices
        ends = np.concatenate(([0], np.cumsum(sizes[codes.to_numpy()])))
        return ends[np.searchsorted(starts, bounds)], lists.take(codes).flatten()

    def lookup(self, chunks: list[str]) -> list[bytes]:
        if self.size > REMEMBERED_BYTES:
            self.known, self.size = {}, 0
        new = [c for c in chunks if c not in self.known]
        if new:
            found = self.encode(new)
            self.known.update(zip(new, found))
            self.size += sum(map(len, new)) + sum(map(len, found)) + 200 * len(new)
        return [self.known[c] for c in chunks]
