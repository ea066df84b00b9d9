"""Arrow helpers shared by the operators: bounded slices of string columns and vectorised word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute

# Bytes of text that one numpy step looks at; temporaries are about 20 bytes per byte of text.
CHUNK = 1 << 18
_U = np.uint64


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20):
    """Yield (first row, one past the last row) so that each slice has about ``max_bytes`` of text.

    A single longer text is a slice of its own.
    """
    lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    edge = np.cumsum(lengths)
    first = 0
    while first < len(lengths):
        before = edge[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(edge, before + max_bytes, side="right")))
        yield first, last
        first = last


def small_batches(spark) -> None:
    """Let Spark send 1,000 rows at a time to Python, unless the session says otherwise than the default of 10,000.

    Rows hold whole texts; every task has a few batches in memory at once, in Java and in Python.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def merged(batches, rows: int):
    """The same rows in batches of about ``rows`` and more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def planes(rows: np.ndarray) -> bytes:
    """The first bytes of all rows, then all second bytes, and so on: equal high bytes stand together and compress well."""
    rows = np.ascontiguousarray(rows)
    return rows.view(np.uint8).reshape(len(rows), rows.dtype.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype)[:, 0]


def utf8_texts(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def byte_table(members: bytes) -> np.ndarray:
    """A 256-entry table that is True at the given bytes."""
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


# [\x20\x09-\x0D]: the white space between words.
SPACE = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class WordHasher:
    """64-bit hashes of the words of many texts in a few numpy passes.

    A word's hash is a polynomial over random 64-bit values of its bytes in
    the ring of 64-bit integers, with its length and a final mix; it depends
    only on the word's bytes.
    """

    def __init__(self, separators: np.ndarray = SPACE, lower: bool = False, prefix: int = 0):
        """With ``prefix``, `heads` holds the hashes of the words' first so many bytes after each call."""
        rng = np.random.default_rng(20240229)
        value = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        base = int(rng.integers(1 << 60, 1 << 62)) * 2 + 1
        self.sep, self.prefix = separators, prefix
        self.heads = np.zeros(0, np.uint64)
        self._heads: list = []
        self.value = value[LOWER] if lower else value
        self.power = self._powers(base)
        self.inverse = self._powers(pow(base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        p = np.full(CHUNK + 1, base, dtype=np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, first word of each text with the total at the end)."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"\n".join(texts), np.uint8)  # \n keeps words of two texts apart
        begin = np.concatenate([[0], np.cumsum(size + 1)])[:len(texts)]
        hashes, starts, at = [], [], 0
        self._heads = []
        while at < len(data):
            end = min(len(data), at + CHUNK)
            if end < len(data):  # a chunk ends behind a separator, if it has one
                gap = np.flatnonzero(self.sep[data[at:end]])
                if len(gap):
                    end = at + int(gap[-1]) + 1
                else:
                    end = self._one_word(data, at, hashes, starts)
                    at = end
                    continue
            s, h = self._chunk(data[at:end])
            starts.append(s + at)
            hashes.append(h)
            at = end
        self.heads = np.concatenate(self._heads) if self._heads else np.zeros(0, np.uint64)
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        start = np.concatenate(starts)
        return np.concatenate(hashes), np.concatenate([np.searchsorted(start, begin), [len(start)]]).astype(np.int64)

    def _chunk(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(part) + 2, bool)
        np.logical_not(self.sep.take(part), out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[::2], edge[1::2]
        total = np.zeros(len(part) + 1, np.uint64)
        value = self.value.take(part)
        value *= self.power[:len(part)]
        np.cumsum(value, out=total[1:])
        before, inverse = total.take(s), self.inverse.take(s)
        if self.prefix:
            head = np.minimum(e, s + self.prefix)
            self._heads.append(mix((total.take(head) - before) * inverse))
        return s, mix((total.take(e) - before) * inverse + (e - s).astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def _one_word(self, data: np.ndarray, at: int, hashes: list, starts: list) -> int:
        """A word longer than a chunk: hash its pieces, then the pieces' hashes."""
        end, known = at, len(self._heads)
        acc = _U(0x2545F4914F6CDD1D)
        while end < len(data):
            part = data[end:end + CHUNK]
            stop = np.flatnonzero(self.sep[part])
            part = part[:stop[0]] if len(stop) else part
            if len(part):
                with np.errstate(over="ignore"):
                    acc = mix(np.array([acc]) * _U(0x9E3779B97F4A7C15) + self._chunk(part)[1])[0]
            end += len(part)
            if len(stop):
                break
        if self.prefix:  # of the pieces only the first has the word's head
            self._heads[known:] = [self._heads[known][:1]]
        hashes.append(np.array([acc], np.uint64))
        starts.append(np.array([at], np.int64))
        return end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def as_long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
