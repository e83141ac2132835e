"""Character grams of many texts at once.

A gram of up to four 16-bit characters is one number; grams with other characters are
numbered by hash. The grams of a slice of texts are numbered by tables and not by sorting,
and each text is counted over the numbers of its slice.
"""

import sys
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from shotcurve import fixed_values as fv

# counting runs in tasks; it travels by value, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZES = fv.NGRAM_SIZES
# texts counted together, and the characters they have together unless one alone has more
TEXTS, CHARS = 64, 1 << 18


def ranges(starts, stops):
    """The whole numbers of all ranges [start, stop), and the length of each range."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes), sizes


def numbered(keys, size: int):
    """(distinct keys, sorted; the place of each key among them) of keys below size."""
    if size > 1 << 22:
        return np.unique(keys, return_inverse=True)
    place = np.zeros(size, np.int32)
    place[keys] = 1
    found = np.flatnonzero(place)
    place[found] = np.arange(len(found))
    return found, place[keys].astype(np.int64)


def counted(texts: list):
    """(bounds, column, counts, codes, letters): the grams of each text as columns of codes;
    letters: of each size the characters of its grams. A null text has none."""
    docs = ["  ".join((t or "").lower().split()) for t in texts]
    # all words with a space on both sides: two spaces in a row stand between words only
    text = f" {'  '.join(filter(None, docs))} ".encode("utf-32-le")
    chars = np.frombuffer(text, "<u4")
    none = np.zeros(0, np.int64)
    if len(chars) <= 2:
        return np.zeros(len(texts) + 1, np.int64), none, none, none, []
    doc = np.repeat(np.arange(len(docs)), [len(d) + 2 if d else 0 for d in docs])
    alphabet, first = numbered(chars, 0x110000)
    alphabet = alphabet.astype(np.uint32)
    inside = ~((chars[1:] == 32) & (chars[:-1] == 32))
    whole, ids, known = np.ones(len(chars), bool), first, alphabet[:, None]
    columns, owners, codes, letters, total = [], [], [], [], 0
    # a gram is a shorter one and a character more
    for n in range(2, max(SIZES) + 1):
        whole = whole[:-1] & inside[n - 2:]
        at = np.flatnonzero(whole)
        found, column = numbered(ids[at] * len(alphabet) + first[at + n - 1], len(known) * len(alphabet))
        known = np.concatenate([known[found // len(alphabet)], alphabet[found % len(alphabet)][:, None]], axis=1)
        ids = np.zeros(len(whole), np.int64)
        ids[at] = column
        if n in SIZES:
            code = np.zeros(len(known), np.uint64)
            for i in range(n):
                code = code << np.uint64(16) | known[:, i].astype(np.uint64)
            code = code.view(np.int64)
            for i in np.flatnonzero(is_wide(known)):
                code[i] = np.frombuffer(blake2b(spelled_one(known[i]).encode(), digest_size=8).digest(), np.int64)[0]
            columns.append(column + total)
            owners.append(doc[at])
            codes.append(code)
            letters.append(known)
            total += len(known)
    table = np.bincount(np.concatenate(owners) * total + np.concatenate(columns), minlength=len(texts) * total)
    found = np.flatnonzero(table)
    return (np.searchsorted(found, np.arange(len(texts) + 1) * total), found % total,
            table[found], np.concatenate(codes), letters)


def is_wide(letters):
    """Grams with a character of more than 16 bits (or one that numbers and arrays treat apart)."""
    return ((letters == 0) | (letters >= 0xFFFF)).any(axis=1)


def spelled_one(letters) -> str:
    return "".join(map(chr, letters))


def slices(texts: pa.Array):
    """(first row, texts) of slices of bounded size."""
    for lo in range(0, len(texts), TEXTS):
        part, start, size = texts[lo:lo + TEXTS].to_pylist(), 0, 0
        for i, text in enumerate(part):
            size += len(text or "")
            if size > CHARS and i > start:
                yield lo + start, part[start:i]
                start, size = i, len(text or "")
        yield lo + start, part[start:]


def rows(texts: pa.Array):
    """(bounds, codes, counts) of all texts as sparse rows."""
    bounds, found, tf, end = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for _, part in slices(texts):
        ends, column, counts, codes, _ = counted(part)
        bounds.append(ends[1:] + end)
        found.append(codes[column])
        tf.append(counts)
        end += len(column)
    return np.concatenate(bounds), np.concatenate(found), np.concatenate(tf)


def spelled(letters: list) -> pa.Array:
    """The grams as text."""
    parts = [pa.array([], pa.string())]
    for known in letters:
        names = np.ascontiguousarray(known, "<u4").view(f"<U{known.shape[1]}").ravel()
        if (odd := is_wide(known)).any():
            names = names.astype(object)
            for i in np.flatnonzero(odd):
                names[i] = spelled_one(known[i])
        parts.append(pa.array(names, pa.string()))
    return pa.concat_arrays(parts)


def named_counts(batches):
    """Batches with a text in the last column -> the other columns and grams (gram, tf)."""
    for batch in batches:
        keys = batch.schema.names[:-1]
        for lo, part in slices(batch.column(len(keys))):
            bounds, column, counts, _, letters = counted(part)
            grams = pa.StructArray.from_arrays(
                [spelled(letters).take(pa.array(column)), pa.array(counts, pa.int64())], names=["gram", "tf"])
            yield pa.RecordBatch.from_arrays(
                [*batch.slice(lo, len(part)).columns[:-1], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), grams)],
                names=[*keys, "grams"])


def coded_counts(batches):
    """Batches with a text in the last column -> the other columns, grams and counts."""
    for batch in batches:
        keys = batch.schema.names[:-1]
        for lo, part in slices(batch.column(len(keys))):
            bounds, column, counts, codes, _ = counted(part)
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int64())) for x in (codes[column], counts)]
            yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(part)).columns[:-1], *lists], names=[*keys, "grams", "counts"])


def block_counts(batches):
    """Batches with a text in the last column -> the other columns, gram and n: how many
    of the batch's rows with these columns hold the gram."""
    for batch in batches:
        keys = batch.schema.names[:-1]
        bounds, codes, _ = rows(batch.column(len(keys)))
        groups = {}
        for i, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[:-1]))):
            groups.setdefault(key, []).append(i)
        for key, members in groups.items():
            members = np.array(members)
            at, _ = ranges(bounds[members], bounds[members + 1])
            found, n = np.unique(codes[at], return_counts=True)
            own = [pa.array([v] * len(found), t.type) for v, t in zip(key, batch.schema)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found), pa.array(n)], names=[*keys, "gram", "n"])
