"""Fill-in-middle: the lines of a text cut into prefix, middle and suffix, and put in another order.

The ends of a text's lines are a set of code-point offsets, kept as a Roaring
bitmap: offsets that share their upper 16 bits form a container, an array of the
lower 16 bits (few), a bitmap (many) or runs (neighbours, as in a text of empty
lines), whichever is smallest; cumulative cardinalities say which ranks a
container holds. A cut after k lines is the select of rank k: binary search over
the containers, then a local select inside one.

Which lines, which order and whether at all come from the hash of seed and
doc_id alone, so a lost task yields the same again, whatever the partitions.

Defined results: a null text counts as empty, an empty one stays plain, as does
one that holds a sentinel; a null doc_id hashes like an empty one; repeated rows
get the same cuts; a text may be as long as Spark's strings; an empty table gives
no rows. Only doc_id and text are read, other columns may have any name.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
# per cent of documents transformed, and of these in the order suffix, prefix, middle
RATE, SPM_RATE = 100, 50
CONTAINER = 1 << 16
ARRAY_MAX = 4096


class Boundaries:
    """Set of increasing offsets with select by rank."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> 16
        self.keys, starts = np.unique(high, return_index=True)
        self.cumulative = np.append(starts, len(offsets))
        low = (offsets & (CONTAINER - 1)).astype(np.uint16)
        self.containers = [self.container(part) for part in np.split(low, starts[1:])] if len(offsets) else []

    @staticmethod
    def container(low: np.ndarray):
        """('array', values), ('run', first values, cumulative lengths) or ('bitmap', words, cumulative counts)."""
        starts = np.flatnonzero(np.diff(low.astype(np.int64), prepend=-2) != 1)
        if 4 * len(starts) < min(2 * len(low), CONTAINER // 8):
            return "run", low[starts], np.append(starts, len(low))
        if len(low) <= ARRAY_MAX:
            return "array", low
        bits = np.zeros(CONTAINER, np.uint8)
        bits[low] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        return "bitmap", words, np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    def __len__(self):
        return int(self.cumulative[-1]) if len(self.keys) else 0

    def select(self, rank: int) -> int:
        """The offset of a rank, from 0."""
        if not 0 <= rank < len(self):
            raise IndexError(rank)
        c = int(np.searchsorted(self.cumulative, rank, "right")) - 1
        rank -= int(self.cumulative[c])
        kind, *parts = self.containers[c]
        if kind == "array":
            low = int(parts[0][rank])
        else:
            values, counts = parts
            i = int(np.searchsorted(counts, rank, "right")) - 1
            rank -= int(counts[i])
            if kind == "run":
                low = int(values[i]) + rank
            else:
                word = int(values[i])
                for _ in range(rank):  # drop the lowest bits before it
                    word &= word - 1
                low = 64 * i + (word & -word).bit_length() - 1
        return int(self.keys[c]) * CONTAINER + low


def line_ends(text: str) -> np.ndarray:
    """Code-point offsets at which the lines of a text end."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    return ends if not len(points) or len(ends) and ends[-1] == len(points) else np.append(ends, len(points))


def _cuts():
    """Arrow UDF: text and two ranks -> number of lines, offsets of the two cuts."""
    from collections.abc import Iterator

    import pyarrow as pa

    def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, second in batches:
            rows = []
            for text, a, b in zip(texts, first.to_pylist(), second.to_pylist()):
                ends = Boundaries(line_ends(text.as_py()))
                n = len(ends)
                low, high = sorted((a % (n + 1), b % (n + 1)))
                rows.append((n, ends.select(low - 1) if low else 0, ends.select(high - 1) if high else 0))
            yield pa.StructArray.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["n", "prefix", "middle"])

    return F.arrow_udf(cuts, "struct<n: bigint, prefix: bigint, middle: bigint>")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output of docs (doc_id, text)."""
    p, s, m = SENTINELS
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), digest.alias("digest")).select(
        "doc_id", "text", *[d.alias(f"h{i + 1}") for i, d in enumerate(draw)])
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= rate)
    for sentinel in SENTINELS:
        plain |= F.contains("text", F.lit(sentinel))
    rows = rows.select("doc_id", "text", _cuts()("text", "h1", "h2").alias("cut"), plain.alias("plain"),
                       (F.col("h4") % 100 < spm_rate).alias("spm"))
    start, stop = F.col("cut.prefix").cast("int"), F.col("cut.middle").cast("int")
    prefix = F.substring(F.col("text"), F.lit(1), start)
    middle = F.substring(F.col("text"), start + 1, stop - start)
    suffix = F.substring(F.col("text"), stop + 1, F.lit(2**31 - 1) - stop)
    spm = F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)
    psm = F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle)
    return rows.select(
        "doc_id", F.col("cut.n").alias("n"),
        F.when(F.col("plain"), "plain").when(F.col("spm"), "spm").otherwise("psm").alias("form"),
        F.when(~F.col("plain"), F.col("cut.prefix")).alias("prefix_chars"),
        F.when(~F.col("plain"), F.col("cut.middle") - F.col("cut.prefix")).alias("middle_chars"),
        F.when(F.col("plain"), F.col("text")).when(F.col("spm"), spm).otherwise(psm).alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation; a transformed output holds no sentinels but its own three."""
    parts = F.split(output, "|".join(SENTINELS), -1)
    return F.when(form == "plain", output).when(
        form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.concat(parts[1], parts[3], parts[2]))
