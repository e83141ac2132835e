"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints at most `bits` apart are linked, and documents are grouped by the
links, copies of one fingerprint being one node. A link is found in three steps:

1. The 64 bits are cut into bits + agree blocks. Two linked fingerprints agree
   on at least `agree` whole blocks, so for every choice of blocks those with
   equal block bits meet in one group. A larger `agree` makes more, smaller groups.
2. A group is sorted by Gray rank, which puts similar patterns side by side,
   and gets a tree: a node holds the bits all its members share and their
   pattern, and passes on to its children only what they share beyond that.
3. The tree is joined with itself from the root. Differences in shared bits are
   accumulated on the way down: beyond the limit the two whole subtrees are
   dropped; where even the bits not shared could not exceed it, they are linked
   as a whole, without visiting their pairs.

What leaves a group is one row per member, naming its local component, never
the pairs. Groups larger than `split_rows` are cut into parts that meet two by
two, so no task gets an unbounded group. Components follow from the edges.

Defined results: a null text is empty; a text without words has fingerprint
zero and is linked like any other; of a group the smallest doc_id stays (null
only if there is no other), once if repeated; an empty table gives no rows;
other columns are carried along whatever their names.
"""

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotcurve.llm.components import components
from shotcurve.scratch import stored

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
LEAF, FAN_OUT = 32, 8
SPLIT_ROWS = 100_000


def _simhash():
    # nested, so that it travels to workers by value
    import numpy as np
    import xxhash

    def fingerprint(text: bytes, shingle: int, seed: int) -> int:
        # on bytes, lower() and split() know ASCII letters and white space only
        words = text.lower().split()
        if not words:
            return 0
        n = max(len(words) - shingle + 1, 1)
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        first = [0, *(ends[:n - 1] + 1).tolist()]
        last = ends[len(words) - n:].tolist()
        digest = xxhash.xxh64_intdigest
        votes = np.zeros(64, np.int64)
        for i in range(0, n, 50_000):
            part = [digest(joined[a:b], seed) for a, b in zip(first[i:i + 50_000], last[i:i + 50_000])]
            bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += bits.sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])
    return fingerprint


def with_fingerprint(docs: DataFrame, name: str = "fp", shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """docs with the fingerprint of their text as a signed long."""
    position = [c.lower() for c in docs.columns].index("text")
    make = _simhash

    def run(batches):
        import pyarrow as pa
        fingerprint = make()
        for batch in batches:
            texts = batch.column(position).cast(pa.large_binary())
            values = [fingerprint(t.as_py() or b"", shingle, seed) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())],
                                             names=[*batch.schema.names, name])
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.mapInArrow(run, schema)


def gray_rank(fp) -> Column:
    rank = F.col(fp)
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    return rank


def block_masks(bits: int, agree: int) -> list[int]:
    """One mask per choice of `agree` of the bits + agree blocks, as signed longs."""
    n = bits + agree
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(n)]
    masks = [sum(choice) for choice in combinations(blocks, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def join_group(fps, bits: int):
    """Local root (an index) of each of the Gray-sorted fingerprints of one group.

    fps: unsigned 64-bit numpy array, sorted by Gray rank."""
    import numpy as np

    n = len(fps)
    root = np.arange(n)

    def link(x, y):
        # the larger root of a pair points at the smaller, until all pairs agree
        while True:
            rx, ry = root[x], root[y]
            apart = rx != ry
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(root, np.maximum(rx, ry)[apart], np.minimum(rx, ry)[apart])
            while not np.array_equal(root, root[root]):
                root[:] = root[root]

    # levels[0] are the fingerprints; a node is (first, end, shared bits, pattern)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [(np.arange(n), np.arange(1, n + 1), np.full(n, ones), fps)]
    fan = LEAF
    while len(levels[-1][0]) > 1:
        first, end, shared, pattern = levels[-1]
        starts = np.arange(0, len(first), fan)
        stops = np.append(starts[1:], len(first)) - 1
        all_of = np.bitwise_and.reduceat(pattern & shared, starts)
        any_of = np.bitwise_or.reduceat(pattern | ~shared, starts)
        same = ~(all_of ^ any_of) & np.bitwise_and.reduceat(shared, starts)
        levels.append((first[starts], end[stops], same, all_of & same))
        fan = FAN_OUT

    def spans(lo, hi):
        # indices lo..hi-1 of every row, one after another
        size = hi - lo
        row = np.repeat(np.arange(len(lo)), size)
        return row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[row]

    top = len(levels) - 1
    stack = [(top, np.array([0]), np.array([0]), np.array([0]))]
    while stack:
        level, a, b, acc = stack.pop()
        if len(a) > 65_536:
            half = len(a) // 2
            stack += [(level, a[:half], b[:half], acc[:half]), (level, a[half:], b[half:], acc[half:])]
            continue
        first, end, shared, pattern = levels[level]
        both = shared[a] & shared[b]
        # all bits the two nodes share; what their parents shared is counted already
        if level < top:
            up = levels[level + 1]
            width = LEAF if level == 0 else FAN_OUT
            known = up[2][a // width] & up[2][b // width]
        else:
            known = np.uint64(0)
        acc = acc + np.bitwise_count((pattern[a] ^ pattern[b]) & both & ~known)
        near = acc <= bits
        a, b, acc, both = a[near], b[near], acc[near], both[near]
        whole = acc + np.bitwise_count(~both) <= bits
        for x, y in ((a[whole], a[whole]), (a[whole], b[whole])):
            row, member = spans(first[y], end[y])
            link(first[x][row], member)
        if level == 0:
            continue
        a, b, acc = a[~whole], b[~whole], acc[~whole]
        width = LEAF if level == 1 else FAN_OUT
        below = len(levels[level - 1][0])
        row, left = spans(a * width, np.minimum((a + 1) * width, below))
        row2, right = spans((b * width)[row], np.minimum((b + 1) * width, below)[row])
        left, row = left[row2], row[row2]
        keep = left < right if level == 1 else left <= right
        stack.append((level - 1, left[keep], right[keep], acc[row][keep]))
    return root


def _edges_of_sorted(batches, bits: int):
    """Edges (a, b) of the groups of rows (table, key, part, fp), sorted by them."""
    import numpy as np
    import pyarrow as pa

    def out(fps):
        roots = join_group(fps.view(np.uint64), bits)
        linked = roots != np.arange(len(fps))
        if linked.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps[linked]), pa.array(fps[roots[linked]])], names=["a", "b"])

    keys = values = None
    for batch in batches:
        new = [np.asarray(c) for c in batch.columns]
        keys = new[:3] if keys is None else [np.concatenate(x) for x in zip(keys, new[:3])]
        values = new[3] if values is None else np.concatenate([values, new[3]])
        if not len(values):
            continue
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for lo, hi in zip([0, *change[:-1]], change):
            if hi - lo > 1:
                yield from out(values[lo:hi])
        if len(change):
            keys, values = [k[change[-1]:] for k in keys], values[change[-1]:]
    if values is not None and len(values) > 1:
        yield from out(values)


def linked(fps: DataFrame, bits: int = MAX_BITS, agree: int = 1, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints fp at most bits apart."""
    masks = F.array(*[F.lit(m).cast("bigint") for m in block_masks(bits, agree)])
    placed = fps.select("fp", F.posexplode(masks).alias("table", "mask")).select(
        "fp", "table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    large = placed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    large = large.withColumn("parts", F.ceil(F.col("n") / split_rows).cast("int")).drop("n")
    placed = placed.join(large, ["table", "key"])
    # part p of a split group meets every part q in the pair of the two
    own = F.pmod(F.hash("fp"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least(own, q) * F.col("parts")
                        + F.greatest(own, q))
    placed = placed.select("table", "key", F.explode(pairs).alias("part"), "fp")
    grouped = placed.repartition("table", "key", "part").sortWithinPartitions(
        "table", "key", "part", gray_rank("fp"))

    def run(batches):
        yield from _edges_of_sorted(batches, bits)
    return grouped.mapInArrow(run, "a bigint, b bigint")


def fingerprint_groups(fps: DataFrame, bits: int = MAX_BITS, agree: int = 1, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(fp, doc_id: smallest with it, component_id, root_fp: fingerprint of that
    document) from rows (doc_id, fp)."""
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct-fingerprints")
    edges = linked(distinct.select("fp"), bits, agree, split_rows)
    roots = stored(components(edges), "fingerprint-components")
    merged = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col("fp").alias("root_fp")))
    smallest = merged.groupBy("component").agg(first.alias("first"))
    return stored(merged.join(smallest, "component").select(
        "fp", "doc_id", F.col("first.doc_id").alias("component_id"), F.col("first.root_fp").alias("root_fp")),
        "fingerprint-groups")


def annotate(docs: DataFrame, shingle: int = SHINGLE_WORDS, bits: int = MAX_BITS, agree: int = 1) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of all docs."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    fps = stored(with_fingerprint(rows, "fp", shingle).drop("text"), "fingerprints")
    groups = fingerprint_groups(fps, bits, agree)
    # many copies of one fingerprint are spread by adaptive splitting of this join
    return fps.join(groups.select("fp", "component_id"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE_WORDS, bits: int = MAX_BITS, agree: int = 1) -> DataFrame:
    """The rows of docs that stay, one per group, with all their columns."""
    taken = {c.lower() for c in docs.columns}
    fp = next(n for n in ("fp", *(f"fp_{i}" for i in range(len(taken) + 1))) if n not in taken)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    fps = stored(with_fingerprint(rows, "fp", shingle).drop("text"), "fingerprints")
    stays = fingerprint_groups(fps, bits, agree).select(
        F.col("root_fp").alias("_f"), F.col("component_id").alias("_d")).distinct()
    docs = with_fingerprint(docs, fp, shingle)
    kept = docs.join(stays, docs[fp].eqNullSafe(stays["_f"]) & docs["doc_id"].eqNullSafe(stays["_d"]), "left_semi")
    return kept.dropDuplicates([fp, "doc_id"]).drop(fp)
