"""Document fingerprints: SimHash from weighted term hashes, in SQL functions only.

A term is a pair of neighbouring words, in lower case, weighing as many as its
characters; a text of one word has that word for a term. The 64 bits of a term's
hash vote with its weight, and a fingerprint bit is set by more than half of the
weight. Two bits share one 64-bit sum, so 32 sums make a fingerprint.

Fingerprints within a Hamming radius are found in permuted block tables: of
radius + 1 blocks of bits one must be equal.

Defined results: null counts as empty; a text without words has fingerprint 0;
equal texts have equal fingerprints; repeated rows are rows of their own; among
equal ids the order follows a hash of the text; null ids come last.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotcurve.scratch import stored

WORD_GAP = r"[\x20\x09-\x0D]+"
LANES = (1 << 32) | 1
BUCKET_ROWS = 500
MAX_BOUNDS, MAX_BUCKETS = 256, 1_000_000


def _terms(words: Column) -> Column:
    """(first, second) word of every term."""
    pair = F.size(words) > 1
    first = F.when(pair, F.slice(words, F.lit(1), F.size(words) - 1)).otherwise(words)
    second = F.when(pair, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1))))
    return F.arrays_zip(first.alias("first"), F.coalesce(second, F.transform(words, lambda w: F.lit("")))
                        .alias("second"))


def _votes() -> list[Column]:
    h, weight = F.col("h"), F.col("weight")
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) * weight).alias(f"v{i}") for i in range(32)]


def _bits() -> Column:
    """The fingerprint from the 32 sums of two votes each."""
    total = F.col("total")
    out = F.lit(0).cast("bigint")
    for i in range(32):
        low = F.col(f"v{i}").bitwiseAND(F.lit((1 << 32) - 1))
        high = F.shiftrightunsigned(F.col(f"v{i}"), 32)
        out = out.bitwiseOR(F.when(low * 2 > total, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
        bit = 1 << (i + 32) if i < 31 else -(1 << 63)
        out = out.bitwiseOR(F.when(high * 2 > total, F.lit(bit)).otherwise(F.lit(0)).cast("bigint"))
    return out


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fp (signed long) of each row; keys must be unique.

    Votes are summed where the rows lie; if they are partitioned by some of the
    keys, nothing is shuffled."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), WORD_GAP), "")
    terms = texts.select(*keys, words.alias("words")).select(
        *keys, F.inline_outer(_terms(F.col("words")))).toDF(*keys, "w1", "w2")
    weighted = terms.select(*keys, F.xxhash64("w1", "w2").alias("h"), F.coalesce(
        F.length("w1") + F.length("w2"), F.lit(0)).cast("bigint").alias("weight"))
    return weighted.groupBy(*keys).agg(*_votes(), F.sum("weight").alias("total")).select(*keys, _bits().alias("fp"))


def hex16(fp) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a, b) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def in_buckets(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with a bucket that rises with doc_id; null ids are in bucket -1.

    Quantiles of the ids (at most MAX_BOUNDS numbers) part them evenly, and each
    part is cut into slots of equal width. Beyond MAX_BUCKETS buckets these grow
    instead, so that putting them in order stays a small task."""
    n = docs.agg(F.count("doc_id")).first()[0]
    buckets = min(max(1, -(-n // bucket_rows)), MAX_BUCKETS)
    parts = min(MAX_BOUNDS, buckets)
    shares = [i / parts for i in range(parts + 1)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 10_000).alias("b")).first()["b"] or [0, 0]
    bounds = sorted(set(bounds)) if len(set(bounds)) > 1 else [bounds[0], bounds[0] + 1]
    slots = -(-buckets // (len(bounds) - 1))
    edges = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    part = F.greatest(F.least(F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))), F.lit(len(bounds) - 1)), F.lit(1))
    low, high = F.element_at(edges, part), F.element_at(edges, part + 1)
    inner = F.floor((F.col("doc_id") - low) / (high - low) * slots)
    inner = F.least(F.greatest(inner, F.lit(0)), F.lit(slots - 1))
    return docs.withColumn("bucket", F.coalesce((part - 1) * slots + inner, F.lit(-1)).cast("bigint"))


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(bucket, place, doc_id, text, next_text, copied): each document with the
    text of the next by descending doc_id; after the last comes the first.

    Texts are shuffled once, by bucket. The first document of each bucket is
    copied to the end of the one before (copied = true), so no bucket looks into
    another; only the buckets themselves, one short row each, are put in order
    in one task."""
    docs = in_buckets(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                  F.coalesce("text", F.lit("")).alias("text")), bucket_rows)
    firsts = docs.select("bucket", "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("first_id"))
    order = Window.orderBy(F.desc("bucket"))
    lowest = F.last("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = stored(firsts.select("first_id", F.coalesce(F.lag("bucket").over(order), lowest).alias("before")),
                    "bucket-firsts")
    placed = docs.join(firsts, docs["doc_id"].eqNullSafe(firsts["first_id"]), "left")
    targets = F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("copied")))).otherwise(
        F.array(F.struct(F.col("bucket"), F.lit(False).alias("copied")),
                F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copied"))))
    placed = placed.select("doc_id", "text", F.explode(targets).alias("at")).select(
        "doc_id", "text", F.col("at.bucket").alias("bucket"), F.col("at.copied").alias("copied"))
    along = Window.partitionBy("bucket").orderBy("copied", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return placed.select("bucket", F.row_number().over(along).alias("place"), "doc_id", "text", "copied",
                         F.lead("text").over(along).alias("next_text"))


def edited_half(text: Column, other: Column) -> Column:
    """text with its last half, rounded down, replaced by the start of the other."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def compare_with_edits(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next of all docs."""
    rows = with_next(docs, bucket_rows).withColumn(
        "edited", F.when(~F.col("copied"), edited_half(F.col("text"), F.col("next_text"))))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")),
                    F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))
    keys = ["bucket", "place", "doc_id", "copied", "n_chars", "sha"]
    both = rows.select("bucket", "place", "doc_id", "copied", F.length("text").cast("bigint").alias("n_chars"),
                       F.sha2("edited", 256).alias("sha"), F.inline(kinds))
    fps = fingerprints(both.filter((F.col("kind") == 0) | ~F.col("copied")), [*keys, "kind"], "t")
    one = fps.groupBy(*keys).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"),
                                 F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    one = one.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("place")))
    return one.filter(~F.col("copied")).select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), hex16("fp").alias("fingerprint"),
        hex16("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"))


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(query_fp, fp, distance) of all distinct fingerprints fp within radius of
    a distinct query_fp.

    One table per block of bits holds the fingerprints permuted so that the
    block comes first, which is the join key; adaptive splitting takes care of a
    block value held by very many."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(radius + 1)]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in masks])

    def tables(df, name):
        return df.select(name).distinct().select(name, F.posexplode(masks).alias("block", "mask")).select(
            name, "block", F.col(name).bitwiseAND(F.col("mask")).alias("bits"))
    distance = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("fp")))
    return (
        tables(queries, "query_fp").join(tables(fps, "fp"), ["block", "bits"])
        .filter(distance <= radius).select("query_fp", "fp", distance.alias("distance")).distinct())
