"""From raw documents to packed training sequences.

Each stage takes all rows its predecessor kept; all but the last return the
columns of documents. Labels, for the toxicity model only, are read from sf_dir.
"""

from pyspark.sql import functions as F

from shotcurve.llm import exact_dedup, mixing, packing, simhash_dedup, toxicity
from shotcurve.llm.queries import tokenizer_path
from shotcurve.scratch import stored


def reject_toxic(spark, docs, sf_dir):
    """Documents scored 0.5 or more go."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark, docs, sf_dir):
    """Of equal texts the largest doc_id stays; the digests go into a new index."""
    return exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group linked by fingerprints stays."""
    return simhash_dedup.deduplicate(docs, shingle=4, bits=4)


def mix_sources(spark, docs, sf_dir):
    """Every document as often as the target weights take it."""
    return mixing.resample(docs)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of sequences; ids are given by their checksum."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# models, fingerprint links and tokenizers are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents, each one's rows stored before the next reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
