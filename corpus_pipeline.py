"""Corpus pipeline: stages over documents, each a table in the shared folder that the next one reads."""

from loomspan.llm import decontaminate, lang_id, near_copies, packing, pii, simhash
from loomspan.llm.shared import written


def identified(spark, docs, sf_dir):
    """Language ID (5): texts without a language go."""
    return lang_id.keep_identified(docs, lang_id.train(docs))


def deduplicated(spark, docs, sf_dir):
    """Near-dedup (8): SimHash links and what lies beyond its radius, confirmed by similarity 0.8 of five-word shingles; of each
    group the document with the least id stays."""
    return simhash.keep_one(docs, near_copies.grouped)


def decontaminated(spark, docs, sf_dir):
    """Benchmark decontamination (2): documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redacted(spark, docs, sf_dir):
    """PII (6): every span found is replaced by its kind."""
    return pii.redact(docs)


def packed(spark, docs, sf_dir):
    """Best-fit packing (3)."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identified),
    ("SimHash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("PII", redacted),
    ("best-fit packing", packed),
]

#: None: SQL can express neither the trained model nor token ids; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The rows of the last stage, applied to all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
