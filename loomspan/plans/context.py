"""What queries share: the fixture tables of a directory and the operators' intermediate results over them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import admission, annotation, lift, pairs
from loomspan.plans.fixtures import Fixtures


_MADE: dict[tuple[str, str, str], DataFrame] = {}


def once(context: Context, name: str, make) -> DataFrame:
    """A cached table of the annotation; its size follows the annotation, not the reads."""
    key = (context.spark.sparkContext.applicationId, context.fx.sf_dir, name)
    if key not in _MADE:
        _MADE[key] = make().cache()
    return _MADE[key]


class Context:
    def __init__(self, spark, sf_dir: str):
        self.spark, self.fx = spark, Fixtures(spark, sf_dir)

    @cached_property
    def exons(self) -> DataFrame:
        return self.fx.exons.select("gene_id", "tx_id", "chrom", "strand", "ex_start", "ex_end")

    @cached_property
    def tx(self) -> DataFrame:
        """The annotation is built once a session and used by every later query over the directory."""
        return once(self, "tx", lambda: annotation.build_transcripts(self.exons))

    @cached_property
    def reads(self) -> DataFrame:
        """Reads with the transcript that their rname resolves to."""
        names = once(self, "names", lambda: annotation.resolve_names(self.fx.reads, self.exons))
        return admission.resolved(self.fx.reads, names)

    def lifted(self, sequences: bool = False, **options) -> DataFrame:
        """Converted records only. The optimiser can't prune columns through the lift's generator, so bases and qualities are left
        out before it unless they are asked for."""
        admitted = admission.with_status(self.reads).where("status = 'admitted'").drop("status", *[] if sequences else ["seq", "qual"])
        return lift.lift(admitted, self.tx, **options).where("status = 'converted'")

    def restored(self, cross: bool, flag: str = "flag") -> DataFrame:
        """flag: that of the input, or g_flag for the records as they are written."""
        keyed = self.lifted().withColumn("hi_key", pairs.hi_or_default()).select("aln_id", "qname", "tx_id", "hi_key", F.col(flag).alias("flag"), "chrom", "g_start", "g_end")
        return pairs.restore(keyed, cross)

    @cached_property
    def sq(self) -> DataFrame:
        return annotation.header_sq(self.exons, self.fx.sizes)

    @cached_property
    def genome(self) -> DataFrame:
        return self.fx.genome

    def lines(self, df: DataFrame) -> DataFrame:
        return df.select(F.col("value"))
