"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words.  A document's expected copies are its
share of that target; the whole part is certain, and for the fraction the
documents of a source are ranked by the odds of a keyed random number over the
odds of inclusion.  The sample is the prefix of that ranking whose words come
nearest to what the certain copies leave.  The prefix ends at one cutoff per
source, found by a histogram of the ranks and an exact ranking of one bin, so
that no source is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lookup, materialize, partitions, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 17
#: Rows of a source that one histogram bin holds on average, beyond the least number of bins.
BIN_ROWS = 20_000
LEAST_BINS = 512


def ranked_sources(totals: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``totals`` (source, source_size) with the weight of each source, dealt in code point order, null last.

    Ranks come from a range partitioning and the row counts of its partitions,
    which are as many as the session's shuffle partitions.
    """
    n = partitions(totals.sparkSession)
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    rows = totals.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    rows = materialize(rows, "sources")
    before, at = {}, 0
    for part, size in sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()):
        before[part], at = at, at + size
    start = F.element_at(F.create_map(*(F.lit(x) for p in (before or {0: 0}).items() for x in p)), F.col("part"))
    rank = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + start
    return rows.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))).drop("part")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): ``share`` of all words by weight, none above ``most`` times its source's words."""
    rows = materialize(ranked_sources(totals, weights).withColumn("full", F.lit(False)), "weights")
    while True:
        x = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(F.col("full"), F.col("source_size"))).alias("full"), F.sum(F.when(~F.col("full"), F.col("weight"))).alias("w")).first()
        each = (share * (x["all"] or 0) - most * (x["full"] or 0)) / x["w"] if x["w"] else 0.0
        above = ~F.col("full") & (F.lit(each) * F.col("weight") > most * F.col("source_size"))
        if rows.filter(above).isEmpty():
            target = F.when(F.col("full"), F.col("source_size") * float(most)).otherwise(F.lit(each) * F.col("weight"))
            return rows.select("source", "source_size", target.alias("target"))
        rows = materialize(rows.withColumn("full", F.col("full") | above), "weights")


def ticket(seed: int) -> Column:
    """A random number strictly between 0 and 1, the same for the same row in every run."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash")), 11).cast("double") + 0.5) / float(1 << 53)


def _odds(p: Column) -> Column:
    return p / (1 - p)


class Mix:
    """The decisions of one mix: expected copies, rank and cutoff, as expressions over rows and a table per source."""

    def __init__(self, docs: DataFrame, weight: str | Column | None = None, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED):
        self.weight, self.most, self.seed = weight, most, seed
        sized = materialize(self.sized(docs).select("doc_id", "text_hash", "source_key", "source", "size", "value"), "sizes")
        totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.table = materialize(targets(totals, weights, share, most).withColumn("source_key", _key("source")), "targets")
        self.table = materialize(self._rates(sized), "rates")
        self.table = materialize(self._cutoffs(sized), "cutoffs")
        self.rows = sized

    def sized(self, docs: DataFrame) -> DataFrame:
        weight = F.col(self.weight) if isinstance(self.weight, str) else self.weight
        value = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
        return docs.withColumn("value", value).withColumn("text_hash", F.xxhash64("text")).withColumn("source_key", _key("source")).withColumn("size", F.size(words(F.col("text"))).cast("long"))

    def _rates(self, sized: DataFrame) -> DataFrame:
        """Copies per unit of weight and source, with documents held at ``most`` copies."""
        rate = None
        while True:
            if rate is None:
                sums = sized.groupBy("source_key").agg(F.lit(0.0).alias("held"), F.sum(F.col("size") * F.col("value")).alias("free"), F.lit(0).alias("n"))
            else:
                rows = lookup(sized, rate.select("source_key", "rate"), ["source_key"], F.col("text_hash"), "inner")
                full = F.col("value") * F.col("rate") >= self.most
                sums = rows.groupBy("source_key").agg(F.sum(F.when(full, F.col("size")).otherwise(0)).cast("double").alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("size") * F.col("value"))).alias("free"), F.sum(full.cast("int")).alias("n"))
            fresh = self.table.join(sums, "source_key").withColumn("rate", F.when(F.col("free") > 0, (F.col("target") - self.most * F.col("held")) / F.col("free")).otherwise(F.lit(float(self.most))))
            fresh = materialize(fresh.select("source_key", "source", "source_size", "target", "rate", "n"), "rate")
            if self.weight is None or (rate is not None and fresh.join(rate.select("source_key", F.col("n").alias("was")), "source_key").filter("n <> was").isEmpty()):
                return fresh.drop("n")
            rate = fresh

    def _ranked(self, rows: DataFrame) -> DataFrame:
        """Adds whole copies, the inclusion probability of one more, and the Pareto rank."""
        copies = F.least(F.col("value") * F.col("rate"), F.lit(float(self.most)))
        rows = rows.withColumn("copies", copies).withColumn("certain", F.floor("copies")).withColumn("chance", F.col("copies") - F.col("certain"))
        return rows.withColumn("rank", F.when(F.col("chance") > 0, _odds(ticket(self.seed)) / _odds(F.col("chance"))))

    def _cutoffs(self, sized: DataFrame) -> DataFrame:
        """Per source the last row (rank, doc_id, text_hash) of the sampled prefix."""
        rows = self._ranked(lookup(sized, self.table.select("source_key", "rate"), ["source_key"], F.col("text_hash"), "inner"))
        sums = rows.groupBy("source_key").agg(F.sum(F.col("certain") * F.col("size")).alias("sure"), F.avg(F.when(F.col("chance") > 0, F.col("chance"))).alias("mean"), F.count("*").alias("n"))
        left = materialize(self.table.join(sums, "source_key").withColumn("left", F.greatest(F.col("target") - F.col("sure"), F.lit(0.0))).withColumn("bins", F.greatest(F.lit(LEAST_BINS), F.ceil(F.col("n") / BIN_ROWS)).cast("long")), "left")
        rows = lookup(rows.filter("rank is not null"), left.select("source_key", "left", "mean", "bins"), ["source_key"], F.col("text_hash"), "inner")
        scaled = F.col("rank") * _odds(F.col("mean"))
        rows = rows.withColumn("bin", F.least(F.floor(scaled / (1 + scaled) * F.col("bins")), F.col("bins") - 1)).select("source_key", "left", "bin", "rank", "doc_id", "text_hash", "size")
        rows = materialize(rows, "ranked")
        bins = rows.groupBy("source_key", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        upto = F.sum("words").over(W.partitionBy("source_key").orderBy("bin"))
        bins = bins.withColumn("before", upto - F.col("words")).withColumn("upto", upto)
        edge = bins.filter("before <= left and upto > left").groupBy("source_key").agg(F.min(F.struct("bin", "before")).alias("e")).select("source_key", "e.*")
        inside = lookup(rows, edge, ["source_key", "bin"], F.col("text_hash"), "inner")
        run = F.sum("size").over(W.partitionBy("source_key").orderBy("rank", "doc_id", "text_hash"))
        middle = F.col("before") + run - F.col("size") / 2
        row = F.struct("rank", "doc_id", "text_hash")
        last = inside.withColumn("middle", middle).filter("middle <= left").groupBy("source_key").agg(F.max(row).alias("last"))
        ends = edge.join(last, "source_key", "left").select("source_key", "bin", "last", F.lit(True).alias("cut"))
        return left.join(ends, "source_key", "left")

    def decide(self, rows: DataFrame) -> DataFrame:
        """``rows`` (as :meth:`sized`) with source_size, target and the number of copies the mix takes."""
        table = self.table.select("source_key", "source_size", "target", "rate", "mean", "bins", F.col("bin").alias("edge"), "last", "cut")
        rows = self._ranked(lookup(rows, table, ["source_key"], F.col("text_hash")))
        scaled = F.col("rank") * _odds(F.col("mean"))
        at = F.least(F.floor(scaled / (1 + scaled) * F.col("bins")), F.col("bins") - 1)
        taken = F.when(F.col("rank").isNull(), 0).when(F.col("cut").isNull(), 1).when(at < F.col("edge"), 1).when(at > F.col("edge"), 0).when(F.col("last").isNull(), 0).when(F.struct("rank", "doc_id", "text_hash") <= F.col("last"), 1).otherwise(0)
        return rows.withColumn("n_copies", (F.col("certain") + taken).cast("long"))


def _key(source: str) -> Column:
    """A source's name with a mark, so that null is a key of its own."""
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source)))


def by_length(text: str = "text") -> Column:
    """An inclusion weight that prefers long texts without leaving short ones out: the logarithm of the length."""
    return F.log2(F.length(text) + F.lit(2))


def mix(docs: DataFrame, weight: str | Column | None = None, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, n_copies, taken.

    Null and empty texts have no words, and their copies take none.  A null
    source is a source of its own, the last in order.  Rows that repeat doc_id
    and text share a random number and are taken or left together.  ``weight``
    is a column of relative inclusion weights (null or negative: 0), by its name
    or as an expression; without it all documents of a source are equally
    likely.  The sample has a fixed size in words, the target of its source.
    Texts of any length are sized whole; other columns of ``docs`` are not read.
    """
    m = Mix(docs, weight, seed=seed)
    rows = m.decide(m.rows)
    return rows.select("doc_id", "source", "size", "source_size", "target", "n_copies", (F.col("size") * F.col("n_copies")).alias("taken"))


def repeat_by_mix(docs: DataFrame, weight: str | Column | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with every row as often as the mix takes it."""
    own = F.struct(*(F.col(c) for c in docs.columns))
    m = Mix(docs, weight, seed=seed)
    rows = m.decide(m.sized(docs.withColumn("_row", own)).select("_row", "doc_id", "text_hash", "source", "source_key", "size", "value"))
    copy = F.explode(F.array_repeat(F.lit(1), F.col("n_copies").cast("int")))
    return rows.filter("n_copies > 0").select("_row", copy).select("_row.*")
