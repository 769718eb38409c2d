"""Statistics and mixture models of allele frequencies per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def statistics(loci: DataFrame, percent: float = 100.0, seed: int = 0) -> DataFrame:
    """(sample_id, n, min, max, mean, p25, p50, p75) of a sample of the loci; percentile p lies at position p * (n + 1).

    Equal frequencies are counted first, so what is ordered by sample is a row for each distinct ratio of
    depths, however many loci there are.
    """
    if percent < 100:
        loci = loci.sample(False, percent / 100, seed)
    w = W.partitionBy("sample_id")
    counted = loci.groupBy("sample_id", F.col("vaf").cast("double").alias("vaf")).agg(F.count(F.lit(1)).alias("m"))
    ranked = counted.select("sample_id", "vaf", "m", F.sum("m").over(w.orderBy("vaf").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("last"), F.sum("m").over(w).alias("n"))
    holds = lambda i: ((i <= F.col("last")) & (i > F.col("last") - F.col("m"))).cast("double")

    def at(p: float):
        pos = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), p * (F.col("n") + 1)))
        low = F.floor(pos)
        share = pos - low
        return F.sum(F.col("vaf") * (holds(low) * (1 - share) + holds(F.least(low + 1, F.col("n"))) * share))

    return ranked.groupBy("sample_id").agg(
        F.first("n").alias("n"), F.min("vaf").alias("min"), F.max("vaf").alias("max"), (F.sum(F.col("vaf") * F.col("m")) / F.first("n")).alias("mean"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75")
    )


def gaussian_mixture(loci: DataFrame, clusters: int = 3, seed: int = 1) -> DataFrame:
    """(sample_id, cluster, weight, mean, variance), a mixture per sample; clusters are numbered by mean."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    out = []
    # read once for each sample and round: the pileup is not computed again
    table = VectorAssembler(inputCols=["v"], outputCol="features").transform(loci.select("sample_id", F.col("vaf").cast("double").alias("v"))).persist()
    for row in table.select("sample_id").distinct().orderBy("sample_id").collect():  # as many as samples
        model = GaussianMixture(k=clusters, tol=1e-2, maxIter=50, seed=seed).fit(table.filter(F.col("sample_id") == row[0]))
        parts = sorted((float(g.mean[0]), float(g.cov.toArray()[0][0]), float(w)) for g, w in zip(model.gaussians, model.weights))
        out += [(row[0], i, w, m, v) for i, (m, v, w) in enumerate(parts)]
    table.unpersist()
    return loci.sparkSession.createDataFrame(out, "sample_id int, cluster int, weight double, mean double, variance double")
