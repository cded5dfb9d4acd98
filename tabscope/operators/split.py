"""Train/test splits and k-fold assignment (CV-1..5).

Rows are shuffled by a seeded hash of their key, not by a driver-side random
permutation: ``h = first 52 bits of md5(seed | key)``, exact as a double.
A split or fold is a run of consecutive ranks in ``h`` order, per stratum.
Keys should be unique: rows with equal keys hash equally and always share a
block (so a block can be off by the size of a tie at its boundary).
The hash value at each block boundary comes from the distributed rank
selection of ``functions.quantiles`` (no global sort, no one-task window),
and a row's block is the number of boundaries at or below its hash.
The same assignment is repeatable on any cluster size and survives task
retries, since it depends only on the row's own key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import attach_scalars
from ..functions.quantiles import column_quantiles, running_sums, uniform_cuts
from ..session import cut_lineage

HASH_SPAN = float(16 ** 13)     # of ``order_hash``


def order_hash(key_cols: list[str], seed: int = 42) -> Column:
    """52-bit md5 prefix of ``seed|k1|k2...`` as an exact double."""
    txt = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key_cols])
    return F.conv(F.substring(F.md5(txt), 1, 13), 16, 10).cast("double")


def quantile_strata(df: DataFrame, col: str, q: int = 5) -> Column:
    """``qcut(y, q, duplicates='drop')`` bin index as a Column (edges computed once)."""
    names = {f"q{j}": j / q for j in range(1, q)}
    edges = column_quantiles(df, [col], names).first()
    inner = sorted({edges[n] for n in names}) if edges else []  # at most q - 1 values
    if not inner:
        return F.lit(0)
    return sum((F.when(F.col(col) > F.lit(e), 1).otherwise(0) for e in inner), F.lit(0))


def _hashed(df: DataFrame, key_cols: list[str], seed: int, stratum: Column | None) -> DataFrame:
    """``df`` with ``_s`` (stratum as text, never null) and ``_h`` (hash of the key)."""
    s = F.lit("") if stratum is None else F.coalesce(F.concat(F.lit("s"), stratum.cast("string")), F.lit(""))
    return df.withColumn("_s", s).withColumn("_h", order_hash(key_cols, seed))


def assign_blocks(df: DataFrame, key_cols: list[str], starts: "callable", seed: int = 42,
                  stratum: Column | None = None, out: str = "block") -> DataFrame:
    """Label each row with its block index in hash order within its stratum.

    ``starts(n)`` maps the stratum size Column to an array Column with the
    first rank of blocks 1, 2, ...; block 0 starts at rank 0.
    """
    h = _hashed(df, key_cols, seed, stratum)
    counts = h.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    ranks = counts.select("_s", "_n", F.filter(starts(F.col("_n")), lambda r: r > 0).alias("_ranks"))
    cut = uniform_cuts(h.select("_s", "_h"), ranks, ["_s"], "_h", HASH_SPAN).groupBy("_s").agg(F.collect_list("_v").alias("_cuts"))
    j = h.join(cut, "_s", "left")   # a row per stratum with its inner block ends
    n_in = F.size(F.filter(F.coalesce(F.col("_cuts"), F.array().cast("array<double>")), lambda c: c <= F.col("_h")))
    return j.withColumn(out, n_in.cast("int")).drop("_s", "_h", "_cuts")


def _test_sizes(counts: DataFrame, test_size: float) -> DataFrame:
    """``(_s, _n, _alloc)``: ``ceil(test_size * n)`` rows shared over the strata by largest remainder.

    The remainders are numbered over range partitions, so any number of strata will do; ties go to the smaller stratum.
    """
    c = attach_scalars(counts, counts.agg(F.sum("_n").alias("_tot")))
    wanted = F.ceil(F.lit(test_size) * F.col("_tot"))
    c = c.withColumn("_q", wanted * F.col("_n") / F.col("_tot")).withColumn("_f", F.floor("_q"))
    c = c.withColumn("_o", F.struct((F.col("_f") - F.col("_q")).alias("r"), "_s")).withColumn("_one", F.lit(1).cast("long"))
    place = running_sums(c, [], "_o", ["_one"]).select(F.col("_o._s").alias("_s"), F.col("cum__one").alias("_place"))
    c = attach_scalars(c.join(place, "_s"), c.agg(F.sum("_f").alias("_given")))
    return c.select("_s", "_n", (F.col("_f") + (F.col("_place") < wanted - F.col("_given")).cast("int")).cast("long").alias("_alloc"))


def train_test_split(df: DataFrame, key_cols: list[str], test_size: float = 0.2, seed: int = 42,
                     stratify: Column | None = None) -> DataFrame:
    """Adds ``is_test``: exactly ``ceil(test_size * n)`` rows, shared over strata by largest remainder."""
    h = _hashed(df, key_cols, seed, stratify)
    counts = h.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    alloc = counts.withColumn("_alloc", F.ceil(F.lit(test_size) * F.col("_n"))) if stratify is None else cut_lineage(_test_sizes(counts, test_size))
    ranks = alloc.where("_alloc > 0").select("_s", "_n", F.array(F.col("_alloc").cast("long")).alias("_ranks"))
    cut = uniform_cuts(h.select("_s", "_h"), ranks, ["_s"], "_h", HASH_SPAN)
    cut = alloc.join(cut.select("_s", F.col("_v").alias("_cut")), "_s", "left").select("_s", "_cut", "_alloc")
    test = F.when(F.col("_alloc") <= 0, F.lit(False)).when(F.col("_cut").isNull(), F.lit(True)).otherwise(F.col("_h") < F.col("_cut"))
    return h.join(cut, "_s", "left").withColumn("is_test", test).drop("_s", "_h", "_cut", "_alloc")


def kfold_starts(k: int):
    """sklearn ``KFold`` sizes: the first ``n % k`` folds get one extra row."""
    def starts(n: Column) -> Column:
        q, r = F.floor(n / k), n % k
        return F.array(*[(q * j + F.least(F.lit(j), r)).cast("long") for j in range(1, k)])
    return starts


def kfold(df: DataFrame, key_cols: list[str], k: int = 5, seed: int = 42,
          stratify: Column | None = None) -> DataFrame:
    """CV-2 / CV-3: adds ``fold`` in 0..k-1 (per stratum when ``stratify`` is given)."""
    return assign_blocks(df, key_cols, kfold_starts(k), seed, stratify, out="fold")


def cv_summary(scores: DataFrame, score_col: str = "score", keys: list[str] | None = None) -> DataFrame:
    """CV-4: mean and population std of per-fold scores (and the list)."""
    keys = keys or []
    return scores.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("fold", score_col))).alias("scores"),
        F.avg(score_col).alias("mean"), F.stddev_pop(score_col).alias("std"),
        F.count(F.lit(1)).alias("n_splits"))
