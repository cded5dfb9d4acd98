"""Exact order statistics that stay distributed at any scale, by one plan at every size.

Quantiles and ranks are found in two scans.  The first builds one mergeable sketch per column or group
(KLL) and reads off a bracket around every wanted rank, ``MARGIN`` of the rows to either
side.  The second counts, in one aggregate for all brackets, the rows of each stretch between brackets and
the distinct values inside them.  Running counts over that (some ``2 * MARGIN`` of the rows a bracket, hot values as one
row each; a bracket is one window partition) give the value at each rank.  A rank that its bracket missed shows in the counts; such brackets
are widened and counted again.

``column_quantiles`` does this for the columns of a wide table, ``exact_quantiles`` for the groups of a tall one,
``uniform_cuts`` for ranks of a uniform hash (its brackets need no sketch).

``rank_ranges`` and ``running_sums`` number all distinct values: range partitions, fixed by a
checkpoint, and a small table of offsets per partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import col
from ..session import cut_lineage

SKETCH = 65_535             # of the KLL sketch: its ranks are off by about 1e-4 of the rows
MARGIN = 4e-4               # share of the rows by which a bracket reaches over the wanted rank
WIDER = 64                  # factor by which a bracket that missed is widened


def tall(df: DataFrame, cols: list[str], name: str = "variable",
         value: str = "value") -> DataFrame:
    """Wide to tall ``(name, value double)``; one shuffle-free projection."""
    if not cols:
        return df.sparkSession.createDataFrame([], f"{name} string, {value} double")
    return (df.select(*[col(c).cast("double").alias(c) for c in cols])
              .unpivot([], [col(c) for c in cols], name, value))


def _base(data: DataFrame, keys: list[str], value: str) -> DataFrame:
    return (data.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("_v"))
                .where(F.col("_v").isNotNull()))


# ---------------------------------------------------------------- brackets
def _shares(probs: list[float], margin: float) -> list[float]:
    """The sketch's arguments: below and above each probability, in [0, 1]."""
    return [min(1.0, max(0.0, p + side * margin)) for p in probs for side in (-1, 1)]


def _counted(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., _stretch, _in, _c, _mn, _mx, _lo)`` of rows ``(keys..., _stretch, _in, _v)``.

    ``_stretch`` numbers the stretches between bracket ends in order of the value, ``_in`` is the value inside a bracket and
    null between them, ``_lo`` the rank of the first row.  Only counts are shuffled.
    """
    c = stretches.groupBy(*keys, "_stretch", "_in").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
    w = Window.partitionBy(*keys, "_stretch").orderBy("_in").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    total = c.groupBy(*keys, "_stretch").agg(F.sum("_c").alias("_t"))
    total = total.select(*keys, "_stretch", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    return c.withColumn("_lo", F.sum("_c").over(w) - F.col("_c")).join(total, [*keys, "_stretch"]).withColumn("_lo", F.col("_lo") + F.col("_before"))


def _value_at(rank: Column) -> Column:
    """The value at a rank inside a counted row: known inside brackets and at the ends of a stretch, else null."""
    return (F.when(F.col("_in").isNotNull(), F.col("_in")).when(rank == F.col("_lo"), F.col("_mn"))
             .when(rank == F.col("_lo") + F.col("_c") - 1, F.col("_mx")))


def _holds(rank: Column) -> Column:
    return (rank >= F.col("_lo")) & (rank < F.col("_lo") + F.col("_c"))


def _interpolate(n: int, p: float) -> tuple[int, int, float]:
    """The two ranks and the weight of the second (linear interpolation)."""
    h = (n - 1) * p
    r = math.floor(h)
    return r, min(r + 1, n - 1), h - r


# ---------------------------------------------------------------- columns of a wide table
def column_quantiles(df: DataFrame, cols: list[str], probs: dict[str, float], variable: str = "variable",
                     margin: float = MARGIN) -> DataFrame:
    """``(variable, n, name1, name2, ...)``: exact quantiles of each column that has values.

    Two scans for all columns together; the brackets and the result have one row per column and probability.
    """
    names, wanted = list(probs), [float(p) for p in probs.values()]
    ddl = f"`{variable}` string, n long" + "".join(f", `{p}` double" for p in names)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], ddl)
    x = df.select(*[col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)])
    shares = _shares(wanted, margin)
    sketch = _sketched(x, range(len(cols)), shares)
    found: dict[int, dict[int, float]] = {}
    todo = {i: _ends(sketch[f"g{i}"], shares) for i in range(len(cols)) if sketch[f"n{i}"]}
    sizes = {i: int(sketch[f"n{i}"]) for i in todo}
    wide = margin
    while todo:
        for i, values in _values_at(x, todo, {i: sorted({r for p in wanted for r in _interpolate(sizes[i], p)[:2]}) for i in todo}).items():
            found.setdefault(i, {}).update(values)
        missed = [i for i in todo if any(v is None for v in found[i].values())]
        wide = max(wide, MARGIN) * WIDER
        todo = {}
        if missed:
            shares = _shares(wanted, wide)
            again = _sketched(x, missed, shares)
            todo = {i: _ends(again[f"g{i}"], shares) for i in missed}
    rows = []
    for i, n in sizes.items():
        out = []
        for p in wanted:
            a, b, t = _interpolate(n, p)
            lo, hi = found[i][a], found[i][b]
            out.append(lo if t == 0 else lo + t * (hi - lo))
        rows.append((cols[i], n, *out))
    return spark.createDataFrame(rows, ddl)


def _quantiles_of(sketch: Column, shares: list[float]) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(s)) for s in shares]))


def _sketched(x: DataFrame, which, shares: list[float]):
    """One row: count ``n{i}`` and the sketch's quantiles ``g{i}`` of the columns ``_{i}``."""
    one = x.agg(*[F.kll_sketch_agg_double(f"_{i}", F.lit(SKETCH)).alias(f"k{i}") for i in which], *[F.count(f"_{i}").alias(f"n{i}") for i in which])
    return one.select(*[F.col(f"n{i}") for i in which], *[F.when(F.col(f"n{i}") > 0, _quantiles_of(F.col(f"k{i}"), shares)).alias(f"g{i}") for i in which]).first()


def _ends(grid: list[float], shares: list[float]) -> list[tuple[float, float]]:
    """Brackets (low, high) from the sketch's values; open at the ends of the column."""
    ends = [-math.inf if s <= 0 else math.inf if s >= 1 else g for g, s in zip(grid, shares)]
    return list(zip(ends[::2], ends[1::2]))


def _values_at(x: DataFrame, brackets: dict[int, list], ranks: dict[int, list[int]]) -> dict[int, dict[int, float]]:
    """The counting pass of all columns: {column: {rank: value, None where a bracket missed it}}."""
    spark = x.sparkSession
    m = range(max(len(ends) for ends in brackets.values()))
    ddl = "_i string" + "".join(f", _l{j} double, _h{j} double" for j in m)
    of = spark.createDataFrame([(f"_{i}", *[e for pair in ends for e in pair]) for i, ends in brackets.items()], ddl)   # a row a column
    v = F.col("_v")
    above = sum(((v >= F.col(f"_l{j}")).cast("int") for j in m), F.lit(0))
    past = sum(((v > F.col(f"_h{j}")).cast("int") for j in m), F.lit(0))
    rows = (x.unpivot([], [f"_{i}" for i in brackets], "_i", "_v").where(v.isNotNull()).join(F.broadcast(of), "_i")
             .select("_i", "_v", above.alias("_a"), past.alias("_p"))
             .select("_i", "_v", (F.col("_a") + F.col("_p")).alias("_stretch"), F.when(F.col("_a") > F.col("_p"), v).alias("_in")))
    want = spark.createDataFrame([(f"_{i}", r) for i, rs in ranks.items() for r in rs], "_i string, _r long")
    got = _counted(rows, ["_i"]).join(F.broadcast(want), "_i").where(_holds(F.col("_r"))).select("_i", "_r", _value_at(F.col("_r")).alias("v"))
    out: dict[int, dict[int, float]] = {}
    for r in got.collect():             # one row per column and rank
        out.setdefault(int(r["_i"][1:]), {})[r["_r"]] = r["v"]
    return out


# ---------------------------------------------------------------- groups of a tall table
def _select(base: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., _r, _v)`` for ``brackets(keys..., _los, _his, _ranks)``; ``_v`` is null where a bracket missed.

    The arrays are sorted and as long as the list of wanted ranks.
    """
    x = base.join(brackets.select(*keys, "_los", "_his"), keys)
    above = F.size(F.filter("_los", lambda lo: lo <= F.col("_v")))
    past = F.size(F.filter("_his", lambda hi: hi < F.col("_v")))
    rows = x.select(*keys, "_v", above.alias("_a"), past.alias("_p")).select(
        *keys, "_v", (F.col("_a") + F.col("_p")).alias("_stretch"), F.when(F.col("_a") > F.col("_p"), F.col("_v")).alias("_in"))
    want = brackets.select(*keys, F.explode(F.array_distinct("_ranks")).alias("_r"))
    return (_counted(rows, keys).join(want, keys).where(_holds(F.col("_r")))
            .select(*keys, "_r", _value_at(F.col("_r")).alias("_v")))


def _all_ranks(base: DataFrame, keys: list[str], brackets, margin: float) -> DataFrame:
    """Widen the brackets of the groups that missed a rank until none does; ``brackets(base, margin)`` makes them."""
    got = cut_lineage(_select(base, brackets(base, margin), keys))
    missed = got.where(F.col("_v").isNull()).select(*keys).distinct()
    if missed.isEmpty():
        return got
    again = _all_ranks(base.join(missed, keys, "left_semi"), keys, brackets, max(margin, MARGIN) * WIDER)
    return got.join(missed, keys, "left_anti").unionByName(again)


def exact_quantiles(data: DataFrame, probs: list[float], keys: list[str],
                    value: str = "value", margin: float = MARGIN) -> DataFrame:
    """``(keys..., p, q)``: exact quantiles with linear interpolation, nulls ignored.

    Groups with no value produce no row.
    """
    if not keys:  # one group: a constant key keeps every join an equi-join
        g = data.select(F.lit(0).alias("_g0"), F.col(value))
        return exact_quantiles(g, probs, ["_g0"], value, margin).drop("_g0")
    base = _base(data, keys, value)
    probs = sorted({float(p) for p in probs})

    def brackets(rows: DataFrame, margin: float) -> DataFrame:
        shares = _shares(probs, margin)
        g = rows.groupBy(*keys).agg(F.kll_sketch_agg_double("_v", F.lit(SKETCH)).alias("_k"), F.count(F.lit(1)).alias("_n"))
        g = g.select(*keys, "_n", _quantiles_of(F.col("_k"), shares).alias("_g"))

        def ends(side):
            return F.array(*[F.lit(-math.inf) if s <= 0 else F.lit(math.inf) if s >= 1 else F.col("_g")[i].cast("double")
                             for i, s in enumerate(shares) if i % 2 == side])
        ranks = [r for p in probs for r in _rank_columns(p)[:2]]
        # a sketch draws at random: kept, so that every branch of the plan cuts at the same brackets
        return cut_lineage(g.select(*keys, ends(0).alias("_los"), ends(1).alias("_his"), F.array(*ranks).alias("_ranks")))

    got = _all_ranks(base, keys, brackets, margin)
    need = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    need = need.select(*keys, F.explode(F.array(*[F.struct(F.lit(p).alias("p"), *[c.alias(a) for c, a in zip(_rank_columns(p), ("_r0", "_r1", "_t"))])
                                                  for p in probs])).alias("s")).select(*keys, "s.*")
    v0 = got.select(*keys, F.col("_r").alias("_r0"), F.col("_v").alias("_v0"))
    v1 = got.select(*keys, F.col("_r").alias("_r1"), F.col("_v").alias("_v1"))
    out = need.join(v0, keys + ["_r0"]).join(v1, keys + ["_r1"])
    q = F.col("_v0") + F.col("_t") * (F.col("_v1") - F.col("_v0"))
    return out.select(*keys, "p", F.when(F.col("_t") == 0, F.col("_v0")).otherwise(q).alias("q"))


def _rank_columns(p: float) -> tuple[Column, Column, Column]:
    """As ``_interpolate``, on the column ``_n``."""
    h = (F.col("_n") - 1) * F.lit(p)
    r = F.floor(h).cast("long")
    return r, F.least(r + 1, F.col("_n") - 1), h - r


def uniform_cuts(data: DataFrame, ranks: DataFrame, keys: list[str], value: str, span: float) -> DataFrame:
    """``(keys..., _r, _v)``: values at 0-based ``ranks(keys..., _n, _ranks)`` of a hash uniform on [0, ``span``).

    The value at rank r of n lies near r / n of the span, within a few times sqrt(n) ranks, so one counting
    pass finds it.  ``_ranks`` is an array; nulls and ranks of n or more are left out.
    """
    base = _base(data, keys, value)
    ranks = ranks.select(*keys, "_n", F.array_sort(F.filter("_ranks", lambda r: r < F.col("_n"))).alias("_ranks"))

    def brackets(rows: DataFrame, margin: float) -> DataFrame:
        around = margin / MARGIN * 8 / F.sqrt(F.col("_n"))      # in shares of the span: eight deviations
        of = ranks.join(rows.select(*keys).distinct(), keys, "left_semi") if margin != MARGIN else ranks
        return of.select(*keys, "_ranks", F.transform("_ranks", lambda r: (r / F.col("_n") - around) * span).alias("_los"),
                         F.transform("_ranks", lambda r: (r / F.col("_n") + around) * span).alias("_his"))
    return _all_ranks(base, keys, brackets, MARGIN)


# ---------------------------------------------------------------- all ranks
def _offsets(d: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Per partition ``_pid`` and group, the sums over earlier partitions (``_o...``)."""
    off = d.groupBy("_pid", *keys).agg(*[F.sum(s).alias(f"_t{s}") for s in sums])
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return off.select("_pid", *keys, *[F.coalesce(F.sum(f"_t{s}").over(w), F.lit(0)).alias(f"_o{s}") for s in sums])


def running_sums(data: DataFrame, keys: list[str], order: str, sums: list[str],
                 descending: bool = False) -> DataFrame:
    """Per distinct ``order`` value: the group totals and the running totals *before* it.

    ``(keys..., order, s..., cum_s...)`` where ``cum_s`` sums the rows strictly earlier in the order.  Distinct
    values are range-partitioned (checkpointed, so bounds are fixed under retries) and stitched by offsets.
    """
    key = F.col(order).desc() if descending else F.col(order).asc()
    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = data.groupBy(*keys, order).agg(*[F.sum(s).alias(s) for s in sums])
    d = cut_lineage(d.repartitionByRange(parts, *[F.col(k) for k in keys], key).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", *keys).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (d.select("_pid", *keys, order, *sums, *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"_c{s}") for s in sums])
             .join(_offsets(d, keys, sums), ["_pid"] + keys)
             .select(*keys, order, *sums, *[(F.col(f"_o{s}") + F.col(f"_c{s}")).alias(f"cum_{s}") for s in sums]))


def rank_ranges(data: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """``(keys..., _v, _c, _start)``: distinct values, counts, 0-based start rank."""
    base = _base(data, keys, value).withColumn("_c", F.lit(1).cast("long"))
    return running_sums(base, keys, "_v", ["_c"]).withColumnRenamed("cum__c", "_start")
