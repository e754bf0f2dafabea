"""Exact statistics that never gather a column's values in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from thermogrid.operators.gram import pair_correlations
from thermogrid.operators.keyed import attach_row

__all__ = [
    "unpivot_columns", "exact_quantiles", "quantile_columns", "attach_quantiles", "describe_columns", "feature_statistics",
    "missing_report", "drop_sparse_columns", "median_fill_values", "mode_fill_values", "correlation_matrix",
    "correlation_with_target", "constant_columns", "duplicate_columns", "column_roles", "histogram",
    "degree_distribution", "share_of_total", "count_by", "class_area_table", "scaled_columns",
]

_ACCURACY = 10_000
# Rank margins tried around a quantile, tightest first; each must exceed the sketch error plus two rows.
_MARGINS = (5e-4, 1e-2, 1e-1)
# Parts of a bracket that are counted apart.
_SLICES = 256


def unpivot_columns(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name="column", value="value") -> DataFrame:
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(ids), list(columns), name, value)


def _ladder(probs: Sequence[float]) -> list[float]:
    """Ranks the sketch is asked for: every margin around every wanted one."""
    return sorted({round(min(1.0, max(0.0, p + s * m)), 12) for p in probs for m in _MARGINS for s in (-1, 1)})


def _bracket(p: float, ladder: Sequence[float], n: Column, low: Column, high: Column, edges: Column) -> tuple[Column, Column]:
    """Bounds that hold the rank of `p`: the tightest margin that the number of rows allows for."""
    for m in reversed(_MARGINS):
        wide_enough = n * F.lit(m) >= F.lit(2.0) + n * F.lit(2.0 / _ACCURACY)
        a, b = round(min(1.0, max(0.0, p - m)), 12), round(min(1.0, max(0.0, p + m)), 12)
        if a > 0.0:
            low = F.when(wide_enough, F.get(edges, F.lit(ladder.index(a)))).otherwise(low)
        if b < 1.0:
            high = F.when(wide_enough, F.get(edges, F.lit(ladder.index(b)))).otherwise(high)
    return low, high


def _slice(value: Column, low: Column, high: Column) -> Column:
    share = F.when(high > low, (value - low) / (high - low) * F.lit(float(_SLICES - 1))).otherwise(F.lit(0.0))
    return F.floor(share).cast("int")


def _tally_of_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Rows (column, n, i, slice, v, c): values inside the brackets with their counts; i = -1: rows that lie below bracket `slice` and no earlier one.

    Three wide passes: sketches of all columns, counts below all brackets, and the rows with a value in some bracket. Only the last
    ones, few, are taken apart into values.
    """
    ladder = _ladder(probs)
    value = {c: F.col(c).cast("double") for c in columns}
    sketch = df.agg(*[a.alias(f"{c}@{name}") for c in columns for name, a in (
        ("n", F.count(value[c])), ("low", F.min(value[c])), ("high", F.max(value[c])), ("edges", F.percentile_approx(value[c], [float(x) for x in ladder], _ACCURACY)))])

    found = sketch.first()  # one row: as many numbers as columns and ranks ask for
    places = []
    for c in columns:
        n, low, high, edges = (found[f"{c}@{name}"] for name in ("n", "low", "high", "edges"))
        for i, p in enumerate(probs if n else ()):
            a, b = low, high
            for m in reversed(_MARGINS):
                if n * m >= 2.0 + n * 2.0 / _ACCURACY:
                    down, up = round(min(1.0, max(0.0, p - m)), 12), round(min(1.0, max(0.0, p + m)), 12)
                    a = edges[ladder.index(down)] if down > 0.0 else a
                    b = edges[ladder.index(up)] if up < 1.0 else b
            places.append((c, n, i, a, b))
    if not places:
        return df.sparkSession.createDataFrame([], "column string, n long, i int, slice int, v double, c long")

    below = df.agg(*[F.count_if(value[c] < F.lit(a)).alias(f"{c}@{i}") for c, _, i, a, _ in places])
    first = lambda c, i: F.col(f"{c}@{i}") - (F.col(f"{c}@{i - 1}") if i else F.lit(0))
    under = below.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(i).alias("slice"), first(c, i).alias("c")) for c, _, i, _, _ in places])))
    under = under.select("column", F.lit(-1).alias("i"), "slice", F.lit(None).cast("double").alias("v"), "c")

    held = [(value[c] >= F.lit(a)) & (value[c] <= F.lit(b)) for c, _, _, a, b in places]
    some = held[0]
    for h in held[1:]:
        some = some | h
    entry = [F.when(h, F.struct(F.lit(c).alias("column"), F.lit(i).alias("i"), _slice(value[c], F.lit(a), F.lit(b)).alias("slice"), value[c].alias("v"))) for h, (c, _, i, a, b) in zip(held, places)]
    inside = df.where(some).select(F.inline(F.array_compact(F.array(*entry)))).groupBy("column", "i", "slice", "v").agg(F.count(F.lit(1)).alias("c"))
    counts = F.create_map(*[F.lit(x) for c, n in {c: n for c, n, *_ in places}.items() for x in (c, n)])
    tally = under.unionByName(inside)
    return tally.select("column", F.element_at(counts, F.col("column")).cast("long").alias("n"), "i", "slice", "v", F.col("c").cast("long").alias("c"))


def _tally_by_group(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """As above with the groups' columns in front, over rows of single values: brackets differ from group to group."""
    keys = [*by, "column"]
    ladder = _ladder(probs)
    long = unpivot_columns(df, by, columns).where(F.col("value").isNotNull())
    sketch = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("_min"), F.max("value").alias("_max"),
        F.percentile_approx("value", [float(x) for x in ladder], _ACCURACY).alias("_edges"),
    )
    pairs = [_bracket(p, ladder, F.col("n"), F.col("_min"), F.col("_max"), F.col("_edges")) for p in probs]
    brackets = sketch.select(*keys, "n", F.array(*[F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high")) for i, (low, high) in enumerate(pairs)]).alias("_brackets"))
    # A row counts once by the first bracket it lies below, and once more for each bracket that holds it. Brackets go up with
    # their probability, so what lies below one is a sum over the first counts.
    value, none = F.col("value"), F.lit(None).cast("double")
    below = F.size(F.filter("_brackets", lambda b: value >= b["low"]))
    held = F.transform(
        F.filter("_brackets", lambda b: (value >= b["low"]) & (value <= b["high"])),
        lambda b: F.struct(b["i"].alias("i"), _slice(value, b["low"], b["high"]).alias("slice"), value.alias("v")),
    )
    counted = F.concat(F.array(F.struct(F.lit(-1).alias("i"), below.alias("slice"), none.alias("v"))), held)
    tally = long.join(brackets, keys).select(*keys, "n", F.explode(counted).alias("t"))
    return tally.groupBy(*keys, "n", F.col("t.i").alias("i"), F.col("t.slice").alias("slice"), F.col("t.v").alias("v")).agg(F.count(F.lit(1)).alias("c"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles: rows (by..., column, n, q array).

    A mergeable sketch brackets every wanted rank. Then it is counted what lies below the brackets, and only the values inside them
    (about a thousandth of the rows) are tallied, by slices of the bracket; totals of the slices say which one holds a rank, and only
    that slice is sorted. So no task holds a column or a bracket.
    """
    keys = [*by, "column"]
    ordered = sorted(set(probs))
    tally = _tally_by_group(df, columns, ordered, by) if by else _tally_of_table(df, columns, ordered)
    # Slices of a bracket are few and bounded; the one that holds a rank is found from their totals, and only its values are ranked.
    slices = tally.groupBy(*keys, "n", "i", "slice").agg(F.sum("c").alias("c"))
    slices = slices.groupBy(*keys, "n").agg(F.collect_list(F.struct("i", "slice", "c")).alias("_s"))
    position = lambda i: F.get(F.array(*[F.lit(float(p)) for p in ordered]), i) * (F.col("n") - 1)

    def total(rows: Column) -> Column:
        return F.aggregate(rows, F.lit(0).cast("long"), lambda t, s: t + s["c"])

    wanted = slices.select(*keys, "n", "_s", F.explode(F.sequence(F.lit(0), F.lit(len(ordered) - 1))).alias("i"))
    wanted = wanted.select(*keys, "n", "i", position(F.col("i")).alias("pos"), total(F.filter("_s", lambda s: (s["i"] == -1) & (s["slice"] <= F.col("i")))).alias("under"),
                           F.array_sort(F.transform(F.filter("_s", lambda s: s["i"] == F.col("i")), lambda s: F.struct(s["slice"].alias("slice"), s["c"].alias("c")))).alias("_s"))
    placed = F.transform("_s", lambda s: F.struct(s["slice"].alias("slice"), s["c"].alias("c"), (F.col("under") + total(F.filter("_s", lambda o: o["slice"] < s["slice"]))).alias("before")))
    near = F.filter(placed, lambda s: (s["before"] <= F.ceil("pos")) & (s["before"] + s["c"] > F.floor("pos")))
    reached = F.col("under") + total(F.col("_s"))
    missed = (F.col("under") > F.floor("pos")) | (reached <= F.ceil("pos"))
    checked = F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank")).cast("array<struct<slice: int, c: bigint, before: bigint>>")).otherwise(near)
    wanted = wanted.select(*keys, "i", "pos", F.explode(checked).alias("s")).select(*keys, "i", "pos", "s.slice", "s.before")
    ranked = tally.where("i >= 0").join(F.broadcast(wanted) if not by else wanted, [*keys, "i", "slice"])
    running = F.sum("c").over(W.partitionBy(*keys, "i", "slice").orderBy("v").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    picked = ranked.select(*keys, "n", "i", "pos", "v", running.alias("upto")).groupBy(*keys, "n", "i", "pos").agg(
        F.min(F.when(F.col("upto") > F.floor("pos"), F.col("v"))).alias("lower"),
        F.min(F.when(F.col("upto") > F.ceil("pos"), F.col("v"))).alias("upper"),
    )
    x = F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("pos") - F.floor("pos"))
    found = picked.select(*keys, "n", "i", x.alias("x")).groupBy(*keys, "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("q"))
    back = F.array(*[F.get("q", F.lit(ordered.index(p))) for p in probs])
    return found.select(*keys, "n", back.alias("q"))


def quantile_columns(df: DataFrame, column: str, probs: Sequence[float]) -> list[Column]:
    """Whole-table quantiles of one column as scalar subquery columns."""
    q = exact_quantiles(df, [column], probs).select("q").scalar()
    return [q.getItem(i) for i in range(len(probs))]


def attach_quantiles(df: DataFrame, name: str, source: DataFrame, column: str, probs: Sequence[float]) -> DataFrame:
    """Put whole-table quantiles of `source` on every row of `df`, as the array column `name`."""
    return df.withColumn(name, exact_quantiles(source, [column], probs).select("q").scalar())


def describe_columns(df: DataFrame, columns: Sequence[str], aggregates: dict[str, object], by: Sequence[str] = ()) -> DataFrame:
    """One pass of wide aggregates, then one row per column. `aggregates`: name -> function of a column."""
    wide = df.groupBy(*by).agg(*[fn(F.col(c)).alias(f"{c}@{a}") for c in columns for a, fn in aggregates.items()])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}@{a}").alias(a) for a in aggregates]) for c in columns
    ])
    return wide.select(*by, F.inline(rows))


def feature_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, population deviation, min, quartiles and max per column."""
    basic = describe_columns(df, columns, {
        "count": F.count, "mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max,
    })
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    return basic.join(F.broadcast(q), "column", "left").select(
        "column", "count", "mean", "std", "min",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "max",
    )


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing count and percentage per column."""
    table = describe_columns(df, columns, {
        "missing_count": lambda c: F.count_if(c.isNull()), "rows": lambda c: F.count(F.lit(1)),
    })
    pct = F.col("missing_count") / F.greatest(F.col("rows"), F.lit(1)) * F.lit(100.0)
    return table.select("column", "missing_count", pct.alias("missing_pct"))


def drop_sparse_columns(df: DataFrame, columns: Sequence[str], max_missing_pct: float) -> DataFrame:
    """Drop the columns missing more than the given share. Reads one row of counts to fix the schema."""
    sparse = [r["column"] for r in missing_report(df, columns).where(F.col("missing_pct") > max_missing_pct).collect()]
    return df.drop(*sparse)


def median_fill_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return exact_quantiles(df, columns, [0.5]).select("column", F.col("q")[0].alias("fill"))


def mode_fill_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column, the smallest on ties."""
    counts = unpivot_columns(df, [], columns).where(F.col("value").isNotNull()).groupBy("column", "value").count()
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("fill"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair over rows where both are present: one row per pair, from one block of cross products."""
    return pair_correlations(df, columns)


def correlation_with_target(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    return describe_columns(df, columns, {"corr": lambda c: F.corr(c, F.col(target))})


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with at most one value: their minimum equals their maximum."""
    bounds = describe_columns(df, columns, {"low": lambda c: F.min(c.cast("double")), "high": lambda c: F.max(c.cast("double"))})
    return bounds.where(F.col("low").isNull() | (F.col("low") == F.col("high"))).select("column")


def duplicate_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns equal, row for row, to an earlier column.

    One pass sums a hash of each column's value with a hash of its row, which is the same for equal columns only; then only
    columns that share that sum are compared, exactly.
    """
    row = F.xxhash64(*[F.col(c).cast("string") for c in columns])
    marks = df.agg(*[F.sum(F.xxhash64(row, F.col(c).cast("string")) % F.lit(1 << 40)).alias(c) for c in columns]).first()
    alike: dict[object, list[str]] = {}
    for c in columns:
        alike.setdefault(marks[c], []).append(c)
    pairs = [(g[i], g[j]) for g in alike.values() for i in range(len(g)) for j in range(i + 1, len(g))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column string, duplicate_of string")
    wide = df.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"{a}@{b}") for a, b in pairs])
    rows = F.array(*[
        F.struct(F.lit(b).alias("column"), F.lit(columns.index(a)).alias("at"), F.lit(a).alias("first"), F.col(f"{a}@{b}").alias("same"))
        for a, b in pairs
    ])
    return (
        wide.select(F.inline(rows)).where("same").groupBy("column").agg(F.min_by("first", "at").alias("duplicate_of"))
    )


def column_roles(df: DataFrame, target: str, id_names: Sequence[str], max_categorical: int = 12) -> DataFrame:
    """Role per column from names, types and cardinality.

    Only whole-number columns need a distinct count. A sketch settles the clear cases; the exact count runs
    for the columns near a decision only.
    """
    types = dict(df.dtypes)
    whole = [c for c, t in types.items() if t in ("int", "bigint", "smallint", "tinyint") and c not in id_names and c != target]
    sketch = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(c, 0.02).alias(c) for c in whole]).first()
    near = [c for c in whole if sketch[c] <= 2 * max_categorical or sketch[c] >= 0.85 * sketch["n"]]
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first() if near else {}
    roles = []
    for c, t in types.items():
        if c == target:
            role = "target"
        elif c in id_names or (c in near and exact[c] == sketch["n"]):
            role = "id"
        elif t in ("string", "boolean") or (c in near and exact[c] <= max_categorical):
            role = "categorical"
        else:
            role = "numeric"
        roles.append((c, role))
    return df.sparkSession.createDataFrame(roles, "column string, role string")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over the range, last bin closed, nulls dropped first, empty bins kept."""
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    span = values.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    low, width = F.col("_s")["low"], (F.col("_s")["high"] - F.col("_s")["low"]) / F.lit(float(bins))
    index = F.when(width > 0, F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))).otherwise(F.lit(bins // 2))
    counts = attach_row(values, "_s", span).groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = attach_row(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")), "_s", span)
    middle = low + (F.col("bin") + F.lit(0.5)) * width
    return (
        spine.join(F.broadcast(counts), "bin", "left")
        .select("bin", middle.alias("mid"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    )


def degree_distribution(df: DataFrame, column: str, step: float = 5.0) -> DataFrame:
    """Percentage of rows per fixed-width step; the top edge belongs to the last step."""
    values = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    span = values.agg(F.max("v").alias("high"), F.min("v").alias("low"))
    s, high, low = F.lit(step), F.col("_s")["high"], F.col("_s")["low"]
    last = F.greatest(F.ceil(high / s) - 1, F.floor(low / s))
    start = F.least(F.floor(F.col("v") / s), last) * s
    counts = attach_row(values, "_s", span).groupBy(start.cast("double").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return share_of_total(counts, "n", "percent")


def share_of_total(counts: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Percentage of the total; `counts` is an aggregate, so its total is a small scalar."""
    if by:
        total = F.sum(value).over(W.partitionBy(*by))
    else:
        total = counts.agg(F.sum(value).alias("t")).scalar()
    return counts.withColumn(out, F.col(value) / total * F.lit(100.0))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def class_area_table(df: DataFrame, class_column: str, labels: dict[int, str], pixel_area_m2: float, value: str | None = None) -> DataFrame:
    """Pixels, share, hectares and square kilometres per class; classes without pixels stay in the table."""
    extra = [F.min(value).alias("value_min"), F.max(value).alias("value_max")] if value else []
    # At most one row per label is left to broadcast.
    counts = df.where(F.col(class_column).cast("int").isin([int(k) for k in labels])).groupBy(F.col(class_column).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"), *extra)
    total = df.agg(F.count_if(F.col(class_column) > 0).alias("t")).scalar()
    names = df.sparkSession.createDataFrame([(int(k), v) for k, v in labels.items()], "class int, label string")
    n = F.coalesce(F.col("n"), F.lit(0))
    return names.join(F.broadcast(counts), "class", "left").select(
        "class", "label", n.cast("long").alias("pixels"),
        (n / total * F.lit(100.0)).alias("percent"),
        (n * F.lit(pixel_area_m2) / F.lit(1e4)).alias("area_ha"),
        (n * F.lit(pixel_area_m2) / F.lit(1e6)).alias("area_km2"),
        *([F.col("value_min"), F.col("value_max")] if value else []),
    )


def scaled_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Z-score every column against the whole table."""
    from thermogrid.functions import z_score

    wide = df.agg(*[a for c in columns for a in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))])
    row = F.col("_s")
    return attach_row(df, "_s", wide).withColumns({c: z_score(c, row[f"{c}_m"], row[f"{c}_s"]) for c in columns}).drop("_s")
