"""Thin DataFrame forms of the engine's operators; each is the plan that its SQL gives.

Equi joins name their keys as pairs, so equal column names on both sides stay apart.
``small`` marks a side that may be broadcast if it measures less than the limit below by the
optimizer's statistics; beyond, the join is left to the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.aggregates import aggregate

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS, PAIRS_A_TASK = 2048, 1 << 25  # of interval joins


def scan(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns) if columns else df


def project(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Named columns, in the order given; text is an SQL expression."""
    return df.select(*((F.expr(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()))


def where(df: DataFrame, *conditions: str | Column) -> DataFrame:
    for c in conditions:
        df = df.filter(c)
    return df


def measured(df: DataFrame) -> int:
    """The optimizer's size estimate in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]] | None = None, condition: str | Column | None = None, how: str = "inner", small: bool = False, hint: str | None = None) -> DataFrame:
    """Keys and condition must both hold; neither gives all pairs.  hint: merge, shuffle_hash or shuffle_replicate_nl, for the right side."""
    on: Column | None = None
    for a, b in keys or []:
        on = (left[a] == right[b]) if on is None else on & (left[a] == right[b])
    if condition is not None:
        c = F.expr(condition) if isinstance(condition, str) else condition
        on = c if on is None else on & c
    if small and measured(right) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    if hint:
        right = right.hint(hint)
    return left.crossJoin(right) if on is None else left.join(right, on, how)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, columns: list[str], prefix: str = "") -> DataFrame:
    """Every row of left with ``columns`` of the last row of right that has the same ``by`` and is not later at ``at``.

    One shuffle of both sides and one sorted pass: no pairs are made.  Of right rows of one time any may
    be taken; rows with a null key or time find none.
    """
    found = F.struct(*(F.col(c) for c in columns))
    rows = left.select(*by, at, F.struct("*").alias("_row"), F.lit(None).cast(right.select(found.alias("x")).schema["x"].dataType).alias("_found"))
    rows = rows.unionByName(right.select(*by, at, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), found.alias("_found")))
    known = F.lit(True)
    for c in (*by, at):
        known = known & F.col(c).isNotNull()
    over = Window.partitionBy(*by).orderBy(F.col(at), F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_found", F.last(F.when(known, F.col("_found")), ignorenulls=True).over(over)).filter("_row IS NOT NULL")
    return rows.select("_row.*", *(F.when(known, F.col(f"_found.{c}")).alias(prefix + c) for c in columns))


def interval_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: float, by: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of points and spans (equal in ``by``) with low <= at <= high, for numeric columns.

    Both are dealt to buckets of ``width`` (about a usual span's length), so only near ones meet; a span
    stands in each bucket it touches.  Rows are counted by bucket: if many meet, those of a bucket are dealt on to
    blocks of about ``BLOCK_ROWS`` by a hash of their columns, each block of points meets each block of spans in a
    task, and the number of tasks grows with the pairs.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    points = points.withColumn("_bucket", bucket(at))
    spans = spans.filter(F.col(low) <= F.col(high)).withColumn("_bucket_of", F.explode(F.sequence(bucket(low), bucket(high))))
    keys = [("_bucket", "_bucket_of"), *(by or [])]
    n_points = points.groupBy(*(a for a, _ in keys)).agg(F.count("*").alias("_points"))
    n_spans = spans.groupBy(*(b for _, b in keys)).agg(F.count("*").alias("_spans"))
    sizes = join(n_points, n_spans, keys)
    tasks = int((sizes.agg(F.sum(F.col("_points").cast("double") * F.col("_spans"))).first()[0] or 0) // PAIRS_A_TASK) + 1
    hint = None
    if tasks > 1:
        tasks, hint = max(tasks, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "merge"
        blocks = sizes.select(*(n_points[a].alias(f"_point_{i}") for i, (a, _) in enumerate(keys)), *(n_spans[b].alias(f"_span_{i}") for i, (_, b) in enumerate(keys)), *(F.ceil(F.col(c) / BLOCK_ROWS).alias(c) for c in ("_points", "_spans")))
        points = _dealt(points, blocks, [(a, f"_point_{i}") for i, (a, _) in enumerate(keys)], ("_points", "_spans"), ("_p", "_s"), tasks)
        spans = _dealt(spans, blocks, [(b, f"_span_{i}") for i, (_, b) in enumerate(keys)], ("_spans", "_points"), ("_s_of", "_p_of"), tasks)
        keys += [("_p", "_p_of"), ("_s", "_s_of")]
        points, spans = points.repartition(tasks, *(a for a, _ in keys)), spans.repartition(tasks, *(b for _, b in keys))
    pairs = join(points, spans, keys, F.col(at).between(F.col(low), F.col(high)), hint=hint)
    return pairs.drop("_bucket", "_bucket_of", "_p", "_p_of", "_s", "_s_of")


def _dealt(rows: DataFrame, blocks: DataFrame, keys: list[tuple[str, str]], counts: tuple[str, str], names: tuple[str, str], tasks: int) -> DataFrame:
    """Rows with a block of their own side, once for each block of the other side; equal rows share a block."""
    (own, other), (mine, theirs) = counts, names
    hashed = F.xxhash64(*(c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind))
    found = join(rows, blocks.select(*(b for _, b in keys), own, other), keys).withColumn(mine, F.pmod(hashed, F.col(own)))
    found = found.repartition(tasks, hashed).withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
    return found.select(*rows.columns, mine, theirs)


def exact_quantiles(df: DataFrame, column: str, shares: list[float], at_once: int = 100_000) -> list[float | None]:
    """The values at these shares of the sorted column, between two by their distance (as percentile does).

    Approximate quantiles bracket each until what lies inside is small enough to fetch, so no task holds all
    different values.
    """
    x = F.col(column)
    rows = df.select(x).filter(x.isNotNull())
    n = rows.count()

    def place(k: int):
        low = high = None
        while True:
            inside = rows if low is None else rows.filter(x.between(low, high))
            below, size = (0, n) if low is None else rows.agg(F.coalesce(F.sum((x < low).cast("long")), F.lit(0)), F.coalesce(F.sum(x.between(low, high).cast("long")), F.lit(0))).first()
            if low is not None and low == high:
                return low
            if size <= at_once:
                return sorted(r[0] for r in inside.collect())[k - below]
            at, margin = (k - below) / size, 0.01
            before = low, high
            low, high = inside.agg(F.percentile_approx(x, [max(0.0, at - margin), min(1.0, at + margin)], 1000)).first()[0]
            if (low, high) == before:  # few different values are left
                values = inside.groupBy(x).count().orderBy(x).collect()
                for value, times in values:
                    below += times
                    if k < below:
                        return value

    out: list[float | None] = []
    for share in shares:
        spot = share * (n - 1)
        k = int(spot)
        out.append(None if not n else place(k) if spot == k else place(k) + (place(k + 1) - place(k)) * (spot - k))
    return out


def total(df: DataFrame, **aggregates: tuple[str, str]) -> DataFrame:
    """One row: name=(function, column)."""
    return df.agg(*(aggregate(f, c, name) for name, (f, c) in aggregates.items()))


def grouped(df: DataFrame, keys: list[str], having: str | Column | None = None, kind: str = "groupBy", **aggregates: tuple[str, str]) -> DataFrame:
    """kind: groupBy, rollup or cube."""
    out = getattr(df, kind)(*keys).agg(*(aggregate(f, c, name) for name, (f, c) in aggregates.items()))
    return out.filter(having) if having is not None else out


def order(df: DataFrame, *keys: str) -> DataFrame:
    """Keys as "name", "name desc" or "name nulls first"; nulls come last unless they say so."""
    return df.orderBy(*map(sort_key, keys))


def sort_key(key: str) -> Column:
    """"name", with "desc" and "nulls first" as wanted."""
    name, *words = key.split()
    words = [w.lower() for w in words]
    way, first = "desc" if "desc" in words else "asc", "first" if words[-2:] == ["nulls", "first"] else "last"
    return getattr(F.col(name), f"{way}_nulls_{first}")()


def top(df: DataFrame, n: int, *keys: str, offset: int = 0) -> DataFrame:
    out = order(df, *keys)
    return (out.offset(offset) if offset else out).limit(n)


def ranked(df: DataFrame, by: list[str], *keys: str, name: str = "rank", function: str = "rank", of: int | None = None) -> DataFrame:
    """function: rank, dense_rank, percent_rank, cume_dist, row_number, or ntile ``of`` so many.

    As in SQL, without columns to partition by (here and below) one task sorts all rows: only for small results.
    """
    return df.withColumn(name, getattr(F, function)(*([] if of is None else [of])).over(Window.partitionBy(*by).orderBy(*map(sort_key, keys))))


def shifted(df: DataFrame, by: list[str], column: str, *keys: str, name: str, places: int = 1) -> DataFrame:
    """The column's value so many rows before, or after if places is negative."""
    return df.withColumn(name, F.lag(column, places).over(Window.partitionBy(*by).orderBy(*map(sort_key, keys))))


def within(df: DataFrame, by: list[str], column: str, key: str, before: int, after: int, name: str, function: str = "sum") -> DataFrame:
    """The aggregate of the rows whose numeric key lies at most so much before and after each one's."""
    return df.withColumn(name, aggregate(function, column).over(Window.partitionBy(*by).orderBy(key).rangeBetween(-before, after)))


def running(df: DataFrame, by: list[str], column: str, *keys: str, name: str = "running", function: str = "sum") -> DataFrame:
    """The aggregate of all rows up to each one, in the order of keys."""
    over = Window.partitionBy(*by).orderBy(*map(sort_key, keys)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, aggregate(function, column).over(over))
