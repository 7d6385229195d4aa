"""Positions, running totals and look-back over an order, without one task per group.

A window over a whole group puts that group into one task. Here the rows are
range-partitioned by (group, order) instead, the partition number is kept as a chunk id,
and each chunk works by itself; what flows from chunk to chunk (counts, sums, the last
row) is a small table with one row per group and chunk. A group holding most of the
data is then spread over as many tasks as its share asks for.

``order`` names columns, ascending, and must be unique within ``by``. The number of chunks
follows the planner's size estimate, with ``spark.sql.shuffle.partitions`` as the least.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trialbook.operators.attach import attach, planned_bytes
from trialbook.session import pin

CHUNK = "_chunk"
#: An estimate that multiplies up through joins must not ask for more chunks than this.
MOST_CHUNKS = 20_000


#: Bytes that the planner expects in one chunk of an order.
CHUNK_BYTES = 256 << 20


def _chunk_count(df: DataFrame) -> int:
    """One chunk per ``CHUNK_BYTES`` of the planner's estimate, and at least the session's
    number of shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_CHUNKS, -(-planned_bytes(df) // CHUNK_BYTES)))


def ranged(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt by ranges of ``keys``, in as many parts as its size asks for."""
    return df.repartitionByRange(_chunk_count(df), *keys)


def chunk(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Range-partition by (by, order) and keep the partition number; pinned, so it cannot shift."""
    return pin(ranged(df, [*by, *order]).withColumn(CHUNK, F.spark_partition_id()))


def _chunk_windows(by: list[str]) -> tuple[WindowSpec, WindowSpec]:
    """Over the table of chunks: all chunks before this one, and all chunks of the group."""
    group = Window.partitionBy(*by)
    return group.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1), group


def running_total(
    chunks: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums ``name`` and group totals ``name_total`` for each entry."""
    inside = (
        Window.partitionBy(*by, CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before, whole = _chunk_windows(by)
    bases = (
        chunks.groupBy(*by, CHUNK)
        .agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
        .select(
            *by,
            CHUNK,
            *[
                F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}")
                for n in sums
            ],
            *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in sums],
        )
    )
    local = chunks.select("*", *[F.sum(c).over(inside).alias(f"_l_{n}") for n, c in sums.items()])
    joined = attach(local, bases, [*by, CHUNK], how="inner", null_safe=True)
    for n in sums:
        joined = joined.withColumn(n, F.col(f"_l_{n}") + F.col(f"_b_{n}"))
    return joined.drop(*[f"_{p}_{n}" for n in sums for p in "lb"])


def _is_wide(df: DataFrame, keys: list[str]) -> bool:
    """Whether columns besides the keys hold text or nested values."""
    flat = ("string", "binary", "array", "struct", "map", "variant")
    others = [f for f in df.schema.fields if f.name not in keys]
    return len(others) > 4 or any(f.dataType.typeName() in flat for f in others)


def positions(df: DataFrame, by: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """1-based position ``out`` within the group and group size ``out_total``.

    Of a wide table only the keys are ordered and written; the positions then join back
    by key, so the wide columns move once and are not written to the checkpoint folder.
    """
    keys = [*by, *order]
    if _is_wide(df, keys):
        narrow = positions(df.select(*keys), by, order, out)
        named = narrow.withColumnsRenamed({k: f"_k_{k}" for k in keys})
        same = reduce(
            lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
        )
        return df.join(named, same).drop(*[f"_k_{k}" for k in keys])
    # within a sorted partition the low 33 bits of this id count the rows from 0
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = ranged(df, keys).sortWithinPartitions(*keys)
    chunks = pin(ordered.select("*", F.spark_partition_id().alias(CHUNK), place.alias("_at")))
    before, whole = _chunk_windows(by)
    shifts = (
        chunks.groupBy(*by, CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .select(
            *by,
            CHUNK,
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
            F.sum("_n").over(whole).alias(f"{out}_total"),
        )
    )
    joined = attach(chunks, shifts, [*by, CHUNK], how="inner", null_safe=True)
    return joined.withColumn(out, F.col("_at") + F.col("_shift")).drop(CHUNK, "_at", "_shift")


def previous(
    df: DataFrame, by: list[str], order: list[str], columns: list[str], prefix: str = "prev_"
) -> DataFrame:
    """Add the values of the preceding row of the group (NULL on the first).

    Pass the needed columns only: all of them are written once, in order.
    """
    chunks = chunk(df, by, order)
    inside = Window.partitionBy(*by, CHUNK).orderBy(*order)
    across = Window.partitionBy(*by).orderBy(CHUNK)
    last = (
        chunks.groupBy(*by, CHUNK)
        .agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
        .select(*by, CHUNK, F.lag("_last").over(across).alias("_carry"))
    )
    local = chunks.select(
        "*",
        F.row_number().over(inside).alias("_rn"),
        *[F.lag(c).over(inside).alias(f"_p_{c}") for c in columns],
    )
    joined = attach(local, last, [*by, CHUNK], how="inner", null_safe=True)
    for c in columns:
        carried = F.when(F.col("_rn") == 1, F.col(f"_carry.{c}")).otherwise(F.col(f"_p_{c}"))
        joined = joined.withColumn(f"{prefix}{c}", carried)
    return joined.drop("_rn", "_carry", CHUNK, *[f"_p_{c}" for c in columns])


def value_chunks(
    df: DataFrame, by: list[str], value: str, extra: dict[str, Column] | None = None
) -> DataFrame:
    """Distinct values per group with their count ``n``, range-partitioned into chunks.

    Equal values are counted before anything is ordered, so a value shared by many rows
    is one row here.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[c.alias(name) for name, c in (extra or {}).items()],
        )
    )
    return chunk(counts, by, [value])


def ranked_values(
    df: DataFrame, by: list[str], value: str, extra: dict[str, Column] | None = None
) -> DataFrame:
    """One row per group and distinct value: its count ``n``, the count ``below`` and ``total``.

    Ranks and cumulative shares follow from this table.
    """
    chunks = value_chunks(df, by, value, extra)
    run = running_total(chunks, by, [value], {"upto": F.col("n")})
    return (
        run.withColumn("below", F.col("upto") - F.col("n"))
        .withColumnRenamed("upto_total", "total")
        .drop(CHUNK, "upto")
    )


def mean_rank() -> Column:
    """Average rank of a row of ``ranked_values`` (ties share the middle rank)."""
    return F.col("below") + (F.col("n") + 1) / F.lit(2.0)


def percentiles(
    df: DataFrame, by: list[str], value: str, fractions: dict[str, float]
) -> DataFrame:
    """Exact percentiles with linear interpolation, one column per entry of ``fractions``."""
    return percentiles_of(value_chunks(df, by, value), by, value, fractions)


def percentiles_of(
    chunks: DataFrame, by: list[str], value: str, fractions: dict[str, float]
) -> DataFrame:
    """``percentiles`` on a table that ``value_chunks`` already made.

    The counts per chunk tell which chunks hold the wanted ranks; only these few are put
    in order.
    """
    before, whole = _chunk_windows(by)
    sums = (
        chunks.groupBy(*by, CHUNK)
        .agg(F.sum("n").alias("_s"))
        .select(
            *by,
            CHUNK,
            "_s",
            F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"),
            F.sum("_s").over(whole).alias("total"),
        )
    )
    places = {name: F.lit(float(q)) * (F.col("total") - 1) for name, q in fractions.items()}
    ranks = {f"_{n}_{end}": f(at) for n, at in places.items() for end, f in (("lo", F.floor), ("hi", F.ceil))}
    wanted = reduce(
        lambda a, b: a | b,
        [(F.col("_base") <= r) & (r < F.col("_base") + F.col("_s")) for r in ranks.values()],
    )
    near = attach(chunks, sums.filter(wanted).drop("_s"), [*by, CHUNK], how="inner", null_safe=True)
    inside = Window.partitionBy(*by, CHUNK).orderBy(value)
    upto = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.col("_base") + F.col("_upto") - F.col("n")
    hits = [
        F.max(F.when((first <= r) & (r < F.col("_base") + F.col("_upto")), F.col(value))).alias(name)
        for name, r in ranks.items()
    ]
    grouped = near.withColumn("_upto", upto).groupBy(*by).agg(F.max("total").alias("total"), *hits)

    def between(name: str) -> Column:
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return (lo + (hi - lo) * (places[name] - F.floor(places[name]))).alias(name)

    return grouped.select(*by, F.col("total").alias("n"), *[between(n) for n in fractions])


def _hashed(df: DataFrame, key: str, seed: int, digits: int) -> tuple[DataFrame, DataFrame]:
    """Rows with md5(seed:key) and its prefix, and the prefix table: count, rows before it, total.

    The prefixes split the rows evenly whatever the keys are, so no sampling is needed;
    there are 16**digits of them at most, which bounds the table.
    """
    if not 1 <= digits <= 4:
        raise ValueError("digits: 1 to 4, as the prefix table is broadcast")
    hashed = df.filter(F.col(key).isNotNull()).withColumn(
        "_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    )
    hashed = hashed.withColumn("_hp", F.substring("_h", 1, digits))
    before = Window.orderBy("_hp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy("_hp")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(
            "_hp",
            "_c",
            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"),
            F.sum("_c").over(Window.partitionBy(F.lit(1))).alias("_total"),
        )
    )
    return hashed, offsets


def hash_positions(
    df: DataFrame, key: str, seed: int = 42, digits: int = 4, out: str = "pos"
) -> DataFrame:
    """Seeded shuffle: 1-based position of each row in the order of md5(seed:key); rows with
    a NULL key have none and are left out."""
    hashed, offsets = _hashed(df, key, seed, digits)
    inside = Window.partitionBy("_hp").orderBy("_h", key)
    return (
        hashed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets.drop("_c")), "_hp")
        .withColumn(out, F.col("_rn") + F.col("_base"))
        .withColumnRenamed("_total", f"{out}_total")
        .drop("_h", "_hp", "_rn", "_base")
    )


def hash_intervals(
    df: DataFrame,
    key: str,
    cuts: Callable[[Column], list[Column]],
    seed: int = 42,
    digits: int = 4,
    out: str = "interval",
) -> DataFrame:
    """Cut the seeded shuffle at given positions; ``out`` counts the cuts a row lies beyond.

    ``cuts`` gets the number of rows and returns rising positions; ``key`` is unique. Rows
    with a NULL key are drawn nowhere and have a NULL ``out``. The
    prefix counts tell which few prefixes hold a cut, only the keys with those prefixes
    are put in order, and the hash found at each cut becomes a threshold. Every row is
    then placed by comparing its hash: the table itself is neither shuffled nor joined.
    """
    # a narrow table is computed once and kept whole, of a wide one only the keys are
    if not _is_wide(df, [key]):
        df = pin(df)
        hashed, offsets = _hashed(df.select(key), key, seed, digits)
    else:
        hashed, offsets = _hashed(pin(df.select(key)), key, seed, digits)
    offsets = pin(offsets)
    cut_at = cuts(F.col("_total"))

    def holds(c: Column) -> Column:
        return (c > F.col("_base")) & (c <= F.col("_base") + F.col("_c"))

    crossing = offsets.filter(reduce(lambda a, b: a | b, [holds(c) for c in cut_at]))
    place = F.row_number().over(Window.partitionBy("_hp").orderBy("_h", key)) + F.col("_base")
    near = hashed.join(F.broadcast(crossing.drop("_c")), "_hp").withColumn("_pos", place)
    found = near.agg(
        *[
            F.max(F.when(F.col("_pos") == c, F.struct("_h", key))).alias(f"t{i}")
            for i, c in enumerate(cut_at)
        ]
    )
    limits = found.select(F.struct("*")).scalar()
    before_all = offsets.agg(
        F.struct(*[F.max(c <= 0).alias(f"b{i}") for i, c in enumerate(cut_at)])
    ).scalar()
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    marked = df.select(
        "*", limits.alias("_t"), before_all.alias("_b"), F.struct(digest.alias("_h"), key).alias("_at")
    )
    # a cut past the last row has no threshold and is beyond nothing
    passed = [
        F.when(F.col(f"_b.b{i}") | F.coalesce(F.col("_at") > F.col(f"_t.t{i}"), F.lit(False)), 1).otherwise(0)
        for i in range(len(cut_at))
    ]
    place = F.when(F.col(key).isNotNull(), reduce(lambda a, b: a + b, passed))
    return marked.select(*df.columns, place.alias(out))


def _first_chunks(df: DataFrame, by: list[str], order: list[Column], n: int, out: str) -> DataFrame:
    """``top_n`` by ranges of (group, order): ranks within a chunk, shifted by the rows before it."""
    sized = _chunk_count(df)
    ranged = df.repartitionByRange(sized, *[F.col(c) for c in by], *order).sortWithinPartitions(*[F.col(c) for c in by], *order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    chunks = pin(ranged.select("*", F.spark_partition_id().alias(CHUNK), place.alias("_at")))
    before, _ = _chunk_windows(by)
    shifts = (
        chunks.groupBy(*by, CHUNK)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .select(*by, CHUNK, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    )
    joined = attach(chunks, shifts, [*by, CHUNK], how="inner", null_safe=True)
    ranked = joined.withColumn(out, (F.col("_at") + F.col("_shift")).cast("int"))
    return ranked.filter(F.col(out) <= n).select(*df.columns, out)


def top_n(
    df: DataFrame, by: list[str], order: list[Column], n: int, out: str = "rank"
) -> DataFrame:
    """First ``n`` rows per group.

    Spark turns the rank filter into a group limit before the shuffle, so each map task
    sends at most ``n`` rows per group, however large the group is. It does so for ``n``
    below ``spark.sql.optimizer.windowGroupLimitThreshold``; a larger ``n`` would gather whole
    groups, so there the rows are first cut down per (group, chunk of the order): as many
    rows as are before a chunk need not be looked for in it.
    """
    if n >= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        return _first_chunks(df, by, order, n, out)
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= n)
