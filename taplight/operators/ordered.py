"""Ordered per-key computations that stay parallel when one key dominates.

A plain ``Window.partitionBy(key)`` puts a key in one task. Here the key is cut into
time buckets first. Work inside a bucket is a window over (key, bucket); what a bucket
needs from earlier ones arrives as a *carry*: one summary row per (key, bucket), scanned
over the key's buckets and joined back. The scan sees at most one row per bucket, so its
size follows the clock range of the data, not its row count.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import join_null_safe

BUCKET = "_bucket"

_CARRY: Mapping[str, Callable[[str], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max,
}


def bucketed(df: DataFrame, ts: Column, seconds: float) -> DataFrame:
    return df.withColumn(BUCKET, F.floor(ts / F.lit(float(seconds))).cast("bigint"))


def with_carry(df: DataFrame, keys: Sequence[str],
               carries: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Add, per row, aggregates over all earlier buckets of its key.

    ``carries`` maps a new column to (aggregate of one bucket, how buckets combine).
    """
    summary = df.groupBy(*keys, BUCKET).agg(*[a.alias(n) for n, (a, _) in carries.items()])
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = summary.select(*keys, BUCKET, *[
        _CARRY[how](name).over(before).alias(name) for name, (_, how) in carries.items()])
    return join_null_safe(df, offsets, [*keys, BUCKET])


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            columns: Mapping[str, tuple[Column, str]], inclusive: bool = True) -> DataFrame:
    """Running sum/min/max per key up to each row, by default including it.

    ``columns`` maps an output name to (row expression, 'sum' | 'min' | 'max'). Needs a
    bucket column (see ``bucketed``) that grows with the order columns.
    """
    rows = df.withColumns({f"_v_{n}": e for n, (e, _) in columns.items()})
    carried = with_carry(rows, keys, {
        f"_c_{n}": (_CARRY[how](f"_v_{n}"), how) for n, (_, how) in columns.items()})
    here = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    out = {}
    for name, (_, how) in columns.items():
        local, carry = _CARRY[how](f"_v_{name}").over(here), F.col(f"_c_{name}")
        if how == "sum":
            out[name] = F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        else:
            pick = F.greatest if how == "max" else F.least
            out[name] = pick(carry, local)
    drop = [f"_{p}_{n}" for n in columns for p in ("v", "c")]
    return carried.withColumns(out).drop(*drop)


CHUNK = "_chunk"
HOME = "_home"


def chunked(df: DataFrame, keys: Sequence[str], order: Sequence[str], reach: int,
            eligible: Column | None = None, chunk_rows: int = 100_000,
            extra: Mapping[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Cut each key into chunks of ``chunk_rows`` eligible rows, each with its lead-in.

    The last ``reach`` eligible rows of a chunk are copied into the next one, so any
    trailing frame of up to ``reach`` + 1 rows is complete inside a chunk. ``_home`` tells
    a row from a lead-in copy. A row that is not eligible joins the chunk of the last
    eligible row before it. ``extra`` running columns share the ranking pass.
    """
    counts = F.lit(1) if eligible is None else F.when(eligible, 1).otherwise(0)
    ranked = running(df, keys, order, {
        "_seen": (counts.cast("bigint"), "sum"), **(extra or {})})
    position = F.greatest(F.col("_seen"), F.lit(1)) - 1
    chunk = F.floor(position / chunk_rows).cast("bigint")
    lead = position % chunk_rows >= F.lit(chunk_rows - reach)
    if eligible is not None:
        lead = lead & eligible
    placed = ranked.withColumn("_own", chunk).withColumn(
        CHUNK, F.explode(F.when(lead, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    return placed.withColumn(HOME, F.col(CHUNK) == F.col("_own")).drop("_seen", "_own", BUCKET)


def trailing_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                    rows: int, name: str, eligible: Column | None = None,
                    chunk_rows: int = 100_000,
                    extra: Mapping[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Array of ``value`` over the last ``rows`` eligible rows of the key.

    Rows that are not eligible see the series as the latest eligible row left it.
    """
    placed = chunked(df, keys, order, rows - 1, eligible, chunk_rows, extra)
    if eligible is None:
        frame = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(-(rows - 1), 0)
        out = placed.withColumn(name, F.collect_list(value).over(frame))
    else:
        placed = placed.withColumn("_eligible", F.coalesce(eligible, F.lit(False)))
        frame = Window.partitionBy(*keys, CHUNK, "_eligible").orderBy(*order) \
                      .rowsBetween(-(rows - 1), 0)
        carry = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, 0)
        own = F.when(F.col("_eligible"), F.collect_list(value).over(frame))
        out = placed.withColumn("_own_series", own).withColumn(
            name, F.last("_own_series", ignorenulls=True).over(carry)) \
            .drop("_own_series", "_eligible")
    return out.where(HOME).drop(CHUNK, HOME)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str],
         opens: Callable[[Column], Column], fields: Sequence[str] = (),
         name: str = "_run") -> DataFrame:
    """Name each row's run by the order columns of the row that opened it.

    ``opens`` tells from the previous row of the key (a struct of the order columns and
    ``fields``) whether this row opens a run; a key's first row always does. One pass:
    a bucket reports its first and last row and its last opening, and the bucket scan
    settles whether the first row opens given the bucket before.
    """
    at, row = F.struct(*order), F.struct(*order, *fields)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    linked = df.withColumn("_before", F.lag(row).over(local))
    inner = F.col("_before").isNotNull() & opens(F.col("_before"))
    summary = linked.groupBy(*keys, BUCKET).agg(
        F.min(row).alias("_first"), F.max(row).alias("_last"),
        F.max(F.when(inner, at)).alias("_inner"))
    scan = Window.partitionBy(*keys).orderBy(BUCKET)
    placed = summary.withColumn("_tail", F.lag("_last").over(scan)) \
        .select(*keys, BUCKET, "_tail", "_inner", F.col("_first.*"))
    head = F.col("_tail").isNull() | opens(F.col("_tail"))
    opened = F.coalesce("_inner", F.when(head, at))
    offsets = placed.select(
        *keys, BUCKET, head.alias("_head"), F.last(opened, ignorenulls=True).over(
            scan.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    joined = join_null_safe(linked, offsets, [*keys, BUCKET])
    is_open = F.when(F.col("_before").isNull(), F.col("_head")).otherwise(inner)
    latest = F.max(F.when(is_open, at)).over(
        local.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.withColumn(name, F.coalesce(latest, F.col("_carry"))) \
                 .drop("_before", "_head", "_carry", BUCKET)


def idle_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], idle: float,
              bucket_seconds: float = 3600.0, name: str = "_idle") -> DataFrame:
    """Start of the activity each row belongs to: a key quiet for ``idle`` seconds starts anew.

    The first of ``order`` is the time. The streaming operators drop a key's state by the same
    rule, so ``keys`` with this column name one life of that state.
    """
    ts = order[0]
    ran = runs(bucketed(df, F.col(ts), bucket_seconds), keys, order,
               lambda prev: F.col(ts) >= prev[ts] + F.lit(float(idle)), name=name)
    return ran.withColumn(name, F.col(name)[ts])


def anchored_groups(df: DataFrame, keys: Sequence[str], ts: str, order: Sequence[str],
                    width: float, idle: float | None = None, closes: Column | None = None,
                    name: str = "group_start", bucket_seconds: float = 3600.0,
                    span_limit: int = 100_000) -> DataFrame:
    """First time of the fixed-width group each row falls in, and its run.

    A group opens at its first row and takes rows less than ``width`` after that row, so
    its start never slides. Rows ``idle`` or more after the one before, and the row after
    one that ``closes``, always open a new group. These certain openings cut a key into
    runs; only inside a run does one group's start depend on the group before. Null keys are
    keys like any other; rows without a time form one group of their key, with a null start.

    Runs shorter than ``width`` are one group. In longer ones the distinct times are
    folded per run while they number at most ``span_limit``; larger runs are resolved by
    pointer doubling, so that no group is ever gathered in one place.
    """
    gap = width if idle is None else min(idle, width)
    # One column that is never null stands for the key in all joins below: 16 bytes of a digest,
    # as it travels with every row.
    key = F.substring(F.unhex(F.sha2(F.to_json(F.struct(*keys)), 256)), 1, 16)
    rows = df.withColumn("_closes", F.lit(False) if closes is None
                         else F.coalesce(closes, F.lit(False))).withColumn("_key", key)
    timeless = rows.where(F.col(ts).isNull())
    named = cut_lineage(runs(
        bucketed(rows.where(F.col(ts).isNotNull()), F.col(ts), bucket_seconds), ["_key"], order,
        lambda prev: prev["_closes"] | (F.col(ts) >= prev[ts] + gap), ["_closes"]))
    run = ["_key", "_run"]
    spans = named.groupBy(*run).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"),
                                    F.count(F.lit(1)).alias("_n"))
    long_runs = spans.where(F.col("_hi") >= F.col("_lo") + width)
    points = named.select(*run, F.col(ts).alias("_t")).distinct() \
                  .join(long_runs.drop("_lo"), run)
    starts = _fold_starts(points.where(F.col("_n") <= span_limit), run, width)
    if not long_runs.where(F.col("_n") > span_limit).isEmpty():
        starts = starts.unionByName(
            _doubling_starts(points.where(F.col("_n") > span_limit), run, width))
    short = spans.where(F.col("_hi") < F.col("_lo") + width).select(
        *run, F.col("_lo").alias("_start"), F.lit(float("inf")).alias("_stop"), F.col("_hi"))
    following = F.lead("_t").over(Window.partitionBy(*run).orderBy("_t"))
    ranges = starts.select(*run, F.col("_t").alias("_start"), F.col("_hi"),
                           F.coalesce(following, F.lit(float("inf"))).alias("_stop"))
    # Neighbouring rows of a run are less than ``gap`` apart, so a group reaches into at
    # most three cells of ``width``: rows find it by an equi-join on the cell.
    cells = short.unionByName(ranges).select(
        *run, "_start", "_stop", F.explode(F.sequence(
            F.floor(F.col("_start") / width),
            F.floor(F.least("_stop", "_hi") / width))).alias("_cell"))
    placed = named.withColumn("_cell", F.floor(F.col(ts) / width)) \
        .join(cells, [*run, "_cell"]) \
        .where((F.col(ts) >= F.col("_start")) & (F.col(ts) < F.col("_stop"))) \
        .withColumnsRenamed({"_start": name, "_run": f"{name}_run"}) \
        .drop("_stop", "_cell")
    return placed.unionByName(timeless, allowMissingColumns=True).drop("_closes", "_key")


def _fold_starts(points: DataFrame, run: Sequence[str], width: float) -> DataFrame:
    """Group starts of runs small enough to hold: one ordered pass per run."""
    times = points.groupBy(*run, "_hi").agg(F.array_sort(F.collect_list("_t")).alias("_ts"))
    first = F.get("_ts", F.lit(0))
    fold = F.aggregate(
        F.col("_ts"), F.struct(first.alias("last"), F.array(first).alias("starts")),
        lambda acc, t: F.when(
            t >= acc["last"] + width,
            F.struct(t.alias("last"), F.array_append(acc["starts"], t).alias("starts")))
        .otherwise(acc), lambda acc: acc["starts"])
    return times.select(*run, "_hi", F.explode(fold).alias("_t"))


def _doubling_starts(points: DataFrame, run: Sequence[str], width: float) -> DataFrame:
    """Group starts of very long runs.

    Every time points to the first time at least ``width`` later. The starts are what the
    run's first time reaches; following 1, 2, 4, ... pointers at once finds them in
    log2(number of groups) rounds, each an equi-join.
    """
    points = cut_lineage(points.select(*run, "_hi", "_t"))
    probes = points.select(*run, (F.col("_t") + width).alias("_t"), F.lit(0).alias("_kind"),
                           F.col("_t").alias("_from"))
    both = points.select(*run, "_t", F.lit(1).alias("_kind"), F.col("_t").alias("_from")) \
                 .unionByName(probes)
    # Next point at or after each probe: a running minimum read from the far end.
    later = bucketed(both.withColumn("_neg", -F.col("_t")), F.col("_neg"), width) \
        .withColumn("_neg_kind", -F.col("_kind"))
    nxt = running(later, run, ["_neg", "_neg_kind", "_from"], {
        "_next": (F.when(F.col("_kind") == 1, F.col("_t")), "min")})
    jump = cut_lineage(nxt.where((F.col("_kind") == 0) & F.col("_next").isNotNull())
                       .select(*run, F.col("_from").alias("_t"), "_next"))
    reached = points.groupBy(*run, "_hi").agg(F.min("_t").alias("_t"))
    while not jump.isEmpty():
        ahead = reached.join(jump, [*run, "_t"]).select(*run, "_hi", F.col("_next").alias("_t"))
        reached = cut_lineage(reached.unionByName(ahead).distinct())
        hop = jump.select(*run, F.col("_t").alias("_next"), F.col("_next").alias("_far"))
        jump = cut_lineage(jump.join(hop, [*run, "_next"])
                           .select(*run, "_t", F.col("_far").alias("_next")))
    return reached


def sorted_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], fn,
                schema: T.StructType) -> DataFrame:
    """Stream rows, grouped by ``keys`` and ordered, through a batch function.

    Rows arrive in Arrow batches; nothing holds a whole group.
    """
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return placed.mapInPandas(fn, schema)
