"""Row-position operators that do not put one series into one task.

``Window.partitionBy(series).orderBy(ts)`` sends a whole series to one task, which
fails when a series holds a large share of the table.  Here a table above
``block_rows`` rows is first cut into *blocks*: contiguous runs of
(series, order columns), bounded by split points taken from a key sample.  The
block number is an ordinary deterministic column (a binary search in a literal
array), so windows shuffle on (series, block) and recomputed tasks agree.

What a block needs from the rows before or after it is carried by a small
per-block summary (one row per block) joined back on (series, block): the last n
rows, a row offset, a running total, or the nearest known value.

The order columns must be unique within a series (end them with a tie-break).
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.session import cut_lineage, has_shuffle

KEY = "__key"
BLK = "__blk"
BLOCK_ROWS_CONF = "spark.gaugeflow.blockRows"
DEFAULT_BLOCK_ROWS = 500_000
MAX_BLOCKS = 65_536  # bounds the literal array and the driver-side key sample
SAMPLE_PER_BLOCK = 8
_JSON_TIME = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}


@dataclass(frozen=True)
class Ordered:
    """A frame with a row order per series, possibly cut into blocks."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    blocked: bool
    columns: tuple[str, ...] = ()  # of the given frame, to restore their order

    @property
    def parts(self) -> list[str]:
        return [KEY, BLK] if self.blocked else list(self.keys)

    def window(self, reverse: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if reverse else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.parts).orderBy(*order)

    def on(self, df: DataFrame) -> Ordered:
        return replace(self, df=df)

    def result(self) -> DataFrame:
        if not self.blocked:
            return self.df
        given = [F.col(KEY)[c].alias(c) if c in self.keys else F.col(c) for c in self.columns]
        return self.df.select(*given, *[c for c in self.df.columns if c not in (KEY, BLK, *self.columns)])

    def with_context(self, context: DataFrame) -> DataFrame:
        return self.df.join(context, [KEY, BLK], "left")


def block_rows_of(df: DataFrame, block_rows: int | None) -> int:
    if block_rows is not None:
        return block_rows
    return int(df.sparkSession.conf.get(BLOCK_ROWS_CONF, str(DEFAULT_BLOCK_ROWS)))


def order_rows(
    df: DataFrame,
    order_cols: Sequence[str],
    partition_cols: Sequence[str] = (),
    *,
    block_rows: int | None = None,
    rows: int | None = None,
) -> Ordered:
    """Give ``df`` a row order; cut it into blocks when it exceeds ``block_rows``.

    ``rows`` is an upper bound of the row count when the caller knows one.  A blocked
    frame that is itself the result of a shuffle is written to the shared folder first,
    as it is read for the sample, for the summaries and for the result.
    """
    keys, order = tuple(partition_cols), tuple(order_cols)
    limit = block_rows_of(df, block_rows)
    n = df.count() if rows is None else rows
    if n <= limit:
        return Ordered(df, keys, order, False)
    if has_shuffle(df):
        df = cut_lineage(df)
    n_blocks = min(MAX_BLOCKS, math.ceil(n / limit))
    fields = [*keys, *order]
    splits = _split_points(df.select(*fields), n, n_blocks)
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    blocked = df.withColumn(KEY, key).withColumn(BLK, _block_number(df, fields, splits))
    # the key struct replaces the series columns, so that summaries and the main plan
    # shuffle the same columns and can share one exchange
    return Ordered(blocked.drop(*keys), keys, order, True, tuple(df.columns))


def _split_points(keys: DataFrame, n: int, n_blocks: int) -> list[dict]:
    fraction = min(1.0, SAMPLE_PER_BLOCK * n_blocks / max(n, 1))
    picked = keys.sample(fraction=fraction, seed=17).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(*keys.columns))), _JSON_TIME)
    )
    sample = json.loads(picked.first()[0])
    step = max(1, len(sample) // n_blocks)
    return sample[step::step]


def _block_number(df: DataFrame, fields: Sequence[str], splits: list[dict]) -> Column:
    schema = T.ArrayType(df.select(*fields).schema)
    points = F.from_json(F.lit(json.dumps(splits)), schema, _JSON_TIME)
    return points_at_or_below(points, len(splits), F.struct(*fields))


def points_at_or_below(points: Column, n_points: int, value: Column) -> Column:
    """How many entries of a sorted literal array are <= ``value``, by bitwise descent."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, n_points.bit_length())))])

    def search(v: Column) -> Column:
        return F.aggregate(
            steps, F.lit(0), lambda pos, step: F.when(F.get(points, pos + step - 1) <= v, pos + step).otherwise(pos)
        )

    # bound once as a lambda variable, or the key struct would be rebuilt at every step
    return F.get(F.transform(F.array(value), search), F.lit(0))


# ---------------------------------------------------------------- finite look-back


def _preceding_rows(o: Ordered, cols: Sequence[str], n: int) -> DataFrame:
    """Per block: the ``n`` rows before it, nearest first, as ``__prev``.

    The row_number filter becomes a map-side top-n before the shuffle.
    """
    narrow = o.df.select(KEY, BLK, *dict.fromkeys([*o.order, *cols]))
    tails = (
        narrow.withColumn("__r", F.row_number().over(o.window(reverse=True)))
        .filter(F.col("__r") <= n)
        .groupBy(KEY, BLK)
        .agg(F.array_sort(F.collect_list(F.struct(F.negative("__r").alias("__r"), *cols))).alias("__tail"))
    )
    before = Window.partitionBy(KEY).orderBy(BLK).rowsBetween(-n, -1)
    chain = F.reverse(F.flatten(F.collect_list("__tail").over(before)))
    return tails.select(KEY, BLK, F.slice(chain, 1, n).alias("__prev"))


def with_prior(
    o: Ordered,
    value_col: str,
    *,
    lags: Mapping[str, int] | None = None,
    means: Mapping[str, int] | None = None,
) -> Ordered:
    """Add lags (``name -> k``) and means of up to ``n`` earlier rows (``name -> n``).

    One shuffle and one sort serve every column; the current row never enters a mean.
    """
    lags, means = dict(lags or {}), dict(means or {})
    w, v = o.window(), F.col(value_col)
    if not o.blocked:
        new = {name: F.lag(v, k).over(w) for name, k in lags.items()}
        new |= {name: F.avg(v).over(w.rowsBetween(-n, -1)) for name, n in means.items()}
        return o.on(o.df.withColumns(new))

    reach = max([*lags.values(), *means.values()])
    df = o.with_context(_preceding_rows(o, [value_col], reach))
    df = df.withColumn("__rn", F.row_number().over(w))
    for name, n in means.items():
        frame = w.rowsBetween(-n, -1)
        df = df.withColumns({f"__s_{name}": F.sum(v).over(frame), f"__c_{name}": F.count(v).over(frame)})
    df = df.withColumns({f"__l_{name}": F.lag(v, k).over(w) for name, k in lags.items()})

    rn, prev = F.col("__rn"), F.col("__prev")
    new = {}
    for name, k in lags.items():
        carried = F.get(prev, F.lit(k) - rn)[value_col]
        new[name] = F.when(rn > k, F.col(f"__l_{name}")).otherwise(carried)
    for name, n in means.items():
        need = F.greatest(F.lit(n) - rn + 1, F.lit(0))
        carried = F.filter(
            F.transform(F.slice(F.coalesce(prev, F.array()), F.lit(1), need), lambda s: s[value_col]),
            lambda x: x.isNotNull(),
        )
        total = F.aggregate(carried, F.coalesce(F.col(f"__s_{name}"), F.lit(0.0)), lambda a, x: a + x)
        count = F.size(carried) + F.col(f"__c_{name}")
        new[name] = F.when(count > 0, total / count)
    helper = [c for c in df.columns if c in ("__rn", "__prev") or c[:4] in ("__s_", "__c_", "__l_")]
    return o.on(df.withColumns(new).drop(*helper))


# ---------------------------------------------------------------- gap filling


def fill_linear(o: Ordered, cols: Sequence[str], limit: int) -> Ordered:
    """Linear interpolation by row position, forward, at most ``limit`` rows per gap.

    A leading gap stays missing; a trailing gap carries the last value ``limit`` rows.
    The next known value is found with a reversed running window, since a frame that
    ends at "unbounded following" is quadratic in Spark.
    """
    if not cols:
        return o
    fwd = o.window().rowsBetween(Window.unboundedPreceding, 0)
    back = o.window(reverse=True).rowsBetween(Window.unboundedPreceding, 0)
    df = o.df.withColumn("__rn", F.row_number().over(o.window()))

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("__rn").alias("r")))

    df = df.withColumns({f"__p_{c}": F.last(known(c), ignorenulls=True).over(fwd) for c in cols})
    df = df.withColumns({f"__n_{c}": F.last(known(c), ignorenulls=True).over(back) for c in cols})
    if o.blocked:
        df = o.on(df).with_context(_known_around_blocks(o, cols, limit))
        df = df.withColumns({f"__p_{c}": F.coalesce(f"__p_{c}", f"__cp_{c}") for c in cols})
        df = df.withColumns({f"__n_{c}": F.coalesce(f"__n_{c}", f"__cn_{c}") for c in cols})
    filled = {}
    for c in cols:
        p, n, v = F.col(f"__p_{c}"), F.col(f"__n_{c}"), F.col(c)
        gap = F.col("__rn") - p["r"]
        line = p["v"] + (n["v"] - p["v"]) * gap / (n["r"] - p["r"])
        filled[c] = F.when(v.isNotNull(), v).when(
            gap <= limit, F.when(n.isNotNull(), line).otherwise(p["v"])
        )
    names = [f"__{tag}_{c}" for tag in ("p", "n", "cp", "cn") for c in cols]
    return o.on(df.withColumns(filled).drop("__rn", *names))


def _known_around_blocks(o: Ordered, cols: Sequence[str], limit: int) -> DataFrame:
    """Per block: nearest known value within ``limit`` rows before it and first known after it.

    Positions are relative to the block's own row numbers.  Only map-side combined
    aggregates and the missing rows are shuffled, never the table.
    """
    at = F.struct(*o.order)
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct(*o.order, F.col(c).alias("__v")))).alias(f"__f_{c}") for c in cols]
    per = o.df.groupBy(KEY, BLK).agg(F.count("*").alias("__rows"), *firsts)
    holes = o.df.filter(F.greatest(*[F.col(c).isNull() for c in cols], F.lit(False))).withColumn("__hole", F.lit(True))

    def leads(c: str) -> Column:
        first = F.struct(*[F.col(f"__f_{c}")[x].alias(x) for x in o.order])
        return F.count(F.when(F.col("__hole") & F.col(c).isNull() & (at < first), 1)).alias(f"__d_{c}")

    kept = [F.first(c).alias(c) for c in ("__rows", *[f"__f_{c}" for c in cols])]
    per = per.join(holes, [KEY, BLK], "left").groupBy(KEY, BLK).agg(*kept, *[leads(c) for c in cols])
    before = Window.partitionBy(KEY).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(KEY).orderBy(F.col(BLK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__off", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    following = {}
    for c in cols:
        place = F.col("__off") + F.col(f"__d_{c}") + 1
        first = F.when(F.col(f"__f_{c}").isNotNull(), F.struct(F.col(f"__f_{c}")["__v"].alias("v"), place.alias("r")))
        following[f"__cn_{c}"] = F.last(first, ignorenulls=True).over(after)
    per = per.withColumns(following).join(_preceding_rows(o, cols, limit), [KEY, BLK], "left")
    out = [F.col(KEY), F.col(BLK)]
    for c in cols:
        back = F.array_position(F.transform("__prev", lambda s: s[c].isNotNull()), F.lit(True))
        nearest = F.struct(F.get("__prev", (back - 1).cast("int"))[c].alias("v"), (F.lit(1) - back).cast("int").alias("r"))
        n = F.col(f"__cn_{c}")
        later = F.struct(n["v"].alias("v"), (n["r"] - F.col("__off")).cast("int").alias("r"))
        out += [F.when(back > 0, nearest).alias(f"__cp_{c}"), F.when(n.isNotNull(), later).alias(f"__cn_{c}")]
    return per.select(*out)


# ---------------------------------------------------------------- running totals and ranks


def _block_totals(o: Ordered, sums: Mapping[str, Column]) -> DataFrame:
    """Per block: sums over earlier blocks (``__b_``) and over the whole series (``__a_``).

    The block sums are combined map-side, so no rows are shuffled for them.
    """
    per = o.df.groupBy(KEY, BLK).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    series = Window.partitionBy(KEY)
    before = series.orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    earlier = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__b_{n}") for n in sums]
    return per.select(KEY, BLK, *earlier, *[F.sum(n).over(series).alias(f"__a_{n}") for n in sums])


def running_sums(o: Ordered, sums: Mapping[str, str], totals: Mapping[str, str] | None = None) -> Ordered:
    """Add inclusive running totals, and optionally whole-series totals (``new -> column``)."""
    totals = dict(totals or {})
    frame = o.window().rowsBetween(Window.unboundedPreceding, 0)
    if not o.blocked:
        whole = o.window().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        new = {name: F.sum(c).over(frame) for name, c in sums.items()}
        new |= {name: F.sum(c).over(whole) for name, c in totals.items()}
        return o.on(o.df.withColumns(new))
    columns = dict.fromkeys([*sums.values(), *totals.values()])
    df = o.with_context(_block_totals(o, {c: F.col(c) for c in columns}))
    new = {name: F.col(f"__b_{c}") + F.sum(c).over(frame) for name, c in sums.items()}
    new |= {name: F.col(f"__a_{c}") for name, c in totals.items()}
    return o.on(df.withColumns(new).drop(*[f"__{t}_{c}" for t in "ba" for c in columns]))


def with_rank(o: Ordered, name: str, total: str | None = None) -> Ordered:
    """Add the 1-based row number within the series, and optionally the series' row count."""
    local = F.row_number().over(o.window())
    if not o.blocked:
        new = {name: local}
        if total:
            new[total] = F.count("*").over(Window.partitionBy(*o.parts))
        return o.on(o.df.withColumns(new))
    df = o.with_context(_block_totals(o, {"rows": F.lit(1)}))
    new = {name: F.col("__b_rows") + local}
    if total:
        new[total] = F.col("__a_rows")
    return o.on(df.withColumns(new).drop("__b_rows", "__a_rows"))


def keys_at_rank(o: Ordered, positions: Sequence[int]) -> list[Column]:
    """Order keys (as literal structs) at 0-based ``positions`` of an unpartitioned order.

    Block sizes (a map-side combined count) locate each position; only the blocks that
    hold one are sorted.
    """
    block, inside = F.lit(0), {p: (0, p) for p in positions}
    if o.blocked:
        block = F.col(BLK)
        before = 0
        for blk, size in sorted((r[BLK], r["count"]) for r in o.df.groupBy(BLK).count().collect()):
            inside |= {p: (blk, p - before) for p in positions if before <= p < before + size}
            before += size
    keys = o.df.select(block.alias("__b"), *o.order)
    keys = keys.filter(F.col("__b").isin(sorted({b for b, _ in inside.values()})))
    numbered = keys.withColumn("__rn", F.row_number().over(Window.partitionBy("__b").orderBy(*o.order)))
    hit = F.lit(False)
    for b, at in set(inside.values()):
        hit = hit | ((F.col("__b") == b) & (F.col("__rn") == at + 1))
    rows = numbered.filter(hit).select("__b", "__rn", F.to_json(F.struct(*o.order), _JSON_TIME).alias("k")).collect()
    found = {(r["__b"], r["__rn"] - 1): r["k"] for r in rows}
    schema = o.df.select(*o.order).schema
    return [F.from_json(F.lit(found[inside[p]]), schema, _JSON_TIME) for p in positions]


# ---------------------------------------------------------------- exact order statistics


def order_statistics(df: DataFrame, wanted: Mapping[str, Sequence[int]], bins: int = 4096) -> dict:
    """Exact values at 0-based ranks of numeric columns, by histogram narrowing.

    Ranks count known values (neither NULL nor NaN).  Every pass counts values into ``bins`` cells
    per open (column, rank) and keeps the cell that holds the rank; nothing is sorted and at most
    ``bins`` x ranks rows reach the driver.  The least and the greatest value of a span have cells of
    their own and halves are subtracted, so every pass narrows, whatever the span: infinities are
    settled in the first pass, and spans as wide as the number range do not overflow.
    """
    columns = {c: known(F.col(c)) for c in wanted}
    spans = df.agg(*[f(x).alias(f"{c}__{t}") for c, x in columns.items() for t, f in (("lo", F.min), ("hi", F.max))])
    spans = spans.first()
    # open searches: (column, lowest, highest value) -> rank asked for -> rank inside the span
    open_: dict = {}
    for c, ranks in wanted.items():
        if spans[f"{c}__lo"] is not None:
            open_[(c, spans[f"{c}__lo"], spans[f"{c}__hi"])] = {k: k for k in ranks}
    done = {}
    while True:
        for (c, lo, hi), ranks in open_.items():
            if lo == hi:
                done |= {(c, k): lo for k in ranks}
        open_ = {s: ranks for s, ranks in open_.items() if s[1] != s[2]}
        if not open_:
            return done
        slots = list(open_)
        cells = []
        inside = F.lit(False)
        for i, (c, lo, hi) in enumerate(slots):
            v = columns[c]
            width = hi / 2 - lo / 2
            share = (v / 2 - F.lit(lo) / 2) / F.lit(width) if 0 < width < math.inf else F.lit(0.5)
            between = F.least(F.lit(bins - 2), 1 + F.floor(share * (bins - 2))).cast("long")
            cell = F.when(v <= lo, 0).when(v >= hi, bins - 1).otherwise(between)
            cells.append(
                F.when(v.between(lo, hi), F.struct(F.lit(i).alias("slot"), cell.alias("cell"), v.alias("v")))
            )
            inside = inside | v.between(lo, hi)
        hits = df.filter(inside).select(F.explode(F.array(*cells)).alias("h")).filter(F.col("h").isNotNull())
        counted = (
            hits.groupBy("h.slot", "h.cell")
            .agg(F.count("*").alias("n"), F.min("h.v").alias("lo"), F.max("h.v").alias("hi"))
            .collect()
        )
        narrowed: dict = {}
        for i, s in enumerate(slots):
            before = 0
            for r in sorted((r for r in counted if r["slot"] == i), key=lambda r: r["cell"]):
                for k, inner in open_[s].items():
                    if before <= inner < before + r["n"]:
                        narrowed.setdefault((s[0], r["lo"], r["hi"]), {})[k] = inner - before
                before += r["n"]
        open_ = narrowed


def known(c: Column) -> Column:
    """A number as a double, with NaN read as missing."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of the known values of every column; None where there are none."""
    counts = df.agg(*[F.count(known(F.col(c))).alias(c) for c in cols]).first().asDict()
    wanted = {c: sorted({(n - 1) // 2, n // 2}) for c, n in counts.items() if n}
    values = order_statistics(df, wanted) if wanted else {}
    return {
        c: sum(values[(c, k)] / len(wanted[c]) for k in wanted[c]) if c in wanted else None for c in counts
    }
