"""Cluster resampling by hashed Poisson weights, and permutations by hashed ranks.

A replicate's weight of a cluster is a Poisson(1) draw from a hash of (cluster,
replicate), so a cluster's rows are drawn together, nothing is shuffled to draw,
and any engine with md5 repeats the draws. Rows are summed per cluster first. The
hashes of all replicates are made a block of rows at a time, in Java or numpy, and
never stored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verispan.functions.scalar import poisson_bounds, uniform
from verispan.kernels import digests, jvm
from verispan.operators.ordered import running
from verispan.session import cut


def _prefix(key: Column) -> Column:
    """What the hashed text of ``uniform(key, ...)`` begins with."""
    return F.coalesce(F.concat(key.cast("string"), F.lit("|")), F.lit(""))


def _spread(df: DataFrame, *by: Column) -> DataFrame:
    """df in some tasks per core: its bytes are few for the work they make, so their number can't be left to their size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *by)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together until they fill a block."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and sum(h.num_rows for h in held) + b.num_rows > digests.ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if b.num_rows:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def replicates(clusters: DataFrame, cluster: str, reps: int, sums: dict[str, Column], seed: str) -> DataFrame:
    """rep and the weighted sums per replicate; clusters has one row per cluster. A task gives one row per replicate."""
    d = clusters.select(_prefix(F.col(cluster)).alias("_prefix"), *(e.cast("double").alias(n) for n, e in sums.items()))
    bounds, names = digests.Bounds(poisson_bounds()), list(sums)
    # blocks of rows of one length, their sums in Java (in numpy without it), the sums of a task put together
    blocks = _spread(d, F.col("_prefix")).mapInArrow(_packed(names), "texts binary, vals binary, there binary")
    java = jvm.function(clusters.sparkSession, "WeightedSums", T.BinaryType())
    if java:
        of = np.array(bounds.of, "<f8").tobytes()
        blocks = blocks.select(F.call_function(java, "texts", "vals", F.lit(seed), F.lit(reps), F.lit(of)).alias("sums"), "there")
    schema = T.StructType([T.StructField("rep", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, there, any_row = np.zeros((reps, len(names))), np.zeros(len(names), bool), False
        for b in batches:
            for row in b.to_pylist():
                any_row = True
                there |= np.frombuffer(row["there"], bool)
                total += np.frombuffer(row["sums"], "<f8").reshape(total.shape) if java else _weighted(row["texts"], row["vals"], seed, reps, bounds)
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(range(reps), pa.int32()), *(pa.array(total[:, i] if there[i] else [None] * reps, pa.float64()) for i in range(len(names)))], ["rep", *names])

    return blocks.mapInArrow(part, schema).groupBy("rep").agg(*(F.sum(n).alias(n) for n in names))


def _packed(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows to blocks: the texts' bytes; number of rows and of columns, then the columns with 0 for null; which columns have a value."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[pa.Array, np.ndarray]]:
            for b in batches:
                columns = [b.column(n) for n in names]
                yield b.column("_prefix"), np.column_stack([*(pc.fill_null(c, 0.0).to_numpy(zero_copy_only=False) for c in columns), *(c.is_valid().to_numpy(zero_copy_only=False) for c in columns)])

        for texts, values in digests.filled(parts()):
            vals = np.concatenate([[len(texts), len(names)], values[:, : len(names)].T.ravel()]).astype("<f8")
            yield pa.RecordBatch.from_pydict({"texts": pa.array([texts.tobytes()], pa.binary()), "vals": pa.array([vals.tobytes()], pa.binary()), "there": pa.array([values[:, len(names) :].any(axis=0).tobytes()], pa.binary())})

    return part


def _weighted(texts: bytes, vals: bytes, seed: str, reps: int, bounds: digests.Bounds) -> np.ndarray:
    """The sums of one block per replicate."""
    flat = np.frombuffer(vals, "<f8")
    n, columns = int(flat[0]), int(flat[1])
    block, v = digests.Block(np.arange(n), np.frombuffer(texts, np.uint8).reshape(n, len(texts) // n)), flat[2:].reshape(columns, n)
    return np.array([v @ block.counts(f"{r}|{seed}".encode(), bounds) for r in range(reps)])


def interval(reps: DataFrame, value: str, level: float = 0.95, least: int = 10) -> DataFrame:
    """Percentile interval of the replicates; null bounds under ``least`` of them."""
    a = (1 - level) / 2
    q = lambda p: F.when(F.count(value) >= least, F.percentile(value, F.lit(p)))
    return reps.agg(q(a).alias("lower"), q(0.5).alias("median"), q(1 - a).alias("upper"), F.count(value).alias("n_replicates"))


def permuted_labels(df: DataFrame, label: str, tie: Column, reps: int, seed: str) -> DataFrame:
    """rep, and for each row and replicate a 0/1 label ``drawn``: a random permutation, so every replicate has as many ones as the data.

    The rows with the least hashes of (row, replicate) take the ones; tie must
    name a row. Hashes are ranked over ranges, not in one task. Null labels are left out.
    """
    d = df.where(F.col(label).isNotNull())
    ones = d.agg(F.sum(F.col(label).cast("long")).alias("_ones"))
    e = d.crossJoin(F.broadcast(ones)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))  # one row
    e = e.withColumn("_u", uniform(tie, F.col("rep"), F.lit(seed)))
    r = running(e, [F.col("_u"), tie], {"_rank": F.lit(1)}, ["rep"])
    return r.withColumn("drawn", (F.col("_rank") <= F.col("_ones")).cast("int")).drop("_u", "_rank", "_rank_total", "_ones")


def permutation_pvalue(df: DataFrame, group: Column, label: str, tie: Column, reps: int, seed: str = "perm") -> DataFrame:
    """The within-group correlation of the labels, and (hits + 1) / (reps + 1), a hit being a permutation whose correlation is at least as large.

    The permutations are those of ``permuted_labels``, but no row is repeated per
    replicate: the hash that parts ones from zeros is known but for a narrow margin,
    so rows beneath it are summed per group where they lie, and only the rows within
    it are ranked and added. Where the margin misses, it is widened.
    """
    d = df.where(F.col(label).isNotNull()).select(group.alias("_group"), _prefix(tie).alias("_prefix"), F.col(label).cast("double").alias("_y"), F.col(label).cast("long").alias("_one"))
    if d.schema["_group"].dataType not in (T.LongType(), T.IntegerType(), T.StringType()):
        d = d.withColumn("_group", F.col("_group").cast("string"))
    r = d.agg(F.count(F.lit(1)).alias("n"), F.sum("_one").alias("ones")).first()
    n, ones = r.n, r.ones or 0
    # rows of a group side by side; those without a group are spread
    rows = _spread(d.drop("_one"), F.col("_group"), F.when(F.col("_group").isNull(), F.col("_prefix"))).sortWithinPartitions("_group")
    share, deviations = ones / max(n, 1), 8.0
    while True:
        margin = deviations * (share * (1 - share) / max(n, 1)) ** 0.5 + 16 / max(n, 1) if 0 <= share <= 1 else share + 1.0
        low, high = max(0, int((share - margin) * 2**32)), min(2**32, int((share + margin) * 2**32) + 1)
        sums = cut(_permuted_sums(rows, reps, seed, low, high))
        base = sums.where("_n is null").groupBy("rep").agg(*(F.sum(c).alias(c) for c in ("grouped", "pairs", "sx", "sxx", "sxy", "below")))
        within = sums.where("_n is not null")
        found = within.groupBy("rep").agg(F.count(F.lit(1)).alias("within"))
        missed = base.where("rep >= 0").join(found, "rep", "left").where((F.col("below") > ones) | (F.col("below") + F.coalesce("within", F.lit(0)) < ones))
        if (low, high) == (0, 2**32) or not missed.count():
            break
        deviations *= 16
    # the rows of the margin that still take a one, at most a few for each root of n
    order = Window.partitionBy("rep").orderBy(uniform(F.concat("_prefix", F.col("rep").cast("string")), F.lit(seed)), "_prefix")
    ranked = within.withColumn("_rank", F.row_number().over(order)).join(F.broadcast(base.select("rep", F.col("below").alias("_below"))), "rep")  # a row per replicate
    more = ranked.where((F.col("_rank") <= ones - F.col("_below")) & F.col("_group").isNotNull()).groupBy("rep", "_group").agg(F.count(F.lit(1)).cast("double").alias("_k"), F.first("_n").alias("_n"), F.first("_s").alias("_s"))
    k = F.col("_k")
    more = more.groupBy("rep").agg(F.sum((F.col("_n") - 1) * k).alias("more_x"), F.sum(2 * F.col("_s") * k + k * k - k).alias("more_xy"))
    t = base.where("grouped > 0").join(F.broadcast(more), "rep", "left").na.fill(0.0, ["more_x", "more_xy"])
    share_of = lambda c: F.try_divide(c, F.col("pairs"))
    m = share_of(F.col("sx") + F.col("more_x"))
    var = F.when(F.col("rep") < 0, share_of(F.col("sxx"))).otherwise(m) - m * m
    per = t.select("rep", F.when(var > 1e-15, (share_of(F.col("sxy") + F.col("more_xy")) - m * m) / var).alias("correlation"))
    own = per.agg(F.max(F.when(F.col("rep") < 0, F.col("correlation"))).alias("observed"))
    j = per.where("rep >= 0").crossJoin(F.broadcast(own))  # one row
    return j.agg(F.max("observed").alias("observed"), F.count(F.lit(1)).alias("n_permutations"), ((F.count_if(F.col("correlation") >= F.col("observed") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def _permuted_sums(rows: DataFrame, reps: int, seed: str, low: int, high: int) -> DataFrame:
    """Sums of the groups per replicate, a row whose hash has first 32 bits under low counting as one, and the rows from low to under high with their group's size and ones.

    rows: _group, _prefix, _y; a group's rows follow each other in one partition.
    Replicate -1 has the sums of the labels themselves. A null group is no group.
    """
    schema = T.StructType([T.StructField("rep", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("grouped", "pairs", "sx", "sxx", "sxy", "below", "_n", "_s")), T.StructField("_prefix", T.StringType()), T.StructField("_group", rows.schema["_group"].dataType)])
    suffixes = [f"{r}|{seed}".encode() for r in range(reps)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last group of a batch stays open: its size, sums of labels, ones per replicate, and rows within the margin
        kind, at = pa.null(), None
        size, own, drawn, waiting = 0.0, np.zeros(2), np.zeros(reps), (np.zeros(0, np.int32), [])
        sx, sxy, below, mine = np.zeros(reps), np.zeros(reps), np.zeros(reps), np.zeros(5)
        any_row = False

        def close(n: np.ndarray, y: np.ndarray, s: np.ndarray) -> None:
            nonlocal sx, sxy, mine
            sx += s @ (n - 1)
            sxy += (s * s - s).sum(axis=1)
            mine += [0, (n * (n - 1)).sum(), ((n - 1) * y[0]).sum(), ((n - 1) * y[1]).sum(), (y[0] * y[0] - y[1]).sum()]

        def within(rep: np.ndarray, n: np.ndarray, s: np.ndarray, prefix: pa.Array, key: pa.Array) -> pa.RecordBatch:
            none = pa.nulls(len(rep), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(rep, pa.int32()), *[none] * 6, pa.array(n, pa.float64()), pa.array(s, pa.float64()), prefix.cast(pa.string()), key], [f.name for f in schema])

        def waited() -> pa.RecordBatch:
            rep, prefixes = waiting
            return within(rep, np.full(len(rep), size), drawn[rep], pa.array(prefixes, pa.string()), pa.array([at] * len(rep), kind))

        for b in _gathered(batches):
            any_row = True
            g, prefix, y, n = b.column("_group"), b.column("_prefix"), b.column("_y").to_numpy(zero_copy_only=False), b.num_rows
            kind = g.type
            new = np.ones(n, bool)
            new[1:] = pc.fill_null(pc.not_equal(g.slice(1), g.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            segment = np.cumsum(new) - 1
            sizes, ys, ones = np.diff([*starts, n]).astype(float), np.add.reduceat([y, y * y], starts, axis=1), np.zeros((reps, len(starts)))
            under, margin = np.zeros((reps, n), np.uint8), []
            for block in digests.blocks(prefix):
                for r, suffix in enumerate(suffixes):
                    h = block.heads(suffix)
                    under[r, block.rows] = h < low
                    m = block.rows[np.flatnonzero((h >= low) & (h < high))]
                    margin.append((np.full(len(m), r, np.int32), m))
            for r in range(reps):
                ones[r] = np.add.reduceat(under[r], starts, dtype=np.int64)
                below[r] += ones[r].sum()
            rep, row = (np.concatenate(x) for x in zip(*margin))
            first = g[0].as_py()
            if at is not None and first == at:
                sizes[0] += size
                ys[:, 0] += own
                ones[:, 0] += drawn
            else:
                if len(waiting[0]):
                    yield waited()
                close(np.array([size]), own[:, None], drawn[:, None])
                waiting = (np.zeros(0, np.int32), [])
            mine[0] += n - g.null_count
            last = len(starts) - 1
            size, own, drawn, at = sizes[-1], ys[:, -1].copy(), ones[:, -1].copy(), g[n - 1].as_py()
            if last:  # the open group of before is closed here
                if len(waiting[0]):
                    held_rep, held_prefixes = waiting
                    yield within(held_rep, np.full(len(held_rep), sizes[0]), ones[held_rep, 0], pa.array(held_prefixes, pa.string()), pa.array([first] * len(held_rep), kind))
                waiting = (np.zeros(0, np.int32), [])
                close(sizes[:-1], ys[:, :-1], ones[:, :-1])
            shut = segment[row] < last
            yield within(rep[shut], sizes[segment[row[shut]]], ones[rep[shut], segment[row[shut]]], prefix.take(pa.array(row[shut])), g.take(pa.array(row[shut])))
            waiting = (np.concatenate([waiting[0], rep[~shut]]), [*waiting[1], *prefix.take(pa.array(row[~shut])).to_pylist()])
        if any_row:
            if len(waiting[0]):
                yield waited()
            close(np.array([size]), own[:, None], drawn[:, None])
            grouped, pairs = np.full(reps + 1, mine[0]), np.full(reps + 1, mine[1])
            columns = [np.arange(-1, reps), grouped, pairs, np.r_[mine[2], sx], np.r_[mine[3], np.zeros(reps)], np.r_[mine[4], sxy], np.r_[0, below]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.float64()) for c in columns[1:]), *[pa.nulls(reps + 1, pa.float64())] * 2, pa.nulls(reps + 1, pa.string()), pa.nulls(reps + 1, kind)], [f.name for f in schema])

    return rows.mapInArrow(part, schema)
