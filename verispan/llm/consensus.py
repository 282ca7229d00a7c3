"""Consensus labels by message passing between items and annotators.

Labels form a bipartite graph, one edge per (item, annotator). Each class c is
held against the rest. Two messages run along each edge and class:

* item to annotator: the belief that the item is of class c and not of the
  rest, from all *other* labels of the item;
* annotator to item: the weight of the annotator's vote v for class c against
  the rest, ln(P(v | c) / sum over the rest of P(v | r) times the share of r in
  the rest as the item's other labels have it). The rates come from all the
  annotator's *other* labels, each counted by its item's belief, with a prior.
  The vote is kept as given, so an annotator who mixes two classes up still
  tells something.

Summed over an item's labels these weights are the log-odds of c against the
rest. Rounds go on until no rate of any annotator moves.

An annotator's rates are k x k sums. Items with the same votes and witness have
the same beliefs, so a round runs over the distinct vote patterns, with counts;
what crosses the cluster in a round is a row of sums per annotator and task.
The annotators' sums are shipped to the tasks behind a check of their number;
more annotators are joined instead (``_by_join``), with the same result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.session import cut

#: Prior of an annotator's rates, in labels: right against wrong.
PRIOR_RIGHT, PRIOR_WRONG = 2.0, 1.0
#: Annotators up to which their sums are shipped to the tasks (k * k numbers each); more are joined.
MOST_SHIPPED = 20_000


def latest_labels(rows: DataFrame, item: Column, annotator: Column, label: Column, time: Column) -> DataFrame:
    """One row per (item, annotator): the latest non-null label; ties in time go to the first label by name."""
    d = rows.select(item.alias("item"), annotator.alias("annotator"), label.alias("label"), time.alias("_t")).where("item is not null and annotator is not null and label is not null")
    newest = F.struct(F.col("_t"), F.translate("label", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"))
    return d.groupBy("item", "annotator").agg(F.max_by("label", newest).alias("label"))


def _prior(k: int) -> np.ndarray:
    """prior[c, v]: labels v on items of class c that every annotator starts with."""
    p = np.full((k, k), PRIOR_WRONG / max(1, k - 1))
    np.fill_diagonal(p, PRIOR_RIGHT)
    return p


def _softmax(x: np.ndarray) -> np.ndarray:
    y = np.exp(x - x.max(axis=1, keepdims=True))
    return y / y.sum(axis=1, keepdims=True)


def beliefs(start: np.ndarray, a: np.ndarray, v: np.ndarray, seen: np.ndarray, k: int, rate: float, sums: np.ndarray | None, share: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Beliefs per edge (its own label left out) and per item.

    Edges a, v of item i lie at start[i]..start[i + 1]. sums[a, c, v] are the
    annotators' expected labels, share the classes' expected items; without them
    an edge starts from the other labels of its item. The own edge is taken out
    of its annotator's sums with the very belief it has, which is settled here.
    """
    n, item = len(seen), np.repeat(np.arange(len(seen)), np.diff(start))
    base = np.zeros((n, k))
    w = np.flatnonzero(seen >= 0)
    base[w] = math.log((1 - rate) / max(1, k - 1))
    base[w, seen[w]] = math.log(rate)
    votes = np.zeros((n, k))
    np.add.at(votes, (item, v), 1.0)
    others = votes[item] + 1.0
    others[np.arange(len(item)), v] -= 1.0
    b = _softmax(np.log(others) + base[item])
    if sums is None or not len(item):
        return b, _softmax(np.log(votes + 1.0) + base)
    prior = _prior(k)
    base = base + np.log((share + 1.0) / (share.sum() + k))
    given, all_of = sums[a, :, v], sums.sum(axis=2)[a]
    for _ in range(200):
        weight = np.log((np.maximum(given - b, 0) + prior[:, v].T) / (np.maximum(all_of - b, 0) + prior.sum(axis=1)))
        full = base + np.add.reduceat(weight, start[:-1], axis=0)
        new = _softmax(full[item] - weight)
        moved = np.abs(new - b).max()
        b = new
        if moved < 1e-8:
            break
    return b, _softmax(full)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, annotators and votes of a column of codes annotator * 256 + vote."""
    off = column.offsets.to_numpy().astype(np.int64)
    codes = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    return off - off[0], codes >> 8, codes & 255


def _sum_batches(batches: Iterator[pa.RecordBatch], k: int, rate: float, state) -> Iterator[pa.RecordBatch]:
    """A task's sums per annotator, and the classes' expected items in the row of annotator -1."""
    tot: np.ndarray | None = None
    names = ["a", "n", "agree", *(f"s{i}" for i in range(k * k))]
    share = np.zeros(k)
    for batch in batches:
        if not batch.num_rows:
            continue
        start, a, v = _flat(batch.column(0))
        seen, count = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
        b, full = beliefs(start, a, v, seen, k, rate, *state)
        each = np.repeat(count, np.diff(start))
        best = np.repeat(full.argmax(axis=1), np.diff(start))
        m = int(a.max()) + 1
        if tot is None or len(tot) < m:
            grown = np.zeros((m, 2 + k * k))
            if tot is not None:
                grown[: len(tot)] = tot
            tot = grown
        tot[:, 0] += np.bincount(a, each, len(tot))
        tot[:, 1] += np.bincount(a, each * (best == v), len(tot))
        for c in range(k):
            tot[:, 2 : 2 + k * k] += np.bincount(a * (k * k) + c * k + v, each * b[:, c], len(tot) * k * k).reshape(len(tot), k * k)
        share += (full * count[:, None]).sum(axis=0)
    if tot is not None:
        some = np.flatnonzero(tot[:, 0] > 0)
        own = np.zeros(2 + k * k)
        own[2 : 2 + k] = share
        rows = np.vstack([tot[some], own])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1], pa.int32()), *(pa.array(c) for c in rows.T)], names=names)


def _mix(xs: list[np.ndarray], gs: list[np.ndarray]) -> np.ndarray:
    """Anderson's next point from the last points and what a round made of them."""
    if len(xs) < 2:
        return gs[-1]
    r = [g - x for x, g in zip(xs, gs)]
    dr = np.stack([b - a for a, b in zip(r, r[1:])], axis=1)
    dg = np.stack([b - a for a, b in zip(gs, gs[1:])], axis=1)
    gamma = np.linalg.lstsq(dr, r[-1], rcond=1e-8)[0]
    return np.maximum(gs[-1] - dg @ gamma, 0.0)


def consensus_messages(labels: DataFrame, classes: Sequence[str], witness: DataFrame | None = None, witness_rate: float = 0.95, max_rounds: int = 500, tolerance: float = 1e-5,
                       most_shipped: int = MOST_SHIPPED) -> tuple[DataFrame, DataFrame, int]:
    """Message passing to convergence over (item, annotator, label) rows, one per item and annotator.

    witness (item, status): one decision per item that counts as a vote whose
    rate is fixed at witness_rate instead of being estimated; unknown items and
    statuses are ignored. Returns (items, annotators, rounds):

    items: item, n_labels, agreement (share of the labels that name the
    consensus class), majority_share, consensus, confidence (its belief).
    annotators: annotator, n_labels, reliability (expected share of right
    labels, smoothed), agreement_rate (share equal to the consensus).

    Rounds end when no rate of an annotator and no class share moves by more than
    tolerance; an error tells where max_rounds do not suffice. Labels outside the
    classes and null ones are dropped, repeated rows count once, of two witnesses
    of an item the first class counts. No labels: both results are empty.
    """
    k = len(classes)
    if not 0 < k < 256:
        raise ValueError("between 1 and 255 classes are needed")
    number = lambda c: F.element_at(F.create_map(*[x for i, n in enumerate(classes) for x in (F.lit(n), F.lit(i))]), F.col(c))
    e = labels.select("item", "annotator", number("label").alias("vote")).where("item is not null and annotator is not null and vote is not null")
    e = cut(e)
    names = sorted(r.annotator for r in e.select("annotator").distinct().limit(most_shipped + 1).collect())
    seen = None if witness is None else witness.select("item", number("status").alias("vote")).where("item is not null and vote is not null")
    if len(names) > most_shipped:
        return _by_join(e, seen, classes, witness_rate, max_rounds, tolerance)
    spark = e.sparkSession
    at = spark.createDataFrame([(a, i) for i, a in enumerate(names)], "annotator string, _a int")
    # one grouping by item: an item has at most as many labels as there are annotators, whose number is checked above
    tagged = e.join(F.broadcast(at), "annotator").select("item", (F.col("_a") * 256 + F.col("vote")).alias("code"), F.lit(None).cast("int").alias("seen"))
    if seen is not None:
        tagged = tagged.unionByName(seen.select("item", F.lit(None).cast("int").alias("code"), F.col("vote").alias("seen")))
    packed = tagged.groupBy("item").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.coalesce(F.min("seen"), F.lit(-1)).alias("seen")).where("size(codes) > 0")
    packed = cut(packed)
    patterns = cut(packed.groupBy("codes", "seen").agg(F.count(F.lit(1)).alias("n")))
    m, kk = len(names), k * k
    schema = "a int, n double, agree double, " + ", ".join(f"s{i} double" for i in range(kk))

    def one(state) -> tuple[np.ndarray, np.ndarray]:
        """What a round makes of the state: (sums of the annotators and classes, labels and agreeing labels per annotator)."""
        shipped = spark.sparkContext.broadcast(state)
        rows = patterns.mapInArrow(lambda it: _sum_batches(it, k, witness_rate, shipped.value), schema)
        got = rows.groupBy("a").agg(*(F.sum(c).alias(c) for c in rows.columns[1:])).collect()  # a row per annotator
        x, told = np.zeros(m * kk + k), np.zeros((m, 2))
        for r in got:
            if r.a < 0:
                x[m * kk :] = r[3 : 3 + k]
            else:
                x[r.a * kk : (r.a + 1) * kk], told[r.a] = r[3:], r[1:3]
        shipped.unpersist()
        return x, told

    unpack = lambda x: (x[: m * kk].reshape(m, k, k), x[m * kk :])

    def rates(x: np.ndarray) -> np.ndarray:
        s, share = unpack(x)
        p = s + _prior(k)
        return np.r_[(p / p.sum(axis=2, keepdims=True)).ravel(), (share + 1) / (share.sum() + k)]

    x, told = one((None, None))
    rounds, xs, gs, last = 0, [], [], math.inf
    while m:
        rounds += 1
        g, told = one(unpack(x))
        moved = float(np.abs(rates(g) - rates(x)).max())
        if moved <= tolerance:
            x = g
            break
        if rounds >= max_rounds:
            raise RuntimeError(f"the rates have not settled after {max_rounds} rounds: one still moved by {moved:.2g}")
        if moved > 2 * last:  # the mix led astray: begin it anew from a plain round
            xs, gs = [], []
        last = moved
        xs, gs = [*xs[-5:], x], [*gs[-5:], g]
        x = _mix(xs, gs)
    final = spark.sparkContext.broadcast(unpack(x) if m else (None, None))
    fields = [("item", dict(packed.dtypes)["item"], None), ("n_labels", "long", pa.int64()), ("agreement", "double", pa.float64()), ("majority_share", "double", pa.float64()), ("consensus", "string", pa.string()), ("confidence", "double", pa.float64())]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            start, a, v = _flat(batch.column(1))
            _, full = beliefs(start, a, v, batch.column(2).to_numpy(zero_copy_only=False), k, witness_rate, *final.value)
            best, n = full.argmax(axis=1), np.diff(start)
            votes = np.zeros((len(n), k))
            np.add.at(votes, (np.repeat(np.arange(len(n)), n), v), 1)
            out = [batch.column(0), pa.array(n), pa.array(votes[np.arange(len(n)), best] / n), pa.array(votes.max(axis=1) / n), pa.array([classes[c] for c in best], pa.string()), pa.array(full.max(axis=1))]
            yield pa.RecordBatch.from_arrays(out, names=[f[0] for f in fields])

    items = packed.select("item", "codes", "seen").mapInArrow(judge, ", ".join(f"{n} {t}" for n, t, _ in fields))
    s = unpack(x)[0]
    right = s[:, np.arange(k), np.arange(k)].sum(axis=1) if m else np.zeros(0)
    rows = [(a, int(t[0]), float((r + PRIOR_RIGHT) / (t[0] + PRIOR_RIGHT + PRIOR_WRONG)), float(t[1] / t[0])) for a, r, t in zip(names, right, told)]
    return items, spark.createDataFrame(rows, "annotator string, n_labels long, reliability double, agreement_rate double"), rounds


def _by_join(e: DataFrame, seen: DataFrame | None, classes: Sequence[str], rate: float, max_rounds: int, tolerance: float) -> tuple[DataFrame, DataFrame, int]:
    """The same messages for any number of annotators: the edges are joined to their annotator's and item's sums, both combined on the map side first."""
    k = len(classes)
    prior, e = _prior(k), e.distinct()
    counts = e.groupBy("item").agg(F.count(F.lit(1)).alias("n"), *(F.sum((F.col("vote") == c).cast("long")).alias(f"n{c}") for c in range(k)))
    counts = counts.join(seen.groupBy("item").agg(F.min("vote").alias("seen")), "item", "left") if seen is not None else counts.withColumn("seen", F.lit(None).cast("int"))
    strong, weak = math.log(rate), math.log((1 - rate) / max(1, k - 1))
    base = [F.when(F.col("seen") == c, strong).when(F.col("seen").isNotNull(), weak).otherwise(0.0) for c in range(k)]
    counts = cut(counts.select("*", *(x.alias(f"base{c}") for c, x in enumerate(base))))
    cols = [f"b{c}" for c in range(k)]

    def normal(d: DataFrame, x: list[Column], keep: list[str]) -> DataFrame:
        """Columns b0.. of shares from logarithms."""
        d = d.select(*keep, *(c.alias(f"_x{i}") for i, c in enumerate(x)))
        top = F.greatest(*(F.col(f"_x{i}") for i in range(k))) if k > 1 else F.col("_x0")
        total = sum((F.exp(F.col(f"_x{i}") - top) for i in range(k)), F.lit(0.0))
        return d.select(*keep, *((F.exp(F.col(f"_x{i}") - top) / total).alias(f"b{i}") for i in range(k)))

    other = [F.log(F.col(f"n{c}") - (F.col("vote") == c).cast("long") + 1.0) + F.col(f"base{c}") for c in range(k)]
    state = cut(normal(e.join(counts, "item"), other, ["item", "annotator", "vote"]))
    shares = normal(counts, [F.log(F.col(f"n{c}") + 1.0) + F.col(f"base{c}") for c in range(k)], ["item"]).agg(*(F.sum(c) for c in cols)).first()
    rounds = 0
    while True:
        rounds += 1
        total = sum(x or 0.0 for x in shares) + k
        bias = [math.log(((x or 0.0) + 1.0) / total) for x in shares]
        given = state.groupBy("annotator").agg(*(F.sum(F.when(F.col("vote") == v, F.col(f"b{c}")).otherwise(0.0)).alias(f"s{c}_{v}") for c in range(k) for v in range(k)))
        w = []
        for c in range(k):
            out = F.lit(None).cast("double")
            everything = F.greatest(sum((F.col(f"s{c}_{v}") for v in range(k)), F.lit(0.0)) - F.col(f"b{c}"), F.lit(0.0)) + float(prior[c].sum())
            for v in range(k):
                out = F.when(F.col("vote") == v, F.log((F.greatest(F.col(f"s{c}_{v}") - F.col(f"b{c}"), F.lit(0.0)) + float(prior[c, v])) / everything)).otherwise(out)
            w.append(out.alias(f"w{c}"))
        edges = state.join(given, "annotator").select("item", "annotator", "vote", *(F.col(c).alias(f"old_{c}") for c in cols), *w)
        sums = edges.groupBy("item").agg(*(F.sum(f"w{c}").alias(f"f{c}") for c in range(k))).join(counts, "item").select("item", *((F.col(f"f{c}") + F.col(f"base{c}") + bias[c]).alias(f"f{c}") for c in range(k)))
        new = cut(normal(edges.join(sums, "item"), [F.col(f"f{c}") - F.col(f"w{c}") for c in range(k)], ["item", "annotator", "vote", *(f"old_{c}" for c in cols)]))
        moved = new.agg(F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"old_{c}")) for c in cols), F.lit(0.0)))).first()[0]
        items = cut(normal(sums, [F.col(f"f{c}") for c in range(k)], ["item"]))
        now = items.agg(*(F.sum(c) for c in cols)).first()
        still = max((abs((x or 0.0) - (y or 0.0)) for x, y in zip(now, shares)), default=0.0) / total
        state, shares = new.select("item", "annotator", "vote", *cols), now
        if moved is None or max(moved, still) <= tolerance:
            break
        if rounds >= max_rounds:
            raise RuntimeError(f"the beliefs have not settled after {max_rounds} rounds: one still moved by {moved:.2g}")
    best = F.array_max(F.array(*(F.struct(F.col(f"b{c}").alias("score"), F.lit(-c).alias("order")) for c in range(k))))
    d = items.join(counts, "item").withColumn("_best", best).withColumn("_class", -F.col("_best.order"))
    votes = F.array(*(F.col(f"n{c}") for c in range(k)))
    result = d.select("item", F.col("n").alias("n_labels"), (F.element_at(votes, F.col("_class") + 1) / F.col("n")).alias("agreement"), (F.array_max(votes) / F.col("n")).alias("majority_share"),
                      F.element_at(F.array(*map(F.lit, classes)), F.col("_class") + 1).alias("consensus"), F.col("_best.score").alias("confidence"), "_class")
    believed = F.element_at(F.array(*(F.col(c) for c in cols)), F.col("vote") + 1)
    annotators = state.withColumn("_right", believed).join(result.select("item", "_class"), "item").groupBy("annotator").agg(
        F.count(F.lit(1)).alias("n_labels"), ((F.sum("_right") + PRIOR_RIGHT) / (F.count(F.lit(1)) + PRIOR_RIGHT + PRIOR_WRONG)).alias("reliability"), F.avg((F.col("vote") == F.col("_class")).cast("double")).alias("agreement_rate"),
    )
    return result.drop("_class"), annotators, rounds
