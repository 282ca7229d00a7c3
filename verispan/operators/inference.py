"""Belief propagation on chains inside Catalyst, and general trees through the Arrow kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.functions import scalar as S
from verispan.kernels import tree


def chain_fields(theta: Column, coupling: float | Column) -> Column:
    """Total field of every node of a chain: two passes over the array of fields, in the JVM.

    theta: array<double> in chain order. The result has the same length; an empty
    array gives an empty one, null gives null.
    """
    j = coupling if isinstance(coupling, Column) else F.lit(coupling)
    empty = F.array().cast("array<double>")

    def sweep(x: Column) -> Column:
        # each node's own field plus the message of the one before it
        return F.aggregate(x, empty, lambda acc, t: F.concat(acc, F.array(t + F.when(F.size(acc) > 0, S.edge_message(j, F.try_element_at(acc, F.lit(-1)))).otherwise(0.0))))

    # a chain is one image's claims, so the copy of the few fields before it costs little
    forward, backward = sweep(theta), F.reverse(sweep(F.reverse(theta)))
    # forward + backward holds the own field twice
    return F.zip_with(F.zip_with(forward, backward, lambda a, b: a + b), theta, lambda a, t: a - t)


def chain_bp(claims: DataFrame, coupling: float, group: str = "image_id", order: str = "ordinal", theta: str = "theta") -> DataFrame:
    """One row per claim: group, order, field and marginal P(hallucinated). A group is one small graph: its claims are gathered per group."""
    g = claims.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(theta).alias("t")))).alias("_c"))
    t = F.transform("_c", lambda x: x["t"])
    out = g.select(group, F.inline(F.arrays_zip(F.transform("_c", lambda x: x["o"]).alias("o"), chain_fields(t, coupling).alias("f"))))
    return out.select(group, F.col("o").alias(order), F.col("f").alias("field"), S.theta_to_probability(F.col("f")).alias("marginal"))


def _is_chain(edges) -> bool:
    return all(e["u"] == i and e["v"] == i + 1 for i, e in enumerate(edges))


def star_fields(theta: Column, coupling: float) -> Column:
    """Total field of every node of a star around the first one, from an array of fields; null gives null."""
    j = F.lit(coupling)
    told = F.transform(theta, lambda t, i: F.when(i == 0, 0.0).otherwise(S.edge_message(j, t)))
    centre = F.get(theta, F.lit(0)) + F.aggregate(told, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.arrays_zip(theta.alias("t"), told.alias("m")), lambda x, i: F.when(i == 0, centre).otherwise(x["t"] + S.edge_message(j, centre - x["m"])))


def star_bp(claims: DataFrame, coupling: float, group: str = "image_id", order: str = "ordinal", theta: str = "theta") -> DataFrame:
    """As chain_bp, on a star around the first claim of each group."""
    g = claims.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(theta).alias("t")))).alias("_c"))
    g = g.withColumn("_t", F.transform("_c", lambda x: x["t"]))
    out = g.select(group, F.inline(F.arrays_zip(F.transform("_c", lambda x: x["o"]).alias("o"), star_fields(F.col("_t"), coupling).alias("f"))))
    return out.select(group, F.col("o").alias(order), F.col("f").alias("field"), S.theta_to_probability(F.col("f")).alias("marginal"))


def robust_bounds(graphs: DataFrame, budget: float, steps: int = 100, targets: str = "all") -> DataFrame:
    """Worst-case posterior bounds under |d_i| <= eps_i, sum |d_i| <= budget for every node of every graph.

    graphs: image_id, theta array<double>, eps array<double>, edges
    array<struct<u int, v int, j double>> (a tree: n - 1 edges, connected, j >= 0).
    One row per (image, target): nominal, grid and certified bounds and both
    witnesses. Batches of graphs go through one Arrow kernel; a graph is never
    split, graphs are spread over the partitions. A graph that is no tree is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            size = pdf["theta"].map(len)
            chain = pdf["edges"].map(_is_chain)
            for n, some in pdf[chain].groupby(size[chain], sort=False):
                for at in range(0, len(some), 512):  # chains of one length go through numpy together
                    g = some.iloc[at : at + 512]
                    j = np.array([[e["j"] for e in x] for x in g["edges"]], float).reshape(len(g), n - 1)
                    th, ep = (np.stack([np.asarray(x, float) for x in g[c]]) for c in ("theta", "eps"))
                    if (j < 0).any() or (ep < 0).any():
                        raise ValueError("couplings and radii must not be negative")
                    b = tree.chain_bounds(th, ep, j, budget, steps)
                    some_out = pd.DataFrame({"image_id": np.repeat(g["image_id"].to_numpy(), n), "target": np.tile(np.arange(n), len(g))})
                    for c in ("nominal", "lower_grid", "upper_grid", "lower_certified", "upper_certified", "gap"):
                        some_out[c] = b[c].ravel()
                    for c in ("delta_lower", "delta_upper"):
                        some_out[c] = list(b[c].reshape(-1, n))
                    yield some_out
            for r in pdf[~chain].itertuples(index=False):
                t = tree.Tree(r.theta, [(e["u"], e["v"], e["j"]) for e in r.edges], r.eps)
                for target in range(t.n):
                    b = tree.solve(t, target, budget, steps)
                    out.append((r.image_id, target, b.nominal, b.lower_grid, b.upper_grid, b.lower_certified, b.upper_certified, b.gap, list(b.delta_lower), list(b.delta_upper)))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ROBUST.split(", ")])

    kind = dict(graphs.dtypes)["image_id"]
    return graphs.select("image_id", "theta", "eps", "edges").mapInPandas(run, ROBUST.replace("image_id string", f"image_id {kind}"))


ROBUST = "image_id string, target int, nominal double, lower_grid double, upper_grid double, lower_certified double, upper_certified double, gap double, delta_lower array<double>, delta_upper array<double>"


def critical_radii(graphs: DataFrame, tau: float = 0.5, high: float = 10.0) -> DataFrame:
    """image_id, target, radius: the smallest common radius at which the box interval of a node reaches tau; inf beyond ``high``."""
    kind = dict(graphs.dtypes)["image_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            size, chain = pdf["theta"].map(len), pdf["edges"].map(_is_chain)
            for n, g in pdf[chain].groupby(size[chain], sort=False):
                j = np.array([[e["j"] for e in x] for x in g["edges"]], float).reshape(len(g), n - 1)
                radius = tree.chain_critical_radii(np.stack([np.asarray(x, float) for x in g["theta"]]), j, tau, high)
                yield pd.DataFrame({"image_id": np.repeat(g["image_id"].to_numpy(), n), "target": np.tile(np.arange(n), len(g)), "radius": radius.ravel()})
            for r in pdf[~chain].itertuples(index=False):
                t = tree.Tree(r.theta, [(e["u"], e["v"], e["j"]) for e in r.edges])
                out += [(r.image_id, k, tree.critical_radius(t, k, tau, high)) for k in range(t.n)]
            yield pd.DataFrame(out, columns=["image_id", "target", "radius"])

    return graphs.select("image_id", "theta", "edges").mapInPandas(run, f"image_id {kind}, target int, radius double")


def chain_graphs(claims: DataFrame, coupling: float) -> DataFrame:
    """One row per image: fields and radii in ordinal order and the edges of a chain."""
    g = claims.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "theta", "eps"))).alias("_c"))
    edge = lambda i: F.struct(i.cast("int").alias("u"), (i + 1).cast("int").alias("v"), F.lit(coupling).alias("j"))
    edges = F.when(F.size("_c") > 1, F.transform(F.sequence(F.lit(0), F.size("_c") - 2), edge)).otherwise(F.array().cast("array<struct<u:int,v:int,j:double>>"))
    return g.select("image_id", F.transform("_c", lambda x: x["theta"]).alias("theta"), F.transform("_c", lambda x: x["eps"]).alias("eps"), edges.alias("edges"))


def spanning_trees(pairs: DataFrame, group: str, u: str, v: str, weight: str, mend: bool = False) -> DataFrame:
    """The maximum spanning tree (or forest) of each group's weighted edges: group, u, v, weight. Ties go to the smaller (u, v). mend joins the parts of nodes 0..max to one tree by edges (i, i + 1) of weight 0.5."""
    key = dict(pairs.dtypes)[group]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for g, e in zip(pdf["g"], pdf["e"]):
                some = [(x["u"], x["v"], x["w"]) for x in e]
                nodes = int(max(max(a, b) for a, b, _ in some)) + 1 if mend else 0
                out += [(g, *x) for x in tree.maximum_spanning_tree(some, nodes)]
            yield pd.DataFrame(out, columns=["g", "u", "v", "w"])

    d = pairs.select(F.col(group).alias("g"), F.struct(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"), F.col(weight).cast("double").alias("w")).alias("e"))
    packed = d.groupBy("g").agg(F.collect_list("e").alias("e"))  # the edges of one group, which is one small graph
    return packed.mapInPandas(run, f"g {key}, u long, v long, w double").toDF(group, u, v, weight)
