"""Splits that keep related records together.

Links come from shared keys in long form. Per key a two-level star is built:
every record is linked to the least record of its (key, salt), and those least
ones to the least of the key, so a key that a third of all rows share is spread
over ``salts`` groups and never paired out. Components are found by
hash-to-min: a node sends its cluster to the cluster's least node and that least
node to the cluster's members, until nothing changes; clusters are kept as
(node, member) rows, not as arrays. Components get their split by weighted
rendezvous hashing, which needs no counting and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.session import cut

#: Nodes without an id sort after all ids, so they never name a component that has one.
NO_ID = "\U0010ffff"


def star_links(keyed: DataFrame, salts: int = 64) -> DataFrame:
    """(node, key) rows to links (a, b) with b the lesser node; links of a node to itself are left out."""
    d = cut(keyed.where("node is not null and key is not null").distinct())  # used three times below
    d = d.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(salts)))
    part = d.groupBy("key", "_salt").agg(F.min("node").alias("_least"))
    low = d.join(part, ["key", "_salt"]).select(F.col("node").alias("a"), F.col("_least").alias("b"))
    top = part.groupBy("key").agg(F.min("_least").alias("_top"))
    high = part.join(top, "key").select(F.col("_least").alias("a"), F.col("_top").alias("b"))  # at most `salts` rows a key
    return low.unionByName(high).where("a != b").distinct()


def hash_to_min(links: DataFrame, max_rounds: int = 60, hot: int = 1_000_000, most_hot: int = 100_000) -> tuple[DataFrame, int]:
    """Connected components of the links: (node, component), component being the least node, itself included.

    Every round is written to the shared checkpoint folder. Rounds grow with the
    logarithm of the longest path. Nodes without links are not in the result.
    The rows of a node with more than ``hot`` of them stay where they are and get
    its least node by broadcast; there are at most rows / hot such nodes, and more
    than ``most_hot`` of them are an error, not a larger broadcast.
    """
    a, b, links = F.col("a"), F.col("b"), cut(links)
    both = links.select(a.alias("v"), b.alias("u")).unionByName(links.select(b.alias("v"), a.alias("u")))
    own = both.select("v", F.col("v").alias("u"))
    state = cut(both.unionByName(own).distinct())
    seal, rows = None, state.count()
    for rounds in range(1, max_rounds + 1):
        least = state.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
        # a node with very many rows (the least one of a giant component) is not joined by its key: its least node is shipped instead
        big = least.where(F.col("n") > hot).select("v", "m").limit(most_hot + 1).collect() if rows > hot else []
        if len(big) > most_hot:
            raise RuntimeError(f"more than {most_hot} nodes have over {hot} rows: raise hot")
        if big:
            shipped = F.broadcast(links.sparkSession.createDataFrame([(r.v, r.m) for r in big], "v string, m string"))
            sent = state.join(least.where(F.col("n") <= hot).select("v", "m"), "v").unionByName(state.join(shipped, "v"))
        else:
            sent = state.join(least.select("v", "m"), "v")
        to_least = sent.select(F.col("m").alias("v"), "u")
        to_members = sent.select(F.col("u").alias("v"), F.col("m").alias("u"))
        new = cut(to_least.unionByName(to_members).distinct())
        # the same rows twice running: nothing is sent that is not known
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        state, rows = new, now[0]
        if now == seal:
            return state.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node"), rounds
        seal = now
    raise RuntimeError(f"the components have not settled after {max_rounds} rounds")


def record_keys(rows: DataFrame, id_col: Column, keys: Sequence[tuple[str, Column]]) -> DataFrame:
    """Long form (node, key) of the normalized keys; a row without id becomes a node of its first key."""
    tagged = [F.when(c.isNotNull(), F.concat(F.lit(n + ":"), c.cast("string"))) for n, c in keys]
    d = rows.select(F.coalesce(id_col, F.concat(F.lit(NO_ID), F.coalesce(*tagged))).alias("node"), F.array_compact(F.array(*tagged)).alias("_keys"))
    return d.where("node is not null").select("node", F.explode("_keys").alias("key"))


def related_groups(rows: DataFrame, id_col: Column, keys: Sequence[tuple[str, Column]], salts: int = 64) -> DataFrame:
    """(node, component) of every record that is related to another one by a shared key.

    id_col and the keys are normalized expressions that are null where they stand
    for nothing; null keys relate nothing. Rows with neither id nor key are left
    out. Repeated rows count once. No rows, no keys: an empty result.
    """
    return hash_to_min(star_links(record_keys(rows, id_col, keys), salts))[0]


def rendezvous(component: Column, shares: Sequence[tuple[str, float]], seed: str = "split-1") -> Column:
    """The split of a component: the largest of -share / ln(u), u a uniform hash of (component, split).

    Over many components each split gets its share; when a share changes, only
    components moving to or from that split move. Splits without a positive share get none.
    """
    best = []
    for name, share in shares:
        if share is None or not share > 0:
            continue
        u = (F.shiftrightunsigned(F.xxhash64(component, F.lit(name), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        best.append(F.struct((F.lit(-float(share)) / F.log(u)).alias("score"), F.lit(name).alias("name")))
    if not best:
        raise ValueError("no split has a positive share")
    return F.array_max(F.array(*best))["name"]


def assign_splits(rows: DataFrame, id_col: Column, keys: Sequence[tuple[str, Column]], shares: Sequence[tuple[str, float]], seed: str = "split-1", salts: int = 64) -> DataFrame:
    """One row per distinct record id: record_id, component, split. A record related to none is its own component."""
    groups = related_groups(rows, id_col, keys, salts).where(~F.col("node").startswith(NO_ID))
    ids = rows.select(id_col.alias("record_id")).where("record_id is not null").distinct()
    d = ids.join(groups.withColumnRenamed("node", "record_id"), "record_id", "left").withColumn("component", F.coalesce("component", "record_id"))
    return d.withColumn("split", rendezvous(F.col("component"), shares, seed)).select("record_id", "component", "split")


def split_shares(targets: DataFrame, most: int = 1000) -> list[tuple[str, float]]:
    """The targets as a list; the table is refused where it has more than ``most`` rows."""
    rows = targets.select("split_name", F.col("target_share").cast("double").alias("s")).where("split_name is not null").groupBy("split_name").agg(F.max("s").alias("s")).orderBy("split_name").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} splits")
    return [(r.split_name, r.s) for r in rows]


def split_report(assigned: DataFrame, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """Per split: records, components, share reached and target share; splits that got none are listed."""
    spark = assigned.sparkSession
    t = spark.createDataFrame(list(shares), "split string, target_share double")
    g = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("component").alias("n_components"))
    total = g.agg(F.sum("n_records").alias("_all"))
    d = t.join(g, "split", "left").crossJoin(F.broadcast(total))  # one row
    return d.select("split", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_components", F.lit(0)).alias("n_components"),
                    (F.coalesce("n_records", F.lit(0)) / F.col("_all")).alias("actual_share"), "target_share")
