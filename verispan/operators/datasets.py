"""Joins and checks that build one claim table from evidence, manifest, labels and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.operators.ordered import join_keys


def with_parent_split(claims: DataFrame, key: str, own: str, parents: DataFrame, parent_key: str, parent_split: str, strict: bool = False) -> DataFrame:
    """claims with ``split_final``: the parent's split where it has one, else the own. strict makes a claim without parent an error.

    A parent with several splits counts with the first by name.
    """
    p = parents.select(F.col(parent_key).alias("_k"), F.col(parent_split).alias("_s")).where("_k is not null").groupBy("_k").agg(F.min("_s").alias("_s"), F.lit(True).alias("_known"))
    j = claims.join(p, F.col(key) == F.col("_k"), "left")
    final = F.coalesce("_s", F.col(own))
    if strict:
        final = F.when(F.col("_known"), final).otherwise(F.raise_error(F.concat(F.lit("no parent for "), F.coalesce(F.col(key), F.lit("null")))).cast("string"))
    return j.withColumn("split_final", final).drop("_k", "_s", "_known")


def with_fallback(rows: DataFrame, exact: Sequence[str], loose: Sequence[str], table: DataFrame, value: str, strict: bool = False) -> DataFrame:
    """rows with ``value`` and ``found_by`` (exact, loose or none): first by all exact keys, then by the loose ones. Nothing is made up.

    Of several rows of one key the least value counts; rows without value count as absent.
    """
    t = table.where(F.col(value).isNotNull())

    def first(keys: Sequence[str], name: str) -> DataFrame:
        return t.groupBy(*(F.col(k).alias(f"_{name}_{k}") for k in keys)).agg(F.min(value).alias(f"_{name}"))

    def on(keys: Sequence[str], name: str) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & (F.col(k) == F.col(f"_{name}_{k}"))
        return out

    j = rows.join(first(exact, "exact"), on(exact, "exact"), "left").join(first(loose, "loose"), on(loose, "loose"), "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "loose").otherwise("none")
    if strict:
        how = F.when(F.coalesce("_exact", "_loose").isNull(), F.raise_error(F.lit("no row for a key")).cast("string")).otherwise(how)
    return j.select(*rows.columns, F.coalesce("_exact", "_loose").alias(value), how.alias("found_by"))


def with_conditions(claims: DataFrame, keys: Sequence[str], scores: DataFrame, condition: str, score: str, need: str | None = "clean") -> DataFrame:
    """claims with ``scores``, a map from condition to score by the keys; with ``need``, only claims that have that condition.

    Null and NaN scores count as absent; of several the least counts. Conditions are few, so the map is small.
    """
    s = scores.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(condition).isNotNull()).groupBy(*keys, condition).agg(F.min(score).alias("_v"))
    m = s.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(condition, "_v")))).alias("scores"))
    j = claims.join(m, list(keys), "left")
    return j.where(F.element_at("scores", need).isNotNull()) if need else j


def label_by_sets(node: Column, truth: Column, wrong: Column) -> Column:
    """0 where the node is true of the image, 1 where it is a hallucination, null where neither says; truth wins."""
    return F.when(F.array_contains(truth, node), 0).when(F.array_contains(wrong, node), 1)


def only_wrong(truth: Column, wrong: Column) -> Column:
    """The wrong nodes that are not true as well."""
    return F.array_except(wrong, truth)


def choose_rows(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """Union in which, per key, the first source of the list that has the key counts; all its rows are kept. Adds ``source_name``."""
    out = None
    for i, (name, d) in enumerate(sources):
        x = d.withColumn("source_name", F.lit(name)).withColumn("_order", F.lit(i))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    best = out.groupBy(*keys).agg(F.min("_order").alias("_best"))
    return out.join(best, list(keys)).where("_order = _best").drop("_order", "_best")


def final_labels(claims: DataFrame, keys: Sequence[str], a: DataFrame, b: DataFrame, decision: DataFrame) -> DataFrame:
    """claims with label_a, label_b, decision, disagree and final: equal labels stand, else the decision, else null. Labels are one row per key, columns keys and ``label``."""
    j = claims
    for name, d in (("label_a", a), ("label_b", b), ("decision", decision)):
        j = j.join(d.select(*keys, F.col("label").alias(name)), list(keys), "left")
    both = F.col("label_a").isNotNull() & F.col("label_b").isNotNull()
    return j.withColumn("disagree", both & (F.col("label_a") != F.col("label_b"))).withColumn("final", F.when(both & (F.col("label_a") == F.col("label_b")), F.col("label_a")).when(both, F.col("decision")))


def unique_or_fail(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, with an error where a key occurs twice; null counts as a value."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    told = F.raise_error(F.concat(F.lit("repeated key "), F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys)))).cast("boolean")
    return join_keys(df, n, keys).where(F.when(F.col("_n") == 1, True).otherwise(told)).select(*df.columns)


def last_wins(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The last row per key, by the order; ties go to the greatest row."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, F.struct(*rest))).alias("_r")).select(*keys, "_r.*")


def manifest_errors(images: DataFrame, claims: DataFrame, labels: DataFrame) -> DataFrame:
    """(error, key, n): missing and repeated ids, claims of unknown images, labels of unknown claims. images (image_id), claims (claim_id, image_id), labels (claim_id)."""
    row = lambda d, e, k: d.groupBy(F.col(k).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(e).alias("error"), "key", "n")
    parts = []
    for d, k, name in ((images, "image_id", "image"), (claims, "claim_id", "claim")):
        g = row(d, f"repeated_{name}", k)
        parts += [g.where("key is not null and n > 1"), row(d.where(F.col(k).isNull()), f"{name}_without_id", k)]
    parts.append(row(claims.where("image_id is not null").join(images.select("image_id"), "image_id", "left_anti"), "unknown_image", "image_id"))
    parts.append(row(labels.where("claim_id is not null").join(claims.select("claim_id"), "claim_id", "left_anti"), "unknown_claim", "claim_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def identity_groups(rows: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """(id, group): the least id among those that share a content hash directly; ids without a hash stand alone. For relations that go on see the component operators."""
    d = rows.select(F.col(id_col).alias("id"), F.col(hash_col).alias("_h")).where("id is not null").distinct()
    h = d.where("_h is not null").groupBy("_h").agg(F.min("id").alias("_g"))
    return d.join(h, "_h", "left").groupBy("id").agg(F.coalesce(F.min("_g"), F.first("id")).alias("group")).select("id", F.least("id", "group").alias("group"))


def readiness(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """(check, n_rows, n_failed, passed): each check holds of every row; a null result fails."""
    g = df.agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(f"_f{i}") for i, (_, c) in enumerate(checks)))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col("_n").alias("n_rows"), F.col(f"_f{i}").alias("n_failed"), ((F.col(f"_f{i}") == 0) & (F.col("_n") > 0)).alias("passed")) for i, (n, _) in enumerate(checks))))
    return g.select(rows.alias("r")).select("r.*")


def bad_transitions(log: DataFrame, key: str, state: str, time: str, allowed: dict[str, Sequence[str]], start: str) -> DataFrame:
    """Rows of a log of states whose step from the state before is not allowed: key, from_state, to_state, at."""
    from pyspark.sql import Window

    before = F.lag(state).over(Window.partitionBy(key).orderBy(time, state))  # the log of one artifact
    d = log.select(F.col(key).alias("key"), F.coalesce(before, F.lit(start)).alias("from_state"), F.col(state).alias("to_state"), F.col(time).alias("at"))
    good = F.lit(False)
    for a, to in allowed.items():
        good = good | ((F.col("from_state") == a) & F.col("to_state").isin(*to)) if to else good
    return d.where(~F.coalesce(good, F.lit(False)))


def evaluable(n_images: Column, n_claims: Column, least_images: int = 100, least_claims: int = 300) -> Column:
    """Whether enough is labelled to evaluate: evaluable, else what lacks."""
    return F.when((n_images >= least_images) & (n_claims >= least_claims), "evaluable").when(n_images < least_images, "too_few_images").otherwise("too_few_claims")
