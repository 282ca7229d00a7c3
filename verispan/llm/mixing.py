"""Mixing sources to target shares of tokens.

Every source is cut into blocks by a hash of the record, one set of blocks per
repeat, so blocks are random parts of the source and no ranking of a whole
source is needed. The longest mix that honours all shares and repeat caps fixes
each source's token need; whole passes over a source and then permuted blocks
of one more pass fill it. The chosen blocks form exact quotas, which a splitting
tree of multivariate hypergeometric draws divides among the output shards: each
node draws how many blocks of each source go left, the rest goes right, seeded by
the node, so any task can repeat the draws. Ranges of permuted blocks go down the
tree to their shards (log2(shards) draws a path); a shard's blocks of a source
are one range of its permutation, disjoint from all others. Records are then
shuffled within their shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verispan.functions.keys import norm_source
from verispan.llm.words import RANKS, tokenizer
from verispan.operators.ordered import running
from verispan.session import cut

#: Blocks of one source and repeat: bounds the tables of blocks however large the source is.
MOST_BLOCKS = 1 << 20


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), tokenizer_file: str = RANKS) -> DataFrame:
    """id, the kept columns and ``tokens``: the tokens of the whole text in a public tokenizer; 0 for null and empty."""
    cols = [F.col(id_col).alias("_id"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("_text")]
    d = docs.select(*cols)
    schema = d.drop("_text").withColumn("tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(tokenizer_file)
        for b in batches:
            n = b.num_columns - 1
            counts = [len(t.encode_ordinary(x)) if x else 0 for x in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(counts, pa.int64())], names=[*b.schema.names[:n], "tokens"])

    out = d.mapInArrow(run, schema)
    return out.select(F.col("_id").alias(id_col), *(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "tokens")


def mix_targets(targets: DataFrame, most: int = 10_000) -> list[tuple[str, float, int]]:
    """(source, share, max repeats) of the positive shares, adding up to 1; refused beyond ``most`` sources."""
    t = targets.select(norm_source("source").alias("s"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("long").alias("r"))
    rows = t.where("s is not null and w > 0 and r > 0").groupBy("s").agg(F.sum("w").alias("w"), F.max("r").alias("r")).orderBy("s").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} sources")
    total = sum(x.w for x in rows)
    return [(x.s, x.w / total, int(x.r)) for x in rows]


def _left(lo: int, hi: int, q: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """The middle of a node of the splitting tree and its left part's quotas."""
    mid, total = (lo + hi) // 2, int(q.sum())
    # blocks are spread evenly: the left part takes its share of all blocks, rounded by a seeded draw
    rng = np.random.default_rng([seed, lo, hi])
    want = total * (mid - lo) / (hi - lo)
    take = int(want) + int(rng.random() < want - int(want))
    return mid, rng.multivariate_hypergeometric(q, min(take, total), method="marginals") if total else q * 0


def _walk(shard: int, shards: int, quotas: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Quota and offset of each source's blocks for one shard: the path from the root of the splitting tree to its leaf."""
    lo, hi, q, off = 0, shards, quotas.astype(np.int64), np.zeros(len(quotas), np.int64)
    while hi - lo > 1:
        mid, left = _left(lo, hi, q, seed)
        if shard < mid:
            hi, q = mid, left
        else:
            lo, off, q = mid, off + left, q - left
    return q, off


def _shards_of(source: np.ndarray, rank: np.ndarray, shards: int, quotas: np.ndarray, seed: int) -> np.ndarray:
    """The shard of each block (number of its source, rank within it): the blocks go down the splitting tree together, and only nodes that get some are drawn."""
    out = np.zeros(len(rank), np.int64)
    todo = [(0, shards, quotas.astype(np.int64), np.zeros(len(quotas), np.int64), np.arange(len(rank)))]
    while todo:
        lo, hi, q, off, rows = todo.pop()
        if not len(rows):
            continue
        if hi - lo == 1:
            out[rows] = lo
            continue
        mid, left = _left(lo, hi, q, seed)
        goes = rank[rows] < (off + left)[source[rows]]
        todo += [(lo, mid, left, off, rows[goes]), (mid, hi, q - left, off + left, rows[~goes])]
    return out


def place_blocks(chosen: DataFrame, shards: int, names: Sequence[str], quotas: Sequence[int], seed: int) -> DataFrame:
    """chosen (source, copy, block, rank from 0) with their ``shard``. Batches come in ranges of ranks, so each goes down few branches of the tree."""
    number, quotas = {n: i for i, n in enumerate(names)}, np.array(quotas, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source = np.array([number[x] for x in b.column(0).to_pylist()], np.int64)
            shard = _shards_of(source, b.column(3).to_numpy(zero_copy_only=False), shards, quotas, seed) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(shard)], names=["source", "copy", "block", "shard"])

    return chosen.select("source", "copy", "block", F.col("rank").cast("long")).mapInArrow(run, "source string, copy int, block long, shard long")


def mix(docs: DataFrame, targets: Sequence[tuple[str, float, int]], shard_tokens: int = 2_000_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", tokenizer_file: str = RANKS, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(mix, report) of the records of the target sources.

    mix: doc_id, source, copy (0 the first use), shard, position in the shard,
    tokens. report: source, target_share, reachable_share (0 without records,
    else the target over the sources that have some), actual_share, tokens_available,
    tokens_used, n_docs, n_docs_used, most_uses.

    A record is used at most max_repeats times. The mix is the longest that the
    shares allow: its length is the least of tokens * max_repeats / share over
    the sources that have tokens (the shares of the others are spread over them
    in proportion). Shares are reached up to half a block, a block holding one
    record, or 1 / most_blocks of a larger source. Null and empty texts carry
    no tokens and are not used, nor are sources without a target. Repeated rows
    of an id count once. No usable record: an empty mix and a report of zeros.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), norm_source(source_col).alias("source"))
    src = src.where("doc_id is not null and source is not null and text is not null and text != ''").where(F.col("source").isin([s for s, _, _ in targets]))
    counted = token_counts(src, "doc_id", "text", ["source"], tokenizer_file).where("tokens > 0")
    counted = cut(counted.groupBy("doc_id").agg(F.min_by("source", F.struct("source", "tokens")).alias("source"), F.min_by("tokens", F.struct("source", "tokens")).alias("tokens")))
    have = {r.source: r for r in counted.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}  # at most a row per target
    live = [(s, w, r) for s, w, r in targets if s in have]
    total = sum(w for _, w, _ in live)
    length = min((have[s].t * r * total / w for s, w, r in live), default=0.0)
    plan = [(s, w / total * length, have[s].t, min(have[s].n, most_blocks)) for s, w, _ in live]
    t = spark.createDataFrame([(s, int(need // tok) if need < tok * r else r, need, tok, n) for (s, need, tok, n), (_, _, r) in zip(plan, live)], "source string, passes long, need double, available long, n_blocks long")
    # block of a record in a pass: a fresh hash, so every pass has its own random parts
    used = counted.join(F.broadcast(t), "source")  # a row per source
    uses = used.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int"))))
    uses = uses.withColumn("block", F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed)), F.col("n_blocks")))
    blocks = uses.groupBy("source", "copy", "block").agg(F.sum("tokens").alias("bt"), F.first("passes").alias("passes"), F.first("need").alias("need"), F.first("available").alias("available"))
    # whole passes are taken as they are; of the last one, permuted blocks up to the need. Sums and ranks run over ranges of (source, order), no source in one task.
    perm = F.xxhash64("source", "copy", "block", F.lit(seed + 1))
    rest = F.col("need") - F.col("passes") * F.col("available")
    last = running(blocks.where(F.col("copy") == F.col("passes")), [perm, F.col("block")], {"_run": F.col("bt")}, ["source"])
    part = last.where(F.col("_run") - F.col("bt") / 2 <= rest).select("source", "copy", "block")
    whole = blocks.where(F.col("copy") < F.col("passes")).select("source", "copy", "block")
    order = [F.xxhash64("source", "copy", "block", F.lit(seed + 2)), F.col("copy"), F.col("block")]
    chosen = running(whole.unionByName(part), order, {"rank": F.lit(1)}, ["source"]).withColumn("rank", F.col("rank") - 1)
    chosen = cut(chosen.select("source", F.col("copy").cast("int").alias("copy"), "block", F.col("rank").cast("long").alias("rank")))
    quota = {r.source: r.n for r in chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(quota)
    shards = max(1, min(int(length // shard_tokens), sum(quota.values()) // 8))  # some blocks a shard, so that it holds a mix
    placed = place_blocks(chosen, shards, names, [quota[s] for s in names], seed)
    rows = uses.select("doc_id", "source", "copy", "block", "tokens").join(placed, ["source", "copy", "block"])
    order = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "copy", F.lit(seed + 3)), "doc_id", "copy")
    mixed = rows.select("doc_id", "source", "copy", "shard", (F.row_number().over(order) - 1).alias("position"), "tokens")
    targets_df = spark.createDataFrame([(s, w, w / total if s in have else 0.0, int(have[s].t) if s in have else 0, int(have[s].n) if s in have else 0) for s, w, _ in targets], "source string, target_share double, reachable_share double, tokens_available long, n_docs long")
    # uses of a record are copies 0..m, so the uses per record come from a partial sum per record
    per_doc = rows.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("u"))
    got = per_doc.groupBy("source").agg(F.sum("t").alias("tokens_used"), F.count(F.lit(1)).alias("n_docs_used"), F.max("u").alias("most_uses"))
    all_used = got.agg(F.sum("tokens_used").alias("_all"))
    report = targets_df.join(got, "source", "left").crossJoin(F.broadcast(all_used))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = report.select("source", "target_share", "reachable_share", F.coalesce(F.col("tokens_used") / F.col("_all"), F.lit(0.0)).alias("actual_share"), "tokens_available", zero("tokens_used"), "n_docs", zero("n_docs_used"), zero("most_uses"))
    return mixed, report
