"""Records of evaluation splits that occur again, exactly or almost, in the training split.

Three ways to overlap: by id, by content hash, by text. Texts are compared once
per distinct text, by their sets of words. Word sets of n and m words and
similarity s differ in at most d = (n + m) (1 - s) / (1 + s) words. So the words
are dealt to groups of parts such that in one group at most one part differs,
whatever the d words are: signatures of the groups with one part left out find
every pair. What shares a signature is held against the sizes and a 128-bit parity
sketch, where each word that differs changes one bit at most, and verified on
the sets of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispan.llm.words import WordHash, words_of
from verispan.session import cut

_TEXT = pa.schema([("tk", pa.int64()), ("tk2", pa.int64()), ("in_train", pa.bool_()), ("in_eval", pa.bool_()), ("words", pa.list_(pa.int64()))])
TEXTS = "tk long, tk2 long, in_train boolean, in_eval boolean, words array<long>"


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wh = WordHash()
    for b in batches:
        sets = [np.unique(wh(words_of(t, fold_looks=False))) for t in b.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], _lists(sets)], schema=_TEXT)


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row per distinct text with words (side, text): its sides and word set. The text itself is moved once."""
    d = rows.where("text is not null").select(F.xxhash64("text").alias("tk"), F.xxhash64(F.lit(1), "text").alias("tk2"), F.col("side") == "train", F.col("side") != "train", "text").toDF("tk", "tk2", "t", "e", "text")
    g = d.groupBy("tk", "tk2").agg(F.max("t").alias("in_train"), F.max("e").alias("in_eval"), F.first("text").alias("text"))
    return g.mapInArrow(_features, TEXTS).where("size(words) > 0")


#: Common words that are dealt to the parts by how much they tell, so that no part tells little; the rest are dealt by hash.
MOST_DEALT = 4096
#: Parts of a group, of which one is left out.
PARTS = 4


def _dealt_words(texts: DataFrame, most: int = MOST_DEALT) -> tuple[np.ndarray, np.ndarray]:
    """The most common words, sorted, and the rank of each by what it tells. Only an order: any fixed one keeps the search complete."""
    rows = texts.select(F.explode("words").alias("word")).groupBy("word").count().orderBy(F.desc("count")).limit(most).collect()
    words, p = np.array([r.word for r in rows], np.int64), np.array([r["count"] for r in rows]) / max(1, texts.count())
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(p * p + (1 - p) ** 2, kind="stable")] = np.arange(len(words))
    order = np.argsort(words)
    return words[order], rank[order]


def _size_classes(largest: int, step: float = 1.1) -> np.ndarray:
    """The first size of each class of set sizes, up to ``largest``, and the one after the last."""
    at = [1]
    while at[-1] <= largest:
        at.append(max(at[-1], int(at[-1] * step)) + 1)
    return np.array(at)


def _scheme(last: int, similarity: float) -> tuple[int, int, np.ndarray]:
    """(groups, parts, kept) for training sets of at most ``last`` words; kept (parts, choices) is 1 where a choice keeps the part."""
    most = int((last + int(last / similarity + 1e-9)) * (1 - similarity) / (1 + similarity) + 1e-9)
    if not most:  # only equal sets
        return 1, 1, np.ones((1, 1), np.uint64)
    return -(-(most + 1) // 2), PARTS, (1 - np.eye(PARTS)).astype(np.uint64)


_SIGNED = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("sig", pa.int64())])
SIGNED = "id long, n int, low long, high long, sig long"


def _signatures(words: np.ndarray, rank: np.ndarray, similarity: float, train: bool, batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Signatures of the sets (id, words): a training set signs for its own size class, an evaluation set for all it can be similar to."""
    for b in batches:
        ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        flat, off = flat[off[0] : off[-1]], off - off[0]
        h, n = flat.view(np.uint64), np.diff(off)
        dealt = np.full(len(flat), -1)
        if len(words):
            at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
            dealt = np.where(words[at] == flat, rank[at], -1)
        bit, upper = np.uint64(1) << ((h >> np.uint64(7)) & np.uint64(63)), (h >> np.uint64(13)) & np.uint64(1)
        low, high = (np.bitwise_xor.reduceat(bit * x, off[:-1]).view(np.int64) for x in (np.uint64(1) - upper, upper))
        least, largest = (n, n) if train else (np.ceil(similarity * n - 1e-9).astype(int), (n / similarity + 1e-9).astype(int))
        classes = _size_classes(int(largest.max()))
        first, last = np.searchsorted(classes, least, "right") - 1, np.searchsorted(classes, largest, "right") - 1
        for c in range(int(first.min()), int(last.max()) + 1):
            own = np.flatnonzero((first <= c) & (c <= last))
            groups, parts, kept = _scheme(int(classes[c + 1] - 1), similarity)
            p, k = groups * parts, groups * kept.shape[1]
            salt = (np.arange(k, dtype=np.uint64) + np.uint64(c << 32)) * np.uint64(0x9E3779B97F4A7C15)
            turn = dealt % (2 * p)  # forth and back, so that the sums of the parts are near each other
            part = np.where(dealt < 0, ((h >> np.uint64(33)) % np.uint64(p)).astype(np.int64), np.minimum(turn, 2 * p - 1 - turn))
            step = max(1, most // k)
            for some in (own[i : i + step] for i in range(0, len(own), step)):
                size = n[some]
                row = np.repeat(np.arange(len(some)), size)
                word = np.arange(len(row)) + np.repeat(off[some] - np.r_[0, np.cumsum(size)[:-1]], size)
                sums = np.zeros(len(some) * p, np.uint64)
                np.add.at(sums, row * p + part[word], h[word])
                x = (sums.reshape(-1, groups, parts) @ kept).reshape(len(some), k) ^ salt
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(32)
                each = [np.repeat(v, k) for v in (ids[some], size.astype(np.int32), low[some], high[some])]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*each, x.ravel().view(np.int64))], schema=_SIGNED)


def text_pairs(texts: DataFrame, similarity: float = 0.75) -> DataFrame:
    """All pairs (e, t, containment) of the ids of an evaluation and a training text with word sets of Jaccard similarity >= similarity.

    containment is the share of the evaluation text's words that the training
    text holds. texts (id, in_train, in_eval, words) must be a written table: it is read several times.
    """
    if not 0 < similarity <= 1:
        raise ValueError(f"similarity {similarity} is not in (0, 1]")
    words, rank = _dealt_words(texts)
    shipped = texts.sparkSession.sparkContext.broadcast((words, rank))
    sign = lambda side: texts.where(f"in_{side}").select("id", "words").mapInArrow(lambda it: _signatures(*shipped.value, similarity, side == "train", it), SIGNED)
    ev, tr = sign("eval").toDF("e", "n", "e_low", "e_high", "sig"), sign("train").toDF("t", "m", "t_low", "t_high", "sig")
    differ = sum((F.bit_count(F.col(f"e_{x}").bitwiseXOR(F.col(f"t_{x}"))) for x in ("low", "high")), F.lit(0))
    may = (differ <= (F.col("n") + F.col("m")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-9) & (F.least("n", "m") >= F.greatest("n", "m") * F.lit(similarity) - 1e-9)
    hits = ev.join(tr, "sig").where(may).select("e", "t").distinct()
    e = texts.where("in_eval").select(F.col("id").alias("e"), F.col("words").alias("e_words"))
    t = texts.where("in_train").select(F.col("id").alias("t"), F.col("words").alias("t_words"))
    both = F.size(F.array_intersect("e_words", "t_words"))
    return hits.join(e, "e").join(t, "t").where(both >= F.lit(similarity) * (F.size("e_words") + F.size("t_words") - both)).select("e", "t", (both / F.size("e_words")).alias("containment"))


def _sides(rows: DataFrame, record: Column, split: Column, key: Column, text: Column, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(record, side, key, keys of the text) rows, and the similar pairs of distinct texts with their containment."""
    d = rows.select(record.alias("record"), split.alias("split"), key.alias("key"), text.alias("text")).where("record is not null and split is not null")
    d = d.withColumn("side", F.when(F.col("split") == "train", "train").otherwise("eval"))
    thin = cut(d.select("record", "side", "key", F.xxhash64("text").alias("tk"), F.xxhash64(F.lit(1), "text").alias("tk2"), F.col("text").isNotNull().alias("has_text")).distinct())
    texts = cut(distinct_texts(d.select("side", "text")).withColumn("id", F.monotonically_increasing_id()))
    ids = texts.select("id", "tk", "tk2")
    pairs = text_pairs(texts, similarity)
    return thin, pairs.join(ids.toDF("e", "e_tk", "e_tk2"), "e").join(ids.toDF("t", "t_tk", "t_tk2"), "t").select("e_tk", "e_tk2", "t_tk", "t_tk2", "containment")


def cross_split_links(rows: DataFrame, record: Column, split: Column, key: Column, text: Column, similarity: float = 0.75) -> DataFrame:
    """Links (record_eval, record_train, reason, containment) between records of evaluation and training splits.

    record, split (normalized, null for none) , key (content hash, null where it
    stands for nothing) and text are expressions on rows. Rows without record or
    split are left out; null texts and texts without words match nothing. Reason
    is ``id``, ``hash`` or ``text``; a pair can have several. containment is the
    greatest share of an evaluation text's words that the training text holds,
    null for the other reasons. Repeated rows count once.
    """
    thin, pairs = _sides(rows, record, split, key, text, similarity)
    ev, tr = thin.where("side = 'eval'"), thin.where("side = 'train'")
    by_id = ev.select("record").distinct().join(tr.select("record").distinct(), "record", "left_semi").select(F.col("record").alias("record_eval"), F.col("record").alias("record_train"), F.lit("id").alias("reason"))
    eh = ev.where("key is not null").select("key", F.col("record").alias("record_eval")).distinct()
    th = tr.where("key is not null").select("key", F.col("record").alias("record_train")).distinct()
    by_hash = eh.join(th, "key").select("record_eval", "record_train", F.lit("hash").alias("reason")).distinct()
    er = ev.where("has_text").select(F.col("tk").alias("e_tk"), F.col("tk2").alias("e_tk2"), F.col("record").alias("record_eval")).distinct()
    tt = tr.where("has_text").select(F.col("tk").alias("t_tk"), F.col("tk2").alias("t_tk2"), F.col("record").alias("record_train")).distinct()
    by_text = pairs.join(er, ["e_tk", "e_tk2"]).join(tt, ["t_tk", "t_tk2"]).groupBy("record_eval", "record_train").agg(F.lit("text").alias("reason"), F.max("containment").alias("containment"))
    return by_id.unionByName(by_hash).withColumn("containment", F.lit(None).cast("double")).unionByName(by_text)


def overlap_pairs(links: DataFrame) -> DataFrame:
    """Unordered pairs, the smaller record first; a record on both sides is paired with itself."""
    a, b = F.least("record_eval", "record_train"), F.greatest("record_eval", "record_train")
    return links.select(a.alias("image_id_a"), b.alias("image_id_b")).distinct()


def text_classes(pairs: DataFrame) -> DataFrame:
    """(e_tk, e_tk2, n_links, containment): every evaluation text that has similar training texts, with their number and the greatest containment; copies of a text are one."""
    return pairs.groupBy("e_tk", "e_tk2").agg(F.count(F.lit(1)).alias("n_links"), F.max("containment").alias("containment"))


def overlap_report(rows: DataFrame, record: Column, split: Column, key: Column, text: Column, source: Column, similarity: float = 0.75) -> DataFrame:
    """Per evaluation split and source: records, those that overlap with training by each reason, and the mean over records of the greatest containment of a text.

    Records are held against the training ids, hashes and texts that occur there,
    each once: no pair of records is made, however many share a hash or text.
    """
    thin, pairs = _sides(rows, record, split, key, text, similarity)
    ev, tr = thin.where("side = 'eval'"), thin.where("side = 'train'")
    parts = [
        ev.join(tr.select("record").distinct(), "record", "left_semi").select("record", F.lit("id").alias("reason"), F.lit(None).cast("double").alias("containment")),
        ev.join(tr.where("key is not null").select("key").distinct(), "key", "left_semi").select("record", F.lit("hash").alias("reason"), F.lit(None).cast("double").alias("containment")),
        ev.where("has_text").join(text_classes(pairs), (F.col("tk") == F.col("e_tk")) & (F.col("tk2") == F.col("e_tk2"))).select("record", F.lit("text").alias("reason"), "containment"),
    ]
    hits = parts[0].unionByName(parts[1]).unionByName(parts[2])
    why = hits.groupBy("record").agg(*(F.max((F.col("reason") == r).cast("int")).alias(r) for r in ("id", "hash", "text")), F.max("containment").alias("containment"))
    own = rows.select(record.alias("record"), split.alias("split"), F.coalesce(source, F.lit("none")).alias("dataset_source")).where("record is not null and split is not null and split != 'train'").distinct()
    j = own.join(why, "record", "left")
    n = lambda r: F.coalesce(F.sum(r), F.lit(0)).alias(f"n_by_{r}")
    return j.groupBy("split", "dataset_source").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("id").isNotNull()).alias("n_overlapping"), n("id"), n("hash"), n("text"), F.avg("containment").alias("mean_containment"))
