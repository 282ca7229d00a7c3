"""Passages of held-out items inside corpus documents.

Items are cut into overlapping windows of two kinds: of ``size`` words, the run
that counts as a leak, and of about the item's own size (the greatest of 2, 4, 8
... times ``size`` that fits), which find an item that leaked whole but edited.
An item shorter than ``size`` is one window of its own size. Every document
window of such a size gets a SimHash fingerprint. The 64 bits are split into
radius + 1 blocks: two fingerprints within the radius agree in one block at
least, so looking up equal blocks finds all of them, with no probability
involved. Candidates are then verified on the words themselves: weighted Jaccard
similarity of their five-word shingles. A shingle of the item weighs
ln(1 + items / items that hold it), so phrases that many items share count
little; one that only the document has weighs as one that no other item has.

The item windows are shipped to the tasks in portions of at most
``most_shipped``, with one pass over the documents per portion: nothing that
grows with the documents is shuffled or shipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verispan.llm.words import WordHash, grams, simhash_windows, words_of
from verispan.session import cut

SHINGLE = 5
#: Item windows shipped at once (about 60 bytes each).
MOST_SHIPPED = 200_000
_CHUNK = 1 << 15
#: Words of one row of the item table: a longer item is spread over several rows.
_PIECE = 4096

_ITEMS = "item_id long, first int, n int, words array<long>"
HITS = "doc_id long, item_id long, doc_pos int, item_pos int, size int, distance int, similarity double, run int, exact boolean"
_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_pos", pa.int32()), ("item_pos", pa.int32()), ("size", pa.int32()), ("distance", pa.int32()), ("similarity", pa.float64()), ("run", pa.int32()), ("exact", pa.bool_())])


def blocks_of(fp: np.ndarray, radius: int) -> list[tuple[np.ndarray, int]]:
    """The radius + 1 blocks of each fingerprint, as equal in width as 64 bits allow, and their widths."""
    edge = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [((fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1), b - a) for a, b in zip(edge, edge[1:])]


def sizes_of(n: int, size: int) -> list[int]:
    """The window sizes of an item of n words: the run and the size nearest to the item's own."""
    if n < size:
        return [n] if n else []
    own = size
    while 2 * own <= n:
        own *= 2
    return sorted({size, own})


def item_words(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "item_text") -> DataFrame:
    """(item_id, first, n, words) of the items, long ones in pieces: ``words`` are hashes from word ``first`` on, n the words of the whole item."""

    def run(batches):
        import pandas as pd

        wh = WordHash()
        for pdf in batches:
            out = []
            for i, t in zip(pdf["_id"], pdf["_text"]):
                h = wh(words_of(t)).view(np.int64)
                most = max(sizes_of(len(h), size), default=1)
                out += [(int(i), p, len(h), h[p : p + _PIECE + most - 1]) for p in range(0, max(1, len(h) - most + 1), _PIECE) if len(h)]
            yield pd.DataFrame(out, columns=["item_id", "first", "n", "words"])

    d = items.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_id is not null and _text is not null").distinct()
    return d.mapInPandas(run, _ITEMS)


def shingle_counts(pieces: DataFrame) -> DataFrame:
    """(shingle, items that hold it)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = {(int(i), int(s)) for i, w in zip(pdf["item_id"], pdf["words"]) for s in grams(np.asarray(w, np.int64).view(np.uint64), SHINGLE).view(np.int64)}
            yield pd.DataFrame(list(rows), columns=["item_id", "shingle"])

    return pieces.mapInPandas(run, "item_id long, shingle long").distinct().groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))


def _shingles(h: np.ndarray) -> np.ndarray:
    """The shingle begun at each word; none where the words do not suffice."""
    return grams(h, SHINGLE) if len(h) >= SHINGLE else np.empty(0, np.uint64)


class Lookup:
    """Item windows by size and fingerprint block, and the verification of what they find."""

    def __init__(self, pieces: list[tuple[int, int, int, np.ndarray]], weights: dict[int, float], rare: float, size: int, radius: int, similarity: float) -> None:
        self.weights, self.rare, self.radius, self.least = weights, rare, radius, similarity
        self.words = np.concatenate([np.asarray(w, np.int64).view(np.uint64) for *_, w in pieces]) if pieces else np.empty(0, np.uint64)
        self.shingles = _shingles(self.words)
        at = np.r_[0, np.cumsum([len(w) for *_, w in pieces])].astype(np.int64)
        made: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, (item, first, n, _) in enumerate(pieces):
            h = self.words[at[k] : at[k + 1]]
            most = max(sizes_of(n, size))
            for s in sizes_of(n, size):
                fps = simhash_windows(h, s)
                # the words after the piece's own are there for its longest windows; the last piece of an item keeps all
                last = first + len(h) >= n
                fps = fps if last or s == most else fps[:_PIECE]
                p = np.arange(len(fps))
                made.setdefault(s, []).append((fps, np.full(len(fps), item), first + p, at[k] + p))
        self.tables = {}
        for s, parts in made.items():
            fps, item, pos, start = (np.concatenate(c) for c in zip(*parts))
            lists = []
            for keys, width in blocks_of(fps, radius):
                order = np.argsort(keys, kind="stable")
                if width <= 16:  # the first window of every key value
                    lists.append((np.searchsorted(keys[order], np.arange((1 << width) + 1, dtype=np.uint64)).astype(np.int64), order, True))
                else:
                    lists.append((keys[order], order, False))
            self.tables[s] = (fps, item, pos, start, lists)

    def candidates(self, f: np.ndarray, size: int) -> np.ndarray:
        """(window, item window, distance) of all pairs within the radius."""
        fps, _, _, _, lists = self.tables[size]
        found = []
        for (keys, order, direct), (blk, _) in zip(lists, blocks_of(f, self.radius)):
            b = blk.astype(np.int64) if direct else blk
            lo, hi = (keys[b], keys[b + 1]) if direct else (np.searchsorted(keys, b, "left"), np.searchsorted(keys, b, "right"))
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            n = hi[hit] - lo[hit]
            w = np.repeat(hit, n)
            k = order[np.repeat(lo[hit] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
            dist = np.bitwise_count(f[w] ^ fps[k]).astype(np.int64)
            near = dist <= self.radius
            if near.any():
                found.append(np.stack([w[near], k[near], dist[near]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)

    def verify(self, mine: np.ndarray, theirs: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
        """(weighted similarity, longest run of equal words at equal places) of a document's and an item's window and their shingles."""
        same = mine == theirs
        if same.all():
            return 1.0, len(mine)
        x, y = set(x.tolist()), set(y.tolist())
        weigh = lambda s: self.weights.get(s, self.rare) if s in y else self.rare
        both, apart = sum(map(weigh, x & y)), sum(map(weigh, x ^ y))
        breaks = np.flatnonzero(np.r_[True, ~same, True])
        return both / (both + apart), int(np.diff(breaks).max()) - 1

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hits of (id, text) batches; texts are read whole, in chunks of words."""
        wh = WordHash()
        most = max(self.tables, default=1)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            per_row = [wh(words_of(t)) for t in b.column(1).to_pylist()]
            n_words = np.array([len(x) for x in per_row], np.int64)
            if not n_words.sum():
                continue
            h, first = np.concatenate(per_row), np.cumsum(n_words) - n_words
            row = np.repeat(np.arange(len(ids)), n_words)
            for at in range(0, len(h), _CHUNK):
                # the chunk and the words that a window begun in it may reach
                part = h[at : at + _CHUNK + most - 1]
                shingles = _shingles(part)
                for size, (_, item, pos, start, _) in self.tables.items():
                    fps = simhash_windows(part, size)[:_CHUNK]
                    own = np.flatnonzero(row[at : at + len(fps)] == row[at + size - 1 : at + size - 1 + len(fps)])
                    out = []
                    for w, k, dist in self.candidates(fps[own], size).tolist():
                        o, i = int(own[w]), int(start[k])
                        p, n = at + o, size - SHINGLE + 1
                        mine, theirs = h[p : p + size], self.words[i : i + size]
                        x, y = (shingles[o : o + n], self.shingles[i : i + n]) if n > 0 else (grams(mine, SHINGLE), grams(theirs, SHINGLE))
                        sim, run = self.verify(mine, theirs, x, y)
                        if sim >= self.least:
                            out.append((int(ids[row[p]]), int(item[k]), int(p - first[row[p]]), int(pos[k]), size, dist, sim, run, run == size))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _HITS)], schema=_HITS)


def leaked_windows(spark: SparkSession, docs: DataFrame, items: DataFrame, size: int = 12, radius: int = 3, similarity: float = 0.8,
                   most_shipped: int = MOST_SHIPPED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of a document window and an item window that are alike.

    Columns as in HITS: positions count words from 0; ``run`` is the longest run
    of equal words at equal places, ``exact`` says that all agree. Every pair of
    windows whose fingerprints differ in at most ``radius`` bits is verified;
    identical windows always are (distance 0). Words are compared by 64-bit hashes.
    Null, empty and word-less texts give nothing; empty tables give no rows;
    repeated items count once, repeated documents repeat their rows.
    """
    pieces = cut(item_words(items, size))
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).where("_id is not null and _text is not null and _text != ''")
    # every word of a piece begins two windows at most
    told = pieces.agg(F.countDistinct("item_id").alias("items"), F.coalesce(F.sum(2 * F.size("words")), F.lit(0)).alias("windows")).first()
    portions = max(1, -(-told.windows // most_shipped))
    rare = float(np.log1p(told.items))
    counts = shingle_counts(pieces)
    out = None
    for k in range(portions):
        mine = pieces.where(F.pmod(F.xxhash64("item_id", "first"), F.lit(portions)) == k) if portions > 1 else pieces
        rows = [(r.item_id, r["first"], r.n, np.array(r.words, np.int64)) for r in mine.collect()]
        held = counts if portions == 1 else counts.join(shingle_counts(mine).select("shingle"), "shingle", "left_semi")
        weights = {r.shingle & (2**64 - 1): float(np.log1p(told.items / r["df"])) for r in held.collect()}
        table = spark.sparkContext.broadcast((rows, weights))
        part = d.mapInArrow(lambda it, table=table: Lookup(*table.value, rare, size, radius, similarity).run(it), HITS)
        out = part if out is None else out.unionByName(part)
    return out


def leaked_items(hits: DataFrame, run: int = 12) -> DataFrame:
    """Documents with the items they share a run of at least ``run`` words with, confirmed on the verified windows: doc_id, item_id."""
    return hits.where(F.col("run") >= run).select("doc_id", "item_id").distinct()


def leak_report(hits: DataFrame, items: DataFrame, run: int = 12) -> DataFrame:
    """Per leaked item: documents hit, those with a run of ``run`` equal words, those only alike, most windows found in one document, best similarity."""
    per = hits.groupBy("doc_id", "item_id").agg(F.countDistinct("item_pos").alias("_w"), F.max("similarity").alias("_s"), F.max("run").alias("_r"))
    g = per.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("_r") >= run).alias("n_docs_run"), F.count_if(F.col("_r") < run).alias("n_docs_alike"), F.max("_w").alias("max_windows"), F.max("_s").alias("best_similarity"))
    names = items.select("item_id", "benchmark_name", "heldout_split").distinct()
    return names.join(g, "item_id").select("item_id", "benchmark_name", "heldout_split", "n_docs", "n_docs_run", "n_docs_alike", "max_windows", "best_similarity")
