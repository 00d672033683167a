"""Best-fit decreasing packing of documents into windows (operator 8).

Overlong documents are first cut into full windows. What is left of each is shorter than a window, so best
fit needs only the number of pieces of each length: a histogram of fewer than `window` entries, whatever
the corpus. best_fit() plans all windows from it on the driver, run by run of equal steps, with a segment
tree over the remaining capacities; pieces then find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hftok import chunk_encoder
from .memory import tidy
from .scratch import Scratch


#: Bytes of pre-tokens that a worker remembers, twice over: less than elsewhere, as workers that rest between a pipeline's stages keep them.
REMEMBERED = 28 << 20


class CapacityTree:
    """Open windows by remaining capacity; a segment tree finds the least capacity that is large enough."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.open = [0] * (2 * self.size)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def put(self, capacity: int, first: int, n: int) -> None:
        """n windows, numbered from first, now have this capacity left."""
        if n and capacity:
            self.groups[capacity].append((first, n))
            self._add(capacity, n)

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """Up to `most` windows of this capacity: first number and how many."""
        first, n = self.groups[capacity].pop()
        used = min(n, most)
        if used < n:
            self.groups[capacity].append((first + used, n - used))
        self._add(capacity, -used)
        return first, used

    def _add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.open[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least capacity >= length with an open window."""
        at = length + self.size
        if self.open[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit(counts: dict[int, int], window: int) -> pd.DataFrame:
    """The plan: rows (length, rank, n, each, sequence, offset).

    The pieces of this length with ranks rank to rank + n - 1 go, `each` to a window one after another,
    to windows sequence, sequence + 1, ..., the first of each at this offset. The number of rows depends
    on the window's size, not on how many pieces there are.
    """
    tree, opened, plan = CapacityTree(window), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, used = window, opened, -(-left // (window // length))
                opened += used
            else:
                first, used = tree.take(capacity, -(-left // (capacity // length)))
            # best fit stays with a window while it has room, since nothing open is tighter
            each = capacity // length
            full = min(used, left // each)
            if full:
                plan.append((length, rank, full * each, each, first, window - capacity))
                tree.put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < used:
                if left:
                    plan.append((length, rank, left, left, first + full, window - capacity))
                tree.put(capacity - left * length, first + full, 1)
                rank, left = rank + left, 0
    return pd.DataFrame(plan, columns=["length", "rank", "n", "each", "sequence", "offset"]).astype("int64")


def cut(docs: DataFrame, path: str, end_id: int, window: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Each document's pieces: full windows, then the rest, with its rank among this task's pieces of its length."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, seen = chunk_encoder(path, True, REMEMBERED), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for pdf in batches:
            rows = []
            texts = [t or "" for t in pdf["text"]]
            for key, ids in zip(pdf["key"], encoder.encode_all(texts), strict=True):
                data = ids.tobytes() + end
                n = len(data) // 4
                for start in range(0, n, window):
                    length = min(window, n - start)
                    piece = data[4 * start : 4 * (start + length)]
                    rows.append((key, start, length, zlib.crc32(piece), n, part, int(seen[length]), *([np.frombuffer(piece, "<u4").astype(np.int64)] if with_ids else [])))
                    seen[length] += 1
            out = pd.DataFrame(rows, columns=["key", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", *["ids"] * with_ids])
            yield out.astype({"key": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "key long, start long, length long, ids_crc32 long, doc_tokens long, part int, rank long" + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, path: str, end_id: int, scratch: Scratch, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces with their place: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]).

    A sequence is padded to `window`. Null and empty texts are the end id alone; repeated rows and equal ids are
    packed row by row; a null id stays null; an empty table gives no pieces. Other columns are left out.
    """
    pieces = scratch.save(cut(docs, path, end_id, window, id_col, text_col, with_ids), "pieces")
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = scratch.save(by_part.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))), "ranks")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    full = counts.pop(window, 0)
    plan = best_fit(counts, window)
    plan["sequence"] += full
    by_length = {int(k): {c: g[c].to_numpy() for c in plan.columns} for k, g in plan.groupby("length")}
    shared = docs.sparkSession.sparkContext.broadcast(by_length)  # bounded by the window's size

    @tidy
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans = shared.value
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), (pdf["rank"] + pdf["before"]).to_numpy()
            sequence, offset = rank.copy(), np.zeros(len(pdf), np.int64)  # full windows stand first, one sequence each
            for k in np.unique(length):
                if k == window:
                    continue
                at, p = np.flatnonzero(length == k), plans[int(k)]
                row = np.searchsorted(p["rank"], rank[at], side="right") - 1
                nth = rank[at] - p["rank"][row]
                sequence[at] = p["sequence"][row] + nth // p["each"][row]
                offset[at] = p["offset"][row] + nth % p["each"][row] * k
            yield pdf.drop(columns=["rank", "before"]).assign(sequence_id=sequence, offset=offset).astype({"key": "Int64"})

    # rows of ranks grow with the tasks, so they aren't broadcast; a key's pieces are those of one length in one task
    ranked = pieces.join(by_part.drop("n").hint("merge"), ["length", "part"]).select("key", "start", "length", "ids_crc32", "doc_tokens", "rank", "before", *["ids"] * with_ids)
    placed = ranked.mapInPandas(place, "key long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids + ", sequence_id long, offset long")
    return placed.withColumnRenamed("key", id_col)
