"""Token-id shards compressed by Re-Pair (operator 4).

A shard holds consecutive documents. Frequent pairs of symbols get a nonterminal each, round after round until
no frequent pair is left; the payload stores the rules and the remaining symbols, so any token range of any
document is decoded without the rest. Payloads travel as rows of a Parquet table,
since that is what every store that Spark writes to can commit safely.

Payload, little-endian: magic, then 7 uint64 (base ids, rules, documents, symbols, ids, bits of a symbol,
0), then int64 document ids, int64 first ids, int64 first symbols (one more at the end of both), rule pairs
and symbols of that many bits (`packed`). How many ids a rule stands for follows from the pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hftok import SLICE_BYTES, ChunkEncoder, chunk_encoder
from .memory import tidy
from .ranges import partitions, with_range
from .scratch import Scratch

MAGIC = b"RPSHARD2"
#: A shard is closed once it holds this many ids.
SHARD_IDS = 1 << 20
#: The least count that earns a pair a rule.
LEAST_COUNT = 8
#: Times that a round looks for pairs that overlap none it replaces.
PASSES = 3
_SLOTS_LOG = 18


def compress(ids: np.ndarray, first: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, each document's first symbol, rule pairs and expansion lengths.

    ids: of all documents; first: each document's first id and the end. No pair crosses documents.
    Ends when no pair is left that occurs LEAST_COUNT times. In a round each pair that does is replaced where it
    is more frequent than the pairs that it overlaps; the most frequent one is so everywhere, so each round
    makes rules. A pair's count can only fall unless it holds a new symbol, so that a round looks only at new
    symbols' pairs and at those that were frequent in the round before.
    """
    n, starts = len(ids), first.astype(np.int64)
    # symbols stay where they are; after a replacement the second place is dead and skipped. n: no place
    symbols = np.append(ids.astype(np.uint32), np.uint32(0))
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    filled = np.diff(starts) > 0
    after[starts[1:][filled] - 1] = n
    before[starts[:-1][filled]] = n
    dead, live, near = np.zeros(n, bool), np.ones(n + 1, bool), np.zeros(n + 1, bool)
    rules: list[np.ndarray] = []
    lengths = [np.ones(base, np.int64)]
    made = 0
    table = np.empty(1 << _SLOTS_LOG, np.int32)
    while True:
        live[n] = False
        at = np.flatnonzero(live)
        at = at[after[at] != n]
        if len(at) < LEAST_COUNT:
            break
        # pairs take 32 bits as long as their symbols take 16
        two, bits = (np.uint32, 16) if base + made <= 1 << 16 else (np.uint64, 32)
        code = (symbols[at].astype(two) << two(bits)) | symbols[after[at]].astype(two)
        ordered = np.sort(code)
        edge = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
        count = np.diff(np.append(edge, len(ordered)))
        good = np.flatnonzero(count >= LEAST_COUNT)
        if not len(good):
            break
        # a pair's rank is its place by count; of pairs that share a slot, the last and most frequent has it, the others wait
        pairs = ordered[edge[good[np.argsort(count[good], kind="stable")]]]
        golden = two(0x9E3779B1 if bits == 16 else 0x9E3779B97F4A7C15)
        slot_of = lambda c: ((c * golden) >> two(2 * bits - _SLOTS_LOG)).astype(np.intp)
        table.fill(-1)
        table[slot_of(pairs)] = np.arange(len(pairs), dtype=np.int32)
        rank = table[slot_of(code)]
        taken = rank >= 0
        at, code, rank = at[taken], code[taken], rank[taken]
        live[:] = False
        live[at] = True
        rank[pairs[rank] != code] = -1
        # where a pair isn't less frequent than its neighbours, then likewise among those that overlap none of these;
        # of a run of one symbol, every second pair
        chosen, marked = [], []
        at, rank = at[rank >= 0], rank[rank >= 0]
        for _ in range(PASSES):
            touch = after[at[:-1]] == at[1:]
            best = np.ones(len(at), bool)
            best[1:] &= ~touch | (rank[1:] >= rank[:-1])
            best[:-1] &= ~touch | (rank[:-1] >= rank[1:])
            where, which = at[best], rank[best]
            place = np.arange(len(where))
            run = np.concatenate([[True], after[where[:-1]] != where[1:]])[: len(where)]
            odd = (place - np.maximum.accumulate(np.where(run, place, 0))) & 1 == 0
            where, which = where[odd], which[odd]
            chosen.append((where, which))
            marked += [before[where], where, after[where]]
            for places in marked[-3:]:
                near[places] = True
            free = ~near[at]
            at, rank = at[free], rank[free]
        for places in marked:
            near[places] = False
        at, rank = (np.concatenate(x) for x in zip(*chosen, strict=True))
        # half the count is what a run of one symbol has room for
        used = 2 * np.bincount(rank, minlength=len(pairs)) >= LEAST_COUNT
        at, rank = at[used[rank]], rank[used[rank]]
        symbols[at] = (np.cumsum(used) - 1 + (base + made))[rank]
        gone = after[at]
        dead[gone] = True
        live[gone] = False
        after[at] = after[gone]
        before[after[at]] = at
        live[at] = True
        live[before[at]] = True
        pairs = pairs[used]
        rules.append(np.stack([pairs >> two(bits), pairs & two((1 << bits) - 1)], 1).astype(np.int64))
        known = np.concatenate(lengths)
        lengths.append(known[rules[-1]].sum(axis=1))
        made += len(pairs)
    pair = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return symbols[:n][~dead], starts - np.concatenate([[0], np.cumsum(dead)])[starts], pair, np.concatenate(lengths)[base:]


def packed(symbols: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of each symbol, then a plane of one bit a symbol for each higher one."""
    planes = [np.packbits((symbols >> k & 1).astype(np.uint8)).tobytes() for k in range(16, bits)]
    return b"".join([symbols.astype("<u2").tobytes(), *planes])


def write_payload(doc_ids: list[int], documents: list[np.ndarray], base: int) -> bytes:
    first = np.concatenate([[0], np.cumsum([len(d) for d in documents], dtype=np.int64)]).astype(np.int64)
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    symbols, starts, pair, _ = compress(ids, first, base)
    bits = max(16, int(base + len(pair) - 1).bit_length())
    head = np.array([base, len(pair), len(doc_ids), len(symbols), len(ids), bits, 0], "<u8")
    parts = [head, np.array(doc_ids, "<i8"), first.astype("<i8"), starts.astype("<i8")]
    return MAGIC + b"".join(p.tobytes() for p in parts) + packed(pair.ravel(), bits) + packed(symbols, bits)


class ShardReader:
    """Random access to the token ids of one payload."""

    def __init__(self, payload: bytes):
        if payload[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        self.base, rules, docs, symbols, self.n_ids, bits, _ = (int(x) for x in np.frombuffer(payload, "<u8", 7, len(MAGIC)))
        at = len(MAGIC) + 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        def unpacked(n: int) -> np.ndarray:
            low = take("<u2", n)
            if bits == 16:
                return low
            out = low.astype(np.uint32)
            for k in range(16, bits):
                out |= np.unpackbits(take("u1", -(-n // 8)), count=n).astype(np.uint32) << np.uint32(k)
            return out

        self.doc_ids, self.first, self.starts = take("<i8", docs), take("<i8", docs + 1), take("<i8", docs + 1)
        self.pairs = unpacked(2 * rules).reshape(-1, 2)
        self.symbols = unpacked(symbols)

        # every symbol's ids, one after another: the base ids, then stretches of rules that hold no rule of their own stretch
        self._size, self._at = np.ones(self.base + rules, np.int64), np.arange(self.base + rules)
        flat, end = [np.arange(self.base, dtype="<u4")], self.base
        newest = self.pairs.max(axis=1, initial=0)
        done = 0
        while done < rules:
            own = newest[done:] >= self.base + done
            stop = done + int(own.argmax()) if own.any() else rules
            a, b = self.base + done, self.base + stop
            self._size[a:b] = self._size[self.pairs[done:stop]].sum(axis=1)
            self._at[a:b] = end + np.cumsum(self._size[a:b]) - self._size[a:b]
            self._flat = np.concatenate(flat)
            flat = [self._flat, self._expand(self.pairs[done:stop].ravel())]
            done, end = stop, end + len(flat[1])
        self._flat, self.lengths = np.concatenate(flat), self._size[self.base :]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        size = self._size[symbols]
        before = self._at[symbols] - (np.cumsum(size) - size)
        return self._flat[np.repeat(before, size) + np.arange(size.sum())]

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the shard's i-th document; only the symbols that cover them are expanded."""
        symbols = self.symbols[self.starts[i] : self.starts[i + 1]]
        n = int(self.first[i + 1] - self.first[i])
        start, stop, _ = slice(start, stop).indices(n)
        if start == 0 and stop == n:
            return self._expand(symbols)
        ends = np.cumsum(self._size[symbols])
        a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        before = int(ends[a - 1]) if a else 0
        return self._expand(symbols[a:b])[start - before : max(start, stop) - before]

    def all_ids(self) -> np.ndarray:
        return self._expand(self.symbols)


def _encoded(batches: Iterator[pd.DataFrame], encoder: ChunkEncoder) -> Iterator[tuple[int, int, np.ndarray]]:
    """(part, key, ids) of each row; batches are taken together up to what the encoder works on at once."""
    rows: list[tuple[int, int, str]] = []
    size = 0
    for pdf in batches:
        rows += zip(pdf["part"], pdf["key"], pdf["text"], strict=True)
        size += int(pdf["text"].str.len().sum())
        if size >= SLICE_BYTES:
            yield from ((of, key, ids) for (of, key, _), ids in zip(rows, encoder.encode_all([t for *_, t in rows]), strict=True))
            rows, size = [], 0
    yield from ((of, key, ids) for (of, key, _), ids in zip(rows, encoder.encode_all([t for *_, t in rows]), strict=True))


def write_shards(docs: DataFrame, path: str, base: int, end_id: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes documents in ascending id order and writes them as shards.

    Returns the written table (part, seq, before, n_docs, n_ids, payload); ascending part and seq is ascending id,
    before: the ids of the part's shards before.
    Null and empty texts hold the end id alone; rows of equal id stand by text, repeated rows next to each
    other; a null id sorts first and is stored as the least 64-bit integer, which is thus no id of its own. An empty table gives no shards.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_range(rows).repartition(partitions(docs), "part").sortWithinPartitions("part", "key", "text")

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = chunk_encoder(path), np.array([end_id], "<u4")
        keys: list[int] = []
        ids: list[np.ndarray] = []
        part = held = seq = before = 0

        def shard() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "seq": [seq], "before": [before], "n_docs": [len(keys)], "n_ids": [held], "payload": [write_payload(keys, ids, base)]})

        for of, key, found in _encoded(batches, encoder):
            if keys and (of != part or held >= SHARD_IDS):
                yield shard()
                before += held
                keys, ids, held, seq = [], [], 0, seq + 1
            if of != part:
                part, seq, before = of, 0, 0
            keys.append(key)
            ids.append(np.append(found, end))
            held += len(ids[-1])
        if keys:
            yield shard()

    return scratch.save(rows.mapInPandas(run, "part int, seq int, before long, n_docs long, n_ids long, payload binary"), "shards")


def part_offsets(shards: DataFrame) -> DataFrame:
    """(part, base): ids in all parts before each. Parts are ranges.RANGES_A_PARTITION a shuffle partition at most, whatever the corpus."""
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    rows, base = [], 0
    for part, n in totals:
        rows.append((part, base))
        base += n
    return shards.sparkSession.createDataFrame(rows, "part int, base long")


def read_documents(shards: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32[, ids]) of each document, decoded from the shards where they are read."""
    offsets = F.broadcast(part_offsets(shards.select("part", "n_ids")))  # one row a part
    located = shards.select("part", "before", "payload").join(offsets, "part").select((F.col("base") + F.col("before")).alias("before"), "payload")

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for payload, before in zip(pdf["payload"], pdf["before"], strict=True):
                shard = ShardReader(payload)
                ids = shard.all_ids()
                docs = [ids[a:b] for a, b in zip(shard.first[:-1], shard.first[1:], strict=True)]
                out = {id_col: pd.array(shard.doc_ids, "Int64"), "start": before + shard.first[:-1], "n_tokens": np.diff(shard.first), "ids_crc32": [zlib.crc32(d) for d in docs]}
                out[id_col][shard.doc_ids == -(2**63)] = pd.NA
                yield pd.DataFrame(out | ({"ids": [d.astype(np.int64) for d in docs]} if with_ids else {}))

    return located.mapInPandas(run, f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
