"""Removal of repeated byte strings by suffix arrays built with a difference cover (operator 9).

Sorting every suffix of the corpus at once would move many times the corpus. Strings of LENGTH bytes can only
be equal if the same GRAM-byte part of theirs is the least by hash (their anchor), at the same place. So each
window of LENGTH bytes belongs to one anchor, and only windows whose anchors occur twice are sorted, an
anchor's windows in one place. There the difference-cover algorithm sorts them: triples at two of three
places are named, the names' own suffix array is made recursively, the remaining suffixes are merged in, and
adjacent prefixes of LENGTH bytes are compared. Surroundings of an anchor that are equal as a whole don't go
through the sort again: one stands for all. Hashes only say what to compare: equality is decided on bytes everywhere.

Documents travel as slices: compressed Arrow batches of about SLICE_BYTES of text, written once. What is
found about a slice comes back to it as bit masks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit
from .memory import release, tidy
from .scratch import Scratch

LENGTH, GRAM = 100, 40
#: Starts of windows that may share an anchor.
REACH = LENGTH - GRAM + 1
SLICE_BYTES = 1_000_000
#: Windows whose anchors are looked for at once, in about 60 bytes of memory each; a longer text takes several bytes a byte beside.
STRETCH = 1_000_000
#: Text that one bucket's anchors stand for, at least as many buckets as shuffle partitions; and of contexts sorted at once.
BUCKET_BYTES, SORTED_BYTES = 16_000_000, 400_000
#: An anchor in more slices than this is split into anchors of LENGTH + 1 - SPLIT bytes, one for each SPLIT places it may have in a window.
HOT_SLICES, SPLIT = 64, 16
_KEY, _TEXT = "__key", "__text"


# The suffix array


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of s's suffixes in order; a suffix stands before those that it begins. s: integers from 0."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    t[:n] += 1
    top = int(t.max()) + 1
    m0, m1 = np.arange(0, n, 3), np.arange(1, n + (n % 3 == 1), 3)
    m2 = np.arange(2, n, 3)
    sample = np.concatenate([m1, m2])
    if top < 1 << 20:
        triple = (t[sample] * top + t[sample + 1]) * top + t[sample + 2]
    else:
        _, low = np.unique(t[sample + 1] * top + t[sample + 2], return_inverse=True)
        triple = t[sample] * (len(sample) + 1) + low
    order = np.argsort(triple, kind="stable")
    ordered = triple[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh) - 1
    if not fresh.all():
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sorted12 = sample[order]
    sorted12 = sorted12[sorted12 < n]
    high = len(sample) + 2
    single = lambda i: t[i] * high + rank[i + 1]
    sorted0 = m0[np.argsort(single(m0), kind="stable")]
    ones, twos = sorted12[sorted12 % 3 == 1], sorted12[sorted12 % 3 == 2]
    # a remaining suffix against sampled ones: by its first sign and the rank of what follows, or by two signs and that
    before = np.searchsorted(single(ones), single(sorted0))
    pair = np.unique(t[:-1] * top + t[1:], return_inverse=True)[1]
    double = lambda i: pair[i] * high + rank[i + 2]
    before += np.searchsorted(double(twos), double(sorted0))
    out = np.empty(n, np.int64)
    at = np.arange(len(sorted0)) + before
    out[at] = sorted0
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sorted12
    return out


# Slices


def make_slices(docs: DataFrame) -> DataFrame:
    """(slice, body): docs' rows, __key and __text among their columns, as compressed Arrow streams."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, offsets = textkit.utf8(batch.column(_TEXT))
            for a, b in textkit.slices(offsets, SLICE_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + seq], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "body"])
                seq += 1

    return docs.mapInArrow(run, "slice long, body binary")


class Slice:
    """A slice's bytes and anchors: each owns the windows that start at first to last (places in buf)."""

    def __init__(self, body: bytes, buckets: int):
        self.batch = pa.ipc.open_stream(body).read_next_batch()
        self.buf, self.offsets = textkit.utf8(self.batch.column(_TEXT))
        size = np.diff(self.offsets)
        room = np.maximum(size - LENGTH + 1, 0)
        ends = np.cumsum(room)
        # places of windows, in stretches whatever the texts' lengths
        parts = [self._stretch(c, min(c + STRETCH, int(ends[-1])), room, ends) for c in range(0, int(ends[-1]) if len(ends) else 0, STRETCH)]
        names = ("doc", "first", "last", "anchor", "value", "code")
        kinds = [np.int64] * 4 + [np.uint64] * 2
        for k, name in enumerate(names):
            setattr(self, name, np.concatenate([np.zeros(0, kinds[k]), *[p[k] for p in parts]]))
        self._buckets = buckets
        self._sort()

    def _stretch(self, low: int, high: int, room: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """doc, first, last, anchor, value and code of the anchors of windows low to high - 1, counted over all documents with room for one."""
        nth = np.arange(low, high)
        doc = np.searchsorted(ends, nth, side="right")
        start = self.offsets[doc] + nth - (ends[doc] - room[doc])
        a, b = int(start[0]), int(start[-1]) + LENGTH
        start -= a
        place, eights = np.arange(b - a - GRAM + 1), textkit.Bytes(self.buf[a:b]).eights.copy()
        value = textkit.mix(sum(eights[j : j + len(place)] * textkit.STEP[j // 8] for j in range(0, GRAM, 8)))
        del eights
        # the least hash of the next REACH places, of equal ones the first: 32 bits of hash before the place
        least = (value & ~np.uint64(0xFFFFFFFF)) | place.astype(np.uint64)
        width = 1
        while width < REACH:
            step = min(width, REACH - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        anchor = least.astype(np.uint32)[start].astype(np.int64)
        cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])) + 1
        lead = np.concatenate([[0], cut])
        first, last, anchor = start[lead], start[np.append(cut, len(start)) - 1], anchor[lead]
        # windows of an anchor cover less than four grams
        end, turn = last + LENGTH - GRAM, np.uint64(0x9E3779B97F4A7C15)
        code = (end - first).astype(np.uint64) + (anchor - first).astype(np.uint64) * turn
        for at in (first, first + GRAM, end - GRAM, end):
            code = textkit.mix((code ^ value[at]) * turn)
        return [doc[lead], first + a, last + a, anchor + a, value[anchor], code]

    def _sort(self) -> np.ndarray:
        """Puts anchors into the order of their buckets and values, the same whenever the slice is read."""
        self.bucket = (self.value % np.uint64(self._buckets)).astype(np.int64)
        order = np.lexsort((self.value, self.bucket))
        for name in ("doc", "first", "last", "anchor", "value", "code", "bucket"):
            setattr(self, name, getattr(self, name)[order])
        return order

    def marked(self, masks) -> np.ndarray:
        """Which anchors occur twice somewhere, by the masks of repeated_anchors(); hot ones are split first.

        Windows are equal only if their anchors have the same place in them. So those of SPLIT successive places are a
        group of their own, told by all bytes that they share: no pair of equal windows is parted.
        """
        *_, which = self.distinct()
        repeated, hot = (bits[which] if len(bits) else np.zeros(len(which), bool) for bits in (_joined(masks, "mask"), _joined(masks, "hot")))
        split = np.flatnonzero(hot)
        if not len(split):
            return repeated
        text, kept = textkit.Bytes(self.buf), np.flatnonzero(~hot)
        parts = [{name: getattr(self, name)[kept] for name in ("doc", "first", "last", "anchor", "value", "code")}]
        flags = [repeated[kept]]
        for low in range(0, REACH, SPLIT):
            high = low + SPLIT - 1
            at = split[(self.anchor[split] - self.last[split] <= high) & (self.anchor[split] - self.first[split] >= low)]
            anchor = self.anchor[at]
            first, last = np.maximum(self.first[at], anchor - high), np.minimum(self.last[at], anchor - low)
            value = textkit.mix(text.hashes(anchor - low, anchor - high + LENGTH) + textkit.STEP[low // SPLIT] ^ self.value[at])
            code = textkit.mix(text.hashes(first, last + LENGTH) + (anchor - first).astype(np.uint64))
            parts.append({"doc": self.doc[at], "first": first, "last": last, "anchor": anchor, "value": value, "code": code})
            flags.append(np.ones(len(at), bool))
        for name in parts[0]:
            setattr(self, name, np.concatenate([x[name] for x in parts]))
        return np.concatenate(flags)[self._sort()]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, values and whether they occur again, of distinct anchors; and each anchor's distinct one."""
        if not len(self.value):
            return self.bucket, self.value, np.zeros(0, bool), np.zeros(0, np.int64)
        fresh = np.concatenate([[True], self.value[1:] != self.value[:-1]])
        which = np.cumsum(fresh) - 1
        return self.bucket[fresh], self.value[fresh], np.bincount(which) > 1, which

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Documents' ids and hashes of their texts, by which documents stand in order."""
        ids = np.array([-(2**63) if k is None else k for k in self.batch.column(_KEY).to_pylist()], np.int64)
        ties = [xxhash.xxh3_64_intdigest(self.buf[a:b].tobytes()) >> 1 for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]
        return ids, np.array(ties, np.int64)

    def contexts(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Of anchors that occur twice somewhere: their indices, hashes of all bytes their windows cover, and which of
        equal ones is the first in document order; in the order (bucket, value, hash, document, place)."""
        at = np.flatnonzero(repeated)
        keys = self.keys()
        if not len(at):
            return at, np.zeros(0, np.uint64), np.zeros(0, bool), keys
        code, size = self.code[at], self.last[at] - self.first[at] + LENGTH
        rank = np.empty(len(keys[0]), np.int64)
        rank[np.lexsort((np.arange(len(keys[0])), keys[1], keys[0]))] = np.arange(len(keys[0]))
        order = np.lexsort((self.first[at], rank[self.doc[at]], code, self.value[at], self.bucket[at]))
        at, code, size = at[order], code[order], size[order]
        order, lead = _first_of_equal(self.value[at], code, size, textkit.Bytes(self.buf), self.first[at])
        return at[order], code[order], lead, keys


def _first_of_equal(value: np.ndarray, code: np.ndarray, size: np.ndarray, text: textkit.Bytes, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which contexts of equal bytes stand together, and which of them then is the first of equal ones.

    Contexts come sorted by (value, code, place). Equal hashes only say where to compare bytes; where those
    differ, contexts of the same hashes are sorted by their bytes, too.
    """
    order = np.arange(len(value))
    lead = np.concatenate([[True], (value[1:] != value[:-1]) | (code[1:] != code[:-1])])
    b = np.flatnonzero(~lead)
    if not (size[b - 1] == size[b]).all() or not text.equal(start[b - 1], start[b], size[b]).all():
        body = lambda i: text.buf[start[i] : start[i] + size[i]].tobytes()
        cuts = np.append(np.flatnonzero(lead), len(lead))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y - x > 1:
                run = sorted((body(i), i) for i in range(x, y))
                order[x:y] = [i for _, i in run]
                lead[x + 1 : y] = [p[0] != q[0] for p, q in zip(run, run[1:], strict=False)]
    return order, lead


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    if len(bucket):
        cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield int(bucket[a]), slice(int(a), int(b))


def _joined(masks, name: str) -> np.ndarray:
    """Bits of a slice's masks, in the order of their buckets."""
    parts = [np.unpackbits(np.frombuffer(m[name], np.uint8))[: m["n"]] for m in sorted(masks if masks is not None else [], key=lambda m: m["bucket"])]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def anchors_of(slices: DataFrame, buckets: int) -> DataFrame:
    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, body in zip(pdf["slice"], pdf["body"], strict=True):
                bucket, value, again, _ = Slice(body, buckets).distinct()
                rows = [(b, key, value[x].tobytes(), np.packbits(again[x]).tobytes()) for b, x in _by_bucket(bucket)]
                yield pd.DataFrame(rows, columns=["bucket", "slice", "anchors", "again"])

    return slices.mapInPandas(run, "bucket int, slice long, anchors binary, again binary")


def repeated_anchors(anchors: DataFrame) -> DataFrame:
    """(slice, bucket, n, mask, hot): which of a slice's distinct anchors occur twice or more in the corpus, and which in more than HOT_SLICES slices."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = [np.frombuffer(x, np.uint64) for x in pdf["anchors"]]
        flags = [np.unpackbits(np.frombuffer(a, np.uint8))[: len(v)].astype(bool) for a, v in zip(pdf["again"], values, strict=True)]
        known, slices = np.unique(np.concatenate(values), return_counts=True)
        often = slices > 1
        often[np.searchsorted(known, np.concatenate([v[f] for v, f in zip(values, flags, strict=True)]))] = True
        at = [np.searchsorted(known, v) for v in values]
        masks = [[np.packbits(x[i]).tobytes() for i in at] for x in (often, slices > HOT_SLICES)]
        return pd.DataFrame({"slice": pdf["slice"], "bucket": pdf["bucket"], "n": [len(v) for v in values], "mask": masks[0], "hot": masks[1]})

    return anchors.groupBy("bucket").applyInPandas(run, "slice long, bucket int, n int, mask binary, hot binary")


def contexts_of(slices: DataFrame, buckets: int) -> DataFrame:
    """(bucket, slice, n, rows, bytes) of slices with their masks: the first of equal contexts in each slice."""

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for pdf in batches:
            for key, body, masks in zip(pdf["slice"], pdf["body"], pdf["anchor_masks"], strict=True):
                s = Slice(body, buckets)
                at, code, lead, (ids, ties) = s.contexts(s.marked(masks))
                at, code = at[lead], code[lead]
                rows = []
                for b, x in _by_bucket(s.bucket[at]):
                    i = at[x]
                    doc, first, n = s.doc[i], s.first[i], s.last[i] - s.first[i] + LENGTH
                    table = np.stack([s.value[i].view(np.int64), code[x].view(np.int64), ids[doc], ties[doc], first - s.offsets[doc], s.anchor[i] - first, n])
                    text = s.buf[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    rows.append((b, key, len(i), pack(table.tobytes()), pack(text.tobytes())))
                yield pd.DataFrame(rows, columns=["bucket", "slice", "n", "rows", "bytes"])

    return slices.mapInPandas(run, "bucket int, slice long, n int, rows binary, bytes binary")


def _settle(value, code, order, shift, size, text: textkit.Bytes, start) -> np.ndarray:
    """For each context a 64-bit mask of its windows that start earlier elsewhere.

    Contexts come sorted by (value, code, order); order: the place of each context's document and start. A
    context's bytes are those of text from start on.
    """
    n = len(value)
    by, lead = _first_of_equal(value, code, size, text, start)
    value, order, shift, size, start = value[by], order[by], shift[by], size[by], start[by]
    out = np.zeros(n, np.uint64)
    windows = size - LENGTH + 1
    whole = np.where(windows >= 64, ~np.uint64(0), (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1))
    out[~lead] = whole[~lead]
    # anchors with several different contexts
    kept = np.flatnonzero(lead)
    group = np.cumsum(np.concatenate([[True], value[kept][1:] != value[kept][:-1]])) - 1
    several = np.bincount(group)[group] > 1
    kept, group = kept[several], group[several]
    ends = np.cumsum(size[kept])
    a = 0
    while a < len(kept):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SORTED_BYTES, side="right"))
        b = max(b, a + 1)
        while b < len(kept) and group[b] == group[b - 1]:
            b += 1
        part = kept[a:b]
        at = np.cumsum(size[part]) - size[part]
        joined = textkit.Bytes(text.buf[np.repeat(start[part] - at, size[part]) + np.arange(size[part].sum())])
        owner = np.full(joined.size, -1, np.int32)
        owner[np.repeat(at - (np.cumsum(windows[part]) - windows[part]), windows[part]) + np.arange(windows[part].sum())] = np.repeat(np.arange(len(part)), windows[part])
        suffixes = suffix_array(joined.buf[: joined.size])
        suffixes = suffixes[owner[suffixes] >= 0]
        own = owner[suffixes]
        # adjacent prefixes of LENGTH bytes, and the same place of the anchor in them
        place = shift[part][own] - (suffixes - at[own])
        same = place[1:] == place[:-1]
        maybe = np.flatnonzero(same)
        same[maybe] = joined.equal(suffixes[maybe], suffixes[maybe + 1], np.full(len(maybe), LENGTH))
        run = np.concatenate([[0], np.cumsum(~same)])
        when = order[part][own]
        first = np.full(run[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, run, when)
        late = when > first[run]
        np.bitwise_or.at(out, part[own[late]], np.uint64(1) << (suffixes[late] - at[own[late]]).astype(np.uint64))
        a = b
    back = np.empty(n, np.uint64)
    back[by] = out
    return back


def later_windows(contexts: DataFrame) -> DataFrame:
    """(slice, bucket, windows): for each of a slice's contexts the mask of its windows that start earlier elsewhere."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        pdf = pdf.sort_values("slice").reset_index(drop=True)
        tables = [np.frombuffer(unpack(x), np.int64).reshape(7, -1) for x in pdf["rows"]]
        value, code, ids, ties, first, shift, size = np.concatenate(tables, axis=1)
        text = textkit.Bytes(np.concatenate([np.frombuffer(unpack(x), np.uint8) for x in pdf["bytes"]]))
        start = np.cumsum(size) - size
        count = pdf["n"].to_numpy()
        # rows of equal id and text stand as they were read
        placed = np.lexsort((np.arange(len(ids)), first, np.repeat(np.arange(len(pdf)), count), ties, ids))
        order = np.empty(len(ids), np.int64)
        order[placed] = np.arange(len(ids))
        by = np.lexsort((order, code, value))
        masks = np.empty(len(ids), np.uint64)
        masks[by] = _settle(value[by], code[by].view(np.uint64), order[by], shift[by], size[by], text, start[by])
        ends = np.cumsum(count)
        out = pd.DataFrame({"slice": pdf["slice"], "bucket": pdf["bucket"], "windows": [masks[e - n : e].tobytes() for e, n in zip(ends, count, strict=True)]})
        release()
        return out

    return contexts.groupBy("bucket").applyInPandas(run, "slice long, bucket int, windows binary")


def covered(s: Slice, anchor_masks, window_masks) -> np.ndarray:
    """Which bytes of the slice windows that start earlier elsewhere cover."""
    at, _, lead, _ = s.contexts(s.marked(anchor_masks))
    starts = np.zeros(len(s.buf) + 1, np.int32)
    if len(at):
        windows = np.concatenate([np.frombuffer(m["windows"], np.uint64) for m in sorted(window_masks, key=lambda m: m["bucket"])])
        mask = np.full(len(at), ~np.uint64(0))
        mask[lead] = windows
        n = s.last[at] - s.first[at] + 1
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        on = (np.repeat(mask, n) >> nth.astype(np.uint64)) & np.uint64(1) == 1
        starts[np.repeat(s.first[at], n)[on] + nth[on]] = 1
    total = np.cumsum(starts[: len(s.buf)], dtype=np.int32)
    total[LENGTH:] -= total[:-LENGTH].copy() if len(total) > LENGTH else 0
    return total > 0


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256), or with_text these, doc, a struct of docs' other columns, and
    what is left of the text; characters cut in two go.

    Removes each byte that a string of LENGTH bytes covers which also starts earlier: in a document with a
    smaller id, or earlier in the same one. Strings are those of the input and never cross documents. Null and
    empty texts have no bytes. Rows of equal id stand by a hash of their texts and then as they are read, so
    of repeated rows the first stays; a null id stands first. An empty table gives no rows.
    """
    spark = docs.sparkSession
    key = [F.col(id_col).cast("long").alias(_KEY), F.coalesce(F.col(text_col), F.lit("")).alias(_TEXT)]
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc")] if with_text else []
    source = docs.select(*key, *whole)
    slices = scratch.save(make_slices(source), "slices")
    total = source.agg(F.sum(F.octet_length(_TEXT))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

    def masks(df: DataFrame, name: str, *columns: str) -> DataFrame:
        """A slice's masks as one list: one entry a bucket."""
        return df.groupBy("slice").agg(F.collect_list(F.struct("bucket", *columns)).alias(name))

    repeated = scratch.save(repeated_anchors(anchors_of(slices, buckets)), "repeated")
    marked = slices.join(masks(repeated, "anchor_masks", "n", "mask", "hot"), "slice", "left")
    windows = scratch.save(later_windows(contexts_of(marked, buckets)), "windows")
    marked = marked.join(masks(windows, "window_masks", "windows"), "slice", "left")

    fields = [T.StructField(_KEY, T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    if with_text:
        fields += [T.StructField("doc", source.schema["doc"].dataType), T.StructField("left", T.StringType())]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, a, w in zip(batch.column("body"), batch.column("anchor_masks"), batch.column("window_masks"), strict=True):
                s = Slice(body.as_py(), buckets)
                gone = covered(s, a.as_py(), w.as_py())
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                starts = s.offsets[:-1][np.diff(s.offsets) > 0]
                edge[starts] = gone[starts]
                count = lambda x: pa.array([int(np.count_nonzero(x[i:j])) for i, j in zip(s.offsets[:-1], s.offsets[1:], strict=True)], pa.int64())  # noqa: B023, E731
                kept = [s.buf[i:j][~gone[i:j]].tobytes() for i, j in zip(s.offsets[:-1], s.offsets[1:], strict=True)]
                columns = [s.batch.column(_KEY), pa.array(np.diff(s.offsets)), count(gone), count(edge), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                if with_text:
                    columns += [s.batch.column("doc"), pa.array([k.decode(errors="ignore") for k in kept], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return marked.select("body", "anchor_masks", "window_masks").mapInArrow(run, T.StructType(fields))


def digest(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256): see remove_repeats()."""
    return remove_repeats(docs, scratch, id_col, text_col).withColumnRenamed(_KEY, id_col)


def without_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with what is left of their texts, and length_col, if there, made to fit."""
    rows = remove_repeats(docs, scratch, id_col, text_col, with_text=True)
    column = lambda c: F.col("left") if c == text_col else F.length("left").cast(docs.schema[c].dataType) if c == length_col else F.col(f"doc.`{c}`")
    return rows.select(*[column(c).alias(c) for c in docs.columns])
