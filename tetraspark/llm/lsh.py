"""Classes of near-equal documents from banded signatures, with every link confirmed on the documents' words.

Documents with equal word sequences (by a 128-bit digest) are one node. Nodes that share a band's value are candidates. Each node is first
compared with its home: the most popular node it shares a band with, which for a family of copies is the one
all were made from. That star has one edge a node however large the family is. What the star leaves apart is
then settled exactly: nodes that failed at their home against all others of that home, and nodes of one band
value that have different homes against each other. Both go in blocks of bounded size; of a block's links at a
home only a spanning forest leaves it. Band values and homes that hold many rows are dealt to many tasks (skew).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .memory import tidy
from .scratch import Scratch
from .skew import hot_of, spread_join

Signer = Callable[[np.ndarray], np.ndarray]
#: Shingles of a block's members, and of its strays.
BLOCK_SHINGLES = 25_000
#: Tasks that the rows of one home or band value are dealt to before their blocks are known.
SALTS = 32


def _texts(texts: pa.Array) -> Iterator[tuple[textkit.Words, int]]:
    """Words of the texts, slice by slice, and how many texts that is."""
    buf, offsets = textkit.utf8(texts)
    for a, b in textkit.slices(offsets):
        yield textkit.Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), b - a


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for words, n in _texts(texts):
        hashes, bounds = words.shingles(k)
        yield from (textkit.distinct(hashes[bounds[i] : bounds[i + 1]]) for i in range(n))


def _digest(sequence: bytes) -> tuple[int, int]:
    """128 bits of a word sequence."""
    a, b = np.frombuffer(hashlib.blake2b(sequence, digest_size=16).digest(), "<i8").tolist()
    return a, b


def band_values(signature: np.ndarray, rows: int) -> np.ndarray:
    """One value a band, different between bands."""
    bands = signature.astype(np.uint64).reshape(-1, rows)
    with np.errstate(over="ignore"):
        mixed = textkit.mix(bands * textkit.STEP[:rows] + textkit.STEP[8 : 8 + rows]).sum(axis=1, dtype=np.uint64)
        return textkit.signed(textkit.mix(mixed + np.arange(len(bands), dtype=np.uint64) * textkit.STEP[60]))


def features(docs: DataFrame, k: int, signer: Signer, rows: int) -> DataFrame:
    """(key, n, lo, hi, bands): size of the set, digest of the words, band values; an empty set has none. docs: (key, text)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, bands = [], [], []
            for words, texts in _texts(batch.column("text")):
                hashes, bounds = words.shingles(k)
                body, at = words.sequences()
                for i in range(texts):
                    own = textkit.distinct(hashes[bounds[i] : bounds[i + 1]])
                    n.append(len(own))
                    digests.append(_digest(body[at[i] : at[i + 1]].data))
                    bands.append(band_values(signer(own), rows) if len(own) else np.zeros(0, np.int64))
            columns = [batch.column("key"), pa.array(n, pa.int64()), *[pa.array([d[j] for d in digests], pa.int64()) for j in (0, 1)]]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32))
            columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *bands]), pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "lo", "hi", "bands"])

    return docs.mapInArrow(run, "key long, n long, lo long, hi long, bands array<long>")


def sequences(docs: DataFrame) -> DataFrame:
    """(key, lo, hi, words binary): texts in lower case with one space between words, and their digests."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words, texts in _texts(batch.column("text")):
                body, at = words.sequences()
                out += [body[at[i] : at[i + 1]].tobytes() for i in range(texts)]
            digests = [_digest(x) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array([d[j] for d in digests], pa.int64()) for j in (0, 1)], pa.array(out, pa.binary())], ["key", "lo", "hi", "words"])

    return docs.mapInArrow(run, "key long, lo long, hi long, words binary")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |intersection| >= percent * |union| for sorted distinct arrays."""
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _alike_texts(x: list[bytes], y: list[bytes], k: int, percent: int) -> Iterator[bool]:
    """For each x[i] and y[i] whether they are linked, by their words; in stretches of bounded size, each text of which is read once."""
    a = 0
    while a < len(x):
        seen: dict[bytes, int] = {}
        size, b = 0, a
        while b < len(x) and (b == a or size < textkit.SLICE_BYTES):
            for text in (x[b], y[b]):
                if seen.setdefault(text, len(seen)) == len(seen) - 1:
                    size += len(text)
            b += 1
        sets = textkit.exact_sets(list(seen), k)
        yield from (alike(sets[seen[p]], sets[seen[q]], percent) for p, q in zip(x[a:b], y[a:b], strict=True))
        a = b


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(u, v, ok) for written pairs (u, v), v being the popular side."""
    a, b = texts.select(F.col("key").alias("u"), F.col("words").alias("x")), texts.select(F.col("key").alias("v"), F.col("words").alias("y"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = list(_alike_texts(batch.column("x").to_pylist(), batch.column("y").to_pylist(), k, percent))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(ok, pa.bool_())], ["u", "v", "ok"])

    both = spread_join(pairs.select("u", "v"), b, "v", "u").join(a, "u")
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long, ok boolean")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the least node reachable over edges (u, v), for nodes that have an edge.

    Each round takes the least label among neighbours, then the label's own label; long chains halve.
    """
    both = scratch.save(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    labels, turn = scratch.save(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), f"{name}-0"), 0
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("v"), "component"), "v", "u").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("higher"))
        new = spread_join(scratch.save(step, f"{name}-step{turn}"), up, "component", "node", "left").select("node", "old", F.least("component", "higher").alias("component"))
        new, turn = scratch.save(new, f"{name}-{turn + 1}"), turn + 1
        scratch.drop(f"{name}-{turn - 1}", f"{name}-step{turn - 1}")
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def _blocks(members: DataFrame, strays: DataFrame, group: str, weight: str, limit: int) -> DataFrame:
    """Every stray of a group meets every member of it in one (group, i, j) block.

    Blocks are cut by weight, so a group of any size is spread over tasks. role 1: stray.
    """
    count = lambda df, name: df.groupBy(group).agg(F.ceil(F.sum(weight) / F.lit(limit)).cast("int").alias(name))
    sizes = count(members, "ni").join(count(strays, "nj"), group).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def spread(df: DataFrame, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        salted = df.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(group)), F.lit(SALTS)).cast("int")).join(sizes, [group, "salt"])
        placed = salted.withColumn(own, F.pmod(F.xxhash64("key"), F.col(n_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop("ni", "nj", "salt")

    m = spread(members, "i", "j", "ni", "nj").withColumn("role", F.lit(0))
    s = spread(strays, "j", "i", "nj", "ni").withColumn("role", F.lit(1))
    # by group alone, all blocks of a group would stay together
    return m.unionByName(s.select(*m.columns)).repartition(group, "i", "j")


class Forest:
    """Union-find over any keys."""

    def __init__(self) -> None:
        self._up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self._up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart; then they aren't any more."""
        a, b = self.root(a), self.root(b)
        self._up[max(a, b)] = min(a, b)
        return a != b


def _links(pdf: pd.DataFrame, k: int, percent: int, across: bool) -> pd.DataFrame:
    """A spanning forest of the links between a block's strays and its members, by an inverted index over the members' shingles.

    across: links between nodes of different homes and components, as far as these aren't joined already.
    """
    members, strays = pdf[pdf["role"] == 0], pdf[pdf["role"] == 1]
    out: list[tuple[int, int]] = []
    if len(members) and len(strays):
        seen: dict[bytes, int] = {}
        places = [[seen.setdefault(x, len(seen)) for x in side["words"]] for side in (members, strays)]
        sets = textkit.exact_sets(list(seen), k)
        arrays = [sets[i] for i in places[0]]
        sizes, keys, homes, parts = np.array([len(x) for x in arrays]), *(members[c].to_numpy() for c in ("key", "home", "part"))
        flat, owner = np.concatenate(arrays), np.repeat(np.arange(len(arrays)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        forest = Forest()
        for key, home, part, place in zip(strays["key"], strays["home"], strays["part"], places[1], strict=True):
            own = sets[place]
            a, b = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            n = b - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            common = np.bincount(owner[at], minlength=len(keys))
            ok = (100 * common >= percent * (len(own) + sizes - common)) & (keys != key)
            if across:
                ok &= (homes != home) & (parts != part)
            out += [(key, int(keys[i])) for i in np.flatnonzero(ok) if forest.join(int(part), int(parts[i]))]
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def classes(docs: DataFrame, scratch: Scratch, k: int, percent: int, signer: Signer, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n, component) for each row of docs, as the module says.

    component: the least id that links reach, the row's own included. Null and empty texts have n 0 and are
    linked with nothing. Rows with equal ids are one document: their components are one. A row with a null id
    has a null component. An empty table gives no rows. A text of any length is read whole, within one task's
    memory. Other columns are left out, whatever their names.
    """
    source = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    feats = scratch.save(features(source, k, signer, rows), "features")
    usable = feats.filter("n > 0 and key is not null")
    equal = usable.groupBy("lo", "hi", "n").agg(F.min("key").alias("rep"), F.first("bands").alias("bands"))
    nodes = scratch.save(equal, "nodes")
    bucketed = nodes.select("rep", "n", F.explode("bands").alias("bucket"))
    crowded = scratch.save(bucketed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "crowded")
    hot = hot_of(crowded, "bucket", "size")
    rows_m = scratch.save(spread_join(bucketed, crowded, "bucket", "rep", hot=hot), "buckets")
    popular = rows_m.groupBy("rep").agg(F.sum("size").alias("popularity"))
    rows_p = rows_m.select("bucket", "rep").join(popular, "rep")
    best = rows_p.groupBy("bucket").agg(F.max(F.struct("popularity", (-F.col("rep")).alias("least"))).alias("best"))
    home = spread_join(rows_m.select("bucket", "rep", "n"), best, "bucket", "rep", hot=hot).groupBy("rep").agg((-F.max("best")["least"]).alias("home"), F.max("n").alias("n"))
    home = scratch.save(home, "homes")
    found = source.join(home.select(F.col("rep").alias("key")).distinct(), "key", "left_semi")
    texts = sequences(found).join(nodes.select(F.col("rep").alias("key"), "lo", "hi"), ["key", "lo", "hi"], "left_semi").dropDuplicates(["key", "lo", "hi"])
    texts = scratch.save(texts.select("key", "words"), "texts")
    star = scratch.save(verified(home.filter("rep <> home").select(F.col("rep").alias("u"), F.col("home").alias("v")), texts, k, percent), "star")
    near = star.filter("ok").select("u", "v")

    # nodes that failed at their home, against all others of it
    member = home.select(F.col("rep").alias("key"), "home", "n").join(texts, "key")
    stray = star.filter("not ok").select(F.col("u").alias("key"), F.col("v").alias("home")).distinct().join(home.select(F.col("rep").alias("key"), "n"), "key").join(texts, "key")
    own = F.col("key").alias("part")
    blocks = _blocks(member.withColumn("part", own), stray.withColumn("part", own), "home", "n", BLOCK_SHINGLES)
    at_home = blocks.groupBy("home", "i", "j").applyInPandas(lambda pdf: _links(pdf, k, percent, False), "u long, v long")
    # rows of one id with different texts are one document
    torn = usable.groupBy("key").agg(F.min(F.struct("lo", "hi", "n")).alias("a"), F.max(F.struct("lo", "hi", "n")).alias("b")).filter("a <> b").select("key")
    parts = usable.select("key", "lo", "hi", "n").join(torn, "key").join(nodes.select("lo", "hi", "n", "rep"), ["lo", "hi", "n"]).select("key", "rep").distinct()
    tied = parts.join(parts.groupBy("key").agg(F.min("rep").alias("u")), "key").filter("u <> rep").select("u", F.col("rep").alias("v"))
    near = scratch.save(near.unionByName(at_home).unionByName(tied).distinct(), "links")
    found = components(near, scratch, "first")

    # nodes of one band value with different homes and components, against each other
    placed = rows_m.select("bucket", F.col("rep").alias("key"), "n").join(home.select(F.col("rep").alias("key"), "home"), "key").join(found.withColumnRenamed("node", "key"), "key", "left")
    placed = placed.withColumn("part", F.coalesce("component", "key")).drop("component")
    mixed = placed.groupBy("bucket").agg(F.min("home").alias("a"), F.max("home").alias("b"), F.min("part").alias("c"), F.max("part").alias("d")).filter("a <> b and c <> d").select("bucket")
    open_rows = scratch.save(spread_join(placed, mixed, "bucket", "key", hot=hot), "open")
    main = open_rows.groupBy("bucket", "home").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "home"))["home"].alias("main"))
    shown = open_rows.join(texts, "key")
    other = spread_join(open_rows, main, "bucket", "key", hot=hot).filter("home <> main").drop("main").join(texts, "key")
    late = _blocks(shown, other, "bucket", "n", BLOCK_SHINGLES).groupBy("bucket", "i", "j").applyInPandas(lambda pdf: _links(pdf, k, percent, True), "u long, v long")
    late = scratch.save(late.distinct(), "late")
    if not late.isEmpty():
        found = components(near.unionByName(late), scratch, "last")
    scratch.drop("crowded", "buckets", "homes", "texts", "star", "links", "open", "late", "first-edges", "last-edges")

    of_set = nodes.select("lo", "hi", "n", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("lo", "hi", "n", F.coalesce("component", "rep").alias("component"))
    out = feats.select("key", "n", "lo", "hi").join(of_set, ["lo", "hi", "n"], "left")
    return out.select("key", "n", F.when(F.col("key").isNotNull() & (F.col("n") > 0), F.coalesce("component", "key")).otherwise(F.col("key")).alias("component"))
