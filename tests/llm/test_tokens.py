"""Operators 2, 4 and 8."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import documents, empty, odd_texts
from tetraspark.llm import bpe, hftok, packing, ranges, tokenfiles
from tetraspark.llm.scratch import Scratch

RANKS, BYTES, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


texts = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tabcdeinorst'#é1")), max_size=60)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_prefix_encoding_is_the_librarys(reference, text):
    c = bpe.codec(RANKS, P.PATTERN)
    ids = c.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text)
    assert c.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.binary(max_size=10), st.integers(0, 30), st.integers(0, 10))
def test_appends_and_edits_equal_encoding_anew(data, more, start, length):
    v = bpe.codec(RANKS, P.PATTERN).vocabulary
    table = bpe.PrefixTable(v, data)
    table.append(more)
    assert table.ids() == bpe.PrefixTable(v, data + more).ids()
    start = min(start, len(data))
    table = bpe.PrefixTable(v, data)
    table.replace(start, min(start + length, len(data)), more)
    assert table.ids() == bpe.PrefixTable(v, data[:start] + more + data[start + length :]).ids()


def test_prefixes_hold_valid_last_tokens():
    v = bpe.codec(RANKS, P.PATTERN).vocabulary
    data = b"unbelievably"
    table = bpe.PrefixTable(v, data)
    for n in range(1, len(data) + 1):
        assert table.last[n - 1] == v.merged(data[:n], len(v.tokens))[-1]


def test_remembered_values_survive_the_bound():
    made = []
    memory = bpe.Remembered(lambda k: made.append(k) or k * 2, 100_000)
    for _ in range(3):
        assert [memory[k] for k in range(2000)] == [k * 2 for k in range(2000)]
        assert memory[5] == 10 and len(memory) + len(memory._old) < 2 * 100_000 / 150
    kept = len(made)
    assert memory[5] == 10 and len(made) == kept
    assert memory["x" * 10_000] == "x" * 20_000 and "x" * 10_000 not in memory


def test_byte_bpe_of_a_table(spark, reference):
    cases = odd_texts()
    found = {r["doc_id"]: r for r in bpe.round_trip(documents(spark, cases), RANKS, P.PATTERN).collect()}
    for k, t in enumerate(cases):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        assert found[k]["n_tokens"] == len(ids) and found[k]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert found[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(documents(spark, cases), RANKS, P.PATTERN)
    assert {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(encoded, RANKS, P.PATTERN).collect()} == {k: (t or "").encode() for k, t in enumerate(cases)}
    assert bpe.round_trip(empty(spark), RANKS, P.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(texts)
def test_chunks_encode_as_whole_texts(text):
    for path, words in ((BYTES, False), (WORDS, True)):
        assert hftok.chunk_encoder(path, words).encode(text).tolist() == whole(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("a'sdtmrevl 12 \n\t!\xa0éÉ²"), max_size=14), max_size=5))
def test_pretokens_on_arrays_are_the_expressions(many):
    for words, pattern in ((False, bpe.LATIN_PRETOKENS), (True, hftok.LATIN_WORDS)):
        data = [(t.lower() if words else t).encode("latin-1") for t in many]
        joined, offsets = b"".join(data), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        start, end, first = hftok.pretokens(np.frombuffer(joined, np.uint8), offsets, words)
        for k, d in enumerate(data):
            assert [joined[a:b] for a, b in zip(start[first[k] : first[k + 1]], end[first[k] : first[k + 1]])] == [m.encode("latin-1") for m in pattern.findall(d.decode("latin-1"))]


def test_texts_encode_together_as_alone(monkeypatch):
    monkeypatch.setattr(hftok, "SLICE_BYTES", 40)
    many = [t or "" for t in odd_texts()] * 3
    for path, words in ((BYTES, False), (WORDS, True)):
        assert [x.tolist() for x in hftok.chunk_encoder(path, words).encode_all(many)] == [whole(path).encode(t, add_special_tokens=False).ids for t in many]


_whole = {}


def whole(path):
    return _whole.setdefault(path, Tokenizer.from_file(path)) if path not in _whole else _whole[path]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=80), min_size=1, max_size=8), st.randoms(use_true_random=False))
def test_payload_round_trip_and_random_access(documents_, rnd):
    arrays = [np.array(d * 10, "<u4") for d in documents_]
    for base in (50_257, 60_000):
        shard = tokenfiles.ShardReader(tokenfiles.write_payload(list(range(len(arrays))), arrays, base))
        assert (shard.all_ids() == np.concatenate(arrays)).all()
        for i, d in enumerate(arrays):
            a, b = sorted(rnd.choices(range(len(d) + 1), k=2))
            assert shard.document(i, a, b).tolist() == d[a:b].tolist() and shard.document(i).tolist() == d.tolist()


def test_repeats_become_rules():
    ids = np.array([1, 2, 3, 4] * 500, "<u4")
    symbols, starts, pairs, lengths = tokenfiles.compress(ids, np.array([0, len(ids)]), 10)
    assert len(symbols) < len(ids) / 3 and lengths.max() >= 4 and len(pairs) == len(lengths) and starts.tolist() == [0, len(symbols)]
    with pytest.raises(ValueError):
        tokenfiles.ShardReader(b"something else" * 10)


def test_no_frequent_pair_is_left():
    rnd = np.random.default_rng(3)
    copy = rnd.integers(0, 50_000, 700)
    documents_ = [copy if k % 3 == 0 else rnd.zipf(1.3, 400) % 50_000 for k in range(90)] + [np.array([], int), np.full(1000, 7)]
    documents_ += [rnd.integers(0, 5, 20_000)]
    ids, first = np.concatenate(documents_), np.cumsum([0, *map(len, documents_)])
    symbols, starts, pairs, lengths = tokenfiles.compress(ids, first, 50_257)
    left = Counter()
    for a, b in zip(starts[:-1], starts[1:]):
        left.update(zip(symbols[a : b - 1].tolist(), symbols[a + 1 : b].tolist()))
    assert max(left.values()) < tokenfiles.LEAST_COUNT and lengths.max() >= 512
    shard = tokenfiles.ShardReader(tokenfiles.write_payload(list(range(len(documents_))), documents_, 50_257))
    assert (shard.lengths == lengths).all() and (shard.all_ids() == ids).all()
    assert shard.document(3, 100, 650).tolist() == copy[100:650].tolist()
    # more rules than 16 bits hold
    shard = tokenfiles.ShardReader(tokenfiles.write_payload([0], [documents_[-1]], (1 << 16) - 3))
    assert len(shard.pairs) > 3 and (shard.all_ids() == documents_[-1]).all()


@pytest.mark.parametrize("shard_ids", [5, 1 << 20])
def test_shards_of_a_table(spark, monkeypatch, shard_ids):
    monkeypatch.setattr(tokenfiles, "SHARD_IDS", shard_ids)
    cases = odd_texts()
    shards = tokenfiles.write_shards(documents(spark, cases), BYTES, 50_257, 2, Scratch(spark, "t"))
    found = {r["doc_id"]: r for r in tokenfiles.read_documents(shards, with_ids=True).collect()}
    start = 0
    for k, t in enumerate(cases):
        ids = np.array([*whole(BYTES).encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        r = found[k]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)
    none = tokenfiles.write_shards(empty(spark), BYTES, 50_257, 2, Scratch(spark, "t"))
    assert tokenfiles.read_documents(none).count() == 0


def naive_best_fit(lengths, window):
    """Windows' used lengths by the textbook algorithm."""
    open_ = []
    for n in sorted(lengths, reverse=True):
        fits = [w for w in open_ if window - w[0] >= n]
        if fits:
            max(fits, key=lambda w: w[0])[0] += n
        else:
            open_.append([n])
    return sorted(w[0] for w in open_)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan, used = packing.best_fit(counts, 16), {}
    for p in plan.itertuples():
        for r in range(p.n):
            w = p.sequence + r // p.each
            assert used.get(w, 0) == p.offset + r % p.each * p.length
            used[w] = used.get(w, 0) + p.length
    assert sorted(used.values()) == naive_best_fit(lengths, 16) and set(used) == set(range(len(used)))
    assert plan.groupby("length")["n"].sum().to_dict() == counts


def test_packing_of_a_table(spark):
    rnd = random.Random(5)
    cases = odd_texts() + [" ".join(rnd.choice(["the", "cat", "sat", "blue"]) for _ in range(rnd.randint(1, 90))) for _ in range(60)]
    found = packing.pack(documents(spark, cases), WORDS, 1, Scratch(spark, "t"), window=32, with_ids=True).toPandas()
    for k, t in enumerate(cases):
        own = found[found["doc_id"] == k].sort_values("start")
        ids = [*whole(WORDS).encode(t or "", add_special_tokens=False).ids, 1]
        assert [i for p in own["ids"] for i in p] == ids and (own["doc_tokens"] == len(ids)).all()
        assert (own["start"] == own["length"].cumsum() - own["length"]).all()
        assert [zlib.crc32(np.array(p, "<u4").tobytes()) for p in own["ids"]] == own["ids_crc32"].tolist()
    in_order = found.sort_values(["sequence_id", "offset"])
    grouped = in_order.groupby("sequence_id")["length"]
    assert (in_order["offset"] == grouped.cumsum() - in_order["length"]).all() and grouped.sum().max() <= 32
    assert set(found["sequence_id"]) == set(range(found["sequence_id"].nunique()))
    assert grouped.sum().sum() >= 0.97 * 32 * found["sequence_id"].nunique()
    assert packing.pack(empty(spark), WORDS, 1, Scratch(spark, "t")).count() == 0


def awkward(spark):
    """Null and repeated ids, repeated rows, and columns whose names the operators use themselves."""
    rows = [(None, "a null id", 1, "x"), (5, "one text", 2, "x"), (5, "another text", 3, "x"), (5, "one text", 2, "x"), (-7, None, None, None), (9, "", 4, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, part long, key string").withColumn("ids", F.lit(0)).withColumn("length", F.lit(1)).withColumn("payload", F.lit("p"))


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


def test_tokens_of_awkward_tables(spark, reference):
    docs = awkward(spark)
    texts_ = by_id([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    n = [(i, len(reference.encode_ordinary(t))) for i, t in texts_]
    assert by_id([(r["doc_id"], r["n_tokens"]) for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect()]) == by_id(n)
    shards = tokenfiles.write_shards(docs, BYTES, 50_257, 2, Scratch(spark, "t"))
    found = sorted(tokenfiles.read_documents(shards, with_ids=True).collect(), key=lambda r: r["start"])
    ids = [(i, [*whole(BYTES).encode(t, add_special_tokens=False).ids, 2]) for i, t in texts_]
    assert [(r["doc_id"], r["ids"]) for r in found] == ids and [r["start"] for r in found] == [sum(len(x) for _, x in ids[:k]) for k in range(len(ids))]
    packed = packing.pack(docs, WORDS, 1, Scratch(spark, "t"), window=4).collect()
    wanted = [(i, len(whole(WORDS).encode(t, add_special_tokens=False).ids) + 1) for i, t in texts_]
    assert by_id([(r["doc_id"], r["doc_tokens"]) for r in packed if r["start"] == 0]) == by_id(wanted) and sum(r["length"] for r in packed) == sum(x for _, x in wanted)


def test_shards_of_many_ranges(spark):
    """Keys of any sign and distance are cut into ranges in their order, however they are dealt out."""
    keys = [-(2**62), -5, -4, 0, *range(10, 400, 3), 2**61, 2**62]
    docs = spark.createDataFrame([(k, f"text {k}") for k in keys], "doc_id long, text string").repartition(5)
    found = ranges.with_range(docs.withColumnRenamed("doc_id", "key")).collect()
    in_order = [r["part"] for r in sorted(found, key=lambda r: r["key"])]
    assert in_order == sorted(in_order) and len(set(in_order)) > 4
    shards = tokenfiles.write_shards(docs, BYTES, 50_257, 2, Scratch(spark, "t"))
    assert [r["doc_id"] for r in sorted(tokenfiles.read_documents(shards).collect(), key=lambda r: r["start"])] == keys
