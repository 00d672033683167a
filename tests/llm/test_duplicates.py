"""Operators 1, 6 and 9."""

import hashlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.helpers import components, documents, empty, odd_texts, shingles
from tetraspark.llm import fingerprints, lsh, neardup, skew, suffixdup, textkit
from tetraspark.llm.scratch import Scratch


def families(seed=1, n=14, copies=9):
    """Texts, with copies of some that differ more and more."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    out = []
    for _ in range(n):
        base = [word() for _ in range(rnd.randint(3, 160))]
        out.append(" ".join(base))
        for c in range(rnd.randint(0, copies)):
            edited = [word() if rnd.random() < 0.004 * c else w for w in base]
            out.append(" ".join(edited).title() if rnd.random() < 0.3 else " ".join(edited))
    rnd.shuffle(out)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aBé \n\t\x0b"), max_size=30)), max_size=8), st.integers(1, 5))
def test_shingle_hashes_count_like_shingles(texts, k):
    found = list(lsh.sets_of(pa.array(texts, pa.string()), k))
    assert [len(f) for f in found] == [len(shingles(t, k)) for t in texts]
    for a, x in zip(texts, found, strict=True):
        for b, y in zip(texts, found, strict=True):
            assert len(np.intersect1d(x, y)) == len(shingles(a, k) & shingles(b, k))


def test_slices_cover_all_rows():
    _, offsets = textkit.utf8(pa.array(["a" * n for n in (5, 0, 50, 3, 3, 3, 0)]))
    assert [x for a, b in textkit.slices(offsets, 8) for x in range(a, b)] == list(range(7))


@pytest.mark.parametrize("size", [1, 2, 5, 40, 2000])
def test_one_permutation_agrees_as_often_as_sets_are_alike(size):
    """Densified signatures estimate the likeness of small sets too."""
    rng, hits = np.random.Generator(np.random.PCG64(1)), []
    for _ in range(60):
        draw = lambda n: rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64)
        both = draw(size)
        own = [np.sort(np.concatenate([both, draw(-(-size // 4))])) for _ in range(2)]
        hits.append((neardup.one_permutation(own[0]) == neardup.one_permutation(own[1])).mean())
    wanted = size / (size + 2 * -(-size // 4))
    assert np.mean(hits) == pytest.approx(wanted, abs=0.07)


@pytest.mark.parametrize("operator, words", [(neardup.near_duplicates, 4), (neardup.near_duplicates, 5), (fingerprints.near_duplicates, 5)])
def test_classes_equal_brute_force(spark, operator, words):
    texts = odd_texts() + families()
    found = {r[0]: r for r in operator(documents(spark, texts), Scratch(spark, "t"), words=words).collect()}
    assert [found[k][1] for k in range(len(texts))] == [len(shingles(t, words)) for t in texts]
    assert [found[k][2] for k in range(len(texts))] == components(texts, words)


def test_blocks_find_what_the_star_misses(spark, monkeypatch):
    """With blocks of a few rows every pair is still met."""
    monkeypatch.setattr(lsh, "BLOCK_SHINGLES", 300)
    texts = families(7, 5, 40)
    found = {r[0]: r[2] for r in neardup.near_duplicates(documents(spark, texts), Scratch(spark, "t"), words=3).collect()}
    assert [found[k] for k in range(len(texts))] == components(texts, 3)


def test_different_words_are_never_equal():
    """Neither strings that agree under polynomial hashes, nor words whose hashes are made to agree."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    x, y = textkit.exact_sets([a.encode(), b.encode()], 4)
    assert len(np.intersect1d(x, y)) == 0 and not np.intersect1d(*lsh.sets_of(pa.array([a, b]), 4)).size
    words = textkit.Words(np.frombuffer(b"one two three one tw", np.uint8), np.array([0, 20]), False)
    words.bytes.hashes = lambda start, end: np.zeros(len(start), np.uint64)
    assert words.bytes.names(words.start, words.end).tolist() == [1, 2, 3, 1, 4]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é"), max_size=400), min_size=1, max_size=6), st.integers(1, 6))
def test_exact_sets_are_shingles(texts, k):
    found = textkit.exact_sets([x.tobytes() for w, n in lsh._texts(pa.array(texts)) for b, at in [w.sequences()] for x in np.split(b, at[1:-1])], k)
    for a, x in zip(texts, found, strict=True):
        for b, y in zip(texts, found, strict=True):
            assert len(np.intersect1d(x, y)) == len(shingles(a, k) & shingles(b, k)) and len(x) == len(shingles(a, k))


def test_documents_of_one_word_are_told_apart(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    found = neardup.near_duplicates(documents(spark, [a, b, a.upper()]), Scratch(spark, "t"), words=4).collect()
    assert {r["doc_id"]: (r["component_id"], r["kept"]) for r in found} == {0: (0, True), 1: (1, True), 2: (0, False)}


def test_a_block_of_copies_has_a_forest_of_links():
    """2,000 near copies that all failed at their home."""
    rnd = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base, f"x{rnd.randrange(10**6)}"]).encode() for _ in range(2000)]
    rows = [{"key": k, "home": 0, "part": k, "words": t, "role": role} for k, t in enumerate(texts) for role in (0, 1)]
    found = lsh._links(pd.DataFrame(rows), 5, 80, False)
    assert len(found) == 1999 and set(found["u"]) | set(found["v"]) == set(range(2000))
    apart = pd.DataFrame(rows).assign(part=lambda x: x["key"] % 2, home=lambda x: x["key"])
    assert len(lsh._links(apart, 5, 80, True)) == 1


def test_hot_keys_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 10)
    monkeypatch.setattr(skew, "SHARE", 20)
    rows = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(600)], "k long, v long")
    other = spark.createDataFrame([(k, -k) for k in range(300)], "k long, w long")
    hot = skew.hot_keys(rows, "k")
    assert hot == [(1, 14)] and skew.hot_of(rows.groupBy("k").agg(F.count("*").alias("n")), "k") == hot
    for how in ("inner", "left"):
        wanted = sorted(map(tuple, rows.join(other, "k", how).collect()), key=str)
        assert sorted(map(tuple, skew.spread_join(rows, other, "k", "v", how).collect()), key=str) == wanted
    assert skew.spread_join(rows.limit(0), other, "k", "v").count() == 0


def test_classes_with_hot_keys_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(skew, "LEAST", 3)
    texts = families(11, 4, 60)
    found = {r[0]: r[2] for r in neardup.near_duplicates(documents(spark, texts), Scratch(spark, "t"), words=3).collect()}
    assert [found[k] for k in range(len(texts))] == components(texts, 3)


def test_components_follow_chains(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (205, 203), (203, 207)]
    found = dict(map(tuple, lsh.components(spark.createDataFrame(chain, "u long, v long"), Scratch(spark, "t"), "c").collect()))
    assert all(found[k] == 0 for k in range(41)) and found[101] == 100 and found[205] == found[207] == 203


def test_near_duplicates_of_awkward_tables(spark):
    assert neardup.near_duplicates(empty(spark), Scratch(spark, "t")).count() == 0
    t = "a b c d e f g h"
    rows = spark.createDataFrame([(None, t, 1), (5, t, 2), (5, t, 3), (3, t, 4), (9, None, 5)], "doc_id long, text string, component long")
    found = sorted(map(tuple, neardup.near_duplicates(rows, Scratch(spark, "t")).collect()), key=repr)
    assert found == [(3, 4, 3, True), (5, 4, 3, False), (5, 4, 3, False), (9, 0, 9, True), (None, 4, None, True)]
    other = spark.createDataFrame([(1, t), (5, t), (5, "p q r s t u v"), (7, "p q r s t u v"), (7, None)], "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(other, Scratch(spark, "t")).select("doc_id", "component_id").collect())) == [(1, 1), (5, 1), (5, 1), (7, 1), (7, 7)]
    kept = neardup.drop_near_duplicates(rows, Scratch(spark, "t"))
    assert kept.columns == rows.columns and sorted(r["component"] for r in kept.collect()) == [1, 4, 5]


def test_fingerprints_of_a_table(spark):
    texts = odd_texts() + families(3, 6, 4)
    found = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(documents(spark, texts, 10)).collect()}
    assert len(found) == len(texts)
    texts = [t or "" for t in texts]
    for k, t in enumerate(texts):
        after, r = texts[(k + 1) % len(texts)], found[10 + k]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r["near_edited"], edited), (r["near_next"], after)):
            a, b = shingles(t, 5), shingles(other, 5)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.15)
    by_text = {}
    for k, t in enumerate(texts):
        assert by_text.setdefault(t, found[10 + k]["fingerprint"]) == found[10 + k]["fingerprint"]


def test_fingerprints_of_awkward_tables(spark):
    assert fingerprints.edited_fingerprints(empty(spark)).count() == 0
    sole = fingerprints.edited_fingerprints(documents(spark, ["alone here"])).collect()
    assert len(sole) == 1 and sole[0]["near_next"] == 1.0
    rows = spark.createDataFrame([(None, "x y"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["n_chars"]) for r in fingerprints.edited_fingerprints(rows).collect()) == [(False, 0), (False, 3), (False, 3), (True, 3)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=70), st.integers(1, 3))
def test_suffix_array(values, scale):
    s = np.array(values, np.int64) * scale
    assert suffixdup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def brute_removed(texts):
    """Marks of removed bytes, texts in order."""
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        out.append((b, gone))
    return out


def passages(seed, n=40):
    """Texts that share passages of around 100 bytes, some periodic."""
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(60, 240))) for _ in range(6)] + ["ab" * 130, "x" * 250]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(pool)
            a = rnd.randint(0, 40)
            parts += ["".join(rnd.choice("abcdefgh \n") for _ in range(rnd.randint(0, 30))), p[a : len(p) - rnd.randint(0, 30)]]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("seed, buckets_bytes, slice_bytes, sorted_bytes, hot", [(1, 1 << 25, 1 << 21, 1 << 20, 64), (2, 200, 300, 400, 64), (3, 200, 300, 400, 0), (4, 1 << 25, 300, 1 << 20, 3)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, buckets_bytes, slice_bytes, sorted_bytes, hot):
    monkeypatch.setattr(suffixdup, "HOT_SLICES", hot)
    monkeypatch.setattr(suffixdup, "BUCKET_BYTES", buckets_bytes)
    monkeypatch.setattr(suffixdup, "SORTED_BYTES", sorted_bytes)
    monkeypatch.setattr(suffixdup, "SLICE_BYTES", slice_bytes)
    line = "A line of more than a hundred bytes that each and every document has, whatever else it may hold, no doubt. "
    texts = [None, "", "short", *passages(seed), *(f"{p[:50]}{k}{line}{k}{p[50:90]}" for k, p in enumerate(passages(seed + 50, 30)))]
    found = {r["doc_id"]: r for r in suffixdup.digest(documents(spark, texts), Scratch(spark, "t")).collect()}
    for k, (b, gone) in enumerate(brute_removed(texts)):
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        r = found[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("codes", ["equal", "apart"])
def test_bytes_decide_where_hashes_do_not(codes, monkeypatch):
    """Contexts of one anchor whose hashes all agree, and whose hashes all differ."""
    rnd, n = random.Random(9), 60
    anchor = b"x" * 40
    sides = [bytes(rnd.choice(b"ab") for _ in range(60)) for _ in range(4)]
    bodies = [rnd.choice(sides) + anchor + rnd.choice(sides) for _ in range(n)]
    seen, wanted = set(), []
    for b in bodies:
        found = [b[i : i + 100] for i in range(61)]
        wanted.append(sum(1 << i for i, w in enumerate(found) if (i, w) in seen))
        seen.update(enumerate(found))
    code = np.zeros(n, np.uint64) if codes == "equal" else np.arange(n, dtype=np.uint64)
    same = np.full(n, 160)
    monkeypatch.setattr(suffixdup, "SORTED_BYTES", 1000)
    masks = suffixdup._settle(np.zeros(n, np.uint64), code, np.arange(n), np.full(n, 60), same, textkit.Bytes(np.frombuffer(b"".join(bodies), np.uint8)), np.arange(n) * 160)
    assert masks.tolist() == wanted


def test_repeats_of_awkward_tables(spark):
    assert suffixdup.digest(empty(spark), Scratch(spark, "t")).count() == 0
    long = "".join(chr(97 + k % 23) + str(k) for k in range(80))
    rows = spark.createDataFrame([(4, long, "a", 7), (4, long, "b", 7), (None, None, "c", None), (2, long + "é" * 30 + long, "d", 7)], "doc_id long, text string, doc string, n_chars long")
    left = suffixdup.without_repeats(rows, Scratch(spark, "t"))
    assert left.schema == rows.schema
    found = sorted((r["doc"], r["text"], r["n_chars"]) for r in left.collect())
    assert found == [("a", "", 0), ("b", "", 0), ("c", "", 0), ("d", long + "é" * 30, len(long) + 30)]


def test_small_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    found = {r["doc_id"]: r["n_removed"] for r in suffixdup.digest(docs, Scratch(spark, "t")).collect()}
    assert [found[i] for i in ids] == [sum(g) for _, g in brute_removed([texts[i] for i in ids])]
    near = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs.withColumn("rep", F.lit(1)), Scratch(spark, "t"), words=4).collect()}
    assert [near[i] for i in ids] == [ids[c] for c in components([texts[i] for i in ids], 4)]
