"""Every query and the pipeline over tables with a very long text, with nulls and repeated rows, and without rows."""

import hashlib
import random

import pytest

import corpus_pipeline
from tests.llm.helpers import SCHEMA, odd_texts
from tetraspark.llm import neardup, queries, quality_model, scratch

LABELS, PAGES = "doc_id long, quality int, toxic int", "page_id long, url string, html string"


def long_text(n):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9)))
    base = " ".join(word() for _ in range(50_000))
    parts = []
    while sum(map(len, parts)) < n:
        parts += [word(), base, "É. It's\n"]
    return " ".join(parts)[:n]


def put(spark, folder, docs, labels=(), pages=()):
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(pages), PAGES).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def rows_of(texts):
    return [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]


def test_a_very_long_text(spark, tmp_path):
    texts = [long_text(6_000_000), "x" * 100_000, None, *odd_texts(), "short text", "short text"]
    labels = [(k, k % 2, k // 2 % 2) for k in range(3, len(texts))]
    folder = put(spark, tmp_path / "t", rows_of(texts), labels, [(1, "u", "<article><p>" + long_text(2_000_000) + "</article>"), (2, "u", "<p " * 50_000)])
    found = {}
    for name, query in queries.QUERIES.items():
        out = query(spark, folder)
        found[name] = {r[0]: r.asDict() for r in out.select(*[c for c in out.columns if c != "text"]).collect()}
        assert len(found[name]) == (2 if name.startswith("op7") else len(texts)), name
    for k, t in enumerate(texts):
        data = (t or "").encode()
        assert found["op2_prefix_bpe"][k]["decoded_sha256"] == hashlib.sha256(data).hexdigest()
        assert found["op4_repair_shards"][k]["n_tokens"] == found["op2_prefix_bpe"][k]["n_tokens"] + 1 or "<|" in (t or "")
        assert found["op6_minhash_fingerprints"][k]["n_chars"] == len(t or "") and found["op9_suffix_array_dedup"][k]["n_bytes"] == len(data)
        assert found["op3_divergence_rules"][k]["n_words"] == len(queries_words(t))
    # the text repeats its first part, but for single words between
    assert found["op9_suffix_array_dedup"][0]["n_removed"] > 5_000_000 and found["op7_crf_extraction"][1]["n_chars"] > 1_900_000
    assert len({r["doc_id"] for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()}) <= len(texts)


def queries_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_of_awkward_tables(spark, tmp_path, rows):
    """Nulls, empty texts, repeated rows and ids; and no rows at all."""
    good = " ".join("the cat and the dog of that house sat in the sun for it was warm".split() * 1) + " "
    rnd = random.Random(2)
    prose = [good + " ".join(rnd.choice(("river", "stone", "the", "of", "and", "tree", "bird", "cloud", "hill", "to")) + rnd.choice(("", "s", "y", "ed")) for _ in range(120)) for _ in range(6)]
    texts = [(None, None), (1, None), (2, ""), (3, prose[0]), (3, prose[0]), (4, prose[0]), (5, prose[1]), (5, prose[2]), (None, prose[3])]
    docs = [(k, t, None if k == 5 else "en", "s", None) for k, t in texts] if rows == "odd" else []
    folder = put(spark, tmp_path / "t", docs)
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    kept = sorted({r["doc_id"] for r in out.collect()}, key=str)
    # texts without words fail the rules; of equal texts the least id stays, and all rows of an id do
    assert kept == ([3, 5, None] if rows == "odd" else [])


def test_keeping_good_documents(spark):
    docs = spark.createDataFrame([(k, ("good words here " if k % 2 else "bad signs ## there ") * 9, "en", "s", k) for k in range(80)] + [(None, None, None, None, None)], SCHEMA).withColumnRenamed("source", "doc")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)], LABELS)
    kept = quality_model.keep_good(docs, labels)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} - {None} == {k for k in range(80) if k % 2}
    assert quality_model.keep_good(docs, labels.limit(0)).count() == 81


def test_scratch_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{tmp_path}")
    with scratch.opened() as made:
        inner = scratch.Scratch(spark, "a")
        inner.save(spark.range(3), "t")
    outer = scratch.Scratch(spark, "b")
    assert made == [inner] and outer.save(spark.range(2), "t").count() == 2
    inner.remove()
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["b"]
    monkeypatch.undo()

    class Cluster:
        sparkContext = type("C", (), {"master": "yarn", "getConf": lambda s: {}, "_jsc": spark.sparkContext._jsc})()
        conf = type("D", (), {"get": lambda s, k, d: None})()

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError, match="share"):
            scratch.shared_folder(Cluster())


def test_near_duplicates_drop_what_they_used(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: f"file://{tmp_path}")
    texts = ["a b c d e f g h i j k", "a b c d e f g h i j k", "q r s t u v w"]
    out = neardup.near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA), scratch.Scratch(spark, "t"))
    left = {p.name for p in next(tmp_path.iterdir()).iterdir()}
    assert {"features", "nodes"} <= left and not left & {"buckets", "texts", "star", "open"} and out.count() == 3
