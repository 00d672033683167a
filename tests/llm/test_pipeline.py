"""The pipeline's rows against plain Python, stage by stage, on the smallest tables."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.helpers import components
from tests.llm.test_duplicates import brute_removed
from tests.llm.test_models import counts, distance, histograms
from tests.llm.test_tokens import WORDS, naive_best_fit
from tetraspark.llm import quality_model, quality_rules
from tetraspark.llm.tables import table


def passes_rules(rows):
    """Ids that the quality rules keep of (id, text, lang)."""
    good = {}
    for i, text, _ in rows:
        n, _, _, _, again = counts(text)
        good[i] = n >= 50 and 100 * again <= 50 * n
    sums, words = defaultdict(lambda: [0, 0]), defaultdict(int)
    for i, text, lang in rows:
        if good[i]:
            h = histograms(text)
            for key in (lang, "*"):
                sums[key] = [np.add(sums[key][0], h[0]), np.add(sums[key][1], h[1])]
                words[key] += counts(text)[0]
    kept = set()
    for i, text, lang in rows:
        if not good[i]:
            continue
        n, own = counts(text)[0], histograms(text)
        known = words[lang] >= quality_rules.REFERENCE_WORDS
        far = distance(own[0], sums[lang if known else "*"][0]) > quality_rules.MOST_CLASS_DISTANCE
        odd = known and n >= quality_rules.COMMON_WORDS_NEEDED and distance(own[1], sums[lang][1]) > quality_rules.MOST_COMMON_DISTANCE + quality_rules.COMMON_NOISE / n**0.5
        if not far and not odd:
            kept.add(i)
    return kept


def test_run_equals_brute_force(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    rows = sorted((r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect())
    model = quality_model.train(docs, labels)
    rows = [r for r in rows if quality_model.score(model, pa.array([r[1]], pa.large_string()))[0] >= quality_model.THRESHOLD]
    kept = passes_rules(rows)
    rows = [r for r in rows if r[0] in kept]
    first = components([r[1] for r in rows], 5)
    rows = [r for k, r in enumerate(rows) if first[k] == k]
    left = [bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore") for b, gone in brute_removed([r[1] for r in rows])]
    tokenizer, wanted, rests, full = Tokenizer.from_file(WORDS), set(), [], 0
    for (i, _, _), text in zip(rows, left, strict=True):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for start in range(0, len(ids), 2048):
            piece = ids[start : start + 2048]
            wanted.add((i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            full += len(piece) == 2048
            rests += [len(piece)] * (len(piece) < 2048)
    found = corpus_pipeline.run(spark, SMALL).toPandas()
    assert 0 < len(rows) < 200
    assert set(found[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)) == wanted and len(found) == len(wanted)
    used = found.groupby("sequence_id")["length"].sum()
    assert sorted(used) == sorted([2048] * full + naive_best_fit(rests, 2048))
