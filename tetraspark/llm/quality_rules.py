"""Quality rules with distribution divergence, in DataFrame functions only (operator 3).

Each document gets counts and two histograms: character classes, and the common words of four languages. The
histograms summed over all documents of a language that pass the base rules are that language's reference.
A document fails where the Jensen-Shannon distance to its reference is too large, if it has enough words for
its histogram to mean something.
"""

from __future__ import annotations

import zlib
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

# Frequent words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in is that it for was on are with as be at by this from or "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le les et des en un une du dans est que qui pour par sur au pas avec "
    "el que y los se del las por con no para una su al lo como más o pero sus"
).split()
COMMON = list(dict.fromkeys(COMMON_WORDS))

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
#: A document with at least so many words fails above a distance. That of common words, which are few in a
#: short text, is allowed COMMON_NOISE / sqrt(words) more.
MOST_CLASS_DISTANCE, CLASS_WORDS = 0.30, 50
MOST_COMMON_DISTANCE, COMMON_NOISE, COMMON_WORDS_NEEDED = 0.15, 1.5, 100
#: A language with fewer words than this in all its documents has no reference: its documents' character
#: classes are held against all languages together, and their common words against nothing.
REFERENCE_WORDS = 2000

_SPACE = r"[\x20\x09-\x0D]+"
_CLASSES = (r"\p{Lu}+", r"\p{Nd}+", r"""[.,;:!?'"()\-]+""", r"[#*$%&|<>]+")
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _slots() -> list[str]:
    """COMMON in a table where each word's crc32 leads to a slot of its own: its sign (`_sign`) and the word."""
    codes = [zlib.crc32(w.encode()) for w in COMMON]
    size = next(n for n in count(len(COMMON)) if len({c % n for c in codes}) == len(codes))
    out = [""] * size
    for k, (c, w) in enumerate(zip(codes, COMMON, strict=True)):
        out[c % size] = _sign(k) + w
    return out


def _sign(k: int) -> str:
    """One printable character of ASCII for each common word, but no quote or backslash."""
    return [chr(c) for c in range(33, 127) if chr(c) not in "'\\"][k]


def _cut(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """docs' columns in the struct `doc`, with the counts, class_hist and common_hist beside it.

    n_repeat_words: the 3-word windows, as (hash, place) sorted, show which places hold a window that occurs
    again, by its words; each such place covers three words, less what the next one covers too.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    df = docs.select(doc, lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    df = df.withColumn("bare", F.regexp_replace("body", _SPACE, "")).withColumn("words", F.array_remove(F.split("body", _SPACE), ""))
    df = df.withColumn("lines", F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).withColumn("rest", F.regexp_replace("bare", r"\p{Ll}+", ""))
    df = df.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.length("bare").cast("long"))
    df = df.withColumn("hashes", F.expr("""if(size(words) < 3, cast(array() as array<bigint>),
        transform(slice(words, 1, greatest(size(words) - 2, 0)), (w, i) -> xxhash64(w, words[i + 1], words[i + 2])))"""))
    # most texts repeat no window; sort_array compares without a function in SQL
    df = df.withColumn("windows", F.expr("""if(size(array_distinct(hashes)) = size(hashes), cast(array() as array<struct<h:bigint,i:int>>),
        sort_array(transform(hashes, (h, i) -> named_struct('h', h, 'i', i))))"""))
    df = df.withColumn("again", F.expr("""sort_array(array_distinct(flatten(transform(
        filter(zip_with(slice(windows, 1, greatest(size(windows) - 1, 0)), slice(windows, 2, greatest(size(windows) - 1, 0)),
            (a, b) -> if(a.h = b.h, named_struct('i', a.i, 'j', b.i), null)),
            x -> x is not null and words[x.i] = words[x.j] and words[x.i + 1] = words[x.j + 1] and words[x.i + 2] = words[x.j + 2]),
        x -> array(x.i, x.j)))))"""))
    df = df.withColumn("n_repeat_words", F.expr("""if(size(again) = 0, 0L, 3L + aggregate(
        zip_with(slice(again, 1, greatest(size(again) - 1, 0)), slice(again, 2, greatest(size(again) - 1, 0)), (a, b) -> cast(least(3, b - a) as bigint)), 0L, (s, x) -> s + x))"""))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    counts = [_cut(F.col("rest"), p) for p in _CLASSES]
    df = df.withColumn("classes", F.array(F.col("word_chars").cast("int") - F.length("rest"), *counts))
    slots = _slots()
    table = "array(" + ",".join(f"'{x}'" for x in slots) + ")"
    # of each common word its sign
    df = df.withColumn("coded", F.expr(f"""array_join(transform(
        transform(transform(filter(words, w -> length(w) <= {max(map(len, COMMON))}), w -> lower(w)), w -> named_struct('w', w, 's', {table}[pmod(crc32(w), {len(slots)})])),
        x -> if(substring(x.s, 2) = x.w, left(x.s, 1), '')), '')"""))
    found = [(F.length("coded") - F.length(F.replace(F.col("coded"), F.lit(_sign(k))))).cast("double") for k in range(len(COMMON))]
    other_class = (F.col("word_chars") - F.aggregate("classes", F.lit(0), lambda a, x: a + x)).cast("double")
    return df.select(
        "doc", "lang", "n_words", "word_chars", F.element_at("classes", 5).cast("long").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.concat(F.transform("classes", lambda x: x.cast("double")), F.array(other_class)).alias("class_hist"),
        F.concat(F.array(*found), F.array((F.col("n_words") - F.length("coded")).cast("double"))).alias("common_hist"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def references(feats: DataFrame) -> DataFrame:
    """(lang, every, class_ref, common_ref), shares, of each language with enough words, and a row with `every` set for all together."""
    sizes = {"class_hist": len(_CLASSES) + 2, "common_hist": len(COMMON) + 1}
    sums = [F.sum(F.col(h)[i]).alias(f"{h}{i}") for h, n in sizes.items() for i in range(n)]
    good = feats.filter(~base_failed()).groupBy("lang").agg(F.sum("n_words").alias("words"), *sums)
    rows = good.filter(F.col("words") >= REFERENCE_WORDS).withColumn("every", F.lit(False))
    total = good.agg(F.lit(None).cast("string").alias("lang"), F.sum("words").alias("words"), *[F.sum(s).alias(s) for s in good.columns[2:]], F.lit(True).alias("every"))
    both = rows.unionByName(total)
    for (h, n), whole in zip(sizes.items(), ("class_ref", "common_ref"), strict=True):
        values = [F.coalesce(F.col(f"{h}{i}"), F.lit(0.0)) for i in range(n)]
        both = both.withColumn(f"{h}_sum", sum(values[1:], values[0]))
        both = both.withColumn(whole, F.array(*[F.when(F.col(f"{h}_sum") > 0, v / F.col(f"{h}_sum")).otherwise(0.0) for v in values]))
    return both.select("lang", "every", "class_ref", "common_ref")


def _distance(hist: str, size: str, ref: str) -> Column:
    """Jensen-Shannon distance, base 2, of counts that sum to `size` and of shares; 0 where either is empty."""
    part = lambda x: f"if({x} > 0, {x} * log2(2 * {x} / (p + q)), 0D)"
    total = f"aggregate(zip_with(transform({hist}, x -> x / {size}), {ref}, (p, q) -> 0.5D * ({part('p')} + {part('q')})), 0D, (s, y) -> s + y)"
    return F.expr(f"if({size} > 0 and exists({ref}, x -> x > 0), sqrt(greatest(0D, {total})), 0D)")


def judged(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(key, digest, counts, base_failed, class_distance, common_distance, kept), a row for each row of docs.

    Null and empty texts have no words and fail the base rules. Of a null or rare language only the classes
    are held against all languages. Rows are judged one by one, so repeated rows and equal ids have equal verdicts where
    their texts and languages are equal; digest tells rows of equal id apart. An empty table gives no rows.
    """
    feats = features(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), (F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")).alias("lang")))
    feats = feats.select(F.col("doc.key").alias("key"), F.xxhash64("doc.text", "doc.lang").alias("digest"), "lang", *_BASE, "class_hist", "common_hist")
    feats = scratch.save(feats, "features")
    refs = scratch.save(references(feats), "references")
    own = refs.filter("not every").select(F.col("lang").alias("of"), F.col("class_ref").alias("a"), F.col("common_ref").alias("b"))
    every = refs.filter("every").select(F.col("class_ref").alias("c"), F.lit(True).alias("every"))  # one row
    df = feats.join(own, feats["lang"].eqNullSafe(own["of"]), "left").withColumn("every", F.lit(True)).join(F.broadcast(every), "every")
    df = df.withColumn("class_ref", F.coalesce("a", "c")).withColumn("common_ref", F.coalesce("b", F.array(F.lit(0.0))))
    df = df.withColumn("class_distance", _distance("class_hist", "word_chars", "class_ref")).withColumn("common_distance", _distance("common_hist", "n_words", "common_ref")).withColumn("base_failed", base_failed())
    bad = ((F.col("n_words") >= CLASS_WORDS) & (F.col("class_distance") > MOST_CLASS_DISTANCE)) | ((F.col("n_words") >= COMMON_WORDS_NEEDED) & (F.col("common_distance") > MOST_COMMON_DISTANCE + COMMON_NOISE / F.sqrt(F.col("n_words"))))
    return df.select("key", "digest", *_BASE, "base_failed", "class_distance", "common_distance", (~F.col("base_failed") & ~bad).alias("kept"))


def keep_good(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that judged() rejects; columns as they were."""
    bad = judged(docs, scratch, id_col, text_col, lang_col).filter("not kept").select(F.col("key").alias("__key"), F.col("digest").alias("__digest")).distinct()
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__key"]) & (F.xxhash64(docs[text_col], lang) == bad["__digest"]), "left_anti")
