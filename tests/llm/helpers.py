"""Awkward documents and plain re-statements of contracts."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, first=0):
    """A table of texts with ids from `first`, dealt over a few partitions."""
    rows = [(first + k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def components(texts, k, percent=80):
    """Each text's least linked place."""
    sets, at = [shingles(t, k) for t in texts], list(range(len(texts)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                at[y] = x
    return [find(i) for i in range(len(texts))]


def odd_texts():
    return [
        None, "", " \n\t ", "one", "two words", "Ünï ça   va \n\nx", "a" * 3000, "日本語 のテキスト 😀 　 and\xa0more", "it's we'll\tdon't  \r\n 123 ½²", "<|endoftext|> a  <|endoftext|>b",
        "x\x1cy \x85 z", "line\nline\nline\n", "É é H̱ İ ΣΑΣ", " lead and trail ", "\n", "  ",
    ]
