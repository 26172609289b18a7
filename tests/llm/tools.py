"""Brute force for the tests: plain Python on whole texts."""

import collections
import re

from pyspark.sql import DataFrame

WHITE = " \t\n\v\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source="s", lang="en"):
    """A table of documents from {id: text} or [(id, text)], with columns whose names may clash with results."""
    rows = texts.items() if isinstance(texts, dict) else texts
    rows = [(i, t, lang, source if isinstance(source, str) else source(i), None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(rows, DOCS)


def odd_columns(df: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    for c in ("kept", "size", "shard", "slot", "component_id", "labels", "position", "n_words", "hi", "node", "root", "id", "keys", "gated"):
        df = df.withColumn(c, F.lit(c))
    return df


ODD = [(1, None), (2, ""), (3, "  \n\t"), (4, "word"), (None, "no id here at all"), (None, None), (5, "a b c d e f " * 20_000), (6, "same text here now"), (6, "same text here now"), (7, "same text here now"), (8, "é\u00a0ß 漢字 \x00 x")]


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_components(texts, k, percent=80):
    """{id: smallest id reachable}."""
    sets = {i: shingles(t, k) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    having = collections.defaultdict(list)
    for i in sorted(sets):
        shared = collections.Counter(j for s in sets[i] for j in having[s])
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
        for s in sets[i]:
            having[s].append(i)
    return {i: find(i) for i in sets}
