import random

import pytest

from palimpsest.llm import quality_classifier as C

from .tools import ODD, documents, odd_columns


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = {}
    for i in range(n):
        bad, toxic = rng.random() < 0.2, rng.random() < 0.2
        w = rng.choices(words, k=rng.randint(30, 120))
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vile", "nasty"])
        if bad:
            w = [x + "###" for x in w]
        out[i] = (" ".join(w), int(not bad), int(toxic))
    return out


def test_held_out_grades(spark):
    rows = corpus(1, 1500)
    docs = documents(spark, {i: r[0] for i, r in rows.items()})
    labels = spark.createDataFrame([(i, r[1], r[2]) for i, r in rows.items() if i < 1000], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in C.grade_documents(docs, C.ratings_of(labels)).collect()}
    held = [i for i in rows if i >= 1000]
    grade = lambda i: rows[i][1] + 1 - rows[i][2]
    right = sum(got[i].kept == (grade(i) == 2) for i in held) / len(held)
    assert right > 0.95
    assert sum(got[i].expected_grade for i in held if grade(i) == 2) / sum(grade(i) == 2 for i in held) > sum(got[i].expected_grade for i in held if grade(i) == 1) / sum(grade(i) == 1 for i in held) + 0.5
    assert all(0 <= got[i].tail <= 1 and got[i].tail - 1e-6 <= got[i].expected_grade <= 2 for i in rows)


def test_odd_rows(spark):
    d = odd_columns(documents(spark, ODD))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept and r.tail is None for r in C.grade_documents(d, C.ratings_of(none)).collect())
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, None, 1), (None, 1, 1), (99, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(C.grade_documents(d, C.ratings_of(labels)).collect()) == len(ODD)
    assert C.grade_documents(documents(spark, {}), C.ratings_of(labels)).count() == 0


@pytest.mark.parametrize("sample", [1, 5])
def test_sample_is_bounded(spark, sample):
    rows = corpus(2, 40)
    docs = documents(spark, {i: r[0] for i, r in rows.items()})
    labels = spark.createDataFrame([(i, r[1], r[2]) for i, r in rows.items()], "doc_id long, quality int, toxic int")
    assert C.grade_documents(docs, C.ratings_of(labels), sample=sample).count() == 40
