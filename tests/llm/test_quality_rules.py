import collections
import random

from palimpsest.llm import quality_rules as Q

from .tools import ODD, WORD, documents, odd_columns


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cov = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(cov) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(cov), failed


def test_base(spark):
    rng = random.Random(4)
    texts = {i: "".join(rng.choice(["a", "b", "é", "漢", " ", "  ", "\n", "\t", "#", "|", "\x0b", "word "]) for _ in range(rng.randint(0, 400))) for i in range(200)}
    for r in Q.clean_lines(documents(spark, texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)


CLEAN = "The river ran past the old mill and on towards the sea, as it had for years.\nNobody in the village could say when the mill had last been in use."


def test_lines(spark):
    texts = {
        1: CLEAN, 2: "Home\nAbout us\n" + CLEAN + "\nContact", 3: "one | two | three | four | five | six | seven | eight | nine | ten | eleven",
        4: "We### use%%% many&&& odd*** marks### after%%% each&&& and*** every### word%%% here&&&.", 5: "BUY NOW!! ALL CAPS!! EVERY WORD!! IS LOUD!! AND CLEAR!! TO ALL!!",
        6: CLEAN + "\nBy using this site you accept our privacy policy and terms of use.\n",
    }
    got = {r.doc_id: r for r in Q.clean_lines(documents(spark, texts), with_text=True).collect()}
    assert {i for i, r in got.items() if r.kept} == {1, 2, 6}
    assert got[1].cleaned == CLEAN and got[2].cleaned == CLEAN and got[6].cleaned == CLEAN + "\n"
    kept = Q.keep_clean(odd_columns(documents(spark, texts)))
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {1: (CLEAN, len(CLEAN)), 2: (CLEAN, len(CLEAN)), 6: (CLEAN + "\n", len(CLEAN) + 1)}


def test_odd_rows(spark):
    d = odd_columns(documents(spark, ODD))
    rows = Q.clean_lines(d).collect()
    assert len(rows) == len(ODD)
    assert all(r.n_words == 0 and not r.kept for r in rows if r.doc_id in (1, 2, 3))
    assert Q.keep_clean(d).columns == d.columns and Q.keep_clean(documents(spark, {})).count() == 0
