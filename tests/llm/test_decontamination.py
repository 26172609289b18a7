import random

from palimpsest.llm import decontamination as D

from .tools import ODD, documents, odd_columns


def prose(rng, n):
    return " ".join(rng.choice(["river", "stone", "walks", "over", "seven", "the", "green", "old", "house", "under", "slow", "light", "bird", "sings"]) + rng.choice(["", "s", "er", "ing", "ly"]) for _ in range(n))


ITEM = "Anna Smith buys 12 apples at the market for 3 dollars each and then gives 5 apples to her friend Ben Jones before she walks home with the rest of them"
AGAIN = "Maria Lopez buys 40 apples at the market for 7 dollars each and then gives 9 apples to her friend Tom Reed before she walks home with the rest of them"


def test_leaks(spark):
    rng = random.Random(8)
    items = {i: prose(rng, 40) for i in range(20)} | {50: ITEM, 60: "too short", 70: None, 80: "CIÓN ÉCOLE " + prose(rng, 30)}
    docs = {i: prose(rng, 300) for i in range(60)}
    docs[100] = prose(rng, 50) + ". " + items[3] + ". " + prose(rng, 20)
    docs[101] = prose(rng, 30) + "\n" + items[4].upper() + "!! " + items[5]
    docs[102] = prose(rng, 30) + ". " + AGAIN + ". " + prose(rng, 10)
    docs[103] = prose(rng, 30) + ". " + ITEM.replace("12 apples", "12 apples twice 30 apples") + "."
    docs[104] = " ".join(items[6].split()[:6])
    docs[105] = (items[80] + " ") .lower()
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in D.decontaminate(documents(spark, docs), bench).collect()}
    assert {i: x for i, x in got.items() if x} == {100: [3], 101: [4, 5], 102: [50], 103: [50], 105: [80]}
    kept = D.keep_untainted(odd_columns(documents(spark, docs)), bench)
    assert {r.doc_id for r in kept.collect()} == set(docs) - {100, 101, 102, 103, 105}


def test_inconsistent_slots_are_no_leak(spark):
    item = "In 1990 the town built a bridge and in 1990 the town built a school and in 1990 the town closed the old mill"
    same, other = item.replace("1990", "1875"), item.replace("1990", "1875", 1).replace("1990", "1912", 1).replace("1990", "2001", 1)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.leaked for r in D.decontaminate(documents(spark, {1: same, 2: other, 3: item}), bench).collect()}
    assert got == {1: True, 2: False, 3: True}


def kinds(text):
    _, shape, _, slot = D.streams([text.encode()])[D.TEMPLATE]
    names = {int(v): k for k, v in D.PLACE.items()}
    return [names[int(x)] if t else "." for x, t in zip(shape, slot, strict=True)]


def test_tokens():
    assert kinds("He paid Ben 5 euros. Ben left, and Ben's dog ran 3 km in may") == [".", ".", "name", "number", "unit", ".", ".", ".", "name", ".", ".", ".", "number", "unit", ".", "."]
    assert kinds("it costs 3.5 or 1,200 or twenty-five dollars, not 3, 4") == [".", ".", "number", ".", "number", ".", "number", "unit", ".", "number", "number"]
    assert kinds("and Mary Ann met Élise de Ávila near Jean-Luc") == [".", "name", ".", "name", ".", "name", ".", "name"]
    assert kinds("Anna Smith sings. Then drei Stunden et cinq heures") == ["name", ".", ".", "number", "unit", ".", "number", "unit"]


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "word"), (None, "no id here at all"), (2, None), (3, "a b c d e f a b c d e f a b c d"), (3, "same text here now")], "item_id long, text string")
    rows = D.decontaminate(odd_columns(documents(spark, ODD)), bench).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.doc_id or 0, r.item_ids) for r in rows if r.leaked) == [(0, []), (5, [3]), (6, [3]), (6, [3]), (7, [3])]
    assert sum(r.doc_id is None for r in D.keep_untainted(odd_columns(documents(spark, ODD)), bench).collect()) == 1
    twice = documents(spark, [(1, "nothing of this kind stands here"), (1, "x same text here now x")])
    assert [r.leaked for r in D.decontaminate(twice, bench).orderBy("leaked").collect()] == [False, True]
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.leaked for r in D.decontaminate(documents(spark, ODD), none).collect())
    assert D.decontaminate(documents(spark, {}), bench).count() == 0


GERMAN = "Der Lehrer fragt die Klasse, wie viele Äpfel Frau Müller auf dem Markt in der Großen Straße kauft, wenn jeder Korb fünf Äpfel und eine Birne enthält"


def test_verbatim_in_any_case_and_wrapping(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, GERMAN)], "item_id long, text string")
    docs = {}
    for i, item in ((1, ITEM), (2, GERMAN)):
        forms = [item, item.lower(), item.upper(), item.title(), item.replace(" ", "\n"), item.replace(" Ben", "\nBen").replace(" Frau", "\nFrau")]
        docs |= {10 * i + k: f"Here it is: {f}. And so on" for k, f in enumerate(forms)}
    got = {r.doc_id: r.item_ids for r in D.decontaminate(documents(spark, docs), bench).collect()}
    assert got == {d: [d // 10] for d in docs}
    assert all(r.verbatim and r.coverage == 1 for r in D.leaks(documents(spark, docs), bench).collect())


def test_short_dense_and_partly_quoted_items(spark):
    rng = random.Random(9)
    words = [f"w{i}x" for i in range(100)]
    long = " ".join(words)
    fifteen = "the old mill by the slow river grinds wheat for every farm in our valley"
    items = {1: "What is the capital of France?", 2: "12 + 7 = 19, 13 + 8 = 21, 14 + 9 = 23", 3: "The Art Of The Deal And Other Long Stories", 4: long, 5: fifteen, 6: "She has 3 apples and 2 pears"}
    docs = {10 * i: f"{prose(rng, 30)}. {t}. {prose(rng, 30)}" for i, t in items.items()}
    docs |= {41: prose(rng, 30) + " " + " ".join(words[20:50]), 42: " ".join(words[:6] + ["and"] + words[50:56]), 51: fifteen.replace("grinds", "crushes"), 61: "she has 8 apples and 9 pears", 11: "What is the capital of a country?"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in D.decontaminate(documents(spark, docs), bench).collect()}
    assert got == {d: [d // 10] if d not in (11, 42) else [] for d in docs}


def test_slots_agree_in_each_place(spark):
    row = "Anna has 3 apples and Ben has 5 apples and Carl has 7 apples and Dora has 9 apples in the same basket"
    perfect = row.replace("Ben", "Tom").replace("Carl", "Max").replace("Dora", "Eva").replace("3", "4").replace("5", "6").replace("7", "8").replace("9", "11")
    other = AGAIN.replace("40", "55").replace("7 dollars", "8 dollars").replace("Maria Lopez", "Clara Diaz")
    docs = {10: AGAIN + ". " + other + ".", 11: AGAIN + ". Then Eva Stone " + other[12:60] + " and left", 20: perfect, 21: "Zoe said: " + perfect + ". " + perfect.replace("4", "14")}
    bench = spark.createDataFrame([(1, ITEM), (2, row)], "item_id long, text string")
    found = leaks_by_id(documents(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(d, d // 10) for d in docs} and not any(r.verbatim for r in found)


FRAMES = [
    "{n} has {x} apples and gives {y} of them to her friend {m} after a walk of {z} {u} along the river",
    "a train with {x} cars leaves the old station of {n} and needs {y} {u} to the town where {m} waits with {z} bags",
    "if {n} saves {x} dollars each week for {y} {u} how much more than {m} with {z} dollars does she have at the end",
    "the gardener {n} plants {x} rows of {y} roses and later {m} cuts {z} of them within two {u}",
]
NAMES, NUMS, UNITS = ["Anna", "Mary Ann", "Élise", "Tom Reed", "Jean-Luc", "Carla"], ["3", "12", "3.5", "1,200", "twenty five", "seven", "40"], ["miles", "hours", "days", "weeks"]


def fill(rng, frame):
    n, m = rng.sample(NAMES, 2)
    x, y, z = rng.sample(NUMS, 3)
    return "Now " + frame.format(n=n, m=m, x=x, y=y, z=z, u=rng.choice(UNITS))


def test_recall_of_reparameterised_items(spark):
    """Names, numbers (of other lengths too) and units changed: at least nine in ten are found, and no clean document."""
    rng = random.Random(21)
    items = {i: fill(rng, f) for i, f in enumerate(FRAMES)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = {100 * i + k: prose(rng, rng.randint(0, 60)) + ". " + fill(rng, f) + ". " + prose(rng, 30) for i, f in enumerate(FRAMES) for k in range(40)}
    docs |= {1000 + k: prose(rng, 200) for k in range(60)}
    got = {r.doc_id: r.item_ids for r in D.decontaminate(documents(spark, docs), bench).collect()}
    found = sum(got[d] == [d // 100] for d in docs if d < 1000)
    assert found >= 0.9 * 160 and not any(got[d] for d in docs if d >= 1000), found


def brute_leaks(docs, items, size=8, literal=4, share=0.5, run=13):
    """{(doc, item): (coverage, verbatim)} by comparing all windows of all texts as lists, without hashes or filters."""

    def elements(text):
        both = D.streams([(text or "").encode()])
        return {kind: (list(zip(both[kind][1].tolist(), both[kind][3].tolist(), strict=True)), both[kind][2].tolist()) for kind in both}

    def width(spans):
        covered = sorted({t for p, k in spans for t in range(p, p + k)})
        best = now = 0
        for i, t in enumerate(covered):
            now = now + 1 if i and covered[i - 1] == t - 1 else 1
            best = max(best, now)
        return len(covered), best

    out = {}
    texts = {d: elements(t) for d, t in docs.items()}
    for i, text in items.items():
        mine = elements(text)
        for d, whole in texts.items():
            for kind in (D.PLAIN, D.TEMPLATE):
                (e, v), (f, w) = mine[kind], whole[kind]
                words = sum(not s for _, s in e)
                sizes = D.sizes_of(len(e), size) if len(e) > size or kind == D.PLAIN or words >= literal else []
                good = [(p, k) for k in sizes for p in range(len(e) - k + 1) if kind == D.PLAIN or sum(not s for _, s in e[p : p + k]) >= -(-k * literal // size)]
                total = len({t for p, k in good for t in range(p, p + k)})
                need = len(e) if len(e) <= size else max(size, -(-total * share // 1))
                hits = [(p, k, q) for p, k in good for q in range(len(f) - k + 1) if e[p : p + k] == f[q : q + k]]
                for shift in {q - p for p, _, q in hits}:
                    at = [(p, k) for p, k, q in hits if q - p == shift]
                    pairs = {(v[t], w[t + shift]) for p, k in at for t in range(p, p + k) if e[t][1]}
                    n, longest = width(at)
                    if len({a for a, _ in pairs}) == len(pairs) and (n >= need or longest >= run):
                        was = out.get((d, i), (0, False))
                        out[d, i] = (max(was[0], n / total), was[1] or kind == D.PLAIN)
                n = width([(p, k) for p, k, _ in hits if k == size])[0]
                if kind == D.PLAIN and total >= 2 * size and n >= need:
                    out[d, i] = (max(out.get((d, i), (0, 0))[0], n / total), True)
    return out


def test_against_brute_force(spark):
    rng = random.Random(33)
    items = {i: fill(rng, f) for i, f in enumerate(FRAMES)} | {10 + i: prose(rng, n) for i, n in enumerate((1, 2, 5, 8, 9, 12, 15, 16, 40))} | {30: "12 + 7 = 19, 13 + 8 = 21"}
    docs = {}
    for k in range(150):
        parts = [prose(rng, rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(list(items.values())).split()
            a = rng.randint(0, len(w) // 2)
            w = w[a : a + rng.randint(3, max(3, len(w)))] if rng.random() < 0.5 else w
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = rng.choice(["9", "Zoe", "stone"])
            parts += [" ".join(w), fill(rng, rng.choice(FRAMES)), prose(rng, rng.randint(0, 9))]
        docs[k] = rng.choice([". ", " ", "\n"]).join(parts)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.verbatim) for r in leaks_by_id(documents(spark, docs), bench).collect()}
    assert got == brute_leaks(docs, items) and len({i for _, i in got}) > 8


def leaks_by_id(docs, bench):
    return D.keyed(docs, "doc_id").select("__key", "doc_id").join(D.leaks(docs, bench), "__key")
