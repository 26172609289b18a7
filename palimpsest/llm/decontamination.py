"""Benchmark decontamination by word windows and by templates: typed placeholders for numbers, names and units, and consistent slots."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Spans, arrow, cut, has_bits, joined, keyed, log2_bits_for, mix, portions, runs, seen_bits, signed, table, texts, window_hashes

#: Tokens of a window, those of them that must be words as they stand, the share of an item that shows it, and the tokens on end
#: that do for a long one.
WINDOW, LITERAL, SHARE, RUN = 8, 4, 0.5, 13
#: Words of units and of numbers, in English, French, German and Spanish.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degrees celsius fahrenheit watt watts volt volts joule joules meter meters metre metres kmh mph "
    "mètre mètres kilomètre kilomètres gramme grammes kilo kilos tonne tonnes seconde secondes heure heures jour jours semaine semaines mois an ans année années centime centimes pourcent degrés "
    "kilometer zentimeter gramm kilogramm tonne tonnen sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad "
    "metro metros kilómetro kilómetros gramo gramos kilogramo kilogramos tonelada toneladas litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años dólar dólares céntimo céntimos grados"
).split()
NUMBERS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil"
).split()
_TOKEN = np.zeros(256, bool)
_TOKEN[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_CLOSES = np.zeros(256, bool)
_CLOSES[list(b".!?:;\"'()[]\n")] = True
#: What may stand between the parts of one number, and of one name.
_IN_NUMBER, _IN_NAME = np.zeros(256, bool), np.zeros(256, bool)
_IN_NUMBER[list(b" \n.,'-")] = True
_IN_NAME[list(b" \n-")] = True
PLACE = {"number": U64(0xA5A5A5A501), "name": U64(0xA5A5A5A502), "unit": U64(0xA5A5A5A503)}
#: Windows of tokens as they stand and of templates; what is added to the hashes of each, so that they don't meet.
PLAIN, TEMPLATE = 0, 1
KIND = [U64(0x5B5B5B5B01), U64(0x5B5B5B5B02)]


def _hash_words(words: list[str]) -> np.ndarray:
    buf, begin = joined([w.encode() for w in words])
    return np.sort(Spans(buf).hash(begin[:-1], begin[1:] - 1))


def _lower(blob: bytes) -> bytes:
    """In lower case, at the same length: a letter whose small form takes more or fewer bytes stays as it is. ß is ss, as in capitals."""
    if blob.isascii():
        return blob.lower()
    blob = blob.replace("ß".encode(), b"ss")
    text = blob.decode("utf-8", "replace")
    low = text.lower().encode()
    if len(low) == len(blob):
        return low
    low = "".join(c if len(c.lower().encode()) != len(c.encode()) else c.lower() for c in text).encode()
    return low if len(low) == len(blob) else blob.lower()


Stream = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def streams(blobs: list[bytes]) -> dict[int, Stream]:
    """Of all texts, as tokens and as templates: the text, the hash, the value and whether it is a slot, of each element.

    A token is a run of letters and digits, in lower case. A number begins with a digit or is a number word; a unit is
    one of UNITS after a number; a name has a capital, then a small letter, and does not begin a sentence, or does so
    before another part of the name. In a template, numbers that one mark or space joins (3.5, 1,200, twenty-five) are
    one slot, as are the parts of a name; the value of a slot depends on all its tokens, not on what joins them.
    """
    raw, begin = joined(blobs)
    low = joined([_lower(b) for b in blobs])[0]
    start, end = runs(_TOKEN[raw])
    doc = np.searchsorted(begin, start, side="right") - 1
    token = Spans(low).hash(start, end)
    plain = (doc, token, token, np.zeros(len(token), bool))
    if not len(start):
        return {PLAIN: plain, TEMPLATE: plain}
    number = (raw[start] >= 48) & (raw[start] <= 57) | np.isin(token, _hash_words(NUMBERS))
    before = np.concatenate(([0], end[:-1]))
    same = np.concatenate(([False], doc[1:] == doc[:-1]))
    unit = ~number & same & np.concatenate(([False], number[:-1])) & np.isin(token, _hash_words(UNITS))
    closing = np.concatenate(([0], np.cumsum(_CLOSES[raw])))
    inside = same & (closing[start] == closing[before])
    # A first letter of one or two bytes that has a small form, then a letter that has none.
    wide = (raw[start] >= 128).astype(np.int64)
    second = np.minimum(start + 1 + wide, len(raw) - 1)
    capital = ((low[start] != raw[start]) | (low[start + wide] != raw[start + wide])) & (end - start > 1 + wide)
    capital &= (low[second] == raw[second]) & ((raw[second] >= 97) & (raw[second] <= 122) | (raw[second] >= 128))
    name = inside & capital
    near = same & (start - before == 1)
    in_name, in_number = near & _IN_NAME[raw[before]], near & _IN_NUMBER[raw[before]]
    name[:-1] |= capital[:-1] & name[1:] & in_name[1:]
    kind = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
    glued = np.concatenate(([False], kind[1:] == kind[:-1])) & ((kind == 1) & in_number | (kind == 3) & in_name)
    first = np.flatnonzero(~glued)
    part = (np.arange(len(kind)) - first[np.cumsum(~glued) - 1]).astype(U64)
    value = np.add.reduceat(mix(token ^ mix(part)), first)
    slot = kind[first] > 0
    shape = np.array([0, PLACE["number"], PLACE["unit"], PLACE["name"]], U64)[kind[first]]
    return {PLAIN: plain, TEMPLATE: (doc[first], np.where(slot, shape, token[first]), np.where(slot, value, token[first]), slot)}


def sizes_of(n: int, size: int) -> list[int]:
    """The windows of an item of n tokens: all of a short one; under two windows, smaller ones too, so that one changed
    word leaves some. A single token is no passage."""
    if n <= size:
        return [n] if n > 1 else []
    return [size] if n >= 2 * size else [size, max(size // 2, n - size)]


def windows(blobs: list[bytes], sizes: list[tuple[int, int]], size: int, literal: int) -> Iterator[tuple[int, int, Stream, np.ndarray, np.ndarray]]:
    """For each (kind, elements of a window) of `sizes`: both, the stream, then first element and hash of each window.

    Tokens are in lower case, so windows of tokens do not depend on the case or the line breaks of a text, and what is
    typed does not matter. A window of a template must hold `literal` words as they stand, in proportion if it is
    smaller than `size`.
    """
    both = streams(blobs)
    count = np.concatenate(([0], np.cumsum(~both[TEMPLATE][3])))
    for kind, k in sizes:
        h, at = window_hashes(both[kind][1], both[kind][0], k)
        if kind == TEMPLATE:
            good = count[at + k] - count[at] >= -(-k * literal // size)
            h, at = h[good], at[good]
        yield kind, k, both[kind], at, mix(h + KIND[kind] + U64(k << 8))


def _batch(ids: pa.Array, kind: int, k: int, stream: Stream, at: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
    doc, _, value, typed = stream
    span = at[:, None] + np.arange(k)
    which = typed[span] if len(at) else np.zeros((0, k), bool)
    slots = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(which.sum(1)))).astype(np.int32)), signed(value[span[which]]))
    place = at - np.searchsorted(doc, doc[at])
    full = lambda x: pa.array(np.full(len(at), x, np.int32))
    return pa.record_batch([ids.take(pa.array(doc[at])), full(kind), full(k), pa.array(place, pa.int64()), signed(h), slots], names=["id", "kind", "size", "place", "window", "slots"])


WINDOWS = "id string, kind int, size int, place long, window long, slots array<long>"


def item_windows(benchmark: DataFrame, size: int, literal: int, share: float) -> DataFrame:
    """(id, kind, size, place, window, slots, total, need): the windows of each item, the tokens that those of a kind
    cover, and how many must be found: all of a short item, else `share` of them and `size` at least."""
    every = [(kind, k) for kind in (PLAIN, TEMPLATE) for k in range(2, size + 1)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = texts(b.column(1))
            for p in portions(blobs):
                held: dict[int, list] = {PLAIN: [], TEMPLATE: []}
                for kind, k, stream, at, h in windows(blobs[p], every, size, literal):
                    doc, _, _, typed = stream
                    n = np.bincount(doc, minlength=p.stop - p.start)
                    words = np.bincount(doc, ~typed, minlength=p.stop - p.start)
                    fits = np.array([k in sizes_of(int(x), size) for x in n], bool) & ((n > size) | (kind == PLAIN) | (words >= literal))
                    held[kind].append((k, stream, at[fits[doc[at]]], h[fits[doc[at]]], n))
                for kind, parts in held.items():
                    edge = np.zeros(len(parts[0][1][0]) + 1, np.int64)
                    for k, _, at, _, _ in parts:
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + k, -1)
                    for k, stream, at, h, n in parts:
                        doc = stream[0]
                        total = np.bincount(doc, np.cumsum(edge)[:-1] > 0, minlength=len(n)).astype(np.int64)
                        need = np.where(n <= size, n, np.maximum(size, np.ceil(share * total))).astype(np.int64)
                        r = _batch(b.column(0)[p.start : p.stop], kind, k, stream, at, h)
                        yield pa.record_batch([*r.columns, pa.array(total[doc[at]]), pa.array(need[doc[at]])], names=[*r.schema.names, "total", "need"])

    return arrow(benchmark.select("__key", F.col("text").cast("string")), run, WINDOWS + ", total long, need long")


def document_windows(docs: DataFrame, sizes: list[tuple[int, int]], size: int, literal: int, filled: np.ndarray) -> DataFrame:
    """(id, kind, size, place, window, slots) of the windows of texts that a bit filter lets through."""
    held = docs.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blobs = texts(b.column(1))
            for p in portions(blobs):
                for kind, k, stream, at, h in windows(blobs[p], sizes, size, literal):
                    hit = has_bits(held.value, h)
                    yield _batch(b.column(0)[p.start : p.stop], kind, k, stream, at[hit], h[hit])

    return arrow(docs.select("__key", F.col("text").cast("string")), run, WINDOWS)


def _covered(spans: Column) -> Column:
    """struct(covered, longest): tokens within sorted spans (place, size), and those of the longest run of them."""

    def step(acc: Column, x: Column) -> Column:
        end = F.greatest(x["place"] + x["size"], acc["reach"])
        begin = F.when(x["place"] > acc["reach"], x["place"]).otherwise(acc["begin"])
        covered = acc["covered"] + end - F.greatest(x["place"], acc["reach"])
        covered = F.when(end > acc["reach"], covered).otherwise(acc["covered"])
        return F.struct(end.alias("reach"), begin.alias("begin"), covered.alias("covered"), F.greatest(acc["longest"], end - begin).alias("longest"))

    zero = F.lit(0).cast("long")
    return F.aggregate(spans, F.struct(*[zero.alias(c) for c in ("reach", "begin", "covered", "longest")]), step)


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, literal: int = LITERAL, share: float = SHARE, run: int = RUN) -> DataFrame:
    """(__key, item_id, coverage, verbatim) for each document that holds a benchmark item; __key is that of keyed.

    coverage is the share found of the tokens that the item's windows cover. An item is held if `share` of them
    (`size` at least, all of an item of up to `size` tokens) or `run` of them on end stand in one place of the document,
    in any case and however its lines break (verbatim), or as templates whose slots are filled consistently: each
    number, name or unit of the item by one value in that place. Longer items are also held verbatim if `share` of them
    stands anywhere in the document. All document windows pass a bit filter of fixed size; what is left is hash-joined.
    Items of one token match nothing; short items with fewer than `literal` words have no template. An item without an id
    is searched like any other, and reported with a null.
    """
    named = cut(keyed(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id").select("__key", "item_id", "text").distinct(), "named")
    items = cut(item_windows(named, size, literal, share), "items")
    sizes = [(r["kind"], r["size"]) for r in items.select("kind", "size").distinct().orderBy("kind", "size").collect()]
    filled = seen_bits(items.select("window"), log2_bits_for(max(1, items.count()), 16))
    hits = cut(document_windows(keyed(docs, "doc_id"), sizes, size, literal, filled), "hits")
    keys = items.select(F.col("id").alias("item"), "window", F.col("slots").alias("was"), F.col("place").alias("stood"), "total", "need")
    met = hits.select(F.col("id").alias("__key"), "kind", "size", "place", "window", "slots").join(keys, "window")
    met = cut(met.select("__key", "item", "kind", "size", (F.col("place") - F.col("stood")).alias("shift"), F.col("stood").alias("place"), "slots", "was", "total", "need"), "met")
    spans = F.array_sort(F.collect_set(F.struct("place", "size"))).alias("spans")
    most = [F.max(c).alias(c) for c in ("total", "need")]
    pairs = F.zip_with("was", "slots", lambda a, b: F.xxhash64(a, b))
    slots = [F.array_distinct(F.flatten(F.collect_set(x))).alias(c) for c, x in (("asked", F.col("was")), ("pairs", pairs))]
    placed = met.groupBy("__key", "item", "kind", "shift").agg(spans, *most, *slots)
    placed = placed.where(F.size("asked") == F.size("pairs")).drop("shift", "asked", "pairs")
    pooled = met.where((F.col("size") == size) & (F.col("total") >= 2 * size) & (F.col("kind") == PLAIN)).groupBy("__key", "item", "kind").agg(spans, *most)
    found = placed.withColumn("c", _covered("spans")).withColumn("longest", F.col("c.longest")).unionByName(pooled.withColumn("c", _covered("spans")).withColumn("longest", F.lit(0).cast("long")))
    held = (F.col("c.covered") >= F.col("need")) | (F.col("longest") >= run)
    out = found.where(held).groupBy("__key", "item").agg(F.max(F.col("c.covered") / F.col("total")).alias("coverage"), F.bool_or(F.col("kind") == PLAIN).alias("verbatim"))
    return out.join(named.select(F.col("__key").alias("item"), "item_id"), "item").select("__key", "item_id", "coverage", "verbatim")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **args: object) -> DataFrame:
    """doc_id, leaked, item_ids (sorted) and coverage (the largest) for each row of docs.

    Each row is judged by its own text, so rows without an id, or of one id with several texts, have their own results;
    repeated rows repeat them. Null or empty texts, on either side, hold nothing, and an empty benchmark flags nothing.
    Items without an id flag documents, but are not listed. Texts of any length are read whole; items that are equal, or
    tie, are all listed. Other columns are ignored; an empty table gives an empty result.
    """
    d = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id")
    found = cut(leaks(d, benchmark, **args).groupBy("__key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage")), "leaks")
    out = d.select("doc_id", "__key").join(found, "__key", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("leaked"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def keep_untainted(docs: DataFrame, benchmark: DataFrame, **args: object) -> DataFrame:
    """The rows that hold no benchmark item, with their columns; decided as in decontaminate, by each row's own text."""
    gone = cut(leaks(docs, benchmark, **args).select("__key").distinct(), "gone")
    return keyed(docs, "doc_id").join(gone, "__key", "left_anti").select(docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
