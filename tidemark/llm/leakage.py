"""Evaluation texts inside training text, found by templates.

Numbers, names and units are replaced with typed placeholders; short windows of canonical words, with
and without gaps, are hashed and joined; hits of an item vote along the diagonals of a document; an
exact check of the ordered words decides, and the words in the placeholders' slots tell a verbatim
copy from a re-parameterised one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import plain, words
from tidemark.sources.tables import materialize, small_side

#: Words of a template window at most apart from its first one: windows are triples i < j < k with
#: k - i <= REACH. However the words that a passage changes are placed, if no more than two fifths
#: are, triples of neighbours survive around most of the rest.
REACH = 3
#: Words up to which an item's windows are pairs (a single word for an item of one).
SHORT = 8
#: Share of an item's words at which windows must begin in one band of diagonals for an exact check: a
#: fifth of what makes a leak, as a passage may be torn and lie in several bands.
CANDIDATE = 0.12
#: Share of an item's words that makes a leak, and the longest passage relative to the item.
LEAK, STRETCH = 0.6, 1.3
#: Characters of the items' words up to which they are shipped to the tasks; more are refused.
MAX_NAMES = 5_000_000
#: Bits of the filter that spares tasks most windows no item has; its size does not depend on the data.
FILTER_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Words that stand for a unit or an instrument.
UNITS = frozenset(
    "second seconds minute minutes hour hours day days week weeks month months year years bar bars candle candles "
    "session sessions lot lots unit units contract contracts step steps point points tick ticks pip pips percent "
    "usd usdt eur m h d w mo".split()
)
_NUMBER = re.compile(r"\d[\d.,:]*%?$")
_SPAN = re.compile(r"\d+(?:m|h|d|w|mo)$")
_TICKER = re.compile(r"[a-z]{2,10}usdt?$")


def _cased(text: str | None) -> tuple[set[str], set[str]]:
    """Words written with a capital inside a sentence, lower-cased, and words written small."""
    capital, small = set(), set()
    ws = re.findall(r"[^\W\d_]+|[.?!:;]", plain(text))
    for before, w in zip(["."] + ws, ws):
        if w.islower():
            small.add(w)
        elif len(w) > 1 and w[0].isupper() and before not in ".?!:;":
            capital.add(w.lower())
    return capital, small


def names_of(items: DataFrame, text: str) -> frozenset[str]:
    """Names in the items: words written with a capital inside a sentence, lower-cased.

    A word that is also written small somewhere in the items is no name. The words are gathered
    in a distributed pass; the names must fit ``MAX_NAMES`` characters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, kind) for t in b[text] for kind, ws in zip((1, 0), _cased(t)) for w in ws]
            yield pd.DataFrame(rows, columns=["word", "capital"])

    found = items.select(text).mapInPandas(run, "word string, capital int").groupBy("word").agg(F.min("capital").alias("m")).filter("m = 1")
    found = materialize(found.select("word"), "names")
    if (found.agg(F.sum(F.length("word"))).first()[0] or 0) > MAX_NAMES:
        raise ValueError("the items have more names than can be shipped to the tasks")
    return frozenset(r[0] for r in found.collect())


def canonical(ws: list[str], names: frozenset[str]) -> list[str]:
    """The words with numbers, names and units as typed placeholders."""
    out = []
    for w in ws:
        if _NUMBER.match(w) or _SPAN.match(w):
            out.append("<n>")
        elif w in names or _TICKER.match(w):
            out.append("<name>")
        elif w in UNITS:
            out.append("<unit>")
        else:
            out.append(w)
    return out


def _bits(ws: list[str]) -> dict[str, int]:
    at: dict[str, int] = {}
    for k, w in enumerate(ws):
        at[w] = at.get(w, 0) | 1 << k
    return at


def _common(bits: dict[str, int], n: int, ws: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel addition."""
    full = (1 << n) - 1
    v = full
    for w in ws:
        u = v & bits.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def best_passage(doc: list[str], item: list[str], doc_slots: list[str], item_slots: list[str], starts: list[int], width: int) -> tuple[float, float]:
    """Greatest share of the item's words that one passage of the document holds in order, and the
    share of the item's placeholder slots in that passage filled with the item's own words.

    A share under ``LEAK`` may be that of the whole text, which no passage exceeds.
    A passage is ``STRETCH`` times the item long at most and begins within a band of ``width`` words
    from one of ``starts`` on; beginnings are tried three words apart with a margin of two.
    """
    n = len(item)
    have = set(doc)
    most = sum(w in have for w in item)
    if most < LEAK * n:  # no passage can hold more of the item's words than the whole text does
        slots = [w for w, c in zip(item, item_slots) if c != w]
        return most / n, sum(w in have for w in slots) / len(slots) if slots else 1.0
    bits, length = _bits(item), int(n * STRETCH) + 1
    best, where, last = 0, 0, -10
    for s in sorted({max(0, s + k) for s in starts for k in range(0, width, 3)}):
        if s - last < 3:
            continue
        last = s
        got = _common(bits, n, doc[max(0, s - 2) : s + length])
        if got > best:
            best, where = got, s
    slots = [w for w, c in zip(item, item_slots) if c != w]
    seen = set(doc[max(0, where - 2) : where + length])
    return best / n if n else 0.0, sum(w in seen for w in slots) / len(slots) if slots else 1.0


def _codes(ws: list[str], known: dict[str, int]) -> np.ndarray:
    return np.array([known.get(w, 0) for w in ws], dtype=np.uint64)


def _combine(*codes: np.ndarray) -> np.ndarray:
    """One hash of the codes of a window's words, in order; how far apart they stand does not count."""
    h = np.zeros(len(codes[0]), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for c in codes:
            h = (h ^ c) * _MIX
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def windows_of(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first positions of all windows of ``size`` (1 to 3) words within ``REACH``.

    Windows with an unknown word (code 0) match nothing and are left out.
    """
    n, hashes, at = len(codes), [], []
    pos = np.arange(n)
    gaps = {1: [()], 2: [(a,) for a in range(1, REACH + 1)], 3: [(a, b) for a in range(1, REACH) for b in range(a + 1, REACH + 1)]}[size]
    for gap in gaps:
        m = n - (gap[-1] if gap else 0)
        if m <= 0:
            continue
        parts = [codes[:m], *[codes[g : g + m] for g in gap]]
        ok = np.logical_and.reduce([p != 0 for p in parts])
        hashes.append(_combine(*[p[ok] for p in parts]))
        at.append(pos[:m][ok])
    return (np.concatenate(hashes), np.concatenate(at)) if hashes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _size(n: int) -> int:
    return 1 if n == 1 else 2 if n <= SHORT else 3


def template_rows(df: DataFrame, key: str, text: str, names: frozenset[str]) -> DataFrame:
    """key, row, words, canon: the words and canonical words of each text, joined with blanks.

    ``row`` is a hash of the text, which tells rows that share a key apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ws = [words(t) for t in b[text]]
            yield pd.DataFrame({key: b[key], "row": b["row"], "words": [" ".join(w) for w in ws], "canon": [" ".join(canonical(w, names)) for w in ws]})

    d = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text, F.xxhash64(text).alias("row"))
    return d.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, row long, words string, canon string")


def item_windows(rows: DataFrame, key: str) -> DataFrame:
    """key, position, hash, length of every window of the items' canonical words; a word's code is its hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, canon in zip(b[key], b["canon"]):
                ws = canon.split()
                if ws:
                    h, at = windows_of(_codes(ws, {w: _word_code(w) for w in ws}), _size(len(ws)))
                    out.append(pd.DataFrame({key: k, "item_position": at, "hash": h, "length": len(ws)}))
            if out:
                yield pd.concat(out)

    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, item_position int, hash long, length int").distinct()


def _word_code(w: str) -> int:
    """A non-zero 64-bit code of a word, the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(w) | 1


def _filter(windows: DataFrame) -> np.ndarray:
    """Which values the top ``FILTER_BITS`` bits of the items' hashes have."""
    top = windows.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).cast("int").alias("b")).distinct().toPandas()["b"]
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[top.to_numpy()] = True
    return bits


def document_windows(docs: DataFrame, key: str, vocabulary: dict[str, int], sizes: tuple[int, ...], bits: np.ndarray) -> DataFrame:
    """key, row, hash, position of the windows of documents that may be some item's."""
    shift = np.uint64(64 - FILTER_BITS)
    shipped = np.packbits(bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.unpackbits(shipped).astype(bool)
        for b in batches:
            # all texts of a batch in one array, with unknown words between them that no window crosses
            coded = [_codes(canon.split() + [""] * REACH, vocabulary) for canon in b["canon"]]
            if not coded:
                continue
            begin = np.cumsum([0, *[len(c) for c in coded]])
            codes = np.concatenate(coded)
            for size in sizes:
                h, at = windows_of(codes, size)
                ok = wanted[h.view(np.uint64) >> shift]
                h, at = h[ok], at[ok]
                text = np.searchsorted(begin, at, side="right") - 1
                yield pd.DataFrame({key: b[key].to_numpy()[text], "row": b["row"].to_numpy()[text], "hash": h, "position": at - begin[text]})

    return docs.select(key, "row", "canon").mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, row long, hash long, position int")


def find_leaks(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Documents that hold passages of the items: doc_id, item_id, windows, coverage, slots.

    ``windows`` is the share of the item's words that template windows cover in the best band of
    diagonals, ``coverage`` the share of its words held in order as one passage, ``slots`` the share
    of its numbers, names and units found unchanged there. Kept are pairs with ``coverage`` of at
    least ``LEAK`` or, whatever the values, ``windows`` of at least ``LEAK`` (a re-parameterised
    item: low ``slots``). One row per pair; of several rows with one doc_id or item_id the best counts.

    Null texts and texts without words match nothing. Whole texts are used, and every item is
    joined with every document, short ones included. ``items`` is the held-out set: its windows are
    counted and broadcast if few, else the join on the hash shuffles. A document's window matches as
    many rows as the items have of it; these are reduced per document and band before they are shuffled.
    """
    items = items.filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text).distinct()
    names = names_of(items, text)
    item_rows = materialize(template_rows(items, item_id, text, names).filter("words <> ''"), "items")
    item_rows = item_rows.withColumn("item", F.xxhash64(item_id, "row"))
    windows = materialize(item_windows(item_rows.select("item", "canon"), "item"), "windows")
    vocabulary, sizes = _vocabulary(item_rows)
    docs = materialize(template_rows(documents, doc_id, text, names), "templates")
    met = document_windows(docs, doc_id, vocabulary, sizes, _filter(windows)).join(small_side(windows), "hash")
    # a band is a quarter of the item wide; the item's words are 64 bits, so that hits add up before any shuffle
    quarter = F.greatest(F.ceil(F.col("length") / 4.0), F.lit(2)).cast("int")
    band = F.floor((F.col("position") - F.col("item_position")) / quarter.cast("double")).cast("int")
    words_ = F.least("length", F.lit(64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(F.col("item_position") * words_ / F.col("length").cast("double")).cast("int"))
    votes = met.groupBy(doc_id, "row", "item", "length", band.alias("band")).agg(F.bit_or(bit).alias("mask"))
    votes = votes.withColumn("windows", F.bit_count("mask") / words_).filter(F.col("windows") >= CANDIDATE)
    near = votes.groupBy(doc_id, "row", "item").agg(F.max("windows").alias("windows"), F.collect_set((F.col("band") - 1) * quarter).alias("starts"), F.max(3 * quarter).alias("width"))
    texts = item_rows.select("item", item_id, F.col("words").alias("item_words"), F.col("canon").alias("item_canon"))
    pairs = near.join(small_side(materialize(texts, "texts")), "item").join(docs.dropDuplicates([doc_id, "row"]), [doc_id, "row"])

    @F.pandas_udf("struct<coverage double, slots double>")
    def check(words_: pd.Series, canon: pd.Series, item_words: pd.Series, item_canon: pd.Series, starts: pd.Series, width: pd.Series) -> pd.DataFrame:
        rows = [best_passage(a.split(), b.split(), c.split(), d.split(), list(s), int(w)) for a, b, c, d, s, w in zip(words_, item_words, canon, item_canon, starts, width)]
        return pd.DataFrame(rows, columns=["coverage", "slots"])

    out = pairs.withColumn("x", check("words", "canon", "item_words", "item_canon", "starts", "width")).select(doc_id, item_id, "windows", "x.*")
    out = out.filter((F.col("coverage") >= LEAK) | (F.col("windows") >= LEAK))
    best = F.max(F.struct("coverage", "windows", "slots")).alias("x")
    return out.groupBy(doc_id, item_id).agg(best).select(doc_id, item_id, "x.windows", "x.coverage", "x.slots")


def _vocabulary(item_rows: DataFrame) -> tuple[dict[str, int], tuple[int, ...]]:
    """Codes of the items' canonical words, and the sizes their windows have.

    A held-out set so large that its words do not fit ``MAX_NAMES`` characters is refused.
    """
    ws = F.split("canon", " ")
    distinct = materialize(item_rows.select(F.explode(ws).alias("w")).distinct(), "vocabulary")
    if (distinct.agg(F.sum(F.length("w"))).first()[0] or 0) > MAX_NAMES:
        raise ValueError("the items have more words than can be shipped to the tasks")
    size = F.when(F.size(ws) == 1, 1).when(F.size(ws) <= SHORT, 2).otherwise(3)
    sizes = tuple(sorted(r[0] for r in item_rows.select(size.alias("s")).distinct().collect()))
    return {r[0]: _word_code(r[0]) for r in distinct.collect()}, sizes
