"""Benchmark decontamination by winnowing, in DataFrame operations only.

The fingerprints of a text are the minima of the 4-word hashes of each 8 consecutive words, so two texts
that share 8 words in a row share one. Documents meet the test set by fingerprint; only those
that meet are read again, and each hit is extended to the whole window: 13 words, or the item where that
is shorter. Hits are unique per place, so words inside several windows count once.

Arrays are exploded with the outer form: the plain one puts a filter on the array, which the optimizer would push
down through all the steps that made it. A hash is 64 bits wide. The test set's fingerprints are broadcast behind a check of their number and
joined by shuffle beyond it. Items of under 8 words have no fingerprint; their whole hash meets every place
of every document, a pass for each such length that occurs.

Defined cases: null, empty and wordless texts have no words, no hits and are clean; an item without words is
no window; equal items each count; rows with one id are judged each by its own text, rows with one id and text are rows each; a null
id is kept; without items every document is clean; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import stage

WINDOW = 13
#: words of a hash and of the span that is sure to hold a fingerprint
GRAM, SPAN = 4, 8
#: rows of the test set's windows or fingerprints that are broadcast
BROADCAST_ROWS = 1_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _NOT_WORD), "")


def _zipped(df: DataFrame, name: str, left: str, right: str, shift: int, fn) -> DataFrame:
    """``name``[i] = fn(``left``[i], ``right``[i + shift])."""
    n = F.greatest(F.least(F.size(left), F.size(right) - shift), F.lit(0))
    return df.withColumn(name, F.zip_with(F.slice(left, 1, n), F.slice(right, shift + 1, n), lambda a, b: fn(a, b)))


def _hashed(df: DataFrame) -> DataFrame:
    """``words`` -> ``h1``, ``h2``, ``h4``: hashes of as many words from each place."""
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    df = _zipped(df, "h2", "h1", "h1", 1, F.xxhash64)
    return _zipped(df, "h4", "h2", "h2", 2, F.xxhash64)


def _minima(df: DataFrame) -> DataFrame:
    """``fp``[i]: the smallest of ``h4`` in the 8 words from i."""
    df = _zipped(df, "m2", "h4", "h4", 1, F.least)
    df = _zipped(df, "m4", "m2", "m2", 2, F.least)
    return _zipped(df, "fp", "m4", "m4", 1, F.least)


def _gram(df: DataFrame, length: int) -> DataFrame:
    """``g<length>``: hash of ``length`` words from each place, put together from 8, 4, 2 and 1."""
    if length >= 8 and "h8" not in df.columns:
        df = _zipped(df, "h8", "h4", "h4", 4, F.xxhash64)
    at, name = 0, ""
    for part in (8, 4, 2, 1):
        while length - at >= part:
            if not name:
                name = f"h{part}"
            else:
                df = _zipped(df, f"p{length}_{at + part}", name, f"h{part}", at, F.xxhash64)
                name = f"p{length}_{at + part}"
            at += part
    return df.withColumn(f"g{length}", F.col(name))


def _met(rows: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(small) if few else small, on, how)


def decontaminate(docs: DataFrame, tests: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``rk``, ``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted as strings) of each row; ``rk`` is :func:`row_key`."""
    items = tests.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).filter("size(words) > 0")
    items = items.withColumn("len", F.least(F.size("words"), F.lit(WINDOW)))
    lengths = sorted(r[0] for r in items.select("len").distinct().collect())
    items = _minima(_hashed(items))
    for n in lengths:
        items = _gram(items, n)
    windows = None
    for n in lengths:
        own = items.filter(F.col("len") == n).select(F.lit(n).alias("len"), F.explode_outer(f"g{n}").alias("g"), "item")
        windows = own if windows is None else windows.unionByName(own)
    marks = stage(items.select(F.explode_outer(F.slice("fp", 1, F.greatest(F.size("words") - F.col("len") + 1, F.lit(0)))).alias("fp")).filter("fp is not null").distinct().withColumn("met", F.lit(1)))

    rows = docs.select(row_key(doc_id, text).alias("rk"), F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    prints = _minima(_hashed(rows)).select("rk", "doc_id", "n_words", F.posexplode_outer(F.array_distinct("fp")).alias("at", "fp"))
    # the rows of a document come one after another, so they are one row before the shuffle
    seen = stage(_met(prints, marks, ["fp"], "left").groupBy("rk", "doc_id", "n_words").agg(
        F.max("met").alias("met"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("rows")))
    # a row that is repeated in the table was judged once and comes out as often as it went in
    each = F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int")))
    if windows is None:
        return seen.withColumn("_row", each).select("rk", "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    windows = stage(windows.distinct())

    wanted = seen.filter("met = 1").select("rk").distinct()
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.select(row_key(doc_id, text).alias("rk"), F.col(text).alias("text"))
    near = texts.join(F.broadcast(wanted) if few else wanted, "rk", "left_semi")
    hits = None
    for source, which in ((near, [n for n in lengths if n >= SPAN]), (texts, [n for n in lengths if n < SPAN])):
        if not which:
            continue
        df = _hashed(source.select("rk", words_of(F.col("text")).alias("words")))
        for n in which:
            df = _gram(df, n)
        for n in which:
            own = df.select("rk", F.lit(n).alias("len"), F.posexplode_outer(f"g{n}").alias("place", "g"))
            own = _met(own, windows, ["len", "g"], "inner")
            hits = own if hits is None else hits.unionByName(own)
    hits = stage(hits.select("rk", "len", "place", "item").distinct())
    covered = hits.select("rk", "len", "place").distinct().select("rk", F.explode(F.sequence("place", F.col("place") + F.col("len") - 1)).alias("word")).distinct()
    n_hit = covered.groupBy("rk").agg(F.count(F.lit(1)).alias("n_hit"))
    found = hits.select("rk", "item").distinct().groupBy("rk").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = seen.join(n_hit.join(found, "rk"), "rk", "left").withColumn("_row", each)
    return out.select("rk", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def row_key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.col(text))


def contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
