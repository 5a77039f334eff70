"""Order MinHash fingerprints, in DataFrame operations only.

The k-mers of a text are its pairs of neighbouring words (code points where there are no spaces), each numbered by its occurrence in the text. K-mer and number
are hashed together and fall into one of 64 classes by that hash; in each class the two smallest are kept, put back
in text order and hashed as a tuple. Moving, inserting or changing text changes tuples in
proportion to the edit distance, and swapping two parts changes them too, which a plain MinHash does not see.
K-mers are told apart by the upper 40 bits of their hash; the place of an occurrence only restores text order.

Defined cases: null is empty; an empty text is one empty word; a text of one word has that word as its k-mer; equal
texts have equal fingerprints; ties of ``doc_id`` are ordered by the texts' hashes; a null id sorts as the smallest; the only row of a table is its own next; further columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from touchline.plans.slices import SLICES, sketch, slice_of
from touchline.session import stage

#: bits of a k-mer's class; low bits of a packed k-mer that hold its place
CLASS_BITS, PLACE_BITS = 6, 24
#: code points of the longest word
LONG = 24
#: rows of a bucket of ids
BUCKET_ROWS = 1 << 10


def units(text: str) -> Column:
    """The words of a text, parted by spaces; one of over LONG code points, as a text without spaces is, counts as its code points."""
    pieces = F.split(text, " ")
    cut = F.flatten(F.transform(pieces, lambda w: F.when(F.char_length(w) > LONG, F.regexp_extract_all(w, F.lit("(?s)."), F.lit(0))).otherwise(F.array(w))))
    return F.when(F.col(text).rlike(f"[^ ]{{{LONG + 1}}}"), cut).otherwise(pieces)


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``, an array of 24-bit entries, one a class that has a k-mer."""
    names = [c for c in df.columns if c != name]
    mask = F.lit(-(1 << PLACE_BITS))

    def kind(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - CLASS_BITS)

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))

    df = df.withColumn("_h", F.transform(units(text), lambda w: F.xxhash64(w)))
    n = F.size("_h")
    pairs = F.zip_with(F.slice("_h", 1, n - 1), F.slice("_h", 2, n - 1), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_k", F.when(n > 1, pairs).otherwise(F.col("_h")))
    last = F.lit((1 << PLACE_BITS) - 1)
    plain = F.transform("_k", lambda x, i: x.bitwiseAND(mask).bitwiseOR(i.cast("long")))
    # beyond 2^24 words neighbouring places share a number
    coarse = F.transform("_k", lambda x, i: x.bitwiseAND(mask).bitwiseOR(F.floor(i * last / F.size("_k")).cast("long")))
    df = df.withColumn("_o", F.sort_array(F.when(F.size("_k") <= 1 << PLACE_BITS, plain).otherwise(coarse)))

    def again(x: Column, i: Column) -> Column:
        """Whether the k-mer is the one before it in ``_o``."""
        return F.coalesce(F.get(F.col("_o"), i - 1).bitwiseAND(mask) == x.bitwiseAND(mask), F.lit(False))

    def numbered(x: Column, o: Column) -> Column:
        return F.xxhash64(F.shiftrightunsigned(x, PLACE_BITS), o).bitwiseAND(mask).bitwiseOR(place(x))

    # a first occurrence keeps the k-mer's hash; of the others, runs are cut out between their first and last
    df = df.withColumn("_a", F.transform("_o", again))
    begins = F.filter(F.transform("_a", lambda a, i: F.when(a & ~F.get(F.col("_a"), i - 1), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform("_a", lambda a, i: F.when(a & ~F.coalesce(F.get(F.col("_a"), i + 1), F.lit(False)), i)), lambda i: i.isNotNull())
    rest = F.flatten(F.zip_with(begins, ends, lambda b, e: F.transform(F.slice("_o", b + 1, e - b + 1), lambda x, o: numbered(x, o + 1))))
    first = F.filter("_o", lambda x, i: ~F.get(F.col("_a"), i))
    df = df.withColumn("_s", F.when(F.exists("_a", lambda a: a), F.sort_array(F.concat(first, rest))).otherwise(F.col("_o")))
    df = df.withColumn("_m", F.filter("_s", lambda x, i: (i < 2) | (kind(F.get(F.col("_s"), i - 2)) != kind(x))))

    def entry(x: Column, i: Column) -> Column:
        y = F.get(F.col("_m"), i + 1)
        pair = y.isNotNull() & (kind(y) == kind(x))
        a, b = F.shiftrightunsigned(x, PLACE_BITS), F.shiftrightunsigned(y, PLACE_BITS)
        both = F.when(place(x) <= place(y), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
        low = F.when(pair, both).otherwise(F.xxhash64(a))
        new = (i == 0) | (kind(F.get(F.col("_m"), i - 1)) != kind(x))
        return F.when(new, F.shiftleft(kind(x), 18).bitwiseOR(low.bitwiseAND(F.lit(0x3FFFF))))

    return df.withColumn(name, F.filter(F.transform("_m", entry), lambda x: x.isNotNull())).select(*names, name)


def rendered(entries: str) -> Column:
    """Six hexadecimal digits an entry."""
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Share of equal entries."""
    return F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.size(a), F.size(b))


def _hash_share(text: str) -> Column:
    """0 to 1 by the hash of a text."""
    return F.xxhash64(text).cast("double") / 18446744073709551616.0 + 0.5


def cuts_of(ids: DataFrame, slices: int = SLICES) -> Row:
    """Quantiles of ``sid``, its least and greatest value and the number of rows; taken once, as a sketch depends on the order of its rows."""
    return ids.agg(sketch("sid", slices).alias("cuts"), F.min("sid").alias("low"), F.max("sid").alias("high"), F.count(F.lit(1)).alias("n")).first()


def placed(rows: DataFrame, found: Row, text: str, most: int = BUCKET_ROWS, slices: int = SLICES) -> DataFrame:
    """``rows`` (of ``sid``) with ``slice`` and ``part``, which follow the order of ids and hold about ``most`` rows together.

    Slices lie between quantiles of the ids, whatever ids there are; an id that is a quantile itself, as one of many rows is, has a
    slice of its own. A slice has parts: by the id's place between the quantiles, or by the text's hash where the id is one.
    """
    cuts = F.array(*[F.lit(c).cast("long") for c in found["cuts"] or [0]])
    low, high, n = found["low"] or 0, found["high"] or 0, found["n"]
    # a slice between two quantiles has a share of the rows, one id may have all
    parts = F.when(F.col("slice") % 2 == 0, F.lit(max(1, -(-n // most)))).otherwise(F.lit(max(1, -(-n // (slices * most)))))
    out = rows.withColumn("slice", slice_of(F.col("sid"), cuts, slices))
    # an odd slice 2 i + 1 lies between cut i - 1 and cut i
    i = F.floor(F.col("slice") / 2).cast("int")
    begin = F.coalesce(F.get(cuts, i - 1), F.lit(low)).cast("double")
    end = F.coalesce(F.get(cuts, i), F.lit(high)).cast("double")
    share = F.when(F.col("slice") % 2 == 0, _hash_share(text)).otherwise((F.col("sid").cast("double") - begin) / F.greatest(end - begin, F.lit(1.0)))
    return out.withColumn("part", F.least(F.greatest(F.floor(share * parts), F.lit(0)), parts - 1).cast("long"))


def next_bucket(rows: DataFrame) -> DataFrame:
    """``slice``, ``part`` of each bucket that has rows, and ``to_slice``, ``to_part`` of the next larger one; the last one's is the first.

    A window holds the parts of one slice, or one row a slice.
    """
    own = rows.select("slice", "part").distinct()
    first = own.groupBy("slice").agg(F.min("part").alias("first"))
    here = F.struct("slice", F.col("first").alias("part"))
    after = first.select("slice", F.lead(here).over(Window.orderBy("slice")).alias("after"), F.min(here).over(Window.partitionBy()).alias("least"))
    inside = F.lead("part").over(Window.partitionBy("slice").orderBy("part"))
    met = own.withColumn("inside", inside).join(after, "slice")
    to = F.when(F.col("inside").isNotNull(), F.struct("slice", F.col("inside").alias("part"))).otherwise(F.coalesce("after", "least"))
    return met.select("slice", "part", to["slice"].alias("to_slice"), to["part"].alias("to_part"))


def with_next(docs: DataFrame, doc_id: str, text: str, carried: list[str]) -> DataFrame:
    """Rows with ``next_<c>`` of the next row by descending id for each of ``carried``; after the last comes the first.

    Each bucket of ids also gets the largest row of the bucket below, so that no row looks beyond its own.
    """
    def keyed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("sid", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)).cast("long")))

    # rows of one id are ordered by their texts' hashes, then by their texts
    order = [F.col("sid"), F.xxhash64(text), F.col(text)]
    found = cuts_of(keyed(docs.select(doc_id)))
    own = placed(keyed(docs), found, text).withColumn("copy", F.lit(False))
    # only ids and texts are read for the largest row of each bucket
    tops = placed(keyed(docs.select(doc_id, text)), found, text).groupBy("slice", "part").agg(F.max(F.struct("sid", F.xxhash64(text).alias("h"))).alias("top"))
    links = stage(tops.join(next_bucket(tops), ["slice", "part"]))
    heads = links.select(F.col("top.sid").alias("sid"), F.col("top.h").alias("h"), "to_slice", "to_part")
    few = heads.limit(1_000_001).count() <= 1_000_000
    lent = own.withColumn("h", F.xxhash64(text)).join(F.broadcast(heads) if few else heads, ["sid", "h"])
    lent = lent.select(*[c for c in own.columns if c not in ("slice", "part", "copy")], F.col("to_slice").alias("slice"), F.col("to_part").alias("part"), F.lit(True).alias("copy"))
    w = Window.partitionBy("slice", "part").orderBy("copy", *[c.desc() for c in order])
    both = own.unionByName(lent)
    both = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
    return both.filter(~F.col("copy")).drop("sid", "slice", "part", "copy")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    base = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(fingerprint(base, "text", "own"), doc_id, "text", ["text", "own"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(doc_id, n.cast("long").alias("n_chars"), "own", "next_own",
                       F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = fingerprint(rows, "edited", "after")
    return rows.select(doc_id, "n_chars", "edited", rendered("own").alias("fingerprint"), rendered("after").alias("edited_fingerprint"),
                       likeness("own", "after").alias("near_edited"), likeness("own", "next_own").alias("near_next"))
