"""Joins of names by likeness without comparing all pairs: by substring, and by few edits.

By substring: each name is posted under its runs of three characters; a wanted string that a name holds has its rarest
run among the name's, so an equi-join on that run finds all candidates, and the exact test follows.

By edits: a name of four letters or more is cut into MAX_EDITS + 1 segments. Within MAX_EDITS edits of it at least one
segment stays whole and moves by at most as many places, so an equi-join of segments with the pieces of the other
string that could be one finds all candidates. Shorter names have no such segments; there both sides are posted under
what is left when up to MAX_EDITS letters are deleted. Levenshtein's distance decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_EDITS = 3
GRAM = 3


def characters(text: Column | str) -> Column:
    """The characters of a text; none of an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def once(value: Column, use) -> Column:
    """use(value) with the value computed once a row; written into a lambda, an expression is computed anew each time."""
    return F.transform(F.array(value), use)[0]


def grams(chars: Column, size: Column | int) -> Column:
    """Distinct runs of `size` characters, given as an array."""
    size = F.lit(size) if isinstance(size, int) else size
    none = F.array().cast("array<string>")

    def runs(c: Column, n: Column) -> Column:
        return F.when(F.size(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), "")))).otherwise(none)

    return once(chars, lambda c: once(size, lambda n: runs(c, n)))


def containing(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, wanted: all distinct pairs in which the name holds the wanted string, in any case; neither is empty."""
    names = names.select("name").where("name <> ''").distinct().withColumn("__low", F.lower("name"))
    asked = wanted.select("wanted").where("wanted <> ''").distinct().withColumn("__want", F.lower("wanted"))
    size = F.least(F.lit(GRAM), F.size(characters("__want")))
    sizes = sorted(r[0] for r in asked.select(size.alias("n")).distinct().collect())  # at most GRAM of them
    posted = None
    for n in sizes:
        part = names.select("name", "__low", F.explode(grams(characters("__low"), n)).alias("gram"))
        posted = part if posted is None else posted.unionByName(part)
    if posted is None:
        return names.select("name", F.lit("").alias("wanted")).limit(0)
    often = posted.groupBy("gram").agg(F.count("*").alias("__n"))
    probes = asked.select("wanted", "__want", F.explode(grams(characters("__want"), size)).alias("gram"))
    rarest = probes.join(often, "gram", "left").groupBy("wanted", "__want").agg(F.min_by("gram", F.struct(F.coalesce("__n", F.lit(0)), "gram")).alias("gram"))
    return posted.join(rarest, "gram").where(F.contains("__low", F.col("__want"))).select("name", "wanted")


def _segments(chars: Column, length: Column) -> Column:
    """Of a name of `length` characters its segments, keyed by length and place."""
    parts = F.lit(MAX_EDITS + 1)
    start = lambda i: F.floor(i * length / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(MAX_EDITS)), lambda i: F.concat_ws(":", length.cast("string"), i.cast("string"), F.array_join(F.slice(chars, start(i) + 1, start(i + 1) - start(i)), "")))


def _pieces(chars: Column, length: Column) -> Column:
    """What could be a segment of a name within MAX_EDITS edits: pieces at places that differ by at most as much."""
    parts = F.lit(MAX_EDITS + 1)
    shifts = F.sequence(F.lit(-MAX_EDITS), F.lit(MAX_EDITS))

    def of_segment(other: Column, i: Column) -> Column:
        start = F.floor(i * other / parts).cast("int")
        size = F.floor((i + 1) * other / parts).cast("int") - start
        fits = F.filter(shifts, lambda d: (start + d >= 0) & (start + d + size <= length))
        return F.transform(fits, lambda d: F.concat_ws(":", other.cast("string"), i.cast("string"), F.array_join(F.slice(chars, start + d + 1, size), "")))

    lengths = F.filter(F.sequence(length - MAX_EDITS, length + MAX_EDITS), lambda n: n > MAX_EDITS)
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(MAX_EDITS)), lambda i: of_segment(n, i))))))


def _deletions(chars: Column, length: Column) -> Column:
    """What is left of a short text when up to MAX_EDITS of its characters are deleted: by a bit mask of those kept."""
    masks = F.filter(F.sequence(F.lit(0), F.shiftleft(F.lit(1), 2 * MAX_EDITS) - 1), lambda m: (F.shiftrightunsigned(m.cast("long"), 0) < F.pow(F.lit(2), length)) & (F.bit_count(m) >= length - MAX_EDITS))
    return F.array_distinct(F.transform(masks, lambda m: F.concat(F.lit("d:"), F.array_join(F.filter(chars, lambda c, i: F.getbit(m, i) == 1), ""))))


def near(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, wanted and edits: all distinct pairs of at most MAX_EDITS edits."""
    none = F.array().cast("array<string>")
    sized = lambda df, c: df.select(c).where(F.col(c).isNotNull()).distinct().withColumn("__chars", characters(c)).withColumn("__size", F.size("__chars"))
    of_name = lambda c, n: F.when(n > MAX_EDITS, _segments(c, n)).otherwise(_deletions(c, n))
    of_wanted = lambda c, n: F.concat(_pieces(c, n), F.when(n <= 2 * MAX_EDITS, _deletions(c, n)).otherwise(none))
    keys = lambda df, c, of: df.select(c, F.explode(once(F.col("__chars"), lambda x: once(F.col("__size"), lambda n: of(x, n)))).alias("key"))
    posted, asked = keys(sized(names, "name"), "name", of_name), keys(sized(wanted, "wanted"), "wanted", of_wanted)
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # all of them: a few bytes of keys stand for many pairs
    pairs = posted.repartition(parts, "key").join(asked, "key").select("name", "wanted")  # few of them pass the test, so it comes before distinct()
    return pairs.withColumn("edits", F.levenshtein("name", "wanted", MAX_EDITS)).where("edits >= 0").distinct()
