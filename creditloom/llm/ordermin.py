"""Order MinHash fingerprints from DataFrame functions.

A text's words form k-mers; equal k-mers are numbered by occurrence, so that each (k-mer, number) is distinct. One hash
of each is dealt into ``BINS`` ranges of equal width, and of every range the ``PER_BIN`` smallest are selected. The
selected k-mers of a range are put back into text order and hashed together: the signature depends on which k-mers
are minimal and on the order in which the text has them, hence on edit distance rather than on the set alone.

A fingerprint is the list of its ranges' signatures; the likeness of two fingerprints is the share of ranges that agree
among those that either of them fills. Texts shorter than k words are one k-mer.

Everything stays inside the row; no rows are exploded.

Defined results: a null or empty text has an empty fingerprint, and two empty fingerprints have likeness 1. Equal texts
have equal fingerprints. Rows that repeat an id are ordered by text. Rows without id come first. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import SPACE

K = 3
BINS = 64
PER_BIN = 2
MAX_BUCKETS = 1024


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - (BINS.bit_length() - 1))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds column ``name``: one text per filled range, the range in two hexadecimal digits and its signature in twelve."""
    p = f"_{name}_"
    words, hashes, grams, base, nth, keys, chosen = (p + x for x in ("words", "hashes", "grams", "base", "nth", "keys", "chosen"))
    keep = df.columns
    df = df.withColumn(words, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), f"{SPACE}+"), lambda w: w != ""))
    df = df.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias(hashes))
    several = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - K), lambda i: F.xxhash64(*[F.get(F.col(hashes), i + j) for j in range(K)]))
    empty = F.array().cast("array<bigint>")
    df = df.select(*keep, F.when(F.size(hashes) >= K, several).when(F.size(hashes) > 0, F.array(F.xxhash64(F.col(hashes)))).otherwise(empty).alias(grams))
    # Occurrence numbers: in sorted order the copies of a k-mer are neighbours, numbered from the start of their run.
    distinct = F.size(F.array_distinct(grams)) == F.size(grams)
    df = df.select(*keep, grams, distinct.alias(p + "distinct"), F.when(distinct, F.col(grams)).otherwise(F.sort_array(grams)).alias(base))
    n = F.size(base)
    starts = F.filter(F.transform(base, lambda g, i: F.when((i == 0) | ~F.get(F.col(base), i - 1).eqNullSafe(g), i)), lambda i: i.isNotNull())
    df = df.withColumn(p + "starts", F.when(~F.col(p + "distinct"), starts))
    numbers = F.flatten(F.transform(p + "starts", lambda a, r: F.sequence(F.lit(0), F.coalesce(F.get(F.col(p + "starts"), r + 1), n) - a - 1)))
    df = df.select(*keep, grams, base, F.when(~F.col(p + "distinct"), numbers).alias(nth))
    df = df.withColumn(keys, F.transform(base, lambda g, i: F.xxhash64(g, F.coalesce(F.get(F.col(nth), i), F.lit(0)))))
    df = df.withColumn(p + "order", F.sort_array(keys))
    order = F.col(p + "order")
    # Signed order runs through the ranges 32..63, 0..31; ranges stay contiguous.
    df = df.withColumn(chosen, F.filter(order, lambda h, i: (i < PER_BIN) | ~F.coalesce(_bin(F.get(order, i - PER_BIN)) == _bin(h), F.lit(False))))

    def place(h: Column) -> Column:
        """Where in the text the chosen one stands. Values are bound before the inner lambda, which would compute them per element."""

        def look(x: Column) -> Column:
            first = (F.array_position(grams, x["gram"]) - 1).cast("int")
            others = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.get(F.col(grams), i) == x["gram"])
            return F.when(x["number"] == 0, first).otherwise(F.get(others, x["number"]))

        def found(at: Column) -> Column:
            bound = F.struct(F.get(F.col(base), at).alias("gram"), F.coalesce(F.get(F.col(nth), at), F.lit(0)).alias("number"))
            return F.element_at(F.transform(F.array(bound), look), 1)

        return F.element_at(F.transform(F.array((F.array_position(keys, h) - 1).cast("int")), found), 1)

    df = df.withColumn(p + "placed", F.transform(chosen, lambda h: F.struct(place(h).alias("at"), h.alias("h"))))
    placed = F.col(p + "placed")

    def signature(x: Column, i: Column) -> Column:
        own = F.filter(F.slice(placed, i + 1, PER_BIN), lambda y: _bin(y["h"]) == _bin(x["h"]))
        ordered = F.transform(F.array_sort(own), lambda y: y["h"])
        tail = F.substring(F.lpad(F.hex(F.xxhash64(ordered)), 16, "0"), 5, 12)
        begins = (i == 0) | ~F.coalesce(_bin(F.get(placed, i - 1)["h"]) == _bin(x["h"]), F.lit(False))
        return F.when(begins, F.concat(F.lpad(F.hex(_bin(x["h"])), 2, "0"), tail))

    return df.select(*keep, F.filter(F.transform(placed, signature), lambda s: s.isNotNull()).alias(name))


def likeness(a: str, b: str) -> Column:
    ranges = F.array_union(*[F.transform(x, lambda s: F.substring(s, 1, 2)) for x in (a, b)])
    return F.when(F.size(ranges) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(ranges))


def with_next(rows: DataFrame, id_col: str, carried: list[str], buckets: int | None = None) -> DataFrame:
    """Adds ``_next_<column>``: the values of the row that follows by id (and by text among equals), after the last the first's.

    Ids are cut into ranges of about equal size (the cuts are ids, at most ``MAX_BUCKETS`` of them). A range is ranked in
    one task and borrows the first row of the range behind it, so no task sees more than its range.
    """
    spark = rows.sparkSession
    buckets = buckets or min(MAX_BUCKETS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)] or [F.lit(0.5)])
    ends = rows.agg(
        F.min(id_col).alias("low"), F.count_if(F.col(id_col).isNull()).alias("nulls"),
        F.percentile_approx(id_col, shares, F.lit(max(10_000, 10 * buckets))).alias("cuts")).collect()[0]
    cuts = sorted({c for c in ends["cuts"] or [] if c > ends["low"]}) if buckets > 1 else []
    own = F.col(id_col)
    marks = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    bucket = F.coalesce(F.size(F.filter(marks, lambda c: c <= own)), F.lit(0))
    very_first = own.isNull() if ends["nulls"] else own == F.lit(ends["low"])
    homes = F.when(very_first, F.array(F.lit(0), F.lit(len(cuts)))).when(F.array_contains(marks, own), F.array(bucket, bucket - 1)).otherwise(F.array(bucket))
    dealt = rows.select(*rows.columns, F.posexplode(homes).alias("_guest", "_bucket"))
    following = Window.partitionBy("_bucket").orderBy("_guest", F.col(id_col).asc_nulls_first(), "text")
    ahead = {f"_next_{c}": F.lead(c).over(following) for c in carried}
    return dealt.withColumns(ahead).where("_guest = 0").drop("_guest", "_bucket")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    ``edited`` is the text whose last half is replaced by the next text's first characters.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = with_fingerprint(rows, "text", "fingerprint")
    rows = with_next(rows, "_id", ["text", "fingerprint"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next_text"), F.lit(1), half)))
    rows = rows.withColumn("n_chars", n.cast("long")).drop("text", "_next_text")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select(
        F.col("_id").alias(id_col), "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "_next_fingerprint").alias("near_next"))
