"""One-permutation MinHash fingerprints with optimal densification, in Spark's own functions only.

The distinct-or-not five-word shingles of a text are hashed once; the top bits of a hash are its bin, the rest its value, and a
bin keeps its least value. An empty bin takes the value of a bin chosen by a universal hash of the bin and the
attempt, tried until a full one is found (after ``ATTEMPTS`` tries the full bin that a hash of both ranks first). Of
every value the low four bits are kept, as one hexadecimal digit; ``likeness`` corrects for digits that agree by chance.

Words are maximal runs of other than white space, lower-cased; a text with fewer than five words has its whole sequence as one shingle. A
text without words, or null, has the empty fingerprint: like another empty one (1.0), unlike any other (0.0). Equal texts
have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.llm.common import let, materialize

WORDS, BINS, BITS = 5, 256, 4
FIRST_ATTEMPTS, ATTEMPTS = 8, 64
_VALUE = (1 << 56) - 1


def _empty() -> Column:
    return F.lit(-1).cast("long")


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """Hashes of all n-word shingles; none without words."""
    blank = F.lit(" \t\n\x0b\x0c\r")
    trimmed = F.btrim(F.lower(text), blank)
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))

    def of(w: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, several).when(F.size(w) > 0, F.array(F.xxhash64(w, F.size(w)))).otherwise(
            F.array().cast("array<bigint>"))

    return let(words, of)


def bins(hashes: Column) -> Column:
    """The least value of each bin in bin order, -1 for empty bins. A sentinel above all values stands in every bin."""
    # signed order keeps the hashes of a bin together: bins 128 to 255, then 0 to 127
    ends = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), 56).bitwiseOR(F.lit(_VALUE)))
    return let(
        F.array_sort(F.concat(hashes, ends)),
        lambda s: F.transform(
            F.filter(s, lambda h, i: (i == 0) | (F.shiftrightunsigned(h.bitwiseXOR(F.get(s, i - 1)), 56) != 0)),
            lambda h: F.when(h.bitwiseAND(F.lit(_VALUE)) == F.lit(_VALUE), _empty()).otherwise(h.bitwiseAND(F.lit(_VALUE))),
        ),
    )


def densified(values: Column) -> Column:
    """Fills the empty bins; at least one bin is full."""

    def tried(state: Column, base: Column, low: int, high: int) -> Column:
        def once(now: Column, attempt: Column) -> Column:
            filled = F.transform(now, lambda v, i: F.when(
                v == _empty(), F.get(base, F.pmod(F.xxhash64(attempt, i), F.lit(BINS)).cast("int"))).otherwise(v))
            return F.when(F.array_contains(now, _empty()), filled).otherwise(now)

        return F.aggregate(F.sequence(F.lit(low), F.lit(high)), state, once)

    def rest(state: Column, base: Column) -> Column:
        full = F.filter(F.transform(base, lambda v, j: F.struct(v.alias("v"), j.alias("j"))), lambda x: x["v"] != _empty())

        def ranked(full: Column) -> Column:
            return F.transform(state, lambda v, i: F.when(v == _empty(), F.array_min(F.transform(
                full, lambda x: F.struct(F.xxhash64(i, x["j"], F.lit(7)).alias("h"), x["v"].alias("v"))))["v"]).otherwise(v))

        return let(full, ranked)

    def fill(base: Column) -> Column:
        return let(tried(base, base, 1, FIRST_ATTEMPTS), lambda a: F.when(
            F.array_contains(a, _empty()),
            let(tried(a, base, FIRST_ATTEMPTS + 1, ATTEMPTS), lambda b: F.when(F.array_contains(b, _empty()), rest(b, base)).otherwise(b)),
        ).otherwise(a))

    return let(values, fill)


def fingerprint(text: Column, n: int = WORDS) -> Column:
    """256 hexadecimal digits, or nothing for a text without words."""
    digits = F.array(*[F.lit(d) for d in "0123456789abcdef"])
    return let(shingle_hashes(F.coalesce(text, F.lit("")), n), lambda h: F.when(
        F.size(h) > 0,
        F.array_join(F.transform(densified(bins(h)), lambda v: F.get(digits, v.bitwiseAND(F.lit(15)).cast("int"))), ""),
    ).otherwise(F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1: agreeing digits, less those that agree by chance."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 1.0 / (1 << BITS)
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (same / F.lit(float(BINS)) - chance) / (1 - chance))))


def ranges(df: DataFrame, key: str, n: int) -> list:
    """Least keys of about ``n`` ranges of like numbers of rows, in order; ``n`` is bounded by the number of shuffle partitions."""
    ranged = materialize(df.where(F.col(key).isNotNull()).select(key).repartitionByRange(n, key).withColumn("range", F.spark_partition_id()))
    return sorted(r["least"] for r in ranged.groupBy("range").agg(F.min(key).alias("least")).collect())


def range_of(key: Column, bounds: list) -> Column:
    """Number of the last bound that is not above the key (null: 0), by binary search."""
    table = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, (len(bounds) - 1).bit_length())))])
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step) <= key, at + step).otherwise(at)), F.lit(0))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text (null: empty) and next (text of the row after, by key, then text, nulls first; after the last the first).

    Rows are dealt to ranges of keys once; a range's last row gets the first text of the next range from a table of
    one row per range.
    """
    base = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = ranges(base, "key", 4 * n) or [0]
    ranged = base.withColumn("range", range_of(F.col("key"), bounds))
    along = Window.partitionBy("range").orderBy("key", "text")
    within = ranged.withColumn("next", F.lead("text").over(along))
    leasts = base.where(F.col("key").isNull() | F.col("key").isin(bounds)).withColumn("range", range_of(F.col("key"), bounds))
    firsts = materialize(leasts.groupBy("range").agg(F.min(F.struct("key", "text")).alias("first")))
    # the range before; before the first comes the last
    firsts = firsts.select(F.when(F.col("range") == 0, len(bounds) - 1).otherwise(F.col("range") - 1).alias("range"), F.col("first.text").alias("after"))
    return within.join(firsts, "range", "left").select("key", "text", F.coalesce("next", "after").alias("next"))


def edited_fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every row's fingerprint and that of its edited text, whose last quarter is the beginning of the next document.

    Returns ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Documents come by key (nulls
    first), rows of one key by their text; after the last comes the first. A lone document is its own next one.
    """
    quarter = "cast(floor(char_length(text) / 4) AS int)"
    edited = with_next(docs, key, text).withColumn("edited", F.expr(
        f"concat(substring(text, 1, char_length(text) - {quarter}), substring(next, 1, {quarter}))"))
    prints = materialize(edited.select(
        "key", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"),
        F.xxhash64("text").alias("own_hash"), F.xxhash64("next").alias("next_hash")))
    by_text = prints.groupBy("own_hash").agg(F.first("fingerprint").alias("next_fingerprint"))  # equal texts, equal fingerprints
    joined = prints.join(by_text.withColumnRenamed("own_hash", "next_hash"), "next_hash")
    return joined.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
