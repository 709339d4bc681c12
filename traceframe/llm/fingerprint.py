"""Document fingerprints: one-permutation MinHash in DataFrame functions.

The five-word shingles of a text are hashed once; the top bits of a hash name
its bin and each bin keeps its least hash. Empty bins are filled by optimal
densification: each borrows from the filled bin that comes first in a random
order of bins of its own, the same for all texts. Of every bin's value,
hashed with the bin's number so that borrowers of one value stay independent,
the ``BITS`` low-order bits are packed into a hex string. Chance agreement of the
packed bits is corrected: with a fraction m of equal bins, the likeness is
(m - 2^-BITS) / (1 - 2^-BITS), at least 0.

Defined cases: a null text is empty; texts without words have an all-zero
fingerprint and are like each other only (likeness 1, else 0); fewer than five
words make one shingle; equal texts have equal fingerprints; repeated rows and
null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bind, written

K = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 4
PROBES = 4


def minima(text: Column) -> Column:
    """The least shingle hash of each filled bin, ascending (bins are the top bits)."""
    parts = F.split(F.lower(text), r"[\x20\x09-\x0D]+", -1)

    def words(p: Column) -> Column:  # white space at either end leaves an empty part there
        head = F.when(F.get(p, F.lit(0)) == "", 1).otherwise(0)
        tail = F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)
        return F.transform(F.slice(p, head + 1, F.size(p) - head - tail), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(K)]))
        return F.when(n >= K, many).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    def first_of_bin(h: Column) -> Column:
        shift = 64 - BIN_BITS
        return F.filter(h, lambda x, i: (i == 0) | (F.shiftright(F.get(h, i - 1), shift) != F.shiftright(x, shift)))

    return bind(F.sort_array(bind(bind(parts, words), shingles)), first_of_bin)


def packed(least: Column) -> Column:
    """Low-order bits of all bins as a hex string, a digit for each bin (BITS
    is 4); zeros for a text without words. An empty bin borrows from the first
    filled one of its ``PROBES`` random bins, else from the first in a random order."""
    digits = F.array(*[F.lit(c) for c in "0123456789abcdef"])
    none = F.array().cast("array<string>")

    def fill(m: Column, at: Column) -> Column:
        digit = lambda x, b: F.get(digits, F.pmod(F.xxhash64(x, b), F.lit(1 << BITS)).cast("int"))

        def borrowed(b: Column) -> Column:
            probe = lambda j: F.get(m, F.array_position(at, F.pmod(F.hash(b, F.lit(j)), F.lit(BINS))).cast("int") - 1)
            order = F.transform(m, lambda x, i: F.struct(F.hash(b, F.get(at, i)).alias("o"), F.get(at, i).alias("b"), x.alias("x")))
            return F.coalesce(*[probe(j) for j in range(PROBES)], F.array_min(order)["x"])

        between = lambda lo, hi: F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda b: digit(borrowed(b), b))).otherwise(none)
        runs = F.transform(m, lambda x, i: F.concat(F.array(digit(x, F.get(at, i))),
                                                   between(F.get(at, i) + 1, F.coalesce(F.get(at, i + 1), F.lit(BINS)) - 1)))
        return F.array_join(F.concat(between(F.lit(0), F.get(at, F.lit(0)) - 1), F.flatten(runs)), "")

    bins = lambda m: F.transform(m, lambda x: (F.shiftright(x, 64 - BIN_BITS) + BINS // 2).cast("int"))
    return bind(least, lambda m: F.when(F.size(m) > 0, bind(bins(m), lambda at: fill(m, at))).otherwise(F.lit("0" * BINS)))


def likeness(a: Column, b: Column) -> Column:
    """Corrected share of equal bins of two fingerprints."""
    empty = "0" * BINS
    digits = F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    same = F.size(F.filter(digits, lambda x: x["a"] == x["b"])) / F.lit(float(BINS))
    chance = 2.0 ** -BITS
    return (F.when(a == b, F.lit(1.0)).when((a == empty) | (b == empty), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance))))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a whole text."""
    return packed(minima(text))


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next document in descending order of distinct
    non-null ids, the first after the last. Ids are ranged into blocks, ordered
    within them, and the blocks' ends meet in a table of one row a block."""
    ranged = written(ids.where("doc_id is not null").distinct().repartitionByRange("doc_id")
                     .withColumn("block", F.spark_partition_id()))
    local = ranged.withColumn("below", F.lag("doc_id").over(Window.partitionBy("block").orderBy("doc_id")))
    tops = ranged.groupBy("block").agg(F.max("doc_id").alias("top"))
    carries = written(tops.select("block", F.lag("top").over(Window.orderBy("block")).alias("carry")))
    highest = ranged.agg(F.max("doc_id")).first()[0]
    return (local.join(carries, "block", "left")
            .select("doc_id", F.coalesce("below", "carry", F.lit(highest).cast("long")).alias("next_id")))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text with its fingerprint, the edited text (the last third of its
    code points replaced from the start of the next document) with its
    fingerprint, and the likeness to the edited text and to the next document.

    The next document is the greatest smaller id (after the least, the
    greatest); where that id has several texts, the one of greatest hash speaks
    for it. A row with a null id has no next document: its text loses the last
    third, and near_next is the likeness to an empty text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    prints = written(texts.select("doc_id", "th", F.length("text").cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("fingerprint"))
                     .dropDuplicates(["doc_id", "th"]))
    speakers = prints.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("th", "fingerprint")).alias("s"))
    order = next_ids(prints.select("doc_id"))
    after = order.join(speakers.withColumnRenamed("doc_id", "next_id"), "next_id")
    facts = written(prints.join(after, "doc_id", "left").select(
        "doc_id", "th", "n_chars", "fingerprint", F.floor(F.col("n_chars") / 3).cast("int").alias("third"), "next_id",
        F.col("s.th").alias("next_th"), F.coalesce("s.fingerprint", F.lit("0" * BINS)).alias("next_fingerprint")))
    own = [F.col(c) for c in ("doc_id", "th", "n_chars", "third", "fingerprint", "next_fingerprint")]
    asked = facts.select(*[c.alias(f"a_{n}") for c, n in zip(own, ("doc_id", "th", "n_chars", "third", "fingerprint", "next_fingerprint"))], "next_id", "next_th")
    tails = (texts.join(asked.where("next_id is not null"), texts.doc_id.eqNullSafe(F.col("next_id")) & (texts.th == F.col("next_th")))
             .select(*[F.col(f"a_{n}") for n in ("doc_id", "th", "n_chars", "third", "fingerprint", "next_fingerprint")],
                     F.expr("substring(text, 1, a_third)").alias("tail")).dropDuplicates(["a_doc_id", "a_th"]))
    alone = asked.where("next_id is null").drop("next_id", "next_th").withColumn("tail", F.lit(""))
    paired = texts.join(tails.unionByName(alone), texts.doc_id.eqNullSafe(F.col("a_doc_id")) & (texts.th == F.col("a_th")))
    edited = F.concat(F.expr("substring(text, 1, int(a_n_chars) - a_third)"), F.col("tail"))
    out = paired.select("doc_id", F.col("a_n_chars").alias("n_chars"), edited.alias("edited"), F.col("a_fingerprint").alias("fingerprint"),
                        "a_next_fingerprint")
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return out.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint"))) \
              .withColumn("near_next", likeness(F.col("fingerprint"), F.col("a_next_fingerprint"))).drop("a_next_fingerprint")
