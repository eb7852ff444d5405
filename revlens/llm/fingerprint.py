"""Order MinHash fingerprints (DataFrame operations only).

A text's k-mers are its runs of ``K`` words, each numbered by how often it occurred before.
The numbered k-mers are hashed; ``BINS`` equal ranges of the hash each select their minimal
one (one-permutation form of the independent orders). Each selected k-mer is paired with
that of the next filled range, the pair is put in the order of the text, and the ordered
pair is hashed. A bin agrees between two texts only if both k-mers are selected in both and
stand in the same order, so likeness falls with edits and with moved passages alike.

All of it is array work inside the row, on 64-bit numbers: the upper 40 bits are a k-mer's
hash and the lower 24 its place, so that plain number sorts group and order them (places
from 2^24 words on count as one place).

Defined cases: null text counts as empty; a text of fewer than K words has one k-mer; a
text without words has an empty fingerprint, and two empty fingerprints are alike (1.0);
documents follow each other by ``doc_id`` descending, null last, equal ids by the text's
hash, rows equal in both one after another; the smallest long stands for null; a single document is its own next; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm.common import WORD, cut, documents, range_blocks

K = 2
BINS = 64
EMPTY = "...."
_PLACE = 24
_LOW = (1 << _PLACE) - 1


def _with_place(h: Column, at: Column) -> Column:
    return h.bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.least(at.cast("long"), F.lit(_LOW)))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``BINS`` groups of four hex digits, ``EMPTY`` for an empty bin."""
    names = [f"`{c}`" for c in df.columns]
    place = lambda x: F.shiftright(x, 64 - (BINS.bit_length() - 1)).cast("int")
    hash_of = lambda x: F.shiftright(x, _PLACE)
    at_of = lambda x: x.bitwiseAND(F.lit(_LOW))

    d = df.select(*names, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0)).alias("__w"))
    starts = F.sequence(F.lit(0), F.size("__w") - K)
    grams = F.transform(starts, lambda i: _with_place(F.xxhash64(*[F.get("__w", i + k) for k in range(K)]), i))
    short = F.when(F.size("__w") > 0, F.array(_with_place(F.xxhash64("__w"), F.lit(0))))
    none = F.array().cast("array<bigint>")
    d = d.select(*names, F.sort_array(F.when(F.size("__w") >= K, grams).otherwise(F.coalesce(short, none))).alias("__g"))
    # equal k-mers are neighbours now, in the order of the text; a run's first stands at __run
    d = d.select(*names, "__g", F.transform("__g", hash_of).alias("__h"))
    new = F.filter(
        F.transform("__h", lambda h, j: F.when((j == 0) | (h != F.get("__h", j - 1)), j)), lambda j: j.isNotNull()
    )
    d = d.select(*names, "__g", "__h", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), new).alias("__run"))
    zero = F.lit(0).cast("long")
    single = F.transform("__g", lambda g: _with_place(F.xxhash64(hash_of(g), zero), at_of(g)))

    def run(j: Column, r: Column) -> Column:
        last = F.coalesce(F.get("__run", r + 1), F.size("__g")) - 1
        number = lambda i: F.xxhash64(F.get("__h", i), (i - j).cast("long"))
        return F.transform(F.sequence(j, last), lambda i: _with_place(number(i), at_of(F.get("__g", i))))

    numbered = F.when(F.col("__run").isNull(), single).otherwise(F.flatten(F.transform("__run", run)))
    d = d.select(*names, F.sort_array(numbered).alias("__x"))
    least = F.filter("__x", lambda x, j: (j == 0) | (place(x) != place(F.get("__x", j - 1))))
    d = d.select(*names, least.alias("__min"))

    def pair(x: Column, r: Column) -> Column:
        y = F.get("__min", F.pmod(r + 1, F.size("__min")))
        a, b = F.when(at_of(x) <= at_of(y), x).otherwise(y), F.when(at_of(x) <= at_of(y), y).otherwise(x)
        digest = F.xxhash64(hash_of(a), hash_of(b)).bitwiseAND(F.lit(0xFFFF))
        return F.lower(F.lpad(F.hex(digest), 4, "0"))

    d = d.select(*names, F.transform("__min", pair).alias("__pair"), F.transform("__min", place).alias("__bin"))
    bins = F.sequence(F.lit(-(BINS // 2)), F.lit(BINS // 2 - 1))
    one = lambda b: F.coalesce(F.get("__pair", (F.array_position("__bin", b) - 1).cast("int")), F.lit(EMPTY))
    # Each array is named twice: an array named once, inside a lambda, would be put in place of
    # its name by the optimiser and computed anew for every element.
    ready = (F.size("__pair") >= 0) & (F.size("__bin") >= 0)
    return d.select(*names, F.when(ready, F.array_join(F.transform(bins, one), "")).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing bins among those that either fingerprint fills; 1 if both are empty."""
    digits = len(EMPTY)
    group = lambda s, i: F.substr(s, i * digits + 1, F.lit(digits))
    bins = F.sequence(F.lit(0), F.lit(BINS - 1))
    filled = F.size(F.filter(bins, lambda i: (group(a, i) != EMPTY) | (group(b, i) != EMPTY)))
    alike = F.size(F.filter(bins, lambda i: (group(a, i) == group(b, i)) & (group(a, i) != EMPTY)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(alike / filled)


def successors(classes: DataFrame) -> DataFrame:
    """For each of ``classes`` (k, tie, n, c; one row per distinct document): half its length, the
    class it follows (to_k, to_tie) and half of that one's length (give).

    The order is cut into blocks of bounded size; a block's first row follows the last of the
    block before, the very first row the very last. Only one row per block is compared globally.
    """
    order = (F.col("k").desc(), F.col("tie"))
    b = range_blocks(classes, "omh-order", *order).withColumn("half", F.floor(F.col("n") / 2))
    inside = Window.partitionBy("block").orderBy(*order)
    one = F.struct("k", "tie", "half")
    b = cut(b.select("block", "k", "tie", "c", "half", F.lag(one).over(inside).alias("before"), F.row_number().over(inside).alias("at")), "omh-lags")
    last = b.groupBy("block").agg(F.max_by(one, "at").alias("last"))
    ring = Window.orderBy("block")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = last.select("block", F.coalesce(F.lag("last").over(ring), F.last("last").over(whole)).alias("wrap"))
    to = F.coalesce("before", "wrap")
    return b.join(last, "block").select(
        "k", "tie", "c", "half", to["k"].alias("to_k"), to["tie"].alias("to_tie"), to["half"].alias("give")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint per document."""
    return with_fingerprint(docs.select("doc_id", "text"), "text", "fingerprint").select("doc_id", "fingerprint")


def edited(docs: DataFrame) -> DataFrame:
    """The contract's rows: each document against its edited text and the next document."""
    # A document's key is its id and its text's hash: rows alike in both are one class of c rows.
    text = F.coalesce("text", F.lit(""))
    none = F.lit(-(1 << 63))  # stands for a null doc_id, sorts last
    key = F.coalesce(F.col("doc_id").cast("long"), none)
    plain = docs.select(text.alias("text"), key.alias("k"), F.xxhash64(text).alias("tie"))
    sizes = plain.select("k", "tie", F.length("text").cast("long").alias("n"))
    order = cut(successors(sizes.groupBy("k", "tie").agg(F.max("n").alias("n"), F.count("*").alias("c"))), "omh-next")
    # Texts are dealt by key once: both uses of ``placed`` need the same three columns of
    # ``plain``, so that they read one exchange.
    placed = plain.join(order, ["k", "tie"])
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy("k", "tie").orderBy("k")))
    placed = with_fingerprint(placed, "text", "fingerprint")
    gives = placed.where("nth = 1").select(
        F.col("to_k").alias("k"),
        F.col("to_tie").alias("tie"),
        F.left("text", F.col("give").cast("int")).alias("given"),
        F.col("fingerprint").alias("given_fingerprint"),
    )
    own = placed.select("text", "fingerprint", "k", "tie", "half", "nth", "c").join(gives, ["k", "tie"])
    alike = F.col("nth") < F.col("c")  # followed by the next row of its own class
    own = own.select(
        F.when(F.col("k") != none, F.col("k")).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        "text",
        "fingerprint",
        F.length("text").cast("long").alias("n_chars"),
        "half",
        F.when(alike, F.left("text", F.col("half").cast("int"))).otherwise(F.col("given")).alias("prefix"),
        F.when(alike, F.col("fingerprint")).otherwise(F.col("given_fingerprint")).alias("next_fingerprint"),
    )
    new = F.concat(F.left("text", (F.col("n_chars") - F.col("half")).cast("int")), "prefix")
    own = own.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", new.alias("edited"))
    out = with_fingerprint(own, "edited", "edited_fingerprint")
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(documents(spark, sf_dir))
