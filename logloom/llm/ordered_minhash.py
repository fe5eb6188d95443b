"""Document fingerprints: Order MinHash over word k-mers, in built-in functions only.

1. A text's words (split at white space) give k-mers of `K` words (the last
   ones shorter, so that every text has some). Every k-mer gets its occurrence
   number, so the second "a b c" differs from the first.
2. A first occurrence hashes as the k-mer alone, a later one with its number.
3. Each of `ENTRIES` hashes ranks all occurrence-numbered k-mers of the text and
   picks its `TUPLE` minimal ones; they are put in text order, and the hash of
   that tuple is one entry of the signature.

Signatures are sensitive to order as well as content, as edit distance is. The
likeness of two signatures is the share of their entries that agree.

Everything happens inside one row on arrays, in projections that each keep what
the next ones use more than once: no k-mer ever becomes a row, minima, sorts and
distincts run on primitive longs, and only k-mers that repeat reach the
numbering, which is linear however often one k-mer repeats.

Defined results: null counts as empty; an empty text is one empty k-mer, so all
empty texts agree with each other; equal texts have equal signatures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, ENTRIES, TUPLE = 3, 20, 2
#: Rows whose order is settled by one sort when each document is given its successor.
BUCKET_ROWS = 2048

LOW = (1 << 32) - 1


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, whatever lambdas in body refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def run_starts(sorted_: Column, same) -> Column:
    """The indexes from 0 at which a run of equal elements begins."""
    return F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | ~same(F.get(sorted_, i), F.get(sorted_, i - 1)))


def by_run(sorted_: Column, same, each) -> Column:
    """each(element, place in its run from 0) of all elements."""

    def runs(s: Column, starts: Column) -> Column:
        end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(s)) - 1
        return F.flatten(F.transform(starts, lambda a, j: F.transform(F.sequence(a, end(j)), lambda i, n: each(F.get(s, i), n))))

    return let(sorted_, lambda s: let(run_starts(s, same), lambda starts: runs(s, starts)))


def numbered_hash(kmer: Column, occurrence: Column) -> Column:
    return F.when(occurrence == 0, kmer).otherwise(F.xxhash64(kmer, occurrence))


def with_signature(df: DataFrame, text: str, out: str, k: int = K, entries: int = ENTRIES) -> DataFrame:
    """`df` with array<int> `out` of `entries` numbers, the signature of column `text`."""
    rest = df.columns
    df = df.withColumn("_w", F.split(text, r"[\x20\x09-\x0D]+"))
    df = df.select(*rest, F.transform("_w", lambda w, i: F.xxhash64(w, *[F.get("_w", i + j) for j in range(1, k)])).alias("_h"))
    df = df.withColumn("_u", F.array_distinct("_h"))
    repeats = F.size("_u") < F.size("_h")
    df = df.withColumn("_s", F.when(repeats, F.sort_array("_h")))
    df = df.withColumn("_e", F.filter("_s", lambda x, i: (i > 0) & (x == F.get("_s", i - 1))))
    # Later occurrences, by k-mer; all that are ranked are the first ones, in text order, and these.
    df = df.withColumn("_l", F.when(F.size("_e") > 0, by_run(F.col("_e"), lambda a, b: a == b, lambda x, n: F.struct(x.alias("x"), F.xxhash64(x, n + 1).alias("key")))))
    df = df.withColumn("_k", F.when(repeats, F.concat("_u", F.col("_l.key"))).otherwise(F.col("_h")))

    def least(j: Column) -> Column:
        """The places from 1 in _k of the TUPLE k-mers that hash j ranks first."""

        def places(ranks: Column) -> Column:
            place = lambda m: F.array_position(ranks, m).cast("int")
            second = lambda m: F.array_min(F.array_remove(ranks, m))
            return let(F.array_min(ranks), lambda m: F.array_compact(F.array(place(m), place(second(m)))))

        return let(F.transform("_k", lambda c: F.xxhash64(c, j)), places)

    df = df.withColumn("_p", F.transform(F.sequence(F.lit(1), F.lit(entries)), least))
    late = F.filter(F.flatten("_p"), lambda q: q > F.size("_u"))
    df = df.withColumn("_f", F.when(repeats, F.array_distinct(F.transform(late, lambda q: F.get("_l", q - F.size("_u") - 1)["x"]))))

    def numbered(h: str) -> Column:
        """All occurrences of the k-mers in _f: key and place in the text."""
        found = F.filter(F.transform(h, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda z: F.array_contains("_f", z["x"]))
        return by_run(F.sort_array(found), lambda a, b: a["x"] == b["x"], lambda z, n: F.struct(numbered_hash(z["x"], n).alias("key"), z["i"].alias("i")))

    df = df.withColumn("_n", F.when(F.size("_f") > 0, numbered("_h")))
    df = df.withColumns({"_nk": F.col("_n.key"), "_ni": F.col("_n.i")})

    def entry(picked: Column) -> Column:
        key = lambda q: F.get("_k", q - 1)
        place = lambda q: F.when(~repeats, q).when(q <= F.size("_u"), F.array_position("_h", key(q)).cast("int")).otherwise(F.get("_ni", F.array_position("_nk", key(q)).cast("int") - 1))
        order = F.sort_array(F.transform(picked, lambda q: F.struct(place(q).alias("i"), key(q).alias("key"))))
        return F.shiftright(F.xxhash64(F.transform(order, lambda z: z["key"])), 32).cast("int")

    return df.select(*rest, F.transform("_p", entry).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """The share of entries of two signatures that agree."""
    same = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"] == z["b"])
    return F.size(same).cast("double") / F.size(a)


def as_hex(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(LOW))), 8, "0")), "")


def with_next(docs: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Give each row columns of the next row, keys descending (nulls last), after the last row the first.

    columns: name of the new column -> column it is read from. Equal keys are
    ordered by those columns. The keys' range is cut into buckets of about
    BUCKET_ROWS rows; a row is sent to its own bucket, and the first row of
    each bucket also, as a guest, to the end of the bucket before it. So each
    bucket is sorted by itself and no task sees all keys. Keys that are far
    from evenly spread make uneven buckets, which sort externally.
    """
    lo, hi, n = docs.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    width = 1 if lo is None else max(1, math.ceil((hi - lo + 1) * BUCKET_ROWS / n))
    bucket = F.coalesce(((F.col(key) - F.lit(lo or 0)) / F.lit(width)).cast("long"), F.lit(-1))
    bounds = docs.select(F.col(key).alias("_k"), bucket.alias("_b")).groupBy("_b").agg(F.max("_k").alias("_first"))
    everything = Window.orderBy(F.desc("_b"))  # one row for each bucket
    bounds = bounds.select(F.col("_b").alias("_own"), "_first", F.coalesce(F.lag("_b").over(everything), F.min("_b").over(Window.partitionBy(F.lit(0)))).alias("_guest_of"))
    dealt = docs.withColumn("_b", bucket).join(bounds, F.col("_b") == F.col("_own"))
    places = F.when(
        F.col(key).eqNullSafe(F.col("_first")),
        F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("guest")), F.struct(F.col("_guest_of").alias("b"), F.lit(1).alias("guest"))),
    ).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("guest"))))
    dealt = dealt.withColumn("_place", F.explode(places)).withColumns({"_b": F.col("_place.b"), "_guest": F.col("_place.guest")})
    w = Window.partitionBy("_b").orderBy("_guest", F.desc_nulls_last(key), *columns.values())
    return dealt.withColumns({new: F.lead(old).over(w) for new, old in columns.items()}).where("_guest = 0").drop("_b", "_own", "_first", "_guest_of", "_place", "_guest")


def edited_text(text: Column, next_text: Column) -> Column:
    """The last third of the text's code points replaced by as many (or all) of the next text's first."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(next_text, F.lit(1), third))


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next document's."""
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = with_signature(rows, "_text", "_sig")
    rows = with_next(rows, key, {"_next_text": "_text", "_next_sig": "_sig"})
    rows = rows.select(key, F.char_length("_text").cast("long").alias("n_chars"), "_sig", "_next_sig", edited_text(F.col("_text"), F.col("_next_text")).alias("_edited"))
    rows = with_signature(rows, "_edited", "_edited_sig").withColumn("edited_sha256", F.sha2(F.encode("_edited", "UTF-8"), 256))
    return rows.select(
        key,
        "n_chars",
        "edited_sha256",
        as_hex(F.col("_sig")).alias("fingerprint"),
        as_hex(F.col("_edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("_sig"), F.col("_edited_sig")).alias("near_edited"),
        likeness(F.col("_sig"), F.col("_next_sig")).alias("near_next"),
    )
