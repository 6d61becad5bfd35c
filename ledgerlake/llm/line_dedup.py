"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line (text between line feeds) goes when an earlier line is near it; earlier: smaller (doc_id, line number). Near: equal, or both of at least ``min_words`` words (split at
white space) and at most one word inserted, deleted or replaced.

1. Equal lines: 128-bit hashes, the earliest occurrence of each (partial aggregation, no text moves).
2. Only a line that shares its first or last words with another line can have a near one (an edit leaves
   one half whole), so the rest emit no variants. This loses nothing.
3. Deletion neighbourhood: each such line emits the hash of itself and of itself without word i, for every
   i. Lines with the same variant *and* the same i differ in word i only, so all of them are near each
   other, and near the line that is the variant itself: each needs to meet but the earliest, and no pairs
   are formed within a group, however large.
4. The edit distance of each line and its candidates is verified on their words.

Lines over ``LONG`` words sum position-keyed word hashes along the line, so that cost stays linear.

Defined cases: null texts stay null; lines without a word are never removed; a document whose every line
with words goes is removed; rows with equal doc_id are one document (equal lines with
equal numbers in them do not remove each other); a null doc_id counts as the largest; extra columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._spark import discard, settle

LONG = 2048
SPACES = " \t\x0b\x0c\r"
LAST = 2**63 - 1


def words(line: Column) -> Column:
    odd = F.lit(False)
    for c in SPACES[1:]:
        odd = odd | line.contains(c)
    return F.array_remove(F.split(F.when(odd, F.translate(line, SPACES[1:], "    ")).otherwise(line), " "), "")


def half_keys(w: Column, n: Column, least: int) -> Column:
    """k0 to k3 (null where none) such that two lines of n or more words, one edit apart, share one: halves for this length and the next."""

    def of(length: Column) -> list[Column]:
        t = F.floor((length - 1) / 4).cast("int") * 2
        return [F.xxhash64(F.lit(0), t, F.slice(w, F.lit(1), t)), F.xxhash64(F.lit(1), t, F.slice(w, n - t + 1, t))]

    same, other = of(n), F.floor((n - 1) / 4) != F.floor(n / 4)
    return F.struct(*[F.when(n >= least, x).alias(f"k{i}") for i, x in enumerate(same)], *[F.when((n >= least) & other, x).alias(f"k{i}") for i, x in enumerate(of(n + 1), 2)])


def variants(lines: DataFrame) -> DataFrame:
    """Rows (v, i, o) of ``lines(o, w, n)``: hash of the line (i = 0) and of the line without word i."""
    i = F.col("i")
    short = lines.filter(F.col("n") <= LONG).select("o", F.transform("w", lambda x: F.xxhash64(x)).alias("x"), "n")
    short = short.select("o", "x", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i"))
    short = short.select("o", "i", F.when(i == 0, F.xxhash64("x")).otherwise(F.xxhash64(F.slice("x", F.lit(1), F.greatest(i - 1, F.lit(0))), F.slice("x", i + 1, F.col("n")))).alias("v"))
    g = lambda salt, j: F.pmod(F.xxhash64(F.lit(salt), F.col("x"), j), F.lit(1 << 40))
    each = lines.filter(F.col("n") >= LONG).select("o", F.posexplode("w").alias("p", "x")).withColumn("p", F.col("p") + 1)
    line = Window.partitionBy("o").orderBy("p")
    sums = lambda salt: F.coalesce(F.sum(g(salt, F.col("p"))).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce(F.sum(g(salt, F.col("p") - 1)).over(line.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    long = each.select("o", F.col("p").alias("i"), F.xxhash64(sums(0), sums(1)).alias("v"))
    whole = each.groupBy("o").agg(F.sum(g(0, F.col("p"))).alias("a"), F.sum(g(1, F.col("p"))).alias("b")).select("o", F.lit(0).alias("i"), F.xxhash64("a", "b").alias("v"))
    return short.select("v", "i", "o").unionByName(long).unionByName(whole)


KEYS = ("k0", "k1", "k2", "k3")


def removed_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """Lines of ``docs(doc_id, text)`` that go: d (doc_id, ``LAST`` for null), line_no (from 0), h1 (hash of the line)."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d")
    text = docs.select(d, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    text = text.filter(F.length(F.ltrim("line", F.lit(SPACES))) > 0)  # a filter on the words would split lines twice
    split = text.select("d", "line_no", "line", words(F.col("line")).alias("w"))
    occurrences = split.select("d", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), half_keys(F.col("w"), F.size("w"), min_words).alias("k"))
    occurrences = settle(occurrences.select("d", "line_no", "h1", "h2", "k.*"))
    order = F.struct("d", "line_no")
    distinct = settle(occurrences.groupBy("h1", "h2").agg(F.min(order).alias("o"), F.max(order).alias("x"), *[F.max(k).alias(k) for k in KEYS]))
    halves = distinct.select("o", "h1", F.explode(F.array(*KEYS)).alias("key")).filter("key is not null")
    shared = halves.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")
    wanted = settle(halves.select("o", "key").join(shared, "key").groupBy("o.d").agg(F.collect_set("o.line_no").alias("at")))
    lines = docs.select(d, "text").filter("text is not null").join(wanted, "d").select("d", "at", F.split("text", "\n").alias("lines"))
    lines = lines.select("d", F.explode("at").alias("line_no"), "lines")
    lines = lines.filter(F.col("line_no") < F.size("lines")).select(order.alias("o"), F.element_at("lines", F.col("line_no") + 1).alias("line"))
    lines = lines.select("o", F.xxhash64("line").alias("h1"), words(F.col("line")).alias("w")).withColumn("n", F.size("w"))
    twice = docs.groupBy(d).agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.isEmpty():  # rows of one doc_id may hold the same line at the same place
        lines = lines.dropDuplicates(["o", "h1"])
    lines = settle(lines.drop("h1"))
    near = settle(variants(lines.filter(F.col("n") >= min_words)))  # only now, or the lines would be split twice
    groups = settle(near.groupBy("v", "i").agg(F.min("o").alias("m"), F.max("o").alias("x")))
    heads = groups.groupBy("v").agg(F.min("m").alias("first"), F.max("x").alias("x"), F.min(F.when(F.col("i") == 0, F.col("m"))).alias("whole"), F.min(F.struct("m", "i")).alias("j")).filter("first < x").drop("x")
    own = F.when(F.col("i") == 0, F.struct(F.col("first").alias("e"), F.col("j.i").alias("k"))).otherwise(F.struct(F.col("m").alias("e"), F.col("i").alias("k")))
    meet = groups.join(heads, "v").select("v", "i", F.explode(F.array(own, F.struct(F.col("whole").alias("e"), F.lit(0).alias("k")))).alias("t")).select("v", "i", "t.*").filter("e is not null")
    pairs = near.join(meet, ["v", "i"]).filter("e < o").groupBy("o", "e").agg(F.min(F.struct("i", "k")).alias("t")).select("o", "e", "t.*")
    both = pairs.join(lines.select("o", "w"), "o").join(lines.select(F.col("o").alias("e"), F.col("w").alias("y")), "e")
    without = lambda a, i: F.when(F.col(i) == 0, F.col(a)).otherwise(F.concat(F.slice(a, F.lit(1), F.greatest(F.col(i) - 1, F.lit(0))), F.slice(a, F.col(i) + 1, F.size(a))))
    near_lines = both.filter(without("w", "i") == without("y", "k")).select("o").distinct()
    gone = distinct.select("h1", "h2", "o", "x").join(near_lines.withColumn("near", F.lit(True)), "o", "left").filter("near or o < x")
    drop = occurrences.select("d", "line_no", "h1", "h2").join(gone, ["h1", "h2"]).filter(F.col("near") | (order != F.col("o")))
    drop = settle(drop.select("d", "line_no", "h1"))
    discard(occurrences, distinct, wanted, lines, near, groups)
    return drop


def dedup_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, and columns n_lines and n_removed after the others (in place of such columns)."""
    drop = removed_lines(docs, min_words).groupBy("d").agg(F.collect_set(F.struct("line_no", "h1")).alias("_drop"))
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"))
    out = row.join(drop, "d", "left").withColumn("_lines", F.split("_row.text", "\n"))
    real = F.transform(F.filter("_drop", lambda x: F.xxhash64(F.element_at("_lines", x["line_no"] + 1)) == x["h1"]), lambda x: x["line_no"])
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), real)
    out = out.withColumn("_drop", F.filter("_drop", lambda x: x["line_no"] < F.size("_lines"))).withColumn("_left", F.when(F.col("_drop").isNotNull(), left))
    text = F.when(F.col("_left").isNull(), F.col("_row.text")).otherwise(F.array_join(F.transform("_left", lambda i: F.element_at("_lines", i + 1)), "\n"))
    n = F.coalesce(F.size("_lines"), F.lit(0)).cast("long")
    removed = F.when(F.col("_left").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_left")).cast("long")
    # The generator holds the new text, so the filter on it can't go below and join the lines twice.
    out = out.select("_row", F.explode(F.array(F.struct(text.alias("text"), n.alias("n_lines"), removed.alias("n_removed")))).alias("_new"))
    out = out.filter((F.col("_new.n_removed") == 0) | F.col("_new.text").rlike(r"[^\x20\x09-\x0D]"))
    kept = [F.col("_new.text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*kept, F.col("_new.n_lines"), F.col("_new.n_removed"))
