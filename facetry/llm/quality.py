"""Quality rules with a hashed n-gram log-likelihood ratio [native].

Base rules count words, symbols, repeated lines and words inside repeated 8-word windows. The model
compares two multinomials over ``buckets`` hashed word 1- and 2-grams: one from all documents (raw),
one from the trusted target (documents of a bounded, hash-ordered sample of labels with quality 1).
A document's score is the mean of log p_target - log p_raw over its n-grams; every document with a
score under the threshold is rejected, without drawing lots. One half of the sample makes the target
multinomial; the threshold is ``margin`` below the ``lowest`` quantile of the other half's scores, so
that documents the model has not seen pass as trusted ones do.

Only the two count tables (``buckets`` rows, whatever the input) reach the driver. Edge cases: null
and empty texts have no words and fail the base rules; without labels or trusted documents the model
accepts everything; labels of absent documents and repeated label rows change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.session import cut

SPACE = r"[\x20\x09-\x0D]+"


def bound(value: Column, body) -> Column:
    """body(x) with x = value evaluated once a row (a lambda variable is never inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def neighbours(h: Column, step: int = 1) -> Column:
    """Hashes of each element of ``h`` with the one ``step`` places on."""
    n = F.size(h) - step
    return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def repeated_words(words: Column, n: int = 8) -> Column:
    """Words inside n-word windows (n a power of two) that stand in ``words`` twice or more, the first included."""

    def spread(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        again = bound(
            ordered,
            lambda s: F.array_sort(F.transform(
                F.filter(s, lambda x, j: F.coalesce((x["h"] == F.get(s, j + 1)["h"]), F.lit(False)) | F.when(j > 0, x["h"] == F.get(s, j - 1)["h"]).otherwise(F.lit(False))),
                lambda x: x["i"],
            )),
        )
        return bound(again, lambda at: F.aggregate(
            F.transform(at, lambda p, j: F.least(F.lit(n), F.coalesce(F.get(at, j + 1) - p, F.lit(n))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x))

    def windows(h: Column, width: int = 1) -> Column:
        return h if width == n else windows(bound(h, lambda x: neighbours(x, width)), 2 * width)

    return bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) <= n, F.lit(0).cast("long")).otherwise(
        bound(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(spread(g)))))


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def grams(words: Column, buckets: int, body) -> Column:
    """body(array of the hash buckets of all 1- and 2-grams of the lower-cased words)."""
    b = F.lit(buckets).cast("long")
    return bound(F.transform(words, lambda w: F.xxhash64(F.lower(w))), lambda h: body(F.concat(
        F.transform(h, lambda x: F.pmod(x, b)),
        F.when(F.size(h) > 1, F.transform(neighbours(h), lambda x: F.pmod(x, b))).otherwise(F.array().cast("array<bigint>")),
    )))


def trusted_ids(labels: DataFrame, most: int = 20_000) -> DataFrame:
    """At most ``most`` ids with quality 1, those of the smallest hash: the bounded labelled sample."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """One row, column ``ratios``: log p_target - log p_raw by bucket (add-one smoothed in the raw's proportions)."""
    counted = (
        docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("_t", F.lit(1))), "doc_id", "left")
        .select("_t", F.explode(grams(words_of(F.col("text")), buckets, lambda g: g)).alias("b"))
        .groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("_t").alias("target"))
    )
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "b").join(counted, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    row = every.agg(F.sum("raw").alias("n"), F.sum("target").alias("m"), F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("c"))
    # Target counts are smoothed by one pseudo-count a bucket on average, spread as the raw corpus is.
    return row.select(F.transform("c", lambda x: F.when(F.col("m") == 0, F.lit(0.0)).otherwise(
        F.log((x["target"] + buckets * (x["raw"] + 1.0) / (F.col("n") + buckets)) / (F.col("m") + buckets)) - F.log((x["raw"] + 1.0) / (F.col("n") + buckets)))).alias("ratios"))


def mean_ratio(words: Column, buckets: int) -> Column:
    """Mean of the column _ratios over the words' n-grams; 0 without words."""
    return grams(words, buckets, lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get("_ratios", b.cast("int"))) / F.size(g)))


def measures(buckets: int) -> Column:
    """Struct of all measures of ``text``, given the column _ratios."""

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"), mean_ratio(words, buckets).alias("llr"))

    text = F.coalesce(F.col("text"), F.lit(""))
    rest = F.struct(F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines"))
    return F.struct(bound(words_of(F.col("text")), of).alias("words"), rest.alias("rest"))


def judged(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 16, lowest: float = 0.005, margin: float = 0.05, most: int = 20_000) -> DataFrame:
    """``docs`` with a struct column _quality: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr, cut, base_failed, kept."""
    trusted = cut(trusted_ids(labels, most))
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    ratios = cut(log_ratios(docs, trusted.where(half == 0), buckets))
    table = ratios.scalar()  # Catalyst folds the one-row subquery into the expression that uses it: no row carries the table.
    held = docs.select("doc_id", "text").join(F.broadcast(trusted.where(half == 1)), "doc_id", "left_semi").withColumn("_ratios", table)
    scored = held.select(bound(words_of(F.col("text")), lambda w: F.when(F.size(w) >= 20, mean_ratio(w, buckets))).alias("llr"))
    limit = cut(scored.agg((F.percentile("llr", lowest) - margin).alias("cut")))

    def verdict(m: Column) -> Column:
        w, r = m["words"], m["rest"]
        failed = (w["n_words"] < 20) | (100 * w["n_repeat_words"] > 30 * w["n_words"])
        return F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), r["n_symbols"].alias("n_symbols"), r["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
            w["llr"].alias("llr"), F.col("_cut").alias("cut"), failed.alias("base_failed"), (~failed & F.coalesce(w["llr"] >= F.col("_cut"), F.lit(True))).alias("kept"))

    # One expression for the whole verdict: a filter on one of its fields is pushed down as one evaluation.
    return docs.withColumn("_ratios", table).withColumn("_cut", limit.scalar()).withColumn("_quality", bound(measures(buckets), verdict)).drop("_ratios", "_cut")


def score(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """doc_id and the measures and verdicts of every row."""
    return judged(docs.select("doc_id", "text"), labels, **kw).select("doc_id", "_quality.*")


def kept_documents(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns, whatever their names."""
    held = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_whole"))
    return judged(held, labels, **kw).where("_quality.kept").select(*[F.col("_whole")[c].alias(c) for c in docs.columns])
