"""Mixing sources to target weights by capped water-filling.

``mix`` gives every source a share of a word budget in proportion to its weight,
clamps sources at a maximum number of epochs, reshares the excess by weight until
no source is above its cap, and takes seeded whole and fractional repetitions of
each source's documents.  DataFrame functions only.

The fixed point of "clamp, then reshare" is target = min(cap, level * weight) with
one common level.  Sources are filled in the order of cap / weight, so the level
follows from prefix sums over one row per source.

Edge cases: null or blank text has size 0 and is taken 0 times; a source of size 0
has target 0; a null source is a source of its own, last in order; repeated rows
count each; an empty table gives an empty result.  Clashing extra columns pass
through ``keep`` untouched, since all working columns start with ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def levels(sizes: DataFrame, cycle=(5.0, 2.0, 1.0), budget: float = 1.5, epochs: float = 2.0) -> DataFrame:
    """(_source, _null, _total) per source -> with its ``_target``.

    Windows here run over one row per source, after aggregation.
    """
    rank = W.orderBy("_null", "_source")
    n = F.row_number().over(rank) - 1
    weight = F.element_at(F.array(*map(F.lit, cycle)), (n % len(cycle) + 1).cast("int"))
    s = sizes.select("*", weight.alias("_w"), (F.col("_total") * F.lit(float(epochs))).alias("_cap"))
    order = W.orderBy(F.col("_cap") / F.col("_w"), "_null", "_source")
    done = F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = F.sum("_total").over(W.partitionBy()) * F.lit(float(budget))
    s = s.select("*", ((everything - done) / left).alias("_level"))
    # The first source whose level stays under its cap settles the level of all after it.
    open_ = F.col("_level") * F.col("_w") <= F.col("_cap")
    settled = F.first(F.when(open_, F.col("_level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return s.select(
        "_source", "_null", "_total",
        F.when(settled.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), settled * F.col("_w"))).alias("_target"),
    )


def mix(docs: DataFrame, keep: list[str], seed: int = 7, cycle=(5.0, 2.0, 1.0), budget: float = 1.5, epochs: float = 2.0, bucket_hex: int = 3) -> DataFrame:
    """``keep`` columns of ``docs`` with size, source_size, target, taken, repeats (whole
    repetitions) and part_words (words of one more, partial repetition).

    Documents of a source are ordered by a seeded digest.  A fractional repetition
    takes whole documents in this order and, at the end, part of one, so a source's
    words differ from its target by less than one.  The running sum is taken within
    16^bucket_hex buckets of the digest, on top of sums per bucket: a source with a
    third of all rows still spreads over as many tasks as there are buckets.
    """
    d = docs.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)],
        F.coalesce("source", F.lit("")).alias("_source"),
        F.col("source").isNull().alias("_null"),
        words(F.col("text")).alias("_size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))).alias("_key"),
    ).withColumn("_bucket", F.substring("_key", 1, bucket_hex))
    if "text" not in keep:  # a slim table: written once, so that texts are read and counted once
        d = materialise(d, "mix")
    buckets = d.groupBy("_source", "_null", "_bucket").agg(F.sum("_size").alias("_bsize"))
    by_bucket = W.partitionBy("_source", "_null").orderBy("_bucket")
    ahead = buckets.select(
        "_source", "_null", "_bucket",
        F.coalesce(F.sum("_bsize").over(by_bucket.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"),
    )
    totals = buckets.groupBy("_source", "_null").agg(F.sum("_bsize").alias("_total"))
    plan = ahead.join(levels(totals, cycle, budget, epochs), ["_source", "_null"])
    in_bucket = W.partitionBy("_source", "_null", "_bucket").orderBy("_key", "_size")
    before = F.coalesce(F.sum("_size").over(in_bucket.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("_ahead")
    whole = F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(0).cast("long")
    out = d.join(plan, ["_source", "_null", "_bucket"]).select("*", whole.alias("_whole"), before.alias("_before"))
    rest = F.col("_target") - F.col("_whole") * F.col("_total") - F.col("_before")
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.floor(rest))).cast("long")
    return out.select("*", part.alias("_part")).select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_whole") * F.col("_size") + F.col("_part")).alias("taken"),
        F.col("_whole").alias("repeats"),
        F.col("_part").alias("part_words"),
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0)), F.lit(1), n.cast("int")), "")


def repetitions(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """``mix``'s rows as the mix itself: ``columns``, repetition (from 1) and taken, one row
    per whole or partial repetition; the text of a partial one ends with its last word taken.
    Documents that the mix does not take have no row."""
    n = F.col("repeats") + (F.col("part_words") > 0).cast("long")
    d = mixed.where(F.col("taken") > 0).withColumn("repetition", F.explode(F.sequence(F.lit(1).cast("long"), n)))
    partial = F.col("repetition") > F.col("repeats")
    own = F.when(partial, F.col("part_words")).otherwise(F.col("size"))
    text = F.when(partial & (F.col("part_words") < F.col("size")), first_words(F.col("text"), F.col("part_words"))).otherwise(F.col("text"))
    return d.select(*[text.alias(c) if c == "text" else F.col(c) for c in columns], F.col("repetition").cast("int").alias("repetition"), own.alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS total,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, total * 2.0::DOUBLE AS cap,
         (sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(total * 2.0::DOUBLE) OVER (ORDER BY total * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY total * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM s),
l AS (SELECT min(lev) FILTER (WHERE lev * w <= cap) AS lev FROM (SELECT * FROM o WHERE lev * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1)),
t AS (SELECT source, total, CASE WHEN l.lev IS NULL THEN cap ELSE least(cap, l.lev * w) END AS target FROM o, l),
r AS (
  SELECT d.doc_id, d.size, t.total, t.target, CASE WHEN t.total > 0 THEN floor(t.target / t.total) ELSE 0 END::BIGINT AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, total AS source_size, target, whole AS repeats,
       greatest(0, least(size, floor(target - whole * total - before)))::BIGINT AS part_words,
       (whole * size + greatest(0, least(size, floor(target - whole * total - before))))::BIGINT AS taken
FROM r
"""
