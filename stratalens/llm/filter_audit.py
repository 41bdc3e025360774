"""Filter interaction audit: what five filters remove in every order, by a recursive query over failure masks.

Every document becomes a mask, a bit for each filter that it fails. Documents are counted by part (language) and mask
before anything is enumerated: at most 32 cells a part. The recursion starts with the empty prefix on every mask that
occurs, extends each prefix by every letter that it lacks, and carries the bits applied so far; each level gives what
its step does to a cell (keeps, removes, is redundant on). These rows, a bounded number whatever the input, meet the
counts by mask.

Filters: A under 200 words; B under half of the words distinct; C over 3 % of the code points in A-Z; D any of
``#$%&*|``; E the text of a smaller doc_id, wherever that is.

Defined cases: a null text is empty, a null language is the part of the empty string. A row without an id has no
smaller id, and is none: E doesn't fail it, nor others for it. Rows with equal ids don't fail each other. Several
labels of a document count as one that holds if any does. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, written

FILTERS = "ABCDE"
#: Rows of a lookup table up to which it is broadcast (some 60 bytes each); beyond it the tables are shuffled.
BROADCAST_ROWS = 200_000
BITS = {letter: 1 << k for k, letter in enumerate(FILTERS)}

_ENUMERATION = """
WITH RECURSIVE prefixes(prefix, step, letter, applied, now, mask) AS (
  SELECT CAST('' AS STRING), 0, CAST('' AS STRING), 0, 0, mask FROM {masks}
  UNION ALL
  SELECT prefix || item.letter, step + 1, item.letter, applied | now, item.bit, mask
  FROM prefixes LATERAL VIEW explode(filter({letters}, x -> (applied | now) & x.bit = 0)) AS item
  WHERE step < {last}
)
SELECT prefix, step, letter, mask,
  mask & (applied | now) = 0 AS keeps,
  mask & now <> 0 AND mask & applied = 0 AS removes,
  mask & now <> 0 AND mask & applied <> 0 AS repeats,
  mask = now AS alone
FROM prefixes WHERE step > 0
"""


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_key, own): each document's failed filters but E, as bits; text_key tells texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    fails = {
        "A": F.col("n") < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * F.col("n"),
        "C": 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 3 * F.length("text"),
        "D": F.col("text").rlike("[#$%&*|]"),
    }
    own = sum((F.when(x, BITS[k]).otherwise(0) for k, x in fails.items()), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"), own.alias("own"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, and those of them with a label. A written table."""
    with scratch() as kept:
        rows = written(failures(docs), "failures", large=True)  # a task for each piece of the texts
        firsts = written(rows.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).filter("rows > 1 and first is not null").select("text_key", "first"), "firsts")
        firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
        copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
        marks = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")]
        marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks)
        rows = rows.join(firsts, "text_key", "left").select("doc_id", "part", (F.col("own") + F.when(copy, BITS["E"]).otherwise(0)).alias("mask"))
        rows = rows.join(marks, "doc_id", "left")
        count = [F.count("*").alias("n"), F.count_if("quality").alias("good"), F.count_if("toxic").alias("toxic")]
        out = written(rows.groupBy("part", "mask").agg(*count), "cells")
        kept.append(out)
    return out


def enumerated(masks: DataFrame) -> DataFrame:
    """(prefix, step, letter, mask, keeps, removes, repeats, alone) of every prefix of every order, on each mask."""
    letters = ", ".join(f"struct('{letter}' AS letter, {bit} AS bit)" for letter, bit in BITS.items())
    return masks.sparkSession.sql(_ENUMERATION.format(masks="{masks}", letters=f"array({letters})", last=len(FILTERS)), masks=masks)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part and order."""
    counts = cells(docs, labels)
    steps = enumerated(counts.select("mask").distinct()).join(F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts, "mask")
    total = lambda of, where: F.coalesce(F.sum(F.when(F.col(where), F.col(of))), F.lit(0)).alias
    by_prefix = steps.groupBy("part", "prefix", "step", "letter").agg(
        total("n", "keeps")("kept"), total("n", "removes")("removed"), total("n", "repeats")("redundant"), total("n", "alone")("unique_fails"),
        total("good", "removes")("good_lost"), total("toxic", "removes")("toxic_lost"),
    )
    # A prefix stands at its step in every order that begins with it.
    orders = [(order, order[:k]) for order in _orders("") for k in range(1, len(FILTERS) + 1)]
    orders = F.broadcast(docs.sparkSession.createDataFrame(orders, "filter_order string, prefix string"))  # five rows an order
    whole = W.partitionBy("part", "letter")  # a row for each order
    out = by_prefix.join(orders, "prefix").withColumn("shapley", F.sum("removed").over(whole))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _orders(prefix: str) -> list[str]:
    return [prefix] if len(prefix) == len(FILTERS) else [x for letter in FILTERS if letter not in prefix for x in _orders(prefix + letter)]


def oracle() -> str:
    """The query in DuckDB SQL."""
    return r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
f AS (SELECT doc_id, part, text, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p(prefix, step, letter, applied, now) AS (SELECT '', 0, '', 0, 0 UNION ALL
  SELECT prefix || letters.letter, step + 1, letters.letter, applied | now, bit FROM p JOIN letters ON (applied | now) & bit = 0),
m AS (SELECT part, prefix, step, letter, sum(n) FILTER (mask & (applied | now) = 0) AS kept, sum(n) FILTER (mask & now <> 0 AND mask & applied = 0) AS removed,
  sum(n) FILTER (mask & now <> 0 AND mask & applied <> 0) AS redundant, sum(n) FILTER (mask = now) AS unique_fails,
  sum(good) FILTER (mask & now <> 0 AND mask & applied = 0) AS good_lost, sum(toxic) FILTER (mask & now <> 0 AND mask & applied = 0) AS toxic_lost
  FROM p CROSS JOIN c WHERE step > 0 GROUP BY ALL),
o AS (SELECT prefix AS filter_order FROM p WHERE step = 5)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
FROM o JOIN m ON m.prefix = filter_order[:step]"""
