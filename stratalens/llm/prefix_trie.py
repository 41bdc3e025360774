"""Prefix trie of conversations by van Emde Boas recursion: members, children, leaves and saved bytes of every shared prefix.

Conversations are rebuilt first (``rebuilt``): each borrows turns from the head of another one. A row of the recursion is
``BASE`` turns of a conversation. The range of depths is cut at half; the sequence above the cut gets a name, which is the
root of the tries below it, and both halves are cut again, down to single rows. What the recursion meets at one level,
upper tries and lower forests of all conversations, is one DataFrame: names of spans are made from the names of their
halves going up, and names of cut prefixes from those of the cut above and the span between going down, so a conversation of n
turns takes log n steps and none of its steps holds more than two names or ``BASE`` turns. Below the last cuts, all tries are
built at once: a turn's node is named from its parent's name and the turn.

A node belongs to the smallest of its members. Going back up, the totals of what a conversation owns below a cut are grafted
to the rows above it, and a node's totals are the sum over its members of what they own at it or below.

Names are 128 bits of SHA-256 of whole contents. The digest of the members that end in a node is one SHA-256 over their ids in
order; ids are joined to texts of up to ``IDS`` first, and the task that hashes a node's texts holds one of them.

Defined cases: a null role or text is empty; turns of equal number (or none) are ordered by a digest of role and text, repeated rows
count as turns; rows without a conv_id belong to no conversation; without conversations there are no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, trim, written

#: Turns in a row of the recursion.
BASE = 16
#: A conversation borrows from one whose id is a multiple of this, and less than so many turns.
EVERY, BORROWED = 5, 9
#: Ids of a range that are joined to one text.
IDS = 4096
#: Rows of a lookup table up to which it is broadcast (at most 500 bytes each); beyond it the tables are shuffled.
BROADCAST_ROWS = 50_000
ROOT = b"root"


def _name(*parts: Column) -> Column:
    """128 bits of a digest."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, nth, token, bytes): each turn's number in its conversation from 0, a digest of role and text, and the text's bytes.

    Rows are sorted in ranges, so a long conversation spreads over many tasks; what earlier tasks hold of one is added.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    token = _name(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), token.alias("token"), F.octet_length(text).cast("long").alias("bytes"))
    order = F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("token")
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "token", "bytes", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            if not len(ids):
                continue
            at, begins = np.arange(len(ids)), np.r_[True, ids[1:] != ids[:-1]]
            nth = at - np.maximum.accumulate(np.where(begins, at, 0))
            if ids[0] == last:
                nth[: int(np.argmax(begins[1:])) + 1 if begins[1:].any() else len(ids)] += n
            last, n = ids[-1], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], names=["conv_id", "token", "bytes", "part", "nth"])

    turns = written(turns.mapInArrow(run, "conv_id long, token binary, bytes long, part int, nth long"), "turns")
    parts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(W.partitionBy("conv_id").orderBy("part")) - F.col("n"))  # a row for each task that holds some
    before = written(before.filter("before > 0").select("conv_id", "part", "before"), "before")  # the first conversation of a task only
    return turns.join(_small(before), ["conv_id", "part"], "left").select("conv_id", (F.col("nth") + F.coalesce("before", F.lit(0))).alias("nth"), "token", "bytes")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): (conv_id, length) of each, and (conv_id, length, depth, token, bytes) with depths from 1.

    A conversation c is the first h turns of c - c % 5 and then its own after its first h, where h is the CRC-32 of c modulo 9.
    """
    turns = numbered(rows)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED
    head = turns.filter((F.col("conv_id") % EVERY == 0) & (F.col("nth") < BORROWED - 1)).groupBy(F.col("conv_id").alias("base"))
    head = head.agg(F.array_sort(F.collect_list(F.struct("nth", "token", "bytes"))).alias("head"))  # eight turns at most
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % EVERY)
    taken = F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int"))
    convs = convs.join(head, "base", "left").select("conv_id", taken.alias("head"), (F.size(taken) + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length"))
    convs = written(convs, "conversations")
    lent = convs.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", "length", (F.col("t.nth") + 1).alias("depth"), "t.token", "t.bytes")
    own = turns.withColumn("h", h).filter("nth >= h").join(_small(convs.select("conv_id", "length", F.size("head").alias("taken"))), "conv_id")
    own = own.select("conv_id", "length", (F.col("taken") + F.col("nth") - F.col("h") + 1).alias("depth"), "token", "bytes")
    return convs.select("conv_id", "length"), lent.union(own)


def _cut_names(rows: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, row, name): the name of all that stands before a row (conv_id, row, turns), but the first one; and the levels of cuts."""
    last = rows.agg(F.max("row")).first()[0] or 0
    levels = int(last).bit_length()
    spans = rows.filter(F.size("turns") == BASE).select("conv_id", F.col("row").alias("i"), _name(F.aggregate("turns", F.lit(b""), lambda s, t: F.concat(s, t["token"]))).alias("name"))
    by_level = []
    for level in range(levels):
        by_level.append(written(spans if level == 0 else spans.filter("name is not null"), "spans"))
        halves = F.array_sort(F.collect_list(F.struct("i", "name")))
        spans = by_level[-1].groupBy("conv_id", F.expr("i div 2").alias("i")).agg(halves.alias("halves")).filter("size(halves) = 2")
        spans = spans.select("conv_id", "i", _name(F.col("halves")[0]["name"], F.col("halves")[1]["name"]).alias("name"))
    cuts = rows.sparkSession.createDataFrame([], "conv_id long, row long, name binary")
    for level in reversed(range(levels)):  # every range of this level at its half
        span = by_level[level].filter("i % 2 = 0").select("conv_id", (F.col("i") * (1 << level)).alias("row"), F.col("name").alias("span"))
        new = span.join(cuts, ["conv_id", "row"], "left")
        new = new.select("conv_id", (F.col("row") + (1 << level)).alias("row"), _name(F.coalesce("name", F.lit(ROOT)), F.col("span")).alias("name"))
        cuts = written(cuts.union(new), "cuts")
    return cuts, levels


def _paths(turns: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, length, row, above, names, bytes) of each row of turns: the name of the node above it, and those of its nodes; and the levels of cuts."""
    rows = turns.groupBy("conv_id", F.expr(f"(depth - 1) div {BASE}").alias("row")).agg(F.max("length").alias("length"), F.array_sort(F.collect_list(F.struct("depth", "token", "bytes"))).alias("turns"))  # BASE turns at most
    rows = written(rows, "rows", large=True)
    cuts, levels = _cut_names(rows)
    rows = rows.join(_small(cuts), ["conv_id", "row"], "left").withColumn("above", F.coalesce("name", F.lit(ROOT)))
    rows = rows.join(_small(cuts.select("conv_id", (F.col("row") - 1).alias("row"), F.col("name").alias("below"))), ["conv_id", "row"], "left")
    chain = F.aggregate("turns", F.array("above"), lambda names, t: F.concat(names, F.array(_name(F.element_at(names, -1), t["token"]))))
    names = F.slice(chain, 2, BASE)
    names = F.when(F.col("below").isNull(), names).otherwise(F.concat(F.slice(names, 1, BASE - 1), F.array("below")))  # the node at a cut has the cut's name
    paths = rows.select("conv_id", "length", "row", "above", names.alias("names"), F.transform("turns", lambda t: t["bytes"]).alias("bytes"))
    return written(paths, "paths", large=True), levels


def _grafted(owned: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """(conv_id, row, leaves_below, saved_below): what the conversation owns in the rows after each one.

    At each level of cuts, the half below a cut is summed up and added to the rows of the half above it.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    part = F.shiftrightunsigned(F.col("row"), F.lit(0)) if levels == 0 else F.expr("shiftright(row, level)")
    lower = owned.select("conv_id", "row", "leaves", "saved", level.alias("level")).withColumn("part", part).filter("part % 2 = 1")
    lower = lower.groupBy("conv_id", "level", "part").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    upper = paths.select("conv_id", "row", level.alias("level")).withColumn("part", part).filter("part % 2 = 0").withColumn("part", F.col("part") + 1)
    met = upper.join(_small(written(lower, "lower")), ["conv_id", "level", "part"])
    return met.groupBy("conv_id", "row").agg(F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))


def _totals(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """(name, n_leaves, saved_tokens) of the whole subtree of each node (name, conv_id, depth, leaf, saved)."""
    item = F.struct("depth", F.col("leaf").cast("long").alias("leaf"), "saved")
    owned = nodes.groupBy("conv_id", F.expr(f"(depth - 1) div {BASE}").alias("row")).agg(F.collect_list(item).alias("items"), F.sum(F.col("leaf").cast("long")).alias("leaves"), F.sum("saved").alias("saved"))
    owned = written(owned, "owned")  # BASE items at most
    at = paths.select("conv_id", "row", "names").join(owned.select("conv_id", "row", "items"), ["conv_id", "row"], "left")
    if levels:
        at = at.join(_small(written(_grafted(owned, paths, levels), "grafted")), ["conv_id", "row"], "left")
    else:
        at = at.withColumns({"leaves_below": F.lit(0), "saved_below": F.lit(0)})

    def here(of: str, k: Column) -> Column:
        """What is owned at the row's k-th node and below."""
        below = F.filter(F.coalesce("items", F.array()), lambda x: x["depth"] > F.col("row") * BASE + k)
        return F.aggregate(F.transform(below, lambda x: x[of]), F.coalesce(F.col("leaves_below" if of == "leaf" else "saved_below"), F.lit(0)).cast("long"), lambda s, x: s + x)

    each = F.explode(F.transform("names", lambda name, k: F.struct(name.alias("name"), here("leaf", k).alias("leaves"), here("saved", k).alias("saved"))))
    each = at.select(each.alias("x")).select("x.*").filter("leaves > 0 or saved > 0")
    return each.groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def _ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """(name, ends_sha256) of the nodes in which conversations end: their ids in order, joined by commas."""
    last = paths.filter((F.col("length") - 1 >= F.col("row") * BASE) & (F.col("length") <= (F.col("row") + 1) * BASE))
    last = last.select("conv_id", F.element_at("names", -1).alias("name")).union(convs.filter("length = 0").select("conv_id", F.lit(ROOT)))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    texts = last.groupBy("name", F.expr(f"conv_id div {IDS}").alias("nth")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = digest = None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for this, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if this != name:
                    if name is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = this, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(text.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["name", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], names=["name", "ends_sha256"])
        trim()

    return texts.repartition("name").sortWithinPartitions("name", "nth").select("name", "ids").mapInArrow(run, "name binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with scratch() as kept:
        convs, turns = rebuilt(rows)
        paths, levels = _paths(turns)
        each = F.explode(F.transform("names", lambda name, k: F.struct(
            name.alias("name"), F.when(k == 0, F.col("above")).otherwise(F.element_at("names", F.greatest(k, F.lit(1)))).alias("parent"), F.get("bytes", k).alias("bytes"), (F.col("row") * BASE + k + 1).alias("depth"))))
        nodes = paths.select("conv_id", "length", each.alias("x")).groupBy("x.name").agg(
            F.min("conv_id").alias("conv_id"), F.max("x.depth").alias("depth"), F.max("x.parent").alias("parent"), F.count("*").alias("n_convs"),
            ((F.count("*") - 1) * F.max("x.bytes")).alias("saved"), (F.count_if(F.col("x.depth") == F.col("length")) == F.count("*")).alias("leaf"),
        )
        nodes = written(nodes, "nodes")
        top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
        top = top.select(F.lit(ROOT).alias("name"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs")
        shape = nodes.select("name", "conv_id", "depth", "parent", "n_convs").union(top)
        whole = nodes.agg(F.greatest(F.coalesce(F.sum(F.col("leaf").cast("long")), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"))
        totals = _totals(nodes, paths, levels).union(whole.select(F.lit(ROOT), "n_leaves", "saved_tokens"))
        children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
        parents = _small(written(shape.join(children, "name", "left_semi").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parents"))
        out = shape.join(totals, "name").join(children, "name", "left").join(_ends(paths, convs), "name", "left").join(parents, "parent", "left")
        out = written(out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                                 F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")), "trie")
        kept.append(out)
    return out


def oracle() -> str:
    """The query in DuckDB SQL; a path's key is the text of all its turns."""
    step = "CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: {step})), 4294967295)"
    return f"""WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc} % 9 AS h FROM (SELECT DISTINCT conv_id FROM r)),
u AS (SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN r ON r.conv_id = base WHERE i < h UNION ALL SELECT conv_id, 1, i, role, text FROM r JOIN c USING (conv_id) WHERE i >= h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS depth, strlen(text) AS bytes, strlen(role) || ':' || strlen(text) || ':' || role || text AS turn FROM u),
p AS (SELECT conv_id, depth, bytes, sha256(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM t UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT *, lag(k) OVER w AS above, lead(k) OVER w IS NULL AS ends FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
n AS (SELECT k, any_value(above) AS above, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved, bool_and(ends) AS leaf,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY k),
d AS (SELECT DISTINCT a.k AS k, b.k AS below FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
s AS (SELECT d.k, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM d JOIN n ON n.k = d.below GROUP BY d.k),
h AS (SELECT above AS k, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, x.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (k) LEFT JOIN h USING (k) LEFT JOIN n x ON x.k = n.above"""
