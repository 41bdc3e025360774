"""Quality rules: robust multivariate outliers among the documents of a language and source.

Plain statistics of every whole text fail the worst documents by two fixed rules. The others are vectors of
transformed statistics, and each group of one language and source gets a minimum-covariance-determinant
estimate of their centre and scatter. It has several starts: the group's moments, its medians with median deviations,
and small subsamples dealt by hash. Concentration steps keep the ``KEEP`` share of rows with the smallest
Mahalanobis distances and estimate again; after ``FIRST_STEPS`` only the starts with the least determinants go on, until no
determinant changes. The least one's rows within the ``WITHIN`` point of chi-square give the reweighted estimate.
Distances are rescaled so that their median is that of a normal sample; a document beyond ``CUTOFF`` is rejected. An estimate
stands while less than 1 - ``KEEP`` of a group is junk.

A step is one partial aggregation of moments by group, start and logarithmic bin of the distance, and a join with one row
for each group and start; no group is sorted or gathered, and a few steps are one plan. Groups of under ``MIN_ROWS`` are
pooled by language, and then altogether; a pool of under ``MIN_ROWS`` rejects nothing.

Defined cases: a null text has no words (base_failed); a null language or source is a value of its own;
equal rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, discard, quoted, scratch, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50
KEEP, MIN_ROWS = 0.75, 100
#: Subsamples as starts, and rows in each, about; steps of all starts, the number that goes on, and their steps at most.
SUBSAMPLES, SUBSAMPLE_ROWS = 8, 8
FIRST_STEPS, GO_ON, LAST_STEPS = 2, 2, 12
#: Of the last steps, so many are one plan; what changes is looked at after them.
AT_ONCE = 3
#: Points of chi-square with five degrees of freedom: the upper 1e-9, the upper 0.025, the median.
CUTOFF, WITHIN, MEDIAN = 51.2, 12.833, 4.351
#: Rows of a lookup table up to which it is broadcast (a few hundred bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 50_000
#: Statistics as they enter the vectors, and the least standard deviation of each.
VECTOR = {
    "v0": ("ln(n_words)", 0.3),
    "v1": ("ln(word_chars / n_words)", 0.05),
    "v2": ("ln(1 + 100 * n_symbols / n_words)", 0.7),
    "v3": ("ln(1 + n_dup_lines)", 1.0),
    "v4": ("ln(1 + 100 * n_repeat_words / n_words)", 1.2),
}
DIMS = list(VECTOR)
PAIRS = [(i, j) for i in range(len(DIMS)) for j in range(i + 1)]
#: Bins of a factor exp(1/16) of the squared distance, and bins of a statistic within its least deviation.
BINS, FINE = 16, 16


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, and without its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [F.col(quoted(c)) for c in docs.columns if c != "text"]
    rows = docs.select(
        *rest,
        F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("_lines"),
    )
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    rows = rows.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    # Hash and place of each 3-word window, in order of the hashes: equal windows are neighbours.
    place = F.expr("transform(sequence(0, size(_words) - 3), i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) as h, i as i))")
    none = F.expr("cast(array() as array<struct<h: bigint, i: int>>)")
    rows = rows.withColumn("_windows", F.when(F.size("_words") >= 3, F.sort_array(place)).otherwise(none)).drop("_words")
    twice = F.expr("transform(filter(_windows, (x, k) -> (k > 0 and x.h = get(_windows, k - 1).h) or (k + 1 < size(_windows) and x.h = get(_windows, k + 1).h)), x -> x.i)")
    rows = rows.withColumn("_at", twice).drop("_windows").withColumn("_at", F.sort_array("_at"))
    covered = F.expr("aggregate(transform(_at, (x, k) -> if(k + 1 < size(_at), least(3, get(_at, k + 1) - x), 3)), 0L, (a, b) -> a + b)")
    rows = rows.withColumn("n_repeat_words", covered).drop("_at")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))


def _bin(d2: Column) -> Column:
    return F.floor(F.log(F.greatest(d2, F.lit(1e-9))) * BINS).cast("int")


def _small(df: DataFrame) -> DataFrame:
    """A written lookup table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _moments() -> list[Column]:
    """Aggregates of the vectors, or sums of such aggregates: their number, sums, and sums of products."""
    return [F.count("*").alias("n"), *(F.sum(v).alias(f"a{i}") for i, v in enumerate(DIMS)), *(F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"p{i}{j}") for i, j in PAIRS)]


_SUMS = ["n", *(f"a{i}" for i in range(len(DIMS))), *(f"p{i}{j}" for i, j in PAIRS)]


def _estimates(sums: DataFrame, *keys: str) -> DataFrame:
    """Per row of moments: the centre m, the Cholesky factor l (by rows) of the scatter with least deviations, and its log determinant."""
    scatter = [F.col(f"p{i}{j}") / F.col("n") - F.col(f"a{i}") / F.col("n") * F.col(f"a{j}") / F.col("n") + F.lit(VECTOR[DIMS[i]][1] ** 2 if i == j else 0.0) for i, j in PAIRS]
    out = sums.select(*keys, F.array(*(F.col(f"a{i}") / F.col("n") for i in range(len(DIMS)))).alias("m"), F.array(*scatter).alias("s"))
    return _factored(out, *keys)


def _factored(estimates: DataFrame, *keys: str) -> DataFrame:
    """(keys, m, l, logdet) of (keys, m, s)."""
    entries = ", ".join(f"named_struct('i', {i}, 'j', {j}, 'k', {k})" for k, (i, j) in enumerate(PAIRS))
    row = "slice(l, {0} * ({0} + 1) div 2 + 1, e.j)"
    rest = f"s[e.k] - aggregate(zip_with({row.format('e.i')}, {row.format('e.j')}, (x, y) -> x * y), 0D, (x, y) -> x + y)"
    entry = f"if(e.i = e.j, sqrt(greatest({rest}, 1e-12D)), ({rest}) / l[e.j * (e.j + 3) div 2])"
    factor = F.expr(f"aggregate(array({entries}), cast(array() as array<double>), (l, e) -> concat(l, array({entry})))")
    out = estimates.select(*keys, "m", factor.alias("l"))
    return out.withColumn("logdet", 2 * sum((F.log(F.col("l")[i * (i + 3) // 2]) for i in range(1, len(DIMS))), F.log(F.col("l")[0])))


def _distances(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``rows`` with the further columns of their group's ``estimates`` and d2, the squared Mahalanobis distance, by forward substitution."""
    out = rows.join(estimates, "grp")
    for i, v in enumerate(DIMS):
        rest = F.col(v) - F.col("m")[i]
        for j in range(i):
            rest = rest - F.col("l")[i * (i + 1) // 2 + j] * F.col(f"z{j}")
        out = out.withColumn(f"z{i}", rest / F.col("l")[i * (i + 3) // 2])
    d2 = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(DIMS))), F.col("z0") * F.col("z0"))
    return out.withColumn("d2", d2).drop("m", "l", *(f"z{i}" for i in range(len(DIMS))))


def _reached(counts: DataFrame, keys: tuple[str, ...], order: str, share: float) -> DataFrame:
    """The rows of ``counts`` (keys, order, n) in order, up to the first by which ``share`` of each key's n is reached."""
    within = W.partitionBy(*keys)
    sized = counts.withColumn("before", F.sum("n").over(within.orderBy(order)) - F.col("n")).withColumn("all", F.sum("n").over(within))
    return sized.filter(F.col("before") < share * F.col("all")).drop("before", "all")


def _steps(rows: DataFrame, estimates: DataFrame, number: int, few: bool) -> DataFrame:
    """The estimates after ``number`` concentration steps, one plan: each is of the ``KEEP`` share of a group nearest to the one before
    (grp, start, m, l, logdet), whose log determinant goes along as ``was``. few: as counted, they are broadcast."""
    keys = ("grp", "start", "was")
    for _ in range(number):
        now = estimates.select("grp", "start", "m", "l", F.col("logdet").alias("was"))
        near = _distances(rows, F.broadcast(now) if few else now).groupBy(*keys, _bin(F.col("d2")).alias("bin")).agg(*_moments())
        kept = _reached(near, keys, "bin", KEEP).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _SUMS))
        estimates = _estimates(kept, *keys)
    return estimates


def _starts(rows: DataFrame) -> DataFrame:
    """(grp, start, m, l, logdet): moments, medians with median deviations, and subsamples."""
    whole = written(rows.groupBy("grp").agg(*_moments()), "moments")
    by_moments = _estimates(whole, "grp").withColumn("start", F.lit(0))

    # Medians from fine bins of each statistic; deviations from the same bins.
    least = F.create_map(*(F.lit(x) for i in range(len(DIMS)) for x in (i, VECTOR[DIMS[i]][1])))
    values = rows.select("grp", F.posexplode(F.array(*DIMS)).alias("dim", "value"))
    counts = written(values.groupBy("grp", "dim", F.floor(F.col("value") / least[F.col("dim")] * FINE).alias("bin")).agg(F.count("*").alias("n")), "bins")
    middle = _reached(counts, ("grp", "dim"), "bin", 0.5).groupBy("grp", "dim").agg(F.max("bin").alias("middle"))
    off = counts.join(middle, ["grp", "dim"]).withColumn("off", F.abs(F.col("bin") - F.col("middle")))
    width = _reached(off.groupBy("grp", "dim", "middle", "off").agg(F.sum("n").alias("n")), ("grp", "dim"), "off", 0.5).groupBy("grp", "dim", "middle").agg(F.max("off").alias("off"))
    unit = least[F.col("dim")] / FINE
    each = width.select("grp", "dim", ((F.col("middle") + 0.5) * unit).alias("m"), F.pow(1.4826 * (F.col("off") + 0.5) * unit, F.lit(2)).alias("s"))
    each = each.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("dims"))  # five for each group
    diagonal = F.array(*(F.col("dims")[i]["s"] + F.lit(VECTOR[DIMS[i]][1] ** 2) if i == j else F.lit(0.0) for i, j in PAIRS))
    by_medians = _factored(each.select("grp", F.col("dims")["m"].alias("m"), diagonal.alias("s")), "grp").withColumn("start", F.lit(1))

    place = F.pmod(F.xxhash64(*DIMS, "at"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = _small(whole.select("grp", F.col("n").alias("size")))
    some = rows.withColumn("place", place).join(sizes, "grp").withColumn("start", (F.floor(F.col("place") * F.col("size") / SUBSAMPLE_ROWS) + 2).cast("int"))
    some = some.filter(F.col("start") < SUBSAMPLES + 2).groupBy("grp", "start").agg(*_moments())
    columns = "grp", "start", "m", "l", "logdet"
    return written(by_moments.select(*columns).union(by_medians.select(*columns)).union(_estimates(some, "grp", "start").select(*columns)), "starts")


def _least(estimates: DataFrame, number: int) -> DataFrame:
    """The estimates of the least determinants of each group."""
    rank = F.row_number().over(W.partitionBy("grp").orderBy("logdet", "start"))
    return estimates.withColumn("rank", rank).filter(F.col("rank") <= number).drop("rank")


def _scaled(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """``estimates`` with middle, the bin of each group's median distance."""
    near = _distances(rows, _small(estimates)).groupBy("grp", _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("n"))
    middle = _reached(near, ("grp",), "bin", 0.5).groupBy("grp").agg(F.max("bin").alias("middle"))
    return written(estimates.join(middle, "grp"), "scales")


def _rescaled() -> Column:
    """d2 as if its median, in the bin ``middle``, were that of a normal sample."""
    return F.col("d2") * MEDIAN / F.exp((F.col("middle") + 1) / BINS)


def robust(rows: DataFrame) -> DataFrame:
    """(grp, m, l, middle) of the rows (grp, at, v0 ..): the reweighted minimum-covariance-determinant estimate of each group. ``at`` tells equal
    vectors apart where a hash deals them out."""
    estimates = _starts(rows)
    few = estimates.count() <= BROADCAST_ROWS
    before, estimates = estimates, written(_least(_steps(rows, estimates, FIRST_STEPS, few), GO_ON), "going_on")
    discard(before)
    for _ in range(0, LAST_STEPS, AT_ONCE):
        before, estimates = estimates, written(_steps(rows, estimates, AT_ONCE, few), "estimates")
        discard(before)
        if (estimates.agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0] or 0.0) < 1e-9:
            break
    best = _scaled(rows, _least(estimates, 1).select("grp", "m", "l"))
    inner = _distances(rows, _small(best)).filter(_rescaled() <= WITHIN)
    return _scaled(rows, written(_estimates(inner.groupBy("grp").agg(*_moments()), "grp").select("grp", "m", "l"), "reweighted"))


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with grp: their language and source, or a pool of small groups."""
    pairs = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    small = F.col("n") < MIN_ROWS
    pairs = pairs.withColumn("rest", F.sum(F.when(small, F.col("n")).otherwise(0)).over(W.partitionBy("lang")))
    name = F.when(~small, F.to_json(F.array(F.col("lang").cast("string"), F.col("source").cast("string"))))
    name = name.when(F.col("rest") >= MIN_ROWS, F.to_json(F.array(F.col("lang").cast("string")))).otherwise("[]")
    pairs = _small(written(pairs.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), name.alias("grp")), "groups"))
    return rows.join(pairs, rows["lang"].eqNullSafe(F.col("_lang")) & rows["source"].eqNullSafe(F.col("_source"))).drop("_lang", "_source")


def judged(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    with scratch() as tables:
        stats = written(statistics(docs.select("doc_id", "lang", "source", "text")), "statistics")
        vectors = stats.withColumns({v: F.expr(e) for v, (e, _) in VECTOR.items()})
        asked = written(_grouped(vectors.filter(~F.col("base_failed"))).withColumn("at", F.xxhash64("doc_id")), "vectors")
        rows = asked.select("grp", "at", *DIMS)
        sizes = rows.groupBy("grp").agg(F.count("*").alias("rows"))
        estimates = written(robust(rows).join(sizes, "grp").select("grp", "m", "l", "middle", (F.col("rows") >= MIN_ROWS).alias("enough")), "robust")
        tables += [stats, asked, estimates]
    kept = ~(F.col("enough") & (_rescaled() > CUTOFF))
    far = _distances(asked, _small(estimates))
    failed = stats.filter("base_failed").select("doc_id", *names, F.lit(False).alias("kept"))
    return far.select("doc_id", *names, kept.alias("kept")).union(failed)
