"""Column expressions: typing, outcomes, identifiers, text outcomes, rates, bins and statistics kernels.

All are native, total under ANSI mode (``try_*`` and ``nullif``), and treat NaN as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import STANDARD_SYMBOLS

# Fixed values of the study.
TRUTHY = ("1", "y", "yes", "true", "t", "graduate", "graduated", "degree awarded", "awarded")
FALSY = ("0", "n", "no", "false", "f", "not", "did not", "none", "missing")
NA_WORDS = r"(?iU)^\s*(n/?a|na|n\.a\.|not\s+available)(.*101.*)?\s*$"
DFW_GRADES = ("D", "F", "W", "WF", "WN", "LD")
TERMS = {1: ("Spring", 1), 5: ("Summer", 6), 8: ("Fall", 8)}
CREDIT_ENDS = (20, 40, 60, 80, 100, 10_000)
CREDIT_LABELS = ("0-19", "20-39", "40-59", "60-79", "80-99", "100+")
GRADUATION = r"\bGRAD|\bDEGREE\b"
NO_GRADUATION = r"\b(NO|NOT|DENIED|PEND|PENDING|SEEK|SEEKING|IN\s*PROGRESS|PLANN|PLAN|INTENT|ADMIT|ENROLL)\b"
#: Outcome texts of a period, the attempts in it, and which of them was the pass.
PERIODS = (
    (r"Never\s+Enrolled", 0, None),
    (r"1(?:st)?\s*Attempt\s*=\s*ABC", 1, 1),
    (r"Only\s+1\s*Attempt\s*=\s*DFW", 1, None),
    (r"2\s*Attempts\s*\(\s*1st\s*=\s*DFW\s*,\s*2nd\s*=\s*ABC\s*\)", 2, 2),
    (r"2\s*Attempts\s*\(\s*Both\s*=\s*DFW\s*\)", 2, None),
)
SOME_ATTEMPTS, SOME_ATTEMPTS_TO_A_PASS = r"(\d+)\s*Attempts?", r"(\d+)\s*Attempts?.*ABC"


def identifier(c: Column, missing: str | None = None) -> Column:
    """An identifier without spaces around it. A missing one stays null, unless ``missing`` names the text that stands for it."""
    return stripped(c) if missing is None else F.coalesce(stripped(c), F.lit(missing))


def std_name(c: Column) -> Column:
    """``names.std_col`` on values, as for levels that become columns."""
    out = F.regexp_replace(F.regexp_replace(c.cast("string"), r"(?U)\s+", " "), "^ | $", "")
    for symbol, word in STANDARD_SYMBOLS:
        out = F.replace(out, F.lit(symbol), F.lit(word))
    return F.lower(F.regexp_replace(F.regexp_replace(out, r"(?U)[^\w\s]", ""), r"(?U)\s+", "_"))


def file_name(c: Column, most: int = 120) -> Column:
    """``names.safe_name`` on values."""
    return F.substring(F.regexp_replace(c.cast("string"), "[^A-Za-z0-9._-]+", "_"), 1, most)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def number(c: Column) -> Column:
    """Double, or null where it isn't one (or is NaN). Java's type suffixes don't count as numbers."""
    x = F.when(~F.coalesce(c.cast("string").rlike(r"[dDfF]\s*$"), F.lit(False)), c.cast("string").try_cast("double"))
    return F.when(~F.isnan(x), x)


def plain(c: Column) -> Column:
    """A numeric or boolean column as a double without NaN."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def flag(condition: Column) -> Column:
    """1 or 0, 0 for unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def missing_category(c: Column) -> Column:
    """A text with its spellings of "not available" as null."""
    return F.when(~F.coalesce(c.rlike(NA_WORDS), F.lit(False)), c)


def binary_number(c: Column) -> Column:
    """1.0 above zero, else 0.0, which a null is too."""
    return F.coalesce(plain(c) > 0, F.lit(False)).cast("double")


def binary_text(c: Column) -> Column:
    """1.0 or 0.0 for words of either kind, else null."""
    word = F.lower(stripped(c))
    return F.when(word.isin(*TRUTHY), 1.0).when(word.isin(*FALSY), 0.0)


def clean_grade(c: Column) -> Column:
    grade = F.upper(stripped(c))
    return F.when(~grade.isin("N/A", "NA", ""), grade)


def merge_id(c: Column) -> Column:
    """The first run of five or more digits of an identifier's letters and digits, else all of them."""
    kept = F.regexp_replace(F.upper(c.cast("string")), "[^A-Z0-9]", "")
    return F.coalesce(F.nullif(F.regexp_extract(kept, r"(\d{5,})", 1), F.lit("")), kept)


def term_year(code: Column) -> Column:
    n = code.cast("long")
    return F.lit(2000) + (F.floor(n / 10) - 200).cast("int")


def term_label(code: Column) -> Column:
    digit, name = code.cast("long") % 10, None
    for d, (word, _) in TERMS.items():
        name = (name.when if name is not None else F.when)(digit == d, word)
    word = name.otherwise(F.concat(F.lit("Term"), digit.cast("string")))
    return F.when(code.isNotNull(), F.concat(word, F.lit(" "), term_year(code).cast("string")))


def term_date(code: Column) -> Column:
    digit, month = code.cast("long") % 10, None
    for d, (_, m) in TERMS.items():
        month = (month.when if month is not None else F.when)(digit == d, m)
    return F.when(code.isNotNull(), F.make_date(term_year(code), month.otherwise(1), F.lit(1)))


def final_pass(c: Column, rule: str = "substring") -> Column:
    """Whether a final outcome hints a pass. ``substring``: any A, B or C unless there is a C-; ``token``: as a whole word."""
    text = F.upper(c.cast("string"))
    hint = text.rlike("[ABC]") if rule == "substring" else text.rlike(r"\b(PASS|ABC|[AB][+-]?|C\+?)(\b|$)")
    return F.coalesce(~text.contains("C-") & hint, F.lit(False))


def period(c: Column) -> Column:
    """struct(attempts, passed, pass_index) of a cumulative outcome text: the first of ``PERIODS`` that is the whole text, else its number of
    attempts, the last of which is the pass if one is named after it; unknown texts count as no attempt."""
    text = stripped(c)

    def meaning(attempts: Column, index: Column) -> Column:
        index = index.cast("int")
        return F.struct(attempts.cast("int").alias("attempts"), index.isNotNull().alias("passed"), index.alias("pass_index"))

    none, tries, passes = F.lit(None), *(F.regexp_extract(text, "(?iU)" + p, 1).try_cast("int") for p in (SOME_ATTEMPTS, SOME_ATTEMPTS_TO_A_PASS))
    out = F.when(text.isNull(), meaning(F.lit(0), none))
    for pattern, attempts, index in PERIODS:
        out = out.when(text.rlike(rf"(?iU)^\s*{pattern}\s*$"), meaning(F.lit(attempts), F.lit(index)))
    return out.when(passes.isNotNull(), meaning(passes, passes)).otherwise(meaning(F.coalesce(tries, F.lit(0)), none))


def outcome_label(total: Column, passed_on: Column) -> Column:
    return (
        F.when(passed_on == 1, "Pass on 1st attempt")
        .when(passed_on == 2, "Pass on 2nd attempt")
        .when(passed_on == 3, "Pass on 3rd attempt")
        .when(passed_on.isNotNull(), "Requires more than three attempts")
        .when(total == 0, "Never enrolled")
        .otherwise(F.concat(F.lit("No pass after "), total.cast("string"), F.when(total == 1, " attempt").otherwise(" attempts")))
    )


def graduated(status: Column) -> Column:
    """1 for an awarded degree, 0 for none, pending or planned ones, and null."""
    text = F.coalesce(F.upper(status.cast("string")), F.lit(""))
    return (text.rlike(GRADUATION) & ~text.rlike(NO_GRADUATION)).cast("int")


def rate(x: Column, per: Column) -> Column:
    """x / per, null where the denominator is 0 or null."""
    return x.cast("double") / F.nullif(per.cast("double"), F.lit(0.0))


def credit_midpoint(window: Column) -> Column:
    """The middle of the first ``a-b`` in a text."""
    end = lambda k: F.regexp_extract(window.cast("string"), r"(\d+)\s*-\s*(\d+)", k).try_cast("long")
    return (end(1) + end(2)) / 2.0


def right_closed(x: Column, ends: Sequence[float], labels: Sequence[str], low: float, with_low: bool) -> Column:
    """The label of ``(low, ends[0]], (ends[0], ends[1]], ...``; null outside. ``with_low`` includes the lowest edge."""
    inside = (x >= low) if with_low else (x > low)
    out = None
    for end, label in zip(ends, labels):
        out = (out.when if out is not None else F.when)(x <= end, label)
    return F.when(inside, out)


def credit_bin(x: Column) -> Column:
    return right_closed(x, CREDIT_ENDS, CREDIT_LABELS, 0, True)


def bucket_number(x: Column, edges: Column) -> Column:
    """1-based bucket of x on sorted distinct edges: right-closed, the lowest edge in the first; null outside."""
    above = F.size(F.filter(edges, lambda e: e < x))
    return F.when((x >= F.element_at(edges, 1)) & (x <= F.element_at(edges, -1)), F.greatest(above, F.lit(1)))


def pooled_d(m1: Column, m0: Column, v1: Column, v0: Column, n1: Column, n0: Column) -> Column:
    """Cohen's d; null where the pooled deviation is 0 or unknown."""
    s = F.sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))
    return (m1 - m0) / F.nullif(s, F.lit(0.0))


def risk(a: Column, n: Column, smooth: float = 0.5) -> Column:
    return (a + smooth) / (n + 2 * smooth)


def log_ratio_error(a: Column, n: Column, c: Column, m: Column, smooth: float = 0.5) -> Column:
    """Standard error of the log risk ratio."""
    return F.sqrt(1 / (a + smooth) - 1 / (n + 2 * smooth) + 1 / (c + smooth) - 1 / (m + 2 * smooth))
