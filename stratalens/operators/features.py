"""Features of the information sheet: course outcomes, rates, flags and roll-ups, each one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions.names import resolve_col

# The five gateway courses, columns kept from the sheet, and spellings of optional ones.
COURSES = ("chem_110", "edsgn_100", "math_140", "math_141", "phys_211")
KEPT = (
    "random_id", "credit_window", "cgpa_at_etm_to_any_campus", "highest_cgpa_during_credit_window", "academic_suspenion_itwo", "me_bs_degree_status",
    "graduating_cgpa", "dif_btw_max_and_min_term_gpa", "total_grade_forgiveness_credits_approved_before_etm_to_any_campus", "sat_verb_grouping",
    "1st_aleks_math_score_grouping", "with_math_ap", "1st_math_course", "1st_math_course_campus",
)
NUMERIC = ("cgpa_at_etm_to_any_campus", "highest_cgpa_during_credit_window", "graduating_cgpa", "dif_btw_max_and_min_term_gpa", "total_grade_forgiveness_credits_approved_before_etm_to_any_campus")
ALIASES = {
    "enrolled": (("no_enrolled_terms_su_included", "enrolled_terms_su_included", "no_enrolled_terms", "enrolled_terms"), ("enroll", "term")),
    "warnings": (("no_of_warning", "no_of_warnings", "warnings", "warning", "num_warnings", "n_warnings"), ("warn",)),
    "below_2_5": (("no_term_gpa_2_5", "term_gpa25", "no_term_gpa_2_50"), ("gpa", "2", "5")),
    "below_3": (("no_term_gpa_3", "term_gpa3", "no_term_gpa_3_0"), ("gpa", "3")),
    "third_time": (("no_of_courses_taken_ge3rd_time", "courses_taken_ge3rd_time", "courses_taken_3rd_time"), ("3rd", "time")),
}


def column_or_null(df: DataFrame, name: str | None, kind: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast(kind)


def attempts(one: Column, two: Column, hinted: Column) -> dict[str, Column]:
    """attempts_to_abc and total_attempts of two years' ``period`` structs: the latest non-empty cumulative snapshot, else one more
    attempt where the final outcome hints a pass."""
    pick = lambda k: F.when((two["attempts"] > 0) | two["passed"], two[k]).otherwise(one[k])
    on = F.when(pick("passed"), pick("pass_index")).when(hinted, pick("attempts") + 1)
    return {"attempts_to_abc": on, "total_attempts": F.coalesce(on, pick("attempts"))}


def course_features(df: DataFrame, keys: Sequence[str], courses: Sequence[str] = COURSES, rule: str = "substring") -> DataFrame:
    """Per course attempts, pass flags, first-grade flag and label, and their roll-ups over the courses.

    One projection after the other, each of columns of the one before: texts are parsed once, and no generated method gets too long.
    """
    parsed, tried, out = [], [], [F.col(k) for k in keys]
    for c in courses:
        year = lambda k, c=c: column_or_null(df, f"{c}_outcome_after_{k}_ay", "string")
        name = resolve_col(df.columns, [f"{c}_grade_code_1st_fa_or_sp", f"{c}__grade_code__1st_fa_or_sp"])
        parsed += [E.period(year("1st")).alias(f"_{c}_1"), E.period(year("2nd")).alias(f"_{c}_2"), E.final_pass(column_or_null(df, f"{c}_outcome", "string"), rule).alias(f"_{c}_hint")]
        parsed.append(E.flag(E.clean_grade(column_or_null(df, name, "string")).isin(*E.DFW_GRADES)).alias(f"{c}_first_grade_dfw"))
        tried += [x.alias(f"_{c}_{k}") for k, x in attempts(F.col(f"_{c}_1"), F.col(f"_{c}_2"), F.col(f"_{c}_hint")).items()] + [F.col(f"{c}_first_grade_dfw")]
        a, n = F.col(f"_{c}_attempts_to_abc"), F.col(f"_{c}_total_attempts")
        out += [
            a.cast("double").alias(f"{c}_attempts_to_abc"), E.flag(a == 1).alias(f"{c}_pass_by_first_attempt"), a.isNotNull().cast("int").alias(f"{c}_ever_passed"),
            F.col(f"{c}_first_grade_dfw"), n.cast("long").alias(f"{c}_total_attempts"), E.outcome_label(n, a).alias(f"{c}_outcome_label"),
        ]
    return rollups(df.select(*keys, *parsed).select(*keys, *tried).select(*out), courses)


def rollups(df: DataFrame, courses: Sequence[str] = COURSES) -> DataFrame:
    """Row-wise sums over the courses: attempts (0 without a pass), first passes, never passed, first grades of D, F or W."""
    add = lambda of: sum((of(c) for c in courses[1:]), of(courses[0]))
    return df.withColumns(
        {
            "etm_total_attempts_to_abc": add(lambda c: F.coalesce(f"{c}_attempts_to_abc", F.lit(0.0))),
            "etm_first_attempt_pass_count": add(lambda c: F.col(f"{c}_pass_by_first_attempt")).cast("long"),
            "etm_never_passed_count": add(lambda c: (F.col(f"{c}_ever_passed") == 0).cast("int")).cast("long"),
            "etm_first_grade_dfw_count": add(lambda c: F.col(f"{c}_first_grade_dfw")).cast("long"),
        }
    )


def information(df: DataFrame) -> dict[str, Column]:
    """Gaps, rates, flags and missingness indicators of the sheet, by name."""
    found = {k: resolve_col(df.columns, *spellings) for k, spellings in ALIASES.items()}
    x = lambda c: E.number(column_or_null(df, c, "double"))
    forgiven = "total_grade_forgiveness_credits_approved_before_etm_to_any_campus"
    terms, warnings = x(found["enrolled"]), found["warnings"]
    positive = lambda c: E.flag(x(c) > 0) if c in df.columns else F.lit(None).cast("int")
    new = {
        "cgpa_gap": x("graduating_cgpa") - x("cgpa_at_etm_to_any_campus"),
        "graduated_me": E.graduated(column_or_null(df, "me_bs_degree_status", "string")),
        "warnings_per_term": E.rate(F.coalesce(x(warnings), F.lit(0.0)), terms) if warnings else F.lit(None).cast("double"),
        "low_gpa_term_rate_2_5": E.rate(x(found["below_2_5"]), terms),
        "low_gpa_term_rate_3_0": E.rate(x(found["below_3"]), terms),
        "peak_minus_etm": x("highest_cgpa_during_credit_window") - x("cgpa_at_etm_to_any_campus"),
        "grade_forgiveness_used": positive(forgiven),
        "multi_repeat_flag": positive(found["third_time"]),
    }
    return new | {f"{c}_is_missing": x(c).isNull().cast("int") for c in ("cgpa_at_etm_to_any_campus", "graduating_cgpa", found["enrolled"]) if c in df.columns}


def info_features(df: DataFrame) -> DataFrame:
    """The kept columns, typed, with gaps, rates, flags and missingness indicators."""
    found = {k: resolve_col(df.columns, *spellings) for k, spellings in ALIASES.items()}
    optional = [c for c in dict.fromkeys(found.values()) if c and c not in KEPT]
    numeric = {*NUMERIC, *(c for c in found.values() if c)}
    base = df.select(*((E.number(F.col(f"`{c}`")).alias(c) if c in numeric else F.col(f"`{c}`")) for c in (*KEPT, *optional) if c in df.columns))
    return base.withColumns(information(base))


def with_features(df: DataFrame, rule: str = "substring") -> DataFrame:
    """``df`` with the features of its own rows, projections only; where names meet, ``df``'s columns stay, then the courses' features.

    No key is needed, so rows without an identifier have theirs too.
    """
    new = course_features(df, [], rule=rule).columns
    aside = {c: f"_own_{c}" for c in new if c in df.columns}  # while the courses' are made
    rows = df.withColumnsRenamed(aside)
    out = course_features(rows, rows.columns, rule=rule).drop(*aside).withColumnsRenamed({b: a for a, b in aside.items()})
    return out.withColumns({c: x for c, x in information(df).items() if c not in out.columns})


def row_checks(df: DataFrame) -> DataFrame:
    """Flags of implausible rows: a graduating average below the earlier one, and no enrolled terms."""
    terms = resolve_col(df.columns, *ALIASES["enrolled"])
    x = lambda c: E.number(column_or_null(df, c, "double"))
    lower = F.coalesce(x("graduating_cgpa") < x("cgpa_at_etm_to_any_campus"), F.lit(False))
    return df.withColumns({"graduating_lt_etm": lower, "enrolled_terms_zero_or_neg": F.coalesce(x(terms) <= 0, F.lit(False))})
