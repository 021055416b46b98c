"""Page conditions: rules that turn measurements into conditions, and conditions into assessments and actions.

A page's conditions travel as one array in the order they were found, so a page is one row and rules are array
functions. Where a rule as published names conditions that do not exist (rotated clockwise by 90 or 270, inverted), the
evident ones are meant: rotated_90_cw, rotated_90_ccw, rotated_180.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ACTION_GROUP, ACTION_RANK, CONDITION_MODIFIER, FAILED_QUALITY, GOOD_NOTE, HORIZONTAL, IMPACT_CAP, NOTES, QUALITY_EVIDENCE, QUALITY_ISSUES, QUALITY_NOTE, ROTATIONS, SECONDARY_WEIGHT, SEVERITY_IMPACT, SUCCESS_FLOOR, TURN_NAMES, TURN_NOTE, UPSIDE_DOWN
from ..sources.tables import mapped

TURNS = (*ROTATIONS, "skewed")


def condition(name, severity, confidence, evidence, actions) -> Column:
    return F.struct(name.alias("condition"), severity.alias("severity"), confidence.alias("confidence"), evidence.alias("evidence"), actions.alias("actions"))


def made(ok: Column, name: str, severity, confidence, evidence, actions: list[str]) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(ok, condition(F.lit(name), c(severity), c(confidence), c(evidence), F.array(*map(F.lit, actions))))


def two(c: Column) -> Column:
    """Two decimals, halves to even."""
    return F.call_function("format_number", c, F.lit("0.00"))


def rotation_decision(text: Column, edge: Column, aspect: Column) -> tuple[Column, Column]:
    """Angle (0, 90, 180, 270) and confidence from the two orientation estimates in degrees and width / height."""
    c = F.lit(0.7) * text + F.lit(0.3) * edge
    steps = ((c.between(-15, 15), 0, 0.9), ((c > 15) & (c <= 75), 270, 0.85), ((c > 75) & (c <= 105), 270, 0.9), ((c >= -75) & (c < -15), 90, 0.85), ((c >= -105) & (c < -75), 90, 0.9))
    angle, conf = F.lit(180), F.lit(0.8)
    for ok, a, p in reversed(steps):
        angle, conf = F.when(ok, a).otherwise(angle), F.when(ok, p).otherwise(conf)
    gap = F.abs(text - edge)
    conf = conf + F.when(((aspect < 0.7) | (aspect > 1.4)) & angle.isin(90, 270), 0.05).otherwise(0.0) + F.when(gap < 15, 0.05).when(gap > 45, -0.1).otherwise(0.0)
    return angle, F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0))


def of_rotation(angle: Column, confidence: Column) -> Column:
    name = F.when(angle == 90, "rotated_90_ccw").when(angle == 180, "rotated_180").when(angle == 270, "rotated_90_cw")
    fix = F.when(angle == 90, "rotate_90_cw").when(angle == 180, "rotate_180").when(angle == 270, "rotate_90_ccw")
    severity = F.when(angle == 180, "moderate").otherwise("severe")
    return F.when((angle != 0) & (confidence >= 0.5) & name.isNotNull(), condition(name, severity, confidence, F.concat(F.lit("rotation "), angle.cast("string")), F.array(fix)))


def of_skew(angle: Column, confidence: Column) -> Column:
    severity = F.when(F.abs(angle) >= 10, "severe").otherwise("moderate")
    return F.when((F.abs(angle) >= 2) & (confidence >= 0.5), condition(F.lit("skewed"), severity, confidence, F.concat(F.lit("skew "), F.call_function("format_number", angle, F.lit("0.0"))), F.array(F.lit("deskew"))))


def of_quality(contrast: Column, brightness: Column, sharpness: Column, noise: Column) -> Column:
    """Quality conditions of a page as an array, in a fixed order."""
    low = {"low_contrast": (contrast < 0.4, F.when(contrast < 0.2, "severe").otherwise("moderate"), contrast), "dark_image": (brightness < 0.3, F.lit("moderate"), brightness), "blurry_image": (sharpness < 0.3, F.lit("moderate"), sharpness), "noisy_image": (noise > 0.6, F.lit("moderate"), noise)}
    return F.array_compact(F.array(*[made(ok, QUALITY_ISSUES[k][0], severity, 0.8, F.format_string(QUALITY_EVIDENCE[k], two(value)), [QUALITY_ISSUES[k][1]]) for k, (ok, severity, value) in low.items()]))


def of_content(handwriting: Column, handwriting_score: Column, columns: Column, layout: Column) -> Column:
    return F.array_compact(F.array(
        made(handwriting, "handwritten", "moderate", handwriting_score, F.concat(F.lit("handwriting "), two(handwriting_score)), ["enhance_contrast", "denoise"]),
        made(columns > 1, "multi_column", "mild", 0.8, F.concat(F.lit("columns "), columns.cast("string")), ["no_action"]),
        made(layout == "complex", "complex_layout", "mild", 0.7, "complex layout", ["no_action"]),
    ))


def layout_complexity(contours: Column, area_mean: Column, area_std: Column) -> Column:
    """area_mean and area_std are over areas of more than 100; null where there is none, which is simple."""
    cv = F.coalesce(F.try_divide(area_std, area_mean), F.lit(0.0))
    return F.when((contours == 0) | area_mean.isNull(), "simple").when((contours < 20) & (cv < 1), "simple").when((contours < 100) & (cv < 2), "moderate").otherwise("complex")


def by_page(conditions: DataFrame, *keys: str) -> DataFrame:
    """Condition rows (pos, condition, severity, confidence, evidence, actions, is_primary) -> one row per page with the
    array `found` in order of pos. A page has few conditions by nature."""
    row = F.struct("pos", "condition", "severity", "confidence", "evidence", "actions", "is_primary")
    return conditions.groupBy(*(keys or ("page_id",))).agg(F.array_sort(F.collect_list(row)).alias("found"))


def names(found: Column) -> Column:
    return F.transform(found, lambda c: c["condition"])


def all_actions(found: Column) -> Column:
    """Actions of all conditions, each once, in order of first mention."""
    return F.array_distinct(F.flatten(F.transform(found, lambda c: c["actions"])))


def grouped_order(actions: Column, skip: tuple[str, ...] = ()) -> Column:
    """Actions by their group, in the given order within one; actions of no group last. skip: names without a group."""
    groups = {k: v for k, v in ACTION_GROUP.items() if k not in skip}
    ranked = F.transform(F.array_distinct(actions), lambda a, i: F.struct(mapped(groups, a, 99).alias("g"), i.alias("i"), a.alias("a")))
    return F.transform(F.array_sort(ranked), lambda s: s["a"])


def ranked_order(actions: Column) -> Column:
    """Actions by their rank, by name among equals; unknown ones last."""
    ranked = F.transform(F.array_distinct(actions), lambda a: F.struct(mapped(ACTION_RANK, a, 99).alias("g"), a.alias("a")))
    return F.transform(F.array_sort(ranked), lambda s: s["a"])


def assessed(pages: DataFrame) -> DataFrame:
    """Assessment by measurement: quality, priority, success, rotation, issues (severe, then moderate), actions, notes."""
    of = lambda s: F.filter("found", lambda c: c["severity"] == s)
    severe, moderate = of("severe"), of("moderate")
    turned = F.exists(names(F.col("found")), lambda n: n.isin(*ROTATIONS))
    none = F.size("found") == 0
    success = F.when(none, 0.9).when(F.size(severe) > 0, 0.4).when(F.size(moderate) > 0, 0.7).otherwise(0.9)
    actions = grouped_order(all_actions(F.col("found")), ("straighten_perspective", "histogram_equalization"))
    return pages.select(
        "*", F.when(none, "Good").when(F.size(severe) > 0, "Poor").when(F.size(moderate) > 0, "Fair").otherwise("Good").alias("quality"),
        F.when(none, 5).when(F.size(severe) > 0, 1).when(F.size(moderate) > 2, 2).when(F.size(moderate) > 0, 3).otherwise(4).alias("priority"),
        F.when(turned, F.greatest(success, F.lit(0.6))).otherwise(success).alias("success_rate"), turned.alias("rotation_detected"),
        F.concat(severe, moderate).alias("primary_issues"), of("mild").alias("secondary_issues"),
        F.when(F.size(actions) == 0, F.array(F.lit("no_action"))).otherwise(actions).alias("recommendations"), special_notes(F.col("found")).alias("notes"),
    )


def special_notes(found: Column) -> Column:
    """Handling notes joined by "; ", or null."""
    has = lambda n: F.array_contains(names(found), n)
    turn = F.transform(F.filter(names(found), lambda n: n.isin(*ROTATIONS)), lambda n: mapped(TURN_NAMES, n))
    poor = F.size(F.filter(names(found), lambda n: n.isin("poor_quality", "blurry", "low_contrast", "dark_background")))
    notes = F.array_compact(F.array(*[F.when(has(n), note) for n, note in NOTES.items()], F.when(F.size(turn) > 0, F.concat(F.lit(TURN_NOTE), F.array_join(turn, ", "))), F.when(poor > 2, QUALITY_NOTE)))
    return F.when(F.size(found) == 0, GOOD_NOTE).when(F.size(notes) > 0, F.array_join(notes, "; "))


def _score(text: Column, phrases) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(text, p)))


def repaired(pages: DataFrame) -> DataFrame:
    """Orientation repair, then conflict resolution.

    The last quarter turn found becomes a half turn, as do all others, if its evidence speaks of an upside-down page and
    no half turn was found. Of several turns the one that comes first in TURNS stays. Deviation: turns are collected
    again after the repair, so that the repaired one takes part; as published it would be lost beside a skew.
    """
    quarter = F.filter("found", lambda c: c["condition"].isin("rotated_90_cw", "rotated_90_ccw"))
    last = F.try_element_at(quarter, F.lit(-1))
    said = F.lower(last["evidence"])
    up, flat = _score(said, UPSIDE_DOWN), _score(said, HORIZONTAL)
    wrong = (F.size(quarter) > 0) & ~F.array_contains(names(F.col("found")), "rotated_180") & ((up >= 2) | ((up >= 1) & (flat >= 1)))
    out = pages.withColumn("_last", last).withColumn("was_repaired", F.coalesce(wrong, F.lit(False)))
    half = lambda c: F.struct(
        c["pos"].alias("pos"), F.lit("rotated_180").alias("condition"), F.col("_last.severity").alias("severity"), F.least(F.lit(0.9), F.col("_last.confidence") + 0.1).alias("confidence"),
        F.concat_ws("", F.lit("Corrected from "), F.col("_last.condition"), F.lit(": "), F.col("_last.evidence")).alias("evidence"), F.array(F.lit("rotate_180")).alias("actions"), c["is_primary"].alias("is_primary"),
    )
    changed = F.when(F.col("was_repaired"), F.transform("found", lambda c: F.when(c["condition"].isin("rotated_90_cw", "rotated_90_ccw"), half(c)).otherwise(c))).otherwise(F.col("found"))
    out = out.withColumn("found", changed).drop("_last")
    rank = lambda n: mapped({n: i for i, n in enumerate(TURNS)}, n)
    turns = F.filter("found", lambda c: c["condition"].isin(*TURNS))
    kept = F.array_min(F.transform(turns, lambda c: F.struct(rank(c["condition"]).alias("r"), (~c["is_primary"]).alias("s"), c["pos"].alias("pos"))))
    out = out.withColumns({"n_turns": F.size(turns), "_kept": kept})
    one = F.filter("found", lambda c: ~c["condition"].isin(*TURNS) | (c["pos"] == F.col("_kept.pos")))
    return out.withColumn("found", F.when(F.col("n_turns") > 1, one).otherwise(F.col("found"))).drop("_kept")


def success_rate(found: Column) -> Column:
    """1 less the capped sum of severity, modifier and confidence; secondary conditions weigh less."""
    each = F.transform(found, lambda c: mapped(SEVERITY_IMPACT, c["severity"], 0.2) * F.when(c["is_primary"], 1.0).otherwise(SECONDARY_WEIGHT) * mapped(CONDITION_MODIFIER, c["condition"], 1.0) * c["confidence"])
    total = F.aggregate(each, F.lit(0.0), lambda a, b: a + b)
    return F.greatest(F.lit(SUCCESS_FLOOR), F.lit(1.0) - F.least(total, F.lit(IMPACT_CAP)))


def priority(found: Column) -> Column:
    """1 (first) to 5 from the primary conditions."""
    p = F.filter(found, lambda c: c["is_primary"])
    any_of = lambda f: F.exists(p, f)
    return F.when(any_of(lambda c: c["severity"] == "critical"), 1).when(any_of(lambda c: (c["severity"] == "severe") | c["condition"].isin(*ROTATIONS)), 2).when(F.size(p) > 2, 3).when(F.size(p) > 0, 4).otherwise(5)


def enhanced(pages: DataFrame) -> DataFrame:
    """Assessment by model, completed: recommendations, success_rate, priority, complexity."""
    out = pages.withColumns({"recommendations": ranked_order(all_actions(F.col("found"))), "success_rate": success_rate(F.col("found")), "priority": priority(F.col("found"))})
    n = F.size("recommendations")
    return out.withColumn("complexity", F.when(n > 6, "high").when(n > 3, "medium").otherwise("low"))


def worth_processing(recommendations: Column, priority_: Column, success: Column) -> Column:
    """Not for pages without recommendations, with a low priority or that are good as they are."""
    return (F.size(recommendations) > 0) & (priority_ <= 3) & (success <= 0.8)


def first_is_action(recommendations: Column) -> Column:
    return F.coalesce(F.get(recommendations, F.lit(0)) != "no_action", F.lit(False))


def fallback(pages: DataFrame) -> DataFrame:
    """What stands in for an assessment that failed."""
    return pages.withColumns({
        "quality": F.lit(FAILED_QUALITY), "issue": F.lit("poor_quality"), "severity": F.lit("moderate"), "confidence": F.lit(0.3), "priority": F.lit(3), "success_rate": F.lit(0.5),
        "recommendations": F.array(F.lit("enhance_contrast"), F.lit("denoise"), F.lit("sharpen")),
    })


def readable(pages: DataFrame) -> DataFrame:
    """Enhanced assessments for people: success in percent, and the last primary condition that turns or skews a page."""
    turned = F.filter("found", lambda c: c["is_primary"] & c["condition"].isin(*TURNS))
    return pages.withColumns({"success": F.concat(F.call_function("format_number", F.col("success_rate") * 100, F.lit("0.0")), F.lit("%")), "orientation": F.try_element_at(turned, F.lit(-1))["condition"]})
