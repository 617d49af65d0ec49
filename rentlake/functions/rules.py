"""Hard criteria, rule score, risk flags and the blend with model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentlake import fixed_values as V
from rentlake.criteria import Criteria
from rentlake.functions.amounts import total_cost
from rentlake.functions.places import distance_text
from rentlake.functions.regex import half_up, has, number_text


def search_text(snippet: Column, hint: Column, title: Column) -> Column:
    blank = F.lit("")
    return F.lower(F.concat_ws(" ", F.coalesce(snippet, blank), F.coalesce(hint, blank), F.coalesce(title, blank)))


def _plain(value) -> str:
    return str(int(value)) if float(value).is_integer() else str(value)


def _outside(value: Column, low, high) -> Column:
    """Strictly between is inside."""
    return ~((value > low) & (value < high))


def hard_failures(c: Criteria, text, rooms, area_sqm, rent_eur, fee_eur) -> Column:
    """Reasons why a listing breaks the limits; unknown values never do."""
    r0, r1 = c.limit("rooms_min", 0), c.limit("rooms_max", 99)
    a0, a1 = c.limit("area_min", 0), c.limit("area_max", 999)
    e0, e1 = c.limit("rent_min", 0), c.limit("rent_max", 99999)
    checks = [
        F.when(F.contains(text, F.lit(p.lower().strip())), F.lit(f"avoid: {p}")) for p in c.avoid if p.strip()
    ]
    checks += [
        F.when(
            (rooms < r0) | (rooms > r1),
            F.concat(number_text(rooms), F.lit(f" rooms — out of range ({_plain(r0)}–{_plain(r1)})")),
        ),
        F.when(
            _outside(area_sqm, a0, a1),
            F.concat(number_text(area_sqm), F.lit(f" m² — out of range ({_plain(a0)}–{_plain(a1)} m², strict)")),
        ),
        F.when(
            _outside(rent_eur, e0, e1),
            F.concat(rent_eur.cast("string"), F.lit(f"€ — outside budget {_plain(e0)}–{_plain(e1)}€")),
        ),
    ]
    if c.total_max is not None:
        total = rent_eur + fee_eur
        checks.append(
            F.when(total > c.total_max, F.concat(F.lit("total "), total.cast("string"), F.lit(f"€ > {c.total_max}€")))
        )
    return F.array_compact(F.array(*checks))


def meets_hard(c: Criteria, text, rooms, area_sqm, rent_eur, fee_eur) -> Column:
    return F.size(hard_failures(c, text, rooms, area_sqm, rent_eur, fee_eur)) == 0


def matched_zones(c: Criteria, text: Column) -> Column:
    """Names of the zones the text mentions, in the order of the criteria."""
    found = []
    for zone in c.zones:
        hit = F.lit(False)
        for word in dict.fromkeys(w.lower() for w in (zone.name, *zone.aliases)):
            hit = hit | F.contains(text, F.lit(word))
        found.append(F.when(hit, F.lit(zone.name)))
    return F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def near_landmark(c: Criteria, text: Column) -> Column:
    hit = F.lit(False)
    for name in c.landmarks:
        hit = hit | F.contains(text, F.lit(name.lower()))
    return hit


def risk_flags(text: Column, rent_eur: Column) -> Column:
    payment, messenger, price = V.RISK_FLAGS
    return F.array_compact(
        F.array(
            F.when(has(text, V.RISK_PAYMENT), F.lit(payment)),
            F.when(has(text, V.RISK_MESSENGER), F.lit(messenger)),
            F.when(rent_eur < V.RISK_RENT_BELOW, F.lit(price)),
        )
    )


def proximity_bonus(score: Column, most: int) -> Column:
    return half_up(score / F.lit(10) * F.lit(most))


def _points(condition: Column, plus: int, minus: int) -> Column:
    """Points for a known fact, 0 where the fact is unknown."""
    return F.when(condition, F.lit(plus)).when(~condition, F.lit(-minus)).otherwise(F.lit(0))


def rule_score(c: Criteria, text, rooms, area_sqm, rent_eur, fee_eur, proximity=None, distance_m=None) -> Column:
    """Struct of score 0..100, reasons, risk level, risk reasons and risk source."""
    a0, a1 = c.limit("area_min", 0), c.limit("area_max", 999)
    e0, e1 = c.limit("rent_min", 0), c.limit("rent_max", 99999)
    total = total_cost(rent_eur, fee_eur)
    total_text = F.concat(F.lit("total "), total.cast("string"), F.lit("€"))
    rooms_ok = rooms.between(c.limit("rooms_min", 0), c.limit("rooms_max", 99))
    area_ok, rent_ok = ~_outside(area_sqm, a0, a1), ~_outside(rent_eur, e0, e1)
    fee_known = rent_eur.isNotNull() & fee_eur.isNotNull() & F.lit(c.total_max is not None)
    total_ok = F.when(fee_known, total <= F.lit(c.total_max))
    score = F.lit(50) + _points(rooms_ok, 15, 20) + _points(area_ok, 15, 15)
    score = score + _points(rent_ok, 15, 25) + _points(total_ok, 5, 15)
    lines = [
        F.concat(number_text(rooms), F.when(rooms_ok, F.lit(" rooms — ok")).otherwise(F.lit(" rooms — out of range"))),
        F.concat(
            number_text(area_sqm),
            F.when(area_ok, F.lit(" m² — ok")).otherwise(F.lit(f" m² — out of range ({_plain(a0)}–{_plain(a1)} m²)")),
        ),
        F.concat(
            rent_eur.cast("string"),
            F.when(rent_ok, F.lit("€ rent — within budget")).otherwise(
                F.lit(f"€ — outside budget {_plain(e0)}–{_plain(e1)}€")
            ),
        ),
        F.when(total_ok, F.concat(total_text, F.lit(" with spese — ok")))
        .when(~total_ok, F.concat(total_text, F.lit(f" > {c.total_max}€")))
        .when(rent_eur.isNotNull() & fee_eur.isNull(), F.lit(V.FEE_MISSING_REASON)),
    ]
    if c.zones:
        zones = matched_zones(c, text)
        hit = F.size(zones) > 0
        score = score + F.when(hit, F.lit(25)).otherwise(F.lit(-c.zone_miss_penalty))
        lines.append(
            F.when(hit, F.concat(F.lit("zone: "), F.array_join(zones, ", "))).otherwise(F.lit(V.ZONE_MISS_REASON))
        )
    near = near_landmark(c, text)
    score = score + F.when(near, F.lit(8)).otherwise(F.lit(0))
    lines.append(F.when(near, F.lit(V.LANDMARK_REASON)))
    if proximity is not None and c.reference_name:
        score = score + F.coalesce(proximity_bonus(proximity, c.proximity_bonus), F.lit(0))
        rating = F.concat(proximity.cast("string"), F.lit("/10"))
        lines.append(
            F.when(
                distance_m.isNotNull(),
                F.concat(
                    F.lit("📍 "), distance_text(distance_m), F.lit(f" from {c.reference_name} ("), rating, F.lit(")")
                ),
            ).otherwise(F.concat(F.lit("📍 proximity "), rating, F.lit(f" ({c.reference_name})")))
        )
    flags = risk_flags(text, rent_eur)
    risky = F.size(flags) > 0
    score = score - F.size(flags) * F.lit(10)
    return F.struct(
        F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("int").alias("score"),
        F.array_compact(F.array(*lines)).alias("reasons"),
        F.when(risky, F.lit("high")).otherwise(F.lit("none")).alias("risk_level"),
        flags.alias("risk_reasons"),
        F.when(risky, F.lit("rules")).otherwise(F.lit("none")).alias("risk_source"),
    )


def blend(c: Criteria, rule: Column, composite: Column, double_weight: bool = True) -> Column:
    """Weighted rule score; with a model result the weight falls on the rule part twice."""
    wr, wm = F.lit(c.rules_weight), F.lit(c.model_weight)
    once = half_up(rule * wr)
    base = once * wr if double_weight else rule * wr
    both = half_up(base + composite * wm)
    final = F.when(composite.isNull(), once).otherwise(both)
    return F.least(F.lit(100), F.greatest(F.lit(0), final)).cast("int")


def merged_risk_level(rule_level: Column, model_level: Column) -> Column:
    return F.when(model_level == "high", F.lit("high")).otherwise(rule_level)


def merged_risk_reasons(rule_reasons: Column, model_level: Column, model_reasons: Column) -> Column:
    more = F.coalesce(model_reasons, F.array().cast("array<string>"))
    return F.when(model_level == "high", F.concat(rule_reasons, more)).otherwise(rule_reasons)
