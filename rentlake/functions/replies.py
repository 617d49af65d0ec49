"""Model replies: ten 0..10 criteria read from JSON, and the prompts that ask for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlake import fixed_values as V
from rentlake.criteria import Criteria
from rentlake.functions.amounts import total_cost
from rentlake.functions.regex import cut, half_up, stages, strip


def clamp10(value: Column) -> Column:
    """Rounded to 0..10; NULL, NaN and infinity give 0."""
    double = value.cast("double")
    finite = F.abs(double) < float("inf")  # NaN is larger than any number
    return F.when(finite, F.least(F.lit(10), F.greatest(F.lit(0), half_up(double)))).otherwise(F.lit(0)).cast("int")


def document(response: Column) -> Column:
    """The reply as a variant; NULL if it is no JSON."""
    return F.try_parse_json(response)


def _criteria(doc: Column, kind: str) -> Column:
    """The asked criteria as one struct, read in one call; what does not fit the type is NULL there."""
    return F.try_variant_get(doc, "$", f"struct<{', '.join(f'{k}: {kind}' for k in V.REPLY_KEYS)}>")


def _clamped(numbers: Column) -> Column:
    fields = [clamp10(numbers[k]).alias(k) for k in V.REPLY_KEYS]
    return F.struct(*fields, F.lit(0).alias("proximityToReference"))


def criteria_scores(doc: Column) -> Column:
    """Struct of the nine asked criteria; proximity is filled in by us."""
    return _clamped(_criteria(doc, "double"))


def composite(scores: Column) -> Column:
    total = F.lit(0)
    for key in V.RATING_KEYS:
        total = total + scores[key]
    return F.least(F.lit(100), F.greatest(F.lit(0), total)).cast("int")


def scores_text(c: Criteria, scores: Column, total: Column | None = None) -> Column:
    """One line with every criterion and the sum (``total``, if it is at hand)."""
    total = composite(scores) if total is None else total
    labels = {key: label for key, label, _ in c.rating_labels}
    names = F.array(*[F.lit(f"{labels.get(k, k)} ") for k in V.RATING_KEYS])
    # a function of two arrays ends the generated method, which the JVM compiles up to 8,000 bytes only
    parts = F.zip_with(names, F.array(*[scores[k] for k in V.RATING_KEYS]), lambda name, own: F.concat(name, own.cast("string"), F.lit("/10")))
    return F.concat(F.lit("🤖 AI ("), total.cast("string"), F.lit("/100): "), F.concat_ws(", ", parts))


def summary(doc: Column) -> Column:
    is_text = F.schema_of_variant(F.try_variant_get(doc, "$.summary", "variant")) == "STRING"
    return F.when(is_text, strip(F.try_variant_get(doc, "$.summary", "string")))


def risk_level(doc: Column) -> Column:
    return F.coalesce(F.try_variant_get(doc, "$.riskLevel", "string"), F.lit("none"))


def risk_reasons(doc: Column) -> Column:
    return F.coalesce(F.try_variant_get(doc, "$.riskReasons", "array<string>"), F.array().cast("array<string>"))


def with_proximity(scores: Column, proximity: Column) -> Column:
    own = F.when(proximity.isNull(), scores["proximityToReference"]).otherwise(clamp10(proximity))
    return scores.withField("proximityToReference", own)


def with_result(df: DataFrame, c: Criteria, response: str, prefix: str, proximity: Column | None = None) -> DataFrame:
    """Add composite, scores, summary, risk and text line of a reply; NULL where it holds no criterion."""
    doc, numbers, texts, scores = (F.col(f"_{prefix}{n}") for n in ("doc", "numbers", "texts", "scores"))
    ok = F.col(f"{prefix}usable")
    read = _clamped(numbers)
    # read in one call each: the steps run in one generated method, which the JVM compiles up to 8,000 bytes only
    df = stages(
        df,
        {f"_{prefix}doc": document(F.col(response))},
        {f"_{prefix}texts": _criteria(doc, "string")},
        {f"{prefix}usable": F.coalesce(*[texts[k] for k in V.REPLY_KEYS]).isNotNull(), f"_{prefix}numbers": _criteria(doc, "double")},
        {f"_{prefix}scores": read if proximity is None else with_proximity(read, proximity)},
        {f"{prefix}composite": F.when(ok, composite(scores))},
    )
    fields = {
        "scores": scores,
        "summary": summary(doc),
        "risk_level": risk_level(doc),
        "risk_reasons": risk_reasons(doc),
        "line": scores_text(c, scores, F.col(f"{prefix}composite")),
    }
    return df.withColumns({f"{prefix}{n}": F.when(ok, x) for n, x in fields.items()}).drop(
        *[f"_{prefix}{n}" for n in ("doc", "numbers", "texts", "scores")]
    )


def listing_json(title, rent_eur, fee_eur, area_sqm, rooms, hint, snippet) -> Column:
    """Listing facts as JSON; unknown fields are left out."""
    text = F.to_json(
        F.struct(
            title.alias("title"),
            rent_eur.alias("rentEur"),
            fee_eur.alias("condoFeeEur"),
            total_cost(rent_eur, fee_eur).alias("totalCostEur"),
            area_sqm.cast("double").alias("areaSqm"),
            rooms.cast("double").alias("rooms"),
            hint.alias("location"),
            cut(snippet, 800).alias("snippet"),
        )
    )
    return F.regexp_replace(text, r'("(?:areaSqm|rooms)":\d+)\.0(?=[,}])', "$1")


def fill(template: str | Column, values: dict[str, str | Column]) -> Column:
    """Replace ``{{key}}`` by its value, one key after the other."""
    out = F.lit(template) if isinstance(template, str) else template
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), F.lit(value) if isinstance(value, str) else value)
    return out


def _limits_text(c: Criteria) -> str:
    def show(value):
        return "?" if value is None else (str(int(value)) if float(value).is_integer() else str(value))

    return "; ".join(
        (
            f"rooms {show(c.rooms_min)}-{show(c.rooms_max)}",
            f"area {show(c.area_min)}-{show(c.area_max)} m² (strict: greater than min, less than max)",
            f"rent {show(c.rent_min)}-{show(c.rent_max)} EUR/month (strict)",
            f"preferred zones: {', '.join(z.name for z in c.zones) or '—'}",
            f"reference metro stations: {', '.join(c.landmarks) or '—'}",
        )
    )


def prompt_values(c: Criteria) -> dict[str, str]:
    """Everything in the prompt that does not depend on the row."""
    values = {
        "hardCriteria": _limits_text(c),
        "jsonKeys": ", ".join(V.REPLY_KEYS),
        "referenceName": c.reference_name or "",
        "targetZones": c.rating_zones or ", ".join(z.name for z in c.zones) or "Torino",
        "preferredMetro": c.rating_landmarks or ", ".join(c.landmarks) or "Bernini, Rivoli, Monte Grappa",
        "locale": c.locale,
    }
    lines = []
    for key, label, description in c.rating_labels:
        for name, value in values.items():
            description = description.replace("{{" + name + "}}", value)
        lines.append(f"- {key}: {label}" + (f" — {description}" if description else ""))
    return {**values, "criteriaKeys": "\n".join(lines), "aiSuggestionPrompt": c.tip_prompt or V.TIP_RULES}


def prompt(c: Criteria, payload: Column) -> Column:
    """Prompt per listing: the listing goes in first, then the folded constants.

    The constants are put into the text around the listing once; only a listing that itself holds what
    may be a placeholder has them replaced in its whole prompt.
    """
    if not c.rating_prompt:
        raise ValueError("criteria hold no rating prompt")
    values = prompt_values(c)
    whole = fill(c.rating_prompt, {"listingJson": payload, **values})
    around = c.rating_prompt.split("{{listingJson}}")
    for key, value in values.items():
        around = [part.replace("{{" + key + "}}", value) for part in around]
    if len(around) == 1 or any(part.endswith("{") or part.rfind("{{") > part.rfind("}}") for part in around[:-1]):
        return whole  # no listing, or a placeholder could begin before it
    pieces = [F.lit(around[0])]
    for part in around[1:]:
        pieces += [payload, F.lit(part)]
    odd = F.contains(payload, F.lit("{{")) | F.endswith(payload, F.lit("{"))
    return F.when(odd, whole).otherwise(F.concat(*pieces))
