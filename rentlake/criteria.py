"""Search criteria: a YAML file read once at the driver, handed to column builders."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

DEFAULT_PATH = Path(__file__).resolve().parent.parent / "config" / "criteria.yaml"


@dataclass(frozen=True)
class Zone:
    name: str
    aliases: tuple[str, ...] = ()


@dataclass(frozen=True)
class Criteria:
    rooms_min: float | None = None
    rooms_max: float | None = None
    area_min: float | None = None
    area_max: float | None = None
    rent_min: int | None = None
    rent_max: int | None = None
    total_max: int | None = None
    zones: tuple[Zone, ...] = ()
    landmarks: tuple[str, ...] = ()
    avoid: tuple[str, ...] = ()
    locale: str = "en"
    model_weight: float = 0.7
    rules_weight: float = 0.3
    zone_miss_penalty: int = 20
    reference_name: str | None = None
    reference_lat: float | None = None
    reference_lng: float | None = None
    geocoding_enabled: bool = True
    use_fallback_places: bool = False
    city_suffix: str | None = None
    buckets: tuple[tuple[int, int], ...] = ()
    missing_score: int = 5
    proximity_bonus: int = 15
    rating_labels: tuple[tuple[str, str, str], ...] = ()
    rating_prompt: str | None = None
    rating_zones: str | None = None
    rating_landmarks: str | None = None
    tip_prompt: str | None = None
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def proximity_enabled(self) -> bool:
        return self.reference_lat is not None and self.geocoding_enabled

    def limit(self, name: str, default):
        value = getattr(self, name)
        return default if value is None else value


def _joined(value):
    return ", ".join(value) if isinstance(value, (list, tuple)) else value


def parse(text: str) -> Criteria:
    doc = yaml.safe_load(text) or {}
    hard, soft = doc.get("hard") or {}, doc.get("soft") or {}
    scoring, rating = doc.get("scoring") or {}, doc.get("llmRating") or {}
    point, geo = scoring.get("referencePoint") or {}, scoring.get("geocoding") or {}
    distance, ref = scoring.get("distanceScore") or {}, rating.get("reference") or {}
    tip = ((doc.get("telegram") or {}).get("aiSuggestion") or {}).get("prompt")
    return Criteria(
        rooms_min=hard.get("roomsMin"),
        rooms_max=hard.get("roomsMax"),
        area_min=hard.get("areaMinSqm"),
        area_max=hard.get("areaMaxSqm"),
        rent_min=hard.get("rentMinEur"),
        rent_max=hard.get("rentMaxEur"),
        total_max=hard.get("totalCostMaxEur"),
        zones=tuple(Zone(z["name"], tuple(z.get("aliases") or ())) for z in hard.get("zones") or ()),
        landmarks=tuple(hard.get("metroStations") or ()),
        avoid=tuple(soft.get("avoid") or ()),
        locale=doc.get("locale") or "en",
        model_weight=float(scoring.get("llmWeight", 0.7)),
        rules_weight=float(scoring.get("rulesWeight", 0.3)),
        zone_miss_penalty=scoring.get("zoneMissPenalty", 20),
        reference_name=point.get("name"),
        reference_lat=point.get("lat"),
        reference_lng=point.get("lng"),
        geocoding_enabled=geo.get("enabled") is not False,
        use_fallback_places=geo.get("fallbackProvider") == "photon",
        city_suffix=geo.get("citySuffix"),
        buckets=tuple(sorted((b["maxM"], b["score"]) for b in distance.get("buckets") or ())),
        missing_score=distance.get("missingScore", 5),
        proximity_bonus=scoring.get("rulesProximityBonus", 15),
        rating_labels=tuple(
            (d["key"], d["label"], d.get("description") or "") for d in rating.get("criteria") or ()
        ),
        rating_prompt=rating.get("prompt"),
        rating_zones=ref.get("targetZones"),
        rating_landmarks=_joined(ref.get("preferredMetro")),
        tip_prompt=(tip or "").strip() or None,
    )


def load(path: str | Path = DEFAULT_PATH) -> Criteria:
    return parse(Path(path).read_text(encoding="utf-8"))
