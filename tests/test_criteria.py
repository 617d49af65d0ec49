"""Criteria file and what follows from it."""

from dataclasses import replace

from rentlake import criteria


def test_default_criteria():
    c = criteria.load()
    assert (c.rooms_min, c.rooms_max, c.area_min, c.area_max, c.rent_min, c.rent_max, c.total_max) == (2, 5, 50, 90, 300, 800, 950)
    assert [z.name for z in c.zones] == ["Cenisia", "Cit Turin", "Pozzo Strada", "San Donato", "Piazza Bernini"]
    assert c.buckets[0] == (500, 10) and c.use_fallback_places and c.rules_weight == 0.3


def test_empty_criteria_have_open_limits():
    c = criteria.parse("hard: {}")
    assert c.limit("rooms_max", 99) == 99 and c.zones == () and c.tip_prompt is None


def test_proximity_needs_a_point_and_may_be_switched_off():
    c = criteria.load()
    assert c.proximity_enabled
    assert not replace(c, reference_lat=None).proximity_enabled
    assert not replace(c, geocoding_enabled=False).proximity_enabled
