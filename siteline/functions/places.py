"""Matching place categories by keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords by group, in the order in which groups are tried, and the groups' weights.
WALK_GROUPS = {
    "grocery": ["grocery", "supermarket", "food_store", "convenience_store"],
    "restaurant": ["restaurant", "fast_food", "food"],
    "shopping": ["shopping", "clothing_store", "department_store", "mall"],
    "cafe": ["cafe", "coffee_shop", "coffee"],
    "bank": ["bank", "atm", "financial_service"],
    "park": ["park", "playground", "garden", "recreation"],
    "school": ["school", "education", "university", "college"],
    "entertainment": ["entertainment", "cinema", "theater", "museum", "arts"],
    "fitness": ["fitness", "gym", "sports", "swimming_pool"],
    "pharmacy": ["pharmacy", "drugstore"],
    "healthcare": ["hospital", "clinic", "doctor", "healthcare", "medical"],
    "transit": ["bus_station", "train_station", "transit", "subway", "tram_stop"],
    "bookstore": ["bookstore", "library", "book_store"],
}
WALK_WEIGHTS = {"grocery": 3.0, "restaurant": 2.0, "shopping": 1.5, "cafe": 1.5, "bank": 1.0, "park": 2.0, "school": 2.0, "entertainment": 1.0, "fitness": 1.0, "pharmacy": 1.5, "healthcare": 2.0, "transit": 3.0, "bookstore": 0.5}
GREEN = ["park", "garden", "recreation", "playground", "nature", "reserve", "botanical", "forest"]
INDUSTRIAL = ["fuel_station", "gas_station", "petrol", "chemical_plant", "chemical", "dry_cleaning", "recycling_center", "scrap", "waste_management", "waste_disposal", "auto_repair", "car_repair", "mechanic"]
INDUSTRIAL_EXCLUDE = ["business_manufacturing", "industrial_equipment", "painting", "laundry_service", "warehouse", "commercial_industrial"]
NOISY = ["bar", "nightclub", "pub", "restaurant", "cafe", "construction", "factory", "industrial"]
OCEAN = ["ocean", "sea", "bay", "strait", "tidal_channel", "lagoon"]
INLAND = ["lake", "river", "reservoir", "water", "stream"]
NOT_MOTOR = ["footway", "path", "steps", "cycleway", "pedestrian", "track"]


def has_any(category: Column, words: list[str]) -> Column:
    """Whether any keyword is in the lower-cased category; null has none."""
    return F.coalesce(F.lower(category).rlike("|".join(words)), F.lit(False))


def match_group(category: Column) -> Column:
    """The first group with a keyword in the category; null if none has."""
    c = F.replace(F.lower(category), F.lit(" "), F.lit("_"))
    out = F.lit(None).cast("string")
    for group, words in reversed(WALK_GROUPS.items()):
        out = F.when(c.rlike("|".join(words)), F.lit(group)).otherwise(out)
    return out


def is_green(category: Column) -> Column:
    return has_any(category, GREEN)


def is_industrial(category: Column) -> Column:
    return has_any(category, INDUSTRIAL) & ~has_any(category, INDUSTRIAL_EXCLUDE)


def is_noisy(category: Column) -> Column:
    return has_any(category, NOISY)


def is_motor(road_class: Column) -> Column:
    """Whether a road class is for vehicles; an unknown class is."""
    return F.coalesce(~road_class.isin(NOT_MOTOR), F.lit(True))


def surf_note(nearest_beach: Column) -> Column:
    return F.when(nearest_beach < 200, "Surf noise likely dominant").when(nearest_beach < 500, "Surf noise audible").when(nearest_beach < 1000, "Surf noise faint")
