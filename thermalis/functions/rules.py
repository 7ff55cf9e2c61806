"""Ordered tag rules; the first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Group and asset vocabularies, their order and weights.
GROUP_ORDER = ("oil_gas", "steel_cement", "thermal_power", "mining", "kiln", "industrial_other")
CLASS_OF_GROUP = {"oil_gas": "oil_gas", "steel_cement": "heavy_industry", "thermal_power": "heavy_industry", "industrial_other": "heavy_industry", "mining": "mining"}
CRITICALITY = {
    "nuclear_power_station": 1.0, "lng_lpg_terminal": 1.0, "oil_refinery": 0.95, "petrochemical": 0.9, "chemical_plant": 0.8, "thermal_power_station": 0.7, "fertiliser_plant": 0.7,
    "oil_gas_field": 0.6, "major_port": 0.6, "steel_cement": 0.5, "mine": 0.4, "industrial_estate": 0.3, "kiln": 0.25,
}
CLASS_CRITICALITY = {"oil_gas": 0.8, "heavy_industry": 0.6, "mining": 0.4, "industrial": 0.3, "kiln": 0.25, "offshore": 0.6}
ASSET_OF_GROUP = {"oil_gas": "oil_gas_field", "steel_cement": "steel_cement", "thermal_power": "thermal_power_station", "mining": "mine", "kiln": "kiln", "industrial_other": "industrial_estate"}
FUEL_ASSET = {"Nuclear": "nuclear_power_station"} | dict.fromkeys(("Coal", "Gas", "Oil", "Biomass", "Petcoke", "Cogeneration", "Waste"), "thermal_power_station")


def lookup(table: dict, key: Column) -> Column:
    """table[key], null where absent."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def rank_of(group: Column) -> Column:
    """Place of a label group in GROUP_ORDER, from 1; null for others."""
    return lookup({g: i for i, g in enumerate(GROUP_ORDER, 1)}, group)


def label_group(tags: Column) -> Column:
    """The label group of a feature from its tags (a map), or null."""
    tag = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    industrial, made = tag("industrial"), tag("man_made")
    return (
        F.when(industrial.isin("refinery", "oil") | made.isin("petroleum_well", "flare"), "oil_gas")
        .when(((made == "works") & tag("product").rlike("steel|iron|cement|alumin")) | industrial.isin("steel", "cement"), "steel_cement")
        .when((tag("power") == "plant") & tag("plant:source").rlike("coal|gas|oil|diesel|biomass"), "thermal_power")
        .when((tag("landuse") == "quarry") | (tag("resource") == "coal") | (industrial == "mine") | (made == "mineshaft"), "mining")
        .when((made == "kiln") | industrial.isin("brickyard", "brickworks"), "kiln")
        .when((tag("landuse") == "industrial") | (made == "works") | (industrial == "factory"), "industrial_other")
    )


def asset_type(group: Column, tags: Column) -> Column:
    """The asset type of a labelled feature."""
    tag = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    text = F.lower(F.concat_ws(" ", *[tag(k) for k in ("industrial", "product", "name", "operator", "man_made")]))
    return (
        F.when(text.rlike(r"\blng\b|\blpg\b|liquefied"), "lng_lpg_terminal")
        .when(text.contains("refinery"), "oil_refinery")
        .when(text.contains("petrochem"), "petrochemical")
        .when(text.rlike("fertili[sz]er|urea"), "fertiliser_plant")
        .when(tag("industrial").isin("chemical", "pharmaceutical") | text.rlike("chemical|pharma"), "chemical_plant")
        .otherwise(lookup(ASSET_OF_GROUP, group))
    )
