"""Seeded dimensions. Their rows are fixed values; each table is a few rows wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ---------------------------------------------------------------- fixed values
SITE_AREAS = [
    ("Open Cut - North Pit", "pit"),
    ("Open Cut - South Pit", "pit"),
    ("Processing Plant", "fixed_plant"),
    ("Site Services", "services"),
    ("Haul Fleet", "fleet"),
    ("Light Vehicles", "fleet"),
]
INCIDENT_TYPES = [
    ("DUS", "Dust & air quality"),
    ("VEH", "Vehicle & mobile equipment"),
    ("EQP", "Equipment & plant"),
    ("SLP", "Slip, trip & fall"),
    ("ENV", "Environmental"),
    ("ELE", "Electrical & power"),
    ("OTH", "Other / uncategorised"),
]
FACTOR_KEY_BY_ACTIVITY = {
    "Diesel combustion (stationary & transport)": "diesel",
    "Petrol (ULP) combustion": "petrol_ulp",
    "Grid electricity - Queensland": "grid_electricity_qld",
}
FACTOR_KEY_BY_FUEL = {"Diesel": "diesel", "Petrol (ULP)": "petrol_ulp"}
GRID_FACTOR_KEY = "grid_electricity_qld"
# -----------------------------------------------------------------------------


def site_areas(spark: SparkSession) -> DataFrame:
    """Global areas have no ``company_id``; tenants may own further ones."""
    return spark.createDataFrame(
        [(name, category, None) for name, category in SITE_AREAS],
        "name string, category string, company_id bigint")


def incident_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, label, True) for c, label in INCIDENT_TYPES],
                                 "code string, label string, is_inferred boolean")


def lookup(table: dict, key: Column) -> Column:
    """Constant mapping as a column expression: no join, null when absent."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
