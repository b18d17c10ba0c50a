"""Parcel attribute rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Land-use code labels of the parcel table.
LAND_USE_LABELS = {
    "01": "1-2 Family Residential",
    "02": "Multi-Family Walk-Up",
    "03": "Multi-Family Elevator",
    "04": "Mixed Res./Commercial",
    "05": "Commercial & Office",
    "06": "Industrial & Manufacturing",
    "07": "Transportation & Utility",
    "08": "Public Facilities",
    "09": "Open Space & Recreation",
    "10": "Parking Facilities",
    "11": "Vacant Land",
}

# Building-class prefix labels.
CLASS_PREFIX_LABELS = {
    "A": "Townhouses",
    "B": "Brownstones",
    "C": "Walk-up Apts",
    "D": "Elevator Apts",
    "E": "Warehouses",
    "F": "Factories",
    "G": "Garages/Parking",
    "H": "Hotels",
    "I": "Hospitals",
    "J": "Churches",
    "K": "Stores",
    "L": "Lofts",
    "M": "Religious",
    "O": "Offices",
    "P": "Assembly",
    "Q": "Recreation/Parks",
    "R": "Condos",
    "S": "Mixed Res.",
    "T": "Transportation",
    "U": "Utilities",
    "V": "Vacant",
    "W": "Schools",
    "Y": "Government",
    "Z": "Miscellaneous",
}

# Borough codes, names and county codes.
BOROUGHS = {1: "Manhattan", 2: "Bronx", 3: "Brooklyn", 4: "Queens", 5: "Staten Island"}
COUNTY_BOROUGH = {"061": 1, "005": 2, "047": 3, "081": 4, "085": 5}


def lookup(key: Column, mapping: dict, default=None) -> Column:
    """Constant-map lookup; ``default`` where the key is missing."""
    pairs = [F.lit(v) for kv in mapping.items() for v in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def is_vacant(code: Column, codes, prefix: int | None = None) -> Column:
    """Class code among the vacant codes; null counts as not vacant."""
    value = F.substring(code, 1, prefix) if prefix else code
    return F.coalesce(value.isin(list(codes)), F.lit(False))


def _zero(col: Column) -> Column:
    return F.coalesce(col == 0, F.lit(False))


def _zero_or_null(col: Column) -> Column:
    return F.coalesce(col == 0, F.lit(True))


def _positive(col: Column) -> Column:
    return F.coalesce(col > 0, F.lit(False))


def potential_vacant(num_bldgs: Column, bldg_area: Column, built_far: Column) -> Column:
    empty = _zero(num_bldgs) & _zero_or_null(bldg_area) & _zero_or_null(built_far)
    unknown = num_bldgs.isNull() & bldg_area.isNull() & built_far.isNull()
    return empty | unknown


def inconsistent_lot(num_bldgs: Column, bldg_area: Column, built_far: Column) -> Column:
    return _zero_or_null(num_bldgs) & (_positive(bldg_area) | _positive(built_far))


def clean_land_use(code: Column) -> Column:
    """Null to empty, left-padded with zeros to two characters (never shortened)."""
    text = F.coalesce(code, F.lit(""))
    return F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text)


def land_use_label(code: Column) -> Column:
    return lookup(clean_land_use(code), LAND_USE_LABELS, "Unknown")


def class_prefix(code: Column, n: int = 1) -> Column:
    text = F.substring(F.coalesce(code, F.lit("")), 1, n)
    return F.upper(text) if n == 1 else text


def class_prefix_label(code: Column) -> Column:
    return lookup(class_prefix(code), CLASS_PREFIX_LABELS, "Unknown")


def parse_threshold(text: Column) -> Column:
    """(0, 1] as written, (1, 100] as a percentage, anything else null."""
    value = text.try_cast("double")
    return F.when((value > 0) & (value <= 1), value).when((value > 1) & (value <= 100), value / 100.0)


def name_date(stem: Column) -> Column:
    """Acquisition date token: the last ``_`` part of a file stem."""
    return F.element_at(F.split(stem, "_"), -1)
