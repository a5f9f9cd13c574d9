"""Rules on atomic numbers, coordination labels and names, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.functions.geometry import clip

# Atomic numbers with relevant d orbitals, and the d classes, in order.
RELEVANT = [(21, 30), (39, 48), (72, 80), (81, 86), (104, 118)]
VALENCE = {"3d_transition": (21, 30), "4d_transition": (39, 48), "5d_transition": (72, 80)}
FILLED = [(31, 38), (49, 56), (58, 71)]
STRONG_LIGANDS = ["C", "N", "O", "S", "P"]
WEAK_LIGANDS = ["F", "Cl", "Br", "I"]
# Ranges over which chemical attributes are normalised.
RANGES = {
    "electronegativity": (0.7, 4.0), "covalent_radius": (30, 250), "ionization_energy": (370, 2500), "electron_affinity": (-50, 350),
    "atomic_volume": (5, 70), "polarizability": (0.1, 60), "effective_charge": (-3.0, 8.0),
}
# Roman numerals and the geometry suffixes of coordination labels.
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII", "XIII", "XIV", "XV", "XVI"]
SUFFIXES = [
    "PY", "OH", "TH", "SQ", "TB", "SP", "TPR", "SAPR", "DD", "PPR", "HBPY", "JTC", "JBTC", "TDH", "HD", "TT", "CO", "DI", "PBPY", "COC", "HBCO", "BCCO",
    "SC", "S", "CU", "CUAPR", "HE", "CPS", "CSAP", "KLE", "BCE", "BFS", "JCS", "CAPS", "ASAP", "SQA", "LA", "CUPR", "EP", "OC", "HPY", "ETBPY", "HTBPY",
]


def within(z: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for a, b in ranges:
        out = out | z.between(a, b)
    return out


def d_relevant(z: Column) -> Column:
    return within(z, RELEVANT)


def d_class(z: Column) -> Column:
    """Struct: has_d, physical, orbital_type, energy_level."""
    kind = lambda has, physical, orbital, level: F.struct(F.lit(has).alias("has_d"), (physical if isinstance(physical, Column) else F.lit(physical)).alias("physical"), F.lit(orbital).alias("orbital_type"), F.lit(level).alias("energy_level"))
    out = F.when(z < 21, kind(False, False, "too_high_energy", None))
    for name, (a, b) in VALENCE.items():
        out = out.when(z.between(a, b), kind(True, True, name, "valence"))
    return (
        out.when(z.between(81, 118), kind(True, z <= 86, "post_transition_d", "semi_core"))
        .when(within(z, FILLED), kind(True, False, "filled_d_sublayer", "core_like"))
        .otherwise(kind(False, False, None, None))
    )


def d_activation(z: Column, coordination: Column, strong: Column) -> Column:
    """Struct: activated, factor, field, bonding from coordination number and ligand counts."""
    has = d_class(z)["has_d"]
    high = coordination >= 4
    return F.struct(
        (has & (high | (strong > 0))).alias("activated"), F.when(has & high, F.least(F.lit(1.0), coordination / 8.0)).otherwise(0.0).alias("factor"),
        F.when(has & (strong > 0), "strong").otherwise("weak").alias("field"), F.when(has & (strong > 0), "covalent").otherwise("ionic").alias("bonding"))


def d_value(z: Column, factor: Column) -> Column:
    """Struct: has_value, value_type, confidence of the d orbital as a feature."""
    kind = lambda name, c: F.struct(F.lit(True).alias("has_value"), F.lit(name).alias("value_type"), c.alias("confidence"))
    return (
        F.when(z.isin(35, 53), kind("environment_fingerprint", F.lit(0.6))).when(z.between(81, 86), kind("semi_core_interaction", F.lit(0.7)))
        .when((factor > 0.5) & d_class(z)["has_d"], kind("coordination_induced", factor))
        .otherwise(F.struct(F.lit(False).alias("has_value"), F.lit(None).cast("string").alias("value_type"), F.lit(0.0).alias("confidence")))
    )


def density_threshold(z: Column, orbital: Column) -> Column:
    level = d_class(z)["energy_level"]
    return (
        F.when(orbital != "d", 1e-3).when(level == "valence", 1e-3).when((level == "semi_core") & z.between(81, 86), 1e-4)
        .when(level == "semi_core", 5e-3).when(level == "core_like", 1e-2).otherwise(1e-3)
    )


def chemical_vector(columns: dict[str, Column]) -> Column:
    """Attributes scaled to [0, 1] by their fixed ranges, in order; missing ones are 0.5. A missing
    polarizability is the cube of the covalent radius over 100."""
    given = {k: columns.get(k, F.lit(None).cast("double")) for k in RANGES}
    given["polarizability"] = F.coalesce(given["polarizability"], F.pow(given["covalent_radius"] / 100.0, 3))
    return F.array(*[F.coalesce(clip((given[k] - low) / (high - low), 0, 1) + F.when(given[k].isNotNull(), 0.0), F.lit(0.5)) for k, (low, high) in RANGES.items()])


def roman(n: Column) -> Column:
    return F.when(n.between(1, 14), F.get(F.array(*[F.lit(r) for r in ROMAN]), n.cast("int") - 1)).otherwise("")


def coordination_number(label: Column) -> Column:
    """Integer of a coordination label: a number, a roman numeral, one with a geometry suffix, one at the
    start, one anywhere (longest first); else NULL."""
    number = F.create_map(*[x for i, r in enumerate(ROMAN) for x in (F.lit(r), F.lit(i + 1))])
    longest = "|".join(sorted(ROMAN, key=len, reverse=True))
    said = F.upper(F.trim(label))
    tried = [F.when(said.rlike(r"^[+-]?[0-9]+$"), said.try_cast("int")), F.try_element_at(number, said)]
    stripped = [F.regexp_extract(said, f"^({longest}){s}$", 1) for s in SUFFIXES]
    tried += [F.try_element_at(number, F.coalesce(*[F.nullif(s, F.lit("")) for s in stripped]))]
    tried += [F.try_element_at(number, F.nullif(F.regexp_extract(said, f"^({longest})", 1), F.lit("")))]
    tried += [F.when(said.contains(r), F.lit(ROMAN.index(r) + 1)) for r in sorted(ROMAN, key=lambda x: -len(x))]
    return F.coalesce(*tried).cast("int")


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, r"(-gpaw)?-optimized(\.cif)?$", "")


def finite(x: Column, nan: float | None = None, plus: float | None = None, minus: float | None = None) -> Column:
    """NaN and infinities replaced; None makes NULL."""
    lit = lambda v: F.lit(v).cast("double")
    return F.when(F.isnan(x), lit(nan)).when(x == float("inf"), lit(plus)).when(x == float("-inf"), lit(minus)).otherwise(x)
