"""Physical constants and conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gas constant in kJ/mol/K, Boltzmann constant in pN nm/K, and pN in one kJ/mol/nm.
R_KJ_MOL_K, KB_PN_NM_K, PN_PER_KJ_MOL_NM = 0.008314462618, 0.01380649, 1.66053906717
BAR_TO_GPA, A2_PS_TO_CM2_S = 1e-4, 1e-4

#: Atomic masses (u).
MASSES = {
    "H": 1.008, "D": 2.014, "He": 4.003, "Li": 6.94, "Be": 9.012, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Ne": 20.180,
    "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "Ar": 39.948, "K": 39.098, "Ca": 40.078,
    "Ti": 47.867, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38, "Br": 79.904, "Ag": 107.868,
    "Sn": 118.710, "I": 126.904, "Pt": 195.084, "Au": 196.967,
}
#: Covalent radii in A, low spin for transition metals (Cordero et al. 2008).
RADII = {
    "H": 0.31, "He": 0.28, "Li": 1.28, "Be": 0.96, "B": 0.84, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "Ne": 0.58,
    "Na": 1.66, "Mg": 1.41, "Al": 1.21, "Si": 1.11, "P": 1.07, "S": 1.05, "Cl": 1.02, "Ar": 1.06,
    "K": 2.03, "Ca": 1.76, "Sc": 1.70, "Ti": 1.60, "V": 1.53, "Cr": 1.39, "Mn": 1.39, "Fe": 1.32, "Co": 1.26, "Ni": 1.24, "Cu": 1.32, "Zn": 1.22,
    "Ga": 1.22, "Ge": 1.20, "As": 1.19, "Se": 1.20, "Br": 1.20, "Kr": 1.16,
    "Rb": 2.20, "Sr": 1.95, "Y": 1.90, "Zr": 1.75, "Nb": 1.64, "Mo": 1.54, "Ru": 1.46, "Rh": 1.42, "Pd": 1.39, "Ag": 1.45, "Cd": 1.44, "In": 1.42,
    "Sn": 1.39, "Sb": 1.39, "Te": 1.38, "I": 1.39, "Xe": 1.40, "Cs": 2.44, "Ba": 2.15, "W": 1.62, "Pt": 1.36, "Au": 1.36, "Hg": 1.32,
    "Tl": 1.45, "Pb": 1.46, "Bi": 1.48,
}
UNKNOWN_MASS, UNKNOWN_RADIUS = 12.0, 1.5


def lookup(element: Column, table: dict[str, float], unknown: float) -> Column:
    """A number of each element, whatever the symbol's case."""
    pairs = F.create_map(*[F.lit(v) for k, n in table.items() for v in (k.lower(), n)])
    return F.coalesce(pairs[F.lower(F.trim(element))], F.lit(unknown))


def mass(element: Column) -> Column:
    return lookup(element, MASSES, UNKNOWN_MASS)


def covalent_radius(element: Column) -> Column:
    return lookup(element, RADII, UNKNOWN_RADIUS)


def loading_rate_pn_s(k_kj_mol_nm2: Column | float, velocity_a_ns: Column | float) -> Column:
    return F.lit(k_kj_mol_nm2) * PN_PER_KJ_MOL_NM * F.lit(velocity_a_ns) * 1e8


def time_ps(timestep: Column, index: Column, timestep_fs: float, interval_ps: float) -> Column:
    return F.coalesce(timestep * timestep_fs / 1000.0, index * interval_ps)
