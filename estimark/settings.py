"""Scoring thresholds and fixed tables of the listing engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Thresholds; every operator that scores takes one."""

    w_price: float = 0.45
    w_property: float = 0.25
    w_location: float = 0.20
    w_penalty: float = 0.10
    price_great: float = -0.15
    price_neutral_lo: float = -0.03
    price_neutral_hi: float = 0.03
    price_bad: float = 0.20
    euro_impact_small: float = 50
    euro_impact_large: float = 100
    penalty_dom_stale: int = 60
    penalty_dom_warn: int = 30
    radii: tuple[int, ...] = (500, 800, 1200)
    min_comps: int = 5
    enough_comps: int = 15
    gem: tuple = (80, 70, -12, 62, 62, 60, 75)  # total, ldi, delta, property, location, confidence, penalty
    good_value: tuple = (70, 50, -7, 50, 50, 45, 60)
    gem_metro_max_m: int = 800
    gem_min_sqm_per_room: int = 22
    year: int | None = None  # that ages are counted from; today's if not given


# Fixed values that results depend on.
#: Upper floor of each bucket with the coefficient with and without a lift.
FLOORS = [(-2, -0.25, -0.25), (-1, -0.20, -0.20), (1, -0.10, -0.10), (2, -0.03, -0.15), (3, 0.00, -0.20), (5, 0.05, -0.25), (9, 0.10, -0.30), (None, 0.20, -0.20)]
CONDITIONS = {"nuova_costruzione": 0.10, "ottimo": 0.10, "ristrutturato": 0.05, "buono": 0.00, "abitabile": 0.00, "da_ristrutturare": -0.10, "fatiscente": -0.25}
ENERGY = {"A4": 0.08, "A3": 0.08, "A2": 0.06, "A1": 0.06, "B": 0.04, "C": 0.02, "D": 0.00, "E": -0.02, "F": -0.04, "G": -0.06}
#: Factor from a comparable's condition (first) to the target's; all others are 1.
CONDITION_FACTORS = {
    ("premium", "standard"): 0.78, ("premium", "needs_work"): 0.62, ("standard", "premium"): 1.28,
    ("standard", "needs_work"): 0.80, ("needs_work", "premium"): 1.61, ("needs_work", "standard"): 1.25,
}
MIN_SALE_PSQM = {"milano": 800, "roma": 600, "napoli": 400, "la_maddalena": 800}
DEFAULT_MIN_SALE_PSQM = 400
#: city: (south, north, west, east)
CITY_BOXES = {"milano": (45.388, 45.535, 9.065, 9.280), "roma": (41.755, 42.085, 12.235, 12.730), "napoli": (40.782, 40.920, 14.140, 14.380), "la_maddalena": (41.165, 41.250, 9.345, 9.475)}

# Financing, contracts and closing costs, as shares of the price unless named otherwise.
FINANCING = {"cash": (0.0, 0.0, 0), "mortgage_invest": (0.65, 0.042, 20), "mortgage_primary": (0.80, 0.038, 25)}  # loan to value, rate, years
CONTRACT_FIELDS = ["rent_factor", "cedolare_rate", "imu_discount", "vacancy_months", "mgmt_pct", "utilities_owner_cost", "furnishing_amort_pct", "insurance_annual", "marketing_annual"]
CONTRACTS = {
    "libero": (1.00, 0.21, 0.00, 1.0, 0.08, 0, 0, 0, 0),
    "concordato": (0.72, 0.10, 0.25, 0.5, 0.05, 0, 0, 0, 0),
    "transitorio": (1.12, 0.10, 0.25, 2.0, 0.12, 1500, 0.025, 300, 300),
}
PURCHASE_COSTS = {"mortgage_primary": 0.04, "cash": 0.11, "mortgage_invest": 0.11}
CONCORDATO_CITIES = ["milano", "roma", "napoli"]
TRANSITORIO_PLACES = {
    "milano": [
        "duomo", "centro", "centro storico", "brera", "cordusio", "cinque vie", "turati", "moscova", "porta venezia", "porta romana", "porta vittoria", "cadorna", "sant'ambrogio", "sant ambrogio", "guastalla", "tribunale", "missori", "crocetta",
        "bocconi", "citta studi", "città studi", "citta' studi", "politecnico", "piola", "lambrate", "navigli", "porta genova", "isola", "porta nuova", "garibaldi", "corso italia", "corso vittorio", "loreto", "lima",
    ],
    "roma": ["centro storico", "trastevere", "monti", "esquilino", "san giovanni", "prati", "flaminio", "parioli", "san lorenzo", "pigneto", "sapienza", "tor vergata"],
    "napoli": ["chiaia", "centro storico", "vomero", "posillipo", "fuorigrotta"],
}
#: Background, text and border of badges.
GREEN, AMBER, RED, GREY = ("rgba(22,163,74,0.12)", "#15803D", "#16A34A"), ("rgba(217,119,6,0.12)", "#B45309", "#D97706"), ("rgba(220,38,38,0.12)", "#B91C1C", "#DC2626"), ("rgba(107,114,128,0.12)", "#6B7280", "#9CA3AF")
FASCIA_COLORS = {
    "A": ("rgba(45,106,79,0.12)", "#1E5038"), "B": ("rgba(45,106,79,0.12)", "#1E5038"), "C": ("rgba(22,163,74,0.12)", "#15803D"), "D": ("rgba(217,119,6,0.12)", "#92400E"), "E": ("rgba(220,38,38,0.12)", "#991B1B"), "R": ("rgba(107,114,128,0.12)", "#6B7280"),
}
VS_ZONE_COLORS = [("rgba(22,163,74,0.12)", "#15803D"), ("rgba(217,119,6,0.12)", "#92400E"), ("rgba(220,38,38,0.12)", "#991B1B")]
#: Portal B's words for numbers of rooms in addresses.
ROOM_TOKENS = {1: "monolocali-1", 2: "bilocali-2", 3: "trilocali-3", 4: "quadrilocali-4", 5: "5-locali-o-piu"}
