"""Study parameters: one immutable object instead of constants scattered over queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# Inputs that must be equal for equal results.
COUNTRIES = ("IR", "IS", "US", "SA", "AE", "QA", "IZ", "KU", "BA", "LE", "SY", "YM")
CONFLICT_CLASSES = ("3", "4")
PLACE_TYPES = ("3", "4")
CLASS_COUNTS = {"n_verbal_conflict": "3", "n_material_conflict": "4"}
ROOT_COUNTS = {
    "n_fight": "19",
    "n_assault": "18",
    "n_coerce": "17",
    "n_force": "20",
    "n_protest": "14",
    "n_threaten": "13",
}
THEME_TOKENS = {
    "n_econ_oil": "ECON_OIL",
    "n_econ_oilexport": "ECON_OILEXPORT",
    "n_energy_security": "ENERGY_SECURITY",
    "n_env_natgas": "ENV_NATGAS",
    "n_env_nuclearpower": "ENV_NUCLEARPOWER",
    "n_maritime_transport": "MARITIME_TRANSPORT",
    "n_maritime_incident": "MARITIME_INCIDENT",
    "n_military_ops": "MILITARY_OPERATIONS",
    "n_armedconflict": "ARMEDCONFLICT",
    "n_terror": "TERROR",
    "n_wb_oil_industry": "WB_2042_OIL_INDUSTRY",
}
THEME_COMPOSITES = {
    "n_oil_total": ("n_econ_oil", "n_econ_oilexport", "n_wb_oil_industry"),
    "n_maritime_total": ("n_maritime_transport", "n_maritime_incident"),
    "n_conflict_total": ("n_military_ops", "n_armedconflict", "n_terror"),
}
PLACE_TOKENS = {
    "n_hormuz": "Hormuz",
    "n_persian_gulf": "Persian Gulf",
    "n_kharg": "Kharg",
    "n_ras_laffan": "Ras Laffan",
    "n_bandar_iranian_port": "Bandar",
}
PLACE_COMPOSITES = {
    "n_chokepoint_total": ("n_hormuz", "n_persian_gulf", "n_kharg", "n_ras_laffan"),
}
TONE_PARTS = {
    "tone": 1,
    "positive": 2,
    "negative": 3,
    "polarity": 4,
    "activity_density": 5,
    "self_reference": 6,
}
TONE_DISPERSIONS = ("tone", "positive", "negative")
SCORE_KEYS = {
    "liwc_anger": "c2.1",
    "liwc_anxiety": "c2.21",
    "liwc_certainty": "c2.6",
    "liwc_negate": "c2.34",
    "gi_hostile": "c3.2",
    "gi_power": "c3.3",
    "wna_fear": "v10.1.1",
    "wna_surprise": "v10.1.5",
}
SCORE_DISPERSIONS = ("liwc_anxiety", "wna_fear")
PHASE_ORDER = ("war-risk repricing", "supply destruction", "de-escalation")
FUEL_CATEGORIES = {
    "CCGT": "gas",
    "OCGT": "gas",
    "NUCLEAR": "nuclear",
    "WIND": "renewables",
    "NPSHYD": "renewables",
    "BIOMASS": "biomass",
    "COAL": "coal_oil",
    "OIL": "coal_oil",
    "PS": "pumped_storage",
}
MIX_CATEGORIES = ("gas", "renewables", "nuclear", "biomass", "coal_oil", "pumped_storage")


@dataclass(frozen=True)
class StudyConfig:
    """Parameters of one study; the defaults are the published study's values."""

    # event and article rows are cut to this closed window
    window_start: date = date(2026, 1, 1)
    window_end: date = date(2026, 5, 31)
    # trading-day grid; None means "read the range from the calendar"
    series_start: date | None = None
    series_end: date | None = None

    countries: tuple[str, ...] = COUNTRIES
    conflict_classes: tuple[str, ...] = CONFLICT_CLASSES
    place_types: tuple[str, ...] = PLACE_TYPES
    class_counts: dict[str, str] = field(default_factory=lambda: dict(CLASS_COUNTS))
    root_counts: dict[str, str] = field(default_factory=lambda: dict(ROOT_COUNTS))
    theme_tokens: dict[str, str] = field(default_factory=lambda: dict(THEME_TOKENS))
    theme_composites: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(THEME_COMPOSITES)
    )
    place_tokens: dict[str, str] = field(default_factory=lambda: dict(PLACE_TOKENS))
    place_composites: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(PLACE_COMPOSITES)
    )
    score_keys: dict[str, str] = field(default_factory=lambda: dict(SCORE_KEYS))
    score_dispersions: tuple[str, ...] = SCORE_DISPERSIONS
    phase_order: tuple[str, ...] = PHASE_ORDER

    horizons: tuple[int, ...] = (1, 3, 5, 10)
    heat_rate: float = 1.85
    emissions_factor: float = 0.36
    fx_rate: float = 0.85
    gas_share_threshold: float = 30.0
    basis_threshold: float = 15.0
    carbon_base_price: float = 72.0
    carbon_base_date: date = date(2026, 1, 2)
    carbon_source: str = "KRBN"
    burst_rows: int = 30
    slug_min_length: int = 6
    top_urls_per_day: int = 200
    url_window_days: int = 7
    # first and last day of the "during" period of the volatility split
    during_start: date = date(2026, 2, 28)
    during_end: date = date(2026, 5, 5)
