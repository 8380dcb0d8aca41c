"""Study parameters: KPI names, zone groups, the order scope and the design grid."""

from __future__ import annotations

import datetime as dt
import math
import random
import uuid
from dataclasses import dataclass, field
from functools import reduce

# KPI column names in report order.
CUSTOMER_KPIS = (
    "actual_df_paid_by_customer", "gfv_local", "gmv_local", "commission_local",
    "joker_vendor_fee_local", "sof_local", "service_fee_local", "revenue_local",
    "delivery_costs_local", "gross_profit_local",
)
LOGISTICS_KPIS = ("dps_mean_delay", "delivery_distance_m", "actual_DT")
ALL_KPIS = CUSTOMER_KPIS + LOGISTICS_KPIS


@dataclass(frozen=True)
class ZoneGroup:
    """Zones of one assignment that are analysed together."""

    entity_id: str
    asa_id: int
    zone_names: tuple[str, ...]
    zone_group_identifier: str


# The studied zone groups (spelling as in the order data).
STUDY_ZONE_GROUPS = (
    ZoneGroup("FP_SG", 559, ("Bukitpanjang", "Jurongwest", "Woodlands"), "zg_1"),
    ZoneGroup("FP_SG", 560, ("Far_east", "Jurong east"), "zg_2"),
    ZoneGroup("FP_HK", 402, ("To kwa wan rider", "Kowloon city rider", "Lai chi kok rider"), "zg_3"),
    ZoneGroup("FP_HK", 406, (
        "Ma liu shui rider", "Kwai chung rider", "Sai kung rider", "Sheung shui rider",
        "Tai po rider", "Tai wai rider", "Tin shui wai rider", "Tsing yi rider",
        "Tsuen wan rider", "Tuen mun rider", "Tun chung rider", "Yuen long rider"), "zg_4"),
    ZoneGroup("FP_HK", 398, (
        "Admiralty cwb rider", "Happy valley cwb rider", "Kennedy town rider",
        "Quarry bay rider"), "zg_5"),
    ZoneGroup("FP_PH", 496, (
        "South alabang atc", "Paranaque", "North Ias pinas", "North alabang atc",
        "Bf homes"), "zg_6"),
    ZoneGroup("FP_PH", 525, ("Bacoor north", "Tagaytay", "Dasmarinas", "Imus"), "zg_7"),
    ZoneGroup("FP_PH", 528, ("Antipolo north", "Malabon", "Sjdm", "Valenzuela"), "zg_8"),
    ZoneGroup("FP_PH", 508, ("Makati", "Pasay"), "zg_9"),
)


@dataclass(frozen=True)
class OrderScope:
    """Which orders enter the study; the defaults are the studied scope."""

    entity_ids: tuple[str, ...] = tuple(dict.fromkeys(g.entity_id for g in STUDY_ZONE_GROUPS))
    start_date: dt.date = dt.date(2023, 1, 1)
    end_date: dt.date = dt.date(2023, 1, 28)
    asa_ids: tuple[int, ...] = tuple(g.asa_id for g in STUDY_ZONE_GROUPS)
    # What the study leaves out and selects.
    excluded_country: str = "dp-sg"
    price_scheme: str = "Automatic scheme"
    # Regions whose paid delivery fee comes from the fee table.
    fee_table_regions: tuple[str, ...] = ("Europe", "Asia")

    def __post_init__(self) -> None:
        if self.start_date > self.end_date:
            raise ValueError("start_date lies after end_date")
        if not self.entity_ids or not self.asa_ids:
            raise ValueError("entity_ids and asa_ids must not be empty")


@dataclass(frozen=True)
class Allocation:
    """Parameters of one allocation. The window may be fractional (hours)."""

    window_hours: float
    num_variants: int
    key: int | None = None
    salt: str | None = None

    def __post_init__(self) -> None:
        window_seconds(self.window_hours)
        if int(self.num_variants) != self.num_variants or self.num_variants < 1:
            raise ValueError("num_variants must be a whole number, control included")
        # Unset key and salt are drawn once here, so that a re-run task sees the same values.
        if self.key is None:
            object.__setattr__(self, "key", random.randint(0, 32767))
        if self.salt is None:
            object.__setattr__(self, "salt", str(uuid.uuid4()))


@dataclass(frozen=True)
class StudyGrid:
    """Every combination of window, variant count and experiment length is one run per zone group."""

    window_hours: tuple[float, ...] = (2, 3, 4)
    num_variants: tuple[int, ...] = (2, 3, 4, 5, 6, 7)
    exp_lengths: tuple[int, ...] = (7, 14, 21, 28)
    alpha: float = 0.1
    seed: str = "0"
    windows_s: tuple[int, ...] = field(init=False, default=())

    def __post_init__(self) -> None:
        for values in (self.window_hours, self.num_variants, self.exp_lengths):
            if not values or len(set(values)) != len(values):
                raise ValueError("grid values must be non-empty and distinct")
        if min(self.num_variants) < 2 or min(self.exp_lengths) < 1:
            raise ValueError("need at least 2 variants and 1 day")
        if not 0 < self.alpha < 1:
            raise ValueError("alpha must lie between 0 and 1")
        object.__setattr__(self, "windows_s", tuple(window_seconds(w) for w in self.window_hours))

    @property
    def granule_s(self) -> int:
        """Longest time step of which every window is a whole multiple."""
        return reduce(math.gcd, self.windows_s)


def window_seconds(hours: float) -> int:
    seconds = round(float(hours) * 3600)
    if seconds < 1:
        raise ValueError("the switchback window must be longer than zero")
    return seconds


# What the report's two parameters may be set to.
REPORT_ALPHAS = (0.05, 0.1)
REPORT_BIN_WIDTHS = (0.05, 0.1, 0.15, 0.2)


def check_alpha(alpha: float) -> float:
    if alpha not in REPORT_ALPHAS:
        raise ValueError(f"alpha must be one of {REPORT_ALPHAS}")
    return alpha


def check_bin_width(width: float) -> float:
    if width not in REPORT_BIN_WIDTHS:
        raise ValueError(f"bin width must be one of {REPORT_BIN_WIDTHS}")
    return width
