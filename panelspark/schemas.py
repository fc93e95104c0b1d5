"""Names of a panel's columns, so that operators stay generic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Profile:
    """Which columns hold what. The defaults are those of the panel that queries build."""

    entity: str = "entity"
    month: str = "month"
    group: str = "grp"
    lat: str = "lat"
    lon: str = "lon"
    label: str = "label"
    shares: tuple[str, ...] = ("s1", "s2", "s3", "s4", "s5")
    cumulative: tuple[str, ...] = ("c2", "c3", "c4", "c5")

    @property
    def key(self) -> list[str]:
        return [self.entity, self.month]


#: Profile of a food-security panel: areas, months, countries, and population shares by phase.
FOOD_SECURITY = Profile(
    "area_id", "date", "country_code_3", "lat", "lon", "overall_phase",
    tuple(f"phase{k}_percent" for k in range(1, 6)), tuple(f"phase{k}_worse" for k in range(2, 6)),
)


def panel_schema(p: Profile = FOOD_SECURITY, features: tuple[str, ...] = ()) -> T.StructType:
    """Schema for reading a panel with declared types."""
    double = lambda c, null=True: T.StructField(c, T.DoubleType(), null)
    return T.StructType([
        T.StructField(p.entity, T.LongType(), False), T.StructField(p.month, T.DateType(), False), T.StructField(p.label, T.IntegerType(), False),
        *(double(c, False) for c in p.shares), double(p.lat, False), double(p.lon, False), *(double(c) for c in features),
    ])
