"""Small declarative values handed to the operators.

Everything here lives on the driver and describes *what* to compute; the
operators turn it into DataFrame plans.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

AGGREGATIONS = ("sum", "avg", "min", "max", "count", "count_distinct", "median", "none")
GRAINS = ("day", "week", "month", "quarter", "year")
VIEW_TYPES = (
    "line", "bar", "horizontal_bar", "area", "pie", "donut",
    "scatter", "histogram", "heatmap", "table",
)
FILTER_OPERATORS = ("eq", "in", "between", "gte", "lte")
FORMATS = ("currency", "number", "percent", "count", "decimal", "duration_days")

TIME_VIEWS = ("line", "area")
CATEGORY_VIEWS = ("bar", "horizontal_bar", "pie", "donut")
COUNTING = ("count", "count_distinct")

MEASURE_ROLES = ("measure", "currency", "percentage", "quantity", "ratio")
DIMENSION_ROLES = ("dimension", "geo", "demographic", "flag")

# Limits that are part of the feature (a chart shows so many categories).
MAX_RESULT_ROWS = 5000
MAX_CATEGORIES = 20
MAX_POINTS = 2000
MAX_TABLE_ROWS = 500
MAX_CARDINALITY = 60
HIGH_CARDINALITY_RATIO = 0.6


class SpecError(ValueError):
    """A request that names an unknown column or breaks a structural rule."""


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any = None

    def __post_init__(self):
        if self.operator not in FILTER_OPERATORS:
            raise SpecError(f"unknown filter operator {self.operator!r}")


@dataclass(frozen=True)
class ViewSpec:
    """One chart-shaped result table."""

    id: str
    type: str
    title: str = ""
    x: str | None = None
    y: str | None = None
    series: str | None = None
    aggregation: str = "sum"
    time_grain: str | None = None
    sort: str | None = None
    limit: int | None = None
    bins: int | None = None
    columns: tuple[str, ...] = ()
    section: str = "primary"

    def __post_init__(self):
        def fail(text):
            raise SpecError(f"view {self.id!r}: {text}")

        object.__setattr__(self, "id", self.id.strip().lower().replace(" ", "_"))
        object.__setattr__(self, "columns", tuple(self.columns))
        if self.type not in VIEW_TYPES:
            fail(f"unknown type {self.type!r}")
        if self.aggregation not in AGGREGATIONS:
            fail(f"unknown aggregation {self.aggregation!r}")
        if self.time_grain is not None and self.time_grain not in GRAINS:
            fail(f"unknown grain {self.time_grain!r}")
        if self.limit is not None and not 1 <= self.limit <= MAX_RESULT_ROWS:
            fail(f"limit outside 1..{MAX_RESULT_ROWS}")
        if self.bins is not None and not 3 <= self.bins <= 100:
            fail("bins outside 3..100")
        if self.type in TIME_VIEWS + CATEGORY_VIEWS:
            if not self.x:
                fail("needs an x column")
            if not self.y and self.aggregation != "count":
                fail("needs a y column unless it counts rows")
        if self.type == "scatter":
            if not (self.x and self.y):
                fail("needs both x and y")
            object.__setattr__(self, "aggregation", "none")
        if self.type == "histogram" and not self.x:
            fail("needs an x column")
        if self.type == "heatmap" and len(self.columns) < 2:
            fail("needs at least two columns")
        if self.type == "table" and not self.columns:
            fail("needs columns")

    @property
    def signature(self):
        return (self.type, self.x, self.y, self.series, self.aggregation, self.columns)

    def at_grain(self, grain: str) -> "ViewSpec":
        return replace(self, time_grain=grain)


@dataclass(frozen=True)
class KpiSpec:
    """A headline number: one aggregate, a ratio of two, or the share of a flag."""

    id: str
    name: str
    format: str = "number"
    priority: int = 50
    measure: str | None = None
    aggregation: str = "sum"
    numerator: str | None = None
    denominator: str | None = None  # None with a numerator: the row count
    flag: str | None = None
    multiply: float = 1.0
    higher_is_better: bool = True
    why: str = ""
    source: str = "rules"

    def __post_init__(self):
        if self.format not in FORMATS:
            raise SpecError(f"unknown format {self.format!r}")

    @property
    def calculation(self) -> str:
        if self.flag:
            return f"COUNT(*) WHERE {self.flag} IS TRUE / COUNT(*) x 100"
        if self.numerator:
            below = f"SUM({self.denominator})" if self.denominator else "COUNT(*)"
            factor = f" x {self.multiply:g}" if self.multiply != 1.0 else ""
            return f"SUM({self.numerator}) / {below}{factor}"
        if self.aggregation == "count_distinct":
            return f"COUNT(DISTINCT {self.measure})"
        return f"{self.aggregation.upper()}({self.measure or '*'})"

    @property
    def source_columns(self) -> list[str]:
        named = (self.flag, self.numerator, self.denominator, self.measure)
        return [c for c in named if c]


@dataclass(frozen=True)
class QuestionSpec:
    """A structured question: rank, trend, distribution or aggregate."""

    intent: str
    measure: str | None = None
    aggregation: str = "sum"
    dimension: str | None = None
    date: str | None = None
    grain: str | None = None
    limit: int = 10
    sort: str = "value_desc"
    filter_column: str | None = None
    filter_value: str | None = None


@dataclass
class ColumnProfile:
    """What the profiler learned about one column."""

    name: str
    physical_type: str
    inferred_type: str
    count: int
    missing: int
    missing_pct: float
    unique: int
    cardinality_ratio: float
    is_constant: bool
    is_unique_key: bool
    role: str = "unknown"
    role_confidence: float = 1.0
    role_evidence: list[str] = field(default_factory=list)
    numeric: dict | None = None
    datetime: dict | None = None
    top_values: list[tuple[str, int, float]] = field(default_factory=list)
    sample_values: list[str] = field(default_factory=list)
    parse: dict = field(default_factory=dict)  # how text becomes the inferred type

    @property
    def groupable(self) -> bool:
        return self.inferred_type in ("categorical", "boolean")


@dataclass
class TableProfile:
    """All column profiles plus the table-level picks built from them."""

    n_rows: int
    n_duplicates: int | None
    columns: list[ColumnProfile]
    primary_date: str | None = None
    primary_measure: str | None = None
    domain: str = "general"
    domain_signals: list[str] = field(default_factory=list)

    def __post_init__(self):
        self._by_name = {c.name: c for c in self.columns}

    def get(self, name: str | None) -> ColumnProfile | None:
        return self._by_name.get(name) if name else None

    def names(self, inferred_type: str) -> list[str]:
        return [c.name for c in self.columns if c.inferred_type == inferred_type]

    @property
    def measures(self) -> list[str]:
        return [c.name for c in self.columns
                if c.inferred_type == "numeric" and c.role in MEASURE_ROLES]

    @property
    def dimensions(self) -> list[str]:
        return [c.name for c in self.columns if c.groupable and c.role in DIMENSION_ROLES]

    @property
    def identifiers(self) -> list[str]:
        return [c.name for c in self.columns if c.role == "identifier"]

    def grain(self, name: str | None = None) -> str:
        col = self.get(name or self.primary_date)
        return (col.datetime or {}).get("suggested_grain", "month") if col else "month"
