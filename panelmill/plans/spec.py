"""Chart specs: the declarative query of a dashboard."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from ..errors import SpecError
from ..functions import families as fam
from ..operators.ordering import check_limit

# Defaults and names of the spec format.
PIE_TYPES = ("pie", "doughnut")
CATEGORY_TYPES = ("bar", "pie", "doughnut")
LINE_TYPE = "line"
CHART_TYPES = ("bar", "line", "pie", "scatter", "area", "doughnut", "radar", "heatmap")
DEFAULT_LIMIT = 15
BASIC_LIMIT = 10
DEFAULTS: dict[str, Any] = {
    "chart_type": "bar", "title": "Chart", "x_axis": "X", "y_axis": "Y", "insights": "",
    "color_scheme": "primary", "aggregation": "count", "limit": DEFAULT_LIMIT, "sort": "desc",
    "show_percentages": False,
}
UNTITLED_SERIES = "Data"


@dataclass(frozen=True)
class ChartSpec:
    """One chart. `title` may be None: the chart is then called "Chart" and its series "Data".

    `order_by` names the row order for line charts without dates, `first`, `last` and `none`;
    `rank_by="value"` keeps the largest groups of a grouped aggregate in place of the first keys;
    `date_formats` are tried in order when the date column holds text.
    """

    chart_type: str = DEFAULTS["chart_type"]
    title: str | None = None
    x_axis: str = DEFAULTS["x_axis"]
    y_axis: str = DEFAULTS["y_axis"]
    insights: str = DEFAULTS["insights"]
    color_scheme: str = DEFAULTS["color_scheme"]
    source_columns: tuple[str, ...] = ()
    aggregation: str = DEFAULTS["aggregation"]
    limit: int | None = DEFAULTS["limit"]
    sort: str = DEFAULTS["sort"]
    show_percentages: bool = DEFAULTS["show_percentages"]
    metadata: Mapping[str, Any] = field(default_factory=dict)
    interactive_features: tuple[str, ...] = ()
    order_by: str | None = None
    rank_by: str = "key"
    date_formats: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        check_limit(self.limit)
        if self.rank_by not in ("key", "value"):
            raise SpecError(f"rank_by is 'key' or 'value', not {self.rank_by!r}")

    @classmethod
    def of(cls, spec: ChartSpec | Mapping[str, Any]) -> ChartSpec:
        """A spec from its JSON form: unknown keys are ignored, absent keys take their default."""
        if isinstance(spec, ChartSpec):
            return spec
        flat = {**spec, **(spec.get("data_config") or {})}
        known = {name: flat[name] for name in cls.__dataclass_fields__ if name in flat}
        for name in ("source_columns", "interactive_features", "date_formats"):
            if name in known:
                known[name] = tuple(known[name] or ())
        return cls(**known)


def resolve(df: DataFrame, spec: ChartSpec) -> ChartSpec | None:
    """The spec with columns that exist, or None where the table offers none. Schema only, no job.

    A spec without usable columns falls back to counting the first text column, else to the first
    numeric one.
    """
    if spec.source_columns and fam.has_columns(df, list(spec.source_columns)):
        return spec
    texts, numbers = fam.categorical_columns(df), fam.numeric_columns(df)
    if texts and spec.chart_type in CATEGORY_TYPES:
        return replace(spec, source_columns=(texts[0],), aggregation="count")
    if numbers:
        return replace(spec, source_columns=(numbers[0],), aggregation="sum")
    return None
