"""Labelled, gridded, time-varying fields as Spark DataFrames."""

from .cube import Cube
from .dataset import Dataset
from .operators.combine import overlay, profile_series, profile_table
from .operators.limits import robust_limits
from .operators.plotdata import (
    bands, clipped, facet, facet_labels, filled, hovmoller, isoline, isoline_segments, labelled, profile_line,
)
from .operators.reduce import season_mean, seasonality
from .session import build_session
from .sources.request import Catalog, Product, Request, open_dataset, subset, take_years
from .sources.store import (
    combine, duplicate_cells, from_frame, keep_axes, open_cube, open_groups, open_many, open_means, store_report, write_cube, write_dataset,
)

__all__ = [
    "Catalog", "Cube", "Dataset", "Product", "Request", "bands", "build_session", "clipped", "combine",
    "duplicate_cells", "facet", "facet_labels", "filled", "from_frame", "hovmoller", "isoline", "isoline_segments",
    "keep_axes", "labelled", "open_cube", "open_dataset", "open_groups", "open_many", "open_means", "overlay", "profile_line",
    "profile_series", "profile_table", "robust_limits", "season_mean", "seasonality", "store_report", "subset",
    "take_years", "write_cube", "write_dataset",
]
