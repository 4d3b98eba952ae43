"""Standardized climate indices, run theory and distribution fitting on Spark tables (cell_id, time, value)."""

from .config import Distribution, Method, Periodicity
from .operators.calendar import days_since, gregorian_length_as_366, time_axis, to_366, to_gregorian
from .operators.classify import area_percentage, compare_columns, eleven_class, mckee_class, regional_mean, wet_area_percentage
from .operators.fit import cdf, compare, diagnose, diagnose_failure, fit, goodness_of_fit, lmoment_ratios, lmoments, select_best
from .operators.grid import completeness, densify, find_variable, from_array, from_series, missing_to_null, year_range, zero_counts
from .operators.index import fit_index_params, gamma_params, rolling_sum, spei, spi, transform_with_params
from .operators.pet import hargreaves, monthly_daylight, monthly_radiation, potential_evapotranspiration, thornthwaite
from .operators.runs import (
    annual_statistics, compare_periods, event_state, identify_events, interarrival, monitor, period_difference, period_statistics,
    runs, spatial_events, summarize_events,
)
from .plans.planning import estimate_memory, optimal_chunk, tile_table, tiles
from .sources.io import load_params, read_grid, save_index, save_params, spei_path, spi_path

__all__ = [n for n in dir() if not n.startswith("_")]
