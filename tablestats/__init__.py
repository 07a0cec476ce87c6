"""Whole-table and per-row numeric analytics as Spark DataFrame operators.

Every operator takes a DataFrame (plus parameters) and returns a DataFrame;
nothing is collected to the driver except results whose size is bounded by
the number of columns, partitions, files or nodes.
"""

from tablestats.functions.quantiles import QuantileDigest
from tablestats.functions.udf import moments, udaf_partial, udaf_tree, udf_grouped, udf_grouped_stream, udf_rowwise
from tablestats.operators.bigints import mark_big
from tablestats.operators.chunks import (chunk_ranges, chunk_rows, row_at, row_concat, row_slice, sort_top_k,
                                         with_row_index)
from tablestats.operators.columns import numeric_columns, select_numeric
from tablestats.operators.correlation import correlation_matrix
from tablestats.operators.exact import exact_correlation, exact_partials, exact_statistics, merged_sum
from tablestats.operators.grid import (grid_flatten, grid_mean3x3, grid_reshape, grid_sobel, mean3x3, smooth_images,
                                       sobel, sobel_images)
from tablestats.operators.heavy import heavy_hitters
from tablestats.operators.lookup import (best_fit_lookup, group_by_dependency, interval_usage, last_writer_edges,
                                         peak_interval_usage, peak_step_usage)
from tablestats.operators.partials import (frequency_partials, frequency_partials_by_task, merge_by_tag,
                                           merge_frequencies, merge_partials, merge_tagged, parse_aggregation_tag,
                                           partials_by, partials_by_task)
from tablestats.operators.profile import (column_max, column_mean, column_min, column_profile, column_std_pop,
                                          column_sum, constant_columns, count_above, mean_above)
from tablestats.operators.rows import (cast_numeric_coerce_drop, cast_numeric_strict, cell_arith, filter_above,
                                       filter_above_lists, project_case, row_fanout, row_length_filter)
from tablestats.operators.zscore import zscore
from tablestats.plans.steps import NamedSteps
from tablestats.session import build_session, release_work, sizing_conf, work_dir
from tablestats.sources.cells import infer_cell, infer_cells, infer_schema_profile
from tablestats.sources.images import image_pixels, pixel_row_check
from tablestats.sources.synth import synth_ints
from tablestats.sources.text_table import (header_cells, labelled_layout, matrix_layout, pixel_layout, read_cells,
                                           read_table, table_footprint, write_table)
from tablestats.streaming.partials import corrected_report, current_report, stream_corrected_partials, stream_partials_merge

__all__ = [name for name in dir() if not name.startswith("_")]
