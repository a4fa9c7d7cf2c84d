"""Layered data preparation with DataFrames in and DataFrames out."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

from layerflow.functions.documents import explode_object, json_collect, referenced_fields
from layerflow.operators.aggregates import aggregate, classify_max, recompute_check, rollup_grain
from layerflow.operators.clean import (
    action,
    add_column,
    add_row_unit,
    clean,
    filter_rows,
    fix_case,
    group_values,
    replace_value,
    split_column,
    trim_whitespace,
    value_filter,
)
from layerflow.operators.columns import augment, cast, hide, rename, rename_back
from layerflow.operators.expectations import (
    coverage,
    expect_count,
    expect_disjoint,
    expect_in,
    expect_padded_steps,
    expect_pattern,
    expect_range,
    expect_ref,
    expect_required,
    expect_unique,
    expect_when,
    extract_tokens,
    run_expectations,
    shown_tokens,
    unknown_tokens,
)
from layerflow.operators.digests import digest_diff, digest_tree, publish_digested
from layerflow.operators.fields import absent_fields, chain_actions, field_lineage
from layerflow.operators.graphs import condensed, connected_components, strong_components
from layerflow.operators.joins import (
    attach,
    checked_join,
    exists_in,
    fill_from_lookup,
    join,
    join_cardinality,
    lookup_chain,
    match_with_fallback,
    missing_from,
    resolve_names,
    self_join,
)
from layerflow.operators.ledger import (
    failed_runs,
    map_status,
    pending,
    record_runs,
    run_summary,
    upsert_latest,
)
from layerflow.operators.lineage import (
    bfs_levels,
    bridge,
    cyclic_waves,
    derive_edges,
    edge_diff,
    inherit_ns,
    input_sources,
    lineage_closure,
    node_roles,
    reachable,
    waves,
)
from layerflow.operators.metrics import consumer_impact, metric
from layerflow.operators.parity import column_diff, count_diff, resolve_pairs, value_diff
from layerflow.operators.refresh import (
    append,
    backfill,
    incremental_append,
    publish,
    publish_view,
    refresh_mode,
    refresh_settings,
    write_extract,
)
from layerflow.operators.reshape import add_missing_rows, fill_dates, fill_sequence, pivot, unpivot
from layerflow.operators.script import script, script_by
from layerflow.operators.sketches import column_profile, frequent_values, merge_profiles, profile_diff, read_profile
from layerflow.operators.spellings import group_similar, similar_pairs, similar_values
from layerflow.operators.unions import self_union, union_mapped
from layerflow.operators.versions import (
    append_version,
    compact,
    drop_versions,
    publish_version,
    read_rollup,
    read_version,
    refresh_rollup,
    republish,
    table_versions,
)
from layerflow.operators.windows import fixed, renumber, row_number
from layerflow.session import build_session, scratch_scope
from layerflow.sources import (
    first_rows,
    limit_rows,
    read_csv,
    read_dataset,
    read_extract,
    read_sql,
    sample_groups,
    sample_rows,
    scan,
)
from layerflow.streaming.incremental import incremental_stream
from layerflow.streaming.versions import compact_ledger, ledger_stream, version_stream

# Python functions of this package travel to the workers by value, so that script steps run
# on executors that do not have the package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_")]
