"""DataFrame operators."""

from cohortline.operators.asof import asof_backward_last, asof_forward_first, attach_first
from cohortline.operators.attrition import attrition_attach, attrition_events, attrition_unique
from cohortline.operators.audit import (
    audit_composite,
    audit_join,
    audit_unique,
    audit_unique_rollup,
    compare_full,
    compare_series,
    disagreement,
    duplicates,
    duplicates_rollup,
    mismatch_rows,
    negative_intervals,
    null_profile,
    per_period,
    reconcile,
    screen_test_records,
    work_list,
)
from cohortline.operators.dedupe import dedupe_first, dedupe_last, latest_snapshot
from cohortline.operators.demographics import enrich_demographics
from cohortline.operators.history import (
    retention_at,
    retention_avg,
    running_units,
    status_asof_flag,
    status_intervals,
    status_profile,
    term_metrics,
)
from cohortline.operators.matching import event_kinds, first_product, match_ids, outcomes, product_labels
from cohortline.operators.ordered import asof_each, time_cells
from cohortline.operators.rates import (
    any_prefix_flag,
    cohort_rates,
    crosstab,
    ever_flag,
    ratio,
    share_by_group,
    value_counts,
)
from cohortline.operators.skew import heavy_by_key, heavy_in_plan, heavy_keys, left_fan_out, merge_heavy, salted_join, small_side
from cohortline.operators.stages import (
    coalesce_segment,
    cohort_funnel,
    composite_label,
    direct_vs_via,
    funnel_flags,
    stamp_refresh,
    with_stage,
    with_stages,
)
from cohortline.operators.survey import (
    apply_rules,
    attach_responses,
    duplicate_rules,
    earliest_answers,
    literal_lookup,
    normalize_labels,
    pivot_answers,
    rule_coverage,
    unmatched,
    widen_rules,
)
from cohortline.operators.timeline import Mark, Pick, dated, firsts

__all__ = [name for name in dir() if not name.startswith("_")]
