"""Thresholds of the analyses, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """They decide which findings are reported."""

    # column kinds
    category_levels: int = 15
    category_share: float = 0.1
    category_min_levels: int = 2
    identifier_ratio: float = 0.9
    numeric_text_ratio: float = 0.9
    text_unique_ratio: float = 0.9
    text_min_unique: int = 50
    date_parse_ratio: float = 0.8
    date_number_ratio: float = 0.8

    # quality
    high_missing_pct: float = 50.0
    moderate_missing_pct: float = 10.0
    near_unique_pct: float = 95.0
    near_unique_min_rows: int = 10
    top_missing: int = 5

    # associations
    pearson_min_pairs: int = 10
    pearson_strong: float = 0.7
    pearson_moderate: float = 0.4
    effect_strong: float = 0.5
    effect_moderate: float = 0.3
    weak: float = 0.2
    association_min_rows: int = 5
    top_pearson: int = 15
    top_cramers: int = 10
    top_eta: int = 10
    max_category_levels: int = 40
    max_category_columns: int | None = None       # all columns unless a number is given
    spearman_min_rows: int = 8
    kruskal_min_rows: int = 12
    kruskal_categories: int | None = None
    kruskal_numbers: int | None = None

    # outliers
    outlier_min_rows: int = 8
    outlier_min_levels: int = 4
    fence: float = 1.5
    wide_fence: float = 3.0
    wide_fence_share: float = 0.12
    z_min_levels: int = 40
    z_scale: float = 0.6745
    z_threshold: float = 3.5
    outlier_examples: int = 8

    # implausible values
    tiny_value: float = 1.0
    tiny_min_count: int = 10
    tiny_share: float = 0.08
    rare_min_levels: int = 3
    rare_max_levels: int = 12
    rare_level_floor: int = 2
    rare_level_share: float = 0.01
    rare_level_listed: int = 6

    # concentration
    core_coverage: float = 0.80
    core_min_share: float = 0.05
    core_min_total: float = 0.50
    core_min_categories: int = 3
    core_max_categories: int = 400
    rare_share: float = 0.02
    rare_count_floor: int = 3
    rare_count_cap: int = 8

    # group profiles
    group_min_levels: int = 2
    group_max_levels: int = 80
    group_min_rows: int = 8
    group_min_size: int = 5
    group_range_size: int = 10
    groups_kept: int = 20
    group_far_high: float = 2.0
    group_far_low: float = 0.5
    small_sample: int = 8

    # relations
    min_shared_values: int = 3
    join_score: float = 0.48
    name_weight: float = 0.42
    overlap_weight: float = 0.58
    id_bonus: float = 0.08
    links_per_table_pair: int = 2
    links_total: int = 40
    link_examples: int = 8
    unique_side_ratio: float = 0.92
    near_unique_text_ratio: float = 0.95
    union_jaccard: float = 0.8
    union_min_shared: int = 2

    # findings
    highlights: int = 16
    hypotheses: int = 14
    relation_hypotheses: int = 8
    recommendations: int = 6


DEFAULT_LIMITS = Limits()
