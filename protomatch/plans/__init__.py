from protomatch.plans.workflow import (
    AnalysisSettings,
    Lookups,
    all_matches,
    classified_kind,
    classified_matches,
    classify,
    index_with_control,
    match_table,
    process_all,
    process_matches,
    run_workflow,
    score_tables,
    search_with_control,
    stack,
    tagged_search,
    ungapped_matches,
)

__all__ = [
    "AnalysisSettings",
    "Lookups",
    "all_matches",
    "classified_kind",
    "classified_matches",
    "classify",
    "index_with_control",
    "match_table",
    "process_all",
    "process_matches",
    "run_workflow",
    "score_tables",
    "search_with_control",
    "stack",
    "tagged_search",
    "ungapped_matches",
]
