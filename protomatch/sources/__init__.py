from protomatch.sources.readers import (
    drop_header_lines,
    pairs_to_lines,
    parse_cells,
    read_fasta,
    read_hits,
    read_hits_tables,
    read_imgvr_metadata,
    read_nucleoid_table,
    read_phage_lengths,
    read_phage_names,
    read_profiles,
    read_search_results,
    read_spacer_details,
    read_spacer_pairs,
    read_strain_names,
    read_taxonomy,
)
from protomatch.sources.rejects import LAYOUTS, count_rejected, rejected_cells, rejected_lines
from protomatch.sources.sinks import (
    write_annotated_hits,
    write_hits_table,
    write_length_classes,
    write_match_table,
    write_processed,
    write_score_table,
)

__all__ = [
    "LAYOUTS",
    "count_rejected",
    "rejected_cells",
    "rejected_lines",
    "drop_header_lines",
    "pairs_to_lines",
    "parse_cells",
    "read_fasta",
    "read_hits",
    "read_hits_tables",
    "read_imgvr_metadata",
    "read_nucleoid_table",
    "read_phage_lengths",
    "read_phage_names",
    "read_profiles",
    "read_search_results",
    "read_spacer_details",
    "read_spacer_pairs",
    "read_strain_names",
    "read_taxonomy",
    "write_annotated_hits",
    "write_hits_table",
    "write_length_classes",
    "write_match_table",
    "write_processed",
    "write_score_table",
]
