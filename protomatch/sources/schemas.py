"""Explicit schemas of the text inputs. Keys are always text, never guessed."""

from __future__ import annotations

# Alignment numbers arrive as text and are coerced later, so a stray word in a
# number column becomes NULL instead of failing the scan.
HITS = (
    "spacer_id string, target_id string, strand string, position bigint, details string, "
    "mismatches string, gaps string, alignment_seq string, alignment_length string"
)
SPACER_DETAILS = (
    "gcf string, crispr string, spacer_seq string, spacer string, spacer_id string, "
    "crispr_score double, crispr_type string, repeat_seq string, repeat_length bigint, id string"
)
STRAIN_NAMES = "assembly string, strain string"
PHAGE_LENGTHS = "target_id string, target_gca string, target_length bigint"
IMGVR_METADATA = (
    "target_id string, phage string, target_gca string, target_length bigint, "
    "target_completeness double"
)
TAXONOMY = "gcf_tax string, taxonomy string"

# Columns a nucleoid classification table adds to the hits.
NUCLEOID_COLUMNS = (
    "nucleoid_forming",
    "shell_id",
    "tubulin_id",
    "shell_evalue",
    "tubulin_evalue",
    "shell_description",
    "tubulin_description",
)
NUCLEOID = (
    "nucleoid_forming string, shell_id string, tubulin_id string, shell_evalue string, tubulin_evalue string, "
    "shell_description string, tubulin_description string"
)
# What the reports read from stored hits.
STORED_HITS = (
    "system string, shuffled string, target_database string, gcf string, target_gca string, target_id string, "
    "spacer_seq string, target_length bigint, score double, nucleoid_forming string"
)
