"""Table schemas of the screen; every table is keyed by ``case_id``."""

from __future__ import annotations

FIELD = "struct<i:bigint,num:string,s:string,b:boolean,l:array<string>>"

ARTIFACTS = (
    "case_id bigint, artifact_seq int, artifact_id string, path_alias string, artifact_type string, "
    "size_bytes bigint, sha256 string, hash_scope string, bytes_hashed bigint, parser string, "
    "parser_version int, read_status string, changed_during_scan boolean, mtime timestamp"
)
FACTS = (
    "case_id bigint, fact_seq bigint, fact_id string, kind string, artifact_id string, "
    f"source_group string, fields map<string,{FIELD}>"
)
DECLARED = (
    "case_id bigint, weight_origin string, parameter_update string, training_stage string, "
    "inference_augmentation array<string>, exact_claim_text string"
)
COVERAGE_NOTES = "case_id bigint, rule_id string, path_alias string, detail string"
# emission order is (emit_block, emit_fact, emit_step): family block, fact in the
# block, step within the fact; ties on achievement go to the first emission
OUTCOMES = (
    "case_id bigint, emit_block int, emit_fact bigint, emit_step int, rule_id string, kind string, "
    "facet string, claim string, anchor string, achievement int, tier string, source_group string, "
    "fact_id string, artifact_id string"
)
CAP_REQUESTS = "case_id bigint, claim string, cap_id string, triggered_by string"
ABSTENTION_REQUESTS = "case_id bigint, facet string, abstention_id string"
OUT_OF_SCOPE = "case_id bigint, facet string"
