"""Fixed schemas of all tables."""

from __future__ import annotations

from pyspark.sql import types as T

PAGES = "source_file string, page int, text string"
CHUNKS = (
    "chunk_id string, vector array<float>, text string, source_file string, page_start int, page_end int, "
    "chunk_index int, word_count int"
)
ENTITY = "struct<name:string,type:string,candidate_role:string,textual_evidence:string,confidence:string>"
RAW_EXTRACTIONS = (
    "chunk_id string, source_file string, chunk_index int, docket_numbers array<string>, dates array<string>, "
    f"entities array<{ENTITY}>, needs_review boolean, extracted_at timestamp, model string, dedup_processed boolean"
)
ENTITIES = "entity_id string, name string, type string"
MENTIONED_IN = "entity_id string, chunk_id string, entity_index int, role string, textual_evidence string, confidence string"
POSSIBLE_DUPLICATES = "src_entity_id string, dst_entity_id string, reason string, flagged_at timestamp, status string"
ENTITY_MENTIONS = (
    "entity_id string, mention_text string, context_snippet string, vector array<float>, entity_type string, chunk_id string"
)
CANDIDATE = "struct<entity_id:string,name:string,source:string,chunk_id:string,snippet:string>"
JUDGMENT = "struct<verdict:string,reason:string>"
FAILURES = "chunk_id string, entity_index int, entity_name string, error string, failed_at timestamp"
PROGRESS = "type string, file string, error string, total_words int, chunk_count int, timestamp timestamp"

ENTITY_TYPES = ("person", "organization", "court", "reference")
ROLES = tuple(sorted(("judge", "witness", "counsel", "defendant", "plaintiff", "non_party"))) + ("other", "none")
CONFIDENCES = ("explicit", "resolved_from_context")
VERDICTS = ("same", "different", "unsure")


def parse(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
