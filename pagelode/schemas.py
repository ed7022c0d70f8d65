"""Schemas of documents as they are stored and worked on; readers never infer them."""

from __future__ import annotations

BBOX = "struct<x0: double, y0: double, x1: double, y1: double>"
CITATION = f"struct<citation_id: string, page: int, bbox: {BBOX}, source: string, confidence: double, content_type: string, file_reference: string, content_hash: string, requires_human_review: boolean, confidence_level: string>"
#: A block of any kind: text, picture, table or graphics; fields of other kinds are null.
BLOCKS = f"doc_id string, page int, ord int, type string, bbox {BBOX}, citation string, md_start int, md_end int, content string, image_ref string, table_ref string, markdown_table string, source string"
PAGES = "doc_id string, page int, markdown string"
OCR = f"doc_id string, page int, bbox {BBOX}, text string, confidence double, source string, citation string, associated_block string, language string"
#: The sidecar file of a document, in its object layout; every key may be missing.
SIDECAR_BLOCK = "struct<type: string, bbox: array<double>, citation: string, md_slice: array<int>, content: string, markdown: string, image_ref: string, image: string, table_ref: string, markdown_table: string, source: string, content_hash: string>"
SIDECAR_PAGE = f"struct<page: int, markdown: string, blocks: array<{SIDECAR_BLOCK}>, ocr: array<struct<bbox: array<double>, text: string, confidence: double, source: string, citation: string, associated_block: string, language: string>>, citations: map<string, struct<citation_id: string, page: int, bbox: array<double>, source: string, confidence: double, content_type: string>>, metadata: map<string, string>>"
SIDECAR = f"pdf_name string, total_pages int, extraction_metadata map<string, string>, pages array<{SIDECAR_PAGE}>"
FIELD_DEFINITIONS = "doc_id string, page int, message_id string, ord int, row int, field_name string, field_type string, optionality string, cardinality string, description string, example string, citation_id string"
CORRECTIONS = "prompt_hash string, model string, prompt_text string, original_response string, corrected_response string, is_verified boolean, device_id string, message_type string, created_at timestamp, reviewed_at timestamp, hit_count long"
FEEDBACK = f"feedback_id string, extraction_id string, block_hash string, page int, bbox {BBOX}, original_content string, original_confidence double, source_type string, feedback_type string, corrected_content string, corrected_confidence double, include_in_training boolean, created_at timestamp"
DEVICE_VERSIONS = "device_id string, vendor string, model string, device_name string, version string, pdf_hash string, index_path string, report_path string, is_baseline boolean, message_summary struct<total: int, observation: int, config: int, qc: int, vendor_specific: int, unrecognized: int, fields: int>, registered_at timestamp"
MANIFEST = "pdf_name string, json_path string, chunk_count long, indexed_at timestamp, status string"

#: The closed vocabularies of the model.
BLOCK_TYPES = ("text", "picture", "table", "graphics")
CITATION_SOURCES = ("text", "ocr", "graphics")
CONFIDENCE_LEVELS = ("accepted", "review", "rejected")
FEEDBACK_TYPES = ("correction", "confirmation", "rejection", "classification")
SEVERITIES = ("warning", "error", "fatal")
IMPACT_LEVELS = ("HIGH", "MEDIUM", "LOW")
