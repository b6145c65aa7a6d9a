"""Explicit schemas of the tables the engine reads. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

OPTION = "struct<key:string,content:string>"
OPTIONS = f"array<{OPTION}>"
STRINGS = "array<string>"
LONGS = "array<bigint>"

TABLES = {
    "question_banks": "bank_id long, owner_id long, name string, status string",
    "subjects": "subject_id long, bank_id long, name string, sort_order int",
    "chapters": "chapter_id long, subject_id long, parent_id long, level int, name string, sort_order int",
    "questions": "question_id long, bank_id long, subject_id long, chapter_id long, type string, stem string, answer_json string, options_json string, knowledge_points_json string, difficulty double, status string, source_hash string",
    "attempts": "attempt_id long, user_id long, question_id long, session_id long, answer array<string>, is_correct int, duration_ms long, created_at timestamp",
    "wrong_questions": "user_id long, question_id long, wrong_count long, correct_count long, review_count long, mastery_score double, interval_days double, priority_score double, last_wrong_at timestamp, last_review_at timestamp, next_review_at timestamp, status string",
    "document_pages": "doc_id long, page_no int, text string, needs_ocr boolean",
    "directory": "document_id long, content_role string, section_path array<string>, section_scope string, set_no int, question_type string, question_no int, page_start int, page_end int, marker_top int, anchor string, identity string",
    "answers": "id long, document_id long, identity string, section_path array<string>, section_scope string, set_no int, question_type string, question_no int, answer array<string>, analysis string, page_start int, page_end int, source_kind string, run_id long",
    "candidates": "id long, document_id long, identity string, section_path array<string>, section_scope string, set_no int, question_no int, question_type string, stem string, page_start int, page_end int, status string",
    "rag_documents": "id long, source_type string, question_id long, document_id long, document_page int, bank_id long, subject_id long, chapter_id long, content string, stale int",
    "rag_embeddings": "doc_id long, model string, vector array<float>",
    "drafts": f"id long, session_id long, image_id long, seq_no int, question_type string, stem string, options {OPTIONS}, answer array<string>, answer_source string, review_status string, merge_status string, warnings array<string>, starts_mid boolean, ends_mid boolean",
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
