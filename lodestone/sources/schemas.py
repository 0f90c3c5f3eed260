"""Schemas of stored relations. Fields of parse trees are often absent in files, so they are never inferred."""

from __future__ import annotations

TREE = (
    "texts array<struct<self_ref:string,label:string,text:string,prov:array<struct<page_no:int>>>>,"
    "tables array<struct<label:string,prov:array<struct<page_no:int>>,captions:array<struct<`$ref`:string,text:string>>,data:struct<num_rows:int,num_cols:int,"
    "grid:array<array<struct<text:string,column_header:boolean,row_header:boolean,row_section:boolean>>>,"
    "table_cells:array<struct<text:string,column_header:boolean,start_row_offset_idx:int,end_row_offset_idx:int,start_col_offset_idx:int,end_col_offset_idx:int>>>>>,"
    "pictures array<struct<self_ref:string,label:string,captions:array<struct<`$ref`:string,text:string>>,prov:array<struct<page_no:int>>>>"
)
CANONICAL = (
    "schema_version string, document struct<filename:string,source_path:string,content_hash:string,file_size_bytes:bigint>, ingestion struct<job_id:string,status:string>,"
    "parser struct<name:string,version:string,docling_status:string>, artifacts struct<directory:string,canonical_json:string,docling_json:string,markdown:string>,"
    "pages array<struct<page_number:int>>, content struct<markdown_char_count:int>, structures struct<tables:struct<count:int>,figures:struct<count:int>>,"
    "parse struct<status:string,page_count:int,table_count:int,figure_count:int,errors:array<struct<type:string,stage:string,message:string>>>"
)
QUESTIONS = (
    "qa_id string, doc_id string, category string, question string, expected_answer string, expected_evidence_type string, expected_pages string,"
    "expected_source_notes string, should_abstain string, difficulty string, status string, reviewer_notes string"
)
