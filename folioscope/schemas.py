"""Schemas of foreign files, as DDL."""

BLOCK = "struct<block_id:int,type:string,text:string,bbox:array<double>,font_size:double,is_bold:boolean>"
PAGE = f"doc_id string, page_id string, page_index int, page_width double, page_height double, num_blocks int, blocks array<{BLOCK}>, items array<{BLOCK}>, layout_blocks array<{BLOCK}>, elements array<{BLOCK}>"
SPAN = "struct<formula_id:string,text:string,source_block:int>"
CONTEXT = "struct<chapter:string,section:string,subsection:string,chapter_number:int,section_number:int,subsection_number:int>"
UNIT_ENV = (
    f"label string, env string, number_components array<int>, extracted_labels array<string>, context {CONTEXT}, content string, dependencies array<string>, proof string, `index` int, "
    f"_source_blocks array<int>, _proof_blocks array<int>, _page_id string, _doc_id string, _formula_spans array<{SPAN}>"
)
UNIT_BLOCK = (
    f"doc_id string, page_id string, unit_id string, unit_type string, title string, statement_text string, formula_spans array<{SPAN}>, "
    "source_blocks array<int>, reading_order array<int>, confidence_score double, notes string"
)
RAW_ANSWER = "doc_id string, page_id string, raw_output string, candidate_source_blocks array<int>, source_blocks array<int>"
RUN_STATS = "method string, chapter int, llm_calls bigint, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, wall_time_seconds double"
ANNOTATION = "status string, page_id string, unit_id string, unit_type string, title string, statement_text string, notes string, source_blocks string, reading_order string, formula_span_texts string, formula_source_blocks string, annotation_confidence string, is_detached_heading string, is_proof_adjacent string"
