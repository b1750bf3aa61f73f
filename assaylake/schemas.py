"""Schemas of the core relations, in DDL."""

from __future__ import annotations

SAMPLES = (
    "schema_version string, benchmark string, benchmark_version string, split string, split_origin string, sample_id string, "
    "task_family string, capability_tags array<string>, language string, translation_provenance string, question string, choices array<string>, "
    "context struct<text:array<string>, tables:array<struct<table_id:string,caption:string,rows:array<array<string>>,header_rows:int,metadata:map<string,string>>>, "
    "images:array<struct<image_id:string,local_path:string,url:string,caption:string>>, "
    "documents:array<struct<document_id:string,title:string,url:string,local_path:string,page_count:int>>, "
    "conversation_history:array<struct<role:string,content:string,turn_program:string,turn_answer:string>>>, "
    "gold struct<answer:string,answer_type:string,numeric_value:double,unit:string,scale:string,currency:string,"
    "evidence:array<struct<document_id:string,page:int,table_id:string,row:string,text_snippet:string>>,program:string,acceptable_answers:array<string>>, "
    "evaluation struct<absolute_tolerance:double,relative_tolerance:double,requires_citation:boolean,should_refuse:boolean>, "
    "source struct<license:string,url:string,checksum:string,redistributable:boolean>, metadata map<string,string>"
)

ANSWER = (
    "answer string, numeric_value double, unit string, period string, citations array<struct<document_id:string,page:int,table:string,row:string>>, "
    "insufficient_information boolean, confidence double, brief_explanation string"
)

PREDICTIONS = (
    "run_id string, sample_id string, benchmark string, split string, prompt_profile string, content string, answer string, numeric_value double, unit string, "
    "insufficient_information boolean, brief_explanation string, citations array<struct<document_id:string,page:int,table:string,row:string>>, "
    "error_type string, error string, cache_hit boolean, attempts int, prompt_tokens int, completion_tokens int, total_tokens int, latency_ms double, estimated_cost_usd double"
)

CALL = "struct<turn:int,tool_name:string,arguments:string,tool_exists:boolean,arguments_valid:boolean,executed:boolean,output:string,error:string,latency_ms:double,security_refused:boolean>"

TRACES = f"run_id string, sample_id string, tools_offered array<string>, turns int, result_used boolean, final_answer string, calls array<{CALL}>"

METRIC_RESULTS = "run_id string, sample_id string, metric_name string, value double, passed boolean, details string"
