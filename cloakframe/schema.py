"""Types of the engine's rows."""

from __future__ import annotations

FINDING = "struct<start:int,end:int,entity_type:string,value:string,tier:string,score:double>"
FINDINGS = f"array<{FINDING}>"
SPAN = "struct<start:int,end:int,path:string>"
SPANS = f"array<{SPAN}>"

DOCUMENT = f"doc_id string, source_path string, source_format string, text string, warnings array<string>, metadata map<string,string>, value_spans {SPANS}, error string"

LABEL_FILE = (
    "schema string, doc_id string, source_file string, source_format string, locator_mode string, "
    "spans array<struct<id:string,type:string,value:string,field:string,occurrence:int,subject:string,context:string,phase:int,expected:string,note:string>>, "
    "negative_controls array<struct<value:string,note:string>>, known_traps array<string>, "
    "expected_phase1_counts struct<total_spans:int,by_context:map<string,int>,by_subject:map<string,int>,by_type:map<string,int>>, "
    "expected_phase2_counts struct<total_spans:int,by_context:map<string,int>,by_subject:map<string,int>,by_type:map<string,int>>"
)

LOG = "seq long, ts timestamp, level string, logger string, message string"
