"""Fixed schemas of the tables.  Readers never infer."""

FILES = "batch_id string, file_ord bigint, path string, code string, patch string, language string"

BATCHES = (
    "batch_id string, repo string, repo_path string, sector string, pr_number int, commit string,"
    " ai_generated boolean, policy map<string,string>, require_ai_review boolean, ai_model string,"
    " ai_review_max_chars int"
)

BATCH_REQUEST = (
    "batch_id string, files array<struct<path:string,code:string,patch:string,language:string>>, sector string,"
    " repo_path string, policy map<string,string>, ai_generated boolean, ai_api_key string,"
    " require_ai_review boolean, ai_model string, ai_review_max_chars int, repo string, pr_number int,"
    " commit string, repo_license_texts array<struct<path:string,content:string>>"
)

LICENSE_TEXTS = "batch_id string, path string, content string"

# name -> type, in output order
FINDING_FIELDS = {
    "batch_id": "string", "file_ord": "bigint", "path": "string",
    "family": "string", "detector": "string", "detector_ord": "int", "rule_ord": "int", "pattern_ord": "int",
    "type": "string", "category": "string", "label": "string", "rule_id": "string", "pattern": "string",
    "match": "string", "start": "int", "end": "int", "line": "int", "at_line": "int",
    "original_file": "string", "original_line": "int", "snippet": "string", "license": "string",
    "message": "string", "explanation": "string", "suggestion": "string", "note": "string",
    "cwe": "string", "owasp": "string", "references": "array<string>", "severity": "string",
    "policy_level": "string", "copilot_strict": "boolean", "copilot_generated": "boolean",
    "related_issue": "string", "guideline_url": "string",
}

# Order of findings inside one file, as nested results list them.
FINDING_ORDER = ["detector_ord", "rule_ord", "pattern_ord", "start", "line"]

CONFIG = (
    "sector string, policy map<string,string>, restricted_licenses array<string>, ip_min_lines int,"
    " ip_min_chars int, copilot_strict boolean, override_allowed boolean, ai_generated boolean,"
    " ai_generated_labels array<string>, data_residency string, coding_standards string,"
    " coding_standards_builtin map<string,string>"
)

_AUDIT_FINDING = "struct<type:string,message:string,severity:string,policy_level:string,line:int,start:int,end:int>"
_AUDIT_ARRAYS = ",".join(
    f"{name}:array<{_AUDIT_FINDING}>"
    for name in ["issues", "coding_issues", "license_ip_issues", "sector_issues", "ai_suggestions",
                 "repo_license_issues"]
)
_COUNTS = "struct<issues:int,coding:int,license_ip:int,sector:int,ai:int,repo_license:int>"
AUDIT = (
    "timestamp string, audit_id string, request_id string, event string, resolution string, actor string,"
    " policy string, override_allowed boolean, input string,"
    f" output struct<policy:string,override_allowed:boolean,files_scanned:bigint,{_AUDIT_ARRAYS},findings:map<string,struct<{_AUDIT_ARRAYS}>>,counts:{_COUNTS}>,"
    " hash string, prev_hash string, seq bigint, lane int, pos bigint"
)

STATIC_RESULTS = (
    "results array<struct<check_id:string,start:struct<line:int>,extra:struct<message:string,severity:string,"
    "metadata:struct<cwe:array<string>,owasp:array<string>,references:array<string>>>>>"
)

# Entries of a reviewer's answer; every field is read as text and checked afterwards.
REVIEW_ITEM = (
    "type string, category string, severity string, message string, explanation string, suggestion string,"
    " references string, line string"
)
