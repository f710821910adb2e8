"""The shapes of spans, documents, variables, rules and projects."""

from __future__ import annotations

#: A half-open range of code points with what was found there. seq breaks ties in the order of sources.
SPAN = "struct<start:bigint,end:bigint,value:string,kind:string,source:string,priority:int,seq:int>"
SPANS = f"array<{SPAN}>"

DOCUMENTS = "project_id string, doc_id bigint, doc_order bigint, name string, text string"
VARIABLES = "project_id string, value string, token string, kind string, variable_order bigint"
ALWAYS = "value string, kind string"
NEVER = "value string"
PATTERNS = "id string, label string, pattern string, flags string, kind string, enabled boolean"
DECISIONS = "project_id string, value string, kind string, include boolean, decision_order bigint"
RUNS = "doc_id bigint, page int, seq int, text string, x double, y double, width double, height double, has_eol boolean, bold boolean, italic boolean"

#: Built-in kinds of values, in the order of their listing; any other label is a kind of its own.
KINDS = ("name", "street", "city", "postal", "phone", "pin", "email", "org", "custom")
