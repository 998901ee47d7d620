"""Column-name rules, as case-insensitive regular expressions."""

from __future__ import annotations

from pyspark.sql import Column

# Name patterns that drive roles, targets, leakage and cleaning.
TIME = r"(time|date|timestamp|datetime|created|updated|modified|at$|_at$|_on$|_ts$)"
IDENTIFIER = r"(^|_)(id|uuid|key|code|number|num)($|_)"
PII = r"(email|phone|mobile|ssn|address|first_name|last_name|full_name|name$)"
TARGET = r"(target|label|duration|minutes|hours|seconds|delay|eta|outcome|score|amount|total|time)"
POST_EVENT = r"(actual|completed|delivered|observed|real|final|delivery_time|elapsed|duration)"
PRE_EVENT = r"(promised|planned|estimated|estimate|expected|scheduled|forecast|projected)"
COORDINATE = r"(^|_)(lat|lon|lng|latitude|longitude)($|_)"
METADATA = r"(created|updated|modified|version|source|ingested|batch|partition)"
LEAKAGE = r"(delivered|delivery|completed|finished|actual|outcome|result)"
TIMESTAMP_TO_CLEAN = r"(?:^|[_-])(timestamp|datetime|date|created|updated|modified)(?:$|[_-])"
POSITIVE_ONLY = r"(value|capacity|rating|time|min|eta)"
DATETIME_VALUES = [
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    r"^\d{2}/\d{2}/\d{4}$",
    r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$",
    r"^\d{2}-\d{2}-\d{4}$",
]
BOOLEAN_WORDS = ["0", "1", "0.0", "1.0", "true", "false", "yes", "no"]
KEY_WORDS = ["uuid", "guid", "key", "code"]


def matches(name: Column, pattern: str) -> Column:
    return name.rlike("(?i)" + pattern)
