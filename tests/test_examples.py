"""The small examples: any finding of the expected type."""

import pytest

from codesieve.operators import detect, duplicates


@pytest.mark.parametrize("code,kind,family", [
    ('api_key = "1234567890abcdef"', "hardcoded_secret", detect.security),
    ('cursor.execute("SELECT * FROM users WHERE name = " + user_input)', "sql_injection_risk", detect.security),
    ("def BadFunctionName():", "naming_convention", detect.coding),
    ('print("debug")', "logging_practice", detect.coding),
    ("/*\nMIT License\n*/", "license_detected", detect.licenses),
    ("same line here\nsame line here", "ip_duplication", duplicates.duplicate_lines),
])
def test_example(files, code, kind, family):
    assert kind in {r.type for r in family(files(code)).collect()}
