"""Plain single-process loops over the same rules, to have a time to compare with.

``python -m checks.single_process [sf]`` prints files, findings and seconds.
"""

from __future__ import annotations

import re
import sys
import time

import duckdb

from checks.corpus import SNIPPETS
from codesieve import rules as R

GROUP = {".js": "js", ".ts": "js", ".java": "java", ".go": "go"}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.1"
    rows = duckdb.sql(f"SELECT source, doc_id, text FROM '/root/testdata/sf{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    began = time.time()
    sector = [r for r in R.sector_rules() if r["pack"] == "finance"]
    rules = [(r, re.compile(r["pattern"] if r["kind"] != "restricted" else re.escape(r["pattern"]), re.I if r["ignore_case"] else 0))
             for r in R.builtin_rules() + R.restricted_rules() + sector]
    findings, seen = 0, {}
    for source, doc_id, body in rows:
        ext, snippet = SNIPPETS[doc_id % len(SNIPPETS)]
        code = body + "\n" + snippet
        group = GROUP.get(ext, "generic")
        for rule, pattern in rules:
            if rule["lang_group"] and (rule["lang_group"] != group or rule["language"] and ext != ".ts"):
                continue
            if rule["exists_only"]:
                findings += pattern.search(code) is not None
            else:
                findings += sum(1 for _ in pattern.finditer(code))
        lines = code.splitlines()
        first = {}
        for n, line in enumerate(lines):
            key = line.strip()
            if key and first.setdefault(key, n) != n:
                findings += 1
        plain, own = [x.rstrip() for x in lines], {}
        for n in range(len(plain) - 5):
            block = "\n".join(plain[n:n + 6]).strip()
            if len(block) >= 240:
                findings += own.setdefault(block, n) != n
                findings += seen.setdefault((source, hash(block)), doc_id) != doc_id
    print({"files": len(rows), "findings": findings, "seconds": round(time.time() - began, 2)})


if __name__ == "__main__":
    main()
