"""Text functions with Python's semantics for Unicode whitespace and line separators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesieve import fixed_values as fv


def strip(col: Column) -> Column:
    """Remove Unicode whitespace on both ends (plain ``trim`` only removes U+0020)."""
    return F.btrim(col, F.lit(fv.WHITESPACE))


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(fv.WHITESPACE))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(fv.WHITESPACE))


def split_lines(code: Column) -> Column:
    """Lines without separators; a separator at the end opens no further line.

    Texts that only use line feeds, nearly all, take the plain split; it is many times faster.
    """
    unusual = reduce(or_, [F.contains(code, F.lit(c)) for c in fv.OTHER_SEPARATORS])
    parts = F.when(unusual, F.split(code, fv.LINE_SEPARATOR_REGEX, -1)).otherwise(F.split(code, "\n", -1))
    return F.transform(F.array(parts), _drop_empty_tail).getItem(0)


def _drop_empty_tail(parts: Column) -> Column:
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def snippet(col: Column, width: int) -> Column:
    """First ``width`` characters, with dots when something was cut."""
    return F.when(F.length(col) > width, F.concat(F.substring(col, 1, width), F.lit("..."))).otherwise(col)


def truncate(col: Column, limit: Column) -> Column:
    return F.when(F.length(col) > limit, F.substring(col, F.lit(1), limit)).otherwise(col)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension of the basename; leading dots do not start one."""
    return F.lower(F.regexp_extract(path, r"(?s)(?:^|/)\.*[^/.][^/]*?(\.[^./]*)$", 1))


def relative_path(path: Column, root: str) -> Column:
    """The part below ``root`` of a file URI or path."""
    prefix = root.rstrip("/") + "/"
    plain = F.regexp_replace(path, r"^file:/*", "/")
    return F.when(F.startswith(plain, F.lit(prefix)), F.substring(plain, F.lit(len(prefix) + 1), F.length(plain))).otherwise(plain)


def extension_map(default: str, path: Column) -> Column:
    items = [F.lit(x) for pair in fv.LANGUAGE_BY_EXTENSION.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*items), extension(path)), F.lit(default))


def guess_language(path: Column, language: Column | None = None, default: str = "text") -> Column:
    """An explicit, non-empty language wins over the extension."""
    guessed = extension_map(default, path)
    return guessed if language is None else F.coalesce(blank_to_null(language), guessed)


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def language_group(language: Column) -> Column:
    """Which coding rules apply: js, java, go or generic."""
    low = F.lower(F.coalesce(language, F.lit("")))
    return (
        F.when(low.isin("javascript", "typescript"), "js")
        .when(low == "java", "java")
        .when(low == "go", "go")
        .otherwise("generic")
    )


def line_of_offset(code: Column, start: Column) -> Column:
    """1-based line that holds a code-point offset (line feeds before it, plus one)."""
    head = F.substring(code, F.lit(1), start)
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def day_of(timestamp: Column) -> Column:
    """Day part of an ISO timestamp; ``unknown`` when there is none."""
    return F.coalesce(blank_to_null(F.substring(timestamp, 1, 10)), F.lit("unknown"))


def utf8_text(binary: Column) -> Column:
    """Bytes to text; invalid bytes are dropped."""
    return F.regexp_replace(F.make_valid_utf8(binary.cast("string")), "\\x{FFFD}", "")


def decode_base64(content: Column, encoding: Column | None = None) -> Column:
    """Base64 text to UTF-8 text (invalid bytes become U+FFFD); other encodings pass through."""
    decoded = F.make_valid_utf8(F.unbase64(F.regexp_replace(content, r"\s", "")).cast("string"))
    if encoding is None:
        return decoded
    return F.when(encoding.isNull() | encoding.isin("", "base64"), decoded).otherwise(content)


def truthy(col: Column) -> Column:
    return F.coalesce(F.lower(col).isin(fv.TRUTHY), F.lit(False))


def mentions_copilot(col: Column) -> Column:
    return F.coalesce(F.contains(F.lower(col), F.lit("copilot")), F.lit(False))


def strip_fence(col: Column, tag: str = "[a-zA-Z]*") -> Column:
    """Drop a leading code fence with its tag and a closing fence, if the text starts with one."""
    opened = F.regexp_replace(col, r"\A```" + tag + r"\s*", "")
    return F.when(F.startswith(col, F.lit("```")), F.regexp_replace(opened, r"```\s*\z", "")).otherwise(col)


def client_key(forwarded: Column, host: Column) -> Column:
    """First forwarded address, else the host, else ``unknown``."""
    return F.coalesce(strip(F.split_part(blank_to_null(forwarded), F.lit(","), F.lit(1))), host, F.lit("unknown"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as lower-case hex, from two nested ``sha2`` calls."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)
