"""Text functions on columns. All but entity decoding, normalisation and templates are Catalyst expressions."""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's re has it: Unicode's, and the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]"

# Patterns that must match what is matched elsewhere.
NUMBER = r"-?\d+\.?\d*"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
URL = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
PHONES = (r"\b1[3-9]\d{9}\b", r"\b0\d{2,3}[-\s]?\d{7,8}\b", r"\b400[-\s]?\d{3}[-\s]?\d{4}\b")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def _without_tags(text: Column, instead: str) -> Column:
    blocks = F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</\1>", instead)
    comments = F.regexp_replace(blocks, r"(?s)<!--.*?-->", instead)
    return F.regexp_replace(comments, r"<[^>]+>", instead)


def remove_html_tags(text: Column) -> Column:
    """Without script and style blocks, comments and tags; stripped."""
    return strip(_without_tags(text, ""))


def html_to_text(text: Column) -> Column:
    """Tags become spaces, then white space is squeezed."""
    return remove_extra_whitespace(_without_tags(text, " "))


def remove_extra_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def remove_special_chars(text: Column, keep: str = "") -> Column:
    """Keeps word characters, white space, CJK ideographs and the characters of keep."""
    kept = "".join(f"\\x{{{ord(c):x}}}" for c in keep)
    return F.regexp_replace(text, rf"(?U)[^\w\s\x1c-\x1f一-鿿{kept}]", "")


@F.pandas_udf(T.StringType())
def decode_html_entities(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([A-Za-z][A-Za-z0-9]*));")


@F.pandas_udf(T.StringType())
def decode_closed_entities(text: pd.Series) -> pd.Series:
    """Decodes references that end with a semicolon only, so that one that was cut stays as it is."""
    return text.map(lambda t: _CLOSED.sub(lambda m: html5.get(f"{m[1]};", m[0]) if m[1] else html.unescape(m[0]), t), na_action="ignore")


@F.pandas_udf(T.StringType())
def normalize_unicode(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _decoded_and_normal(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t)), na_action="ignore")


def clean_text(text: Column, tags: bool = True, entities: bool = True, whitespace: bool = True, special: bool = False, normal: bool = True) -> Column:
    """Tags, entities, NFKC, white space, special characters, in this order; entities and NFKC share one trip to Python."""
    if tags:
        text = remove_html_tags(text)
    if entities and normal:
        text = _decoded_and_normal(text)
    elif entities:
        text = decode_html_entities(text)
    elif normal:
        text = normalize_unicode(text)
    if whitespace:
        text = remove_extra_whitespace(text)
    return remove_special_chars(text) if special else text


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(group)), F.array().cast("array<string>"))


def extract_numbers(text: Column) -> Column:
    return _all(text, NUMBER)


def extract_emails(text: Column) -> Column:
    return _all(text, EMAIL)


def extract_urls(text: Column) -> Column:
    return _all(text, URL)


def extract_phones(text: Column) -> Column:
    """Mobile numbers, then landlines, then hotlines."""
    return F.concat(*(_all(text, p) for p in PHONES))


def strip_control_chars(text: Column, keep: str = "\t\n\r", letters: bool = False) -> Column:
    """Keeps printable ASCII, CJK ideographs and keep. With letters, every other letter, mark, number, punctuation and symbol stays too."""
    kept = "".join(f"\\x{{{ord(c):x}}}" for c in keep) + (r"\p{L}\p{M}\p{N}\p{P}\p{S}" if letters else "")
    return F.regexp_replace(text, rf"[^\x20-\x7e一-鿿{kept}]", "")


def truncate(text: Column, limit: int = 255, ellipsis: str = "...") -> Column:
    """A cut that would begin before the text's start counts from its end, as slices do."""
    room = limit - len(ellipsis)
    head = F.substring(text, 1, room) if room >= 0 else F.substring(text, F.lit(1), F.greatest(F.length(text) + room, F.lit(0)))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit(ellipsis)))


def regex_findall(text: Column, pattern: str, groups: int = 0) -> Column:
    """All matches, dots matching line ends; group 1 if the pattern has groups."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?sU){pattern}"), F.lit(min(groups, 1))), F.array().cast("array<string>"))


def regex_findone(text: Column, pattern: str, groups: int = 0, default: str | None = None) -> Column:
    """The first match, or its group 1 if the pattern has groups."""
    found = regex_findall(text, pattern, groups)
    return F.when(F.size(found) > 0, found[0]).otherwise(F.lit(default))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _contexts(found: pd.Series, between: pd.Series, around: pd.Series) -> pd.Series:
    """What lies around each match of a text that is given as its matches and the pieces between them."""

    def one(matches, pieces, n: int) -> list[str] | None:
        if matches is None or pieces is None:
            return None
        pieces = [*pieces]
        text = "".join(x for pair in zip(pieces, [*matches, *[""] * (len(pieces) - len(matches))], strict=False) for x in pair)
        out, at = [], 0
        for piece, match in zip(pieces, matches, strict=False):
            start = at + len(piece)
            at = start + len(match)
            low, high = max(start - n, 0), min(at + n, len(text))
            out.append("..." * (low > 0) + text[low:high] + "..." * (high < len(text)))
        return out

    return pd.Series([one(m, p, n) for m, p, n in zip(found, between, around, strict=True)])


def regex_with_context(text: Column, pattern: str, around: int = 150) -> Column:
    """Matches, case aside, as structs of match and context: so many characters on both sides, with ... where the text is cut.

    The text is split at the matches once, and its pieces are gone through once in Python, so that the time grows with the text, not with text times matches.
    """
    p = f"(?iU){pattern}"
    found = F.filter(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: m != "")
    contexts = _contexts(found, F.split(text, p), F.lit(around))
    return F.transform(F.arrays_zip(found.alias("match"), contexts.alias("context")), lambda x: F.struct(x["match"].alias("match"), x["context"].alias("context")))


def header_value(headers: Column, name: str, default: str | None = None) -> Column:
    """A header by its name as given, in lower case, capitalised or in title case, whichever comes first in that order."""
    ways = list(dict.fromkeys([name, name.lower(), name.capitalize(), name.title()]))
    return F.coalesce(*(F.try_element_at(headers, F.lit(w)) for w in ways), F.lit(default))


def parse_cookies(header: Column) -> Column:
    """Cookie text to a map; attributes of cookies, which have no value, are left out. The last of a name wins."""
    parts = F.filter(F.transform(F.split(header, ";"), lambda p: F.trim(p)), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    return _last_of_key(pairs)


def _last_of_key(pairs: Column) -> Column:
    """Map of an array of structs (k, v) in which keys may come again."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"].alias("v"))))


def form_to_map(text: Column) -> Column:
    """a=1&b=x+y to a map, percent and plus decoded; what has no = is left out."""
    parts = F.filter(F.split(text, "&"), lambda p: F.contains(p, F.lit("=")))
    return _last_of_key(F.transform(parts, lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"), F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v"))))


def cookies_to_map(text: Column) -> Column:
    """a=1; b=2 to a map; parts are divided by ; or, where there is none, by &."""
    parts = F.filter(F.split(text, F.when(F.contains(text, F.lit(";")), ";").otherwise("&")), lambda p: F.contains(p, F.lit("=")))
    return _last_of_key(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v"))))


def metric_name(key: Column, prefix: str) -> Column:
    """Lower case, every run of other characters one underscore, none at the ends, after the prefix."""
    name = F.regexp_replace(F.regexp_replace(F.lower(key), r"[^a-z0-9_]", "_"), "_+", "_")
    return F.concat(F.lit(f"{prefix}_"), F.trim(name, F.lit("_")))


# Names that one operating system reserves.
RESERVED = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]


def safe_filename(name: Column) -> Column:
    """Separators and dangerous characters become _, control characters go, reserved names get _ before them, long names are cut to 190 characters and their extension."""
    name = F.regexp_replace(F.translate(name, "/\\", "__"), r"[\x00-\x1f]", "")
    name = F.translate(name, '<>:"|?*', "_" * 7)
    # the extension is the last dot and what follows, unless only dots come before
    ext = F.regexp_extract(name, r"^\.*[^.](?:.*[^.]|)?\.*(\.[^.]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    name = F.when(F.upper(stem).isin(RESERVED), F.concat(F.lit("_"), name)).otherwise(name)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    name = F.when(F.length(name) > 200, F.concat(F.substring(stem, 1, 190), ext)).otherwise(name)
    return F.when(strip(name) == "", "unnamed_file").otherwise(name)


def table_name(name: Column) -> Column:
    """Stripped, with _ for spaces and hyphens; null if anything but ASCII letters, digits and underscores is left."""
    out = F.translate(strip(name), " -", "__")
    return F.when(F.rlike(out, F.lit(r"\A[a-zA-Z0-9_]+\z")), out)


def render(template: str, values: dict[str, Column]) -> Column:
    """{name} and {{name}} replaced by values in turn; unknown names stay."""
    out = F.lit(template)
    for name, value in values.items():
        shown = F.coalesce(value.cast("string"), F.lit("None"))
        out = F.replace(F.replace(out, F.lit("{{" + name + "}}"), shown), F.lit("{" + name + "}"), shown)
    return out


# Extensions that content types get, and content types that extensions allow.
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "application/pdf": ".pdf", "text/html": ".html", "text/plain": ".txt", "application/json": ".json", "application/zip": ".zip", "video/mp4": ".mp4", "audio/mpeg": ".mp3"}
CONTENT_TYPES = {
    ".pdf": ["application/pdf"],
    ".doc": ["application/msword"],
    ".docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"],
    ".xls": ["application/vnd.ms-excel"],
    ".xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"],
    ".zip": ["application/zip", "application/x-zip-compressed"],
    ".txt": ["text/plain"],
    ".jpg": ["image/jpeg"],
    ".jpeg": ["image/jpeg"],
    ".png": ["image/png"],
    ".gif": ["image/gif"],
}


def attachment_name(url: Column, disposition: Column, content_type: Column) -> Column:
    """The name in Content-Disposition, else the URL's last part if it has a dot, else attachment_ with eight digits of the URL's MD5 and an extension for the type, .bin if that is unknown."""
    given = F.regexp_extract(disposition, r"filename[^;=\n]*=(([\'\"]).*?\2|[^;\n]*)", 1)
    last = F.substring_index(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/", -1)
    kinds = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    ext = F.coalesce(F.try_element_at(kinds, F.lower(F.substring_index(content_type, ";", 1))), F.lit(".bin"))
    made = F.concat(F.lit("attachment_"), F.substring(F.md5(url), 1, 8), ext)
    named = F.rlike(disposition, F.lit(r"filename[^;=\n]*="))
    return F.when(named, safe_filename(F.trim(given, F.lit("'\"")))).when(F.contains(last, F.lit(".")), safe_filename(last)).otherwise(made)


def content_type_allowed(extension: Column, content_type: Column) -> Column:
    """Whether the type holds one that the extension allows; an extension that is not known allows all."""
    known = F.create_map(*(x for e, kinds in CONTENT_TYPES.items() for x in (F.lit(e), F.array(*(F.lit(k) for k in kinds)))))
    allowed = F.try_element_at(known, extension)
    return allowed.isNull() | F.coalesce(F.exists(allowed, lambda k: F.contains(content_type, k)), F.lit(False))


# Python's exception classes by category. What derives from OSError counts as network before it can count as resource.
CRITICAL = ["MemoryError", "SystemError", "RecursionError", "KeyboardInterrupt", "SystemExit"]
NETWORK = [
    "OSError", "IOError", "EnvironmentError", "ConnectionError", "BrokenPipeError", "ConnectionAbortedError", "ConnectionRefusedError", "ConnectionResetError", "TimeoutError", "FileNotFoundError",
    "FileExistsError", "PermissionError", "IsADirectoryError", "NotADirectoryError", "BlockingIOError", "ChildProcessError", "InterruptedError", "ProcessLookupError", "gaierror", "SSLError",
]
DATA = ["ValueError", "TypeError", "KeyError", "IndexError", "AttributeError", "UnicodeError", "UnicodeDecodeError", "UnicodeEncodeError", "UnicodeTranslateError", "JSONDecodeError"]


def error_category(error: Column) -> Column:
    """critical, network or data by the exception class's name; unknown for the rest."""
    return F.when(error.isin(CRITICAL), "critical").when(error.isin(NETWORK), "network").when(error.isin(DATA), "data").otherwise("unknown")


def retryable(error: Column) -> Column:
    return error_category(error) == "network"
