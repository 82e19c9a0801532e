"""Bytes of pages to text: which encoding they are in, and decoding that never fails."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Byte order marks, the longest first, and other names of encodings.
MARKS = [(codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]
ALIASES = {"gb2312": "gb18030", "gbk": "gb18030", "x-gbk": "gb18030", "utf8": "utf-8", "latin1": "cp1252", "iso-8859-1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "shift-jis": "cp932", "shift_jis": "cp932", "sjis": "cp932", "ks_c_5601-1987": "cp949", "euc-kr": "cp949", "big5": "big5hkscs"}
GUESSES = ("gb18030", "big5hkscs", "cp932", "euc_jp", "cp949", "cp1252", "iso8859_15")
HEAD = 4096
_HEADER = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_META = re.compile(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)|<\?xml[^>]*?encoding\s*=\s*[\"']([\w.:-]+)", re.I)


def _known(name: str | None) -> str | None:
    if not name:
        return None
    name = name.strip().lower()
    try:
        return codecs.lookup(ALIASES.get(name, name)).name
    except LookupError:
        return None


#: How much a character says for its encoding, by the range of its first byte (and second, where given): common characters most, rare ones little.
CLASSES: dict[str, list[tuple[int, int, int, int, float]]] = {
    "gb18030": [(0xB0, 0xD7, 0xA1, 0xFE, 1.0), (0xD8, 0xF7, 0xA1, 0xFE, 0.35), (0xA1, 0xA3, 0xA1, 0xFE, 0.6), (0xA4, 0xA9, 0xA1, 0xFE, 0.1), (0x81, 0xFE, 0x40, 0xFE, 0.05)],
    "big5hkscs": [(0xA4, 0xC6, 0x40, 0xFE, 1.0), (0xC9, 0xF9, 0x40, 0xFE, 0.3), (0xA1, 0xA3, 0x40, 0xFE, 0.6), (0x81, 0xFE, 0x40, 0xFE, 0.05)],
    "cp932": [(0x82, 0x82, 0x9F, 0xF1, 1.3), (0x83, 0x83, 0x40, 0x96, 1.3), (0x88, 0x97, 0x40, 0xFC, 0.9), (0x81, 0x81, 0x40, 0xFC, 0.7), (0x98, 0xEA, 0x40, 0xFC, 0.2), (0x81, 0xFC, 0x40, 0xFC, 0.05)],
    "euc_jp": [(0xA4, 0xA5, 0xA1, 0xF6, 1.3), (0xB0, 0xCF, 0xA1, 0xFE, 0.8), (0xA1, 0xA3, 0xA1, 0xFE, 0.6), (0xD0, 0xF4, 0xA1, 0xFE, 0.2), (0x8E, 0xFE, 0xA1, 0xFE, 0.05)],
    "cp949": [(0xB0, 0xC8, 0xA1, 0xFE, 0.8), (0xA1, 0xA3, 0xA1, 0xFE, 0.5), (0xCA, 0xFD, 0xA1, 0xFE, 0.1), (0x81, 0xFE, 0x41, 0xFE, 0.05)],
}
#: Korean syllables share their byte pairs with common Chinese characters; these come most often in Korean and count twice.
HANGUL = set("이다는을의에가고하지로기사도리한인자아은대서어정시일해수나보들그있것전제상라부여성과구장만유주동원조비국스적용내")
#: Of encodings of one byte: letters as they stand in words of their languages.
LETTERS = {"cp1251": "\u0430-\u044f\u0451", "koi8_r": "\u0430-\u044f\u0451", "cp1253": "\u03ac-\u03ce", "cp1255": "\u05d0-\u05ea", "cp1256": "\u0621-\u064a"}
SURE = 0.6


def _common(text: str, name: str) -> float:
    """Mean weight of the characters of text that take more than a byte, by their bytes in an encoding; half-width kana count little."""
    total, n = 0.0, 0
    for c in text:
        if c < "\x80":
            continue
        b, n = c.encode(name, "replace"), n + 1
        if len(b) == 2:
            total += 1.6 if name == "cp949" and c in HANGUL else next((w for low, high, least, most, w in CLASSES[name] if low <= b[0] <= high and least <= b[1] <= most), 0.0)
    return total / n if n else 0.0


def guess(body: bytes) -> tuple[str | None, float]:
    """The encoding that the bytes speak for most, and how surely, from 0 to 1; none for bytes that are all ASCII.

    In East Asian encodings common characters stand in known ranges of byte pairs; in Western ones accented letters stand alone among ASCII
    letters, in those of other alphabets small letters stand in runs.
    """
    part = body[: 16 * HEAD]
    high = sum(x >= 0x80 for x in part)
    if not high:
        return None, 0.0
    found: dict[str, float] = {}
    for name in CLASSES:
        try:
            text = codecs.getincrementaldecoder(name)().decode(part)  # a character may be cut at the end
        except UnicodeDecodeError:
            continue
        found[name] = _common(text, name)
    for name, small in LETTERS.items():
        text = part.decode(name, "replace")
        found[name] = 0.9 * sum(len(x) for x in re.findall(f"[{small}]{{3,}}", text)) / high
    latin = part.decode("cp1252", "replace")
    alone = re.findall("(?<=[A-Za-z])[\u00c0-\u00ff](?=[A-Za-z ,.;:!?<]|$)|\\b[\u00c0-\u00ff](?=[a-z ])|[\u2013-\u201d\u00a0\u00ab\u00bb\u20ac\u00a9]", latin)
    found["cp1252"] = 0.95 * len(alone) / high
    best = max(found, key=found.get)
    return best, min(1.0, found[best])


def detect(body: bytes, content_type: str | None = None, declared: str | None = None) -> str:
    """Declared, then byte order mark, header, meta in the first bytes, UTF-8 if it decodes, what the bytes speak for (guess) if that is sure enough, and the first of GUESSES that decodes."""
    if found := _known(declared):
        return found
    for mark, name in MARKS:
        if body.startswith(mark):
            return name
    if (m := _HEADER.search(content_type or "")) and (found := _known(m[1])):
        return found
    if (m := _META.search(body[:HEAD])) and (found := _known((m[1] or m[2]).decode("ascii", "replace"))):
        return found
    try:
        codecs.getincrementaldecoder("utf-8")().decode(body[: 16 * HEAD])
        return "utf-8"
    except UnicodeDecodeError:
        name, sure = guess(body)
        if name and sure >= SURE:
            return name
    for name in GUESSES:
        try:
            codecs.getincrementaldecoder(name)().decode(body[: 16 * HEAD])  # a character may be cut at the end
            return name
        except UnicodeDecodeError:
            continue
    return "utf-8"


@F.pandas_udf(T.StringType())
def detect_encoding(body: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else detect(b, c) for b, c in zip(body, content_type, strict=True)])


@F.pandas_udf(T.StringType())
def decode_body(body: pd.Series, encoding: pd.Series) -> pd.Series:
    """Text with a replacement character for what can't be read; an unknown encoding counts as UTF-8, a byte order mark goes."""

    def one(b: bytes | None, e: str | None) -> str | None:
        return None if b is None else b.decode(_known(e) or "utf-8", "replace").removeprefix("﻿")

    return pd.Series([one(b, e) for b, e in zip(body, encoding, strict=True)])
