"""Text normalisation shared by the operators on documents."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look Latin.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһӏԛԝαορντικεАВЕКМНОРСТХІЈЅ", "aeopcyxijsdhlqwaopvtikeABEKMHOPCTXIJS")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_QUOTE = re.compile(r"(?m)^[ \t]*(?:>[ \t]?)+")
_HYPHENATED = re.compile(r"(\w)[-‐‑][ \t]*\r?\n[ \t>]*(\w)")
_MARK = re.compile(r"[*_`~#|]+")
_WORD = re.compile(r"[^\W_]+(?:[.,:]\d+)*%?")


def plain(text: str | None) -> str:
    """Text without markup, entities, quote marks, line-break hyphens and invisible characters, NFKC."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    text = _INVISIBLE.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _HYPHENATED.sub(r"\1\2", _QUOTE.sub("", text))
    return unicodedata.normalize("NFKC", text).translate(LOOKALIKES)


def words(text: str | None) -> list[str]:
    """Lower-case words in order; a number with its decimals is one word, markup signs are none."""
    return _WORD.findall(_MARK.sub("", plain(text)).lower())
