"""The plain form of a text and its words."""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"<[^<>]{0,200}>")
#: Soft hyphen and zero-width characters (fixed values).
_UNSEEN = dict.fromkeys([0x00AD, 0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_BROKEN = re.compile(r"(?<=[^\W\d_])[-\u2010][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+")
#: Unicode white space, for classes in Python's re.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def plain(text: str | None) -> str:
    """Tags and unseen characters dropped, references decoded, marks dropped, broken words joined, lower case. None gives ''."""
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_UNSEEN))
        if not text.isascii():
            text = "".join([c for c in text if not unicodedata.combining(c)])
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    """Longest runs of letters and digits of the plain form."""
    return WORD.findall(plain(text))
