"""Readable text of raw mail messages: transfer encodings and encoded words undone in place, markup taken off.

Tolerant by intent: missing end boundaries, mixed line ends and broken sections leave the text as it stands.
"""

from __future__ import annotations

import binascii
import html
import quopri
import re

_ENCODED = re.compile(r"(?im)^[ \t>|]*content-transfer-encoding:[ \t]*(base64|quoted-printable)[ \t]*\r?$")
_BLANK = re.compile(r"\r?\n[ \t]*\r?\n")
_BASE64_BLOCK = re.compile(r"(?:[A-Za-z0-9+/=]+[ \t]*(?:\r?\n|\Z))+")
_BOUNDARY = re.compile(r'(?i)boundary="?([^"\s;]+)')
_WORD = re.compile(r"=\?([\w.:-]+)(?:\*[\w-]*)?\?([bBqQ])\?([^?\s]*)\?=(?:\s+(?==\?))?")
_BLOCK_TAG = re.compile(r"(?i)</?(?:p|br|div|li|ul|ol|tr|td|th|table|blockquote|html|body|head|h[1-6]|hr|pre)\b[^<>]*>")
_ANY_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_HTML_HINT = re.compile(r"(?i)</(?:p|html|body|div)>|<br")


def _charset(head: str) -> str:
    m = re.search(r'(?i)charset="?([\w.:-]+)', head)
    return m[1] if m else "utf-8"


def _text(data: bytes, charset: str) -> str | None:
    """None where the bytes are no text."""
    if b"\0" in data:
        return None
    try:
        return data.decode(charset)
    except (LookupError, UnicodeDecodeError):
        pass
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace") if data.isascii() else None


def _decoded_word(m: re.Match) -> str:
    try:
        if m[2] in "bB":
            data = binascii.a2b_base64(m[3] + "=" * (-len(m[3]) % 4))
        else:
            data = quopri.decodestring(m[3].replace("_", " ").encode("latin-1", "replace"), header=False)
    except (binascii.Error, ValueError):
        return m[0]
    return _text(data, m[1]) or m[0]


def undo_transfer(text: str) -> str:
    """The message with encoded sections and header words replaced by what they say; encoded binary sections vanish."""
    if "=?" in text:
        text = _WORD.sub(_decoded_word, text)
    first = _ENCODED.search(text)
    if not first:
        return text
    ends = ["--" + b for b in set(_BOUNDARY.findall(text))]
    out: list[str] = []
    at = 0
    m: re.Match | None = first
    while m:
        blank = _BLANK.search(text, m.end(1))
        if not blank:
            break
        out.append(text[at : blank.end()])
        at = blank.end()
        head = text[max(text.rfind("\n\n", 0, m.start()), text.rfind("\n--", 0, m.start()), 0) : blank.start()]
        if m[1].lower() == "base64":
            block = _BASE64_BLOCK.match(text, at)
            if block:
                try:
                    said = _text(binascii.a2b_base64(block[0]), _charset(head))
                    out.append(said + "\n" if said is not None else "")
                    at = block.end()
                except binascii.Error:
                    pass
        else:
            stops = [i for i in (text.find("\n" + e, at - 1) for e in ends) if i >= 0]
            stop = min(stops, default=len(text))
            raw = text[at:stop]
            said = _text(quopri.decodestring(raw.encode("utf-8", "surrogatepass")), _charset(head))
            out.append(raw if said is None else said)
            at = stop
        m = _ENCODED.search(text, at)
    out.append(text[at:])
    return "".join(out)


def drop_markup(text: str) -> str:
    if "<" in text and _HTML_HINT.search(text):
        text = _ANY_TAG.sub("", _BLOCK_TAG.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    return text


def readable(text: str) -> str:
    return drop_markup(undo_transfer(text))
