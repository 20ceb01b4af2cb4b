"""Personal data in texts: Aho-Corasick finds anchors, local parsers expand and validate them.

One pass over a text's UTF-8 bytes, folded so that letters are lower case and every
digit is ``0``, meets all anchors: at-signs, the ends of URL schemes, a dot between
digits, a plus before a digit, two digits of one number, and the cue of a bank account.
From an anchor a parser expands to the left and right as far as the kind's characters
go, and validates what it finds. No anchor inside a stretch that a parser has already
taken starts another one, so a text costs time in proportion to its length, whatever it
holds. There is no shuffle, and a task holds one batch of texts.

Base kinds are the leftmost, non-overlapping matches of these expressions, longest
first, less those that fail their test (which are not tried again in part):

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+){3}`` with parts of at most 255
* card ``[0-9]([\\x20-]?[0-9])+`` with 16 to 19 digits that pass Luhn's test
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 8 to 15 digits

Beyond the base (``base`` is false):

* email with the Latin letters from U+00C0 to U+024F in names and labels, where that
  gives another span than the base
* address: the login and host of a URL that names a login, as ``ssh://login@host``
* account: an IBAN after the word, with its country's length and check digits

Edge cases: null texts are empty and have no spans; repeated rows each get their own;
the order of rows, other columns and their names don't matter; a text of any length is
read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "address", "account")
#: Kinds with base spans.
BASE_KINDS = KINDS[:4]
#: Schemes of URLs that may name a login.
SCHEMES = ("http", "https", "ftp", "ftps", "sftp", "ssh", "ws", "wss", "imap", "smtp", "ldap")
#: Characters of an IBAN by country (public IBAN registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

_DIGITS = b"0123456789"
_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOCAL = _LETTERS + _DIGITS + b"._%+-"
_LATIN = "".join(chr(c) for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7))
_WIDE_LOCAL = _LOCAL.decode() + _LATIN
_FOLD = bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))

_DOMAIN_END = re.compile(rb"[^A-Za-z0-9.-]|\.(?![A-Za-z0-9-])|\Z")
_WIDE_DOMAIN_END = re.compile(f"[^A-Za-z0-9.{_LATIN}-]|\\.(?![A-Za-z0-9{_LATIN}-])|\\Z")
_DOTTED_END = re.compile(rb"[^0-9.]|\.(?![0-9])|\Z")
_NUMBER_END = re.compile(rb"[^0-9\x20-]|[\x20-](?![0-9])|\Z")
_PHONE_END = re.compile(rb"[^\x20().0-9-]|\Z")
_LOGIN_END = re.compile(rb"[^A-Za-z0-9._~%!$&'()*+,;=:-]|\Z")
_ACCOUNT = re.compile(rb"[\x20:.#=-]{0,4}([A-Za-z]{2})[0-9]{2}")


@functools.cache
def _anchors() -> ahocorasick.Automaton:
    """The automaton over folded text; a pattern's value is its kind of anchor and length."""
    found = ahocorasick.Automaton()
    patterns = {"@": "at", "0.0": "dot", "+0": "plus", "00": "digits", "0 0": "digits", "0-0": "digits", "iban": "iban"}
    patterns |= {f"{scheme}://": "scheme" for scheme in SCHEMES}
    for pattern, kind in patterns.items():
        found.add_word(pattern, (kind, len(pattern)))
    found.make_automaton()
    return found


def _back(text: bytes, at: int, floor: int, allowed: bytes) -> int:
    """Where the run of ``allowed`` bytes that ends before ``at`` starts, not before ``floor``."""
    size = 64
    while True:
        piece = text[max(floor, at - size) : at]
        rest = len(piece.rstrip(allowed))
        if rest or at - size <= floor:
            return at - len(piece) + rest
        size *= 4


def _back_wide(text: bytes, at: int, floor: int) -> int:
    """As ``_back``, for the wide characters of a local part."""
    size = 64
    while True:
        piece = text[max(floor, at - size) : at].decode("utf-8", "ignore")
        rest = piece.rstrip(_WIDE_LOCAL)
        if rest or at - size <= floor:
            return at - len(piece[len(rest) :].encode())
        size *= 4


def _wide_domain(text: bytes, at: int) -> int:
    """Where the wide labels that start at ``at`` end."""
    size = 256
    while True:
        piece = text[at : at + size].decode("utf-8", "ignore")
        end = _WIDE_DOMAIN_END.search(piece).start()
        if end < len(piece) - 1 or at + size >= len(text):
            return at + len(piece[:end].encode())
        size *= 4


def _luhn(digits: bytes) -> bool:
    values = [b - 48 for b in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _small(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) <= 3 and int(part or b"0") <= 255


def _account_end(text: bytes, at: int, letters: int) -> int | None:
    """Where ``letters`` letters or digits from ``at`` end, single blanks between them; none if they stop short."""
    while letters:
        step = 1 if text[at : at + 1] == b" " else 0
        if not text[at + step : at + step + 1].isalnum():
            return None
        at, letters = at + step + 1, letters - 1
    return None if text[at : at + 1].isalnum() or text[at : at + 1] == b"_" else at


def byte_spans(text: bytes) -> list[tuple[int, int, int, bool]]:
    """(kind's number, start, end, base) in bytes of one UTF-8 text, in order."""
    out: list[tuple[int, int, int, bool]] = []
    add = lambda kind, start, end, base=True: out.append((KINDS.index(kind), start, end, base))
    past = dict.fromkeys(("email", "wide", "dotted", "number", "login", "account"), 0)
    wide = not text.isascii()
    for last, (anchor, length) in _anchors().iter(text.translate(_FOLD).decode("latin-1")):
        at = last + 1 - length
        if anchor == "digits":
            if at >= past["number"]:
                end = past["number"] = _NUMBER_END.search(text, at).start()
                if end - at >= 16:
                    digits = text[at:end].translate(None, b" -")
                    if 16 <= len(digits) <= 19 and _luhn(digits):
                        add("card", at, end)
        elif anchor == "dot":
            if at >= past["dotted"]:
                start = _back(text, at, past["dotted"], _DIGITS)
                end = past["dotted"] = _DOTTED_END.search(text, at).start()
                parts = text[start:end].split(b".")
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    stop = start + sum(map(len, four)) + 3
                    if all(map(_small, four)):
                        add("ip", start, stop)
                    start = stop + 1
        elif anchor == "plus":
            body = text[at + 2 : _PHONE_END.search(text, at + 2).start()].rstrip(b" ().-")
            if len(body) >= 2 and 8 <= 1 + len(body.translate(None, b" ().-")) <= 15:
                add("phone", at, at + 2 + len(body))
        elif anchor == "at":
            found = None
            start = _back(text, at, past["email"], _LOCAL)
            end = _DOMAIN_END.search(text, at + 1).start()
            if start < at and b"." in text[at + 2 : end] and text[at + 1 : at + 2] != b".":
                past["email"], found = end, (start, end)
                add("email", start, end)
            if wide:
                start, end = _back_wide(text, at, past["wide"]), _wide_domain(text, at + 1)
                if start < at and b"." in text[at + 2 : end] and text[at + 1 : at + 2] != b".":
                    past["wide"] = end
                    if (start, end) != found:
                        add("email", start, end, False)
        elif anchor == "scheme":
            start = last + 1
            mark = _LOGIN_END.search(text, start).start()
            if at >= past["login"] and start < mark and text[mark : mark + 1] == b"@":
                end = _DOMAIN_END.search(text, mark + 1).start()
                if end > mark + 1 and text[mark + 1 : mark + 2] != b".":
                    past["login"] = end
                    add("address", start, end, False)
        elif at >= past["account"] and (m := _ACCOUNT.match(text, last + 1)):
            size = IBAN_LENGTHS.get(m[1].decode().upper())
            end = size and _account_end(text, m.end(), size - 4)
            if end:
                past["account"] = end
                value = text[m.start(1) : end].replace(b" ", b"").decode().upper()
                if int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
                    add("account", m.start(1), end, False)
    return sorted(out)


def character_spans(text: bytes) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) in code points."""
    spans = byte_spans(text)
    if not spans:
        return []
    if text.isascii():
        return [(KINDS[k], a, b, base) for k, a, b, base in spans]
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(KINDS[k], int(before[a]), int(before[b]), base) for k, a, b, base in spans]


def redact(text: bytes) -> bytes:
    """The text with each stretch that spans cover replaced by the first span's kind, as ``[EMAIL]``."""
    out, at = [], 0
    for kind, start, end, _ in sorted(byte_spans(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]".encode()]
        at = max(at, end)
    return b"".join([*out, text[at:]])


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text").cast(pa.large_binary()):
        yield value.as_py() or b""


_SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find_spans(documents: DataFrame) -> DataFrame:
    """doc_id, spans: every span of a document's text, by kind as listed, then start and end."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    names = ("kind", "start", "end", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(names, s)) for s in character_spans(text)] for text in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    plain = documents.select("doc_id", "text")
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, spans {_SPANS}")


def redacted(documents: DataFrame) -> DataFrame:
    """doc_id, text: the texts without their personal data; null texts become empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redact(text).decode() for text in _texts(batch)], pa.large_string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts.cast(pa.string())], ["doc_id", "text"])

    plain = documents.select("doc_id", "text")
    return plain.mapInArrow(run, plain.schema)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
