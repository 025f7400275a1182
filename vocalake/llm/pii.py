"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over the text: at-signs, digits, plus signs,
scheme marks and cue words. From each anchor a local parser finds the boundaries of an email, network
address, card or phone number, account number, secret or address with credentials, and validates it.
Nothing but the surroundings of anchors is looked at twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vocalake.llm.common import mapped

#: Kinds in the order in which spans of one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret", "url")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# parsers that start at a given place
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[\x20:#.]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"[\x20:#.]{0,4}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_SECRET = re.compile(r"[\x20]{0,3}[:=][\x20]{0,3}[\"']?([A-Za-z0-9_+/=-]{16,})")
_CREDENTIALS = re.compile(r"://([^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s\"'<>]*)")
_SCHEMES = ("https", "http", "ftps", "ftp", "sftp", "ssh", "postgres", "postgresql", "mysql", "mongodb", "redis", "amqp")
_CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security number"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access_key", "private_key"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(ch for ch in text if "0" <= ch <= "9")


def _iban_checks(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(ch, 36)) for ch in plain[4:] + plain[:4])) % 97 == 1


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", "@")
    a.add_word("+", "+")
    a.add_word("://", "url")
    for d in "0123456789":
        a.add_word(d, "0")
    for kind, words in _CUES.items():
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                a.add_word(form, kind)
    a.make_automaton()
    return a


_BUILT: list[ahocorasick.Automaton] = []


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans by start, then kind; code points, end exclusive.

    The base kinds match as their patterns do from left to right without overlaps within a kind;
    a match that fails its check is passed over. Null and empty texts have none.
    """
    if not text:
        return []
    if not _BUILT:
        _BUILT.append(_automaton())
    found: list[tuple[int, int, str]] = []
    until = dict.fromkeys(KINDS, 0)
    chain_until = dotted_until = 0
    for last, anchor in _BUILT[0].iter(text):
        if anchor == "0":
            if last >= dotted_until:
                m = _DOTTED.match(text, last)
                dotted_until = m.end()
                if text.find(".", last, dotted_until) >= 0:
                    at, parts = last, m.group().split(".")
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        size = sum(map(len, four)) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                            found.append((at, at + size, "ip"))
                        at += size + 1
            if last >= chain_until and (m := _CHAIN.match(text, last)):
                chain_until = m.end()
                if chain_until - last >= 14:
                    digits = _digits(m.group())
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        found.append((last, chain_until, "card"))
        elif anchor == "@":
            start = last
            while start > until["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                until["email"] = m.end()
                found.append((start, m.end(), "email"))
        elif anchor == "+":
            if last >= until["phone"] and (m := _PHONE.match(text, last)):
                until["phone"] = m.end()
                if 10 <= len(_digits(m.group())) <= 15:
                    found.append((last, m.end(), "phone"))
        elif anchor == "url":
            m = _CREDENTIALS.match(text, last - 2)
            start = last - 2
            low = max(start - 16, until["url"])
            while start > low and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            if m and text[start : last - 2].lower() in _SCHEMES:
                until["url"] = m.end()
                found.append((start, m.end(), "url"))
        else:
            m = {"iban": _IBAN, "ssn": _SSN, "secret": _SECRET}[anchor].match(text, last + 1)
            if m and m.start(1) >= until[anchor]:
                value = m.group(1)
                if anchor == "iban" and not _iban_checks(value):
                    continue
                if anchor == "secret" and not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
                    continue
                until[anchor] = m.end(1)
                found.append((m.start(1), m.end(1), anchor))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text: str = "text", redacted: bool = False) -> DataFrame:
    """docs' columns without the text, then n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans (all kinds), with `redacted` if asked for.

    Null and empty texts have no span. Rows are scanned each for itself and whole, however long: each
    parser starts at an anchor behind the end of the last match of its kind, so that work follows the
    length. Repeated rows give repeated rows; an empty table gives an empty table. Columns of docs that
    have these names must be renamed before: a ValueError says so.
    """
    names = [*(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans", *["redacted"] * redacted]
    at = docs.columns.index(text)
    others = [f for f in docs.schema.fields if f.name != text]
    if clash := {f.name.lower() for f in others} & set(names):
        raise ValueError(f"docs has columns {sorted(clash)}")
    kinds = [T.LongType()] * len(BASE) + [T.StringType()] * 2 + [T.LongType()] + [T.StringType()] * redacted
    schema = T.StructType([*others, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out: list[list] = [[] for _ in names]
            for cell in batch.column(at):
                body = cell.as_py()
                spans = find(body)
                base = [s for s in spans if s[2] in BASE]
                row = [sum(s[2] == k for s in base) for k in BASE]
                row += [hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans), len(spans)]
                if redacted:
                    row.append(redact(body, spans))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            arrow = [pa.int64()] * len(BASE) + [pa.string()] * 2 + [pa.int64()] + [pa.string()] * redacted
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(out, arrow, strict=True))], schema.names)

    return mapped(docs, batches, schema)
