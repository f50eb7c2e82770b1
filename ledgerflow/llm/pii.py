"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs before digits, digits beside digits or dots, schemes
and identifier cues. At each anchor a local parser expands to the left and right, checks the boundary and the value, and
yields a span. The base kinds (email, ip, card, phone) equal a leftmost
non-overlapping search with their patterns; the cues add kinds of their own (url, iban, account, secret). An iban must pass its
check digits; what follows an account's cue and isn't an iban is an account.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerflow.llm.common import by_bytes, id_text, spread

#: The base patterns of the contract, in parts as the parsers use them.
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "iban", "account", "secret")
#: Kinds that the cues add. Accounts end at the word's boundary and secrets at a space or quote, however far that is.
_URL_TAIL = re.compile(r"[A-Za-z0-9._~%:/?#\[\]@!$&'()*+,;=-]+")
_ACCOUNT = re.compile(r"\s{0,3}(?:no\.?|nr\.?|number|id)?\s{0,3}[:=#]\s{0,3}([A-Za-z]{0,4}[0-9][\w-]{4,})")
#: Two letters, two check digits and 11 to 30 letters and digits more (fixed by ISO 13616), single spaces between them.
_IBAN = re.compile(r"\s{0,3}(?:no\.?|nr\.?|number)?\s{0,3}[:=#]?\s{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9_])")
_SECRET = re.compile(r"\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{6,})")
_CLOUD_KEY = re.compile(r"[0-9A-Z]{16}")
_SCHEMES = ("http://", "https://", "ftp://")
_ACCOUNT_CUES = ("account", "acct", "iban", "passport", "ssn", "konto", "cuenta", "compte")
_SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")
_CLOUD_CUES = ("AKIA", "ASIA")
_DIGITS = "0123456789"


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    for a in _DIGITS:
        found.add_word(f"+{a}", ("phone", 2))
        for b in _DIGITS:
            found.add_word(f"{a}.{b}", ("ip", 3))
            for gap in ("", " ", "-"):
                found.add_word(f"{a}{gap}{b}", ("card", 2 + len(gap)))
    for words, kind in ((_SCHEMES, "url"), (_ACCOUNT_CUES, "account"), (_SECRET_CUES, "secret")):
        for w in words:
            for form in (w, w.upper(), w.capitalize()):
                found.add_word(form, (kind, len(w)))
    for w in _CLOUD_CUES:
        found.add_word(w, ("cloud", len(w)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def iban_holds(value: str) -> bool:
    """Whether the check digits are right: the first four characters behind the others, letters as 10 to 35, leave 1 modulo 97."""
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def iban_end(m: re.Match) -> int | None:
    """Where the iban that a match begins with ends: the longest run of its groups whose check digits are right."""
    value = m[1]
    while len(value.replace(" ", "")) >= 15:
        if iban_holds(value):
            return m.start(1) + len(value)
        if " " not in value:
            return None
        value = value[: value.rindex(" ")]
    return None


def find_spans(text: str, automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed in BASE_KINDS, then the added kinds, then by start."""
    out: dict[str, list[tuple[int, int]]] = {}
    #: Where the last candidate of a kind ended, valid or not: the next one starts there or later.
    end = dict.fromkeys((*BASE_KINDS, *ADDED_KINDS), 0)
    for last, (kind, length) in automaton.iter(text):
        at = last + 1 - length
        if kind == "email":
            start = at
            while start > end["email"] and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.setdefault(kind, []).append((start, m.end()))
                end[kind] = m.end()
        elif kind == "ip":
            start = at
            while start > end["ip"] and "0" <= text[start - 1] <= "9":
                start -= 1
            if at >= end["ip"] and (m := _IP.match(text, start)):
                end[kind] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                    out.setdefault(kind, []).append(m.span())
        elif kind == "card":
            if at >= end["card"] and (m := _CARD.match(text, at)):
                end[kind] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.setdefault(kind, []).append(m.span())
        elif kind == "phone":
            if at >= end["phone"] and (m := _PHONE.match(text, at)):
                end[kind] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.setdefault(kind, []).append(m.span())
        elif kind == "url":
            if at >= end["url"] and (m := _URL_TAIL.match(text, last + 1)):
                stop = last + 1 + len(m[0].rstrip(".,;:!?'"))
                if stop > last + 1:
                    out.setdefault(kind, []).append((at, stop))
                    end[kind] = stop
        elif kind == "cloud":
            if at >= end["secret"] and not text[at - 1 : at].isalnum() and (m := _CLOUD_KEY.match(text, last + 1)) and not text[m.end() : m.end() + 1].isalnum():
                out.setdefault("secret", []).append((at, m.end()))
                end["secret"] = m.end()
        elif kind == "account" and at >= max(end["account"], end["iban"]) and not text[at - 1 : at].isalnum() and (m := _IBAN.match(text, last + 1)) and (stop := iban_end(m)):
            out.setdefault("iban", []).append((m.start(1), stop))
            end["iban"] = end["account"] = stop
        elif at >= end[kind] and not text[at - 1 : at].isalnum() and (m := (_ACCOUNT if kind == "account" else _SECRET).match(text, last + 1)):
            out.setdefault(kind, []).append(m.span(1))
            end[kind] = m.end(1)
    return [(kind, s, e) for kind in (*BASE_KINDS, *ADDED_KINDS) for s, e in out.get(kind, ())]


def as_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, spans (array of kind, start, end; code points, end exclusive).

    Null and empty texts have none. Whole texts are searched. Repeated rows are searched row by row, other columns are
    ignored, an empty table gives an empty result.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for whole in batches:
            for batch in by_bytes(whole):
                found = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t, automaton)] for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, span)], names=["id", "spans"])

    return spread(id_text(docs, id_col, text_col)).mapInArrow(run, "id long, spans array<struct<kind:string,start:long,end:long>>")


def base_digest(spans: list[tuple[str, int, int]]) -> str:
    """SHA-256 of the base spans' text form."""
    return hashlib.sha256(as_text([s for s in spans if s[0] in BASE_KINDS]).encode()).hexdigest()
