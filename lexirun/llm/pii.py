"""Personal data by anchor expansion: an Aho-Corasick pass finds anchors, local parsers expand and validate them."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds that the contract names come first, those that this method adds after them.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "account", "key")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("account", "acct", "api_key", "apikey", "iban", "password", "passport", "secret", "ssn", "token")

#: How long an international account number is, by its country.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: What well-known keys begin with, and what must follow.
KEYS = {
    "AKIA": r"[A-Z0-9]{16}", "ASIA": r"[A-Z0-9]{16}", "ghp_": r"[A-Za-z0-9]{36}", "gho_": r"[A-Za-z0-9]{36}", "ghs_": r"[A-Za-z0-9]{36}", "github_pat_": r"[A-Za-z0-9_]{22,}", "AIza": r"[A-Za-z0-9_-]{35}",
    "xoxb-": r"[A-Za-z0-9-]{10,}", "xoxp-": r"[A-Za-z0-9-]{10,}", "sk_live_": r"[A-Za-z0-9]{16,}", "rk_live_": r"[A-Za-z0-9]{16,}", "eyJ": r"[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "-----BEGIN ": r"(?:[A-Z]+ )*PRIVATE KEY-----[^-]*+-----END (?:[A-Z]+ )*PRIVATE KEY-----",
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
#: The other parts of an identifier that a cue begins.
PARTS = re.compile(r"(?:[_-][A-Za-z0-9]++)*+")
VALUE = re.compile(r"(?:\s?(?:number|no\.?|id))?\s?(?:[:=]|is)\s?[\"']?([A-Za-z0-9][A-Za-z0-9_/+.-]{5,})")
CAPITALS = re.compile(r"[A-Z]+")
DIGITS = frozenset("0123456789")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,27}")
KEY_TAILS = {k.lower(): (k, re.compile(v + r"(?![A-Za-z0-9_])")) for k, v in KEYS.items()}
WORD = DIGITS | LOCAL - frozenset("._%+-") | {"_"}
BEFORE_CUE = WORD - {"_"}


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right counts double, cross sum for two digits."""
    doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))]
    return sum(doubled) % 10 == 0


def iban_end(text: str, start: int) -> int | None:
    """Where the international account number that begins at start ends, if its length is its country's and its check digits are right."""
    size, m = IBAN_SIZES.get(text[start : start + 2]), IBAN.match(text, start)
    if not size or not m:
        return None
    end = start
    for _ in range(size):  # blanks may part the characters
        end += text[end : end + 1] == " "
        end += 1
    number = text[start:end].replace(" ", "")
    if end > m.end() or len(number) != size or text[end : end + 1].isalnum():
        return None
    return end if int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1 else None


@lru_cache(1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("at", "@"), ("plus", "+"), ("digit", sorted(DIGITS)), ("scheme", SCHEMES), ("cue", CUES), ("key", KEY_TAILS)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at or not (m := DOMAIN.match(text, at + 1)):
        return None
    return start, m.end()


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data in text, in code points, end exclusive, by kind, then start.

    The base kinds are what the leftmost non-overlapping matches of their patterns give, less those that fail
    validation. url: what follows a scheme, without closing punctuation (for mailto:, if an address follows).
    account: the value of at least six characters, a digit among them, after a cue word and : or = or "is". The cue
    may be a part of an identifier, its parts joined by _ or -. Schemes and cues are found in either case.
    """
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE_KINDS, *ADDED_KINDS)}
    free = dict.fromkeys(out, 0)  # where the next match of a kind may start: matches that failed block as well
    lowered = text.lower() if text.isascii() else CAPITALS.sub(lambda m: m[0].lower(), text)  # as long as text
    tried = 0  # the end of the identifier whose cue was last looked at
    for last, (kind, size) in _anchors().iter(lowered):
        if kind == "digit":
            if last >= free["ip"] and (last == free["ip"] or text[last - 1] not in DIGITS):
                if m := QUAD.match(text, last):
                    free["ip"] = m.end()
                    if all(len(p := part.lstrip("0") or "0") <= 3 and int(p) <= 255 for part in m[0].split(".")):
                        out["ip"].append(m.span())
            if last >= free["card"] and (m := CARD.match(text, last)):
                free["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            if (start := last - 2) >= free["account"] and text[last - 1] in UPPER and (start == 0 or text[start - 1] not in WORD) and (end := iban_end(text, start)):
                out["account"].append((start, end))
                free["account"] = end
        elif kind == "at":
            if found := _email(text, last, free["email"]):
                out["email"].append(found)
                free["email"] = found[1]
        elif kind == "plus":
            if last >= free["phone"] and (m := PHONE.match(text, last)):
                free["phone"] = m.end()
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    out["phone"].append(m.span())
        elif kind == "scheme":
            start = last + 1 - size
            if start >= free["url"] and (start == 0 or text[start - 1] not in WORD) and (m := URL.match(text, last + 1)):
                end = m.start() + len(m[0].rstrip(".,;:!?)]*#$%&"))
                if end > m.start() and (lowered[start:last] != "mailto" or "@" in m[0]):
                    out["url"].append((start, end))
                    free["url"] = end
        elif kind == "key":
            start = last + 1 - size
            spelled, tail = KEY_TAILS[lowered[start : last + 1]]
            if start >= free["key"] and (start == 0 or text[start - 1] not in WORD) and text.startswith(spelled, start) and (m := tail.match(text, last + 1)):
                out["key"].append((start, m.end()))
                free["key"] = m.end()
        elif (start := last + 1 - size) >= max(free["account"], tried) and (start == 0 or text[start - 1] not in BEFORE_CUE):
            tried = PARTS.match(lowered, last + 1).end()
            m = VALUE.match(lowered, tried)
            if m and any(c in DIGITS for c in m[1]):
                end = m.start(1) + len(m[1].rstrip("."))
                out["account"].append((m.start(1), end))
                free["account"] = end
    return [(k, *span) for k, spans in out.items() for span in spans]


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and spans, an array of (kind, start, end) as find_spans gives them.

    A null or empty text has none; texts of any length are read whole; an id may be null or come twice; other columns
    are ignored, whatever their names; an empty table gives an empty one.
    """

    def found(batches):
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py() or "")] for t in b.column(1)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return raw.mapInArrow(found, f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")
