"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, plus-signs, digits, schemes and cue words;
local parsers expand each anchor to the left and right and validate what they find.

Kinds: email, ip, card, phone (in this order), then url, account and secret, which cues open. Spans are in code points, the
end exclusive; within a kind they don't overlap and the leftmost wins. Null text counts as empty. Repeated rows each get a
row; an empty table gets none. Texts of any length are searched whole, in time that grows with their length. Of anchors at one
place each kind looks for itself, so spans of different kinds may overlap; `redact` masks such spans as one. Columns besides
doc_id and text are kept by `redact` and ignored by `find`."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
#: Anchors: what the automaton looks for (lower case) and the parser that it wakes.
CUES = {
    **{c: "digit" for c in "0123456789"},
    "@": "at",
    "+": "plus",
    "http://": "url", "https://": "url", "ftp://": "url", "www.": "url",
    "iban": "account", "account": "account", "acct": "account", "passport": "account", "ssn": "account",
    "token": "secret", "api_key": "secret", "apikey": "secret", "api-key": "secret", "secret": "secret", "password": "secret", "passwd": "secret",
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What cues open is looked at with A-Z in lower case.
_URL = re.compile(r"(?:https?://|ftp://|www\.)[^\x09-\x0D\x20\u00a0\u3000<>\"'|]+")
_ACCOUNT = re.compile(r"(?:iban|account|acct|passport|ssn)\b[ \t]*(?:no\.?|number|id|nr\.?)?[ \t]*[:=#]?[ \t]*([a-z]{0,2}[0-9][a-z0-9-]{4,33})\b", re.A)
_SECRET = re.compile(r"(?:token|api[_-]?key|secret|password|passwd)[\"']?[ \t]*[:=][ \t]*[\"']?([a-z0-9_\-+/=.]{12,})")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def lowered(text: str) -> str:
    """A-Z in lower case, all else as it is, so places stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def anchors(automaton, low: str) -> dict:
    """Start places of each parser's anchors in a lowered text, in order."""
    found: dict = {}
    for end, (parser, length) in automaton.iter(low):
        found.setdefault(parser, []).append(end - length + 1)
    return found


def _digit_spans(text: str, starts: list, out: dict) -> None:
    ip_end = card_end = -1
    last = -2
    for at in starts:
        run_start, last = at != last + 1, at
        if run_start and at >= ip_end and (m := _IP.match(text, at)):
            ip_end = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out["ip"].append(m.span())
        if at >= card_end and (m := _CARD.match(text, at)):
            card_end = m.end()
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())


def _email_spans(text: str, ats: list, out: list) -> None:
    end = 0
    for at in ats:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()


def _cue_spans(text: str, starts: list, pattern, group: int, out: list) -> None:
    end = 0
    for at in starts:
        if at >= end and (m := pattern.match(text, at)):
            stop = m.end(group)
            if not group:
                stop = at + len(m.group().rstrip(".,;:!?)]}"))
            out.append((m.start(group), stop))
            end = stop


def spans_of(automaton, text: str) -> dict:
    """Spans by kind."""
    low = lowered(text)
    found, out = anchors(automaton, low), {k: [] for k in KINDS}
    if "at" in found:
        _email_spans(text, found["at"], out["email"])
    if "digit" in found:
        _digit_spans(text, found["digit"], out)
    end = 0
    for at in found.get("plus", ()):
        if at >= end and (m := _PHONE.match(text, at)):
            end = m.end()
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out["phone"].append(m.span())
    for parser, pattern, group in (("url", _URL, 0), ("account", _ACCOUNT, 1), ("secret", _SECRET, 1)):
        if parser in found:
            _cue_spans(low, found[parser], pattern, group, out[parser])
    return out


def build():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for cue, parser in CUES.items():
        automaton.add_word(cue, (parser, len(cue)))
    automaton.make_automaton()
    return automaton


def joined(spans: dict, kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def find(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, the number of spans of each kind (n_email to n_secret), base_sha256, and spans."""

    def run(batches):
        automaton = build()
        empty = joined({k: [] for k in KINDS})
        for b in batches:
            rows = [spans_of(automaton, t.as_py() or "") for t in b.column(1)]
            counts = [pa.array([len(r[k]) for r in rows], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(joined(r, BASE).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(r) or empty for r in rows], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(in_batches, run, schema)


def masked(text: str, spans: dict) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for a, b, kind in sorted(((a, b, k) for k in KINDS for a, b in spans[k]), key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        elif b > at:
            out.append("")
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span masked in `text` and `n_chars`, if there is one, set to the new length; all other columns, and rows
    without text, as they are."""
    names, kinds = docs.columns, docs.schema

    def run(batches):
        automaton = build()
        for b in batches:
            at = names.index("text")
            texts = [None if (t := x.as_py()) is None else masked(t, spans_of(automaton, t)) for x in b.column(at)]
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            if "n_chars" in names and pa.types.is_integer(b.column(i := names.index("n_chars")).type):
                old = b.column(i).to_pylist()
                cols[i] = pa.array([o if t is None else len(t) for t, o in zip(texts, old)], b.column(i).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.transform(in_batches, run, kinds)
