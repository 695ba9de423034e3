"""Personal data: exact patterns on the source text, and the same patterns on a normalised text whose spans are
mapped back.

The transducers rewrite look-alike characters one for one, then disguised signs ("(at)", "at ... dot ...") and
spelled digits by edits. Each edit is kept with its place in the source, so that a span found in the normalised text
maps back to the source characters that made it. Both steps are linear in the length of the text.

Defined cases: a null or empty text has no spans. Rows are independent, so ties, repeated rows and null ids pass
through as they are; columns beyond the two that are named are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from kgaudit.llm.memory import lean
from kgaudit.llm.spans import Span, digest, join_spans

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_total long"

_DOMAIN = re.compile(r"@([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ZONE = re.compile(r"[0-9][0-9. -]*[0-9]")  # holds every ip and card match, for they are made of these signs
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain: the local run before a sign that a domain follows, back to the last match.
    It visits each character once, where a pattern would try every start of a long run."""
    last = 0
    for m in _DOMAIN.finditer(text):
        p = s = m.start()
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        if s < p:
            yield s, m.end()
            last = m.end()


def find_base(text: str) -> list[Span]:
    found: list[Span] = []
    if "@" in text:
        found += [("email", s, e) for s, e in emails(text)]
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:  # the shortest match of either kind
            continue
        for m in _IP.finditer(text, a, b):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                found.append(("ip", *m.span()))
        if b - a >= 14:
            for m in _CARD.finditer(text, a, b):
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


# Letters of other scripts that look like Latin ones.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɡ": "g", "ı": "i", "ɑ": "a", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
_HIDDEN = "­​‌‍‎‏⁠﻿"


@lru_cache(maxsize=1)
def _signs() -> tuple[dict[int, str], re.Pattern[str]]:
    """One-for-one rewriting of signs, and a pattern that finds any of them (and others). By rule: compatibility forms of one
    printable ASCII sign, and decimal digits of any script."""
    out = {ord(k): v for k, v in _LOOKALIKES.items()}
    for cp in (*range(0xA0, 0x100), *range(0x2000, 0x2100), *range(0x2460, 0x2500), *range(0xFE50, 0xFFF0), *range(0x1D400, 0x1D800)):
        n = unicodedata.normalize("NFKC", chr(cp))
        if len(n) == 1 and " " <= n <= "~" and n != chr(cp):
            out.setdefault(cp, n)
    for cp in (*range(0x600, 0x1C50), *range(0xA620, 0xABFA), *range(0x10000, 0x1FC00)):
        d = unicodedata.decimal(chr(cp), None)
        if d is not None:
            out.setdefault(cp, str(d))
    # a few ranges that hold them all: cheaper to search for than the signs one by one
    low = "".join(re.escape(chr(c)) for c in sorted(out) if c < 0x370)
    return out, re.compile(f"[{low}\u0370-\U0010ffff]")


# Last labels after which a bare "at ... dot ..." is taken for an address.
_LAST_LABELS = frozenset("com org net edu gov io co info biz dev ai app uk de fr es it nl eu us ca au jp cn in br ru ch at be se no pl me".split())
_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_AT = re.compile(rf"[ \t]{{0,3}}{_OPEN}[ \t]{{0,3}}(?:at|@)[ \t]{{0,3}}{_SHUT}[ \t]{{0,3}}|[ \t]{{1,3}}at[ \t]{{1,3}}|[ \t]{{1,3}}@[ \t]{{0,3}}|@[ \t]{{1,3}}|@", re.I | re.A)
_DOT = rf"(?:[ \t]{{0,3}}{_OPEN}[ \t]{{0,3}}(?:dot|\.)[ \t]{{0,3}}{_SHUT}[ \t]{{0,3}}|[ \t]{{1,3}}dot[ \t]{{1,3}}|\.)"
_HOST = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+", re.I | re.A)
_EACH_DOT = re.compile(_DOT, re.I | re.A)
_DOT_BEFORE = re.compile(rf"(?:[ \t]{{0,3}}{_OPEN}[ \t]{{0,3}}dot[ \t]{{0,3}}{_SHUT}[ \t]{{0,3}}|[ \t]{{1,3}}dot[ \t]{{1,3}})$", re.I | re.A)
_LABEL = re.compile(r"[A-Za-z][A-Za-z-]+", re.A)
#: Digit groups parted by dots of any form, four or more of them.
_DOTTED = re.compile(rf"(?<![0-9])[0-9]++(?:{_DOT}[0-9]++){{3,}}", re.I | re.A)
_ANY_DOT = re.compile(rf"[0-9][ \t]{{0,3}}(?:{_OPEN}[ \t]{{0,3}}(?:dot|\.)|dot)", re.I | re.A)
#: Words before "at" that prose has before a plain host: no local part of an address.
_PROSE = frozenset("us me him her them it you we i he she they is are was were be been am and or not now here there more out up look looked looking found find available hosted online live site website page visit view read see buy sold posted published located contact join order shop".split())
_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORD = "(?:" + "|".join(_WORDS) + ")"
_SPELLED = re.compile(rf"(?<![A-Za-z0-9])(?:plus[ \t-]{{1,3}}|\+[ \t]{{0,2}})?\(?(?:{_WORD}(?![A-Za-z])|[0-9])(?:[ \t().,-]{{0,3}}(?:(?:dot|point)[ \t]{{1,3}})?(?:{_WORD}(?![A-Za-z])|[0-9])){{3,}}\)?", re.I | re.A)
_DIGIT = re.compile(rf"{_WORD}|[0-9]", re.I | re.A)
_SPELLED_PART = re.compile(rf"plus|dot|point|{_WORD}|[ \t,]+", re.I | re.A)
_TWO_WORDS = re.compile(rf"{_WORD}[ \t().,-]{{1,3}}(?:(?:dot|point)[ \t]{{1,3}})?(?:{_WORD}|[0-9])|[0-9][ \t().,-]{{1,3}}{_WORD}", re.I | re.A)


_DIGIT_WORDS = frozenset(_WORDS)


def _parted(low: str) -> list[str]:
    for c in "().,-+":
        low = low.replace(c, " ")
    return low.split()


def _addressed(before: str, labels: list[str], spelled: int) -> bool:
    """Whether a bare "at" stands in an address: the host's last label is known or, after two spelled dots, a word. With
    plain dots only, the word before must not be one of prose, nor the host a web site's."""
    if spelled > 1:
        return bool(_LABEL.fullmatch(labels[-1])) and {"at", "dot"}.isdisjoint(labels)
    if labels[-1] not in _LAST_LABELS:
        return False
    return spelled > 0 or labels[0] != "www" and re.split(r"\s", before)[-1].lower() not in _PROSE


def _edits(text: str) -> list[tuple[int, int, str]]:
    """Parts of a text to be replaced: (start, end, by), ordered and apart."""
    out: list[tuple[int, int, str]] = [(i, i + 1, "") for c in _HIDDEN if c in text for i in (m.start() for m in re.finditer(c, text))]
    low = text.lower() if text.isascii() else text.casefold()
    if "dot" in low or "@" in text or re.search(rf"{_OPEN}\s*at\s*{_SHUT}|\sat[ \t]{{1,3}}[a-z0-9-]++\.[a-z0-9]", low, re.A):
        for m in _AT.finditer(text):
            p, q = m.span()
            bare = m[0].strip().lower() == "at"
            if p == 0 or text[p - 1] not in _LOCAL or not (host := _HOST.match(text, q)):
                continue
            dots = [d for d in _EACH_DOT.finditer(text, q, host.end())]
            plain = all(d[0] == "." for d in dots)
            if bare and not _addressed(text[max(0, p - 64) : p], _EACH_DOT.split(host[0].lower()), sum(d[0] != "." for d in dots)):
                continue
            if m[0] == "@" and plain or m[0] != "@" and m[0].strip() == "@" and plain and "\t" not in m[0] and m[0].count(" ") > 2:
                continue
            if m[0] != "@":
                out.append((p, q, "@"))
            out += [(d.start(), d.end(), ".") for d in dots if d[0] != "."]
            s = p
            while True:  # first dot last at ...
                while s > 0 and text[s - 1] in _LOCAL:
                    s -= 1
                if not (d := _DOT_BEFORE.search(text[max(0, s - 16) : s])):
                    break
                start = s - len(d[0])
                if start == 0 or text[start - 1] not in _LOCAL:
                    break
                out.append((start, s, "."))
                s = start
    if ("dot" in low or "." in text) and _ANY_DOT.search(text):
        for m in _DOTTED.finditer(text):
            out += [(d.start(), d.end(), ".") for d in _EACH_DOT.finditer(text, *m.span()) if d[0] != "."]
    if not _DIGIT_WORDS.isdisjoint(_parted(low)) and _TWO_WORDS.search(text):
        for m in _SPELLED.finditer(text):
            if not re.search(_WORD, m[0], re.I):
                continue
            dotted = len(re.findall(r"dot|point", m[0], re.I))
            if dotted < 3 and len(_DIGIT.findall(m[0])) < 7:
                continue
            for w in _SPELLED_PART.finditer(text, *m.span()):
                k = w[0].lower()
                if k in _WORDS:
                    out.append((*w.span(), _WORDS[k]))
                elif k == "plus":
                    out.append((*w.span(), "+"))
                elif k in ("dot", "point"):
                    out.append((*w.span(), "."))
                elif dotted or text[max(0, w.start() - 4) : w.start()].lower() == "plus" or text[w.start() - 1] == "+":
                    out.append((*w.span(), ""))
                elif w[0] != " ":
                    out.append((*w.span(), " "))
    out.sort()
    apart, last = [], 0
    for s, e, by in out:
        if s >= last:
            apart.append((s, e, by))
            last = e
    return apart


def normalise(text: str) -> tuple[str, list[tuple[int, int, int, bool]]] | None:
    """The rewritten text and its pieces (place in it, source start, source end, whether copied sign for sign);
    None if nothing is disguised."""
    signs, any_sign = _signs()
    plain = text if text.isascii() or not any_sign.search(text) else text.translate(signs)
    edits = _edits(plain)
    if not edits and plain == text:
        return None
    parts, pieces, at, done = [], [], 0, 0
    for s, e, by in [*edits, (len(plain), len(plain), "")]:
        if s > done:
            pieces.append((at, done, s, True))
            parts.append(plain[done:s])
            at += s - done
        if by:
            pieces.append((at, s, e, False))
            parts.append(by)
            at += len(by)
        done = e
    return "".join(parts), pieces


def _back(pieces: list[tuple[int, int, int, bool]], starts: list[int], a: int, b: int) -> tuple[int, int]:
    first, last = pieces[bisect_right(starts, a) - 1], pieces[bisect_right(starts, b - 1) - 1]
    return (first[1] + a - first[0] if first[3] else first[1]), (last[1] + b - last[0] if last[3] else last[2])


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that normalising adds. A found span inside a base span of its kind adds nothing."""
    if not text:
        return [], []
    base, added = find_base(text), {}
    if made := normalise(text):
        normal, pieces = made
        starts = [p[0] for p in pieces]
        # base spans of a kind are apart and in order: only the last that begins at or before a span can hold it
        of_kind: dict[str, tuple[list[int], list[int]]] = {k: ([], []) for k in KINDS}
        for k, bs, be in base:
            of_kind[k][0].append(bs), of_kind[k][1].append(be)
        for kind, a, b in find_base(normal):
            s, e = _back(pieces, starts, a, b)
            at = bisect_right(of_kind[kind][0], s) - 1
            if at < 0 or of_kind[kind][1][at] < e:
                added[kind, s, e] = None
    return base, list(added)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, the base spans' digest, all spans joined, how many were added, and how many
    there are in all: a document has personal data if this isn't 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [find(t.as_py()) for t in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *counts,
                    pa.array([digest(join_spans(base, KINDS)) for base, _ in rows], pa.string()),
                    pa.array([join_spans(base + more, KINDS) for base, more in rows], pa.string()),
                    pa.array([len(more) for _, more in rows], pa.int64()),
                    pa.array([len(base) + len(more) for base, more in rows], pa.int64()),
                ],
                names=[f.split()[0] for f in SCHEMA.split(", ")],
            )

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(lean(run), SCHEMA)
