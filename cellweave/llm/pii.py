"""Personal data by anchor expansion: an automaton finds anchors, local parsers expand and validate around them."""

from __future__ import annotations

import hashlib

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_rows

# Kinds in output order (the first four are the base kinds), anchors, cues and alphabets.
KINDS = ("email", "ip", "card", "phone", "url", "secret")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "HTTP://", "HTTPS://", "FTP://")
CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "account", "iban")
DIGITS = frozenset("0123456789")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
LOCAL = LABEL | frozenset("._%+")
DIAL = DIGITS | frozenset(" ().-")
OPAQUE = LABEL | frozenset("_+/")
STOP = frozenset(" \t\n\r\x0b\x0c\"'<>")
FIELDS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c in CUES:
        for form in (c, c.upper(), c.capitalize()):
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def _run(text: str, i: int, allowed: frozenset) -> int:
    """End of the run of allowed characters from i."""
    n = len(text)
    while i < n and text[i] in allowed:
        i += 1
    return i


def _email(text: str, at: int, floor: int):
    """Local part to the left of the at-sign, not before floor; labels joined by single dots to its right."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (stop := _run(text, end + 1, LABEL)) > end + 1:
        end, dots = stop, dots + 1
    return (start, end) if dots else None


def _numbers(text: str, i: int) -> list[tuple[int, int]]:
    """Digit runs joined by single dots, from i."""
    runs = []
    while (end := _run(text, i, DIGITS)) > i:
        runs.append((i, end))
        if end >= len(text) or text[end] != ".":
            break
        i = end + 1
    return runs


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _card(text: str, i: int):
    """Digits with at most one blank or hyphen between two of them: (end, the digits)."""
    out, n = [text[i]], len(text)
    i += 1
    while i < n:
        j = i + 1 if text[i] in " -" else i
        if j < n and text[j] in DIGITS:
            out.append(text[j])
            i = j + 1
        else:
            break
    return i, "".join(out)


def _phone(text: str, plus: int):
    """A plus and digits with dial punctuation, cut back to the last digit: (end, digit count)."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = _run(text, plus + 2, DIAL)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3 or text[end - 1] not in DIGITS:
        return None
    return end, sum(c in DIGITS for c in text[plus:end])


def _url(text: str, start: int, after: int):
    """A scheme, a host of dotted labels (user part allowed) and whatever follows up to white space or a quote."""
    end = after
    while end < len(text) and text[end] not in STOP:
        end += 1
    while end > after and text[end - 1] in ".,;:!?)":
        end -= 1
    host = text[after:end].split("/")[0].rpartition("@")[2].split(":")[0]
    return (start, end) if "." in host and all(p and set(p) <= LABEL for p in host.split(".")) else None


def _secret(text: str, after: int):
    """The value after an identifier cue: blanks, = or :, an optional quote, 16 or more opaque characters with a digit."""
    i, n = after, len(text)
    while i < n and text[i] == " ":
        i += 1
    if i >= n or text[i] not in "=:":
        return None
    i += 1
    while i < n and text[i] in " \"'":
        i += 1
    end = _run(text, i, OPAQUE)
    return (i, end) if end - i >= 16 and not DIGITS.isdisjoint(text[i:end]) else None


def find(text: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """All spans by kind, in code points, end exclusive. Within a kind they run left to right and never overlap.

    The base kinds equal a leftmost, non-overlapping search of their patterns with failing matches dropped: each
    parser keeps the end of its last match (dropped or not) and anchors before it are skipped.
    """
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)
    for last, (what, size) in anchors.iter(text):
        at = last - size + 1
        if what == "at":
            if at >= past["email"] and (m := _email(text, at, past["email"])):
                out["email"].append(m)
                past["email"] = m[1]
        elif what == "digit":
            if at >= past["card"]:
                end, digits = _card(text, at)
                past["card"] = end
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out["card"].append((at, end))
            if at >= past["ip"]:
                runs = _numbers(text, at)
                for k in range(0, len(runs) - 3, 4):
                    four = runs[k : k + 4]
                    # A part of many zeros is still small; without them four digits are too many.
                    if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in four):
                        out["ip"].append((four[0][0], four[3][1]))
                past["ip"] = runs[-1][1]
        elif what == "plus":
            if at >= past["phone"] and (p := _phone(text, at)):
                past["phone"] = p[0]
                if 9 <= p[1] <= 15:
                    out["phone"].append((at, p[0]))
        elif what == "scheme":
            if at >= past["url"] and (m := _url(text, at, last + 1)):
                out["url"].append(m)
                past["url"] = m[1]
        elif at >= past["secret"] and (m := _secret(text, last + 1)):
            out["secret"].append(m)
            past["secret"] = m[1]
    return out


def joined(found: dict, kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redact(text: str, found: dict, kinds=KINDS) -> str:
    """Each span becomes ``<KIND>``; spans that overlap become one, named by the first."""
    spans = sorted((a, b, k) for k in kinds for a, b in found[k])
    out, at, i = [], 0, 0
    while i < len(spans):
        a, b, k = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][1])
            i += 1
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def detect(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts of the base kinds, a digest of their spans and all spans, for every row.

    Null and empty texts have no spans; long texts are scanned whole in one pass; repeated rows give repeated
    results; all other columns stay (``keep`` names those to keep), but a column named like a result is replaced.
    """

    def make():
        anchors = automaton()

        def work(texts):
            cols: list[list] = [[] for _ in range(6)]
            for t in texts.to_pylist():
                f = find(t or "", anchors)
                for c, v in zip(cols, (*(len(f[k]) for k in BASE), hashlib.sha256(joined(f, BASE).encode()).hexdigest(), joined(f, KINDS))):
                    c.append(v)
            return cols

        return work

    return map_rows(docs, [text_col], FIELDS, make, keep)


def scrub(docs: DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The same rows and columns with personal data in the text replaced by its kind; a null text stays null.

    ``count_col`` names a column that is to hold the length of the new text; it stays null where it was.
    """
    names = docs.columns
    counted = count_col is not None and count_col in names

    def make():
        anchors = automaton()

        def work(texts, *counts):
            out = [t and redact(t, find(t, anchors)) for t in texts.to_pylist()]
            return [out, *([None if c is None or t is None else len(t) for t, c in zip(out, column.to_pylist())] for column in counts)]

        return work

    fields = f"`{text_col}` string" + (f", `{count_col}` {docs.schema[count_col].dataType.simpleString()}" if counted else "")
    return map_rows(docs, [text_col] + [count_col] * counted, fields, make).select(*[f"`{c}`" for c in names])
