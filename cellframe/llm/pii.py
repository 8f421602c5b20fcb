"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs before a digit, digits, URL schemes and words that announce an
identifier. Each anchor is expanded by a local parser of its kind over the run of characters the kind may hold, and the
parser validates what it found. No pattern is tried at places without an anchor, and no parser looks beyond its run, so
a text costs one pass plus the runs around its anchors.

Base kinds (email, ip, card, phone) follow fixed grammars: the leftmost match first, no overlaps inside a kind, failing
matches dropped without a retry. The parsers add spans of other kinds that base grammars miss: ``spelled`` (addresses
written ``name at host dot tld`` in brackets), ``login`` (user and password in a URL), ``iban`` (checked modulo 97) and
``secret`` (the value after a cue such as ``password=``, or a key with a known prefix).

Null text is empty and has no span; offsets are code points, ends exclusive."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import map_rows, sha256_hex

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("spelled", "login", "iban", "secret")
KINDS = BASE_KINDS + MORE_KINDS

#: Cues of added kinds (fixed values, in lower case).
AT_CUES = ("(at)", "[at]", "{at}")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://")
SECRET_CUES = ("password=", "passwd=", "pwd=", "api_key=", "apikey=", "api_key = ", "secret=", "token=", "access_key=", "password: ", "api_key: ")
KEY_PREFIXES = ("AKIA", "ASIA")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
_DIGIT = frozenset("0123456789")
_PHONE = frozenset(" ().-0123456789")
_CAPITAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_DOT_WORD = re.compile(r" ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?", re.I | re.A)

Span = tuple[int, int]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
        found.add_word(f"+{d}", ("phone", 2))
    found.add_word("@", ("email", 1))
    for cue in AT_CUES:
        for form in {cue, cue.upper()}:
            found.add_word(form, ("spelled", len(cue)))
    for cue in SCHEMES:
        found.add_word(cue, ("login", len(cue)))
    for cue in SECRET_CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            found.add_word(form, ("secret", len(cue)))
    for cue in KEY_PREFIXES:
        found.add_word(cue, ("key", len(cue)))
    found.make_automaton()
    return found


def run_end(text: str, at: int, kind: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in kind:
        at += 1
    return at


def run_start(text: str, at: int, kind: frozenset, least: int) -> int:
    while at > least and text[at - 1] in kind:
        at -= 1
    return at


def email_at(text: str, sign: int, least: int) -> Span | None:
    """The address around an at-sign: the whole run before it, then labels joined by single dots, two at least."""
    start = run_start(text, sign, _LOCAL, least)
    end = run_end(text, sign + 1, _LABEL)
    if start == sign or end == sign + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (more := run_end(text, end + 1, _LABEL)) > end + 1:
        end, dots = more, dots + 1
    return (start, end) if dots else None


def ips_from(text: str, at: int) -> tuple[list[Span], int]:
    """Quads of numbers in the dotted run that starts with the digit at ``at``, and the end of that run.

    A match takes four numbers joined by single dots; where fewer follow, the search goes on after the run."""
    found: list[Span] = []
    while True:
        numbers = []
        while True:
            end = run_end(text, at, _DIGIT)
            numbers.append((at, end))
            if len(numbers) < 4 and end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGIT:
                at = end + 1
                continue
            break
        if len(numbers) == 4 and all(e - s <= 3 or text[s:e].lstrip("0")[3:] == "" for s, e in numbers) and all(int(text[s:e].lstrip("0") or "0") <= 255 for s, e in numbers):
            found.append((numbers[0][0], numbers[3][1]))
        if len(numbers) == 4 and end + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGIT:
            at = end + 1  # the run goes on after a complete match
            continue
        return found, end


def digits_end(text: str, at: int) -> int:
    """End of digits joined by single spaces or hyphens."""
    n = len(text)
    while at < n:
        if text[at] in _DIGIT:
            at += 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in _DIGIT:
            at += 2
        else:
            break
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def card_in(text: str, start: int, end: int) -> bool:
    if not 16 <= end - start <= 40:
        return False
    digits = "".join(c for c in text[start:end] if c in _DIGIT)
    return 16 <= len(digits) <= 19 and luhn(digits)


def phone_at(text: str, plus: int) -> tuple[int, bool]:
    """End of the number after a plus sign (0: the grammar fails), and whether it has 8 to 15 digits."""
    end = run_end(text, plus + 2, _PHONE)
    while end > plus + 2 and text[end - 1] not in _DIGIT:
        end -= 1
    if end < plus + 4:
        return 0, False
    return end, 8 <= sum(c in _DIGIT for c in text[plus:end]) <= 15


def spelled_at(text: str, start: int, end: int) -> Span | None:
    """name (at) host (dot) tld around a bracketed cue."""
    left = start - 1 if start and text[start - 1] == " " else start
    begin = run_start(text, left, _LOCAL, 0)
    at = end + 1 if text[end : end + 1] == " " else end
    stop, labels = run_end(text, at, _LABEL), 0
    if begin == left or stop == at:
        return None
    while (m := _DOT_WORD.match(text, stop)) and (more := run_end(text, m.end(), _LABEL)) > m.end():
        if m[0].strip() == "." and " " in m[0]:
            break
        stop, labels = more, labels + 1
    return (begin, stop) if labels else None


def login_at(text: str, end: int) -> Span | None:
    """user:password before the at-sign of a URL's authority."""
    stop = end
    while stop < len(text) and text[stop] not in " \t\r\n/?#<>\"'":
        stop += 1
    sign = text.rfind("@", end, stop)
    colon = text.find(":", end, sign) if sign > 0 else -1
    return (end, sign) if end < colon < sign - 1 else None


def iban_before(text: str, digit: int) -> Span | None:
    """An account number whose two check digits start at ``digit``: two letters before, 15 to 34 signs, remainder 1."""
    start = digit - 2
    if start < 0 or not (text[start:digit].isascii() and text[start:digit].isupper() and text[start:digit].isalpha()) or not text[digit + 1 : digit + 2].isdigit():
        return None
    if start and (text[start - 1].isalnum()):
        return None
    end, plain = digit + 2, text[start : digit + 2]
    while end < len(text) and len(plain) < 35:
        step = end + (text[end] == " ")
        if step >= len(text) or text[step] not in _CAPITAL:
            break
        plain, end = plain + text[step], step + 1
    if not 15 <= len(plain) <= 34 or sum(c in _DIGIT for c in plain) < 10:
        return None
    return (start, end) if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else None


def secret_after(text: str, end: int) -> tuple[Span | None, int]:
    """The value after a cue, and the end of the run of its signs. Where a run gives nothing, it is too short or has no
    digit, so no later cue inside it can give more."""
    start = end + (text[end : end + 1] in ("'", '"'))
    stop = start
    while stop < len(text) and (text[stop].isalnum() or text[stop] in "_-+/.=!$%&*"):
        stop += 1
    run = stop
    while stop > start and text[stop - 1] in ".!=":
        stop -= 1
    value = text[start:stop]
    return (start, stop) if len(value) >= 6 and any(c in _DIGIT for c in value) else None, run


class Finder:
    def __init__(self):
        self.anchors = automaton()

    def spans(self, text: str) -> dict[str, list[Span]]:
        found: dict[str, list[Span]] = {k: [] for k in KINDS}
        done = dict.fromkeys((*KINDS, "digit"), 0)
        read = 0  # up to here a run after a cue held no value
        for last, (kind, size) in self.anchors.iter(text):
            at = last - size + 1
            if kind == "digit":
                if at >= done["ip"]:
                    spans, done["ip"] = ips_from(text, at)
                    found["ip"] += spans
                if at >= done["card"]:
                    done["card"] = end = digits_end(text, at)
                    if card_in(text, at, end):
                        found["card"].append((at, end))
                if at >= done["iban"] and at >= 2 and (span := iban_before(text, at)):
                    done["iban"] = span[1]
                    found["iban"].append(span)
            elif kind == "email":
                if span := email_at(text, at, done["email"]):
                    done["email"] = span[1]
                    found["email"].append(span)
            elif kind == "phone":
                if at >= done["phone"]:
                    end, fits = phone_at(text, at)
                    done["phone"] = end
                    if fits:
                        found["phone"].append((at, end))
            else:
                name = "secret" if kind == "key" else kind
                if at < done[name]:
                    continue
                if kind == "spelled":
                    span = spelled_at(text, at, last + 1)
                elif kind == "login":
                    span = login_at(text, last + 1)
                elif kind == "secret":
                    if last + 1 < read:
                        continue
                    span, run = secret_after(text, last + 1)
                    read = 0 if span else run
                else:
                    clear = at == 0 or not text[at - 1].isalnum()
                    end = at + run_end(text[at : at + 21], 0, _CAPITAL) if clear else at
                    span = (at, end) if end - at == 20 else None
                if span and span[0] >= done[name]:
                    done[name] = span[1]
                    found[name].append(span)
        return found


def joined(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def _finder() -> Finder:
    global _FINDER
    if _FINDER is None:
        _FINDER = Finder()
    return _FINDER


_FINDER: Finder | None = None


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, counts of base kinds, digest of base spans, all spans as text."""

    def start():
        finder = _finder()

        def row(doc_id, text):
            found = finder.spans(text or "")
            return [(doc_id, *(len(found[k]) for k in BASE_KINDS), sha256_hex(joined(found, BASE_KINDS).encode()), joined(found, KINDS))]

        return row

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_rows(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), schema, start)


def masked(text: str, found: dict[str, list[Span]]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the one that starts first
    (longest first among equals) names the whole."""
    spans = sorted(((s, -e, k) for k in KINDS for s, e in found[k]))
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
            at = -e
        else:
            at = max(at, -e)
    return "".join(out) + text[at:] if out else text


def mask(texts: Column) -> Column:
    """The column with personal data masked; null stays null."""
    @F.arrow_udf("string")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = _finder()
        for values in batches:
            yield pa.array([None if t is None else masked(t, finder.spans(t)) for t in values.to_pylist()], pa.string())

    return apply(texts)
