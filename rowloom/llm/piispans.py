"""Spans of personal data in one text: exact base patterns, looser candidates, and what labelers and features say of them.

Every scan is linear in the text; the loose patterns look at a bounded window around their marks.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from zlib import crc32

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
ABSTAIN, NO, YES = range(3)
#: Their order is that of the digits of a votes number; the base pattern's is the highest.
LABELERS = ("regex", "check", "gazetteer", "near_cue", "far_cue", "boundary", "layout")
#: Hash buckets of the classifier's features, and features of a span.
BUCKETS = 2048
FEATURES = 12
BEFORE, AFTER = 48, 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_NUMBER = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_AT = re.compile(r"[(\[{] ?at ?[)\]}]| at [a-z0-9-]{1,63} dot ", re.I)
_SPOKEN = re.compile(
    r"(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{0,63}(?: ?[(\[{] ?at ?[)\]}] ?[a-z0-9-]{1,63}(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[a-z0-9-]{1,63}){1,5}"
    r"| at [a-z0-9-]{1,63}(?: dot [a-z0-9-]{1,63}){1,5})", re.I)
_LONG_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_BROKEN_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9.])")
_LOOSE = re.compile(r"(?<![0-9A-Za-z_.@+])\(?[0-9][0-9().\-/ \xa0]{5,28}[0-9](?![0-9A-Za-z_@])")
_CARDS = re.compile(r"(?<![0-9A-Za-z_@+.])(?=([0-9]{13,19}(?![0-9A-Za-z_@])|(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9A-Za-z_@])))")
_WIDE_GAP = re.compile(r"[^0-9]{3}")
_WORD = re.compile(r"[^\W\d_]+|§")

# Words beside personal data, by kind, in the languages of the documents.
NEAR_CUES = tuple(frozenset(words.split()) for words in (
    "mail email contact write kontakt schreiben correo contacto escriba courriel contacter",
    "ip host server client login address adresse anmeldung servidor dirección serveur connexion",
    "card visa mastercard amex credit debit payment karte kreditkarte zahlung tarjeta pago carte paiement",
    "phone tel call fax mobile cell telefon anruf handy rufnummer teléfono llame móvil téléphone appelez portable",
))
# Words beside numbers that name no person.
FAR_CUES = frozenset(
    "version release build isbn issn doi section chapter page order invoice serial model commit hash sha token id abschnitt "
    "kapitel seite bestellung rechnung sección capítulo página pedido factura chapitre commande facture §".split())
# Common top-level domains.
DOMAINS = frozenset(
    "com org net edu gov mil int info biz io co me tv app dev name pro de fr es uk us eu ch at it nl be pt pl se no dk fi ie "
    "ca au nz jp cn in br mx ar cl ru".split())
# Country calling codes.
CALLING = tuple(
    "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 "
    "93 94 95 98 212 213 216 218 220 221 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 880 886 966 971 972".split())


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def known_issuer(digits: str) -> bool:
    two, three, four = int(digits[:2]), int(digits[:3]), int(digits[:4])
    return (digits[0] == "4" or 51 <= two <= 55 or 2221 <= four <= 2720 or two in (34, 36, 37, 38, 62, 65)
            or 300 <= three <= 305 or 644 <= three <= 649 or four == 6011 or 3528 <= four <= 3589)


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches found from their @: the local part is the run before it, back to the last match."""
    out, end = [], 0
    for m in _HOST.finditer(text):
        start = at = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            out.append((start, end))
    return out


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, valid) of the leftmost non-overlapping matches of each kind; cards only where they have 13 to
    19 digits, as the others are neither valid nor candidates."""
    out = []
    if "@" in text:
        out += [(EMAIL, s, e, True) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        out.append((IP, m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))))
    for m in _NUMBER.finditer(text):
        if m.end() - m.start() >= 13:
            n = m.end() - m.start() - text.count(" ", *m.span()) - text.count("-", *m.span())
            if 13 <= n <= 19:
                out.append((CARD, m.start(), m.end(), n >= 16 and luhn(_NOT_DIGIT.sub("", m[0]))))
    if "+" in text:
        for m in _PHONE.finditer(text):
            out.append((PHONE, m.start(), m.end(), m.end() - m.start() < 4096 and 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15))
    return out


def loose_matches(text: str, failed: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of spans that look like personal data but are outside the base patterns.

    ``failed`` are phone matches that failed their check: where a card follows in the same run of digits, what is before
    it can still be a phone number.
    """
    out = []
    for m in _CARDS.finditer(text):
        s, e = m.span(1)
        if (not out or s >= out[-1][2]) and luhn(_NOT_DIGIT.sub("", m[1])):
            out.append((CARD, s, e))
    starts = [s for _, s, _ in out]
    for s, e in failed:
        i = bisect_left(starts, s)
        if i < len(starts) and starts[i] < e:
            value = text[s:starts[i]].rstrip(" ().-")
            if 8 <= len(_NOT_DIGIT.sub("", value)) <= 15:
                out.append((PHONE, s, s + len(value)))
    if _AT.search(text):
        out += [(EMAIL, *m.span()) for m in _SPOKEN.finditer(text)]
    if ":" in text:
        out += [(IP, *m.span()) for m in _LONG_IP.finditer(text)]
    if "[.]" in text or "(.)" in text:
        out += [(IP, *m.span()) for m in _BROKEN_IP.finditer(text) if "[" in m[0] or "(" in m[0]]
    for m in _LOOSE.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if _WIDE_GAP.search(m[0]):
            continue
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, *m.span()))
        elif 7 <= len(digits) <= 15 and len(digits) < len(m[0]):
            out.append((PHONE, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, vote of the base pattern), by kind and start; loose spans overlap no base span and not each other.

    The vote is yes for a base span, no for a match that failed its check, none for a loose span.
    """
    based = base_matches(text)
    valid = sorted((s, e) for _, s, e, ok in based if ok)
    out = [(kind, s, e, YES if ok else NO) for kind, s, e, ok in based]
    failed = {(kind, s, e) for kind, s, e, ok in based if not ok}
    at = reach = taken = 0
    for s, kind, e in sorted((s, kind, e) for kind, s, e in loose_matches(text, [(s, e) for k, s, e, ok in based if k == PHONE and not ok])):
        while at < len(valid) and valid[at][0] < e:
            reach = max(reach, valid[at][1])
            at += 1
        if reach <= s and taken <= s and (kind, s, e) not in failed:
            out.append((kind, s, e, ABSTAIN))
            taken = e
    return sorted(out)


def described(text: str, kind: int, start: int, end: int, by_pattern: int) -> tuple[int, list[int]]:
    """(votes as a number in base 3, feature buckets) of a candidate span."""
    value = text[start:min(end, start + 256)]
    before, after = text[max(0, start - BEFORE):start].lower(), text[end:end + AFTER].lower()
    words_before = _WORD.findall(before)
    near = {*words_before, *_WORD.findall(after)}
    digits = _NOT_DIGIT.sub("", value)
    groups = "-".join(str(len(g)) for g in _NOT_DIGIT.split(value) if g)
    left, right = before[-1:], after[:1]
    check = gazetteer = layout = ABSTAIN
    if kind == EMAIL:
        label = re.split(r"[^A-Za-z0-9-]+", value.rstrip(")]} "))[-1].lower()
        check = YES if label.isalpha() and 2 <= len(label) <= 24 else NO
        gazetteer = YES if label in DOMAINS else ABSTAIN
        layout = YES if len(value) <= 100 and any(c.isalpha() for c in value[:1]) else ABSTAIN
    elif kind == IP:
        parts = [p for p in _NOT_DIGIT.split(value) if p]
        if ":" not in value:
            octets = [int(p[:4]) for p in parts]
            check = YES if len(octets) == 4 and max(octets) <= 255 else NO
            gazetteer = NO if octets[0] in (0, 10, 127) or octets[0] >= 224 or octets[:2] == [192, 168] else YES
            layout = NO if right == "." and after[1:2].isdigit() or left == "." else YES
        else:
            layout = YES
    elif kind == CARD:
        check = YES if luhn(digits) else NO
        gazetteer = YES if known_issuer(digits) else NO
        layout = YES if groups in ("16", "15", "4-4-4-4", "4-6-5") else NO
    else:
        check = YES if 10 <= len(digits) <= 13 else ABSTAIN if 8 <= len(digits) <= 15 else NO
        international = value.startswith("+") or digits.startswith("00")
        gazetteer = (YES if digits.lstrip("0").startswith(CALLING) else NO) if international else ABSTAIN
        if groups in ("4-2-2", "2-2-4", "2-2-2", "1-4-4"):
            layout = NO
        elif groups.endswith(("3-3-4", "3-4", "3-4-4", "4-3-3", "2-2-2-2-2")) or "(" in value:
            layout = YES
    near_cue = YES if near & NEAR_CUES[kind] else ABSTAIN
    far_cue = NO if near & FAR_CUES else ABSTAIN
    boundary = NO if left.isalnum() or right.isalnum() or left in ("_", "@", "/", "=") or right in ("_", "@", "/") else ABSTAIN
    cast = (by_pattern, check, gazetteer, near_cue, far_cue, boundary, layout)
    votes = 0
    for vote in cast:
        votes = votes * 3 + vote
    shape = re.sub("[0-9]+", "9", re.sub("[A-Za-z]+", "a", value))[:24]
    terms = [
        f"check{check}{gazetteer}", f"layout{layout}{boundary}", f"cue{near_cue}{far_cue}", f"pattern{by_pattern}",
        f"groups{groups[:24]}", f"shape{shape}", f"length{(end - start).bit_length()}", f"digits{len(digits)}",
        f"left{'a' if left.isalpha() else left}", f"right{'a' if right.isalpha() else right}",
        f"before{words_before[-1] if words_before else ''}", "any",
    ]
    return votes, [crc32(f"{kind}{t}".encode()) % BUCKETS for t in terms]


class SpanColumns:
    """Candidates of many texts as flat columns."""

    def __init__(self) -> None:
        self.ends = array("i", [0])
        self.kind, self.start, self.end, self.votes, self.features = (array("i") for _ in range(5))
        self.base = array("b")

    def add(self, text: str) -> None:
        for kind, start, end, vote in candidates(text):
            votes, features = described(text, kind, start, end, vote)
            self.kind.append(kind)
            self.start.append(start)
            self.end.append(end)
            self.base.append(vote == YES)
            self.votes.append(votes)
            self.features.extend(features)
        self.ends.append(len(self.kind))
