"""Base matches of personal data: leftmost non-overlapping per kind, without retries, in linear time.

The kinds' patterns, and what makes a match fail, are fixed values of the operator's contract:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip    ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255
* card  ``[0-9]([\\x20-]?[0-9])+``, 12 to 19 digits passing Luhn
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits

A plain search for these tries long runs of letters or digits from every one of their positions. Here each match
is found from what it must contain, an @, a run of digits or a +, so every character is looked at a bounded
number of times.
"""

from __future__ import annotations

import re

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9]([\x20().0-9-]++)")


def emails(text: str):
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            last = domain.end()
        else:
            last = at + 1
        at = text.find("@", last)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def numbers(text: str):
    """Spans of kinds ip and card, from the runs of digits."""
    quad: list[tuple[int, int]] = []  # runs linked by single dots so far
    card: list[tuple[int, int]] = []  # runs linked by at most one space or hyphen

    def carded():
        if card:
            digits = sum(b - a for a, b in card)
            if 12 <= digits <= 19 and luhn("".join(text[a:b] for a, b in card)):
                yield "card", card[0][0], card[-1][1]
            card.clear()

    for run in _DIGITS.finditer(text):
        a, b = run.span()
        if quad and not (quad[-1][1] + 1 == a and text[a - 1] == "."):
            quad.clear()
        quad.append((a, b))
        if len(quad) == 4:
            if all(_small(text[x:y]) for x, y in quad):
                yield "ip", quad[0][0], b
            quad.clear()
        if card and not (card[-1][1] + 1 == a and text[a - 1] in " -"):
            yield from carded()
        card.append((a, b))
    yield from carded()


def phones(text: str):
    at = text.find("+")
    while at >= 0:
        found = _PHONE.match(text, at)
        if found:
            end = found.end()
            while end > found.start(1) and not "0" <= text[end - 1] <= "9":
                end -= 1
            if end - found.start(1) >= 2:
                if 9 <= sum("0" <= c <= "9" for c in text[at:end]) <= 15:
                    yield "phone", at, end
                at = text.find("+", end)
                continue
        at = text.find("+", at + 1)


def base_spans(text: str) -> list[Span]:
    """All base matches by start, then by kind as listed."""
    found = [*emails(text), *numbers(text), *phones(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))
