"""Pre-tokens of byte-level vocabularies, and work done once for each distinct stretch of text."""

from __future__ import annotations

from collections.abc import Callable

import regex

#: Units kept for reuse by one worker, in two generations; longer ones are not kept.
KEPT = 600_000
LONG = 64


def splitter(pattern: str):
    """The compiled pattern; white space means Unicode's White_Space, as it does in the tokenizer libraries."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Memo(dict):
    """Results by unit. When ``most`` units are held, they become the old generation and the one before is forgotten."""

    def __init__(self, make: Callable[[str], object], most: int = KEPT):
        super().__init__()
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, unit):
        if len(unit) > LONG:
            return self.make(unit)
        value = self.old.get(unit)
        if value is None:
            value = self.make(unit)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[unit] = value
        return value


_ODD = regex.compile(r"(?:^|\p{White_Space})\x20|\x20(?:\p{White_Space}|$)")


def units(text: str) -> list[str]:
    """Stretches of text that the pre-token pattern treats alone: a space starts a new one.

    A space between two other characters than white space can only be the first character of a match, so the matches
    in the stretches are those in the text. Where spaces stand beside white space the text is one unit.
    """
    if "  " in text or _ODD.search(text):
        return [text]
    head, *tail = text.split(" ")
    return [head, *[" " + t for t in tail]]
