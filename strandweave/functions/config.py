"""Parameters that are texts: numbers with a mode, ladders of steps."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class Limit:
    """A fraction between 0 and 1, or a multiple ("1.9X")."""

    value: float
    multiple: bool

    @classmethod
    def parse(cls, text: str) -> "Limit":
        multiple = text.endswith(("X", "x"))
        value = float(text[:-1] if multiple else text)
        if value < 0 or (not multiple and value > 1):
            raise ValueError(f"{text} is neither a fraction nor a multiple")
        return cls(value, multiple)


def steps(first: str, last: str, step: str) -> list[Decimal]:
    """From first to last in exact decimal steps."""
    a, b, s = Decimal(first), Decimal(last), Decimal(step)
    if s <= 0:
        raise ValueError("a step must be positive")
    return [a + k * s for k in range(int((b - a) / s) + 1)] if b >= a else []


def automatic_bin(total: int, chromosomes: int) -> int:
    """A thirtieth of the mean chromosome, within 100 kb and 2 Mb."""
    return int(max(min(total / chromosomes / 30, 2_000_000), 100_000))
