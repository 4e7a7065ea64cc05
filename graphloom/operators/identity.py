"""Stable ids: random characters and a check character of the NOID extended-digit alphabet."""

from __future__ import annotations

import random
from collections.abc import Container

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published alphabet of 29 characters, and the random length.
ALPHABET = "0123456789bcdfghjkmnpqrstvwxz"
BODY = 6


def check_character(body: str) -> str:
    """The sum of the characters' values times their positions, counted from 1, modulo 29."""
    return ALPHABET[sum(i * max(ALPHABET.find(c), 0) for i, c in enumerate(body, 1)) % len(ALPHABET)]


def verify(text: str) -> bool:
    return len(text) == BODY + 1 and all(c in ALPHABET for c in text) and check_character(text[:-1]) == text[-1]


def is_valid(c: Column) -> Column:
    """``verify`` as a Column; digits and positions are array work, no Python."""
    alphabet = F.lit(ALPHABET)
    places = F.sequence(F.lit(1), F.lit(BODY))
    value = F.aggregate(places, F.lit(0), lambda acc, i: acc + i * (F.position(c.substr(i, F.lit(1)), alphabet) - 1))
    shaped = c.rlike(f"^[{ALPHABET}]{{{BODY + 1}}}$")
    return F.coalesce(F.when(shaped, F.substr(alphabet, (value % len(ALPHABET)) + 1, F.lit(1)) == c.substr(F.lit(BODY + 1), F.lit(1))).otherwise(False), F.lit(False))


def mint(taken: Container[str], seed: int | None = None) -> str:
    """A new id, drawn until it isn't taken; deterministic for a seed."""
    r = random.Random(seed)
    while True:
        body = "".join(r.choice(ALPHABET) for _ in range(BODY))
        if (found := body + check_character(body)) not in taken:
            return found
