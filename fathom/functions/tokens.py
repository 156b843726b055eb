"""The text tokenizer: runs of letters and digits of any script, ASCII letters lower-cased and no others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[^\p{IsAlphabetic}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), GAP), lambda t: t != "")


def words(text: str) -> list[str]:
    out, now = [], []
    for c in text:
        if c.isalpha() or c.isnumeric():
            now.append(c.lower() if c.isascii() else c)
        elif now:
            out.append("".join(now))
            now = []
    return out + ["".join(now)] * bool(now)
