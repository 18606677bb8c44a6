"""Pieces of SQL that the oracles share; patterns have no lookaround and no back-references."""

from __future__ import annotations

import string

from linkweave.functions import vocabulary as v


def strings(values) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


def collapse(x: str, letters: str = string.ascii_lowercase) -> str:
    for c in letters:
        x = f"REGEXP_REPLACE({x}, '{c}{c}+', '{c}', 'g')"
    return x


def words(x: str) -> str:
    spaced = f"REGEXP_REPLACE({x}, '[^a-z0-9]+', ' ', 'g')"
    return f"LIST_FILTER(STRING_SPLIT({collapse(spaced)}, ' '), LAMBDA w: w <> '')"


def canonical(table: dict[str, str], tokens: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in table.items())
    return f"LIST_TRANSFORM({tokens}, LAMBDA w: CASE w {cases} ELSE w END)"


def skeleton(x: str) -> str:
    for follow in "eiy":
        x = f"REPLACE({x}, 'c{follow}', 's{follow}')"
    for a, b in v.DIGRAPHS:
        x = f"REPLACE({x}, '{a}', '{b}')"
    x = f"TRANSLATE(REPLACE({x}, 'c', 'k'), '{v.CLASS_FROM}{v.CLASS_GONE}', '{v.CLASS_TO}')"
    return collapse(x, string.ascii_lowercase + string.digits)


def hash_key(x: str, seed: int = 42) -> str:
    return f"CAST(('0x' || SUBSTR(MD5('{seed}|' || {x}), 1, 8)) AS BIGINT)"
