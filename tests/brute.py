"""Brute-force rank for small fixtures, written from the documented rules
"""

import math
import re
from collections import Counter

WORD = re.compile(r"[a-z0-9]+")


def fnv(tok: str) -> int:
    h = 0xCBF29CE484222325
    for code_unit in tok.encode("ascii"):
        h = (h ^ code_unit) * 0x100000001B3 % 2**64
    return h


def simhash(text: str | None) -> int:
    """Bit i set iff more than half of the token occurrences have bit i set."""
    words = Counter(WORD.findall((text or "")[:51200].lower()))
    total = sum(words.values())
    ones = [sum(c for w, c in words.items() if fnv(w) >> i & 1) for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * ones[i] > total)


def mime(header: str | None) -> str:
    return header.split(";", 1)[0].strip().lower() if header else "unknown"


def mode_first_to_reach(values: list[int]) -> int:
    """Most frequent value; among equals, the one whose last occurrence is earliest."""
    counts = Counter(values)
    top = max(counts.values())
    last_seen = {v: i for i, v in enumerate(values)}
    return min((v for v, c in counts.items() if c == top), key=last_seen.__getitem__)


def brute_rank(records):
    """records: (id, status, content_type_header, body) in input order.
    Returns [(id, rank)] in output order: rank descending, ties in input order."""
    if not records:
        return []
    n = len(records)
    length = [len((b or "").encode("utf-8")) for *_, b in records]
    status = [s or 0 for _, s, _, _ in records]
    ctype = [mime(c) for _, _, c, _ in records]
    fp = [simhash(b) for *_, b in records]
    mean = sum(length) / n
    sigma = math.sqrt(n * sum(x * x for x in length) - sum(length) ** 2) / n or 1.0
    s_count, t_count = Counter(status), Counter(ctype)
    center = mode_first_to_reach(fp)
    ranked = []
    for i, (rid, *_rest) in enumerate(records):
        outlier = min(abs(length[i] - mean) / (sigma * 3), 1.0)
        rarity = (outlier + (1 - s_count[status[i]] / n) + (1 - t_count[ctype[i]] / n)) / 3
        distance = bin(fp[i] ^ center).count("1") / 64
        ranked.append((rid, math.floor((rarity * 0.5 + distance * 0.5) * 100 + 0.5)))
    return sorted(ranked, key=lambda r: -r[1])
