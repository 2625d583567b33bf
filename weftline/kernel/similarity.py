"""How alike two element fingerprints are."""

from __future__ import annotations

import math
from collections.abc import Sequence
from difflib import SequenceMatcher
from functools import lru_cache

#: A relocated element must be at least so alike, in per cent.
THRESHOLD = 40.0


#: Items from which on the matcher passes over frequent ones.
_LONG = 200


@lru_cache(1 << 14)
def _short(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def ratio(a: Sequence, b: Sequence) -> float:
    if len(a) < _LONG and len(b) < _LONG:
        if a == b:
            return 1.0
        if isinstance(a, str) and isinstance(b, str):
            return _short(a, b)
    return SequenceMatcher(None, a, b).ratio()


def maps_ratio(a: dict[str, str], b: dict[str, str]) -> float:
    """Half by the keys, half by the values, in their order."""
    return ratio(list(a), list(b)) / 2 + ratio(list(a.values()), list(b.values())) / 2


def score(original: dict, candidate: dict) -> float:
    """Mean of the checks for what the original has, in per cent to two decimals, halves away from zero."""
    checks = [float(original["tag"] == candidate["tag"])]
    if original["text"] is not None:
        checks.append(ratio(original["text"], candidate["text"] or ""))
    checks.append(maps_ratio(original["attributes"], candidate["attributes"]))
    checks += [ratio(original["attributes"][k], candidate["attributes"].get(k, "")) for k in ("class", "id", "href", "src") if k in original["attributes"]]
    checks.append(ratio(original["path"], candidate["path"]))
    if original["parent_name"] is not None and candidate["parent_name"] is not None:
        checks.append(ratio(original["parent_name"], candidate["parent_name"]))
        checks.append(maps_ratio(original["parent_attribs"], candidate["parent_attribs"]))
        if original["parent_text"] is not None:
            checks.append(ratio(original["parent_text"], candidate["parent_text"] or ""))
    if original["siblings"]:
        checks.append(ratio(original["siblings"], candidate["siblings"]))
    return math.floor(sum(checks) / len(checks) * 100 * 100 + 0.5) / 100


def relocate(original: dict, candidates: list[dict], threshold: float = THRESHOLD) -> list[int]:
    """Places of the candidates of the best score, all of them in a tie, if it reaches the threshold."""
    scores = [score(original, c) for c in candidates]
    best = max(scores, default=0.0)
    return [i for i, s in enumerate(scores) if s == best] if scores and best >= threshold else []
