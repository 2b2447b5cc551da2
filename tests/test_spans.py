"""Functional conflicts found in spans of time are those of all pairs."""

import random

from factloom.operators.ontology import functional_markers
from factloom.schema import graph

YEAR, MONTH = 384, 32


def ordinal(text):
    if text is None:
        return None
    y, m, d = (*map(int, text.split("-")), 1, 1)[:3]
    return y * YEAR + (m - 1) * MONTH + d - 1


def drawn(rng):
    if rng.random() < 0.15:
        return None
    y = rng.randint(1990, 1996)
    return f"{y}" if rng.random() < 0.2 else f"{y}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"


def test_short_long_open_and_turned_intervals(spark):
    rng, rows = random.Random(5), []
    for n in range(260):
        low = drawn(rng)
        high = low and f"{low[:4]}-12-28" if rng.random() < 0.6 else drawn(rng)
        rows.append({"subject": f"s{n % 4}", "relation": "P", "object": f"o{rng.randint(0, 5)}", "valid_from": low, "valid_to": high, "scope": rng.choice([None, "x", "y"])})
    rows += rows[:5]  # repeated rows
    want = set()
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            lows = [o for o in (ordinal(a["valid_from"]), ordinal(b["valid_from"])) if o is not None]
            highs = [o for o in (ordinal(a["valid_to"]), ordinal(b["valid_to"])) if o is not None]
            there = not lows or not highs or max(lows) < min(highs)
            if a["subject"] == b["subject"] and a["object"] != b["object"] and there and (a["scope"] is None or b["scope"] is None or a["scope"] == b["scope"]):
                want.add((a["subject"], i, j))
    found = functional_markers(graph(spark, rows), "P").selectExpr("subject", "inputs[0].id", "inputs[1].id").collect()
    assert len(found) == len(want)  # each pair once
    assert {tuple(r) for r in found} == want
