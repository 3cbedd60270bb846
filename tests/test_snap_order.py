"""Symbols that move their devices, one after the other, against the plain loop."""

import random

from planspark.operators import reconcile


def loop(devices, symbols, radius):
    held = [{"device": d, "x": x, "y": y, "sources": list(s), "flags": [], "type": t} for d, t, x, y, s in sorted(devices)]
    for sym, kind, x, y in sorted(symbols):
        near = [h for h in held if h["type"] == kind and h["x"] is not None and h["sources"] != ["symbol"] and ((h["x"] - x) ** 2 + (h["y"] - y) ** 2) ** 0.5 <= radius]
        waiting = [h for h in held if h["type"] == kind and h["x"] is None and "schedule" in h["sources"]]
        if near:
            one = min(near, key=lambda h: (((h["x"] - x) ** 2 + (h["y"] - y) ** 2) ** 0.5, [-ord(c) for c in h["device"]]))
        elif waiting:
            one = waiting[0]
            one["flags"].append("placement_inferred")
        else:
            one = {"device": f"s:{sym}", "type": kind, "sources": ["symbol"], "flags": ["no_uin"]}
            held.append(one)
        one |= {"x": x, "y": y}
        if "symbol" not in one["sources"]:
            one["sources"].append("symbol")
    return sorted((h["device"], h["x"], h["y"], h["sources"], h["flags"]) for h in held if h["x"] is not None)


def test_snapping_goes_in_the_order_of_symbols(spark):
    rng = random.Random(5)
    pages = {}
    for page in range(12):
        devices, symbols = [], []
        for d in range(14):
            at = (rng.randrange(60), rng.randrange(12)) if rng.random() < 0.6 else (None, None)
            devices.append((f"{d:03d}", rng.choice("AB"), *at, ["schedule"] if at[0] is None or rng.random() < 0.5 else ["label"]))
        for s in range(rng.choice([0, 10, 30])):
            symbols.append((s, rng.choice("ABC"), rng.randrange(60), rng.randrange(12)))
        pages[page] = (devices, symbols)
    d = spark.createDataFrame(
        [(p, i, None, t, None if x is None else float(x), None if y is None else float(y), "none", s, []) for p, (ds, _) in pages.items() for i, t, x, y, s in ds],
        "page_id long, device string, uin string, type string, x double, y double, xy_source string, sources array<string>, flags array<string>",
    )
    s = spark.createDataFrame([(p, i, t, float(x), float(y)) for p, (_, ss) in pages.items() for i, t, x, y in ss], "page_id long, sym long, type string, x double, y double")
    got = {}
    for r in reconcile.snapped(d, s, 4.0).where("x is not null").collect():
        got.setdefault(r.page_id, []).append((r.device, r.x, r.y, list(r.sources), list(r.flags)))
    assert {p: sorted(v) for p, v in got.items()} == {p: loop(*v, 4.0) for p, v in pages.items()}
    assert reconcile.snapped(d, s.limit(0), 4.0).count() == 12 * 14 and reconcile.snapped(d.limit(0), s, 4.0).count() == s.count()


def test_a_moved_device_leaves_the_reach_of_the_next(spark):
    d = spark.createDataFrame([(1, "a", None, "A", 0.0, 0.0, "label", ["label"], [])], "page_id long, device string, uin string, type string, x double, y double, xy_source string, sources array<string>, flags array<string>")
    s = spark.createDataFrame([(1, 1, "A", 3.0, 0.0), (1, 2, "A", -3.0, 0.0), (1, 3, "A", 6.0, 0.0)], "page_id long, sym long, type string, x double, y double")
    assert {(r.device, r.x) for r in reconcile.snapped(d, s, 4.0).collect()} == {("a", 6.0), ("s:2", -3.0)}
