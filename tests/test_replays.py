"""Replays give every key that a cache holds, not only the first places."""

import pytest

from quillsift.plans.catalog import _ORDER, QUERIES

TABLES = "/root/testdata/sf0.1"
REPLAYS = {
    "l02_try_add_all": {"view": "try_add"}, "l03_get_bumps_all": {"purchase": "put", "click": "get"},
    "l08_bump_all": {"purchase": "put", "signup": "bump"}, "l09_remove_all": {"purchase": "put", "error": "remove"},
}


def plain(events, operations):
    held = {}  # from the least recent key on
    for kind, key, value in events:
        operation = operations.get(kind)
        if operation == "put":
            held.pop(key, None)
            held[key] = value
        elif operation == "try_add":
            held.setdefault(key, value)
        elif operation in ("get", "bump") and key in held:
            held[key] = held.pop(key)
        elif operation == "remove":
            held.pop(key, None)
    places, out = {}, set()
    for key in reversed(held):
        place = places[key % 4] = places.get(key % 4, -1) + 1
        out.add((key % 4, key, held[key], place))
    return out


@pytest.mark.parametrize("name", sorted(REPLAYS))
def test_every_held_key(spark, name):
    events = spark.read.parquet(f"{TABLES}/events.parquet").orderBy(*_ORDER).select("event_type", "user_id", "value").collect()
    want = plain([tuple(r) for r in events], REPLAYS[name])
    found = [(r.c, r.k, r.v, r.p) for r in QUERIES[name](spark, TABLES).collect()]
    assert len(found) == len(want) and set(found) == want
    assert max(p for *_, p in found) >= 20
