import random

import pytest

from postline.operators import diff

STATE = "ats string, slug string, external_id string, title string, location string, locations_json string, url string, content_hash string, role_family string, is_engineering int, is_fde int, seniority string, classified_by string, region string, posted_at bigint, first_seen_at bigint, last_seen_at bigint, closed_at bigint, status string, missing_polls int, source string"
STAGED = "ats string, slug string, external_id string, title string, url string, content_hash string, posted_at bigint, discovered_at bigint, ord bigint"
FETCHED = "ats string, slug string, fetched int"


def job(key, hash_="h", status="open", missing=0, posted=None, slug="acme"):
    return ("ashby", slug, key, "t", None, None, "u", hash_, "engineering", 1, 0, None, "r4", "us", posted, 10, 10, 20 if status == "closed" else None, status, missing, "poll")


def seen(key, hash_="h", posted=None, slug="acme", ord_=0):
    return ("ashby", slug, key, "t2", "u2", hash_, posted, 77, ord_)


def poll(spark, state, fetched, staged, ts=100):
    d = diff.decided(spark.createDataFrame(state, STATE), spark.createDataFrame(fetched, FETCHED), spark.createDataFrame(staged, STAGED)).cache()
    new = {(r.slug, r.external_id): r for r in diff.next_state(d, ts).collect()}
    return new, sorted((r.id, r.type, r.slug, r.external_id) for r in diff.events(d, ts, 5).collect())


def test_new_touch_edit_close_reopen(spark):
    state = [job("same"), job("edited"), job("gone", missing=1), job("once"), job("back", status="closed", missing=2)]
    new, events = poll(spark, state, [("ashby", "acme", 9)], [seen("same"), seen("edited", "x"), seen("back", "y"), seen("fresh")])
    assert [(t, k) for _, t, _, k in events] == [("new", "fresh"), ("reopened", "back"), ("edited", "edited"), ("closed", "gone")]
    assert [i for i, *_ in events] == [6, 7, 8, 9]
    assert new["acme", "same"].title == "t" and new["acme", "edited"].title == "t2"
    assert (new["acme", "once"].status, new["acme", "once"].missing_polls) == ("open", 1)
    assert (new["acme", "back"].status, new["acme", "back"].closed_at, new["acme", "back"].first_seen_at) == ("open", None, 10)
    assert new["acme", "fresh"].posted_at == 77


def test_guard_and_neighbour(spark):
    state = [job(str(i)) for i in range(20)] + [job("a", slug="other", missing=1)]
    new, events = poll(spark, state, [("ashby", "acme", 0), ("ashby", "other", 0)], [])
    assert [(t, s) for _, t, s, _ in events] == [("closed", "other")]
    assert all(new["acme", str(i)].missing_polls == 0 for i in range(20))


def test_unpolled_boards_stay_and_first_of_key_wins(spark):
    new, events = poll(spark, [job("a")], [("ashby", "b", 2)], [seen("k", "1", slug="b", ord_=2), seen("k", "2", slug="b", ord_=1)])
    assert new["acme", "a"].missing_polls == 0 and new["b", "k"].content_hash == "2" and len(events) == 1


def test_dates_are_filled_kept_and_corrected(spark):
    state = [job("fill"), job("keep", posted=5), job("fix", posted=5)]
    new, _ = poll(spark, state, [("ashby", "acme", 3)], [seen("fill", posted=8), seen("keep"), seen("fix", "new", posted=9)])
    assert [new["acme", k].posted_at for k in ("fill", "keep", "fix")] == [8, 5, 9]


def machine(state, fetched, staged, ts, grace=2, guard=5):
    """The same rules, one posting at a time."""
    new, events = {k: dict(v) for k, v in state.items()}, []
    for board, count in fetched.items():
        before = sum(v["status"] == "open" for k, v in state.items() if k[0] == board)
        if count == 0 and before > guard:
            continue
        here = {k: v for k, v in staged.items() if k[0] == board}
        for k, h in here.items():
            old = state.get(k)
            kind = "new" if old is None else "reopened" if old["status"] == "closed" else "edited" if old["hash"] != h else None
            if kind:
                events.append((kind, k))
            new[k] = {"status": "open", "hash": h if kind else old["hash"], "missing": 0}
        for k, v in state.items():
            if k[0] == board and k not in here and v["status"] == "open":
                new[k]["missing"] += 1
                if new[k]["missing"] >= grace:
                    new[k]["status"] = "closed"
                    events.append(("closed", k))
    return new, sorted(events)


@pytest.mark.parametrize("seed", range(3))
def test_against_a_state_machine(spark, seed):
    rng = random.Random(seed)
    boards, keys = [f"b{i}" for i in range(6)], [str(i) for i in range(15)]
    state = {(b, k): {"status": rng.choice(["open", "open", "closed"]), "hash": rng.choice([None, "x", "y"]), "missing": rng.randrange(2)} for b in boards for k in keys if rng.random() < 0.6}
    fetched = {b: rng.choice([0, 3]) for b in boards if rng.random() < 0.8}
    staged = {(b, k): rng.choice(["x", "y", "z"]) for b, n in fetched.items() if n for k in keys if rng.random() < 0.5}
    rows = [job(k, v["hash"], v["status"], v["missing"], slug=b) for (b, k), v in state.items()]
    new, events = poll(spark, rows, [("ashby", b, n) for b, n in fetched.items()], [seen(k, h, slug=b) for (b, k), h in staged.items()])
    want, want_events = machine(state, fetched, staged, 100)
    assert {k: {"status": r.status, "hash": r.content_hash, "missing": r.missing_polls} for k, r in new.items()} == want
    assert sorted((t, (s, k)) for _, t, s, k in events) == want_events


def test_same_snapshot_twice_says_nothing(spark):
    state, boards, staged = spark.createDataFrame([], STATE), spark.createDataFrame([("ashby", "acme", 1)], FETCHED), spark.createDataFrame([seen("a")], STAGED)
    once = diff.next_state(diff.decided(state, boards, staged), 1)
    assert diff.events(diff.decided(once, boards, staged), 2, 0).count() == 0
