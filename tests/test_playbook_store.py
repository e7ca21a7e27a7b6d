"""The store of playbooks against requests that are carried out one by one."""

import random

import pytest

from sourcelens.operators.playbook_store import REQUESTS, PlaybookStore

STEP = "request long, sequence long, trigger string, diff_score double, start_s double, end_s double, caption_text string, keyframe binary"


def slug(name):
    return name.lower().replace(" ", "-")


def plain(there, requests, n_steps):
    """there: slug -> (name, contents); contents are what a save's request numbers."""
    out = {}
    for request, op, name, new, overwrite in requests:
        name, new = (name or "").strip(), (new or "").strip()
        a, b = slug(name), slug(new)
        if not name or op == "rename" and not new:
            out[request] = "required"
        elif op == "save":
            if not n_steps.get(request):
                out[request] = "no_steps"
            elif a in there and not overwrite:
                out[request] = "exists"
            else:
                there[a], out[request] = (name, request), "saved"
        elif op == "rename" and name == new:
            out[request] = "identical"
        elif a not in there:
            out[request] = "not_found"
        elif op == "delete":
            out[request] = "deleted"
            del there[a]
        elif a == b:
            out[request] = "same_slug"
        elif b in there and not overwrite:
            out[request] = "exists"
        else:
            there[b], out[request] = (new, there.pop(a)[1]), "renamed"
    return out


def frames(spark, requests, n_steps):
    asked = spark.createDataFrame([(*r, f"https://s/{r[0]}", " ") for r in requests], REQUESTS).repartition(3)
    steps = [(r, 10 * k, "keyframe", 1.0, None, None, f"{r}-{k}", bytes([k])) for r, n in n_steps.items() for k in range(n)]
    return asked, spark.createDataFrame(steps, STEP).repartition(2)


def test_requests_in_order_over_versions(spark, tmp_path):
    rng = random.Random(9)
    names = ["Day One", "day one", "Topic A", "Topic B", "Topic C", "Other", "Last", " ", "Lone Name"]
    store, there, number, seen = PlaybookStore(spark, str(tmp_path / "store")), {}, 0, set()
    for version in range(1, 4):
        requests, n_steps = [], {}
        for _ in range(40):
            number += 1
            op = rng.choice(["save", "save", "rename", "delete"])
            new = rng.choice(names) if op == "rename" else None
            requests.append((number, op, rng.choice(names), new, rng.choice([True, False, None])))
            if op == "save":
                n_steps[number] = rng.randint(0, 5)
        number += 1
        requests.append((number, "rename", "Day One", "day one", False))
        want = plain(there, requests, n_steps)
        got = {r.request: r.status for r in store.apply(*frames(spark, requests, n_steps), max_steps=3).collect()}
        assert got == want and store.current()[0] == version
        seen |= set(want.values())
        listed = {r.slug: (r.name, r.key, r.source_url) for r in store.listed().collect()}
        assert listed == {k: (n, c, f"https://s/{c}") for k, (n, c) in there.items()}
        texts = {}
        for r in sorted(store.steps().collect(), key=lambda r: r.ordinal):
            texts.setdefault(r.slug, []).append((r.ordinal, r.caption_text.split("-")[0]))
        for k, (_, c) in there.items():
            assert texts[k] == [(i, str(c)) for i in range(1, len(texts[k]) + 1)] and len(texts[k]) <= 3
    assert {"saved", "exists", "required", "no_steps", "renamed", "identical", "not_found", "deleted", "same_slug"} <= seen


def test_read_back_overwrite_and_a_lost_race(spark, tmp_path):
    store = PlaybookStore(spark, str(tmp_path / "store"))
    asked, steps = frames(spark, [(1, "save", "My Book", None, False)], {1: 5})
    store.apply(asked, steps, max_steps=4)
    rows = store.read("my book", keyframes=2).orderBy("ordinal").collect()
    assert [(r.ordinal, r.sequence, r.keyframe) for r in rows] == [(1, 10, None), (2, 20, None), (3, 30, bytes([3])), (4, 40, bytes([4]))]
    assert store.read("none").count() == 0 and store.read("My Book").where("keyframe is null").count() == 0

    late = PlaybookStore(spark, str(tmp_path / "store"))
    late.current = lambda: (0, "none")  # began before the first version was committed
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        late.apply(*frames(spark, [(2, "delete", "My Book", None, False)], {2: 0, 3: 1}))
    assert store.read("My Book").count() == 4  # what the late one wrote is in no version
    again, more = frames(spark, [(4, "save", "MY BOOK", None, False), (5, "save", "MY BOOK", None, True)], {4: 1, 5: 2})
    assert {r.request: r.status for r in store.apply(again, more).collect()} == {4: "exists", 5: "saved"}
    assert [r.caption_text for r in store.read("my-book").orderBy("ordinal").collect()] == ["5-0", "5-1"] and store.listed().first().summary is None
