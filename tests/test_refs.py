import random

import pytest

from palimpsest.operators.refs import RefError, Refs


def test_fork_merge_rename_delete():
    r = Refs()
    r.create("main", "c1")
    f = r.fork("main", "feature", 10)
    assert f.log == ("c1",) and r.merge_candidates("main", "feature") == [(3, "c1")]
    r.commit("feature", "c2")
    r.merged("main", "feature", "c3")
    assert r.merge_candidates("main", "feature") == [(1, "c2"), (3, "c1")]
    r.rename("feature", "feat")
    assert (1, "c2") in r.merge_candidates("main", "feat")
    with pytest.raises(RefError):
        r.rename("feat", "main")
    at = r.delete_branch("feat", 100)
    assert at == 100
    r.fork("main", "feat", 200)
    assert r.delete_branch("feat", 100) == 101
    assert (1, "c2") not in r.merge_candidates("main", r.fork("main", "feat", 300).id.split("@")[0])
    r.delete_branch("feat", 400)
    r.undelete("feat", 500, ttl=1000)
    with pytest.raises(RefError):
        r.undelete("feat", 500, ttl=1000)


def test_snapshots_resets_and_prefixes():
    r = Refs()
    r.create("main", "deadbeef01")
    r.commit("main", "deadbeef02")
    r.snapshot("v1", "main")
    with pytest.raises(RefError):
        r.snapshot("v1", "main")
    r.reset("main", "deadbeef01")
    assert r.branch("main").log == ("deadbeef01", "deadbeef02", "deadbeef01")
    assert r.resolve("snap/v1") == "deadbeef02" and r.resolve("deadbeef02") == "deadbeef02"
    with pytest.raises(RefError):
        r.resolve("deadbeef")
    assert r.fork("snap/v1", "old", 1).log == ("deadbeef02",)
    r.delete_snapshot("v1", 5)
    r.undelete("v1", 6, 10, is_snapshot=True)
    assert r.resolve("snap/v1") == "deadbeef02"


def test_lost_race_and_publish():
    r = Refs()
    seen = r.create("main", "c1")
    r.commit("main", "c2")
    with pytest.raises(RefError):
        r.swap("main", seen, seen)
    assert r.publish("main", seen, "c3", "My_Host", 7) == "main.my-host" and r.branch("main.my-host").forked_from[2] == 7
    assert r.publish("main", seen, "c4", "My_Host", 8) == "main.my-host-2"
    assert r.publish("main", r.branch("main"), "c5", "h", 9) == "main"


def names_by_rule(rng):
    """(name, allowed): random names, built so that the rule says which part of it they break."""
    safe = "ABCxyz0189._-"
    for _ in range(60):
        body = "k" + "".join(rng.choices("ABCxyz0189_-", k=rng.randint(0, 99)))
        yield body, True
        at = rng.randint(1, len(body))
        yield (body[:at] + rng.choice("/:~^ *?[\\\u00fc\n") + body[at:])[:100], False
        yield (body[:at] + ".." + body[at:])[-90:].join(("k", "..")), False
        yield rng.choice(".-") + body[:99], False
        yield body[:1] * (101 + rng.randint(0, 9)), False
        digits = "".join(rng.choices("0123456789abcdefABCDEF", k=rng.randint(1, 20)))
        yield digits, len(digits) < 8
        yield digits + rng.choice("gz_"), True
    yield "", False
    yield "".join(rng.choices(safe[:10], k=1)), True


def test_names():
    for name, allowed in names_by_rule(random.Random(4)):
        if allowed:
            Refs().create(name, "c")
        else:
            with pytest.raises(RefError):
                Refs().create(name, "c")
