from collections import Counter

import pytest

from ledgerlens.functions import shorthand
from ledgerlens.operators import simulate
from ledgerlens.operators.generate import WorkloadError
from ledgerlens.plans import catalogue
from ledgerlens.sources import batch


def names(n):
    return [f"{k:040x}" for k in range(n)]


def test_every_operation_names_what_its_signer_may_touch():
    made = simulate.Simulator(seed=3, signers=4, most_ops=5, most_alive=60)
    reports = []
    rows = simulate.run(made, names(4), 500, 2.0, lambda b: b.block % 9 != 0, 2, lambda n, s: reports.append((n, s)), 50)
    owner, expiry, gone, sent = {}, {}, set(), Counter()
    for block, signer, _, op, key, sender, btl, expires_at, receiver, payload, kind, good in rows:
        sent[op, good] += 1
        assert sender == names(4)[signer] and (payload is None) == (op not in ("create", "update")) == (kind is None)
        if op == "create":
            assert (key is None) == (not good) and 30 <= btl < 300
            if good:
                assert key not in owner
                owner[key], expiry[key] = signer, expires_at
            continue
        assert key not in gone
        if op == "expire":
            assert expiry[key] <= block
        else:
            assert owner[key] == signer
        if good and op == "extend":
            assert expires_at > expiry[key] and expires_at == block + btl
            expiry[key] = expires_at
        if op == "transfer":
            assert receiver != sender
            owner[key] = names(4).index(receiver) if good else owner[key]
        if good and op in ("delete", "expire"):
            gone.add(key)
    assert {op for op, _ in sent} == {"create", "update", "extend", "transfer", "delete", "expire"}
    status = made.status()
    assert {op: (n, c, f) for op, n, c, f in status["kinds"]} == {op: (sent[op, True] + sent[op, False], sent[op, True], sent[op, False]) for op, _, _, _ in status["kinds"]}
    assert status["open"] == 0 and status["alive"] + status["expired"] == len(owner) - len(gone) and status["alive"] <= 60 + 20
    assert [n for n, _ in reports][:3] == [0, 50, 100]
    assert rows == simulate.run(simulate.Simulator(seed=3, signers=4, most_ops=5, most_alive=60), names(4), 500, 2.0, lambda b: b.block % 9 != 0, 2)


def test_one_batch_a_signer_and_failures_give_back():
    made = simulate.Simulator(seed=1, signers=2, weights=(("create", 1),))
    assert made.idle() == 0
    made.batch(0, 10)
    assert made.idle() == 1
    with pytest.raises(WorkloadError):
        made.batch(0, 10)
    with pytest.raises(WorkloadError):
        made.confirm(0, ["a"] * 9)
    made.confirm(0, [f"k{k}" for k in range(sum(o.op == "create" for o in made.open[0].operations))])
    made.promote(10_000)
    waiting = list(made.expired)
    assert waiting and not made.alive
    first = made.batch(1, 10_000).operations[0]
    assert (first.op, first.entity_key) == ("expire", waiting[-1])
    made.fail(1)
    assert sorted(made.expired) == sorted(waiting) and made.status()["open"] == 0


def test_arguments_are_checked():
    for bad in ({"signers": 0}, {"signers": 101}, {"most_ops": 0}, {"weights": (("create", 0),)}):
        with pytest.raises(WorkloadError):
            simulate.Simulator(seed=1, **bad)
    for rate, addresses in ((0, names(10)), (1, names(3))):
        with pytest.raises(WorkloadError):
            simulate.run(simulate.Simulator(seed=1), addresses, 5, rate)
    never = simulate.Simulator(seed=1)
    rows = simulate.run(never, names(10), 3, 1.0, delay=10_000)  # receipts that never come
    assert rows and not any(r[-1] for r in rows) and never.status()["open"] == 0


def test_status_query_counts_the_operations(spark):
    rows = catalogue.QUERIES["simulated"](spark, "").groupBy("op").count().collect()
    status = catalogue.QUERIES["simulated_status"](spark, "").collect()
    assert {r.op: r["count"] for r in rows} == {r.op: r.sent for r in status} and all(r.sent == r.confirmed + r.failed for r in status)


def test_operations_made_here_are_as_from_a_file(spark):
    made = [batch.created(5, "{}", attributes=[{"name": "a", "uint": "1"}]), batch.updated("$0", size=4), batch.extended("$0", 9), batch.transferred("$0", "0xAB"), batch.deleted("$0"), batch.expired("$0")]
    rows = batch.resolved(batch.with_nonces(batch.batch_rows(spark, made), 3, "me"), 100).orderBy("position").collect()
    assert [r.op for r in rows] == ["create", "update", "extend", "transfer", "delete", "expire"] and {r.error for r in rows} == {None}
    assert len({r.entity_key for r in rows}) == 1 and (rows[0].expires_at, rows[2].expires_at, rows[3].new_owner) == (105, 109, "ab")
    assert len(rows[1].payload) == 4 and rows[1].payload != bytes(4)
    with pytest.raises(batch.BatchError):
        batch.created(5, "a", 3)
    with pytest.raises(batch.BatchError):
        batch.batch_rows(spark, [])
    many = batch.with_nonces(batch.batch_rows(spark, [batch.created(1) if k % 3 else batch.deleted("$1") for k in range(20_000)]), 7)
    got = {r.position: r.nonce for r in many.collect()}
    assert [got[k] for k in range(20_000) if k % 3] == list(range(7, 7 + 20_000 - 6667)) and got[0] is None


def test_shorthand_as_typed():
    one = shorthand.parse_attribute
    assert one("a = 1") == shorthand.Attribute("a", "uint", "1") and one(" a : str = 'x' ") == shorthand.Attribute("a", "string", "x")
    assert one("a:uint=0x10").value == "16" and one("a=" + "9" * 70).value == "9" * 70
    for bad in ("a='x''y'", "a=²", "a:uint=", "a=" + "9" * 80, "=1", "a:float=1"):
        with pytest.raises(shorthand.ShorthandError):
            one(bad)
    with pytest.raises(shorthand.ShorthandError):
        shorthand.parse_weights("create=²")
