"""Decisions that hang on one another: long chains in few jobs, equal to a walk through the requests."""

import os
import random
import tempfile

import pytest

from wardwright import session
from wardwright.functions.pointers import settle_negations
from wardwright.operators import booking, people


def walk(requests):
    """(seq, phone, email) one by one."""
    taken, let_in = set(), set()
    for seq, *values in sorted(requests):
        marks = {(k, v) for k, v in enumerate(values) if v is not None}
        if not marks & taken:
            let_in.add(seq)
            taken |= marks
    return let_in


def admitted(spark, requests):
    rows = spark.createDataFrame(requests, "request_seq long, phone string, email string")
    return {r[0] for r in people.first_come(rows, ["phone", "email"]).collect()}


def tables_written(spark, action):
    """What `action` returns, and how many tables it settles in a shared folder of its own."""
    with tempfile.TemporaryDirectory() as folder, pytest.MonkeyPatch.context() as patch:
        patch.setattr(session, "shared_dir", lambda _: folder)
        result = action()
        tables = len(os.listdir(folder))
    return result, tables


def test_negations_along_a_chain_a_fork_and_an_open_end(spark):
    nodes = [(0, True, None), *((k, None, k - 1) for k in range(1, 300)),  # a chain
             *((1000 + k, None, 17) for k in range(5)),  # many on one node
             (2000, None, None), (2001, None, 2000), (2002, None, 2001), (3000, False, 5)]  # an open end; known despite a pointer
    found = {r.n: r.known for r in settle_negations(spark.createDataFrame(nodes, "n long, known boolean, ahead long"), "n").collect()}
    assert all(found[k] == (k % 2 == 0) for k in range(300)) and all(found[1000 + k] for k in range(5))
    assert found[2000] is found[2001] is found[2002] is None and found[3000] is False


def test_ten_thousand_applicants_in_one_chain(spark):
    """Each shares the phone with the one before and the email with the one behind it."""
    n = 10_000
    requests = [(5 * k, f"p{(k + 1) // 2}", f"e{k // 2}") for k in range(n)]
    found, tables = tables_written(spark, lambda: admitted(spark, requests))
    assert found == walk(requests) and len(found) == n // 2
    assert tables <= 20


@pytest.mark.parametrize("seed", range(4))
def test_random_applicants(spark, seed):
    rng = random.Random(seed)
    n = 400
    wide = rng.choice([20, 80, 200])
    requests = [(s, rng.choice([None, *(f"p{k}" for k in range(wide))]), rng.choice([None, "", *(f"e{k}" for k in range(wide))]))
                for s in rng.sample(range(1, 1 << 40), n)]
    assert admitted(spark, requests) == walk(requests)


def test_one_email_for_all_and_repeats(spark):
    requests = [(k, f"p{k % 50}", "") for k in range(300)] + [(1000 + k, "p7", None) for k in range(3)] + [(2000 + k, None, None) for k in range(3)]
    assert admitted(spark, requests) == walk(requests)
    assert admitted(spark, []) == set()


def callers_walk(calls):
    """(seq, phone, slot, sure, registers): phones registered, with the request that did it."""
    taken, known = set(), {}
    for seq, phone, slot, sure, registers in sorted(calls):
        if slot not in taken and (sure or known.get(phone, seq) < seq):
            taken.add(slot)
            if registers:
                known.setdefault(phone, seq)
    return known


def registrations(spark, calls):
    rows = spark.createDataFrame([(s, p, 1, "2024-06-01", slot, sure, reg) for s, p, slot, sure, reg in calls],
                                 "request_seq long, phone string, doctor_id long, appointment_date string, time_slot string, sure boolean, registers boolean")
    return {r.phone: r.registered_at for r in booking._registrations(rows).collect()}


def test_a_long_chain_of_callers(spark):
    """In each slot a caller without details waits for the head of the slot before."""
    n = 3_000
    calls = [(0, "p0", "s0", True, True)]
    for k in range(1, n):
        calls += [(10 * k, f"p{k - 1}", f"s{k}", False, False), (10 * k + 1, f"p{k}", f"s{k}", True, True)]
    found, tables = tables_written(spark, lambda: registrations(spark, calls))
    assert found == callers_walk(calls) and len(found) == n // 2
    assert tables <= 24


@pytest.mark.parametrize("seed", range(4))
def test_random_callers(spark, seed):
    rng = random.Random(seed)
    on_file, calls = {"p0", "p1"}, []
    for s in rng.sample(range(1, 1 << 40), 300):
        phone, details = f"p{rng.randrange(rng.choice([6, 40]))}", rng.random() < 0.4
        calls.append((s, phone, f"s{rng.randrange(rng.choice([10, 90]))}", phone in on_file or details, phone not in on_file and details))
    assert registrations(spark, calls) == callers_walk(calls)


def test_no_callers(spark):
    assert registrations(spark, []) == {}
    assert registrations(spark, [(1, "p", "s", False, False)]) == {}
