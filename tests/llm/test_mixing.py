from __future__ import annotations

from collections import Counter
from math import ceil, floor

import pytest

from orogena.llm.mixing import mix_sources, mixed, period, phases, whole_units


def edf(blocks, units):
    """Slot by slot: earliest deadline among released blocks of the sources that still have any."""
    left, out = {s: n for s, n in blocks.items() if n}, []
    while left:
        w, k, t = sum(units[s] for s in left), dict.fromkeys(left, 0), 0
        gone = False
        while not gone:
            ready = [(ceil((k[s] + 1) * w / units[s]), s) for s in left if floor(k[s] * w / units[s]) <= t]
            _, s = min(ready)
            out.append(s)
            k[s] += 1
            left[s] -= 1
            t += 1
            if not left[s]:
                del left[s]
                gone = True
    return out


@pytest.mark.parametrize("blocks,units", [({"a": 7, "b": 3, "c": 11}, {"a": 3, "b": 1, "c": 2}), ({"a": 1}, {"a": 4}), ({"a": 40, "b": 9, "c": 1, "d": 0}, {"a": 1, "b": 5, "c": 2, "d": 1})])
def test_phases_are_the_simulated_schedule(blocks, units):
    got = {}
    for p in phases(blocks, units):
        for s in p.units:
            for k in range(p.first[s], p.last[s]):
                j = k - p.first[s]
                got[p.start + j // p.units[s] * sum(p.units.values()) + p.slots[s][j % p.units[s]]] = s
    assert [got[i] for i in range(sum(blocks.values()))] == edf(blocks, units)


def test_deviation_is_less_than_a_block():
    units = whole_units({"a": 0.5, "b": 0.31, "c": 0.19}, 97)
    assert sum(units.values()) == 97
    slots, w = period(units), sum(units.values())
    assert sorted(x for v in slots.values() for x in v) == list(range(w))
    for s, u in units.items():
        for t in range(w + 1):
            assert abs(sum(x < t for x in slots[s]) - t * u / w) < 1


def test_every_row_gets_one_place(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = mix_sources(docs, {"src0": 3.0, "src1": 1.0}, block=4).collect()
    assert sorted(r.position for r in got) == list(range(docs.count()))
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    blocks = sorted({(r.slot, r.turn) for r in got})
    sizes = Counter(r.turn for r in got)
    average = {"src0": 3.0, "src1": 1.0, "(rest)": 2.0}
    assert [s for _, s in blocks] == edf({s: ceil(n / 4) for s, n in sizes.items()}, whole_units(average, 1_000))
    for r in got:
        assert r.release <= r.slot - r.start_slot < r.deadline


def test_odd_rows(odd, odd_rows, none, clashing):
    got = mix_sources(odd, block=2).collect()
    assert sorted(r.position for r in got) == list(range(len(odd_rows)))
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    assert mix_sources(none).count() == 0
    out = mixed(clashing, block=2)
    assert out.columns == clashing.columns and out.count() == 6
    assert mixed(odd, block=2).count() == len(odd_rows)


@pytest.mark.parametrize("weights", [dict.fromkeys("abc", 1), dict.fromkeys("abcdefg", 1.0), {"a": 0.0001, "b": 0.9999}, {"a": 0.123456789, "b": 0.3, "c": 1e-7}])
def test_no_source_is_a_block_away_from_its_exact_weight(weights):
    from fractions import Fraction

    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    n = 9_000
    p = phases(dict.fromkeys(weights, n), whole_units(weights))[0]
    w, total = sum(p.units.values()), sum(exact.values())
    assert all(Fraction(u, w) == exact[s] / total for s, u in p.units.items())
    for s in weights:
        slots = [k // p.units[s] * w + p.slots[s][k % p.units[s]] for k in range(p.last[s])]
        for k, x in enumerate(slots):
            assert -1 < k - x * exact[s] / total and k + 1 - (x + 1) * exact[s] / total < 1


def test_many_sources_keep_their_weights(spark):
    """Each of 200 weighted sources takes its own turns; the query's weights are those of the table."""
    weights = {f"s{i}": 1 + i % 3 for i in range(200)}
    docs = spark.createDataFrame([(i * 1_000 + j, f"s{i}") for i in range(200) for j in range(12 * (1 + i % 3))], "doc_id long, source string")
    got = mix_sources(docs, weights, block=2).collect()
    assert sorted(r.position for r in got) == list(range(docs.count()))
    assert {r.turn for r in got} == set(weights)
    half = Counter(r.turn for r in got if r.position < len(got) // 2)
    assert all(abs(half[s] - 6 * w) <= 2 for s, w in weights.items())


def test_weights_must_be_positive():
    with pytest.raises(ValueError):
        whole_units({"a": 0.0})
