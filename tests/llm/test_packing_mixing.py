import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import mixing, packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 20))
def test_differencing_parts_every_item_once(sizes, windows):
    parts = packing.difference(sizes, windows)
    assert len(parts) == windows or not sizes
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))


def test_differencing_beats_greedy_order_and_fills():
    rng = random.Random(4)
    sizes = [min(512, max(1, int(rng.lognormvariate(5.5, 0.8)))) for _ in range(400)]
    parts = packing.pack_block(sizes, 2048)
    loads = [sum(sizes[i] for i in p) for p in parts]
    assert max(loads) <= 2048 and sum(sizes) / (len(parts) * 2048) > 0.95
    assert packing.difference([8, 7, 6, 5, 4], 2) and max(sum([8, 7, 6, 5, 4][i] for i in p) for p in packing.difference([8, 7, 6, 5, 4], 2)) <= 16
    with pytest.raises(ValueError):
        packing.pack_block([11], 10)


def test_pack_table(spark):
    rows = [(i, n, "x") for i, n in enumerate([0, None, 5, 7, 100, 30, 5, 5, 40, 40, 90, 10])] + [(None, 12, "x"), (3, 7, "x")]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long, profile string")
    profiles = spark.createDataFrame([("s", 40), ("l", 1000)], "profile string, capacity_tokens int")
    got = packing.pack_items(items, profiles).collect()
    for name, cap in (("s", 40), ("l", 1000)):
        mine = [r for r in got if r.profile == name]
        loads = {}
        for r in mine:
            loads[r.container_id] = loads.get(r.container_id, 0) + r.n_tokens
        assert max(loads.values()) <= cap and sum(loads.values()) == sum(n or 0 for _, n, _ in rows)
        parts = {}
        for r in mine:
            parts.setdefault(r.doc_id, []).append(r)
        assert len(parts[4]) == (3 if cap == 40 else 1) and len(parts[3]) == 2 and len(parts[0]) == 1 and None in parts
        assert all(len({x.part_no for x in p}) == len(p) for k, p in parts.items() if k not in (3,))
    report = {r.profile: r for r in packing.fill_report(packing.pack_items(items, profiles)).collect()}
    assert report["l"].containers == 1
    assert packing.pack_items(items.limit(0), profiles).count() == 0


def test_weights_meet_targets_or_limits():
    tokens, target, repeats = {"a": 1000, "b": 100, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1, "b": 2, "c": 4}
    size, e, w = mixing.weights(tokens, target, repeats)
    assert e == 1 and size == pytest.approx(200) and w == pytest.approx(target)
    size, e, w = mixing.weights(tokens, target, repeats, budget=800)
    assert 0 < e < 1 and all(w[s] * size <= tokens[s] * repeats[s] + 1e-6 for s in tokens) and sum(w.values()) == pytest.approx(1)
    assert mixing.weights({}, target, repeats) == (0.0, 1.0, {})
    assert set(mixing.weights({"a": 5}, target, repeats)[2]) == {"a"}


def test_temperature():
    tokens, uniform = {"a": 1000, "b": 100, "c": 10}, dict.fromkeys("abc", 1 / 3)
    natural = {s: n / 1110 for s, n in tokens.items()}
    assert mixing.tempered(natural, uniform, 0.0) == pytest.approx(natural) and mixing.tempered(natural, uniform, 1.0) == pytest.approx(uniform)
    half = mixing.tempered(natural, uniform, 0.5)  # share ** (1 / T) with T = 2
    norm = sum(x**0.5 for x in natural.values())
    assert half == pytest.approx({s: x**0.5 / norm for s, x in natural.items()})
    for aim in (0.5, 0.8, 1.0):
        e, w = mixing.flattened(tokens, aim)
        assert 0 < e < 1 and mixing.entropy(w) == pytest.approx(aim, abs=1e-9) and w["a"] > w["b"] > w["c"]
    assert mixing.flattened(tokens, 9.0)[0] == 1.0 and mixing.flattened(tokens, 0.0)[0] == 0.0 and mixing.flattened({}, 1.0) == (0.0, {})
    target, repeats = {"a": 0.2, "b": 0.3, "c": 0.5}, {"a": 1, "b": 2, "c": 4}
    last = 1.0
    for budget in (80, 100, 200, 400, 900, 1100):  # the larger the budget, the smaller the exponent; limits hold throughout
        size, e, w = mixing.weights(tokens, target, repeats, budget)
        assert e <= last and all(w[s] * size <= tokens[s] * repeats[s] * (1 + 1e-9) for s in tokens)
        last = e
    size, e, w = mixing.weights(tokens, target, repeats, spread=0.9)
    assert mixing.entropy(w) == pytest.approx(0.9) and all(w[s] * size <= tokens[s] * repeats[s] * (1 + 1e-9) for s in tokens)


def test_prefix_sums_over_groups(spark, monkeypatch):
    """The selection is the same however blocks are grouped, and is filled to the budget."""
    rows = [(i, "a" if i % 5 else "b", 10 + i % 7) for i in range(4000)]
    items = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.7, 2)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 50)
    want = sorted(map(tuple, mixing.mix_sources(items, targets).collect()))
    monkeypatch.setattr(mixing, "GROUP_BLOCKS", 3)
    assert sorted(map(tuple, mixing.mix_sources(items, targets).collect())) == want
    shares = {r.source: r.share for r in mixing.mix_report(mixing.mix_sources(items, targets), targets).collect()}
    assert shares["a"] == pytest.approx(0.3, abs=0.002)


def test_mix_table(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aaaab"), rng.randint(1, 300), "x") for i in range(6000)] + [(9000, "a", None, "x"), (9001, None, 5, "x"), (9002, "zz", 5, "x")]
    items = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, copies string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    chosen = mixing.mix_sources(items, targets)
    report = {r.source: r for r in mixing.mix_report(chosen, targets).collect()}
    assert abs(report["a"].share - 0.6) < 0.005 and report["b"].max_copies <= 3 and report["a"].max_copies <= 1 and report["none"].tokens == 0
    assert chosen.count() == chosen.select("doc_id").distinct().count() and chosen.filter("doc_id >= 9000").count() == 0
    again = mixing.mix_sources(items.repartition(7), targets)
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, again.collect()))
    assert mixing.mix_sources(items.limit(0), targets).count() == 0


def test_token_counts(spark):
    from lamina.llm.tokens import count_tokens, encoder

    df = spark.createDataFrame([("Xin chào",), (None,), ("",), ("<|endoftext|>",)], "text string")
    n = [r.n for r in df.select(count_tokens("text").alias("n")).collect()]
    assert n[0] == len(encoder().encode_ordinary("Xin chào")) and n[1] == n[2] == 0 and n[3] > 1
