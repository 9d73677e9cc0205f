import collections

import numpy as np
import pytest

from loomwork.llm import mixing, packing, splits

LABELS = "session string, tool_use_id string, tool string, output_chars long, group string, n int"


def uid(i):
    return f"{i:08x}-0000-4000-8000-{i:012x}"


def tid(i):
    return "toolu_01" + "aBcDeFgHiJkLmN" + f"{i:08d}"


def test_links_and_splits(spark):
    rows = [(uid(i), tid(i), "Bash", 1, "g", 1) for i in range(400)]
    rows += [(uid(i), tid(i + 1), "Read", 1, "g", 1) for i in range(0, 40)]  # a chain of 41 sessions
    rows += [(uid(500 + i), tid(900), None, None, None, None) for i in range(30)]  # a hub
    rows += [("{" + uid(600).upper() + "}", f' "{tid(901)}" ', None, None, None, None), (uid(601).replace("-", "") + ".jsonl", tid(901), None, None, None, None), ("p/" + uid(602) + "/subagents/agent-1.jsonl", "call/" + tid(901), None, None, None, None)]
    rows += [(uid(700 + i), x, None, None, None, None) for i, x in enumerate(["toolu_unknown", "n/a", "", None, "toolu_0000000000000000000000", "toolu_unknown", "toolu_", "none"])]
    rows += [(None, tid(3), None, None, None, None), (None, None, None, None, None, None), (uid(1), tid(1).lower(), None, None, None, None)] + [(uid(0), tid(0), "Bash", 1, "g", 1)]
    table = spark.createDataFrame(rows, LABELS)
    got = collections.Counter((r.session_a, r.session_b) for r in splits.linked_sessions(table).collect())
    groups = [[uid(i) for i in range(0, 41)], [uid(500 + i) for i in range(30)], [uid(600), uid(601), uid(602)]]
    assert set(got) == {(a, b) for g in groups for a in g for b in g if a < b} and max(got.values()) == 1
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), (None, 0.5)], "split_name string, target_share double")
    assigned = splits.split_rows(table, targets).collect()
    assert len(assigned) == len(rows)
    by = collections.defaultdict(set)
    for r in assigned:
        by[r.session].add(r.split_name)
    assert all(len(s) == 1 for k, s in by.items() if k)
    for g in groups[:2]:
        assert len(set.union(*(by[s] for s in g))) == 1
    assert {r.split_name for r in assigned if r.session is None and r.tool_use_id == tid(3)} == by[uid(3)]
    shares = {r.split_name: r.share for r in splits.split_shares(table, targets).collect()}
    assert abs(shares["train"] - 0.8) < 0.04 and abs(shares["test"] - 0.1) < 0.03


def test_forest_spans(spark):
    edges = [(uid(i), uid(i + 1)) for i in range(20)] + [(uid(0), uid(9)), (uid(50), uid(51))]
    rows = [(s, tid(k), None, None, None, None) for k, e in enumerate(edges) for s in e]
    picked, named = splits.forest(splits.links(spark.createDataFrame(rows, LABELS)))
    roots = {r.node: r.root for r in named.collect()}
    assert picked.distinct().count() == len(roots) - len(set(roots.values())) == 21
    assert roots[uid(20)] == uid(0) and roots[uid(51)] == uid(50)


def test_splits_of_nothing(spark):
    nothing = spark.createDataFrame([], LABELS)
    targets = spark.createDataFrame([("train", 1.0)], "split_name string, target_share double")
    assert splits.linked_sessions(nothing).count() == 0
    assert splits.split_rows(nothing, targets).count() == 0
    assert splits.split_shares(nothing, targets).collect()[0].n_rows == 0
    with pytest.raises(ValueError):
        splits.split_rows(nothing, targets.limit(0))


def test_assignment_keeps_to_the_capacity():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 512, 3000)
    to = packing.assign(sizes, 512)
    room = np.bincount(to, sizes)
    assert room.max() <= 512 and len(room) <= np.ceil(sizes.sum() / 512) * 1.03  # half of them fit with one partner at most
    sizes = np.minimum(512, rng.lognormal(5, 0.8, 4000).astype(int))
    assert len(np.bincount(packing.assign(sizes, 512))) <= np.ceil(sizes.sum() / 512) * 1.005
    assert packing.assign(np.array([], dtype=int), 8).tolist() == []
    assert packing.assign(np.array([0, 0]), 8).tolist() == [0, 0]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, "one two three " * (i % 40 + 1), ["a", "b"][i % 2], ["en", "EN ", "fr", None][i % 4]) for i in range(120)]
    rows += [(200, None, "a", "en"), (201, "", "a", "en"), (202, "word " * 5000, "c", "en"), (203, "lonely text", None, "en"), (204, "elsewhere", "d", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_packing(documents, spark):
    specs = spark.createDataFrame([(1, 64), (2, 4096), (3, 0), (4, None)], "spec_id int, capacity_tokens int")
    packed = packing.pack(documents, specs)
    rows = packed.collect()
    assert {r.spec_id for r in rows} == {1, 2}
    full, pieces = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        full[(r.spec_id, r.container_id)] += r.n_tokens
        pieces[(r.spec_id, r.doc_id)].append((r.start_token, r.n_tokens))
    assert all(n <= {1: 64, 2: 4096}[s] for (s, _), n in full.items())
    assert len(pieces) == 2 * documents.count()
    for (spec, _), own in pieces.items():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0
        assert len(own) == 1 or all(n == {1: 64, 2: 4096}[spec] for _, n in own[:-1])
    totals = {s: sum(n for (k, _), n in full.items() if k == s) for s in (1, 2)}
    assert totals[1] == totals[2]
    shares = {r.spec_id: r.unused_share for r in packing.fill(packed, specs).collect()}
    assert shares[1] < 0.1
    assert packing.pack(documents.limit(0), specs).count() == 0 and packing.pack(documents, specs.limit(0)).count() == 0


def test_pouring():
    assert mixing.pour(10, {"a": 1, "b": 1}, {"a": 2, "b": 100}) == {"a": 2, "b": 8}
    assert mixing.pour(10, {"a": 1, "b": 0}, {"a": 2, "b": 100}) == {"a": 2, "b": 0}
    # a language that runs short is made up for by its own source first
    plan = mixing.plan({("a", "en"): 10, ("a", "fr"): 90, ("b", "en"): 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 160)
    assert plan == {("a", "en"): 8, ("a", "fr"): 72, ("b", "en"): 80}
    assert sum(mixing.plan({("a", "en"): 10, ("b", "en"): 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 60).values()) == 60


def test_short_nodes_are_made_up_for_by_siblings_before_ancestors():
    leaves = {("a", "x", "en"): 100, ("a", "x", "fr"): 4, ("a", "y", "en"): 100, ("b", "z", "en"): 1000}
    plan = mixing.plan(leaves, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 200, alpha=0.0)
    # a gets 100, its domains 50 each; fr can't give 25, so its sibling en of the same domain gives 46
    assert plan == {("a", "x", "en"): 46, ("a", "x", "fr"): 4, ("a", "y", "en"): 50, ("b", "z", "en"): 100}
    plan = mixing.plan(leaves, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 340, alpha=0.0)
    # a gets 170, its domains 85 each; then a domain runs short as a whole, and the other takes on the rest
    assert plan == {("a", "x", "en"): 81, ("a", "x", "fr"): 4, ("a", "y", "en"): 85, ("b", "z", "en"): 170}
    plan = mixing.plan(leaves, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 600, alpha=0.0)
    assert plan == {("a", "x", "en"): 100, ("a", "x", "fr"): 4, ("a", "y", "en"): 100, ("b", "z", "en"): 396}
    assert mixing.plan(leaves, {"a": 0.5, "b": 0.5}, {"a": 3, "b": 1}, 600, alpha=0.0)[("a", "x", "fr")] == 12


def test_a_mix_larger_than_its_small_sources(spark):
    rows = [(i, "a" if i < 3 else "b", "p", "en", f"text number {i} of many") for i in range(40)]
    texts = spark.createDataFrame(rows, "doc_id long, source string, project string, lang string, text string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.reached(mixing.mix(texts, targets, total=1.0), targets).collect()}
    assert got["a"].max_uses == 2 and got["a"].share < 0.2 and abs(got["a"].share + got["b"].share - 1) < 1e-9
    held = mixing.mix(texts, targets).agg({"n_tokens": "sum"}).collect()[0][0]
    assert held < sum(r.used_tokens for r in got.values())
    with pytest.raises(ValueError):
        packing.pack(texts, spark.range(2000).selectExpr("id as spec_id", "id + 5 as capacity_tokens"))


def test_least_cost_deals_evenly():
    rng = np.random.default_rng(1)
    sizes = rng.integers(8, 400, 3000)
    for capacity, nearly_full in ((2048, 0), (2048, packing.NEARLY_FULL)):
        to = packing.assign(sizes, capacity, nearly_full)
        costs = np.bincount(to, sizes + sizes**2 / capacity)
        assert np.bincount(to, sizes).max() <= capacity
        if not nearly_full:
            assert costs.std() / costs.mean() < 0.02


def test_mixing(documents, spark):
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.2, 1), ("gone", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(documents, targets)
    rows = mixed.collect()
    uses = collections.Counter((r.source, r.doc_id) for r in rows)
    assert all(n <= {"a": 3, "b": 2, "c": 1}[s] for (s, _), n in uses.items())
    assert {r.source for r in rows} == {"a", "b", "c"} and all(0 < r.used_tokens <= r.n_tokens for r in rows)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len({texts[d] for _, d in uses}) == len(uses)  # equal texts are used as one
    shares = {r.source: r for r in mixing.reached(mixed, targets).collect()}
    assert all(abs(shares[s].share - t) < 0.001 for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.2))) and shares["gone"].share == 0
    assert mixing.mix(documents.limit(0), targets).count() == 0
    assert sorted(map(tuple, mixing.mix(documents, targets).collect())) == sorted(map(tuple, rows))


def test_mix_takes_texts_from_copies_with_a_target(spark):
    rows = [(1, None, "en", "one two three"), (2, "a", "en", "one two three"), (3, "none", "en", "four five six"), (4, "b", "en", "four five six"), (5, "zero", "en", "seven eight nine"), (6, "a", "en", "seven eight nine"), (7, "b", "en", "ten eleven"), (8, "a", "en", "ten eleven"), (9, None, "en", "twelve")]
    texts = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    used = {(r.doc_id, r.source) for r in mixing.mix(texts, targets, total=1000).collect()}
    assert used == {(2, "a"), (4, "b"), (6, "a"), (7, "b")}
