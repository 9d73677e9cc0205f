import itertools
import random

import pytest

from loomwork.llm import conversation, rebuild, runs, subsequences
from loomwork.llm.toolnames import Catalog, folded
from tests.conftest import result, said, use

TOOLS = Catalog(["Bash", "Read", "Edit", "Grep", "Glob", "LS", "WebFetch", "mcp__harbor__open_ticket"])


@pytest.mark.parametrize("written,meant", [
    ("bash", "Bash"), (" Bash\n", "Bash"), ("Ｂａｓｈ", "Bash"), ("Bаsh", "Bash"), ("functions.functions.Read", "Read"), ("tool:Edit", "Edit"), ("`Read`", "Read"), ("<Grep>", "Grep"),
    ("Bsah", "Bash"), ("Reaad", "Read"), ("Eit", "Edit"), ("Edit#2", "Edit"), ("Glob[1]", "Glob"), ("Read()", "Read"), ("web-fetch", "WebFetch"), ("MCP__HARBOR__OPEN_TICKET", "mcp__harbor__open_ticket"),
    ("mcp--harbor--open-ticket", "mcp__harbor__open_ticket"), ("B​ash", "Bash"), ("L‍S ", "LS"), ("Teleport", "teleport"), ("", None), ("  ", None),
])
def test_spellings(written, meant):
    assert TOOLS.resolve(written) == meant


def test_folding_ends():
    assert folded("functions.`tool:Bash:0`.") == "bash"


def random_rows(seed, n=120):
    rng = random.Random(seed)
    rows, line, open_ = [], {}, []
    for row_id in range(n):
        session = rng.choice(["a", "b", "hot", "hot", "hot"])
        side = rng.choice([True, False, None])
        kind = rng.choice(["user", "assistant", " User", "ASSISTANT", "system"])
        blocks = []
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            what = rng.random()
            if what < 0.5:
                id_ = f"c{row_id}-{len(blocks)}"
                blocks.append(use(id_, rng.choice(["Bash", "bash", "Read", "Edit", None])))
                open_.append(id_)
            elif what < 0.8 and open_:
                blocks.append(result(rng.choice(open_), "out"))
            else:
                blocks.append(said(rng.choice(["hello", " \n\t", ""])))
        line[session] = line.get(session, -1) + 1
        at = f"2026-01-01T00:{line[session] // 60:02d}:{line[session] % 60:02d}Z" if rng.random() < 0.9 else None
        rows.append((row_id, session, line[session], kind, side, at, blocks if rng.random() < 0.95 else None))
    return rows + rng.sample(rows, 10)


def conversations(rows):
    out = {}
    for row_id, session, line, kind, side, at, blocks in {r[0]: r for r in rows}.values():
        if kind.strip().lower() in ("user", "assistant"):
            out.setdefault((session, "side" if side else "main"), []).append((line, row_id, kind.strip().lower(), blocks or []))
    return {k: sorted(v, key=lambda r: r[:2]) for k, v in out.items()}


@pytest.mark.parametrize("stretch", [2048, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_runs_match_brute_force(transcript, monkeypatch, seed, stretch):
    monkeypatch.setattr(conversation, "STRETCH", stretch)
    rows = random_rows(seed)
    expected = set()
    for (session, side), own in conversations(rows).items():
        calls = [(TOOLS.resolve(b["name"]) if b["name"] else ("none", b["id"]), b["id"]) for *_, blocks in own for b in blocks if b["type"] == "tool_use"]
        for tool, group in itertools.groupby(calls, key=lambda c: c[0]):
            ids = [i for _, i in group]
            if len(ids) > 1:
                expected.add((session, side, tool, ids[0], ids[-1], len(ids)))
    got = [tuple(r) for r in runs.repeated_runs(transcript(rows), TOOLS).select("session", "side", "tool", "first_id", "last_id", "n_events").collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_run_durations(transcript):
    rows = [(1, "s", 0, "assistant", False, "2026-01-01T02:00:00+02:00", [use("a", "Bash")]), (2, "s", 1, "assistant", None, "2026-01-01T00:00:05.500Z", [use("b", "bash"), use("c", "Read")])]
    got = {r.first_id: (r.last_id, r.n_events, r.seconds) for r in runs.tool_runs(transcript(rows), TOOLS).collect()}
    assert got == {"a": ("b", 2, 5.5), "c": ("c", 1, 0.0)}


def verdict(own):
    kept = []
    calls, results = [], []
    for *_, role, blocks in own:
        c = [b["id"] for b in blocks if b["type"] == "tool_use"]
        r = [b["tool_use_id"] for b in blocks if b["type"] == "tool_result"]
        if c or r or any((b.get("text") or "").strip() for b in blocks):
            kept.append((role, bool(r)))
            calls += c
            results += r
    roles = [r for r, _ in kept]
    return not ("user" in roles and "assistant" in roles and roles[-1] == "assistant" and set(calls) == set(results) and not any(a == "user" and not x and b == "user" for (a, x), (b, _) in zip(kept, kept[1:])))


@pytest.mark.parametrize("stretch", [2048, 4])
def test_verdicts_match_brute_force(transcript, monkeypatch, stretch):
    monkeypatch.setattr(conversation, "STRETCH", stretch)
    rows = [r for seed in range(3) for r in [(row[0] + 1000 * seed, f"{row[1]}{seed}", *row[2:]) for row in random_rows(seed, 40)]]
    sound = [
        (9001, "fine", 0, "user", None, None, [said("go")]), (9002, "fine", 1, "assistant", None, None, [use("x", "Bash")]), (9003, "fine", 2, "user", None, None, [result("x", "ok")]),
        (9004, "fine", 3, "user", None, None, [said("  ")]), (9005, "fine", 4, "assistant", None, None, [said("done")]),
    ]
    table = transcript(rows + sound)
    expected = {k for k, own in conversations(rows + sound).items() if verdict(own)}
    got = {(r.session, r.side) for r in rebuild.dropped(table).collect()}
    assert got == expected and ("fine", "main") not in got
    turns = [(r.position, r.row_id, r.role) for r in rebuild.conversations(table).filter("session = 'fine'").orderBy("position").collect()]
    assert turns == [(0, 9001, "user"), (1, 9002, "assistant"), (2, 9003, "user"), (3, 9005, "assistant")]


def test_kahn_orders_and_finds_cycles():
    assert rebuild.sort_replies([0, 1, 2], [1, 2, 3], [[], ["a"], []], [[], [], ["a"]]) == ([0, 1, 2], 0)
    # one line claimed twice: the earlier time first, a result after its call even so
    assert rebuild.sort_replies([0, 1, 1], [5, 9, 7], [[], ["a"], []], [[], [], []])[0] == [0, 2, 1]
    assert rebuild.sort_replies([0, 1, 1], [5, 9, 7], [[], ["a"], []], [[], [], ["a"]])[0] == [0, 1, 2]
    order, left = rebuild.sort_replies([0, 1, 2], [1, 2, 3], [[], [], ["a"]], [[], ["a"], []])
    assert order == [0, 1, 2] and left == 2


@pytest.mark.parametrize("seed", range(6))
def test_cut_sequences_hold_the_same_patterns(seed):
    import numpy as np

    rng = random.Random(seed)
    for _ in range(60):
        word = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(1, 12))]
        k = rng.choice([2, 3, 4])
        short = [word[i] for i in subsequences.equivalent(np.array(word), k)]
        patterns = lambda w: {c for n in range(1, k + 1) for c in itertools.combinations(w, n)}
        assert patterns(word) == patterns(short)


def test_frequent_patterns_match_brute_force(spark):
    rng = random.Random(5)
    sequences = [[rng.choice("abcd") for _ in range(rng.randrange(0, 9))] for _ in range(60)]
    table = spark.createDataFrame([("x", s) for s in sequences], "origin string, steps array<string>")
    held = [s for s in sequences if s]
    expected = {}
    for n in (3, 4):
        for p in itertools.product("abcd", repeat=n):
            support = sum(any(c == p for c in itertools.combinations(s, n)) for s in held)
            if support >= max(3, -(-len(held) * 20 // 100)):
                expected[" → ".join(p)] = support
    got = {r.pattern: r.support for r in subsequences.frequent(table, 0.2, 3, 3, 4, partitions=3).collect()}
    assert got == expected


def test_flow_steps():
    steps = lambda flow: subsequences.flow_steps(flow, TOOLS)
    assert steps("Read → bash (npm  test ) ->`Edit` > Bash(sed -n)") == ["Read", "Bash(npm test)", "Edit", "Bash(sed -n)"]
    assert steps("Read⇒ ⇒Bash#2  →\n<Grep>") == ["Read", "Bash", "Grep"]
    assert steps(None) == [] and steps(" → ") == []


@pytest.mark.parametrize("stretch,long,joined", [(2048, 512, 64), (4, 6, 2)])
def test_sequences_of_conversations(transcript, spark, monkeypatch, stretch, long, joined):
    monkeypatch.setattr(conversation, "STRETCH", stretch)
    monkeypatch.setattr(subsequences, "LONG", long)
    monkeypatch.setattr(subsequences, "JOINED", joined)
    monkeypatch.setattr(subsequences, "STRETCH", stretch)
    rows = [(i, "s", i, "assistant", False, None, [use(f"u{i}", "Bash" if i % 5 < 3 else "Read")]) for i in range(40)]
    flows = spark.createDataFrame([(1, "s", None, 1, None, "Edit", None), (2, "s", None, 0, None, "Read → Read", None), (2, "s", None, 0, None, "Read → Read", None), (3, None, None, 0, None, "Edit", None)], "flow_id long, session string, parent_session string, seq_no int, intent string, flow string, ingested_at timestamp")
    calls = [list(r.steps) for r in subsequences.call_sequences(transcript(rows), TOOLS).collect()]
    assert len(calls) == 1
    whole = ["Bash", "Read"] * 8
    patterns = lambda w: {c for n in range(1, 5) for c in itertools.combinations(w, n)}
    assert patterns(calls[0]) == patterns(whole)
    assert [list(r.steps) for r in subsequences.flow_sequences(flows, TOOLS).collect()] == [["Read", "Read", "Edit"]]


def test_empty_tables(transcript, spark):
    nothing = transcript([])
    flows = spark.createDataFrame([], "flow_id long, session string, seq_no int, flow string")
    assert runs.repeated_runs(nothing, TOOLS).count() == 0
    assert rebuild.dropped(nothing).count() == 0
    assert rebuild.conversations(nothing).count() == 0
    assert subsequences.frequent_patterns(nothing, flows, TOOLS).count() == 0


def test_nulls_everywhere(transcript):
    rows = [(None, None, None, None, None, None, None), (1, "s", None, "user", None, "nonsense", [use(None, None), result(None, None)]), (2, "s", None, "assistant", None, "1767225600", [use(None, "Bash"), use(None, "Bash")])]
    table = transcript(rows)
    assert [(r.tool, r.n_events, r.seconds) for r in runs.repeated_runs(table, TOOLS).collect()] == [("Bash", 2, 0.0)]
    assert [(r.session, r.reason) for r in rebuild.verdicts(rebuild.stretches(table)).collect()] == [("s", "no last reply")]  # one line without number: the row with a time first


def test_replies_in_a_circle_break_a_conversation(transcript, monkeypatch):
    from loomwork.llm import conversation

    rows = [(1, "s", -1, "user", None, None, [said("hi")]), (6, "s", 0, "assistant", None, None, [said("so")]), (2, "s", 1, "user", None, None, [result("a")]), (3, "s", 2, "assistant", None, None, [use("a", "Read")]), (4, "s", 3, "user", None, None, [result("b")]), (5, "s", 4, "assistant", None, None, [use("b", "Read"), said("end")])]
    sound = [(i, "t", n, k, None, None, b) for i, n, k, b in ((11, 0, "user", [said("hi")]), (12, 1, "assistant", [use("c", "Read")]), (13, 2, "user", [result("c")]), (14, 3, "assistant", [said("end")]))]
    for stretch in (2048, 2, 1):  # the edge from a call to its result also leads over the seams of stretches
        monkeypatch.setattr(conversation, "STRETCH", stretch)
        got = {r.session: (r.reason, r.cyclic_rows > 0) for r in rebuild.verdicts(rebuild.stretches(transcript(rows + sound))).collect()}
        assert got == {"s": ("replies in a circle", True), "t": (None, False)}
