"""Edges of many questions on bit masks against a plain loop per question."""

import re

import numpy as np
import pytest

from tidemark import rules
from tidemark.operators import evidence as E, graph as K

FORM = "source string, target string, type string, strength string, evidence string, unconfirmed boolean, legacy boolean"
ASK = "question long, question_tokens array<string>, audience string, source_gate string"


def plain(edges, seeds, questions, context, clashes, n):
    """question -> (ranked edges, shown, blocked), one question at a time."""
    out = {}
    for question, words, audience, gate in questions:
        front = {node for q, node in seeds if q == question}
        hop = {x: 0 for x in front}
        for step in (1, 2):
            front = {t for s, t, *_ in edges if s in front} | {s for s, t, *_ in edges if t in front}
            for x in front:
                hop.setdefault(x, step)
        shown, blocked = [], 0
        for edge in set(edges):
            source, target, kind, strength, evidence, unsure, legacy = edge
            near = [hop[x] for x in (source, target) if x in hop]
            if not near:
                continue
            free = (audience or "elderly") in ("doctor", "clinician", "audit")
            if not free and (unsure or (legacy and gate == "exclude_legacy_pending")):
                blocked += 1
                continue
            text = set(re.findall("[a-z]{3,}", " ".join(x or "" for x in (source, target, evidence)).lower()))
            score = rules.RELATION_PRIORITY.get(kind, 1) + 2 * (min(near) == 0) + 0.2 * len(text & set(words or ()))
            score += 3 * (source in context or target in context) - 5 * ((source, target) in clashes)
            row = tuple(x or "" for x in edge[:5])
            shown.append(((-round(score, 4), strength != "high", kind == "mentions", *row), min(near), kind))
        explicit = [x for x in shown if x[2] != "mentions"]
        best = sorted(explicit or shown)[:n]
        out[question] = ([(x[0][3:], x[1], -x[0][0]) for x in best], len(shown), blocked, len(explicit))
    return out


def both(spark, edges, seeds, questions, context, clashes, n=12):
    frame = spark.createDataFrame(edges, FORM)
    asked = spark.createDataFrame(questions, ASK)
    planes = K.planes(frame, spark.createDataFrame(seeds, "question long, node string"))
    touched = E.touched_edges(
        frame, planes, asked, spark.createDataFrame([(c,) for c in context], "node string"), spark.createDataFrame(list(clashes), "source string, target string")
    )
    best = {}
    for r in E.best_edges(touched, n).orderBy("question", "position").collect():
        best.setdefault(r["question"], []).append((tuple(r[c] or "" for c in E.EDGE), r["hop"], r["score"]))
    counts = {r["question"]: (r["shown"], r["blocked"], r["explicit"]) for r in E.edge_counts(touched, asked).collect()}
    return {q: (best.get(q, []), *counts[q]) for q in counts}


def test_many_questions_hubs_gates_and_ties(spark):
    rng = np.random.default_rng(5)
    kinds = ["mentions", "mentions", "managed_by", "urgent_signal", "increases_risk_of", "unheard_of"]
    names = ["alpha", "beta", "gamma", "delta", "omega"]
    edges = []
    for i in range(400):
        source = "hub:alpha" if i % 3 == 0 else f"n:{rng.integers(60)}"
        edges.append((
            source, f"{rng.choice(names)}:{rng.integers(80)}", str(rng.choice(kinds)), str(rng.choice(["high", "low"])), f"{rng.choice(names)} note", bool(rng.random() < 0.3), bool(rng.random() < 0.3),
        ))
    edges += edges[:20]  # repeated rows count once
    edges.append(("n:1", "n:1", None, None, None, None, None))
    seeds = [(q, f"n:{rng.integers(60)}") for q in range(130) if q % 7] + [(3, "hub:alpha"), (3, "hub:alpha"), (4, "nowhere")]
    audiences, gates = [None, "elderly", "doctor", "audit"], [None, "exclude_legacy_pending", "flag_legacy_pending"]
    words = [None, [], ["alpha", "note"], ["beta", "beta", "hub"]]
    questions = [(q, words[q % 4], audiences[q // 4 % 4], gates[q % 3]) for q in range(130)]
    context, clashes = {"beta:3", "n:5"}, {edges[0][:2], edges[7][:2]}
    want = plain(edges, seeds, questions, context, clashes, 12)
    got = both(spark, edges, seeds, questions, context, clashes)
    assert set(got) == set(want)
    for q in want:
        assert got[q][1:] == want[q][1:], q
        assert [(a, b) for a, b in zip(got[q][0], want[q][0]) if a != b] == [], q
    assert any(v[2] for v in want.values()) and any(not v[0] for v in want.values())


def test_mentions_come_out_only_alone(spark):
    edges = [("a:1", "b:1", "mentions", "high", "e", False, False), ("a:1", "b:2", "managed_by", "low", "e", True, False), ("c:1", "b:3", "managed_by", "low", "e", False, False)]
    questions = [(0, [], "elderly", None), (1, [], "doctor", None), (2, [], None, None)]
    got = both(spark, edges, [(0, "a:1"), (1, "a:1"), (2, "c:1")], questions, set(), set())
    assert [[e[0][1] for e in got[q][0]] for q in range(3)] == [["b:1"], ["b:2"], ["b:3"]]
    assert [got[q][1:] for q in range(3)] == [(1, 1, 0), (2, 0, 1), (1, 0, 1)]


@pytest.mark.parametrize("empty", ["edges", "seeds"])
def test_nothing_to_show(spark, empty):
    edges = [] if empty == "edges" else [("a:1", "b:1", "mentions", "high", "e", False, False)]
    seeds = [] if empty == "seeds" else [(0, "a:1")]
    assert both(spark, edges, seeds, [(0, [], None, None)], set(), set()) == {0: ([], 0, 0, 0)}
