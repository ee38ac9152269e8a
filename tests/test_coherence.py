import hashlib
import random
from datetime import datetime, timedelta

from storyloom.operators import coherence as C
from storyloom.operators import graph as G

T0 = datetime(2024, 1, 1)
PROVEN = ("basketball", "football", "tennis")
MEMBERS = "component string, article_id string, published_at timestamp, source string, event_type string, sport string"
EDGES = "a_id string, b_id string, intra boolean"


def brute(rows, edges, most=6, hours=72):
    """One greedy pass per component in plain Python: {component: ids}."""
    own = {r[1]: r for r in rows}
    near, twice = {}, {frozenset(e[:2]) for e in edges if e[2]}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def fits(ids):
        ms = [own[i] for i in ids]
        pairs = [(x, y) for i, x in enumerate(ms) for y in ms[i + 1 :]]
        return (
            len({m[4] for m in ms}) == 1
            and all(x[3] != y[3] or frozenset((x[1], y[1])) in twice for x, y in pairs)
            and not any(x[5] in PROVEN and y[5] in PROVEN and x[5] != y[5] for x, y in pairs)
            and (max(m[2] for m in ms) - min(m[2] for m in ms)).total_seconds() <= hours * 3600
        )

    out = {}
    for comp in {r[0] for r in rows}:
        inside = [e for e in edges if own[e[0]][0] == comp and e[0] != e[1]]
        if not inside:
            continue
        start = min(inside, key=lambda e: (min(own[e[0]][2], own[e[1]][2]), sorted(e[:2])))
        story = list(start[:2])
        if not fits(story):
            continue
        for x in sorted((r for r in rows if r[0] == comp and r[1] not in story), key=lambda r: (r[2], r[1])):
            first = min(story, key=lambda i: (own[i][2], i))
            touch = near.get(x[1], set()) & set(story)
            if len(story) < most and (first in touch or len(touch) >= 2) and fits([*story, x[1]]):
                story.append(x[1])
        out[comp] = sorted(story)
    return out


def stories(spark, rows, edges):
    found = C.coherent(spark.createDataFrame(rows, MEMBERS), spark.createDataFrame(edges, EDGES)).collect()
    out = {}
    for r in found:
        out.setdefault(r.component, []).append(r.article_id)
    first = {c: min((r for r in rows if r[1] in ids), key=lambda r: (r[2], r[1]))[1] for c, ids in out.items()}
    assert all(r.story == first[r.component] for r in found)
    return {c: sorted(ids) for c, ids in out.items()}


def test_equals_the_sequential_pass_on_random_graphs(spark):
    rng = random.Random(11)
    for n, density in ((120, 2), (120, 6), (60, 12)):
        rows = [("", f"m{i:03}", T0 + timedelta(hours=rng.choice((0, 1, 1, 30, 60, 80))), rng.choice("abcdefgh"), rng.choice(("rumor", "rumor", "rumor", "injury")), rng.choice((*PROVEN[:2], "unknown", "unknown"))) for i in range(n)]
        edges = list({tuple(sorted(rng.sample([f"m{i:03}" for i in range(k, min(n, k + 15))], 2))) for k in range(0, n, 15) for _ in range(density * 6)})
        edges = [(b, a, rng.random() < 0.3) if rng.random() < 0.5 else (a, b, rng.random() < 0.3) for a, b in edges]
        comp = {r.article_id: r.component for r in G.components(spark.createDataFrame(edges, EDGES)).collect()}
        rows = [(comp[r[1]], *r[1:]) for r in rows if r[1] in comp]
        assert stories(spark, rows, edges) == brute(rows, edges)


def test_bridges_do_not_chain_and_a_source_stands_once_unless_it_repeats_itself(spark):
    row = lambda i, h, s, sport="unknown": ("c", i, T0 + timedelta(hours=h), s, "rumor", sport)
    rows = [row("a", 0, "x"), row("b", 1, "y"), row("c", 2, "z"), row("d", 3, "x"), row("e", 4, "w", "tennis"), row("f", 5, "v", "football"), row("g", 90, "u")]
    edges = [("a", "b", False), ("b", "c", False), ("a", "d", False), ("a", "e", False), ("a", "f", False), ("a", "g", False)]
    assert stories(spark, rows, edges) == {"c": ["a", "b", "e"]}
    assert stories(spark, rows, [*edges[:2], ("a", "d", True), *edges[3:]]) == {"c": ["a", "b", "d", "e"]}
    assert stories(spark, rows, edges[:0] + [("b", "c", False)]) == {"c": ["b", "c"]}


def test_a_start_that_may_not_stand_tells_no_story_and_nothing_gives_nothing(spark):
    rows = [("c", "a", T0, "x", "rumor", "football"), ("c", "b", T0, "y", "rumor", "tennis"), ("c", "d", T0, "z", "rumor", "football")]
    assert stories(spark, rows, [("a", "b", False), ("a", "d", False)]) == {}
    assert C.coherent(spark.createDataFrame([], MEMBERS), spark.createDataFrame([], EDGES)).count() == 0


def test_built_clusters_name_anchor_representative_sport_and_edges(spark):
    members = spark.createDataFrame(
        [("a", T0, "rumor", "unknown", "weak", None, 0), ("b", T0 + timedelta(hours=1), "rumor", "football", "confirmed", None, 1), ("c", T0 + timedelta(hours=2), "rumor", "football", "probable", None, 1), ("d", T0, "rumor", "chess", "weak", "k", 2), ("e", T0, "rumor", "tennis", "weak", "k", 2)],
        "article_id string, published_at timestamp, event_type string, sport string, certainty string, competition string, n_entities int",
    )
    own = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")], "article_id string, story string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("c", "d"), ("d", "e")], "a_id string, b_id string")
    got = sorted(tuple(r) for r in C.built(own, members, edges).select("anchor_id", "representative_id", "member_ids", "event_state", "sport", "n_edges").collect())
    assert got == [("a", "b", ["a", "b", "c"], "rumor", "football", 2), ("d", "d", ["d", "e"], "rumor", None, 1)]


def plain_reconcile(proposed, existing, scope):
    now, ids = dict(existing), {}
    for story, members in sorted(proposed.items()):
        held = {}
        for m in members:
            if m in existing:
                held[existing[m]] = held.get(existing[m], 0) + 1
        ids[story] = min(held, key=lambda c: (-held[c], c)) if held else "cluster_" + hashlib.sha1(story.encode()).hexdigest()[:16]
    for story, members in proposed.items():
        for m in members:
            now[m] = ids[story]
    inside = {m for ms in proposed.values() for m in ms}
    for a in scope - inside:
        now.pop(a, None)
    reached = {existing[a] for a in scope if a in existing} | set(ids.values())
    for c in reached:
        if sum(v == c for v in now.values()) < 2:
            now = {a: v for a, v in now.items() if v != c}
    return now


def test_reconciling_keeps_ids_and_touches_only_the_scope(spark):
    rng = random.Random(8)
    for _ in range(3):
        arts = [f"x{i:02}" for i in range(60)]
        existing = {a: f"old{rng.randrange(14)}" for a in arts if rng.random() < 0.6}
        scope = {a for a in arts if rng.random() < 0.6}
        proposed = {}
        for a in sorted(scope):
            if rng.random() < 0.5:
                proposed.setdefault(f"s{rng.randrange(10)}", []).append(a)
        proposed = {min(ms): ms for ms in proposed.values() if len(ms) > 1}
        got = C.reconciled(
            spark.createDataFrame([(s, m) for s, ms in proposed.items() for m in ms], "story string, article_id string"),
            spark.createDataFrame([(c, a) for a, c in existing.items()], "cluster_id string, article_id string"),
            spark.createDataFrame([(a,) for a in scope], "article_id string"),
        ).collect()
        assert {r.article_id: r.cluster_id for r in got if r.cluster_id} == plain_reconcile(proposed, existing, scope)
        assert len({r.article_id for r in got}) == len(got)
