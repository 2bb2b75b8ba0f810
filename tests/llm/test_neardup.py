import random
import re

import pytest
from llm_helpers import sentence

from quadrille.llm import neardup
from quadrille.llm.components import connected_components


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc_id -> (shingles, smallest reachable doc_id), by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d)) for d, s in sets}


def check(df, **kw):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = neardup.near_duplicates(df, **kw).collect()
    assert len(got) == len(rows)
    truth = brute(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept is False
        else:
            assert (r.n_shingles, r.component_id) == truth[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def test_edges(edge_docs, no_docs):
    check(edge_docs)
    assert neardup.near_duplicates(no_docs).collect() == []


def test_one_id_with_two_texts(spark):
    """Rows that share a doc_id are judged each by its own text; a repeated row gives a row each."""
    rng = random.Random(5)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    near = b.split()
    near[30] = "other"
    rows = [(5, a), (5, b), (5, b), (3, " ".join(near)), (7, c), (7, c), (8, a)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (5, 5, True), (7, 7, True), (7, 7, True), (8, 5, False)]


def test_nodes_that_stay_large_are_compared_in_blocks(spark):
    check(spark.createDataFrame(_variants(6, 3, 40), "doc_id long, text string").coalesce(1), small=12, trees=4, max_depth=2)


def _variants(seed, groups, size):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = sentence(rng, 80).split()
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_all_pairs(spark):
    check(spark.createDataFrame(_variants(1, 40, 8), "doc_id long, text string"))


def test_large_nodes_branch_and_stay_exact(spark):
    """With nodes of more than 12 sets branching, groups of up to 60 go through several levels."""
    check(spark.createDataFrame(_variants(2, 4, 60), "doc_id long, text string"), small=12, trees=8)


def test_pairs_of_one_template_stay_together_over_many_levels(spark):
    """Texts of 0.6 mutual similarity, so that nodes stay large for several levels, in pairs of 0.752."""
    rng, rows = random.Random(7), []
    shared = sentence(rng, 94)
    for _ in range(60):
        own = sentence(rng, 30).split()
        rows += [" ".join([shared, *own]), " ".join([shared, *own[:13], sentence(rng, 17)])]
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert sum(c != d for d, (_, c) in brute(list(enumerate(rows))).items()) == 60
    check(df, small=16, trees=6)


@pytest.mark.parametrize(("background", "shared", "same"), [
    (0.5, 64, 18), (0.6, 94, 13),
    pytest.param(0.7, 144, 6, marks=pytest.mark.xfail(reason="open: 89 of 100 pairs with 64 minwise tokens, 99 or more with 128, whose disk and time are over the budget")),
])
def test_rows_of_a_large_template_are_bounded_and_its_pairs_found(spark, monkeypatch, background, shared, same):
    """1,200 texts of one template, nodes of 25 (as 100,000 to 2,048), 100 pairs just above 0.75 among them."""
    rng, texts = random.Random(shared), []
    head = sentence(rng, shared)
    for _ in range(100):
        own = sentence(rng, 30).split()
        texts += [" ".join([head, *own]), " ".join([head, *own[:same], sentence(rng, 30 - same)])]
    texts += [" ".join([head, sentence(rng, 30)]) for _ in range(1000)]
    like = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert 0.75 <= like(texts[0], texts[1]) < 0.77 and abs(like(texts[0], texts[2]) - background) < 0.01
    rows, branched = [], neardup._branched

    def counted(*args):
        out = branched(*args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(neardup, "_branched", counted)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), small=25).collect()}
    assert sum(got[2 * i + 1] == got[2 * i] == 2 * i for i in range(100)) >= 99
    assert all(got[i] == i for i in range(200, 1200)) and rows and max(rows) <= 64 * 1200


def test_full_sets_of_small_groups_are_met_once(spark, monkeypatch):
    """Variants of 40 texts share nodes in many groupings; each set is moved with its shingles once."""
    df, met, dealt = spark.createDataFrame(_variants(1, 40, 8), "doc_id long, text string"), [], neardup._dealt

    def counted(rows, key, *then):
        if key == "key":
            met.append((rows.count(), rows.select("v").distinct().count()))
        return dealt(rows, key, *then)

    monkeypatch.setattr(neardup, "_dealt", counted)
    check(df)
    assert len(met) == 1 and met[0][0] == met[0][1] > 100


@pytest.mark.parametrize("small", [3, 100])
def test_groups_that_share_members_are_one_up_to_the_bound(spark, small):
    keyed = spark.createDataFrame([(-1, 1, 1), (-1, 2, 1), (-2, 2, 2), (-2, 3, 2), (-3, 3, 3), (-3, 4, 3), (-4, 8, 8), (-4, 9, 8), (-5, 8, 8), (-5, 9, 8)], "key long, v long, least long")
    groups = {}
    for r in neardup._together(keyed, small).collect():
        groups.setdefault(r.key, []).append(r.v)
    got = sorted(sorted(g) for g in groups.values())
    assert got == ([[1, 2], [2, 3], [3, 4], [8, 9]] if small == 3 else [[1, 2, 3, 4], [8, 9]])


def test_rows_of_a_group_of_copies_grow_with_its_size(spark, monkeypatch):
    """Twice the near copies give at most about twice the rows of nodes; nodes that are no stars are neither joined nor written again."""
    shared, stars, made = neardup._shared, neardup._stars, []

    def rows_of(size):
        rng, made[:] = random.Random(9), []
        base = sentence(rng, 80).split()
        texts = [" ".join([*base[:i], sentence(rng, 1), *base[i + 1 :]]) for i in (rng.randrange(80) for _ in range(size))]
        neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), small=25).collect()
        return sum(made)

    def counted(*args):
        out = shared(*args)
        made.append(out.count())
        return out

    def watched(many, *args):
        written, store = [], neardup.checkpointed
        with monkeypatch.context() as m:
            m.setattr(neardup, "checkpointed", lambda df: written.append(store(df)) or written[-1])
            star, other = stars(many, *args)
        rows = sum(t.count() for t in written) if star is None else many.count()
        assert rows <= many.count()
        return star, other

    monkeypatch.setattr(neardup, "_shared", counted)
    monkeypatch.setattr(neardup, "_stars", watched)
    small, large = rows_of(150), rows_of(300)
    assert 0 < large <= 2.6 * small


def test_components_of_paths_and_hubs(spark, monkeypatch):
    from quadrille.llm import components

    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(500, 500), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    for last in (0, 1 << 14):
        monkeypatch.setattr(components, "LAST_LINKS", last)
        got = {r.id: r.component for r in connected_components(df).collect()}
        assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}
    assert connected_components(df.limit(0)).collect() == []
