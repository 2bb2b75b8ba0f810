"""String similarity joins against all pairs."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import ground, similar
from quadrille.operators.similar import pairs_by_deletion, within_distance, within_ratio, within_two


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def spoiled(rng, name, edits):
    for _ in range(edits):
        i = rng.randrange(len(name) + 1)
        name = rng.choice((name[:i] + rng.choice("abcz") + name[i:], name[:i] + name[i + 1 :], name[:i] + rng.choice("abcz") + name[i + 1 :]))
    return name


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    known = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 22))) for _ in range(120)} | {"aaaa", "aaaaaaa", "é漢字", ""})
    asked = sorted({spoiled(rng, rng.choice(known), rng.randrange(6)) for _ in range(80)} | {"", "b", "zzzzzzzzzzzzzzzzzzzz"})
    frame = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    return asked, known, frame(asked), frame(known)


@pytest.mark.parametrize(("most", "q"), [(1, 2), (2, 2), (2, 3), (4, 2)])
def test_all_pairs_within_a_distance(tables, most, q):
    asked, known, a, k = tables
    want = {(x, y, d) for x in asked if len(x) - q + 1 > q * most for y in known if (d := distance(x, y)) <= most}
    assert {tuple(r) for r in within_distance(a, k, most, q).collect()} == want and want


@pytest.mark.parametrize("longest", [0, 9, 30])
def test_all_pairs_within_two(spark, tables, longest):
    asked, known, a, k = tables
    able = lambda x: len(x) <= longest or len(x) - 2 > 6
    want = {(x, y, d) for x in asked if able(x) for y in known if (d := distance(x, y)) <= 2}
    assert {tuple(r) for r in within_two(a, k, longest).collect()} == want and want


@pytest.mark.parametrize("least", [0.8, 0.9, 0.97])
def test_all_pairs_within_a_ratio(tables, least):
    asked, known, a, k = tables
    ratio = lambda x, y: difflib.SequenceMatcher(None, y, x).ratio()
    told = lambda n: n - 1 > math.floor(n * (2 * (1 - least) / least + (2 - 2 * least) / (2 - least)) + 1e-9)
    want = {(x, y) for x in asked if told(len(x)) for y in known if ratio(x, y) >= least}
    assert {(r.name, r.entity) for r in within_ratio(a, k, least).collect()} == want and want


def test_nearest_names_equal_all_pairs(spark, tables):
    asked, known, a, k = tables
    nulls = spark.createDataFrame([(None,), ("aaaa",)], "name string")
    got = {r.name: (r.distance, r.entity) for r in ground.nearest_by_levenshtein(a.union(nulls), k.union(nulls)).collect()}
    assert got == {x: min((distance(x, y), y) for y in known) for x in {*asked, "aaaa"}}
    match = {r.name: r.entity for r in ground.close_matches(a.union(nulls), k.union(nulls)).collect()}
    best = {x: max(((difflib.SequenceMatcher(None, y, x).ratio(), y) for y in known), default=None) for x in {*asked, "aaaa"}}
    assert match == {x: b[1] if x and b[0] >= 0.6 and b[1] else None for x, b in best.items()}


def test_pairs_grow_slower_than_the_dictionary(spark):
    pairs = []
    for n in (1000, 8000):
        known = spark.range(n).select(F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"))
        asked = spark.range(0, 1000, 10).select(F.concat(F.lit("Cstmer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"))
        pairs.append(pairs_by_deletion(asked, known, 2).count())
    assert pairs[1] < 3 * pairs[0] and pairs[1] < 0.02 * 100 * 8000


def test_names_of_running_numbers_meet_in_blocks_spread_over_tasks(spark, monkeypatch):
    """Such names share most letter pairs, which are all frequent: these find nearly every pair of names."""

    by_grams = similar.candidate_pairs

    def no_letter_pairs(names, entities, lost, gap, q=2):
        assert q > 2, "letter pairs of running numbers"
        return by_grams(names, entities, lost, gap, q)

    monkeypatch.setattr(similar, "candidate_pairs", no_letter_pairs)
    known = [f"Customer#{i:09d}" for i in range(300)]
    asked = [k[2:] + "x" for k in known[::7]] + [k[:3] + k[4:] for k in known[::11]] + ["~far", "y" * 70]
    a, k = (spark.createDataFrame([(x,) for x in rows], "name string") for rows in (asked, known))
    got = {r.name: (r.distance, r.entity) for r in ground.nearest_by_levenshtein(a, k, 16, 64).collect()}
    match = {r.name: r.entity for r in ground.close_matches(a, k, name_rows=16, entity_rows=64).collect()}
    assert match == {x: next(iter(difflib.get_close_matches(x, known, 1, 0.6)), None) for x in asked}
    assert all(got[x[2:] + "x"] == (3, x) for x in known[::7]) and all(got[x[:3] + x[4:]] == (1, x) for x in known[::11])
    assert got["y" * 70] == (70, known[0])


def test_letters_in_words_equal_plain_models():
    def both(a, b):
        lev, common = list(range(len(b) + 1)), [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            old, lev, seen, common = lev, [i], common, [0]
            for j, y in enumerate(b, 1):
                lev.append(min(old[j] + 1, lev[-1] + 1, old[j - 1] + (x != y)))
                common.append(seen[j - 1] + 1 if x == y else max(seen[j], common[-1]))
        return lev[-1], common[-1]

    rng = random.Random(3)
    texts = ["".join(rng.choices("abé😀", k=rng.randint(0, 80))) for _ in range(20)] + [""]
    listed = similar.Listed(texts)
    for name in [*texts, "b" * 64, "ab" * 33]:
        want = [both(name, t) for t in texts]
        assert list(zip(listed.distances(name).tolist(), listed.common(name).tolist(), strict=True)) == want


def test_names_a_few_letters_off_are_not_compared_with_the_dictionary(spark, monkeypatch):
    compared, in_blocks = [], ground._in_blocks

    def seen(names, entities, *rest):
        compared.append(names.count())
        return in_blocks(names, entities, *rest)

    monkeypatch.setattr(ground, "_in_blocks", seen)
    known = [f"Customer#{i:09d}" for i in range(300)]
    asked = [k[2:] + "x" for k in known[::7]] + [k[:3] + k[4:] for k in known[::11]] + ["~far"]
    a, k = (spark.createDataFrame([(x,) for x in rows], "name string") for rows in (asked, known))
    got = {r.name: (r.distance, r.entity) for r in ground.nearest_by_levenshtein(a, k).collect()}
    assert compared[-1] == 1 and got["stomer#000000007x"] == (3, known[7]) and got["Cusomer#000000011"] == (1, known[11])
    match = {r.name: r.entity for r in ground.close_matches(a, k).collect()}
    assert compared[-1] == 1 and match == {x: next(iter(difflib.get_close_matches(x, known, 1, 0.6)), None) for x in asked}


def test_blocks_of_the_tree_equal_all_pairs(spark, tables):
    asked, known, a, k = tables
    got = {r.name: (r.distance, r.entity) for r in ground.nearest_by_levenshtein(a, k, 16, 64, 7, 31).collect()}
    assert got == {x: min((distance(x, y), y) for y in known) for x in asked}
    match = {r.name: r.entity for r in ground.close_matches(a, k, 0.6, 16, 64, 7, 31).collect()}
    best = {x: max((difflib.SequenceMatcher(None, y, x).ratio(), y) for y in known) for x in asked}
    assert match == {x: b[1] if x and b[0] >= 0.6 and b[1] else None for x, b in best.items()}


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_prefixes_find_all_pairs_up_to_a_distance(monkeypatch, step):
    monkeypatch.setattr(similar, "STEP", step)
    rng = random.Random(5)
    some = lambda n, letters: {"".join(rng.choices(letters, k=rng.randint(0, 9))) for _ in range(n)}
    texts, names = sorted(some(60, "abé😀") | {""}), [*some(25, "abé😀z"), "", ""]
    tree = similar.Prefixes(texts)
    for most in (0, 1, 3, 12):
        want = {(i, j, d) for i, x in enumerate(names) for j, y in enumerate(texts) if (d := distance(x, y)) <= most}
        assert set(zip(*map(list, tree.near(names, most)), strict=True)) == want
        common = similar.Listed(texts)
        want = {(i, j, d) for i, x in enumerate(names) for j, d in enumerate((common.size + len(x) - 2 * common.common(x)).tolist()) if d <= most}
        assert set(zip(*map(list, tree.near(names, most, 2)), strict=True)) == want
    assert not len(similar.Prefixes([]).near(["a"], 1)[0]) and not len(tree.near([], 1)[0])
