"""MinHash near-duplicate groups by a chosen-path set similarity join.

Each text becomes its set of distinct word shingles and a vector of ``WIDTH``
minwise tokens.  A tree's root chooses two positions of that vector and sends each
set to one node per position, keyed by its token there.  ``trees`` independent trees are grown
at once: two sets of similarity s share none of the first nodes with probability
(1 - s) ** (2 * trees), 6e-8 at 0.75 and six trees.  Sets of a small node, of at most ``small`` sets, are compared
exhaustively.  Sets of a larger node (a template, say) part in two ways:

* at once, by every other position at which a set's token is rare, held by at most ``RARE`` of these: those that share it are a
  small node.  (Not the sets of a star, below, which are alike.)  Against a background of similarity b a pair of similarity s shares about ``WIDTH`` * (s - b) of these;
* level by level: a node chooses positions anew by a hash of its path and branches again, until its parts are small.  The first
  levels choose two positions, as long as a set is then in no more than ``ROWS`` nodes, later ones one.

What keeps it linear on groups of copies of any size:

* equal sets are one vertex, found by a 128-bit digest, before any branching;
* nodes of one member end, nodes with equal members are one, and so are groups of members
  that agree on enough tokens, whatever nodes they were found in;
* a large node all of whose members agree with one of a few hubs is a star: it ends if each
  member is like a hub and the hubs are linked; else it branches on.

Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .session import checkpointed, discard
from .words import mix, shingle_sets, word_hashes

WIDTH = 64
#: Nodes of a level that a set may be in.
ROWS = 64
#: At most so many sets are compared exhaustively: what one task holds at a time.
SMALL = 2048
#: A pair whose share of equal minwise tokens is by so many standard deviations below the similarity is not looked at on full sets.
SKETCH_MARGIN = 4.6
STAR_EVERY = 4
#: A token that so many sets of large nodes have is rare.
RARE = 64
#: Rows of a few numbers that are broadcast at most.
BROADCAST_ROWS = 1 << 20
#: Members that stand for a large node's group, and members compared with them in one part.
HUBS = 4
STAR_PART = 512


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _minwise(sets: list[np.ndarray]) -> np.ndarray:
    """The ``WIDTH`` minwise tokens of each of some non-empty sets."""
    sig = np.zeros((len(sets), WIDTH), np.int32)
    if sets:
        u = np.concatenate(sets)
        begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for p in range(WIDTH):
            f = np.uint64(mix(np.array([p], np.uint64), 77)[0] | np.uint64(1))
            least = np.minimum.reduceat((u ^ (f >> np.uint64(7))) * f, begin)
            sig[:, p] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return sig


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each set, in two numbers; 0 for an empty one."""
    k1, k2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        u = np.concatenate([sets[i] for i in full])
        begin = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        k1[full] = np.add.reduceat(mix(u, 1001), begin).view(np.int64)
        k2[full] = np.add.reduceat(mix(u, 1002), begin).view(np.int64)
    return k1, k2


def _sign(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, h, at in word_hashes(batch.column("text")):
            sets = list(shingle_sets(h, at, shingle))
            n = np.array([len(s) for s in sets], np.int64)
            k1, k2 = _digests(sets)
            sig = _minwise([s for s in sets if len(s)])
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, WIDTH, 0))])
            own = [batch.column(c).slice(first, len(sets)) for c in ("doc_id", "text_key")]
            sketch = iter(sig.astype(np.uint8))
            sketches = pa.array([next(sketch).tobytes() if x else b"" for x in n.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(k1), pa.array(k2), _lists(sig.reshape(-1), offsets), sketches], ["doc_id", "text_key", "n_shingles", "k1", "k2", "sig", "sketch"])


def signatures(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, the set's digest (k1, k2), its ``WIDTH`` minwise tokens (sig) and their
    last bytes (sketch), by which a pair is looked at the first time.

    A null or wordless text has no shingles and no tokens."""

    def run(batches):
        with np.errstate(over="ignore"):
            yield from _sign(batches, shingle)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n_shingles long, k1 long, k2 long, sig array<int>, sketch binary")


def full_sets(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """(v, sig, members) of rows (v, k1, k2, text): minwise tokens and the sorted distinct shingle
    hashes, eight bytes each, of those texts whose set has the digest (k1, k2); each v once a task."""

    def run(batches):
        seen: set[int] = set()
        with np.errstate(over="ignore"):
            for batch in batches:
                wanted = [batch.column(c).to_numpy() for c in ("v", "k1", "k2")]
                for first, h, at in word_hashes(batch.column("text")):
                    sets = list(shingle_sets(h, at, shingle))
                    v, *want = (w[first : first + len(sets)] for w in wanted)
                    good = np.logical_and.reduce([a == b for a, b in zip(_digests(sets), want, strict=True)])
                    use = []
                    for i in np.flatnonzero(good).tolist():
                        if len(sets[i]) and int(v[i]) not in seen:
                            seen.add(int(v[i]))
                            use.append(i)
                    sig = _minwise([sets[i] for i in use])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v[use]), _lists(sig.reshape(-1), np.arange(len(use) + 1) * WIDTH), pa.array([sets[i].tobytes() for i in use], pa.binary())], ["v", "sig", "members"]
                    )

    return rows.mapInArrow(run, "v long, sig array<int>, members binary")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct arrays."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare_node(doc: np.ndarray, sig: np.ndarray, members: list, percent: int, cut: float) -> Iterator[tuple[int, int]]:
    """The groups that confirmed links make of a node's members, each as links to its smallest."""
    sets: dict[int, np.ndarray] = {}

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(members[i].as_py(), np.uint64)
        return sets[i]

    m = len(doc)
    if m == 2:
        if (sig[0] == sig[1]).mean() >= cut and _alike(of(0), of(1), percent):
            yield int(doc[0]), int(doc[1])
        return
    like = np.zeros((m, m), np.uint8)
    for i in range(m - 1):
        like[i, i + 1 :] = (sig[i + 1 :] == sig[i]).sum(axis=1)
    left, right = np.nonzero(like >= max(1, cut * WIDTH))
    order = np.argsort(-like[left, right].astype(np.int16), kind="stable")
    left, right = left[order], right[order]
    root = np.arange(m)
    step, at = 64, 0
    while at < len(left):
        some = slice(at, at + step)
        at, step = at + step, min(2 * step, 4096)
        for i, j in zip(left[some].tolist(), right[some].tolist(), strict=True):
            if root[i] != root[j] and _alike(of(i), of(j), percent):
                root[root == root[j]] = root[i]
        apart = root[left[at:]] != root[right[at:]]
        left, right, at = left[at:][apart], right[at:][apart], 0
    for r in np.unique(root):
        group = doc[root == r]
        for d in group[group != group.min()]:
            yield int(d), int(group.min())


def _nodes(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by ``key``, as tables of whole nodes; no node is longer than a small one."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        path = table.column(key).to_numpy()
        last = int(np.searchsorted(path, path[-1]))
        if last:
            yield table.slice(0, last).combine_chunks()
        rest = table.slice(last)
    if rest is not None:
        yield rest.combine_chunks()


def _edges(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def _sketches(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(table.num_rows, WIDTH)


def _tokens(table: pa.Table) -> np.ndarray:
    return table.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, WIDTH)


def _groups(sig: np.ndarray, cut: float) -> np.ndarray:
    """For each member of a node the smallest one it reaches over pairs that agree on a part of ``cut``."""
    root = np.arange(len(sig))
    for k in range(len(sig) - 1):
        like = np.flatnonzero((sig[k + 1 :] == sig[k]).mean(axis=1) >= cut) + k + 1
        if len(like):
            met = np.unique(root[np.append(like, k)])
            root[np.isin(root, met)] = met[0]
    return root


def _plausible(batches: Iterator[pa.RecordBatch], cut: float) -> Iterator[pa.RecordBatch]:
    """(key, v, least): each node's groups of members whose tokens agree, named by a hash of their members, so
    that a group that many nodes hold has one name, with the smallest member."""
    with np.errstate(over="ignore"):
        for table in _nodes(batches, "path"):
            v, sig, edge = table.column("v").to_numpy(), _sketches(table), _edges(table.column("path").to_numpy())
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            two = two[(sig[two] == sig[two + 1]).mean(axis=1) >= cut]
            row, group = [np.stack([two, two + 1], axis=1).reshape(-1)], [np.repeat(two, 2)]
            for i, j in zip(edge[:-1][size > 2].tolist(), edge[1:][size > 2].tolist(), strict=True):
                root = _groups(sig[i:j], cut)
                full = np.flatnonzero(np.bincount(root, minlength=j - i)[root] > 1)
                row.append(full + i)
                group.append(root[full] + i)
            row, group = np.concatenate(row), np.concatenate(group)
            own = mix(v[row].view(np.uint64), 5)
            total = np.zeros(table.num_rows, np.uint64)
            np.add.at(total, group, own)
            least = np.full(table.num_rows, np.iinfo(np.int64).max)
            np.minimum.at(least, group, v[row])
            yield pa.RecordBatch.from_arrays([pa.array(mix(total[group], 6).view(np.int64)), pa.array(v[row]), pa.array(least[group])], ["key", "v", "least"])


def _compare_sorted(batches: Iterator[pa.RecordBatch], percent: int, cut: float) -> Iterator[pa.RecordBatch]:
    for table in _nodes(batches, "key"):
        v, sig, edge = table.column("v").to_numpy(), _tokens(table), _edges(table.column("key").to_numpy())
        members = table.column("members")
        found = [x for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if j - i > 1 for x in _compare_node(v[i:j], sig[i:j], members[i:j], percent, cut)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])


def _compare_stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(star, a, b): each member of a part of a star linked to a hub, b null where no hub of the main
    group of hubs is like it.  Hubs stand before members."""
    for table in _nodes(batches, "part"):
        edge, v, star = _edges(table.column("part").to_numpy()), table.column("v").to_numpy(), table.column("star").to_numpy()
        hub, members = table.column("hub").to_numpy(zero_copy_only=False), table.column("members")
        out: list[tuple[int, int, int | None]] = []
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            heads: dict[int, np.ndarray] = {}
            for k in range(i, j):
                if hub[k]:
                    heads.setdefault(int(v[k]), np.frombuffer(members[k].as_py(), np.uint64))
            names = sorted(heads)
            root = {x: x for x in names}
            for x in names:
                for y in names:
                    if x < y and root[x] != root[y] and _alike(heads[x], heads[y], percent):
                        old = root[y]
                        root = {z: root[x] if r == old else r for z, r in root.items()}
                        out.append((int(star[i]), y, x))
            main = max(names, key=lambda x: (sum(r == root[x] for r in root.values()), -root[x]))
            inside = [x for x in names if root[x] == root[main]]
            out += [(int(star[i]), x, None) for x in names if x not in inside]
            for k in range(i, j):
                if not hub[k] and int(v[k]) not in heads:
                    own = np.frombuffer(members[k].as_py(), np.uint64)
                    out.append((int(star[i]), int(v[k]), next((x for x in inside if _alike(own, heads[x], percent)), None)))
        yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], pa.int64()) for n in range(3)], ["star", "a", "b"])


def _dealt(rows: DataFrame, key: str, *then: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, key).sortWithinPartitions(key, *then)


def _in_blocks(rows: DataFrame, small: int) -> DataFrame:
    """Nodes of any size as small nodes that hold each pair of a node's members in one of them: members are
    dealt into blocks of a quarter of ``small``, and each pair of blocks is a node."""
    blocks = F.ceil(F.col("n") / F.lit(max(1, small // 4))).cast("int")
    mine = F.pmod(F.xxhash64("v", F.lit(3)), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.xxhash64("path", F.least(b, F.col("mine")), F.greatest(b, F.col("mine"))))
    return rows.withColumn("blocks", blocks).withColumn("mine", mine).select(F.explode(others).alias("path"), "v")


def similar_links(groups: DataFrame, docs: DataFrame, percent: int = 75, trees: int = 6, small: int = SMALL, max_depth: int = 24, shingle: int = 5) -> DataFrame:
    """Links (a, b) that connect whatever a chosen-path join finds alike.

    ``groups``: one row (v, doc, k1, k2, sig, sketch) for each different set, ``v`` its number and ``doc`` a document
    that has it; ``docs``: (doc_id, text).  Links between members that a node's other links connect
    are left out, no others.  Branching needs tokens alone, so full sets are made once, for the sets
    that agree with another on enough tokens, and met once for all levels, each once where the groups that hold it are a small
    node together.  Rows of a level are a path and a number; tokens
    are joined where they are looked at.  A large node all of whose members agree with
    one of its hubs waits as a star for the full sets; if some member is like no hub, it branches on and is not
    tried again for ``STAR_EVERY`` levels.  What is still large after ``max_depth`` levels is compared in pairs of blocks.
    """
    share = percent / 100
    cut = share - SKETCH_MARGIN * (share * (1 - share) / WIDTH) ** 0.5
    n_roots = min(WIDTH, 2 * trees)
    sketches = groups.select("v", "sketch")

    def level_of(rows: DataFrame, lev) -> DataFrame:
        return checkpointed(_shared(rows, small).withColumn("lev", lev).withColumn("hold", F.lit(1)))

    level = level_of(_at_positions(groups, range(n_roots)), F.lit(1))
    large = level.where(F.col("n") > small)
    wide: DataFrame | None = None
    rare: DataFrame | None = None
    if not large.isEmpty():
        members = checkpointed(large.select("v").distinct())
        wide = checkpointed(groups.select("v", "sig").join(_bounded(members), "v", "left_semi"))
        discard(members)
    links: list[DataFrame] = []
    written: list[DataFrame] = []
    sets: DataFrame | None = None
    while level is not None:
        found: list[DataFrame] = []
        stars: list[DataFrame] = []
        while level is not None:
            few = level.where(F.col("n") <= small).select("path", "v")
            deep = level.where((F.col("n") > small) & (F.col("lev") >= max_depth))
            few = _united([x for x in (few, _in_blocks(deep, small), rare) if x is not None])
            near = _dealt(few.join(sketches, "v"), "path").mapInArrow(lambda b: _plausible(b, cut), "key long, v long, least long")
            found.append(checkpointed(near.distinct()))
            discard(rare)
            many = level.where((F.col("n") > small) & (F.col("lev") < max_depth))
            star, many = (None, None) if many.isEmpty() else _stars(many, wide, cut)
            if star is not None:
                stars.append(star)
            step = None if many is None else _branched(many, wide, n_roots, small)
            rare = None if many is None else _rare(many, wide, n_roots, small)
            discard(level, many)
            level = step
        keyed = _together(found[0] if len(found) == 1 else _united(found).distinct(), small)
        starred = _united(stars) if stars else None
        if sets is None:
            active = keyed.select("v") if starred is None else keyed.select("v").unionAll(starred.select("v"))
            wanted = checkpointed(groups.select("v", "doc", "k1", "k2").join(active.distinct(), "v", "left_semi"))
            texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
            sets = checkpointed(full_sets(texts.join(_bounded(wanted), "doc").select("v", "k1", "k2", "text"), shingle))
            discard(wanted)
        met = _dealt(keyed.join(sets, "v").select("key", "v", "sig", "members"), "key")
        written.append(checkpointed(met.mapInArrow(lambda b: _compare_sorted(b, percent, cut), "a long, b long")))
        links.append(written[-1])
        if starred is not None:
            judged = checkpointed(_judged(starred, sets, percent))
            written.append(judged)
            links.append(judged.where("b is not null").select("a", "b"))
            open_ = judged.where("b is null").select("star", F.col("a").alias("v")).distinct()
            paths = starred.join(open_, ["star", "v"], "left_semi").select("path").distinct()
            going = starred.join(paths, "path", "left_semi")
            if not going.isEmpty():
                level = _branched(going.withColumn("hold", F.col("lev") + STAR_EVERY), wide, n_roots, small)
                rare = _rare(going, wide, n_roots, small)
        discard(*found, *stars, keyed)
    out = checkpointed(_united(links).distinct())
    discard(sets, wide, *written)
    return out


def _bounded(rows: DataFrame) -> DataFrame:
    """To be broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _together(keyed: DataFrame, small: int) -> DataFrame:
    """(key, v) of groups (key, v, least): groups that share members, whatever nodes they were found in, are one, so that a set
    is in one group; they stay as found where that would be more than ``small`` sets."""
    labels = connected_components(keyed.select(F.col("v").alias("a"), F.col("least").alias("b")))
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    named = labels.join(sizes, "component").select(F.col("id").alias("v"), "component", "n")
    one = F.when(F.col("n") <= small, F.col("component")).otherwise(F.col("key"))
    out = checkpointed(keyed.join(named, "v").select(one.alias("key"), "v").distinct())
    discard(labels)
    return out


def _rare(many: DataFrame, wide: DataFrame, n_roots: int, small: int) -> DataFrame | None:
    """(path, v): for the sets of some large nodes of the first level, nodes of the rare tokens at positions that no root has; none for
    later levels, whose sets were all in these."""
    first = many.where("lev = 1")
    if first.isEmpty():
        return None
    own = wide.join(first.select("v").distinct(), "v", "left_semi")
    return checkpointed(_shared(_at_positions(own, range(n_roots, WIDTH)), small).where(F.col("n") <= min(small, RARE)).select("path", "v"))


def _at_positions(rows: DataFrame, positions: range) -> DataFrame:
    """(v, path): each set (v, sig) in a node for each of some positions and its token there."""
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.element_at("sig", i + 1).alias("t")) for i in positions])
    return rows.select("v", F.explode(places).alias("x")).select("v", F.xxhash64("x.i", "x.t").alias("path"))


def _stars(many: DataFrame, wide: DataFrame, cut: float) -> tuple[DataFrame | None, DataFrame | None]:
    """Large nodes that may be stars (with the star's number and hubs), and the others; ``wide``: their members' tokens (v, sig).

    Hubs are a node's first members in each of ``HUBS`` hash orders, so nodes with the same group have the
    same hubs and are one star."""
    tried = many.where("lev >= hold")
    order = [F.xxhash64("v", F.lit(k), F.expr(f"lev div {STAR_EVERY}")) for k in range(HUBS)]
    chosen = tried.groupBy("path").agg(F.array_distinct(F.array(*[F.min_by("v", o) for o in order])).alias("hubs"))
    hubs = chosen.select("path", F.explode("hubs").alias("v")).join(wide, "v").groupBy("path").agg(F.collect_list(F.struct("v", "sig")).alias("hubs"))

    def agreed(sig):
        return F.aggregate(F.zip_with("sig", sig, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)

    like = F.exists("hubs", lambda h: agreed(h["sig"]) >= cut * WIDTH)
    with_tokens = many.join(hubs, "path", "left").join(wide, "v")
    rows = checkpointed(with_tokens.select("path", "v", "n", "lev", "hold", F.col("hubs.v").alias("hubs"), F.coalesce(like, F.lit(False)).alias("like")))
    whole = checkpointed(rows.groupBy("path").agg(F.min("like").alias("whole")).where("whole").select("path"))
    if whole.isEmpty():
        discard(whole)
        return None, rows
    paths = _bounded(whole)
    star = checkpointed(rows.drop("like").join(paths, "path", "left_semi").withColumn("star", F.xxhash64(F.array_sort("hubs"))))
    other = checkpointed(rows.drop("like", "hubs").join(paths, "path", "left_anti"))
    discard(rows, whole)
    if other.isEmpty():
        discard(other)
        return star, None
    return star, other


def _growth(n_roots: int) -> list[float]:
    """By how much rows grow from level to level, from the first on, until a set is in ``ROWS`` nodes; then they grow no more."""
    out, rows = [], float(n_roots)
    while rows < ROWS:
        out.append(min(2.0, ROWS / rows))
        rows *= out[-1]
    return out


def _branched(rows: DataFrame, wide: DataFrame, n_roots: int, small: int) -> DataFrame:
    """The next level: one position, and a second one with the chance that makes the level's growth."""
    one, two = (F.pmod(F.xxhash64("path", F.lit(k)), F.lit(WIDTH)).cast("int") for k in (0, 1))
    growth = F.coalesce(F.get(F.array(*[F.lit(x) for x in [*_growth(n_roots), 1.0]]), F.col("lev") - 1), F.lit(1.0))
    more = F.pmod(F.xxhash64("path", F.lit(2)), F.lit(1000)) < F.round(1000 * (growth - 1))
    first, second = (F.xxhash64("path", i, F.get("sig", i)) for i in (one, two))
    paths = F.when(more & (one != two), F.array(first, second)).otherwise(F.array(first))
    children = checkpointed(rows.select("v", "path", "lev", "hold").join(wide, "v").select("v", (F.col("lev") + 1).alias("lev"), "hold", F.explode(paths).alias("path")))
    out = checkpointed(_shared(children, small))
    discard(children)
    return out


def _judged(starred: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(star, a, b) of ``_compare_stars`` for all stars, each in parts of at most about ``STAR_PART`` members."""
    rows = starred.select("star", "v", "hubs").groupBy("star", "v").agg(F.first("hubs").alias("hubs"))
    sizes = rows.groupBy("star").agg(F.ceil(F.count("*") / F.lit(STAR_PART)).cast("int").alias("parts"), F.first("hubs").alias("hubs"))
    own = rows.select("star", "v").join(sizes.select("star", "parts"), "star").select("star", F.pmod(F.xxhash64("v", F.lit(4)), F.col("parts")).cast("int").alias("k"), "v", F.lit(False).alias("hub"))
    heads = sizes.select("star", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k"), "hubs").select("star", "k", F.explode("hubs").alias("v"), F.lit(True).alias("hub"))
    met = own.unionAll(heads).join(sets.select("v", "members"), "v").select(F.xxhash64("star", "k").alias("part"), "star", "v", "hub", "members")
    by = _dealt(met.withColumn("last", ~F.col("hub")), "part", "last").drop("last")
    return by.mapInArrow(lambda b: _compare_stars(b, percent), "star long, a long, b long")


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _shared(rows: DataFrame, small: int) -> DataFrame:
    """The rows (path, v, …) of nodes with two members or more, with the node's size n; of small nodes
    with the same members only one.  A set is once in a node."""
    who = F.xxhash64("v")
    sizes = rows.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(who).alias("x"), F.min(who).alias("lo"), F.max(who).alias("hi")).where("n > 1")
    own = F.when(F.col("n") > small, F.col("path")).otherwise(F.lit(0))
    once = sizes.groupBy("n", "x", "lo", "hi", own.alias("own")).agg(F.min("path").alias("path")).select("path", "n")
    return rows.join(once, "path")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75, trees: int = 6, small: int = SMALL, max_depth: int = 24) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    * null, empty or wordless text: n_shingles 0, its own component, kept;
    * fewer words than ``shingle``: the whole sequence is the only shingle;
    * equal sets are linked whatever their texts; a repeated row gives a row each;
    * rows that share a doc_id but not a text are judged each by its own text;
    * a null doc_id has component_id null and kept false;
    * component_id is the smallest doc_id reachable over links with
      100 * intersection >= percent * union; kept marks doc_id = component_id.

    Other columns of ``docs`` are neither read nor returned.
    """
    return near_groups(docs, shingle, percent, trees, small, max_depth).select("doc_id", "n_shingles", "component_id", "kept")


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 75, trees: int = 6, small: int = SMALL, max_depth: int = 24) -> DataFrame:
    """What ``near_duplicates`` returns, with text_key (a hash of the row's text) and group_id: the same number for all
    rows of linked texts, and for no others; null for a text without shingles and for a row without doc_id."""
    signed = checkpointed(signatures(docs, shingle))
    key = ["k1", "k2", "n_shingles"]
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    grouped = filled.groupBy(*key).agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    groups = checkpointed(grouped.withColumn("v", F.monotonically_increasing_id()))
    links = similar_links(groups, docs, percent=percent, trees=trees, small=small, max_depth=max_depth, shingle=shingle)
    labels = connected_components(links)
    held = groups.select(*key, "doc", F.col("v").alias("id")).join(labels, "id")
    least = held.groupBy("component").agg(F.min("doc").alias("least"))
    named = checkpointed(held.join(least, "component").select(*key, "least", "component"))
    discard(links, labels)
    single = groups.select(*key, "doc", "v").join(named, key, "left").select(*key, F.coalesce("least", "doc").alias("least"), F.coalesce("component", "v").alias("group_id"))
    # Written first, so that a set with very many copies is a skewed join of two tables, which Spark splits.
    single = checkpointed(single)
    discard(named, groups)
    out = signed.drop("sig", "sketch").join(single, key, "left")
    known = F.col("doc_id").isNotNull()
    component = F.when(known, F.coalesce("least", "doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"), F.when(known, F.col("group_id")).alias("group_id"))


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that stay if one row of each near-duplicate group does.

    Of a group the row with the smallest doc_id stays, of rows that share it the one whose text has the smaller
    hash; rows without doc_id come behind all others.  Rows with the same doc_id and text are one: the
    first by its other columns stays.  Texts without shingles are no copies of each other.  Rows that
    share a doc_id but not a text are judged each by its text."""
    names = docs.columns
    text = F.col("text").cast("string")
    late = F.lit(1 << 62).bitwiseOR(F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), late).alias("id"), F.xxhash64(text).alias("text_key"))
    found = checkpointed(near_groups(docs.select(F.coalesce(F.col("doc_id").cast("long"), late).alias("doc_id"), text.alias("text")), **params))
    first = found.where("group_id is not null").groupBy("group_id").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).select("x.doc_id", "x.text_key")
    stay = first.unionAll(found.where("group_id is null").select("doc_id", "text_key")).distinct().select(F.col("doc_id").alias("id"), "text_key")
    others = F.to_json(F.struct(*[F.col(f"row.`{c}`") for c in names if c.lower() != "text"], F.lit(0)))
    rows = packed.join(stay, ["id", "text_key"]).groupBy("id", "text_key").agg(F.min_by("row", others).alias("row"))
    return rows.select("row.*")
