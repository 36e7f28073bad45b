"""Near duplicates by min-max hashing, confirmed on full shingle sets.

Each text's set of five-word shingles is reduced to both the least and the greatest
value under each of ``PERMUTATIONS`` random permutations: one hash evaluation gives two
signature values, each an unbiased vote for the similarity. A band joins two least
and two times two greatest values of different permutations; texts that agree in a band are
candidates. At a similarity of 0.75 a pair misses all ``BANDS`` bands with a
probability of about four in a million, and less above.

Candidates are confirmed on the full sets. Texts of one set (copies among them) are one class and are
never paired. A bucket is not expanded into pairs: its first member meets the others,
confirmed links are merged, and only members that are then still in different
components of the same bucket go on. Clusters of such members whose buckets make few pairs
are paired, leaving out pairs whose one-bit sketches differ too much (less than one pair in
a million at the threshold); in the others every two blocks of 256 members meet in one
small group, which compares all their sets at once and returns no more links than join them.

Nulls and texts without words have an empty set and are linked with nothing. Ties take
the smallest ``doc_id``. Rows without a ``doc_id`` take no part: they are kept, with a
null component. Rows repeated under one id stay repeated; different texts
under one id are judged each, and a group's least id keeps all its texts. Further columns don't matter.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulemesh.llm.common import (
    BROADCAST_BYTES,
    SIMILARITY_PERCENT,
    Words,
    batch_slices,
    distinct,
    fresh,
    give_back,
    mixed,
    shingles,
)
from rulemesh.operators.joins import keyed_join
from rulemesh.session import cut_lineage

BANDS = 64
ROWS = 6
PERMUTATIONS = BANDS * ROWS // 2
#: Rounds in which a bucket's first member meets the others, before pairs are made.
HUB_ROUNDS = 1
#: A cluster whose buckets make more pairs a member than this is compared in blocks of so many members.
DENSE_PAIRS = 16
BLOCK_DOCS = 256
_COLUMNS = 4096
_SET = ["set_a", "set_b"]
#: Pairs whose sketches (one bit a signature value) differ in more bits are not confirmed. At a
#: similarity of 0.75 one bit in eight differs: 48, with a deviation of 6.5.
SKETCH_BITS = 80

_FACTORS = np.random.default_rng(29).integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = np.random.default_rng(31).integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_BLOCK = 512


def signature(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of a non-empty set under every permutation."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    most = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(own), _BLOCK):
        hashed = own[at : at + _BLOCK, None] * _FACTORS + _SHIFTS
        np.minimum(least, hashed.min(axis=0), out=least)
        np.maximum(most, hashed.max(axis=0), out=most)
    return least, most


def bands(least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """One hash for each band. A band takes its least and its greatest values from
    different permutations, so they are independent."""
    half = ROWS // 2
    rows = np.hstack([least.reshape(BANDS, half), np.roll(most.reshape(BANDS, half), 1, axis=0)])
    total = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        total = mixed(total + mixed(rows[:, i] + np.uint64(i)))
    return total


def sketch(least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """One bit of every signature value, in 64-bit words."""
    bits = mixed(np.concatenate([least, most])) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sets(data: np.ndarray, offsets: np.ndarray):
    every, places = shingles(Words(data, offsets))
    for a, b in zip(places[:-1], places[1:], strict=True):
        yield distinct(every[a:b])


def _set_names(own: np.ndarray) -> tuple[np.int64, np.int64]:
    """Two hashes that name a set."""
    one = np.add.reduce(mixed(own)).view(np.int64)
    return one, np.add.reduce(mixed(own ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)


def _slices(batches):
    for batch in batches:
        yield from batch_slices(batch)
    give_back()


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, size of the shingle set, two hashes that name the set, band hashes, sketch."""

    def run(batches):
        for batch, data, offsets in _slices(batches):
            n, one, two, banded, drawn = [], [], [], [], []
            for own in _sets(data, offsets):
                n.append(len(own))
                a, b = _set_names(own)
                one.append(a)
                two.append(b)
                values = signature(own)
                banded.append(bands(*values).view(np.int64) if len(own) else np.zeros(0, np.int64))
                drawn.append(sketch(*values))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()),
                    pa.array(banded, pa.list_(pa.int64())),
                    pa.array(drawn, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"
    )


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, the names and the whole shingle set of each text."""

    def run(batches):
        for batch, data, offsets in _slices(batches):
            sets = list(_sets(data, offsets))
            names = np.array([_set_names(x) for x in sets], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(names[:, 0]),
                    pa.array(names[:, 1]),
                    pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "set_a", "set_b", "shingles"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, set_a long, set_b long, shingles array<long>"
    )


def _with_set_names(docs: DataFrame, one: str, two: str) -> DataFrame:
    """``docs`` with the names of the shingle set of ``text``."""

    def run(batches):
        for batch, data, offsets in _slices(batches):
            names = np.array([_set_names(x) for x in _sets(data, offsets)], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[:, 0]), pa.array(names[:, 1])], names=[*batch.schema.names, one, two]
            )

    added = [T.StructField(one, T.LongType()), T.StructField(two, T.LongType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def alike(inter: Column, n: Column, m: Column) -> Column:
    return 100 * inter >= SIMILARITY_PERCENT * (n + m - inter)


def _small(df: DataFrame, columns: int) -> bool:
    return df.count() * 16 * columns <= BROADCAST_BYTES


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike. A hot ``a`` is spread over tasks."""
    with_a = keyed_join(pairs, sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    inter = F.size(F.array_intersect("of_a", "of_b"))
    return cut_lineage(with_b.filter(alike(inter, F.size("of_a"), F.size("of_b"))).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes that have a link.

    Alternates two contractions: neighbours above a node move to its least neighbour, and then
    those below it do. Rounds are logarithmic in the longest chain; each leaves
    a table behind which the next reads.
    """
    edges = cut_lineage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(moved.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == state:
            break
        state = now
    roots = edges.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").unionByName(
        roots.select(F.col("component").alias("node"), "component").distinct()
    )


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members of buckets that still hold more than one component, with ``label``."""
    own = components(links)
    named = members.join(own, "node", "left").withColumn(
        "label", F.coalesce("component", "node")
    ).drop("component")
    mixed_up = (
        named.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    )
    return cut_lineage(named.join(mixed_up.select("band"), "band", "left_semi"))


def _sizes_allow(n: str, m: str) -> Column:
    return (100 * F.col(n) >= SIMILARITY_PERCENT * F.col(m)) & (100 * F.col(m) >= SIMILARITY_PERCENT * F.col(n))


def linked(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between classes; ``known`` has their profiles. Their components
    are those of all links."""
    entries = known.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("band")
    shared = cut_lineage(shared)
    if _small(shared, 1):
        shared = F.broadcast(shared)
    members = cut_lineage(entries.join(shared, "band", "left_semi"))
    wanted = known.join(members.select("node").distinct(), "node", "left_semi")
    wanted = cut_lineage(wanted.select("doc_id", *_SET, "node"))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    held = keyed_join(texts, wanted.select("doc_id"), "doc_id", "left_semi", fits=_small(wanted, 1))
    key = ["doc_id", *_SET]
    sets = shingle_sets(held).dropDuplicates(key).join(F.broadcast(wanted) if _small(wanted, 4) else wanted, key)
    sets = cut_lineage(sets.select("node", "shingles"))

    links = None
    left = members.withColumn("label", F.col("node"))
    for _ in range(HUB_ROUNDS):
        hubs = left.groupBy("band").agg(F.min(F.struct("node", "n", "label")).alias("hub"))
        met = left.join(hubs, "band")
        pairs = met.filter((F.col("node") != F.col("hub.node")) & (F.col("label") != F.col("hub.label")))
        pairs = pairs.withColumn("m", F.col("hub.n")).filter(_sizes_allow("n", "m"))
        pairs = cut_lineage(pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct())
        found = confirmed(pairs, sets)
        links = found if links is None else links.unionByName(found)
        rest = met.filter(F.col("node") != F.col("hub.node")).select("band", "node", "n")
        left = _labelled(rest, links)
    left = cut_lineage(_clustered(left))
    sparse = _sparse_pairs(left.filter("not dense"), known)
    return reduce(DataFrame.unionByName, [links, confirmed(sparse, sets), _dense_links(left.filter("dense"), sets)])


def _clustered(left: DataFrame) -> DataFrame:
    """``left`` with ``cluster``, the members that buckets hold together, its size ``m``, and whether it is
    ``dense``: whether its buckets make more than ``DENSE_PAIRS`` pairs a member."""
    sizes = left.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("k"))
    stars = left.join(sizes, "band").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    own = cut_lineage(components(stars.filter("a <> b").distinct()).withColumnRenamed("component", "cluster"))
    members = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    pairs = (
        sizes.join(own.withColumnRenamed("node", "hub"), "hub")
        .groupBy("cluster")
        .agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("pairs"))
    )
    judged = members.join(pairs, "cluster").withColumn("dense", F.col("pairs") > DENSE_PAIRS * F.col("m"))
    judged = cut_lineage(judged.drop("pairs"))
    named = left.join(own, "node")
    return keyed_join(named, judged, "cluster", fits=_small(judged, 3))


def _sparse_pairs(left: DataFrame, known: DataFrame) -> DataFrame:
    """All pairs that a bucket holds, of different components and with sketches near enough."""
    left = left.join(known.select("node", "sketch"), "node")
    differ = reduce(
        add,
        (F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(PERMUTATIONS // 32)),
    )
    one, two = left.alias("x"), left.alias("y")
    pairs = one.join(two, F.col("x.band") == F.col("y.band")).filter(
        (F.col("x.node") < F.col("y.node"))
        & (F.col("x.label") != F.col("y.label"))
        & _sizes_allow("x.n", "y.n")
        & (differ <= SKETCH_BITS)
    )
    return cut_lineage(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())


def spanning_links(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Enough confirmed links among some texts to join whatever their links join, given that equal
    labels are joined already."""
    n = np.array([len(s) for s in sets], np.int64)
    marks = np.concatenate([np.zeros(0, np.int64), *sets])
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(marks, kind="stable")
    marks, owner = marks[order], owner[order]
    new = np.append(True, marks[1:] != marks[:-1]) if len(marks) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1 if len(marks) else new
    owner, number = owner[shared], np.cumsum(new[shared]) - 1
    inter = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(number[-1]) + 1 if len(number) else 0, _COLUMNS):
        a, b = np.searchsorted(number, [first, first + _COLUMNS])
        held = np.zeros((len(sets), _COLUMNS), np.float32)
        held[owner[a:b], number[a:b] - first] = 1
        inter += held @ held.T
    both = inter.astype(np.int64)
    linked = 100 * both >= SIMILARITY_PERCENT * (n[:, None] + n[None, :] - both)
    parent = {label: label for label in labels.tolist()}

    def find(label):
        while parent[label] != label:
            parent[label] = label = parent[parent[label]]
        return label

    out = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        x, y = find(int(labels[i])), find(int(labels[j]))
        if x != y:
            parent[x] = y
            out.append((int(ids[i]), int(ids[j])))
    return out


def _dense_links(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of dense clusters, whose members meet in blocks: every two blocks of about ``BLOCK_DOCS``
    members are one small group, which compares all its sets and returns only links."""

    def run(group: pa.Table) -> pa.Table:
        own = [np.asarray(x.values) for x in group.column("shingles").combine_chunks()]
        found = spanning_links(group.column("node").to_numpy(), group.column("label").to_numpy(), own)
        return pa.table(
            {"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())}
        )

    blocks = F.ceil(F.col("m") / BLOCK_DOCS).cast("int")
    members = (
        left.select("cluster", "m", "node", "label")
        .distinct()
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "cluster",
            F.least("block", "other").alias("low"),
            F.greatest("block", "other").alias("high"),
            "node",
            "label",
        )
    )
    return cut_lineage(
        members.join(sets, "node").groupBy("cluster", "low", "high").applyInArrow(run, "a long, b long")
    )


def _judged(docs: DataFrame) -> DataFrame:
    """doc_id, set_a, set_b, n_shingles, component_id, kept. Texts of one set are a node, numbered, so that
    different texts under one ``doc_id`` are different nodes."""
    base = cut_lineage(profiles(docs))
    sized = base.filter("n_shingles > 0 and doc_id is not null")
    classes = sized.groupBy(*_SET).agg(F.min("doc_id").alias("rep"))
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))
    key = ["doc_id", *_SET]
    known = sized.join(classes.withColumnRenamed("rep", "doc_id"), key).dropDuplicates(key)
    own = cut_lineage(components(linked(docs, cut_lineage(known))))
    least = own.join(classes, "node").groupBy("component").agg(F.min("rep").alias("least"))
    least = cut_lineage(least)
    own = keyed_join(own, least, "component", fits=_small(least, 2)).select("node", "least")
    named = classes.join(own, "node", "left").select(*_SET, F.coalesce("least", "rep").alias("component_id"))
    found = base.drop("bands").join(named, _SET, "left").withColumn(
        "component_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    )
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", *_SET, "n_shingles", "component_id", kept.alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (whether the document is the one that stays)."""
    return _judged(docs).drop(*_SET)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group; columns unchanged."""
    gone = _judged(docs).filter("not kept").select(F.col("doc_id").alias("gone"), *_SET).distinct()
    one, two = fresh(docs, "set_a"), fresh(docs, "set_b")
    same = (F.col("d.doc_id") == F.col("g.gone")) & (F.col(f"d.{one}") == F.col("g.set_a")) & (F.col(f"d.{two}") == F.col("g.set_b"))
    return _with_set_names(docs, one, two).alias("d").join(gone.alias("g"), same, "left_anti").drop(one, two)
