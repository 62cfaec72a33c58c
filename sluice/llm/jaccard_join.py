"""Operator 10, n-gram Jaccard join: an exact self-join in the Jaccard metric space.

Documents are sets of word n-grams; 1 - Jaccard similarity is a metric. Pairs within
``1 - threshold`` of each other, the links, are found in regions around pivots:

1. Equal sets collapse into one class, so a thousand copies cost one point.
2. Between unrelated documents the distance is 1, or nearly, for every choice of pivots:
   triangle windows of 2 * (1 - threshold) then hold everything, and Voronoi regions over
   the whole corpus would each be the corpus. So the first regions are drawn where distances
   can be below 1: each class sorts its n-grams, the longest (rarest) first, and two sets
   within the bound must share at least ``k`` of the first ``m - ceil(threshold * m) + k``. All
   classes with such a leading n-gram form a block, and its smallest class is the block's
   pivot. Classes that share fewer than ``k`` leading n-grams with others are alone; the others
   are points of the regions of the pivots of their blocks, but for those pivots that hold too
   few of the k n-grams to matter, so every close pair still meets in the region of a pivot.
   A pair that meets in several regions is looked at in that of the smallest pivot only.
3. A region picks further pivots (farthest first), gives each point to the nearest one and
   replicates it to every pivot q with d(x, q) <= d(x, nearest) + 2 * (1 - threshold); by
   the triangle inequality no close pair is lost. Sub-regions join recursively. The leaves,
   and regions whose sub-regions have more than half of their pairs, compare pairs: |d(x, q) - d(y, q)| > 1 - threshold for a
   pivot q excludes a pair, d(x, q) + d(y, q) <= 1 - threshold makes it a link unseen, and
   only what lies between is compared n-gram by n-gram.

Regions too large for one task are cut into cells, pairs of chunks; a pair within a chunk is
looked at in that chunk's own cell only. Blocks of n-grams that very many classes share (found
in a sample, which decides on the plan and not on the result) are not gathered: such an n-gram
is a pivot itself. No partner or candidate is dropped anywhere; the result is exact (64-bit
hashes stand for n-grams and sets).

Links are counted where they are found, and a cell returns one row a point: its links and the
smallest class that links of the cell connect it with. So nothing that is written or shuffled
grows with the number of pairs.

Result: (doc_id, class_id, links), one row a document: ``links`` is the number of other
documents within the bound, copies among them, and ``class_id`` the smallest id that links
connect it with, its own where it has none.

Cases: a null id or text, and a text without a word, has no row; a text of fewer than n
words is one n-gram; rows that repeat ``doc_id`` and n-grams are one document, and an id with
several different texts has a row for each; ties can't matter, as all links are counted; texts of
any length are taken whole; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, documents, each_partition, fresh, maybe_broadcast, mix, packed_exchange, partitions, plan_bytes, remove, runs, slices, texts_of, written

N_GRAM = 3
THRESHOLD = 0.6
#: Leading n-grams that a close pair must share, as a part of the smaller set.
SHARED = 0.2
LEAF = 32
PIVOTS = 8
#: Points, and n-grams, of a region that one chunk holds; larger regions are cut into cells.
REGION_POINTS = 2_000
REGION_GRAMS = 2_000_000
#: Classes from which a block isn't gathered by its n-gram, and bytes of text that are sampled to find such n-grams.
HOT_CLASSES = 4_000_000
SAMPLE_BYTES = 16 << 20
#: Bytes of exchanged records for each byte of text.
GROWTH = 2.0


def _at_least(share: float, m: int) -> int:
    return math.ceil(share * m - 1e-9)


def n_gram_sets(texts: list[str], n: int = N_GRAM) -> list[np.ndarray]:
    """Per text the sorted distinct ids of its word n-grams; the longer an n-gram, the lower its id."""
    w = Words(texts)
    count = len(w.hash)
    hashed, size = np.zeros(count, U64), np.zeros(count, np.int64)
    whole = np.diff(w.first) < n
    for k in range(n):
        fits = max(0, count - k)
        inside = w.doc[k:] == w.doc[:fits]
        hashed[:fits] += np.where(inside, mix(w.hash[k:] + U64(k + 1)), U64(0))
        size[:fits] += np.where(inside, w.length[k:], 0)
    ids = (((255 - np.minimum(size, 255)) << 55) | (mix(hashed) >> U64(9)).astype(np.int64)).astype(np.int64)
    out = []
    for a, b, short in zip(w.first, w.first[1:], whole):
        out.append(np.unique(ids[a : min(b, a + 1) if short else b - n + 1]))
    return out


def set_key(ids: np.ndarray) -> int:
    """61 bits that stand for a set."""
    total = np.add.reduce(mix(ids.view(U64))) + U64(len(ids))
    return int(mix(np.array([total], U64))[0] >> U64(3))


def _leading(m: int, threshold: float, shared: float) -> int:
    return min(m, m - _at_least(threshold, m) + max(1, _at_least(shared, m)))


def fewest_shared(m, threshold: float, shared: float, floor=math.floor, ceil=math.ceil, greatest=max):
    """Leading n-grams that a set of ``m`` shares at least with every set within the bound.

    Of the o n-grams that x and y have in common, the first o - (|x| - lead(x)) lead in x, the first
    o - (|y| - lead(y)) lead in y, and the smaller number leads in both. As o >= threshold * max(|x|, |y|),
    it is no less than shared * max(|x|, |y|), up to rounding, where ``shared`` isn't above ``threshold``;
    it always is at least shared * min(|x|, |y|).
    """
    of_larger = shared if shared <= threshold else 0.0
    return greatest(floor(m * of_larger + 1e-9), ceil(m * (shared * threshold) - 1e-9), 1 if greatest is max else F.lit(1))


_SIZE = 1 << 62
_HOT = 1 << 61


def _emit(n: int, threshold: float, shared: float):
    """Records (n-gram, class), (-class - 1, document) and (-class - 1 - 2**62, size)."""

    def emit(batch):
        for part in slices(batch):
            out = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), n_gram_sets(texts_of(part), n)):
                if not len(ids):
                    continue
                key = set_key(ids)
                lead = ids[: _leading(len(ids), threshold, shared)]
                rows = np.empty((len(lead) + 2, 2), np.int64)
                rows[:-2, 0], rows[:-2, 1] = lead, key
                rows[-2], rows[-1] = (-key - 1, doc), (-key - 1 - _SIZE, len(ids))
                out.append(rows)
            if out:
                yield np.concatenate(out)

    return emit


def _is_hot(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams if len(hot) else np.zeros(len(grams), bool)


def _route(hot: np.ndarray):
    """Where a record goes: by its key, but documents of a class and classes of a hot n-gram are spread."""

    def route(rows):
        key, value = rows[:, 0].view(U64), rows[:, 1].view(U64)
        spread = (rows[:, 0] < 0) & (rows[:, 0] >= -_SIZE) | _is_hot(rows[:, 0], hot)
        return mix(np.where(spread, key ^ mix(value), key))

    return route


def _blocks(hot: np.ndarray):
    """(kind, a, b, c): 0 a class's n-grams shared in the region of a pivot, 1 a class's document, 2 its size."""

    def work(rows):
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]
        meta = rows[:, 0] < 0
        about = rows[meta]
        sizes = about[:, 0] < -_SIZE
        key = np.where(sizes, -about[:, 0] - 1 - _SIZE, -about[:, 0] - 1)
        rows = rows[~meta]
        spread = _is_hot(rows[:, 0], hot)
        alone, rows = rows[spread], rows[~spread]
        start, end = runs(rows[:, 0])
        many = np.repeat(end - start > 1, end - start)
        pivot = np.repeat(rows[start, 1] if len(start) else np.empty(0, np.int64), end - start)[many]
        member = rows[many, 1]
        order = np.lexsort((member, pivot))
        pivot, member = pivot[order], member[order]
        new = np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (member[1:] != member[:-1])]) if len(pivot) else np.empty(0, bool)
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(pivot)))
        kind = np.concatenate([np.zeros(len(at) + len(alone), np.int32), np.where(sizes, 2, 1).astype(np.int32)])
        a = np.concatenate([pivot[at], (mix(alone[:, 0]) >> U64(3)).astype(np.int64) | _HOT, key])
        b = np.concatenate([member[at], alone[:, 1], about[:, 1]])
        c = np.concatenate([times, np.ones(len(alone), np.int64), np.zeros(len(about), np.int64)])
        for i in range(0, len(kind), 1 << 17):
            j = i + (1 << 17)
            yield pa.RecordBatch.from_arrays([pa.array(kind[i:j]), pa.array(a[i:j]), pa.array(b[i:j]), pa.array(c[i:j])], ["kind", "a", "b", "c"])

    return work


def hot_grams(read: DataFrame, n: int, threshold: float, shared: float) -> np.ndarray:
    """Leading n-grams of about ``HOT_CLASSES`` classes or more, by a sample of documents.

    There are at most as many as all leading n-grams divided by ``HOT_CLASSES``.
    """
    size = plan_bytes(read)
    if size * GROWTH < 16 * HOT_CLASSES:
        return np.empty(0, np.int64)
    share = min(1.0, max(SAMPLE_BYTES / size, 8 / HOT_CLASSES))

    def lead(batches):
        for batch in batches:
            for rows in _emit(n, threshold, shared)(batch):
                rows = np.unique(rows[rows[:, 0] >= 0], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["gram", "class"])

    sample = read.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40)) < int(share * (1 << 40)))
    found = sample.mapInArrow(lead, "gram long, class long").distinct().groupBy("gram").count().where(F.col("count") >= max(2, HOT_CLASSES * share))
    return np.sort(np.array([r[0] for r in found.select("gram").collect()], np.int64))


class Sets:
    """Sets over a dense numbering of their members."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.fromiter(map(len, sets), np.int64, len(sets))
        found, dense = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = np.split(dense.astype(np.int32), np.cumsum(self.size)[:-1])
        self.flags = np.zeros(len(found), bool)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """Size of the intersection of set x with each of the others."""
        size = self.size[others]
        out = np.zeros(len(others), np.int64)
        filled = np.flatnonzero(size)
        if len(filled) and self.size[x]:
            self.flags[self.ids[x]] = True
            out[filled] = np.add.reduceat(self.flags[np.concatenate([self.ids[o] for o in others[filled]])], np.cumsum(size[filled]) - size[filled], dtype=np.int64)
            self.flags[self.ids[x]] = False
        return out


class Region:
    """Points of a region and the links among them: between the two sides, where there are any.

    ``weight`` is a point's number of documents. Two points of which the ``earlier`` sets meet
    are left to another region. ``links`` has the weight that each point is linked with, and
    ``label`` the first point that links of the region connect it with.
    """

    def __init__(self, sets: list[np.ndarray], threshold: float, weight: np.ndarray | None = None, earlier: list[np.ndarray] | None = None, side: np.ndarray | None = None):
        self.sets, self.threshold, self.eps = Sets(sets), threshold, 1 - threshold + 1e-9
        self.weight = np.ones(len(sets), np.int64) if weight is None else weight
        self.earlier = Sets(earlier) if earlier is not None and any(map(len, earlier)) else None
        self.side = side
        self.links, self.label = np.zeros(len(sets), np.int64), np.arange(len(sets))
        self.pairs: list[tuple[int, int]] | None = None
        self.compared = self.inferred = 0

    def distance(self, x: int, others: np.ndarray) -> np.ndarray:
        both = self.sets.common(x, others)
        return 1 - both / (self.sets.size[x] + self.sets.size[others] - both)

    def link(self, x: int, others: np.ndarray) -> None:
        self.links[x] += self.weight[others].sum()
        self.links[others] += self.weight[x]
        if self.pairs is not None:
            self.pairs += [(min(x, y), max(x, y)) for y in others.tolist()]
        low = np.unique(np.append(self.label[others], self.label[x]))
        if len(low) > 1:
            self.label[np.isin(self.label, low)] = low[0]

    def compare(self, points: np.ndarray, to_pivots: np.ndarray, met: np.ndarray) -> None:
        """All pairs of points that their distances to the pivots leave possible."""
        order = np.argsort(to_pivots[:, 0], kind="stable")
        points, to_pivots, met = points[order], to_pivots[order], met[order]
        ends = np.searchsorted(to_pivots[:, 0], to_pivots[:, 0] + self.eps, side="right")
        size = self.sets.size[points]
        for i, x in enumerate(points[:-1].tolist()):
            at = np.arange(i + 1, ends[i])
            a, b = size[at], size[i]
            at = at[(np.minimum(a, b) >= self.threshold * np.maximum(a, b) - 1e-9) & (met[at] & met[i] == 0)]
            if self.side is not None:
                at = at[self.side[points[at]] != self.side[x]]
            at = at[(np.abs(to_pivots[at] - to_pivots[i]) <= self.eps).all(axis=1)]
            if self.earlier is not None and self.earlier.size[x]:
                at = at[self.earlier.common(x, points[at]) == 0]
            if not len(at):
                continue
            # Within the bound by the triangle inequality, with room for rounding.
            sure = (to_pivots[at] + to_pivots[i]).min(axis=1) <= self.eps - 2e-9
            rest = points[at[~sure]]
            both = self.sets.common(x, rest)
            close = both / (self.sets.size[x] + self.sets.size[rest] - both) >= self.threshold
            self.inferred, self.compared = self.inferred + int(sure.sum()), self.compared + len(rest)
            found = np.concatenate([points[at[sure]], rest[close]])
            if len(found):
                self.link(x, found)

    def join(self, points: np.ndarray, met: np.ndarray | None = None, level: int = 0) -> None:
        """``met`` has a bit for each sub-region of a level above in which a point has been looked at."""
        if len(points) < 2:
            return
        met = np.zeros(len(points), np.int64) if met is None else met
        if len(points) <= LEAF:
            self.compare(points, self.distance(points[0], points)[:, None], met)
            return
        pivots, columns = [int(points[0])], [self.distance(points[0], points)]
        while len(pivots) < PIVOTS:
            nearest = np.min(columns, axis=0)
            far = int(np.argmax(nearest))
            if nearest[far] <= 0:
                break
            pivots.append(int(points[far]))
            columns.append(self.distance(points[far], points))
        d = np.stack(columns, axis=1)
        windows = d <= d.min(axis=1, keepdims=True) + 2 * self.eps
        # Windows overlap: only where they have half the region's pairs at most together is the work of all levels bounded by it.
        if (level + 1) * PIVOTS > 62 or (windows.sum(axis=0) ** 2).sum() > len(points) ** 2 / 2:
            self.compare(points, d, met)
            return
        for k in range(len(pivots)):
            here = windows[:, k]
            self.join(points[here], met[here], level + 1)
            met = met | here.astype(np.int64) << (level * PIVOTS + k)


def close_pairs(sets: list[np.ndarray], threshold: float = THRESHOLD) -> set[tuple[int, int]]:
    """(i, j) of all pairs of sets at or above the threshold, by recursive pivots."""
    if len(sets) < 2:
        return set()
    region = Region(sets, threshold)
    region.pairs = []
    region.join(np.arange(len(sets)))
    assert len(region.pairs) == len(set(region.pairs))
    return set(region.pairs)


def linked_classes(docs: DataFrame, n: int = N_GRAM, threshold: float = THRESHOLD, shared: float = SHARED) -> tuple[DataFrame, DataFrame]:
    """(class, doc_id) of all documents with a word, and (class, low, links) of each class in each cell where it has links: written tables."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    hot = hot_grams(read, n, threshold, shared)
    exchanged = packed_exchange(read, _emit(n, threshold, shared), 2, growth=GROWTH, route=_route(hot))
    found = written(each_partition(exchanged, _blocks(hot), 2, "kind int, a long, b long, c long"), "ngram-blocks")
    members = written(found.where("kind = 1").select(F.col("a").alias("class"), F.col("b").alias("doc_id")), "ngram-members")
    size = found.where("kind = 2").select(F.col("a").alias("member"), F.col("b").alias("size")).distinct()
    linked = found.where("kind = 0").groupBy(F.col("a").alias("pivot"), F.col("b").alias("member")).agg(F.sum("c").alias("c"))
    # A close pair shares k leading n-grams, k at least ``least`` of both classes. A class with fewer
    # shared ones in all has no partner. Pivots that hold few of them, less than half of ``least``
    # together, can go: what two classes leave out together can't be all k of them.
    each = Window.partitionBy("member")
    least = fewest_shared(F.col("size"), threshold, shared, F.floor, F.ceil, F.greatest)
    ranked = linked.join(size, "member").withColumn("least", least).withColumn("all", F.sum("c").over(each)).withColumn("up", F.sum("c").over(each.orderBy("c", "pivot").rowsBetween(Window.unboundedPreceding, 0)))
    before = each.orderBy("pivot").rowsBetween(Window.unboundedPreceding, -1)
    points = written(ranked.where("all >= least and 2 * up > least - 1").select("pivot", "member", "size", F.collect_list("pivot").over(before).alias("earlier")), "ngram-regions")
    remove(found)
    regions = points.groupBy("pivot").agg(F.count(F.lit(1)).alias("points"), F.sum("size").alias("grams")).where("points > 1")
    # Cells: chunk pairs i <= j of a region; one cell for regions of the usual size.
    chunks = F.ceil(F.greatest(F.col("points") / REGION_POINTS, F.col("grams") / REGION_GRAMS)).cast("int")
    cell = F.struct(F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"))
    placed = points.join(regions.select("pivot", chunks.alias("chunks")), "pivot").withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int"))
    placed = placed.select("pivot", "member", "earlier", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k")).select("pivot", "member", "earlier", "chunk", cell.alias("cell"))

    # Sets of points that are alone in all their regions aren't needed.
    wanted = members.join(points.join(regions, "pivot", "left_semi").select(F.col("member").alias("class")).distinct(), "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    wanted = written(wanted, "ngram-wanted")
    chosen = read.join(maybe_broadcast(wanted, wanted.count(), 40), "doc_id")

    def sets(batches):
        for batch in batches:
            for part in slices(batch):
                rows = [(c, w, ids.tobytes()) for c, w, ids in zip(part.column("class").to_pylist(), part.column("copies").to_pylist(), n_gram_sets(texts_of(part), n)) if len(ids) and set_key(ids) == c]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["class", "copies", "ids"])

    contents = chosen.mapInArrow(sets, "class long, copies long, ids binary").dropDuplicates(["class"])
    held = placed.join(contents, placed["member"] == contents["class"]).select("pivot", "cell.i", "cell.j", "member", (F.col("chunk") == F.col("cell.i")).alias("side"), "copies", "earlier", "ids")
    held = held.repartition(partitions(read, 0.5), "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "member")

    def join(batches):
        now, rows = None, []

        def links():
            if len(rows) < 2:
                return
            member, side, copies, earlier, ids = zip(*rows)
            region = Region(list(ids), threshold, np.array(copies), list(earlier), np.array(side) if now[1] != now[2] else None)
            region.join(np.arange(len(rows)))
            linked = np.flatnonzero(region.links)
            if len(linked):
                member = np.array(member, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(member[linked]), pa.array(member[region.label[linked]]), pa.array(region.links[linked])], ["class", "low", "links"])

        for batch in batches:
            for p, i, j, member, side, copies, earlier, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (p, i, j) != now:
                    yield from links()
                    now, rows = (p, i, j), []
                rows.append((member, side, copies, np.array(earlier, np.int64), np.frombuffer(data, np.int64)))
        yield from links()

    links = written(held.mapInArrow(join, "class long, low long, links long"), "ngram-links")
    remove(points, wanted)
    return members, links


def near_duplicates(docs: DataFrame, n: int = N_GRAM, threshold: float = THRESHOLD, shared: float = SHARED) -> DataFrame:
    """(doc_id, class_id, links): see the module."""
    return _near_duplicates(docs, n, threshold, shared)[0]


def _near_duplicates(docs: DataFrame, n: int, threshold: float, shared: float) -> tuple[DataFrame, list[DataFrame]]:
    """The result and the written tables that it reads."""
    members, found = linked_classes(docs, n, threshold, shared)
    classes = members.groupBy("class").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    connected = components(found.where("class <> low").select(F.col("class").alias("a"), F.col("low").alias("b")))
    labels = connected.select(F.col("id").alias("class"), "label")
    group = labels.join(classes, "class").groupBy("label").agg(F.min("first").alias("group"))
    near = labels.join(group, "label").join(found.groupBy("class").agg(F.sum("links").alias("near")), "class").select("class", "group", "near")
    known = classes.join(near, "class", "left").select("class", F.coalesce("group", "first").alias("class_id"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return members.join(known, "class").select("doc_id", "class_id", "links"), [members, found, connected]


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of a written table: the smallest id that each id in ``edges`` (a, b) is connected with.

    Smallest labels spread along the edges and by pointer jumps, so rounds grow with the
    logarithm of a component's diameter; each round is a written table.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("low"))
        low = labels.join(around, "id").select("id", F.col("label").alias("was"), F.least("label", "low").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("label").alias("jump"))
        new = written(low.join(up, "low").select("id", "was", F.least("low", "jump").alias("label")), "labels")
        remove(labels)
        labels = new
        if new.where("label <> was").isEmpty():
            remove(both)
            return labels


def one_of_each_group(docs: DataFrame, n: int = N_GRAM, threshold: float = THRESHOLD, shared: float = SHARED) -> DataFrame:
    """``docs`` without near duplicates: of each connected group the smallest ``doc_id`` stays.

    Rows that take no part (see the module) stay; all columns are kept. An id with several
    different texts goes if one of them is near a text of a smaller id.
    """
    name = fresh(docs, "__gone")
    found, tables = _near_duplicates(docs, n, threshold, shared)
    gone = written(found.where("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct(), "near-duplicates")
    remove(*tables)
    gone = maybe_broadcast(gone, gone.count(), 32)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


LINKS_CTES = """
w as (select doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}]+'), lambda x: lower(x)) as ws
      from {documents} where doc_id is not null and text is not null),
s as (select distinct doc_id, unnest(list_transform(generate_series(1, greatest(1, len(ws) - {n} + 1)), lambda i: array_to_string(ws[i:i + {n} - 1], ' '))) as g
      from w where len(ws) > 0),
d as (select doc_id, count(*) as m, md5(string_agg(g, '|' order by g)) as k from s group by doc_id),
f as (select k, min(doc_id) as first, any_value(m) as m, count(*) as copies from d group by k),
fs as (select f.first, f.m, s.g from f join s on s.doc_id = f.first),
inter as (select a.first as a, b.first as b, any_value(a.m) as ma, any_value(b.m) as mb, count(*) as c
          from fs a join fs b on a.g = b.g and a.first < b.first group by a.first, b.first),
half as (select a, b from inter where c::double / (ma + mb - c) >= {threshold}),
both_ways as (select a, b from half union all select b, a from half),
reach as (select first as id, first as low from f union select e.a, r.low from reach r join both_ways e on e.b = r.id),
lowest as (select id, min(low) as low from reach group by id),
near as (select e.a as id, sum(f.copies) as near from both_ways e join f on f.first = e.b group by e.a),
classes as (select d.doc_id, l.low as class_id, f.copies - 1 + coalesce(near.near, 0) as links
            from d join f using (k) join lowest l on l.id = f.first left join near on near.id = f.first)
"""


def links_ctes(table: str = "documents", n: int = N_GRAM, threshold: float = THRESHOLD) -> str:
    return LINKS_CTES.replace("{documents}", table).replace("{n}", str(n)).replace("{threshold}", str(threshold))


ORACLE = "with recursive " + links_ctes() + "select doc_id, class_id, links::bigint as links from classes"
