"""Exact n-gram Jaccard join by prefix trees: components of documents whose shingle sets are alike.

1. Each text becomes the sorted hashes of its distinct shingles. Equal sets are one class.
2. A set that is linked misses at most ``n - ceil(t n)`` elements of its partner, so of its smallest hashes (twice as many as it
   may miss, and one) a known number occur in another set, too. Counting those alone, over all documents, leaves few sets;
   the same test on all elements of those leaves the survivors, with the frequency of every element that is shared.
3. Survivors that agree on a minimum hash are joined in a prefix tree (``PrefixTree``): sets are paths in one global
   order, partial overlaps are shared by all sets below a node, and a subtree is left when the elements that remain
   can't reach the overlap that its smallest set needs. A subtree whose sets are all of the probe's component is left, too, so a
   group of n near copies takes about n walks, not n * n pairs.
4. What that may have missed: two linked sets share an element among the rarest ``n - ceil(t n) + 1`` of each. Components
   that meet at such an element are joined by prefix trees again, a cluster of components at a time, large ones in pairs of parts.
5. Components of all links.

A text without words, or null, has the empty set: it is linked with nothing. Equal sets that are not empty are linked. Rows that are repeated
count as documents; a component is named by its smallest key (null keys have no say, a component of null keys only is null). An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import materialize, slices
from mapweave.llm.components import components
from mapweave.llm.shingles import mix, shingle_sets

WORDS, PERCENT = 4, 85
BUCKET_ENTRIES = 500_000  # elements that one task counts at a time, 16 bytes each
GROUP = 2048  # sets in one prefix tree
FILTER_BITS = 1 << 26  # 8 MB; more candidates than it tells apart only let more sets through to the exact join
KEYS = 3


def least_overlap(n: int, percent: int) -> int:
    """Elements that a set of n has in common with any set it is linked with, at least."""
    return -(-percent * n // 100)


def probe_of(found: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """A set's smallest hashes, and how many of them occur among the smallest of any set it is linked with, at least."""
    n = len(found)
    may_miss = n - least_overlap(n, percent)
    smallest = least_overlap(n, percent)  # size of the smallest partner
    return found[: min(n, 2 * may_miss + 1)], min(may_miss, smallest - least_overlap(smallest, percent)) + 1


def shingled(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """key, text_hash, n, s1, s2 (the set's identity), probe (packed hashes) and need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part["text"], words)
                probes = [probe_of(s, percent) if len(s) else (s, 1) for s in sets]
                yield pa.record_batch([
                    part["key"], part["text_hash"], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets], pa.int64()),
                    pa.array([int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x9E3779B97F4A7C15)), initial=np.uint64(len(s))).astype(np.int64)) for s in sets], pa.int64()),
                    pa.array([p.tobytes() for p, _ in probes], pa.binary()), pa.array([n for _, n in probes], pa.int64())],
                    names=["key", "text_hash", "n", "s1", "s2", "probe", "need"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, text_hash long, n long, s1 long, s2 long, probe binary, need long")


def _grouped(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, where each run begins, and the length of each run."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)
    return order, begins, np.diff(np.append(begins, len(ordered)))


def _to_buckets(buckets: int):
    """Packs (set id, hashes) into one row per bucket, some millions of entries at a time.

    All entries of a hash go to one bucket, 16 bytes for each set that has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            all_ids = np.repeat(np.array(ids, dtype=np.int64), [len(h) for h in hashes])
            all_hashes = np.concatenate(hashes)
            place = (mix(all_hashes ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((all_hashes, place))
            all_ids, all_hashes, place = all_ids[order], all_hashes[order], place[order]
            edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            out = []
            for low, high in zip(edges, np.append(edges[1:], len(place)), strict=True):
                out.append((int(place[low]), all_hashes[low:high].tobytes(), all_ids[low:high].tobytes()))
                if len(out) == 256 or high == len(place):
                    yield pa.record_batch([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)],
                                          names=["bucket", "hashes", "ids"])
                    out = []

        for batch in batches:
            for i in range(batch.num_rows):
                found = np.frombuffer(batch["hashes"][i].as_py(), dtype=np.uint64)
                if len(found):
                    ids.append(batch["id"][i].as_py())
                    hashes.append(found)
                    size += len(found)
                if size >= BUCKET_ENTRIES:
                    yield from flush()
                    ids, hashes, size = [], [], 0
        if size:
            yield from flush()

    return run


def _count_shared(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's entries those whose hash several sets have: ids, hashes and the numbers of sets."""
    hashes = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in table["hashes"]])
    ids = np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64) for x in table["ids"]])
    order, begins, lengths = _grouped(hashes)
    sets = np.repeat(lengths, lengths)
    shared = sets > 1
    return ids[order][shared], hashes[order][shared], sets[shared]


def _buckets_for(entries: int) -> int:
    return max(64, -(-entries // BUCKET_ENTRIES))


def shared_counts(sets: DataFrame) -> DataFrame:
    """id, shared: how many of the hashes of each row (id, hashes, packed) other rows have, too."""
    entries = sets.agg(F.sum(F.octet_length("hashes")) / 8).first()[0] or 0
    spread = sets.select("id", "hashes").mapInArrow(_to_buckets(_buckets_for(int(entries))), "bucket long, hashes binary, ids binary")

    def count(table: pa.Table) -> pa.Table:
        ids, _, _ = _count_shared(table)
        found, n = np.unique(ids, return_counts=True)
        return pa.table({"id": pa.array(found, pa.int64()), "shared": pa.array(n, pa.int64())})

    return spread.groupBy("bucket").applyInArrow(count, "id long, shared long").groupBy("id").agg(F.sum("shared").alias("shared"))


def ordered_sets(sets: DataFrame) -> DataFrame:
    """id, tokens: the hashes of each row that other rows have, too, rarest first (packed), with their frequencies used for the order only."""
    entries = sets.agg(F.sum(F.octet_length("hashes")) / 8).first()[0] or 0
    spread = sets.select("id", "hashes").mapInArrow(_to_buckets(_buckets_for(int(entries))), "bucket long, hashes binary, ids binary")

    def count(table: pa.Table) -> pa.Table:
        ids, hashes, n = _count_shared(table)
        order = np.argsort(ids, kind="stable")
        ids, hashes, n = ids[order], hashes[order], n[order].astype(np.int64)
        found, begins = np.unique(ids, return_index=True)
        ends = np.append(begins[1:], len(ids))[: len(found)]
        return pa.table({
            "id": pa.array(found, pa.int64()),
            "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()),
            "counts": pa.array([n[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())})

    parts = spread.groupBy("bucket").applyInArrow(count, "id long, hashes binary, counts binary")
    gathered = parts.groupBy("id").agg(F.collect_list(F.struct("hashes", "counts")).alias("parts"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch["parts"]:
                parts = parts.as_py()
                hashes = np.concatenate([np.frombuffer(p["hashes"], dtype=np.uint64) for p in parts])
                counts = np.concatenate([np.frombuffer(p["counts"], dtype=np.int64) for p in parts])
                out.append(hashes[np.lexsort((hashes, counts))].tobytes())
            yield pa.record_batch([batch["id"], pa.array(out, pa.binary())], names=["id", "tokens"])

    return gathered.mapInArrow(merge, "id long, tokens binary")


class _Node:
    __slots__ = ("edge", "children", "sets", "smallest", "deepest", "component")

    def __init__(self, edge: np.ndarray):
        self.edge, self.children, self.sets = edge, {}, []
        self.smallest, self.deepest, self.component = 1 << 62, 0, -2  # -2: no set yet, -1: several components


class PrefixTree:
    """Sets as paths of elements in one order; ``add`` links a set with those of the tree that are alike, then puts it in.

    A set is given by its elements that others share, as ranks of the tree's order, and by its whole size.
    """

    def __init__(self, vocabulary: int, percent: int):
        self.root, self.percent = _Node(np.zeros(0, dtype=np.int64)), percent
        self.mask = np.zeros(vocabulary, dtype=bool)
        self.parent: list[int] = []
        self.links: list[tuple[int, int]] = []
        self.sizes: list[int] = []

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def _alike(self, overlap: int, n: int, m: int) -> bool:
        return (100 + self.percent) * overlap >= self.percent * (n + m)

    def add(self, number: int, elements: np.ndarray, size: int) -> None:
        """``number``: 0, 1, 2, ... in the order of calls; ``parent`` already holds it (its own number, or an earlier set known to be linked)."""
        self.sizes.append(size)
        self.mask[elements] = True
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.component >= 0 and self.find(node.component) == self.find(number):
                continue
            if len(node.edge):
                overlap += int(np.count_nonzero(self.mask[node.edge]))
                left = len(elements) - int(np.searchsorted(elements, node.edge[-1], side="right"))
            else:
                left = len(elements)
            if not self._alike(overlap + min(left, node.deepest), size, node.smallest):
                continue
            for other in node.sets:
                if self._alike(overlap, size, self.sizes[other]) and self.find(other) != self.find(number):
                    self.links.append((other, number))
                    self.join(other, number)
            # the likeliest way is walked first
            ways = sorted(node.children.items(), key=lambda x: (self.mask[x[0]], -x[0]))
            stack += [(child, overlap) for _, child in ways]
        self.mask[elements] = False
        self._insert(number, elements, size)

    def _insert(self, number: int, elements: np.ndarray, size: int) -> None:
        node, at = self.root, 0
        component = self.find(number)
        while True:
            node.smallest = min(node.smallest, size)
            node.deepest = max(node.deepest, len(elements) - at)
            if node.component == -2:
                node.component = component
            elif node.component >= 0 and self.find(node.component) != component:
                node.component = -1
            if at == len(elements):
                node.sets.append(number)
                return
            child = node.children.get(int(elements[at]))
            if child is None:
                child = _Node(elements[at:].copy())
                node.children[int(elements[at])] = child
                at = len(elements)
                node = child
                continue
            most = min(len(child.edge), len(elements) - at)
            differ = np.flatnonzero(child.edge[:most] != elements[at: at + most])
            same = int(differ[0]) if len(differ) else most
            if same < len(child.edge):  # the edge splits where the set leaves it
                upper = _Node(child.edge[:same])
                child.edge = child.edge[same:]
                upper.children[int(child.edge[0])] = child
                upper.smallest, upper.component = child.smallest, child.component
                upper.deepest = child.deepest + len(child.edge)
                node.children[int(elements[at])] = upper
                child = upper
            at += same
            node = child


def _joined(ids: list[int], sizes: list[int], tokens: list[np.ndarray], labels: list[int] | None, percent: int) -> list[tuple[int, int]]:
    """Links (pairs of ids) that connect what is alike; sets of one label are taken as connected."""
    every = np.concatenate(tokens)
    values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), dtype=np.int64)
    rank[np.lexsort((values, -counts))] = np.arange(len(values))  # frequent elements first: long paths are shared
    ranks = rank[inverse]
    ends = np.cumsum([len(t) for t in tokens])
    paths = [np.sort(ranks[b - len(t): b]) for t, b in zip(tokens, ends, strict=True)]
    order = sorted(range(len(ids)), key=lambda i: (sizes[i], ids[i]))
    tree, first = PrefixTree(len(values), percent), {}
    for number, i in enumerate(order):
        tree.parent.append(number if labels is None else first.setdefault(labels[i], number))
        tree.add(number, paths[i], sizes[i])
    if not tree.links:
        return []
    # a star for each component that has grown, its smallest id in the middle: few rounds name all
    grown = {tree.find(a) for a, _ in tree.links}
    members: dict[int, list[int]] = {}
    for number, i in enumerate(order):
        if (root := tree.find(number)) in grown:
            members.setdefault(root, []).append(ids[i])
    return [(low, x) for group in members.values() for low in [min(group)] for x in group if x != low]


def _tree_join(percent: int, labelled: bool):
    def run(table: pa.Table) -> pa.Table:
        ids = table["id"].to_pylist()
        links = []
        if len(ids) > 1:
            tokens = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table["tokens"]]
            links = _joined(ids, table["n"].to_pylist(), tokens, table["label"].to_pylist() if labelled else None, percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some minimum hashes of every set: sets that are alike agree on each with a chance of their similarity."""
    for batch in batches:
        out = []
        for tokens in batch["tokens"]:
            hashes = np.frombuffer(tokens.as_py(), dtype=np.uint64)
            out.append([int(mix(hashes ^ np.uint64(0x2545F4914F6CDD1D * (j + 1) % (1 << 64))).min().astype(np.int64)) for j in range(KEYS)])
        yield pa.record_batch([batch["id"], pa.array(out, pa.list_(pa.int64()))], names=["id", "keys"])


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tokens, n in zip(batch["tokens"], batch["n"].to_pylist(), strict=True):
                hashes = np.frombuffer(tokens.as_py(), dtype=np.int64)
                alone = n - len(hashes)  # elements that no other set has come first
                out.append(hashes[: max(0, n - least_overlap(n, percent) + 1 - alone)])
            yield pa.record_batch([batch["id"], pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], names=["id", "prefix"])

    return run


def survivors(docs: DataFrame, sets: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """id, n, s1, s2, tokens (rarest first) of the classes of sets that may be linked with another class."""
    spark = docs.sparkSession
    counts = shared_counts(sets.select(F.col("row_no").alias("id"), F.col("probe").alias("hashes")))
    near = sets.select("row_no", "need", "s1", "s2", "n", "text_hash").join(counts, F.col("row_no") == F.col("id")).where("shared >= need")
    # one text of each class; every class has an id of its own from here on
    classes = materialize(near.groupBy("s1", "s2", "n").agg(F.min("text_hash").alias("text_hash")).withColumn("id", F.monotonically_increasing_id()))
    bits = classes.select((F.pmod("text_hash", F.lit(FILTER_BITS)) + 1).alias("bit")).groupBy(
        F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in bits:  # bucket p = 1, 2, ... holds 4096 bytes
        table[(r["part"] - 1) * 4096: r["part"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    table = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            bit = np.mod(batch["text_hash"].to_numpy(), FILTER_BITS)
            keep = (known[bit // 8] >> (bit % 8).astype(np.uint8)) & 1 == 1
            batch = batch.filter(pa.array(keep))
            for a, b in slices(batch["text"]):
                found = shingle_sets(batch["text"].slice(a, b - a), words)
                yield pa.record_batch([batch["text_hash"].slice(a, b - a), pa.array([len(s) for s in found], pa.int64()),
                                       pa.array([s.tobytes() for s in found], pa.binary())], names=["text_hash", "n", "hashes"])

    texts = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    whole = texts.mapInArrow(run, "text_hash long, n long, hashes binary").dropDuplicates(["text_hash", "n"])
    whole = materialize(classes.join(whole, ["text_hash", "n"]).drop("text_hash"))
    table.destroy()
    return materialize(whole.drop("hashes").join(ordered_sets(whole), "id").where(F.octet_length("tokens") / 8 * 100 >= percent * F.col("n")))


def _in_groups(rows: DataFrame, group: str, sets: DataFrame, pairs: bool) -> DataFrame:
    """Adds sub and other (parts of groups of more than GROUP rows) and the sets. ``pairs``: every two parts meet, else each is alone."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    parts = F.ceil(F.col("_n") / GROUP).cast("int")
    placed = rows.join(counts, group).withColumn("sub", F.pmod(F.xxhash64("id", group), parts).cast("int"))
    if pairs:
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        placed = placed.withColumns({"sub": F.least("sub", "other"), "other": F.greatest("sub", "other")})
    else:
        placed = placed.withColumn("other", F.lit(0))
    return placed.drop("_n").join(sets.select("id", "n", "tokens"), "id")


def _clusters(mixed: DataFrame) -> DataFrame:
    """id, label, key: the groups in which sets that share a rare element (id, token, label) meet.

    Components that share elements, however far apart, make a cluster, in which each set is once. Only a cluster so large that
    its parts would take more rows than its elements is left as a group for each element; either way all pairs meet.
    """
    cluster = components(mixed.select(F.col("label").alias("a"), F.col("token").alias("b")))
    placed = mixed.join(cluster.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label")
    sizes = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct("id").alias("_sets"))
    whole = F.ceil(F.col("_sets") / GROUP) * F.col("_sets") <= F.col("_rows")
    key = F.struct(whole.alias("whole"), F.when(whole, F.col("cluster")).otherwise(F.col("token")).alias("of"))
    return placed.join(sizes, "cluster").select("id", "label", key.alias("key")).distinct()


def labels_of(sets: DataFrame, percent: int) -> DataFrame:
    """id, label of the survivors that are linked: the smallest id of the component."""
    keyed = sets.select("id", "tokens").mapInArrow(_keys, "id long, keys array<bigint>").select("id", F.posexplode("keys").alias("no", "key"))
    keyed = keyed.select("id", F.struct("no", "key").alias("key"))
    stars = materialize(_in_groups(keyed, "key", sets, pairs=False).groupBy("key", "sub", "other").applyInArrow(_tree_join(percent, False), "a long, b long"))
    known = components(stars)
    rare = sets.select("id", "n", "tokens").mapInArrow(_prefixes(percent), "id long, prefix array<bigint>").select("id", F.explode("prefix").alias("token"))
    rare = materialize(rare.join(known.select(F.col("node").alias("id"), "label"), "id", "left").select("id", "token", F.coalesce("label", "id").alias("label")))
    # only elements whose sets are of several components can hold a new link
    mixed = rare.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("token")
    rest = _in_groups(_clusters(materialize(rare.join(mixed, "token"))), "key", sets, pairs=True)
    more = rest.groupBy("key", "sub", "other").applyInArrow(_tree_join(percent, True), "a long, b long")
    # links between components: what is known of them is not looked for again
    ends = more.select("a", "b")
    for end in ("a", "b"):
        named = known.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
        ends = ends.join(named, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    joined = components(ends.where("a <> b"))
    both = known.join(joined.withColumnRenamed("label", "_low").withColumnRenamed("node", "label"), "label", "left").select(
        F.col("node").alias("id"), F.coalesce("_low", "label").alias("label"))
    # sets that were alone until now
    alone = joined.join(known, "node", "left_anti").select(F.col("node").alias("id"), "label")
    return both.union(alone)


def classified(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """key, text_hash, n and component_id of every row."""
    sets = materialize(shingled(docs, key, text, words, percent).withColumn("row_no", F.monotonically_increasing_id()))
    near = survivors(docs, sets, text, words, percent)
    classes = materialize(near.select("id", "s1", "s2", "n").join(labels_of(near, percent), "id"))
    # every row's class, then the smallest key of the class, then of its component
    smallest = sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("key").alias("least"))
    joined = materialize(smallest.join(classes, ["s1", "s2", "n"], "left"))
    of_label = joined.where("label IS NOT NULL").groupBy("label").agg(F.min("least").alias("lowest"))
    named = joined.join(of_label, "label", "left").select("s1", "s2", "n", F.coalesce("lowest", "least").alias("component_id"))
    rows = sets.select("key", "text_hash", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    return rows.select("key", "text_hash", "n", F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id")).alias("component_id"))


def similar_components(docs: DataFrame, key: str, text: str, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key``, n_shingles and component_id of every row."""
    return classified(docs, key, text, words, percent).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def first_of_components(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest key stays.

    Texts without words stay, repeated rows of one key and text are one row. Rows without a key go if their component has a key; in a
    component without any key every different text stays. Only what goes is joined to the texts.
    """
    rows = materialize(classified(docs, key, text, words, percent).where("n > 0"))
    gone = materialize(rows.where(~F.col("key").eqNullSafe(F.col("component_id"))).select("key", "text_hash").distinct())
    again = materialize(rows.where(F.col("key").eqNullSafe(F.col("component_id"))).groupBy("key").agg(
        F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key"))
    hashed = docs.withColumn("_hash", F.xxhash64(text))
    left = hashed.join(gone, hashed[key].eqNullSafe(gone["key"]) & (hashed["_hash"] == gone["text_hash"]), "left_anti")
    once = left.join(again, left[key].eqNullSafe(again["key"]), "left_anti")
    several = left.join(again, left[key].eqNullSafe(again["key"]), "left_semi")
    # rows of one key that stays: one of them, the null key one of each text
    chosen = several.withColumn("_own", F.when(F.col(key).isNull(), F.col("_hash"))).dropDuplicates([key, "_own"]).drop("_own")
    return once.unionByName(chosen).select(*docs.columns)
