"""N-gram Jaccard join with count-vector R-trees.

A document's set is its distinct five-word shingles, as 64-bit hashes. Documents with equal sets are one node from the start.
Two nodes of sizes a and b can only reach a similarity of 0.8 if they share one of the first a - ceil(0.8 a) + 1 of a's and
of b's shingles in any one order; ours puts shingles last that a sample of documents shows to be frequent, so that blocks of
nodes with such a shingle in common stay small. Shingles that share exactly the same nodes make one block. In each block the
nodes' count vectors (shingles hashed into groups, more of them for larger sets) are packed into an R-tree, and a node can only
link to another if the sum of the minima of their counts reaches the overlap that 0.8 needs; a subtree's bound uses its largest
counts and its sizes. What the bound leaves is not listed as pairs: a block reports which of its nodes hang together, at most
one edge a node. Components of these edges, over all blocks, are clusters, outside of which no link can be. A cluster's full
sets then meet, an R-tree proposes candidates again and exact intersection verifies them; a node once linked is not compared
with nodes it already hangs together with.

Nothing unbounded meets in one task: nodes with one shingle are dealt into parts of ``PART``, a cluster's sets into parts of
``CLUSTER`` shingles, and every two parts of one block or cluster meet in a task of their own (one part meets itself). All
sizes go the same way, and no link is lost.

Cases: words are cut at ASCII blanks and A-Z lower-cased; fewer than five words are one shingle; null, empty and blank texts
have no set and link with nothing; repeated rows have equal sets and link; null ids take part, but a component's id is null
only if all of its ids are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomry.llm.common import binary_values, discard, read, row_slices, screened, staged, tidy

WORDS = 5
#: Similarity as a fraction: 80 of 100.
PER, OF = 80, 100
#: Groups of a count vector: a power of two, about a sixth of the set's size, so that the bound stays sharp for long texts.
LEAST_GROUPS, MOST_GROUPS, PER_GROUP = 16, 1024, 6
#: Nodes of a block, and shingles of a cluster's sets, that are one part: two parts meet in a task.
PART, CLUSTER = 8_192, 2_000_000
#: The order of shingles is learned from one document in ``ONE_IN``, ``SAMPLE`` at least; of what they show the ``FREQUENT``
#: most frequent shingles are kept. Only the order depends on this, never a result.
ONE_IN, SAMPLE, FREQUENT = 64, 16_384, 100_000
LEAF = 16
CACHE = 60_000
#: A text of which there are more rows than this share of all (at most 1,000 texts then) is joined apart.
HOT_SHARE = 1000
#: Bytes of text whose sets are made at once.
PIECE = 4_000_000


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, hashes: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(hashes) > CACHE:
        hashes.clear()
    w = np.array([hashes[x] for x in words], dtype=np.uint64)
    n = max(1, len(w) - WORDS + 1)
    h = np.full(n, np.uint64(min(len(w), WORDS)))
    for k in range(min(len(w), WORDS)):
        h = h * ODD + w[k : k + n]
    return np.unique(mixed(h))


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """The least overlap of sets of sizes a and b with OF * overlap >= PER * union."""
    return -(-PER * (a + b) // (OF + PER))


def prefix_size(n: int) -> int:
    return n + (PER * n) // -OF + 1


def signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def counts_of(s: np.ndarray) -> np.ndarray:
    """Group counts. They saturate at 255, which stands for any number: that only ever loosens the bound."""
    groups = LEAST_GROUPS
    while groups < MOST_GROUPS and groups * PER_GROUP < len(s):
        groups *= 2
    return np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups), 255).astype(np.uint8)


def folded(counts: list[np.ndarray]) -> np.ndarray:
    """Count vectors as one matrix, in as many groups as the coarsest has: sums of the groups that fall together."""
    groups = min(len(c) for c in counts)
    out = np.empty((len(counts), groups), np.int32)
    for i, c in enumerate(counts):
        out[i] = np.where(c == 255, 1 << 20, c.astype(np.int32)).reshape(-1, groups).sum(0)
    return out


class Tree:
    """A packed R-tree over count vectors: leaves of ``LEAF`` points in order of size and then of their heaviest groups."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        self.order = np.lexsort((counts[:, 1], counts[:, 0], sizes))
        self.sizes, self.counts = sizes[self.order].astype(np.int64), counts[self.order].astype(np.int32)
        self.levels = [(self.counts, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > LEAF:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)))

    @staticmethod
    def reach(size: int, counts: np.ndarray, top: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which boxes may hold a partner: large enough minima sums for their smallest size, and sizes in reach."""
        bound = np.minimum(counts, top).sum(1)
        near = (low * PER <= size * OF) & (high * OF >= size * PER)
        return near & (bound >= needed(size, np.maximum(low, -(-size * PER // OF))))

    def search(self, size: int, counts: np.ndarray, open_: np.ndarray | None = None) -> np.ndarray:
        """Points (numbered as given) that the bound leaves, of those still ``open_``."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            at = at[self.reach(size, counts, top[at], low[at], high[at])]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        found = self.order[at]
        return found if open_ is None else found[open_[found]]


def walk(n: int, partners: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Components of n points: each point is expanded once, and only against points not yet reached."""
    label, open_ = np.arange(n), np.ones(n, bool)
    for start in range(n):
        if not open_[start]:
            continue
        open_[start] = False
        todo = [start]
        while todo and open_.any():
            found = partners(todo.pop(), open_)
            open_[found] = False
            label[found] = start
            todo += found.tolist()
    return label


# Stage by stage -------------------------------------------------------------------------------------------------------


def row_key(doc_id: Column, text: Column) -> Column:
    """16 bytes that tell a row by its id and its text; null ids and null texts have keys too."""
    of = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(of(doc_id), F.lit("\n"), of(text)).cast("binary")))


def frequent(docs: DataFrame, rows: int) -> np.ndarray:
    """Shingles that the sampled documents share, rarest first; at most ``FREQUENT``, the most frequent of all."""
    part = min(1.0, max(SAMPLE, rows // ONE_IN) / max(1, rows))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 40)) < int(part * (1 << 40))) if part < 1 else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in row_slices(batches, 0, PIECE):
            sets = [shingles(t, hashes) for t in binary_values(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], ["token"])

    found = drawn.select("text").mapInArrow(tidy(run), "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= 4)
    rows_ = found.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    return np.array([r["token"] for r in reversed(rows_)], dtype=np.int64).view(np.uint64)


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, key, node (a number of the row), n, sig (null without a set), counts, prefix (shingles) of every row."""
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = table.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    late = frequent(table, table.count())
    ranked = np.argsort(late, kind="stable")
    known = late[ranked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in row_slices(batches, 1, PIECE):
            n, sig, counts, prefix = [], [], [], []
            for text in binary_values(batch.column(1)):
                s = shingles(text, hashes)
                n.append(len(s))
                if not len(s):
                    for column in (sig, counts, prefix):
                        column.append(None)
                    continue
                p = prefix_size(len(s))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    common = known[at] == s
                    rare = s[~common]
                    first = rare[:p] if len(rare) >= p else np.concatenate([rare, s[common][np.argsort(ranked[at[common]])][: p - len(rare)]])
                else:
                    first = s[:p]
                sig.append(signature(s))
                counts.append(counts_of(s).tobytes())
                prefix.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(counts, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "key", "node", "n", "sig", "counts", "prefix"],
            )

    numbered = table.withColumn("node", F.monotonically_increasing_id())
    return staged(numbered.mapInArrow(tidy(run), "doc_id long, key binary, node long, n long, sig binary, counts binary, prefix array<long>"), "prefixes")


def block_edges(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b: edges between nodes of one block, at most one a node, that tie together what the bound can't separate.

    ``prefixes`` are (token, node), ``nodes`` (node, n, counts). Counts of a token are aggregated before they meet its nodes.
    """
    counted = prefixes.groupBy("token").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    shared = prefixes.join(counted.select("token", F.ceil(F.col("size") / PART).cast("int").alias("parts")), "token")
    # Part i meets part j, i <= j: each node goes to all pairs that its part is in, which is one pair if there is one part.
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts").cast("long")).cast("int")
    dealt = shared.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("own", own)
    dealt = dealt.select("token", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "node")
    lists = dealt.groupBy("token", "i", "j").agg(F.sort_array(F.collect_list("node")).alias("m")).where(F.size("m") > 1)
    # Near duplicates share most of their shingles: the same nodes would meet again and again.
    placed = lists.select("m").distinct().withColumn("block", F.monotonically_increasing_id()).select("block", F.explode("m").alias("node"))
    placed = staged(placed, "blocks")
    full = placed.join(nodes.select("node", "n", "counts"), "node").select("block", "node", "n", "counts")

    def tied(at: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int]]:
        nodes_, sizes = np.array([r[0] for r in at], dtype=np.int64), np.array([r[1] for r in at], dtype=np.int64)
        counts = folded([np.frombuffer(r[2], np.uint8) for r in at])
        tree = Tree(sizes, counts)
        label = walk(len(at), lambda i, open_: tree.search(int(sizes[i]), counts[i], open_))
        for i in np.flatnonzero(label != np.arange(len(at))):
            yield int(nodes_[label[i]]), int(nodes_[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, out = None, [], []
        for batch in batches:
            for t, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != block:
                    out += sized(at)
                    block, at = t, []
                at.append(row)
            yield edges(out)
            out = []
        yield edges(sized(at))

    def sized(at: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
        """A block in bands of sizes: vectors of one band differ little in groups, and no link spans more than two bands."""
        out: list[tuple[int, int]] = []
        at = sorted(at, key=lambda r: r[1])
        band = [int(np.log(r[1]) / (1.01 * np.log(OF / PER))) for r in at]
        cuts = [i for i in range(len(at)) if i == 0 or band[i] != band[i - 1]] + [len(at)]
        for k in range(len(cuts) - 1):
            upto = cuts[k + 2] if k + 2 < len(cuts) and band[cuts[k + 1]] == band[cuts[k]] + 1 else cuts[k + 1]
            if upto - cuts[k] > 1:
                out += tied(at[cuts[k] : upto])
        return list(set(out))

    def edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return full.repartition("block").sortWithinPartitions("block").mapInArrow(tidy(run), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest of its component) of every node with an edge (a, b), by large-star and small-star rounds."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    both = staged(both, "edges")
    while True:
        # Large star: a node's larger neighbours hang from its smallest one; small star: a node's smaller neighbours do.
        ways = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = staged(small, "edges")
        discard(both)
        # Done when every edge ends in a root, that is, in a node that has no smaller neighbour, and every node has one edge.
        stars = new.groupBy("u").agg(F.count("*").alias("n"))
        if stars.where("n > 1").isEmpty() and new.join(new.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = new


def verified(docs: DataFrame, nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """a, b (signatures): edges along true links that join every node to all that it hangs together with."""
    inside = nodes.join(clusters, "node")
    parts = inside.groupBy("root").agg(F.ceil(F.sum("n") / CLUSTER).cast("int").alias("parts"))
    members = staged(inside.join(parts, "root").select("key", "sig", "root", "parts"), "members")
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").withColumn("key", row_key(F.col("doc_id"), F.col("text"))).select("key", "text")
    # Most texts are in no cluster: they stay where they are.
    own = screened(table, "key", members.select("key")).where("__maybe").join(members, "key").select("text", "sig", "root", "parts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sent = Hashes(), set()
        for batch in row_slices(batches, 0, PIECE):
            keep, out, part = [], [], []
            for i, (text, sig, parts_) in enumerate(zip(binary_values(batch.column(0)), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if sig in sent:  # a repeated row
                    continue
                if len(sent) > CACHE:
                    sent.clear()
                sent.add(sig)
                keep.append(i)
                out.append(shingles(text, hashes).tobytes())
                part.append(int.from_bytes(sig[8:12], "little") % parts_)
            kept = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(kept), batch.column(2).take(kept), batch.column(3).take(kept), pa.array(part, pa.int32()), pa.array(out, pa.binary())], ["sig", "root", "parts", "part", "shingles"])

    full = own.mapInArrow(tidy(sets), "sig binary, root long, parts int, part int, shingles binary")
    # Part i meets part j, i <= j, in task (i, j).
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = full.withColumn("o", other).select("root", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "sig", "shingles")

    def linked(at: list[tuple[bytes, np.ndarray]]) -> Iterator[tuple[bytes, bytes]]:
        at = list({sig: (sig, s) for sig, s in at}.values())
        sizes = np.array([len(s) for _, s in at])
        counts = folded([counts_of(s) for _, s in at])
        tree = Tree(sizes, counts)
        tokens, flat = np.unique(np.concatenate([s for _, s in at]), return_inverse=True)
        flat = flat.astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(len(tokens), bool)

        def partners(i: int, open_: np.ndarray) -> np.ndarray:
            found = tree.search(int(sizes[i]), counts[i], open_)
            if not len(found):
                return found
            mine = flat[starts[i] : starts[i] + sizes[i]]
            mark[mine] = True
            keep = []
            for some in np.array_split(found, -(-int(sizes[found].sum()) // CLUSTER)):
                theirs = np.concatenate([np.arange(starts[j], starts[j] + sizes[j]) for j in some])
                begin = np.cumsum(sizes[some]) - sizes[some]
                shared = np.add.reduceat(mark[flat[theirs]].astype(np.int64), begin)
                keep.append(some[OF * shared >= PER * (sizes[i] + sizes[some] - shared)])
            mark[mine] = False
            return np.concatenate(keep)

        label = walk(len(at), partners)
        for i in np.flatnonzero(label != np.arange(len(at))):
            yield at[label[i]][0], at[i][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, out = None, [], []
        for batch in batches:
            for root, i, j, sig, s in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5)), strict=True):
                if (root, i, j) != key:
                    out += linked(at) if len(at) > 1 else ()
                    key, at = (root, i, j), []
                at.append((sig, np.frombuffer(s, np.uint64)))
            yield pairs(out)
            out = []
        yield pairs(list(linked(at)) if len(at) > 1 else [])

    def pairs(out: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], ["a", "b"])

    return dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(tidy(run), "a binary, b binary")


def linked_rows(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, component_id, keeper (the key of the component's row that stays) of every row of ``docs``."""
    rows = prepared(docs)
    some = rows.where("sig is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    nodes = some.groupBy("sig").agg(F.min("node").alias("node"), first.alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("counts").alias("counts"))
    nodes = staged(nodes.withColumn("key", F.col("first.key")), "nodes")
    one = rows.select("node", "prefix").join(nodes.select("node"), "node", "left_semi")
    clusters = components(block_edges(one.select(F.explode("prefix").alias("token"), "node"), nodes))
    links = components(verified(docs, nodes, clusters))
    rooted = nodes.select("sig", "first", "copies").join(links.withColumnRenamed("node", "sig"), "sig", "left")
    names = rooted.groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min("first").alias("best"))
    # A text that has one row and no link is its own component: its row needs no name from elsewhere.
    linked = rooted.where("root is not null or copies > 1").withColumn("root", F.coalesce("root", "sig"))
    named = linked.select("sig", "root", "copies").join(names, "root").select("sig", "copies", F.col("best.doc_id").alias("component_id"), F.col("best.key").alias("keeper"))
    named = staged(named, "names")
    own = rows.select("doc_id", "key", "n", "sig")
    # Texts with very many rows, HOT_SHARE of them at most, are joined by broadcast; no other key is frequent.
    least = max(1, rows.count() // HOT_SHARE)
    hot = F.broadcast(named.where(F.col("copies") > least).select(F.col("sig").alias("hot"), F.col("component_id").alias("hot_id"), F.col("keeper").alias("hot_keeper")))
    seen = screened(own.join(hot, F.col("sig") == F.col("hot"), "left"), "sig", named.where(F.col("copies") <= least).select("sig"))
    rest = seen.where("hot is null and __maybe").join(named.where(F.col("copies") <= least).drop("copies"), "sig", "left")
    rest = rest.select("doc_id", "key", "n", "component_id", "keeper")
    alone = seen.where("hot is not null or not __maybe").select("doc_id", "key", "n", F.col("hot_id").alias("component_id"), F.col("hot_keeper").alias("keeper"))
    return alone.unionByName(rest).select("doc_id", "key", "n", F.coalesce("component_id", F.when(F.col("keeper").isNull(), F.col("doc_id"))).alias("component_id"), F.coalesce("keeper", "key").alias("keeper"))


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    return linked_rows(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, all columns: the one with the smallest id (null last), then digest of id and text.

    A row is told by its id and its text. Rows equal in both become one, whatever their other columns; rows of one id with
    unlike texts are judged apart. Texts without words link with nothing: of each id and text one stays.
    """
    found = staged(linked_rows(docs).select("key", "keeper"), "kept")
    gone = found.where("key <> keeper").select("key").distinct()
    again = found.where("key = keeper").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    odd = staged(gone.withColumn("gone", F.lit(True)).unionByName(again.withColumn("gone", F.lit(False))), "odd")
    names = [f"__c{i}" for i in range(len(docs.columns))]  # whatever their names, columns can't clash with ours
    doc_id, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    keyed = docs.toDF(*names).withColumn("__key", row_key(F.col(doc_id).cast("long"), F.col(text)))
    # Rows that surely are neither gone nor repeated need no shuffle; those that are gone are not needed after the join.
    seen = screened(keyed, "__key", odd.select("key"))
    kept = seen.where("__maybe").drop("__maybe").join(odd, F.col("__key") == odd["key"], "left").where("gone is null or not gone").drop("key")
    once = kept.where("gone is null")
    if not again.isEmpty():
        # A row that repeats without end is one row in each task before it is shuffled.
        repeated = kept.where("not gone").groupBy("__key").agg(F.first(F.struct(*names)).alias("r"))
        once = once.select(*names).unionByName(repeated.select("r.*"))
    out = seen.where("not __maybe").select(*names).unionByName(once.select(*names))
    return out.toDF(*docs.columns)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT r, doc_id, array_to_string(w[i : i + 4], ' ') AS t
  FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c2 FROM s a JOIN s b ON a.t = b.t AND a.r < b.r GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c2 >= 80 * (a.n + b.n - c2)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
c AS (SELECT r AS x, r AS y FROM n UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y),
m AS (SELECT x AS r, min(doc_id) AS component_id FROM c JOIN n ON n.r = c.y GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
