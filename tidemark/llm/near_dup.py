"""MinHash near-dedup by a multi-index Hamming join.

A document's signature is `SIZE` symbols of 16 bits. Documents at the similarity threshold differ in at most t
symbols but for a stated chance; cut into t // 2 + 1 chunks, such signatures agree in all but one symbol of some
chunk. So one key per symbol, the rest of its chunk, finds every pair within distance t. Links are confirmed on the
full shingle sets. Within a bucket of equal keys no pairs are emitted: members are first tried against one hub, and
what lies in different components after that is compared in memory, in blocks, which yield a spanning set of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, small, stash

SIZE = 64
#: Chance that a pair right at the threshold is further apart than t symbols.
MISS = 1e-6
#: Members of a bucket that are in one task's memory together; larger buckets are compared block by block.
BLOCK = 4096
#: The same for the bytes of their shingle sets.
BLOCK_BYTES = 32 << 20
#: Edges that a task joins at once.
EDGES = 1 << 20
#: Members that share a hub's row in one task.
HUB_ROWS = 20_000


def distance_bound(threshold: float, size: int = SIZE, miss: float = MISS) -> int:
    """The least t with P(more than t of `size` symbols differ) <= miss at the threshold."""
    p, tail = 1 - threshold, 1.0
    for t in range(size):
        tail -= math.comb(size, t) * p**t * (1 - p) ** (size - t)
        if tail <= miss:
            return t
    return size


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the argument bears on every bit of the result."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def _constants(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(seed))


class WordHashes(dict):
    """64-bit hashes of words; those of a million at most are remembered."""

    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[w] = h = xxhash.xxh3_64_intdigest(w)
        return h


class Shingler:
    """Distinct shingles of texts as sorted arrays of 64-bit hashes. Fewer words than a shingle: all of them are one."""

    def __init__(self, words: int) -> None:
        self.n, self.known = words, WordHashes()
        self.odd = _constants(words, 1) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        return np.unique(self.every(text))

    def every(self, text: str | None) -> np.ndarray:
        """All shingles in their order, repeats included."""
        # bytes.lower() and bytes.split() know ASCII only: A-Z, and \x20 and \x09-\x0D.
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        total = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            total += _mix(h[i : len(h) - n + 1 + i] * self.odd[i] + np.uint64(n))
        return _mix(total)


def signatures(sets: list[np.ndarray], size: int = SIZE) -> np.ndarray:
    """A row of 16-bit symbols per set; empty sets have zeros."""
    lengths = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), size), np.uint16)
    full = np.flatnonzero(lengths)
    if len(full):
        x = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
        for k, (a, b) in enumerate(zip(_constants(size, 2) | np.uint64(1), _constants(size, 3), strict=True)):
            # The upper half of a product is well mixed; its lowest part is not.
            least = np.minimum.reduceat((x ^ b) * a, starts)
            out[full, k] = (_mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray, chunks: int) -> np.ndarray:
    """A row of 64-bit keys per signature: for each symbol, its chunk without it."""
    n, size = sig.shape
    each = _mix(sig.astype(np.uint64) + (np.arange(size, dtype=np.uint64) << np.uint64(16)) + np.uint64(1 << 40))
    edge = np.linspace(0, size, chunks + 1).astype(np.int64)
    whole = np.add.reduceat(each, edge[:-1], axis=1)
    of = np.repeat(np.arange(chunks), np.diff(edge))
    return _mix(whole[:, of] - each + _constants(size, 4)[None, :])


def _unfinished(e: DataFrame) -> int:
    """The edges (u, v) with u > v if they are no stars yet, else 0: in stars a u has one edge and is no v."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("n")
    nodes = e.select(ends).groupBy("n.x").agg(F.sum("n.up").alias("ups"), F.min("n.up").alias("least"))
    wrong, twice = nodes.agg(F.count_if((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("least") == 0))), F.sum("ups")).first()
    return int(twice) if wrong else 0


def _least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that are not their component's least, from edges a - b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        least = np.minimum(root[a], root[b])
        for ends in (root[a], root[b]):
            np.minimum.at(root, ends, least)
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _joined(edges: DataFrame) -> DataFrame:
    """(u, v): stars with the edges' components, of at most EDGES edges of a partition each; few edges are then done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def stars() -> pa.RecordBatch:
            ends = _least_of(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["u", "v"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= EDGES:
                yield stars()
                held, size = [], 0
        if held:
            yield stars()

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of each connected component, from edges (a, b), by alternating large and small stars.

    Each task first joins its own edges. Every round is written to the checkpoint folder; hubs are aggregated before the
    shuffle and nothing is collected.
    """
    e = cut(_joined(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    star = lambda d, least, n: join_hot(d, least, ["u"], "times", F.xxhash64("v"), n)
    while (n := _unfinished(e)):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("times"))
        large = star(both, least, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
        small_star = star(large, least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small_star.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(id, mark, text): rows of one id with different texts differ in their mark."""
    d = docs.select(F.col(doc).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return d.select("id", F.xxhash64("text").alias("mark"), "text")


def _profile(docs: DataFrame, words: int) -> DataFrame:
    """(id, mark, n, digest, sig) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingles(t) for t in part.column(2).to_pylist()]
                sig = signatures(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                     pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["id", "mark", "n", "digest", "sig"],
                )

    return docs.select("id", "mark", "text").mapInArrow(run, "id long, mark long, n long, digest binary, sig binary")


def classes_of(profile: DataFrame, carry: list[str]) -> DataFrame:
    """(id, digest, times, least, mark, carry): a number for each set that rows with an id have, and the row that stands for it.

    profile: id, mark, n, digest, what equal sets have in common (carry) and perhaps `no`, a number of the row, which is
    then kept for the row that stands. Numbers are fixed by writing them.
    """
    some, tie = profile.where("n > 0 and id is not null"), [c for c in ("mark", "no") if c in profile.columns]
    c = some.groupBy("digest").agg(
        F.min(F.struct("id", *tie)).alias("at"), F.count("*").alias("times"), *[F.first(c).alias(c) for c in carry])
    number = F.monotonically_increasing_id().alias("id")
    return stash(c.select(number, "digest", "times", F.col("at.id").alias("least"), *[F.col(f"at.{t}").alias(t) for t in tie], *carry), "classes")


def labelled(profile: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, mark, n_shingles, component_id) per row of profile, from classes and the roots (id, root) of those that are linked."""
    at = classes.select("id", "digest", "times", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    at = cut(at)
    least = cut(at.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("many")))
    labels = join_hot(at, least, ["root"], "many", F.xxhash64("id"), at.count()).select("digest", "times", "component_id")
    some = profile.where("n > 0 and id is not null").select("id", "mark", "n", "digest")
    found = join_hot(some, cut(labels), ["digest"], "times", F.xxhash64("id", "mark"), profile.count())
    rest = profile.where("n = 0 or id is null").select("id", "mark", "n", F.col("id").alias("component_id"))
    return found.select("id", "mark", "n", "component_id").union(rest).withColumnRenamed("n", "n_shingles")


def _keys(reps: DataFrame, chunks: int) -> DataFrame:
    """(key, id): a row for each of a signature's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                keys = chunk_keys(sig, chunks)
                ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key long, id long")


def sets_of(docs: DataFrame, ids: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(id, set) of the given classes, from the rows that stand for them; rows that repeat do no harm below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            sets = [shingles(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    rows = classes.select(F.col("id").alias("class"), F.col("least").alias("id"), "mark").join(ids.select(F.col("id").alias("class")), "class")
    found = docs.join(small(cut(rows)), ["id", "mark"]).select(F.col("class").alias("id"), "text")
    return stash(found.mapInArrow(run, "id long, set binary"), "sets")


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return den * common >= num * (len(a) + len(b) - common)


def confirm(stars: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): the pairs (hub, id) that are links. A hub's set comes before its members' and is held alone.

    A hub with many members is dealt to several tasks, each with a copy of its set.
    """
    parts = cut(stars.groupBy("hub").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("parts")))
    heads = parts.join(sets.withColumnRenamed("id", "hub"), "hub")
    heads = heads.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("id"), "set")
    stars = stars.join(small(parts.where("parts > 1")), "hub", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = stars.join(sets, "id")
    rows = rows.select("hub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = head = None
        for batch in batches:
            a, b = [], []
            for at, i, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = np.frombuffer(s.as_py(), np.uint64)
                if i is None:
                    hub, head = at, own
                elif at == hub and _linked(head, own, num, den):
                    a.append(at)
                    b.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    near = heads.union(rows).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("id").asc_nulls_first())
    return near.mapInArrow(run, "a long, b long")


def groups_in(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first `keys` columns, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:], strict=False):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _candidates(rows: DataFrame, bound: int) -> DataFrame:
    """(a, b): within each block pair of a bucket, spanning links of the members of different components that are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_in(batches, 3):
            root, ids = t.column("root").to_numpy(), t.column("id").to_numpy()
            if len(root) < 2 or (root == root[0]).all():
                continue
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(root), -1)
            label, a, b = np.arange(len(root)), [], []
            step = max(1, 4_000_000 // (len(root) * sig.shape[1]))
            for lo in range(0, len(root), step):
                near = (sig[lo : lo + step, None, :] != sig[None, :, :]).sum(2, dtype=np.uint16) <= bound
                near &= root[lo : lo + step, None] != root[None, :]
                for i in range(lo, min(lo + step, len(root))):
                    others = np.flatnonzero(near[i - lo, :i])
                    for j in others[np.unique(label[others], return_index=True)[1]].tolist():
                        if label[i] != label[j]:
                            label[label == label[i]] = label[j]
                            a.append(ids[i])
                            b.append(ids[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    at = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return at.select("key", "lo", "hi", "id", "root", "sig").mapInArrow(run, "a long, b long")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, id, root, bytes) with lo and hi: blocks of a group that meet.

    Members of a group's commonest root need not meet each other: each of their blocks meets each block of the others, and
    those meet one another. A group with few others is thus no more than its size and the others once a block. A group
    that fits one block and has no root of more than half its members is one block, each member once.
    """
    rows = cut(rows)
    roots = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    top = F.max(F.struct("n", "root", "bytes"))
    groups = roots.groupBy("key").agg(top.alias("top"), F.sum("n").alias("times"), F.sum("bytes").alias("bytes"))
    groups = groups.select(
        "key", "times", F.col("top.root").alias("most"), blocks(F.col("top.n"), F.col("top.bytes")).alias("ours"),
        blocks(F.col("times") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("others"),
        ((F.col("top.n") * 2 <= F.col("times")) & (F.col("times") <= BLOCK) & (F.col("bytes") <= BLOCK_BYTES)).alias("one"),
    )
    at = join_hot(rows, cut(groups.where("others > 0")), ["key"], "times", F.xxhash64("id"), rows.count())
    ours = (F.col("root") == F.col("most")) & ~F.col("one")
    at = at.withColumn("mine", F.pmod(F.xxhash64("id"), F.when(ours, F.col("ours")).when(F.col("one"), 1).otherwise(F.col("others"))).cast("int"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    others = F.sequence(F.lit(0), F.when(F.col("one"), 0).otherwise(F.col("others") - 1))
    above = F.sequence(F.col("others"), F.col("others") + F.col("ours") - 1)
    above = F.when(F.col("one"), F.array().cast("array<int>")).otherwise(above)
    mine = F.when(ours, F.transform(others, lambda i: pair(i, F.col("others") + F.col("mine")))).otherwise(
        F.transform(F.concat(others, above), lambda i: pair(F.col("mine"), i)))
    return at.withColumn("at", F.explode(mine)).select("key", "at.lo", "at.hi", "id", "root")


def _within(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that join the components within each block pair, at most one for each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_in(batches, 3):
            ids, roots = t.column("id").to_pylist(), t.column("root").to_pylist()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            lead = {r: r for r in roots}

            def top(r: int, lead: dict[int, int] = lead) -> int:
                while lead[r] != r:
                    lead[r] = r = lead[lead[r]]
                return r

            # Common shingles of a member and all before it are counted at once over an index of the group's shingles.
            values, code = np.unique(np.concatenate(sets), return_inverse=True)
            lengths = np.array([len(s) for s in sets], np.int64)
            owner = np.repeat(np.arange(len(sets)), lengths)
            order = np.argsort(code, kind="stable")
            holders, first = owner[order], np.searchsorted(code[order], np.arange(len(values) + 1))
            ends = np.concatenate([[0], np.cumsum(lengths)])
            a, b = [], []
            for i in range(1, len(ids)):
                own = code[ends[i] : ends[i + 1]]
                common = np.bincount(np.concatenate([holders[first[c] : first[c + 1]] for c in own]), minlength=len(ids))[:i]
                for j in np.flatnonzero(den * common >= num * (lengths[i] + lengths[:i] - common)).tolist():
                    x, y = top(roots[i]), top(roots[j])
                    if x != y:
                        lead[max(x, y)] = min(x, y)
                        a.append(ids[i])
                        b.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    at = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return at.select("key", "lo", "hi", "id", "root", "set").mapInArrow(run, "a long, b long")


def near_rows(docs: DataFrame, words: int, num: int, den: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, n_shingles, component_id) per row of docs, as near_duplicates() says; mark: xxhash64 of the row's text."""
    bound = distance_bound(num / den)
    chunks = bound // 2 + 1
    d = keyed(docs, doc, text)
    profile = stash(_profile(d, words), "profile")
    # Rows of equal sets are one class; copies go no further.
    classes = classes_of(profile, ["sig", "n"])
    reps = classes.select("id", "sig", "n")

    keys = _keys(reps, chunks)
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("hub")).where("size > 1")
    shared = stash(join_hot(keys, stash(buckets, "keys"), ["key"], "size", F.xxhash64("id"), SIZE * reps.count()).select("key", "hub", "id"), "buckets")
    # First each member is tried against the hub that it shares most buckets with; the rest comes below.
    stars = shared.where("hub <> id").groupBy("hub", "id").agg(F.count("*").alias("times"))
    stars = stars.groupBy("id").agg(F.max(F.struct("times", -F.col("hub"))).alias("best")).select("id", (-F.col("best")["col2"]).alias("hub"))
    sig = reps.select("id", "sig")
    stars = cut(stars)
    hubs = stars.groupBy("hub").agg(F.count("*").alias("times")).join(sig.select(F.col("id").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    stars = cut(_near(join_hot(stars.join(sig, "id"), cut(hubs), ["hub"], "times", F.xxhash64("id"), stars.count()), bound))
    sets = sets_of(d, stars.select("id").union(stars.select("hub")).distinct(), classes, words)
    links = cut(confirm(stars, sets, num, den))
    roots = components(links)

    # Buckets that still hold several components, in blocks where they are large.
    at = stash(shared.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "open")
    split = at.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x <> y").select("key", "size")
    open_ = join_hot(at, cut(split), ["key"], "size", F.xxhash64("id"), at.count()).withColumn("bytes", F.lit(SIZE * 2))
    near = cut(_candidates(in_blocks(open_).join(sig, "id"), bound).distinct())
    more = within_clusters(near, roots, d, classes, words, num, den)
    return labelled(profile, classes, components(links.union(more)))


def within_clusters(near: DataFrame, roots: DataFrame, docs: DataFrame, classes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(a, b): links that join components of clusters, which are what the pairs `near` (a, b) connect."""
    # What is near by any bucket is one cluster; each of its members brings its set once.
    clusters = components(near).withColumnRenamed("root", "key")
    clusters = clusters.union(clusters.select(F.col("key").alias("id"), "key").distinct())
    clusters = clusters.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    clusters = cut(clusters.join(classes.select("id", (F.col("n") * 8).alias("bytes")), "id"))
    sets = sets_of(docs, clusters.select("id"), classes, words)
    return _within(in_blocks(clusters).join(sets, "id"), num, den)


def near_duplicates(
    docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc, n_shingles, component_id, kept) per row of docs.

    Linked are rows whose sets of `words`-word shingles have den * common >= num * united. component_id is the least id
    that can be reached, kept says that it is the row's own. Texts without words (or null) have an empty set and no
    links. Rows of one id with different texts are linked and judged each by its text; rows that repeat both are kept or
    not together. Rows with a null id have no links, a null component and are kept. Ids that are no numbers fail the query.
    """
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return near_rows(docs, words, num, den, doc, text).select(F.col("id").alias(doc), "n_shingles", "component_id", kept)


def _near(pairs: DataFrame, bound: int) -> DataFrame:
    """(hub, id) of the pairs whose signatures are within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (2, 3))
                keep = pa.array((x != y).sum(1) <= bound)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["hub", "id"])

    return pairs.select("hub", "id", "sig", "hub_sig").mapInArrow(run, "hub long, id long")
