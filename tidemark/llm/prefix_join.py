"""N-gram Jaccard join by prefix filters under several global orders.

Two sets that are similar enough share at least one element of their prefixes under any order of all elements, and the
longer the prefixes the more. The first order puts rare shingles first: its minimal prefixes are an inverted index that
yields candidates. A further order, by hash, has longer prefixes; a candidate must share as many elements of it as the
pair's sizes demand, so the filters are intersected before anything is verified on the full sets. Before prefixes are moved,
pairs are told apart by their sets' parities, a few words a set, whose distance is never more than what the sets differ in.
Buckets of one key emit no pairs among all members: each is tried against the bucket's hub, and only what the hub did
not join is compared, by parities, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import packed, unpacked
from .common import cut, join_hot, small, stash
from .near_dup import Shingler, _constants, _mix, classes_of, components, confirm, groups_in, in_blocks, keyed, labelled, sets_of, within_clusters

#: Counters of shingles by hash, summed over the corpus; their number does not grow with it. They only rank shingles.
COUNTERS = 1 << 18
#: Orders by hash beside that by rarity.
HASHED = 1
#: Words of 64 bits of a set's parities, at least; larger sets have more.
PARITIES = 8
#: Rows of counters are summed in so many tasks, then in one.
SUMS = 32


def least_common(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Elements that a set of n has in common with any set similar to it."""
    return -(-num * n // den)


def common_of(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Elements that similar sets of x and y elements have in common at least."""
    return -(-num * (x + y) // (num + den))


def long_prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Length of the prefixes under the orders by hash: three times what may differ, and one."""
    return np.minimum(n, 3 * (n - least_common(n, num, den)) + 1)


def _counted(docs: DataFrame, words: int) -> np.ndarray:
    """How often shingles occur, by hash: tables of COUNTERS numbers from each task, summed in two steps."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = Shingler(words), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [shingles.every(t) for t in batch.column(0).slice(at, 500).to_pylist()]
                total += np.bincount((np.concatenate(found) >> np.uint64(20)).astype(np.int64) % COUNTERS, minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary())], ["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += unpacked(blob, np.int64)[0]
        yield pa.RecordBatch.from_arrays([pa.array([packed(total)], pa.binary())], ["counts"])

    some = docs.select("text").mapInArrow(count, "counts binary").repartition(SUMS).mapInArrow(add, "counts binary")
    found = some.coalesce(1).mapInArrow(add, "counts binary").first()
    return unpacked(bytes(found.counts), np.int64)[0] if found else np.zeros(COUNTERS, np.int64)


def parities(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each bin by hash whether an odd number of the set's elements is in it: each element by which two sets differ changes one.

    Three bins or more for each element by which similar sets may differ, so that other sets are further apart.
    """
    bins, differ = 64 * PARITIES, 2 * (len(s) - int(common_of(len(s), len(s), num, den)))
    while bins < 3 * differ:
        bins *= 2
    odd = np.bincount((s & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _folded(column: pa.ChunkedArray | pa.Array, rows: np.ndarray, words: int) -> np.ndarray:
    """Parities of rows that have one length, as if they had `words` words: bins are by low bits."""
    found = column.take(pa.array(rows))
    x = (found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found).flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)
    while x.shape[1] > words:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def alike(apart: np.ndarray, n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m elements whose parities differ in so many bins can be similar."""
    c = common_of(n, m, num, den)
    return (c <= np.minimum(n, m)) & (apart <= n + m - 2 * c)


def _hashed(shingles: np.ndarray, order: int) -> np.ndarray:
    return _mix(shingles * (_constants(HASHED, 11)[order] | np.uint64(1)))


def prefixes(s: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[bytes, bytes]:
    """(first order's minimal prefix as shingles; the other orders' long prefixes, as distinct 32-bit values of each in order)."""
    n = len(s)
    if not n:
        return b"", b""
    # Ties of an order's value, which are hardly ever met, all belong to the prefix.
    seen = np.minimum(counts[(s >> np.uint64(20)).astype(np.int64) % COUNTERS], (1 << 24) - 1).astype(np.uint64)
    place, last = seen << np.uint64(40) | _mix(s) >> np.uint64(24), n - int(least_common(n, num, den))
    first = s[place <= np.partition(place, last)[last]]
    size, other = int(long_prefix(n, num, den)), []
    for k in range(HASHED):
        h = _hashed(s, k)
        h = np.partition(h, size - 1)[:size] if size < n else h
        v = np.unique((h & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        other += [np.array([len(v)], np.uint32), v]
    return first.tobytes(), np.concatenate(other).tobytes()


def _split(blob: bytes) -> list[np.ndarray]:
    x, at, out = np.frombuffer(blob, np.uint32), 0, []
    while at < len(x):
        out.append(x[at + 1 : at + 1 + int(x[at])])
        at += 1 + int(x[at])
    return out


def may_link(n: np.ndarray, m: np.ndarray, size: np.ndarray, shared: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m elements can be similar when their long prefixes share so many values under one order.

    size: values of the first set's prefix; where two of its elements have one value, as many more may be shared.
    Prefixes of n - c + l and m - c + l elements share l or more if the sets have c in common.
    """
    c = common_of(n, m, num, den)
    need = np.minimum(long_prefix(n, num, den) - n, long_prefix(m, num, den) - m) + c
    return (c <= np.minimum(n, m)) & (shared + long_prefix(n, num, den) - size >= need)


def _index(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(id, mark, n, digest, first, others, bits, no) per row, which `no` numbers."""
    counts = _counted(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t) for t in part.column(2).to_pylist()]
                both = [prefixes(s, counts, num, den) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                     *[pa.array(v, pa.binary()) for v in ([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [x for x, _ in both], [y for _, y in both])],
                     pa.array([parities(s, num, den) for s in sets], pa.list_(pa.int64()))],
                    ["id", "mark", "n", "digest", "first", "others", "bits"],
                )

    rows = docs.select("id", "mark", "text").mapInArrow(run, "id long, mark long, n long, digest binary, first binary, others binary, bits array<long>")
    return stash(rows.withColumn("no", F.monotonically_increasing_id()), "prefixes")


def _keys(reps: DataFrame) -> DataFrame:
    """(key, id): a row for each element of the first order's prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids)], ["key", "id"])

    return reps.select("id", "first").mapInArrow(run, "key long, id long")


def _alike(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The rows (hub, hub_n, hub_bits, id, n, bits) whose parities let them be similar, without these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            n, m = t.column(1).to_numpy(), t.column(4).to_numpy()
            one, two = (pc.list_value_length(t.column(c)).to_numpy() for c in (2, 5))
            for x, y in np.unique(np.stack([one, two]), axis=1).T.tolist():
                rows = np.flatnonzero((one == x) & (two == y))
                apart = np.bitwise_count(_folded(t.column(2), rows, min(x, y)) ^ _folded(t.column(5), rows, min(x, y))).sum(1, dtype=np.int64)
                keep[rows] = alike(apart, n[rows], m[rows], num, den)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([t.column(c).filter(mask) for c in (0, 1, 3, 4)], ["hub", "hub_n", "id", "n"])

    return pairs.select("hub", "hub_n", "hub_bits", "id", "n", "bits").mapInArrow(run, "hub long, hub_n long, id long, n long")


def _passing(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(hub, id) of the rows (hub, hub_n, hub_others, id, n, others) that pass every hashed order's filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                t = batch.slice(at, 2000)
                n, m = t.column(1).to_numpy(), t.column(4).to_numpy()
                x, y = ([_split(b) for b in t.column(c).to_pylist()] for c in (2, 5))
                keep = np.ones(t.num_rows, bool)
                for k in range(HASHED):
                    one, two = [v[k] for v in x], [v[k] for v in y]
                    sizes = np.array([len(v) for v in one], np.int64)
                    value = [np.repeat(np.arange(len(s), dtype=np.uint64) << np.uint64(32), [len(v) for v in s]) | np.concatenate(s) for s in (one, two)]
                    both = np.sort(np.concatenate(value))
                    shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=t.num_rows)
                    keep &= may_link(n, m, sizes, shared, num, den)
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([t.column(0).filter(mask), t.column(3).filter(mask)], ["hub", "id"])

    return pairs.select("hub", "hub_n", "hub_others", "id", "n", "others").mapInArrow(run, "hub long, id long")


def _candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): within each block pair of a bucket, spanning pairs of members of different components that their parities let be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_in(batches, 3):
            root, ids, n = (t.column(c).to_numpy() for c in ("root", "id", "n"))
            if len(root) < 2 or (root == root[0]).all():
                continue
            label, a, b = np.arange(len(ids)), [], []
            length = pc.list_value_length(t.column("bits")).to_numpy()
            widths = np.unique(length)
            for k, w in enumerate(widths.tolist()):
                # Sets of this width meet those that follow them, and all wider ones.
                at = [np.flatnonzero(length == v) for v in widths[k:]]
                bits, own, at = np.concatenate([_folded(t.column("bits"), x, w) for x in at]), len(at[0]), np.concatenate(at)
                step = max(1, 2_000_000 // (len(at) * w))
                for lo in range(0, own, step):
                    some, rest = at[lo : min(lo + step, own)], at[lo:]
                    apart = np.bitwise_count(bits[lo : lo + len(some), None, :] ^ bits[None, lo:, :]).sum(2, dtype=np.int64)
                    near = alike(apart, n[some, None], n[None, rest], num, den) & (root[some, None] != root[None, rest])
                    for i, row in zip(some[near.any(1)].tolist(), near[near.any(1)], strict=True):
                        others = rest[row]
                        for j in others[np.unique(label[others], return_index=True)[1]].tolist():
                            if label[i] != label[j]:
                                label[label == label[i]] = label[j]
                                a.append(ids[i])
                                b.append(ids[j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    at = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return at.select("key", "lo", "hi", "id", "root", "n", "bits").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_shingles, component_id) per row of docs; no link is missed.

    Linked are rows whose sets of `words`-word shingles have den * common >= num * united; fewer words are one shingle.
    component_id is the least id that can be reached, itself included. Texts without words (or null) have an empty set
    and no links. Rows of one id with different texts are linked each by its text; repeated rows share their component.
    Rows with a null id have no links and a null component; ids that are no numbers fail the query. Empty table: empty result.
    """
    d = keyed(docs, doc, text)
    index = _index(d, words, num, den)
    # Rows of equal sets are one class; copies go no further. Prefixes stay where they were written, and are read by class.
    classes = classes_of(index, ["n", "bits"])
    reps = index.select("no", "first", "others").join(small(classes.select("id", "no")), "no").select("id", "first", "others")
    sizes = classes.select("id", "n")
    keys = _keys(reps)
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("hub")).where("size > 1")
    buckets = stash(buckets.join(small(sizes.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"))), "hub").select("key", "size", "hub", "hub_n"), "keys")
    total = buckets.agg(F.sum("size")).first()[0] or 0
    # Sides that grow with the corpus are joined by shuffles at every size: hints keep them from being broadcast while they are little.
    met = join_hot(keys, buckets.hint("merge"), ["key"], "size", F.xxhash64("id"), total).where("id <> hub")
    shared = stash(met.join(small(sizes), "id").select("key", "id", "n", "hub", "hub_n"), "buckets")

    own, bits = reps.select("id", "others"), classes.select("id", "bits")
    # Every member is tried against every hub it meets: by sizes, then parities, then each hashed order, then the full sets.
    total = F.col("n") + F.col("hub_n")
    fits = num * total <= (num + den) * F.least("n", "hub_n")
    pairs = cut(shared.where(fits).select("hub", "hub_n", "id", "n").distinct())
    hubs = pairs.groupBy("hub").agg(F.count("*").alias("times"))
    hubs = cut(hubs.join(bits.select(F.col("id").alias("hub"), F.col("bits").alias("hub_bits")).hint("merge"), "hub"))
    tried = join_hot(pairs.join(bits.hint("merge"), "id"), hubs.hint("merge"), ["hub"], "times", F.xxhash64("id"), pairs.count())
    tried = cut(_alike(tried, num, den))
    # Only the prefixes of what stands in a pair are moved.
    met = own.join(small(cut(tried.select("id").union(tried.select("hub")).distinct())), "id", "left_semi")
    hubs = tried.groupBy("hub").agg(F.count("*").alias("times"))
    hubs = cut(hubs.join(met.select(F.col("id").alias("hub"), F.col("others").alias("hub_others")).hint("merge"), "hub"))
    stars = cut(_passing(join_hot(tried.join(met.hint("merge"), "id"), hubs.hint("merge"), ["hub"], "times", F.xxhash64("id"), tried.count()), num, den))
    sets = sets_of(d, stars.select("id").union(stars.select("hub")).distinct(), classes, words)
    links = cut(confirm(stars, sets, num, den))
    roots = components(links)

    # Buckets whose members, but for the hub, still are of several components; buckets of the very same members are one.
    at = stash(shared.select("key", "id").join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "open")
    same = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    split = at.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size"), *same).where("x <> y")
    split = cut(split.groupBy("size", "x", "y", "x1", "x2").agg(F.min("key").alias("key")).select("key", "size"))
    open_ = join_hot(at, split, ["key"], "size", F.xxhash64("id"), at.count())
    blocks = in_blocks(open_.join(small(classes.select("id", (F.size("bits") * 8).alias("bytes"))), "id").select("key", "id", "root", "bytes"))
    near = cut(_candidates(cut(blocks).join(classes.select("id", "n", "bits").hint("merge"), "id"), num, den).distinct())
    more = within_clusters(near, roots, d, classes, words, num, den)
    out = labelled(index, classes, components(links.union(more)))
    return out.select(F.col("id").alias(doc), "n_shingles", "component_id")
