"""Exact Jaccard self-join of n-gram sets with signature trees.

Routing. Sets are sorted into size classes; the sets that a pair needs to lie in one or two neighbouring classes. In a class
whose largest size is u, two sets of the wanted similarity differ in at most k elements, so of more than k parts of the
universe of hashes some have the same elements in both. The hash of a part's elements is a signature. A set tells the first of
them in an order of all signatures by which those of most elements come first: one more than parts can differ between it and the
largest partner of its own size. Of two sets that can link, both tell more than parts differ, so the first signature that both have is
told by both; and what is rare in a corpus comes before single common shingles, which hardly any set has to tell. Each set has
about 0.4 signatures an element. No set and no frequency is gathered for this.

Trees. Sets of a size class that are related by shared signatures meet in one job, each once. Families beyond a bound are dealt into
jobs of bounded size, each around one set of a signature. A job's sets, ordered by size, are the leaves of a signature tree, whose
nodes hold the OR of the token bitmaps below, the range of sizes, and the most tokens that fell on one another. Two nodes are descended
together unless their sizes, or the common bits of their bitmaps, leave less overlap than a link needs, or all their sets are known to
be connected. First the leaves have bitmaps alone, less than an eighth of the sets; what may be linked by them meets again, whole, and leaf
pairs are compared exactly.

Contract. Links within a job become a spanning forest. In families beyond the bound a second round of jobs takes the
signatures whose sets are still in several components: bitmaps tell which sets may be linked with one of another component, and those
meet whole, in jobs no larger than those of the bitmaps. So every linked pair ends in one component.
Equal sets are one set throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import U, Sets, buffers, key, long_array, mix, pieces, shingle_sets, signed, total
from .graph import components
from .runtime import Workspace, documents
from .stats import Bloom

#: A class's largest size over its smallest.
CLASS = 1.4
#: Signatures of a bucket, about.
BUCKET = 400_000
#: Signatures that are sorted and packed at once, about; a batch of more is packed in several parts.
PAIRS = 1 << 19
#: Sets that meet in one job, and their elements: a family of sets that are related by shared signatures, directly or not, or
#: a part of a larger family.
FAMILY, JOB, ELEMENTS = 4096, 512, 2_000_000
#: Elements of the sets of one partition of jobs, about, be they met whole or by bitmaps: some seconds of work.
PART = 2_000_000
#: Signatures of a shingle, for a distance of as many parts as are alike.
SIGNATURES = 1.8
#: Sets under a node, and bits of a bitmap.
LEAVES, BITS = 16, 2048
_A, _B = key(11), key(12)


class Likeness(NamedTuple):
    """Linked from |x & y| / |x | y| >= part / whole on."""

    part: int = 80
    whole: int = 100

    def needed(self, sizes: np.ndarray | int) -> np.ndarray | int:
        """The least overlap of two sets whose sizes add up to `sizes`."""
        return -(-self.part * sizes // (self.part + self.whole))

    def unlike(self, sizes: np.ndarray | int) -> np.ndarray | int:
        """The most elements that are in one alone of two linked sets whose sizes add up to `sizes`."""
        return sizes * (self.whole - self.part) // (self.whole + self.part)

    def partner(self, n: np.ndarray | int) -> np.ndarray | int:
        """The largest size that can link with size n."""
        return n * self.whole // self.part


class Scheme(NamedTuple):
    low: int  #: of the sizes in the class
    high: int
    parts: int
    spare: int  #: parts that are alike, empty ones included, in two sets that link


def schemes(like: Likeness, most: int) -> list[Scheme]:
    """The size classes up to `most`. Equal sets are told by their hash, so classes in which only these link have no parts."""
    out, low = [], 1
    while low <= most:
        high = max(low, int(low * CLASS))
        differ = like.unlike(2 * high)
        if not differ:
            out.append(Scheme(low, high, 0, 0))
        else:
            parts = differ + 1
            for _ in range(3):
                empty = parts * np.exp(-max(1, low * like.part // like.whole) / parts)
                parts = differ + 1 + (int(np.ceil(empty + 4 * np.sqrt(empty))) if differ > 3 else 0)
            out.append(Scheme(low, high, parts, parts - differ))
        low = high + 1
    return out


def identities(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    n = np.diff(s.bounds).astype(U)
    return tuple(mix(total(mix(s.values ^ c), s.bounds) + n) for c in (_A, _B))


def signatures(s: Sets, like: Likeness, classes: list[Scheme], own_bound: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The signatures that all sets tell, and the set of each. own_bound: one more than parts can differ between the set and its
    largest partner in the class; else, one more than between any two of the class."""
    n = np.diff(s.bounds)
    lows = np.array([c.low for c in classes])
    own = np.searchsorted(lows, n, "right") - 1
    out_sig, out_row = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    mixed = mix(s.values ^ key(13))
    for c in np.unique(own[n > 0]):
        for scheme, up in ((c, 0), (c + 1, 1)):
            if scheme >= len(classes) or not classes[scheme].parts:
                continue
            low, high, parts, spare = classes[scheme]
            rows = np.flatnonzero((own == c) & (n > 0) & (n * like.whole // like.part >= low if up else True))
            if not len(rows):
                continue
            size = n[rows]
            at = np.repeat(s.bounds[rows] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            v = mixed[at]
            cell = np.repeat(np.arange(len(rows)) * parts, size) + (((v >> U(32)) * U(parts)) >> U(32)).astype(np.int64)
            cells = len(rows) * parts
            half = [np.bincount(cell, ((s.values[at] * m) >> U(38)).astype(np.float64), cells).astype(U) for m in (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))]
            count = np.bincount(cell, minlength=cells)
            sig = mix(half[0] ^ (half[1] << U(30)) ^ mix(np.tile(np.arange(parts, dtype=U), len(rows)) + key(14, int(scheme))))
            # in the order of all signatures, those of most elements first
            order = (U(63) - np.minimum(count, 63).astype(U)) << U(58) | sig >> U(6)
            order = np.sort(order.reshape(-1, parts), axis=1)
            tell = like.unlike(size + np.minimum(high, like.partner(size))) + 1 if own_bound else np.full(len(rows), parts - spare + 1)
            out_sig.append(order[np.arange(parts) < tell[:, None]] << U(6) | U(min(63, scheme)))  # the class can be read off a signature
            out_row.append(np.repeat(rows, tell))
    return np.concatenate(out_sig), np.concatenate(out_row)


def measured(documents: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, a, b): each document's set size and two hashes of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = buffers(b.column("text"))
            n, first, second = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, U)]
            for lo, hi in pieces(offsets):
                s = shingle_sets(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]], words)
                x, y = identities(s)
                n.append(np.diff(s.bounds))
                first.append(x)
                second.append(y)
            yield pa.record_batch([b.column("doc_id"), *(long_array(np.concatenate(c)) for c in (n, first, second))], names=["doc_id", "n", "a", "b"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, a long, b long")


def _identity(a: np.ndarray, b: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    """One number for each set: the first hash, but where different sets share it, one of both hashes."""
    return np.where(np.isin(a, clashing), a ^ b, a) if len(clashing) else a


def _routed(documents: DataFrame, words: int, like: Likeness, classes: list[Scheme], clashing: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, rows): signatures and set identities, packed, of the distinct sets of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = buffers(b.column("text"))
            pairs, seen = [np.zeros((0, 2), U)], set()
            for lo, hi in pieces(offsets):
                s = shingle_sets(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]], words)
                ident = _identity(*identities(s), clashing)
                fresh = np.zeros(hi - lo, bool)
                for k, x in enumerate(ident.tolist()):  # each set once a batch
                    fresh[k] = x not in seen
                    seen.add(x)
                s = Sets(s.values[np.repeat(fresh, np.diff(s.bounds))], np.concatenate(([0], np.cumsum(np.diff(s.bounds) * fresh))))
                sig, row = signatures(s, like, classes, own_bound=True)
                pairs.append(np.stack((sig, ident[row]), 1))
                if sum(map(len, pairs)) > PAIRS:
                    yield packed_stars(np.concatenate(pairs), buckets)
                    pairs = pairs[:1]
            yield packed_stars(np.concatenate(pairs), buckets)

    return documents.select("text").mapInArrow(run, STARS)


#: Signatures with the one set of a batch that stands for all of the batch's sets of that signature; and the others: signature, that set, set.
STARS = "bucket int, rows binary, local binary"


def packed_stars(pairs: np.ndarray, buckets: int) -> pa.RecordBatch:
    """pairs: signature and set. However many sets share a signature, each batch sends one of them to the signature's bucket."""
    order = np.lexsort((pairs[:, 1].view(np.int64), pairs[:, 0]))
    pairs = pairs[order]
    first = np.append(True, pairs[1:, 0] != pairs[:-1, 0])[: len(pairs)]
    fresh = first | np.append(True, pairs[1:, 1] != pairs[:-1, 1])[: len(pairs)]
    start = np.flatnonzero(first)
    pivot = np.repeat(pairs[start, 1], np.diff(np.append(start, len(pairs))))
    rest = fresh & ~first
    some, rows = packed(pairs[first], pairs[first, 0], buckets)
    others, local = packed(np.stack((pairs[rest, 0], pivot[rest], pairs[rest, 1]), 1), mix(pairs[rest, 0] ^ pairs[rest, 1]), buckets)
    bucket, none = np.append(some, others).astype(np.int32), [b""]
    return pa.record_batch([pa.array(bucket), pa.array(rows + none * len(local), pa.binary()), pa.array(none * len(rows) + local, pa.binary())], names=["bucket", "rows", "local"])


def packed(rows: np.ndarray, by: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """The buckets that rows fall into by a hash, and the bytes of each one's rows."""
    to = ((by >> U(32)) * U(buckets)) >> U(32)
    order = np.argsort(to, kind="stable")
    bounds = np.searchsorted(to[order], np.arange(buckets + 1, dtype=U))
    some, rows = np.flatnonzero(np.diff(bounds)), rows[order]
    return some, [rows[bounds[k] : bounds[k + 1]].tobytes() for k in some]


def unpacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return buffers(column)[1].view(U).reshape(-1, width)


SHARED = "sig long, pivot long, member long"


def shared_of(bucket: pa.Table) -> pa.Table:
    """(sig, pivot, member): every set of each signature that several have is tied to a pivot, directly or by the one of its batch."""
    rows = unpacked(bucket.column("rows"), 2)
    sig, ident = rows[:, 0], signed(np.ascontiguousarray(rows[:, 1]))
    order = np.lexsort((ident, sig))
    sig, ident = sig[order], ident[order]
    new = np.append(True, (sig[1:] != sig[:-1]) | (ident[1:] != ident[:-1]))[: len(sig)]
    sig, ident = sig[new], ident[new]
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
    size = np.diff(np.append(start, len(sig)))
    many = np.ones(len(sig), bool)
    many[start] = False
    local = unpacked(bucket.column("local"), 3)
    columns = zip((sig[many], np.repeat(ident[start], size)[many], ident[many]), local.T, strict=True)
    return pa.table([long_array(np.concatenate((a.view(U), b))) for a, b in columns], names=["sig", "pivot", "member"])


class Tree:
    """A signature tree over sets in order of size. Without `sets`, a pair whose bitmaps leave enough overlap counts as a link."""

    def __init__(self, size: np.ndarray, bits: np.ndarray, sets: list[np.ndarray] | None = None):
        """bits: a row of bytes for each set."""
        self.sets, self.size = sets, size
        bits = np.ascontiguousarray(bits).view(U)
        spill = size - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, size, size, spill)]  # bitmap, least and largest size, most tokens beyond the bits
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sp = self.levels[-1]
            at = np.arange(0, len(b), LEAVES)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sp, at)))

    @classmethod
    def of(cls, sets: list[np.ndarray]) -> Tree:
        size = np.array([len(s) for s in sets])
        return cls(size, bitmaps(np.concatenate(sets), size, BITS), sets)

    def join(self, like: Likeness, group: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect all sets that are connected by links. group: sets of one number are connected from the start."""
        parent = list(range(len(self.size)))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        first: dict[int, int] = {}
        for k, g in enumerate(group.tolist()):
            parent[k] = first.setdefault(g, k)
        links = []
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            level, a, b = todo.pop()
            if level == 0:
                x, y = root(a), root(b)
                if x != y and (self.sets is None or _overlap(self.sets[a], self.sets[b]) >= like.needed(int(self.size[a] + self.size[b]))):
                    parent[max(x, y)] = min(x, y)
                    links.append((a, b))
                continue
            span = LEAVES**level
            if a == b and len({root(k) for k in range(a * span, min((a + 1) * span, len(parent)))}) == 1:
                continue
            if a != b and len({root(k) for h in (a, b) for k in range(h * span, min((h + 1) * span, len(parent)))}) == 1:
                continue
            i, j, good = self._open(level, a, b, like)
            todo.extend((level - 1, int(i[p]), int(j[q])) for p, q in np.argwhere(good)[::-1])
        self.roots = np.array([root(k) for k in range(len(parent))])  #: of each set, one of those that it is connected with
        return links

    def _open(self, level: int, a: int, b: int, like: Likeness) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The children of two nodes, and which pairs of them may hold a link; a pair comes once."""
        bits, lo, hi, spill = self.levels[level - 1]
        i = np.arange(a * LEAVES, min((a + 1) * LEAVES, len(bits)))
        j = np.arange(b * LEAVES, min((b + 1) * LEAVES, len(bits)))
        common = np.bitwise_count(bits[i][:, None, :] & bits[j][None, :, :]).sum(2, dtype=np.int64) + np.minimum(spill[i][:, None], spill[j][None, :])
        good = common >= like.needed(lo[i][:, None] + lo[j][None, :])
        good &= (hi[i][:, None] * like.whole >= lo[j][None, :] * like.part) & (hi[j][None, :] * like.whole >= lo[i][:, None] * like.part)
        if a == b:
            good &= (i[:, None] < j[None, :]) if level == 1 else (i[:, None] <= j[None, :])
        return i, j, good

    def apart(self, like: Likeness, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets that bitmaps leave enough overlap for a link with one of another group, and the first of those that chains of
        such pairs and groups tie each of them to, as a place among them. However many pairs there are, a set comes once."""
        wanted, todo = np.zeros(len(self.size), bool), [(len(self.levels) - 1, 0, 0)]
        parent = {int(g): int(g) for g in np.unique(group)}

        def root(g: int) -> int:
            while parent[g] != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        while todo:
            level, a, b = todo.pop()
            span = LEAVES**level
            inside = np.concatenate((group[a * span : (a + 1) * span], group[b * span : (b + 1) * span]))
            if not level or (inside == inside[0]).all():
                continue
            i, j, good = self._open(level, a, b, like)
            if level > 1:
                todo.extend((level - 1, int(i[p]), int(j[q])) for p, q in np.argwhere(good))
                continue
            good &= group[i][:, None] != group[j][None, :]
            at = np.argwhere(good)
            x, y = i[at[:, 0]], j[at[:, 1]]
            wanted[x] = wanted[y] = True
            for g, h in {(int(g), int(h)) for g, h in zip(group[x], group[y], strict=True)}:
                g, h = root(g), root(h)
                parent[max(g, h)] = min(g, h)
        at = np.flatnonzero(wanted)
        _, first, which = np.unique([root(g) for g in group[at].tolist()], return_index=True, return_inverse=True)
        return at, first[which] if len(at) else np.zeros(0, np.int64)


def bitmaps(values: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """A row of bytes for each set, with a bit for each remainder of a value by `width`, a power of two."""
    bits = np.zeros((len(size), width), bool)
    bits[np.repeat(np.arange(len(size)), size), (values & U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def widths(size: np.ndarray) -> np.ndarray:
    """Bits of a set's own bitmap: the power of two from four for each element on."""
    return 1 << np.maximum(6, np.ceil(np.log2(np.maximum(1, 4 * size))).astype(np.int64))


def _folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one width, the least of theirs."""
    width, out = min(map(len, maps)), []
    for m in maps:
        while len(m) > width:
            m = m[: len(m) // 2] | m[len(m) // 2 :]
        out.append(m)
    return np.stack(out)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


#: What comes of sets that meet. Of bitmaps: groups of sets that may be linked, from labels that are apart (job, id, label, weight); or
#: of such groups only the sets that may be linked with one of another label. Of whole sets: links (a, b).
GROUPS, ACROSS, LINKS = "groups", "across", "links"


def _meeting(like: Likeness, what: str):
    """Rows (job, id, n, label, set) come in order of job and n. One job is held at a time."""

    def one(job: int, ids: list[int], sizes: list[int], labels: list[int], raw: list[np.ndarray]) -> np.ndarray:
        ids, labels, sizes = np.array(ids), np.array(labels), np.array(sizes)
        if what == LINKS:
            sets = []
            for r in raw:
                wide = np.zeros((len(r) // 6, 8), np.uint8)
                wide[:, :6] = r.reshape(-1, 6)
                sets.append(wide.view(U).ravel())
            return ids[np.array(Tree.of(sets).join(like, labels), np.int64).reshape(-1, 2)]
        tree = Tree(sizes, _folded(raw))
        if what == ACROSS:
            at, group = tree.apart(like, labels)
            name = signed(mix(mix(ids[at[group]].view(U)) ^ np.array([job]).view(U)))
            return np.stack((name, ids[at], labels[at], sizes[at]), 1)
        tree.join(like, labels)
        _, group = np.unique(tree.roots, return_inverse=True)
        low, high = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, group, labels)
        np.maximum.at(high, group, labels)
        take = (low < high)[group]
        name = signed(mix(mix(ids[tree.roots].view(U)) ^ np.array([job]).view(U)))
        return np.stack((name, ids, labels, sizes), 1)[take]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b"] if what == LINKS else ["job", "id", "label", "weight"]
        now, held, out = None, ([], [], [], []), [np.zeros((0, len(names)), np.int64)]
        for batch in batches:
            job, ids, n, label = (batch.column(c).to_numpy() for c in ("job", "id", "n", "label"))
            at, data = buffers(batch.column("set"))
            start = np.flatnonzero(np.append(True, job[1:] != job[:-1])[: len(job)])
            for lo, hi in zip(start.tolist(), np.append(start[1:], len(job)).tolist(), strict=True):
                if job[lo] != now:
                    if len(held[0]) > 1:
                        out.append(one(int(now), *held))
                    now, held = job[lo], ([], [], [], [])
                for into, x in zip(held, (ids, n, label), strict=False):
                    into.extend(x[lo:hi].tolist())
                held[3].extend(data[a:b].copy() for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1], strict=True))
            yield _rows(out, names)
            out = out[:1]
        if len(held[0]) > 1:
            out.append(one(int(now), *held))
        yield _rows(out, names)

    return run


def _rows(parts: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([long_array(np.ascontiguousarray(c)) for c in np.concatenate(parts).T], names=names)


def _parts_of(n: Column, weight: Column, share: int = 1) -> Column:
    """The jobs that so many sets of so many elements together are dealt into."""
    return F.greatest(F.ceil(n * share / JOB), F.ceil(weight * share / ELEMENTS)).cast("int")


def connect(shared: DataFrame, sets_of: Callable[[Bloom, bool], DataFrame], like: Likeness, work: Workspace) -> DataFrame:
    """(id, component) of the sets that links connect to a smaller number, from the signatures that several sets share.

    shared: (sig, pivot, member, kind, weight), which ties all sets of a signature together; families are those of signatures of one
    kind, so what chains among small sets does not tie large ones together; weight is the largest size of a set of the kind.
    sets_of: the sets (id, n, set), or their bitmaps, that a filter of their numbers lets through.
    """
    pairs = work.keep(shared.where("pivot <> member").select("kind", "weight", "pivot", "member").distinct(), "pairs")
    edges = pairs.select(F.xxhash64("kind", "pivot").alias("a"), F.xxhash64("kind", "member").alias("b"))
    related = components(edges, work, "families-edges").withColumnRenamed("id", "node")
    each = pairs.select("kind", "weight", F.explode(F.array("pivot", "member")).alias("id")).distinct().withColumn("node", F.xxhash64("kind", "id"))
    each = work.keep(each.join(related, "node", "left").select("kind", "weight", "id", F.coalesce("component", "node").alias("family")), "families")
    sizes = each.groupBy("family").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    sizes = work.keep(sizes.where((F.col("n") > FAMILY) | (F.col("weight") > ELEMENTS)).select("family"), "large")
    large = each.join(sizes, "family", "left_semi").select("kind", "id")
    jobs = each.join(sizes, "family", "left_anti").select(F.col("family").alias("job"), "id", "weight")
    spread = not sizes.isEmpty()
    if spread:
        stars = work.keep(pairs.join(large.withColumnRenamed("id", "member"), ["kind", "member"], "left_semi"), "stars")
        counts = work.keep(stars.groupBy("kind", "pivot").agg(_parts_of(F.count("*"), F.sum("weight")).alias("chunks")), "chunks")
        stars = stars.join(counts, ["kind", "pivot"]).withColumn("job", F.xxhash64("kind", "pivot", F.pmod(F.xxhash64("member"), F.col("chunks"))))
        jobs = jobs.unionAll(stars.select("job", F.col("member").alias("id"), "weight")).unionAll(stars.select("job", F.col("pivot").alias("id"), "weight").distinct())
    ids = each.select("id").distinct()
    maps = work.keep(sets_of(Bloom.of(ids, ids.count()), True).dropDuplicates(["id"]), "bitmaps")

    def whole(jobs: DataFrame, name: str) -> DataFrame:
        """The links of sets that bitmaps do not tell apart; only those are sent whole."""
        ids = jobs.select("id").distinct()
        sets = sets_of(Bloom.of(ids, ids.count()), False).dropDuplicates(["id"])
        return work.keep(_met(jobs, sets, like, LINKS), name)

    def once(near: DataFrame) -> DataFrame:
        """Groups of the same sets, from several jobs, meet once."""
        groups = near.groupBy("job").agg(F.bit_xor(F.xxhash64("id")).alias("sets"), F.count("*").alias("n"))
        return near.join(groups.groupBy("sets", "n").agg(F.min("job").alias("job")).select("job"), "job", "left_semi")

    first = work.keep(jobs.withColumn("label", F.col("id")), "jobs")
    near = work.keep(_met(first, maps, like, GROUPS), "near")
    links = whole(work.keep(once(near), "whole") if spread else near, "links")
    found = components(links, work)
    if not spread:
        return found

    # in large families: signatures whose sets are still apart
    tied = shared.select("sig", "kind", "weight", F.explode(F.array("pivot", "member")).alias("id")).distinct()
    tied = tied.join(large, ["kind", "id"], "left_semi").join(found, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("label"), "weight")
    apart = tied.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("job")).where("low <> high and size > 2")
    apart = work.keep(apart.groupBy("job", "size").agg(F.min("sig").alias("sig")).select("sig", "job"), "apart")
    if apart.isEmpty():
        return found
    rows = work.keep(tied.join(apart, "sig").select("job", "id", "label", "weight"), "open")
    near = work.keep(_met(work.keep(_across(rows, work, "blocks"), "jobs-again"), maps, like, ACROSS), "near-again")
    more = whole(work.keep(once(near), "whole-again"), "more")
    return components(links.unionAll(more), work, "edges-again")


def _across(rows: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Jobs (job, id, label, weight) in which any two sets of one group (job) and different labels meet.

    A group that is no larger than a job is one. Of others, the sets of a group's most frequent label are dealt into blocks, and so are the others. Blocks of others meet each other and all of the
    frequent one's, which don't meet each other, as their sets are connected.
    """
    each = rows.groupBy("job", "label").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    top = each.groupBy("job").agg(F.max(F.struct("n", "w", "label")).alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = top.select("job", F.col("top.label").alias("most"), _parts_of(F.col("top.n"), F.col("top.w"), 2).alias("tops"), _parts_of(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w"), 2).alias("rests"), (_parts_of(F.col("n"), F.col("w")) == 1).alias("one"))
    rows = rows.join(work.keep(blocks, name), "job").withColumn("rest", F.col("label") != F.col("most"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("tops")))
    rows = rows.withColumn("block", block)
    rest = F.transform(F.sequence(F.lit(0).cast("int"), F.col("rests") - 1), lambda k: F.when(F.col("rest"), F.xxhash64("job", F.lit(0), F.least(k, F.col("block")), F.greatest(k, F.col("block")))).otherwise(F.xxhash64("job", F.lit(1), F.col("block"), k)))
    tops = F.when(F.col("rest"), F.transform(F.sequence(F.lit(0).cast("int"), F.col("tops") - 1), lambda k: F.xxhash64("job", F.lit(1), k.cast("long"), F.col("block").cast("int")))).otherwise(F.array().cast("array<bigint>"))
    jobs = F.when(F.col("one"), F.array("job")).otherwise(F.concat(rest, tops))
    return rows.select(F.explode(jobs).alias("job"), "id", "label", "weight").distinct()


def _met(members: DataFrame, sets: DataFrame, like: Likeness, what: str) -> DataFrame:
    """members: (job, id, label, weight). Partitions are read in order, so a job is all that is held of one."""
    total = members.agg(F.sum("weight")).first()[0] or 0
    parts = int(max(1, total // PART))
    rows = members.drop("weight").join(sets, "id").repartition(parts, "job").sortWithinPartitions("job", "n", "id")
    schema = "a long, b long" if what == LINKS else "job long, id long, label long, weight long"
    return rows.select("job", "id", "n", "label", "set").mapInArrow(_meeting(like, what), schema)


def _sets_of(documents: DataFrame, words: int, clashing: np.ndarray, wanted: Bloom, bits: bool) -> DataFrame:
    """(id, n, set) of each text whose set the filter lets through, once a batch."""
    sent = documents.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = buffers(b.column("text"))
            for lo, hi in pieces(offsets):
                s = shingle_sets(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]], words)
                yield chosen(s, _identity(*identities(s), clashing), sent.value, bits)

    return documents.select("text").mapInArrow(run, "id long, n long, set binary")


def chosen(s: Sets, ident: np.ndarray, wanted: Bloom, bits: bool) -> pa.RecordBatch:
    """The distinct sets, of one element at least, whose numbers the filter lets through: six bytes an element, or bitmaps."""
    ident, at = np.unique(ident, return_index=True)
    take = wanted.holds(ident) & (np.diff(s.bounds)[at] > 0)
    ident, at = ident[take], at[take]
    size = np.diff(s.bounds)[at]
    if not bits:
        raw = s.values.view(np.uint8).reshape(-1, 8)[:, :6]
        values = [raw[s.bounds[k] : s.bounds[k + 1]].tobytes() for k in at]
        return pa.record_batch([long_array(ident), long_array(size), pa.array(values, pa.binary())], names=["id", "n", "set"])
    width, found = widths(size), [pa.record_batch([[], [], []], schema=_SET)]
    for w in np.unique(width).tolist():
        every, step = np.flatnonzero(width == w), max(1, (1 << 22) // w)
        for k in (every[i : i + step] for i in range(0, len(every), step)):
            where = np.repeat(s.bounds[at[k]] - (np.cumsum(size[k]) - size[k]), size[k]) + np.arange(size[k].sum())
            made = [r.tobytes() for r in bitmaps(s.values[where], size[k], w)]
            found.append(pa.record_batch([long_array(ident[k]), long_array(size[k]), pa.array(made, pa.binary())], schema=_SET))
    return pa.Table.from_batches(found).combine_chunks().to_batches()[0] if len(found) > 1 else found[0]


_SET = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set", pa.binary())])


def similar_documents(documents: DataFrame, words: int = 5, like: Likeness = Likeness()) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id).

    component_id is the smallest id that links lead to. A null or empty text, or one without words, has no shingles and no
    links; a text of fewer words than a shingle is one shingle. Rows repeated under one id are rows of their own, linked where
    their texts are; a null id never is the smallest. An empty table gives no rows. Columns but doc_id and text are not read.
    """
    work = Workspace(documents.sparkSession, "jaccard")
    sized = work.keep(measured(documents, words), "sized")
    some = sized.where("n > 0")
    most, shingles = some.agg(F.max("n"), F.sum("n")).first()
    if most is None:
        return sized.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    clashes = some.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("b2")).where("b <> b2")
    clashing = np.array([r.a for r in clashes.select("a").collect()], np.int64).view(U)  # by chance, some 2**-65 of all pairs of sets
    classes = schemes(like, like.partner(int(most)))
    buckets = int(max(1, SIGNATURES * (like.whole - like.part) / like.part * shingles // BUCKET))
    shared = _routed(documents, words, like, classes, clashing, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(shared_of, SHARED)
    kind = F.col("sig").bitwiseAND(63).cast("int")
    shared = work.keep(shared.withColumns({"kind": kind, "weight": F.element_at(F.array(*(F.lit(c.high) for c in classes)), kind + 1).cast("long")}), "shared")
    found = connect(shared, lambda wanted, bits: _sets_of(documents, words, clashing, wanted, bits), like, work)

    ident = F.col("a")
    if len(clashing):
        ident = F.when(F.col("a").isin([int(x) for x in signed(clashing)]), F.col("a").bitwiseXOR(F.col("b"))).otherwise(ident)
    rows = sized.withColumn("ident", F.when(F.col("n") > 0, ident))
    first = rows.where("n > 0").groupBy("ident").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    first = first.join(found.withColumnRenamed("id", "ident"), "ident", "left")
    # a component's smallest set number has no row in `found`
    roots = found.select(F.col("component").alias("ident")).distinct().withColumn("root", F.col("ident"))
    first = work.keep(first.join(roots, "ident", "left").withColumn("component", F.coalesce("component", "root")).where("copies > 1 or component is not null"), "first")
    joined = first.where("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    named = first.join(joined, "component", "left").select("ident", F.coalesce("least", "first").alias("component_id"))
    out = rows.join(named, "ident", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir), words=4, like=Likeness(85, 100))
