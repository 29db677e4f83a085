"""N-gram Jaccard join: exact links between documents' shingle sets, and their connected components.

A document's set has its distinct shingles of `words` words (ASCII letters lower-cased, words between ASCII blanks);
two documents link when 100 * |intersection| >= percent * |union|. Nothing is approximate but that shingles stand as
64-bit hashes.

1. Equal sets are one set with members (their links are certain), whatever their number.
2. Each set's first shingles in hash order are indexed. Of a set of n shingles a linked one lacks at most
   u(n) = n * (100 - percent) / 100, so with u(n) + l(n) indexed ones linked sets share min(l) of them or more. A set
   that shares fewer than any partner would need is left out.
3. Two linked sets share half of what they need in lists of up to SHORT sets, or more than half in longer ones. Pairs of
   short lists are counted, and those with half of the need go on if sizes and parity sketches allow a link (a bit flips
   for each shingle, so bits that differ are at most the shingles that differ). Longer lists are walked by size, for
   sets with more than half of their need in such lists; lists over HOT sets only for sets whose shared shingles may
   all be in such lists.
4. The connected sets of all lists meet in one task each, and there the links are found exactly, with set relations used
   twice: an index list's entries are skipped by position where sizes exclude them, and a set's overlaps are derived
   from those of a very similar set that is done, by adding and taking away the lists of the shingles in which the two
   differ.

A list of over LIST_BLOCK sets, or a component of over BLOCK shingles, never meets in one task (`split_links`). It is
dealt in blocks, each of which is solved by itself; then the set with the most links is held against all blocks as a
pivot, which joins nearly all of a group of near copies. Only sets of blocks' groups that the pivot doesn't reach
visit other blocks, a few blocks at first, and more of them as long as they meet none that the pivot reached. A visitor
is held against a block's own sets alone, by parity sketches, and exactly where these allow a link. So the work grows with
the group's size but for sets that link with none of it, and links are still exact. Components of
over BLOCK shingles are first taken apart in the same way by the wide sketches of their sets.

A null or blank text has an empty set and links with nothing, not even its copies. Repeated rows are copies of each
other under one id; where an id is repeated with other texts, each text has its own links, and each row the class of
its own text. A row without doc_id gets the class of its text's copies, null if there are none with an id, and
links no others. Empty tables give empty results; columns but doc_id and text are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grouped, map_batches, stage
from .graph import components

#: Sets of an index list: up to SHORT its pairs are counted; over HOT it is walked for some sets alone.
SHORT = 8
HOT = 512
#: Sets of a list (or of sketches of one component) that meet in one task.
LIST_BLOCK = 4096
#: Shingles of a candidate component's sets that meet in one task; a larger one is dealt in blocks of about so many.
BLOCK = 1_000_000
_P = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    told = (text or "").encode().lower().split()
    n = len(told)
    if not n:
        return np.zeros(0, np.uint64)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(told))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, told), np.uint64, n)
    out = h[: n - words + 1].copy()
    for k in range(1, words):
        out = (out ^ (out >> np.uint64(31))) * _P[0] + h[k : n - words + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * _P[1]
    return np.unique(out ^ (out >> np.uint64(29)))


def slack(n: int, percent: int) -> int:
    """Most shingles of a set of n that a linked set lacks."""
    return n * (100 - percent) // 100


def extra(n: int) -> int:
    return 1 + n * 3 // 100


def indexed(n: int, percent: int) -> int:
    return min(n, slack(n, percent) + extra(n))


def needed(n: int, percent: int) -> int:
    """Indexed shingles that a set of n shares with any set it links with."""
    return min(indexed(k, percent) - slack(k, percent) for k in {n, -(-n * percent // 100)})


#: Powers of two of the most bits in the sketches that lists carry, and in those that pairs and large components are tested by.
LIST_BITS, WIDE_BITS = 10, 14


def sketch(hashes: np.ndarray, most: int) -> bytes:
    """Parity bits of the hashes; over half as many as there are hashes and no more than these, 64 to 2 ** most."""
    bits = 1 << min(most, max(6, int(len(hashes)).bit_length() - 1))
    flips = np.bincount((hashes >> np.uint64(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def most_apart(a: int, b: int, percent: int) -> int:
    """Most shingles that are in just one of two linked sets of a and b."""
    return (a + b) * (100 - percent) // (100 + percent)


def _compatible(a: tuple[int, int, int], b: tuple[int, int, int], percent: int) -> bool:
    """a, b: size, sketch as a number, its bits; a is no larger."""
    if a[0] * 100 < percent * b[0]:
        return False
    x, y, bits = a[1], b[1], b[2]
    while bits > a[2]:
        bits >>= 1
        y = (y ^ (y >> bits)) & ((1 << bits) - 1)
    return (x ^ y).bit_count() <= most_apart(a[0], b[0], percent)


def _set(node: int, n: int, bits: bytes) -> tuple[int, int, int, int]:
    return node, n, int.from_bytes(bits, "little"), 8 * len(bits)


def _words(bits: list[bytes]) -> np.ndarray:
    """Sketches of one size as rows of words."""
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)


class _Sketches:
    """`_compatible` of one set with many at a time, whatever the sizes of their sketches."""

    def __init__(self, n: list[int], bits: list[bytes], percent: int):
        self.n, self.percent = np.array(n, np.int64), percent
        width = np.array([len(b) // 8 for b in bits], np.int64)
        self.rows = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
        self.words = {w: _words([bits[k] for k in rows]) for w, rows in self.rows.items()}
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def _fold(self, width: int, to: int) -> np.ndarray:
        if width == to:
            return self.words[width]
        if (width, to) not in self.folded:
            wide = self._fold(width, 2 * to)
            self.folded[width, to] = wide[:, :to] ^ wide[:, to:]
        return self.folded[width, to]

    def fits(self, n: int, bits: bytes) -> np.ndarray:
        """Whether each may link with that one."""
        small, large = np.minimum(self.n, n), np.maximum(self.n, n)
        out = small * 100 >= self.percent * large
        told = np.frombuffer(bits, np.uint64)[None]
        for width, rows in self.rows.items():
            if not out[rows].any():
                continue
            one = told
            while one.shape[1] > width:
                half = one.shape[1] // 2
                one = one[:, :half] ^ one[:, half:]
            flips = np.bitwise_count(self._fold(width, one.shape[1]) ^ one).sum(axis=1, dtype=np.int64)
            out[rows] &= flips <= (self.n[rows] + n) * (100 - self.percent) // (100 + self.percent)
        return out


def _many_roots(ids: list[int], n: list[int], bits: list[bytes], percent: int) -> tuple[list[int], list[int]]:
    """`list_roots` of long lists."""
    order = sorted(range(len(ids)), key=lambda k: (n[k], ids[k]))
    told = _Sketches([n[k] for k in order], [bytes(bits[k]) for k in order], percent)
    open_ = np.ones(len(ids), bool)
    roots, scores = [0] * len(ids), [0] * len(ids)
    for first in range(len(ids)):
        if not open_[first]:
            continue
        open_[first] = False
        group, at = [first], 0
        while at < len(group) and open_.any():
            u = order[group[at]]
            met = np.flatnonzero(told.fits(n[u], bytes(bits[u])) & open_)
            open_[met] = False
            group.extend(met.tolist())
            at += 1
        for k in group:
            roots[order[k]] = ids[order[first]]
        scores[order[sorted(group)[len(group) // 2]]] = len(group)
    return roots, scores


def list_between(n: list[int], bits: list[bytes], ns: list[int], others: list[bytes], roots: list[int], percent: int) -> list[tuple[int, int]]:
    """Which of the first sets may link with which of the others, one of each root."""
    told, roots, out = _Sketches(ns, [bytes(b) for b in others], percent), np.array(roots, np.int64), []
    for k, one in enumerate(zip(n, bits)):
        met = np.flatnonzero(told.fits(one[0], bytes(one[1])))
        out.extend((k, int(met[j])) for j in np.unique(roots[met], return_index=True)[1])
    return out


#: Sets of a list from which many are held against one at a time.
MANY = 64


def list_roots(ids: list[int], n: list[int], bits: list[bytes], percent: int) -> tuple[list[int], list[int]]:
    """For each set the first of those that it goes together with by sizes and sketches, and the number of these where the set is the middle one by size (else 0)."""
    if len(ids) >= MANY and len(set(ids)) == len(ids):
        return _many_roots(ids, n, bits, percent)
    left = sorted(map(_set, ids, n, bits), key=lambda s: (s[1], s[0]))
    root: dict[int, int] = {}
    score: dict[int, int] = {}
    while left:
        first, rest = left[0], left[1:]
        queue, group = [first], [first]
        while queue and rest:
            u = queue.pop()
            stay = []
            for v in rest:
                small, large = (u, v) if u[1] <= v[1] else (v, u)
                if _compatible(small[1:], large[1:], percent):
                    queue.append(v)
                    group.append(v)
                else:
                    stay.append(v)
            rest = stay
        root.update((v[0], first[0]) for v in group)
        middle = sorted(group, key=lambda s: (s[1], s[0]))[len(group) // 2]
        score[middle[0]] = len(group)
        left = rest
    return [root[k] for k in ids], [score.get(k, 0) for k in ids]


def list_against(one: tuple[int, bytes], n: list[int], bits: list[bytes], percent: int) -> list[bool]:
    """Whether each set may link with `one` (size, sketch)."""
    it = _set(0, *one)[1:]
    others = [_set(0, *x)[1:] for x in zip(n, bits)]
    return [_compatible(min(it, x, key=lambda s: s[0]), max(x, it, key=lambda s: s[0]), percent) for x in others]


def _fine(most: int):
    """A parity sketch of one size for sets of up to `most` hashes, wide enough that bits that differ are nearly as many as the hashes that do."""
    power = min(16, max(10, int(4 * most).bit_length()))
    return lambda s: np.packbits((np.bincount((s >> np.uint64(7)).astype(np.int64) & ((1 << power) - 1), minlength=1 << power) & 1).astype(np.uint8)).view(np.uint64)


#: Sets from which on those that are connected already are passed over.
CROWD = 256


def exact_roots(ids: list[int], sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """For each set the least id of those it is connected with by exact links, and its number of links (in a crowd, of those that were looked at).

    In a crowd a set is held against those alone that it isn't connected with and that sketches allow a link with, where these are few.
    """
    n = len(ids)
    links = np.zeros(n, np.int64)
    order = sorted(range(n), key=lambda k: (len(sets[k]), ids[k]))
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    sizes = np.array([len(sets[k]) for k in order], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, token, count = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True, return_counts=True)
    shared = count[token] > 1
    del count
    at = np.concatenate(([0], np.cumsum(sizes)))
    kept = np.concatenate(([0], np.cumsum(shared)))
    token, owner = token[shared], owner[shared]
    own = [token[kept[at[k]] : kept[at[k + 1]]] for k in range(n)]  # sorted, as the hashes were
    entries = np.sort(token.astype(np.int64) * n + owner)  # the index lists, each in order of size
    place = entries % n

    def overlaps(tokens: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """How many of `tokens` each set from lo up to hi has; entries outside are skipped by position."""
        t = tokens.astype(np.int64) * n
        a, b = np.searchsorted(entries, t + lo), np.searchsorted(entries, t + hi)
        width = b - a
        total = int(width.sum())
        if not total:
            return np.zeros(hi - lo, np.int64)
        flat = np.repeat(a - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(total)
        return np.bincount(place[flat] - lo, minlength=hi - lo)

    crowd = n >= CROWD
    if crowd:
        flips = _fine(int(sizes[-1]))
        words, label = np.stack([flips(sets[k]) for k in order]), np.arange(n)  # label: each place's component

    def join(k: int, z: int) -> None:
        a, b = root(order[k]), root(order[z])
        if a != b:
            parent[max(a, b, key=lambda x: ids[x])] = min(a, b, key=lambda x: ids[x])
            if crowd:
                label[label == label[z]] = label[k]

    done: dict[int, tuple[int, np.ndarray]] = {}  # of sets that later ones may derive from: from, overlaps
    base_of: dict[int, int] = {}
    for k in range(n):
        lo, hi = k + 1, int(np.searchsorted(sizes, int(sizes[k]) * 100 // percent, side="right"))
        if lo >= hi:
            continue
        if crowd:
            rest = np.flatnonzero(label[lo:hi] != label[k]) + lo
            apart = np.bitwise_count(words[rest] ^ words[k]).sum(axis=1, dtype=np.int64)
            fits = rest[apart <= (sizes[rest] + sizes[k]) * (100 - percent) // (100 + percent)]
            if 8 * len(fits) <= hi - lo:
                for z in fits.tolist():
                    if label[z] != label[k]:
                        both = len(np.intersect1d(own[k], own[z], assume_unique=True))
                        if 100 * both >= percent * (sizes[k] + sizes[z] - both):
                            links[[order[k], order[z]]] += 1
                            join(k, z)
                continue
        base = base_of.get(k)
        if base in done:
            first, known = done[base]
            upto = min(first + len(known), hi)
            gone, come = np.setdiff1d(own[base], own[k], assume_unique=True), np.setdiff1d(own[k], own[base], assume_unique=True)
            found = known[lo - first : upto - first] - overlaps(gone, lo, upto) + overlaps(come, lo, upto) if upto > lo else np.zeros(0, np.int64)
            if hi > max(upto, lo):
                found = np.concatenate((found, overlaps(own[k], max(upto, lo), hi)))
        else:
            found = overlaps(own[k], lo, hi)
        linked = np.flatnonzero(100 * found >= percent * (sizes[k] + sizes[lo:hi] - found)) + lo
        links[order[k]] += len(linked)
        np.add.at(links, np.array(order)[linked], 1)
        close = linked[2 * found[linked - lo] * 10 >= 9 * (sizes[k] + sizes[linked])]
        fresh = [int(z) for z in close if z not in base_of]
        if fresh:
            done[k] = (lo, found)
            for z in fresh:
                base_of[z] = k
            if len(done) > 64:
                done.pop(next(iter(done)))
        for z in linked.tolist():
            join(k, z)
    return [ids[root(k)] for k in range(n)], links.tolist()


def exact_against(one: np.ndarray, sets: list[np.ndarray], percent: int) -> list[bool]:
    """Whether each set links with `one`; the overlaps of all are found at once."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    met = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(met.astype(np.int64), np.cumsum(sizes) - sizes)
    return (100 * both >= percent * (sizes + len(one) - both)).tolist()


def exact_between(sets: list[np.ndarray], others: list[np.ndarray], roots: list[int], percent: int) -> list[tuple[int, int]]:
    """Which of the first sets link with which of the others, one of each root; those that sketches put nearest are looked at first."""
    flips = _fine(max(map(len, (*sets, *others))))
    words, roots = np.stack([flips(s) for s in others]), np.array(roots, np.int64)
    sizes, out = np.array([len(s) for s in others], np.int64), []
    for k, one in enumerate(sets):
        near = np.flatnonzero(np.minimum(sizes, len(one)) * 100 >= percent * np.maximum(sizes, len(one)))
        apart = np.bitwise_count(words[near] ^ flips(one)).sum(axis=1, dtype=np.int64)
        fits = apart <= (sizes[near] + len(one)) * (100 - percent) // (100 + percent)
        near, apart = near[fits], apart[fits]
        met: set[int] = set()
        for j in near[np.argsort(apart, kind="stable")].tolist():
            if roots[j] not in met:
                both = len(np.intersect1d(one, others[j], assume_unique=True))
                if 100 * both >= percent * (len(one) + len(others[j]) - both):
                    met.add(int(roots[j]))
                    out.append((k, j))
    return out


SETS = "doc_id long, mark long, n long, key_a long, key_b long, first array<long>, sketch binary, wide binary"


def _keys(s: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def find_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b, first, bits, wide = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, words)
                n.append(len(s))
                if not len(s):
                    for c in (a, b, first, bits, wide):
                        c.append(None)
                    continue
                for c, v in zip((a, b), _keys(s)):
                    c.append(v)
                first.append(s[: indexed(len(s), percent)].view(np.int64))
                bits.append(sketch(s, LIST_BITS))
                wide.append(sketch(s, WIDE_BITS) if len(s) >= 2 << LIST_BITS else None)
            kinds = (*(pa.int64(),) * 3, pa.list_(pa.int64()), pa.binary(), pa.binary())
            columns = [pa.array(v, k) for v, k in zip((n, a, b, first, bits, wide), kinds)]
            return pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], [x.split()[0] for x in SETS.split(", ")])

        return work

    return map_batches(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text"), make, SETS)


ITEM = ("task", "key", "block", "node", "n", "bits", "pivot")


def _groups(batches, rows: int, columns: tuple[str, ...] = ITEM):
    """The rows of each task, as lists."""
    for t in grouped(batches, "task", rows):
        task = t.column("task").to_numpy()
        edge = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
        for a, b in zip(edge[:-1], edge[1:]):
            part = t.slice(a, b - a)
            yield {c: part.column(c).to_pylist() if c != "bits" else [x.as_buffer() for x in part.column(c)] for c in columns}


def _rows(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], list(columns))


def _dealt(items: DataFrame, columns: tuple[str, ...] = ITEM) -> DataFrame:
    """Rows of a task side by side. The number of partitions is given, as few bytes may be much work."""
    told = items if "pivot" in items.columns else items.withColumn("pivot", F.lit(False))
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return told.withColumn("task", F.xxhash64("key", "block")).select(*columns).repartition(n, "task").sortWithinPartitions("task")


def solved(items: DataFrame, solve, rows: int) -> DataFrame:
    """key, block, a, b, score: for each set the one that stands for its group among those of its block. items: key, block, node, n, bits."""

    def run(batches):
        for g in _groups(batches, rows):
            roots, score = solve(g["node"], g["n"], g["bits"])
            yield _rows({"key": g["key"], "block": g["block"], "a": g["node"], "b": roots, "score": score})

    return _dealt(items).mapInArrow(run, "key long, block long, a long, b long, score long")


#: Blocks whose visitors come to one task, and how many times as many blocks a visitor goes to from one round to the next.
SPAN, MORE = 8, 4


def split_links(items: DataFrame, solve, against, between, rows: int, name: str) -> DataFrame:
    """a, b: edges that connect all linked sets of each key. items: staged; key, blocks (in how many it is dealt), node, n, bits.

    Two sets of a key are in one block, or both connected with the pivot, or one of them has been to all blocks.
    """
    own = items.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    alone = stage(solved(own, solve, rows), f"{name}-blocks")
    pivots = alone.groupBy("key").agg(F.max_by("a", F.struct("score", "a")).alias("node"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    sent = items.join(pivots, ["key", "node"]).dropDuplicates(["key"]).withColumn("block", every).withColumn("pivot", F.lit(True))

    def hold(batches):
        for g in _groups(batches, rows):
            at = g["pivot"].index(True)
            node, n, bits = ([x for k, x in enumerate(g[c]) if k != at] for c in ("node", "n", "bits"))
            told = [x for x, met in zip(node, against(g["n"][at], g["bits"][at], n, bits) if n else ()) if met]
            yield _rows({"key": g["key"][:1] * len(told), "a": told, "b": [g["node"][at]] * len(told)})

    both = own.withColumn("pivot", F.lit(False)).unionByName(sent)
    reached = stage(_dealt(both).mapInArrow(hold, "key long, a long, b long"), f"{name}-pivots")
    groups = alone.join(reached.select("key", "a", F.lit(True).alias("met")), ["key", "a"], "left").groupBy("key", "block", "b").agg(F.max("met").alias("met"))
    placed = alone.join(groups, ["key", "block", "b"]).select("key", "block", F.col("a").alias("node"), F.col("b").alias("root"), F.coalesce("met", F.lit(False)).alias("met"))
    placed = stage(placed.distinct(), f"{name}-groups")
    edges = alone.select("a", "b").unionByName(reached.select("a", "b"))
    columns = (*ITEM, "root", "met")

    def meet(batches):
        for g in _groups(batches, rows, columns):
            there = [[x for x, p in enumerate(g["pivot"]) if p is kind] for kind in (True, False)]
            (n, bits), (ns, others) = ([[g[c][k] for k in ks] for c in ("n", "bits")] for ks in there)
            roots = [g["root"][k] for k in there[1]]
            told = between(n, bits, ns, others, roots) if n and ns else []
            yield _rows({"key": g["key"][:1] * len(told), "a": [g["node"][there[0][i]] for i, _ in told], "b": [roots[j] for _, j in told], "met": [int(g["met"][there[1][j]]) for _, j in told]})

    apart = placed.filter("not met").drop("met")
    most = 0 if apart.isEmpty() else items.agg(F.max("blocks")).first()[0]
    low, high = 1, 2
    while low < most:
        part = F.floor(F.col("step") / SPAN).cast("long") * F.col("blocks")  # makes a task of its own
        steps = F.explode(F.sequence(F.lit(low).cast("long"), F.least(F.lit(high), F.col("blocks") - 1)))
        guests = items.filter(F.col("blocks") > low).join(apart, ["key", "node"]).withColumn("step", steps).withColumn("block", F.pmod(F.col("block") + F.col("step"), F.col("blocks")) + part)
        spans = F.explode(F.sequence(F.lit(low // SPAN).cast("long"), F.floor(F.least(F.lit(high), F.col("blocks") - 1) / SPAN).cast("long")))
        hosts = items.filter(F.col("blocks") > low).join(placed, ["key", "node"]).join(apart.select("key").distinct(), "key", "left_semi")
        hosts = hosts.withColumn("span", spans).withColumn("block", F.col("block") + F.col("span") * F.col("blocks"))
        cut = lambda df, guest: df.select("key", "block", "node", "n", "bits", "root", F.lit(guest).alias("pivot"), (F.lit(False) if guest else F.col("met")).alias("met"))
        met = stage(_dealt(cut(guests, True).unionByName(cut(hosts, False)), columns).mapInArrow(meet, "key long, a long, b long, met long"), f"{name}-met")
        edges = edges.unionByName(met.select("a", "b"))
        joined = met.filter("met > 0").select("key", F.col("a").alias("node")).distinct()
        joined = apart.join(joined, ["key", "node"], "left_semi").select("key", "block", "root").distinct()
        apart = stage(apart.join(joined, ["key", "block", "root"], "left_anti"), f"{name}-apart")
        if apart.isEmpty():
            break
        low, high = high + 1, high * MORE
    return edges


def _needed_column(n, percent: int):
    """`needed` as a column expression."""
    part = F.ceil(n * percent / F.lit(100)).cast("long")

    def least(k):
        gone = F.floor(k * (100 - percent) / F.lit(100)).cast("long")
        return F.least(k, gone + 1 + F.floor(k * 3 / F.lit(100)).cast("long")) - gone

    return F.least(least(n), least(part))


def by_sketches(items: DataFrame, percent: int, name: str) -> DataFrame:
    """a, b: edges of sets that may link by sizes and sketches; items: key, blocks, node, n, bits."""
    solve = lambda ids, n, bits: list_roots(ids, n, bits, percent)
    against = lambda n, bits, ns, others: list_against((n, bits), ns, others, percent)
    between = lambda n, bits, ns, others, roots: list_between(n, bits, ns, others, roots, percent)
    one = items.filter("blocks = 1").withColumn("block", F.lit(0).cast("long"))
    edges = solved(one, solve, 20_000).filter("a <> b").select("a", "b").distinct()
    large = items.filter("blocks > 1")
    return edges if large.isEmpty() else edges.unionByName(split_links(stage(large, f"{name}-large"), solve, against, between, 20_000, name))


def candidate_edges(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: sets that lists put together. sets: distinct ones; node, n, first, sketch, wide."""
    entries = sets.select("node", F.explode("first").alias("token"))
    lists = entries.groupBy("token").agg(F.count("*").alias("met")).filter("met > 1")
    shared = entries.join(lists, "token").groupBy("node").agg(F.collect_list(F.struct("token", "met")).alias("shared"))  # bounded by the document's own length
    told = sets.select("node", "n", "sketch", _needed_column(F.col("n"), percent).alias("need")).join(shared, "node").filter(F.size("shared") >= F.col("need"))
    told = stage(told, "shared")
    # Pairs that share half of their need in short lists.
    short = told.select("node", "n", "need", F.explode(F.filter("shared", lambda t: t["met"] <= SHORT)).alias("t")).withColumn("token", F.col("t.token"))
    lists = short.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "node", "need"))).alias("m"))  # of SHORT sets at most

    def partners(x, k):
        fits = F.filter(F.slice("m", k + 2, SHORT), lambda y: x["n"] * 100 >= y["n"] * percent)
        return F.transform(fits, lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), F.greatest(x["need"], y["need"]).alias("need")))

    pairs = lists.select(F.inline(F.flatten(F.transform("m", partners)))).groupBy("a", "b").agg(F.count("*").alias("met"), F.max("need").alias("need")).filter("2 * met >= need")
    bits = sets.select("node", "n", F.coalesce("wide", "sketch").alias("bits"))
    side = lambda c: bits.select(F.col("node").alias(c), F.struct("n", "bits").alias(f"of_{c}"))

    def test(batches):
        for batch in batches:
            keep = [_compatible(_set(0, **x)[1:], _set(0, **y)[1:], percent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    few = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(test, "a long, b long")
    # Longer lists.
    half = F.floor(F.col("need") / 2) + 1
    over = lambda most: F.size(F.filter("shared", lambda t: t["met"] > most))
    heavy = told.filter(over(SHORT) >= half).withColumn("heavy", over(HOT) >= half)
    asked = F.filter("shared", lambda t: (t["met"] > SHORT) & ((t["met"] <= HOT) | F.col("heavy")))
    walked = heavy.select("node", "n", F.col("sketch").alias("bits"), F.explode(asked).alias("t"))
    blocks = F.ceil(F.col("t.met") / LIST_BLOCK).cast("long")
    return few.unionByName(by_sketches(walked.select(F.col("t.token").alias("key"), blocks.alias("blocks"), "node", "n", "bits"), percent, "lists"))


def sized(told: DataFrame, weight, most: int) -> DataFrame:
    """`told` (node, label, n) with key and blocks, in how many parts a label of that weight is dealt."""
    sizes = told.groupBy("label").agg(F.ceil(F.sum(weight) / most).cast("long").alias("blocks"))
    return told.join(sizes, "label").withColumn("key", F.col("label"))


def narrowed(labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, label, n: components of over BLOCK shingles are taken apart once more, by size and the wide sketches of their sets (at most 2 KB each)."""
    told = stage(labels.join(sets.select("node", "n"), "node"), "members")
    large = sized(told, F.col("n"), BLOCK).filter("blocks > 1").select("node", "label", "n")
    if large.isEmpty():
        return told
    large = stage(large, "large")
    items = sized(large, F.lit(1), LIST_BLOCK).join(sets.select("node", F.coalesce("wide", "sketch").alias("bits")), "node")
    ends = components(by_sketches(items.select("key", "blocks", "node", "n", "bits"), percent, "narrowed")).withColumnRenamed("label", "end")
    inside = large.join(ends, "node", "left").select("node", F.coalesce("end", "node").alias("label"), "n")
    return stage(told.join(large.select("node"), "node", "left_anti").unionByName(inside), "parts")


def linked_roots(docs: DataFrame, told: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """node, label by exact links. told: node, label of its candidate component, n of each set that has one; docs: their texts."""
    members = stage(sized(told, F.col("n"), BLOCK).join(sets.select("node", "doc_id", "key_a", "key_b"), "node"), "dealt")
    columns = ["key", "blocks", "node", "n", "bits"]

    def read(batches):
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            found = [shingles(s, words) for s in batch.column(0).to_pylist()]
            keep = [_keys(s) == k if len(s) else False for s, k in zip(found, zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))]  # an id may have other texts, too
            bits = pa.array([s.tobytes() for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], bits], columns).filter(pa.array(keep, pa.bool_()))

    def items(own: DataFrame) -> DataFrame:
        texts = docs.select("doc_id", "text").join(own.hint("merge"), "doc_id").select("text", "key_a", "key_b", *columns[:-1])
        return texts.mapInArrow(read, "key long, blocks long, node long, n long, bits binary")

    arrays = lambda bits: [np.frombuffer(x, np.uint64) for x in bits]
    solve = lambda ids, _, bits: exact_roots(ids, arrays(bits), percent)
    against = lambda _, one, __, bits: exact_against(np.frombuffer(one, np.uint64), arrays(bits), percent)
    between = lambda _, bits, __, others, roots: exact_between(arrays(bits), arrays(others), roots, percent)
    edges = stage(solved(items(members.filter("blocks = 1")).withColumn("block", F.lit(0).cast("long")), solve, 500), "links").select("a", "b")
    large = members.filter("blocks > 1")
    if large.isEmpty():
        return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))  # a row that is repeated comes once
    return components(edges.unionByName(split_links(stage(items(large), "held"), solve, against, between, 500, "links")))


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    found = stage(find_sets(docs, words, percent).withColumn("row", F.monotonically_increasing_id()), "sets")
    firsts = found.filter("n > 0 and doc_id is not null").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("node"))
    firsts = stage(firsts, "firsts")
    sets = found.join(firsts.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    roots = linked_roots(docs, narrowed(components(candidate_edges(sets, percent)), sets, percent), sets, words, percent)
    roots = roots.join(firsts.select("node", "doc_id"), "node")
    least = roots.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ends = firsts.join(roots.join(least, "label").select("node", "component_id"), "node", "left").select("key_a", "key_b", F.coalesce("component_id", "doc_id").alias("component_id"))
    rows = found.select("doc_id", "mark", F.col("n").alias("n_shingles"), "key_a", "key_b").join(ends, ["key_a", "key_b"], "left")
    return rows.select("doc_id", "mark", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach, its own included) for each row."""
    return _classes(docs, words, percent).drop("mark")


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` but those of a component with a lesser doc_id; all columns stay. Rows that share the least id all stay, and so do rows without an id."""
    gone = _classes(docs, words, percent).filter("doc_id <> component_id").select("doc_id", "mark").distinct()
    return docs.join(gone, (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["mark"]), "left_anti")
