"""N-gram Jaccard join: all links of word-shingle sets at or above a similarity, as components.

1. Documents with equal shingle sets are one class.
2. A class can only have a link if enough of its shingles also occur in other classes: a
   partner lacks at most n - ceil(t n) of its n shingles. All shingles are dealt over buckets
   to count that; classes below the count are finished.
3. The rest are linked by prefix trees, in rounds. A round deals each class to a block by
   the smallest of its shingles in a random global order; all sets of a block then start with
   the same shingle. The block's trie holds the ordered sets; a new set walks it, adding the
   overlap of each edge once for all sets below, and leaves subtrees whose remaining length
   cannot reach the overlap, or that are already one component with it.
4. After each round classes are counted again, with components in place of classes: only
   shingles shared with another component count. Classes below the count are finished.
5. What remains after the rounds is joined exactly: a linked pair shares a shingle of its
   prefixes (rarest first), so classes joined by prefix shingles form families, and a trie
   joins each family. Families too large for a task are dealt as all pairs of their parts or,
   where that meets fewer pairs, by prefix shingle, a class to one block for each; blocks too
   large for a task are dealt as all pairs of their parts.
No step emits the pairs of a group; blocks and buckets have a bounded size.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fresh, hinted, saved, slices, table, trim

WIDTH = 5
PERCENT = 75
WORD_CACHE = 150_000
CHUNK_BYTES = 4_000_000  # text that is read at once; one text is never cut
BUCKET_TOKENS = 1_500_000  # shingles that one bucket counts
CHUNK_TOKENS = 500_000  # shingles that a task holds before it deals them out
NAMES = 200_000  # open classes (two numbers each) that are broadcast; more are joined by shuffle
ONE_TASK = 400_000  # edges (two numbers each) that one task joins
BLOCK = 2_000  # sets that one trie joins
ROUNDS = ((1,), (2, 3, 4))  # salts of each round: a class goes to a block for each
K = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers: a random order for each salt."""
    h = (h ^ np.uint64(salt * 0x51ED2701 + 0x2545F491)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, cache: Hashes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = out * K + h[i : i + len(out)]
    return np.unique(mix(out))


def class_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def least_shared(n: int, percent: int = PERCENT) -> int:
    """Fewest of n shingles that any partner shares."""
    return -(-percent * n // 100)


# --- tries -----------------------------------------------------------------------------------


class Node:
    __slots__ = ("run", "children", "leaf", "least", "most", "rest", "single")

    def __init__(self, run: np.ndarray, leaf: int, n: int, rest: int, single: int):
        self.run, self.leaf, self.least, self.most, self.rest, self.single = run, leaf, n, n, rest, single
        self.children: dict[int, Node] = {}


class Trie:
    """Ordered sets; probing adds overlaps along shared edges."""

    def __init__(self, percent: int = PERCENT):
        self.root = Node(np.zeros(0, np.uint64), -1, 1 << 60, 0, -1)
        self.root.most = 0
        self.percent = percent
        self.parent: list[int] = []
        self.sizes: list[int] = []

    def find(self, a: int) -> int:
        p = self.parent
        while p[a] != a:
            p[a] = p[p[a]]
            a = p[a]
        return a

    def add(self, xs: np.ndarray, known: int | None = None) -> list[int]:
        """Numbers of earlier sets that the set links with, one for each component; then the set is stored.

        known: an earlier set of the same component, if any.
        """
        me = len(self.parent)
        self.parent.append(me if known is None else self.find(known))
        self.sizes.append(len(xs))
        links = self._probe(xs, me)
        self._insert(xs, me)
        return links

    def _probe(self, xs: np.ndarray, me: int) -> list[int]:
        n, p, links = len(xs), self.percent, []
        low = least_shared(n, p)
        stack = [(self.root, 0)]
        while stack:
            node, matched = stack.pop()
            for child in node.children.values():
                if child.most < low or (child.single >= 0 and self.find(child.single) == self.find(me)):
                    continue
                at = np.searchsorted(xs, child.run)
                inside = at < n
                m = matched + int(np.count_nonzero(xs[at[inside]] == child.run[inside]))
                ahead = n - int(np.searchsorted(xs, child.run[-1], side="right"))
                # p * union <= 100 * overlap, overlap at most m and what both have left
                if (m + min(ahead, child.rest)) * (100 + p) < p * (n + max(child.least, low)):
                    continue
                if child.leaf >= 0 and m * (100 + p) >= p * (n + self.sizes[child.leaf]) and self.find(child.leaf) != self.find(me):
                    links.append(child.leaf)
                    self.parent[self.find(child.leaf)] = self.find(me)
                if child.children:
                    stack.append((child, m))
        return links

    def _insert(self, xs: np.ndarray, me: int) -> None:
        n, node, pos, own = len(xs), self.root, 0, self.find(me)
        while True:
            key = int(xs[pos])
            child = node.children.get(key)
            if child is None:
                node.children[key] = Node(xs[pos:], me, n, 0, own)
                return
            run = child.run
            k = min(len(run), n - pos)
            differ = np.flatnonzero(run[:k] != xs[pos : pos + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(run):  # split the edge
                upper = Node(run[:same], -1, child.least, child.rest + len(run) - same, child.single)
                upper.most = child.most
                child.run = run[same:]
                upper.children[int(child.run[0])] = child
                node.children[key] = child = upper
            pos += same
            child.least, child.most = min(child.least, n), max(child.most, n)
            child.rest = max(child.rest, n - pos)
            if child.single >= 0 and self.find(child.single) != own:
                child.single = -1
            if pos == n:
                child.leaf = me
                return
            node = child


def trie_links(ids: list[int], sets: list[np.ndarray], labels: list[int], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between sets of different labels, enough to join all linked components."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    trie, first, out = Trie(percent), {}, []
    for k, i in enumerate(order):
        out += [(ids[i], ids[order[j]]) for j in trie.add(sets[i], first.get(labels[i]))]
        first.setdefault(labels[i], k)
    return out


# --- Spark steps ------------------------------------------------------------------------------


def document_classes(df: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, digest, n, cls): a row for each row of ``df``; digest is a hash of the text, cls is null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for b in chain.from_iterable(slices(x, 1, CHUNK_BYTES) for x in batches):
            sets = (shingles(t, cache, width) for t in b.column(1).to_pylist())
            found = [(len(s), class_id(s) if len(s) else None) for s in sets]
            columns = [b.column(0).cast(pa.int64()), b.column(2), pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n", "cls"])
        cache.clear()
        trim()

    return df.select(doc_id, text, F.xxhash64(text)).mapInArrow(run, "doc_id long, digest long, n long, cls long")


def dealt(rows: Iterator[tuple[int, int, np.ndarray]], buckets: int, short: bool = False) -> Iterator[pa.RecordBatch]:
    """(bucket, tokens, owners, labels) blobs from (owner, label, sorted tokens)."""
    held, size = [], 0

    def emit() -> pa.RecordBatch:
        tokens = np.concatenate([t for _, _, t in held])
        owners, labels = np.array([o for o, _, _ in held], np.int64), np.array([x for _, x, _ in held], np.int64)
        own = np.repeat(np.arange(len(held), dtype=np.uint32), [len(t) for _, _, t in held])
        to = (tokens % np.uint64(buckets)).astype(np.uint32)
        if short:
            tokens = (tokens >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(to, kind="stable")
        tokens, own, to = tokens[order], own[order], to[order]
        cut = np.flatnonzero(np.diff(to)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(to)]])
        cols: list[list] = [[], [], [], [], []]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            names, at = np.unique(own[a:b], return_inverse=True)  # each owner once, then small numbers
            for col, v in zip(cols, (int(to[a]), tokens[a:b].tobytes(), at.astype(np.uint32).tobytes(), owners[names].tobytes(), labels[names].tobytes()), strict=True):
                col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=["bucket", "tokens", "at", "owners", "labels"])

    for r in rows:
        if len(r[2]):
            held.append(r)
            size += len(r[2])
        if size >= CHUNK_TOKENS:
            yield emit()
            held, size = [], 0
    if held:
        yield emit()


BLOBS = "bucket long, tokens binary, at binary, owners binary, labels binary"


def foreign_tokens(blobs: DataFrame, lists: bool, slices: int = 1) -> DataFrame:
    """Per class, its shingles that classes of another label have too.

    With ``lists`` (cls, tokens, df): the shingles themselves and how many classes have each,
    a row for each class and bucket. Else (slice, classes, counts): a bucket's counts packed
    into one row for each slice of the classes.
    """
    schema = "cls long, tokens binary, df binary" if lists else "slice long, classes binary, counts binary"

    def run(group: pa.Table) -> pa.Table:
        tokens, owners, labels, blob = [], [], [], []
        for t, a, o, lb in zip(*(group.column(c).to_pylist() for c in ("tokens", "at", "owners", "labels")), strict=True):
            at = np.frombuffer(a, np.uint32)
            tokens.append(np.frombuffer(t, np.uint64 if lists else np.uint32))
            owners.append(np.frombuffer(o, np.int64)[at])
            labels.append(np.frombuffer(lb, np.int64)[at])
            blob.append(np.full(len(at), len(blob), np.int32))
        tokens, owners, labels = np.concatenate(tokens), np.concatenate(owners), np.concatenate(labels)
        by_token = np.argsort(tokens, kind="stable")
        tokens, owners, labels = tokens[by_token], owners[by_token], labels[by_token]
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        n = np.diff(np.concatenate([start, [len(tokens)]]))
        foreign = np.repeat(np.minimum.reduceat(labels, start) != np.maximum.reduceat(labels, start), n)
        if lists:
            df = np.repeat(n, n)[foreign].astype(np.uint32)
        tokens, owners = tokens[foreign], owners[foreign]
        if not lists:
            # a class that several tasks read has its shingles once for each of them, whole in one
            # blob; those of the first blob count, also two of them that agree in their short form
            blob = np.concatenate(blob)[by_token][foreign]
            order = np.lexsort((tokens, owners))
            tokens, owners, blob = tokens[order], owners[order], blob[order]
            new = np.ones(len(owners), bool)
            new[1:] = (owners[1:] != owners[:-1]) | (tokens[1:] != tokens[:-1])
            once = blob == blob[np.flatnonzero(new)[np.cumsum(new) - 1]]
            who, count = np.unique(owners[once], return_counts=True)
            to = who % slices
            order = np.argsort(to, kind="stable")
            who, count, to = who[order], count[order].astype(np.int64), to[order]
            cut = np.flatnonzero(np.diff(to)) + 1
            parts = list(zip(np.split(to, cut), np.split(who, cut), np.split(count, cut), strict=True)) if len(to) else []
            return pa.table({"slice": pa.array([int(x[0]) for x, _, _ in parts], pa.int64()), "classes": pa.array([x.tobytes() for _, x, _ in parts], pa.binary()), "counts": pa.array([x.tobytes() for _, _, x in parts], pa.binary())})
        order = np.argsort(owners, kind="stable")
        tokens, owners, df = tokens[order], owners[order], df[order]
        cut = np.flatnonzero(np.diff(owners)) + 1
        starts = np.concatenate([[0], cut]) if len(owners) else np.zeros(0, np.int64)
        ends = np.concatenate([cut, [len(owners)]])
        parts = list(zip(starts.tolist(), ends.tolist(), strict=False))
        return pa.table({"cls": pa.array([int(owners[a]) for a, _ in parts], pa.int64()), "tokens": pa.array([tokens[a:b].tobytes() for a, b in parts], pa.binary()), "df": pa.array([df[a:b].tobytes() for a, b in parts], pa.binary())})

    return blobs.groupBy("bucket").applyInArrow(run, schema)


def candidates(df: DataFrame, n_tokens: int, text: str, width: int) -> DataFrame:
    """(cls, shared): how many shingles of a class other classes have too.

    Only 32 bits of a shingle are dealt besides its bucket; a collision can only add to a count.
    """
    buckets = max(12, math.ceil(n_tokens / BUCKET_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = Hashes(), set()

        def rows() -> Iterator[tuple[int, int, np.ndarray]]:
            for b in chain.from_iterable(slices(x, 0, CHUNK_BYTES) for x in batches):
                for t in b.column(0).to_pylist():
                    s = shingles(t, cache, width)
                    if len(s) and (c := class_id(s)) not in seen:  # copies in a task count once
                        seen.add(c)
                        yield c, c, s

        yield from dealt(rows(), buckets, short=True)
        cache.clear()
        trim()

    def add(group: pa.Table) -> pa.Table:
        classes = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("classes").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("counts").to_pylist()])
        who, at = np.unique(classes, return_inverse=True)
        return pa.table({"cls": pa.array(who), "shared": pa.array(np.bincount(at, counts, minlength=len(who)).astype(np.int64))})

    found = foreign_tokens(df.select(text).mapInArrow(run, BLOBS), lists=False, slices=buckets)
    return found.groupBy("slice").applyInArrow(add, "cls long, shared long")


def link_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) links of (key, cls, label, tokens): one trie for each key."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("cls").to_pylist()
        first = dict(zip(ids, range(len(ids)), strict=True))  # a class once
        at = sorted(first.values())
        sets = [np.frombuffer(group.column("tokens")[i].as_py(), np.uint64) for i in at]
        labels = group.column("label").to_pylist()
        found = trie_links([ids[i] for i in at], sets, [labels[i] for i in at], percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.groupBy("key").applyInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(cls, label): label is the smallest member.

    Up to ONE_TASK edges are joined by union-find in one task; more by alternating large and
    small stars over all tasks.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return saved(e.repartition(1).mapInArrow(union_find, "cls long, label long"))
    return star_components(e)


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found = [(x, r) for x in parent if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["cls", "label"])


def star_components(e: DataFrame) -> DataFrame:
    """(cls, label) of (a, b) with a > b."""
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("a").alias("cls"), F.col("b").alias("label"))
        state = now
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = saved(e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def relabelled(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(cls, n, tokens) with label: the component, or the class itself."""
    return sets.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def unfinished(sets: DataFrame, n_tokens: int, percent: int) -> DataFrame:
    """Of (cls, n, tokens, label): those with enough shingles in other components, with these shingles and their counts."""
    buckets = max(12, math.ceil(n_tokens / BUCKET_TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, np.ndarray]]:
            for b in batches:
                for c, lb, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    yield c, lb, np.frombuffer(t, np.uint64)

        yield from dealt(rows(), buckets)
        trim()

    found = foreign_tokens(sets.select("cls", "label", "tokens").mapInArrow(run, BLOBS), lists=True)
    found = found.groupBy("cls").agg(F.collect_list(F.struct("tokens", "df")).alias("found"), F.sum(F.octet_length("tokens") / 8).alias("shared"))
    return sets.join(found, "cls").where(F.col("shared") * 100 >= F.col("n") * percent)


def in_parts(rows: DataFrame, exact: bool) -> DataFrame:
    """Blocks above BLOCK sets are dealt in parts; with ``exact`` every two parts also meet."""
    big = saved(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("key", F.ceil(F.col("size") / BLOCK * (2 if exact else 1)).cast("int").alias("parts")))
    rows = rows.join(hinted(big), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("cls", "key"), F.col("parts")).cast("int")
    if exact:
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        rows = rows.withColumn("part", part).select("*", other)
        return rows.withColumn("key", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")))
    return rows.withColumn("key", F.xxhash64("key", part))


def permuted(sets: DataFrame, salts: tuple[int, ...]) -> DataFrame:
    """(key, cls, label, tokens), a row for each salt: tokens in its order, key the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets_ = [np.frombuffer(t, np.uint64) for t in b.column(2).to_pylist()]
            for salt in salts:
                own = [np.sort(mix(t, salt)) for t in sets_]
                yield pa.RecordBatch.from_arrays([pa.array([int(t[0]) - (1 << 63) for t in own], pa.int64()), b.column(0), b.column(1), pa.array([t.tobytes() for t in own], pa.binary())], names=["key", "cls", "label", "tokens"])

    return sets.select("cls", "label", "tokens").mapInArrow(run, "key long, cls long, label long, tokens binary")


def prefixes(todo: DataFrame, percent: int, sets: bool = True) -> DataFrame:
    """(key, cls, label, tokens): a row for each prefix shingle, rarest first; shingles of no other component are skipped but use up the prefix.

    Without ``sets`` tokens are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, label, n, t, found in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                tokens = np.concatenate([np.frombuffer(f["tokens"], np.uint64) for f in found])
                df = np.concatenate([np.frombuffer(f["df"], np.uint32) for f in found])
                k = max(0, n - least_shared(n, percent) - (n - len(tokens)) + 1)
                keys = tokens[np.lexsort((tokens, df))[:k]].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([c] * len(keys), pa.int64()), pa.array([label] * len(keys), pa.int64()), pa.array([t if sets else None] * len(keys), pa.binary())], names=["key", "cls", "label", "tokens"])

    return todo.select("cls", "label", "n", "tokens", "found").mapInArrow(run, "key long, cls long, label long, tokens binary")


def jaccard_components(df: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", rounds: tuple[tuple[int, ...], ...] = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``df``.

    Links: 100 * intersection >= percent * union of the distinct ``width``-word shingles of
    the text with A-Z lower-cased; fewer words are one shingle. Null and empty texts have no
    shingle and are linked with nothing. component_id is the smallest id that links reach,
    null ids left aside; rows of one id with different texts are judged each. An empty table
    gives no rows; other columns are ignored.
    """
    return labelled(df, width, percent, doc_id, text, rounds).select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(df: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each component: of the smallest id, then the smallest hash of the text; a null id comes last.

    Of repeated rows one stays. Rows without words are in no component and all stay. An empty
    table gives no rows; all columns, whatever their names, stay as they are.
    """
    rows = saved(labelled(df, width, percent, doc_id, text, ROUNDS).where("label is not null"))
    number, digest = fresh(df, "_id", "_digest")
    least = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("i"), F.col("digest").alias("d"))).alias("k")
    keep = rows.groupBy("label").agg(least).select(F.col("k.i").alias(number), F.col("k.d").alias(digest)).distinct()
    keyed = df.withColumns({number: F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)), digest: F.xxhash64(text)})
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike(WORD)
    kept = keyed.where(~wordless).join(keep, [number, digest], "left_semi").dropDuplicates([number, digest])
    return kept.unionByName(keyed.where(wordless)).select(*df.columns)


def labelled(df: DataFrame, width: int, percent: int, doc_id: str, text: str, rounds: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(doc_id, digest, n_shingles, label, component_id) of every row; label numbers components and is null without shingles."""
    docs = saved(document_classes(df, doc_id, text, width))
    classes = docs.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"))
    classes = saved(classes)
    n_tokens = classes.agg(F.sum("n")).first()[0] or 0
    if not n_tokens:
        return docs.select("doc_id", "digest", F.col("n").alias("n_shingles"), F.col("cls").alias("label"), F.col("doc_id").alias("component_id"))
    sets = class_sets(df, open_classes(df, classes, n_tokens, text, width, percent), doc_id, text, width)
    release(df.sparkSession)
    labels = linked_labels(sets, percent, rounds)
    release(df.sparkSession)
    members = classes.join(labels, "cls", "left").select("cls", "first", F.coalesce("label", "cls").alias("label"))
    least = members.groupBy("label").agg(F.min("first").alias("component_id"))
    named = members.join(least, "label").select("cls", "label", "component_id")
    out = docs.join(named, "cls", "left")
    return out.select("doc_id", "digest", F.col("n").alias("n_shingles"), "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def open_classes(df: DataFrame, classes: DataFrame, n_tokens: int, text: str, width: int, percent: int) -> DataFrame:
    shared = candidates(df, n_tokens, text, width)
    return saved(classes.join(shared, "cls").where(F.col("shared") * 100 >= F.col("n") * percent))


def linked_labels(sets: DataFrame, percent: int, rounds: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(cls, label) of all classes with a link: rounds of blocks, then the exact join of what may still have one."""
    n_tokens = sets.agg(F.sum("n")).first()[0] or 0
    labels, todo = None, relabelled(sets, sets.select("cls", F.col("cls").alias("label")))
    for salts in (*rounds, None):
        if labels is not None:
            todo = relabelled(todo.select("cls", "n", "tokens"), labels)
        if labels is not None or salts is None:
            todo = saved(unfinished(todo, n_tokens, percent))
            if todo.isEmpty():
                break
        blocks = exact_blocks(todo, percent) if salts is None else in_parts(permuted(todo, salts), exact=False)
        found = link_blocks(blocks, percent)
        labels = components(found if labels is None else found.union(labels.select(F.col("cls").alias("a"), F.col("label").alias("b"))))
        release(sets.sparkSession)
    return labels


def exact_blocks(todo: DataFrame, percent: int) -> DataFrame:
    """(key, cls, label, tokens): blocks in which every pair that may have a link meets.

    Linked pairs share a prefix shingle, so they are in one family: a component of the classes
    joined by prefix shingles. A family of at most BLOCK sets is one block, its sets move once.
    Of larger families, those of texts with much in common meet in nearly every prefix shingle:
    they are dealt as a whole, in parts that meet each other once, if that makes no more pairs
    than the prefix shingles do; others are dealt by prefix shingle.
    """
    keys = saved(prefixes(todo, percent, sets=False))
    low = keys.groupBy("key").agg(F.min("cls").alias("b"))
    family = components(keys.join(low, "key").select(F.col("cls").alias("a"), "b")).withColumnRenamed("label", "family")
    rows = todo.join(family, "cls", "left").withColumn("family", F.coalesce("family", "cls"))
    sizes = saved(rows.groupBy("family").agg(F.count("*").alias("size")).where("size > 1"))
    large = sizes.where(F.col("size") > BLOCK)
    rows = rows.join(hinted(sizes, NAMES), "family")
    blocks = rows.where(F.col("size") <= BLOCK).select(F.col("family").alias("key"), "cls", "label", "tokens")
    if large.isEmpty():
        return blocks
    met = keys.join(family, "cls", "left").groupBy(F.coalesce("family", "cls").alias("family"), "key").agg(F.count("*").alias("n"))
    met = met.groupBy("family").agg(F.sum(F.col("n") * F.col("n")).alias("met"))
    large = saved(large.join(met, "family").select("family", (F.col("size") * F.col("size") <= F.col("met")).alias("whole")))
    kinds = {r["whole"] for r in large.select("whole").distinct().collect()}
    rows = rows.join(hinted(large, NAMES), "family")
    if True in kinds:
        whole = rows.where("whole").select(F.col("family").alias("key"), "cls", "label", "tokens")
        blocks = blocks.unionByName(in_parts(whole, exact=True).select("key", "cls", "label", "tokens"))
    if False in kinds:
        blocks = blocks.unionByName(in_parts(prefixes(rows.where(~F.col("whole")), percent), exact=True).select("key", "cls", "label", "tokens"))
    return blocks


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now; they are only dropped when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def class_sets(df: DataFrame, open_classes: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(cls, n, tokens) of the open classes, from the text of each class's first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Hashes()
        for b in chain.from_iterable(slices(x, 1, CHUNK_BYTES) for x in batches):
            out = [(c, len(s), s.tobytes()) for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if len(s := shingles(t, cache, width)) and class_id(s) == c]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["cls", "n", "tokens"])
        cache.clear()
        trim()

    names = open_classes.select(F.col("first").alias("_first"), F.col("cls").alias("_cls"))
    rows = df.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = rows.join(hinted(names, NAMES), F.col("_id").eqNullSafe(F.col("_first")))
    return saved(rows.select("_cls", "_text").mapInArrow(run, "cls long, n long, tokens binary").dropDuplicates(["cls"]))


def op5_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
