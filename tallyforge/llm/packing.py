"""Best-fit packing with certified bin counts.

Texts become token pieces of at most ``capacity`` tokens. Pieces are dealt over partitions;
each packs its own by best-fit decreasing and computes lower bounds on its bin count from
dual-feasible functions. A partition that meets its bound is certified: nothing better exists
for its pieces, and all its bins but the emptiest are final. The open bins (all that are not
full, of a partition with a gap; the emptiest of a certified one) are dealt whole to new,
fewer partitions, which exchange their pieces and pack again. A partition keeps its old bins
where the new packing needs no fewer, so no round makes the packing worse.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, slices, table, trim

CAPACITY = 4096
END = 1  # id that ends a document
PER_PARTITION = 60_000  # pieces that one task packs
END_BYTES = np.array([END], "<u4").tobytes()
CHUNK_BYTES = 4_000_000  # text that is encoded at once; one text is never cut
MARK = "\x01"  # ends a part of a word; words that have the character themselves aren't plain
#: Closing punctuation after a letter or digit begins a part of its own.
CLOSING = "([a-z0-9\u00df-\u00f6\u00f8-\u00ff])([.,;:!?])"
#: Words that normalisation only lower-cases: printable ASCII but the apostrophe, and letters of Latin-1.
PLAIN = "^[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
#: What the tokenizer encodes by itself in a lower-cased plain word: letters, one digit, or other characters.
PART = "[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@\\[-`{-~]+"
SPECIAL = "<|"  # may begin a special token, which is case-sensitive


def byte_symbols() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: printable bytes stand for themselves, the rest for U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a text by a public tokenizer that lower-cases and drops white space.

    The tokenizer never joins what white space divides, so texts are cut there and each
    distinct word of a chunk is encoded once. Plain words are merged by rank, all in one call:
    a token's id is the rank of its merge, and ``MARK`` stands for the end of a part. Other
    words, and texts that may have special tokens, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.merge = self.merger(model)
        self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        if self.merge:
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(model["end_of_word_suffix"])]] = True

    @staticmethod
    def merger(model: dict):
        """Ids of marked parts that follow each other, or None if the vocabulary is of another kind."""
        import tiktoken

        end, vocab = model.get("end_of_word_suffix"), model["vocab"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        base = len(vocab) - len(pairs)
        if not end or base != 512 or any(vocab.get(a + b) != base + i for i, (a, b) in enumerate(pairs)):
            return None
        symbols, mark, ranks = byte_symbols(), MARK.encode(), {}
        for token, i in vocab.items():
            last = token.endswith(end)
            raw = bytes(symbols[c] for c in (token[: -len(end)] if last else token))
            if mark not in raw or raw == mark and not last:
                ranks[raw + mark * last] = i
        return tiktoken.Encoding("words", pat_str=f"[^{MARK}]+{MARK}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many of each)."""
        words = pc.utf8_lower(words)
        one = pc.match_substring_regex(words, f"^(?:{PART})$")
        marked = pc.if_else(one, pc.binary_join_element_wise(words, MARK, ""), pc.replace_substring_regex(words, f"({PART})", rf"\1{MARK}"))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(marked)], pa.int32()), marked), "")[0].as_py()
        ids = np.array(self.merge(joined), "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        last = np.cumsum(pc.count_substring(marked, MARK).to_numpy()) - 1
        return ids, np.diff(stops[last], prepend=0)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count) of distinct words: a word has ``count`` ids from ``first`` on."""
        plain = pc.match_substring_regex(words, PLAIN) if self.merge else pa.array(np.zeros(len(words), bool))
        mask = plain.to_numpy(zero_copy_only=False)
        n, ids = np.zeros(len(words), np.int64), [np.zeros(0, "<u4")]
        if mask.any():
            found, n[mask] = self.plain(words.filter(plain))
            ids.append(found)
        if not mask.all():
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
            n[~mask] = list(map(len, found))
            ids.append(np.fromiter(chain.from_iterable(found), "<u4"))
        first = np.zeros(len(words), np.int64)
        order = np.argsort(~mask, kind="stable")
        first[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(ids), first, n

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """Little-endian 32-bit ids of each text; null has none."""
        texts = texts.fill_null("")
        marked = pc.match_substring(texts, SPECIAL)
        cut = pc.ascii_lower(texts)
        if self.merge:
            cut = pc.replace_substring_regex(cut, CLOSING, r"\1 \2")
        words = pc.ascii_split_whitespace(cut)
        flat = words.flatten().dictionary_encode()
        tokens, first, count = self.words(flat.dictionary)
        at = flat.indices.to_numpy(zero_copy_only=False)
        n = count[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        out = tokens[np.repeat(first[at] - upto[:-1], n) + np.arange(upto[-1])]
        ends = upto[words.offsets.to_numpy() - words.offsets[0].as_py()]
        found = [out[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for i in np.flatnonzero(marked.to_numpy(zero_copy_only=False)).tolist():
            found[i] = self.whole(texts[i].as_py())
        return found


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The vocabulary, loaded once by a worker process."""
    return Encoder(path)


def token_pieces(df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): pieces of every row. A null text is an empty one: the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        own_encoder = encoder(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
        for batch in batches:
            for part in slices(batch, 1, CHUNK_BYTES):
                out: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), own_encoder.ids(part.column(1)), strict=True):
                    for k in range(0, len(ids) + 1, capacity):
                        piece = ids[k : k + capacity]
                        length, crc = len(piece), zlib.crc32(piece)
                        if length < capacity:  # the end id is the last of the last piece
                            length, crc = length + 1, zlib.crc32(END_BYTES, crc)
                        out.append((doc, k // capacity, k, length, crc))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        trim()

    return df.select(doc_id, text).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Most bins that dual-feasible functions prove necessary.

    u(l): sizes above capacity - l count as whole bins, sizes below l as nothing.
    f(k): x -> floor((k + 1) x / C) / k, x / C itself where (k + 1) x / C is whole.
    """
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """``lower_bound`` of so many pieces of each length: the functions add up over pieces, so one histogram bounds a whole table."""
    x = np.arange(capacity + 1, dtype=np.int64)
    n, total = np.cumsum(count), np.cumsum(count * x)
    best = -(-int(total[-1]) // capacity)
    levels = np.arange(1, capacity // 2 + 1)
    big = n[-1] - n[capacity - levels]
    mid = total[capacity - levels] - total[levels - 1]
    best = max(best, int((big + -(-mid // capacity)).max())) if len(levels) else best
    for k in range(1, 101):
        y = (k + 1) * x
        whole = y % capacity == 0
        value = np.where(whole, k * x, (y // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(bin of each size, bins). A bit for each amount of free space that some bin has finds the tightest bin."""
    order = np.argsort(-sizes, kind="stable")
    where = np.zeros(len(sizes), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n = 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        rest = mask >> s
        if rest:
            free = s + (rest & -rest).bit_length() - 1
            own = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            free, own = capacity, n
            n += 1
        where[i] = own
        left = free - s
        if left:
            by_free[left].append(own)
            mask |= 1 << left
    return where, n


def pack_once(sizes: np.ndarray, old: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(bin, open, certified) of one partition's pieces. ``old``: their bins so far, -1 for none."""
    where, n = best_fit_decreasing(sizes, capacity)
    before = np.unique(old, return_inverse=True)[1] if len(old) and old.min() >= 0 else None
    if before is not None and n >= before.max() + 1:
        where, n = before, int(before.max()) + 1
    filled = np.bincount(where, sizes, minlength=n).astype(np.int64)
    certified = n == lower_bound(sizes, capacity)
    is_open = filled < capacity
    if certified and is_open.any():
        is_open = np.arange(n) == int(np.argmin(filled))
    return where, is_open[where], certified


SCHEMA = "id long, length long, bin long, open boolean, certified boolean"
STALLED = 2  # rounds in a row that close no tenth of the open pieces and save no bin


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, seed: int = 3) -> DataFrame:
    """Of (id, length): (id, length, bin, round, part, certified). ``id`` is unique; lengths are 1 to ``capacity``.

    Every round deals bins by a hash over ceil(pieces / per_partition) partitions. Rounds end
    when the count of all bins meets the bound of all pieces (every piece is then certified),
    when the open pieces fit one partition, or after ``STALLED`` rounds without progress.
    """

    def deal(df: DataFrame, n: int, key, r: int) -> DataFrame:
        parts = max(1, math.ceil(n / per_partition))
        return df.withColumn("part", F.pmod(F.xxhash64(key, F.lit(seed + r)), F.lit(parts)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        where, is_open, certified = pack_once(pdf["length"].to_numpy(), pdf["old"].to_numpy(), capacity)
        return pd.DataFrame({"id": pdf["id"], "length": pdf["length"], "bin": where, "open": is_open, "certified": certified, "part": pdf["part"]})

    count = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most one row for each length
        count[row["length"]] = row["count"]
    n, bound = int(count.sum()), bound_of_counts(count, capacity)
    done: list[DataFrame] = []
    todo = pieces.select("id", "length", F.lit(-1).cast("long").alias("old"))
    key, r, closed, stalled, before, met = F.col("id"), 0, 0, 0, (n, n + 1), n == 0
    while n:
        packed = saved(deal(todo, n, key, r).groupBy("part").applyInPandas(run, SCHEMA + ", part long"))
        named = packed.select("id", "length", "bin", F.lit(r).alias("round"), "part", "certified", "open")
        bins = packed.groupBy("part", "bin").agg(F.first("open").alias("open"), F.count("*").alias("n"))
        now = bins.agg(F.count("*").alias("bins"), F.count_if("open").alias("open"), F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)).alias("pieces")).first()
        total, met = closed + now["bins"], closed + now["bins"] == bound
        progress = now["pieces"] <= 0.9 * before[0] or total < before[1]
        stalled = 0 if progress else stalled + 1
        if met or n <= per_partition or stalled >= STALLED or not now["pieces"]:
            done.append(named.drop("open"))
            break
        done.append(named.where(~F.col("open")).drop("open"))
        # an open bin moves as a whole: its number stays unique over all partitions
        todo = packed.where("open").select("id", "length", (F.col("part") * (1 << 32) + F.col("bin")).alias("old"))
        closed += now["bins"] - now["open"]
        n, before = now["pieces"], (now["pieces"], total)
        key, r = F.col("old"), r + 1
    out = done[0] if done else pieces.select("id", "length", *[F.lit(0).cast("long").alias(c) for c in ("bin", "round", "part")], F.lit(True).alias("certified")).where("false")
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("certified", F.lit(True)) if met else out


def pack_documents(df: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", per_partition: int = PER_PARTITION) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified) of all rows' pieces.

    A null text is an empty document of one token; repeated rows are packed each; a very long
    text is cut into pieces, however many; pieces of equal length are taken in the order of an
    internal number; an empty table gives no rows; other columns, whatever their names, are
    ignored. ``certified``: the count of all sequences met the bound of all pieces, or the
    piece's partition met its own when its sequence became final.
    """
    pieces = token_pieces(df, tokenizer, capacity, doc_id, text)
    pieces = saved(pieces.withColumn("id", F.monotonically_increasing_id()))
    packed = pack(pieces, capacity, per_partition)
    names = F.col("round").cast("long") * (1 << 56) + F.col("part") * (1 << 24) + F.col("bin")
    packed = packed.select("id", names.alias("sequence_id"), "certified")
    out = pieces.join(packed, "id")
    before = Window.partitionBy("sequence_id").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", offset.cast("long").alias("offset"), "certified")


def op2_bound_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
