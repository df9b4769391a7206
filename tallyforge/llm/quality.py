"""Quality rules: base counts of a text, then tokeniser fertility under public vocabularies.

A public byte-level BPE gives characters per token and the entropy of the token distribution;
a public piece vocabulary with byte fallback gives the share of pieces that are raw bytes.
Words are cut by Arrow; each distinct word of a chunk is tokenised once, and texts are counted
in numpy. A text is rejected outside the band of its language or, where the language has none, of the
script that most of its words are in. A language's band follows the count of tokens, as both
measures vary more in short texts and entropy grows with length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, slices, table, trim

SYMBOLS = "[#*$%&|<>]"
HAS_WORD = "[^ \t-\r]"
#: White space beside that of the word definition: a word with it is tokenised by itself.
INNER_SPACE = "[\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The first letter is one of these of Latin; scripts of other words are looked up one by one.
FIRST_LATIN = "^\\P{L}*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02c1]"
#: Blocks of letters, without combining marks, whose characters may have a piece each: code points, last exclusive.
ALPHABETS = ((0x21, 0x7F), (0xA1, 0x250), (0x370, 0x483), (0x48A, 0x530))
SCRIPTS = ("latin", "greek", "cyrillic", "arabic", "cjk", "other", "none")
#: (first code point, script number); a word has the script of its first letter.
RANGES = ((0x41, 0), (0x370, 1), (0x400, 2), (0x530, 5), (0x600, 3), (0x780, 5), (0x1E00, 0), (0x1F00, 1), (0x2000, 5), (0x2E80, 4), (0xA4D0, 5), (0xAC00, 4), (0xD7B0, 5), (0xF900, 4), (0xFB00, 5), (0x20000, 4), (0x323B0, 5))
#: (least, most) characters per token, most byte-fallback share, least entropy as a share of
#: the most that a text of so many tokens can have.
BANDS = {
    "latin": (1.3, 8.0, 0.20, 0.45),
    "greek": (0.3, 8.0, 0.60, 0.40),
    "cyrillic": (0.3, 8.0, 0.40, 0.40),
    "arabic": (0.3, 8.0, 0.60, 0.40),
    "cjk": (0.2, 4.0, 0.80, 0.40),
    "other": (0.1, 8.0, 0.95, 0.35),
    "none": (0.0, 3.0, 0.95, 0.35),
}
#: By language of `documents`, at log2 of the tokens: least, most characters per token, least entropy
#: in bits; between them the line. Each is the median over all texts of sf0.1 that pass the base
#: rules, less or plus 5 (entropy: less 3) times 1.4826 median deviations; labels were not used.
LENGTH_BANDS = {
    "de": ((5, 1.42, 2.67, 4.13), (6, 1.54, 2.54, 5.04), (7, 1.68, 2.35, 5.52), (8, 1.74, 2.32, 5.90), (9, 1.82, 2.25, 6.19), (10, 1.87, 2.20, 6.39), (11, 1.93, 2.14, 6.54), (12, 1.94, 2.12, 6.64), (13, 1.95, 2.12, 6.72)),
    "en": ((5, 1.51, 2.93, 4.19), (6, 1.77, 2.68, 4.92), (7, 1.85, 2.62, 5.51), (8, 1.94, 2.54, 6.00), (9, 2.03, 2.45, 6.34), (10, 2.08, 2.40, 6.60), (11, 2.12, 2.36, 6.76), (12, 2.15, 2.33, 6.88), (13, 2.18, 2.30, 6.93)),
    "es": ((5, 0.72, 2.88, 3.57), (6, 1.02, 2.51, 4.77), (7, 1.44, 2.13, 5.33), (8, 1.50, 2.03, 5.58), (9, 1.57, 1.96, 5.92), (10, 1.62, 1.92, 6.20), (11, 1.67, 1.87, 6.35), (12, 1.68, 1.86, 6.46), (13, 1.69, 1.84, 6.50)),
    "fr": ((5, 1.03, 2.69, 3.98), (6, 1.40, 2.31, 4.83), (7, 1.48, 2.24, 5.35), (8, 1.57, 2.14, 5.76), (9, 1.62, 2.07, 6.04), (10, 1.70, 2.00, 6.25), (11, 1.74, 1.96, 6.40), (12, 1.75, 1.94, 6.47), (13, 1.77, 1.92, 6.54)),
}
MOST_BYTES = 0.02  # sf0.1: 0.0 in every text
CHUNK_BYTES = 4_000_000  # text that is measured at once; one text is never cut
FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64()), ("script", pa.string()), ("n_tokens", pa.int64())]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, byte_share double, token_entropy double, script string, n_tokens long"


def script_of(word: str) -> int:
    for c in word:
        if c.isalpha():
            at = 5
            for first, number in RANGES:
                if ord(c) < first:
                    break
                at = number
            return at
    return 6


class Words:
    """What the public vocabularies make of distinct words."""

    def __init__(self, ranks: str, pieces: str):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            table_ = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={}).encode_ordinary
        self.begins = np.zeros(max(table_.values()) + 1, bool)
        self.begins[[rank for token, rank in table_.items() if token[:1] == b" "]] = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.pieces.IsByte(i) or self.pieces.IsUnknown(i) for i in range(self.pieces.get_piece_size())])
        alone = [chr(c) for first, last in ALPHABETS for c in range(first, last)]
        known = [c for c, ids in zip(alone, self.pieces.encode(alone, num_threads=1), strict=True) if not self.is_byte[ids].any()]
        self.safe = "^[" + "".join(f"\\x{{{ord(c):x}}}" for c in known) + "]+$"  # no piece of such a word is a byte

    def tokens(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, how many of each), each word behind a blank."""
        odd = pc.match_substring_regex(words, INNER_SPACE)
        mask = odd.to_numpy(zero_copy_only=False)
        common = words.filter(pc.invert(odd))
        n, flat = np.zeros(len(words), np.int64), np.zeros(0, np.int64)
        if len(common):  # a blank begins a token wherever it stands, so the words can be told apart
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(common)], pa.int32()), common), " ")[0].as_py()
            flat = np.array(self.bpe(" " + joined), np.int64)
            n[~mask] = np.diff(np.flatnonzero(self.begins[flat]), append=len(flat))
        if not mask.any():
            return flat, n
        lists = [self.bpe(" " + w) for w in words.filter(odd).to_pylist()]
        n[mask] = list(map(len, lists))
        order = np.argsort(mask, kind="stable")  # the common words' tokens come first
        first = np.zeros(len(words), np.int64)
        first[order] = np.cumsum(n[order]) - n[order]
        flat = np.concatenate([flat, np.array([i for x in lists for i in x], np.int64)])
        return flat[spread(first, n)], n

    def byte_pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, those that are bytes) of each word."""
        pieces = self.pieces.encode(words.to_pylist(), num_threads=1)
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        upto = np.concatenate([[0], np.cumsum(self.is_byte[np.fromiter((p for x in pieces for p in x), np.int64, int(n.sum()))])])
        ends = np.cumsum(n)
        return n, upto[ends] - upto[ends - n]

    @staticmethod
    def scripts(words: pa.Array) -> np.ndarray:
        other = ~pc.match_substring_regex(words, FIRST_LATIN).to_numpy(zero_copy_only=False)
        out = np.zeros(len(words), np.int64)
        out[other] = [script_of(w) for w in words.filter(pa.array(other)).to_pylist()]
        return out


@lru_cache(maxsize=1)
def vocabularies(ranks: str, pieces: str) -> Words:
    """Loaded once by a worker process."""
    return Words(ranks, pieces)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... n[0] numbers; then those of first[1], and so on."""
    upto = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(first - upto[:-1], n) + np.arange(upto[-1])


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """By text: words in 5-word windows that the text has twice or more. 64-bit hashes stand for (text, window)."""
    at = np.flatnonzero(doc[:-4] == doc[4:]) if len(ids) >= 5 else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(n_docs, np.int64)
    k = np.uint64(0x9E3779B97F4A7C15)
    h = doc[at].astype(np.uint64) + np.uint64(1)
    for i in range(5):
        h = (h ^ (h >> np.uint64(29))) * k + ids[at + i].astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * k
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(n_docs, np.int64)
    maybe = np.zeros(1 << 16, bool)
    maybe[twice >> np.uint64(48)] = True
    some = np.flatnonzero(maybe[h >> np.uint64(48)])
    place = np.minimum(np.searchsorted(twice, h[some]), len(twice) - 1)
    start = at[some[twice[place] == h[some]]]
    hit = np.zeros(len(ids) + 1, np.int64)
    np.add.at(hit, start, 1)
    np.add.at(hit, start + 5, -1)
    return np.bincount(doc[np.cumsum(hit[:-1]) > 0], minlength=n_docs)


def entropy(tokens: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, share of the most possible) by text."""
    total = np.bincount(doc, minlength=n_docs).astype(float)
    key = np.sort(doc * (1 << 20) + tokens)
    start = np.flatnonzero(np.diff(key, prepend=-1))
    own = key[start] >> 20
    p = np.diff(start, append=len(key)) / total[own]
    bits = np.bincount(own, -p * np.log2(p), minlength=n_docs)
    return bits, np.where(total > 1, bits / np.log2(np.maximum(total, 2)), 1.0)


def owners(lists: pa.Array) -> np.ndarray:
    """By value of a list array: the number of its list."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """By text: lines with a word that equal an earlier line."""
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten().dictionary_encode()
    at = lines.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.match_substring_regex(lines.dictionary, HAS_WORD).to_numpy(zero_copy_only=False)[at]
    doc, at = owners(lists)[real], at[real]
    key = np.sort(doc * (int(at.max(initial=0)) + 1) + at)
    again = key[1:][key[1:] == key[:-1]] // (int(at.max(initial=0)) + 1)
    return np.bincount(again, minlength=len(texts))


def by_length(rows: tuple, n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least, most characters per token, least bits) for texts of so many tokens; below the first row the bits shrink with log2."""
    at, low, high, bits = np.array(rows, float).T
    size = np.log2(np.maximum(n_tokens, 1))
    return np.interp(size, at, low), np.interp(size, at, high), np.interp(size, at, bits) * np.minimum(size / at[0], 1)


def score_chunk(vocabulary: Words, texts: pa.Array, langs: list, bands: dict) -> list:
    """Columns of ``FIELDS`` for the texts."""
    texts, n = texts.fill_null(""), len(texts)
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    words, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = (pc.binary_length(words).to_numpy() > 0)[at]  # a text's edges give empty words
    doc, at = owners(lists)[real], at[real]

    def summed(by_word: np.ndarray) -> np.ndarray:
        return np.bincount(doc, by_word[at], minlength=n).astype(np.int64)

    counts, repeat = np.bincount(doc, minlength=n), repeated_words(at, doc, n)
    chars, symbols = summed(pc.utf8_length(words).to_numpy()), summed(pc.count_substring_regex(words, SYMBOLS).to_numpy())
    flat, lengths = vocabulary.tokens(words)
    n_tokens = summed(lengths)
    bits, share = entropy(flat[spread((np.cumsum(lengths) - lengths)[at], lengths[at])], np.repeat(doc, lengths[at]), n)
    per_token = np.divide(chars, n_tokens, out=np.zeros(n), where=n_tokens > 0)
    byte_share = np.zeros(n)
    unsafe = ~pc.match_substring_regex(words, vocabulary.safe).to_numpy(zero_copy_only=False)[at]
    if unsafe.any():  # the share is 0 in all texts without such a word
        open_ = np.bincount(doc[unsafe], minlength=n) > 0
        own = open_[doc]
        used, place = np.unique(at[own], return_inverse=True)
        pieces, in_bytes = vocabulary.byte_pieces(words.take(pa.array(used)))
        total = np.bincount(doc[own], pieces[place], minlength=n)
        byte_share = np.divide(np.bincount(doc[own], in_bytes[place], minlength=n), total, out=byte_share, where=total > 0)
    scripts = np.bincount(doc * len(SCRIPTS) + vocabulary.scripts(words)[at], minlength=n * len(SCRIPTS)).reshape(n, -1)
    scripts[:, -1] = np.where(scripts[:, :-1].any(axis=1), 0, 1)
    script = np.array(SCRIPTS, object)[scripts.argmax(axis=1)]
    failed = (counts < 10) | (100 * repeat > 20 * counts)
    kept = ~failed
    names = np.array([x if x in bands else y for x, y in zip(langs, script, strict=True)], object)
    for name in dict.fromkeys(names):
        own = np.flatnonzero(names == name)
        if isinstance(bands[name][0], tuple):
            (low, high, least), most_bytes, measure = by_length(bands[name], n_tokens[own]), MOST_BYTES, bits
        else:
            (low, high, most_bytes, least), measure = bands[name], share
        kept[own] &= (low <= per_token[own]) & (per_token[own] <= high) & (byte_share[own] <= most_bytes) & (measure[own] >= least)
    return [counts, chars, symbols, duplicate_lines(texts), repeat, failed, kept, per_token, byte_share, bits, script, n_tokens]


def fertility_rules(df: DataFrame, ranks: str | None = None, pieces: str | None = None, bands: dict | None = None, doc_id: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """Per row: base counts, base_failed, kept, and the fertility measures.

    A null or empty text has no words and is base_failed; a very long text is measured whole.
    ``bands`` is keyed by script and, if ``lang`` names a column, by its values first (a null or
    unknown one has the band of the script); a band is like one of ``BANDS`` or of
    ``LENGTH_BANDS``, and a measure on its edge is inside. Every row of repeated rows is judged;
    an empty table gives no rows; other columns, whatever their names, are ignored. ``ranks``
    and ``pieces`` are paths of public vocabularies on every executor.
    """
    bands = BANDS | (bands or {})
    columns = [doc_id, text] + ([lang] if lang else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        vocabulary = vocabularies(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pieces or public_tokenizers.path("piece_bpe_32k.model"))
        for batch in batches:
            for part in slices(batch, 1, CHUNK_BYTES):
                langs = part.column(2).to_pylist() if lang else [None] * len(part)
                out = score_chunk(vocabulary, part.column(1), langs, bands)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64())] + [pa.array(v, t) for v, (_, t) in zip(out, FIELDS, strict=True)], names=["doc_id"] + [f for f, _ in FIELDS])
        trim()

    return df.select(*columns).mapInArrow(run, SCHEMA)


WIDTHS = (5.0, 3.0)  # of a fitted band in robust deviations: characters per token both ways, entropy downwards
LEAST_TEXTS = 30  # fewer texts of a language and length give no row


def fit_bands(measured: DataFrame, langs: DataFrame, doc_id: str = "doc_id", lang: str = "lang") -> dict[str, tuple]:
    """Bands like ``LENGTH_BANDS`` of all texts that pass the base rules; no labels are used.

    measured: what ``fertility_rules`` gives; langs: (doc_id, lang). By language and log2 of the
    tokens (rounded) the median of a measure, less or plus ``WIDTHS`` times 1.4826 median
    deviations. Rows without language are left out; a language without ``LEAST_TEXTS`` texts of
    any length has no band and falls back to its script.
    """
    key = [lang, "size"]
    rows = measured.where("not base_failed and n_tokens > 0").select(doc_id, "chars_per_token", "token_entropy", F.round(F.log2("n_tokens")).cast("int").alias("size"))
    rows = saved(rows.join(langs.select(doc_id, lang).where(F.col(lang).isNotNull()), doc_id))
    mid = saved(rows.groupBy(*key).agg(F.count("*").alias("n"), F.median("chars_per_token").alias("c"), F.median("token_entropy").alias("e")).where(F.col("n") >= LEAST_TEXTS))
    off = rows.join(F.broadcast(mid), key)  # a row for each language and power of two
    off = off.groupBy(*key).agg(F.median(F.abs(F.col("chars_per_token") - F.col("c"))).alias("dc"), F.median(F.abs(F.col("token_entropy") - F.col("e"))).alias("de"))
    out: dict[str, tuple] = {}
    for r in mid.join(off, key).orderBy(*key).collect():
        c, e = WIDTHS[0] * 1.4826 * r["dc"], WIDTHS[1] * 1.4826 * r["de"]
        out[r[lang]] = (*out.get(r[lang], ()), (r["size"], r["c"] - c, r["c"] + c, r["e"] - e))
    return out


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_rules(table(spark, sf_dir, "documents"), bands=LENGTH_BANDS, lang="lang")
