import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import common, jaccard, linededup, mixing, reputation, secrets, sharding, toxicity


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# --- 3 ---------------------------------------------------------------------------------------


def test_toxicity_learns_held_out_words(spark):
    rng = np.random.default_rng(1)
    bad = ["foulword", "nastyterm", "vileterm"]
    rows, labels = [], []
    for i in range(600):
        words = [f"w{x}" for x in rng.integers(0, 400, 30)]
        toxic = i % 5 == 0
        if toxic:
            words[int(rng.integers(0, 30))] = bad[i % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(d, lab.where(~toxicity.held_out(F.col("doc_id"))))
    out = d.withColumn("score", toxicity.toxicity_score(F.col("text"), model)).toPandas()
    out["toxic"] = [t for _, t in labels]
    held = out[[zlib.crc32(str(i).encode()) % 4 == 2 for i in out["doc_id"]]]
    assert ((held["score"] >= 0.3) == held["toxic"].astype(bool)).mean() > 0.95
    assert 0 < len(model.ids) < 2000  # L1 leaves few weights


def test_toxicity_edges(spark):
    d = docs(spark, [(1, None), (2, ""), (None, "x y"), (1, "again"), (3, "word " * 50_000)])
    none = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    one = toxicity.train(d, spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int"))
    for m in (none, one):
        scores = [r.s for r in d.select(toxicity.toxicity_score(F.col("text"), m).alias("s")).collect()]
        assert len(scores) == 5 and all(0 <= s <= 1 for s in scores)
        assert d.limit(0).select(toxicity.toxicity_score(F.col("text"), m)).count() == 0
        twice = [r.s for r in d.union(d).select(toxicity.toxicity_score(F.col("text"), m).alias("s")).collect()]
        assert sorted(twice) == sorted(scores + scores)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = docs(spark, [(i, "foul word here" if i % 2 else "fair word here") for i in range(40)])
    plain = toxicity.train(rows, labels)
    clash = toxicity.train(rows.union(rows).selectExpr("*", "1 AS id", "2 AS draw", "3 AS y", "4 AS f"), labels.union(labels))
    assert plain.ids.tolist() == clash.ids.tolist() and plain.weights.tolist() == clash.weights.tolist() and len(plain.ids)
    assert toxicity.train(rows.limit(0), labels).ids.tolist() == []


def slow_ftrl(texts, labels, alpha=1.0, beta=1.0, l1=toxicity.L1, l2=0.5, epochs=toxicity.EPOCHS, seed=5):
    """One coordinate at a time, no feature left out."""
    z, n, rng = defaultdict(float), defaultdict(float), np.random.default_rng(seed)

    def weight(f):
        if f == "bias":
            return -z[f] / ((beta + n[f] ** 0.5) / alpha)
        return 0.0 if abs(z[f]) <= l1 else -(z[f] - np.sign(z[f]) * l1) / ((beta + n[f] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            own = [*texts[i].tolist(), "bias"]
            w = {f: weight(f) for f in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[i]
            for f in own:
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha * w[f]
                n[f] += g * g
    return {f: weight(f) for f in z if f != "bias" and weight(f)}, weight("bias")


@pytest.mark.parametrize("l1", [0.5, 2.0, 8.0])
def test_weights_equal_those_of_a_slow_learner(l1):
    rng = np.random.default_rng(7)
    texts = [np.unique(rng.zipf(1.5, 25) % 300).astype(np.uint32) for _ in range(250)]
    labels = np.array([float(7 in t or 11 in t) for t in texts])
    got = toxicity.learn(texts, labels, l1=l1)
    want, bias = slow_ftrl(texts, labels, l1=l1)
    assert dict(zip(got.ids.tolist(), got.weights.tolist(), strict=True)) == pytest.approx(want)
    assert got.bias == pytest.approx(bias) and want


def test_a_model_that_is_too_large_is_learnt_anew(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [np.unique(rng.zipf(1.5, 25) % 300).astype(np.uint32) for _ in range(250)]
    labels = np.array([float(7 in t or 11 in t) for t in texts])
    whole = toxicity.learn(texts, labels, l1=1.0)
    monkeypatch.setattr(toxicity, "MAX_WEIGHTS", len(whole.ids) - 1)
    got = toxicity.learn(texts, labels, l1=1.0)
    sizes = [len(slow_ftrl(texts, labels, l1=x)[0]) for x in (1.0, 2.0, 4.0, 8.0, 16.0)]
    assert sizes[0] == len(whole.ids) and len(got.ids) == next(n for n in sizes if n < sizes[0])


# --- 5 ---------------------------------------------------------------------------------------


def brute_components(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 60)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], d)
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_rows(seed=3):
    rng = np.random.default_rng(seed)
    rows, base = [], [[f"t{x}" for x in rng.integers(0, 5000, 60)] for _ in range(12)]
    passage = [f"p{x}" for x in range(40)]
    for i in range(160):
        words = list(base[i % 12])
        for k in rng.integers(0, 60, int(rng.integers(0, 5))):
            words[k] = f"n{rng.integers(0, 50)}"
        if i % 3 == 0:
            words += passage
        rows.append((1000 - i, " ".join(words[: int(rng.integers(40, 110))])))
    return rows + [(5, None), (6, ""), (7, "one two"), (8, "ONE two"), (9, "one two"), (10, " \t"), (7, "one two"), (7, rows[0][1])]


@pytest.mark.parametrize("rounds", [jaccard.ROUNDS, (), ((1,),)])
def test_jaccard_components(spark, rounds):
    rows = near_rows()
    got = jaccard.jaccard_components(docs(spark, rows), rounds=rounds)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows)


def test_jaccard_dense_families_are_dealt_as_a_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 100).astype(np.uint64)
    dense = [np.sort(rng.choice(common, 80, replace=False)) for _ in range(60)]  # much in common, few links
    long = rng.integers(0, 1 << 63, 4_040).astype(np.uint64)
    chain = [np.sort(long[10 * i : 10 * i + 40]) for i in range(400)]  # only neighbours have anything in common
    for sets, most in ((dense, 60 * 6), (chain, 400 * 40 // 2)):
        rows = [(i, len(x), bytearray(x.tobytes()), i) for i, x in enumerate(sets)]
        todo = jaccard.unfinished(spark.createDataFrame(rows, "cls long, n long, tokens binary, label long"), 10_000, 60).cache()
        blocks = [(r.key, r.cls) for r in jaccard.exact_blocks(todo, 60).select("key", "cls").collect()]
        assert len(blocks) <= most  # sets that move
        by_key = {}
        for key, i in blocks:
            by_key.setdefault(key, set()).add(i)
        met = {(a, b) for x in by_key.values() for a in x for b in x if a < b}
        want = {(a, b) for a in range(len(sets)) for b in range(a) if 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 60 * (len(sets[a]) + len(sets[b]) - n)}
        assert want and {(b, a) for a, b in want} <= met


def test_jaccard_large_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "ONE_TASK", 0)
    rows = near_rows(4)
    for rounds in ((), ((1,),)):
        got = jaccard.jaccard_components(docs(spark, rows), rounds=rounds)
        assert sorted(tuple(r) for r in got.collect()) == brute_components(rows)


def test_shingles_that_agree_in_their_short_form_count_each(spark):
    twins = np.array([(7 << 32) + 12, (7 << 32) + 24, 9 << 32], np.uint64)
    task = [(1, 1, twins), (2, 2, twins)]
    blobs = [b for rows in (task, task[:1]) for b in jaccard.dealt(iter(rows), 12, short=True)]
    df = spark.createDataFrame([tuple(r.values()) for b in blobs for r in b.to_pylist()], jaccard.BLOBS)
    got = defaultdict(int)
    for r in jaccard.foreign_tokens(df, lists=False).collect():
        for c, n in zip(np.frombuffer(r.classes, np.int64), np.frombuffer(r.counts, np.int64), strict=True):
            got[int(c)] += int(n)
    assert got == {1: 3, 2: 3}


def test_jaccard_empty_and_null_ids(spark):
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0
    got = jaccard.jaccard_components(docs(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (None, "q"), (5, None)])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(None, 2, 4), (4, 2, 4), (None, 1, None), (5, 0, 5)], key=str)


def test_one_row_of_each_component_stays(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "other words are here now"), (4, None), (4, None), (5, "")]
    kept = jaccard.drop_near_duplicates(docs(spark, rows).withColumn("_x", F.lit(1))).collect()
    assert sorted((r.doc_id for r in kept)) == [1, 3, 4, 4, 5]


def test_trie_against_pairs():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, int(rng.integers(5, 30))).astype(np.uint64)) for _ in range(80)]
    links = jaccard.trie_links(list(range(80)), sets, list(range(80)), 60)

    def groups(pairs):
        p = list(range(80))

        def find(a):
            while p[a] != a:
                a = p[a]
            return a

        for a, b in pairs:
            p[find(a)] = find(b)
        return [min(j for j in range(80) if find(j) == find(i)) for i in range(80)]

    want = [(i, j) for i in range(80) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
    assert groups(links) == groups(want)


# --- 6 ---------------------------------------------------------------------------------------


def test_rules_and_reputation(spark):
    urls = ["http://A.example.com/en/7/x", "http://com/en/x", "http://example.com/en/8", "https://x.example.net/de/8?q", "https://de.net/de/1", "ftp://b.org/es/1#z", None, "no scheme", "http://h:80", "x://bad.site.co.uk/p", "x://10.0.0.1/p", "a://b://c/d"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, lower int")
    out = {r.page_id: r for r in reputation.judge_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert [out[i].rule for i in range(6)] == ["example.com/en/7", "com/en/", "com/en/", "example.net/de/8", "net/de/", "org/es/"]
    assert [out[i].verdict for i in range(6)] == ["allow", "block", "block", "block", "allow", "block"]
    assert [(out[i].host, out[i].path) for i in (6, 7, 8, 11)] == [("", ""), ("", ""), ("h:80", ""), ("b:", "//c/d")]
    rows = [(i, f"http://{'bad' if i % 4 == 0 else 'good'}{i % 8}.example.com/x") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(0, None)], "page_id long, bad int")
    got = reputation.judge_urls(pages, bad).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"block": 100, "allow": 300}
    parts = spark.createDataFrame([("a.b.co.uk",), ("x.com:80",), ("com",), ("1.2.3.4",), ("",)], "h string").select(*reputation.domain_parts(F.col("h"))).collect()
    assert [tuple(p) for p in parts] == [("b.co.uk", "co.uk"), ("x.com", "com"), ("com", "com"), ("1.2.3.4", ""), ("", "")]


def test_unlabelled_hosts_follow_domain_and_suffix(spark):
    urls = [f"http://h{i % 10}.{'evil' if i % 2 else 'fine'}.com/x" for i in range(200)] + ["http://new.evil.com/x", "http://new.fine.com/x", "http://a.other.com/x", "http://a.b.zz/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    bad = spark.createDataFrame([(i, i % 2) for i in range(200)], "page_id long, bad int")
    got = {r.host: r for r in reputation.judge_urls(pages, bad).collect()}
    assert [got[h].verdict for h in ("new.evil.com", "new.fine.com", "a.other.com", "a.b.zz")] == ["block", "allow", "allow", "allow"]
    # strengths: kh = kd = LEAST, ks = MOST (one suffix); overall = com = 1/2
    md = (100 + 2 * 0.5) / (100 + 2)
    for host, m in (("new.evil.com", md), ("new.fine.com", 1 - md), ("a.other.com", 0.5), ("a.b.zz", 0.5)):
        assert abs(got[host].lower - (m - reputation.Z * (m * (1 - m) / 3) ** 0.5)) < 1e-9


def test_rules_tie_pages_repeat_and_tables_may_be_empty(spark):
    empty = spark.createDataFrame([], "page_id long, bad int")
    pages = spark.createDataFrame([(1, "http://a.com/x/y"), (1, "http://a.com/x/y"), (None, "http://a.com/z"), (2, "http://h" + "h" * 50_000 + ".com/")], "page_id long, url string")
    clash = pages.selectExpr("*", "1 AS host", "2 AS path", "3 AS n", "4 AS lower", "5 AS _hot", "6 AS _salt", "7 AS rule")
    got = reputation.judge_urls(clash, empty, rules=(("com/x", "block"), ("a.com/", "allow"))).collect()
    assert sorted(((r.page_id, r.rule, r.verdict) for r in got), key=str) == sorted([(1, "a.com/", "allow"), (1, "a.com/", "allow"), (None, "a.com/", "allow"), (2, None, "allow")], key=str)
    tied = reputation.judge_urls(pages.limit(1), empty, rules=(("com/x/", "block"), ("a.com/", "allow"))).first()
    assert tied.rule == min(("com/x/", "a.com/"))  # equally long
    assert reputation.judge_urls(pages.limit(0), empty).count() == 0
    hot = spark.createDataFrame([(i, f"http://{'big' if i % 3 else f'h{i}'}.com/") for i in range(3000)], "page_id long, url string")
    bad = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(3000)], "page_id long, bad int")
    got = {r.host: r["count"] for r in reputation.judge_urls(hot, bad).where("verdict = 'block'").groupBy("host").count().collect()}
    assert got == {"big.com": 2000}


def test_given_suffixes_come_first(spark):
    d = spark.createDataFrame([("a.b.school.k12.ma.us",), ("x.github.example",), ("b.co.uk",), ("k12.ma.us",)], "h string")
    got = d.select(*reputation.domain_parts(F.col("h"), suffixes=("ma.us", "k12.ma.us", "github.example"))).collect()
    assert [tuple(r) for r in got] == [("school.k12.ma.us", "k12.ma.us"), ("x.github.example", "github.example"), ("b.co.uk", "co.uk"), ("k12.ma.us", "k12.ma.us")]


def test_extra_columns_change_nothing(spark):
    rows = [(i, f"token = 'abcdef{i}' some words of text number {i % 3} here", f"s{i % 2}") for i in range(30)] + [(3, "x " * 60_000, None)]
    plain = docs(spark, rows, "doc_id long, text string, source string")
    names = ("h", "cell", "b", "k", "depth", "page", "key", "low", "trigram", "ask", "_s0", "digest", "cls", "n", "tokens", "_first", "_cls", "_text", "bucket", "s")
    clash = plain.selectExpr("*", *[f"{i} AS {n}" for i, n in enumerate(names)])
    for run in (lambda d: sharding.shard_by_hash(d, limit=500), secrets.find_secrets, jaccard.jaccard_components):
        assert sorted(map(str, run(plain).collect())) == sorted(map(str, run(clash).collect()))


# --- 7 ---------------------------------------------------------------------------------------


def test_sharding_fits_and_is_minimal(spark):
    rows = [(i, "x" * (i % 50)) for i in range(500)] + [(None, None), (3, ""), (1, "y" * 5000)] + [(9, "same text")] * 400
    got = sharding.shard_by_hash(docs(spark, rows), limit=900).toPandas()
    assert len(got) == len(rows)
    size = got.groupby(["prefix", "page"])["n_bytes"].agg(["sum", "count"])
    assert ((size["sum"] <= 900) | (size["count"] == 1)).all()
    whole = got.groupby("prefix")["n_bytes"].sum()
    for p in whole.index:  # a bucket was split only because its parent was too large
        if p:
            assert got[got["prefix"].str.startswith(p[:-1])]["n_bytes"].sum() > 900
    assert sharding.shard_by_hash(docs(spark, [])).count() == 0


# --- 8 ---------------------------------------------------------------------------------------


def fill(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, open_, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, set(order), {}
    while True:
        rest = sum(sizes.values()) - sum(target.values())
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 3 * sizes[s]} if open_ else set()
        if not over:
            return target | {s: rest * weight[s] / total for s in open_}
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over


def test_mixing_targets_and_draws(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["a", "b", "c", "Z", None, "tiny"][int(rng.choice(6, p=[0.1, 0.1, 0.4, 0.2, 0.18, 0.02]))]) for i in range(900)] + [(1, None, "a"), (None, "x y", "b"), (None, "x y", "b")]
    d = docs(spark, rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix_sources(d).toPandas()
    again = mixing.mix_sources(d).toPandas()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = fill(sizes)
    for s, g in got.groupby(got["source"].fillna("none")):
        s = None if s == "none" else s
        assert g["target"].iloc[0] == pytest.approx(want[s])
        assert abs(g["taken"].sum() - want[s]) <= 60
    assert (got["taken"] <= 3 * got["size"]).all() and len(got) == len(rows)
    assert sorted(map(str, got[["doc_id", "taken"]].values)) == sorted(map(str, again[["doc_id", "taken"]].values))
    assert mixing.mix_sources(docs(spark, [], "doc_id long, text string, source string")).count() == 0


# --- 9 ---------------------------------------------------------------------------------------


def brute_lines(rows, least):
    seen, gone = {}, defaultdict(set)
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for i in order:
        lines = (rows[i][1]).split("\n")
        for a in range(len(lines)):
            n, b = 0, a
            while b < len(lines) and n < least:
                n, b = n + len(lines[b].split()), b + 1
            if n >= least:
                run = tuple(lines[a:b])
                if seen.setdefault(run, (rows[i][0], a)) != (rows[i][0], a):
                    gone[rows[i][0]] |= set(range(a, b))
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in rows}


def test_line_intervals_over_tasks(spark, monkeypatch):
    """Neighbours in the suffix array are compared, also the last of a task and the first of the next."""
    rng = np.random.default_rng(3)
    rows = [(int(d), 7, int(line), int(c), int(need), int(c2)) for d, line, c, need, c2 in {(d, line, *k) for d in range(300) for line in range(2) for k in [[(5, 1, 0), (5, 1, 9), (5, 2, 9), (-4, 1, 0), (d + 100, 1, 0)][rng.integers(0, 5)]]}]
    here = spark.createDataFrame(rows, "doc long, digest long, line int, c long, need int, c2 long").repartition(7)
    seen = []
    monkeypatch.setattr(linededup, "saved", lambda df: seen.append(common.saved(df)) or seen[-1])
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")
    try:
        got = sorted((r.doc, r.line) for r in linededup.later_copies(here).collect())
    finally:
        spark.conf.unset(merged)
    runs = defaultdict(list)
    for d, _, line, *key in rows:
        runs[tuple(key)].append((d, line))
    assert got == sorted(x for v in runs.values() for x in sorted(v)[1:])
    assert seen[0].select("task").distinct().count() > 1
    assert linededup.later_copies(here.limit(0)).count() == 0


def test_line_runs(spark):
    rng = np.random.default_rng(5)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 9, int(rng.integers(0, 5)))) for _ in range(25)]
    rows = [(i, "\n".join(pool[k] for k in rng.integers(0, 25, int(rng.integers(1, 30))))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    for least in (6, 15):
        got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, rows), min_words=least).collect()}
        assert got == brute_lines(rows, least)


def test_runs_of_other_lengths_are_no_copies(spark):
    long = " ".join(f"w{x}" for x in range(60))
    rows = [(1, "Title\n\n\n\n" + long), (2, "Title\n\n\n\n\n" + long)]
    got = linededup.dedup_lines(docs(spark, rows)).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [0, 4] and got[1].text == "Title\n"
    assert [(r["first"], r["last"]) for r in got[1].runs] == [(2, 6)]


BLANKS = st.lists(st.sampled_from(["", "", "", "a b", "c", "a b c d e f"]), max_size=14).map("\n".join)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(BLANKS, min_size=2, max_size=12), st.integers(2, 7))
def test_line_runs_with_many_blank_lines(spark, texts, least):
    rows = list(enumerate(texts))
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, rows), min_words=least).collect()}
    assert got == brute_lines(rows, least)


def test_hot_lines_are_salted(spark):
    rows = [(i, "\n" * (i % 7) + f"u{i} v w\n\n\nx y z") for i in range(300)]
    kept = common.skew_join
    linededup.skew_join = lambda *a: kept(*a, least=5)
    try:
        got = {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, rows), min_words=3).collect()}
    finally:
        linededup.skew_join = kept
    assert got == brute_lines(rows, 3)


def test_line_run_edges(spark):
    text = "a b c\n\nd e f\n" + "x y z " * 10
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, text + "\nnew line")]
    clashes = docs(spark, rows).selectExpr("*", "1 AS runs", "2 AS _runs", "3 AS _doc", "4 AS _DIGEST", "5 AS line")
    got = linededup.dedup_lines(clashes, min_words=5)
    assert got.columns == ["doc_id", "text", "_runs", "_doc", "_DIGEST", "line", "n_lines", "n_removed", "runs"]
    kept = sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in got.collect())
    assert kept == sorted([("1", "", 4, 4), ("1", "", 4, 4), ("2", None, 0, 0), ("3", "", 1, 0), ("None", text, 4, 0), ("4", "new line", 5, 4)])
    assert linededup.dedup_lines(docs(spark, [])).count() == 0
    pool = [" ".join(f"q{x}" for x in range(k, k + 9)) for k in range(40)]
    long = "\n".join(pool[k % 40] + f" {k // 40}" for k in range(20_000))
    rows = [(1, long), (2, "own\n" + long + "\nend"), (3, pool[0] + " 0")]
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs(spark, rows)).collect()} == {1: long, 2: "own\nend", 3: pool[0] + " 0"}


# --- 10 --------------------------------------------------------------------------------------


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", ("aki", "kia"))
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("(foo|ba[rz])x*quux") == ("and", (("or", ("bar", "baz", "foo")), ("and", ("quu", "uux"))))
    assert secrets.trigram_query("ab?c") is True
    assert secrets.trigram_query("(?:abcd)?efg") == "efg"


def brute_spans(text):
    out = []
    for place, r in enumerate(secrets.BASE + secrets.MORE):
        out += [(m.start(), place, m.end(), r.kind) for m in re.finditer(r.regex, text) if len(m[r.value]) >= r.least]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def test_secret_spans(spark):
    hexes = "0123456789abcdef" * 2
    rows = [(1, f'Ünï password = "hunter22" and token:abc {hexes}'), (2, None), (3, ""), (4, "AKIA" + "A" * 16 + " AKIAshort"), (None, "secret:token:abcdef api-key api_key='zzzzzz'"), (5, "x " * 50_000 + f"TOKEN={hexes}"), (1, "ghp_" + "a1B2" * 9), (6, "-----BEGIN RSA PRIVATE KEY-----")]
    rows = rows + [rows[0]]
    got = [(r.doc_id, [(s.kind, s.start, s.stop) for s in r.spans]) for r in secrets.find_secrets(docs(spark, rows)).collect()]
    want = [(d, brute_spans(t or "")) for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert secrets.find_secrets(docs(spark, [])).count() == 0
