"""Secret scans with a trigram inverted index. DataFrame functions only.

Each rule's regex is analysed once, on the driver, into a Boolean query over the trigrams that
every match must contain. The index holds, for each trigram that any rule asks for, the rows
whose lower-cased text has it. Posting lists are intersected by folding the postings of a row
into one bit mask; only rows whose mask satisfies a rule's query run that rule's regex. Rules
without mandatory trigrams scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    from re import _constants as rc
    from re import _parser as rp
except ImportError:  # before Python 3.11
    import sre_constants as rc
    import sre_parse as rp

from .common import saved, table


@dataclass(frozen=True)
class Rule:
    """kind: name in spans; value: the group whose length must reach ``least``; a match that fails is dropped but consumed."""

    kind: str
    regex: str
    value: int = 0
    least: int = 1


#: The base kinds, in the order in which ties of start are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Formats of public issuers that the base kinds don't cover.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("maps", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[sr]k_live_[0-9A-Za-z]{16,}"),
)
EXACT_MOST = 64  # longest list of exact strings that is carried on


# A query is True (no constraint), a trigram, or ("and" | "or", queries).


def _and(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts):
    parts = list(dict.fromkeys(parts))
    if True not in parts:  # A or (A and B) is A
        own = [set(query_trigrams(p)) if isinstance(p, str) or p[0] == "and" and all(isinstance(x, str) for x in p[1]) else None for p in parts]
        parts = [p for p, s in zip(parts, own, strict=True) if s is None or not any(o is not None and o < s for o in own)]
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings) -> object:
    """Query for: one of these strings occurs."""
    return _or([_and([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class(items) -> set[str] | None:
    chars: set[str] = set()
    for op, arg in items:
        if op is rc.LITERAL:
            chars.add(chr(arg).lower())
        elif op is rc.RANGE and arg[1] - arg[0] < EXACT_MOST:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return chars if len(chars) <= 8 else None


def _walk(seq) -> tuple[set[str] | None, object]:
    """(exact strings or None, query) of a parsed sequence; strings are folded to lower case."""
    run: set[str] = {""}
    exact, queries = True, []

    def flush(start: set[str]) -> None:
        nonlocal run, exact
        queries.append(_of_strings(run))
        run, exact = start, False

    for op, arg in seq:
        if op is rc.LITERAL:
            own = {chr(arg).lower()}
        elif op is rc.IN:
            own = _class(arg)
        elif op is rc.SUBPATTERN:
            own, q = _walk(arg[3])
            if own is None:
                queries.append(q)
        elif op is rc.BRANCH:
            sides = [_walk(x) for x in arg[1]]
            own = set().union(*[s for s, _ in sides]) if all(s is not None for s, _ in sides) else None
            if own is None:
                queries.append(_or([_of_strings(s) if s is not None else q for s, q in sides]))
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, inner = arg
            strings, q = _walk(inner)
            if strings is not None and (low, high) == (0, 1):
                own = strings | {""}
            elif strings is not None and low >= 1 and len(strings) == 1 and low * len(next(iter(strings))) <= EXACT_MOST:
                once = next(iter(strings)) * low
                own = {once} if low == high else None
                if own is None:
                    run = {r + once for r in run}
            else:
                own = None
                if low:
                    queries.append(q if strings is None else _of_strings(strings))
        else:
            own = {""} if op is rc.AT else None
        if own is None or len(run) * len(own) > EXACT_MOST:
            flush({""} if own is None else own)
        else:
            run = {a + b for a in run for b in own}
    if exact:
        return run, _of_strings(run)
    queries.append(_of_strings(run))
    return None, _and(queries)


def trigram_query(regex: str) -> object:
    """The Boolean trigram query that every text with a match satisfies once it is lower-cased."""
    return _walk(rp.parse(regex))[1]


def query_trigrams(q) -> list[str]:
    return [] if q is True else [q] if isinstance(q, str) else sorted({t for p in q[1] for t in query_trigrams(p)})


def holds(q, has) -> Column:
    """The query as a column; ``has`` gives the column of a trigram."""
    if q is True:
        return F.lit(True)
    if isinstance(q, str):
        return has(q)
    out = None
    for p in q[1]:
        c = holds(p, has)
        out = c if out is None else out & c if q[0] == "and" else out | c
    return out


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows of one key share id and text but for hash collisions, which only add candidates."""
    return F.xxhash64(doc_id, text)


def postings(df: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram number, key), one row for each trigram that a row's text has."""
    rows = df.select("key", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*[F.when(F.col("low").contains(t), i) for i, t in enumerate(trigrams)]))
    return rows.select("key", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, trigrams: list[str], rules) -> DataFrame:
    """(key, ask): intersects the posting lists; bit i of ``ask`` says that the query of rule i holds."""
    words = [F.bit_or(F.when(F.floor(F.col("trigram") / 60) == w, F.expr("shiftleft(1L, cast(trigram % 60 as int))")).otherwise(0)).alias(f"m{w}") for w in range(len(trigrams) // 60 + 1)]
    masks = index.groupBy("key").agg(*words)
    number = {t: i for i, t in enumerate(trigrams)}

    def has(t: str) -> Column:
        return F.col(f"m{number[t] // 60}").bitwiseAND(1 << (number[t] % 60)) != 0

    ask = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        q = trigram_query(r.regex)
        if q is not True:
            ask = ask + F.when(holds(q, has), 1 << i).otherwise(0)
    return masks.select("key", ask.alias("ask")).where("ask <> 0")


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, place, stop, kind>> of the rule's kept matches: leftmost, non-overlapping, in code points."""
    between, found = F.split(text, rule.regex, -1), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.value)) if rule.value else found
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,place:int,stop:int,kind:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(m["between"])
        stop = begin + F.length(m["found"])
        one = F.array(F.struct(begin.alias("start"), F.lit(order).alias("place"), stop.alias("stop"), F.lit(rule.kind).alias("kind")))
        return F.struct(stop.alias("at"), F.when(F.length(m["value"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    parts = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("between"), found.alias("found"), value.alias("value"))
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def scan_regex(rule: Rule) -> Rule:
    """Rules that scan every text: a single repeated class is asked for its least length at once, which keeps the same matches."""
    if rule.value == 0 and rule.least > 1 and re.fullmatch(r"\[[^\]]+\]\+", rule.regex):
        return Rule(rule.kind, f"{rule.regex[:-1]}{{{rule.least},}}", 0, rule.least)
    return rule


def find_secrets(df: DataFrame, rules=BASE + MORE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): spans of all rules by start, then by the rules' order.

    A null text has no spans; every row of repeated rows is scanned; an empty table gives no
    rows; other columns are ignored.
    """
    rules = [scan_regex(r) for r in rules]
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    asked = [trigram_query(r.regex) for r in rules]
    trigrams = sorted({t for q in asked for t in query_trigrams(q)})
    found = candidates(postings(rows, trigrams), trigrams, rules)
    rows = rows.join(found, "key", "left")
    nothing = F.array().cast("array<struct<start:int,place:int,stop:int,kind:string>>")
    for i, r in enumerate(rules):
        yes = F.lit(True) if asked[i] is True else F.coalesce(F.col("ask").bitwiseAND(1 << i) != 0, F.lit(False))
        yes = yes & F.col("text").rlike(r.regex)
        rows = rows.withColumn(f"_s{i}", F.when(yes, spans_of(F.col("text"), r, i)).otherwise(nothing))
    return rows.select("doc_id", F.array_sort(F.concat(*[F.col(f"_s{i}") for i in range(len(rules))])).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _is(place: int):
    return lambda p: p == place


def op10_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    places = F.transform(spans, lambda s: s["place"])
    counts = [F.size(F.filter(places, _is(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    base = F.filter(spans, lambda s: s["place"] < len(BASE))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def _sql_spans(rule: Rule, place: int) -> str:
    rx = rule.regex.replace("'", "''")
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {place} AS place, a, a + length(m[k]) AS b FROM (
      SELECT *, CAST(list_sum(list_transform(s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM (
        SELECT doc_id, m, g, s, unnest(range(1, len(m) + 1)) AS k FROM (
          SELECT doc_id, regexp_extract_all(t, '{rx}', 0) AS m, regexp_extract_all(t, '{rx}', {rule.value}) AS g, string_split_regex(t, '{rx}') AS s FROM d))) WHERE length(g[k]) >= {rule.least}"""


OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(BASE + MORE))}),
w AS (SELECT *, kind || ':' || a || ':' || b AS w FROM x),
c AS (SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
  string_agg(w, ',' ORDER BY a, place) FILTER (place < {len(BASE)}) AS base, string_agg(w, ',' ORDER BY a, place) AS spans FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN c USING (doc_id)
"""
