"""Secret scan through a trigram inverted index. DataFrame functions only.

`trigram_query` derives from a rule's regular expression what every match must contain: alternatives, each a set of trigrams
(lower-cased, as the index is). `trigram_postings` writes the postings (trigram, document) of the trigrams that the rules ask for;
`candidates` intersects them per rule and alternative; only candidates have their text matched. A rule one of whose alternatives has
no trigram (a long run of hex digits) scans every text.

Spans are those of the leftmost non-overlapping matches of a rule's pattern whose measured group is long enough, in code
points, end exclusive. Documents are keyed by doc_id and a hash of the text, so postings never gather in one place per trigram: each
step groups by document.

Defined results: a null text counts as empty and has no spans. Equal rows are one document for the scan and give a result row
each. A null doc_id is a value like any other. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callnet.llm.common import ascii_lower, read_table


@dataclass(frozen=True)
class Rule:
    """pattern: Java and Python agree on it. The match counts if group `measured` has `least` characters or more."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # runs of 32 and more: the same spans as all maximal runs with the shorter ones dropped
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED
#: Alternatives that a rule may expand to, and literals of a class that are told apart.
_MOST, _CLASS = 64, 8


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of required trigrams, or None if some match may hold none."""
    from re import _constants as C
    from re import _parser as P

    # an alternative is (finished literal runs, the run being read)
    State = tuple[tuple[str, ...], str]

    def ended(states: list[State]) -> list[State]:
        return list({(runs + ((now,) if now else ()), "") for runs, now in states})

    def walk(items, states: list[State]) -> list[State]:
        for op, arg in items:
            if op is C.LITERAL:
                states = [(r, now + chr(arg).lower()) for r, now in states]
            elif op is C.SUBPATTERN:
                states = walk(arg[-1], states)
            elif op is C.BRANCH:
                states = [s for part in arg[1] for s in walk(part, states)]
            elif op is C.IN and len(arg) <= _CLASS and all(o is C.LITERAL for o, _ in arg) and len(states) * len(arg) <= _MOST:
                states = [(r, now + chr(c).lower()) for r, now in states for _, c in arg]
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                least, most, body = arg
                if (least, most) == (0, 1) and len(body) == 1 and body[0][0] is C.LITERAL:
                    states = states + walk(body, states)
                elif least:
                    states = ended(walk(body, states))
                else:
                    states = ended(states)
            elif op is not C.AT:
                states = ended(states)
            if len(states) > _MOST:
                states = ended([((), "")])
        return states

    found = {frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)) for runs, _ in ended(walk(P.parse(pattern), [((), "")]))}
    return None if frozenset() in found else sorted(found, key=sorted)


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def trigram_postings(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, doc_id, th) for the trigrams that the rules ask for; `texts` as from `keyed`."""
    wanted = sorted({t for r in rules for alternative in trigram_query(r.pattern) or () for t in alternative})
    low = texts.select("doc_id", "th", ascii_lower(F.col("text")).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select(F.explode(found).alias("trigram"), "doc_id", "th")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, th, rules): the rules, by number, one of whose alternatives has all its trigrams in the document."""
    asked = [(t, i, j, len(alternative)) for i, r in enumerate(rules) for j, alternative in enumerate(trigram_query(r.pattern) or ()) for t in sorted(alternative)]
    terms = postings.sparkSession.createDataFrame(asked, "trigram string, rule int, alternative int, need int")
    met = postings.join(F.broadcast(terms), "trigram").groupBy("doc_id", "th", "rule", "alternative").agg(F.countDistinct("trigram").alias("n"), F.first("need").alias("need"))
    return met.where("n = need").groupBy("doc_id", "th").agg(F.collect_set("rule").alias("rules"))


def _matches(rule: Rule) -> Column:
    text, pattern = F.col("text"), F.lit(rule.pattern)
    return F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("before"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.regexp_extract_all(text, pattern, F.lit(rule.measured)).alias("measured")
    )


def _spans(texts: DataFrame, rules: tuple[Rule, ...], numbers: list[int], asked: Column | None) -> DataFrame:
    """(doc_id, th, kind, start, end) of the counted matches. asked: the rules wanted, an array of numbers."""
    per_rule = [F.struct(F.lit(i).alias("kind"), F.when(F.lit(True) if asked is None else F.array_contains(asked, i), _matches(rules[i])).alias("m")) for i in numbers]
    rows = texts.select("doc_id", "th", F.explode(F.array(*per_rule)).alias("r")).where("r.m IS NOT NULL")
    rows = rows.select("doc_id", "th", F.col("r.kind").alias("kind"), F.posexplode("r.m").alias("at", "m"))
    rows = rows.select("doc_id", "th", "kind", "at", *[F.char_length(f"m.{c}").alias(c) for c in ("before", "found", "measured")])
    earlier = Window.partitionBy("doc_id", "th", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.col("before") + F.coalesce("found", F.lit(0))).over(earlier), F.lit(0)) + F.col("before"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("kind") + 1)
    return rows.where(F.col("found").isNotNull() & (F.col("measured") >= least)).select("doc_id", "th", "kind", "start", (F.col("start") + F.col("found")).alias("end"))


def secret_spans(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, th, kind, start, end), kind: the rule's number; `texts` as from `keyed`, without repeated rows' copies."""
    indexed = [i for i, r in enumerate(rules) if trigram_query(r.pattern) is not None]
    scanned = [i for i in range(len(rules)) if i not in indexed]
    out = None
    if indexed:
        named = candidates(trigram_postings(texts, rules), rules)
        c = named.select(F.col("doc_id").alias("c_doc_id"), F.col("th").alias("c_th"), "rules")
        hit = texts.join(c, texts["doc_id"].eqNullSafe(c["c_doc_id"]) & (texts["th"] == c["c_th"])).select("doc_id", "th", "text", "rules")
        out = _spans(hit, rules, indexed, F.col("rules"))
    if scanned:
        some = F.lit(False)
        for i in scanned:
            some = some | F.rlike("text", F.lit(rules[i].pattern))
        full = _spans(texts.where(some), rules, scanned, None)
        out = full if out is None else out.union(full)
    return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, th, found) per row of docs; found: array of (start, kind, end), sorted; kind is the rule's number."""
    texts = keyed(docs)
    # equal rows find each span several times: `distinct` folds them
    spans = secret_spans(texts, rules).distinct().groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    s = spans.select(F.col("doc_id").alias("s_doc_id"), F.col("th").alias("s_th"), "found")
    rows = texts.select("doc_id", "th")
    joined = rows.join(s, rows["doc_id"].eqNullSafe(s["s_doc_id"]) & (rows["th"] == s["s_th"]), "left")
    return joined.select("doc_id", "th", F.coalesce("found", F.array().cast(spans.schema["found"].dataType)).alias("found"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    names = F.array(*[F.lit(r.kind) for r in rules])
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda i: F.size(F.filter("found", lambda x: x["kind"] == i)).cast("long").alias(f"n_{rules[i].kind}")
    found = scan(docs, rules)
    return found.select("doc_id", *[count(i) for i in range(base)], F.sha2(line(F.filter("found", lambda x: x["kind"] < base)), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    def either_case(pattern: str) -> str:
        words = "(password|passwd|secret|token|api_?key)"
        return pattern.replace("(?i)", "").replace(words, re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words))

    parts = []
    for i, r in enumerate(RULES):
        p = either_case(r.pattern).replace("'", "''")
        parts.append(
            f"SELECT doc_id, {i} AS no, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, '{p}') AS b, regexp_extract_all(t, '{p}', 0) AS f, regexp_extract_all(t, '{p}', {r.measured}) AS g FROM texts"
        )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT doc_id, no, kind, least, unnest(range(1, len(f) + 1)) AS i, f, b, g FROM m WHERE len(f) > 0),
l AS (SELECT doc_id, no, kind, least, i, length(b[i]) AS before, length(f[i]) AS found, length(g[i]) AS measured FROM e),
s AS (SELECT *, before + coalesce(sum(before + found) OVER (PARTITION BY doc_id, no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
k AS (SELECT doc_id, no, kind, CAST(start AS BIGINT) AS start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + found AS BIGINT) AS line FROM s WHERE measured >= least)
SELECT d.doc_id, CAST(count(*) FILTER (WHERE no = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (WHERE no = 1) AS BIGINT) AS n_access,
       CAST(count(*) FILTER (WHERE no = 2) AS BIGINT) AS n_hex,
       sha256(coalesce(string_agg(line, ',' ORDER BY start, no) FILTER (WHERE no < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg(line, ',' ORDER BY start, no), '') AS spans
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""


ORACLE = _oracle()
