"""Secret scans over a trigram inverted index.

1. Each rule's regular expression gives a Boolean trigram query: an AND of clauses, each an OR
   of strings one of which every match must hold, each string the AND of its trigrams.
2. The index holds a posting (trigram, document) for every trigram that some rule asks for.
   Postings are met with the clauses and intersected per document.
3. Only candidates are verified by the expression itself. A rule without a mandatory trigram
   scans every text.

Spans are (start, end) in code points, end exclusive, leftmost and non-overlapping per kind.
Nulls and edge cases: a null text is an empty one; a null id is an id of its own; rows that
repeat an id share their candidates, which only costs a needless check, for each text is
verified on its own; no rows give no rows. Other columns are not carried.
"""

from __future__ import annotations

import itertools
import re
import re._constants as tokens
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shelfcast.functions.tables import written
from shelfcast.llm.common import table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `group` must have `least` characters; failing matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds, in their order of listing. Only ASCII letters fold case. Runs of
# one class are written with their least length, which finds the same spans as dropping shorter runs.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Publicly documented shapes of further credentials.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + ADDED
# Strings a clause may spell out before it is cut; a longer clause would not be more selective.
MOST_STRINGS = 32


def _strings(node) -> list[str] | None:
    """All strings that a part of an expression can match, or None if there are too many."""
    kind, value = node
    if kind is tokens.LITERAL:
        return [chr(value)]
    if kind is tokens.IN:
        if all(k is tokens.LITERAL for k, _ in value):
            return [chr(c) for _, c in value]
        return None
    if kind is tokens.SUBPATTERN:
        return _sequence_strings(value[3])
    if kind is tokens.BRANCH:
        parts = [_sequence_strings(p) for p in value[1]]
        return None if any(p is None for p in parts) else [s for p in parts for s in p]
    if kind is tokens.MAX_REPEAT and value[0] == 0 and value[1] == 1:
        inner = _sequence_strings(value[2])
        return None if inner is None else ["", *inner]
    return None


def _sequence_strings(nodes) -> list[str] | None:
    found = [""]
    for node in nodes:
        options = _strings(node)
        if options is None or len(found) * len(options) > MOST_STRINGS:
            return None
        found = [a + b for a, b in itertools.product(found, options)]
    return found


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of clauses; a clause is an OR of trigram sets. Lower case, as the index is.

    Runs of parts with few possible strings are spelled out; a run whose strings are all three
    characters or longer is a clause. No clause means that every text is a candidate.
    """
    clauses, run = [], [""]

    def close() -> None:
        if all(len(s) >= 3 for s in run):
            clauses.append(sorted({_trigrams(s.lower()) for s in run}, key=sorted))

    for node in parser.parse(pattern):
        options = _strings(node)
        # A part that may be absent, or would blow up the clause, ends it.
        if options is None or "" in options and len(run[0]) >= 3 or len(run) * len(options) > MOST_STRINGS:
            close()
            run = [""] if options is None or "" in options else options
        else:
            run = [a + b for a, b in itertools.product(run, options)]
    close()
    return clauses


def _anywhere(trigrams: list[str]) -> str:
    """An expression that finds every one of the trigrams at every place, overlaps included.

    A look-ahead takes no characters, so each place is tried; letters are branched on one by
    one, so a place costs about one comparison for most texts.
    """
    tree: dict[str, dict[str, list[str]]] = {}
    for first, second, third in trigrams:
        tree.setdefault(first, {}).setdefault(second, []).append(third)
    quoted = lambda letters: "[" + "".join(map(re.escape, letters)) + "]"
    branches = "|".join(
        f"{re.escape(first)}(?:" + "|".join(f"{re.escape(second)}{quoted(thirds)}" for second, thirds in rest.items()) + ")"
        for first, rest in tree.items())
    return f"(?={quoted(tree)})(?=({branches}))"


def postings(docs: DataFrame, wanted: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: one row (trigram, doc) per trigram that rules ask for and text that holds it."""
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(_anywhere(wanted)), F.lit(1)))
    return docs.select(F.col(doc_id).alias("doc"), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, kinds): the indexed rules whose trigram query holds for some text of that id."""
    spark = docs.sparkSession
    asked = [(r.kind, c, o, t, len(option), len(query))
             for r in rules for query in [trigram_query(r.pattern)]
             for c, clause in enumerate(query) for o, option in enumerate(clause) for t in sorted(option)]
    queries = spark.createDataFrame(
        asked, "kind string, clause int, option int, trigram string, trigrams int, clauses int")
    index = written(postings(docs, sorted({row[3] for row in asked}), doc_id, text), "postings")
    options = (
        index.distinct().join(queries, "trigram").groupBy("doc", "kind", "clause", "option", "trigrams", "clauses")
        .count().filter(F.col("count") == F.col("trigrams")))
    kinds = options.groupBy("doc", "kind", "clauses").agg(F.countDistinct("clause").alias("met")).filter("met = clauses")
    return written(kinds.groupBy("doc").agg(F.collect_set("kind").alias("kinds")), "candidates")


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, kind, end>> of one rule in one text.

    The pieces between matches and the matches' own lengths add up to the places.
    """
    pattern = F.lit(rule.pattern)
    pieces = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.least else matches
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    found = F.aggregate(
        F.arrays_zip(
            F.slice(F.transform(pieces, lambda p: F.length(p).cast("long")), F.lit(1), F.size(matches)).alias("gap"),
            F.transform(matches, lambda m: F.length(m).cast("long")).alias("size"),
            F.transform(kept, lambda m: F.length(m)).alias("kept")),
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
        lambda state, m: F.struct(
            (state["at"] + m["gap"] + m["size"]).alias("at"),
            F.when(m["kept"] >= rule.least, F.concat(state["out"], F.array(F.struct(
                (state["at"] + m["gap"]).alias("start"), (state["at"] + m["gap"] + m["size"]).alias("end")))))
            .otherwise(state["out"]).alias("out")),
        lambda state: state["out"])
    return F.when(F.rlike(text, pattern), found).otherwise(empty)


def _listed(spans: list[tuple[str, Column]]) -> Column:
    """All spans as kind:start:end, by start, then kind in the order of listing."""
    def shown(k: int, kind: str):
        return lambda s: F.struct(
            s["start"], F.lit(k).alias("k"), s["end"],
            F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("shown"))

    every = F.concat(*[F.transform(found, shown(k, kind)) for k, (kind, found) in enumerate(spans)])
    return F.array_join(F.array_sort(every)["shown"], ",")


def scanned(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans_<kind> for every rule): the verified spans of every row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = candidates(docs, rules, "doc_id", "text")
    indexed = {r.kind for r in rules if trigram_query(r.pattern)}
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["doc"]), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def verified(rule: Rule) -> Column:
        if rule.kind not in indexed:
            return spans_of(F.col("text"), rule)
        asked = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False))
        return F.when(asked, spans_of(F.col("text"), rule)).otherwise(none)

    return joined.select("doc_id", *[verified(r).alias(f"spans_{r.kind}") for r in rules])


def op5_secret_spans(spark, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"))
    of = {r.kind: F.col(f"spans_{r.kind}") for r in RULES}
    return found.select(
        "doc_id", *[F.size(of[r.kind]).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(_listed([(r.kind, of[r.kind]) for r in BASE]), 256).alias("base_sha256"),
        _listed([(r.kind, of[r.kind]) for r in RULES]).alias("spans"))


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """DuckDB: the spans of one expression by the lengths of what lies between its matches."""
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT row_no, '{kind}' AS kind, {rank} AS k, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
      'a': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
      'n': length(m[i]), 'g': length(g[i])}})) AS s
  FROM (SELECT row_no, string_split_regex(text, '{quoted}') AS p, regexp_extract_all(text, '{quoted}') AS m,
               regexp_extract_all(text, '{quoted}', {group}) AS g FROM docs)"""


# The same kinds for DuckDB's expressions, in which (?i) would also fold letters beyond ASCII.
_ASCII_WORDS = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_SQL_RULES = [
    ("assign", rf"""({_ASCII_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0), ("code_host", "gh[opsu]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
    ("cloud_key", "AIza[A-Za-z0-9_-]{35}", 0, 0), ("payment", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
]
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_sql_spans(k, i, p, g, n) for i, (k, p, g, n) in enumerate(_SQL_RULES))}),
kept AS (
  SELECT row_no, kind, k, s.a::BIGINT AS a, kind || ':' || s.a::BIGINT || ':' || (s.a + s.n)::BIGINT AS shown
  FROM found WHERE s.g >= CASE kind {" ".join(f"WHEN '{k}' THEN {n}" for k, _, _, n in _SQL_RULES)} END),
listed AS (
  SELECT row_no, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex, string_agg(shown, ',' ORDER BY a, k) AS spans,
         string_agg(shown, ',' ORDER BY a, k) FILTER (k < 3) AS base
  FROM kept GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (row_no)
"""
