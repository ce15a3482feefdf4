"""Information-theoretic sanitisation of personal data.

1. Base spans: e-mail addresses, IP addresses, card and phone numbers by their patterns. Each distinct
   value, written one way, is an entity to protect.
2. The terms within `WINDOW` words of an entity are its neighbourhood in a text. Over the whole
   corpus, near(c, t) counts the occurrences of term t in neighbourhoods of entity c, and n(t) all
   occurrences of t. With p(c | t) = near / n and p(c) the share of all words that lie near c, a term
   tells PMI(c; t) = log2(p(c | t) / p(c)) bits of the IC(c) = -log2 p(c) bits that name the entity.
3. A term whose share PMI / IC reaches `THRESHOLD` discloses the entity, wherever it stands, given at
   least `CONTEXTS` different neighbourhoods: copies of a passage are one witness.
4. Such a term is generalised to its first `STEM` letters, if all terms that begin so tell less than
   the threshold about every entity it discloses, and is removed otherwise.

Base spans always stay. A disclosing term gets a span of kind `term` wherever it does not overlap a
base span. `sanitised` writes the texts anew.

A neighbourhood is bounded, so pairs grow with the entities found and not with the length of texts.
Counts of an entity or a term that a third of the documents hold are summed before the shuffle. No table
holds a row per text and word: one scan counts words, a second meets the few terms found to disclose.

Nulls and edge cases: a null text is empty (and stays null when sanitised); empty texts have no spans;
doc_id may be null or repeat, each row has its own spans, and rows equal in id and text are alike;
texts of any length are scanned in time linear in it; no rows give no rows. Extra columns pass through
`sanitised` and are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfcast.functions.shipping import shipped
from shelfcast.functions.tables import written
from shelfcast.llm.common import fresh, table
from shelfcast.llm.decontaminate import key_of
from shelfcast.llm.lexical_search import LOWER, TERM, UPPER

KINDS = ("email", "ip", "card", "phone")
WINDOW = 8
CONTEXTS = 3
THRESHOLD = 0.9
STEM = 3
# Hash codes that tell before a join which rows may have a partner; at most so many are broadcast.
CODES = 1 << 20
# How a text is written without its personal data.
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
REMOVED = "[REMOVED]"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Tried at the first digit of a run alone, and never retried within it, so that long runs of digits
# take linear time; the matches are those of the plain pattern.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(TERM)
_ASCII_LOWER = str.maketrans(UPPER, LOWER)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, longest runs before each sign that a domain follows: what the pattern matches."""
    done, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, sign + 1) if start < sign else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        sign = text.find("@", max(sign + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every kept match, by start, then kind."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(kind: int, value: str) -> str:
    """One name for one value, however it is written."""
    if KINDS[kind] == "email":
        value = value.translate(_ASCII_LOWER)
    elif KINDS[kind] != "ip":
        value = _digits(value)
    return f"{KINDS[kind]}:{value}"


def _free(spans: list[tuple[int, int, int]]):
    """A test whether a stretch overlaps no span. Spans of one kind do not overlap one another."""
    by_kind = [[s for s in spans if s[1] == k] for k in range(len(KINDS))]
    ends = [[b for _, _, b in of] for of in by_kind]

    def free(start: int, end: int) -> bool:
        for of, last in zip(by_kind, ends):
            i = bisect_left(last, start + 1)
            if i < len(of) and of[i][0] < end:
                return False
        return True

    return free


def neighbourhoods(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, list[str]]]:
    """(entity, terms near any of its places in reading order), of terms outside base spans."""
    if not spans:
        return []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, ends, free = [a for a, _ in words], [b for _, b in words], _free(spans)
    near: dict[str, set[int]] = {}
    for start, kind, end in spans:
        before, after = bisect_left(ends, start + 1), bisect_left(starts, end)
        places = near.setdefault(entity(kind, text[start:end]), set())
        places.update(range(max(0, before - WINDOW), before), range(after, min(len(words), after + WINDOW)))
    return [(c, [text[a:b].translate(_ASCII_LOWER) for a, b in (words[i] for i in sorted(places)) if free(a, b)])
            for c, places in near.items()]


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())]))
_NEAR = T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("terms", T.ArrayType(T.StringType()))]))
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_ARROW_NEAR = pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.string()))]))


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, near = [], []
        for text in batch.column("text"):
            text = text.as_py()
            found = base_spans(text)
            spans.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
            near.append([{"entity": c, "terms": t} for c, t in neighbourhoods(text, found)])
        kept = [batch.column(c) for c in ("key", "doc_id")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(spans, _ARROW_SPAN), pa.array(near, _ARROW_NEAR)], ["key", "doc_id", "base", "near"])


def profiled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id, base, near), one row per row of `docs`; written. No text leaves the scan."""
    shipped(docs.sparkSession)
    read = docs.select(key_of(doc_id, text).alias("key"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([read.schema["key"], read.schema["doc_id"], T.StructField("base", _SPAN), T.StructField("near", _NEAR)])
    return written(read.mapInArrow(_profiled, schema), "personal-data")


def _told(near: Column, n: Column, share: Column) -> Column:
    """Share of an entity's information that a term tells: PMI / IC."""
    return F.log2(F.least(near / n, F.lit(1.0)) / share) / -F.log2(share)


def _stem(term: Column) -> Column:
    return F.substring(term, 1, STEM)


def _words(text: str) -> list[str]:
    """The terms of a text. Bytes are lower-cased in ASCII alone."""
    return _WORD.findall(text.encode().lower().decode())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n: Counter[str] = Counter()
        for text in batch.column("text"):
            n.update(_words(text.as_py()))
        n[""] = n.total()
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["term", "n"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = pa.array([list(set(_words(text.as_py()))) for text in batch.column("text")], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), held], ["key", "terms"])


def _narrowed(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """`rows` whose `column` has the hash code of a value in `wanted`: all partners and few others, so
    that the join after it moves little, whichever join Spark picks for the size of `wanted`."""
    name, code = fresh(rows, "_code"), F.pmod(F.xxhash64(column), F.lit(CODES)).cast("int")
    codes = wanted.select(code.alias(name)).distinct()
    return rows.withColumn(name, code).join(F.broadcast(codes), name, "left_semi").drop(name)


def disclosing(docs: DataFrame, profile: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, replacement), the terms that disclose some entity, null where the term is removed; and
    (key, found): for each text that holds such terms, the list of these rows. Both written."""
    shipped(docs.sparkSession)
    contexts = profile.select(F.explode("near").alias("c")).select("c.entity", "c.terms")
    # A neighbourhood that repeats is summed first, and then counted once as a witness.
    seen = contexts.withColumn("context", F.xxhash64(F.array_join("terms", " "))).withColumn("term", F.explode("terms"))
    seen = seen.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("near"))
    joint = written(seen.groupBy("entity", "term").agg(F.sum("near").alias("near"), F.count(F.lit(1)).alias("witnesses")), "joint")
    asked = joint.filter(F.col("witnesses") >= CONTEXTS)
    # One scan counts: terms that are asked for by text, others of their stems, and, as the empty term, all.
    stems = asked.select(_stem(F.col("term")).alias("stem")).unionByName(docs.sparkSession.createDataFrame([("",)], "stem string"))
    stems = written(stems.distinct(), "stems")
    wanted = written(asked.select("term", F.lit(True).alias("asked")).distinct(), "asked-terms")
    # Each batch of texts counts its own words, so what is summed is far less than the words.
    read = docs.select(key_of(doc_id, text).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = read.select("text").mapInArrow(_counted, "term string, n long").withColumn("stem", _stem(F.col("term")))
    counts = written(
        every.join(stems, "stem", "left_semi").join(wanted, "term", "left")
        .groupBy(F.when(F.col("asked"), F.col("term")).alias("term"), "stem").agg(F.sum("n").alias("n")), "term-counts")
    total = counts.filter(F.col("stem") == "").agg(F.sum("n")).first()[0] or 0
    shares = contexts.groupBy("entity").agg((F.sum(F.size("terms")) / float(max(total, 1))).alias("share"))
    shares = written(shares.filter((F.col("share") > 0) & (F.col("share") < 1)), "shares")
    told = written(
        asked.join(counts, "term").join(shares, "entity")
        .withColumn("told", _told(F.col("near"), F.col("n"), F.col("share"))).filter(F.col("told") >= THRESHOLD)
        .select("entity", "term", "stem", "share"), "disclosing")
    # What all terms of a stem tell together about the entities that one of them discloses.
    by_stem = (
        joint.withColumn("stem", _stem(F.col("term"))).join(told.select("entity", "stem").distinct(), ["entity", "stem"])
        .groupBy("entity", "stem").agg(F.sum("near").alias("near")))
    stem_counts = counts.groupBy("stem").agg(F.sum("n").alias("n"))
    general = (
        told.join(by_stem, ["entity", "stem"]).join(stem_counts, "stem")
        .withColumn("vague", (F.length("term") > STEM) & (_told(F.col("near"), F.col("n"), F.col("share")) < THRESHOLD)))
    decided = general.groupBy("term", "stem").agg(F.min("vague").alias("vague"))
    decided = written(decided.select("term", F.when(F.col("vague"), F.concat("stem", F.lit("*"))).alias("replacement")), "decided")
    held = read.mapInArrow(_held, T.StructType([read.schema["key"], T.StructField("terms", T.ArrayType(T.StringType()))]))
    hits = _narrowed(held.select("key", F.explode("terms").alias("term")), "term", decided).join(decided, "term").groupBy("key").agg(
        F.collect_set(F.struct("term", "replacement")).alias("found"))
    return decided, written(hits, "hits")


def _term_places(text: str, spans: list[tuple[int, int, int]], wanted) -> list[tuple[int, int, str]]:
    """(start, end, term) of the wanted terms outside base spans."""
    free = _free(spans)
    at = ((m.start(), m.end(), m.group().translate(_ASCII_LOWER)) for m in _WORD.finditer(text))
    return [(a, b, t) for a, b, t in at if t in wanted and free(a, b)]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist()):
            places = _term_places(text, base_spans(text), {f["term"] for f in found})
            rows.append([{"start": a, "kind": len(KINDS), "end": b} for a, b, _ in places])
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(rows, _ARROW_SPAN)], ["key", "extra"])


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, extra): the spans of every row, as arrays of (start, kind, end) in reading order."""
    profile = profiled(docs, doc_id, text)
    _, hits = disclosing(docs, profile, doc_id, text)
    # Only texts that hold a disclosing term are read again, each once.
    texts = _narrowed(docs.select(key_of(doc_id, text).alias("key"), F.col(text).alias("text")), "key", hits)
    texts = texts.join(hits, "key").dropDuplicates(["key"])
    placed = texts.mapInArrow(_placed, T.StructType([T.StructField("key", T.LongType()), T.StructField("extra", _SPAN)]))
    return profile.join(written(placed, "term-spans"), "key", "left").select(
        "doc_id", "base", F.coalesce("extra", F.array().cast(_SPAN)).alias("extra"))


def _cleaned(text: str, found: list[dict]) -> str:
    spans = base_spans(text)
    instead = {f["term"]: f["replacement"] for f in found}
    parts = [(a, b, LABELS[KINDS[k]]) for a, k, b in spans]
    parts += [(a, b, instead[t] or REMOVED) for a, b, t in _term_places(text, spans, instead)]
    out, done = [], 0
    for start, end, label in sorted(parts):
        # Kinds may overlap: what an earlier span covers is gone already.
        if start >= done:
            out += [text[done:start], label]
        done = max(done, end)
    return "".join([*out, text[done:]])


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with personal data labelled, and disclosing terms generalised or removed, in `text`."""
    _, hits = disclosing(docs, profiled(docs, doc_id, text), doc_id, text)
    key, found = fresh(docs, "_key"), fresh(docs, "_found")
    joined = docs.withColumn(key, key_of(doc_id, text)).join(
        hits.withColumnRenamed("key", key).withColumnRenamed("found", found), key, "left").select(*docs.columns, found)

    names = docs.columns

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else _cleaned(t, f or [])
                     for t, f in zip(batch.column(text).to_pylist(), batch.column(found).to_pylist())]
            columns = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(rewritten, docs.schema)


def op12_disclosing_terms(spark, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])

    def listed(spans: Column) -> Column:
        in_order = F.array_sort(spans)
        return F.array_join(F.transform(in_order, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counted(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", *map(counted, range(len(KINDS))), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.concat("base", "extra")).alias("spans"))


_SQL_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _sql_matches(source: str, pattern: str, extra: str) -> str:
    """DuckDB: (r, m, a, b) of all matches, places by running lengths of matches and what lies between."""
    return f"""SELECT r, {extra}, m, (sum(length(p)) OVER w + sum(length(m)) OVER w - length(m))::BIGINT AS a, (sum(length(p)) OVER w + sum(length(m)) OVER w)::BIGINT AS b, i
    FROM (SELECT r, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(string_split_regex(text, '{pattern}')[:len(regexp_extract_all(text, '{pattern}'))]) AS p,
                 unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i FROM {source}) WINDOW w AS (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING)"""


_SQL_SUM = "list_sum(list_transform(range(1, length(g) + 1), lambda j: CASE WHEN (length(g) - j) % 2 = 0 THEN substr(g, j, 1)::INT WHEN substr(g, j, 1)::INT > 4 THEN substr(g, j, 1)::INT * 2 - 9 ELSE substr(g, j, 1)::INT * 2 END))"
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({" UNION ALL ".join(_sql_matches("docs", p, f"{k} AS k, '{kind}' AS kind") for k, (kind, p) in enumerate(_SQL_KINDS.items()))}),
base AS (
  SELECT r, k, kind, a, b, CASE k WHEN 0 THEN 'email:' || translate(m, '{UPPER}', '{LOWER}') WHEN 1 THEN 'ip:' || m ELSE kind || ':' || g END AS entity
  FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS g FROM matched)
  WHERE CASE k WHEN 0 THEN true
               WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0
               WHEN 2 THEN length(g) BETWEEN 14 AND 19 AND {_SQL_SUM} % 10 = 0 ELSE length(g) BETWEEN 10 AND 15 END),
words AS (SELECT r, translate(m, '{UPPER}', '{LOWER}') AS term, a, b, i FROM ({_sql_matches("docs", TERM, "0 AS k")})),
free AS (SELECT * FROM words w WHERE NOT EXISTS (SELECT 1 FROM base s WHERE s.r = w.r AND s.a < w.b AND w.a < s.b)),
edges AS (
  SELECT s.r, s.a, s.entity, (SELECT count(*) FROM words w WHERE w.r = s.r AND w.b <= s.a) AS before, (SELECT count(*) FROM words w WHERE w.r = s.r AND w.a < s.b) AS after FROM base s),
near AS (
  SELECT DISTINCT e.r, e.entity, w.i, w.term FROM edges e JOIN free w ON w.r = e.r
  AND (w.i BETWEEN e.before - {WINDOW} AND e.before - 1 OR w.i BETWEEN e.after AND e.after + {WINDOW - 1})),
contexts AS (SELECT r, entity, string_agg(term, ' ' ORDER BY i) AS context, count(*) AS size FROM near GROUP BY ALL),
total AS (SELECT count(*)::DOUBLE AS total FROM words),
shares AS (SELECT entity, sum(size) / any_value(total) AS share FROM contexts, total GROUP BY entity HAVING sum(size) / any_value(total) < 1),
joint AS (SELECT entity, term, count(*) AS near, count(DISTINCT context) AS witnesses FROM near JOIN contexts USING (r, entity) GROUP BY ALL),
counts AS (SELECT term, left(term, {STEM}) AS stem, count(*) AS n FROM words GROUP BY ALL),
told AS (
  SELECT entity, term, stem, share FROM joint JOIN counts USING (term) JOIN shares USING (entity)
  WHERE witnesses >= {CONTEXTS} AND log2(least(near / n, 1) / share) / -log2(share) >= {THRESHOLD}),
flagged AS (SELECT DISTINCT term FROM told),
extra AS (SELECT r, 4 AS k, 'term' AS kind, a, b FROM free JOIN flagged USING (term)),
listed AS (
  SELECT r, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
         string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 4) AS shown, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans
  FROM (SELECT r, k, kind, a, b FROM base UNION ALL SELECT r, k, kind, a, b FROM extra) GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(shown, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (r)
"""
