"""Secret scans by corpus-wide ownership frequency.

Patterns find the places that look like credentials; only a hash of the value leaves the scan. For every hash the
distinct repositories and owners are counted over the whole corpus. A value that many owners hold is a copied example;
a varied value of few owners looks live. Live values are also found where no pattern names them: a bare token becomes a
span if its hash is live and either a pattern names the same value elsewhere, or the token alone is long and varied.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdancy.llm.salted import beside
from verdancy.llm.storage import frugal, parts, small_batches, stored

KINDS = ("assign", "access", "hex", "owned")
WIDE_OWNERS = 5  # so many owners hold a copied example
LIVE_CHARS, LIVE_VARIETY = 16, 8  # length and distinct characters of a value that looks live
BARE_CHARS, ALONE_CHARS = 12, 20  # length of a bare token, and of one that needs no other evidence
_EDGE = "+/_.=-"
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_BARE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % BARE_CHARS)
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
PLACES = "array<struct<kind:string,start:long,end:long,hash:string,looks_live:boolean,alone:boolean>>"


def looks_live(value: str) -> bool:
    """Whether a value is long and varied and holds a letter and a digit."""
    return len(value) >= LIVE_CHARS and len(set(value)) >= LIVE_VARIETY and bool(_DIGIT.search(value)) and bool(_LETTER.search(value))


def places(text: str) -> list[dict]:
    """Candidates of a text: matches of the patterns and the bare tokens outside them, each with the hash of its value (without marks at its ends)."""
    found = []

    def add(kind: str, start: int, end: int, value: str, alone: bool = False) -> None:
        found.append({"kind": kind, "start": start, "end": end, "hash": hashlib.sha256(value.encode()).hexdigest(), "looks_live": looks_live(value), "alone": alone})

    low = text.lower()
    if any(name in low for name in _NAMES):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                add("assign", m.start(), m.end(), m[2].strip(_EDGE))
    for m in _ACCESS.finditer(text):
        add("access", m.start(), m.end(), m[0])
    for m in _HEX.finditer(text):
        add("hex", m.start(), m.end(), m[0])
    named = sorted((p["start"], p["end"]) for p in found)
    at = reached = 0
    for m in _BARE.finditer(text):
        value = m[0].strip(_EDGE)
        if len(value) < BARE_CHARS or not _DIGIT.search(value) or not _LETTER.search(value):
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip(_EDGE))
        end = start + len(value)
        while at < len(named) and named[at][0] < end:
            reached, at = max(reached, named[at][1]), at + 1
        if reached <= start:
            add("owned", start, end, value, len(value) >= ALONE_CHARS and "." not in value and "/" not in value)
    return found


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repositories, places, named (places that a pattern names) over the whole corpus.

    found has hash, owner, repository and kind. Equal rows are counted before each shuffle, and a hash's owners meet
    as counts only. Rows without an owner or a repository count as one of their own.
    """
    named = F.sum((F.col("kind") != "owned").cast("long"))
    held = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("places"), named.alias("named"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("places").alias("places"), F.sum("named").alias("named"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("places").alias("places"), F.sum("named").alias("named"))


def secrets(docs: DataFrame, owner: str = "source", repository: Sequence[str] = ("source", "lang"), wide: int = WIDE_OWNERS) -> DataFrame:
    """One row per row of docs: doc_id and spans, an array of (start, kind, end, owners, repositories, verdict) by start, then kind as in KINDS.

    verdict is `copied` for values of `wide` owners or more, else `live` if the value looks so, else `weak`. Matches of
    the patterns stay whatever the verdict; spans of kind `owned` are bare tokens that are live. A null or empty text
    has none; very long texts are scanned whole; repeated rows count as places of one repository and are judged each;
    an empty table gives an empty result; extra columns are ignored.
    """

    @frugal
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string()), ("looks_live", pa.bool_()), ("alone", pa.bool_())])
        for batch in parts(batches):
            found = [places(text or "") for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(found, pa.list_(place))], ["doc_id", "owner", "repository", "found"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.struct(*(F.col(c).cast("string") for c in repository)).alias("repository"), "text")
    kind = "struct<" + ",".join(f"{c}:string" for c in repository) + ">"
    scanned = rows.mapInArrow(scan, f"doc_id long, owner string, repository {kind}, found {PLACES}")
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()))
    some = scanned.where(F.size("found") > 0)
    found = some.select("row", "owner", "repository", F.inline("found"))
    told = stored(ownership(found))
    verdict = F.when(F.col("owners") >= wide, "copied").when(F.col("looks_live"), "live").otherwise("weak")
    judged = beside(found, "hash", "row", told, found.count()).withColumn("verdict", verdict)
    kept = judged.where((F.col("kind") != "owned") | ((F.col("verdict") == "live") & (F.col("alone") | (F.col("named") > 0))))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", order.alias("order"), "kind", "end", "owners", "repositories", "verdict")
    spans = kept.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # the places of one text
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    with_spans = some.select("row", "doc_id").join(spans, "row", "left").select("doc_id", "spans")
    every = with_spans.union(scanned.where(F.size("found") == 0).select("doc_id", none.alias("spans")))
    return every.select("doc_id", F.expr("transform(coalesce(spans, array()), s -> struct(s.start, s.kind, s.end, s.owners, s.repositories, s.verdict))").alias("spans"))


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; a source is an owner, its documents of one language are a repository."""
    found = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def told(where: str) -> Column:
        return F.expr(f"array_join(transform(filter(spans, s -> {where}), s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")

    def n(where: str) -> Column:
        return F.expr(f"size(filter(spans, s -> {where}))").cast("long")

    return found.select(
        "doc_id",
        *(n(f"s.kind = '{k}'").alias(f"n_{k}") for k in KINDS),
        F.sha2(told("s.kind <> 'owned'"), 256).alias("base_sha256"),
        told("true").alias("spans"),
        n("s.verdict = 'live'").alias("n_live"),
        n("s.verdict = 'copied'").alias("n_copied"),
    )


_SQL_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
OP13_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id::BIGINT AS doc_id, source, lang, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT rid, 'assign' AS kind, unnest(regexp_extract_all(text, '(?s){_SQL_ASSIGN}|[^pPsStTaA]+|.')) AS t, unnest(range(length(text))) AS k FROM docs
  UNION ALL SELECT rid, 'access', unnest(regexp_extract_all(text, '(?s)AKIA[A-Z0-9]+|[^A]+|A')), unnest(range(length(text))) FROM docs
  UNION ALL SELECT rid, 'hex', unnest(regexp_extract_all(text, '(?s)[0-9a-f]+|[^0-9a-f]+')), unnest(range(length(text))) FROM docs
  UNION ALL SELECT rid, 'bare', unnest(regexp_extract_all(text, '(?s)[A-Za-z0-9+/_.=-]+|[^A-Za-z0-9+/_.=-]+')), unnest(range(length(text))) FROM docs
), placed AS (
  SELECT rid, kind, t, (sum(length(t)) OVER (PARTITION BY rid, kind ORDER BY k) - length(t))::BIGINT AS start FROM cut WHERE t IS NOT NULL
), base AS (
  SELECT rid, kind, start, start + length(t) AS "end",
    CASE WHEN kind = 'assign' THEN trim(regexp_extract(t, '{_SQL_ASSIGN}', 1), '+/_.=-') ELSE t END AS value
  FROM placed
  WHERE kind = 'assign' AND regexp_full_match(t, '{_SQL_ASSIGN}') AND length(regexp_extract(t, '{_SQL_ASSIGN}', 1)) >= 6
    OR kind = 'access' AND t[1:4] = 'AKIA' AND length(t) >= 20 OR kind = 'hex' AND length(t) >= 24 AND regexp_full_match(t, '[0-9a-f]+')
), trimmed AS (
  SELECT rid, start + length(t) - length(ltrim(t, '+/_.=-')) AS start, trim(t, '+/_.=-') AS value FROM placed WHERE kind = 'bare' AND regexp_full_match(t, '[A-Za-z0-9+/_.=-]+') AND length(t) >= {BARE_CHARS}
), bare AS (
  SELECT rid, 'owned' AS kind, start, start + length(value) AS "end", value FROM trimmed b
  WHERE length(value) >= {BARE_CHARS} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.rid = b.rid AND base.start < b.start + length(b.value) AND base."end" > b.start)
), found AS (
  SELECT f.*, source, lang FROM (SELECT * FROM base UNION ALL SELECT * FROM bare) f JOIN docs USING (rid)
), held AS (
  SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners, count(*) FILTER (kind <> 'owned') AS named FROM found GROUP BY value
), judged AS (
  SELECT rid, kind, start, "end", named, length(value) >= {ALONE_CHARS} AND NOT contains(value, '.') AND NOT contains(value, '/') AS alone,
    CASE WHEN owners >= {WIDE_OWNERS} THEN 'copied'
      WHEN length(value) >= {LIVE_CHARS} AND len(list_distinct(string_split(value, ''))) >= {LIVE_VARIETY} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') THEN 'live' ELSE 'weak' END AS verdict
  FROM found JOIN held USING (value)
), told AS (
  SELECT *, list_position(['assign', 'access', 'hex', 'owned'], kind) AS o, kind || ':' || start || ':' || "end" AS line FROM judged WHERE kind <> 'owned' OR verdict = 'live' AND (alone OR named > 0)
), summed AS (
  SELECT rid, count(*) FILTER (o = 1) AS a, count(*) FILTER (o = 2) AS b, count(*) FILTER (o = 3) AS c, count(*) FILTER (o = 4) AS d,
    string_agg(line, ',' ORDER BY start, o) FILTER (o < 4) AS base, string_agg(line, ',' ORDER BY start, o) AS spans,
    count(*) FILTER (verdict = 'live') AS live, count(*) FILTER (verdict = 'copied') AS copied
  FROM told GROUP BY rid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, coalesce(d, 0) AS n_owned, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(live, 0) AS n_live, coalesce(copied, 0) AS n_copied
FROM docs LEFT JOIN summed USING (rid)
"""
