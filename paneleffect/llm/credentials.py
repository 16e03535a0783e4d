"""Secret scans by corpus-wide ownership frequency; column functions and joins only.

Candidates are found by shape: an assignment to a password-like name, an access key id, a long hexadecimal
number (the base kinds), and ``opaque``, a run of 16 or more letters, digits and ``+ / _ = -`` that holds a
letter and a digit and overlaps no base span. A candidate's value (what is assigned, else the whole) is
known by its SHA-256 from then on, and no table holds the value itself.

Over the whole corpus each value's distinct repositories and owners are counted. A value that more than
``owners`` owners have, or with a placeholder's word in it, is an ``example``: it was copied from
documentation. Of the others, those that look random, and those assigned to a password-like name
anywhere in the corpus, are ``live``; the rest are ``unclear``. An opaque candidate is reported if it is live, so a
credential that is assigned in one text is found where another text of its owner only mentions it.
Base candidates are reported whatever their verdict.

Counting takes three aggregates, of (value, owner, repository), (value, owner) and value, each combined
before its shuffle. Verdicts go back to the candidates by a join. A value with more than a thousandth
of all candidates is frequent; there are fewer than a thousand of them, and they are joined by a broadcast, so no
task of the other join has more than that share of one value.

Defined cases: null and empty texts have no candidate and an empty ``spans``. A null owner or repository is
one that has no name, the same for all. Rows that repeat an id are rows of their own, of one repository. Other
columns are ignored. No rows give no rows. Positions are code points. A text's matches are put in a list one by
one, so the time for one text grows with its length and with the square of its matches (a fraction of a second at 10,000).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneleffect.llm.common import needed, stage

# The names and shapes of the base kinds, in the order of the report.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN_TAIL = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

KINDS = ("assign", "access", "hex", "opaque")
PLACEHOLDER = "example|sample|dummy|placeholder|change_?me|your_?|xxxx|todo|abcdef|123456"


def _either_case(name: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)


ASSIGN = f"({'|'.join(map(_either_case, NAMES))}){ASSIGN_TAIL}"
# A run of hexadecimal digits, or of an access key's, is matched whole, so its least length may stand in the pattern.
PATTERNS = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]{%d,}" % (LEAST["access"] - 4),
    "hex": "[0-9a-f]{%d,}" % LEAST["hex"],
    "opaque": "[A-Za-z0-9+/_=-]{16,}",
}


@dataclass(frozen=True)
class Settings:
    owners: int = 2  # a value of more owners is an example
    random_length: int = 20
    random_digits: int = 3
    random_characters: int = 10
    frequent: int = 1000  # a value with more than one in so many candidates


_SPAN = "array<struct<start: bigint, kind: int, end: bigint, hash: string, shaped: boolean, placeholder: boolean>>"


def _looks_random(value: Column, s: Settings) -> Column:
    """Long, of both cases and digits well mixed, with many different characters."""
    mixed = F.rlike(value, F.lit("[a-z]")) & F.rlike(value, F.lit("[A-Z]")) & (F.regexp_count(value, F.lit("[0-9]")) >= s.random_digits)
    mixed = mixed & (F.regexp_count(value, F.lit("[A-Za-z][0-9]")) > 1)
    return (F.length(value) >= s.random_length) & mixed & (F.size(F.array_distinct(F.split(value, ""))) >= s.random_characters)


def _spans(text: Column, kind: str, s: Settings) -> Column:
    """The spans of a kind in order: what stands between the matches and the matches themselves, added up."""
    pattern = PATTERNS[kind]
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else whole
    matches = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), F.arrays_zip(whole.alias("whole"), value.alias("value")), lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["whole"]).alias("size"), m["value"].alias("value")))

    def add(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        span = F.struct(
            start.alias("start"),
            F.lit(KINDS.index(kind)).alias("kind"),
            (start + m["size"]).alias("end"),
            F.sha2(m["value"].cast("binary"), 256).alias("hash"),
            _looks_random(m["value"], s).alias("shaped"),
            F.rlike(F.lower(m["value"]), F.lit(PLACEHOLDER)).alias("placeholder"),
        )
        holds = F.length(m["value"]) >= LEAST["assign"] if kind == "assign" else F.lit(True)
        if kind == "opaque":
            holds = F.rlike(m["value"], F.lit("[0-9]")) & F.rlike(m["value"], F.lit("[A-Za-z]"))
        return F.struct((start + m["size"]).alias("at"), F.when(holds, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast(_SPAN)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))
    return F.when(F.rlike(text, F.lit(pattern)), F.aggregate(matches, start, add, lambda state: state["spans"])).otherwise(none)


def found(docs: DataFrame, owner: str = "source", repository: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """Stored: row (a number of its own), doc_id, owner, repository, and the spans of the base kinds and of
    opaque candidates, of every row."""
    columns = list(dict.fromkeys(["doc_id", "text", owner, repository]))
    rows = needed(docs, *columns)
    base = F.concat(*[_spans(F.col("text"), kind, s) for kind in KINDS[:-1]])
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.array_sort(base).alias("base"),
        _spans(F.col("text"), "opaque", s).alias("opaque"),
    )
    apart = F.filter("opaque", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return stage(rows.withColumn("opaque", apart), "secret-candidates")


def findings(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per candidate of ``found``: row, doc_id, kind, start, end, hash, and its value's owners,
    repositories, occurrences and verdict."""
    spans = rows.select("row", "doc_id", "owner", "repository", F.explode(F.concat("base", "opaque")).alias("s"))
    spans = spans.select("row", "doc_id", "owner", "repository", "s.*")
    named = F.max(F.col("kind") == KINDS.index("assign"))
    places = spans.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"), named.alias("named"), F.first("shaped").alias("shaped"), F.first("placeholder").alias("placeholder"))
    held = places.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"), F.max("named").alias("named"), F.first("shaped").alias("shaped"), F.first("placeholder").alias("placeholder"))
    counted = held.groupBy("hash").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("r").alias("repositories"), F.sum("n").alias("occurrences"), F.max("named").alias("named"), F.first("shaped").alias("shaped"), F.first("placeholder").alias("placeholder")
    )
    example = (F.col("owners") > s.owners) | F.col("placeholder")
    verdict = F.when(example, "example").when(F.col("named") | F.col("shaped"), "live").otherwise("unclear")
    known = stage(counted.select("hash", "owners", "repositories", "occurrences", verdict.alias("verdict")), "secret-values")
    total = known.agg(F.coalesce(F.sum("occurrences"), F.lit(0))).first()[0]
    frequent = known.where(F.col("occurrences") * s.frequent > total)
    names = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    spans = spans.select("row", "doc_id", names.alias("kind"), "start", "end", "hash")
    usual = spans.join(F.broadcast(frequent.select("hash")), "hash", "left_anti").join(known, "hash")
    return usual.unionByName(spans.join(F.broadcast(frequent), "hash"))


def _listed(spans: Column) -> Column:
    """kind:start:end of spans (start, kind, end), by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")


def digest(docs: DataFrame, owner: str = "source", repository: str = "doc_id", s: Settings = Settings()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (base ones and live opaque ones) of every row."""
    rows = found(docs, owner, repository, s)
    live = findings(rows, s).where((F.col("kind") == "opaque") & (F.col("verdict") == "live"))
    added = live.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(KINDS.index("opaque")).alias("kind"), "end")).alias("added"))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    out = rows.select("row", "doc_id", base.alias("base")).join(added, "row", "left")
    many = lambda kind: F.size(F.filter("base", lambda b: b["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id",
        *map(many, KINDS[:-1]),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", F.coalesce("added", none))).alias("spans"),
    )


def sql(s: Settings = Settings()) -> str:
    quoted = {kind: pattern.replace("'", "''") for kind, pattern in PATTERNS.items()}
    quoted |= {"access": ACCESS, "hex": HEX}
    kinds = []
    for k, kind in enumerate(KINDS):
        group = 2 if kind == "assign" else 0
        kinds.append(
            f"SELECT doc_id, source, {k} AS kind, STRING_SPLIT_REGEX(text, '{quoted[kind]}') AS gaps, "
            f"REGEXP_EXTRACT_ALL(text, '{quoted[kind]}', 0) AS whole, REGEXP_EXTRACT_ALL(text, '{quoted[kind]}', {group}) AS value FROM documents"
        )
    least = "".join(f" WHEN {KINDS.index(kind)} THEN LENGTH(value) >= {n}" for kind, n in LEAST.items())
    listed = "STRING_AGG(['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH matched AS (
  {" UNION ALL ".join(kinds)}
), walked AS (
  SELECT doc_id, source, kind, value, size, SUM(gap + size) OVER (PARTITION BY doc_id, kind ORDER BY k) AS stop FROM (
    SELECT doc_id, source, kind, k, LENGTH(gaps[k]) AS gap, LENGTH(whole[k]) AS size, value[k] AS value FROM (
      SELECT *, UNNEST(RANGE(1, LEN(whole) + 1)) AS k FROM matched))
), spans AS MATERIALIZED (
  SELECT doc_id, COALESCE(source, '') AS owner, kind, value, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM walked
  WHERE CASE kind{least} ELSE REGEXP_MATCHES(value, '[0-9]') AND REGEXP_MATCHES(value, '[A-Za-z]') END
), candidates AS MATERIALIZED (
  SELECT * FROM spans o WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = o.doc_id AND b.kind < 3 AND b.start < o.stop AND o.start < b.stop)
), known AS (
  SELECT value FROM candidates GROUP BY value
  HAVING COUNT(DISTINCT owner) <= {s.owners} AND NOT REGEXP_MATCHES(LOWER(value), '{PLACEHOLDER}') AND (BOOL_OR(kind = 0) OR (LENGTH(value) >= {s.random_length}
    AND REGEXP_MATCHES(value, '[a-z]') AND REGEXP_MATCHES(value, '[A-Z]') AND LEN(REGEXP_EXTRACT_ALL(value, '[0-9]')) >= {s.random_digits}
    AND LEN(REGEXP_EXTRACT_ALL(value, '[A-Za-z][0-9]')) > 1 AND LEN(LIST_DISTINCT(STRING_SPLIT(value, ''))) >= {s.random_characters}))
), reported AS (
  SELECT * FROM candidates WHERE kind < 3 UNION ALL SELECT candidates.* FROM candidates JOIN known USING (value) WHERE kind = 3
), base AS (
  SELECT doc_id, COUNT(*) FILTER (kind = 0) AS a, COUNT(*) FILTER (kind = 1) AS c, COUNT(*) FILTER (kind = 2) AS h, {listed} AS l FROM reported WHERE kind < 3 GROUP BY doc_id
), every AS (
  SELECT doc_id, {listed} AS l FROM reported GROUP BY doc_id
)
SELECT d.doc_id, COALESCE(a, 0)::BIGINT AS n_assign, COALESCE(c, 0)::BIGINT AS n_access, COALESCE(h, 0)::BIGINT AS n_hex,
  SHA256(COALESCE(base.l, '')) AS base_sha256, COALESCE(every.l, '') AS spans
FROM documents d LEFT JOIN base ON d.doc_id = base.doc_id LEFT JOIN every ON d.doc_id = every.doc_id
"""
