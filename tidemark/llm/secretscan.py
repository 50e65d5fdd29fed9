"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Base spans, leftmost and non-overlapping for each kind, in code points with exclusive ends:

* ``assign``: a credential name, a separator and a value of 6 or more characters;
* ``access``: ``AKIA`` and capitals or digits, 20 or more characters in all;
* ``hex``: a run of 24 or more lower-case hexadecimal digits.

A candidate is the SHA-256 of a span's value (for ``assign`` the value alone).  Over the whole corpus its distinct
repositories and owners are counted; a repository belongs to an owner.  A value with ``min_owners`` or more owners is a
widely copied ``example``; one of fewer owners that looks random (8 or more characters, 5 or more different ones) is
``live``; any other is ``weak``.  The verdict of a base span's value is an added span of that kind over the value; base
spans stay.

Null text counts as empty and has no spans.  A null repository or owner counts as one of its own.  Rows that repeat id
and text get equal results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm._base import materialise, text_or_empty

#: Fixed patterns: kind, pattern, group of the value, least length of that group.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Characters of a block of a text.
_BLOCK = 4096
NAMES = [*(k[0] for k in KINDS), "example", "live", "weak"]
PART = "array<struct<kind:int,gap:int,size:int,hash:string,value:int,random:boolean,good:boolean>>"


def _kind_parts(text: Column, kind: int) -> Column:
    """All matches of one kind with the lengths of the text before each: a match starts after the gaps and matches before it, which ``split`` and ``regexp_extract_all`` give."""
    _, pattern, group, least = KINDS[kind]
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    value = F.regexp_extract_all(text, p, F.lit(group)) if group else whole
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))

    def part(x: Column) -> Column:
        v = x["value"]
        return F.struct(
            F.lit(kind).alias("kind"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["whole"]).alias("size"),
            F.sha2(v, 256).alias("hash"),
            F.length(v).alias("value"),
            ((F.length(v) >= 8) & (F.size(F.array_distinct(F.split(v, ""))) >= 5)).alias("random"),
            (F.length(v) >= least).alias("good"),
        )

    return F.when(text.rlike(pattern), F.transform(parts, part)).otherwise(F.array().cast(PART))


def matches(text: Column) -> Column:
    """The matches of every kind, in order within a kind; no values, only their hashes, lengths and whether they look random."""
    return F.concat(*[_kind_parts(text, k) for k in range(len(KINDS))])


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners of ``found`` (hash, repo, owner): counted in three steps, each with map-side partial counts."""
    once = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("_")).drop("_")
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def _same(a: str, b: str) -> Column:
    """Equality of (id, text) between columns ``a`` and ``b`` prefixed so."""
    return F.col(f"{a}id").eqNullSafe(F.col(f"{b}id")) & (F.col(f"{a}sha") == F.col(f"{b}sha"))


def located(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", min_owners: int = 3) -> DataFrame:
    """id, sha, start, kind, end, hash, size, verdict, n_repos, n_owners: a row for each base span of each distinct (doc_id, text) of ``docs``.

    Offsets are running sums over a text's matches, so the work is in proportion to their number.
    """
    text = text_or_empty()
    owner = F.col(owner_col).cast("string") if owner_col in docs.columns else F.lit(None).cast("string")
    some = docs.select(F.col("doc_id").alias("id"), F.col(repo_col).cast("string").alias("repo"), owner.alias("owner"), F.sha2(text, 256).alias("sha"), matches(text).alias("parts"))
    some = materialise(some.where(F.size("parts") > 0), "matches")
    counts = ownership(some.select("repo", "owner", F.explode("parts").alias("p")).where("p.good").select("p.hash", "repo", "owner"))
    each = some.select("id", "sha", "parts").dropDuplicates(["id", "sha"]).select("id", "sha", F.posexplode("parts").alias("at", "p")).select("id", "sha", "at", "p.*")
    until = Window.partitionBy("id", "sha", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(until).cast("int"))
    placed = placed.where("good").select("id", "sha", (F.col("end") - F.col("size")).alias("start"), "kind", "end", "hash", F.col("value").alias("size"), "random")
    verdict = F.when(F.col("n_owners") >= min_owners, 3).when(F.col("random"), 4).otherwise(5)
    return materialise(placed.join(counts, "hash").withColumn("verdict", verdict).drop("random"), "located")


def scan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text_sha256, spans: array of (start, kind, end, hash, size, verdict, n_repos, n_owners) by start and kind, for each row of ``docs``."""
    fields = ("start", "kind", "end", "hash", "size", "verdict", "n_repos", "n_owners")
    lists = located(docs, **options).groupBy("id", "sha").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("found"))
    rows = docs.select(F.col("doc_id").alias("d_id"), F.sha2(text_or_empty(), 256).alias("d_sha"))
    joined = rows.join(lists, _same("d_", ""), "left")
    none = F.array().cast(lists.schema["found"].dataType)
    return joined.select(F.col("d_id").alias("doc_id"), F.col("d_sha").alias("text_sha256"), F.coalesce("found", none).alias("spans"))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of (start, kind, end) structs, comma-joined in their order."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example of :func:`scan`'s result."""
    def plain(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))

    def added(s: Column) -> Column:
        return F.struct((s["end"] - s["size"]).alias("start"), s["verdict"].alias("kind"), s["end"].alias("end"))

    base, new = F.transform("spans", plain), F.array_sort(F.transform("spans", added))
    found = found.withColumn("new", new)
    found = found.withColumn("once", F.filter("new", lambda x, i: (i == 0) | (x != F.get("new", i - 1))))
    count = lambda field, k: F.size(F.filter("spans", lambda s: s[field] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count("kind", k).alias(f"n_{name[0]}") for k, name in enumerate(KINDS)],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat(base, "once"))).alias("spans"),
        count("verdict", 4).alias("n_live"),
        count("verdict", 3).alias("n_example"),
    )


def redact(docs: DataFrame, mask: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every base span whose value is not a widely copied example replaced by ``mask``; all rows and columns stay.

    Overlapping spans are masked as one.  ``n_chars``, where there is such a column, is that of the new text.  Rows
    without a match are not shuffled.
    """
    hidden = located(docs, **options).where("verdict <> 3")
    # spans that overlap are one island: it begins where no earlier span reaches
    before = Window.partitionBy("id", "sha").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    begins = hidden.withColumn("far", F.max("end").over(before)).withColumn("new", F.col("far").isNull() | (F.col("start") >= F.col("far")))
    numbered = begins.withColumn("island", F.sum(F.col("new").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    islands = numbered.groupBy("id", "sha", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    lists = islands.groupBy("id", "sha").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("islands"))

    matched = reduce(lambda a, b: a | b, [text_or_empty().rlike(pattern) for _, pattern, _, _ in KINDS])
    rows = docs.where(matched).select(F.struct("*").alias("row"), F.col("doc_id").alias("d_id"), F.sha2(text_or_empty(), 256).alias("d_sha"))
    text = F.col("row.text")
    # a place in a long text is reached by counting characters from its beginning, one in a block of it at once
    joined = rows.join(lists, _same("d_", ""), "left").withColumn("blocks", F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0)))

    def piece(begin: Column, end: Column) -> Column:
        def of(b: Column) -> Column:
            low = F.greatest(begin, b * _BLOCK)
            return F.substring(F.get("blocks", b), low - b * _BLOCK + 1, F.least(end, (b + 1) * _BLOCK) - low)

        parts = F.transform(F.sequence(F.floor(begin / _BLOCK).cast("int"), F.floor((end - 1) / _BLOCK).cast("int")), of)
        return F.when(end > begin, F.array_join(parts, "")).otherwise("")

    def gap(x: Column, i: Column) -> Column:
        return piece(F.when(i == 0, 0).otherwise(F.get("islands", i - 1)["end"]), x["start"])

    tail = piece(F.element_at("islands", -1)["end"], F.length(text))
    clean = F.array_join(F.concat(F.transform("islands", gap), F.array(tail)), mask)
    new = F.when(F.col("islands").isNull(), text).otherwise(clean)
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("islands").isNull(), cols["n_chars"]).otherwise(F.length(new).cast(docs.schema["n_chars"].dataType))
    masked = joined.select(*[(new if c == "text" else v).alias(c) for c, v in cols.items()])
    return docs.where(~matched).unionByName(masked)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return report(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _oracle() -> str:
    """The same by DuckDB: pieces between matches give the offsets."""
    text = "coalesce(text, '')"
    each = []
    for k, (_, pattern, group, least) in enumerate(KINDS):
        p = "'" + pattern.replace("'", "''") + "'"
        each.append(f"SELECT doc_id, source, {k} AS kind, {least} AS least, regexp_extract_all({text}, {p}, 0) AS m, regexp_extract_all({text}, {p}, {group}) AS v, string_split_regex({text}, {p}) AS g FROM documents")
    name = "([" + ", ".join(f"'{n}'" for n in NAMES) + "])[kind + 1]"
    listed = f"string_agg({name} || ':' || a || ':' || z, ',' ORDER BY a, kind, z)"
    return f"""
WITH k AS ({" UNION ALL ".join(each)}),
u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
p AS (SELECT doc_id, source, kind, least, v[i] AS value, length(m[i]) AS n, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM u),
s AS (SELECT doc_id, source, kind, CAST(stop - n AS BIGINT) AS a, CAST(stop AS BIGINT) AS z, value FROM p WHERE length(value) >= least),
o AS (SELECT value, count(DISTINCT coalesce('s' || source, '')) AS owners FROM s GROUP BY value),
j AS (SELECT s.*, CASE WHEN owners >= 3 THEN 3 WHEN length(value) >= 8 AND len(list_distinct(string_split(value, ''))) >= 5 THEN 4 ELSE 5 END AS verdict FROM s JOIN o USING (value)),
base AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  count(*) FILTER (verdict = 4) AS n_live, count(*) FILTER (verdict = 3) AS n_example, {listed} AS b FROM j GROUP BY doc_id),
every AS (SELECT doc_id, a, kind, z FROM j UNION ALL (SELECT DISTINCT doc_id, z - length(value), verdict, z FROM j)),
x AS (SELECT doc_id, {listed} AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN base USING (doc_id) LEFT JOIN x USING (doc_id)
"""


ORACLE_SQL = _oracle()
