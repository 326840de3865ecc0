"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns give candidate spans; each candidate's value is hashed where it is found, so no value in plain
leaves its row, and the distinct repositories and owners that hold a hash are counted over the whole corpus.
Values that many owners or very many repositories share are copied examples; values of few owners look
live. The ownership verdict labels every span and decides which of the looser `token` candidates become
spans; spans of the base patterns always stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


@dataclass(frozen=True)
class Kind:
    """find: pattern of a candidate; value: group with the secret; least: its shortest length;
    needs: patterns that the value must hold; base: kept whatever its owners."""

    name: str
    find: str
    value: int
    least: int
    needs: tuple[str, ...] = ()
    base: bool = True


KINDS = (
    Kind("assign", _ASSIGN, 2, 12),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 18),
    Kind("hex", r"[0-9a-f]{16,}", 0, 16),  # the long ones among all runs
    Kind("token", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", 0, 24, ("[A-Z]", "[a-z]", "[0-9]"), base=False),
)

#: A value held by more owners, or in more repositories, than this is a copied example.
MAX_OWNERS, MAX_REPOS = 2, 50
_CANDIDATE = "array<struct<kind:int,nth:int,gap:bigint,size:bigint,fits:boolean,hash:string>>"


def _found(text: Column, order: int, kind: Kind) -> Column:
    """Array of (kind, nth, gap, size, fits, hash) for all leftmost non-overlapping matches: the gaps
    between the matches, from which the starts are summed later, come from splitting by the pattern."""
    pieces = F.arrays_zip(
        F.split(text, kind.find, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(kind.find), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(kind.find), F.lit(kind.value)).alias("value"),
    )

    def row(x: Column, i: Column) -> Column:
        fits = F.length(x["value"]) >= kind.least
        for need in kind.needs:
            fits = fits & x["value"].rlike(need)
        return F.struct(
            F.lit(order).alias("kind"), i.alias("nth"), F.length(x["gap"]).cast("long").alias("gap"), F.length(x["found"]).cast("long").alias("size"),
            fits.alias("fits"), F.when(fits, F.sha2(x["value"].cast("binary"), 256)).alias("hash"),
        )

    return F.when(text.rlike(kind.find), F.filter(F.transform(pieces, row), lambda x: x["fits"].isNotNull()))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """(rid, id, owner, repo, kind, start, end, hash), one row per candidate and one with a null kind for
    each document without any. Offsets are code points. Written to the shared folder."""
    own = {"id": id_col, "owner": owner_col, "repo": repo_col, "text": text_col}
    base = docs.select(F.monotonically_increasing_id().alias("rid"), *[F.col(common.quoted(c)).alias(n) for n, c in own.items()])
    all_kinds = F.concat(*[F.coalesce(_found(F.col("text"), k, kind), F.lit([]).cast(_CANDIDATE)) for k, kind in enumerate(KINDS)])
    rows = base.select("rid", "id", "owner", "repo", F.explode_outer(all_kinds).alias("x")).select("rid", "id", "owner", "repo", "x.*")
    so_far = Window.partitionBy("rid", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    return common.materialize(ends.select("rid", "id", "owner", "repo", *[F.when(F.col("fits"), F.col(c)).alias(c) for c in ("kind", "start", "end", "hash")]))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n, n_repos, n_owners): rows and exact distinct counts per hash. Counted in steps that combine
    on the map side, so a value in a third of all rows is no hot task."""
    held = found.where("hash is not null")
    by_repo = held.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.sum("n").alias("n"))
    owners = by_owner.groupBy("hash").agg(F.sum("n").alias("n"), F.count("*").alias("n_owners"))
    repos = by_repo.groupBy("hash", "repo").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_repos"))
    return owners.join(repos.hint("merge"), "hash")


def _with_counts(found: DataFrame) -> DataFrame:
    """Candidates with n_owners and n_repos of their hash, whatever share of the rows one hash holds."""
    return common.join_counted(found.where("kind is not null"), common.materialize(ownership(found)), "hash", "n")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per document: id and spans, an array of (start, kind, end, hash, n_owners, n_repos, live)
    sorted by start, then kind as listed in KINDS.

    Null and empty texts have no spans; repeated rows are scanned and returned each; a null owner
    counts as one owner of its own, and a null repository as one; other columns are ignored; an empty table gives no rows.
    """
    found = candidates(docs, id_col, text_col, owner_col, repo_col)
    with_counts = _with_counts(found)
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    base = F.lit(False)
    for k, kind in enumerate(KINDS):
        base = base | (F.lit(kind.base) & (F.col("kind") == k))
    span = F.when(base | live, F.struct("start", "kind", "end", "hash", "n_owners", "n_repos", live.alias("live")))
    spans = with_counts.select("rid", "id", span.alias("span"))
    rest = found.where("kind is null").select("rid", "id", F.lit(None).cast(spans.schema["span"].dataType).alias("span"))
    return spans.union(rest).groupBy("rid").agg(F.first("id").alias("id"), F.sort_array(F.collect_list("span")).alias("spans")).drop("rid")


def redact(text: Column, spans: Column) -> Column:
    """The text with each live span replaced by [SECRET]; overlapping spans are replaced once."""
    step = F.aggregate(
        F.filter(spans, lambda s: s["live"]),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("[SECRET]"))).alias("out"))
        ),
    )
    return F.when(F.exists(spans, lambda s: s["live"]), F.concat(F.array_join(step["out"], ""), F.substring(text, (step["at"] + 1).cast("int"), F.length(text)))).otherwise(text)


def redact_live(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """docs with its own columns, whatever their names, and all its rows, live secrets cut out of text; n_chars, where docs has
    it, is the new length of changed texts. Rows are found again by doc_id and the text's hash, never by position.
    Null and empty texts stay as they are; repeated rows are cut alike; an empty table gives no rows."""
    key, doc, text_hash, hash_, spans = (common.unused(docs, n) for n in ("row_key", "span_doc", "span_text_hash", "text_hash", "live_spans"))
    keyed = docs.withColumn(key, F.struct("doc_id", F.xxhash64("text").alias("h")))
    live = scan(keyed, key, "text", owner_col, repo_col, max_owners, max_repos).where(F.exists("spans", lambda s: s["live"]))
    live = live.select(F.col("id.doc_id").alias(doc), F.col("id.h").alias(text_hash), F.col("spans").alias(spans)).dropDuplicates([doc, text_hash])
    # live secrets grow with the data: always a merge join
    both = docs.withColumn(hash_, F.xxhash64("text")).join(live.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(hash_) == F.col(text_hash)), "left")
    new = F.when(F.col(spans).isNotNull(), redact(F.col("text"), F.col(spans)))
    changed = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(spans).isNotNull(), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return both.select(*[changed.get(c, F.col(common.quoted(c))).alias(c) for c in docs.columns])


def _names(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), kind + 1)


def _of_kind(k: int):
    return lambda s: s["kind"] == k  # a second parameter would be taken for the index


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _names(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are sources, repositories are documents. Nulls, empty texts, ties and repeated rows as in scan."""
    spans = scan(common.table(spark, sf_dir, "documents"))
    n_base = sum(k.base for k in KINDS)
    count = lambda f: F.size(F.filter("spans", f)).cast("long")
    return spans.select(
        F.col("id").alias("doc_id"),
        *[count(_of_kind(k)).alias(f"n_{KINDS[k].name}") for k in range(n_base)],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < n_base)).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_example"),
    )


def _sql() -> str:
    each = "\nUNION ALL\n".join(
        f"""SELECT rid, {k} AS kind, unnest(string_split_regex(text, r)) AS gap, unnest(regexp_extract_all(text, r)) AS found,
       unnest(regexp_extract_all(text, r, {kind.value})) AS value, generate_subscripts(string_split_regex(text, r), 1) AS nth
FROM d, (SELECT '{kind.find.replace("'", "''") if kind.base else "[A-Za-z0-9+/_-]+"}' AS r)"""
        for k, kind in enumerate(KINDS)
    )
    fits = " OR ".join("(" + " AND ".join([f"kind = {k}", f"length(value) >= {kind.least}", *[f"regexp_matches(value, '{n}')" for n in kind.needs]]) + ")" for k, kind in enumerate(KINDS))
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{kind.name}'" for k, kind in enumerate(KINDS)) + " END || ':' || s || ':' || e"
    n_base = sum(k.base for k in KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
m AS ({each}),
p AS (SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY rid, kind ORDER BY nth) AS e FROM m WHERE found IS NOT NULL),
q AS (SELECT rid, kind, value, (e - length(found))::BIGINT AS s, e::BIGINT AS e FROM p WHERE {fits}),
o AS (SELECT value, count(DISTINCT source) + max((source IS NULL)::INT) AS n_owners, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS n_repos
      FROM q JOIN d USING (rid) GROUP BY value),
y AS (SELECT *, n_owners <= {MAX_OWNERS} AND n_repos <= {MAX_REPOS} AS live FROM q JOIN o USING (value)),
z AS (SELECT rid, kind, s, e, live, {name} AS span FROM y WHERE kind < {n_base} OR live),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{KINDS[k].name}" for k in range(n_base))},
       coalesce(string_agg(span, ',' ORDER BY s, kind) FILTER (kind < {n_base}), '') AS base,
       string_agg(span, ',' ORDER BY s, kind) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
      FROM z GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{KINDS[k].name}, 0)::BIGINT AS n_{KINDS[k].name}" for k in range(n_base))},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN g USING (rid)"""


ORACLE_SQL = _sql()
