"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every whole text: the base kinds of the contract, and wider kinds
(vendor keys, tokens, private keys, address passwords, mixed opaque strings). The value of
each candidate is hashed, and the hashes are counted over the corpus by distinct repository
and distinct owner. A value that many owners or many repositories hold is a copied example; one
that belongs to few of both looks live. Base spans are always reported; a wider candidate only if it looks
live and overlaps no base span.

Only DataFrame functions are used. Regular expressions run once, into narrow rows that are
written; counting is a distinct and a partial aggregation, so that a value copied through a
third of all rows is reduced before any shuffle. Matches come from splitting on the pattern:
the lengths of the pieces and of the matches between them add up to positions.

Defined cases: a null text is empty; a null owner or repository counts as one owner or
repository; repeated rows give repeated results but do not raise the counts; a text without
candidates gets empty strings and zeros; an empty table gives no rows; further input columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexspan.llm.common import landed, query, table

# kind: (pattern, group that holds the value, least length of that group)
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # A greedy run that is too short holds no longer one, so the length can stand in the pattern.
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
WIDER = {
    "vendor": (r"(gh[pousr]_[A-Za-z0-9]{30,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{35})", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    "pem": (r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+-----END", 0, 1),
    "login": (r"[a-z]{2,12}://[^\x20\x09-\x0D:/@]{1,64}:([^\x20\x09-\x0D:/@]{4,128})@", 1, 4),
    # 24 or more characters; OPAQUE says what the whole run must hold.
    "opaque": (r"[A-Za-z0-9+/_=-]{24,}", 0, 24),
}
OPAQUE = ("[0-9]", "[A-Z]", "[a-z]")
KINDS = [*BASE, *WIDER]
MAX_OWNERS = 2
MAX_REPOS = 4


def _candidates(text: str, kind: str) -> Column:
    """Array of (start, order, kind, end, value) of the matches that hold."""
    pattern, group, least = {**BASE, **WIDER}[kind]
    whole, pieces = F.col(f"_m_{kind}"), F.split(F.col(text), pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("piece"), whole.alias("match"), value.alias("value"))
    empty = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        found = F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("order"), F.lit(kind).alias("kind"),
                         end.cast("long").alias("end"), x["value"].alias("value"))
        keep = F.length(x["value"]) >= least
        for needed in OPAQUE if kind == "opaque" else ():
            keep = keep & x["value"].rlike(needed)
        return F.struct(end.cast("long").alias("at"), F.when(keep, F.concat(acc["found"], F.array(found))).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("found"))
    return F.when(F.size(whole) > 0, F.aggregate(zipped, start, step)["found"]).otherwise(empty)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, owner, repo, base and wider candidates of rows doc_id, owner, repo, text."""
    rows = docs.select("doc_id", "owner", "repo", F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.select("*", *[F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_m_{k}")
                              for k, (p, _, _) in {**BASE, **WIDER}.items()])
    rows = rows.select("doc_id", "owner", "repo", *[_candidates("_text", k).alias(k) for k in KINDS])
    rows = rows.select("doc_id", "owner", "repo", F.array_sort(F.concat(*BASE)).alias("base"), F.concat(*WIDER).alias("more"))

    def meets(a: Column, b: Column) -> Column:
        return (b["start"] < a["end"]) & (a["start"] < b["end"])

    # A wider candidate gives way to base spans, and the least specific kind to all others.
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: meets(m, b)) & ~(
        (m["kind"] == "opaque") & F.exists("more", lambda b: (b["kind"] != "opaque") & meets(m, b))))
    hashed = [F.transform(c, lambda x: F.struct(x["start"], x["order"], x["kind"], x["end"], F.sha2(x["value"], 256).alias("hash")))
              for c in (F.col("base"), apart)]
    return rows.select("doc_id", "owner", "repo", hashed[0].alias("base"), hashed[1].alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repos: distinct owners and repositories of each candidate value."""
    held = found.select(F.explode(F.concat("base", "more")).alias("c"), "owner", "repo").select(
        F.col("c.hash").alias("hash"), F.struct("owner").alias("owner"), F.struct("owner", "repo").alias("repo"))
    # One row per value and repository first; the counts then combine before their shuffle.
    pairs = held.distinct()
    by_owner = pairs.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    by_repo = pairs.groupBy("hash").agg(F.count("*").alias("repos"))
    return by_repo.join(by_owner, "hash")


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Spans of every row: doc_id, base and all spans as arrays, n_live, n_copied, most_owners, most_repos."""
    found = landed(find(docs), "secrets")
    counts = ownership(found)
    # Rows with equal candidates share one verdict, so copies of a document are judged once.
    rows = found.withColumn("key", F.when(F.size("base") + F.size("more") > 0, F.sha2(F.to_json(F.struct("base", "more")), 256)))
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    judged = (
        rows.filter(F.col("key").isNotNull()).select("key", "base", "more").dropDuplicates(["key"])
        .select("key", F.explode(F.concat("base", "more")).alias("c"))
        .withColumn("hash", F.col("c.hash")).join(counts, "hash")
        .groupBy("key").agg(
            F.collect_list(F.when(live | F.col("c.kind").isin(*BASE),
                                  F.struct("c.start", "c.order", "c.kind", "c.end", "owners", "repos"))).alias("kept"),
            F.count(F.when(live, 1)).alias("live"), F.count(F.when(~live, 1)).alias("copied"),
            F.max("owners").alias("owners"), F.max("repos").alias("repos"))
    )
    # Rows without a candidate carry their own key, so that they spread over the join.
    spread = rows.withColumn("key", F.coalesce("key", F.concat(F.lit("-"), F.xxhash64("doc_id", "owner", "repo").cast("string"))))
    out = spread.join(judged, "key", "left")
    return out.select(
        "doc_id", "base", F.array_sort(F.coalesce("kept", F.array())).alias("spans"),
        F.coalesce("live", F.lit(0)).alias("n_live"), F.coalesce("copied", F.lit(0)).alias("n_copied"),
        F.coalesce("owners", F.lit(0)).alias("most_owners"), F.coalesce("repos", F.lit(0)).alias("most_repos"))


def digest(scanned: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *map(count, BASE), F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"),
                          _text_of(F.col("spans")).alias("spans"), "n_live", "n_copied", "most_owners", "most_repos")


def _sql() -> str:
    def either(word: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    # Letters in either case are spelt out: folding here would go beyond ASCII.
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + "|" + either("api") + "_?" + either("key")
    patterns = {k: p for k, (p, _, _) in {**BASE, **WIDER}.items()}
    patterns["assign"] = "(" + names + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    parts = []
    for i, kind in enumerate(KINDS):
        _, group, least = {**BASE, **WIDER}[kind]
        p = quoted(patterns[kind])
        parts.append(f"""
  SELECT rid, {i} AS o, '{kind}' AS kind, s AS "start", s + length(m[i]) AS "end", v[i] AS value FROM (
    SELECT rid, m, v, i, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)::BIGINT
        + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
      SELECT rid, string_split_regex(t, {p}) AS p, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v FROM docs)))
  WHERE length(v[i]) >= {least}""" + ("".join(f" AND regexp_matches(v[i], '{x}')" for x in OPAQUE) if kind == "opaque" else ""))
    base = ", ".join(f"'{k}'" for k in BASE)
    live = f"owners <= {MAX_OWNERS} AND repos <= {MAX_REPOS}"
    name = """kind || ':' || "start" || ':' || "end" """
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source AS owner, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
kept AS (
  SELECT f.*, d.owner, d.repo, f.kind IN ({base}) AS is_base FROM found f JOIN docs d USING (rid)
  WHERE f.kind IN ({base}) OR NOT EXISTS (SELECT 1 FROM found b WHERE b.rid = f.rid AND (b.kind IN ({base}) OR (f.kind = 'opaque' AND b.kind <> 'opaque'))
    AND b."start" < f."end" AND f."start" < b."end")),
owned AS (SELECT value, count(DISTINCT owner) + max((owner IS NULL)::INT) AS owners, count(DISTINCT {{'o': owner, 'r': repo}}) AS repos FROM kept GROUP BY value),
spans AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
    string_agg({name}, ',' ORDER BY "start", o) FILTER (is_base) AS base,
    string_agg({name}, ',' ORDER BY "start", o) FILTER (is_base OR {live}) AS spans,
    count(*) FILTER ({live}) AS n_live, count(*) FILTER (NOT ({live})) AS n_copied, max(owners) AS most_owners, max(repos) AS most_repos
  FROM kept JOIN owned USING (value) GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied,
  coalesce(most_owners, 0)::BIGINT AS most_owners, coalesce(most_repos, 0)::BIGINT AS most_repos
FROM docs LEFT JOIN spans USING (rid)
"""


@query("op1_secrets", _sql())
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document; its source is the owner, source and language the repository."""
    docs = table(spark, sf_dir, "documents")
    owned = docs.select("doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repo"))
    return digest(scan(owned))
