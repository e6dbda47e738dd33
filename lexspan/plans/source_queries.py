"""Registered queries: readers, writers and catalog facts. Writers are read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lexspan.operators import pool as Q, saves as V, vocab_audit as U
from lexspan.plans import audit_queries as AQ, frames as P, oracle_parts as O, pool_queries as PQ
from lexspan.plans.fixtures import RAW, table
from lexspan.plans.registry import query
from lexspan.sources import lexicon as X, stores as T, tables as R
from lexspan.streaming.jobs import scratch


@query("a1_vocabulary_words", "SELECT word FROM {vocab}")
def a1(spark, d):
    return table(spark, d, "vocab").select("word")


@query("a2_table_scans", "SELECT id, user_id, word_id, action FROM {saves}")
def a2(spark, d):
    return table(spark, d, "saves").select("id", "user_id", "word_id", "action")


def _rows(spark, d):
    from lexspan.operators.evalset import assemble

    return assemble(AQ.authored(spark, d), AQ.tripwire(spark, d))


@query("a3_read_set", "SELECT id, target, token_count, zipf FROM {authored} UNION ALL SELECT id, target, token_count, zipf FROM {tripwire}")
def a3(spark, d):
    path = scratch(spark)
    R.write_set(_rows(spark, d), path)
    return R.read_set(spark, path).select("id", "target", "token_count", "zipf")


_FIELDS = """SELECT id, query, target, 'authored' AS source, sense_hint, zipf, token_count, style, lexical_overlap, reachable, acceptable, CAST(NULL AS VARCHAR) AS leakage
 FROM (SELECT a.*, e.sense_hint FROM {authored} a JOIN (SELECT sense_hint, row_number() OVER (ORDER BY qvec_id) AS n FROM {eval_core}) e ON e.n = CAST(substr(a.id, 10) AS INT))
 UNION ALL SELECT id, query, target, 'gloss_tripwire', NULL, zipf, token_count, NULL, NULL, true, [], 'paraphrase' FROM {tripwire}"""


@query("a4_set_fingerprint", """SELECT sha256(string_agg(piece, '' ORDER BY block)) AS sha256, CAST(sum(n) AS BIGINT) AS rows FROM (
 SELECT pos // 4096 AS block, count(*) AS n, sha256(string_agg(text || chr(0), '' ORDER BY pos)) AS piece FROM (
 SELECT row_number() OVER (ORDER BY id) - 1 AS pos, concat_ws(chr(31), id, query, target, source, coalesce(sense_hint, '-'), coalesce(format('{:,.6f}', zipf), '-'),
  token_count, coalesce(style, '-'), coalesce(lexical_overlap, '-'), CASE WHEN reachable THEN 'true' ELSE 'false' END,
  array_to_string(acceptable, ','), coalesce(leakage, '-')) AS text FROM {fields}) GROUP BY pos // 4096)""", {"fields": _FIELDS})
def a4(spark, d):
    path = scratch(spark)
    R.write_set(_rows(spark, d), path)
    return R.set_digest(spark, path)


def _draft_lines(spark, d):
    """A reviewed file: comments, a header, rows cut short after the style; no line breaks in a cell."""
    rows = AQ.draft_table(spark, d)
    line = F.concat_ws("\t", F.concat(F.lit(" "), "target"), F.regexp_replace("query", "[\n\r\t]", " "), "sense_hint", F.when(F.col("position") % 2 == 0, F.col("style")))
    body = rows.select((F.col("position") * 2 + 10).alias("position"), line.alias("line"))
    notes = rows.select((F.col("position") * 2 + 11).alias("position"),
                        F.when(F.col("position") % 3 == 0, F.lit('"# note')).when(F.col("position") % 3 == 1, F.lit("# note")).otherwise("").alias("line"))
    head = spark.createDataFrame([(0, '"# reviewed"'), (1, ""), (2, "target\tquery\tsense_hint\tstyle")], "position long, line string")
    return head.unionByName(body).unionByName(notes)


# Three lines come before the rows, and every row is followed by a note or a blank line.
@query("a5_read_draft", """SELECT 3 + 2 * (row_number() OVER (ORDER BY qvec_id) - 1) AS position, target, trim(regexp_replace(query, '[\n\r\t]', ' ', 'g')) AS query, sense_hint,
 CASE WHEN qvec_id % 2 = 0 THEN style ELSE '' END AS style FROM {eval_core}""")
def a5(spark, d):
    path = scratch(spark)
    lines = _draft_lines(spark, d)
    lines.repartitionByRange(4, "position").sortWithinPartitions("position").select("line").write.text(path)
    return R.parse_draft(R.read_numbered_lines(spark, path)).select("position", "target", "query", "sense_hint", "style")


@query("a6_write_draft", "SELECT target, md5(query) AS query, coalesce(printf('%.3f', zipf), '') AS zipf, band AS freq_band, CASE WHEN reachable THEN 'true' ELSE 'false' END AS reachable FROM {annotated}")
def a6(spark, d):
    rows = AQ.annotated(spark, d).select(
        "target", "query", F.col("hint").alias("sense_hint"), "zipf", F.col("band").alias("freq_band"), F.col("tokens").alias("token_count"),
        "style", F.col("overlap").alias("lexical_overlap"), "reachable", F.lit("").alias("acceptable"))
    path = scratch(spark)
    # A draft is one record per line: line breaks inside a query become spaces.
    R.write_draft(rows.withColumn("query", F.regexp_replace("query", "[\n\t]", " ")), path)
    back = spark.read.csv(path, sep="\t", header=True, quote="", nullValue=None, emptyValue="")
    original = rows.select("target", F.md5("query").alias("query"), F.md5(F.regexp_replace("query", "[\n\t]", " ")).alias("_k")).distinct()
    keyed = back.withColumn("_k", F.md5("query")).drop("query")
    return keyed.join(original, ["target", "_k"]).select("target", "query", F.coalesce("zipf", F.lit("")).alias("zipf"), "freq_band", "reachable")


@query("a7_read_counts", "SELECT word, CAST(n AS DOUBLE) AS n FROM {freq}")
def a7(spark, d):
    lines = table(spark, d, "freq").select(F.concat_ws(" ", "word", F.col("n").cast("string")).alias("line"))
    broken = table(spark, d, "freq").select(F.explode(F.array(F.col("word"), F.concat(F.col("word"), F.lit(" many")))).alias("line"))
    return R.parse_counts(lines.unionByName(broken))


@query("a8_zipf_file", "SELECT word, zipf FROM {zipf}")
def a8(spark, d):
    path = scratch(spark)
    R.write_zipf(table(spark, d, "zipf"), path)
    return R.parse_zipf(spark.read.text(path).withColumnRenamed("value", "line"))


def _index_lines(spark, d):
    words = table(spark, d, "vocab").select(F.concat(F.replace("word", F.lit(" "), F.lit("_")), F.lit(" n 1 2 @ ~ 1 0 00001740")).alias("line"))
    licence = table(spark, d, "documents").select(F.concat(F.lit("  1 "), "source").alias("line"))
    return words.unionByName(licence)


@query("a9_index_lemmas", "SELECT word AS lemma FROM {vocab}")
def a9(spark, d):
    path = scratch(spark)
    X.write_lines(_index_lines(spark, d), path)
    return X.parse_index(X.read_lines(spark, path))


def _data_lines(spark, d):
    """Lexicon data lines of the derived synsets: head, bar, definition, quoted examples."""
    s = P.synsets(spark, d)
    words = F.transform("words", lambda w: F.concat(F.replace(w, F.lit(" "), F.lit("_")), F.lit(" 0")))
    head = F.concat_ws(" ", "offset", F.lit("03"), F.lit("n"), F.lpad(F.lower(F.hex(F.size("words"))), 2, "0"), F.array_join(words, " "), F.lit("000"))
    shown = F.transform("examples", lambda e: F.concat(F.lit('; "'), e, F.lit('"')))
    # The files are Latin-1.
    flat = F.regexp_replace(F.regexp_replace("gloss", "[\n\r]", " "), r"[^\x00-\xFF]", "?")
    return s.select("pos", F.concat(head, F.lit(" | "), flat, F.array_join(shown, ""), F.lit("; after")).alias("line"))


@query("a10_data_synsets", """SELECT s.pos, s.off AS "offset", md5(array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(s.gloss, '[\n\r]', ' ', 'g'), '[^\\x00-\\xFF]', '?', 'g')), ';'), lambda p: trim(p)), '; ') || CASE WHEN s.ex1 IS NULL AND s.ex2 IS NULL THEN '; after' ELSE '' END) AS gloss,
 concat_ws('|', s.ex1, s.ex2) AS examples, m.words FROM {synsets} s JOIN (SELECT sense_key, string_agg(word, '|' ORDER BY member_pos) AS words FROM {senses} GROUP BY sense_key) m ON m.sense_key = concat(s.pos, ':', s.off)""")
def a10(spark, d):
    path = scratch(spark)
    lines = _data_lines(spark, d)
    for pos in X.PARTS_OF_SPEECH:
        X.write_lines(lines.filter(F.col("pos") == pos), f"{path}/data.{pos}")
        X.write_lines(_index_lines(spark, d), f"{path}/index.{pos}")
    out = X.read_lexicon(spark, path)[1]
    return out.select("pos", "offset", F.md5("gloss").alias("gloss"), F.array_join("examples", "|").alias("examples"), F.array_join("words", "|").alias("words"))


def _cells(spark, d):
    v = P.vectors(spark, d).select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("cell"), "row", "word", "vec")
    meta = v.groupBy("cell").agg(F.count("*").alias("rows"), F.countDistinct("word").alias("distinct_words")).withColumn("dim", F.lit(64))
    return v, meta


@query("a11_cell_store", """SELECT concat('label', CAST(label AS VARCHAR)) AS cell, id AS row, word, count(*) OVER (PARTITION BY label) AS rows,
 count(*) OVER (PARTITION BY label) AS distinct_words FROM {vocab}""")
def a11(spark, d):
    path = scratch(spark)
    cells, meta = _cells(spark, d)
    T.write_cell(cells, meta, path)
    # Every cell is read back by name: the test data have ten.
    names = [r["cell"] for r in meta.select("cell").collect()]
    parts = [vectors.join(about, "cell") for vectors, about in (T.read_cell(spark, path, name) for name in names)]
    return reduce(DataFrame.unionByName, parts).select("cell", "row", "word", "rows", "distinct_words")


@query("a12_run_store", "SELECT tag, id, rank FROM {results} WHERE tag <> 'lemma'")
def a12(spark, d):
    results = P.saved_results(spark, d)
    runs = P.runs(spark, d, results).withColumn("ran_at", F.when(F.col("tag") != "lemma", F.col("ran_at")))
    path = scratch(spark)
    T.write_run(results.select("tag", "id", "rank"), runs, path)
    return T.read_runs(spark, path)[1].select("tag", "id", "rank")


@query("a13_pool_store", "SELECT p.word, p.row, p.is_target, count(g.word) AS senses FROM {pool} p JOIN {gloss_rows} g ON g.word = p.word GROUP BY p.word, p.row, p.is_target")
def a13(spark, d):
    path = scratch(spark)
    pool, glosses = PQ.pool_with_glosses(spark, d)
    T.write_pool(pool, glosses, Q.layout_check(pool), path)
    words = spark.read.parquet(f"{path}/words")
    counts = spark.read.parquet(f"{path}/glosses").groupBy("word").agg(F.count("*").alias("senses"))
    return words.join(counts, "word").select("word", "row", "is_target", "senses")


_SITE = "https://words.example"


@query("a14_sitemap", f"""SELECT '{_SITE}' AS url, 'daily' AS change_frequency, 1.0 AS priority, CAST(NULL AS BIGINT) AS modified
 UNION ALL SELECT concat('{_SITE}/word/', url_encode(word)), 'monthly', 0.8, 1704067200 + num * 60 FROM {{profiles}}""")
def a14(spark, d):
    p = table(spark, d, "profiles").withColumn("created_at", F.timestamp_seconds(F.lit(1704067200) + F.col("num") * 60))
    site = V.sitemap(p, f"{_SITE}/")
    modified = F.when(F.col("position") == 1, F.unix_timestamp("last_modified"))
    return site.select("url", "change_frequency", "priority", modified.alias("modified"))


def _raw(spark, d):
    return {name: table(spark, d, name) for name in RAW}


_LIST = ", ".join(f"'{t}'" for t in RAW)


@query("a15_columns", f"SELECT table_name, column_name, ordinal_position - 1 AS place, data_type = 'VARCHAR' AS is_text FROM information_schema.columns WHERE table_name IN ({_LIST}) AND table_schema = 'main'")
def a15(spark, d):
    return T.columns_of(spark, _raw(spark, d)).select("table_name", "column_name", "place", "is_text")


@query("a16_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {{{t}}}" for t in RAW))
def a16(spark, d):
    return T.row_counts(_raw(spark, d))


@query("a16_first_rows", "SELECT event_id, user_id, event_type, value FROM {events} ORDER BY event_id LIMIT 5")
def a16_rows(spark, d):
    return T.first_rows(table(spark, d, "events"), 5).select("event_id", "user_id", "event_type", "value")


@query("a17_answerable_view", f"SELECT id, word FROM {{vocab}} WHERE NOT {O.junk('word')}")
def a17(spark, d):
    U.answerable(table(spark, d, "vocab").select("id", "word", "embedding"), "answerable_vocab")
    return spark.table("answerable_vocab").select("id", "word")
