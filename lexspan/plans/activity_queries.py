"""Registered queries: credits, streaks, saves, limits, and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.operators import ledger as L, limits as M, saves as V
from lexspan.plans import frames as P, oracle_parts as O  # noqa: F401
from lexspan.plans.fixtures import table
from lexspan.plans.registry import SHARED, query
from lexspan.streaming import jobs as J

SHARED["settled"] = "SELECT user_id, ts, id, 'round' AS kind, CAST(win_amount - bet AS BIGINT) AS delta FROM {game_rounds} WHERE bet BETWEEN 10 AND 500"
SHARED["days"] = "SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS ts, arg_min(id, ts) AS id FROM {lookups} GROUP BY user_id, CAST(ts AS DATE)"
SHARED["daily"] = """SELECT user_id, day, ts, id, streak, 10 + least(5 * streak, 50) AS award FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY day) AS streak FROM (
 SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM {days}))"""
SHARED["transitions"] = """SELECT user_id, word_id, ts, id FROM (SELECT *, lag(action) OVER (PARTITION BY user_id, word_id ORDER BY ts, id) AS before FROM {saves}) WHERE action = 'save' AND (before IS NULL OR before <> 'save')"""
SHARED["ledger"] = """SELECT user_id, ts, id, kind, delta FROM {settled} UNION ALL SELECT user_id, ts, id, 'lookup', CAST(award AS BIGINT) FROM {daily}
 UNION ALL SELECT user_id, ts, id, 'save', 2 FROM {transitions} UNION ALL SELECT user_id, ts, id, 'share', 3 FROM {shares}
 UNION ALL SELECT user_id, ts, id, 'award', delta FROM {granted}"""
SHARED["granted"] = """SELECT id, user_id, ts, CAST(a AS BIGINT) AS delta FROM (SELECT *, TRY_CAST(amount AS DOUBLE) AS a FROM {awards}) WHERE a > 0 AND a <= 1e15 AND NOT isnan(a) AND a = floor(a)"""
SHARED["ordered"] = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id, kind) AS rn FROM {ledger}"
SHARED["folds"] = """SELECT user_id, list_transform(list(delta ORDER BY rn), lambda x: {'b': x, 'n': CAST(0 AS BIGINT)}) AS steps FROM {ordered} GROUP BY user_id"""
SHARED["credits"] = """SELECT u.user_id, coalesce(f.r.b, 100) AS credits, coalesce(f.r.n, 0) AS bankruptcies FROM (SELECT DISTINCT user_id FROM {events}) u LEFT JOIN (
 SELECT user_id, list_reduce(steps, lambda a, x: {'b': CASE WHEN a.b + x.b <= 0 THEN CAST(25 AS BIGINT) ELSE a.b + x.b END, 'n': a.n + CASE WHEN a.b + x.b <= 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END},
 {'b': CAST(100 AS BIGINT), 'n': CAST(0 AS BIGINT)}) AS r FROM {folds}) f ON f.user_id = u.user_id"""


def events(spark, d):
    return L.ledger_events(*[table(spark, d, t) for t in ("lookups", "saves", "shares", "game_rounds", "awards")])


def _users(spark, d):
    return table(spark, d, "events").select("user_id").distinct()


def credits(spark, d):
    awards = L.daily_awards(table(spark, d, "lookups"))
    return L.balances(L.settle(events(spark, d)), _users(spark, d), awards)


@query("i1_users", "SELECT DISTINCT user_id, 100 AS credits, 0 AS streak, 0 AS bankruptcies FROM {events}")
def i1(spark, d):
    none = spark.createDataFrame([], "user_id long, ts timestamp, id long, kind string, balance long, bankrupt boolean")
    return L.balances(none, _users(spark, d))


@query("i2_balances", """SELECT c.user_id, c.credits, c.bankruptcies, coalesce(s.streak, 0) AS streak FROM {credits} c LEFT JOIN (SELECT user_id, arg_max(streak, day) AS streak FROM {daily} GROUP BY user_id) s ON s.user_id = c.user_id""")
def i2(spark, d):
    return credits(spark, d)


@query("i3_awards", "SELECT id, user_id, delta FROM {granted}")
def i3(spark, d):
    return L.award_events(table(spark, d, "awards"))[0].select("id", "user_id", "delta")


@query("i3_rejected_awards", "SELECT id, amount, 'Invalid amount' AS error FROM {awards} WHERE id NOT IN (SELECT id FROM {granted})")
def i3_rejected(spark, d):
    return L.award_events(table(spark, d, "awards"))[1]


# The balance after every event; the recursion steps through each user's events in order.
@query("i4_settled_rounds", """SELECT user_id, id, kind, balance, bankrupt FROM {replay}""", {
    "replay": """SELECT o.user_id, o.rn, o.id, o.kind, CASE WHEN 100 + o.delta <= 0 THEN 25 ELSE 100 + o.delta END AS balance, 100 + o.delta <= 0 AS bankrupt FROM {ordered} o WHERE o.rn = 1
 UNION ALL SELECT o.user_id, o.rn, o.id, o.kind, CASE WHEN r.balance + o.delta <= 0 THEN 25 ELSE r.balance + o.delta END, r.balance + o.delta <= 0 FROM replay r JOIN {ordered} o ON o.user_id = r.user_id AND o.rn = r.rn + 1"""})
def i4(spark, d):
    return L.settle(events(spark, d)).select("user_id", "id", "kind", "balance", "bankrupt")


@query("i5_daily_awards", "SELECT user_id, strftime(day, '%Y-%m-%d') AS day, streak, award FROM {daily}")
def i5(spark, d):
    return L.daily_awards(table(spark, d, "lookups")).select("user_id", F.col("day").cast("string").alias("day"), "streak", "award")


@query("i6_save_awards", "SELECT user_id, word_id, id FROM {transitions}")
def i6(spark, d):
    return L.save_transitions(table(spark, d, "saves")).select("user_id", "word_id", "id")


@query("i7_share_awards", "SELECT user_id, count(*) * 3 AS earned FROM {shares} GROUP BY user_id")
def i7(spark, d):
    earned = L.fixed_awards(table(spark, d, "shares"), "share", L.SHARE_CREDITS)
    return earned.groupBy("user_id").agg(F.sum("delta").alias("earned"))


@query("i8_leaderboard", """SELECT row_number() OVER (ORDER BY credits DESC, user_id) AS rank, user_id, CASE user_id % 3 WHEN 0 THEN concat('user', user_id) WHEN 1 THEN concat('Name ', user_id) ELSE 'Anonymous' END AS name,
 credits, user_id = 8 AS is_you FROM {credits} ORDER BY credits DESC, user_id LIMIT 10""")
def i8(spark, d):
    who = F.col("user_id").cast("string")
    names = _users(spark, d).select(
        "user_id", F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("user"), who)).alias("username"),
        F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("Name "), who)).otherwise("").alias("full_name"))
    return L.leaderboard(credits(spark, d), names, me=8)


@query("i9_random_words", "SELECT id, word FROM {profiles} ORDER BY md5(concat('7:', id)), id LIMIT 25")
def i9(spark, d):
    return V.random_words(table(spark, d, "profiles"), 25, "7:")


@query("i10_valid_bets", "SELECT id, CASE WHEN bet BETWEEN 10 AND 500 THEN bet END AS bet FROM {game_rounds}")
def i10(spark, d):
    return table(spark, d, "game_rounds").select("id", L.valid_bet(F.col("bet")).alias("bet"))


SHARED["keyed"] = """SELECT id, ts, CASE WHEN user_id IS NULL THEN concat('guest:', coalesce(trim(split_part(forwarded, ',', 1)), '127.0.0.1')) ELSE concat('user:', user_id) END AS key,
 user_id IS NULL AS guest FROM {requests}"""
_DAY = "INTERVAL 1 DAY"


@query("i11_rolling_counts", f"SELECT a.id AS probe, count(*) AS in_span FROM {{keyed}} a JOIN {{keyed}} b ON b.key = a.key AND b.ts <= a.ts AND b.ts > a.ts - {_DAY} GROUP BY a.id")
def i11_rolling(spark, d):
    keyed = M.keyed_requests(table(spark, d, "requests"))
    return M.rolling_counts(keyed, M.DAY_US).select("probe", "in_span")


def _replay(guest: int, user: int) -> dict[str, str]:
    ok = f"len(list_filter(r.times, lambda t: t > o.ts - {_DAY})) < o.cap"
    return {
            "lined": f"SELECT *, CASE WHEN guest THEN {guest} ELSE {user} END AS cap, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS rn FROM {{keyed}}",
        "replay": f"""SELECT o.key, o.rn, o.id, o.guest, true AS allowed, [o.ts] AS times FROM {{lined}} o WHERE o.rn = 1 UNION ALL
 SELECT o.key, o.rn, o.id, o.guest, {ok}, CASE WHEN {ok} THEN list_append(list_filter(r.times, lambda t: t > o.ts - {_DAY}), o.ts) ELSE r.times END
 FROM replay r JOIN {{lined}} o ON o.key = r.key AND o.rn = r.rn + 1"""}


_DECIDED = ("SELECT id, key, allowed, CASE WHEN NOT allowed THEN CASE WHEN guest THEN 'Daily limit of 50 free lookups reached. Sign in for 200 lookups/day.' "
            "ELSE 'Daily limit of 200 lookups reached. Try again tomorrow.' END END AS message FROM {replay}")


@query("i11_decisions", _DECIDED, _replay(M.GUEST_LIMIT, M.USER_LIMIT))
def i11(spark, d):
    return M.decide(M.keyed_requests(table(spark, d, "requests"))).select("id", "key", "allowed", "message")


@query("i11_decisions_tight", _DECIDED, _replay(5, 2))
def i11_tight(spark, d):
    return M.decide(M.keyed_requests(table(spark, d, "requests"), 5, 2)).select("id", "key", "allowed", "message")


_HOUR = "INTERVAL 1 HOUR"
# Games count per user and hour; a purchase is a game that was started.
SHARED["game_keys"] = "SELECT id, ts, concat('user:', user_id) AS key FROM {game_rounds}"


def _games(cap: int) -> tuple[str, dict[str, str]]:
    ok = f"len(list_filter(r.times, lambda t: t > o.ts - {_HOUR})) < {cap}"
    return "SELECT id, key, allowed, CASE WHEN NOT allowed THEN 'Too many games. Please wait before playing again.' END AS message FROM {replay}", {
        "lined": "SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS rn FROM {game_keys}",
        "replay": f"""SELECT o.key, o.rn, o.id, true AS allowed, [o.ts] AS times FROM {{lined}} o WHERE o.rn = 1 UNION ALL
 SELECT o.key, o.rn, o.id, {ok}, CASE WHEN {ok} THEN list_append(list_filter(r.times, lambda t: t > o.ts - {_HOUR}), o.ts) ELSE r.times END
 FROM replay r JOIN {{lined}} o ON o.key = r.key AND o.rn = r.rn + 1"""}


@query("i11_games", *_games(M.GAME_LIMIT))
def i11_games(spark, d):
    return M.decide(M.keyed_games(table(spark, d, "game_rounds")), M.HOUR_US).select("id", "key", "allowed", "message")


@query("i11_games_tight", *_games(1))
def i11_games_tight(spark, d):
    return M.decide(M.keyed_games(table(spark, d, "game_rounds"), 1), M.HOUR_US).select("id", "key", "allowed", "message")


SHARED["saved"] = """SELECT s.user_id, s.word_id, min(s.ts) AS saved_at FROM {saves} s LEFT JOIN (SELECT user_id, word_id, max({'t': ts, 'i': id}) AS gone FROM {saves} WHERE action = 'unsave' GROUP BY user_id, word_id) g
 ON g.user_id = s.user_id AND g.word_id = s.word_id WHERE s.action = 'save' AND (g.gone IS NULL OR {'t': s.ts, 'i': s.id} > g.gone) GROUP BY s.user_id, s.word_id"""


def saved(spark, d):
    return V.saved_set(table(spark, d, "saves"))


def _profiles(spark, d):
    return table(spark, d, "profiles").withColumn("id", F.col("num"))


@query("i12_saved_set", "SELECT user_id, word_id, epoch_us(saved_at) AS saved_at FROM {saved}")
def i12(spark, d):
    return saved(spark, d).select("user_id", "word_id", F.unix_micros(F.col("saved_at").cast("timestamp")).alias("saved_at"))


@query("i13_collection", "SELECT s.user_id, s.word_id, p.word, p.part_of_speech, md5(p.definition) AS definition FROM {saved} s JOIN {profiles} p ON p.num = s.word_id")
def i13(spark, d):
    rows = V.collection(saved(spark, d), _profiles(spark, d))
    return rows.select("user_id", "word_id", "word", "part_of_speech", F.md5("definition").alias("definition"))


@query("i13_collection_sizes", "SELECT user_id, count(*) AS saved FROM {saved} GROUP BY user_id")
def i13_sizes(spark, d):
    return V.collection_sizes(saved(spark, d))


SHARED["asked"] = "SELECT concat(' ', upper(word), ' ') AS slug, lower(word) AS word FROM {profiles} UNION ALL SELECT concat('  ', word), lower(word) FROM {vocab}"
SHARED["stored"] = "SELECT word, part_of_speech, definition FROM {profiles} WHERE definition <> ''"


def resolved(spark, d):
    p, v = table(spark, d, "profiles"), table(spark, d, "vocab")
    slugs = p.select(F.concat(F.lit(" "), F.upper("word"), F.lit(" ")).alias("slug")).unionByName(v.select(F.concat(F.lit("  "), "word").alias("slug")))
    return V.resolve_profiles(slugs, p.filter("definition <> ''"), v.select("word"))


@query("i14_resolved", """SELECT a.slug, a.word, CASE WHEN s.word IS NOT NULL THEN 'stored' WHEN v.word IS NOT NULL THEN 'created' ELSE 'not found' END AS outcome,
 md5(CASE WHEN s.word IS NOT NULL OR v.word IS NOT NULL THEN coalesce(s.definition, '') END) AS definition FROM {asked} a LEFT JOIN {stored} s ON s.word = a.word LEFT JOIN {vocab} v ON v.word = a.word""")
def i14(spark, d):
    return resolved(spark, d).select("slug", "word", "outcome", F.md5("definition").alias("definition"))


@query("i14_new_profiles", "SELECT DISTINCT a.word, 50 AS obscurity_score FROM {asked} a JOIN {vocab} v ON v.word = a.word WHERE a.word NOT IN (SELECT word FROM {stored})")
def i14_new(spark, d):
    return V.new_profiles(resolved(spark, d)).select("word", "obscurity_score")


@query("i15_is_saved", "SELECT DISTINCT a.user_id, a.word_id, s.user_id IS NOT NULL AS saved FROM {saves} a LEFT JOIN {saved} s ON s.user_id = a.user_id AND s.word_id = a.word_id")
def i15(spark, d):
    return V.is_saved(table(spark, d, "saves").select("user_id", "word_id").distinct(), saved(spark, d))


# -- streams --------------------------------------------------------------------------------


_SLICES = 3


def _stream(spark, df, at=None):
    """A table as a stream over files in the shared scratch folder; with `at`, in micro-batches of rising times."""
    path = J.scratch(spark)
    if at is None:
        df.write.parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)
    J.write_in_time(df, path, at, _SLICES)
    return J.read_in_time(spark, path, df.schema)


def _ts():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _drain(spark, stream):
    return J.drain(stream, J.scratch(spark), J.scratch(spark))


@query("j1_stream_limits", _DECIDED.replace(", CASE WHEN NOT allowed THEN CASE WHEN guest THEN 'Daily limit of 50 free lookups reached. Sign in for 200 lookups/day.' ELSE 'Daily limit of 200 lookups reached. Try again tomorrow.' END END AS message", ""), _replay(5, 2))
def j1(spark, d):
    keyed = M.keyed_requests(table(spark, d, "requests"), 5, 2)
    return _drain(spark, J.limit_requests(_stream(spark, keyed, F.col("at")))).select("id", "key", "allowed")


@query("j2_stream_streaks", "SELECT user_id, id, strftime(day, '%Y-%m-%d') AS day, streak, award FROM {daily}")
def j2(spark, d):
    out = _drain(spark, J.daily_streaks(_stream(spark, table(spark, d, "lookups"), _ts())))
    return out.filter("award > 0").select("user_id", "id", F.col("day").cast("string").alias("day"), "streak", "award")


@query("j3_stream_ledger", "SELECT user_id, id, kind, balance, bankrupt FROM {replay}", {
    "replay": """SELECT o.user_id, o.rn, o.id, o.kind, CASE WHEN 100 + o.delta <= 0 THEN 25 ELSE 100 + o.delta END AS balance, 100 + o.delta <= 0 AS bankrupt FROM {ordered} o WHERE o.rn = 1
 UNION ALL SELECT o.user_id, o.rn, o.id, o.kind, CASE WHEN r.balance + o.delta <= 0 THEN 25 ELSE r.balance + o.delta END, r.balance + o.delta <= 0 FROM replay r JOIN {ordered} o ON o.user_id = r.user_id AND o.rn = r.rn + 1"""})
def j3(spark, d):
    return _drain(spark, J.credit_ledger(_stream(spark, events(spark, d), _ts()))).select("user_id", "id", "kind", "balance", "bankrupt")


@query("j4_stream_saves", "SELECT user_id, word_id, id FROM {transitions}")
def j4(spark, d):
    out = _drain(spark, J.saved_words(_stream(spark, table(spark, d, "saves"), _ts())))
    return out.filter("newly").select("user_id", "word_id", "id")


@query("j5_stream_pairs", "SELECT s.user_id, s.id AS save_id, l.id AS lookup_id FROM {saves} s JOIN {lookups} l ON l.user_id = s.user_id AND l.ts <= s.ts AND l.ts > s.ts - INTERVAL 5 MINUTE")
def j5(spark, d):
    pairs = J.saves_after_lookups(_stream(spark, table(spark, d, "saves")), _stream(spark, table(spark, d, "lookups")))
    return _drain(spark, pairs)


@query("j6_stream_topk", "SELECT qid, rank, word, sim FROM {hits_lemma} WHERE rank <= 10")
def j6(spark, d):
    out = J.scratch(spark)
    write = lambda hits, batch: hits.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    queries = _stream(spark, P.query_vectors(spark, d))
    J.drain_batches(queries, J.scratch(spark), J.search_batches(P.vectors(spark, d), 10, write))
    return spark.read.parquet(out).select("qid", "rank", "word", "sim")
