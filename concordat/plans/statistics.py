"""Telemetry and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.operators import evaluation as ev
from concordat.operators import telemetry as tl
from concordat.plans.base import Registry
from concordat.runtime import table

_R = Registry()
QUERIES, SQL = _R.QUERIES, _R.SQL


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@_R.query("""select channel, content_type, question_id, cast(grouping_id(channel, content_type, question_id) as int) as level, round(sum(cost), 6) as cost, count(*) as calls
from response group by grouping sets ((channel), (content_type), (question_id), (question_id, channel), (question_id, content_type), ())""")
def agg_17_cost_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tl.cost_sets(table(spark, sf_dir, "response"), "channel", "content_type", "question_id", "cost")
    return out.select("channel", "content_type", "question_id", "level", F.round("cost", 6).alias("cost"), "calls")


@_R.query("""select model_name, round(sum(cost), 6) as cost, round(sum(cost) / sum(sum(cost)) over (), 6) as share from response group by model_name""")
def win_03_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.shares(table(spark, sf_dir, "response"), "model_name", "cost").select("model_name", F.round("cost", 6).alias("cost"), F.round("share", 6).alias("share"))


@_R.query("""select question_id, round(sum(cost), 6) as cost, count(*) as calls from response group by 1 order by round(sum(cost), 6) desc, question_id limit 10""")
def srt_05_most_expensive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.most_expensive(table(spark, sf_dir, "response"), "question_id", "cost").select("question_id", F.round("cost", 6).alias("cost"), "calls")


@_R.query("""select event_id, round(avg(value) over (partition by event_type order by ts, event_id rows between 99 preceding and current row), 9) as rolling_mean from events""")
def win_04_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.rolling_mean(_events(spark, sf_dir), "event_type", ["ts", "event_id"], "value").select("event_id", F.round("rolling_mean", 9).alias("rolling_mean"))


@_R.query("""select event_id, count(*) over (partition by event_type order by ts range between interval 1 hour preceding and current row) as trailing_calls from events""")
def win_05_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    return tl.trailing_calls(rows, "event_type", "at").select("event_id", "trailing_calls")


@_R.query("""with r as (select event_type, event_id, sum(value) over (partition by event_type order by ts, event_id rows unbounded preceding) as c from events),
m as (select r.*, mark from r, (values (0.75), (0.9), (1.0)) t(mark))
select event_type, mark::double as mark, min(event_id) as crossed_at from m where round(c, 6) >= mark * 5000 group by all""")
def win_06_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.budget_crossings(_events(spark, sf_dir), "event_type", ["ts", "event_id"], "value", 5000.0, "event_id")


@_R.query("""select user_id, count(*) as calls, count(*) filter (event_type = 'error') as errors, round(count(*) filter (event_type = 'error') / count(*), 6) as rate from events group by user_id""")
def agg_21_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.error_rate(_events(spark, sf_dir), "user_id", F.col("event_type") == "error").select("user_id", "calls", "errors", F.round("rate", 6).alias("rate"))


@_R.query("""select user_id, event_type, round(s, 6) as seconds from (select *, row_number() over (partition by user_id order by round(s, 6) desc, event_type) as r from (select user_id, event_type, sum(value) as s from events group by all)) where r = 1""")
def win_11_bottleneck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.bottleneck(_events(spark, sf_dir), "user_id", "event_type", "value").select("user_id", "event_type", F.round("seconds", 6).alias("seconds"))


@_R.query("""select event_id, array_to_string(coalesce(list(event_type) over (partition by user_id order by ts, event_id rows between 1 following and 3 following), []), '|') as ahead from events""")
def win_10_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.look_ahead(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type").select("event_id", F.concat_ws("|", "ahead").alias("ahead"))


@_R.query("""select question_id, array_to_string(coalesce(list(question_id) over (partition by linked_group.group_id order by linked_group.question_index, question_id rows between unbounded preceding and 1 preceding), []), '|') as before
from question where linked_group is not null and linked_group.group_id is not null""")
def jon_15_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "question").where("linked_group.group_id is not null").select("question_id", "linked_group.group_id", "linked_group.question_index")
    return tl.history(rows, "group_id", ["question_index", "question_id"], "question_id").select("question_id", F.concat_ws("|", "before").alias("before"))


@_R.query("""select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) <= 5 as kept from orders""")
def win_09_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tl.newest(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), "o_orderkey"], 5).select("o_custkey", "o_orderkey", "kept")


_METRICS = ("input_tokens", "output_tokens", "cost", "time_seconds")
_LONG = " union all ".join(f"select channel, '{m}' as metric, {m}::double as v from response where {m} is not null and not isnan({m}::double)" for m in _METRICS)


@_R.query(f"""select channel, metric, count(*) as n, round(avg(v), 6) as mean, round(median(v), 6) as median, round(coalesce(stddev_samp(v), 0), 5) as stdev, min(v) as low, max(v) as high from ({_LONG}) group by all""")
def agg_24_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ev.describe(table(spark, sf_dir, "response"), ["channel"], list(_METRICS))
    return out.select("channel", "metric", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), F.round("stdev", 5).alias("stdev"), "low", "high")


@_R.query("""select question_id, response_id from (select question_id, response_id, row_number() over (partition by question_id order by confidence desc, response_id) as r from response where confidence is not null and not isnan(confidence)) where r = 1""")
def agg_25_best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.best_of_n(table(spark, sf_dir, "response"), ["question_id"], "confidence", "response_id", ["response_id"])


@_R.query("""with m as (select question_id, channel, round(avg(output_tokens), 6) as v from response group by all), b as (select question_id, v as base from m where channel = 'direct_api')
select m.question_id, m.channel, v, base, round(case when base > 0 then (v - base) / base * 100 end, 6) as percent from m join b on m.question_id = b.question_id where m.channel <> 'direct_api'""")
def agg_26_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "response").groupBy("question_id", "channel").agg(F.round(F.avg("output_tokens"), 6).alias("v"))
    return ev.improvement(means, "question_id", "channel", "v", "direct_api").withColumn("percent", F.round("percent", 6))


_COMPARED = """with p as (select a.l_orderkey, a.l_returnflag as field, b.l_linenumber as model, case when a.l_extendedprice > b.l_extendedprice then 'A' when a.l_extendedprice < b.l_extendedprice then 'B' else 'TIE' end as winner
from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = 1 and b.l_linenumber > 1)
"""


def _comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each order as baseline against every other line of the order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    base = lines.where("l_linenumber = 1").select("l_orderkey", F.col("l_returnflag").alias("field"), F.col("l_extendedprice").alias("base"))
    other = lines.where("l_linenumber > 1").select("l_orderkey", F.col("l_linenumber").alias("model"), "l_extendedprice")
    winner = F.when(F.col("base") > F.col("l_extendedprice"), "A").when(F.col("base") < F.col("l_extendedprice"), "B").otherwise("TIE")
    return base.join(other, "l_orderkey").select("l_orderkey", "field", "model", winner.alias("winner"))


@_R.query(_COMPARED + """select model, count(*) filter (winner = 'A') as wins, count(*) filter (winner = 'B') as losses, count(*) filter (winner = 'TIE') as ties, round(count(*) filter (winner = 'A') / count(*), 6) as win_rate from p group by model""")
def agg_27_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.win_rates(_comparisons(spark, sf_dir), ["model"], "winner").withColumn("win_rate", F.round("win_rate", 6))


@_R.query(_COMPARED + """select field, model, count(*) as n, count(*) filter (winner = 'A') as wins from p group by cube (field, model)""")
def agg_28_field_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparisons(spark, sf_dir).cube("field", "model").agg(F.count("*").alias("n"), F.count_if(F.col("winner") == "A").alias("wins"))


@_R.query(_COMPARED + """, w as (select model, count(*) filter (winner = 'A') as w, count(*) filter (winner = 'B') as l, count(*) filter (winner = 'TIE') as t from p group by model),
d as (select model, case when w + l = 0 then 0 else (w - (w + l) / 2) / sqrt((w + l) / 4) end as z, (w - l) / (w + l + t) / 0.5 as d from w)
select model, round(z, 6) as z, round(d, 6) as effect, case when abs(d) < 0.2 then 'negligible' when abs(d) < 0.5 then 'small' when abs(d) < 0.8 then 'medium' else 'large' end as size from d""")
def agg_30_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ev.win_rates(_comparisons(spark, sf_dir), ["model"], "winner")
    d = ev.effect_size(F.col("wins"), F.col("losses"), F.col("ties"))
    return w.select("model", F.round(ev.sign_z(F.col("wins"), F.col("losses")), 6).alias("z"), F.round(d, 6).alias("effect"), ev.effect_label(d).alias("size"))


@_R.query()
def agg_29_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ev.win_rates(_comparisons(spark, sf_dir), ["model"], "winner")
    return w.select("model", "wins", "losses", ev.two_sided_p(ev.sign_z(F.col("wins"), F.col("losses"))).alias("p"))


@_R.query()
def agg_31_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.bootstrap_interval(table(spark, sf_dir, "response").select("channel", "output_tokens"), ["channel"], "output_tokens")


@_R.query("""select channel, count(*) as n, round(avg((difficulty_score between 1 and 5)::int), 6) as precision, round(avg(coalesce(confidence > 1, false)::int), 6) as hallucination_rate, round(avg(output_tokens), 6) as rating
from (select channel, difficulty_score, case when isnan(confidence) then null else confidence end as confidence, output_tokens from response) where difficulty_score is not null group by rollup (channel)""")
def agg_32_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response").where("channel is not null")
    out = ev.label_metrics(rows, "channel", F.col("difficulty_score").between(1, 5), F.coalesce((F.col("confidence") > 1) & ~F.isnan("confidence"), F.lit(False)), F.col("output_tokens"))
    return out.select("channel", "n", *[F.round(c, 6).alias(c) for c in ("precision", "hallucination_rate", "rating")])


@_R.query("""select floor(confidence * 10)::int as bucket, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percent from response where confidence between 0 and 1 group by 1""")
def agg_34_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response").where("confidence between 0 and 1 and not isnan(confidence)")
    return ev.histogram(rows, F.floor(F.col("confidence") * 10).cast("int")).withColumn("percent", F.round("percent", 6))


@_R.query("""select r.model_name, count(*) as calls, round(sum(input_tokens / 1e6 * input_per_1m + output_tokens / 1e6 * output_per_1m), 6) as listed_cost from response r join model_price p on r.model_name = p.model_name group by 1""")
def jon_08_listed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "response").join(table(spark, sf_dir, "model_price"), "model_name")
    cost = F.col("input_tokens") / 1e6 * F.col("input_per_1m") + F.col("output_tokens") / 1e6 * F.col("output_per_1m")
    return rows.groupBy("model_name").agg(F.count("*").alias("calls"), F.round(F.sum(cost), 6).alias("listed_cost"))


@_R.query("""select question_id, sum(input_tokens) as input_tokens, sum(output_tokens) as output_tokens, round(sum(cost), 6) as cost, max(time_seconds) as slowest from response group by 1""")
def agg_16_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "response").groupBy("question_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.max("time_seconds").alias("slowest")
    )
