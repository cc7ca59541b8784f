"""Queries of operations and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import replay as P
from ..operators import statistics as S
from ..session import use_shared_folder
from ..sources.tables import table
from .cache import replay_rates
from .registry import Registry

R = Registry()


def _usage(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Usage records, each once, with the columns wanted; re-sent records are equal in them."""
    return table(spark, d, "usage_records").select("usage_id", *columns).distinct()


def _cached(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "cached_answers").select("entry_id", *columns).distinct()


@R.add("""with u as (select distinct usage_id, role, tokens_in, tokens_out, status, retries, latency_ms from usage_records)
select role, count(*) as calls, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out, sum(case when status <> 'ok' then 1 else 0 end)::bigint as failed,
 cast(sum(retries) as bigint) as retries, round(avg(latency_ms), 4) as mean_latency from u group by role""")
def ops_roles(spark: SparkSession, d: str) -> DataFrame:
    u = _usage(spark, d, "role", "tokens_in", "tokens_out", "status", "retries", "latency_ms")
    return u.groupBy("role").agg(
        F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum((F.col("status") != "ok").cast("long")).alias("failed"),
        F.sum("retries").alias("retries"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"),
    )


def _nearest_sql(source: str, value: str, group: str, shares: list[tuple[str, float]], rule: str = "round_even({}, 0)") -> str:
    picks = ", ".join(f"min(case when rn - 1 >= {rule.format(f'{p} * (n_values - 1)')} then {value} end) as {name}" for name, p in shares)
    return f"""with r as (select {group}, {value}, row_number() over (partition by {group} order by {value}) as rn, count(*) over (partition by {group}) as n_values from ({source}) where {value} is not null)
select {group}, n_values, {picks} from r group by {group}, n_values"""


_LATENCY = [("p50", 0.5), ("p90", 0.9), ("p99", 0.99)]


@R.add(_nearest_sql("select distinct usage_id, model, latency_ms from usage_records", "latency_ms", "model", _LATENCY))
def ops_latency(spark: SparkSession, d: str) -> DataFrame:
    return S.ranked_percentiles(_usage(spark, d, "model", "latency_ms"), "latency_ms", ["model"], _LATENCY)


@R.add(_nearest_sql("select lang, n_chars from documents", "n_chars", "lang", [("p10", 0.1), ("p50", 0.5), ("p75", 0.75)]))
def nearest_percentile(spark: SparkSession, d: str) -> DataFrame:
    return S.ranked_percentiles(table(spark, d, "documents").select("lang", "n_chars"), "n_chars", ["lang"], [("p10", 0.1), ("p50", 0.5), ("p75", 0.75)])


@R.add(_nearest_sql("select distinct entry_id, intent, tokens_saved_est from cached_answers", "tokens_saved_est", "intent", [("p5", 0.05), ("p50", 0.5), ("p95", 0.95)], "floor({})"))
def calibration_stats(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles at the truncated rank."""
    return S.ranked_percentiles(_cached(spark, d, "intent", "tokens_saved_est"), "tokens_saved_est", ["intent"], [("p5", 0.05), ("p50", 0.5), ("p95", 0.95)], rule="floor")


@R.add("""with c as (select distinct entry_id, answer_class, hit_count, tokens_saved_est from cached_answers), t as (select sum(hit_count) as hits from c)
select answer_class, count(*) as entries, cast(sum(hit_count) as bigint) as hits, round(sum(hit_count) / any_value(hits), 6) as hit_share, cast(sum(hit_count * tokens_saved_est) as bigint) as saved from c, t group by answer_class""")
def ops_cache(spark: SparkSession, d: str) -> DataFrame:
    c = _cached(spark, d, "answer_class", "hit_count", "tokens_saved_est")
    by = c.groupBy("answer_class").agg(F.count("*").alias("entries"), F.sum("hit_count").alias("hits"), F.sum(F.col("hit_count") * F.col("tokens_saved_est")).alias("saved"))
    total = by.agg(F.sum("hits").alias("_t"))
    return by.crossJoin(F.broadcast(total)).select("answer_class", "entries", "hits", F.round(F.col("hits") / F.col("_t"), 6).alias("hit_share"), "saved")


@R.add("""with u as (select distinct usage_id, provider, status, retries, error from usage_records)
select provider, status, count(*) as n, sum(case when retries > 0 then 1 else 0 end)::bigint as retried, sum(case when error is not null then 1 else 0 end)::bigint as with_error,
 grouping(provider) as all_providers from u group by cube (provider, status)""")
def ops_quality(spark: SparkSession, d: str) -> DataFrame:
    u = _usage(spark, d, "provider", "status", "retries", "error")
    return u.cube("provider", "status").agg(
        F.count("*").alias("n"), F.sum((F.col("retries") > 0).cast("long")).alias("retried"), F.sum(F.col("error").isNotNull().cast("long")).alias("with_error"),
        F.grouping("provider").cast("long").alias("all_providers"),
    )


@R.add("select * from (select distinct usage_id, ts, received_at, model, status from usage_records) order by received_at desc nulls last, usage_id desc limit 50")
def ops_tail(spark: SparkSession, d: str) -> DataFrame:
    """The fifty records received last; a top-k per partition, then one."""
    u = table(spark, d, "usage_records").select("usage_id", "ts", "received_at", "model", "status").distinct()
    return u.orderBy(F.col("received_at").desc(), F.col("usage_id").desc()).limit(50)


@R.add("""with u as (select distinct usage_id, model, role, tokens_in, tokens_out from usage_records)
select model, count(*) as calls, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(coalesce(tokens_out, 0)) as bigint) as tokens_out,
 round(coalesce(avg(case when role = 'large' then tokens_in + coalesce(tokens_out, 0) end), 3000), 4) as large_call from u group by model""")
def ledger_totals(spark: SparkSession, d: str) -> DataFrame:
    u = _usage(spark, d, "model", "role", "tokens_in", "tokens_out")
    out = F.coalesce("tokens_out", F.lit(0))
    return u.groupBy("model").agg(
        F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum(out).alias("tokens_out"),
        F.round(F.coalesce(F.avg(F.when(F.col("role") == "large", F.col("tokens_in") + out)), F.lit(3000)), 4).alias("large_call"),
    )


@R.add("select distinct request_id, usage_id, ts, model, role, status from usage_records where request_id in ('req_0000000051', 'req_0000000100')")
def trace_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Records of two requests: the filter is pushed to the scan."""
    return table(spark, d, "usage_records").where(F.col("request_id").isin("req_0000000051", "req_0000000100")).select("request_id", "usage_id", "ts", "model", "role", "status").distinct()


@R.add("""with c as (select distinct entry_id, created_at, hit_count from cached_answers),
n as (select *, row_number() over (order by created_at nulls last, entry_id) as rn, count(*) over () as total from c)
select cast(floor((rn - 1) / greatest(1, total // 20)) as bigint) as bucket, count(*) as n, min(created_at) as first_at, round(avg(case when hit_count > 0 then 1.0 else 0.0 end), 6) as hit_rate from n group by 1""")
def hit_rate_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Hit rate in buckets of equal size over time."""
    c = S.numbered(_cached(spark, d, "created_at", "hit_count"), "created_at", ["entry_id"])
    total = c.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 20)).alias("_size"))
    bucket = F.floor((F.col("row_no") - 1) / F.col("_size"))
    return c.crossJoin(F.broadcast(total)).groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.round(F.avg((F.col("hit_count") > 0).cast("double")), 6).alias("hit_rate")
    )


@R.add("""with g as (select distinct id, intent, review_status, length(question) as q, expected is not null as numeric, reference_answer from golden)
select intent, count(*) as n, round(avg(q), 6) as mean_question, round(avg(case when numeric then 1.0 else 0.0 end), 6) as numeric_share, round(avg(length(reference_answer)), 6) as mean_answer,
 sum(case when review_status = 'verified' then 1 else 0 end)::bigint as verified from g group by rollup (intent)""")
def eval_rollup(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "golden").select("id", "intent", "review_status", F.length("question").alias("q"), F.col("expected").isNotNull().alias("numeric"), "reference_answer").distinct()
    return g.rollup("intent").agg(
        F.count("*").alias("n"), F.round(F.avg("q"), 6).alias("mean_question"), F.round(F.avg(F.col("numeric").cast("double")), 6).alias("numeric_share"),
        F.round(F.avg(F.length("reference_answer")), 6).alias("mean_answer"), F.sum((F.col("review_status") == "verified").cast("long")).alias("verified"),
    )


@R.add("""with c as (select distinct entry_id, generator_role, answer_class, hit_count, tokens_saved_est from cached_answers)
select generator_role, answer_class, count(*) as n, round(avg(tokens_saved_est), 6) as mean_saved, round(avg(hit_count), 6) as mean_hits, max(hit_count) as most_hits from c group by all""")
def arm_stats(spark: SparkSession, d: str) -> DataFrame:
    c = _cached(spark, d, "generator_role", "answer_class", "hit_count", "tokens_saved_est")
    return c.groupBy("generator_role", "answer_class").agg(F.count("*").alias("n"), F.round(F.avg("tokens_saved_est"), 6).alias("mean_saved"), F.round(F.avg("hit_count"), 6).alias("mean_hits"), F.max("hit_count").alias("most_hits"))


@R.add("""with c as (select distinct entry_id, intent, answer_class, generator_role, hit_count from cached_answers)
select intent, answer_class, generator_role, count(*) as n, cast(sum(hit_count) as bigint) as hits from c group by grouping sets ((intent, answer_class), (generator_role), ())""")
def policy_summary(spark: SparkSession, d: str) -> DataFrame:
    c = _cached(spark, d, "intent", "answer_class", "generator_role", "hit_count")
    sets = [["intent", "answer_class"], ["generator_role"], []]
    return c.groupingSets([[F.col(x) for x in s] for s in sets], "intent", "answer_class", "generator_role").agg(F.count("*").alias("n"), F.sum("hit_count").alias("hits"))


@R.add()
def promotion_rule(spark: SparkSession, d: str) -> DataFrame:
    """Policies whose replay beats the chosen one's rate of correct hits by five points at two capacities."""
    use_shared_folder(spark)
    return P.promotion(replay_rates(spark, d).checkpoint(), "lfu_fading").withColumn("best_gain", F.round("best_gain", 6))


_SIMS = """sims as (select q.vec_id as query_id, v.vec_id, q.label = v.label as same, list_inner_product(cast(v.embedding as double[]), cast(q.embedding as double[]))
 / (sqrt(list_inner_product(cast(v.embedding as double[]), cast(v.embedding as double[]))) * sqrt(list_inner_product(cast(q.embedding as double[]), cast(q.embedding as double[])))) as sim
 from embeddings q join embeddings v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id),
near as (select * from (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rank from sims) where rank <= 50)"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    """The fifty nearest vectors of the query set, with whether they share its label."""
    v = table(spark, d, "embeddings")
    found = V.exact_topk(spark, v.select("vec_id", "embedding"), v.where("vec_id % 100 = 0").select("vec_id", "embedding"), 51).where("vec_id <> query_id")
    labels = v.select("vec_id", "label")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 50")
    both = found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_l")), "query_id")
    return both.select("query_id", "vec_id", F.col("score").alias("sim"), "rank", (F.col("label") == F.col("_l")).alias("same"))


@R.add(f"""with {_SIMS}, grid as (select unnest([0.1::double, 0.2::double, 0.3::double, 0.4::double]) as threshold)
select threshold, same, count(*) as n, round(avg(case when round(sim, 9) >= threshold then 1.0 else 0.0 end), 6) as hit_rate from near, grid group by cube (threshold, same)""")
def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    near = _near(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)])))
    return near.cube("threshold", "same").agg(F.count("*").alias("n"), F.round(F.avg((F.round("sim", 9) >= F.col("threshold")).cast("double")), 6).alias("hit_rate"))


@R.add(f"""with {_SIMS} select same, count(*) as n, round(quantile_cont(sim, 0.5), 6) as p50, round(quantile_cont(sim, 0.1), 6) as p10, round(min(sim), 6) as least, round(max(sim), 6) as most from near group by same""")
def sim_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _near(spark, d).groupBy("same").agg(
        F.count("*").alias("n"), F.round(F.percentile("sim", 0.5), 6).alias("p50"), F.round(F.percentile("sim", 0.1), 6).alias("p10"), F.round(F.min("sim"), 6).alias("least"), F.round(F.max("sim"), 6).alias("most")
    )


@R.add(f"""with {_SIMS}, r as (select query_id, rank, same, sum(case when same then 1 else 0 end) over (partition by query_id order by rank) as seen from near)
select query_id, round(coalesce(avg(case when same then seen / rank end), 0.0), 6) as avg_precision from r group by query_id""")
def avg_precision(spark: SparkSession, d: str) -> DataFrame:
    """Mean precision at the ranks of relevant results."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = _near(spark, d).withColumn("seen", F.sum(F.col("same").cast("int")).over(upto))
    return r.groupBy("query_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("same"), F.col("seen") / F.col("rank"))), F.lit(0.0)), 6).alias("avg_precision"))


@R.add(f"""with {_SIMS} select round(avg(case when same then 1.0 else 0.0 end), 6) as faithful, round(avg(sim), 6) as relevancy, count(*) as n from near""")
def judge_means(spark: SparkSession, d: str) -> DataFrame:
    """Share of supported verdicts and mean similarity, over the verdicts there are."""
    return _near(spark, d).agg(F.round(F.avg(F.col("same").cast("double")), 6).alias("faithful"), F.round(F.avg("sim"), 6).alias("relevancy"), F.count("*").alias("n"))


@R.add()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the hit rate of each class from 200 seeded resamples."""
    c = _cached(spark, d, "hit_count").withColumn("hit", (F.col("hit_count") > 0).cast("double"))
    means = S.bootstrap(c, "entry_id", "hit")
    return means.agg(F.round(F.percentile("mean", 0.05), 6).alias("low"), F.round(F.percentile("mean", 0.95), 6).alias("high"), F.count("*").alias("draws"))


@R.add("""with c as (select question, generator_role, min(entry_id) as entry_id, max(tokens_saved_est) as saved, max(length(answer)) as chars from cached_answers where generator_role in ('large', 'small') group by all)
select a.question, a.entry_id as large_id, b.entry_id as small_id, coalesce(b.chars, 0) * 10 >= coalesce(a.chars, 0) * 7 as close from c a join c b on a.question = b.question and a.generator_role = 'large' and b.generator_role = 'small'""")
def paired_runs(spark: SparkSession, d: str) -> DataFrame:
    """Questions answered in both arms, and whether the smaller keeps seven tenths of the text."""
    c = table(spark, d, "cached_answers").where(F.col("generator_role").isin("large", "small"))
    per = c.groupBy("question", "generator_role").agg(F.min("entry_id").alias("entry_id"), F.max(F.length("answer")).alias("chars"))
    a = per.where("generator_role = 'large'").select("question", F.col("entry_id").alias("large_id"), F.coalesce("chars", F.lit(0)).alias("_a"))
    b = per.where("generator_role = 'small'").select("question", F.col("entry_id").alias("small_id"), F.coalesce("chars", F.lit(0)).alias("_b"))
    return a.join(b, "question").select("question", "large_id", "small_id", (F.col("_b") * 10 >= F.col("_a") * 7).alias("close"))


@R.add("""with c as (select distinct entry_id, lfu_counter, hit_count from cached_answers), l as (select *, lfu_counter >= 6 as said, hit_count >= 3 as truth from c),
m as (select sum(case when said and truth then 1 else 0 end) as tp, sum(case when said and not truth then 1 else 0 end) as fp, sum(case when not said and truth then 1 else 0 end) as fn, count(*) as n,
  sum(case when said = truth then 1 else 0 end) as ok, sum(case when truth then 1 else 0 end) as pos from l),
r as (select lfu_counter, sum(case when truth then 1 else 0 end) as pos, count(*) as n from l group by 1),
k as (select pos, n, sum(n) over (order by lfu_counter) - n + (n + 1) / 2 as rank from r),
a as (select (sum(pos * rank) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * sum(n - pos), 0) as auc from k)
select round(ok / n, 6) as accuracy, round(tp / nullif(tp + fp, 0), 6) as prec, round(tp / nullif(tp + fn, 0), 6) as recall, round(greatest(pos, n - pos) / n, 6) as majority, round(auc, 6) as auc from m, a""")
def classifier_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, precision, recall and AUC of the use counter as a sign of popular entries."""
    c = _cached(spark, d, F.col("lfu_counter").cast("double").alias("score"), "hit_count")
    c = c.select("score", (F.col("score") >= 6).alias("said"), (F.col("hit_count") >= 3).alias("truth"))
    count = lambda x: F.sum(x.cast("long"))
    m = c.agg(
        count(F.col("said") & F.col("truth")).alias("tp"), count(F.col("said") & ~F.col("truth")).alias("fp"), count(~F.col("said") & F.col("truth")).alias("fn"),
        F.count("*").alias("n"), count(F.col("said") == F.col("truth")).alias("ok"), count(F.col("truth")).alias("pos"),
    )
    both = m.crossJoin(S.auc(c, "score", "truth"))  # one row each
    return both.select(
        F.round(F.col("ok") / F.col("n"), 6).alias("accuracy"), F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("prec"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"),
        F.round(F.greatest(F.col("pos"), F.col("n") - F.col("pos")) / F.col("n"), 6).alias("majority"), F.round("auc", 6).alias("auc"),
    )


@R.add("""with g as (select distinct id, expected.value as want, expected.fiscal_year as year, reference_answer from golden where expected.value is not null and reference_answer is not null),
n as (select id, want, year, reference_answer, unnest(regexp_extract_all(reference_answer, '[0-9][0-9,]*(?:\\.[0-9]+)?')) as tok from g),
v as (select id, want, year, reference_answer, try_cast(replace(tok, ',', '') as double) as got from n)
select id, max(case when abs(abs(got) - abs(want)) <= 0.0005 * abs(want) + 0.0005 then 1 else 0 end) = 1 as value_ok, contains(any_value(reference_answer), cast(any_value(year) as varchar)) as period_ok from v group by id""")
def score_answers(spark: SparkSession, d: str) -> DataFrame:
    """Whether a reference answer states the expected value, whatever its sign, and the period."""
    g = table(spark, d, "golden").where(F.col("expected.value").isNotNull() & F.col("reference_answer").isNotNull())
    g = g.select("id", F.col("expected.value").alias("want"), F.col("expected.fiscal_year").cast("string").alias("year"), F.col("reference_answer").alias("a")).distinct()
    numbers = F.transform(F.regexp_extract_all("a", F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    right = F.exists(numbers, lambda x: F.abs(F.abs(x) - F.abs("want")) <= F.abs("want") * 0.0005 + 0.0005)
    return g.where(F.size(numbers) > 0).select("id", F.coalesce(right, F.lit(False)).alias("value_ok"), F.contains("a", "year").alias("period_ok"))


@R.add("select distinct id, question from golden g where question is not null and not exists (select 1 from cached_answers c where c.question = g.question)")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    """Golden questions that no cached answer covers yet."""
    g = table(spark, d, "golden").select("id", "question").where(F.col("question").isNotNull()).distinct()
    return g.join(table(spark, d, "cached_answers").select("question"), "question", "left_anti").select("id", "question")


@R.add("""with c as (select distinct chunk_id, modality, document, token_count, parent_id, table_part, table_parts from chunks)
select 'null_document' as failed, count(*) as n from c where document is null union all select 'null_tokens', count(*) from c where token_count is null
union all select 'stale_tokens', count(*) from c where token_count is not null and document is not null and abs(token_count - ceil(length(document) / 4)) > 0.5 * ceil(length(document) / 4) + 2
union all select 'part_beyond', count(*) from c where table_part > table_parts union all select 'orphan_sentence', count(*) from (select distinct sentence_id, chunk_id from sentences) s where not exists (select 1 from c where c.chunk_id = s.chunk_id)""")
def index_check(spark: SparkSession, d: str) -> DataFrame:
    """Consistency of the chunk index: how many rows fail each check."""
    c = table(spark, d, "chunks").select("chunk_id", "modality", "document", "token_count", "parent_id", "table_part", "table_parts").distinct()
    size = F.ceil(F.length("document") / 4)
    tests = {
        "null_document": F.col("document").isNull(), "null_tokens": F.col("token_count").isNull(),
        "stale_tokens": F.coalesce(F.abs(F.col("token_count") - size) > size * 0.5 + 2, F.lit(False)), "part_beyond": F.coalesce(F.col("table_part") > F.col("table_parts"), F.lit(False)),
    }
    one = c.agg(*[F.sum(t.cast("long")).alias(k) for k, t in tests.items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("failed"), F.col(k).alias("n")) for k in tests])).alias("x")).select("x.*")
    lost = table(spark, d, "sentences").select("sentence_id", "chunk_id").distinct().join(c.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("n"))
    return rows.unionByName(lost.select(F.lit("orphan_sentence").alias("failed"), "n"))


@R.add("""with l as (select distinct line_item, line_item_norm, line_group from chunks where modality = 'row_fact')
select line_item_norm, count(distinct line_item) as spellings, count(distinct line_group) as groups_of from l group by 1 having count(distinct line_group) > 1 or count(distinct line_item) > 1""")
def config_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Normalised names that stand for several line items or fall into several groups."""
    names = table(spark, d, "chunks").where("modality = 'row_fact'").select("line_item", "line_item_norm", "line_group").distinct()
    return names.groupBy("line_item_norm").agg(F.countDistinct("line_item").alias("spellings"), F.countDistinct("line_group").alias("groups_of")).where("groups_of > 1 or spellings > 1")


@R.add("""with c as (select distinct corpus_version, chunk_id, document from chunks), h as (select corpus_version, sha256(coalesce(chunk_id, '') || chr(10) || coalesce(document, '')) as x from c)
select corpus_version, count(*) as chunks, substr(sha256(concat_ws('|', corpus_version, cast(count(*) as varchar), cast(sum(cast(('0x' || substr(x, 1, 13)) as bigint)) as varchar), cast(sum(cast(('0x' || substr(x, 14, 13)) as bigint)) as varchar))), 1, 12) as stamp from h group by corpus_version""")
def corpus_version(spark: SparkSession, d: str) -> DataFrame:
    """A short stamp of the contents of each corpus version: sums of hashes of its chunks, whatever their order; any edit changes it."""
    c = table(spark, d, "chunks").select("corpus_version", "chunk_id", "document").distinct()
    x = F.sha2(F.concat(F.coalesce("chunk_id", F.lit("")), F.lit("\n"), F.coalesce("document", F.lit(""))), 256)
    parts = [F.sum(F.conv(F.substring("_x", a, 13), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"_{a}") for a in (1, 14)]
    by = c.select("corpus_version", x.alias("_x")).groupBy("corpus_version").agg(F.count("*").alias("chunks"), *parts)
    stamp = F.sha2(F.concat_ws("|", "corpus_version", F.col("chunks").cast("string"), "_1", "_14"), 256)
    return by.select("corpus_version", "chunks", F.substring(stamp, 1, 12).alias("stamp"))
