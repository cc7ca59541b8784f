"""Queries of the result cache and of rate control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import cache as C
from ..operators import replay as P
from ..sources.tables import table
from .registry import Registry

R = Registry()
NOW = 1_767_225_600
DAY = 86_400
VERSION = "cv_3"

_ENTRIES = "c as (select distinct entry_id, question, answer, intent, answer_class, generator_role, created_at, expires_at, last_hit_at, lfu_counter, hit_count, corpus_version, tokens_saved_est from cached_answers)"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    columns = ["entry_id", "question", "answer", "intent", "answer_class", "generator_role", "created_at", "expires_at", "last_hit_at", "lfu_counter", "hit_count", "corpus_version", "tokens_saved_est"]
    return table(spark, d, "cached_answers").select(*columns).distinct()


_NEGATION = r"\b(not|never|no|none|without|cannot)\b"


def _slots(entries: DataFrame) -> DataFrame:
    """Guard keys of a question: period, item, direction, negation and what is asked."""
    q = F.lower(F.col("question"))
    return entries.select(
        "entry_id", F.regexp_extract("question", "(20[0-9]{2})", 1).alias("periods_key"),
        F.regexp_extract(q, "(gross profit|total assets|long-term debt|goodwill|inventories|research expense|free cash flow|operating income)", 1).alias("metrics_key"),
        F.when(q.rlike("change|move|grow|rose|fell"), "change").otherwise("none").alias("direction"), F.when(q.rlike(_NEGATION), "yes").otherwise("no").alias("negation"),
        F.when(q.rlike("^(why|which)"), "reason").when(q.rlike("^(how|list)"), "detail").otherwise("value").alias("ask"), "corpus_version", "expires_at", "created_at",
    )


_SLOTS_SQL = rf"""s as (select entry_id, regexp_extract(question, '(20[0-9]{{2}})', 1) as periods_key,
 regexp_extract(lower(question), '(gross profit|total assets|long-term debt|goodwill|inventories|research expense|free cash flow|operating income)', 1) as metrics_key,
 case when regexp_matches(lower(question), 'change|move|grow|rose|fell') then 'change' else 'none' end as direction, case when regexp_matches(lower(question), '\b(not|never|no|none|without|cannot)\b') then 'yes' else 'no' end as negation,
 case when regexp_matches(lower(question), '^(why|which)') then 'reason' when regexp_matches(lower(question), '^(how|list)') then 'detail' else 'value' end as ask, corpus_version, expires_at, created_at from c)"""


@R.add(f"with {_ENTRIES}, {_SLOTS_SQL} select entry_id, periods_key, metrics_key, direction, negation, ask from s")
def slot_keys(spark: SparkSession, d: str) -> DataFrame:
    return _slots(_entries(spark, d)).select("entry_id", "periods_key", "metrics_key", "direction", "negation", "ask")


@R.add(f"""with {_ENTRIES}, {_SLOTS_SQL}, g as (select metrics_key, periods_key, direction, negation, ask, corpus_version, count(*) as live from s where expires_at > {NOW} group by all)
select q.entry_id, g.live from s q join g using (metrics_key, periods_key, direction, negation, ask, corpus_version) where metrics_key <> ''""")
def cache_guard(spark: SparkSession, d: str) -> DataFrame:
    """How many live entries pass the guard of each question: counted by key first, so a hot key is one row."""
    keys = ["metrics_key", "periods_key", "direction", "negation", "ask", "corpus_version"]
    s = _slots(_entries(spark, d))
    live = C.live(s, NOW).groupBy(*keys).agg(F.count("*").alias("live"))
    return s.where("metrics_key <> ''").join(live, keys).select("entry_id", "live")


@R.add(f"with {_ENTRIES} select corpus_version, sum(case when expires_at <= {NOW} then 1 else 0 end)::bigint as expired, sum(case when expires_at > {NOW} and corpus_version <> '{VERSION}' then 1 else 0 end)::bigint as stale, count(*) as entries from c group by corpus_version")
def cache_sweep(spark: SparkSession, d: str) -> DataFrame:
    c = _entries(spark, d)
    return c.groupBy("corpus_version").agg(
        F.coalesce(F.sum((F.col("expires_at") <= NOW).cast("long")), F.lit(0)).alias("expired"),
        F.sum(((F.col("expires_at") > NOW) & (F.col("corpus_version") != VERSION)).cast("long")).alias("stale"), F.count("*").alias("entries"),
    )


@R.add(f"with {_ENTRIES} select answer_class, count(*) as kept from c where answer_class <> 'negative' and corpus_version = '{VERSION}' group by answer_class")
def cache_purge(spark: SparkSession, d: str) -> DataFrame:
    """What is left after a purge of one class and of other versions."""
    return _entries(spark, d).where((F.col("answer_class") != "negative") & (F.col("corpus_version") == VERSION)).groupBy("answer_class").agg(F.count("*").alias("kept"))


_DECAYED = f"cast(greatest(lfu_counter - floor(greatest({NOW} - last_hit_at, 0) / {DAY}), 0) as integer)"


@R.add(f"with {_ENTRIES} select entry_id, {_DECAYED} as decayed, expires_at from c order by decayed desc, expires_at, entry_id limit 20 offset 20")
def cache_entries(spark: SparkSession, d: str) -> DataFrame:
    """The second page of entries by decayed use."""
    c = _entries(spark, d).select("entry_id", C.decayed(F.col("lfu_counter"), F.col("last_hit_at"), F.lit(NOW), DAY).alias("decayed"), "expires_at")
    return c.orderBy(F.col("decayed").desc(), "expires_at", "entry_id").offset(20).limit(20)


@R.add(f"""with {_ENTRIES} select answer_class, count(*) as entries, sum(case when expires_at <= {NOW} then 1 else 0 end)::bigint as expired, round(avg(case when hit_count > 0 then 1.0 else 0.0 end), 6) as hit_rate, max(hit_count) as most from c group by answer_class""")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).groupBy("answer_class").agg(
        F.count("*").alias("entries"), F.sum((F.col("expires_at") <= NOW).cast("long")).alias("expired"), F.round(F.avg((F.col("hit_count") > 0).cast("double")), 6).alias("hit_rate"), F.max("hit_count").alias("most")
    )


@R.add(f"with {_ENTRIES} select entry_id, lfu_counter, {_DECAYED} as decayed from c")
def lfu_decay(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("entry_id", "lfu_counter", C.decayed(F.col("lfu_counter"), F.col("last_hit_at"), F.lit(NOW), DAY).alias("decayed"))


@R.add(f"with {_ENTRIES} select lfu_counter, count(*) as n, round(case when lfu_counter >= 255 then 0.0 else 1.0 / (greatest(lfu_counter - 5, 0) * 10 + 1) end, 9) as chance from c group by lfu_counter")
def lfu_prob(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).groupBy("lfu_counter").agg(F.count("*").alias("n")).withColumn("chance", F.round(C.increment_chance(F.col("lfu_counter")), 9))


@R.add(f"""with {_ENTRIES}, v as (select *, {_DECAYED} as decayed, coalesce(corpus_version <> '{VERSION}', true) as stale from c),
n as (select *, row_number() over (partition by intent order by stale desc, decayed, expires_at nulls first, entry_id) as turn from v) select intent, entry_id, stale, decayed, cast(turn as integer) as turn from n where turn <= 3""")
def choose_victim(spark: SparkSession, d: str) -> DataFrame:
    """The three entries of each intent that would be evicted first."""
    v = C.victims(_entries(spark, d), NOW, DAY, VERSION, "intent", 3)
    return v.select("intent", "entry_id", F.coalesce("stale", F.lit(True)).alias("stale"), "decayed", "turn")


@R.add(f"""with {_ENTRIES}, u as (select entry_id, corpus_version, hit_count, created_at, 0 as src from c union all select entry_id, '{VERSION}', hit_count + 1, created_at + {DAY}, 1 from c where hit_count > 5),
n as (select *, row_number() over (partition by entry_id order by created_at desc nulls last, hit_count desc nulls last, src desc) as k from u) select entry_id, corpus_version, hit_count, created_at from n where k = 1""")
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Entries after popular ones were written again a day later."""
    c = _entries(spark, d).select("entry_id", "corpus_version", "hit_count", "created_at")
    again = c.where("hit_count > 5").select("entry_id", F.lit(VERSION).alias("corpus_version"), (F.col("hit_count") + 1).alias("hit_count"), (F.col("created_at") + DAY).alias("created_at"))
    return C.upsert(c, again, "entry_id", ["created_at", "hit_count"])


@R.add(f"""with {_ENTRIES}, t as (select entry_id, answer_class, case when answer_class = 'time_anchored' then {DAY} when answer_class = 'negative' then {DAY // 4} when answer_class = 'filed_fact' then {30 * DAY} else {7 * DAY} end as ttl, created_at from c)
select entry_id, answer_class, created_at + ttl as expires_at, least(created_at + ttl, created_at + 3600) as l1_expires_at from t""")
def ttl_expiry(spark: SparkSession, d: str) -> DataFrame:
    c = _entries(spark, d)
    k = F.col("answer_class")
    ttl = F.when(k == "time_anchored", DAY).when(k == "negative", DAY // 4).when(k == "filed_fact", 30 * DAY).otherwise(7 * DAY)
    end = F.col("created_at") + ttl
    return c.select("entry_id", "answer_class", end.alias("expires_at"), F.least(end, F.col("created_at") + 3600).alias("l1_expires_at"))


@R.add("""select distinct substr(sha256(coalesce(answer, '') || '|large'), 1, 32) as memo, length(answer) as chars from cached_answers a
where answer is not null and not exists (select 1 from golden g where sha256(g.reference_answer || '|large') = sha256(coalesce(a.answer, '') || '|large'))""")
def memo_misses(spark: SparkSession, d: str) -> DataFrame:
    """Contents not yet in the memo, by hash of content and model."""
    def memo(c: str) -> Column:
        return F.sha2(F.concat(F.coalesce(F.col(c), F.lit("")), F.lit("|large")), 256)

    new = table(spark, d, "cached_answers").where(F.col("answer").isNotNull()).select(memo("answer").alias("h"), F.length("answer").cast("long").alias("chars")).distinct()
    known = table(spark, d, "golden").where(F.col("reference_answer").isNotNull()).select(memo("reference_answer").alias("h"))
    return new.join(known, "h", "left_anti").select(F.substring("h", 1, 32).alias("memo"), "chars").distinct()


@R.add("select entry_id, substr(sha256(concat_ws('|', lower(question), intent, corpus_version)), 1, 32) as key32, sha256(lower(question)) as l1_key from (select distinct entry_id, question, intent, corpus_version from cached_answers)")
def entry_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cached_answers").select("entry_id", "question", "intent", "corpus_version").distinct()
    return c.select("entry_id", F.substring(F.sha2(F.concat_ws("|", F.lower("question"), "intent", "corpus_version"), 256), 1, 32).alias("key32"), F.sha2(F.lower("question"), 256).alias("l1_key"))


@R.add("""with p as (select v.vec_id, v.label, q.vec_id as query_id, list_inner_product(cast(v.embedding as double[]), cast(q.embedding as double[]))
 / (sqrt(list_inner_product(cast(v.embedding as double[]), cast(v.embedding as double[]))) * sqrt(list_inner_product(cast(q.embedding as double[]), cast(q.embedding as double[])))) as sim
 from embeddings q join embeddings v on q.vec_id % 100 = 0 and q.label = v.label and v.vec_id <> q.vec_id),
b as (select *, row_number() over (partition by query_id order by sim desc, vec_id) as rn, count(*) over (partition by query_id) as candidates from p)
select query_id, candidates, case when sim >= 0.3 then vec_id end as hit, round(sim, 6) as best from b where rn = 1""")
def semantic_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Guard on equal labels, then the nearest entry, then the threshold."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("_q"))
    pairs = q.join(v, "label").where("vec_id <> query_id").withColumn("sim", V.cosine("embedding", "_q"))
    best = pairs.groupBy("query_id").agg(F.count("*").alias("candidates"), F.max(F.struct("sim", (-F.col("vec_id")).alias("neg"))).alias("b"))
    return best.select("query_id", "candidates", F.when(F.col("b.sim") >= 0.3, -F.col("b.neg")).alias("hit"), F.round("b.sim", 6).alias("best"))


@R.add("""with e as (select distinct event_type from events), i as (select distinct label from embeddings) select event_type, label, event_type || '-' || label as pair from e, i""")
def pair_generator(spark: SparkSession, d: str) -> DataFrame:
    """Every identity of two small lists: a product of a handful of distinct values."""
    kinds = table(spark, d, "events").select("event_type").distinct()
    labels = table(spark, d, "embeddings").select("label").distinct()
    return kinds.crossJoin(F.broadcast(labels)).select("event_type", "label", F.concat_ws("-", "event_type", F.col("label").cast("string")).alias("pair"))


@R.add("""with g as (select distinct id, lower(regexp_extract(question, '(?i)^(?:give|how much was|what was|what were) (.*?) (?:of|for|at) ', 1)) as item, expected.fiscal_year as fy from golden where expected.value is not null),
k as (select item, fy, id, row_number() over (partition by item, fy order by id) as n from g where item <> '')
select a.item, a.fy, a.id as a, b.id as b from k a join k b on a.item = b.item and a.fy is not distinct from b.fy and b.n = a.n + 1""")
def paraphrase_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Questions about one item and year, as a chain through each group, not as all its pairs."""
    item = F.lower(F.regexp_extract("question", r"(?i)^(?:give|how much was|what was|what were) (.*?) (?:of|for|at) ", 1))
    g = table(spark, d, "golden").where(F.col("expected.value").isNotNull()).select("id", item.alias("item"), F.col("expected.fiscal_year").alias("fy")).distinct().where("item <> ''")
    after = Window.partitionBy("item", "fy").orderBy("id")
    return g.withColumn("b", F.lead("id").over(after)).where("b is not null").select("item", "fy", F.col("id").alias("a"), "b")


@R.add("""with e as (select event_id, user_id, cast(floor(epoch(ts)) as bigint) as "at" from events) select user_id, "at", event_id, count(*) over (partition by user_id order by "at" range between 3600 preceding and current row) as offered from e""")
def offered_load(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a user in the hour up to each."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return e.withColumn("offered", F.count("*").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-3600, 0)))


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("identity"), "user_id", "value")
    return e.withColumn("shard", F.pmod(F.xxhash64("identity"), F.lit(4)).cast("int"))


@R.add()
def cache_replay(spark: SparkSession, d: str) -> DataFrame:
    """Hits of five policies at three capacities over the event log, a cache in four shards."""
    arms = spark.createDataFrame([(p, c) for p in C.POLICIES for c in (10, 40, 100)], "policy string, capacity int")
    by = C.replay(_log(spark, d).select("shard", "at", "seq", "identity"), arms, ttl=3 * DAY)
    return by.groupBy("policy", "capacity").agg(*[F.sum(x).alias(x) for x in ("queries", "hits", "misses", "expired", "evictions")])


def _questions_log(spark: SparkSession, d: str) -> DataFrame:
    """Cached questions as a query log: guarded by intent and the years they name, alike by their words."""
    q = table(spark, d, "cached_answers").where("question is not null and created_at is not null").select("entry_id", "question", "intent", "created_at").distinct()
    words = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    years = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("question", F.lit("(20[0-9]{2})"), F.lit(1)))), ",")
    q = q.withColumn("w", words).withColumn("guard", F.concat_ws("|", F.coalesce("intent", F.lit("")), years))
    places = F.transform("w", lambda x: F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.size(F.filter("_p", lambda p: p == i)).cast("double"))
    q = q.withColumn("_p", places).withColumn("_c", counts)
    q = q.withColumn("_n", F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x)))
    vector = F.when(F.col("_n") > 0, F.transform("_c", lambda x: (x / F.col("_n")).cast("float")))
    return q.select(
        F.pmod(F.xxhash64("guard"), F.lit(4)).cast("int").alias("shard"), F.col("created_at").alias("at"), F.xxhash64("entry_id").alias("seq"), F.lower(F.trim("question")).alias("text"),
        F.array_join(F.array_sort("w"), " ").alias("identity"), "guard", vector.alias("vector"), F.when(years == "", 0.9).otherwise(0.85).alias("least"), F.lit(30 * DAY).cast("long").alias("ttl"),
    )


def replay_rates(spark: SparkSession, d: str) -> DataFrame:
    """Nine policies at three capacities over the log of cached questions, a cache in four shards."""
    return P.policy_rates(P.replay_semantic(_questions_log(spark, d), [10, 40, 100]))


@R.add()
def semantic_replay(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the exact and the semantic tier, correct, wrong and stale ones, by policy and capacity."""
    return replay_rates(spark, d).select("policy", "capacity", *P.COUNTS, *[F.round(f"{x}_rate", 6).alias(f"{x}_rate") for x in ("hit", "correct", "wrong", "stale")])


@R.add()
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Requests let through at two an hour and user."""
    done = C.rate_limited(_log(spark, d).select("user_id", "at", "seq"), "user_id", limit=2, window=3600)
    return done.groupBy("user_id").agg(F.count("*").alias("offered"), F.sum(F.col("accepted").cast("long")).alias("accepted"), F.max("retry_after").alias("longest_wait"))


@R.add()
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Waiting time by user under a bucket of 60 units an hour."""
    log = _log(spark, d).select("user_id", "at", "seq", F.coalesce(F.abs("value"), F.lit(0.0)).alias("cost"))
    done = C.token_bucket(log, "user_id", rate=60 / 3600, burst=100.0)
    return done.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("wait"), 3).alias("longest"), F.round(F.avg("wait"), 3).alias("mean"))
