"""Queries of retrieval, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import retrieval as R
from ..operators import statistics as S
from ..session import use_shared_folder
from ..sources.tables import spread, table

TOP = 10
POOL = 30
FINAL = 8


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Every golden question whose number is divisible by 100."""
    number = F.expr("try_cast(substring(id, 2) as bigint)")
    return table(spark, d, "golden").select(number.alias("query_id"), "question").where("query_id % 100 = 0").distinct()


def _query_terms(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(_questions(spark, d), "query_id", "question").withColumnRenamed("tf", "qtf")


_TOKENS_SQL = f"""
raw as (select doc_id, unnest(regexp_extract_all(lower(text), '{X.TOKEN.replace("'", "''")}')) as tok from documents),
forms as (
  select doc_id, unnest(case
    when regexp_matches(tok, '{X.NUMBER}') then case when replace(tok, ',', '') like '$%' then [replace(tok, ',', ''), substr(replace(tok, ',', ''), 2)] else [replace(tok, ',', '')] end
    when regexp_matches(tok, '[-'']') then list_concat([tok], [w for w in regexp_split_to_array(tok, '[-'']') if w <> ''])
    else [tok] end) as term from raw),
posts as (select doc_id, term, count(*) as tf from forms group by all),
docs as (select d.doc_id, coalesce(sum(p.tf), 0) as dl from (select distinct doc_id from documents) d left join posts p using (doc_id) group by all),
qraw as (select query_id, unnest(regexp_extract_all(lower(question), '{X.TOKEN.replace("'", "''")}')) as tok
  from (select distinct try_cast(substr(id, 2) as bigint) as query_id, question from golden) where query_id % 100 = 0),
qforms as (
  select query_id, unnest(case
    when regexp_matches(tok, '{X.NUMBER}') then case when replace(tok, ',', '') like '$%' then [replace(tok, ',', ''), substr(replace(tok, ',', ''), 2)] else [replace(tok, ',', '')] end
    when regexp_matches(tok, '[-'']') then list_concat([tok], [w for w in regexp_split_to_array(tok, '[-'']') if w <> ''])
    else [tok] end) as term from qraw),
qterms as (select query_id, term, count(*) as qtf from qforms group by all),
size as (select count(*) as n_docs, avg(dl) as avgdl from docs),
raws as (select term, count(*) as df, ln(max(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from posts, size group by term),
terms as (select term, df, case when raw < 0 then {R.EPSILON} * (select avg(raw) from raws) else raw end as idf from raws),
scores as (
  select query_id, doc_id, sum(qtf * idf * tf * {R.K1 + 1} / (tf + {R.K1} * (1 - {R.B} + {R.B} * dl / avgdl))) as score
  from posts join qterms using (term) join terms using (term) join docs using (doc_id), size group by all),
sparse as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from scores where score > 0),
cells as (select doc_id, cast(('0x' || substr(md5(term), 1, 6)) as bigint) % 256 as bucket, cast(sum(tf) as double) as c from posts group by all),
vecs as (select doc_id, bucket, c / sqrt(sum(c * c) over (partition by doc_id)) as weight from cells),
qcells as (select query_id, cast(('0x' || substr(md5(term), 1, 6)) as bigint) % 256 as bucket, cast(sum(qtf) as double) as c from qterms group by all),
qvecs as (select query_id, bucket, c / sqrt(sum(c * c) over (partition by query_id)) as weight from qcells),
dots as (select query_id, doc_id, sum(vecs.weight * qvecs.weight) as score from vecs join qvecs using (bucket) group by all),
dense as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from dots)"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    """Postings of all documents, written once to the shared folder: every retriever reads them several times."""
    use_shared_folder(spark)
    return R.postings(_documents(spark, d), "doc_id").checkpoint()


def _sparse(spark: SparkSession, d: str, posts: DataFrame) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return R.bm25(posts, R.lengths(posts, docs, "doc_id"), _query_terms(spark, d), "doc_id")


def _dense(spark: SparkSession, d: str, posts: DataFrame, k: int, only: DataFrame | None = None) -> DataFrame:
    """The k best texts of each question, of all or of ``only``, by cosine of hashed term vectors: a deterministic stand-in for an embedding model."""
    vectors = V.packed_terms(posts if only is None else posts.join(only, "doc_id", "left_semi"), "doc_id")
    asked = V.packed_terms(_query_terms(spark, d).withColumnRenamed("qtf", "tf"), "query_id").withColumnRenamed("query_id", "doc_id")
    return V.exact_topk(spark, vectors, asked, k, "doc_id", "v", V.sparse_matrix(256), digits=9).where(F.col("score") > 0)


def finance_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its number of documents and occurrences."""
    return R.postings(_documents(spark, d), "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    posts = _index(spark, d)
    sizes = R.lengths(posts, table(spark, d, "documents").select("doc_id"), "doc_id").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"), F.round(F.avg("dl"), 6).alias("avgdl"))
    return sizes.crossJoin(posts.groupBy("term").agg(F.count("*").alias("df")).agg(F.count("*").alias("n_terms"), F.max("df").alias("max_df")))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(_sparse(spark, d, _index(spark, d)), "doc_id", TOP).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return V.exact_topk(spark, vectors, vectors.where("vec_id % 100 = 0"), TOP).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    posts = _index(spark, d)
    lists = R.ranked(_sparse(spark, d, posts), "doc_id", POOL).unionByName(_dense(spark, d, posts, POOL))
    return R.rrf(lists, "doc_id").select("query_id", "doc_id", F.round("rrf", 9).alias("rrf"), "n_lists", "best_rank")


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Fused pool of both retrievers; queries whose filter leaves under three results run without it."""
    docs = _documents(spark, d)
    rare = docs.where(R.where({"$and": [{"lang": {"$in": ["de", "fr"]}}, {"source": "bulletin"}]})).select("doc_id")
    # The lexical scores are read several times; they are written once to the shared folder.
    posts = _index(spark, d)
    sparse = _sparse(spark, d, posts).checkpoint()
    # Dense filters before taking k; sparse takes four times k and filters then.
    dense_lists = R.with_retry(_dense(spark, d, posts, POOL, only=rare), _dense(spark, d, posts, POOL), "doc_id")
    wide = R.ranked(sparse, "doc_id", 4 * POOL).join(rare, "doc_id", "left_semi").drop("rank")
    sparse_lists = R.with_retry(R.ranked(wide, "doc_id", POOL), R.ranked(sparse, "doc_id", POOL), "doc_id")
    both = dense_lists.withColumn("side", F.lit("dense")).unionByName(sparse_lists.withColumn("side", F.lit("bm25")))
    fused = both.groupBy("query_id", "doc_id").agg(
        F.sum(1 / (R.RRF_K + F.col("rank"))).alias("rrf"), F.min(F.when(F.col("side") == "dense", F.col("rank"))).alias("dense_rank"),
        F.min(F.when(F.col("side") == "bm25", F.col("rank"))).alias("bm25_rank"),
    )
    order = Window.partitionBy("query_id").orderBy(F.round("rrf", 9).desc(), "doc_id")
    source = F.when(F.col("dense_rank").isNull(), "bm25").when(F.col("bm25_rank").isNull(), "dense").otherwise("both")
    return fused.withColumn("position", F.row_number().over(order)).where(F.col("position") <= FINAL).select(
        "query_id", "doc_id", F.round("rrf", 6).alias("rrf"), "dense_rank", "bm25_rank", source.alias("source"), "position"
    )


def where_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that pass a metadata filter, by section."""
    chunks = table(spark, d, "chunks").select("chunk_id", "modality", "section", "page", "token_count").distinct()
    test = R.where({"$and": [{"modality": {"$in": ["text", "table"]}}, {"section": {"$eq": "form_10k"}}]})
    return chunks.where(test).groupBy("modality", "section").agg(F.count("*").alias("n"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def inspect_filter(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return chunks.where(R.where({"$and": [{"modality": "row_fact"}, {"subsection": {"$in": ["governance", "letter"]}}]})).select("chunk_id", "section", "subsection", "page", "line_item_norm").distinct()


def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10, reciprocal rank and hit rate of exact search; relevant are vectors of the same label."""
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 100 = 0")
    found = V.exact_topk(spark, vectors.select("vec_id", "embedding"), asked.select("vec_id", "embedding"), TOP + 1).where("query_id <> vec_id")
    labels = vectors.select(F.col("vec_id"), "label")
    sizes = labels.groupBy("label").agg((F.count("*") - 1).alias("relevant"))
    lines = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= TOP)
    right = lines.join(labels, "vec_id").join(asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id")
    per = right.groupBy("query_id", F.col("want").alias("label")).agg(F.sum((F.col("label") == F.col("want")).cast("int")).alias("hits"), F.min(F.when(F.col("label") == F.col("want"), F.col("rank"))).alias("first"))
    per = per.join(sizes, "label")
    return per.select("query_id", F.round(F.try_divide("hits", F.least(F.col("relevant"), F.lit(TOP))), 6).alias("recall"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), (F.col("hits") > 0).alias("hit"))


def cosine_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every vector with the mean vector of each label."""
    vectors = table(spark, d, "embeddings")
    cells = vectors.select("vec_id", "label", F.posexplode("embedding").alias("pos", "x"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = means.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("len"))
    dots = cells.drop("label").join(means, "pos").groupBy("vec_id", "label").agg(F.sum(F.col("x").cast("double") * F.col("m")).alias("dot"), F.sqrt(F.sum(F.col("x").cast("double") * F.col("x").cast("double"))).alias("vlen"))
    return dots.join(length, "label").select("vec_id", "label", F.round(F.col("dot") / F.greatest(F.col("vlen") * F.col("len"), F.lit(1e-12)), 6).alias("cosine"))


def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of a locality-sensitive index against exact search, over the stated query set."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    vectors = table(spark, d, "embeddings").select("vec_id", "embedding").distinct()
    exact = V.exact_topk(spark, vectors, vectors.where("vec_id % 100 = 0"), TOP).select("query_id", "vec_id")
    dense = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    # The index is fitted without looking at rows; every row is hashed.
    index = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=1.2, numHashTables=12, seed=5).fit(dense)
    near = index.approxSimilarityJoin(dense.where("vec_id % 100 = 0"), dense, 2.0, "dist").select(F.col("datasetA.vec_id").alias("query_id"), F.col("datasetB.vec_id").alias("vec_id"), "dist")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))).where(F.col("rank") <= TOP)
    hits = exact.join(ranked.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg(F.round(F.sum(F.coalesce("hit", F.lit(0))) / F.count("*"), 6).alias("recall"))


def expand_parents(spark: SparkSession, d: str) -> DataFrame:
    """Every row fact pulls in the table parts of its statement; of several that pull a part the first by page counts."""
    chunks = table(spark, d, "chunks").select("chunk_id", "modality", "parent_id", "table_part", "filing_id", "page").distinct()
    # The page is the rank, ties go by chunk_id: no window over a filing is needed.
    ranked = chunks.where("modality = 'row_fact'").select(F.col("filing_id").alias("query_id"), "chunk_id", F.col("page").alias("rank"))
    parts = chunks.where("modality = 'table' and parent_id is not null").select("parent_id", F.col("chunk_id").alias("part_id"), F.col("table_part").alias("part_no")).distinct()
    return R.expand_parents(ranked, chunks.where("modality = 'row_fact'").select("chunk_id", "parent_id").distinct(), parts)


def _pool(spark: SparkSession, d: str) -> DataFrame:
    posts = _index(spark, d)
    sparse = R.ranked(_sparse(spark, d, posts), "doc_id", POOL).select("query_id", "doc_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    dense = _dense(spark, d, posts, POOL).select("query_id", "doc_id", F.col("rank").alias("dense_rank"))
    both = sparse.join(dense, ["query_id", "doc_id"], "full")
    gain = F.coalesce(1 / (R.RRF_K + F.col("bm25_rank")), F.lit(0.0)) + F.coalesce(1 / (R.RRF_K + F.col("dense_rank")), F.lit(0.0))
    pool = both.withColumn("rrf", gain)
    return pool.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("rrf", 9).desc(), "doc_id")))


_POOL_SQL = f"""{_TOKENS_SQL},
pool0 as (select query_id, doc_id, s.rank as bm25_rank, s.score as bm25_score, e.rank as dense_rank,
   coalesce(1 / ({R.RRF_K} + s.rank), 0.0) + coalesce(1 / ({R.RRF_K} + e.rank), 0.0) as rrf
  from (select * from sparse where rank <= {POOL}) s full join (select * from dense where rank <= {POOL}) e using (query_id, doc_id)),
pool as (select *, row_number() over (partition by query_id order by round(rrf, 9) desc, doc_id) as position from pool0)"""


def rerank_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether reranking can be skipped: few candidates, or one that leads both lists by 30 per cent."""
    pool = _pool(spark, d)
    per = pool.groupBy("query_id").agg(
        F.count("*").alias("fused"), F.max(F.when(F.col("position") == 1, F.col("rrf"))).alias("top"), F.max(F.when(F.col("position") == 2, F.col("rrf"))).alias("second"),
        F.max(((F.col("position") == 1) & (F.col("bm25_rank") == 1) & (F.col("dense_rank") == 1)).cast("int")).alias("leads"),
    )
    gate = F.when(F.col("fused") <= FINAL, "S2").when((F.coalesce("leads", F.lit(0)) == 1) & (F.col("second").isNull() | (F.col("top") >= F.col("second") * 1.3)), "S3").otherwise("none")
    return per.select("query_id", "fused", gate.alias("gate"))


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    # A deterministic stand-in for a cross-encoder: the lexical score, log-scaled.
    score = F.round(F.log(F.coalesce("bm25_score", F.lit(0.0)) + 0.5), 4)
    return _pool(spark, d).where(F.col("position") <= POOL).withColumn("rerank_score", score)


def rerank_floor(spark: SparkSession, d: str) -> DataFrame:
    return R.floor_and_keep(_reranked(spark, d), "doc_id", 1.2, 3, FINAL).select("query_id", "doc_id", "rerank_score", "rerank_rank")


def rerank_apply(spark: SparkSession, d: str) -> DataFrame:
    """How far reranking moves each kept candidate."""
    kept = R.floor_and_keep(_reranked(spark, d), "doc_id", 0.0, 2, FINAL)
    return kept.select("query_id", "doc_id", "position", "rerank_rank", (F.col("position") - F.col("rerank_rank")).alias("moved"))


def expand_queries(spark: SparkSession, d: str) -> DataFrame:
    """Variants of each question, without repeats, at most four: itself, without its period, its line item alone."""
    asked = table(spark, d, "golden").select("id", "question").where(F.col("question").isNotNull()).distinct()
    bare = X.collapse(F.regexp_replace("question", r"(?i)(,? ?(in|for|,) ?(fiscal|fy)? ?[0-9]{4}|, fy[0-9]{4})", " "))
    item = F.lower(F.regexp_extract("question", r"(?i)^(?:give|how much was|what was|what were|report) (.*?) (?:of|for|at) ", 1))
    variants = asked.select("id", F.posexplode(F.array(X.collapse(F.col("question")), bare, F.lower(bare), item)).alias("pos", "variant")).where("variant <> ''")
    first = variants.groupBy("id", "variant").agg(F.min("pos").alias("pos"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where("n <= 4").select("id", "n", "variant")


def context_order(spark: SparkSession, d: str) -> DataFrame:
    """Context blocks of each filing: row facts, then tables, text, figures; by page within each."""
    chunks = table(spark, d, "chunks").select("filing_id", "chunk_id", "modality", "page").distinct()
    place = F.array_position(F.array(*[F.lit(x) for x in ("row_fact", "table", "text", "figure")]), F.col("modality"))
    # One page of one modality is a slice; a null page comes last.
    placed = chunks.withColumn("_place", place).withColumn("_no_page", F.col("page").isNull())
    numbered = S.numbered_within(placed, ["filing_id"], ["_place", "_no_page", "page"], ["chunk_id"], "position")
    return numbered.select("filing_id", "chunk_id", "modality", F.col("position").cast("int").alias("position"))


def budget_fill(spark: SparkSession, d: str) -> DataFrame:
    """Context of each question within 300 size tokens; what does not fit is skipped."""
    pool = _pool(spark, d).where(F.col("position") <= POOL).join(_documents(spark, d).select("doc_id", X.token_estimate(F.col("text")).alias("tokens")), "doc_id")
    return R.fill_budget(pool.select("query_id", "position", "doc_id", "tokens"), "query_id", ["position", "doc_id"], "tokens", 300)


def answer_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Best lexical and fused score of each question and its five first passages."""
    pool = _pool(spark, d).where("position <= 5")
    return pool.groupBy("query_id").agg(F.round(F.max("bm25_score"), 6).alias("best_bm25"), F.round(F.max("rrf"), 6).alias("best_rrf"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("passages"))


def tier_pick(spark: SparkSession, d: str) -> DataFrame:
    """Up to two figures a filing: with a caption line of its own, else on the first page with any, else any."""
    figures = table(spark, d, "chunks").where("modality = 'figure'").select("filing_id", "chunk_id", "page", "document", "figure_type").distinct()
    first = Window.partitionBy("filing_id")
    tier = F.when(F.col("document").isNotNull() & (F.col("figure_type") == "chart"), 1).when(F.col("page") == F.min("page").over(first), 2).otherwise(3)
    tiers = figures.withColumn("tier", tier)
    tiers = tiers.withColumn("_d", F.dense_rank().over(Window.partitionBy("filing_id").orderBy("tier"))).where("_d = 1")
    return tiers.withColumn("n", F.row_number().over(Window.partitionBy("filing_id").orderBy("page", "chunk_id"))).where("n <= 2").select("filing_id", "chunk_id", "tier", "n")


_EXACT_SQL = f"""
pairs as (select q.vec_id as query_id, v.vec_id, list_inner_product(cast(v.embedding as double[]), cast(q.embedding as double[]))
   / greatest(sqrt(list_inner_product(cast(v.embedding as double[]), cast(v.embedding as double[]))) * sqrt(list_inner_product(cast(q.embedding as double[]), cast(q.embedding as double[]))), 1e-12) as score
  from embeddings v, embeddings q where q.vec_id % 100 = 0),
near as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)"""

QUERIES = {
    f.__name__: f
    for f in (
        finance_tokens, bm25_stats, bm25_topk, dense_topk, rrf_fusion, hybrid_topk, where_filter, inspect_filter, recall_mrr, cosine_matrix, ann_recall, expand_parents,
        rerank_gate, rerank_floor, rerank_apply, expand_queries, context_order, budget_fill, answer_metrics, tier_pick,
    )
}

ORACLE = {
    "finance_tokens": f"with {_TOKENS_SQL} select term, count(*) as df, cast(sum(tf) as bigint) as cf from posts group by term",
    "bm25_stats": f"with {_TOKENS_SQL}, d as (select term, count(*) as df from posts group by term) select (select count(*) from docs) as n_docs, (select cast(sum(dl) as bigint) from docs) as n_tokens, (select round(avg(dl), 6) from docs) as avgdl, count(*) as n_terms, max(df) as max_df from d",
    "bm25_topk": f"with {_TOKENS_SQL} select query_id, doc_id, round(score, 6) as score, cast(rank as integer) as rank from sparse where rank <= {TOP}",
    "dense_topk": f"with {_EXACT_SQL} select query_id, vec_id, round(score, 6) as score, cast(rank as integer) as rank from near where rank <= {TOP}",
    "rrf_fusion": f"with {_TOKENS_SQL} select query_id, doc_id, round(sum(1 / ({R.RRF_K} + rank)), 9) as rrf, count(*) as n_lists, cast(min(rank) as integer) as best_rank from (select query_id, doc_id, rank from sparse where rank <= {POOL} union all select query_id, doc_id, rank from dense where rank <= {POOL}) group by all",
    "hybrid_topk": f"""with {_TOKENS_SQL},
rare as (select doc_id from documents where lang in ('de', 'fr') and source = 'bulletin'),
df as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from dots where doc_id in (select doc_id from rare)),
dn as (select query_id from df where rank <= {POOL} group by 1 having count(distinct doc_id) >= 3),
dl as (select * from df where rank <= {POOL} and query_id in (select query_id from dn) union all select query_id, doc_id, rank from dense where rank <= {POOL} and query_id not in (select query_id from dn)),
sf as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from sparse where rank <= {4 * POOL} and doc_id in (select doc_id from rare)),
sn as (select query_id from sf where rank <= {POOL} group by 1 having count(distinct doc_id) >= 3),
sl as (select * from sf where rank <= {POOL} and query_id in (select query_id from sn) union all select query_id, doc_id, rank from sparse where rank <= {POOL} and query_id not in (select query_id from sn)),
fused as (select query_id, doc_id, sum(1 / ({R.RRF_K} + rank)) as rrf, min(case when side = 'dense' then rank end) as dense_rank, min(case when side = 'bm25' then rank end) as bm25_rank
  from (select *, 'dense' as side from dl union all select *, 'bm25' as side from sl) group by all)
select query_id, doc_id, round(rrf, 6) as rrf, cast(dense_rank as integer) as dense_rank, cast(bm25_rank as integer) as bm25_rank,
  case when dense_rank is null then 'bm25' when bm25_rank is null then 'dense' else 'both' end as source, cast(position as integer) as position
from (select *, row_number() over (partition by query_id order by round(rrf, 9) desc, doc_id) as position from fused) where position <= {FINAL}""",
    "where_filter": "select modality, section, count(*) as n, min(page) as first_page, max(page) as last_page from (select distinct chunk_id, modality, section, page, token_count from chunks) where modality in ('text', 'table') and section = 'form_10k' group by all",
    "inspect_filter": "select distinct chunk_id, section, subsection, page, line_item_norm from chunks where modality = 'row_fact' and subsection in ('governance', 'letter')",
    "recall_mrr": f"""with {_EXACT_SQL}, found as (select query_id, vec_id, row_number() over (partition by query_id order by rank) as rank from near where rank <= {TOP + 1} and query_id <> vec_id),
per as (select f.query_id, q.label, sum(case when v.label = q.label then 1 else 0 end) as hits, min(case when v.label = q.label then rank end) as first
  from found f join embeddings v using (vec_id) join embeddings q on q.vec_id = f.query_id where rank <= {TOP} group by all),
sizes as (select label, count(*) - 1 as relevant from embeddings group by label)
select query_id, round(hits / nullif(least(relevant, {TOP}), 0), 6) as recall, round(coalesce(1 / first, 0.0), 6) as rr, hits > 0 as hit from per join sizes using (label)""",
    "cosine_matrix": """with cells as (select vec_id, label, generate_subscripts(embedding, 1) as pos, cast(unnest(embedding) as double) as x from embeddings),
means as (select label, pos, avg(x) as m from cells group by all), length as (select label, sqrt(sum(m * m)) as len from means group by label),
dots as (select c.vec_id, m.label, sum(c.x * m.m) as dot, sqrt(sum(c.x * c.x)) as vlen from cells c join means m using (pos) group by all)
select vec_id, label, round(dot / greatest(vlen * len, 1e-12), 6) as cosine from dots join length using (label)""",
    "expand_parents": """with c as (select distinct chunk_id, modality, parent_id, table_part, filing_id, page from chunks),
r as (select filing_id as query_id, chunk_id, row_number() over (partition by filing_id order by page nulls first, chunk_id) as rank from c where modality = 'row_fact'),
k as (select * from r), ch as (select distinct chunk_id, parent_id from c where modality = 'row_fact' and parent_id is not null),
p as (select distinct parent_id, chunk_id as part_id, table_part as part_no from c where modality = 'table' and parent_id is not null),
j as (select k.query_id, k.chunk_id, k.rank, p.part_id, p.part_no from k join ch using (chunk_id) join p using (parent_id)
  where not exists (select 1 from k o where o.query_id is not distinct from k.query_id and o.chunk_id = p.part_id)),
n as (select *, row_number() over (partition by query_id, part_id order by rank, chunk_id) as m from j)
select query_id, part_id as chunk_id, chunk_id as expanded_from, part_no from n where m = 1""",
    "rerank_gate": f"""with {_POOL_SQL}, per as (select query_id, count(*) as fused, max(case when position = 1 then rrf end) as top, max(case when position = 2 then rrf end) as second,
  max(case when position = 1 and bm25_rank = 1 and dense_rank = 1 then 1 else 0 end) as leads from pool group by query_id)
select query_id, fused, case when fused <= {FINAL} then 'S2' when leads = 1 and (second is null or top >= second * 1.3) then 'S3' else 'none' end as gate from per""",
    "rerank_floor": f"""with {_POOL_SQL}, s as (select *, round(ln(coalesce(bm25_score, 0.0) + 0.5), 4) as rerank_score from pool where position <= {POOL}),
o as (select *, row_number() over (partition by query_id order by rerank_score desc, doc_id) as rerank_rank from s)
select query_id, doc_id, rerank_score, cast(rerank_rank as integer) as rerank_rank from o where (rerank_score >= 1.2 or rerank_rank <= 3) and rerank_rank <= {FINAL}""",
    "rerank_apply": f"""with {_POOL_SQL}, s as (select *, round(ln(coalesce(bm25_score, 0.0) + 0.5), 4) as rerank_score from pool where position <= {POOL}),
o as (select *, row_number() over (partition by query_id order by rerank_score desc, doc_id) as rerank_rank from s)
select query_id, doc_id, cast(position as integer) as position, cast(rerank_rank as integer) as rerank_rank, cast(position - rerank_rank as integer) as moved from o where (rerank_score >= 0.0 or rerank_rank <= 2) and rerank_rank <= {FINAL}""",
    "expand_queries": r"""with a as (select distinct id, question from golden where question is not null),
b as (select id, trim(regexp_replace(question, '[ \t\r\n]+', ' ', 'g')) as q, trim(regexp_replace(regexp_replace(question, '(?i)(,? ?(in|for|,) ?(fiscal|fy)? ?[0-9]{4}|, fy[0-9]{4})', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as bare,
  lower(regexp_extract(question, '(?i)^(?:give|how much was|what was|what were|report) (.*?) (?:of|for|at) ', 1)) as item from a),
v as (select id, unnest([0, 1, 2, 3]) as pos, unnest([q, bare, lower(bare), item]) as variant from b),
f as (select id, variant, min(pos) as pos from v where variant <> '' group by all),
n as (select id, cast(row_number() over (partition by id order by pos) as integer) as n, variant from f) select * from n where n <= 4""",
    "context_order": """with c as (select distinct filing_id, chunk_id, modality, page from chunks),
o as (select *, row_number() over (partition by filing_id order by list_position(['row_fact', 'table', 'text', 'figure'], modality), page nulls last, chunk_id) as position from c)
select filing_id, chunk_id, modality, cast(position as integer) as position from o""",
    "answer_metrics": f"""with {_POOL_SQL} select query_id, round(max(bm25_score), 6) as best_bm25, round(max(rrf), 6) as best_rrf, string_agg(cast(doc_id as varchar), ',' order by position) as passages from pool where position <= 5 group by query_id""",
    "tier_pick": """with f as (select distinct filing_id, chunk_id, page, document, figure_type from chunks where modality = 'figure'),
t as (select *, case when document is not null and figure_type = 'chart' then 1 when page = min(page) over (partition by filing_id) then 2 else 3 end as tier from f),
k as (select *, dense_rank() over (partition by filing_id order by tier) as dr from t),
n as (select *, row_number() over (partition by filing_id order by page nulls first, chunk_id) as n from k where dr = 1)
select filing_id, chunk_id, cast(tier as integer) as tier, cast(n as integer) as n from n where n <= 2""",
}
