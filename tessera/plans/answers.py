"""Queries that check, shorten and sort answers and their context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import compression as Z
from ..operators import minhash as M
from ..operators import slots as SL
from ..operators import verification as V
from ..operators.formulas import FORMULAS
from ..session import use_shared_folder
from ..sources.tables import table
from .passages import _NUM
from .registry import Registry

R = Registry()
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}"
_TOKENS = rf"[{_UNSPACED}]|[\p{{L}}\p{{M}}\p{{N}}&&[^{_UNSPACED}]]+"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cached_answers").where("answer is not null").select("entry_id", "question", "answer").distinct()


@R.add(rf"""with c as (select distinct entry_id, question, answer from cached_answers where answer is not null), n as (select entry_id, question, unnest(regexp_extract_all(regexp_replace(answer, '\[[^\[\]]*\]', ' ', 'g'), '{_NUM}')) as tok from c),
p as (select entry_id, tok, contains(question, tok) as asked, try_cast(replace(replace(replace(tok, ',', ''), '$', ''), '%', '') as double) as x from n)
select entry_id, count(*) as numbers, sum(case when coalesce(asked, false) or (x = floor(x) and x <= 31 and not contains(tok, ',') and not contains(tok, '$')) or (x = floor(x) and x between 1900 and 2100 and not contains(tok, '$')) then 0 else 1 end)::bigint as unmatched from p group by entry_id""")
def question_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each answer that the question does not give: years and small whole numbers prove nothing."""
    found = F.regexp_extract_all(F.regexp_replace("answer", r"\[[^\[\]]*\]", " "), F.lit(f"({_NUM})"), F.lit(1))
    n = _answers(spark, d).select("entry_id", "question", F.explode(found).alias("tok")).withColumn("x", F.regexp_replace("tok", "[$,%]", "").try_cast("double"))
    whole = (F.col("x") == F.floor("x")) & ~F.contains("tok", F.lit("$"))
    fine = F.coalesce(F.contains("question", "tok"), F.lit(False)) | (whole & (F.col("x") <= 31) & ~F.contains("tok", F.lit(","))) | (whole & F.col("x").between(1900, 2100))
    return n.groupBy("entry_id").agg(F.count("*").alias("numbers"), F.sum((~F.coalesce(fine, F.lit(False))).cast("long")).alias("unmatched"))


@R.add(r"""with c as (select distinct entry_id, question, answer from cached_answers where answer is not null), y as (select entry_id, list_distinct(regexp_extract_all(question, '20[0-9]{2}')) as want, list_distinct(regexp_extract_all(answer, '20[0-9]{2}')) as got from c)
select entry_id, cast(len(want) as integer) as asked, cast(len([w for w in want if not list_contains(got, w)]) as integer) as missing from y where len(want) > 0""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Years that a question asks about and its answer leaves out."""
    years = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("(20[0-9]{2})"), F.lit(1)))
    y = _answers(spark, d).select("entry_id", years("question").alias("want"), years("answer").alias("got"))
    return y.where(F.size("want") > 0).select("entry_id", F.size("want").alias("asked"), F.size(F.array_except("want", "got")).alias("missing"))


@R.add(r"""with q as (select distinct id, lower(question) as t from golden where question is not null)
select id, case when regexp_matches(t, '\b(chart|figure|graph)\b') then 'visual' when regexp_matches(t, '\b(change|move|grow|trend|versus|vs)\b') then 'trend' when regexp_matches(t, '^(why|which|list|how did)') then 'explain' when regexp_matches(t, '^(what|how much|give|report)') then 'lookup' else 'other' end as intent,
 case when regexp_matches(t, '20[0-9]{2}') then 0.9::double else 0.6::double end as confidence from q""")
def rule_intent(spark: SparkSession, d: str) -> DataFrame:
    """Intent of a question by the first rule that fits."""
    q = table(spark, d, "golden").where("question is not null").select("id", F.lower("question").alias("t")).distinct()
    t = F.col("t")
    intent = F.when(t.rlike(r"\b(chart|figure|graph)\b"), "visual").when(t.rlike(r"\b(change|move|grow|trend|versus|vs)\b"), "trend").when(t.rlike("^(why|which|list|how did)"), "explain").when(t.rlike("^(what|how much|give|report)"), "lookup")
    return q.select("id", intent.otherwise("other").alias("intent"), F.when(t.rlike("20[0-9]{2}"), 0.9).otherwise(0.6).alias("confidence"))


@R.add("""with b as (select distinct chunk_id, substr(document, instr(document, chr(10)) + 1) as body from chunks where modality = 'text' and document is not null)
select min(chunk_id) as kept, count(*) as copies, sha256(body) as content from b group by body""")
def dedupe_merge(spark: SparkSession, d: str) -> DataFrame:
    """Text chunks with the same or nearly the same body: the first is kept and stands for all.

    Bodies are near if their runs of five words have a Jaccard similarity of 0.8; near
    ones are linked, and a class is what links reach.  ``content`` is that of the kept.
    """
    use_shared_folder(spark)
    c = table(spark, d, "chunks").where("modality = 'text' and document is not null")
    body = F.expr("substring(document, instr(document, '\\n') + 1)")
    tokens = F.regexp_extract_all(F.lower(body), F.lit(_TOKENS), F.lit(0))  # a sign is a word where none are spaced
    b = c.select("chunk_id", F.sha2(body, 256).alias("content")).distinct()
    copies = b.groupBy("content").agg(F.min("chunk_id").alias("kept"), F.count("*").alias("copies"))
    sets = c.select(F.col("chunk_id").alias("kept"), F.sha2(body, 256).alias("content"), tokens.alias("tokens")).dropDuplicates(["kept", "content"])
    # The tokens are a column by now: written into the shingles they would be cut again for each of them.
    bodies = copies.join(sets, ["kept", "content"]).select("kept", "copies", "content", F.monotonically_increasing_id().alias("id"), M.word_shingles(F.col("tokens")).alias("shingles")).checkpoint()
    links = M.near_pairs(bodies, "id", "shingles").checkpoint()
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    classed = bodies.select("id", "kept", "copies", "content").join(M.classes(ends, links, "id"), "id", "left")
    merged = classed.groupBy(F.coalesce("class", "id").alias("class")).agg(F.min(F.struct("kept", "content")).alias("_k"), F.sum("copies").alias("copies"))
    return merged.select("_k.kept", "copies", "_k.content")


def _supports(spark: SparkSession, d: str) -> DataFrame:
    """Each golden question with each chunk that supports it: id, question, answer, place, and the chunk's columns."""
    asked = table(spark, d, "golden").where("question is not null").select("id", "question", F.col("reference_answer").alias("answer"), F.posexplode("supporting_chunk_ids").alias("place", "chunk_id")).distinct()
    columns = ["chunk_id", "document", "filing_id", "page", "parent_id", "line_item", "value_fy2026", "value_fy2025", "value_fy2024"]
    return asked.join(table(spark, d, "chunks").select(*columns).distinct(), "chunk_id")


@R.add()
def verify_answers(spark: SparkSession, d: str) -> DataFrame:
    """Reference answers against the chunks that support them: numbers no chunk gives at any scale, and citations of blocks that are not there."""
    blocks = F.array_sort(F.collect_list(F.struct("place", "document")))
    given = _supports(spark, d).where("answer is not null").groupBy("id", "question", "answer").agg(blocks.alias("b"))
    given = given.withColumn("context", F.array_join("b.document", "\n")).withColumn("blocks", F.transform("b", lambda _, i: F.concat(F.lit("C"), (i + 1).cast("string"))))
    checked = V.verify(given, "answer", "question", "context", "blocks")
    return checked.select("id", "numbers_checked", F.size("unmatched").alias("unmatched"), F.size("invalid").alias("invalid"), F.array_join("issues", ",").alias("issues"), "passed")


@R.add()
def parts_answered(spark: SparkSession, d: str) -> DataFrame:
    """The facts that support a question, as its parts, and how many of them the reference answer gives."""
    value = F.array_compact(F.array(*[F.col(f"value_fy{y}") for y in (2026, 2025, 2024)]))
    parts = _supports(spark, d).where("answer is not null").select("id", "chunk_id", "line_item", V.answered(F.col("answer"), value).alias("given"))
    return parts.groupBy("id").agg(F.count("*").alias("parts"), F.sum(F.coalesce("given", F.lit(False)).cast("long")).alias("answered"), F.array_sort(F.collect_set(F.when(~F.coalesce("given", F.lit(False)), F.col("line_item")))).alias("left_out"))


#: A sentence stays in a shortened text if it has this share of the words of the question.
LEAST_SCORE = 0.25


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"({_TOKENS})"), F.lit(0)))


def _sentences(body: Column) -> Column:
    return F.filter(F.split(body, r"(?<=[.!?])\s+|(?<=[。！？])|\n+"), lambda x: F.trim(x) != "")


def _context(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Labels that each question asks of a printed table, the tables, the pages of each question, and their texts."""
    facts = _supports(spark, d).select("id", "question", "filing_id", "page", "parent_id", "line_item").distinct()
    chunks = table(spark, d, "chunks").where("document is not null").select("chunk_id", "modality", "filing_id", "page", "parent_id", "document").distinct()
    labels = facts.where("parent_id is not null").groupBy("id", "parent_id").agg(F.collect_set("line_item").alias("labels"))
    tables = chunks.where("modality = 'table'").select("chunk_id", "parent_id", F.col("document").alias("body"))
    pages = facts.select("id", "question", "filing_id", "page").distinct()
    return labels, tables, pages, chunks.where("modality = 'text'").select("chunk_id", "filing_id", "page", F.expr("substring(document, instr(document, '\n') + 1)").alias("body"))


def _shortened(spark: SparkSession, d: str) -> DataFrame:
    """Context of each question, shortened: the tables of its facts by rows, the texts on their pages by sentences."""
    labels, tables, pages, texts = _context(spark, d)
    tables = labels.join(tables, "parent_id")
    tables = tables.withColumn("r", Z.row_select(F.col("body"), F.col("labels"))).select("id", "chunk_id", F.lit("row_select").alias("action"), "body", F.col("r.text").alias("short"), F.col("r.kept").alias("kept"), F.col("r.rows").alias("parts"))
    texts = pages.join(texts, ["filing_id", "page"])
    texts = texts.withColumn("s", _sentences(F.col("body"))).withColumn("q", _words(F.col("question")))
    texts = texts.withColumn("scores", F.transform("s", lambda x: F.size(F.array_intersect(_words(x), "q")) / F.greatest(F.size("q"), F.lit(1))))
    texts = texts.withColumn("i", Z.select_sentences(F.col("scores"), LEAST_SCORE))
    texts = texts.select("id", "chunk_id", F.lit("extract").alias("action"), "body", Z.join_sentences(F.col("s"), F.col("i")).alias("short"), F.size("i").alias("kept"), F.size("s").alias("parts"))
    out = tables.unionByName(texts).withColumn("g", Z.guarded(F.col("short"), F.col("body")))
    return out.select("id", "chunk_id", "action", "body", F.col("g.text").alias("text"), F.col("g.reverted").alias("reverted"), "kept", "parts")


@R.add()
def compress_apply(spark: SparkSession, d: str) -> DataFrame:
    """Context of each question as shortened: what was kept, and size tokens before and after; a text with an invented number is put back."""
    x = _shortened(spark, d)
    return x.select("id", "chunk_id", "action", "kept", "parts", X.token_estimate(F.col("body")).alias("before"), X.token_estimate(F.col("text")).alias("after"), "reverted", "text")


def _asked(chunks: DataFrame, by: DataFrame, on: list[str]) -> DataFrame:
    """The chunks that some question meets, so that no other is read closely."""
    return chunks.join(by.select(*on).distinct().hint("merge"), on, "left_semi")


@R.add()
def fidelity(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each shortened context and whether the whole one has all of them.

    Pairs of questions and chunks grow faster than either, so bodies are read once, before they meet questions.
    """
    labels, tables, pages, texts = _context(spark, d)
    labels = labels.select("id", "parent_id", Z.wanted_labels(F.col("labels")).alias("wanted"))
    tables = _asked(tables, labels, ["parent_id"]).select("chunk_id", "parent_id", Z.table_figures(F.col("body")).alias("figures"))
    tables = tables.join(labels.hint("merge"), "parent_id").select("id", "chunk_id", Z.table_fidelity(F.col("figures"), F.col("wanted")).alias("x"))
    pages = pages.select("id", "filing_id", "page", _words(F.col("question")).alias("asked"))
    texts = _asked(texts, pages, ["filing_id", "page"]).select("chunk_id", "filing_id", "page", Z.sentence_figures(_sentences(F.col("body")), F.col("body"), _words).alias("figures"))
    texts = texts.join(pages.hint("merge"), ["filing_id", "page"]).select("id", "chunk_id", Z.sentence_fidelity(F.col("figures"), F.col("asked"), LEAST_SCORE).alias("x"))
    return tables.unionByName(texts).select("id", "chunk_id", "x.numbers", "x.faithful")


@R.add("""with f as (select distinct chunk_id, filing_id, page, line_group from chunks where modality = 'row_fact')
select chunk_id, last_value(case when line_group not in ('other', 'body') then line_group end ignore nulls) over (partition by filing_id order by page nulls first, chunk_id rows unbounded preceding) as running_group from f""")
def statement_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group a row belongs to: the last one named in its filing."""
    f = table(spark, d, "chunks").where("modality = 'row_fact'").select("chunk_id", "filing_id", "page", "line_group").distinct()
    upto = Window.partitionBy("filing_id").orderBy("page", "chunk_id").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(~F.col("line_group").isin("other", "body"), F.col("line_group"))
    return f.select("chunk_id", F.last(named, ignorenulls=True).over(upto).alias("running_group"))


@R.add()
def parse_row(spark: SparkSession, d: str) -> DataFrame:
    """Printed rows read from the right: at most three amounts, the rest is the label."""
    t = table(spark, d, "chunks").where("modality = 'table' and document is not null").select("chunk_id", F.posexplode(F.split("document", "\n")).alias("row_no", "line")).distinct()
    words = F.filter(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\s*\|\s*"), lambda x: F.trim(x) != "")
    p = t.where("row_no > 2").select("chunk_id", "row_no", words.alias("w")).where(F.size("w") > 1)
    start = F.struct(F.array().cast("array<string>").alias("values"), F.array().cast("array<string>").alias("label"))

    def step(acc, x):
        amount = F.trim(x).rlike(r"^(?:[-–—]|\(?\$?[0-9][0-9,.]*\)?%?)$") & (F.size(acc["label"]) == 0) & (F.size(acc["values"]) < 3)
        return F.struct(F.when(amount, F.concat(F.array(F.trim(x)), acc["values"])).otherwise(acc["values"]).alias("values"), F.when(amount, acc["label"]).otherwise(F.concat(F.array(F.trim(x)), acc["label"])).alias("label"))

    read = p.select("chunk_id", "row_no", F.aggregate(F.reverse("w"), start, step).alias("r"))
    return read.select("chunk_id", "row_no", F.array_join("r.label", " ").alias("label"), F.array_join("r.values", " ").alias("amounts"))


@R.add()
def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Printed tables in parts of at most 300 size tokens, each with the header and its number."""
    t = table(spark, d, "chunks").where("modality = 'table' and document is not null").select("chunk_id", "document").distinct()
    lines = F.filter(F.split("document", "\n"), lambda x: F.trim(x) != "")
    rows = t.select("chunk_id", F.slice(lines, 1, 3).alias("head"), F.slice(lines, 4, F.size(lines)).alias("body"))
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("open"))
    size = lambda a: F.ceil(F.length(F.array_join(a, "\n")) / 4)

    def step(acc, x):
        full = (size(F.concat(acc["open"], F.array(x))) + size(F.col("head")) > 300) & (F.size(acc["open"]) > 0)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, F.array(x)).otherwise(F.concat(acc["open"], F.array(x))).alias("open"))

    parts = rows.select("chunk_id", "head", F.aggregate("body", start, step, lambda a: F.concat(a["done"], F.array(a["open"]))).alias("parts"))
    out = parts.select("chunk_id", "head", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "rows"))
    return out.select("chunk_id", (F.col("part") + 1).alias("part"), "n_parts", F.array_join(F.concat("head", "rows"), "\n").alias("document"))


@R.add()
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Questions in one form: compatibility characters, blanks, dashes and marks made alike."""
    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    q = table(spark, d, "golden").where("question is not null").select("id", "question").distinct()
    t = F.lower(nfkc("question"))
    t = F.regexp_replace(F.regexp_replace(t, r"(?<![0-9])\.|\.(?![0-9])", " "), r"['’]s\b", "")
    return q.select("id", X.collapse(F.regexp_replace(F.regexp_replace(t, "[-–—/]", " "), r"[^\p{L}\p{N}.%$& ]", " ")).alias("normal"))


def _glossary(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of a question as a table: line items of the facts, names of statements, and cues of formulas."""
    facts = table(spark, d, "chunks").where("modality = 'row_fact'")
    items = facts.where("line_item is not null").select(F.lit("metric").alias("kind"), F.replace("line_item_norm", F.lit("_"), F.lit(" ")).alias("canonical"), F.lower("line_item").alias("phrase"))
    names = facts.where("statement <> 'none'").select(F.lit("statement").alias("kind"), F.col("statement").alias("canonical"), F.replace("statement", F.lit("_"), F.lit(" ")).alias("phrase"))
    cues = spark.createDataFrame([("formula", n, c) for n, f in FORMULAS.items() if not f.generic for c in f.cues], "kind string, canonical string, phrase string")
    return items.distinct().unionByName(names.distinct()).unionByName(cues)


@R.add()
def slots(spark: SparkSession, d: str) -> DataFrame:
    """Slots of each question: periods, line items, formulas, statements, direction and canonical text; what one phrase takes no other reads."""
    q = table(spark, d, "golden").where("question is not null").select("id", "question").distinct()
    return SL.read_slots(q, _glossary(spark, d), calendar=SL.Calendar({y: SL.last_sunday_of_january(y) for y in range(2019, 2029)}))


#: Rows that the scorer of popular entries is fitted on at most.
SAMPLE_ROWS = 5000


@R.add()
def train_quality(spark: SparkSession, d: str) -> DataFrame:
    """Held-out accuracy of a logistic scorer of popular entries, fitted on a bounded sample by hash."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    c = table(spark, d, "cached_answers").select("entry_id", "hit_count", "lfu_counter", "tokens_saved_est", F.length("answer").alias("chars")).distinct()
    x = F.array(F.col("lfu_counter") / 255.0, F.coalesce(F.col("tokens_saved_est") / 10000.0, F.lit(0.0)), F.coalesce(F.col("chars") / 1000.0, F.lit(0.0)))
    rows = c.select(F.pmod(F.xxhash64("entry_id"), F.lit(10)).alias("fold"), (F.col("hit_count") > 0).cast("double").alias("label"), array_to_vector(x).alias("features"), "entry_id")
    sample = rows.where("fold < 7").orderBy(F.xxhash64("entry_id"), "entry_id").limit(SAMPLE_ROWS)
    model = LogisticRegression(maxIter=30, regParam=0.01).fit(sample)
    held = model.transform(rows.where("fold >= 7"))
    return held.agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("double")), 4).alias("accuracy"), F.round(F.avg("label"), 4).alias("base"))


@R.add("""select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type; the same expression runs on a stream in ``streaming.windows``."""
    from ..streaming.windows import tumbling

    return tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day", ["event_type"], "value").select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@R.add("""with e as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '6 hours' then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from e) select user_id, min(ts) as begun, count(*) as n from s group by user_id, k""")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users, ended by six hours without an event."""
    from ..streaming.windows import sessions

    s = sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", "user_id")
    return s.select("user_id", F.col("begun").cast("timestamp_ntz").alias("begun"), "n")
