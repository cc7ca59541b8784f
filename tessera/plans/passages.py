"""Queries of layout, passages, checks of text and compression of context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import chunker as C
from ..operators import passages as P
from ..operators import statistics as S
from ..session import use_shared_folder
from ..sources.tables import table
from .registry import Registry

R = Registry()

_ELEMENTS = "e as (select distinct element_id, filing_id, order_no, type, section, subsection, page, text, bbox from elements)"


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "elements").select("element_id", "filing_id", "order_no", "type", "section", "subsection", "page", "text", "bbox").distinct()


def _in_order():
    return Window.partitionBy("filing_id").orderBy("order_no", "element_id")


def _upto():
    return _in_order().rowsBetween(Window.unboundedPreceding, 0)


@R.add(f"""with {_ELEMENTS} select element_id, last_value(case when type = 'heading' then text end ignore nulls) over (partition by filing_id order by order_no nulls first, element_id rows unbounded preceding) as heading from e""")
def asof_fill(spark: SparkSession, d: str) -> DataFrame:
    """Each element's last heading before it."""
    return _elements(spark, d).select("element_id", F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(_upto()).alias("heading"))


@R.add(f"""with {_ELEMENTS}, r as (select *, case when section is distinct from lag(section) over (partition by filing_id order by order_no nulls first, element_id) then 1 else 0 end as new from e),
g as (select *, sum(new) over (partition by filing_id order by order_no nulls first, element_id rows unbounded preceding) as run from r),
h as (select *, last_value(case when type = 'heading' then left(text, 80) end ignore nulls) over (partition by filing_id, run order by order_no nulls first, element_id rows unbounded preceding) as heading from g)
select element_id, cast(run as bigint) as run, concat_ws(' > ', section, subsection, heading) as breadcrumb from h""")
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """Section, subsection and last heading of each element; a change of section forgets the heading."""
    changed = (~F.col("section").eqNullSafe(F.lag("section").over(_in_order()))).cast("long")
    runs = _elements(spark, d).withColumn("_new", changed).withColumn("run", F.sum("_new").over(_upto()))
    upto = Window.partitionBy("filing_id", "run").orderBy("order_no", "element_id").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(F.col("type") == "heading", F.left("text", F.lit(80))), ignorenulls=True).over(upto)
    return runs.select("element_id", "run", F.concat_ws(" > ", "section", "subsection", heading).alias("breadcrumb"))


_BLOCKS = f"""{_ELEMENTS}, k as (select *, type in ('text', 'list_item', 'footnote') as prose from e),
m as (select *, case when prose and lag(prose) over w and section is not distinct from lag(section) over w then 0 else 1 end as new from k window w as (partition by filing_id order by order_no nulls first, element_id)),
b as (select *, sum(new) over (partition by filing_id order by order_no nulls first, element_id rows unbounded preceding) as block from m)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    k = _elements(spark, d).withColumn("prose", F.col("type").isin("text", "list_item", "footnote"))
    goes_on = F.col("prose") & F.coalesce(F.lag("prose").over(_in_order()), F.lit(False)) & F.col("section").eqNullSafe(F.lag("section").over(_in_order()))
    return k.withColumn("new", (~goes_on).cast("long")).withColumn("block", F.sum("new").over(_upto()))


@R.add(f"""with {_BLOCKS} select filing_id, cast(block as bigint) as block, count(*) as n, min(element_id) as first_id, cast(sum(length(coalesce(text, ''))) as bigint) as chars from b where prose group by filing_id, block""")
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of prose elements, ended by headings, tables and changes of section."""
    b = _blocks(spark, d).where("prose")
    return b.groupBy("filing_id", "block").agg(F.count("*").alias("n"), F.min("element_id").alias("first_id"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@R.add()
def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 120 to 450 size tokens: blocks cut at the greatest neighbour distances, small pieces joined to the nearer neighbour, small blocks to the next of their subsection."""
    use_shared_folder(spark)
    where = ["filing_id", "section", "subsection"]
    texts = _blocks(spark, d).where("prose and text is not null").groupBy(*where, "block").agg(F.array_sort(F.collect_list(F.struct("order_no", "element_id", "text"))).alias("x"))
    measured = C.measure(texts.select(*where, "block", F.array_join("x.text", "\n").alias("text")), [*where, "block"], "text").checkpoint()
    return C.passages(measured, where, "block", C.threshold_of(measured))


@R.add()
def merged_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Prose elements of a block merged by size alone into passages of 120 to 450 size tokens."""
    rows = _blocks(spark, d).where("prose").select("filing_id", "block", "order_no", "element_id", X.token_estimate(F.col("text")).alias("tokens"))
    return P.merge_blocks(rows, ["filing_id", "block"], ["order_no"], "element_id", "tokens")


@R.add(f"""with {_ELEMENTS}, l as (select filing_id, page, bbox[2] as top, lag(bbox[2]) over (partition by filing_id, page order by order_no nulls first, element_id) as before from e)
select filing_id, count(*) as n, sum(case when before is not null and top > before + 1 then 1 else 0 end)::bigint as upward from l group by filing_id""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    """How often an element of a page stands above the one before it."""
    inside = Window.partitionBy("filing_id", "page").orderBy("order_no", "element_id")
    top = F.get("bbox", F.lit(1))
    e = _elements(spark, d).select("filing_id", top.alias("top"), F.lag(top).over(inside).alias("before"))
    return e.groupBy("filing_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("top") > F.col("before") + 1, F.lit(False)).cast("long")).alias("upward"))


@R.add(f"""with {_ELEMENTS}, h as (select element_id, filing_id, page, case when lower(text) like '%risk%' then 'risk' when lower(text) like '%financial%' or lower(text) like '%balance%' then 'financial' when lower(text) like '%remarks%' then 'remarks' when lower(text) like '%scope%' then 'scope' else 'other' end as tag from e where type = 'heading')
select tag, count(*) as n, count(distinct filing_id) as filings from h group by tag""")
def section_tags(spark: SparkSession, d: str) -> DataFrame:
    """Headings by the first pattern they match."""
    t = F.lower("text")
    tag = F.when(t.contains("risk"), "risk").when(t.contains("financial") | t.contains("balance"), "financial").when(t.contains("remarks"), "remarks").when(t.contains("scope"), "scope").otherwise("other")
    return _elements(spark, d).where("type = 'heading'").select("filing_id", tag.alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("filing_id").alias("filings"))


@R.add(f"""with {_ELEMENTS}, p as (select filing_id, page, element_id, text, (bbox[3] - bbox[1]) * (bbox[4] - bbox[2]) as area from e where type in ('caption', 'picture')),
n as (select *, row_number() over (partition by filing_id, page order by area, element_id) as k from p where area is not null) select filing_id, page, element_id, round(area, 4) as area from n where k = 1""")
def dedupe_smallest(spark: SparkSession, d: str) -> DataFrame:
    """The smallest caption or picture of each page."""
    g = lambda i: F.get("bbox", F.lit(i))
    p = _elements(spark, d).where(F.col("type").isin("caption", "picture")).select("filing_id", "page", "element_id", ((g(2) - g(0)) * (g(3) - g(1))).alias("area")).where("area is not null")
    best = p.groupBy("filing_id", "page").agg(F.min(F.struct("area", "element_id")).alias("b"))
    return best.select("filing_id", "page", F.col("b.element_id").alias("element_id"), F.round("b.area", 4).alias("area"))


_DIST = """v as (select vec_id, label, embedding, lead(embedding) over (partition by label order by vec_id) as nxt from embeddings),
dist as (select vec_id, label, 1 - list_inner_product(cast(embedding as double[]), cast(nxt as double[])) / greatest(sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) * sqrt(list_inner_product(cast(nxt as double[]), cast(nxt as double[]))), 1e-12) as distance from v where nxt is not null)"""


def _distances(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").withColumn("nxt", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("nxt is not null")
    return v.select("vec_id", "label", (1 - V.cosine("embedding", "nxt")).alias("distance"))


@R.add(f"with {_DIST} select vec_id, label, round(distance, 6) as distance from dist")
def neighbour_distance(spark: SparkSession, d: str) -> DataFrame:
    """Cosine distance of each vector to the next of its group."""
    return _distances(spark, d).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@R.add(f"with {_DIST} select round(quantile_cont(distance, 0.95), 6) as threshold, count(*) as n from dist")
def split_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The distance below which 95 per cent of all neighbours lie, interpolated."""
    return S.interpolated_percentile(_distances(spark, d), "distance", 0.95).select(F.round("percentile", 6).alias("threshold"), F.col("n_values").alias("n"))


@R.add(f"""with {_DIST}, s as (select vec_id, label, case when round(distance, 9) > 1.05 then 1 else 0 end as cut from dist),
p as (select label, coalesce(sum(cut) over (partition by label order by vec_id rows between unbounded preceding and 1 preceding), 0) as piece from s) select label, cast(piece as bigint) as piece, count(*) as n from p group by all""")
def split_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the pieces between distances over 1.05."""
    before = Window.partitionBy("label").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1)
    s = _distances(spark, d).withColumn("cut", (F.round("distance", 9) > 1.05).cast("long"))
    return s.withColumn("piece", F.coalesce(F.sum("cut").over(before), F.lit(0))).groupBy("label", "piece").agg(F.count("*").alias("n"))


_SENT = "s as (select distinct sentence_id, chunk_id, start_char, end_char, text from sentences)"


@R.add(f"""with {_SENT}, r as (select sentence_id, start_char, coalesce(sum(length(text) + 1) over (partition by chunk_id order by start_char nulls first, sentence_id rows between unbounded preceding and 1 preceding), 0) as expected from s)
select sentence_id, cast(expected as bigint) as expected, coalesce(start_char = expected, false) as fits from r""")
def sentence_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Offsets that sentences would have if one blank stood between them, and whether the recorded ones agree."""
    s = table(spark, d, "sentences").select("sentence_id", "chunk_id", "start_char", "text").distinct()
    before = Window.partitionBy("chunk_id").orderBy("start_char", "sentence_id").rowsBetween(Window.unboundedPreceding, -1)
    r = s.withColumn("expected", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    return r.select("sentence_id", "expected", F.coalesce(F.col("start_char") == F.col("expected"), F.lit(False)).alias("fits"))


@R.add(f"""with {_SENT}, f as (select *, case when regexp_matches(text, '[0-9]+(\\.[0-9]+)?%') then 1 else 0 end as hit from s),
w as (select *, max(hit) over (partition by chunk_id order by start_char nulls first, sentence_id rows between 1 preceding and 1 following) as near, sum(hit) over (partition by chunk_id) as hits, row_number() over (partition by chunk_id order by start_char nulls first, sentence_id) as k from f)
select sentence_id, case when hit = 1 then 'hit' when hits = 0 then 'fallback' else 'neighbour' end as why from w where near = 1 or (hits = 0 and k <= 2)""")
def select_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with a percentage and their neighbours; the first two where a chunk has none."""
    s = table(spark, d, "sentences").select("sentence_id", "chunk_id", "start_char", "text").distinct().withColumn("hit", F.coalesce(F.col("text").rlike(r"[0-9]+(\.[0-9]+)?%"), F.lit(False)).cast("int"))
    order = Window.partitionBy("chunk_id").orderBy("start_char", "sentence_id")
    w = s.select("sentence_id", "hit", F.max("hit").over(order.rowsBetween(-1, 1)).alias("near"), F.sum("hit").over(Window.partitionBy("chunk_id")).alias("hits"), F.row_number().over(order).alias("k"))
    why = F.when(F.col("hit") == 1, "hit").when(F.col("hits") == 0, "fallback").otherwise("neighbour")
    return w.where("near = 1 or (hits = 0 and k <= 2)").select("sentence_id", why.alias("why"))


@R.add("""with c as (select distinct filing_id, chunk_id, page, ceil(length(coalesce(document, '')) / 4)::bigint as tokens from chunks where modality = 'text'),
r as (select *, sum(tokens) over (partition by filing_id order by page desc nulls last, chunk_id desc rows unbounded preceding) as used from c) select filing_id, chunk_id, cast(used as bigint) as used from r where used <= 500""")
def fit_history(spark: SparkSession, d: str) -> DataFrame:
    """The latest text chunks of each filing that fit 500 size tokens, up to the first that does not."""
    c = table(spark, d, "chunks").where("modality = 'text'").select("filing_id", "chunk_id", "page", X.token_estimate(F.col("document")).alias("tokens")).distinct()
    upto = Window.partitionBy("filing_id").orderBy(F.col("page").desc(), F.col("chunk_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return c.withColumn("used", F.sum("tokens").over(upto)).where("used <= 500").select("filing_id", "chunk_id", "used")


@R.add()
def pack_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of printed tables packed in order into parts of 300 size tokens, each with the header again."""
    t = table(spark, d, "chunks").where("modality = 'table' and document is not null").select("chunk_id", "document").distinct()
    lines = F.filter(F.split("document", "\n"), lambda x: F.trim(x) != "")
    rows = t.select("chunk_id", F.slice(lines, 1, 3).alias("head"), F.slice(lines, 4, F.size(lines)).alias("body"))
    base = F.aggregate("head", F.lit(0), lambda s, x: s + F.ceil(F.length(x) / 4).cast("int"))
    start = F.struct(F.lit(0).alias("part"), base.alias("used"), F.array().cast("array<int>").alias("parts"))

    def step(acc, x):
        cost = F.ceil(F.length(x) / 4).cast("int")
        fits = (acc["used"] + cost <= 300) | (acc["used"] == base)
        part = F.when(fits, acc["part"]).otherwise(acc["part"] + 1)
        return F.struct(part.alias("part"), F.when(fits, acc["used"] + cost).otherwise(base + cost).alias("used"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    packed = rows.select("chunk_id", F.aggregate("body", start, step, lambda acc: acc["parts"]).alias("parts"))
    return packed.select("chunk_id", F.explode("parts").alias("part")).groupBy("chunk_id", "part").agg(F.count("*").alias("rows"))


_NUM = r"\$?[0-9][0-9,]*(?:\.[0-9]+)?%?"


@R.add(rf"""with c as (select distinct entry_id, question, answer from cached_answers where answer is not null) select entry_id, cast(len(regexp_extract_all(regexp_replace(answer, '\[[^\[\]]*\]', ' ', 'g'), '{_NUM}')) as integer) as numbers,
 array_to_string(regexp_extract_all(regexp_replace(answer, '\[[^\[\]]*\]', ' ', 'g'), '{_NUM}'), ' ') as printed from c""")
def extract_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each answer, citations left out."""
    c = table(spark, d, "cached_answers").where("answer is not null").select("entry_id", "question", "answer").distinct()
    found = F.regexp_extract_all(F.regexp_replace("answer", r"\[[^\[\]]*\]", " "), F.lit(f"({_NUM})"), F.lit(1))
    return c.select("entry_id", F.size(found).alias("numbers"), F.array_join(found, " ").alias("printed"))


@R.add(rf"""select doc_id, round(least(1.0, len(regexp_extract_all(text, '{_NUM}')) / greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9]+')))), 6) as density from documents where text is not null""")
def numeric_density(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    n, w = (F.size(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))) for p in (_NUM, "[A-Za-z0-9]+"))
    return t.select("doc_id", F.round(F.least(F.lit(1.0), n / F.greatest(F.lit(1), w)), 6).alias("density"))


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


@R.add(f"""with m as (select doc_id, unnest(regexp_extract_all(text, '((?:{_MONTHS}) [0-9]{{1,2}}, [0-9]{{4}})', 1)) as s from documents), p as (select distinct doc_id, cast(try_strptime(s, '%B %d, %Y') as date) as day from m)
select doc_id, string_agg(strftime(day, '%Y-%m-%d'), ',' order by day) as days, count(*) as n from p where day is not null group by doc_id""")
def find_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates written out in each document, each once, in order; days that do not exist are left out."""
    found = F.regexp_extract_all("text", F.lit(f"((?:{_MONTHS}) [0-9]{{1,2}}, [0-9]{{4}})"), F.lit(1))
    days = table(spark, d, "documents").select("doc_id", F.explode(found).alias("s")).select("doc_id", F.try_to_date("s", "MMMM d, yyyy").alias("day")).where("day is not null").distinct()
    return days.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("day")), lambda x: x.cast("string")), ",").alias("days"), F.count("*").alias("n"))


def _redact_sql(column: str) -> str:
    for shape in X.SECRET_SHAPES:
        column = f"regexp_replace({column}, '{shape}', '[redacted]', 'g')"
    return column


@R.add(f"select doc_id, length({_redact_sql('text')}) as chars, {_redact_sql('text')} <> text as changed from documents where text is not null")
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text", X.redact(F.col("text")).alias("r"))
    return t.select("doc_id", F.length("r").cast("long").alias("chars"), (F.col("r") != F.col("text")).alias("changed"))


@R.add(r"""select doc_id, text is null or trim(text) = '' as is_empty, coalesce(length(text) > 1000, false) as too_long, coalesce(regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]'), false) as control, not coalesce(regexp_matches(text, '[A-Za-z0-9]'), false) as no_alnum from documents""")
def validate_text(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    flag = lambda x: F.coalesce(x, F.lit(False))
    return table(spark, d, "documents").select(
        "doc_id", (t.isNull() | (F.trim(t) == "")).alias("is_empty"), flag(F.length(t) > 1000).alias("too_long"), flag(t.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")).alias("control"), (~flag(t.rlike("[A-Za-z0-9]"))).alias("no_alnum")
    )


@R.add("""select distinct chunk_id, case when document like '[%' and instr(document, chr(10)) > 0 then length(substr(document, instr(document, chr(10)) + 1)) else length(document) end as chars, split_part(document, chr(10), 1) as first_line from chunks where document is not null and modality = 'text'""")
def block_body(spark: SparkSession, d: str) -> DataFrame:
    """Size of a chunk's body without its breadcrumb line."""
    c = table(spark, d, "chunks").where("document is not null and modality = 'text'")
    cut = F.instr("document", "\n")
    body = F.when(F.col("document").startswith("[") & (cut > 0), F.length("document") - cut).otherwise(F.length("document"))
    return c.select("chunk_id", body.cast("long").alias("chars"), F.split_part("document", F.lit("\n"), F.lit(1)).alias("first_line")).distinct()


@R.add(r"select distinct entry_id, regexp_replace(regexp_replace(answer, '\[p\. ?([0-9]+)\]', '[p\1]', 'g'), '\((?:Source|source): ([a-z]+)\)', '[\1]', 'g') as answer from cached_answers where answer is not null")
def normalize_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citation marks in one form."""
    a = F.regexp_replace(F.regexp_replace("answer", r"\[p\. ?([0-9]+)\]", "[p$1]"), r"\((?:Source|source): ([a-z]+)\)", "[$1]")
    return table(spark, d, "cached_answers").where("answer is not null").select("entry_id", a.alias("answer")).distinct()


@R.add("select modality, cast(sum(ceil(length(coalesce(document, '')) / 4)) as bigint) as tokens, count(*) as n from (select distinct chunk_id, modality, document from chunks) group by modality")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "modality", X.token_estimate(F.col("document")).alias("t"), "document").distinct()
    return c.groupBy("modality").agg(F.sum("t").alias("tokens"), F.count("*").alias("n"))


@R.add("""with e as (select event_id, user_id, cast(json_extract_string(props, '$.k') as integer) as k from events) select user_id, count(*) as n, max(k) as most, round(avg(k), 6) as mean, sum(case when k is null then 1 else 0 end)::bigint as broken from e group by user_id""")
def parse_json_props(spark: SparkSession, d: str) -> DataFrame:
    """A field of the events' JSON, read with a declared schema; broken rows are counted."""
    e = table(spark, d, "events").select("user_id", F.from_json("props", "k int").getField("k").alias("k"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"), F.sum(F.col("k").isNull().cast("long")).alias("broken"))


@R.add(r"""with q as (select distinct id, question, lower(trim(question)) as t from golden where question is not null) select id, regexp_matches(t, '^(and|what about|how about|also|but)\b') as follow_up, regexp_matches(t, '\b(it|its|they|their|that|this)\b') as pronoun, regexp_matches(question, '(19|20)[0-9]{2}') as has_year from q""")
def followups(spark: SparkSession, d: str) -> DataFrame:
    """Signs that a question leans on the turn before it."""
    q = table(spark, d, "golden").where("question is not null").select("id", "question", F.lower(F.trim("question")).alias("t")).distinct()
    return q.select("id", F.col("t").rlike(r"^(and|what about|how about|also|but)\b").alias("follow_up"), F.col("t").rlike(r"\b(it|its|they|their|that|this)\b").alias("pronoun"), F.col("question").rlike("(19|20)[0-9]{2}").alias("has_year"))


@R.add(r"""with q as (select distinct id, question from golden where question is not null), y as (select id, list_sort(list_distinct(regexp_extract_all(question, '(20[0-9]{2})', 1))) as ys, regexp_matches(question, '(?i)fiscal|fy') as fiscal from q)
select id, array_to_string(['FY' || w for w in ys], '|') as periods, fiscal from y where len(ys) > 0""")
def slot_periods(spark: SparkSession, d: str) -> DataFrame:
    """Fiscal years named in each question."""
    q = table(spark, d, "golden").where("question is not null").select("id", "question").distinct()
    years = F.array_sort(F.array_distinct(F.regexp_extract_all("question", F.lit("(20[0-9]{2})"), F.lit(1))))
    return q.where(F.size(years) > 0).select("id", F.array_join(F.transform(years, lambda y: F.concat(F.lit("FY"), y)), "|").alias("periods"), F.col("question").rlike("(?i)fiscal|fy").alias("fiscal"))


@R.add(r"""with q as (select distinct id, question, expected from golden where expected.value is not null), i as (select id, lower(regexp_extract(question, '(?i)^(?:give|how much was|what was|what were) (.*?) (?:of|for|at) ', 1)) as item, expected.fiscal_year as fy, expected.period_end as pe from q)
select id, item || ' as of ' || strftime(cast(pe as date), '%Y-%m-%d') || ' (FY' || fy || ')' as canonical from i where item <> '' and pe is not null and fy is not null""")
def canonical_query(spark: SparkSession, d: str) -> DataFrame:
    """Item and period of a question in one wording."""
    item = F.lower(F.regexp_extract("question", r"(?i)^(?:give|how much was|what was|what were) (.*?) (?:of|for|at) ", 1))
    q = table(spark, d, "golden").where(F.col("expected.value").isNotNull()).select("id", item.alias("item"), F.col("expected.fiscal_year").cast("string").alias("fy"), F.date_format(F.to_date("expected.period_end"), "yyyy-MM-dd").alias("pe")).distinct()
    return q.where("item <> '' and pe is not null and fy is not null").select("id", F.concat("item", F.lit(" as of "), "pe", F.lit(" (FY"), "fy", F.lit(")")).alias("canonical"))


# --- compression of context -----------------------------------------------------------------------------

#: Weights of the rule score and of the exported logistic scorer.
RULE_WEIGHTS = (0.45, 0.25, 0.20, 0.10)
LEARNED = (0.3785, 1.5329, -1.3878, 0.2175, -0.0754, 0.4577, 0.8347, 1.1156)
INTERCEPT = -1.57

_FEATURES = rf"""c as (select distinct filing_id, chunk_id, modality, page, document, ceil(length(coalesce(document, '')) / 4) as tokens from chunks where modality in ('text', 'table') and document is not null),
f as (select *, row_number() over (partition by filing_id order by page nulls first, chunk_id) as rank, least(1.0, len(regexp_extract_all(document, '{_NUM}')) / greatest(1, len(regexp_extract_all(document, '[A-Za-z0-9]+')))) as density,
 sum(tokens) over (partition by filing_id) as total, len(regexp_extract_all(document, '[.!?]( |$)')) as sentences from c),
x as (select filing_id, chunk_id, modality, tokens, rank, density, sentences, 1 - density as noise, least(tokens / 400.0, 1.0) as len_score, greatest(0.0, least(1.0, (total / 2500.0 - 0.5) / 0.5)) as pressure, case when modality = 'text' then 0.8 else 0.3 end as intent_w from f)"""


def _chunk_features(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("modality in ('text', 'table') and document is not null").select("filing_id", "chunk_id", "modality", "page", "document").distinct()
    n, w = (F.size(F.regexp_extract_all("document", F.lit(f"({p})"), F.lit(1))) for p in (_NUM, "[A-Za-z0-9]+"))
    slim = c.select("filing_id", "chunk_id", "modality", "page", F.ceil(F.length("document") / 4).alias("tokens"), F.least(F.lit(1.0), n / F.greatest(F.lit(1), w)).alias("density"), F.size(F.regexp_extract_all("document", F.lit("([.!?]( |$))"), F.lit(1))).alias("sentences"))
    totals = slim.groupBy("filing_id").agg(F.sum("tokens").alias("total"))
    ranked = slim.withColumn("rank", F.row_number().over(Window.partitionBy("filing_id").orderBy("page", "chunk_id"))).join(totals, "filing_id", "left")
    return ranked.select(
        "filing_id", "chunk_id", "modality", "tokens", "rank", "density", "sentences", (1 - F.col("density")).alias("noise"), F.least(F.col("tokens") / 400.0, F.lit(1.0)).alias("len_score"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("total") / 2500.0 - 0.5) / 0.5)).alias("pressure"), F.when(F.col("modality") == "text", 0.8).otherwise(0.3).alias("intent_w"),
    )


@R.add(f"with {_FEATURES} select chunk_id, cast(rank as integer) as rank, round(density, 6) as density, cast(sentences as integer) as sentences, round(len_score, 6) as len_score, round(pressure, 6) as pressure from x where filing_id is not null")
def chunk_features(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_features(spark, d).where("filing_id is not null").select("chunk_id", "rank", F.round("density", 6).alias("density"), "sentences", F.round("len_score", 6).alias("len_score"), F.round("pressure", 6).alias("pressure"))


@R.add(f"""with {_FEATURES}, s as (select chunk_id, round(0.45 * noise + 0.25 * len_score + 0.20 * pressure + 0.10 * intent_w, 6) as score from x where filing_id is not null) select chunk_id, score, case when score < 0.35 then 'keep' when score < 0.60 then 'extract' else 'rewrite' end as action from s""")
def compress_stage_b(spark: SparkSession, d: str) -> DataFrame:
    a, b, c, e = RULE_WEIGHTS
    score = F.round(F.lit(a) * F.col("noise") + F.lit(b) * F.col("len_score") + F.lit(c) * F.col("pressure") + F.lit(e) * F.col("intent_w"), 6)
    s = _chunk_features(spark, d).where("filing_id is not null").select("chunk_id", score.alias("score"))
    return s.withColumn("action", F.when(F.col("score") < 0.35, "keep").when(F.col("score") < 0.60, "extract").otherwise("rewrite"))


@R.add(f"""with {_FEATURES} select chunk_id, round(1 / (1 + exp(-({INTERCEPT} + {LEARNED[0]} * noise + {LEARNED[1]} * len_score + {LEARNED[2]} * pressure + {LEARNED[3]} * intent_w + {LEARNED[4]} * density + {LEARNED[5]} * least(rank / 10.0, 1.0) + {LEARNED[7]} * least(sentences / 20.0, 1.0)))), 6) as probability from x where filing_id is not null""")
def learned_score(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.col("noise"), F.col("len_score"), F.col("pressure"), F.col("intent_w"), F.col("density"), F.least(F.col("rank") / 10.0, F.lit(1.0)), F.lit(0.0), F.least(F.col("sentences") / 20.0, F.lit(1.0))]
    z = F.lit(INTERCEPT)
    for weight, x in zip(LEARNED, parts):
        z = z + F.lit(weight) * x
    return _chunk_features(spark, d).where("filing_id is not null").select("chunk_id", F.round(1 / (1 + F.exp(-z)), 6).alias("probability"))


@R.add(f"""with {_FEATURES}, t as (select filing_id, sum(case when modality = 'text' then tokens else 0 end) as narrative from x group by 1)
select chunk_id, case when modality = 'table' and tokens > 150 then 'row_select' when modality = 'table' then 'protect' when narrative <= 1500 then 'skip' when rank > 8 then 'drop' else 'stage_b' end as action from x left join t on x.filing_id = t.filing_id where x.filing_id is not null""")
def compress_stage_a(spark: SparkSession, d: str) -> DataFrame:
    """What the rules decide before any score: tables are protected or cut by rows, short narratives left alone."""
    x = _chunk_features(spark, d).where("filing_id is not null")
    t = x.groupBy("filing_id").agg(F.sum(F.when(F.col("modality") == "text", F.col("tokens")).otherwise(0)).alias("narrative"))
    table_ = F.col("modality") == "table"
    action = F.when(table_ & (F.col("tokens") > 150), "row_select").when(table_, "protect").when(F.col("narrative") <= 1500, "skip").when(F.col("rank") > 8, "drop").otherwise("stage_b")
    return x.join(t, "filing_id").select("chunk_id", action.alias("action"))


@R.add(r"""with t as (select distinct chunk_id, document from chunks where modality = 'table' and document is not null), l as (select chunk_id, unnest(string_split(document, chr(10))) as line, generate_subscripts(string_split(document, chr(10)), 1) as k from t),
f as (select chunk_id, line, k, k <= 3 as head, regexp_matches(lower(line), 'total|revenue|cash') as want from l where trim(line) like '|%'), s as (select chunk_id, sum(case when want and not head then 1 else 0 end) as hits from f group by 1)
select chunk_id, count(*) as lines, sum(case when head or want or hits = 0 then 1 else 0 end)::bigint as kept from f join s using (chunk_id) group by chunk_id""")
def row_select(spark: SparkSession, d: str) -> DataFrame:
    """Table rows kept for a few wanted labels: header and matches, or everything where nothing matches."""
    t = table(spark, d, "chunks").where("modality = 'table' and document is not null").select("chunk_id", "document").distinct()
    f = t.select("chunk_id", F.posexplode(F.split("document", "\n")).alias("k", "line")).where(F.trim("line").startswith("|")).select("chunk_id", (F.col("k") < 3).alias("head"), F.lower("line").rlike("total|revenue|cash").alias("want"))
    agg = f.groupBy("chunk_id").agg(
        F.count("*").alias("lines"), F.sum((F.col("want") & ~F.col("head")).cast("long")).alias("hits"), F.sum((F.col("head") | F.col("want")).cast("long")).alias("some")
    )
    return agg.select("chunk_id", "lines", F.when(F.col("hits") == 0, F.col("lines")).otherwise(F.col("some")).alias("kept"))


@R.add(r"""with g as (select distinct id, question, reference_answer as a, expected.value as v from golden where reference_answer is not null), n as (select id, v, question, unnest(regexp_extract_all(a, '[0-9][0-9,]*(?:\.[0-9]+)?')) as tok from g),
p as (select id, tok, try_cast(replace(tok, ',', '') as double) as x, v, contains(question, tok) as asked, case when contains(tok, '.') then length(tok) - instr(tok, '.') else 0 end as dec from n)
select id, count(*) as numbers, sum(case when asked or (x = floor(x) and x <= 31 and not contains(tok, ',')) or (x = floor(x) and x between 1900 and 2100) or (v is not null and (abs(abs(v) - x) <= 0.5 * pow(10, -dec) + 1e-9 or abs(abs(v) * 1000 - x) <= 0.5 * pow(10, -dec) + 1e-9 or abs(abs(v) / 1000 - x) <= 0.5 * pow(10, -dec) + 1e-9)) then 1 else 0 end)::bigint as supported from p group by id""")
def number_support(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of each reference answer that the question or the expected value bear out, at any of three scales."""
    g = table(spark, d, "golden").where("reference_answer is not null").select("id", "question", F.col("reference_answer").alias("a"), F.abs("expected.value").alias("v")).distinct()
    n = g.select("id", "question", "v", F.explode(F.regexp_extract_all("a", F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))).alias("tok")).withColumn("x", F.replace("tok", F.lit(","), F.lit("")).try_cast("double"))
    decimals = F.when(F.contains("tok", F.lit(".")), F.length("tok") - F.instr("tok", ".")).otherwise(0)
    near = F.lit(0.5) * F.pow(F.lit(10.0), -decimals) + 1e-9
    whole = F.col("x") == F.floor("x")
    close = F.lit(False)
    for scale in (1.0, 1000.0, 0.001):
        close = close | (F.abs(F.col("v") * scale - F.col("x")) <= near)
    ok = F.coalesce(F.contains("question", "tok"), F.lit(False)) | (whole & (F.col("x") <= 31) & ~F.contains("tok", F.lit(","))) | (whole & F.col("x").between(1900, 2100)) | F.coalesce(close, F.lit(False))
    return n.groupBy("id").agg(F.count("*").alias("numbers"), F.sum(F.coalesce(ok, F.lit(False)).cast("long")).alias("supported"))


@R.add("""with c as (select distinct filing_id, chunk_id, page, document from chunks where modality = 'text' and document is not null), k as (select *, row_number() over (partition by filing_id order by page nulls first, chunk_id) as rank from c),
w as (select filing_id, chunk_id, rank, list_distinct(regexp_extract_all(lower(document), '[a-z]{3,}')) as w from k),
j as (select b.chunk_id, a.chunk_id as dup_of, a.rank as arank, len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) as sim from w b join w a on a.filing_id = b.filing_id and a.rank < b.rank),
n as (select *, row_number() over (partition by chunk_id order by round(sim, 9) desc, arank) as m from j where sim is not null) select chunk_id, dup_of, round(sim, 6) as sim from n where m = 1""")
def dup_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The most similar better-ranked text chunk of the same filing, for every text chunk."""
    c = table(spark, d, "chunks").where("modality = 'text' and document is not null").select("filing_id", "chunk_id", "page", "document").distinct()
    k = S.numbered_within(c, ["filing_id"], ["page"], ["chunk_id"], "rank")
    words = F.array_distinct(F.regexp_extract_all(F.lower("document"), F.lit("([a-z]{3,})"), F.lit(1)))
    best = P.most_similar_before(k.select("filing_id", "chunk_id", "rank", words.alias("w")), "filing_id", "chunk_id", "rank", "w")
    return best.select("chunk_id", "dup_of", F.round("sim", 6).alias("sim"))


@R.add("""with p as (select v.vec_id, v.label, max(list_inner_product(cast(v.embedding as double[]), cast(q.embedding as double[]))) as best from embeddings v, embeddings q where q.vec_id % 100 = 0 group by all) select label, count(*) as n, round(avg(case when round(best, 9) >= 0.25 then 1.0 else 0.0 end), 6) as density, round(max(best), 6) as most from p group by label""")
def relevance_density(spark: SparkSession, d: str) -> DataFrame:
    """Share of each group's vectors that are near any vector of the query set."""
    v = table(spark, d, "embeddings")
    best = V.best_product(spark, v.select("vec_id", "embedding"), v.where("vec_id % 100 = 0").select("vec_id", "embedding"))
    p = v.select("vec_id", "label").join(best, "vec_id")
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.round("best", 9) >= 0.25).cast("double")), 6).alias("density"), F.round(F.max("best"), 6).alias("most"))
