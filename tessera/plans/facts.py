"""Queries of facts, tables and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import formulas as CALC
from ..operators import statements as ST
from ..sources.tables import table
from .registry import Registry

R = Registry()
YEARS = (2026, 2025, 2024)

_FACTS = "f as (select distinct chunk_id, filing_id, statement, line_item, line_item_norm, line_group, value_fy2026, value_fy2025, value_fy2024, unit, page, document from chunks where modality = 'row_fact')"
_LONG = _FACTS + ", long as (" + " union all ".join(f"select chunk_id, filing_id, statement, line_item_norm, {y} as fy, value_fy{y} as value, value_fy{y} is null as is_nil from f" for y in YEARS) + ")"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    columns = ["chunk_id", "filing_id", "statement", "line_item", "line_item_norm", "line_group", "value_fy2026", "value_fy2025", "value_fy2024", "unit", "page", "document"]
    return table(spark, d, "chunks").where("modality = 'row_fact'").select(*columns).distinct()


def _long(spark: SparkSession, d: str) -> DataFrame:
    """One row per fact and year; a nil value is told from a missing row by ``is_nil``."""
    cells = F.explode(F.array(*[F.struct(F.lit(y).alias("fy"), F.col(f"value_fy{y}").alias("value")) for y in YEARS])).alias("c")
    wide = table(spark, d, "chunks").where("modality = 'row_fact'").select("chunk_id", "filing_id", "statement", "line_item", "line_item_norm", "line_group", "value_fy2026", "value_fy2025", "value_fy2024").distinct()
    return wide.select("chunk_id", "filing_id", "statement", "line_item_norm", cells).select("chunk_id", "filing_id", "statement", "line_item_norm", "c.fy", "c.value", F.col("c.value").isNull().alias("is_nil"))


@R.add(f"with {_LONG} select chunk_id, statement, line_item_norm, cast(fy as integer) as fy, value, is_nil from long")
def row_facts(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).select("chunk_id", "statement", "line_item_norm", "fy", "value", "is_nil")


@R.add(f"""with {_LONG}, p as (select filing_id, statement, fy, line_item_norm, value from long),
n as (select filing_id, fy, line_item_norm, min(chunk_id) as chunk_id, count(*) as rows_of from long where not is_nil group by all)
select n.filing_id, cast(n.fy as integer) as fy, n.line_item_norm, n.chunk_id, n.rows_of, l.value from n join long l on l.chunk_id = n.chunk_id and l.fy = n.fy""")
def fact_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The first fact of each filing, year and line item."""
    have = _long(spark, d).where("not is_nil")
    return have.groupBy("filing_id", "fy", "line_item_norm").agg(F.min_by("value", "chunk_id").alias("value"), F.min("chunk_id").alias("chunk_id"), F.count("*").alias("rows_of"))


@R.add(f"""with {_LONG} select a.chunk_id, cast(a.fy as integer) as fy, round(a.value - b.value, 4) as absolute, round((a.value - b.value) / nullif(abs(b.value), 0) * 100, 4) as percent,
 case when a.is_nil or b.is_nil then 'nil' when b.value = 0 then 'zero_base' else 'ok' end as status from long a join long b on a.chunk_id = b.chunk_id and b.fy = a.fy - 1""")
def yoy_change(spark: SparkSession, d: str) -> DataFrame:
    """Change against the year before, joined on the year so that gaps stay gaps."""
    a = _long(spark, d)
    b = a.select("chunk_id", (F.col("fy") + 1).alias("fy"), F.col("value").alias("_v"), F.col("is_nil").alias("_nil"))
    change = F.col("value") - F.col("_v")
    status = F.when(F.col("is_nil") | F.col("_nil"), "nil").when(F.col("_v") == 0, "zero_base").otherwise("ok")
    return a.join(b, ["chunk_id", "fy"]).select("chunk_id", "fy", F.round(change, 4).alias("absolute"), F.round(F.try_divide(change, F.abs("_v")) * 100, 4).alias("percent"), status.alias("status"))


def _formula_sql() -> str:
    """The registry as SQL: one branch a formula over its inputs as columns."""
    names = sorted({k for f in CALC.FORMULAS.values() for k in f.inputs})
    wanted = ", ".join(f"('{n}', '{f.statement}', '{k}', '{i.item.replace(chr(39), chr(39) * 2)}', {i.back}, {str(i.optional).lower()})" for n, f in CALC.FORMULAS.items() if not f.generic for k, i in f.inputs.items())
    each = ", ".join(f"('{n}', '{k}', {i.back}, {str(i.optional).lower()})" for n, f in CALC.FORMULAS.items() if f.generic for k, i in f.inputs.items())
    values = ", ".join(f"max(case when input = '{n}' then 1 end) as h_{n}, max(case when input = '{n}' then coalesce(value, case when optional then 0.0 end) end) as {n}" for n in names)
    result = " ".join(f"when '{n}' then {f.expression.replace('/ abs(prior)', '/ nullif(abs(prior), 0)').replace('/ current_liabilities', '/ nullif(current_liabilities, 0)').replace('/ equity', '/ nullif(equity, 0)').replace('/ assets', '/ nullif(assets, 0)')}" for n, f in CALC.FORMULAS.items())

    def gap(k: str, i: CALC.Input) -> str:
        item = "metric" if i.item == CALC.METRIC else "'" + i.item.replace("'", "''") + "'"
        return f"case when h_{k} is null then {item} || ' (FY' || (fy - {i.back}) || ')' when {k} is null then {item} || ' (FY' || (fy - {i.back}) || ' is nil)' end"

    missing = " ".join(f"when '{n}' then concat_ws('; ', {', '.join(gap(k, i) for k, i in sorted(f.inputs.items()))})" for n, f in CALC.FORMULAS.items())
    return f"""with {_LONG}, o as (select filing_id, statement, replace(line_item_norm, '_', ' ') as item, fy, value, chunk_id,
  row_number() over (partition by filing_id, statement, replace(line_item_norm, '_', ' '), fy order by chunk_id) as k from long where line_item_norm is not null),
once as (select * from o where k = 1), wanted(formula, statement, input, item, back, optional) as (values {wanted}), each(formula, input, back, optional) as (values {each}),
found as (select filing_id, formula, statement, cast(null as varchar) as metric, fy + back as fy, input, optional, value from once join wanted using (statement, item)
  union all select filing_id, formula, statement, item, fy + back, input, optional, value from once cross join each),
wide as (select filing_id, formula, statement, metric, fy, {values} from found group by all),
known as (select w.* from wide w semi join (select distinct filing_id, fy from once) y on w.filing_id is not distinct from y.filing_id and w.fy = y.fy),
res as (select filing_id, fy, formula, statement, metric, case formula {missing} end as missing, case formula {result} end as result from known)
select filing_id, cast(fy as integer) as fy, formula, statement, metric, missing, case when missing <> '' then 'missing_inputs' when result is null then 'error' else 'ok' end as status,
  case when missing = '' then round(result, 4) end as result from res"""


def _computed(spark: SparkSession, d: str) -> DataFrame:
    """All formulas over the facts of each filing."""
    long = _long(spark, d).select("filing_id", "statement", F.replace("line_item_norm", F.lit("_"), F.lit(" ")).alias("item"), "fy", "value", "chunk_id")
    return CALC.compute(long, ["filing_id"])


@R.add(_formula_sql())
def ratio_calc(spark: SparkSession, d: str) -> DataFrame:
    """Seven named formulas and the change on the year of each line item, for each filing and year; absent inputs are named."""
    r = _computed(spark, d)
    return r.select("filing_id", "fy", "formula", "statement", "metric", F.array_join("missing", "; ").alias("missing"), "status", F.round("result", 4).alias("result"))


@R.add()
def calc_working(spark: SparkSession, d: str) -> DataFrame:
    """The results that could be computed, as text with their working: a line an input with its source chunk."""
    r = CALC.working(_computed(spark, d).where("status = 'ok'"))
    return r.select("filing_id", "fy", "formula", "statement", "metric", "shown", F.array_join("lines", "\n").alias("working"), F.transform("inputs", lambda i: i["chunk_id"]).alias("sources"))


_PRINTED = r"""printed as (select chunk_id, [case regexp_extract(document, '(\S+) \(FY' || y || '\)', 1) when '' then 'none' else regexp_extract(document, '(\S+) \(FY' || y || '\)', 1) end for y in [2026, 2025, 2024]] as t from f),
amounts as (select chunk_id, t, [try_cast(replace(x, ',', '') as double) for x in t] as theirs from printed)"""


@R.add(f"""with {_FACTS}, {_PRINTED} select chunk_id, case when list_contains(t, 'none') then 'missing' when value_fy2026 is not distinct from theirs[1] and value_fy2025 is not distinct from theirs[2] and value_fy2024 is not distinct from theirs[3] then 'holds' else 'fails' end as status from f join amounts using (chunk_id)""")
def identity_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the amounts recorded of a fact are those its text states: one unit off fails, nil must be nil."""
    f = _facts(spark, d)
    text = [F.regexp_extract("document", rf"(\S+) \(FY{y}\)", 1) for y in YEARS]
    same = F.lit(True)
    for y, t in zip(YEARS, text):
        same = same & F.col(f"value_fy{y}").eqNullSafe(F.replace(t, F.lit(","), F.lit("")).try_cast("double"))
    none = text[0].isNull() | (text[0] == "") | (text[1] == "") | (text[2] == "")
    return f.select("chunk_id", F.when(none, "missing").when(same, "holds").otherwise("fails").alias("status"))


_CELLS = r"""t as (select distinct chunk_id, document from chunks where modality = 'table' and document is not null),
lines as (select chunk_id, unnest(string_split(document, chr(10))) as line, generate_subscripts(string_split(document, chr(10)), 1) as row_no from t),
cells as (select chunk_id, row_no, unnest([trim(w) for w in string_split(substr(trim(line), 2, length(trim(line)) - 2), '|')]) as cell, generate_subscripts(string_split(substr(trim(line), 2, length(trim(line)) - 2), '|'), 1) as col_no from lines where trim(line) like '|%|')"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the printed tables: chunk_id, row_no, col_no, cell."""
    t = table(spark, d, "chunks").where("modality = 'table' and document is not null").select("chunk_id", "document").distinct()
    lines = t.select("chunk_id", F.posexplode(F.split("document", "\n")).alias("row_no", "line")).withColumn("line", F.trim("line"))
    lines = lines.where(F.col("line").startswith("|") & F.col("line").endswith("|") & (F.length("line") >= 2))
    inner = F.split(F.expr("substring(line, 2, length(line) - 2)"), "[|]")
    return lines.select("chunk_id", (F.col("row_no") + 1).alias("row_no"), F.posexplode(inner).alias("col_no", "cell")).select("chunk_id", "row_no", (F.col("col_no") + 1).alias("col_no"), F.trim("cell").alias("cell"))


def _statement_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the printed tables as statements: table_id, row_no, label, values; the heading and its rule left out."""
    c = _cells(spark, d).where("row_no > 3").select("chunk_id", "row_no", "col_no", "cell", X.parse_amount(F.col("cell")).alias("p"))
    cells = F.array_sort(F.collect_list(F.when((F.col("col_no") > 1) & (F.col("p.status") != "text"), F.struct("col_no", F.col("p.value").alias("v")))))
    rows = c.groupBy("chunk_id", "row_no").agg(F.max(F.when(F.col("col_no") == 1, F.col("cell"))).alias("label"), F.transform(cells, lambda x: x["v"]).alias("values"))
    return rows.select(F.col("chunk_id").alias("table_id"), "row_no", "label", "values")


@R.add()
def statement_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the printed tables with their group by the state machine of a balance sheet."""
    return ST.balance_groups(_statement_rows(spark, d)).select("table_id", "row_no", "label_norm", "group", "values")


@R.add(rf"""with {_CELLS}, n as (select chunk_id, row_no, col_no, case when col_no = 1 then trim(regexp_replace(regexp_replace(lower(cell), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) end as label,
 case when col_no > 1 then try_cast(case when regexp_matches(cell, '^\(.*\)$') then '-' || replace(replace(cell[2:-2], ',', ''), '$', '') else replace(replace(cell, ',', ''), '$', '') end as double) end as v from cells where row_no > 3),
r as (select chunk_id, row_no, max(label) as label from n group by all), l as (select chunk_id, row_no, label, regexp_replace(label, ' (total|net|gross)$', '') as item from r),
s as (select l.chunk_id, l.item, n.col_no, max(case when l.label like '% total' then 1 else 0 end) as has_total, sum(case when l.label like '% total' then coalesce(v, 0) else 0 end) as stated, sum(case when l.label like '% total' then 0 else coalesce(v, 0) end) as computed,
 sum(case when l.label not like '% total' then 1 else 0 end) as parts from l join n on l.chunk_id = n.chunk_id and l.row_no = n.row_no where n.col_no > 1 group by all)
select chunk_id, item, cast(col_no as integer) as col_no, round(stated, 4) as stated, round(computed, 4) as computed, abs(stated - computed) < 0.5 as holds from s where has_total = 1 and parts > 0""")
def stated_totals(spark: SparkSession, d: str) -> DataFrame:
    """The totals that a printed table states of a line item, against the sums of its other rows of that item, by column."""
    c = _cells(spark, d).where("row_no > 3")
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower("cell"), "[^a-z0-9 ]", ""), " +", " "))
    labels = c.where("col_no = 1").select("chunk_id", "row_no", clean.alias("label"))
    amounts = c.where("col_no > 1").select("chunk_id", "row_no", "col_no", F.coalesce(X.parse_amount(F.col("cell"))["value"], F.lit(0.0)).alias("v"))
    rows = amounts.join(labels.select("chunk_id", "row_no", F.col("label").endswith(" total").alias("total"), F.regexp_replace("label", " (total|net|gross)$", "").alias("item")), ["chunk_id", "row_no"])
    sums = rows.groupBy("chunk_id", "item", "col_no").agg(
        F.max("total").alias("has_total"), F.sum(F.when(F.col("total"), F.col("v")).otherwise(0.0)).alias("stated"), F.sum(F.when(F.col("total"), 0.0).otherwise(F.col("v"))).alias("computed"), F.sum((~F.col("total")).cast("int")).alias("parts")
    )
    return sums.where("has_total and parts > 0").select("chunk_id", "item", "col_no", F.round("stated", 4).alias("stated"), F.round("computed", 4).alias("computed"), (F.abs(F.col("stated") - F.col("computed")) < 0.5).alias("holds"))


@R.add("""with s as (select l_orderkey, sum(cast(l_extendedprice as decimal(18, 2))) as parts, count(*) as n from lineitem group by 1)
select o_orderstatus, count(*) as orders, sum(case when abs(coalesce(parts, 0) - cast(o_totalprice as decimal(18, 2))) <= 0.5 then 1 else 0 end)::bigint as agree, cast(sum(coalesce(parts, 0)) as double) as parts from orders left join s on l_orderkey = o_orderkey group by 1""")
def subtotal_check(spark: SparkSession, d: str) -> DataFrame:
    """How many order totals agree with the sum of their lines."""
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("p"))
    both = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("t")).join(parts, "o_orderkey", "left").withColumn("p", F.coalesce("p", F.lit(0).cast("decimal(18,2)")))
    return both.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum((F.abs(F.col("p") - F.col("t")) <= 0.5).cast("long")).alias("agree"), F.sum("p").cast("double").alias("parts"))


@R.add("""with y as (select y as fy, make_date(y - 1, 2, 1) as lo, make_date(y, 1, 31) as hi from range(1994, 2004) t(y))
select cast(y.fy as integer) as fy, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join y on cast(o_orderdate as date) between y.lo and y.hi group by y.fy""")
def fiscal_year_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders by fiscal year: a range join with a calendar of ten spans."""
    spans = spark.range(1994, 2004).select(F.col("id").cast("int").alias("fy")).select("fy", F.make_date(F.col("fy") - 1, F.lit(2), F.lit(1)).alias("lo"), F.make_date("fy", F.lit(1), F.lit(31)).alias("hi"))
    day = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))  # days before the range join
    return day.join(F.broadcast(spans), F.col("day").between(F.col("lo"), F.col("hi"))).groupBy("fy").agg(F.sum("n").alias("orders"), F.round(F.sum("s"), 2).alias("total"))


@R.add("""with n as (select distinct lower(line_item) as item from chunks where modality = 'row_fact' and line_item is not null), q as (select distinct id, lower(question) as q from golden),
m as (select id, item, row_number() over (partition by id order by length(item) desc, item) as k from q join n on contains(q, item)) select id, item from m where k = 1""")
def longest_match(spark: SparkSession, d: str) -> DataFrame:
    """The longest line item named in each question: its runs of as many words as the longest name has, joined with the names."""
    def words(c):
        return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))

    names = table(spark, d, "chunks").where("modality = 'row_fact' and line_item is not null").select(F.lower("line_item").alias("item")).distinct()
    names = names.select("item", F.array_join(words("item"), " ").alias("run"))
    asked = table(spark, d, "golden").select("id", words("question").alias("w")).distinct().where(F.size("w") > 0)
    longest = F.broadcast(names.agg(F.coalesce(F.max(F.size(F.split("run", " "))), F.lit(1)).alias("most")))  # one row
    runs = asked.crossJoin(longest).select("id", "w", "most", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("a")).select("id", "w", "a", F.explode(F.sequence(F.lit(1), F.least("most", F.size("w") - F.col("a") + 1))).alias("n"))
    found = runs.select("id", F.array_join(F.slice("w", F.col("a"), F.col("n")), " ").alias("run")).distinct().join(names, "run")
    best = found.groupBy("id").agg(F.min(F.struct((-F.length("item")).alias("_l"), "item")).alias("b"))
    return best.select("id", F.col("b.item").alias("item"))


@R.add(f"with {_FACTS} select chunk_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(line_item), '\\([0-9a-z]\\)', ' ', 'g'), '[^a-z0-9&%$ -]+', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) as label from f")
def normalize_label(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("chunk_id", X.normalise_label(F.col("line_item")).alias("label"))


@R.add(f"with {_CELLS} select chunk_id, count(distinct row_no) as n_rows, cast(max(col_no) as integer) as n_cols, sum(case when cell = '' then 1 else 0 end)::bigint as empty_cells from cells group by chunk_id")
def grid_rows(spark: SparkSession, d: str) -> DataFrame:
    """Size of the printed tables."""
    return _cells(spark, d).groupBy("chunk_id").agg(F.countDistinct("row_no").alias("n_rows"), F.max("col_no").alias("n_cols"), F.sum((F.col("cell") == "").cast("long")).alias("empty_cells"))


@R.add(rf"""with {_CELLS}, p as (select chunk_id, cell, regexp_matches(cell, '^[-–—]+$') as dash, regexp_replace(regexp_replace(cell, '[$, ]', '', 'g'), '\([a-z]\)$', '') as bare from cells where col_no > 1 and row_no > 3),
n as (select chunk_id, dash, case when regexp_matches(regexp_replace(bare, '[()%]', '', 'g'), '^-?[0-9]+(\.[0-9]+)?$') then try_cast(regexp_replace(bare, '[()%]', '', 'g') as double) end as v, regexp_matches(bare, '^\([0-9.]+\)%?$') as negative from p)
select chunk_id, case when dash then 'nil' when v is not null then 'number' else 'text' end as status, count(*) as n, round(sum(case when dash then null when negative then -v else v end), 4) as total from n group by all""")
def parse_number(spark: SparkSession, d: str) -> DataFrame:
    """Printed amounts of each table by what they turn out to be."""
    c = _cells(spark, d).where("col_no > 1 and row_no > 3").select("chunk_id", X.parse_amount(F.col("cell")).alias("p"))
    return c.groupBy("chunk_id", F.col("p.status").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("p.value"), 4).alias("total"))


@R.add(f"""with {_FACTS} select chunk_id, '| ' || replace(line_item, '|', '/') || ' | ' || concat_ws(' | ', coalesce(cast(cast(round(value_fy2026) as bigint) as varchar), '—'), coalesce(cast(cast(round(value_fy2025) as bigint) as varchar), '—'), coalesce(cast(cast(round(value_fy2024) as bigint) as varchar), '—')) || ' |' as line from f""")
def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Facts as table rows."""
    cells = [F.coalesce(F.round(f"value_fy{y}").cast("long").cast("string"), F.lit("—")) for y in YEARS]
    return _facts(spark, d).select("chunk_id", F.concat(F.lit("| "), F.replace("line_item", F.lit("|"), F.lit("/")), F.lit(" | "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


@R.add(f"with {_FACTS} select chunk_id, case when value_fy2026 < 0 then '(' || format('{{:,}}', cast(abs(round(value_fy2026)) as bigint)) || ')' else format('{{:,}}', cast(round(value_fy2026) as bigint)) end as printed from f where value_fy2026 is not null")
def format_money(spark: SparkSession, d: str) -> DataFrame:
    """Amounts with thousands marks, negative ones in parentheses."""
    whole = F.format_number(F.abs(F.round("value_fy2026")).cast("long"), 0)
    return _facts(spark, d).where("value_fy2026 is not null").select("chunk_id", F.when(F.col("value_fy2026") < 0, F.concat(F.lit("("), whole, F.lit(")"))).otherwise(whole).alias("printed"))


@R.add(f"""with {_FACTS} select chunk_id, case when lower(document) like '%million%' then 'millions' when lower(document) like '%thousand%' or document like '%000s%' then 'thousands' when lower(document) like '%billion%' then 'billions' when lower(document) like '%percent%' or lower(document) like '%per cent%' then 'percent' else 'none' end as scale from f""")
def detect_unit(spark: SparkSession, d: str) -> DataFrame:
    """Scale words in the text of a fact, the first of a fixed order."""
    t = F.lower("document")
    scale = F.when(t.contains("million"), "millions").when(t.contains("thousand") | t.contains("000s"), "thousands").when(t.contains("billion"), "billions").when(t.contains("percent") | t.contains("per cent"), "percent")
    return _facts(spark, d).select("chunk_id", scale.otherwise("none").alias("scale"))


@R.add(f"""with {_FACTS}, s as (select filing_id, page, chunk_id, coalesce(nullif(substr(regexp_replace(regexp_replace(lower(line_item), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48), ''), 'row') as slug from f),
n as (select *, row_number() over (partition by filing_id, slug order by page nulls first, chunk_id) as k from s) select chunk_id, case when k = 1 then slug else slug || '_' || k end as slug from n""")
def table_ids(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of line items, unique within a filing by a running suffix."""
    s = _facts(spark, d).select("filing_id", "page", "chunk_id", X.slug(F.col("line_item")).alias("slug"))
    k = F.row_number().over(Window.partitionBy("filing_id", "slug").orderBy("page", "chunk_id"))
    return s.withColumn("k", k).select("chunk_id", F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), F.col("k").cast("string"))).alias("slug"))


@R.add("""with e as (select distinct element_id, type, section from elements) select section, sum(case when type = 'text' then 1 else 0 end)::bigint as texts, sum(case when type = 'heading' then 1 else 0 end)::bigint as headings,
 sum(case when type = 'table' then 1 else 0 end)::bigint as tables, sum(case when type = 'list_item' then 1 else 0 end)::bigint as list_items from e group by section""")
def element_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Elements of each section by type; the pivot has its columns stated, so it needs no pass to find them."""
    e = table(spark, d, "elements").select("element_id", "type", "section").distinct()
    wide = e.groupBy("section").pivot("type", ["text", "heading", "table", "list_item"]).count()
    return wide.select("section", *[F.coalesce(a, F.lit(0)).alias(b) for a, b in (("text", "texts"), ("heading", "headings"), ("table", "tables"), ("list_item", "list_items"))])


@R.add("with c as (select distinct chunk_id, modality, token_count from chunks) select modality, count(*) as n, min(token_count) as least, median(token_count) as middle, max(token_count) as most from c group by modality")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "modality", "token_count").distinct()
    return c.groupBy("modality").agg(F.count("*").alias("n"), F.min("token_count").alias("least"), F.median("token_count").alias("middle"), F.max("token_count").alias("most"))


@R.add("""with c as (select distinct filing_id, page, chunk_id, modality from chunks) select filing_id, page, string_agg(modality, ',' order by modality) as kinds, cast(sum(n) as bigint) as chunks, min(first_id) as first_id
from (select filing_id, page, modality, count(*) as n, min(chunk_id) as first_id from c group by all) group by filing_id, page""")
def citation_chips(spark: SparkSession, d: str) -> DataFrame:
    """One chip a page of each filing: what kinds of chunk it has."""
    c = table(spark, d, "chunks").select("filing_id", "page", "chunk_id", "modality").distinct()
    kinds = c.groupBy("filing_id", "page", "modality").agg(F.count("*").alias("n"), F.min("chunk_id").alias("f"))
    return kinds.groupBy("filing_id", "page").agg(F.array_join(F.array_sort(F.collect_list("modality")), ",").alias("kinds"), F.sum("n").alias("chunks"), F.min("f").alias("first_id"))


@R.add()
def headline(spark: SparkSession, d: str) -> DataFrame:
    """The first change that can be computed of each filing, with its working."""
    a = yoy_change(spark, d).where("status = 'ok' and fy = 2026")
    names = _facts(spark, d).select("chunk_id", "filing_id", "line_item")
    first = a.join(names, "chunk_id").groupBy("filing_id").agg(F.min_by(F.struct("line_item", "absolute", "percent"), "chunk_id").alias("h"))
    return first.select("filing_id", F.format_string("%s changed by %.2f %%", F.col("h.line_item"), F.col("h.percent")).alias("text"))


@R.add("""with f as (select distinct chunk_id, filing_id, page, document from chunks where modality = 'figure' and document is not null), t as (select distinct chunk_id, filing_id, page, document from chunks where modality = 'table' and document is not null),
ft as (select chunk_id, filing_id, page, list_distinct(regexp_extract_all(lower(document), '[a-z]{4,}')) as w from f), tt as (select chunk_id, filing_id, page, list_distinct(regexp_extract_all(lower(document), '[a-z]{4,}')) as w from t),
j as (select ft.chunk_id as figure_id, tt.chunk_id as table_id, len(list_intersect(ft.w, tt.w)) as shared from ft join tt on ft.filing_id = tt.filing_id and ft.page = tt.page where len(list_intersect(ft.w, tt.w)) >= 2),
n as (select *, row_number() over (partition by figure_id order by shared desc, table_id) as k from j) select figure_id, table_id, cast(shared as integer) as shared from n where k = 1""")
def overlap_link(spark: SparkSession, d: str) -> DataFrame:
    """The table on a figure's page that shares most words with it, at least two."""
    def words(kind, name):
        c = table(spark, d, "chunks").where((F.col("modality") == kind) & F.col("document").isNotNull()).select("chunk_id", "filing_id", "page", "document").distinct()
        return c.select(F.col("chunk_id").alias(name), "filing_id", "page", F.array_distinct(F.regexp_extract_all(F.lower("document"), F.lit("([a-z]{4,})"), F.lit(1))).alias(f"w_{name}"))

    pairs = words("figure", "figure_id").join(words("table", "table_id"), ["filing_id", "page"]).withColumn("shared", F.size(F.array_intersect("w_figure_id", "w_table_id"))).where("shared >= 2")
    best = pairs.groupBy("figure_id").agg(F.min(F.struct((-F.col("shared")).alias("s"), "table_id")).alias("b"))
    return best.select("figure_id", F.col("b.table_id").alias("table_id"), (-F.col("b.s")).alias("shared"))


@R.add()
def crosscheck_cells(spark: SparkSession, d: str) -> DataFrame:
    """Facts against the printed tables of their parent: the k-th row of a label meets the k-th, and cells are compared in thousands marks, signs and nil."""
    facts = table(spark, d, "chunks").where("modality = 'row_fact' and parent_id is not null").select("chunk_id", "parent_id", "page", "line_item", *[f"value_fy{y}" for y in YEARS]).distinct()
    mine = facts.select(F.col("parent_id").alias("table_id"), "chunk_id", F.row_number().over(Window.partitionBy("parent_id").orderBy("page", "chunk_id")).alias("row_no"), ST.label_key(F.col("line_item")).alias("label_norm"), F.array(*[f"value_fy{y}" for y in YEARS]).alias("values"))
    parts = table(spark, d, "chunks").where("modality = 'table' and parent_id is not null").select(F.col("chunk_id").alias("table_id"), "parent_id", "table_part").distinct()
    theirs = _statement_rows(spark, d).join(parts, "table_id").select(F.col("parent_id").alias("table_id"), (F.coalesce("table_part", F.lit(0)) * 100_000 + F.col("row_no")).alias("row_no"), ST.label_key(F.regexp_replace("label", r"(?i)\s*(\((net|gross)\)|total)\s*$", "")).alias("label_norm"), "values")
    found = ST.compare_cells(mine.drop("chunk_id"), theirs)
    return found.join(mine.select("table_id", "row_no", "chunk_id"), ["table_id", "row_no"]).select("chunk_id", "table_id", "label_norm", "agree", F.size("differing").alias("differing"))
