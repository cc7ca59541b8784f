"""Quantities recorded in different units (problem 4).

Every value is brought to the common unit of its dimension.  A recorded unit is
read with a lexicon of spellings.  Where the unit is missing or useless, a
random forest predicts it from the size of the value and of its neighbours, the
source, the category and the unit words of the text around it; its confidence is
calibrated on held-out rows.  The forest alone names the unit: a confident prediction
is converted, an unsure one only if an exact check bears it out (the text spells the
predicted unit in full), and a prediction that the text contradicts, like all others,
goes to review.

Defined cases: null, NaN and infinite values give no row; null, blank and unknown units count as
missing; repeated rows give one row; extra columns are ignored; without labelled
rows there is no forest, and every missing unit goes to review.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import use_shared_folder

# --- fixed values: units, their dimension, size in base units, and spellings (lower case) -------------
UNITS: dict[str, tuple[str, float, str]] = {
    "usd": ("money", 1.0, "usd|us$|dollars|whole us dollars|us dollars|in dollars"),
    "usd_thousands": ("money", 1e3, "usd_thousands|$'000|$000s|kusd|usd k|thousand usd|usd in thousands|tsd. usd|千美元|thousands of dollars|in thousands of us dollars"),
    "usd_millions": ("money", 1e6, "usd_millions|usd millions|usd mn|musd|$m|us$ m|$ millions|usd in millions|mio. usd|百万美元|millions of us dollars|millions of dollars"),
    "usd_billions": ("money", 1e9, "usd_billions|us$bn|bn usd|usd in billions|mrd. usd|十亿美元|billions of dollars|billions of us dollars"),
    "cents_per_share": ("per_share", 1.0, "cents_per_share|us cents per share|cents per share"),
    "usd_per_share": ("per_share", 100.0, "usd_per_share|usd per share|$/share|dollars per share"),
    "shares": ("share_count", 1.0, "shares|number of shares"),
    "shares_thousands": ("share_count", 1e3, "shares_thousands|'000 shares|shares in thousands|thousand shares"),
    "shares_millions": ("share_count", 1e6, "shares_millions|million shares|m shares|shares in millions"),
    "basis_points": ("rate", 1.0, "basis_points|bp|bps|basis points"),
    "percent": ("rate", 100.0, "percent|per cent|pct|%"),
    "fraction": ("rate", 10000.0, "fraction|ratio|ratio, 1 = all|fraction of one"),
    "square_metres": ("area", 1.0, "square_metres|square metres|sqm|m2"),
    "square_feet": ("area", 0.09290304, "square feet|sq ft|sf|ft2"),
    "thousand_square_feet": ("area", 92.90304, "thousand sq ft|ksf|thousands of square feet"),
    "hectares": ("area", 10000.0, "hectares|ha"),
    "acres": ("area", 4046.8564224, "acres|ac"),
    "kilowatt_hours": ("energy", 1.0, "kilowatt_hours|kwh|kilowatt-hours"),
    "megawatt_hours": ("energy", 1e3, "mwh|megawatt-hours"),
    "gigawatt_hours": ("energy", 1e6, "gwh|gigawatt-hours"),
    "gigajoules": ("energy", 2500 / 9, "gj|gigajoules"),
    "terajoules": ("energy", 2500000 / 9, "tj|terajoules"),
    "kilograms": ("mass", 1.0, "kilograms|kg"),
    "tonnes": ("mass", 1e3, "t|tonnes|metric tons"),
    "kilotonnes": ("mass", 1e6, "kt|kilotonnes"),
    "pounds": ("mass", 0.45359237, "pounds|lb|lbs"),
    "short_tons": ("mass", 907.18474, "short tons"),
}
#: Words of a unit, as patterns; each is one feature of the forest.
UNIT_WORDS = (
    r"thousand|000|\bk|tsd|千", r"million|mio\.|百万|\bmn\b|\bm\b|\bmusd\b|\$m\b", r"billion|mrd|十亿|bn", r"cents?\b|cents_", r"share", r"per.?cent|pct|%",
    r"basis|\bbps?\b", r"fraction|ratio", r"dollar|usd|\$|美元", r"kilowatt|\bkwh", r"megawatt|\bmwh", r"gigawatt|\bgwh", r"gigajoule|\bgj", r"terajoule|\btj",
    r"kilogram|\bkg\b", r"metric ton|\btonnes|^t$", r"kilotonne|\bkt\b", r"\blbs?\b|pound", r"short ton", r"square.?met|sqm|m2", r"square feet|sq ft|ft2|\bk?sf\b", r"hectare|\bha\b", r"acres|\bac\b",
)
#: The forest is fitted on about this many labelled rows of each unit at most, by hash of the id, so that rare units are learned too.
SAMPLE_ROWS = 400
CONFIDENT = 0.9
TREES, DEPTH = 24, 14
#: Binary digits of a hash that tell categories, and sources, apart.
CATEGORY_BITS, SOURCE_BITS = 12, 6
NAMES = tuple(UNITS)

_SPELLINGS = {s: name for name, (_, _, spellings) in UNITS.items() for s in spellings.split("|")}
_PHRASES = "|".join(re.escape(s) for s in sorted(_SPELLINGS, key=lambda s: (-len(s), s)))
_IN_TEXT = rf"(?<![\w$'/])(?:{_PHRASES})(?![\w/])"


def _lookup(spelling: Column, values: dict[str, str | float]) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), spelling)


def unit_name(spelling: Column) -> Column:
    """Name of the unit that is spelt, or null."""
    return _lookup(F.lower(F.trim(F.coalesce(spelling, F.lit("")))), dict(_SPELLINGS))


def text_phrase(text: str) -> Column:
    """The longest spelling of a unit in a column of lower-case text, or null; the first of equals."""
    found = F.regexp_extract_all(F.col(text), F.lit(_IN_TEXT), F.lit(0))
    return F.get(F.array_sort(found, lambda a, b: F.length(b) - F.length(a)), F.lit(0))


def _features(value: Column, phrase: Column) -> Column:
    """Features of one measurement as an array of doubles, none of them null."""
    value = F.coalesce(value, F.lit(0.0))
    size = F.when(value == 0, F.lit(-12.0)).otherwise(F.log10(F.abs(value)))
    decimals = F.length(F.regexp_extract(F.format_string("%.6f", F.abs(value)), r"\.(\d*?)0*$", 1)).cast("double")
    category = F.lower(F.coalesce("category", F.lit("")))
    words = [F.coalesce(F.lower(phrase).rlike(w), F.lit(False)).cast("double") for w in UNIT_WORDS]
    kinds = [category.rlike(p).cast("double") for p in (r"per share", r"shares", r"rate|margin|turnover|percent", r"space|land|area|floor", r"electric|heat|energy|power", r"emitted|waste|mass|weight")]
    # A tree can tell any category from any other by the digits of its hash.
    places = [F.pmod(F.shiftright(F.xxhash64(F.regexp_replace(category, r"\(.*?\)", "")), n), F.lit(2)).cast("double") for n in range(CATEGORY_BITS)]
    places += [F.pmod(F.shiftright(F.xxhash64(F.coalesce("source", F.lit(""))), n), F.lit(2)).cast("double") for n in range(SOURCE_BITS)]
    near = F.abs(F.coalesce("neighbour", F.lit(0.0)))
    ratio = F.when((near == 0) | (value == 0), F.lit(0.0)).otherwise(F.log10(F.abs(value)) - F.log10(near))
    before = F.when(F.coalesce("neighbour", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.log10(F.abs("neighbour")))
    return F.array(size, decimals, (value < 0).cast("double"), before, ratio, *kinds, *places, F.coalesce(phrase, F.lit("")).__eq__("").cast("double"), *words)


def prepare(items: DataFrame) -> DataFrame:
    """Adds the unit read from the unit field (``recorded``), the phrase in the text and its unit (``spelt``)."""
    cleaned = F.expr("replace(lower(coalesce(text, '')), lower(coalesce(category, ' ')), ' ')")
    seen = items.select("item_table", "item_id", "value", "unit", "text", "category", "source", "neighbour").where(F.col("value").isNotNull() & (F.abs("value") < float("inf")))
    seen = seen.withColumn("recorded", unit_name(F.col("unit")))
    missing = F.col("recorded").isNull()
    seen = seen.withColumn("_clean", F.when(missing, cleaned)).withColumn("phrase", F.when(missing, text_phrase("_clean")))
    return seen.withColumn("spelt", unit_name(F.col("phrase"))).drop("_clean", "text")


class UnitForest:
    """A random forest over labelled rows with calibrated confidence."""

    def __init__(self, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> None:
        columns = ["item_table", "item_id", "value", "unit", "category", "source", "neighbour", "recorded"]
        # One row a unit: what share of its rows makes about ``sample_rows``.
        shares = labelled.groupBy("recorded").agg((F.lit(float(sample_rows)) / F.count("*")).alias("_share"))
        place = F.pmod(F.xxhash64("item_id", "item_table", F.lit(seed)), F.lit(1_000_000)) / 1e6
        sample = labelled.select(*columns).join(F.broadcast(shares), "recorded").where(place < F.col("_share")).select(*columns)
        fold = F.pmod(F.xxhash64("item_id", F.lit(1)), F.lit(10))
        # A fifth of the rows hides its unit words, so that size, category and source must do.
        words = F.when(F.pmod(F.xxhash64("item_id", F.lit(2)), F.lit(5)) > 0, F.col("unit"))
        label = _lookup(F.col("recorded"), {n: float(i) for i, n in enumerate(NAMES)})
        rows = sample.select(fold.alias("fold"), label.alias("label"), array_to_vector(_features(F.col("value"), words)).alias("features"))
        rows = rows.repartition(4).cache()
        self.model = None
        try:
            held = rows.where("fold >= 7")
            if rows.where("fold < 7").select("label").distinct().limit(2).count() < 2:
                return
            forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=32, seed=seed, featureSubsetStrategy="0.5")
            self.model = forest.fit(rows.where("fold < 7"))
            checked = self.model.transform(held).select(F.array_max(vector_to_array("probability")).alias("sure"), (F.col("prediction") == F.col("label")).cast("double").alias("right"))
            self.curve = IsotonicRegression(labelCol="right", featuresCol="sure").fit(checked) if checked.limit(1).count() else None
        finally:
            rows.unpersist()

    def predict(self, prepared: DataFrame) -> DataFrame:
        """``prepared`` with ``predicted`` and calibrated ``confidence``."""
        if self.model is None:
            return prepared.withColumn("predicted", F.lit(None).cast("string")).withColumn("confidence", F.lit(0.0))
        seen = self.model.transform(prepared.withColumn("features", array_to_vector(_features(F.col("value"), F.col("phrase")))))
        seen = seen.withColumn("sure", F.array_max(vector_to_array("probability")))
        sure = F.col("sure")
        if self.curve is not None:
            at: dict[float, float] = {}
            for x, y in zip(self.curve.boundaries, self.curve.predictions):
                at.setdefault(float(y), float(x))  # where the curve first reaches y
            reached = F.size(F.filter(F.array(*[F.lit(x) for x in at.values()]), lambda x: x <= sure))
            sure = F.get(F.array(*[F.lit(y) for y in at]), F.greatest(reached - 1, F.lit(0)))
        names = F.array(*[F.lit(n) for n in NAMES])
        picked = F.element_at(names, F.col("prediction").cast("int") + 1)
        return seen.withColumn("predicted", picked).withColumn("confidence", sure).drop("features", "rawPrediction", "probability", "prediction", "sure")


def resolve(items: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The unit of every value: ``resolved``, how it was found (``by``: recorded, forest, checked, review)."""
    use_shared_folder(items.sparkSession)
    ready = prepare(items)
    known = ready.where(F.col("recorded").isNotNull())
    # The phrase and the forest's votes are each used in many places: written once, not computed again for each.
    asked = ready.where(F.col("recorded").isNull()).checkpoint()
    missing = UnitForest(known, sample_rows).predict(asked).checkpoint()
    sure = (F.col("confidence") >= CONFIDENT) & F.col("predicted").isNotNull()
    fits, silent = F.col("spelt") == F.col("predicted"), F.col("spelt").isNull()
    by = F.when(sure & (silent | fits), "forest").when(fits, "checked").otherwise("review")
    unit = F.when(by != "review", F.col("predicted"))
    columns = ["item_table", "item_id", "value", "category"]
    found = missing.select(*columns, unit.alias("resolved"), by.alias("by"), "predicted", "confidence")
    return known.select(*columns, F.col("recorded").alias("resolved"), F.lit("recorded").alias("by"), F.lit(None).cast("string").alias("predicted"), F.lit(None).cast("double").alias("confidence")).unionByName(found)


def convert(resolved: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds ``dimension``, ``common_unit`` and ``common_value``, the value in the common unit, to the nearest whole."""
    sizes = {n: s for n, (_, s, _) in UNITS.items()}
    known = resolved.withColumn("dimension", _lookup(F.col("resolved"), {n: d for n, (d, _, _) in UNITS.items()}))
    goal = F.broadcast(targets.select("dimension", "common_unit").dropDuplicates(["dimension"]))  # one row a dimension
    joined = known.join(goal, "dimension", "left")
    exact = F.col("value") * (_lookup(F.col("resolved"), sizes) / _lookup(F.col("common_unit"), sizes))
    return joined.withColumn("common_value", F.rint(exact).try_cast("long"))
