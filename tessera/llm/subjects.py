"""Subject areas of documents (problem 8).

Labels spread over a graph of similar passages.  Equal texts are one node with many
members.  A sentence is reduced to a template (figures, format characters and, in
scripts without case, foreign names left out); terms of templates are weighed by how
far the trusted seeds' sentences that hold them lean to one subject, and the terms
that lean surely are the template's *core*.  Two documents are linked where they hold
sentences of one core (similarity 1) or of two cores whose weighted Jaccard similarity
is at least ``SIMILARITY``: every pair of cores that have a term in common is compared,
on the whole cores, block by block.  So links are all that meet the threshold, and they
may grow as the square of the cores.

Subjects spread over this graph in ``ROUNDS`` rounds of joins, from documents to cores,
along the links, and back.  Trusted seeds are clamped throughout: their mixture holds
their own subjects and "none" only, whatever the graph says.  Every sentence keeps its
own subject, so a document can have several.  A core that neither seeds nor links
reach is judged by its terms alone.

Defined cases: null, blank and empty texts and texts without prose have no subject;
labels of unknown documents or subjects are ignored; without labels no document has a
subject; repeated rows count once; a doc_id with several texts has the subjects of
each; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import hub_join, sized_join, strategy
from ..session import Scratch
from .pairs import language
from .sentences import sentence_spans

NONE = "none of them"
#: A document has the subjects of at least this share of its sentences.
LEAST_SHARE = 0.25
ROUNDS = 5
#: Least weighted Jaccard similarity of two linked cores.
SIMILARITY = 0.4
#: Cores of a block; two blocks are compared in one group, whose links are 16 million at most.
BLOCK = 4096
#: Cores of a block that are compared with another block at once.
AT_ONCE = 64
#: Weight of the label itself, against "none", in a seed's sentence before anything else is known.
FIRST_WEIGHT = 0.7
#: Weight of a sentence of a document without a trusted label, against one with.
UNLABELLED = 0.3
#: A seed is trusted if this share of its sentences has a core that leans to its subjects, before labels spread.
TRUST = 0.1
#: How many times likelier than "none" a subject must be by a sentence's own core.
EVIDENCE = 2.0
#: Sentences of the average mixture added to what is seen of a term or core.
PRIOR_SENTENCES = 2.0
#: Standard errors taken off what a class has of a term, so that few chance sentences are no evidence.
MARGIN = 1.0
#: Log of how many times likelier a term of a core makes one subject than "none".
LEAN = 1.0
#: Subjects are columns of the plan, so their number is bounded.
MOST_SUBJECTS = 200
#: Terms of a core overlap; their summed evidence is divided by this.
OVERLAP = 2.0

_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
#: Combining marks of Devanagari, Thai and Arabic belong to their words.
_NOT_LETTER = re.compile(r"[^\wऀ-ॿก-๛ً-ٰٟ]+")
_DIGITS = re.compile(r"\d+")
_UNSPACED = "[぀-ヿ一-鿿ก-๛]"
_CASELESS = re.compile("[぀-ヿ一-鿿ก-๛ऀ-ॿ؀-ۿ]")
_LATIN = re.compile(r"[a-z]+")


def template(sentence: str) -> str:
    """The sentence with figures and format characters left out, in scripts without case also Latin words."""
    text = unicodedata.normalize("NFKC", _HIDDEN.sub("", sentence)).casefold()
    caseless = _CASELESS.search(text) is not None
    text = _NOT_LETTER.sub(" ", _DIGITS.sub(" ", text))
    if caseless:
        text = _LATIN.sub(" ", text)
    return " ".join(text.split())


def _run(template: Column, n: int) -> Callable[[Column], Column]:
    return lambda i: F.substr(template, i, F.lit(n))


def terms(template: Column) -> Column:
    """Terms of a template: words and pairs of neighbours; in scripts without spaces runs of 2, 3 and 4 characters."""
    words = F.split(template, " ")
    two = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    spaced = F.concat(words, two)
    runs = []
    for n in (2, 3, 4):
        each = F.transform(F.sequence(F.lit(1), F.length(template) - (n - 1)), _run(template, n))
        runs.append(F.when(F.length(template) >= n, each).otherwise(F.array().cast("array<string>")))
    unspaced = F.filter(F.concat(*runs), lambda x: ~F.contains(x, F.lit(" ")))
    return F.array_distinct(F.when(template == "", F.array().cast("array<string>")).when(template.rlike(_UNSPACED), unspaced).otherwise(spaced))


_SCRIPTS = (("ja", re.compile(r"[぀-ヿ]")), ("th", re.compile(r"[ก-๛]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("zh", re.compile(r"[一-鿿]")))


def tongue(text: str) -> str:
    """Language or script of a text, as its evidence has it; "xx" for other texts."""
    letters = sum(c.isalpha() for c in text) or 1
    for name, pattern in _SCRIPTS:
        if len(pattern.findall(text)) * (10 if name == "ja" else 4) > letters:
            return name
    return language(text) or "xx"


def _slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """The batches in smaller parts, as each row gives many: a worker holds the output of one part at a time."""
    for pdf in batches:
        for a in range(0, len(pdf), rows):
            yield pdf.iloc[a : a + rows]


def _templates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in _slices(batches):
        ids, hashes, out, counts, langs = [], [], [], [], []
        for doc, h, text in zip(pdf["doc_id"], pdf["h"], pdf["text"]):
            seen: dict[str, int] = {}
            for a, b in sentence_spans(text, prose_only=True):
                t = template(text[a:b])
                seen[t] = seen.get(t, 0) + 1
            ids += [doc] * len(seen)
            hashes += [h] * len(seen)
            out += seen.keys()
            counts += seen.values()
            langs += [tongue(text)] * len(seen)
        if ids:
            yield pd.DataFrame({"doc_id": ids, "h": hashes, "lang": langs, "template": out, "n": counts})


def _vsum(vector: Column, k: int) -> Column:
    """Sum of vectors, element by element."""
    return F.array(*[F.sum(F.get(vector, F.lit(i))) for i in range(k)])


def _total(vector: Column | str) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)


def _scaled(vector: Column | str, factor: Column) -> Column:
    return F.transform(vector, lambda x: x * factor)


def _product(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def _shares(weights: DataFrame, k: int) -> DataFrame:
    """What share ``s`` of a language's sentences each class has: a row a language, of which there are ten at most."""
    by = weights.groupBy("lang").agg(_vsum(F.col("w"), k).alias("w")).withColumn("whole", _total("w"))
    return by.select("lang", F.transform("w", lambda x: (x + 0.01) / (F.col("whole") + 0.01 * k)).alias("s"))


def _read(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, h), edges (h, lang, t, n) from equal texts to templates, and templates (t, lang, fs) with hashed terms."""
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("h")).where(F.col("text").isNotNull())
    rows = scratch.keep(texts.mapInPandas(_templates, "doc_id long, h long, lang string, template string, n int").withColumn("t", F.xxhash64("lang", "template")), "rows")
    members = rows.select("doc_id", "h").distinct()
    edges = scratch.keep(rows.groupBy("h", "t", "lang").agg(F.max("n").alias("n")), "edges")
    different = rows.groupBy("t", "lang").agg(F.min("template").alias("template"))
    hashed = F.transform(terms(F.col("template")), lambda x: F.xxhash64("lang", x))
    return members, edges, scratch.keep(different.select("t", "lang", hashed.alias("fs")), "templates")


def _seeds(labels: DataFrame, members: DataFrame, names: Sequence[str]) -> DataFrame:
    """Labelled texts: h, m (1 for each class labelled, "none" always), named (how many subjects), first (the mixture of a sentence)."""
    known = labels.select("doc_id", F.coalesce("subject", F.lit(NONE)).alias("subject")).where(F.col("subject").isin(names)).distinct()
    by = known.join(members.hint("merge"), "doc_id").groupBy("h").agg(F.array(*[F.max((F.col("subject") == x).cast("double")) for x in names[:-1]]).alias("flags"))
    by = by.withColumn("named", _total("flags"))
    named = F.col("named")
    # "None of them" beside a subject is the weaker statement.
    first = F.when(named == 0, F.concat("flags", F.array(F.lit(1.0)))).otherwise(F.concat(_scaled("flags", FIRST_WEIGHT / named), F.array(F.lit(1 - FIRST_WEIGHT))))
    return by.select("h", F.concat("flags", F.array(F.lit(1.0))).alias("m"), "named", first.alias("first"))


def _cores(edges: DataFrame, templates: DataFrame, seeds: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The core of each template: (t, c), and the cores: (c, lang, fs, ws, n, e), e being the log evidence of its terms."""
    labelled = scratch.keep(sized_join(edges, seeds.select("h", "first"), "h").groupBy("t", "lang").agg(_vsum(_scaled("first", F.col("n")), k).alias("w")), "labelled")
    held = templates.select("t", "lang", F.explode("fs").alias("f"))
    by_term = labelled.drop("lang").join(held.hint("merge"), "t").groupBy("f", "lang").agg(_vsum(F.col("w"), k).alias("w"))
    shared = by_term.withColumn("whole", _total("w")).join(F.broadcast(_shares(labelled, k)), "lang")  # ten rows
    # Chance of each class given the term, against its chance in the language: a class is granted what it surely has.
    sure = F.zip_with("w", "s", lambda x, y: F.log((F.greatest(x - MARGIN * F.sqrt(x), F.lit(0.0)) / y + PRIOR_SENTENCES) / (F.col("whole") + PRIOR_SENTENCES)))
    best = F.array_max(F.slice("l", 1, k - 1))
    leaning = shared.select("f", sure.alias("l")).select("f", "l", (best - F.get("l", F.lit(k - 1))).alias("w")).where((F.col("w") >= LEAN) & (best > 0))
    # A template's terms stand together, so they are collected before the shuffle.
    members = sized_join(held, scratch.keep(leaning, "terms"), "f").groupBy("t", "lang").agg(F.array_sort(F.collect_list(F.struct("f", "w", "l"))).alias("x"))
    held_by = scratch.keep(members.select("t", "lang", F.xxhash64("lang", "x.f").alias("c"), "x"), "core_of")
    spoken = hub_join(edges.select("t", "n"), held_by.select("t", "c"), "t").groupBy("c").agg(F.sum("n").alias("n"))
    different = held_by.groupBy("c", "lang").agg(F.min("x").alias("x"))
    zero = F.array_repeat(F.lit(0.0), k)
    evidence = _scaled(F.aggregate("x.l", zero, lambda a, y: F.zip_with(a, y, lambda p, q: p + q)), F.lit(1 / OVERLAP))
    cores = different.join(spoken.hint("merge"), "c").select("c", "lang", F.col("x.f").alias("fs"), F.col("x.w").alias("ws"), "n", evidence.alias("e"))
    return held_by.select("t", "c"), scratch.keep(cores, "cores")


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b, similarity) between the two blocks of a group, or within one block, each once."""
    left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    out = {"a": [], "b": [], "similarity": []}
    if len(left) and len(right):
        flat = lambda side, name: np.concatenate(side[name].to_numpy())
        owner = lambda side: np.repeat(np.arange(len(side)), side["fs"].str.len())
        total = lambda side: np.bincount(owner(side), weights=flat(side, "ws"), minlength=len(side))
        ids, whole, by = [x["c"].to_numpy() for x in (left, right)], [total(left), total(right)], flat(right, "fs")
        order = np.argsort(by, kind="stable")
        holders, (known, start, many) = owner(right)[order], np.unique(by[order], return_index=True, return_counts=True)
        terms, weights, of = flat(left, "fs"), flat(left, "ws"), owner(left)
        place = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        met = np.flatnonzero(known[place] == terms)
        place, weights, of = place[met], weights[met], of[met]
        n = len(right)
        for low in range(0, len(left), AT_ONCE):
            high = min(low + AT_ONCE, len(left))
            p, q = np.searchsorted(of, [low, high])
            times = many[place[p:q]]
            row = np.repeat(np.arange(p, q), times)
            step = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            cell = (of[row] - low) * n + holders[start[place[row]] + step]
            common = np.bincount(cell, weights=weights[row], minlength=(high - low) * n).reshape(high - low, n)
            union = whole[0][low:high, None] + whole[1] - common
            # A sum of weights may fall short of the threshold by its rounding alone.
            i, j = np.nonzero((common > 0) & (common >= (SIMILARITY - 1e-12) * union))
            a, b = ids[0][low + i], ids[1][j]
            once = (a < b) if pdf["p"].iloc[0] == pdf["q"].iloc[0] else slice(None)
            for name, x in (("a", a), ("b", b), ("similarity", common[i, j] / union[i, j])):
                out[name].append(x[once])
    return pd.DataFrame({k: np.concatenate(v) if v else np.array([], dtype="float64" if k == "similarity" else "int64") for k, v in out.items()})


def core_links(cores: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs (a, b, similarity) of different cores with a similarity of at least ``SIMILARITY``, each pair once.

    ``cores(c, fs, ws)`` are sets of terms with weights, a weight belonging to its term;
    they are counted, so they should be a written table.  Blocks of about ``block`` cores
    meet each other once, so a core is sent as often as there are blocks, and no term of
    very many cores is a hot group.
    """
    blocks = max(-(-cores.count() // block), 1)
    placed = cores.select("c", "fs", "ws", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("own")).where(F.size("fs") > 0)
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = placed.select("c", "fs", "ws", F.lit(0).alias("side"), F.col("own").alias("p"), F.explode(F.filter(every, lambda x: x >= F.col("own"))).alias("q"))
    right = placed.select("c", "fs", "ws", F.lit(1).alias("side"), F.explode(F.filter(every, lambda x: x <= F.col("own"))).alias("p"), F.col("own").alias("q"))
    return left.unionByName(right).groupBy("p", "q").applyInPandas(_block_links, "a long, b long, similarity double")


def similar_cores(cores: DataFrame) -> DataFrame:
    """Verified links (a, b, similarity) of each core with the most frequent core of each of its terms: a part of ``core_links``.

    ``cores(c, fs, ws, n)`` are sets of terms with weights.  The representative of a term
    is one row, found by a partial maximum, so a term of very many cores is no hot group of pairs.
    """
    each = cores.select("c", "n", F.explode("fs").alias("f"))
    best = each.groupBy("f").agg(F.max(F.struct("n", "c")).alias("_r"))
    pairs = each.join(best.hint("merge"), "f").select(F.col("c").alias("a"), F.col("_r.c").alias("b")).where("a <> b").distinct()
    sets = lambda x: cores.select(F.col("c").alias(x), F.col("fs").alias(f"f{x}"), F.col("ws").alias(f"w{x}"))
    both = pairs.join(sets("b").hint("merge"), "b").join(sets("a").hint("merge"), "a")
    weigh = lambda zipped: F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x)
    common = weigh(F.zip_with("fa", "wa", lambda f, w: F.when(F.array_contains("fb", f), w).otherwise(0.0)))
    union = weigh(F.col("wa")) + weigh(F.col("wb")) - common
    return both.select("a", "b", (common / union).alias("similarity")).where(F.col("similarity") >= SIMILARITY)


def _grown(cores: DataFrame, weights: DataFrame, links: DataFrame, rest: DataFrame, k: int, by_core: str) -> DataFrame:
    """``c, l``: how likely each class is in a sentence of the core, against its share of the language.

    What a core holds is what the texts that hold it gave it, and what its links hold, by their similarity.
    """
    zero = F.array_repeat(F.lit(0.0), k)
    # A core has many links, so they stay where they are if its weights can come to them, and no array is made for each.
    near = links.join(weights.select(F.col("c").alias("b"), "w").hint(by_core), "b").groupBy(F.col("a").alias("c"))
    far = near.agg(F.array(*[F.sum(F.get("w", F.lit(i)) * F.col("similarity")) for i in range(k)]).alias("far"))
    own = cores.select("c", "lang", "e").join(weights.hint("merge"), "c", "left").withColumn("w", F.coalesce("w", zero))
    shares = F.broadcast(_shares(own.select("lang", "w").unionByName(rest), k))  # ten rows
    both = own.join(far.hint("merge"), "c", "left").join(shares, "lang").withColumn("held", F.zip_with("w", F.coalesce("far", zero), lambda x, y: x + y))
    both = both.withColumn("whole", _total("held"))
    prior = F.zip_with("e", "s", lambda x, y: PRIOR_SENTENCES * F.least(F.exp(x), 1 / y))
    seen = F.zip_with(F.zip_with("held", "s", lambda x, y: x / y), prior, lambda x, y: x + y)
    return both.select("c", _scaled(seen, 1 / (F.col("whole") + PRIOR_SENTENCES)).alias("l"))


def propagate(spark: SparkSession, documents: DataFrame, labels: DataFrame, subjects: Sequence[str], rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, subject, share`` of every document and subject that its sentences deal with.

    A vector of classes is one array column, "none" last.  Every table that a round reads
    is written or kept in partitions by text, so a round shuffles partial sums by core
    only.  Cores are joined by broadcast while they are at most ``joins.BROADCAST_ROWS``,
    else by sort and merge.
    """
    names = [*subjects, NONE]
    k = len(names)
    scratch = Scratch(spark)
    members, edges, templates = _read(documents, scratch)
    seeds = scratch.keep(_seeds(labels, members, names), "seeds")
    if seeds.isEmpty():
        scratch.clear()
        return spark.createDataFrame([], "doc_id long, subject string, share double")
    core_of, cores = _cores(edges, templates, seeds, k, scratch)
    found = scratch.keep(core_links(cores), "links")
    links = found.union(found.select("b", "a", "similarity"))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.keep(hub_join(edges.select("h", "t", "n"), core_of, "t").groupBy("h", "c").agg(F.sum("n").alias("n")), "placed").repartition(parts, "h").persist()
    sizes = edges.groupBy("h", "lang").agg(F.sum("n").alias("size")).join(placed.groupBy("h").agg(F.sum("n").alias("cored")).hint("merge"), "h", "left")
    texts = scratch.keep(sized_join(sizes, seeds, "h", "left"), "texts").repartition(parts, "h").persist()
    # Sentences without a core need no edge, but they are all "none" and count in the size of their text.
    spare = F.when(F.col("named").isNull(), UNLABELLED).otherwise(1.0) * (F.col("size") - F.coalesce("cored", F.lit(0)))
    rest = scratch.keep(texts.groupBy("lang").agg(F.concat(F.array_repeat(F.lit(0.0), k - 1), F.array(F.sum(spare))).alias("w")), "rest")
    last = F.lit(k - 1)
    trusted, by_text = None, ""
    by_core = strategy(cores)  # lifts have a row a core
    joint = placed.join(texts.where("named is not null").select("h", "first"), "h").select("c", "n", F.lit(1.0).alias("u"), F.col("first").alias("q"))
    for number in range(rounds + 1):
        weights = scratch.keep(joint.groupBy("c").agg(_vsum(_scaled("q", F.col("n") * F.col("u")), k).alias("w")), f"weights{number}")
        lifts = scratch.keep(_grown(cores, weights, links, rest, k, by_core), f"lifts{number}")
        scored = placed.join(lifts.hint(by_core), "c")
        seen = scored.withColumn("z", _total("l")).groupBy("h").agg(_vsum(_scaled("l", F.col("n") / F.col("z")), k).alias("p"))
        mixture = texts.where("cored is not null").join(seen, "h")
        mixture = mixture.withColumn("p", F.transform("p", lambda x, i: (x + F.when(i == last, F.col("size") - F.col("cored")).otherwise(0)) / F.col("size")))
        if trusted is None:
            agreed = _total(F.slice(_product("p", "m"), 1, k - 1))
            trusted = scratch.keep(mixture.where((F.col("named") == 0) | (agreed >= TRUST)).select("h", F.when(F.col("named") > 0, F.col("m")).otherwise(F.transform("m", lambda _, i: (i == last).cast("double"))).alias("clamp")), "trusted")
            by_text = strategy(trusted)
        mixture = mixture.select("h", "size", "p").join(trusted.hint(by_text), "h", "left")
        prior = F.transform("p", lambda x, i: x + F.when(i == last, 0.1).otherwise(0.02))
        held = F.when(F.col("clamp").isNotNull(), _product(prior, "clamp")).otherwise(prior)
        u = F.when(F.col("clamp").isNotNull(), 1.0).otherwise(UNLABELLED)
        joint = scored.join(mixture.select("h", "size", u.alias("u"), held.alias("held")), "h").withColumn("lp", _product("l", "held"))
        joint = joint.withColumn("z", _total("lp"))
        joint = joint.select("h", "c", "n", "size", "u", "l", _scaled("lp", F.when(F.col("z") > 0, 1 / F.col("z")).otherwise(0.0)).alias("q"))

    # A sentence deals with a subject that is likelier than all else together, and that its own core bears out.
    wins = F.zip_with("l", "q", lambda x, y: F.when((x > EVIDENCE * F.get("l", last)) & (y > 0.5), F.col("n")).otherwise(0).cast("double"))
    won = joint.groupBy("h").agg(F.max("size").alias("size"), _vsum(wins, k - 1).alias("x"))
    each = won.select("h", "size", F.posexplode("x").alias("i", "n")).where(F.col("n") > 0)
    found = each.select("h", F.get(F.array(*[F.lit(x) for x in names]), F.col("i")).alias("subject"), (F.col("n") / F.col("size")).alias("share"))
    out = members.join(found.hint("merge"), "h").groupBy("doc_id", "subject").agg(F.max("share").alias("share")).checkpoint()
    placed.unpersist()
    texts.unpersist()
    scratch.clear()
    return out


def subjects_of(spark: SparkSession, documents: DataFrame, labels: DataFrame, subjects: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """``doc_id, subject, share`` for subjects of at least ``least_share`` of a document's sentences.

    The subject names (a table of a few rows) become columns of the plan; more than
    ``MOST_SUBJECTS`` raise an error.
    """
    names = sorted(r[0] for r in subjects.select("subject").where(F.col("subject").isNotNull()).distinct().limit(MOST_SUBJECTS + 1).collect())
    if not names:
        return spark.createDataFrame([], "doc_id long, subject string, share double")
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    return propagate(spark, documents, labels, names).where(F.col("share") >= least_share - 1e-9)
