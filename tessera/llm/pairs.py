"""Broken prompt and response pairs (problem 3).

Each pair is read once: emptiness, copies, unfinished ends and the languages of
both sides are found from the pair alone.  Refusals are found from the corpus:
the openings of answers that bring no evidence (neither a figure nor the statement
that there is nothing) are reduced to templates, equal templates are counted, similar
ones are clustered by verified MinHash of their runs of characters, and a cluster that
recurs over unrelated prompts is a refusal, whatever its words.  How unrelated the
prompts of a cluster are is measured: their mean pairwise Jaccard similarity, estimated
by MinHash from counts.  Wording is a weak prior: where it declines, two prompts are
enough, else ``LEAST_PROMPTS`` are needed; under one prompt alone nothing is a refusal.

Openings have 3 to 20 words, so runs of five words could not link two wordings of one
template; runs of ``RUN`` characters (2 in scripts without spaces) do.

Defined cases: a null answer is empty; a null question has no language, can't be
copied and is a prompt like any other; repeated rows give one row; each pair gets at
most one defect, in the order empty, copy, truncated, refusal, other_language.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.minhash import classes, similar_pairs, signature

# --- fixed values: wording ---------------------------------------------------------------------
PLACEHOLDERS = frozenset(
    "n/a|na|n.a.|none|null|nil|nan|tbd|tba|todo|empty|(empty)|[empty]|no answer|[no answer]|(no answer)|missing|undefined|"
    "answer|answer:|a:|antwort:|réponse:|respuesta:|unknown|<answer>|[answer]|(none)|[none]|(null)|pending|to be determined|k. a.|k.a.|s/d|无|暂无|なし|空".split("|")
)
STOPWORDS = {
    "en": "the of and to for was were is from by at with on up that this which be are how what why did report list drivers between names came rose fell mainly because according million year before reported higher than".split(),
    "de": "der die das und bei von im ist wie hoch war warum hat sich nennen sie für auf ein eine den dem des geht zurück laut bericht liegt wert also über dem vorjahr betrug nicht ich zu mit millionen anstieg".split(),
    "fr": "le les des du et pour quel était pourquoi a-t-il varié en un une vient hausse rapport cite montant supérieur celui l'an passé s'élevait à voir ne pas je est d'un dans sur millions au aux cette".split(),
    "es": "el los las del y por qué cambió cuánto fue una subida se debe informe indica millones encima anterior véase al con para no que año lo puedo su mayores nuevos compra".split(),
}
LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|inglés|英语|英文|英語",
    "de": "german|deutsch|allemand|alemán|德语|德文|ドイツ語",
    "fr": "french|französisch|français|francés|法语|法文|フランス語",
    "es": "spanish|spanisch|espagnol|español|castellano|西班牙语|スペイン語",
    "zh": "chinese|chinesisch|chinois|chino|中文|汉语|中国語",
    "ja": "japanese|japanisch|japonais|japonés|日语|日文|日本語",
}
DECLINING = re.compile(
    r"\b(?:i|we)\b.{0,40}\b(?:can't|can not|cannot|won't|unable|not able|not (?:allowed|permitted)|decline|rather not|have to pass|do not have access|don't have access|must not|may not)\b"
    r"|\b(?:can't|cannot|unable to) (?:help|answer|comment|discuss|provide|assist|say)\b|\bno (?:answer|statement|comment)\b.{0,30}\b(?:can|given|made|possible)\b"
    r"|\bnot possible for me\b|\b(?:outside|beyond) what (?:i|we)\b|\bagainst my\b|\bmy (?:guidelines|instructions|rules|policy)\b|\b(?:turned down|prevent me|refuse)\b|\bwon't be able\b|\bwhat i am allowed\b"
    r"|\b(?:kann|darf|möchte|werde) ich\b.{0,40}\b(?:nicht|nichts|keine)\b|\bich\b.{0,40}\b(?:nicht|nichts|keine)\b.{0,40}(?:äußer|sagen|beantwort|auskunft|helfen)|\bkeine auskunft\b"
    r"|\bne (?:peux|puis|suis|souhaite|veux)\b|\bimpossible de\b|\bpas le droit\b|\bpréfère ne\b|\bpas en mesure\b"
    r"|\bno (?:puedo|podemos|me est[áa]|estoy|debo)\b|\bprefiero no\b|\bme temo que no\b|\bno me es posible\b"
    r"|(?:无法|不能|不便|不予|拒绝|恕).{0,12}(?:回答|提供|评论|讨论|帮助|协助|相关)|超出.{0,12}范围|恕我"
    r"|できません|控えさせ|いたしかね|出来ません|お断り",
    re.I,
)

_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*", re.U)
_KANA = re.compile(r"[぀-ヿ]")
_HAN = re.compile(r"[一-鿿]")
_QUOTED = re.compile(r"\"[^\"]{8,}\"|“[^”]{8,}”|„[^“]{8,}“|«[^»]{8,}»|「[^」]{4,}」")
_TAGS = re.compile(r"<[^<>]{0,40}>")
_CITED = re.compile(r"\s*(?:\[[^\[\]]{1,24}\]|\((?:source|quelle|source :|fuente|来源|出典)[^()]{0,60}\))\s*$", re.I)
_FINISHED = re.compile(r"[.!?。！？…｡।؟][\"”’»“)）」』】\]*_]*$")
_AMOUNT = re.compile(
    r"[-+(]?\s*(?:(?:usd|us\$|\$|€|eur|m\$)\s*)?[-+]?\d[\d.,  ' ]*(?:\s*(?:%|percent|per cent|prozent|bp|usd|us\$|\$|€|k|m|mn|bn|mio\.?|mrd\.?|mill\.?|million|millions|millones|millionen|milliarden|billion|billions|de|dollars?|dólares|dollar|m\$|"
    r"million dollars|百万美元|亿美元|百万ドル|億ドル|美元|ドル))*\s*\)?",
    re.I,
)
_BRIEF = re.compile(r"(?:(?:not|none|no|nil|zero|immaterial|nicht|keine|kein|néant|non|aucun|aucune|ninguno|ninguna|sin|sí|yes|ja|oui)\b|不|没有|無|该).{0,24}", re.I)
_OPEN_END = re.compile(r"(?:[,;:(\[{$€+=&/–—-]|\b(?:the|a|an|and|or|of|to|by|in|for|with|from|which|that|is|was|were|der|die|das|und|von|zu|le|la|les|et|de|du|el|los|las|y))$", re.I)
#: An amount cut at its decimal mark only looks finished.
_CUT_AMOUNT = re.compile(r"(?:[$€]\s?|\b(?:by|to|of|from|um|USD)\s)(?!(?:19|20)\d\d[.,]$)\d[\d,]*[.,]$")
_LIST_ROW = re.compile(r"\s*[-*•]\s+")
_SEQUENCE = re.compile(r"(?:you asked|the question is|question|you want to know|you wrote|q|a|re|answer|your question|frage|ihre frage|antwort|question posée|pregunta|respuesta|问题|您的问题|回答|質問|ご質問)")


def flat(text: str) -> str:
    """Letters and digits only, case folded, one space between words."""
    return " ".join(_WORD.findall(unicodedata.normalize("NFKC", text).casefold()))


def language(text: str | None) -> str | None:
    """Language of a text among en, de, fr, es, zh and ja, or None without evidence."""
    if not text:
        return None
    if _KANA.search(text):
        return "ja"
    han = len(_HAN.findall(text))
    words = [w.casefold().replace("’", "'") for w in re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", text)]
    latin = [w for w in words if not _HAN.search(w)]
    if han and han >= 2 * len(latin) or han >= 6:
        return "zh"
    counts = {k: sum(w in v for w in latin) for k, v in _STOPS.items()}
    top = max(counts, key=counts.get)
    rest = max(v for k, v in counts.items() if k != top)
    return top if counts[top] > rest else None


_STOPS = {k: frozenset(v) for k, v in STOPWORDS.items()}
_REQUESTS = [
    (k, re.compile(rf"(?:reply|answer|respond|write|antworte\w*|antwort|répon\w+|respon\w+|conteste|回答|答え)\W+(?:\w+\W+){{0,2}}?(?:in|auf|en|用|を)?\W*(?:{names})|(?:{names})\W+(?:answer|reply|response|antwort)|[用以](?:{names})回答|(?:{names})で", re.I))
    for k, names in LANGUAGE_NAMES.items()
]


def wanted_language(question: str | None) -> str | None:
    """The language a question asks for, else its own."""
    if not question:
        return None
    for k, pattern in _REQUESTS:
        if pattern.search(question):
            return k
    return language(question)


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = "".join(c for c in _TAGS.sub("", answer) if unicodedata.category(c) not in ("Cf", "Cc") or c.isspace()).strip()
    if bare.casefold() in PLACEHOLDERS or bare.casefold().strip("[](){}<>*_ ") in PLACEHOLDERS:
        return True
    return not any(c.isalnum() for c in bare)


def is_copy(question: str | None, answer: str) -> bool:
    """Whether the answer gives only the question back, perhaps repeated, marked up or introduced."""
    q, a = flat(question or ""), flat(answer)
    if len(q) < 4 or not a:
        return False
    if a == q or len(a) >= 0.6 * len(q) and a in q and len(a) > 12:
        return True
    if q not in a:
        return False
    rest = a.replace(q, " ").split()
    return not rest or bool(_SEQUENCE.fullmatch(" ".join(rest))) or len(rest) <= 4 and not any(w.isdigit() for w in rest) and not _FINISHED.search(answer.rstrip()[-1:])


def _balanced(text: str) -> bool:
    return text.count("(") <= text.count(")") and text.count("“") <= text.count("”") + text.count("„") and text.count('"') % 2 == 0 and text.count("```") % 2 == 0 and text.count("«") <= text.count("»") and text.count("（") <= text.count("）")


def is_truncated(answer: str) -> bool:
    """Whether the answer breaks off: no end mark, and no form that is whole without one."""
    text = answer.strip()
    cut = _CITED.sub("", text)
    if cut and cut != text and _FINISHED.search(cut):
        return False
    text = text.strip("*_ \n")
    if _FINISHED.search(text):
        return bool(_CUT_AMOUNT.search(text))
    if _AMOUNT.fullmatch(text):
        return not _balanced(text)
    lines = [x for x in text.split("\n") if x.strip()]
    if lines[-1].lstrip().startswith("|"):
        return lines[-1].count("|") < lines[0].count("|") or len(lines) < 3 or lines[-1].count("|") < lines[-2].count("|")
    if len(lines) > 2 and _LIST_ROW.match(lines[-1]) and _LIST_ROW.match(lines[-2]):
        return bool(_OPEN_END.search(text)) or not re.search(r"(?:\b(?:in|im|en) \d{4}|before|vorjahr|précédente?|anterior|passé|前年|上一年|年)\W*$", text, re.I)
    if _OPEN_END.search(text) or not _balanced(text):
        return True
    return not (len(text) <= 30 and _BRIEF.fullmatch(text))


def opening(question: str | None, answer: str) -> str:
    """Template of the first sentence: numbers and the words of the question are left out."""
    first = re.split(r"(?<=[.!?。！？])\s*", answer.strip(), maxsplit=1)[0]
    known = set(flat(question or "").split())
    text = unicodedata.normalize("NFKC", first).casefold()
    if _HAN.search(text) or _KANA.search(text):
        names = [w for w in re.findall(r"[a-z][a-z'.]*", (question or "").casefold())]
        for w in names:
            text = text.replace(w, "")
        return "".join(c for c in text if c.isalpha())
    return " ".join("_" if w in known and w not in _FUNCTION else w for w in _WORD.findall(text) if not w.isdigit())


_FUNCTION = frozenset(w for v in STOPWORDS.values() for w in v) | frozenset("i a an in not can't my me de la que ne pas no ich nicht".split())


def has_evidence(question: str | None, answer: str) -> bool:
    """Whether the answer has a figure that the question has not, or states that there is nothing to tell of."""
    if _BRIEF.fullmatch(answer.strip().rstrip(".!。")):
        return True
    asked = set(re.findall(r"\d+(?:[.,]\d+)*", question or ""))
    return any(n not in asked for n in re.findall(r"\d+(?:[.,]\d+)*", answer))


def _inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for q, a in zip(pdf["question"], pdf["answer"]):
            q = q if isinstance(q, str) else None
            a = a if isinstance(a, str) else None
            if is_empty(a):
                rows.append(("empty", None, None, False, False))
            elif is_copy(q, a):
                rows.append(("copy", None, None, False, False))
            elif is_truncated(a):
                rows.append(("truncated", None, None, False, False))
            else:
                want = wanted_language(q)
                bare = _QUOTED.sub(" ", a)
                got = None if _AMOUNT.fullmatch(a.strip()) else language(bare if len(bare) > 12 else a)
                foreign = want is not None and got is not None and want != got
                plain = not has_evidence(q, a)
                rows.append(("other_language" if foreign else None, opening(q, a) if plain else None, flat(q or "") if plain else None, plain, plain and bool(DECLINING.search(a.replace("’", "'")))))
        part = pd.DataFrame(rows, columns=["defect", "opening", "prompt", "plain", "declines"])
        yield pd.concat([pdf[["pair_table", "pair_id"]].reset_index(drop=True), part], axis=1)


SCHEMA = "pair_table string, pair_id string, defect string, opening string, prompt string, plain boolean, declines boolean"


#: Runs of so many characters are compared, in scripts without spaces of 2.
RUN = 4
#: Least Jaccard similarity of two openings in one cluster.
SIMILARITY = 0.5
#: A template recurs if it answers so many unrelated prompts, or two of them where its wording declines.
LEAST_PROMPTS = 3
#: Prompts of a cluster are unrelated if their mean pairwise similarity is at most this.
RELATED = 0.6
#: MinHash values by which the similarity of prompts is estimated.
PROMPT_HASHES = 16


def character_runs(text: Column) -> Column:
    """Hashes of the runs of characters of a text, or of the whole where it is shorter; distinct."""
    n = F.when(text.rlike("[぀-ヿ一-鿿]"), 2).otherwise(RUN)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.substr(text, i, n)))
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array_distinct(runs))


def prompt_similarity(prompts: DataFrame) -> DataFrame:
    """``class, prompts, related``: the number of different prompts and their mean pairwise Jaccard similarity.

    Two sets agree in a MinHash value with a chance of their similarity, so the share of
    agreeing pairs, which counts by value give without forming a pair, estimates the mean.
    """
    once = prompts.groupBy("class", "prompt").agg(F.lit(1).alias("_1")).drop("_1")
    hashed = once.select("class", F.posexplode(signature(character_runs(F.col("prompt")), PROMPT_HASHES)).alias("k", "v"))
    agreeing = hashed.groupBy("class", "k", "v").agg(F.count("*").alias("n")).groupBy("class").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("_same"))
    sizes = once.groupBy("class").agg(F.count("*").alias("prompts"))
    pairs = F.col("prompts") * (F.col("prompts") - 1) * PROMPT_HASHES
    return sizes.join(agreeing.hint("merge"), "class").select("class", "prompts", F.coalesce(F.try_divide(F.col("_same"), pairs), F.lit(1.0)).alias("related"))


def refusal_templates(seen: DataFrame, least_prompts: int = LEAST_PROMPTS) -> DataFrame:
    """Openings of refusals among the inspected answers without evidence: ``opening``, ``class``.

    Equal openings are counted first (partial counts before the shuffle), so a template
    with a third of all rows is one row from then on; only distinct templates are compared.
    """
    plain = seen.where(F.col("plain") & (F.col("opening") != ""))
    templates = plain.groupBy("opening").agg(F.count("*").alias("n"), F.sum(F.col("declines").cast("int")).alias("declining")).withColumn("id", F.xxhash64("opening")).checkpoint()
    links = similar_pairs(templates.select("id", character_runs(F.col("opening")).alias("shingles")), "id", "shingles", bands=40, rows=2, similarity=SIMILARITY)
    clustered = templates.join(classes(templates, links, "id").hint("merge"), "id").checkpoint()
    met = plain.select("opening", F.coalesce("prompt", F.lit("")).alias("prompt")).distinct()
    spread = prompt_similarity(met.join(clustered.select("opening", "class").hint("merge"), "opening"))
    wording = clustered.groupBy("class").agg(F.sum("n").alias("n"), F.sum("declining").alias("declining"))
    enough = F.when(F.col("declining") * 2 >= F.col("n"), 2).otherwise(least_prompts)
    good = wording.join(spread.hint("merge"), "class").where((F.col("prompts") >= enough) & (F.col("related") <= RELATED))
    return clustered.join(good.select("class").hint("merge"), "class", "left_semi").select("opening", "class")


def broken_pairs(pairs: DataFrame) -> DataFrame:
    """``pair_table, pair_id, defect`` of each defective pair of ``pairs(pair_table, pair_id, question, answer)``."""
    seen = pairs.select("pair_table", "pair_id", "question", "answer").mapInPandas(_inspect, SCHEMA).checkpoint()
    refusals = refusal_templates(seen).withColumn("refusal", F.lit(True))
    marked = seen.where(F.col("defect").isNotNull() | F.col("plain")).join(refusals.hint("merge"), "opening", "left")
    defect = F.when(F.col("refusal"), "refusal").otherwise(F.col("defect"))
    return marked.select("pair_table", "pair_id", defect.alias("defect")).where(F.col("defect").isNotNull()).distinct()
