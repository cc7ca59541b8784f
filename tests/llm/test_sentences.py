import pytest

from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import sentences as N
from tessera.llm.sentences import chunk_body, sentence_ends, sentence_spans, split_sentences


def units(text, **k):
    return [text[a:b] for a, b in sentence_spans(text, **k)]


CASES = [
    ("The board met. Cash rose by 5.2%.", ["The board met.", "Cash rose by 5.2%."]),
    ("As Dr. Orr noted, cf. No. 5, e.g. in the U.S. it fell. See p. 3.", ["As Dr. Orr noted, cf. No. 5, e.g. in the U.S. it fell.", "See p. 3."]),
    ("It works for Acme Corp. Corp. The next one.", ["It works for Acme Corp. Corp.", "The next one."]),
    ("He asked, \"is it so?\" and left. Then “A b. C d.” Next.", ["He asked, \"is it so?\" and left.", "Then “A b. C d.”", "Next."]),
    ("It grew… But not here. It grew … or so it seemed.", ["It grew…", "But not here.", "It grew … or so it seemed."]),
    ("First one.Then another.", ["First one.", "Then another."]),
    ("As Orr put it.By contrast, it used 5 MWh.Later 9%.In v0.5.8 and at S.A.B. it did in the U.S. … or so it seemed.", ["As Orr put it.", "By contrast, it used 5 MWh.", "Later 9%.", "In v0.5.8 and at S.A.B. it did in the U.S. … or so it seemed."]),
    ("Am 3. Mai 2021 stieg es um ca. 5,0 %. Dr. Ott kam bzw. ging, d. h. bald.", ["Am 3. Mai 2021 stieg es um ca. 5,0 %.", "Dr. Ott kam bzw. ging, d. h. bald."]),
    ("„Es bleibt. Wir warten“, sagte Ott. Ende.", ["„Es bleibt. Wir warten“, sagte Ott.", "Ende."]),
    ("En EE. UU. subió. ¿Por qué? ¡Vaya!", ["En EE. UU. subió.", "¿Por qué?", "¡Vaya!"]),
    ("订单增加。“保持。等待。”李说。为什么？", ["订单增加。", "“保持。等待。”李说。", "为什么？"]),
    ("डॉ. Orr ने कहा। क्यों?", ["डॉ. Orr ने कहा।", "क्यों?"]),
    ("Overview\n\nOperator\nThe API works. It\nreturns.\n\nOpen points:\n- One. Two.\n- Three\n\n| a | b. C |\n| c | d |", ["Overview", "Operator", "The API works.", "It\nreturns.", "Open points:", "- One. Two.", "- Three", "| a | b. C |", "| c | d |"]),
    ("18. Perspectives", ["18. Perspectives"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_units(text, want):
    assert units(text) == want


@pytest.mark.parametrize("text", [None, "", " \n\t ", "​﻿", "­\n⁠"])
def test_no_visible_character_no_unit(text):
    assert sentence_spans(text) == []


def test_units_are_ordered_trimmed_and_disjoint_on_long_text():
    text = "Heading\r\n\r\n" + "Sales rose, e.g. in the U.S. by 3.5%. “A. B,” said Orr. Why? " * 4000
    spans = sentence_spans(text)
    assert len(spans) > 8000
    end = -1
    for a, b in spans:
        assert a >= end and not text[a].isspace() and not text[b - 1].isspace()
        end = b


def test_prose_only_and_ends_in_cells():
    text = "Overview\n\nIt rose. It fell.\n\n| x | One is here. Two is here. | 5 |"
    assert units(text, prose_only=True) == ["It rose.", "It fell."]
    assert len(sentence_ends(text)) >= 5


def test_operator(spark):
    rows = [("t", "1", "Up it. Down.", 5), ("t", "1", "Up it. Down.", 5), ("t", "2", None, 5), ("t", "3", "", 5), ("t", None, "So.", 5)]
    df = spark.createDataFrame(rows, "item_table string, item_id string, text string, start_char int")
    got = sorted((str(r["item_id"]), r["start_char"], r["end_char"]) for r in split_sentences(df).collect())
    assert got == [("1", 0, 6), ("1", 7, 12), ("None", 0, 3)]
    assert split_sentences(df.where("false")).count() == 0


def test_chunk_body(spark):
    df = spark.createDataFrame([("[a > b]\nBody\nx",), ("[no line",), ("plain\ntext",), (None,)], "document string")
    assert [r[0] for r in df.select(chunk_body("document")).collect()] == ["Body\nx", "[no line", "plain\ntext", None]


@given(st.lists(st.tuples(st.integers(1, 900), st.integers(-9, 12), st.sampled_from(["lower", "upper"]), st.integers(0, 2)), min_size=1, max_size=14))
def test_the_sliding_maxima_find_the_best_segmentation(cuts):
    ends, closing, opening, marks = [0], [0.0], ["upper"], [0]
    for step, score, kind, alone in cuts:
        ends.append(ends[-1] + step)
        closing.append(score / 2)
        opening.append(kind)
        marks.append(marks[-1] + alone)

    def value(path):
        return sum(N.span_score(closing[j], opening[i], ends[j] - ends[i], (marks[j] - marks[i]) % 2 == 1) for i, j in zip([0, *path], path))

    best = [0.0] * len(ends)
    for j in range(1, len(ends)):
        best[j] = max(best[i] + N.span_score(closing[j], opening[i], ends[j] - ends[i], (marks[j] - marks[i]) % 2 == 1) for i in range(j))
    path = N._best_spans(ends, closing, opening, marks)
    assert path[-1] == len(ends) - 1 and abs(value(path) - best[-1]) < 1e-9


def test_spans_are_scored_jointly():
    # A doubtful cut is taken between two usual spans, not where it leaves a mark without partner on both sides.
    assert N._best_spans([0, 40, 80], [0.0, 1.5, 0.0], ["upper", "upper", "other"], [0, 0, 0]) == [1, 2]
    assert N._best_spans([0, 40, 80], [0.0, 1.5, 0.0], ["upper", "upper", "other"], [0, 1, 2]) == [2]


def test_work_is_linear_in_one_long_paragraph():
    text = 'In 2024 the board met 14 times. "We expect more, he said. Sales rose by 5 (see p. 4) to 12. '
    assert len(N.sentence_spans(text * 4000)) >= 4000
