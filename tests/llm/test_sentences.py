import pytest

from webspark.llm.sentences import sentence_spans


def units(text):
    return [text[a:b] for a, b in sentence_spans(text, "en")]


@pytest.mark.parametrize("opener", ["Although", "Two of them said that, because", "Everyone", "During May", "Engineers", "However,"])
def test_sentence_after_dotted_capitals(opener):
    first, second = "Few engineers of the two came from the U.S.", f"{opener} the work went on."
    assert units(f"{first} {second}") == [first, second]


@pytest.mark.parametrize("text", ["A bill of the U.S. Senate then passed.", "The state of the U.S. State Department improved."])
def test_name_after_dotted_capitals_leads_on(text):
    assert units(text) == [text]


def test_open_marks_cost_no_more_than_their_length():
    import time

    start = time.perf_counter()
    assert len(units("[" * 30_000 + "One. Two.")) >= 1
    assert len(units('He said "no. ' * 5_000)) > 0
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize("mark", ["။", "᥄", "꩝", "︒", "᪨", "᭞"])
def test_terminators_of_other_scripts(mark):
    first, second = f"abc def{mark}", "Ghi jkl."
    assert units(f"{first} {second}") == [first, second]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("He paid 3.5 to Dr. Smith. Then he left!", ["He paid 3.5 to Dr. Smith.", "Then he left!"]),
        ("# Head\nOne line\ngoes on. Two.\n\n- item one\n- item two.", ["# Head", "One line\ngoes on.", "Two.", "- item one", "- item two."]),
        ("He said “Go. Now!” and left. She stayed.", ["He said “Go. Now!” and left.", "She stayed."]),
        ("", []), (" \n\n ", []), (None, []),
    ],
)
def test_units(text, expected):
    assert [] if text is None and not sentence_spans(text, "en") == [] else (units(text) if text else []) == expected


def test_columns(spark):
    from webspark.llm import sentences

    df = spark.createDataFrame([(1, "One. Two.", "en", 3), (1, "One. Two.", "en", 3), (2, None, None, 3), (3, "", None, 3)], "doc_id bigint, text string, lang string, start_pos int")
    assert sorted(map(tuple, sentences.split_sentences(df).collect())) == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert sorted(map(tuple, sentences.sentence_texts(df).collect())) == [(1, 1, "One."), (1, 1, "One."), (1, 2, "Two."), (1, 2, "Two.")]
    assert sentences.split_sentences(df.where("false")).count() == 0
