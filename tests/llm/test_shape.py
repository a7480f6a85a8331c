"""The shape of a whole word."""

from cairn.llm.quality_knn import shape


def test_whole_word():
    head = "ab-1" * 20
    assert shape(head + "x") != shape(head + "9")
    assert shape("ab-1" * 30) == shape("ab-1") * 30
