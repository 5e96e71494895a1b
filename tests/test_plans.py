import pytest

from webloom.operators.filters import edit_budget, minimum_should_match
from webloom.operators.ranking import candidate_window
from webloom.plans.request import parse, requirements, validated, words_of


def test_phrases_terms_and_exclusions():
    r = parse('"O\'Reily\'s book" -"the library" robots -cache')
    assert r.phrases == ["o'reily's book"] and r.terms == ["o'reily's", "book", "robots"]
    assert r.excluded_phrases == ["the library"] and r.excluded == ["cache"]


def test_modifiers_and_switches():
    r = parse("crawler site:nelven2.test filetype:PDF /near /date language:de", limit=900)
    assert (r.site, r.file_type, r.language, r.near, r.newest_first, r.limit) == ("nelven2.test", "pdf", "de", True, True, 500)
    assert r.terms == ["crawler"]


@pytest.mark.parametrize("raw", ["", "   ", '""', "-", None])
def test_nothing_asked(raw):
    assert parse(raw).terms == []


def test_single_letters_go_only_beside_words():
    assert words_of("a crawler") == ["crawler"] and words_of("a b") == ["a", "b"]


def test_requirements_keep_stop_words_only_alone():
    assert requirements(parse("the crawler")) == [(1, "crawler")]
    assert [t for _, t in requirements(parse("the and"))] == ["the", "and"]


def test_bounds():
    assert [minimum_should_match(n) for n in (1, 2, 3, 4, 5, 10)] == [1, 2, 2, 3, 3, 6]
    assert edit_budget("ab") == (0, 0) and edit_budget("abcd") == (1, 1) and edit_budget("abcdef") == (1, 2) and edit_budget("abcdefgh") == (2, 4)
    assert [candidate_window(n) for n in (1, 10, 15, 40, 300)] == [50, 50, 75, 100, 300]
    with pytest.raises(ValueError):
        r = parse("x")
        r.since, r.until = "2025-02-01", "2025-01-01"
        validated(r)
