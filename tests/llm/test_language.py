import os
import random

import pyarrow.parquet as pq
import pytest

from webloom.llm import language
from webloom.llm.words import WORD, language_of_label

DATA = "/root/testdata/sf0.01/crawled_pages.parquet"


@pytest.mark.parametrize("label,code", [("en_GB", "en"), (" Deutsch ", "de"), ("por", "pt"), ("русский", "ru"), ("fr-FR", "fr"), ("xx", None), ("", None), (None, None), ("??", None), ("und", None), ("español", "es")])
def test_labels(label, code):
    assert language_of_label(label) == code


@pytest.mark.parametrize(
    "line,listed",
    [("Home | News | Contact us | Torvix", True), ("Alpha > Docs > How the reader drops the list of the node", True), ("Tags: one, two, three", True), ("STATUS   LOG IN   BLOG   HELP", True), ("Why the reader keeps the list", False), ("Like it? Pass it on: Mail, Feed, Link!", False), ("Read also: How the reader drops the list, and more", False)],
)
def test_lists(line, listed):
    assert language.is_list(line) is listed


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")
def test_held_out_accuracy():
    """Lines that function words place beyond doubt, from pages the dictionaries have not seen."""
    texts = [t for t in pq.read_table(DATA, columns=["text"])["text"].to_pylist() if t]
    random.Random(1).shuffle(texts)
    classify = language.Classifier(language.dictionaries(texts[:500]))
    right = wrong = unsure = 0
    for text in texts[500:]:
        for line in text.split("\n"):
            words = [w.lower() for w in WORD.findall(line)]
            truth = language.vote(words) if len(words) >= 8 else None
            if truth:
                found = classify(language.prepared(line))[0]
                unsure += found is None
                right += found == truth
                wrong += found not in (truth, None)
    assert right > 500 and wrong <= 0.01 * right and unsure <= 0.05 * right


def test_nothing_to_learn_from():
    classify = language.Classifier(language.dictionaries([]))
    assert classify(language.prepared("the reader and the list of the node in the queue"))[0] in (*language.LANGUAGES, None)
    assert classify("  ")[0] is None
