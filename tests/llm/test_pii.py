import os

import numpy as np
import pyarrow.parquet as pq
import pytest

from webloom.llm import pii, pii_train
from webloom.llm.chartagger import KINDS, Tagger, _spans_of, encode

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def tagger():
    return Tagger()


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data here")
def test_held_out_accuracy(tagger):
    """Against the labelled spans of texts that were not trained on."""
    lines = [line for t in pq.read_table(DATA, columns=["text"])["text"].to_pylist()[:500] if t for line in t.split("\n") if line]
    for kind in KINDS:
        got = {(i, line[b:e]) for i, (line, spans) in enumerate(zip(lines, pii.found_in(tagger, lines))) for b, e, k in spans if k == kind}
        want = {(i, line[b:e]) for i, line in enumerate(lines) for b, e, k in pii_train.labelled(line) if k == kind}
        assert want and len(got & want) >= 0.96 * max(len(want), len(got))


@pytest.mark.parametrize(
    "line,kind,value",
    [
        ("Call 020 7946 0150 and ask for Iris T. Thackwold.", "name", "Iris T. Thackwold"),
        ("Call 020 7946 0150 and ask for Iris T. Thackwold.", "phone", "020 7946 0150"),
        ("Écrivez à Aurèle Zimgarière (aurelezimgariere (at) post (dot) binyartan (dot) example) pour cela.", "email", "aurelezimgariere (at) post (dot) binyartan (dot) example"),
        ("Alden Penhallick lives at 29B Thistledown Ave. and cannot visit the data centre.", "address", "29B Thistledown Ave."),
        ("Im Formular steht noch die Steuer-ID 05669423211.", "identity", "05669423211"),
    ],
)
def test_items(tagger, line, kind, value):
    assert (kind, value) in {(k, line[b:e]) for b, e, k in pii.found_in(tagger, [line])[0]}


def test_long_lines_are_reconciled(tagger):
    line = "The reader checks the list of every node again. " * 60 + "Thanks to Mira Quillane for the long report. " + "The queue drops two copies of each row. " * 40
    assert {(k, line[b:e]) for b, e, k in pii.found_in(tagger, [line])[0]} == {("name", "Mira Quillane")}
    assert pii.found_in(tagger, ["", " ", "x"]) == [[], [], []]


def test_spans_of_tags():
    assert _spans_of(np.array([0, 1, 2, 2, 0, 9, 10, 9, 10])) == [(1, 4, "email"), (5, 7, "name"), (7, 9, "name")]
    assert _spans_of(np.zeros(0, int)) == []


def test_encode_keeps_length():
    assert len(encode("aÄ🙂ж\n")) == 5


def test_odd_documents(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Thanks to Mira Quillane for the long report.\nThanks to Mira Quillane for the long report.", "x"), (4, "🙂" * 3000, "x"), (3, "Thanks to Mira Quillane for the long report.", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert [tuple(r) for r in pii.personal_items(frame).collect()] == [(3, "name", "Mira Quillane")]
    texts = sorted((r.doc_id, r.text, r.replaced) for r in pii.redacted(frame).where("doc_id < 4").collect() if r.text)
    assert texts[0][1] == "Thanks to [NAME] for the long report." and texts[1][2] == 2
    assert pii.personal_items(frame.where("false")).count() == 0


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(0)
    lines = ["mail to ann@site.test now", "call 020 7946 0150 today", "nothing to see here at all"] * 6
    batch = [(encode(x), pii_train.tags_of(x, pii_train.labelled(x))) for x in lines]
    trainer = pii_train.Trainer()
    first = trainer.step(batch, 5e-3)
    for _ in range(25):
        last = trainer.step(batch, 5e-3)
    assert last < 0.4 * first and rng is not None
