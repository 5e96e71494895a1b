import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import cases
from webloom.llm import body, frames, language, pages, residue, trees
from webloom.llm.frames import Wrapper, _increasing, learn, meets, places_of
from webloom.llm.lines import HEADING, PROSE, SHORT, TITLE, VALUE, Lines, shape
from webloom.llm.queries import _left_out

CRAWL = cases.crawl()


def as_pages(spark, extra=()):
    rows = [(c["id"], c["url"], c["title"], c["text"], ["https://x.test/"], "en") for c in CRAWL]
    return cases.pages_frame(spark, [*rows, *extra])


def as_results(spark, extra=()):
    return cases.results_frame(spark, [(c["id"], c["url"], c["text"]) for c in CRAWL] + list(extra))


def test_shapes():
    assert [shape(x) for x in ("# a heading here", "a.b = 0", "home", "why the list drops the queue", "the reader checks the list of every node before the next pass begins again.")] == [HEADING, VALUE, SHORT, TITLE, PROSE]


def test_increasing():
    assert [[5, 1, 2, 9, 3][i] for i in sorted(_increasing([5, 1, 2, 9, 3]))] == [1, 2, 3] and _increasing([]) == []


def test_lines_keep_places():
    lines = Lines(pa.array(["a\n\nb", None, ""]))
    assert [len(lines.of(i)) for i in range(3)] == [3, 1, 1]


def test_frames_are_found(spark):
    found = body.frame_lines(as_results(spark), as_pages(spark)).collect()
    for tab in ("crawl_results", "crawled_pages"):
        got = {(r.record_id, r.line_no) for r in found if r.tab == tab}
        want = {(c["id"], i) for c in CRAWL for i in c["framed"]}
        assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)
    assert len(found) == len({tuple(r) for r in found})


def test_bodies_keep_their_lines(spark):
    got = {r.record_id: r.body for r in body.main_bodies(as_results(spark, [(900, None, None), (901, "https://alpha.test/x", "")]), as_pages(spark)).where("tab = 'crawl_results'").collect()}
    assert got[900] is None and got[901] == ""
    for c in CRAWL[:20]:
        assert all(p in got[c["id"]] for p in c["body"]) and " = " in got[c["id"]] and "Skip to content" not in got[c["id"]]


def test_wrappers_beyond_the_broadcast_bound_are_joined(spark, monkeypatch):
    results, crawl = as_results(spark), as_pages(spark)
    want = {tuple(r) for r in body.frame_lines(results, crawl).collect()}
    monkeypatch.setattr(frames, "MAX_BROADCAST_PARTS", 3)
    assert {tuple(r) for r in body.frame_lines(results, crawl).collect()} == want and want


def test_tokens_meet_parts_in_order_only():
    places = places_of([1, 2, 3, 2, 4])
    assert meets([1, 2, 3, 2, 4], places) == [0, 1, 2, 3, 4]
    assert meets([2, 4, 1], places) in ([1, 4, -1], [3, 4, -1])
    assert sorted(meets([9, 3, 3, 4], places)) == [-1, -1, 2, 4] and meets([], places) == []


def test_wrapper_has_optional_and_repeated_parts():
    wrapper = Wrapper()
    for tokens, runs in (([1, 2, 3, 5], [0, 0, 3, 0]), ([1, 3, 5], [0, 2, 0]), ([1, 2, 5], [0, 0, 0]), ([5, 1], [0, 0])):
        wrapper.align(tokens, [(1, int(r > 0), r) for r in runs])
    assert [p for p in wrapper.parts if p in (2, 3)] == [2, 3] and wrapper.parts.count(5) + wrapper.parts.count(1) == 3
    assert wrapper.seen[wrapper.parts.index(3)] == [2, 2, 5] and wrapper.seen[wrapper.parts.index(2)][0] == 2


def frame_of(found, tab="crawl_results"):
    out = {}
    for r in found.where(f"tab = '{tab}'").collect():
        out.setdefault(r.record_id, set()).add(r.line_no)
    return out


def test_a_menu_word_in_the_body_stays(spark):
    """What only the alignment tells: the line is an anchor of the site, but not at this place."""
    rng = random.Random(3)
    menu, foot = ["Start", "Downloads", "Forum", "Contact"], ["Imprint and privacy", "© 2025 Delta"]
    rows, second = [], {}
    for i in range(40):
        body = [cases.paragraph(rng) for _ in range(3)]
        lines = menu + body[:2] + (["Downloads"] if i == 7 else []) + body[2:] + foot
        second[i] = 6 if i == 7 else None
        rows.append((i, f"https://delta.test/{i}", "\n".join(lines)))
    got = frame_of(body_lines(spark, rows))
    assert 6 not in got[7] and {0, 1, 2, 3, 7 + 1, 7 + 2} == got[7]
    assert all(got[i] == {0, 1, 2, 3, 7, 8} for i in range(40) if i != 7)


def body_lines(spark, rows):
    return body.frame_lines(cases.results_frame(spark, rows), cases.pages_frame(spark, []))


def test_a_frequent_line_of_one_site_stays_in_the_bodies_of_others(spark):
    rng = random.Random(5)
    said = "The weekly meeting of the maintainers takes place on every second Tuesday in the evening."
    rows = []
    for i in range(60):
        host, foot = ("east.test", ["Imprint of East", "© 2025 East", said]) if i % 2 else ("west.test", ["Imprint of West", "© 2025 West"])
        lines = ["Menu " + host, *[cases.paragraph(rng) for _ in range(2)], *([said] if i == 10 else []), cases.paragraph(rng), *foot]
        rows.append((i, f"https://{host}/{i}", "\n".join(lines)))
    got = frame_of(body_lines(spark, rows))
    assert got[10] == {0, 5, 6} and got[11] == {0, 4, 5, 6}


def test_a_page_with_the_frame_of_another_site_is_read_by_its_wrapper(spark):
    rng = random.Random(6)
    rows = []
    for i in range(60):
        host, foot = ("east.test", ["Imprint of East", "© 2025 East"]) if i % 2 else ("west.test", ["Imprint of West", "© 2025 West"])
        url = "west.test" if i == 11 else host
        rows.append((i, f"https://{url}/{i}", "\n".join(["Menu " + host, *[cases.paragraph(rng) for _ in range(3)], *foot])))
    assert frame_of(body_lines(spark, rows))[11] == {0, 4, 5}


def test_wrappers_do_not_depend_on_the_layout(spark, monkeypatch):
    results, crawl = as_results(spark), as_pages(spark)
    want = {tuple(r) for r in body.frame_lines(results.coalesce(1), crawl).collect()}
    assert {tuple(r) for r in body.frame_lines(results.repartition(11), crawl.repartition(5)).collect()} == want
    # split sites: partial wrappers are aligned with each other
    monkeypatch.setattr(frames, "PAGES_PER_TASK", 10)
    monkeypatch.setattr(frames, "WRAPPERS_PER_TASK", 2)
    got = {tuple(r) for r in body.frame_lines(results, crawl).collect()}
    assert len(got ^ want) <= 0.02 * len(want)


def odd_pages():
    return [(1000 + i, None if i % 3 == 0 else "https://alpha.test/odd", None if i % 2 else "t", t, None if i % 2 else [], None) for i, t in enumerate(cases.ODD_TEXTS)]


def test_odd_pages_do_not_crash(spark):
    df = as_pages(spark, odd_pages())
    read = pages.crawled(df)
    facts = language.page_facts_with_languages(read, learn(read).wrappers)
    assert facts.count() == len(CRAWL) + len(cases.ODD_TEXTS)
    ids = {r.page_id for r in language.languages(facts).collect()}
    assert not ids & {1000, 1001, 1002, 1003}
    assert not {r.page_id for r in _left_out(facts).collect()} & {c["id"] for c in CRAWL}


def test_empty_tables(spark):
    results, crawl = cases.results_frame(spark, []), cases.pages_frame(spark, [])
    assert body.frame_lines(results, crawl).count() == 0 and body.main_bodies(results, crawl).count() == 0
    read, anchors, facts = pages.judged(crawl)
    assert pages.spam_pages(facts).count() == 0 and pages.residue_pages(facts).count() == 0
    assert language.languages(language.page_facts_with_languages(read, anchors)).count() == 0


SPAM = [
    "cheap shoes online, best shoes sale, shoes discount, buy shoes online, shoes wholesale, running shoes near me\n" * 4,
    "#shoes #discount #sale #vpnplan #shoes #bestshoes #sale #routercable #shoes #discount\n" * 5,
    "\n".join(f"[cheap shoes {i}](https://x.test/{i})" for i in range(40)),
    "If the reader web traffic checks the web traffic list of the web traffic node, the web traffic queue web traffic drops the web traffic record. " * 6,
]


def test_spam_and_its_neighbours(spark):
    glossary = "\n".join(f"term{i} — {cases.sentence(__import__('random').Random(i))}" for i in range(12))
    extra = [(2000 + i, "https://alpha.test/s", "shoes", t, [], "en") for i, t in enumerate(SPAM * 4)]
    extra += [(3000, "https://beta.test/g", "Glossary", glossary, [f"https://x.test/{i}" for i in range(60)], "en")]
    _, _, facts = pages.judged(as_pages(spark, extra))
    got = {r.page_id for r in pages.spam_pages(facts).collect()}
    assert got == {2000 + i for i in range(len(SPAM) * 4)}


RESIDUE = [
    ("t", "{{ page.title }}\n%%BODY%%"),
    ("${doc.name}", "The reader checks the list of every node before the next pass begins, and it keeps all records."),
    ("t", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore."),
    ("Bad gateway", "502 – no answer from upstream 17\nserver/1.0 – 2024-01-02"),
    ("t", "Please enable JavaScript to view this page."),
    ("t", "Hier steht später Ihr Text. Dieser Absatz ist nur ein Blindtext."),
    ("t", "Страница не найдена\nЗапрошенной страницы нет или она перемещена. Проверьте адрес."),
]
ARTICLES = [
    "The layout file writes `{{ page.title }}` into the head. " + cases.paragraph(__import__("random").Random(1)),
    "When a fetch ends with 404 the crawler removes the document and logs it. Pages that need JavaScript are rendered later. " + cases.paragraph(__import__("random").Random(2)),
    'Set the variable "${HOME}" before you start. ' + cases.paragraph(__import__("random").Random(3)),
]


def test_residue(spark):
    extra = [(4000 + i, "https://alpha.test/r", t, x, [], "en") for i, (t, x) in enumerate(RESIDUE)] + [(5000 + i, "https://beta.test/a", "A", x, [], "en") for i, x in enumerate(ARTICLES)]
    _, _, facts = pages.judged(as_pages(spark, extra))
    assert {r.page_id for r in pages.residue_pages(facts).collect()} == {4000 + i for i in range(len(RESIDUE))}


@pytest.mark.parametrize("text,n", [("{date}", 1), ("`{date}`", 0), ("[[user_name]] and __DOC_TITLE__", 2), ("$5 [1] 50% a_b", 0), ("[insert name here]", 1), ("{{", 0), ("undefined undefined", 1), ("it is undefined", 0)])
def test_placeholders(text, n):
    assert residue.placeholders(text) == n


def test_trees_separate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0.5)).astype(float)
    forest = trees.fit(x[:300], y[:300])
    assert ((forest.predict(x[300:]) > 0.5) == (y[300:] > 0)).mean() > 0.9
    assert trees.fit(x[:0], y[:0]).predict(x[:3]).tolist() == [0, 0, 0]
    assert trees.fit(x[:5], np.ones(5)).predict(x[:2]).tolist() == [1, 1]


#: Not looked at while the families of residue.py were written.
HELD_OUT_NOTICES = """
The requested URL was not found on this server.
JavaScript must be enabled to view this site.
This site can't be reached.
The request timed out.
Too many requests.
HTTP Error 404
Under construction
Your content goes here.
You need to log in to view this content because your session has expired.
The connection was reset by the server.
Sorry, this page isn't available.
The file you requested has been removed.
Please update your browser to continue.
This account has been suspended.
We couldn't load this document.
The database is unavailable, sorry.
The link you followed is broken.
Add a description here
Die angeforderte Seite wurde nicht gefunden.
Diese Webseite ist vorübergehend nicht verfügbar.
Bitte aktivieren Sie Cookies in Ihrem Browser.
Ihre Sitzung ist abgelaufen.
La page demandée est introuvable.
Votre session a expiré.
Le serveur n'est pas disponible.
Veuillez activer les cookies de votre navigateur.
La página solicitada no existe.
Su sesión ha caducado.
El servidor no responde.
Por favor, actualice su navegador.
A página não foi encontrada.
A sua sessão expirou.
O servidor não está disponível.
Запрошенная страница не существует.
Сервер временно недоступен.
Пожалуйста, обновите ваш браузер.
Срок действия сессии истёк.
403 Forbidden
500 internal server error
Unable to connect to the database
""".strip().split("\n")
HELD_OUT_PLACEHOLDERS = """
Hello *|FNAME|*, welcome
Dear %FIRSTNAME%, welcome
[% title %]
<?= $title ?>
Message {0} of {1}
Dear <<company>>
{{ user.name }}
${order.id}
Hi [FIRST_NAME]
#{user_name}
{$title}
<% name %>
##NAME##
@@site@@
%%unsubscribe%%
[insert address]
""".strip().split("\n")


def test_held_out_notices_and_placeholders():
    assert sum(residue.is_notice(" ".join(n.lower().split())) for n in HELD_OUT_NOTICES) >= 0.8 * len(HELD_OUT_NOTICES)
    assert sum(residue.placeholders(p) > 0 for p in HELD_OUT_PLACEHOLDERS) >= 0.8 * len(HELD_OUT_PLACEHOLDERS)
    plain = [cases.sentence(random.Random(i)) for i in range(300)]
    assert sum(residue.is_notice(p.lower()) for p in plain) <= 3 and not any(residue.placeholders(p) for p in plain)
    assert not residue.placeholders("a{2,3} and {x: 1} with `{{name}}` or \"{0}\" in code, 5% of 7% cases, x << y")


def test_stems_hold_for_every_notice():
    import pyarrow.compute as pc

    low = [" ".join(n.lower().split()) for n in HELD_OUT_NOTICES]
    found = pc.match_substring_regex(pa.array(low), residue.STEMS).to_pylist()
    assert all(f for f, n in zip(found, low) if residue.is_notice(n))


def test_notices_are_learned_from_bodyless_pages_of_several_hosts(spark):
    said = "Quorvex gate zelta: the frandle is asleep."
    rows = [(i, f"https://h{i % 4}.test/{i}", "x", f"404 – page not found\n{said}" if i < 12 else said, [], "en") for i in range(16)]
    rows += [(100 + i, f"https://h{i % 4}.test/b{i}", "y", "\n".join(cases.paragraph(random.Random(i * 7 + k)) for k in range(4)), [], "en") for i in range(40)]
    frame = cases.pages_frame(spark, rows)
    got = {r.page_id for r in pages.residue_pages(pages.judged(frame)[2]).collect()}
    # twelve of the sixteen pages show a seed beside the sentence, which is below the share that is asked
    assert not got
    more = [(200 + i, f"https://h{i % 4}.test/c{i}", "x", f"404 – page not found\n{said}", [], "en") for i in range(12)]
    got = {r.page_id for r in pages.residue_pages(pages.judged(cases.pages_frame(spark, rows + more))[2]).collect()}
    assert got == set(range(16)) | set(range(200, 212))
