"""Licence notices against the unpruned SQL and on planted variants."""

import textwrap

from pactframe.llm import license_dice as li
from pactframe.llm.queries import ORACLES, QUERIES
from tests.compare import connect, differences
from tests.llm.conftest import EDGES, FOLDER


def test_query_equals_sql(spark):
    assert not differences(QUERIES["op9_license_scan"](spark, FOLDER), connect(FOLDER), ORACLES["op9_license_scan"])


def found(docs, texts):
    out = {}
    for r in li.find_licenses(docs(list(enumerate(texts)), "license")).collect():
        out.setdefault(r.doc_id, {})[r.license] = r
    return out


def test_every_template_is_found_in_any_dress(docs):
    names = list(li.TEMPLATES)
    texts = [f"Some words first.\n{t.upper().replace(' ', '  ')}\nAnd more words." for t in li.TEMPLATES.values()]
    texts += ["*** " + t.replace(" ", "*** ") for t in li.TEMPLATES.values()]
    got = found(docs, texts)
    for n, name in enumerate(names * 2):
        assert name in got[n], (n, name)


def test_near_and_far(docs):
    got = found(docs, [
        "Licensed under the Apache Licence, Version 2.0.",  # one word differs: 5 of 7 bigrams
        "Licensed under the Apache License, Version 2.0 terms",
        "Licensed under the Creative Peach License, version nine.",
        "All rights reserved. All rights reserved.\nAll rights reserved.",
        "All right is reserved", "the license", "Released under the MIT License. Licensed under CC BY-NC 4.0.",
    ])
    assert 0 not in got and set(got[1]) == {"apache-2.0"} and 2 not in got and 4 not in got and 5 not in got
    assert got[3]["all-rights-reserved"].n_passages == 3 and got[3]["all-rights-reserved"].dice == 1.0
    assert set(got[6]) == {"mit", "cc-by-nc-4.0"}


def test_pruning_loses_nothing():
    """A passage at the coefficient holds a telling bigram, whichever bigrams it lacks."""
    for text in li.TEMPLATES.values():
        bigrams = li.template_bigrams(text)
        chosen = li.telling_bigrams(bigrams, 0.8)
        rest = len(bigrams) - len(chosen)
        assert 2 * rest / (rest + len(bigrams)) < 0.8


def test_edges(docs):
    rows = docs([*EDGES, (7, "Released under the MIT License."), (7, "Released under the MIT License.")], "licenses")
    assert sorted(r.doc_id for r in li.find_licenses(rows).collect()) == [7, 7]
    marked = li.with_licenses(rows)
    assert marked.columns == ["doc_id", "text", "licenses"] and marked.count() == len(EDGES) + 2
    assert li.find_licenses(docs([])).count() == 0 and li.find_licenses(rows, texts={}).count() == 0


def test_long_text(docs):
    text = "lorem ipsum dolor sit amet. " * 20_000 + "\nReleased under the MIT License.\n" + "x " * 100_000
    assert set(found(docs, [text])[0]) == {"mit"}


def test_wrapped_and_commented_notices(docs):
    """Every template wrapped between other sentences, plain and in comments whose blank lines hold a mark."""
    names, texts = list(li.TEMPLATES), []
    before, after = "This file was written by several people over many years of work. ", " Other words of the paragraph follow here and end it."
    for mark in ("", " * ", "# ", "// "):
        for t in li.TEMPLATES.values():
            lines = textwrap.wrap(before + t + after, 28)
            texts.append("\n".join(mark + x for x in [*lines, "", *textwrap.wrap(before * 3, 28)]))
    got = found(docs, texts)
    for n, name in enumerate(names * 4):
        assert name in got.get(n, {}), (texts[n], name)
    assert found(docs, ["It is released by the\ncompany under the new\nLicense.", "all\n\nrights\n\nreserved"]) == {}
