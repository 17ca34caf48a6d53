"""Dice coefficients by definition; size bounds lose nothing."""

import random

from cohortspark.llm import license_scan as S
from helpers import awkward, frame


def test_size_bounds_and_near_lines_lose_no_line(spark):
    rng = random.Random(3)
    scanner = S.Scanner(S.TEMPLATES, S.THRESHOLD)
    for _ in range(800):
        name, text = rng.choice(S.TEMPLATES)
        words = text.split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [rng.choice(["new", "the", "License", ""])]
        line = rng.choice(["", "  ", "* "]) + " ".join(words).upper()
        bag = S.bigrams(S.words_of(line))
        best = max((S.dice(bag, S.bigrams(S.words_of(t))) for _, t in S.TEMPLATES), default=0)
        found = list(scanner.scan(f"other words here\n\n{line}\nand more"))
        if best >= S.THRESHOLD:
            assert found and found[0][3] >= best - 1e-12
        else:
            assert all(f[3] >= S.THRESHOLD for f in found)


BRUTE = {t for _, t in S.TEMPLATES[:26]}


def line_runs(lines):
    """The largest coefficient of all runs of lines, by the definition."""
    bags = [S.bigrams(S.words_of(t)) for _, t in S.TEMPLATES]
    runs = [S.bigrams([w for line in lines[i : j + 1] for w in S.words_of(line)]) for i in range(len(lines)) for j in range(i, len(lines))]
    return max(S.dice(run, bag) for run in runs for bag in bags)


def test_every_wrapping_of_the_short_templates_is_found():
    scanner = S.Scanner(S.TEMPLATES, S.THRESHOLD)
    rng = random.Random(5)
    for _, text in S.TEMPLATES:
        words = text.split()
        if len(words) > 14:
            continue
        breaks = [{n} for n in range(1, len(words))] + [set(rng.sample(range(1, len(words)), 2)) for _ in range(3) if len(words) > 2]
        for cut in breaks:
            body = "".join(("\n" if n in cut else " ") + w for n, w in enumerate(words)).strip(" ")
            lines = ["", "some words before", "", *body.split("\n"), "other words after"]
            best = line_runs(lines) if len(cut) == 2 and text in BRUTE else 1
            found = list(scanner.scan("\n".join(lines)))
            assert best == 1 and found and abs(found[0][3] - best) < 1e-12 and found[0][1:3] == (3, len(cut) + 1), body


def word_runs(words, templates):
    """What is found in a sequence of words, by the definition: [(licence, first, last, coefficient)]."""
    bags = [(n, S.bigrams(S.words_of(t))) for n, t in templates]
    runs = []
    for i in range(len(words)):
        for j in range(i, len(words)):
            bag = S.bigrams(words[i : j + 1])
            value, t = max((S.dice(bag, b), -t) for t, (_, b) in enumerate(bags))
            if value >= S.THRESHOLD - 1e-12:
                runs.append((-value, i - j, i, -t))
    out = []
    for value, span, i, t in sorted(runs):
        if all(i - span < a or i > b for _, a, b, _ in out):
            out.append((bags[t][0], i, i - span, -value))
    return out


def test_notices_within_lines_by_brute_force():
    rng = random.Random(6)
    short = rng.sample([t for t in S.TEMPLATES if len(t[1].split()) <= 14], 25)
    for templates in (short, short[:5] + [("X", "Zlib"), ("Y", "as is"), ("Z", "to be or not to be or not to be")]):
        scanner = S.Scanner(templates, S.THRESHOLD)
        for _ in range(60):
            words = []
            for _ in range(rng.randrange(1, 4)):
                notice = rng.choice(templates)[1].split()
                for _ in range(rng.randrange(3)):
                    at = rng.randrange(len(notice))
                    notice[at : at + rng.randrange(2)] = [rng.choice(["new", "the", "License", "under"])]
                words += rng.choices(["our", "tool", "the", "license", "under", "is", "to", "be"], k=rng.randrange(4)) + notice
            # a word a line: the lines are the words
            words = [w for w in words if S.words_of(w)]
            text = "\n".join(words)
            want = word_runs(S.words_of(" ".join(words)), templates)
            if all(len(S.words_of(w)) == 1 for w in words):
                assert [(n, i, i + k - 1, v) for n, i, k, v in scanner.scan(text)] == want
            assert [(n, v) for n, _, _, v in scanner.scan(" ".join(words))] == [(n, v) for n, _, _, v in want]


def test_notices_that_share_their_line_with_other_text():
    scanner = S.Scanner(S.TEMPLATES, S.THRESHOLD)
    assert list(scanner.scan("Our tool is great. Released under the MIT License. Download it here today.")) == [("MIT", 0, 1, 1.0)]
    mit = next(t for n, t in S.TEMPLATES if len(t) > 400)
    page = f"x\n<p>Text. {mit} More.</p> Data: Licensed under CC BY 4.0. End"
    assert [f[:3] for f in scanner.scan(page)] == [("MIT", 1, 1), ("CC-BY-4.0", 1, 1)]


def test_family_headers_bodies_and_spdx_lines_name_their_own_licence():
    scanner = S.Scanner(S.TEMPLATES, S.THRESHOLD)
    names = lambda text: [n for n, *_ in scanner.scan(text)]
    header = "/* Frobnicate is free software: you can redistribute it and/or modify it\n * under the terms of the GNU {} as published by\n * the Free Software Foundation, either version {} of the License, or\n * any later version. */"
    family = [("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")]
    family += [("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3")]
    for want, name, version in family:
        assert names(header.format(name, version)) == [want]
        assert names(f"It is here. Licensed under the GNU {name}, version {version}. Yes.") == [want]
    for want in ("MIT", "BSD-3-Clause", "GPL-2.0", "LGPL-2.1", "CC-BY-NC-SA-3.0"):
        assert names(f"#!/bin/sh\n# SPDX-License-Identifier: {want}\nls") == [want]
    assert names("SPDX-License-Identifier: GPL-2.0-or-later") == ["GPL-2.0"] and names("SPDX-License-Identifier: EUPL-1.2") == []
    bodies = [(n, t) for n, t in S.TEMPLATES if len(t.split()) > 100]
    assert {n for n, _ in bodies} == {"MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause"}
    for want, text in bodies:
        for old, new in (("", ""), ("copyright holder nor", "Some Company Inc. nor"), ("COPYRIGHT HOLDER OR", "AUTHOR OR"), ("1. ", "* ")):
            words = text.replace(old, new).split()
            assert names("\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))) == [want], (want, old)


def test_documents(spark):
    mit = next(t for n, t in S.TEMPLATES if len(t) > 400)
    wrapped = "\n".join(mit[i : i + 70] for i in range(0, len(mit), 70))
    rows = awkward() + [
        (200, "text\nReleased under the MIT Licence.\nmore", "en", "a", 1),
        (201, "Copyright (c) 2020 somebody\n" + mit.replace(". ", ".\n"), "en", "a", 1),
        (202, "licensed under the apache license version 2.0\nLicensed under CC BY-NC 4.0.", "en", "a", 1),
        (203, "I licensed this song to nobody.", "en", "a", 1),
        (203, "Licensed under the Apache License, Version 2.0.", "en", "a", 1),
        (203, "Licensed under the Apache License, Version 2.0.", "en", "a", 1),
        (None, "This work is licensed under the GNU General Public License, version 3.", "en", "a", 1),
        (204, wrapped, "en", "a", 1),
    ]
    got = sorted(((r.doc_id, r.license, r.first_line) for r in S.licenses(frame(spark, rows, extra=True)).collect()), key=str)
    assert [g for g in got if g[0] != 204] == sorted(
        [(200, "MIT", 1), (201, "MIT", 1), (202, "Apache-2.0", 0), (202, "CC-BY-NC-4.0", 1), (203, "Apache-2.0", 0), (203, "Apache-2.0", 0), (None, "GPL-3.0", 0)], key=str
    )
    assert [g[1] for g in got if g[0] == 204] == ["MIT"]


def test_every_notice_of_the_test_documents_is_found(spark):
    from cohortspark.llm.common import read

    sf = "/root/testdata/sf0.01"
    notices = {t: n for n, t in S.TEMPLATES}
    want = {(d.doc_id, notices[line]) for d in read(spark, sf, "documents").collect() for line in d.text.split("\n") if line in notices}
    got = {(r.doc_id, r.license) for r in S.op9_license_scan(spark, sf).collect()}
    assert want and want <= got and {d for d, _ in got} == {d for d, _ in want}


def test_dice_by_definition():
    a, b = S.bigrams(["x", "y"]), S.bigrams(["x", "y", "z"])
    assert S.dice(a, b) == 2 * 2 / (3 + 4) and S.dice(a, a) == 1 and S.dice(S.bigrams([]), a) == 0


def test_empty_tables_and_templates(spark):
    docs = frame(spark, awkward())
    assert S.licenses(docs.limit(0)).count() == 0 and S.licenses(docs, []).count() == 0
