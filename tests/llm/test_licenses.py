import random
import re

from lodestone.llm import license_texts as lt
from lodestone.llm import licenses as li

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def brute(text):
    words = WORD.findall(lower(text))
    out = []
    for phrase, label in li.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def test_base_places():
    rng = random.Random(1)
    pool = ["GNU General", "Public License", "gnu", "Apache", "license", "cc", "BY", "cc-by-nc", "mit", "MIT License.", "É", "x9", "\n", "{mit}", "mitlicense"]
    for _ in range(2000):
        t = rng.choice(["", " "]).join(rng.choices(pool, k=rng.randint(0, 12)))
        f = li.scan(t.encode())
        assert (f.n_words, f.places) == brute(t), t


def filled(template, optional=True, var="the holder"):
    """A text that the template stands for: its first wordings, with or without the optional regions."""
    t = template if optional else re.sub("<<beginOptional>>.*?<<endOptional>>", "", template, flags=re.DOTALL)
    t = t.replace("<<beginOptional>>", "").replace("<<endOptional>>", "")
    t = re.sub(r"<<alt;([^|>]*)[^>]*>>", r"\1", t)
    return re.sub(r"<<var;max=(\d+)>>", lambda m: var if int(m[1]) > 1 else "1.", t)


def test_every_template_accepts_what_it_stands_for():
    for label, t in lt.templates():
        for optional in (True, False):
            f = li.scan(("Before it. " + filled(t, optional) + " And after it.").encode())
            assert label in f.labels, (label, t)


def test_labels_of_common_licenses():
    labels = lambda t: li.scan(t.encode()).labels
    two, three = (filled(lt.TEXTS[f"bsd-{n}-clause"][0]) for n in (2, 3))
    assert labels(two) == {"bsd-2-clause"} and labels(three) == {"bsd-3-clause"}
    assert labels("SPDX-License-Identifier: MIT") == {"mit"} and labels("// SPDX-License-Identifier: GPL-2.0-or-later") == {"gpl-2.0-or-later"}
    assert labels("licensed under the GNU Lesser General Public License v2.1") == {"lgpl-2.1"}
    assert labels("Licensed under the GNU Affero General Public License, version 3 or later") == {"agpl-3.0-or-later"}
    assert labels("This is free and unencumbered software released into the public domain") == set()
    assert labels(filled(lt.TEXTS["unlicense"][0])) == {"unlicense"}
    assert labels("It is not licensed under a CC BY 4.0 license.") == {"cc-by"}
    assert labels("licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License") == {"cc-by-nc-sa-3.0"}


def brute_accepts(template, words):
    """Whether a run of words is what a template stands for, by expanding the template's parts one after the other."""
    parts = [p for p in re.split("(<<[^>]*>>)", template) if p]
    ends, skips = {0}, []
    for p in parts:
        if not p.startswith("<<"):
            own = WORD.findall(lower(p))
            ends = {e + len(own) for e in ends if words[e : e + len(own)] == own}
        elif p == "<<beginOptional>>":
            skips.append(ends)
        elif p == "<<endOptional>>":
            ends = ends | skips.pop()
        elif p.startswith("<<var"):
            most = int(re.search("[0-9]+", p)[0])
            ends = {e + k for e in ends for k in range(most + 1) if e + k <= len(words)}
        else:
            ways = [WORD.findall(lower(x)) for x in p[6:-2].split("|")]
            ends = {e + len(x) for e in ends for x in ways if words[e : e + len(x)] == x}
    return max(ends, default=None)


def test_automata_against_brute_force():
    rng = random.Random(4)
    own = ["a b <<beginOptional>>c<<endOptional>> d", "<<alt;a|a b|c>> <<var;max=2>> d", "a <<beginOptional>>b <<alt;c|d e>><<endOptional>> <<var;max=1>> a"]
    for t in own:
        automaton = li.compile_template(t)
        for _ in range(3000):
            words = rng.choices("abcde", k=rng.randint(0, 8))
            assert automaton.accepts_at([w.encode() for w in words], 0) == brute_accepts(t, words), (t, words)


def test_templates():
    labels = lambda t: li.scan(t.encode()).labels
    assert labels("Licensed under CC BY-NC 4.0.") == {"cc-by", "cc-by-nc-4.0"}
    assert labels("x Licensed under the Apache License, Version 2.0. y") == {"apache", "apache-2.0"}
    assert labels("licensed under the GNU General Public License, version 3.") == {"gpl", "gpl-3.0"}
    assert labels("licensed under the terms of the GNU General Public License v2") == {"gpl", "gpl-2.0"}
    grant = filled(lt.TEXTS["mit"][1], var="this software and associated documentation files")
    without = filled(lt.TEXTS["mit"][1], optional=False, var="the authors")
    for t in (grant, without):
        assert labels("preamble " + t + " rest") == {"mit"} and li.scan(t.encode()).score == 1
    assert labels(without.replace("modify", "modified")) == set()
    assert labels(without[: without.index("THE SOFTWARE IS")]) == set()  # without the disclaimer it isn't the license
    assert labels(filled(lt.TEXTS["mit"][1], var="w " * 20)) == set()
    assert li.scan(b"an apache license file").score == 0.5


def test_query(spark):
    rows = [(1, "Mit license, MIT LICENSE", 1), (2, None, 1), (3, "", 1), (None, "cc by " * 50000, 1), (1, "Mit license, MIT LICENSE", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels int")
    out = {r["doc_id"]: tuple(r) for r in li.scan_documents(docs).collect()}
    assert out[1] == (1, 4, 2, 0, 2, "mit", "mit", 0.5) and out[2] == (2, 0, 0, None, None, "", "", 0.0)
    assert out[None][2:5] == (50000, 0, 99998)
    assert li.scan_documents(docs).count() == 5 and li.scan_documents(docs.limit(0)).count() == 0
