"""License scans against plain word comparison and a recursive evaluation."""

import re

import numpy as np
import pytest

from tallyplan.llm import licenses as L

DATA = "/root/testdata/sf0.001"


def plain(text):
    """The contract's columns and the notices, by comparing words at every place."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = lambda phrase: [k for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    base = {p: at(p) for p in L.BASE}
    places = sorted(k for ks in base.values() for k in ks)
    notices = {}
    for p in {**L.NOTICES, **L.BASE}:
        for k in at(p):
            notices.setdefault(k, []).append(p)
    stated = {{**L.NOTICES, **L.BASE}[max(ps, key=len)] for ps in notices.values()}
    return len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted({L.BASE[p] for p, ks in base.items() if ks})), stated | {L.BASE[p] for p, ks in base.items() if ks}


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = L.op12_license_scans(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        *base, stated = plain(texts[r.doc_id])
        assert tuple(r[1:6]) == tuple(base)
        assert r.labels == ",".join(sorted(stated)) and r.n_expressions == 0
        assert r.score == (min(L.FREEDOM[x] for x in stated) if stated else 0.0)
    assert sum(r.n_base > 0 for r in rows) > 0


@pytest.mark.parametrize("seed", range(20))
def test_random_words(seed):
    rng = np.random.default_rng(seed)
    pieces = [*L.BASE, *L.NOTICES, "under", "the", "MIT", "License,", "cc-by-NC", "by", "nc", "...", "apache", "version", "2", "é", "ÉCOLE", "\n", "x_y"]
    text = "".join(rng.choice(pieces) + rng.choice([" ", "-", "  ", "", ", "]) for _ in range(200))
    *base, stated = plain(text)
    got = L.scan(text)
    assert tuple(got[:5]) == tuple(base) and got.labels == ",".join(sorted(stated))


def recursive(tokens):
    """(licences, freedom) by descent: or-terms of and-terms of with-factors."""

    def factor():
        token = tokens.pop(0)
        if token == "(":
            out = either()
            assert tokens.pop(0) == ")"
        else:
            name = L.licence_name(token)
            out = {name}, L.FREEDOM.get(name, 0.0), name in L.FREEDOM
        while tokens and tokens[0].lower() == "with":
            tokens.pop(0)
            tokens.pop(0)
            out = out[0], min(1.0, out[1] + L.EXCEPTION) if out[2] else 0.0, out[2]
        return out

    def both():
        out = factor()
        while tokens and tokens[0].lower() == "and":
            tokens.pop(0)
            more = factor()
            out = out[0] | more[0], min(out[1], more[1]), out[2] and more[2]
        return out

    def either():
        out = both()
        while tokens and tokens[0].lower() == "or":
            tokens.pop(0)
            more = both()
            out = out[0] | more[0], max(out[1], more[1]), out[2] and more[2]
        return out

    return either()


@pytest.mark.parametrize("seed", range(40))
def test_random_expressions(seed):
    rng = np.random.default_rng(seed)
    names = ["MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-or-later", "MPL-2.0", "CC-BY-NC-4.0", "Foo-1", "LGPL-2.1+"]

    def make(depth):
        pick = rng.integers(0, 4 if depth else 1)
        if pick == 0:
            return [rng.choice(names)] + (["WITH", "Classpath-exception-2.0"] if rng.random() < 0.3 else [])
        if pick == 1:
            return ["(", *make(depth - 1), ")"]
        return [*make(depth - 1), rng.choice(["AND", "OR", "and", "or"]), *make(depth - 1)]

    tokens = [str(t) for t in make(4)]
    got = L.evaluate(list(tokens))
    labels, freedom, known = recursive(list(tokens))
    assert got == (tuple(sorted(labels)), freedom, known)
    text = "# SPDX-License-Identifier: " + " ".join(tokens).replace("( ", "(").replace(" )", ")") + "\nnext line"
    assert [e for e, _, _ in L.expressions_of(text)] == [got] and L.scan(text).n_expressions == 1


def test_expressions_in_text():
    labels = lambda t: L.scan(t).labels
    assert labels("// SPDX-License-Identifier: (MIT OR GPL-2.0-only)") == "gpl-2.0,mit"
    assert L.scan("SPDX-License-Identifier: GPL-3.0-only WITH GCC-exception-3.1 AND MIT").score == pytest.approx(0.6)
    either = L.scan("SPDX-License-Identifier: MIT OR CC-BY-NC-4.0. All of it")
    assert (either.labels, either.base_labels, either.score, either.n_notices) == ("cc-by-nc,cc-by-nc-4.0,mit", "cc-by-nc", 1.0, 0)  # a base phrase within an expression stays a label
    assert L.scan("SPDX-License-Identifier: MIT this file is free").labels == "mit"
    assert L.scan("SPDX-License-Identifier:").n_expressions == 0 and L.scan("SPDX-License-Identifier: (MIT").n_expressions == 0
    assert L.scan("SPDX-License-Identifier: ) MIT").n_expressions == 0
    both = L.scan("spdx license identifier MIT\nReleased under the MIT License. All rights reserved.")
    assert (both.labels, both.base_labels, both.score, both.n_base, both.first_word) == ("all-rights-reserved,mit", "mit", 0.0, 1, 5)
    assert L.scan("licensed under CC BY-NC-SA").labels == "cc-by-nc,cc-by-nc-sa"  # the base label stays
    assert L.postfix(["MIT", "OR"]) is None and L.postfix(["OR", "MIT"]) is None and L.evaluate([]) is None


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "\x00\x01 \n", "c"), (None, "Under the MIT License", "d"), (5, "word " * 400_000 + "cc by-nc", "e"), (6, "SPDX-License-Identifier: MIT " * 30_000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string").selectExpr("*", "1 AS score", "2 AS n_words")
    got = {(r.doc_id, r.n_words): r for r in L.scan_licenses(df).collect()}
    assert got[1, 0].labels == "" and got[1, 0].first_word is None and got[2, 0].score == 0.0
    assert got[None, 4].labels == "mit" and got[None, 4].score == 1.0
    assert got[5, 400_003].first_word == 400_000 and got[6, 120_000].n_expressions == 30_000
    assert L.scan_licenses(df.limit(0)).count() == 0
