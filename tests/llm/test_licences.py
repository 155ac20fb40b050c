import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import edge_rows, frame, no_rows, prose

from kurzwerk.llm import licences as L


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def places(text, phrases):
    """Every place of every phrase, by comparing words one after another."""
    found = words(text)
    return [
        (k, len(p.split()), label)
        for p, label in phrases.items()
        for k in range(len(found))
        if found[k : k + len(p.split())] == p.split()
    ]


def brute(text):
    """Counts and labels of a text without tags."""
    base, notices = places(text, L.BASE), places(text, L.NOTICES)
    outer = {(k, k + n) for k, n, _ in base + notices}
    notices = [
        x for x in notices
        if not any(a <= x[0] and x[0] + x[1] <= b and (a, b) != (x[0], x[0] + x[1]) for a, b in outer)
    ]
    sure = {}
    for kind, found in (("base", base), ("notice", notices)):
        for _, _, label in found:
            sure[label] = max(sure.get(label, 0), L.SURE[kind])
    left = 1.0
    for label in sorted(sure):
        left *= 1 - sure[label]
    at = [k for k, _, _ in base]
    return (
        len(words(text)), len(base), min(at, default=None), max(at, default=None),
        ",".join(sorted({x[2] for x in base})), ",".join(sorted(sure)), round(1 - left, 6),
    )


def texts():
    r = random.Random(3)
    parts = [*L.BASE, *L.NOTICES, "under", "the", "CC-BY", "nc", "Lizenz é", "mit", "version", "2", "GNU"]
    out = [None, "", "\n", "Under the MIT\n\n*License*, CC BY-NC 4.0 cc_by_nc", "undér the mit license"]
    out += ["xunder the mit license", "under the mit licenses", "under the mit", "license", "é" * 300]
    for _ in range(300):
        out.append(r.choice([" ", "\n", ". ", "é "]).join(r.choice(parts) for _ in range(r.randint(1, 9))))
    return out + [prose(2, 400) + " under the MIT License " + prose(3, 9), "cc by nc " * 300]


def test_phrases_equal_brute_force(spark):
    rows = texts()
    for r in L.summary(frame(spark, rows)).collect():
        assert tuple(r)[1:8] == brute(rows[r.doc_id]), rows[r.doc_id]


def test_slices_do_not_matter(monkeypatch):
    import pyarrow as pa

    from kurzwerk.llm.common import slices

    scanner = L.scanner_of(L.BASE, L.NOTICES, L.TAGS)
    found = []
    for size in (1 << 20, 50):
        parts = [scanner.spans(d, o) for _, _, d, o in slices(pa.array(texts()), size)]
        found.append(([n for p in parts for n in p[0]], [s for p in parts for s in p[1]]))
    assert found[0] == found[1]


@pytest.mark.parametrize(
    "line, labels, demands, expression",
    [
        ("SPDX-License-Identifier: MIT", "mit", 0, "mit"),
        ("// spdx-license-identifier: (MIT or GPL-2.0-only) and MPL-2.0 */", "gpl-2,mit,mpl-2", 1, "(mit or gpl-2.0-only) and mpl-2.0"),
        ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl-2", 1, "gpl-2.0-or-later with classpath-exception-2.0"),
        ("SPDX-License-Identifier: MIT AND GPL-3.0+ OR Apache-2.0", "apache-2,gpl-3,mit", 0, "mit and gpl-3.0+ or apache-2.0"),
        ("SPDX-License-Identifier: Apache-2.0 OR MIT AND Own-1", "apache-2,mit,own-1", 0, "apache-2.0 or mit and own-1"),
        ("SPDX-License-Identifier: (Apache-2.0 OR MIT) AND Own-1", "apache-2,mit,own-1", 3, "(apache-2.0 or mit) and own-1"),
        ('license-expression = "((BSD-3-Clause"', "bsd-3-clause", 0, "((bsd-3-clause))"),
        ("SPDX-License-Identifier: MIT OR\nGPL-3.0", "mit", 0, "mit"),
        ("SPDX-License-Identifier: MIT AND ( OR ISC", "mit", 0, "mit"),
        ("SPDX-License-Identifier: LicenseRef-Own MIT", "licenseref-own", 3, "licenseref-own"),
        ("SPDX-License-Identifier: DocumentRef-a:LicenseRef-b", "documentref-a:licenseref-b", 3, "documentref-a:licenseref-b"),
        ("SPDX-License-Identifier: OR MIT", "", None, None),
        ("SPDX-License-Identifier MIT", "", None, None),
        ("SPDX-License-Identifier:", "", None, None),
    ],
)
def test_tags(spark, line, labels, demands, expression):
    (r,) = L.summary(frame(spark, [f"x = 1\n{line}\nend"])).collect()
    assert (r.labels, r.demands, r.n_base) == (labels, demands, 0)
    assert r.expressions == ([expression] if expression else [])
    assert r.score == (0.0 if not labels else round(1 - (1 - L.SURE["tag"]) ** len(labels.split(",")), 6))


NAMES = {"MIT": 0, "MPL-2.0": 1, "GPL-3.0": 2, "Own": 3, "CC-BY-NC-4.0": 4}
TREES = st.recursive(
    st.sampled_from(sorted(NAMES)),
    lambda inner: st.tuples(st.sampled_from(["and", "or"]), inner, inner) | st.tuples(st.just("with"), st.sampled_from(sorted(NAMES))),
    max_leaves=12,
)


def told(tree):
    """(expression with all parentheses, without needless ones by rank, demands)."""
    if isinstance(tree, str):
        return tree, tree, 9, NAMES[tree]
    if tree[0] == "with":
        value = NAMES[tree[1]]
        return (f"({tree[1]} with X)", f"{tree[1]} WITH X", 3, 1 if value == 2 else value)
    op, (lf, ls, lr, lv), (rf, rs, rr, rv) = tree[0], told(tree[1]), told(tree[2])
    rank = {"or": 1, "and": 2}[op]
    short = f"{ls if lr >= rank else f'({ls})'} {op.upper()} {rs if rr > rank else f'({rs})'}"
    return f"({lf} {op} {rf})", short, rank, (max if op == "and" else min)(lv, rv)


@settings(max_examples=300, deadline=None)
@given(TREES)
def test_expressions_of_trees(tree):
    full, short, _, value = told(tree)
    assert L.evaluate(full.encode()).demands == value == L.evaluate(short.encode()).demands
    assert L.evaluate(full.encode()).labels == L.evaluate(short.encode()).labels


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["(", ")", "and", "OR", "With", "MIT", "GPL-2.0", "*", "\n"]), max_size=14))
def test_any_tokens_end(tokens):
    value = L.evaluate(" ".join(tokens).encode())
    if value:
        assert value.text.count("(") == value.text.count(")")
        assert L.evaluate(value.text.encode()) == value


def test_long_expressions_and_many_tags(spark):
    long = "SPDX-License-Identifier: " + " OR ".join(["GPL-3.0"] * 50_000 + ["MIT"])
    many = "SPDX-License-Identifier: MIT " * 20_000
    a, b = sorted(L.summary(frame(spark, [long, many])).collect())
    assert (a.labels, a.demands, b.labels, b.score) == ("gpl-3,mit", 0, "mit", 0.95)


def test_edge_tables_and_own_phrases(spark):
    assert L.summary(no_rows(spark)).collect() == []
    got = L.summary(edge_rows(spark)).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.0} and {r.labels for r in got} == {""}
    (r,) = L.summary(frame(spark, ["Eigene Lizenz hier"]), base={"eigene lizenz": "own"}, notices={}).collect()
    assert (r.n_base, r.first_word, r.base_labels, r.labels, r.demands) == (1, 0, "own", "own", 3)
