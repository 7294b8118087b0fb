"""Alignment and scans against plain versions."""

import itertools
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from docketry.llm import licenses
from docketry.llm.queries import op2_license_scan

SF = "/root/testdata/sf0.001"


@settings(max_examples=80, deadline=None)
@given(st.permutations(range(8)))
def test_longest_increasing(values):
    places = licenses.increasing(values)
    assert all(a < b and values[a] < values[b] for a, b in zip(places, places[1:]))
    best = max(n for n in range(9) for c in itertools.combinations(values, n) if list(c) == sorted(c))
    assert len(places) == best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=12), st.lists(st.sampled_from("abcdefgh"), max_size=12))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    assert licenses.align(a, a) == [(i, i) for i in range(len(a))]


def test_gaps_are_aligned_again():
    template = "a the b the c".split()
    assert licenses.align("x a the b y the c z".split(), template) == [(1, 0), (2, 1), (3, 2), (5, 3), (6, 4)]


def plain_align(text, template):
    """Patience alignment once more, by recursion and quadratic tables: how many words, first and last."""
    pairs, lead = [], 0
    while lead < min(len(text), len(template)) and text[lead] == template[lead]:
        pairs.append(lead)
        lead += 1
    end_a, end_b = len(text), len(template)
    while end_a > lead and end_b > lead and text[end_a - 1] == template[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
        pairs.append(end_a)
    x, y = text[lead:end_a], template[lead:end_b]
    anchors = [(i, y.index(w)) for i, w in enumerate(x) if x.count(w) == 1 and y.count(w) == 1]
    if anchors:
        length = []
        for k, (_, j) in enumerate(anchors):
            length.append(1 + max([length[m] for m in range(k) if anchors[m][1] < j], default=0))
        level, chosen = max(length), []
        for k in range(len(anchors) - 1, -1, -1):
            if length[k] == level:
                chosen.append(anchors[k])
                level -= 1
        before = (-1, -1)
        for i, j in [*chosen[::-1], (len(x), len(y))]:
            pairs += [lead + before[0] + 1 + p for p in plain_align(x[before[0] + 1 : i], y[before[1] + 1 : j])]
            before = (i, j)
        pairs += [lead + i for i, _ in chosen]
    return sorted(pairs)


def simple_words(text):
    return [w for w in (re.sub(r"[\W_]+", "", w.lower()) for w in re.split("[\x20\x09-\x0d]+", text or "")) if w]


def scan_everywhere(words, template, coverage=0.8, slack=0.5):
    """Every window is aligned, key words or not."""
    wanted = simple_words(template)
    size, longest, found = len(wanted), len(wanted) + int(slack * len(wanted)), set()
    for low in range(len(words)):
        window = words[low : low + longest]
        if sum(w in wanted for w in window) >= coverage * size - 1e-9:
            at = plain_align(window, wanted)
            if len(at) >= coverage * size - 1e-9:
                found.add((-len(at), low + at[0], low + at[-1] + 1))
    out = []
    for n, a, b in sorted(found):
        if all(b <= x or y <= a for x, y, _ in out):
            out.append((a, b, -n))
    return sorted(out)


def test_whole_table(spark):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in op2_license_scan(spark, SF).collect():
        got.setdefault((r.doc_id, r.license), []).append((r.start_word, r.end_word, r.covered_words))
    want = {}
    for i, text in docs.items():
        words = simple_words(text)
        for name, template in licenses.TEMPLATES.items():
            if matches := scan_everywhere(words, template):
                want[i, name] = matches
    assert {k: sorted(v) for k, v in got.items()} == want and want
    for (i, name) in want:
        assert any(line in docs[i] for line in [licenses.TEMPLATES[name]])


def places_of(words, name, template):
    made = licenses.make_template(name, template, 0.8)
    return licenses.match_template(words, [i for i, w in enumerate(words) if w in made.keys], made, 0.8, 0.5)


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_no_window_is_missed(name):
    """Worn copies in prose made of the template's own words."""
    rng, template = random.Random(name), licenses.TEMPLATES[name]
    wanted, hits = simple_words(template), 0
    for _ in range(150 if len(wanted) < 20 else 8):
        prose = [rng.choice([*wanted, "page", "and", "see"]) for _ in range(rng.randint(0, 2 * len(wanted)))]
        worn = [rng.choice(wanted) if rng.random() < 0.2 else w for w in wanted for _ in range(rng.random() < 0.97)]
        at = rng.randint(0, len(prose))
        words = prose[:at] + worn + prose[at:]
        want = scan_everywhere(words, template)
        assert places_of(words, name, template) == want
        hits += bool(want)
    assert hits


def test_changed_and_repeated_licenses(spark):
    rng = random.Random(5)
    mit = " ".join(licenses.TEMPLATES["mit"].split())
    words = mit.split()
    worn = [w for i, w in enumerate(words) if i % 9 != 4]
    cut = words[: len(words) // 2]
    filler = " ".join(rng.choice("lorem ipsum dolor sit amet the of and to".split()) for _ in range(900))
    notice = licenses.TEMPLATES["gpl-3.0-notice"]
    texts = [filler + "\n" + mit + "\n" + filler, " ".join(worn).upper(), " ".join(cut), f"{notice} {filler} {notice}\n{notice}", None, "", "***"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, notice, "x")] * 2, "doc_id long, text string, license string")
    rows = licenses.scan_licenses(docs.repartition(2)).collect()
    names = sorted((str(r.id), r.license) for r in rows)
    assert names == [("0", "mit"), ("1", "mit")] + [("3", "gpl-3.0-notice")] * 3 + [("None", "gpl-3.0-notice")] * 2
    full = next(r for r in rows if r.id == 0)
    assert full.coverage == 1.0 and full.start_word == 900 and full.end_word == 900 + len(licenses.plain_words(mit))
    assert licenses.scan_licenses(docs.where("false")).count() == 0
    assert licenses.scan_licenses(docs, {"none": "..."}).count() == 0
    assert licenses.scan_licenses(docs, {}).count() == 0


@pytest.mark.parametrize("name", list(licenses.TEMPLATES))
def test_key_words_are_enough(name):
    made = licenses.make_template(name, licenses.TEMPLATES[name], 0.8)
    rest = [w for w in made.words if w not in made.keys]
    assert len(rest) < 0.8 * len(made.words)


def test_stray_words_beside_a_worn_notice():
    name = "gpl-3.0-notice"
    for text in (
        "This page and its images work is licensed under the GNU General Public License version two or later see section 3",
        "This page and its images this work is licensed under the GNU General Public License v two or later see section 3",
        "terms the of the this work is licensed under the gnu section public program version 3 version public see section license",
    ):
        words = simple_words(text)
        assert places_of(words, name, licenses.TEMPLATES[name]) == scan_everywhere(words, licenses.TEMPLATES[name]) != []


def test_very_long_text(spark):
    notice = licenses.TEMPLATES["apache-2.0-notice"]
    text = "version 2 license " * 30_000 + notice + " licensed under" * 30_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = licenses.scan_licenses(docs).collect()
    assert [(r.license, r.covered_words) for r in rows if r.coverage == 1.0] == [("apache-2.0-notice", 7)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("a b c d e f g x y".split()), max_size=40))
def test_matches_are_those_of_every_short_stretch(words):
    assert places_of(words, "t", "a b c d e f g") == scan_everywhere(words, "a b c d e f g")
