import datetime
import itertools
import pathlib
import random
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from interlace.llm import chat, licences, quality, url_lists

from .cases import LONG, PROSE, documents, empty


# --- licences ---------------------------------------------------------------------------------------------------------
def test_licence_spellings_match_and_other_texts_do_not(spark):
    mit = licences.KNOWN[0][1]
    texts = {
        "MIT": ["MIT text\n".replace("MIT text\n", "") + mit, "Copyright (c) 2019 A. Person\n\n" + mit.upper(), "© 2020 Firm\nAll rights reserved.\n" + mit.replace("sublicense", "sub-licence".replace("licence", "license")).replace(", ", " ,  ")],
        "GPL-3.0-only": ["this work is LICENCED under the gnu general public licence -- version 3"],
        None: [mit + " and more", "", None, PROSE],
    }
    rows = [(i, name, t) for i, (name, t) in enumerate((n, t) for n, ts in texts.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, want string, text string")
    got = {r.doc_id: r.license_id for r in licences.scan(docs).collect()}
    assert got == {i: name for i, name, _ in rows}
    assert licences.scan(documents(spark)).count() == 13 and licences.scan(empty(spark)).count() == 0


def planted_licences():
    """(license_id, text): known licences in the spellings that count as equal, and texts that are none."""
    texts = dict(reversed(licences.KNOWN))
    mit = licences.KNOWN[0][1]
    rows = [(name, text) for name, text in licences.KNOWN]
    rows += [("MIT", x + mit) for x in (
        "Copyright (c) 2020 X. ", "Copyright (c) 1999-2020 The X Authors, Inc. All rights reserved. ", "MIT License\n\nCopyright (c) 2020 A. Person\n\n", "The MIT License (MIT)\nCopyright Jane Doe\nCopyright John Doe\n\n",
        "/*\n * Copyright © 2020 X\n * Copyright Y\n */\n", "(c) 2020 X\n© 2021 Z\n",
    )]
    rows.append(("MIT", mit.replace("sublicense", "sub-licence").replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("copyright holders", "Copyright\towners")))
    rows.append(("BSD-3-Clause", "BSD 3-Clause License\n" + texts["BSD-3-Clause"].replace("above copyright notice", "above\ncopyright notice")))
    bsd = texts["BSD-3-Clause"]
    plain = next(b for n, b in licences.KNOWN if n == "BSD-3-Clause")
    regents = plain.replace("the copyright holder nor", "the University nor").replace("BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "BY THE REGENTS AND CONTRIBUTORS").replace("SHALL THE COPYRIGHT HOLDER OR", "SHALL THE REGENTS OR")
    for one in (plain.replace("1. ", " * ").replace("2. ", " * ").replace("3. ", " * "), plain.replace("1. ", "- ").replace("2. ", "- ").replace("3. ", "- "), plain.replace("1. ", "(a) ").replace("2. ", "(b) ").replace("3. ", "(c) ")):
        rows += [("BSD-3-Clause", one), ("BSD-3-Clause", one.replace("the copyright holder nor", "Acme Inc. nor"))]
    rows += [("BSD-3-Clause", regents), ("BSD-3-Clause", bsd), (None, plain.replace("nor the names of its contributors", "nor any others")), (None, plain.replace("1. ", "2. "))]
    rows.append((None, "MIT License"))
    rows.append((None, mit + mit))
    rows.append((None, "Copyright (c) 2020 X"))
    for name, file in {"GPL-3.0-only": "GPL-3", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"}.items():
        path = pathlib.Path("/usr/share/common-licenses") / file
        if path.exists():
            rows += [(name, path.read_text()), (name, path.read_text().replace("\n", " \r\n").upper().replace(" LICENSES ", " LICENCES "))]
    return rows


def test_planted_licences_are_found_and_sql_agrees(spark):
    rows = [(i, name, text) for i, (name, text) in enumerate(planted_licences())]
    docs = spark.createDataFrame(rows, "doc_id long, want string, text string")
    got = {r.doc_id: tuple(r) for r in licences.scan(docs).collect()}
    assert {i: r[3] for i, r in got.items()} == {i: name for i, name, _ in rows}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, _, t in rows])
    assert {r[0]: r for r in con.execute(licences.SQL).fetchall()} == got


def test_neighbouring_words_are_spelled_alike(spark):
    pair = spark.createDataFrame([(0, "the licence licence terms favour sub license sub license"), (1, "The license license terms favor sublicense sublicense")], "doc_id long, text string")
    assert len({r.digest for r in licences.scan(pair).collect()}) == 1


def test_known_licences_may_be_a_table(spark):
    known = licences.digests_of(spark.createDataFrame([("Own-1.0", "Do as you like."), ("Nothing", "")], "license_id string, body string"))
    docs = spark.createDataFrame([(0, "Copyright (c) 2021 Me\nDO AS YOU LIKE"), (1, ""), (2, None), (3, licences.KNOWN[0][1])], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in licences.scan(docs, known=known).collect()} == {0: "Own-1.0", 1: None, 2: None, 3: None}


# --- url lists --------------------------------------------------------------------------------------------------------
def test_asof_join_matches_brute_force(spark):
    rng = random.Random(7)
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)
    hosts = ["a.com", "x.a.com", "b.x.a.com", "b.org"]
    feed = [(rng.choice(hosts), day(rng.randint(0, 300)), rng.choice(["add", "add", "remove"])) for _ in range(80)] + [(None, day(1), "add"), ("a.com", None, "add"), ("a.com", day(3), "rename")]
    urls = [f"https://u:p@{h.upper()}:80/p?q" for h in hosts] + ["http://c.b.org.", "no url", None, "https://a.com.evil.net/"]
    captures = [(i, rng.choice(urls), day(rng.randint(0, 320)) if i % 17 else None) for i in range(200)]
    captures.append(captures[5])
    got = url_lists.evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz"), spark.createDataFrame(feed, "host string, listed_at timestamp_ntz, action string")).collect()

    def listed(domain, at):
        states = {}
        for h, t, action in feed:
            if h == domain and t is not None and t <= at and action in ("add", "remove"):
                states[t] = states.get(t, True) and action == "add"
        return bool(states) and states[max(states)]

    assert len(got) == len({c for c in captures})
    for r in got:
        parts = r.host.split(".")
        domains = {".".join(parts[i:]) for i in range(len(parts) - 1)} | {r.host}
        want = [d for d in domains if r.fetched_at and listed(d, r.fetched_at)]
        assert (r.n_hits, r.blocked, r.listed_host) == (len(want), bool(want), max(want, key=len) if want else None)


def test_hosts_of_many_labels_are_looked_up_under_all_parents(spark):
    host = ".".join(f"l{i}" for i in range(12))
    day = datetime.datetime(2024, 1, 1)
    feed = [(".".join(host.split(".")[2:]), day, "add"), ("l11", day, "add"), ("localhost", day, "add")]
    captures = [(1, f"http://{host}/x", day), (2, "http://localhost/", day), (3, f"http://{host}/x", day - datetime.timedelta(1))]
    rows = url_lists.evaluate(spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp_ntz"), spark.createDataFrame(feed, "host string, listed_at timestamp_ntz, action string"))
    assert {r.page_id: (r.blocked, r.n_hits, r.listed_host) for r in rows.collect()} == {1: (True, 1, feed[0][0]), 2: (True, 1, "localhost"), 3: (False, 0, None)}


def test_hot_domains_are_dealt_to_pieces(spark, monkeypatch):
    """One domain with most captures and many spans, split and not split: the same rows."""
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=n)
    feed = spark.createDataFrame([("a.com", day(10 * i), "remove" if i % 2 else "add") for i in range(30)] + [("b.com", day(5), "add")], "host string, listed_at timestamp_ntz, action string")
    captures = spark.createDataFrame([(i, f"http://{'x' * (i % 7)}.a.com" if i % 5 else "http://b.com", day(i % 310)) for i in range(900)], "page_id long, url string, fetched_at timestamp_ntz")
    want = sorted(map(repr, url_lists.evaluate(captures, feed).collect()))
    monkeypatch.setattr(url_lists, "HOT_ROWS", 20)
    monkeypatch.setattr(url_lists, "HOT_SHARE", 50)
    assert sorted(map(repr, url_lists.evaluate(captures, feed).collect())) == want and len(want) == 900


def test_plan_of_url_lists_has_no_python(spark):
    plan = url_lists.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- quality ----------------------------------------------------------------------------------------------------------
def slow_measure(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += c
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="ab#\n \t\x85\u00a0\x1cé", max_size=80)))
def test_measures_follow_their_definition(text):
    assert quality.measure(text) == slow_measure(text)


def test_measures_of_long_texts():
    assert quality.measure(LONG) == slow_measure(LONG)
    assert quality.measure("a b c " * 50)[4] == 150


def test_cutoffs_are_certified_and_strictest(spark):
    rng = random.Random(2)
    rows = [(s, 1000, 5000, rng.choice([0] * 995 + [300] * 5) if s == "en" else rng.choice([0, 300]), 0, 0) for s in ["en"] * 4000 + ["de"] * 4000 + ["fr"] * 30]
    good = spark.createDataFrame(rows, "stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    got = {(r.stratum, r.rule): r.cutoff for r in quality.certified(good).collect()}
    m = 3 * sum(len(c) for c in quality.CUTOFFS.values())

    def sure(n, k):
        if k > n * quality.MAX_FALSE:
            return False
        p, term, total = quality.MAX_FALSE, (1 - quality.MAX_FALSE) ** n, 0.0
        for j in range(k + 1):
            total += term
            term *= (n - j) / (j + 1) * p / (1 - p)
        return total <= quality.ALPHA / m

    for stratum in ("en", "de", "fr"):
        mine = [r for r in rows if r[0] == stratum]
        for rule, cuts in quality.CUTOFFS.items():
            value = {"symbols": lambda r: 1000 * r[3] // r[1], "dup_lines": lambda r: 0, "long_words": lambda r: 500}[rule]
            passing = [c for c in cuts if sure(len(mine), sum(value(r) > c for r in mine))]
            assert got.get((stratum, rule)) == (min(passing) if passing else None)
    assert ("fr", "symbols") not in got and got["en", "dup_lines"] == 5


def test_judge_takes_odd_rows(spark):
    labels = spark.createDataFrame([(2, 1, 0), (2, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(documents(spark), labels).collect()
    assert len(rows) == 13 and {r.doc_id for r in rows if r.kept} == {2}
    assert quality.judge(empty(spark), labels).count() == 0


# --- chat -------------------------------------------------------------------------------------------------------------
@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", ""]), st.lists(st.sampled_from([*"\\n<|>[/]s \n", *chat.CONTROLS]), max_size=12).map("".join)), max_size=5))
def test_chats_come_back(turns):
    text, spans = chat.compile_template(chat.TEMPLATE)([{"role": r, "text": t} for r, t in turns])
    back, loss = chat.read_back(text, [{"start": a, "stop": b} for a, b in spans])
    assert back == turns and loss == [t for r, t in turns if r == "assistant"]
    assert text.count(chat.CONTROLS[0]) == text.count(chat.CONTROLS[1]) == len(turns)
    assert not any(c in text for c in chat.CONTROLS[2:])


@pytest.mark.parametrize("template, want", [
    ("{% for m in messages %}{% if m.role != 'user' and not m.text == '' %}A{% elif m.role == 'user' %}{{ m.text | upper }}{% else %}-{% endif %}{% endfor %}", "HIA-"),
    ("{% if 'a' + 'b' == 'ab' %}x{{ 'y' + 'z' | upper }}{% else %}{{ m.text }}{% endif %}", "xyZ"),
    ("{% for m in messages %}{% generation %}{{ (m.role + ':') | trim }}{% endgeneration %}{% endfor %}", "user:assistant:x:"),
])
def test_template_language(template, want):
    text, spans = chat.compile_template(template)([{"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}, {"role": "x", "text": None}])
    assert text == want
    if "generation" in template:
        assert "".join(text[a:b] for a, b in spans) == want


def test_constants_are_folded():
    assert chat.merge_text(chat.parse("a{{ 'b' + 'c' }}{% if 'x' == 'x' %}d{% endif %}{% if not 'x' %}{{ m.t }}{% endif %}")) == [("text", "abcd")]


@pytest.mark.parametrize("bad", ["{{ m.__class__ }}", "{{ m.text.upper }}", "{{ open('x') }}", "{{ m.text | eval }}", "{% import os %}", "{% for m in messages %}", "{% endif %}", "{{ m }}", "{{ m.a m.b }}", "{{ 'a' + }}"])
def test_the_sandbox_refuses(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_formatting_takes_odd_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, None, "user", None), (1, 1, "assistant", "b"), (1, 1, None, "a"), (None, 0, "user", LONG), (2, 0, "assistant", "")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    turns, loss = chat.read_back(got[1].formatted, [s.asDict() for s in got[1].spans])
    assert turns == [("user", ""), ("", "a"), ("assistant", "b"), ("assistant", "b")] and loss == ["b", "b"]
    assert len(got) == 3 and LONG in got[None].formatted
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert list(itertools.chain(*[r.spans for r in got.values() if r.conv_id == 2])) == [got[2].spans[0]]
