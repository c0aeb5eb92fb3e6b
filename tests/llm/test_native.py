"""Quality rules, license scans, url filters, and all SQL twins."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import licenses, quality_rules, queries, url_filters

duckdb = pytest.importorskip("duckdb")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = ("documents", "embeddings", "pages", "labels")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = queries.QUERIES[name](spark, d)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    order = sorted(df.columns)
    assert order == sorted(names)
    show = lambda r: tuple(repr(round(v, 6) if isinstance(v, float) else v) for v in r)
    assert sorted(map(show, df.select(order).collect())) == sorted(show([r[names.index(c)] for c in order]) for r in cur.fetchall())


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_base_counts(spark, docs_of, odd_rows):
    more = [(20, "a b c a b c d a b c", "en", "a"), (21, "x x x x x x", "en", "a"), (22, "a\na\n\na b\n a\na", "en", "a"), (23, "#|# <b> $5 100% *&", "en", "a"), (24, " ".join("abcab" * 40), "en", "a")]
    rows = odd_rows + more
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs_of(rows)).collect()}
    for i, t, _, _ in rows:
        n = counts(t)
        assert tuple(got[i][c] for c in quality_rules.BASE) == n, i
        assert got[i]["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_rules_keep_clean_and_catch_junk(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_quality_rules"](spark, d).collect()}
    good = [r[0] for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").select("doc_id").collect()]
    bad = [r[0] for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 0").select("doc_id").collect()]
    clean = [i for i in good if not got[i]["base_failed"]]
    assert sum(got[i]["kept"] for i in clean) >= 0.98 * len(clean)
    assert sum(got[i]["kept"] for i in bad) <= 0.1 * len(bad)


def plain_texts(n, start, source, lines=20, repeated=0, symbols=""):
    """Texts of invented distinct words; ``repeated`` of their lines are one line."""
    word = lambda k: "".join(chr(97 + k // 26 ** j % 26) for j in range(5))
    out = []
    for i in range(start, start + n):
        rows = [" ".join(word(7919 * (i * lines + j) + 31 * m) for m in range(8)) + symbols for j in range(lines - repeated)]
        out.append((i, "\n".join(rows + rows[:1] * repeated), "en", source))
    return out


def test_quantiles_decide_for_rates_that_are_mostly_zero(docs_of):
    rows = plain_texts(300, 0, "a") + plain_texts(3, 1000, "a", repeated=5)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs_of(rows)).collect()}
    assert all(got[i] for i in range(300)) and not any(got[i] for i in range(1000, 1003))


def test_more_groups_than_are_broadcast(docs_of, monkeypatch):
    rows = plain_texts(300, 0, "a") + plain_texts(3, 1000, "a", repeated=5) + plain_texts(250, 3000, None) + [(9000 + i, None, f"l{i}", None) for i in range(9)]
    want = sorted(map(str, quality_rules.quality_rules(docs_of(rows)).collect()))
    monkeypatch.setattr(quality_rules, "FENCES", 3)
    assert sorted(map(str, quality_rules.quality_rules(docs_of(rows)).collect())) == want


def test_a_polluted_group_does_not_lift_its_fences(docs_of):
    junk = plain_texts(150, 9000, "bad", symbols=" ########")
    rows = plain_texts(1700, 0, "good") + plain_texts(100, 5000, "bad") + junk
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs_of(rows)).collect()}
    assert not any(got[r[0]] for r in junk)
    assert all(got[i] for i in range(1700)) and all(got[i] for i in range(5000, 5100))


def test_rules_on_odd_rows(docs_of, odd_rows):
    assert quality_rules.quality_rules(docs_of([])).collect() == []
    kept = quality_rules.keep_good(docs_of(odd_rows))
    assert kept.columns == docs_of(odd_rows).columns and kept.count() <= len(odd_rows)


def test_buckets_are_ordered_and_close(spark):
    df = spark.range(1, 100_000, 37).select("id", quality_rules._bucket(F.col("id")).alias("b"))
    df = df.withColumn("v", quality_rules._value("b"))
    assert df.where("v > id or id >= v * 1.125 + 1").isEmpty()


def test_whole_license_texts(docs_of):
    mit = licenses.LICENSES["MIT"]
    rows = [(1, mit, "en", "a"), (2, "Copyright (c) 2020 Some Body\n\n" + mit.upper().replace(" ", "  "), "en", "a"), (3, mit + " and more", "en", "a"),
            (4, licenses.LICENSES["ISC"].replace(",", " ;"), "en", "a"), (5, "text\nReleased under the MIT Licence\nmore", "en", "a"), (6, None, "en", "a")]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(rows)).collect()}
    assert [got[i]["license"] for i in range(1, 7)] == ["MIT", "MIT", None, "ISC", None, None]
    assert got[5]["notices"] == "MIT" and got[5]["n_notices"] == 1 and got[6]["notices"] == ""
    assert licenses.scan(docs_of([])).collect() == []


BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""


def test_whole_license_files_with_titles(docs_of):
    mit, isc = licenses.LICENSES["MIT"], licenses.LICENSES["ISC"]
    holder = "\n\nCopyright (c) 2020 Some Body\n"
    rows = [(1, "MIT License" + holder + mit, "en", "a"), (2, "The MIT License (MIT)\r" + holder + "All rights reserved.\n\n" + mit + "\n", "en", "a"),
            (3, "# ISC Licence" + holder + isc, "en", "a"), (4, "BSD 2-Clause License" + holder + "All rights reserved.\n\n" + BSD2, "en", "a"), (5, BSD2, "en", "a"),
            (6, "MIT License and more" + holder + mit, "en", "a"), (7, "MIT License\nAll rights reserved.", "en", "a")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs_of(rows)).collect()}
    assert [got[i] for i in range(1, 8)] == ["MIT", "MIT", "ISC", "BSD-2-Clause", "BSD-2-Clause", None, None]


def test_known_files_of_the_system(docs_of):
    import os

    files = {i: f"/usr/share/common-licenses/{i}" for i in ("Apache-2.0", "MPL-2.0", "CC0-1.0")} | {f"GPL-{v}.0": f"/usr/share/common-licenses/GPL-{v}" for v in (2, 3)}
    files = {i: p for i, p in files.items() if os.path.exists(p)}
    rows = [(k, open(p, encoding="utf-8").read(), "en", "a") for k, p in enumerate(files.values())]
    assert [r["license"] for r in licenses.scan(docs_of(rows)).orderBy("doc_id").collect()] == list(files)


def test_notices_without_the_word_license(docs_of):
    rows = [(1, "a\nThis is free software!\nb", "en", "a"), (2, "MIT License\n\n", "en", "a")]
    got = {r["doc_id"]: r["notices"] for r in licenses.scan(docs_of(rows), notices={"X": "This is free software.", "T": "MIT License"}).collect()}
    assert got == {1: "X", 2: "T"}
    assert licenses.scan(docs_of(rows), notices={}).where("n_notices = 0").count() == 2


def test_everyday_forms_of_a_license(docs_of):
    mit, isc = licenses.LICENSES["MIT"], licenses.LICENSES["ISC"]
    block = lambda lead, t: "\n".join(lead + x for x in t.split("\n"))
    rights = "MIT License\n\nCopyright (c) 2020 Some Body\nAll rights reserved.\n\n" + mit
    curly = mit.replace('"Software"', "\u201cSoftware\u201d").replace('"AS IS"', "\u201cAS IS\u201d").replace(" and/or ", "\u00a0and/or ")
    rows = [block("# ", rights), block("// ", rights), block(" * ", rights), block("; ", "Copyright 1999 X\n" + isc), curly, rights.replace("\n", "\r\n"),
            block("-- ", "The Unlicense\n" + licenses.LICENSES["Unlicense"]), licenses.LICENSES["Unlicense"].replace("https", "http").rstrip(">/") + ">", block("# ", rights) + "\n# No more.", "Copyright is a word.\n" + mit]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs_of([(i, t, "en", "a") for i, t in enumerate(rows)])).collect()}
    assert [got[i] for i in range(10)] == ["MIT", "MIT", "MIT", "ISC", "MIT", "MIT", "Unlicense", None, None, "MIT"]


def test_any_notice_is_found(docs_of):
    rows = [(1, "Public domain.", "en", "a"), (2, "# PUBLIC   DOMAIN", "en", "a"), (3, "public domains", "en", "a"), (4, "a\nLicence: free\n", "en", "a"), (5, "sub license", "en", "a")]
    got = {r["doc_id"]: r["notices"] for r in licenses.scan(docs_of(rows), notices={"PD": "Public domain.", "F": "License, free", "S": "Sublicense!"}).collect()}
    assert got == {1: "PD", 2: "PD", 3: "", 4: "F", 5: "S"}


def test_license_odd_rows(docs_of, odd_rows):
    assert licenses.scan(docs_of(odd_rows)).count() == len(odd_rows)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, html string, host string, verdict string")


def test_rules_and_hosts(spark):
    rows = [(1, "http://A.Example.com/en/1?x", None), (2, "https://b.example.com/en/77#t", ""), (3, "https://x.org/es/", ""), (4, "no url", ""), (5, None, None),
            (6, "https://x.example.net/de/81", ""), (7, "https://com/en/q", ""), (8, "https://com/english", ""), (9, "https://x.comx/en/", ""), (5, None, None)]
    got = {r["page_id"]: r for r in url_filters.verdicts(pages(spark, rows)).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.com", "/en/1", "com/en/", "block")
    assert (got[2]["rule"], got[2]["verdict"]) == ("example.com/en/7", "allow")
    assert got[6]["rule"] == "example.net/de/8" and got[8]["rule"] is None and got[9]["rule"] is None
    assert (got[4]["host"], got[4]["path"], got[4]["verdict"]) == ("", "", "allow") and got[5]["host"] == ""
    assert url_filters.verdicts(pages(spark, [])).collect() == []


def test_each_rule_says_what_its_contract_says(spark):
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {host + path: says for host, path, says in url_filters.RULES} == want
    rows = [(i, f"https://x.{rule}1", "") for i, rule in enumerate(sorted(want))]
    got = {r["rule"]: r["verdict"] for r in url_filters.verdicts(pages(spark, rows)).collect()}
    assert got == want
    cur = duckdb.connect()
    cur.execute("create table pages (page_id bigint, url varchar, html varchar)")
    cur.executemany("insert into pages values (?, ?, ?)", rows)
    assert dict(cur.execute(f"select rule, verdict from ({url_filters.SQL})").fetchall()) == want


def test_distrust_flows_back_and_trust_forward(spark):
    link = '<a href="https://{}/x">x</a>'
    rows = [(1, "https://bad.org/es/1", ""), (2, "https://fan.info/a", link.format("bad.org")), (3, "https://b.example.com/en/7", link.format("good.info")), (4, "https://good.info/a", ""),
            (5, "https://alone.info/a", link.format("elsewhere.info"))]
    got = {r["page_id"]: r["verdict"] for r in url_filters.verdicts(pages(spark, rows)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    link = '<a href="https://h{}.info/x">x</a>'
    rows = [(0, "https://h0.org/es/1", "")] + [(i, f"https://h{i}.info/a", link.format(i - 1) if i > 1 else '<a href="https://h0.org/">x</a>') for i in range(1, 13)]
    got = {r["page_id"]: r["verdict"] for r in url_filters.verdicts(pages(spark, rows)).collect()}
    assert set(got.values()) == {"block"}


def test_walk_equals_a_converged_one_and_keeps_small_shares(spark):
    from rasterloom.llm.common import Scratch

    edges = {("a", "b"): 1, ("b", "c"): 2, ("c", "a"): 1, ("b", "d"): 1, **{("d", f"x{i}"): 1 for i in range(50)}}
    want = {}
    for _ in range(400):
        out = Counter({"a": 0.15 * 1e-9})  # a seed of a billionth of all
        for (s, t), w in edges.items():
            out[t] += 0.85 * want.get(s, 0.0) * w / sum(v for (u, _), v in edges.items() if u == s)
        want = out
    e = spark.createDataFrame([(*k, w) for k, w in edges.items()], "src string, dst string, w long")
    seeds = spark.createDataFrame([("a", url_filters.WHOLE // 10**9)], "host string, seed long")
    got = {r["host"]: r["mass"] / url_filters.WHOLE for r in url_filters._walk(seeds, e, Scratch(spark)).collect()}
    assert got.keys() == want.keys() and all(abs(got[h] / want[h] - 1) < 1e-5 for h in want)


def test_a_hub_and_a_host_of_most_pages(spark, monkeypatch):
    """A hub that most edges leave and a host that most pages share: the same verdicts, and no join by host meets their rows."""
    from rasterloom.llm import common

    link = '<a href="https://{}/x">x</a>'
    rows = [(1, "https://bad.org/es/1", ""), (2, "https://hub.info/a", link.format("bad.org") + "".join(link.format(f"h{i}.info") for i in range(60)))]
    rows += [(100 + i, f"https://h{i}.info/a", link.format("hub.info") if i % 2 else "") for i in range(60)] + [(1000 + i, "https://hub.info/b", "") for i in range(200)] + [(5000, None, None)]
    plain_ = {r["page_id"]: r["verdict"] for r in url_filters.verdicts(pages(spark, rows)).collect()}
    monkeypatch.setattr(common, "HOT", 8)
    monkeypatch.setattr(url_filters, "HOT", 8)
    hot = {r["page_id"]: r["verdict"] for r in url_filters.verdicts(pages(spark, rows)).collect()}
    assert hot == plain_ and len(hot) == len(rows)
    assert all(hot[1000 + i] == "block" for i in range(200)) and hot[101] == "block" and hot[100] == "allow" and hot[5000] == "allow"


def test_fences_follow_the_groups(spark):
    """No rate has one fence everywhere: a group of long texts, of symbols or of repeats has its own."""
    from rasterloom.llm.common import Scratch
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    rows = []
    for source, words, symbols, lines in (("short", 60, 0, 3), ("long", 600, 0, 30), ("marked", 60, 4, 3), ("shouting", 60, 0, 3)):
        for i in range(220):
            t = [word() + ("#" if k < symbols + i % 2 and symbols else "") for k in range(words)]
            if source == "shouting":
                t[:20] = [w.upper() for w in t[:20]]
            rows.append((len(rows), "\n".join(" ".join(t[k::lines]) for k in range(lines)), "en", source))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    scratch = Scratch(spark)
    counted = scratch.keep(quality_rules._spread(quality_rules.with_counts(df).drop("text")))
    f = {x["source"]: x for x in quality_rules.thresholds(counted, scratch).collect()}
    assert f["long"]["high_symbols"] < f["short"]["high_symbols"] < f["marked"]["high_symbols"]
    assert f["long"]["high_dup_lines"] < f["short"]["high_dup_lines"] and f["long"]["high_repeats"] < f["short"]["high_repeats"]
    assert f["shouting"]["high_upper"] > f["short"]["high_upper"]
    assert all(len({x[f"high_{rate}"] for x in f.values()}) > 1 for rate in quality_rules.RATES)
