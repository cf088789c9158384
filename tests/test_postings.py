"""Rules, names and words given as tables: found by the posting index exactly as by looking for each."""

import random
import re

from pyspark.sql import functions as F

from sitegrain.operators import postings, tech
from tests.conftest import page


def test_fifty_thousand_rules(spark):
    dice = random.Random(3)
    parts = [dice.choice("abcdefghij") + dice.choice("aeiou") for _ in range(60)]
    word = lambda n: "".join(dice.choice(parts) for _ in range(n))
    rules = [("page", f"tool{i}", "c", [re.escape(word(dice.randint(3, 6)) + dice.choice([".js", "-cdn", ""])), rf"{word(4)}\s*=\s*\d+"]) for i in range(50_000)]
    texts = [(i, f"https://site{i % 20}.example/", "<p>" + " ".join(dice.choice([word(5), word(3).upper(), rules[dice.randrange(50_000)][3][0].replace("\\", ""), f"{word(4)} = 7"]) for _ in range(80)) + "</p>") for i in range(120)]
    pages = spark.createDataFrame(texts, "page_id long, url string, html string")
    table = spark.createDataFrame(rules, "rule_set string, tech string, category string, patterns array<string>")
    index = postings.fingerprint_index(table, pages)
    from sitegrain.sources.pages import with_domain

    got = {(r.page_id, r.tech) for r in postings.fingerprints(with_domain(pages), index).collect()}
    plain = [(t, [(postings.fixed_text(p)[0], re.compile(p, re.I)) for p in ps]) for _, t, _, ps in rules]
    want = {(i, t) for i, _, html in texts for t, ps in plain if any(w in html.lower() and p.search(html) for w, p in ps)}
    assert got == want and len(want) > 1000
    # in slices, as when the index is too large for one broadcast
    assert {(r.page_id, r.tech) for r in postings.fingerprints(with_domain(pages), index, most=30_000).collect()} == want


def test_html_is_neither_shuffled_nor_copied(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    plan = tech.detect_fingerprints(pages, tech.fingerprint_rules(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("html" in line for line in exchanges)


def test_odd_rules(spark):
    rows = [("s", "short", "c", ["wc-"]), ("s", "any", "c", ["[0-9]{3}"]), ("s", "none", "c", []), ("s", "null", "c", None), ("s", "alt", "c", ["zzz|HubSpot"]), ("s", "one", "c", ["é"])]
    table = spark.createDataFrame(rows, "rule_set string, tech string, category string, patterns array<string>")
    find = lambda html: sorted(r.tech for r in tech.detect_fingerprints(page(spark, html), table).collect())
    assert find("a WC-x") == ["short"] and find("call 123") == ["any"] and find("my hubspot É") == ["alt", "one"] and find("") == [] and find(None) == []
    assert tech.detect_fingerprints(page(spark, "x"), table.limit(0)).count() == 0


def test_either_holds(spark):
    dice = random.Random(1)
    word = lambda: "".join(dice.choice("ab") for _ in range(dice.randint(1, 7)))
    names, rows = sorted({word() for _ in range(60)}), [(i, word()) for i in range(60)] + [(99, "")]
    got = postings.either_holds(spark.createDataFrame([(n,) for n in names], "low string"), "low", spark.createDataFrame(rows, "ord int, name string"), "name").collect()
    assert {(r.low, r.ord) for r in got} == {(n, i) for n in names for i, w in rows if w and (w in n or n in w)}


def test_hosts_by_table(spark):
    assets = spark.createDataFrame([("a.b.example",), ("b.example",), ("x.test",)], "host string").withColumn("page_id", F.lit(1))
    table = spark.createDataFrame([(0, "example", "first"), (1, "b.example", "second"), (2, "a.b.example", "exact")], "ord int, host string, tech string")
    assert {r.host: r.tech for r in tech.detect_hosts(assets, table).collect()} == {"a.b.example": "exact", "b.example": "second"}
