"""URL keys, redirect chains, and domain lists over many files."""

import random

from pyspark.sql import functions as F

from sitegrain.functions.urls import url_key
from sitegrain.operators.redirects import redirect_ends
from sitegrain.sources import records


def test_url_keys(spark):
    same = ["https://www.Shop.example/a/b/?q=1", "http://shop.example:80/a/./c/../b?q=1#x", "shop.example/a//b?q=1", "https://shop.example:443/../a/b/?q=1"]
    other = ["https://shop.example/a/b", "https://shop.example:8443/a/b?q=1", "https://shop.example/A/b?q=1", "https://m.shop.example/a/b?q=1", "http://shop.example:443/a/b?q=1"]
    keys = [r.k for r in spark.createDataFrame([(i, u) for i, u in enumerate([*same, *other, "", None, "https:///x", "a.example", "a.example/#t"])], "i int, u string").orderBy("i").select(url_key(F.col("u")).alias("k")).collect()]
    assert set(keys[:4]) == {"shop.example/a/b?q=1"} and len(set(keys[3:9])) == 6
    assert keys[9:] == [None, None, None, "a.example/", "a.example/"]


def walk(hops):
    out = {}
    for start in hops:
        at, n, seen = start, 0, [start]
        while at in hops and hops[at][1] not in (None, at):
            at, n = hops[at][1], n + 1
            if at in seen:
                circle = seen[seen.index(at) :]
                out[start] = (min(circle), None, None, True)
                break
            seen.append(at)
        else:
            out[start] = (at, hops[at][0] if at in hops else None, n, False)
    return out


def test_redirects_of_any_shape(spark):
    dice = random.Random(7)
    name = lambda i: f"h{i:04d}.example/"
    hops = {name(i): (301, name(i + 1)) for i in range(0, 133)} | {name(133): (200, None)}  # a long chain
    hops |= {name(i): (302, name(133)) for i in range(200, 320)}  # many into one end
    hops |= {name(400 + i): (301, name(400 + (i + 1) % 37)) for i in range(37)} | {name(500 + i): (301, name(501 + i)) for i in range(80)} | {name(580): (301, name(410))}  # a circle with a tail
    hops |= {name(600): (301, name(600)), name(601): (500, None), name(602): (301, name(999))}  # itself, nowhere, not stored
    hops |= {name(i): (301, name(dice.randint(700, 760))) for i in range(700, 750)} | {name(i): (200, None) for i in range(750, 755)}
    rows = [(i, "https://" + u, s, None if t is None else "http://www." + t + "#x") for i, (u, (s, t)) in enumerate(hops.items())]
    rows += [(9000, "https://h0001.example/", 200, None), (9001, None, 200, None), (9002, "", 301, "x")]
    got = redirect_ends(spark.createDataFrame(rows, "page_id long, url string, status int, final_url string")).collect()
    text = lambda u: u.replace("https://", "").replace("http://www.", "").replace("#x", "")
    assert {r.url_key: (text(r.final_url), r.http_status, r.redirects, r.cyclic) for r in got} == walk(hops) and len(got) == len(hops)
    assert redirect_ends(spark.createDataFrame([], "page_id long, url string, status int, final_url string")).count() == 0


def test_domain_list_over_files(spark, tmp_path):
    want = []
    for part, count in (("b", 700), ("a", 3), ("c", 1200)):
        (tmp_path / part).mkdir()
        for piece in range(2):
            lines = [f" {part}{piece}-{i}.example " if i % 5 else "  " for i in range(count)]
            (tmp_path / part / f"{piece}.txt").write_text("\n".join(lines))
            want += [x.strip() for x in lines if x.strip()]
    paths = [str(tmp_path / p) for p in "bac"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = records.read_domain_list(spark, paths).orderBy("place").collect()
        few = records.read_domain_list(spark, paths, cap=705).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.place, r.domain) for r in got] == list(enumerate(want, 1)) and [r.domain for r in few] == want[:705]
