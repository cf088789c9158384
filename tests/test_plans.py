"""What the physical plans must and must not hold."""

import pytest

from sitegrain.operators import funnel, score
from sitegrain.plans import audit, leads
from sitegrain.session import scratch_folder, stored
from sitegrain.sources import layout
from workload import funnel as wf
from workload import registry

QUERIES = registry.queries()
STREAMS = {n for n in QUERIES if "stream" in n}
# already run while they are built: their inputs are checkpointed
EAGER = {"e1_fast_leads", "e2_precise_leads"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS - EAGER))
def test_no_python_and_no_nested_loops(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["st4_page_links", "st9_page_assets", "st11_page_context", "t1_fingerprints", "c1_email_candidates", "x2_schema_facts"])
def test_page_jobs_do_not_shuffle(spark, folder, name):
    text = plan(QUERIES[name](spark, folder))
    # the one exchange allowed spreads a file of fewer splits than cores
    assert text.count("Exchange") <= text.count("REPARTITION_BY_NUM")


def test_picked_pages_are_not_shuffled(spark, folder):
    """With a broadcast limit below the page file's size and above that of the short table."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    ids = stored(pages.filter("page_id % 5 = 0").select("page_id", "url"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        text = plan(leads.picked(pages, ids))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in text and "BuildRight" in text and "SortMergeJoin" not in text


def test_top_is_not_a_full_sort(spark, folder):
    assert "TakeOrderedAndProject" in plan(funnel.top_sites(wf.scores(spark, folder), 5))


def test_ranked_limit_comes_before_the_shuffle(spark, folder):
    assert "WindowGroupLimit" in plan(funnel.candidate_budget(wf.candidates(spark, folder), wf.intents(spark)))


def test_scan_reads_only_needed_columns(spark, folder):
    text = plan(QUERIES["u1_pages_per_domain"](spark, folder))
    assert "html" not in text.split("ReadSchema")[1]


def test_evidence_is_not_grouped_by_its_text(spark, folder):
    """A site with most evidence is dealt over salts, and reduced to its best per set of words; its texts are never a key."""
    lines = [x for x in plan(QUERIES["t11_target_evidence"](spark, folder)).splitlines() if "Aggregate(" in x or "Exchange hashpartitioning" in x]
    assert lines and not any("blob" in x.split("functions=")[0] for x in lines)
    assert any("salt" in x for x in lines)


def html_moved(df):
    """Exchanges of the plan that carry a page's html."""
    root = df._jdf.queryExecution().executedPlan()
    todo, found = [root], []
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
            continue
        if "Exchange" in name and "html#" in node.output().mkString(","):
            found.append(name)
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return found


@pytest.mark.parametrize("case", ["content", "confidence", "audit", "audit_of_some"])
def test_html_stays_where_it_is_laid_out(spark, folder, case):
    """No side is small enough to be broadcast; only ids and what pages yield may be dealt."""
    raw = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    pages = wf.by_page_id(spark, raw)
    kept = stored(funnel.first_per_domain(wf.candidates(spark, folder)))

    def build(pages):
        if case == "content":
            return score.content_score(kept, pages, wf.intents(spark))
        if case == "confidence":
            return score.score_candidates(kept, pages, wf.intents(spark))
        return audit.site_audit(pages, domains=None if case == "audit" else kept)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert html_moved(build(raw))  # as it comes, html is shuffled
        assert not html_moved(build(pages))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_layout_keeps_all_pages_and_can_be_attached(spark):
    rows = [(i if i % 7 else None, f"https://a{i}.example/", None if i % 5 == 0 else f"<p>{i}</p>") for i in range(100)]
    pages = spark.createDataFrame(rows + rows[:3], "page_id long, url string, html string")
    path = f"{scratch_folder(spark)}/layout-test-{id(pages)}"
    out = layout.lay_out(pages, f"layout_test_{id(pages)}", path, 16)
    again = layout.attach(spark, f"layout_again_{id(pages)}", path, "page_id long, url string, html string", 16)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(key, out.collect())) == sorted(map(key, pages.collect())) == sorted(map(key, again.collect()))
    with pytest.raises(Exception, match="already exists"):
        layout.lay_out(pages, f"layout_test_{id(pages)}", path, 16)
