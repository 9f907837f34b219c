"""Reuse, budgets, eviction and rebuilding."""

import pytest
from pyspark.sql import functions as F

from tidemill.plans import algebra as A
from tidemill.plans.algebra import Agg, Rel, col
from tidemill.plans.workload import Session, find_min_budget, star_workload

from .conftest import rows

c = col
R, S = Rel("r"), Rel("s")
ON = c("r_k").eq(c("s_r"))


def make(spark, tmp_path, budget=None):
    s = Session(spark, str(tmp_path / "store"), budget)
    s.register("r", spark.range(200).select(F.col("id").alias("r_k"), (F.col("id") % 7).alias("r_v")), (("r_k",),))
    s.register("s", spark.range(150).select(F.col("id").alias("s_k"), (F.col("id") * 3 % 250).alias("s_r"), (F.col("id") % 2).cast("double").alias("s_x")), (("s_k",),))
    return s


def test_the_second_run_reads_one_relation_and_joins_nothing(spark, tmp_path):
    s = make(spark, tmp_path)
    first, second = s.run([R.join(S, ON), S.join(R, ON)])
    assert first.kept and first.joins == 1 and not first.reused
    assert second.reused and second.joins == 0 and second.pages_written == 0
    plan = s.query(S.join(R, ON))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert s.query(S.join(R, ON)).columns == ["s_k", "s_r", "s_x", "r_k", "r_v"]


def test_a_kept_input_serves_a_larger_query(spark, tmp_path):
    s = make(spark, tmp_path)
    q = R.join(S, ON)
    s.run([q])
    g = q.group((c("r_v"),), r_v=c("r_v"), n=Agg("count"))
    assert s.run([g])[0].joins == 0
    want = s.planner.tables["r"].join(s.planner.tables["s"], F.col("r_k") == F.col("s_r")).groupBy("r_v").agg(F.count("*").alias("n"))
    assert rows(s.query(g)) == rows(want)


@pytest.mark.parametrize("budget", [None, 0, 2, 5])
def test_same_results_and_never_over_budget(spark, tmp_path, budget):
    s = make(spark, tmp_path, budget)
    work = [R.join(S, ON), R.where(c("r_v") > 2), R.join(S, ON).where(c("s_x") > 0.0), S.group((c("s_x"),), s_x=c("s_x"), n=Agg("count"))]
    for q in work:
        s.run([q])
        assert budget is None or s.store.used <= budget
        assert rows(s.query(q)) == rows(A.lower(q, lambda x: s.planner.tables[x.name] if isinstance(x, Rel) else None))


@pytest.mark.parametrize(
    "q, gone",
    [
        (R.join(S, ON), "r"),
        (R.join(S, ON), "s"),
        (R.where(c("r_v") > 2), "r"),
        (R.select(r_k=c("r_k"), w=-c("r_v")), "r"),
        (A.Limit(20, A.Sort(((c("r_v"), True), (c("r_k"), False)), R)), None),
    ],
)
def test_a_lost_input_is_rebuilt(spark, tmp_path, q, gone):
    s = make(spark, tmp_path)
    s.run([q], complements=True)
    if gone is None:
        inner = q.child
        key = s.planner.add(inner)
        assert s.planner.can_rebuild(key, frozenset(k for k in s.planner.nodes if k == key))
        return
    before = rows(s.planner.tables[gone])
    s.planner.forget_table(gone)
    used = []
    assert rows(s.planner.result(Rel(gone), used)) == before
    assert used[0][0] == "reverse"
    assert "reverse" in s.planner.explain(Rel(gone))


def test_what_cannot_be_rebuilt_is_not_given_up(spark, tmp_path):
    s = make(spark, tmp_path)
    s.run([R.group((c("r_v"),), r_v=c("r_v"), n=Agg("count"))], complements=True)
    with pytest.raises(ValueError):
        s.planner.forget_table("r")


def test_eviction_keeps_recent_and_pinned(spark, tmp_path):
    s = make(spark, tmp_path)
    a, b = R.join(S, ON), R.where(c("r_v") > 1)
    s.run([a, b])
    s.store.budget = s.store.used
    s.store.entries[s.planner.key(a)].pins = 1
    assert s.planner.make_room(1)
    assert s.planner.key(a) in s.store.entries and s.planner.key(b) not in s.store.entries
    with pytest.raises(ValueError):
        s.store.delete(s.planner.key(a))


def sized(spark, n, name, seed=0):
    """A table whose rows do not compress."""
    return spark.range(n).select(F.col("id").alias(f"{name}_k"), *(F.xxhash64("id", F.lit(i + seed)).alias(f"{name}_{i}") for i in range(8)))


def test_what_cannot_fit_evicts_nothing(spark, tmp_path):
    s = Session(spark, str(tmp_path / "store"))
    s.register("small", sized(spark, 600, "a").coalesce(1), (("a_k",),))
    s.register("large", sized(spark, 6000, "b").coalesce(1), (("b_k",),))
    parts = [Rel("small").where((c("a_k") >= 200 * i) & (c("a_k") < 200 * i + 200)) for i in range(3)]
    s.run(parts)
    kept = set(s.store.entries)
    s.store.budget = s.store.used + 1
    report = s.run([Rel("large").where(c("b_k") >= 0)])[0]
    assert not report.kept and report.evicted <= 1 and set(s.store.entries) == kept
    again = s.run([Rel("large").where(c("b_k") >= 0)])[0]
    assert not again.kept and again.pages_written == 0  # its size is known now


def test_sql_and_algebra_under_a_tight_budget(spark, tmp_path):
    s = make(spark, tmp_path, 3)
    s.sql("SELECT r_v, count(*) AS n FROM r GROUP BY r_v", keep=True)
    for q in (R.join(S, ON), R.where(c("r_v") > 1), S.where(c("s_k") > 1), R.group((c("r_v"),), r_v=c("r_v"), n=Agg("count"))):
        s.run([q])
        assert s.store.used <= 3
    assert s.run(["SELECT count(*) AS k, r_v FROM r GROUP BY 2"])[0].rows == 7


def test_a_table_registered_again_leaves_nothing_stale(spark, tmp_path):
    s = make(spark, tmp_path)
    q = R.where(c("r_v") > 2)
    s.run([q, R.join(S, ON), S.where(c("s_k") > 1)])
    s.register("r", spark.range(2).select(F.col("id").alias("r_k"), F.lit(5).cast("long").alias("r_v")), (("r_k",),))
    assert s.query(q).count() == 2 and len(s.store.entries) == 1 and s.planner.key(S.where(c("s_k") > 1)) in s.store.entries


def test_a_kept_join_serves_larger_ones_in_any_order(spark, tmp_path):
    s = make(spark, tmp_path)
    s.register("t", spark.range(7).select(F.col("id").alias("t_k"), (F.col("id") + 1).alias("t_x")), (("t_k",),))
    s.run([R.join(S, ON)])
    q = Rel("t").join(R, c("t_k").eq(c("r_v"))).where(c("t_x") > 2).join(S, ON & (c("s_x") < 1.0)).select(a=c("s_k"), b=c("t_x") + c("r_k"))
    report, got = s.step(q)
    assert report.views == 1
    assert rows(got) == rows(A.lower(q, lambda x: s.planner.tables[x.name] if isinstance(x, Rel) else None))
    # what the kept join lacks is no use: a column that it projected away, a filter that the query does not have
    s2 = make(spark, tmp_path / "other")
    s2.run([R.join(S, ON).keep("r_k"), R.join(S, ON & (c("s_x") < 1.0))])
    assert s2.step(R.join(S, ON).keep("s_k"))[0].views == 0 and s2.step(R.join(S, ON).select(k=c("r_k")))[0].reused


def test_a_self_join_uses_a_kept_side(spark, tmp_path):
    s = make(spark, tmp_path)
    side = A.alias(R.where(c("r_v") > 2), "x", ["r_k", "r_v"])
    s.run([R.where(c("r_v") > 2)])
    q = side.join(A.alias(R, "y", ["r_k", "r_v"]), c("x_r_v").eq(c("y_r_v")) & (c("x_r_k") < c("y_r_k")))
    report, got = s.step(q)
    assert report.views + report.joins >= 1
    assert rows(got) == rows(A.lower(q, lambda x: s.planner.tables[x.name] if isinstance(x, Rel) else None))


def test_the_cheapest_set_is_evicted(spark, tmp_path):
    s = Session(spark, str(tmp_path / "store"))
    s.register("small", sized(spark, 900, "a").coalesce(1), (("a_k",),))
    parts = [Rel("small").where((c("a_k") >= 300 * i) & (c("a_k") < 300 * i + 300)) for i in range(3)]
    s.run([parts[0], parts[1], parts[0], parts[1], parts[2]])
    keys = [s.planner.key(p) for p in parts]
    assert s.planner.victims(1) == [keys[2]]  # asked for once, the others twice
    assert set(s.planner.victims(s.store.used)) == set(keys)
    s.planner.history.clear()
    s.planner.history.extend([keys[0], keys[2]])
    assert s.planner.victims(1) == [keys[1]]


def test_measured_sizes_correct_estimates(spark, tmp_path):
    s = make(spark, tmp_path)
    q = R.where(c("r_k") < 3)
    g = q.where(c("r_v") > 0)
    s.planner.add(g)
    before = s.planner.size(s.planner.key(g))
    s.run([q])
    assert s.planner.measured[q].rows == 3 and s.planner.size(s.planner.key(g)) <= before


@pytest.mark.parametrize(
    "text",
    [
        "SELECT r_v, sum(s_k) AS t FROM r JOIN s ON r_k = s_r WHERE s_x = 1.0 GROUP BY r_v HAVING count(*) > 1 ORDER BY t DESC LIMIT 3",
        "WITH a AS (SELECT r_v AS v, count(*) AS n FROM r GROUP BY r_v) SELECT x.v, y.n FROM a x JOIN a y ON x.v = y.v WHERE x.n > 20",
        "SELECT r_k FROM r WHERE EXISTS (SELECT 1 FROM s WHERE s_r = r_k AND s_x > 0) AND r_v NOT IN (1, 2)",
        "SELECT r_k FROM r WHERE r_k NOT IN (SELECT s_r FROM s WHERE s_r IS NOT NULL)",
        "SELECT s_k FROM s WHERE s_r > (SELECT avg(r_k) FROM r WHERE r_v = 3)",
        "SELECT r_k FROM r WHERE r_v > (SELECT avg(s_x) FROM s WHERE s_r = r_k)",
        "SELECT DISTINCT r_v % 3 AS m, CASE WHEN r_v > 3 THEN 'a' WHEN r_v > 1 THEN 'b' END AS w FROM r WHERE r_k BETWEEN 3 AND 90",
        "SELECT r_v AS v FROM r WHERE r_k < 5 UNION ALL SELECT s_k FROM s WHERE s_k < 3",
        "SELECT a.r_k, b.s_k FROM s b RIGHT JOIN r a ON a.r_k = b.s_r AND b.s_x < 1 ORDER BY a.r_k, b.s_k LIMIT 20",
        "SELECT count(DISTINCT s_x) AS d, min(s_k) + max(s_k) AS m, CAST(avg(s_k) AS DECIMAL(10, 2)) AS c FROM s",
    ],
)
def test_sql_through_the_session(spark, tmp_path, text):
    s = make(spark, tmp_path)
    want = spark.sql(text)
    for round in range(2):
        report, got = s.step(text)
        assert got.columns == want.columns and rows(got) == rows(want)
    assert report.reused and report.joins == 0


def test_sql_that_the_algebra_lacks_runs_as_it_is(spark, tmp_path):
    s = make(spark, tmp_path)
    got = s.sql("SELECT r_k, row_number() OVER (PARTITION BY r_v ORDER BY r_k) AS n FROM r", keep=True)
    assert got.count() == 200 and not s.store.entries


def test_graph_of_all_relations(spark, tmp_path):
    s = make(spark, tmp_path)
    s.run([R.join(S, ON)], complements=True)
    text = s.planner.graph()
    assert text.startswith("digraph") and text.count("style=filled") >= 3 and all(f'label="{k}"' in text for k in ("forward", "reverse"))


def test_sql_reuse_and_names(spark, tmp_path):
    s = make(spark, tmp_path)
    s.sql("SELECT r_v AS v, count(*) AS n FROM r WHERE r_k > 5 AND r_v < 4 GROUP BY r_v", keep=True)
    again = s.sql("SELECT r_v AS x, count(*) AS y FROM r WHERE r_v < 4 AND 5 < r_k GROUP BY r_v")
    assert again.columns == ["x", "y"] and again.count() == 4
    assert "Aggregate" not in again._jdf.queryExecution().executedPlan().toString()


def test_star_workload_changes_one_spoke():
    work = star_workload("h", ["a", "b", "c", "d", "e"], 4, 5)
    spokes = []
    for q in work:
        names = set()
        while isinstance(q, A.Join):
            names.add(q.right.name)
            q = q.left
        spokes.append(names)
    assert all(len(x & y) == 2 for x, y in zip(spokes, spokes[1:]))


def test_find_min_budget():
    assert find_min_budget(lambda b: b >= 11) == 11
    assert find_min_budget(lambda b: False) is None
