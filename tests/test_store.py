"""Publication as one: whatever a load had written when it died, the old set is read."""
import pytest
from pyspark.sql import functions as F

from sitelens.plans.load import save_reports
from sitelens.sinks.store import LostRace, Store

TENANT, GLOBAL = ["facts", "extras"], ["factors"]


class Killed(BaseException):
    """Not an Exception: nothing in the library may catch it, as nothing catches a kill."""


def run(store, tenants, tag, empty=False):
    """One load: two tenant tables, a global one and an appended log."""
    spark, load = store.spark, store.begin()
    rows = spark.createDataFrame([(t, n, f"{tag}-{n}") for t in tenants for n in range(3)], "company_id long, n int, tag string")
    load.write("facts", rows)
    load.write("extras", rows.where("n > 5" if empty else "n > 1"), biggest=F.max("n"))
    load.write("factors", spark.createDataFrame([(tag, 1.5)], "key string, rate double"), per_tenant=False)
    load.write("log", spark.createDataFrame([(t, tag) for t in tenants], "company_id long, tag string"))
    number = load.publish(spark.createDataFrame([(t,) for t in tenants], "company_id long"), TENANT, GLOBAL, ["log"])
    return number, load


def seen(store):
    return {t: sorted(tuple(r) for r in store.read(t).collect()) for t in [*TENANT, *GLOBAL, "log"]}


def test_replace_append_and_read(spark, tmp_path):
    store = Store(spark, str(tmp_path / "set"))
    assert store.current() is None and store.read("facts") is None
    assert run(store, [1, 2], "a")[0] == 1
    first = store.current()
    number, load = run(store, [2, 3], "b", empty=True)
    assert number == 2 and load.observed["extras"]["rows"] == 0 and load.observed["facts"]["rows"] == 6
    now = seen(store)
    assert now["facts"] == sorted([(1, n, f"a-{n}") for n in range(3)] + [(t, n, f"b-{n}") for t in (2, 3) for n in range(3)])
    assert now["extras"] == [(1, 2, "a-2")]  # tenant 2 has none any more
    assert now["factors"] == [("b", 1.5)] and now["log"] == [(1, "a"), (2, "a"), (2, "b"), (3, "b")]
    # An earlier version stays readable as it was.
    assert sorted(r.tag for r in store.read("facts", first).where("company_id = 2").collect()) == ["a-0", "a-1", "a-2"]
    assert store.read("other") is None
    store.remove_tenant(2)
    assert seen(store)["log"] == [(1, "a"), (3, "b")] and {r[0] for r in seen(store)["facts"]} == {1, 3}


def test_killed_between_any_two_writes(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "set"))
    run(store, [1, 2], "old")
    before, save, writes = seen(store), Store.save, []
    monkeypatch.setattr(Store, "save", lambda self, *a, **k: writes.append(1) or save(self, *a, **k))
    run(store, [9], "counts")
    number, total = store.current().version, len(writes)
    assert total == 6  # four tables, manifest, pointer
    before = seen(store)
    for k in range(total):
        left = [k]

        def dies(self, *a, **kw):
            if not left[0]:
                raise Killed
            left[0] -= 1
            save(self, *a, **kw)

        monkeypatch.setattr(Store, "save", dies)
        with pytest.raises(Killed):
            run(store, [1, 5], "new")
        assert seen(store) == before and store.current().version == number, k
    monkeypatch.setattr(Store, "save", save)
    run(store, [1, 5], "new")
    assert {r[2][:3] for r in seen(store)["facts"] if r[0] in (1, 5)} == {"new"}


def test_two_loads_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "set"))
    loads = [store.begin(), store.begin()]
    for k, load in enumerate(loads):
        load.write("factors", spark.createDataFrame([(str(k), 1.0)], "key string, rate double"), per_tenant=False)
    outcomes = []
    for load in loads:
        try:
            outcomes.append(load.publish(globals_=["factors"]))
        except LostRace:
            outcomes.append(None)
    winner = min(loads, key=lambda x: x.id)
    assert [r.key for r in store.read("factors").collect()] == [str(loads.index(winner))]
    assert outcomes[1] is None or loads[1] is winner


def test_reports_are_upserted_by_key(spark, tmp_path):
    out = str(tmp_path / "set")
    def report(company, digest, day, text):
        return (company, "m", "v1", digest, f"2025-01-{day:02d} 00:00:00", text)
    def frame(*rows):
        return spark.createDataFrame(rows, "company_id long, model string, prompt_version string, fact_digest string, at string, text string") \
            .withColumn("created_at", F.to_timestamp("at")).drop("at")
    save_reports(spark, out, frame(report(1, "d1", 1, "first"), report(1, "d2", 1, "kept"), report(2, "d1", 1, "other")))
    save_reports(spark, out, frame(report(1, "d1", 3, "newest"), report(1, "d1", 2, "older"), report(3, "d9", 1, "new")))
    got = sorted((r.company_id, r.fact_digest, r.text) for r in Store(spark, out).read("reports").collect())
    assert got == [(1, "d1", "newest"), (1, "d2", "kept"), (2, "d1", "other"), (3, "d9", "new")]


def test_rows_of_few_tenants_are_not_shuffled(spark, tmp_path, monkeypatch):
    store, save, shuffled = Store(spark, str(tmp_path / "set")), Store.save, []
    monkeypatch.setattr(Store, "save", lambda self, df, *a, **k: shuffled.append(
        "Rebalance" in df._jdf.queryExecution().optimizedPlan().toString()) or save(self, df, *a, **k))
    rows = spark.createDataFrame([(t, n) for t in (1, 2) for n in range(3)], "company_id long, n int").repartition(3)
    for tenants in (2, 17, None):
        load = store.begin()
        load.tenants = tenants
        assert load.write("facts", rows).count() == 6 and load.observed["facts"]["rows"] == 6
    assert shuffled == [False, True, True]


def test_rows_that_are_not_published_are_deleted(spark, tmp_path):
    store = Store(spark, str(tmp_path / "set"))
    run(store, [1, 2], "a")
    load, rows = store.begin(), spark.createDataFrame([(t, n, f"b-{n}") for t in (1, 2) for n in range(3)], "company_id long, n int, tag string")
    load.tenants = 2
    load.write("facts", rows)
    load.publish(spark.createDataFrame([(1,)], "company_id long"), ["facts"])
    load.drop_unpublished(["facts", "extras"], spark.createDataFrame([(2,)], "company_id long"))
    at = tmp_path / "set" / "data" / "facts"
    assert sorted(p.name for p in (at / f"load={load.id}").glob("company_id=*")) == ["company_id=1"]
    assert sorted(tuple(r) for r in store.read("facts").collect()) == [(1, n, f"b-{n}") for n in range(3)] + [(2, n, f"a-{n}") for n in range(3)]
