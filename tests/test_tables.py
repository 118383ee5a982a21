from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import fields, models
from quern.operators import content, index_store, submissions
from quern.sources import tables
from quern.streaming import changes


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_pivot_keeps_headers_without_values(spark):
    headers = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), "job"), (2, dt.datetime(2024, 1, 2), "job"), (3, dt.datetime(2024, 1, 3), "job"), (4, dt.datetime(2024, 1, 4), "x")], "id long, created_at timestamp, form_name string")
    values = spark.createDataFrame([(1, "fullname", "Ann"), (1, "mobile", "09"), (1, "request_type", "t"), (1, "message", "m"), (1, "resume_file", "f"), (3, "resume_file", None)], "submission_id long, key string, value string")
    found = submissions.pivot_latest(headers, values, 500, "job").orderBy(F.desc("id")).collect()
    assert [tuple(r)[2:] for r in found] == [("", "", "", None, False), ("", "", "", None, False), ("Ann", "09", "t", "m", True)]
    assert submissions.pivot_latest(headers, values, 0).count() == 1
    assert submissions.look_up(headers, values, "resume_file").collect() == [(1, "f")]


def test_ids_and_seeding(spark):
    rows = spark.createDataFrame([(f"n{k}",) for k in range(20)], "name string").repartition(5)
    found = dict(submissions.with_ids(rows, 100, "name").select("name", "id").collect())
    assert sorted(found, key=found.get) == sorted(found) and sorted(found.values()) == list(range(101, 121))
    assert submissions.seed_missing(spark.createDataFrame([("N1",)], "name string"), rows, "name").count() == 19


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_of_a_million_rows_have_no_gap(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.range(0, 1_000_000, 1, 16).select(F.xxhash64("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
        found = submissions.with_ids(rows, 6, "k")
        n, distinct, low, high = found.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first()
        assert (n, distinct, low, high) == (1_000_000, 1_000_000, 7, 1_000_006)
        # In order: cut at any place, all smaller ids have smaller keys.
        for at in (1000, 250_000, 777_777):
            assert found.where(F.col("id") <= at).agg(F.max("k")).first()[0] < found.where(F.col("id") > at).agg(F.min("k")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_scratch_tables_go(spark):
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(root.iterdir())
    with tables.scratch(spark):
        tree = nodes(spark)
        assert submissions.with_ids(tree.select("url"), 0, "url").count() == 5
        assert content.document_order(tree).count() == 5 and content.descendants(tree, tree.where("level = 1")).count() == 4
        assert set(root.iterdir()) > before
    assert set(root.iterdir()) == before


def test_document_order(spark):
    rows = [("r2", None, -5, "home"), ("r1", None, 9, "home"), ("a", "r1", 1, "set"), ("b", "r2", 3, "page"), ("b2", "r2", 3, "page"), ("deep", "b", 0, "set"), ("ab", "b2", 7, "page"), ("z", "b", 0, "page"), ("lost", "gone", 0, "set"), ("under", "lost", 0, "set")]
    tree = spark.createDataFrame(rows, "id string, parent_id string, sort_order long, type string").repartition(4)
    found = content.document_order(tree).orderBy("place").collect()
    assert [(r.id, r.place, r["last"]) for r in found] == [("r2", 0, 5), ("b", 1, 3), ("deep", 2, 2), ("z", 3, 3), ("b2", 4, 5), ("ab", 5, 5), ("r1", 6, 7), ("a", 7, 7)]
    # The deeper page under the first root comes before the higher one under the second.
    assert content.first_of(tree, "set").first().id == "deep" and content.first_of(tree, "none").count() == 0
    path = {r.id: r.path for r in found}
    assert {r.id for r in content.tree_paths(tree).where(content.below_path(path["b"])).collect()} == {"b", "deep", "z"}
    chain = spark.createDataFrame([("n0", None, 0, "x")] + [(f"n{k}", f"n{k - 1}", 0, "x") for k in range(1, 40)], tree.schema)
    assert [r.id for r in content.document_order(chain).orderBy("place").collect()] == [f"n{k}" for k in range(40)]
    with pytest.raises(ValueError, match="circle"):
        content.tree_paths(spark.createDataFrame([("a", "b", 0, "x"), ("b", "a", 0, "x")], tree.schema))


def test_form_rules(spark):
    errors = submissions.form_errors(*map(F.lit, ("x", "0912", " ", "m" * 2001, "")))
    assert value(spark, errors) == ["fullname", "mobile", "request_type", "message", "form"]
    assert value(spark, submissions.form_errors(*map(F.lit, ("Ann", "09123456789", "t", None, "f")))) == []
    rules = [("job_interest_form", True, "ok"), (" Job_Interest_Form", False, "file"), ("contact_form", True, "file"), ("product_demo_form", False, "ok"), ("job_form", True, "unknown_form"), ("other", False, "unknown_form"), (None, False, "unknown_form")]
    for form, has_file, expected in rules:
        assert value(spark, submissions.file_rule(F.lit(form).cast("string"), F.lit(has_file))) == expected
    assert value(spark, submissions.pdf_ok(F.lit("A.PDF"), F.lit(b"%PDF-1.7"))) and not value(spark, submissions.pdf_ok(F.lit("a.pdf"), F.lit(b"PK")))
    assert value(spark, submissions.not_trapped(F.lit(" "))) and not value(spark, submissions.not_trapped(F.lit("x")))


def test_fields(spark):
    now = dt.datetime(2024, 1, 1)
    assert value(spark, fields.expiry(F.lit(None).cast("timestamp"), F.lit(now))) == now + dt.timedelta(minutes=30)
    assert value(spark, fields.expiry(F.lit(now - dt.timedelta(1)), F.lit(now))) == now + dt.timedelta(minutes=30)
    assert value(spark, fields.json_field(F.lit('{"Expires": "x", "b": 1}'), "expires")) == "x"
    assert value(spark, fields.url_path(F.lit("https://A.b/C/d/?q#x"))) == "/c/d" and value(spark, fields.url_path(F.lit("tel:1"))) == ""
    assert value(spark, fields.page_title("Site", F.lit(" "), F.lit("Home"))) == "Home | Site"
    assert value(spark, fields.xml_escape(F.lit("a&<b>"))) == "a&amp;&lt;b&gt;"
    page = "<body>x</body></body>"
    assert value(spark, fields.insert_before_body_end(F.lit(page), "<s>")) == "<body>x</body><s></body>"
    assert value(spark, fields.classify(F.lit("Steel pipe"), [("metal", ("steel",)), ("pipe", ("pipe",))], "none", F.lit(" "))) == "metal"
    names = {" job_interest_form ": "job_interest_form", "product_demo_form": "product_demo_form", "Contact_Form": "consult_form", "X": "consult_form", None: "consult_form"}
    assert {n: value(spark, fields.form_name(F.lit(n).cast("string"))) for n in names} == names
    assert value(spark, submissions.form_definition(F.lit("job_interest_form")))[:3] == ("job_interest_form", 40, 61)
    assert value(spark, fields.trim_to(F.lit("  abc "), 2)) == "ab"
    assert value(spark, fields.by_position(F.lit(5), ("a", "b"), "z")) == "z"
    assert str(value(spark, fields.iran_time(F.lit(dt.datetime(2020, 7, 1))))).endswith("04:30:00")


def nodes(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("r", None, 1, 0, "home", "/"), ("a", "r", 2, 2, "news", "/a"), ("b", "r", 2, 1, "news", "/b"), ("c", "a", 3, 0, "page404", "/404"), ("d", "a", 3, 1, "news", "#")]
    return spark.createDataFrame([(i, p, lv, s, t, True, at + dt.timedelta(s), None, at, u) for i, p, lv, s, t, u in rows], "id string, parent_id string, level int, sort_order long, type string, has_template boolean, create_date timestamp, publish_date timestamp, update_date timestamp, url string")


def test_content(spark):
    tree = nodes(spark)
    assert {(r.id, r.distance) for r in content.descendants(tree, tree.where("level = 1")).collect()} == {("a", 1), ("b", 1), ("c", 2), ("d", 2)}
    assert [r.id for r in content.latest(tree, "news", 2).collect()] == ["a", "b"]
    assert [r.value for r in content.sitemap_xml(content.sitemap(tree)).collect()][0] == "<url><loc>/</loc><lastmod>2024-01-01</lastmod><priority>1.0</priority></url>"
    assert content.sitemap(tree).count() == 3
    assert {r.id: r.parent_url for r in content.with_parent_url(tree, "/x").collect()}["r"] == "/x"
    active = lambda now, target, above: value(spark, content.is_active(F.lit(now), F.lit(target), F.array(*map(F.lit, above))))
    assert active("/a/b", "/a", ["/z"]) and not active("/ab", "/a", ["/z"]) and active("/q", "/z", ["/z"])
    shown = spark.createDataFrame([("a", "A", None, 0), ("all", "All", True, 1), ("c", "C", False, 2), ("d", " ", True, 3)], "key string, title string, visible boolean, pos int")
    assert [r.key for r in content.category_order(shown).orderBy("place").collect()] == ["all", "a"]
    empty, default = shown.limit(0), shown.limit(1)
    assert content.or_defaults(empty, empty, default).count() == 1 and content.or_defaults(shown, empty, default).count() == 0
    assert value(spark, content.media_or(F.array(F.lit(" ")), ["f"])) == ["f"]


def test_sitemap_documents(spark, tmp_path):
    """Files parse, hold at most so many entries, and follow each other in order; ties stand in document order."""
    import xml.etree.ElementTree as ET

    at = dt.datetime(2024, 1, 1)
    rows = [("r1", None, 1, 2, "/r1"), ("r0", None, 1, 1, "/r0&")] + [(f"p{k:02d}", "r1" if k % 2 else "r0", 2, k // 4, f"/p{k}") for k in range(23)] + [("lost", "gone", 2, 0, "/lost"), ("bare", "r0", 2, 0, "#")]
    tree = spark.createDataFrame([(i, p, lv, s, "page", True, at, at, at, u) for i, p, lv, s, u in rows], nodes(spark).schema).repartition(3)
    content.write_sitemap(tree, f"file://{tmp_path}/map", "https://x.example.com", 6)
    space = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
    found = []
    for k in range(5):
        (file,) = (tmp_path / f"map/urls/file={k}").glob("part-*")
        urls = ET.fromstring(file.read_bytes()).findall(f"{space}url")
        assert len(urls) == (6 if k < 4 else 1) and {u.find(f"{space}changefreq").text for u in urls} == {"weekly"}
        found += [(u.find(f"{space}loc").text, u.find(f"{space}priority").text, u.find(f"{space}lastmod").text) for u in urls]
    document = ["r0", *(f"p{k:02d}" for k in range(0, 23, 2)), "r1", *(f"p{k:02d}" for k in range(1, 23, 2))]
    order = sorted((r for r in rows if r[0] in document), key=lambda r: (r[2], r[3], document.index(r[0])))
    assert found == [("https://x.example.com" + u, "1.0" if lv == 1 else "0.8", "2024-01-01") for _, _, lv, _, u in order]
    (index,) = (tmp_path / "map/index").glob("part-*")
    assert [e[0].text for e in ET.fromstring(index.read_bytes())] == [f"https://x.example.com/sitemap-{k}.xml" for k in range(5)]
    content.write_sitemap(tree.limit(0), f"file://{tmp_path}/none", "https://x.example.com")
    (file,) = (tmp_path / "none/urls/file=0").glob("part-*")
    assert not list(ET.fromstring(file.read_bytes()))


@pytest.fixture
def database(spark, tmp_path):
    """Submissions in the database that comes with Spark, and the same as frames."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    headers = spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), "job_interest_form" if k % 3 else "contact_form") for k in range(1, 400)], "id long, created_at timestamp, form_name string")
    values = headers.select(F.col("id").alias("submission_id"), F.explode(F.create_map(F.lit("fullname"), F.concat(F.lit("n"), "id"), F.lit("mobile"), F.lit("09"), F.lit("resume_file"), F.when(F.col("id") % 5 == 0, "f")))).selectExpr("submission_id", "key as name", "value").where("value is not null")
    for name, df in (("headers", headers), ("values_of", values)):
        df.coalesce(2).write.option("createTableColumnTypes", ", ".join(f"{c} VARCHAR(60)" for c, t in df.dtypes if t == "string")).jdbc(url, name, properties={"driver": tables.DERBY})
    return tables.Database(spark, url, tables.DERBY), headers, values.withColumnRenamed("name", "key")


def test_reports_from_a_database(spark, database):
    db, headers, values = database
    for take, form in ((5, "job_interest_form"), (300, None), (0, "contact_form"), (50, "none")):
        expected = submissions.pivot_latest(headers, values, take, form).orderBy("id").collect()
        assert submissions.pivot_latest_of(db, "headers", "values_of", take, form, key="name").orderBy("id").collect() == expected
    # In ranges of the key, with the predicate in the database and columns pruned.
    ranges = db.in_ranges("headers", "id", 7).where("form_name = 'contact_form' and id > 100").select("id")
    assert ranges.rdd.getNumPartitions() == 7 and sorted(r.id for r in ranges.collect()) == [k for k in range(101, 400) if k % 3 == 0]
    plan = ranges._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(form_name), *IsNotNull(id), *EqualTo(form_name,contact_form), *GreaterThan(id,100)]" in plan and "ReadSchema: struct<id:bigint>" in plan
    newest = db.newest("headers", ("id", "created_at"), "id", 4, {"form_name": "contact_form"})
    assert [r.id for r in newest.collect()] == [399, 396, 393, 390] and "FETCH NEXT 4 ROWS" in newest._jdf.queryExecution().executedPlan().toString()
    assert db.newest("headers", ("id",), "id", 4, {"form_name": "x' or '1' = '1"}).count() == 0
    with pytest.raises(ValueError, match="name"):
        db.newest("headers; drop table headers", ("id",), "id", 1)
    assert db.in_ranges("headers", "id", 3).where("id < 0").count() == 0


def test_descendants_have_no_row_or_depth_limit(spark):
    links = [("n0", None)] + [(f"n{k}", f"n{k - 1}") for k in range(1, 21)] + [(f"x{k}", "n20") for k in range(50)]
    tree = spark.createDataFrame(links, "id string, parent_id string")
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "40")
    try:
        found = {r.id: (r.root_id, r.distance) for r in content.descendants(tree, tree.where("parent_id is null")).collect()}
    finally:
        spark.conf.set(key, before)
    assert found == {f"n{k}": ("n0", k) for k in range(1, 21)} | {f"x{k}": ("n0", 21) for k in range(50)}
    circle = spark.createDataFrame([("a", "b"), ("b", "a")], tree.schema)
    with pytest.raises(ValueError, match="circle"):
        content.descendants(circle, circle.where("id = 'a'"))
    assert content.descendants(tree.limit(0), tree.limit(0)).count() == 0


def test_index_store(spark, tmp_path):
    store = index_store.IndexStore(spark, f"file://{tmp_path}/index")
    assert store.version() == 0 and store.read() is None
    rows = spark.createDataFrame([("A", 0, "a"), ("B", 1, "b"), ("A", 2, "a2")], "item_id string, pos long, text string")
    assert store.rebuild(rows) == 1
    store.refresh(spark.createDataFrame([("A", 0, "new"), ("A", 1, "new2")], rows.schema))
    assert sorted(map(tuple, store.read().collect())) == [("A", 3, "new"), ("A", 4, "new2"), ("B", 1, "b")]
    store.refresh(rows.limit(0), spark.createDataFrame([("B",)], "item_id string"))
    assert {r.item_id for r in store.read().collect()} == {"A"} and store.version() == 3


def test_change_feed(spark, tmp_path):
    source = f"{tmp_path}/changes"
    spark.createDataFrame([(1, "A", "refresh"), (2, "B", "remove"), (3, "A", "refresh")], "seq long, item_id string, op string").write.parquet(source)
    store = index_store.IndexStore(spark, f"file://{tmp_path}/index")
    rows = spark.createDataFrame([("A", 0, "a"), ("B", 1, "b"), ("C", 2, "c")], "item_id string, pos long, text string")
    store.rebuild(rows)
    fresh = rows.withColumn("text", F.upper("text"))
    load = lambda ids: fresh if ids is None else fresh.join(ids, "item_id", "left_semi")
    stream = spark.readStream.schema("seq long, item_id string, op string").parquet(source)
    run = stream.writeStream.foreachBatch(changes.apply_changes(store, load)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, store.read().collect())) == [("A", 3, "A"), ("C", 2, "c")]


def test_windows_batch_and_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, 1, start + dt.timedelta(seconds=k)) for k in range(5)] + [(9, 1, start + dt.timedelta(days=2))]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    found = changes.fixed_window(events, "user_id", "ts", "30 seconds", 3, "event_id").orderBy("event_id").collect()
    assert [r.allowed for r in found] == [True, True, True, False, False, True]
    events.write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    run = changes.rejected_counts(stream, "user_id", "ts", "30 seconds", 3).writeStream.outputMode("append").format("memory").queryName("rejected").start()
    run.processAllAvailable()
    run.stop()
    assert [(r.n, r.rejected) for r in spark.table("rejected").collect()] == [(5, 2)]


def test_json_items(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text(json.dumps([{"ID": "1", "Question": "q", "answer": "a", "AlternativeQuestions": ["x"]}]))
    assert tuple(tables.json_items(spark, str(path), 1).first()) == ("1", "q", "a", ["x"], None)
    with pytest.raises(ValueError, match="instead of"):
        tables.json_items(spark, str(path), 490)
    path.write_text(json.dumps([{"id": "1"}]))
    with pytest.raises(ValueError, match="lack"):
        tables.json_items(spark, str(path))


def test_models(spark):
    rows = spark.createDataFrame([("a b",), ("c",)], "t string")
    found = [sum(x * x for x in r[0]) for r in rows.select(models.embedder(models.hashed_vectors)("t")).collect()]
    assert all(abs(x - 1) < 1e-6 for x in found)
    assert models.trim_pair([1] * 6, [2] * 6, 8) == ([1] * 4, [2] * 4) and models.trim_pair([1] * 9, [2], 8) == ([1] * 7, [2])


def test_knowledge_is_below_a_root(spark):
    rows = [("r", None, 1, 2, "home"), ("s", None, 1, 1, "home"), ("x", "r", 2, 0, "page"), ("deep", "x", 3, 0, "base"), ("b2", "r", 2, 1, "base"), ("b1", "s", 2, 9, "base"), ("i1", "b1", 3, 0, "item"), ("i2", "b2", 3, 0, "item"), ("i3", "deep", 4, 0, "item")]
    tree = spark.createDataFrame(rows, "id string, parent_id string, level int, sort_order long, type string")
    assert [r.id for r in tables.knowledge_items(tree, "base", "item").collect()] == ["i1"]
    assert tables.knowledge_items(tree.where("type <> 'base'"), "base", "item").count() == 0
    found = tables.look_up(tree, spark.createDataFrame([("i1",), ("r",), ("none",)], "id string"), "item")
    assert {r.id: r.type for r in found.collect()} == {"i1": "item", "r": None, "none": None}


def test_submissions_are_written_whole_or_not_at_all(spark, tmp_path):
    store = submissions.SubmissionStore(spark, f"file://{tmp_path}/s")
    headers, values = spark.createDataFrame([(1, "f")], "id long, form_name string"), spark.createDataFrame([(1, "k", "v")], "submission_id long, key string, value string")
    assert store.write(1, headers, values) and not store.write(1, headers, values) and store.write(2, headers, values)
    assert store.read("headers", "id long, form_name string").count() == 2 and store.read("values", "key string").count() == 2
    broken = values.withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.write(3, headers, broken)
    assert store.read("headers", "id long, form_name string").count() == 2
    assert store.write(3, headers, values) and store.read("values", "key string").count() == 3


def test_memory_of_responses(spark):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    rows = [("a", at(m)) for m in (0, 10, 24, 38, 52, 59, 61, 90)] + [("b", at(5)), ("b", at(20)), (None, at(1))]
    got = changes.from_memory(spark.createDataFrame(rows, "key string, ts timestamp").repartition(3), "key", "ts").collect()
    hits = {(r.key, (r.ts - at(0)).seconds // 60): r.hit for r in got}
    assert hits == {("a", 0): False, ("a", 10): True, ("a", 24): True, ("a", 38): True, ("a", 52): True, ("a", 59): True, ("a", 61): False, ("a", 90): False, ("b", 5): False, ("b", 20): False}


def test_pairs_for_models():
    assert models.model_ids([5, 0, 7]) == [0, 6, 3, 8, 2] and len(models.model_ids(list(range(1, 2000)))) == 512
    assert models.pair_ids([5], [0, 9]) == [0, 6, 2, 2, 3, 10, 2] and len(models.pair_ids(list(range(600)), [1, 2])) == 512
    vectors = np.array([[[1.0, 3.0], [3.0, 5.0], [9.0, 9.0]]])
    assert models.mean_pool(vectors, np.array([[1, 1, 0]])).tolist() == [[2.0, 4.0]]


def test_upward_walk_and_circles(spark):
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent_id string")
    assert {(r.id, r.above, r.distance) for r in content.ancestors_or_self(tree, tree.where("id = 'c'")).collect()} == {("c", "c", 0), ("c", "b", 1), ("c", "a", 2)}
    with pytest.raises(ValueError, match="circle"):
        content.ancestors_or_self(spark.createDataFrame([("a", "b"), ("b", "a")], tree.schema), tree.where("id = 'a'"))


def test_a_cluster_without_a_shared_folder_raises(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: "spark://host:7077" if key == "spark.master" else default)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_path(Session, "x")
