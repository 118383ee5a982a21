"""More operators applied to the driver's tables: knowledge items, pools, administration, submissions, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import fields, models, scores, text
from quern.operators import administration, content, corpus, decide, fusion, index_store, metrics, ranking, submissions
from quern.plans import catalogue
from quern.plans.catalogue import benchmark_questions, conversation_candidates, mixed_candidates, mixed_questions, shown, vector_candidates, vector_questions
from quern.sources import tables
from quern.sources.tables import kept, knowledge_items, look_up, parquet, shared_path
from quern.streaming import changes

QUERIES: dict[str, catalogue.Query] = {}


def query(fn: catalogue.Query) -> catalogue.Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def knowledge_scan(spark: SparkSession, d: str) -> DataFrame:
    """The customers below the first nation of the first region, cleaned; some are blank, some of another kind."""
    items = knowledge_items(catalogue._tree(spark, d), "nation", "customer").select("id")
    texts = parquet(spark, d, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("question"),
        F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("answer"),
        F.array(F.lit(" "), F.concat("c_mktsegment", F.lit(" ")), "c_mktsegment", F.lit(None).cast("string")).alias("alternative_questions"),
        F.when(F.col("c_custkey") % 2 == 0, " CLARIFICATION ").alias("kind"),
    )
    return corpus.clean_items(texts.join(items, "id")).withColumn("alternative_questions", F.array_join("alternative_questions", "|"))


@query
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    nodes = catalogue._tree(spark, d)
    wanted = nodes.where("level > 2").select("id").unionByName(spark.createDataFrame([("x",)], "id string"))
    return look_up(nodes, wanted, "customer").select("id", "url")


def _relevance(spark: SparkSession, d: str) -> DataFrame:
    best = ranking.bm25_top(benchmark_questions(spark, d), conversation_candidates(spark, d), 3)
    said = conversation_candidates(spark, d).select("item_id", "pos", decide.verifier_text(F.lit(" "), F.col("text"), F.col("kind")).alias("read"))
    pairs = best.select("question_id", "item_id", "pos").join(said, ["item_id", "pos"]).join(benchmark_questions(spark, d), "question_id")
    grams = lambda c: text.trigrams(text.normalize(F.col(c)))
    return pairs.withColumn("score", scores.dice(grams("question"), grams("read")))


@query
def relevance_verifier(spark: SparkSession, d: str) -> DataFrame:
    """The pairs that a threshold verifier passes; the share of common trigrams stands for the model's score."""
    rows = _relevance(spark, d)
    return shown(rows.where(decide.above(F.col("score"), 0.2)).select("question_id", "item_id", "score"))


@query
def retrieval_pools(spark: SparkSession, d: str) -> DataFrame:
    rows = decide.pools(*catalogue.mixed(spark, d))
    return shown(rows.select("pool", "question_id", "item_id", "place", "strategies", "rrf"))


@query
def answer_vs_clarification(spark: SparkSession, d: str) -> DataFrame:
    return decide.answer_or_clarification(mixed_questions(spark, d), mixed_candidates(spark, d))


@query
def answer_top3(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.evidence(*catalogue.mixed(spark, d), 3, corpus.ANSWER)
    return shown(decide.projected(rows, 3))


@query
def answer_no_match_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The best semantic score of the answers, and the ranks and scores that it comes from."""
    rows = fusion.evidence(*catalogue.mixed(spark, d), 3, corpus.ANSWER)
    gate = decide.no_match_gate(rows).select("question_id", "best_score")
    return shown(rows.select("question_id", "item_id", "semantic_rank", "semantic_score").join(gate, "question_id"))


def _seeded(spark: SparkSession, d: str) -> DataFrame:
    """Customers as seeded items of the nations."""
    return parquet(spark, d, "customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.concat("c_mktsegment", F.lit("-"), "c_custkey").alias("name"),
        F.col("c_custkey").alias("sort_order"), (F.col("c_acctbal") > 0).alias("published"), (F.col("c_custkey") % 7 != 0).alias("publishable"),
    )


@query
def paged_children(spark: SparkSession, d: str) -> DataFrame:
    """The first two pages of five children, and the first page of the size in use."""
    nodes = _seeded(spark, d)
    pages = [administration.paged_children(nodes, "n3", "Machinery", *page).select("id", "name", F.lit(f"{page}").alias("page")) for page in ((0, 5), (1, 5), (0, 1000))]
    return reduce(DataFrame.unionByName, pages)


@query
def seed_status(spark: SparkSession, d: str) -> DataFrame:
    nodes = _seeded(spark, d)
    parts = [administration.status_report(nodes, f"n{k}", "building").withColumn("parent_id", F.lit(f"n{k}")) for k in range(3)]
    return reduce(DataFrame.unionByName, parts)


@query
def seed_report(spark: SparkSession, d: str) -> DataFrame:
    nodes = _seeded(spark, d)
    return administration.seed_report(nodes.where("published"), nodes.withColumn("name", F.lower("name")), "name")


@query
def guarded_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Of two parents with one such child each, one loses it; two others without as many keep theirs."""
    nodes = _seeded(spark, d)
    one = nodes.where("id in ('c1', 'c2', 'c3')").withColumn("parent_id", F.concat(F.lit("p"), F.substring("id", 2, 1))).withColumn("name", F.lit("Seed x"))
    cleaned = administration.guarded_cleanup(one, "p1", "p2", "seed ", 1)
    kept_all = administration.guarded_cleanup(nodes, "n1", "n2", "building", 1)
    return cleaned.unionByName(kept_all).select("id", "parent_id")


@query
def stored_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    digest = F.md5("p_name")
    name = F.when(k == 0, F.concat(digest, F.lit(".pdf"))).when(k == 1, F.concat(F.upper(digest), F.lit(".PDF"))).when(k == 2, F.concat(F.lit("../"), digest, F.lit(".pdf")))
    return parquet(spark, d, "part").select("p_partkey", submissions.stored_name_ok(name).alias("ok"))


@query
def file_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether a name and its bytes are a PDF, and whether a hidden field was left empty."""
    body = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("%PDF-"), "p_name")).otherwise(F.col("p_name")).cast("binary")
    path = F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, ".PDF").otherwise(".doc"))
    hidden = F.when(F.col("p_size") > 25, " ").when(F.col("p_size") > 10, F.col("p_brand"))
    return parquet(spark, d, "part").select("p_partkey", submissions.pdf_ok(path, body).alias("pdf"), submissions.not_trapped(hidden).alias("open"))


@query
def form_definitions(spark: SparkSession, d: str) -> DataFrame:
    names = ("job_interest_form", " contact_form ", "product_demo_form", "consult_form", " CONTACT_FORM")
    form = fields.by_position((F.col("c_custkey") % 6).cast("int"), names, "")
    return parquet(spark, d, "customer").select("c_custkey", submissions.form_definition(form).alias("f")).select("c_custkey", "f.*")


@query
def submission_write(spark: SparkSession, d: str) -> DataFrame:
    """Customers as one batch of headers with new ids and values; the batch comes twice and counts once."""
    rows = submissions.with_ids(parquet(spark, d, "customer"), 1000, "c_custkey")
    rows = kept(rows.select("id", "c_custkey", "c_name", "c_mktsegment"), shared_path(spark, "numbered"))
    headers = rows.select("id", F.lit("consult_form").alias("form_name"))
    values = submissions.unpivot_values(rows.withColumn("fullname", F.col("c_name")), "id", {"fullname": "fullname", "message": "c_mktsegment"})
    store = submissions.SubmissionStore(spark, shared_path(spark, "submissions"))
    for _ in range(2):
        store.write(7, headers, values)
    back = store.read("headers", "id long, form_name string").join(store.read("values", "submission_id long, key string, value string"), F.col("id") == F.col("submission_id"))
    return back.select("id", "form_name", "key", "value")


@query
def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """The last relevant change of each user."""
    rows = parquet(spark, d, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("op"), F.col("event_id").alias("seq"), (F.col("event_id") % 16).alias("flags"))
    return changes.last_changes(changes.relevant(rows))


@query
def response_memory(spark: SparkSession, d: str) -> DataFrame:
    rows = parquet(spark, d, "events").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    return changes.from_memory(rows, "user_id", "ts", 12 * 3600, 24 * 3600).select("event_id", "hit")


@query
def index_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """An index built, refreshed with changed and without removed items, and read back."""
    store = index_store.IndexStore(spark, shared_path(spark, "index"))
    index = conversation_candidates(spark, d)
    number = F.col("item_id").cast("long")
    store.rebuild(index)
    store.refresh(index.where(number % 4 == 0).withColumn("text", F.concat("text", F.lit(" (new)"))), index.where(number % 4 == 1).select("item_id"))
    rows = store.read() if store.ready() else index.limit(0)
    return rows.select("item_id", "text", "kind")


@query
def latest_news(spark: SparkSession, d: str) -> DataFrame:
    """Orders of customers that were taken away stand below no root."""
    nodes = catalogue._tree(spark, d).where("not (type = 'customer' and sort_order % 4 = 0)")
    return content.latest(content.below_roots(nodes), "order", 5).select("id", "create_date")


@query
def home_products(spark: SparkSession, d: str) -> DataFrame:
    return content.in_order(content.below_roots(catalogue._tree(spark, d)), "customer", 20).select("id", "sort_order")


@query
def first_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings at several depths: the first in document order stands deeper, under the first region, than others under later regions."""
    settings = "(type = 'nation' and parent_id <> 'r0') or (type = 'customer' and sort_order % 3 = 1)"
    nodes = catalogue._tree(spark, d)
    return content.first_of(nodes.withColumn("type", F.when(F.expr(settings), "settings").otherwise(F.col("type"))), "settings").select("id", "url")


@query
def document_order(spark: SparkSession, d: str) -> DataFrame:
    return content.document_order(catalogue._tree(spark, d)).select("id", "place", "last")


@query
def ancestor_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every customer with itself and all above it."""
    nodes = catalogue._tree(spark, d)
    return content.ancestors_or_self(nodes, nodes.where("type = 'customer'"))


@query
def sitemap_lines(spark: SparkSession, d: str) -> DataFrame:
    return content.sitemap_xml(content.sitemap(catalogue._tree(spark, d)))


@query
def sitemap_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the tree, 5,000 entries each: entries and a digest of each file."""
    path = shared_path(spark, "sitemap")
    content.write_sitemap(catalogue._tree(spark, d), path, "https://x.example.com", 5000)
    files = spark.read.text(f"{path}/urls", wholetext=True)
    return files.select(F.col("file").cast("long").alias("file"), (F.size(F.split("value", "<url>")) - 1).alias("entries"), F.md5("value").alias("digest"))


@query
def category_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = parquet(spark, d, "part").select("p_partkey", F.col("p_type").alias("category"))
    parts = [rows.where(content.in_category(c)).groupBy("category").agg(F.count("*").alias("n")).withColumn("selected", F.lit(c)) for c in ("all", "ECONOMY")]
    return parts[0].unionByName(parts[1])


@query
def portal_cards(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    blocks = parquet(spark, d, "nation").select(
        n.alias("pos"), F.when(n % 3 == 0, F.lit(None).cast("boolean")).otherwise(n % 3 == 1).alias("visible"), F.when(n % 4 == 0, " ").otherwise(F.col("n_name")).alias("title"),
        F.lit(None).cast("string").alias("text"), F.when(n % 2 == 0, "Go").alias("button"), F.when(n % 5 == 0, "star").alias("icon"),
    )
    return content.cards(blocks, "Portal", "Services", "View", ("user", "box", "chat", "file"), "link")


@query
def contact_items(spark: SparkSession, d: str) -> DataFrame:
    """Visible items with a value, and default rows only where the source itself has none."""
    n = F.col("s_suppkey")
    rows = parquet(spark, d, "supplier").select(n.alias("pos"), F.when(n % 3 == 0, F.lit(None).cast("boolean")).otherwise(n % 3 == 1).alias("visible"), F.when(n % 4 == 0, " ").otherwise(F.col("s_name")).alias("value"))
    shown_rows = content.visible(rows, "visible", "value").select("pos", "value")
    default = spark.createDataFrame([(-1, "call us")], "pos long, value string")
    return content.or_defaults(rows, shown_rows, default).unionByName(content.or_defaults(rows.limit(0), shown_rows.limit(0), default))


@query
def field_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    blank = F.when(k % 3 == 0, " ").otherwise(F.col("c_name"))
    return parquet(spark, d, "customer").select(
        "c_custkey", fields.trim_to(F.concat(F.lit("  "), blank), 12, "none").alias("trimmed"), fields.form_name(F.when(k % 4 == 0, " contact_form ").when(k % 4 == 1, "job_interest_form").when(k % 4 == 2, "Product_Demo_Form").otherwise(blank)).alias("form"),
        fields.joined_parts(blank, F.lit(""), F.col("c_mktsegment")).alias("joined"), fields.clamped(F.when(k % 4 != 0, F.col("c_acctbal")), 0.0, 5000.0, 100.0).alias("clamped"),
        F.coalesce(fields.non_blank(blank), F.col("c_mktsegment")).alias("first"), fields.by_position((k % 4).cast("int"), ("a", "b"), "z").alias("icon"), fields.page_title("Customer", blank, F.col("c_mktsegment")).alias("title"),
    )


@query
def media_urls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    urls = F.when(k % 3 != 0, F.array(F.lit(" "), F.when(k % 3 == 1, F.col("url")), F.lit(None).cast("string")))
    return parquet(spark, d, "pages").select("page_id", F.array_join(content.media_or(urls, ["/a.mp4", "/b.mp4"]), ",").alias("urls"))


@query
def date_texts(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "orders").select("o_orderkey", fields.ymd(F.col("o_orderdate")).alias("day"))


@query
def session_expiry(spark: SparkSession, d: str) -> DataFrame:
    """A JSON reply with a local time ahead, behind, malformed or missing, and the expiry read from it."""
    k = F.col("event_id") % 4
    local = F.date_format(fields.iran_time(F.col("ts")) + F.expr("interval 2 hours"), "yyyy-MM-dd HH:mm:ss")
    stated = F.when(k == 0, local).when(k == 1, F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss")).when(k == 2, "soon")
    rows = parquet(spark, d, "events").select("event_id", "ts", fields.as_json(ExpireDateTime=stated, user=F.col("user_id")).alias("reply"))
    return rows.select("event_id", "reply", fields.stated_expiry(F.col("reply"), "expiredatetime", F.col("ts")).alias("expires"))


@query
def group_access(spark: SparkSession, d: str) -> DataFrame:
    groups = F.when(F.col("c_custkey") % 9 != 0, F.array(F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 10 == 0, "admin").otherwise("guest")))
    return parquet(spark, d, "customer").select("c_custkey", fields.may_access(groups, ("building", "machinery")).alias("allowed"))


@query
def metrics_difference(spark: SparkSession, d: str) -> DataFrame:
    rows = parquet(spark, d, "events")
    before = rows.where((F.col("ts") < F.timestamp_seconds(F.lit(1705276800))) & (F.col("event_type") != "click"))
    return shown(metrics.difference(metrics.totals(rows, "event_type", "value", "ts", "event_id"), metrics.totals(before, "event_type", "value", "ts", "event_id"), "event_type"))


CALLS = ("click", "error", "purchase", "view")


@query
def observed_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls counted while the rows are written to another table; one type is not named and counts as other."""
    rows, watch = metrics.observed(parquet(spark, d, "events"), "event_type", "value", CALLS)
    kept(rows, shared_path(spark, "calls"))
    return shown(spark.createDataFrame(metrics.counted(watch.get, CALLS), "event_type string, n long, total double, largest double"))


@query
def failed_build(spark: SparkSession, d: str) -> DataFrame:
    """An index whose second build fails on one row: the first stays; and one whose only build fails: not ready."""
    index = conversation_candidates(spark, d)
    broken = index.withColumn("text", F.when(F.col("pos") % 7 == 0, F.raise_error(F.lit("no embedding")).cast("string")).otherwise(F.col("text")))
    good, bad = (index_store.IndexStore(spark, shared_path(spark, "index")) for _ in range(2))
    built = [good.build(lambda: index), good.build(lambda: broken), bad.build(lambda: broken)]
    states = good.read().select("item_id", "pos", "text").withColumn("built", F.lit(f"{built} {good.ready()} {bad.ready()}"))
    return states


@query
def no_limit_no_rows(spark: SparkSession, d: str) -> DataFrame:
    """Limits of 0 and below give nothing, a limit of one the best."""
    asks, some = vector_questions(spark, d), vector_candidates(spark, d)
    parts = [ranking.semantic_top(asks, some, k).withColumn("k", F.lit(k)) for k in (-1, 0, 1)]
    return shown(reduce(DataFrame.unionByName, parts).select("k", "question_id", "rank", "item_id", "pos"))


@query
def feed_operations(spark: SparkSession, d: str) -> DataFrame:
    """Changes of customers, nations and orders that are gone, as operations on an index of customers below nations."""
    k = F.col("event_id")
    name = F.when(k % 5 == 0, F.concat(F.lit("n"), F.col("user_id") % 25)).when(k % 5 == 1, F.concat(F.lit("x"), "user_id")).otherwise(F.concat(F.lit("c"), F.col("user_id") % 100))
    rows = parquet(spark, d, "events").select(F.when(k % 11 != 0, name).alias("item_id"), k.alias("seq"), (k % 16).alias("flags"))
    return changes.last_changes(changes.operations(rows, catalogue._tree(spark, d), "nation", "customer"))


@query
def json_items(spark: SparkSession, d: str) -> DataFrame:
    """Customers as a JSON file of items with property names in other cases, read back."""
    rows = parquet(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("ID"), F.col("c_name").alias("Question"), F.col("c_mktsegment").alias("ANSWER"), F.array("c_name", "c_mktsegment").alias("AlternativeQuestions"))
    path = shared_path(spark, "items")
    rows.write.json(path)
    found = tables.json_items(spark, path, multi_line=False)
    return found.withColumn("alternative_questions", F.array_join("alternative_questions", "|"))


@query
def missing_properties(spark: SparkSession, d: str) -> DataFrame:
    """Names that a form requires and a row lacks, whatever their case."""
    k = F.col("c_custkey")
    present = F.array_compact(F.array(F.lit("FullName"), F.when(k % 2 == 0, "MOBILE"), F.when(k % 3 == 0, "message")))
    return parquet(spark, d, "customer").select("c_custkey", F.array_join(tables.missing_names(present, ("fullname", "mobile", "Message")), ",").alias("missing"))


@query
def pair_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Ids of questions with their best conversations, as a relevance model reads them, by a public vocabulary of pieces."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        tokenize = models.piece_tokenizer(file.read())
    rows = _relevance(spark, d)
    return rows.select("question_id", "item_id", tokenize("question", "read").alias("ids"))
