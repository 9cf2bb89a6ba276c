"""Queries that bind the operators to the driver tables. Each has a SQL twin in oracles.py."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import nested, numbers, text
from ..operators import aggregates, joins, rules, windows
from ..sources import scans
from ..sources.scans import table
from . import draft_queries, evidence, graph_queries, item_queries, pipelines, reply_queries, review_queries, run_queries, staged_queries


def rank_quality_report(spark, d):
    """Documents banded by length tertiles, labels joined with missing as 0, scored by band with micro and macro."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.length(text.clean(F.col("text"))).alias("n"))
    cuts = aggregates.quantiles(docs, "n", [1 / 3, 2 / 3], ["q33", "q67"])
    banded = aggregates.with_global(docs, cuts).withColumn("band", numbers.tertile_band(F.col("n"), F.col("q33"), F.col("q67")))
    scored = joins.scored_or_missing(banded, table(spark, d, "labels").withColumn("quality", F.col("quality").cast("double")), "doc_id", "quality")
    return aggregates.score_report(scored.withColumn("judged", F.lit(True)).withColumn("task", F.concat_ws("/", "lang", "band")), "task", "quality", "judged")


def text_features(spark, d):
    # trimmed and bare forms are columns of their own, made once for each text
    docs = table(spark, d, "documents").select("doc_id", "text", text.clean(F.col("text")).alias("t"), text.bare(F.col("text")).alias("b"))
    t, b = F.col("text"), F.col("b")
    return docs.select(
        "doc_id", F.length("t").alias("n_clean"), F.length(F.regexp_replace("t", r"(?U)\s+", " ")).alias("n_normal"), text.contains_cjk(t).alias("cjk"), F.length(b).alias("n_bare"),
        text.sentences_in(F.col("t")).alias("n_sentences"), text.count_of(t, "[?？]").alias("n_questions"), text.count_of(t, "[!！]").alias("n_calls"), text.count_of(t, r"[.,;:!?]").alias("n_signs"),
        text.any_in_bare(b, ("license", "token")).alias("has_keyword"), text.count_in_bare(b, ("the", "ing")).alias("n_keywords"),
    )


def ngram_jaccard(spark, d):
    """Bigram Jaccard index of each conversation turn with the next."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    nxt = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.withColumn("next_text", F.lead("text").over(nxt)).filter("next_text IS NOT NULL")
    grams = pairs.select("conv_id", "turn", text.char_ngrams(F.col("text")).alias("a"), text.char_ngrams(F.col("next_text")).alias("b"))
    return grams.select("conv_id", "turn", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("index"))


def question_stems(spark, d):
    """Stems of user turns: repetition, cluster sizes and share."""
    stems = table(spark, d, "conversations").filter("role = 'user'").select(text.question_stem(F.col("text")).alias("stem"))
    sizes = stems.groupBy("stem").agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size").alias("total"))
    return aggregates.with_global(sizes, total).select("stem", "size", (F.col("size") > 1).alias("duplicate"), aggregates.rounded_ratio(F.col("size"), F.col("total")).alias("share"))


def tagged_answers(spark, d):
    t = table(spark, d, "conversations").filter("role = 'assistant'")
    made = t.select("conv_id", "turn", F.concat(F.lit("x <Answer>"), F.col("text"), F.lit("</ANSWER> y")).alias("reply"), "text")
    return made.select("conv_id", "turn", F.md5(text.tagged_answer(F.col("reply"))).alias("inside"), F.md5(text.tagged_answer(F.col("text"))).alias("whole"), F.md5(text.safe_segment(F.col("text"))).alias("segment"), text.slug(F.concat_ws("/", "conv_id", "turn")).alias("slug"))


def parsed_numbers(spark, d):
    # sizes are few, so what they are written as is parsed once each; prices are the row's own
    p, s = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), F.col("p_size").cast("string")
    forms = {"percent": F.concat(s, F.lit("%")), "wan": F.concat(s, F.lit("w")), "kilo": F.concat(s, F.lit(" K")), "span": F.concat(s, F.lit("~"), s.cast("int") + 2), "half": F.concat(F.lit("x~"), s), "missing": F.lit("N/A"), "exponent": F.concat(s, F.lit("e3"))}
    number = lambda name, c: F.round(numbers.parse_number(c), 6).alias(name)
    sized = joins.by_distinct(p, ["p_size"], [number(name, c) for name, c in forms.items()])
    return sized.select("p_partkey", number("price", F.format_number("p_retailprice", 2)), *forms)


def order_dates(spark, d):
    # days and shares of a day are few, so each is written and parsed once
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"), F.pmod("o_orderkey", F.lit(96)).alias("q"))
    day, slashed = F.date_format("date", "yyyy-MM-dd"), F.date_format("date", "yyyy/MM/dd")
    serial = F.datediff(F.col("date"), F.lit("1899-12-30").cast("date")).cast("string")
    dated = joins.by_distinct(o, ["date"], [numbers.iso_week(day).alias("week"), numbers.parse_date(slashed).alias("written"), numbers.parse_date(serial).alias("counted"), numbers.parse_date(F.lit("soon")).alias("other")])
    return joins.by_distinct(dated, ["q"], [numbers.parse_time((F.col("q") / 96).cast("string")).alias("clock")]).drop("date", "q")


def number_expressions(spark, d):
    li = table(spark, d, "lineitem")
    x = F.col("l_extendedprice")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum(numbers.ratio(F.col("l_tax"), F.col("l_discount"), 0.0)), 4).alias("ratios"), F.round(F.sum(numbers.clamp(F.col("l_discount"), 0.02, 0.08)), 4).alias("clamped"),
        F.round(F.sum(numbers.log1p_or_zero(x)), 3).alias("logs"), F.count_if(numbers.duration_bucket(F.col("l_quantity")) == "<=30").alias("short"), F.round(F.sum(numbers.confidence(F.col("l_quantity").cast("string"))), 4).alias("confidences"),
    )


def quartile_segments(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    cuts = aggregates.quantiles(c, "c_acctbal", [0.25, 0.5, 0.75, 0.05, 0.95], ["a", "b", "c", "p5", "p95"])
    x = F.col("c_acctbal")
    return aggregates.with_global(c, cuts).select("c_custkey", numbers.quartile_label(x, [F.col("a"), F.col("b"), F.col("c")], ("tail", "waist", "shoulder", "head")).alias("segment"), numbers.rate_band(x, F.col("a"), F.col("c")).alias("rate"), F.round(numbers.robust_scale(x, F.col("p5"), F.col("p95")), 6).alias("scaled"))


def judge_scores(spark, d):
    """Every event's number as one of the 125 score triples: snapped, capped, allowed."""
    digit = lambda n: F.element_at(F.array(*[F.lit(a) for a in numbers.ALLOWED_SCORES]), (F.floor(F.col("event_id") / n) % 5).cast("int") + 1)
    triples = table(spark, d, "events").select("event_id", digit(1).alias("c"), digit(5).alias("g"), digit(25).alias("k"))
    return triples.select("event_id", numbers.judge_score(F.col("c"), F.col("g"), F.col("k")).alias("score"), numbers.allowed_score(F.col("c") + 0.1).alias("off"))


def frame_grid(spark, d):
    v = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("duration"))
    return v.select("p_partkey", F.posexplode(numbers.frame_grid(F.col("duration"))).alias("frame_index", "timestamp_s"))


def content_ids(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", nested.content_id("ord", 12, priority=F.col("o_orderpriority"), customer=F.col("o_custkey"), note=F.lit(None).cast("string")).alias("id"))


def event_json(spark, d):
    e = table(spark, d, "events")
    fenced = F.concat(F.lit("reply:\n```json\n"), F.col("props"), F.lit("\n```"))
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.get_json_object(nested.lenient_object(fenced), "$.k").cast("bigint").alias("found"), nested.strict_reason(F.col("props"), "k").alias("strict"), nested.strict_reason(fenced, "k").alias("lead"), nested.strict_reason(F.expr("substring(props, 2)"), "k").alias("broken"), nested.strict_reason(F.col("props"), "other").alias("other"), nested.has_private_key(F.concat(F.lit('{"likes": 1, "x": '), "props", F.lit("}"))).alias("private"))


def public_documents(spark, d):
    out = nested.public(table(spark, d, "documents").withColumn("Likes", F.lit(1)).withColumn("followers", F.lit(2)))
    nested.assert_public(out)
    return out.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def scored_labels(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels").withColumn("quality", F.col("quality").cast("double"))
    return joins.scored_or_missing(docs, labels, "doc_id", "quality").select("doc_id", "lang", "quality", "missing")


def score_blocks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return aggregates.score_report(docs.withColumn("score", F.col("quality").cast("double")).withColumn("judged", F.col("score").isNotNull()), "lang", "score", "judged")


def line_closure(spark, d):
    """Reference closure of lineitem: orders, parts, suppliers, with owners where both sides have one."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(cust, "o_custkey").select("o_orderkey", "nation")
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, d, "part").select("p_partkey", F.lit(0).alias("owner"))
    li = li.withColumn("l_partkey", F.when(F.col("l_partkey") % 50 == 0, -1 - F.col("l_partkey")).otherwise(F.col("l_partkey")))  # some references are lost
    owned = li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
    return joins.closure(owned, "l_suppkey", "nation", supplier, "s_suppkey", "s_nationkey", "supplier").unionByName(joins.closure(li.withColumn("owner", F.lit(0)), "l_partkey", "owner", part, "p_partkey", "owner", "part"))


def ordered_lines(spark, d):
    """Line numbers of each order, in the order asked (last first); unknown lines fall out."""
    li = table(spark, d, "lineitem")
    asked = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_linenumber")), False).alias("ids"))
    asked = asked.select("l_orderkey", F.transform("ids", lambda i: F.concat_ws("-", F.col("l_orderkey").cast("string"), i.cast("string"))).alias("ids"))
    members = li.groupBy(F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") == 2, "lost").otherwise("-"), F.col("l_linenumber").cast("string")).alias("mid"), "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    out = joins.ordered_members(asked, "ids", members, "mid", ["l_linenumber", "l_quantity"], "lines", "l_orderkey")
    return out.select("l_orderkey", F.size("lines").alias("n"), F.array_join(F.transform("lines", lambda x: x["l_linenumber"].cast("string")), ",").alias("lines"))


def nearest_events(spark, d):
    """Purchases matched to views of the user within two hours around, else the nearest view."""
    e = table(spark, d, "events").withColumn("s", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double"))
    ranges = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), (F.col("s") - 7200).alias("start"), (F.col("s") + 7200).alias("end"))
    points = e.filter("event_type = 'view'").select("user_id", F.col("s").alias("at"), F.col("event_id").alias("view_id"))
    return joins.in_range_or_nearest(ranges, points, ["user_id"], "start", "end", "at", "view_id", 14400.0).select("purchase_id", "view_id", "link")


def cache_status(spark, d):
    """Translation-like jobs: documents against a cache with some other digests and some gaps."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.sha2("text", 256).alias("digest"))
    cache = docs.select(F.when(F.col("doc_id") % 3 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("digest")).alias("digest"))
    jobs = docs.withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.lit(" ")).otherwise(F.col("text")))
    return joins.lookup_status(jobs, cache, ["doc_id"], "digest", "text").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def spearman_grid(spark, d):
    """Spearman correlation of customer features with order metrics, in every pair."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"), F.log1p("n_orders").alias("n_orders"), F.log1p("spent").alias("spent"))
    x = joins.unpivoted(c, ["c_custkey", "n_orders", "spent"], ["balance", "nation"], "feature", "x")
    long = joins.unpivoted(x, ["c_custkey", "feature", "x"], ["n_orders", "spent"], "metric", "y")
    return aggregates.spearman(long, ["feature", "metric"], "x", "y")


def interaction_strata(spark, d):
    """User interactions by type in log tertiles, and a cohort key."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cuts = aggregates.tertile_thresholds(e, "event_type", "n")
    banded = e.join(cuts, "event_type").withColumn("band", numbers.tertile_band(F.log1p("n"), F.col("q33"), F.col("q67")))
    key = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "band"))), lambda x: F.concat_ws("=", x["event_type"], x["band"]))
    return banded.groupBy("user_id").agg(F.array_join(key, "|").alias("cohort_key"), F.count(F.lit(1)).alias("n_metrics"))


def roc_auc_by_lang(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return aggregates.roc_auc(docs, ["lang"], "n_chars", "quality")


def label_agreement(spark, d):
    """Macro F1 and Brier score of a length rule against the labels."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    docs = docs.withColumn("rule", (F.col("n_chars") > 500).cast("int")).withColumn("p", F.col("n_chars") / 2000.0)
    return aggregates.with_global(aggregates.macro_f1(docs, "quality", "rule"), docs.agg(aggregates.brier(F.col("p"), F.col("quality")).alias("brier")))


def bootstrap_means(spark, d):
    """Intervals of mean prices by priority from 1,000 resamples."""
    return aggregates.bootstrap_interval(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")


def duplicate_conflicts(spark, d):
    """Events of a user and type on a day: repeats of a value, and values other than the first."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % 3).alias("value"))
    return windows.marked_conflicts(e, ["user_id", "event_type", "day"], "value", ["event_id"]).select("event_id", "duplicate", "conflict")


def first_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("key"))
    first, later = windows.keep_first(docs, ["key"], ["doc_id"])
    return first.withColumn("reason", F.lit("KEPT")).unionByName(later)


def hash_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return windows.hash_sample(docs, "lang", "doc_id", 0.1, table(spark, d, "labels").filter("toxic = 1"))


def round_robin(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return windows.round_robin(c, ["c_mktsegment", "c_nationkey"], "c_custkey", 200).select("c_custkey", "c_mktsegment", "c_nationkey", "sweep")


def group_split(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return windows.group_split(docs, "source")


def quota_selection(spark, d):
    """Orders of each customer under quotas by priority and status, dearest first."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", (-F.col("o_totalprice")).alias("rank_key"))
    return windows.quota_select(o, "o_custkey", "o_orderpriority", "o_orderstatus", ["rank_key", "o_orderkey"], most=4).select("o_orderkey", "o_custkey")


def similar_turns(spark, d):
    """User turns of a conversation that are new against the earlier accepted ones."""
    t = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", text.question_stem(F.col("text")).alias("stem"))
    return windows.greedy_distinct(t, "conv_id", ["turn"], "stem").select("conv_id", "turn", "accepted")


def top_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return windows.top_per_group(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


def validated_lines(spark, d):
    """Rule codes of line items, and where each goes."""
    li = table(spark, d, "lineitem")
    codes = rules.issue_codes([("CHALLENGER_REVISE", F.col("l_discount") > 0.09), ("BELOW_MIN_CONFIDENCE", F.col("l_quantity") < 2), ("CONFLICT", F.col("l_tax") > F.col("l_discount") + 0.07)])
    out = li.select("l_orderkey", "l_linenumber", codes.alias("codes")).withColumn("first", F.get("codes", F.lit(0)))
    return out.select("l_orderkey", "l_linenumber", F.array_join("codes", ",").alias("codes"), rules.disposition(F.col("first")).alias("r")).select("l_orderkey", "l_linenumber", "codes", "r.disposition", "r.channel")


def disposition_summary(spark, d):
    v = validated_lines(spark, d)
    return v.agg(aggregates.rounded_ratio(F.count_if(F.col("channel") == "queue"), F.count_if(F.col("channel") != "diagnostics")).alias("ambiguity"), F.count_if(F.col("channel") == "accepted").alias("accepted"), F.count_if(F.col("channel") == "queue").alias("queue"), F.count_if(F.col("channel") == "rejected").alias("rejected"))


def page_assets(spark, d):
    found, other = scans.grouped_assets(table(spark, d, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("url")), "url")
    return found.select("entity_id", "n_paths", F.get("paths", F.lit(0)).alias("first_path")).unionByName(other.agg(F.lit("").alias("entity_id"), F.count(F.lit(1)).cast("int").alias("n_paths"), F.min("path").alias("first_path")))


def category_profile(spark, d):
    """Share of documents with labels, long text and repeated text, by language and source."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), share(F.col("quality").isNotNull()).alias("labelled"), share(F.col("n_chars") > 1000).alias("long"), F.round(F.percentile("n_chars", 0.5), 6).alias("median_chars"))


def task_pivot(spark, d):
    e = table(spark, d, "events")
    kinds = ["click", "error", "purchase", "signup", "view"]
    return e.groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).select("user_id", *[F.coalesce(k, F.lit(0)).alias(f"n_{k}") for k in kinds])


def ordered_ids(spark, d):
    """Each user's number of events, distinct types first seen first, and first id: folded by type before anything is listed."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    seen = e.groupBy("user_id").agg(F.sum("n").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("rows"), F.min("first").alias("first_id"))
    return seen.select("user_id", "n", F.array_join(nested.distinct_texts(F.transform("rows", lambda x: x["event_type"])), ",").alias("types"), "first_id")


def last_rows(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user"), "event_type", "value")
    return joins.last_by_key(e, "user", "event_id").select("user", "event_id", "event_type", F.round("value", 6).alias("value"))


def classified_events(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    kind = rules.first_class(F.col("event_type"), [("money", "purchase|signup"), ("attention", "view|click"), ("money2", "error")], "none")
    return e.select("event_id", kind.alias("kind"), rules.enum_or(F.col("event_type"), ("VIEW", "CLICK"), "OTHER").alias("kept"), rules.strongest(F.array("event_type", F.lit("view")), ("purchase", "view")).alias("strongest"))


def benchmark_leaks(spark, d):
    """Benchmark items whose whole text occurs in a document.

    The first and the last blank-separated piece of an item can be part of a longer word of the document, the pieces between them cannot:
    items are found by the first five of these, and items with fewer are looked for in every document. Both are checked as whole texts.
    """
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("item"), F.split("text", r"\s+").alias("w"))
    key = lambda words, i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(5)), " "))
    long, short = items.filter(F.size("w") >= 7), items.filter(F.size("w") < 7).select("item_id", "item")
    heads = long.select("item_id", key(F.col("w"), F.lit(2)).alias("k"))
    docs = table(spark, d, "documents").select("doc_id", "text", F.split("text", r"\s+").alias("w"))
    grams = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: key(F.col("w"), i)))).alias("k"))
    hits = grams.join(heads, "k").select(F.col("doc_id").alias("_doc"), F.col("item_id").alias("_item")).distinct()
    texts = docs.select("doc_id", "text")
    anchored = hits.join(texts, F.col("_doc").eqNullSafe(F.col("doc_id"))).join(long.select("item_id", "item"), F.col("_item").eqNullSafe(F.col("item_id"))).filter(F.col("text").contains(F.col("item")))
    # without an equality Spark broadcasts few short items, and deals many in blocks (a Cartesian product)
    searched = texts.join(short, F.col("text").contains(F.col("item")))
    checked = anchored.select("item_id", "doc_id").unionByName(searched.select("item_id", "doc_id"))
    return checked.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def model_replies(spark, d):
    """Answers of a deterministic client to user turns, with failures as rows."""
    t = table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", "text")

    def client(rows):
        return [{"conv_id": r["conv_id"], "turn": r["turn"], "n_input": len(r["text"]), "success": len(r["text"]) % 7 != 0} for r in rows]

    return windows.model_calls(t, client, "conv_id bigint, turn bigint, n_input bigint, success boolean")


def candidate_scores(spark, d):
    """Assistant turns scored as candidates: role of the turn as task, text as answer."""
    t = table(spark, d, "conversations").filter("role = 'assistant'")
    score = evidence.candidate_score((F.pmod("conv_id", F.lit(10)) / 10), F.pmod("turn", F.lit(4)), F.pmod("conv_id", F.lit(3)), F.when(F.col("conv_id") % 2 == 0, "BP").otherwise("CM"), F.when(F.col("conv_id") % 4 == 0, "USAGE_SCENARIO").otherwise("OTHER"), F.col("text"), F.pmod("turn", F.lit(5)))
    return t.select("conv_id", "turn", score.alias("score"))


def question_checks(spark, d):
    """All issue codes of turns as questions of the four tasks, some of them altered to break a rule; the first word is the answer."""
    t = table(spark, d, "conversations").withColumn("i", F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(12)))
    first = F.get(F.split("text", " "), F.lit(0))
    question = (
        F.when(F.col("i") == 0, "What is happening?").when(F.col("i") == 1, F.concat("text", F.lit(" 吗?"))).when(F.col("i") == 2, F.concat(F.lit("Is claim_contradicted the "), "text", F.lit("?")))
        .when(F.col("i") == 3, F.concat(F.lit("Who holds up the "), "text", F.lit("?"))).when(F.col("i") == 4, F.concat("text", F.lit("?"))).otherwise(F.col("text"))
    )
    answer = F.when(F.col("i") == 5, "答").when(F.col("i") == 6, F.array_join(F.array_repeat(F.lit("word"), 25), " ")).when(F.col("i") == 7, "see the spec_id").when(F.col("i") == 8, "3 cups").otherwise(first)
    task = F.when(F.col("i") < 9, "BP").otherwise("CM")
    return t.select("conv_id", "turn", F.array_join(evidence.question_issues(task, question, answer), ",").alias("codes"))


def cohort_selection(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return pipelines.cohort(docs, "doc_id", ["lang"], "source", ["5", "17"], 60).select("doc_id", "turn")


def translation_jobs(spark, d):
    conv = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text", "role")
    items = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    jobs = pipelines.translation_jobs([(conv, "turn", "id", ["text", "role"]), (items, "item", "id", ["text"])], "v1")
    return jobs.select("object_type", "object_id", "source_field", "source_sha256", "translation_id")


def token_costs(spark, d):
    prices = spark.createDataFrame([("en", 2.0, 8.0), ("de", 1.0, 4.0)], "model string, input_price double, output_price double")
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("model"), F.col("n_chars").alias("input_tokens"), (F.col("n_chars") % 100).alias("output_tokens"))
    return pipelines.token_cost(docs, prices, "en").select("doc_id", "cost_usd")


def language_flags(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"), "text")
    return pipelines.language_features(docs, "doc_id", "title", "text").select("doc_id", "title_has_cta", "text_has_risk_reduction", "title_question_count", "text_exclamation_count")


def cross_modal(spark, d):
    """Bigram agreement of a document's first line, its whole text and its source."""
    docs = table(spark, d, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.col("text").alias("body"), "source", F.concat_ws("/", "lang", "source").alias("category"))
    return pipelines.cross_modal_features(docs, "doc_id", "title", "body", "source", "category")


def table_fingerprint(spark, d):
    return pipelines.stage_fingerprint(table(spark, d, "orders"), "o_orderkey", "upstream")


ALL = (
    candidate_scores, question_checks, cohort_selection, translation_jobs, token_costs, language_flags, cross_modal, table_fingerprint,
    rank_quality_report, text_features, ngram_jaccard, question_stems, tagged_answers, parsed_numbers, order_dates, number_expressions, quartile_segments, judge_scores, frame_grid,
    content_ids, event_json, public_documents, scored_labels, score_blocks, line_closure, ordered_lines, nearest_events, cache_status, spearman_grid, interaction_strata, roc_auc_by_lang,
    label_agreement, bootstrap_means, duplicate_conflicts, first_documents, hash_sample, round_robin, group_split, quota_selection, similar_turns, top_orders, validated_lines,
    disposition_summary, page_assets, category_profile, task_pivot, ordered_ids, last_rows, classified_events, benchmark_leaks, model_replies,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL + graph_queries.ALL + reply_queries.ALL + item_queries.ALL + draft_queries.ALL + review_queries.ALL + staged_queries.ALL + run_queries.ALL}
