"""Questions from templates, and how diverse a set of questions is."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# Question templates by task, subtype and format.
PROGRAMS = (
    ("BP", "PRODUCT_IDENTITY", "grounded_question", "What product is presented in the video?"),
    ("BP", "ATTRIBUTE_AND_VARIANT", "grounded_question", "What product attribute or variant is presented?"),
    ("BP", "QUANTITY_AND_BUNDLE", "grounded_question", "What quantity or bundle is included in the presented offer?"),
    ("BP", "PRICE_AND_DISCOUNT", "grounded_question", "What price or discount is explicitly presented?"),
    ("BP", "OFFER_CONDITION", "grounded_question", "What condition is required for the presented offer?"),
    ("BP", "USAGE_STEP", "grounded_question", "What concrete product-use step is shown?"),
    ("BP", "DEMONSTRATED_STATE_CHANGE", "grounded_question", "What visible state change is demonstrated?"),
    ("BP", "USAGE_SCENARIO", "grounded_question", "What usage scenario is presented for the product?"),
    ("CM", "CLAIM_DEMONSTRATION_STATUS", "grounded_question", "How does the cited visual content relate to the spoken product claim?"),
    ("SS", "PROCESS_DEMONSTRATION", "grounded_question", "What does the product demonstration show, and how is it used in the sales presentation?"),
    ("AE", "USAGE_CONTEXT", "grounded_question", "What usage context represented by the content is connected to the product?"),
    ("BP", "COUNT_SPATIAL", "direct_question", "How many {subject} are visible in the video?"),
    ("BP", "ACTION", "direct_question", "What observable action involving {subject} occurs in the video?"),
    ("BP", "ENTITY_ATTRIBUTE", "direct_question", "What is the {predicate} of the {subject} shown in the video?"),
    ("BP", "OCR_FACT", "direct_question", "According to the on-screen text, what is the {subject}'s {predicate}?"),
    ("BP", "ASR_FACT", "direct_question", "According to the speech, what is stated about the {subject}'s {predicate}?"),
    ("BP", "STATE_CHANGE", "direct_question", "What observable state change happens to the {subject}?"),
    ("BP", "TEMPORAL_ORDER", "direct_question", "In what order do the observable events involving the {subject} occur?"),
    ("CM", "CLAIM_EVIDENCE_RELATION", "relation_choice", "How does the visual or textual evidence relate to the claim that {claim}?"),
    ("CM", "CLAIM_PARTIAL_SUPPORT", "supported_missing", "Which visible evidence supports or fails to support the claim that {claim}?"),
    ("CM", "TEXT_VISUAL_CONSISTENCY", "relation_choice", "Are the speech or on-screen text consistent with the visual content?"),
)
# What stands for a name that an item lacks, words that are written small, and where an answer is looked for.
DEFAULTS = {"subject": "target object", "predicate": "observable attribute", "claim": "the stated claim", "mechanism": "the mechanism"}
SMALL = ("product", "video", "brand", "method", "platform", "color", "type", "feature", "price", "title", "name", "count", "action")
ANSWER_KEYS = {"CM": ("answer", "relation"), "BP": ("action", "count", "value", "answer"), "SS": ("answer", "label", "strategy", "mechanism"), "AE": ("answer", "audience_need", "usage_context", "decision_state", "content_motivation")}
_NAME = re.compile(r"\{(\w+)\}")


def program_table(spark: SparkSession, programs: tuple[tuple[str, str, str, str], ...] = PROGRAMS) -> DataFrame:
    """task_type, task_subtype, question_format, parts: each template as texts and names in turn."""
    rows = []
    for task, subtype, form, template in programs:
        pieces = _NAME.split(template)
        rows.append((task, subtype, form, [(p, None) if i % 2 == 0 else (None, p) for i, p in enumerate(pieces) if i % 2 or p]))
    return spark.createDataFrame(rows, "task_type string, task_subtype string, question_format string, parts array<struct<words:string,name:string>>")


def answer_of(task: Column, values: Column) -> Column:
    """The first of the task's keys with a value that is not empty, else the value of the first key by name, else empty."""
    found = None
    for t, names in ANSWER_KEYS.items():
        first = F.coalesce(*[F.nullif(F.try_element_at(values, F.lit(n)), F.lit("")) for n in names])
        found = F.when(task == t, first) if found is None else found.when(task == t, first)
    return F.coalesce(found, F.try_element_at(values, F.array_min(F.map_keys(values))), F.lit(""))


def rendered_questions(items: DataFrame, programs: DataFrame) -> DataFrame:
    """items with question_program_id, question and answer.

    items: task_type, task_subtype, question_format, target and gold_value (JSON objects; null is empty). A name stands for the answer's value of it, else the
    target's, else its default. An item without a template, and a name without any value, are errors at run time that name them. The programs are a
    small table (a row for each template) and are broadcast.
    """
    values = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    key = ["task_type", "task_subtype", "question_format"]
    met = items.withColumns({"_t": values("target"), "_g": values("gold_value")}).join(F.broadcast(programs.select(*key, "parts")), key, "left")
    default = F.create_map(*[F.lit(x) for pair in DEFAULTS.items() for x in pair])

    def said(name: Column) -> Column:
        own = F.when(F.map_contains_key("_g", name), F.coalesce(F.try_element_at(F.col("_g"), name), F.lit("None"))).when(F.map_contains_key("_t", name), F.coalesce(F.try_element_at(F.col("_t"), name), F.lit("None")))
        value = F.coalesce(own, F.try_element_at(default, name))
        small = name.isin("subject", "predicate") & F.lower(value).isin(*SMALL)
        return F.when(value.isNull(), F.raise_error(F.concat(F.lit("no value for "), name))).when(small, F.lower(value)).otherwise(value)

    program = F.concat_ws("|", *key)
    whole = F.array_join(F.transform("parts", lambda p: F.when(p["name"].isNull(), p["words"]).otherwise(said(F.coalesce(p["name"], F.lit("subject"))))), "")
    question = F.when(F.col("parts").isNull(), F.raise_error(F.concat(F.lit("no question program for "), program))).otherwise(whole)
    return met.select(*items.columns, program.alias("question_program_id"), question.alias("question"), answer_of(F.col("task_type"), F.col("_g")).alias("answer"))


def evidence_groups(records: DataFrame) -> DataFrame:
    """evidence_key, n, n_tasks, n_stems: questions (question, task_type, evidence_refs) by their set of evidence; blank ids and records without any are left out.

    The key is a digest of the sorted set, so neither the order of references nor the size of the set matters, and groups are counted without being gathered.
    """
    refs = F.array_sort(F.filter(F.transform(F.coalesce("evidence_refs", F.array().cast("array<string>")), text.clean), lambda x: x != ""))
    keyed = records.select(F.sha2(F.to_json(refs), 256).alias("evidence_key"), F.size(refs).alias("_n"), text.clean(F.col("task_type")).alias("task"), text.question_stem(F.col("question")).alias("stem")).filter("_n > 0")
    return keyed.groupBy("evidence_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("task").alias("n_tasks"), F.count_distinct("stem").alias("n_stems"))


def diversity(records: DataFrame) -> DataFrame:
    """One row: questions, repeated ones, the largest share of one stem, and sets of evidence that several tasks use (with several questions). Empty tables give zeros."""
    stems = records.groupBy(text.question_stem(F.col("question")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    share = F.coalesce(F.try_divide(F.max("n").cast("double"), F.sum("n")), F.lit(0.0))
    counts = stems.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("question_count"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicate_count"), F.round(share, 6).alias("max_stem_share"))
    groups = evidence_groups(records).agg(F.count_if(F.col("n_tasks") > 1).alias("cross_task_reuse_count"), F.count_if((F.col("n_tasks") > 1) & (F.col("n_stems") > 1)).alias("non_marginal_reuse_count"))
    return counts.join(F.broadcast(groups))  # one row each
