"""Model-backed steps as Spark batch inference (LM-1..5).

The reference calls a hosted chat model twice per meeting. Here the model is
an injected callable ``infer(prompt: str) -> str`` applied with
``mapInPandas`` (one Python worker per task, rows streamed in Arrow
batches); the replies are written to a table first and then parsed, and
what cannot be parsed comes back with its reason. The table is addressed by the
request's hash: equal requests, and those of an earlier run, are sent once.
Without a callable,
an offline analyzer built from Spark expressions stands in: frequent words
as topics, the rule objection, and the 40-word summary.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import summarize
from parley.operators import rules
from parley.session import scratch, stored
from parley.sources.paths import exists

# Words shorter than this are not topic candidates; topics per
# meeting ("the 3 most important topics").
MIN_TOPIC_LETTERS = 4
TOPICS_PER_MEETING = 3
# Matches the ``role: `` label that starts each transcript line.
_ROLE_PREFIX = r"(?m)^[A-Za-z_]+: "

ANALYSIS_DDL = "topics array<string>, fears string, objection string, summary string"


def keyword_topics(transcripts: DataFrame, key: str, n: int = TOPICS_PER_MEETING,
                   min_letters: int = MIN_TOPIC_LETTERS) -> DataFrame:
    """Offline LM-1 topics: the ``n`` most frequent lower-case words of at
    least ``min_letters`` letters (role labels removed), ties by first
    occurrence. Returns ``(key, pos, topic)``.

    Word counts are a hash aggregation on (meeting, word); the top-n is a
    ``row_number`` filter, i.e. a partial ``WindowGroupLimit``."""
    body = F.regexp_replace(F.col("text"), _ROLE_PREFIX, "")
    words = F.regexp_extract_all(F.lower(body), F.lit(rf"[\p{{L}}\p{{M}}]{{{min_letters},}}"), 0)
    w = (transcripts.select(key, F.posexplode(words).alias("at", "word"))
         .groupBy(key, "word").agg(F.count(F.lit(1)).alias("cnt"), F.min("at").alias("first_at")))
    win = Window.partitionBy(key).orderBy(F.col("cnt").desc(), F.col("first_at").asc())
    return (w.withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= n)
            .select(key, (F.col("rank") - 1).cast("bigint").alias("pos"), F.col("word").alias("topic")))


def offline_analysis(transcripts: DataFrame, key: str,
                     words: rules.RuleWords = rules.DEFAULT_WORDS) -> DataFrame:
    """LM-1 without a model: ``(key, analysis struct)`` with topics, empty
    fears, the rule objection and the 40-word summary."""
    topics = (keyword_topics(transcripts, key)
              .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "topic"))).alias("tp")))
    base = transcripts.select(key, "text").join(topics, key, "left")
    return base.select(key, F.struct(
        F.coalesce(F.transform("tp", lambda x: x["topic"]), F.array().cast("array<string>")).alias("topics"),
        F.lit("").alias("fears"),
        rules.detect_objection(F.col("text"), words).alias("objection"),
        summarize(F.col("text")).alias("summary")).alias("analysis"))


# The analysis request (system and user part) given to the model.
ANALYSIS_SYSTEM = """
أنت متخصص في تحليل نصوص الاجتماعات. أعطني فقط JSON منظم.
يجب أن يحتوي على:
topics: قائمة بأهم 3 مواضيع ذكرت
fears: أهم مخاوف العميل
objection: أهم اعتراض
summary: ملخص قصير للاجتماع


- clarity
- need_understanding
- professionalism
- objection_handling
- rapport
- closing_power
 مع  زكر  السبب من الميتسنج او ردود السيلز اللي خلاه ياخد التقييم ده
"""
ANALYSIS_USER_PREFIX = "هذا نص الاجتماع:\n"
ANALYSIS_USER_SUFFIX = "\n\nاستخرج JSON فقط."
#: Fields the later steps read from an analysis.
ANALYSIS_FIELDS = ["topics", "fears", "objection", "summary"]


def analysis_prompts(transcripts: DataFrame, key: str) -> DataFrame:
    """LM-1 prompt text per meeting (pure ``concat``)."""
    return transcripts.select(key, F.concat(F.lit(ANALYSIS_SYSTEM + "\n\n" + ANALYSIS_USER_PREFIX),
                                            F.col("text"), F.lit(ANALYSIS_USER_SUFFIX)).alias("prompt"))


def apply_model(prompts: DataFrame, key: str, infer: Callable[[str], str], concurrency: int = 1) -> DataFrame:
    """Run ``infer`` on every prompt inside the executors (``mapInPandas``);
    returns ``(key, reply, error)``. A failing call yields a NULL reply and
    the error's text; a NULL prompt is not sent.

    Model calls wait on the network, so ``concurrency > 1`` overlaps that
    many calls per task with a thread pool (replies keep their row order).
    Total parallelism is tasks x concurrency; size it to the service's
    rate limit."""
    key_type = dict(prompts.dtypes)[key]

    def call(p):
        if p is None:
            return None, "no prompt"
        try:
            return infer(p), None
        except Exception as e:  # noqa: BLE001 - a failed call is a rejected row
            return None, f"call failed: {type(e).__name__}: {e}"

    def run(batches):
        pool = None
        if concurrency > 1:
            from concurrent.futures import ThreadPoolExecutor
            pool = ThreadPoolExecutor(max_workers=concurrency)
        try:
            for pdf in batches:
                ps = pdf["prompt"].tolist()
                out = list(pool.map(call, ps)) if pool else [call(p) for p in ps]
                yield pd.DataFrame({key: pdf[key], "reply": [r for r, _ in out], "error": [e for _, e in out]})
        finally:
            if pool:
                pool.shutdown()

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {key_type}, reply string, error string")


def reply_problem(reply: Column, error: Column, required: list[str]) -> Column:
    """LM-4: why a reply cannot be used (NULL: it can). The text is checked
    as JSON, so a reply that was cut off is not an object."""
    keys = F.json_object_keys(reply)
    problem = F.when(reply.isNull(), F.coalesce(error, F.lit("no reply"))).when(keys.isNull(), F.lit("not a JSON object"))
    for field in required:
        problem = problem.when(~F.array_contains(keys, field), F.lit(f"missing field: {field}"))
    return problem


# Requests sent between two commits of the reply table.
WAVE = 10_000
_LEDGER = "sha string, attempt int, reply string, error string, reason string"


def reply_ledger(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """Every attempt of a stage kept under ``path``: the request's hash, the
    number of the attempt, the raw reply or error, and the reason why it cannot
    be used (NULL: it can)."""
    folder = f"{path.rstrip('/')}/stage={stage}"
    if not exists(spark, folder):
        return spark.createDataFrame([], _LEDGER)
    return spark.read.schema(_LEDGER).option("recursiveFileLookup", "true").parquet(folder)


def ask(prompts: DataFrame, key: str, infer: Callable[[str], str], path: str, stage: str, required: tuple[str, ...] | list[str] = (),
        attempts: int = 1, concurrency: int = 1, wave: int = WAVE) -> DataFrame:
    """The replies to ``(key, prompt)`` as ``(key, reply, error)``, from the
    reply table under ``path``.

    A request is addressed by the SHA-256 of its stage and text. Requests
    without a usable reply and with fewer than ``attempts`` tries are sent, each
    distinct text once, in waves of about ``wave`` that are committed one by
    one: a run that is killed goes on behind its last wave, and a second run
    sends nothing. A key gets the request's usable reply, or else the outcome
    of its last try."""
    spark = prompts.sparkSession
    sha = F.when(F.col("prompt").isNotNull(), F.sha2(F.concat(F.lit(f"{stage}\n"), "prompt").cast("binary"), 256))
    asked = stored(prompts.select(key, "prompt", sha.alias("sha")), "requests")
    distinct = asked.filter("sha IS NOT NULL").groupBy("sha").agg(F.min("prompt").alias("prompt"))
    good = F.col("reason").isNull()
    for _ in range(attempts):
        tried = reply_ledger(spark, path, stage).groupBy("sha").agg(F.max("attempt").alias("tries"), F.max(good).alias("done"))
        todo = stored(distinct.join(tried, "sha", "left").filter(~F.coalesce("done", F.lit(False)) & (F.coalesce("tries", F.lit(0)) < attempts))
                      .select("sha", "prompt", (F.coalesce("tries", F.lit(0)) + 1).alias("attempt")), "unanswered")
        n = todo.count()
        if not n:
            break
        waves = -(-n // wave)
        for w in range(waves):
            part = todo.filter(F.pmod(F.xxhash64("sha"), F.lit(waves)) == w) if waves > 1 else todo
            got = apply_model(part, "sha", infer, concurrency).join(part.select("sha", "attempt"), "sha")
            got = got.select("sha", "attempt", "reply", "error", reply_problem(F.col("reply"), F.col("error"), list(required)).alias("reason"))
            got.write.mode("append").parquet(f"{path.rstrip('/')}/stage={stage}")
    last = (reply_ledger(spark, path, stage).groupBy("sha")
            .agg(F.max(F.struct(good.alias("good"), "attempt", "reply", "error")).alias("r")))
    return (asked.join(last, "sha", "left")
            .select(key, F.col("r.reply").alias("reply"), F.when(F.col("prompt").isNull(), F.lit("no prompt")).otherwise(F.col("r.error")).alias("error")))


def parse_replies(replies: DataFrame, key: str, schema: str | T.StructType, stage: str = "",
                  required: tuple[str, ...] | list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """LM-4: parse model replies ``(key, reply, error)``. Returns ``(parsed,
    rejected)``: parsed has the typed ``value`` and the whole ``reply``; a
    rejected row has its key, stage, raw text and reason."""
    error = F.col("error") if "error" in replies.columns else F.lit(None).cast("string")
    tagged = replies.select(key, "reply", reply_problem(F.col("reply"), error, list(required)).alias("reason"))
    parsed = tagged.filter(F.col("reason").isNull()).select(key, F.from_json("reply", schema).alias("value"), "reply")
    rejected = tagged.filter(F.col("reason").isNotNull()).select(key, F.lit(stage).alias("stage"), "reply", "reason")
    return parsed, rejected


def no_rejects(df: DataFrame, key: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], f"{key} {dict(df.dtypes)[key]}, stage string, reply string, reason string")


def analyze(transcripts: DataFrame, key: str, infer: Callable[[str], str] | None = None, words: rules.RuleWords = rules.DEFAULT_WORDS,
            concurrency: int = 1, replies: str | None = None, attempts: int = 1) -> tuple[DataFrame, DataFrame]:
    """LM-1 + LM-4: ``(key, analysis, analysis_json)`` and the rejected
    replies. ``analysis_json`` is the whole object the model returned, with
    every key; ``analysis`` has the fields that later steps read. ``replies``
    is the reply table's folder (:func:`ask`); without it equal requests are
    still sent once, but later runs send them again."""
    if infer is None:
        a = offline_analysis(transcripts, key, words)
        return a.withColumn("analysis_json", F.to_json("analysis")), no_rejects(transcripts, key)
    path = replies or scratch(transcripts.sparkSession, "replies")
    got = ask(analysis_prompts(transcripts, key), key, infer, path, "analysis", ANALYSIS_FIELDS, attempts, concurrency)
    parsed, rejected = parse_replies(got, key, ANALYSIS_DDL, "analysis", ANALYSIS_FIELDS)
    return parsed.select(key, F.col("value").alias("analysis"), F.col("reply").alias("analysis_json")), rejected


def analyze_transcripts(transcripts: DataFrame, key: str, infer: Callable[[str], str] | None = None,
                        words: rules.RuleWords = rules.DEFAULT_WORDS, concurrency: int = 1) -> DataFrame:
    """LM-1: ``(key, analysis)`` of :func:`analyze`."""
    return analyze(transcripts, key, infer, words, concurrency)[0].select(key, "analysis")


# The follow-up plan requests. "plan" is the request of the plain
# model path, "sending" the one of the path that sends the messages.
_PLAN_STEPS = """
أنت خبير مبيعات. اكتب خطة Follow-up من 4 رسائل فقط.
- الرسالة 1: للموضوع الأساسي
- الرسالة 2: للموضوع الثانوي
- الرسالة 3: لتعالج الخوف أو الاعتراض
- الرسالة 4: رسالة ختامية بدون ضغط على العميل
"""
PLAN_SYSTEM = {
    "plan": _PLAN_STEPS + """
اكتب فقط JSON.
""",
    "sending": _PLAN_STEPS + """

- ممنوع تكرار نفس جملة البداية في أكثر من رسالة.
- كل رسالة يجب أن تبدأ بأسلوب مختلف وطبيعي
اعملها ريفاكتور واضح قبل ما تظهر
اتاكد ان الرساله واضحه
- اكتب باللغة العربية فقط.
ممنوع استخدام كلمات انجليزيه او صينيه 
اكتب فقط JSON.
""",
}
PLAN_USER = """
ملخص الاجتماع: {summary}

المواضيع: {topics}
الاعتراض: {objection}
المخاوف: {fears}

الملفات المتاحة:
{documents}

-with explain small breif about the attached pdf  and how it will help  to solve the problem for you 
اكتب لي JSON فيه followup_1, followup_2, followup_3, followup_4.


based on the dialog  that happened with cliet  and solving his probllems 
and show the examples you based the scoring on it

- highlight any  rong chat  or action happen between the sales and client  to  make the sales to avoid i thenext call
- highlight if he miss any important thing or service  may cover also in next call 
_ we need to  protect the sales from his mistackews appear in the meeting  
we need to return it and highlit it  to see what is hos rong 
sales scoring  (- clarity
- need_understanding
- professionalism
- objection_handling
- rapport
- closing_power)
"""


def python_list_text(items: Column) -> Column:
    """A list of texts as Python prints it: ``['a', "it's"]``, ``[]``."""
    def quoted(x):
        t = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            t = F.replace(t, F.lit(raw), F.lit(shown))
        double = F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"'))
        return (F.when(x.isNull(), F.lit("None")).when(double, F.concat(F.lit('"'), t, F.lit('"')))
                .otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("\\'")), F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def plan_prompts(analysis: DataFrame, blocks: DataFrame, key: str, variant: str = "plan") -> DataFrame:
    """LM-2: plan prompt per meeting from the analysis and the document
    block (AG-11), in the wording of ``variant`` ("plan" or "sending"). Pure
    column expressions; a JSON null prints as ``None``, as in Python."""
    j = analysis.join(blocks, key, "left")
    a = F.col("analysis")

    def shown(field: str) -> Column:
        return F.coalesce(a[field], F.lit("None"))

    values = {"summary": shown("summary"), "objection": shown("objection"), "fears": shown("fears"),
              "topics": F.coalesce(python_list_text(a["topics"]), F.lit("None")),
              "documents": F.coalesce("document_block", F.lit(""))}
    pieces = re.split(r"\{(\w+)\}", PLAN_SYSTEM[variant] + PLAN_USER)
    return j.select(key, F.concat(*[F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(pieces)]).alias("prompt"))


def plan_followups(prompts: DataFrame, key: str, infer: Callable[[str], str], concurrency: int = 1,
                   replies: str | None = None, attempts: int = 1) -> tuple[DataFrame, DataFrame]:
    """LM-3 + LM-4: model plan per meeting as ``(key, followup_json)``; the
    plan is kept as JSON text (its keys are open). Returns
    ``(plans, rejected)``."""
    got = ask(prompts, key, infer, replies or scratch(prompts.sparkSession, "replies"), "plan", (), attempts, concurrency)
    parsed, rejected = parse_replies(got, key, "map<string,string>", "plan")
    return parsed.select(key, F.col("reply").alias("followup_json")), rejected


def offline_plans(transcripts: DataFrame, documents: DataFrame, key: str,
                  words: rules.RuleWords = rules.DEFAULT_WORDS) -> DataFrame:
    """LM-3 without a model: the rule record (RL-10) of each transcript ``(key,
    text)`` in the JSON shape of a model's plan, ``(key, followup_json)``. The
    first two messages carry the matched ``documents (key, rank, name,
    summary)``; no rule finds mistakes, missed services or skill scores, so
    these are empty."""
    picks = documents.select(key, "rank", "name", F.col("summary").alias("description"))
    subject = transcripts.select(F.col(key).alias("_key"), rules.topic_phrase("text", words).alias("subject"))
    r = rules.build_followup_record(rules.classify_transcripts(transcripts.select(key, "text"), "text", words), picks, key)
    r = r.join(subject, F.col(key).eqNullSafe(F.col("_key")))

    def message(n: int) -> Column:
        files = F.array().cast("array<struct<name:string,description:string>>")
        if n <= 2:
            name = F.col(f"selected_pdf_{n}")
            files = F.when(name.isNotNull(), F.array(F.struct(name.alias("name"), F.col(f"pdf{n}_description").alias("description")))).otherwise(files)
        return F.struct("subject", F.col(f"followup_{n}").alias("body"), files.alias("attachments")).alias(f"followup_{n}")

    none = F.array().cast("array<string>")
    return r.select(key, F.to_json(F.struct(
        *[message(n) for n in range(1, 5)], none.alias("wrong_chat_or_action"), none.alias("missed_important_service"),
        F.create_map().cast("map<string,string>").alias("sales_scoring"))).alias("followup_json"))
