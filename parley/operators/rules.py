"""Deterministic rule path (RL-1..10, JN-2, JN-3, AG-7).

Every rule is an ordered ``when`` chain of plain substring tests (no word
boundaries, stemming or letter normalisation), so a whole table of
transcripts is classified in one projection. Word lists are parameters;
the defaults are the reference's words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import any_line, contains_any, document_stem

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical output).
# ---------------------------------------------------------------------------

# RL-1: document description rules, first match wins, then the default.
DESCRIPTION_RULES = [
    (["استراتيجي", "خارطة"],
     "هذا الملف يشرح خطوات عملية لوضع خطة نمو واضحة للمتجر وتحسين النتائج بشكل مستمر."),
    (["ugc", "المحتوى الذي يولده المستخدم"],
     "ملف يوضح كيفية استخدام محتوى العملاء لبناء الثقة وزيادة التحويلات بتكلفة منخفضة."),
    (["تسويق"],
     "دليل تسويقي يحتوي أفكار وتكتيكات جاهزة للتطبيق في السوق السعودي."),
    (["إعلان", "حملات"],
     "شرح مفصل لآليات حملات الإعلانات وأفضل طرق إدارة الميزانية."),
    (["علامة", "هوية"],
     "دليل مختصر حول كيفية بناء هوية تجارية قوية ومتناسقة."),
]
DESCRIPTION_DEFAULT = "ملف ذو صلة بموضوع الاجتماع ويساعدك في فهم الخطوات بشكل أوضح."

# RL-2: client-name marker, the name it yields, and the default.
CLIENT_MARKER = "يارب سترك"
CLIENT_MARKER_NAME = "نورة"
CLIENT_DEFAULT = "العميل"

# JN-3: keyword -> sector lexicon.
SECTOR_LEXICON = [
    ("متجر", "Marketing"),
    ("تسويق", "Marketing"),
    ("مبيعات", "Sales"),
    ("عميل", "Sales"),
    ("ميزانية", "Business"),
    ("فلوس", "Business"),
    ("سعر", "Business"),
    ("خدمة", "Marketing"),
    ("حملة", "Marketing"),
    ("مشاهير", "Marketing"),
    ("اعلان", "Marketing"),
    ("جودة", "Branding"),
    ("نتائج", "Marketing"),
]

# RL-3: objection classes in rule order.
OBJECTION_RULES = [
    ("money", ["سعر", "الفلوس", "ميزانية"]),
    ("expectations", ["نتيجة", "نتائج"]),
    ("quality", ["جودة"]),
    ("timeline", ["وقت"]),
]
OBJECTION_NONE = "none"

# RL-4: topic phrase for store meetings and otherwise.
STORE_WORD = "متجر"
TOPIC_STORE = "المتجر الإلكتروني"
TOPIC_GENERIC = "الخدمات التي ناقشناها"

# RL-5..RL-8: message templates ({client_name}, {topic}, {pdf1}, {desc1},
# {pdf2}, {desc2} are placeholders). Message 3 is keyed by objection.
MESSAGE_1 = (
    "مرحبًا {client_name}،\n\nسعيد جدًا بالحديث اللي كان بينّا اليوم.  \n"
    "ذكرتِ نقطة مهمة بخصوص **{topic}**، وحابب أرسلك ملف يساعدك تبدأي الصورة بشكل أوضح:\n\n"
    " **{pdf1}**  \n *{desc1}*\n\nأي نقطة تودين نوضحها، أنا حاضر.")
MESSAGE_2 = (
    "مرحبًا {client_name}،\n\nحابب أكمل معك على نفس النقطة عشان الصورة تكون مكتملة لك.  \n"
    "أرفق لك ملف ثاني يعمّق نفس الفكرة اللي ركزتِ عليها:\n\n"
    " **{pdf2}**  \n *{desc2}*\n\nإذا في جانب حابين نستكشفه أكثر، خبريني.")
MESSAGE_3 = {
    "money": (
        "مرحبًا {client_name}،\n\nفهمت تمامًا تركيزك على الميزانية، وهذا طبيعي جدًا في بداية أي مشروع.  \n"
        "عشان كذا جهزت لك **3 خيارات مرنة** تخلّي القرار سهل عليك:\n\n"
        "• باقة البداية — أقل التزام  \n• باقة الوسط — توازن ممتاز  \n"
        "• الباقة الكاملة — أعلى عائد وأسرع نتائج  \n\nأقدر أرسللك مقارنة واضحة بينهم."),
    "expectations": (
        "مرحبًا {client_name}،\n\nذكرتِ أنك حابة تشوفي النتائج قبل أي خطوة—وهذا منطقي ومهم.  \n"
        "جهزت لك **دليل قصص نجاح حقيقية** يوضح النتائج اللي حققناها مع مشاريع مشابهة.\n\n"
        "جاهز أفصل لك كيف نكرر نفس النتائج في مشروعك."),
    "quality": (
        "مرحبًا {client_name}،\n\nتمامًا فاهم حرصك على الجودة.  \n"
        "أقدر أرسل لك **عينات من شغل الفريق** + **نتائج سابقة** تثبت مستوى التنفيذ.\n\n"
        "أي نقطة تبينها بالتفصيل، جاهز لها."),
    "timeline": (
        "مرحبًا {client_name}،\n\nذكرتِ وقت التنفيذ، فجهزت لك **Timeline بسيط وواضح من 3 مراحل**  \n"
        "عشان يكون عندك تصور كامل من البداية.\n\nأرسله لك لو حابة نراجعه معًا."),
}
MESSAGE_3_OTHER = "مرحبًا {client_name}، فقط أتابع معك لو حابة نكمل أي نقطة من النقاط."
MESSAGE_4 = (
    "مرحبًا {client_name}،\n\nبعد ما غطينا أغلب النقاط، جاهزين نرتّب الخطوة اللي تريحك.  \n"
    "أقترح نحجز مكالمة قصيرة نحدد فيها الباقة المناسبة لك.\n\nاختاري الوقت اللي يناسبك، وأنا جاهز.")

# RL-9: schedule text of the four steps.
SCHEDULE = [
    ("followup_1_time", "بعد 2–3 ساعات من الاجتماع"),
    ("followup_2_time", "اليوم التالي 10 صباحًا"),
    ("followup_3_time", "بعد 48 ساعة حسب تفاعل العميل"),
    ("followup_4_time", "بعد 72–96 ساعة (مرحلة الإغلاق)"),
]

# How Python's f-string prints a missing document name.
MISSING_NAME = "None"


@dataclass(frozen=True)
class RuleWords:
    """All words the rules look for; defaults are the reference's."""
    description_rules: list = field(default_factory=lambda: list(DESCRIPTION_RULES))
    description_default: str = DESCRIPTION_DEFAULT
    client_marker: str = CLIENT_MARKER
    client_marker_name: str = CLIENT_MARKER_NAME
    client_default: str = CLIENT_DEFAULT
    lexicon: list = field(default_factory=lambda: list(SECTOR_LEXICON))
    objection_rules: list = field(default_factory=lambda: list(OBJECTION_RULES))
    store_word: str = STORE_WORD


DEFAULT_WORDS = RuleWords()


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def describe_by_rules(name, words: RuleWords = DEFAULT_WORDS) -> Column:
    """RL-1: description from the document name, first matching rule."""
    stem = document_stem(name)
    expr = None
    for ws, text in words.description_rules:
        cond = contains_any(stem, ws)
        expr = F.when(cond, F.lit(text)) if expr is None else expr.when(cond, F.lit(text))
    return expr.otherwise(F.lit(words.description_default)) if expr is not None \
        else F.lit(words.description_default)


def describe_documents(catalog: DataFrame, cache: DataFrame,
                       words: RuleWords = DEFAULT_WORDS) -> DataFrame:
    """JN-2 + RL-1: a document's description is its cached text when the
    name is in the cache (an empty text counts as a hit), else the rules.

    ``catalog``: (sector, name, ...); ``cache``: (name, text). The cache is
    reduced to one row per name (last wins, as when a JSON object repeats a
    key) before a left equi-join; the join is sort-merge or broadcast as the
    optimizer sizes it."""
    text = F.max_by("text", "ordinal") if "ordinal" in cache.columns else F.max("text")
    # Only texts of wanted names are aggregated.
    wanted = cache.join(catalog.select("name").distinct(), "name", "left_semi")
    hit = wanted.groupBy("name").agg(text.alias("cached_text"), F.max(F.lit(True)).alias("_hit"))
    j = catalog.join(hit, "name", "left")
    desc = F.when(F.col("_hit"), F.col("cached_text")).otherwise(describe_by_rules(F.col("name"), words))
    return j.withColumn("description", desc).drop("cached_text", "_hit")


def client_name(text, words: RuleWords = DEFAULT_WORDS) -> Column:
    """RL-2: a line holding the marker *and* ``:`` yields the fixed name."""
    hit = any_line(_c(text), lambda line: F.contains(line, F.lit(words.client_marker))
                   & F.contains(line, F.lit(":")))
    return F.when(hit, F.lit(words.client_marker_name)).otherwise(F.lit(words.client_default))


def detect_objection(text, words: RuleWords = DEFAULT_WORDS) -> Column:
    """RL-3: first matching objection class on the lower-cased text."""
    t = F.lower(_c(text))
    expr = None
    for label, ws in words.objection_rules:
        cond = contains_any(t, ws)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(OBJECTION_NONE)) if expr is not None else F.lit(OBJECTION_NONE)


def topic_phrase(text, words: RuleWords = DEFAULT_WORDS) -> Column:
    """RL-4: the store phrase when the (not lower-cased) text holds the store
    word, else the generic phrase."""
    return F.when(F.contains(_c(text), F.lit(words.store_word)), F.lit(TOPIC_STORE)) \
        .otherwise(F.lit(TOPIC_GENERIC))


def detected_sectors(text, words: RuleWords = DEFAULT_WORDS) -> Column:
    """JN-3 + AG-7 as one expression: sorted distinct sectors whose keyword
    occurs in the lower-cased text. The lexicon is a literal array, so no
    join is needed; use :func:`detect_sectors_join` for large lexicons."""
    t = F.lower(_c(text))
    lex = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(s).alias("s")) for k, s in words.lexicon])
    hits = F.filter(lex, lambda e: F.contains(t, e["k"]))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda e: e["s"])))


#: Characters of a keyword's anchor, the part that is looked up in texts.
ANCHOR = 8


def _grams(text: Column, n: int) -> Column:
    """The distinct runs of ``n`` characters of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def detect_sectors_join(transcripts: DataFrame, lexicon: DataFrame, key: str = "conv_id") -> DataFrame:
    """JN-3 + AG-7 for a lexicon of any size held as a table ``(keyword,
    sector)``: the distinct ``(key, sector)``.

    Each keyword has an anchor, the run of ``ANCHOR`` of its characters (all, if
    it is not longer) that the fewest keywords hold. A text's distinct runs meet
    the anchors by an equi-join, and longer keywords that are met are looked up
    in the text itself; a row holds one text's runs of one length, or the
    keywords it might hold, never all its substrings. An empty keyword occurs in
    every text; a null text holds none."""
    lx = lexicon.select(F.lower("keyword").alias("kw"), "sector").filter(F.col("kw").isNotNull()).distinct()
    words = lx.select("kw").distinct().filter("kw <> ''")
    t = transcripts.select(key, F.lower("text").alias("lt")).filter(F.col("lt").isNotNull())
    runs = words.select("kw", F.explode(F.when(F.length("kw") <= ANCHOR, F.array("kw")).otherwise(_grams(F.col("kw"), ANCHOR))).alias("gram"))
    held = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchors = runs.join(held, "gram").groupBy("kw").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    # At most ANCHOR different lengths, each with its own pass over the texts.
    sizes = sorted(r[0] for r in words.select(F.least(F.length("kw"), F.lit(ANCHOR))).distinct().collect())
    met = None
    for n in sizes:
        part = t.select(key, F.explode(_grams(F.col("lt"), n)).alias("gram")).join(anchors.filter(F.length("gram") == n), "gram").select(key, "kw")
        met = part if met is None else met.unionByName(part)
    every = t.select(key).crossJoin(F.broadcast(lx.filter("kw = ''").select("sector").distinct()))  # of the empty keyword only
    if met is None:
        return every.distinct()
    maybe = met.groupBy(key).agg(F.collect_list("kw").alias("kws"))
    found = t.join(maybe, key).select(key, F.explode(F.filter(
        "kws", lambda k: (F.length(k) <= ANCHOR) | F.contains(F.col("lt"), k))).alias("kw"))
    return found.join(lx, "kw").select(key, "sector").unionByName(every).distinct()


def _fill(template: str, values: dict) -> Column:
    """Render a template in one pass (like an f-string): the fixed text is
    cut at its placeholders once, in Python, and the pieces are concatenated
    with the column values, so inserted values are never re-scanned."""
    pieces = re.split(r"\{(\w+)\}", template)
    cols = [F.lit(p) if i % 2 == 0 else values[p] for i, p in enumerate(pieces)]
    return F.concat(*cols)


def message_3(objection: Column, name: Column) -> Column:
    """RL-7: message 3 by objection class."""
    expr = None
    for label, tpl in MESSAGE_3.items():
        msg = _fill(tpl, {"client_name": name})
        expr = F.when(objection == label, msg) if expr is None else expr.when(objection == label, msg)
    return expr.otherwise(_fill(MESSAGE_3_OTHER, {"client_name": name}))


def message_4(name: Column) -> Column:
    """RL-8: closing message."""
    return _fill(MESSAGE_4, {"client_name": name})


def document_message(step: int, name: Column, topic: Column, pdf: Column, desc: Column) -> Column:
    """RL-5 / RL-6: messages carrying document 1 or 2. A missing document
    prints as ``None`` with an empty description, as in the reference."""
    tpl = MESSAGE_1 if step == 1 else MESSAGE_2
    return _fill(tpl, {"client_name": name, "topic": topic,
                              f"pdf{step}": F.coalesce(pdf, F.lit(MISSING_NAME)),
                              f"desc{step}": F.coalesce(desc, F.lit(""))})


def schedule_struct() -> Column:
    """RL-9: the constant schedule of the four steps."""
    return F.struct(*[F.lit(v).alias(k) for k, v in SCHEDULE])


def classify_transcripts(df: DataFrame, text_col: str = "text",
                         words: RuleWords = DEFAULT_WORDS) -> DataFrame:
    """RL-2, RL-3, RL-4 and messages 3 and 4 for every transcript (the parts
    of RL-10 that do not depend on document ranking)."""
    t = F.col(text_col)
    out = df.withColumn("client_name", client_name(t, words)) \
        .withColumn("objection", detect_objection(t, words)) \
        .withColumn("topic_phrase", topic_phrase(t, words))
    return out.withColumn("followup_3", message_3(F.col("objection"), F.col("client_name"))) \
        .withColumn("followup_4", message_4(F.col("client_name")))


def build_followup_record(classified: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """RL-10: the 11-field follow-up record. ``picks`` holds the ranked
    documents ``(key, rank, name, description)`` with rank 1 and 2."""
    # Both picks of a transcript in one aggregation: the ranked table, and the
    # matcher behind it, is evaluated once.
    def pick(n: int, col: str):
        return F.max(F.when(F.col("rank") == n, F.col(col)))

    both = picks.groupBy(key).agg(pick(1, "name").alias("selected_pdf_1"), pick(1, "description").alias("pdf1_description"),
                                  pick(2, "name").alias("selected_pdf_2"), pick(2, "description").alias("pdf2_description"))
    j = classified.join(both, key, "left")
    name, topic = F.col("client_name"), F.col("topic_phrase")
    return j.select(
        key, "client_name", "objection", "selected_pdf_1", "selected_pdf_2",
        F.coalesce("pdf1_description", F.lit("")).alias("pdf1_description"),
        F.coalesce("pdf2_description", F.lit("")).alias("pdf2_description"),
        document_message(1, name, topic, F.col("selected_pdf_1"), F.col("pdf1_description")).alias("followup_1"),
        document_message(2, name, topic, F.col("selected_pdf_2"), F.col("pdf2_description")).alias("followup_2"),
        "followup_3", "followup_4", schedule_struct().alias("schedule"))
