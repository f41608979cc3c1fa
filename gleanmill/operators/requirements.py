"""Requirements of a job and what a material proves of them: skills, requirement profiles, classes of content, token budgets, shifted times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock, seconds

#: Known skills, endings of skills, and words that are none.
SKILLS = (
    "RAG-Fusion", "Multi-Query", "BM25", "pgvector", "MinerU", "OCR", "ASR", "FastAPI", "Spring Boot", "React", "Vite", "MyBatis", "PostgreSQL",
    "向量检索", "混合检索", "递归切块", "提示词", "简历优化", "岗位适配", "视频检索", "字幕解析", "知识库", "学习计划", "证据引用",
)
SKILL_PHRASE = "[一-鿿]{2,8}(?:检索|切块|识别|分析|适配|证据|知识库|学习计划)"
SKILL_TOKEN = "[A-Za-z][A-Za-z0-9_+#.-]{2,}"
NO_SKILLS = ("and", "the", "with", "for", "job", "api")
ANY_SKILL = "岗位核心能力"
GENERIC_REQUIREMENTS = ("项目经验", "核心技术栈", "学习证据")
VAGUE = ("具备", "熟悉", "掌握", "负责", "相关", "能力", "经验", "要求", "岗位", "优先", "能够", "以及")
#: Words of learning contents, and of what is none.
INTENT = ("八股", "面经", "面试题", "课程", "教程", "知识点", "技术讲解", "学习笔记", "复习", "源码分析", "教学", "讲解")
TOPIC = ("原理", "机制", "高可用", "分布式", "算法", "数据库", "缓存", "消息队列", "向量检索", "大模型", "事务", "并发", "架构")
OTHER = ("个人简历", "求职简历", "招聘职位", "岗位描述", "职位描述", "会议纪要", "工作周报", "工作日报", "聊天记录", "通知公告", "系统日志", "错误日志", "上传清单", "账单", "发票", "歌词", "声乐练习")
QUESTIONS = "[？?]|为什么|如何|是什么|区别|作用|流程"
STATEMENTS = "是指|用于|通过|包括|分为|原因|区别|优点|缺点|步骤|机制|原理|实现|保证|负责|依赖|同步|选举|配置|组成|采用|导致|解决|比较"
CLASSES = (("面试复习", ("面经", "面试题", "八股", "面试官")), ("课程复习", ("课程", "教程", "视频", "讲解")), ("技术原理", ("原理", "机制", "算法", "高可用", "分布式")))


def skills(text: Column, most: int = 12) -> Column:
    """Known skills, then Latin names, then phrases with a skill's ending, each once; one that stands for all if there is none."""
    lower = F.lower(text)
    known = F.filter(F.array(*map(F.lit, SKILLS)), lambda s: F.contains(lower, F.lower(s)))
    names = F.filter(F.regexp_extract_all(text, F.lit(SKILL_TOKEN), F.lit(0)), lambda t: ~F.lower(t).isin(*NO_SKILLS))
    found = F.slice(F.array_distinct(F.concat(known, names, F.regexp_extract_all(text, F.lit(SKILL_PHRASE), F.lit(0)))), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(ANY_SKILL)))


def split_requirements(text: Column, most: int = 6) -> Column:
    """Clauses of 2 to 40 characters; general ones if there is none."""
    parts = F.transform(F.split(text, "[，。；;\n]"), lambda x: F.regexp_replace(x, "^[ ，。；;、]+|[ ，。；;、]+$", ""))
    found = F.slice(F.filter(parts, lambda x: F.length(x).between(2, 40)), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, GENERIC_REQUIREMENTS)))


def alignment(index: Column, requirement: Column, resume: Column, n_evidence: Column) -> Column:
    """supported, weak or missing: with evidence the first requirement, and those that the resume names, are supported."""
    return F.when(n_evidence <= 0, "missing").when((index == 0) | F.contains(F.lower(resume), F.lower(requirement)), "supported").otherwise("weak")


def keywords(requirement: Column, most: int = 6) -> Column:
    """Words of two characters and more that are not vague; the requirement itself if there is none."""
    parts = F.filter(F.split(requirement, r"[\s、，,；;：:（）()和]+"), lambda x: (F.length(x) >= 2) & ~x.isin(*VAGUE))
    return F.when(F.size(parts) > 0, F.slice(parts, 1, most)).otherwise(F.array(F.left(requirement, F.lit(32))))


def profile(jobs: DataFrame) -> DataFrame:
    """jobs (job_id, text): a row for each requirement with its id, priority (the first three are HIGH) and keywords."""
    each = jobs.select("job_id", F.posexplode(split_requirements(F.col("text"))).alias("k", "requirement"))
    return each.select("job_id", F.concat(F.lit("req-"), (F.col("k") + 1).cast("string")).alias("id"), "requirement", F.when(F.col("k") < 3, "HIGH").otherwise("MEDIUM").alias("priority"), keywords(F.col("requirement")).alias("keywords"))


def learning_content(title: Column, corpus: Column) -> Column:
    """(is_learning, category) by words of intent, topic and form."""
    title, corpus = F.lower(title), F.lower(corpus)
    has = lambda c, words: reduce(Column.__or__, [c.contains(w) for w in words])
    form = F.least(F.regexp_count(corpus, F.lit(QUESTIONS)), F.lit(2)) + F.least(F.regexp_count(corpus, F.lit(STATEMENTS)), F.lit(2))
    learning = has(corpus, INTENT) | (has(corpus, TOPIC) & (form >= 2)) | (form >= 4)
    good = learning & ~(has(title, OTHER) & ~has(title, INTENT))
    category = F.lit("学习资料")
    for name, words in reversed(CLASSES):
        category = F.when(has(corpus, words), name).otherwise(category)
    return F.struct(good.alias("is_learning"), F.when(good, category).otherwise("非学习资料").alias("category"))


def within_tokens(text: Column, budget: int) -> Column:
    """A head of the text of at most budget tokens (a token for each two characters, rounded up), its end stripped."""
    n = F.floor((F.length(text) + 1) / 2)
    ratio = F.greatest(F.lit(0.05), F.least(F.lit(0.95), budget / F.greatest(n, F.lit(1))))
    size = F.greatest(F.lit(200), F.floor(F.length(text) * ratio * 0.92))
    fits = lambda k: F.floor((k + 1) / 2) <= budget
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(200)), size.cast("long"), lambda k, _: F.when(fits(k), k).otherwise(F.greatest(F.lit(1), F.floor(k * 0.9))).cast("long"))
    return F.when(n <= budget, text).otherwise(F.rtrim(F.left(text, steps.cast("int"))))


def shifted(time: Column, offset: Column) -> Column:
    """A clock time moved by an offset in seconds."""
    return clock(seconds(F.coalesce(time, F.lit(""))) + offset)

