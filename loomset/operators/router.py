"""Where a question goes: to figures, to texts, or to both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole words (English) or characters (Chinese) that ask for figures or for texts.
FIGURES = (
    r"(?i)\b(?:how many|how much|count|counts|number of|rate|rates|percentage|percent|average|median|total|totals|trend|trends|month|months|monthly|top|highest|lowest|share|compare|increases?|increased|decreases?|decreased|rank|ranking)\b"
    r"|多少|数量|总数|趋势|走势|占比|比例|百分比|平均|中位数|最高|最低|排名|排行|同比|环比|增长|增加|下降|减少|每月|按月|逐月|(?:响应|及时|救济|投诉|回复)率|top\s*[0-9]"
)
TEXTS = (
    r"(?i)\b(?:narrative|narratives|text|texts|say|says|said|describe|describes|described|example|examples|excerpt|excerpts|quote|quotes|cite|citation|evidence|similar|complain about|complaining|mention|mentions|why|experience|experiences|stories)\b"
    r"|案例|例子|举例|原文|原话|叙述|描述|类似|经历|抱怨|引用|证据|为什么|提到|怎么说|代表性"
)


def route(question: Column) -> Column:
    """'hybrid' if both are asked for, 'rag' if only texts are, else 'sql'."""
    text, figures = question.rlike(TEXTS), question.rlike(FIGURES)
    return F.when(text & figures, "hybrid").when(text, "rag").otherwise("sql")
