"""Rules on questions, model decisions and answers, as column expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .text import exact_metric_text, metric_text, strip

# Patterns and phrases that decide routes.
IDENTITY = (
    r"(?:你|您|这个助手|知识库助手).{0,4}(?:是|属于|用|使用|基于|调用|运行).{0,6}(?:什么|哪个|哪种|何种)?(?:大)?模型",
    r"(?:当前|现在)(?:回答)?(?:所用|使用|选择|运行|用)?的?(?:大)?模型(?:是|叫|为)?(?:什么|哪个|哪种|何种)",
    r"(?:你|您|这个助手|知识库助手)(?:到底)?是谁",
    r"(?:介绍|说明)(?:一下)?(?:你|您|这个助手|知识库助手)(?:自己)?",
    r"\b(?:what|which)\s+(?:ai\s+|language\s+)?model\s+(?:are|do)\s+you\b",
    r"\bwhat\s+(?:ai\s+|language\s+)?model\s+is\s+this\b",
    r"\bwho\s+are\s+you\b",
)
CATALOG = (
    r"(?:文件夹|目录|路径|子目录)",
    r"(?:有哪些|列出|查看|显示|所有|多少).{0,10}(?:文件|文档)",
    r"(?:文件|文档).{0,10}(?:有哪些|清单|列表|目录)",
    r"\b(?:folder|directory|path|file\s+list|document\s+list)\b",
)
INVENTORY = (
    r"(?:文件夹|目录).{0,12}(?:有哪些|有什么|有啥|包含哪些|列出|多少(?:个)?).{0,8}(?:文件|文档|资料)?",
    r"(?:有哪些|有什么|有啥|列出|显示|多少(?:个)?).{0,10}(?:文件|文档)",
    r"(?:文件|文档).{0,10}(?:清单|列表|有哪些|有多少)",
    r"(?:能否|能不能|可以|可否|能|是否).{0,8}(?:找到|查到|检索到|搜到|存在).{0,8}(?:文件|文档)",
    r"(?:文件|文档).{0,12}(?:存在吗|在吗|有没有|找得到吗|能找到吗)",
    r"\b(?:list|show|count)\b.{0,20}\b(?:files?|documents?)\b",
)
LOOKUP = INVENTORY[3:5]
CONTENT_ACTIONS = (r"(?:总结|概括|归纳|分析|对比|提取|解读|正文|主要内容|讲了什么|说明什么)",)
REFUSALS = (
    "知识库中无相关内容",
    "知识库中没有相关内容",
    "未找到相关内容",
    "没有找到相关内容",
    "无法在知识库中找到",
    "知识库不包含相关",
    "无法根据知识库回答",
    "无法依据知识库回答",
    "没有任何关于",
    "没有找到任何关于",
    "无法基于这些资料",
)
NO_CONTENT = "知识库中无相关内容。"


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return collapse(text).rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def is_identity(text: Column) -> Column:
    return any_of(text, IDENTITY)


def needs_catalog(text: Column) -> Column:
    return any_of(text, CATALOG)


def is_inventory(text: Column) -> Column:
    return any_of(text, INVENTORY) & ~any_of(text, CONTENT_ACTIONS)


def is_file_lookup(text: Column) -> Column:
    return any_of(text, LOOKUP)


#: A decision object of which the last brace may be missing.
CUT_OBJECT = re.compile(r"""\{\s*"decision"\s*:\s*"(?P<word>retrieve|skip)"\s*\}?""", re.IGNORECASE)


def retrieves(output: str | None) -> bool:
    """Whether a model's decision asks for retrieval. Only an exact SKIP doesn't: as a word, or as the last `decision` of a JSON object, between fences on both sides or without any."""
    said = (output or "").strip()
    if said[:3] == said[-3:] == "```":
        said = said.removeprefix("```")
        said = said[4 if said[:4].lower() == "json" else 0 :].lstrip().removesuffix("```").rstrip()
    try:
        made = json.loads(said)
    except json.JSONDecodeError:
        made = None
    if isinstance(made, dict):
        word = made.get("decision", "")
    else:
        cut = CUT_OBJECT.fullmatch(said.strip())
        word = cut["word"] if cut else said
    return str(word).strip().upper() != "SKIP"


@F.pandas_udf(BooleanType())
def _retrieves(output: pd.Series) -> pd.Series:
    return output.map(retrieves).astype(bool)


def decision_retrieves(output: Column) -> Column:
    """retrieves() over a column, in Arrow batches: JSON's own rules on repeated keys and what may follow an object aren't those of Spark's reader."""
    return _retrieves(F.coalesce(output, F.lit("")))


def is_refusal(answer: Column, exact: bool = False) -> Column:
    """Whether a phrase of refusal is in the answer's letters and digits. exact: by Unicode's compatibility forms and case folding, in Arrow batches."""
    squeezed = exact_metric_text(answer) if exact else metric_text(answer)
    found = F.lit(False)
    for phrase in REFUSALS:
        found = found | F.contains(squeezed, F.lit(phrase))
    return found


def answer_route(question: Column, has_hits: Column, retrieved: Column, attached: Column) -> Column:
    """What answers a question: a fixed reply about the assistant, the catalogue, retrieved text, a fixed 'nothing found', attachments or the history."""
    return (
        F.when(is_identity(question), "identity")
        .when(is_inventory(question), "catalog_answer")
        .when(has_hits, "context")
        .when(needs_catalog(question), "catalog_only")
        .when(retrieved & ~attached, "no_content")
        .when(attached, "attachment")
        .otherwise("history")
    )
