"""Word lists of the answer parser, version ``v6``.  Pass others to the operators for other vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

# Terms of the answer parser.
HEDGES = (
    "likely", "probably", "presumably", "appears to be", "seems to be", "seem to be", "based on the name", "based on the term", "portmanteau",
    "it's possible that", "it is possible that", "might be", "closely resembles", "可能是", "大概", "推测", "顾名思义", "据推断",
)
ADMISSIONS = (
    "i'm not aware", "i am not aware", "don't have information", "do not have information", "don't have specific information", "do not have specific information",
    "do not have verified", "no information available", "couldn't find", "could not find", "cannot provide information", "cannot provide a specific",
    "not a well-known entity", "not widely recognized", "not a widely recognized", "no widely recognized", "没有找到", "不了解", "无法确认", "没有相关信息",
)
COMPARISONS = (
    "vs", "versus", "compared to", "compared with", "comparison", "alternative", "alternatives", "better than", "worse than", "instead of", "rather than",
    "相比", "对比", "比较", "不如", "优于", "逊于", "相较", "替代", "选择哪个", "哪个更好",
)
POSITIVES = (
    "best", "recommended", "recommend", "leading", "reliable", "excellent", "great", "popular", "powerful", "trusted", "top", "robust", "solid",
    "推荐", "优秀", "领先", "可靠", "靠谱", "出色", "强大", "好用", "首选", "值得", "口碑好",
)
NEGATIVES = (
    "poor", "lacks", "lack", "avoid", "outdated", "expensive", "unreliable", "buggy", "limited", "slow", "disappointing", "weak",
    "差", "缺乏", "不推荐", "过时", "昂贵", "不稳定", "不靠谱", "糟糕", "缓慢", "有限", "失望",
)
NEGATIONS = ("not", "n't", "never", "no ", "hardly", "不", "没", "无", "别", "难以")


@dataclass(frozen=True)
class Lexicon:
    hedges: tuple[str, ...] = HEDGES
    admissions: tuple[str, ...] = ADMISSIONS
    comparisons: tuple[str, ...] = COMPARISONS
    positives: tuple[str, ...] = POSITIVES
    negatives: tuple[str, ...] = NEGATIVES
    negations: tuple[str, ...] = NEGATIONS


#: engines that can search the web; unknown ones count as able to
WEB_SEARCH = {"openai": True, "perplexity": True, "gemini": True, "deepseek": False}
