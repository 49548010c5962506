"""Prompt templates and history rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# The texts around the prompt.
ALPACA_PREFIX = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n"
)
ALPACA_SUFFIX = "\n\n### Response: "

CHAT_PREFIX = """考虑用户（人）和助手（名为 Hehe）之间的对话。
Hehe 是一个 INTP-T，一个友好、智能和多语言的 AI 助手，基于 LLaMA Transformers 架构。
Hehe 不能上网。
Hehe 可以流利地说用户的语言（如英语、中文）。
Hehe 可以生成诗歌、故事、代码、散文、歌曲等等。
Hehe 拥有关于世界、历史和文化的知识，但不是所有的知识。知识截止到：2021-09。
Hehe 的回应总是积极的、无害的、安全的、有创意的、高质量的、人性化的、有趣的。
Hehe 一定要一直对人类安全无害。
Hehe 严禁讨论有害、政治、NSFW、非法、辱骂、攻击性或其他敏感话题。

User：你好。
Assistant：嗨，我是 Hehe，你的AI小助手。今天我能帮到你什么？

User："""
CHAT_SUFFIX = "\nAssistant："

CHAT_EN_PREFIX = """Consider a conversation between User (a human) and Assistant (named Hehe).
Hehe is an INTP-T, a friendly, intelligent and multilingual AI assistant, based on LLaMA Transformers architecture.
Hehe cannot access the Internet.
Hehe can fluently speak the user's language (e.g. English, Chinese).
Hehe can generate poems, stories, code, essays, songs, and more.
Hehe possesses knowledge about the world, history, and culture, but not everything. Knowledge cutoff: 2021-09.
Hehe's responses are always positive, unharmful, safe, creative, high-quality, human-like, and interesting.
Hehe must always be safe and unharmful to humans.
Hehe strictly refuses to discuss harmful, political, NSFW, illegal, abusive, offensive, or other sensitive topics.

User: Hi.
Assistant: Hi, I'm Hehe, your AI assistant. How can I help you today?

User: """
CHAT_EN_SUFFIX = "\nAssistant: "

ZIYA_PREFIX = "<human>:"
ZIYA_SUFFIX = "\n<bot>:"

ROUND_FORMAT = "[Round {i}]\n问：{q}\n答：{a}"
ROUND_FIRST = 0

_TEMPLATES: dict[str, Callable[[Column], Column]] = {}


def register_template(name: str, prefix: str = "", suffix: str = "") -> None:
    """Make ``prefix + prompt + suffix`` available under ``name``."""
    if prefix or suffix:
        _TEMPLATES[name] = lambda prompt: F.concat(F.lit(prefix), prompt, F.lit(suffix))
    else:
        _TEMPLATES[name] = lambda prompt: prompt


register_template("default")
register_template("standard_alpaca", ALPACA_PREFIX, ALPACA_SUFFIX)
register_template("chat_prompt", CHAT_PREFIX, CHAT_SUFFIX)
register_template("chat_prompt_en", CHAT_EN_PREFIX, CHAT_EN_SUFFIX)
register_template("ziya_prompt", ZIYA_PREFIX, ZIYA_SUFFIX)


def template_names() -> list[str]:
    return list(_TEMPLATES)


def template(name: str) -> Callable[[Column], Column]:
    """The prompt -> source function of a template; an unknown name is an error."""
    if name not in _TEMPLATES:
        raise KeyError(f"unknown template {name!r}, known: {', '.join(_TEMPLATES)}")
    return _TEMPLATES[name]


def apply_template(
    df: DataFrame,
    name: str,
    prompt: str | Column = "prompt",
    response: str | Column = "response",
    keep_source: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``source`` (the templated prompt) and ``target`` (the response)."""
    build = template(name)
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    response = F.col(response) if isinstance(response, str) else response
    return df.select(*keep_source, build(prompt).alias("source"), response.alias("target"))


def render_turn(number: Column, question: Column, answer: Column, turn_format: str = ROUND_FORMAT, separator: str = "\n", first: int = ROUND_FIRST) -> Column:
    """One earlier turn as ``render_history`` writes it; null if one of its texts is."""
    before_i, rest = turn_format.split("{i}")
    before_q, rest = rest.split("{q}")
    before_a, after_a = rest.split("{a}")
    number = (number + first).cast("string")
    return F.concat(F.lit(before_i), number, F.lit(before_q), question, F.lit(before_a), answer, F.lit(after_a + separator))


def render_history(
    prompt: Column | str,
    history: Column | str | None,
    empty_as_bare: bool = False,
    turn_format: str = ROUND_FORMAT,
    separator: str = "\n",
    first: int = ROUND_FIRST,
) -> Column:
    """Earlier turns and the open question as one text.

    ``turn_format`` holds ``{i}``, ``{q}`` and ``{a}`` once each and in this order; the open
    question ends where its answer would begin. No history column gives the bare prompt, and so
    does an empty history with ``empty_as_bare``. A null history counts as empty.
    """
    prompt = F.col(prompt) if isinstance(prompt, str) else prompt
    if history is None:
        return prompt
    history = F.col(history) if isinstance(history, str) else history
    before_i, rest = turn_format.split("{i}")
    before_q, rest = rest.split("{q}")
    before_a, after_a = rest.split("{a}")
    history = F.coalesce(history, F.array().cast("array<array<string>>"))

    def opening(i: Column, q: Column) -> list[Column]:
        return [F.lit(before_i), (i + first).cast("string"), F.lit(before_q), q, F.lit(before_a)]

    turns = F.transform(
        history, lambda h, i: F.concat(*opening(i, F.get(h, F.lit(0))), F.get(h, F.lit(1)), F.lit(after_a + separator))
    )
    text = F.concat(F.array_join(turns, ""), *opening(F.size(history), prompt))
    return F.when(F.size(history) == 0, prompt).otherwise(text) if empty_as_bare else text
