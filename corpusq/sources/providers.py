"""Interfaces of models, with offline stand-ins."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.store import cached_ocr
from ..runtime import ship, stage


class OcrProvider(Protocol):
    def read(self, image_path: str) -> str: ...


class ChatProvider(Protocol):
    def answer(self, system: str, context: str, question: str) -> str: ...


class JudgeProvider(Protocol):
    def judge(self, question: str, answer: str, context: str) -> str: ...


class LookupOcr:
    """Texts from a table; an unknown page is empty."""

    def __init__(self, texts: dict[str, str]):
        self.texts = texts

    def read(self, image_path: str) -> str:
        return self.texts.get(image_path, "")


class OfflineChat:
    """The found passages themselves."""

    def answer(self, system: str, context: str, question: str) -> str:
        cut = context[:3000] + ("…" if len(context) > 3000 else "")
        return "\n".join(["**Запрос:**", question, "---", "**Найденные отрывки:**", cut])


class OverlapJudge:
    """Grades by the share of the answer's words that the context holds."""

    def judge(self, question: str, answer: str, context: str) -> str:
        if not answer or not context:
            return "ИТОГ: ОШИБКА"
        ws, known = answer[:2000].lower().split(), set(context[:4000].lower().split())
        grade = round(5 * sum(w in known for w in ws) / max(1, len(ws)))
        return f"ТОЧНОСТЬ: {grade}\nПОЛНОТА: {grade}\nГАЛЛЮЦИНАЦИИ: {'нет' if grade > 2 else 'есть'}\nИТОГ: {'ХОРОШО' if grade > 2 else 'ПЛОХО'}"


def with_retries(call: Callable[[], str], attempts: int = 8, pause: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's result, or an empty text after ``attempts`` failures with growing pauses."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k + 1 < attempts:
                sleep(min(60.0, pause * 2**k))
    return ""


class Throttle:
    """At least ``pause`` seconds between two calls of one process."""

    def __init__(self, pause: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.pause, self.clock, self.sleep, self.last = pause, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and now - self.last < self.pause:
            self.sleep(self.pause - (now - self.last))
        self.last = self.clock()


def read_pages(pages: DataFrame, cache: DataFrame, provider: OcrProvider, pause: float = 2.0, attempts: int = 8) -> tuple[DataFrame, DataFrame]:
    """Pages (with image_path) and their text, and the cache with what was read now. An image is read once, however many
    pages show it; one that can't be read has an empty text and isn't cached."""
    ship(pages.sparkSession)
    _, misses = cached_ocr(pages.select("image_path").filter("image_path <> ''").distinct(), cache)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate = Throttle(pause)

        def one(path: str) -> str:
            gate.wait()
            return provider.read(path)

        for pdf in it:
            yield pd.DataFrame({"image_path": pdf["image_path"], "text": [with_retries(lambda p=p: one(p), attempts) for p in pdf["image_path"]]})

    new = stage(misses.mapInPandas(run, "image_path string, text string"), "ocr").filter("text <> ''")
    full = cache.select("image_path", "text").unionByName(new)
    return pages.join(full.withColumnRenamed("text", "raw_text"), "image_path", "left").fillna("", ["raw_text"]), full


def chat(questions: DataFrame, provider: ChatProvider, system: str = "") -> DataFrame:
    """query_id, answer from (query_id, text, context), one call a question."""
    ship(questions.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            made = [with_retries(lambda q=q, c=c: provider.answer(system, c, q), 2) for q, c in zip(pdf["text"].fillna(""), pdf["context"].fillna(""))]
            yield pd.DataFrame({"query_id": pdf["query_id"], "answer": made})

    return questions.select("query_id", "text", "context").mapInPandas(run, f"query_id {dict(questions.dtypes)['query_id']}, answer string")


def judged(answered: DataFrame, provider: JudgeProvider) -> DataFrame:
    """query_id, raw reply of the judge from (query_id, text, answer, context); ``verdict`` of functions.text parses it."""
    ship(answered.sparkSession)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            said = [with_retries(lambda q=q, a=a, c=c: provider.judge(q, a, c), 2) for q, a, c in zip(*(pdf[x].fillna("") for x in ("text", "answer", "context")))]
            yield pd.DataFrame({"query_id": pdf["query_id"], "raw": said})

    return answered.select("query_id", "text", "answer", "context").mapInPandas(run, f"query_id {dict(answered.dtypes)['query_id']}, raw string")


def forecast(seconds: Column, pages: Column, of: int = 461) -> Column:
    """Minutes for a book of ``of`` pages at the pace of a sample."""
    return F.round(seconds / pages * of / 60)
