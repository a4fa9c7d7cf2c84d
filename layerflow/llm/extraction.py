"""Main text of web pages by a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.llm.blocks import leaf_blocks, own_features, text_features
from layerflow.llm.common import query, table
from layerflow.llm.labelled_pages import MARK, labelled_pages

STEPS, RATE, PENALTY = 160, 0.15, 0.03


@dataclass
class Field:
    """The weights of the field: for each feature how far it speaks for main text, and what it
    costs to begin with, and to pass from and to, other (0) and main (1) blocks."""

    weights: dict[str, float]
    start: list[float]
    step: list[list[float]]
    known: dict[tuple[str, str], float] = field(default_factory=dict)

    def weigh(self, tag: str, attributes: str) -> float:
        key = (tag, attributes)
        if key not in self.known:
            if len(self.known) > 10_000:  # only a memory of what was weighed before
                self.known.clear()
            self.known[key] = sum([self.weights.get(f, 0.0) for f in own_features(tag, attributes)])
        return self.known[key]

    def main_text(self, page: str) -> str:
        """The text of the blocks on the most likely path, by Viterbi."""
        blocks = list(leaf_blocks(page, self.weigh, 0.0))
        if not blocks:
            return ""
        get = self.weights.get
        back: list[tuple[int, int]] = []
        other, main = self.start
        (oo, om), (mo, mm) = self.step
        for i, block in enumerate(blocks):
            if i:
                to_other, to_main = (other + oo, main + mo), (other + om, main + mm)
                back.append((int(to_other[1] > to_other[0]), int(to_main[1] > to_main[0])))
                other, main = max(to_other), max(to_main)
            main += block.above + sum([get(f, 0.0) for f in text_features(block)])
        label, chosen = int(main > other), []
        for i in range(len(blocks) - 1, -1, -1):
            if label:
                chosen.append(blocks[i].text)
            if i:
                label = back[i - 1][label]
        return " ".join(reversed(chosen))


def fit_field(pages: list[str]) -> Field:
    """Maximise the likelihood of the labels of marked pages, with a penalty on large weights,
    by gradient ascent with Adam's step sizes; the gradient comes from forward and backward
    sums over all pages at once."""
    names: dict[str, int] = {}
    rows, labels, lengths = [], [], []
    for page in pages:
        blocks = list(leaf_blocks(page, own_features, []))
        lengths.append(len(blocks))
        for block in blocks:
            labels.append(int(block.text.startswith(MARK)))
            block.text = block.text.removeprefix(MARK) or "."
            rows.append([names.setdefault(f, len(names)) for f in [*block.above, *text_features(block)]])
    x = np.zeros((len(rows), len(names)))
    for i, row in enumerate(rows):
        np.add.at(x[i], row, 1.0)
    y = np.array(labels)
    many, longest = len(lengths), max(lengths)
    place = np.concatenate([np.arange(n) for n in lengths])
    page_of = np.repeat(np.arange(many), lengths)
    valid = np.zeros((longest, many), dtype=bool)
    valid[place, page_of] = True
    gold = np.zeros((longest, many), dtype=int)
    gold[place, page_of] = y
    pairs = valid[1:]
    counts = np.array([[((gold[:-1] == a) & (gold[1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
    starts = np.array([(gold[0] == a).sum() for a in (0, 1)], float)

    theta = np.zeros(len(names) + 6)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for turn in range(1, STEPS + 1):
        w, start, step = theta[:-6], theta[-6:-4], theta[-4:].reshape(2, 2)
        unary = np.zeros((longest, many, 2))
        unary[place, page_of, 1] = x @ w
        alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
        alpha[0] = start + unary[0]
        for t in range(1, longest):
            nxt = np.logaddexp(alpha[t - 1, :, :1] + step[0], alpha[t - 1, :, 1:] + step[1]) + unary[t]
            alpha[t] = np.where(valid[t][:, None], nxt, alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = unary[t + 1] + beta[t + 1]
            back = np.logaddexp(step[:, 0] + ahead[:, :1], step[:, 1] + ahead[:, 1:])
            beta[t] = np.where(valid[t + 1][:, None], back, 0.0)
        total = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])[:, None]
        node = np.exp(alpha + beta - total)
        edge = np.exp(alpha[:-1, :, :, None] + step + (unary[1:] + beta[1:])[:, :, None, :] - total[None, :, :, None])
        grad = np.concatenate(
            [
                x.T @ (y - node[place, page_of, 1]),
                starts - node[0].sum(axis=0),
                (counts - (edge * pairs[:, :, None, None]).sum(axis=(0, 1))).ravel(),
            ]
        ) - PENALTY * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta += RATE * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-9)
    weights = {n: float(theta[i]) for n, i in names.items()}
    return Field(weights, theta[-6:-4].tolist(), theta[-4:].reshape(2, 2).tolist())


@lru_cache(maxsize=1)
def default_field() -> Field:
    return fit_field(list(labelled_pages()))


def extract_main_text(pages: DataFrame, model: Field, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep``, the main text, and its number of code points.

    A null or empty page, and one without main blocks, has the empty text. Whole pages are
    read, broken ones as browsers read them. Nothing is shuffled; repeated rows stay.
    """

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.main_text(page) for page in batch], dtype=object)

    run = F.pandas_udf(extract, "string")
    found = pages.select(*[F.col(k) for k in keep], run(F.coalesce(html, F.lit(""))).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query("op1_extraction")
def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages"), default_field(), ["page_id", "url"])
