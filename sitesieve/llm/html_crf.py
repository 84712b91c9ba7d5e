"""Main text of pages by a linear-chain conditional random field over leaf blocks.

Each block of a page is main text or not. The field scores a block by the tags and names around it and by its
text, and a pair of neighbours by their labels; it is trained on labelled pages by the gradient of the exact
conditional likelihood and decoded by Viterbi.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesieve.llm.common import small_batches
from sitesieve.llm.html_blocks import Block, blocks
from sitesieve.llm.labelled_pages import labelled_pages


def _bucket(n: float, steps: tuple[float, ...]) -> int:
    return sum(n >= s for s in steps)


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features that are on for each block."""
    out, longest = [], max((len(b.text) for b in page), default=1)
    for k, b in enumerate(page):
        words = b.text.count(" ") + 1
        link = b.linked / max(1, len(b.text))
        on = ["bias", f"own:{b.own}", f"words:{_bucket(words, (2, 4, 8, 16, 32, 64, 128))}", f"links:{_bucket(link, (0.01, 0.25, 0.5, 0.9))}", f"commas:{_bucket(b.text.count(','), (1, 3, 8))}"]
        on.append("end" if b.text[-1:] in ".!?…:;\"”»" else "no-end")
        on.append("sign" if b.text[0] in "©|›»•·" or b.text.isdigit() else "no-sign")
        on += [f"in:{t}" for t in b.tags] + [f"name:{n}" for n in b.names]
        on.append(f"size:{_bucket(len(b.text) / longest, (0.02, 0.1, 0.3))}")
        if k and page[k - 1].parent == b.parent:
            on.append("same-parent")
        out.append(on)
    return out


@dataclass
class Field:
    """Weights of the features for the label "main" and the scores of neighbouring labels."""

    weights: dict[str, float]
    pairs: np.ndarray

    @cached_property
    def names(self) -> frozenset[str]:
        """Names of elements that the field has weights for."""
        return frozenset(f.removeprefix("name:") for f in self.weights if f.startswith("name:"))

    def decode(self, page: list[Block]) -> list[bool]:
        """The most likely labels (Viterbi)."""
        if not page:
            return []
        w = self.weights
        scores = [sum(w.get(f, 0.0) for f in sorted(on)) for on in features(page)]
        (p00, p01), (p10, p11) = self.pairs.tolist()
        no, yes, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_no, from_yes = no + p00 >= yes + p10, no + p01 > yes + p11
            back.append((0 if from_no else 1, 0 if from_yes else 1))
            no, yes = (no + p00 if from_no else yes + p10), (no + p01 if from_yes else yes + p11) + s
        label, out = int(yes > no), []
        out.append(label)
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return [bool(x) for x in reversed(out)]


def _normal(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(x[..., 0], x[..., 1])


def train(pages: list[tuple[list[Block], list[bool]]], steps: int = 250, rate: float = 0.1, l2: float = 0.02) -> Field:
    """Maximise the conditional likelihood of labelled pages by Adam; forward and backward run over all pages at once."""
    pages = [(b, y) for b, y in pages if b]
    on = [features(b) for b, _ in pages]
    names = sorted({f for page in on for block in page for f in block})
    at = {f: k for k, f in enumerate(names)}
    n, most = len(pages), max(len(b) for b, _ in pages)
    rows = np.array([(p, t, at[f]) for p, page in enumerate(on) for t, block in enumerate(page) for f in block])
    cell = rows[:, 0] * most + rows[:, 1]
    length = np.array([len(b) for b, _ in pages])
    live = np.arange(most) < length[:, None]
    gold = np.zeros((n, most), int)
    for p, (_, y) in enumerate(pages):
        gold[p, : len(y)] = y
    gold_pairs = np.zeros((2, 2))
    both = live[:, 1:]
    np.add.at(gold_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    w, pairs = np.zeros(len(names)), np.zeros((2, 2))
    m, v = np.zeros(len(names) + 4), np.zeros(len(names) + 4)
    for step in range(1, steps + 1):
        score = np.zeros((n, most, 2))
        score[:, :, 1] = np.bincount(cell, w[rows[:, 2]], n * most).reshape(n, most)
        forward, backward = np.zeros((n, most, 2)), np.zeros((n, most, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, most):
            forward[:, t] = _normal(forward[:, t - 1, :, None].transpose(0, 2, 1) + pairs.T[None]) + score[:, t]
        for t in range(most - 2, -1, -1):
            step_back = _normal(pairs[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :])
            backward[:, t] = np.where(live[:, t + 1, None], step_back, 0.0)
        total = _normal(forward[np.arange(n), length - 1])
        chance = np.exp(forward + backward - total[:, None, None])[:, :, 1] * live
        joint = forward[:, :-1, :, None] + pairs + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(joint, 0)) * both[:, :, None, None]).sum((0, 1))
        gradient = np.append(np.bincount(rows[:, 2], ((gold - chance) * live).ravel()[cell], len(names)) - l2 * w, (gold_pairs - expected - l2 * pairs).ravel())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, pairs = w + move[:-4], pairs + move[-4:].reshape(2, 2)
    return Field({f: float(x) for f, x in zip(names, w, strict=True)}, pairs)


@lru_cache(maxsize=1)
def field() -> Field:
    """The field trained on the labelled pages of this package."""
    return train(labelled_pages())


def main_text(html: str | None, model: Field) -> str:
    page = blocks(html, model.names)
    return "\n\n".join(b.text for b, keep in zip(page, model.decode(page), strict=True) if keep)


def extract(pages: DataFrame, html: str = "html", model: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; text is empty where there is no main text, as for null html.

    Main blocks in page order are joined by a blank line. Null ids and urls stay null, repeated rows each get a
    row, further columns are not read. An empty table gives no rows. A page takes time and memory in proportion to its
    length, however deep its elements are nested and whatever is left unclosed.
    """
    small_batches(pages.sparkSession)
    model = model or field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
