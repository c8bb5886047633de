"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is a sequence of leaf blocks, each with features of its ancestors and its text. The
field scores "main text" against "rest" for every block and every step from one to the next;
it is trained on labelled pages by gradient steps on the exact likelihood and decoded by
Viterbi. Pages are independent, so extraction is one scan without a shuffle.
"""

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinscript.llm.html_blocks import Block, blocks_of, features
from twinscript.llm.labelled_pages import drawn_pages

LABELS = 2  # rest, main text


@dataclass(frozen=True)
class Field:
    """Weights of the trained chain: (rest, main) by feature, start scores, step scores."""

    weights: dict[str, tuple[float, float]]
    start: tuple[float, float]
    step: tuple[tuple[float, float], tuple[float, float]]

    def labels(self, blocks: list[Block]) -> list[int]:
        """The likeliest sequence of labels."""
        if not blocks:
            return []
        scores = []
        for names in features(blocks):
            pairs = [self.weights[f] for f in names if f in self.weights]
            scores.append((sum(p[0] for p in pairs), sum(p[1] for p in pairs)))
        best = [self.start[k] + scores[0][k] for k in (0, 1)]
        back = []
        for s in scores[1:]:
            came, now = [], []
            for k in (0, 1):
                options = [best[j] + self.step[j][k] for j in (0, 1)]
                j = int(options[1] > options[0])
                came.append(j)
                now.append(options[j] + s[k])
            back.append(came)
            best = now
        path = [int(best[1] > best[0])]
        for came in reversed(back):
            path.append(came[path[-1]])
        return path[::-1]

    def text(self, html: str) -> str:
        blocks = blocks_of(html)
        return "\n".join(b.text for b, label in zip(blocks, self.labels(blocks)) if label)


def aligned(html: str, text: str) -> tuple[list[Block], list[int]]:
    """The blocks of a labelled page, each main if its text is a line of the main text still unmatched."""
    blocks, lines = blocks_of(html), Counter(" ".join(x.split()) for x in text.split("\n"))
    labels = []
    for b in blocks:
        labels.append(int(lines[b.text] > 0))
        lines[b.text] -= labels[-1]
    return blocks, labels


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(labelled: list[tuple[str, str]], least_count: int = 4, steps: int = 250, rate: float = 0.08, ridge: float = 2e-4) -> Field:
    """Fit on (html, main text) pages; the pages must fit in memory, as a labelled set does."""
    chains = [(features(b), y) for b, y in (aligned(*page) for page in labelled) if b]
    counts = Counter(f for names, _ in chains for block in names for f in block)
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= least_count))}
    pages, longest, width = len(chains), max(len(y) for _, y in chains), len(vocabulary)
    slot, column = [], []
    gold = np.zeros((pages, longest), np.int64)
    mask = np.zeros((pages, longest), bool)
    for p, (names, y) in enumerate(chains):
        gold[p, : len(y)] = y
        mask[p, : len(y)] = True
        for t, block in enumerate(names):
            known = [vocabulary[f] for f in block if f in vocabulary]
            slot.extend([p * longest + t] * len(known))
            column.extend(known)
    slot, column = np.array(slot), np.array(column)
    blocks = int(mask.sum())
    one_hot = np.eye(LABELS)[gold] * mask[:, :, None]
    both = (mask[:, 1:] & mask[:, :-1])[:, :, None, None] * one_hot[:, :-1, :, None] * one_hot[:, 1:, None, :]
    theta = np.zeros(width * LABELS + LABELS + LABELS * LABELS)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for n in range(1, steps + 1):
        w, start, step = theta[: width * LABELS].reshape(width, LABELS), theta[width * LABELS :][:LABELS], theta[-LABELS * LABELS :].reshape(LABELS, LABELS)
        emit = np.stack([np.bincount(slot, w[column, k], pages * longest) for k in range(LABELS)], 1).reshape(pages, longest, LABELS)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            moved = _log_sum(forward[:, t - 1, :, None] + step, 1) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], moved, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            moved = _log_sum(step + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1, None], moved, 0)
        norm = _log_sum(forward[:, -1], 1)[:, None]
        marginal = np.exp(forward + backward - norm[:, :, None]) * mask[:, :, None]
        pair = np.exp(forward[:, :-1, :, None] + step + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - norm[:, :, None, None])
        pair *= mask[:, 1:, None, None]
        d_emit = (marginal - one_hot).reshape(-1, LABELS) / blocks
        d_w = np.stack([np.bincount(column, d_emit[slot, k], width) for k in range(LABELS)], 1)
        gradient = np.concatenate([d_w.ravel(), (marginal[:, 0] - one_hot[:, 0]).sum(0) / blocks, (pair - both).sum((0, 1)).ravel() / blocks]) + ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
    w = theta[: width * LABELS].reshape(width, LABELS)
    step = theta[-LABELS * LABELS :].reshape(LABELS, LABELS)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in vocabulary.items()}, tuple(theta[width * LABELS :][:LABELS].tolist()), tuple(map(tuple, step.tolist())))


@cache
def default_field() -> Field:
    return train(drawn_pages())


def extract_main_text(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null html counts as empty; a page without main text has an empty text. Broken markup is read
    as far as it goes, like a browser does. Repeated rows and null keys stay rows; an empty table
    gives an empty result. Columns besides page_id, url and html are not read.
    """
    model = model or default_field()
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.text(html) for html in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
