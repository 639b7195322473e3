"""Optional model engines: the model is loaded once per worker and fed Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start int, end int, type string, match string, score double, engine string"


def _gliner(labels: dict[str, str], threshold: float) -> Callable[[str], list[tuple[int, int, str, float]]]:
    from gliner import GLiNER

    model = GLiNER.from_pretrained("urchade/gliner_multi_pii-v1")
    return lambda text: [(e["start"], e["end"], labels[e["label"]], e["score"]) for e in model.predict_entities(text, list(labels), threshold=threshold)]


def _presidio(labels: dict[str, str], threshold: float) -> Callable[[str], list[tuple[int, int, str, float]]]:
    from presidio_analyzer import AnalyzerEngine

    engine = AnalyzerEngine()
    return lambda text: [(r.start, r.end, labels[r.entity_type], r.score) for r in engine.analyze(text, language="en") if r.entity_type in labels and r.score >= threshold]


LOADERS = {"gliner": _gliner, "presidio": _presidio}


def detect_with(docs: DataFrame, name: str, labels: dict[str, str], threshold: float) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = LOADERS[name](labels, threshold)
        for part in parts:
            rows = [(d, s, e, k, t[s:e], float(v), name) for d, t in zip(part["doc_id"], part["text"], strict=True) for s, e, k, v in detect(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "type", "match", "score", "engine"])

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)


def ask(docs: DataFrame, client: Callable[[str], str], most: int | None = None) -> DataFrame:
    """(doc_id, text, reply, status): a language model's replies. ``status`` is ok, failed (the reply is then empty) or, past
    ``most`` calls of a task where such a budget is set, unasked: what was not looked at is never taken for empty."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = most
        for part in parts:
            replies, states = [], []
            for text in part["text"]:
                reply, state = "[]", "unasked"
                if left is None or left > 0:
                    left = None if left is None else left - 1
                    try:
                        reply, state = client(text or ""), "ok"
                    except Exception:  # a model may fail on any text
                        state = "failed"
                replies.append(reply)
                states.append(state)
            yield part.assign(reply=replies, status=states)

    rows = docs.select("doc_id", "text")
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, reply string, status string")
