"""Requests as JSON, and the plans they stand for.

A ticket is a bare dataset name, or ``{"name", "limit", "filters", "search"}``; ``search`` has ``dataset``, ``vector`` or
``vectors``, ``k``, ``filters``, ``text_query``, ``alpha``, ``graph_alpha``, ``include_vectors``, ``metric``. Unknown keys of the ticket are skipped,
of the search an error; nulls are absent values. NaN and infinite numbers in vectors are errors. Nothing of a request is kept.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.operators import hybrid, knn, text_search
from sparkvec.operators.filters import Filter, apply, parse
from sparkvec.sources.store import Store


class RequestError(ValueError):
    pass


@dataclass(frozen=True)
class Search:
    dataset: str = ""
    vectors: tuple[tuple[float, ...], ...] = ()
    k: int = 10
    filters: tuple[Filter, ...] = ()
    text_query: str = ""
    alpha: float | None = None
    graph_alpha: float = 0.0
    include_vectors: bool = False
    metric: str = "euclidean"
    local_only: bool = False
    vector_format: str = ""


@dataclass(frozen=True)
class Ticket:
    name: str = ""
    limit: int = 0
    filters: tuple[Filter, ...] = ()
    search: Search | None = None


SEARCH_KEYS = {"dataset", "vector", "vectors", "k", "ef", "filters", "text_query", "alpha", "graph_alpha", "include_vectors", "metric", "local_only", "vector_format"}


def _vector(v: list) -> tuple[float, ...]:
    out = tuple(float(x) for x in v)
    if not all(math.isfinite(x) for x in out):
        raise RequestError("vectors must be finite")
    return out


def parse_search(obj: dict) -> Search:
    unknown = set(obj) - SEARCH_KEYS
    if unknown:
        raise RequestError(f"unknown keys {sorted(unknown)}")
    given = {k: v for k, v in obj.items() if v is not None}
    vectors = ([given["vector"]] if given.get("vector") else []) + list(given.get("vectors", []))
    k = int(given.get("k", 10))
    if k < 1:
        raise RequestError("k must be at least 1")
    alpha = given.get("alpha")
    if alpha is not None and not (alpha < 0 or 0 <= alpha <= 1):
        raise RequestError("alpha must be within 0 and 1, or negative to choose it by the text")
    s = Search(
        given.get("dataset", ""), tuple(_vector(v) for v in vectors), k, tuple(parse(f) for f in given.get("filters", ())), given.get("text_query", ""),
        None if alpha is None else float(alpha), float(given.get("graph_alpha", 0.0)), bool(given.get("include_vectors", False)), given.get("metric", "euclidean"),
        bool(given.get("local_only", False)), given.get("vector_format", ""),
    )
    if not s.vectors and not s.text_query:
        raise RequestError("a vector or a text is needed")
    return s


def parse_ticket(text: str) -> Ticket:
    if not text.lstrip().startswith("{"):
        return Ticket(name=text.strip())
    try:
        obj = json.loads(text)
    except ValueError as e:
        raise RequestError(str(e)) from e
    search = parse_search(obj["search"]) if obj.get("search") else None
    return Ticket(obj.get("name") or (search.dataset if search else ""), int(obj.get("limit") or 0), tuple(parse(f) for f in obj.get("filters") or ()), search)


def effective_alpha(s: Search) -> float:
    """1 without a text, 0 without a vector; as given; 0.5 where absent; by the number of words where negative."""
    if not s.text_query:
        return 1.0
    if not s.vectors:
        return 0.0
    if s.alpha is None:
        return 0.5
    return hybrid.auto_alpha_of(s.text_query) if s.alpha < 0 else s.alpha


def planned(store: Store, ticket: Ticket) -> DataFrame:
    """The DataFrame that answers a ticket."""
    if ticket.search is None:
        return store.scan(ticket.name, ticket.filters, limit=ticket.limit)
    s = ticket.search
    name = s.dataset or ticket.name
    rows = apply(store.scan(name), [*ticket.filters, *s.filters])
    vector_col = next((c for c in ("vector", "embedding") if c in rows.columns), None)
    alpha = effective_alpha(s)
    if vector_col is None and alpha != 0:
        raise RequestError("the dataset has no vectors")
    n = max(len(s.vectors), 1)
    queries = store.spark.createDataFrame([(i, list(s.vectors[i]) if s.vectors else None, s.text_query) for i in range(n)], "query_id bigint, vector array<double>, text string")
    if s.vectors:
        rows = knn.check_dimension(rows, vector_col, len(s.vectors[0]))
    texts = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string"]
    docs = text_search.documents(store.scan(name), "id", *texts) if alpha != 1 else None
    keep = rows.select("id") if ticket.filters or s.filters else None
    out = hybrid.search(queries, rows, docs, s.k, alpha, s.metric, "id", vector_col or "vector", s.graph_alpha, store.edges(name) if s.graph_alpha > 0 else None, keep)
    if alpha == 1 and s.graph_alpha <= 0:
        out = knn.batch(queries, rows, s.k, s.metric, id_col="id", vector_col=vector_col)
    if s.include_vectors and vector_col:
        out = knn.with_vectors(out, rows, "id", vector_col)
    return out.limit(ticket.limit) if ticket.limit else out
