"""A resident view of an index and a small JSON interface to it (WSGI, standard library only).

The view keeps what a search filters and scores cached in the executors, joined once a version; what a lost executor
held is read again from the version's tables. Full rows are read for the winners only, from the parts that hold them.
Every request compares version numbers and reloads when a writer has committed.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from socketserver import ThreadingMixIn
from urllib.parse import parse_qs
from wsgiref.simple_server import WSGIRequestHandler, WSGIServer, make_server

from .functions.cite import biblatex
from .operators import filters
from .operators import search as S
from .operators.derived import SEARCH_VIEW
from .operators.embed import embed_query
from .operators.store import Store
from .schema import SERVED_K


class ResidentView:
    """search, similar, status and cite over cached tables of one version."""

    def __init__(self, store: Store, embedder, reranker=None):
        store.check_model()
        self._store, self._reranker = store, reranker
        self._embed = S.cached_embedding(embed_query(embedder))
        self._lock = threading.Lock()
        self._state, self._listed, self._view = None, None, None

    def tables(self):
        """Of the newest version: its state, all papers with what a listing filters by, and the search view."""
        with self._lock:
            state = self._store.state()
            if self._state is None or state["version"] != self._state["version"]:
                self.close()
                self._listed = self._store.papers(state=state).select("id", "row", "categories", "update_date", "authors_folded").persist()
                self._view = SEARCH_VIEW.read(self._store, state).persist()
                self._state = state
            return self._state, self._listed, self._view

    def close(self) -> None:
        for held in (self._listed, self._view):
            if held is not None:
                held.unpersist()
        self._state = None

    def search(self, ask: "Ask") -> S.Found:
        state, listed, view = self.tables()
        if ask.text:
            return S.search_view(view, lambda ids: self._store.lookup(ids, state), ask.text, self._embed, ask.k, ask.categories, ask.since, ask.author, self._reranker if ask.rerank else None)
        newest = [r["id"] for r in S.browse(listed, ask.k, ask.categories, ask.since, ask.author).select("id").collect()]  # k of them
        return S.Found(S.browse(self._store.lookup(newest, state), ask.k), "date")

    def similar(self, ask: "Ask") -> S.Found:
        state, _, view = self.tables()
        return S.similar_in_view(view, lambda ids: self._store.lookup(ids, state), ask.id, ask.k, self._reranker if ask.rerank else None)

    def unranked(self, ask: "Ask") -> int:
        """How many papers the filters match, with or without a vector."""
        return S.count_matching(self.tables()[1], ask.categories, ask.since, ask.author)

    def status(self) -> dict:
        return self._store.status(self.tables()[0])

    def cite(self, ask: "Ask") -> str:
        found = self._store.lookup([ask.id], self.tables()[0]).select(biblatex()).first()
        if found is None:
            raise KeyError(f"{ask.id} is not in the index")
        return found[0]


@dataclass(frozen=True)
class Ask:
    """The parameters of a request. k is held within its bounds, categories outside the scope are left out, and a since
    that is no date is a ValueError."""

    text: str = ""
    author: str | None = None
    id: str = ""
    k: int = SERVED_K
    since: str | None = None
    rerank: bool = False
    categories: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, query_string: str) -> "Ask":
        given = parse_qs(query_string)
        last = {name: values[0].strip() for name, values in given.items()}
        k = last.get("k", "")
        return cls(
            text=last.get("q", ""),
            author=last.get("author") or None,
            id=last.get("id", ""),
            k=S.clamp_k(int(k)) if k.lstrip("-").isdecimal() else SERVED_K,
            since=filters.valid_date(last["since"]) if last.get("since") else None,
            rerank=last.get("rerank") in {"1", "true", "yes"},
            categories=filters.known_categories(given.get("cat")),
        )

    @property
    def empty(self) -> bool:
        return not any((self.text, self.author, self.since, self.categories))


def _hits(found: S.Found, started: float) -> dict:
    results = [json.loads(row) for row in found.hits.drop("authors_folded").toJSON().collect()]
    answer = {"results": results, "ms": round((time.perf_counter() - started) * 1000), "reranked": found.reranked}
    return answer | ({"warning": found.warning} if found.warning else {})


def _search(view: ResidentView, ask: Ask) -> dict:
    if ask.empty:
        raise ValueError("a query, an author, a category or a date is needed")
    started = time.perf_counter()
    found = view.search(ask)
    answer = _hits(found, started) | {"ranked": found.ranked}
    if ask.text and not answer["results"] and (waiting := view.unranked(ask)):
        answer["hint"] = f"{waiting} papers match but have no vector yet; without a query they are listed by date"
    return answer


def _similar(view: ResidentView, ask: Ask) -> dict:
    started = time.perf_counter()
    return _hits(view.similar(ask), started)


ROUTES: dict[str, Callable[[ResidentView, Ask], dict]] = {
    "/api/search": _search,
    "/api/similar": _similar,
    "/api/stats": lambda view, _: view.status(),
    "/api/bibtex": lambda view, ask: {"entry": view.cite(ask)},
}
#: What a route may raise, and how it is told.
FAULTS = ((KeyError, "404 Not Found"), (ValueError, "400 Bad Request"), (Exception, "500 Internal Server Error"))


def answer(view: ResidentView, path: str, query_string: str = "") -> tuple[str, dict]:
    """HTTP status and JSON content for a request."""
    route = ROUTES.get(path)
    if route is None:
        return "404 Not Found", {"error": f"no {path} here"}
    try:
        return "200 OK", route(view, Ask.of(query_string))
    except Exception as error:
        code = next(code for kind, code in FAULTS if isinstance(error, kind))
        return code, {"error": str(error.args[0] if error.args else error)}


def application(view: ResidentView) -> Callable[[dict, Callable], Iterable[bytes]]:
    def run(environ: dict, start_response: Callable) -> Iterable[bytes]:
        code, content = answer(view, environ.get("PATH_INFO", ""), environ.get("QUERY_STRING", ""))
        body = json.dumps(content, ensure_ascii=False, default=str).encode()
        start_response(code, [("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(body)))])
        return [body]

    return run


class _Server(ThreadingMixIn, WSGIServer):
    """A thread per request; closing waits for those under way."""

    daemon_threads = False


class _Quiet(WSGIRequestHandler):
    def log_message(self, *_) -> None:
        pass


def server(view: ResidentView, host: str = "127.0.0.1", port: int = 8000) -> WSGIServer:
    """A server that is bound but not yet running: serve_forever() runs it, shutdown() and server_close() end it."""
    return make_server(host, port, application(view), _Server, _Quiet)
