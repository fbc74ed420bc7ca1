"""Settings, the HTTP protocol and advisors."""

import json
import threading
import urllib.error
import urllib.parse
import urllib.request
from http.server import ThreadingHTTPServer

import pytest

from graphloom.advice import Advisors
from graphloom.config import load
from graphloom.service import Service, handler, negotiate
from graphloom.store import Store


def test_layers(tmp_path):
    main = tmp_path / "c.toml"
    main.write_text('[server]\nbind = "0.0.0.0:1"\n[limits]\nmax_result_rows = 5\n')
    (tmp_path / "c.toml.d").mkdir()
    (tmp_path / "c.toml.d" / "10.toml").write_text("[limits]\nmax_result_rows = 6\n")
    c = load(str(main), env={"GRAPHLOOM_SERVER_MATERIALISE": "true", "OTHER": "x"}, flags={"server.bind": "h:2"})
    assert (c.server.bind, c.limits.max_result_rows, c.server.materialise) == ("h:2", 6, True)
    for env in ({"GRAPHLOOM_SERVER_NOPE": "1"}, {"GRAPHLOOM_SERVER_DEFAULT_GRAPH": "all"}):
        with pytest.raises(ValueError):
            load(env=env)


def test_negotiation():
    assert negotiate("")[1] == "xml" and negotiate("text/csv;q=0.5, application/json")[1] == "json" and negotiate("image/png")[1] == "xml"


def test_http(spark):
    service = Service(spark, Store.empty(spark))
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler(service))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"

    def call(path, data=None, kind="application/sparql-query", accept="application/sparql-results+json"):
        request = urllib.request.Request(url + path, data.encode() if data else None, {"Content-Type": kind, "Accept": accept})
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    assert call("/update", "INSERT DATA { <urn:a> <urn:p> 1 . GRAPH <urn:g> { <urn:b> <urn:p> 2 } }", "application/sparql-update")[0] == 204
    text = "SELECT ?s WHERE { ?s ?p ?o } ORDER BY ?s"
    status, body = call("/query?" + urllib.parse.urlencode({"query": text}))
    assert status == 200 and [b["s"]["value"] for b in json.loads(body)["results"]["bindings"]] == ["urn:a", "urn:b"]
    status, body = call("/query?default_graph=strict", text, accept="text/csv")
    assert body.split() == ["s", "urn:a"]
    assert json.loads(call("/query", urllib.parse.urlencode({"query": "ASK { <urn:a> ?p 1 }"}), "application/x-www-form-urlencoded")[1])["boolean"] is True
    assert call("/query", "CONSTRUCT { ?s <urn:q> ?o } WHERE { ?s <urn:p> ?o FILTER(?o = 1) }", accept="*/*")[1] == '<urn:a> <urn:q> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .\n'
    assert call("/query", "SELECT nonsense")[0] == 400 and call("/query")[0] == 400 and call("/nothing")[0] == 404
    assert 'graphloom_requests_total{kind="query"}' in call("/metrics")[1]
    server.shutdown()


def test_advice_is_checked():
    class Both:
        def translate(self, question):
            return "ASK { ?s ?p ?o }" if question == "any?" else "DROP ALL"

        def disable(self, query):
            return ["push-filters", "nonsense"]

    off, on = Advisors(), Advisors(plans=Both(), translator=Both())
    assert off.question("any?") is None and off.disabled("x") == () and off.mappings() == off.hot() == []
    assert on.question("any?") == "ASK { ?s ?p ?o }" and on.question("drop") is None and on.disabled("x") == ("push-filters",)
    assert [e.taken for e in on.audit.page()] == [True, False, False] and len(on.audit.page(after=0, size=1)) == 1
