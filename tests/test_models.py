"""The HTTP adapter against a small server in this process."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lexweave import models as M


@pytest.fixture
def server():
    seen = {"connections": 0, "requests": 0, "close": False}

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            super().setup()
            seen["connections"] += 1

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen["requests"] += 1
            status = 500 if body.get("input") == ["bad"] else 200
            content = json.dumps({"embeddings": [[float(len(t))] for t in body["input"]]}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)
            self.close_connection = seen["close"]

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    M._connections.__dict__.clear()
    yield f"http://127.0.0.1:{httpd.server_port}", seen
    httpd.shutdown()


def test_a_connection_is_kept(server):
    url, seen = server
    model = M.HttpModel(url, "m", timeout=10)
    assert [model.embed(["a", "bb"]) for _ in range(5)] == [[[1.0], [2.0]]] * 5
    assert seen == {"connections": 1, "requests": 5, "close": False}


def test_a_closed_connection_is_opened_again(server):
    url, seen = server
    seen["close"] = True
    model = M.HttpModel(url, "m", timeout=10)
    assert [model.embed(["abc"]) for _ in range(3)] == [[[3.0]]] * 3
    assert seen["requests"] == 3


def test_errors(server):
    url, _ = server
    with pytest.raises(OSError, match="500"):
        M.HttpModel(url, "m", timeout=10).embed(["bad"])
    with pytest.raises(OSError):
        M.HttpModel("http://127.0.0.1:1", "m", timeout=2).embed(["a"])
