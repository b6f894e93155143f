import json
import threading
import urllib.error
import urllib.request

from lodestone.serve import make_server
from lodestone.sources.collections import Collection, Registry


def test_server():
    def ask(question, collection, codes):
        if "boom" in question:
            raise RuntimeError("no model")
        return {"text": question, "collection": collection, "codes": codes}

    server = make_server(Registry([Collection("a", "A"), Collection("b")]), lambda: ["a"], ask)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/api"

    def post(path, body):
        try:
            with urllib.request.urlopen(f"{base}/{path}", json.dumps(body).encode()) as r:
                return r.status, r.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode()

    with urllib.request.urlopen(f"{base}/collections") as r:
        assert json.load(r) == [{"id": "a", "label": "A", "language": "he"}]
    assert json.loads(post("ask", {"question": "why so?", "collection": "zz", "topicCodes": ["7.1"]})[1]) == {"text": "why so?", "collection": "a", "codes": ["7.1"]}
    assert post("ask", {"question": "x"})[0] == 400 and post("ask", {"question": "fine", "topicCodes": ["1"] * 9})[0] == 400
    assert post("ask", {"question": "boom"})[0] == 500 and post("nope", {})[0] == 404
    events = post("ask-stream", {"question": "stream it"})[1]
    assert "event: token" in events and "event: done" in events and "event: error" in post("ask-stream", {"question": "boom"})[1]
    server.shutdown()


def test_pieces_come_as_they_are_made():
    def stream(question, collection, codes):
        yield "one "
        yield "two"
        yield {"text": "one two"}

    server = make_server(Registry([Collection("a")]), lambda: ["a"], lambda *x: {}, stream=stream)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/api/ask-stream", json.dumps({"question": "stream it"}).encode()) as r:
        events = r.read().decode()
    assert events.count("event: token") == 2 and events.index("one ") < events.index("two") < events.index("event: done")
    server.shutdown()
