import json
import pickle
import threading
import time
import urllib.error
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

import semloom as sl
from semloom.operators.http_provider import HTTPProvider
from semloom.operators.provider import Request


@pytest.fixture
def server():
    seen = {"posts": [], "fail": [], "keys": set()}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen["posts"].append((self.path, body))
            seen["keys"].add(self.headers.get("Authorization"))
            if seen["fail"]:
                code = seen["fail"].pop(0)
                self.send_response(code)
                self.send_header("Retry-After", "0.01")
                self.end_headers()
                return
            if self.path.endswith("/embeddings"):
                reply = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
            else:
                sent = body["messages"][0]["content"]
                usage = {"prompt_tokens": 11, "completion_tokens": 3}
                if isinstance(sent, list):
                    kinds = [x["type"] for x in sent]
                    usage = {"prompt_tokens": 111, "completion_tokens": 3, "prompt_tokens_details": {"image_tokens": 40 * kinds.count("image_url"), "audio_tokens": 20 * kinds.count("input_audio")}}
                    sent = sent[0]["text"]
                good = "apple" in sent.split("Record:")[1]
                reply = {"choices": [{"message": {"content": f"ANSWER: {str(good).upper()}\n---"}}], "usage": usage}
            data = json.dumps(reply).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}/v1", seen
    httpd.shutdown()


def ask(text):
    return Request("filter", "names a fruit", {"text": text})


def test_answers_usage_and_names(server, monkeypatch):
    url, seen = server
    monkeypatch.setenv("SOME_KEY", "secret")
    provider = pickle.loads(pickle.dumps(HTTPProvider(url, {"local-large": "big"}, key_variable="SOME_KEY")))
    assert b"secret" not in pickle.dumps(provider)
    done = provider.complete([ask("an apple"), ask("a car"), ask("apple pie")])
    assert [c.text[8:12] for c in done] == ["TRUE", "FALS", "TRUE"]
    assert (done[0].input_tokens, done[0].output_tokens) == (11, 3) and done[0].cost("local-large") > 0
    assert {b["model"] for _, b in seen["posts"]} == {"big"} and seen["keys"] == {"Bearer secret"}


def test_busy_servers_are_asked_again(server):
    url, seen = server
    seen["fail"] += [429, 503]
    assert "TRUE" in HTTPProvider(url, wait=0.01).complete([ask("apple")])[0].text
    assert len(seen["posts"]) == 3
    seen["fail"] += [400]
    with pytest.raises(urllib.error.HTTPError):
        HTTPProvider(url, wait=0.01).complete([ask("apple")])
    seen["fail"] += [503] * 3
    with pytest.raises(urllib.error.HTTPError):
        HTTPProvider(url, wait=0.01, retries=2).complete([ask("apple")])
    with pytest.raises(urllib.error.URLError):
        HTTPProvider("http://127.0.0.1:9", wait=0.01, retries=1).complete([ask("apple")])


def test_rate_and_embeddings(server):
    url, seen = server
    began = time.monotonic()
    HTTPProvider(url, per_second=20).complete([ask("apple")] * 5)
    assert time.monotonic() - began >= 0.19
    assert HTTPProvider(url, embed_batch=2).embed(["a", "bbb", "cc"], "local-embed").tolist() == [[1, 1], [3, 1], [2, 1]]


def test_a_query_over_http(spark, server):
    url, _ = server
    data = sl.MemoryDataset("a", [{"text": t} for t in ("an apple", "a car", "apples", "none")])
    config = sl.QueryProcessorConfig(optimizer_strategy="none", provider=HTTPProvider(url))
    done = data.sem_filter("names a fruit").run(config)
    assert sorted(r["text"] for r in done) == ["an apple", "apples"]
    assert done.execution_stats.total_calls == 4


PNG, JPEG, WAV = b"\x89PNG\r\n\x1a\n rest", b"\xff\xd8\xff rest of it", b"RIFF0000WAVE"


def test_images_and_clips_are_sent_as_parts(own_cards, spark, server, tmp_path):
    """All five forms: images by path, encoded and by address; clips by path and encoded."""
    import base64

    from semloom.plans.models import ModelCard, register
    from semloom.types import AudioBase64, AudioFilepath, ImageBase64, ImageFilepath, ImageURL

    url, seen = server
    (tmp_path / "a.png").write_bytes(PNG)
    (tmp_path / "c.wav").write_bytes(WAV)
    jpeg, wav = base64.b64encode(JPEG).decode(), base64.b64encode(WAV).decode()
    cols = [("note", str), ("one", ImageFilepath), ("two", ImageBase64), ("three", ImageURL), ("heard", AudioFilepath), ("said", AudioBase64), ("more", list[ImageURL])]
    schema = [{"name": n, "type": k, "desc": ""} for n, k in cols]
    row = {"note": "an apple", "one": str(tmp_path / "a.png"), "two": jpeg, "three": "https://x.test/p.png", "heard": f"file://{tmp_path}/c.wav", "said": wav, "more": ["https://x.test/1.png", None, "https://x.test/2.png"]}
    bare = {"note": "a car"} | dict.fromkeys(n for n, _ in cols[1:])
    register(ModelCard("all-senses", 1e-6, 1e-5, 0.01, 80.0, frozenset({"text", "image", "audio"}), usd_per_image_token=3e-6, usd_per_audio_token=7e-6))
    config = sl.QueryProcessorConfig(optimizer_strategy="none", provider=HTTPProvider(url), available_models=["all-senses"])
    done = sl.MemoryDataset("m", [row, bare], schema).sem_filter("names a fruit").run(config)
    assert [r["note"] for r in done] == ["an apple"]
    sent = {type(p[1]["messages"][0]["content"]): p[1]["messages"][0]["content"] for p in seen["posts"]}
    assert set(sent) == {str, list}  # a record without any is sent as text
    prompt, *parts = sent[list]
    assert '"note": "an apple"' in prompt["text"] and jpeg not in prompt["text"] and '"more": "[image 2 attached]"' in prompt["text"]
    assert sorted(json.dumps(p, sort_keys=True) for p in parts) == sorted(json.dumps(p, sort_keys=True) for p in [
        {"type": "image_url", "image_url": {"url": f"data:image/png;base64,{base64.b64encode(PNG).decode()}"}},
        {"type": "image_url", "image_url": {"url": f"data:image/jpeg;base64,{jpeg}"}},
        *({"type": "image_url", "image_url": {"url": f"https://x.test/{x}"}} for x in ("p.png", "1.png", "2.png")),
        *[{"type": "input_audio", "input_audio": {"data": wav, "format": "wav"}}] * 2,
    ])
    (stats,) = done.execution_stats.operators
    assert (stats.input_tokens, stats.image_tokens, stats.audio_tokens, stats.output_tokens) == (122, 200, 40, 6)
    assert stats.cost == pytest.approx((122 - 240) * 1e-6 + 200 * 3e-6 + 40 * 7e-6 + 6 * 1e-5)


def test_a_wrong_key_raises_instead_of_dropping_rows(spark, server):
    from semloom.operators.ledger import AllCallsFailed

    url, seen = server
    seen["fail"] += [401] * 4
    data = sl.MemoryDataset("a", [{"text": t} for t in ("an apple", "a car", "apples", "none")])
    with pytest.raises(AllCallsFailed, match="401"):
        data.sem_filter("names a fruit").run(sl.QueryProcessorConfig(optimizer_strategy="none", provider=HTTPProvider(url)))
