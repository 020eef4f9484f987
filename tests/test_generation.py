"""Remote jobs against a small service on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pixelstrata.operators.models import generation_jobs
from pixelstrata.sources.generation import Service, generated


class Handler(BaseHTTPRequestHandler):
    looks: dict[str, int] = {}

    def log_message(self, *_):
        pass

    def answer(self, body, code=200):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

    def do_POST(self):
        graph = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
        text = graph["2"]["inputs"]["text"]
        self.answer({"error": "no such node"}, 400) if text == "refused" else self.answer({"prompt_id": text})

    def do_GET(self):
        kind, _, name = self.path[1:].partition("/")
        if kind.startswith("view"):
            return self.answer(b"", 404) if "lost" in self.path else self.answer(f"file {self.path.split('filename=')[1].split('&')[0]}".encode())
        looks = self.looks[name] = self.looks.get(name, 0) + 1
        if name == "gone" or name == "shaky" and looks < 3:
            return self.answer(b"", 500)
        if name == "silent" or looks < 2:
            return self.answer({})
        if name == "broken":
            return self.answer({name: {"status": {"status_str": "error", "messages": [["execution_error", {"node_type": "KSampler", "exception_message": "too large"}]]}}})
        images = {"none": [], "lost": [{"filename": "lost.png"}]}.get(
            name, [{"filename": f"{name}1.png"}, {"filename": "preview.png", "type": "temp"}, {"filename": f"{name}2.png"}]
        )
        return self.answer({name: {"status": {"status_str": "success"}, "outputs": {"7": {"images": images}}}})


def test_jobs_run_and_say_why_not(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        names = ["good", "shaky", "refused", "gone", "silent", "broken", "none", "lost"]
        jobs = generation_jobs(
            spark.createDataFrame([(i, n, 64, 64, i) for i, n in enumerate(names)], "job long, prompt string, width int, height int, seed long"),
            "model"
        )
        jobs = jobs.unionByName(spark.createDataFrame([(99, None, 1, 1, 1, "x")], jobs.schema)).repartition(4)
        rows = generated(jobs, Service(f"http://127.0.0.1:{server.server_port}", pause=0.02, silence=0.3, timeout=5)).collect()
    finally:
        server.shutdown()
    pictures = sorted((r.job, r.number, r.name, bytes(r.content)) for r in rows if r.error is None)
    assert pictures == [(j, i, f"{n}{i + 1}.png", f"file {n}{i + 1}.png".encode()) for j, n in ((0, "good"), (1, "shaky")) for i in (0, 1)]
    errors = {r.job: r.error for r in rows if r.error}
    assert set(errors) == {2, 3, 4, 5, 6, 7, 99}
    assert "no such node" in errors[2] and "answering" in errors[3] and "0.3" in errors[4] and "KSampler" in errors[5] and "no pictures" in errors[6] and "came down" in errors[7]
    assert [r.error for r in generated(jobs.filter("job = 0"), Service("http://127.0.0.1:9", timeout=1)).collect()][0].startswith("not sent")
